"""Task loss: retried tasks give the same exact percentiles (separate JVM)."""

import json
import os
import subprocess
import sys


def test_retried_tasks_same_result():
    script = os.path.join(os.path.dirname(os.path.abspath(__file__)), "retry_job.py")
    proc = subprocess.run([sys.executable, script], capture_output=True, text=True, timeout=600)
    assert proc.returncode == 0, proc.stderr[-2000:]
    line = [x for x in proc.stdout.splitlines() if x.startswith("{")][-1]
    res = json.loads(line)
    assert res["clean"] == res["flaky"]
    assert set(res["clean"]) == {"hot", "a"}
