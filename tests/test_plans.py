"""Plan audit over every query of the catalog (sf0.001): no cartesian or nested-loop
joins, no window without a partition key, Python only in the adjacency block
product."""

import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from plan_audit import audit  # noqa: E402

from marketlens.plans import catalog  # noqa: E402

PYTHON_ALLOWED = ("q3", "f5_")


def test_registered_plans(spark):
    bad = {}
    for name, fn in catalog.QUERIES.items():
        a = audit(fn(spark, "/root/testdata/sf0.001"))
        if a["cartesian"] or a["nested_loop"] or a["unpartitioned_windows"]:
            bad[name] = a
        if a["python"] and not name.startswith(PYTHON_ALLOWED):
            bad[name] = a
    assert bad == {}
