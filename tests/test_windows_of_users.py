"""X3 rolling distinct users and Q8a stored sketches, against brute force."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketlens.operators import usage

LOG = "event_id bigint, occurred_at timestamp_ntz, view_name string, session_id string"
AS_OF = "2024-03-31"


def _log(spark, n=600, users=40, seed=1):
    rng = random.Random(seed)
    rows = [(i, dt.datetime(2024, 2, 1) + dt.timedelta(days=rng.randrange(66), hours=rng.randrange(24)), rng.choice("abc"),
             None if rng.random() < .05 else f"u{rng.randrange(users)}") for i in range(n)]
    return rows, spark.createDataFrame(rows, LOG).repartition(4)


@pytest.mark.parametrize("window,users", [(1, 40), (7, 40), (7, 400), (20, 3)])
def test_rolling_users_equal_brute_force(spark, window, users):
    rows, log = _log(spark, users=users, seed=window)
    last = dt.date.fromisoformat(AS_OF)
    want = {}
    for back in range(30):
        day = last - dt.timedelta(days=back)
        want[day] = len({s for _, t, _, s in rows if s and day - dt.timedelta(days=window - 1) <= t.date() <= day})
    assert {r.day: r.users for r in usage.rolling_users(log, window, 30, AS_OF).collect()} == want


def test_rolling_users_of_nothing(spark):
    _, log = _log(spark)
    got = usage.rolling_users(log.where(F.lit(False)), 7, 5, AS_OF).collect()
    assert len(got) == 5 and {r.users for r in got} == {0}
    with pytest.raises(ValueError):
        usage.rolling_users(log, 0, 5, AS_OF)


def test_stored_sketches_answer_any_window(spark):
    rows, log = _log(spark, 20_000, 5_000, 3)
    daily = usage.daily_sketches(log).checkpoint()
    assert daily.count() <= 66 * 3
    for days in (1, 10, 30):
        got = {r.view_name: r for r in usage.window_from_sketches(daily, days, AS_OF).collect()}
        for r in usage.usage_by_view(log, days, AS_OF).collect():
            found = got.pop(r.view_name)
            assert (found.events, found.last_seen) == (r.events, r.last_seen)
            assert abs(found.sessions - r.sessions) <= usage.SKETCH_ERROR * r.sessions
        assert not got
