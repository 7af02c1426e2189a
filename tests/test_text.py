"""Formatting cases (ordinals, money) as Catalyst expressions."""

from marketlens.functions.text import money_text, ordinal_text


def test_ordinals(spark):
    ns = [1, 2, 3, 4, 11, 12, 13, 21, 22, 101]
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    got = [r[0] for r in df.select(ordinal_text("n")).collect()]
    assert got == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "22nd", "101st"]


def test_money(spark):
    vs = [500.0, 12500.0, 13500.0, 1500000.0, -2400000.0]
    df = spark.createDataFrame([(v,) for v in vs], "v double")
    got = [r[0] for r in df.select(money_text("v")).collect()]
    assert got == ["$500", "$13k", "$14k", "$1.5M", "$-2.4M"]


def test_percent_rounds_like_python_format(spark):
    from marketlens.functions.text import percent_text
    vals = [0.125, 0.705, 0.015, 0.7, 1 / 3, 0.995]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(percent_text("v")).collect()]
    assert got == [f"{v:.0%}" for v in vals]


from decimal import ROUND_HALF_UP, Decimal  # noqa: E402

from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


def _money_rule(v: float) -> str:
    """The documented rule, stated independently: half away from zero on the
    decimal value, millions to one place, thousands from 10,000, else dollars."""
    def r(x, places):
        return Decimal(repr(x)).quantize(Decimal(1).scaleb(-places), rounding=ROUND_HALF_UP)
    if abs(v) >= 1_000_000:
        return f"${r(v / 1_000_000, 1):,.1f}M"
    if abs(v) >= 10_000:
        return f"${r(v / 1_000, 0):,.0f}k"
    return f"${r(v, 0):,.0f}"


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.integers(-5_000_000, 5_000_000).map(lambda i: i / 2.0),
                          st.sampled_from([12_500.0, 13_500.0, 1_250_000.0, -2_450_000.0, 9_999.5])),
                min_size=1, max_size=20))
def test_money_matches_rule(spark, values):
    from marketlens.functions.text import money_text
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(money_text("v")).collect()]
    assert got == [_money_rule(v) for v in values]


def _ordinal_rule(n: int) -> str:
    last_two, last = n % 100, n % 10
    suffix = "th" if 10 <= last_two <= 20 else {1: "st", 2: "nd", 3: "rd"}.get(last, "th")
    return f"{n}{suffix}"


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 100_000), min_size=1, max_size=30))
def test_ordinal_matches_rule(spark, ns):
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    assert [r[0] for r in df.select(ordinal_text("n")).collect()] == [_ordinal_rule(n) for n in ns]
