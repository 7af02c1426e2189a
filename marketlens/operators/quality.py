"""Data-quality rules (D1-D11, D14, D16, D17) as one report DataFrame.

Each table is scanned once: a row becomes entries for the keys that its rules
look at, with the states of its row-level rules, and the entries of all tables
are merged by key, then by category, then into the report. The report has one row per rule:
``(rule_id, description, severity, table_name, violations, metric)``.

Severity tiers: ``fatal`` rejects a publish, ``warn`` loads and logs, ``note``
loads and marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens import schema

REPORT_COLUMNS = ["rule_id", "description", "severity", "table_name", "violations", "metric"]


def ordered_percentiles_ok() -> Column:
    """D1 as a CHECK: adjacent pairs only; a NULL comparison passes."""
    w = schema.WAGE_COLUMNS
    cond = F.lit(True)
    for lo, hi in zip(w, w[1:]):
        cond = cond & F.coalesce(F.col(lo) <= F.col(hi), F.lit(True))
    return cond


def _row(rule_id, description, severity, table_name, violations: Column,
         metric: Column | None = None) -> list[Column]:
    return [F.lit(rule_id).alias("rule_id"), F.lit(description).alias("description"),
            F.lit(severity).alias("severity"), F.lit(table_name).alias("table_name"),
            violations.cast("long").alias("violations"),
            (metric if metric is not None else F.lit(None)).cast("double").alias("metric")]


def _market_states() -> dict[str, Column]:
    """States of the row-level rules: a name, and the condition by which a row counts."""
    positive = F.coalesce(F.col("wage_p50") <= 0, F.lit(False)) | F.coalesce(F.col("employment") <= 0, F.lit(False))
    return {"d1": ~ordered_percentiles_ok(), "d2": positive, "matched": F.col("employment_prior").isNotNull(),
            **{f"d5_{c}": F.col(c).isNull() for c in schema.MARKET_REQUIRED}}


def _skill_states() -> dict[str, Column]:
    on_scale = F.col("importance").between(schema.IMPORTANCE_MIN, schema.IMPORTANCE_MAX)
    return {"d3": ~F.coalesce(on_scale, F.lit(True))}


def _entry(kind: str, category: Column | None = None, second: Column | None = None, third: Column | None = None,
           rows: int = 1, scoped: int = 0, value: Column | None = None) -> Column:
    none = F.lit(None)
    pick = lambda c, t, name: (none if c is None else c).cast(t).alias(name)
    return F.struct(F.lit(kind).alias("kind"), pick(category, "string", "category"), pick(second, "string", "second"),
                    pick(third, "string", "third"), F.lit(rows).cast("long").alias("rows"),
                    F.lit(scoped).cast("long").alias("scoped"), pick(value, "double", "value"))


def _entries(df: DataFrame, entries: list[Column], states: dict[str, Column]) -> DataFrame:
    """The entries of every row; its first one carries the row-level states."""
    flags = df.select(F.struct(*[cond.cast("long").alias(c) for c, cond in states.items()]).alias("_s"),
                      F.array(*entries).alias("_e")) if states else df.select(F.array(*entries).alias("_e"))
    each = flags.select(*(["_s"] if states else []), F.posexplode("_e").alias("_at", "_entry"))
    return each.select("_entry.*", *[F.when(F.col("_at") == 0, F.col(f"_s.{c}")).alias(c) for c in states])


def quality_report(market: DataFrame, skills: DataFrame,
                   scope: DataFrame | None = None) -> DataFrame:
    """Every rule in one report, from one scan of each table.

    Null categories are a category of their own, outside every scope and without skills. The rules D6 are
    reported only if there is a scope; its rows without a category are not read. Empty tables break no rule."""
    m_states, s_states = _market_states(), _skill_states()
    soc = F.col("soc_code")
    entries = (
        _entries(market, [_entry("cell", soc, F.col("area_code"), value=F.col("national_wage_p50")),
                          _entry("labels", soc, F.col("occupation"), F.col("occupation_group")),
                          _entry("place", None, F.col("area_code"))], m_states)
        .unionByName(_entries(skills, [_entry("skill", soc, F.col("skill"))], s_states), allowMissingColumns=True))
    if scope is not None:
        entries = entries.unionByName(
            _entries(scope.where(soc.isNotNull()),
                     [_entry("labels", soc, F.col("occupation"), F.col("occupation_group"), rows=0, scoped=1)], {}),
            allowMissingColumns=True)
    states = [*m_states, *s_states]
    added = [F.sum(c).alias(c) for c in states]
    keys = entries.groupBy("kind", "category", "second", "third").agg(
        F.sum("rows").alias("rows"), F.sum("scoped").alias("scoped"),
        F.min("value").alias("low"), F.max("value").alias("high"), *added)

    # per category; places have none and merge into the null category, told apart by their kind
    def count(kind: str, cond: Column | None = None) -> Column:
        return F.count_if((F.col("kind") == kind) & (F.lit(True) if cond is None else cond))

    labels = F.col("kind") == "labels"
    category = keys.groupBy("category").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "cell", F.col("rows"))), F.lit(0)).alias("n"),
        count("cell", F.col("rows") > 1).alias("twice_m"), count("skill", F.col("rows") > 1).alias("twice_s"),
        (F.min("low") < F.max("high")).alias("varies"), count("skill").alias("skills"),
        count("skill", F.col("second").isNotNull()).alias("named"),
        count("place", F.col("second").isNotNull()).alias("places"),
        count("labels", F.col("rows") > 0).alias("labels"), F.sum(F.when(labels, F.col("scoped"))).alias("scoped"),
        F.sum(F.when(labels & (F.col("rows") > 0), F.col("scoped"))).alias("agree"), *added)
    in_scope = F.coalesce(F.col("scoped"), F.lit(0))
    has_skills = F.col("skills") > 0
    per_size = category.groupBy(F.when(has_skills, F.col("named")).alias("size")).agg(
        F.count(F.lit(1)).alias("categories"), F.sum("n").alias("n"), F.sum("twice_m").alias("twice_m"),
        F.sum("twice_s").alias("twice_s"), F.count_if("varies").alias("varies"), F.sum("places").alias("places"),
        F.count_if((F.col("n") > 0) & (~has_skills | F.col("category").isNull())).alias("bare"),
        F.sum(F.when(in_scope == 0, F.col("n"))).alias("outside"),
        F.sum(F.col("labels") * in_scope - F.coalesce(F.col("agree"), F.lit(0))).alias("disagree"), *added)
    sized = F.when(F.col("size").isNotNull(), F.col("categories"))
    total = per_size.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c)
          for c in ["n", "twice_m", "twice_s", "varies", "places", "bare", "outside", "disagree", *states]],
        (F.coalesce(F.sum(sized), F.lit(0)) - F.coalesce(F.max_by(sized, "size"), F.lit(0))).alias("ragged"))
    c = F.col
    rows = [
        _row("D1", "wage percentiles ordered (adjacent pairs)", "fatal", "market", c("d1")),
        _row("D2", "positive median wage and employment", "fatal", "market", c("d2")),
        *[_row("D5", f"required column {x} not null", "fatal", "market", c(f"d5_{x}")) for x in schema.MARKET_REQUIRED],
        _row("D11", "share of rows matched to the prior vintage", "warn", "market",
             F.lit(0), c("matched") / F.when(c("n") > 0, c("n"))),
        _row("D4", f"unique key ({', '.join(schema.MARKET_KEYS)})", "fatal", "market", c("twice_m")),
        _row("D7", "national_wage_p50 constant within soc_code", "fatal", "market", c("varies")),
        _row("D3", "importance between 1 and 5", "fatal", "skills", c("d3")),
        _row("D4", f"unique key ({', '.join(schema.SKILL_KEYS)})", "fatal", "skills", c("twice_s")),
        _row("D8", "every category carries the full skill vector", "fatal", "skills", c("ragged")),
        _row("D9", "every market category has a skill vector", "warn", "market", c("bare")),
        # few distinct places: a synthetic fixture
        _row("D16", f"synthetic if at most {schema.SYNTHETIC_MAX_METROS} places", "note", "market", F.lit(0), c("places"))]
    if scope is not None:
        rows += [_row("D6", "category in scope", "fatal", "market", c("outside")),
                 _row("D6", "labels agree with the scope dimension", "fatal", "market", c("disagree"))]
    return total.select(F.inline(F.array(*[F.struct(*r) for r in rows]))).select(*REPORT_COLUMNS)


def is_synthetic(report: DataFrame) -> DataFrame:
    """D16 as a flag: one row, whether the report's market has no more places than a fixture."""
    return (report.where(F.col("rule_id") == "D16")
            .select((F.col("metric") <= schema.SYNTHETIC_MAX_METROS).alias("synthetic")))


def load_summary(market: DataFrame, skills: DataFrame) -> DataFrame:
    """Rows, distinct categories and places, skill rows (one row, no join)."""
    t = market.agg(F.count(F.lit(1)).alias("market_rows"),
                   F.countDistinct("soc_code").alias("occupations"),
                   F.countDistinct("area_code").alias("metros"))
    s = skills.agg(F.count(F.lit(1)).alias("skill_rows"))
    stacked = t.unionByName(s, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def row_count_drift(current: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """Rows added / removed between two versions of a table, by key."""
    a = current.select(*keys).distinct()
    b = previous.select(*keys).distinct()
    added = a.join(b, keys, "left_anti").agg(F.count(F.lit(1)).alias("added"))
    removed = b.join(a, keys, "left_anti").agg(F.count(F.lit(1)).alias("removed"))
    stacked = added.unionByName(removed, allowMissingColumns=True)
    return stacked.agg(F.max("added").alias("added"), F.max("removed").alias("removed"))


def fatal_violations(report: DataFrame) -> DataFrame:
    return report.where((F.col("severity") == "fatal") & (F.col("violations") > 0))


#: A value is an outlier if it lies more than this many robust standard deviations from the series' median.
DRIFT_LIMIT = 3.5
#: Robust standard deviation of a normal series, in median absolute deviations.
MAD_SCALE = 1.4826
#: Relative difference below which two values are the same: sums of doubles depend on the order of rows.
DRIFT_NOISE = 1e-9


def version_metrics(market: DataFrame, skills: DataFrame) -> DataFrame:
    """``(metric, value)`` of one version, one aggregate a table."""
    m = market.agg(F.count(F.lit(1)).cast("double").alias("market_rows"),
                   F.count_distinct("soc_code").cast("double").alias("categories"),
                   F.count_distinct("area_code").cast("double").alias("places"),
                   F.sum("employment").alias("employment"), F.avg("wage_p50").alias("mean_median_wage"),
                   F.avg(F.col("employment_prior").isNotNull().cast("double")).alias("prior_match_rate"))
    s = skills.agg(F.count(F.lit(1)).cast("double").alias("skill_rows"), F.avg("importance").alias("mean_importance"))

    def long(df: DataFrame) -> DataFrame:
        return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in df.columns])))
    return long(m).unionByName(long(s))


def drift_history(series: DataFrame) -> DataFrame:
    """D17 over any number of versions: each value of ``series(version, committed_at, metric, value)`` against its
    metric's median over all versions, in robust standard deviations (``score``; null where most of the series
    stands still, up to ``DRIFT_NOISE``). ``outlier``: beyond ``DRIFT_LIMIT``, or off a series that stands still.
    Null values have neither. The series of a metric has one value a version."""
    middle = series.groupBy("metric").agg(F.median("value").alias("typical"))
    apart = series.join(middle, "metric").withColumn("_off", F.col("value") - F.col("typical"))
    spread = apart.groupBy("metric").agg((F.median(F.abs("_off")) * MAD_SCALE).alias("_spread"))
    noise = F.abs(F.col("typical")) * DRIFT_NOISE
    moving = F.col("_spread") > noise
    score = F.when(moving, F.col("_off") / F.col("_spread"))
    outlier = F.when(moving, F.abs(score) > DRIFT_LIMIT).otherwise(F.abs("_off") > noise)
    return (apart.join(spread, "metric")
            .select("committed_at", "version", "metric", "value", "typical", score.alias("score"), outlier.alias("outlier")))
