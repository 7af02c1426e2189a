"""Exact order statistics per key that stay balanced when one key is huge.

A window ``PARTITION BY key ORDER BY value`` sends every row of a key to one task.
For a mart whose grain is unique per (category, place) that task holds at most
one row per place, which is a dimension-sized bound, so the plain window form is
offered for that case. Over raw rows (a category may hold a third of all rows)
the distributed form is used instead:

1. pre-aggregate ``(key, value) -> weight`` (map-side combine, ties collapse);
2. range-partition on ``(key, value)`` so a hot key is split across many tasks;
3. prefix sums inside each range partition, plus one offset per
   ``(key, partition)`` taken from a table of at most ``#keys + #partitions`` rows;
4. every ``(key, value)`` row then knows how many rows precede it and the key
   total, which is enough for percent-rank and for exact ``percentile_cont``
   (each row tests locally whether the interpolation positions fall inside it,
   and a partial-aggregated ``groupBy(key)`` picks them up).

The range-partitioned, pre-aggregated table is checkpointed to the reliable
checkpoint folder so partition ids stay stable if a stage is recomputed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class Order:
    """One ordering term: column name, direction and null placement."""

    column: str
    ascending: bool = True
    nulls_first: bool | None = None   # None: Spark default (asc: first, desc: last)

    def sort(self, c: Column | None = None) -> Column:
        c = F.col(self.column) if c is None else c
        nf = self.nulls_first
        if self.ascending:
            return c.asc_nulls_last() if nf is False else c.asc_nulls_first()
        return c.desc_nulls_first() if nf is True else c.desc_nulls_last()


def cumulative_before(df: DataFrame, keys: list[str], order: Order,
                      weight: str | None = None, unique: bool = False) -> DataFrame:
    """Rows ``(keys, value, _w, _before, _total)``, one per distinct (keys, value).

    ``_before`` is the total weight of rows of the same key strictly ahead in
    ``order``; ``_total`` the key's total weight. ``weight`` names a pre-computed
    count column; without it every input row weighs 1. ``unique=True`` states that
    (keys, value) is already unique with its weight in ``weight`` (skips a shuffle).
    """
    v = order.column
    ranged = range_layout(df, keys, order, weight, unique)

    local_w = (Window.partitionBy(*keys, "_pid").orderBy(order.sort())
               .rowsBetween(Window.unboundedPreceding, -1))
    local = ranged.withColumn("_local", F.coalesce(F.sum("_w").over(local_w), F.lit(0)))

    per_part = ranged.groupBy(*keys, "_pid").agg(F.sum("_w").alias("_pw"))
    by_pid = Window.partitionBy(*keys).orderBy("_pid")
    offsets = (per_part
               .withColumn("_offset", F.coalesce(
                   F.sum("_pw").over(by_pid.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)))
               .withColumn("_total", F.sum("_pw").over(Window.partitionBy(*keys)))
               .drop("_pw"))

    return (local.join(offsets, [*keys, "_pid"])
            .select(*keys, v, "_w",
                    (F.col("_offset") + F.col("_local")).alias("_before"), "_total"))


def range_layout(df: DataFrame, keys: list[str], order: Order, weight: str | None = None,
                 unique: bool = False, partitions: int | None = None) -> DataFrame:
    """``(keys, value, _w, _pid)``: the pre-aggregated rows range-partitioned on
    (keys, value) and checkpointed, so a hot key spans many partitions and the
    partition ids are stable under recomputation.

    Without ``partitions`` the range count starts at ``spark.sql.shuffle.partitions``
    and AQE sizes it by data volume; coalescing only merges neighbouring ranges, so
    partition ids stay in key/value order."""
    v = order.column
    if unique and weight:
        grouped = df.select(*keys, v, F.col(weight).cast("long").alias("_w"))
    else:
        w = F.sum(weight) if weight else F.count(F.lit(1))
        grouped = df.groupBy(*keys, v).agg(w.cast("long").alias("_w"))
    ensure_checkpoint_dir(df.sparkSession)
    sort = [*[F.col(k).asc() for k in keys], order.sort()]
    ranged = (grouped.repartitionByRange(partitions, *sort) if partitions
              else grouped.repartitionByRange(*sort))
    return (ranged
            .withColumn("_pid", F.spark_partition_id())
            .checkpoint(eager=True))


def percent_rank_window(keys: list[str], order: Order) -> Column:
    """``PERCENT_RANK() OVER (PARTITION BY keys ORDER BY order)``."""
    return F.percent_rank().over(Window.partitionBy(*keys).orderBy(order.sort()))


def percent_rank_distributed(df: DataFrame, keys: list[str], order: Order,
                             out: str, kind: str = "percent_rank") -> DataFrame:
    """Adds ``out`` = (rows strictly ahead) / (n - 1), 0 when n = 1; same result as
    :func:`percent_rank_window` including ties and nulls, without a per-key task.
    ``kind="rank"`` gives ``RANK()`` (rows strictly ahead + 1) instead."""
    v = order.column
    ranks = cumulative_before(df.select(*keys, v), keys, order)
    if kind == "percent_rank":
        value = (F.when(F.col("_total") <= 1, F.lit(0.0))
                 .otherwise(F.col("_before") / (F.col("_total") - 1)))
    elif kind == "rank":
        value = (F.col("_before") + 1).cast("long")
    else:
        raise ValueError(f"unknown kind {kind!r}")
    ranks = ranks.select(
        *[F.col(k).alias(f"_rk_{k}") for k in keys], F.col(v).alias("_rk_v"), value.alias(out))
    cond = [df[k] == ranks[f"_rk_{k}"] for k in keys] + [df[v].eqNullSafe(ranks["_rk_v"])]
    return df.join(ranks, cond, "left").drop(*[f"_rk_{k}" for k in keys], "_rk_v")


def _placed(order: Order) -> tuple[Column, Column]:
    """``(_null, _v)`` that sort ascending as ``order`` sorts: nulls before (-1) or after (1) the values (0),
    descending values negated."""
    c = F.col(order.column).cast("double")
    first = order.ascending if order.nulls_first is None else order.nulls_first
    value = c if order.ascending else F.lit(0.0) - c
    return F.when(c.isNull(), F.lit(-1 if first else 1)).otherwise(F.lit(0)), F.coalesce(value, F.lit(0.0))


def _melt(orders: list[Order], first: list[Column] | None = None) -> Column:
    """One element per order: ``(_measure, _null, _v)``; ``first`` rides along the first one only."""
    out = []
    for i, order in enumerate(orders):
        null, v = _placed(order)
        fields = [F.lit(i).alias("_measure"), null.alias("_null"), v.alias("_v")]
        if first:
            row = F.struct(*first)
            fields.append((row if not i else F.when(F.lit(False), row)).alias("_row"))
        out.append(F.struct(*fields))
    return F.explode(F.array(*out)).alias("_m")


def rank_layout(df: DataFrame, keys: list[str], orders: list[Order]) -> DataFrame:
    """Several orders of the same rows, ranked from one range layout.

    The orders are melted into ``(_measure, keys, _null, _v)``, pre-aggregated to distinct values with their
    weight ``_w``, range-partitioned once and given one set of offsets: ``_before`` is the number of rows of
    the key strictly ahead of a value in that order (``_measure``: its place in ``orders``), ``_total`` the key's rows."""
    values = df.select(*keys, _melt(orders)).select("_m._measure", *keys, "_m._null", "_m._v")
    by = ["_measure", *keys]
    grouped = values.groupBy(*by, "_null", "_v").agg(F.count(F.lit(1)).alias("_w"))
    ensure_checkpoint_dir(df.sparkSession)
    ranged = (grouped.repartitionByRange(*by, "_null", "_v").withColumn("_pid", F.spark_partition_id())
              .checkpoint(eager=True))
    local = Window.partitionBy(*by, "_pid").orderBy("_null", "_v").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy(*by, "_pid").agg(F.sum("_w").alias("_pw"))
               .withColumn("_offset", F.coalesce(F.sum("_pw").over(ahead), F.lit(0)))
               .withColumn("_total", F.sum("_pw").over(Window.partitionBy(*by))).drop("_pw"))
    return (ranged.withColumn("_local", F.coalesce(F.sum("_w").over(local), F.lit(0)))
            .join(offsets, [*by, "_pid"])
            .select(*by, "_null", "_v", "_w", (F.col("_offset") + F.col("_local")).alias("_before"), "_total"))


def attach_ranks(df: DataFrame, keys: list[str], row_keys: list[str], orders: dict[str, Order],
                 layout: DataFrame) -> DataFrame:
    """``df`` with ``_before_<name>`` and ``_total`` of every order, by one join on the values and one grouping
    by the row key, which must be unique. ``layout``: the :func:`rank_layout` of the same orders."""
    names = list(orders)
    rows = (df.select(*row_keys, _melt(list(orders.values()), [F.col(c) for c in df.columns]))
            .select(*row_keys, "_m.*"))
    met = rows.join(layout.drop("_w"), ["_measure", *keys, "_null", "_v"])
    out = met.groupBy(*row_keys).agg(
        F.first("_row", ignorenulls=True).alias("_row"), F.max("_total").alias("_total"),
        *[F.max(F.when(F.col("_measure") == i, F.col("_before"))).alias(f"_before_{n}") for i, n in enumerate(names)])
    return out.select("_row.*", "_total", *[f"_before_{n}" for n in names])


def percentile_cont_distributed(df: DataFrame, keys: list[str], value: str,
                                fractions: dict[str, float],
                                weight: str | None = None, unique: bool = False) -> DataFrame:
    """Exact ``PERCENTILE_CONT(p) WITHIN GROUP (ORDER BY value)`` per key for each
    ``name -> p`` in ``fractions``; nulls ignored. One row per key."""
    base = df.where(F.col(value).isNotNull())
    cum = cumulative_before(base, keys, Order(value, True, False), weight=weight, unique=unique)
    return _interpolated(cum, keys, value, fractions)


def _interpolated(cum: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """The percentiles from ``(keys, value, _w, _before, _total)`` rows, which hold all that a position falls on."""
    last = F.col("_before") + F.col("_w") - 1
    aggs = []
    cols = []
    for name, p in fractions.items():
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        at_lo = (F.col("_before") <= lo) & (lo <= last)
        at_hi = (F.col("_before") <= hi) & (hi <= last)
        aggs += [F.max(F.when(at_lo, F.col(value))).alias(f"_{name}_lo"),
                 F.max(F.when(at_hi, F.col(value))).alias(f"_{name}_hi"),
                 F.max(pos - lo).alias(f"_{name}_f")]
        lo_v, hi_v, frac = F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), F.col(f"_{name}_f")
        cols.append((lo_v + (hi_v - lo_v) * frac).alias(name))
    return cum.groupBy(*keys).agg(*aggs).select(*keys, *cols)


#: Buckets of a value for each factor of e.
BUCKETS = 256
#: Buckets up to this number are broadcast to the rows.
_BROADCAST = 100_000


def value_bucket(value: str) -> Column:
    """A bucket number that never falls as the value rises (NaN last); null for null."""
    x = F.col(value).cast("double")
    size = F.floor(F.least(F.log1p(F.abs(x)), F.lit(1000.0)) * BUCKETS)
    return F.when(F.isnan(x), F.lit(1 << 20)).otherwise(F.signum(x) * size).cast("int")


def percentile_buckets(counts: DataFrame, keys: list[str], fractions: dict[str, float]) -> DataFrame:
    """``(keys, _b, _ahead, _total)`` of the buckets that a percentile's position falls on, from the rows ``n`` of every
    ``(keys, _b)``: ``_ahead`` rows of the key lie in lower buckets, ``_total`` in all."""
    by = Window.partitionBy(*keys)
    placed = counts.select(
        *keys, "_b", "n", F.sum("n").over(by).alias("_total"),
        F.coalesce(F.sum("n").over(by.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    held = F.lit(False)
    for p in fractions.values():
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        for at in (F.floor(pos), F.ceil(pos)):
            held = held | ((F.col("_ahead") <= at) & (at < F.col("_ahead") + F.col("n")))
    ensure_checkpoint_dir(counts.sparkSession)
    out = placed.where(held).select(*keys, "_b", "_ahead", "_total").checkpoint(eager=True)
    return F.broadcast(out) if out.limit(_BROADCAST + 1).count() <= _BROADCAST else out


def percentile_cont_in_buckets(rows: DataFrame, buckets: DataFrame, keys: list[str], value: str,
                               fractions: dict[str, float]) -> DataFrame:
    """Exact ``PERCENTILE_CONT`` as :func:`percentile_cont_distributed`, from the ``rows(keys, _b, value)`` of the
    :func:`percentile_buckets` alone: the others are counted, not sorted."""
    by = [*keys, "_b"]
    cum = (cumulative_before(rows, by, Order(value, True, False)).drop("_total").join(buckets, by)
           .withColumn("_before", F.col("_before") + F.col("_ahead")))
    return _interpolated(cum, keys, value, fractions)
