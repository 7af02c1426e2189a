"""Raw landing-file readers (I1, I3, I23) and raw vintages derived from the
driver tables.

Readers take a folder of any number of files; every column is read as a string
(no inference), the vintage comes from a ``vintage=...`` folder (partition
discovery) and ``src_row`` keeps file order for keep-first dedup.

The derived raw frames turn the driver tables into published-style rows so the
whole cleaning path runs on data that grows with the inputs. Per vintage
(current = shipped on/after the cut, prior = before) they hold:

* all-industry cell rows (category x place, NAICS 000000, detailed level),
* one industry row per return flag (NAICS ``54`` + code), dropped by I6,
* non-metropolitan rows per region (AREA_TYPE 2), dropped by I5,
* major-group summary rows per family (``O_GROUP=Major``), dropped by I5,
* a restated copy of every cell in places whose code is divisible by 7, with a
  doubled count and a later source position, removed by keep-first (I9).

Formatting exercises the cleaner: counts with thousands separators and ``~``
below 30, ``$`` on p10, padded medians and ``*`` for cells of fewer than three
lines, ``#`` for p90 at or above 100,000.
"""

from __future__ import annotations

import csv
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens import schema
from marketlens.functions.columns import exact_mean
from marketlens.session import ensure_checkpoint_dir
from marketlens.sources.testmart import CURRENT_VINTAGE_START, table


# ---------------------------------------------------------------- readers --
#: Lines of a file among which a header is looked for when its place is not given.
HEADER_LINES = 5
#: Vintages with faulty files that one error message names.
NAMED = 10


class LandingError(ValueError):
    """Landing files that break the header contract; ``faults`` has one row a vintage."""

    def __init__(self, message: str, faults: list):
        super().__init__(message)
        self.faults = faults


def landing_files(spark: SparkSession, path: str, sep: str = ",", header_row: int | None = 0,
                  wanted: tuple[str, ...] = ()) -> DataFrame:
    """``(vintage, file, above, lines, open_quotes)``, one row per landing file, from one scan of the text.

    ``above`` holds the lines down to the header (the first line; without a ``header_row`` the first of
    ``HEADER_LINES`` that holds every wanted word, else the first). ``lines`` counts all lines, ``open_quotes``
    those with a quoted cell and an odd number of quotes: the cell goes on in the next line. The files are
    scanned once, by as many tasks as their size asks for, whatever their number."""
    file = F.col("_metadata.file_path")
    text = spark.read.text(path).select("value", file.alias("file"), F.col("_metadata.file_block_start").alias("at"),
                                        F.monotonically_increasing_id().alias("id"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    opened = (quotes % 2 == 1) & F.col("value").rlike(rf'(^|[{sep}])"')
    counted = text.groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(opened).alias("open_quotes"),
        F.min_by("value", F.struct("at", "id")).alias("first"))
    if header_row == 0:
        out = counted.withColumn("above", F.array("first"))
    else:
        top = (text.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("at", "id")))
               .where(F.col("n") <= (HEADER_LINES if header_row is None else header_row + 1)))
        tops = top.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("n", "value")))["value"].alias("top"))
        if header_row is None:
            fits = F.array_position(F.transform("top", lambda x: F.forall(
                F.array(*[F.lit(w) for w in wanted]), lambda w: F.contains(F.lower(x), w))), True)
            size = F.greatest(fits, F.lit(1)) if wanted else F.lit(1)
        else:
            size = F.lit(header_row + 1)
        out = counted.join(tops, "file").withColumn("above", F.slice("top", F.lit(1), size.cast("int")))
    return out.select(_vintage(F.col("file")).alias("vintage"), "file", "above", "lines", "open_quotes")


def _vintage(file) -> F.Column:
    """The value of the ``vintage=`` folder in a file's path as Spark shows it: that path is URL-encoded, and a
    folder's name has its special characters escaped the same way."""
    name = F.regexp_extract(file, "/vintage=([^/]+)/", 1)
    for _ in range(2):
        name = F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)
    return F.when(name != "", name)


def _cells(files: DataFrame, sep: str) -> DataFrame:
    """``files`` with ``names``: the cells of each file's header line, trimmed."""
    def parse(batches):
        for b in batches:
            above = b.column("above").to_pylist()
            names = [[c.strip() for c in next(csv.reader([x[-1].removeprefix("\ufeff")], delimiter=sep), [])] for x in above]
            yield b.append_column("names", pa.array(names, pa.list_(pa.string())))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(parse, f"{fields}, names array<string>")


def header_contract(spark: SparkSession, path: str, required: list[str] | tuple[str, ...] = (), sep: str = ",",
                    header_row: int | None = 0, wanted: tuple[str, ...] = (), upper: bool = False) -> DataFrame:
    """I2 over any number of landing files: ``(vintage, file, n_columns, n_rows, missing, verdict)`` and, for the
    reader, ``above`` and ``names``.

    ``verdict``, the first that holds: ``missing`` (required columns that the file lacks), ``repeated`` (a column name
    twice), ``disagrees`` (its columns differ from those of its vintage's first file), ``open quote`` (a quoted cell
    goes on in the next line, which would become rows of its own), ``no rows``, or ``ok``. Names are compared
    trimmed and, with ``upper``, in capitals."""
    files = _cells(landing_files(spark, path, sep, header_row, wanted), sep)
    if upper:
        files = files.withColumn("names", F.transform("names", F.upper))
    ensure_checkpoint_dir(spark)
    files = files.checkpoint(eager=True)            # one row a file; the text is scanned once
    need = F.array(*[F.lit(c) for c in required]).cast("array<string>")
    firsts = files.groupBy(F.col("vintage").alias("_v")).agg(F.min_by("names", "file").alias("_names"))
    missing = F.array_sort(F.array_except(need, "names"))
    verdict = (F.when(F.size("missing") > 0, "missing")
               .when(F.size(F.array_distinct("names")) < F.size("names"), "repeated")
               .when(F.col("names") != F.col("_names"), "disagrees")
               .when(F.col("open_quotes") > 0, "open quote")
               .when(F.col("n_rows") <= 0, "no rows").otherwise("ok"))
    return (files.join(firsts, F.col("vintage").eqNullSafe(F.col("_v")))
            .withColumn("missing", missing).withColumn("n_rows", F.col("lines") - F.size("above"))
            .select("vintage", "file", F.size("names").alias("n_columns"), "n_rows",
                    F.array_join("missing", ", ").alias("missing"), verdict.alias("verdict"), "above", "names"))


def _read_vintage(spark: SparkSession, path: str, vintage: str | None, sep: str, names: list[str],
                  above: list[str]) -> DataFrame:
    """The rows of one vintage, whose files share one header."""
    cells = [f"_c{i}" for i in range(len(names))]
    df = (spark.read.schema(", ".join(f"{c} string" for c in cells)).option("sep", sep)
          .option("header", False).csv(path)
          .withColumn("src_row", F.struct("_metadata.file_path", "_metadata.file_block_start",
                                          F.monotonically_increasing_id().alias("row"))))
    for line in above:          # the title and header lines are known by their whole content
        parsed = next(csv.reader([line], delimiter=sep), [])
        same = F.lit(True)
        for c, v in zip(cells, (parsed + [None] * len(cells))[:len(cells)]):
            same = same & F.coalesce(F.col(c), F.lit("")).eqNullSafe(F.lit(v or ""))
        df = df.where(~same)
    out = df.select(*[F.col(c).alias(n) for c, n in zip(cells, names)], "src_row")
    return out if vintage is None else out.withColumn("vintage", F.lit(vintage))


def read_delimited(spark: SparkSession, path: str, sep: str = ",", header_row: int | None = 0,
                   wanted: tuple[str, ...] = (), required: tuple[str, ...] | list[str] = (), upper: bool = False) -> DataFrame:
    """All-string delimited files; ``vintage`` from ``vintage=`` folders, of which there can be any number.

    The header contract is checked first, for all files in one job; a file that breaks it is fatal and
    named with what it lacks. Each vintage is then read under its own header and the vintages are united by
    column name, so neither column order nor further columns of one vintage move another's values.
    ``src_row`` orders rows by file, block and place in it, whatever order Spark reads the files in. What
    comes to the driver is one row a vintage: its header and its first faulty file."""
    fatal = F.col("verdict").isin("missing", "repeated", "disagrees", "open quote")
    found = header_contract(spark, path, required, sep, header_row, wanted, upper)
    heads = sorted(found.groupBy("vintage").agg(
        F.min_by(F.struct("file", "above", "names"), "file").alias("head"), F.count_if(fatal).alias("faulty"),
        F.min(F.when(fatal, F.struct("file", "verdict", "missing"))).alias("first")).collect(), key=lambda r: r["vintage"] or "")
    if not heads:
        raise FileNotFoundError(f"no landing file under {path}")
    if faults := [r for r in heads if r["faulty"]]:
        told = "; ".join(f"vintage {r['vintage']}: {r['faulty']} of its files, the first is {r['first']['file']}: {r['first']['verdict']}"
                         + (f" {r['first']['missing']}" if r["first"]["missing"] else "") for r in faults[:NAMED])
        raise LandingError(f"landing files disagree with the header contract: {told}", faults)
    parts = []
    for r in heads:
        file = unquote(r["head"]["file"])
        folder = path if r["vintage"] is None else file[:file.index("/", file.index("/vintage=") + 1)]
        parts.append(_read_vintage(spark, folder, r["vintage"], sep, r["head"]["names"], r["head"]["above"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_projections(spark: SparkSession, path: str) -> DataFrame:
    """Projection files; a title line above the header is skipped."""
    return read_delimited(spark, path, header_row=None, wanted=("code", "percent", "change"))


def read_oes(spark: SparkSession, path: str) -> DataFrame:
    """Place or national files; each vintage must hold every column of the contract."""
    return read_delimited(spark, path, ",", required=list(schema.OES_COLUMNS.values()), upper=True)


def read_onet(spark: SparkSession, path: str) -> DataFrame:
    return read_delimited(spark, path, "\t")


def read_mart(spark: SparkSession, path: str, kind: str = "market") -> DataFrame:
    """Published mart with its declared schema (no inference)."""
    sch = schema.MARKET_SCHEMA if kind == "market" else schema.SKILLS_SCHEMA
    return spark.read.schema(sch).parquet(path)


# ---------------------------------------------------------------- derived --
def soc_code(brand_number) -> F.Column:
    """Fixed-width SOC-style code for a brand number: ``BR-0007``."""
    return F.concat(F.lit("BR-"), F.lpad(brand_number.cast("string"), 4, "0"))


def ingest_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category dimension for the raw path: code, label, family."""
    n = F.substring_index(F.col("p_brand"), "#", -1).cast("int")
    return (table(spark, sf_dir, "part").select(n.alias("n")).distinct()
            .select(soc_code(F.col("n")).alias("soc_code"),
                    F.concat(F.lit("Role "), F.col("n").cast("string")).alias("occupation"),
                    F.concat(F.lit("Family "), (F.col("n") % 5).cast("string"))
                    .alias("occupation_group")))


def _lines(spark: SparkSession, sf_dir: str, vintage: F.Column | None = None) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    pa = table(spark, sf_dir, "part").select(
        "p_partkey", F.substring_index("p_brand", "#", -1).cast("int").alias("brand"))
    su = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    na = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    re = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    if vintage is None:
        vintage = F.when(F.col("l_shipdate") >= F.lit(CURRENT_VINTAGE_START).cast("timestamp"),
                         F.lit("current")).otherwise(F.lit("prior"))
    return (li.join(pa, li.l_partkey == pa.p_partkey)
            .join(su, li.l_suppkey == su.s_suppkey)
            .join(na, F.col("s_nationkey") == na.n_nationkey)
            .join(re, F.col("n_regionkey") == re.r_regionkey)
            .select(vintage.alias("vintage"), "brand", "s_nationkey", "n_name", "n_regionkey",
                    "r_name", "l_returnflag", "l_quantity", "l_extendedprice"))


def _line_cube(spark: SparkSession, sf_dir: str, vintage: F.Column | None = None) -> DataFrame:
    """One pass over the line facts at the finest grain any raw row needs; every
    raw row kind rolls up from this (small, checkpointed) cube. ``vintage`` names a line's
    vintage (null: none); by default there are two, current and prior."""
    ensure_checkpoint_dir(spark)
    lines = _lines(spark, sf_dir, vintage).where("vintage IS NOT NULL")
    return (lines.groupBy("vintage", "brand", "s_nationkey", "n_name", "n_regionkey", "r_name",
                          "l_returnflag")
            .agg(F.sum("l_quantity").alias("_emp"), F.count(F.lit(1)).alias("_n"),
                 F.min("l_extendedprice").alias("_mn"), F.max("l_extendedprice").alias("_mx"),
                 F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("_sx"))
            .checkpoint(eager=True))


def _measures():
    """Roll-up of the cube measures (sums exact: the price sum is fixed point)."""
    return [F.sum("_emp").alias("_emp"), F.sum("_n").alias("_n"), F.min("_mn").alias("_mn"),
            (F.sum("_sx").cast("double") / F.sum("_n").cast("double")).alias("_av"),
            F.max("_mx").alias("_mx")]


def _render(df: DataFrame, area, area_title, area_type, state, naics, occ, occ_title, o_group,
            kind: int, emp_factor: float = 1.0) -> DataFrame:
    emp = F.col("_emp") * emp_factor
    p25 = (F.col("_mn") + F.col("_av")) / 2
    p75 = (F.col("_av") + F.col("_mx")) / 2
    return df.select(
        "vintage",
        area.alias("AREA"), area_title.alias("AREA_TITLE"), area_type.alias("AREA_TYPE"),
        state.alias("PRIM_STATE"), naics.alias("NAICS"), occ.alias("OCC_CODE"),
        occ_title.alias("OCC_TITLE"), o_group.alias("O_GROUP"),
        F.when(emp < 30, F.lit("~")).otherwise(F.format_number(emp, 0)).alias("TOT_EMP"),
        F.format_number(F.col("_n") / 10.0, 1).alias("JOBS_1000"),
        F.concat(F.lit("$"), F.format_number("_mn", 0)).alias("A_PCT10"),
        F.format_number(p25, 0).alias("A_PCT25"),
        F.when(F.col("_n") < 3, F.lit("*"))
        .otherwise(F.concat(F.lit(" "), F.format_number("_av", 0), F.lit(" "))).alias("A_MEDIAN"),
        F.format_number(p75, 0).alias("A_PCT75"),
        F.when(F.col("_mx") >= 100000, F.lit("#"))
        .otherwise(F.format_number("_mx", 0)).alias("A_PCT90"),
        (F.lit(kind * 10_000_000) + F.coalesce(F.col("NAICS_NUM"), F.lit(0))).cast("long")
        .alias("src_row"),
    )


def raw_oes(spark: SparkSession, sf_dir: str, cube: DataFrame | None = None) -> DataFrame:
    """All-string OES-style rows for both vintages (see module docstring)."""
    lines = cube if cube is not None else _line_cube(spark, sf_dir)
    occ = soc_code(F.col("brand"))
    title = F.concat(F.lit("Role "), F.col("brand").cast("string"))
    place = F.col("s_nationkey").cast("string")
    place_title = F.concat(F.col("n_name"), F.lit(", "), F.col("r_name"))

    cells = (lines.groupBy("vintage", "brand", "s_nationkey", "n_name", "r_name")
             .agg(*_measures()).withColumn("NAICS_NUM", F.lit(0)))
    totals = _render(cells, place, place_title, F.lit("4"), F.col("r_name"),
                     F.lit(schema.NAICS_ALL_INDUSTRIES), occ, title, F.lit("detailed"), 0)
    restated = _render(cells.where(F.col("s_nationkey") % 7 == 0), place, place_title,
                       F.lit("4"), F.col("r_name"), F.lit(schema.NAICS_ALL_INDUSTRIES), occ,
                       title, F.lit("detailed"), 4, emp_factor=2.0)

    naics_num = F.lit(540000) + F.ascii("l_returnflag")
    industry = (lines.groupBy("vintage", "brand", "s_nationkey", "n_name", "r_name",
                              "l_returnflag")
                .agg(*_measures()).withColumn("NAICS_NUM", naics_num))
    by_industry = _render(industry, place, place_title, F.lit("4"), F.col("r_name"),
                          F.lpad(naics_num.cast("string"), 6, "0"), occ, title,
                          F.lit("detailed"), 1)

    regions = (lines.groupBy("vintage", "brand", "n_regionkey", "r_name").agg(*_measures())
               .withColumn("NAICS_NUM", F.lit(0)))
    non_metro = _render(regions, F.concat(F.lit("R"), F.col("n_regionkey").cast("string")),
                        F.concat(F.col("r_name"), F.lit(" nonmetropolitan area")),
                        F.lit("2"), F.col("r_name"), F.lit(schema.NAICS_ALL_INDUSTRIES), occ,
                        title, F.lit("detailed"), 2)

    fam = (lines.withColumn("family", F.col("brand") % 5)
           .groupBy("vintage", "family", "s_nationkey", "n_name", "r_name").agg(*_measures())
           .withColumn("NAICS_NUM", F.lit(0)))
    summary = _render(fam, place, place_title, F.lit("4"), F.col("r_name"),
                      F.lit(schema.NAICS_ALL_INDUSTRIES),
                      F.concat(F.lit("FM-"), F.lpad(F.col("family").cast("string"), 4, "0")),
                      F.concat(F.lit("Family "), F.col("family").cast("string")),
                      F.lit("Major"), 3)
    return (totals.unionByName(restated).unionByName(by_industry).unionByName(non_metro)
            .unionByName(summary))


def raw_national(spark: SparkSession, sf_dir: str, cube: DataFrame | None = None) -> DataFrame:
    """National rows (current vintage, all places per category). Categories whose
    number is divisible by 5 get an earlier suppressed duplicate row."""
    lines = (cube if cube is not None else _line_cube(spark, sf_dir)) \
        .where(F.col("vintage") == "current")
    nat = lines.groupBy("vintage", "brand").agg(*_measures()).withColumn("NAICS_NUM", F.lit(0))
    occ = soc_code(F.col("brand"))
    title = F.concat(F.lit("Role "), F.col("brand").cast("string"))
    rows = _render(nat, F.lit("99"), F.lit("U.S."), F.lit("1"), F.lit("US"),
                   F.lit(schema.NAICS_ALL_INDUSTRIES), occ, title, F.lit("detailed"), 1)
    early = (_render(nat.where(F.col("brand") % 5 == 0), F.lit("99"), F.lit("U.S."), F.lit("1"),
                     F.lit("US"), F.lit(schema.NAICS_ALL_INDUSTRIES), occ, title,
                     F.lit("detailed"), 0)
             .withColumn("A_MEDIAN", F.lit("*")))
    return rows.unionByName(early)


def raw_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection rows: code and a percent change, from the part catalogue."""
    part = table(spark, sf_dir, "part").select(
        F.substring_index("p_brand", "#", -1).cast("int").alias("brand"), "p_retailprice")
    g = part.groupBy("brand").agg(exact_mean("p_retailprice").alias("_avg"))
    return g.select(soc_code(F.col("brand")).alias("Occupation code"),
                    F.format_number((F.col("_avg") / 1000.0 - 1.0) * 100.0, 1)
                    .alias("Employment change, percent"),
                    F.col("brand").cast("long").alias("src_row"))


def raw_onet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-file style rows from the embeddings: one specialisation per
    ``vec_id % 3`` of category ``label + 1``; importance and level scales;
    suppression recommended for ``vec_id % 11 == 0`` (null flag on even ids)."""
    emb = table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.posexplode("embedding").alias("dim", "x"))
    code = F.concat(soc_code(F.col("label") + 1), F.lit(".0"), (F.col("vec_id") % 3).cast("string"))
    skill = F.concat(F.lit("skill_"), F.lpad(F.col("dim").cast("string"), 2, "0"))
    value = 3.0 + 2.0 * F.col("x").cast("double")
    suppress = (F.when(F.col("vec_id") % 11 == 0, F.lit("Y"))
                .when(F.col("vec_id") % 2 == 0, F.lit(None)).otherwise(F.lit("n")))
    im = emb.select(code.alias("O*NET-SOC Code"), skill.alias("Element Name"),
                    F.lit("IM").alias("Scale ID"), F.format_number(value, 2).alias("Data Value"),
                    suppress.alias("Recommend Suppress"))
    lv = emb.select(code.alias("O*NET-SOC Code"), skill.alias("Element Name"),
                    F.lit("LV").alias("Scale ID"), F.format_number(value * 1.4, 2).alias("Data Value"),
                    F.lit("N").alias("Recommend Suppress"))
    return im.unionByName(lv)
