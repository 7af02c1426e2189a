"""URL filters: rules by host and path prefix, then a template tree per host whose variable or
alike branches become wildcards and whose templates are judged by smoothed labelled purity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import labels_by_doc, table

#: A branch point with at least this many children and under PAGES_EACH pages for each is variable.
MIN_CHILDREN = 8
PAGES_EACH = 3.0
#: A child joins the wildcard if its purity is within this many standard errors of its siblings', and both
#: sides have at least MIN_LABELS labels; without that evidence it stays apart.
ALIKE = 2.0
MIN_LABELS = 5
#: Pseudo-labels with the corpus's purity added to each template; blocked below MIN_PURITY.
PRIOR = 10.0
MIN_PURITY = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame) -> DataFrame:
    """``page_id, host, path`` of every url; null urls and those without ``://`` have both empty."""
    rest = r"CASE WHEN locate('://', url) > 0 THEN substring(url, locate('://', url) + 3) ELSE '' END"
    return (pages.select("page_id", F.expr(f"coalesce({rest}, '')").alias("rest"))
            .withColumn("raw", F.expr("regexp_extract(rest, '^[^/?#]*', 0)"))
            .select("page_id", F.translate("raw", _UPPER, _LOWER).alias("host"),
                    F.expr("regexp_extract(substring(rest, char_length(raw) + 1), '^[^?#]*', 0)").alias("path")))


def rule_columns(rules: list[tuple[str, str]]):
    """The longest fitting rule and its verdict; rules are ``(verdict, host + path)``."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        text, verdict = F.when(fits, rule).otherwise(text), F.when(fits, says).otherwise(verdict)
    return text, verdict


def _typed(segment: str) -> str:
    """Numbers, hex digests and dates within a segment as typed holes."""
    return (f"regexp_replace(regexp_replace({segment}, '(?<![0-9A-Za-z])[0-9a-f]{{12,}}(?![0-9A-Za-z])', '{{hex}}'), "
            "'[0-9]+', '{n}')")


def templates(shapes: DataFrame) -> DataFrame:
    """``shapes(host, shape, pages, good, bad)`` -> the same with ``template``. Level by level: the
    children of a branch point (host and generalised prefix) are aggregated, so branches that became
    one wildcard share the subtree below them; no host is gathered in one task. A shape that is alone
    under its prefix has no siblings further down, so it ends there and deep paths need no more rounds."""
    point_keys, sums = ["host", "prefix"], ("pages", "good", "bad", "shapes")
    live = table(shapes.withColumn("segs", F.expr("split(shape, '/')")).withColumn("prefix", F.lit("")), "level")
    done, depth = [], 0
    while depth == 0 or not live.isEmpty():
        here = live.withColumn("seg", F.expr(f"segs[{depth}]"))
        child = (here.withColumn("shapes", F.lit(1)).groupBy(*point_keys, "seg")
                 .agg(*(F.sum(c).alias(c) for c in sums)))
        point = child.groupBy(*point_keys).agg(
            F.count("*").alias("children"), F.sum("pages").alias("all_pages"), F.sum("shapes").alias("all_shapes"),
            F.sum("good").alias("all_good"), F.sum(F.expr("good + bad")).alias("all_seen"))
        merged = (child.join(point, point_keys)
                  .withColumns({"n": F.expr("good + bad"), "others": F.expr("all_seen - good - bad"),
                                "p": F.expr("(all_good + 1D) / (all_seen + 2D)")})
                  # two samples, the child and its siblings without it: told apart or not at their sizes
                  .withColumn("alike", F.expr(
                      f"n >= {MIN_LABELS} AND others >= {MIN_LABELS} AND abs(good / greatest(n, 1) - (all_good - good) / greatest(others, 1)) "
                      f"<= {ALIKE} * sqrt(p * (1 - p) * (1D / greatest(n, 1) + 1D / greatest(others, 1)))"))
                  .select(*point_keys, "seg", "all_shapes", F.expr(
                      f"CASE WHEN (children >= {MIN_CHILDREN} AND all_pages < {PAGES_EACH} * children) OR alike "
                      "THEN '*' ELSE seg END").alias("general")))
        before = "" if depth == 0 else "prefix || '/' || "
        level = table(here.join(merged, [*point_keys, "seg"]).select(
            *shapes.columns, "segs", F.expr(f"{before}general").alias("prefix"),
            F.expr(f"all_shapes = 1 OR size(segs) = {depth + 1}").alias("whole")), "level")
        done.append(level.where("whole").select(*shapes.columns, F.expr(
            f"array_join(array_prepend(slice(segs, {depth + 2}, size(segs)), prefix), '/')").alias("template")))
        live, depth = level.where("NOT whole").drop("whole"), depth + 1
    for part in done[1:]:
        done[0] = done[0].unionByName(part)
    return done[0]


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """One row per row of ``pages(page_id, url)``: host, path, fitting rule, its template, the
    template's smoothed purity, verdict.

    A page takes the quality label of the document whose number its path holds; pages without one
    count as unlabelled. Null or malformed urls share the empty template. Repeated rows are judged
    alike; without labels every purity is 1 and only rules block; an empty table gives no rows."""
    text, says = rule_columns(rules)
    parts = (with_parts(pages)
             .withColumn("shape", F.expr(f"regexp_replace({_typed('path')}, '^/|/$', '')"))
             .withColumn("doc", F.expr("try_cast(regexp_extract(path, '/([0-9]+)(?=[/.]|$)', 1) AS bigint)")))
    marks = labels_by_doc(labels).select(F.col("doc_id").cast("bigint").alias("doc"), "quality")
    numbered = (parts.where("doc IS NOT NULL").groupBy("doc", "host", "shape").agg(F.count("*").alias("n"))
                .join(marks, "doc"))
    seen = numbered.groupBy("host", "shape").agg(
        F.sum(F.expr("CASE WHEN quality = 1 THEN n ELSE 0 END")).alias("good"),
        F.sum(F.expr("CASE WHEN quality = 0 THEN n ELSE 0 END")).alias("bad"))
    shapes = (parts.groupBy("host", "shape").agg(F.count("*").alias("pages"))
              .join(seen, ["host", "shape"], "left").na.fill(0, ["good", "bad"]))
    known = table(templates(table(shapes, "shapes")), "templates")
    totals = known.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    prior = totals["good"] / (totals["good"] + totals["bad"]) if (totals["good"] or 0) + (totals["bad"] or 0) else 1.0
    purity = known.groupBy("host", "template").agg(F.expr(
        f"(sum(good) + double('{PRIOR * prior!r}')) / (sum(good + bad) + double('{PRIOR!r}'))").alias("purity"))
    verdicts = known.join(purity, ["host", "template"]).select("host", "shape", "template", "purity")
    return (parts.join(verdicts, ["host", "shape"])
            .select("page_id", "host", "path", text.alias("rule"),
                    F.coalesce(says, F.expr(f"CASE WHEN purity < double('{MIN_PURITY}') THEN 'block' ELSE 'allow' END")).alias("verdict"),
                    "template", "purity"))
