"""Entry B: raw vintages -> market and skills marts (I1-I21), plus row accounting.

Row accounting (I21) comes two ways: ``Marts.observed_counts()`` reads
``Observation`` metrics gathered during the materializing pass itself (no extra
scan; what a production build logs), and ``row_accounting`` returns the kept
rows of every step as one DataFrame (a report that re-reads each step).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from marketlens import schema
from marketlens.operators import ingest
from marketlens.session import ensure_checkpoint_dir


@dataclass
class Marts:
    market: DataFrame
    skills: DataFrame
    quarantine: DataFrame           # rows with crossed wage percentiles (fatal if any)
    steps: dict[str, DataFrame]     # intermediate frames, for accounting
    observed: dict[str, Observation] = field(default_factory=dict)

    def observed_counts(self) -> dict[str, dict]:
        """Step metrics gathered during the materializing pass (I21), no extra scan.
        Only meaningful after the build ran with ``materialize=True``."""
        return {name: obs.get for name, obs in self.observed.items()}


def _observe(df: DataFrame, name: str, observed: dict, extra=None) -> DataFrame:
    obs = Observation(name)
    observed[name] = obs
    metrics = [F.count(F.lit(1)).alias("rows")] + (extra or [])
    return df.observe(obs, *metrics)


def build_marts(raw_oes: DataFrame, raw_national: DataFrame, raw_projections: DataFrame | None,
                raw_onet: DataFrame, scope: DataFrame, floor: float = schema.MIN_EMPLOYMENT,
                top_n: int = schema.TOP_N_METROS, materialize: bool = True,
                years: dict[str, int] | None = None) -> Marts:
    """Lazy build of both marts. ``raw_oes`` may hold any number of vintages: the newest becomes the market, each
    of its cells with the nearest earlier vintage that holds it (``years`` names the years of vintages
    that have none in their names). ``materialize`` checkpoints the two (small) results so reports that
    read them many times do not re-run the build."""
    observed: dict[str, Observation] = {}
    typed = ingest.typed_oes(ingest.normalise_headers(raw_oes))
    scoped = ingest.scope_filter(typed, scope)
    is_total = F.col("naics") == schema.NAICS_ALL_INDUSTRIES
    ok = (F.col("employment").isNotNull() & F.col("wage_p50").isNotNull()
          & (F.col("employment") >= F.lit(float(floor))))
    scoped_obs = _observe(scoped, "scoped", observed, [
        F.count_if(is_total).alias("total_rows"),
        F.count_if(ok).alias("usable_rows"),
        F.count_if(ok & is_total).alias("usable_total_rows")])
    cleaned = ingest.select_rows(scoped_obs, floor)
    # step frames for the (re-reading) accounting report
    single_industry = ingest.industry_filter(scoped)
    usable = ingest.usable(single_industry, floor)
    if materialize:
        # lineage cut: from here on every frame is mart-sized (one row per
        # vintage x category x place) and is read several times
        ensure_checkpoint_dir(cleaned.sparkSession)
        cleaned = cleaned.checkpoint(eager=True)

    with_prior = kept = ingest.top_areas(ingest.newest_with_prior(cleaned, years), top_n)
    full = ingest.attach_dimensions(with_prior, ingest.national_medians(raw_national, scope),
                                    ingest.projections(raw_projections, scope), scope)
    market = ingest.conform(full.where(ingest.monotonic_ok()))
    profiles = ingest.onet_profiles(ingest.onet_filter(raw_onet), scope)
    if materialize:
        profiles = profiles.checkpoint(eager=True)       # category x skill rows
    skills = ingest.drop_ragged(profiles)
    market, skills = ingest.coverage(market, skills)
    if materialize:
        ensure_checkpoint_dir(market.sparkSession)
        market, skills = market.checkpoint(eager=True), skills.checkpoint(eager=True)
    return Marts(market, skills, ingest.monotonic_violations(full), {
        "raw": raw_oes, "scoped": scoped, "single_industry": single_industry,
        "usable": usable, "deduplicated": cleaned, "current_top_areas": kept,
        "with_prior": with_prior.where(F.col("employment_prior").isNotNull()),
        "market": market, "skills": skills,
    }, observed if materialize else {})


def row_accounting(marts: Marts) -> DataFrame:
    """(step, rows) for every step of the build, one partial-aggregated count each."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(i).alias("step_order"),
                                                            F.lit(name).alias("step"), "rows")
             for i, (name, df) in enumerate(marts.steps.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class BuildError(RuntimeError):
    pass


def run_build(spark, oes_path: str, national_path: str, onet_path: str,
              projections_path: str | None, scope: DataFrame, base: str,
              floor: float = schema.MIN_EMPLOYMENT, top_n: int = schema.TOP_N_METROS,
              version: str | None = None, years: dict[str, int] | None = None) -> tuple[str, dict]:
    """Entry B end to end: landing files -> marts -> validated, committed version.

    ``oes_path`` holds ``vintage=...`` folders of delimited files, named by year
    (or ``current`` / ``prior``, or as ``years`` says); the national and projection files are read the same way,
    the skills file tab-separated. Crossed wage percentiles are fatal and named
    (at most ten rows are fetched for the message). Returns the committed
    version and the step counts observed during the build pass.
    """
    from marketlens.plans import publish
    from marketlens.sources import raw

    proj = raw.read_projections(spark, projections_path) if projections_path else None
    marts = build_marts(raw.read_oes(spark, oes_path), raw.read_oes(spark, national_path),
                        proj, raw.read_onet(spark, onet_path), scope, floor, top_n, years=years)
    crossed = marts.quarantine.limit(10).collect()
    if crossed:
        names = ", ".join(f"{r.soc_code}@{r.metro}" for r in crossed)
        raise BuildError(f"wages fall from one percentile to the next, for instance at {names}; "
                         "check the landing headers")
    committed = publish.publish(marts.market, marts.skills, base, scope, version)
    return committed, marts.observed_counts()
