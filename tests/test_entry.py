"""Driver contract: entry runs; every query has a callable; oracle keys are a subset."""

import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "competition_index" in df.columns


def test_registry_consistent():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    ids = ["q1_", "q2_", "q3_", "q3j_", "q4_", "q5_", "q6_", "q7_", "q7d_", "q8_", "q8s_", "q9_",
           "q10_", "q11_", "f1_", "f2_", "f3_", "f4_", "f5_", "f6_", "f8_", "f9_", "f10_", "f11_",
           "i_build_market", "i_build_skills", "i_row_accounting", "d_quality_report",
           "d14_", "x1_", "x4_", "x5_"]
    for prefix in ids:
        assert any(k.startswith(prefix) for k in q), prefix
