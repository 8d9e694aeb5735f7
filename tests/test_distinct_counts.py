"""Distinct counts beside quantiles."""

from pyspark.sql import functions as F

from lodemark import session
from lodemark.operators import quantiles as qs
from lodemark.registry import all_queries


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_distinct_counts_stand_apart_from_summaries(spark, sf, monkeypatch):
    plans = []
    monkeypatch.setattr(qs, "DIRECT", 0)
    monkeypatch.setattr(session, "checkpointed", lambda df, own=session.checkpointed: plans.append(_plan(df)) or own(df))
    for name in ("g01_g06_basic_aggregates", "v12_nested_summary"):
        all_queries()[name](spark, sf)
    summaries = [p for p in plans if "percentile_approx" in p]
    assert len(summaries) == 2 and not any("distinct" in p for p in summaries)


def test_distinct_counts_of_missing_keys_and_values(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 3), (None, None), ("b", None)], "g string, v int")
    got = {r["g"]: (r["n"], r["k"]) for r in qs.with_distinct(df.groupBy("g").agg(F.count("*").alias("n")), df, ["g"], {"k": F.col("v")}).collect()}
    assert got == {"a": (3, 2), None: (2, 1), "b": (1, 0)}
    whole = qs.with_distinct(df.agg(F.count("*").alias("n")), df, [], {"k": F.col("v")}).collect()
    assert [tuple(r) for r in whole] == [(6, 3)]
