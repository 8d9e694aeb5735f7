"""Running counts and the pairs made of their places, on more rows than the edges of their ranges are sampled from."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from lodemark.operators import joins, windows

N = 150_000


def _many(spark):
    return spark.range(0, N, 1, 6).select(F.expr("id * 48271 % 2147483647").alias("id"))


def test_running_counts_of_many_values(spark):
    got = windows.running_counts(_many(spark).select(F.md5(F.col("id").cast("string")).alias("o")), "o").toPandas().sort_values("o")
    assert len(got) == N and got.upto.tolist() == list(range(1, N + 1))


def test_pairs_of_many_keys_are_the_permutations(spark):
    ids = sorted((r["id"] for r in _many(spark).collect()), key=lambda k: (hashlib.md5(f"{k}|9".encode()).hexdigest(), str(k)))
    got = joins.other_keys(_many(spark), "id", 3, 9).toPandas()
    want = {(a, ids[(i + s) % N]) for i, a in enumerate(ids) for s in (1, 2, 3)}
    assert len(got) == 3 * N and set(zip(got.id, got.other, strict=True)) == want


def test_every_row_of_a_repeated_key_has_a_place(spark):
    """As in the SQL, whose row_number counts rows; a key of more rows than a block holds, and missing keys."""
    rows = [*range(40), *range(10), *[7] * 5_000, None, None]
    ids = sorted(rows, key=lambda k: hashlib.md5(("9" if k is None else f"{k}|9").encode()).hexdigest())
    got = joins.other_keys(spark.createDataFrame([(k,) for k in rows], "id bigint"), "id", 5, 9).collect()
    assert Counter(map(tuple, got)) == Counter((a, ids[(i + s) % len(ids)]) for i, a in enumerate(ids) for s in range(1, 6))
