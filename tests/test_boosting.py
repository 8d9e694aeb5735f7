"""Boosted trees against plain enumerations of splits, and as a whole on data with a known shape."""

import itertools
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodemark.operators import boosting as bt
from lodemark.session import discard, stored

LEVELS = ["u", "v", "w", "x", "y"]


def table(n, seed=3):
    rng = np.random.default_rng(seed)
    f = pd.DataFrame({"key": np.arange(n), "a": rng.normal(size=n).round(2), "b": rng.integers(0, 6, n).astype(float), "c": rng.choice(LEVELS, n)})
    f["y"] = 3 * (f.a > 0.3) + f.c.map({"u": 2.0, "v": -1.0, "w": 2.5, "x": 0.0, "y": -2.0}) + rng.normal(0, 0.3, n) + 10
    f.loc[rng.random(n) < 0.15, "a"] = np.nan
    f.loc[f.a.isna(), "y"] += 4
    f.loc[rng.random(n) < 0.1, "c"] = None
    return f


def columns():
    return {"a": F.col("a"), "b": F.col("b"), "c": F.col("c")}


def frame(spark, f):
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in f[["key", "a", "b", "c", "y"]].itertuples(index=False)]
    return spark.createDataFrame(rows, "key long, a double, b double, c string, y double").repartition(3)


def gain_of(g, left):
    n, m = left.sum(), (~left).sum()
    return g[left].sum() ** 2 / n + g[~left].sum() ** 2 / m - g.sum() ** 2 / len(g)


def all_splits(f, least):
    """Every threshold with missing values on either side, and every subset of categories with them on either side."""
    for name in ("a", "b"):
        v = f[name].to_numpy()
        for edge, missing in itertools.product(sorted(set(v[~np.isnan(v)])), (False, True)):
            yield name, np.where(np.isnan(v), missing, v <= edge).astype(bool)
    known = f.c.notna().to_numpy()
    for k in range(1, len(LEVELS) + 1):
        for subset in itertools.combinations(LEVELS, k):
            for missing in (False, True):
                yield "c", np.where(known, f.c.isin(subset), missing).astype(bool)


@pytest.mark.parametrize("loss", ["l1", "l2"])
@pytest.mark.parametrize("seed", [3, 4])
def test_the_split_is_the_best_of_all(spark, loss, seed):
    f, least = table(200, seed), 20
    fitted = bt.fit_boosted(frame(spark, f), [bt.Spec("m", ("a", "b", "c"), loss)], columns(), {"c": LEVELS}, F.col("y"), "key", rounds=1, stop=5, depth=1, least=least, rate=1.0, held_of=7)["m"]
    assert len(fitted.trees) == 1
    y = f.y.to_numpy()
    start = np.median(y) if loss == "l1" else y.mean()
    g = np.sign(start - y) if loss == "l1" else start - y
    best = max(gain_of(g, left) for _, left in all_splits(f, least) if least <= left.sum() <= len(f) - least)
    assert np.isclose(sum(fitted.gains.values()), best, rtol=0.02 if loss == "l1" else 1e-9)  # categories are ordered by smoothed means
    got = {r["key"]: r["m"] for r in bt.predict_boosted(frame(spark, f), {"m": fitted}, columns()).collect()}
    sides = np.array([got[k] for k in f.key])
    for value in set(sides):
        own = np.sort(y[sides == value])
        low, high = (own[(len(own) - 1) // 2] - 0.05, own[len(own) // 2] + 0.05) if loss == "l1" else (own.mean() - 1e-9, own.mean() + 1e-9)
        assert low <= value <= high


def test_histogram_splits_equal_enumeration():
    rng = np.random.default_rng(8)
    for case in range(60):
        n = rng.integers(0, 30, 256) * (rng.random(256) < 0.05)
        n[bt.MISSING] = rng.integers(0, 20) * (case % 2)
        g = rng.normal(size=256) * n
        found = bt.best_split(g, n, False, 15)
        want = None
        used = np.flatnonzero(n[: bt.MISSING])
        for k, missing in itertools.product(range(len(used)), (False, True)):
            left = np.zeros(256, bool)
            left[used[: k + 1]] = True
            left[bt.MISSING] = missing
            if min(n[left].sum(), n[~left].sum()) >= 15:
                gain = g[left].sum() ** 2 / n[left].sum() + g[~left].sum() ** 2 / n[~left].sum() - g.sum() ** 2 / n.sum()
                want = gain if want is None else max(want, gain)
        assert (found is None) == (want is None)
        assert found is None or np.isclose(found[0], want)


def test_many_models_at_once_learn_what_there_is(spark):
    f, test = table(4000), table(1500, 9)
    specs = [bt.Spec("all", ("a", "b", "c"), "l2"), bt.Spec("median", ("a", "b", "c"), "l1"), bt.Spec("no_c", ("a", "b"), "l2"), bt.Spec("noise", ("b",), "l2")]
    fits = bt.fit_boosted(frame(spark, f), specs, columns(), {"c": LEVELS}, F.col("y"), "key", rounds=25, stop=4, depth=3, rate=0.3)
    got = bt.predict_boosted(frame(spark, test), fits, columns()).toPandas()
    error = {m: (got[m] - got.y).abs().mean() for m in fits}
    assert error["all"] < 0.75 and error["median"] < 0.9 and error["all"] < error["no_c"] - 0.5 < error["noise"] - 0.5
    assert all(len(m.trees) == m.best_round and m.losses[m.best_round] == min(m.losses) for m in fits.values())
    assert len(fits["noise"].losses) < 26 and fits["noise"].best_round < 10  # it stops early
    assert max(fits["all"].gains, key=fits["all"].gains.get) in ("a", "c") and fits["all"].gains.get("b", 0) < 0.05 * sum(fits["all"].gains.values())


def test_one_model_alone_is_the_same_as_among_others(spark):
    f = table(800)
    specs = [bt.Spec("m", ("a", "c"), "l1"), bt.Spec("other", ("b",), "l2")]
    run = lambda s: bt.fit_boosted(frame(spark, f), s, columns(), {"c": LEVELS}, F.col("y"), "key", rounds=12, stop=12, depth=2)["m"]
    one, two = run(specs[:1]), run(specs)
    assert one.best_round == two.best_round and one.gains.keys() == two.gains.keys()
    assert np.allclose(one.losses, two.losses) and all(np.allclose(a.values, b.values) for a, b in zip(one.trees, two.trees, strict=True))


def test_all_thirteen_models_run(spark, sf):
    from lodemark.plans.clicks import clicks, with_angles

    view = with_angles(clicks(spark, sf)).where("label_id % 40 = 0")
    features = bt.benchmark_features(F.col("dep"))
    fits = bt.fit_boosted(view, bt.benchmark_specs(), features, {"label_type": ["AF", "NF", "NO", "RF"]}, F.col("truth_m"), "label_id", rounds=3, stop=3, depth=2)
    assert len(fits) == 13 and set(bt.DROPS["canvas"]).isdisjoint(fits["drop_canvas"].spec.features)
    scored = bt.predict_boosted(view, fits, features)
    assert scored.where(" OR ".join(f"{k} IS NULL OR {k} < 0 OR {k} > 50" for k in fits)).count() == 0 and scored.count() == view.count()


def test_awkward_tables(spark):
    none = spark.createDataFrame([], "key long, a double, b double, c string, y double")
    spec = [bt.Spec("m", ("a", "b", "c"))]
    fits = bt.fit_boosted(none, spec, columns(), {"c": LEVELS}, F.col("y"), "key", rounds=2)
    assert fits["m"].trees == [] and bt.predict_boosted(none, fits, columns()).count() == 0
    odd = spark.createDataFrame([(k % 3, None, float("nan"), "other", 5.0 if k % 4 else None) for k in range(300)], "key long, a double, b double, c string, y double")
    fits = bt.fit_boosted(odd, spec, columns(), {"c": LEVELS}, F.col("y"), "key", rounds=2, stop=2)
    assert {r["m"] for r in bt.predict_boosted(odd, fits, columns()).collect()} == {5.0}


def _walked(tree, column):
    at = tree.root
    while at >= 0:
        left = np.unpackbits(np.frombuffer(tree.left[at], np.uint8))[column[tree.feature[at]]]
        at = tree.children[at][0 if left else 1]
    return ~at


def test_leaves_by_byte_tables_are_those_of_the_walk():
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 256, (4, 500)).astype(np.uint8)
    tree = bt.Tree()
    for nodes in range(1, 12):
        tree.split(int(rng.integers(len(tree.values))), int(rng.integers(4)), rng.random(256) < 0.5)
        assert tree.leaves(bins).tolist() == [_walked(tree, c) for c in bins.T]
        assert (tree._tables is not None) == (nodes <= 8)


def test_blocks_are_read_from_small_row_groups_and_not_kept_in_memory(spark):
    """Sixty times sf0.1 in four tasks: scores of thirteen models, kept and read by whole row groups, were more than 4 GB."""
    rows = spark.range(120, numPartitions=1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"b": [np.random.default_rng(k).bytes(1_000_000)]}) for b in batches for k in range(b.num_rows)), "b binary")
    table, path = stored(rows, large_rows=True)
    place = Path(path.removeprefix("file:"))
    files = [pq.ParquetFile(f) for f in place.glob("*.parquet")]
    assert table.count() == 120 and max(f.metadata.row_group(k).num_rows for f in files for k in range(f.metadata.num_row_groups)) <= 16
    discard(spark, path)
    assert not place.exists()
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    df = spark.createDataFrame([(float(k), float(k % 7), k) for k in range(400)], "a double, y double, id long")
    bins = bt.make_bins(df, {"a": F.col("a")}, {})
    passes = bt._Passes(bt._blocks(df, bins, {"a": F.col("a")}, F.col("y"), "id", 10), np.zeros(1), 1, False)
    assert passes.sums([[]], lambda bins, y, held, scores, grown, m: [(0, np.array([y.sum()]), np.array([len(y)]))], 1)[1][0] == 400
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    passes.close()
