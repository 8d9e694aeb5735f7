"""The pipeline on the small table: each stage on what the one before kept."""

import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import order, plain_components, plain_fingerprint

from lodemark.llm import quality, secrets
from lodemark.llm.common import set_checkpoint_dir

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_in_order(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4]
    texts = [r["text"].lower() for r in spark.read.parquet(str(tmp_path / "1")).collect()]
    assert len(texts) == len(set(texts))
    packed = docs.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).toPandas()
    assert len(packed) == counts[4] and (packed["sum(length)"] == packed["max(doc_tokens)"]).all()


def test_run_leaves_one_table(spark, sf):
    """Of what the stages write only the table that packing reads stays; the result can be read more than once."""
    set_checkpoint_dir(spark)
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = {*folder.glob("keyed-*"), *folder.glob("pipeline-*/*")}
    out = corpus_pipeline.run(spark, sf)
    assert out.count() == out.count() > 0
    left = {*folder.glob("keyed-*"), *folder.glob("pipeline-*/*")} - before
    assert [p.name for p in left] == ["3-secret_scan"]


def test_dedup_stages_decide_by_row(spark):
    """Repeated rows, doc_ids that win with one text and lose with another, and missing ids."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 1 << 30, 200)) for _ in range(12)]
    near = [" ".join([*t.split()[:-1], "end"]) for t in texts]
    rows = [(k, t) for k, t in enumerate(texts)] * 3 + [(k + 5, t.upper()) for k, t in enumerate(texts[:6])] + [(None, t) for t in [*texts[4:8], *near, *near, None, ""]]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long").repartition(5)
    exact = [tuple(r) for r in corpus_pipeline.exact_stage(spark, docs, "").select("doc_id", "text").collect()]
    best = {}
    for i, t in rows:
        low = (t or "").lower()
        best[low] = max(best.get(low, i), i, key=order)
    assert Counter((i, (t or "").lower()) for i, t in exact) == Counter((i, t) for t, i in best.items())
    got = corpus_pipeline.near_stage(spark, docs, "")
    assert got.columns == docs.columns
    prints = [plain_fingerprint(t) for _, t in rows]
    parts, least = plain_components(prints), {}
    for (i, _), p in zip(rows, prints, strict=True):
        least.setdefault(parts[p], []).append(i)
    kept = [(r["doc_id"], parts[plain_fingerprint(r["text"])]) for r in got.collect()]
    assert Counter(kept) == Counter((min(ids, key=lambda i: (i is None, i or 0)), part) for part, ids in least.items())
    assert len(least) < len(set(prints))


def test_every_stage_takes_awkward_rows(spark, sf, awkward, tmp_path):
    """Nulls, empty texts, repeated rows and ids, and clashing columns, against a plain version of each stage."""
    docs, columns = awkward, awkward.columns
    before = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if name == "packing":
            pieces = out.toPandas()
            assert (pieces[pieces.start == 0].doc_tokens.sum() == pieces.length.sum()) and (pieces.start == 0).sum() == len(before)
            break
        assert out.columns == columns
        after = [(r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()]
        if name == "quality":
            model = quality.train(spark, sf)
            scores = quality.score(docs.select(F.monotonically_increasing_id().alias("doc_id"), "text"), model)
            assert len(after) == scores.where("predicted = 1").count() and not Counter(after) - Counter(before)
            docs, out = awkward, awkward  # the next stages get every awkward row
            continue
        if name == "exact_dedup":
            best = {}
            for i, t in before:
                low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
                best[low] = max(best.get(low, i), i, key=order)
            assert Counter((i, re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) for i, t in after) == Counter((i, t) for t, i in best.items())
        if name == "simhash_near_dedup":
            parts, least = plain_components([plain_fingerprint(t) for _, t in before]), {}
            for i, t in before:
                least.setdefault(parts[plain_fingerprint(t)], []).append(i)
            assert Counter((i, parts[plain_fingerprint(t)]) for i, t in after) == Counter((min(ids, key=lambda i: (i is None, i or 0)), p) for p, ids in least.items())
        if name == "secret_scan":
            net = secrets.train(docs)
            want = []
            for i, t in before:
                at, parts = 0, []
                for start, _, end in secrets.find(pa.array([t], pa.string()), net)[0]:
                    if start >= at:
                        parts += [t[at:start], "[SECRET]"]
                    at = max(at, end)
                want.append((i, t if not parts else "".join([*parts, t[at:]])))
            assert Counter(after) == Counter(want)
        docs, before = out, after


def test_every_stage_takes_an_empty_table(spark, sf, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
