"""Each operator against a plain version of its contract, on awkward rows and on real ones."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodemark.llm import bpe, exact_dedup, langid, packing, quality, secrets, simhash, sketch, substring_dedup, toxicity
from lodemark.llm.components import connected_components

P = pytest.importorskip("public_tokenizers")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def order(x):
    return (x is not None, x or 0)


# ---- exact dedup


def test_exact_dedup_matches_brute_force(awkward):
    rows = rows_of(awkward)
    groups = {}
    for i, t in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        groups.setdefault(low, []).append(i)
    got = exact_dedup.exact_dedup(awkward).collect()
    assert len(got) == len(rows)
    want = sorted((hashlib.sha256(t.encode()).hexdigest(), order(i), order(max(ids, key=order)), len(ids)) for t, ids in groups.items() for i in ids)
    assert sorted((r["text_sha256"], order(r["doc_id"]), order(r["keep_id"]), r["group_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)


def test_exact_dedup_splits_heavy_hitters(spark):
    df = spark.createDataFrame([(k, "same" if k % 3 == 0 else f"own {k // 2}") for k in range(900)], "doc_id long, text string")
    rows = exact_dedup.digest_rows(df)
    assert exact_dedup.frequent_digests(rows).collect()[0]["group_size"] == 300
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(df).collect()}
    assert got[0]["keep_id"] == 897 and got[0]["group_size"] == 300 and sum(r["kept"] for r in got.values()) == len(set("same" if k % 3 == 0 else f"own {k // 2}" for k in range(900)))


def test_summaries_keep_what_is_frequent():
    whole = {}
    for part in range(20):
        counts = {f"{part}-{k}": 1 for k in range(50)} | {"hot": 30}
        whole = exact_dedup.merge_summaries(whole, counts, 8)
    assert "hot" in whole and len(whole) <= 8


# ---- SimHash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    ones = np.zeros(64, int)
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        ones += [(h >> k) & 1 for k in range(64)]
    return sum(1 << k for k in range(64) if 2 * ones[k] > len(grams))


def plain_components(prints):
    keys = sorted(set(prints))
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    return {k: root(k) for k in keys}


@pytest.mark.parametrize("crowd", [4096, 2])
def test_simhash_matches_brute_force(spark, unique, sample, crowd, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rows = rows_of(unique) + [(10_000 + i, t) for i, t in zip(sample.doc_id, sample.text, strict=True)]
    rng = np.random.default_rng(0)
    for k in range(60):  # near copies of one text: a chain of fingerprints
        words = sample.text[5].split()
        for _ in range(rng.integers(1, 4)):
            words[rng.integers(len(words))] = f"n{rng.integers(1000)}"
        rows.append((20_000 + k, " ".join(words)))
    got = simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    prints = {i: plain_fingerprint(t) for i, t in rows}
    parts = plain_components(prints.values())
    least = {}
    for i, p in prints.items():
        least[parts[p]] = min(least.get(parts[p], i), i)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(i, f"{p:016x}", least[parts[p]]) for i, p in prints.items()}
    assert len(got) == len(rows)


def test_links_of_random_balls(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 3)
    rng = np.random.default_rng(4)
    centres = rng.integers(-(1 << 62), 1 << 62, 6)
    prints = sorted({int(c ^ np.bitwise_xor.reduce(np.int64(1) << rng.choice(62, rng.integers(0, 4), replace=False))) if n else int(c) for c in centres for n in range(25)})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {r["vertex"]: r["component"] for r in connected_components(simhash.links(df)).collect()}
    want = plain_components([p & (1 << 64) - 1 for p in prints])
    groups = {}
    for p in prints:
        groups.setdefault(want[p & (1 << 64) - 1], []).append(p)
    assert all(got.get(p, p) == min(g) for g in groups.values() for p in g)


# ---- substring dedup


def plain_removal(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: order(r[0])):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for p in range(len(words) - 19):
            key = tuple(words[p : p + 20])
            if key in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(key)
        out.append((i, len(words), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=lambda r: (order(r[0]), r[1:]))


def test_substring_dedup_matches_brute_force(spark, unique, sample):
    rng = np.random.default_rng(2)
    rows = rows_of(unique) + [(10_000 + i, t) for i, t in zip(sample.doc_id, sample.text, strict=True)]
    rows += [(30_000 + k, " ".join(rng.choice(["a", "b"], rng.choice([19, 20, 21, 45, 200])))) for k in range(40)]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=lambda r: (order(r[0]), r[1:])) == plain_removal(rows)


def test_substring_dedup_on_repeated_and_missing_ids(awkward):
    got = substring_dedup.substring_dedup(awkward, keep_text=True).collect()
    assert len(got) == awkward.count()
    assert all(r["n_words"] == r["n_removed"] + len((r["kept_text"] or "").encode().split()) for r in got)


# ---- tokens


def test_bpe_is_the_librarys(awkward):
    own = bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    got = bpe.bpe_round_trip(awkward, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    want = []
    for i, t in rows_of(awkward):
        ids = own.encode_ordinary(t or "")
        want.append((order(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((order(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(want)


SPECIAL = ["plain <|endoftext|> tail", "<|endoftext|>", "a<|endoftext|><|endoftext|>b  <|endoftext|>\n", "half <|endof text|> of it <|endoftext|", "(<|endoftext|>) and so on"]


def test_special_tokens_can_be_plain_text(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    df = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    got = packing.pack(df, P.path("byte_bpe_50k.json"), special_as_text=True).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {tuple(r) for r in got} == {(k, len(own.encode(t, add_special_tokens=False).ids) + 1) for k, t in enumerate(SPECIAL)}


def test_packing_keeps_repeated_and_missing_ids(awkward):
    got = packing.pack(awkward, P.path("byte_bpe_50k.json")).toPandas()
    want = awkward.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    assert (got[got.start == 0].groupby("doc_id", dropna=False).size().sort_index() == want.sort_index()).all()
    assert got.length.sum() == got[got.start == 0].doc_tokens.sum()


def test_packing_places_every_id_once(spark, unique):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert own.encode("plain <|endoftext|> tail", add_special_tokens=False).ids == [25638, 220, 50256, 7894]
    unique = unique.unionByName(spark.createDataFrame([(900 + k, t) for k, t in enumerate(SPECIAL)], "doc_id long, text string"), allowMissingColumns=True)
    got = packing.pack(unique, P.path("byte_bpe_50k.json")).toPandas()
    for i, t in rows_of(unique):
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        pieces, at = got[got.doc_id == i].sort_values("start"), 0
        for p in pieces.itertuples():
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048
        total = int(s.length.sum())
        assert total & (total - 1) == 0


def test_packing_routes_documents_to_tiers(spark):
    sizes = [1500] * 20 + [900] * 30 + [400] * 40 + [100] * 300
    df = spark.createDataFrame([(k, " the" * n) for k, n in enumerate(sizes)], "doc_id long, text string").coalesce(1)
    got = packing.pack(df, P.path("byte_bpe_50k.json")).toPandas()
    tokens = got.groupby("doc_id").doc_tokens.max()
    whole = got.length == got.doc_tokens
    total = got.groupby("sequence_id").length.sum()
    tier = got.groupby("sequence_id").tier.max()
    assert set(tier) == set(packing.TIERS) and (total <= tier).all() and (total[tier > 256] == tier[tier > 256]).all()
    assert (total[tier == 256] == 256).sum() >= (tier == 256).sum() - 8  # the others are powers of two, at the end
    # Every window of a tier but a task's last ones holds a piece that was routed to it.
    longest = got.groupby("sequence_id").length.max()
    assert ((longest > tier // 2) | (tier == 256)).sum() >= len(tier) - 11
    assert (got[whole].doc_tokens <= got[whole].tier).all() and len(tokens) == len(sizes)
    assert (got.groupby("step_group").tier.nunique() == 1).all()
    sizes = got.groupby("step_group").agg(tier=("tier", "max"), n=("sequence_id", "nunique"))
    assert (sizes.n == packing.STEP).sum() >= len(sizes) - 2 * len(packing.TIERS) and sizes.n.max() == packing.STEP
    short = packing.pack(df.where("doc_id >= 90"), P.path("byte_bpe_50k.json")).toPandas()
    assert set(short.tier) == {256}


def test_gaps_are_filled_from_shorter_tiers():
    packer = packing.Packer()
    for k, n in enumerate([1500, 500, 300, 200, 48]):
        packer.add(k, 0, n)
    assert list(packer.full_windows()) == [(2048, [(0, 0, 1500), (1, 0, 500), (4, 0, 48)])]
    rest = list(packer.full_windows(last=True))
    assert rest[0] == (256, [(3, 0, 200), (2, 0, 56)]) and sum(n for _, w in rest for _, _, n in w) == 500 and not packer.documents()


def test_step_groups_are_balanced():
    costs = list(range(64))
    groups = packing.step_groups(costs, 8)
    sums = [sum(c for c, g in zip(costs, groups, strict=True) if g == k) for k in range(8)]
    assert max(sums) - min(sums) <= 8 and all(groups.count(k) == 8 for k in range(8))


# ---- secrets


def plain_spans(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m.group(2)) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(spans)


def test_base_secrets_stay_and_candidates_are_scored(unique, sf, spark):
    net = secrets.fit([])
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (unique, documents):
        got = {r["doc_id"]: r for r in secrets.scan(df, net).collect()}
        for i, t in rows_of(df):
            base = plain_spans(t)
            text = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
            r = got[i]
            assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[1] == k for x in base) for k in range(3)]
            assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
            assert [x for x in r["spans"].split(",") if x and not x.startswith("model")] == [x for x in text.split(",") if x]


def test_the_network_finds_credentials_that_no_rule_names():
    net = secrets.fit([])
    held = secrets.generated(np.random.default_rng(99), 400)
    p = np.array([net.probabilities(secrets.windows(a + b + c, len(a), len(a) + len(b))).max() for a, b, c, _ in held])
    y = np.array([h[3] for h in held])
    assert (p[y == 1] >= net.threshold).mean() >= 0.9 and (p[y == 0] >= net.threshold).mean() <= 0.1


SLUG, UUID, PATH = r"[a-z]{8}_[a-z]{9}_[0-9]{2}", r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", r"[a-z]+(/[a-z]+){3}/[0-9]{3}"


@pytest.mark.parametrize(("form", "secret"), [("ghp_.*", True), ("AIza.*", True), ("xoxb-.*", True), (SLUG, False), (UUID, False), (PATH, False)])
def test_the_network_judges_forms_that_it_never_saw(monkeypatch, form, secret):
    """One form at a time is left out of training; then with the words before it, and without a telling lead."""
    real, form = secrets.generated, re.compile(form)
    monkeypatch.setattr(secrets, "generated", lambda rng, n: [g for g in real(rng, n) if not form.fullmatch(g[1])])
    net = secrets.fit([])

    def taken(rows):
        p = np.array([net.probabilities(secrets.windows(a + b + c, len(a), len(a) + len(b))).max() for a, b, c in rows])
        return (p >= net.threshold).mean()

    unseen = [(a, b, c) for a, b, c, _ in real(np.random.default_rng(98), 3000) if form.fullmatch(b)]
    plain = [(" ".join(a.split()[:5]) + " ", b, c) for a, b, c in unseen]
    assert len(unseen) > 100
    if secret:
        assert taken(unseen) >= 0.9 and taken(plain) >= 0.85
    else:
        assert taken(unseen) <= 0.2 and taken(plain) <= 0.2


def test_held_back_contexts_are_not_learned(monkeypatch):
    seen = []
    real = secrets.Network.slopes
    monkeypatch.setattr(secrets.Network, "slopes", lambda self, rows, y: seen.append(rows) or real(self, rows, y))
    monkeypatch.setattr(secrets, "generated", lambda rng, n: [])
    monkeypatch.setattr(secrets, "EPOCHS", 1)
    pairs = [(f"context {k:03d} has ", body, " in it", y) for k in range(50) for body, y in (("a1" * 12, 1), ("0000-11-22-0000-11-22", 0))]
    secrets.fit(pairs)
    assert sum(map(len, seen)) == 80


def test_fits_read_one_text_of_an_id_that_repeats(spark, monkeypatch):
    """However often an id (or null) repeats, samples are bounded by ids."""
    rows = [(7, f'password = "hunter{k}x" now', "en") for k in range(400)] + [(None, f'secret: "abcd{k}ef" now', "en") for k in range(400)] + [(k, f'token="tokens{k}" end', "de") for k in range(100, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    assert len(secrets.findings(docs)) == 202
    monkeypatch.setattr(secrets, "TRAIN_DOCS", 100)
    assert len(secrets.findings(docs)) <= 60
    got = {}
    monkeypatch.setattr(langid, "fit", lambda texts, languages, pieces: got.update(n=len(texts)))
    langid.train(spark, docs, P.path("piece_bpe_32k.model"))
    assert got["n"] == docs.where(F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).select("doc_id").distinct().count()


def test_threshold_keeps_recall_where_negatives_prevail():
    rng = np.random.default_rng(22)
    alike = ["q7" + "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), 22)) for _ in range(3300)]
    net = secrets.fit([("the mill and ", a, " by the river", int(k % 11 == 0)) for k, a in enumerate(alike)])
    p = np.array([net.probabilities(secrets.windows(f"the mill and {a} by the river", 13, 13 + len(a))).max() for a in alike[::11]])
    assert (p >= net.threshold).mean() >= 0.8 and net.recall >= secrets.RECALL and net.threshold < 0.5


def test_a_digest_that_occurs_once_a_task_is_heavy(spark):
    """200 tasks of 1,000 rows, the digest once in each: a thousandth of all rows."""
    rows = spark.range(0, 200_000, 1, 200).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 1000 == 500, "same").otherwise(F.col("id").cast("string")).alias("text"))
    heavy = exact_dedup.frequent_digests(exact_dedup.digest_rows(rows)).collect()
    assert [(r["keep_id"], r["group_size"]) for r in heavy] == [(199_500, 200)]


def test_threshold_is_the_best_of_those_that_keep_recall():
    good = np.linspace(0.1, 0.4, 100)
    threshold, recall = secrets.recall_threshold(good, np.linspace(0, 0.3, 1000))
    assert threshold == good[5] and recall == 0.95
    assert secrets.recall_threshold(good + 0.55, np.array([0.1, 0.2])) == (0.5, 1.0)
    assert secrets.recall_threshold(np.array([]), np.array([0.1])) == (0.5, None)


def test_credentials_of_the_corpus_are_no_negatives(spark):
    rng = np.random.default_rng(21)

    def some(n, letters="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"):
        return "".join(rng.choice(list(letters), n))

    def credential(k):
        return ["ghp_" + some(36), "AIza" + some(35), "Zx9+" + some(36), "xoxb-" + some(12, "0123456789") + "-" + some(24)][k % 4]

    plain = ["0b1c2d3e-0001-4a2b-9c3d-aabbccddeeff", "2024-05-06T07-08-09", "/data/logs/2024/report/final", "how-to-bake-bread-12"]
    texts = [f"the mill by the river {credential(k)} ran {credential(k + 1)} all day and {plain[k % 4]} too" for k in range(1500)]
    got = secrets.findings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {f[1] for f in got if f[3] == 0} == {p for p in plain if len(p) >= secrets.CANDIDATE} and len(got) == 3000
    net = secrets.fit(got)
    fresh = [f"a note in the margin {credential(k)} was read aloud" for k in range(400)]
    found = secrets.find(pa.array(fresh), net)
    assert np.mean([any(kind == 3 for _, kind, _ in spans) for spans in found]) >= 0.9


def test_redaction_removes_spans_and_keeps_rows(unique):
    got = {r["doc_id"]: r for r in secrets.redact(unique, secrets.fit([])).collect()}
    assert len(got) == unique.count()
    assert not any(plain_spans(r["text"]) for r in got.values() if r["text"] and "hunter22" in r["text"])


# ---- fingerprints


def plain_shingles(text):
    """The 32-bit hashes of all distinct shingles, by the operator's hash rule in Python integers."""
    mask, words = (1 << 64) - 1, [w for w in re.split("[ \t\n\x0b\f\r]+", text) if w]
    runs = [words[i : i + 5] for i in range(len(words) - 4)] or ([words] if words else [])
    out = set()
    for run in runs:
        h = 0
        for w in run:
            h = (h * 0x9E3779B97F4A7C15 + xxhash.xxh64_intdigest(w.encode())) & mask
        h = (h + (len(run) if len(run) < 5 else 0)) & mask
        h ^= h >> 33
        h = h * 0xFF51AFD7ED558CCD & mask
        h ^= h >> 33
        h = h * 0xC4CEB9FE1A85EC53 & mask
        out.add((h ^ h >> 33) >> 32)
    return out


def plain_sketch(text):
    """(fingerprint, kept hashes, up to where they are all the text's)."""
    hashes = sorted(plain_shingles(text))
    kept = [h for k, h in enumerate(hashes) if k < 32 or h < 1 << 30]
    return base64.b64encode(np.array(kept, "<u4").tobytes()).decode(), set(kept), 1 << 32 if len(kept) < 32 else max(1 << 30, kept[-1] + 1)


def plain_likeness(a, b):
    x, y = ({h for h in s[1] if h < min(a[2], b[2])} for s in (a, b))
    small = min((x, y), key=len)
    return len(x & y) / len(small) if small else float(not a[1] and not b[1])


def test_fingerprints_follow_the_next_document(unique):
    rows = sorted(rows_of(unique), key=lambda r: -r[0])
    got = {r["doc_id"]: r for r in sketch.document_fingerprints(unique).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()
        a, b, c = plain_sketch(t), plain_sketch(t[: len(t) - half] + n[:half]), plain_sketch(n)
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (a[0], b[0])
        assert np.isclose(got[i]["near_edited"], plain_likeness(a, b)) and np.isclose(got[i]["near_next"], plain_likeness(a, c))
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t or "", set()).add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_sketches_estimate_containment():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in rng.integers(0, 1 << 30, 20_000)]
    long, part, other = " ".join(words), " ".join(words[4000:8000]), " ".join(f"v{k}" for k in range(4000))
    s = sketch.Sketches(pa.array([long, part, other]))
    assert abs(sketch.containment(s.of(1), s.of(0)) - 1) < 0.02 and sketch.likeness(s.of(0), s.of(2)) == 0
    assert abs(sketch.containment(s.of(0), s.of(1)) - 0.2) < 0.05
    union = sketch.merge(s.of(1), s.of(2))
    assert sketch.containment(s.of(2), union) == 1 and (sketch.read(sketch.written(union)) == union).all()
    whole = sketch.Sketches(pa.array(["a b c d e", " ".join(words[:20]), " ".join([*words[:20], *words[30:40]])]))
    assert (sketch.merge(whole.of(0), whole.of(1)) == np.union1d(whole.of(0), whole.of(1))).all()


def test_short_texts_are_found_in_long_ones():
    """Likeness against exact shingle sets: verbatim and half-changed parts of a long text, from 10 shingles on."""
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in rng.integers(0, 1 << 30, 5000)]
    for n, most in ((14, 0.1), (24, 0.02), (120, 0.0)):
        starts = rng.integers(0, 5000 - n, 300)
        parts = [" ".join(words[i : i + n]) for i in starts]
        half = [" ".join([*words[i : i + n // 2], *(f"x{i}.{k}" for k in range(n - n // 2))]) for i in starts]
        s = sketch.Sketches(pa.array([" ".join(words), *parts, *half]))
        found = np.array([sketch.likeness(s.of(0), s.of(k)) for k in range(1, 601)])
        assert (found[:300] < 1).mean() <= most and set(found[:300]) <= {0.0, 1.0}
        truth = np.mean([len(plain_shingles(h) & plain_shingles(p)) / len(plain_shingles(h)) for p, h in zip(parts[:20], half[:20], strict=True)])
        assert abs(found[300:].mean() - truth) < 0.08


def test_short_texts_are_compared_whole():
    texts = [f"a b c d {k} f g h {k % 3} j k l m n" for k in range(30)]
    s = sketch.Sketches(pa.array(texts))
    for i in range(30):
        for j in range(30):
            x, y = plain_shingles(texts[i]), plain_shingles(texts[j])
            assert sketch.likeness(s.of(i), s.of(j)) == len(x & y) / min(len(x), len(y))


def test_an_id_of_many_rows_has_buckets_of_its_own(spark):
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"text number {k} of many") for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    placed = sketch.with_next(df)
    got = placed.where("not look").groupBy("bucket").count().collect()
    assert sum(r["count"] for r in got) == 900 and max(r["count"] for r in got) <= 330
    out = sketch.document_fingerprints(df).collect()
    assert len(out) == 900
    hashes = {r["text"]: r["h"] for r in spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "xxhash64(text) h").collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    want = set()
    for k, (i, t) in enumerate(ordered):
        n = ordered[(k + 1) % len(ordered)][1]
        want.add((i, hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()))
    assert {(r["doc_id"], r["edited_sha256"]) for r in out} == want


def test_every_row_counts_with_repeated_and_missing_ids(awkward):
    assert sketch.document_fingerprints(awkward).count() == awkward.count()


# ---- classifiers


def segmentations(word, pieces):
    """Every way to cut the word into pieces; characters without a piece of their own are the last number."""
    if not word:
        return [[]]
    heads = {k: p for k in range(1, len(word) + 1) if (p := pieces.get(word[:k])) is not None}
    heads.setdefault(1, len(pieces))
    return [[p, *rest] for k, p in heads.items() for rest in segmentations(word[k:], pieces)]


LATTICE = ["▁", "a", "b", "ab", "▁a", "bab", "aba", "▁abab", "c" * 14, "c"]


def test_language_forward_and_counts_sum_all_segmentations():
    rng = np.random.default_rng(3)
    pieces = {p: k for k, p in enumerate(LATTICE)}
    prob = np.vstack([rng.random((len(pieces), 3)) * 0.4, np.full((1, 3), 1e-7)])
    words = ["ab", "a", "babab", "ababab", "xay", "", "c" * 15, "abc"]
    weight = rng.integers(0, 5, (len(words), 3)).astype(float)
    lattice = langid.Lattice(langid.Pieces(LATTICE), words)
    value, counts = np.zeros((len(words), 3)), np.zeros_like(prob)
    for w, word in enumerate(words):
        ways = [(way, prob[way].prod(axis=0)) for way in segmentations(langid.START + word, pieces)]
        value[w] = sum(p for _, p in ways)
        for way, p in ways:
            np.add.at(counts, way, p / value[w] * weight[w])
    assert np.allclose(lattice.forward(prob), np.log(value)) and np.allclose(lattice.expected_counts(prob, weight), counts)


def test_long_words_have_their_value():
    prob = np.vstack([np.full((len(LATTICE), 2), [[0.05, 0.2]]), np.full((1, 2), 1e-7)])
    lattice = langid.Lattice(langid.Pieces(LATTICE), ["ab" * 3000, "é" * 4000])
    logs = lattice.forward(prob)
    assert np.isfinite(logs).all() and (logs[0, 1] > logs[0, 0]) and np.allclose(logs[1], np.log(prob[0]) + 4000 * np.log(1e-7))
    counts = lattice.expected_counts(prob, np.ones((2, 2)))
    used = np.array([*map(len, LATTICE), 1]) @ counts
    assert np.allclose(used, 6001 + 4001)  # every character is in one piece


def test_language_is_learned_by_plain_expectation_maximisation():
    """fit() against expectation maximisation over enumerated segmentations, ties and long words included."""
    pieces = {p: k for k, p in enumerate(LATTICE)}
    texts, languages = ["ab ab ba", "cc ccc " + "c" * 14, "ab cc", ""], np.array(["x", "y", "y", "x"], object)
    got = langid.fit(pa.array(texts), languages, LATTICE)
    prob = np.full((len(LATTICE) + 1, 2), 1 / (len(LATTICE) + 1))
    prob[-1] = langid.UNKNOWN
    for _ in range(langid.ROUNDS):
        counts = np.zeros_like(prob)
        for text, language in zip(texts, languages, strict=True):
            for word in text.split():
                ways = [(way, prob[way, int(language == "y")].prod()) for way in segmentations(langid.START + word, pieces)]
                for way, p in ways:
                    np.add.at(counts[:, int(language == "y")], way, p / sum(q for _, q in ways))
        shared = counts.sum(axis=1, keepdims=True) + 0.1
        prob = counts + 500 * shared / shared.sum()
        prob /= prob.sum(axis=0)
        prob[-1] = langid.UNKNOWN
    assert got.languages == ["x", "y"] and np.allclose(got.prob, prob)


def test_languages_that_tie_go_by_name(spark):
    model = langid.Model(["aa", "bb"], LATTICE, np.full((len(LATTICE) + 1, 2), 0.01), 1.0)
    got = langid.predict(spark.createDataFrame([(1, "ab"), (2, "12"), (3, None)], "doc_id long, text string"), model).collect()
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in got} == {(1, "aa", 0.5), (2, "und", 0.0), (3, "und", 0.0)}


def test_language_id(spark, sf, awkward):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(spark, documents, P.path("piece_bpe_32k.model"))
    got = langid.predict(documents, model).join(documents.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.95
    assert set(got.held_out) == {True, False} and all(got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id])
    odd = langid.predict(awkward, model).toPandas()
    assert len(odd) == awkward.count() and odd.score.between(0, 1).all()
    none = langid.predict(awkward, None).toPandas()
    assert set(none.lang_pred) == {"und"}


@pytest.mark.parametrize(("module", "label", "least"), [(quality, "quality", 0.95), (toxicity, "toxic", 0.88)])
def test_classifiers_on_held_out_rows(spark, sf, awkward, empty, module, label, least):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    model = module.train(spark, sf)
    got = module.score(documents, model).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held[label]).mean() >= least
    odd = module.score(awkward, model).toPandas()
    assert len(odd) == awkward.count() and odd.score.between(0, 1).all() and ((odd.score >= 0.5) == (odd.predicted == 1)).all()
    assert module.score(empty, model).count() == 0


def test_gapped_insults_are_near_their_plain_form():
    import pyarrow as pa

    clean = [f"{a}{b} and {c}" for a in ("water", "stone", "cloud") for b in ("mill", "wall", "bank") for c in ("rivers", "fields", "towns", "birds")] * 5
    toxic = [f"{t} you idiot" for t in clean[:30]]
    model = toxicity.fit(pa.array(clean + toxic), np.array([0] * len(clean) + [1] * len(toxic)))
    value = toxicity.word_scores(["idiot", "id*iot", "i-d-i-o-t", "water", "rivers"], model.weight, model.bias)
    assert min(value[:3]) > max(value[3:])
    codes, offsets, words = toxicity.text_words(pa.array(["you i d i o t there"]))
    assert "idiot" in words.to_pylist()


def plain_word_value(word, weight, bias):
    """The decision value of a word by its definition: all letter triples that span at most nine characters."""
    word = "\x02" + word + "\x02"
    if len(word) > 16:
        return max(plain_window(word[i : i + 16], weight, bias) for i in range(0, len(word) - 8, 8))
    return plain_window(word, weight, bias)


def plain_window(word, weight, bias):
    code = [63 if c == "\x02" else ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 36 if c.isalpha() else 0 for c in word]
    sums = {}
    for i in range(len(word)):
        for j in range(i + 1, len(word)):
            for k in range(j + 1, min(len(word), i + 9)):
                if code[i] and code[j] and code[k]:
                    key = (code[i] * 64 + code[j]) * 64 + code[k]
                    sums[key] = sums.get(key, 0.0) + 0.7 ** (k - i + 1)
    norm = np.sqrt(sum(v * v for v in sums.values()))
    return sum(weight[k] * v for k, v in sums.items()) / norm + bias if norm else -2.0


def test_toxicity_scores_by_their_definition(spark, sf, awkward):
    model = toxicity.train(spark, sf)
    rows = rows_of(awkward) + rows_of(spark.read.parquet(f"{sf}/documents.parquet").limit(40))
    got = toxicity.score(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string"), model).toPandas().set_index("doc_id").score
    known = {}
    for k, (_, text) in enumerate(rows):
        text = (text or "").lower()
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        words += ["".join(m.group().split()) for m in re.finditer(r"(?<!\S)\S(?:\s\S){2,}(?!\S)", text)]
        for w in words:
            known[w] = known.get(w, plain_word_value(w, model.weight, model.bias) if w not in known else 0)
        best = sorted((known[w] for w in words), reverse=True)[:2]
        best = np.maximum(best + [-2.0] * (2 - len(best)), -2.0)
        x = np.array([*best, np.log1p(sum(known[w] > 0 for w in words)), np.log(len(words) + 10)])
        assert np.isclose(got[k], 1 / (1 + np.exp(-np.clip(x @ model.slope + model.shift, -40, 40))), atol=1e-4), text[:50]


def test_landmarks_span_the_collapsed_weights():
    """One weight per triple gives the same as the kernel against all landmarks."""
    landmarks, words = ["idiot", "river", "stone", "stupid", "water"], ["idi0t", "rivers", "stupidity", "xyz", "watering"]
    space = toxicity._Space(landmarks)
    w = np.array([0.5, -1.0, 0.25, 2.0, -0.5])
    assert np.allclose(space.map(words) @ w, toxicity.scores(words, space.collapse(w), 0.0), atol=1e-5)


def test_a_fit_without_both_labels_scores_the_share(spark):
    for labels, want in (([0, 0, 0], 0.0), ([1, 1], 1.0), ([], 0.0)):
        model = toxicity.fit(pa.array(["some words here"] * len(labels), pa.string()), np.array(labels, np.int64))
        got = toxicity.score(spark.createDataFrame([(1, "you idiot"), (2, None)], "doc_id long, text string"), model).toPandas().score
        assert np.allclose(got, want, atol=1e-6)


def plain_pooled(text, context, vectors):
    """Mean and spread of a text's word vectors and its bound vectors, one word after another."""
    words = [w for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    if not words:
        return np.zeros((144 if context is not None else 96) + 24 * quality.LAGS)
    rows = []
    for w in words:
        raw = ("<" + w + ">").encode()
        kinds = bytes(1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 3 if 48 <= b <= 57 else 4 if b >= 128 else b for b in raw)
        parts = []
        for table, data in ((quality.BYTES, raw), (quality.KINDS, kinds)):
            at = [((data[i] * 961 + data[i + 1] * 31 + data[i + 2]) * 0x9E3779B1 >> 7) & 4095 for i in range(len(data) - 2)]
            parts.append(sum(table[a].astype(float) for a in at) / np.sqrt(max(len(at), 1)))
        parts.append(vectors[context[w]] if w in context else np.zeros(24))
        rows.append(np.concatenate(parts))
    rows = np.array(rows)
    bound = [sum((rows[i, :24] * rows[i - lag, :24] for i in range(lag, len(words))), np.zeros(24)) / len(words) for lag in range(1, quality.LAGS + 1)]
    return np.concatenate([rows.mean(axis=0), rows.std(axis=0), *bound])


def test_quality_scores_by_their_definition(spark, sf, awkward):
    model = quality.train(spark, sf)
    rows = rows_of(awkward) + rows_of(spark.read.parquet(f"{sf}/documents.parquet").limit(40))
    got = quality.score(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string"), model).toPandas().set_index("doc_id").score
    context = {w: k for k, w in enumerate(model.context.to_pylist())}
    for k, (_, text) in enumerate(rows):
        z = (plain_pooled(text or "", context, model.vectors) - model.mean) / model.scale
        hidden = np.maximum(z @ model.layers[0] + model.layers[1], 0)
        out = (hidden @ model.layers[2] + model.layers[3])[0] / model.temperature
        assert np.isclose(got[k], 1 / (1 + np.exp(-np.clip(out, -40, 40))), atol=2e-4), (text or "")[:50]


def plain_value(net, text, start, end):
    """The network's value of a candidate, one window and one character after another."""
    best = 0.0
    for at in range(start, max(end - 32, start + 1), 32) if end - start > 64 else [start]:
        codes = [0] * 112
        for place, part in ((32 - min(32, start), text[max(0, start - 32) : start]), (32, text[at : min(end, at + 64)]), (96, text[end : end + 16])):
            for k, c in enumerate(part):
                codes[place + k] = ord(c) - 31 if 32 <= ord(c) < 127 else 96 if ord(c) < 128 else ord("?") - 31
        padded = [0, 0, *codes, 0, 0]
        out = np.array([sum(net.vectors[padded[i + k]] @ net.kernel[k] for k in range(5)) + net.shift for i in range(112)])
        out = np.maximum(out, 0)
        logit = np.concatenate([out[:32].max(axis=0), out[32:96].max(axis=0), out[96:].max(axis=0)]) @ net.dense + net.bias[0]
        best = max(best, 1 / (1 + np.exp(-np.clip(logit / net.temperature, -40, 40))))
    return best


def test_model_spans_by_their_definition(monkeypatch):
    monkeypatch.setattr(secrets, "BATCH", 7)
    net = secrets.fit([])
    rng = np.random.default_rng(12)
    texts = ["", "plain words only", "key ghp_" + "a1B2" * 9 + " and 2024-01-02T10-11-12 é end", "x" * 20 + "7" + "y" * 300, "uuid 0b1c2d3e-0001-4a2b-9c3d-aabbccddeeff, tok AIza" + "q7Zp" * 9]
    texts += [" ".join(t) for t in [(a, b, c) for a, b, c, _ in secrets.generated(rng, 30)]]
    for text, spans in zip(texts, secrets.find(pa.array(texts), net), strict=True):
        base = plain_spans(text)
        want = list(base)
        for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}", text):
            token = m.group()
            if re.search("[0-9]", token) and re.search("[A-Za-z]", token) and not any(s < m.end() and e > m.start() for s, _, e in base) and plain_value(net, text, *m.span()) >= net.threshold:
                want.append((m.start(), 3, m.end()))
        assert spans == sorted(want), text


# ---- very long texts


@pytest.fixture(scope="module")
def giants():
    """Texts of 2 to 3 MB: words, one unbroken word, one unbroken blob of token characters, and one word over and over."""
    rng = np.random.default_rng(8)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    words = " ".join("".join(rng.choice(letters, n)) for n in rng.integers(2, 9, 350_000))
    return [(1, words), (2, "".join(rng.choice(letters, 2_000_000))), (3, "".join(rng.choice(list("ABCDEFabcdef0123456789+/"), 2_000_000))), (4, "again " * 400_000), (5, words + " tail"), (6, "short")]


def test_every_operator_takes_very_long_texts(spark, sf, giants):
    from tokenizers import Tokenizer

    df = spark.createDataFrame(giants, "doc_id long, text string").repartition(3).cache()
    texts = dict(giants)
    n = {i: len(t.split()) for i, t in giants}
    model = langid.train(spark, spark.read.parquet(f"{sf}/documents.parquet"), P.path("piece_bpe_32k.model"))
    found = langid.predict(df, model).toPandas()
    assert len(found) == 6 and found.score.between(0, 1).all() and (found.lang_pred != "und").all()
    prints = {r["doc_id"]: r["fingerprint"] for r in simhash.simhash_dedup(df).collect()}
    assert prints == {i: f"{plain_fingerprint(t):016x}" for i, t in giants}
    for module in (toxicity, quality):
        got = module.score(df, module.train(spark, sf)).toPandas()
        assert len(got) == 6 and got.score.between(0, 1).all()
    removed = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(df).collect()}
    assert removed == {1: (n[1], 0), 2: (1, 0), 3: (1, 0), 4: (n[4], n[4] - 1), 5: (n[5], n[5] - 1), 6: (1, 0)}
    net = secrets.fit([])
    spans = {r["doc_id"]: r for r in secrets.scan(df, net).collect()}
    assert len(spans) == 6 and spans[1]["n_hex"] == 0 and spans[3]["n_hex"] == sum(x[1] == 2 for x in plain_spans(texts[3]))
    packed = packing.pack(df, P.path("byte_bpe_50k.json")).groupBy("doc_id").agg({"length": "sum"}).collect()
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert {r[0]: r[1] for r in packed} == {i: len(own.encode(t, add_special_tokens=False).ids) + 1 for i, t in giants}
    exact = {r["doc_id"]: r["text_sha256"] for r in exact_dedup.exact_dedup(df).collect()}
    assert exact == {i: hashlib.sha256(t.lower().encode()).hexdigest() for i, t in giants}
    near = {r["doc_id"]: r for r in sketch.document_fingerprints(df).collect()}
    assert near[6]["n_chars"] == 5 and near[5]["near_next"] == 0 and len(near) == 6
    round_trip = {r["doc_id"]: r["decoded_sha256"] for r in bpe.bpe_round_trip(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()}
    assert round_trip == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in giants}


# ---- hot groups


def test_a_text_in_a_third_of_the_rows(spark, sample):
    """Copies of one text and near copies of another, a third of the rows each, against brute force."""
    rng = np.random.default_rng(14)
    hot, near = sample.text[3], sample.text[4].split()
    rows = []
    for k in range(900):
        text = hot if k % 3 == 0 else sample.text[k % len(sample)]
        if k % 3 == 1:
            words = list(near)
            words[rng.integers(len(words))] = f"x{k}"
            text = " ".join(words)
        rows.append((k, text))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(df).collect()) == plain_removal(rows)
    prints = {i: plain_fingerprint(t) for i, t in rows}
    parts, least = plain_components(prints.values()), {}
    for i, p in prints.items():
        least[parts[p]] = min(least.get(parts[p], i), i)
    assert {(r["doc_id"], r["component_id"]) for r in simhash.simhash_dedup(df).collect()} == {(i, least[parts[p]]) for i, p in prints.items()}


def test_a_key_with_more_fingerprints_than_a_crowd(spark):
    """5,000 fingerprints that share a half, at the operator's own CROWD."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 32, 1000)
    high = np.concatenate([centres, *[centres ^ (1 << rng.integers(0, 32, 1000)) ^ (1 << rng.integers(0, 32, 1000)) for _ in range(4)]])
    prints = np.unique((high.astype(np.int64) << 32) | 12345)
    assert len(prints) > simhash.CROWD
    parent = {int(p): int(p) for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p in prints:
        for q in prints[(np.bitwise_count((prints ^ p).view(np.uint64)) <= 4) & (prints > p)].tolist():
            parent[root(q)] = root(int(p))
    want = {}
    for p in parent:
        want.setdefault(root(p), []).append(p)
    got = {r["vertex"]: r["component"] for r in connected_components(simhash.links(spark.createDataFrame([(int(p),) for p in prints], "fp long"))).collect()}
    assert all(got.get(p, p) == min(g) for g in want.values() for p in g)


def test_a_star_and_a_chain_become_components(spark, monkeypatch):
    monkeypatch.setattr("lodemark.llm.common.HOT", 0.01)
    edges = [(0, k) for k in range(1, 600)] + [(1000 + k, 1001 + k) for k in range(150)] + [(5, 5)]
    got = {r["vertex"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(600)} | {1000 + k: 1000 for k in range(151)}


# ---- empty tables


def test_empty_tables_give_no_rows(spark, empty):
    net = secrets.fit([])
    frames = [
        exact_dedup.exact_dedup(empty), simhash.simhash_dedup(empty), substring_dedup.substring_dedup(empty), secrets.scan(empty, net), packing.pack(empty, P.path("byte_bpe_50k.json")),
        sketch.document_fingerprints(empty), bpe.bpe_round_trip(empty, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), langid.predict(empty, None), quality.score(empty, None),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)
