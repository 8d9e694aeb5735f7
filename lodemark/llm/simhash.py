"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at distance d <= 4 differ in at most 2 bits of one of their 32-bit halves. Within a half
the ball of radius 2 is searched from both ends: every fingerprint emits the half itself and its 32
one-bit variants, 66 keys in all, and shuffles on them; fingerprints that meet on a key are verified on
all 64 bits. (The ball over all 64 bits at once takes 2,081 keys a fingerprint; see the README for what
that costs.)

A key with more than CROWD fingerprints is met in the middle once more, in the other half, with the flips
that are left of two: everything that meets there is within two flips of one 64-bit point, so pairwise
within four, and a grouped minimum links all of it without a pair being formed. So no group of near
copies, however large, is expanded into pairs, and no link is lost.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; equal
fingerprints are one vertex; component_id is the least doc_id of the component (null doc_ids are ignored
for it, unless there is no other); repeated doc_ids give one row each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, join_by_key, read_table, slices, tasks_for
from .components import connected_components

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Fingerprints that one key holds before its members are met again in the other half.
CROWD = 4096


def _lanes() -> np.ndarray:
    """Entry x has the bits of byte x, lowest first, in lanes of eight bits each."""
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    return np.ascontiguousarray(bits.astype(np.uint8)).view(np.uint64).ravel()


_LANES = _lanes()


def shingle_hashes(text: bytes) -> list[int]:
    """XXH64 of each 4-word shingle; of the whole sequence if there are fewer words; [] if there are none."""
    words = text.lower().split()  # bytes.lower() is A-Z; bytes.split() is the six ASCII spaces
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.concatenate([np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), [len(joined)]])
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(joined[i:j], SEED) for i, j in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)]


def majority_bits(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half the hashes."""
    n = len(hashes)
    if not n:
        return 0
    # Eight lane words a hash; a byte lane holds sums of up to 255 hashes.
    ones = np.zeros(64, np.int64)
    lanes = hashes.view(np.uint8).reshape(n, 8)
    for start in range(0, n, 1 << 16):
        part = _LANES[lanes[start : start + (1 << 16)]]
        sums = np.add.reduceat(part, np.arange(0, len(part), 255), axis=0)
        ones += sums.view(np.uint8).reshape(len(sums), 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *keys: str) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; and the columns keys (longs)."""

    def run(batches):
        for batch in slices(batches):
            prints = np.zeros(batch.num_rows, np.uint64)
            for i, raw in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                prints[i] = majority_bits(np.array(shingle_hashes(raw or b""), np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *keys])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keys).mapInArrow(run, ", ".join(["doc_id long, fp long", *(f"{k} long" for k in keys)]))


def half_keys(prints: DataFrame) -> DataFrame:
    """fp with its 66 keys: bit 32 of a key tells the half, the low 32 bits are the variant."""

    def run(batches):
        flips = np.concatenate([[0], 1 << np.arange(32, dtype=np.int64)])
        for batch in batches:
            fp = batch.column(0).to_numpy()
            high, low = (fp >> 32) & 0xFFFFFFFF, fp & 0xFFFFFFFF
            for start in range(0, len(fp), 4096):
                here = slice(start, start + 4096)
                keys = np.concatenate([low[here, None] ^ flips, (high[here, None] ^ flips) | (1 << 32)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(fp[here], 66))], ["key", "fp"])

    return prints.mapInArrow(run, "key long, fp long")


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ; on unsigned values, as the count of a negative number is that of its magnitude."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _links(fp: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of one key's fingerprints under the distance; as many pairs as it takes."""
    fp = np.unique(fp)
    left, out = fp, []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):  # breadth first; each fingerprint is linked once
            near = differing(left[:, None], front[None, :64]) <= RADIUS
            hit = near.any(axis=1)
            out += zip(left[hit].tolist(), front[near[hit].argmax(axis=1)].tolist(), strict=True)
            front = np.concatenate([front[64:], left[hit]])
            left = left[~hit]
    return out


def _meet(batches):
    """Rows sorted by key -> links within keys; members of crowded keys pass through with their key."""
    held_key, held, crowded = None, [], False

    def close():
        return _links(np.concatenate(held)) if held and not crowded and sum(map(len, held)) > 1 else []

    for batch in batches:
        key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(cuts[1:], len(key))
        pairs: list[tuple[int, int]] = []
        through: list[tuple[np.ndarray, int]] = []
        # Pairs are by far the most common meeting: they are verified all at once.
        inner = (ends - cuts == 2) & (cuts > 0) & (ends < len(key))
        two = cuts[inner]
        near = differing(fp[two], fp[two + 1]) <= RADIUS
        pairs += zip(fp[two[near]].tolist(), fp[two[near] + 1].tolist(), strict=True)
        for c, e in zip(*(x[(ends - cuts > 2) | (cuts == 0) | (ends == len(key))].tolist() for x in (cuts, ends)), strict=True):
            if key[c] != held_key:
                pairs += close()
                held_key, held, crowded = int(key[c]), [], False
            held.append(fp[c:e].copy())
            if crowded or sum(map(len, held)) > CROWD:
                crowded = True
                through += [(x, held_key) for x in held]
                held = []
        a = [x for x, _ in pairs]
        b = [y for _, y in pairs]
        k = [None] * len(a)
        rest = np.concatenate([x for x, _ in through]) if through else np.zeros(0, np.int64)
        keys = np.concatenate([np.full(len(x), y, np.int64) for x, y in through]) if through else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.array(a, pa.int64()), pa.array(rest, pa.int64())]),
                pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(rest), pa.int64())]),
                pa.concat_arrays([pa.array(k, pa.int64()), pa.array(keys, pa.int64())]),
            ],
            ["a", "b", "key"],
        )
    last = close()
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in last], pa.int64()), pa.array([y for _, y in last], pa.int64()), pa.nulls(len(last), pa.int64())], ["a", "b", "key"])


def _refine(batches):
    """Members of crowded keys -> the 64-bit points that the flips left of two reach in the other half."""
    bits = 1 << np.arange(32, dtype=np.int64)
    ones = np.concatenate([[0], bits])
    i, j = np.triu_indices(32, 1)
    twos = np.concatenate([ones, bits[i] | bits[j]])
    for batch in batches:
        for fp, key in zip(batch.column(0).to_numpy().tolist(), batch.column(1).to_numpy().tolist(), strict=True):
            upper = bool(key >> 32)
            variant = key & 0xFFFFFFFF
            own, other = ((fp >> 32) & 0xFFFFFFFF, fp & 0xFFFFFFFF) if upper else (fp & 0xFFFFFFFF, (fp >> 32) & 0xFFFFFFFF)
            flips = twos if own == variant else ones
            points = other ^ flips
            points = (np.int64(variant) << 32) | points if upper else (points << 32) | variant
            yield pa.RecordBatch.from_arrays([pa.array(points), pa.array(np.full(len(points), fp, np.int64))], ["point", "fp"])


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links that connect exactly what distance at most RADIUS connects. prints: distinct fp."""
    n = tasks_for(prints)
    met = checkpointed(half_keys(prints).repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(_meet, "a long, b long, key long"))
    crowded = met.where(F.col("b").isNull()).select(F.col("a").alias("fp"), "key").mapInArrow(_refine, "point long, fp long")
    # One row a point and task after the partial minimum; the minimum of a point links all that reach it.
    least = crowded.groupBy("point").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    starred = crowded.join(least, "point").select(F.col("fp").alias("a"), "b").where("a <> b")
    return met.where(F.col("b").isNotNull()).select("a", "b").unionByName(starred)


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs."""
    prints = checkpointed(fingerprints(docs))
    groups = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    n_groups, n_rows = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    parts = connected_components(links(groups.select("fp")))
    named = checkpointed(groups.join(parts, groups["fp"] == parts["vertex"], "left").select("fp", "least", "copies", F.coalesce("component", "fp").alias("component")))
    roots = checkpointed(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")))
    # A component, or a fingerprint, that holds a large share of the rows is not dealt to one task.
    labels = checkpointed(join_by_key(named, roots, "component", "members", n_groups).select("fp", "component_id", "copies"))
    return join_by_key(prints, labels, "fp", "copies", n_rows).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def survivors(docs: DataFrame, key: str) -> DataFrame:
    """The column key (unique longs) of one row per component: its least doc_id (null ids last), then the least key."""
    prints = checkpointed(fingerprints(docs, key))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", key))
    groups = checkpointed(prints.groupBy("fp").agg(least.alias("least")))
    parts = connected_components(links(groups.select("fp")))
    named = groups.join(parts, groups["fp"] == parts["vertex"], "left").select("least", F.coalesce("component", "fp").alias("component"))
    return named.groupBy("component").agg(F.min("least").alias("least")).select(f"least.{key}")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(read_table(spark, sf_dir, "documents"))
