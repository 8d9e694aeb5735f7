"""Hierarchical multi-length packing of token ids into sequences of at most 2048.

Every document is its ids and one end id. Whole windows of 2048 are cut off the front of a long document;
what is left of it, and every shorter document, is routed to the context tier that it fits: 2048, 1024,
512 or 256. Each tier has a pool of its own and is packed into windows of its own size, the longest tier
first. A window begins with the largest piece of its tier; its gap is filled from that pool and those of the
shorter tiers, the largest piece that fits first. A gap that none fits takes a cut from the largest piece of
the shorter tiers (of its own, if they are empty), and what is left of that is routed again. Tiers are packed
after each slice; a piece whose window the slice cannot fill waits for the next. What is left at the end of a
task leaves in sequences of a power of two, which need no padding and count to the tier that holds them.
Sequences of a tier are dealt to step groups of STEP, heavy and light ones (by the sum of squared piece
lengths) in turn, so that the steps of training take alike long; no group mixes tiers, and only the last two
of a task and tier hold fewer than STEP.

Packing is a map over input partitions: nothing is shuffled, and a lost task packs its rows again in the
same way. sequence_id is unique over the table: the task number above, a running number below.

Ids are those of the library with its defaults and without added special tokens: the string of a special
token in a text is that token (see `special_as_text`).

Defined results: null and empty texts are the end id alone; repeated rows and doc_ids are packed each;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_by_worker, read_table, slices
from .tokens import UnitEncoder, joined

WINDOW = 2048
TIERS = (2048, 1024, 512, 256)
STEP = 8
END_ID = 1

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long"
)


class Packer:
    """Packs pieces (document, start, length) into windows, tier by tier; keeps what fills none for the next call."""

    def __init__(self, window: int = WINDOW):
        self.tiers = (window, *(t for t in TIERS if t < window))
        self.pools: dict[int, list[tuple[int, int, int, int]]] = {t: [] for t in self.tiers}  # (length, order, document, start), sorted
        self.held = dict.fromkeys(self.tiers, 0)  # tokens in each pool
        self.order = 0

    def documents(self) -> set[int]:
        """The documents that have a piece in a pool."""
        return {p[2] for pool in self.pools.values() for p in pool}

    def add(self, document: int, start: int, length: int) -> None:
        self.order += 1
        tier = next(t for t in reversed(self.tiers) if length <= t)
        insort(self.pools[tier], (length, self.order, document, start))
        self.held[tier] += length

    def _take(self, tier: int, at: int) -> tuple[int, int, int]:
        length, _, document, start = self.pools[tier].pop(at)
        self.held[tier] -= length
        return document, start, length

    def _window(self, room: int, tiers: tuple[int, ...]) -> list[tuple[int, int, int]]:
        """A window of room tokens from the pools of tiers, which hold as many; begun with the largest piece."""
        out = []
        largest = next(t for t in tiers if self.pools[t])
        if self.pools[largest][-1][0] <= room:
            out.append(self._take(largest, -1))
            room -= out[0][2]
        while room:
            for tier in tiers:
                at = bisect_right(self.pools[tier], (room, self.order + 1, 0, 0)) - 1
                if at >= 0:
                    out.append(self._take(tier, at))
                    room -= out[-1][2]
                    break
            else:  # none fits whole: what is left of the piece that is cut is routed again
                cut = next(t for t in (*tiers[1:], tiers[0]) if self.pools[t])
                document, start, length = self._take(cut, -1)
                out.append((document, start, room))
                self.add(document, start + room, length - room)
                room = 0
        return out

    def full_windows(self, last: bool = False):
        """(tier, window), a window as a list of (document, start, length). With last, all that is left comes out too."""
        for k, tier in enumerate(self.tiers):
            tiers = self.tiers[k:]
            while self.pools[tier] and sum(self.held[t] for t in tiers) >= tier:
                yield tier, self._window(tier, tiers)
        while last and (left := sum(self.held.values())):  # less than the longest window
            room = 1 << (left.bit_length() - 1)
            yield next(t for t in reversed(self.tiers) if room <= t), self._window(room, self.tiers)


def step_groups(costs: list[int], size: int = STEP) -> list[int]:
    """The group of each cost: the heaviest first, each to the group with the least so far that has room."""
    n = -(-len(costs) // size)
    heap = [(0, 0, g) for g in range(n)]
    out = [0] * len(costs)
    for k in sorted(range(len(costs)), key=lambda k: (-costs[k], k)):
        total, held, g = heapq.heappop(heap)
        out[k] = g
        if held + 1 < size:
            heapq.heappush(heap, (total + costs[k], held + 1, g))
    return out


def pack(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID, window: int = WINDOW, special_as_text: bool = False) -> DataFrame:
    """One row per piece of every document of docs. With special_as_text, a special token's string in a text is
    encoded like any other text; without, it is that token, as the library has it by default."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        def make() -> UnitEncoder:
            bpe = Tokenizer.from_file(tokenizer_file)
            bpe.encode_special_tokens = special_as_text
            newline = bpe.encode("\n", add_special_tokens=False).ids
            return UnitEncoder(joined(lambda texts: [e.ids for e in bpe.encode_batch_fast(texts, add_special_tokens=False)], *newline))

        encoder = kept_by_worker(("packing", tokenizer_file, special_as_text), make)
        task = TaskContext.get().partitionId() << 40
        packer, tokens, names, n_sequences, n_groups = Packer(window), {}, {}, 0, 0
        number = 0
        waiting: dict[int, list] = {}  # sequences of each tier that are in no step group yet: (cost, their rows)

        def rows(windows, last=False):
            nonlocal n_sequences, n_groups
            for tier, pieces in windows:
                own, offset = [], 0
                for document, start, length in pieces:
                    ids = tokens[document]
                    crc = zlib.crc32(ids[start : start + length].astype("<u4").tobytes())
                    own.append((names[document], start, length, crc, len(ids), task + n_sequences, offset, tier))
                    offset += length
                n_sequences += 1
                waiting.setdefault(tier, []).append((sum(p[2] ** 2 for p in pieces), own))
            out = []
            for tier, sequences in sorted(waiting.items(), reverse=True):
                full = len(sequences) if last else len(sequences) - len(sequences) % STEP
                now, waiting[tier] = sequences[:full], sequences[full:]
                groups = step_groups([cost for cost, _ in now])
                for (_, own), group in zip(now, groups, strict=True):
                    out += [(*row, task + n_groups + group) for row in own]
                n_groups += max(groups, default=-1) + 1
            # Only documents with a piece in the pool are needed again.
            needed = packer.documents()
            for document in [d for d in tokens if d not in needed]:
                del tokens[document], names[document]
            columns = list(zip(*out, strict=True)) if out else [[]] * 9
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], fields)

        for batch in slices(batches, most=4 << 20):
            ids, at = encoder(batch.column(1))
            for doc_id, i, j in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                number += 1
                tokens[number], names[number] = np.append(ids[i:j], np.uint32(end_id)), doc_id
            ready = []
            for document in [d for d in tokens if d > number - batch.num_rows]:
                n = len(tokens[document])
                whole = n - n % window
                ready += [(window, [(document, start, window)]) for start in range(0, whole, window)]
                if n > whole:
                    packer.add(document, whole, n - whole)
            ready += packer.full_windows()
            yield rows(ready)
        yield rows(list(packer.full_windows(last=True)), last=True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
