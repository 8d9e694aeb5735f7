"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts are cut at safe boundaries (see tokens.py), so that a text of any length reaches the library in
short units and each distinct unit of a slice only once; ids decode back through the raw bytes of each id.

Defined results: null counts as empty (no ids, hashes of the empty string); the decoded bytes are the
text's UTF-8; repeated rows give one row each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices
from .tokens import UnitEncoder


def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def bpe_round_trip(docs: DataFrame, rank_file: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids) for every row of docs."""

    def run(batches):
        own = encoding(rank_file, pattern)
        encoder = UnitEncoder(lambda units: [own.encode_ordinary(u) for u in units])  # ids of at most 64 MB of units and matches are kept
        for batch in slices(batches):
            ids, at = encoder(batch.column(1))
            counts, hashes, decoded, lists = [], [], [], []
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                part = ids[i:j]
                counts.append(j - i)
                hashes.append(hashlib.sha256(part.astype("<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(own.decode_bytes(part.tolist())).hexdigest())
                if keep_ids:
                    lists.append(part.tolist())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(lists, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
