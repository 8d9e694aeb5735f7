"""Whitening of embeddings by a randomised range finder.

Entries become whole numbers (floor(64 c) + 1,000,000) and every distinct vector counts once; n and the sums S are exact.
A random block of COMPONENTS + OVERSAMPLING directions is multiplied by the covariance over all centred rows, once and
then in POWER_PASSES more passes with orthonormal bases between them; Rayleigh-Ritz in the range gives the components.
If a component's residual is too large for the gaps beside its eigenvalue, the block grows to all dimensions, where
Rayleigh-Ritz is exact. A pass sends one block of sums a task and adds them up in rounds; the driver only holds blocks of
dimension x directions, however many rows there are.

Defined results: rows whose vector is null or empty, or holds a null or a non-finite entry, are left out, as are rows
whose dimension is not the most common one (of equally common ones the largest stays); entries too large for a long are
the largest one; repeated rows and ids, and missing ids, give their rows each; components without variance (the rank
may be smaller than the dimension) are left out, so that equal vectors alone give no rows; a deviation too large for a
long is null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_model, read_table, set_checkpoint_dir

COMPONENTS, OVERSAMPLING, POWER_PASSES = 16, 16, 3
#: Largest error of a component that a residual may stand for, and the share of the variance that counts as none.
TOLERANCE, NOTHING = 1e-12, 1e-12
#: Vector entries that one Python step holds at once.
ENTRIES = 1 << 20
#: Blocks of sums that the driver adds up itself.
FEW = 8


def scaled(vector: Column) -> Column:
    """The vector in whole numbers, or null if it is to be dropped."""
    entry = F.transform(vector, lambda c: c.cast("double"))
    sound = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(entry, lambda c: F.floor(c * 64.0))
    # beyond 2^62 the sum below could leave the range of a long
    edge = F.lit(1 << 62)
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & sound, F.transform(whole, lambda c: F.greatest(F.least(c, edge), -edge) + 1_000_000))


@dataclass
class Fit:
    """What whitening needs to know: n, exact sums, components (in columns) and their eigenvalues, shares of the variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float
    directions: int  # in the last block


def _blocks(batches, column: str = "x"):
    """Row blocks of the vectors as matrices of longs, with the place of each in its batch."""
    for batch in batches:
        x = batch.column(column)
        if not len(x):
            continue
        width = len(x[0])
        step = max(1, ENTRIES // max(1, width))
        for i in range(0, len(x), step):
            part = x.slice(i, step)
            yield batch.slice(i, step), part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), width)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: longs, or whole numbers of any size where those would not do."""
    if n * int(max(np.abs(x).max(initial=0), max(map(abs, sums), default=0) // max(n, 1) + 1)) < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _added(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of all blocks (column part: doubles in bytes), in rounds, so that neither a task nor the driver gets many."""

    def add(batches):
        total = None
        for batch in batches:
            for part in batch.column("part"):
                values = np.frombuffer(part.as_buffer(), np.float64)
                total = values.copy() if total is None else total + values
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    tasks = parts.rdd.getNumPartitions()
    while tasks > FEW:
        tasks = max(1, round(tasks**0.5))
        parts = parts.repartition(tasks).mapInArrow(add, "part binary")
    found = [np.frombuffer(r["part"], np.float64) for r in parts.toLocalIterator()]
    return np.sum(found, axis=0) if found else np.zeros(size)


def _times_covariance(rows: DataFrame, n: int, sums: list[int], block: np.ndarray) -> np.ndarray:
    """The covariance of rows times the block, and the trace: one pass over all rows, centred before anything is multiplied."""
    shared = broadcast_model(rows.sparkSession, (n, sums, block))  # dimension x directions

    def run(batches):
        n, sums, block = shared()
        total, trace = np.zeros(block.shape), 0.0
        for _, x in _blocks(batches):
            z = centred(x, n, sums).astype(np.float64) / n
            total += z.T @ (z @ block)
            trace += float(np.einsum("ij,ij->", z, z))
        yield pa.RecordBatch.from_arrays([pa.array([np.append(total.ravel(), trace).tobytes()], pa.binary())], ["part"])

    found = _added(rows.select("x").mapInArrow(run, "part binary"), block.size + 1)
    return found / n


def _exact_sums(rows: DataFrame) -> DataFrame:
    """place, total, n: the sum of each entry over all rows, in a decimal that no sum of longs overflows."""

    def run(batches):
        total, n = None, 0
        for _, x in _blocks(batches):
            small = int(np.abs(x).max(initial=0)) * len(x) < 1 << 62
            part = x.sum(axis=0).astype(object) if small else x.astype(object).sum(axis=0)
            total, n = part if total is None else total + part, n + len(x)
        if total is not None:
            places = pa.array(range(len(total)), pa.int32())
            yield pa.RecordBatch.from_arrays([places, pa.array([str(t) for t in total]), pa.array([n] * len(total), pa.int64())], ["place", "total", "n"])

    parts = rows.select("x").mapInArrow(run, "place int, total string, n long")
    return parts.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).orderBy("place")


def _rayleigh_ritz(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values and vectors in the range of basis, largest first, and each one's residual."""
    small = basis.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    return values, basis @ turn, np.linalg.norm(image @ turn - (basis @ turn) * values, axis=0)


def _settled(values: np.ndarray, residuals: np.ndarray, wanted: int) -> bool:
    """Whether residual over gap, which bounds the error of a vector, is small for all wanted components."""
    if len(values) <= wanted:
        return False
    top = max(values[0], 0.0)
    gaps = np.abs(np.diff(values[: wanted + 1]))
    beside = np.minimum(np.concatenate([[np.inf], gaps[:-1]]), gaps)
    needed = values[:wanted] > NOTHING * top
    return bool((residuals[:wanted][needed] <= TOLERANCE * np.maximum(beside[needed], 1e-300)).all())


def fit(rows: DataFrame, components: int = COMPONENTS, oversampling: int = OVERSAMPLING, passes: int = POWER_PASSES) -> Fit | None:
    """The whitening of rows: a table with a column x, vectors of one dimension, each once, that can be read again."""
    found = _exact_sums(rows).collect()  # one row a dimension
    if not found:
        return None
    n, sums, dimension = found[0]["n"], [int(r["total"]) for r in found], len(found)
    rng = np.random.default_rng(12)
    width = min(dimension, components + oversampling)
    basis = np.eye(dimension) if width == dimension else np.linalg.qr(rng.standard_normal((dimension, width)))[0]
    for k in range(passes + 1):
        result = _times_covariance(rows, n, sums, basis)
        image, trace = result[:-1].reshape(basis.shape), float(result[-1])
        values, vectors, residuals = _rayleigh_ritz(basis, image)
        wanted = min(components, dimension)
        if basis.shape[1] == dimension or _settled(values, residuals, wanted):
            break
        if k == passes:
            basis = np.eye(dimension)
            result = _times_covariance(rows, n, sums, basis)
            values, vectors, residuals = _rayleigh_ritz(basis, result[:-1].reshape(basis.shape))
            break
        basis = np.linalg.qr(image)[0]
    kept = values[:wanted] > NOTHING * max(values[0], 0.0)
    values, vectors = values[:wanted][kept], vectors[:, :wanted][:, kept]
    error = 0.0
    if len(values):
        whitening = vectors / np.sqrt(values)
        image = _times_covariance(rows, n, sums, whitening)[:-1].reshape(whitening.shape)
        error = float(np.abs(whitening.T @ image - np.eye(len(values))).max())
    return Fit(n, sums, vectors, values, values / trace if trace > 0 else values, error, basis.shape[1])


def whiten(rows: DataFrame, own: Fit | None) -> DataFrame:
    """rows (vec_id, x) -> one row for each vector and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if own is None:
        return rows.sparkSession.createDataFrame([], schema)
    shared = broadcast_model(rows.sparkSession, own)  # dimension x components

    def run(batches):
        own = shared()
        k = len(own.values)
        whitening = own.components / np.sqrt(own.values)
        for batch, x in _blocks(batches):
            z = centred(x, own.n, own.sums)
            small = z.dtype != object and int(np.abs(z).max(initial=0)) ** 2 * z.shape[1] < 1 << 62
            squares = (z * z).sum(axis=1) if small else (z.astype(object) ** 2).sum(axis=1)
            deviations = pa.array(squares if small else [v if v < 1 << 63 else None for v in squares], pa.int64())
            projected = (z.astype(np.float64) / own.n) @ whitening
            m = len(x)
            again = pa.array(np.repeat(np.arange(m), k))
            columns = [
                batch.column(0).take(again),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, own.n, np.int64)),
                deviations.take(again),
                pa.array(projected.ravel()),
                pa.array(np.tile(own.explained, m)),
                pa.array(np.full(m * k, own.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, schema)


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and x of the rows that are not dropped."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding")).alias("x")).where("x IS NOT NULL")
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (common["d"] if common else 0))


def whitened(embeddings: DataFrame) -> DataFrame:
    """The whitening of embeddings (vec_id, embedding), fitted on its distinct vectors."""
    spark = embeddings.sparkSession
    set_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/vectors-{uuid.uuid4().hex}"
    rows = usable(embeddings)
    rows.select("x").distinct().write.parquet(path)  # read again in every pass
    return whiten(rows, fit(spark.read.parquet(path)))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(read_table(spark, sf_dir, "embeddings"))
