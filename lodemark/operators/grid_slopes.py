"""Median slopes through the origin at every angle of a grid, and the losses there, without a row for every angle.

Built-in expressions would need each row once an angle. Here a task reads its rows once, in Arrow batches, and counts
them for every angle and type in cells of the ratios; what leaves it are those counts, whose number does not grow with
the rows. A cell is a range of the ratios' bits, in their order; each pass goes on within the cell that holds the median
until it has a single value, so that a handful of passes find it exactly, however the values lie.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a ratio that a pass tells apart.
BITS = 12
#: Types counted in the same passes, beside all of them together: 55 MB of cells in a task.
TYPES_AT_ONCE = 8
_SIGN, _REST = np.int64(63), np.int64(0x7FFFFFFFFFFFFFFF)


def _keys(v: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values."""
    bits = (v + 0.0).view(np.int64)
    return bits ^ ((bits >> _SIGN) & _REST)


def _values(keys: np.ndarray) -> np.ndarray:
    return (keys ^ ((keys >> _SIGN) & _REST)).view(np.float64)


def _columns(batch: pa.RecordBatch, types: list[str]) -> tuple[np.ndarray, ...]:
    """Depression, tangent, disparity and distance of a batch, and the number of the type, from 1 (none of types: 0)."""
    at = pa.compute.index_in(batch.column("_t"), value_set=pa.array(types, pa.string())).fill_null(-1)
    return *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("_d", "_x", "_y", "_m")), at.to_numpy(zero_copy_only=False).astype(np.int64) + 1


def _at_angle(form: str, angle: float, d: np.ndarray, x: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """Which rows count at an angle (None: all), and the tangents that they have there."""
    if form == "floor":
        return None, np.maximum(x, math.tan(math.radians(angle)))
    use = np.flatnonzero(d >= angle)
    return use, x[use]


def _count(rows: DataFrame, form: str, grid: list[float], types: list[str], low: np.ndarray, high: np.ndarray, shift: np.ndarray, going: np.ndarray) -> tuple[np.ndarray, ...]:
    """By group (0: all rows, then the types), angle and cell of what is still going: weight, rows, least and largest key."""
    cells = low.size << BITS

    def run(batches):
        total, count = np.zeros(cells), np.zeros(cells, np.int64)
        least, most = np.full(cells, _REST), np.full(cells, ~_REST)
        for batch in batches:
            d, x, y, _, kind = _columns(batch, types)
            known = ~np.isnan(x) & ~np.isnan(y)
            d, x, y, kind = (c if known.all() else c[known] for c in (d, x, y, kind))
            for k, angle in enumerate(grid):
                if not going[:, k].any():
                    continue
                use, own_x = _at_angle(form, angle, d, x)
                own_y, own_kind = (y, kind) if use is None else (y[use], kind[use])
                with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                    v = own_y / own_x
                keys, counts = _keys(v), (own_x != 0) & ~np.isnan(v)
                for groups in (np.zeros(len(v), np.int64) if going[0, k] else None, own_kind if going[1:, k].any() else None):
                    if groups is None:
                        continue
                    inside = counts & (keys >= low[groups, k]) & (keys <= high[groups, k]) & going[groups, k]
                    if groups is own_kind:
                        inside &= own_kind > 0
                    at = np.flatnonzero(inside)
                    g, own = groups[at], keys[at]
                    cell = (own.view(np.uint64) - low[g, k].view(np.uint64)) >> shift[g, k]
                    place = (g * len(grid) + k << BITS) + cell.astype(np.int64)
                    np.add.at(total, place, np.abs(own_x[at]))
                    np.add.at(count, place, 1)
                    np.minimum.at(least, place, own)
                    np.maximum.at(most, place, own)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (at, total[at], count[at], least[at], most[at])], ["place", "total", "n", "least", "most"])

    sums = [F.sum("total").alias("total"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")]
    found = rows.mapInArrow(run, "place long, total double, n long, least long, most long").groupBy("place").agg(*sums).toArrow()
    place = found["place"].to_numpy()
    out = [np.zeros(cells), np.zeros(cells, np.int64), np.zeros(cells, np.int64), np.zeros(cells, np.int64)]
    for made, name in zip(out, ("total", "n", "least", "most"), strict=True):
        made[place] = found[name].to_numpy()
    return tuple(made.reshape(*low.shape, -1) for made in out)


def median_slopes(base: DataFrame, form: str, grid: list[float], types: list[str]) -> tuple[list[float | None], list[dict[str, float]]]:
    """For each angle the lower median of _y/x weighted by |x|, of all rows and by type; x is the tangent that the form has there.

    base has _d (depression), _x (its tangent), _y (disparity), _m (distance) and _t (type).
    """
    pooled: list[float | None] = [None] * len(grid)
    by_type: list[dict[str, float]] = [{} for _ in grid]
    rows = base.select("_d", "_x", "_y", "_m", "_t")
    for first in range(0, max(len(types), 1), TYPES_AT_ONCE):
        some = types[first : first + TYPES_AT_ONCE]
        shape = len(some) + 1, len(grid)
        low, high = np.full(shape, ~_REST), np.full(shape, _REST)
        below, half, going = np.zeros(shape), np.full(shape, np.nan), np.full(shape, True)
        going[0] = first == 0
        while going.any():
            spans = [(int(b) - int(a)).bit_length() for a, b in zip(low.flat, high.flat, strict=True)]
            shift = np.array([max(s - BITS, 0) for s in spans], np.uint64).reshape(shape)
            total, count, least, most = _count(rows, form, grid, some, low, high, shift, going)
            for g, k in zip(*np.nonzero(going), strict=True):
                held = np.flatnonzero(count[g, k])
                if not len(held):
                    going[g, k] = False
                    continue
                upto = below[g, k] + np.cumsum(total[g, k, held])
                if np.isnan(half[g, k]):
                    half[g, k] = 0.5 * upto[-1]
                at = min(int(np.searchsorted(upto, half[g, k])), len(held) - 1)
                below[g, k] = upto[at] - total[g, k, held[at]]
                low[g, k], high[g, k] = least[g, k, held[at]], most[g, k, held[at]]
                if low[g, k] == high[g, k]:
                    going[g, k], slope = False, float(_values(low[g, k : k + 1])[0])
                    if g:
                        by_type[k][some[g - 1]] = slope
                    else:
                        pooled[k] = slope
    return pooled, by_type


def mean_losses(base: DataFrame, form: str, grid: list[float], pooled: list[float], by_type: list[dict[str, float]], cap: float, loss: str = "l1") -> tuple[list[float], list[float]]:
    """The mean absolute ("ols": squared) error in metres at each angle: with one height, and with those of the types (one for the others); one pass."""
    types = sorted({t for own in by_type for t in own if t is not None})
    heights = np.array([[h, *[own.get(t, h) for t in types]] for h, own in zip(pooled, by_type, strict=True)])

    def run(batches):
        sums, n = np.zeros((len(grid), 2)), 0
        for batch in batches:
            d, x, _, m, kind = _columns(batch, types)
            n += len(m)
            level = np.maximum(d, 0.0)
            for k, angle in enumerate(grid):
                a = math.radians(angle)
                with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                    per_metre = 1 / np.maximum(x, math.tan(a)) if form == "floor" else np.where(d >= angle, 1 / x, 1 / math.tan(a) - (math.radians(1) / math.sin(a) ** 2) * (level - angle))
                    for typed in (0, 1):
                        h = heights[k][kind] if typed else heights[k, 0]
                        e = np.clip(h * per_metre, 0.0, cap) - m
                        sums[k, typed] += e @ e if loss == "ols" else np.abs(e).sum()
        yield pa.RecordBatch.from_arrays([pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.array(np.full(len(grid), n)), pa.array(np.arange(len(grid)))], ["one", "typed", "n", "k"])

    found = base.select("_d", "_x", "_y", "_m", "_t").mapInArrow(run, "one double, typed double, n long, k long").groupBy("k").agg(*[(F.sum(c) / F.sum("n")).alias(c) for c in ("one", "typed")]).collect()
    own = {r["k"]: r for r in found}
    return [own[k]["one"] for k in range(len(grid))], [own[k]["typed"] for k in range(len(grid))]
