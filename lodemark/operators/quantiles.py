"""Exact quantiles and weighted medians of groups of any size.

The built-in percentile keeps every distinct value of a group in one task. Here a bounded summary first
tells where a group's rank must lie, and only the rows of that narrow range are gathered: the value is exact,
and no task holds a group.
"""

from __future__ import annotations

import math
import sys
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups of so many values are gathered whole; of a larger one about 4/ACCURACY of its values.
WHOLE = 100_000
ACCURACY = 50_000
#: Where no group has more rows than this, they are gathered, or run through by a window, in a single pass.
DIRECT = 200_000
#: Cells that the range of a weighted median is cut into in each pass.
CELLS = 4096
#: Tables of so many groups are broadcast.
FEW = 10_000
#: Ranks of so many groups are found by counting cells of the values, as many for each factor of e.
COUNTED, FINE = 100, 16_384
_LARGEST = sys.float_info.max


def beside(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """rows with the columns of groups, one row per value of by (missing equals missing), n of them in rows.

    Few groups are broadcast. Of many, those that hold a thousandth of the rows or more (1,000 at most) are,
    so that their rows stay where they are, and the others shuffle.
    """
    named = groups.withColumnsRenamed({c: f"_g_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    drop = [f"_g_{c}" for c in by]
    size = groups.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).first()
    if size["k"] <= FEW:
        return rows.join(F.broadcast(named), same).drop(*drop)
    hot = F.col("n") >= size["n"] / 1000
    few = rows.join(F.broadcast(named.where(hot)), same)
    many = rows.join(F.broadcast(named.where(hot).select(*drop)), same, "left_anti").join(named.where(~hot), same)
    return few.unionByName(many).drop(*drop)


def apart(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with the columns, each computed in an operator of its own.

    Neighbouring projections become one, and the JVM does not compile a method of more than 8,000 bytes: a few long
    expressions in one projection run many times slower. A generator of one row after each keeps them apart.
    """
    kept = [F.col(f"`{k}`") for k in df.columns]
    for name, c in columns.items():
        df = df.select(*kept, c.alias("_apart")).select(*kept, F.explode(F.array("_apart")).alias(name))
        kept.append(F.col(f"`{name}`"))
    return df


def _sizes(df: DataFrame, by: list[str]) -> tuple[int, int]:
    """Rows of the largest group, and how many groups there are."""
    found = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    return found["n"] or 0, found["k"]


def _largest(df: DataFrame, by: list[str]) -> int:
    """Rows of the largest group."""
    return _sizes(df, by)[0]


def _between(values: Column, q: float) -> Column:
    """The quantile of an ordered array, linear between ranks; NULL of an empty one."""
    at = (F.size(values) - 1) * F.lit(q)
    low, high = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int"))
    return F.when(F.size(values) > 0, F.when(F.floor(at) == F.ceil(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high))


def _rank(k: int, at: Column) -> Column:
    """The value of rank `at` (from 0) among value k's rows: below the low edge, on it, between the edges, or on the high one."""
    low, inside = F.col(f"_low{k}"), F.col(f"_in{k}")
    first = F.col(f"_eq{k}") + F.col(f"_below{k}")
    return F.when(at < first, low).when(at < first + F.size(inside), F.get(inside, (at - first).cast("int"))).otherwise(F.col(f"_high{k}"))


def _gathered(spots: list[tuple[str, int, float]]) -> list[Column]:
    """For each of spots the counts below and on its low edge, and the values between both edges."""
    out = []
    for s, (_, k, _) in enumerate(spots):
        v, low, high = F.col(f"_v{k}"), F.col(f"_low{s}"), F.col(f"_high{s}")
        out += [F.count_if(v < low).alias(f"_below{s}"), F.count_if(v == low).alias(f"_eq{s}"), F.sort_array(F.collect_list(F.when((v > low) & (v < high), v))).alias(f"_in{s}")]
    return out


def _at_ranks(groups: DataFrame, kept: list[str], spots: list[tuple[str, int, float]], rounded) -> DataFrame:
    """The kept columns and the quantile of each of spots, from what was gathered about its edges."""
    out = []
    for s, (name, _, q) in enumerate(spots):
        at = (F.col(f"_c{s}") - 1) * q
        a, b = _rank(s, F.floor(at)), _rank(s, F.ceil(at))
        value = F.when(F.col(f"_c{s}") > 0, F.when(F.floor(at) == F.ceil(at), a).otherwise((F.ceil(at) - at) * a + (at - F.floor(at)) * b))
        out.append(rounded(value).alias(name))
    return groups.select(*kept, *out)


def _counted_edges(wide: DataFrame, keys: list[str], n_values: int, spots: list[tuple[str, int, float]]) -> DataFrame | None:
    """keys and, for each of spots, the least and largest value (_low, _high) of the cells that hold its ranks, and how many values there are (_c).

    None where such a cell holds more values than are to be gathered.
    """
    from lodemark.session import checkpointed

    v = F.col("_v")
    values = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_v{k}").alias("v")) for k in range(n_values)])
    rows = wide.select(*keys, F.explode(values).alias("_x")).select(*keys, F.col("_x.k").alias("_k"), F.col("_x.v").alias("_v"))
    cells = rows.groupBy(*keys, "_k", F.floor(F.signum(v) * F.log1p(F.abs(v)) * FINE).alias("_cell")).agg(F.count(v).alias("_m"), F.min(v).alias("_min"), F.max(v).alias("_max"))
    group = Window.partitionBy(*keys, "_k")
    upto = F.sum("_m").over(group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
    counts = cells.select("*", upto.alias("_upto"), F.sum("_m").over(group).alias("_total"))
    first, held, edges = F.col("_upto") - F.col("_m"), F.col("_total") == 0, []
    for s, (_, k, q) in enumerate(spots):
        own, at = F.col("_k") == k, (F.col("_total") - 1) * F.lit(q)
        low, high = (own & (r >= first) & (r < F.col("_upto")) for r in (F.floor(at), F.ceil(at)))
        held = held | low | high
        edges += [F.max(F.when(low, F.col("_min"))).alias(f"_low{s}"), F.max(F.when(high, F.col("_max"))).alias(f"_high{s}"), F.max(F.when(own, F.col("_total"))).alias(f"_c{s}")]
    hits = checkpointed(counts.where(held))
    if hits.where((F.col("_m") > F.greatest(F.lit(WHOLE), F.col("_total") * (8 / ACCURACY))) & (F.col("_min") < F.col("_max"))).limit(1).count():
        return None
    return hits.groupBy(*keys).agg(*edges)


def quantiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[Column, float]], aggs: list[Column] = (), digits: int | None = 6) -> DataFrame:
    """by, n (rows), every column of aggs and, for each name of wanted, the exact quantile of a Column (linear between ranks).

    Missing values and NaN do not count; a group without any gets NULL. Two passes over df, both with partial aggregates:
    the first finds a narrow range for each quantile, by counted cells for few groups, else by summaries.
    """
    from lodemark.session import checkpointed

    by = list(by)
    keys = by or ["_all"]
    values = list({str(c): c for c, _ in wanted.values()}.items())
    number = {name: k for k, (name, _) in enumerate(values)}
    spots = [(name, number[str(c)], q) for name, (c, q) in wanted.items()]
    named = {f"Column<'{c}'>" for c in df.columns}
    long = {f"_v{k}": F.nanvl(c.cast("double"), F.lit(None)) for k, (text, c) in enumerate(values) if text not in named}
    short = [F.nanvl(c.cast("double"), F.lit(None)).alias(f"_v{k}") for k, (text, c) in enumerate(values) if text in named]
    wide = (apart(df, long) if len(long) > 1 else df.select("*", *[c.alias(n) for n, c in long.items()])).select("*", *short, *([] if by else [F.lit(0).alias("_all")]))
    rounded = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    largest, n_groups = _sizes(df, by)
    if largest <= DIRECT:
        plain = wide.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *aggs, *[F.sort_array(F.collect_list(f"_v{k}")).alias(f"_s{k}") for k in range(len(values))])
        named = [c for c in plain.columns if not c.startswith("_") and c not in ("n", *keys)]
        return plain.select(*by, "n", *named, *[rounded(_between(F.col(f"_s{k}"), q)).alias(name) for name, k, q in spots])
    counted = _counted_edges(wide, keys, len(values), spots) if n_groups <= min(COUNTED, FEW) else None
    if counted is not None:
        named = counted.withColumnsRenamed({c: f"_g_{c}" for c in keys})
        same = F.lit(True)
        for c in keys:
            same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
        found = wide.join(F.broadcast(named), same).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *aggs, *_gathered(spots))
        extra = [c for c in found.columns if not c.startswith("_") and c not in ("n", *keys)]
        return _at_ranks(found.join(F.broadcast(named), same), [*by, "n", *extra], spots, rounded)
    # Where cells do not tell, or groups are many. Pass 1: how many values, and for every quantile a range of ranks that must hold it.
    margin, found = 2 / ACCURACY, [F.count(F.lit(1)).alias("n")]
    for k in range(len(values)):
        v = F.col(f"_v{k}")
        found += [F.count(v).alias(f"_n{k}"), F.min(v).alias(f"_min{k}"), F.max(v).alias(f"_max{k}")]
        edges = sorted({min(max(q + s * margin, 0.0), 1.0) for _, j, q in spots if j == k for s in (-1, 1)})
        found.append(F.percentile_approx(v, edges, ACCURACY).alias(f"_e{k}"))
    first = wide.groupBy(*keys).agg(*found, *aggs)
    extra = [c for c in first.columns if not c.startswith("_") and c not in ("n", *keys)]
    edged = []
    for s, (_, k, q) in enumerate(spots):
        edges = sorted({min(max(p + x * margin, 0.0), 1.0) for _, j, p in spots if j == k for x in (-1, 1)})
        whole = F.col(f"_n{k}") <= WHOLE
        low, high = (F.get(f"_e{k}", edges.index(min(max(q + x * margin, 0.0), 1.0))) for x in (-1, 1))
        edged += [F.when(whole | F.lit(q - margin <= 0), F.col(f"_min{k}")).otherwise(low).alias(f"_low{s}"), F.when(whole | F.lit(q + margin >= 1), F.col(f"_max{k}")).otherwise(high).alias(f"_high{s}"), F.col(f"_n{k}").alias(f"_c{s}")]
    groups = checkpointed(first.select(*keys, "n", *extra, *edged))
    # Pass 2: counts below and on the low edge, and the values between both edges.
    rows = beside(wide.select(*keys, *[f"_v{k}" for k in range(len(values))]), groups.select(*keys, "n", *[f"_{e}{s}" for s in range(len(spots)) for e in ("low", "high")]), keys)
    counted = rows.groupBy(*keys).agg(*_gathered(spots))
    return _at_ranks(beside(counted, groups, keys), [*by, "n", *extra], spots, rounded)


def cell_quantiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """by and, for each name of wanted, the exact quantile of a column (linear between ranks), for few groups of many rows.

    As quantiles(), but counts by cells of the value tell which cells hold the ranks, where summaries of all values
    would cost more than the rows; only those cells are gathered. Keys must not be missing.
    """
    from lodemark.session import checkpointed

    v = F.nanvl(F.col(value).cast("double"), F.lit(None))
    rows = df.select(*by, v.alias("_v"), F.floor(F.signum(v) * F.log1p(F.abs(v)) * (CELLS / 2)).alias("_cell"))
    group = Window.partitionBy(*by)
    upto = F.sum("_m").over(group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
    counts = rows.groupBy(*by, "_cell").agg(F.count("_v").alias("_m")).select("*", upto.alias("_upto"), F.sum("_m").over(group).alias("_total"))
    spots = {name: (F.col("_total") - 1) * F.lit(q) for name, q in wanted.items()}
    first = F.col("_upto") - F.col("_m")
    held = F.col("_total") == 0
    for at in spots.values():
        for r in (F.floor(at), F.ceil(at)):
            held = held | ((r >= first) & (r < F.col("_upto")))
    hits = checkpointed(counts.where(held))
    inside = rows.join(F.broadcast(hits), [*by, "_cell"]).groupBy(*by, "_cell", "_m", "_upto", "_total").agg(F.sort_array(F.collect_list("_v")).alias("_s"))
    found = [F.max(F.when((r >= first) & (r < F.col("_upto")), F.get("_s", (r - first).cast("int")))).alias(f"_{e}_{name}") for name, at in spots.items() for e, r in (("low", F.floor(at)), ("high", F.ceil(at)))]
    joined = hits.select(*by, "_total").distinct().join(inside.groupBy(*by).agg(*found), by, "left")
    out = []
    for name, at in spots.items():
        low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        out.append(F.when(F.floor(at) == F.ceil(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(name))
    return joined.select(*by, *out)


def with_distinct(groups: DataFrame, df: DataFrame, by: list[str], columns: dict[str, Column]) -> DataFrame:
    """groups, one row per value of by, with the number of distinct values of Columns of df.

    Counted in a pass of its own: beside other aggregates Spark keeps the state of each of them, summaries for
    quantiles too, once per group and distinct value.
    """
    for name, c in columns.items():
        counts = df.groupBy(*[F.col(k).alias(f"_g_{k}") for k in by]).agg(F.countDistinct(c).alias(name))
        same = F.lit(True)
        for k in by:
            same = same & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
        groups = groups.join(counts, same).drop(*[f"_g_{k}" for k in by])
    return groups


def quantile(df: DataFrame, value: Column, q: float | list[float]):
    """The exact quantile, or list of quantiles, of a whole column; None without values."""
    if isinstance(q, list):
        return _many(df, value, q)
    found = quantiles(df, [], {"q": (value, q)}, digits=None).first()
    return found["q"] if found is not None else None


def _many(df: DataFrame, value: Column, shares: list[float]) -> list[float | None]:
    """Quantiles at many shares, from the running counts of the distinct values, which are made range by range."""
    from lodemark.session import checkpointed

    from .windows import running_counts

    counts = checkpointed(running_counts(df.select(value.cast("double").alias("_v")), "_v"))
    total = counts.agg(F.max("upto")).first()[0]
    if not total:
        return [None] * len(shares)
    spots = [q * (total - 1) for q in shares]
    ranks = sorted({int(f(x)) for x in spots for f in (math.floor, math.ceil)})
    # Two values a share at most come to the driver.
    hit = F.exists(F.lit(ranks).cast("array<long>"), lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto")))
    rows = sorted((r["upto"], r["_v"]) for r in counts.where(hit).select("_v", "upto").collect())
    upto = [u for u, _ in rows]

    def of(rank: int) -> float:
        return rows[bisect_right(upto, rank)][1]

    return [of(math.floor(x)) if x == math.floor(x) else (math.ceil(x) - x) * of(math.floor(x)) + (x - math.floor(x)) * of(math.ceil(x)) for x in spots]


def weighted_median(df: DataFrame, by: list[str], value: Column, weight: Column, name: str = "median", persisted: bool = False) -> DataFrame:
    """The lower weighted median per group.

    A pass cuts each group's range into CELLS, narrow near the middle and wide in the tails, adds up their weights and
    goes on with the cell that holds the median, until WHOLE values or fewer are left in it; equal values of those are added up and
    summed in order. Tells no group's values apart but those of its last cell. Values and weights that are missing
    or NaN do not count; infinite values have cells of their own at both ends.
    """
    from lodemark.session import checkpointed

    by = list(by)
    rows = df.select(*by, value.cast("double").alias("_v"), weight.cast("double").alias("_w")).where(F.col("_v").isNotNull() & F.col("_w").isNotNull() & ~F.isnan("_v") & ~F.isnan("_w"))
    if _largest(df, by) <= DIRECT:
        w = Window.partitionBy(*by)
        sums = rows.groupBy(*by, "_v").agg(F.sum("_w").alias("_vw"))
        run = sums.select(*by, "_v", F.sum("_vw").over(w).alias("_total"), F.sum("_vw").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"))
        return run.where(F.col("_upto") >= 0.5 * F.col("_total")).groupBy(*by).agg(F.min("_v").alias(name))
    if not persisted:
        rows = rows.persist()
    try:
        first = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("_total"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.percentile_approx("_v", [0.25, 0.5, 0.75], 1000).alias("_p"))
        spread = F.get("_p", 2) - F.get("_p", 0)
        scale = F.when((spread > 0) & (spread < _LARGEST), spread).otherwise(F.lit(1.0))
        state = checkpointed(first.withColumns({"_below": F.lit(0.0), "_m": F.col("n"), "_at": F.get("_p", 1), "_scale": scale}).drop("_p"))
        narrow = ["n", "_low", "_high", "_m", "_at", "_scale"]
        while True:
            large = (F.col("_m") > WHOLE) & (F.col("_low") < F.col("_high"))
            if not state.where(large).limit(1).count():
                break
            inside = beside(rows, state.where(large).select(*by, *narrow), by).where(F.col("_v").between(F.col("_low"), F.col("_high")))
            def scaled(v: Column) -> Column:
                z = F.least(F.greatest((v - F.col("_at")) / F.col("_scale"), F.lit(-_LARGEST)), F.lit(_LARGEST))
                return F.signum(z) * F.log1p(F.abs(z))

            low, high = scaled(F.greatest(F.col("_low"), F.lit(-_LARGEST))), scaled(F.least(F.col("_high"), F.lit(_LARGEST)))
            # Where the scale cannot tell the ends apart, their own middle does.
            inner = F.greatest(F.least(F.floor((scaled(F.col("_v")) - low) / (high - low) * CELLS), F.lit(CELLS - 1)), F.lit(0))
            halves = F.when(F.col("_v") / 2 > F.greatest(F.col("_low"), F.lit(-_LARGEST)) / 4 + F.least(F.col("_high"), F.lit(_LARGEST)) / 4, 1).otherwise(0)
            cell = F.when(F.col("_v") > _LARGEST, CELLS).when(F.col("_v") < -_LARGEST, -1).when(low < high, inner).otherwise(halves)
            cells = inside.groupBy(*by, cell.alias("_cell")).agg(F.sum("_w").alias("_cw"), F.count(F.lit(1)).alias("_cm"), F.min("_v").alias("_cl"), F.max("_v").alias("_ch"))
            # CELLS rows a group at most.
            upto = F.sum("_cw").over(Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
            run = beside(cells.select("*", upto.alias("_upto")), state, by).where(F.col("_below") + F.col("_upto") >= 0.5 * F.col("_total"))
            hit = run.groupBy(*by, "n", "_total", "_at", "_scale").agg(F.min_by(F.struct("_cl", "_ch", "_cm", (F.col("_below") + F.col("_upto") - F.col("_cw")).alias("_b")), "_cell").alias("_h"))
            fresh = hit.select(*by, "n", "_total", "_at", "_scale", F.col("_h._cl").alias("_low"), F.col("_h._ch").alias("_high"), F.col("_h._b").alias("_below"), F.col("_h._cm").alias("_m"))
            state = checkpointed(state.where(~large).unionByName(fresh))
        left = beside(rows, state.select(*by, "n", "_low", "_high"), by).where(F.col("_v").between(F.col("_low"), F.col("_high")))
        distinct = left.groupBy(*by, "_v").agg(F.sum("_w").alias("_vw"))
        upto = F.sum("_vw").over(Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
        run = beside(distinct.select("*", upto.alias("_upto")), state, by)
        return checkpointed(run.where(F.col("_below") + F.col("_upto") >= 0.5 * F.col("_total")).groupBy(*by).agg(F.min("_v").alias(name)))
    finally:
        if not persisted:
            rows.unpersist()


def lad_slope(df: DataFrame, by: list[str], x: Column, y: Column, name: str = "slope", persisted: bool = False) -> DataFrame:
    """Least absolute deviation slope through the origin: the |x|-weighted median of y/x; x = 0 is inert."""
    return weighted_median(df.where(x != 0), by, F.try_divide(y, x), F.abs(x), name, persisted)
