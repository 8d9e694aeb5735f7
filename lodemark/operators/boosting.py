"""Gradient-boosted trees on feature histograms, many models in the same passes.

Features become at most 255 bins each, from one quantile pass; rows become blocks of bytes (bins, label, scores). A pass
adds up the gradients of every model, open leaf, feature and bin in each task and sums them with a groupBy; what
reaches the driver are those sums, whose number does not grow with the rows. Missing values have a bin of their own that
goes to the better side, categories are split into the subset that the order of their mean gradients gives. Absolute
error takes the median of its rows as a leaf's value, squared error the mean. All models take their passes together, so
thirteen fits need no more jobs than one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemark.session import discard, stored

#: Bins of values; the bin after them holds missing values.
MISSING = 255
#: Cells that residuals are counted in for the medians of leaves, half of them on each side of zero and narrower near it.
CELLS = 4096
#: Rounds after which the trees grown so far are added to the stored scores; walking them in each pass costs more than to write often.
REFRESH = 3


@dataclass(frozen=True)
class Spec:
    """One model: its features and its loss, "l1" or "l2"."""

    name: str
    features: tuple[str, ...]
    loss: str = "l1"


@dataclass(frozen=True)
class Bins:
    """Numeric features by upper edges of their bins, categories by their list of values; in order of the columns."""

    edges: dict[str, list[float]]
    categories: dict[str, list[str]]

    @property
    def names(self) -> list[str]:
        return [*self.edges, *self.categories]

    def coded(self, batch: pa.RecordBatch) -> np.ndarray:
        """Bins of a batch that has the features as columns: one row a feature."""
        out = np.full((len(self.names), batch.num_rows), MISSING, np.uint8)
        for k, (name, edges) in enumerate(self.edges.items()):
            column = batch.column(name)
            known = column.is_valid().to_numpy(zero_copy_only=False)
            values = column.fill_null(0.0).to_numpy(zero_copy_only=False)
            known &= ~np.isnan(values)
            out[k, known] = np.searchsorted(np.array(edges), values[known], side="left")
        for k, (name, levels) in enumerate(self.categories.items(), len(self.edges)):
            at = pa.compute.index_in(batch.column(name), value_set=pa.array(levels, pa.string()))
            known = at.is_valid().to_numpy(zero_copy_only=False)
            out[k, known] = at.drop_null().to_numpy(zero_copy_only=False)
        return out


def make_bins(df: DataFrame, features: dict[str, Column], categories: dict[str, list[str]], most: int = MISSING) -> Bins:
    """Bins of about equal counts, one for each value where there are few of them; a single pass."""
    shares = [k / most for k in range(most)]
    found = df.agg(*[F.percentile_approx(F.when(~F.isnan(c.cast("double")), c.cast("double")), shares, 100 * most).alias(n) for n, c in features.items()]).first()
    edges = {n: sorted(set(found[n] or []))[: most - 1] for n in features}
    if any(len(levels) >= MISSING for levels in categories.values()):
        raise ValueError(f"at most {MISSING - 1} categories")
    return Bins(edges, {n: list(map(str, levels)) for n, levels in categories.items()})


@dataclass
class Tree:
    """Inner nodes with the bins that go left; a child below zero is leaf ~child."""

    feature: list[int] = field(default_factory=list)
    left: list[bytes] = field(default_factory=list)  # 256 bits a node
    children: list[list[int]] = field(default_factory=list)
    root: int = -1
    values: list[float] = field(default_factory=lambda: [0.0])
    _tables: tuple | None = field(default=None, repr=False, compare=False)  # of _coded_leaves, until the next split

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every column of bins."""
        if not self.feature:
            return np.full(bins.shape[1], ~self.root, np.int64)
        if len(self.feature) <= 8:
            return self._coded_leaves(bins)
        at = np.full(bins.shape[1], self.root, np.int64)
        feature, children = np.array(self.feature), np.array(self.children)
        table = np.unpackbits(np.frombuffer(b"".join(self.left), np.uint8).reshape(-1, 32), axis=1).astype(bool)
        going = np.flatnonzero(at >= 0)
        while len(going):
            node = at[going]
            left = table[node, bins[feature[node], going]]
            at[going] = children[node, np.where(left, 0, 1)]
            going = going[at[going] >= 0]
        return ~at

    def _coded_leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaves of a tree of at most eight nodes: a bit a node that a bin goes left at, then the leaf of those bits, both by byte tables."""
        if self._tables is None:
            sides = [(np.unpackbits(np.frombuffer(left, np.uint8)) << k).astype(np.uint8).tobytes() for k, left in enumerate(self.left)]
            ends = bytearray(256)
            for bits in range(1 << len(sides)):
                at = self.root
                while at >= 0:
                    at = self.children[at][0 if bits >> at & 1 else 1]
                ends[bits] = ~at
            self._tables = sides, bytes(ends)
        sides, ends = self._tables
        bits = np.zeros(bins.shape[1], np.uint8)
        for f, side in zip(self.feature, sides, strict=True):
            bits |= np.frombuffer(bins[f].tobytes().translate(side), np.uint8)
        return np.frombuffer(bits.tobytes().translate(ends), np.uint8)

    def split(self, leaf: int, feature: int, left: np.ndarray) -> tuple[int, int]:
        """Makes a leaf an inner node; its left child keeps the leaf's number."""
        self._tables = None
        node, fresh = len(self.feature), len(self.values)
        self.feature.append(feature)
        self.left.append(np.packbits(left).tobytes())
        for pair in self.children:
            for side in (0, 1):
                if pair[side] == ~leaf:
                    pair[side] = node
        if self.root == ~leaf:
            self.root = node
        self.children.append([~leaf, ~fresh])
        self.values.append(0.0)
        return leaf, fresh


@dataclass
class Boosted:
    """A fitted model: start, trees, and for each feature the gain that its splits brought."""

    spec: Spec
    bins: Bins
    start: float
    trees: list[Tree] = field(default_factory=list)
    gains: dict[str, float] = field(default_factory=dict)
    losses: list[float] = field(default_factory=list)  # of the rows held back, after 0, 1, ... rounds

    @property
    def best_round(self) -> int:
        return int(np.argmin(self.losses)) if self.losses else len(self.trees)

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return _added(np.full(bins.shape[1], self.start), self.trees, bins)


def _added(scores: np.ndarray, trees: list[Tree], bins: np.ndarray) -> np.ndarray:
    for tree in trees:
        scores = scores + np.array(tree.values)[tree.leaves(bins)]
    return scores


def best_split(gradient: np.ndarray, count: np.ndarray, category: bool, least: int, smooth: float = 10.0) -> tuple[float, np.ndarray] | None:
    """The largest gain of one feature's histogram (256 sums) and the bins that go left; None if no split leaves `least` rows on both sides."""
    g, n = gradient[:MISSING], count[:MISSING]
    order = np.flatnonzero(n > 0)
    if category:
        order = order[np.argsort(g[order] / (n[order] + smooth), kind="stable")]
    total_g, total_n = gradient.sum(), count.sum()
    if not total_n or not len(order):
        return None
    base, best = total_g**2 / total_n, None
    sums_g, sums_n = np.cumsum(g[order]), np.cumsum(n[order])
    for with_missing in (False, True) if count[MISSING] else (False,):
        left_g, left_n = sums_g + gradient[MISSING] * with_missing, sums_n + count[MISSING] * with_missing
        right_n = total_n - left_n
        fits = (left_n >= max(least, 1)) & (right_n >= max(least, 1))
        if not fits.any():
            continue
        gain = np.where(fits, left_g**2 / np.maximum(left_n, 1) + (total_g - left_g) ** 2 / np.maximum(right_n, 1) - base, -np.inf)
        k = int(np.argmax(gain))
        if best is None or gain[k] > best[0]:
            left = np.zeros(256, bool)
            if category:
                left[order[: k + 1]] = True
            else:
                left[: order[k] + 1] = True  # bins between two values go with the lower one
            left[MISSING] = with_missing
            best = (float(gain[k]), left)
    return best


def _blocks(df: DataFrame, bins: Bins, features: dict[str, Column], label: Column, key: str, held_of: int) -> DataFrame:
    """Blocks of rows: bins, label, held. Rows without a label are left out; a hash of the key holds one in `held_of` back."""
    columns = [features[n].cast("double").alias(n) for n in bins.edges] + [features[n].cast("string").alias(n) for n in bins.categories]
    held = (F.pmod(F.xxhash64(key), F.lit(held_of)) == 0).alias("_held")
    rows = df.select(*columns, label.cast("double").alias("_y"), held).where(F.col("_y").isNotNull() & ~F.isnan("_y"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                y, held = batch.column("_y").to_numpy(), batch.column("_held").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (bins.coded(batch), y, held)], ["bins", "y", "held"])

    return rows.mapInArrow(run, "bins binary, y binary, held binary")


def _arrays(batch: pa.RecordBatch, features: int, models: int):
    """bins, label, held and scores of each block."""
    for k in range(batch.num_rows):
        raw = [np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in enumerate((np.uint8, np.float64, bool))]
        n = len(raw[1])
        scores = np.frombuffer(batch.column(3)[k].as_buffer(), np.float64).reshape(models, n) if batch.num_columns > 3 else None
        yield raw[0].reshape(features, n), raw[1], raw[2], scores


class _Passes:
    """The rows in blocks, with the models' scores, and the passes over them."""

    def __init__(self, blocks: DataFrame, starts: np.ndarray, features: int, all_rows: bool):
        self.spark, self.features, self.models, self.all_rows = blocks.sparkSession, features, len(starts), all_rows
        self.blocks, self.path = None, None
        self._store(blocks, lambda bins, scores: np.repeat(starts[:, None], bins.shape[1], axis=1))

    def _store(self, blocks: DataFrame, make) -> None:
        features, models = self.features, self.models

        def run(batches):
            for batch in batches:
                for k, (bins, _, _, scores) in enumerate(_arrays(batch, features, models)):
                    row = batch.slice(k, 1)
                    yield pa.RecordBatch.from_arrays([*row.columns[:3], pa.array([make(bins, scores).tobytes()], pa.binary())], ["bins", "y", "held", "scores"])

        # Read from their files in every pass: kept in memory they would take it from the tasks, by thirteen scores a row.
        old_path = self.path
        self.blocks, self.path = stored(blocks.mapInArrow(run, "bins binary, y binary, held binary, scores binary"), large_rows=True)
        if old_path is not None:
            discard(self.spark, old_path)

    def add(self, pending: list[list[Tree]]) -> None:
        """Adds the trees of each model to the stored scores."""
        self._store(self.blocks, lambda bins, scores: np.stack([_added(s, t, bins) for s, t in zip(scores, pending, strict=True)]))

    def close(self) -> None:
        discard(self.spark, self.path)

    def sums(self, pending: list[list[Tree]], visit, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums and counts by place. visit(bins, y, held, scores, model) gives for each block and model (first place, sums, counts) of places in a row."""
        sent = self.spark.sparkContext.broadcast(cloudpickle.dumps((pending, visit)))
        features, models, all_rows = self.features, self.models, self.all_rows

        def run(batches):
            pending, visit = cloudpickle.loads(sent.value)
            total, count = np.zeros(size), np.zeros(size)
            for batch in batches:
                for bins, y, held, scores in _arrays(batch, features, models):
                    for m in range(models):
                        for first, sums, counts in visit(bins, y, held & (not all_rows), scores[m], pending[m], m):
                            total[first : first + len(sums)] += sums
                            count[first : first + len(sums)] += counts
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at]), pa.array(count[at].astype(np.int64))], ["place", "total", "n"])

        found = self.blocks.mapInArrow(run, "place long, total double, n long").groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
        sent.unpersist()
        total, count = np.zeros(size), np.zeros(size)
        place = found["place"].to_numpy()
        total[place], count[place] = found["total"].to_numpy(), found["n"].to_numpy()
        return total, count


def _counted(at: np.ndarray, values: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts by place."""
    return np.bincount(at, values, places), np.bincount(at, minlength=places)


def _residual_cells(r: np.ndarray, reach: float) -> np.ndarray:
    return np.clip((np.sign(r) * np.sqrt(np.abs(r) / reach) * (CELLS / 2) + CELLS / 2).astype(np.int64), 0, CELLS - 1)


def _grow(passes: _Passes, specs: list[Spec], bins: Bins, going: list[int], pending: list[list[Tree]], reach: float, depth: int, leaves: int, least: int, rate: float):
    """One tree of every model that is going; returns the trees, the gains by feature and the held-back loss before them."""
    names, m_count = bins.names, len(specs)
    used = [[names.index(f) for f in s.features] for s in specs]
    trees = {m: Tree() for m in going}
    open_leaves = {m: [0] for m in going}
    sums: dict[int, dict[int, tuple[float, float]]] = {m: {} for m in going}
    gains = {m: {} for m in going}
    loss = None
    for level in range(depth):
        # Places: the held-back losses first, then (model, feature, leaf, bin).
        slots = {m: {leaf: k for k, leaf in enumerate(open_leaves[m])} for m in going}
        base, at = {}, m_count
        for m in going:
            base[m] = at
            at += len(slots[m]) * len(used[m]) * 256
        if at == m_count:
            break

        def visit(b, y, held, scores, grown, m, trees=trees, slots=slots, base=base, level=level):
            if m not in trees:
                return
            error = _added(scores, grown, b) - y
            absolute = specs[m].loss == "l1"
            if level == 0 and held.any():
                yield m, *_counted(np.zeros(int(held.sum()), np.int64), np.abs(error[held]) if absolute else error[held] ** 2, 1)
            # Rows of closed leaves and those held back have a slot of their own behind the others.
            width = len(slots[m])
            slot_of = np.full(len(trees[m].values), width)
            for leaf, k in slots[m].items():
                slot_of[leaf] = k
            slot = slot_of[trees[m].leaves(b)]
            slot[held] = width
            if absolute:  # signs are counted
                wide = (slot * 3 + (error > 0) + 2 * (error < 0)) * 256
            else:
                wide = slot * 256
            for k, f in enumerate(used[m]):
                if absolute:
                    none, more, less = np.bincount(wide + b[f], minlength=(width + 1) * 768).reshape(-1, 3, 256)[:width].transpose(1, 0, 2).reshape(3, -1)
                    yield base[m] + k * width * 256, more - less, none + more + less
                else:
                    sums, counts = _counted(wide + b[f], error, (width + 1) * 256)
                    yield base[m] + k * width * 256, sums[: width * 256], counts[: width * 256]

        total, count = passes.sums(pending, visit, at)
        if level == 0:
            loss = {m: total[m] / count[m] for m in going if count[m]}
        for m in going:
            size = len(slots[m]) * len(used[m]) * 256
            g, n = (x[base[m] : base[m] + size].reshape(len(used[m]), len(slots[m]), 256).transpose(1, 0, 2) for x in (total, count))
            choices = []
            for leaf, k in slots[m].items():
                sums[m][leaf] = (g[k, 0].sum(), n[k, 0].sum())
                found = [(s[0], i, s[1]) for i, f in enumerate(used[m]) if (s := best_split(g[k, i], n[k, i], names[f] in bins.categories, least)) is not None and s[0] > 1e-12]
                if found:
                    gain, i, left = max(found, key=lambda x: (x[0], -x[1]))
                    choices.append((gain, leaf, i, left, k))
            fresh = []
            for gain, leaf, i, left, k in sorted(choices, key=lambda c: (-c[0], c[1])):
                if len(trees[m].values) >= leaves:
                    break
                pair = trees[m].split(leaf, used[m][i], left)
                for side, child in zip((left, ~left), pair, strict=True):
                    sums[m][child] = (g[k, i][side].sum(), n[k, i][side].sum())
                gains[m][names[used[m][i]]] = gains[m].get(names[used[m][i]], 0.0) + gain
                fresh += pair
            open_leaves[m] = fresh
    for m in going:
        trees[m].values = [-rate * g / n if n else 0.0 for g, n in (sums[m].get(k, (0.0, 0.0)) for k in range(len(trees[m].values)))]
    absolute = [m for m in going if specs[m].loss == "l1"]
    if absolute:
        base, at = {}, 0
        for m in absolute:
            base[m] = at
            at += len(trees[m].values) * CELLS

        def visit_leaves(b, y, held, scores, grown, m):
            if m in base:
                r = (y - _added(scores, grown, b))[~held]
                yield base[m], *_counted(trees[m].leaves(b)[~held].astype(np.int64) * CELLS + _residual_cells(r, reach), r, len(trees[m].values) * CELLS)

        total, count = passes.sums(pending, visit_leaves, at)
        for m in absolute:
            n = count[base[m] : base[m] + len(trees[m].values) * CELLS].reshape(-1, CELLS)
            r = total[base[m] : base[m] + len(trees[m].values) * CELLS].reshape(-1, CELLS)
            middle = np.argmax(np.cumsum(n, axis=1) * 2 >= n.sum(axis=1, keepdims=True), axis=1)
            k = np.arange(len(n))
            trees[m].values = [float(v) for v in rate * r[k, middle] / np.maximum(n[k, middle], 1)]
    return trees, gains, loss


def _boost(blocks: DataFrame, bins: Bins, specs: list[Spec], rounds: list[int], stop: int | None, all_rows: bool, depth: int, leaves: int, least: int, rate: float) -> list[Boosted]:
    """Every model for its number of rounds, or until its held-back loss has not improved for `stop` rounds."""
    features = len(bins.names)
    starts, low, high = _starts(blocks, features, all_rows)
    passes = _Passes(blocks, np.array([starts[s.loss] for s in specs]), features, all_rows)
    models = [Boosted(s, bins, starts[s.loss]) for s in specs]
    pending: list[list[Tree]] = [[] for _ in specs]
    grown_up: set[int] = set()  # models whose last tree found nothing to split
    try:
        for k in range(max(rounds, default=0) + (not all_rows)):
            going = [m for m in range(len(specs)) if m not in grown_up and k < rounds[m] + (not all_rows) and not (stop and models[m].losses and len(models[m].losses) - 1 - models[m].best_round >= stop)]
            if not going:
                break
            last = [m for m in going if k == rounds[m]]  # their loss is all that is left to know
            trees, gains, loss = _grow(passes, specs, bins, going, pending, max(high - low, 1e-9), depth if len(last) < len(going) else 1, leaves, least, rate)
            for m in going:
                if loss and m in loss:
                    models[m].losses.append(float(loss[m]))
                if m in last:
                    continue
                if not trees[m].feature:
                    grown_up.add(m)
                    continue
                models[m].trees.append(trees[m])
                pending[m].append(trees[m])
                for f, g in gains[m].items():
                    models[m].gains[f] = models[m].gains.get(f, 0.0) + g
            if (k + 1) % REFRESH == 0:
                passes.add(pending)
                pending = [[] for _ in specs]
    finally:
        passes.close()
    return models


def _starts(blocks: DataFrame, features: int, all_rows: bool) -> tuple[dict[str, float], float, float]:
    """The median and the mean of the labels, and their range."""
    from .quantiles import quantiles

    def run(batches):
        for batch in batches:
            for _, y, held, _ in _arrays(batch, features, 0):
                yield pa.RecordBatch.from_arrays([pa.array(y if all_rows else y[~held])], ["y"])

    y = blocks.mapInArrow(run, "y double")
    found = quantiles(y, [], {"m": (F.col("y"), 0.5)}, [F.avg("y").alias("a"), F.min("y").alias("low"), F.max("y").alias("high")], digits=None).first()
    if found is None:
        return {"l1": 0.0, "l2": 0.0}, 0.0, 0.0
    return {"l1": found["m"], "l2": found["a"]}, found["low"], found["high"]


def fit_boosted(
    df: DataFrame, specs: list[Spec], features: dict[str, Column], categories: dict[str, list[str]], label: Column, key: str, rounds: int = 3000, stop: int = 100,
    depth: int = 6, leaves: int = 63, least: int = 50, rate: float = 0.05, held_of: int = 10,
) -> dict[str, Boosted]:
    """Boosted trees of every spec. features: all numeric ones and categories by name; categories: the levels of the latter.

    One row in `held_of`, by a hash of key, is held back; a model stops when its loss there has not improved for `stop`
    rounds and is then fitted again on all rows for its best number of rounds.
    """
    numeric = {n: c for n, c in features.items() if n not in categories}
    bins = make_bins(df, numeric, categories)
    blocks, path = stored(_blocks(df, bins, features, label, key, held_of), large_rows=True)
    try:
        probes = _boost(blocks, bins, specs, [rounds] * len(specs), stop, False, depth, leaves, least, rate)
        final = _boost(blocks, bins, specs, [p.best_round for p in probes], None, True, depth, leaves, least, rate)
    finally:
        discard(df.sparkSession, path)
    for probe, model in zip(probes, final, strict=True):
        model.losses = probe.losses
    return {m.spec.name: m for m in final}


def predict_boosted(df: DataFrame, models: dict[str, Boosted], features: dict[str, Column], low: float = 0.0, high: float = 50.0) -> DataFrame:
    """df with a column for every model's prediction, within low .. high."""
    if not models:
        return df
    bins = next(iter(models.values())).bins
    sent = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(models))
    named = [f"_f{k}" for k in range(len(bins.names))]
    columns = [features[n].cast("string" if n in bins.categories else "double").alias(a) for n, a in zip(bins.names, named, strict=True)]
    width = len(df.columns)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{m}` double" for m in models)])

    def run(batches):
        own = cloudpickle.loads(sent.value)
        for batch in batches:
            coded = bins.coded(pa.RecordBatch.from_arrays(batch.columns[width:], bins.names))
            found = [pa.array(np.clip(m.scores(coded), low, high)) for m in own.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *found], [*batch.schema.names[:width], *own])

    return df.select("*", *columns).mapInArrow(run, schema)


#: The feature set of the benchmark, what each ablation leaves out, and the single-signal models.
FEATURES = ("sv_image_y", "sv_norm", "canvas_x", "canvas_y", "zoom", "label_type", "heading", "pitch", "pano_height")
DROPS = {
    "sv_image_y": ("sv_image_y",), "sv_norm": ("sv_norm",), "canvas": ("canvas_x", "canvas_y"), "zoom": ("zoom",), "label_type": ("label_type",),
    "heading_pitch": ("heading", "pitch"), "pano_height": ("pano_height",),
}
ALONE = {"only_sv_image_y": ("sv_image_y",), "only_canvas": ("canvas_x", "canvas_y"), "only_depression": ("depression",)}


def benchmark_specs() -> list[Spec]:
    """The thirteen models: three with all features, three with one signal each, seven with one group left out."""
    main = [Spec("gbm_l1", FEATURES, "l1"), Spec("gbm_l2", FEATURES, "l2"), Spec("gbm_dep_l1", (*FEATURES, "depression"), "l1")]
    return [*main, *(Spec(n, f) for n, f in ALONE.items()), *(Spec(f"drop_{n}", tuple(f for f in FEATURES if f not in out)) for n, out in DROPS.items())]


def benchmark_features(depression: Column) -> dict[str, Column]:
    """The benchmark's columns over clicks: the normalised row is missing where the panorama's height is."""
    plain = {n: F.col(n) for n in FEATURES if n != "sv_norm"}
    return plain | {"sv_norm": F.col("sv_image_y") * 6656.0 / F.col("pano_height"), "depression": depression}
