"""Gradient boosting of conditional quantiles by histograms, as passes of Spark over one binned table.

All models (a target, a level, an end of the training time) grow in the same passes. A pass sends counts, never rows: by
(model, node, feature, bin) to find splits, by (model, leaf, cell) to find the exact quantile of a leaf. Splits depend on
whole numbers alone, so neither the partitioning nor a repeated task changes a tree. What the driver holds is bounded by
the settings (models x rounds x leaves), not by the data.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.places import quantiles
from ..sources.shared import kept

#: Cells that a pass cuts the range of a leaf's residuals into; a range of at most KEEP rows is gathered and sorted;
#: rounds between two checkpoints of the predictions.
CELLS, KEEP, EVERY = 256, 256, 10


@dataclass(frozen=True)
class Settings:
    """Rounds, learning rate, depth, fewest rows of a leaf, l2 of the gain, share of the features a node looks at, bins."""

    rounds: int = 80
    rate: float = 0.03
    depth: int = 2
    least: int = 250
    ridge: float = 20.0
    share: float = 0.4
    bins: int = 64
    seed: int = 20260828


@dataclass
class Model:
    """One learned quantile: its target, level, last training time (None: all), first prediction and trees.

    A tree is (splits by (depth, node): (feature, bin), leaf values); rows of bins up to `bin` go to node * 2, others to
    node * 2 + 1, and all to node * 2 where there is no split."""

    target: str
    level: float
    until: float | None = None
    base: float | None = None
    trees: list[tuple[dict, np.ndarray]] = field(default_factory=list)


@dataclass
class Fitted:
    features: list[str]
    cuts: list[np.ndarray]
    settings: Settings
    models: list[Model]


def looked_at(settings: Settings, features: int, model: Model, turn: int, depth: int, node: int) -> list[int]:
    """The seeded choice of features that a node may split by."""
    name = f"{settings.seed}:{model.target}:{model.level}:{model.until}:{turn}:{depth}:{node}"
    order = sorted(range(features), key=lambda j: (zlib.crc32(f"{name}:{j}".encode()), j))
    return sorted(order[: max(1, math.ceil(settings.share * features))])


def _nodes(x: np.ndarray, splits: dict, depth: int) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    for d in range(depth):
        right = np.zeros(len(x), np.int64)
        for (level, node), (j, b) in splits.items():
            if level == d:
                right |= (at == node) & (x[:, j] > b)
        at = 2 * at + right
    return at


def _cells(r: np.ndarray, low: float, high: float) -> np.ndarray:
    """The cell of each residual between low and high; it never falls as the residual grows."""
    if high <= low:
        return np.zeros(len(r), np.int64)
    return np.minimum(((r - low) / (high - low) * CELLS).astype(np.int64), CELLS - 1)


def cut_points(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Ascending exact quantiles of every feature, at most bins - 1 of each; a value belongs to the first that it does not pass."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(j).alias("feature"), F.col(f).cast("double").alias("value")) for j, f in enumerate(features)])).alias("_"))
    got = quantiles(long.select("_.*"), ["feature"], "value", [i / bins for i in range(1, bins)]).collect()
    return [np.unique([r.quantile for r in got if r.feature == j]) for j in range(len(features))]


def _binned(values: list[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, v, "left") for v, c in zip(values, cuts)], axis=1).astype(np.uint8)


def _matrix(column: pa.ChunkedArray, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


class _Grower:
    """The binned table, the models so far, and the passes that let them grow by a round."""

    def __init__(self, rows: DataFrame, time: str, features: list[str], models: list[Model], settings: Settings, cuts):
        self.features, self.models, self.settings, self.cuts = features, models, settings, cuts
        self.targets = sorted({m.target for m in models})
        targets, width = self.targets, len(models)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _binned([b.column(i).to_numpy(zero_copy_only=False) for i in range(len(features))], cuts)
                y = np.stack([b.column(len(features) + i).to_numpy(zero_copy_only=False) for i in range(len(targets))], axis=1)
                f = np.zeros(width).tobytes()
                yield pa.RecordBatch.from_arrays([b.column(b.num_columns - 1), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in y], pa.binary()), pa.array([f] * len(x), pa.binary())], names=["time", "x", "y", "f"])

        d = rows.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate([*features, *targets])], F.col(time).cast("double").alias("_t"))
        self.table = kept(d.mapInArrow(pack, "time double, x binary, y binary, f binary"))
        self.pending: list[list] = []

    def batches(self) -> Callable[[pa.RecordBatch], tuple]:
        """What reads a batch: (x, y by model, predictions by model, training rows by model), pending trees applied."""
        pending, depth = self.pending, self.settings.depth
        k, t, m = len(self.features), len(self.targets), len(self.models)
        which = [self.targets.index(a.target) for a in self.models]
        until = [math.inf if a.until is None else a.until for a in self.models]

        def read(b: pa.RecordBatch):
            x, y, f = _matrix(b.column("x"), np.uint8, k), _matrix(b.column("y"), np.float64, t), _matrix(b.column("f"), np.float64, m).copy()
            time = b.column("time").to_numpy(zero_copy_only=False)
            for step in pending:
                for i, (splits, values) in enumerate(step):
                    f[:, i] += values[_nodes(x, splits, depth)] if splits else values[0]
            return x, y[:, which], f, [(time <= u) & ~np.isnan(y[:, w]) for u, w in zip(until, which)]

        return read

    def level(self, turn: int, depth: int, splits: list[dict]) -> dict:
        """(model, node): (feature, bin, rows left, rows right, least and largest residual) of the best split of each node."""
        s, models, k = self.settings, self.models, len(self.features)
        looked = {(i, v): looked_at(s, k, m, turn, depth, v) for i, m in enumerate(models) for v in range(2**depth)}
        read, bins = self.batches(), s.bins

        def count(batches):
            n, low, span = {}, {}, {}
            for b in batches:
                x, y, f, mine = read(b)
                for i in range(len(models)):
                    at = _nodes(x, splits[i], depth)
                    r = y[:, i] - f[:, i]
                    for v in range(2**depth):
                        rows = np.flatnonzero(mine[i] & (at == v))
                        if not len(rows):
                            continue
                        a, c = span.get((i, v), (math.inf, -math.inf))
                        span[i, v] = min(a, r[rows].min()), max(c, r[rows].max())
                        below = rows[r[rows] <= 0]
                        for j in looked[i, v]:
                            n[i, v, j] = n.get((i, v, j), 0) + np.bincount(x[rows, j], minlength=bins)
                            low[i, v, j] = low.get((i, v, j), 0) + np.bincount(x[below, j], minlength=bins)
            out = [(i, v, j, int(b), int(c[b]), int(low[i, v, j][b]), *map(float, span[i, v])) for (i, v, j), c in n.items() for b in np.flatnonzero(c)]
            yield _batch(out, "model node feature bin", "n low", "least most")

        d = self.table.mapInArrow(count, "model int, node int, feature int, bin int, n long, low long, least double, most double")
        d = d.repartition("model", "node", "feature").groupBy("model", "node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.min("least").alias("least"), F.max("most").alias("most"))
        w = Window.partitionBy("model", "node", "feature")
        upto = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        d = d.withColumns({"nl": F.sum("n").over(upto), "ll": F.sum("low").over(upto), "na": F.sum("n").over(w), "la": F.sum("low").over(w), "least": F.min("least").over(w), "most": F.max("most").over(w)})
        d = d.withColumns({"nr": F.col("na") - F.col("nl"), "lr": F.col("la") - F.col("ll"), "q": F.get(F.array(*[F.lit(m.level) for m in models]), F.col("model"))})
        force = lambda n, low: F.pow(F.col(low) * (1 - F.col("q")) - (F.col(n) - F.col(low)) * F.col("q"), F.lit(2.0)) / (F.col(n) + s.ridge)
        d = d.withColumn("gain", force("nl", "ll") + force("nr", "lr") - force("na", "la"))
        ok = (F.col("nl") >= s.least) & (F.col("nr") >= s.least) & (F.col("gain") > 0)
        best = F.max(F.when(ok, F.struct("gain", (-F.col("feature")).alias("j"), (-F.col("bin")).alias("b"), "nl", "nr"))).alias("best")
        got = d.groupBy("model", "node").agg(best, F.max("na").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).collect()  # a row a model and node
        return {(r.model, r.node): (None if r.best is None else (-r.best.j, -r.best.b, r.best.nl, r.best.nr), r.n, r.least, r.most) for r in got}

    def leaves(self, splits: list[dict], depth: int, sizes: dict, spans: dict) -> dict:
        """(model, leaf): the exact quantile of its residuals.

        Each pass counts the residuals of a leaf's range by cells, and the range shrinks to the cells that hold the wanted
        places, between their least and largest value, until few rows or one value are left; those are sorted."""
        out, wanted = {}, {}
        for key, n in sizes.items():
            place = self.models[key[0]].level * (n - 1)
            wanted[key] = dict(low=spans[key][0], high=spans[key][1], before=0, rows=n, first=math.floor(place), last=math.ceil(place), part=place - math.floor(place))
        while wanted:
            cells = {}
            for r in self._pass(splits, depth, wanted).collect():  # at most CELLS or KEEP rows a model and leaf
                cells.setdefault((r.model, r.leaf), []).append((r.cell, r.n, r.least, r.most))
            after = {}
            for key, w in wanted.items():
                ends = [None, None]
                before, upto = 0, w["before"]
                inside, low, high = 0, None, None
                for _, n, least, most in sorted(cells[key], key=lambda c: (c[0], c[2])):
                    if upto + n > w["first"] and upto <= w["last"]:
                        if low is None:
                            before, low = upto, least
                        inside, high = inside + n, most
                        for e, place in enumerate((w["first"], w["last"])):
                            if upto <= place < upto + n and least == most:
                                ends[e] = least
                    upto += n
                if None not in ends:
                    out[key] = ends[0] + (ends[1] - ends[0]) * w["part"]
                else:
                    after[key] = {**w, "low": low, "high": high, "before": before, "rows": inside}
            wanted = after
        return out

    def _pass(self, splits: list[dict], depth: int, wanted: dict) -> DataFrame:
        read = self.batches()
        asked: dict[int, list] = {}
        for (i, leaf), w in wanted.items():
            asked.setdefault(i, []).append((leaf, w["low"], w["high"], w["rows"] <= KEEP))

        def count(batches):
            found: dict = {}
            for b in batches:
                x, y, f, mine = read(b)
                for i, parts in asked.items():
                    at, r = _nodes(x, splits[i], depth), y[:, i] - f[:, i]
                    for leaf, low, high, few in parts:
                        v = np.sort(r[mine[i] & (at == leaf) & (r >= low) & (r <= high)])
                        starts = np.flatnonzero(np.diff(v if few else _cells(v, low, high), prepend=np.nan))
                        for a, e in zip(starts, [*starts[1:], len(v)]):
                            cell = 0 if few else int(_cells(v[a : a + 1], low, high)[0])
                            key = (i, leaf, cell, float(v[a]) if few else None)
                            n, least, most = found.get(key, (0, math.inf, -math.inf))
                            found[key] = n + int(e - a), min(least, float(v[a])), max(most, float(v[e - 1]))
            yield _batch([(i, leaf, cell, n, least, most, value) for (i, leaf, cell, value), (n, least, most) in found.items()], "model leaf cell", "n", "least most value")

        d = self.table.mapInArrow(count, "model int, leaf int, cell int, n long, least double, most double, value double")
        return d.groupBy("model", "leaf", "cell", "value").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))

    def start(self) -> None:
        """Every model's first prediction: the exact quantile of its training rows."""
        none = [{} for _ in self.models]
        first = self.level(-1, 0, none)
        got = self.leaves(none, 0, {k: v[1] for k, v in first.items()}, {k: v[2:] for k, v in first.items()})
        for i, m in enumerate(self.models):
            m.base = got.get((i, 0))
        self.pending = [[({}, np.array([m.base or 0.0])) for m in self.models]]

    def grow(self, turn: int) -> None:
        s = self.settings
        splits: list[dict] = [{} for _ in self.models]
        sizes, spans = {}, {}
        for d in range(s.depth):
            before, sizes, spans = sizes, {}, {}
            for (i, v), (best, n, low, high) in self.level(turn, d, splits).items():
                if best is not None:
                    splits[i][d, v] = best[:2]
                for child, size in ((2 * v, n if best is None else best[2]), (2 * v + 1, 0 if best is None else best[3])):
                    if size:
                        sizes[i, child], spans[i, child] = size, (low, high)
        got = self.leaves(splits, s.depth, sizes, spans)
        step = []
        for i, m in enumerate(self.models):
            values = np.array([s.rate * got.get((i, v), 0.0) for v in range(2**s.depth)])
            m.trees.append((splits[i], values))
            step.append((splits[i], values))
        self.pending = [*self.pending, step]
        if (turn + 1) % EVERY == 0:
            self.settle()

    def settle(self) -> None:
        """The predictions so far written into the table, so that a pass applies at most EVERY rounds of trees."""
        read = self.batches()

        def apply(batches):
            for b in batches:
                f = read(b)[2]
                yield pa.RecordBatch.from_arrays([b.column("time"), b.column("x"), b.column("y"), pa.array([r.tobytes() for r in f], pa.binary())], names=["time", "x", "y", "f"])

        self.table, self.pending = kept(self.table.mapInArrow(apply, self.table.schema)), []


def _batch(rows: list[tuple], ints: str, longs: str, doubles: str) -> pa.RecordBatch:
    names = [*ints.split(), *longs.split(), *doubles.split()]
    kinds = [pa.int32()] * len(ints.split()) + [pa.int64()] * len(longs.split()) + [pa.float64()] * len(doubles.split())
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def fit(rows: DataFrame, time: str, features: list[str], models: list[Model], settings: Settings = Settings()) -> Fitted:
    """The models, learned from the rows without null (or NaN) features; a null target leaves a row out of its models.

    Each model learns from its rows up to `until`. A model without any row has base None and predicts null. The
    histograms, cells and trees in one task or on the driver are bounded by models x nodes x features x bins."""
    if not 1 < settings.bins <= 256:
        raise ValueError("bins must lie between 2 and 256")
    whole = F.lit(True)
    for c in features:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows = kept(rows.where(whole).select(time, *dict.fromkeys([*features, *(m.target for m in models)])))
    cuts = cut_points(rows, features, settings.bins)
    models = [Model(m.target, m.level, m.until) for m in models]
    g = _Grower(rows, time, features, models, settings, cuts)
    g.start()
    for turn in range(settings.rounds):
        g.grow(turn)
    return Fitted(list(features), cuts, settings, models)


def predict(rows: DataFrame, fitted: Fitted, out: str = "predicted") -> DataFrame:
    """rows with `out`, the predictions of all models in order; null where a feature is null."""
    depth, schema = fitted.settings.depth, StructType([*rows.schema.fields, StructField(out, ArrayType(DoubleType()))])
    features, cuts, models = fitted.features, fitted.cuts, fitted.models
    values = F.array(*[F.col(c).cast("double") for c in features])
    d = rows.withColumn(out, F.when(F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v)), values))

    def apply(batches):
        for b in batches:
            at = b.num_columns - 1
            col = b.column(at)
            known = np.flatnonzero(col.is_valid().to_numpy(zero_copy_only=False))
            result: list = [None] * b.num_rows
            if len(known):
                v = col.drop_null().flatten().to_numpy().reshape(len(known), -1)
                x = _binned(list(v.T), cuts)
                f = np.full((len(known), len(models)), np.nan)
                for i, m in enumerate(models):
                    if m.base is not None:
                        f[:, i] = m.base
                        for splits, leaf in m.trees:
                            f[:, i] += leaf[_nodes(x, splits, depth)] if splits else leaf[0]
                for r, p in zip(known, f.tolist()):
                    result[r] = [None if a != a else a for a in p]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(result, pa.list_(pa.float64()))], names=b.schema.names)

    return d.mapInArrow(apply, schema)
