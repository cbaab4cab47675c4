"""Boosted trees on binned features for many heads at once: quantile losses, and a logistic one.

A head is a loss on a run of the rows in order: it learns from the rows before `fit`, watches its loss on those from
there to `tail`, and later rows are not its own. So all folds, seeds and quantiles of an evaluation are heads of one
training, and share each pass over the data.

A pass. Features are bytes (bins of their quantiles, edges from counts or one aggregate). Rows that are alike in bins and labels are a kind;
they are dealt out so that they meet, and lie in blocks of some hundred thousand: a column of numbers for each feature of the kinds, and of
each row its key and how many of the heads' limits it has passed. A pass counts what rows of each kind a head's round sees, and all else
is done once a kind, on whole columns. Each task sums gradients and
curvatures by (head, node, feature, bin) in arrays; those are added up by a grouped sum, and the driver picks the best
split of each node from the sums (heads x nodes x features x bins rows, whatever the number of cases). Sums are of
whole numbers (gradients in millionths of two), so results do not hang on the order of addition, nor on what is a kind. When a round's trees
are grown, one more pass refits each leaf of a quantile head: residuals are counted in steps of the leaf's range, and
the leaf takes the quantile of its loss. Every few rounds the running predictions are written out, so lineage stays
short; the trees since then are applied on the fly.

A tail's best round, if there is a tail, ends the head's trees. Missing values, and null ones, fall in the lowest bin.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corvia.operators.selection import at_ranks
from corvia.sources.written import discard, materialise

UNIT = 1 << 20  # of gradients, curvatures and losses, as whole numbers
STEPS = 512  # on each side of 0, in which a leaf's residuals are counted
KEEP = 12  # rounds after which running predictions are written


@dataclass(frozen=True)
class Head:
    """One model to train: its loss, and which ranks of the rows it may see."""

    name: str
    fold: int
    alpha: float | None  # of a quantile; None: probability of `positive`
    seed: int
    fit: int
    tail: int
    weight: float = 1.0  # of positives


@dataclass
class Tree:
    """A whole binary tree in level order: features, bins and gains of the inner nodes, shares of rows, values of the leaves.

    A row goes right where its bin is over the split's; an inner node that does not split sends all to the left.
    """

    feature: np.ndarray
    bin: np.ndarray
    cover: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def leaves(self, x: np.ndarray, kind: type = np.int64) -> np.ndarray:
        """Of rows of bins, the leaf of each, from 0. Columns are compared as a whole, so x is best held by column."""
        first, small = len(self.feature), np.uint8 if len(self.value) <= 256 else np.int64

        def below(node: int):
            if node >= first:
                return small(node - first)
            left = below(2 * node + 1)
            if self.bin[node] == 255:
                return left
            goes = small(0) - (x[:, self.feature[node]] > x.dtype.type(self.bin[node])).astype(small)  # all bits where a row goes right: quicker than a choice
            return left ^ ((left ^ below(2 * node + 2)) & goes)

        return np.broadcast_to(below(0), len(x)).astype(kind)

    @property
    def depth(self) -> int:
        return int(np.log2(len(self.value)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(x, np.intp)]


@dataclass
class Boosted:
    """A head's start value and trees."""

    head: Head
    base: float
    trees: list[Tree] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.predict(x)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        return raw if self.head.alpha is not None else 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


@dataclass
class Bins:
    """Edges of each feature; a value's bin is the number of edges below it."""

    columns: list[str]
    edges: list[np.ndarray]

    def of(self, values: list[np.ndarray]) -> np.ndarray:
        """Columns of values -> rows of bins."""
        out = np.zeros((len(values[0]) if values else 0, len(self.columns)), dtype=np.uint8)
        for j, (e, v) in enumerate(zip(self.edges, values, strict=True)):
            if len(e) < 8:  # nothing is over NaN
                for edge in e:
                    out[:, j] += v > edge
            else:
                out[:, j] = np.where(np.isnan(v), 0, np.searchsorted(e, v, side="left"))
        return out


def learn_bins(rows: DataFrame, columns: list[str], bins: int = 32) -> Bins:
    """Edges between quantiles, a few numbers for each feature.

    Values of a feature that has few are counted; the others' quantiles are from one aggregate whose sketches are bounded.
    """
    values = rows.select(*(F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)))
    share = [i / bins for i in range(1, bins + 1)]
    found = {}
    for i, counts in _counted(values).items():
        v, n = (np.array(a) for a in zip(*sorted(counts, key=lambda c: (np.isnan(c[0]), c[0])), strict=True))
        upto = np.cumsum(n)
        found[i] = v[np.searchsorted(upto, np.ceil(np.array(share) * upto[-1]))]
    wide = [i for i in range(len(columns)) if i not in found]
    if wide:
        at = values.agg(*(F.percentile_approx(f"c{i}", share, 10_000).alias(f"q{i}") for i in wide)).first()
        found |= {i: at[f"q{i}"] or [] for i in wide}
    edges = [np.unique([v for v in found[i] if v is not None and not np.isnan(v)])[:-1] for i in range(len(columns))]
    return Bins(columns, edges)


FEW = 16  # values of a feature that are counted


def _counted(values: DataFrame) -> dict[int, list[tuple[float, int]]]:
    """The place of each column that has one to FEW values (nulls apart): values, numbers of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[dict[float, int] | None] = []
        for batch in batches:
            found = found or [{} for _ in batch.columns]
            for j, column in enumerate(batch.columns):
                if (have := found[j]) is None:
                    continue
                for v, n in zip(*(a.tolist() for a in np.unique(column.drop_null().to_numpy(), return_counts=True)), strict=True):
                    v = v if v == v else np.nan  # a single key
                    have[v] = have.get(v, 0) + n
                    if len(have) > FEW:
                        found[j] = None
                        break
        out = [(j, v, n) for j, have in enumerate(found) for v, n in ([(None, 0)] if have is None else have.items())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int32(), pa.float64(), pa.int64()))], names=["place", "v", "n"])

    sums = values.mapInArrow(run, "place int, v double, n long").groupBy("place", "v").agg(F.sum("n").alias("n"))
    each = sums.groupBy("place").agg(F.count_if(F.col("v").isNull()).alias("wide"), F.count("*").alias("d"), F.collect_list(F.struct("v", "n")).alias("counts"))
    return {r["place"]: [(c["v"], c["n"]) for c in r["counts"]] for r in each.where((F.col("wide") == 0) & (F.col("d") <= FEW)).collect()}  # a row a feature


def binned(rows: DataFrame, bins: Bins, name: str = "x") -> DataFrame:
    """rows with the bytes of their bins."""

    @F.arrow_udf("binary")
    def pack(*values: pa.Array) -> pa.Array:
        x = bins.of([v.to_numpy(zero_copy_only=False) for v in values])
        ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
        return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x.tobytes())])

    return rows.withColumn(name, pack(*(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in bins.columns)))


def _bytes(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """A column of equally long binaries as rows of numbers."""
    if not len(column):
        return np.zeros((0, width), dtype=kind)
    _, ends, data = column.buffers()
    size = width * np.dtype(kind).itemsize
    start = int(np.frombuffer(ends, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset])
    return np.frombuffer(data, dtype=np.uint8)[start : start + size * len(column)].view(kind).reshape(-1, width)


def _gradient(h: Head, y: np.ndarray, p: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if h.alpha is not None:
        return (y < f) - h.alpha, np.ones(len(y))
    s = 1 / (1 + np.exp(-np.clip(f, -500, 500)))
    w = np.where(p, h.weight, 1.0)
    return w * (s - p), w * np.maximum(s * (1 - s), 1e-6)


def loss(h: Head, y: np.ndarray, p: np.ndarray, f: np.ndarray) -> np.ndarray:
    if h.alpha is not None:
        return np.maximum((y - f) * h.alpha, (y - f) * (h.alpha - 1))
    return np.where(p, h.weight, 1.0) * (np.logaddexp(0, f) - p * f)


def _drawn(h: Head, key: np.ndarray, round_: int, share: float) -> np.ndarray:
    """Which rows a round of a head sees: a hash of the row's key, so the same on every machine."""
    with np.errstate(over="ignore"):
        x = key.astype(np.uint64) ^ np.uint64((h.seed * 0x9E3779B97F4A7C15 + round_ * 0xC2B2AE3D27D4EB4F + 1) & ((1 << 64) - 1))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(40)) < np.uint64(int(share * (1 << 24)))


# --- blocks: kinds packed by thousands, as columns of numbers, with their rows' keys

KIND = {"first": np.uint16, "n": np.int32, "y": np.float64, "p": np.uint8}
ROW = {"rank": np.uint16, "key": np.int64}
BLOCK, PART_BYTES = 1 << 17, 32 << 20


@dataclass
class Block:
    """Rows by kind; y, p, bins (by column) of each kind, running predictions by head, if any were written.

    With cuts, a row's rank is the number of cuts that are not above it, `first` is the lowest of each kind, and kinds are in its order,
    so a head's kinds begin each block. Without, each row is a kind, in the order of ranks.
    """

    rank: np.ndarray
    key: np.ndarray
    y: np.ndarray
    p: np.ndarray
    x: np.ndarray
    f: np.ndarray | None
    n: np.ndarray | None = None
    first: np.ndarray | None = None
    cuts: list[int] | None = None
    drawn: dict = field(default_factory=dict)

    def upto(self, limit: int) -> int:
        """The number of kinds with a row below a rank; a cut, if there are cuts."""
        return int(np.searchsorted(self.rank, limit) if self.cuts is None else np.searchsorted(self.first, self._passed(limit)))

    def _passed(self, limit: int) -> int:
        return self.cuts.index(limit) + 1

    def _places(self) -> np.ndarray:
        if "places" not in self.drawn:
            self.drawn["places"] = self.rank * np.int64(len(self.y)) + np.repeat(np.arange(len(self.y)), self.n)
        return self.drawn["places"]

    def _sums(self, which: np.ndarray | None) -> np.ndarray:
        """By number of cuts and kind, the rows that have passed fewer."""
        places = self._places() if which is None else self._places()[which]
        counts = np.bincount(places, minlength=len(self.cuts) * len(self.y)).reshape(-1, len(self.y))
        return np.cumsum(counts, axis=0, dtype=np.float64)

    def seen(self, h: Head, round_: int, share: float) -> np.ndarray:
        """Of each kind, the rows that teach a head in a round."""
        if h.seed not in self.drawn:
            drawn = _drawn(h, self.key, round_, share)
            self.drawn[h.seed] = drawn if self.cuts is None else self._sums(drawn)
        drawn = self.drawn[h.seed]
        return (drawn & (self.rank < h.fit)).astype(np.float64) if self.cuts is None else drawn[self._passed(h.fit) - 1]

    def late(self, h: Head) -> np.ndarray:
        """Of each kind, the rows of a head's tail."""
        if self.cuts is None:
            return ((self.rank >= h.fit) & (self.rank < h.tail)).astype(np.float64)
        if "all" not in self.drawn:
            self.drawn["all"] = self._sums(None)
        return self.drawn["all"][self._passed(h.tail) - 1] - self.drawn["all"][self._passed(h.fit) - 1]


def cuts_of(heads: list[Head]) -> list[int]:
    """The ranks where a head's rows end: all that training needs to know of an order."""
    return sorted({r for h in heads for r in (h.fit, h.tail)})


def _row_schema(with_f: bool) -> str:
    return ", ".join(f"{c} binary" for c in (*KIND, *ROW, "x", *(["f"] if with_f else [])))


def _packed(rows: DataFrame, width: int, heads: int, cuts: list[int] | None = None) -> DataFrame:
    """rank, key, y, p, x -> blocks. Rows of a kind lie together, by ranges of a hash, and then of keys where a kind is large."""
    cuts = cuts or []
    n = rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-n * (25 + width + 8 * (heads if heads < 8 else 8)) // PART_BYTES), min(2 * cores, n // 20_000 + 1))
    passed = sum(((F.col("rank") >= c).cast("int") for c in cuts), F.lit(0))
    slim = rows.select(passed.alias("rank"), "key", "y", "p", "x", F.xxhash64("x", "y", "p").alias("kind"))
    spread = slim.repartitionByRange(parts, "kind", "key") if parts > 1 else slim.coalesce(1)

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        of = lambda c, kind: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]).astype(kind)
        rank, key, y, p = of("rank", np.uint16), of("key", np.int64), of("y", np.float64), of("p", np.uint8)
        x = np.concatenate([_bytes(b.column("x"), np.uint8, width) for b in held])
        other = (y[1:] != y[:-1]) | (p[1:] != p[:-1]) | (x[1:] != x[:-1]).any(axis=1)
        starts = np.flatnonzero(np.concatenate([[True], other]))
        size, first = np.diff(np.append(starts, len(y))), np.minimum.reduceat(rank, starts)
        order = np.argsort(first, kind="stable")
        at = np.repeat(starts[order] - np.concatenate([[0], np.cumsum(size[order])[:-1]]), size[order]) + np.arange(len(y))  # rows in the order of kinds
        kept = starts[order]
        values = {"first": first[order], "n": size[order], "y": y[kept], "p": p[kept], "rank": rank[at], "key": key[at]}
        blobs = [v.astype((KIND | ROW)[c]).tobytes() for c, v in values.items()] + [x[kept].tobytes(order="F")]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in blobs], names=[*values, "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held, size = [*held, batch], size + batch.num_rows
            if size >= BLOCK:
                yield block(held)
                held, size = [], 0
        if size:
            yield block(held)

    return spread.sortWithinPartitions("kind").mapInArrow(run, _row_schema(False))


def _blocks(batches: Iterator[pa.RecordBatch], width: int, heads: int, cuts: list[int]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            value = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), dtype=kind)  # noqa: B023, E731
            f = value("f", np.float64).reshape(heads, -1) if "f" in batch.schema.names else None
            v = {c: value(c, k) for c, k in (KIND | ROW).items()}
            yield Block(v["rank"], v["key"], v["y"], v["p"], value("x", np.uint8).reshape(width, -1).T, f, v["n"], v["first"], cuts)


Pending = list[list[Tree | None]]  # by round, then by head


def _running(block: Block, m: int, base: float, pending: Pending, upto: int) -> np.ndarray:
    """Predictions of a head for the first kinds of a block."""
    f = np.full(upto, base) if block.f is None else block.f[m, :upto].copy()
    for trees in pending:
        if trees[m] is not None:
            f += trees[m].predict(block.x[:upto])
    return f


def _pass(state: DataFrame, heads: list[Head], base: list[float], width: int, pending: Pending, late: bool, step: Callable) -> DataFrame:
    """Run step().add(block, head number, head, f, number of kinds that teach) on each block and head; its sums go out at the end of a task.

    If `late`, step().late(block, head number, head, f) too, where f goes on to the kinds of the tail.
    """
    cuts = cuts_of(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = step()
        for block in _blocks(batches, width, len(heads), cuts):
            for m, h in enumerate(heads):
                fit = block.upto(h.fit)
                tail = block.upto(h.tail) if late and h.tail > h.fit else fit
                if tail:
                    f = _running(block, m, base[m], pending, tail)
                    sums.add(block, m, h, f[:fit], fit)
                    if late and h.tail > h.fit:
                        sums.late(block, m, h, f)
        for m, node, g, w in sums.rows():
            at = np.flatnonzero((g != 0) | (w != 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), m), pa.int32()), pa.array(np.full(len(at), node), pa.int32()), pa.array(at, pa.int64()), pa.array(g[at], pa.int64()), pa.array(w[at], pa.int64())],
                names=["head", "node", "at", "g", "w"],
            )

    return state.mapInArrow(run, SUMS)


SUMS = "head int, node int, at long, g long, w long"


def _added(parts: DataFrame) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(head, node) -> places, sums; a number of rows that the data do not change."""
    t = parts.groupBy("head", "node", "at").agg(F.sum("g").alias("g"), F.sum("w").alias("w")).toArrow()
    head, node, at, g, w = (t[c].to_numpy() for c in ("head", "node", "at", "g", "w"))
    order = np.lexsort((at, node, head))
    head, node, at, g, w = (a[order] for a in (head, node, at, g, w))
    cut = np.flatnonzero(np.concatenate([[True], (head[1:] != head[:-1]) | (node[1:] != node[:-1])])) if len(head) else np.empty(0, dtype=int)
    ends = np.append(cut[1:], len(head))[: len(cut)]
    return {(int(head[a]), int(node[a])): (at[a:b], g[a:b], w[a:b]) for a, b in zip(cut.tolist(), ends.tolist(), strict=True)}


def _best_split(at: np.ndarray, g: np.ndarray, w: np.ndarray, width: int, bins: int, least: float, allowed: np.ndarray):
    """Feature, bin, share of the left, gain, or None; sums at feature * bins + bin. The first of equal gains."""
    G, W = np.zeros(width * bins), np.zeros(width * bins)
    G[at], W[at] = g / UNIT, w / UNIT
    G, W = G.reshape(width, bins), W.reshape(width, bins)
    left, weight = np.cumsum(G, axis=1), np.cumsum(W, axis=1)
    total, all_ = left[:, -1:], weight[:, -1:]
    right, other = total - left, all_ - weight
    gain = left**2 / (weight + 1) + right**2 / (other + 1) - total**2 / (all_ + 1)
    gain[(weight < least) | (other < least)] = -np.inf
    gain[~allowed] = -np.inf
    best = int(np.argmax(gain))
    if not gain.flat[best] > 1e-9:
        return None
    return best // bins, best % bins, weight.flat[best] / all_[best // bins, 0], gain.flat[best]


def train(
    rows: DataFrame, bins: Bins, heads: list[Head], rounds: int = 20, depth: int = 3, rate: float = 0.2, least: float = 5.0,
    row_share: float = 0.8, column_share: float = 0.8,
) -> list[Boosted]:
    """rank, key, y, p (0 or 1), x (bytes of bins) -> the heads' trees.

    A round sees row_share of a head's rows and a tree column_share of the features, drawn by the head's seed.
    """
    width = len(bins.columns)
    slim = rows.select("rank", "key", F.col("y").cast("double").alias("y"), F.col("p").cast("int").alias("p"), "x")
    base, span = _starts(slim, heads)
    cuts = cuts_of(heads)
    state = materialise(_packed(slim.where(F.col("rank") < cuts[-1]), width, len(heads), cuts), "boosting")
    conf = rows.sparkSession.conf
    before = conf.get(LEAST_PARTS, None)
    conf.set(LEAST_PARTS, before or str(4 * rows.sparkSession.sparkContext.defaultParallelism))  # small files are not put together until cores idle
    try:
        return _rounds(state, bins, heads, base, span, rounds, depth, rate, least, row_share, column_share)
    finally:
        if before is None:
            conf.unset(LEAST_PARTS)


LEAST_PARTS = "spark.sql.files.minPartitionNum"


def _rounds(
    state: DataFrame, bins: Bins, heads: list[Head], base: list[float], span: float, rounds: int, depth: int, rate: float, least: float, row_share: float, column_share: float,
) -> list[Boosted]:
    """Blocks -> the heads' trees."""
    width, most = len(bins.columns), 1 + max((len(e) for e in bins.edges), default=0)
    sizes = [len(e) + 1 for e in bins.edges]
    models = [Boosted(h, b) for h, b in zip(heads, base, strict=True)]
    pending: Pending = []
    losses = np.full((rounds + 1, len(heads)), np.nan)
    pick = [np.random.default_rng(h.seed) for h in heads]
    for r in range(rounds):
        grown = [Tree(np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, 255), np.ones(2 ** (depth + 1) - 1), np.zeros(2**depth), np.zeros(2**depth - 1)) for _ in heads]
        allowed = [p.random(width) < column_share for p in pick]
        for level in range(depth):
            sums = _added(_pass(state, heads, base, width, pending, level == 0, lambda: Histograms(grown, level, sizes, most, r, row_share)))  # noqa: B023
            for (m, node), (at, g, w) in sums.items():
                if node == -1:
                    losses[r, m] = g[0] / max(1, w[0])
                else:
                    use = allowed[m] if allowed[m].any() else np.ones(width, dtype=bool)
                    found = _best_split(at, g, w, width, most, least, use)
                    t = grown[m]
                    share = 1.0 if found is None else found[2]
                    if found is not None:
                        t.feature[node], t.bin[node], t.gain[node] = found[0], found[1], found[3]
                    t.cover[2 * node + 1], t.cover[2 * node + 2] = t.cover[node] * share, t.cover[node] * (1 - share)
            for t in grown:  # nodes that no row reached
                for node in range(2**level - 1, 2 ** (level + 1) - 1):
                    if t.bin[node] == 255:
                        t.cover[2 * node + 1], t.cover[2 * node + 2] = t.cover[node], 0.0
        sums = _added(_pass(state, heads, base, width, pending, False, lambda: LeafSums(grown, span, r, row_share)))  # noqa: B023
        for (m, leaf), (at, g, w) in sums.items():
            grown[m].value[leaf] = rate * _leaf_value(heads[m], at, g, w, span)
        for model, t in zip(models, grown, strict=True):
            model.trees.append(t)
        pending.append(grown)
        if len(pending) == KEEP and r + 1 < rounds:
            following = materialise(_applied(state, heads, base, width, pending), "boosting")
            discard(state)
            state, pending = following, []
    for (m, node), (_, g, w) in _added(_pass(state, heads, base, width, pending, True, lambda: Histograms([], 0, sizes, most, rounds, row_share))).items():
        if node == -1:
            losses[rounds, m] = g[0] / max(1, w[0])
    discard(state)
    for m, model in enumerate(models):
        if heads[m].tail > heads[m].fit and not np.isnan(losses[:, m]).all():
            model.trees = model.trees[: int(np.nanargmin(losses[:, m]))]
    return models


def _starts(rows: DataFrame, heads: list[Head]) -> tuple[list[float], float]:
    """A quantile head starts from that quantile of its labels, a probability from the log odds of its share; and the span of labels.

    Labels are counted between the ranks where heads end; a head's are those before its own.
    """
    fits = sorted({h.fit for h in heads})
    passed = sum(((F.col("rank") >= c).cast("int") for c in fits), F.lit(0))
    parts = {r["part"]: r for r in rows.groupBy(passed.alias("part")).agg(F.count("p").alias("n"), F.sum("p").alias("p"), F.min("y").alias("low"), F.max("y").alias("high")).collect()}
    lows, highs = ([r[c] for r in parts.values() if r[c] is not None] for c in ("low", "high"))
    alphas = sorted({h.alpha for h in heads if h.alpha is not None})
    values = {}
    if alphas:
        counts = rows.where(F.col("rank") < fits[-1]).groupBy(passed.alias("part"), "y").agg(F.count("*").alias("k"))
        known = counts.select("y", "k", F.explode(F.sequence(F.col("part"), F.lit(len(fits) - 1))).alias("of"))
        nearest = [lambda n, a=a: F.greatest(F.ceil(n * F.lit(a)) - 1, F.lit(0)) for a in alphas]
        values = {fits[r["of"]]: dict(zip(alphas, r["values"], strict=True)) for r in at_ranks(known, ["of"], "y", nearest, count="k").collect()}
    base = []
    for h in heads:
        if h.alpha is not None:
            base.append(float(values.get(h.fit, {}).get(h.alpha, 0.0)))
        else:
            mine = [r for part, r in parts.items() if part <= fits.index(h.fit)]
            n = sum(r["n"] for r in mine)
            v = min(max(sum(r["p"] or 0 for r in mine) / n if n else 0.5, 1e-6), 1 - 1e-6)
            v = v * h.weight / (v * h.weight + 1 - v)
            base.append(float(np.log(v / (1 - v))))
    return base, max(max(highs) - min(lows) if lows else 0.0, 1e-9)


def grouped(sizes: list[int], most: int = 4096) -> list[list[int]]:
    """Features in groups that have at most `most` different rows of bins (a feature with more is a group of its own)."""
    out: list[list[int]] = []
    ways = most + 1
    for j, size in enumerate(sizes):
        if ways * size > most:
            out.append([])
            ways = 1
        out[-1].append(j)
        ways *= size
    return out


class Histograms:
    """Sums by bin for each node of a level; with the first level the loss of the tail (node -1).

    A group of features is counted once, by its rows of bins; what a feature's own bins have is added up from those when a task ends.
    A quantile's gradients have two values, so counts of both give their sums.
    """

    def __init__(self, grown: list[Tree], level: int, sizes: list[int], bins: int, round_: int, share: float):
        self.grown, self.level, self.sizes, self.bins, self.round, self.share = grown, level, sizes, bins, round_, share
        self.groups = grouped(sizes)
        self.sums: dict[tuple[int, int], list[np.ndarray]] = {}
        self.losses: dict[int, list[int]] = {}
        self.alphas: dict[int, float | None] = {}
        self.codes: tuple[Block | None, list[np.ndarray]] = (None, [])

    def _codes(self, block: Block) -> list[np.ndarray]:
        if self.codes[0] is not block:
            found = []
            for group in self.groups:
                code = np.zeros(len(block.y), dtype=np.int64)
                for j in group:
                    code = code * self.sizes[j] + block.x[:, j]
                found.append(code)
            self.codes = block, found
        return self.codes[1]

    def late(self, block: Block, m: int, h: Head, f: np.ndarray) -> None:
        have, rows, n = self.losses.setdefault(m, [0, 0]), block.late(h)[: len(f)], len(f)
        have[0] += int((np.round(loss(h, block.y[:n], block.p[:n].astype(bool), f) * 1024) * rows).sum())
        have[1] += int(rows.sum())

    def add(self, block: Block, m: int, h: Head, f: np.ndarray, fit: int) -> None:
        if not self.grown or not fit:
            return
        self.alphas[m] = h.alpha
        y, nodes, rows = block.y[:fit], 2**self.level, block.seen(h, self.round, self.share)[:fit]
        top = self.grown[m]
        node = Tree(top.feature[: nodes - 1], top.bin[: nodes - 1], top.cover, np.zeros(nodes), top.gain).leaves(block.x[:fit])
        if h.alpha is not None:
            node = 2 * node + (y < f)
            weights = [rows]
        else:
            weights = [np.round(v * UNIT) * rows for v in _gradient(h, y, block.p[:fit].astype(bool), f)]
        for i, (group, code) in enumerate(zip(self.groups, self._codes(block), strict=True)):
            ways = int(np.prod([self.sizes[j] for j in group]))
            at = node * ways + code[:fit]
            new = [np.bincount(at, v, (1 + (h.alpha is not None)) * nodes * ways).astype(np.int64) for v in weights]
            have = self.sums.get((m, i))
            if have is None:
                self.sums[m, i] = new
            else:
                for a, b in zip(have, new, strict=True):
                    a += b

    def rows(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for m, (total, n) in self.losses.items():
            yield m, -1, np.array([total]), np.array([n])
        nodes, width = 2**self.level, len(self.sizes)
        whole: dict[int, list[np.ndarray]] = {}
        for (m, i), sums in self.sums.items():
            g, w = whole.setdefault(m, [np.zeros((nodes, width * self.bins), dtype=np.int64) for _ in range(2)])
            group = self.groups[i]
            if len(sums) == 1:  # over the prediction, and under it
                over, under = np.moveaxis(sums[0].reshape(nodes, 2, -1), 1, 0)
                high, low = self._quantile_units(m)
                sums = [over * high + under * low, (over + under) * UNIT]
            each = [v.reshape(nodes, *(self.sizes[j] for j in group)) for v in sums]
            for k, j in enumerate(group):
                others = tuple(1 + o for o in range(len(group)) if o != k)
                for into, v in zip((g, w), each, strict=True):
                    into[:, j * self.bins : j * self.bins + self.sizes[j]] = v.sum(axis=others)
        for m, (g, w) in whole.items():
            for k in range(nodes):
                yield m, nodes - 1 + k, g[k], w[k]

    def _quantile_units(self, m: int) -> tuple[int, int]:
        alpha = self.alphas[m]
        return int(np.round(-alpha * UNIT)), int(np.round((1 - alpha) * UNIT))


def _cells(residual: np.ndarray, span: float) -> np.ndarray:
    """The cell of each residual: fine near 0, coarse near the ends of the range of labels."""
    return np.clip(np.round(np.arcsinh(residual * 200 / span) * (STEPS / 7)), -STEPS, STEPS).astype(np.int64) + STEPS


class LeafSums:
    """For each leaf, residuals by cell, or gradient and curvature of a probability."""

    def __init__(self, grown: list[Tree], span: float, round_: int, share: float):
        self.grown, self.span, self.round, self.share = grown, span, round_, share
        self.sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, block: Block, m: int, h: Head, f: np.ndarray, fit: int) -> None:
        t, cells = self.grown[m], 2 * STEPS + 1
        rows, n, leaf = block.seen(h, self.round, self.share)[:fit], len(t.value), t.leaves(block.x[:fit])
        g, w = self.sums.setdefault(m, tuple(np.zeros((n, cells), dtype=np.int64) for _ in range(2)))
        if h.alpha is not None:
            w += np.bincount(leaf * cells + _cells(block.y[:fit] - f, self.span), rows, w.size).astype(np.int64).reshape(w.shape)
        else:
            for into, v in zip((g, w), _gradient(h, block.y[:fit], block.p[:fit].astype(bool), f), strict=True):
                into[:, 0] += np.bincount(leaf, np.round(v * UNIT) * rows, n).astype(np.int64)

    def rows(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for m, (g, w) in self.sums.items():
            for k in range(len(g)):
                yield m, k, g[k], w[k]


def _leaf_value(h: Head, at: np.ndarray, g: np.ndarray, w: np.ndarray, span: float) -> float:
    if h.alpha is None:
        return float(-(g[0] / UNIT) / (w[0] / UNIT + 1))
    upto = np.cumsum(w)
    cell = at[np.searchsorted(upto, h.alpha * upto[-1])]
    return float(np.sinh((cell - STEPS) * 7 / STEPS) * span / 200)


def _applied(state: DataFrame, heads: list[Head], base: list[float], width: int, pending: Pending) -> DataFrame:
    """state with the pending trees in its running predictions."""
    cuts = cuts_of(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(_blocks(iter([batch]), width, len(base), cuts)):
                f = np.concatenate([_running(block, m, b, pending, len(block.y)) for m, b in enumerate(base)])
                one = batch.slice(i, 1).select([*KIND, *ROW, "x"])
                yield one.append_column("f", pa.array([f.tobytes()], pa.binary()))

    return state.mapInArrow(run, _row_schema(True))
