"""Boosted trees grown from histograms of gradients.

Features are cut into bins by quantiles of all rows. A round grows one tree per
class (one in all for two classes) from sums of gradients and hessians per
(class, node, feature, bin): split gains, leaf values and their penalties need
nothing else. Trees grow best first up to a number of leaves: all nodes that may
still be among the best are summed in one pass.

``Booster`` fits on all rows. Up to ``HELD`` of them are held by one task, and
several models, such as those of folds, are fitted by as many tasks. More are
dealt over all cores by ``fit_together``: one job whose tasks wait for each
other (a barrier stage) runs all rounds; a task sums its own rows, adds up its
share of the features from the sums of all, and tells the others its best
splits. ``fit_distributed`` needs no tasks at the same time: a pass combines its
sums per task and adds them up in one shuffle, and only these sums, whose number
depends on bins and nodes and not on rows, reach the driver. All run the same
rounds over the same sums.
"""

from __future__ import annotations

import heapq
import io
import json
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import BarrierTaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clienttrace.operators.evidence import Leaves
from clienttrace.operators.paths import Paths, TreeNodes, paths
from clienttrace.session import shared_folder, written

#: Rows that one task holds for a fit; more are dealt over all cores.
HELD = 1 << 16
#: Rows summed, scored or turned at a time by a task that keeps its rows in files.
BLOCK = 1 << 17
#: Bytes of an array that such a task holds in memory instead.
IN_MEMORY = 1 << 26
#: Rows that are worth a task among those that fit together.
LEAST_ROWS = 1 << 13
#: Bytes of packed trees per row of a result.
PACKED = 1 << 22
#: Numbers worked on at a time, so that they stay in a core's cache.
CACHED = 1 << 15
#: Rows of a node from which one of its children is subtracted from it; fewer rows are summed anew, without rounding.
SUBTRACTED = 1 << 11
#: Rows scored at a time.
SCORED = 1 << 12
ALL_OPEN = np.uint64((1 << 64) - 1)
#: Rounds after which a distributed fit writes the scores instead of making them again.
KEEP_EVERY = 8
#: Blocks of features whose quantiles are put together by tasks of their own, and tasks that read rows for them (cores, if more).
BLOCKS = 16
SKETCHES = 32
#: Features that are left together.
FEW = 8


@dataclass(frozen=True)
class Boosting:
    """Settings: ``alpha`` and ``penalty`` are the absolute and squared penalties of leaf values."""

    rounds: int
    rate: float
    depth: int
    leaves: int = 1 << 30
    rows: float = 1.0
    columns: float = 1.0
    least_rows: int = 1
    least_hessian: float = 1e-3
    alpha: float = 0.0
    penalty: float = 0.0
    bins: int = 64


def cut_points(rows: DataFrame, d: int, bins: int) -> dict[int, tuple[int, int, list]]:
    """Per number in ``part``: rows, the highest label, and for each dimension of ``x`` the bounds of ``bins`` equally full bins.

    What a task keeps of a feature to find its quantiles hardly shrinks with the rows it reads, and putting it together
    costs more than reading. So rows are read by a bounded number of tasks, not by one per partition, and blocks of
    features are put together side by side.
    """
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    width = max(1, d) if d <= FEW else -(-d // BLOCKS)
    tasks = max(SKETCHES, rows.sparkSession.sparkContext.defaultParallelism)
    starts = F.array(*[F.lit(at) for at in range(0, max(1, d), width)])
    dealt = rows.coalesce(tasks).select("part", "label", "x", F.explode(starts).alias("at"))
    found = dealt.groupBy("part", "at").agg(
        F.count(F.lit(1)).alias("n"), F.max("label").alias("top"),
        F.array(*[F.percentile_approx(F.when(F.col("at") + j < d, F.col("x")[F.col("at") + j]), shares, 10_000)
                  for j in range(width)]).alias("edges")).collect()
    out: dict[int, tuple[int, int, list]] = {}
    for r in sorted(found, key=lambda r: (r["part"], r["at"])):
        out.setdefault(r["part"], (r["n"], r["top"], []))[2].extend(r["edges"][:d - r["at"]])
    return out


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin of each value: the number of bounds below it; NaN is in the last."""
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(e, x[:, j])
    return out


def _drawn(keys: np.ndarray, seed: int, turn: int, share: float) -> np.ndarray:
    """The rows of a round, by their keys and not by their places."""
    if share >= 1:
        return np.ones(len(keys), bool)
    z = keys.astype(np.uint64) + np.uint64((seed * 1_000_003 + turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) < np.uint64(int(share * (1 << 63)) * 2)


def gradients(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the log loss; one score per row means two classes."""
    k = scores.shape[1]
    if k == 1:
        p = 1 / (1 + np.exp(-scores))
        return p - labels[:, None], p * (1 - p)
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return p - (labels[:, None] == np.arange(k)), p * (1 - p) * k / (k - 1)


#: Gain, feature, bin, and the sums of the left side.
Split = tuple[float, int, int, np.ndarray]


@dataclass
class Tree:
    """Nodes in the order they were made; a leaf has no feature (-1). ``sums`` are gradients, hessians and rows."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    sums: list[np.ndarray | None] = field(default_factory=lambda: [None])
    best: list[Split | None] = field(default_factory=lambda: [None])

    def place(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(bins), np.int32)
        rows = {0: np.arange(len(bins))}
        for node, feature in enumerate(self.feature):
            here = rows.pop(node)
            if feature >= 0:
                right = bins[:, feature].take(here) > self.bin[node]
                rows[self.left[node]], rows[self.left[node] + 1] = here[~right], here[right]
            else:
                at[here] = node
        return at

    def expand(self, node: int) -> list[int]:
        _, self.feature[node], self.bin[node], left = self.best[node]
        self.left[node] = len(self.feature)
        for sums in (left, self.sums[node] - left):
            self.feature.append(-1)
            self.bin.append(0)
            self.left.append(0)
            self.depth.append(self.depth[node] + 1)
            self.sums.append(sums)
            self.best.append(None)
        return [self.left[node], self.left[node] + 1]

    def frontier(self, leaves: int) -> tuple[set[int], list[int]]:
        """Nodes split best first as far as known, and nodes that would be split next but are not expanded."""
        split, wanted, n = set(), [], 1
        heap = [(-self.best[0][0], 0)] if self.best[0] else []
        while heap and n < leaves:
            _, node = heapq.heappop(heap)
            n += 1
            if self.feature[node] < 0:
                wanted.append(node)
                continue
            split.add(node)
            for child in (self.left[node], self.left[node] + 1):
                if self.best[child]:
                    heapq.heappush(heap, (-self.best[child][0], child))
        return split, wanted

    def pruned(self, split: set[int]) -> Tree:
        """Only these splits, renumbered."""
        out, todo = Tree(), [(0, 0)]
        out.sums[0] = self.sums[0]
        while todo:
            old, new = todo.pop(0)
            if old in split:
                out.best[new] = self.best[old]
                todo += [(self.left[old] + i, child) for i, child in enumerate(out.expand(new))]
        return out

    def values(self, p: Boosting) -> np.ndarray:
        g, h, _ = np.array(self.sums).T
        return -_shrunk(g, p.alpha) / (h + p.penalty) * p.rate


def _shrunk(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def best_splits(sums: np.ndarray, cuts: np.ndarray, p: Boosting) -> list[Split | None]:
    """The best split of each node's sums (kind, node, feature, bin); of equal ones the first feature and bin."""
    left = sums.cumsum(axis=3)
    whole = left[..., -1:]
    right = whole - left

    def score(s: np.ndarray) -> np.ndarray:
        g = np.abs(s[0])
        g -= p.alpha
        np.maximum(g, 0, out=g)
        g *= g
        g /= s[1] + (p.penalty + 1e-300)
        return g

    fine = (np.arange(sums.shape[3]) < cuts[:, None]) & (left[2] >= p.least_rows) & (right[2] >= p.least_rows)
    fine &= (left[1] >= p.least_hessian) & (right[1] >= p.least_hessian)
    gain = score(left)
    gain += score(right)
    gain -= score(whole)
    gain[~fine] = -np.inf
    gain = gain.reshape(sums.shape[1], -1)
    at = gain.argmax(axis=1)
    out: list[Split | None] = []
    for i, a in enumerate(at):
        f, b = divmod(int(a), sums.shape[3])
        out.append((float(gain[i, a]), f, b, left[:, i, f, b].copy()) if gain[i, a] > 1e-12 else None)
    return out


Wanted = list[tuple[int, int]]


def histograms(bins: np.ndarray, g: np.ndarray, h: np.ndarray, trees: list[Tree], wanted: Wanted, width: int) -> np.ndarray:
    """Sums of gradients, hessians and rows per (kind, wanted class and node, feature, bin)."""
    d = bins.shape[1]
    out = np.zeros((3, len(wanted), d, width))
    for c in sorted({c for c, _ in wanted}):
        nodes = [(i, node) for i, (of, node) in enumerate(wanted) if of == c]
        slot = np.full(len(trees[c].feature), -1)
        slot[[node for _, node in nodes]] = range(len(nodes))
        at = slot[trees[c].place(bins)]
        rows = np.flatnonzero(at >= 0)
        flat = (bins[rows] + np.arange(d) * width + at[rows, None] * (d * width)).ravel()
        for kind, weight in enumerate((g, h, None)):
            weights = None if weight is None else np.repeat(weight[rows, c], d)
            out[kind, [i for i, _ in nodes]] = np.bincount(flat, weights, len(nodes) * d * width).reshape(-1, d, width)
    return out


def _sums(bins: np.ndarray, g: np.ndarray, h: np.ndarray, groups: list[np.ndarray], width: int,
          columns: np.ndarray | None = None) -> np.ndarray:
    """Sums of gradients, hessians and rows per (kind, group of rows, feature, bin); ``bins`` has a line per feature, of
    which ``columns`` are summed."""
    d, n = len(bins) if columns is None else len(columns), len(groups)
    rows = np.concatenate(groups)
    slot = np.repeat(np.arange(n) * width, [len(r) for r in groups])
    weights = g[rows], h[rows]
    out = np.empty((3, n, d, width))
    step = max(1, min(d, CACHED // max(1, len(rows))))
    cells = np.arange(step)[:, None] * (n * width) + slot
    times = [np.tile(w, step) for w in weights]
    for f in range(0, d, step):
        part = (np.take(bins[f:f + step], rows, axis=1, mode="clip") if columns is None
                else np.stack([bins[j].take(rows, mode="clip") for j in columns[f:f + step]]))
        k = len(part)
        at = (part + cells[:k]).ravel()
        for kind, w in enumerate((*times, None)):
            found = np.bincount(at, None if w is None else w[:len(at)], k * n * width)
            out[kind, :, f:f + k] = found.reshape(k, n, width).transpose(1, 0, 2)
    return out


class _Held:
    """Sums for ``grow`` of one tree over rows held in one place.

    Rows are parted node by node. Of two children of many rows only the smaller is summed, the other is what is left
    of their parent; a bin without rows is exactly zero in both.
    """

    def __init__(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray, width: int):
        self.bins, self.g, self.h, self.width = bins, g, h, width
        self.rows = {0: np.arange(bins.shape[1])}
        self.found: dict[int, np.ndarray] = {}

    def __call__(self, trees: list[Tree], wanted: Wanted) -> np.ndarray:
        tree, nodes = trees[0], [node for _, node in wanted]
        if nodes == [0]:
            self.found[0] = _sums(self.bins, self.g, self.h, [self.rows[0]], self.width)[:, 0]
            return self.found[0][:, None]
        asked = set(nodes)
        # Parents wait with their rows and sums until one of their children is wanted.
        parents = [n for n in self.found if tree.feature[n] >= 0 and {tree.left[n], tree.left[n] + 1} & asked]
        summed, left_over = [], []
        for n in parents:
            rows, of_parent, left = self.rows.pop(n), self.found.pop(n), tree.left[n]
            right = self.bins[tree.feature[n]].take(rows, mode="clip") > tree.bin[n]
            self.rows[left], self.rows[left + 1] = rows[~right], rows[right]
            if len(rows) < SUBTRACTED:
                summed += [c for c in (left, left + 1) if c in asked]
                continue
            small = left + (2 * np.count_nonzero(right) < len(rows))
            summed.append(small)
            left_over.append((2 * left + 1 - small, of_parent, small))
        sums = _sums(self.bins, self.g, self.h, [self.rows[n] for n in summed], self.width)
        self.found.update((n, sums[:, i]) for i, n in enumerate(summed))
        for node, of_parent, small in left_over:
            rest = of_parent - self.found[small]
            rest[:2, rest[2] == 0] = 0
            self.found[node] = rest
        return np.stack([self.found[n] for n in nodes], axis=1)


#: For nodes wanted their best splits and, for roots, the sums of all rows.
Splits = Callable[[list[Tree], Wanted], list[tuple[Split | None, np.ndarray | None]]]


def grown(classes: int, p: Boosting, splits: Splits) -> list[Tree]:
    """One tree per class."""
    trees = [Tree() for _ in range(classes)]
    wanted: Wanted = [(c, 0) for c in range(classes)]
    while wanted:
        for (c, node), (split, whole) in zip(wanted, splits(trees, wanted)):
            if node == 0:
                trees[c].sums[0] = whole
            trees[c].best[node] = split
        wanted = []
        for c, t in enumerate(trees):
            # What is too deep or too small to be split needs no sums: those of its parent's split are known.
            todo = t.frontier(p.leaves)[1]
            while todo:
                wanted += [(c, n) for node in todo for n in t.expand(node)
                           if t.depth[n] < p.depth and t.sums[n][2] >= 2 * p.least_rows]
                todo = [] if any(of == c for of, _ in wanted) else t.frontier(p.leaves)[1]
    return [t.pruned(t.frontier(p.leaves)[0]) for t in trees]


def grow(classes: int, columns: list[np.ndarray], cuts: np.ndarray, p: Boosting,
         sums: Callable[[list[Tree], Wanted], np.ndarray]) -> list[Tree]:
    """One tree per class; ``columns`` are the features each may use, ``cuts`` the bounds of every feature."""
    allowed = [np.where(np.isin(np.arange(len(cuts)), c), cuts, 0) for c in columns]

    def splits(trees: list[Tree], wanted: Wanted) -> list[tuple[Split | None, np.ndarray | None]]:
        found = sums(trees, wanted)
        out: list = [None] * len(wanted)
        for c in {c for c, _ in wanted}:
            slots = [i for i, (of, _) in enumerate(wanted) if of == c]
            for i, split in zip(slots, best_splits(found[:, slots], allowed[c], p)):
                out[i] = split, found[:, i, 0].sum(axis=1)
        return out

    return grown(classes, p, splits)


def _columns(p: Boosting, d: int, classes: int, seed: int, turn: int) -> list[np.ndarray]:
    n = max(1, round(p.columns * d))
    return [np.random.default_rng((seed, turn, c)).permutation(d)[:n] for c in range(classes)]


def _prior(counts: np.ndarray) -> np.ndarray:
    """Starting scores: log odds of two classes, else log shares."""
    share = np.maximum(counts, 1e-9) / max(counts.sum(), 1e-9)
    return np.log(share[1:] / share[:1]) if len(counts) == 2 else np.log(share)


def _packed(trees: Sequence[Tree]) -> bytes:
    """Trees as plain arrays: about 33 bytes a node."""
    out = io.BytesIO()
    np.savez(out, size=np.array([len(t.feature) for t in trees], np.int32), sums=np.concatenate([s for t in trees for s in t.sums]),
             **{name: np.concatenate([getattr(t, name) for t in trees]).astype(kind) for name, kind in _NODES.items()})
    return out.getvalue()


def _packs(rounds: Iterator[list[Tree]]) -> Iterator[bytes]:
    """Rounds in order, a few in each piece."""
    trees, nodes = [], 0
    for of_round in rounds:
        trees += of_round
        nodes += sum(len(t.feature) for t in of_round)
        if nodes * 33 >= PACKED:
            yield _packed(trees)
            trees, nodes = [], 0
    if trees:
        yield _packed(trees)


#: What a tree keeps of its nodes besides their sums.
_NODES = {"feature": np.int32, "bin": np.uint8, "left": np.int32, "depth": np.int16}


class Rounds(Sequence):
    """Rounds of ``classes`` trees each, read when they are first asked for; trees are made one at a time."""

    def __init__(self, classes: int, read: Callable[[], Sequence[bytes]]):
        self._classes, self._read, self._arrays = classes, read, None

    def _found(self) -> dict[str, np.ndarray]:
        if self._arrays is None:
            packs = [np.load(io.BytesIO(b)) for b in self._read()]
            kinds = {"size": np.int32, "sums": float, **_NODES}
            self._arrays = {n: np.concatenate([p[n] for p in packs]) if packs else np.empty(0, k) for n, k in kinds.items()}
            self._arrays["end"] = self._arrays["size"].cumsum(dtype=np.int64)
        return self._arrays

    def __len__(self) -> int:
        return len(self._found()["size"]) // self._classes

    def __getitem__(self, i):
        if isinstance(i, slice):
            return [self[j] for j in range(*i.indices(len(self)))]
        if not -len(self) <= i < len(self):
            raise IndexError(i)
        first = i % len(self) * self._classes
        return [self._tree(j) for j in range(first, first + self._classes)]

    def _tree(self, i: int) -> Tree:
        a = self._found()
        here = slice(a["end"][i] - a["size"][i], a["end"][i])
        return Tree(*(a[n][here].tolist() for n in _NODES), list(a["sums"].reshape(-1, 3)[here]), [None] * int(a["size"][i]))


@dataclass
class BoostedModel:
    """Rounds of trees; ``transform`` adds ``probs ARRAY<DOUBLE>`` to rows with a vector column ``features``."""

    prior: np.ndarray
    edges: list[np.ndarray]
    rounds: Sequence[list[Tree]]
    settings: Boosting

    def flat(self) -> tuple[list, np.ndarray]:
        """What ``scores`` needs: per tree the features it asks, its splits and the leaves that these close; values.

        Leaves are numbered from left to right, with a bit each. A split answered by "right" closes the leaves on its
        left side; the first leaf left open is the one a row reaches, whatever the order of the splits.
        """
        words = -(-max((t.feature.count(-1) for r in self.rounds for t in r), default=1) // 64)
        width = self._width()
        splits, value = [], np.zeros((len(self.rounds) * len(self.prior), 64 * words))
        for i, t in enumerate(t for r in self.rounds for t in r):
            order, first, todo = [], [0] * len(t.feature), [(0, False)]
            while todo:
                node, done = todo.pop()
                if not done:
                    first[node] = len(order)
                if t.feature[node] < 0:
                    order.append(node)
                elif not done:
                    todo += [(t.left[node] + 1, False), (t.left[node], False)]
            value[i, :len(order)] = t.values(self.settings)[order]
            inner = [node for node, f in enumerate(t.feature) if f >= 0]
            asked = sorted({t.feature[node] for node in inner})
            at = [asked.index(t.feature[node]) * width + t.bin[node] + 1 for node in inner]
            closed = [(1 << first[t.left[node] + 1]) - (1 << first[node]) for node in inner]
            still = [[~c >> 64 * w & int(ALL_OPEN) for c in closed] for w in range(words)]
            splits.append((np.array(asked, np.int32), np.array(at, np.int32), np.array(still, np.uint64).reshape(words, -1)))
        return splits, value

    def _width(self) -> int:
        return max((len(e) for e in self.edges), default=0) + 2

    def scores(self, x: np.ndarray, flat: tuple[list, np.ndarray]) -> np.ndarray:
        splits, value = flat
        k, width = len(self.prior), self._width()
        out = np.tile(self.prior, (len(x), 1))
        for start in range(0, len(x), SCORED):
            bins = np.ascontiguousarray(binned(x[start:start + SCORED], self.edges).T.astype(np.int64))
            n = bins.shape[1]
            left, more, sums = np.empty(n, np.uint64), np.empty(n, np.uint64), np.zeros((k, n))
            for i, (asked, at, still) in enumerate(splits):
                leaf = np.full(n, -1)
                for w, masks in enumerate(still):
                    # Per feature and bin the leaves that no split on this feature closes.
                    table = np.full(len(asked) * width, ALL_OPEN)
                    np.bitwise_and.at(table, at, masks)
                    table = np.bitwise_and.accumulate(table.reshape(len(asked), width), axis=1)
                    left.fill(ALL_OPEN)
                    for f, line in zip(asked, table):
                        np.take(line, bins[f], out=more, mode="clip")
                        left &= more
                    # The place of the lowest bit is the number of bits below it.
                    lowest = np.bitwise_count((left & (~left + np.uint64(1))) - np.uint64(1)).astype(np.int64)
                    leaf = np.where((leaf < 0) & (left > 0), 64 * w + lowest, leaf)
                sums[i % k] += value[i].take(leaf)
            out[start:start + n] += sums.T
        return out

    def probabilities(self, x: np.ndarray, flat: tuple[np.ndarray, ...]) -> np.ndarray:
        s = self.scores(x, flat)
        if s.shape[1] == 1:
            p = 1 / (1 + np.exp(-s))
            return np.hstack([1 - p, p])
        p = np.exp(s - s.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def transform(self, rows: DataFrame, features: str = "features") -> DataFrame:
        # Splits and values are all a task needs, and less than the trees.
        model, d, flat = BoostedModel(self.prior, self.edges, [], self.settings), len(self.edges), self.flat()

        @F.arrow_udf("array<double>")
        def probabilities(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                found = model.probabilities(batch.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d), flat)
                n, k = found.shape
                yield pa.ListArray.from_arrays(np.arange(0, (n + 1) * k, k, np.int32), found.ravel())

        return rows.withColumn("probs", probabilities(vector_to_array(features)))

    def leaves(self) -> Leaves:
        """Ranges and log-odds of all leaves of a model of two classes; the start is a leaf of its own."""
        d = len(self.edges)
        low, high, value = [np.full(d, -np.inf)], [np.full(d, np.inf)], [float(self.prior[0])]
        for t in (t for r in self.rounds for t in r):
            values, todo = t.values(self.settings), [(0, np.full(d, -np.inf), np.full(d, np.inf))]
            while todo:
                node, lo, hi = todo.pop()
                f = t.feature[node]
                if f < 0:
                    low.append(lo)
                    high.append(hi)
                    value.append(values[node])
                    continue
                cut = self.edges[f][t.bin[node]]
                left, right = hi.copy(), lo.copy()
                left[f], right[f] = min(hi[f], cut), max(lo[f], cut)
                todo += [(t.left[node], lo, left), (t.left[node] + 1, right, hi)]
        return Leaves(np.array(low), np.array(high), np.array(value))

    def paths(self) -> Paths:
        """Paths to all leaves of a model of two classes; covers are the sums of hessians of the fit."""
        trees = []
        for t in (t for r in self.rounds for t in r):
            cuts = [self.edges[f][b] if f >= 0 else np.inf for f, b in zip(t.feature, t.bin)]
            trees.append(TreeNodes(t.feature, cuts, t.left, [at + 1 for at in t.left], t.values(self.settings),
                                   [0.0 if s is None else float(s[1]) for s in t.sums]))
        return paths(trees, float(self.prior[0]))


def _prepared(rows: DataFrame, key: str | None) -> DataFrame:
    """``key, label, x``; rows without label or vector cannot be learned from."""
    x = vector_to_array("features")
    of_row = F.xxhash64(F.col(key)) if key and key in rows.columns else F.xxhash64(x, F.col("label"))
    return rows.where("label is not null and features is not null").withColumn("key", of_row).withColumn("x", x)


def _edges(found: Sequence[Sequence[float]], bins: int) -> list[np.ndarray]:
    return [np.unique(np.array([v for v in (e or []) if v == v], float))[:min(bins, 255)] for e in found]


def _fitted(keys: np.ndarray, labels: np.ndarray, x: np.ndarray, edges: list[np.ndarray], classes: int, p: Boosting,
            seed: int) -> BoostedModel:
    """All rounds over rows held in one place."""
    bins = np.ascontiguousarray(binned(x, edges).T)
    cuts = np.array([len(e) for e in edges])
    width = int(cuts.max(initial=0)) + 1
    model = BoostedModel(_prior(np.bincount(labels, minlength=classes)), edges, [], p)
    scores = np.tile(model.prior, (len(labels), 1))
    for turn in range(p.rounds):
        used = np.flatnonzero(_drawn(keys, seed, turn, p.rows))
        g, h = gradients(scores, labels)
        part, gu, hu = np.take(bins, used, axis=1), g[used], h[used]
        # Classes one after the other: only the features a tree may use are summed.
        trees = []
        for c, columns in enumerate(_columns(p, len(cuts), scores.shape[1], seed, turn)):
            columns = np.sort(columns)
            held = _Held(part[columns], np.ascontiguousarray(gu[:, c]), np.ascontiguousarray(hu[:, c]), width)
            grown = grow(1, [np.arange(len(columns))], cuts[columns], p, held)[0]
            grown.feature = [int(columns[f]) if f >= 0 else -1 for f in grown.feature]
            scores[:, c] += grown.values(p)[grown.place(bins.T)]
            trees.append(grown)
        model.rounds.append(trees)
    return model


def _space(shape: tuple[int, ...], kind: type) -> np.ndarray:
    """Room for numbers: many lie in a file without a name, which is gone with its task."""
    if np.prod(shape, dtype=float) * np.dtype(kind).itemsize <= IN_MEMORY:
        return np.empty(shape, kind)
    return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=shape)


def _blocks(n: int) -> Iterator[slice]:
    return (slice(at, min(at + BLOCK, n)) for at in range(0, n, BLOCK))


class _Post:
    """Messages among tasks that run at the same time, as files in the shared folder.

    Spark's own barrier looks once a second whether all have come, too seldom for the steps of a fit; it is asked once,
    for a name that no other attempt has.
    """

    def __init__(self, store: fs.FileSystem, path: str, rank: int, tasks: int):
        self.store, self.path, self.rank, self.tasks, self.n = store, path, rank, tasks, 0

    def put(self, data: pa.Buffer) -> None:
        self.n += 1
        with self.store.open_output_stream(self._name(self.rank, self.n) + ".part") as out:
            out.write(data)
        self.store.move(self._name(self.rank, self.n) + ".part", self._name(self.rank, self.n))
        # One of the last two messages was read by this task from all others, so they have read what is before.
        if self.n > 3:
            self.store.delete_file(self._name(self.rank, self.n - 3))

    def get(self, task: int, size: int | None = None, offset: int = 0) -> bytes:
        """A task's newest message, or a part of it; waits for it. If a task ends early Spark ends all."""
        wait = 0.0002
        while True:
            try:
                with self.store.open_input_file(self._name(task, self.n)) as f:
                    return f.read() if size is None else f.read_at(size, offset)
            except FileNotFoundError:
                time.sleep(wait)
                wait = min(2 * wait, 0.005)

    def close(self) -> None:
        """Waits for all and removes what is left but empty messages."""
        self.put(pa.py_buffer(b""))
        for i in range(self.tasks):
            self.get(i)
        for n in range(max(1, self.n - 2), self.n):
            self.store.delete_file(self._name(self.rank, n))

    def _name(self, task: int, n: int) -> str:
        return f"{self.path}-{task}-{n}"


class _Dealt:
    """Best splits for ``grown`` over rows dealt over tasks that wait for each other.

    Each task sums its own rows; of two children of many rows only the one with fewer rows in all. The sums are laid
    down in the shared folder, features first, and each task adds up its share of the features. Then all learn the best
    splits of each.
    """

    def __init__(self, post: _Post, bins: np.ndarray, g: np.ndarray, h: np.ndarray, used: np.ndarray,
                 columns: list[np.ndarray], cuts: np.ndarray, width: int, p: Boosting):
        self.post, tasks = post, post.tasks
        self.bins, self.g, self.h, self.columns, self.cuts, self.width, self.p = bins, g, h, columns, cuts, width, p
        self.rows = [{0: used} for _ in columns]
        self.found: list[dict[int, np.ndarray]] = [{} for _ in columns]
        bounds = [-(-i * len(columns[0]) // tasks) for i in range(tasks + 1)]
        self.first, self.last = bounds[post.rank], bounds[post.rank + 1]

    def __call__(self, trees: list[Tree], wanted: Wanted) -> list[tuple[Split | None, np.ndarray | None]]:
        summed, left_over = [], []
        for c in sorted({c for c, _ in wanted}):
            tree, rows, found, asked = trees[c], self.rows[c], self.found[c], {n for of, n in wanted if of == c}
            if 0 in asked:
                summed.append((c, 0))
                continue
            for n in [n for n in found if tree.feature[n] >= 0 and {tree.left[n], tree.left[n] + 1} & asked]:
                here, of_parent, left = rows.pop(n), found.pop(n), tree.left[n]
                right = self.bins[tree.feature[n]].take(here, mode="clip") > tree.bin[n]
                rows[left], rows[left + 1] = here[~right], here[right]
                if tree.sums[n][2] < SUBTRACTED:
                    summed += [(c, child) for child in (left, left + 1) if child in asked]
                    continue
                small = left + int(tree.sums[left + 1][2] < tree.sums[left][2])
                summed.append((c, small))
                left_over.append((c, 2 * left + 1 - small, of_parent, small))
        total = self._together(self._own(summed))
        for i, (c, n) in enumerate(summed):
            self.found[c][n] = np.ascontiguousarray(total[:, i].transpose(1, 0, 2))
        for c, node, of_parent, small in left_over:
            rest = of_parent - self.found[c][small]
            rest[:2, rest[2] == 0] = 0
            self.found[c][node] = rest
        return self._best(wanted)

    def _own(self, summed: Wanted) -> np.ndarray:
        """Sums of this task's rows per (feature, class and node, kind, bin)."""
        out = np.zeros((len(self.columns[0]), len(summed), 3, self.width))
        for c in sorted({c for c, _ in summed}):
            slots = [i for i, (of, _) in enumerate(summed) if of == c]
            groups = [self.rows[c][summed[i][1]] for i in slots]
            # Many rows are summed piece by piece, few together.
            many = [j for j, rows in enumerate(groups) if len(rows) > BLOCK]
            for j in many:
                for piece in _blocks(len(groups[j])):
                    out[:, slots[j]] += _sums(self.bins, self.g[c], self.h[c], [groups[j][piece]], self.width,
                                              self.columns[c])[:, 0].transpose(1, 0, 2)
            few = [j for j in range(len(groups)) if j not in many]
            if few:
                out[:, [slots[j] for j in few]] = _sums(self.bins, self.g[c], self.h[c], [groups[j] for j in few], self.width,
                                                        self.columns[c]).transpose(2, 1, 0, 3)
        return out

    def _together(self, own: np.ndarray) -> np.ndarray:
        """This task's features, summed over all tasks, always in the same order."""
        self.post.put(pa.py_buffer(own))
        shape = (self.last - self.first, *own.shape[1:])
        total, line = np.zeros(shape), own[0].nbytes
        for i in range(self.post.tasks if self.last > self.first else 0):
            total += np.frombuffer(self.post.get(i, line * shape[0], line * self.first)).reshape(shape)
        return total

    def _best(self, wanted: Wanted) -> list[tuple[Split | None, np.ndarray | None]]:
        # Gain, feature, bin, sums of the left side, sums of all.
        best = np.full((len(wanted), 9), -np.inf)
        for c in {c for c, _ in wanted} if self.last > self.first else ():
            slots = [i for i, (of, _) in enumerate(wanted) if of == c]
            mine, sums = self.columns[c][self.first:self.last], [self.found[c][wanted[i][1]] for i in slots]
            for i, split, of_node in zip(slots, best_splits(np.stack(sums, axis=1), self.cuts[mine], self.p), sums):
                best[i, 6:] = of_node[:, 0].sum(axis=1)
                if split:
                    best[i, :6] = split[0], mine[split[1]], split[2], *split[3]
        self.post.put(pa.py_buffer(best))
        best = np.stack([np.frombuffer(self.post.get(i)).reshape(-1, 9) for i in range(self.post.tasks)])
        out = []
        for i, at in enumerate(best[:, :, 0].argmax(axis=0)):
            found = best[at, i]
            split = (float(found[0]), int(found[1]), int(found[2]), found[3:6].copy()) if found[0] > -np.inf else None
            # The first task has the first feature.
            out.append((split, best[0, i, 6:].copy()))
        return out


def fit_together(known: DataFrame, p: Boosting, edges: list[np.ndarray], classes: int, seed: int, tasks: int) -> DataFrame:
    """``prior, at, trees`` of a fit on all rows of ``known`` (``key, label, x``), dealt over tasks that run at the same time.

    A task keeps its rows in files of its own and works on a block of them at a time; what it holds beside that are
    keys, labels and numbers of rows per class, and the sums of the nodes still open.
    """
    d, k = len(edges), 1 if classes == 2 else classes
    cuts = np.array([len(e) for e in edges])
    width = int(cuts.max(initial=0)) + 1
    folder = shared_folder(known.sparkSession, "sums")
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        keys, labels, lines = [np.empty(0, np.int64)], [np.empty(0, np.int64)], tempfile.TemporaryFile()
        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            labels.append(batch.column(1).to_numpy())
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, d)
            lines.write(binned(x, edges))
        keys, labels = np.concatenate(keys), np.concatenate(labels)
        n = len(keys)
        bins, scores, g, h = _space((d, n), np.uint8), *(_space((k, n), float) for _ in range(3))
        lines.seek(0)
        for b in _blocks(n):
            bins[:, b] = np.frombuffer(lines.read((b.stop - b.start) * d), np.uint8).reshape(-1, d).T
        lines.close()
        told = [json.loads(m) for m in context.allGather(json.dumps([uuid.uuid4().hex, np.bincount(labels, minlength=classes).tolist()]))]
        post = _Post(*fs.FileSystem.from_uri(f"{folder}/{told[0][0]}"), context.partitionId(), tasks)
        prior = _prior(np.sum([counts for _, counts in told], axis=0))
        scores[:] = prior[:, None]

        def rounds() -> Iterator[list[Tree]]:
            for turn in range(p.rounds):
                used = [np.empty(0, np.int32)]
                for b in _blocks(n):
                    used.append((np.flatnonzero(_drawn(keys[b], seed, turn, p.rows)) + b.start).astype(np.int32))
                    slopes = gradients(scores[:, b].T, labels[b])
                    g[:, b], h[:, b] = slopes[0].T, slopes[1].T
                columns = [np.sort(c) for c in _columns(p, d, k, seed, turn)]
                trees = grown(k, p, _Dealt(post, bins, g, h, np.concatenate(used), columns, cuts, width, p))
                for b in _blocks(n):
                    for c, t in enumerate(trees):
                        scores[c, b] += t.values(p)[t.place(bins[:, b].T)]
                yield trees
            post.close()

        packs = _packs(rounds())
        # All tasks have the same trees, one tells them.
        at = -1
        for at, pack in enumerate(packs):
            if context.partitionId() == 0:
                yield pa.RecordBatch.from_arrays([pa.array([prior], pa.list_(pa.float64())), pa.array([at], pa.int32()),
                                                  pa.array([pack], pa.binary())], ["prior", "at", "trees"])
        if at < 0 and context.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([prior], pa.list_(pa.float64())), pa.array([0], pa.int32()),
                                              pa.array([None], pa.binary())], ["prior", "at", "trees"])

    return known.repartition(tasks).mapInArrow(run, _TREES, barrier=True)


#: Schema of packed trees.
_TREES = "prior array<double>, at int, trees binary"


def _tasks_together(spark, n: int) -> int:
    """Tasks for a fit of ``n`` rows that can run at the same time and reach the shared folder; 0 if there are none."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 0
    try:
        fs.FileSystem.from_uri(shared_folder(spark, "sums"))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return 0
    context = spark.sparkContext._jsc.sc()
    slots = context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())
    return min(slots, -(-n // LEAST_ROWS))


@dataclass(frozen=True)
class Booster:
    """Fits on all rows with ``features`` (vector) and ``label`` (0, 1, ...); with ``fit_rows`` on about so many, drawn by hash."""

    settings: Boosting
    seed: int = 42
    fit_rows: int | None = None

    def fit(self, rows: DataFrame, key: str | None = "customer_id") -> BoostedModel:
        return self.fit_parts(rows.withColumn("part", F.array(F.lit(0))), key)[0]

    def fit_parts(self, rows: DataFrame, key: str | None = "customer_id") -> dict[int, BoostedModel]:
        """A model per number in the array column ``part``.

        Parts of up to ``HELD`` rows are fitted side by side, each by a task of its own; larger ones one after the
        other, each by all tasks that can run at the same time. Trees stay in the shared folder until they are asked for.
        """
        p, seed = self.settings, self.seed
        known = _prepared(rows, key).select("key", F.col("label").cast("int").alias("label"), "x", F.explode("part").alias("part"))
        d = known.agg(F.max(F.size("x"))).first()[0] or 0
        facts = cut_points(known, d, p.bins)
        if not facts:
            raise ValueError("no labelled rows to fit on")
        edges = {part: _edges(found, p.bins) for part, (_, _, found) in facts.items()}
        classes = max([2, *(top + 1 for _, top, _ in facts.values())])
        sizes = {part: n for part, (n, _, _) in facts.items()}
        if self.fit_rows is not None:
            share = F.create_map(*[F.lit(v) for part, n in sizes.items() for v in (part, min(1.0, self.fit_rows / n))])
            known = known.where(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) < share[F.col("part")] * (1 << 30))
            sizes = {part: min(n, self.fit_rows) for part, n in sizes.items()}

        def run(table: pa.Table) -> pa.Table:
            part = table.column("part")[0].as_py()
            keys, labels = (table.column(n).to_numpy() for n in ("key", "label"))
            x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1)
            order = np.lexsort((labels, keys))
            model = _fitted(keys[order], labels[order].astype(np.int64), x[order], edges[part], classes, p, seed)
            packs = list(_packs(iter(model.rounds))) or [None]
            return pa.Table.from_arrays([pa.array([part] * len(packs), pa.int32()), pa.array([model.prior] * len(packs), pa.list_(pa.float64())),
                                         pa.array(range(len(packs)), pa.int32()), pa.array(packs, pa.binary())],
                                        names=["part", "prior", "at", "trees"])

        held = [part for part, n in sizes.items() if n <= HELD]
        models: dict[int, BoostedModel] = {}
        if held:
            made = written(known.where(F.col("part").isin(held)).groupBy("part").applyInArrow(run, f"part int, {_TREES}"), "trees")
            for r in made.where("at = 0").select("part", "prior").collect():
                models[r["part"]] = _stored(made.where(F.col("part") == r["part"]), r["prior"], edges[r["part"]], p)
        for part in sorted(sizes.keys() - set(held)):
            own = known.where(F.col("part") == part).select("key", "label", "x")
            tasks = _tasks_together(rows.sparkSession, sizes[part])
            if tasks:
                made = written(fit_together(own, p, edges[part], classes, seed, tasks), "trees")
                models[part] = _stored(made, made.where("at = 0").first()["prior"], edges[part], p)
            else:
                models[part] = _fit_passes(own, p, edges[part], classes, seed)
        return models


def _stored(made: DataFrame, prior: Sequence[float], edges: list[np.ndarray], p: Boosting) -> BoostedModel:
    def read() -> list[bytes]:
        return [bytes(r["trees"]) for r in made.orderBy("at").select("trees").where("trees is not null").collect()]
    return BoostedModel(np.array(prior), edges, Rounds(len(prior), read), p)


def fit_distributed(rows: DataFrame, settings: Boosting, seed: int = 42, key: str | None = "customer_id",
                    edges: Sequence[Sequence[float]] | None = None) -> BoostedModel:
    """Fits on all rows, each round by passes over them; ``edges`` are bounds per feature to use as they are."""
    known = _prepared(rows, key).select("key", F.col("label").cast("int").alias("label"), "x")
    d = known.agg(F.max(F.size("x"))).first()[0]
    if d is None:
        raise ValueError("no labelled rows to fit on")
    if edges is None:
        edges = cut_points(known.withColumn("part", F.lit(0)), d, settings.bins)[0][2]
    return _fit_passes(known, settings, _edges(edges, settings.bins), 2, seed)


def _fit_passes(known: DataFrame, p: Boosting, bounds: list[np.ndarray], classes: int, seed: int) -> BoostedModel:
    d, cuts = len(bounds), np.array([len(e) for e in bounds])
    width = int(cuts.max(initial=0)) + 1
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    prior = _prior(np.array([counts.get(c, 0) for c in range(max(classes, max(counts) + 1))], float))
    model, k = BoostedModel(prior, bounds, [], p), len(prior)

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            n = batch.num_rows
            if n:
                bins = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(n, d)
                yield (batch.column(0).to_numpy(), batch.column(1).to_numpy(), bins,
                       np.array(batch.column(3).to_pylist(), float).reshape(n, k))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = binned(np.array(batch.column(2).to_pylist(), float).reshape(-1, d), bounds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r.tobytes() for r in bins], pa.binary()),
                 pa.array([prior] * len(bins), pa.list_(pa.float64()))], ["key", "label", "bins", "scores"])

    schema = "key long, label int, bins binary, scores array<double>"
    state = written(known.mapInArrow(cut, schema), "bins")
    fresh: list[list[Tree]] = []

    def with_rounds(scores: np.ndarray, bins: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
        for trees in rounds:
            for c, t in enumerate(trees):
                scores[:, c] += t.values(p)[t.place(bins)]
        return scores

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, (_, _, bins, scores) in ((b, next(batches_of(iter([b])))) for b in batches if b.num_rows):
            yield batch.set_column(3, "scores", pa.array(list(with_rounds(scores, bins, fresh)), pa.list_(pa.float64())))

    for turn in range(p.rounds):
        def sums(trees: list[Tree], wanted: Wanted, turn: int = turn) -> np.ndarray:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                out = np.zeros((3, len(wanted), d, width))
                for keys, labels, bins, scores in batches_of(batches):
                    used = _drawn(keys, seed, turn, p.rows)
                    g, h = gradients(with_rounds(scores[used], bins[used], fresh), labels[used])
                    out += histograms(bins[used], g, h, trees, wanted, width)
                flat = out.reshape(3, -1)
                at = np.flatnonzero(flat[2])
                yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(kind[at]) for kind in flat)], ["at", "g", "h", "n"])

            total = state.mapInArrow(run, "at long, g double, h double, n double").groupBy("at").agg(
                *(F.sum(c).alias(c) for c in "ghn")).toArrow()
            out = np.zeros((3, len(wanted) * d * width))
            out[:, total.column("at").to_numpy()] = np.stack([total.column(c).to_numpy() for c in "ghn"])
            return out.reshape(3, len(wanted), d, width)

        trees = grow(k, _columns(p, d, k, seed, turn), cuts, p, sums)
        model.rounds.append(trees)
        fresh.append(trees)
        if len(fresh) == KEEP_EVERY:
            state = written(state.mapInArrow(moved, schema), "scores")
            fresh = []
    return model


def as_table(spark, model: BoostedModel) -> DataFrame:
    """``round, class, node, feature, threshold, left, rows, gradient, hessian, value`` of every node; leaves lack a feature."""
    out = []
    for turn, trees in enumerate(model.rounds):
        for c, t in enumerate(trees):
            for node, (f, s, v) in enumerate(zip(t.feature, t.sums, t.values(model.settings))):
                inner = f >= 0
                out.append((turn, c, node, f if inner else None, float(model.edges[f][t.bin[node]]) if inner else None,
                            t.left[node] if inner else None, int(s[2]), float(s[0]), float(s[1]), float(v)))
    return spark.createDataFrame(out, "round int, class int, node int, feature int, threshold double, left int, "
                                      "rows long, gradient double, hessian double, value double")
