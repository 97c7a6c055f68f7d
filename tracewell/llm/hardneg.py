"""Hard negatives by spanning-tree bounds over anchors.

The anchors are cut into blocks, and every block is joined to a minimum spanning tree by distance. A candidate that has
score s at a parent anchor scores s plus or minus (edge length times candidate norm) at the child, so the walk down the
tree rescores only candidates whose bounds overlap what the child still wants: rows of the same label that may reach its
best positives, then rows of other labels that may fall into a score window under one of them. Candidates stay where
they are read; only anchors and short lists of best rows move.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm import common

#: Anchors of one tree, before the spread of hashing; bytes of anchor vectors that travel to the tasks in one round.
BLOCK = 2_048
ROUND_BYTES = 64 << 20
#: Candidates that walk a tree together.
STEP = 1_024


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): rows that take part, labels as they are, components floor(256 x) as doubles."""
    finite = F.forall("embedding", lambda x: F.coalesce((F.abs(x.cast("double")) < F.lit(math.inf)) & ~F.isnan(x), F.lit(False)))
    kept = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                       F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("v"))


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prim's minimum spanning tree: (order of visit, place of the parent in that order or -1, edge length)."""
    n = len(points)
    squared = np.einsum("ij,ij->i", points, points)
    order, parent, edge = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n)
    near, link = np.full(n, np.inf), np.full(n, -1, np.int64)
    done = np.zeros(n, bool)
    at = 0
    for place in range(n):
        order[place], parent[place], edge[place] = at, link[at], 0.0 if place == 0 else math.sqrt(near[at])
        done[at] = True
        away = np.maximum(squared + squared[at] - 2.0 * (points @ points[at]), 0.0)
        closer = (away < near) & ~done
        near[closer], link[closer] = away[closer], place
        at = int(np.argmin(np.where(done, np.inf, near)))
    return order, parent, edge


class Tree:
    """One block of anchors in the order of its tree."""

    def __init__(self, ids, labels, points, parent, edge):
        self.ids, self.labels, self.points, self.parent = ids, labels, points, parent
        self.edge = edge * (1.0 + 1e-9)
        self.rescored = 0

    def walk(self, x: np.ndarray, wanted, use) -> None:
        """Call ``use(place, rows, scores)`` for every anchor with the candidates that ``wanted(place, low, high)`` lets in."""
        norms = np.sqrt(np.einsum("ij,ij->i", x, x)) * (1.0 + 1e-9)
        low, high = np.empty((len(self.ids), len(x))), np.empty((len(self.ids), len(x)))
        for j, p in enumerate(self.parent):
            if p < 0:
                rows = np.arange(len(x))
            else:
                reach = self.edge[j] * norms + 1.0
                low[j], high[j] = low[p] - reach, high[p] + reach
                rows = np.flatnonzero(wanted(j, low[j], high[j]))
            scores = x[rows] @ self.points[j]
            self.rescored += len(rows)
            low[j, rows] = high[j, rows] = scores
            use(j, rows, scores)


class Best:
    """The first ``size`` rows by falling score, then rising id."""

    def __init__(self, size: int, floor: float = -math.inf):
        self.size, self.floor = size, floor
        self.scores, self.ids = np.empty(0), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(scores):
            return
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        first = np.lexsort((ids, -scores))[:self.size]
        self.scores, self.ids = scores[first], ids[first]
        if len(first) == self.size:
            self.floor = max(self.floor, self.scores[-1])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _steps(batches: Iterator[pa.RecordBatch]):
    """(ids, labels, matrix) of candidates of one vector length, in steps."""
    for batch in batches:
        widths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
        for width in np.unique(widths):
            same = batch.take(pa.array(np.flatnonzero(widths == width)))
            ids, labels = same.column("vec_id").to_numpy(), same.column("label").to_numpy()
            x = _matrix(same.column("v"), int(width))
            for at in range(0, len(ids), STEP):
                yield ids[at:at + STEP], labels[at:at + STEP], x[at:at + STEP]


def _kth_largest(values: np.ndarray, k: int, floor: float) -> float:
    return float(np.partition(values, len(values) - k)[-k]) if len(values) >= k else floor


def best_positives(trees: list[Tree], batches, count: int):
    """Per tree and anchor the best rows of its label among the candidates of this task."""
    found = []
    for tree in trees:
        own = tree.points @ tree.points.T
        same = tree.labels[:, None] == tree.labels[None, :]
        np.fill_diagonal(same, False)
        found.append([Best(count, _kth_largest(own[j, same[j]], count, -math.inf)) for j in range(len(tree.ids))])
    for ids, labels, x in _steps(batches):
        for tree, best in zip(trees, found):
            if tree.points.shape[1] != x.shape[1]:
                continue

            def wanted(j, low, high):
                return (labels == tree.labels[j]) & (high >= best[j].floor)

            def use(j, rows, scores):
                keep = (labels[rows] == tree.labels[j]) & (ids[rows] != tree.ids[j]) & (scores >= best[j].floor)
                best[j].add(scores[keep], ids[rows[keep]])

            tree.walk(x, wanted, use)
    return found


def best_negatives(trees: list[Tree], positives: dict[int, list[tuple[int, int]]], batches, count: int, share: tuple[int, int]):
    """Per tree, anchor and positive: (positive id, its score, lower and upper end of the window, best rows in it)."""
    found = []
    for tree in trees:
        own = tree.points @ tree.points.T
        lists = []
        for j, anchor in enumerate(tree.ids):
            other = own[j, tree.labels != tree.labels[j]]
            windows = []
            for positive, score in positives.get(int(anchor), []):
                least, most = -(-share[0] * score // 100), share[1] * score // 100
                inside = other[(other >= least) & (other <= most)]
                if least <= most:
                    windows.append((positive, score, most, Best(count, _kth_largest(inside, count, least))))
            lists.append(windows)
        found.append(lists)
    for ids, labels, x in _steps(batches):
        for tree, lists in zip(trees, found):
            if tree.points.shape[1] != x.shape[1]:
                continue

            def wanted(j, low, high):
                if not lists[j]:
                    return np.zeros(len(low), bool)
                return ((labels != tree.labels[j]) & (low <= max(w[2] for w in lists[j]))
                        & (high >= min(w[3].floor for w in lists[j])))

            def use(j, rows, scores):
                other = labels[rows] != tree.labels[j]
                for _, _, most, best in lists[j]:
                    keep = other & (scores >= best.floor) & (scores <= most)
                    best.add(scores[keep], ids[rows[keep]])

            tree.walk(x, wanted, use)
    return found


def _plant(rows: DataFrame, anchors_of: int) -> tuple[DataFrame, int, int]:
    """(tree rows of all anchors, number of blocks, longest vector); repeated ids count once, with the smallest (label, vector)."""
    anchors = (rows.filter(F.col("vec_id") % anchors_of == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("_a"))
               .select("vec_id", "_a.label", "_a.v", F.size("_a.v").alias("width")))
    total, widest = anchors.agg(F.count(F.lit(1)), F.max("width")).first()
    blocks = max(1, math.ceil(total / BLOCK))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", ignore_index=True)
        order, parent, edge = spanning_tree(np.array(pdf["v"].tolist(), dtype=float).reshape(len(pdf), -1))
        return pdf.iloc[order].assign(place=np.arange(len(pdf)), parent=parent, edge=edge)

    staged = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    schema = "vec_id long, label long, v array<double>, width int, block int, place long, parent long, edge double"
    return staged.groupBy("block", "width").applyInPandas(grow, schema), blocks, int(widest or 0)


def _trees(found: list) -> list[Tree]:
    groups: dict[tuple[int, int], list] = {}
    for row in found:
        groups.setdefault((row["block"], row["width"]), []).append(row)
    made = []
    for (_, width), members in sorted(groups.items()):
        members.sort(key=lambda r: r["place"])
        made.append(Tree(np.array([r["vec_id"] for r in members]), np.array([r["label"] for r in members]),
                         np.array([r["v"] for r in members], dtype=float).reshape(len(members), width),
                         np.array([r["parent"] for r in members]), np.array([r["edge"] for r in members])))
    return made


def mine(vectors: DataFrame, *, anchors_of: int = 100, positives: int = 5, negatives: int = 10, share: tuple[int, int] = (30, 90),
         round_bytes: int = ROUND_BYTES) -> DataFrame:
    """Hard negatives of every anchor and positive, for ``vectors`` with vec_id, label and embedding.

    Anchors are rows whose id is divisible by ``anchors_of``. Returns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score: for each of an anchor's best ``positives`` rows of its own label, the best
    ``negatives`` rows of other labels whose score lies within ``share`` percent of the positive's. Ties go to the
    smaller id. Rows with a null id, label or vector, or with a null or non-finite component take no part; vectors of
    unequal length are not compared, empty ones score 0. Repeated rows are rows of their own, but an anchor id counts
    once, with its smallest (label, vector), and no row is a positive of its own id. A negative positive score has an
    empty window. Scores are exact while the product of two norms of floor(256 x) stays below 2^53. Other columns are
    ignored.

    Anchors reach the tasks in rounds of at most about ``round_bytes``; a round reads the candidates twice without
    shuffling them. The number of tasks follows the cores, so partial lists grow with the anchors alone.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    grown, blocks, widest = _plant(rows, anchors_of)
    grown = common.landed(grown, "trees")
    per_round = max(1, round_bytes // (8 * BLOCK * max(widest, 1)))
    candidates = rows.coalesce(3 * spark.sparkContext.defaultParallelism)
    parts = []
    for start in range(0, blocks, per_round):
        trees = _trees(grown.filter(F.col("block").between(start, start + per_round - 1)).collect())
        planted = spark.sparkContext.broadcast(trees)

        def positive_lists(batches, planted=planted):
            for tree, best in zip(planted.value, best_positives(planted.value, batches, positives)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(tree.ids, [len(b.ids) for b in best]), pa.int64()),
                     pa.array(np.concatenate([b.ids for b in best]), pa.int64()),
                     pa.array(np.concatenate([b.scores for b in best]).astype(np.int64), pa.int64())],
                    names=["anchor_id", "positive_id", "positive_score"])

        first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
        lists = (candidates.mapInArrow(positive_lists, "anchor_id long, positive_id long, positive_score long")
                 .withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= positives))
        wanted: dict[int, list[tuple[int, int]]] = {}
        for row in lists.select("anchor_id", "positive_id", "positive_score").distinct().collect():
            wanted.setdefault(row[0], []).append((row[1], row[2]))
        chosen = spark.sparkContext.broadcast(wanted)

        def negative_lists(batches, planted=planted, chosen=chosen):
            for tree, lists in zip(planted.value, best_negatives(planted.value, chosen.value, batches, negatives, share)):
                flat = [(int(anchor), positive, score, best) for anchor, windows in zip(tree.ids, lists) for positive, score, _, best in windows]
                sizes = [len(best.ids) for _, _, _, best in flat]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.repeat(np.array([f[k] for f in flat], np.int64), sizes), pa.int64()) for k in range(3)),
                     pa.array(np.concatenate([np.empty(0, np.int64), *(f[3].ids for f in flat)]), pa.int64()),
                     pa.array(np.concatenate([np.empty(0), *(f[3].scores for f in flat)]).astype(np.int64), pa.int64())],
                    names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

        best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
        part = (candidates.mapInArrow(negative_lists, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
                .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives))
        parts.append(part.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    parts = parts if len(parts) == 1 else [common.landed(p, "negatives") for p in parts]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
