"""One-class detectors: isolation forest and minimum-determinant covariance, as Spark jobs."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell import session
from tracewell.functions.scalars import is_finite
from tracewell.operators import covariance
from tracewell.operators.ranks import order_statistic

LEAF = -1
NODE_SCHEMA = "tree int, node int, feature int, cut double, left int, size int, depth int"


def path_constant(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    full = 2.0 * (np.log(np.maximum(n - 1, 1.0)) + np.euler_gamma) - 2.0 * (n - 1) / np.maximum(n, 1.0)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, full))


def _grow(tree: int, x: np.ndarray, seed: int) -> pd.DataFrame:
    """Random splits of one small sample; children of a node are stored side by side."""
    rng = np.random.default_rng([seed, tree])
    limit, rows, queue = math.ceil(math.log2(max(len(x), 2))), [], [(0, np.arange(len(x)), 0)]
    made = 1
    while queue:
        node, idx, depth = queue.pop(0)
        part = x[idx]
        wide = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(idx) > 1 else np.array([], dtype=int)
        if depth >= limit or not len(wide):
            rows.append((tree, node, LEAF, 0.0, 0, len(idx), depth))
            continue
        f = int(rng.choice(wide))
        cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        below = part[:, f] <= cut
        rows.append((tree, node, f, cut, made, len(idx), depth))
        queue += [(made, idx[below], depth + 1), (made + 1, idx[~below], depth + 1)]
        made += 2
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "cut", "left", "size", "depth"])


@dataclass
class IsolationForest:
    """Trees as arrays of fixed width: sample size bounds the nodes of a tree, so the model is small."""

    features: list[str]
    nodes: pd.DataFrame
    sample: int
    trees: int

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str], row_id: str, *, trees: int = 500, sample: int = 256,
            seed: int = 711) -> IsolationForest:
        """Every tree sees min(sample, n) rows: those of its smallest hashes, by one rule at every size.

        A row is offered only to the trees whose hash of it is small enough for the sample and a margin of
        eight standard deviations, so a group holds little more than a sample. The rows of ``df`` itself are
        counted; a looser bound would thin the samples.
        """
        data = df.select(F.col(row_id).alias("_id"), *[F.col(f).cast("double").alias(f) for f in features])
        n = data.count()
        if not n:
            raise ValueError("an isolation forest needs training rows")
        share = min(1.0, (sample + 8 * math.sqrt(sample) + 32) / n)
        top = F.lit(int((2.0 * share - 1.0) * 2 ** 63) if share < 1.0 else 2 ** 63 - 1)
        drawn = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda k: F.struct(k.alias("tree"), F.xxhash64(k, F.col("_id"), F.lit(seed)).alias("_h")))
        offered = data.withColumn("_d", F.explode(F.filter(drawn, lambda d: d["_h"] <= top))).select("*", "_d.tree", "_d._h").drop("_d")
        names = list(features)

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            chosen = pdf.sort_values(["_h", "_id"]).head(sample)
            return _grow(int(pdf["tree"].iloc[0]), chosen[names].to_numpy(float), seed)

        nodes = offered.groupBy("tree").applyInPandas(build, NODE_SCHEMA).toPandas()  # at most 2 * sample nodes per tree
        sizes = nodes.loc[nodes["depth"] == 0, "size"]
        size = min(sample, n)
        if len(sizes) != trees or int(sizes.min()) < size:
            raise ValueError(f"{len(sizes)} of {trees} trees, the smallest with {sizes.min()} of {size} rows: row ids must tell rows apart")
        return cls(names, nodes.sort_values(["tree", "node"]), size, trees)

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """2^(-mean path / expected path); larger is more anomalous."""
        packed = [(g["feature"].to_numpy(), g["cut"].to_numpy(), g["left"].to_numpy(),
                   (g["depth"] + path_constant(g["size"])).to_numpy()) for _, g in self.nodes.groupby("tree")]
        expected, deepest = float(path_constant(self.sample)), int(self.nodes["depth"].max())

        @F.pandas_udf(T.DoubleType())
        def anomaly(x: pd.Series) -> pd.Series:
            if x.empty:
                return pd.Series([], dtype=float)
            rows = np.stack(x.to_numpy()).astype(float)
            total, every = np.zeros(len(rows)), np.arange(len(rows))
            for feature, cut, left, length in packed:
                at = np.zeros(len(rows), dtype=np.int64)
                for _ in range(deepest):
                    f = feature[at]
                    right = (rows[every, np.maximum(f, 0)] > cut[at]).astype(np.int64)
                    at = np.where(f == LEAF, at, left[at] + right)
                total += length[at]
            return pd.Series(np.exp2(-total / len(packed) / expected))

        return df.withColumn(name, anomaly(F.array(*[F.col(f).cast("double") for f in self.features])))


def _chi2_quantile(q: float, d: int) -> float:
    """Quantile of a chi-squared variable by bisection on its series expansion."""

    def cdf(x: float) -> float:
        a, half = d / 2.0, x / 2.0
        term = math.exp(a * math.log(half) - half - math.lgamma(a + 1))
        total, k = 0.0, 0
        while term > 1e-17 * max(total, 1e-300) and k < 10_000:
            total, k = total + term, k + 1
            term *= half / (a + k)
        return total

    low, high = 1e-9, d + 20.0 * math.sqrt(2.0 * d) + 20.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < q else (low, mid)
    return (low + high) / 2


#: Rows of the bounded sample that starts are drawn from and first concentrated on.
NEST = 1_500


def _concentrate(x: np.ndarray, moments: np.ndarray, h: int, steps: int) -> np.ndarray:
    """A few concentration steps around zero on rows in memory."""
    for _ in range(steps):
        away = np.einsum("ij,jk,ik->i", x, covariance.precision_of(moments), x)
        kept = x[np.argsort(away, kind="stable")[:h]]
        moments = kept.T @ kept / h
    return moments


def _first_moments(x: np.ndarray, starts: int, seed: int) -> list[np.ndarray]:
    """Second moments of random subsets of d + 1 rows, each grown until it spans all dimensions."""
    rng, d, out = np.random.default_rng(seed), x.shape[1], []
    for _ in range(starts):
        order, take = rng.permutation(len(x)), min(d + 1, len(x))
        while take < len(x) and np.linalg.matrix_rank(x[order[:take]]) < d:
            take += 1
        part = x[order[:take]]
        out.append(part.T @ part / take)
    return out


@dataclass
class RobustCovariance:
    """Minimum-determinant covariance with a fixed zero center, consistency factor and reweighting.

    ``raw`` are the second moments of the best half before the correction, ``log_det`` their determinant,
    ``steps`` and ``converged`` those of the best start.
    """

    features: list[str]
    matrix: np.ndarray
    support: int
    steps: int
    raw: np.ndarray
    log_det: float
    converged: bool
    starts: int

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str], *, rows: int | None = None, starts: int = 20, kept: int = 10,
            limit: int = 100, seed: int = 711) -> RobustCovariance:
        """Concentration steps from several starts: second moments of the h closest rows, until determinants are stable.

        Random starts take two steps on a bounded sample; the best ``kept`` of them and the start of smallest
        scaled norms then step on all rows. A step of all live starts is one order statistic over their
        distances and one sum of cross products, over a table that is written once. Rows with a null or
        non-finite feature take no part.
        """
        features, d = list(features), len(features)
        whole = F.lit(True)
        for f in features:
            whole = whole & F.coalesce(is_finite(f), F.lit(False))
        data = session.landed(df.filter(whole).select(F.array(*[F.col(f).cast("double") for f in features]).alias("x")), "rows")
        n = data.count()
        if not n:
            raise ValueError("a robust covariance needs training rows")
        h = min(n, (n + d + 1) // 2)

        def moments(edges: dict[int, tuple[np.ndarray, float]]) -> dict[int, np.ndarray]:
            """Second moments, for every start, of the rows within its edge under its precision."""

            def partial(batches):
                held = {s: np.zeros(d * d + 1) for s in edges}
                for pdf in batches:
                    x = np.stack(pdf["x"].to_numpy())
                    for s, (p, edge) in edges.items():
                        part = x[np.einsum("ij,jk,ik->i", x, p, x) <= edge]
                        held[s] += np.append((part.T @ part).ravel(), len(part))
                for s, v in held.items():
                    yield pd.DataFrame({"s": s, "p": np.arange(len(v)), "v": v})

            cells = data.mapInPandas(partial, "s int, p int, v double").groupBy("s", "p").agg(F.sum("v").alias("v")).toPandas()
            out = {}
            for s, part in cells.groupby("s"):
                v = part.sort_values("p")["v"].to_numpy()
                out[int(s)] = v[:-1].reshape(d, d) / max(v[-1], 1.0)
            return out

        def nearest_edges(precisions: dict[int, np.ndarray], count: int) -> dict[int, tuple[np.ndarray, float]]:
            def measure(batches):
                for pdf in batches:
                    x = np.stack(pdf["x"].to_numpy())
                    for s, p in precisions.items():
                        yield pd.DataFrame({"s": s, "d": np.einsum("ij,jk,ik->i", x, p, x)})

            long = data.mapInPandas(measure, "s int, d double")
            found = order_statistic(long, ["s"], "d", F.lit(count).cast("long"), "edge", rows=n * len(precisions)).collect()
            return {r["s"]: (precisions[r["s"]], float(r["edge"])) for r in found}

        share = min(1.0, 1.5 * NEST / n)
        sample = data.withColumn("_h", F.pmod(F.xxhash64("x"), F.lit(1_000_003)) / 1_000_003.0).filter(F.col("_h") < share).orderBy("_h", "x").limit(NEST)
        near = np.array([r["x"] for r in sample.select("x").collect()], dtype=float).reshape(-1, d)
        everything = moments({0: (np.zeros((d, d)), 0.0)})[0]
        candidates = []
        if len(near):
            inner = min(len(near), (len(near) + d + 1) // 2)
            candidates = sorted((_concentrate(near, m, inner, 2) for m in _first_moments(near, starts, seed)), key=lambda m: np.linalg.slogdet(m)[1])[:kept]
        current = dict(enumerate([np.diag(np.diag(everything)), *candidates]))
        size, steps, live = {s: math.inf for s in current}, dict.fromkeys(current, 0), set(current)
        while live:
            found = moments(nearest_edges({s: covariance.precision_of(current[s]) for s in live}, h))
            for s in sorted(live):
                current[s], steps[s] = found[s], steps[s] + 1
                det = float(np.linalg.slogdet(found[s])[1])
                if not size[s] - det > 1e-9:
                    live.discard(s)
                elif steps[s] >= limit:
                    live.discard(s)
                    steps[s] = limit + 1
                size[s] = det
        best = min(size, key=lambda s: (size[s], s))
        raw = current[best]
        middle = nearest_edges({0: covariance.precision_of(raw)}, (n + 1) // 2)[0][1]
        wide = covariance.precision_of(raw * (middle / _chi2_quantile(0.5, d)))
        final = moments({0: (wide, _chi2_quantile(0.975, d))})[0]
        return cls(features, final, h, min(steps[best], limit), raw, size[best], steps[best] <= limit, len(current))

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        return df.withColumn(name, covariance.distance(self.features, covariance.precision_of(self.matrix)))
