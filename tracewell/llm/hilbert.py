"""Approximate nearest neighbours by shifted space-filling curves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import landed, prefix_sums

CURVES = 4
DIMENSIONS = 6
LEVELS = 10
QUERY_CHUNK = 4_096
MOST_BLOCK = 65_536
SAMPLE = 64
TARGET = 0.96
SEED = 7
#: Vectors whose keys place the bounds of the ranges of a curve, and the vectors of one range. They decide the work alone.
CUT_SAMPLE, RANGE = 1 << 16, 16_384


def hilbert_keys(cells: np.ndarray, levels: int) -> np.ndarray:
    """Positions of integer cells (rows of coordinates below 2 ** levels) on the Hilbert curve: coordinates are turned and
    swapped from the coarsest level down, then Gray-coded and interleaved."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (levels - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (levels - 1)
    while q > 1:
        turn = np.where(x[n - 1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(levels - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> level & 1)
    return key


def curve_keys(vectors: np.ndarray, longest: float, queries: bool, size: int, curves: int = CURVES) -> np.ndarray:
    """Hilbert key of each vector (rows) on each curve (columns): an own projection and an own shift of the grid per curve.

    One more coordinate brings all vectors to one length, so that the largest inner product is the smallest distance;
    a query is scaled to that length instead.
    """
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    if queries:
        lifted = np.column_stack([vectors * (longest / np.maximum(norms, 1e-300))[:, None], np.zeros(len(vectors))])
    else:
        lifted = np.column_stack([vectors, np.sqrt(np.maximum(longest ** 2 - norms ** 2, 0))])
    draw = np.random.default_rng(SEED)
    keys = []
    for _ in range(curves):
        base = np.linalg.qr(draw.normal(size=(size + 1, min(DIMENSIONS, size + 1))))[0]
        spread = longest / np.sqrt(size + 1)
        at = (lifted @ base / (8 * spread) + 0.5) * (1 << (LEVELS - 1)) + draw.uniform(0, 1 << (LEVELS - 1), base.shape[1])
        keys.append(hilbert_keys(np.clip(at, 0, (1 << LEVELS) - 1).astype(np.int64), LEVELS))
    return np.column_stack(keys) if len(vectors) else np.zeros((0, curves), np.int64)


def _matrix(column, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(-1, size)


def nodes_of(vectors: DataFrame, neighbours: int) -> DataFrame:
    """Usable vectors, each once: (vid, vec, ids) with its ``neighbours`` + 1 smallest ids; no answer needs more of them."""
    usable = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vec")).filter("vec_id is not null and vec is not null")
    fine = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)
    usable = usable.filter(fine).withColumn("vec", F.transform("vec", lambda x: x + 0.0))
    place = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    few = usable.distinct().withColumn("_n", place).filter(F.col("_n") <= neighbours + 1)
    return few.groupBy("vec").agg(F.min("vec_id").alias("vid"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def search(vectors: DataFrame, step: int = 20, neighbours: int = 20, *, curves: int = CURVES, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest vectors found for every vector whose id is divisible by ``step``.

    All vectors are laid on ``curves`` Hilbert curves. On each curve a query compares itself with the vectors less than a
    window of places away, and what the curves find is merged and ranked by the inner product in double precision. The window
    is measured: SAMPLE queries are compared with all vectors, and the window is the distance in places, on the better of the
    curves, within which ``target`` of their true neighbours lie. Close groups need a few places; where vectors have no close
    neighbours, as in noise of many dimensions, it grows to a share of the table, and the search with it.

    Equal vectors are searched once and count with all their ids. Vectors that are null, zero, of another length than most,
    or hold null or non-finite numbers take no part; null ids neither; repeated rows count once; an empty table gives an
    empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    found = nodes_of(vectors, neighbours)
    packed = landed(found, "vectors")
    sizes = packed.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return spark.createDataFrame([], result)
    size = sizes["size"]
    nodes = packed.filter(F.size("vec") == size)
    longest = nodes.agg(F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    asked = vectors.select(F.col("vec_id").cast("long").alias("query_id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x + 0.0).alias("vec"))
    asked = landed(asked.filter(F.col("query_id") % step == 0).distinct().join(nodes.select("vid", "vec"), "vec").select("query_id", "vid"), "queries")
    queries = nodes.join(asked.select("vid").distinct(), "vid", "left_semi")

    total = nodes.count()
    every = max(1, total // CUT_SAMPLE)
    few = nodes.filter(F.pmod(F.xxhash64("vid"), F.lit(every)) == 0).select("vec")
    cuts = _cuts(few, longest, size, curves, max(1, min(CUT_SAMPLE // 16, total // RANGE)))

    def laid(rows: DataFrame, is_query: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                matrix = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                keys = curve_keys(matrix, longest, is_query, size, curves)
                vecs = [row.tobytes() for row in matrix]
                for c in range(curves):
                    yield pa.RecordBatch.from_arrays([pa.array([c] * len(vecs), pa.int32()), pa.array(keys[:, c]), batch.column(0), pa.array(vecs, pa.binary()),
                                                      pa.array([int(is_query)] * len(vecs), pa.int32()), pa.array(np.searchsorted(cuts[c], keys[:, c], "right"))],
                                                     names=["curve", "h", "vid", "vec", "query", "range"])

        return rows.select("vid", "vec").mapInArrow(run, "curve int, h long, vid long, vec binary, query int, range long")

    both = laid(nodes, False).union(laid(queries, True)).withColumn("one", F.lit(1).cast("long") - F.col("query"))
    placed = landed(prefix_sums(both, ["curve"], ["h", "query", "vid"], F.col("range"), "one", "place")
                    .select("curve", "place", "vid", "vec", "query"), "places")
    data, ask = placed.filter("query = 0"), placed.filter("query = 1")
    window = measured_window(nodes, placed, queries, size, neighbours, target, total)
    block = max(1_024, min(MOST_BLOCK, window))
    reach = F.sequence(F.floor(F.greatest(F.col("place") - window, F.lit(0)) / block), F.floor((F.col("place") + window) / block))
    ask = ask.select("curve", "place", "vid", "vec", F.explode(reach).alias("block"))
    # a block is copied for every QUERY_CHUNK queries of its own, of which it has no more than its width and two windows hold
    chunks = landed(ask.groupBy("curve", "block").agg(F.ceil(F.count(F.lit(1)) / QUERY_CHUNK).cast("int").alias("chunks")), "query-chunks")
    data = (data.select("curve", "place", "vid", "vec", F.floor(F.col("place") / block).alias("block")).join(chunks, ["curve", "block"])
            .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks").toDF("curve", "block", "place", "vid", "vec", "chunk"))
    ask = ask.join(chunks, ["curve", "block"]).withColumn("chunk", F.pmod(F.xxhash64("vid"), F.col("chunks")).cast("int")).drop("chunks").toDF("curve", "block", "place", "vid", "vec", "chunk")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"qvid": [], "vid": [], "score": []}
        if len(left) and len(right):
            x, xp, xid = _matrix(left["vec"], size), left["place"].to_numpy(), left["vid"].to_numpy()
            for at in range(0, len(right), 256):
                part = right.iloc[at:at + 256]
                q, qp = _matrix(part["vec"], size), part["place"].to_numpy()
                near = q @ x.T
                near[np.abs(qp[:, None] - xp[None, :]) > window] = -np.inf
                keep = min(neighbours + 1, len(x))
                best = np.argpartition(-near, keep - 1, axis=1)[:, :keep]
                worst = np.take_along_axis(near, best, axis=1).min(axis=1, keepdims=True)
                # all ties at the cut go on, of which the smaller ids are kept; matrix products may differ in the last bits
                rows, hit = np.nonzero((near >= worst - 1e-12 * np.abs(worst)) & np.isfinite(near))
                out["qvid"].append(part["vid"].to_numpy()[rows])
                out["vid"].append(xid[hit])
                out["score"].append((q[rows] * x[hit]).sum(axis=1))
        return pd.DataFrame({k: np.concatenate(v) if v else np.array([], "f8" if k == "score" else "i8") for k, v in out.items()})

    keys = ["curve", "block", "chunk"]
    hits = data.groupBy(*keys).cogroup(ask.groupBy(*keys)).applyInPandas(compare, "qvid long, vid long, score double").distinct()
    hits = _best(hits, "qvid", "vid", neighbours + 1)
    members = hits.join(nodes.select("vid", "ids"), "vid").select("qvid", "score", F.explode("ids").alias("vec_id"))
    members = _best(members, "qvid", "vec_id", neighbours + 1)
    answers = asked.join(members, asked["vid"] == members["qvid"]).filter("query_id <> vec_id").select("query_id", "vec_id", "score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")


def _cuts(vectors: DataFrame, longest: float, size: int, curves: int, ranges: int) -> list[np.ndarray]:
    """Keys that part each curve into ranges of about as many sampled vectors; the sample has at most 2 * CUT_SAMPLE rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = curve_keys(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size), longest, False, size, curves)
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, c]) for c in range(curves)], names=[f"k{c}" for c in range(curves)])

    found = vectors.mapInArrow(run, ", ".join(f"k{c} long" for c in range(curves))).toPandas()
    at = np.linspace(0, len(found), ranges + 1)[1:-1].astype(int)
    return [np.unique(np.sort(found[f"k{c}"].to_numpy("i8"))[at]) for c in range(curves)]


def _best(rows: DataFrame, key: str, tie: str, count: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), tie)
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= count).drop("_n")


def measured_window(nodes: DataFrame, placed: DataFrame, queries: DataFrame, size: int, neighbours: int, target: float, total: int) -> int:
    """Places within which ``target`` of the true neighbours of SAMPLE queries lie on the better curve of each."""
    sample = queries.select("vid", "vec").orderBy(F.xxhash64("vid"), "vid").limit(SAMPLE).collect()
    if not sample:
        return 1
    ids, matrix = np.array([r["vid"] for r in sample]), np.array([r["vec"] for r in sample], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, vid = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size), batch.column(0).to_numpy()
            near = matrix @ x.T
            keep = min(neighbours, len(vid))
            if keep:
                best = np.argpartition(-near, keep - 1, axis=1)[:, :keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, keep)), pa.array(vid[best].ravel()), pa.array(np.take_along_axis(near, best, axis=1).ravel())],
                                                 names=["qvid", "vid", "score"])

    truth = _best(nodes.select("vid", "vec").mapInArrow(run, "qvid long, vid long, score double"), "qvid", "vid", neighbours).collect()  # SAMPLE x neighbours rows
    spark = nodes.sparkSession
    wanted = spark.createDataFrame(sorted({(int(r["qvid"]), 1) for r in truth} | {(int(r["vid"]), 0) for r in truth}), "vid long, query int")
    at = {(r["query"], r["vid"], r["curve"]): r["place"] for r in placed.join(F.broadcast(wanted), ["vid", "query"]).select("query", "vid", "curve", "place").collect()}
    curves = {c for _, _, c in at}
    apart = sorted(min(abs(at[1, r["qvid"], c] - at[0, r["vid"], c]) for c in curves) for r in truth)
    return int(min(total, apart[min(len(apart) - 1, int(np.ceil(target * len(apart))))] + 1))
