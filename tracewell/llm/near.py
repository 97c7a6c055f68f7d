"""Texts whose sets of five-word shingles have a Jaccard similarity of at least a bound: SimHash links, then prefix filtering for the rest."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm import simhash
from tracewell.llm.common import components, landed, text_bytes, words_of

SHINGLE = 5
SIMILARITY = 0.8
SEED = 42
#: Shingles in so many texts of a sample come last in the order, so that passages of many texts pair none by themselves.
COMMON = 4
#: The sample holds one text in SAMPLE, or fewer of a table with more than SAMPLE * SAMPLE_ROWS rows. It decides the order alone.
SAMPLE, SAMPLE_ROWS = 16, 1 << 16


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Different XXH64 values of the word shingles in rising order; fewer words are one shingle."""
    words, digest, join = words_of(text), xxhash.xxh64_intdigest, b" ".join
    if len(words) < shingle:
        found = [digest(join(words), SEED)]
    else:
        found = [digest(join(t), SEED) for t in zip(*(words[i:] for i in range(shingle)))]
    return np.unique(np.array(found, "u8"))


def _name(found: np.ndarray) -> int:
    """64-bit name of a set."""
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def needed(n: int, similarity: float) -> int:
    """Shingles that a set of n shares at least with any set that similar."""
    return math.ceil(similarity * n - 1e-9)


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*values, np.zeros(0, "u8")]).view("i8")))


def _sets(docs: DataFrame, shingle: int, similarity: float | None, common: np.ndarray | None = None) -> DataFrame:
    """(doc_id, node, n, fp, some): name, size and fingerprint of each text's set with its first shingles, or all without a similarity.

    Under any one order of all shingles, two sets that share at least needed(n) of them both hold a common one among their
    first n - needed(n) + 1. The order is that of the hashes, with those of ``common``, in its order, behind all others.
    """
    common = np.zeros(0, "u8") if common is None else common
    rank = np.argsort(common)
    sorted_common = common[rank]

    def ordered(s: np.ndarray) -> np.ndarray:
        at = np.searchsorted(sorted_common, s)
        hit = np.zeros(len(s), bool)
        hit[at < len(common)] = sorted_common[at[at < len(common)]] == s[at < len(common)]
        return np.concatenate([s[~hit], s[hit][np.argsort(rank[at[hit]])]]) if hit.any() else s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [shingle_set(t, shingle) for t in text_bytes(part.column(1))]
                some = found if similarity is None else [ordered(s)[:len(s) - needed(len(s), similarity) + 1] for s in found]
                # only the first shingles go with a fingerprint: the other calls fetch sets that were linked before
                prints = np.array([0 if similarity is None else simhash.vote(s) for s in found], "u8").view("i8")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array([_name(s) for s in found], "u8").view("i8")),
                                                  pa.array([len(s) for s in found], pa.int64()), pa.array(prints, pa.int64()), _lists(some)],
                                                 names=["doc_id", "node", "n", "fp", "some"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, node long, n long, fp long, some array<long>")


def _common(docs: DataFrame, shingle: int) -> np.ndarray:
    """Shingles that many texts of the sample hold, rarer ones first."""
    every = max(SAMPLE, docs.count() // SAMPLE_ROWS)
    few = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    counts = _sets(few, shingle, None).select(F.explode("some").alias("key")).groupBy("key").count().filter(F.col("count") >= COMMON)
    return counts.orderBy("count", "key").select("key").toPandas()["key"].to_numpy("i8").view("u8")


def alike(a: Column, b: Column, similarity: float) -> Column:
    """Whether two arrays of different shingles have at least this Jaccard similarity."""
    shared = F.size(F.array_intersect(a, b))
    return shared >= similarity * (F.size(a) + F.size(b) - shared) - 1e-9


def _possible(pairs: DataFrame, similarity: float) -> DataFrame:
    """Distinct (a, b) that may be similar, of rows (a, p, b, q): two sets with the packed size and place of a shared shingle."""
    n, m = F.shiftright("p", 32), F.shiftright("q", 32)
    p, q = F.col("p").bitwiseAND(F.lit(0xFFFFFFFF)), F.col("q").bitwiseAND(F.lit(0xFFFFFFFF))
    # the shingles before and after the common one bound what the sets can share
    can = (F.least(p, q) + F.least(n - p, m - q) >= similarity / (1 + similarity) * (n + m) - 1e-6) & (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-6)
    met = pairs.filter(can).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.max(n).alias("n"), F.max(m).alias("m"))
    # of the set whose first part ends earlier, the shared shingles of that part are all counted; no more than its rest comes on top
    rest = F.ceil(similarity * F.greatest("n", "m") - 1e-6) - 1
    return met.filter(F.col("c") + rest >= similarity / (1 + similarity) * (F.col("n") + F.col("m")) - 1e-6).select("a", "b", "c")


def _similar(docs: DataFrame, sets: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are as similar."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = sets.join(asked, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("asked_id")).select("asked_id").distinct()
    named = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # one text a node: the others of its name hold the same shingles
    whole = _sets(named.join(ids, F.col("doc_id").eqNullSafe(F.col("asked_id")), "left_semi"), shingle, None)
    whole = landed(whole.join(asked, "node", "left_semi").groupBy("node").agg(F.first("some").alias("some")), "shingle-sets")
    both = pairs.join(whole.toDF("a", "x"), "a").join(whole.toDF("b", "y"), "b")
    return both.filter(alike(F.col("x"), F.col("y"), similarity)).select("a", "b")


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes by their SimHash fingerprints: each with the first of its fingerprint, and the first of two within two bits."""
    firsts = landed(nodes.groupBy("fp").agg(F.min("node").alias("a")), "fingerprints")
    same = nodes.join(firsts, "fp").filter("node <> a").select("a", F.col("node").alias("b"))
    near = simhash.links(firsts.select("fp")).toDF("x", "y")
    return same.union(near.join(firsts.toDF("x", "a"), "x").join(firsts.toDF("y", "b"), "y").select("a", "b"))


def near_components(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id): documents linked by pairs whose exact similarity reaches the bound.

    Equal sets are one node, so a group of copies costs one row however large it is. Near copies are first linked by SimHash
    fingerprints of the shingles that meet on Golay-code keys, and through hubs: every set is compared with the smallest or
    the largest set of its shingles, whichever it meets on more of them. Both are checked by exact similarity. What this links
    is one class, and only sets of different classes are paired afterwards, on shingles that such sets share, so the pairs of
    a large group are never made. Links that fingerprints and hubs miss are found by the second step.
    Texts without words are alike; component_id is null only where a whole component has null ids; repeated rows are one
    document; an empty table gives an empty result; other columns are ignored.
    """
    sets = landed(_sets(docs, shingle, similarity, _common(docs, shingle)), "shingles")
    nodes = landed(sets.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("some").alias("some")), "nodes")
    keys = nodes.select("node", "n", F.posexplode("some").alias("at", "key")).select("key", "node", F.shiftleft("n", 32).bitwiseOR(F.col("at").cast("long")).alias("at"))
    # most shingles stand in one set alone
    one = F.struct("node", "at")
    ends = keys.groupBy("key").agg(F.min(one).alias("low"), F.max(one).alias("high")).filter("low.node <> high.node")
    # Spark takes a set for one of its shingles and a sorted table for its file, so joins on shingles never send one side to all tasks
    met = landed(keys.hint("merge").join(ends, "key"), "shared-shingles")
    stars = met.select(F.col("node").alias("b"), F.col("at").alias("q"), F.inline(F.array("low", "high"))).toDF("b", "q", "a", "p").filter("a <> b")
    best = landed(_possible(stars, similarity).groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a")).select("a", "b"), "hub-pairs")
    printed = fingerprint_pairs(nodes.select("fp", "node"))
    either = landed(best.union(printed).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "first-pairs")
    hubs = landed(_similar(docs, sets, either, shingle, similarity), "hub-links")
    classes = components(hubs)
    place = landed(met.select("key", "node", "at").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node")), "classed-shingles")
    # shingles on which different classes meet, each class once
    several = place.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    held = place.hint("merge").join(several, "key", "left_semi").select("key", "root").distinct()
    apart = held.toDF("key", "ra").hint("merge").join(held.toDF("key", "rb"), "key").filter("ra < rb")
    left, right = place.toDF("a", "key", "p", "ra"), place.toDF("b", "key", "q", "rb")
    meetings = apart.hint("merge").join(left, ["key", "ra"]).hint("merge").join(right, ["key", "rb"])
    pairs = landed(_possible(meetings, similarity).select("a", "b"), "near-pairs")
    roots = components(hubs.union(_similar(docs, sets, pairs, shingle, similarity)))
    rooted = nodes.select("node", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return sets.select("doc_id", "node").join(rooted.join(smallest, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Documents that are the first of their component; rows with a null id stay, and of rows with one id the least stays.

    Null and empty texts are alike, so one of them stays. Other columns may have any name; an empty table stays empty.
    """
    named = docs.filter("doc_id is not null")
    found = near_components(named, shingle, similarity)
    first = found.filter("doc_id = component_id").select("doc_id").distinct()
    # a repeated id keeps the row with the smallest hash
    packed = named.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("hash"))
    kept = packed.join(first, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("row", "hash").alias("row"))
    return kept.select("row.*").union(docs.filter("doc_id is null"))
