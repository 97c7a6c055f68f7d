"""SimHash near-duplicates by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import components, landed, text_bytes, words_of

BITS = 64
#: (lowest bit, width) of the three fingerprint segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Segment pairs that remain when the segment with most errors is left out.
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Generator polynomial of the binary Golay code (23, 12, 7), a fixed value.
GENERATOR = 0xC75
PARITY = 11
SEED = 42


def fingerprint(text: bytes, shingle: int = 3, seed: int = SEED) -> int:
    """64-bit majority vote over XXH64 of the word shingles; no word gives zero."""
    words = words_of(text)
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        digest, join = xxhash.xxh64_intdigest, b" ".join
        hashes = [digest(join(t), seed) for t in zip(*(words[i:] for i in range(shingle)))]
    return vote(np.array(hashes, "<u8"))


def vote(hashes: np.ndarray) -> int:
    """64-bit majority vote over 64-bit hashes."""
    bits = np.unpackbits(hashes.astype("<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed 64-bit integer; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in text_bytes(batch.column(1))], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator polynomial."""
    rest = words.copy()
    for shift in range(22, PARITY - 1, -1):
        rest ^= np.where(rest >> shift & 1, GENERATOR << (shift - PARITY), 0)
    return rest


def _leaders() -> np.ndarray:
    """The code is perfect: each of the 2,048 syndromes has exactly one error pattern of weight three or less."""
    one = 1 << np.arange(23)
    patterns = {0} | {int(a | b | c) for a in one for b in one for c in one}
    patterns = np.array(sorted(patterns))
    table = np.zeros(1 << PARITY, np.int64)
    table[_syndromes(patterns)] = patterns
    return table


def golay_indices(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices of each word and of its one-bit neighbours, sorted by row, and a mask of the first of equals.

    Two words that differ in one bit or none share an index: each lists the codeword to which the other decodes. A word at
    distance three of its codeword has up to six indices, any other word one.
    """
    near = words[:, None] ^ np.concatenate([[0], 1 << np.arange(width)])[None, :]
    index = np.sort((near ^ _leaders()[_syndromes(near)]) >> PARITY, axis=1)
    first = np.ones(index.shape, bool)
    first[:, 1:] = index[:, 1:] != index[:, :-1]
    return index, first


def _keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of fingerprints: (which key, codeword index of one segment, exact value of another), with row numbers."""
    parts = [(fps.view("u8") >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    fuzzy = [golay_indices(part, width) for part, (_, width) in zip(parts, SEGMENTS)]
    keys, rows = [], []
    for number, (loose, exact) in enumerate([*PAIRS, *(p[::-1] for p in PAIRS)]):
        index, first = fuzzy[loose]
        row, column = np.nonzero(first)
        keys.append(number << 40 | index[row, column] << 24 | parts[exact][row])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """All pairs (a, b) of different fingerprints within ``distance`` (two at most) differing bits.

    Of two errors over three segments, the two segments with fewest hold one at most. So one of these two is equal and the
    other has an equal or neighbouring word, and the pair meets on a key made of the first's value and a codeword index.
    """
    if not 0 <= distance <= 2:
        raise ValueError("the segment argument covers distances up to two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 4096):
                part = np.ascontiguousarray(fps[at:at + 4096])
                keys, rows = _keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "fp"])

    keyed = fps.select("fp").mapInArrow(run, "key long, fp long")
    left, right = keyed.select("key", F.col("fp").alias("a")), keyed.select("key", F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    # a fingerprint has some forty keys, which Spark does not count in the size of either side: neither may be sent to all tasks
    return left.hint("merge").join(right, "key").filter(near).select("a", "b").distinct()


def simhash_components(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id): documents linked by fingerprints within ``distance`` bits.

    Equal fingerprints are one node, so a group of copies costs one row however large it is. Null and empty texts have
    fingerprint zero and link like any other; repeated rows are returned as often as they came; an empty table gives an
    empty result; other columns are ignored. component_id is null only where a whole component has null ids.
    """
    prints = landed(fingerprints(docs, shingle), "fingerprints")
    nodes = landed(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = components(links(nodes, distance))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return (prints.join(named, "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """Documents that are the first of their component; rows with a null id stay, and of repeated rows with one id one stays."""
    found = simhash_components(docs, shingle, distance)
    first = found.filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.filter("doc_id is not null")
    # the join leaves equal ids in one partition; a repeated id keeps the row with the smallest hash
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns))
    kept = named.join(first, "doc_id", "left_semi").withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    return kept.select(docs.columns).unionByName(docs.filter("doc_id is null"))
