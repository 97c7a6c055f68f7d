"""Mixture-controlled packing: deficit round-robin over source queues into fixed windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import MAX_BUCKETS, ROWS_PER_BUCKET, landed, prefix_sums, text_bytes
from tracewell.llm.tokens import TEXTS, encoder

WINDOW = 1024
PACKET = 256


def tokenized(docs: DataFrame, tokenizer: str, *, end_id: int = 0, drops_space: bool = False) -> DataFrame:
    """Documents as (key, doc_id, source, n, width, ids) in a landed table; key numbers the rows, so copies stay apart."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, key = encoder(tokenizer, drops_space), TaskContext.get().partitionId() << 36
        end = end_id.to_bytes(encode.width, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                ids = [x + end for x in encode.encode(text_bytes(part.column(2)))]
                counts = [len(x) // encode.width for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(key, key + len(ids)), pa.int64()), part.column(0), part.column(1), pa.array(counts, pa.int64()),
                     pa.array([encode.width] * len(ids), pa.int32()), pa.array(ids, pa.binary())],
                    names=["key", "doc_id", "source", "n", "width", "ids"])
                key += len(ids)

    return landed(rows.mapInArrow(run, "key long, doc_id long, source string, n long, width int, ids binary"), "token-ids")


def placed_packets(rows: DataFrame, weights: dict[str, float] | None = None, window: int = WINDOW, packet: int = PACKET) -> DataFrame:
    """Where deficit round-robin puts each packet: (key, start, length, place), place being its offset in the whole stream.

    Each window is a round in which every source earns its share of ``window`` tokens; a source sends its next packet (up to
    ``packet`` tokens of a document) in the first round in which all it has earned covers all it has sent with that packet. So
    the deficit carries over windows, and, as the round follows from the queue offset alone, over partitions too: a source
    differs from its share by less than one packet and one round. ``weights`` names the shares; by default each source has
    its share of all tokens, so every window shows the mixture of the whole. Sources that weights don't name get the smallest.
    """
    spark = rows.sparkSession
    totals = rows.groupBy("source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("docs"))
    everything = totals.agg(F.sum("total").alias("tokens"), F.sum("docs").alias("docs")).first()
    tokens, docs = everything["tokens"] or 1, everything["docs"] or 1
    if weights:
        whole, least = float(sum(weights.values())), min(weights.values())
        named = spark.createDataFrame([(s, w / whole) for s, w in weights.items()], "source string, share double")
        shares = totals.join(named, "source", "left").withColumn("share", F.coalesce("share", F.lit(least / whole)))
    else:
        shares = totals.withColumn("share", F.col("total") / F.lit(float(tokens)))
    shares = shares.select(F.coalesce("source", F.lit("\0")).alias("queue"), (F.col("share") * window).alias("quantum"),
                           F.ceil(F.col("total") / (F.col("share") * window)).alias("rounds"))
    last = shares.agg(F.max("rounds")).first()[0] or 1
    queued = rows.select("key", "doc_id", "n", F.coalesce("source", F.lit("\0")).alias("queue"), F.xxhash64("doc_id", "n").alias("h"))
    bits = max(0, min(13, int(docs // ROWS_PER_BUCKET).bit_length()))
    bucket = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 63 - bits) if bits else F.lit(0)
    queued = prefix_sums(queued, ["queue"], ["h", "doc_id", "key"], bucket, "n", "sent")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / packet) * packet, F.lit(packet).cast("long")))
    packets = queued.select("key", "queue", "n", "sent", starts.alias("start"))
    packets = packets.withColumn("length", F.least(F.col("n") - F.col("start"), F.lit(packet)))
    packets = packets.withColumn("through", F.col("sent") + F.col("start") + F.col("length")).join(shares, "queue")
    packets = packets.withColumn("round", F.ceil(F.col("through") / F.col("quantum")))
    wide = max(1, -(-int(last) // min(MAX_BUCKETS, max(1, int(tokens) // (packet * ROWS_PER_BUCKET) * 4 + 1))))
    placed = prefix_sums(packets.select("key", "queue", "start", "length", "round", "through"), [], ["round", "queue", "through"],
                         F.floor(F.col("round") / wide), "length", "place")
    return placed.select("key", "start", "length", "place")


def pack(docs: DataFrame, tokenizer: str, *, weights: dict[str, float] | None = None, window: int = WINDOW, packet: int = PACKET,
         end_id: int = 0, drops_space: bool = False) -> DataFrame:
    """Pack all documents into sequences of ``window`` tokens; one row per piece, with its ids as little-endian integers.

    Returns (doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset). Every token, the end id included, lies in
    exactly one piece; every sequence is full but the last. A null or empty text is its end id alone; a null source is a queue
    of its own; repeated rows are packed as often as they come; an empty table gives no row. Other columns are ignored.
    """
    rows = tokenized(docs, tokenizer, end_id=end_id, drops_space=drops_space)
    packets = placed_packets(rows, weights, window, packet)
    lists = packets.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "length", "place"))).alias("packets"))
    joined = rows.select("key", "doc_id", "n", "width", "ids").join(lists, "key").select("doc_id", "n", "width", "ids", "packets")

    def pieces(starts, lengths, places):
        """Packets cut at window edges, then joined where they follow each other in one window."""
        found = []
        for start, length, place in zip(starts, lengths, places):
            while length:
                take = min(length, window - place % window)
                if found and found[-1][0] + found[-1][1] == start and found[-1][2] + found[-1][1] == place and place % window:
                    found[-1][1] += take
                else:
                    found.append([start, take, place])
                start, length, place = start + take, length - take, place + take
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = {k: [] for k in ("doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
                ends = np.asarray(part.column(4).offsets)
                whole = part.column(4).flatten()
                starts, lengths, places = (whole.field(c).to_numpy().tolist() for c in range(3))
                ends = (ends - ends[0]).tolist()
                for doc, n, width, ids, low, high in zip(*(part.column(c).to_pylist() for c in range(4)), ends, ends[1:]):
                    wide = np.frombuffer(ids, f"<u{width}").astype("<u4")
                    for start, length, place in pieces(starts[low:high], lengths[low:high], places[low:high]):
                        own = wide[start:start + length].tobytes()
                        for k, v in zip(out, (doc, start, length, own, zlib.crc32(own), n, place // window, place % window)):
                            out[k].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()], names=list(out))

    return joined.mapInArrow(run, "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
