"""Language identification by compression: the language whose raw text helps most to shorten a text.

Every learned language owns one raw-content dictionary for zstandard, made of many short pieces of its training texts.
A whole text is cut into blocks that are compressed against each dictionary; the language with the smallest sum wins.
Near ties are marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm import common

#: Pieces of one dictionary and code points of a piece: the bounded sample of labelled rows the classifier is fitted on.
PIECES = 1_000
PIECE = 256
#: All dictionaries together hold at most so many pieces (16 Mi code points); it bounds what is collected and sent to the tasks.
ALL_PIECES = 65_536
LEVEL = 6
BLOCK = 4_096
#: A win by less than this share of the runner-up's size is rejected.
MARGIN = 0.005
UNKNOWN = "und"

_OTHER = regex.compile(r"[^\p{L}]+")


def plain(text: str) -> bytes:
    """Lower-case words of letters between single spaces; marks, digits and decoration say nothing about a language."""
    return f" {_OTHER.sub(' ', text.lower()).strip()} ".encode("utf-8", "replace")


def dictionaries(train: DataFrame, pieces: int = PIECES) -> list[tuple[str, int, bytes]]:
    """(language, training rows, dictionary bytes), most frequent language first, ties by name.

    ``train`` has text and lang; rows with a null lang teach nothing. A language gives the pieces of its rows with the
    smallest hashes, at most ``pieces`` of them and ``ALL_PIECES`` over all languages. Rows are thinned by their hash
    before they are ordered, so a hot language costs no more than a rare one.
    """
    known = train.filter("lang is not null").select("lang", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("_h"))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    languages = counts.count()
    if languages > ALL_PIECES:
        raise ValueError(f"more than {ALL_PIECES} languages")
    each = max(1, min(pieces, ALL_PIECES // max(languages, 1)))
    start = F.pmod(F.shiftright("_h", 20), F.greatest(F.length("text") - PIECE + 1, F.lit(1))) + 1
    share = F.pmod("_h", F.lit(1_000_003)) / 1_000_003.0
    near = (known.join(F.broadcast(counts), "lang").filter(share * F.col("_n") <= 4.0 * each + 16)
            .select("lang", "_n", "_h", share.alias("_u"), F.substring("text", start.cast("int"), F.lit(PIECE)).alias("piece")))
    first = Window.partitionBy("lang").orderBy("_u", "_h", "piece")
    chosen = near.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= each)
    found: dict[str, tuple[int, list[bytes]]] = {}
    for row in chosen.orderBy("lang", "_r").collect():
        found.setdefault(row["lang"], (row["_n"], []))[1].append(plain(row["piece"]))
    return sorted(((lang, n, b"".join(parts)) for lang, (n, parts) in found.items()), key=lambda x: (-x[1], x[0]))


def _compressors(learned: list[tuple[str, int, bytes]]) -> list[zstandard.ZstdCompressor]:
    made = []
    for _, _, content in learned:
        held = zstandard.ZstdCompressionDict(content.rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))
    return made


def code_lengths(text: bytes, compressors: list[zstandard.ZstdCompressor]) -> list[int]:
    """Bytes of the whole text under each dictionary, block by block so that a long text keeps leaning on it."""
    view = memoryview(text)
    blocks = [view[at:at + BLOCK] for at in range(0, len(text), BLOCK)]
    return [sum(len(c.compress(b)) for b in blocks) for c in compressors]


def verdict(sizes: list[int]) -> tuple[int, float, float]:
    """(place of the smallest size, score, margin); ties go to the first place, which is the more frequent language.

    The score is the winner's share of two to the power of minus its size in bytes, the margin the relative lead.
    """
    best = int(np.argmin(sizes))
    ahead = np.array(sizes, dtype=float) - sizes[best]
    score = float(1.0 / np.exp2(-ahead).sum())
    rest = sizes[:best] + sizes[best + 1:]
    margin = 1.0 if not rest else (min(rest) - sizes[best]) / min(rest)
    return best, score, margin


def predict(docs: DataFrame, learned: list[tuple[str, int, bytes]], margin: float = MARGIN) -> DataFrame:
    """Columns lang_pred, score, margin, rejected for every row of (doc_id, held_out, text); ``text`` is replaced."""
    names = [lang for lang, _, _ in learned]
    if not names:
        return docs.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(0.0).alias("margin"), F.lit(True).alias("rejected"))
    sent = docs.sparkSession.sparkContext.broadcast(learned)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(sent.value)
        for batch in batches:
            out = []
            for text, letters in zip(common.text_bytes(batch.column("text")), batch.column("letters").to_pylist()):
                if not letters:
                    out.append((UNKNOWN, 0.0, 0.0, True))
                    continue
                best, score, lead = verdict(code_lengths(plain(text.decode("utf-8", "replace")), compressors))
                out.append((names[best], score, lead, lead < margin))
            langs, scores, leads, rejected = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(leads, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "margin", "rejected"])

    ready = docs.select("doc_id", "held_out", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ready.mapInArrow(judge, f"doc_id {kind}, held_out boolean, lang_pred string, score double, margin double, rejected boolean")


def identify(docs: DataFrame, *, pieces: int = PIECES, margin: float = MARGIN) -> DataFrame:
    """Language of every document, learned from the rows whose crc32 of the id is not divisible by five.

    Returns doc_id, held_out, lang_pred, score (0 to 1), margin and rejected. A text that is null or has no letter is
    ``und`` with score 0 and rejected; a narrow win keeps its language and is only marked as rejected. Equal sizes go to
    the more frequent training language, then the smaller name. Without one labelled training row all texts are ``und``.
    Null ids are training rows; repeated rows each get a row; other columns, whatever their names, are ignored. Very
    long texts are read whole, in blocks.
    """
    rows = docs.select("doc_id", "text", "lang", common.held_out("doc_id", 5, 0).alias("held_out"))
    learned = dictionaries(rows.filter("not held_out"), pieces)
    return predict(rows.select("doc_id", "held_out", "text"), learned, margin)
