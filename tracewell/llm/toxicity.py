"""Toxicity of texts restored by a noisy channel: leetspeak, spacing and repetition are decoded under a character model."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import held_out, text_bytes

#: Letters that a written character may stand for (fixed values of common leetspeak).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
        "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou"}
#: Characters that may be put between letters.
FILLER = " .-_*"
LABELLED_ROWS = 20_000
CONTEXTS = 3
PRECISION = 0.85
PREFIXES = (4, 5)
CUTOFF = 0.7
SYMBOLS = 28  # boundary, a-z, any other letter
#: Costs in nats: reading a digit or sign as a letter, leaving out a filler, leaving out a repeat, keeping a plain letter.
COSTS = {"leet": 1.0, "filler": 0.5, "repeat": 0.5}
BEAM = 4
SLACK = 6.0

#: Pieces of a split word are no longer than PIECE, and the word read from them no longer than LONGEST.
PIECE, LONGEST = 3, 24
#: Above so many repeated letters the best ways of leaving some out are searched, not all listed.
DOUBLES = 5

WORD = re.compile(r"[^\W\d_]+")
#: A token with a letter next to a sign that may stand for one, or with fillers inside.
CORE = re.compile(r"[a-z][0-9@$!|+(<*]|[0-9@$!|+(<*][a-z]|[a-z][._\-]+[a-z]")
SPACED = re.compile(r"(?<!\S)\S(?:\s+\S(?!\S))+")
REPEAT = re.compile(r"([a-z])\1+")
PIECES = re.compile(r"(?<!\S)[a-z0-9@$!|+(<*]{1,%d}(?:\s+[a-z0-9@$!|+(<*]{1,%d}(?!\S))+" % (PIECE, PIECE))
LETTER, SIGN = re.compile(r"[a-z]"), re.compile(r"[0-9@$!|+(<*]")
EDGE = ".,;:?\"')[]{}"


def letter_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities of a letter after two others, counted over all texts: a table of 28 ** 3 whatever their number."""
    size = SYMBOLS ** 3
    code = np.zeros(256, np.int64)
    code[ord("a"):ord("z") + 1] = np.arange(1, 27)
    code[128:] = 27

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                text = b"  " + b"  ".join(text_bytes(batch.column(0).slice(at, 256))).lower() + b"  "
                c = code[np.frombuffer(text, "u1")]
                counts += np.bincount((c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:], minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(counts)[0]), pa.array(counts[counts > 0])], names=["code", "n"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size)
    counts[found["code"].to_numpy()] = found["n"].to_numpy()
    counts = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    pairs = counts.sum(axis=0)
    single = (pairs.sum(axis=0) + 1) / (pairs.sum() + SYMBOLS)
    double = (pairs + 10 * single) / (pairs.sum(axis=1, keepdims=True) + 10)
    return np.log((counts + 10 * double[None]) / (counts.sum(axis=2, keepdims=True) + 10))


def decode(span: str, model: list) -> list[str]:
    """Likely readings of a disguised span, best first: Viterbi over the lattice of letters, with a few paths per state.

    The span is in lower case. Every character is a letter it may stand for, or, as a filler or a repeat, nothing.
    """
    paths = {(0, 0): [(0.0, "")]}
    for c in span:
        letters = c if "a" <= c <= "z" else LEET.get(c, "")
        price = 0.0 if "a" <= c <= "z" else COSTS["leet"] * (2 if len(letters) > 2 else 1)
        grown: dict = {}
        for (a, b), best in paths.items():
            for cost, made in best:
                steps = []
                if c in FILLER or not letters:
                    steps.append((cost + COSTS["filler"], a, b, made))
                for letter in letters:
                    x = ord(letter) - 96
                    steps.append((cost + price - model[a][b][x], b, x, made + letter))
                    if made and x == b:
                        steps.append((cost + COSTS["repeat"], a, b, made))
                for total, p, q, text in steps:
                    grown.setdefault((p, q), []).append((total, text))
        paths = {k: _best(v) for k, v in grown.items()}
    final = _best([(cost - model[a][b][0], made) for (a, b), best in paths.items() for cost, made in best if made], 8)
    return [made for cost, made in final if cost <= final[0][0] + SLACK]


def _best(found: list[tuple[float, str]], count: int = BEAM) -> list[tuple[float, str]]:
    kept: dict[str, float] = {}
    for cost, made in found:
        if cost < kept.get(made, math.inf):
            kept[made] = cost
    return sorted((cost, made) for made, cost in kept.items())[:count]


def _literal(span: str) -> list[str]:
    """Readings that leave nothing out, up to eight: a rare double letter is far from the best path."""
    letters = [c if "a" <= c <= "z" else LEET.get(c, "") for c in span]
    return ["".join(p) for p in itertools.product(*letters)] if math.prod(map(len, letters)) <= 8 else []


class Restorer:
    """Words of texts with their disguises read; remembers readings, within a bound.

    With ``marks``, tokens that no path of the lattice reads as a mark are not decoded: none of their readings would be one.
    """

    def __init__(self, model: list, marks: set[str] | None = None):
        self.model, self.memo, self.marks = model, {}, marks
        self.heads = None if marks is None else {f[:k] for f in marks for k in range(len(f) + 1)}

    def _decode(self, span: str) -> list[str]:
        return decode(span, self.model) if self.marks is None or self._reaches(span) else []

    def _reaches(self, span: str) -> bool:
        """Whether the steps of decode, at any cost, lead to a mark."""
        states = {""}
        for c in span:
            letters = c if "a" <= c <= "z" else LEET.get(c, "")
            grown = {s + x for s in states for x in letters if s + x in self.heads} | {s for s in states for x in letters if s and s[-1] == x}
            states = grown | states if c in FILLER or not letters else grown
            if not states:
                return False
        return not states.isdisjoint(self.marks)

    def _read(self, span: str) -> list[str]:
        """Readings of a token: as a lattice, if letters meet signs or fillers, and of its words with repeated letters."""
        if span not in self.memo:
            if len(self.memo) > 300_000:
                self.memo.clear()
            made = []
            if CORE.search(span):
                bare = span.strip(EDGE)
                made += self._decode(bare) + _literal(bare)
                if span[:len(span) - len(span.lstrip(EDGE))].endswith("("):  # a parenthesis or a c
                    made += self._decode("(" + bare) + _literal("(" + bare)
            if REPEAT.search(span):
                made += [r for w in WORD.findall(span) if REPEAT.search(w) for r in self._undoubled(w)]
            self.memo[span] = made
        return self.memo[span]

    def _undoubled(self, word: str) -> list[str]:
        """The word with each repeated letter once or twice."""
        parts, at = [], 0
        for m in REPEAT.finditer(word):
            parts += [[word[at:m.start()]], [m.group(1), m.group(1) * 2]]
            at = m.end()
        if len(parts) > 2 * DOUBLES:
            return self._decode(word)
        return ["".join(p) for p in itertools.product(*parts, [word[at:]])]

    def readings(self, text: str) -> set[str]:
        """Readings of disguised spans and of words with repeated letters."""
        made = set()
        for token in set(text.split()):
            made.update(self._read(token))
        for m in SPACED.finditer(text):
            made.update(self._spaced(" ".join(m.group(0).split())))
        return made

    def _spaced(self, span: str) -> list[str]:
        key = f" {span}"  # no token begins with a blank
        if key not in self.memo:
            self.memo[key] = self._decode(span.strip(EDGE))
        return self.memo[key]

    def joined(self, text: str) -> set[str]:
        """Readings of all neighbouring short pieces as parts of one word: there are few true ones, so they make no marks."""
        made, seen = set(), set()
        for m in PIECES.finditer(text):
            pieces = m.group(0).split()
            for i in range(len(pieces) - 1):
                word = pieces[i]
                for piece in pieces[i + 1:]:
                    word += piece
                    if len(word) > LONGEST:
                        break
                    seen.add(word)
        for word in seen:
            if not SIGN.search(word):
                made.add(word)
            elif LETTER.search(word):
                made.update(self._read(word))
        return made


def features(words: set[str], readings: set[str]) -> set[str]:
    """Whole words, word beginnings (marked by an end sign) and readings of disguised spans."""
    return words | readings | {w[:k] + "~" for k in PREFIXES for w in words if len(w) > k}


def learn(docs: DataFrame, labels: DataFrame, model: np.ndarray, *, bound: int = LABELLED_ROWS) -> dict[str, float]:
    """Features whose presence marks toxic texts, with their precision, from at most ``bound`` labelled rows in hash order.

    A feature counts by the number of different words before it, a reading by that of different texts, so a much copied toxic
    text does not make its own words toxic. Candidates are counted and filtered in Spark; the marks alone are collected.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out("doc_id", 3, 1))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).collect()
    if not sample:
        return {}
    few = spark.createDataFrame(sample, "doc_id long, toxic int")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(few), "doc_id")  # at most ``bound`` rows
    table = model.tolist()

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(table)
        for batch in batches:
            pairs = set()
            for text in text_bytes(batch.column(0)):
                text = text.decode().lower()
                words = WORD.findall(text)
                for before, word in zip(["", *words], words):
                    pairs.update((f, before) for f in features({word}, set()))
                whole = xxhash.xxh64_hexdigest(text.encode())
                pairs.update((f, whole) for f in restorer.readings(text))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())], names=["feature", "before"])

    toxic = rows.filter("toxic = 1").select("text").mapInArrow(contexts, "feature string, before string")
    common = toxic.groupBy("feature", "before").count().groupBy("feature").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= CONTEXTS)

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, counts = Restorer(table), {}
        for batch in batches:
            for text, label in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist()):
                text = text.decode().lower()
                if len(counts) > 1_000_000:
                    yield emit(counts)
                    counts = {}
                for f in features(set(WORD.findall(text)), restorer.readings(text) | restorer.joined(text)):
                    counts.setdefault(f, [0, 0])[label] += 1
        yield emit(counts)

    def emit(counts: dict[str, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()),
                                           pa.array([c[1] for c in counts.values()], pa.int64())], names=["feature", "clean", "toxic"])

    found = rows.select("text", F.col("toxic").cast("int")).mapInArrow(presence, "feature string, clean long, toxic long")
    found = found.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    found = found.withColumn("p", (F.col("toxic") + 0.5) / (F.col("toxic") + F.col("clean") + 1)).filter(F.col("p") >= PRECISION)
    return {r["feature"]: r["p"] for r in found.join(common, "feature", "left_semi").collect()}


def _scorer(model: np.ndarray, marks: dict[str, float]):
    """Function from texts to scores: one minus the chance that every mark found is a false alarm; a low floor without any."""
    table = model.tolist()

    def start():
        known = set(marks)
        restorer = Restorer(table, known)
        heads = [(k, {f[:-1] for f in known if f[-1] == "~" and len(f) == k + 1}) for k in PREFIXES]

        def scores(texts: list[bytes]) -> list[float]:
            made = []
            for text in texts:
                text = text.decode().lower()
                words = set(WORD.findall(text))
                found = words & known
                for k, some in heads:
                    found.update(w[:k] + "~" for w in words if w[:k] in some and len(w) > k)
                found |= (restorer.readings(text) | restorer.joined(text)) & known
                best = sorted((marks[f] for f in found), reverse=True)[:3]
                made.append(1 - 0.98 * math.prod(1 - p for p in best))
            return made

        return scores

    return start


def score(docs: DataFrame, model: np.ndarray, marks: dict[str, float]) -> DataFrame:
    """(doc_id, score) of every row."""
    start = _scorer(model, marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = start()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(text_bytes(batch.column(1))), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def reject(docs: DataFrame, labels: DataFrame, *, cutoff: float = CUTOFF, bound: int = LABELLED_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is below the cutoff."""
    model = letter_model(docs)
    start = _scorer(model, learn(docs, labels, model, bound=bound))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = start()
        for batch in batches:
            yield batch.filter(pa.array(np.array(scores(text_bytes(batch.column(place))), float) < cutoff))

    return docs.mapInArrow(run, docs.schema)


def judge(docs: DataFrame, labels: DataFrame, *, cutoff: float = CUTOFF, bound: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    The letter model counts all texts; labels are read only where crc32 of the id leaves a remainder other than 1. A null or
    empty text has the floor score; null ids are scored and not held out; repeated rows are scored alike; without labels
    all scores are the floor; an empty table gives an empty result. Other columns are ignored.
    """
    model = letter_model(docs)
    found = score(docs, model, learn(docs, labels, model, bound=bound))
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))
