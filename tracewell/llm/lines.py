"""Line dedup by a segment-partition edit join, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import components, landed
from tracewell.llm.near import SHINGLE, SIMILARITY, alike
from tracewell.llm.quality import let

EDITS = 2
#: One edit is allowed for so many characters of the shorter line: numbers and short headings that differ stay apart.
CHARS_PER_EDIT = 20
#: Letters that the sketch of a line counts, four bits each.
LETTERS = "etaonis "
#: Letters that are counted for lines that met, before their pairs are compared.
MORE_LETTERS = "rhldcumfpgwbvkjx"
#: Letters of the sketch that travels with the keys of a line, four bits each.
KEY_LETTERS = LETTERS + MORE_LETTERS[:8]
#: Lines that make up more than one in HEAVY of all copied lines are compared at their first place alone; the others' copies meet on the keys.
HEAVY = 1 << 17
#: So many hashes of lines that met are sent to the tasks to fetch the texts; beyond that lines are shuffled.
SENT = 4_000_000
#: A document that lost this share to one earlier document of nearly its size may be that document's copy; the texts are compared then.
COPY_SHARE = 0.5
COPY_SIZE = 0.25


def allowed(length: Column, edits: int = EDITS, chars_per_edit: int = CHARS_PER_EDIT) -> Column:
    """Edits that a line of this length, the shorter of two, may be away."""
    return F.least(F.floor(length / chars_per_edit), F.lit(edits)).cast("int")


def _segment(i: Column, length: Column, edits: Column) -> tuple[Column, Column]:
    """(start, length) of segment ``i`` of the edits + 1 nearly equal ones of a line, counted from 0."""
    base, more = F.floor(length / (edits + 1)).cast("int"), length % (edits + 1)
    short = edits + 1 - more  # the last ``more`` segments are one longer
    return i * base + F.greatest(i - short, F.lit(0)), base + F.when(i >= short, 1).otherwise(0)


def _key(i: Column, length: Column, line: Column, start: Column, size: Column, plain: Column) -> Column:
    """Hash of a piece of the line; bytes of a plain (ASCII) line are reached without counting characters, to the same hash."""
    return F.when(plain, F.xxhash64(i, length, F.substring(line.cast("binary"), start + 1, size))).otherwise(
        F.xxhash64(i, length, F.substring(line, start + 1, size)))


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(how much shorter, segment, shift) of every probe.

    For each length and segment only the starts are probed at which the edits before and after the segment can still
    add up to ``edits``.
    """
    return [(shorter, i, shift) for shorter in range(edits + 1) for i in range(edits + 1)
            for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + edits - i) + 1)]


def _index_key(line: Column, length: Column, edits: Column, plain: Column, i: Column) -> Column:
    return _key(i, length, line, *_segment(i, length, edits), plain)


def _probe_key(line: Column, length: Column, edits: Column, plain: Column, shorter: Column, i: Column, shift: Column) -> Column:
    """Null where the start lies outside of the line."""
    at, size = _segment(i, length - shorter, edits)
    start = at + shift
    return F.when((start >= 0) & (start + size <= length), _key(i, length - shorter, line, start, size, plain))


def index_keys(line: Column, length: Column, edits: int, plain: Column | None = None) -> Column:
    plain = F.lit(False) if plain is None else plain
    return F.array(*[_index_key(line, length, F.lit(edits), plain, F.lit(i)) for i in range(edits + 1)])


def probe_keys(line: Column, length: Column, edits: int, plain: Column | None = None) -> Column:
    """Keys under which a line no longer than this one, and at most ``edits`` away, stands in the index."""
    plain = F.lit(False) if plain is None else plain
    return F.array_compact(F.array(*[_probe_key(line, length, F.lit(edits), plain, *map(F.lit, spec)) for spec in probes(edits)]))


def _specs(rows: list[tuple[int, ...]], names: list[str]) -> Column:
    return F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]))


def keyed(long: DataFrame, edits: int, chars_per_edit: int) -> tuple[DataFrame, DataFrame]:
    """(id, s, key) of the index and (other, t, key) of the probes. The length of the shorter line names its edits, so both agree.

    A line becomes a row per probe first and each row has one key: all keys in one expression make a method that the JVM does
    not compile.
    """
    line, n, plain, e, i = (F.col(c) for c in ("line", "n", "plain", "e", "i"))
    levels = range(1, edits + 1)
    index = long.select("id", "s", "line", "n", "plain", _specs([(v, k) for v in levels for k in range(v + 1)], ["e", "i"]))
    index = index.filter(allowed(n, edits, chars_per_edit) == e).select("id", "s", _index_key(line, n, e, plain, i).alias("key"))
    probe = long.select("id", "s", "line", "n", "plain", _specs([(v, *spec) for v in levels for spec in probes(v)], ["e", "shorter", "i", "shift"]))
    probe = probe.filter(allowed(n - F.col("shorter"), edits, chars_per_edit) == e)
    probe = probe.select(F.col("id").alias("other"), F.col("s").alias("t"), _probe_key(line, n, e, plain, F.col("shorter"), i, F.col("shift")).alias("key"))
    return index, probe.filter("key is not null")


def sketch(line: Column, letters: str = LETTERS) -> Column:
    """Counts of the letters modulo 16."""
    counts = [(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))).bitwiseAND(F.lit(15)).cast("long") for c in letters]
    return sum((F.shiftleft(n, 4 * k) for k, n in enumerate(counts)), F.lit(0).cast("long"))


def sketches_apart(a: Column, b: Column, letters: str = LETTERS) -> Column:
    """By how much the counts of two sketches differ at least."""
    apart = F.lit(0)
    for k in range(len(letters)):
        d = F.abs(F.shiftright(a, 4 * k).bitwiseAND(F.lit(15)) - F.shiftright(b, 4 * k).bitwiseAND(F.lit(15)))
        apart = apart + F.least(d, 16 - d)
    return apart


def sketches_near(a: Column, b: Column, edits: int) -> Column:
    """False only where more than ``edits`` edits lie between: each changes two counts by one at most."""
    return sketches_apart(a, b) <= 2 * edits


def counts_near(a: Column, b: Column, edits: int) -> Column:
    """False only where more than ``edits`` edits lie between two lines, by their sketches over KEY_LETTERS.

    An edit adds one to one count at most and takes one from one at most, so neither the counts that are higher in the first
    line nor those that are lower may differ by more than ``edits`` altogether. Eight counts at once are subtracted modulo 16 inside
    of a number; a difference stands for -7 to 7, one of eight for none.
    """
    top, low, byte = 0x88888888, 0x77777777, 0x0F0F0F0F

    def halves(x: Column) -> list[Column]:
        return [x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32)]

    def added(x: Column) -> Column:
        """Sum of the eight numbers of four bits."""
        pairs = x.bitwiseAND(F.lit(byte)) + F.shiftright(x, 4).bitwiseAND(F.lit(byte))
        return F.shiftright(pairs * F.lit(0x01010101), 24).bitwiseAND(F.lit(0xFF))

    def ahead(x: Column, y: Column) -> Column:
        """By how much the counts of x that are higher exceed those of y."""
        apart = (x.bitwiseOR(F.lit(top)) - y.bitwiseAND(F.lit(low))).bitwiseXOR(x.bitwiseXOR(y).bitwiseXOR(F.lit(top)).bitwiseAND(F.lit(top)))
        higher = F.shiftright(apart.bitwiseAND(F.lit(top)).bitwiseXOR(F.lit(top)), 3) * F.lit(7)
        return added(apart.bitwiseAND(higher))

    (a0, a1), (b0, b1) = halves(a), halves(b)
    return (ahead(a0, b0) + ahead(a1, b1) <= edits) & (ahead(b0, a0) + ahead(b1, a1) <= edits)


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of two texts is at most ``edits``, by bit vectors over the band of 2 * edits + 1 diagonals.

    Bit r of column j stands for row j - edits + r. The score follows the lowest diagonal down to the last row, then that
    row to the end. An equal beginning put before both texts leaves no text shorter than the band.
    """
    top, full = 2 * edits, (1 << (2 * edits + 1)) - 1

    def run(x: Column) -> Column:
        rows, cols = x["rows"], x["cols"]
        m, n = F.size(rows), F.size(cols)

        def step(s: Column, j: Column) -> Column:
            c = F.get(cols, j - 1)
            eq = sum((F.when(F.get(rows, j - 1 - edits + r) == c, F.lit(1 << r)).otherwise(F.lit(0)) for r in range(top + 1)), F.lit(0))

            def bits(v: Column) -> Column:
                vp, vn, e = v["vp"], v["vn"], v["eq"]

                def with_d(d: Column) -> Column:
                    hp = (vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(vp)))).bitwiseAND(F.lit(full))
                    hn = d.bitwiseAND(vp)
                    half = F.shiftright(d, 1)
                    down = F.when(d.bitwiseAND(F.lit(1 << top)) == 0, 1).otherwise(0)
                    bit = F.expr("1") * F.pow(F.lit(2), F.greatest(m - j + edits, F.lit(0))).cast("int")
                    side = F.when(hp.bitwiseAND(bit) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(bit) != 0, 1).otherwise(0)
                    return F.struct(hn.bitwiseOR(F.bitwise_not(half.bitwiseOR(hp)).bitwiseAND(F.lit(full))).alias("vp"), half.bitwiseAND(hp).alias("vn"),
                                    (v["dist"] + F.when(j <= m - edits, down).otherwise(side)).cast("int").alias("dist"))

                d0 = (((e.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(e).bitwiseOR(vn)).bitwiseAND(F.lit(full))
                return let(d0, with_d)

            return let(F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["dist"].alias("dist"), eq.alias("eq")), bits)

        start = F.struct(F.lit(full & ~((1 << edits) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("dist"))
        far = F.abs(m - n) > edits
        return F.when(far, False).otherwise(F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s["dist"] <= edits))

    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.abs(F.length(a) - F.length(b)) <= edits).otherwise(
        let(F.struct(F.split(F.concat(F.lit("x" * edits), a), "").alias("rows"), F.split(F.concat(F.lit("x" * edits), b), "").alias("cols")), run))


def close(a: Column, b: Column, edits: int, chars_per_edit: int) -> Column:
    """Whether two lines are at most as many edits apart as the shorter one allows."""
    of = allowed(F.least(F.length(a), F.length(b)), edits, chars_per_edit)
    return F.coalesce(*[F.when(of == e, within(a, b, e)) for e in range(1, edits + 1)], F.lit(False))


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id, size, line_no, line, id) of all lines with a visible character.

    text_id is a 64-bit hash of the text, which tells rows of one id apart, size its characters, id a 64-bit hash of the line.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    lines = rows.select("doc_id", F.xxhash64("t").alias("text_id"), F.length("t").alias("size"), F.posexplode(F.split("t", "\n", -1)).alias("line_no", "line"))
    return lines.filter(F.col("line").rlike("[^ \\t-\\r]")).withColumn("id", F.xxhash64("line"))


PLACE = ("doc_id", "line_no", "text_id", "size")


def first_copies(lines: DataFrame, copied: DataFrame) -> DataFrame:
    """Lines without the later copies of very frequent ones, of which there are at most HEAVY."""
    total = copied.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    heavy = copied.filter(F.col("copies") > total / HEAVY).select(F.col("id").alias("heavy"), F.col("place").alias("heavy_place"))
    return lines.join(F.broadcast(heavy), F.col("id") == F.col("heavy"), "left").filter(F.col("heavy").isNull() | F.struct(*PLACE).eqNullSafe(F.col("heavy_place")))


def classes(docs: DataFrame, edits: int = EDITS, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """(id, root, n_links, first) of the different lines that come twice or have a link: their class and its first place.

    Lines meet on (segment number, length, segment text). Only hashes and places are shuffled; the texts of lines that met are
    fetched afterwards. A place is (doc_id, line_no, text_id, size); the size travels with it, so that no join on a much
    copied document is needed.
    """
    lines = numbered(docs)
    places = lines.groupBy("id").agg(F.min(F.struct(*PLACE)).alias("place"), F.count(F.lit(1)).alias("copies"))
    copied = landed(places.filter("copies > 1"), "copied-lines")
    long = lines.withColumn("n", F.length("line")).filter(F.col("n") >= chars_per_edit)
    long = first_copies(long, copied).select("id", "line", "n", sketch(F.col("line"), KEY_LETTERS).alias("s"), (F.octet_length("line") == F.col("n")).alias("plain"))
    index, probe = keyed(long, edits, chars_per_edit)
    pairs = probe.join(index.repartition("key").distinct(), "key").filter((F.col("id") != F.col("other")) & counts_near(F.col("s"), F.col("t"), edits))
    pairs = landed(pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct(), "line-pairs")
    asked = landed(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "asked-lines")
    asked = F.broadcast(asked) if asked.count() <= SENT else asked
    texts = lines.join(asked, "id", "left_semi").groupBy("id").agg(F.min(F.struct(*PLACE)).alias("place"), F.max("line").alias("line"))
    texts = landed(texts.withColumns({"s": sketch(F.col("line")), "m": sketch(F.col("line"), MORE_LETTERS)}), "line-texts")
    sides = [texts.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("line", "s", "m")]) for x in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    near = sketches_apart(F.col("s_a"), F.col("s_b")) + sketches_apart(F.col("m_a"), F.col("m_b"), MORE_LETTERS)
    near = near <= 2 * allowed(F.least(F.length("line_a"), F.length("line_b")), edits, chars_per_edit)
    links = landed(both.filter(F.when(near, close(F.col("line_a"), F.col("line_b"), edits, chars_per_edit)).otherwise(False)).select("a", "b"), "line-links")
    counts = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    linked = landed(components(links).withColumnRenamed("node", "id").join(counts, "id").join(texts.select("id", "place"), "id"), "linked-lines")
    first = linked.groupBy("root").agg(F.min("place").alias("first"))
    alone = copied.join(linked, "id", "left_anti").select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("n_links"), F.col("place").alias("first"))
    return linked.join(first, "root").select("id", "root", "n_links", "first").union(alone)


def at_first() -> Column:
    """Whether a numbered line stands at the first place of its class; a line without a class is its own."""
    return F.col("first").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no")) & (F.col("text_id") == F.col("first.text_id")))


def line_classes(docs: DataFrame, edits: int = EDITS, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """(doc_id, line_no, class_doc, class_line, n_links, kept) of every line with a visible character.

    Two lines are linked that are at most ``edits`` edits apart, and at most one for each ``chars_per_edit`` characters of the
    shorter one; the shortest lines are therefore only compared for equality. The class of a line, named by its first place,
    holds the lines that chains of links connect; n_links is the number of different lines linked to it; kept is true at the
    first place alone. Null and empty texts have no lines; a null id sorts first; of rows with one id the texts are told apart by a
    64-bit hash and come in its order where line numbers tie; rows with one id and one text are one document, and all of
    them keep the place; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    found = numbered(docs).select("doc_id", "text_id", "line_no", "id").join(classes(docs, edits, chars_per_edit), "id", "left")
    doc, line = (F.when(F.col("first").isNull(), F.col(c)).otherwise(F.col(f"first.{c}")) for c in ("doc_id", "line_no"))
    return found.select("doc_id", F.col("line_no").cast("long"), doc.alias("class_doc"), line.cast("long").alias("class_line"),
                        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), at_first().alias("kept"))


def shingles(text: Column) -> Column:
    """Different hashes of the word shingles; fewer words are one shingle."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(plain, "[ \\t-\\r]+"), lambda w: w != "")
    return let(words, lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - SHINGLE + 1, F.lit(1))),
                                                             lambda i: F.xxhash64(F.array_join(F.slice(w, i, SHINGLE), " ")))))


def copies(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (doc_id, text_id, class_doc, class_text) whose whole texts are alike."""
    asked = pairs.select(F.explode(F.array(F.struct("doc_id", "text_id"), F.struct(F.col("class_doc").alias("doc_id"), F.col("class_text").alias("text_id")))).alias("x"))
    asked = asked.select(F.col("x.doc_id").alias("a"), F.col("x.text_id").alias("u")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("a"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).withColumn("u", F.xxhash64("t"))
    sets = texts.join(asked, ["a", "u"], "left_semi").select("a", "u", shingles(F.col("t")).alias("x")).dropDuplicates(["a", "u"])
    sets = landed(sets, "copy-shingles")
    both = pairs.join(sets.toDF("doc_id", "text_id", "x"), ["doc_id", "text_id"]).join(sets.toDF("class_doc", "class_text", "y"), ["class_doc", "class_text"])
    return both.filter(alike(F.col("x"), F.col("y"), SIMILARITY)).select("doc_id", "text_id", "class_doc", "class_text")


def drop_repeats(docs: DataFrame, edits: int = EDITS, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """Documents without the lines whose class has an earlier place, in the columns of ``docs`` (n_chars follows the text).

    Classes are those of ``line_classes``. A document goes where no visible line is left of those it had, or where at least half
    of it was taken by one earlier document within a quarter of its size and the whole texts have a Jaccard similarity of 0.8
    or more: what is left are the edits of a copy. Documents without visible lines stay, and so do rows with a null id, whose
    lines come first. Of rows with one id each loses its own lines alone; rows with one id and one text fare alike. Other columns come
    back as they are, whatever their names; an empty table gives an empty result.
    """
    found = numbered(docs).select("doc_id", "text_id", "size", "line_no", F.length("line").alias("n"), "id")
    lost = found.join(classes(docs, edits, chars_per_edit).select("id", "first"), "id").filter(~at_first() & F.col("doc_id").isNotNull())
    lost = lost.groupBy("doc_id", "text_id", F.col("first.doc_id").alias("class_doc"), F.col("first.text_id").alias("class_text")).agg(
        F.collect_set(F.struct("line_no", "n")).alias("some"), F.max("size").alias("size"), F.max("first.size").alias("class_size"))
    lost = lost.select("doc_id", "text_id", "class_doc", "class_text", "size", "class_size", F.col("some.line_no").alias("some"),
                       F.aggregate("some", F.lit(0).cast("long"), lambda n, x: n + x["n"]).alias("n"))
    lost = landed(lost, "lost-lines")
    other = (F.col("class_doc") != F.col("doc_id")) | (F.col("class_text") != F.col("text_id"))
    # a text that lost all its lines to one document goes anyhow
    copied = other & (F.col("n") + F.size("some") - 1 < F.col("size")) & (F.col("n") >= COPY_SHARE * F.col("size")) & (F.abs(F.col("class_size") - F.col("size")) <= COPY_SIZE * F.col("size"))
    same = copies(docs, lost.filter(copied).select("doc_id", "text_id", "class_doc", "class_text"))
    same = same.select("doc_id", "text_id").distinct().withColumn("copy", F.lit(True))
    per = lost.groupBy("doc_id", "text_id").agg(F.flatten(F.collect_list("some")).alias("gone")).join(same, ["doc_id", "text_id"], "left")
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_id"))
    joined = rows.join(per, ["doc_id", "text_id"], "left")
    lines = F.filter(F.split(F.col("row.text").cast("string"), "\n", -1), lambda x, i: ~F.array_contains(F.col("gone"), i))
    left = joined.select("row", "gone", "copy", F.when(F.col("gone").isNull(), F.col("row.text").cast("string")).otherwise(F.array_join(lines, "\n")).alias("text"))
    left = left.filter(F.col("gone").isNull() | (F.col("copy").isNull() & F.col("text").rlike("[^ \\t-\\r]")))
    made = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return left.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
