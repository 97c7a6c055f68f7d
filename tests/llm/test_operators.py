"""The training-data operators against brute force, with nulls, empty texts, repeated rows, empty tables and odd columns."""

import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewell.llm import common, hilbert, lines, mixing, ordinal, packing, pitmanyor, quality, sequences, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, line string"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def row(i, text, lang="en", source="a"):
    return (i, text, lang, source, len(text or ""), "x", None, "y")


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    words = "the of and río straße naïve cat dog run sun 12 x1 It's A&B <b> #tag".split()
    made = [row(i, "\n".join(" ".join(draw.choice(words) for _ in range(draw.randint(1, 12))) for _ in range(draw.randint(1, 6))),
                draw.choice(["en", "de", None]), draw.choice("aaab")) for i in range(60)]
    long = " ".join(draw.choice(words) for _ in range(4000))
    return [*made, row(100, None), row(101, ""), row(102, "  \n\t"), row(103, long, None, None), row(104, long + " end"), row(105, "one"), row(106, "one"),
            row(None, "no id here"), row(7, made[7][1]), row(107, " odd  space\n\nx ")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0, "z") for i in range(60)] + [(None, 1, 1, "z"), (3, None, None, "z")],
                                 "doc_id long, quality int, toxic int, text string")


def test_simhash_equals_brute_force(spark, docs, empty, rows):
    got = simhash.simhash_components(docs).collect()
    assert len(got) == len(rows) and simhash.simhash_components(empty).count() == 0

    def print_of(text):
        w = SPLIT.findall(lower(text or ""))
        s = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    want = collections.Counter((r[0], f"{print_of(r[1]):016x}") for r in rows)
    assert collections.Counter((r["doc_id"], r["fingerprint"]) for r in got) == want


def test_simhash_links_are_complete(spark):
    draw = random.Random(1)
    base = [draw.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << k for k in draw.sample(range(64), n)) for b in base for n in (0, 1, 2, 2, 3, 4) for _ in range(3)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert got == want


def test_keep_one_keeps_null_ids_and_first_of_group(docs):
    kept = [r["doc_id"] for r in simhash.keep_one(docs).collect()]
    assert None in kept and kept.count(7) == 1 and 105 in kept and 106 not in kept


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    roots = {r["node"]: r["root"] for r in common.components(edges).collect()}
    assert roots == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_sequences_round_trip(spark, docs, empty, rows, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    ids = {r[0]: [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows}
    found = sequences.sequence_digests(docs, path, length=64).collect()
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        own = ids[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)
    assert len(found) == len(rows)
    index = sequences.write_sequences(docs.filter("doc_id = 103"), str(tmp_path / "s"), path, length=64, partitions=1).first()
    reader = sequences.SequenceReader(str(tmp_path / "s"), f"part-{index['file']:06d}.arrow")
    assert np.concatenate(reader.read(0, len(ids[103]))).tolist() == ids[103]
    last, mask = reader.sequence((len(ids[103]) - 1) // 64)
    assert mask.sum() == len(ids[103]) % 64 or mask.all()
    assert sequences.sequence_digests(empty, path).count() == 0


def test_packing_covers_every_token_once(docs, empty, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    want = collections.Counter()
    for r in rows:
        own = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want[r[0], zlib.crc32(own.tobytes())] += 1
    pieces = packing.pack(docs, path, window=64, packet=16).collect()
    places = sorted((p["sequence_id"], p["offset"], p["length"]) for p in pieces)
    assert all(a[0] * 64 + a[1] + a[2] == b[0] * 64 + b[1] for a, b in zip(places, places[1:]))
    assert all(o + n <= 64 for _, o, n in places) and places[0][:2] == (0, 0)
    parts = collections.defaultdict(list)
    for p in pieces:
        assert p["ids_crc32"] == zlib.crc32(p["ids"])
        parts[p["doc_id"], p["start"]].append(p["ids"])
    single = {k for k, n in collections.Counter(r[0] for r in rows).items() if n == 1}
    for (doc, crc), _ in want.items():
        if doc in single:
            assert zlib.crc32(b"".join(parts[k][0] for k in sorted(k for k in parts if k[0] == doc))) == crc
    assert packing.pack(empty, path).count() == 0


def test_packing_follows_weights(spark):
    docs = spark.createDataFrame([(i, "word " * 60, "ab"[i % 2]) for i in range(80)], "doc_id long, text string, source string")
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), weights={"a": 3, "b": 1}, window=256, packet=16).collect()
    first = [p for p in pieces if p["sequence_id"] < 8]
    share = sum(p["length"] for p in first if p["doc_id"] % 2 == 0) / sum(p["length"] for p in first)
    assert abs(share - 0.75) < 0.05


def test_mixing_stays_within_one_block(spark, docs, empty):
    shares = spark.createDataFrame([("a", 7), ("b", 2), ("c", 1), ("d", 13)], "queue string, share long")
    done = collections.Counter()
    for r in sorted(mixing.cycle(shares).collect(), key=lambda r: r["slot"]):
        done[r["queue"]] += 1
        assert all(abs(done[q] - (r["slot"] + 1) * a / 23) < 1 for q, a in (("a", 7), ("b", 2), ("c", 1), ("d", 13)))
    assert done == {"a": 7, "b": 2, "c": 1, "d": 13}
    mixed = mixing.mix(docs, block=256)
    assert mixed.filter("epoch = 0").count() == docs.count() and mixing.mix(empty).count() == 0
    assert mixing.mix(docs, epochs=False).count() == docs.count()


def test_line_distance_and_keys(spark):
    draw = random.Random(2)
    pairs = []
    for _ in range(300):
        a = "".join(draw.choice("abñ ") for _ in range(draw.randint(1, 50)))
        b = list(a)
        for _ in range(draw.randint(0, 4)):
            at = draw.randint(0, len(b))
            b[at:at + draw.randint(0, 1)] = draw.choice(["", "z", "b"])
        pairs.append((a, "".join(b)))
    found = spark.createDataFrame(pairs, "a string, b string").filter("b <> ''")
    for edits in (1, 2, 3):
        assert found.filter(lines.within(F.col("a"), F.col("b"), edits) != (F.levenshtein("a", "b") <= edits)).count() == 0
        near = found.filter(F.levenshtein("a", "b") <= edits).filter((F.length("a") > 8) & (F.length("b") > 8))
        longer = near.select(F.when(F.length("a") >= F.length("b"), F.col("a")).otherwise(F.col("b")).alias("p"),
                             F.when(F.length("a") >= F.length("b"), F.col("b")).otherwise(F.col("a")).alias("q"))
        met = F.arrays_overlap(lines.probe_keys(F.col("p"), F.length("p"), edits), lines.index_keys(F.col("q"), F.length("q"), edits))
        assert longer.filter(~met).count() == 0
        plain = F.octet_length("p") == F.length("p")
        for keys in (lines.index_keys, lines.probe_keys):
            assert longer.filter(keys(F.col("p"), F.length("p"), edits) != keys(F.col("p"), F.length("p"), edits, plain)).count() == 0
        assert longer.filter(~lines.sketches_near(lines.sketch(F.col("p")), lines.sketch(F.col("q")), edits)).count() == 0


def test_lines_and_their_documents(spark, docs, empty, rows):
    passage = "this is a passage that stands in several documents of the table"
    made = [row(1, f"own one\n{passage}\nlast"), row(2, f"{passage}s\nsomething else that is here alone"), row(3, passage.replace("several", "severel")),
            row(4, None), row(5, ""), row(None, passage)]
    table = spark.createDataFrame(made, SCHEMA)
    found = {(r["doc_id"], r["line_no"]): r for r in lines.line_classes(table).collect()}
    assert not found[2, 0]["kept"] and not found[1, 1]["kept"] and found[None, 0]["kept"] and found[2, 1]["kept"]
    left = {r["doc_id"]: r["text"] for r in lines.drop_repeats(table).collect()}
    assert left == {1: "own one\nlast", 2: "something else that is here alone", 4: None, 5: "", None: passage}
    assert lines.line_classes(empty).count() == 0 and lines.drop_repeats(empty).count() == 0
    seen = lines.line_classes(docs).count()
    assert seen == sum(bool(SPLIT.search(x)) for r in rows for x in (r[1] or "").split("\n"))


def test_quality_statistics_and_ratio(spark, docs, empty, rows, labels):
    trusted = labels.filter("quality = 1")
    good = {r["doc_id"] for r in trusted.collect()} - {None}
    got = quality.judge(docs, trusted, buckets=512).collect()
    assert len(got) == len(rows) and quality.judge(empty, trusted).count() == 0

    def grams(text):
        w = SPLIT.findall(text or "")
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        return [signed(xxhash.xxh64_intdigest(x, 42)) % 512 for x in w] + [signed(xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(a, 42))) % 512 for a, b in zip(w, w[1:])]

    raw, target = collections.Counter(), collections.Counter()
    for r in rows:
        raw.update(grams(r[1]))
        if r[0] in good:
            target.update(grams(r[1]))
    llr = {b: math.log((target[b] + 1) / (sum(target.values()) + 512)) - math.log((raw[b] + 1) / (sum(raw.values()) + 512)) for b in raw}
    want = collections.Counter()
    for r in rows:
        text = r[1] or ""
        w = SPLIT.findall(text)
        c = collections.Counter(zip(w, w[1:], w[2:]))
        again = {k for i in range(len(w) - 2) if c[tuple(w[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
        full = [x for x in text.split("\n") if SPLIT.search(x)]
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        g = grams(text)
        score = sum(llr[b] for b in g) / len(g) if g else 0.0
        want[r[0], len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), len(full) - len(set(full)), len(again), failed, round(score, 9)] += 1
    assert collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], round(r["score"], 9))
                               for r in got) == want
    assert all(r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD) for r in got)


def test_disguises_are_read(spark, sf):
    model = toxicity.letter_model(spark.read.parquet(f"{sf}/documents.parquet")).tolist()
    for span, word in (("st4nd", "stand"), ("t.h.e.r.e", "there"), ("thhhhe", "the"), ("a n d", "and")):
        assert word in toxicity.decode(span, model)


def test_toxicity_learns_and_leaves_held_out_labels(spark, empty, labels):
    made = [row(i, f"well {'abcdefgh'[i // 3 % 8]} {'grimble' if i % 3 == 0 else 'gentle'} {'xyz'[i % 2]} words number{i}") for i in range(60)]
    made += [row(200, "now gr1mble again"), row(201, "so g r i m b l e it"), row(202, None), row(203, ""), row(None, "gentle"), row(200, "now gr1mble again")]
    docs = spark.createDataFrame(made, SCHEMA)
    got = toxicity.judge(docs, labels).collect()
    assert len(got) == len(made) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"] for r in got if r["predicted"]} >= {0, 3, 57, 200} and not any(r["predicted"] for r in got if r["doc_id"] in (1, 2, 202, 203, None))
    assert toxicity.judge(empty, labels).count() == 0
    turned = labels.withColumn("toxic", F.when(common.held_out("doc_id", 3, 1), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted((r["doc_id"] or -1, r["score"]) for r in toxicity.judge(docs, turned).collect()) == sorted((r["doc_id"] or -1, r["score"]) for r in got)
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns and 0 not in {r["doc_id"] for r in kept.collect()}


def test_grades_rise_and_hold_out(spark, empty, labels):
    made = [row(i, " ".join(["bad", "mid", "good"][i % 3] for _ in range(20)) + f" w{i}") for i in range(240)]
    rated = spark.createDataFrame([(i, i % 3) for i in range(240)] + [(None, 1), (5, None)], "doc_id long, g int")
    got = ordinal.grades(spark.createDataFrame([*made, row(None, None), row(900, "")], SCHEMA), rated, F.col("g"), 3).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 240]
    assert len(got) == 242 and sum(r["predicted"] == r["doc_id"] % 3 for r in held) >= 0.9 * len(held)
    assert all(0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in got)
    assert ordinal.grades(empty, rated, F.col("g"), 3).count() == 0
    assert ordinal.grades(spark.createDataFrame(made[:3], SCHEMA), rated.limit(0), F.col("g"), 3).count() == 3


def test_pitman_yor_base_and_held_out(spark, docs, empty, rows):
    got = pitmanyor.score_texts(docs).collect()
    counts = collections.Counter()
    for r in rows:
        if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2:
            counts.update([*SPLIT.findall(lower(r[1] or "")), None])
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for r in rows:
        w = [*SPLIT.findall(lower(r[1] or "")), None]
        want[r[0], len(w), sum(x in counts for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got) and pitmanyor.score_texts(empty).count() == 0


def test_tables_never_exceed_customers():
    count = np.array([0, 1, 2, 50, 10_000])
    tables = pitmanyor.seat(count, np.full(5, 3.0), 0.6, np.random.default_rng(1))
    assert (tables <= count).all() and (tables[1:] >= 1).all() and tables[0] == 0


def test_hilbert_curve_and_search(spark):
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = hilbert.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512)) and np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1).max() == 1
    draw = np.random.default_rng(3)
    x = draw.normal(size=(30, 1, 8)) + 0.1 * draw.normal(size=(30, 40, 8))
    x = x.reshape(-1, 8)
    x[40:80] = x[40]
    table = [(i, v.tolist(), "t") for i, v in enumerate(x)] + [(5000, None, "t"), (5020, [0.0] * 8, "t"), (5040, [float("nan")] * 8, "t"), (None, [1.0] * 8, "t"), (20, x[20].tolist(), "t"), (5060, [1.0], "t")]
    frame = spark.createDataFrame(table, "vec_id long, embedding array<double>, score string")
    got = collections.defaultdict(list)
    for r in hilbert.search(frame, 20, 20).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1200, 20))
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(1200), -np.round(s, 12)))[:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(f[2] - s[f[1]]) < 1e-9 for f in found)
        hit += len({f[1] for f in found} & set(best.tolist()))
    assert hit >= 0.9 * 20 * len(got)
    assert hilbert.search(frame.limit(0)).count() == 0
