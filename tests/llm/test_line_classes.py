"""Line classes and what they leave of documents, against all pairs in plain Python."""

import random

import xxhash

from tracewell.llm import lines

SCHEMA = "doc_id long, text string, n_chars long, _gone string, _copy int, _doc string, _text string, gone int, copy int, row string, text_id string"


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def text_id(text):
    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def table():
    draw = random.Random(11)

    def edited(line):
        made = list(line)
        for _ in range(draw.randint(0, 3)):
            at = draw.randint(0, len(made) - 1)
            made[at:at + draw.randint(0, 1)] = draw.choice(["", "z", "q", "é"])
        return "".join(made)

    seeds = ["".join(draw.choice("abcdefgh  ñ") for _ in range(n)) for n in range(10, 62)]
    rows = []
    for i in range(60):
        own = [edited(draw.choice(seeds)) for _ in range(draw.randint(1, 5))]
        rows.append((draw.choice([i, i // 2]), "\n".join([*own, draw.choice(["", "  ", f"a line that row {i * 7919} has of its own"])])))
    rows += [(1, "A\nunique one a"), (90, "A\nunique one b"), (90, "unique line of the second row\nother"), (90, "A\nunique one b"), (91, None), (92, ""), (93, " \t")]
    return rows


def classes_of(rows):
    """{(doc, line_no, text_id): (first place, links)} by comparing all pairs of different lines."""
    places = {}
    for doc, text in rows:
        for at, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\n\v\f\r"):
                places.setdefault(line, set()).add((doc, at, text_id(text)))
    names = list(places)
    near = {a: {b for b in names if a != b and distance(a, b) <= min(2, min(len(a), len(b)) // 20)} for a in names}
    first = {}
    for a in names:
        if a not in first:
            group, todo = {a}, [a]
            while todo:
                more = near[todo.pop()] - group
                group |= more
                todo += more
            first.update({b: min(p for c in group for p in places[c]) for b in group})
    return {p: (first[a], len(near[a])) for a in names for p in places[a]}


def frame(spark, rows):
    return spark.createDataFrame([(d, t, len(t or ""), "g", 1, "d", "t", 2, 3, "r", "u") for d, t in rows], SCHEMA)


def test_classes_equal_all_pairs(spark):
    rows = table()
    want = classes_of(rows)
    assert 20 < sum(p != f for p, (f, _) in want.items()) and sum(n > 0 for _, n in want.values()) > 40
    expected = sorted((d, at, *want[d, at, text_id(t)][0][:2], want[d, at, text_id(t)][1], want[d, at, text_id(t)][0] == (d, at, text_id(t)))
                      for d, t in rows for at, line in enumerate((t or "").split("\n")) if line.strip(" \t\n\v\f\r"))
    assert sorted(tuple(r) for r in lines.line_classes(frame(spark, rows)).collect()) == expected


def test_each_row_loses_its_own_lines(spark):
    """Without copies of whole documents: no row here is nearly the size of one that took half of it and like it in words."""
    rows = table()
    want, expected = classes_of(rows), []
    for doc, text in rows:
        cut = [x for at, x in enumerate((text or "").split("\n")) if (doc, at, text_id(text)) not in want or want[doc, at, text_id(text)][0] == (doc, at, text_id(text))]
        if text is None or cut == text.split("\n"):
            expected.append((doc, text))
        elif "".join(cut).strip(" \t\n\v\f\r"):
            expected.append((doc, "\n".join(cut)))
    left = lines.drop_repeats(frame(spark, rows))
    assert left.columns == frame(spark, rows).columns
    got = left.collect()
    key = lambda r: (r[0], r[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=key) == sorted(expected, key=key)
    assert {tuple(r)[3:] for r in got} == {("g", 1, "d", "t", 2, 3, "r", "u")}
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None and r["n_chars"] is not None else r["n_chars"]) for r in got)
    assert {(90, "unique line of the second row\nother"), (90, "unique one b")} <= set(expected)
