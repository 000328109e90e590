import random

import pytest
from pyspark.sql import functions as F

from jobmarket.llm import line_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def edited(rng, line, n):
    line = list(line)
    for _ in range(n):
        at = rng.randrange(len(line) + 1)
        what = rng.randrange(3)
        if what == 0:
            line.insert(at, rng.choice("abé𝄞"))
        elif line and what == 1:
            line.pop(min(at, len(line) - 1))
        elif line:
            line[min(at, len(line) - 1)] = rng.choice("xyzü")
    return "".join(line)


WS = " \t\n\x0b\x0c\r"


def brute(rows, t, per_edit):
    occ = []
    for at, (doc_id, text, *_) in enumerate(rows):
        for n, raw in enumerate((text or "").split("\n")):
            if raw.strip(WS):
                occ.append((doc_id is None, doc_id if doc_id is not None else 0, n, at, raw.strip(WS)))
    texts = sorted({o[4] for o in occ})
    may = lambda x, y: min(t, min(len(x), len(y)) // per_edit)
    near = {x: {y for y in texts if y != x and abs(len(x) - len(y)) <= may(x, y) and distance(x, y) <= may(x, y)} for x in texts}
    root = {}
    for x in texts:
        if x not in root:
            stack, members = [x], {x}
            while stack:
                for y in near[stack.pop()] - members:
                    members.add(y)
                    stack.append(y)
            for y in members:
                root[y] = x
    first = {}
    for o in sorted(occ):
        first.setdefault(root[o[4]], o)
    out = []
    for o in occ:
        f = first[root[o[4]]]
        out.append((None if o[0] else o[1], o[2], None if f[0] else f[1], f[2], len(near[o[4]])))
    return sorted(out, key=str), len(first)


@pytest.mark.parametrize("t", [1, 2, 3])
def test_equals_brute_force(spark, t):
    rng = random.Random(t)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.choice([8, 9, 10, 12, 19, 20, 22, 31, 60]))).strip() or "x" for _ in range(25)]
    rows = []
    for i in range(50):
        rows.append((i, "\n".join(edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3, 4])) for _ in range(rng.randrange(5))), None, None, None))
    rows += [(None, base[1] + "\r\n\n \t", None, None, None), (7, rows[7][1], None, None, None), (91, None, None, None, None), (92, "", None, None, None), (93, "q" * 40_000, None, None, None), (94, "q" * 39_999, None, None, None)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, DOCS), t).collect()
    quick = [r for r in rows if r[0] not in (93, 94)]
    want, classes = brute(quick, t, line_dedup.PER_EDIT)
    want = sorted(want + [(93, 0, 93, 0, 1), (94, 0, 93, 0, 1)], key=str)
    assert sorted([(r["doc_id"], r["line_no"], r["class_doc_id"], r["class_line_no"], r["n_links"]) for r in got], key=str) == want
    assert sum(r["kept"] for r in got) == classes + 1


def test_automaton_is_the_edit_distance(spark):
    rng = random.Random(8)
    pairs = [(a := "".join(rng.choice("abc") for _ in range(rng.randrange(14))), edited(rng, a, rng.randrange(5))) for _ in range(600)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for t in (0, 1, 2, 4):
        out = df.select("a", "b", line_dedup.within(line_dedup.characters(F.col("a")), line_dedup.characters(F.col("b")), t).alias("near")).collect()
        assert all(r["near"] == (distance(r["a"], r["b"]) <= t) for r in out)


def test_texts_lose_dropped_lines(spark):
    line = "a line that is long enough to compare"
    df = spark.createDataFrame([(1, line + "\nshort", "en", None, None), (2, "own text\n" + line + "s\nshort", "en", None, None), (3, None, "en", None, None)], DOCS)
    out = {r["doc_id"]: r["text"] for r in line_dedup.without_duplicate_lines(df, line_dedup.line_dedup(df)).collect()}
    assert out == {1: line + "\nshort", 2: "own text", 3: None}
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_short_lines_and_clashing_columns(spark):
    """One edit from ten characters on, two from twenty; line ends do not count."""
    rows = [(1, "All rights reserved\r\nyes", "x", 1), (2, "All rights reserved.\nyet", "x", 2), (3, "all rights reserved.", "x", 3), (4, "yes\r", "x", 4), (5, "123456789", "x", 5), (6, "123456780", "x", 6)]
    got = {(r["doc_id"], r["line_no"]): (r["class_doc_id"], r["n_links"]) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, line string, h long")).collect()}
    assert got == {(1, 0): (1, 1), (2, 0): (1, 2), (3, 0): (1, 1), (1, 1): (1, 0), (2, 1): (2, 0), (4, 0): (1, 0), (5, 0): (5, 0), (6, 0): (6, 0)}


def test_lines_that_share_a_hash_stay_apart(spark, monkeypatch):
    """With a first hash that is the same for all lines the second one tells them apart."""
    real = line_dedup.lines
    monkeypatch.setattr(line_dedup, "lines", lambda docs: real(docs).withColumn("h", F.lit(7).cast("long")))
    rows = [(i, f"a line of its own with number {i:03d} in it", None, None, None) for i in (1, 2, 222, 1)]
    got = [(r["doc_id"], r["class_doc_id"]) for r in line_dedup.line_dedup(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(got) == [(1, 1), (1, 1), (2, 2), (222, 222)]
