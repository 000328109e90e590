"""Line dedup by a segment-partition edit join, in DataFrame operations only.

Lines (split at newlines, ASCII white space trimmed) are equal, or near when their edit distance in code points is at most one for every
`per_edit` characters of the shorter line, and `threshold` at most: a line of under ten characters has no near lines, since one edit makes
another word of it. A line that may differ by t edits is cut into t + 1 segments; two near lines share one segment of the
shorter line as a substring of the longer one, at a place that the lengths and the segment's number allow
(a few shifts). Every line is indexed by its segments and probes the lengths L - t to L.

A key (length, segment number, substring) counts only if two different lines share it: one aggregation with
map-side combine over hashes finds those keys, and only lines that hold one are looked at again. Pairs are
screened by the parity of their characters (an edit flips two bits at most), then verified by a
banded bit-parallel automaton: the states within the band are bits of one word for each number of edits.

A line is known by two 64-bit hashes, 126 bits of which name it in classes, so unlike lines are not taken for one.
Near lines form classes (connected components); the first occurrence of a class in (doc_id, line number) order
stays. Empty lines are never duplicates. Null texts have no lines; null ids come last; repeated rows are later occurrences; other columns
of the documents are left out; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmarket.llm.common import components, sized, written

THRESHOLD, PER_EDIT = 2, 10
SPACES = " \t\n\x0b\x0c\r"


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line (trimmed, not empty), h and g (hashes of the line), chars."""
    each = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).select("doc_id", "line_no", F.trim("raw").alias("line"))
    # Trimming other characters than the space is slow, and few lines need it.
    odd = reduce(or_, [f(F.col("line"), F.lit(c)) for c in SPACES.strip(" ") for f in (F.startswith, F.endswith)])
    each = each.withColumn("line", F.when(odd, F.trim("line", F.lit(SPACES))).otherwise(F.col("line")))
    return each.where("line <> ''").withColumns({"h": F.xxhash64("line"), "g": F.xxhash64(F.lit(1), "line"), "chars": F.length("line")})


def name() -> Column:
    """A line's name: 64 bits of one hash and 62 of the other in one number."""
    return (F.col("h").cast("decimal(20,0)") * F.lit(1 << 62).cast("decimal(20,0)")).cast("decimal(38,0)") + F.col("g").bitwiseAND(F.lit((1 << 62) - 1)).cast("decimal(20,0)")


def edits(shorter: Column, threshold: int, per_edit: int) -> Column:
    """How many edits two lines may differ by, from the shorter one's length."""
    return F.least(F.lit(threshold), F.call_function("div", shorter, F.lit(per_edit)).cast("int"))


def segment_keys(each: DataFrame, threshold: int, per_edit: int) -> DataFrame:
    """Rows h, key, probe: a line's own segments (probe 0) and the substrings that it probes shorter lines with (probe 1)."""
    cuts = []
    for t in range(1, threshold + 1):
        for shorter in range(t + 1):
            for i in range(t + 1):
                left = t - i  # edits that the segments behind may take
                cuts += [(t, shorter, i, s, 0 if shorter == s == 0 else 1) for s in range(-i, i + 1) if shorter - left <= s <= shorter + left]
    # The cuts are constants, so each row below is one substring and one hash. A line from a length on needs those of the most edits only.
    rows = lambda some: F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("t", "shorter", "i", "shift", "probe"), c)]) for c in some])
    some = F.when(F.col("chars") >= threshold * (per_edit + 1), rows([c for c in cuts if c[0] == threshold])).otherwise(rows(cuts))
    long_lines = each.where(F.col("chars") >= per_edit).select("h", "line", "chars")
    cut = long_lines.select("*", F.inline(some)).where(edits(F.col("chars") - F.col("shorter"), threshold, per_edit) == F.col("t"))
    length = F.col("chars") - F.col("shorter")
    base = F.expr("cast((chars - shorter) div (t + 1) as int)")
    even = F.col("t") + 1 - length % (F.col("t") + 1)  # later segments have one more
    size = base + F.when(F.col("i") >= even, 1).otherwise(0)
    start = base * F.col("i") + F.greatest(F.lit(0), F.col("i") - even) + 1 + F.col("shift")
    fits = (start >= 1) & (start + size - 1 <= F.col("chars"))
    return cut.where(fits).select("h", F.xxhash64(length, "i", F.substring("line", start, size)).alias("key"), "probe")


def parity(line: Column) -> Column:
    """64 bits: is the number of characters of each class (code point modulo 64) odd."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(64)))
    return F.aggregate(characters(line), F.lit(0).cast("long"), lambda acc, c: acc.bitwiseXOR(bit(c)))


def characters(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0))


def within(a: Column, b: Column, threshold: int) -> Column:
    """Is the edit distance of two character arrays at most `threshold`."""
    return edit_distance(a, b, threshold) <= threshold


def edit_distance(a: Column, b: Column, threshold: int) -> Column:
    """The edit distance of two character arrays, threshold + 1 where it is beyond `threshold`.

    State (i characters of a, j of b, e edits) is bit i - j + threshold of word e. A step over b[j] keeps a bit where
    the characters match, and adds to word e + 1 a substitution (same bit), an insertion (one bit down) and,
    from the new word, a deletion (one bit up).
    """
    mask = (1 << (2 * threshold + 1)) - 1
    down = lambda x: F.shiftrightunsigned(x, 1)
    up = lambda x: F.shiftleft(x, 1).bitwiseAND(F.lit(mask))

    def matches(c: Column, j: Column) -> Column:
        word = F.lit(0)
        for d in range(-threshold, threshold + 1):
            word = word + F.when((j + d >= 0) & F.get(a, j + d).eqNullSafe(c), 1 << (d + threshold)).otherwise(0)
        return word

    def step(state: Column, equal: Column) -> Column:
        new: list[Column] = []
        for e in range(threshold + 1):
            w = state[f"w{e}"].bitwiseAND(equal)
            if e:
                before = state[f"w{e - 1}"]
                w = w.bitwiseOR(before).bitwiseOR(down(before)).bitwiseOR(up(new[e - 1]))
            new.append(w)
        return F.struct(*[w.alias(f"w{e}") for e, w in enumerate(new)])

    start = [1 << threshold]
    for _ in range(threshold):
        start.append((start[-1] | start[-1] << 1) & mask)
    first = F.struct(*[F.lit(w).alias(f"w{e}") for e, w in enumerate(start)])
    end = F.call_function("shiftleft", F.lit(1), F.size(a) - F.size(b) + threshold)
    least = lambda s: F.coalesce(*[F.when(s[f"w{e}"].bitwiseAND(end) != 0, F.lit(e)) for e in range(threshold + 1)], F.lit(threshold + 1))
    return F.when(F.abs(F.size(a) - F.size(b)) <= threshold, F.aggregate(F.transform(b, matches), first, step, least)).otherwise(threshold + 1)


def near_pairs(each: DataFrame, threshold: int = THRESHOLD, per_edit: int = PER_EDIT) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs a < b of names of near lines; and h, g, name of the lines that were looked at. each: rows of `lines`."""
    keys = segment_keys(each, threshold, per_edit)
    shared = keys.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.min("probe").alias("probe")).where("lo <> hi and probe = 0").select("key")
    shared = written(shared, "segments")
    hits = written(keys.join(sized(shared), "key").distinct(), "hits")
    wanted = written(hits.select("h").distinct(), "wanted")
    # One text for each line; lines that share the first hash are several.
    found = each.select("h", "g", "line").join(sized(wanted), "h").groupBy("h", "g").agg(F.first("line").alias("line"))
    found = written(found.select("h", "g", name().alias("name"), "line"), "lines")
    marked = hits.join(found.select("h", "name", parity(F.col("line")).alias("odd"), F.length("line").alias("chars")), "h")
    a, b = marked.where("probe = 0").alias("a"), marked.alias("b")
    most = f"least({threshold}, least(a.chars, b.chars) div {per_edit})"
    pairs = a.join(
        b,
        F.expr(f"a.key = b.key and a.name <> b.name and (b.probe = 1 or a.name < b.name) and bit_count(a.odd ^ b.odd) <= 2 * {most} and abs(a.chars - b.chars) <= {most}"),
    ).select(F.least("a.name", "b.name").alias("a"), F.greatest("a.name", "b.name").alias("b")).distinct()
    pairs = written(pairs, "line-pairs")
    text = found.select("name", characters(F.col("line")).alias("chars"))
    both = pairs.join(text.withColumnsRenamed({"name": "a", "chars": "left"}), "a").join(text.withColumnsRenamed({"name": "b", "chars": "right"}), "b")
    near = edit_distance(F.col("left"), F.col("right"), threshold) <= edits(F.least(F.size("left"), F.size("right")), threshold, per_edit)
    return both.where(near).select("a", "b"), found.select("h", "g", "name")


def line_dedup(docs: DataFrame, threshold: int = THRESHOLD, per_edit: int = PER_EDIT) -> DataFrame:
    """One row per line that is not empty: doc_id, line_no, class_doc_id, class_line_no, n_links, kept.

    The class is named by its first occurrence; n_links counts the different lines that are near.
    """
    each = lines(docs)
    found = written(each.select("doc_id", "line_no", "h", "g", F.monotonically_increasing_id().alias("at")), "occurrences")
    pairs, names = near_pairs(each, threshold, per_edit)
    pairs = written(pairs, "near-lines")
    links = pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name"))).groupBy("name").agg(F.count("*").alias("n_links"))
    classes = components(pairs).select(F.col("node").alias("name"), F.col("component").alias("root"))
    near = written(names.join(classes.join(links, "name"), "name").drop("name"), "line-classes")
    placed = found.join(sized(near), ["h", "g"], "left").select("doc_id", "line_no", "at", F.coalesce("root", name()).alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    placed = written(placed, "placed")
    first = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line_no", "at")).alias("first"))
    return placed.join(written(first, "first-lines"), "root").select(
        "doc_id", "line_no", F.col("first.doc_id").alias("class_doc_id"), F.col("first.line_no").alias("class_line_no"), "n_links", (F.col("at") == F.col("first.at")).alias("kept")
    )


def without_duplicate_lines(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """docs with the lines that decisions drop removed from text; doc_id must be unique in docs."""
    dropped = decisions.where("not kept").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("line_no").alias("_dropped"))
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("_dropped", i))
    joined = docs.join(dropped, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return joined.withColumn("text", F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).drop("_id", "_dropped")
