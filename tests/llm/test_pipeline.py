import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from jobmarket.llm import quality, registry


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(600)]
    rows = []
    for i in range(300):
        text = " ".join(rng.choice(vocab) for _ in range(rng.choice([20, 60, 200])))
        if i % 6 == 0:
            text = text.upper() + "!!"
        elif i % 6 == 1 and rows:
            text = rows[-1][1] if i % 12 == 1 else rng.choice(rows)[1]
        elif i % 6 == 2 and i > 10:
            text = rows[i - 3][1] + " tail"
        rows.append((i, text, "en", f"src{i % 5}" if i % 17 else None, len(text), "clash"))
    rows += [(500, None, "en", "src0", None, "clash"), (501, "", None, None, 0, "clash"), (502, rows[5][1], "en", "src1", 1, "clash"), (502, rows[5][1], "en", "src1", 1, "clash")]
    path = tmp_path_factory.mktemp("tables")
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    spark.createDataFrame(rows, schema).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame([(r[0], int(not r[1].isupper()), 0) for r in rows[:300]], "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return str(path)


def test_every_stage_equals_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], folder)
        path = f"file://{tmp_path}/{len(seen)}"
        out.write.parquet(path)
        seen.append(spark.read.parquet(path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert seen[-1].columns == docs.columns
    rows = [[tuple(r) for r in d.collect()] for d in seen]
    # quality: junk goes, the rest stays
    ids = {r[0] for r in rows[1]}
    labelled = [r for r in rows[0] if r[0] is not None and r[0] < 300]
    assert sum((r[0] in ids) == (not (r[1] or "").isupper()) for r in labelled) >= 0.97 * len(labelled)
    # exact: one of each text
    norm = lambda r: "".join(words(r[1]))
    best = {}
    for r in rows[1]:
        if norm(r) not in best or (-len(r[1] or ""), r[0]) < (-len(best[norm(r)][1] or ""), best[norm(r)][0]):
            best[norm(r)] = r
    assert Counter(rows[2]) == Counter(best.values())
    # near: one of each class, the smallest id
    sets = [{tuple(words(r[1])[i:i + 5]) for i in range(max(1, len(words(r[1])) - 4))} if words(r[1]) else set() for r in rows[2]]
    root = list(range(len(sets)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    keep = {}
    for i, r in enumerate(rows[2]):
        keep[find(i)] = min(keep.get(find(i), r), r, key=lambda x: x[0])
    assert Counter(rows[3]) == Counter(keep.values())
    # mixture: 1.5 times the words, no document more than twice
    n = lambda rs: sum(len(words(r[1])) for r in rs)
    assert n(rows[4]) == pytest.approx(1.5 * n(rows[3]), rel=0.1) and max(Counter(rows[4]).values()) <= 2 and set(rows[4]) <= set(rows[3])
    # packing: every appearance of a document, whole
    pieces = seen[5].collect()
    assert Counter(p["doc_id"] for p in pieces if p["piece"] == 0) == Counter(r[0] for r in rows[4])
    fill = Counter()
    for p in pieces:
        fill[p["sequence_id"]] += p["length"]
    assert max(fill.values()) <= 1024


def test_run_is_the_stages(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_clashing_columns_and_empty_table(spark, tmp_path):
    """Other columns, named as the stages name their own, come back as they were; an empty table passes through."""
    names = ["rank", "before", "position", "positions", "score", "target", "_row", "_label", "row", "doc", "kept", "order", "size", "uid", "sequence_id", "_metadata", "_file", "_place"]
    rng = random.Random(2)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in names)
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(40)), "en", f"s{i % 3}", 1, *range(100, 100 + len(names))) for i in range(30)]
    rows += [rows[3], rows[3], (None, None, None, None, None, *[None] * len(names))]
    for kind, table in (("full", rows), ("empty", [])):
        folder = f"{tmp_path}/{kind}"
        spark.createDataFrame(table, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in range(20)] if table else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, folder).write.parquet(f"{folder}/{n}")
            after = spark.read.parquet(f"{folder}/{n}")
            if n < 4:
                assert after.columns == docs.columns and set(map(tuple, after.collect())) <= set(table)
                docs = after
        assert (docs.count() > 30) == bool(table) == (after.count() > 0)
