import json

import pytest
from pyspark.sql import functions as F

from jobmarket.functions.text import decoded_bytes, decoded_items
from jobmarket.operators import inbox, reports, tracking
from jobmarket.sources import boards, tables


def test_profiles_as_people_write_them(spark, tmp_path):
    full = {"name": "A", "skills": ["x"], "work_modes": ["Remote", {"mode": "hybrid", "country": " LT "}, "moon"], "max_english_level": "b2", "years_of_experience": 2.25}
    for name, content in (("a", json.dumps(full)), ("b", json.dumps({"name": "B", "skills": []})), ("bad", "{not json"), ("nameless", json.dumps({"skills": []}))):
        (tmp_path / f"{name}.json").write_text(content)
    got = {r["profile_id"]: r for r in tables.read_profiles(spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "b"}
    assert [tuple(m) for m in got["a"]["work_modes"]] == [("remote", ""), ("hybrid", "LT")] and got["a"]["max_english_level"] == "B2" and got["a"]["years_of_experience"] == 2.2
    assert got["b"]["work_modes"] == [] and got["b"]["max_english_level"] is None and got["b"]["experience_level"] == "Mid"


def test_raw_pages_are_decoded(spark, tmp_path):
    (tmp_path / "u.html").write_bytes("a č\n".encode() + b"\xff!")
    (tmp_path / "w.html").write_bytes("ačiū".encode("cp1257"))
    assert {r["file"]: r["html"] for r in tables.read_pages(spark, f"{tmp_path}/u.html").collect()} == {"u.html": "a č\n!"}
    assert tables.read_pages(spark, f"{tmp_path}/w.html", "cp1257").first()["html"] == "ačiū"
    empty = spark.createDataFrame([(bytearray(b""),), (None,)], "raw binary").select(decoded_bytes(F.col("raw")).alias("t")).collect()
    assert [r["t"] for r in empty] == ["", None]


def test_items_are_decoded_one_by_one(spark):
    df = spark.createDataFrame([(["&scaron;a", "b &amp; &#233;", ""],), ([],), (None,)], "x array<string>").select(decoded_items(F.col("x")).alias("x"))
    assert [r["x"] for r in df.collect()] == [["ša", "b & é", ""], [], None]


def test_tables_are_committed_together(spark, tmp_path):
    path = str(tmp_path)
    one, two = (spark.createDataFrame([(n,)], "n long") for n in (1, 2))
    tables.commit_tables({"a": one, "b": one}, path)
    tables.write_state(two, f"{path}/a")  # a writer that died before its commit
    assert tables.read_table(spark, path, "a", "n long").first()["n"] == 1 and tables.read_table(spark, path, "c", "n long").count() == 0
    tables.commit_tables({"b": two}, path)
    assert [tables.read_table(spark, path, t, "n long").first()["n"] for t in "ab"] == [1, 2]


def test_reports_begin_with_their_header(spark, tmp_path):
    rows = spark.createDataFrame([(2, "two"), (1, "one")], "at int, section string")
    reports.write_sections(rows, f"{tmp_path}/r", [F.col("at")], reports.PROMPT)
    assert (tmp_path / "r" / "header").exists()
    text = "".join(r["value"] + "\n" for r in spark.read.text(f"{tmp_path}/r/header", wholetext=True).collect())
    assert text.startswith("## AI Re-analysis Prompt\n\nYou are") and "4. Keyword/source recommendations" in text
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/r/*.txt").collect()] == ["one", "two"]


def test_long_command_lists_are_folded_in_runs(spark, monkeypatch):
    """The verdicts do not depend on where a list is cut."""
    new = ["Applied", "Interview", "Offer", "Rejected", "Withdrawn", "Saved", None]
    commands = spark.createDataFrame([(i, f"u{i % 3}", new[(i * 5) % 7], "corrective" if i % 4 == 0 else "normal", "why" if i % 4 == 0 else "") for i in range(200)], "id long, vacancy_source_url string, new_status string, kind string, reason string")
    apps = spark.createDataFrame([("u0", "Saved"), ("u1", "Offer")], "vacancy_source_url string, status string")
    out = []
    for size in (7, 10_000):
        monkeypatch.setattr(tracking, "FOLD", size)
        out.append({r["id"]: (r["previous_status"], r["verdict"]) for r in tracking.apply_commands(apps, commands).collect()})
    assert out[0] == out[1] and len(out[0]) == 200 and {v for _, v in out[0].values()} >= {"accepted", "no_application", "not_allowed"}


def test_inbox_options():
    q = inbox.InboxQuery(source="  a   b ", label="hIGH", status=" saved")
    assert (q.source, q.label, q.status) == ("a b", "High", "Saved")
    for bad in ({"label": "great"}, {"status": "hired"}, {"sort": "x"}, {"min_score": 101}):
        with pytest.raises(ValueError):
            inbox.InboxQuery(**bad)
    assert q.with_options(source=None, min_score=5) == inbox.InboxQuery("a b", "High", "Saved", min_score=5)
    cleared = q.with_options(clear_filters=True, source="c", new_only=True, sort="title")
    assert cleared == inbox.InboxQuery(current_run=True, sort="title") and not q.with_options(clear_filters=True, all_runs=True).only_current


def test_routing_needs_no_shuffle(spark):
    df = boards.route(spark.createDataFrame([("https://a.hh.ru/vacancy/1",), ("https://hh.ru/x",), (None,)], "url string"), boards.board_rows(spark, [boards.HH]))
    assert [r["board"] for r in df.collect()] == ["hh", None, None]
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert boards.route(df.drop("board"), boards.board_rows(spark, [boards.HH]).limit(0)).where("board is not null").count() == 0
