"""Text reports: one rendered column, written in order by write.text; summaries and message chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobmarket.functions.text import escape_html, let, visible_text

EXCERPT = 1400
CHUNK = 3800
CHUNK_ROWS = 200  # messages that Python holds as its own texts at once


def _or(c: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(default))


def _lines(*parts: Column | str) -> Column:
    return F.array_join(F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts]), "\n")


def _field(name: str, c: Column) -> Column:
    return F.concat(F.lit(f"- {name}: "), c)


def excerpt(html: Column) -> Column:
    short = lambda text: F.when(text == "", "Not extracted").when(F.length(text) <= EXCERPT, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, EXCERPT)), F.lit("...")))
    return let(visible_text(F.coalesce(html, F.lit(""))), short)


def bullets(items: Column) -> Column:
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, "  - Not extracted").otherwise(F.array_join(F.transform(items, lambda x: F.concat(F.lit("  - "), F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))), "\n"))


def link(url: Column) -> Column:
    return F.when(F.coalesce(url, F.lit("")) == "", "Not specified").otherwise(F.concat(F.lit("["), url, F.lit("]("), url, F.lit(")")))


# The words of the sections, summaries and tables below are output that must stay as it is.


def vacancy_sections(rows: DataFrame) -> DataFrame:
    """Add `section`, the Markdown of one analysed vacancy."""
    joined = lambda c: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit("None"))
    return rows.withColumn("section", _lines(
        F.concat(F.lit("## "), F.coalesce("title", F.lit(""))), _field("Source", _or("source_name", "")), _field("Source ID", _or("source_id", "")), _field("Company", _or("company", "")),
        _field("Location", _or("location", "")), _field("Salary", _or("salary_text", "Not specified")), _field("Vacancy URL", link(F.col("source_url"))), "", "### Extracted Vacancy Data",
        "- Requirements / skills:", bullets(F.col("requirements")), "- Responsibilities / description:", bullets(F.col("responsibilities")), "- Raw text excerpt:", F.concat(F.lit("  "), excerpt(F.col("raw_text"))), "",
        "### Preliminary Software Analysis", "Use this only as a weak hint. Re-score independently from the vacancy data above.", _field("Analysis method", _or("analysis_method", "")), _field("Score", _or("score", "")),
        _field("Fit label", _or("fit_label", "")), _field("Explanation", _or("explanation", "")), _field("Matched points", joined("matched_points")), _field("Missing points", joined("missing_points")),
        _field("Application status", _or("application_status", "Not tracked")), "",
    ))


def tracked_sections(rows: DataFrame) -> DataFrame:
    return rows.withColumn("section", _lines(
        F.concat(F.lit("## "), F.coalesce("title", F.lit(""))), _field("Source", _or("source_name", "")), _field("Source ID", _or("source_id", "")), _field("Company", _or("company", "")),
        _field("Location", _or("location", "Not specified")), _field("Application status", _or("status", "")), _field("Notes", _or("notes", "None")), _field("Latest score", _or("score", "Not available")),
        _field("Latest fit label", _or("fit_label", "Not available")), _field("Vacancy URL", link(F.col("vacancy_source_url"))), "",
    ))


# Fixed text: what stands before the vacancies in a report for a model.
PROMPT = """## AI Re-analysis Prompt

You are an independent job-search analyst. This Markdown file contains structured vacancy data collected by software. Your task is to re-analyze the vacancies from scratch using the search intent below and each vacancy's Extracted Vacancy Data section.

Search intent: find strong roles around automation, AI automation, AI specialist work, workflow automation, RPA, no-code/low-code, API/system integrations, internal tools, AI agents, and practical AI tooling.

Important rules:
- Do not trust the existing software score, fit label, matched points, or missing points. Treat them only as a weak hint after your own review.
- Base your judgment primarily on title, company, location, salary, URL, requirements, responsibilities, and raw text excerpt.
- Do not require or infer a candidate profile. Evaluate whether each vacancy matches the search intent itself.
- Every ranked/recommended/rejected vacancy must include the exact Vacancy URL from the report.
- Prioritize automation, AI automation, AI specialist, workflow automation, RPA, no-code/low-code, integrations, and practical AI tooling roles.
- Penalize vacancies that are clearly unrelated, too senior/junior, not remote when remote is required, located in excluded countries, or focused on generic QA/dev work without automation/AI relevance.
- If data is incomplete, say what is missing instead of inventing details.

Return the result in this format:
1. A ranked table with columns: Rank, Fit 0-100, Priority, Vacancy, Company, Location, Why it fits, Risks, URL.
2. A shortlist of the top 5 vacancies with concrete next actions.
3. A reject list for poor-fit vacancies with one-sentence reasons.
4. Keyword/source recommendations to improve the next search run.
"""


def write_sections(rows: DataFrame, path: str, order: list[Column], header: str = "") -> None:
    """Text files whose parts follow the order; the header is a file of its own that sorts first."""
    rows.orderBy(*order).select("section").write.mode("overwrite").text(path)
    if header:
        rows.sparkSession.createDataFrame([(header,)], "section string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def daily_summary(rows: DataFrame, group: str, n: int = 10) -> DataFrame:
    """One summary text for each group (a run): counts, the top n by score and title, and how many more there are."""
    n = max(1, n)
    w = Window.partitionBy(group).orderBy(F.col("score").desc(), F.lower("title"), F.col("source_url"))
    top = rows.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= n)
    text = lambda c, default: escape_html(_or(c, default))
    entry = _lines(
        "", F.concat(F.col("_at").cast("string"), F.lit(". <b>"), text("title", "Untitled vacancy"), F.lit("</b>")), F.concat(text("company", "Unknown company"), F.lit(" | "), text("location", "Location not specified")),
        F.concat(F.lit("Score: <b>"), F.col("score").cast("string"), F.lit("</b> ("), text("fit_label", ""), F.lit(") | "), text("source_name", "")), F.concat(F.lit('<a href="'), escape_html(F.col("source_url")), F.lit('">Open vacancy</a>')),
    )
    # At most n entries for each group are collected into one text.
    entries = top.select(group, "_at", entry.alias("_e")).groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_e"))), lambda x: x["_e"]), "\n").alias("_entries"))
    counts = rows.groupBy(group).agg(F.count("*").alias("_n"))
    more = F.col("_n") - F.least(F.col("_n"), F.lit(n))
    body = F.concat(
        F.lit("New vacancies: <b>"), F.col("_n").cast("string"), F.lit("</b>\n\n<b>Top "), F.least(F.col("_n"), F.lit(n)).cast("string"), F.lit("</b>\n"), F.col("_entries"),
        F.when(more > 0, F.concat(F.lit("\n\nPlus "), more.cast("string"), F.lit(" more new vacancies in the local report."))).otherwise(""),
    )
    return counts.join(entries, group).select(group, F.col("_n").alias("new_vacancies"), body.alias("summary"))


def chunk_messages(messages: DataFrame, limit: int = CHUNK) -> DataFrame:
    """Rows of messages (with `text`), one for each chunk (`part`, `chunk`) of at most `limit` characters.

    A chunk ends at a blank line if it can, else at a newline, else anywhere.
    """
    rest = [c for c in messages.columns if c != "text"]
    schema = T.StructType([*[f for f in messages.schema if f.name != "text"], T.StructField("part", T.IntegerType()), T.StructField("chunk", T.StringType())])

    def cut(text: str) -> list[str]:
        out: list[str] = []
        held = ""
        for block in text.split("\n\n") if len(text) > limit else [text]:
            joined = f"{held}\n\n{block}" if held else block
            if len(joined) <= limit:
                held = joined
                continue
            if held:
                out.append(held)
            start = 0  # a place in the block: the rest of a long one is not copied for each chunk
            while len(block) - start > limit:
                at = block.rfind("\n", start, start + limit)
                at = at if at > start else start + limit
                out.append(block[start:at].rstrip())
                start = at
                while start < len(block) and block[start].isspace():
                    start += 1
            held = block[start:]
        return [*out, held] if held else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, CHUNK_ROWS):
                batch = whole.slice(first, CHUNK_ROWS)
                chunks = [cut(t or "") for t in batch.column("text").to_pylist()]
                rows = pa.array([i for i, c in enumerate(chunks) for _ in c], pa.int32())
                part, chunk = pa.array([i for c in chunks for i in range(len(c))], pa.int32()), pa.array([x for c in chunks for x in c], pa.string())
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in rest], part, chunk], [*rest, "part", "chunk"])

    return messages.mapInArrow(run, schema)


def excluded_rows(refined: DataFrame, why: str, n: int) -> DataFrame:
    """An exclusion list with its Markdown table rows."""
    from jobmarket.functions.text import escape_table_cell
    from jobmarket.operators.ranking import excluded

    cell = lambda c: escape_table_cell(F.coalesce(F.col(c).cast("string"), F.lit("")))
    url = F.coalesce(F.col("url"), F.lit(""))
    parts = [cell("rank"), cell("fit_score"), cell(f"{why}_risk"), cell("source"), F.concat(F.lit("["), cell("title"), F.lit("]("), url, F.lit(")")), cell("company"), cell("location"), F.concat(F.lit("[open]("), url, F.lit(")"))]
    return excluded(refined, why, n).withColumn("markdown_row", F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |")))


def ranking_rows(refined: DataFrame, n: int = 300) -> DataFrame:
    """The first n rows of a ranking with their rank and their HTML and Markdown table rows."""
    from jobmarket.functions.text import escape_table_cell
    from jobmarket.operators.ranking import top_report

    cells = ("rank", "rank_score", "priority", "title", "company", "location", "why", "risks")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    html = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), escape_html(text(c)), F.lit("</td>")) for c in cells], F.lit('<td><a href="'), escape_html(text("url")), F.lit('">Open</a></td></tr>'))
    markdown = F.concat(F.lit("| "), F.concat_ws(" | ", *[escape_table_cell(text(c)) for c in (*cells, "url")]), F.lit(" |"))
    return top_report(refined, n).withColumns({"html_row": html, "markdown_row": markdown})
