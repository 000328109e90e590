"""The refined ranking of scored vacancies: seniority and language blocks, priority, risks, report order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobmarket.functions.text import contains_any, report_text
from jobmarket.operators.score import texts

# Title terms in order, and the patterns of a year requirement and its surroundings.
SENIOR_TERMS = (
    "senior", "sr.", "sr ", "lead", "team lead", "leader", "principal", "staff", "head of", "manager", "director", "architect", "руководитель", "ведущий",
    "старший", "сеньор", "тимлид", "team leader", "tech lead", "technical lead",
)
JUNIOR_TERMS = ("junior", "entry", "entry-level", "entry level", "trainee", "intern", "assistant", "младший", "стажер", "стажёр", "praktikantas", "jaunesnysis")
YEARS = r"(?iuU)(\d+)\s*(?:-|to|–|—)?\s*(\d+)?\s*\+?\s*(?:years?|yrs?|лет|года|met(?:ų|u)?|m\.|lat\b|lata\b)"
CANDIDATE = (
    r"(?iu)experience|requirements|what we.?re looking for|looking for|you have|you bring|must have|required|commercial|professional|hands-on|proven|as a |"
    r"work experience|опыт|опыта|требования|стаж|doświadczenie|doswiadczenie|wymagania"
)
COMPANY = r"(?iu)global technology company|company with|company has|years of experience, committed|on the market|we have been|history|founded|employer|businesses"
ASKING = r"(?iu)looking for|requirements|you have|must have|required|опыт работы|what we"
REPORT_FIELDS = (
    "rank", "rank_score", "fit_score", "priority", "block_reason", "language_risk", "seniority_risk", "signals", "title", "company", "location", "salary", "source",
    "source_id", "why", "risks", "language_snippets", "url",
)


def year_requirements(body: Column) -> Column:
    """Array of years asked of a candidate: each number of years, if the window around it speaks of candidates and not of the company."""
    # What stands between the matches gives their places; only these two read the whole body.
    pieces = lambda whole: F.zip_with(F.slice(F.transform(F.split(body, YEARS, -1), F.length), 1, F.size(whole)), whole, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
    number = lambda x: x.try_cast("decimal(38,0)")

    def one(state: Column, p: Column) -> Column:
        start, m = state["at"] + p["gap"], p["m"]
        low = F.greatest(F.lit(0), start - 120)
        window = F.substring(body, low + 1, start + F.length(m) + 160 - low)
        company_only = window.rlike(COMPANY) & ~window.rlike(ASKING)
        years = F.greatest(number(F.regexp_extract(m, YEARS, 1)), number(F.regexp_extract(m, YEARS, 2)))
        asked = F.when(~company_only & window.rlike(CANDIDATE), years)
        return F.struct((start + F.length(m)).alias("at"), F.when(asked.isNotNull(), F.concat(state["years"], F.array(asked))).otherwise(state["years"]).alias("years"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<decimal(38,0)>").alias("years"))
    found = lambda whole: F.when(F.size(whole) > 0, F.aggregate(pieces(whole), begin, one, lambda s: s["years"]))  # noqa: E731  most bodies name no years
    # Bound to a variable, the matches are found once.
    return F.get(F.transform(F.array(F.regexp_extract_all(body, F.lit(YEARS), F.lit(0))), found), F.lit(0))


def title_and_url(title: Column, url: Column) -> Column:
    return F.concat(report_text(title), F.lit(" "), F.lower(F.coalesce(url, F.lit(""))))


def seniority(name: Column, years: Column) -> Column:
    """Struct (blocked, risk, note) from the terms of title and URL, else from the years that the body asks for (year_requirements)."""
    hits = F.filter(texts(*SENIOR_TERMS), lambda t: F.contains(name, t))
    need, risk = F.array_max(F.filter(years, lambda y: y >= 5)), F.array_max(F.filter(years, lambda y: (y >= 3) & (y < 5)))
    say = lambda blocked, text, note="": F.struct(F.lit(blocked).alias("blocked"), text.alias("risk"), F.lit(note).alias("note"))
    return (
        F.when(contains_any(name, JUNIOR_TERMS), say(False, F.lit("OK"), "junior/entry signal"))
        .when(F.size(hits) > 0, say(True, F.concat(F.lit("Senior-like title: "), F.array_join(F.slice(hits, 1, 4), ", "))))
        .when(need.isNotNull(), say(True, F.concat(F.lit("Requires "), need.cast("string"), F.lit("+ years"))))
        .when(risk.isNotNull(), say(False, F.concat(F.lit("Experience requirement may be "), risk.cast("string"), F.lit("+ years"))))
        .otherwise(say(False, F.lit("OK")))
    )


def refine(rows: DataFrame, vacancies: DataFrame) -> DataFrame:
    """Report rows (url, title, company, location, fit_score, language_risk, why, risks) with their blocks, rank score and priority.

    The body is the stored vacancy's searchable fields, or the row's own where the URL is not stored.
    """
    stored = vacancies.select(F.col("source_url").alias("url"), report_text(F.concat_ws(" ", "title", "company", "location", "salary_text", F.array_join("requirements", " "), F.array_join("responsibilities", " "))).alias("_stored"))
    own = report_text(F.concat_ws(" ", "title", "company", "location"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    out = rows.join(stored, "url", "left").withColumn("_body", F.coalesce("_stored", own)).withColumn("fit_score", F.coalesce(F.col("fit_score").cast("int"), F.lit(0)))
    out = out.withColumn("_name", title_and_url(F.col("title"), F.col("url"))).withColumn("_years", year_requirements(F.col("_body"))).withColumn("_senior", seniority(F.col("_name"), F.col("_years"))).withColumn("language_risk", F.coalesce("language_risk", F.lit("OK")))
    reasons = F.filter(F.array(F.when(F.col("language_risk") != "OK", F.col("language_risk")), F.when(F.col("_senior.blocked"), F.col("_senior.risk"))), lambda x: x.isNotNull())
    note = F.col("_senior.note")
    out = out.withColumns({
        "seniority_risk": F.col("_senior.risk"), "seniority_blocked": F.col("_senior.blocked"), "language_blocked": F.col("language_risk") != "OK", "blocked": F.size(reasons) > 0, "block_reason": F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise("OK"),
        "why": F.when((note != "") & ~F.contains(text("why"), note), F.regexp_replace(F.concat(text("why"), F.lit("; "), note), "^[; ]+|[; ]+$", "")).otherwise(F.col("why")),
    })
    out = out.withColumn("rank_score", F.when(F.col("blocked"), F.least(F.lit(29), F.col("fit_score"))).otherwise(F.col("fit_score")))
    base = F.filter(F.transform(F.split(text("risks"), ";"), lambda x: F.trim(x)), lambda r: (r != "") & ~F.startswith(r, F.lit("Requires ")) & ~F.startswith(r, F.lit("Senior-like title")))
    risks = F.array_join(F.concat(F.when(F.col("blocked"), F.array("block_reason")).otherwise(texts()), F.slice(base, 1, 5)), "; ")
    level = F.when(F.col("blocked"), "Blocked").when(F.col("rank_score") >= 82, "Top").when(F.col("rank_score") >= 68, "Strong").when(F.col("rank_score") >= 52, "Maybe").otherwise("Low")
    return out.withColumns({"priority": level, "risks": F.when(risks == "", "no major risk").otherwise(risks)}).drop("_stored", "_body", "_name", "_years", "_senior")


def report_order() -> list[Column]:
    return [F.col("blocked").asc(), F.col("rank_score").desc(), F.col("fit_score").desc(), F.lower("title").asc(), F.lower("company").asc(), F.col("url").asc()]


def top_report(refined: DataFrame, n: int) -> DataFrame:
    """The first n rows with their rank. A top-n is a report, so the rank needs one task over n rows only."""
    return refined.orderBy(*report_order()).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*report_order())))


def headline(refined: DataFrame) -> DataFrame:
    return refined.agg(
        F.count("*").alias("total"), F.count_if(~F.col("blocked")).alias("eligible"), F.count_if(F.col("blocked")).alias("blocked"),
        F.count_if(F.col("language_risk") != "OK").alias("language"), F.count_if(F.col("seniority_risk").rlike("^(Requires|Senior-like)")).alias("seniority"),
    )


def source_counts(refined: DataFrame) -> DataFrame:
    """Rows by source, the most first."""
    return refined.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "source")


#: Rows of the ranking and of each exclusion list in the two reports.
CUTS = {"html": (300, 160, 160), "markdown": (220, 140, 140)}


def excluded(refined: DataFrame, why: str, n: int) -> DataFrame:
    """The first n rows excluded by seniority or by language, best fit first, with their rank."""
    if why not in ("seniority", "language"):
        raise ValueError("why must be seniority or language")
    order = [F.col("fit_score").desc(), F.lower("title").asc(), F.col("url").asc()]
    top = refined.where(f"{why}_blocked").orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # n rows


def block_reasons(refined: DataFrame, n: int = 8) -> DataFrame:
    return refined.where("blocked").groupBy("block_reason").count().orderBy(F.col("count").desc(), "block_reason").limit(n)
