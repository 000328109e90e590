"""Vacancies from page HTML: ordered patterns, JSON-LD, a gate that turns bad pages into rejected rows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobmarket.functions.text import MARK, clean_markup, collapse, decoded_groups, decoded_items, let, visible_decoded, visible_text
from jobmarket.functions.urls import parts
from jobmarket.operators.score import searchable_text
from jobmarket.sources.boards import Board, excluded_location, looks_remote, page_blocked, source_id, vacancy_url

# Patterns in order of preference; the first that gives text wins.
PATTERNS = {
    "title": (r"(?is)<h1[^>]*>(.*?)</h1>", r'(?is)<meta\s+property="og:title"\s+content="([^"]+)"', r'(?is)<meta\s+name="twitter:title"\s+content="([^"]+)"', r"(?is)<title[^>]*>(.*?)</title>"),
    "company": (r'(?is)<[^>]+data-testid="company-name"[^>]*>(.*?)</[^>]+>', r'(?is)<[^>]+class="[^"]*(?:company|employer)[^"]*"[^>]*>(.*?)</[^>]+>'),
    "location": (r'(?is)<[^>]+data-testid="location"[^>]*>(.*?)</[^>]+>', r'(?is)<[^>]+class="[^"]*(?:location|job-location)[^"]*"[^>]*>(.*?)</[^>]+>'),
    "salary_text": (r'(?is)<[^>]+data-testid="salary"[^>]*>(.*?)</[^>]+>', r'(?is)<[^>]+class="[^"]*(?:salary|compensation)[^"]*"[^>]*>(.*?)</[^>]+>'),
    "description": (
        r'(?is)<[^>]+data-testid="job-description"[^>]*>(.*?)</(?:section|div|article)>',
        r'(?is)<(?:section|div|article)[^>]+class="[^"]*(?:description|content|job-description)[^"]*"[^>]*>(.*?)</(?:section|div|article)>',
        r"(?is)<main[^>]*>(.*?)</main>", r"(?is)<article[^>]*>(.*?)</article>",
    ),
}
#: The same holds for these.
SKILLS = (r'(?is)<[^>]+data-testid="skill"[^>]*>(.*?)</[^>]+>', r'(?is)<[^>]+class="[^"]*(?:skill|tag|badge)[^"]*"[^>]*>(.*?)</[^>]+>')
JSON_LD = r'(?is)<script[^>]+type="application/ld\+json"[^>]*>(.*?)</script>'
#: The layout with jobad_* ids.
JOBAD = {
    "title": (r'(?is)<h1[^>]*id="jobad_heading1"[^>]*>(.*?)</h1>', r'(?is)<h1[^>]*class="title"[^>]*>(.*?)</h1>', r'(?is)<meta\s+property="og:title"\s+content="([^"]+)"'),
    "company": (r'(?is)<h2[^>]*id="jobad_company_title"[^>]*>(.*?)</h2>', r'(?is)<div[^>]*class="company"[^>]*>(.*?)</div>'),
    "place": (r'(?is)<div[^>]*id="jobad_location"[^>]*>(.*?)</div>',),
}
SECTION = r'(?is)<h2[^>]*>\s*%s\s*</h2>\s*<div[^>]*class="jobad_txt"[^>]*>(.*?)</div>'
INTRO = r'(?is)<section>\s*<div[^>]*class="jobad_txt"[^>]*>(.*?)</div>\s*</section>'
LEGACY_LIST = r'(?is)<div\s+class="%s">\s*<ul>(.*?)</ul>\s*</div>'
JOBAD_SALARY = (
    SECTION % "Atlyginimas", r'(?is)<div[^>]*class="data_tag_component_body[^"]*salary_bl_[^"]*"[^>]*>(.*?)</div>', r'(?is)<span[^>]*class="data_tag_component_salary_amount"[^>]*>(.*?)</span>',
    r'(?is)<div\s+class="salary">\s*(.*?)\s*</div>',
)
MAX_SKILL = 60


def first_match(html: Column, patterns: Sequence[str], unclosed: bool = True) -> Column:
    """Cleaned text of the first pattern that gives some; empty if none does. unclosed: as in unescape."""
    return F.coalesce(*[F.nullif(clean_markup(F.regexp_extract(html, p, 1), unclosed), F.lit("")) for p in patterns], F.lit(""))


def bare(c: Column) -> Column:
    """Decoded text without tags; usable inside a lambda."""
    return collapse(F.regexp_replace(c, "<[^>]+>", " "))


def list_items(block: Column) -> Column:
    return F.filter(F.transform(decoded_items(_items(block)), bare), lambda x: x != "")


def _items(block: Column) -> Column:
    return F.regexp_extract_all(block, F.lit(r"(?is)<li>(.*?)</li>"), F.lit(1))


def _first(texts: Column) -> Column:
    """The first text that is not empty, else null."""
    return F.get(F.filter(texts, lambda x: x != ""), F.lit(0))


def _captures(html: Column, patterns: Sequence[str]) -> Column:
    return F.array(*[F.regexp_extract(html, p, 1) for p in patterns])


def jobad_cuts(html: Column, requirement_headings: Sequence[str], duty_headings: Sequence[str]) -> dict[str, Column]:
    """The raw pieces of a page in the jobad layout, arrays by name; of a section its items and its whole text."""
    cuts = {name: _captures(html, patterns) for name, patterns in JOBAD.items()} | {"salary": _captures(html, JOBAD_SALARY)}
    for part, headings in (("requirements", requirement_headings), ("responsibilities", duty_headings)):
        blocks = [F.regexp_extract(html, SECTION % re.escape(h), 1) for h in headings]
        cuts |= {f"{part} {i}": _items(block) for i, block in enumerate(blocks)}
        cuts |= {part: F.array(*blocks, F.regexp_extract(html, INTRO, 1)), f"old {part}": _items(F.regexp_extract(html, LEGACY_LIST % part, 1))}
    return cuts


def _section(piece: Callable[[str], Column], part: str, headings: Sequence[str], intro: bool = False) -> Column:
    """List items of the first heading's section that has any, or its whole text as one item; then intro and legacy list."""
    texts = lambda name: F.filter(piece(name), lambda x: x != "")
    whole = lambda i: F.get(piece(part), F.lit(i))
    tries = [F.when(F.size(texts(f"{part} {i}")) > 0, texts(f"{part} {i}")).when(whole(i) != "", F.array(whole(i))) for i in range(len(headings))]
    if intro:
        tries.append(F.when(whole(len(headings)) != "", F.array(whole(len(headings)))))
    old = texts(f"old {part}")
    return F.coalesce(*tries, F.when(F.size(old) > 0, old), F.array().cast("array<string>"))


def jobad_fields(html: Column, url: Column, requirement_headings: Sequence[str], duty_headings: Sequence[str], piece: Callable[[str], Column] | None = None) -> dict[str, Column]:
    """Fields of the jobad layout: place splits into location and company, salary has three places, sections become lists.

    piece gives the cleaned texts of a cut by its name; without it they are made here, for each field anew.
    """
    if piece is None:
        cuts = jobad_cuts(html, requirement_headings, duty_headings)
        piece = lambda name: F.transform(decoded_items(cuts[name]), bare)
    text = lambda name, at=1, n=9: F.coalesce(_first(F.slice(piece(name), at, n)), F.lit(""))
    split = F.split(text("place"), " - ", 2)
    amount = F.regexp_extract(html, JOBAD_SALARY[2], 1) != ""
    return {
        "source_id": F.coalesce(F.nullif(F.regexp_extract(html, 'data-source-id="([^"]+)"', 1), F.lit("")), F.nullif(F.regexp_extract(url, r"/(1-\d+)", 1), F.lit("")), path_id(url)),
        "title": text("title"),
        "company": F.coalesce(_first(piece("company")), F.trim(F.coalesce(F.get(split, F.lit(1)), F.lit("")))),
        "location": F.trim(F.get(split, F.lit(0))),
        "salary_text": F.when(html.rlike(JOBAD_SALARY[0]), text("salary", 1, 1)).when(amount, text("salary", 2, 2)).otherwise(text("salary", 4)),
        "requirements": _section(piece, "requirements", requirement_headings),
        "responsibilities": _section(piece, "responsibilities", duty_headings, intro=True),
    }


def path_id(url: Column) -> Column:
    path = F.trim(parts(url)["path"], F.lit("/"))
    return F.coalesce(F.nullif(path, F.lit("")), url)


def _all(html: Column, *patterns: str) -> Column:
    return F.concat(*[F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in patterns])


def skill_tags(cleaned: Column, most: int | None = MAX_SKILL) -> Column:
    """Skills from the cleaned texts of the tags: the first of each, none empty or too long."""
    found = F.array_distinct(F.filter(cleaned, lambda x: x != ""))
    return F.filter(found, lambda x: F.length(x) <= most) if most else found


#: Scripts that may hold a posting more than two levels deep: two graphs, or a list inside a list.
DEEP = r"(?s)@graph.*@graph|[\[,]\s*\["


def find_posting(scripts: list[str]) -> str | None:
    """JSON of the first posting, depth first: an object, an item of a list, or an item of @graph, however deep."""
    for script in scripts:
        try:
            open_ = [iter([json.loads(script.strip())])]
        except (ValueError, RecursionError):  # nested beyond what JSON readers take: as if it did not parse
            continue
        while open_:
            item = next(open_[-1], open_)
            if item is open_:
                open_.pop()
            elif isinstance(item, list):
                open_.append(iter(item))
            elif isinstance(item, dict):
                if item.get("@type") == "JobPosting":
                    return json.dumps(item)
                if isinstance(item.get("@graph"), list):
                    open_.append(iter(item["@graph"]))
    return None


@F.pandas_udf(T.StringType())
def _deep_posting(scripts: pd.Series) -> pd.Series:
    return scripts.map(lambda s: find_posting(s.split(MARK)), na_action="ignore")


def job_posting(html: Column) -> Column:
    """VARIANT of the first ld+json JobPosting: an object, an item of a list, or an item of @graph.

    Two levels are column expressions. Pages whose scripts may nest deeper, and name a posting, are searched to any depth in Python; others send it a null.
    """
    return posting_in(decoded_items(_all(html, JSON_LD)))


def posting_in(texts_: Column) -> Column:
    """The same of a page's decoded scripts; they are named more than once, so they should be a column."""
    joined = F.array_join(texts_, MARK)
    deep = F.contains(joined, F.lit("JobPosting")) & joined.rlike(DEEP)
    scripts = F.transform(texts_, lambda s: F.try_parse_json(F.trim(s)))
    is_posting = lambda v: F.try_variant_get(v, "$['@type']", "string") == "JobPosting"
    none = F.array().cast("array<variant>")
    inside = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    level = F.flatten(F.transform(F.filter(scripts, lambda v: v.isNotNull()), inside))
    for _ in range(2):
        level = F.flatten(F.transform(level, lambda v: F.when(is_posting(v), F.array(v)).otherwise(F.coalesce(F.try_variant_get(v, "$['@graph']", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"), none))))
    return F.when(deep, F.try_parse_json(_deep_posting(F.when(deep, joined)))).otherwise(F.get(F.filter(level, is_posting), F.lit(0)))


def posting_fields(v: Column) -> dict[str, Column]:
    """Company, location and salary text of a JobPosting."""
    get = lambda x, path: F.coalesce(bare(F.try_variant_get(x, path, "string")), F.lit(""))  # noqa: E731  decoded with its script
    places = F.coalesce(F.try_variant_get(v, "$.jobLocation", "array<variant>"), F.array(F.try_variant_get(v, "$.jobLocation", "variant")))
    names = F.flatten(F.transform(F.filter(places, lambda p: p.isNotNull()), lambda p: F.array(*[get(p, f"$.address.{k}") for k in ("addressLocality", "addressRegion", "addressCountry")])))
    paid = F.struct(*[get(v, f"$.baseSalary.{p}").alias(k) for k, p in (("low", "value.minValue"), ("high", "value.maxValue"), ("unit", "value.unitText"), ("money", "currency"))])

    def range_text(x: Column) -> Column:
        low, high, tail = x["low"], x["high"], F.concat(F.lit(" "), x["money"], F.lit(" "), x["unit"])
        return F.when((low != "") & (high != ""), F.concat(low, F.lit("-"), high, tail)).when(low != "", F.concat(F.lit("from "), low, tail)).when(high != "", F.concat(F.lit("up to "), high, tail)).otherwise("")

    salary = let(paid, range_text)
    return {
        "title": get(v, "$.title"), "company": get(v, "$.hiringOrganization.name"), "location": F.array_join(F.array_distinct(F.filter(names, lambda x: x != "")), ", "),
        "salary_text": F.trim(F.regexp_replace(salary, " +", " ")), "description": get(v, "$.description"),
    }


def vacancies(pages: DataFrame, board: Board) -> DataFrame:
    """pages (url, html, any others) to vacancy fields, searchable text and reject_reason (null for a good page).

    Reasons in order: blocked, not_remote, excluded_location, no_title; a bad page is a row, never a failed job.
    """
    html, url = F.coalesce(F.col("html"), F.lit("")), F.coalesce(F.col("url"), F.lit(""))
    if board.layout == "jobad":
        cuts = jobad_cuts(html, board.requirement_headings, board.duty_headings)
    else:
        cuts = {name: _captures(html, patterns) for name, patterns in (PATTERNS | dict(board.patterns)).items()} | {"skills": _all(html, *SKILLS), "scripts": _all(html, JSON_LD)}
    # Each step is a column of its own: a page is cut once, decoded once and cleaned once, however many fields name a piece.
    staged = pages.withColumn("_cuts", F.array(F.array(html), *cuts.values())).withColumn("_cuts", decoded_groups(F.col("_cuts")))
    raw = lambda name: F.get(F.col("_cuts"), F.lit(list(cuts).index(name) + 1))
    piece = lambda name: F.get(F.col("_clean"), F.lit(list(cuts).index(name)))
    staged = staged.withColumn("_visible", visible_decoded(F.get(F.get(F.col("_cuts"), F.lit(0)), F.lit(0))))
    staged = staged.withColumn("_clean", F.transform(F.slice("_cuts", 2, len(cuts) - ("scripts" in cuts)), lambda g: F.transform(g, bare)))
    if board.layout == "jobad":
        out = staged.withColumns(jobad_fields(html, url, board.requirement_headings, board.duty_headings, piece))
    else:
        out = staged.withColumn("_scripts", raw("scripts")).withColumn("_posting", posting_struct(F.col("_scripts")))
        value = lambda name: F.coalesce(_first(piece(name)), F.col(f"_posting.{name}"), F.lit(""))
        out = out.withColumns({**{n: value(n) for n in ("title", "company", "location", "salary_text")}, "_description": value("description")})
        out = out.withColumns({
            "source_id": source_id(url, html, board), "requirements": skill_tags(piece("skills")),
            "responsibilities": F.when(F.col("_description") != "", F.array("_description")).otherwise(F.array().cast("array<string>")),
        })
    out = out.withColumns({"source_name": F.lit(board.name), "source_url": vacancy_url(url, board)})
    reason = F.when(page_blocked(html, F.col("_visible"), board), "blocked")
    if board.remote_only:
        reason = reason.when(~looks_remote(F.col("title"), F.col("location"), F.col("source_url"), html, board.remote_markers, board.fold_io), "not_remote")
    if board.exclude_locations:
        reason = reason.when(excluded_location(F.col("location"), board.excluded_locations), "excluded_location")
    out = out.withColumn("reject_reason", reason.when(F.col("title") == "", "no_title"))
    out = out.withColumn("searchable", searchable_text(*[F.col(c) for c in ("title", "company", "location", "salary_text", "requirements", "responsibilities")]))
    return out.drop("_cuts", "_clean", "_scripts", "_visible", "_posting", "_description")


def posting_struct(scripts: Column) -> Column:
    """Fields of the posting in a page's decoded scripts; null for a page without scripts."""
    return F.when(F.size(scripts) > 0, let(posting_in(scripts), lambda v: F.struct(*[c.alias(k) for k, c in posting_fields(v).items()])))


def postings(pages: DataFrame) -> DataFrame:
    """pages with ld+json scripts, and the fields of their first posting."""
    found = pages.where(F.col("html").rlike(JSON_LD)).withColumn("_scripts", decoded_items(_all(F.col("html"), JSON_LD)))
    return found.withColumn("_posting", posting_struct(F.col("_scripts"))).select(*pages.columns, "_posting.*")


def needs_enrichment(df: DataFrame) -> Column:
    return (F.col("company") == "") | (F.col("location") == "") | (F.col("salary_text") == "") | (F.size("requirements") == 0) | (F.size("responsibilities") == 0)


ENRICH_WORDS = ("reikalavimai", "atsakomybės", "darbo pobūdis", "atlyginimas", "requirements", "responsibilities", "qualification", "what we expect", "your job", "you will")


def enrichment_text(html: Column) -> Column:
    """The text a model sees: the start, two windows round each keyword, and the end; repeats dropped, 22,000 characters."""
    return let(visible_text(html), lambda text: let(F.lower(text), lambda low: _windows(text, low)))


def _windows(text: Column, low: Column) -> Column:
    window = lambda at: F.when(at > 0, F.substring(text, F.greatest(F.lit(1), at - 800), at + 2800 - F.greatest(F.lit(1), at - 800)))

    def both(word: str) -> Column:
        # contains compares bytes; locate steps by characters and is asked only where there is a hit.
        one = F.when(F.contains(low, F.lit(word)), F.locate(word, low)).otherwise(0)
        after = lambda at: F.when(at > 0, F.call_function("locate", F.lit(word), low, at + len(word))).otherwise(0)
        return let(one, lambda at: F.array(window(at), let(after(at), window)))

    last = F.when(F.length(text) > 4000, F.substring(text, F.length(text) - 3999, F.lit(4000))).otherwise(text)
    chunks = F.concat(F.array(F.substring(text, 1, 12_000)), *map(both, ENRICH_WORDS), F.array(last))
    kept = F.array_distinct(F.filter(F.transform(chunks, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    return F.substring(F.array_join(kept, "\n\n"), 1, 22_000)


def fill_missing(parsed: DataFrame, extracted: DataFrame, key: str = "source_url") -> DataFrame:
    """Parsed fields, filled from a model's extraction only where they are empty."""
    texts, lists = ("company", "location", "salary_text"), ("requirements", "responsibilities")
    e = extracted.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in (*texts, *lists)])
    out = parsed.join(e, F.col(key) == F.col("_k"), "left")
    filled = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.trim(F.col(f"_{c}")), F.lit("")) for c in texts}
    filled |= {c: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.col(c)).otherwise(F.coalesce(F.col(f"_{c}"), F.array().cast("array<string>"))) for c in lists}
    return out.withColumns(filled).drop("_k", *[f"_{c}" for c in (*texts, *lists)])
