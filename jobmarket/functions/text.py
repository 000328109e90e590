"""Text expressions: entity decoding, visible text, lists of keywords, small normalisers."""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from functools import reduce
from html.entities import html5
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Character references decoded natively; &amp; comes last so that nothing is decoded twice.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&ndash;": "–", "&mdash;": "—", "&amp;": "&"}
_KNOWN = "|".join(k[1:-1] for k in ENTITIES)
CEFR_LEVELS = ("A1", "A2", "B1", "B2", "C1", "C2")
STATUSES = ("Saved", "Applied", "Interview", "Offer", "Rejected", "Withdrawn")


@F.pandas_udf(T.StringType())
def _unescape_any(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once, however often f names it. No Python function may stand in f."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _closed(text: str) -> str:
    return re.sub(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text)


@F.pandas_udf(T.StringType())
def _unescape_closed(texts: pd.Series) -> pd.Series:
    return texts.map(_closed, na_action="ignore")


def _rare(c: Column, unclosed: bool = True) -> Column:
    return F.contains(c, F.lit("&")) & c.rlike(f"&(?!(?:{_KNOWN});)" + ("(?:#|[A-Za-z])" if unclosed else "(?:#[xX]?[0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"))


def _plain(c: Column) -> Column:
    for entity, char in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def unescape(c: Column, unclosed: bool = True) -> Column:
    """Decode character references. Only texts with one outside ENTITIES go through Python; others send it a null.

    unclosed: also decode those that end without a semicolon, as browsers do (&amp at a cut); else they stay as they are.
    """
    rare = F.when(_rare(c, unclosed), c)
    plain = _plain(c)
    return F.when(F.contains(c, F.lit("&")), F.coalesce((_unescape_any if unclosed else _unescape_closed)(rare), plain)).otherwise(c)  # most texts hold none


MARK = "\x01"  # no HTML text holds it


def decoded_items(items: Column) -> Column:
    """An array of texts with all character references decoded; the array is decoded as one text, since no Python function runs in a lambda."""
    return F.when(F.size(items) > 0, F.split(unescape(F.array_join(items, MARK)), MARK)).otherwise(items)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _unescape_groups(groups: pd.Series) -> pd.Series:
    return groups.map(lambda g: None if g is None else [[html.unescape(x) for x in one] for one in g])


def decoded_groups(groups: Column) -> Column:
    """Arrays of texts in an array, decoded together: one Python function, which sees only rows with a reference outside ENTITIES."""
    rare = F.when(F.exists(groups, lambda g: F.exists(g, lambda x: _rare(x))), groups)
    plain = F.transform(groups, lambda g: F.transform(g, lambda x: F.when(F.contains(x, F.lit("&")), _plain(x)).otherwise(x)))
    return F.coalesce(_unescape_groups(rare), plain)


def decoded_bytes(c: Column, charset: str = "utf-8") -> Column:
    """Text of raw bytes; what the charset cannot hold is dropped. Valid UTF-8 stays in the JVM; other bytes go through Python."""
    if charset.lower() not in ("utf-8", "utf8"):
        return F.pandas_udf(lambda s: s.map(lambda b: bytes(b).decode(charset, "ignore"), na_action="ignore"), T.StringType())(c)
    return F.coalesce(F.try_validate_utf8(c.cast("string")), _decode_utf8(F.when(F.try_validate_utf8(c.cast("string")).isNull(), c)))


@F.pandas_udf(T.StringType())
def _decode_utf8(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: bytes(b).decode("utf-8", "ignore"), na_action="ignore")


def contains_any(hay: Column, words: Column | tuple) -> Column:
    """Does the text hold any of the words; fixed words make a plain disjunction, an array column a lambda."""
    if isinstance(words, Column):
        return F.exists(words, lambda w: F.contains(hay, w))
    return let(hay, lambda h: reduce(or_, [F.contains(h, F.lit(w)) for w in words]))


#: A run of white space that is not one space already: words of a text are not replaced one by one.
RUN = r"(?U)[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*| [\s\x1c-\x1f]+"


def collapse(c: Column) -> Column:
    """White-space runs (Unicode) to one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, RUN, " "))


def clean_markup(c: Column, unclosed: bool = True) -> Column:
    """Decoded text without tags: decoding comes first, so an escaped tag goes as well."""
    return collapse(F.regexp_replace(unescape(c, unclosed), "<[^>]+>", " "))


def visible_text(c: Column, unclosed: bool = True) -> Column:
    """As clean_markup, with script and style blocks removed."""
    return let(unescape(c, unclosed), visible_decoded)


def visible_decoded(c: Column) -> Column:
    """Visible text of a decoded page; usable inside a lambda."""
    text = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>", " ")
    text = F.regexp_replace(text, r"(?is)<style[^>]*>.*?</style>", " ")
    return collapse(F.when(F.contains(c, F.lit("<")), F.regexp_replace(text, "<[^>]+>", " ")).otherwise(c))


def report_text(c: Column) -> Column:
    """The ranking report's clean text, lower case; null counts as empty."""
    text = F.regexp_replace(unescape(F.coalesce(c, F.lit(""))), r"(?is)<script.*?</script>|<style.*?</style>", " ")
    return F.lower(collapse(F.regexp_replace(text, "<[^>]+>", " ")))


def escape_html(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def escape_table_cell(c: Column) -> Column:
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def keep_first(items: Column, fold_case: bool = False) -> Column:
    """Drop later repeats, keeping order; with fold_case repeats are found without regard to case."""
    if not fold_case:
        return F.array_distinct(items)
    low = F.transform(items, F.lower)
    return F.filter(items, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def keyword_list(c: Column) -> Column:
    """A string of keywords: split at newline, semicolon or comma, collapsed, deduplicated without case."""
    return normalize_keywords(F.split(F.coalesce(c, F.lit("")), "[\n;,]"))


def normalize_keywords(items: Column) -> Column:
    """A list is not split, only collapsed and deduplicated."""
    return keep_first(F.filter(F.transform(items, collapse), lambda x: x != ""), fold_case=True)


def profile_keywords(profile: Column) -> Column:
    """Search terms of a profile: additional, roles, must-have, skills; the first twelve."""
    parts = [F.coalesce(profile[k], F.array().cast("array<string>")) for k in ("additional_keywords", "target_roles", "must_have_skills", "skills")]
    return F.slice(normalize_keywords(F.concat(*parts)), 1, 12)


def cefr(c: Column) -> Column:
    level = F.upper(F.trim(c))
    return F.when(level.isin(*CEFR_LEVELS), level)


def cefr_rank(c: Column) -> Column:
    rank = F.array_position(F.array(*[F.lit(x) for x in CEFR_LEVELS]), cefr(c)).cast("int")
    return F.when(rank > 0, rank)


def status(c: Column) -> Column:
    """Canonical application status of any spelling, else null."""
    wanted = F.lower(F.trim(c))
    return F.coalesce(*[F.when(wanted == s.lower(), F.lit(s)) for s in STATUSES])


def years(c: Column) -> Column:
    """Years of experience from text or number: not negative, whole or with one decimal (half-even), else null."""
    raw = c.cast("string").try_cast("double")
    value = F.greatest(F.lit(0.0), raw)
    return F.when(raw.isNotNull() & ~F.isnan(raw), F.when(value == F.floor(value), value).otherwise(F.bround(value, 1)))


def years_text(c: Column) -> Column:
    return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))


def threshold(c: Column, default: int) -> Column:
    """An integer setting between 0 and 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.trim(c).try_cast("int"), F.lit(default))))


def preview(c: Column, size: int = 300) -> Column:
    text = collapse(c)
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def work_modes(items: Column) -> Column:
    """Array of (mode, country) from an array of the same: known modes only, first of each, no country for remote."""
    low = F.transform(items, lambda x: F.struct(F.lower(F.trim(x["mode"])).alias("mode"), F.trim(F.coalesce(x["country"], F.lit(""))).alias("country")))
    known = F.filter(low, lambda x: x["mode"].isin("remote", "hybrid", "office"))
    modes = F.transform(known, lambda x: x["mode"])
    first = F.filter(known, lambda x, i: F.array_position(modes, x["mode"]) == i + 1)
    return F.transform(first, lambda x: F.struct(x["mode"].alias("mode"), F.when(x["mode"] == "remote", F.lit("")).otherwise(x["country"]).alias("country")))


def work_modes_from_json(c: Column) -> Column:
    """Work modes from a JSON list of strings or of objects with mode and country."""
    items = F.try_variant_get(F.try_parse_json(c), "$", "array<variant>")
    one = lambda v: F.struct(F.coalesce(F.try_variant_get(v, "$.mode", "string"), F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))).alias("mode"), F.try_variant_get(v, "$.country", "string").alias("country"))
    return F.coalesce(work_modes(F.transform(items, one)), F.array().cast("array<struct<mode:string,country:string>>"))
