"""Rule scores of vacancies against candidate profiles: one row for each pair, with the sentences behind the score.

Profiles are a small stated set (their number is checked) and are broadcast; everything is column expressions over
their arrays. Points are added in a fixed order and clamped once. Null text counts as empty.

A text is read once, whatever the number of profiles: years, level, English and work mode are facts of the text, and the terms of all profiles
make one dictionary of distinct terms, whose terms in the text are found in one pass over its trigrams. A pair of text and profile then only asks
for names among the text's hits, and profiles are reached from hits through a term-to-profile table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobmarket.functions.model_output import label_for
from jobmarket.functions.text import CEFR_LEVELS, cefr_rank, contains_any, years_text

MAX_PROFILES = 10_000
MAX_TERMS = 100_000  # distinct terms of all profiles together
FEW_TERMS = 200  # that are cheaper to look for one by one than through trigrams
LISTS = ("skills", "must_have_skills", "nice_to_have_skills", "additional_keywords", "excluded_keywords")
STRINGS = T.ArrayType(T.StringType())
PROFILE = T.StructType(
    [T.StructField("profile_id", T.StringType())]
    + [T.StructField(k, STRINGS) for k in ("target_roles", "skills", "must_have_skills", "nice_to_have_skills", "preferred_locations", "additional_keywords", "excluded_keywords")]
    + [T.StructField("years_of_experience", T.DoubleType()), T.StructField("max_english_level", T.StringType())]
    + [T.StructField("work_modes", T.ArrayType(T.StructType([T.StructField("mode", T.StringType()), T.StructField("country", T.StringType())])))]
)

# Language markers (in order; the first three are English), phrases and their CEFR rank, work-mode
# and country words.
ENGLISH_MARKERS = ("english", "anglų", "anglu")
OTHER_MARKERS = (
    "german", "deutsch", "vokie", "french", "prancu", "spanish", "ispan", "russian", "rusų", "rusu", "polish", "lenk", "italian", "lietuvi",
    "lithuanian", "latvian", "estonian", "ukrain", "dutch", "swedish", "norwegian", "danish", "portuguese", "chinese",
)
FLUENCY = {
    "native english": 6, "english native": 6, "native-level english": 6, "native level english": 6, "fluent english": 5, "fluent in english": 5,
    "fluency in english": 5, "english fluency": 5, "proficient in english": 5, "proficiency in english": 5, "advanced english": 5, "excellent english": 5,
}
HYBRID_WORDS = ("hybrid", "hibridin", "hibridas", "hibridinis")
REMOTE_WORDS = ("remote", "remotely", "work from home", "wfh", "nuotolinis", "nuotoliniu", "nuotoliniai", "nuotolinio", "nuotoliniu budu", "nuotoliniu būdu")
COUNTRY_WORDS = {
    "lithuania": ("lithuania", "lietuva", "vilnius", "kaunas", "klaipeda", "klaipėda", "siauliai", "šiauliai", "panevezys", "panevėžys"),
    "latvia": ("latvia", "latvija", "riga", "rīga", "daugavpils"),
    "estonia": ("estonia", "eesti", "tallinn", "tartu"),
    "poland": ("poland", "polska", "warsaw", "warszawa", "krakow", "kraków", "wroclaw", "wrocław", "gdansk", "gdańsk", "poznan", "poznań", "lodz", "łódź"),
    "germany": ("germany", "deutschland", "berlin", "munich", "münchen", "hamburg", "frankfurt", "cologne", "köln", "stuttgart"),
    "netherlands": ("netherlands", "nederland", "holland", "amsterdam", "rotterdam", "utrecht"),
    "spain": ("spain", "españa", "espana", "madrid", "barcelona", "valencia"),
    "france": ("france", "paris", "lyon", "marseille"),
    "united kingdom": ("united kingdom", "uk", "england", "london", "manchester", "scotland"),
    "ukraine": ("ukraine", "ukraina", "україна", "kyiv", "kiev", "lviv"),
    "sweden": ("sweden", "sverige", "stockholm", "gothenburg", "göteborg"),
    "finland": ("finland", "suomi", "helsinki", "espoo", "tampere"),
    "norway": ("norway", "norge", "oslo", "bergen"),
    "denmark": ("denmark", "danmark", "copenhagen", "københavn"),
    "czechia": ("czechia", "czech republic", "cesko", "česko", "prague", "praha", "brno"),
    "ireland": ("ireland", "eire", "éire", "dublin", "cork"),
    "portugal": ("portugal", "lisbon", "lisboa", "porto"),
}
SENIOR_WORDS = {3: ("senior", "lead", "head", "principal"), 2: ("mid", "middle"), 1: ("junior", "entry-level", "entry level")}
BIND_WINDOW = 30


# The sentences that the functions below put into notes, matched and missing points are output that must stay as it is.


def texts(*items: str) -> Column:
    return F.array(*[F.lit(x) for x in items]) if items else F.array().cast("array<string>")


def searchable_text(title: Column, company: Column, location: Column, salary: Column, requirements: Column, responsibilities: Column) -> Column:
    """Lower-cased fields joined by one space each; empty fields keep their space."""
    none = F.array().cast("array<string>")
    head = [F.coalesce(c, F.lit("")) for c in (title, company, location, salary)]
    return F.lower(F.array_join(F.concat(F.array(*head), F.coalesce(requirements, none), F.coalesce(responsibilities, none)), " "))


def _plain(term: Column) -> Column:
    return F.lower(F.trim(term))


def _places(country: Column) -> Column:
    """The words that stand for a country: those of the fixed list, else its own name."""
    key = F.lower(F.trim(country))
    known = F.create_map(*[x for k, words in COUNTRY_WORDS.items() for x in (F.lit(k), texts(*words))])
    return F.when(key == "", texts()).otherwise(F.coalesce(F.try_element_at(known, key), F.array(key)))


def _profile_terms(profiles: DataFrame) -> DataFrame:
    """profile_id, list, term: what each profile looks for in a text, in lower case."""
    none = texts()
    listed = [(k, F.transform(F.coalesce(F.col(k), none), _plain)) for k in (*LISTS, "target_roles")]
    listed.append(("preferred_locations", F.transform(F.coalesce(F.col("preferred_locations"), none), F.lower)))
    listed.append(("work_modes", F.flatten(F.transform(F.coalesce(F.col("work_modes"), F.array().cast(PROFILE["work_modes"].dataType)), lambda w: _places(w["country"])))))
    rows = profiles.select("profile_id", F.explode(F.array(*[F.struct(F.lit(k).alias("list"), c.alias("terms")) for k, c in listed])).alias("l"))
    return rows.select("profile_id", "l.list", F.explode("l.terms").alias("term")).where("term <> ''")


def dictionary(profiles: DataFrame) -> list[str]:
    """The distinct terms of all profiles, MAX_TERMS at most; they travel in the plan as one constant."""
    found = [r[0] for r in _profile_terms(profiles).select("term").distinct().limit(MAX_TERMS + 1).collect()]
    if len(found) > MAX_TERMS:
        raise ValueError("score profiles in sets of at most MAX_TERMS distinct terms")
    return sorted(found)


def _constant(items: list[str], mark: str) -> Column:
    """Texts as a constant array of the plan: folded once, not built for each row."""
    return F.split(F.lit(mark.join(items)), mark, -1) if items else texts()


def term_candidates(hay: Column, terms: list[str]) -> Column:
    """Terms that may occur in the text, a superset of those that do.

    Each term hangs on one of its trigrams, the one that the fewest terms have; a table of slots by the trigram's checksum leads from the text's
    trigrams to terms. Terms of one or two characters are always candidates.
    """
    used = set("".join(terms))
    mark, inner = [c for c in map(chr, range(0xE000, 0xF8FF)) if c not in used][:2]  # private characters that no term holds
    if len(terms) <= FEW_TERMS:
        return _constant(terms, mark)
    short, long = [t for t in terms if len(t) < 3], [t for t in terms if len(t) >= 3]
    grams = [sorted({t[i:i + 3] for i in range(len(t) - 2)}) for t in long]
    common = Counter(g for gs in grams for g in gs)
    slots = 1 << max(1, 2 * len(long) - 1).bit_length()
    table: list[list[str]] = [[] for _ in range(slots)]
    for term, gs in zip(long, grams):
        key = min(gs, key=lambda g: (common[g], g))
        table[zlib.crc32(key.encode()) % slots].append(term)
    by_slot = _constant([inner.join(ts) for ts in table], mark)
    own = F.array_distinct(F.regexp_extract_all(hay, F.lit("(?s)(?=(...))"), F.lit(1)))
    reached = F.transform(own, lambda g: F.get(by_slot, F.crc32(g.cast("binary")).bitwiseAND(F.lit(slots - 1)).cast("int")))
    met = F.split(F.array_join(F.array_distinct(reached), inner), inner, -1)
    return F.concat(_constant(short, mark), F.array_distinct(F.filter(met, lambda t: t != "")))


def found_terms(hay: Column, terms: list[str]) -> Column:
    """The dictionary's terms that occur in the text, as substrings."""
    if not terms:
        return texts()
    return F.filter(term_candidates(hay, terms), lambda t: F.contains(hay, t))


def term_hits(vacancies: DataFrame, profiles: DataFrame) -> DataFrame:
    """vacancies' columns but the text, profile_id, list, term: each profile's terms in each text, reached from the text's hits through a term-to-profile table.

    Profiles without a hit cost a text nothing.
    """
    terms = dictionary(profiles)
    table = _profile_terms(profiles).distinct()
    table = F.broadcast(table) if table.count() <= MAX_TERMS else table
    hit = vacancies.select(*[c for c in vacancies.columns if c != "searchable"], F.explode(found_terms(F.coalesce("searchable", F.lit("")), terms)).alias("term"))
    return hit.join(table, "term")


def role_match(roles: Column, title: Column, hay: Column, has: Callable[[Column], Column] | None = None) -> Column:
    """Struct (points, note): a role in the title ends the search; else the best points and the last note. has: whether the text holds a name."""
    has = has or (lambda name: F.contains(hay, name))

    def one(state: Column, role: Column) -> Column:
        name = _plain(role)
        words = F.filter(F.split(name, "[^a-z0-9]+"), lambda w: F.length(w) > 2)
        overlap = F.size(F.filter(words, lambda w: F.contains(title, w)))
        partial = (overlap >= 2) | ((overlap == 1) & (F.size(words) == 1))
        new = lambda points, text: F.struct(F.greatest(state["points"], F.lit(points)).alias("points"), F.concat(F.lit(text), role, F.lit(".")).alias("note"))
        return (
            F.when((state["points"] == 20) | (name == ""), state)
            .when(F.contains(title, name), new(20, "The vacancy title directly matches the target role: "))
            .when(has(name), new(15, "The vacancy text strongly aligns with the target role: "))
            .when(partial, new(10, "The vacancy title partially aligns with the target role: "))
            .otherwise(state)
        )

    return F.aggregate(F.coalesce(roles, texts()), F.struct(F.lit(0).alias("points"), F.lit("").alias("note")), one)


def required_years(hay: Column) -> Column:
    found = F.concat(
        F.regexp_extract_all(hay, F.lit(r"(?U)(\d+)\+?\s*(?:years|year)\b"), F.lit(1)),
        F.regexp_extract_all(hay, F.lit(r"(?U)(\d+)\+?\s*(?:met(?:ų|u)?|m\.)\b"), F.lit(1)),
    )
    return F.array_max(F.transform(found, lambda y: y.try_cast("decimal(38,0)")))


def required_level(hay: Column) -> Column:
    """3 senior, 2 middle, 1 junior, 0 unknown."""
    return F.coalesce(*[F.when(contains_any(hay, words), F.lit(n)) for n, words in SENIOR_WORDS.items()], F.lit(0))


def experience_match(have: Column, hay: Column) -> Column:
    """Struct (points, note) for the profile's years against the largest number of years in the text."""
    return graded_experience(have, required_years(hay), required_level(hay))


def graded_experience(have: Column, need: Column, level: Column) -> Column:
    graded = F.rint(F.lit(-10.0) + F.lit(20.0) * (have / need.cast("double"))).cast("int")
    own = F.when(have >= 5, 3).when(have >= 2, 2).otherwise(1)
    say = lambda points, *text: F.struct(points.cast("int").alias("points"), F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text]).alias("note"))
    number = need.cast("string")
    return (
        F.when(have.isNull(), say(F.lit(0), ""))
        .when(need.isNotNull() & ((need <= 0) | (have >= need.cast("double"))), say(F.lit(10), "Experience level matches the vacancy expectation (", number, "+ years)."))
        .when(need.isNotNull() & (graded >= 0), say(graded, "Close to the vacancy's ", number, "+ year expectation (", years_text(have), " yrs)."))
        .when(need.isNotNull(), say(graded, "Below the vacancy's ", number, "+ year expectation (", years_text(have), " yrs)."))
        .when(level == 0, say(F.lit(0), ""))
        .when(own >= level, say(F.lit(8), "Profile seniority appears compatible with the vacancy level."))
        .otherwise(say(F.lit(-8), "Vacancy seniority appears higher than the current profile level."))
    )


def english_rank(hay: Column) -> Column:
    """Highest CEFR rank (1 to 6) of English that a text asks for; a level belongs to the nearest language within 30 characters."""
    token = r"(?U)\b([abc][12])\b"
    tokens = F.regexp_extract_all(hay, F.lit(token), F.lit(1))
    between = F.split(hay, token, -1)
    start = lambda i: F.aggregate(F.slice(between, 1, i + 1), F.lit(0), lambda n, x: n + F.length(x)) + 2 * i
    markers = ENGLISH_MARKERS + OTHER_MARKERS

    def windows(t: Column, i: Column) -> Column:
        at = start(i)
        return F.struct(t.alias("t"), F.reverse(F.substring(hay, F.greatest(F.lit(1), at - BIND_WINDOW + 1), F.least(F.lit(BIND_WINDOW), at))).alias("left"), F.substring(hay, at + 3, F.lit(BIND_WINDOW)).alias("right"))

    def is_english(w: Column) -> Column:
        far = F.lit(10_000)
        place = lambda p: F.when(p > 0, p - 1).otherwise(far)
        best = F.array_min(F.array(*[F.struct(F.least(place(F.locate(m, w["right"])), place(F.locate(m[::-1], w["left"]))).alias("d"), F.lit(k).alias("k")) for k, m in enumerate(markers)]))
        return F.transform(F.array(best), lambda b: (b["d"] < far) & (b["k"] < len(ENGLISH_MARKERS)))[0]

    levels = texts(*[x.lower() for x in CEFR_LEVELS])
    ranks = F.transform(F.transform(tokens, windows), lambda w: F.when(is_english(w), F.array_position(levels, w["t"]).cast("int")))
    phrases = F.array(*[F.when(F.contains(hay, F.lit(p)), F.lit(r)) for p, r in FLUENCY.items()])
    # Most texts hold no level at all: they skip the windows.
    tokens_at_all = F.when(hay.rlike("[abc][12]"), F.array_max(ranks))
    return F.array_max(F.array(tokens_at_all, F.array_max(phrases)))


def english_match(limit: Column, hay: Column) -> Column:
    return graded_english(limit, english_rank(hay))


def graded_english(limit: Column, need: Column) -> Column:
    most = cefr_rank(limit)
    name = lambda r: F.element_at(texts(*CEFR_LEVELS), r)
    say = lambda points, ok, end: F.struct(F.lit(points).alias("points"), F.concat(F.lit("English requirement ("), name(need), F.lit(f") is {end} your "), name(most), F.lit(" ceiling.")).alias("note"))
    return F.when(most.isNull() | need.isNull(), F.struct(F.lit(0).alias("points"), F.lit("").alias("note"))).when(need > most, say(-40, False, "above")).otherwise(say(5, True, "within"))


def work_mode(hay: Column) -> Column:
    return F.when(contains_any(hay, HYBRID_WORDS), "hybrid").when(contains_any(hay, REMOTE_WORDS), "remote").otherwise("office")


def work_match(wanted: Column, hay: Column) -> Column:
    return graded_work(wanted, work_mode(hay), lambda words: contains_any(hay, words))


def graded_work(wanted: Column, mode: Column, any_of: Callable[[Column], Column]) -> Column:
    """Struct (points, note) for the wanted work modes; any_of: whether the text holds any of some words."""

    def fits(p: Column) -> Column:
        return (p["mode"] == mode) & ((p["mode"] == "remote") | (p["country"] == "") | any_of(_places(p["country"])))

    first = F.get(F.filter(wanted, fits), F.lit(0))
    asked = F.array_join(F.transform(wanted, lambda p: F.when(p["mode"] == "remote", p["mode"]).otherwise(F.concat(p["mode"], F.lit(" ("), p["country"], F.lit(")")))), ", ")
    where = F.when(first["country"] == "", "your area").otherwise(first["country"])
    say = lambda points, note: F.struct(F.lit(points).alias("points"), note.alias("note"))
    return (
        F.when(F.coalesce(F.size(wanted), F.lit(0)) <= 0, say(0, F.lit("")))
        .when(first["mode"] == "remote", say(10, F.lit("Remote role matches your work-mode preference.")))
        .when(first.isNotNull(), say(10, F.concat(F.initcap(first["mode"]), F.lit(" role in "), where, F.lit(" matches your work-mode preference."))))
        .otherwise(say(-40, F.concat(F.lit("Work mode ("), mode, F.lit(") is outside your preferences ("), asked, F.lit(")."))))
    )


def text_facts(hay: Column, title: Column, terms: list[str], years: bool = True, english: bool = True, modes: bool = True) -> Column:
    """What a text says, whoever asks: found terms, required years and level, English rank, work mode. What no profile asks for is not read."""
    return F.struct(
        found_terms(hay, terms).alias("terms"), F.lower(F.coalesce(title, F.lit(""))).alias("title"), (required_years(hay) if years else F.lit(None).cast("decimal(38,0)")).alias("years"),
        (required_level(hay) if years else F.lit(0)).alias("level"), (english_rank(hay) if english else F.lit(None).cast("int")).alias("english"), (work_mode(hay) if modes else F.lit("office")).alias("mode"),
    )


def score(vacancies: DataFrame, profiles: DataFrame) -> DataFrame:
    """All columns of vacancies (with title and searchable) and profile_id, score, fit_label, matched_points, missing_points, explanation, notes."""
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    n, *asked = profiles.agg(F.count("*"), any_(F.col("years_of_experience").isNotNull()), any_(F.col("max_english_level").isNotNull()), any_(F.size("work_modes") > 0)).first()
    if n > MAX_PROFILES:
        raise ValueError("score profiles in sets of at most MAX_PROFILES")
    names = [f.name for f in PROFILE.fields]
    spelled = lambda k: F.transform(F.coalesce(F.col(k), texts()), lambda t: F.struct(t.alias("said"), _plain(t).alias("plain")))  # noqa: E731  in lower case once, not for each text
    p = profiles.select(F.struct(*names).alias("_p"), F.struct(*[spelled(k).alias(k) for k in LISTS]).alias("_t"))
    terms, fact, who = dictionary(profiles), F.col("_fact"), F.col("_p")
    facts = vacancies.withColumn("_fact", text_facts(F.coalesce(F.col("searchable"), F.lit("")), F.col("title"), terms, *asked))
    has = lambda t: F.array_contains(fact["terms"], t)
    matched_terms = lambda k: F.array_distinct(F.transform(F.filter(F.col("_t")[k], lambda t: has(t["plain"])), lambda t: t["said"]))
    near = lambda x: (F.lower(x) == "") | has(F.lower(x))
    pairs = facts.crossJoin(F.broadcast(p))
    pairs = pairs.select(
        "*", F.struct(*[matched_terms(k).alias(k) for k in LISTS]).alias("_m"),
        role_match(who["target_roles"], fact["title"], fact["title"], has).alias("_role"), graded_experience(who["years_of_experience"], fact["years"], fact["level"]).alias("_years"),
        graded_english(who["max_english_level"], fact["english"]).alias("_english"), graded_work(who["work_modes"], fact["mode"], lambda words: F.exists(words, has)).alias("_work"),
        F.exists(F.coalesce(who["preferred_locations"], texts()), near).alias("_near"),
    )
    m, n = F.col("_m"), lambda c: F.coalesce(F.size(c), F.lit(0)).cast("double")
    count = lambda k: F.greatest(F.lit(0), F.size(m[k]))
    share = lambda k, full: F.floor(n(m[k]) / F.greatest(F.lit(1.0), n(who[k])) * F.lit(float(full))).cast("int")
    points = (
        share("skills", 25) + share("must_have_skills", 30) + F.least(F.lit(10), count("nice_to_have_skills") * 3) + F.col("_role.points") + F.when(F.col("_near"), 10).otherwise(0)
        + F.least(F.lit(10), count("additional_keywords") * 2) + F.col("_years.points") + F.col("_english.points") + F.col("_work.points") - F.when(count("excluded_keywords") > 0, 40).otherwise(0)
    )
    listed = lambda k, text: F.when(count(k) > 0, F.concat(F.lit(text), F.array_join(m[k], ", ")))
    note = lambda c, good: F.when((F.col(f"{c}.note") != "") & ((F.col(f"{c}.points") >= 0) == F.lit(good)), F.col(f"{c}.note"))
    present = lambda *items: F.filter(F.array(*items), lambda x: x.isNotNull())
    matched = present(
        listed("skills", "Matched skills: "), listed("must_have_skills", "Matched must-have skills: "), listed("nice_to_have_skills", "Nice-to-have skills found: "),
        F.when(F.col("_role.points") > 0, F.col("_role.note")), F.when(F.col("_near"), "The vacancy location matches the preferred location."),
        listed("additional_keywords", "Extra profile keywords found: "), note("_years", True), note("_english", True), note("_work", True),
    )
    missing = present(
        F.when(count("skills") == 0, "No core profile skills matched directly in the vacancy text."),
        F.when((n(who["must_have_skills"]) > 0) & (count("must_have_skills") == 0), "No must-have profile skills were found."),
        F.when(F.col("_role.points") == 0, "The vacancy title does not closely match the target role."), F.when(~F.col("_near"), "The vacancy location is outside the preferred locations."),
        F.when(count("additional_keywords") == 0, "No extra profile keywords were found."), note("_years", False), note("_english", False), note("_work", False),
        listed("excluded_keywords", "Excluded profile keywords matched: "),
    )
    out = pairs.withColumns({"score": F.greatest(F.lit(0), F.least(F.lit(100), points)), "matched_points": matched, "missing_points": missing, "profile_id": who["profile_id"]})
    out = out.withColumn("fit_label", label_for(F.col("score")))
    said = F.concat(F.lit("Rule-based analysis marked this vacancy as a "), F.lower("fit_label"), F.lit(" fit with a score of "), F.col("score").cast("string"), F.lit("."))
    return out.withColumns({"explanation": said, "notes": F.lit("Used deterministic profile-to-vacancy keyword matching."), "analysis_method": F.lit("rule_based")}).drop("_p", "_t", "_fact", "_m", "_role", "_years", "_english", "_work", "_near")


def boosted(scored: DataFrame) -> DataFrame:
    """The offline stand-in for a model: ten points more, relabelled, never without a matched point."""
    out = scored.withColumn("score", F.least(F.lit(100), F.col("score") + 10)).withColumn("fit_label", label_for(F.col("score")))
    return out.withColumns({
        "matched_points": F.when(F.size("matched_points") > 0, F.col("matched_points")).otherwise(texts("The vacancy has general alignment with the active profile.")),
        "explanation": F.concat(F.lit("AI-assisted review suggests a "), F.lower("fit_label"), F.lit(" fit because the vacancy matches several profile preferences and core skill keywords.")),
        "notes": F.lit("Generated by the offline demo AI client."), "analysis_method": F.lit("ai_assisted"),
    })


def complete(a: Column) -> Column:
    """Does an analysis struct hold everything an analysis needs."""
    return a.isNotNull() & a["score"].isNotNull() & a["fit_label"].isin("High", "Medium", "Low") & (F.length(F.trim(F.coalesce(a["explanation"], F.lit("")))) > 0)


def overlay(rules: DataFrame, responses: DataFrame, key: list[str]) -> DataFrame:
    """Rule rows, replaced by a model's analysis (column `analysis`) where that is complete."""
    joined = rules.join(responses.select(*key, "analysis"), key, "left").withColumn("_ok", complete(F.col("analysis")))
    fields = ("score", "fit_label", "explanation", "matched_points", "missing_points", "notes")
    return joined.withColumns({f: F.when(F.col("_ok"), F.col("analysis")[f]).otherwise(F.col(f)) for f in fields}).withColumn("analysis_method", F.when(F.col("_ok"), "ai_assisted").otherwise(F.col("analysis_method"))).drop("analysis", "_ok")


def requests(vacancies: DataFrame, profiles: DataFrame) -> DataFrame:
    """One JSON request for each vacancy and profile."""
    if profiles.limit(MAX_PROFILES + 1).count() > MAX_PROFILES:
        raise ValueError("ask for profiles in sets of at most MAX_PROFILES")
    v = F.struct(*[c for c in vacancies.columns if c not in ("searchable", "raw_text")])
    return vacancies.select("source_url", v.alias("vacancy")).crossJoin(F.broadcast(profiles.select("profile_id", F.struct(*profiles.columns).alias("profile")))).select("source_url", "profile_id", F.to_json(F.struct("vacancy", "profile")).alias("payload"))


def extraction_requests(vacancies: DataFrame, text: Column) -> DataFrame:
    """One JSON request for each vacancy: the fields that the parser found, and the text to read the missing ones from."""
    fields = F.struct(F.col("source_name").alias("source"), "title", "company", "location", "salary_text", "requirements", "responsibilities")
    return vacancies.select("source_url", F.to_json(F.struct(fields.alias("current_fields"), text.alias("vacancy_text"))).alias("payload"))
