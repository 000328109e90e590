"""Job boards as rows: hosts, paths, listing templates and markers. Adding a board is adding a row, not code."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobmarket.functions.text import clean_markup, contains_any, decoded_items, normalize_keywords, visible_text
from jobmarket.functions.urls import host, parts, resolve, without_query

# Fixed values.
REMOTE_MARKERS = ("remote", "work from home", "work from anywhere", "worldwide remote", "fully remote", "100% remote")
EXCLUDED_LOCATIONS = ("belarus", "russia", "беларус", "белорус", "минск", "moscow", "москва", "saint petersburg", "st. petersburg", "санкт-петербург", "spb")
BLOCK_PHRASES = ("access denied", "just a moment", "checking your browser", "verify you are human", "sgcaptcha", "temporarily unavailable")
LINK = r"""(?i)href="([^"]+)\""""
LIST_LINK = r"""(?i)<a[^>]*class="[^"]*\blist_a\b[^"]*"[^>]*href="([^"]+)\""""


@dataclass(frozen=True)
class Board:
    """One board. `listing` holds {query}; parameters are (name, value) pairs, {keyword} and {page} are filled in."""

    name: str
    hosts: tuple[str, ...]
    path_pattern: str = "."
    excluded_prefixes: tuple[str, ...] = ()
    listing: str = ""
    paged_listing: str = ""  # used from the second page on, if set; may hold {page}
    parameters: tuple[tuple[str, str], ...] = (("q", "{keyword}"), ("page", "{page}"))
    first_page: int = 1
    first_page_shown: bool = False
    link_pattern: str = LINK
    remote_only: bool = False
    exclude_locations: bool = False
    remote_markers: tuple[str, ...] = REMOTE_MARKERS
    filters: tuple[tuple[str, str], ...] = field(default=())
    #: Field patterns that take the place of the general ones: (field, patterns).
    patterns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    layout: str = ""  # "jobad": the page layout with jobad_* ids
    requirement_headings: tuple[str, ...] = ()
    duty_headings: tuple[str, ...] = ()
    id_patterns: tuple[str, ...] = ()  # tried on the URL, then
    page_id_patterns: tuple[str, ...] = ()  # on the page; else the path, or the whole URL
    url_is_id: bool = False
    id_path: str = ""  # path of the board's own canonical URL, holds {id}
    base_url: str = ""  # the canonical URL is rebuilt from it and the path
    accept_marker: str = ""  # a page that holds it is never blocked
    block_phrases: tuple[str, ...] = BLOCK_PHRASES
    listing_raw_phrases: tuple[str, ...] = ()
    fold_io: bool = False  # the Cyrillic letter io counts as ie in markers and pages
    excluded_locations: tuple[str, ...] = EXCLUDED_LOCATIONS
    area_ids: tuple[str, ...] = ()
    excluded_area_ids: tuple[str, ...] = ()


# The boards with rules of their own.
HH = Board(
    "hh", ("hh.ru",), path_pattern=r"/vacancy/\d+", listing="https://hh.ru/search/vacancy", parameters=(("page", "{page}"), ("text", "{keyword}")), first_page=0, first_page_shown=True,
    link_pattern=r'(?i)<a[^>]+href="([^"]*/vacancy/\d+[^"]*)"', remote_only=True, exclude_locations=True,
    remote_markers=("можно удаленно", "можно удалённо", "удаленная работа", "удалённая работа", "удаленно", "удалённо", "remote", "work_format", "workformat"),
    id_patterns=(r"/vacancy/(\d+)",), page_id_patterns=(r'data-vacancy-id="(\d+)"', r'"vacancyId"\s*:\s*"?(\d+)"?'), url_is_id=True, id_path="/vacancy/{id}",
    accept_marker=r'(?i)data-qa="vacancy-title"|@type"\s*:\s*"JobPosting"',
    block_phrases=("account-login", "captcha", "доступ ограничен", "подтвердите, что вы не робот", "checking your browser", "access denied"), listing_raw_phrases=("sgcaptcha", "challenge-platform"), fold_io=True,
    excluded_locations=(
        "belarus", "russia", "беларус", "белорус", "минск", "москва", "санкт-петербург", "spb", "казань", "новосибирск", "екатеринбург", "нижний новгород", "самара", "ростов-на-дону", "краснодар",
        "воронеж", "пермь", "омск", "уфа", "челябинск", "красноярск", "томск", "сочи", "калининград",
    ),
    area_ids=("5", "9", "28", "40", "48", "97", "1001"), excluded_area_ids=("16", "113"),
)
EUREMOTEJOBS = Board(
    "euremotejobs", ("euremotejobs.com",), excluded_prefixes=("category/", "company/", "feed", "feed/", "job-category/", "page/", "privacy-policy/", "remote-jobs/", "tag/", "terms", "terms/", "wp-"),
    listing="https://euremotejobs.com/job-region/remote-jobs-europe/", paged_listing="https://euremotejobs.com/job-region/remote-jobs-europe/page/{page}/", parameters=(("s", "{keyword}"),), exclude_locations=True,
    id_patterns=(r"^[^?#]*?//[^/?#]*/+job/+([^?#]*[^/?#])",),
)
JUSTJOIN = Board(
    "justjoin", ("justjoin.it",), path_pattern=r"^/job-offer/[^/?#]+", listing="https://justjoin.it/job-offers/all-locations", parameters=(("workplace", "remote"), ("keyword", "{keyword}"), ("page", "{page}")),
    remote_only=True, exclude_locations=True, id_patterns=(r"^[^?#]*?//[^/?#]*/(?:[^?#]*/)?([^/?#]+)/*(?:[?#]|$)",),
)
STARTUP_JOBS = Board(
    "startup_jobs", ("startup.jobs",), listing="https://startup.jobs/remote-jobs", parameters=(("remote", "true"), ("w", "remote"), ("q", "{keyword}"), ("page", "{page}")), remote_only=True, exclude_locations=True,
    base_url="https://startup.jobs/",
)
CVBANKAS = Board(
    "cvbankas", ("cvbankas.lt",), layout="jobad", requirement_headings=("Reikalavimai kandidatui (-ei):", "Reikalavimai darbuotojui", "Reikalavimai"),
    duty_headings=("Pagrindinės atsakomybės:", "Darbo pobūdis", "Pagrindinės užduotys:"), link_pattern=LIST_LINK,
    remote_only=True, exclude_locations=True,
)


def board_rows(spark: SparkSession, boards: Sequence[Board]) -> DataFrame:
    """One row per board and host, with the board's position for first-match routing."""
    rows = [(i, b.name, h, b.path_pattern, list(b.excluded_prefixes)) for i, b in enumerate(boards) for h in b.hosts]
    return spark.createDataFrame(rows, "position int, board string, board_host string, path_pattern string, excluded array<string>")


ROUTE_RULES = 1_000  # most rules of a set


def route(urls: DataFrame, boards: DataFrame, url: str = "url") -> DataFrame:
    """Add `board`: the first board whose host (itself or a parent domain) and path fit, else null.

    The rules are a stated set of at most ROUTE_RULES rows; they travel as one constant array, so a page is
    routed where it lies: nothing is shuffled and each page offers its own parent domains to the rules.
    """
    rules = boards.orderBy("position", "board_host").limit(ROUTE_RULES + 1).collect()
    if len(rules) > ROUTE_RULES:
        raise ValueError("route by sets of at most ROUTE_RULES rules")
    name, path = host(F.col(url)), parts(F.col(url))["path"]
    fits = [
        (
            r["board"],
            ((name == r["board_host"]) | F.endswith(name, F.lit(f".{r['board_host']}"))) & path.rlike(r["path_pattern"])
            & ~F.exists(F.array(*map(F.lit, r["excluded"])).cast("array<string>"), lambda p: F.startswith(F.ltrim(path, F.lit("/")), p)),
        )
        for r in rules
    ]
    best = F.coalesce(*[F.when(ok, F.lit(board)) for board, ok in fits]) if fits else F.lit(None).cast("string")
    return urls.withColumn("board", best)


def listing_urls(spark: SparkSession, boards: Sequence[Board], keywords: DataFrame, pages: int) -> DataFrame:
    """Crawl frontier: board, keyword, page, url for every keyword (columns board, keyword, position) and page."""
    rules = spark.createDataFrame(
        [(b.name, b.listing, b.paged_listing, [list(p) for p in (*b.parameters, *b.filters)], b.first_page, b.first_page_shown) for b in boards],
        "board string, listing string, paged_listing string, parameters array<array<string>>, first_page int, shown boolean",
    )
    each = keywords.join(F.broadcast(rules), "board").withColumn("page", F.explode(F.sequence(F.col("first_page"), F.col("first_page") + F.lit(pages - 1))))
    first = F.col("page") <= F.greatest(F.col("first_page"), F.lit(1))
    in_path = F.col("paged_listing") != ""

    def value(p: Column) -> Column:
        return (
            F.when(p[1] == "{keyword}", F.when(F.coalesce("keyword", F.lit("")) != "", F.url_encode("keyword")))
            .when(p[1] == "{page}", F.when(in_path | (first & ~F.col("shown")), F.lit(None)).otherwise(F.col("page").cast("string")))
            .otherwise(F.url_encode(p[1]))
        )

    query = F.array_join(F.filter(F.transform("parameters", lambda p: F.concat(p[0], F.lit("="), value(p))), lambda x: x.isNotNull()), "&")
    base = F.when(in_path & ~first, F.replace(F.col("paged_listing"), F.lit("{page}"), F.col("page").cast("string"))).otherwise(F.col("listing"))
    return each.select("board", "keyword", "position", "page", F.concat(base, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))).alias("url"))


def harvest_links(pages: DataFrame, pattern: str = LINK, fallback: str | None = None, wanted: str = ".") -> DataFrame:
    """Rows page columns (without html), link, at: the page's links in order, resolved, first of each, those that match `wanted`."""
    found = F.regexp_extract_all("html", F.lit(pattern), F.lit(1))
    if fallback:
        found = F.when(F.size(found) > 0, found).otherwise(F.regexp_extract_all("html", F.lit(fallback), F.lit(1)))
    rest = [c for c in pages.columns if c != "html"]
    links = F.array_distinct(F.transform(decoded_items(found), lambda h: without_fragment(resolve(F.col("url"), F.trim(h)))))
    each = pages.select(*rest, F.posexplode(links).alias("at", "link"))
    return each.where(F.col("link").rlike(wanted))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def frontier(links: DataFrame, limit: int) -> DataFrame:
    """First `limit` URLs of each board in order of keyword, page and place; a URL counts where it is first seen.

    links: board, position, page, at, link.
    """
    order = F.struct("position", "page", "at")
    salted = links.withColumn("_salt", F.pmod(F.xxhash64("link"), F.lit(FRONTIER_PARTS)).cast("int"))
    firsts = salted.groupBy("board", "_salt", "link").agg(F.min(order).alias("_first"))
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("_first", "link"))
    # A board with most of all links is cut in FRONTIER_PARTS parts first; the last cut sees that many times the limit at most.
    parts = firsts.withColumn("_place", place("board", "_salt")).where(F.col("_place") <= limit)
    return parts.withColumn("place", place("board")).where(F.col("place") <= limit).select("board", "link", "place")


FRONTIER_PARTS = 64


def blocked(visible: Column, phrases: Sequence[str] = BLOCK_PHRASES) -> Column:
    return contains_any(F.lower(visible), tuple(phrases))


def page_blocked(html: Column, visible: Column, board: Board) -> Column:
    """Is a vacancy page a block page; a page with the board's own marker never is."""
    found = blocked(visible, board.block_phrases)
    return ~html.rlike(board.accept_marker) & found if board.accept_marker else found


def listing_blocked(html: Column, board: Board) -> Column:
    """Listing pages have no marker to trust, and some block pages show only in their markup."""
    found = blocked(visible_text(html), board.block_phrases)
    return found | contains_any(F.lower(html), board.listing_raw_phrases) if board.listing_raw_phrases else found


def _io(c: Column) -> Column:
    return F.replace(c, F.lit("ё"), F.lit("е"))


def looks_remote(title: Column, location: Column, url: Column, html: Column, markers: Sequence[str] = REMOTE_MARKERS, fold_io: bool = False) -> Column:
    hay = F.lower(clean_markup(F.concat_ws(" ", title, location, url, html)))
    return contains_any(_io(hay), tuple(m.replace("ё", "е") for m in markers)) if fold_io else contains_any(hay, tuple(markers))


def excluded_location(location: Column, markers: Sequence[str] = EXCLUDED_LOCATIONS) -> Column:
    return contains_any(_io(F.lower(clean_markup(F.coalesce(location, F.lit(""))))), tuple(markers))


def source_id(url: Column, html: Column, board: Board) -> Column:
    """The board's id of a vacancy: its patterns on the URL, then on the page, then the path, then the URL."""
    tries = [F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in board.id_patterns] + [F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in board.page_id_patterns]
    path = F.nullif(F.trim(parts(url)["path"], F.lit("/")), F.lit(""))
    return F.coalesce(*tries, *([] if board.url_is_id else [path]), url)


def vacancy_url(url: Column, board: Board | None = None) -> Column:
    """A board's own canonical form: query and fragment dropped; some boards set the path by the id or rebuild it from their base."""
    plain = without_query(url)
    if board is None or not (board.id_path or board.base_url):
        return plain
    p = parts(url)
    if board.base_url:
        return F.concat(F.lit(board.base_url), F.trim(p["path"], F.lit("/")))
    number = F.coalesce(*[F.nullif(F.regexp_extract(url, x, 1), F.lit("")) for x in board.id_patterns])
    head, tail = board.id_path.split("{id}")
    authority = F.when(p["authority"] == "", board.hosts[0]).otherwise(p["authority"])
    return F.when(number.isNotNull(), F.concat(p["scheme"], F.lit("://"), authority, F.lit(head), number, F.lit(tail))).otherwise(plain)


def forced_filters(url: Column, board: Board) -> Column:
    """A listing URL with the board's filters: excluded areas go, its own areas come where none is left, remote work is asked for."""
    p = parts(url)
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    pair = lambda x: F.struct(decode(F.substring_index(x, "=", 1)).alias("k"), decode(F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).otherwise("")).alias("v"))
    pairs = F.transform(F.filter(F.split(p["query"], "&"), lambda x: x != ""), pair)
    out_of = list(board.excluded_area_ids) if board.exclude_locations else []
    drop = lambda x: (x["k"] == "area") & x["v"].isin(*out_of) if out_of else F.lit(False)
    forced = lambda x: x["k"].isin("schedule", "work_format") if board.remote_only else F.lit(False)
    kept = F.filter(pairs, lambda x: ~drop(x) & ~forced(x))
    fixed = lambda items: F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in items]).cast("array<struct<k:string,v:string>>")
    areas = fixed([("area", a) for a in board.area_ids if a not in out_of])
    whole = F.concat(kept, F.when(F.exists(kept, lambda x: x["k"] == "area"), fixed([])).otherwise(areas), fixed([("schedule", "remote"), ("work_format", "REMOTE")] if board.remote_only else []))
    encode = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    query = F.array_join(F.transform(whole, lambda x: F.concat(encode(x["k"]), F.lit("="), encode(x["v"]))), "&")
    return F.concat(F.regexp_replace(url, r"[?#].*$", ""), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)), F.regexp_extract(url, r"(#.*)$", 1))


def union_sources(spark: SparkSession, results: Sequence[tuple[str, DataFrame | None]], schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of all sources in source order (source_name, source_position, columns of schema), and one row for each source: failed is 1 where it has no result."""
    rows = spark.createDataFrame([], schema).withColumns({"source_name": F.lit(""), "source_position": F.lit(0)})
    for at, (name, df) in enumerate(results):
        if df is not None:
            rows = rows.unionByName(df.select(*[c for c in rows.columns if c not in ("source_name", "source_position")]).withColumns({"source_name": F.lit(name), "source_position": F.lit(at)}))
    return rows, spark.createDataFrame([(at, name, int(df is None)) for at, (name, df) in enumerate(results)], "source_position int, source_name string, failed int")


def resolve_keywords(boards: DataFrame, settings: DataFrame) -> DataFrame:
    """board, keywords: the first level with any keyword, of cli, source, global, fallback.

    boards: board. settings: level, board (null: all boards), keywords (array, normalised here).
    """
    rank = F.array_position(F.array(*map(F.lit, ("cli", "source", "global", "fallback"))), F.col("level"))
    given = settings.select(F.col("board").alias("_b"), rank.alias("_rank"), normalize_keywords(F.col("keywords")).alias("_words")).where("_rank > 0 and size(_words) > 0")
    joined = boards.join(F.broadcast(given) if given.count() <= ROUTE_RULES else given, F.col("_b").isNull() | (F.col("_b") == F.col("board")), "left")
    return joined.groupBy("board").agg(F.min_by("_words", "_rank").alias("keywords"))
