"""Inbox, tracked list, detail and recent views: joins and filters that Catalyst pushes down."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmarket.functions.text import STATUSES
from jobmarket.functions.urls import canonical_url
from jobmarket.operators.lifecycle import latest, latest_run
from jobmarket.operators.tracking import reminders

SORTS = ("score", "newest", "title", "company")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class InboxQuery:
    """What the inbox shows. `new_only` reads all runs unless current_run was set on purpose."""

    source: str | None = None
    label: str | None = None
    status: str | None = None
    new_only: bool = False
    current_run: bool | None = None
    min_score: int = 0
    hide_below: bool = False
    sort: str = "score"

    def __post_init__(self) -> None:
        if self.sort not in SORTS:
            raise ValueError(f"sort must be one of {SORTS}")
        if not 0 <= self.min_score <= 100:
            raise ValueError("min_score must be from 0 to 100")
        for name, known in (("source", None), ("label", ("High", "Medium", "Low")), ("status", STATUSES)):
            object.__setattr__(self, name, _spelled(getattr(self, name), known))

    def merged(self, **overrides: object) -> InboxQuery:
        """These preferences with overrides; a value of None clears a filter."""
        return replace(self, **overrides)

    def with_options(self, clear_filters: bool = False, all_runs: bool = False, **given: object) -> InboxQuery:
        """These preferences with options given by a caller; None keeps what was set.

        clear_filters drops source, label, status and new_only and goes back to the current run before the other options count;
        it also wins over a source, label, status or new_only given with it. all_runs wins over current_run.
        """
        given = {k: v for k, v in given.items() if v not in (None, "")}
        if clear_filters:
            given = {"current_run": True} | {k: v for k, v in given.items() if k not in ("source", "label", "status", "new_only")} | {"source": None, "label": None, "status": None, "new_only": False}
        if all_runs:
            given["current_run"] = False
        return replace(self, **given)

    @property
    def only_current(self) -> bool:
        return (not self.new_only) if self.current_run is None else self.current_run


def _spelled(value: object, known: tuple[str, ...] | None) -> str | None:
    """A filter text with white space collapsed and its known spelling; blank is no filter."""
    text = " ".join(str(value or "").split())
    if not text:
        return None
    for k in known or (text,):
        if k.lower() == text.lower():
            return k
    raise ValueError(f"{text!r} is none of {known}")


def ascii_fold(c: Column) -> Column:
    """Case-insensitive order for A-Z only."""
    return F.translate(c, UPPER, LOWER)


def with_analysis(vacancies: DataFrame, analyses: DataFrame) -> DataFrame:
    """Vacancies with their newest analysis: analysis_id, score, fit_label."""
    a = latest(analyses.select("vacancy_source_url", "id", "score", "fit_label"), "vacancy_source_url").withColumnsRenamed({"vacancy_source_url": "source_url", "id": "analysis_id"})
    return vacancies.join(a, "source_url", "left")


def inbox(vacancies: DataFrame, analyses: DataFrame, applications: DataFrame, runs: DataFrame, query: InboxQuery = InboxQuery()) -> DataFrame:
    """Rows of the inbox in order. Without any finished run, filters on the run give no rows."""
    apps = applications.select(F.col("vacancy_source_url").alias("source_url"), F.col("status").alias("application_status"))
    run = F.broadcast(latest_run(runs).select(F.col("id").alias("_run")))  # one row at most
    rows = with_analysis(vacancies, analyses).join(apps, "source_url", "left").join(run, F.lit(True), "left")
    rows = rows.withColumns({"is_new": F.coalesce(F.col("first_seen_run_id") == F.col("_run"), F.lit(False)), "is_current": F.coalesce(F.col("last_seen_run_id") == F.col("_run"), F.lit(False))})
    if query.source:
        rows = rows.where(F.col("source_name") == query.source)
    if query.label:
        rows = rows.where(F.col("fit_label") == query.label)
    if query.status:
        rows = rows.where(F.col("application_status") == query.status)
    if query.new_only:
        rows = rows.where("is_new")
    if query.only_current:
        rows = rows.where("is_current")
    if query.hide_below:
        rows = rows.where(F.coalesce("score", F.lit(-1)) >= query.min_score)
    return rows.drop("_run").orderBy(*inbox_order(query.sort))


def inbox_order(sort: str) -> list[Column]:
    newest, title = F.col("last_seen_at").desc_nulls_last(), F.col("title").asc_nulls_first()
    return {
        "score": [F.coalesce("score", F.lit(-1)).desc(), newest, title],
        "newest": [newest, title],
        "title": [ascii_fold(F.col("title")).asc_nulls_first()],
        "company": [ascii_fold(F.col("company")).asc_nulls_first(), ascii_fold(F.col("title")).asc_nulls_first()],
    }[sort] + [F.col("source_url")]


def tracked(vacancies: DataFrame, analyses: DataFrame, applications: DataFrame) -> DataFrame:
    """Applications with their vacancy and the analysis they are pinned to, else the newest."""
    newest = analyses.groupBy("vacancy_source_url").agg(F.max("id").alias("_newest"))
    apps = applications.join(newest, "vacancy_source_url", "left").withColumn("_id", F.coalesce("analysis_id", "_newest"))
    a = analyses.select(F.col("id").alias("_id"), "score", "fit_label")
    v = vacancies.select(F.col("source_url").alias("vacancy_source_url"), "title", "company", "location", "source_name", "source_id")
    return apps.drop("analysis_id", "_newest").join(v, "vacancy_source_url").join(a, "_id", "left").withColumnRenamed("_id", "analysis_id")


def tracked_order() -> list[Column]:
    return [F.col("status"), F.col("title").asc_nulls_first(), F.col("vacancy_source_url")]


def detail(vacancies: DataFrame, analyses: DataFrame, applications: DataFrame, events: DataFrame, items: DataFrame) -> DataFrame:
    """Each vacancy with its newest analysis, application, status history and actions (a vacancy's few)."""
    listed = lambda df, by, name: df.groupBy(F.col("vacancy_source_url").alias("source_url")).agg(F.array_sort(F.collect_list(F.struct(by, *[c for c in df.columns if c not in (by, "vacancy_source_url")]))).alias(name))
    apps = applications.select(F.col("vacancy_source_url").alias("source_url"), F.struct("status", "notes", "analysis_id").alias("application"))
    return with_analysis(vacancies, analyses).join(apps, "source_url", "left").join(listed(events, "id", "history"), "source_url", "left").join(listed(items, "action_id", "actions"), "source_url", "left")


def recent(vacancies: DataFrame, analyses: DataFrame, applications: DataFrame, runs: DataFrame, n: int = 20) -> DataFrame:
    """Today's list: the first rows of the current run, whatever their score."""
    return inbox(vacancies, analyses, applications, runs, InboxQuery(current_run=True)).limit(n)


def today(vacancies: DataFrame, analyses: DataFrame, applications: DataFrame, runs: DataFrame, items: DataFrame, now: Column, n: int = 20) -> tuple[DataFrame, DataFrame]:
    """Today's list, and the open reminders with their vacancy's title (to show in tracking.reminder_order)."""
    titles = vacancies.select(F.col("source_url").alias("vacancy_source_url"), F.col("title").alias("vacancy_title"))
    return recent(vacancies, analyses, applications, runs, n), reminders(items, now).join(titles, "vacancy_source_url", "left")


def vacancy_list(vacancies: DataFrame, analyses: DataFrame) -> DataFrame:
    """All vacancies with their newest analysis (to show in list_order)."""
    return with_analysis(vacancies, analyses)


def list_order() -> list[Column]:
    return [F.coalesce("score", F.lit(-1)).desc(), F.col("title").asc_nulls_first(), F.col("source_url")]


def by_url(vacancies: DataFrame, wanted: DataFrame, url: str = "url") -> DataFrame:
    """Vacancies stored under the canonical form of the wanted URLs: wanted's columns and the vacancy's (null where there is none)."""
    asked = wanted.withColumn("_key", canonical_url(F.col(url)))
    return asked.join(vacancies.withColumn("_key", F.col("source_url")), "_key", "left").drop("_key")


def by_source_id(vacancies: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: source_id, source_name (null: any source). Adds source_url and problem: ambiguous where an id alone names several sources, or unknown."""
    v = vacancies.select("source_url", F.col("source_id").alias("_id"), F.col("source_name").alias("_name"))
    hits = wanted.join(v, (F.col("source_id") == F.col("_id")) & (F.col("source_name").isNull() | (F.col("source_name") == F.col("_name"))), "left")
    found = hits.groupBy("source_id", "source_name").agg(F.min("source_url").alias("_url"), F.count_distinct("_name").alias("_n"), F.array_join(F.sort_array(F.collect_set("_name")), ", ").alias("sources"))
    problem = F.when(F.col("_n") > 1, "ambiguous").when(F.col("_n") == 0, "unknown")
    return found.select("source_id", "source_name", F.when(F.col("_n") == 1, F.col("_url")).alias("source_url"), problem.alias("problem"), "sources")
