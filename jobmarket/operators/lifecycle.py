"""Vacancy lifecycle over collection runs: upserts, observations, run summaries, identity merge, pruning.

Tables are Parquet; an upsert is a full outer join of old and new rows on the canonical URL. "Latest" is
always the greatest id. First writer or last writer of a batch is chosen by a window over the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobmarket.functions.urls import canonical_url

STATUS_RANK = ("Saved", "Applied", "Interview", "Offer", "Rejected", "Withdrawn")
CONTENT = ("source_name", "source_id", "title", "company", "location", "salary_text", "requirements", "responsibilities", "raw_text")


def latest(df: DataFrame, key: str, by: str = "id") -> DataFrame:
    """The newest row of each key, by map-side max over one struct."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), by).alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in rest])


def one_writer(batch: DataFrame, key: str, order: str, refresh: bool) -> DataFrame:
    """Within a batch the first occurrence of a key supplies its content, or with refresh the last."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc() if refresh else F.col(order).asc())
    return batch.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


SKETCH_URLS = 4_000_000  # stored URLs up to which their sketch is broadcast: 2 bytes of bits each, some 40 MB as rows
_WORD_URLS = 4  # URLs for each word of 64 bits


def _bits(url: Column, words: int) -> tuple[Column, Column]:
    """A URL's word of the sketch, and its three bits there."""
    h = F.xxhash64(url)
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftrightunsigned", h, F.lit(at)).bitwiseAND(F.lit(63)).cast("int"))
    return h.bitwiseAND(F.lit(words - 1)), bit(40).bitwiseOR(bit(46)).bitwiseOR(bit(52))


def url_sketch(stored: DataFrame, words: int, key: str = "source_url") -> DataFrame:
    """A Bloom sketch of stored URLs as rows word, bits: each URL sets three bits of one word. words: a power of two."""
    word, bits = _bits(F.col(key), words)
    return stored.select(word.alias("_word"), bits.alias("_b")).groupBy("_word").agg(F.bit_or("_b").alias("_bits"))


def known_and_new(batch: DataFrame, stored: DataFrame, key: str = "source_url") -> tuple[DataFrame, DataFrame]:
    """Batch rows whose URL is stored (only observed) and those to process; a null URL is new.

    A sketch of the stored URLs is broadcast: rows that it cannot hold are new where they lie, and only possible hits, with their html, are shuffled to the exact
    join. Beyond SKETCH_URLS the batch's distinct URLs are joined with the stored ones first, and rows meet that list of known URLs.
    """
    urls = stored.select(key)
    n = urls.count()
    if n > SKETCH_URLS:
        known = batch.select(key).distinct().join(urls, key, "left_semi")
        return batch.join(known, key, "left_semi").select(*batch.columns), batch.join(known, key, "left_anti").select(*batch.columns)
    words = 1 << max(6, (n // _WORD_URLS).bit_length())
    word, bits = _bits(F.col(key), words)
    marked = batch.withColumns({"_word": word, "_mine": bits}).join(F.broadcast(url_sketch(stored, words, key)), "_word", "left")  # a row for each four URLs at most
    maybe = F.coalesce(F.col("_bits").bitwiseAND(F.col("_mine")) == F.col("_mine"), F.lit(False)) & F.col(key).isNotNull()
    possible, sure = marked.where(maybe).select(*batch.columns), marked.where(~maybe).select(*batch.columns)
    return possible.join(urls, key, "left_semi").select(*batch.columns), sure.unionByName(possible.join(urls, key, "left_anti"))


def upsert_vacancies(old: DataFrame, new: DataFrame) -> DataFrame:
    """Content is replaced; first_seen and the original URL stay once set; last_seen is replaced, its run even by null."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col("o.source_url") == F.col("n.source_url"), "full")
    has_new = F.col("n.source_url").isNotNull()
    pick = lambda c: F.when(has_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    keep = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
    return joined.select(
        F.coalesce("o.source_url", "n.source_url").alias("source_url"), *[pick(c) for c in CONTENT if c in old.columns], keep("original_source_url"),
        keep("first_seen_at"), keep("first_seen_run_id"), pick("last_seen_at"), pick("last_seen_run_id"),
    )


def observe_known(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Only last_seen moves; a missing run keeps the stored one. seen: source_url, observed_at, run_id."""
    s = seen.groupBy("source_url").agg(F.max(F.struct("observed_at", "run_id")).alias("_s"))
    return stored.join(s, "source_url", "left").withColumns({
        "last_seen_at": F.coalesce("_s.observed_at", "last_seen_at"), "last_seen_run_id": F.coalesce("_s.run_id", "last_seen_run_id"),
    }).drop("_s")


def upsert_observations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Key (run_id, vacancy_source_url): time and source are replaced, the original URL stays."""
    on = (F.col("o.run_id") == F.col("n.run_id")) & (F.col("o.vacancy_source_url") == F.col("n.vacancy_source_url"))
    joined = old.alias("o").join(new.alias("n"), on, "full")
    first = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
    last = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    return joined.select(first("run_id"), first("vacancy_source_url"), last("observed_at"), last("source_name"), first("original_source_url"))


def run_summary(results: DataFrame) -> DataFrame:
    """results: run_id, source_name, outcome (saved, observed, failed), pages. Counts of each run and source."""
    return results.groupBy("run_id", "source_name").agg(
        F.count("*").alias("attempted"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_if(F.col("outcome") == "observed").alias("observed"),
        F.count_if(F.col("outcome") == "saved").alias("saved"), F.sum("pages").alias("pages"),
    )


def run_status(summary: DataFrame) -> DataFrame:
    """completed without failures; partial if anything was saved or observed; else failed."""
    totals = summary.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in ("attempted", "failed", "observed", "saved", "pages")])
    return totals.withColumn("status", F.when(F.col("failed") == 0, "completed").when(F.col("saved") + F.col("observed") > 0, "partial").otherwise("failed"))


def run_totals(summary: DataFrame) -> DataFrame:
    """Totals of a run over its sources for the daily message: attempted, failed and new (saved) vacancies, and the failed sources."""
    return summary.groupBy("run_id").agg(
        F.sum("attempted").alias("attempted"), F.sum("failed").alias("failed"), F.sum("saved").alias("new"), F.array_join(F.sort_array(F.collect_set("source_name")), ", ").alias("sources")
    )


def latest_run(runs: DataFrame) -> DataFrame:
    """The completed or partial run that finished last."""
    return runs.where(F.col("status").isin("completed", "partial")).orderBy(F.col("finished_at").desc_nulls_last(), F.col("id").desc()).limit(1)


def collisions(stored: DataFrame) -> DataFrame:
    """URL groups that need a merge: more than one stored URL, or one that is not canonical. Survivor: the canonical URL if stored, else the smallest."""
    c = stored.select("source_url", canonical_url(F.col("source_url")).alias("canonical"))
    g = c.groupBy("canonical").agg(F.count("*").alias("members"), F.min("source_url").alias("smallest"), F.max(F.col("source_url") == F.col("canonical")).alias("stored"))
    return g.where("members > 1 or not stored").select("canonical", "members", F.when(F.col("stored"), F.col("canonical")).otherwise(F.col("smallest")).alias("survivor"))


def merged_vacancies(stored: DataFrame) -> DataFrame:
    """One row for each canonical URL: the survivor's content, the earliest first and the latest last sighting.

    Times compare with their runs, null times aside; a run that stays null takes the smallest (largest) known run.
    """
    rows = stored.withColumn("_c", canonical_url(F.col("source_url")))
    first, last = F.struct("first_seen_at", "first_seen_run_id"), F.struct("last_seen_at", "last_seen_run_id")
    content = [c for c in CONTENT if c in stored.columns]
    best = F.min_by(F.struct("source_url", *content), F.struct((F.col("source_url") != F.col("_c")).alias("a"), F.col("source_url").alias("b")))
    g = rows.groupBy("_c").agg(
        best.alias("_s"), F.min(F.when(F.col("first_seen_at").isNotNull(), first)).alias("_f"), F.max(F.when(F.col("last_seen_at").isNotNull(), last)).alias("_l"),
        F.min("first_seen_run_id").alias("_fr"), F.max("last_seen_run_id").alias("_lr"),
    )
    return g.select(
        F.col("_c").alias("source_url"), *[F.col("_s")[c].alias(c) for c in content], F.col("_s.source_url").alias("original_source_url"),
        F.col("_f.first_seen_at").alias("first_seen_at"), F.coalesce("_f.first_seen_run_id", "_fr").alias("first_seen_run_id"),
        F.col("_l.last_seen_at").alias("last_seen_at"), F.coalesce("_l.last_seen_run_id", "_lr").alias("last_seen_run_id"),
    )


def ordered_texts(value: Column, order: Column, separator: str) -> Column:
    """Distinct texts of a group joined in order of their first occurrence."""
    sorted_ = F.array_sort(F.collect_list(F.when(value.isNotNull() & (value != ""), F.struct(order.alias("o"), value.alias("v")))))
    return F.array_join(F.array_distinct(F.transform(sorted_, lambda x: x["v"])), separator)


def merged_observations(observations: DataFrame) -> DataFrame:
    """One row for each run and canonical URL: the latest sighting's time and source, all original URLs."""
    rows = observations.withColumn("_c", canonical_url(F.col("vacancy_source_url")))
    # One row per distinct original first: lists hold distinct values only.
    distinct = rows.groupBy("run_id", "_c", "original_source_url").agg(F.max(F.struct("observed_at", "source_name")).alias("_l"), F.min("observed_at").alias("_o"))
    return distinct.groupBy("run_id", F.col("_c").alias("vacancy_source_url")).agg(
        F.max("_l.observed_at").alias("observed_at"), F.max("_l")["source_name"].alias("source_name"), ordered_texts(F.col("original_source_url"), F.col("_o"), "\n").alias("original_source_url")
    )


def merged_applications(applications: DataFrame) -> DataFrame:
    """One row for each canonical URL: the furthest status, labelled notes, the newest analysis."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUS_RANK]), F.col("status"))
    url = F.col("vacancy_source_url")
    note = F.when(F.trim(F.coalesce("notes", F.lit(""))) != "", F.concat(F.lit("["), url, F.lit("] "), F.trim("notes")))
    return applications.groupBy(canonical_url(url).alias("canonical")).agg(
        F.max_by("status", F.struct(rank.alias("r"), url.alias("u"))).alias("status"), ordered_texts(note, url, "\n").alias("notes"), F.max("analysis_id").alias("analysis_id")
    ).withColumnRenamed("canonical", "vacancy_source_url")


def aliases(stored: DataFrame) -> DataFrame:
    """Every stored URL of a merged group with its canonical URL and its whole old row as JSON."""
    groups = collisions(stored).select("canonical")
    rows = stored.withColumn("canonical", canonical_url(F.col("source_url"))).join(groups, "canonical", "left_semi")
    return rows.select(F.col("source_url").alias("original"), "canonical", F.col("canonical").alias("collision_group"), F.to_json(F.struct(*stored.columns)).alias("legacy_vacancy"))


def prune_candidates(vacancies: DataFrame, analyses: DataFrame, applications: DataFrame, threshold: int) -> DataFrame:
    """URLs without an application whose newest score is known and below the threshold."""
    scores = analyses.groupBy(F.col("vacancy_source_url").alias("source_url")).agg(F.max_by("score", "id").alias("score"))
    free = vacancies.join(applications.select(F.col("vacancy_source_url").alias("source_url")), "source_url", "left_anti")
    return free.join(scores, "source_url").where(F.col("score") < threshold).select("source_url", "score")


def prune_count(pruned: DataFrame) -> DataFrame:
    """How many vacancies a prune removes."""
    return pruned.agg(F.count_distinct("source_url").alias("removed"))


def rewritten_keys(child: DataFrame, stored: DataFrame, key: str = "vacancy_source_url") -> DataFrame:
    """A child table after an identity merge: keys of merged vacancies become their canonical URL, others stay."""
    moved = aliases(stored).where("original <> canonical").select(F.col("original").alias("_old"), F.col("canonical").alias("_new"))
    return child.join(moved, F.col(key) == F.col("_old"), "left").withColumn(key, F.coalesce("_new", key)).drop("_old", "_new")


def without_pruned(tables: dict[str, DataFrame], pruned: DataFrame, keys: dict[str, str]) -> dict[str, DataFrame]:
    """Every table without the rows of pruned URLs; keys: the URL column of each table."""
    return {name: df.join(pruned.select(F.col("source_url").alias(keys[name])), keys[name], "left_anti") for name, df in tables.items()}


def auto_save(applications: DataFrame, analyses: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Applications after an analysis batch, and the events of new ones.

    An existing application takes the new analysis and a note only if it has none; otherwise one is created as Saved when
    the score reaches the threshold. analyses: id, vacancy_source_url, score, note.
    """
    a = analyses.select("vacancy_source_url", F.col("id").alias("_id"), F.col("score").alias("_score"), F.col("note").alias("_note"))
    joined = applications.withColumn("_old", F.lit(True)).join(a, "vacancy_source_url", "full")
    kept = joined.where(F.col("_old") | (F.col("_score") >= threshold))
    out = kept.select(
        "vacancy_source_url", F.coalesce("_id", "analysis_id").alias("analysis_id"), F.coalesce("status", F.lit("Saved")).alias("status"),
        F.when(F.coalesce("notes", F.lit("")) == "", F.coalesce("_note", F.lit(""))).otherwise(F.col("notes")).alias("notes"),
    )
    events = kept.where("_old is null").select("vacancy_source_url", F.lit(None).cast("string").alias("previous_status"), F.lit("Saved").alias("new_status"), F.lit("system").alias("origin"), F.lit("normal").alias("kind"))
    return out, events


def baseline_events(applications: DataFrame, events: DataFrame) -> DataFrame:
    """One baseline event for each application that has none."""
    bare = applications.join(events.select("vacancy_source_url"), "vacancy_source_url", "left_anti")
    return bare.select("vacancy_source_url", F.lit(None).cast("string").alias("previous_status"), F.col("status").alias("new_status"), F.lit("migration").alias("origin"), F.lit("baseline").alias("kind"))


def orphans(children: dict[str, tuple[DataFrame, str]], vacancies: DataFrame) -> DataFrame:
    """Rows of each child table whose vacancy is missing, as counts."""
    out = None
    for name, (df, key) in children.items():
        n = df.join(vacancies.select(F.col("source_url").alias(key)), key, "left_anti").agg(F.lit(name).alias("child"), F.count("*").alias("orphans"))
        out = n if out is None else out.unionByName(n)
    return out


def ambiguous_ids(vacancies: DataFrame) -> DataFrame:
    """Source ids that name vacancies of more than one source."""
    return vacancies.groupBy("source_id").agg(F.count_distinct("source_name").alias("n_sources"), F.array_join(F.sort_array(F.collect_set("source_name")), ",").alias("sources")).where("n_sources > 1")


def begin_runs(runs: DataFrame, new: DataFrame) -> DataFrame:
    """Runs with new ones opened. new: id, started_at."""
    opened = new.join(runs.select("id"), "id", "left_anti").select("id", "started_at", F.lit(None).cast("timestamp").alias("finished_at"), F.lit("running").alias("status"))
    return runs.select("id", "started_at", "finished_at", "status").unionByName(opened)


def finish_runs(runs: DataFrame, statuses: DataFrame, at: Column) -> DataFrame:
    """Running runs get their terminal status (from run_status); finished ones stay as they are."""
    s = statuses.select(F.col("run_id").alias("id"), F.col("status").alias("_new"))
    ends = F.col("status").eqNullSafe(F.lit("running")) & F.col("_new").isin("completed", "partial", "failed")
    return runs.join(s, "id", "left").withColumns({"finished_at": F.when(ends, at).otherwise(F.col("finished_at")), "status": F.when(ends, F.col("_new")).otherwise(F.col("status"))}).drop("_new")
