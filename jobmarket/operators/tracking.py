"""Application status commands and action items, folded in order of their ids."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobmarket.operators.order import with_place

#: The status graph.
TRANSITIONS = {
    "Saved": ("Applied", "Interview", "Withdrawn"), "Applied": ("Interview", "Rejected", "Withdrawn"), "Interview": ("Offer", "Rejected", "Withdrawn"), "Offer": ("Withdrawn",),
    "Rejected": (), "Withdrawn": (),
}


def allowed(previous: Column, new: Column) -> Column:
    table = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))])
    return F.coalesce(F.array_contains(F.try_element_at(table, previous), new), F.lit(False))


#: The rules of a command, in order: the first whose facts all hold names the verdict. The batch fold and the stream read this one table.
RULES = (
    ("no_application", ("absent",)),
    ("unknown_status", ("unknown",)),
    ("reason_required", ("corrective", "bare")),
    ("reason_refused", ("plain", "reasoned")),
    ("unchanged", ("same",)),
    ("accepted", ("corrective",)),
    ("accepted", ("allowed",)),
    ("not_allowed", ()),
)


def verdict(state: Column, command: Column) -> Column:
    """accepted, unchanged, or why a command is refused, given the current status (null: no application)."""
    reason, corrective = F.trim(F.coalesce(command["reason"], F.lit(""))), F.coalesce(command["kind"] == "corrective", F.lit(False))
    facts = {
        "absent": state.isNull(), "unknown": ~command["new_status"].isin(*TRANSITIONS) | command["new_status"].isNull(), "corrective": corrective, "plain": ~corrective,
        "bare": reason == "", "reasoned": reason != "", "same": F.coalesce(state == command["new_status"], F.lit(False)), "allowed": allowed(state, command["new_status"]),
    }
    out = None
    for name, needed in RULES:
        holds = reduce(and_, [facts[f] for f in needed], F.lit(True))
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out


def verdict_of(state: str | None, new_status: str | None, kind: str | None, reason: str | None) -> str:
    """verdict, for one command of a stream."""
    said, corrective = (reason or "").strip(" "), kind == "corrective"
    facts = {
        "absent": state is None, "unknown": new_status not in TRANSITIONS, "corrective": corrective, "plain": not corrective, "bare": not said, "reasoned": bool(said),
        "same": state is not None and state == new_status, "allowed": new_status in TRANSITIONS.get(state or "", ()),
    }
    return next(name for name, needed in RULES if all(facts[f] for f in needed))


FOLD = 500  # commands that are folded together, and maps that are composed together
OTHER = "?"  # in a map: a status that the graph does not know, unmoved


def apply_commands(applications: DataFrame, commands: DataFrame) -> DataFrame:
    """Every command with the status before it and its verdict. Refused commands do not move the status.

    applications: vacancy_source_url, status. commands: id, vacancy_source_url, new_status, kind, reason.

    Commands are placed in order of application and id over range partitions, and cut by place into runs of at most FOLD. A run maps each possible
    status before it to one after it. Up to FOLD neighbouring maps are composed to one of the next level, until an application has a single one; then
    statuses go down again: a node's start gives its children theirs. The depth is the logarithm of the commands to the base FOLD, and no list
    is longer than FOLD, so an application with any number of commands is spread over tasks.
    """
    key = "vacancy_source_url"
    rest = [c for c in commands.columns if c not in ("id", key)]
    placed = with_place(commands, [F.col(key).asc(), F.col("id").asc()], "_place")
    last = placed.agg(F.max("_place")).first()[0] or 0
    run = F.floor((F.col("_place") - 1) / FOLD).alias("_run")
    runs = placed.groupBy(key, run).agg(F.array_sort(F.collect_list(F.struct("id", *rest))).alias("_c"))
    states = F.array(*map(F.lit, (*TRANSITIONS, OTHER)))
    after = lambda s, c: F.when(verdict(s, c) == "accepted", c["new_status"]).otherwise(s)
    known = lambda s: F.coalesce(F.nullif(F.array_position(states, s).cast("int"), F.lit(0)), F.lit(len(TRANSITIONS) + 1))
    level = runs.select(key, "_run", F.transform(states, lambda s: F.aggregate("_c", s, after)).alias("_map"))
    levels: list[DataFrame] = []
    through = lambda s, m: F.when(F.element_at(m, known(s)) == OTHER, s).otherwise(F.element_at(m, known(s)))
    size = FOLD
    while size < last:  # as deep as the logarithm of all commands
        parents = level.groupBy(key, F.floor(F.col("_run") / FOLD).alias("_parent")).agg(F.array_sort(F.collect_list(F.struct("_run", "_map"))).alias("_children"))
        levels.append(parents)
        level = parents.select(key, F.col("_parent").alias("_run"), F.transform(states, lambda s: F.aggregate("_children", s, lambda x, child: F.element_at(child["_map"], known(x)))).alias("_map"))
        size *= FOLD
    starts = level.select(key, "_run").join(applications.select(key, F.col("status").alias("_start")), key, "left")
    for parents in reversed(levels):
        step = lambda s, child: F.struct(
            F.when(s["now"].isNotNull(), through(s["now"], child["_map"])).alias("now"), F.concat(s["out"], F.array(F.struct(child["_run"].alias("_run"), s["now"].alias("_start")))).alias("out")
        )
        begin = F.struct(F.col("_start").alias("now"), F.array().cast("array<struct<_run:bigint,_start:string>>").alias("out"))
        opened = parents.withColumnRenamed("_parent", "_run").join(starts, [key, "_run"]).drop("_run")
        starts = opened.select(key, F.explode(F.aggregate("_children", begin, step, lambda s: s["out"])).alias("_x")).select(key, "_x._run", "_x._start")
    joined = runs.join(starts, [key, "_run"])

    def step_command(s: Column, c: Column) -> Column:
        v = verdict(s["now"], c)
        row = F.struct(c.alias("command"), s["now"].alias("previous_status"), v.alias("verdict"))
        return F.struct(F.when(v == "accepted", c["new_status"]).otherwise(s["now"]).alias("now"), F.concat(s["out"], F.array(row)).alias("out"))

    kind = f"array<struct<command:{commands.select(F.struct('id', *rest).alias('x')).schema['x'].dataType.simpleString()},previous_status:string,verdict:string>>"
    start = F.struct(F.col("_start").alias("now"), F.array().cast(kind).alias("out"))
    out = joined.withColumn("_o", F.explode(F.aggregate("_c", start, step_command, lambda s: s["out"])))
    return out.select(key, *[F.col(f"_o.command.{c}").alias(c) for c in ("id", *rest)], "_o.previous_status", "_o.verdict")


def accepted_events(folded: DataFrame) -> DataFrame:
    return folded.where("verdict = 'accepted'")


def final_status(applications: DataFrame, folded: DataFrame) -> DataFrame:
    """Applications with their status after all commands."""
    moved = accepted_events(folded).groupBy("vacancy_source_url").agg(F.max_by("new_status", "id").alias("_new"))
    return applications.join(moved, "vacancy_source_url", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")


def save_records(applications: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Save whole records (vacancy_source_url, analysis_id, status, notes): applications, events, refused records.

    A new record is an event without a previous status, a changed status an event that the graph must allow; a refused record
    leaves its application as it was.
    """
    new = records.select("vacancy_source_url", *[F.col(c).alias(f"_{c}") for c in ("analysis_id", "status", "notes")])
    joined = applications.join(new, "vacancy_source_url", "full").withColumn("_saves", F.col("_status").isNotNull())
    moved = F.col("_saves") & F.col("status").isNotNull() & (F.col("status") != F.col("_status"))
    joined = joined.withColumn("_refused", F.coalesce(moved & ~allowed(F.col("status"), F.col("_status")), F.lit(False)))
    take = F.col("_saves") & ~F.col("_refused")
    out = joined.where(F.col("status").isNotNull() | take).select("vacancy_source_url", *[F.when(take, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("analysis_id", "status", "notes")])
    changed = joined.where(take & (F.col("status").isNull() | (F.col("status") != F.col("_status"))))
    events = changed.select("vacancy_source_url", F.col("status").alias("previous_status"), F.col("_status").alias("new_status"), F.lit("system").alias("origin"), F.lit("normal").alias("kind"), F.col("_notes").alias("note"), F.lit("").alias("reason"))
    return out, events, joined.where("_refused").select("vacancy_source_url", F.col("status").alias("previous_status"), F.col("_status").alias("new_status"))


def broken_history(events: DataFrame) -> DataFrame:
    """Events whose previous status is not the new status of the event before."""
    w = Window.partitionBy("vacancy_source_url").orderBy("id")
    return events.withColumn("_last", F.lag("new_status").over(w)).where(F.col("_last").isNotNull() & ~F.col("_last").eqNullSafe(F.col("previous_status"))).drop("_last")


def ensure_applications(applications: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insert what is absent; fill an absent analysis, and a note only if empty; events for new ones. wanted: vacancy_source_url, analysis_id, notes."""
    w = wanted.select("vacancy_source_url", F.col("analysis_id").alias("_id"), F.col("notes").alias("_note"))
    joined = applications.withColumn("_old", F.lit(True)).join(w, "vacancy_source_url", "full")
    empty = F.coalesce("notes", F.lit("")) == ""
    out = joined.select("vacancy_source_url", F.coalesce("analysis_id", "_id").alias("analysis_id"), F.coalesce("status", F.lit("Saved")).alias("status"), F.when(empty, F.coalesce("_note", F.lit(""))).otherwise(F.col("notes")).alias("notes"))
    return out, joined.where("_old is null").select("vacancy_source_url", F.lit(None).cast("string").alias("previous_status"), F.lit("Saved").alias("new_status"))


def apply_actions(vacancies: DataFrame, commands: DataFrame) -> DataFrame:
    """Action items after create, update, complete and reopen commands; a create without title or parent is rejected.

    commands: id (unique), action_id, vacancy_source_url, op, title, due_at, at. The first valid create counts, commands before it do nothing. Completing
    twice keeps the first time; reopening clears it. Every field is an aggregate by id, so an action with any number of commands is summed up before the
    shuffle and never listed.
    """
    parents = vacancies.select(F.col("source_url").alias("vacancy_source_url"), F.lit(True).alias("_parent"))
    c = commands.join(parents, "vacancy_source_url", "left").withColumn("title", F.nullif(F.trim("title"), F.lit("")))
    good = c.where("op <> 'create' or (_parent and title is not null)")
    created = good.where("op = 'create' and at is not null").groupBy("action_id").agg(F.min_by(F.struct("id", "vacancy_source_url", F.col("at").alias("at")), "id").alias("_c"))
    live = good.join(created, "action_id").where("id >= _c.id")
    edit = (F.col("id") == F.col("_c.id")) | (F.col("op") == "update")
    last = lambda value, rows: F.max_by(F.when(rows, value), F.when(rows, F.col("id")))
    state = live.groupBy("action_id").agg(
        F.any_value("_c").alias("_c"), last(F.col("title"), edit & F.col("title").isNotNull()).alias("title"), last(F.col("due_at"), edit).alias("due_at"), F.max_by("at", "id").alias("updated_at"),
        F.max(F.when(F.col("op") == "reopen", F.col("id"))).alias("_reopened"), F.count_if(F.col("op") == "complete").alias("_completions"),
    )
    done = live.where("op = 'complete' and at is not null").join(state.where("_completions > 0").select("action_id", "_reopened"), "action_id").where("_reopened is null or id > _reopened")
    done = done.groupBy("action_id").agg(F.min_by("at", "id").alias("completed_at"))
    out = state.join(done, "action_id", "left")
    return out.select("action_id", "_c.vacancy_source_url", "title", "due_at", "completed_at", F.col("_c.at").alias("created_at"), "updated_at", F.when(F.col("completed_at").isNull(), "open").otherwise("completed").alias("state"))


def actions(items: DataFrame, url: str | None = None, completed: bool = True) -> DataFrame:
    out = items if url is None else items.where(F.col("vacancy_source_url") == url)
    out = out if completed else out.where("completed_at is null")
    return out.orderBy(F.col("due_at").asc_nulls_last(), "action_id")


def reminders(items: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Open items due within some hours of now: overdue or due_soon. Show them in reminder_order."""
    due = items.where(F.col("completed_at").isNull() & F.col("due_at").isNotNull() & (F.col("due_at") <= now + F.expr(f"INTERVAL {hours} HOURS")))
    return due.withColumn("reminder_state", F.when(F.col("due_at") < now, "overdue").otherwise("due_soon"))


def reminder_order() -> list[Column]:
    return [F.col("due_at").asc(), F.col("action_id").asc()]
