"""Repair of damaged conversations by Viterbi with coalescing survivors.

A repaired conversation's role initials are `(s?(ua)+)?`. Edits of one row: Keep (0), Rerole to user or assistant (2), Delete (3, the only one
for blank and duplicate rows); Insert (2) adds an empty user or assistant turn anywhere; a truncated row that stays costs 1 more.
The cheapest edits win, ties by their initials D, I, K, R.

The trellis has four states (nothing yet, after s, after u, after a). Each keeps one survivor, a leaf of a tree of back pointers with reference
counts. A survivor that another one beats strictly whatever follows is dropped; branches without survivors die, and once all survivors share an
ancestor, the edits down to it are final and leave the tree. So memory holds the unresolved edits only. Tied survivors are compared over their complete unresolved suffixes:
the first place where two of them differ is carried along from row to row. Each survivor holds the running hash of its own repaired text, so no text waits for a decision.

Sorting, damage and faults are Spark's; a duplicate is found by its place among equal rows over range partitions, so a conversation of
any size is spread there. The fold itself reads a conversation's rows in order, batch by batch, in one task: its hash is one chain from the first
row to the last, hence cannot be split; memory does not grow with the rows read, except by the audit string and by ties that stay open.

Nulls: a null conv_id is a conversation; null roles and texts count as one space; null turns come first and count in no gap. Rows of one turn are ordered
by role, then text; repeated rows are duplicates. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmarket.llm.common import prefix_sums

#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}  # the only role that a rerole or an insertion can give
FINAL = (0, 3)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
#: BEATS[y][x]: what it costs at most to follow, from state y, whatever completes state x.
BEATS = ((0, 0, 2, 0), (4, 0, 2, 4), (5, 2, 0, 2), (3, 0, 2, 0))
SPACES = " \t\n\x0b\x0c\r"


def _apart(a: str, b: str) -> tuple[str, str]:
    """The first place where a and b differ; ("", rest) or (rest, "") if one begins the other."""
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return (a[n], b[n]) if n < len(a) and n < len(b) else (a[n:], b[n:])


def _first(costs: tuple, order: dict, left: tuple, right: tuple) -> bool:
    """Whether candidate left (cost, parent, edits) comes before right."""
    if left[0] != right[0]:
        return left[0] < right[0]
    a, b = order[left[1], right[1]]
    return _apart(a + left[2], b + right[2]) < _apart(b + right[2], a + left[2])


@lru_cache(maxsize=100_000)
def advance(costs: tuple, order: tuple, initial: str, fault: str) -> tuple[int, tuple, tuple, tuple]:
    """One row of the trellis: (cost added to all, costs above it, order, choices), a choice being (parent state, edits) or None.

    costs: of each survivor, None if dropped. order: for each pair of states where their edits differ first. fault: one of blank, duplicate, truncated, "", start.
    """
    where = {(i, j): order[i * 4 + j] for i in range(4) for j in range(4)}
    best: list[tuple | None] = [None] * 4

    def offer(state: int, candidate: tuple) -> None:
        if best[state] is None or _first(costs, where, candidate, best[state]):
            best[state] = candidate

    for p, cost in enumerate(costs):
        if cost is None:
            continue
        if fault == "start":
            offer(p, (cost, p, ""))
            continue
        offer(p, (cost + DELETE, p, "D"))
        if fault not in ("blank", "duplicate"):
            stays = cost + (TRUNCATED if fault == "truncated" else 0)
            if (p, initial) in MOVES:
                offer(MOVES[p, initial], (stays, p, "K"))
            offer(MOVES[p, NEXT[p]], (stays + REROLE, p, "R"))
    for _ in range(2):  # s, u, a: two insertions in a row at most
        for p in range(4):
            if best[p] is not None:
                cost, parent, edits = best[p]
                offer(MOVES[p, NEXT[p]], (cost + INSERT, parent, edits + "I"))
    least = min(b[0] for b in best if b)
    kept = [b if b and not any(o and o[0] + BEATS[y][x] < b[0] for y, o in enumerate(best)) else None for x, b in enumerate(best)]
    new = []
    for b in kept:
        for o in kept:
            if b and o:
                a, c = where[b[1], o[1]]
                new.append(_apart(a + b[2], c + o[2]))
            else:
                new.append(("", ""))
    return least, tuple(b and b[0] - least for b in kept), tuple(new), tuple(b and b[1:] for b in kept)


class Node:
    """One edit of the tree of back pointers."""

    __slots__ = ("parent", "edit", "role", "kids", "held")

    def __init__(self, parent: Node | None, edit: str, role: str):
        self.parent, self.edit, self.role, self.kids, self.held = parent, edit, role, [], 0
        if parent is not None:
            parent.kids.append(self)

    def release(self) -> None:
        """One survivor less; a branch without survivors dies."""
        self.held -= 1
        node = self
        while node is not None and not node.held and not node.kids:
            parent = node.parent
            if parent is not None:
                parent.kids.remove(node)
            node = parent


class Repair:
    """Fold of one conversation: add(row) in order, then finish(). Final edits go to `emit` as (edit, role initial)."""

    def __init__(self, emit) -> None:
        self.emit, self.cost, self.root = emit, 0, Node(None, "", "")
        self.costs: tuple = (0, None, None, None)
        self.order: tuple = (("", ""),) * 16
        self.root.held = 1
        self.leaves: list = [self.root, None, None, None]
        self.hashes: list = [hashlib.sha256(), None, None, None]
        self._step("", "", "", "start")

    def _step(self, role: str, text: str, initial: str, fault: str) -> None:
        added, self.costs, self.order, choices = advance(self.costs, self.order, initial, fault)
        self.cost += added
        made: dict = {}
        hashes: list = [None] * 4
        leaves: list = [None] * 4
        for state, choice in enumerate(choices):
            if choice is None:
                continue
            p, edits = choice
            at, node, digest = p, self.leaves[p], self.hashes[p].copy()
            for n, edit in enumerate(edits):
                to = "" if edit == "D" else initial if edit == "K" else NEXT[at]
                key = (p, edits[:n + 1])
                if key not in made:
                    made[key] = Node(node, edit, to)
                node = made[key]
                if to:
                    turn = f"{role if edit == 'K' else ROLES[to]}:{'' if edit == 'I' else text}"
                    digest.update((turn if at == 0 else "\n" + turn).encode("utf-8", "surrogatepass"))
                    at = MOVES[at, to]
            node.held += 1
            leaves[state], hashes[state] = node, digest
        for leaf in self.leaves:
            if leaf is not None:
                leaf.release()
        self.leaves, self.hashes = leaves, hashes
        self._settle()

    def _settle(self) -> None:
        while not self.root.held and len(self.root.kids) == 1:
            self.root = self.root.kids[0]
            self.root.parent = None
            self.emit(self.root.edit, self.root.role)

    def add(self, role: str, text: str, fault: str) -> None:
        self._step(role, text, role[:1], fault)

    def finish(self) -> tuple[int, str]:
        """Emit what is left; (cost, sha256 of the repaired text)."""
        ends = [s for s in FINAL if self.costs[s] is not None]
        where = {(i, j): self.order[i * 4 + j] for i in range(4) for j in range(4)}
        end = ends[0]
        for s in ends[1:]:
            if _first(self.costs, where, (self.costs[s], s, ""), (self.costs[end], end, "")):
                end = s
        for s, leaf in enumerate(self.leaves):
            if leaf is not None and s != end:
                leaf.release()
        self.leaves[end].held = 0
        self._settle()
        return self.cost + self.costs[end], self.hashes[end].hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32("conv_id:turn") % 20; a dropped row stays with `gone`, so that its conversation is known."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(name.cast("binary")) % 20
    hurt = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"), hurt.alias("text"),
        (kind == 0).alias("gone"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _fault(text: Column, nth: Column) -> Column:
    """First of blank, duplicate, truncated; else empty."""
    seen = F.rtrim(text, F.lit(SPACES))
    return F.when(seen == "", "blank").when(nth > 0, "duplicate").when(~F.substring(seen, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")


def _whole(c: str) -> list[Column]:
    """A nullable long as two columns without nulls, `has_` and its value: exact on its way through pandas, and nulls first in order."""
    return [F.col(c).isNotNull().alias(f"has_{c}"), F.coalesce(c, F.lit(0)).cast("long").alias(c)]


ORDER = ("has_conv_id", "conv_id", "has_turn", "turn", "role", "text", "line")


def faulty(turns: DataFrame) -> DataFrame:
    """turns with `fault`. Equal rows of a conversation are numbered by turn over range partitions; all but the first are duplicates."""
    length = F.length("role").cast("string")
    same = F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.col("gone").cast("string"), length, "role", "text"), 256)
    rows = turns.select(*_whole("conv_id"), *_whole("turn"), "role", "text", "gone", same.alias("same"), F.monotonically_increasing_id().alias("line"))
    nth = prefix_sums(rows, ["has_turn", "turn", "line"], None, group="same", rank="nth")
    return nth.select(*ORDER, "gone", _fault(F.col("text"), F.col("nth")).alias("fault"))


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EDITS = "conv_id long, step long, edit string, role string, row long"


class _Conversation:
    """Counts of one conversation beside its repair."""

    def __init__(self, conv_id, keep: bool):
        self.conv_id, self.keep, self.step, self.row, self.audit, self.rows = conv_id, keep, 0, 0, [], []
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        self.illegal, self.before, self.low, self.high, self.turns = 0, None, None, None, 0
        self.repair = Repair(self.emit)

    def emit(self, edit: str, role: str) -> None:
        if self.keep:
            self.rows.append((self.conv_id, self.step, edit, role if edit in "RI" else None, None if edit == "I" else self.row))
            self.step += 1
            self.row += edit != "I"
        else:
            self.audit.append(edit)

    def add(self, turn, role: str, text: str, fault: str) -> None:
        self.counts[fault] += 1
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.repair.add(role, text, fault)

    def summary(self) -> tuple:
        cost, digest = self.repair.finish()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, self.counts["blank"], self.counts["duplicate"], self.counts["truncated"], self.illegal, cost, "".join(self.audit), digest)


def _fold(turns: DataFrame, edits: bool) -> DataFrame:
    """Read each conversation's rows in order; a conversation may go over many batches."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in (EDITS if edits else SUMMARY).split(", ")]
        at: _Conversation | None = None

        def frame(rows: list) -> pd.DataFrame:
            columns = dict(zip(names, zip(*rows)))
            return pd.DataFrame({c: pd.array(list(v), dtype="Int64") if c in ("conv_id", "row") else list(v) for c, v in columns.items()})

        for pdf in batches:
            out: list = []
            kept = (pdf[c].tolist() for c in ("has_conv_id", "conv_id", "has_turn", "turn", "role", "text", "gone", "fault"))
            for has_id, conv_id, has_turn, turn, role, text, gone, fault in zip(*kept):
                conv_id = conv_id if has_id else None
                if at is None or conv_id != at.conv_id:
                    if at is not None:
                        last = at.summary()
                        out.extend(at.rows if edits else [last])
                    at = _Conversation(conv_id, edits)
                if not gone:
                    at.add(turn if has_turn else None, role, text, fault)
            if edits and at is not None:  # what is final leaves at once
                out.extend(at.rows)
                at.rows = []
            if out:
                yield frame(out)
        if at is not None:
            last = at.summary()
            if out := at.rows if edits else [last]:
                yield frame(out)

    dealt = turns.repartition("has_conv_id", "conv_id").sortWithinPartitions(*ORDER)
    return dealt.mapInPandas(fold, EDITS if edits else SUMMARY)


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. conversations: conv_id, turn, role, text, gone."""
    return _fold(faulty(conversations), False)


def edits(conversations: DataFrame) -> DataFrame:
    """One row per edit: conv_id, step, edit, role (of R and I), row (place in the conversation of the row that it keeps, reroles or deletes).

    Rows leave the task as soon as they are final; texts are reached by conv_id and row, see `repaired`.
    """
    return _fold(faulty(conversations), True)


def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired turns themselves: conv_id, step, role, text, turn (null for inserted ones)."""
    rows = conversations.where("not gone").select(F.col("conv_id").cast("string").alias("conv"), *_whole("turn"), "role", "text", F.monotonically_increasing_id().alias("line"))
    placed = prefix_sums(rows, ["has_turn", "turn", "role", "text", "line"], None, group="conv", rank="row").withColumnRenamed("role", "was")
    made = edits(conversations).where("edit <> 'D'").alias("e")
    named = F.when(F.col("e.role") == "u", "user").when(F.col("e.role") == "a", "assistant").otherwise(F.col("p.was"))
    return made.join(placed.alias("p"), F.expr("cast(e.conv_id as string) <=> p.conv and e.row = p.row"), "left").select(
        "e.conv_id", "e.step", named.alias("role"), F.coalesce("p.text", F.lit("")).alias("text"), F.when(F.col("p.has_turn"), F.col("p.turn")).alias("turn")
    )
