import hashlib
import random
import re
import zlib
from itertools import product

from jobmarket.llm import conversation
from jobmarket.llm.registry import op11_survivor_coalescence

ROWS = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Every string of edits of one conversation, rows (role, text, fault): the cheapest, ties by initials; (cost, audit, repaired turns)."""
    best = None
    options = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for _, _, f in rows]
    gaps = ["", "u", "a", "ua", "au"]
    for inserts in product(gaps, repeat=len(rows) + 1):
        if sum(map(len, inserts)) > len(rows) + 2:
            continue
        for chosen in product(*options):
            out, audit, cost = [], "", 0
            for n in range(len(rows) + 1):
                for r in inserts[n]:
                    out.append(("user" if r == "u" else "assistant", ""))
                    audit, cost = audit + "I", cost + 2
                if n == len(rows):
                    break
                role, text, fault = rows[n]
                audit += chosen[n][0]
                if chosen[n] == "D":
                    cost += 3
                else:
                    cost += (fault == "truncated") + (2 if chosen[n] != "K" else 0)
                    out.append((role if chosen[n] == "K" else {"Ru": "user", "Ra": "assistant"}[chosen[n]], text))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
    return best


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def fold(rows):
    edits = []
    r = conversation.Repair(lambda e, _: edits.append(e))
    for row in rows:
        r.add(*row)
    cost, digest = r.finish()
    return cost, "".join(edits), digest


def test_fold_equals_every_string_of_edits():
    rng = random.Random(5)
    for n in range(120):
        rows = faults([(rng.choice(["system", "user", "user", "assistant", "tool", ""]), rng.choice(["A.", "B", "c!", " ", "D?"])) for _ in range(n % 4)])
        cost, audit, out = brute(rows)
        assert fold(rows) == (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()), rows


def plain(rows):
    """Viterbi over whole strings, no tree."""
    at = {0: (0, "")}

    def insert(at):
        for _ in range(2):
            for p, (c, a) in list(at.items()):
                q = conversation.MOVES[p, conversation.NEXT[p]]
                at[q] = min(at.get(q, (c + 2, a + "I")), (c + 2, a + "I"))
        return at

    at = insert(at)
    for role, _, fault in rows:
        new = {}
        for p, (c, a) in at.items():
            ways = [(p, c + 3, "D")]
            if fault not in ("blank", "duplicate"):
                c += fault == "truncated"
                ways += [(conversation.MOVES[p, conversation.NEXT[p]], c + 2, "R")]
                if (p, role[:1]) in conversation.MOVES:
                    ways.append((conversation.MOVES[p, role[:1]], c, "K"))
            for q, cost, e in ways:
                new[q] = min(new.get(q, (cost, a + e)), (cost, a + e))
        at = insert(new)
    return min(at[s] for s in conversation.FINAL if s in at)


def test_long_ties_equal_whole_strings():
    rng = random.Random(6)
    for n in range(60):
        roles = ["user"] if n % 3 == 0 else ["user", "assistant", "system"]
        rows = [(rng.choice(roles), "x.", rng.choice(["", "", "truncated", "blank", "duplicate"])) for _ in range(40 + n)]
        assert fold(rows)[:2] == plain(rows)


def test_final_edits_leave_the_tree():
    left, most = [], 0
    r = conversation.Repair(lambda e, _: left.append(e))
    for n in range(20_000):
        r.add("user" if n % 2 == 0 else "assistant", f"{n}.", "blank" if n % 7 == 0 else "truncated" if n % 5 == 0 else "")
        most = max(most, n + 1 - sum(e != "I" for e in left))
    assert most < 40


def damage(rows):
    out = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k:
            row = (c, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            out += [row, row] if k == 3 else [row]
    return out


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["system", "user", "assistant", "assistant", None]), rng.choice(["Hi.", "Yes!", "cut off", "", None, "So? \n", "ö."])) for c in [*range(60), None] for t in [None, *range(rng.randrange(4))]]
    rows += [(5, 1, "user", "Hi."), (5, 1, "user", "Hi."), (900, 1, "user", "long " * 100_000), (2**60 + 1, 2**59 + 3, "user", "Hi."), (2**60 + 1, 2**59 + 4, "assistant", "So!"), (2**60 + 2, None, "user", "Hi.")]
    spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS + ", cost string, line int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r.asDict() for r in op11_survivor_coalescence(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    hurt = damage(rows)
    for c in got:
        mine = sorted((r for r in hurt if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        marked = faults([r[2:] for r in mine])
        turns = {r[1] for r in mine if r[1] is not None}
        cost, audit, out = (*plain(marked), None)
        want = {
            "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **{k: sum(f == k for *_, f in marked) for k in ("blank", "duplicate", "truncated")},
            "illegal": sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:])), "cost": cost, "audit": audit,
        }
        assert {k: got[c][k] for k in want} == want, mine
        if len(mine) <= 3:
            assert got[c]["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in brute(marked)[2]).encode()).hexdigest()
    empty = spark.createDataFrame([], ROWS)
    assert conversation.repair(conversation.damaged(empty)).collect() == []


def test_repaired_turns_hash_to_the_summary(spark):
    rng = random.Random(8)
    rows = spark.createDataFrame([(c, t, rng.choice(["system", "user", "assistant"]), rng.choice(["Hi.", "Yes!", "cut off", "", f"{t}?"])) for c in range(40) for t in range(12)], ROWS)
    hurt = conversation.damaged(rows)
    turns = {}
    for r in conversation.repaired(hurt).collect():
        turns.setdefault(r["conv_id"], []).append((r["step"], f"{r['role']}:{r['text']}"))
    for r in conversation.repair(hurt).collect():
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(t for _, t in sorted(turns.get(r["conv_id"], []))).encode()).hexdigest()


def test_one_conversation_holds_a_third_of_the_rows(spark):
    rows = spark.range(60_000).selectExpr("if(id < 20000, 1, id) AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('turn ', id % 5000, '.') AS text", "false AS gone")
    out = {r["conv_id"]: r for r in conversation.repair(rows).where("conv_id = 1 or conv_id > 59990").collect()}
    assert out[1]["duplicate"] == 15_000 and out[1]["audit"] == "K" * 5000 + "D" * 15_000 and out[59_999]["cost"] == 2
