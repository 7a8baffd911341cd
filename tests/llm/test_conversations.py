"""Conversation repair against a plain programme that keeps the cheapest, ASCII-least edits per state."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from inkveil.llm import conversations as C
from inkveil.llm.conversations import conversation_audit, damage, repaired_turns

SHOWN = re.compile("[^\x20\x09-\x0d]")
GOOD = re.compile(r"(s?(ua)+)?\Z")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def place(row):
    _, turn, role, text = row
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    return (turn is not None, turn or 0, md5(md5(role) + md5(text)))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        shown = SHOWN.findall(text)
        out.append("" if shown and (role, text) not in seen and shown[-1] in ".!?"
                   else "blank" if not shown else "duplicate" if (role, text) in seen else "truncated")
        seen.add((role, text))
    return out


def step(state, initial):
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, initial))


def repair(rows):
    """Forward over the rows: per state the least (cost, edits, repaired turns)."""
    best = {"": (0, "", ())}

    def take(into, state, item):
        if state is not None and (state not in into or item < into[state]):
            into[state] = item

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, kept) in list(best.items()):
                for role in ("user", "assistant"):
                    take(best, step(state, role[0]), (cost + 3, audit + "I", (*kept, f"{role}:")))
        return best

    for (_, _, role, text), fault in zip(rows, faults(rows), strict=True):
        nxt = {}
        for state, (cost, audit, kept) in inserted(best).items():
            take(nxt, state, (cost + 4, audit + "D", kept))
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 * (fault == "truncated")
            take(nxt, step(state, role[:1]), (cost + extra, audit + "K", (*kept, f"{role}:{text}")))
            for new in ("user", "assistant"):
                take(nxt, step(state, new[0]), (cost + extra + 3, audit + "R", (*kept, f"{new}:{text}")))
        best = nxt
    return min(item for state, item in inserted(best).items() if state in ("", "a"))


def brute(rows, ids):
    out = []
    for conv in ids:
        mine = sorted((r for r in rows if r[0] == conv), key=place)
        kinds = faults(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit, kept = repair(mine)
        assert GOOD.match("".join(k[0] for k in kept))
        sha = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((conv, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return sorted(out, key=repr)


def frame(spark, rows, conv="long"):
    df = spark.createDataFrame(rows, f"conv_id {conv}, turn long, role string, text string")
    for c in ("message", "code", "kind", "place", "c", "first", "row"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    return df.repartition(4)


def audited(spark, rows, with_damage=True, conv="long", block=C.BLOCK):
    df = frame(spark, rows, conv)
    got = conversation_audit(damage(df) if with_damage else df, df, block).collect()
    return sorted(map(tuple, got), key=repr)


def some_rows(rng, n_convs, longest, roles, texts):
    rows = []
    for conv in range(n_convs):
        for turn in range(rng.randint(1, longest)):
            turn = None if rng.random() < 0.05 else turn * rng.choice([1, 1, 2])
            rows.append((conv, turn, rng.choice(roles), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", "User", "a", None]
    texts = ["Hello.", "Yes!", "no end", "a b c?", " \t\x0b", "", None, "tail. \n", "é…", "x. "]
    rows = some_rows(rng, 60, 9, roles, texts)
    plain = some_rows(rng, 200, 6, ["user", "assistant", "system"], [f"t{k}{'.' * (k % 4 > 0)}" for k in range(40)])
    rows += [(c + 100, *r) for c, *r in plain]
    assert audited(spark, rows) == brute(damaged(rows), {r[0] for r in rows})


def test_conversations_over_many_blocks_and_partitions(spark):
    rng = random.Random(5)
    rows = [(9, t, rng.choice(["user", "assistant", "system"]), f"{rng.randint(0, 700)}{rng.choice(['.', ''])}") for t in range(1500)]
    rows += some_rows(rng, 20, 8, ["user", "assistant"], ["a.", "b.", "c"])
    rows += [(9, 1500, "user", "alike.")] * 400  # over the ends of ranges too
    assert audited(spark, rows, block=7) == brute(damaged(rows), {r[0] for r in rows})


def test_block_size_changes_nothing():
    rng = random.Random(1)
    kinds = [i | f for i in range(4) for f in (0, C.MUST_GO, C.CUT_SHORT, C.MUST_GO | C.REPEATED)]
    for _ in range(200):
        codes = bytes(rng.choices(kinds, k=rng.randint(1, 40)))

        def walk(size, codes=codes):
            blocks = [codes[k : k + size] for k in range(0, len(codes), size)]
            behind = [C.END]
            for b in reversed(blocks):
                behind.append(C.through(C.block_table(b), behind[-1]))
            state, out = 0, ""
            for b, v in zip(blocks, behind[-2::-1], strict=True):
                for edit, _, new in C.edits(b, v, state):
                    out += edit
                state = new
            return out + "".join(e for e, *_ in C.closing(state)), behind[-1][0]

        assert len({walk(size) for size in (1, 3, 8, 100)}) == 1


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "hi."), (1, 0, "user", "same."), (1, 0, "user", "same."),
            (1, 0, "user", "same."), (2, 5, "assistant", "x" * 300_000 + "."), (2, None, "user", "q?"), (3, 2, "system", "s.")]
    rows += [(c, 0, "user", "only.") for c in range(10, 60)]  # some lose all their rows
    got = audited(spark, rows)
    assert got == brute(damaged(rows), {r[0] for r in rows})
    assert any(r[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in got)
    assert audited(spark, rows, with_damage=False) == brute([(c, t, r or " ", x or " ") for c, t, r, x in rows], {r[0] for r in rows})
    assert audited(spark, []) == []
    names = [("a", 0, "user", "q."), ("b", 0, "user", "q."), ("a", 1, "assistant", "r.")]
    assert audited(spark, names, False, "string") == brute(names, {"a", "b"})


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "a."), (1, 1, "user", "b."), (1, 2, "user", "b."), (2, 0, "user", "c."), (2, 1, "tool", "d.")]
    got = sorted(map(tuple, repaired_turns(frame(spark, rows)).collect()))
    assert [g[2] for g in got if g[0] == 2] == ["K", "R"]
    for conv in (1, 2):
        mine = [g for g in got if g[0] == conv]
        cost, audit, kept = repair([r for r in rows if r[0] == conv])
        assert "".join(g[2] for g in mine) == audit
        assert [f"{g[3]}:{g[4]}" for g in mine if g[2] != "D"] == list(kept)
