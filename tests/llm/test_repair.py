import hashlib
import random
import zlib
from functools import cache

import pytest
from llm_helpers import prose

from watchspan.llm import repair

SPACE = " \t\n\x0b\f\r"


def damaged(rows):
    """Each row as the contract damages it, one by one."""
    out = []
    for conv_id, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        out += [(conv_id, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain(conv_id, rows):
    rows = sorted((r[1:] for r in rows if r[0] == conv_id), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [t for t, _, _ in rows if t is not None]
    faults, seen = [], set()
    for _, role, text in rows:
        solid = text.strip(SPACE)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))

    accept = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    new = {0: "user", 1: "user", 2: "assistant", 3: "user"}

    @cache
    def best(i, state, made):
        ways = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        if made < 3:
            cost, letters, lines = best(i, accept[state][new[state][0]], made + 1)
            ways.append((cost + 2, "I" + letters, (f"{new[state]}:", *lines)))
        if i < len(rows):
            _, role, text = rows[i]
            extra = faults[i] == "truncated"
            cost, letters, lines = best(i + 1, state, 0)
            ways.append((cost + 3, "D" + letters, lines))
            if faults[i] in ("", "truncated"):
                if role[:1] in accept[state]:
                    cost, letters, lines = best(i + 1, accept[state][role[:1]], 0)
                    ways.append((cost + extra, "K" + letters, (f"{role}:{text}", *lines)))
                cost, letters, lines = best(i + 1, accept[state][new[state][0]], 0)
                ways.append((cost + 2 + extra, "R" + letters, (f"{new[state]}:{text}", *lines)))
        return min(ways, key=lambda w: w[:2]) if ways else (10**9, "", ())

    cost, audit, lines = best(0, 0, 0)
    count = lambda fault: sum(f == fault for f in faults)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (conv_id, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest()), list(lines)


def conversation(rng, conv_id, length, roles=("system", "user", "assistant", "tool", None, "")):
    rows = []
    for k in range(length):
        text = rng.choice(["Yes.", "ok", "", " \t", None, "What?", prose(rng.randrange(10**6), 4) + rng.choice(".x! ")])
        rows.append((conv_id, rng.choice([k, k, k, k + 3, None]), rng.choice(roles), text))
    return rows


def corpus():
    rng, rows = random.Random(5), []
    for conv_id in range(150):
        rows += conversation(rng, conv_id, rng.randrange(1, 9), rng.choice([("user", "assistant"), ("system", "user", "assistant"), ("system", "user", "assistant", "tool", None, "")]))
    rows += [(500, k, "assistant" if k % 2 else "user", f"{k} done.") for k in range(120)]
    rows += [(501, k, "user", f"{k} and") for k in range(90)]
    rows += [(502, k, "tool", f"{k} and") for k in range(90)]
    rows += [(503, k, "user", "same text.") for k in range(100)]
    rows += [(504, 7, "user", "same row.")] * 80
    rows += conversation(rng, None, 40) + conversation(rng, 505, 120)
    rows += [(506, 0, "user", "é" * 50_000 + "."), (507, None, None, None), (508, None, "assistant", "x")]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", part int, audit string")


def test_query_equals_a_plain_walk(spark, tmp_path):
    rows = corpus()
    frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = repair.op13_conversation_repair(spark, str(tmp_path)).collect()
    after = damaged(rows)
    expected = [plain(c, after)[0] for c in {r[0] for r in rows}]
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    assert {"D", "I", "K", "R"} <= set("".join(r.audit for r in got))


@pytest.mark.parametrize("parts, passes", [(1, 3), (17, 3), (40, 1), (40, 0)])
def test_pieces_and_passes_do_not_change_the_result(spark, monkeypatch, parts, passes):
    monkeypatch.setattr(repair, "PASSES", passes)
    monkeypatch.setattr(repair, "CHUNK", 7)
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in corpus()]
    given = frame(spark, rows).select("conv_id", "turn", "role", "text").selectExpr("*", "1L as n")
    got = repair.repair(given, parts).collect()
    totals = {r.conv_id: r for r in got if r.repaired_sha256 is not None}
    for conv_id in {r[0] for r in rows}:
        expected, lines = plain(conv_id, rows)
        t = totals.pop(conv_id)
        assert (conv_id, t.gaps, t.blank, t.duplicate, t.truncated, t.illegal, t.cost, t.audit, t.repaired_sha256) == expected
        turns = sorted((r.position, r.role, r.text) for r in got if r.conv_id == conv_id and r.repaired_sha256 is None)
        assert [f"{r}:{x}" for _, r, x in turns] == lines
    assert not totals


def test_fix_up_passes_end_where_vectors_agree(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"{k} done.") for k in range(400)]
    cut = repair.keep(repair.pieces(repair.counted(frame(spark, rows).selectExpr("conv_id", "turn", "role", "text", "1L as n")), 20))
    plan, passes = repair.settled(cut)
    assert 10 < len(plan) <= 20 and passes == 1
    steps, codes = repair.Steps(), bytes([1, 2] * 500)
    rows_looked_at, _ = steps.rerun(codes, steps.number(repair.GUESS)[0], steps.number(repair.END)[0])
    assert rows_looked_at < 5
    assert steps.rerun(bytes([3] * 500), steps.number(repair.GUESS)[0], steps.number(repair.END)[0]) is None


def test_nothing_gives_nothing(spark):
    assert repair.repair(spark.createDataFrame([], SCHEMA + ", n long")).count() == 0
