"""Conversation repair against an exhaustive search and a plain version of the whole query."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm.turn_repair import Turn, apply_edits, cheapest, damaged, lower_bounds, repair_conversations

SCHEMA = "conv_id long, turn long, role string, text string, part string, seq string, gone string, whole int, cost int, audit int, pos int, digest int"
SOUND = re.compile("(s?(ua)+)?")


def all_edits(i, out, turns):
    """Every edit at a place: letter, cost, next place, next output."""
    if i < len(turns):
        t = turns[i]
        yield "D", 3, i + 1, out
        if not t.must_go:
            yield "K", int(t.broken), i + 1, out + (t.initial or "?")
            for role in "ua":
                yield "R", 2 + t.broken, i + 1, out + role
    for role in "ua":
        yield "I", 2, i, out + role


def exhaustive(turns):
    """Cheapest first, then least letters; only outputs that can still become sound go on."""
    waiting, seen = [(0, "", 0, "")], set()
    while waiting:
        cost, audit, i, out = heapq.heappop(waiting)
        if i == len(turns) and SOUND.fullmatch(out):
            return cost, audit
        if (audit, out) in seen:
            continue
        seen.add((audit, out))
        for letter, more, after, now in all_edits(i, out, turns):
            if re.fullmatch("s?((ua)*u?)", now) and cost + more <= 3 * len(turns):
                heapq.heappush(waiting, (cost + more, audit + letter, after, now))


def table(turns):
    """The same by a table from the back, for long conversations."""
    accepts = {0: (0, ""), 1: (4, "II"), 2: (2, "I"), 3: (0, "")}
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = accepts
    for t in reversed(turns):
        now = {}
        for q in range(4):
            ways = [(best[q][0] + 3, "D" + best[q][1])]
            if not t.must_go:
                ways += [(best[n][0] + t.broken, "K" + best[n][1]) for (p, c), n in step.items() if p == q and c == t.initial]
                ways += [(best[n][0] + 2 + t.broken, "R" + best[n][1]) for (p, c), n in step.items() if p == q and c in "ua"]
            now[q] = min(ways)
        for _ in range(2):  # inserts
            for (p, c), n in step.items():
                if c in "ua":
                    now[p] = min(now[p], (now[n][0] + 2, "I" + now[n][1]))
        best = now
    return best[0]


TURNS = st.lists(st.builds(Turn, st.sampled_from(["s", "u", "a", "x", ""]), st.sampled_from([False, False, True]), st.booleans()), max_size=6)


@given(TURNS)
@settings(max_examples=250, deadline=None)
def test_search_equals_trying_everything(turns):
    assert cheapest(turns) == exhaustive(turns) == table(turns)


@given(st.lists(st.builds(Turn, st.sampled_from("suax"), st.sampled_from([False, False, True]), st.booleans()), max_size=60))
@settings(max_examples=250, deadline=None)
def test_search_equals_a_table(turns):
    assert cheapest(turns) == table(turns)


@given(TURNS, st.integers(0, 3), st.sampled_from([None, 0, 1, 2, 3]))
@settings(max_examples=250, deadline=None)
def test_lower_bounds_are_below_every_search(turns, state, goal):
    bound, found = lower_bounds(turns, goal)[0][state], cheapest(turns, state, goal)
    assert found is None or bound <= found[0]


def test_hard_conversations_end():
    for letters in ("u" * 250, "a" * 250, "s" * 250, "x" * 250, "uuaas" * 50, "as" * 125):
        turns = [Turn(c, i % 7 == 0, i % 3 == 0) for i, c in enumerate(letters)]
        assert cheapest(turns) == table(turns)


def plain(rows, damage=True):
    """The whole report from rows (conv_id, turn, role, text)."""
    filled = lambda v: " " if v is None else str(v)
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        role, text = filled(role), filled(text)
        kind = zlib.crc32(f"{filled(conv)}:{filled(turn)}".encode()) % 20 if damage else 9
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        known = [t[0] for t in turns if t[0] is not None]
        seen, faults, marks = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in turns:
            body = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            marks.append(Turn(role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = table(marks)
        repaired, i, letters = [], 0, ""
        for edit in audit:
            if edit == "K":
                repaired.append(f"{turns[i][1]}:{turns[i][2]}")
                letters += turns[i][1][:1]
            elif edit in "IR":
                due = "assistant" if letters[-1:] == "u" else "user"
                repaired.append(f"{due}:{turns[i][2] if edit == 'R' else ''}")
                letters += due[0]
            i += edit != "I"
        assert SOUND.fullmatch(letters)
        initials = [t[1][:1] for t in turns]
        out[conv] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0, *faults.values(),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(repaired).encode()).hexdigest(),
        )
    return out


def report(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    assert len(rows) == len({r.conv_id for r in rows})
    return {r.conv_id: tuple(r)[1:] for r in rows}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", 1, 2, 3, 4, 5) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(11)
    say = lambda: rng.choice(["Yes.", "no", "", "  \n", "Really?!", "é so", "ok.", "ok. \t", f"line {rng.random()}.", "a ", None])
    rows = []
    for conv in range(80):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn + rng.randint(0, 1), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), say()))
    rows += [(500, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(700)]  # a hot conversation, many ranges
    rows += [(501, None, "user", "hot copies.")] * 300 + [(501, t, "assistant", "hot copies.") for t in range(200)]
    rows += [(None, t, "user", "of no conversation.") for t in range(12)] + [(None, None, None, None)] * 3
    rows += [(600, 1, "user", "long " * 200_000), (600, 2, "assistant", "long " * 200_000 + "."), (601, None, None, None)]
    rows += [(700 + i, i % 7, "user", "one.") for i in range(90)]  # of some of these nothing is left
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block_turns, block_bytes, parts", [(256, 4 << 20, "1"), (256, 1 << 16, "4"), (3, 100, "9"), (1, 1, "3")])
def test_report_equals_a_plain_version(spark, conversations, block_turns, block_bytes, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = repair_conversations(damaged(frame(spark, conversations).repartition(3)), gone="gone", block_turns=block_turns, block_bytes=block_bytes)
        got = report(found.report())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    expected = plain(conversations)
    assert got == expected
    empty = hashlib.sha256(b"").hexdigest()
    assert any(v == (0, 0, 0, 0, 0, 0, "", empty) for v in expected.values())


def test_undamaged_conversations_and_repaired_turns(spark, conversations):
    some = [r for r in conversations if r[0] is not None and r[0] < 80]
    found = repair_conversations(frame(spark, some), block_turns=2)
    assert report(found.report()) == plain(some, damage=False)
    turns = {}
    for r in found.turns().orderBy("conv_id", "part", "seq", "place").collect():
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, expected in plain(some, damage=False).items():
        assert hashlib.sha256("\n".join(turns.get(conv, [])).encode()).hexdigest() == expected[-1]


def test_no_rows(spark):
    assert report(repair_conversations(damaged(frame(spark, [])), gone="gone").report()) == {}


def test_edits():
    assert apply_edits("IKDR", ["assistant", "user", "tool"], ["x", "y", "z"]) == ([("user", ""), ("assistant", "x"), ("user", "z")], 2)


def test_registered_query(spark):
    import __spark_entry__ as contract

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert report(contract.queries()["op12_turn_repair"](spark, sf)) == plain(rows)
