"""Repair of conversation structure by iterative-deepening A*.

A conversation is sound if the initials of its roles spell (s?(ua)+)?: an optional system turn, then user
and assistant in turn. Turns are kept (K, no cost), given the role that is due (R, 2), deleted (D, 3), or
empty turns of the role that is due are inserted (I, 2); a turn that breaks off costs 1 unless deleted.
The cheapest edits are searched depth first, in ASCII order of their letters, under a rising bound on the
cost, so the first path that ends is the cheapest and, of these, the ASCII-least. States that failed are
kept in a table with the cost that is known to be needed from there.

Turns are dealt to tasks by ranges of (conversation, turn), so that no conversation needs to fit into one
task. Conversations that lie whole within a task and are of at most BLOCK_TURNS turns are searched there.
Others are searched block by block, from every state of the grammar to every other, and the blocks' costs
are then added up along the conversation.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import materialize, named, text_batches, tidy

#: Turns, and bytes of text, of a block at most; a single longer turn is a block by itself.
BLOCK_TURNS = 256
BLOCK_BYTES = 4 << 20

_SPACE = " \t\n\x0b\x0c\r"
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_AFTER = {"s": {_START: _SYSTEM}, "u": {_START: _USER, _SYSTEM: _USER, _ASSISTANT: _USER}, "a": {_USER: _ASSISTANT}}
#: The state that the turn due in a state leads to, that turn's role, and the inserts that end a conversation.
_DUE = (_USER, _USER, _ASSISTANT, _USER)
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
_TAIL = (0, 2, 1, 0)
_INSERT, _REROLE, _DELETE, _BROKEN = 2, 2, 3, 1


def is_blank(text: str) -> bool:
    return not text.strip(_SPACE)


def breaks_off(text: str) -> bool:
    return text.rstrip(_SPACE)[-1:] not in (".", "!", "?")


@dataclass(frozen=True)
class Turn:
    """What the search needs of a turn: the initial of its role, whether it has to go, whether it breaks off."""

    initial: str
    must_go: bool
    broken: bool


def lower_bounds(turns: list[Turn], goal: int | None) -> list[list[float]]:
    """For each place and state, a cost that no path from there to the goal can be below.

    Turns that must go cost 3, broken ones 1. Of the others, one of no use costs at least 2 (a new role,
    or its deletion), and every two neighbours of equal initials need an edit of one of them, or between
    them; one edit serves two such pairs at most, both of one run. A run may begin with what the state
    stands for and end with what the goal asks for. A system turn is of use only in front.
    """
    n = len(turns)
    if goal in (_START, _SYSTEM):  # all is deleted, but for a system turn
        out = [[math.inf] * 4 for _ in range(n + 1)]
        kept, left = math.inf, 0
        for i in range(n, -1, -1):
            if i < n:
                kept, left = kept + _DELETE, left + _DELETE
                if turns[i].initial == "s" and not turns[i].must_go:
                    kept = min(kept, left - _DELETE + _BROKEN * turns[i].broken)
            out[i][goal] = left
            if goal == _SYSTEM:
                out[i][_START] = kept
        return out
    # the run in front of what is left: its initial and length, and what all behind it costs
    letter, length, behind, fixed, system = ("a" if goal == _USER else "u"), 1, 0, 0, 0
    ends = [math.inf] * 4
    if goal is None:
        ends = [_INSERT * inserts for inserts in _TAIL]
    else:
        ends[goal] = 0
    out = [ends]
    for turn in reversed(turns):
        if turn.must_go:
            fixed += _DELETE
        else:
            fixed += _BROKEN * turn.broken
            if turn.initial == letter:
                length += 1
            else:
                behind += 2 * (length // 2)
                letter, length = turn.initial, 1
                if letter not in ("u", "a"):  # a run of none, closed at once
                    letter, length, behind, system = "", 0, behind + 2, system + (turn.initial == "s")
        front = lambda last: 2 * ((length + (letter == last)) // 2)
        rest = fixed + behind
        start = rest + front("a") - 2 if system else rest + front("a")
        out.append([max(0, start), rest + front("a"), rest + front("u"), rest + front("a")])
    out.reverse()
    return out


def cheapest(turns: list[Turn], state: int = _START, goal: int | None = None) -> tuple[int, str] | None:
    """Cost and letters of the cheapest edits, the ASCII-least of them; None where none lead to the goal.

    goal None: a sound conversation. Otherwise the state to be in behind the last turn; edits then end with
    that turn, as inserts behind it belong in front of the next one.
    """
    n = len(turns)
    needed = lower_bounds(turns, goal)  # raised wherever a search fails: the table of failed states
    path: list[str] = []

    def edits(i: int, q: int):
        """Letters, cost and next state, in ASCII order. An insert goes with the turn behind it: a deletion
        would come first, and two inserts in a row are of no use except at the end."""
        turn = turns[i]
        yield "D", _DELETE, q
        if turn.must_go:
            return
        due, broken = _DUE[q], _BROKEN * turn.broken
        if (kept := _AFTER.get(turn.initial, {}).get(due)) is not None:
            yield "IK", _INSERT + broken, kept
        yield "IR", _INSERT + _REROLE + broken, _DUE[due]
        if (kept := _AFTER.get(turn.initial, {}).get(q)) is not None:
            yield "K", broken, kept
        yield "R", _REROLE + broken, due

    def found(i: int, q: int, budget: float) -> bool:
        if i == n:
            path.append("I" * _TAIL[q] if goal is None else "")
            return True
        least = math.inf
        for letters, cost, after in edits(i, q):
            need = cost + needed[i + 1][after]
            if need <= budget:
                path.append(letters)
                if found(i + 1, after, budget - cost):
                    return True
                path.pop()
                need = cost + needed[i + 1][after]  # raised by the search that failed
            least = min(least, need)
        needed[i][q] = max(needed[i][q], least)
        return False

    while (bound := needed[0][state]) < math.inf:
        if found(0, state, bound):
            return int(bound), "".join(path)
    return None


def apply_edits(audit: str, roles: list[str], texts: list[str], state: int = _START) -> tuple[list[tuple[str, str]], int]:
    """The turns (role, text) that the edits leave, and the state behind them."""
    out, i = [], 0
    for edit in audit:
        if edit == "K":
            out.append((roles[i], texts[i]))
            state = _AFTER[roles[i][:1]][state]
        elif edit in "IR":
            state = _DUE[state]
            out.append((_ROLE[state], texts[i] if edit == "R" else ""))
        i += edit != "I"
    return out, state


def _faults(roles: list[str], texts: list[str], repeated: set[int]) -> tuple[list[Turn], dict[str, int]]:
    """The turns for the search, and the numbers of turns by their first fault."""
    turns, counts = [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for i, (role, text) in enumerate(zip(roles, texts)):
        fault = "blank" if is_blank(text) else "duplicate" if i in repeated else "truncated" if breaks_off(text) else None
        if fault:
            counts[fault] += 1
        turns.append(Turn(role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    return turns, counts


def _repeated(roles: list[str], texts: list[str]) -> set[int]:
    seen: set[tuple[str, str]] = set()
    return {i for i, turn in enumerate(zip(roles, texts)) if turn in seen or seen.add(turn)}


_BLOCK = "conv_id long, part int, seq int, whole boolean, turns array<long>, roles array<string>, texts array<string>"
_STATS = "blank long, duplicate long, truncated long"
_EDITED = f"{_BLOCK}, {_STATS}, state int, cost long, audit string"
_REPORT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
_TURNS = "conv_id long, part int, seq int, place int, role string, text string"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    kinds |= {f"array<{k}>": pa.list_(v) for k, v in list(kinds.items())}
    return pa.schema([(name, kinds[kind]) for name, kind in (column.split() for column in ddl.split(", "))])


def _batches(rows: Iterator[dict], ddl: str, size: int = 256) -> Iterator[pa.RecordBatch]:
    schema, held = _schema(ddl), []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _in_tasks(rows_of, ddl: str):
    """A function of row dicts as one of Arrow batches."""
    return tidy(lambda batches: _batches(rows_of(row for batch in batches for row in batch.to_pylist()), ddl))


def _blocks(turns_at_most: int, bytes_at_most: int):
    """Sorted turns to blocks of neighbours of one conversation; whole if the conversation surely ends there."""

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        part, seq = TaskContext.get().partitionId(), 0
        block, weight, whole = None, 0, False  # the first conversation of a task may have begun in another

        def closed(whole: bool) -> dict:
            return block | {"part": part, "seq": seq, "whole": whole}

        for row in rows:
            other = block is None or row["conv_id"] != block["conv_id"]
            size = len(row["text"]) + len(row["role"])
            if other or len(block["turns"]) >= turns_at_most or (block["turns"] and weight + size > bytes_at_most):
                if block is not None:
                    yield closed(whole and other)
                    whole, seq = other, seq + 1
                block, weight = {"conv_id": row["conv_id"], "turns": [], "roles": [], "texts": []}, 0
            if not row["gone"]:
                weight += size
                for name in ("turn", "role", "text"):
                    block[f"{name}s"].append(row[name])
        if block is not None:
            yield closed(False)

    return run


def _solved_whole(rows: Iterator[dict]) -> Iterator[dict]:
    for row in rows:
        turns, counts = _faults(row["roles"], row["texts"], _repeated(row["roles"], row["texts"]))
        cost, audit = cheapest(turns)
        yield row | counts | {"state": _START, "cost": cost, "audit": audit}


def _solved_block(rows: Iterator[dict]) -> Iterator[dict]:
    """Costs and letters from each state to each, the latter with their rank among those from the same state."""
    for row in rows:
        turns, counts = _faults(row["roles"], row["texts"], set(row.pop("repeated") or ()))
        costs, audits, ranks = [-1] * 16, [None] * 16, [-1] * 16
        for state in range(4):
            for goal in range(4):
                if (best := cheapest(turns, state, goal)) is not None:
                    costs[4 * state + goal], audits[4 * state + goal] = best
            order = sorted(a for a in audits[4 * state : 4 * state + 4] if a is not None)
            ranks[4 * state : 4 * state + 4] = [-1 if a is None else order.index(a) for a in audits[4 * state : 4 * state + 4]]
        yield row | counts | {"costs": costs, "audits": audits, "ranks": ranks}


def _chosen(rows: Iterator[dict]) -> Iterator[dict]:
    """The states between which each block of a conversation is passed on the cheapest way, the ASCII-least of these.

    Letters of one block from one state end with its last turn, so none is the beginning of another, and
    the first block in which two ways differ tells which comes first.
    """
    for row in rows:
        blocks = row["blocks"]
        best: list[float] = [_INSERT * inserts for inserts in _TAIL]
        steps: list[list[int]] = []
        for block in reversed(blocks):
            step, after = [0] * 4, [math.inf] * 4
            for state in range(4):
                ways = [
                    (cost + best[goal], block["ranks"][4 * state + goal], goal)
                    for goal in range(4) if (cost := block["costs"][4 * state + goal]) >= 0
                ]
                if ways:
                    after[state], _, step[state] = min(ways)
            best = after
            steps.append(step)
        state = _START
        for i, (block, step) in enumerate(zip(blocks, reversed(steps))):
            inserts = _TAIL[step[state]] if i == len(blocks) - 1 else 0
            yield {"part": block["part"], "seq": block["seq"], "state": state, "goal": step[state], "inserts": inserts}
            state = step[state]


def _reported(rows: Iterator[dict]) -> Iterator[dict]:
    """A row a conversation from its blocks in order; texts pass through the digest and are let go."""
    conv, total = None, None

    def finished() -> dict:
        gaps = total["last_turn"] - total["first_turn"] + 1 - total["n_turns"] if total["n_turns"] else 0
        return {k: total[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")} | {
            "conv_id": conv, "gaps": gaps, "audit": "".join(total["audit"]), "repaired_sha256": total["digest"].hexdigest()}

    for row in rows:
        if total is None or row["conv_id"] != conv:
            if total is not None:
                yield finished()
            conv = row["conv_id"]
            total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "n_turns"), 0)
            total |= {"first_turn": None, "last_turn": None, "initial": None, "audit": [], "digest": hashlib.sha256(), "begun": False}
        for name in ("blank", "duplicate", "truncated", "cost"):
            total[name] += row[name]
        for turn in row["turns"]:
            if turn is not None and turn != total["last_turn"]:
                total["first_turn"] = turn if total["first_turn"] is None else total["first_turn"]
                total["last_turn"], total["n_turns"] = turn, total["n_turns"] + 1
        for role in row["roles"]:
            if total["initial"] is not None:
                total["illegal"] += total["initial"] + role[:1] not in ("su", "ua", "au")
            total["initial"] = role[:1]
        total["audit"].append(row["audit"])
        for role, text in apply_edits(row["audit"], row["roles"], row["texts"], row["state"])[0]:
            total["digest"].update((("\n" if total["begun"] else "") + f"{role}:{text}").encode())
            total["begun"] = True
    if total is not None:
        yield finished()


def _repaired(rows: Iterator[dict]) -> Iterator[dict]:
    for row in rows:
        for place, (role, text) in enumerate(apply_edits(row["audit"], row["roles"], row["texts"], row["state"])[0]):
            yield {"conv_id": row["conv_id"], "part": row["part"], "seq": row["seq"], "place": place, "role": role, "text": text}


@dataclass(frozen=True)
class Repair:
    """The edited blocks of all conversations, and what follows from them."""

    whole: DataFrame
    split: DataFrame

    def turns(self) -> DataFrame:
        """conv_id, part, seq, place, role and text of every repaired turn; a conversation's order is (part, seq, place)."""
        return self.whole.unionByName(self.split).mapInArrow(_in_tasks(_repaired, _TURNS), _TURNS)

    def report(self) -> DataFrame:
        """A row a conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

        The digest runs over role:text of the repaired turns, joined by newlines. It is a sequence by its
        nature, so the blocks of a split conversation pass one task in order, a block at a time.
        """
        ordered = self.split.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
        return self.whole.mapInArrow(_in_tasks(_reported, _REPORT), _REPORT).unionByName(ordered.mapInArrow(_in_tasks(_reported, _REPORT), _REPORT))


def repair_conversations(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None,
    block_turns: int = BLOCK_TURNS, block_bytes: int = BLOCK_BYTES,
) -> Repair:
    """The cheapest edits that make every conversation sound, and the faults of its turns.

    Turns go by turn, null first; those of one turn by role, then the first 64 characters of the text, then
    a hash of it. Nulls in role and text are one space. A turn is blank without a character other than
    ASCII white space, else a duplicate if an earlier one has its role and text, else truncated if its last
    such character is none of . ! ? Blank and duplicate turns are deleted. Rows with a true `gone` column are
    no turns, but their conversation is reported. A null conv_id is a conversation of its own. Repeated
    rows are turns of their own, so all but the first are duplicates. No rows give no rows; other columns
    are ignored. An empty conversation costs nothing.

    A conversation of any length passes: what a task holds of it at a time is a block. Only its row of the
    report, whose audit has a letter a turn, and some 200 bytes a block are ever in one place.
    """
    text_batches(rows.sparkSession)
    absent = F.coalesce(named(gone), F.lit(False)) if gone else F.lit(False)
    chosen = rows.select(
        named(conv_id).cast("long").alias("conv_id"), named(turn).cast("long").alias("turn"), F.coalesce(named(role), F.lit(" ")).alias("role"),
        F.coalesce(named(text), F.lit(" ")).alias("text"), absent.alias("gone"),
    ).withColumns({"front": F.substring("text", 1, 64), "hash": F.xxhash64("text"), "salt": F.spark_partition_id()})
    keys = ["conv_id", "turn", "role", "front", "hash", "salt"]  # by the salt, equal rows may be dealt to several tasks
    ordered = chosen.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "turn", "role", "text", "gone")
    blocks = materialize(ordered.mapInArrow(_in_tasks(_blocks(block_turns, block_bytes), _BLOCK), _BLOCK), "turn-blocks")
    whole = blocks.where("whole").mapInArrow(_in_tasks(_solved_whole, _EDITED), _EDITED)

    split = blocks.where("not whole")
    digest = F.sha2(F.concat_ws(":", F.length("e.roles").cast("string"), "e.roles", "e.texts"), 256)
    each = split.select("conv_id", "part", "seq", F.posexplode(F.arrays_zip("roles", "texts")).alias("pos", "e"))
    each = each.select("conv_id", F.struct("part", "seq", "pos").alias("at"), digest.alias("digest"))
    firsts = each.groupBy("conv_id", "digest").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first")
    later = each.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))).where(F.col("at") != F.col("first"))
    repeated = later.groupBy("at.part", "at.seq").agg(F.collect_list("at.pos").alias("repeated"))  # of one block
    ways = f"{_BLOCK}, {_STATS}, costs array<int>, audits array<string>, ranks array<int>"
    solved = split.join(repeated, ["part", "seq"], "left").select(*split.columns, "repeated").mapInArrow(_in_tasks(_solved_block, ways), ways)
    solved = materialize(solved, "solved-blocks")
    summary = F.sort_array(F.collect_list(F.struct("part", "seq", "costs", "ranks"))).alias("blocks")
    steps = "part int, seq int, state int, goal int, inserts int"
    chosen = solved.groupBy("conv_id").agg(summary).select("blocks").mapInArrow(_in_tasks(_chosen, steps), steps)
    way = F.lit(4) * F.col("state") + F.col("goal")
    edited = solved.join(chosen, ["part", "seq"]).select(
        *blocks.columns, "blank", "duplicate", "truncated", "state",
        (F.get("costs", way) + F.lit(_INSERT) * F.col("inserts")).cast("long").alias("cost"),
        F.concat(F.get("audits", way), F.repeat(F.lit("I"), F.col("inserts"))).alias("audit"),
    )
    return Repair(whole, edited)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults planted by crc32('conv_id:turn') % 20; nulls are one space.

    0: the turn is gone; 1: its text is empty; 2: its text loses . ! ?; 3: it comes twice; 4: its role is user.
    conv_id, turn, role, text and gone.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), times.alias("copy"))
