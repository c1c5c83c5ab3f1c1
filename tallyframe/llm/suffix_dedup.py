"""Removal of repeated byte strings by a hash-compared suffix sort.

A string of `length` bytes that also starts earlier is removed. Every window of that length has an
anchor, the place inside it where a short gram has the least hash; equal windows have their anchors
at the same offset. So only anchors, one in some 35 bytes, are shuffled: by the hash of their gram,
with a hash of all bytes that the anchor's windows cover. Anchors that agree in both have equal
windows, and all but the earliest are covered. Where grams agree and surroundings differ, as at the
ends of a repeated passage, the surroundings are fetched and their suffixes sorted: those that start
at an anchor, and backwards those that end before it. Windows are equal where both agree far enough, so
what neighbours in the two orders share settles all windows of an anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import has_repeats, materialize, named, refuse_clash, text_batches, tidy, worker_state

LENGTH = 100
GRAM = 32
#: Bytes of text that one step of a task works on; longer texts are cut into overlapping parts.
CHUNK = 1 << 17
_PLACE = 22  # bits of a place in a chunk
#: Powers of the hashes' base that a worker keeps.
KEPT_POWERS = 1 << 18
#: Anchors held before equal ones are combined inside a task.
HELD = 400_000
#: Rows with one gram that are sorted in one task; more are compared window by window in a shuffle.
HOT_ROWS = 20_000
#: Document ids that may be broadcast to leave unaffected texts out of a join.
BROADCAST_DOCS = 500_000
_BASE = 0x9E3779B97F4A7C15
_NULL_ID = -(1 << 63)
_LETTERS = np.random.default_rng(42).integers(1, 1 << 63, 256, dtype=np.uint64)  # a fixed code for each byte
_FOUND = "h long, d long, t long, x int, a int, b int"
_NAMES = [part.split()[0] for part in _FOUND.split(", ")]
#: What a shuffled anchor has besides h, as bytes that sort like the numbers, as a column costs more than its bytes.
_REST = np.dtype([("c", ">u8"), ("d", ">u8"), ("t", ">u8"), ("x", ">u4"), ("a", ">u4"), ("b", ">u4"), ("covered", "u1")])
_SIGN = np.uint64(1 << 63)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, from the 0th to the nth."""
    one = np.ones(1, np.uint64)
    return tuple(np.cumprod(np.concatenate((one, np.full(n, base, np.uint64)))) for base in (_BASE, pow(_BASE, -1, 1 << 64)))


def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    kept = worker_state("powers")
    if KEPT_POWERS not in kept:
        kept[KEPT_POWERS] = _powers(KEPT_POWERS)
    return kept[KEPT_POWERS]


class PrefixHashes:
    """Polynomial hashes, modulo 2^64, of any part of a byte string, by differences of prefixes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        # powers of the base's inverse, so that a part's hash depends on its bytes alone
        powers, self.back = _kept_powers() if n <= KEPT_POWERS else _powers(n)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTERS[data] * powers[:n], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.back[start]


def _mixed(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = h ^ (h >> np.uint64(32))
        h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def chunk_anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Anchors of the windows of a chunk of texts that end at `ends`: h, c, x, a, b.

    x: place of the anchor, a: bytes between its first window's start and x, b: its windows less one.
    Windows whose least gram is the same one follow each other, so each anchor is one row.
    """
    n, grams = len(data), length - gram + 1
    none = np.empty(0, np.int64)
    if n < length:
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    hashes = PrefixHashes(data)
    full = _mixed((hashes.prefix[gram:] - hashes.prefix[:-gram]) * hashes.back[: n - gram + 1])
    low = np.uint64((1 << _PLACE) - 1)
    least = full & ~low
    least |= np.arange(n - gram + 1, dtype=np.uint64)
    span = 1
    while span * 2 <= grams:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    least = np.minimum(least[: len(least) - (grams - span)], least[grams - span :]) if grams > span else least
    anchor = (least & low).astype(np.int64)  # of the window that starts at each place
    last = np.repeat(ends, np.diff(ends, prepend=0))[: len(anchor)]  # the end of each place's text
    valid = np.flatnonzero(np.arange(length, length + len(anchor)) <= last)
    if not len(valid):
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    own = anchor[valid]
    head = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (valid[1:] != valid[:-1] + 1))))
    first = valid[head]
    b = np.diff(np.append(head, len(valid))) - 1
    x = own[head]
    around = hashes.of(first, first + b + length)
    c = _mixed(around + (x - first).astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + b.astype(np.uint64))
    return full[x], c, x, x - first, b


def _parts(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Chunks of (number of the text, place in it, bytes); parts of one text overlap by a window less a byte."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), CHUNK):
            part = text[at : at + CHUNK + length - 1]
            if held and size + len(part) > CHUNK:
                yield held
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield held


def _text_bytes(column: pa.Array) -> list[bytes]:
    return [v or b"" for v in column.to_pylist()]


def _rows(d, t, x, a, b, h=None) -> pa.RecordBatch:
    """Covered rows, or with h those that are open."""
    longs = [pa.array(np.asarray(v, np.int64)) for v in (d, t)]
    ints = [pa.array(np.asarray(v).astype(np.int64).astype(np.int32)) for v in (x, a, b)]
    return pa.RecordBatch.from_arrays([pa.nulls(len(d), pa.int64()) if h is None else pa.array(h), *longs, *ints], _NAMES)


def _binary(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    """A value up to each of the ends."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data)])


def _packed(covered: bool, h, c, d, t, x, a, b) -> pa.RecordBatch:
    rest = np.empty(len(d), _REST)
    for name, v in (("c", c), ("d", d.view(np.uint64) ^ _SIGN), ("t", t.view(np.uint64) ^ _SIGN), ("x", x), ("a", a), ("b", b), ("covered", covered)):
        rest[name] = v
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), _binary(np.arange(1, len(d) + 1) * _REST.itemsize, rest)], ["h", "rest"])


def _unpacked(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    column = batch.column(1).cast(pa.binary())
    rest = np.frombuffer(column.buffers()[2], _REST, len(column), np.frombuffer(column.buffers()[1], np.int32)[column.offset])
    table = {n: rest[n].astype(rest.dtype[n].newbyteorder("=")) for n in _REST.names}
    return table | {n: (table[n] ^ _SIGN).view(np.int64) for n in ("d", "t")} | {"h": batch.column(0).to_numpy()}


def _anchors(length: int, gram: int):
    """Rows (d, t, text) to packed anchors, marked as covered where the task has an equal one earlier."""

    def combined(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h, c, d, t, x, a, b = (np.concatenate(v) for v in zip(*held))
        order = np.argsort(h)
        near = np.flatnonzero(h[order[1:]] == h[order[:-1]])
        few = np.unique(np.concatenate((near, near + 1)))  # only where grams are equal the rest of the order counts
        some = order[few]
        order[few] = some[np.lexsort((x[some], t[some], d[some], c[some], h[some]))]
        h, c, d, t, x, a, b = (v[order] for v in (h, c, d, t, x, a, b))
        again = np.concatenate(([False], (h[1:] == h[:-1]) & (c[1:] == c[:-1])))
        keep = ~again
        for at in range(0, int(keep.sum()), 100_000):
            yield _packed(False, *(v[keep][at : at + 100_000] for v in (h, c, d, t, x, a, b)))
        if again.any():
            yield _packed(True, d[again], np.zeros(int(again.sum()), np.int64), *(v[again] for v in (d, t, x, a, b)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            d, t = (batch.column(i).to_numpy() for i in (0, 1))
            for part in _parts(_text_bytes(batch.column(2)), length):
                data = np.frombuffer(b"".join(p for _, _, p in part), np.uint8)
                ends = np.cumsum([len(p) for _, _, p in part])
                h, c, x, a, b = chunk_anchors(data, ends, length, gram)
                which = np.searchsorted(ends, x, side="right")
                number = np.array([i for i, _, _ in part])[which]
                shift = np.array([at for _, at, _ in part])[which] - (ends - np.array([len(p) for _, _, p in part]))[which]
                held.append((h, c, d[number], t[number], x + shift, a, b))
                count += len(h)
                if count > HELD:
                    yield from combined(held)
                    held, count = [], 0
        if count:
            yield from combined(held)

    return run


def _gathered(batches: Iterator[pa.RecordBatch], least: int = 4096) -> Iterator[pa.RecordBatch]:
    """Small batches joined into fewer."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += len(batch)
        if count >= least:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, count = [], 0
    if count:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed anchors sorted by h and the rest to covered ones (h null) and to those that share a gram with other
    surroundings (h). Rows that are covered already may come anywhere between them.

    Streams: of a gram's anchors only the first is kept waiting, until a second kind of surroundings is seen.
    """
    h0 = c0 = waiting = None
    for batch in _gathered(batches, 1 << 16):
        table = _unpacked(batch)
        done = table["covered"] == 1
        if done.any():
            yield _rows(*(table[n][done] for n in _NAMES[1:]))
            table = {n: v[~done] for n, v in table.items()}
        h, c = table["h"], table["c"]
        if not len(h):
            continue
        new_h = np.concatenate(([h0 is None or h[0] != h0], h[1:] != h[:-1]))
        new_c = new_h | np.concatenate(([c0 is None or c[0] != c0], c[1:] != c[:-1]))
        if (again := ~new_c).any():
            yield _rows(*(table[n][again] for n in _NAMES[1:]))
        reps = np.flatnonzero(new_c)
        if len(reps):
            more = np.concatenate((~new_h[reps[1:]], [False]))  # the next one has the same gram
            if waiting is not None and not new_h[reps[0]]:
                yield waiting
            waiting = None
            shared = reps[~new_h[reps] | more]
            if len(shared):
                yield _rows(*(table[n][shared] for n in _NAMES[1:]), h[shared])
            if new_h[reps[-1]]:
                waiting = _rows(*(table[n][reps[-1:]] for n in _NAMES[1:]), h[reps[-1:]])
        h0, c0 = h[-1], c[-1]


class Suffixes:
    """Suffixes of a buffer, compared up to `length` bytes by hashes and binary search."""

    def __init__(self, data: np.ndarray, length: int):
        self.data = np.concatenate((data, np.zeros(length + 8, np.uint8)))
        self.hashes, self.length = PrefixHashes(self.data), length

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The length of the common extension, at most `length`."""
        low, high = np.zeros(len(i), np.int64), np.full(len(i), self.length)
        equal = self.hashes.of(i, i + self.length) == self.hashes.of(j, j + self.length)
        low[equal] = self.length
        rest = np.flatnonzero(~equal)
        low_r, high_r, i, j = low[rest], high[rest] - 1, i[rest], j[rest]
        while len(rest) and (low_r < high_r).any():
            middle = (low_r + high_r + 1) // 2
            same = self.hashes.of(i, i + middle) == self.hashes.of(j, j + middle)
            low_r, high_r = np.where(same, middle, low_r), np.where(same, high_r, middle - 1)
        low[rest] = low_r
        return low

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        shared = self.common(i, j)
        return (shared < self.length) & (self.data[i + shared] < self.data[j + shared])

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """As `common`, but by the bytes themselves, not by their hashes."""
        eight = np.ndarray(len(self.data) - 7, "<u8", self.data.data, strides=(1,))
        found = np.full(len(i), self.length)
        live = np.arange(len(i))
        for step in range(0, self.length, 8):
            differ = eight[i[live] + step] ^ eight[j[live] + step]
            other = differ != 0
            differ = differ[other]
            found[live[other]] = step + np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) // 8
            live = live[~other]
        return np.minimum(found, self.length)

    def sort(self, places: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The order that sorts the suffixes at `places` inside each bucket; equal ones keep theirs.

        A mergesort from below, all runs of a level at once: the place of a suffix in the merged run is
        its own plus the number of suffixes of the sister run before it, which binary search finds.
        `bucket` is ascending.
        """
        n = len(places)
        order = np.arange(n)
        head = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if n else np.empty(0, np.int64)
        size = np.diff(np.append(head, n))
        run = 1
        while len(head) and run < size.max():
            big = size > run
            at = np.repeat(head[big], size[big]) + (np.arange(int(size[big].sum())) - np.repeat(np.cumsum(size[big]) - size[big], size[big]))
            first, total = np.repeat(head[big], size[big]), np.repeat(size[big], size[big])
            inside = at - first
            left = (inside // run) % 2 == 0
            other = np.where(left, (inside // run + 1) * run, (inside // run - 1) * run)
            low = np.minimum(other, total)
            high = np.minimum(other + run, total)
            base, mine = low.copy(), places[order[at]]
            live = np.flatnonzero(low < high)
            while len(live):
                middle = (low[live] + high[live]) // 2
                their = places[order[first[live] + middle]]
                # those before a suffix of the left run are less; before one of the right run, not greater
                ahead = np.where(left[live], self.less(their, mine[live]), ~self.less(mine[live], their))
                low[live] = np.where(ahead, middle + 1, low[live])
                high[live] = np.where(ahead, high[live], middle)
                live = live[low[live] < high[live]]
            pair = (inside // (2 * run)) * 2 * run
            merged = first + pair + (inside % run) + (low - base)
            moved = order.copy()
            moved[merged] = order[at]
            order, run = moved, run * 2
        return order


def _neighbours(suffixes: Suffixes, places: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the suffixes in their groups, the places in it, and what each shares with the one before (-1: another group)."""
    order = suffixes.sort(places, group)
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    shared = np.full(len(order), -1)
    inner = np.flatnonzero(group[1:] == group[:-1]) + 1  # groups lie where they lay before
    shared[inner] = suffixes.shared(places[order[inner]], places[order[inner - 1]])
    return order, at, shared


def covered_windows(h: np.ndarray, a: np.ndarray, b: np.ndarray, around: list[bytes], length: int) -> np.ndarray:
    """Flags of all windows of the rows, row by row: equal to a window of an earlier row of the same h.

    Rows are in order of h, then of document and place. around: the bytes that a row's windows cover.

    In equal windows the anchor has the same offset, so they are the windows of anchors that share at least
    `offset` bytes before them and the rest of the window from there on. Among the sorted anchors these are
    neighbours: a run in which each shares as much with the one before. Two anchors are in the same runs of
    both orders, or their windows at this offset differ.
    """
    n, sizes = len(h), b.astype(np.int64) + 1
    flags = np.zeros(int(sizes.sum()), bool)
    if not n:
        return flags
    data = np.frombuffer(b"".join(around), np.uint8)
    widths = sizes + length - 1
    x = np.cumsum(widths) - widths + a
    group = np.concatenate(([0], np.cumsum(h[1:] != h[:-1])))
    after, at_after, shared_after = _neighbours(Suffixes(data, length), x, group)
    before, at_before, shared_before = _neighbours(Suffixes(data[::-1], max(1, int(a.max()))), len(data) - x, group)

    def most(at, shared):  # that a row shares with any other of its group
        return np.maximum(shared, np.append(shared[1:], -1))[at]

    least, highest = np.maximum(a - b, length - most(at_after, shared_after)), np.minimum(a, most(at_before, shared_before))
    able = np.flatnonzero(least <= highest)
    if not len(able):
        return flags
    least, highest, at_after, at_before = least[able], highest[able], at_after[able], at_before[able]
    window = (np.cumsum(sizes) - sizes + a)[able]  # that of offset 0, were there one
    numbers = np.arange(n)
    for offset in range(int(least.min()), int(highest.max()) + 1):
        own = np.flatnonzero((least <= offset) & (offset <= highest))
        if len(own) < 2:
            continue
        run_after = np.maximum.accumulate(np.where(shared_after < length - offset, numbers, 0))[at_after[own]]
        run_before = np.maximum.accumulate(np.where(shared_before < offset, numbers, 0))[at_before[own]]
        runs = run_after * n + run_before
        order = np.argsort(runs, kind="stable")
        again = order[1:][runs[order[1:]] == runs[order[:-1]]]
        flags[window[own[again]] - offset] = True
    return flags


def _sorted_groups(length: int):
    """Rows (h, d, t, x, a, b, around) sorted by them to covered rows: x, a, b restated for the covered windows."""

    def of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        h, d, t, x, a, b = (rows.column(i).to_numpy() for i in range(6))
        flags = covered_windows(h, a.astype(np.int64), b.astype(np.int64), rows.column(6).to_pylist(), length)
        if not flags.any():
            return
        sizes = b.astype(np.int64) + 1
        row = np.repeat(np.arange(len(h)), sizes)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        head = flags & np.concatenate(([True], ~flags[:-1] | (row[1:] != row[:-1])))
        number = np.cumsum(head)[flags] - 1
        at = np.flatnonzero(head)
        count = np.bincount(number)
        start = (x.astype(np.int64) - a)[row[at]] + inside[at]
        yield _rows(d[row[at]], t[row[at]], start, np.zeros(len(at), np.int64), count - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < HOT_ROWS:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            h = rows.column(0).to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # the last gram may go on
            if cut:
                yield from of(rows.slice(0, cut).combine_chunks())
            held = rows.slice(cut).combine_chunks().to_batches()
        if held:
            yield from of(pa.Table.from_batches(held).combine_chunks())

    return run


def _surroundings(length: int):
    """Rows (d, t, text, places) to a row for each place, with the bytes that its windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, t = (batch.column(i).to_numpy() for i in (0, 1))
            texts, lists = batch.column(2).cast(pa.large_binary()), batch.column(3)
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts)]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            h, x, a, b = (v.to_numpy() for v in lists.flatten().flatten())
            text = np.repeat(np.arange(len(batch)), pc.list_value_length(lists).to_numpy())
            starts, widths = offsets[text] + x - a, b.astype(np.int64) + length
            for at in range(0, len(h), 4096):
                part = slice(at, at + 4096)
                ends = np.cumsum(widths[part])
                inside = np.arange(ends[-1]) - np.repeat(ends - widths[part], widths[part])
                around = data[np.repeat(starts[part], widths[part]) + inside]
                yield pa.RecordBatch.from_arrays([
                    *(pa.array(v[part]) for v in (h, d[text], t[text], x, a, b)),
                    _binary(ends, around),
                ], ["h", "d", "t", "x", "a", "b", "around"])

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, text, spans) to rows with what is left of the text, and the counts."""
    for batch in batches:
        kept, readable, removed, runs = [], [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2)):
            start, end = (v.to_numpy() for v in spans.values.flatten())
            order = np.argsort(start, kind="stable")
            start, end = start[order], np.maximum.accumulate(end[order])
            head = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
            cuts = list(zip(start[head].tolist(), np.append(end[head[1:] - 1], end[-1]).tolist()))
            at, left = 0, []
            for a, b in cuts:
                left.append(text[at:a])
                at = b
            left.append(text[at:])
            kept.append(b"".join(left))
            readable.append("".join(part.decode("utf-8", "ignore") for part in left))
            removed.append(sum(b - a for a, b in cuts))
            runs.append(len(cuts))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(kept, pa.binary()), pa.array(readable, pa.string()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())],
            ["row", "kept", "kept_text", "n_removed", "n_spans"],
        )


def _near_texts(rows: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose d is wanted (and perhaps others), and those surely not wanted; exact where the ids
    are few enough to broadcast, else all rows are left to the join that follows."""
    ids = wanted.select("d").distinct()
    if ids.count() <= BROADCAST_DOCS:
        ids = F.broadcast(ids)
        return rows.join(ids, "d", "left_semi"), rows.join(ids, "d", "left_anti")
    return rows, rows.limit(0)


def covered_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Spans d, t, start and end (bytes) that strings of `length` bytes starting earlier cover; they may overlap.

    rows: d, t (together the order of documents) and text (binary).
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    anchors = rows.select("d", "t", "text").mapInArrow(tidy(_anchors(length, gram)), "h long, rest binary")
    ordered = anchors.repartition(parts, "h").sortWithinPartitions("h", "rest")
    found = materialize(ordered.mapInArrow(tidy(_resolved), _FOUND), "suffix-anchors")
    open_ = found.where("h IS NOT NULL")
    hot = materialize(open_.groupBy("h").count().where(F.col("count") > HOT_ROWS).select("h"), "suffix-hot")
    lists = open_.groupBy("d", "t").agg(F.collect_list(F.struct("h", "x", "a", "b")).alias("places"))
    near, _ = _near_texts(rows.select("d", "t", "text"), open_)
    fetched = near.join(lists, ["d", "t"]).select("d", "t", "text", "places").mapInArrow(
        tidy(_surroundings(length)), "h long, d long, t long, x int, a int, b int, around binary"
    )
    spans = []
    if hot.isEmpty():
        mild = fetched
    else:
        fetched = materialize(fetched, "suffix-surroundings")
        mild = fetched.join(hot, "h", "left_anti").select(fetched.columns)
        window = fetched.join(hot, "h", "left_semi").select(
            "h", "d", "t", "x", "a", F.explode(F.sequence(F.lit(0), F.col("b"))).alias("i"), "around"
        ).select("h", "d", "t", (F.col("x") - F.col("a") + F.col("i")).alias("s"), F.sha2(F.substring("around", F.col("i") + 1, F.lit(length)), 256).alias("w"))
        window = materialize(window, "suffix-windows")
        firsts = window.groupBy("w").agg(F.min(F.struct("d", "t", "s")).alias("first"))
        later = window.join(firsts, "w").where(F.struct("d", "t", "s") > F.col("first"))
        spans.append(later.select(F.lit(None).cast("long").alias("h"), "d", "t", F.col("s").alias("x"), F.lit(0).alias("a"), F.lit(0).alias("b")))
    grouped = mild.repartition(parts, "h").sortWithinPartitions("h", "d", "t", "x")
    spans.append(grouped.mapInArrow(tidy(_sorted_groups(length)), _FOUND))
    both = found.where("h IS NULL").unionByName(materialize(reduce(DataFrame.unionByName, spans), "suffix-spans"))
    start = F.col("x") - F.col("a")
    return both.select("d", "t", start.alias("start"), (start + F.col("b") + length).alias("end"))


def cut_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """row (all columns of a document) with kept (binary, what is left of the text's UTF-8 bytes),
    kept_text (the same without characters that were cut through), n_removed and n_spans (maximal
    removed runs).

    Removed is each byte covered by a string of `length` bytes that also starts earlier: in a document
    of smaller id, or earlier in the same one. Overlaps count, and strings are judged on the input.
    Null and empty texts keep nothing and lose nothing; a null id comes before all others; rows of the
    same id and text are one document and share its result; of the same id and other text, ordered by
    a hash of it; no rows give no rows. Equal anchors are first combined inside each task, so a passage
    that a third of all rows share is shuffled once a task.
    """
    text_batches(docs.sparkSession)
    shape = docs.select(F.struct("*").alias("row"), F.coalesce(named(doc_id).cast("long"), F.lit(_NULL_ID)).alias("d"))
    own = F.coalesce(F.col("row").getField(text), F.lit("")).cast("binary").alias("text")
    repeated = has_repeats(docs, doc_id)
    rows = shape.withColumn("t", F.xxhash64(own) if repeated else F.lit(0).cast("long"))
    ones = rows.select("d", "t", own)
    # else the anchors of a document would be covered by those of its own other row
    spans = covered_spans(materialize(ones.dropDuplicates(["d", "t"]), "suffix-documents") if repeated else ones, length, gram)
    lists = spans.groupBy("d", "t").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    near, far = _near_texts(rows, spans)
    joined = near.join(lists, ["d", "t"], "left")  # a row has its text once, as text is read after the join
    touched = joined.where("spans IS NOT NULL")
    rest = joined.where("spans IS NULL").select(near.columns).unionByName(far.select(near.columns))
    from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

    out = StructType([StructField("row", shape.schema["row"].dataType), StructField("kept", BinaryType()), StructField("kept_text", StringType()), StructField("n_removed", LongType()), StructField("n_spans", LongType())])
    cut = touched.select("row", own, "spans").mapInArrow(tidy(_kept), out)
    whole = rest.select("row", own.alias("kept"), own.cast("string").alias("kept_text"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"))
    return cut.unionByName(whole)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """All columns of the documents with kept, kept_text, n_removed and n_spans, as `cut_rows` gives them;
    document columns of these names are an error."""
    refuse_clash(docs, "kept", "kept_text", "n_removed", "n_spans")
    return cut_rows(docs, doc_id, text, length, gram).select("row.*", "kept", "kept_text", "n_removed", "n_spans")
