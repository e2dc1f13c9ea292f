"""Removal of byte strings that also start in an earlier document, by suffix arrays of grouped segments.

Linear grouping construction of a suffix array (`suffix_arrays`): suffixes start in groups by their first symbol. Groups are
processed in descending order; the previous smaller suffix of each member, found along the pointers of groups already
processed, moves behind its old group, and the more members point at it, the further. Then every group holds the suffixes
of one Lyndon prefix, and one pass from the smallest suffix on emits each group's order: the suffix before an emitted one,
and those its pointers lead to, are the next of their groups. Nothing is renamed and nothing recurses. Many texts are
sorted in step, one group of each at a time, so that the work is numpy's.

Distribution: a window of 50 bytes belongs to the smallest hash of its 24-byte grams, so equal windows meet wherever they
stand, and neighbouring windows of one hash form a segment. Hashes that occur in one document only are dropped. The distinct
segments of a hash are one text, whose suffix array brings equal windows side by side; bytes are compared, not hashes. A
hash of more than 64 distinct segments (`IN_STEP`) has its windows sorted as they are, since one long text would hold up the
others; one in more than 4,096 documents (`HOT`) may have more than a task can hold, so its windows go out one by one, by
128-bit hashes of their bytes, and are met by those.

Documents are cut into slices, rows of a stored table. Slices send and are answered packed arrays, and a segment that
repeats within a slice is sent once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xmseq.llm.groups import by_group, releasing
from xmseq.llm.phrases import expand, squeeze
from xmseq.llm.slices import by_slice
from xmseq.llm.substrings import from_planes, pack, planes, unpack
from xmseq.llm.words import ROLL, mix, runs, slices, text_bytes
from xmseq.storage import pin

WINDOW = 50
GRAM = 24
#: Windows in a segment at most: periodic texts have endless runs of one hash.
SEGMENT = 64
SLICE = 4 << 20
PIECE = 1 << 20
HOT = 4096
#: A text of more segments than this is too long to be sorted in step with others: its windows are sorted as they are.
IN_STEP = 64
#: Symbols sorted in step.
BATCH = 1 << 20
INT, BIN = pa.int64(), pa.binary()


# ---- suffix arrays ----


def suffix_arrays(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Suffix array of each of many texts, one behind the other, as places in `symbols`.

    symbols: whole numbers from 0 on; text t is offsets[t] to offsets[t + 1] and ends with its only 0.
    """
    n, texts = len(symbols), len(offsets) - 1
    if n == 0:
        return np.zeros(0, np.int64)
    text = np.repeat(np.arange(texts), np.diff(offsets))
    key = text * (int(symbols.max()) + 1) + symbols
    sa = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.append(True, key[sa][1:] != key[sa][:-1]))
    size = np.zeros(n + 1, np.int64)
    size[first] = np.diff(np.append(first, n))
    place, group = np.empty(n, np.int64), np.empty(n, np.int64)
    place[sa] = np.arange(n)
    group[sa] = np.repeat(first, size[first])
    before = np.arange(n) - 1
    before[offsets[:-1]] = -1
    point(sa, place, group, size, before, offsets)
    return emit(group, before, offsets)


def point(sa: np.ndarray, place: np.ndarray, group: np.ndarray, size: np.ndarray, before: np.ndarray, offsets: np.ndarray) -> None:
    """Split the groups by Lyndon prefixes and leave in `before` each suffix's last one of a smaller group, or -1."""
    end, begin = offsets[1:].copy(), offsets[:-1]
    live = np.flatnonzero(end > begin + 1)
    moved = np.zeros(len(sa), bool)
    while len(live):
        at = group[sa[end[live] - 1]]
        count = end[live] - at
        end[live] = at
        low = np.repeat(at, count)
        own = sa[low + np.arange(len(low)) - np.repeat(np.cumsum(count) - count, count)]
        live = live[at > begin[live] + 1]
        # Pointers of higher groups are final; within the group they are followed until they leave it.
        todo, floor = own, low
        while True:
            to = before[todo]
            up = (to >= 0) & (group[to] >= floor)
            if not up.any():
                break
            todo, floor = todo[up], floor[up]
            before[todo] = before[to[up]]
        to = before[own]
        to = np.sort(to[to >= 0])
        if not len(to):
            continue
        new = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        many = np.diff(np.append(new, len(to)))
        to = to[new]
        old = group[to]
        order = np.lexsort((many, old))
        to, old, many = to[order], old[order], many[order]
        change = np.append(True, old[1:] != old[:-1])
        run = np.flatnonzero(change)
        length = np.diff(np.append(run, len(old)))
        slot = np.repeat(old[run] + size[old[run]] - length, length) + np.arange(len(old)) - np.repeat(run, length)
        # What stands in the slots but stays changes places with what moves there from further down.
        moved[to] = True
        there = sa[slot]
        stays = there[~moved[there]]
        moved[to] = False
        gaps = place[to] < np.repeat(slot[run], length)
        sa[place[to[gaps]]] = stays
        place[stays] = place[to[gaps]]
        sa[slot], place[to] = to, slot
        size[old[run]] -= length
        part = np.flatnonzero(change | np.append(True, many[1:] != many[:-1]))
        width = np.diff(np.append(part, len(old)))
        size[slot[part]] = width
        group[to] = np.repeat(slot[part], width)


def emit(group: np.ndarray, before: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The order of all suffixes from their groups and pointers: each text either places a suffix or goes on to its next."""
    out = np.zeros(len(group), np.int64)
    free = np.arange(len(group))
    placed = np.zeros(len(group), bool)
    live = np.flatnonzero(np.diff(offsets) > 0)
    begin, end = offsets[live], offsets[live + 1]
    out[begin] = end - 1
    placed[end - 1] = True
    at = begin.copy()
    here = end - 2
    while len(at):
        can = here >= begin
        can[can] = ~placed[here[can]]
        s = here[can]
        slot = free[group[s]]
        free[group[s]] = slot + 1
        out[slot] = s
        placed[s] = True
        here[can] = before[s]
        at[~can] += 1
        on = at < end
        if not on.all():
            can, at, here, begin, end = can[on], at[on], here[on], begin[on], end[on]
        rest = ~can
        here[rest] = out[at[rest]] - 1
    return out


# ---- segments ----


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros beyond the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))


def segments(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one smallest gram hash: first byte, number of windows, and 48 bits of the hash."""
    n = len(data) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    e = eights(data)
    h = mix(e[: len(data) - gram + 1] + ROLL)
    for j in range(8, gram, 8):
        h = mix((h ^ e[min(j, gram - 8) :][: len(h)]) * ROLL)
    width, size = window - gram + 1, 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    if size < width:
        h = np.minimum(h[: len(h) - (width - size)], h[width - size :])
    # Windows that leave their row belong to none.
    out = np.zeros(n + 1, np.int32)
    np.add.at(out, (offsets[1:-1] - window + 1).clip(0, n), 1)
    np.add.at(out, offsets[1:-1].clip(max=n), -1)
    inner = np.cumsum(out[:n]) == 0
    h >>= np.uint64(16)
    start = np.flatnonzero(inner & np.append(True, (h[1:] != h[:-1]) | ~inner[:-1]))
    stop = np.flatnonzero(inner & np.append((h[1:] != h[:-1]) | ~inner[1:], True)) + 1
    many = stop - start
    if len(many) and many.max() > SEGMENT:
        parts = -(-many // SEGMENT)
        start, stop = np.repeat(start, parts) + runs(parts) * SEGMENT, np.repeat(stop, parts)
        many = np.minimum(stop - start, SEGMENT)
    return start, many, h[start]


def pieces(lengths: np.ndarray, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (text, from, to) of about PIECE bytes; parts of a long text overlap by all but one byte of a window."""
    held, size = [], 0
    for t, n in enumerate(lengths.tolist()):
        for at in range(0, max(n - window + 1, 0), PIECE):
            to = min(at + PIECE + window - 1, n)
            held.append((t, at, to))
            size += to - at
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


class Slice:
    """The distinct texts of a slice that have an id: bytes, smallest id, and which text each row holds."""

    def __init__(self, ids: list[int | None], lengths: bytes, z: bytes):
        self.ids, self.bytes = ids, np.frombuffer(expand(z), np.uint8)
        ends = np.cumsum(from_planes(lengths))
        raw, number, self.begin, self.size, self.least = self.bytes.tobytes(), {}, [], [], []
        self.text = []
        for i, a, b in zip(ids, np.append(0, ends).tolist(), ends.tolist(), strict=False):
            if i is None:
                self.text.append(-1)
                continue
            t = number.setdefault(raw[a:b], len(number))
            if t == len(self.begin):
                self.begin.append(a)
                self.size.append(b - a)
                self.least.append(i)
            self.least[t] = min(self.least[t], i)
            self.text.append(t)
        self.raw, self.ends = raw, ends
        self.begin, self.size, self.least = (np.array(x, np.int64) for x in (self.begin, self.size, self.least))

    def segments(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, first byte in the text, windows and hash of every segment."""
        out = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)]
        for part in pieces(self.size, window):
            text, a, b = (np.array(x) for x in zip(*part, strict=True))
            offsets = np.append(0, np.cumsum(b - a))
            data = np.concatenate([self.bytes[self.begin[t] + x : self.begin[t] + y] for t, x, y in part])
            start, many, key = segments(data, offsets, window, gram)
            row = np.searchsorted(offsets, start, side="right") - 1
            out.append((text[row], start - offsets[row] + a[row], many, key))
        return tuple(np.concatenate([o[i] for o in out]) for i in range(4))


#: Bytes of text whose hashes a task compares.
TASK_BYTES = 16 << 20


def cut(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for lo, hi in slices(offsets, SLICE):
                ids = pa.array([batch.column("doc_id").slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64()))
                lengths = planes(np.diff(offsets[lo : hi + 1]))
                z = squeeze(data[offsets[lo] : offsets[hi]].tobytes())
                size = pa.array([int(offsets[hi] - offsets[lo])])
                yield pa.record_batch([size, ids, pa.array([lengths], BIN), pa.array([z], BIN)], ["size", "ids", "lengths", "z"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = rows.mapInArrow(releasing(run), "size bigint, ids array<bigint>, lengths binary, z binary")
    return pin(made.withColumn("slice", F.monotonically_increasing_id()), "slices", packed=True)


def runs_of(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    cuts = np.flatnonzero(np.append(True, x[1:] != x[:-1])).tolist() if len(x) else []
    return zip(cuts, [*cuts[1:], len(x)][: len(cuts)], strict=True)


def by_task(keys: np.ndarray, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys by task, then key, and the tasks in that order."""
    task = (mix(keys) % np.uint64(tasks)).astype(np.int64)
    order = np.lexsort((keys, task))
    return order, task[order]


def record(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(schema)], [c for c, _ in schema])


# ---- hashes that recur ----


def filter_bits(total: int) -> int:
    """Bits of a hash that tell whether it recurs: few distinct ones collide, and those are only looked at in vain."""
    return min(48, max(24, total.bit_length() + 4))


def recurring(cuts: DataFrame, window: int, gram: int, tasks: int, bits: int) -> DataFrame:
    """For each slice and task a byte per key, in order: 0 in one document only, 1 recurs, 2 recurs in too many for one task."""
    names = [("task", INT), ("slice", INT), ("keys", BIN), ("counts", BIN)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                text, _, _, key = Slice(row["ids"], row["lengths"], row["z"]).segments(window, gram)
                keys, counts = documents_of(key >> np.uint64(48 - bits), text)
                order, task = by_task(keys, tasks)
                keys, counts = keys[order], counts[order]
                yield record([(int(task[a]), row["slice"], squeeze(planes(np.diff(keys[a:b].view(np.int64), prepend=0))), squeeze(planes(counts[a:b]))) for a, b in runs_of(task)], names)

    def meet(table: pa.Table, starts: np.ndarray) -> pa.Table:
        out = []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            rows = table.slice(lo, hi - lo).to_pylist()
            keys = [np.cumsum(from_planes(expand(r["keys"]))) for r in rows]
            counts = np.concatenate([from_planes(expand(r["counts"])) for r in rows])
            _, which = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(which, counts)
            level = ((total > 1).astype(np.uint8) + (total > HOT).astype(np.uint8))[which]
            at = np.cumsum([0, *(len(k) for k in keys)])
            out += [(r["slice"], r["task"], squeeze(level[a:b].tobytes())) for r, a, b in zip(rows, at[:-1], at[1:], strict=True)]
        return pa.Table.from_batches([record(out, [("slice", INT), ("task", INT), ("levels", BIN)])])

    sent = cuts.mapInArrow(releasing(send), "task bigint, slice bigint, keys binary, counts binary")
    return pin(by_group(sent, ["task"], meet, "slice bigint, task bigint, levels binary"), "levels")


def documents_of(key: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and in how many texts each occurs."""
    order = np.lexsort((text, key))
    key, text = key[order], text[order]
    new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    fresh = new.copy()
    fresh[1:] |= text[1:] != text[:-1]
    first = np.flatnonzero(new)
    return key[first], np.add.reduceat(fresh.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


# ---- segments that meet ----

SENT = "task bigint, slice bigint, keys binary, windows binary, bytes binary, docs binary"
NAMES = [("task", INT), ("slice", INT), ("keys", BIN), ("windows", BIN), ("bytes", BIN), ("docs", BIN)]
PAIR = np.dtype([("a", "<u8"), ("b", "<u8")])


class Meeting:
    """What a slice brings together with others: its distinct segments, and single windows of hashes that are too frequent.

    Both are numbered in the order of the tasks they go to; the numbers of every place are kept. Made again from the same
    slice and answers, it is the same.
    """

    def __init__(self, rows: list[dict], window: int, gram: int, tasks: int, bits: int):
        own = next(r for r in rows if r["z"] is not None)
        told = sorted((r for r in rows if r["levels"] is not None), key=lambda r: r["task"])
        self.slice = s = Slice(own["ids"], own["lengths"], own["z"])
        text, start, many, key = s.segments(window, gram)
        short = key >> np.uint64(48 - bits)
        keys = np.unique(short)
        level = np.zeros(len(keys), np.uint8)
        if told:
            level[by_task(keys, tasks)[0]] = np.concatenate([np.frombuffer(expand(r["levels"]), np.uint8) for r in told])
        level = level[np.searchsorted(keys, short)]
        some, hot = np.flatnonzero(level == 1), np.flatnonzero(level == 2)
        self.text, self.many, self.place = text[some], many[some], (s.begin[text] + start)[some]
        number: dict[bytes, int] = {}
        ends = (self.place + self.many + window - 1).tolist()
        which = np.array([number.setdefault(s.raw[a:b], len(number)) for a, b in zip(self.place.tolist(), ends, strict=True)], np.int64)
        one = np.zeros(len(number), np.int64)
        one[which] = np.arange(len(some))
        order, self.tasks = by_task(key[some][one], tasks)
        self.number, self.least = ranked(order, which, s.least[self.text])
        one = one[order]
        self.keys, self.windows = key[some][one], self.many[one]
        blobs = list(number)
        self.blobs = [blobs[i] for i in order.tolist()]
        times = many[hot]
        self.hot_text = np.repeat(text[hot], times)
        self.hot_place = np.repeat((s.begin[text] + start)[hot], times) + runs(times)
        pairs, which = np.unique(window_hashes(s.bytes, self.hot_place, window), return_inverse=True)
        order, self.hot_tasks = by_task(pairs["a"].copy(), tasks)
        self.pairs = pairs[order]
        self.hot_number, self.hot_least = ranked(order, which.ravel(), s.least[self.hot_text])


def ranked(order: np.ndarray, which: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place in `order` of what each place shows, and the smallest document showing it, in that order."""
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    least = np.full(len(order), 2**63 - 1)
    np.minimum.at(least, rank[which], docs)
    return rank[which], least


def send_segments(cuts: DataFrame, levels: DataFrame, window: int, gram: int, tasks: int, bits: int) -> DataFrame:
    """Rows of segments, with keys, and of hashes of single windows, without."""

    def run(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        m, slice_ = Meeting(rows, window, gram, tasks, bits), rows[0]["slice"]
        out = []
        for a, b in runs_of(m.tasks):
            steps = squeeze(planes(np.diff(m.keys[a:b].view(np.int64), prepend=0)))
            out.append((int(m.tasks[a]), slice_, steps, planes(m.windows[a:b]), squeeze(b"".join(m.blobs[a:b])), pack(m.least[a:b])))
        for a, b in runs_of(m.hot_tasks):
            out.append((int(m.hot_tasks[a]), slice_, None, None, m.pairs[a:b].tobytes(), pack(m.hot_least[a:b])))
        yield record(out, NAMES)

    return by_slice(cuts.unionByName(levels, allowMissingColumns=True), run, SENT)


def window_hashes(data: np.ndarray, where: np.ndarray, window: int) -> np.ndarray:
    """128 bits of hash of each window."""
    e = eights(data)
    out = np.zeros(len(where), PAIR)
    a, b = np.full(len(where), ROLL), np.full(len(where), ~ROLL)
    for j in [*range(0, window - 8, 8), window - 8]:
        x = e[where + j]
        a, b = mix((a ^ x) * ROLL), mix((b + x) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(j + 1))
    out["a"], out["b"] = a, b
    return out


def meet_segments(sent: DataFrame, window: int) -> DataFrame:
    """For each slice and task the smallest document of every window sent, as its distance below the one sent with it."""
    schema = [("slice", INT), ("task", INT), ("lower", BIN), ("hot_lower", BIN)]

    def meet(table: pa.Table, starts: np.ndarray) -> pa.Table:
        out = []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            rows = table.slice(lo, hi - lo).to_pylist()
            out += [(*r, None) for r in lowest([r for r in rows if r["keys"] is not None], window)]
            out += [(i, t, None, x) for i, t, x in lowest_windows([r for r in rows if r["keys"] is None])]
        return pa.Table.from_batches([record(out, schema)])

    return by_group(sent, ["task"], meet, "slice bigint, task bigint, lower binary, hot_lower binary")


def lowest_windows(rows: list[dict]) -> list[tuple[int, int, bytes]]:
    if not rows:
        return []
    docs = [unpack(r["docs"]) for r in rows]
    _, which = np.unique(np.concatenate([np.frombuffer(r["bytes"], PAIR) for r in rows]), return_inverse=True)
    which = which.ravel()
    low = np.full(int(which.max()) + 1, 2**63 - 1)
    np.minimum.at(low, which, np.concatenate(docs))
    at = np.cumsum([0, *(len(d) for d in docs)])
    return [(r["slice"], r["task"], squeeze(planes(d - low[which[a:b]]))) for r, d, a, b in zip(rows, docs, at[:-1], at[1:], strict=True)]


def lowest(rows: list[dict], window: int) -> list[tuple[int, int, bytes]]:
    if not rows:
        return []
    many = [from_planes(r["windows"]) for r in rows]
    keys = np.concatenate([np.cumsum(from_planes(expand(r["keys"]))) for r in rows])
    docs = np.concatenate([unpack(r["docs"]) for r in rows])
    raw = b"".join(expand(r["bytes"]) for r in rows)
    size = np.concatenate(many) + window - 1
    end = np.cumsum(size)
    # The distinct segments of each key, in its order.
    order = np.argsort(keys, kind="stable")
    held = np.empty(len(keys), np.int64)
    blobs: list[bytes] = []
    owner: list[int] = []
    begin, stop = (end - size)[order].tolist(), end[order].tolist()
    group, new = np.cumsum(np.append(0, keys[order][1:] != keys[order][:-1])).tolist(), {}
    last = -1
    for i, g, a, b in zip(order.tolist(), group, begin, stop, strict=True):
        if g != last:
            new, last = {}, g
        blob = raw[a:b]
        at = new.get(blob)
        if at is None:
            at = new[blob] = len(blobs)
            blobs.append(blob)
            owner.append(g)
        held[i] = at
    least = np.full(len(blobs), 2**63 - 1)
    np.minimum.at(least, held, docs)
    length = np.array([len(b) for b in blobs])
    begin = np.cumsum(length - window + 1) - (length - window + 1)
    low = np.repeat(least, length - window + 1)
    owner = np.array(owner)
    share(blobs, length, owner, least, begin, low, window)
    result, at = [], 0
    for r, m in zip(rows, many, strict=True):
        h = held[at : at + len(m)]
        places = np.repeat(begin[h], m) + runs(m)
        result.append((r["slice"], r["task"], squeeze(planes(np.repeat(docs[at : at + len(m)], m) - low[places]))))
        at += len(m)
    return result


def share(blobs: list[bytes], length: np.ndarray, owner: np.ndarray, least: np.ndarray, begin: np.ndarray, low: np.ndarray, window: int) -> None:
    """Give equal windows of different segments of a key the smallest of their documents, in `low`."""
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    many = np.diff(np.append(first, len(owner)))
    total = np.add.reduceat(length + 1, first)
    for g in np.flatnonzero(many > IN_STEP).tolist():
        own = np.arange(first[g], first[g] + many[g])
        data = np.frombuffer(b"".join([blobs[i] for i in own.tolist()]), np.uint8)
        size = length[own] - window + 1
        where = np.repeat(np.cumsum(length[own]) - length[own], size) + runs(size)
        rows = np.lib.stride_tricks.sliding_window_view(data, window)[where].copy().view(f"V{window}").ravel()
        _, which = np.unique(rows, return_inverse=True)
        lowest_ = np.full(int(which.max()) + 1, 2**63 - 1)
        np.minimum.at(lowest_, which, np.repeat(least[own], size))
        low[np.repeat(begin[own], size) + runs(size)] = lowest_[which]
    groups = np.flatnonzero((many > 1) & (many <= IN_STEP))
    # Texts of similar length are sorted in step.
    groups = groups[np.argsort(total[groups], kind="stable")]
    at = 0
    while at < len(groups):
        to = at + max(1, int(np.searchsorted(np.cumsum(total[groups[at:]]), BATCH, side="right")))
        chosen = groups[at:to]
        at = to
        own = np.repeat(first[chosen], many[chosen]) + runs(many[chosen])
        # Every segment ends with a 1, every text with a 0 in its place.
        data = np.frombuffer(b"\0".join([blobs[i] for i in own.tolist()]) + b"\0", np.uint8)
        symbols = data.astype(np.int64) + 2
        stop = np.cumsum(length[own] + 1)
        symbols[stop - 1] = 1
        offsets = np.append(0, np.cumsum(total[chosen]))
        symbols[offsets[1:] - 1] = 0
        sa = suffix_arrays(symbols, offsets)
        inside = runs(length[own] + 1)
        segment = np.repeat(own, length[own] + 1)
        ok = inside + window <= length[segment]
        text = np.repeat(np.arange(len(chosen)), total[chosen])
        sa = sa[ok[sa]]
        same = text[sa[1:]] == text[sa[:-1]]
        e = eights(data)
        for j in [*range(0, window - 8, 8), window - 8]:
            same &= e[sa[1:] + j] == e[sa[:-1] + j]
        run = np.flatnonzero(np.append(True, ~same))
        lowest_ = np.minimum.reduceat(least[segment[sa]], run)
        low[begin[segment[sa]] + inside[sa]] = np.repeat(lowest_, np.diff(np.append(run, len(sa))))


def below(answers: list[bytes], text: np.ndarray, many: np.ndarray, number: np.ndarray, size: np.ndarray, least: np.ndarray, s: Slice) -> np.ndarray:
    """Whether a smaller document than its own has each window; the answers follow the numbered segments, `size` windows each."""
    lower = np.concatenate([from_planes(expand(x)) for x in answers])
    at = (np.cumsum(size) - size)[number]
    low = np.repeat(least[number], many) - lower[np.repeat(at, many) + runs(many)]
    return low < np.repeat(s.least[text], many)


def apply_answers(rows: list[dict], window: int, gram: int, tasks: int, bits: int) -> Iterator[tuple[int | None, int, int, bytes, list[dict]]]:
    own = next(r for r in rows if r["z"] is not None)
    m = Meeting(rows, window, gram, tasks, bits)
    s = m.slice
    covered = np.zeros(len(s.bytes) + window + 1, np.int32)
    for column in ("lower", "hot_lower"):
        told = [r[column] for r in sorted((r for r in rows if r[column] is not None), key=lambda r: r["task"])]
        if not told:
            continue
        if column == "lower":
            late = below(told, m.text, m.many, m.number, m.windows, m.least, s)
            at = (np.repeat(m.place, m.many) + runs(m.many))[late]
        else:
            one = np.ones(len(m.hot_number), np.int64)
            late = below(told, m.hot_text, one, m.hot_number, np.ones(len(m.pairs), np.int64), m.hot_least, s)
            at = m.hot_place[late]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + window, -1)
    gone = np.cumsum(covered)[: len(s.bytes)] > 0
    for i, t, b, n in zip(s.ids, s.text, s.ends.tolist(), from_planes(own["lengths"]).tolist(), strict=True):
        raw = s.raw[b - n : b]
        if t < 0 or (i == s.least[t] and not (own_gone := gone[s.begin[t] : s.begin[t] + n]).any()):
            yield i, n, 0, raw, []
        elif i > s.least[t]:  # a copy of an earlier text of this slice
            whole = n >= window
            yield i, n, n if whole else 0, b"" if whole else raw, [{"start": 0, "end": n}] if whole else []
        else:
            edges = np.flatnonzero(np.diff(own_gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
            kept = np.frombuffer(raw, np.uint8)[~own_gone].tobytes()
            yield i, n, n - len(kept), kept, [{"start": a, "end": z} for a, z in edges.tolist()]


def drop_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Remove every byte covered by a string of `window` bytes that also starts in a document with a smaller doc_id.

    docs: doc_id (a whole number), text; other columns are ignored. Texts are taken as UTF-8 bytes, null as empty; strings do
    not cross documents, overlaps count, and strings are judged on the input. Returns per row doc_id, n_bytes, n_removed,
    kept (the bytes left, which may begin or end within a character) and removed, the maximal removed runs as (start, end)
    in bytes. Of rows that share a doc_id none is earlier than another. Rows without doc_id are kept whole and are nobody's
    earlier document. Texts shorter than `window` stay. `gram` is the length that equal strings are sought by, from 8 to
    `window`; it changes no result.
    """
    if not 8 <= gram <= window:
        raise ValueError("a gram has 8 bytes at least and fits into the window")
    spark = docs.sparkSession
    cuts = cut(docs)
    total = cuts.agg(F.sum("size")).first()[0] or 0
    tasks, bits = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES)), filter_bits(total)
    cuts = cuts.select("slice", "ids", "lengths", "z")
    levels = recurring(cuts, window, gram, tasks, bits)
    rows = cuts
    for more in (levels, meet_segments(send_segments(cuts, levels, window, gram, tasks, bits), window)):
        rows = rows.unionByName(more, allowMissingColumns=True)
    span = pa.list_(pa.struct([("start", INT), ("end", INT)]))
    names = [("doc_id", INT), ("n_bytes", INT), ("n_removed", INT), ("kept", BIN), ("removed", span)]

    def finish(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in apply_answers(rows, window, gram, tasks, bits):
            held.append(row)
            size += row[1]
            if size > PIECE:
                yield record(held, names)
                held, size = [], 0
        if held:
            yield record(held, names)

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, kept binary, removed array<struct<start: bigint, end: bigint>>"
    return by_slice(rows, finish, schema)
