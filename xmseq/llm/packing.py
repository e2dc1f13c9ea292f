"""Packing of token sequences into windows of several lengths.

Documents become token ids and go to packing groups of a bounded number of rows by a hash of id and text; equal rows, which
share a hash, are cut into runs of a bounded number. Within a group, whole windows of
the longest length are cut off; what is left of a document goes to the tier of the shortest window that holds it. Tiers are
packed from the longest on: each rest opens a window, the gap is filled by the longest rests of shorter tiers that
fit, and at last by a piece cut from the shortest rest there is. Every window but the last of a group is thus full, and the
last one is the only one to be padded. Windows are dealt to training steps, the longest first and each to the step with
fewest tokens, so that the steps of a group differ by one window of the longest at most, in all and in each tier.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from xmseq.llm.groups import releasing
from xmseq.llm.substrings import grouped
from xmseq.llm.words import bounds, hashes, mix, slices, text_bytes

LONGEST = 1024
TIERS = (128, 256, 512, 1024)
GROUP_ROWS = 1024
STEP_TOKENS = 65_536
END_ID = 0
SLICE = 4 << 20
#: White space beyond ASCII: texts that hold any of it are encoded whole.
WIDE_SPACE = "\x1c\x1d\x1e\x1f\x85\xa0                　"
#: Fixed values of the tokenizer family: how texts are split before merging, and the bytes that stand for themselves.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
JOINED = 4096
SPACES = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
_LOADED: dict[str, Encoder] = {}


class Encoder:
    """Token ids of texts by a byte-level BPE file, with a memory for spaced words.

    The pretokens of this family never cross from a character to white space after it, so a text is the sequence of its
    words with the white space before each, and equal ones have equal ids. The memory is emptied when it is full.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)
        special = {t["content"] for t in vocabulary["added_tokens"]}
        # Other bytes are written as the characters from 256 on, in order.
        other = [b for b in range(256) if b not in PLAIN_BYTES]
        byte_of = {chr(b): b for b in PLAIN_BYTES} | {chr(256 + i): b for i, b in enumerate(other)}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary["model"]["vocab"].items() if t not in special}
        # Ids are in the order of the merges, so they are ranks.
        self.encoding = tiktoken.Encoding("packing", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        # A special token in a text is that token, as the tokenizer reads it; what lies between is encoded by itself.
        self.special = {t["content"]: t["id"] for t in vocabulary["added_tokens"]}
        names = sorted(self.special, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            self.width[i] = len(t)
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys, self.first = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.uint32)

    def whole(self, text: str) -> np.ndarray:
        if self.split is None:
            return self.plain(text)
        parts = self.split.split(text)
        return np.concatenate([np.array([self.special[x]], np.uint32) if i % 2 else self.plain(x) for i, x in enumerate(parts)])

    def holds_special(self, text: bytes) -> bool:
        return any(x.encode() in text for x in self.special)

    def pieces(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of spaced words, one after the other, and the number of each: many words are encoded as one text."""
        ids, length = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(texts), JOINED):
            part = texts[lo : lo + JOINED]
            found = self.plain(b"".join(part).decode())
            ends = np.searchsorted(np.cumsum(self.width[found]), np.cumsum([len(t) for t in part])) + 1
            ids.append(found)
            length.append(np.diff(ends, prepend=0))
        return np.concatenate(ids), np.concatenate(length)

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; a null is empty."""
        data, offsets = text_bytes(column)
        for lo, hi in slices(offsets, SLICE):
            part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            found = self._slice(part, own)
            for i, ids in enumerate(found):
                if ids is None:
                    yield self.whole(part[own[i] : own[i + 1]].tobytes().decode())
                else:
                    yield ids

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray | None]:
        starts, ends, counts = bounds(data, offsets)
        first = np.cumsum(counts) - counts
        # A word takes the white space before it; what follows the last word of a text is a piece of its own.
        begin = np.empty_like(starts)
        begin[1:] = ends[:-1]
        some = counts > 0
        begin[first[some]] = offsets[:-1][some]
        tail = np.where(some, ends[np.minimum(first + counts - 1, max(len(ends) - 1, 0))] if len(ends) else 0, offsets[:-1])
        order = np.argsort(np.append(begin, tail), kind="stable")
        begin, stop = np.append(begin, tail)[order], np.append(ends, offsets[1:])[order]
        row = np.append(np.repeat(np.arange(len(counts)), counts), np.arange(len(counts)))[order]
        # Ties of empty pieces are cut away before rows are counted.
        keep = stop > begin
        begin, stop, row = begin[keep], stop[keep], row[keep]
        number = self._known(data, begin, stop)
        length = self.length[number]
        at = np.repeat(self.first[number] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        flat = self.ids[at]
        cut = np.cumsum(np.bincount(row, length, len(counts)).astype(np.int64))
        wide = [False] * len(counts)
        if (data >= 0x80).any() or ((data >= 0x1C) & (data <= 0x1F)).any():
            for i in range(len(counts)):
                text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
                wide[i] = any(c in text for c in WIDE_SPACE)
        if self.holds_special(data.tobytes()):
            for i in range(len(counts)):
                wide[i] = wide[i] or self.holds_special(data[offsets[i] : offsets[i + 1]].tobytes())
        return [None if w else flat[a:b] for w, a, b in zip(wide, np.append(0, cut[:-1]), cut, strict=True)]

    def _known(self, data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Place of each piece in the memory, after adding new ones."""
        key = hashes(data, begin, stop)
        if len(self.keys) > self.most:
            self.clear()
        order = grouped(key)
        new = np.append(True, key[order][1:] != key[order][:-1]) if len(key) else np.zeros(0, bool)
        lead, number = order[new], np.empty(len(key), np.int64)
        number[order] = np.cumsum(new) - 1
        each = key[lead]
        at = np.searchsorted(self.keys, each)
        missing = np.flatnonzero(self.keys[at.clip(0, len(self.keys) - 1)] != each) if len(self.keys) else np.arange(len(each))
        if len(missing):
            # A piece that does not begin with white space would join the one before it.
            texts = [data[begin[i] : stop[i]].tobytes() for i in lead[missing].tolist()]
            apart = np.array([t[:1] not in SPACES for t in texts], bool) | np.array([t[-1:] in SPACES for t in texts], bool)
            missing = np.append(missing[~apart], missing[apart])
            spaced = [t for t, x in zip(texts, apart, strict=True) if not x]
            alone = [self.plain(t.decode()) for t, x in zip(texts, apart, strict=True) if x]
            found, length = self.pieces(spaced)
            length = np.append(length, np.array([len(x) for x in alone], np.int64))
            first = len(self.ids) + np.cumsum(length) - length
            self.ids = np.concatenate([self.ids, found, *alone])
            keys = np.append(self.keys, each[missing])
            by = np.argsort(keys, kind="stable")
            self.keys, self.first, self.length = keys[by], np.append(self.first, first)[by], np.append(self.length, length)[by]
            at = np.searchsorted(self.keys, each)
        return at[number]


def encoder(path: str) -> Encoder:
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def pack_group(lengths: list[int], longest: int = LONGEST, tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Pieces (row, start, length, window, offset) of rows of `lengths` ids, and the size of each window.

    Windows are full at the size of their tier, apart from the last one.
    """
    pieces, sizes = [], []

    def fill(window: int, at: int, row: int, length: int, start: int) -> int:
        pieces.append((row, start, length, window, at))
        return at + length

    rests = []  # (length, row, start) in ascending order
    for row, n in enumerate(lengths):
        for start in range(0, n - longest + 1, longest):
            fill(len(sizes), 0, row, longest, start)
            sizes.append(longest)
        if n % longest:
            rests.append((n % longest, row, n - n % longest))
    rests.sort()
    while rests:
        length, row, start = rests.pop()
        size = next(t for t in tiers if t >= length)
        window, at = len(sizes), 0
        at = fill(window, at, row, length, start)
        if sum(r[0] for r in rests[:16]) < size - at and sum(r[0] for r in rests) < size - at:
            size = longest  # too little is left for this tier: everything goes to the last window
        sizes.append(size)
        while at < size and rests:
            i = bisect_right(rests, (size - at, len(lengths), 0)) - 1
            if i >= 0:
                n, row, start = rests.pop(i)
            else:  # cut the shortest
                n, row, start = rests.pop(0)
                insort(rests, (n - (size - at), row, start + (size - at)))
                n = size - at
            at = fill(window, at, row, n, start)
    return pieces, sizes


def deal_steps(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """Step of each window: none holds more than `step_tokens`, and their tokens differ by the longest window at most."""
    longest = max(sizes, default=0)
    steps = max(1, -(-sum(sizes) // max(step_tokens - longest, longest, 1)))
    least = [(0, s) for s in range(steps)]
    out = [0] * len(sizes)
    for w in sorted(range(len(sizes)), key=lambda w: -sizes[w]):
        tokens, step = heapq.heappop(least)
        out[w] = step
        heapq.heappush(least, (tokens + sizes[w], step))
    return out


def packed(docs: DataFrame, path: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pieces of all rows of `docs` (doc_id, text) in windows of at most 1024 tokens.

    Returns doc_id, start, length, ids (the piece's token ids), doc_tokens, sequence_id, offset, tier (the size of the
    window) and step (windows of one group dealt to steps of at most 65,536 tokens). Each text is encoded whole and followed
    by id 0, special tokens in it by their own ids; a null text is empty. Rows that share a doc_id, or are equal, are packed
    each by itself. Windows are full but for one in each group of about `group_rows` rows, or of twice as many of those that
    are. Rows without doc_id are packed, too; other columns are ignored, whatever their names. No rows: no pieces.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    groups = max(1, -(-docs.count() // group_rows))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = [np.append(x, np.uint32(END_ID)) for x in encode(part.column("text"))]
                # The group depends on the row alone, so that a task that runs again deals its rows alike.
                salt = np.array([zlib.crc32(x.tobytes()) for x in ids], np.uint64)
                key = part.column("doc_id").cast(pa.int64()).fill_null(-1).to_numpy().view(np.uint64)
                group = (mix(key ^ mix(salt)) % np.uint64(groups)).astype(np.int64)
                blobs = [x.astype("<u2").tobytes() if small else x.astype("<u4").tobytes() for x in ids]
                yield pa.record_batch([pa.array(group), part.column("doc_id"), pa.array(blobs, pa.binary())], ["group", "doc_id", "ids"])

    with open(path, encoding="utf-8") as f:
        small = len(json.load(f)["model"]["vocab"]) + 64 < 1 << 16
    width = 2 if small else 4

    def pack(ids: list[np.ndarray], group: int, window: int, step: int) -> tuple[list[list], int, int]:
        """Columns of the pieces of one run of rows, the first its row, and how many windows and steps it made."""
        pieces, sizes = pack_group([len(x) for x in ids])
        steps = deal_steps(sizes)
        at = [p[0] for p in pieces]
        parts = [ids[r][s : s + n].tobytes() for r, s, n, _, _ in pieces]
        place = [(group << 24) + window + p[3] for p in pieces]
        dealt = [(group << 24) + step + steps[p[3]] for p in pieces]
        columns = [at, [p[1] for p in pieces], [p[2] for p in pieces], parts, [len(ids[r]) for r in at], place, [p[4] for p in pieces], [sizes[p[3]] for p in pieces], dealt]
        return columns, len(sizes), max(steps, default=-1) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last, window, step = None, 0, 0

        def done() -> pa.RecordBatch:
            nonlocal window, step
            table = pa.Table.from_batches(held).combine_chunks()
            ids = [np.frombuffer(x, f"<u{width}").astype("<u4") for x in table.column("ids").to_pylist()]
            columns, windows, steps = pack(ids, last, window, step)
            window, step = window + windows, step + steps
            first = table.column("doc_id").combine_chunks().take(pa.array(columns[0], pa.int64()))
            return pa.record_batch([first, *(pa.array(x, pa.binary() if c == "ids" else pa.int64()) for c, x in zip(names, columns[1:], strict=True))], ["doc_id", *names])

        for batch in batches:
            groups = batch.column("group").to_numpy()
            cuts = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), len(groups)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi > lo and held and groups[lo] != last:
                    yield done()
                    held, window, step = [], 0, 0
                for at in range(lo, hi, group_rows):
                    last = int(groups[lo])
                    held.append(batch.slice(at, min(group_rows, hi - at)))
                    # Equal rows come one after the other, so it does not matter which of them are cut off here.
                    if sum(b.num_rows for b in held) >= 2 * group_rows:
                        yield done()
                        held = []
        if held:
            yield done()

    names = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step"]
    dealt = docs.mapInArrow(releasing(encode), f"group bigint, doc_id {kind}, ids binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "group").sortWithinPartitions("group", "doc_id", "ids")
    return dealt.mapInArrow(releasing(run), f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, tier bigint, step bigint")
