"""Interpolated modified Kneser-Ney language model, counted in Spark and memory-mapped by the workers that score.

A word pair (v, w) has the probability (c - D(c)) / c(v) + g(v) * p(w), where c counts the pair, c(v) the pairs that v
begins, D is a discount for counts of one, two and more, and g(v) the weight that discounting sets free. p(w) is the same
kind of estimate from the number of different words before w, and gives what it sets free to all words and one unknown one
alike. The model is kept as sorted arrays of 64-bit hashes, one file of each kind and bucket, in the shared folder. Buckets
are shares of the hash range of v (or w). A word that begins too many pairs for one task is frequent: its pairs are shared
out by the hash of (v, w), and its sums are added up from the buckets. So any number of tasks counts the corpus and no file
outgrows a task. A worker maps the files and looks up what a slice of its texts asks for in the order of the hashes.
"""

from __future__ import annotations

import os
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xmseq.llm.groups import by_group
from xmseq.llm.substrings import grouped, pack, unpack
from xmseq.llm.words import ROLL, bounds, hashes, mix, slices, text_bytes
from xmseq.storage import shared_path

BEGIN, END = np.uint64(0x5D3B8C1E97A6F024), np.uint64(0xA1C4E7F3529B6D08)
SLICE = 9 << 20
BUCKET_BYTES = 8 << 20
#: Rows that one word may bring to its bucket, one for each pair it begins in a slice; words above are frequent.
MOST_PAIRS = 1 << 19
NAMES = ["bucket", "a", "b", "c", "d", "stats"]


@dataclass
class Model:
    """Where the arrays are, and the few numbers of the whole corpus."""

    folder: str
    bits: int
    tokens: int
    words: int
    pairs: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    free: float
    #: Hashes of the frequent words, ascending.
    frequent: np.ndarray
    #: By kind of file, a bit for each bucket that has one.
    files: dict[str, np.ndarray]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts for counts of 1, 2, 3 and more, from the numbers of counts 1 to 4."""
    if not (n[0] and n[1] and n[2]):
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) for k in (1, 2, 3))


def taken(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3)]


def tokens(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of a text column: the word before each token, the token, and the tokens of each row (words and one end)."""
    data, offsets = text_bytes(column)
    for lo, hi in slices(offsets, SLICE):
        own = offsets[lo : hi + 1]
        h, counts = [np.zeros(0, np.uint64)], []
        for a, b in slices(own):
            part, edge = data[own[a] : own[b]], own[a : b + 1] - own[a]
            starts, ends, n = bounds(part, edge)
            h.append(hashes(part, starts, ends, lower=True))
            counts.append(n)
        n = np.concatenate(counts)
        last = np.cumsum(n + 1) - 1
        word = np.full(int((n + 1).sum()), END, np.uint64)
        inner = np.ones(len(word), bool)
        inner[last] = False
        word[inner] = np.concatenate(h)
        before = np.roll(word, 1)
        before[last - n] = BEGIN
        yield before, word, n + 1


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * ROLL + word)


def bucket_of(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)


def among(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of `x` are in the ascending `some`."""
    return some[np.searchsorted(some, x).clip(0, len(some) - 1)] == x if len(some) else np.zeros(len(x), bool)


def pair_place(before: np.ndarray, key: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """What a pair of key `key` is shared out by: the hash of its first word, or the key if that word is frequent."""
    return np.where(among(before, frequent), key, mix(before))


def frequent_words(docs: DataFrame, pieces: int) -> np.ndarray:
    """Words that bring more than MOST_PAIRS rows to their bucket, and maybe some of more than a half of that.

    `pieces` is the most slices there can be. A slice leaves out words that begin so few pairs in it that all slices leave
    out a half of MOST_PAIRS of a word at most; what they tell of is frequent from the other half on.
    """
    least = max(2, MOST_PAIRS // 2 // pieces)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, word, _ in tokens(batch.column("text")):
                place, _ = distinct(pair_key(before, word))
                at, n = summed(before[place], np.ones(len(place), np.int64))
                often = n >= least
                yield pa.record_batch([pa.array(before[place][at][often].view(np.int64)), pa.array(n[often])], ["v", "n"])

    found = docs.select("text").mapInArrow(count, "v bigint, n bigint").groupBy("v").agg(F.sum("n").alias("n"))
    rows = found.where(F.col("n") > MOST_PAIRS // 2).select("v").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def cuts_of(x: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal values."""
    if not len(x):
        return []
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])).tolist()
    return list(zip(first, [*first[1:], len(x)], strict=True))


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """A place of each distinct key, in ascending order of keys, and the sums of the values."""
    order = grouped(key)
    if not len(order):
        return (order, *values)
    first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    place, sums = order[first], [np.add.reduceat(v[order], first) for v in values]
    if (key[place][1:] < key[place][:-1]).any():
        again = np.argsort(key[place])
        place, sums = place[again], [s[again] for s in sums]
    return (place, *sums)


def save(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Write arrays under a name of their own, then rename: a task that runs twice leaves one whole file."""
    os.makedirs(folder, exist_ok=True)
    for i, x in enumerate(arrays):
        own = f"{folder}/.{uuid.uuid4().hex}.npy"
        np.save(own, x)
        os.replace(own, f"{folder}/{name}-{i}.npy")


def mounted(path: str) -> str:
    """Local name of a folder in the shared store, which must be mounted to be memory-mapped."""
    parts = urllib.parse.urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory mapping needs a mounted shared folder, not {path}")
    return parts.path


KINDS = {"pair": 4, "context": 3, "word": 3, "frequent": 3}


def files_of(folder: str, bits: int, rows: dict[str, int]) -> dict[str, np.ndarray]:
    """Which buckets have files, as the driver sees them; an error if those do not hold `rows` keys of each kind.

    Tasks that wrote to disks of their own, or a file that went astray, are noticed here and not taken for unseen words.
    """
    found = {kind: np.zeros(1 << bits, bool) for kind in KINDS}
    held = dict.fromkeys(KINDS, 0)
    parts = dict.fromkeys(KINDS, 0)
    for entry in os.scandir(folder) if os.path.isdir(folder) else ():
        kind, _, rest = entry.name.removesuffix(".npy").partition("-")
        if kind in KINDS:
            bucket, _, part = rest.partition("-")
            parts[kind] += 1
            if part == "0":
                found[kind][int(bucket)] = True
                held[kind] += len(np.load(entry.path, mmap_mode="r"))
    for kind, n in KINDS.items():
        if parts[kind] != n * found[kind].sum() or held[kind] != rows.get(kind, held[kind]):
            raise FileNotFoundError(f"{folder}: {held[kind]} of {rows.get(kind)} keys of kind {kind}; driver and workers must share the folder of spark.checkpoint.dir")
    return {kind: np.packbits(x) for kind, x in found.items()}


def train(docs: DataFrame) -> Model:
    """Count the texts of `docs` (column text, a null counting as empty) and write the arrays."""
    spark = docs.sparkSession
    folder = mounted(shared_path(spark, "kneser-ney"))
    sizes = docs.select(F.octet_length("text").alias("size"), F.spark_partition_id().alias("part"))
    size, rows, last = (x or 0 for x in sizes.agg(F.sum("size"), F.count("*"), F.max("part")).first())
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    bits = max(0, (tasks - 1).bit_length())
    # Two slices next to each other hold more than SLICE; a batch and a partition end with a smaller one.
    batch_rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    frequent = frequent_words(docs, 1 + last + rows // max(batch_rows, 1) + 2 * size // SLICE)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, word, _ in tokens(batch.column("text")):
                place, n = summed(pair_key(before, word), np.ones(len(word), np.int64))
                v, w = before[place], word[place]
                bucket = bucket_of(pair_place(v, pair_key(v, w), frequent), bits)
                order = grouped(mix(v))
                order = order[np.argsort(bucket[order].astype(np.uint16) if bits <= 16 else bucket[order], kind="stable")]
                v, w, n, bucket = v[order], w[order], n[order], bucket[order]
                rows = []
                for lo, hi in cuts_of(bucket):
                    first = np.array([a for a, _ in cuts_of(v[lo:hi])])
                    length = np.diff(np.append(first, hi - lo))
                    rows.append((int(bucket[lo]), v[lo + first].tobytes(), pack(length), w[lo:hi].tobytes(), pack(n[lo:hi])))
                yield table_of(rows)

    def table_of(rows: list[tuple], stats: list[int] | None = None) -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 5)]
        numbers = pa.array([stats if stats and not i else None for i in range(len(rows))], pa.list_(pa.int64()))
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), *columns, numbers], NAMES)

    def pairs(table: pa.Table, starts: np.ndarray) -> pa.Table:
        out = []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            part = table.slice(lo, hi - lo)
            v, w, n = [], [], []
            for a, b, c, d in zip(*(part.column(x).to_pylist() for x in "abcd"), strict=True):
                v.append(np.repeat(np.frombuffer(a, np.uint64), unpack(b)))
                w.append(np.frombuffer(c, np.uint64))
                n.append(unpack(d))
            v, w, n = np.concatenate(v), np.concatenate(w), np.concatenate(n)
            key = pair_key(v, w)
            place, n = summed(key, n)
            v, w, key = v[place], w[place], key[place]
            many = n > 254
            bucket = part.column("bucket")[0].as_py()
            save(folder, f"pair-{bucket}", key, np.minimum(n, 255).astype(np.uint8), key[many], n[many])
            at, total, *kinds = summed(mix(v), n, *((n == 1) * 1, (n == 2) * 1, (n > 2) * 1))
            often, sums = among(v[at], frequent), np.stack([total, *kinds], 1)
            if not often.all():
                save(folder, f"context-{bucket}", mix(v[at[~often]]), total[~often], sums[~often, 1:].astype(np.uint32))
            name = mix(v[at[often]])
            at, seen, raw = summed(mix(w), np.ones(len(w), np.int64), n)
            last = mix(w[at])
            rows = [(int(b), last[x:y].tobytes(), pack(seen[x:y]), pack(raw[x:y]), b"") for (x, y) in cuts_of(bucket_of(last, bits)) for b in [bucket_of(last[x : x + 1], bits)[0]]]
            # The sums of frequent words go on, to be added up where their own hash is.
            sums = np.column_stack([name.view(np.int64), sums[often]])
            rows += [(int(bucket_of(name[x : x + 1], bits)[0]), b"", b"", b"", sums[x:y].tobytes()) for x, y in cuts_of(bucket_of(name, bits))]
            # Contexts come last: those filed here, those of frequent words elsewhere.
            stats = [int(len(n)), *(int((n == k).sum()) for k in (1, 2, 3, 4)), int((~often).sum())]
            out.append(table_of(rows, stats))
        return pa.Table.from_batches(out)

    def words(table: pa.Table, starts: np.ndarray) -> pa.Table:
        out = []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            part = table.slice(lo, hi - lo)
            key = np.frombuffer(b"".join(part.column("a").to_pylist()), np.uint64)
            seen, raw = (np.concatenate([np.zeros(0, np.int64), *(unpack(x) for x in part.column(c).to_pylist() if x)]) for c in "bc")
            at, seen, raw = summed(key, seen, raw)
            bucket = part.column("bucket")[0].as_py()
            if len(at):
                save(folder, f"word-{bucket}", key[at], seen, raw)
            often = np.frombuffer(b"".join(part.column("d").to_pylist()), np.int64).reshape(-1, 5)
            filed = 0
            if len(often):
                at, total, *kinds = summed(often[:, 0].copy().view(np.uint64), *often.T[1:])
                save(folder, f"frequent-{bucket}", often[at, 0].copy().view(np.uint64), total, np.stack(kinds, 1))
                filed = len(at)
            stats = np.sum([s for s in part.column("stats").to_pylist() if s] or [[0] * 6], axis=0).tolist()
            own = [int(raw.sum()), len(raw), int(seen.sum()), *(int((seen == k).sum()) for k in (1, 2, 3, 4)), int((seen > 2).sum()), filed]
            out.append([*stats, *map(int, own)])
        return pa.table({"numbers": pa.array(out, pa.list_(pa.int64()))})

    schema = "bucket bigint, a binary, b binary, c binary, d binary, stats array<bigint>"
    counted = by_group(docs.select("text").mapInArrow(send, schema), ["bucket"], pairs, schema)
    numbers = by_group(counted, ["bucket"], words, "numbers array<bigint>")
    # At most one row per bucket.
    sums = np.sum([r[0] for r in numbers.collect()] or [[0] * 15], axis=0).tolist()
    n_pairs, pair_kinds, n_contexts, (n_tokens, n_words, total), word_kinds, more, n_frequent = sums[0], sums[1:5], sums[5], sums[6:9], sums[9:13], sums[13], sums[14]
    files = files_of(folder, bits, {"pair": n_pairs, "context": n_contexts, "word": n_words, "frequent": n_frequent})
    d = discounts(word_kinds)
    free = (d[0] * word_kinds[0] + d[1] * word_kinds[1] + d[2] * more) / total if total else 1.0
    return Model(folder, bits, n_tokens, n_words, n_pairs, discounts(pair_kinds), d, free, frequent, files)


def look_up(m: Model, name: str, key: np.ndarray, bucket_key: np.ndarray, columns: int) -> list[np.ndarray]:
    """Values of the keys in the mapped arrays of their buckets, 0 where they have none. A file that should be there must be."""
    folder, bits, files = m.folder, m.bits, m.files[name]
    bucket = bucket_of(bucket_key, bits)
    order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
    out = None
    for lo, hi in cuts_of(bucket[order]):
        rows = order[lo:hi]
        b = int(bucket[rows[0]])
        path = f"{folder}/{name}-{b}"
        if not files[b >> 3] >> (7 - (b & 7)) & 1:
            continue
        if not os.path.exists(f"{path}-0.npy"):
            raise FileNotFoundError(f"{path}-0.npy: all workers must see the folder of spark.checkpoint.dir")
        keys = np.load(f"{path}-0.npy", mmap_mode="r")
        values = [np.load(f"{path}-{i}.npy", mmap_mode="r") for i in range(1, columns + 1)]
        if out is None:
            out = [np.zeros((len(key), *v.shape[1:]), np.int64) for v in values]
        at = np.searchsorted(keys, key[rows]).clip(0, len(keys) - 1)
        hit = keys[at] == key[rows]
        for x, v in zip(out, values, strict=True):
            x[rows[hit]] = v[at[hit]]
        if name == "pair":
            full = rows[hit][out[0][rows[hit]] == 255]
            if len(full):
                often = np.load(f"{path}-2.npy", mmap_mode="r")
                out[0][full] = np.load(f"{path}-3.npy", mmap_mode="r")[np.searchsorted(often, key[full])]
    return out if out is not None else [np.zeros((len(key), 3) if name in ("context", "frequent") and i else len(key), np.int64) for i in range(columns)]


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, and for each row the number of its key."""
    order = grouped(key)
    new = np.append(True, key[order][1:] != key[order][:-1])
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def log_probabilities(m: Model, before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each token after the one before it, and its count in training."""
    at, word_no = distinct(word)
    key = mix(word[at])
    seen, raw = look_up(m, "word", key, key, 2)
    total = max(m.pairs, 1)
    p_word = (seen - taken(seen, m.word_discounts)) / total + m.free / (m.words + 1)
    at, pair_no = distinct(pair_key(before, word))
    v, key = mix(before[at]), pair_key(before[at], word[at])
    (count,) = look_up(m, "pair", key, pair_place(before[at], key, m.frequent), 1)
    context, context_no = distinct(v)
    sums, kinds = look_up(m, "context", v[context], v[context], 2)
    often = among(before[at][context], m.frequent)
    if often.any():
        sums[often], kinds[often] = look_up(m, "frequent", v[context][often], v[context][often], 2)
    free = kinds @ np.array(m.pair_discounts)
    sums, free = sums[context_no], free[context_no]
    lower = p_word[word_no[at]]
    known = sums > 0
    by = np.where(known, sums, 1)
    p = np.where(known, (count - taken(count, m.pair_discounts)) / by + free / by * lower, lower)
    return np.log10(p)[pair_no], raw[word_no]


def score(docs: DataFrame, m: Model) -> DataFrame:
    """Per row of (doc_id, text): n_tokens, n_known, train_tokens, base_score, score, perplexity. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, done = batch.column("doc_id"), 0
            for before, word, n in tokens(batch.column("text")):
                log, raw = log_probabilities(m, before, word)
                first = np.cumsum(n) - n
                base = np.log10((raw + 0.1) / (m.tokens + 0.1 * (m.words + 1)))
                sums = [np.add.reduceat(x, first) for x in ((raw > 0) * 1, base, log)]
                part = ids.slice(done, len(n))
                done += len(n)
                columns = [n, sums[0], np.full(len(n), m.tokens), sums[1], sums[2], 10 ** (-sums[2] / n)]
                yield pa.record_batch([part, *map(pa.array, columns)], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double",
    )


def held_out_scores(docs: DataFrame, folds: int = 10) -> DataFrame:
    """Score every row of `docs` with a model of those whose crc32(doc_id as text) mod `folds` is not 0.

    Adds held_out (remainder 0, or no doc_id). A null text is empty: one token, its end. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(True))
    model = train(docs.where(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
