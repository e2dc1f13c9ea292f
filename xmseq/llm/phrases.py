"""Phrases of words that keep company, mined with stripes.

A stripe is the associative counter of a prefix: how often each next word follows it. Prefixes of 0 to 4 words give the
counts of phrases of 1 to 5 words, one length after the other. A slice of the input builds its own stripes; stripes of one
prefix are merged elementwise in a task; and a stripe of a frequent prefix is cut into parts by the next word's hash, as many
as the prefix's own count, known from the length before, asks for. What reaches the least count is answered to the slices
that hold it, and a phrase is only extended where both the phrase and the one that starts a word later are frequent, which
loses nothing: no phrase is more frequent than a part of it.

The merged entries are one structure for all that follows: an entry is an extension of its prefix, the total of its phrase,
and a bound that may subsume its first and its last words.

Slices are rows of a stored table, words as numbers into the slice's own vocabulary; stripes and answers are packed arrays.
Words are compared by 64-bit hashes until a phrase is known to be frequent, and phrases by hashes of those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from xmseq.llm.groups import by_group, releasing
from xmseq.llm.substrings import from_planes, planes
from xmseq.llm.words import ROLL, hashes, mix, slices, text_bytes
from xmseq.storage import pin

SLICE = 8 << 20
#: A stripe is cut into one part per so many occurrences of its prefix.
PART = 1 << 20
#: Occurrences of words per merging task.
TASK_WORDS = 2_000_000
#: Parts of a language in which its phrases are ranked before they are ranked together.
PARTS = 64
BREAKS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b" \x09"
MESSAGE = "task bigint, slice bigint, prefixes binary, sizes binary, nexts binary, counts binary"
ANSWER = "slice bigint, grams binary, totals binary, named binary"
STATE = "kind int, slice bigint, lang string, vocab binary, codes binary, heavy binary, phrase string, a bigint"


def squeeze(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(3).compress(x)


def expand(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def slice_words(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, int]:
    """Vocabulary of a slice, its words as numbers from 1 with 0 between pieces and texts, and the number of words."""
    n = len(data)
    low = np.where((data >= 65) & (data <= 90), data | 32, data)
    broken = np.isin(data, np.frombuffer(BREAKS, np.uint8))
    word = ~(broken | np.isin(data, np.frombuffer(BLANKS, np.uint8)))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return [], np.zeros(0, np.int64), 0
    h = hashes(low, starts, ends)
    _, at, code, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    # Frequent words get the small numbers, which leaves their upper bytes to compress.
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at, code = at[order], rank[code]
    cuts = np.cumsum(broken, dtype=np.int32)[starts] + np.searchsorted(offsets, starts, side="right")
    place = np.arange(len(starts)) + np.append(0, np.cumsum(cuts[1:] != cuts[:-1]))
    codes = np.zeros(int(place[-1]) + 1, np.int64)
    codes[place] = code + 1
    raw = low.tobytes()
    return [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], codes, len(starts)


def word_hashes(vocab: list[bytes], lang: str) -> np.ndarray:
    """Hash of each word of a vocabulary, apart by language; number 0 is no word."""
    lengths = np.array([len(w) for w in vocab], np.int64)
    ends = np.cumsum(lengths)
    h = hashes(np.frombuffer(b"".join(vocab), np.uint8), ends - lengths, ends)
    return np.append(np.uint64(0), mix(h ^ language_hash(lang)))


def language_hash(lang: str) -> np.uint64:
    raw = np.frombuffer(lang.encode(), np.uint8)
    return hashes(raw, np.zeros(1, np.int64), np.full(1, len(raw)))[0]


def extend(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase by the hashes of its prefix and its last word."""
    return mix(prefix * ROLL + word)


def starts_of(codes: np.ndarray, k: int) -> np.ndarray:
    """Places where k words follow each other without a break."""
    ok = codes > 0
    out = ok[: max(len(codes) - k + 1, 0)].copy()
    for j in range(1, k):
        out &= ok[j : j + len(out)]
    return np.flatnonzero(out)


def gram_hashes(codes: np.ndarray, at: np.ndarray, h: np.ndarray, lang: str, k: int) -> np.ndarray:
    out = np.full(len(at), language_hash(lang))
    for j in range(k):
        out = extend(out, h[codes[at + j]])
    return out


def unpack_state(vocab: bytes, codes: bytes) -> tuple[list[bytes], np.ndarray]:
    words = expand(vocab)
    return words.split(b"\n") if words else [], from_planes(expand(codes))


def cut(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """Slices of the input as rows; a slice holds one language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang")
            for name in pc.unique(langs).to_pylist():
                data, offsets = text_bytes(batch.column("text").filter(pc.equal(langs, name)))
                for lo, hi in slices(offsets, SLICE):
                    vocab, codes, n = slice_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    if n:
                        columns = [pa.array([name]), pa.array([n]), pa.array([squeeze(b"\n".join(vocab))], pa.binary()), pa.array([squeeze(planes(codes))], pa.binary())]
                        yield pa.record_batch(columns, ["lang", "n", "vocab", "codes"])

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    made = rows.mapInArrow(releasing(run), "lang string, n bigint, vocab binary, codes binary")
    return pin(made.withColumn("slice", F.monotonically_increasing_id()).withColumn("heavy", F.lit(None).cast("binary")), "slices", packed=True)


def parts_of(prefix: np.ndarray, heavy: bytes | None, k: int, tasks: int) -> np.ndarray:
    """Into how many parts the stripe of each prefix is cut, the same in every slice."""
    if k == 1:
        return np.full(len(prefix), tasks, np.uint64)
    parts = np.ones(len(prefix), np.uint64)
    if heavy:
        known, many = np.frombuffer(heavy, np.uint64).reshape(2, -1)
        at = np.minimum(np.searchsorted(known, prefix), len(known) - 1)
        parts = np.where(known[at] == prefix, many[at], parts)
    return np.minimum(parts, np.uint64(tasks))


def stripes(state: DataFrame, k: int, least: int, tasks: int) -> DataFrame:
    """Merged stripes of prefixes of k-1 words, as answers to the slices: the frequent phrases they hold, and who names each."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vocab, codes = unpack_state(row["vocab"], row["codes"])
                h = word_hashes(vocab, row["lang"])
                at = starts_of(codes, k)
                prefix = gram_hashes(codes, at, h, row["lang"], k - 1)
                word = h[codes[at + k - 1]]
                _, one, count = np.unique(extend(prefix, word), return_index=True, return_counts=True)
                prefix, word = prefix[one], word[one]
                part = mix(word + ROLL) % parts_of(prefix, row["heavy"], k, tasks)
                task = ((mix(prefix) >> np.uint64(1)) + part) % np.uint64(tasks)
                order = np.lexsort((word, prefix, task))
                task, prefix, word, count = task[order], prefix[order], word[order], count[order]
                cuts = np.flatnonzero(np.append(True, task[1:] != task[:-1])) if len(task) else []
                rows = []
                for lo, hi in zip(cuts, [*cuts[1:], len(task)], strict=True) if len(task) else ():
                    p = prefix[lo:hi]
                    first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
                    sizes = np.diff(np.append(first, hi - lo))
                    rows.append((int(task[lo]), row["slice"], p[first].tobytes(), planes(sizes), word[lo:hi].tobytes(), planes(count[lo:hi])))
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                names = ["task", "slice", "prefixes", "sizes", "nexts", "counts"]
                yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    def merge(table: pa.Table, starts: np.ndarray) -> pa.Table:
        out = []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            rows = table.slice(lo, hi - lo).to_pylist()
            prefix = np.concatenate([np.repeat(np.frombuffer(r["prefixes"], np.uint64), from_planes(r["sizes"])) for r in rows])
            word = np.concatenate([np.frombuffer(r["nexts"], np.uint64) for r in rows])
            count = np.concatenate([from_planes(r["counts"]) for r in rows])
            source = np.repeat(np.arange(len(rows)), [len(r["nexts"]) // 8 for r in rows])
            gram = extend(prefix, word)
            order = np.argsort(gram, kind="stable")
            first = np.flatnonzero(np.append(True, gram[order][1:] != gram[order][:-1]))
            total = np.add.reduceat(count[order], first)
            each = np.repeat(total, np.diff(np.append(first, len(order))))
            named = np.zeros(len(order), bool)
            named[first] = True
            keep = each >= least
            order, each, named = order[keep], each[keep], named[keep]
            # By slice; within a slice in the order of the hashes.
            by = np.argsort(source[order], kind="stable")
            order, each, named = order[by], each[by], named[by]
            own = source[order]
            cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else []
            for a, b in zip(cuts, [*cuts[1:], len(own)], strict=True) if len(own) else ():
                out.append((rows[own[a]]["slice"], gram[order[a:b]].tobytes(), planes(each[a:b]), named[a:b].tobytes()))
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
        names = ("slice", "grams", "totals", "named")
        return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(zip(names, kinds, strict=True))})

    sent = state.select("slice", "lang", "vocab", "codes", "heavy").mapInArrow(releasing(send), MESSAGE)
    return by_group(sent, ["task"], merge, ANSWER)


def advance(state: DataFrame, answers: DataFrame, k: int, last: bool) -> DataFrame:
    """Slices with the answers they got: phrases to name (kind 1) and, unless this is the last length, what may be extended (kind 0)."""

    def step(table: pa.Table, starts: np.ndarray) -> pa.Table:
        out = []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            rows = table.slice(lo, hi - lo).to_pylist()
            told = [r for r in rows if r["codes"] is None]
            if not told:
                continue
            slice_ = next(r for r in rows if r["codes"] is not None)
            lang = slice_["lang"]
            vocab, codes = unpack_state(slice_["vocab"], slice_["codes"])
            grams, totals, named = (np.concatenate([f(r[c]) for r in told]) for c, f in (("grams", lambda x: np.frombuffer(x, np.uint64)), ("totals", from_planes), ("named", lambda x: np.frombuffer(x, bool))))
            order = np.argsort(grams)
            grams, totals, named = grams[order], totals[order], named[order]
            at = starts_of(codes, k)
            own = gram_hashes(codes, at, word_hashes(vocab, lang), lang, k)
            found = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            hit = grams[found] == own
            at, found = at[hit], found[hit]
            place = np.zeros(len(grams), np.int64)
            place[found] = at
            for i in np.flatnonzero(named).tolist():
                words = b" ".join(vocab[c - 1] for c in codes[place[i] : place[i] + k].tolist())
                out.append((1, slice_["slice"], lang, None, None, None, words.decode(), int(totals[i])))
            if last or not len(at):
                continue
            run = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1))
            size = np.diff(np.append(run, len(at)))
            begin, length = at[run][size > 1], size[size > 1] + k - 1
            ends = np.cumsum(length + 1)
            left = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
            # The word at place p of a run goes as far from the run's start as it was; a break follows each run.
            at = np.repeat(ends - length - 1, length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
            left[at] = codes[np.repeat(begin - (ends - length - 1), length) + at]
            if not len(left):
                continue
            used = np.unique(left)
            used = used[used > 0]
            number = np.zeros(len(vocab) + 1, np.int64)
            number[used] = np.arange(1, len(used) + 1)
            many = np.flatnonzero(totals > PART)
            heavy = np.concatenate([grams[many], (totals[many] // PART + 1).astype(np.uint64)]).tobytes() if len(many) else None
            out.append((0, slice_["slice"], lang, squeeze(b"\n".join([vocab[c - 1] for c in used.tolist()])), squeeze(planes(number[left])), heavy, None, None))
        kinds = (pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.int64())
        names = ("kind", "slice", "lang", "vocab", "codes", "heavy", "phrase", "a")
        return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(zip(names, kinds, strict=True))})

    both = state.select("slice", "lang", "vocab", "codes").unionByName(answers, allowMissingColumns=True)
    return by_group(both, ["slice"], step, STATE)


def frequent_phrases(docs: DataFrame, longest: int = 5, least: int = 100, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All phrases of up to `longest` words with `least` occurrences or more (lang, phrase, k, a), and words by language (lang, n)."""
    spark = docs.sparkSession
    state = cut(docs, lang, text)
    words = pin(state.groupBy("lang").agg(F.sum("n").alias("n")), "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_WORDS))
    found = None
    for k in range(1, longest + 1):
        out = pin(advance(state, stripes(state, k, least, tasks), k, k == longest), "phrases", by="kind", packed=True)
        named = out.where("kind = 1").select("lang", "phrase", F.lit(k).alias("k"), "a")
        found = named if found is None else found.unionByName(named)
        state = out.where("kind = 0")
    return found, words


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, percent: int = 100, top: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """The phrases of each language whose parts belong together most.

    docs: a text and a language; other columns are ignored. A-Z are lower-cased, texts split at `.,;:!?` and \\x0A-\\x0D
    into pieces, those at blanks and tabs into words. Candidates have 2 to `longest` words and a >= `least` occurrences,
    overlapping ones included. A cut after k words scores floor(1000 * a * n / (l * r)), with l and r the occurrences of
    the first words and the rest, and n all words of the language; the lowest-scoring cut counts, of equal ones that with
    the smallest k. A candidate goes if it lies inside a longer one with at least `percent` % of its occurrences. Returned
    are each language's `top` by score, occurrences (both descending) and phrase: lang, rank, phrase, a, l, r, n, score.

    A null text has no words; rows without a language are of language `und`, as are those that say so; repeated rows count
    each time. Products are computed in 38 digits. No candidates: an empty result.
    """
    found, words = frequent_phrases(docs, longest, least, lang, text)
    found = pin(found, "frequent-phrases")
    part = F.split("phrase", " ")

    def joined(first: int | F.Column, length: F.Column) -> F.Column:
        return F.array_join(F.slice(part, first, length), " ")

    # A phrase inside a longer one is inside one that has a single word more and at least as many occurrences.
    inner = F.array(joined(1, F.col("k") - 1), joined(2, F.col("k") - 1))
    bound = found.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "a")
    bound = bound.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = found.where("k > 1").join(bound, ["lang", "phrase"], "left")
    kept = kept.where(F.col("most").isNull() | (F.lit(100) * F.col("most") < F.lit(percent) * F.col("a")))
    cuts = kept.select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", joined(1, F.col("cut")).alias("head"), joined(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail"))
    known = found.select("lang", "phrase", "a")
    cuts = cuts.join(known.toDF("lang", "head", "l"), ["lang", "head"]).join(known.toDF("lang", "tail", "r"), ["lang", "tail"]).join(words, "lang")

    def wide(c: str, digits: int) -> F.Column:
        return F.col(c).cast(f"decimal({digits},0)")

    cuts = cuts.withColumn("up", F.lit(1000).cast("decimal(4,0)") * wide("a", 15) * wide("n", 18)).withColumn("down", wide("l", 18) * wide("r", 18))
    scored = cuts.withColumn("score", F.expr("up div down")).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    flat = scored.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    # The first of a language lie in the powers of two that hold its highest scores; the rest needs no order.
    power = F.floor(F.log2(F.col("score") + 1)).cast("int")
    flat = pin(flat.withColumn("power", power), "scored-phrases")
    above = Window.partitionBy("lang").orderBy(F.desc("power"))
    # At most 64 rows per language.
    sizes = flat.groupBy("lang", "power").agg(F.count("*").alias("m")).withColumn("upto", F.sum("m").over(above))
    least = sizes.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("upto") >= top, F.col("power"))), F.lit(-1)).alias("least"))
    flat = flat.join(least, "lang").where("power >= least").drop("power", "least")
    # What is not among the first of its part of a language is not among the first of the language.
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(F.desc("score"), F.desc("a"), "phrase")
    flat = flat.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top).drop("rank")
    ranked = flat.withColumn("rank", F.row_number().over(best).cast("bigint"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
