"""Document fingerprints: MinHash over 5-word shingles, their likeness, and near-duplicates by signature bands.

A fingerprint is 128 minima of 16 bits, written as hexadecimal digits. The likeness of two fingerprints, the share of equal
minima, estimates the Jaccard similarity of the shingle sets. Words are as in `words`, with A-Z lower-cased.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xmseq.llm.minhash import signatures
from xmseq.llm.store import components
from xmseq.llm.verify import confirmed
from xmseq.llm.words import bounds, hashes, shingles, slices, text_bytes
from xmseq.storage import pin

MINIMA = 128
WORDS = 5
SEED = 11
ROWS = 256
#: Bands of five minima: a pair of likeness 0.8 shares none of 25 once in 20,000.
BANDS, BAND_ROWS = 25, 5


def fingerprint_matrix(texts: pa.Array, k: int = WORDS, minima: int = MINIMA) -> np.ndarray:
    """A row of 16-bit minima for each text; texts without words have the largest number everywhere."""
    data, offsets = text_bytes(texts)
    parts = [np.zeros((0, minima), np.uint16)]
    for lo, hi in slices(offsets):
        part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, counts = bounds(part, own)
        found, n = shingles(hashes(part, starts, ends, lower=True), counts, k)
        parts.append((signatures(found, n, minima, SEED) >> np.uint32(16)).astype(np.uint16))
    return np.concatenate(parts)


def hex_of(matrix: np.ndarray) -> list[str]:
    return [r.astype(">u2").tobytes().hex() for r in matrix]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def edited(text: str, following: str) -> str:
    """`text` with its last half of code points replaced by as many from the start of `following`, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row of (doc_id, text); a null text counts as empty. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.record_batch([part.column("doc_id"), pa.array(hex_of(fingerprint_matrix(part.column("text"))))], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string")


def place(ids: pa.Array, cuts: np.ndarray) -> np.ndarray:
    """The range of each id: the number of cuts below it; 0 for a null."""
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    return np.where(known, np.searchsorted(cuts, ids.fill_null(0).to_numpy()), 0).astype(np.int32)


def ranges(ids: DataFrame, parts: int) -> tuple[np.ndarray, dict[int, tuple[int, int | None]]]:
    """Cuts of `parts` or fewer ascending ranges of doc_id; by range, the range before it and its first id (None: null).

    Cuts are quantiles, so a range holds no more than its share of distinct ids. The range before the first is the last.
    """
    share = [i / parts for i in range(1, parts)]
    found = ids.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, share)), 100 * parts)).first()[0] if share else None
    cuts = np.array(sorted(set(found or [])), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.array(place(batch.column("doc_id"), cuts))
            yield pa.record_batch([part, batch.column("doc_id").cast(pa.int64())], ["part", "id"])

    each = ids.mapInArrow(run, "part int, id bigint").groupBy("part")
    firsts = {r["part"]: None if r["gaps"] else r["first"] for r in each.agg(F.min("id").alias("first"), F.count_if(F.isnull("id")).alias("gaps")).collect()}
    order = sorted(firsts)
    return cuts, {p: (order[i - 1], firsts[p]) for i, p in enumerate(order)}


def edit_report(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """How far the fingerprint of each text follows an edit, the next text taking over its second half.

    docs: doc_id, text. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Next
    is the following doc_id, null ids first and rows of equal ids in a fixed order; after the last comes the first. A null
    text is empty. The texts are shuffled once, compressed, into ranges of ids; the first row of a range is also sent behind
    the range before it.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts, homes = ranges(docs.select("doc_id"), parts)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3)
        for batch in batches:
            ids, part = batch.column("doc_id"), place(batch.column("doc_id"), cuts)
            blobs = [pack.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
            leads = [i for i, (p, x) in enumerate(zip(part.tolist(), ids.to_pylist(), strict=True)) if homes[p][1] == x]
            rows = np.append(np.arange(len(blobs)), np.array(leads, np.int64))
            part = np.append(part, np.array([homes[p][0] for p in part[leads].tolist()], np.int32))
            guest = rows * 0 > 0
            guest[len(blobs) :] = True
            yield pa.record_batch(
                [ids.take(pa.array(rows)), pa.array(part.astype(np.int32)), pa.array(guest), pa.array([blobs[i] for i in rows], pa.binary())],
                ["doc_id", "part", "guest", "z"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    small = docs.select("doc_id", "text").mapInArrow(squeeze, f"doc_id {kind}, part int, guest boolean, z binary")
    dealt = small.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "guest", "doc_id", "z")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        held: list[tuple] = []  # rows whose following row has not come yet, or too few of them
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [unpack.decompress(z).decode() for z in part.column("z").to_pylist()]
                held += zip(part.column("doc_id").to_pylist(), part.column("part").to_pylist(), part.column("guest").to_pylist(), texts, strict=True)
                yield from report(held)
                held = held[-1:]

    def report(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        pairs = [(a, b) for a, b in zip(rows[:-1], rows[1:], strict=True) if not a[2] and a[1] == b[1]]
        if not pairs:
            return
        changed = [edited(a[3], b[3]) for a, b in pairs]
        every = fingerprint_matrix(pa.array([r[3] for r in rows], pa.large_string()))
        other = fingerprint_matrix(pa.array(changed, pa.large_string()))
        at = np.array([i for i, (a, b) in enumerate(zip(rows[:-1], rows[1:], strict=True)) if not a[2] and a[1] == b[1]])
        own, following = every[at], every[at + 1]
        yield pa.record_batch(
            [
                pa.array([a[0] for a, _ in pairs], batch_kind),
                pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                pa.array(hex_of(own)),
                pa.array(hex_of(other)),
                pa.array(likeness(own, other)),
                pa.array(likeness(own, following)),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    batch_kind = pa.int64() if kind == "bigint" else pa.int32()
    return dealt.mapInArrow(
        run,
        f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


def near_documents(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, component_id (the smallest doc_id reachable by links), kept.

    Links have 5-word shingle sets of Jaccard percent/100 or more. Documents whose signatures agree in a band are candidates:
    they are joined to the smallest document of the band, so a band shared by many costs one row each; the groups this
    makes are confirmed on the full sets. Equal texts are one candidate. A null or empty text links with nothing, nor
    does a row without doc_id, whose component is null; both are kept. Rows that share a doc_id are one document.
    """
    docs = docs.select("doc_id", "text")
    named = docs.where("doc_id is not null and text is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("same"))
    classes = pin(named.groupBy("same").agg(F.min("doc_id").alias("rep")), "text-classes")

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                m = fingerprint_matrix(part.column("text"))
                rows = np.flatnonzero((m != 0xFFFF).any(axis=1))
                found = m[rows, : BANDS * BAND_ROWS].reshape(-1, BAND_ROWS)
                ids = part.column("doc_id").take(pa.array(np.repeat(rows, BANDS)))
                band = pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(rows)))
                yield pa.record_batch([ids, band, pa.array([x.tobytes() for x in found], pa.binary())], ["doc_id", "band", "minima"])

    reps = docs.join(classes.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    posted = pin(reps.mapInArrow(bands, "doc_id bigint, band int, minima binary"), "bands")
    shared = posted.groupBy("band", "minima").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    links = posted.join(shared, ["band", "minima"]).select(F.col("doc_id").alias("u"), F.col("first").alias("v")).distinct()
    joined = confirmed(docs, pin(components(links), "candidate-groups"), WORDS, percent)
    known = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("same", F.coalesce("component", "rep").alias("component_id"))
    empty = F.lit("").cast("binary")
    rows = docs.select("doc_id", F.sha2(F.coalesce(F.col("text").cast("binary"), empty), 256).alias("same"), F.col("text").rlike(r"[^\x20\x09-\x0D]").alias("has_words"))
    rows = rows.join(known, "same", "left")
    some = F.col("has_words") & F.col("doc_id").isNotNull()
    return rows.select(
        "doc_id", F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
