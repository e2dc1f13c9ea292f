"""Language identification: multinomial logistic regression on TF-IDF of character n-grams, trained by FTRL.

Features are lower-cased character n-grams of one to three characters, hashed into a fixed number of places, weighted by
their logarithmic frequency and inverse document frequency, and scaled to length one. The model is trained by
follow-the-regularised-leader with an elastic-net penalty, which leaves most weights at zero, on a bounded sample of the
labelled rows, taken from each language alike so that a rare one is learnt as well; document frequencies are counted over all
of them. A temperature fitted on a part of the sample that the weights have not seen turns scores into probabilities, in
which each language has the share that it has among all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xmseq.llm.groups import release, releasing

UNKNOWN = "und"
GRAMS = (1, 2, 3)
PLACES = 1 << 14
#: Labelled rows the weights are fitted on: of each language those with the smallest hashes, an equal part of this number
#: and LEAST at least.
SAMPLE = 6000
LEAST = 50
FEW = 4
#: Every fifth of a language's rows fits the temperature.
FIFTH = 5
#: Rows of a language with less than a tenth of an equal part are gone through up to so many times an epoch.
REPEATS = 20
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.001
SLICE = 1 << 20
TURN = np.uint32(0x9E3779B1)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float
    #: Log of each language's share of all labelled rows over that of what the weights were fitted on.
    prior: np.ndarray


def counts_of(text: str) -> np.ndarray:
    """How often each place is hit by the n-grams of a text; a long text is counted in pieces."""
    out = np.zeros(PLACES, np.int64)
    for at in range(0, len(text), SLICE):
        # Pieces overlap, so that no n-gram is lost; those inside the overlap belong to the earlier piece.
        part = text[at : at + SLICE + max(GRAMS) - 1].lower()
        x = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        h = np.zeros(len(x), np.uint32)
        for n in range(1, max(GRAMS) + 1):
            if len(x) < n:
                break
            h = (h[: len(x) - n + 1] * TURN + x[n - 1 :] + np.uint32(1)) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
            if n in GRAMS:
                own = h if at + SLICE >= len(text) else h[:SLICE]
                out += np.bincount(own >> np.uint32(32 - 14), minlength=PLACES)
    return out


def features(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a TF-IDF vector of length one."""
    place = np.flatnonzero(counts)
    value = (1 + np.log(counts[place])) * idf[place]
    size = np.sqrt((value * value).sum())
    return place, value / size if size > 0 else value


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(labelled: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each place occurs, over all rows. A task sends one row per place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(PLACES, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                df += counts_of(text or "") > 0
                n += 1
        yield pa.record_batch([pa.array(np.arange(PLACES + 1)), pa.array(np.append(df, n))], ["place", "n"])

    sums = labelled.select("text").mapInArrow(releasing(run), "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n"))
    out = np.zeros(PLACES + 1, np.int64)
    for place, n in sums.collect():
        out[place] = n
    return out[:PLACES], int(out[PLACES])


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], langs: int, epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal weights (places x langs) of rows (places, values, label), which may be in small types: one is widened at a time."""
    z, n = np.zeros((PLACES, langs)), np.zeros((PLACES, langs))

    def weights(place: np.ndarray | slice) -> np.ndarray:
        zs, ns = z[place], n[place]
        w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2)
        return np.where(np.abs(zs) <= L1, 0.0, w)

    for _ in range(epochs):
        for short, single, label in rows:
            place, value = short.astype(np.int64), single.astype(float)
            w = weights(place)
            p = softmax(value @ w)
            p[label] -= 1
            g = value[:, None] * p
            ns = n[place]
            z[place] += g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
            n[place] = ns + g * g
    return weights(slice(None))


def best_temperature(logits: np.ndarray, labels: np.ndarray, prior: np.ndarray, row_weights: np.ndarray) -> float:
    """The temperature of least weighted log loss, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t) + prior)
        return -(row_weights * np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12))).sum()

    lo, hi, ratio = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def taught_and_held(labels: np.ndarray, langs: int, part: int) -> tuple[list[int], list[int]]:
    """Rows to fit the weights on, those of rare languages several times, and rows to fit the temperature on."""
    taught: list[tuple[int, int]] = []
    held: list[int] = []
    for lang in range(langs):
        own = np.flatnonzero(labels == lang).tolist()
        mine = own[::FIFTH] if len(own) >= 2 * FIFTH else []
        held += mine
        rest = [i for i in own if i not in set(mine)]
        times = min(max(part // (10 * len(rest)), 1), REPEATS)
        taught += [(turn, i) for turn in range(times) for i in rest]
    return [i for _, i in sorted(taught)], sorted(held)


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from (doc_id, text, lang); rows without lang or letters teach nothing.

    Document frequencies cover all rows. The weights are fitted on the rows of each language with the smallest hashes of
    doc_id, `sample` over the number of languages of them, and 50 at least where there are so many; of a language with many
    rows they are chosen among about four times as many, by a hash of id and text.
    """
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    df, n = document_frequencies(labelled)
    idf = np.log((1 + n) / (1 + df)) + 1
    # A row per language; the model has a column for each.
    shares = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(shares)
    if not langs:
        return Model([], idf, np.zeros((PLACES, 0)), 1.0, np.zeros(0))
    part = max(LEAST, sample // len(langs))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))

    def first(rows: DataFrame, *order: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
        return rows.withColumn("place", place).where(F.col("place") <= part).drop("place")

    # Of a language with many rows about FEW times `part` are looked at, by a hash of their own: so many come to one task.
    bars = [(lang, min(1.0, FEW * part / n)) for lang, n in shares.items()]
    bars = labelled.sparkSession.createDataFrame(bars, "lang string, bar double")
    own = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    some = labelled.select("doc_id", "lang", key.alias("k"), own.alias("own")).join(F.broadcast(bars), "lang").where("own < bar")
    ids = first(some.select("doc_id", "lang", "k"), "k", "doc_id").select("doc_id", "lang").distinct()
    # `part` ids of a language at most.
    chosen = labelled.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(counts_of(t), idf) for t in batch.column("text").to_pylist()]
            places = [p.astype("<u2").tobytes() for p, _ in rows]
            values = [v.astype("<f4").tobytes() for _, v in rows]
            columns = [batch.column("lang"), batch.column("k"), pa.array(places, pa.binary()), pa.array(values, pa.binary())]
            yield pa.record_batch(columns, ["lang", "k", "places", "values"])

    # Rows of the ids chosen, which may share an id, under the same bar.
    chosen = chosen.withColumn("own", own).join(F.broadcast(bars), "lang").where("own < bar")
    made = chosen.select("text", "lang", key.alias("k")).mapInArrow(releasing(run), "lang string, k string, places binary, values binary")
    found = first(made, "k", "places", "values").orderBy("k", "lang", "places", "values").collect()
    # Views of the bytes that came: widened, the sample would take four times its size and more in the driver.
    rows = [(np.frombuffer(r["places"], "<u2"), np.frombuffer(r["values"], "<f4"), langs.index(r["lang"])) for r in found]
    labels = np.array([y for _, _, y in rows], np.int64)
    taught, held = taught_and_held(labels, len(langs), part)
    w = fit([rows[i] for i in taught], len(langs))
    seen = np.bincount(labels[taught], minlength=len(langs)) / len(taught)
    share = np.array([shares[x] for x in langs]) / sum(shares.values())
    prior = np.log(share / seen)
    logits = np.array([rows[i][1].astype(float) @ w[rows[i][0]] for i in held]).reshape(-1, len(langs))
    del found, rows
    release()
    # Held rows count by the share of their language.
    each = share[labels[held]] / np.bincount(labels[held], minlength=len(langs))[labels[held]]
    return Model(langs, idf, w, best_temperature(logits, labels[held], prior, each), prior)


def predict(docs: DataFrame, m: Model) -> DataFrame:
    """All columns of `docs` with lang_pred and score, the probability of that language; of equal ones the first by name.

    A text that is null or has no letter is `und` with score 0. Whole texts count, long ones in pieces. Columns of these two
    names are replaced, others stay; rows that are equal are judged alike.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = [], []
            for text in batch.column("text").to_pylist():
                if text is None or not m.langs or not any(map(str.isalpha, text)):
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    continue
                place, value = features(counts_of(text), m.idf)
                p = softmax(value @ m.weights[place] / m.temperature + m.prior)
                best = int(p.argmax())
                lang.append(m.langs[best])
                score.append(float(p[best]))
            yield pa.record_batch([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType([*docs.schema.fields, *added])
    return docs.mapInArrow(releasing(run), schema)


def held_out_languages(docs: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of `docs` (doc_id, text, lang).

    Held out, and not learnt from, are rows whose crc32(doc_id as text) mod `folds` is `fold`, and those without doc_id.
    """
    docs = docs.select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(True))
    model = train(docs.where(~held))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
