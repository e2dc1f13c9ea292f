"""Texts as vectors by a bidirectional encoder over subwords, with vocabulary and weights given as tables.

Spark cuts texts at white space; a task cuts each distinct word of an Arrow batch into pieces once, by longest match in a
trie, and runs texts of similar length together. Nothing is shuffled. Vocabulary and weights do not grow with the data; their
size is checked before they are broadcast.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xmseq.model import ITEM, TEXT, VECTOR
from xmseq.operators.encoder import ACTIVATIONS, SLICE_CELLS, _linear, _norm
from xmseq.operators.matrix import to_lists
from xmseq.operators.params import collect_params
from xmseq.storage import BROADCAST_BYTES, SMALL_ROWS, fits

# Special pieces, the mark of a piece within a word, and parameter names of the public model format.
UNKNOWN, FIRST, LAST, INSIDE = "[UNK]", "[CLS]", "[SEP]", "##"
WORDS = "embeddings.word_embeddings.weight"
PLACES = "embeddings.position_embeddings.weight"
KINDS = "embeddings.token_type_embeddings.weight"
INPUT_NORM = "embeddings.LayerNorm"
LAYER = "encoder.layer.{}."
QUERY, KEY, VALUE = "attention.self.query", "attention.self.key", "attention.self.value"
MIXED, MIXED_NORM = "attention.output.dense", "attention.output.LayerNorm"
INNER, OUTER, OUTER_NORM = "intermediate.dense", "output.dense", "output.LayerNorm"
MAX_TOKENS = 512
TEXT_HEADS = 12
LONGEST_WORD = 100

#: A node of a trie: next letters, and under "" the number of the piece that ends here.
Trie = dict


def trie_of(pieces: dict[str, int]) -> Trie:
    root: Trie = {}
    for piece, number in pieces.items():
        node = root
        for letter in piece:
            node = node.setdefault(letter, {})
        node[""] = number
    return root


def longest_match(trie: Trie, word: str, at: int) -> tuple[int, int] | None:
    """End and number of the longest piece that starts at `at`."""
    found = None
    for i in range(at, len(word)):
        trie = trie.get(word[i])
        if trie is None:
            break
        if "" in trie:
            found = i + 1, trie[""]
    return found


def wordpieces(word: str, starts: Trie, inside: Trie, unknown: int) -> list[int]:
    """Numbers of the pieces of a word, or the unknown one alone if some part of it, or its length, fits none."""
    if len(word) > LONGEST_WORD:
        return [unknown]
    out, at = [], 0
    while at < len(word):
        found = longest_match(inside if at else starts, word, at)
        if found is None:
            return [unknown]
        at, number = found
        out.append(number)
    return out


def is_mark(letter: str) -> bool:
    """Punctuation and signs stand alone, and so do letters of scripts without spaces."""
    code = ord(letter)
    if code < 128:
        return 33 <= code and not letter.isalnum()
    return unicodedata.category(letter).startswith("P") or unicodedata.name(letter, "").startswith("CJK ")


def simple_words(chunk: str) -> list[str]:
    """A run without white space as lower-case words and marks, without accents and control characters."""
    out: list[str] = []
    joined = False
    for letter in unicodedata.normalize("NFD", chunk.lower()):
        kind = unicodedata.category(letter)
        if kind == "Mn" or kind in ("Cc", "Cf") or letter == "�":
            continue
        if letter.isspace():
            joined = False
        elif is_mark(letter):
            out.append(letter)
            joined = False
        elif joined:
            out[-1] += letter
        else:
            out.append(letter)
            joined = True
    return out


def encode_first(ids: np.ndarray, lengths: np.ndarray, p: dict, layers: int, heads: int, act: str) -> np.ndarray:
    """Output at the first place of texts (batch, place) of piece numbers, filled up on the right.

    Every place sees all places of its text. Of the last layer only the first place is worked out.
    """
    batch, places = ids.shape
    x = _norm(p, INPUT_NORM, p[WORDS][ids] + p[PLACES][:places] + p[KINDS][0])
    width = x.shape[-1]
    padding = np.where(np.arange(places) < lengths[:, None], 0.0, -np.inf)[:, None, None, :]

    def projected(name: str, inputs: np.ndarray) -> np.ndarray:
        return _linear(p, name, inputs).reshape(batch, -1, heads, width // heads).transpose(0, 2, 1, 3)

    for n in range(layers):
        name = LAYER.format(n)
        asking = x[:, :1] if n == layers - 1 else x
        scores = projected(name + QUERY, asking) @ projected(name + KEY, x).transpose(0, 1, 3, 2) / math.sqrt(width // heads) + padding
        weights = np.exp(scores - scores.max(axis=-1, keepdims=True))
        weights /= weights.sum(axis=-1, keepdims=True)
        context = (weights @ projected(name + VALUE, x)).transpose(0, 2, 1, 3).reshape(asking.shape)
        hidden = _norm(p, name + MIXED_NORM, _linear(p, name + MIXED, context) + asking)
        x = _norm(p, name + OUTER_NORM, _linear(p, name + OUTER, ACTIVATIONS[act](_linear(p, name + INNER, hidden))) + hidden)
    return x[:, 0]


def collect_vocabulary(vocabulary: DataFrame, limit_bytes: int) -> dict[str, int]:
    if not fits(vocabulary.select("piece", "id"), SMALL_ROWS, limit_bytes):
        raise ValueError(f"the vocabulary has more than {SMALL_ROWS} pieces or {limit_bytes} bytes")
    found = {r["piece"]: r["id"] for r in vocabulary.select("piece", "id").collect()}
    missing = {UNKNOWN, FIRST, LAST} - set(found)
    if missing:
        raise ValueError(f"pieces not found: {', '.join(sorted(missing))}")
    return found


def encode_texts(
    texts: DataFrame,
    vocabulary: DataFrame,
    params: DataFrame,
    heads: int = TEXT_HEADS,
    act: str = "gelu",
    max_tokens: int = MAX_TOKENS,
    key: str = ITEM,
    text: str = TEXT,
    params_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(key, vector): output at the first place of each text, as single-precision numbers.

    vocabulary: piece, id, with pieces inside a word marked by ## and the special ones present. params: name, row, values, in
    the public names; the number of layers is read off them. Texts are lower-cased, freed of accents and control characters,
    cut at white space, marks and letters that stand alone, and each word into the longest pieces from its start; a word that
    does not work out is unknown as a whole. The first `max_tokens` pieces count, first and last special ones included. A
    null text is an empty one; every row gives a row, whatever its key.
    """
    if act not in ACTIVATIONS:
        raise ValueError(f"activation {act!r} is not one of {', '.join(ACTIVATIONS)}")
    numbers = collect_vocabulary(vocabulary, params_bytes)
    p = collect_params(params, params_bytes)
    rows, width = p[WORDS].shape
    if width % heads:
        raise ValueError(f"width {width} is not a multiple of {heads} heads")
    if max(numbers.values()) >= rows:
        raise ValueError(f"the model has {rows} pieces, the vocabulary more")
    if not 2 <= max_tokens <= len(p[PLACES]):
        raise ValueError(f"the model has {len(p[PLACES])} places, not {max_tokens}")
    layers = 0
    while LAYER.format(layers) + QUERY + ".weight" in p:
        layers += 1
    if not layers:
        raise ValueError("the model has no layer")
    chunks = F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), r"\s+")
    schema = T.StructType([T.StructField(key, texts.schema[key].dataType), T.StructField(VECTOR, T.ArrayType(T.FloatType()))])
    shared = texts.sparkSession.sparkContext.broadcast((numbers, p))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, p = shared.value
        starts = trie_of({w: n for w, n in numbers.items() if not w.startswith(INSIDE)})
        inside = trie_of({w[len(INSIDE) :]: n for w, n in numbers.items() if w.startswith(INSIDE)})
        unknown, first, last = (numbers[w] for w in (UNKNOWN, FIRST, LAST))
        for batch in batches:
            lists = batch.column("_chunks")
            coded = lists.flatten().dictionary_encode()
            cut = [[n for w in simple_words(c) for n in wordpieces(w, starts, inside, unknown)] for c in coded.dictionary.to_pylist()]
            size = np.array([len(c) for c in cut], np.int64)
            flat = np.array([n for c in cut for n in c], np.int64)
            word = coded.indices.to_numpy()
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            pieces = np.bincount(owner, size[word], len(lists)).astype(np.int64)
            lengths = np.minimum(pieces, max_tokens - 2)
            order = np.argsort(lengths, kind="stable")
            before = np.cumsum(size[word]) - size[word]
            place = before - (np.cumsum(pieces) - pieces)[owner]
            # One row of `ids` per text, in the order of their lengths; what lies beyond the limit is left out.
            spot = np.repeat(place, size[word]) + runs_of(size[word])
            number = flat[np.repeat((np.cumsum(size) - size)[word], size[word]) + runs_of(size[word])]
            kept = spot < max_tokens - 2
            offsets = np.append(0, np.cumsum(lengths))
            number = number[kept]
            found = np.empty((len(lists), width), np.float32)
            at = 0
            while at < len(order):
                step = max(1, SLICE_CELLS // (8 * width * int(lengths[order[min(at + 63, len(order) - 1)]] + 2)))
                some = order[at : at + step]
                most = int(lengths[some[-1]])
                ids = np.zeros((len(some), most + 2), np.int64)
                ids[:, 0] = first
                there = np.arange(most) < lengths[some][:, None]
                ids[:, 1:-1][there] = number[(offsets[some][:, None] + np.arange(most))[there]]
                ids[np.arange(len(some)), lengths[some] + 1] = last
                found[some] = encode_first(ids, lengths[some] + 2, p, layers, heads, act)
                at += step
            yield pa.RecordBatch.from_arrays([batch.column(key), to_lists(found)], schema.names)

    return texts.select(F.col(key), chunks.alias("_chunks")).mapInArrow(encode, schema)


def runs_of(counts: np.ndarray) -> np.ndarray:
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
