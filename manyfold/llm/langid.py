"""Language identification by string kernels.

The kernel of two texts is the blended-spectrum presence kernel: the number of character n-grams (n = 1..3, lower
case) that both contain, over the geometric mean of the numbers that each contains, counted over the n-grams that
any landmark has. Letters that are common in some language are symbols of their own, the others share CLASSES symbols
by their block of 256 code points, so scripts stay apart. Landmarks are a bounded sample of labelled texts (Nyström); one-versus-rest kernel ridge
regression is solved in the landmarks' span, and a batch of texts is scored by two matrix products.

Defined results: a text that is null or has no letter gets `und`, score 0, as every text does when nothing could be
learned. Rows with a null language teach nothing. Repeated rows and ids are scored one by one. Equal scores go to
the language that comes first in code-point order. Extra columns pass through `predict`; its result columns replace
input columns of their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkit as tk
from .common import extended

UNKNOWN = "und"
SYMBOLS, BITS, CLASSES = 128, 7, 16
#: Cells of the matrix of texts and n-grams that are worked on at once.
CELLS = 1 << 24
MOST_LANDMARKS = 4096
_LETTER = regex.compile(r"\p{L}")
_GRAMS = SYMBOLS + SYMBOLS**2 + SYMBOLS**3


@dataclass
class Model:
    """languages: sorted; symbols: code point -> symbol; grams: n-gram code -> column or -1; landmarks: columns x m,
    scaled to unit length; weights: m x languages. Bounded by the training parameters, not by the corpus."""

    languages: list[str]
    symbols: np.ndarray
    grams: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray


def sample(docs: DataFrame, teach, per_language: int, max_chars: int, max_rows: int, max_languages: int = 4096) -> list[tuple[str, str]]:
    """(text, language) of teaching rows by hash order: up to per_language of each language, fewer where that would make
    more than max_rows. Every language takes part; more than max_languages are an error of the tags. Rows are first
    chosen without their texts, then only the chosen texts are read."""
    rows = docs.where(teach & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= max_chars))
    keys = rows.select("lang", F.xxhash64("doc_id", "lang").alias("h"))
    n = keys.select("lang").distinct().count()
    if n > max_languages:
        raise ValueError(f"{n} languages, at most {max_languages} can be learned")
    per_language = max(1, min(per_language, max_rows // max(1, n)))
    order = Window.partitionBy("lang").orderBy("h")  # the limit is applied before the shuffle too
    last = keys.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language).groupBy("lang").agg(F.max("h").alias("last"))
    chosen = rows.join(F.broadcast(last), "lang").where(F.xxhash64("doc_id", "lang") <= F.col("last"))
    picked = chosen.select("text", "lang").limit(2 * per_language * max(1, n)).collect() if n else []
    return sorted((r["text"], r["lang"]) for r in picked)


def _symbols(texts: list[tuple[str, str]]) -> np.ndarray:
    """0: no letter; then the languages' commonest letters, in turn; the last CLASSES: any other letter."""
    ranked = []
    for lang in sorted({x for _, x in texts}):
        cps, n = np.unique(tk.code_points(tk.plain(pa.array([t.lower() for t, x in texts if x == lang])))[0], return_counts=True)
        ranked.append([c for _, c in sorted((-k, int(c)) for c, k in zip(cps, n) if chr(int(c)).isalpha())])
    turns = [c for row in itertools.zip_longest(*ranked) for c in row if c is not None]
    letters = list(dict.fromkeys(turns))[: SYMBOLS - CLASSES - 1]
    rank = {c: i + 1 for i, c in enumerate(letters)}
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = ord(s.lower()[0])
            table[c] = rank.get(low) or SYMBOLS - CLASSES + (low >> 8) * 40503 % 65536 % CLASSES
    return table


def _codes(texts: pa.Array, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, n-gram code) for n = 1, 2, 3; runs of non-letters count as one."""
    cps, off = tk.code_points(texts)
    s = symbols[cps].astype(np.int32)
    owner = tk.owners(off)
    keep = np.ones(len(s), bool)
    if len(s):
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0) | (owner[1:] != owner[:-1])
    s, owner = s[keep], owner[keep]
    yield owner, s
    same = owner[1:] == owner[:-1]
    two = (s[:-1] << BITS) | s[1:]
    yield owner[1:][same], two[same] + SYMBOLS
    if len(s) > 2:
        same = owner[2:] == owner[:-2]
        yield owner[2:][same], ((two[:-1] << BITS) | s[2:])[same] + (SYMBOLS + SYMBOLS**2)


def _presence(texts: pa.Array, symbols: np.ndarray, grams: np.ndarray, width: int) -> np.ndarray:
    found = np.zeros((len(texts), width + 1), np.float32)
    for owner, code in _codes(texts, symbols):
        found[owner, grams[code]] = 1  # -1 falls into the spare column
    found = found[:, :width]
    return found / np.maximum(np.sqrt(found.sum(1, keepdims=True)), 1)


def fit(rows: list[tuple[str, str]], landmarks_per_language: int = 48, ridge: float = 1e-2) -> Model:
    """A model of (text, language) rows; the first rows of each language, in the order given, are its landmarks."""
    languages = sorted({lang for _, lang in rows})
    landmarks_per_language = max(1, min(landmarks_per_language, MOST_LANDMARKS // max(1, len(languages))))
    pairs = [p for lang in languages for p in [p for p in rows if p[1] == lang][:landmarks_per_language]]
    marks, symbols = [t for t, _ in pairs], _symbols(pairs)
    grams = np.full(_GRAMS, -1, np.int32)
    codes = [c for _, c in _codes(tk.plain(pa.array(marks, pa.large_string())), symbols)] if marks else []
    used = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
    grams[used] = np.arange(len(used))
    at = _presence(tk.plain(pa.array(marks, pa.large_string())), symbols, grams, len(used))
    kmm = (at @ at.T).astype(np.float64)
    gram, target = np.zeros_like(kmm), np.zeros((len(marks), len(languages)))
    for i in range(0, len(rows), 256):
        part = rows[i : i + 256]
        k = (_presence(tk.plain(pa.array([t for t, _ in part], pa.large_string())), symbols, grams, len(used)) @ at.T).astype(np.float64)
        y = np.array([[float(x == lang) for lang in languages] for _, x in part])
        gram += k.T @ k
        target += k.T @ y
    weights = np.linalg.solve(gram + ridge * len(rows) * kmm / max(1, len(marks)) + 1e-6 * np.eye(len(marks)), target) if marks else target
    return Model(languages, symbols, grams, np.ascontiguousarray(at.T), weights.astype(np.float32))


def train(docs: DataFrame, teach=None, per_language: int = 256, landmarks_per_language: int = 48, max_chars: int = 20_000, max_rows: int = 16_384) -> Model:
    """Learn from documents (doc_id, text, lang) for which teach holds. Bounds of the sample: per_language whole texts
    of at most max_chars characters for each language, and about max_rows in all; MOST_LANDMARKS landmarks in all."""
    return fit(sample(docs, F.lit(True) if teach is None else teach, per_language, max_chars, max_rows), landmarks_per_language)


def score_texts(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    langs: list[str] = []
    scores: list[np.ndarray] = []
    most = max(1, CELLS // (len(model.landmarks) + 1))
    for a, b in ((x, min(b, x + most)) for a, b in tk.slices(texts) for x in range(a, b, most)):
        part = texts.slice(a, b - a)
        if model.languages:
            s = _presence(part, model.symbols, model.grams, len(model.landmarks)) @ model.landmarks @ model.weights
            best = s.argmax(1)
            share = np.clip(s[np.arange(len(s)), best], 0, 1).astype(np.float64)
            letters = [_LETTER.search(t) is not None for t in part.to_pylist()]
            langs += [model.languages[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), letters)]
            scores.append(np.where(letters, share, 0.0))
        else:
            langs += [UNKNOWN] * len(part)
            scores.append(np.zeros(len(part)))
    return langs, np.concatenate(scores) if scores else np.zeros(0)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `lang_pred` and `score`; only `text` is looked at."""
    spark = docs.sparkSession
    docs = docs.drop("lang_pred", "score")
    shared = spark.sparkContext.broadcast(model)
    schema = extended(docs.schema, "lang_pred string, score double")
    arrow_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = score_texts(tk.plain(batch.column(arrow_at)), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def identified(docs: DataFrame, model: Model, min_score: float = 0.2) -> DataFrame:
    """The documents in a recognisable language, with their own columns: those without a letter, or whose best
    language scores under min_score, go."""
    names = docs.columns
    tagged = predict(docs.select(F.struct(*names).alias("row"), "text"), model)
    return tagged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select("row.*")
