"""Language of texts by string kernels (operator 4).

The kernel of two texts is the share of character n-grams (blended spectrum: 1 to 3 characters of the
lower-cased text, each character that isn't a letter as one boundary character) that both have, by presence: common
n-grams over the root of the product of both numbers. All letters are told apart: an n-gram is a number of three code
points. A bounded sample of labelled rows gives the landmarks of a Nyström approximation and the training rows of
one-versus-rest kernel ridge regression. A batch is scored by two matrix products: presence by landmarks, then kernels by
weights.

Defined cases: a null text or one without a letter is ``und`` with score 0; rows without a language or id teach
nothing or count as id ''; repeated rows are predicted each; an empty table gives an empty result, and if nothing
is labelled every text is ``und``; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaloom.llm.common import ship

#: Stands for all that isn't a letter, and bits of a code point in an n-gram.
BOUNDARY, BITS = 1, 21
#: Characters of a text whose n-grams are made at once.
STEP = 1 << 20
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def ngrams(text: str | None) -> np.ndarray:
    """The different n-grams of 1 to 3 characters of a text, in order; none if it has no letter."""
    chars = code_points(text or "")
    known = letters()[chars]
    if not known.any():
        return np.zeros(0, np.int64)
    s = np.concatenate([[BOUNDARY], np.where(known, chars, BOUNDARY), [BOUNDARY]]).astype(np.int64)
    parts = []
    for k in range(0, len(s), STEP):
        one = s[k : k + STEP + 2]
        two = one[:-1] << BITS | one[1:]
        parts.append(distinct(np.concatenate([one, two, two[:-1] << BITS | one[2:]])))
    return parts[0] if len(parts) == 1 else distinct(np.concatenate(parts))


@dataclass
class Model:
    """languages; vocabulary: the landmarks' n-grams in order; landmarks: one row each, divided by the root of its number of
    n-grams; weights: landmarks by languages."""

    languages: list[str]
    vocabulary: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray

    def kernels(self, grams: list[np.ndarray]) -> np.ndarray:
        """Kernel of each text, given its n-grams, with each landmark."""
        present = np.zeros((len(grams), len(self.vocabulary)), np.float32)
        for i, own in enumerate(grams):
            at = np.minimum(np.searchsorted(self.vocabulary, own), len(self.vocabulary) - 1)
            present[i, at[self.vocabulary[at] == own]] = 1
        sizes = np.array([max(1, len(own)) for own in grams], np.float32)
        return (present @ self.landmarks.T) / np.sqrt(sizes)[:, None]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        if not self.languages:
            return out
        for k in range(0, len(texts), 256):
            grams = [ngrams(t) for t in texts[k : k + 256]]
            own = [i for i, g in enumerate(grams) if len(g)]
            if not own:
                continue
            values = self.kernels([grams[i] for i in own]) @ self.weights
            odds = np.exp(8.0 * (values - values.max(axis=1, keepdims=True)))
            share = odds / odds.sum(axis=1, keepdims=True)
            for i, row in zip(own, share, strict=True):
                best = int(row.argmax())
                out[k + i] = (self.languages[best], float(row[best]))
        return out


def fit(rows: list[tuple[str, str]], landmarks: int = 192, ridge: float = 1e-3) -> Model:
    """Fits the classifier to (text, language) rows; landmarks are taken from the languages in turn."""
    return fit_ngrams([(ngrams(t), lang) for t, lang in rows], landmarks, ridge)


def fit_ngrams(rows: list[tuple[np.ndarray, str]], landmarks: int = 192, ridge: float = 1e-3) -> Model:
    """The same for rows of n-grams and language."""
    rows = [(g, lang) for g, lang in rows if len(g) and lang is not None]
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32))
    by = {lang: [g for g, x in rows if x == lang] for lang in languages}
    turns = max(map(len, by.values()))
    chosen = [by[lang][k] for k in range(turns) for lang in languages if k < len(by[lang])][:landmarks]
    vocabulary = distinct(np.concatenate(chosen))
    own = np.zeros((len(chosen), len(vocabulary)), np.float32)
    for i, g in enumerate(chosen):
        own[i, np.searchsorted(vocabulary, g)] = 1 / np.sqrt(len(g))
    model = Model(languages, vocabulary, own, np.zeros((len(chosen), len(languages)), np.float32))
    among = (own @ own.T).astype(np.float64)
    target = np.array([[1.0 if lang == x else -1.0 for x in languages] for _, lang in rows])
    # Rare languages weigh as much as frequent ones.
    weight = np.array([1.0 / len(by[lang]) for _, lang in rows])
    left, right = ridge * among / len(languages) + 1e-9 * np.eye(len(chosen)), np.zeros((len(chosen), len(languages)))
    for k in range(0, len(rows), 256):
        kernel = model.kernels([g for g, _ in rows[k : k + 256]]).astype(np.float64)
        left += kernel.T @ (kernel * weight[k : k + 256, None])
        right += kernel.T @ (target[k : k + 256] * weight[k : k + 256, None])
    model.weights = np.linalg.lstsq(left, right, rcond=1e-10)[0].astype(np.float32)
    return model


def sample(docs: DataFrame, teaches: Column, rows: int = 2400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[np.ndarray, str]]:
    """N-grams and language of about ``rows`` labelled texts for fitting (2 * rows at most), the same number for each
    language, chosen by a hash of the id. Texts of any length are chosen; the driver gets their different n-grams."""
    ship(docs.sparkSession)
    able = docs.where(teaches & F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.xxhash64(F.lit("sample"), F.col(id_col)).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = {r.lang: r.n for r in able.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()}
    if not counts:
        return []
    each = max(1, rows // len(counts))
    part = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, each / n))])
    place = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = pa.array([ngrams(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), grams, batch.column(2)], names=["h", "grams", "lang"])

    chosen = able.where(place < part[F.col("lang")]).mapInArrow(cut, "h long, grams binary, lang string")
    found = chosen.orderBy("h", "lang", "grams").limit(2 * rows).collect()
    return [(np.frombuffer(r.grams, np.int64), r.lang) for r in found]


def crc_of_id(id_col: str) -> Column:
    """CRC-32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of each row's text, from the text alone."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (crc_of_id(id_col) % 4 == 2).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, min_score: float = 0.4, text_col: str = "text") -> DataFrame:
    """The rows whose language the model tells, all columns as they are."""
    spark = docs.sparkSession
    ship(spark)
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index(text_col)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != UNKNOWN and score >= min_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(known, docs.schema)
