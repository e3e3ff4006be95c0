"""Toxicity by class-conditional Kneser-Ney word models (operator 7).

Each class c has a model of its own over one shared backoff: P_c(w) = max(n_c(w) - D_c, 0) / N_c + B_c * K(w). n_c(w) counts the
class's documents with the word, N_c is their sum, D_c the class's absolute discount, B_c the share of N_c that the discounts free, and K the continuation
distribution of both classes together (how many different words precede w, mixed with a uniform share for what no count covers).
So a rare expression is smoothed to what its contexts in the whole corpus say. D_c follows the words seen once and twice
(once / (once + 2 * twice)), times two for the toxic class, which has the fewer documents, and is 1 at least.

A toxic document is mostly made of ordinary words. Its model is therefore the mixture (1 - SHARE) * P_ordinary + SHARE * P_toxic; a word's
weight is the log of the mixture over the ordinary probability, divided by SHARE. No word is left out: one that training hasn't seen has the weight of its
backoff. The score is a logistic function of the difference of both length-normalised log-likelihoods, the mean weight of a document's words.

Words are runs of letters in lower case, told apart by 64 bits. The counts and ratios of all words are a Spark table that grows with
the corpus. Words whose weight isn't the backoff's are broadcast behind a check of their number, and joined to the
documents' words beyond it, with the same result. Counts cover every labelled document of the folds used: 1 to 3 for
counts and 4 for the logistic function (by CRC-32 of the id, modulo 5); fold 0 is held out.

Defined cases: a null or empty text, or one without words, gets the score of a difference of 0; a null id counts as id '' and
has no label; of several labels of a document the greatest counts, null labels don't; if a class has no document every
score is 0.0 (no toxic ones) or 0.5; repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaloom.llm.common import U64, mix, shared_dir, ship, signed, stored, word_hashes
from taxaloom.llm.language_id import crc_of_id, distinct, letters

#: Added to the number of words in the mean, so that a few words alone are no strong evidence.
PRIOR_WORDS = 4
#: Part of a toxic document's words that its own model accounts for, and the factor of the toxic class's discount; set on fold 4.
SHARE, TOXIC_FACTOR = 1 / 256, 2.0
#: Bins of the difference for fitting the logistic function.
BINS, SPAN = 32_768, 4.0
#: Telling words that are broadcast; beyond that they are joined.
BROADCAST_WORDS = 2_000_000
#: Preceding words fall into so many classes, the low bits of a code whose high bits are the word's.
CLASS_BITS = 16
#: Words of documents that a worker gathers before it sends their counts.
GATHERED = 2_000_000

_WORD, _PAIR, _DOCUMENT = 1, 2, 0
COUNTS = "kind byte, code long, toxic long, ordinary long"


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts, and the texts' offsets."""
    table = letters()
    clean = []
    for t in texts:
        chars = np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        clean.append(np.where(table[chars], chars, 32).astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass"))
    return word_hashes(pa.array(clean, pa.large_string()))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (toxic, text): documents of each class, documents of each class with each word, and pairs of a word and the class of the
    word before it, combined over blocks of documents."""
    held: list[tuple[np.ndarray, np.ndarray, bool]] = []
    size, documents = 0, [0, 0]

    def send() -> Iterator[pa.RecordBatch]:
        parts = []
        for toxic in (True, False):
            own = [w for w, _, t in held if t == toxic]
            parts.append(np.unique(np.concatenate([np.zeros(0, U64), *own]), return_counts=True))
        code = distinct(np.concatenate([parts[0][0], parts[1][0]]))
        n = np.zeros((2, len(code)), np.int64)
        for i, (word, count) in enumerate(parts):
            n[i, np.searchsorted(code, word)] = count
        pair = distinct(np.concatenate([np.zeros(0, U64), *[p for _, p, _ in held]]))
        none = np.zeros(len(pair), np.int64)
        for kind, c, t, o in ((_WORD, code, n[0], n[1]), (_PAIR, pair, none, none), (_DOCUMENT, np.zeros(1, U64), np.array(documents[:1]), np.array(documents[1:]))):
            for k in range(0, len(c), 50_000):
                part = slice(k, k + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c[part]), kind, np.int8)), pa.array(signed(c[part])), pa.array(t[part], pa.int64()), pa.array(o[part], pa.int64())], names=["kind", "code", "toxic", "ordinary"])

    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            found, at = words_of(part.column(1).to_pylist())
            before = np.concatenate([np.zeros(1, U64), found[:-1]])
            before[at[:-1][at[:-1] < len(found)]] = 0
            pairs = found >> U64(CLASS_BITS) << U64(CLASS_BITS) | mix(before) >> U64(64 - CLASS_BITS)
            for i, toxic in enumerate(part.column(0).to_pylist()):
                own = slice(at[i], at[i + 1])
                held.append((distinct(found[own]), distinct(pairs[own]), toxic))
                documents[0 if toxic else 1] += 1
                size += len(held[-1][0])
            if size > GATHERED:
                yield from send()
                held, size, documents = [], 0, [0, 0]
    if held:
        yield from send()


def discount(once: int, twice: int, factor: float = 1.0) -> float:
    return max(1.0, factor * once / max(once + 2 * twice, 1))


def word_model(docs: DataFrame, labels: DataFrame, folder: str) -> tuple[DataFrame, float] | None:
    """word, toxic, ordinary (documents), preceding, p_toxic, p_ordinary and weight of every word of the labelled documents of folds 1 to
    3, and the weight of all other words; None if a class has no document."""
    fold = crc_of_id("doc_id") % 5
    used = (fold > 0) & (fold < 4)
    rows = docs.where(used).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Both sides are shuffled at every size: labels grow with the corpus and are never broadcast.
    joined = rows.join(_known(labels).where(used).hint("merge"), "doc_id").select((F.col("toxic") == 1).alias("toxic"), "text")
    # A word's code and those of its pairs have their high bits in common; blocks are combined already, so all goes to the
    # task of those bits at once.
    high, total = F.when(F.col("kind") != _DOCUMENT, F.shiftrightunsigned("code", CLASS_BITS)), F.col("kind") == _DOCUMENT
    dealt = joined.mapInArrow(_counts, COUNTS).withColumns({"high": high, "total": total}).repartition("high", "total")
    combined = dealt.groupBy("high", "total", "kind", "code").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    word = F.when(F.col("kind") == _WORD, F.struct("code", "toxic", "ordinary"))
    by_word = combined.groupBy("high", "total")
    counts = by_word.agg(F.collect_list(word).alias("word"), F.count_if(F.col("kind") == _PAIR).alias("preceding"), F.sum("toxic").alias("t"), F.sum("ordinary").alias("o"))
    counts = stored(counts.select("total", F.explode_outer("word").alias("w"), "preceding", "t", "o").select("total", F.col("w.code").alias("word"), F.coalesce("w.toxic", "t").alias("toxic"), F.coalesce("w.ordinary", "o").alias("ordinary"), "preceding"), folder, "counts")
    whole = counts.where("total").first()
    if whole is None or not whole.toxic or not whole.ordinary:
        return None
    words = counts.where("not total").drop("total")
    classes = ("toxic", "ordinary")
    seen = words.agg(F.count("*").alias("words"), F.sum("preceding").alias("preceding"), *[F.count_if(F.col(c) == k).alias(f"{c}{k}") for c in classes for k in (1, 2)]).first()
    less = {c: discount(seen[f"{c}1"], seen[f"{c}2"], TOXIC_FACTOR if c == "toxic" else 1.0) for c in classes}
    mass = words.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in classes], *[F.coalesce(F.sum(F.least(F.col(c), F.lit(less[c]))), F.lit(0.0)).alias(f"{c}_freed") for c in classes]).first()
    backoff = {c: mass[f"{c}_freed"] / max(mass[c], 1) for c in classes}
    continuation = 0.99 * F.col("preceding") / max(seen["preceding"] or 0, 1) + 0.01 / max(seen["words"], 1)
    p = {c: F.greatest(F.col(c) - less[c], F.lit(0.0)) / max(mass[c], 1) + backoff[c] * continuation for c in classes}
    # A class whose documents have no words has no opinion.
    usable = all(mass[c] for c in classes)
    model = words.select("word", "toxic", "ordinary", "preceding", p["toxic"].alias("p_toxic"), p["ordinary"].alias("p_ordinary"))
    weight = F.log(1 - SHARE + SHARE * F.col("p_toxic") / F.col("p_ordinary")) / SHARE if usable else F.lit(0.0)
    unseen = math.log(1 - SHARE + SHARE * backoff["toxic"] / backoff["ordinary"]) / SHARE if usable else 0.0
    return stored(model.withColumn("weight", weight), folder, "model"), unseen


def _known(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))


SCORED = "doc_id long, fold int, ratio double, words long"


def differences(docs: DataFrame, model: DataFrame, unseen: float, folder: str, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """doc_id, fold, ratio (difference of the classes' length-normalised log-likelihoods) and words of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_of_id("doc_id") % 5).cast("int").alias("fold"), "text")
    # Weights as they differ from the backoff's, which all words have.
    above = F.col("weight") - unseen
    telling = model.select("word", above.alias("ratio")).where(F.abs("ratio") > 1e-9)
    if telling.count() > broadcast_words:
        return _joined_differences(rows, telling, unseen, folder)
    found = telling.orderBy("word").toArrow()
    known, ratio = found.column("word").to_numpy().view(U64), found.column("ratio").to_numpy()
    order = np.argsort(known)
    shared = docs.sparkSession.sparkContext.broadcast((known[order], ratio[order]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ratio = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                words, at = words_of(part.column(2).to_pylist())
                value = np.zeros(len(words))
                if len(known) and len(words):
                    place = np.minimum(np.searchsorted(known, words), len(known) - 1)
                    hit = known[place] == words
                    value[hit] = ratio[place[hit]]
                total, n = np.concatenate([[0.0], np.cumsum(value)]), np.diff(at)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array((total[at[1:]] - total[at[:-1]] + unseen * n) / (n + PRIOR_WORDS)), pa.array(n, pa.int64())], names=["doc_id", "fold", "ratio", "words"])

    return rows.mapInArrow(score, SCORED)


def _joined_differences(rows: DataFrame, telling: DataFrame, unseen: float, folder: str) -> DataFrame:
    """The same by a join of the documents' different words with the telling words."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                words, at = words_of(part.column(3).to_pylist())
                out, counts, sizes = [], [], []
                for a, b in zip(at[:-1], at[1:], strict=True):
                    own, n = np.unique(words[a:b], return_counts=True)
                    out.append(signed(own))
                    counts.append(n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(np.diff(at), pa.int64()), pa.array(out, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))], names=["place", "doc_id", "fold", "words", "word", "n"])

    placed = rows.select(F.monotonically_increasing_id().alias("place"), "doc_id", "fold", "text")
    held = stored(placed.mapInArrow(spread, "place long, doc_id long, fold int, words long, word array<long>, n array<long>"), folder, "words")
    each = held.select("place", F.explode(F.arrays_zip("word", "n")).alias("x")).select("place", "x.word", "x.n")
    sums = each.join(telling, "word").groupBy("place").agg(F.sum(F.col("n") * F.col("ratio")).alias("sum"))
    return held.join(sums, "place", "left").select("doc_id", "fold", ((F.coalesce("sum", F.lit(0.0)) + unseen * F.col("words")) / (F.col("words") + PRIOR_WORDS)).alias("ratio"), "words")


def logistic(x: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic regression on binned counts, by Newton's method with a small ridge.

    The classes weigh as they are; the slope is kept positive.
    """
    n, rate = positive + negative, positive.sum() / max(positive.sum() + negative.sum(), 1)
    a, b = 1.0, math.log(max(rate, 1e-6) / max(1 - rate, 1e-6))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        w = n * p * (1 - p) + 1e-9
        g = np.array([((positive - n * p) * x).sum() - 1e-3 * a, (positive - n * p).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 1e-3), b


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, ratio (difference of the length-normalised log-likelihoods) and number of words of each row."""
    spark = docs.sparkSession
    ship(spark)
    folder = shared_dir(spark, "toxicity")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fitted = word_model(rows, labels, folder)
    if fitted is None:
        any_toxic = _known(labels).where("toxic = 1").take(1)
        return rows.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_of_id("doc_id") % 5 == 0).alias("held_out"), F.lit(0.5 if any_toxic else 0.0).alias("score"), F.lit(1 if any_toxic else 0).alias("predicted"), F.lit(0.0).alias("ratio"), F.lit(0).cast("long").alias("words"))
    scored = stored(differences(rows, *fitted, folder), folder, "ratios")
    place = F.floor((F.greatest(F.lit(-SPAN), F.least(F.lit(SPAN), F.col("ratio"))) + SPAN) / (2 * SPAN) * (BINS - 1)).cast("int")
    binned = scored.where("fold = 4").join(_known(labels), "doc_id").groupBy(place.alias("bin"), (F.col("toxic") == 1).alias("toxic")).agg(F.count("*").alias("n")).collect()
    counts = np.zeros((2, BINS))
    for r in binned:
        counts[int(r.toxic), r.bin] += r.n
    slope, intercept = logistic((np.arange(BINS) + 0.5) / (BINS - 1) * 2 * SPAN - SPAN, counts[1], counts[0]) if counts[0].any() and counts[1].any() else (1.0, 0.0)
    score = 1 / (1 + F.exp(-(F.lit(float(slope)) * F.col("ratio") + F.lit(float(intercept)))))
    return scored.select("doc_id", (F.col("fold") == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "ratio", "words")
