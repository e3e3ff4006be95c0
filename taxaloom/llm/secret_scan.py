"""Secrets in texts (operator 2).

Base kinds are fixed patterns. The method adds spans of kind ``guess``: the value after a credential word
is priced by the fewest guesses that a cracker needs (:mod:`taxaloom.llm.guess_cost`). A dynamic program cuts the value into words (by rank
among all words of the corpus), dates, repeats, keyboard walks and brute-force spans, taking the cheapest cut; a value
above the limit is reported. Values that a base span meets are reported by it and not priced.

1. Workers find base spans and credential values; texts are read once for it and once for the counts of words.
2. Each different value gets a number. What may begin a word in it (stretches of three to eight letters, and of nine, which
   begin any longer word) meets the words' ranks in a join: the whole vocabulary counts, and none of it is broadcast. The number goes with
   them, not the value. A word's uses as a credential value don't count.
3. Each different value is priced once, and its price goes back to the documents with it.

Defined cases: a null or empty text has no spans; ids may be null; repeated rows are scanned each; an empty
table gives an empty result; other columns are ignored. Spans count code points; ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxaloom.llm.common import shared_dir, ship, stored
from taxaloom.llm.guess_cost import LEET, SHORTEST_WORD, guess_cost, lowered

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "guess")
#: Words whose value is a credential, the sign between, and the value; quotes end a value.
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|private|secret|auth|client)[_\x20-]?key|auth(?:orization)?|bearer)["']?\x20{0,4}(?:[:=]|=>|:=|->)\x20{0,4}["'`]?([^\s"'`<>,;|]+)""", re.I | re.A)
HINT = re.compile("pass|pwd|secret|token|credential|key|auth|bearer", re.I | re.A)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by start and then kind."""
    found = []
    if HINT.search(text):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def credential_values(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the values after a credential word."""
    if HINT.search(text):
        for m in CONTEXT.finditer(text):
            yield m.span(1)


def uncovered(values: Iterator[tuple[int, int]], base: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, bool]]:
    """Values with whether one of the base spans meets them."""
    starts, reach = [a for _, a, _ in base], []
    for _, _, b in base:
        reach.append(max(b, reach[-1] if reach else 0))
    for a, b in values:
        k = bisect_right(starts, a)
        yield a, b, (k > 0 and reach[k - 1] > a) or bisect_left(starts, b) > bisect_left(starts, a)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


#: Words are joined by so many of their first letters.
HEAD = 9


def letter_runs(value: str) -> set[str]:
    """What may be a word of a value, or the beginning of one longer than ``HEAD`` letters: stretches of its letters, as they are or with
    signs for letters, in lower case."""
    low = lowered(value)
    out: set[str] = set()
    for form in {low, low.translate(LEET)}:
        for m in re.finditer(r"[^\W\d_]{3,}", form):
            run = m.group()
            for size in range(SHORTEST_WORD, HEAD + 1):
                out.update(run[a : a + size] for a in range(len(run) - size + 1))
    return out


_SPLIT = r"[ \t\n\r.,;:!?|]+"


def _count_words(rows: DataFrame, text: Column) -> DataFrame:
    words = rows.select(F.explode(F.split(text, _SPLIT)).alias("w")).where(F.length("w") >= SHORTEST_WORD)
    counts = words.groupBy("w").agg(F.count("*").alias("n")).where(F.col("w").rlike(r"^\p{L}+$"))
    return counts.groupBy(F.lower("w").alias("word")).agg(F.sum("n").alias("n"))


def corpus_words(docs: DataFrame, values: DataFrame, folder: str, least: int = 1, text_col: str = "text") -> DataFrame:
    """word, rank: all words of three letters or more that texts use ``least`` times or more outside credential values (column value, one row for each
    use), with one more than the number of words used more often."""
    used = _count_words(docs, F.col(text_col)).unionByName(_count_words(values, F.col("value")).select("word", (-F.col("n")).alias("n")))
    counts = stored(used.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least), folder, "words")
    # One row for each different count: far fewer than words.
    sizes = counts.groupBy("n").agg(F.count("*").alias("words"))
    above = F.coalesce(F.sum("words").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.join(sizes.select("n", (above + 1).alias("rank")), "n").select("word", "rank")


def value_costs(values: DataFrame, words: DataFrame, folder: str) -> DataFrame:
    """value, cost of each row of ``values``, which has each value once. What one value's words need is held at once."""
    numbered = stored(values.select(F.monotonically_increasing_id().alias("number"), "value"), folder, "values")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = sorted(letter_runs(value.as_py()))
                for k in range(0, len(found), 10_000):
                    part = found[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(part), pa.int64()), pa.array(part, pa.string())], names=["number", "head"])

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                ranks = {w["word"]: w["rank"] for w in r["words"] or ()}
                yield pa.RecordBatch.from_arrays([pa.array([r["number"]], pa.int64()), pa.array([round(guess_cost(r["value"], ranks)[0], 3)])], names=["number", "cost"])

    heads = words.withColumn("head", F.substring("word", 1, HEAD))
    ranked = numbered.mapInArrow(runs, "number long, head string").join(heads, "head").groupBy("number").agg(F.collect_list(F.struct("word", "rank")).alias("words"))
    costs = numbered.join(ranked, "number", "left").select("number", "value", "words").mapInArrow(price, "number long, cost double")
    return numbered.join(stored(costs, folder, "prices"), "number").select("value", "cost")


FOUND = "doc_id long, place long, n_assign long, n_access long, n_hex long, base_sha256 string, base string, values array<struct<start: long, end: long, covered: boolean, value: string>>"

FOUND_NAMES = ["doc_id", "place", "n_assign", "n_access", "n_hex", "base_sha256", "base", "values"]


def scan(docs: DataFrame, min_log10_guesses: float = 12.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: counts, all spans, and log10 guesses of the credential values that no base span meets, in their order."""
    spark = docs.sparkSession
    ship(spark)
    folder = shared_dir(spark, "secrets")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("covered", pa.bool_()), ("value", pa.string())]))
        kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), kind]
        for batch in batches:
            rows = []
            for doc, place, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = text.as_py() or ""
                base = base_spans(text)
                held = joined(base)
                values = [{"start": a, "end": b, "covered": c, "value": text[a:b]} for a, b, c in uncovered(credential_values(text), base)]
                of = [k for k, _, _ in base]
                rows.append((doc, place, *(of.count(k) for k in KINDS[:3]), hashlib.sha256(held.encode()).hexdigest(), held, values or None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=FOUND_NAMES)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("place"), F.col(text_col).alias("text"))
    found = stored(rows.mapInArrow(find, FOUND), folder, "found")
    uses = found.select("place", F.explode("values").alias("v")).select("place", "v.*")
    words = corpus_words(rows, uses, folder)
    costs = stored(value_costs(uses.where("not covered").select("value").distinct(), words, folder), folder, "costs")
    by_row = uses.where("not covered").join(costs, "value").groupBy("place").agg(F.sort_array(F.collect_list(F.struct("start", "end", "covered", "cost"))).alias("priced"))
    out = found.join(by_row, "place", "left")
    guesses = F.filter("priced", lambda v: ~v["covered"] & (v["cost"] >= min_log10_guesses))
    n = F.coalesce(F.size(guesses), F.lit(0)).cast("long")
    guess = F.transform(guesses, lambda v: F.struct(v["start"].alias("a"), F.lit(len(KINDS) - 1).alias("k"), F.concat_ws(":", F.lit("guess"), v["start"], v["end"]).alias("span")))
    base = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.struct(F.split(x, ":")[1].cast("long").alias("a"), F.array_position(F.array(*map(F.lit, KINDS)), F.split(x, ":")[0]).cast("int").alias("k"), x.alias("span")))
    both = F.array_sort(F.concat(base, guess))
    spans = F.when(n == 0, F.col("base")).otherwise(F.array_join(F.transform(both, lambda x: x["span"]), ","))
    costs_ = F.coalesce(F.transform("priced", lambda v: v["cost"]), F.array().cast("array<double>"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.when(F.col("priced").isNull(), F.lit(0).cast("long")).otherwise(n).alias("n_guess"), "base_sha256", F.when(F.col("priced").isNull(), F.col("base")).otherwise(spans).alias("spans"), costs_.alias("costs"))
