"""Words grouped with the spelling they vary from, by PartEnum signatures (operator 11).

A word's letters with their repeats (the second ``a`` is a dimension of its own) are a binary vector. One replaced letter moves it by
a Hamming distance of two at most, one inserted or deleted letter by one. Dimensions are dealt into ``parts`` first-level parts
and each of these into ``pieces``; vectors within distance k agree wholly on all but some pieces of one part, so every choice of the
other pieces is a signature, and near vectors share at least one.

Anagrams are the same vector, and words built of few syllables have very many. So words meet on a signature together with
the half of the word that one edit leaves alone, at their beginning or end, and with the lengths of both: the equi join's keys then hold
few words. Edit distance decides on every pair that meets, inside the join.

Defined cases: a null text has no words; a null id counts as an empty text in the checksum; repeated rows count again; letters and
runs of any number and length are taken whole; an empty table gives no words; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaloom.llm.common import U64, mix, ship, signed, stored
from taxaloom.llm.conversation_trie import CRC_SQL, crc32_sql

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of a word, and code points that a word has at least.
LETTERS, MIN_LENGTH, MIN_COUNT = "A-Za-zÀ-ÿ", 7, 2
#: A near word so many times as frequent is the form.
FACTOR = 10
#: First-level parts and pieces of each, for pairs of one length (distance two) and of neighbouring lengths (distance one).
SAME, NEXT = (1, 3), (1, 2)


def words(docs: DataFrame, every: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n: runs of letters, A to Z lower-cased. A run whose checksum with the document's id is a multiple of ``every`` loses
    the letter that the checksum points to. Counts are combined before the shuffle."""
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{MIN_LENGTH},}}"), F.lit(0))).alias("run")
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run).withColumn("run", F.translate("run", UPPER, LOWER))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    without = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, without).otherwise(F.col("run"))
    counted = runs.withColumn("h", h).select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.length("word") >= MIN_LENGTH) & (F.col("n") >= MIN_COUNT))


def signatures(letters: np.ndarray, at: np.ndarray, distance: int, parts: int, pieces: int) -> np.ndarray:
    """The signatures of words given as code points and n + 1 offsets: a row for each word.

    Two words whose multisets differ in at most ``distance`` letters (counted both ways) share a column's value.
    """
    n = len(at) - 1
    word = np.repeat(np.arange(n), np.diff(at))
    order = np.lexsort((letters, word))
    word, sorted_ = word[order], letters[order]
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (sorted_[1:] == sorted_[:-1])
    place = np.arange(len(word))
    repeat = place - np.maximum.accumulate(np.where(same, 0, place)) if len(word) else place
    dimension = mix(sorted_.astype(U64) * U64(0x9E3779B97F4A7C15) + repeat.astype(U64))
    dealt = (dimension >> U64(40)) % U64(parts * pieces)
    sums = np.zeros((n, parts * pieces), U64)
    np.add.at(sums, (word, dealt.astype(np.int64)), mix(dimension))
    within = distance // parts  # some part differs by no more than this
    out = []
    for p in range(parts):
        own = sums[:, p * pieces : (p + 1) * pieces]
        for kept in combinations(range(pieces), pieces - within):
            total = np.full(n, p + 1, U64)
            for j in kept:
                total = mix(total + own[:, j] + U64(j + 1))
            out.append(total)
    return np.stack(out, 1)


def _hashes(letters: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each stretch of code points: the sum of its letters mixed with their places."""
    size = ends - begins
    owner = np.repeat(np.arange(len(begins)), size)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    total = np.zeros(len(begins), U64)
    np.add.at(total, owner, mix(letters[np.repeat(begins, size) + place].astype(U64) + (place.astype(U64) << U64(24))))
    return mix(total + size.astype(U64))


def keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, role and key of each entry of a word. Roles: 0 meets 0 (one length), 1 meets 2 (the longer one)."""
    text = column.to_pylist()
    size = np.array([len(t) for t in text], np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    letters = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin, end = at[:-1], at[1:]
    rows, roles, found = [], [], []
    for role, (distance, shape), shorter in ((0, (2, SAME), size), (1, (1, NEXT), size), (2, (1, NEXT), size - 1)):
        sign = signatures(letters, at, distance, *shape)
        half = shorter // 2  # of the shorter word: all before the edit, or all behind it
        for side, stretch in ((1, _hashes(letters, begin, begin + half)), (2, _hashes(letters, end - (shorter - half), end))):
            base = mix(stretch + U64(side) + (shorter.astype(U64) << U64(2)) + (U64(min(role, 1)) << U64(40)))
            for j in range(sign.shape[1]):
                rows.append(np.arange(len(text)))
                roles.append(np.full(len(text), role, np.int8))
                found.append(mix(base ^ (sign[:, j] + U64(j))))
    return np.concatenate(rows), np.concatenate(roles), np.concatenate(found)


def near_words(counted: DataFrame, folder: str) -> DataFrame:
    """All ordered pairs of words that one inserted, deleted or replaced letter sets apart: word, n, near, near_n."""
    ship(counted.sparkSession)

    def enumerate_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 4096):
                part = batch.slice(a, 4096)
                row, role, key = keys(part.column(0))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(role), pa.array(signed(key))], names=["word", "n", "role", "key"])

    entries = stored(counted.select("word", "n").mapInArrow(enumerate_, "word string, n long, role byte, key long"), folder, "entries")
    left = entries.where("role < 2").select("word", "n", "role", "key")
    right = entries.where("role <> 1").select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.when(F.col("role") == 2, 1).otherwise(0).cast("byte").alias("_r"), F.col("key").alias("_k"))
    # Of two words of one length the pair is kept once, the smaller word first.
    meets = (F.col("key") == F.col("_k")) & (F.col("role") == F.col("_r")) & ((F.col("role") == 1) | (F.col("word") < F.col("near")))
    pairs = left.join(right, meets & (F.levenshtein("word", "near", 1) == 1)).select("word", "n", "near", "near_n").distinct()
    pairs = stored(pairs, folder, "pairs")
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def variants(counted: DataFrame, folder: str, factor: int = FACTOR, max_rounds: int = 64) -> DataFrame:
    """word, form, root, n, n_near and form_n of counted words. The form is the most frequent near word (ties: the smallest) if it is
    ``factor`` times as frequent; the root is where forms lead to."""
    counted = stored(counted.select("word", "n"), folder, "words")
    best = near_words(counted, folder).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("b"))
    best = best.select(F.col("word").alias("_w"), "n_near", F.col("b.w").alias("_form"), (-F.col("b.m")).alias("_n"))
    found = counted.join(best, F.col("word") == F.col("_w"), "left")
    has = F.coalesce(F.col("_n") >= factor * F.col("n"), F.lit(False))
    found = stored(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("_form")).alias("form"), F.when(has, F.col("_n")).alias("form_n")), folder, "forms")
    roots = _roots(found.where("form is not null").select("word", F.col("form").alias("root")), folder, max_rounds)
    out = found.join(roots.select(F.col("word").alias("_w"), "root"), F.col("word") == F.col("_w"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(steps: DataFrame, folder: str, max_rounds: int) -> DataFrame:
    """Follows forms to the last, doubling the way in each round; frequencies grow tenfold by step, so ways are short."""
    now = stored(steps, folder, "roots-0")
    for k in range(1, max_rounds + 1):
        ahead = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        now = stored(now.join(ahead, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), folder, f"roots-{k}")
        if not now.where("moved").take(1):
            return now.select("word", "root")
        now = now.select("word", "root")
    raise RuntimeError(f"forms lead on after {max_rounds} rounds")


#: The variants in DuckDB's SQL: near words share a word with one letter deleted, at one place or as the shorter word itself.
SQL = f"""with {CRC_SQL},
  runs as (select coalesce(doc_id::varchar, '') as id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]{{{MIN_LENGTH},}}')), '{UPPER}', '{LOWER}') as run from documents),
  different as (select id, run, count(*) as m from runs group by all),
  hashed as (select *, {crc32_sql("id || ':' || run")} as h from different, crc),
  word as (select w, sum(m)::bigint as n from (select case when h % 31 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as w, m from hashed) where length(w) >= {MIN_LENGTH} group by 1 having sum(m) >= {MIN_COUNT}),
  less as (select w, n, i, substr(w, 1, i) || substr(w, i + 2) as d from (select w, n, unnest(range(length(w))) as i from word)),
  pairs as (select a.w, b.w as near, b.n as near_n from less a join less b on a.d = b.d and a.i = b.i and a.w <> b.w
    union select a.w, b.w, b.n from less a join word b on a.d = b.w union select b.w, a.w, a.n from less a join word b on a.d = b.w),
  best as (select w, count(*) as n_near, arg_min(near, (-near_n, near)) as near, max(near_n) as near_n from pairs group by 1),
  form as (select word.w, n, coalesce(n_near, 0) as n_near, case when near_n >= {FACTOR} * n then near end as form, case when near_n >= {FACTOR} * n then near_n end as form_n from word left join best using (w)),
  way as (with recursive way as (select w, w as last_form, 0 as steps from form union all select way.w, form.form, steps + 1 from way join form on form.w = way.last_form where form.form is not null) select w, arg_max(last_form, steps) as root from way group by 1)
  select w as word, form, root, n, n_near, form_n from form join way using (w)"""
