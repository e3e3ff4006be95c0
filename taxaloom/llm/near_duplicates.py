"""Near-duplicate documents by MinHash (operator 9).

1. Each document's set of word shingles gives a 128-bit fingerprint and a signature by one-permutation hashing:
   one hash of each shingle, its high bits a bin, the least rest in each bin; an empty bin is filled from a
   full one that a sequence of universal hashes finds (optimal densification).
2. Documents with the same set are one node, the smallest id. Bands of bins make buckets; a bucket gives
   star-shaped candidate links, each member to the smallest member, so their number follows the members.
3. Candidates are confirmed on full sets, and confirmed links make components.
4. A star misses a link of two members that aren't both near the centre. So buckets that still hold several
   components are compared in tiles of bounded size: inside a tile numpy compares signatures across components, and
   what may reach the similarity is confirmed on full sets. Only links leave a tile, never pairs.

Two documents at a similarity of 0.75 share no bucket with a chance of about 5e-6 (32 bands of 4 bins).

Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing; rows that
share a doc_id take the smallest component among theirs; a null doc_id is never linked, its component is null and it is
kept; repeated rows are each returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaloom.llm.common import U64, mix, ngram_hashes, shared_dir, ship, signed, stored, word_hashes
from taxaloom.llm.components import connected_components

BINS, BAND = 128, 4
#: Of 128 bins two sets at a similarity of 0.75 agree in 96, give or take 4.9; fewer than this is 4.9 deviations off.
LEAST_AGREEING = 72
#: Members of one bucket that are compared as one block, and their shingles together; a tile holds two blocks.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
SIGNED = "doc_id long, n_shingles long, fp struct<a: long, b: long>, bands array<long>, bins binary"
_FP = pa.struct([("a", pa.int64()), ("b", pa.int64())])


def shingle_sets(texts: pa.Array, words: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, no words give none."""
    hashes, rows = word_hashes(texts, lower=True)
    out = []
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        own = hashes[a:b]
        grams = ngram_hashes(own, words) if b - a >= words else ngram_hashes(own, int(b - a), seed=1) if b > a else own
        grams = np.sort(grams)
        out.append(grams[np.concatenate([[True], grams[1:] != grams[:-1]])] if len(grams) else grams)
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """One-permutation hashing of a non-empty set into BINS bins, with optimal densification."""
    h = mix(shingles ^ U64(0x5851F42D4C957F2D))
    place, value = (h >> U64(57)).astype(np.int64), h & U64((1 << 57) - 1)
    bins = np.full(BINS, np.iinfo(np.uint64).max, U64)
    np.minimum.at(bins, place, value)
    full = np.zeros(BINS, bool)
    full[place] = True
    if not full.all():
        empty = np.flatnonzero(~full)
        filled, attempt = bins.copy(), 0
        while len(empty):
            source = _probe(attempt)[empty]
            ok = full[source]
            filled[empty[ok]] = bins[source[ok]]
            empty, attempt = empty[~ok], attempt + 1
        bins = filled
    return bins


_PROBES: list[np.ndarray] = []


def _probe(attempt: int) -> np.ndarray:
    """Where each bin looks at this attempt."""
    while len(_PROBES) <= attempt:
        k = len(_PROBES)
        _PROBES.append((mix(np.arange(BINS, dtype=U64) + U64(1 + k * BINS)) >> U64(57)).astype(np.int64))
    return _PROBES[attempt]


def signatures(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, set size, fingerprint, hash of each band, and the low byte of each bin."""
    ship(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                sizes, fps, bands, low = [], [], [], []
                for s in shingle_sets(part.column(1), words):
                    sizes.append(len(s))
                    other = mix(s + U64(0x9E3779B97F4A7C15))
                    fps.append({"a": int(signed(s.sum(keepdims=True, dtype=U64))[0]), "b": int(signed(other.sum(keepdims=True, dtype=U64))[0])})
                    if len(s):
                        bins = signature(s)
                        bands.append(signed(ngram_rows(bins.reshape(-1, BAND))))
                        low.append((bins & U64(0xFF)).astype(np.uint8).tobytes())
                    else:
                        bands.append(None)
                        low.append(None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(fps, _FP), pa.array(bands, pa.list_(pa.int64())), pa.array(low, pa.binary())], names=["doc_id", "n_shingles", "fp", "bands", "bins"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(sign, SIGNED)


def ngram_rows(rows: np.ndarray) -> np.ndarray:
    """Hash of each row, different for each row number."""
    total = np.arange(1, len(rows) + 1, dtype=U64)
    for j in range(rows.shape[1]):
        total = total * U64(0x9FB21C651E98DF25) + rows[:, j]
    return mix(total)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """node, shingles of rows (node, text)."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([signed(s) for s in shingle_sets(part.column(1), words)], pa.list_(pa.int64()))], names=["node", "shingles"])

    return docs.mapInArrow(collect, "node long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: Column) -> DataFrame:
    """The pairs (a, b) that reach the similarity on their full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", shared.alias("i"), (F.size("sa") + F.size("sb") - shared).alias("u")).where(100 * F.col("i") >= similarity * F.col("u")).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "near")
    every = stored(signatures(docs, words, id_col, text_col), folder, "signatures")
    known = every.where("doc_id is not null and n_shingles > 0")
    # Equal sets are one node. Tables on the small side of a join are stored first, so that Spark can split
    # the many rows of one key on the other side.
    node = F.min("doc_id").alias("node")
    nodes = stored(known.groupBy("fp", "n_shingles").agg(node, F.first("bands").alias("bands"), F.first("bins").alias("bins")), folder, "nodes")
    member = nodes.select("node", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    shared = member.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre < last")
    shared = stored(shared.select("bucket", "centre"), folder, "shared")
    members = stored(member.join(shared, "bucket").select("bucket", "band", "centre", "node", "n_shingles"), folder, "members")
    wanted = members.select("node").distinct()
    source = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    sets = stored(_sets(source.join(wanted, "node", "left_semi"), words), folder, "sets")
    limit = F.lit(percent)

    pairs = members.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    links = stored(_confirmed(pairs, sets, limit), folder, "links-0")
    groups = stored(connected_components(links, folder, "components-1"), folder, "groups-1")
    more = _links_across(members, nodes, groups, sets, percent, folder)
    links = stored(links.unionByName(more), folder, "links-1")
    groups = stored(connected_components(links, folder, "components-2"), folder, "groups-2")

    of_set = nodes.join(groups, "node", "left").select("fp", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    by_doc = known.select("doc_id", "fp", "n_shingles").join(stored(of_set, folder, "of-set"), ["fp", "n_shingles"])
    return _result(every, by_doc)


_TILE = ["bucket", "i", "j"]


def _links_across(members: DataFrame, nodes: DataFrame, groups: DataFrame, sets: DataFrame, percent: int, folder: str) -> DataFrame:
    """Links between components that share a bucket."""
    placed = members.select("bucket", "band", "node", "n_shingles").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # Blocks are bounded by members and by shingles, so a tile of long documents is no larger than one of short ones.
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    several = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), blocks.alias("blocks"))
    several = stored(several.where("lo < hi").select("bucket", "blocks"), folder, "several")
    # A member meets every block of its bucket once: blocks i <= j make a tile.
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    open_ = placed.join(several, "bucket").withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = open_.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "band", "block", "node", "component", "n_shingles")
    tiles = stored(tiles.join(nodes.select("node", "bins", "bands"), "node"), folder, "tiles")
    near = tiles.groupBy(*_TILE).applyInArrow(_near_members(percent), tiles.schema)
    full = stored(near, folder, "near").join(sets, "node")
    return full.groupBy(*_TILE).applyInArrow(_tile_links(percent), "a long, b long").distinct()


def _candidates(table: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each member of a tile with those after it that it may be linked with: another component, sizes and signatures that
    allow the similarity, no earlier band that both share (that band's bucket has the pair). Bands are compared by the whole
    hashes that make the buckets; low bytes of bins agree by chance."""
    bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(-1, BINS)
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BINS // BAND)
    component, size, block = (table.column(c).to_numpy() for c in ("component", "n_shingles", "block"))
    band, across = table.column("band")[0].as_py(), table.column("i")[0].as_py() != table.column("j")[0].as_py()
    for k in range(len(bins) - 1):
        low, high = np.minimum(size[k], size[k + 1 :]), np.maximum(size[k], size[k + 1 :])
        ok = (component[k + 1 :] != component[k]) & (100 * low >= percent * high)
        if across:
            ok &= block[k + 1 :] != block[k]
        able = np.flatnonzero(ok) + k + 1
        if not len(able):
            continue
        able = able[(bins[able] == bins[k]).sum(axis=1) >= LEAST_AGREEING]
        first = (bands[able] == bands[k]).argmax(axis=1)
        if len(able := able[first == band]):
            yield k, able


def _near_members(percent: int) -> Callable:
    def find(table: pa.Table) -> pa.Table:
        """The members of a tile that may be linked with another."""
        wanted = np.zeros(table.num_rows, bool)
        for k, able in _candidates(table, percent):
            wanted[k] = True
            wanted[able] = True
        return table.filter(pa.array(wanted))

    return find


def _tile_links(percent: int) -> Callable:
    def find(table: pa.Table) -> pa.Table:
        """Links of a tile's members, on their full sets."""
        shingles = table.column("shingles").combine_chunks()
        at, values = shingles.offsets.to_numpy(), shingles.values.to_numpy().view(U64)
        node = table.column("node").to_numpy()
        found = []
        for k, able in _candidates(table, percent):
            own = values[at[k] : at[k + 1]]
            others = [values[at[i] : at[i + 1]] for i in able]
            joint = np.concatenate(others)
            hit = own[np.minimum(np.searchsorted(own, joint), len(own) - 1)] == joint
            n = np.array([len(x) for x in others])
            shared = np.add.reduceat(hit.astype(np.int64), np.cumsum(n) - n)
            for i in able[100 * shared >= percent * (len(own) + n - shared)]:
                found.append((min(node[k], node[i]), max(node[k], node[i])))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return find


def _result(every: DataFrame, by_doc: DataFrame) -> DataFrame:
    own = by_doc.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = every.select("doc_id", "n_shingles").join(own, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
