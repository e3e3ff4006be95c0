"""The trie of conversation prefixes and what its subtrees share (operator 12).

Turns are numbered in parts of a range order with counts carried from part to part, so that a conversation of any length
is spread over tasks. A prefix is told by the exclusive or of two 64-bit hashes of each turn's SHA-256 and place, run in blocks of
1,024 turns. Grouping prefixes gives the nodes; a node's smallest conversation and its depth name it. Totals of subtrees come from
:mod:`taxaloom.llm.contraction`.

Defined cases: turns are ordered by turn (null first), then role, then the text's digest, and repeated rows all count; a null role or
text is empty; rows without a conversation's id are no conversation's and are left out; an empty table gives no nodes,
not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxaloom.llm.common import ship, stored
from taxaloom.llm.contraction import subtree_totals

#: Turns whose hashes run together, and ids that are joined to one text before they are hashed.
BLOCK, IDS = 1024, 4096
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame, folder: str) -> DataFrame:
    """conv_id, k (from 1), digest of role and text, and the text's bytes, for each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    placed = stored(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), folder, "placed")
    counts = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("conv_id", "part", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    return placed.withColumn("within", within).join(counts, ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("within")).alias("k"), "digest", "bytes")


def shared_starts(turns: DataFrame, folder: str, group: int = 5, limit: int = 9) -> DataFrame:
    """Conversations that take their first turns from the first of their group: conv_id, k, digest, bytes, and ``last`` (turns of the
    whole conversation). Conversation c takes h turns from c - c % group, h being the checksum of its id modulo ``limit``, and
    goes on with its own turns after the first h. A conversation without turns has a row whose k is 0."""
    turns = stored(turns, folder, "turns")
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % limit
    donors = own.select(F.col("conv_id").alias("donor"), F.col("n").alias("m"))
    plan = own.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("donor")).join(donors, "donor", "left")
    plan = plan.withColumn("taken", F.least("h", F.coalesce("m", F.lit(0)))).withColumn("last", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    plan = stored(plan.select("conv_id", "donor", "h", "taken", "last"), folder, "plan")
    lent = plan.where("taken > 0").select("conv_id", "last", F.col("donor").alias("_d"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("taken"))).alias("_k"))
    first = turns.where(F.col("k") < limit).select(F.col("conv_id").alias("_c"), F.col("k").alias("_j"), "digest", "bytes")
    taken = lent.join(first, (F.col("_d") == F.col("_c")) & (F.col("_k") == F.col("_j"))).select("conv_id", F.col("_k").alias("k"), "digest", "bytes", "last")
    kept = turns.join(plan.select("conv_id", "h", "taken", "last"), "conv_id").where("k > h").select("conv_id", (F.col("taken") + F.col("k") - F.col("h")).alias("k"), "digest", "bytes", "last")
    bare = plan.where("last = 0").select("conv_id", F.lit(0).cast("long").alias("k"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes"), "last")
    return taken.unionByName(kept).unionByName(bare)


def prefixes(turns: DataFrame, folder: str) -> DataFrame:
    """conv_id, depth, x and y (the prefix' two hashes), px and py (those of the prefix before), bytes of the last text and ``last``."""
    turns = stored(turns.where("k > 0").withColumns({"a": F.xxhash64(F.lit(1), "k", "digest"), "b": F.xxhash64(F.lit(2), "k", "digest"), "block": F.floor((F.col("k") - 1) / BLOCK)}).drop("digest"), folder, "hashed")
    upto = Window.partitionBy("conv_id", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = turns.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"_{c}") for c in "ab"])
    out = turns.withColumns({"x": F.bit_xor("a").over(upto), "y": F.bit_xor("b").over(upto)}).join(blocks, ["conv_id", "block"])
    x, y = F.col("x").bitwiseXOR(F.col("_a")), F.col("y").bitwiseXOR(F.col("_b"))
    return out.select("conv_id", F.col("k").alias("depth"), x.alias("x"), y.alias("y"), x.bitwiseXOR(F.col("a")).alias("px"), y.bitwiseXOR(F.col("b")).alias("py"), "bytes", "last")


def trie(turns: DataFrame, folder: str) -> DataFrame:
    """A row for each node, as the docstring of :func:`report` says, from conversations as :func:`shared_starts` returns them."""
    turns = stored(turns, folder, "rebuilt")
    paths = stored(prefixes(turns, folder), folder, "paths")
    root = turns.groupBy().agg(F.min("conv_id").alias("conv_id"), F.countDistinct("conv_id").alias("n_convs")).where("conv_id is not null")
    found = paths.groupBy("depth", "x", "y").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("px").alias("px"), F.max("py").alias("py"))
    none = F.lit(0).cast("long")
    nodes = found.unionByName(root.select(none.alias("depth"), none.alias("x"), none.alias("y"), "conv_id", "n_convs", none.alias("bytes"), none.alias("px"), none.alias("py")))
    nodes = stored(nodes, folder, "nodes")
    above = nodes.select((F.col("depth") + 1).alias("_d"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("conv_id").alias("parent_conv_id"))
    nodes = stored(nodes.join(above, (F.col("depth") == F.col("_d")) & (F.col("px") == F.col("_x")) & (F.col("py") == F.col("_y")), "left").drop("_d", "_x", "_y", "px", "py"), folder, "linked")
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("_c"), (F.col("depth") - 1).alias("_d")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, (F.col("conv_id") == F.col("_c")) & (F.col("depth") == F.col("_d")), "left").drop("_c", "_d").withColumn("n_children", F.coalesce("n_children", none))
    nodes = stored(nodes, folder, "counted")
    name = lambda c, d: F.struct(F.col(c).alias("c"), d.alias("d"))
    tree = nodes.select(name("conv_id", F.col("depth")).alias("id"), F.when(F.col("depth") > 0, name("parent_conv_id", F.col("depth") - 1)).alias("parent"), F.when(F.col("n_children") == 0, 1).otherwise(0).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    totals = subtree_totals(tree, ["n_leaves", "saved_tokens"], folder).select(F.col("id.c").alias("_c"), F.col("id.d").alias("_d"), "n_leaves", "saved_tokens")
    ends = end_digests(turns, paths, nodes)
    out = nodes.join(totals, (F.col("conv_id") == F.col("_c")) & (F.col("depth") == F.col("_d"))).drop("_c", "_d")
    out = out.join(ends, (F.col("conv_id") == F.col("_n")) & (F.col("depth") == F.col("_e")), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))


def end_digests(turns: DataFrame, paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """_n and _e (a node's conv_id and depth) and SHA-256 of the ids of the conversations that end there.

    Ids are joined to texts of up to 4,096 in parts of their order; a task then runs over each node's texts in order and holds
    one of them at a time.
    """
    ship(turns.sparkSession)
    none = F.lit(0).cast("long")
    last = paths.where("depth = last").select("conv_id", "depth", "x", "y").unionByName(turns.where("last = 0").select("conv_id", none.alias("depth"), none.alias("x"), none.alias("y")).distinct())
    part = F.floor(F.col("conv_id") / IDS)
    texts = last.groupBy("depth", "x", "y", part.alias("part")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    named = nodes.select(F.col("conv_id").alias("_n"), F.col("depth").alias("_e"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    texts = texts.join(named, (F.col("depth") == F.col("_e")) & (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))).select("_n", "_e", "part", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        done: dict[str, list] = {"_n": [], "_e": [], "ends_sha256": []}

        def put() -> None:
            for c, v in zip(done, (*at, state.hexdigest()), strict=True):
                done[c].append(v)

        for batch in batches:
            for n, e, _, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (n, e) != at:
                    if at is not None:
                        put()
                    at, state = (n, e), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pydict(done, schema=_ENDS)
            done = {c: [] for c in done}
        if at is not None:
            put()
            yield pa.RecordBatch.from_pydict(done, schema=_ENDS)

    tasks = max(1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return texts.repartition(tasks, "_n", "_e").sortWithinPartitions("_n", "_e", "part").mapInArrow(run, "_n long, _e long, ends_sha256 string")


_ENDS = pa.schema([("_n", pa.int64()), ("_e", pa.int64()), ("ends_sha256", pa.string())])


def report(conversations: DataFrame, folder: str, rebuild: bool = True) -> DataFrame:
    """Nodes of the trie of all conversations (rebuilt by :func:`shared_starts`, or as they are): the smallest conversation, the depth
    (0: the root), the parent's smallest conversation (null: the root), conversations that begin so, children, childless nodes at and
    below, bytes that storing each node's last text once would save at and below, and the SHA-256 of the ids that end here."""
    turns = numbered_turns(conversations, folder)
    if rebuild:
        turns = shared_starts(turns, folder)
    else:
        turns = stored(turns, folder, "turns")
        turns = turns.join(turns.groupBy("conv_id").agg(F.count("*").alias("last")), "conv_id")
    return trie(turns, folder)


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes in DuckDB's SQL; ``crc`` must be among the relations."""
    data = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint)"
    return f"xor(4294967295, list_reduce({data}, lambda a, b: xor(a >> 8, crc_t[(xor(a, b) & 255) + 1]), 4294967295::bigint))"


#: The table of CRC-32.
CRC_SQL = "crc as materialized (select list(list_reduce(range(8), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)), b::bigint) order by b) as crc_t from range(256) r(b))"
#: The report in DuckDB's SQL: nodes by their whole turns, subtrees by each node's smallest conversation.
SQL = f"""with {CRC_SQL},
  src as (select conv_id as c, turn, coalesce(role, '') as r, coalesce(text, '') as t from conversations where conv_id is not null),
  turns as (select *, row_number() over (partition by c order by turn nulls first, r, sha256(length(r) || ':' || r || t)) as k from src),
  own as (select c, count(*) as n from turns group by 1),
  plan as (select c, n, h, c - c % 5 as d from (select *, {crc32_sql('c::varchar')} % 9 as h from own, crc)),
  full_plan as (select p.*, least(h, coalesce(o.n, 0)) as taken from plan p left join own o on o.c = p.d),
  rebuilt as (select p.c, t.k, t.r, t.t from full_plan p join turns t on t.c = p.d and t.k <= p.taken union all select p.c, p.taken + t.k - p.h, t.r, t.t from full_plan p join turns t on t.c = p.c and t.k > p.h),
  path as (select c, k as depth, octet_length(encode(t))::bigint as bytes, sha256(string_agg(sha256(length(r) || ':' || r || t), '' order by k) over (partition by c order by k rows unbounded preceding)) as key from rebuilt union all select c, 0, 0, '' from own),
  ends as (select c, max(depth) as depth from path group by 1),
  closing as (select p.key, string_agg(e.c::varchar, ',' order by e.c) as ids from ends e join path p using (c, depth) group by 1),
  node as (select depth, key, min(c) as c, count(*) as n_convs, any_value(bytes) as bytes from path group by all),
  linked as (select n.*, a.c as parent from node n left join path q on q.c = n.c and q.depth = n.depth - 1 left join node a on a.key = q.key and a.depth = q.depth),
  kids as (select parent as c, depth - 1 as depth, count(*) as n_children from linked where depth > 0 group by all),
  counted as (select l.*, coalesce(k.n_children, 0) as n_children from linked l left join kids k using (c, depth)),
  total as (select u.key, u.depth, count_if(v.n_children = 0) as n_leaves, sum((v.n_convs - 1) * v.bytes)::bigint as saved from counted v join path u on u.c = v.c and u.depth <= v.depth group by all)
  select c as conv_id, depth::bigint as depth, parent as parent_conv_id, n_convs, n_children, n_leaves, saved as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256 from counted join total using (key, depth) left join closing using (key)"""
