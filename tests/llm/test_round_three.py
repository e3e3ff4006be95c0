"""Spelling variants, conversation tries and web archives against brute force."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxaloom.llm import contraction, conversation_trie, spelling_variants, warc
from taxaloom.llm.common import shared_dir

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


# Spelling variants


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def counted_words(docs: list[tuple]) -> Counter:
    out: Counter = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return Counter({w: n for w, n in out.items() if len(w) >= 7 and n >= 2})


def expected_variants(words: Counter) -> list[tuple]:
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and edits(v, w) == 1] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w: str) -> str:
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), words[w], len(near[w]), form[w] and words[form[w]]) for w in words)


def variant_docs() -> list[tuple]:
    rng = random.Random(3)
    base = ["".join(rng.choice("abéd") for _ in range(rng.randint(7, 10))) for _ in range(12)] + ["straßenbahn", "ÀLAMODE" + "X", "aaaaaaaa", "aaaaaaaaa"]
    docs: list[tuple] = []
    for k in range(60):
        some = []
        for w in base:
            some += [w] * rng.choice([0, 1, 3])
            if rng.random() < 0.4:
                i = rng.randrange(len(w))
                some.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + "b" + w[i:], w[:i] + "a" + w[i + 1 :]]))
        rng.shuffle(some)
        docs.append((k, rng.choice([" ", "-", "\n"]).join(some)))
    # A chain of forms: thousandfold, hundredfold, tenfold.
    docs += [(100, "chainword " * 1100), (101, "chainwordy " * 105), (102, "chainwordyz " * 9), (103, None), (None, "chainword chainword"), (104, ""), (105, "Chainword×chainword " * 3)]
    return [*docs, docs[0], (106, "x" * 50_000 + " " + "x" * 50_000)]


def test_variants_equal_brute_force(spark):
    docs = variant_docs()
    df = spark.createDataFrame([(*d, 1, "w") for d in docs], "doc_id long, text string, n int, word string").repartition(3)
    got = spelling_variants.variants(spelling_variants.words(df), shared_dir(spark, "test"))
    expected = expected_variants(counted_words(docs))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == expected
    assert any(r[1] and r[2] != r[1] for r in expected)  # a form of a form


def test_variants_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_variants.variants(spelling_variants.words(df), shared_dir(spark, "test")).count() == 0


@pytest.mark.parametrize(("distance", "parts", "pieces"), [(2, 1, 5), (1, 1, 3), (2, 2, 4), (2, 3, 1), (1, 2, 2)])
def test_near_multisets_share_a_signature(distance, parts, pieces):
    rng = random.Random(distance * 100 + parts * 10 + pieces)
    for _ in range(200):
        a = [rng.choice("abcdefgh") for _ in range(rng.randint(7, 12))]
        b = list(a)
        if distance == 2:
            b[rng.randrange(len(b))] = rng.choice("abcdefghz")
        else:
            b.insert(rng.randrange(len(b)), rng.choice("abcz"))
        rng.shuffle(b)
        letters = np.array([ord(c) for c in a + b], np.uint32)
        sign = spelling_variants.signatures(letters, np.array([0, len(a), len(a) + len(b)]), distance, parts, pieces)
        assert (sign[0] == sign[1]).any()


def test_unlike_words_seldom_meet():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(500)]
    import pyarrow as pa

    _, role, key = spelling_variants.keys(pa.array(words))
    same = [n for n in Counter(key[role == 0].tolist()).values() if n > 1]
    assert sum(same) < 50


# Conversations


def expected_nodes(rows: list[tuple], rebuild: bool = True) -> list[tuple]:
    own: dict[int, list] = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    turns = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in own.items()}
    if rebuild:
        built = {}
        for c, mine in turns.items():
            h = zlib.crc32(str(c).encode()) % 9
            donor = c - (abs(c) % 5) * (1 if c >= 0 else -1)
            built[c] = turns.get(donor, [])[:h] + mine[h:]
        turns = built
    members: dict[tuple, list] = defaultdict(list)
    for c, t in turns.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in m if len(turns[c]) == len(p))))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], sum(kids[q] == 0 for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def conversations(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows: list[tuple] = []
    for c in [*range(-7, 60), 1000, 1001, 1004, 90_000]:
        for k in range(rng.choice([1, 2, 3, 9, 12])):
            rows.append((c, k, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "c"])))
    rows += [(5, None, "system", "first"), (5, None, "system", "first"), (6, 0, None, None), (7, 3, "user", ""), (None, 1, "user", "lost"), (12, 1, "user", "tie"), (12, 1, "tool", "tie")]
    rows += [(200, k, "user", f"t{k}") for k in range(2500)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rebuild", [True, False])
def test_trie_equals_brute_force(spark, rebuild):
    rows = [r for r in conversations(1) if r[0] != 200] + [(200, k, "user", f"t{k}") for k in range(40)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, n int").repartition(5)
    got = conversation_trie.report(df, shared_dir(spark, "test"), rebuild)
    assert sorted(map(tuple, got.collect())) == expected_nodes(rows, rebuild)


def test_trie_of_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "BLOCK", 64)
    df = spark.createDataFrame(conversations(2), "conv_id long, turn long, role string, text string").repartition(4)
    got = {(r.conv_id, r.depth): r for r in conversation_trie.report(df, shared_dir(spark, "test")).collect()}
    deep = [r for r in got.values() if r.conv_id == 200 and r.depth > 8]
    assert max(r.depth for r in deep) == 2500 and all(r.n_convs == 1 and r.n_leaves == 1 and r.saved_tokens == 0 and r.parent_conv_id is not None for r in deep)


def test_trie_of_an_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie.report(df, shared_dir(spark, "test")).count() == 0


def test_ends_of_many_equal_conversations(spark):
    rows = [(c, 0, "user", "same") for c in range(5000, 14_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = conversation_trie.report(df, shared_dir(spark, "test"), rebuild=False).where("depth = 1").first()
    assert got.n_convs == 9000 and got.saved_tokens == 8999 * 4
    assert got.ends_sha256 == hashlib.sha256(",".join(str(c) for c in range(5000, 14_000)).encode()).hexdigest()


@pytest.mark.parametrize("shape", ["path", "star", "random", "caterpillar", "binary", "forest"])
def test_contraction_equals_direct_sums(spark, shape):
    rng = random.Random(7)
    n = 300
    parent = {
        "path": lambda i: i - 1, "star": lambda i: 0, "random": lambda i: rng.randrange(i), "caterpillar": lambda i: i - 1 if i % 2 else i - 2, "binary": lambda i: (i - 1) // 2, "forest": lambda i: None if i % 40 == 0 else i - rng.randint(1, i % 40),
    }[shape]
    tree = [(i, None if i == 0 else parent(i), rng.randint(-5, 9), i) for i in range(n)]
    sums = {i: [v, w] for i, _, v, w in tree}
    for i, p, _, _ in reversed(tree):
        if p is not None:
            sums[p] = [a + b for a, b in zip(sums[p], sums[i], strict=True)]
    got = contraction.subtree_totals(spark.createDataFrame(tree, "id long, parent long, v long, w long"), ["v", "w"], shared_dir(spark, "test"))
    assert sorted(map(tuple, got.collect())) == sorted((i, *s) for i, s in sums.items())


def test_contraction_of_a_cycle_raises(spark):
    tree = spark.createDataFrame([(1, 2, 1), (2, 1, 1), (3, 1, 1), (4, None, 1)], "id long, parent long, v long")
    with pytest.raises(ValueError):
        contraction.subtree_totals(tree, ["v"], shared_dir(spark, "test"))


# Web archives


def pages() -> list[tuple]:
    rows = [(i, f"https://example.org/{i}?q=a b", f"<p>page {i % 7} é</p>") for i in range(40)]
    rows += [(100, "https://example.org/x", None), (101, None, ""), (102, "a\r\nb: c", "\r\n\r\nWARC/1.1\r\n\r\n"), (None, "https://example.org/null", "<p>page 3 é</p>"), (None, None, "alone"), (103, "null", "x" * 3_000_000)]
    return [*rows, rows[39], rows[39], rows[0]]


def test_archives_round_trip(spark):
    rows = pages()
    folder = shared_dir(spark, "test")
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, key string, top int").repartition(3)
    warc.write_captures(df, folder, archive_bytes=4000, range_bytes=1500)
    records = warc.read_records(spark, folder)
    assert dict(records.groupBy("kind").count().collect())["request"] == len(rows)
    assert records.where("not intact").count() == 0 and warc.orphans(records).count() == 0
    assert records.select("file", "record_id").distinct().count() == records.count()
    found = warc.resolved(warc.captures(records)).cache()
    assert found.where("request is null or metadata is null or n_request <> 1 or n_metadata <> 1").count() == 0
    top: dict[str, int | None] = {}
    for page_id, _, html in rows:
        text = html or ""
        top[text] = max((x for x in (top.get(text), page_id) if x is not None), default=None)
    expected = []
    for page_id, _, html in rows:
        data, best = (html or "").encode(), top[html or ""]
        expected.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if page_id == best else "revisit", None if page_id == best else best))
    order = lambda r: tuple((v is not None, v) for v in r)
    assert sorted((tuple(r)[:5] for r in warc.digests(found).collect()), key=order) == sorted(expected, key=order)
    assert sorted(((r.page_id, r.url) for r in found.select("page_id", "url").collect()), key=order) == sorted(((p, u) for p, u, _ in rows), key=order)
    held = {r.page_id: bytes(r.payload) for r in found.where("main.kind = 'response'").select("page_id", F.col("main.payload").alias("payload")).collect()}
    assert held[102] == rows[42][2].encode() and held[103] == b"x" * 3_000_000


def test_archives_of_an_empty_table(spark):
    folder = shared_dir(spark, "test")
    warc.write_captures(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    records = warc.read_records(spark, folder)
    assert records.count() == 0 and warc.digests(warc.resolved(warc.captures(records))).count() == 0


def test_records_name_each_other_either_way(spark):
    schema = "file string, record_id string, kind string, concurrent_to array<string>, fields map<string,string>"
    rows = [("f", "r1", "response", ["q1"], None), ("f", "q1", "request", [], None), ("f", "m1", "metadata", ["r1"], {"a": "1"}), ("f", "m0", "metadata", ["r1"], {"a": "0"}), ("f", "q2", "request", ["gone"], None), ("g", "q3", "request", ["r1"], None), ("f", "r2", "revisit", [], None)]
    df = spark.createDataFrame(rows, schema)
    got = {r.main.record_id: r for r in warc.captures(df).collect()}
    assert (got["r1"].request.record_id, got["r1"].metadata.record_id, got["r1"].n_metadata) == ("q1", "m0", 2)
    assert got["r2"].request is None and got["r2"].n_request == 0
    assert {r.record_id for r in warc.orphans(df).collect()} == {"q2", "q3"}


def test_a_cut_archive_is_told():
    whole = warc.record("metadata", "urn:x", b"a: b\r\n", Content_Type="application/warc-fields")
    assert len(list(warc.members(iter([whole[:5], whole[5:] + whole])))) == 2
    with pytest.raises(ValueError):
        list(warc.members(iter([whole, whole[:20]])))
