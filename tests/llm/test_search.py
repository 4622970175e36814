"""Spelling variants, exact top-k search and the Merkle manifest against brute force and SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quantgrid.llm import merkle, topk, variants
from quantgrid.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize(("name", "table"), [("op11_asymmetric_chunk_variants", "documents"), ("op12_no_random_access_top_k", "embeddings"), ("op13_merkle_manifest", "documents")])
def test_against_sql(spark, sf, name, table):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    got, cur = QUERIES[name](spark, sf), con.execute(ORACLES[name])
    assert [d[0] for d in cur.description] == got.columns
    found = sorted((tuple(r) for r in got.collect()), key=repr)
    assert found == sorted(cur.fetchall(), key=repr) and found


# Spelling variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def grouped(words, ratio=10):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if words[b] >= ratio * words[w]}
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(out, key=repr)


def counted(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            if len(word) >= 7:
                n[word] += 1
    return {w: k for w, k in n.items() if k >= 2}


@pytest.mark.parametrize("bucket", [256, 3])
def test_groups(spark, bucket):
    rnd = random.Random(bucket)
    words = {}
    for _ in range(60):  # edits of edits, over few letters so that chunks meet often
        word = "".join(rnd.choice("abcé") for _ in range(rnd.randrange(7, 14)))
        n = rnd.choice([2, 9, 10, 50, 100, 1000])
        for _ in range(5):
            words[word] = n
            at, kind = rnd.randrange(len(word) + 1), rnd.randrange(3)
            word = word[:at] + ("" if kind == 1 else rnd.choice("abcé")) + word[at + (kind > 0) :]
            word, n = word + "a" * (7 - len(word)), max(2, n // rnd.choice([1, 2, 10, 11]))
    words |= {f"common{c}{d}": 2 for c in "abcdefghijklm" for d in "abcdefghijklm"}  # a chunk that very many words share
    words |= {"common" + "x" * 70: 3, "common" + "x" * 71: 40, "aaaaaaaa": 5, "aaaaaaaaa": 60}
    words |= {"chained": 2000, "chainedd": 150, "cchainedd": 9}  # a chain of forms
    got = variants.group_variants(spark.createDataFrame(list(words.items()), "word string, n long"), bucket=bucket).collect()
    assert sorted((tuple(r) for r in got), key=repr) == grouped(words)
    assert sum(r.root not in (r.word, r.form) for r in got) > 0


def test_counts_and_cuts(spark):
    rnd = random.Random(1)
    stock = ["Straßenbahn", "ÉCOLES", "ÉCOLESÉ", "Hôpital×÷", "seventy", "seventyX", "short", "x" * 30_000, "a1seventy_b", *("".join(rnd.choice("abcdefgh") for _ in range(8)) for _ in range(200))]
    docs = [(i if i % 50 else None, " ".join(rnd.choice(stock) for _ in range(rnd.randrange(40)))) for i in range(300)] + [(7, None), (8, "")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.word: r.n for r in variants.count_words(table).collect()}
    assert got == counted(docs)
    assert any(len(w) == 29_999 for w in got) or "x" * 30_000 in got


def test_variants_odd(compare, odd):
    found = compare(lambda docs: variants.group_variants(variants.count_words(docs)))
    assert sorted((tuple(r.values()) for r in found), key=repr) == grouped(counted([(r.doc_id, r.text) for r in odd.collect()]))


# Top-k search


def ranked(rows, k=5):
    rows = [(i, [int(np.floor(256 * np.float64(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in rows:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in rows if j != i)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int"


def search(df):
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())


@pytest.mark.parametrize("small", [False, True])
def test_search(spark, monkeypatch, small):
    rng = np.random.default_rng(2)
    if small:  # many blocks, slices and query blocks
        monkeypatch.setattr(topk, "QUERIES", 3)
        monkeypatch.setattr(topk, "SLICE", 2)
    rows = [(i, rng.normal(size=8).astype("f4").tolist(), 0) for i in range(600)]
    rows += [(1000 + i, rows[100][1], 0) for i in range(400)]  # a third of all are copies of a query: ties by the smaller id
    rows += [(100, rows[100][1], 1), (100, rows[3][1], 1), (300, [0.0] * 8, 0), (2001, [1.0, 2.0], 0), (2050, [], 0)]
    rows += [(2100, None, 0), (2101, [None] * 8, 0), (2150, [float("nan")] * 8, 0), (2200, [float("inf")] + [0.0] * 7, 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, VECTORS).repartition(7)
    assert search(df) == ranked([(i, v) for i, v, _ in rows])
    clash = df.select("*", *[F.lit(1).alias(c) for c in ("vector", "query", "score", "part", "slice", "block", "asked", "rank")])
    assert search(clash) == search(df)


def test_few_and_no_vectors(spark):
    assert search(spark.createDataFrame([], VECTORS)) == []
    assert search(spark.createDataFrame([(0, [1.0], 0)], VECTORS)) == []
    assert search(spark.createDataFrame([(3, [1.0], 0)], VECTORS)) == []
    assert search(spark.createDataFrame([(0, [1.0], 0), (2, [-1.0], 0), (1, [-1.0], 0)], VECTORS)) == [(0, 1, 1, -65536), (0, 2, 2, -65536)]
    assert search(spark.createDataFrame([(0, None, 0)], VECTORS)) == []


def test_reading_stops_early():
    rng = np.random.default_rng(3)
    vectors = np.floor(256 * rng.normal(size=(1000, 16)) / 4).astype(np.int64)
    queries, lists = vectors[:40], topk.sorted_lists(vectors)
    scores = queries @ vectors.T
    own = np.arange(40)[:, None] == np.arange(1000)[None, :]
    least = np.sort(np.where(own, -(10**9), scores), axis=1)[:, -5].astype(float)
    for bar in (least, np.full(40, -np.inf)):
        which, rows, found = topk.search_block(vectors, lists, queries, own, bar, 5)
        assert (found == scores[which, rows]).all() and not own[which, rows].any()
        for q in range(40):
            best = set(np.flatnonzero((scores[q] >= least[q]) & ~own[q]))
            assert best <= set(rows[which == q])  # none that qualifies is left out
    assert len(topk.search_block(vectors, lists, queries, own, least, 5)[0]) < 40 * 1000 * topk.FEW  # and few others are resolved
    large = vectors * 2**20  # sums beyond what doubles hold
    which, rows, found = topk.search_block(large, topk.sorted_lists(large), large[:40], own, np.full(40, -np.inf), 5)
    assert (found == scores[which, rows] * 2**40).all()


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes, fanout):
    """The root, and for each leaf the siblings of each level as (left, right)."""
    sides, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            start = p - p % fanout
            sides[i].append(("".join(nodes[start:p]), "".join(nodes[p + 1 : start + fanout])))
        nodes = [sha(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [p // fanout for p in at]
    return nodes[0], sides


def brute_manifest(rows, fanout):
    """(doc_id, leaf, subroot, root, siblings) for rows (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row)))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    found = {s: tree([x[2] for x in sorted(trees[s])], fanout) for s in order}
    root, above = tree([found[s][0] for s in order], fanout)
    return [(x[1] if x[0] else None, x[2], found[s][0], root, below + above[i]) for i, s in enumerate(order) for x, below in zip(sorted(trees[s]), found[s][1], strict=True)]


@pytest.mark.parametrize(("fanout", "levels"), [(16, 3), (2, 2), (3, 1)])
def test_manifest(spark, monkeypatch, fanout, levels):
    monkeypatch.setattr(merkle, "FANOUT", fanout)
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rnd = random.Random(fanout)
    rows = []
    for s, n in ((None, 20), ("", 1), ("a", 130), ("b", 16), ("é", 17), ("Z", 2), *((f"s{i}", 1) for i in range(20))):
        rows += [(rnd.randrange(10_000), s, rnd.choice(["en", None]), rnd.choice([1, None]), rnd.choice(["", None, "Tëxt", "x" * 3000])) for _ in range(n)]
    rows += [rows[30]] * 3 + [(None, "a", None, None, None)]  # repeated rows, a row without an id
    rnd.shuffle(rows)
    got = merkle.manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5))
    got = got.withColumn("folded", merkle.fold(F.col("leaf"), F.col("sides"))).collect()
    assert all(r.folded == r.root for r in got)
    own = [(r.doc_id, r.leaf, r.subroot, r.root, [(bytes(x.left).decode(), bytes(x.right).decode()) for x in r.sides]) for r in got]
    assert sorted(own, key=repr) == sorted(brute_manifest(rows, fanout), key=repr)


def test_tampering_is_found(spark, sf):
    got = QUERIES["op13_merkle_manifest"](spark, sf).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.verified for r in got} == {True, False}
    for r in got:
        changed = zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and text[r.doc_id] is not None and re.search("[A-Z]", text[r.doc_id])
        assert r.verified == (r.folded_root == r.root) == (not changed)


def test_manifest_odd(compare, odd):
    found = compare(lambda docs: merkle.manifest(docs).drop("sides"))
    want = brute_manifest([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd.collect()], 16)
    assert sorted((tuple(r.values()) for r in found), key=repr) == sorted((x[:4] for x in want), key=repr)
