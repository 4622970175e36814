"""Fingerprints, line deduplication and the Jaccard join against brute force."""

import hashlib
import random
import re

import pytest

from quantgrid.llm import jaccard, lines, shingles, syncmers
from quantgrid.llm.components import components

WORDS = [f"w{i}" for i in range(400)]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def test_syncmers_are_context_free():
    rnd = random.Random(1)
    passage = prose(rnd, 60)
    for k, s in ((24, 8), (20, 6), (9, 4)):
        own = set(zip(*(x.tolist() for x in syncmers.anchors(passage, k, s)), strict=True))
        before = prose(rnd, 30)
        place, hashes = syncmers.anchors(before + passage + prose(rnd, 30), k, s)
        assert own <= {(p - len(before), h) for p, h in zip(place.tolist(), hashes.tolist(), strict=True)}
    # A brute-force choice of the k-mers.
    k, s = 24, 8
    place, _ = syncmers.anchors(passage)
    order = {passage[i : i + s]: None for i in range(len(passage) - s + 1)}
    points = syncmers.np.frombuffer(passage.encode("utf-32-le"), "<u4").astype("uint64") + syncmers.np.uint64(1)
    for i in range(len(passage) - s + 1):
        order[passage[i : i + s]] = int(syncmers.mix((points[i : i + s] * syncmers._powers(s)).sum(keepdims=True))[0])
    want = [i for i in range(len(passage) - k + 1) if min(v := [order[passage[i + j : i + j + s]] for j in range(k - s + 1)]) in (v[0], v[-1])]
    assert place.tolist() == want


def test_likeness():
    rnd = random.Random(2)
    text = prose(rnd, 300)
    same, other = syncmers.fingerprint(text), syncmers.fingerprint(prose(rnd, 300))
    assert syncmers.likeness(same, same) == (1.0, 0)
    assert syncmers.likeness(same, other)[0] < 0.1
    near, shift = syncmers.likeness(same, syncmers.fingerprint("hello " + text))
    assert near > 0.9 and shift == 6
    assert syncmers.likeness("", "")[0] == 1 and syncmers.likeness("", same)[0] == 0


def test_likeness_of_long_texts():
    rnd = random.Random(3)
    passage = prose(rnd, 50)
    for _ in range(10):  # a passage of about a hundredth of all anchors, found each time and counted exactly
        one, other = (prose(rnd, 1500) + passage + prose(rnd, 1500) for _ in range(2))
        a, b = (set(syncmers.anchors(x)[1].tolist()) for x in (one, other))
        near, _ = syncmers.likeness(syncmers.fingerprint(one), syncmers.fingerprint(other))
        assert near == 2 * len(a & b) / (len(a) + len(b)) > 0.005


def test_likeness_across_lengths():
    def near(one, other):
        return syncmers.likeness(syncmers.fingerprint(one), syncmers.fingerprint(other))[0]

    texts = [prose(random.Random(i), 60)[:96] for i in range(50)]
    assert all(len(x) == 96 and near(x, x[:95]) > 0.7 for x in texts)  # near copies on both sides of the border
    assert all(near(x[:60], x[:59] + "#") > 0.7 for x in texts)  # and among short ones
    rnd = random.Random(4)
    tiny = list({"".join(rnd.choice("abcdefgh .") for _ in range(n)) for n in (1, 2, 5, 6, 7, 8, 9) for _ in range(20)} | {"Thtion.", "Die tz."})
    assert all(syncmers.fingerprint(x) for x in tiny)
    assert all(near(x, "") == 0 and near(x, x) == 1 for x in tiny)
    assert near("Thtion.", "Die tz.") == 0


def test_followers_across_ranges(spark):
    docs = [(i // 3 * 2**54 + i % 2 if i else None, prose(random.Random(i), 5 + i % 60)) for i in range(90)]
    got = syncmers.edited_fingerprints(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    order = [x for _, x in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]
    want = []
    for text, after in zip(order, order[1:] + order[:1], strict=True):
        want.append(hashlib.sha256((text[: len(text) - len(text) // 4] + after[: len(text) // 4]).encode()).hexdigest())
    assert sorted(r.edited_sha256 for r in got) == sorted(want)


def test_fingerprint_operator(spark, compare):
    found = compare(syncmers.edited_fingerprints)
    assert len(found) == 12 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    assert all(r["fingerprint"] == "" for r in found if not r["n_chars"])
    docs = [(i, prose(random.Random(i), 20 + i % 50)) for i in range(200)]
    got = {r.doc_id: r for r in syncmers.edited_fingerprints(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    for i, text in docs:
        after = docs[(i + 1) % 200][1]
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (syncmers.fingerprint(text), syncmers.fingerprint(edited))
        assert got[i].near_edited == syncmers.likeness(syncmers.fingerprint(text), syncmers.fingerprint(edited))[0]
        assert got[i].near_next == syncmers.likeness(syncmers.fingerprint(text), syncmers.fingerprint(after))[0]
    one = syncmers.edited_fingerprints(spark.createDataFrame([(1, "only one text here")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1 and one[0].near_edited <= 1


def kept_lines(docs):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    low = lambda i: -1 if i is None else i
    holders = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(low(i))
    out = []
    for i, text in docs:
        own = (text or "").split("\n")
        stay = [x for x in own if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == low(i)]
        out.append((i, len(own), len(own) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 3), (4, 3), (7, 2)])
def test_line_dedup(spark, batches, fanout):
    rnd = random.Random(batches)
    stock = ["Some line that is long", " some LINE that is long\t", "short", "ÉCOLE et ÇA AUSSI", "école et ça aussi", "é" * 9, "é" * 10, "", *(prose(rnd, 4) for _ in range(30))]
    docs = [(i, "\n".join(rnd.choice(stock) for _ in range(rnd.randrange(8)))) for i in range(60)] + [(None, "Some line that is long\nx"), (3, "Some line that is long")]
    got = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), batches, fanout)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == kept_lines(docs)


def test_line_dedup_odd(compare, odd):
    found = compare(lines.dedup_lines)
    assert sorted((tuple(r.values()) for r in found), key=repr) == kept_lines([(r.doc_id, r.text) for r in odd.collect()])
    carried = lines.dedup_lines(odd, carry=("lang", "source"))
    assert carried.columns == ["doc_id", "n_lines", "n_dropped", "text", "lang", "source"] and carried.count() == 12


def brute(docs, threshold=0.8):
    def of(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets, n = [of(t) for _, t in docs], len(docs)
    near = lambda a, b: a == b or (len(a & b) >= threshold * len(a | b) - 1e-9)
    low = [float("-inf") if i is None else i for i, _ in docs]
    label, links = list(low), [sum(near(sets[i], sets[j]) for j in range(n) if j != i) for i in range(n)]
    adjacent = [[j for j in range(n) if near(sets[i], sets[j])] for i in range(n)]
    while True:
        fresh = [min(label[j] for j in adjacent[i]) for i in range(n)]
        if fresh == label:
            break
        label = fresh
    return sorted(((i, None if label[k] == float("-inf") else label[k], links[k]) for k, (i, _) in enumerate(docs)), key=repr)


@pytest.mark.parametrize("blocks", [False, True])
def test_jaccard_join(spark, monkeypatch, blocks):
    rnd = random.Random(5)
    docs = []
    for _ in range(40):  # groups of near copies, some chained
        text = prose(rnd, rnd.randrange(6, 120)).split()
        for _ in range(rnd.randrange(1, 6)):
            docs.append((len(docs), " ".join(text)))
            text = list(text)
            text[rnd.randrange(len(text))] = "other"
    passage = prose(rnd, 60)
    docs += [(1000 + i, prose(rnd, 60) + " " + passage) for i in range(90)]  # they share a passage but aren't near
    alike = prose(rnd, 150).split()
    for i in range(150):  # one large group of near copies, more than a bucket may hold
        own = list(alike)
        own[rnd.randrange(150)] = f"edit{i}"
        docs.append((2000 + i, " ".join(own)))
    docs += [(3000 + i, "same words in all of these copies here") for i in range(50)]
    if blocks:
        monkeypatch.setattr(jaccard, "SMALL", 30)
        monkeypatch.setattr(jaccard, "BLOCK", 40)
    got = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(6))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs)


def test_jaccard_join_odd(compare, odd):
    found = compare(jaccard.near_duplicates)
    assert sorted((tuple(r.values()) for r in found), key=repr) == brute([(r.doc_id, r.text) for r in odd.collect()])
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([None, None, 5, 6, 7, 8, 9], key=repr)


def test_common_counts_in_slabs():
    rng = shingles.np.random.default_rng(1)
    sets = [shingles.np.unique(rng.integers(0, 300, rng.integers(0, 200))) for _ in range(30)]
    got = shingles.common_counts(sets, slab=7)
    assert all(got[i, j] == len(set(a.tolist()) & set(b.tolist())) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (101, 102), (103, 100), (200, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 104), 100), 200: 200}


def test_repeated_ids_with_other_texts_stay(spark):
    rnd = random.Random(8)
    a, b, c, d = (prose(rnd, 40) for _ in range(4))
    near = a.rsplit(" ", 1)[0] + " edited"
    docs = [(1, a, "x"), (1, b, "x"), (2, c, "x"), (3, near, "x"), (4, b, "x"), (4, d, "x"), (None, c, "x"), (None, d + " more", "x"), (5, a, "x"), (5, a, "y"), (2, c, "z")]
    kept = jaccard.one_of_each(spark.createDataFrame(docs, "doc_id long, text string, node string").repartition(3))
    assert kept.columns == ["doc_id", "text", "node"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, a), (1, b), (None, c), (None, d + " more")], key=repr)
