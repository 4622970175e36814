"""Personal data, secrets, quality rules and the quality classifier."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quantgrid.llm import credentials, outliers, privacy, quality
from quantgrid.llm.spans import matches


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def only(s):
    return re.sub("[^0-9]", "", s)


PRIVATE = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: max(map(int, s.split("."))) <= 255),
    (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(only(s)) <= 19 and luhn(only(s))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(only(s)) <= 15),
]
SECRET = [
    (r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
    (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
]


def private(text):
    return [(k, m.start(), m.end()) for k, (p, good) in enumerate(PRIVATE) for m in re.finditer(p, text) if good(m[0])]


def secret(text):
    return sorted((m.start(), k, m.end()) for k, (p, good) in enumerate(SECRET) for m in re.finditer(p, text) if good(m))


def noise(pieces, n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(12))) for _ in range(n)]


def test_private_base_forms(spark):
    pieces = ["a.b@c.d", "@", "x@y", ".", "..", "_", " ", "-", "1.2.3.4", "256.1.1.1", "00255.1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 1234", "567", "+1", "é🙂", "12", "+", "\n", "a@b.c_d@e.f"]
    texts = noise(pieces, 600, 1) + ["1" * 20_000, "a" * 20_000 + "@b.c", "7-" * 9_000, "a@" + "b." * 5_000 + "c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in privacy.find_private(docs).collect()}
    for i, text in enumerate(texts):
        base = [tuple(x) for x in got[i].base]
        assert base == private(text), repr(text[:200])
        assert set(base) <= {tuple(x) for x in got[i].spans}


def test_private_loose_forms(spark, compare):
    texts = ["please call me by phone: 030 1234 5678 tomorrow"] * 20 + ["mail to john.doe (at) example (dot) com"] * 20 + ["4111 1111 1111 1112 is no card", "from 172.242.194.228 on", "nothing here"]
    texts += ["phone +49 30 123456 or call +1 212 555 0100"] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in privacy.find_private(docs).collect()}
    assert got[0] == [(3, 25, 38)] and got[20] == [(0, 8, 39)]
    assert got[40] == [] and got[42] == [] and got[41] == [(1, 5, 20)]
    found = compare(privacy.find_private)
    assert [r["base"] for r in found if r["doc_id"] in (2, 3, 4)] == [[], [], []]


def test_reliabilities():
    rng = random.Random(4)
    good, counts = (0.95, 0.9, 0.6, 0.8, 0.55), Counter()
    for _ in range(4000):
        true = rng.random() < 0.4
        counts[0, tuple(int(true) if rng.random() < g else int(not true) for g in good)] += 1
    model, post = privacy.reliabilities([(k, v, n) for (k, v), n in sorted(counts.items())])
    share, rates = model[0]
    assert abs(share - 0.4) < 0.04
    assert all(abs(a - g) < 0.06 and abs(b - (1 - g)) < 0.06 for (a, b), g in zip(rates, good, strict=True))
    assert post[0, (1, 1, 1, 1, 1)] > 0.99 > 0.01 > post[0, (0, 0, 0, 0, 0)]
    weights = privacy.classifier([(0, (1, 0, 0, 0, 0, 0, 0), 0.95, 100), (0, (0, 0, 0, 0, 0, 0, 0), 0.05, 100)])
    assert weights[0][0] > 1 and len(weights) == 4 and not any(weights[1])


def test_secret_base_forms(spark):
    pieces = ["password", "Token", "api_key", "API-KEY", "apikey", "=", ":", " ", "'", '"', "hunter2", "abc", "AKIA", "IOSFODNN7EXAMPLE", "A1" * 9, "0123456789abcdef", "fe", "\n", "é🙂", "passwd:", "          "]
    texts = noise(pieces, 600, 2) + ["f" * 20_000, "token" + " " * 300 + "=" + "z" * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in credentials.find_secrets(docs).collect()}
    for i, text in enumerate(texts):
        assert [tuple(x) for x in got[i].base] == secret(text), repr(text[:200])
        assert set(map(tuple, got[i].base)) <= set(map(tuple, got[i].spans))


def entropy(s, w):
    h = lambda x: -sum(n / w * math.log2(n / w) for n in Counter(x).values())
    return max((h(s[i : i + w]) for i in range(len(s) - w + 1)), default=None)


def test_window_entropy(spark):
    rnd = random.Random(6)
    alphabet = credentials.CLASSES["alnum"][1]
    strings = ["".join(rnd.choice(alphabet[: rnd.randrange(1, 62)]) for _ in range(rnd.randrange(0, 60))) for _ in range(60)]
    df = spark.createDataFrame([(s,) for s in strings], "s string")
    for s, h in df.select("s", credentials.window_entropy(F.col("s"), alphabet)).collect():
        want = entropy(s, credentials.WINDOW)
        assert (h is None) == (want is None) and (h is None or abs(h - want) < 1e-9)


def test_entropy_spans_and_allow_list(spark, compare):
    key = "kJ8s2LmQ9xZ4vB7nT1wY6pRdE3"
    texts = [f"see {key} here", "id 123e4567-e89b-12d3-a456-426614174000 ok", "internationalization-and-localization-2020", "plain words only, nothing else", f"password={key}", "1234567890123456789012345"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in credentials.find_secrets(docs).collect()}
    assert got == {0: [(4, 3, 4 + len(key))], 1: [], 2: [], 3: [], 4: [(0, 0, 9 + len(key))], 5: [(0, 2, 25)]}
    clean = {r.doc_id: r.text for r in credentials.redact_secrets(docs).collect()}
    assert clean[0] == "see [secret] here" and clean[4] == "[secret]" and clean[1] == texts[1]
    compare(credentials.find_secrets)
    compare(credentials.redact_secrets)


def test_matches_of_many(spark):
    text = "é1 22 " * 700
    row = spark.createDataFrame([(text,)], "t string").select(matches(F.col("t"), "[0-9]+", F.lit(True)).alias("m")).first()
    assert [(x.start, x.end, x.s) for x in row.m] == [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", text)]


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    rows = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(rows) - len(set(rows)), len(covered), failed


def test_rule_counts(spark, compare, odd):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    texts = noise(["a ", "b ", "c\n", "a b c d e ", "\n", " # ", "é🙂 ", "\t", "x\x0by ", " "], 400, 3)
    texts = [t * (1 + i % 3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for r in outliers.judge(docs).collect():
        assert tuple(r[n] for n in names) == counts(texts[r.doc_id]), repr(texts[r.doc_id])
        assert not (r.kept and r.base_failed)
    found = compare(outliers.judge)
    want = Counter((r.doc_id, *counts(r.text or "")) for r in odd.collect())
    assert want == Counter((r["doc_id"], *(r[n] for n in names)) for r in found)


def test_outliers(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8)))
    good = [(i, " ".join(word() for _ in range(rnd.randrange(15, 300))), "en", f"s{i % 2}") for i in range(400)]
    bad = [(1000 + i, " ".join(word() + "###" for _ in range(200)), "en", "s0") for i in range(60)]
    got = {r.doc_id: r for r in outliers.judge(spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[1000 + i].kept for i in range(60))
    assert sum(got[i].kept for i in range(400)) >= 398


def test_concentration_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.multivariate_normal([0, 1, 2, 3], np.diag([1, 4, 1, 2]) + 0.5, 3000)
    x[:500] += 40
    names = list(outliers.PARTS)
    df = spark.createDataFrame([("g", i % outliers.SALTS, *map(float, r)) for i, r in enumerate(x)], ", ".join(["grp string", "salt int", *(f"{n} double" for n in names)]))
    p = outliers.concentrate(df).first()
    clean = x[500:]
    assert np.allclose([p[f"m_{i}"] for i in range(4)], clean.mean(0), atol=0.15)
    low = np.zeros((4, 4))
    for i in range(4):
        for j in range(i + 1):
            low[i, j] = p[f"l_{i}_{j}"]
    assert np.allclose(low @ low.T, np.cov(clean.T), rtol=0.25, atol=0.3)
    assert abs(outliers.chi2_cdf(outliers.chi2_quantile(0.975, 4), 4) - 0.975) < 1e-9
    assert abs(outliers.chi2_quantile(0.975, 4) - 11.1433) < 1e-3


def test_quality(spark, sf, compare):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(docs, labels)
    got = quality.score_quality(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert got and sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)
    found = compare(lambda d: quality.score_quality(d, model))
    assert len(found) == 12 and all(0 <= r["score"] <= 1 for r in found)
    blank = quality.train(docs, labels.where("quality = 2"))
    assert all(abs(r.score - 0.5) < 1e-9 for r in quality.score_quality(docs, blank).collect())


def test_pairs_find_the_direction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(scale=0.3, size=2000) > -1).astype(int)
    model = quality.fit(x[:1500], y[:1500])
    p = quality.score(model, x[1500:])
    assert ((p >= quality.CUT) == y[1500:]).mean() > 0.93
    assert model["weight"][0] > 0 > model["weight"][1] and abs(model["weight"][2]) < 0.3


def test_keys_with_empty_parts(spark):
    keys = [
        "b3BlbnNzaC1rZXktdjEAAAAABG5vbmUAAAAEbm9uZQAAAAAAAAABAAAAMwAAAAtzc2gtZW",  # how an unencrypted private key begins
        "sk-live-51Hxyz9QwErTy8UiOp7LkJh6GfDs5Example4",
        "example51Hxyz9QwErTy8UiOp7LkJh6GfDs5",
        "0123456789Zx9QwErTy8UiOp7LkJh6GfDs5q",
    ]
    clean = ["example0123456789abcdefgh", "AAAAAAAAAAAAAAAA1111111111111111", "sample-placeholder-changeme-0123456789", "xxxxxxxxxxxxexample4xxxxxxxxxxxx5", "0123456789abcdefgh0123456789ABCDEFGH"]
    docs = [(i, f"see {s} here") for i, s in enumerate(keys + clean)]
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in credentials.find_secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, s in enumerate(keys):
        assert got[i] == [(4, 3, 4 + len(s))], s
    assert all(not got[len(keys) + i] for i in range(len(clean)))


def test_planted_keys_are_found(spark):
    """Recall and false alarms of the window on random keys and on words and numbers of like length."""
    import string

    rnd = random.Random(9)
    kinds = {"alnum": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "hex": "0123456789ABCDEF"}
    planted = [("".join(rnd.choice(kinds[k]) for _ in range(rnd.randrange(32, 64))), k) for k in kinds for _ in range(100)]
    words = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randrange(3, 10))) for _ in range(300)]
    plain = [rnd.choice(["-", "_", "/"]).join(rnd.choice([*words, "2024", "17"]) for _ in range(8)) for _ in range(300)]
    docs = [(i, f"a b {s} c") for i, (s, _) in enumerate(planted)] + [(1000 + i, f"a b {s} c") for i, s in enumerate(plain)]
    got = {r.doc_id: r.spans for r in credentials.find_secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for kind in kinds:
        own = [i for i, (_, k) in enumerate(planted) if k == kind]
        assert sum(bool(got[i]) for i in own) >= 0.9 * len(own), kind
    assert sum(bool(got[1000 + i]) for i in range(300)) <= 3
