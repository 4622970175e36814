"""Personal data in texts by weak supervision.

Candidates are the base forms and looser ones (written-out e-mail addresses, national telephone numbers,
IPv6). Labelers vote on each: its form, a gazetteer of known parts, words before it, what touches it, and
its digits. Expectation-maximisation estimates from the votes how reliable each labeler is for each kind; the
posteriors then train a logistic classifier on features of the span, which decides about the looser
candidates. Base forms always stay.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantgrid.llm.common import documents, materialise
from quantgrid.llm.spans import let, matches, written

KINDS = ["email", "ip", "card", "phone"]
#: The base forms. Possessive where nothing follows, so that long runs need no stack.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Looser forms by kind.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}+ ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,12}(?![A-Za-z])",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9A-Za-z+.-])(?<![0-9] )(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ -])[0-9]{3,4}[ -][0-9]{3,4}(?![ .-]?[0-9])",
}
GUARD = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9]"}

#: Gazetteers: top-level domains, country calling codes, first digits of card issuers.
DOMAINS = "com org net edu gov info io de fr es uk eu it nl ch at".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
ISSUERS = "4 5 2 34 37 6011 65 35 36 62".split()
#: Words that announce a kind, in the characters before it.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|address|reach|correo|kontakt)\b",
    "ip": r"(?i)\b(?:ip|ipv6|host|server|node|client|address|addr)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|tarjeta|karte|carte)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|fax|mobile|cell|whatsapp|telefon|m[oó]vil)\b",
}
BEFORE = 40
LABELERS = ["form", "gazetteer", "context", "touching", "digits"]
ROUNDS = 50


def _luhn(digits: Column) -> Column:
    def doubled(x: Column, i: Column) -> Column:
        d = x.cast("int") * (i % 2 + 1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), doubled), F.lit(0), lambda a, x: a + x) % 10 == 0


def holds(kind: str, s: Column) -> Column:
    """Whether a match of the base form counts."""
    digits = F.regexp_replace(s, "[^0-9]", "")
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return {
        "email": F.lit(True),
        "ip": s.rlike(rf"^{part}(?:\.{part}){{3}}$"),
        "card": F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False),
        "phone": F.length(digits).between(8, 15),
    }[kind]


def _begins(digits: Column, parts: list[str]) -> Column:
    return digits.rlike("^(?:" + "|".join(parts) + ")")


def _votes(kind: str, text: Column, x: Column, base: bool) -> list[Column]:
    """One vote a labeler: 1 for, 0 against, -1 none."""
    digits = F.regexp_replace(x.s, "[^0-9]", "")
    before = F.substring(text, F.greatest(x.start - BEFORE + 1, F.lit(1)), F.least(F.lit(BEFORE), x.start))
    touch = F.concat(F.when(x.start > 0, F.substring(text, x.start, F.lit(1))).otherwise(F.lit("")), F.substring(text, x.end + 1, F.lit(1)))
    yes_or = lambda c, other: F.when(c, F.lit(1)).otherwise(F.lit(other))
    known = {
        "email": yes_or(F.lower(x.s).rlike("(?:" + "|".join(DOMAINS) + ")$"), -1),
        "ip": yes_or(~x.s.rlike(r"^(?:0+\.|255\.)"), 0),
        "card": yes_or(_begins(digits, ISSUERS), 0),
        "phone": yes_or(_begins(digits, CALLING), 0) if base else F.lit(-1),
    }[kind]
    count = {"email": F.lit(-1), "ip": F.lit(-1), "card": yes_or(F.length(digits).isin(16, 19), -1), "phone": yes_or(F.length(digits).between(9, 13), 0)}[kind]
    return [F.lit(1 if base else -1), known, yes_or(before.rlike(CONTEXT[kind]), -1), yes_or(~touch.rlike("[0-9A-Za-z#$%]"), 0), count]


def _features(kind: str, text: Column, x: Column, base: bool) -> list[Column]:
    """Features of the span that the classifier sees, 0 or 1."""
    before = F.substring(text, F.greatest(x.start - BEFORE + 1, F.lit(1)), F.least(F.lit(BEFORE), x.start))
    flags = [F.lit(base), before.rlike(CONTEXT[kind]), F.length(x.s) >= 12, F.length(x.s) >= 24, x.s.rlike(r"[@(+]"), before.rlike(r"[0-9][ .-]*$"), before.rlike(r"[:=]\s*$")]
    return [c.cast("int") for c in flags]


N_FEATURES = 7


def candidates(text: Column) -> Column:
    """All candidates as structs of kind, start, end, base, votes and features, sorted."""
    found = []
    for k, kind in enumerate(KINDS):
        guard = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(GUARD[kind])
        kept = _kept(matches(text, BASE[kind], guard), kind)
        base = _told(k, kind, text, True)
        loose = _told(k, kind, text, False)
        if kind not in LOOSE:
            found.append(F.transform(kept, base))
            continue
        extra = matches(text, LOOSE[kind], text.rlike(LOOSE[kind]))
        found.append(let(kept, _with_loose(extra, base, loose)))
    return F.array_sort(F.concat(*found))


def _kept(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: holds(kind, x.s))


def _with_loose(extra, base, loose):
    free = lambda b: F.filter(extra, lambda x: ~F.exists(b, lambda y: (y.start < x.end) & (x.start < y.end)))
    return lambda b: F.concat(F.transform(b, base), F.transform(free(b), loose))


def _told(k: int, kind: str, text: Column, base: bool):
    def tell(x: Column) -> Column:
        votes, flags = _votes(kind, text, x, base), _features(kind, text, x, base)
        return F.struct(F.lit(k).alias("kind"), x.start.alias("start"), x.end.alias("end"), F.lit(base).alias("base"), F.array(*votes).alias("votes"), F.array(*flags).alias("flags"))

    return tell


def reliabilities(counts: list[tuple[int, tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[dict, dict]:
    """Expectation-maximisation over counted vote patterns (kind, votes, count).

    Returns the share of true candidates and, for each labeler, P(vote for | true) and P(vote for | false) of each
    kind, and the posterior of each pattern. Priors as of a few candidates keep empty cells defined.
    """
    model = {k: (0.5, [(0.9, 0.3)] * len(LABELERS)) for k in range(len(KINDS))}
    post: dict = {}
    for _ in range(rounds):
        post = {}
        for kind, votes, _n in counts:
            share, rates = model[kind]
            yes, no = math.log(share), math.log(1 - share)
            for v, (a, b) in zip(votes, rates, strict=True):
                if v >= 0:
                    yes, no = yes + math.log(a if v else 1 - a), no + math.log(b if v else 1 - b)
            post[kind, votes] = 1 / (1 + math.exp(min(no - yes, 700)))
        fresh = {}
        for k in range(len(KINDS)):
            own = [(v, n, post[k, v]) for kind, v, n in counts if kind == k]
            total, true = sum(n for _, n, _ in own), sum(n * p for _, n, p in own)
            rates = []
            for j in range(len(LABELERS)):
                cast = [(v[j], n, p) for v, n, p in own if v[j] >= 0]
                a = (4.5 + sum(n * p * v for v, n, p in cast)) / (5 + sum(n * p for _, n, p in cast))
                b = (1.5 + sum(n * (1 - p) * v for v, n, p in cast)) / (5 + sum(n * (1 - p) for _, n, p in cast))
                rates.append((min(a, 0.999), max(min(b, 0.999), 0.001)))
            fresh[k] = ((1 + true) / (2 + total), rates)
        if all(abs(fresh[k][0] - model[k][0]) < 1e-9 for k in fresh):
            break
        model = fresh
    return model, post


def classifier(rows: list[tuple[int, tuple[int, ...], float, int]], rounds: int = 300, ridge: float = 1.0) -> list[list[float]]:
    """Weights of the features (the last is the constant) by kind, from (kind, flags, posterior, count), by gradient ascent."""
    out = []
    for k in range(len(KINDS)):
        own = [((*flags, 1), p, n) for kind, flags, p, n in rows if kind == k]
        weight, total = [0.0] * (N_FEATURES + 1), sum(n for *_, n in own)
        for _ in range(rounds if own else 0):
            grad = [-ridge * w / max(total, 1) for w in weight]
            for x, p, n in own:
                q = 1 / (1 + math.exp(-max(min(sum(a * b for a, b in zip(x, weight, strict=True)), 30), -30)))
                for j, a in enumerate(x):
                    grad[j] += a * (p - q) * n / total
            weight = [w + g for w, g in zip(weight, grad, strict=True)]
        out.append(weight)
    return out


def find_private(docs: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ``base`` and ``spans`` (structs of kind, start, end; kind counts in KINDS) of each row.

    Places are in code points, ends exclusive. Null and empty texts have no spans. Rows that repeat or have a
    null doc_id stay rows; an empty table gives none. Other columns are left out. Only counts of the patterns
    of votes and features reach the driver, at most 4 x 3^5 x 2^7 of them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    told = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_text")).select("doc_id", candidates(F.col("_text")).alias("found"))
    told = materialise(told)
    each = told.where(F.size("found") > 0).select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes", "c.flags").count().collect()
    counts: dict[tuple, int] = {}
    for r in each:
        counts[r["kind"], tuple(r["votes"])] = counts.get((r["kind"], tuple(r["votes"])), 0) + r["count"]
    _, post = reliabilities(sorted((k, v, n) for (k, v), n in counts.items()))
    weights = classifier(sorted((r["kind"], tuple(r["flags"]), post[r["kind"], tuple(r["votes"])], r["count"]) for r in each))
    table = F.array(*[F.array(*map(F.lit, w)) for w in weights])

    def sure(x: Column) -> Column:
        own = F.get(table, x.kind)
        total = reduce(Column.__add__, [F.get(own, F.lit(j)) * F.get(x.flags, F.lit(j)) for j in range(N_FEATURES)], F.get(own, F.lit(N_FEATURES)))
        return 1 / (1 + F.exp(-total)) >= threshold

    place = lambda x: F.struct(x.kind.alias("kind"), x.start.alias("start"), x.end.alias("end"))
    base, spans = F.filter("found", lambda x: x.base), F.filter("found", lambda x: x.base | sure(x))
    return told.select("doc_id", F.transform(base, place).alias("base"), F.array_distinct(F.transform(spans, place)).alias("spans"))


def op2_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(documents(spark, sf_dir))
    n = [F.expr(f"cast(size(filter(base, x -> x.kind = {k})) as long)").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *n, F.sha2(written(F.col("base"), KINDS), 256).alias("base_sha256"), written(F.col("spans"), KINDS).alias("spans"))
