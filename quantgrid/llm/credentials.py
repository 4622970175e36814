"""Secrets in texts: fixed forms, and strings of high entropy in a sliding window.

Candidate strings of a character class are scanned with a window; the counts of its characters, and with them
the Shannon entropy, are brought up to date for the character that enters and the one that leaves. A string whose
best window reaches its class's threshold is a secret, unless the allow-list knows its form.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantgrid.llm.common import documents
from quantgrid.llm.spans import let, matches, written

#: The three forms that always count. Possessive, so that long runs need no stack.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
KINDS = ["assign", "access", "hex", "entropy"]

WINDOW = 20
#: Character classes: pattern of candidates, alphabet, entropy in bits that a window has to reach.
CLASSES = {
    "hex": (r"(?<![0-9A-Za-z+/_-])[0-9A-Fa-f]{20,}+(?![0-9A-Za-z+/_-])", "0123456789abcdefABCDEF", 3.0),
    "alnum": (r"(?<![0-9A-Za-z+/_-])[0-9A-Za-z]{20,}+(?![0-9A-Za-z+/_=-])", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 3.7),
    "base64": (r"(?<![0-9A-Za-z+/_-])[0-9A-Za-z+/_-]{20,}+={0,2}", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-=", 3.9),
}
#: Forms that aren't secrets as a whole: UUIDs, numbers, words or path parts with separators.
ALLOWED = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[0-9+/_=-]+$",
    r"^[A-Za-z]+$",
    r"^(?:[A-Za-z]+|[0-9]{1,8})(?:[/_=-]+(?:[A-Za-z]+|[0-9]{1,8}))*+[/_=-]*$",
)
#: Parts that say nothing: words of samples, runs of one character. Only what lies between them is scored, so a key is found
#: though such a part occurs in it, and a string made up of them isn't.
EMPTY_PARTS = r"(?i:example|sample|placeholder|changeme|0123456789|abcdefgh)|(.)\1{7,}"


def window_entropy(s: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The greatest Shannon entropy, in bits, of ``window`` characters in a row; null for a shorter string."""
    term = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(0.0)

    def scan(codes: Column) -> Column:
        zero = F.struct(F.array_repeat(F.lit(0), len(alphabet) + 1).alias("n"), F.lit(0.0).alias("t"), F.lit(None).cast("double").alias("best"))

        def step(acc: Column, i: Column) -> Column:
            new, old = F.element_at(codes, i), F.when(i > window, F.get(codes, i - window - 1))
            kept = F.transform(acc.n, lambda c, k: c - F.when(k == old, 1).otherwise(0))
            t = acc.t - F.when(old.isNotNull(), term(F.get(acc.n, old)) - term(F.get(acc.n, old) - 1)).otherwise(0.0)

            def enter(n: Column) -> Column:
                total = t - term(F.get(n, new)) + term(F.get(n, new) + 1)
                entropy = F.when(i >= window, F.log2(F.lit(float(window))) - total / window)
                return F.struct(F.transform(n, lambda c, k: c + F.when(k == new, 1).otherwise(0)).alias("n"), total.alias("t"), F.greatest(acc.best, entropy).alias("best"))

            return let(kept, enter)

        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), zero, step).best

    codes = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(alphabet), c))
    return F.when(F.length(s) >= window, let(codes, scan))


def _mixed(s: Column) -> Column:
    return s.rlike("[0-9].*[0-9]") & s.rlike("[A-Za-z].*[A-Za-z]")


def _dense(alphabet: str, least: float) -> Callable[[Column], Column]:
    return lambda x: F.exists(F.split(x.s, EMPTY_PARTS), lambda part: F.coalesce(window_entropy(part, alphabet) >= least, F.lit(False)))


def base_spans(text: Column) -> Column:
    """The fixed forms as sorted structs of start, kind and end."""
    of = lambda spans, kind: F.transform(spans, lambda x: F.struct(x.start.alias("start"), F.lit(kind).alias("kind"), x.end.alias("end")))
    assign = matches(text, ASSIGN, text.rlike(ASSIGN))
    assign = F.filter(assign, lambda x: F.length(F.regexp_extract(x.s, ASSIGN, 1)) >= 6)
    access = matches(text, ACCESS, F.contains(text, F.lit("AKIA")))
    return F.array_sort(F.concat(of(assign, 0), of(access, 1), of(matches(text, HEX, text.rlike(HEX)), 2)))


def entropy_spans(text: Column, base: Column) -> Column:
    """Strings of high entropy that touch no fixed form, as ``base_spans``."""
    worth = text.rlike(r"[0-9A-Za-z+/_-]{20}") & text.rlike("[0-9]")
    found = []
    for pattern, alphabet, least in CLASSES.values():
        spans = F.filter(matches(text, pattern, worth), lambda x: _mixed(x.s) & ~reduce(Column.__or__, [x.s.rlike(a) for a in ALLOWED]))
        found.append(F.filter(spans, _dense(alphabet, least)))
    free = lambda x, b: ~F.exists(b, lambda y: (y.start < x.end) & (x.start < y.end))
    spans = F.filter(F.concat(*found), lambda x: free(x, base))
    return F.array_distinct(F.transform(spans, lambda x: F.struct(x.start.alias("start"), F.lit(3).alias("kind"), x.end.alias("end"))))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``base`` and ``spans`` (structs of start, kind, end; kind counts in KINDS), and the columns in ``carry``.

    Places are in code points, ends exclusive. Null and empty texts have no spans. Rows that repeat or have a
    null doc_id stay rows; an empty table gives none. Other columns are left out.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *[F.col(c).alias(f"_carry_{c}") for c in carry])
    both = lambda b, t: F.struct(b.alias("base"), F.array_sort(F.concat(b, entropy_spans(t, b))).alias("spans"))
    out = base.withColumn("_found", let(base_spans(F.col("_text")), lambda b: both(b, F.col("_text"))))
    return out.select("doc_id", "_found.base", "_found.spans", *[F.col(f"_carry_{c}").alias(c) for c in carry])


def redact_secrets(docs: DataFrame, mark: str = "[secret]", id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and text, with ``mark`` for each stretch covered by spans of ``find_secrets``, and the columns in ``carry``."""
    base = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *[F.col(c).alias(f"_carry_{c}") for c in carry])
    found = find_secrets(base, id_col, "_text", carry=("_text", *(f"_carry_{c}" for c in carry)))

    def cut(text: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            before = F.array(F.substring(text, acc.at + 1, x.start - acc.at), F.lit(mark))
            out = F.when(x.start >= acc.at, F.concat(acc.out, before)).otherwise(acc.out)
            return F.struct(F.greatest(acc.at, x.end).alias("at"), out.alias("out"))

        rest = lambda acc: F.concat(F.array_join(acc.out, ""), F.substring(text, acc.at + 1, F.length(text)))
        return F.aggregate("spans", zero, step, rest)

    clean = F.when(F.size("spans") == 0, F.col("_text")).otherwise(cut(F.col("_text")))
    return found.select("doc_id", clean.alias("text"), *[F.col(f"_carry_{c}").alias(c) for c in carry])


def op10_window_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    n = [F.expr(f"cast(size(filter(base, x -> x.kind = {k})) as long)").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *n, F.sha2(written(F.col("base"), KINDS), 256).alias("base_sha256"), written(F.col("spans"), KINDS).alias("spans"))
