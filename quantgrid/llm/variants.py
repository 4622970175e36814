"""Spelling variants: words one edit apart, found by asymmetric q-chunks.

A word gives two disjoint chunks, its halves; the other word gives positional grams of the same lengths, of which only
those are made that a chunk can meet: at the chunk's place, or shifted by one if that word is longer by one. One edit
spares one of the chunks, so each near pair meets in a bucket and is verified there. What is left beside the chunk of a
bucket with very many words is halved in the same way (one edit spares one of those halves, too), until it fits or a
single code point is left: then a bucket has no more chunks than there are letters, and no more grams than pairs of letters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantgrid.llm.common import documents, materialise
from quantgrid.llm.crc import CRC_SQL, crc_sql

SHORTEST = 7
#: A word's form has at least so many times its occurrences.
RATIO = 10
#: One run in so many is cut, by its crc32.
CUT = 31
#: Words in a bucket of which all pairs may be verified.
BUCKET = 256
#: Words a task counts before it passes its counts on.
_HELD = 300_000


def cut_run(run: str, prefix: bytes) -> str:
    """The run, without one code point if the checksum says so."""
    h = zlib.crc32(run.encode(), zlib.crc32(prefix))
    if h % CUT:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, shortest: int = SHORTEST, least: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the lower-cased runs of letters, after cuts, of at least ``shortest`` code points and ``least`` occurrences.

    Null and empty texts have none; a null doc_id counts as an empty string before the colon. Rows that repeat count again. Runs of
    any length are taken whole. A task adds up its own counts, in a table of bounded size, before they are shuffled.
    """
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % shortest)

    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                prefix = b":" if doc is None else b"%d:" % doc
                for run, n in Counter(runs.findall(text.encode().lower().decode())).items():  # of bytes: only A-Z change
                    word = cut_run(run, prefix)
                    if len(word) >= shortest:
                        held[word] += n
            if len(held) >= _HELD:
                yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
                held.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    texts = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _key(size: Column, head: Column, tail: Column, word: Column, longer: Column) -> Column:
    """What a bucket's words have in common: the length, and the code points before and after the open middle."""
    last = F.substring(word, size + longer - tail + 1, tail)
    return F.xxhash64(size, head, tail, F.substring(word, F.lit(1), head), last)


def _halved(rows: DataFrame) -> DataFrame:
    """Each row (word, n, size, longer, head, tail) twice: with the left or the right half of its open middle as a chunk, too."""
    middle = F.col("size") - F.col("head") - F.col("tail")
    half = F.floor(middle / 2).cast("int")
    left = F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail"))
    right = F.struct(F.col("head").alias("head"), (F.col("tail") + middle - half).alias("tail"))
    out = rows.select("word", "n", "size", "longer", F.explode(F.array(left, right)).alias("x")).select("word", "n", "size", "longer", "x.*")
    return out.withColumn("key", _key(F.col("size"), F.col("head"), F.col("tail"), F.col("word"), F.col("longer")))


def near_pairs(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """word, n, near, near_n: every ordered pair of different words (word, n) that are one edit apart, once. Words are distinct."""
    length = F.length("word")
    # A word gives chunks as the shorter one or one of two equally long, and grams for words as long or shorter by one.
    sides = F.array(F.struct(length.alias("size"), F.lit(0).alias("longer")), F.struct((length - 1).alias("size"), F.lit(1).alias("longer")))
    rows = words.select("word", "n", F.explode(sides).alias("x")).select("word", "n", "x.*").where("size > 0")
    rows = rows.select("word", "n", "size", "longer", F.lit(0).alias("head"), F.lit(0).alias("tail"))
    found = []
    while True:
        rows = materialise(_halved(rows))
        counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("here"), F.sum("longer").alias("grams"), F.max(F.col("size") - F.col("head") - F.col("tail")).alias("open"))
        counts = counts.where("here > 1 and here > grams")
        full = (F.col("here") > bucket) & (F.col("open") > 1)
        counts = materialise(counts.select("key", full.alias("full")))
        met = rows.join(counts, "key")
        met_now = met.where("not full")
        chunks = met_now.where("longer = 0").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
        grams = met_now.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "longer")
        pairs = chunks.join(grams, "key").where(((F.col("longer") == 1) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
        found.append(pairs.select("a", "a_n", "b", "b_n"))
        if not counts.where("full").limit(1).count():
            break
        rows = met.where("full").select("word", "n", "size", "longer", "head", "tail")
    once = materialise(reduce(DataFrame.unionAll, found).distinct())
    way = lambda a, b: F.struct(F.col(a).alias("word"), F.col(f"{a}_n").alias("n"), F.col(b).alias("near"), F.col(f"{b}_n").alias("near_n"))
    ways = F.array(way("a", "b"), way("b", "a"))
    return once.select(F.inline(ways))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root for each row (word, form): the end of the chain of forms, by following pointers twice as far each round."""
    known = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialise(known.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        known = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return known


def group_variants(words: DataFrame, ratio: int = RATIO, bucket: int = BUCKET) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row (word, n) of ``words``, whose words are distinct.

    ``form`` is the near word of largest n, of equal ones the smallest in code-point order, if its n is at least ``ratio`` times
    the word's; otherwise null, as is form_n, and the word is its own root. An empty table gives no rows.
    """
    words = materialise(words.select("word", "n"))
    near = near_pairs(words, bucket).groupBy("word").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    holds = -F.col("best.less") >= ratio * F.col("n")
    near = materialise(near.select("word", "n_near", F.when(holds, F.col("best.near")).alias("form"), F.when(holds, -F.col("best.less")).alias("form_n")))
    roots = _roots(near.where("form is not null"))
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op11_asymmetric_chunk_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(count_words(documents(spark, sf_dir)))


_RUN = "translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = f"""
WITH RECURSIVE {CRC_SQL},
raw AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS r FROM documents),
runs AS (SELECT doc_id, {_RUN} AS w, count(*) AS n FROM raw WHERE length(r) >= {SHORTEST} GROUP BY ALL),
sums AS (SELECT w, n, {crc_sql("(coalesce(doc_id::varchar, '') || ':' || w)")} AS h FROM runs, crc_table),
cut AS (SELECT CASE WHEN h % {CUT} = 0 THEN left(w, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) ELSE w END AS word, n FROM sums),
words AS (SELECT word, sum(n)::bigint AS n FROM cut WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= 2),
holes AS (SELECT word, n, i, left(word, i::int - 1) || substr(word, i::int + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
links AS (SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN holes b ON a.word = b.rest
  UNION SELECT b.word, a.word, a.n FROM words a JOIN holes b ON a.word = b.rest),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS form, max(near_n) AS form_n FROM links GROUP BY word),
own AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= {RATIO} * w.n THEN b.form END AS form, CASE WHEN b.form_n >= {RATIO} * w.n THEN b.form_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
chain AS (SELECT word, word AS root, form AS next FROM own UNION ALL SELECT c.word, o.word, o.form FROM chain c JOIN own o ON c.next = o.word)
SELECT o.word, o.form, c.root, o.n, o.n_near, o.form_n FROM own o JOIN chain c ON c.word = o.word AND c.next IS NULL"""
