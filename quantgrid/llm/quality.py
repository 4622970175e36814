"""Document quality by pairwise ranking (Bradley-Terry) on text statistics.

A document's score is linear in its features; that a document of label 1 beats one of label 0 has the logistic
probability of the difference of their scores. The weights are fitted on preference pairs of a bounded sample of
labelled documents; the cut is the quantile of the sample's scores that separates its labels best.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantgrid.llm.common import documents

#: Labelled documents used at most, and preference pairs per document of the rarer label.
SAMPLE, PAIRS = 20_000, 12
#: The score at the cut.
CUT = 0.3


def features(text: str) -> list[float]:
    """Statistics of a text that don't depend on its language."""
    raw = text.encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, w = max(len(raw), 1), max(len(words), 1)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = count[65:91].sum(), count[97:123].sum()
    share = lambda chars, of: math.log(count[list(chars)].sum() / of + 0.003)
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        math.log1p(len(words)),
        min(math.log1p(len(words)), 4.0),
        math.log(n / w),
        math.log(upper / max(upper + lower, 1) + 0.003),
        math.log(count[48:58].sum() / n + 0.003),
        share(b"#*$%&", w),
        share(b"|", w),
        share(b"!", w),
        share(b"?", w),
        share(b".", w),
        share(b",;:", w),
        share(b"<>@^~=+_{}[]\\/", w),
        share(b"\n", w),
        share(range(128, 256), n),
        math.log(len(set(words)) / w + 0.003),
        math.log(pairs / max(len(words) - 1, 1) + 0.003) if len(words) > 1 else 0.0,
        math.log((len(lines) - len(set(lines))) / max(len(lines), 1) + 0.003),
        math.log(max(map(len, words), default=1)),
    ]


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7, ridge: float = 1.0) -> dict:
    """Weights, centre and scale of the features, and the cut; all zero where a label is missing."""
    d = x.shape[1]
    if not len(y) or y.min() == y.max():
        return {"centre": np.zeros(d), "scale": np.ones(d), "weight": np.zeros(d), "cut": math.log(CUT / (1 - CUT))}
    centre, scale = x.mean(0), x.std(0) + 1e-3
    z = np.clip((x - centre) / scale, -6, 6)
    good, bad = np.nonzero(y == 1)[0], np.nonzero(y == 0)[0]
    rng = np.random.default_rng(seed)
    m = min(len(good), len(bad)) * PAIRS
    diff = z[rng.choice(good, m)] - z[rng.choice(bad, m)]
    weight = np.zeros(d)
    for _ in range(30):  # Newton steps on the logistic loss of the differences
        p = 1 / (1 + np.exp(-np.clip(diff @ weight, -30, 30)))
        grad = diff.T @ (1 - p) - ridge * weight
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff + ridge * np.eye(d), grad)
        weight = weight + step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ weight
    order = np.argsort(s)
    # Errors when the lowest k scores are taken for label 0, for every quantile k / n.
    wrong = np.concatenate([[np.sum(y == 0)], np.sum(y == 0) + np.cumsum(np.where(y[order] == 1, 1, -1))])
    k = int(wrong.argmin())
    near = s[order][[max(k - 1, 0), min(k, len(s) - 1)]]
    return {"centre": centre, "scale": scale, "weight": weight, "cut": float(near.mean())}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores between 0 and 1; at the model's cut, CUT."""
    s = np.clip((x - model["centre"]) / model["scale"], -6, 6) @ model["weight"]
    return 1 / (1 + np.exp(-np.clip(s - model["cut"] + math.log(CUT / (1 - CUT)), -40, 40)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Fit on the ``sample`` labelled documents with the least hashes, of those that aren't held out."""
    ids = labels.where("doc_id is not null and quality is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # so many rows at most are broadcast
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "quality")

    def run(batches):
        for batch in batches:
            x = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    rows = chosen.mapInArrow(run, "doc_id long, quality int, x array<double>").dropDuplicates(["doc_id"]).orderBy("doc_id").limit(sample).collect()
    x = np.array([r.x for r in rows], float).reshape(len(rows), len(features("")))
    return fit(x, np.array([r.quality for r in rows]))


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def score_quality(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from CUT on), with the columns named in ``carry``.

    Null and empty texts get the score of an empty text; a null doc_id isn't held out. Rows that repeat stay,
    with equal scores. An empty table gives no rows; other columns are left out.
    """
    extra = docs.select(*carry).schema.fields if carry else []
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *[F.col(c).alias(f"_carry_{c}") for c in carry])
    types = ", ".join(["doc_id long", "held_out boolean", "score double", "predicted int", *(f"_carry_{f.name} {f.dataType.simpleString()}" for f in extra)])

    def run(batches):
        for batch in batches:
            x = [features(t) for t in batch.column(2).to_pylist()]
            p = score(model, np.array(x)) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= CUT).astype(np.int32)), *batch.columns[3:]], names=["doc_id", "held_out", "score", "predicted", *(f"_carry_{c}" for c in carry)])

    out = base.mapInArrow(run, types)
    return out.select("doc_id", "held_out", "score", "predicted", *[F.col(f"_carry_{c}").alias(c) for c in carry])


def op4_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_quality(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
