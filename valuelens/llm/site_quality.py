"""Operator 3, quality by hierarchical empirical Bayes.

Document evidence is a logistic classifier over shares that the text's bytes and words give (symbols, digits, capitals,
repeated words, word lengths ...), fitted in numpy.  Every document's evidence is summed per host and path by grouped
aggregation.  A host's posterior shrinks its mean evidence towards the corpus mean, a path's towards its host's; how much
is estimated by moments: the variance inside groups is pooled over their degrees of freedom, so that groups of one document
do not enter it, and the variance between groups is what their means spread beyond it.  A site with few documents keeps the
prior; where groups do not differ, or nothing tells whether they do, all keep it.  The score
adds to the document's own log-odds what its path's posterior says above the corpus mean; the document's own evidence is
taken out of the sums first, so that it does not count twice.

Training reads a bounded sample: the SAMPLE labelled rows outside the held-out fold with the smallest digest of the id.
Evidence, sums and scores cover every whole text.  Hosts and paths are pre-aggregated before the shuffle; their tables are
broadcast only if they have a bounded number of rows.

Defined results: a null or empty text has evidence from zero shares; a null host or path is a group of its own; repeated
labels count once (the largest), of a repeated id the text with the smallest digest; without two classes the evidence is the share of label 1 (one half without labels);
every row gives one row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, one_text, row_key, ship, small, stored

ship(__name__)

SAMPLE = 6000
MOST = 1e6  # documents that a prior is worth at most
KEEP = 0.5
_SYMBOL = np.array([b in b"*#%$&|<>{}[]=~^\\@_+" for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_STOP = np.array([b in b".!?" for b in range(256)])


def features(text: str | None) -> list[float]:
    """Shares of a whole text; all zero without words."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [0.0] * 11
    n, seen = len(raw), np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    low = raw.lower().split()
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    distinct = len(set(low)) / len(low)
    same = sum(a == b for a, b in zip(low, low[1:])) / len(low)
    lines = raw.count(b"\n") + 1
    return [seen[_SYMBOL].sum() / n, seen[_DIGIT].sum() / n, seen[_UPPER].sum() / n, seen[_STOP].sum() / len(words),
            seen[124] / len(words), distinct, same, float(sizes.mean()) / 10, float(np.log1p(sizes.max())),
            float(np.log1p(len(words))), lines / len(words)]


def _with_squares(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, x * x, np.sqrt(np.abs(x))])


def fit(x: np.ndarray, y: np.ndarray):
    """(centre, scale, weights) of a ridged logistic regression by Newton's method."""
    x = _with_squares(x)
    centre, scale = x.mean(0), x.std(0) + 1e-6
    x = np.hstack([(x - centre) / scale, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1.0 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (p - y) + w)
    return centre, scale, w


def _featured(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [features(t) for t in batch.column("text").to_pylist()]
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(rows, pa.list_(pa.float64()))],
                                             names=[*rest, "x"])

    schema = ", ".join(f"{n} {t}" for n, t in docs.dtypes if n != "text") + ", x array<double>"
    return docs.mapInArrow(run, schema)


def evidence(docs: DataFrame, labels: DataFrame, host: Column, path: Column, rows: int = SAMPLE) -> DataFrame:
    """doc_id, key, host, path and p, the classifier's probability of quality 1, for every document."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    known = stored(known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows), "training_ids")
    part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    got = _featured(one_text(part, "doc_id", "quality")).orderBy("doc_id").toPandas()  # at most `rows` rows of 11 numbers
    y = got["quality"].to_numpy(float)
    base = float(y.mean()) if len(y) else 0.5
    model = fit(np.stack(got["x"].tolist()), y) if len(y) and 0 < base < 1 else None

    def run(batches):
        for batch in batches:
            x = np.array([features(t) for t in batch.column("text").to_pylist()]).reshape(-1, 11)
            p = np.full(len(x), base)
            if model is not None and len(x):
                centre, scale, w = model
                z = (_with_squares(x) - centre) / scale @ w[:-1] + w[-1]
                p = 1 / (1 + np.exp(-np.clip(z, -12, 12)))
            names = ["doc_id", "key", "host", "path"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(p, pa.float64())], names=[*names, "p"])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("key"),
                       F.concat(F.lit("="), host).alias("host"), F.concat(F.lit("="), path).alias("path"), "text")
    cols = cols.withColumn("host", F.coalesce("host", F.lit("null"))).withColumn("path", F.coalesce("path", F.lit("null")))
    return cols.mapInArrow(run, "doc_id bigint, key string, host string, path string, p double")


def _strength(groups: DataFrame) -> float:
    """How many documents the prior of a level is worth: the variance inside groups over that between groups of one parent.

    groups has n, s and q (documents, sum and sum of squares of their evidence) and pn and ps (n and s of the parent)."""
    inside = F.greatest(F.lit(0.0), F.col("q") - F.col("s") ** 2 / F.col("n"))
    away = F.col("n") * (F.col("s") / F.col("n") - F.col("ps") / F.col("pn")) ** 2
    row = groups.agg(F.sum(inside).alias("inside"), F.sum(F.col("n") - 1).alias("free"), F.sum(away).alias("away"),
                     F.sum(1 - F.col("n") / F.col("pn")).alias("groups"),
                     F.sum(F.col("n") * (1 - F.col("n") / F.col("pn"))).alias("weight")).first()  # five numbers
    if not row["free"] or not row["weight"]:
        return MOST
    within = row["inside"] / row["free"]
    between = (row["away"] - row["groups"] * within) / row["weight"]
    return min(MOST, within / between) if between > 0 else MOST


def site_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """doc_id, key, held_out, evidence, host_prior, path_prior, score, predicted, keep: one row per document."""
    rows = stored(evidence(docs, labels, host, path), "evidence")
    paths = stored(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"),
                                                    F.sum(F.col("p") ** 2).alias("q")), "paths")
    hosts = stored(paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")]), "hosts")
    total = hosts.agg(F.sum("n").alias("pn"), F.sum("s").alias("ps"))
    pn, ps = total.first()  # two numbers
    mu = float(ps / pn) if pn else 0.5
    k_host = _strength(hosts.withColumns({"pn": F.lit(pn or 1), "ps": F.lit(ps or 0.0)}))
    both = paths.join(hosts.select("host", F.col("n").alias("hn"), F.col("s").alias("hs")), "host")
    k_path = _strength(both.withColumnsRenamed({"hn": "pn", "hs": "ps"}))
    both = small(stored(both.select("host", "path", "n", "s", "hn", "hs"), "sites"))
    own = rows.join(both, ["host", "path"])
    # without variance inside groups the prior is worth nothing, unless there is no other document
    shrunk = lambda s, n, k, prior: F.coalesce(F.try_divide(s - F.col("p") + k * prior, n - 1 + k), prior)
    host_prior = shrunk(F.col("hs"), F.col("hn"), F.lit(k_host), F.lit(mu))
    path_prior = shrunk(F.col("s"), F.col("n"), F.lit(k_path), F.col("host_prior"))
    own = own.withColumn("host_prior", host_prior).withColumn("path_prior", path_prior)
    logit = lambda c: F.log(F.greatest(c, F.lit(1e-6)) / F.greatest(1 - c, F.lit(1e-6)))
    z = logit(F.col("p")) + logit(F.col("path_prior")) - logit(F.lit(mu))
    own = own.withColumn("score", 1 / (1 + F.exp(-z)))
    return own.select("doc_id", "key", held_out(F.col("doc_id")).alias("held_out"), F.col("p").alias("evidence"),
                      "host_prior", "path_prior", "score", (F.col("score") >= KEEP).cast("int").alias("predicted"),
                      (F.col("score") >= KEEP).alias("keep"))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return site_quality(docs, labels, F.col("source"), F.col("lang")).drop("key")
