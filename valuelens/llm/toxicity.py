"""Operator 6, toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 5, with marks for its ends) and itself, each hashed to one of BUCKETS
vectors, so a misspelling shares most vectors with the word.  A window of WINDOW words is the average of its words'
averages; a softmax over it gives the two classes.  Vectors and softmax are trained together on windows that carry their
document's label.  A document's evidence is its most toxic window, so that a few words count in a long text as in a short
one; a logistic curve of that evidence and the number of windows, fitted on documents that the vectors never saw, makes
the score.

Training reads a bounded sample: per class the SAMPLE documents with the smallest digest of the id, outside the held-out
fold.  A third of them is kept aside for the curve, with whole texts of every length, read in tasks; the others train the
vectors.  Of a text with more than SAMPLE_WINDOWS windows, that many from all over it train them, those with the smallest
digests.  Scoring reads every whole text.  Only the text is an input of a score.

Defined results: null, empty and blank texts have no window and get the score of a clean one; labels without a document,
null labels and repeated labels (the largest counts) are allowed; of a repeated id the text with the smallest digest trains; with fewer than two classes in the sample the score is
the share of label 1 (0 without labels); every row gives one row; extra columns are ignored by score() and kept by
clean(); an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, one_text, row_key, ship, stored, without

ship(__name__)

BUCKETS = 1 << 16
DIM = 4
WINDOW = 2
SAMPLE = 1200
SAMPLE_WINDOWS = 2_000
EPOCHS = 40
THRESHOLD = 0.3
_EDGE = b".,;:!?()[]{}\"'|*#%$&<>-_"
_CACHE_WORDS = 300_000


class Model(NamedTuple):
    """weight: per bucket, its vector times the difference of the two class vectors."""
    weight: np.ndarray | None
    bias: float
    slope: float
    per_log: float
    shift: float
    clean: float  # evidence of a text without words


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def bags(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of the word) of every n-gram of every word and of the words themselves."""
    marked = [b"<" + (w.strip(_EDGE) or w) + b">" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    text = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(marked)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(text))  # bytes of the word from here on
    found = [np.fromiter((zlib.crc32(w) for w in marked), np.uint32, len(marked)) & np.uint32(BUCKETS - 1)]
    owners = [np.arange(len(marked))]
    for n in (3, 4, 5):
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint32)
        for k in range(n):
            h = (h ^ text[at + k]) * np.uint32(0x01000193)  # FNV-1a
        found.append((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1))
        owners.append(owner[at])
    return np.concatenate(found).astype(np.int64), np.concatenate(owners)


def thinned(text: str) -> str:
    """A text of at most SAMPLE_WINDOWS windows: those with the smallest digests of place and words, in the text's order."""
    words = words_of(text)
    if len(words) <= SAMPLE_WINDOWS * WINDOW:
        return text
    whole = [b" ".join(words[i:i + WINDOW]) for i in range(0, len(words) - WINDOW + 1, WINDOW)]
    digest = np.fromiter((zlib.crc32(w, i) for i, w in enumerate(whole)), np.uint32, len(whole))
    kept = np.sort(np.argsort(digest, kind="stable")[:SAMPLE_WINDOWS])
    return b" ".join(whole[i] for i in kept).decode("utf-8", "replace")


def _sample(docs: DataFrame, labels: DataFrame, rows: int):
    """(texts of SAMPLE_WINDOWS windows and labels of at most 2 * rows documents that the vectors are trained on; the
    documents kept aside for the curve, a third of those chosen, with whole texts of any length; every class's size)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}  # two rows
    chosen = [known.where(F.col("toxic") == c).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows)
              for c in (0, 1)]
    aside = F.crc32(F.concat(F.lit("aside"), F.col("doc_id").cast("string"))) % 3 == 2
    chosen = stored(chosen[0].unionByName(chosen[1]).withColumn("aside", aside), "training_ids")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    got = texts.where(~F.col("aside")).select("doc_id", "text", "toxic")
    got = one_text(got, "doc_id", "toxic").where(F.length("text") > 0)

    def shorten(batches):
        for batch in batches:
            texts = pa.array([thinned(t) for t in batch.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), texts], names=["doc_id", "toxic", "text"])

    kind = dict(got.dtypes)["doc_id"]
    got = got.select("doc_id", "toxic", "text").mapInArrow(shorten, f"doc_id {kind}, toxic int, text string")
    got = got.toPandas().sort_values("doc_id")
    return got["text"].tolist(), got["toxic"].to_numpy(np.float32), texts.where("aside"), sizes


def _windows(texts: list[str]):
    """Word numbers in windows (-1 pads), the document of each window, and of each n-gram its bucket and
    its word; the n-grams of each word."""
    number: dict[bytes, int] = {}
    rows, owner = [], []
    for d, t in enumerate(texts):
        ids = [number.setdefault(w, len(number)) for w in words_of(t)]
        ids += [-1] * (-len(ids) % WINDOW)
        rows.append(np.array(ids, np.int32).reshape(-1, WINDOW))
        owner.append(np.full(len(rows[-1]), d, np.int32))
    flat, word = bags(list(number))
    return np.concatenate(rows), np.concatenate(owner), flat, word, np.bincount(word, minlength=len(number))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _prior(sizes: dict[int, int]) -> float:
    total = sum(sizes.values())
    return sizes.get(1, 0) / total if total else 0.0


def _constant(prior: float) -> Model:
    return Model(None, 0.0, 0.0, 0.0, float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))), 0.0)


def vectors_of(texts: list[str], labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias): joint training by Adam on whole batches of windows."""
    win, owner, flat, of_word, counts = _windows(texts)
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    softmax = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    offset = np.zeros(2, np.float32)
    used, target = win, labels[owner]
    real = used >= 0
    # each class weighs the same, whatever its number of windows
    weight = np.where(target == 1, 0.5 / max(1, (target == 1).sum()), 0.5 / max(1, (target == 0).sum())).astype(np.float32)
    params = [vectors, softmax, offset]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    n_words = len(counts)
    place, spread = used[real].astype(np.int64), np.repeat(np.arange(len(used)), real.sum(1))
    for step in range(1, EPOCHS + 1):
        padded = np.zeros((n_words + 1, DIM), np.float32)  # the last row pads; one dimension at a time, to save memory
        for j in range(DIM):
            padded[:-1, j] = np.bincount(of_word, vectors[flat, j], n_words) / counts
        mean = padded[used].sum(1) / WINDOW
        z = mean @ softmax + offset
        p1 = _sigmoid(z[:, 1] - z[:, 0])
        g = (weight * (p1 - target)).astype(np.float32)
        dz = np.stack([-g, g], 1)
        d_mean = dz @ softmax.T / WINDOW
        d_vec = np.empty_like(vectors)
        for j in range(DIM):
            d_word = np.bincount(place, d_mean[spread, j], n_words) / counts
            d_vec[:, j] = np.bincount(flat, d_word[of_word], BUCKETS)
        grads = [d_vec, mean.T @ dz, dz.sum(0)]
        for p, gr, (m, v) in zip(params, grads, moments):
            m += 0.1 * (gr - m)
            v += 0.01 * (gr * gr - v)
            p -= 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return (vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(offset[1] - offset[0])


def curve(weight: np.ndarray, bias: float, best: np.ndarray, n_win: np.ndarray, y: np.ndarray, prior: float) -> Model:
    """The logistic curve from the most toxic window and the number of windows of documents that the vectors never saw."""
    mean, deviation = best.mean(), best.std() + 1e-9
    x = np.stack([(best - mean) / deviation, np.log(n_win), np.ones(len(y))], 1)
    share = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    w = np.zeros(3)
    for _ in range(50):  # Newton, slightly ridged
        p = _sigmoid(x @ w)
        h = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        w -= np.linalg.solve(h, x.T @ (share * (p - y)) + 1e-2 * w)
    slope = float(w[0] / deviation)
    return Model(weight, bias, slope, float(w[1]), float(w[2] - slope * mean), float(np.median(best[y == 0])))


def _values(weight: np.ndarray, words: list[bytes], cache: dict[bytes, float]) -> list[float]:
    found = list(map(cache.get, words))
    if None in found:
        new = list({w for w, v in zip(words, found) if v is None})
        bucket, word = bags(new)
        mean = np.bincount(word, weight[bucket], len(new)) / np.bincount(word, minlength=len(new))
        known = dict(zip(new, mean.tolist()))
        if len(cache) >= _CACHE_WORDS:
            cache.clear()
        cache.update((w, v) for w, v in known.items() if len(w) <= 64)
        found = [known[w] if v is None else v for w, v in zip(words, found)]
    return found


def _evidence(weight: np.ndarray, text: str | None, cache: dict[bytes, float]) -> tuple[float, int] | None:
    """The most toxic window of a whole text and its number of windows; None without words."""
    words = words_of(text)
    if not words:
        return None
    v = np.zeros(-(-len(words) // WINDOW) * WINDOW)
    v[:len(words)] = _values(weight, words, cache)
    sums = v.reshape(-1, WINDOW).sum(1) / WINDOW
    return float(sums.max()), len(sums)


def fitted(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model:
    """The model: vectors trained on the driver on a bounded sample, evidence for the curve computed in tasks."""
    texts, y, aside, sizes = _sample(docs, labels, rows)
    if len(set(y.tolist())) < 2:
        return _constant(_prior(sizes))
    weight, bias = vectors_of(texts, y)

    def seen(batches):
        cache: dict[bytes, float] = {}
        for batch in batches:
            found = [_evidence(weight, t, cache) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array([f and f[0] for f in found], pa.float64()),
                 pa.array([f and f[1] for f in found], pa.int64())], names=["doc_id", "toxic", "best", "n"])

    aside = aside.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "text")
    got = aside.mapInArrow(seen, "doc_id bigint, toxic int, best double, n bigint").where("n IS NOT NULL")
    got = got.groupBy("doc_id", "toxic").agg(F.max(F.struct("best", "n")).alias("b")).select("doc_id", "toxic", "b.*")
    got = got.toPandas().sort_values("doc_id")  # a row of four numbers for each of at most 2 * rows documents
    if got["toxic"].nunique() < 2:
        return _constant(_prior(sizes))
    return curve(weight, bias, got["best"].to_numpy(), got["n"].to_numpy(), got["toxic"].to_numpy(float), _prior(sizes))


def score(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """doc_id, key, held_out, score, predicted: one row per row of docs."""
    model = fitted(docs, labels, rows)

    def scored(batches):
        cache: dict[bytes, float] = {}
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                found = _evidence(model.weight, text, cache) if model.weight is not None else None
                best, n = found or (model.clean, 1)
                out.append(float(_sigmoid(model.slope * best + model.per_log * np.log(n) + model.shift)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(out, pa.float64())],
                                             names=["doc_id", "key", "score"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    got = text.mapInArrow(scored, "doc_id bigint, key string, score double")
    return got.select("doc_id", "key", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic."""
    bad = stored(score(docs, labels).where("predicted = 1").select("key").distinct(), "toxic")
    return without(docs, row_key(F.col("doc_id"), F.col("text")), bad)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, labels).select("doc_id", "held_out", "score", "predicted")
