r"""Operator 11, periodic runs of words by recursive frequency splitting.

A run is a stretch of words with smallest period q (words q apart are identical), at least max(24, 3 * q) words long, that
no neighbouring word extends.  In such a run every word occurs at least three times.  So a word that occurs less often
within a segment cannot be in a run of that segment and splits it; the parts are split again by their own counts until
nothing changes, and parts of fewer than 24 words fall away.  Of ordinary prose little is left.

Surviving segments are scanned by lag: stretches where words p apart are identical, at least max(24, 3 * p) - p long.
Not every lag is worth a scan: the words of a run of period q, q <= k <= 2 * q, repeat in windows of k words (8 for the
smallest periods), and in a window at least as long as the period the next occurrence of the same window is exactly q
away.  Windows of 8, 16, 32, ... words get names by doubling, and only distances to the next equal name that lie in
(k / 2, k] are scanned.  All of a text is in one task, nothing is shuffled, and a text costs n log(n) for each doubling.

Defined results: null, empty and blank texts have no words and no runs; a null doc_id is kept (the query repeats nothing in
it); rows that repeat stay rows; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction
from itertools import count
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

ship(__name__)

LEAST = 24
TIMES = 3
WINDOW = 8  # 2 * WINDOW <= LEAST: the smallest periods recur within it


def split(ids: np.ndarray) -> list[tuple[int, int]]:
    """Segments (begin, end) of at least LEAST words in which every word occurs at least TIMES times."""
    done, todo = [], [(0, len(ids))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < LEAST:
            continue
        part = ids[lo:hi]
        if (hi - lo) * 4 < ids.max():  # few words beside the numbers in use
            part = np.unique(part, return_inverse=True)[1]
        rare = np.bincount(part)[part] < TIMES
        if not rare.any():
            done.append((lo, hi))
            continue
        cuts = np.concatenate([[-1], np.flatnonzero(rare), [hi - lo]])
        long = np.flatnonzero(np.diff(cuts) > LEAST)
        todo.extend((lo + int(cuts[i]) + 1, lo + int(cuts[i + 1])) for i in long)
    return done


def lags(w: np.ndarray) -> list[int]:
    """Ascending distances that are the period of every run of the segment, and perhaps some others."""
    found: set[int] = set()
    name, k = np.unique(w, return_inverse=True)[1].astype(np.int64), 1
    while True:
        if k >= WINDOW:
            order = np.argsort(name, kind="stable")
            near = np.diff(order)[np.diff(name[order]) == 0]
            if not len(near):
                break  # longer windows do not repeat either
            found.update(np.unique(near[(near <= k) & ((near > k // 2) | (k == WINDOW))]).tolist())
        if k * TIMES > 2 * len(w) or len(name) <= k:
            break
        pair = name[:-k] * (len(w) + 1) + name[k:]
        name, k = np.unique(pair, return_inverse=True)[1].astype(np.int64), 2 * k
    return sorted(found)


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    found: dict[tuple[int, int], int] = {}
    for lo, hi in split(ids) if len(ids) >= LEAST else []:
        w = ids[lo:hi]
        for p in lags(w):
            same = np.concatenate([[False], w[:-p] == w[p:], [False]])
            edge = np.flatnonzero(same[1:] != same[:-1])
            begin, size = edge[::2], edge[1::2] - edge[::2] + p
            for b, n in zip(begin[size >= max(LEAST, TIMES * p)], size[size >= max(LEAST, TIMES * p)]):
                # the same stretch under a multiple of its period comes later and is no run of its own
                found.setdefault((lo + int(b), int(n)), p)
    return sorted((s, n, p) for (s, n), p in found.items())


def numbered(words: list) -> np.ndarray:
    """Words as numbers in the order of their first use."""
    number = defaultdict(count().__next__)
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """True for words that no run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for s, length, p in found:
        depth[s + p] += 1
        depth[s + length] -= 1
    return np.cumsum(depth[:n]) == 0


def most_repeated(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; of equal ones that with the smallest start, then period."""
    return min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None


def repeated_tail(words: list, doc_id: int | None) -> list:
    """The query's stand-in input: for a tenth of the ids, words from a place on repeat with a period, both by the id."""
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * -(-(n - a) // p))[:n - a]


_COLUMNS = ("doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
            "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def collapsed(docs: DataFrame, change=None) -> DataFrame:
    """doc_id, n_runs, the most repeated run (start, length, period, exponent_milli; null without one), all runs and the
    text without repetitions, words joined by one space.  `change(words, doc_id)` may replace a row's words first."""
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"]
    kinds = [pa.int64()] * 6 + [pa.list_(run), pa.string()]

    def scan(batches):
        for batch in batches:
            out = [[] for _ in names]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = (text or "").encode().split()  # at [\x20\x09-\x0D]
                words = change(words, doc_id) if change else words
                found = runs(numbered(words))
                best = most_repeated(found)
                keep = words if not found else [w for w, k in zip(words, kept(len(words), found).tolist()) if k]
                row = (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                       [dict(zip(("start", "length", "period"), r)) for r in found], b" ".join(keep).decode())
                for col, v in zip(out, row):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        scan, _COLUMNS)


def query(spark, sf_dir: str) -> DataFrame:
    got = collapsed(spark.read.parquet(f"{sf_dir}/documents.parquet"), repeated_tail)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    return got.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli",
                      F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
