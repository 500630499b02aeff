"""Merkle manifest, periodic runs and language-model scores against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from valuelens.llm import lm_trie, merkle, period_runs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("s", "part", "place", "n", "digest", "all", "slot", "run", "path", "now", "held", "block", "word", "row", "start")


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(7).alias(c) for c in CLASHES])


def _odd(n=0):
    texts = [None, "", "  \n", "a", "one two", "é ß x", "ab " * 40_000, "x" * 50_000, "A b C"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, "null id", None, None, None), (3, "a", "en", "s", 1),
                                                                  (3, "b", "en", "s", 1), (40, "", "", "", 0)]
    return rows + [(100 + i, f"Text {i}", "en", "hot", i) for i in range(n)]


# ---- Merkle manifest ------------------------------------------------------------------------------------------------

def _h(*parts):
    return _sha("".join(parts))


def _leaf(row, text):
    doc_id, _, lang, source, n = row
    return _h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n, text)])


def _trees(groups):
    """Proof path (left, right) of each leaf and the top of each group."""
    tops, paths = {}, {}
    for g, leaves in groups.items():
        level, up = list(leaves), [[i] for i in range(len(leaves))]
        paths[g] = [[] for _ in leaves]
        while len(level) > 1:
            for at in range(0, len(level), 16):
                run = level[at:at + 16]
                for j in range(len(run)):
                    for i in up[at + j]:
                        paths[g][i].append(("".join(run[:j]), "".join(run[j + 1:])))
            up = [sum(up[at:at + 16], []) for at in range(0, len(level), 16)]
            level = [_h(*level[at:at + 16]) for at in range(0, len(level), 16)]
        tops[g] = level[0]
    return tops, paths


def _manifest(rows, change):
    rows = sorted(rows, key=lambda r: (r[3] is not None, (r[3] or "").encode(), r[0] is not None, r[0] or 0, _leaf(r, r[1])))
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    tops, paths = _trees({g: [_leaf(r, r[1]) for r in rs] for g, rs in groups.items()})
    root, over = _trees({0: [tops[g] for g in groups]})
    out = []
    for k, (g, rs) in enumerate(groups.items()):
        for r, path in zip(rs, paths[g]):
            whole, now = path + over[0][k], _leaf(r, change(r))
            for left, right in whole:
                now = _h(left, now, right)
            out.append((r[0], _leaf(r, r[1]), tops[g], root[0], _sha("".join(a + b for a, b in whole)), now, now == root[0]))
    return out


def _low(row):
    doc_id, text = row[0], row[1]
    if doc_id is None or text is None or zlib.crc32(str(doc_id).encode()) % 5:
        return text
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.mark.parametrize("n,sources", [(0, 0), (17, 0), (300, 20)])
def test_manifest_equals_brute_force(spark, tmp_path, n, sources):
    rows = _odd(n) + [(1000 + i, "T", "en", f"S{i}", 1) for i in range(sources)]
    _table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(_manifest(rows, _low), key=key)


def test_manifest_finds_a_change_and_has_no_rows_without_leaves(spark):
    rows = [(i, "text", "en", "s", 1) for i in range(40)]
    got = merkle.manifest(_table(spark, rows), F.when(F.col("doc_id") == 33, "other"))
    bad = got.where(merkle.fold(F.col("now"), F.col("path")) != F.col("root")).collect()
    assert [r["doc_id"] for r in bad] == [33]
    assert merkle.manifest(_table(spark, [])).collect() == []


# ---- periodic runs --------------------------------------------------------------------------------------------------

def _runs(w):
    out = set()
    for p in range(1, len(w) // 3 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            n = j - i + p
            if j > i and n >= max(24, 3 * p) and not any(
                    all(w[x] == w[x + q] for x in range(i, i + n - q)) for q in range(1, p)):
                out.add((i, n, p))
            i = max(j, i + 1)
    return sorted(out)


def _random_words(rng):
    k, w = rng.choice([1, 2, 3, 5, 30]), []
    while len(w) < rng.randint(0, 200):
        if rng.random() < .5:
            w += [rng.randrange(k) for _ in range(rng.randint(0, 20))]
        else:
            u = [rng.randrange(k) for _ in range(rng.randint(1, 25))]
            size = rng.randint(1, 5 * len(u) + 20)
            w += (u * (size // len(u) + 1))[:size]
    return w


def test_runs_equal_brute_force():
    rng, found = random.Random(11), 0
    for _ in range(1500):
        w = _random_words(rng)
        want = _runs(w)
        found += len(want)
        assert period_runs.runs(np.array(w, np.int64)) == want
    assert found > 500


def test_a_run_inside_a_run_and_a_very_long_text():
    inner = ["x"] * 30 + [f"a{i}" for i in range(10)]
    w = period_runs.numbered(inner * 4)
    assert (0, 160, 40) in period_runs.runs(w) and (40, 30, 1) in period_runs.runs(w)
    long = [str(i * i % 99_991) for i in range(90_000)]
    assert period_runs.runs(period_runs.numbered(["start"] + long * 3)) == [(1, 270_000, 90_000)]
    assert period_runs.runs(np.zeros(0, np.int64)) == [] and period_runs.runs(np.zeros(24, np.int64)) == [(0, 24, 1)]


def test_collapsed_texts(spark, tmp_path):
    rng = random.Random(5)
    rows = _odd() + [(200 + i, " ".join(map(str, _random_words(rng))), "en", "s", 1) for i in range(120)]
    _table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in period_runs.query(spark, str(tmp_path)).collect()), key=str)
    want = []
    for doc_id, text, *_ in rows:
        w = (text or "").encode().split()
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        runs = _runs(w) if len(w) < 10_000 else [(0, len(w), 1)]
        drop = {i for s, n, p in runs for i in range(s + p, s + n)}
        best = sorted(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))[0] if runs else (None,) * 3
        want.append((doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                     _sha("".join("%d,%d,%d\n" % r for r in runs)),
                     _sha(b" ".join(x for i, x in enumerate(w) if i not in drop).decode())))
    assert got == sorted(want, key=str)
    assert sum(r[1] for r in want) > 20
    texts = {r["doc_id"]: r["collapsed"] for r in period_runs.collapsed(_table(spark, rows)).collect()}
    assert texts[6] == "ab" and texts[4] == "one two" and texts[0] == ""
    assert period_runs.collapsed(_table(spark, [])).collect() == []


# ---- language model -------------------------------------------------------------------------------------------------

def test_sequences_give_back_and_find():
    rng = np.random.default_rng(1)
    for n, top in [(0, 1), (1, 1), (1, 10**12), (1000, 50), (1000, 10**9), (5000, 5000)]:
        x = np.sort(rng.integers(0, top, n))
        assert (lm_trie.EliasFano(lm_trie.encode(x), 0).get(np.arange(n)) == x).all()
        x = np.unique(x)
        q = np.concatenate([rng.integers(0, 2 * top, 500), x[:500]])
        at, hit = lm_trie.EliasFano(lm_trie.encode(x), 0).find(q)
        assert (hit == np.isin(q, x)).all() and (x[at[hit]] == q[hit]).all()


def _model(rows):
    texts = [(i, (t or "").encode().lower().split() + [b"\n"], i is not None and zlib.crc32(str(i).encode()) % 7 == 2)
             for i, t, *_ in rows]
    c1, c2, c3, x2, x3, t2, t3 = (Counter() for _ in range(7))
    for _, words, held in texts:
        u = v = None
        for w in words if not held else ():
            t2[v] += not c2[v, w]
            t3[u, v] += not c3[u, v, w]
            for c, k in ((c1, w), (c2, (v, w)), (c3, (u, v, w)), (x2, v), (x3, (u, v))):
                c[k] += 1
            u, v = v, w
    n, kinds, out = sum(c1.values()), len(c1), []
    for i, words, held in texts:
        u = v = None
        base = score = 0.0
        for w in words:
            p = (c1[w] + 1) / (n + kinds + 1)
            base += math.log10(p)
            p = (c2[v, w] + t2[v] * p) / (x2[v] + t2[v]) if x2[v] else p
            p = (c3[u, v, w] + t3[u, v] * p) / (x3[u, v] + t3[u, v]) if x3[u, v] else p
            score += math.log10(p)
            u, v = v, w
        out.append((i, held, len(words), sum(c1[w] > 0 for w in words), n, base, score))
    return out


@pytest.mark.parametrize("shard,block", [(2_000_000, 400_000), (500, 300)])
def test_scores_equal_brute_force(spark, tmp_path, monkeypatch, shard, block):
    """With small shards, frequent middle words are dealt to several."""
    monkeypatch.setattr(lm_trie, "SHARD_WORDS", shard)
    monkeypatch.setattr(lm_trie, "BLOCK_WORDS", block)
    rng = random.Random(2)
    rows = [r for r in _odd() if len(r[1] or "") < 1000]
    rows += [(200 + i, " ".join(rng.choice("the The of a b c d e f g h".split() + [f"w{rng.randrange(500)}"])
                                for _ in range(rng.randrange(60))), "en", "s", 1) for i in range(150)]
    _table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in lm_trie.query(spark, str(tmp_path)).collect()), key=str)
    want = sorted(_model(rows), key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx(w[6], abs=4 / lm_trie.GRID * w[2])  # four quantised factors a token


def test_held_out_prose_is_likelier_with_context(spark):
    got = lm_trie.query(spark, "/root/testdata/sf0.001").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1] * 0.95 > got[1]


def test_scores_without_training_or_rows(spark):
    rows = _table(spark, [(1, "a b", "en", "s", 1), (2, None, "en", "s", 1)])
    got = sorted(tuple(r) for r in lm_trie.scored(rows, F.lit(True)).collect())
    assert got == [(1, True, 3, 0, 0, 0.0, 0.0), (2, True, 1, 0, 0, 0.0, 0.0)]
    assert lm_trie.scored(_table(spark, []), F.lit(False)).collect() == []
