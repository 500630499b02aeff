r"""Operator 12, language-model scoring with an Elias-Fano n-gram trie.

A trigram model with Witten-Bell interpolation.  With c the counts in training texts and t(x) the number of distinct words
that follow x, p(w | u v) = c(u v w) / (c(u v) + t(u v)) + b(u v) * p(w | v), b(x) = t(x) / (c(x) + t(x)) (1 if x was never
seen), p(w | v) alike over p(w) = (c(w) + 1) / (N + V + 1).  A text begins after two begin marks and closes with one end.

1. Texts are cut into words once, in blocks of whole texts (stored: numbers of words local to the block, its vocabulary).
2. Vocabularies are dealt to buckets by word, a word once per block, and counted there.  Words are numbered by falling
   count: running sums over the buckets of each count.  So the count of a number is a step function of at most sqrt(2 N)
   steps, the model's first level, small enough for every task (54 MB at 10**13 words).
3. Every block sends its trigrams (v, u, w, text) to the shard of v, the middle word, packed and ordered.  A shard thus has
   all that p(w | u v) needs.  A word v with more than SHARD_WORDS occurrences is dealt to several shards by u, and each
   gets the block's distinct pairs (v, w).
4. A shard counts its training trigrams and builds its trie, one buffer of levels in an anonymous memory map: words v;
   pairs v -> w; contexts v -> u; triples (v, u) -> w.  Levels are Elias-Fano sequences, pointers between them are monotone and
   Elias-Fano too.  Within a context a third word is stored as its place among the successors of v, so that numbers are small.
   Probabilities and back-off weights are quantised to 16 bits of a logarithmic grid (1 / 4096 of a decade).
5. The shard looks its distinct trigrams up: successor search in the range of the context, in the part with equal high bits.
   It returns a sum for each text, in whole billionths, so that the order of addition does not matter; Spark adds these.

Work, shuffle and model grow with the corpus; nothing is capped, pruned or sampled.  Bounds: the first level above; a
shard has about SHARD_WORDS trigrams, but all of one context (u, v) are in one shard, once per block and text.

Defined results: null, empty and blank texts are one end; rows that repeat are rows of their own (each trains and is
scored); a null doc_id trains; extra columns are ignored; words of texts outside training have c = 0; an empty table gives
an empty result; without training texts every score is that of p(w) = 1.
"""

from __future__ import annotations

import mmap
import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ship, stored

ship(__name__)

END = b"\n"  # no word holds a line break
BLOCK_WORDS = 800_000  # below 2**20: a text's number in its block has 20 bits
SHARD_WORDS = 1_000_000
GRID = 4096  # steps of the quantiser per decade
NANO = 1e9
_U = np.uint64
_64 = _U(64)


# ---- Elias-Fano sequences -------------------------------------------------------------------------------------------

def _pack_low(x: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of x, one after the other in 64-bit words."""
    out = np.zeros(len(x) * bits // 64 + 2, _U)
    if bits and len(x):
        at = np.arange(len(x), dtype=_U) * _U(bits)
        low, shift, word = x & _U((1 << bits) - 1), at & _U(63), (at >> _U(6)).astype(np.int64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.add.reduceat(low << shift, first)  # bits do not overlap, so the sum is the union
        over = shift + _U(bits) > _64  # at most one of each word
        out[word[over] + 1] |= low[over] >> (_64 - shift[over])
    return out


def encode(values: np.ndarray) -> bytes:
    """A non-decreasing sequence of non-negative numbers: high parts in unary, low parts packed."""
    x = np.asarray(values).astype(_U)
    n = len(x)
    top = int(x[-1]) if n else 0
    bits = max(0, (top // max(n, 1)).bit_length() - 1)
    spot = (x >> _U(bits)).astype(np.int64) + np.arange(n)
    flags = np.zeros((n + (top >> bits) + 64) // 64 * 64, np.uint8)
    flags[spot] = 1
    high = np.packbits(flags, bitorder="little").view(_U)
    low = _pack_low(x, bits)
    return np.array([n, bits, len(high), len(low)], np.int64).tobytes() + high.tobytes() + low.tobytes()


class EliasFano:
    """Views on an encoded sequence; only a directory of counts per 64 bits is held beside it."""

    def __init__(self, buffer, at: int):
        self.n, self.bits, nh, nl = np.frombuffer(buffer, np.int64, 4, at).tolist()
        self.high = np.frombuffer(buffer, _U, nh, at + 32)
        self.low = np.frombuffer(buffer, _U, nl, at + 32 + 8 * nh)
        self.end = at + 32 + 8 * (nh + nl)
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.high), dtype=np.int64)])

    def _select(self, i: np.ndarray, one: bool) -> np.ndarray:
        """Place of the i-th (from 0) bit that is one, or zero."""
        before = self.ones if one else 64 * np.arange(len(self.ones)) - self.ones
        k = np.minimum(np.searchsorted(before, i, "right") - 1, len(self.high) - 1)
        word, rest = self.high[k] if one else ~self.high[k], i - before[k]
        place = np.zeros(len(i), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            here = np.bitwise_count(word & _U((1 << step) - 1)).astype(np.int64)
            right = rest >= here
            rest -= np.where(right, here, 0)
            place += np.where(right, step, 0)
            word = np.where(right, word >> _U(step), word)
        return 64 * k + place

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.int64)
        at = i * self.bits
        k, shift = at >> 6, (at & 63).astype(_U)
        both = self.low[k] >> shift
        both |= np.where(shift > 0, self.low[k + 1] << ((_64 - shift) & _U(63)), _U(0))
        return (both & _U((1 << self.bits) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, True) - i) << self.bits) | self._lows(i)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether x is there, and where: the first element >= x of those with its high bits, if there is one."""
        high = x >> self.bits
        most = 64 * len(self.high) - self.n - 1  # zeros
        inside = high <= most
        high = np.minimum(high, most)
        before = self._select(np.maximum(high - 1, 0), False)
        before[high == 0] = -1
        lo, end = before + 1 - high, self._zero_after(before) - high
        want, hi = x & ((1 << self.bits) - 1), end - 1
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._lows(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        hit = inside & (lo < end)
        hit[hit] = self._lows(lo[hit]) == want[hit]
        return lo, hit

    def _zero_after(self, at: np.ndarray) -> np.ndarray:
        """Place of the first zero bit after a place; one follows the last element."""
        at = at + 1
        k = at >> 6
        zeros = ~self.high[k] >> (at & 63).astype(_U)
        out = at + np.bitwise_count((zeros & -zeros) - _U(1))
        rest = np.flatnonzero(zeros == 0)
        while len(rest):
            k[rest] += 1
            zeros = ~self.high[k[rest]]
            out[rest] = 64 * k[rest] + np.bitwise_count((zeros & -zeros) - _U(1))
            rest = rest[zeros == 0]
        return out


# ---- the trie of a shard --------------------------------------------------------------------------------------------

def quantised(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-np.log10(p) * GRID), 65535).astype(np.uint16)


def _probability(code: np.ndarray) -> np.ndarray:
    return 10.0 ** (code / -GRID)


def _sums(keys: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    return np.bincount(keys, weights, n).astype(np.int64)


def build(v2: np.ndarray, w2: np.ndarray, c2: np.ndarray, v3: np.ndarray, u3: np.ndarray, w3: np.ndarray,
          c3: np.ndarray, words: int) -> bytes:
    """The trie of counted pairs (v, w) and triples (v, u, w), both ordered and distinct; numbers are below `words`.
    Every pair (v, w) of a triple is among the pairs."""
    roots, at2 = np.unique(v2, return_inverse=True)
    begin = np.searchsorted(v2, np.append(roots, words))
    total, kinds = _sums(at2, len(roots), c2), np.diff(begin)
    own = np.searchsorted(roots, v3)
    context, at3 = np.unique(own * words + u3, return_inverse=True)
    total3, kinds3 = _sums(at3, len(context), c3), np.bincount(at3, minlength=len(context))
    # a third word is its place among the successors of v; contexts follow each other without gaps
    key2 = at2 * words + w2
    place = np.searchsorted(key2, own * words + w3) - begin[own]
    base = np.concatenate([[0], np.cumsum(kinds[context // words])]).astype(np.int64)
    levels = [encode(x) for x in (roots, begin, key2, context, base, base[at3] + place)]
    codes = [quantised(x) for x in (kinds / (total + kinds), c2 / (total + kinds)[at2],
                                    kinds3 / (total3 + kinds3), c3 / (total3 + kinds3)[at3])]
    out = b"".join([np.array([words], np.int64).tobytes(), *levels])
    for code in codes:
        raw = code.tobytes()
        out += np.array([len(code)], np.int64).tobytes() + raw + bytes(-len(raw) % 8)
    return out


class Trie:
    """A built trie, mapped: every level is a view on the one buffer."""

    def __init__(self, raw: bytes):
        self.map = mmap.mmap(-1, len(raw))
        self.map[:] = raw
        self.words, at = int(np.frombuffer(self.map, np.int64, 1)[0]), 8
        levels = []
        for _ in range(6):
            levels.append(EliasFano(self.map, at))
            at = levels[-1].end
        self.roots, self.begin, self.pairs, self.contexts, self.base, self.triples = levels
        codes = []
        for _ in range(4):
            n = int(np.frombuffer(self.map, np.int64, 1, at)[0])
            codes.append(np.frombuffer(self.map, np.uint16, n, at + 8))
            at += 8 + 2 * n + -2 * n % 8
        self.back2, self.part2, self.back3, self.part3 = codes

    def _root(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.diff(v, prepend=-1))
        root, known = self.roots.find(v[first])
        size = np.diff(first, append=len(v))
        return np.repeat(root, size), np.repeat(known, size)

    def probability(self, v: np.ndarray, u: np.ndarray, own: np.ndarray, v2: np.ndarray, w2: np.ndarray,
                    own2: np.ndarray, single: np.ndarray) -> np.ndarray:
        """p(w | u v) of triples: number own of the distinct contexts (v, u) and number own2 of the distinct pairs
        (v2, w2), both in ascending order; single is p(w) of the pairs."""
        root, known = self._root(v)
        context, seen = np.zeros(len(v), np.int64), known.copy()
        context[known], seen[known] = self.contexts.find(root[known] * self.words + u[known])
        root2, known = self._root(v2)
        pair, old = np.zeros(len(v2), np.int64), known.copy()
        pair[known], old[known] = self.pairs.find(root2[known] * self.words + w2[known])
        q = single.astype(np.float64)
        q[known] *= _probability(self.back2)[root2[known]]
        q[old] += _probability(self.part2)[pair[old]]
        q, old = q[own2], old[own2]
        inner = seen[own]
        q[inner] *= _probability(self.back3)[context[own[inner]]]
        both = np.flatnonzero(inner & old)
        where = np.flatnonzero(seen)
        base = np.zeros(len(seen), np.int64)
        base[where] = self.base.get(context[where])
        if len(both):
            pair -= self.begin.get(np.arange(self.roots.n))[np.minimum(root2, self.roots.n - 1)]
        triple, old = self.triples.find(base[own[both]] + pair[own2[both]])
        q[both[old]] += _probability(self.part3)[triple[old]]
        return q


# ---- blocks of texts ------------------------------------------------------------------------------------------------

def _packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length, each by its byte planes, compressed."""
    planes = [np.ascontiguousarray(c).astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns]
    return zstandard.compress(b"".join(planes), 1)


def _unpacked(raw: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(columns, 4, -1)
    return [np.ascontiguousarray(p.T).view(np.int32).ravel() for p in planes]


_BLOCKS = "block bigint, doc_id array<bigint>, held array<boolean>, size binary, tokens binary, tokens_n bigint, vocabulary int, word binary, many binary"


def _blocks(docs: DataFrame, held) -> DataFrame:
    """Whole texts in blocks of about BLOCK_WORDS words, those that train first: ids, sizes in tokens, tokens as numbers
    of the block's vocabulary, and how often each word of it is in training texts."""
    names = [c.split()[0] for c in _BLOCKS.split(", ")]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.int64(), pa.int32(),
             pa.binary(), pa.binary()]

    def cut(batches):
        number, rows, n = count(TaskContext.get().partitionId() << 20), [], 0

        def block():
            rows.sort(key=lambda r: r[1])
            vocabulary = defaultdict(count().__next__)
            tokens = [np.fromiter(map(vocabulary.__getitem__, r[2]), np.int32, len(r[2])) for r in rows]
            flat = np.concatenate(tokens)
            training = sum(len(t) for t, r in zip(tokens, rows) if not r[1])
            many = np.bincount(flat[:training], minlength=len(vocabulary))
            cols = [next(number), [r[0] for r in rows], [r[1] for r in rows], _packed(np.array([len(t) for t in tokens])),
                    _packed(flat), len(flat), len(vocabulary), zstandard.compress(b" ".join(vocabulary), 3), _packed(many)]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cols, kinds)], names=names)

        for batch in batches:
            for doc_id, out, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held", "text"))):
                words = (text or "").encode().lower().split()  # A-Z only; at [\x20\x09-\x0D]
                words.append(END)
                rows.append((doc_id, out, words))
                n += len(words)
                if n >= BLOCK_WORDS:
                    yield block()
                    rows, n = [], 0
        if rows:
            yield block()

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"),
                       F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(cut, _BLOCKS)


def _dealt(blocks: DataFrame, buckets: int) -> DataFrame:
    """Of every block, per bucket its words (bytes joined by blanks), their local numbers and training counts."""
    def deal(batches):
        for rows in batches:
            for block, raw, many in zip(*(rows.column(c).to_pylist() for c in ("block", "word", "many"))):
                words, many = zstandard.decompress(raw).split(b" "), _unpacked(many, 1)[0]
                bucket = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % buckets
                order = np.argsort(bucket, kind="stable")
                parts = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(bucket[p[0]]) for p in parts], pa.int64()), pa.array([block] * len(parts), pa.int64()),
                    pa.array([zstandard.compress(b" ".join([words[i] for i in p.tolist()]), 3) for p in parts], pa.binary()),
                    pa.array([_packed(p, many[p]) for p in parts], pa.binary())], names=["bucket", "block", "word", "data"])

    return blocks.select("block", "word", "many").mapInArrow(deal, "bucket bigint, block bigint, word binary, data binary")


def _counted(rows: pa.Table) -> pa.Table:
    """Of one bucket: the words in each block as (local number, number in the bucket by falling count), and how many words
    have which count, falling.  Words outside training are left out."""
    number, seen, block, local = defaultdict(count().__next__), [], [], []
    total: list[np.ndarray] = []
    for b, raw, data in zip(*(rows.column(c).to_pylist() for c in ("block", "word", "data"))):
        here, many = _unpacked(data, 2)
        seen.append(np.fromiter(map(number.__getitem__, zstandard.decompress(raw).split(b" ")), np.int64, len(here)))
        total.append(many)
        block.append(b)
        local.append(here)
    c = np.bincount(np.concatenate(seen), np.concatenate(total), len(number)).astype(np.int64)
    order = np.argsort(-c, kind="stable")
    place = np.empty(len(c), np.int64)
    place[order] = np.arange(len(c))
    many, n = np.unique(c[c > 0], return_counts=True)
    keep = [c[s] > 0 for s in seen]
    return pa.table({"bucket": pa.array([rows.column("bucket")[0].as_py()], pa.int64()), "block": pa.array([block], pa.list_(pa.int64())),
                     "data": pa.array([[_packed(x[k], place[s[k]]) for x, s, k in zip(local, seen, keep)]], pa.list_(pa.binary())),
                     "c": pa.array([many[::-1]], pa.list_(pa.int64())), "n": pa.array([n[::-1]], pa.list_(pa.int64()))})


def _known(words: DataFrame, steps: DataFrame) -> DataFrame:
    """block, known: (local number, id) of its words that training has, packed by bucket; `steps` has the first id of every count."""
    counts = words.select("bucket", F.explode(F.arrays_zip("c", "n")).alias("x")).select("bucket", "x.c", "x.n")
    before = F.sum("n").over(Window.partitionBy("c").orderBy("bucket")) - F.col("n")
    starts = counts.withColumn("before", before).join(steps.select("c", "first"), "c").groupBy("bucket").agg(
        F.sort_array(F.collect_list(F.struct("c", (F.col("first") + F.col("before")).alias("id"))), False).alias("start"))

    def number(batches):
        for rows in batches:
            for blocks, data, n, start in zip(*(rows.column(c).to_pylist() for c in ("block", "data", "n", "start"))):
                n, start = np.array(n, np.int64), np.array([x["id"] for x in start], np.int64)
                ids = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
                out = []
                for raw in data:
                    local, place = _unpacked(raw, 2)
                    out.append(_packed(local, ids[place]))
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(out, pa.binary())], names=["block", "known"])

    rows = words.where(F.size("c") > 0).select("bucket", "block", "data", "n").join(starts, "bucket")
    return rows.select("block", "data", "n", "start").mapInArrow(number, "block bigint, known binary").groupBy("block").agg(
        F.collect_list("known").alias("known"))


def _scatter(v: np.ndarray, salt: np.ndarray, shards: int) -> np.ndarray:
    x = (v.astype(_U) * _U(0x9E3779B97F4A7C15)) ^ (salt.astype(_U) * _U(0xC2B2AE3D27D4EB4F))
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> _U(29))) % _U(shards)).astype(np.int64)


class Words:
    """The first level: counts of numbered words as steps, with totals.  Numbers v and v + 1 stand for a word outside
    training and for the begin mark."""

    def __init__(self, first: list[int], many: list[int], n: int, v: int, texts: int):
        self.parts = (first, many, n, v, texts)
        self.first, self.many = np.array(first, np.int64), np.array(many, np.int64)
        self.n, self.v, self.texts, self.unknown, self.begin = n, v, texts, v, v + 1

    def counts(self, ids: np.ndarray) -> np.ndarray:
        if not self.v:
            return np.zeros(len(ids), np.int64)
        return np.where(ids < self.v, self.many[np.searchsorted(self.first, ids, "right") - 1], 0)

    def probability(self, ids: np.ndarray) -> np.ndarray:
        return (self.counts(ids) + 1) / (self.n + self.v + 1)

    def salts(self, v: np.ndarray, shards: int) -> np.ndarray:
        """Shards that a middle word is dealt to; words outside training need no counts and go anywhere."""
        c = np.where(v == self.begin, self.texts, self.counts(v))
        return np.where(v == self.unknown, shards, np.clip(-(-c // SHARD_WORDS), 1, shards))


_SENT = "kind int, block bigint, shard bigint, training int, data binary, text bigint, doc_id bigint, held_out boolean, " \
        "n_tokens bigint, n_known bigint, base double"


def _sent(blocks: DataFrame, words: Words, shards: int) -> DataFrame:
    """Of every block: kind 0, per shard the pairs of its salted middle words; kind 1, per shard the trigrams (v, u, w,
    text), `training` the number of texts that train; kind 2, a row per text with its base score."""
    shared = blocks.sparkSession.sparkContext.broadcast(words.parts)
    names = [c.split()[0] for c in _SENT.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(),
             pa.int64(), pa.int64(), pa.float64()]

    def batch(n: int, **cols):
        return pa.RecordBatch.from_arrays([pa.array(cols[c], k) if c in cols else pa.nulls(n, k)
                                           for c, k in zip(names, kinds)], names=names)

    def split(block: int, kind: int, shard: np.ndarray, training: int, *cols: np.ndarray):
        order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
        edge = np.flatnonzero(np.diff(shard[order], prepend=-1))
        parts = np.split(order, edge[1:]) if len(order) else []
        for at in range(0, len(parts), 32):
            some = parts[at:at + 32]
            yield batch(len(some), kind=[kind] * len(some), block=[block] * len(some), shard=[int(shard[p[0]]) for p in some],
                        training=[training] * len(some),
                        data=[_packed(np.diff(cols[0][p], prepend=0), *(c[p] for c in cols[1:])) for p in some])

    def send(batches):
        level = Words(*shared.value)
        for rows in batches:
            known = rows.column("known")
            for i, row in enumerate(rows.drop_columns(["known"]).to_pylist()):
                ids = np.full(row["vocabulary"], level.unknown, np.int64)
                for raw in known[i].as_py() or ():
                    local, number = _unpacked(raw, 2)
                    ids[local] = number
                size, tokens = _unpacked(row["size"], 1)[0].astype(np.int64), ids[_unpacked(row["tokens"], 1)[0]]
                start = np.cumsum(size) - size
                c = level.counts(tokens)
                base = np.log10((c + 1) / (level.n + level.v + 1))
                n = len(size)
                yield batch(n, kind=[2] * n, block=[row["block"]] * n, shard=np.arange(n) % shards, text=np.arange(n), doc_id=row["doc_id"],
                            held_out=row["held"], n_tokens=size, n_known=np.add.reduceat((c > 0).astype(np.int64), start),
                            base=np.add.reduceat(base, start))
                v, u = np.roll(tokens, 1), np.roll(tokens, 2)
                v[start] = u[start] = level.begin
                u[start[size > 1] + 1] = level.begin
                text, training = np.repeat(np.arange(n), size), n - sum(row["held"])
                order = np.argsort(v << 32 | u)
                v, u, w, text = v[order], u[order], tokens[order], text[order]
                salts = level.salts(v, shards)
                yield from split(row["block"], 1, _scatter(v, np.where(salts > 1, u % salts, 0), shards), training, v, u, w, text)
                hot = (salts > 1) & (text < training) & (v != level.unknown)
                pair, many = np.unique(v[hot] << 32 | w[hot], return_counts=True)
                v, w = pair >> 32, pair & 0xFFFFFFFF
                salts = level.salts(v, shards)
                copies = np.repeat(np.arange(len(v)), salts)
                salt = np.arange(len(copies)) - np.repeat(np.cumsum(salts) - salts, salts)
                shard = _scatter(v[copies], salt, shards)
                # two salts of a word may meet in one shard, which needs its pairs once
                once = np.unique(shard * max(len(v), 1) + copies)
                shard, copies = once // max(len(v), 1), once % max(len(v), 1)
                yield from split(row["block"], 0, shard, training, v[copies], w[copies], many[copies])

    return blocks.mapInArrow(send, _SENT)


def _shard_scores(rows: pa.Table, words: Words) -> tuple[bytes, list[int], list[np.ndarray], list[np.ndarray]]:
    """The trie of one shard and, for each block, the texts in it and their billionths of log10 probability."""
    pairs, parts, blocks = [], [], []
    for kind, block, training, data in zip(*(rows.column(c).to_pylist() for c in ("kind", "block", "training", "data"))):
        if kind == 0:
            v, w, many = _unpacked(data, 3)
            pairs.append((np.cumsum(v, dtype=np.int64), w, many))
        elif kind == 1:
            v, u, w, text = _unpacked(data, 4)
            parts.append((np.cumsum(v, dtype=np.int64), u, w, text < training))
            blocks.append((block, text))
    size = words.v + 2
    v, u, w, train = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
    del parts
    context, own = np.unique(v * size + u, return_inverse=True)
    triple, at = np.unique(own * size + w, return_inverse=True)
    del own, v, u, w
    c3 = np.bincount(at, train, len(triple)).astype(np.int64)
    own, w = np.divmod(triple, size)
    begin, second = np.divmod(context, size)
    v, u = begin[own], second[own]
    del context, triple
    # pairs: of salted words as sent, of the others from the triples
    seen = c3 > 0
    asked, own2 = np.unique(v * size + w, return_inverse=True)
    v2, w2 = np.divmod(asked, size)
    c2 = np.bincount(own2, c3, len(asked)).astype(np.int64)
    cold = (c2 > 0) & (words.salts(v2, 1 << 30) == 1)
    key = np.concatenate([asked[cold]] + [p[0] * size + p[1] for p in pairs])
    key, where = np.unique(key, return_inverse=True)
    c2 = np.bincount(where, np.concatenate([c2[cold]] + [p[2] for p in pairs]), len(key)).astype(np.int64)
    raw = build(key // size, key % size, c2, v[seen], u[seen], w[seen], c3[seen], size)
    p = Trie(raw).probability(begin, second, own, v2, w2, own2, words.probability(w2))
    score, done, texts, sums = np.rint(np.log10(p) * NANO)[at], 0, [], []
    for _, text in blocks:
        total = np.bincount(text, score[done:done + len(text)])  # whole numbers, exact in doubles
        texts.append(np.unique(text))
        sums.append(total[texts[-1]].astype(np.int64))
        done += len(text)
    return raw, [b for b, _ in blocks], texts, sums


_OWN = ["text", "doc_id", "held_out", "n_tokens", "n_known", "base"]


def scored(docs: DataFrame, held) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; `held` is true for rows that
    do not train."""
    blocks = stored(_blocks(docs, held), "blocks")
    training = F.size(F.filter("held", lambda x: ~x))
    tokens, texts = blocks.agg(F.sum("tokens_n"), F.sum(training)).first()
    buckets = max(1, -(-(tokens or 0) // SHARD_WORDS))
    table = stored(_dealt(blocks, buckets).groupBy("bucket").applyInArrow(
        _counted, "bucket bigint, block array<bigint>, data array<binary>, c array<bigint>, n array<bigint>"), "words")
    counts = table.select(F.explode(F.arrays_zip("c", "n")).alias("x")).groupBy("x.c").agg(F.sum("x.n").alias("n"))
    first = F.sum("n").over(Window.orderBy(F.desc("c"))) - F.col("n")  # a row per count, at most sqrt(2 N)
    steps = stored(counts.select("c", "n", first.alias("first")), "steps")
    level = steps.orderBy("first").collect()
    words = Words([r["first"] for r in level], [r["c"] for r in level], sum(r["c"] * r["n"] for r in level),
                  sum(r["n"] for r in level), texts or 0)
    shards = max(1, -(-words.n // SHARD_WORDS))
    known = _known(table, steps)
    ready = blocks.select("block", "doc_id", "held", "size", "tokens", "vocabulary").join(
        known, "block", "left")
    shared = docs.sparkSession.sparkContext.broadcast(words.parts)

    def score(rows: pa.Table) -> pa.Table:
        _, block, texts, sums = _shard_scores(rows, Words(*shared.value))
        parts = [_packed(t, s >> 32, s) for t, s in zip(texts, sums)]
        parts = pa.table({"block": pa.array(block, pa.int64()), "part": pa.array(parts, pa.binary())})
        own = rows.filter(pc.equal(rows.column("kind"), 2)).select(["block", *_OWN])
        return pa.concat_tables([own, parts], promote_options="default").select(["block", *_OWN, "part"])

    def add(rows: pa.Table) -> pa.Table:
        """All of one block: its texts' rows, and the parts of their scores from the shards."""
        texts = rows.filter(pc.is_null(rows.column("part")))
        total = np.zeros(len(texts), np.int64)
        for raw in pc.drop_null(rows.column("part")).to_pylist():
            text, high, low = _unpacked(raw, 3)
            total[text] += (high.astype(np.int64) << 32) + low.view(np.uint32)
        place = texts.column("text").to_numpy()
        return texts.select(_OWN).append_column("score", pa.array(total[place] / NANO, pa.float64()))

    own = ", ".join(c for c in _SENT.split(", ") if c.split()[0] in _OWN)
    parts = _sent(ready, words, shards).groupBy("shard").applyInArrow(score, f"block bigint, {own}, part binary")
    out = parts.groupBy("block").applyInArrow(add, f"{own}, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(words.n).cast("long").alias("train_tokens"),
                      F.col("base").alias("base_score"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("long").cast("string")) % 7 == 2
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), held)
