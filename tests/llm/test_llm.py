"""The training-data operators against brute force on small made tables, and their edge cases: nulls, empty and long
texts, ties, repeated rows, empty tables, extra columns."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from valuelens.llm import (chat_format, decontaminate, exact_dedup, mix_sources, near_dup, personal_data, shard_table,
                           site_quality, token_counts, toxicity)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"


def _docs(spark, texts, sources=None, first=0):
    rows = [(first + i, t, "en", sources[i] if sources else "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


ODD = [None, "", "   \n", "a", "a", "one two", "é ß   x" * 3, "word " * 30_000, "x" * 50_000, "<null>\x00\x7f [a] \\ %"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a null id and source, rows that repeat, and extra columns with clashing names."""
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(ODD)] + [(None, "null id", None, None, None)]
    rows += [rows[3], rows[7]]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(7).alias(c) for c in ("key", "name", "size", "row", "shard", "slot", "hash", "words", "n", "_key", "_bad", "_lap", "lap", "begin")])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


def test_exact_dedup(spark, odd, empty):
    texts = ["a b", "ab", "a  b", "", None, "x" * 25, "x" * 24 + " x", "x" * 24 + "y", "x" * 10 + "y" + "x" * 14]
    got = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(_docs(spark, texts), block=4).collect()}
    plain = [re.sub(r"[ \t\n\x0b\x0c\r]", "", t or "") for t in texts]
    for i, p in enumerate(plain):
        group = [j for j, q in enumerate(plain) if q == p]
        keep = min(group, key=lambda j: (-len(texts[j] or ""), j))
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (keep, len(group), i == keep)
        assert got[i]["text_sha256"] == _sha(p)
    assert exact_dedup.exact_duplicates(odd).count() == len(ODD) + 1
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_decontaminate(spark, odd, empty):
    bench = spark.createDataFrame([(10, " ".join(f"w{i}" for i in range(20))), (2, "Short one"), (3, None), (4, "--"),
                                   (5, "Short ONE")], "item_id long, text string")
    long = " ".join(f"w{i}" for i in range(3, 18))
    texts = [long, "x " * 400 + long, "a short one here", "short", None, "W0-W1 w2", "pad " * 99 + "short one"]
    got = {r["doc_id"]: r for r in decontaminate.contamination(_docs(spark, texts), bench).collect()}
    assert [(got[i]["n_words"], got[i]["n_hit"], got[i]["items"], got[i]["contaminated"]) for i in range(7)] == [
        (15, 15, "10", True), (415, 15, "10", False), (4, 2, "2,5", True), (1, 0, "", False), (0, 0, "", False),
        (3, 0, "", False), (101, 2, "2,5", False)]
    one_row_blocks = decontaminate.matches(_docs(spark, texts), bench, max_block_rows=3)[0]
    whole = decontaminate.matches(_docs(spark, texts), bench)[0]
    assert sorted(map(tuple, one_row_blocks.where("wlen > 0").distinct().collect())) == sorted(
        map(tuple, whole.where("wlen > 0").distinct().collect()))
    assert decontaminate.decontaminated(odd, bench).count() == odd.count()
    assert decontaminate.contamination(odd, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0


def _luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def _brute_spans(text):
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19
              and _luhn(re.sub("[^0-9]", "", m))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15)]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, text) if ok(m.group())]


def test_personal_data(spark, odd, empty):
    rng = np.random.default_rng(1)
    pieces = ["a@b.co", "@", ".", "4111 1111 1111 1111", "4111-1111-1111-1112", "10.0.0.1", "256.1.1.1", "1.2.3.4.5", "+1 (212) 555-0100",
              "+", " ", "é", "x_y@z-1.de.", "0", "12", "-", "DE89370400440532013000", "_", "😀", "378282246310005", "a@b.c@d.e"]
    texts = ["".join(pieces[j] for j in rng.integers(0, len(pieces), 12)) for _ in range(300)]
    texts += ["a@b" + ".c" * 20_000, "1" * 60_000, "+" + "(" * 60_000, "a" * 100_000 + "@"]
    got = {r["doc_id"]: r["found"] for r in personal_data.find(_docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = [f"{s['kind']}:{s['start']}:{s['end']}" for s in got[i] if s["kind"] in personal_data.BASE]
        assert base == _brute_spans(t), t[:200]
    extra = personal_data.find(_docs(spark, ["my iban DE89 3704 0044 0532 0130 00", "DE88370400440532013000",
                                             "ssn 123-45-6789", "order 123-45-6789"])).orderBy("doc_id").collect()
    assert [[s["kind"] for s in r["found"]] for r in extra] == [["iban"], [], ["ssn"], []]
    assert personal_data.find(odd).count() == odd.count() and personal_data.find(empty).count() == 0


@pytest.mark.parametrize("words,percent,large,rounds", [(3, 90, 8, 4), (5, 80, 2, 1), (5, 80, 64, 2)])
def test_near_copies_equal_brute_force(spark, words, percent, large, rounds, monkeypatch):
    monkeypatch.setattr(near_dup, "LARGE", large)
    monkeypatch.setattr(near_dup, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(near_dup, "SALT", 3)
    rng = np.random.default_rng(words)
    texts = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in rng.integers(0, 400, 90)]
        for _ in range(14):
            w = list(base)
            for j in rng.integers(0, len(w), rng.integers(0, 5)):
                w[j] = f"e{rng.integers(0, 30)}"
            texts.append(" ".join(w))
    texts += ["common passage of some words that many share " + f"t{i} " * 3 for i in range(20)]
    # almost linked: each differs from a common text, which is missing, in one place of its own; a few in two
    base = [f"almost{i}" for i in range(90)]
    for i in range(17):
        w = list(base)
        w[5 * i + 2] = f"own{i}"
        w[88 if i % 6 == 0 else 5 * i + 2] = "last"
        texts.append(" ".join(w))
    texts += ["", None, "A", "a", "a b", "A  B", texts[0].upper(), "same row"]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i:i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [new if c == old else c for c in comp]
    got = {r["doc_id"]: r for r in near_dup.components(_docs(spark, texts), words, percent).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == comp
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]


def test_near_copies_edges(spark, odd, empty):
    assert near_dup.components(odd).count() == len(ODD) + 1
    left = near_dup.one_of_each(odd)
    assert left.columns == odd.columns
    assert sorted(r["doc_id"] for r in left.where("doc_id IS NOT NULL").collect()) == [0, 1, 2, 3, 5, 6, 7, 8, 9]
    assert near_dup.one_of_each(empty).count() == 0


def test_shard_table(spark, odd, empty):
    owner = shard_table.fill([f"s{i}" for i in range(5)], 101)
    assert sorted(np.bincount(owner)) == [20, 20, 20, 20, 21]
    fewer = shard_table.fill([f"s{i}" for i in range(4)], 101)
    assert sum(a != b for a, b in zip(owner, fewer) if a < 4) < 40  # most slots of the shards that stay
    got = shard_table.placed(odd)
    assert got.count() == odd.count() and got.where("shard IS NULL").count() == 0
    assert shard_table.placed(empty).count() == 0


def test_mix_sources(spark, odd, empty):
    sources = ["a"] * 40 + ["b"] * 10 + [None] * 5 + ["c"]
    docs = _docs(spark, [" ".join("w" * (1 + i % 9)) for i in range(len(sources))], sources)
    got = mix_sources.mixture(docs, block=4).collect()
    size = {}
    for r in got:
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
    weight = {"a": 3, "b": 1, "c": 2, None: 3}
    target, open_ = {}, set(size)
    while open_:
        rest = 1.5 * sum(size.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * size[s]}
        if not full:
            target.update(share)
            break
        target.update({s: 2.0 * size[s] for s in full})
        open_ -= full
    taken = {s: sum(r["taken"] for r in got if r["source"] == s) for s in size}
    for r in got:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert all(target[s] - 1 - 1e-6 <= taken[s] <= target[s] + 1e-6 for s in size)
    mixed = mix_sources.mixed(docs, block=4)
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(mix_sources.words_of(F.col("text")))).first()[0] == sum(taken.values())
    assert mix_sources.mixture(odd).count() == len(ODD) + 1
    assert mix_sources.mixed(empty).count() == 0


def test_mix_is_in_the_order_of_the_schedule(spark):
    n = {"a": 300, "b": 100, "c": 200}  # as the weights, so that all sources run through the whole mix
    sources = [s for s, k in n.items() for _ in range(k)]
    docs = _docs(spark, [f"w{i} " * 4 for i in range(600)], sources)
    got = [r["source"] for r in mix_sources.mixed(docs, block=4).collect()]
    assert len(got) == 900
    for s, k in n.items():  # a golden-ratio sequence is near its share over every stretch
        at = np.cumsum([x == s for x in got])
        assert np.abs(at - np.arange(1, 901) * k / 600).max() < 6
    place = {}
    for r in mix_sources.mixture(docs, block=4).collect():
        for lap in ("first_position", "second_position"):
            if r[lap] is not None:
                place[r[lap]] = r["doc_id"]
    assert [r["doc_id"] for r in mix_sources.mixed(docs, block=4).collect()] == [place[p] for p in sorted(place)]


def test_a_part_taken_keeps_its_white_space(spark):
    texts = ["  one\ttwo\n\n three\x0b\x0b", "one  two", "é\n😀 \r\n ß", "a"]
    rows = [(t, n, t[:[m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)][n - 1]])
            for t in texts for n in range(1, len(t.split()) + 1)]
    got = spark.createDataFrame(rows, "text string, n int, want string").select(
        "want", mix_sources.first_words(F.col("text"), F.col("n")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    docs = _docs(spark, ["\n".join(f"w{i}  x{i}" for i in range(k)) for k in (400, 90, 200)], ["a", "b", "c"])
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = mix_sources.mixed(docs).collect()
    assert all(whole[r["doc_id"]].startswith(r["text"]) for r in out) and any(r["text"] != whole[r["doc_id"]] for r in out)


def test_chat_format(spark):
    rows = [(1, 0, "system", "be [kind] <s>"), (1, 1, "user", "hi\\s"), (1, 2, "assistant", "</s>[INST:user]x"), (1, 3, "user", None),
            (1, 4, "assistant", "\\l"), (1, 5, "user", "bye"), (2, 0, "user", "only"), (None, None, None, "lost"), (3, 0, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.examples(df)).collect()}
    for conv in (1, 2, 3, None):
        turns = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv]["n_turns"] == len(turns) and got[conv]["loss_chars"] == len(loss)
        assert got[conv]["turns_sha256"] == _sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert got[conv]["loss_sha256"] == _sha(loss)
    shown = chat_format.examples(df).where("conv_id = 1").orderBy("example").collect()
    assert [r["example"] for r in shown] == [2, 4, 5] and shown[-1]["loss_start"] is None
    assert all(shown[-1]["text"].startswith(r["text"]) for r in shown)
    assert chat_format.read_back(chat_format.examples(df.limit(0))).count() == 0


def test_a_long_conversation_copies_no_prefixes(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(c, int(t), ("user", "assistant", None)[rng.integers(0, 3)], "x<\\" * int(rng.integers(0, 5)))
            for c in (1, 2, None) for t in rng.integers(0, 12, 30)] + [(1, None, "assistant", "first"), (1, -3, "assistant", "é")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    one = sorted(map(str, chat_format.read_back(chat_format.examples(df)).collect()))
    monkeypatch.setattr(chat_format, "TURN_BITS", 1)
    assert sorted(map(str, chat_format.read_back(chat_format.examples(df)).collect())) == one
    assert sorted(map(str, chat_format.summary(df).collect())) == one
    spans = lambda f, *more: sorted(map(str, f.select("conv_id", "loss_start", "loss_end", *more).collect()))
    assert spans(chat_format.expanded(df).where("shown"), "end") == spans(chat_format.examples(df), F.length("text").alias("end"))
    n = 40_000  # the prefixes of its 20,000 examples have 25 billion characters
    turn = F.when(F.col("id") % 2 == 1, "assistant").otherwise("user")
    long = spark.range(n).select(F.lit(5).alias("conv_id"), F.col("id").alias("turn"), turn.alias("role"),
                                 F.lpad(F.col("id").cast("string"), 45, "t").alias("text"))
    got = chat_format.summary(long).collect()
    texts = [str(i).rjust(45, "t") for i in range(n)]
    ends = np.cumsum([len(f"[INST:{('user', 'assistant')[i % 2]}]{t}</s>") for i, t in enumerate(texts)])
    assert [tuple(r)[1:] for r in got] == [(
        n, _sha("".join(f"{('user', 'assistant')[i % 2]}\n{t}\n" for i, t in enumerate(texts))), 45 * n // 2,
        _sha("".join(texts[1::2])), int(ends[1::2].sum()))]


def test_token_counts(spark, odd, empty):
    texts = ["héllo wörld\nnext line\n\n", "", None, "no newline", "a" * 3000 + "\n" + " " * 3000]
    for rule in ("first", "last", "most"):
        got = token_counts.count_tokens(_docs(spark, texts), rule=rule).orderBy("doc_id", "section").collect()
        for i, t in enumerate(texts):
            mine = [r for r in got if r["doc_id"] == i]
            parts = [(t or "")[r["char_start"]:r["char_end"]] for r in mine]
            assert parts == ((t or "").splitlines(keepends=True) or [""])
            assert sum(r["n_tokens"] for r in mine) == len(token_counts.token_ends(t or ""))
    ends, sections = np.array([2, 6, 7]), np.array([3, 4, 7])
    assert [token_counts.attribute(ends, sections, r).tolist() for r in ("first", "last", "most")] == [
        [2, 0, 1], [1, 0, 2], [1, 0, 2]]
    assert token_counts.count_tokens(odd).select("doc_id").distinct().count() == len(ODD) + 1
    assert token_counts.count_tokens(empty).count() == 0


def test_token_counts_of_long_runs_are_those_of_the_whole():
    encoding = token_counts._encoder(None)[0]
    rng = np.random.default_rng(5)
    pieces = ["word", "don't", " ", "12", "--", "é", "\u3000", "\x1c", "\n" * 1500, " " * 2000, "\t \n\xa0" * 900, " \x85" * 600 + "\n"]
    for _ in range(60):
        text = "".join(pieces[j] for j in rng.integers(0, len(pieces), 9))
        assert token_counts._around_runs(encoding, text) == encoding.encode_ordinary(text)
    # the splitter gives up on the run; the word before it lies on both sides of character 100,000
    ends = token_counts.token_ends("ab " * 33_333 + "information" + " " * 1_000_000 + "end")
    head = token_counts.token_ends("ab " * 33_333 + "information")
    assert ends[:len(head)].tolist() == head.tolist() and ends[-1] == 99_999 + 11 + 1_000_000 + 3
    assert ends[-2] == ends[-1] - 4  # the run's last blank goes with the word


def _auc(score, y):
    rank = np.argsort(np.argsort(score))
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))


def test_toxicity_learns_and_shares_subwords(spark, odd, empty, labels):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    texts, y = [], []
    for i in range(1800):
        w = [word() for _ in range(30)]
        if i % 3 == 0:
            w[7] = "horrible" if i % 6 else "horribel"  # the second spelling is held back below
        texts.append(" ".join(w))
        y.append(int(i % 3 == 0))
    seen = [i for i in range(1800) if i % 6]
    known = lambda some: spark.createDataFrame([(i, 1, y[i]) for i in some], "doc_id long, quality int, toxic int")
    model = toxicity.fitted(_docs(spark, texts), known(seen))
    bucket, _ = toxicity.bags([b"horribel"])
    plain, _ = toxicity.bags([b"abcdefgh"])
    assert model.weight[bucket].mean() > model.weight[plain].mean()
    got = toxicity.score(_docs(spark, texts), known(range(1800))).toPandas().sort_values("doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in range(1800)])
    assert (got["held_out"].to_numpy() == held).all()
    assert _auc(got["score"].to_numpy()[held], np.array(y)[held]) > 0.9
    assert toxicity.score(odd, labels).count() == odd.count()
    assert toxicity.score(empty, labels).count() == 0 and toxicity.score(odd, labels.limit(0)).where("predicted = 1").count() == 0


def test_toxicity_curve_sees_texts_of_every_length(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 5)
    texts = [f"plain{i % 7} words{i % 5} here " * (2000 if i % 2 else 3) + ("horrible thing" if i % 3 == 0 else "") for i in range(120)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    known = []
    monkeypatch.setattr(toxicity, "curve", lambda w, b, best, n, y, prior, f=toxicity.curve: known.append(n) or f(w, b, best, n, y, prior))
    assert toxicity.score(_docs(spark, texts), labels).count() == 120
    aside = [i for i in range(120) if zlib.crc32(str(i).encode()) % 4 != 2 and zlib.crc32(f"aside{i}".encode()) % 3 == 2]
    assert known[0].tolist() == [-(-len(texts[i].split()) // toxicity.WINDOW) for i in aside]
    assert max(len(texts[i]) for i in aside) > 20_000


def test_toxicity_trains_on_long_texts_and_on_one_text_of_an_id(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_WINDOWS", 50)
    short, long = "a b c", " ".join(f"w{i}" for i in range(1001))
    assert toxicity.thinned(short) == short
    words = toxicity.thinned(long).split()
    places = [int(w[1:]) for w in words]
    assert len(words) == 100 and places == sorted(places) and all(p % 2 == 0 and q == p + 1 for p, q in zip(places[::2], places[1::2]))
    assert min(places) < 200 and max(places) > 800  # from all over the text
    trained = []
    monkeypatch.setattr(toxicity, "vectors_of", lambda t, y, f=toxicity.vectors_of: trained.append(sorted(t)) or f(t, y))
    monkeypatch.setattr(toxicity, "EPOCHS", 2)
    texts = [f"id {i} " + ("bad " * 500 if i % 2 else "good") for i in range(40)]
    docs = _docs(spark, texts).unionByName(_docs(spark, [f"again {i}" for i in range(40)])).unionByName(_docs(spark, [None] * 40))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    for rows in (docs, docs.repartition(5)):
        toxicity.fitted(rows, labels)
    md5 = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2 and zlib.crc32(f"aside{i}".encode()) % 3 != 2]
    first = [min((texts[i], f"again {i}", None), key=md5) for i in ids]
    assert trained == [sorted(toxicity.thinned(t) for t in first if t)] * 2


def _brute_toxicity(model, text):
    """A score from the fitted weights, one n-gram at a time."""
    values = []
    for w in (text or "").encode().lower().split():
        marked = b"<" + (w.strip(b".,;:!?()[]{}\"'|*#%$&<>-_") or w) + b">"
        buckets = [zlib.crc32(marked) % toxicity.BUCKETS]
        for n in (3, 4, 5):
            for i in range(len(marked) - n + 1):
                h = n
                for c in marked[i:i + n]:
                    h = (h ^ c) * 0x01000193 % 2 ** 32
                buckets.append((h ^ (h >> 15)) % toxicity.BUCKETS)
        values.append(sum(float(model.weight[b]) for b in buckets) / len(buckets))
    windows = [sum(values[i:i + 2]) / 2 for i in range(0, len(values), 2)]
    best, n = (max(windows), len(windows)) if windows else (model.clean, 1)
    return 1 / (1 + np.exp(-(model.slope * best + model.per_log * np.log(n) + model.shift)))


def test_toxicity_scores_equal_brute_force(spark, labels, odd):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10 ** 9 + i, t) for i, t in enumerate(ODD[:7])], "doc_id long, text string")
    docs = docs.unionByName(more)
    model = toxicity.fitted(docs, labels)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.score(docs, labels).collect():
        assert abs(r["score"] - _brute_toxicity(model, text[r["doc_id"]])) < 1e-5, r


def test_site_quality(spark, odd, empty, labels):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = site_quality.site_quality(docs, labels, F.col("source"), F.col("lang")).toPandas()
    known = got.merge(labels.toPandas(), on="doc_id")
    assert len(got) == docs.count() and _auc(known["score"].to_numpy(), known["quality"].to_numpy()) > 0.9
    assert site_quality.site_quality(odd, labels, F.col("source"), F.col("lang")).count() == odd.count()
    assert site_quality.site_quality(empty, labels, F.col("source"), F.col("lang")).count() == 0


def test_a_site_of_one_document_keeps_the_prior(spark, labels):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    host = F.when(F.col("doc_id") % 4 == 0, F.lit("large")).otherwise(F.concat(F.lit("h"), F.col("doc_id").cast("string")))
    got = site_quality.site_quality(docs, labels, host, F.col("lang")).toPandas()
    mean = got["evidence"].mean()
    one = got[got["doc_id"] % 4 != 0]
    assert len(one) > 100 and np.allclose(one["host_prior"], mean) and np.allclose(one["path_prior"], mean)
    assert np.allclose(one["score"], one["evidence"], atol=1e-4)  # its own evidence does not count twice
    large = got[got["doc_id"] % 4 == 0]
    rest = (large["evidence"].sum() - large["evidence"]) / (len(large) - 1)
    low, high = np.minimum(rest, mean), np.maximum(rest, mean)
    assert ((large["host_prior"] >= low - 1e-9) & (large["host_prior"] <= high + 1e-9)).all()


def test_site_posteriors_equal_brute_force(spark, labels):
    """Hosts of one and of two documents beside large ones: moments and posteriors by plain loops."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").drop_duplicates(["doc_id"])
    def host_of(i):
        return "large" if i % 5 == 0 else f"pair{i // 10}" if i % 5 in (1, 2) else f"one{i}"
    n = F.col("doc_id")
    host = F.when(n % 5 == 0, F.lit("large")).when((n % 5).isin(1, 2), F.concat(F.lit("pair"), F.expr("doc_id div 10"))).otherwise(
        F.concat(F.lit("one"), n))
    got = site_quality.site_quality(docs, labels, host, (n % 3).cast("string")).toPandas()
    p = dict(zip(got["doc_id"], got["evidence"]))
    hosts, paths = {}, {}
    for i in p:
        hosts.setdefault(host_of(i), []).append(i)
        paths.setdefault((host_of(i), i % 3), []).append(i)
    mean = lambda ids: sum(p[i] for i in ids) / len(ids)

    def strength(groups, parent):
        inside = sum((p[i] - mean(g)) ** 2 for g in groups for i in g)
        within = inside / sum(len(g) - 1 for g in groups)
        away = sum(len(g) * (mean(g) - mean(parent(g))) ** 2 for g in groups)
        free = sum(1 - len(g) / len(parent(g)) for g in groups)
        weight = sum(len(g) * (1 - len(g) / len(parent(g))) for g in groups)
        between = (away - free * within) / weight
        return min(1e6, within / between) if between > 0 else 1e6

    k_host, k_path = strength(hosts.values(), lambda g: list(p)), strength(paths.values(), lambda g: hosts[host_of(g[0])])
    mu = mean(list(p))
    for r in got.itertuples():
        i = r.doc_id
        rest, near = [j for j in hosts[host_of(i)] if j != i], [j for j in paths[host_of(i), i % 3] if j != i]
        prior = (sum(p[j] for j in rest) + k_host * mu) / (len(rest) + k_host)
        path = (sum(p[j] for j in near) + k_path * prior) / (len(near) + k_path)
        z = np.log(p[i] / (1 - p[i])) + np.log(max(path, 1e-6) / max(1 - path, 1e-6)) - np.log(mu / (1 - mu))
        assert np.allclose([r.host_prior, r.path_prior, r.score], [prior, path, 1 / (1 + np.exp(-z))], atol=1e-6), r


def test_token_counts_equal_a_loop_over_tokens(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    encoding = token_counts._encoder(None)[0]
    got = {}
    for r in token_counts.count_tokens(docs).orderBy("doc_id", "section").collect():
        got.setdefault(r["doc_id"], []).append(r["n_tokens"])
    for i, t in text.items():
        line, counts = 0, [0] * max(1, t.count("\n") + (not t.endswith("\n")))
        for token in encoding.encode_ordinary(t):
            counts[line] += 1  # the line of the token's first byte
            raw = encoding.decode_single_token_bytes(token)
            line += raw.count(b"\n")
        assert got[i] == counts, i


def test_stages_keep_what_brute_force_keeps(spark, labels, empty, tmp_path):
    word = lambda g, i: f"g{g}w{i}"
    base = [[word(g, i) for i in range(80)] for g in range(4)]
    near = [" ".join(base[0]), " ".join(base[0][:-1] + ["end"]), " ".join(["start"] + base[0][1:]), " ".join(base[1]),
            " ".join(base[1][:20] + ["x"] + base[1][21:40] + ["y"] + base[1][41:60] + ["z"] + base[1][61:]), " ".join(base[2]),
            " ".join(base[2]).upper(), "", None, "a b", "a b"]
    sets = []
    for t in near:
        w = (t or "").lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    kept = [i for i, s in enumerate(sets)  # the first of each group; here every link is one to the first
            if not any(s and len(s & o) >= 0.8 * len(s | o) for o in sets[:i])]
    assert kept == [0, 3, 4, 5, 7, 8, 9]
    out = corpus_pipeline.drop_near_copies(spark, _docs(spark, near), SMALL)
    assert sorted(r["doc_id"] for r in out.collect()) == kept

    item = " ".join(base[3][:30])
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = [item, "pad " * 200 + " ".join(base[3][3:16]), "pad " * 300 + " ".join(base[3][3:16]), " ".join(base[3][3:15]), None,
             " ".join(base[3][3:16]).upper() + "."]
    windows = [base[3][i:i + 13] for i in range(18)]
    kept = []
    for i, t in enumerate(texts):
        w = re.findall("[0-9a-z]+", (t or "").lower())
        hit = {j + k for j in range(len(w)) for k in range(13) if w[j:j + 13] in windows}
        if not hit or 20 * len(hit) < len(w):
            kept.append(i)
    out = corpus_pipeline.drop_contaminated(spark, _docs(spark, texts), str(tmp_path))
    assert sorted(r["doc_id"] for r in out.collect()) == kept == [2, 3, 4]

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bad = {r["doc_id"] for r in toxicity.score(docs, labels).where("predicted = 1").collect()}
    out = [r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, SMALL).collect()]
    assert bad and sorted(out) == sorted(r["doc_id"] for r in docs.collect() if r["doc_id"] not in bad)

    now = empty
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SMALL)
        assert now.count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SMALL)
        assert now.columns == docs.columns, name
    last = corpus_pipeline.STAGES[-1][1](spark, now, SMALL)
    assert 0 < last.select("doc_id").distinct().count() <= docs.count() and "shard" in last.columns


def test_chat_format_query_reads_whole_examples_back(spark, tmp_path, monkeypatch):
    rows = [(1, 0, "user", "a<b"), (1, 1, "assistant", "[x]"), (1, 2, "user", "c"), (1, 3, "assistant", None), (2, 0, "user", "only")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    made, whole = [], chat_format.examples
    monkeypatch.setattr(chat_format, "examples", lambda r: made.append(whole(r)) or made[-1])
    got = {r["conv_id"]: r for r in chat_format.query(spark, str(tmp_path)).collect()}
    texts = made[0].groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()
    assert {r["conv_id"]: (r["n"], r["chars"]) for r in texts} == {c: (n, got[c]["formatted_chars"]) for c, n in ((1, 2), (2, 1), (-7, 1))}
    assert (got[1]["n_turns"], got[1]["loss_chars"]) == (4, 3)
