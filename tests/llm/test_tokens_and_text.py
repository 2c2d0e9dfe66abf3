"""BPE, decontamination, language and toxicity against brute force and held-out rows."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from loadlens.llm import bpe, decontaminate, langid, queries, toxicity
from loadlens.llm.workers import is_training_row

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path(queries.BYTE_BPE)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                             mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def odd_texts(n, seed):
    rng = random.Random(seed)
    alphabet = "aabbeeeinrst  \n\t'.,09_ÄßéñцшΩ日本語🙂​　\x1c\x85İ"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_bpe_equals_the_library(reference):
    enc = bpe.Encoder(bpe.load_ranks(PATH), public_tokenizers.PATTERN)
    texts = odd_texts(3000, 1) + ["", "a" * 5000, " " * 3000, "abcabc" * 900, "é" * 999, "'s't 're",
                                  "<|endoftext|>", "\r\n\r\n  x"]
    for t in texts:
        ids = np.frombuffer(enc.encode(t), "<u4").tolist()
        assert ids == reference.encode_ordinary(t), repr(t[:80])
        assert enc.decode(enc.encode(t)) == t.encode()


def test_bpe_pieces_equal_the_merge_rule():
    ranks = {bytes([b]): b for b in range(256)}
    for i, token in enumerate([b"ab", b"bc", b"abc", b"cd", b"bcd", b"aa", b"aab", b"dab", b"aaa"]):
        ranks[token] = 256 + i
    enc = bpe.Encoder(ranks, r"(?s).+")
    for n in range(1, 8):
        for cut in itertools.product(b"abcd", repeat=n):
            piece = bytes(cut)
            want = [ranks[piece]] if piece in ranks else bpe.merge_by_rank(piece, ranks)
            assert enc.piece(piece) == want


def test_bpe_rows(spark, reference):
    rows = [(1, "the cat\n", "x"), (1, "the cat\n", "x"), (None, "", "y"), (2, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, bpe.digest_tokens(docs, PATH, public_tokenizers.PATTERN).collect()),
                 key=str)
    ids = np.array(reference.encode_ordinary("the cat\n"), "<u4").tobytes()
    none = hashlib.sha256(b"").hexdigest()
    own = (1, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(b"the cat\n").hexdigest())
    assert got == sorted([own, own, (None, 0, none, none), (2, 0, none, none)], key=str)
    ids = bpe.encode_texts(docs, PATH, public_tokenizers.PATTERN)
    back = bpe.decode_ids(ids, PATH, public_tokenizers.PATTERN)
    assert sorted(bytes(r["content"]) for r in back.collect()) == [b"", b"", b"the cat\n", b"the cat\n"]
    assert bpe.digest_tokens(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_bpe_query_equals_the_library(spark, reference):
    got = {r["doc_id"]: r for r in queries.op5_byte_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = np.array(reference.encode_ordinary(d["text"]), "<u4")
        assert got[d["doc_id"]]["n_tokens"] == len(ids)
        assert got[d["doc_id"]]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[d["doc_id"]]["decoded_sha256"] == hashlib.sha256(d["text"].encode()).hexdigest()


def naive_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def naive_hits(docs, items, window):
    out = []
    for i, text in docs:
        words, hit, named = naive_words(text), set(), set()
        for item, body in items:
            w = naive_words(body)
            n = min(window, len(w))
            for s in range(len(w) - n + 1 if n else 0):
                for at in range(len(words) - n + 1):
                    if words[at:at + n] == w[s:s + n]:
                        hit |= set(range(at, at + n))
                        named |= {str(item)} if item is not None else set()
        out.append((i, len(words), len(hit), tuple(sorted(named))))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_windows", [50_000, 7])
def test_decontamination_equals_brute_force(spark, block_windows):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["a", "B", "ä", "d-e"]) for _ in range(n))
    items = [(i, text(rng.randrange(1, 9))) for i in range(12)] + [
        (12, None), (13, ""), (None, "zz yy xx"), (3, "again")]
    docs = [(i, text(rng.randrange(0, 30))) for i in range(25)] + [
        (3, "q zz yy xx again"), (None, None), (7, ""), (3, "q zz yy xx again")]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(d, b, window=5, block_windows=block_windows)
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got.collect()),
                 key=str)
    assert got == naive_hits(docs, items, 5)


def test_decontamination_of_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:3] for r in decontaminate.decontaminate(d, b).select(
        "doc_id", "n_words", "n_hit").collect()] == [(1, 2, 0)]
    assert decontaminate.decontaminate(d.limit(0), b).count() == 0


def segmentations(word):
    if not word:
        yield []
    for n in range(1, min(langid.LONGEST, len(word)) + 1):
        for rest in segmentations(word[n:]):
            yield [word[:n], *rest]


def test_language_likelihood_sums_all_segmentations():
    pieces = sorted({bytes([b]) for b in range(256)} | {b" a", b"ab", b"abc", b"bca", b" ab", b"ca"})
    rng = np.random.default_rng(0)
    probs = rng.random((len(pieces), 2))
    probs /= probs.sum(axis=0)
    logs = np.log(probs)
    lattice, place = langid.Lattice(pieces), {p: i for i, p in enumerate(pieces)}
    words = ["abcabca", "b", "cab", "ab" * 90, "x" * 3000, "é", "ba"]
    got = langid.word_scores(words, lattice, logs)
    for w, g in zip(words, got):
        for lang in range(2):
            if len(w) < 10:
                want = sum(math.prod(probs[place[p], lang] for p in cut)
                           for cut in segmentations(b" " + w.encode()) if all(p in place for p in cut))
                assert abs(g[lang] - math.log(want)) < 1e-9
    # The plain and the logarithmic sums agree.
    arcs = lattice.arcs([(" " + w).encode() for w in words if len(w) < 10])
    assert np.allclose(langid._short_scores(arcs, logs), langid.forward(arcs, logs[arcs.piece])[
        arcs.lengths, np.arange(len(arcs.lengths))])
    assert np.isfinite(got).all()
    counts = langid.expected_counts(["b", "abca"], np.array([0.0, 2.0]), np.array([0, 1]), lattice, logs)
    want, total = np.zeros(len(pieces)), 0.0
    for cut in segmentations(b" abca"):
        if all(p in place for p in cut):
            share = math.prod(probs[place[p], 1] for p in cut)
            total += share
            for p in cut:
                want[place[p]] += 2.0 * share
    assert np.allclose(counts[:, 1], want / total) and not counts[:, 0].any()


def test_language_words():
    find = re.compile(langid.WORDS).findall
    for t in odd_texts(500, 8) + ["Plain ASCII, 12 words_and more\x1c\x7fx", None, "²Ⅷ a"]:
        assert langid.find_words(t) == find((t or "").lower())
    assert list(langid.chunks(["a" * n for n in (1, 500_000, 3, 40, 41)]))[-1][0].tolist() == [1]


def test_language_held_out_accuracy(spark):
    got = queries.op10_language(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "n_chars")
    rows = got.join(docs, "doc_id").filter("held_out and lang is not null and n_chars > 40").collect()
    assert len(rows) > 100
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edge_cases(spark):
    rows = [(1, "the old house", "en"), (2, "das alte haus", "de"), (3, None, "en"), (4, "12 -- 5", None),
            (None, "das haus", None), (5, "", "de"), (5, "", "de"), (6, "x" * 20_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn(
        "score", F.lit("mine"))
    got = langid.predict(docs, langid.fit(docs, PATH)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert by[3] == by[4] == [("und", 0.0)] and by[5] == [("und", 0.0)] * 2
    assert by[None][0][0] == "de" and by[1][0][0] == "en" and by[6][0][0] in ("de", "en")
    none = langid.predict(docs, langid.fit(docs.withColumn("lang", F.lit(None).cast("string")), PATH))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert langid.predict(docs.limit(0), langid.fit(docs.limit(0), PATH)).count() == 0


def auc(scores, labels):
    order = np.argsort(scores)
    rank = np.empty(len(scores))
    rank[order] = np.arange(len(scores))
    pos = np.array(labels) == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op3_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("toxic is not null")
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 500
    assert auc([r["score"] for r in rows], [r["toxic"] for r in rows]) > 0.97
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.95


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame(
        [(i, f"you are {'vile scum' if i % 3 == 0 else 'kind folk'} number{i}", "x") for i in range(60)]
        + [(100, None, "x"), (101, "", "x"), (None, "vile scum", "x"), (3, "again vile scum", "x")],
        "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)]
                                   + [(999, 1), (None, 1), (5, None), (1, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, "toxic", epochs=20)
    assert 0 < len(model.slots) < 100
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 64
    score = {r["doc_id"]: r["score"] for r in rows}
    assert score[None] > 0.5 > score[1] and score[100] == score[101] < 0.5
    assert all((score[i] > 0.5) == (i % 3 == 0) for i in range(60))
    one = toxicity.fit(docs, labels.filter("toxic = 0"), "toxic")
    assert all(r["score"] < 1e-9 for r in toxicity.score(docs, one).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_training_rows_follow_the_checksum(spark):
    import zlib
    got = spark.range(200).select("id", is_training_row(F.col("id")).alias("t")).collect()
    assert all(r["t"] == (zlib.crc32(str(r["id"]).encode()) % 5 != 0) for r in got)


def test_language_pieces_are_not_cut():
    pieces = langid.read_pieces(PATH)
    assert max(map(len, pieces)) > 8
    word = next(p for p in pieces if len(p) > 10 and p.isascii() and p.isalpha())
    arcs = langid.Lattice(pieces).arcs([word, b"ab"])
    whole = (arcs.word == 0) & (arcs.start == 0) & (arcs.end == len(word))
    assert [pieces[k] for k in arcs.piece[whole]] == [word]
