"""Set near-duplicates, periodic runs and the conversation trie against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadlens.llm import minhash, queries, runs, trie
from loadlens.llm.toxicity import WordHashes

SF = "/root/testdata/sf0.01"
DOC = "doc_id bigint, text string"


# --- near-duplicates by sets ---------------------------------------------------------------------

def naive_set(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in text.translate({c: " " for c in range(9, 14)}).split(" ") if w]
    return {" ".join(words[i:i + 2]) for i in range(len(words) - 1)} or set(words)


def naive_components(docs, percent=80):
    sets = [naive_set(t) for _, t in docs]
    label = list(range(len(docs)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                label[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(docs):
        if key is not None:
            r = find(i)
            least[r] = min(least.get(r, key), key)
    return sorted(((k, len(s), least.get(find(i)), k is not None and least[find(i)] == k)
                   for i, ((k, _), s) in enumerate(zip(docs, sets))), key=str)


def near(spark, docs, **kw):
    df = spark.createDataFrame(docs, DOC) if docs else spark.createDataFrame([], DOC)
    return sorted((tuple(r) for r in minhash.near_duplicates(df, **kw).collect()), key=str)


def family(rng, words, n):
    """Texts of one length that differ from a first one in a few to many words."""
    first = [rng.choice(words) for _ in range(rng.randrange(4, 90))]
    out = []
    for _ in range(n):
        t = list(rng.choice([first, out[-1] if out else first]))
        for _ in range(rng.randrange(0, max(2, len(t) // 12))):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append(t)
    return [" ".join(t) for t in out]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    texts = [t for _ in range(25) for t in family(rng, words, rng.randrange(1, 12))]
    texts += [None, "", " \t\n", "one", "ONE", "one two", "One\ttwo ", "two one", "a b c d e f"]
    docs = [(i, t) for i, t in enumerate(rng.sample(texts, len(texts)))]
    docs += [docs[3], docs[3], (None, docs[4][1]), (None, "alone here"), (-5, docs[9][1])]
    assert near(spark, docs) == naive_components(docs)
    assert near(spark, []) == []


def test_links_that_no_star_tests(spark):
    # All share one band of a single bin, so there is one bucket and one centre.
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    groups = [[rng.choice(words) for _ in range(40)] for _ in range(6)]
    docs = []
    for g in groups:
        for _ in range(4):
            t = list(g)
            t[rng.randrange(40)] = rng.choice(words)
            docs.append((len(docs), "same start " + " ".join(t)))
    real = minhash.bucket_keys
    minhash.bucket_keys = lambda sig, bands, factors: np.ones(1, np.uint64)
    try:
        got = near(spark, docs, bands=1, rows=1)
    finally:
        minhash.bucket_keys = real
    assert got == naive_components(docs)
    assert len({r[2] for r in got}) < len(docs)


def test_near_copies_have_few_different_tests(spark, monkeypatch):
    # One original and its copies with a word changed: most buckets hold the original.
    rng = random.Random(8)
    first = [f"w{i}" for i in range(60)]
    docs = [(0, " ".join(first))]
    for i in range(1, 150):
        t = list(first)
        t[rng.randrange(60)] = f"x{i}"
        docs.append((i, " ".join(t)))
    pairs, real = [], minhash.confirmed
    monkeypatch.setattr(minhash, "confirmed",
                        lambda p, *a: pairs.append(p.count()) or real(p, *a))
    assert near(spark, docs) == naive_components(docs)
    assert pairs[0] < 3 * len(docs)


def in_one_bucket(spark, monkeypatch, docs, worst_hub=False):
    """Result, and how many pairs each step confirms, if all share a bucket."""
    pairs, real, scores = [], minhash.confirmed, minhash._scores
    monkeypatch.setattr(minhash, "bucket_keys", lambda sig, bands, factors: np.ones(1, np.uint64))
    monkeypatch.setattr(minhash, "confirmed",
                        lambda p, *a: pairs.append(p.count()) or real(p, *a))
    if worst_hub:
        monkeypatch.setattr(minhash, "_scores", lambda t, li: scores(t, li).withColumn(
            "score", -F.col("score")))
    got = near(spark, docs, bands=1, rows=1)
    monkeypatch.undo()
    return got, pairs


@pytest.mark.parametrize("worst_hub", [False, True])
def test_far_copies_of_one_text_make_few_pairs(spark, monkeypatch, worst_hub):
    # Copies with few changes are one component; those with many are linked with none, but lack
    # the same words of the text as others do, and hold words that others hold.
    rng = random.Random(12)
    first = [f"w{i}" for i in range(75)]
    docs = [(0, " ".join(first))]
    for i in range(1, 240):
        t = list(first)
        for at in rng.sample(range(75), rng.randrange(1, 8) if i % 3 else rng.randrange(10, 18)):
            t[at] = f"x{rng.randrange(60)}"
        docs.append((i, " ".join(t)))
    got, pairs = in_one_bucket(spark, monkeypatch, docs, worst_hub)
    assert got == naive_components(docs)
    assert sum(r[3] for r in got) > 50
    assert pairs[-1] < len(docs)


def test_any_differences_to_any_hub_equal_brute_force(spark, monkeypatch):
    # Words changed, dropped, added and cut off, and no text that most of them come from.
    rng = random.Random(1)
    docs, n = [], 0
    for _ in range(3):
        first = [f"w{rng.randrange(90)}" for _ in range(rng.randrange(25, 60))]
        for _ in range(45):
            t = list(first if rng.random() < 0.7 or not docs else docs[-1][1].split())
            for _ in range(rng.randrange(1, 2 + len(t) // 7)):
                at = rng.randrange(len(t))
                t[at:at + 1] = rng.choice([[], [f"w{rng.randrange(12)}"], [f"x{rng.randrange(9)}"],
                                           [t[at], f"x{rng.randrange(9)}"]])
            t = t[:rng.randrange(len(t) * 3 // 4, len(t) + 1)] if rng.random() < 0.3 else t
            docs.append((n, " ".join(t + ["end"])))
            n += 1
    want = naive_components(docs)
    assert len({r[2] for r in want}) < len(docs)
    for worst_hub in (False, True):
        assert in_one_bucket(spark, monkeypatch, docs, worst_hub)[0] == want


def test_signatures_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(3)
    n = minhash.BANDS * minhash.ROWS
    for size in (5, 40, 3000):
        agree, want = [], []
        for _ in range(40):
            a = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)
            b = np.concatenate([a[size // 5:], rng.integers(0, 1 << 63, size // 5, np.uint64)])
            x, y = (minhash.signature(np.unique(v), n) for v in (a, b))
            agree.append(np.mean(x == y))
            want.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(agree) - np.mean(want)) < 0.05
    table = minhash._probes(np.arange(n), 0, n, minhash.PROBES)
    few = np.unique(rng.integers(0, 1 << 63, 3, dtype=np.uint64))
    assert np.array_equal(minhash.signature(few, n), minhash.signature(few, n, table))


def test_shingles_ignore_case_and_space_only():
    h = WordHashes()
    assert np.array_equal(minhash.shingles("A b\tC", h), minhash.shingles("a  B c\n", h))
    assert len(minhash.shingles("Ä ä", h)) == 1 and len(minhash.shingles("x x x", h)) == 1
    assert not np.array_equal(minhash.shingles("a b", h), minhash.shingles("b a", h))


def test_minhash_reads_two_columns_only(spark):
    docs = spark.range(6).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"),
                                 *[F.lit(1).alias(c) for c in ("k", "t", "n", "set", "node", "key")])
    assert {tuple(r) for r in minhash.near_duplicates(docs).collect()} == {
        (i, 2, 0, i == 0) for i in range(6)}


# --- periodic runs -------------------------------------------------------------------------------

def naive_runs(words, min_words=6, exponent=4):
    n, out = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_words, exponent * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e, q) for (s, e), q in out.items())


def some_words(rng):
    kind, n = rng.randrange(6), rng.randrange(90)
    if kind < 2:
        return [rng.randrange(2 + kind) for _ in range(n)]
    if kind == 2:
        p, ends = [[rng.randrange(4) for _ in range(rng.randrange(1, k))] for k in (12, 9)]
        return ends + (p * 12)[:n] + ends
    if kind == 3:
        return [7] * n
    if kind == 4:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b
    x = [0, 0, 0, 0, 0, 1] * rng.randrange(1, 7)
    return x * 2 + [3] + x


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        docs = [some_words(rng) for _ in range(rng.randrange(1, 7))]
        words = np.array(sum(docs, []), np.int64)
        starts = np.cumsum([0] + [len(d) for d in docs])[:-1]
        least, exponent = rng.choice([(6, 4), (8, 5), (11, 4), (6, 7)])
        got = [r for r in zip(*(a.tolist() for a in runs.find_runs(words, starts, least, exponent)))]
        assert got == sorted(got, key=lambda r: (r[0], r[2]))
        assert sorted(got) == sorted((s + o, e + o, q) for d, o in zip(docs, starts.tolist())
                                     for s, e, q in naive_runs(d, least, exponent))


def test_grammar_derives_the_words():
    rng = random.Random(2)
    for _ in range(100):
        docs = [d for d in (some_words(rng) for _ in range(4)) if d] or [[1]]
        words = np.array(sum(docs, []), np.int64)
        g = runs.repair(words, np.cumsum([0] + [len(d) for d in docs])[:-1])

        def derive(x):
            return [x] if x < g.n_words else derive(g.left[x - g.n_words]) + derive(
                g.right[x - g.n_words])

        assert sum((derive(x) for x in g.root), []) == words.tolist()
        pairs = list(zip(g.root.tolist(), g.root[1:].tolist()))
        at = np.cumsum([0] + [len(d) for d in docs]).tolist()
        inside = [p for p, a in zip(pairs, g.root_at[1:].tolist()) if a not in at]
        assert all(n == 1 or p[0] == p[1] for p in inside for n in [inside.count(p)])


def test_long_and_uniform_texts():
    n = 300_000
    assert [a.tolist() for a in runs.find_runs(np.zeros(n, np.int64), np.array([0]))] == [[0], [n], [1]]
    words = np.array(([0] * 100 + [1]) * 2000, np.int64)
    s, e, q = runs.find_runs(words, np.array([0]))
    assert len(s) == 2001 and (0, len(words), 101) in set(zip(s.tolist(), e.tolist(), q.tolist()))
    assert len(runs.repair(np.zeros(1 << 16, np.int64), np.array([0])).left) == 15


def test_periodic_runs_rows(spark):
    docs = spark.createDataFrame([
        (1, None, 0), (2, "", 0), (3, "x", 0), (4, "a b a b a b a b c", 0), (4, "a b a b a b a b c", 0),
        (None, "z\t z z\nz z z", 0), (5, "a a a a a", 0)], "doc_id bigint, text string, runs int")
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"])
                  for r in runs.periodic_runs(docs).collect()), key=str)
    assert got == sorted([
        (1, 0, [], ""), (2, 0, [], ""), (3, 1, [], "x"), (4, 9, [(0, 8, 2)], "a b c"),
        (4, 9, [(0, 8, 2)], "a b c"), (None, 6, [(0, 6, 1)], "z"), (5, 5, [], "a a a a a")], key=str)
    empty = spark.createDataFrame([], DOC)
    assert runs.periodic_runs(empty).collect() == []


def test_periodic_runs_query_on_planted_repeats(spark):
    rows = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    planted = 0
    for doc_id, text in texts:
        words = (text or "").split()
        if len(words) > 400:
            continue
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and words:
            a, m = h // 10 % len(words), h // 10 % 8
            p = 1 + (len(words) - a) // (3 + m)
            words = [words[i if i < a else a + (i - a) % p] for i in range(len(words))]
        found = naive_runs(words)
        planted += h % 10 == 0 and bool(found)
        r = rows[doc_id]
        assert r["n_runs"] == len(found)
        lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in sorted(found, key=lambda x: (x[0], x[2])))
        assert r["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        gone = {i for s, e, q in found for i in range(s + q, e)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        assert r["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
        if found:
            s, e, q = min(found, key=lambda x: (x[0] - x[1], x[0], x[2]))
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (
                s, e - s, q, 1000 * (e - s) // q)
    assert planted > 20


# --- conversation trie ---------------------------------------------------------------------------

def naive_trie(turns):
    """Nodes of conversations given as {id: [(role, text), ...]}."""
    members = {}
    for c, t in turns.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    out = []
    for path, ids in members.items():
        under = [p for p in members if p[:len(path)] == path]
        kids = [p for p in under if len(p) == len(path) + 1]
        ends = sorted(c for c in ids if len(turns[c]) == len(path))
        out.append((
            min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), len(kids),
            sum(not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in members) for p in under),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in under if p),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def rebuilt(raw):
    by = {}
    for c, turn, role, text in raw:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in by.items()}
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + t[h:]
    return out


def nodes_of(spark, raw, graft=True, local=trie.LOCAL):
    df = spark.createDataFrame(raw, "conv_id bigint, turn bigint, role string, text string")
    df = df.withColumns({"d": F.lit(1), "conv": F.lit("x"), "pos": F.lit(2)})
    take = F.crc32(F.col("conv").cast("string").cast("binary")) % 6 if graft else F.lit(0)
    rows, convs = trie.grafted(trie.numbered(df), F.col("conv") - F.col("conv") % 100, take, 5)
    nodes, ends = trie.trie(rows, convs, local)
    joined = nodes.join(trie.ends_digests(ends), ["conv", "d"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return sorted(((r["conv"], r["d"], r["parent"], r["n_convs"], r["n_children"], r["n_leaves"],
                    r["saved"], r["ends_sha256"] or none) for r in joined.collect()), key=str)


def some_turns(rng, n, longest=7):
    raw = []
    for c in rng.sample(range(400), n):
        for turn in range(rng.randrange(1, longest)):
            raw.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ccc"])))
    return raw


def test_trie_equals_brute_force(spark):
    rng = random.Random(7)
    raw = some_turns(rng, 60)
    raw += [(None, 0, "user", "lost"), (401, None, None, None), (401, 0, "user", "é😀"),
            (500, 3, "user", "late"), (502, None, "user", "null first"), (502, 0, "user", "x")]
    raw += [raw[5], raw[5]]
    want = naive_trie(rebuilt(raw))
    assert nodes_of(spark, raw) == want
    # Components split by joins, down to single nodes, give the same sums.
    assert nodes_of(spark, raw, local=12) == want


def test_trie_without_turns(spark):
    assert nodes_of(spark, []) == []
    # 1..9 have one turn that the rebuilt conversation drops where h > 0: members of the root.
    raw = [(c, 0, "user", "only") for c in range(1, 10)]
    assert nodes_of(spark, raw) == naive_trie(rebuilt(raw))


def test_long_conversations_are_cut(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 4)
    monkeypatch.setattr(trie, "LEVELS", 8)
    rng = random.Random(9)
    base = [("user", rng.choice("ab")) for _ in range(70)]
    raw = []
    for c, n, change in ((1, 70, None), (2, 70, None), (3, 40, 30), (4, 70, 63), (5, 8, None), (6, 16, 15)):
        t = [(r, "zz" if i == change else x) for i, (r, x) in enumerate(base[:n])]
        raw += [(c, i, *x) for i, x in enumerate(t)]
    turns = {}
    for c, _, r, t in raw:
        turns.setdefault(c, []).append((r, t))
    want = naive_trie(turns)
    assert nodes_of(spark, raw, graft=False) == want
    assert nodes_of(spark, raw, graft=False, local=30) == want


def test_local_totals_on_random_trees():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randrange(1, 60)
        above = [-1] + [rng.randrange(max(0, i - rng.choice([1, 3, 60])), i) for i in range(1, n)]
        depth = [0] * n
        for i in range(1, n):
            depth[i] = depth[above[i]] + 1
        order = sorted(range(n), key=depth.__getitem__)
        number = {v: i for i, v in enumerate(order)}
        above = [number.get(above[v], -1) for v in order]
        own = [rng.randrange(1, 5) for _ in range(n)]
        value = [rng.randrange(9) for _ in range(n)]
        weight, want = list(own), list(value)
        for v in range(n - 1, 0, -1):
            weight[above[v]] += weight[v]
            want[above[v]] += want[v]
        leaves, saved = [0] * n, [0] * n
        trie.local_totals([0] * n, above, weight, [1] * n, value, leaves, saved)
        assert saved == want


def test_fragmented_groups_equal_brute_force(spark):
    """Chains of edits around an original: links, near links and outsiders in one cluster."""
    for seed in (1, 2, 3):
        rng = random.Random(seed)
        base = [f"b{i}" for i in range(70)]
        pool = [f"p{i}" for i in range(30)]
        texts = [base]
        for _ in range(90):
            t = list(rng.choice(texts if rng.random() < 0.6 else [base]))
            for _ in range(rng.randrange(1, 9)):
                at = rng.randrange(len(t))
                t[at:at + rng.choice([0, 1, 1, 1, 2])] = [rng.choice(pool)]
            texts.append(t)
        docs = [(i, " ".join(t)) for i, t in enumerate(rng.sample(texts, len(texts)))]
        want = naive_components(docs)
        assert 3 < len({r[2] for r in want}) < 80
        assert near(spark, docs) == want


def test_copies_that_only_their_original_links(spark):
    # Copies differ from each other by too much, and from the original by little.
    rng = random.Random(6)
    base = [f"b{i}" for i in range(60)]
    docs = [(1000, " ".join(base))]
    for i in range(40):
        t = list(base)
        for at in rng.sample(range(0, 60, 3), 2):
            t[at] = f"c{i}x{at}"
        docs.append((i, " ".join(t)))
    got = near(spark, docs)
    assert got == naive_components(docs) and {r[2] for r in got} == {0}


def test_scores_count_the_ends_of_pairs_without_doubling_rows(spark):
    tested = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (4, 5)], "a bigint, b bigint")
    links = spark.createDataFrame([(1, 2), (1, 3)], "a bigint, b bigint")
    out = minhash._scores(tested, links)
    assert {r.node: r.score for r in out.collect()} == {1: 2.0, 2: 0.5, 3: 0.5, 4: 0.0, 5: 0.0}
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
