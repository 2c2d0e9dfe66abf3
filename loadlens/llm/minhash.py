"""MinHash near-duplicates: one permutation, optimal densification, banded buckets, stars.

A document is the set of its word shingles. One hash of a shingle gives its bin and its value,
and a bin keeps its smallest value, so a signature costs one hash a shingle. An empty bin takes
the value of a filled one that its own sequence of random bins meets first; two sets then agree
in a bin with the probability of their similarity, however small they are. A band of the
signature names a bucket; at a similarity of 0.8 two sets share none of 56 buckets of seven
bins in one of 500,000 pairs.

Documents with equal sets are one class before anything else, so copies never multiply. In a
bucket every class is paired with one centre and no other: candidate edges are stars. The centre
is the member whose buckets hold the most classes, so the buckets of a group of near copies agree
on one (the original, mostly) and a class has few different tests, not one for each bucket. Edges
are confirmed on the full sets, and links become components.

Buckets that their star leaves in several components are open. Open buckets that meet form
clusters, and each cluster gets one hub B, the member whose tests were links most often (the
original among its copies), which is compared with all of the cluster. Every member is then
known by its difference to the set C of the elements that most of the cluster hold, X ^ C, and the
member that is closest to C is compared with all of the cluster too. Two members X and Y that are
still in different components can be linked only if their differences have enough in common: they
differ in |X ^ C| + |Y ^ C| - 2 common elements, and linked sets may differ in a ninth of
|X| + |Y| at most (at 80 percent). Elements of C that both lack are few kinds and common by
chance; mostly they cannot suffice, and the pair must have elements beside C in common, which are
rare. So only the rarest of these, as many as must hold a common one, are joined; what they bring
together is confirmed on the full sets. No link inside a bucket is lost for the choice of centres,
and pairs inside one component, or pairs that only have the common text of the cluster in common,
are never made.

Cases: null and empty texts, and texts of white space only, have the empty set and are linked
with nothing. Null ids stay in the result with ``kept`` false; a component is named by its
smallest id that is not null (null if there is none). Repeated rows are returned as often as
they come. Only the id and text columns are read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loadlens.llm.components import components
from loadlens.llm.toxicity import WordHashes
from loadlens.llm.workers import map_rows, mix, ship
from loadlens.session import write_and_read

ship(__name__)

BANDS, ROWS = 56, 7
PROBES = 32
REMEMBERED = 50_000


class Hashes(WordHashes):
    """Word hashes of a task; few are remembered, as every task of a worker has its own."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        return super().__missing__(word)


def shingles(text: str | None, hashes: WordHashes, width: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words are one shingle."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    size = min(width, len(h))
    s = mix(h[:len(h) - size + 1] + np.uint64(size))
    for i in range(1, size):
        s = mix(s + h[i:len(h) - size + 1 + i])
    return np.unique(s)


def _probes(bins: np.ndarray, first: int, n: int, count: int) -> np.ndarray:
    """The next ``count`` bins that each of ``bins`` asks, from its ``first`` one on."""
    at = bins.astype(np.uint64)[:, None] << np.uint64(32) | np.arange(first, first + count,
                                                                    dtype=np.uint64)
    return (mix(at + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)


def signature(values: np.ndarray, n: int, table: np.ndarray | None = None) -> np.ndarray:
    """Smallest value per bin of sorted distinct ``values``, empty bins densified; ``table``
    may hold the first probes of all bins."""
    bins = ((values >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(bins[1:] != bins[:-1]) + 1])
    out = np.zeros(n, np.uint64)
    out[bins[first]] = values[first]
    filled = np.zeros(n, bool)
    filled[bins[first]] = True
    empty = np.flatnonzero(~filled)
    if len(first) == 1:
        out[:] = values[first[0]]
        return out
    asked = 0
    while len(empty):
        if asked == 0 and table is not None:
            ask = table[empty]
        else:
            ask = _probes(empty, asked, n, PROBES)
        hit = filled[ask]
        met = hit.any(axis=1)
        done = empty[met]
        out[done] = out[ask[met, hit[met].argmax(axis=1)]]
        empty = empty[~met]
        asked += PROBES
    return out


def bucket_keys(sig: np.ndarray, bands: int, factors: np.ndarray) -> np.ndarray:
    """One key per band, different for equal bins of different bands."""
    rows = sig.reshape(bands, -1)
    return mix((rows * factors).sum(axis=1, dtype=np.uint64)
               + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def signed_sets(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int,
                rows: int) -> DataFrame:
    """(k, n, set, bands) per row: id and text hash, size and digest of the set, bucket keys."""
    keyed = _keyed(docs, id_col, text_col)
    n = bands * rows

    def made(batches: Iterator[dict]):
        hashes = Hashes()
        table = _probes(np.arange(n), 0, n, PROBES)
        factors = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        for b in batches:
            for k, t in zip(b["k"], b["t"]):
                u = shingles(t, hashes, width)
                if not len(u):
                    yield k, 0, None, None
                    continue
                keys = bucket_keys(signature(u, n, table), bands, factors)
                yield k, len(u), xxhash.xxh3_128_digest(u.tobytes()), keys.view(np.int64)

    return map_rows(keyed, f"k {dict(keyed.dtypes)['k']}, n bigint, set binary, "
                           "bands array<bigint>", made, flush=1024)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")
                                ).alias("k"), F.col(text_col).alias("t"))


def _of_like_size(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that the sizes of their sets alone do not exclude."""
    sizes = texts.select("node", "n")
    sized = pairs.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(
        sizes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    return write_and_read(sized.filter(
        F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b"), "minhash")


def _compared(pairs: DataFrame, texts: DataFrame, width: int, schema: str, row) -> DataFrame:
    """``row(a, b, set of a, set of b)`` for each pair whose answer is not None, as ``schema``."""
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b").join(
        texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a").select(
        "a", "b", "ta", "tb")

    def compare(batches: Iterator[dict]):
        hashes = Hashes()
        of, mine = None, None
        for batch in batches:
            for a, b, ta, tb in zip(*(batch[c] for c in ("a", "b", "ta", "tb"))):
                if a != of:
                    of, mine = a, shingles(ta, hashes, width)
                found = row(a, b, mine, shingles(tb, hashes, width))
                if found is not None:
                    yield found

    return write_and_read(map_rows(both, schema, compare), "minhash")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets, of ``texts`` (node, n, t), are similar enough."""

    def row(a, b, x, y):
        common = len(np.intersect1d(x, y, assume_unique=True))
        return (a, b) if 100 * common >= percent * (len(x) + len(y) - common) else None

    return _compared(pairs, texts, width, "a bigint, b bigint", row)


def differences(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(hub, node, n, linked, less, more) for pairs (a = hub, b): the elements that only the hub
    holds and those that only the node holds."""

    def row(a, b, x, y):
        less = np.setdiff1d(x, y, assume_unique=True)
        more = np.setdiff1d(y, x, assume_unique=True)
        linked = 100 * (len(x) - len(less)) >= percent * (len(x) + len(more))
        return a, b, len(y), linked, less.view(np.int64), more.view(np.int64)

    return _compared(pairs, texts, width, "hub bigint, node bigint, n bigint, linked boolean, "
                                          "less array<bigint>, more array<bigint>", row)


def _texts(members: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str,
           text_col: str) -> DataFrame:
    """(node, n, t): one text of each class that shares a bucket."""
    asked = members.select("node").distinct().join(classes.select("node", "n", "one"), "node")
    asked = asked.select("node", "n", F.col("one.id").alias("own_id"), F.col("one.h").alias("own_h"))
    found = _keyed(docs, id_col, text_col).join(
        asked, (F.col("k.h") == F.col("own_h")) & F.col("k.id").eqNullSafe(F.col("own_id")))
    return write_and_read(found.groupBy("node").agg(
        F.min("n").alias("n"), F.any_value("t").alias("t")), "minhash")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    width: int = 2, percent: int = 80, bands: int = BANDS, rows: int = ROWS
                    ) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row: documents whose sets have at least
    ``percent`` of their union in common are linked."""
    own = write_and_read(signed_sets(docs, id_col, text_col, width, bands, rows), "minhash")
    classes = write_and_read(own.filter("n > 0").groupBy("set").agg(
        F.min("k").alias("one"), F.min("k.id").alias("least"), F.min("n").alias("n"),
        F.any_value("bands").alias("bands")).withColumn(
        "node", F.monotonically_increasing_id()), "minhash")
    members = _members(classes)
    texts = _texts(members, classes, docs, id_col, text_col)
    tested = write_and_read(_pairs(members.filter("node <> centre"), "node", "centre"), "minhash")
    links = confirmed(_of_like_size(tested, texts, percent), texts, width, percent)
    roots = _merged(classes.select("node", F.col("node").alias("root")), links)
    clusters = _clusters(members, roots, tested, links)
    if not clusters.isEmpty():
        spokes = clusters.select(F.col("hub").alias("a"), F.col("node").alias("b"))
        known = differences(spokes, texts, width, percent)
        roots = _merged(roots, known.filter("linked").select(F.col("hub").alias("a"),
                                                             F.col("node").alias("b")))
        known = _centred(known, roots, percent)
        apart = _placed(known, roots).filter("outside and centre <> hub")
        roots = _merged(roots, confirmed(_pairs(apart, "node", "centre"), texts, width, percent))
        rest = write_and_read(_between(known, roots, percent), "minhash")
        if not rest.isEmpty():
            roots = _merged(roots, confirmed(rest, texts, width, percent))
    named = classes.select("node", "set", "least").join(roots, "node")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select("set", "component_id")
    some = own.filter("n > 0").join(named, "set").select("k", "n", "component_id")
    none = own.filter("n = 0").select("k", "n", F.col("k.id").alias("component_id"))
    return some.unionByName(none).select(
        F.col("k.id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("k.id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _members(classes: DataFrame) -> DataFrame:
    """(key, node, size, centre): the classes of every bucket that holds more than one, and the
    one with which the others are tested."""
    rows = classes.select("node", F.explode("bands").alias("key"))
    size = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    rows = write_and_read(rows.join(size, "key").select("key", "node", "size"), "minhash")
    weight = rows.groupBy("node").agg(F.sum("size").alias("weight"))
    centre = rows.join(weight, "node").groupBy("key").agg(
        F.max(F.struct("weight", "node")).alias("m"))
    return write_and_read(rows.join(centre, "key").select(
        "key", "node", "size", F.col("m.node").alias("centre")), "minhash")


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after the components that new links connect have become one."""
    over = links.join(roots.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(
        roots.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
    found = components(over.select(F.col("x").alias("a"), F.col("y").alias("b")))
    found = found.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return write_and_read(roots.join(found, "root", "left").select(
        "node", F.coalesce("top", "root").alias("root")), "minhash")


def _clusters(members: DataFrame, roots: DataFrame, tested: DataFrame,
              links: DataFrame) -> DataFrame:
    """(node, hub) for the members of buckets that lie in several components; members of
    buckets that meet have one hub."""
    placed = members.filter("size > 2").join(roots, "node")
    several = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")
                                        ).filter("low <> high").select("key")
    open_ = write_and_read(placed.join(several, "key").select("key", "node"), "minhash")
    first = open_.groupBy("key").agg(F.min("node").alias("b"))
    met = components(open_.join(first, "key").select(F.col("node").alias("a"), "b"))
    scored = write_and_read(met.join(_scores(tested, links), "node", "left").select(
        "node", "root", F.coalesce("score", F.lit(0.0)).alias("score")), "minhash")
    best = scored.groupBy("root").agg(F.max(F.struct("score", "node")).alias("m"))
    return write_and_read(scored.join(best, "root").select("node", F.col("m.node").alias("hub")),
                          "minhash")


def _scores(tested: DataFrame, links: DataFrame) -> DataFrame:
    """(node, score): links of a node times the share of its tests that they are."""
    # Each end is counted for itself: pairs are aggregated as they are read, not doubled before.
    parts = [df.groupBy(F.col(end).alias("node")).agg(
        F.count(F.lit(1)).alias("n")).select("node", F.lit(kind).alias("kind"), "n")
        for df, kind in ((tested, "tested"), (links, "linked")) for end in ("a", "b")]
    n = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))),
                                F.lit(0))
    return functools.reduce(DataFrame.unionByName, parts).groupBy("node").agg(
        (F.pow(n("linked"), F.lit(2)) / n("tested")).alias("score"))


def _share(percent: int) -> float:
    """Linked sets differ in this share of the sum of their sizes at most."""
    return (100 - percent) / (100 + percent)


def _centred(known: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(hub, node, n, less, more, excess, centre) for the clusters that lie in several
    components: what a member lacks of the elements that more than half of its cluster hold, and
    what it holds beside them, in place of its differences to the hub.

    ``excess`` is the size of that difference less the share of ``n`` by which linked sets may
    differ; ``centre`` is the member with the least. Two members whose excesses add up to no more
    than 0 are linked with each other, and so is each of them with the centre.
    """
    own = roots.select("node", "root")
    several = known.join(own, "node").groupBy("hub").agg(
        F.min("root").alias("low"), F.max("root").alias("high"),
        F.count(F.lit(1)).alias("members")).filter("low <> high").select("hub", "members")
    known = write_and_read(known.join(several, "hub"), "minhash")
    cells = known.select("hub", "members", F.inline(_elements()))
    most = cells.groupBy("hub", "members", "x", "added").agg(F.count(F.lit(1)).alias("df")).filter(
        "2 * df > members")
    turned = most.groupBy("hub").agg(F.collect_list(F.when(~F.col("added"), F.col("x"))).alias("lost"),
                                     F.collect_list(F.when(F.col("added"), F.col("x"))).alias("won"))
    none = F.array().cast("array<bigint>")
    rows = known.join(turned, "hub", "left").withColumns(
        {c: F.coalesce(c, none) for c in ("lost", "won")})
    rows = rows.select(
        "hub", "node", "n",
        F.array_union(F.array_except("less", "lost"), F.array_except("won", "more")).alias("less"),
        F.array_union(F.array_except("more", "won"), F.array_except("lost", "less")).alias("more"))
    rows = write_and_read(rows.withColumn(
        "excess", F.size("less") + F.size("more") - _share(percent) * F.col("n")), "minhash")
    centre = rows.groupBy("hub").agg(F.min(F.struct("excess", "node")).alias("m"))
    return rows.join(centre.select("hub", F.col("m.node").alias("centre")), "hub")


def _elements() -> Column:
    """An array of (x, added) for the elements of ``more`` and ``less``."""
    of = lambda c, added: F.transform(c, lambda x: F.struct(
        x.alias("x"), F.lit(added).alias("added")))
    return F.concat(of("more", True), of("less", False))


def _placed(known: DataFrame, roots: DataFrame) -> DataFrame:
    """``known`` with the root of each node and whether it lies outside its centre's component."""
    own = roots.select("node", "root")
    return known.join(own, "node").join(own.select(
        F.col("node").alias("centre"), F.col("root").alias("centre_root")), "centre").withColumn(
        "outside", F.col("root") != F.col("centre_root"))


def _between(known: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one cluster in different components whose differences can have
    enough in common.

    Linked sets X and Y have ``(excess of X + excess of Y) / 2`` elements of their differences in
    common, and X has ``size - share * (|X| + |Y|)`` at least, where |Y| is at most 100 / percent
    |X|. What is not among the elements that both lack is among those that both hold beside the
    cluster's: that many less the fewest that either lacks. Pairs that must have such elements are
    sought by them alone, the others by all elements. What a set must have in common with any
    partner follows from the least bounds of the cluster; a set in the centre's component has
    partners outside it only.
    Of two sets with c common elements both hold one among their first size - c + 1, in any
    order that all sets follow; here the rarest come first. A pair that meets at some element is
    made only if the elements before and after it can be as many as that pair must have.
    """
    share, n = _share(percent), F.col("n")
    cells = write_and_read(_placed(known, roots).select(
        "hub", "node", "root", "n", "outside", (F.col("excess") / 2).alias("half"),
        (F.size("less") + F.size("more") - share * n * (1 + 100 / percent)).alias("far"),
        F.inline(_elements())), "minhash")
    shared = cells.groupBy("hub", "x").agg(F.count(F.lit(1)).alias("df"),
                                           F.count_if("outside").alias("out")).filter(
        "df > 1 and out > 0")
    # ``held`` are the elements that may bring something together, ``held_more`` the added ones.
    mine = W.partitionBy("hub", "node")
    order = mine.orderBy("df", "x")
    seen = write_and_read(cells.join(shared, ["hub", "x"]).withColumns({
        "held": F.count(F.lit(1)).over(mine), "held_more": F.count_if("added").over(mine),
        "at": F.row_number().over(order),
        "at_more": F.count_if("added").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)),
    }).withColumn("held_less", F.col("held") - F.col("held_more")), "minhash")
    half, beside = F.col("half"), F.col("half") - F.col("held_less")
    least = seen.groupBy("hub").agg(
        F.min(half).alias("half_any"), F.min(beside).alias("beside_any"),
        F.min(F.when(F.col("outside"), half)).alias("half_out"),
        F.min(F.when(F.col("outside"), beside)).alias("beside_out"))
    of = lambda c: F.when(F.col("outside"), F.col(f"{c}_any")).otherwise(F.col(f"{c}_out"))
    # A little less than the bounds, against rounding.
    whole = lambda c: F.greatest(F.lit(1), F.ceil(c - 1e-6))
    need = seen.join(least, "hub").withColumns({
        "need": whole(F.greatest(half + of("half"), F.col("far"))),
        "must_more": F.greatest(beside + of("half"), half + of("beside")) - 1e-6}).withColumn(
        "need_more", whole(F.col("must_more"))).filter("held >= need and held_more >= must_more")
    need = write_and_read(need.filter(
        "added and at_more + need_more <= held_more + 1 or must_more <= 0 and at + need <= held + 1"
        ).select("hub", "x", "node", "root", "n", "outside", "half", "added", "held", "held_more",
                 "held_less", "at", "at_more", "need", "need_more", "must_more"), "minhash")
    must = half + F.col("o_half") - 1e-6
    must_more = must - F.least("held_less", "o_held_less")
    by_more = _meeting(need.filter("added and at_more + need_more <= held_more + 1"), "at_more",
                       "held_more", must_more, must_more > 0, percent)
    by_all = _meeting(need.filter("must_more <= 0 and at + need <= held + 1"), "at", "held", must,
                      must_more <= 0, percent)
    return _pairs(by_more.unionByName(by_all), "node", "o_node")


def _meeting(rows: DataFrame, at: str, held: str, must: Column, kind: Column, percent: int
             ) -> DataFrame:
    """(node, o_node) of a ``kind`` that meet at an element, the ``at``-th of ``held``, and can
    have as many in common as they ``must``."""
    cols = ["node", "root", "n", "half", "held_less", at, held]
    outer = rows.filter("outside").select("hub", "x", *[F.col(c).alias(f"o_{c}") for c in cols])
    most = F.least(at, f"o_{at}") + F.least(F.col(held) - F.col(at),
                                            F.col(f"o_{held}") - F.col(f"o_{at}"))
    return rows.select("hub", "x", *cols).join(outer, ["hub", "x"]).filter(
        (F.col("root") != F.col("o_root")) & kind & (most >= must)
        & (F.least("n", "o_n") * 100 >= F.greatest("n", "o_n") * percent)).select("node", "o_node")
