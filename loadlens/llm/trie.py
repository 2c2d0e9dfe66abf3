"""Prefix trie of conversations with roll-ups over subtrees by centroid decomposition.

A node is a distinct sequence of the first d turns; it is named by its depth and the smallest
conversation that starts with it. Prefixes are told apart by 128 bits that are combined turn by
turn, so no text is kept or compared twice. Long conversations are cut into chunks for all
running totals; a chunk is the most that one task orders.

Sums over subtrees: the parent-edge forest is split again and again at centroids. A node's
weight is the number of rebuilt turns at or below it, which a plain aggregation gives before
any tree is walked. Nodes that hold more than half of their component's weight form a path
down from its top, and the deepest of them is the centroid: what hangs below it and what is
left above it hold at most half each. The total of the centroid's part is added to all nodes of
that path; then the children of the centroid are the tops of components of their own, and what
is left above goes on without it. Rounds grow with the logarithm of the table. Components of
more than ``LOCAL`` turns are split by joins and aggregations over all of them at once; smaller
ones are finished by the same steps inside tasks, one bounded component at a time.

Cases: rows without a conversation id belong to none and are left out. Null roles and texts
are empty. Turns are ordered by number, null first, and by a hash of role and text where
numbers are equal, so equal rows repeat a turn. An empty table gives an empty table. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loadlens.llm.workers import map_rows, ship
from loadlens.session import write_and_read

ship(__name__)

CHUNK = 4096        # turns of a conversation that one task orders
LEVELS = 1024       # depths of a conversation in one row of the table of its nodes
LOCAL = 20_000      # rebuilt turns of a component that a task finishes


def numbered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
             role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, x1, x2, points) per turn: its number from 1 in its conversation, a hash of
    role and text in two longs, and the code points of the text.

    Rows are sorted over all tasks; a conversation may span several. A row's number is its
    place in its task and the rows of its conversation in the tasks before.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("x1"), F.xxhash64(F.lit(2), text, role).alias("x2"),
        F.length(text).cast("bigint").alias("points"))
    placed = write_and_read(rows.orderBy("conv", F.col("turn").asc_nulls_first(), "x1", "x2").select(
        "conv", "x1", "x2", "points", F.monotonically_increasing_id().alias("place")), "trie")
    part = F.shiftright("place", 33).alias("part")
    parts = placed.groupBy("conv", part).agg(F.min("place").alias("low"),
                                             F.count(F.lit(1)).alias("n"))
    ahead = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    return write_and_read(placed.withColumn("part", part).join(parts, ["conv", "part"]).select(
        "conv", (F.col("ahead") + F.col("place") - F.col("low") + 1).alias("pos"),
        "x1", "x2", "points"), "trie")


def grafted(rows: DataFrame, base: Column, take: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: the first ``take`` (at most ``most``) turns of the conversation
    ``base``, then those of the own turns that come after the first ``take``.

    ``base`` and ``take`` are columns over ``conv``. Returns the rows with ``size``, the turns
    of the rebuilt conversation, and all (conv, size), conversations without a turn too.
    """
    count = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    own = count.select("conv", "n", base.alias("base"), F.least(take, F.lit(most)).alias("take"))
    had = count.select(F.col("conv").alias("base"), F.col("n").alias("had"))
    plan = own.join(had, "base", "left").select(
        "conv", "base", "take", F.least("take", F.coalesce("had", F.lit(0))).alias("got"),
        F.greatest(F.col("n") - F.col("take"), F.lit(0)).alias("rest"))
    plan = write_and_read(plan.withColumn("size", F.col("got") + F.col("rest")), "trie")
    lent = rows.filter(F.col("pos") <= most).withColumnRenamed("conv", "base").join(
        plan.select("conv", "base", "got", "size"), "base").filter("pos <= got")
    kept = rows.join(plan.select("conv", "take", "got", "size"), "conv").filter(
        "pos > take").withColumn("pos", F.expr("pos - take + got"))
    cols = ["conv", "pos", "x1", "x2", "points", "size"]
    return lent.select(cols).unionByName(kept.select(cols)), plan.select("conv", "size")


def prefixes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, d, k1, k2, points, size): the prefix of each length of each conversation, the
    empty one too; k1 and k2 tell different prefixes of a length apart."""
    chunk = F.shiftright(F.col("pos") - 1, CHUNK.bit_length() - 1)
    e = rows.select("conv", "pos", "points", "size", chunk.alias("chunk"),
                    F.xxhash64("pos", "x1", "x2").alias("e1"),
                    F.xxhash64("pos", "x2", "x1").alias("e2"))
    inside = W.partitionBy("conv", "chunk").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    run = e.withColumns({k: F.bit_xor(k).over(inside) for k in ("e1", "e2")})
    before = W.partitionBy("conv").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = e.filter(F.col("size") > CHUNK).groupBy("conv", "chunk").agg(
        F.bit_xor("e1").alias("c1"), F.bit_xor("e2").alias("c2"))
    carry = carry.withColumns({k: F.bit_xor(k).over(before) for k in ("c1", "c2")}).filter(
        "chunk > 0")
    keyed = run.join(carry, ["conv", "chunk"], "left").select(
        "conv", F.col("pos").alias("d"),
        *[F.col(f"e{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0).cast("bigint"))).alias(f"k{i}")
          for i in (1, 2)], "points", "size")
    zero = F.lit(0).cast("bigint")
    root = convs.select("conv", zero.alias("d"), zero.alias("k1"), zero.alias("k2"),
                        zero.alias("points"), "size")
    return keyed.unionByName(root)


def trie(rows: DataFrame, convs: DataFrame, local: int = LOCAL) -> tuple[DataFrame, DataFrame]:
    """Nodes and ends of the trie of numbered turns (``grafted`` or with a column ``size``).

    Nodes: conv, d, parent, n_convs, n_children, n_leaves, saved. ``saved`` sums, over the
    subtree, the code points of a node's last text times its members but one. Ends: (conv, d,
    member) for each conversation, at the node it ends in. ``local`` bounds the rebuilt turns of
    a component that one task finishes.
    """
    paths = write_and_read(prefixes(rows, convs), "trie")
    groups = write_and_read(paths.groupBy("d", "k1", "k2").agg(
        F.min("conv").alias("rep"), F.count(F.lit(1)).alias("n_convs"),
        F.max("points").alias("points"),
        F.sum(F.col("size") - F.col("d") + 1).alias("w")), "trie")
    named = paths.join(groups.select("d", "k1", "k2", "rep"), ["d", "k1", "k2"]).select(
        "conv", "d", "rep", "size")
    levels = _levels(named)
    ends = levels.filter(F.col("last").isNotNull()).select(
        F.col("last").alias("conv"), F.col("size").alias("d"), F.col("conv").alias("member"))
    steps = levels.select("conv", F.posexplode(F.transform(
        "reps", lambda r, i: F.struct((F.col("low") + i).alias("d"), r.alias("rep"),
                                      F.get("reps", i - 1).alias("parent"), i.alias("i")))
    ).alias("at", "s")).filter((F.col("s.rep") == F.col("conv"))
                               & ((F.col("s.i") > 0) | (F.col("s.d") == 0)))
    parents = steps.select(F.col("s.d").alias("d"), F.col("s.rep").alias("rep"), "s.parent")
    nodes = groups.select("rep", "d", "n_convs", "points", "w").join(parents, ["rep", "d"])
    kids = parents.filter("parent is not null").groupBy(
        F.col("parent").alias("rep"), (F.col("d") - 1).alias("d")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(kids, ["rep", "d"], "left").select(
        "rep", "d", "parent", "n_convs", "w",
        F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("points")).alias("saving"))
    done = rolled_up(nodes, levels, local)
    return done.withColumnRenamed("rep", "conv"), ends


def _levels(named: DataFrame) -> DataFrame:
    """(conv, chunk, low, reps, size, last): the nodes of a conversation at ``LEVELS`` depths in
    a row and the one before, from depth ``low``; ``last`` is the node where it ends."""
    bits = LEVELS.bit_length() - 1
    own = F.shiftright("d", bits)
    chunk = F.explode(F.array_distinct(F.array(own, F.least(F.shiftright(F.col("d") + 1, bits),
                                                            F.shiftright("size", bits)))))
    got = named.select("conv", "size", "d", "rep", chunk.alias("chunk")).groupBy(
        "conv", "chunk").agg(F.max("size").alias("size"), F.min("d").alias("low"),
                             F.sort_array(F.collect_list(F.struct("d", "rep"))).alias("s"))
    return write_and_read(got.select(
        "conv", "chunk", "low", F.col("s.rep").alias("reps"), "size",
        F.when(F.shiftright("size", bits) == F.col("chunk"), F.element_at("s", -1)["rep"]
               ).alias("last")), "trie")


def rolled_up(nodes: DataFrame, levels: DataFrame, local: int) -> DataFrame:
    """Adds n_leaves and saved, summed over subtrees, to ``nodes`` (rep, d, parent, n_convs,
    n_children, saving, w); ``levels`` is the table of each conversation's nodes."""
    bits = LEVELS.bit_length() - 1
    zero = F.lit(0).cast("bigint")
    nodes = write_and_read(nodes, "trie")
    root = nodes.filter("d = 0").first()
    top = (root["rep"], root["w"]) if root else (None, 0)
    kind = dict(nodes.dtypes)["rep"]
    state = nodes.select(
        "rep", "d", "parent", "n_convs", "n_children", "saving", "w",
        F.lit(top[0]).cast(kind).alias("top"), zero.alias("top_d"),
        F.lit(top[1]).cast("bigint").alias("total"), zero.alias("n_leaves"), zero.alias("saved"))
    columns = state.columns
    small, settled = [], []
    while True:
        small.append(state.filter(F.col("total") <= local))
        open_ = state.filter(F.col("total") > local)
        if open_.isEmpty():
            break
        key = ["top", "top_d"]
        heavy = (F.col("w") * 2 > F.col("total"))
        centre = open_.filter(heavy).groupBy(*key).agg(
            F.max(F.struct("d", "rep", "w")).alias("c")).select(
            *key, F.col("c.d").alias("c_d"), F.col("c.rep").alias("c_rep"), F.col("c.w").alias("c_w"))
        look = levels.select(F.col("conv").alias("rep"), F.col("chunk").alias("look"), "low", "reps")
        below = open_.join(centre, key).withColumn(
            "look", F.when(F.col("d") > F.col("c_d"), F.shiftright(F.col("c_d") + 1, bits)))
        at = (F.col("c_d") + 1 - F.col("low")).cast("int")
        below = below.join(look, ["rep", "look"], "left").withColumn(
            "child", F.when(F.get("reps", at - 1) == F.col("c_rep"), F.get("reps", at))).drop(
            "look", "low", "reps")
        is_centre = (F.col("d") == F.col("c_d")) & (F.col("rep") == F.col("c_rep"))
        below = write_and_read(below.withColumn("is_centre", is_centre), "trie")
        part = below.filter("is_centre or child is not null").groupBy(*key).agg(
            F.sum((F.col("n_children") == 0).cast("bigint")).alias("t_leaves"),
            F.sum("saving").alias("t_saved"))
        tops = below.filter("child is not null").groupBy("child", "c_d").agg(
            F.max("w").alias("child_w"))
        under = F.col("child").isNotNull()
        moved = below.join(part, key).join(tops, ["child", "c_d"], "left").withColumn("heavy", heavy)
        moved = moved.select(
            "rep", "d", "parent", "n_convs", "n_children", "saving",
            F.when(F.col("heavy") & ~F.col("is_centre"), F.col("w") - F.col("c_w")
                   ).otherwise(F.col("w")).alias("w"),
            F.when(under, F.col("child")).otherwise(F.col("top")).alias("top"),
            F.when(under, F.col("c_d") + 1).otherwise(F.col("top_d")).alias("top_d"),
            F.when(under, F.col("child_w")).otherwise(F.col("total") - F.col("c_w")).alias("total"),
            *[(F.col(a) + F.when(F.col("heavy"), F.col(t)).otherwise(0)).alias(a)
              for a, t in (("n_leaves", "t_leaves"), ("saved", "t_saved"))], "is_centre")
        moved = write_and_read(moved, "trie")
        settled.append(moved.filter("is_centre").select(columns))
        state = moved.filter(~F.col("is_centre")).select(columns)
    done = _finished(_union(small))
    for part in settled:
        done = done.unionByName(part.select(done.columns))
    return done


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def local_totals(depth: list[int], above: list[int], weight: list[int], leaf: list[int],
                 saving: list[int], leaves: list[int], saved: list[int]) -> None:
    """Centroid decomposition of one component in memory. Nodes are in order of depth,
    ``above`` holds the number of the parent (-1 at the top); adds to ``leaves`` and ``saved``."""
    parts = [list(range(len(depth)))]
    child = [-1] * len(depth)
    while parts:
        nodes = parts.pop()
        total = weight[nodes[0]]
        path = [v for v in nodes if weight[v] * 2 > total]
        c = path[-1]
        pieces: dict[int, list[int]] = {}
        rest = []
        lost, t_leaves, t_saved = weight[c], leaf[c], saving[c]
        inside = {c}
        for v in nodes:
            if above[v] in inside and v != c:
                piece = v if above[v] == c else child[above[v]]
                child[v] = piece
                pieces.setdefault(piece, []).append(v)
                inside.add(v)
                t_leaves += leaf[v]
                t_saved += saving[v]
            elif v != c:
                rest.append(v)
        for v in path:
            leaves[v] += t_leaves
            saved[v] += t_saved
            if v != c:
                weight[v] -= lost
        parts.extend(pieces.values())
        if rest:
            parts.append(rest)


def _finished(state: DataFrame) -> DataFrame:
    """Finish components of bounded size, each inside one task."""
    dealt = state.repartition("top", "top_d").sortWithinPartitions("top", "top_d", "d", "rep")
    names = ["rep", "d", "parent", "n_convs", "n_children", "saving", "w", "n_leaves", "saved"]
    kinds = dict(state.dtypes)
    keep = ["rep", "d", "parent", "n_convs", "n_children", "n_leaves", "saved"]

    def solve(group: list[tuple]) -> Iterator[tuple]:
        rep, d, parent, n_convs, n_children, saving, w, leaves, saved = map(list, zip(*group))
        if len(group) == 1:
            leaves[0] += n_children[0] == 0
            saved[0] += saving[0]
        else:
            number = {(r, x): i for i, (r, x) in enumerate(zip(rep, d))}
            above = [number.get((p, x - 1), -1) for p, x in zip(parent, d)]
            local_totals(d, above, w, [int(k == 0) for k in n_children], saving, leaves, saved)
        yield from zip(rep, d, parent, n_convs, n_children, leaves, saved)

    def rows(batches: Iterator[dict]):
        held, of = [], None
        for b in batches:
            for key, row in zip(zip(b["top"], b["top_d"]), zip(*(b[c] for c in names))):
                if key != of:
                    if held:
                        yield from solve(held)
                    held, of = [], key
                held.append(row)
        if held:
            yield from solve(held)

    return map_rows(dealt.select("top", "top_d", *names),
                    ", ".join(f"{c} {kinds[c]}" for c in keep), rows)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(conv, d, ends_sha256): hash of the comma-joined ids of the conversations that end at a
    node, ascending. Ids stream through the hash in order, so a node may have any number."""
    dealt = ends.repartition("conv", "d").sortWithinPartitions("conv", "d", "member")
    kinds = dict(ends.dtypes)

    def rows(batches: Iterator[dict]):
        of, digest = None, None
        for b in batches:
            for conv, d, member in zip(b["conv"], b["d"], b["member"]):
                if (conv, d) != of:
                    if of:
                        yield *of, digest.hexdigest()
                    of, digest = (conv, d), hashlib.sha256(str(member).encode())
                else:
                    digest.update(b"," + str(member).encode())
        if of:
            yield *of, digest.hexdigest()

    return map_rows(dealt.select("conv", "d", "member"),
                    f"conv {kinds['conv']}, d {kinds['d']}, ends_sha256 string", rows)
