"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most three bits have at most two differing bits outside
some third of the 64 bits: the third is masked, and every fingerprint emits all variants of
the remaining bits within half the remaining radius, which is one bit. Such a pair then has
a variant in common for at least one third. This needs 131 rows per distinct fingerprint
where balls of half the full radius (two bits, rounded up) need 2,081.

The variants are shuffled once. Fingerprints that share one are compared where they meet; a
meeting place leaves at most one link per member, never all pairs: up to 512 members are
compared directly, and more by looking up, for each member, the masked bits that a linked
member can have. Components come from the links between distinct fingerprints, so exact
copies never multiply, however many there are.

Cases: null and empty texts, and texts of white space only, have fingerprint zero and are
linked like any other. Null ids stay in the result; the component is named by the smallest
id that is not null (null if there is none). Repeated rows are returned as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from loadlens.llm.components import components
from loadlens.llm.workers import map_rows, ship
from loadlens.session import write_and_read

ship(__name__)

# Bits of each third, lowest first; the radius is three.
THIRDS = ((0, 21), (21, 42), (42, 64))
RADIUS = 3
DIRECT = 512
BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit fingerprint: a bit is set if over half the shingle hashes set it."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) <= width:
        cuts = [(0, len(line))]
    else:
        cuts = list(zip(starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist()))
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(cuts), BLOCK):
        part = cuts[at:at + BLOCK]
        h = np.fromiter([digest(line[a:b], 42) for a, b in part], np.uint64, len(part))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    value = np.packbits(counts * 2 > len(cuts), bitorder="little").view(np.uint64)[0]
    return int(value)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) per row; fp holds the 64 bits as a signed long."""

    def rows(batches: Iterator[dict]):
        for b in batches:
            for i, t in zip(b["k"], b["t"]):
                f = fingerprint(t)
                yield i, f - (1 << 64) if f >> 63 else f

    kind = docs.select(id_col).dtypes[0][1]
    return map_rows(docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")),
                    f"`{id_col}` {kind}, fp bigint", rows)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _variants(fps: DataFrame) -> DataFrame:
    """Rows (third, key, fp): the bits outside the third, and those with one bit turned."""
    cells = []
    for third, (low, high) in enumerate(THIRDS):
        keep = _signed(((1 << 64) - 1) ^ ((1 << high) - (1 << low)))
        flips = [0] + [1 << b for b in range(64) if not low <= b < high]
        cells += [(third, keep, _signed(f)) for f in flips]
    table = "array(" + ",".join(
        f"struct({t}Y as t, {_long(k)} as k, {_long(f)} as f)" for t, k, f in cells) + ")"
    return fps.select("fp", F.explode(F.expr(table)).alias("v")).select(
        F.col("v.t").alias("third"),
        F.col("fp").bitwiseAND(F.col("v.k")).bitwiseXOR(F.col("v.f")).alias("key"), "fp")


def _long(x: int) -> str:
    return f"{x}L" if x > -(1 << 63) else "(-9223372036854775807L - 1L)"


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member reachable over the links a-b, for members 0..n-1."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def linked(fps: np.ndarray, third: int, key: np.uint64) -> np.ndarray:
    """Labels of distinct fingerprints that meet at one variant: members with the same label
    are connected by links within the radius.

    With more than ``DIRECT`` members: outside the third two members differ in at most two
    bits. If their masked bits are equal or differ in one bit they are linked. Members whose
    remaining bits equal the key may differ in up to three masked bits. Other pairs within
    the radius have one of these forms for another third.
    """
    n = len(fps)
    if n <= DIRECT:
        a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= RADIUS, 1))
        return _labels(n, a, b)
    low, high = THIRDS[third]
    bits = [np.uint64(1) << np.uint64(x) for x in range(low, high)]
    mask = np.uint64((1 << high) - (1 << low))
    inner = fps & mask
    values, first, back = np.unique(inner, return_index=True, return_inverse=True)
    links = [(np.arange(n), first[back])]

    def look(among: np.ndarray, flips: np.ndarray, members: np.ndarray) -> None:
        for f in flips:
            want = among ^ f
            at = np.minimum(np.searchsorted(among, want), len(among) - 1)
            ok = among[at] == want
            links.append((members[ok], members[at[ok]]))

    look(values, np.array(bits, np.uint64), first)
    same = np.flatnonzero((fps & ~mask) == key)
    if len(same) > 1:
        order = same[np.argsort(inner[same])]
        two = [x | y for i, x in enumerate(bits) for y in bits[i + 1:]]
        three = [p | z for p in two for z in bits if z > p and not z & p]
        look(inner[order], np.array(two + three, np.uint64), order)
    return _labels(n, np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links]))


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` exactly as all pairs within
    the radius would."""
    near = _variants(fps).repartition("third", "key").sortWithinPartitions("third", "key", "fp")

    def rows(batches: Iterator[dict]):
        held = (np.zeros(0, np.int8), np.zeros(0, np.int64), np.zeros(0, np.int64))
        for b in batches:
            t, k, f = (np.concatenate([h, b.column(c).to_numpy()])
                       for h, c in zip(held, ("third", "key", "fp")))
            cut = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            last = int(cut[-1]) if len(cut) else 0
            yield from _meet(t[:last], k[:last], f[:last], cut[:-1])
            held = t[last:], k[last:], f[last:]
        yield from _meet(*held, np.zeros(0, np.int64))

    return map_rows(near, "a bigint, b bigint", rows, arrow_in=True).distinct()


def _meet(t: np.ndarray, k: np.ndarray, f: np.ndarray, cut: np.ndarray) -> Iterator[tuple]:
    starts = np.concatenate([[0], cut]).astype(np.int64)
    sizes = np.diff(np.concatenate([starts, [len(f)]]))
    u = f.view(np.uint64)
    two = starts[sizes == 2]
    two = two[np.bitwise_count(u[two] ^ u[two + 1]) <= RADIUS]
    yield from set(zip(f[two].tolist(), f[two + 1].tolist()))
    for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        group = f[at:at + n]
        label = linked(u[at:at + n], int(t[at]), k[at:at + 1].view(np.uint64)[0])
        for i in np.flatnonzero(label != np.arange(n)).tolist():
            yield int(group[i]), int(group[label[i]])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) per row: the component is the smallest id reachable by links."""
    own = write_and_read(fingerprints(docs, id_col, text_col), "simhash")
    return own.join(fingerprint_components(own, id_col), "fp").select(id_col, "fp", "component_id")


def fingerprint_components(own: DataFrame, id_col: str) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of ``own`` (id, fp)."""
    distinct = write_and_read(own.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash")
    found = write_and_read(links(distinct.select("fp")), "simhash")
    roots = components(found).withColumnRenamed("node", "fp")
    named = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(least, "root").select("fp", "component_id")


def hex_of(fp) -> Column:
    """Sixteen lowercase hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
