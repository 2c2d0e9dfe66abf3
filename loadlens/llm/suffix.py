"""Repeated passages by sparse suffixes.

A document's words are hashed; in every window of ``passage`` words the word group of ``gram``
words with the smallest hash is its minimiser. Only suffixes that start at a minimiser are
kept, each with the windows that chose it: these are one segment of the text, from the first
such window to the end of the last. Equal passages choose equal minimisers, so repeats meet
at the same suffix.

Suffixes are brought together by the minimiser and the segment around it. Equal segments are
repeats as they are. Where one minimiser has different segments, the match of two suffixes has
to be extended to the left and right of the minimiser as far as it goes; a neighbour in one
sorted order is not enough for that (the neighbour with the longest common right side may
differ on the left), so the windows of these segments alone are compared, which finds every
extension of at least ``passage`` words exactly, in time linear in the segments.

Words are runs between ASCII white space, compared as they are.

Cases: null, empty and short texts have no repeats. Repeated rows repeat each other, null ids
too; the result has a row for every row of the input. Hot passages are aggregated before
they are shuffled, and no group is ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from loadlens.llm.decontaminate import merged
from loadlens.llm.toxicity import WordHashes
from loadlens.llm.workers import map_rows, mix, ship
from loadlens.session import write_and_read

ship(__name__)

SEGMENT = "struct<a:int,b:int,anchor:bigint,seg:bigint>"


def hashed(text: str | None, hashes: WordHashes) -> np.ndarray:
    words = text.encode("utf-8", "replace").split() if text else []
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def minimisers(h: np.ndarray, passage: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``passage`` words the start of its minimiser, leftmost of equals;
    and the hash of the word group at each place."""
    if len(h) < passage:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.zeros(len(h) - gram + 1, np.uint64)
    for i in range(gram):
        grams = mix(grams + h[i:len(h) - gram + 1 + i])
    wide = passage - gram + 1
    out = np.empty(len(h) - passage + 1, np.int64)
    for at in range(0, len(out), 1 << 16):
        view = np.lib.stride_tricks.sliding_window_view(grams[at:at + (1 << 16) + wide - 1], wide)
        out[at:at + len(view)] = at + np.arange(len(view)) + np.argmin(view, axis=1)
    return out, grams


def segments(h: np.ndarray, passage: int, gram: int) -> list[tuple[int, int, int, int]]:
    """(first window, last window, minimiser hash, segment hash) per kept suffix."""
    places, grams = minimisers(h, passage, gram)
    if not len(places):
        return []
    first = np.concatenate([[0], np.flatnonzero(np.diff(places)) + 1])
    last = np.concatenate([first[1:] - 1, [len(places) - 1]])
    raw = h.tobytes()
    anchors = grams[places[first]].view(np.int64).tolist()
    digest = xxhash.xxh3_64_intdigest
    segs = np.array([digest(raw[8 * a:8 * (b + passage)], 0)
                     for a, b in zip(first.tolist(), last.tolist())], np.uint64)
    offset = (places[first] - first).astype(np.uint64)  # where in the segment the suffix starts
    segs = mix(segs + offset).view(np.int64).tolist()
    return list(zip(first.tolist(), last.tolist(), anchors, segs))


def repeated_passages(docs: DataFrame, passage: int = 50, gram: int = 8, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """(id, n_words, n_repeated, spans): the words of each row that lie in a window of
    ``passage`` words which occurs at least twice in the table, as merged spans of words."""
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")).alias("k"),
                        F.col(text_col).alias("t"))
    key_type = keyed.select("k").dtypes[0][1]

    def cut(batches: Iterator[dict]):
        hashes = WordHashes()
        for b in batches:
            for k, t in zip(b["k"], b["t"]):
                h = hashed(t, hashes)
                yield k, len(h), segments(h, passage, gram)

    kept = write_and_read(map_rows(keyed, f"k {key_type}, n int, segs array<{SEGMENT}>", cut,
                                   flush=512), "suffix")
    suffixes = kept.select("k", F.explode("segs").alias("s")).select("k", "s.*")
    equal = suffixes.groupBy("anchor", "seg").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "a")).alias("one"))
    equal = write_and_read(equal, "suffix")
    several = equal.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select(
        "anchor", F.lit(True).alias("open"))
    live = write_and_read(
        equal.join(several, "anchor", "left").filter("n > 1 or open").select(
            "anchor", "seg", "n", "one", F.coalesce("open", F.lit(False)).alias("open")), "suffix")
    whole = suffixes.join(live.filter("n > 1").select("anchor", "seg"), ["anchor", "seg"]).select(
        "k", F.col("a").alias("start"), (F.col("b") + passage).alias("end"))
    asked = suffixes.join(live.filter("open"), ["anchor", "seg"]).filter(
        F.col("one") == F.struct("k", "a")).select("k", "a", "b", "anchor", "n")
    extended = _extend(keyed, asked, key_type, passage)
    spans = whole.unionByName(extended).groupBy("k").agg(
        F.collect_set(F.struct("start", "end")).alias("s"))
    spans = map_rows(spans, f"k {key_type}, spans array<struct<start:int,end:int>>",
                     lambda batches: ((k, merged([(x["start"], x["end"]) for x in s]))
                                      for b in batches for k, s in zip(b["k"], b["s"])))
    rows = _left_on_key(kept.select("k", "n"), spans)
    n = F.aggregate("spans", F.lit(0).cast("bigint"),
                    lambda x, s: x + (s["end"] - s["start"]).cast("bigint"))
    return rows.select(F.col("k.id").alias(id_col), F.col("n").cast("bigint").alias("n_words"),
                       n.alias("n_repeated"), "spans")


def _left_on_key(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows with the spans of their key (id and text hash, nulls equal), or no spans."""
    right = spans.select(F.col("k").alias("own"), "spans")
    return rows.join(right, (F.col("k.h") == F.col("own.h"))
                     & F.col("k.id").eqNullSafe(F.col("own.id")), "left").withColumn(
        "spans", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")))


def _extend(keyed: DataFrame, asked: DataFrame, key_type: str, passage: int) -> DataFrame:
    """(k, start, end) of repeated windows in the segments of ``asked``; each different segment
    is in it once, so a window that occurs twice there is a repeat."""
    per_doc = asked.groupBy("k").agg(F.collect_set(F.struct("a", "b", "anchor", "n")).alias("parts"))
    per_doc = per_doc.select(F.col("k").alias("own"), "parts")
    joined = keyed.join(per_doc, (F.col("k.h") == F.col("own.h"))
                        & F.col("k.id").eqNullSafe(F.col("own.id"))).select("k", "t", "parts")

    def cut(batches: Iterator[dict]):
        hashes, digest = WordHashes(), xxhash.xxh3_64_intdigest
        for b in batches:
            for k, t, parts in zip(b["k"], b["t"], b["parts"]):
                raw = hashed(t, hashes).tobytes()
                for p in parts:
                    for s in range(p["a"], p["b"] + 1):
                        w = digest(raw[8 * s:8 * (s + passage)], 0)
                        yield k, s, p["anchor"], w - (1 << 64) if w >> 63 else w, p["n"] == 1

    windows = write_and_read(map_rows(
        joined, f"k {key_type}, s int, anchor bigint, w bigint, single boolean", cut), "suffix")
    place = F.struct("k", "s")
    again = windows.groupBy("anchor", "w").agg(
        F.min(place).alias("one"), F.max(place).alias("other")).filter("one <> other").select(
        "anchor", "w")
    return windows.filter("single").join(again, ["anchor", "w"]).select(
        "k", F.col("s").alias("start"), (F.col("s") + passage).alias("end"))
