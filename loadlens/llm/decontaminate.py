"""Benchmark decontamination by Wu-Manber search over words.

Windows of ``window`` consecutive words of the test items are the patterns (an item of
fewer words is one shorter pattern). The searched symbols are words; a block is two
words. For patterns of one length the shift table says, for the block under the search
position, how far the position may move on without passing an occurrence; blocks at the
end of a pattern have shift zero and name a bucket of patterns, which are compared word
by word. A block in no pattern moves the search on by a whole pattern less one word, so
most positions of a document are never looked at.

Distinct patterns are counted and broadcast in blocks of about ``block_windows``, dealt by a hash
of the pattern, so an item of any length is spread over blocks and a larger test set takes more
passes over the documents, not more memory: a pattern of ten words takes about 1.5 kB in the
tables of a worker.

Cases: null texts have no words; items without words match nothing. Repeated item ids
count once; items with a null id are searched (their words are hit) but not named.
Repeated documents are each reported. With no items every document is clean.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from loadlens.llm.workers import latest, map_rows, ship, words_of
from loadlens.session import write_and_read

ship(__name__)


class WuManber:
    """Patterns of equal length over words. ``patterns`` maps a word tuple to item ids."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set]):
        self.length = len(next(iter(patterns)))
        self.block = min(2, self.length)
        self.rest = self.length - self.block + 1
        self.singles = {w[0]: items for w, items in patterns.items()} if self.length == 1 else {}
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list] = defaultdict(list)
        for words, items in patterns.items():
            for start in range(self.rest):
                block = words[start:start + self.block]
                far = self.rest - 1 - start
                self.shift[block] = min(far, self.shift.get(block, far))
            self.bucket[words[self.rest - 1:]].append((words, items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set]]:
        """(first word, item ids) of every occurrence."""
        get, rest, length = self.shift.get, self.rest, self.length
        end = length
        if self.block == 1:
            for at, w in enumerate(words):
                if w in self.singles:
                    yield at, self.singles[w]
            return
        while end <= len(words):
            step = get((words[end - 2], words[end - 1]), rest)
            if step:
                end += step
                continue
            start = end - length
            for pattern, items in self.bucket[words[end - 2], words[end - 1]]:
                if pattern[0] == words[start] and list(pattern) == words[start:end]:
                    yield start, items
            end += 1


def windows(text: str, window: int) -> list[bytes]:
    """Patterns of an item: every window, or the whole of a shorter item; words space-joined."""
    words = words_of(text)
    n = min(window, len(words))
    return [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1 if n else 0)]


def patterns_of(items: DataFrame, window: int) -> DataFrame:
    """(w, items): the distinct patterns of items (i, t), and the ids that they name."""

    def rows(batches: Iterator[dict]):
        for b in batches:
            for i, t in zip(b["i"], b["t"]):
                for w in set(windows(t, window)):
                    yield w, i

    found = map_rows(items, "w binary, i string", rows)
    return write_and_read(found.groupBy("w").agg(F.collect_set("i").alias("items")), "decontaminate")


def find_hits(docs: DataFrame, patterns: list[tuple[bytes, list]], id_col: str,
              text_col: str) -> DataFrame:
    """Rows (id, n_words, spans, items): the word spans hit by one block of patterns, merged."""
    shared = docs.sparkSession.sparkContext.broadcast(patterns)
    key = uuid.uuid4().hex

    def tables() -> list[WuManber]:
        by_length: dict[int, dict[tuple, list]] = defaultdict(dict)
        for w, items in shared.value:
            words = tuple(w.split(b" "))
            by_length[len(words)][words] = items
        return [WuManber(p) for p in by_length.values()]

    def rows(batches: Iterator[dict]):
        searches = latest("wu-manber", key, tables)
        for b in batches:
            for i, text in zip(b["k"], b["t"]):
                words = words_of(text)
                found: set = set()
                hit: list[tuple[int, int]] = []
                for s in searches:
                    for start, named in s.search(words):
                        hit.append((start, start + s.length))
                        found.update(named)
                yield i, len(words), merged(hit), sorted(found)

    kind = docs.select(id_col).dtypes[0][1]
    return map_rows(docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")),
                    f"`{id_col}` {kind}, n_words bigint, "
                    "spans array<struct<start:int,end:int>>, items array<string>", rows)


def merged(spans: list) -> list[dict]:
    """Spans joined where they touch or overlap."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [{"start": a, "end": b} for a, b in out]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", block_windows: int = 50_000) -> DataFrame:
    """(id, n_words, n_hit, spans, items) per document; spans in words, items sorted as text."""
    items = benchmark.select(F.col(item_col).cast("string").alias("i"),
                             F.col(item_text_col).alias("t")).filter("t is not null")
    patterns = patterns_of(items, window)
    n = patterns.count()
    if n <= block_windows:
        found = find_hits(docs, _collected(patterns), id_col, text_col)
        return found.withColumn("n_hit", words_hit("spans"))
    return _in_blocks(docs, patterns, id_col, text_col, -(-2 * n // block_windows))


def _collected(patterns: DataFrame) -> list[tuple[bytes, list]]:
    return [(bytes(r["w"]), r["items"]) for r in patterns.toLocalIterator()]


def words_hit(spans: str):
    return F.aggregate(spans, F.lit(0).cast("bigint"),
                       lambda n, s: n + (s["end"] - s["start"]).cast("bigint"))


def _in_blocks(docs: DataFrame, patterns: DataFrame, id_col: str, text_col: str,
               blocks: int) -> DataFrame:
    """One pass over the documents for each block of patterns; hits of a document meet by a key
    of its id and text, so repeated documents with one key share their (equal) hits."""
    keyed = docs.select(F.struct(F.col(id_col).alias("id"),
                                 F.xxhash64(text_col).alias("h")).alias("row"),
                        F.col(text_col).alias("body"))
    part = F.pmod(F.xxhash64("w"), F.lit(blocks))
    found = None
    for n in range(blocks):
        hits = find_hits(keyed, _collected(patterns.filter(part == n)), "row", "body").filter(
            F.size("spans") > 0)
        hits = write_and_read(hits.select("row", "spans", "items"), "decontaminate")
        found = hits if found is None else found.unionByName(hits)
    united = map_rows(
        found.groupBy("row").agg(F.flatten(F.collect_set("spans")).alias("s"),
                                 F.array_sort(F.array_distinct(F.flatten(
                                     F.collect_set("items")))).alias("i")),
        f"row {keyed.select('row').dtypes[0][1]}, spans array<struct<start:int,end:int>>, "
        "items array<string>",
        lambda batches: ((k, merged([(x["start"], x["end"]) for x in s]), i)
                         for b in batches for k, s, i in zip(b["row"], b["s"], b["i"])))
    counted = find_hits(keyed, [], "row", "body").select("row", "n_words")
    joined = counted.join(united, counted["row"].eqNullSafe(united["row"]), "left").drop(
        united["row"])
    empty = F.array().cast("array<struct<start:int,end:int>>")
    return joined.select(F.col("row.id").alias(id_col), "n_words",
                         F.coalesce("spans", empty).alias("spans"),
                         F.coalesce("items", F.array().cast("array<string>")).alias("items")
                         ).withColumn("n_hit", words_hit("spans"))

