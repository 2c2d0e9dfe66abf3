"""Periodic runs of words by grammar compression.

A run is a stretch of words with smallest period q and at least ``max(min_words,
min_exponent * q)`` words that neither neighbour extends. A task takes the documents of some
hundred thousand words at a time, gives words numbers and compresses them with Re-Pair: pairs
of neighbouring symbols that occur twice or more become nonterminals, the most frequent first,
until no pair repeats. A round replaces every pair that is more frequent than the pairs it
overlaps (ties by a hash), so that the most frequent pair of all goes in each round and many
others, which do not touch it, go with it; the depth stays logarithmic where one pair a round
gives combs.

For the rule X -> A B the runs inside X that cross the boundary of A and B are found once: all
periods up to a part of X's length are tried on the words next to the boundary, and those that
agree are extended to both sides by searching with prefix hashes. The symbols that remain for
a document are halved again and again in the same way. Runs of a nonterminal are then carried
to all places where it is derived, and pieces of equal period that overlap by a period or more
are merged, which leaves the maximal runs: each lies whole in the smallest node around it.
Work is n log n for a document of n words, whatever it repeats; words repeated by several
documents or places are looked at once in a task.

Cases: null, empty and short texts have no runs. Null ids and repeated rows are rows like any
other; ties are part of the order stated at each result. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, functions as F

from loadlens.llm.workers import map_rows, mix, ship

ship(__name__)

BATCH_WORDS = 200_000
TESTS = 1 << 20
RUN = "struct<start:bigint,length:bigint,period:bigint>"
# Two primes below 2**31 and a base for each: sums of products stay in 64 bits.
MODULI = ((2147483647, 1103515245), (2147483629, 1812433253))


@dataclass
class Grammar:
    """Rules by number (symbol minus ``n_words``), and the symbols left, in text order."""

    n_words: int
    left: np.ndarray
    right: np.ndarray
    left_size: np.ndarray
    size: np.ndarray
    place: np.ndarray      # where the rule's expansion stands first
    rounds: list[int]      # number of the first rule of each round
    root: np.ndarray
    root_at: np.ndarray
    root_size: np.ndarray


def repair(words: np.ndarray, starts: np.ndarray) -> Grammar:
    """Grammar of numbered words; no pair reaches over one of the ``starts`` of documents."""
    n, base = len(words), int(words.max()) + 1 if len(words) else 0
    sym, at, size = words.astype(np.int64), np.arange(n), np.ones(n, np.int64)
    link = np.ones(n, bool)  # the pair of this symbol and the next may repeat
    link[starts[1:] - 1] = False
    link[n - 1:] = False
    rules, settled, rounds, made = [], [], [], 0
    while True:
        pair = np.flatnonzero(link)
        if not len(pair):
            break
        keys, which, times = np.unique(sym[pair] << 32 | sym[pair + 1], return_inverse=True,
                                       return_counts=True)
        again = times[which] > 1
        link[pair[~again]] = False  # what occurs once stays single whatever grows around it
        pair, which = pair[again], which[again]
        if not len(pair):
            break
        rank = np.empty(len(keys), np.int64)
        rank[np.lexsort((mix(keys), times))] = np.arange(len(keys))
        first = np.full(len(sym), -1, np.int64)
        first[pair] = rank[which]
        cut = np.concatenate([[0], np.flatnonzero(first[1:] != first[:-1]) + 1])
        v = np.concatenate([[-1], first[cut], [-1]])
        top = (v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])
        spread = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(sym))))
        chosen = np.flatnonzero(top[spread] & ((np.arange(len(sym)) - cut[spread]) % 2 == 0))
        _, one, new = np.unique(first[chosen], return_index=True, return_inverse=True)
        one = chosen[one]
        rules.append((sym[one], sym[one + 1], size[one], size[one] + size[one + 1], at[one]))
        rounds.append(made)
        sym[chosen] = base + made + new
        made += len(one)
        size[chosen] += size[chosen + 1]
        link[chosen] = link[chosen + 1]
        stay = np.ones(len(sym), bool)
        stay[chosen + 1] = False
        open_ = link.copy()
        open_[1:] |= link[:-1] & stay[:-1]
        # A deleted symbol hands its link to the one before it.
        gone = chosen + 1
        after = gone[gone + 1 < len(sym)] + 1
        open_[after] |= link[after - 2]
        settled.append((at[stay & ~open_], sym[stay & ~open_], size[stay & ~open_]))
        keep = stay & open_
        sym, at, size, link = sym[keep], at[keep], size[keep], link[keep]
    settled.append((at, sym, size))
    root_at, root, root_size = (np.concatenate(x) for x in zip(*settled))
    order = np.argsort(root_at)
    parts = [np.concatenate(x) for x in zip(*rules)] if rules else [np.zeros(0, np.int64)] * 5
    return Grammar(base, *parts, rounds, root[order], root_at[order], root_size[order])


def halved(g: Grammar, starts: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(lo, boundary, hi) of the nodes that join each document's remaining symbols in halves."""
    first = np.searchsorted(g.root_at, starts)
    a, b = first, np.append(first[1:], len(g.root_at))
    end = g.root_at + g.root_size
    out = []
    while True:
        some = b - a > 1
        a, b = a[some], b[some]
        wide = end[b - 1] - g.root_at[a] >= least if len(a) else np.zeros(0, bool)
        a, b = a[wide], b[wide]
        if not len(a):
            break
        mid = (a + b) // 2
        out.append((g.root_at[a], g.root_at[mid], end[b - 1]))
        a, b = np.concatenate([a, mid]), np.concatenate([mid, b])
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


class Extension:
    """How far stretches of words go on being equal, by prefix hashes over two moduli."""

    def __init__(self, words: np.ndarray):
        self.tables = []
        for p, base in MODULI:
            power = np.ones(1, np.int64)
            step = base
            while len(power) <= len(words):
                power = np.concatenate([power, power * step % p])
                step = step * step % p
            value = (mix(words.astype(np.uint64) + np.uint64(base)) % np.uint64(p)).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(value * power[:len(words)] % p) % p])
            self.tables.append((p, power, total))

    def equal(self, x: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the ``n`` words at x equal those at x + q."""
        same = np.ones(len(x), bool)
        for p, power, total in self.tables:
            here = (total[x + n] - total[x]) % p
            there = (total[x + q + n] - total[x + q]) % p
            same &= here * power[q] % p == there
        return same

    def reach(self, x: np.ndarray, q: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """Greatest n up to ``most`` with equal words after (or before) x and x + q."""
        n = np.zeros(len(x), np.int64)
        step = 1 << max(int(most.max()), 1).bit_length() - 1 if len(x) else 0
        while step:
            may = np.flatnonzero(n + step <= most)
            at = x[may] - n[may] - step if back else x[may] + n[may]
            ok = may[self.equal(at, q[may], np.full(len(may), step))]
            n[ok] += step
            step >>= 1
        return n


def crossing(words: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray, min_words: int,
             exponent: int, reach: Callable[[], Extension]) -> tuple[np.ndarray, ...]:
    """(node, start, end, period) of the runs inside [lo, hi) around the boundary ``mid``.

    A run has half of its words, so two periods and three words at least, on one side of the
    boundary; there its first words agree with those one period away.
    """
    most = (hi - lo) // exponent
    ends = np.cumsum(most)
    found = []
    start = 0
    half = exponent // 2
    least = (min_words + 1) // 2
    while start < len(lo):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + TESTS, "right")))
        node = np.repeat(np.arange(start, stop), most[start:stop])
        q = np.arange(len(node)) - np.repeat(ends[start:stop] - most[start:stop] - done,
                                             most[start:stop]) + 1
        side = np.maximum(half * q, least)
        m = mid[node]
        for right in (True, False):
            i = np.flatnonzero(m + side <= hi[node] if right else m - side >= lo[node])
            x = m[i] if right else m[i] - 1 - q[i]
            for off in (0, 1):
                y = x + off if right else x - off
                ok = words[y] == words[y + q[i]]
                i, x = i[ok], x[ok]
            x = m[i] if right else m[i] - q[i]
            far = x + q[i] - 1 if right else x - q[i]
            ok = words[far] == words[far + q[i]]
            i, x = i[ok], x[ok]
            if len(i):
                found.append((node[i], x, q[i]))
        start = stop
    if not found:
        return (np.zeros(0, np.int64),) * 4
    node, x, q = (np.concatenate(c) for c in zip(*found))
    ext = reach()
    left = ext.reach(x, q, x - lo[node], True)
    right = ext.reach(x, q, hi[node] - q - x, False)
    s, e = x - left, x + right + q
    ok = e - s >= np.maximum(min_words, exponent * q)
    node, s, e, q = node[ok], s[ok], e[ok], q[ok]
    order = np.lexsort((q, e, s, node))  # multiples of a period give the same stretch
    node, s, e, q = node[order], s[order], e[order], q[order]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    return node[new], s[new], e[new], q[new]


def derived(g: Grammar, rule: np.ndarray, s: np.ndarray, e: np.ndarray, q: np.ndarray
            ) -> tuple[np.ndarray, ...]:
    """(start, end, period) of the rules' runs at every place where the rules are derived."""
    n = len(g.left)
    some = np.zeros(g.n_words + n, bool)
    own = np.bincount(rule, minlength=n)
    for a, b in zip(g.rounds, [*g.rounds[1:], n]):
        some[g.n_words + a:g.n_words + b] = ((own[a:b] > 0) | some[g.left[a:b]]
                                             | some[g.right[a:b]])
    head = np.cumsum(own) - own
    rel_s, rel_e = s - g.place[rule], e - g.place[rule]
    live = some[g.root]
    at, sym = g.root_at[live], g.root[live]
    out = []
    while len(at):
        r = sym - g.n_words
        times = own[r]
        k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(
            head[r], times)
        base = np.repeat(at, times)
        out.append((base + rel_s[k], base + rel_e[k], q[k]))
        at = np.concatenate([at, at + g.left_size[r]])
        sym = np.concatenate([g.left[r], g.right[r]])
        live = some[sym]
        at, sym = at[live], sym[live]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def merged_runs(s: np.ndarray, e: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of one period that overlap by the period or more as one; ordered by start, period."""
    order = np.lexsort((-e, s, q))
    s, e, q = s[order], e[order], q[order]
    wide = int(e.max()) + 1 if len(e) else 1
    level = np.cumsum(np.concatenate([[0], q[1:] != q[:-1]])) * wide if len(q) else q
    top = np.maximum.accumulate(level + e) if len(q) else q
    new = np.ones(len(q), bool)
    new[1:] = s[1:] + level[1:] > top[:-1] - q[1:]
    if len(q):
        new[1:] |= q[1:] != q[:-1]
    first = np.flatnonzero(new)
    s, q = s[first], q[first]
    e = top[np.append(first[1:], len(top)) - 1] - level[first] if len(first) else e
    order = np.lexsort((q, s))
    return s[order], e[order], q[order]


def find_runs(words: np.ndarray, starts: np.ndarray, min_words: int = 6, exponent: int = 4
              ) -> tuple[np.ndarray, ...]:
    """(start, end, period) of all runs in the documents that begin at ``starts``, by start,
    then period; ``words`` are the numbered words of all of them in a row."""
    if min_words < 6 or exponent < 4:
        raise ValueError("runs are found from 6 words and exponent 4 on")
    if len(words) < min_words:
        return (np.zeros(0, np.int64),) * 3
    starts = np.unique(starts[starts < len(words)])
    g = repair(words, starts)
    kept: list[Extension] = []

    def reach() -> Extension:
        if not kept:
            kept.append(Extension(words))
        return kept[0]

    wide = np.flatnonzero(g.size >= min_words)
    inner, s, e, q = crossing(words, g.place[wide], (g.place + g.left_size)[wide],
                              (g.place + g.size)[wide], min_words, exponent, reach)
    outer = crossing(words, *halved(g, starts, min_words), min_words, exponent, reach)[1:]
    pieces = derived(g, wide[inner], s, e, q)
    return merged_runs(*(np.concatenate(x) for x in zip(outer, pieces)))


def _dropped(n: int, s: np.ndarray, e: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, s + q, 1)
    np.add.at(step, e, -1)
    return np.cumsum(step[:-1]) > 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_words: int = 6, exponent: int = 4,
                  reorder: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """(id, n_words, runs, collapsed) per row: all runs by start, then period, and the words
    that are left when each run keeps its first period, joined by single spaces.

    Words are runs of anything but ASCII white space. ``reorder`` may give, for an id and its
    number of words, the number of the word to read at each place.
    """

    def flush(held: list[tuple]) -> Iterator[tuple]:
        ids: dict[bytes, int] = {}
        numbers = count()
        lines, arrays = [], []
        for key, text in held:
            w = text.encode("utf-8", "replace").split() if text else []
            a = np.fromiter(map(ids.setdefault, w, numbers), np.int64, len(w))
            take = reorder(key, len(w)) if reorder and w else None
            if take is not None:
                a, w = a[take], [w[i] for i in take.tolist()]
            arrays.append(a)
            lines.append(b" ".join(w))
        ends = np.cumsum([len(a) for a in arrays])
        starts = ends - [len(a) for a in arrays]
        s, e, q = find_runs(np.concatenate(arrays), starts, min_words, exponent)
        cut = np.searchsorted(s, np.append(starts, ends[-1]))
        for i, (key, _) in enumerate(held):
            a, b, n = int(cut[i]), int(cut[i + 1]), len(arrays[i])
            own = (s[a:b] - starts[i], e[a:b] - starts[i], q[a:b])
            line = lines[i]
            if b > a:
                gone = _dropped(n, *own).tolist()
                line = b" ".join(w for w, g in zip(line.split(b" "), gone) if not g)
            runs = [{"start": x, "length": y - x, "period": z}
                    for x, y, z in zip(*(c.tolist() for c in own))]
            yield key, n, runs, line.decode("utf-8")

    def rows(batches: Iterator[dict]):
        held, size = [], 0
        for b in batches:
            for key, text in zip(b["k"], b["t"]):
                held.append((key, text))
                size += len(text or "") // 5 + 1
                if size >= BATCH_WORDS:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    kind = docs.select(id_col).dtypes[0][1]
    return map_rows(docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")),
                    f"`{id_col}` {kind}, n_words bigint, runs array<{RUN}>, collapsed string",
                    rows, flush=256)
