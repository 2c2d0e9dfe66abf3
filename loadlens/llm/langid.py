"""Language identification by unigram piece models, summed over all segmentations.

Words are runs of letters, lower-cased, with a space before them. A language's model gives
each piece of a fixed public vocabulary a probability; the likelihood of a word is the sum,
over every way to cut it into pieces, of the product of the piece probabilities. A forward
pass over the bytes of the word gives that sum; words are independent, so a text's score is
the sum over its words. Piece probabilities are learned by expectation maximisation with
forward-backward passes over the word counts of a bounded sample of labelled documents per
language (``fit_docs``); all pieces that words can hold are used, and every single byte, so
every text has a likelihood in every language.

Cases: ``und`` with score 0 for null texts and texts without a letter, and for all texts if
no labelled document exists. Equal posteriors go to the language first in text order.
Repeated rows and null ids are predicted like any other. Long texts are scored whole.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, functions as F

from loadlens.llm.workers import map_rows, opened, share, ship
from loadlens.session import write_and_read

ship(__name__)

# What the packed matches can hold; the bits of a length.
LENGTH_BITS = 16
LONGEST = (1 << LENGTH_BITS) - 1
KEPT = 300_000
# Places times words that are worked on at once.
CELLS = 150_000
# Words of up to so many bytes are summed without logarithms; scale of a byte's probability.
SHORT = 40
BYTE_SCALE = 3.0
WORDS = r"[^\W\d_]+"


def read_pieces(path: str) -> list[bytes]:
    """Pieces of a rank file that words can hold: every byte, and runs of lower-case letters
    and bytes above ASCII, with or without a space before them."""
    with open(path, "rb") as f:
        pieces = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
    inner = re.compile(rb" ?[a-z\x80-\xff]+")
    return sorted(p for p in pieces
                  if len(p) == 1 or len(p) <= LONGEST and inner.fullmatch(p))


# In texts of ASCII alone the words are the runs of a-z.
ASCII_WORDS = {i: " " for i in range(128) if not chr(i).isalpha()}


def find_words(text: str | None, find=re.compile(WORDS).findall) -> list[str]:
    """Lower-cased runs of letters of a text."""
    if not text:
        return []
    low = text.lower()
    return low.translate(ASCII_WORDS).split() if low.isascii() else find(low)


@dataclass
class Arcs:
    """Piece matches of some words, ordered by end: word, first and last byte place, piece."""

    lengths: np.ndarray
    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray

    def by(self, place: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each value of ``place``: the value, its arcs in word order, and where in them a
        new word begins."""
        order = np.argsort(place, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(place[order])) + 1, [len(order)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            arcs = order[a:b]
            w = self.word[arcs]
            yield int(place[arcs[0]]), arcs, np.concatenate([[0], np.flatnonzero(np.diff(w)) + 1])


class Lattice:
    """All piece matches of words, found by one Aho-Corasick pass over many words."""

    def __init__(self, pieces: list[bytes]):
        self.count = len(pieces)
        self.find = ahocorasick.Automaton()
        for k, p in enumerate(pieces):
            self.find.add_word(p.decode("latin-1"), k << LENGTH_BITS | len(p))
        self.find.make_automaton()

    def arcs(self, coded: list[bytes]) -> Arcs:
        """Words are joined by line ends, which longer pieces do not hold."""
        lengths = np.array([len(w) for w in coded])
        first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        text = b"\n".join(coded).decode("latin-1")
        ends, found = np.fromiter(chain.from_iterable(self.find.iter(text)), np.int64
                                  ).reshape(-1, 2).T
        word = np.searchsorted(first, ends, side="right") - 1
        end = ends - first[word] + 1
        own = end <= lengths[word]  # the line end itself is a byte, too
        word, end, found = word[own], end[own], found[own]
        return Arcs(lengths, word, end - (found & LONGEST), end, found >> LENGTH_BITS)


def chunks(words: list[str]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(places, UTF-8 with a space before) of words of like length, in bounded blocks."""
    coded = [(" " + w).encode("utf-8", "replace") for w in words]
    order = sorted(range(len(words)), key=lambda i: len(coded[i]))
    while order:
        n = 1
        while n < len(order) and (n + 1) * (len(coded[order[n]]) + 1) <= CELLS:
            n *= 2
        n = max(1, min(n, len(order)) if n * (len(coded[order[min(n, len(order)) - 1]]) + 1)
                <= CELLS else n // 2)
        yield np.array(order[:n]), [coded[i] for i in order[:n]]
        order = order[n:]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log of the summed exponentials of the rows of each word."""
    top = np.maximum.reduceat(values, first)
    size = np.diff(np.append(first, len(values)))
    return top + np.log(np.add.reduceat(np.exp(values - np.repeat(top, size, axis=0)), first))


def forward(arcs: Arcs, logp: np.ndarray) -> np.ndarray:
    """Log of the summed probability of all segmentations up to each place, (place, word,
    column); ``logp`` has a row for each arc."""
    sums = np.full((int(arcs.lengths.max()) + 1, len(arcs.lengths), logp.shape[1]), -np.inf)
    sums[0] = 0.0
    for at, own, first in arcs.by(arcs.end):
        sums[at, arcs.word[own[first]]] = _sums(
            sums[arcs.start[own], arcs.word[own]] + logp[own], first)
    return sums


def _short_scores(arcs: Arcs, logs: np.ndarray) -> np.ndarray:
    """Log-likelihoods of words of up to ``SHORT`` bytes, from plain products: scaled by
    ``BYTE_SCALE`` per byte they stay inside the range of a double."""
    size = arcs.end - arcs.start
    p = np.exp(logs)[arcs.piece] * np.exp(BYTE_SCALE * size)[:, None]
    sums = np.zeros((int(arcs.lengths.max()) + 1, len(arcs.lengths), logs.shape[1]))
    sums[0] = 1.0
    for at, own, first in arcs.by(arcs.end):
        w = arcs.word[own]
        sums[at, w[first]] = np.add.reduceat(sums[arcs.start[own], w] * p[own], first)
    last = sums[arcs.lengths, np.arange(len(arcs.lengths))]
    return np.log(last) - BYTE_SCALE * arcs.lengths[:, None]


def word_scores(words: list[str], lattice: Lattice, logs: np.ndarray) -> np.ndarray:
    """Log-likelihood of each word in each language; ``logs`` is (pieces, languages)."""
    out = np.zeros((len(words), logs.shape[1]))
    for places, coded in chunks(words):
        arcs = lattice.arcs(coded)
        if arcs.lengths.max() <= SHORT:
            out[places] = _short_scores(arcs, logs)
        else:
            out[places] = forward(arcs, logs[arcs.piece])[arcs.lengths, np.arange(len(places))]
    return out


def expected_counts(words: list[str], weight: np.ndarray, language: np.ndarray,
                    lattice: Lattice, logs: np.ndarray) -> np.ndarray:
    """Expected uses of each piece by language, (pieces, languages), by forward-backward."""
    width = logs.shape[1]
    out = np.zeros(lattice.count * width)
    for places, coded in chunks(words):
        arcs = lattice.arcs(coded)
        lang = language[places][arcs.word]
        logp = logs[arcs.piece, lang][:, None]
        fore = forward(arcs, logp)
        # Backwards: the same sums over the mirrored words.
        size = arcs.lengths[arcs.word]
        mirror = Arcs(arcs.lengths, arcs.word, size - arcs.end, size - arcs.start, arcs.piece)
        back = forward(mirror, logp)
        total = fore[arcs.lengths, np.arange(len(places)), 0]
        share = np.exp(fore[arcs.start, arcs.word, 0] + logp[:, 0]
                       + back[size - arcs.end, arcs.word, 0] - total[arcs.word])
        out += np.bincount(arcs.piece * width + lang, share * weight[places][arcs.word],
                           minlength=len(out))
    return out.reshape(lattice.count, width)


@dataclass
class Model:
    """Languages in text order, pieces, and log-probabilities (pieces, languages)."""

    languages: list[str]
    pieces: list[bytes]
    logs: np.ndarray


def sampled(docs: DataFrame, key: str, per_value: int, id_col: str) -> DataFrame:
    """About ``per_value`` rows of each value of ``key``, chosen by a hash of the id."""
    counts = docs.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    share = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    picked = docs.withColumn("_u", share).join(F.broadcast(counts), key)
    return picked.filter(F.col("_u") * F.col("_n") < per_value).drop("_u", "_n")


def fit(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", fit_docs: int = 1500, rounds: int = 3,
        smoothing: float = 0.5, max_languages: int = 200) -> Model:
    """Learn from at most about ``fit_docs`` documents per language.

    What reaches the driver is one number per piece and language, whatever the corpus; more
    than ``max_languages`` label values are refused.
    """
    spark = docs.sparkSession
    pieces = read_pieces(vocabulary)
    own = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"),
                      F.col(lang_col).alias("l")).filter("l is not null and t is not null")
    labels = [r[0] for r in own.select("l").distinct().limit(max_languages + 1).collect()]
    if len(labels) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages = sorted(labels)
    if not languages:
        return Model([], pieces, np.zeros((len(pieces), 0)))
    place = {lang: k for k, lang in enumerate(languages)}

    def counted(batches: Iterator[dict]):
        for b in batches:
            seen: Counter = Counter()
            for text, lang in zip(b["t"], b["l"]):
                seen.update((place[lang], w) for w in find_words(text))
            for (lang, w), n in seen.items():
                yield lang, w, n

    words = map_rows(sampled(own, "l", fit_docs, "i").select("t", "l"),
                     "l int, w string, n bigint", counted)
    words = write_and_read(words.groupBy("l", "w").agg(F.sum("n").alias("n")), "langid")
    logs = np.full((len(pieces), len(languages)), -np.log(len(pieces)))
    for _ in range(rounds):
        counts = np.full_like(logs, smoothing)
        got = _count_pieces(words, pieces, logs).toArrow()
        counts[got.column("p").to_numpy(), got.column("l").to_numpy()] += got.column("c").to_numpy()
        logs = np.log(counts / counts.sum(axis=0))
    return Model(languages, pieces, logs)


def _count_pieces(words: DataFrame, pieces: list[bytes], logs: np.ndarray) -> DataFrame:
    model = words.sparkSession.sparkContext.broadcast((pieces, logs))

    def rows(batches: Iterator[dict]):
        own, current = model.value
        lattice = Lattice(own)
        total = np.zeros_like(current)
        for b in batches:
            total += expected_counts(b["w"], np.array(b["n"], float), np.array(b["l"], int),
                                     lattice, current)
        for p, lang in np.argwhere(total > 1e-6).tolist():
            yield p, lang, float(total[p, lang])

    return map_rows(words, "p int, l int, c double", rows).groupBy("p", "l").agg(
        F.sum("c").alias("c"))


class Scorer:
    """Word likelihoods of one model, remembered per word."""

    def __init__(self, model: Model):
        self.lattice, self.logs = Lattice(model.pieces), model.logs
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.languages)))

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > KEPT:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        base = len(self.known)
        if base + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((base + len(new),
                                                               self.table.shape[1]))])
        if new:
            self.table[base:base + len(new)] = word_scores(new, self.lattice, self.logs)
        self.known.update((w, base + i) for i, w in enumerate(new))

    def batch(self, texts: list[str | None]) -> Iterator[np.ndarray | None]:
        """Log-likelihoods by language of each text; None without a letter."""
        for a in range(0, len(texts), 512):
            found = [find_words(t) for t in texts[a:a + 512]]
            self.learn(set().union(*found))
            for words in found:
                if any(ch.isalpha() for w in words for ch in w):
                    at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
                    yield self.table[at].sum(axis=0)
                else:
                    yield None


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) per row: the likeliest language and its posterior probability."""
    shared = share(docs.sparkSession, model)

    def rows(batches: Iterator[dict]):
        m = opened(shared)
        scorer = Scorer(m)
        for b in batches:
            for i, like in zip(b["k"], scorer.batch(b["t"])):
                if like is None or not len(like):
                    yield i, "und", 0.0
                else:
                    best = int(np.argmax(like))
                    yield i, m.languages[best], float(1 / np.exp(like - like[best]).sum())

    kind = docs.select(id_col).dtypes[0][1]
    return map_rows(docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")),
                    f"`{id_col}` {kind}, lang_pred string, score double", rows)
