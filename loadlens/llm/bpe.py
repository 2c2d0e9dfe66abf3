"""Byte-level BPE: encode by longest matches and backtracking, and decode.

A token sequence is the BPE encoding of a piece exactly if every token is the encoding
of its own bytes and every two neighbours are the encoding of their joined bytes. The
encoder finds all vocabulary matches of a piece with one Aho-Corasick pass (bytes mapped
to Latin-1 characters), takes the longest match first and steps back to shorter ones where
neighbours do not fit. A place left once without success is never tried again, so the work
is linear in the piece. Whether two tokens fit is worked out by the merge rule on their few bytes
and remembered.

Cases: a null text counts as empty; an empty text has no ids, and the digests of no
bytes. Repeated rows and null ids are encoded like any other. Lone surrogates cannot
occur in Spark strings. Long texts are split by the pattern, whole, never cut.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame, functions as F

from loadlens.llm.workers import map_rows, once, ship

ship(__name__)

# Entries kept per worker for pieces and for token pairs; both are caches only.
KEPT = 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank)
                for token, rank in (line.split() for line in f if line.strip())}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The defining rule: join the neighbours of lowest rank, leftmost first, until none is left."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1),
                   key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        joined = parts[best] + parts[best + 1]
        if joined not in ranks:
            break
        parts[best:best + 2] = [joined]
    return [ranks[p] for p in parts]


def make_room(cache: dict) -> None:
    """Drop the older half of a full cache."""
    if len(cache) >= KEPT:
        for key in list(islice(cache, KEPT // 2)):
            del cache[key]


class Encoder:
    """Exact BPE of one rank table and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.matches = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if len(token) > 255:
                raise ValueError("a token is longer than 255 bytes")
            self.matches.add_word(token.decode("latin-1"), rank << 8 | len(token))
        self.matches.make_automaton()
        self._own: dict[int, bool] = {}
        self._fits: dict[int, bool] = {}
        self.packed = _Pieces(self)

    def stands(self, token: int) -> bool:
        """Is the token the encoding of its own bytes?"""
        if token not in self._own:
            self._own[token] = merge_by_rank(self.bytes_of[token], self.ranks) == [token]
        return self._own[token]

    def fits(self, left: int, right: int) -> bool:
        """Are the two tokens the encoding of their joined bytes? (Then the right one stands.)"""
        pair = left << 32 | right
        known = self._fits.get(pair)
        if known is None:
            make_room(self._fits)
            joined = self.bytes_of[left] + self.bytes_of[right]
            known = self._fits[pair] = merge_by_rank(joined, self.ranks) == [left, right]
        return known

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        found: list[list[int]] = [[] for _ in piece]  # matches by start, longest last
        for end, match in self.matches.iter(piece.decode("latin-1")):
            found[end + 1 - (match & 255)].append(match)
        known = self._fits.get
        out: list[int] = []
        starts: list[int] = []
        closed: set[int] = set()
        at, last, choices = 0, None, found[0]
        while at < len(piece):
            while choices:
                match = choices.pop()
                token, end = match >> 8, at + (match & 255)
                if end in closed:
                    continue
                if last is None:
                    good = self.stands(token)
                else:
                    good = known(last << 32 | token)
                    if good is None:
                        good = self.fits(last, token)
                if good:
                    out.append(token)
                    starts.append(at)
                    at, last = end, token
                    break
            else:  # step back, to the next shorter match there
                if not out:
                    raise ValueError("a byte of the text is missing from the vocabulary")
                closed.add(at)
                out.pop()
                at, last = starts.pop(), out[-1] if out else None
            if at < len(piece):
                choices = found[at]
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.packed.__getitem__, self.split(text))) if text else b""

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Pieces(dict):
    """Packed ids of pieces seen before."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encoder.piece(piece.encode("utf-8")), "<u4").tobytes()
        make_room(self)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


def _encoder(ranks, pattern: str) -> Encoder:
    digest, table = ranks.value
    return once(("bpe", digest, pattern), lambda: Encoder(table, pattern))


def _share(df: DataFrame, path: str):
    """The rank table, read on the driver and sent to the executors (about a megabyte), with
    the digest under which a worker keeps its encoder."""
    with open(path, "rb") as f:
        digest = hashlib.sha256(f.read()).hexdigest()
    return df.sparkSession.sparkContext.broadcast((digest, load_ranks(path)))


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row (id, ids array<int>) per row of ``docs``."""
    ranks = _share(docs, path)

    def rows(batches: Iterator[dict]):
        enc = _encoder(ranks, pattern)
        for b in batches:
            for i, text in zip(b["k"], b["t"]):
                yield i, np.frombuffer(enc.encode(text), "<u4").tolist()

    kind = docs.select(id_col).dtypes[0][1]
    return map_rows(docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")),
                    f"`{id_col}` {kind}, ids array<int>", rows, flush=256)


def decode_ids(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
               ids_col: str = "ids") -> DataFrame:
    """One row (id, content binary) per row of ``tokens``; null ids give no bytes."""
    ranks = _share(tokens, path)

    def rows(batches: Iterator[dict]):
        enc = _encoder(ranks, pattern)
        for b in batches:
            for i, ids in zip(b["k"], b["t"]):
                yield i, enc.decode(np.array(ids or [], "<u4").tobytes())

    kind = tokens.select(id_col).dtypes[0][1]
    return map_rows(tokens.select(F.col(id_col).alias("k"), F.col(ids_col).alias("t")),
                    f"`{id_col}` {kind}, content binary", rows, flush=256)


def digest_tokens(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per row: encode, decode and digest in one pass,
    so that neither ids nor bytes leave the task."""
    ranks = _share(docs, path)

    def rows(batches: Iterator[dict]):
        enc = _encoder(ranks, pattern)
        sha = hashlib.sha256
        for b in batches:
            for i, text in zip(b["k"], b["t"]):
                ids = enc.encode(text)
                yield i, len(ids) // 4, sha(ids).hexdigest(), sha(enc.decode(ids)).hexdigest()

    kind = docs.select(id_col).dtypes[0][1]
    return map_rows(docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")),
                    f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
                    rows)
