"""Helpers for Python that runs inside Spark tasks."""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Letters A-Z to a-z, every other ASCII byte that is no digit or letter to a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122
                   else 32 for b in range(256))


def ship(module: str) -> None:
    """Send the functions of a module with the tasks, so executors need no install."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def share(spark, value):
    """Broadcast a value of a class of this package, whole, so that executors need no install;
    ``opened`` gives it back in a task."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(shared):
    return pickle.loads(shared.value)


def once(key: tuple, build: Callable):
    """Value built once per worker process and kept for its later tasks."""
    kept = sys.__dict__.setdefault("_loadlens_once", {})
    if key not in kept:
        kept[key] = build()
    return kept[key]


def latest(slot: str, key: str, build: Callable):
    """Value of ``key`` built once per worker process; it replaces the one kept in its slot."""
    kept = sys.__dict__.setdefault("_loadlens_latest", {})
    if kept.get(slot, ("", None))[0] != key:
        kept[slot] = (key, build())
    return kept[slot][1]


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters, as UTF-8."""
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


def map_rows(df: DataFrame, schema: str, rows: Callable[[Iterator], Iterator[tuple]],
             flush: int = 4096, arrow_in: bool = False) -> DataFrame:
    """``rows`` turns an iterator of column dicts (one per Arrow batch, columns as lists)
    into tuples of ``schema``; they leave in Arrow batches of ``flush`` rows. With
    ``arrow_in`` it gets the batches themselves."""
    target = T.StructType.fromDDL(schema)
    names = target.names
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def made():
            cols = zip(*held) if held else [[] for _ in names]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for row in rows(batches if arrow_in else _columns(batches)):
            held.append(row)
            if len(held) >= flush:
                yield made()
                held.clear()
        if held:
            yield made()

    return df.mapInArrow(run, target)


def _columns(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[dict]:
    """Columns as Python lists, a part of a batch at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows).to_pydict()


def is_training_row(doc_id: Column) -> Column:
    """Rows a model may learn from: crc32 of the id as text is no multiple of 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (shift-multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))
