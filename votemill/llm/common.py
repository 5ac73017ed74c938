"""Arrow maps, counts and models sent to the executors, shared by the operators on text."""

from __future__ import annotations

import pickle
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votemill.session import ship, written  # noqa: F401

LOADED = 3  # models a worker keeps
COUNTED = 200_000  # keys that a task holds before it hands on what it has counted


class Shipped:
    """A trained model, pickled once and sent to the executors as a broadcast; its size is bounded by its training parameters."""

    def __init__(self, df: DataFrame, model):
        self._b = df.sparkSession.sparkContext.broadcast(pickle.dumps(model, protocol=5))
        self._key = uuid.uuid4().hex
        self._m = None

    def __getstate__(self):
        return {"_b": self._b, "_key": self._key, "_m": None}

    def get(self):
        if self._m is None:
            if self._key not in _loaded:
                while len(_loaded) >= LOADED:
                    del _loaded[next(iter(_loaded))]
                _loaded[self._key] = pickle.loads(self._b.value)
            self._m = _loaded[self._key]
        return self._m


_loaded: dict = {}


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = work(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def count_keys(df: DataFrame, keys: Callable[[pa.RecordBatch], Iterable[Iterable[str]]], weight: bool = False) -> DataFrame:
    """key, n: how often ``keys`` gives a key over all rows of ``df``, which gives the keys of each row of a batch.

    With ``weight`` a row counts as often as its second column says.

    A task adds up what it reads and hands on partial sums, so that neither a frequent key nor
    many rows weigh on the shuffle, and no task holds more than ``COUNTED`` keys and a row's own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            times = batch.column(1).to_pylist() if weight else None
            for i, found in enumerate(keys(batch)):
                if times is None:
                    seen.update(found)
                else:
                    for k in found:
                        seen[k] += times[i]
                if len(seen) > COUNTED:
                    yield _counted(seen)
                    seen.clear()
        yield _counted(seen)

    ship(df.sparkSession)
    return df.mapInArrow(run, "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["key", "n"])


def collect_counts(counts: DataFrame) -> Iterator[tuple[str, int]]:
    """The rows of key and n on the driver, without an object for each of them at once."""
    for b in counts.toArrow().to_batches(max_chunksize=50_000):
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist())
