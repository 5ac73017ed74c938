"""Nested histories to flat tables that keep the links between parent and child.

Two forms arrive: JSON text before any schema, and the typed nested table.  JSON text is read
by the structural index (``structural.py``); in the typed table the array offsets already are
that index, so the same rows come from Spark's own explodes.

Keys: a row is named by its record and the places of its ancestors, so every row names its
parent by a prefix of its own key.  Places count null elements; -1 stands below a row's level.

Edge cases: a null, empty, blank or malformed payload has no rows; a null or empty list has no
children; null elements are no rows but keep their place; an object (or for lines a string)
where a list belongs is a list of one; deliveries repeated under one id count once, the first
by time; deliveries without an id are never taken for repeats of each other unless time and
content are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votemill.operators import structural
from votemill.session import ship, written

PATH = ("acf_commits", "acf_files", "added_lines")
POSITIONS = ("repo_pos", "commit_pos", "file_pos", "line_pos")
_POS = pa.struct([(p, pa.int32()) for p in POSITIONS])
_BATCH_BYTES = 32 << 20


def _utf8(text: str | None) -> bytes:
    return text.lstrip("﻿").encode("utf-8", "replace").replace(b"\x01", b" ") if text else b""


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Payloads in blocks of bounded size: the index takes about forty bytes for each byte of text."""
    block: list[bytes] = []
    size, first = 0, 0
    for i, t in enumerate(texts):
        b = _utf8(t)
        if block and size + len(b) > _BATCH_BYTES // 8:
            yield first, block
            block, size, first = [], 0, i
        block.append(b)
        size += len(b)
    if block:
        yield first, block


def _keys(ix: structural.Index, levels: list, upto: int) -> np.ndarray:
    """The places of a level's rows and of their ancestors; -1 below."""
    own = structural.places(ix, levels)
    values, up = levels[upto]
    out = np.full((len(values), len(levels)), -1, np.int64)
    rows = np.arange(len(values))
    for k in range(upto, -1, -1):
        out[:, k] = own[k][rows]
        rows = levels[k][1][rows]
    return out


def text_positions(df: DataFrame, record: str, text: str, delivered: str, path: tuple[str, ...] = PATH) -> DataFrame:
    """One row per payload: record_id, delivered and ``rows``, the places of every row of every level below the top objects.

    One Arrow batch is indexed at once; the payload text stays in the task that read it.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, block in _blocks(batch.column(2).to_pylist()):
                ix = structural.build(block)
                levels = structural.linked_rows(ix, path)
                keys = [_keys(ix, levels, k) for k in range(1, len(levels))]
                owner = np.concatenate([ix.payload[v] for v, _ in levels[1:]]) if keys else np.zeros(0, np.int64)
                key = np.concatenate(keys) if keys else np.zeros((0, 4), np.int64)
                order = np.argsort(owner, kind="stable")
                offsets = np.searchsorted(owner[order], np.arange(len(block) + 1)).astype(np.int32)
                rows = pa.StructArray.from_arrays([pa.array(key[order, k].astype(np.int32)) for k in range(4)], fields=list(_POS))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(block)), batch.column(1).slice(first, len(block)), pa.ListArray.from_arrays(pa.array(offsets), rows)], names=["record_id", "delivered", "rows"])

    ship(df.sparkSession)
    kind = "array<struct<repo_pos:int,commit_pos:int,file_pos:int,line_pos:int>>"
    stamp = df.schema[delivered].dataType.simpleString()
    return df.select(F.col(record).cast("bigint").alias("record_id"), F.col(delivered).alias("delivered"), F.col(text).alias("text")).mapInArrow(work, f"record_id bigint, delivered {stamp}, rows {kind}")


def _at(c: Column | int, f: Column | int, line: Column | int) -> Column:
    as_int = lambda v: v.cast("int") if isinstance(v, Column) else F.lit(v).cast("int")
    return F.struct(F.lit(0).alias("repo_pos"), as_int(c).alias("commit_pos"), as_int(f).alias("file_pos"), as_int(line).alias("line_pos"))


def typed_positions(df: DataFrame, record: str, delivered: str) -> DataFrame:
    """As text_positions, for the typed nested column acf_commits; no text leaves the JVM."""
    empty_type = "array<struct<repo_pos:int,commit_pos:int,file_pos:int,line_pos:int>>"
    nested_type = f"array<{empty_type}>"

    def lines(c: Column, f: Column, added: Column) -> Column:
        marked = F.transform(added, lambda line, k: F.when(line.isNotNull(), _at(c, f, k)))
        return F.filter(F.coalesce(marked, F.array().cast(empty_type)), lambda x: x.isNotNull())

    def files(c: Column, fs: Column) -> Column:
        per = F.transform(fs, lambda f, j: F.when(f.isNotNull(), F.concat(F.array(_at(c, j, -1)), lines(c, j, f["added_lines"]))))
        return F.flatten(F.filter(F.coalesce(per, F.array().cast(nested_type)), lambda x: x.isNotNull()))

    per = F.transform("acf_commits", lambda c, i: F.when(c.isNotNull(), F.concat(F.array(_at(i, -1, -1)), files(i, c["acf_files"]))))
    rows = F.flatten(F.filter(F.coalesce(per, F.array().cast(nested_type)), lambda x: x.isNotNull()))
    return df.select(F.col(record).cast("bigint").alias("record_id"), F.col(delivered).alias("delivered"), rows.alias("rows"))


def once(positions: DataFrame) -> DataFrame:
    """Deliveries repeated under one record count once: the first by time.

    The shuffle moves places only, and repeats meet already before it (partial aggregation),
    so a record that arrives very often is no hot group.
    """
    unnamed = F.when(F.col("record_id").isNull(), F.xxhash64("delivered", "rows"))
    return positions.groupBy("record_id", unnamed.alias("__unnamed")).agg(F.min(F.struct("delivered", "rows")).alias("m")).select("record_id", F.inline("m.rows"))


MOST_REPEATED = 1_000_000  # ids of repeated records are broadcast up to so many


def first_deliveries(df: DataFrame, record: str, delivered: str) -> DataFrame:
    """The rows of ``df`` (read from files) without repeated deliveries.

    Ids and places are read first, without texts; the ids that repeat, with the place of their
    first delivery, are written to the shared folder and counted.  Up to ``MOST_REPEATED`` of
    them are broadcast to where the texts are read, so no text is shuffled; beyond that the
    join is left to AQE.  A null id repeats nothing.
    """
    spot = F.struct(F.col(delivered).alias("d"), F.col("_metadata.file_path").alias("p"), F.col("_metadata.row_index").alias("i"))
    ids = df.where(F.col(record).isNotNull()).select(F.col(record).alias("__id"), spot.alias("__spot"))
    first = written(ids.groupBy("__id").agg(F.min("__spot").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n"))
    if first.count() <= MOST_REPEATED:
        first = F.broadcast(first)
    joined = df.select("*", spot.alias("__spot")).join(first, F.col(record) == F.col("__id"), "left")
    return joined.where("__first is null or __first = __spot").drop("__id", "__first", "__spot")


def text_rows(df: DataFrame, record: str, text: str, level: int, path: tuple[str, ...] = PATH) -> DataFrame:
    """The rows of one level (0 for the top objects) with their scalar fields: record_id, places, ``fields`` (key to text), ``value`` of a scalar row.

    Scalars are given as text (strings unescaped, numbers and booleans as written), nulls
    as null; nested containers other than the levels stay as JSON text in ``fields``.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, block in _blocks(batch.column(1).to_pylist()):
                ix = structural.build(block)
                levels = structural.linked_rows(ix, path)
                kind = ix.kind() if len(ix.start) else np.zeros(0, np.uint8)
                for k, (values, _) in [(level, levels[level])]:
                    key = _keys(ix, levels, k)
                    box = (kind[values] == 0x7B) | (kind[values] == 0x5B)
                    text_of: list[str | None] = [None] * len(values)
                    for j, v in zip(np.flatnonzero(~box).tolist(), structural.spans(ix, values[~box])):
                        text_of[j] = v
                    child = np.flatnonzero(np.isin(ix.parent, values))
                    child = child[(ix.key_from[child] >= 0)]
                    if k < len(path):
                        child = child[~ix.has_key(child, path[k])]
                    got = structural.spans(ix, child)
                    raw = ix.data.tobytes()
                    fields: list[dict[str, str | None]] = [{} for _ in values]
                    rows = np.searchsorted(values, ix.parent[child])
                    for r, a, b, v in zip(rows.tolist(), ix.key_from[child].tolist(), ix.key_to[child].tolist(), got):
                        fields[r][raw[a:b].decode("utf-8", "replace")] = v
                    owner = ids.take(pa.array(ix.payload[values] + first))
                    cols = [pa.array(key[:, j].astype(np.int32)) for j in range(4)]
                    yield pa.RecordBatch.from_arrays([owner, *cols, pa.array([list(f.items()) for f in fields], pa.map_(pa.string(), pa.string())), pa.array(text_of, pa.string())], names=["record_id", *POSITIONS, "fields", "value"])

    ship(df.sparkSession)
    return df.select(F.col(record).cast("bigint").alias("record_id"), F.col(text).alias("text")).mapInArrow(work, "record_id bigint, repo_pos int, commit_pos int, file_pos int, line_pos int, fields map<string,string>, value string")
