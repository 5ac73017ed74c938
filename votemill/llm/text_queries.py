"""Queries on the corpus: spam pages, encoding, mixing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votemill.llm import bpe, mixing, prose
from votemill.llm import units as U
from votemill.llm.common import COUNTED, Shipped, map_batches, written
from votemill.session import checkpoint_dir, ship
from votemill.sources.tables import table


_COUNTS = "keys array<bigint>, n array<bigint>"


def _binary(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of a binary column as 32-bit numbers, where each value begins in them)."""
    offsets = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if a.buffers()[2] else np.zeros(0, np.uint8)
    return data.view("<u4"), (offsets - offsets[0]) // 4


def _as_binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


class _Counts:
    """Counts of a task: handed on when it ends or holds ``COUNTED`` keys, as one row of two arrays."""

    def __init__(self):
        self.parts: list[prose.Counted] = []
        self.held = 0

    def add(self, c: prose.Counted) -> bool:
        """Is it time to hand on what is there?"""
        self.parts.append(c)
        self.held += len(c[0])
        if self.held > 4 * COUNTED:
            self.parts = [prose.added(self.parts)]
            self.held = len(self.parts[0][0])
        return self.held > COUNTED

    def row(self) -> tuple[pa.Array, pa.Array]:
        k, n = prose.added(self.parts)
        self.parts, self.held = [], 0
        at = pa.array([0, len(k)], pa.int32())
        return pa.ListArray.from_arrays(at, pa.array(k, pa.int64())), pa.ListArray.from_arrays(at, pa.array(n, pa.int64()))


_KINDS = (pa.int64(), pa.int32(), pa.binary(), pa.bool_())


def _count_row(counts: _Counts, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in _KINDS[: len(names) - 2]), *counts.row()], names=names)


class SparkCorpus:
    """What ``prose.fit`` asks of the pages.

    The texts are read once, into a table of units (8 bytes each) in the shared folder; with the
    function words known, a second table holds 4 bytes a unit, and all later steps read that.
    What comes to the driver are the most frequent words, the counts of unit sequences (bounded,
    see ``prose.Grams``) and the bins of the percentiles.
    """

    def __init__(self, documents: DataFrame):
        def work(batches):
            counts = _Counts()
            for batch in batches:
                texts = batch.column(2).to_pylist()
                for first, block in U.blocks(texts):
                    raw, at = U.raw(U.Block(block))
                    none = pa.nulls(len(block), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(block)), batch.column(1).slice(first, len(block)), _as_binary(raw, at * 8), none, none], names=names)
                    counts.add(prose.word_keys(raw, at))
                if counts.held > COUNTED:
                    yield _count_row(counts, names)
            yield _count_row(counts, names)

        names = ["doc_id", "half", "units", "keys", "n"]
        half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")
        ship(documents.sparkSession)
        self.documents = documents
        self.raw = written(documents.select("doc_id", half.alias("half"), "text").mapInArrow(work, f"doc_id bigint, half int, units binary, {_COUNTS}"))

    @staticmethod
    def _added(rows: DataFrame) -> DataFrame:
        each = rows.where("keys is not null").select(F.inline(F.arrays_zip("keys", "n")))
        return each.groupBy(F.col("keys").alias("key")).agg(F.sum("n").alias("n"))

    def words(self) -> np.ndarray:
        top = self._added(self.raw).orderBy(F.desc("n"), "key").limit(prose.FUNCTION_WORDS)
        return np.array([r.key for r in top.collect()], np.int64)

    def pack(self, function: np.ndarray) -> None:
        """The table of packed pages; it carries the counts of the first step too."""
        names = ["doc_id", "half", "units", "train", "keys", "n"]

        def work(batches):
            f = prose.function_lookup(function)
            counts = _Counts()
            for batch in batches:
                raw, at = _binary(batch.column(2))
                raw, at = raw.reshape(-1, 2), at // 2
                train = U.repeats(raw, at) <= prose.REPEATS
                packed = prose.pack(raw, at, f)
                none = pa.nulls(len(batch), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _as_binary(packed, at * 4), pa.array(train), none, none], names=names)
                half = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                for where, p in prose.Pages(packed, at).take(train).slices():
                    if counts.add(prose.line_grams(p, half[where], ())):
                        yield _count_row(counts, names)
            yield _count_row(counts, names)

        pages = self.raw.where("keys is null").select("doc_id", "half", "units")
        self.packed = written(pages.mapInArrow(work, f"doc_id bigint, half int, units binary, train boolean, {_COUNTS}"))

    def count_rows(self, step: prose.Pass, models: tuple = ()) -> DataFrame:
        """The counts of a step over all pages that are trained on."""
        if step is prose.line_grams:
            return self._added(self.packed)
        shipped = Shipped(self.documents, models)

        def work(batches):
            known = shipped.get()
            counts = _Counts()
            for batch in batches:
                units, at = _binary(batch.column(1))
                half = batch.column(0).to_numpy().astype(np.int64)
                for where, p in prose.Pages(units, at).slices():
                    if counts.add(step(p, half[where], known)):
                        yield pa.RecordBatch.from_arrays(list(counts.row()), names=["keys", "n"])
            yield pa.RecordBatch.from_arrays(list(counts.row()), names=["keys", "n"])

        return self._added(self.packed.where("train").select("half", "units").mapInArrow(work, _COUNTS))

    def count(self, step: prose.Pass, models: tuple = ()) -> prose.Counted:
        return _arrays(self.count_rows(step, models), "key", "n")

    def grams(self, step: prose.Pass, models: tuple = ()) -> tuple[prose.Grams, ...]:
        """The counts of each half and of both (which 0, 1 and 2); of trigrams, those above a least count by which ``MOST_GRAMS`` of each remain."""
        rows = self.count_rows(step, models).select(F.shiftright("key", 36).cast("int").alias("which"), F.col("key").bitwiseAND((1 << 36) - 1).alias("key"), "n")
        both = rows.groupBy("key").agg(F.sum("n").alias("n")).select(F.lit(2).alias("which"), "key", "n")
        t = written(rows.unionByName(both))
        band = F.floor(F.log2("n") * 8).cast("int")
        cuts = [-1, -1, -1]
        held = [0, 0, 0]
        for r in sorted(t.groupBy("which", band.alias("band")).count().collect(), key=lambda r: -r.band):
            held[r.which] += r["count"]
            if held[r.which] > prose.MOST_GRAMS:
                cuts[r.which] = max(cuts[r.which], r.band)
        often = F.element_at(F.array(*map(F.lit, cuts)), F.col("which") + 1)
        w, key, n = _arrays(t.where(band > often), "which", "key", "n")
        cw, ctx, total, kinds = _arrays(t.groupBy("which", F.shiftright("key", 12).alias("key")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")), "which", "key", "n", "kinds")
        pw, pair, pair_n = _arrays(t.groupBy("which", F.col("key").bitwiseAND(0xFFFFFF).alias("key")).agg(F.sum("n").alias("n")), "which", "key", "n")
        return tuple(prose.Grams(key[w == i], n[w == i], ctx[cw == i], total[cw == i], kinds[cw == i], pair[pw == i], pair_n[pw == i]) for i in range(3))


def _arrays(df: DataFrame, *columns: str) -> tuple[np.ndarray, ...]:
    t = df.select(*[F.col(c).cast("bigint").alias(c) for c in columns]).toArrow()
    return tuple(t.column(c).to_numpy() for c in columns)


def fit_prose(documents: DataFrame) -> tuple[Shipped, SparkCorpus]:
    """The prose model of all pages, and the pages packed for it."""
    corpus = SparkCorpus(documents)
    return Shipped(documents, prose.fit(corpus)), corpus


def train_prose(documents: DataFrame) -> Shipped:
    return fit_prose(documents)[0]


def spam_shares(documents: DataFrame) -> DataFrame:
    """doc_id and the share of the page that is no prose, for every row; the texts are not read again."""
    model, corpus = fit_prose(documents)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        units, at = _binary(batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.get().page_shares(prose.Pages(units, at)))], names=["doc_id", "spam_share"])

    return map_batches(corpus.packed.where("keys is null").select("doc_id", "units"), work, "doc_id bigint, spam_share double")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the ids that byte_bpe_50k gives it."""
    return bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.sizes(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text")


def _planned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source and n_tokens of each document, the plan); both written once, as the encoding is dear and the plan (a row a source) is read by several steps."""
    checkpoint_dir(spark)
    sized = written(_sized(spark, sf_dir))
    return sized, mixing.plan(mixing.totals(sized), table(spark, sf_dir, "mix_targets")).checkpoint()


def _capped(p: DataFrame) -> DataFrame:
    """The sources that cannot fill all blocks the schedule gives them."""
    slot, frames = mixing.frame(p)
    return mixing.demand(p, frames, slot).where("not filled").select("source").distinct()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that leave blocks of the schedule empty: their target exceeds what their repeats can give."""
    return _capped(_planned(spark, sf_dir)[1])


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares really reached, by source, counted from the rows of the mixture."""
    sized, p = _planned(spark, sf_dir)
    return mixing.shares(p, mixing.mixture(sized, p), _capped(p)).withColumns({c: F.round(c, 9) for c in ("actual_share", "repeats")})


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture itself, in slots."""
    return mixing.mixture(*_planned(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that consist mainly of keywords, links, tags or offers."""
    return spam_shares(table(spark, sf_dir, "documents")).where(F.col("spam_share") > prose.MAINLY).select("doc_id")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each page that is no prose."""
    return spam_shares(table(spark, sf_dir, "documents"))


QUERIES = {"p7_ids": p7_ids, "p8_found": p8_found, "p8_shares": p8_shares, "p8_mix": p8_mix, "p9_found": p9_found, "p9_scores": p9_scores}
SQL: dict[str, str] = {}
