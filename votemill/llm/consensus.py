"""Consensus of annotators who disagree, by message passing on the graph of items and annotators.

Every rating is an edge.  An item sends each of its annotators what the others say about its
category; an annotator sends each of its items what its answers elsewhere say about the label
it gave: for each category against the rest, the log of how often it gives this label where
the category holds, over how often where it does not.  Neither message contains what came in
on the same edge.  Messages go to and fro until they settle: until of a message's mass less
than ``SETTLED`` moves in a round, on average.  A run that has not settled after ``MOST_ROUNDS``
says so (a warning, and ``settled`` beside every reliability).

Annotators that share their mistakes count less: after a first run, the share of mistakes that
two have in common beyond what their habits explain is measured, and an annotator's messages
are divided by one plus its sum; then the messages run again.

Scale: an item's edges lie in one row, so an item's messages are made where the row is; what
crosses the network are sums over items (annotators x categories x labels), added up in Spark.
The messages of a round (a small number for each edge and category) are a table in the shared
folder: a round reads the last one and writes the next, so work grows with the rounds and no
further, and lineage stays short; the one before is removed.

Bounds: annotators are models or persons of one project; their sums are held by the driver and
sent to the tasks, and more than ``MOST_ANNOTATORS`` (8 MB of sums) are refused.  Edge cases: of several ratings of an item by one
annotator the latest valid one counts (ties: the smaller label); a rating without a known
category counts if its scores name one; failed ratings count only for items without a valid
one, and an item without any label gets the most usual category, with 0 votes; an item with
one rating has the category that the annotator's habits suggest; rows without diff_id are none.
"""

from __future__ import annotations

import uuid
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votemill.llm.common import map_batches
from votemill.operators.gold import CATEGORIES
from votemill.session import checkpoint_dir, ship

MOST_ROUNDS = 60
FIRST = 3  # rounds before the dependence of annotators is measured
SETTLED = 0.0002  # share of a message's mass that may still move when the messages stop
SMOOTH = 0.3
DIAGONAL = 0.5
SHARED = 0.1  # common mistakes below this are taken for chance
MOST_ANNOTATORS = 4096

def _key(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit("and")), "[^a-z0-9]", "")


def label_of(category: Column, scores: Column) -> Column:
    """The index of a rating's category: as written, whatever its case and signs; else of its highest score above zero."""
    key = [c.lower().replace("&", "and") for c in CATEGORIES]
    index = F.create_map(*[F.lit(x) for i, k in enumerate(key) for x in ("".join(ch for ch in k if ch.isalnum()), i)])
    entries = F.filter(F.map_entries(scores), lambda e: (e["value"] > 0) & ~F.isnan(e["value"]) & F.map_contains_key(index, _key(e["key"])))
    best = F.array_min(F.transform(entries, lambda e: F.struct((-e["value"]).alias("s"), F.try_element_at(index, _key(e["key"])).alias("i"))))["i"]
    return F.coalesce(F.try_element_at(index, _key(category)), best)


def votes(ratings: DataFrame) -> DataFrame:
    """diff_id, annotator, label, valid: one row per item and annotator, the latest valid rating, else the latest failed one.

    Reruns meet in partial aggregation before the shuffle, so an item rated very often is no
    hot group.
    """
    label = label_of(F.col("primary_result.primary_category"), F.col("category_scores"))
    failed = F.col("primary_result.error").isNotNull() | (F.coalesce("status", F.lit("")) == "fallback")
    rows = ratings.where("diff_id is not null").select("diff_id", F.col("primary_result.model").alias("annotator"), label.alias("label"), failed.alias("failed"), "recorded_at")
    last = rows.groupBy("diff_id", "annotator").agg(F.max(F.struct((F.col("label").isNotNull() & ~F.col("failed")).alias("valid"), F.col("label").isNotNull(), "recorded_at", (-F.col("label")).alias("m"))).alias("x"))
    return last.select("diff_id", "annotator", (-F.col("x.m")).alias("label"), F.col("x.valid").alias("valid"))


def by_item(v: DataFrame, annotators: list[str]) -> DataFrame:
    """diff_id and its edges; the list is at most as long as there are annotators.

    Failed ratings are edges only of items that have no other; an item without any label has no edges.
    """
    place = F.create_map(*[F.lit(x) for i, a in enumerate(annotators) for x in (a, i)]) if annotators else F.lit(None).cast("map<string,int>")
    edge = F.when(F.col("label").isNotNull() & F.col("annotator").isNotNull(), F.struct(F.try_element_at(place, "annotator").alias("a"), F.col("label").alias("l"), F.col("valid").alias("v")))
    every = v.groupBy("diff_id").agg(F.sort_array(F.collect_list(edge)).alias("every"))
    valid = F.filter("every", lambda e: e["v"])
    chosen = F.when(F.size(valid) > 0, valid).otherwise(F.col("every"))
    return every.select("diff_id", F.transform(chosen, lambda e: F.struct(e["a"].alias("a"), e["l"].alias("l"))).alias("edges"))


class Edges:
    """A batch of items as arrays: one entry per edge."""

    def __init__(self, column: pa.ListArray):
        flat = column.flatten()
        self.count = np.diff(column.offsets.to_numpy()).astype(np.int64)
        self.item = np.repeat(np.arange(len(column)), self.count)
        self.a = flat.field(0).to_numpy().astype(np.int64)
        self.l = flat.field(1).to_numpy().astype(np.int64)
        self.n = len(column)

    def per_item(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, x.shape[1]))
        some = np.flatnonzero(self.count)
        if len(some):
            out[some] = np.add.reduceat(x, (np.cumsum(self.count) - self.count)[some], axis=0)
        return out


def first_messages(e: Edges, c: int) -> np.ndarray:
    """Item to annotator before any reliability is known: the shares of all votes of the item."""
    one = np.zeros((len(e.a), c))
    one[np.arange(len(e.a)), e.l] = 1.0
    q = e.per_item(one) + 0.05
    return (q / q.sum(1, keepdims=True))[e.item]


def next_messages(e: Edges, q: np.ndarray, s: "Sums", weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item to annotator messages of the next round, belief of each item)."""
    c = q.shape[1]
    joint = s.joint[e.a, :, e.l] - q  # of this annotator and label, by category, without this edge
    mass = s.joint.sum(2)[e.a] - q
    label = (s.joint.sum(1)[e.a, e.l] - 1.0)[:, None]
    total = (s.joint.sum((1, 2))[e.a] - 1.0)[:, None]
    share = s.joint.sum((0, 1)) / max(s.joint.sum(), 1e-9)
    base = SMOOTH * c * share[e.l][:, None]
    own = DIAGONAL * (np.arange(c)[None, :] == e.l[:, None])
    yes = (np.maximum(joint, 0) + base + own) / (np.maximum(mass, 0) + SMOOTH * c + DIAGONAL)
    no = (np.maximum(label - joint, 0) + base) / (np.maximum(total - mass, 0) + SMOOTH * c)
    w = (np.log(yes + 1e-12) - np.log(no + 1e-12)) * weight[e.a][:, None]
    prior = np.clip(s.joint.sum((0, 2)) / max(s.joint.sum(), 1e-9), 1e-6, 1 - 1e-6)
    odds = np.log(prior / (1 - prior))[None, :]
    all_in = e.per_item(w)
    z = all_in[e.item] - w + odds
    out = np.exp(z - z.max(1, keepdims=True))
    belief = np.exp((all_in + odds) - (all_in + odds).max(1, keepdims=True))
    return out / out.sum(1, keepdims=True), belief / belief.sum(1, keepdims=True)


class Sums:
    """What annotators know: ``joint[a, category, label]``, the expected number of items."""

    def __init__(self, joint: np.ndarray):
        self.joint = joint


_STATE = "diff_id string, edges array<struct<a:int,l:int>>, q binary, k array<int>, v array<double>"


def _messages(a: pa.Array, c: int) -> np.ndarray:
    """The messages of a batch's edges, in order."""
    at = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8)[at[0] : at[-1]] if a.buffers()[2] else np.zeros(0, np.uint8)
    return data.view("<f4").reshape(-1, c).astype(np.float64)


def _joint(e: Edges, q: np.ndarray, a: int, c: int) -> np.ndarray:
    """What a batch adds to the annotators' sums."""
    cell = e.a * c + e.l
    return np.stack([np.bincount(cell, q[:, k], a * c) for k in range(c)], axis=1).reshape(a, c, c).transpose(0, 2, 1).reshape(-1)


class State:
    """The messages of a round, as a table of items, and the annotators' sums that follow from them."""

    def __init__(self, df: DataFrame, path: str, a: int, c: int):
        self.path = path
        self.items = df.where("k is null")
        t = df.where("k is not null").select(F.inline(F.arrays_zip("k", "v"))).groupBy("k").agg(F.sum("v").alias("v")).toArrow()
        flat = np.zeros(a * c * c + 2)
        flat[t.column("k").to_numpy()] = t.column("v").to_numpy()
        self.sums = Sums(flat[:-2].reshape(a, c, c))
        self.moved = float(flat[-2] / max(flat[-1], 1.0))  # share of the mass of a message that the round moved


def _round(rows: DataFrame, weight: np.ndarray, a: int, c: int, last: State | None) -> State:
    """The first messages of ``rows`` (diff_id, edges), or those that follow from the last state."""
    sums = last.sums if last else None

    def work(batches):
        total = np.zeros(a * c * c + 2)
        for batch in batches:
            e = Edges(batch.column(1))
            old = _messages(batch.column(2), c) if sums is not None else None
            q = next_messages(e, old, sums, weight)[0] if sums is not None else first_messages(e, c)
            q = q.astype(np.float32).astype(np.float64)
            total[:-2] += _joint(e, q, a, c)
            total[-2] += np.abs(q - old).sum() / 2 if old is not None else len(q)
            total[-1] += len(q)
            at = np.append(0, np.cumsum(e.count)).astype(np.int32) * np.int32(4 * c)
            blob = pa.Array.from_buffers(pa.binary(), e.n, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(q.astype("<f4")))])
            pairs = pa.StructArray.from_arrays([pa.array(e.a, pa.int32()), pa.array(e.l, pa.int32())], fields=list(_EDGE))
            edges = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(e.count)), pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([batch.column(0), edges, blob, pa.nulls(e.n, pa.list_(pa.int32())), pa.nulls(e.n, pa.list_(pa.float64()))], names=_NAMES)
        keep = np.flatnonzero(total)
        one = pa.array([0, len(keep)], pa.int32())
        edges = pa.nulls(1, pa.list_(_EDGE))
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), edges, pa.nulls(1, pa.binary()), pa.ListArray.from_arrays(one, pa.array(keep.astype(np.int32))), pa.ListArray.from_arrays(one, pa.array(total[keep]))], names=_NAMES)

    spark = rows.sparkSession
    ship(spark)
    path = f"{checkpoint_dir(spark)}/messages-{uuid.uuid4().hex}"
    rows.mapInArrow(work, _STATE).write.option("compression", "zstd").parquet(path)
    return State(spark.read.schema(_STATE).parquet(path), path, a, c)


_NAMES = ["diff_id", "edges", "q", "k", "v"]
_EDGE = pa.struct([("a", pa.int32()), ("l", pa.int32())])


def _remove(spark, path: str) -> None:
    """A round's table that no later step reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _dependence(state: State, weight: np.ndarray, a: int, c: int) -> np.ndarray:
    """By annotator, the sum of its shares of mistakes in common with others beyond their habits, as shares of the mistakes of the one with fewer.

    Only pairs that met on an item are counted; an item's pairs are as many as its annotators allow.
    """
    sums_now = state.sums
    joint = sums_now.joint + 0.01
    habit = joint / joint.sum(2, keepdims=True)

    def work(batches):
        keys, sums = np.zeros(0, np.int64), np.zeros((0, 4))
        for batch in batches:
            e = Edges(batch.column(1))
            belief = next_messages(e, _messages(batch.column(2), c), sums_now, weight)[1]
            truth = belief.argmax(1)[e.item]
            begin = np.repeat(np.cumsum(e.count) - e.count, e.count)
            width = int(e.count.max()) if e.n else 0
            found, values = [keys], [sums]
            for step in range(1, width):  # each edge with the one so many places on
                i = np.flatnonzero(np.arange(len(e.a)) + step < begin + e.count[e.item])
                j = i + step
                x, y = np.minimum(e.a[i], e.a[j]), np.maximum(e.a[i], e.a[j])
                wi, wj = e.l[i] != truth[i], e.l[j] != truth[j]
                t = truth[i]
                chance = (habit[x, t] * habit[y, t]).sum(1) - habit[x, t, t] * habit[y, t, t]
                low = np.where(e.a[i] <= e.a[j], wi, wj)
                high = np.where(e.a[i] <= e.a[j], wj, wi)
                found.append(x * a + y)
                values.append(np.stack([wi & wj & (e.l[i] == e.l[j]), chance, low, high], axis=1).astype(float))
            k, at = np.unique(np.concatenate(found), return_inverse=True)
            v = np.concatenate(values)
            keys, sums = k, np.stack([np.bincount(at, v[:, n], len(k)) for n in range(4)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(sums[:, n]) for n in range(4)]], names=["k", "alike", "chance", "low", "high"])

    ship(state.items.sparkSession)
    rows = state.items.mapInArrow(work, "k bigint, alike double, chance double, low double, high double").groupBy("k").agg(*[F.sum(n).alias(n) for n in ("alike", "chance", "low", "high")])
    t = rows.toArrow()
    k, alike, chance, low, high = (t.column(n).to_numpy() for n in ("k", "alike", "chance", "low", "high"))
    fewer = np.minimum(low, high)
    excess = np.where(fewer > 5, (alike - chance) / np.maximum(fewer - chance, 1.0), 0.0)
    excess = np.where(excess > SHARED, np.minimum(excess, 1.0), 0.0)
    return np.bincount(k // a, excess, a) + np.bincount(k % a, excess, a)


class Consensus:
    """The result: the last state, weights of the annotators, the annotators by name, rounds and whether they settled."""

    def __init__(self, annotators: list[str], state: State, weight: np.ndarray, rounds: int, settled: bool):
        self.annotators, self.state, self.weight, self.rounds, self.settled = annotators, state, weight, rounds, settled


def run(items: DataFrame, annotators: list[str]) -> Consensus:
    """Messages until they settle; ``items`` is diff_id and edges."""
    a, c = len(annotators), len(CATEGORIES)
    if a > MOST_ANNOTATORS:
        raise ValueError(f"{a} annotators; the sums of at most {MOST_ANNOTATORS} are held")
    spark = items.sparkSession
    weight = np.ones(a)
    first = state = _round(items.select("diff_id", "edges"), weight, a, c, None)
    for _ in range(FIRST - 1):
        state = _step(state, weight, a, c, keep=first)
    weight = 1 / (1 + _dependence(state, weight, a, c))
    _remove(spark, state.path)
    state, rounds, settled = first, 0, a == 0
    while rounds < MOST_ROUNDS and not settled:
        state = _step(state, weight, a, c)
        rounds += 1
        settled = state.moved < SETTLED
    if not settled:
        warnings.warn(f"messages still move by {state.moved:.5f} after {rounds} rounds", stacklevel=2)
    return Consensus(annotators, state, weight, rounds, settled)


def _step(state: State, weight: np.ndarray, a: int, c: int, keep: State | None = None) -> State:
    """One round; the state before is removed unless it is to be kept."""
    new = _round(state.items.select("diff_id", "edges", "q"), weight, a, c, state)
    if state is not keep:
        _remove(state.items.sparkSession, state.path)
    return new


def categories(result: Consensus) -> DataFrame:
    """diff_id, category, confidence, votes, agreement (share of votes for the category), entropy of the votes in bits."""
    c = len(CATEGORIES)
    sums, weight = result.state.sums, result.weight

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = Edges(batch.column(1))
        belief = next_messages(e, _messages(batch.column(2), c), sums, weight)[1]
        one = np.zeros((len(e.a), c))
        one[np.arange(len(e.a)), e.l] = 1.0
        n = e.per_item(one)
        best = belief.argmax(1)
        p = n / np.maximum(n.sum(1, keepdims=True), 1)
        bits = -(p * np.log2(np.where(p > 0, p, 1))).sum(1) + 0.0
        rows = np.arange(e.n)
        cols = [pa.array([CATEGORIES[i] for i in best], pa.string()), pa.array(belief[rows, best]), pa.array(n.sum(1).astype(np.int32)), pa.array(p[rows, best]), pa.array(bits)]
        return pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["diff_id", "category", "confidence", "votes", "agreement", "entropy"])

    return map_batches(result.state.items.select("diff_id", "edges", "q"), work, "diff_id string, category string, confidence double, votes int, agreement double, entropy double")


def reliability(spark, result: Consensus) -> DataFrame:
    """annotator, ratings, reliability (expected share of right answers), weight, and the rounds and whether they settled."""
    rows = []
    for i, name in enumerate(result.annotators):
        j = result.state.sums.joint[i]
        rows.append((name, float(j.sum()), float(np.trace(j) / max(j.sum(), 1e-9)), float(result.weight[i]), result.rounds, result.settled))
    return spark.createDataFrame(rows, "annotator string, ratings double, reliability double, weight double, rounds int, settled boolean")
