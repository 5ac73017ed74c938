"""Mixing sources to target weights, laid out by Pfair scheduling.

The size of a document is its tokens under a public tokenizer.  A source wants its target share
of the corpus's present total; it can give at most ``max_repeats`` times its own total, and
gives the smaller of the two.

The mixture is a sequence of frames, each of the same slots.  In a frame a source has blocks in
proportion to its target weight: block j of a source with weight w (blocks a slot) is released
at floor(j/w) and due at ceil((j+1)/w), and slots go to the released block that is due first.
With the weights adding up to one this order keeps every source within less than one block of
its share at each slot, and exactly at its share at the end of each frame.  The blocks of a
source that cannot give what it wants are filled in part, all alike (``filled``).

Scale: a frame has so many slots that the smallest share has ``LEAST_BLOCKS`` of them (at most
``MOST_SLOTS``, below which a share is one slot); the number of frames grows with the corpus,
so a block stays at ``BLOCK_TOKENS`` or less.  Documents find their block by prefix sums in two
steps: within buckets of a source, whose number grows with its documents, and over the buckets'
sums.  Repeats are rows made only where they are used.

Edge cases: a source without documents gives nothing and is capped if its share is above zero;
documents of a source that is no target, or of none, count for the total only; null and empty
texts have size 0, belong to the corpus and are never part of a mixture; letter case of a
source does not matter; a null share counts as 0, null repeats as 0; every source with a share
and a token is in the mixture.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votemill.functions.scalars import with_totals

LEAST_BLOCKS = 8
FEWEST_SLOTS = 256
MOST_SLOTS = 1 << 17
BLOCK_TOKENS = 1 << 16
BUCKET_DOCS = 50_000


def totals(sized: DataFrame) -> DataFrame:
    """source (lower case, may be null), docs, tokens; from a table of source and n_tokens."""
    return sized.groupBy(F.lower("source").alias("source")).agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("bigint").alias("tokens"))


def plan(sums: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: own and wanted tokens, and the most it can give.

    Both inputs are aggregates with a row a source; the corpus total is one row.
    """
    t = targets.groupBy(F.lower("source").alias("source")).agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats")).where("source is not null")
    total = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    own = sums.where("source is not null").select("source", "docs", "tokens")
    p = with_totals(t.join(own, "source", "left"), total).na.fill(0, ["docs", "tokens"])
    p = p.withColumn("wanted", F.col("target_share") * F.col("total")).withColumn("most", F.col("max_repeats") * F.col("tokens"))
    return p.withColumn("gives", F.least("wanted", F.col("most").cast("double")))


def release(j: int, w: Fraction) -> int:
    return int(j // w)


def deadline(j: int, w: Fraction) -> int:
    return -int(-(j + 1) // w)


def schedule(blocks: dict[str, int]) -> list[str]:
    """The source of each slot: earliest deadline first among released blocks; ties by source."""
    n = sum(blocks.values())
    weight = {s: Fraction(b, n) for s, b in blocks.items() if b}
    waiting = [(0, s, 0) for s in sorted(weight)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(n):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline(j, weight[s]), s, j))
        _, s, j = heapq.heappop(ready)
        out.append(s)
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, (release(j + 1, weight[s]), s, j + 1))
    return out


def slots_for(shares: dict[str, float]) -> int:
    """The slots of a frame: the smallest share has ``LEAST_BLOCKS``, if ``MOST_SLOTS`` allow."""
    total, least = sum(shares.values()), min((x for x in shares.values() if x > 0), default=1.0)
    return min(MOST_SLOTS, max(FEWEST_SLOTS, ceil(LEAST_BLOCKS * total / least)))


def apportion(shares: dict[str, float], slots: int) -> dict[str, int]:
    """Blocks of each source in a frame, by largest remainders; they add up to ``slots``, or a few more.

    A source with a share has a block, if need be one more than ``slots``: without one its
    documents would have no place.
    """
    total = sum(map(Fraction, shares.values()))
    if total <= 0:
        return {}
    exact = {s: Fraction(g) * slots / total for s, g in shares.items()}
    out = {s: int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[: slots - sum(out.values())]:
        out[s] += 1
    return {s: max(n, 1) if exact[s] > 0 else n for s, n in out.items()}


def frame(p: DataFrame, slots: int | None = None) -> tuple[DataFrame, int]:
    """(source and place of each slot of a frame: slot, source, block, blocks, slots; the number of frames).

    ``p`` is a plan; it has a row for each target source, and so does what is collected here.
    """
    rows = [r for r in p.select("source", "target_share", "wanted").collect() if r.target_share > 0]
    shares = {r.source: r.target_share for r in rows}
    order = schedule(apportion(shares, slots or slots_for(shares)))
    count: dict[str, int] = {}
    block = []
    for s in order:
        block.append(count.get(s, 0))
        count[s] = block[-1] + 1
    t = pa.table({"slot": pa.array(range(len(order)), pa.int64()), "source": pa.array(order, pa.string()), "block": pa.array(block, pa.int64()), "blocks": pa.array([count[s] for s in order], pa.int64()), "slots": pa.array([len(order)] * len(order), pa.int64())})
    frames = max(1, ceil(sum(r.wanted for r in rows) / max(1, len(order) * BLOCK_TOKENS)))
    return p.sparkSession.createDataFrame(t), frames


def demand(p: DataFrame, frames: int, slot: DataFrame) -> DataFrame:
    """Of each source's last blocks in the last frame, the tokens due by their end and the most it has: source, slot, due, most, filled.

    Demand grows from block to block, so what a source cannot fill shows in these.
    """
    at = (F.lit(frames - 1) * F.col("blocks") + F.col("block") + 1) / (F.lit(frames) * F.col("blocks"))
    d = slot.join(p.select("source", "wanted", "most"), "source").withColumn("due", F.col("wanted") * at)
    return d.select("source", "slot", "due", "most", (F.col("due") <= F.col("most")).alias("filled"))


def mixture(sized: DataFrame, p: DataFrame, slots: int | None = None) -> DataFrame:
    """The mixture: slot, source, doc_id, repeat (0 for the first use), n_tokens.

    Rows of one slot belong together; slots are in order.  A document takes the block in which
    its first token falls, so a source's blocks differ by less than one document.  ``p`` is
    ``plan(totals(sized), targets)``; sizes should be materialised before, as they are used twice.
    """
    slot, frames = frame(p, slots)
    places = slot.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("block", "slot"))), lambda x: x["slot"]).alias("places"), F.max("slots").alias("slots"))
    # A row a source: at most MOST_SLOTS places in all.
    small = p.where("gives > 0").select("source", F.col("tokens").alias("own"), "gives", F.ceil(F.col("docs") / BUCKET_DOCS).alias("buckets")).join(places, "source")
    docs = sized.select("doc_id", F.lower("source").alias("source"), "n_tokens").where("n_tokens > 0 and source is not null")
    mixed = F.xxhash64("doc_id")
    bucketed = docs.join(F.broadcast(small.select("source", "buckets")), "source").withColumn("bucket", F.pmod(mixed, F.col("buckets"))).drop("buckets")
    per = bucketed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = per.select("source", "bucket", (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = bucketed.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(before, ["source", "bucket"]).select("source", "doc_id", "n_tokens", (F.col("base") + F.col("inside")).alias("start"))
    used = placed.join(F.broadcast(small), "source").withColumn("last", F.ceil((F.col("gives") - F.col("start")) / F.col("own")).cast("int") - 1).where("last >= 0")
    copies = used.withColumn("repeat", F.explode(F.sequence(F.lit(0), "last")))
    n = F.size("places").cast("bigint")
    part = (F.col("start") + F.col("repeat") * F.col("own")) / F.col("gives")
    block = F.least(F.floor(part * (n * F.lit(frames))), n * F.lit(frames) - 1)
    at = F.floor(block / n) * F.col("slots") + F.element_at("places", (block % n + 1).cast("int"))
    return copies.select(at.alias("slot"), "source", "doc_id", "repeat", "n_tokens")


def shares(p: DataFrame, mixed: DataFrame, capped: DataFrame) -> DataFrame:
    """By source, what it has and what the rows of the mixture give: tokens_given, actual_share and repeats are counted, not planned."""
    given = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens_given"))
    total = given.agg(F.sum("tokens_given").alias("mixture"))
    x = with_totals(p.join(given, "source", "left").join(capped.select("source", F.lit(True).alias("capped")), "source", "left"), total).na.fill(0, ["tokens_given"]).na.fill(False, ["capped"])
    return x.select("source", "docs", "tokens", "target_share", "max_repeats", "capped", "tokens_given", F.try_divide("tokens_given", "mixture").alias("actual_share"), F.try_divide("tokens_given", "tokens").alias("repeats"))
