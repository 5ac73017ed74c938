"""Stratified samples of multi-label items.

Items with one set of labels are alike for the choice, so the choice is made over the distinct
sets and how many items each has: the label still wanted by the fewest items is served next,
by the set that serves the most wanted labels.  Within a set, items are taken in the order of
a seeded hash, so the sample is the same at every run.

Bound: the distinct label sets are held by the driver; more than ``MOST_SETS`` are refused.
Edge cases: items without labels fill up at the end; a size above the number of items takes all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_SETS = 100_000
SALTS = 64


def quotas(sets: list[tuple[tuple[str, ...], int]], size: int) -> dict[tuple[str, ...], int]:
    """How many items to take of each label set.

    While a label still wants items, the one that wants the fewest is served (ties: the rarest,
    then by name) by the set that serves the most wanted labels.  When none does, the rest is
    filled evenly: each set gives in proportion to what is left of it, by largest remainders.
    A step looks at the labels and at the sets with the label served.
    """
    left = dict(sets)
    total = sum(left.values())
    size = min(size, total)
    having: dict[str, list[tuple[str, ...]]] = {}
    there: dict[str, int] = {}
    for labels, n in sets:
        for l in labels:
            having.setdefault(l, []).append(labels)
            there[l] = there.get(l, 0) + n
    want = {l: size * n / total for l, n in there.items()} if total else {}
    out: dict[tuple[str, ...], int] = {}
    taken = 0
    while taken < size:
        wanted = [l for l, w in want.items() if w > 0 and there[l] > 0]
        if not wanted:
            break
        l = min(wanted, key=lambda x: (want[x], there[x], x))
        s = max((s for s in having[l] if left[s]), key=lambda s: (sum(max(0.0, want[x]) for x in s), -len(s), s))
        left[s] -= 1
        out[s] = out.get(s, 0) + 1
        taken += 1
        for x in s:
            want[x] -= 1
            there[x] -= 1
    rest, room = size - taken, sum(left.values())
    if rest and room:
        exact = {s: rest * n / room for s, n in left.items()}
        give = {s: int(x) for s, x in exact.items()}
        for s in sorted(exact, key=lambda s: (give[s] - exact[s], s)):
            if sum(give.values()) == rest:
                break
            give[s] += give[s] < left[s]
        for s, n in give.items():
            if n:
                out[s] = out.get(s, 0) + n
    return out


def stratified_sample(df: DataFrame, size: int, seed: int = 7, census: tuple[str, ...] = ()) -> DataFrame:
    """item, labels, in_census of a sample; ``df`` has item and labels (sorted arrays).

    Every item with a census label is in it; those beyond the size are refused.  The order of
    the rows says nothing: it is that of the hash.
    """
    rank = F.xxhash64(F.lit(seed), "item")
    rare = F.arrays_overlap("labels", F.array(*[F.lit(c) for c in census])) if census else F.lit(False)
    marked = df.select("item", "labels", F.coalesce(rare, F.lit(False)).alias("in_census"), rank.alias("__h"))
    taken = marked.where("in_census").count() if census else 0
    if taken > size:
        raise ValueError(f"{taken} items carry a census label; the sample has {size}")
    rest = marked.where("not in_census")
    counts = rest.groupBy("labels").agg(F.count(F.lit(1)).alias("n")).limit(MOST_SETS + 1).collect()
    if len(counts) > MOST_SETS:
        raise ValueError(f"more than {MOST_SETS} distinct label sets")
    q = quotas(sorted((tuple(r.labels or ()), r.n) for r in counts), size - taken)
    spark = df.sparkSession
    quota = spark.createDataFrame([(list(s), n) for s, n in q.items()], "labels array<string>, __q int") if q else spark.createDataFrame([], "labels array<string>, __q int")
    x = rest.join(F.broadcast(quota), "labels").withColumn("__s", F.pmod("__h", F.lit(SALTS)))
    w = lambda *k: Window.partitionBy(*k).orderBy("__h", "item")
    few = x.withColumn("__r", F.row_number().over(w("labels", "__s"))).where("__r <= __q")
    chosen = few.withColumn("__r", F.row_number().over(w("labels"))).where("__r <= __q").select("item", "labels", "in_census", "__h")
    return marked.where("in_census").unionByName(chosen).orderBy("__h").drop("__h")
