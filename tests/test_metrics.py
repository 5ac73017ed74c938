import math
import random
from itertools import combinations

import pytest

from votemill.operators import agreement as A
from votemill.operators import gold as G
from votemill.operators import votes as V


def votes(spark, table):
    return spark.createDataFrame([(i, f"r{k}", l) for i, row in enumerate(table) for k, l in enumerate(row)], "item int, rater string, label string")


def one(df):
    return df.collect()[0]


def brute_kappa(pairs):
    n = len(pairs)
    po = sum(a == b for a, b in pairs) / n
    pe = sum((sum(a == l for a, _ in pairs) / n) * (sum(b == l for _, b in pairs) / n) for l in {x for p in pairs for x in p})
    return 1.0 if pe >= 1 else (po - pe) / (1 - pe)


def test_random_tables_against_definitions(spark):
    rnd = random.Random(5)
    table = [[rnd.choice("abc") for _ in range(4)] for _ in range(40)]
    v = votes(spark, table)
    got = {(r.rater_a, r.rater_b): r.kappa for r in A.cohen(A.pair_counts(v)).collect()}
    for a, b in combinations(range(4), 2):
        assert got[f"r{a}", f"r{b}"] == pytest.approx(brute_kappa([(row[a], row[b]) for row in table]))
    f = one(A.fleiss(v))
    n, m = len(table), 4
    p = [sum(row.count(l) ** 2 for l in "abc") for row in table]
    obs = sum((x - m) / (m * (m - 1)) for x in p) / n
    exp = sum((sum(row.count(l) for row in table) / (n * m)) ** 2 for l in "abc")
    assert f.fleiss_kappa == pytest.approx((obs - exp) / (1 - exp))
    # Identity: 1 - alpha = (1 - kappa) (N m - 1) / (N m) for complete data.
    assert 1 - f.krippendorff_alpha == pytest.approx((1 - f.fleiss_kappa) * (n * m - 1) / (n * m))


def test_degenerate_tables(spark):
    same = one(A.fleiss(votes(spark, [["a", "a"]] * 3)))
    assert same.fleiss_kappa == 1.0 and same.krippendorff_alpha == 1.0
    assert one(A.cohen(A.pair_counts(votes(spark, [["a", "a"]] * 3)))).kappa == 1.0
    assert one(A.cohen(A.pair_counts(votes(spark, [["a", "a"], ["a", "b"]])))).kappa == 0.0
    assert one(A.full_agreement(votes(spark, []))).full_agreement is None
    assert A.cohen(A.pair_counts(votes(spark, [["a"], ["b"]]))).count() == 0
    blank = one(A.full_agreement(votes(spark, [["a", None], ["", None]])))
    assert blank.full_agreement == 0.5  # a missing label is the blank label


def test_entropy_is_never_minus_zero(spark):
    r = one(A.item_ambiguity(votes(spark, [["a", "a", "a"]])))
    assert r.entropy == 0.0 and math.copysign(1, r.entropy) == 1 and r.plurality == "a"
    assert one(A.item_ambiguity(votes(spark, [["b", "a"]]))).plurality == "a"


def test_jaccard_of_empty_sets(spark):
    df = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(V.jaccard(df.a, df.b)).collect()] == [1.0, 0.0, pytest.approx(1 / 3)]


def test_thirds_are_cut_by_position(spark):
    x = spark.createDataFrame([(f"i{k:02}", float(k), float(k)) for k in range(11)], "item string, category_divergence double, mean_error double")
    r = one(G.divergence_summary(x))
    assert (r.error_low, r.error_mid, r.error_high) == (1.0, 4.5, 8.5) and r.pearson == pytest.approx(1.0)
    const = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 3.0)], "item string, category_divergence double, mean_error double")
    assert one(G.divergence_summary(const)).pearson is None


def test_gold_labels_outside_the_list(spark):
    p = spark.createDataFrame([("m", "corrective", "corrective"), ("m", "additive", "nonsense"), ("m", "odd", "corrective")], "rater string, gold string, pred string")
    got = {r["class"]: r for r in G.single(p, G.LEAVES).collect()}
    assert (got["additive"].tp, got["additive"].fn) == (0, 1) and got["corrective"].fp == 1
    assert got["additive"].accuracy == pytest.approx(1 / 3)


def test_every_model_is_evaluated(spark, data):
    from pyspark.sql import functions as F

    from votemill.plans import catalogue
    from votemill.sources.tables import table

    r = table(spark, data, "recovered_20260714_204326").where("diff_id <> '' and primary_result.model is not null").select(F.col("diff_id").alias("item"), F.col("primary_result.model").alias("rater")).distinct()
    want = {tuple(x) for x in r.collect()}
    assert len({m for _, m in want}) > 3
    assert {(x.item, x.rater) for x in catalogue.QUERIES["latest_records_all"](spark, data).collect()} == want
    gold = {x.diff_id for x in table(spark, data, "gold_sheet").where("trim(diff_id) <> ''").collect()}
    rated = {m: len({i for i, k in want if k == m} & gold) for _, m in want}
    assert {x.rater: x["items"] for x in catalogue.QUERIES["gold_multilabel_overall_all"](spark, data).collect()} == {m: n for m, n in rated.items() if n}
