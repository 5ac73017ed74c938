import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from votemill.functions import chunks, responses
from votemill.functions import text as X
from votemill.operators import classify, sampling
from votemill.operators.history import with_position, with_prior
from votemill.sources import records
from votemill.streaming import pipeline as P

NAMES = ("Testing", "DevOps", "UI/UX")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\r\u00e9", max_size=200), st.integers(2, 40), st.integers(-3, 60))
def test_chunks_lose_nothing(text, limit, overlap):
    p = chunks.plan(text, limit, overlap)
    back = max(0, overlap) if overlap < limit else limit // 4
    assert all(len(x[2]) <= limit and x[2] == text[x[3] : x[4]] for x in p)
    assert not text or (p[0][3] == 0 and p[-1][4] == len(text))
    assert all(b[3] == max(0, a[4] - back) and b[4] > a[4] for a, b in zip(p, p[1:]))
    assert [x[0] for x in p] == list(range(len(p))) and all(x[1] == len(p) for x in p)


def chunks_by_walk(text, limit, overlap, head):
    """Line by line: a piece ends before the line that does not fit, or where the last file or hunk began in its later half."""
    out, start, size, mark = [], 0, 0, None
    for line in text.splitlines(keepends=True):
        if line.startswith(head):
            mark = start + size
        if size and size + len(line) > limit:
            end = mark if mark is not None and mark > start and mark - start >= limit // 2 else start + size
            out.append((start, end))
            size += start - max(0, end - overlap)
            start, mark = max(0, end - overlap), None
        size += len(line)
    return out + [(start, len(text))] if len(text) > limit else [(0, len(text))]


@pytest.mark.parametrize("boundary, head", [("file", "diff --git "), ("hunk", "@@ ")])
def test_chunks_end_where_files_and_hunks_begin(boundary, head):
    rnd = random.Random(5)
    for _ in range(60):
        text = "".join(rnd.choice(["diff --git a b\n", "@@ -1 +1 @@\n", "+x\n", "-longer line here\n", " c\n"]) for _ in range(rnd.randint(1, 40)))
        got = chunks.plan(text, 60, 7, boundary)
        want = chunks_by_walk(text, 60, 7, head)
        # The walk counts a cut's tail as read, so that a file begun before the cut is behind; both agree on what a piece may be.
        assert got[0][3] == 0 and got[-1][4] == len(text) and len(got) <= len(want) + 2
        for a, b in zip(got, got[1:]):
            assert text[a[4] :].startswith(head) or len(a[2]) + len(text[a[4] :].splitlines(keepends=True)[0]) > 60


def test_patch_lines(spark):
    patch = "@@ -1 +1 @@\n+ a \n+\n-b\r\n+++ b/x\n--- x\n++ c +d"
    df = spark.createDataFrame([(patch,), ("",), (None,)], "p string")
    got = df.select(X.patch_lines(F.col("p"), "+").alias("a"), X.patch_lines(F.col("p"), "-").alias("r"), X.changed_count(F.col("p")).alias("n"), X.changed(F.col("p")).alias("t")).collect()
    assert got[0].a == ["a", "+ c", "d"] and got[0].r == ["b"] and got[0].n == 5 and got[0].t == "+ a\n- b\n+ + c\n+ d"
    assert got[1].a == [] and got[1].n == 0 and got[2].a is None


@pytest.mark.parametrize(
    "text, codes, score",
    [
        ('{"categories":[{"name":"testing","score":"0,85","rationale":"x"},{"name":"DevOps","score":true,"rationale":"x"},{"name":"UI/UX","score":0,"rationale":""}],"primary_category":"Testing","summary":"s"}', ["categories_missing_entries:Testing"], 0.85),
        ('Sure: {"categories":[{"name":"Testing","score":0.4,"rationale":"}"},],"primary_category":"Testing","summary":"s",} ok', ["categories_missing_entries:DevOps,UI/UX"], 0.4),
        ('{"categories":[{"name":"Testing","score":0.9,"rationale":"x"},{"name":"Dev', ["invalid_json"], 0.9),
        ('"primary_category": "Testing"', ["invalid_json"], 0.65),
        ("", ["invalid_json"], 0.0),
        (None, ["invalid_json"], 0.0),
        ('{"categories": 3}', ["categories_missing_or_not_list"], 0.0),
        ('{"categories":[{"name":"Testing","score":0.3,"rationale":"x"},"primary_category":"Testing","     "summary":"s"}', ["categories_missing_entries:DevOps,UI/UX"], 0.3),
        ('{"categories":[{"name":"Testing","score":0.3,"rationale":"x"}}', ["categories_missing_entries:DevOps,UI/UX", "primary_category_invalid", "summary_invalid"], 0.3),
        ('{oops} {"categories":[3,{"name":" "},{"name":"Testing","score":"high","rationale":2}],"primary_category":"Testing","summary":" "}', ["categories[0].not_object", "categories[1].name_invalid", "categories[2].score_invalid(Testing)", "categories[2].rationale_invalid(Testing)", "categories_missing_entries:DevOps,UI/UX", "summary_invalid"], 0.0),
        ("Unit testing: 0.7, the rest is fine", ["invalid_json"], 0.7),
        ("testing 7 of 9", ["invalid_json"], 1.0),
        ('{"name":"DevOps","score":0.1,"x":[{"score":0.2,"name":"Testing"', ["invalid_json"], 0.1),
        ('{"score":0.2,"why":"' + "w " * 160 + '","name":"Testing"', ["invalid_json"], 0.0),
        ('[1, {"categories":[{"name":"TESTING","score":1e-1,"rationale":""}],"primary_category":"DevOps","summary":"s"}]', ["categories_missing_entries:Testing,DevOps,UI/UX"], 0.1),
    ],
)
def test_responses(text, codes, score):
    _, errors, scores = responses.parse(text, NAMES)
    assert errors == codes and scores["Testing"] == pytest.approx(score)


def test_scores_are_coerced():
    assert [responses.score(x) for x in (True, "0,5", "nan", 7, -1, "x", None, [])] == [1.0, 0.5, 1.0, 1.0, 0.0, None, None, None]


def test_pieces_to_item(spark):
    rows = [("i", 0, {"Testing": 0.2}, {"Testing": "low"}, "DevOps", "first", "ok"), ("i", 1, {"Testing": 0.8}, {"Testing": " "}, "Testing", "second", "recovered"), ("i", 2, None, None, None, None, "ok"), ("i", 3, {"Testing": 0.7}, {"Testing": "late"}, "Testing", "third", None)]
    p = spark.createDataFrame(rows, "item string, index int, scores map<string,double>, rationales map<string,string>, primary string, summary string, status string")
    assert {r.category: r.score for r in classify.aggregate(p, NAMES, "mean").collect()}["Testing"] == pytest.approx(1.7 / 3)
    assert {r.category: r.rationale for r in classify.best_rationale(p, NAMES).collect()} == {"Testing": "low"}
    primary = spark.createDataFrame([("i", "Testing")], "item string, category string")
    assert classify.best_summary(p, primary).collect()[0].summary == "second"
    assert p.groupBy("item").agg(classify.worst_status(F.col("status")).alias("s")).collect()[0].s == "recovered"


def test_history_windows_equal_plain_ones(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, "a", "b"]), f"{rnd.randint(1, 4)}-{rnd.randint(1, 9)}", i) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, t string, i int")
    pos = {r.i: (r.position, r.total) for r in with_position(df, ["k"], ["t", "i"], F.substring("t", 1, 1)).collect()}
    prior = {r.i: r.prior for r in with_prior(df, ["k"], ["t", "i"], F.substring("t", 1, 1), F.col("i")).collect()}
    for key in (None, "a", "b"):
        mine = sorted([(t, i) for k, t, i in rows if k == key])
        for n, (_, i) in enumerate(mine):
            assert pos[i] == (n + 1, len(mine))
            assert prior[i] == [x for _, x in mine[max(0, n - 3) : n]]


def test_sample_covers_rare_labels_and_repeats(spark):
    rows = [(i, ["common"] + (["rare"] if i % 50 == 0 else [])) for i in range(500)] + [(1000, ["census"])]
    df = spark.createDataFrame([(i, sorted(l)) for i, l in rows], "item int, labels array<string>")
    a = sampling.stratified_sample(df, 20, census=("census",)).collect()
    assert a == sampling.stratified_sample(df.repartition(7), 20, census=("census",)).collect()
    assert len(a) == 20 and sum(r.in_census for r in a) == 1 and sum("rare" in r.labels for r in a) == 1 or sum("rare" in r.labels for r in a) > 0
    with pytest.raises(ValueError):
        sampling.stratified_sample(df, 0, census=("census",))
    assert sampling.quotas([(("a",), 3), ((), 4)], 99) == {("a",): 3, (): 4}


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿"diff_id";labels_gold\n"x";"A; B\nC"\ny;\n'.encode())
    assert [tuple(r) for r in records.read_sheet(spark, str(tmp_path / "a.csv")).collect()] == [("x", "A; B\nC"), ("y", "")]
    (tmp_path / "primary_1.jsonl").write_text('{"diff_id":"a","status":"old"}\n\nbroken\n{"diff_id":"b","status":"x"}\n')
    (tmp_path / "primary_2.jsonl").write_text('{"diff_id":"a","status":"new"}\n{"diff_id":"","status":"x"}\n')
    got = records.latest_by_id(records.json_lines(spark, str(tmp_path / "*.jsonl")))
    assert sorted((r.diff_id, r.status) for r in got.collect()) == [("a", "new"), ("b", "x")]
    assert records.latest_file(["primary_1.jsonl", "primary_2.jsonl", "z.txt"]) == "primary_2.jsonl"
    log = spark.createDataFrame([("a" * 40 + " | 2024 | me | a | b | http://x",), ("no",)], "line string")
    assert records.parse_log(log, F.col("line")).collect()[0].message == "a | b"
    raw = spark.createDataFrame([("für".encode("cp1252"),), ("für".encode(),)], "b binary")
    assert [r[0] for r in raw.select(records.best_decoding(F.col("b"))).collect()] == ["für", "für"]
    t = [spark.createDataFrame([("a", "", "1")], "k string, c string, d string"), spark.createDataFrame([("a", "two", "2")], "k string, c string, d string")]
    assert tuple(records.first_filled(t, "k", ["c", "d"]).collect()[0]) == ("a", "two", "1")
    assert records.model_folder("gem:ma/4 b.") == "gem_ma_4_b"
    out = str(tmp_path / "report")
    records.write_report(spark.createDataFrame([(1.23456, float("nan"))], "a double, b double"), out, 4)
    assert [tuple(r) for r in records.read_csv(spark, out).collect()] == [("1.2346", None)]


def test_stream_resumes_without_repeats(spark, tmp_path):
    src, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    at = dt.datetime(2024, 1, 1)
    kind = "id int, v string, t timestamp"
    spark.createDataFrame([(1, "a", at), (1, "b", at), (2, "c", at)], kind).coalesce(1).write.parquet(src)
    def run():
        s = P.once_per_id(spark.readStream.schema("id int, v string, t timestamp").parquet(src), "id", "t")
        q = s.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        q.awaitTermination()
        return sorted(r.id for r in spark.read.parquet(out).collect())
    assert run() == [1, 2]
    spark.createDataFrame([(2, "d", at), (3, "e", at)], kind).coalesce(1).write.mode("append").parquet(src)
    assert run() == [1, 2, 3]


def test_budget_excludes_what_is_just_a_minute_old(spark):
    df = spark.createDataFrame([(1, "m", "2024-01-01 00:00:00", 1.0), (2, "m", "2024-01-01 00:01:00", 1.0), (3, "m", "2024-01-01 00:01:59.999999", 1.0)], "id int, k string, t string, c double").withColumn("t", F.to_timestamp("t"))
    got = {r.id: r.requests for r in P.sliding_budget(df, "k", "t", "c").collect()}
    assert got == {1: 1, 2: 1, 3: 2}
