"""Readers, label spaces, sinks and stores."""

import json

import pytest
from pyspark.sql import functions as F

from votemill.functions import outcomes as O
from votemill.sources import records, taxonomy
from votemill.streaming import pipeline as P


def test_line_numbers_are_those_of_the_file(spark, tmp_path):
    for name, n in (("a.txt", 5000), ("b.txt", 37)):
        (tmp_path / name).write_text("".join(f"{i}\n" for i in range(1, n + 1)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000b")
    try:
        t = records.text_lines(spark, str(tmp_path))
        assert t.rdd.getNumPartitions() > 1
        got = t.select("value", "line", F.regexp_extract("file", "([ab]).txt$", 1).alias("f")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 5037 and all(int(r.value) == r.line for r in got)


def test_runs_and_diffs_by_extension(spark, tmp_path):
    lines = lambda *rows: "".join(x if isinstance(x, str) else json.dumps(x) + "\n" for x in rows)
    (tmp_path / "primary_1.jsonl").write_text(lines({"diff_id": "a", "status": "ok"}, "\n", "{no\n", {"diff_id": " "}, {"diff_id": "a", "status": "late"}))
    (tmp_path / "primary_2.jsonl").write_text(lines({"diff_id": "b", "status": "ok"}))
    (tmp_path / "other.json").write_text("[]")
    assert [x.rsplit("/", 1)[1] for x in records.inputs(spark, str(tmp_path))] == ["other.json", "primary_1.jsonl", "primary_2.jsonl"]
    assert {(r.diff_id, r.status) for r in records.run_records(spark, str(tmp_path)).collect()} == {("a", "late"), ("b", "ok")}
    assert {r.diff_id for r in records.run_records(spark, str(tmp_path), "1").collect()} == {"a"}
    with pytest.raises(FileNotFoundError):
        records.run_records(spark, str(tmp_path), "9")
    with pytest.raises(Exception):
        records.json_lines(spark, str(tmp_path / "primary_1.jsonl"), strict=True).collect()
    (tmp_path / "d.jsonl").write_text(lines({"commit_hash": "h", "filename": "f", "patch": "+x"}, {"diff_id": "i", "diff_text": "+y"}, {"commit_hash": "h", "patch": ""}, {"patch": "+z"}))
    schema = "repo string, hash string, acf_commits array<struct<hash:string,acf_files:array<struct<filename:string,patch:string>>>>, acf_files array<struct<filename:string,patch:string>>"
    assert {(r.diff_id, r.patch) for r in records.diffs(spark, str(tmp_path / "d.jsonl"), schema).collect()} == {("h:f", "+x"), ("i", "+y"), (":4", "+z")} or {r.patch for r in records.diffs(spark, str(tmp_path / "d.jsonl"), schema).collect()} == {"+x", "+y", "+z"}
    files = [{"filename": "f", "patch": "+x"}, {"filename": "g", "patch": ""}]
    for name, data, repo in (("one", {"repo": "r", "acf_commits": [{"hash": "h", "acf_files": files}]}, "r"), ("list", [{"repo": "r", "acf_commits": [{"hash": "h", "acf_files": files}]}], "r"), ("flat", [{"hash": "h", "acf_files": files}], None)):
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
        assert [tuple(r) for r in records.diffs(spark, str(tmp_path / f"{name}.json"), schema).collect()] == [(repo, "h:f", "h", "f", "+x")]


def test_label_spaces_from_files(spark, tmp_path):
    (tmp_path / "c.json").write_text("﻿" + json.dumps({"categories": [{"name": "A", "description": "d", "examples": ["x", "y"]}, "B", {"name": " "}, "B"]}), "utf-8")
    assert [tuple(r) for r in taxonomy.categories(spark, str(tmp_path / "c.json")).collect()] == [(0, "A", "d", "Ex.1: x | Ex.2: y"), (1, "B", "", "")]
    (tmp_path / "m.json").write_text(json.dumps({"maintenance_classes": [{"name": "K", "leaf_types": ["q"]}], "maintenance_types": [{"name": "p", "class": "C", "base_type": "b"}, {"name": "q"}]}))
    types = taxonomy.maintenance(spark, str(tmp_path / "m.json"))
    assert [tuple(r)[1:4] for r in types.collect()] == [("p", "C", "b"), ("q", "K", "q")]
    df = spark.createDataFrame([("p",), ("z",), (None,)], "leaf string")
    assert {(r.leaf, r.looked_class, r.looked_base) for r in taxonomy.looked_up(df, F.col("leaf"), types).collect()} == {("p", "C", "b"), ("z", "", "z"), (None, "", "")}
    assert taxonomy.categories(spark).count() == 16 and taxonomy.maintenance(spark).count() == 6


def test_stores(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "i int, x double")
    assert records.publish(df, path).count() == 2
    assert records.publish(spark.read.parquet(path).where("i = 2"), path).collect()[0].i == 2  # made from what it replaces
    records.snapshot(spark, path, f"file://{tmp_path}/copy")
    assert spark.read.parquet(f"file://{tmp_path}/copy").count() == 1 and records.exists(spark, path) and not records.exists(spark, path + "x")
    made = []
    for _ in range(2):
        got = records.cached(spark, "r", [f"file://{tmp_path}/first", f"file://{tmp_path}"], lambda: made.append(1) or df)
    assert got.count() == 2 and made == [1]
    assert records.cached(spark, "t", [f"file://{tmp_path}/first", f"file://{tmp_path}"], None).count() == 1
    records.write_summary(df, f"{tmp_path}/s")
    assert {r.x for r in spark.read.schema("i int, x double").json(f"{tmp_path}/s").collect()} == {None, 0.5}
    records.write_nested(spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int"), ["k"], f"{tmp_path}/n")
    assert spark.read.json(f"{tmp_path}/n").collect()[0].rows[1].v == 2
    raw = spark.createDataFrame([("﻿é".encode("utf-8"),), (b"caf\xe9 \x93",), (b"\x81\xe9",)], "b binary")
    assert [r[0] for r in raw.select(records.best_decoding(F.col("b"))).collect()] == ["é", "café “", "\x81é"]
    records.write_report(spark.createDataFrame([(0.12345,)], "a double"), f"{tmp_path}/csv", 4)
    assert records.read_csv(spark, f"{tmp_path}/csv").collect()[0].a == "0.1234"  # half to even


def test_replay_gives_what_is_stored_first(spark, tmp_path):
    src, store = f"{tmp_path}/in", f"file://{tmp_path}/store"
    kind = "id int, v string"
    spark.createDataFrame([(1, "a"), (1, "b"), (None, "n")], kind).coalesce(1).write.parquet(src)
    run = lambda: {(r.id, r.replayed) for r in P.run_replay(spark.readStream.schema(kind).parquet(src), "id", store).collect()}
    assert run() == {(1, False)}
    spark.createDataFrame([(1, "c"), (2, "d")], kind).coalesce(1).write.mode("append").parquet(src)
    assert run() == {(1, True), (2, False)} and run() == {(1, True), (2, True)}


def test_answers_as_they_are_shown(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).collect()[0].x
    lit = F.lit
    lists = ['{"logprobs": [-0.1, {"logprob": -0.2}, "x"]}', '{"logprobs": {"token_logprobs": [-1]}}', '{"message": {"logprobs": [{"log_prob": -3}]}}', '{"logprobs": []}', "no", None]
    assert [one(O.logprobs(lit(x).cast("string"))) for x in lists] == [[-0.1, -0.2], [-1.0], [-3.0], None, None, None]
    assert [one(O.access(lit(a), lit(b), lit(c))) for a, b, c in ((200, False, False), (404, False, True), (404, True, True), (404, True, False))] == ["public_repo", "owner_not_found", "access_denied_or_private", "repo_missing_or_private"]
    assert json.loads(one(O.prompt(lit("i"), lit(None).cast("string"), lit("m"), lit("+x")))) == {"diff_id": "i", "filename": "", "commit_message": "m", "diff": "+x"}
    commits = spark.createDataFrame([([(("old", ("a", "1"), None),), (("head\nbody", (None, ""), ("c", "2")),)],), ([],), (None,)], "c array<struct<commit:struct<message:string,author:struct<name:string,date:string>,committer:struct<name:string,date:string>>>>")
    assert [tuple(r.x) for r in commits.select(O.last_commit(F.col("c")).alias("x")).collect()] == [("head", "c", "2"), ("", "", ""), ("", "", "")]
    schema = O.answer_schema(("A", "B"), ("t",))
    assert schema["properties"]["primary_category"]["enum"] == ["A", "B"] and "maintenance" not in schema["required"] and "maintenance" not in O.answer_schema(("A",))["properties"]
    assert [one(O.prefilled(lit(x))) for x in ('"a": 1}', ' {"a": 1}')] == ['{"a": 1}', ' {"a": 1}']
    assert [one(O.back_off(lit(k))) for k in (0, 1, 3, 9)] == [1.0, 1.0, 4.0, 30.0]
    assert one(O.safe_limit(lit(8192), lit(1000))) == (7372 - 1000 - 4096) * 4 and one(O.safe_limit(lit(100), lit(1000))) == 0
    m = F.create_map(lit("a"), lit(0.0), lit("b"), lit(0.7))
    none = lit(None).cast("map<string,double>")
    e = lambda *x: F.array(*map(lit, x)).cast("array<string>")
    assert [one(O.chunk_status(s, lit(n), errs, lit(r))) for s, n, errs, r in ((none, 3, e(), False), (none, 0, e(), False), (m, 3, e("x"), False), (none, 0, e("x"), True), (none, 0, e("x"), False))] == ["fallback", "ok", "recovered", "retried_failed", "fallback"]
    assert [one(O.has_missing_list(x)) for x in (e(O.MISSING_LIST), e("chunk2:" + O.MISSING_LIST), e("y:" + O.MISSING_LIST), lit(None).cast("array<string>"))] == [True, True, False, False]
    assert one(O.rescue_category(lit("Add a TEST"))) == "Testing" and one(O.rescue_category(lit("nothing known"))) == O.RESCUE_DEFAULT
    assert one(O.prior_display(lit("2024-01-02T03:04"), lit(" a \n b " + "x" * 90))) == "2024-01-02 — a b " + "x" * 75 + "…" and one(O.prior_display(lit(None).cast("string"), lit(None).cast("string"))) == ""
    assert one(O.path_pattern(lit("a.b/c"))) == "^a\\.b/c$" and one(O.ascii_only(lit("é1"))) == "?1" and one(O.without_controls(lit("a\x01b"))) == "ab"


def test_listings_end_where_the_service_ends(spark, tmp_path):
    from votemill.sources import listings

    rows = [("a", 0, 200, ["1", None, "2"], "9"), ("a", 1, 200, ["3", " ", "4"], "0"), ("a", 2, 200, ["5"], "9"), ("b", 0, 404, None, None), ("c", 0, 200, ["7"], "9"), ("c", 1, 200, [], "9"), ("c", 2, 200, ["8"], "9")]
    p = spark.createDataFrame(rows, "k string, page int, status int, commits array<string>, remaining string")
    t = spark.createDataFrame([("a", "2"), ("c", "none")], "k string, target string")
    assert sorted(map(tuple, listings.commits(p, ["k"]).collect())) == [("a", 0, "1"), ("a", 1, "2"), ("a", 2, "3"), ("a", 3, "4"), ("c", 0, "7")]
    assert sorted(map(tuple, listings.windows(p, t, ["k"], 2).collect())) == [("a", "window", 0, "2"), ("a", "window", 1, "3"), ("c", "latest", 0, "7")]
    assert [tuple(r) for r in listings.failures(p, ["k"]).collect()] == [("b", 404)]
    env = tmp_path / ".env"
    env.write_text("# note\nexport A = 'x y'\nB=1\nnothing\n=3\n")
    assert listings.settings(str(env), {"B": "2", "C": "3"}) == {"A": "x y", "B": "2"} and listings.settings(str(env) + "no", {}) == {}
    shown = ['{"model_info": {"x.context_length": 4096}}', '{"parameters": "stop x\\nnum_ctx   2048"}', '{"modelfile": "FROM a\\nparameter num_ctx 512"}', "{}", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(shown)], "i int, s string")
    assert [r.n for r in df.orderBy("i").select(O.context_size(F.col("s")).alias("n")).collect()] == [4096, 2048, 512, None, None]


def test_sheets_and_logs(spark, tmp_path):
    df = spark.createDataFrame([("b", "two\x01", "k2"), ("a", "o;ne\nx", "k1")], "diff_id string, commit_message string, secret string")
    records.write_sheet(df, f"{tmp_path}/sheet", ("secret",), f"{tmp_path}/key")
    sheet = records.read_sheet(spark, f"{tmp_path}/sheet")
    assert sheet.columns == ["diff_id", "commit_message"] and [tuple(r) for r in sheet.collect()] == [("a", "o;ne\nx"), ("b", "two")]
    assert {(r.diff_id, r.secret) for r in spark.read.json(f"{tmp_path}/key").collect()} == {("a", "k1"), ("b", "k2")}
    earlier = spark.createDataFrame([("x", 3), ("y", 1), ("x", 0), (" ", 2)], "diff_id string, place int")
    assert [tuple(r) for r in records.ids_in_order(earlier, "diff_id", "place").orderBy("place").collect()] == [("x", 0), ("y", 1)]
    for _ in range(2):
        records.write_records(spark.createDataFrame([("a", "m/1")], "diff_id string, model string"), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 2
    sha = "a" * 40
    (tmp_path / "log.txt").write_text(f"{sha} | 2024-01-01 | me | fix: a | b | https://x/y\nnoise\n")
    assert [tuple(r) for r in records.commit_log(spark, str(tmp_path / "log.txt")).collect()] == [(sha, "2024-01-01", "me", "fix: a | b", "https://x/y")]
