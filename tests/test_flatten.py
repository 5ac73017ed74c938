import pytest

from votemill.operators import nested
from votemill.plans import flatten


def test_repeats_count_once_and_nulls_keep_places(spark):
    df = spark.createDataFrame(
        [(1, "2024-01-01", '{"acf_commits":[null,{"acf_files":{"added_lines":"x"}}]}', "clash"), (1, "2024-01-02", '{"acf_commits":[null,{"acf_files":{"added_lines":"x"}}]}', "clash"), (2, "2024-01-01", None, "clash"), (None, "2024-01-01", "[]", "clash")],
        "record_id bigint, received_at string, payload string, rows string",
    )
    got = sorted(map(tuple, nested.once(nested.text_positions(df, "record_id", "payload", "received_at")).collect()))
    assert got == [(1, 0, 1, -1, -1), (1, 0, 1, 0, -1), (1, 0, 1, 0, 0)]


def test_very_long_payload(spark):
    text = '{"acf_commits":[{"acf_files":[{"added_lines":["' + "y" * 6_000_000 + '","z"]}]}]}'
    df = spark.createDataFrame([(7, "t", text)], "record_id bigint, received_at string, payload string")
    assert nested.once(nested.text_positions(df, "record_id", "payload", "received_at")).count() == 4


def test_plan_has_one_exchange(spark, data):
    plan = flatten.p1_found(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", list(flatten.QUERIES))
def test_tables_have_parents(spark, data, name):
    df = flatten.QUERIES[name](spark, data)
    keys = [c for c in ("record_id", "repo_pos", "commit_pos", "file_pos", "line_pos") if c in df.columns]
    assert df.select(*keys).distinct().count() == df.count() > 0
