"""Every query of the subpackage on ordinary, empty, null-ridden and column-clashing tables."""

import os
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from compare import rows
from votemill.llm import catalogue

TABLES = ("documents", "git_history_diffs", "recovered_20260714_204326", "model_divergence_per_item", "gold_sheet", "diffchunk", "text_langs", "chunk_limits", "mix_targets", "history_raw")
CLASH = ("unit", "lang", "label", "edges", "ids", "c", "f", "text", "vote", "path", "family", "n", "k", "v", "record_id", "source", "bucket", "host", "given", "langs", "category", "item")


def variant(t: pa.Table, kind: str) -> pa.Table:
    nothing = lambda n: pa.table({c: pa.nulls(n, t.schema.field(c).type) for c in t.column_names}, schema=t.schema)
    if kind == "empty":
        return t.slice(0, 0)
    if kind == "nulls":
        return nothing(3)
    out = pa.concat_tables([t, t.slice(0, 3), nothing(2)])
    for c in CLASH:
        if c not in out.column_names:
            out = out.append_column(c, pa.array(["x"] * len(out)))
    return out


@pytest.fixture(scope="session")
def variants(tmp_path_factory, data):
    out = {"plain": data}
    for kind in ("empty", "nulls", "clash"):
        d = tmp_path_factory.mktemp(kind)
        for n in TABLES:
            pq.write_table(variant(pq.read_table(f"{data}/{n}.parquet"), kind), f"{d}/{n}.parquet")
        out[kind] = str(d)
    return out


@pytest.mark.parametrize("kind", ["plain", "empty", "nulls", "clash"])
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_runs(spark, variants, name, kind):
    df = catalogue.QUERIES[name](spark, variants[kind])
    found = df.collect()
    if kind == "empty":
        assert not found
    if kind in ("plain", "clash") and name.endswith("_found"):
        assert len(found) == len(set(map(tuple, found)))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, data, name):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df = catalogue.QUERIES[name](spark, data)
    r = con.sql(catalogue.SQL[name])
    assert rows(df.columns, [tuple(x) for x in df.collect()]) == rows(r.columns, r.fetchall())


def test_ids_of_null_and_empty_texts(spark, tmp_path):
    from votemill.llm import bpe

    df = spark.createDataFrame([(1, None), (2, ""), (3, "hi <|endoftext|>" + " x" * 300_000)], "doc_id bigint, text string")
    got = {r.doc_id: r.ids for r in bpe.encode(df, "doc_id", "text").collect()}
    assert got[1] == got[2] == [] and len(got[3]) > 300_000 and 50256 not in got[3]


def mix_by_hand(rows_, targets, slots):
    """Each source's documents end to end, copy after copy, up to what it gives; a document lies in the block of its first token."""
    from fractions import Fraction

    from votemill.llm import mixing

    total = sum(r[2] for r in rows_)
    own = {}
    for _, s, n in rows_:
        if s is not None:
            own[s.lower()] = own.get(s.lower(), 0) + n
    shares = {s.lower(): x for s, x, _ in targets if x > 0}
    order = mixing.schedule(mixing.apportion(shares, slots))
    given, capped = {}, set()
    for s, share, most in targets:
        gives = min(share * total, most * own.get(s.lower(), 0))
        if share * total > most * own.get(s.lower(), 0):
            capped.add(s.lower())
        given[s.lower()] = gives
    return order, given, capped


def test_mixture_is_that_of_brute_force(spark):
    from votemill.llm import mixing

    rows_ = [(i, "Big" if i % 2 else "big", 10 + i % 7) for i in range(900)] + [(1000 + i, "small", 5) for i in range(20)] + [(5000, None, 3), (5001, "other", 97), (5002, "small", 0)]
    goal = [("big", 0.5, 1), ("SMALL", 0.4, 3), ("none", 0.1, 2), ("zero", 0.0, 1)]
    sized = spark.createDataFrame(rows_, "doc_id bigint, source string, n_tokens bigint")
    p = mixing.plan(mixing.totals(sized), spark.createDataFrame(goal, "source string, target_share double, max_repeats int"))
    order, given, capped = mix_by_hand(rows_, goal, 64)
    slot, frames = mixing.frame(p, 64)
    assert [r.source for r in slot.orderBy("slot").collect()] == order and frames == 1
    assert {r.source for r in mixing.demand(p, frames, slot).where("not filled").collect()} == capped == {"small", "none"}
    mix = mixing.mixture(sized, p, 64).orderBy("slot").collect()
    assert {order[r.slot] == r.source for r in mix} == {True}
    for s in ("big", "small"):
        mine = [r for r in mix if r.source == s]
        assert 0 <= sum(r.n_tokens for r in mine) - given[s] < 17
        assert all(sorted(r.repeat for r in mine if r.doc_id == d) == list(range(sum(r.doc_id == d for r in mine))) for d in {r.doc_id for r in mine})
        # At each slot the source has its share of what it gives, to less than a block and a document.
        n = order.count(s)
        for k in range(64):
            so_far = sum(r.n_tokens for r in mine if r.slot <= k)
            assert abs(so_far - given[s] * (k + 1) / 64) < given[s] / n + 17
    out = {r.source: r for r in mixing.shares(p, mixing.mixture(sized, p, 64), spark.createDataFrame([(s,) for s in capped], "source string")).collect()}
    for s, r in out.items():
        assert r.tokens_given == sum(x.n_tokens for x in mix if x.source == s) and r.capped == (s in capped)
    assert abs(sum(r.actual_share for r in out.values()) - 1) < 1e-12 and out["small"].repeats == 3


@pytest.mark.parametrize("tiny", [0.1, 1e-5, 1e-9])
def test_mixture_keeps_the_smallest_source(spark, tiny):
    from votemill.llm import mixing

    sized = spark.createDataFrame([(i, "big", 1000) for i in range(100)] + [(200, "tiny", 1), (201, "tiny", 2)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("big", 1 - tiny, 1), ("tiny", tiny, 2)], "source string, target_share double, max_repeats int")
    p = mixing.plan(mixing.totals(sized), targets)
    mix = mixing.mixture(sized, p).where("source = 'tiny'").collect()
    assert mix and {(r.doc_id, r.repeat) for r in mix} <= {(200, 0), (200, 1), (201, 0), (201, 1)} and (len(mix) == 4 or tiny < 0.1)


def test_frames_grow_with_the_corpus(spark):
    from votemill.llm import mixing

    sized = spark.createDataFrame([(i, "ab"[i % 2], 2**40) for i in range(64)], "doc_id bigint, source string, n_tokens bigint")
    p = mixing.plan(mixing.totals(sized), spark.createDataFrame([("a", 0.25, 1), ("b", 0.75, 9)], "source string, target_share double, max_repeats int"))
    slot, frames = mixing.frame(p)
    assert frames * slot.count() * mixing.BLOCK_TOKENS >= 64 * 2**40 and slot.count() == mixing.FEWEST_SLOTS
    mix = mixing.mixture(sized, p).collect()
    assert max(r.slot for r in mix) < frames * slot.count() and sum(r.source == "b" for r in mix) == 48 and sum(r.source == "a" for r in mix) == 16


def test_votes_take_the_latest_valid_rating(spark):
    from votemill.llm import consensus

    s = "diff_id string, primary_result struct<model:string,primary_category:string,error:string>, category_scores map<string,double>, status string, recorded_at timestamp"
    import datetime as dt

    t = lambda k: dt.datetime(2024, 1, k)
    df = spark.createDataFrame(
        [("a", ("m", "testing ", None), None, "ok", t(1)), ("a", ("m", "DevOps", None), None, "fallback", t(2)), ("a", ("m", "Conf. & Env.", None), None, "ok", t(3)), ("b", ("m", "N/A", None), {"Security": 80.0, "Testing": 3.0}, None, t(1)), ("c", ("m", None, "boom"), None, "fallback", t(1))],
        s,
    )
    got = {r.diff_id: (r.label, r.valid) for r in consensus.votes(df).collect()}
    assert got == {"a": (consensus.CATEGORIES.index("Conf.&Env."), True), "b": (consensus.CATEGORIES.index("Security"), True), "c": (None, False)}


def test_prose_model_counts_every_page(spark):
    from votemill.llm import prose, text_queries

    rare = "\n".join("Das ist " + " ".join("z" * 12 + chr(97 + i % 26) + chr(97 + i // 26) + c for c in "abcdef") + " und gut !" for i in range(200))
    texts = ["The parser is ready."] * 2500 + [rare, None, "", " "]
    assert len(rare) > 20_000
    corpus = text_queries.SparkCorpus(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3))
    local = prose.Corpus(texts)
    words, mine = corpus.words(), local.words()
    assert sorted(words) == sorted(mine) and len(words) == 8 + 6 * 200
    corpus.pack(mine)
    local.pack(mine)
    both, counted = corpus.grams(prose.line_grams)[2], local.grams(prose.line_grams)[2]
    assert dict(zip(both.tri, both.tri_n)) == dict(zip(counted.tri, counted.tri_n)) and max(both.tri_n) == 2500
    assert dict(zip(both.ctx, both.ctx_kinds)) == dict(zip(counted.ctx, counted.ctx_kinds)) and dict(zip(both.pair, both.pair_n)) == dict(zip(counted.pair, counted.pair_n))
    shares = {r.doc_id: r.spam_share for r in text_queries.spam_shares(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert len(shares) == len(texts) and shares[0] == shares[2501] == 0.0


def test_repertoire_counts_every_text_once(spark):
    from votemill.llm import encoding, history_queries

    said = [f"prüfung {i}" for i in range(21_000)] + ["prüfung 1"] * 5 + [None, "", "plain"]
    long = "x " * 11_000 + "größe ß"
    pages = [f"straße {i}" for i in range(1600)] + [long, "a ß", "a ß", None]
    m = spark.createDataFrame([(i, 0, t) for i, t in enumerate(said)], "history_id bigint, commit_pos int, commit_message string")
    docs = spark.createDataFrame(list(enumerate(pages)), "doc_id bigint, text string")
    known = history_queries.train_mender(m, docs).get()
    assert known.words == {"prüfung": 21_000, "straße": 1600} and known.grams["ü"] == 21_000 and known.grams["rüf"] == 21_000
    assert known.grams["ö"] == 1
    local = encoding.Repertoire.of([t for t in said + pages if t])
    assert (known.grams, known.words, known.characters) == (local.grams, local.words, local.characters)


def test_host_votes_decide(spark, tmp_path):
    from votemill.llm import history_queries, markup

    file = lambda text: {"patch": "@@ -0,0 +1 @@\n+" + text}
    repo = lambda i, name, *texts: (i, name, [{"acf_files": [file(t) for t in texts]}])
    kind = "history_id bigint, repo string, acf_commits array<struct<acf_files: array<struct<patch: string>>>>"
    rows_ = [repo(1, "many", "use a &lt; b", "or c &gt; d", "plain"), repo(2, "one", "use a &lt; b"), repo(3, None, "use a &lt; b"), repo(4, None, "c &gt; d"), repo(5, "sure", "&lt; <b>x</b>"), repo(6, "list", "- x &amp; y")]
    d = tmp_path / "sf"
    spark.createDataFrame(rows_, kind).write.parquet(f"{d}/git_history_diffs.parquet")
    found = {tuple(r) for r in history_queries.p5_found(spark, str(d)).collect()}
    want = {(1, 0, 0, "html"), (1, 0, 1, "html"), (3, 0, 0, "html"), (4, 0, 0, "html"), (5, 0, 0, "html"), (6, 0, 0, "markdown")}
    assert found == want  # without the vote, (2, 0, 0, "html") and (6, 0, 0, "html") would be found, or none of the weak ones
    old = history_queries.MOST_LOST
    history_queries.MOST_LOST = 1
    try:
        assert {tuple(r) for r in history_queries.p5_found(spark, str(d)).collect()} == want
    finally:
        history_queries.MOST_LOST = old
    assert markup.clean("+a &lt; b", frozenset({("html", "html/text/escape")})) == "a &lt; b"


def test_no_machine_local_checkpoints():
    root = Path(catalogue.__file__).parent.parent
    assert not [p for p in root.rglob("*.py") if "localCheckpoint(" in p.read_text()]
    assert os.path.isdir(root)
