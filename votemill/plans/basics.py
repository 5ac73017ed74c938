"""Queries over single tables: filters, profiles, distributions, chunks, answers, samples, streams."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from votemill.functions import responses as R
from votemill.functions import text as X
from votemill.functions.chunks import plan_chunks
from votemill.functions.scalars import with_totals
from votemill.operators import classify as C
from votemill.operators import gold as G
from votemill.operators import sampling
from votemill.operators import votes as V
from votemill.session import checkpoint_dir, written
from votemill.sources import records
from votemill.sources.tables import table
from votemill.streaming import pipeline as P


def min_words(spark, d):
    """Documents of at least ten words."""
    words = F.size(F.filter(F.split("text", r"[ \t\r\n]+"), lambda w: w != ""))
    return table(spark, d, "documents").where("text is not null").select("doc_id", words.alias("words")).where("words >= 10")


def blank_profile(spark, d):
    """Missing and blank values of the documents' columns, of text and path together, and of all at once."""
    empty = lambda c: F.coalesce(F.length(F.btrim(F.col(c), F.lit(" \t\r\n"))) == 0, F.lit(True))
    cols = ("text", "lang", "source", "repo", "file_path")
    sets = {**{c: (c,) for c in cols}, "text and file_path": ("text", "file_path"), "all": cols}
    n = lambda cs: F.count(F.when(functools.reduce(lambda a, b: a & b, map(empty, cs)), 1))
    a = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"), *[n(cs).alias(f"c{i}") for i, cs in enumerate(sets.values())])
    return a.select("n", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("blank")) for i, c in enumerate(sets)])))


def char_counts(spark, d):
    """Documents whose stated length is missing, right or wrong."""
    t = table(spark, d, "documents")
    state = F.when(F.col("n_chars").isNull(), "missing").when(F.col("n_chars") == F.length(F.coalesce("text", F.lit(""))), "right").otherwise("wrong")
    return t.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("documents"))


def duplicate_texts(spark, d):
    """Texts that occur more than once, by digest: how often, and the smallest id.  Null texts are no text."""
    t = table(spark, d, "documents").where("text is not null").select(F.md5("text").alias("digest"), "doc_id")
    return t.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def json_scores(spark, d):
    """The number in the events' JSON, by type."""
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k int")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


def histogram_15(spark, d):
    """Customers by account balance in 15 bins of equal width; the largest value falls into the last."""
    t = table(spark, d, "customer").where("c_acctbal is not null")
    lim = t.agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    b = F.least(F.floor((F.col("c_acctbal") - F.col("lo")) / F.col("hi").__sub__(F.col("lo")) * 15).cast("int"), F.lit(14))
    return with_totals(t, lim).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def empirical_cdf(spark, d):
    """The share of parts at or below each price, ties in the order of keys.

    Prices are cut into 1024 bins of equal width and each bin into ranges of keys, so that a price
    of very many parts is spread: ranks run within a price and range, and only counts are added up.
    """
    t = table(spark, d, "part").where("p_retailprice is not null")
    lim = t.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"), F.count(F.lit(1)).alias("total"))
    part = F.coalesce(F.try_divide(F.col("p_retailprice") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    x = with_totals(t.select("p_partkey", "p_retailprice"), lim).withColumn("bin", F.least(F.floor(part * 1024), F.lit(1023))).withColumn("range", F.floor(F.col("p_partkey") / 100_000))
    key = ["bin", "p_retailprice", "range"]
    n = x.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    bins = n.groupBy("bin").agg(F.sum("n").alias("m"))
    below = bins.select("bin", (F.sum("m").over(Window.orderBy("bin")) - F.col("m")).alias("below"))
    before = n.withColumn("b", F.sum("n").over(Window.partitionBy("bin").orderBy("p_retailprice", "range")) - F.col("n")).join(below, "bin").select(*key, (F.col("b") + F.col("below")).alias("below"))
    inside = x.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("p_partkey")))
    return inside.join(before, key).select("p_partkey", "p_retailprice", F.round((F.col("below") + F.col("k")) / F.col("total"), 9).alias("share"))


def sliding_budget(spark, d):
    """Events of a type and their values within the last minute."""
    b = P.sliding_budget(table(spark, d, "events").select("event_id", "event_type", "ts", "value"), "event_type", "ts", "value")
    return b.select("event_id", "requests", F.round("spent", 6).alias("spent"))


def lifecycle_pick(spark, d):
    """The smallest history of a file with at least three rated changes of both classes, else of two base types, else any of three; its key breaks ties."""
    l = G.latest(table(spark, d, "recovered_20260714_204326")).where("class <> ''").groupBy("item").agg(F.min("class").alias("class"), F.min("base").alias("base"))
    r = table(spark, d, "recovered_20260714_204326").where("repo is not null and filename is not null").groupBy(F.col("diff_id").alias("item")).agg(F.min("repo").alias("repo"), F.min("filename").alias("filename"))
    g = r.join(l, "item").groupBy("repo", "filename").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("class").alias("classes"), F.countDistinct("base").alias("bases")).where("n >= 3")
    tier = F.when(F.col("classes") >= 2, 0).when(F.col("bases") >= 2, 1).otherwise(2)
    return g.withColumn("tier", tier).orderBy("tier", "n", "repo", "filename").limit(1)


def last_counts(spark, d):
    """Histories by their number of diffs: the ten largest numbers, shown in rising order."""
    c = table(spark, d, "git_history_diffs").where("total_diffs_found is not null").groupBy("total_diffs_found").agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy(F.desc("total_diffs_found")).limit(10).orderBy("total_diffs_found")


def ordered_types(spark, d):
    """Maintenance types in their listed order, then others by name, with a flag for few records."""
    listed = F.array(*[F.lit(x) for x in G.LEAVES])
    c = table(spark, d, "recovered_20260714_204326").groupBy(F.coalesce("maintenance.primary_maintenance_type", F.lit("")).alias("type")).agg(F.count(F.lit(1)).alias("n"))
    at = F.array_position(listed, F.col("type"))
    return c.select("type", "n", F.when(at == 0, 99).otherwise(at).cast("int").alias("place"), (F.col("n") < 20).alias("few")).orderBy("place", "type")


def log_lines(spark, d):
    """Commit log lines taken apart: messages and authors by commit."""
    r = table(spark, d, "recovered_20260714_204326").where("commit_hash is not null and commit_time is not null and commit_message is not null")
    line = F.concat_ws(" | ", "commit_hash", "commit_time", F.lit("dev"), X.first_line(F.col("commit_message")), F.concat(F.lit("https://git.example/"), "commit_hash"))
    return records.parse_log(r.select(line.alias("line")), F.col("line")).select("sha", "date", "message", "url").distinct()


def sheet_merge(spark, d):
    """Messages of labelled diffs: from the sheet where filled, else from the ratings."""
    sheet = table(spark, d, "gold_sheet").where("trim(diff_id) <> ''").groupBy("diff_id").agg(F.min(F.nullif("commit_message", F.lit(""))).alias("commit_message"))
    rated = table(spark, d, "recovered_20260714_204326").join(sheet.select("diff_id"), "diff_id", "left_semi").groupBy("diff_id").agg(F.max("commit_message").alias("commit_message"))
    return records.first_filled([sheet, rated], "diff_id", ["commit_message"]).select("diff_id", F.md5("commit_message").alias("digest"))


def _pieces(spark, d):
    """The models' records of a diff as if they were its pieces."""
    r = table(spark, d, "recovered_20260714_204326").where("diff_id is not null")
    blank = lambda c: F.coalesce(f"primary_result.{c}", F.lit(""))
    place = F.row_number().over(Window.partitionBy("diff_id").orderBy("recorded_at", "primary_result.model", blank("primary_category"), blank("summary"), F.array_join("primary_result.validation_errors", ";"))) - 1
    # Rating runs of one diff are as many as models and reruns.
    return r.select(F.col("diff_id").alias("item"), place.alias("index"), F.col("category_scores").alias("scores"), "status", F.col("primary_result.validation_errors").alias("errors"), F.col("primary_result.primary_category").alias("primary"), F.col("primary_result.summary").alias("summary"))


def _aggregated(how):
    def q(spark, d):
        r = table(spark, d, "recovered_20260714_204326").where("diff_id is not null").select(F.col("diff_id").alias("item"), F.col("category_scores").alias("scores"))
        return C.aggregate(r, G.CATEGORIES, how).where("score > 0").select("item", "category", F.round("score", 9).alias("score"))

    q.__doc__ = f"Scores of a diff over all its records: {how}."
    return q


def worst_status(spark, d):
    """The most severe status of each diff's records."""
    return table(spark, d, "recovered_20260714_204326").where("diff_id is not null").groupBy("diff_id").agg(C.worst_status(F.col("status")).alias("status"))


def error_tags(spark, d):
    """Distinct error codes of each diff, each with the place of its record among the diff's records, from 0."""
    p = _pieces(spark, d).where("size(errors) > 0")
    return p.groupBy("item").agg(F.array_join(C.error_tags(F.col("index").cast("string"), F.col("errors")), ";").alias("tags"))


def chunk_plan(spark, d):
    """Documents cut into pieces of whole lines of at most 800 characters with an overlap of 100: how many, whether all keep limit and overlap, and the digest of what they join to."""
    p = plan_chunks(F.col("text"), 800, 100)
    t = table(spark, d, "documents").select("doc_id", p.alias("p")).where("size(p) > 0")
    new = F.transform("p", lambda x, i: F.when(i == 0, x["text"]).otherwise(F.substring(x["text"], F.get("p", i - 1)["char_end"] - x["char_start"] + 1, F.lit(2**31 - 1))))
    keeps = F.forall("p", lambda x: (F.length(x["text"]) <= 800) & (F.length(x["text"]) == x["char_end"] - x["char_start"]) & (x["total"] == F.size("p")))
    back = F.forall(F.transform("p", lambda x, i: (i == 0) | (F.coalesce(F.get("p", i - 1)["char_end"], F.lit(0)) - x["char_start"] == F.least(F.lit(100), F.coalesce(F.get("p", i - 1)["char_end"], F.lit(0))))), lambda x: x)
    return t.select("doc_id", (F.size("p") > 1).alias("cut"), keeps.alias("keeps"), back.alias("overlaps"), F.md5(F.array_join(new, "")).alias("digest"))


def response_parse(spark, d):
    """Answers rebuilt from the ratings, a part of them broken in known ways, parsed back: errors and score sums.

    By the length of the id an answer is sound, within other text, with a stray comma, or without its last bracket.
    """
    r = table(spark, d, "recovered_20260714_204326").where("diff_id is not null and category_scores is not null")
    entries = F.transform(F.map_entries("category_scores"), lambda e: F.struct(e["key"].alias("name"), F.round(e["value"], 3).alias("score"), F.lit("because").alias("rationale")))
    ok = F.to_json(F.struct(entries.alias("categories"), F.coalesce("primary_result.primary_category", F.lit("none")).alias("primary_category"), F.lit("text").alias("summary")))
    kind = F.length("diff_id") % 4
    broken = F.when(kind == 0, ok).when(kind == 1, F.concat(F.lit("Here you go: "), ok, F.lit(" Done."))).when(kind == 2, F.regexp_replace(ok, r"\}\]", "},]")).otherwise(F.substring(ok, F.lit(1), F.length(ok) - 1))
    p = r.select("diff_id", F.col("primary_result.model").alias("model"), "recorded_at", kind.alias("kind"), R.parse_response(broken, G.CATEGORIES).alias("p"))
    total = F.aggregate(F.map_values("p.scores"), F.lit(0.0), lambda a, x: a + x)
    return p.select("diff_id", "model", "recorded_at", "kind", F.array_join("p.errors", ";").alias("errors"), F.round(total, 6).alias("sum"), F.col("p.parsed").isNotNull().alias("parsed"))


#: Answers with what has to come of them: errors, and the scores above zero of two categories.
_ANSWERS = (
    ('{"categories":[{"name":"Testing","score":"0,85","rationale":"x"},{"name":"devops","score":true,"rationale":""}],"primary_category":"Testing","summary":"s"}', "categories_missing_entries:DevOps", 0.85, 1.0),
    ('Sure: {"categories":[{"name":"Testing","score":0.4,"rationale":"}"},{"name":"DevOps","score":7,"rationale":"x"},],"primary_category":"DevOps","summary":"s",} ok', "", 0.4, 1.0),
    ('{"categories":[{"name":"Testing","score":0.3,"rationale":"x"},{"name":"DevOps","score":null,"rationale":3},"primary_category":"none","     "summary":" "}', "categories[1].score_invalid(DevOps);categories[1].rationale_invalid(DevOps);primary_category_invalid;summary_invalid", 0.3, 0.0),
    ('{"categories":[{"name":"Testing","score":0.9,"rationale":"x"},{"name":"Dev', "invalid_json", 0.9, 0.0),
    ('```json\n"primary_category": "DevOps"\n```', "invalid_json", 0.0, 0.65),
    ("Testing: 0.7, DevOps 0.2", "invalid_json", 0.7, 0.2),
    ('{"score": 0.25, "name": "Testing"', "invalid_json", 0.25, 0.0),
    ('{"categories": "none"}', "categories_missing_or_not_list", 0.0, 0.0),
    ("{broken: } no", "invalid_json", 0.0, 0.0),
    (None, "invalid_json", 0.0, 0.0),
)


def response_cases(spark, d):
    """A table of answers, sound, broken and empty, parsed."""
    t = spark.createDataFrame([(i, a[0]) for i, a in enumerate(_ANSWERS)], "case int, answer string").select("case", R.parse_response(F.col("answer"), ("Testing", "DevOps")).alias("p"))
    return t.select("case", F.array_join("p.errors", ";").alias("errors"), F.element_at("p.scores", "Testing").alias("testing"), F.element_at("p.scores", "DevOps").alias("devops"))


def stratified_sample(spark, d):
    """Two hundred orders that cover the label sets of the panel, those with the label N-O first."""
    s = V.label_sets(V.line_panel(table(spark, d, "lineitem"), ("by_qty",))).select("item", "labels")
    return sampling.stratified_sample(s, 200).select("item", F.array_join("labels", "|").alias("labels"))


def sample_balance(spark, d):
    """By label, the orders that have it, and whether the sample has its share of them, to one order; the blank label stands for all orders."""
    s = V.label_sets(V.line_panel(table(spark, d, "lineitem"), ("by_qty",))).select("item", "labels")
    chosen = written(sampling.stratified_sample(s, 200))
    count = lambda t, n: t.select(F.explode(F.concat("labels", F.array(F.lit("")))).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias(n))
    total = s.agg(F.count(F.lit(1)).alias("total"))
    x = with_totals(count(s, "have").join(count(chosen, "taken"), "label", "left").na.fill(0, ["taken"]), total)
    return x.select("label", "have", (F.col("taken") > F.col("have") * F.least(F.lit(200), F.col("total")) / F.col("total") - 1).alias("balanced"))


def stream_dedup(spark, d):
    """Events once per id, through a stream; ids are forgotten a year after their time."""
    e = P.stream_of(spark, f"{d}/events.parquet").select("event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    return P.run_append(P.once_per_id(e, "event_id", "ts", "365 days").drop("ts"))


def _event_stream(spark, d):
    return P.stream_of(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_window_counts(spark, d):
    """Events by hour and type, through a stream with a watermark."""
    n = P.run_closed(_event_stream(spark, d).select("ts", "event_type"), lambda e: P.window_counts(e, "ts", "event_type", "1 hour"), "ts")
    return n.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def stream_sessions(spark, d):
    """Sessions of users, with pauses of 30 minutes, through a stream with a watermark."""
    n = P.run_closed(_event_stream(spark, d).select("ts", "user_id"), lambda e: P.sessions(e, "ts", "user_id", "30 minutes"), "ts")
    return n.select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n")


def stream_merged(spark, d):
    """Events of two producers as one stream, each once per producer: rows by producer and type."""
    e = _event_stream(spark, d).select("event_id", "event_type", "ts")
    both = P.merged({"even": e.where("event_id % 2 = 0"), "odd": _event_stream(spark, d).select("event_id", "event_type", "ts").where("event_id % 2 <> 0")})
    return P.run_append(P.once_per_id(both, "event_id", "ts", "365 days").drop("ts")).groupBy("producer", "event_type").agg(F.count(F.lit(1)).alias("n"))


def run_files(spark, d):
    """The ratings written as lines of two runs, some lines blank or broken, read back: the last line of each diff, in the last run."""
    base = f"{checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"
    r = table(spark, d, "recovered_20260714_204326").where("trim(diff_id) <> ''").groupBy("diff_id").agg(F.max("commit_hash").alias("commit_hash"), F.max("filename").alias("filename"))
    line = lambda status: F.to_json(F.struct("diff_id", "commit_hash", "filename", F.lit(status).alias("status")))
    first = r.select(F.explode(F.array(line("early"), F.lit(""), F.lit("{broken"), line("late"))).alias("value"))
    second = r.where("length(diff_id) % 2 = 0").select(line("second run").alias("value"))
    for name, t in (("primary_1.jsonl", first), ("primary_2.jsonl", second)):
        t.write.text(f"{base}/{name}")
    return records.run_records(spark, base).select("diff_id", "status")


def limiter_waits(spark, d):
    """How long each event would wait where a type may have three events and values of 100 a quarter of an hour."""
    e = table(spark, d, "events").select("event_id", "event_type", "ts", "value")
    return P.limiter_waits(e, "event_type", "ts", "value", "event_id", 3, 100.0, seconds=900).select("event_id", F.round("wait", 6).alias("wait"))


chunk_aggregate, chunk_aggregate_mean, chunk_aggregate_any = _aggregated("max"), _aggregated("mean"), _aggregated("any")
QUERIES = {f.__name__: f for f in (min_words, blank_profile, char_counts, duplicate_texts, json_scores, histogram_15, empirical_cdf, sliding_budget, lifecycle_pick, last_counts, ordered_types, log_lines, sheet_merge, worst_status, error_tags, chunk_plan, response_parse, response_cases, stratified_sample, sample_balance, stream_dedup, stream_window_counts, stream_sessions, stream_merged, limiter_waits, run_files)} | {"chunk_aggregate": chunk_aggregate, "chunk_aggregate_mean": chunk_aggregate_mean, "chunk_aggregate_any": chunk_aggregate_any}

def panel_sql(query: str) -> str:
    """A query on the line panel's tables, which plans.panel defines."""
    from votemill.plans.panel import _P

    return _P + query


_AG = "with r as (select diff_id item, category_scores s from recovered_20260714_204326 where diff_id is not null), n as (select item, count(s) n from r group by 1), e as (select item, unnest(map_entries(s)) e from r where s is not null), x as (select item, e.key category, max(e.value) hi, sum(e.value) t, max(cast(e.value >= 0.5 as double)) a from e where e.key in ('System Overview', 'AI Integration', 'Documentation', 'Architecture', 'Impl. Details', 'Build and Run', 'Testing', 'Conf.&Env.', 'DevOps', 'Development Process', 'Project Management', 'Maintenance', 'Debugging', 'Performance', 'Security', 'UI/UX') group by 1, 2) "
SQL = {
    "min_words": "select doc_id, cast(words as int) words from (select doc_id, len(list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda w: w <> '')) words from documents where text is not null) where words >= 10",
    "blank_profile": " union all ".join(f"select count(*) n, '{name}' \"column\", count(*) filter (" + " and ".join(f"({c} is null or length(trim({c}, chr(32) || chr(9) || chr(13) || chr(10))) = 0)" for c in cs) + ") blank from documents" for name, cs in (*((c, (c,)) for c in ("text", "lang", "source", "repo", "file_path")), ("text and file_path", ("text", "file_path")), ("all", ("text", "lang", "source", "repo", "file_path")))),
    "char_counts": "select case when n_chars is null then 'missing' when n_chars = length(coalesce(text, '')) then 'right' else 'wrong' end state, count(*) documents from documents group by 1",
    "duplicate_texts": "select md5(text) digest, count(*) n, min(doc_id) first_id from documents where text is not null group by 1 having count(*) > 1",
    "json_scores": "select event_type, count(k) n, cast(sum(k) as bigint) total, max(k) most from (select event_type, cast(json_extract(props, '$.k') as int) k from events) group by 1",
    "histogram_15": "select cast(least(floor((c_acctbal - lo) / (hi - lo) * 15), 14) as int) bin, count(*) n from customer, (select min(c_acctbal) lo, max(c_acctbal) hi from customer) group by 1",
    "empirical_cdf": "select p_partkey, p_retailprice, round(row_number() over (order by p_retailprice, p_partkey) / cast(count(*) over () as double), 9) share from part",
    "sliding_budget": "select event_id, count(*) over w requests, round(sum(value) over w, 6) spent from (select *, epoch_us(ts) t from events) window w as (partition by event_type order by t range between 59999999 preceding and current row)",
    "lifecycle_pick": """with rr as (select diff_id item, primary_result.model rater, coalesce(primary_result.primary_category, '') label, category_scores s, maintenance m, recorded_at from recovered_20260714_204326 where diff_id <> ''),
l as (select item, min(m.maintenance_class) c, min(m.maintenance_base_type) b from (select *, row_number() over (partition by item, rater order by recorded_at desc, label desc) k from rr) where k = 1 and m.maintenance_class <> '' group by 1),
r as (select diff_id item, min(repo) repo, min(filename) filename from recovered_20260714_204326 where repo is not null and filename is not null group by 1),
g as (select repo, filename, count(*) n, count(distinct c) classes, count(distinct b) bases from r join l using (item) group by 1, 2 having count(*) >= 3)
select *, case when classes >= 2 then 0 when bases >= 2 then 1 else 2 end tier from g order by tier, n, repo, filename limit 1""",
    "last_counts": "select total_diffs_found, count(*) n from git_history_diffs where total_diffs_found is not null group by 1 order by 1 desc limit 10",
    "ordered_types": "select type, n, cast(case when list_contains(o, type) then list_position(o, type) else 99 end as int) place, n < 20 few from (select coalesce(maintenance.primary_maintenance_type, '') type, count(*) n, ['corrective', 'preventive', 'adaptive (enhancement)', 'adaptive (correction)', 'additive', 'perfective'] o from recovered_20260714_204326 group by 1)",
    "log_lines": """with r as (select commit_hash || ' | ' || commit_time || ' | dev | ' || string_split_regex(commit_message, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x{85}\\x{2028}\\x{2029}]')[1] || ' | https://git.example/' || commit_hash line from recovered_20260714_204326 where commit_hash is not null and commit_time is not null and commit_message is not null),
m as (select regexp_extract(line, '^([0-9a-f]{40}) \\| (.*?) \\| (.*?) \\| (.*) \\| (\\S+)$', ['sha', 'date', 'author', 'message', 'url']) x from r where regexp_matches(line, '^([0-9a-f]{40}) \\| (.*?) \\| (.*?) \\| (.*) \\| (\\S+)$'))
select distinct x.sha, x.date, x.message, x.url from m""",
    "sheet_merge": """with s as (select diff_id, min(nullif(commit_message, '')) m from gold_sheet where trim(diff_id) <> '' group by 1), r as (select diff_id, max(commit_message) n from recovered_20260714_204326 group by 1)
select diff_id, md5(coalesce(m, nullif(n, ''))) digest from s left join r using (diff_id)""",
    "worst_status": "with x as (select diff_id, case status when 'recovered' then 1 when 'retried_failed' then 2 when 'fallback' then 3 else 0 end k from recovered_20260714_204326 where diff_id is not null) select diff_id, ['ok', 'recovered', 'retried_failed', 'fallback'][max(k) + 1] status from x group by 1",
    "error_tags": "with p as (select diff_id item, primary_result.validation_errors es, row_number() over (partition by diff_id order by recorded_at, primary_result.model nulls first, coalesce(primary_result.primary_category, ''), coalesce(primary_result.summary, ''), array_to_string(primary_result.validation_errors, ';')) - 1 i from recovered_20260714_204326 where diff_id is not null), t as (select distinct item, 'chunk' || i || ':' || unnest(es) tag from p) select item, string_agg(tag, ';' order by tag) tags from t group by 1",
    "chunk_plan": "select doc_id, length(text) > 800 cut, true keeps, true \"overlaps\", md5(text) digest from documents where text <> ''",
    "response_cases": "select * from (values " + ", ".join(f"({i}, '{e}', cast({t} as double), cast({o} as double))" for i, (_, e, t, o) in enumerate(_ANSWERS)) + ") t(\"case\", errors, testing, devops)",
    "response_parse": """with cats as (select unnest(['System Overview', 'AI Integration', 'Documentation', 'Architecture', 'Impl. Details', 'Build and Run', 'Testing', 'Conf.&Env.', 'DevOps', 'Development Process', 'Project Management', 'Maintenance', 'Debugging', 'Performance', 'Security', 'UI/UX']) category, unnest(range(16)) i),
r as (select row_number() over () id, diff_id, primary_result.model model, recorded_at, length(diff_id) % 4 kind, coalesce(primary_result.primary_category, 'none') p, map_entries(category_scores) es from recovered_20260714_204326 where diff_id is not null and category_scores is not null),
s as (select id, category, i, len([1 for e in es if e.key = category]) seen, coalesce(least(1e0, greatest(0e0, round([e.value for e in es if lower(e.key) = lower(category)][-1], 3))), 0e0) v from r, cats),
t as (select id, sum(v) v, string_agg(category, ',' order by i) filter (seen = 0) missing, max(cast(category = p as int)) listed, sum(case when category = p and v = 0 then 0.65 else 0 end) boost from s join r using (id) group by 1)
select diff_id, model, recorded_at, cast(kind as int) kind, case when kind = 3 then 'invalid_json' else concat_ws(';', 'categories_missing_entries:' || missing, case when listed = 0 then 'primary_category_invalid' end) end errors, round(v + case when kind = 3 then boost else 0 end, 6) "sum", kind <> 3 parsed from r join t using (id)""",
    "chunk_aggregate": _AG + "select item, category, round(hi, 9) score from x where hi > 0",
    "chunk_aggregate_mean": _AG + "select item, category, round(t / n, 9) score from x join n using (item) where t > 0",
    "chunk_aggregate_any": _AG + "select item, category, a score from x where a > 0",
    "sample_balance": panel_sql("s as (select item, labels from st where rater = 'by_qty'), x as (select unnest(list_append(labels, '')) \"label\" from s) select \"label\", count(*) have, true balanced from x group by 1"),
    "run_files": "select distinct diff_id, case when length(diff_id) % 2 = 0 then 'second run' else 'late' end status from recovered_20260714_204326 where trim(diff_id) <> ''",
    "stream_merged": "select case when event_id % 2 = 0 then 'even' else 'odd' end producer, event_type, count(distinct event_id) n from events group by 1, 2",
    "limiter_waits": """with e as (select *, epoch_us(ts) t from events), w as (select a.event_id, a.t, a.value c, b.t bt, b.event_id bid, b.value bc from e a left join e b on a.event_type = b.event_type and (b.t < a.t or (b.t = a.t and b.event_id < a.event_id)) and b.t > a.t - 900000000),
s as (select *, sum(bc) over (partition by event_id order by bt, bid) freed, sum(bc) over (partition by event_id) held, count(bt) over (partition by event_id) n, min(bt) over (partition by event_id) oldest from w)
select event_id, round(greatest(case when any_value(n) >= 3 then (any_value(oldest) + 900000000 - any_value(t)) / 1e6 + 0.05 else 0 end, coalesce((min(bt) filter (coalesce(held, 0) + c > 100 and freed >= held + c - 100) + 900000000 - any_value(t)) / 1e6 + 0.05, 0)), 6) wait from s group by event_id""",
    "stream_dedup": "select distinct event_id, event_type, value from events",
    "stream_window_counts": "select time_bucket(interval '1 hour', ts) \"start\", event_type, count(*) n from events group by 1, 2",
    "stream_sessions": """with a as (select user_id, ts, case when ts >= lag(ts) over w + interval '30 minutes' or lag(ts) over w is null then 1 else 0 end b from events window w as (partition by user_id order by ts)), g as (select *, sum(b) over (partition by user_id order by ts) s from a)
select min(ts) "start", user_id, count(*) n from g group by user_id, s""",
}
