"""Queries on commit messages and patches: wrong encodings, languages, markup, pieces."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from votemill.llm import encoding, language, markup, pieces
from votemill.llm.common import Shipped, collect_counts, count_keys, map_batches, written
from votemill.llm.prose import MAINLY
from votemill.llm.text_queries import train_prose
from votemill.operators.nested import first_deliveries
from votemill.sources.tables import commit_units, file_units, histories, table


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """history_id, commit_pos, commit_message; of every delivery."""
    return commit_units(histories(spark, sf_dir, commit=("commit_message",))).select("history_id", "commit_pos", F.col("c.commit_message").alias("commit_message"))


def train_mender(m: DataFrame, documents: DataFrame) -> Shipped:
    """What sound text looks like, from all messages and pages with other than ASCII characters, each distinct text once.

    Of a text only its words with such characters are moved, under the text's digest.  The
    counts that decide nothing (see ``Repertoire``) do not come to the driver.
    """
    odd = F.col("text").rlike(r"[^\x00-\x7F]")
    texts = m.select(F.col("commit_message").alias("text")).where(odd).unionByName(documents.select("text").where(odd))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest(), encoding.marked(t)) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], names=["text_id", "words"])

    distinct = map_batches(texts, work, "text_id binary, words array<string>").groupBy("text_id").agg(F.first("words").alias("words"))
    said = count_keys(distinct.select("words"), lambda batch: ((k for w in words for k in encoding.said(w)) for words in batch.column(0).to_pylist()))
    counts = count_keys(said, lambda batch: map(encoding.keys_of, batch.column(0).to_pylist()), weight=True)
    kind = F.substring("key", 1, 1)
    used = counts.where((kind == encoding.GRAM) | ((kind == encoding.WORD) & (F.col("n") > 2)) | ((kind == encoding.FOLLOWS) & (F.col("n") > 1)))
    return Shipped(m, encoding.Repertoire.from_counts(collect_counts(used)))


def mended(m: DataFrame, known: Shipped) -> DataFrame:
    """The damaged messages: history_id, commit_pos, commit_message, restored, pairs, complete.

    Messages of ASCII without a question mark are sound and stay in the JVM.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        mender = encoding.mender(known)
        got = [mender.mend(t) for t in batch.column(2).to_pylist()]
        keep = [i for i, g in enumerate(got) if g[0]]
        cols = [batch.column(i).take(pa.array(keep, pa.int64())) for i in range(3)]
        out = [pa.array([got[i][1] for i in keep], pa.string()), pa.array([got[i][2] for i in keep], pa.string()), pa.array([got[i][3] for i in keep], pa.bool_())]
        return pa.RecordBatch.from_arrays([*cols, *out], names=["history_id", "commit_pos", "commit_message", "restored", "pairs", "complete"])

    rows = m.where(F.col("commit_message").rlike(r"[^\x00-\x7F]|\?"))
    return map_batches(rows, work, "history_id bigint, commit_pos int, commit_message string, restored string, pairs string, complete boolean")


def _mended(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    return mended(m, train_mender(m, table(spark, sf_dir, "documents")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits whose message was decoded wrongly; repeated deliveries once."""
    return _mended(spark, sf_dir).select("history_id", "commit_pos").distinct()


def p6_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged messages with what could be restored."""
    return _mended(spark, sf_dir).distinct()


_UNITS = "unit string, record_id bigint, commit_pos int, file_pos int, label string, lang string, start int, end int, confidence double, sentences int"


def train_languages(documents: DataFrame) -> Shipped:
    """The language model, from a bounded sample of the labelled documents of each language: those with the smallest hashes of their ids.

    The ranks are taken on ids alone, each task handing on no more than the sample; the ids
    (``SAMPLE_TEXTS`` of each two-letter code) are then broadcast to where the texts are.
    """
    d = documents.where("text <> ''").select("doc_id", "text", label_code(F.col("lang")).alias("code")).where(F.col("code").rlike("^[a-z]{2}$"))
    h = F.xxhash64("doc_id")
    ids = d.select("doc_id", "code", h.alias("h")).distinct()
    place = F.row_number().over(Window.partitionBy("code").orderBy("h", "doc_id"))
    chosen = ids.withColumn("place", place).where(F.col("place") <= language.SAMPLE_TEXTS).select("doc_id", "code")
    room = F.greatest(F.length("text") - language.SAMPLE_CHARS, F.lit(0)) + 1
    passage = F.substring("text", F.pmod(h, room.cast("bigint")).cast("int") + 1, F.lit(language.SAMPLE_CHARS))
    rows = d.join(F.broadcast(chosen), ["doc_id", "code"]).select("doc_id", "code", passage.alias("text")).dropDuplicates(["doc_id", "code"]).collect()
    return Shipped(documents, language.train([(r.code, r.text) for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.code))]))


def _segments(df: DataFrame, unit: str, models: Shipped, known: Shipped | None = None, prose_model: Shipped | None = None) -> DataFrame:
    """Stretches of the texts in ``df`` (record_id, commit_pos, file_pos, label, text); a text without language has no row.

    With ``known`` damaged texts are restored first; with ``prose_model`` spam pages have no
    language (asked only of texts that could be cases, as it decides nothing for others).
    """
    kind = unit if unit != "chunk" else "document"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = models.get()
        mender = encoding.mender(known) if known else None
        prose = prose_model.get() if prose_model else None
        labels = batch.column(3).to_pylist()
        texts = batch.column(4).to_pylist()
        every = []
        for text in texts:
            if mender is not None and text and not text.isascii():
                text = mender.mend(text)[1]
            every.append(language.stretches(model, text, kind) if text else [])
        if prose is not None:
            doubt = [i for i, got in enumerate(every) if got and (len(own := {x[0] for x in got}) > 1 or language.code(labels[i]) not in own)]
            for i, share in zip(doubt, prose.shares([texts[i] for i in doubt])):
                if share > MAINLY:
                    every[i] = []
        row = [i for i, got in enumerate(every) for _ in got]
        found = [x for got in every for x in got]
        take = pa.array(row, pa.int64())
        cols = [batch.column(k).take(take) for k in range(4)]
        names = ["unit", "record_id", "commit_pos", "file_pos", "label", "lang", "start", "end", "confidence", "sentences"]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([unit] * len(row), pa.string()), *cols, *[pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)]], names=names)

    return map_batches(df.select("record_id", "commit_pos", "file_pos", "label", "text"), work, _UNITS)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches of all messages, patches and documents; label is filled for documents only."""
    docs = table(spark, sf_dir, "documents")
    model = train_languages(docs)
    m = messages(spark, sf_dir)
    none = F.lit(None).cast("string")
    msg = m.select(F.col("history_id").alias("record_id"), "commit_pos", F.lit(-1).alias("file_pos"), none.alias("label"), F.col("commit_message").alias("text"))
    files = file_units(histories(spark, sf_dir, file=("patch",)))
    patches = files.select(F.col("history_id").alias("record_id"), "commit_pos", "file_pos", none.alias("label"), F.col("f.patch").alias("text"))
    pages = docs.select(F.col("doc_id").alias("record_id"), F.lit(-1).alias("commit_pos"), F.lit(-1).alias("file_pos"), F.col("lang").alias("label"), "text")
    prose_model = train_prose(docs)
    out = _segments(msg, "message", model, known=train_mender(m, docs))
    return out.unionByName(_segments(patches, "patch", model)).unionByName(_segments(pages, "document", model, prose_model=prose_model))


def label_code(label: Column) -> Column:
    """language.code as an expression."""
    low = F.lower(F.trim(label))
    codes = F.create_map(*[F.lit(x) for pair in language.CODES.items() for x in pair])
    known = F.coalesce(F.try_element_at(codes, low), F.try_element_at(codes, F.split(low, r"[-_ (]")[0]), low)
    return F.when(low.isin(*language.MISSING), F.lit(None)).otherwise(known)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a missing or wrong label, or with sentences in several languages; a row for each language.

    A text labelled more than once has the label given last.  Only keys and codes are
    shuffled; the texts stay in the tasks that read them.
    """
    key = ["unit", "record_id", "commit_pos", "file_pos"]
    found = segments(spark, sf_dir).groupBy(*key).agg(F.collect_set("lang").alias("langs"), F.max("label").alias("label"))
    given = table(spark, sf_dir, "text_langs").select(
        F.when(F.col("field") == "commit_message", "message").when(F.col("field") == "patch", "patch").alias("unit"),
        F.col("history_id").alias("record_id"),
        "commit_pos",
        F.when(F.col("field") == "commit_message", -1).otherwise(F.col("file_pos")).alias("file_pos"),
        F.struct("labelled_at", F.col("lang").alias("given")).alias("g"),
    )
    last = given.groupBy(*key).agg(F.max("g").alias("g")).select(*key, F.col("g.given").alias("given"))
    # One join for all units: two branches over ``found`` would read and judge every text twice.
    joined = found.join(last.withColumn("labelled", F.lit(True)), key, "left").where("unit = 'document' or labelled")
    units = joined.select(*key, "langs", F.when(F.col("unit") == "document", F.col("label")).otherwise(F.col("given")).alias("label"))
    own = label_code(F.col("label"))
    case = own.isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.coalesce(own, F.lit("")))
    return units.where(case).select(*key, F.explode("langs").alias("lang"))


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch with its language and confidence; repeated deliveries once."""
    return segments(spark, sf_dir).drop("label").withColumn("confidence", F.round("confidence", 6)).distinct()


def _limits(spark: SparkSession, sf_dir: str) -> list[tuple[str | None, int, int]]:
    """(profile, max_chars, overlap_chars) of each profile; a table of settings, whose profiles without a limit count for none."""
    rows = table(spark, sf_dir, "chunk_limits").where("max_chars is not null").distinct().collect()
    return sorted(((r.profile, r.max_chars, r.overlap_chars or 0) for r in rows), key=str)


_PIECE = "profile string, unit string, record_id bigint, commit_pos int, file_pos int, piece_index int, piece_total int, char_start int, char_end int"


def _pieces(df: DataFrame, limits: list[tuple[str | None, int, int]], with_text: bool) -> DataFrame:
    """profile, unit, record_id, commit_pos, file_pos, piece_index, piece_total, char_start, char_end (and text) of texts above a profile's limit."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [(i, name, pieces.split(t, most, back)) for i, t in enumerate(batch.column(4).to_pylist()) for name, most, back in limits]
        take = pa.array([i for i, _, g in got for _ in g], pa.int64())
        cols = [pa.array([name for _, name, g in got for _ in g], pa.string()), *[batch.column(k).take(take) for k in range(4)]]
        num = [pa.array(x, pa.int32()) for x in ([k for _, _, g in got for k in range(len(g))], [len(g) for _, _, g in got for _ in g], [x[0] for _, _, g in got for x in g], [x[1] for _, _, g in got for x in g])]
        names = ["profile", "unit", "record_id", "commit_pos", "file_pos", "piece_index", "piece_total", "char_start", "char_end"]
        if with_text:
            return pa.RecordBatch.from_arrays([*cols, *num, pa.array([x[2] for _, _, g in got for x in g], pa.string())], names=[*names, "text"])
        return pa.RecordBatch.from_arrays([*cols, *num], names=names)

    least = min((most for _, most, _ in limits), default=2**31 - 1)
    large = df.where(F.length("text") > least).select("unit", "record_id", "commit_pos", "file_pos", "text")
    return map_batches(large, work, _PIECE + (", text string" if with_text else ""))


def _oversized(h: DataFrame, chunks: DataFrame) -> DataFrame:
    patches = file_units(h).select(F.lit("patch").alias("unit"), F.col("history_id").alias("record_id"), "commit_pos", "file_pos", F.col("f.patch").alias("text"))
    return patches.unionByName(chunks.select(F.lit("chunk").alias("unit"), F.col("chunk_id").alias("record_id"), F.lit(-1).alias("commit_pos"), F.lit(-1).alias("file_pos"), "text"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches and chunks above a limit, each with its pieces made; repeated deliveries once."""
    texts = _oversized(histories(spark, sf_dir, file=("patch",)), table(spark, sf_dir, "diffchunk"))
    return _pieces(texts, _limits(spark, sf_dir), with_text=False).where("piece_index = 0 and piece_total > 1").select("unit", "record_id", "commit_pos", "file_pos").distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces with their texts, by profile; of repeated rows the first."""
    h = first_deliveries(histories(spark, sf_dir, repo=("delivered_at",), file=("patch",)), "history_id", "delivered_at")
    chunks = first_deliveries(table(spark, sf_dir, "diffchunk"), "chunk_id", "chunk_index")
    return _pieces(_oversized(h, chunks), _limits(spark, sf_dir), with_text=True)


def p4_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of each text come to: the digest of the text they join to, and whether all keep the limit, the overlap and the line ends.

    A text's pieces meet in one row, which is no longer than the text.
    """
    p = p4_pieces(spark, sf_dir)
    limits = F.create_map(*[F.lit(x) for name, most, back in _limits(spark, sf_dir) for x in (name or "", F.struct(F.lit(most).alias("most"), F.lit(back).alias("back")))] or [F.lit(""), F.struct(F.lit(0).alias("most"), F.lit(0).alias("back"))])
    key = ["profile", "unit", "record_id", "commit_pos", "file_pos"]
    g = p.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("piece_index", "char_start", "char_end", "text"))).alias("p")).withColumn("l", F.try_element_at(limits, F.coalesce("profile", F.lit(""))))
    earlier = lambda i: F.get("p", i - 1)
    new = F.transform("p", lambda x, i: F.when(i == 0, x["text"]).otherwise(F.substring(x["text"], earlier(i)["char_end"] - x["char_start"] + 1, F.lit(2**31 - 1))))
    overlap = F.forall(F.transform("p", lambda x, i: (i == 0) | (F.coalesce(earlier(i)["char_end"], F.lit(0)) - x["char_start"] == F.col("l.back")) & F.endswith(F.coalesce(earlier(i)["text"], F.lit("")), F.substring(x["text"], F.lit(1), F.col("l.back")))), lambda x: x)
    # A cut that is no line end lies in a line longer than a piece: neither of the parts it divides holds another line whole.
    room = F.col("l.most") - F.col("l.back")
    ends = F.forall(F.transform("p", lambda x, i: (i + 1 == F.size("p")) | x["text"].rlike(r"[\n\r]$") | (F.length(F.regexp_extract(x["text"], r"([^\n\r]*)$", 1)) + F.length(F.regexp_extract(F.coalesce(F.get(new, i + 1), F.lit("")), r"^([^\n\r]*)", 1)) >= room)), lambda x: x)
    return g.select(*key, F.md5(F.array_join(new, "")).alias("digest"), F.forall("p", lambda x: F.length(x["text"]) <= F.col("l.most")).alias("within"), overlap.alias("overlaps"), ends.alias("at_lines"))


_PAGE = ["history_id", "commit_pos", "file_pos"]


def _pages(h: DataFrame) -> DataFrame:
    commits = h.select("history_id", "repo", F.posexplode("acf_commits").alias("commit_pos", "c"))
    files = commits.select("history_id", "repo", "commit_pos", F.posexplode("c.acf_files").alias("file_pos", "f"))
    return files.select(*_PAGE, "repo", F.col("f.patch").alias("patch")).where("patch is not null")


_PATHS = "history_id bigint, commit_pos int, file_pos int, repo string, family string, path string, score double"


def _extract(batch: pa.RecordBatch, lost: Callable[[str | None], frozenset]) -> pa.RecordBatch:
    """The paths of pages (key, repo, patch) with their scores, without those lost on their host."""
    got = [markup.page_paths(t, lost(r)) for r, t in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
    take = pa.array([i for i, g in enumerate(got) for _ in g], pa.int64())
    found = [[k[0] for g in got for k in g], [k[1] for g in got for k in g]]
    return pa.RecordBatch.from_arrays([*[batch.column(k).take(take) for k in range(4)], *[pa.array(x, pa.string()) for x in found], pa.array([v for g in got for v in g.values()], pa.float64())], names=[*_PAGE, "repo", "family", "path", "score"])


def page_paths(pages: DataFrame) -> DataFrame:
    """The generalised paths of each page with their scores, repeated deliveries once; no text in it."""
    rows = map_batches(pages.select(*_PAGE, "repo", "patch"), lambda b: _extract(b, lambda _: frozenset()), _PATHS)
    return rows.groupBy(*_PAGE, "repo", "family", "path").agg(F.max("score").alias("score"))


def host_votes(paths: DataFrame) -> DataFrame:
    """repo, family, path, votes: the scores of a host's pages added up; pages meet in partial sums first, so a large host is no hot group."""
    return paths.groupBy("repo", "family", "path").agg(F.sum("score").alias("votes"))


def losers(paths: DataFrame) -> DataFrame:
    """The paths in doubt that lost, by page: their own score and the votes of the host's other pages do not reach WINS."""
    doubt = paths.where(F.col("score") < markup.WINS)
    v = host_votes(paths).select(F.col("repo").alias("host"), F.col("family").alias("f"), F.col("path").alias("p"), "votes")
    own = F.col("repo").eqNullSafe(F.col("host")) & (F.col("family") == F.col("f")) & (F.col("path") == F.col("p"))
    # The host's votes are those of the others and the page's own score.
    return doubt.join(v, own).where(F.col("votes") < markup.WINS).select(*_PAGE, "repo", "family", "path")


MOST_LOST = 200_000  # host paths that lost are sent to all tasks up to so many, else joined by page


def _lost_paths(lost: DataFrame) -> Shipped | None:
    """The lost paths by host, if few; all pages of a host that doubt a path share its votes, so a path is lost on all of them."""
    rows = lost.select("repo", "family", "path").distinct().limit(MOST_LOST + 1).collect()
    if len(rows) > MOST_LOST:
        return None
    by: dict = {}
    for r in rows:
        by.setdefault(r.repo, set()).add((r.family, r.path))
    return Shipped(lost, {k: frozenset(v) for k, v in by.items()})


def _with_lost(pages: DataFrame, lost: DataFrame, work: Callable, schema: str, only: bool = False) -> DataFrame:
    """``work(batch, lost paths of each row)`` over pages, or over those with a lost path ``only``.

    Texts are shuffled only where more than ``MOST_LOST`` paths were lost.  A lost path has less
    than one vote on its host and a doubtful sign half a vote or more, so it is lost by one page:
    the pages with a lost path are no more than the paths.
    """
    sent = _lost_paths(lost)
    cols = pages.select(*_PAGE, "repo", "patch")
    if only:
        few = lost.select(*_PAGE).distinct()
        cols = cols.join(F.broadcast(few) if sent is not None else few, _PAGE, "left_semi").select(*_PAGE, "repo", "patch")
    if sent is not None:
        return map_batches(cols, lambda b: work(b, [sent.get().get(r, frozenset()) for r in b.column(3).to_pylist()]), schema)
    mine = lost.groupBy(*_PAGE).agg(F.collect_set(F.struct("family", "path")).alias("lost"))
    return map_batches(cols.join(mine, _PAGE, "left"), lambda b: work(b, [frozenset((x["family"], x["path"]) for x in r or ()) for r in b.column(5).to_pylist()]), schema)


def _again(batch: pa.RecordBatch, lost: list[frozenset]) -> pa.RecordBatch:
    it = iter(lost)
    return _extract(batch, lambda _: next(it))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose patch adds a construct of a family, by the paths that won on their host.

    A page none of whose paths lost keeps what was extracted; the others (few) are extracted
    again without the paths that lost.
    """
    pages = _pages(histories(spark, sf_dir, repo=("repo",), file=("patch",)))
    paths = written(page_paths(pages))
    lost = written(losers(paths))
    again = _with_lost(pages, lost, _again, _PATHS, only=True).select(*_PAGE, "family")
    kept = paths.join(lost.select(*_PAGE).distinct(), _PAGE, "left_anti").select(*_PAGE, "family")
    return kept.unionByName(again).select(*_PAGE, F.col("family").alias("markup")).distinct()


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The added lines of each file as clean text, extracted again without the paths that lost on their host; repeated deliveries once."""
    h = first_deliveries(histories(spark, sf_dir, repo=("repo", "delivered_at"), file=("patch",)), "history_id", "delivered_at")
    pages = _pages(h)
    lost = written(losers(written(page_paths(pages))))

    def work(batch: pa.RecordBatch, gone: list[frozenset]) -> pa.RecordBatch:
        out = [markup.clean(t, g) for t, g in zip(batch.column(4).to_pylist(), gone)]
        return pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], pa.array(out, pa.string())], names=[*_PAGE, "text"])

    return _with_lost(pages, lost, work, "history_id bigint, commit_pos int, file_pos int, text string")


QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces, "p4_joined": p4_joined, "p5_found": p5_found, "p5_clean": p5_clean, "p3_found": p3_found, "p3_segments": p3_segments, "p6_found": p6_found, "p6_restored": p6_restored}
_SQL_FILES = """with g as (select * from (select *, row_number() over (partition by history_id order by delivered_at) n from git_history_diffs) where n = 1),
c as (select history_id, i - 1 commit_pos, acf_commits[i] c from (select *, unnest(range(1, len(acf_commits) + 1)) i from g) where acf_commits[i] is not null),
f as (select history_id, commit_pos, j - 1 file_pos, c.acf_files[j] f from (select *, unnest(range(1, len(c.acf_files) + 1)) j from c) where c.acf_files[j] is not null)
"""
SQL: dict[str, str] = {
    "p4_found": _SQL_FILES
    + """select 'patch' unit, history_id record_id, cast(commit_pos as int) commit_pos, cast(file_pos as int) file_pos from f where length(f.patch) > (select max_chars from chunk_limits)
union select 'chunk', chunk_id, -1, -1 from diffchunk where length(text) > (select max_chars from chunk_limits)""",
    "p4_joined": _SQL_FILES
    + """, t as (select 'patch' unit, history_id record_id, cast(commit_pos as int) commit_pos, cast(file_pos as int) file_pos, f.patch text from f union all select 'chunk', chunk_id, -1, -1, min_by(text, chunk_index) from diffchunk group by chunk_id)
select profile, unit, record_id, commit_pos, file_pos, md5(text) digest, true "within", true "overlaps", true at_lines from t, chunk_limits where length(text) > max_chars""",
}
