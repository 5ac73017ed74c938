"""What became of an answer, and how it is shown: column expressions over scores, errors and texts.

Edge cases: null errors are none, a null map has no scores, a null text has no changed lines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

USABLE = 0.5
RETRIES = 5
# The error code of a missing list, the score and default of a rescued vector, and the
# patterns that name its category, the first that fits.
MISSING_LIST = "categories_missing_or_not_list"
RESCUE_SCORE = 0.20
RESCUE_DEFAULT = "Impl. Details"
RESCUE = (
    (r"(?:^|[\s`])/[a-z][\w-]+|slash command|custom command|\bmcp\b|\bagent\b|claude|copilot|\bllm\b", "AI Integration"),
    (r"pull request|\bpr\b|merge queue|\bcommit\b|\bbranch\b|code review", "Development Process"),
    (r"\btest|pytest|jest|vitest|coverage", "Testing"),
    (r"ci/cd|\bci\b|workflow|deploy|release|pipeline", "DevOps"),
    (r"npm run|cargo build|\bmake\b|compile|build command", "Build and Run"),
    (r"\.env\b|environment variable|config file|\bsetup\b|\binstall\b", "Conf.&Env."),
    (r"security|vulnerab|\bauth\b|token|secret", "Security"),
    (r"performance|latency|cache|optimi", "Performance"),
    (r"architecture|module|package|layer|design pattern", "Architecture"),
    (r"readme|changelog|\bdocs?\b|documentation|https?://", "Documentation"),
)
NO_RATIONALE = "Rationale not available for this score."


def no_scores(scores: Column) -> Column:
    """Is no score above zero?"""
    return F.coalesce(~F.exists(F.map_values(scores), lambda v: F.coalesce(v, F.lit(0.0)) > 0), F.lit(True))


def usable(scores: Column, threshold: float = USABLE) -> Column:
    """Does a score reach the threshold?"""
    return F.coalesce(F.exists(F.map_values(scores), lambda v: F.coalesce(v, F.lit(0.0)) >= threshold), F.lit(False))


def rescue_category(changed_text: Column) -> Column:
    """The category of a diff that no chunk scored, by its changed lines."""
    low = F.lower(changed_text)
    out = F.lit(RESCUE_DEFAULT)
    for pattern, category in reversed(RESCUE):
        out = F.when(low.rlike(pattern), category).otherwise(out)
    return out


def chunk_status(scores: Column, changed: Column, errors: Column, retried: Column) -> Column:
    """ok, recovered, retried_failed or fallback: an empty vector on changed lines is a fallback whatever else happened."""
    wrong = F.coalesce(F.size(errors), F.lit(0)) > 0
    late = F.when(usable(scores), "recovered").when(retried, "retried_failed").otherwise("fallback")
    return F.when(no_scores(scores) & (changed > 0), "fallback").when(~wrong, "ok").otherwise(late)


def needs_retry(parsed: Column, errors: Column, scores: Column, changed: Column, tries: Column) -> Column:
    """Should an answer be asked for again?  It is broken or empty, has no usable score, and tries are left."""
    wrong = ~parsed | (F.coalesce(F.size(errors), F.lit(0)) > 0) | ((changed > 0) & no_scores(scores))
    return wrong & ~usable(scores) & (tries < RETRIES)


def has_missing_list(errors: Column) -> Column:
    """Is the code of a missing list among the errors, plain or tagged with a chunk?"""
    return F.coalesce(F.exists(errors, lambda e: (e == MISSING_LIST) | (e.startswith("chunk") & e.endswith(MISSING_LIST))), F.lit(False))


def result_list(scores: Column, flagged: Column) -> Column:
    """The scores above zero, the highest first (ties by name), each with its first flagged rationale or the default text."""
    above = F.filter(F.map_entries(scores), lambda e: e["value"] > 0)
    reason = lambda name: F.coalesce(F.try_element_at(F.filter(flagged, lambda f: f["category"] == name), F.lit(1))["rationale"], F.lit(NO_RATIONALE))
    rows = F.transform(above, lambda e: F.struct((-e["value"]).alias("order"), e["key"].alias("category"), e["value"].alias("score"), reason(e["key"]).alias("rationale")))
    return F.transform(F.array_sort(rows), lambda r: F.struct(r["category"], r["score"], r["rationale"]))


def direction(added_text: Column) -> Column:
    """+ if a diff adds text, else -."""
    return F.when(F.coalesce(added_text, F.lit("")) != "", "+").otherwise("-")


def prior_display(date: Column, message: Column, most: int = 80) -> Column:
    """An earlier change in one line: its day and its message, blanks collapsed, cut with an ellipsis."""
    day = F.substring(F.btrim(F.coalesce(date, F.lit(""))), 1, 10)
    m = F.btrim(F.regexp_replace(F.coalesce(message, F.lit("")), r"[\s\u000B\u001C-\u001F\u0085   -     　]+", " "))
    cut = F.when(F.length(m) > most, F.concat(F.rtrim(F.substring(m, 1, most - 1)), F.lit("…"))).otherwise(m)
    return F.btrim(F.concat(day, F.lit(" — "), cut), F.lit(" —"))


def path_pattern(path: Column) -> Column:
    """A pattern that matches this path alone; only dots are escaped."""
    return F.concat(F.lit("^"), F.replace(path, F.lit("."), F.lit("\\.")), F.lit("$"))


def access(public_status: Column, owner_exists: Column, with_token: Column) -> Column:
    """Why a repository's commits cannot be read (a listing gave 404)."""
    return F.when(public_status == 200, "public_repo").when(~owner_exists, "owner_not_found").when(with_token, "access_denied_or_private").otherwise("repo_missing_or_private")


def last_commit(commits: Column) -> Column:
    """Message line, author and date of the last commit of a comparison; the committer stands in for a missing author."""
    c = F.try_element_at(commits, F.lit(-1))["commit"]
    blank = lambda x: F.nullif(x, F.lit(""))
    first = F.split(F.coalesce(c["message"], F.lit("")), r"\r\n|[\n\r\u000B\u000C\u001C\u001D\u001E\u0085  ]")[0]
    either = lambda f: F.coalesce(blank(c["author"][f]), blank(c["committer"][f]), F.lit(""))
    return F.struct(first.alias("message"), either("name").alias("author"), either("date").alias("date"))


def ascii_only(c: Column) -> Column:
    """Other characters as question marks, as an ASCII log shows them."""
    return F.regexp_replace(c, r"[^\x00-\x7F]", "?")


def without_controls(c: Column) -> Column:
    """Without the control characters that spreadsheets refuse."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def back_off(tries: Column, most: float = 30.0) -> Column:
    """Seconds before the next try: doubled each time, up to a bound; the random part is left out."""
    return F.least(F.lit(most), F.pow(F.lit(2.0), F.greatest(tries, F.lit(1)) - 1))


def safe_limit(context_tokens: Column, prompt_tokens: Column, answer_tokens: int = 4096, reserve: float = 0.1) -> Column:
    """Characters a diff may have within a model's context: what prompt, answer and a reserve leave, at four characters a token; at least 0."""
    left = F.floor(context_tokens * (1 - reserve)) - prompt_tokens - answer_tokens
    return F.greatest(F.lit(0), left * 4).cast("bigint")


def logprobs(answer: Column) -> Column:
    """The first usable list of log probabilities of an answer (JSON text): numbers, or objects that hold one; null if none."""
    # Where lists and numbers may stand.
    places = ("logprobs", "response_logprobs", "response_logprob", "eval_logprobs", "message.logprobs", "message.response_logprobs", "message.response_logprob")
    inner = ("token_logprobs", "token_log_probs", "logprobs", "log_probs")
    keys = ("logprob", "log_prob", "token_logprob")

    def numbers(text: Column) -> Column:
        items = F.from_json(text, "array<string>")
        value = lambda x: F.coalesce(x.try_cast("double"), *[F.get_json_object(x, f"$.{k}").try_cast("double") for k in keys])
        got = F.filter(F.transform(items, value), lambda v: v.isNotNull())
        return F.when(F.size(got) > 0, got)

    texts = [t for p in places for t in (f"$.{p}", *[f"$.{p}.{k}" for k in inner])]
    return F.coalesce(*[numbers(F.get_json_object(answer, t)) for t in texts])


def context_size(shown: Column) -> Column:
    """The context length in a model's description (JSON text): of its info, its parameters, or its file; null if none says."""
    info = F.map_filter(F.from_json(F.get_json_object(shown, "$.model_info"), "map<string,string>"), lambda k, v: k.contains("context_length") & (v.try_cast("int") > 0))
    number = lambda place, pattern: F.nullif(F.regexp_extract(F.coalesce(F.get_json_object(shown, place), F.lit("")), pattern, 1), F.lit("")).try_cast("int")
    return F.coalesce(F.try_element_at(F.map_values(info), F.lit(1)).try_cast("int"), number("$.parameters", r"num_ctx\s+(\d+)"), number("$.modelfile", r"(?i)PARAMETER\s+num_ctx\s+(\d+)"))


def prompt(diff_id: Column, filename: Column, message: Column, text: Column) -> Column:
    """The user's part of a prompt as JSON; nulls are blank."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.to_json(F.struct(blank(diff_id).alias("diff_id"), blank(filename).alias("filename"), blank(message).alias("commit_message"), blank(text).alias("diff")))


def answer_schema(categories: tuple[str, ...], types: tuple[str, ...] = ()) -> dict:
    """The JSON schema of an answer on the category axis, and on the maintenance axis if its types are given."""
    entry = lambda names: {"type": "array", "items": {"type": "object", "properties": {"name": {"type": "string", "enum": list(names)}, "score": {"type": "number", "minimum": 0, "maximum": 1}, "rationale": {"type": "string"}}, "required": ["name", "score", "rationale"]}}
    fields = {"categories": entry(categories), "primary_category": {"type": "string", "enum": list(categories)}, "summary": {"type": "string"}}
    if types:
        fields["maintenance"] = entry(types)
    return {"type": "object", "properties": fields, "required": [k for k in fields if k != "maintenance"]}


def prefilled(answer: Column) -> Column:
    """An answer whose first bracket was put into the model's mouth, whole again; one that has it already is left."""
    return F.when(F.ltrim(answer).startswith("{"), answer).otherwise(F.concat(F.lit("{"), answer))
