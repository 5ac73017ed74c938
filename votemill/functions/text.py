"""Scalar functions on texts and patches, as column expressions of the JVM.

Lines end at any Unicode line break.  Edge cases: null gives null (counts: 0 for an empty
text); an empty text has one empty first line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BREAK = r"\r\n|[\n\r\u000B\u000C\u001C\u001D\u001E\u0085  ]"
SPACE = r"[\s\u000B\u001C-\u001F\u0085   -     　]+"
# Fixed value: the marker that takes the place of the text cut off.
CUT = "\n...TRUNCATED..."


def lines(c: Column) -> Column:
    """The lines of a text; a break at the very end starts no further line."""
    return F.split(F.regexp_replace(c, f"(?:{BREAK})$", ""), BREAK)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}|{SPACE}$", "")


def patch_lines(patch: Column, sign: str) -> Column:
    """The stripped, non-blank lines that a patch adds ('+') or removes ('-'); file headers are none.

    A changed line whose own text starts with two more signs counts as a header, as it does
    for the histories' producer.
    """
    mine = F.filter(lines(patch), lambda x: x.startswith(sign) & ~x.startswith(sign * 3))
    return F.filter(F.transform(mine, lambda x: strip(F.substring(x, 2, 2**31 - 1))), lambda x: x != "")


def changed(patch: Column) -> Column:
    """The changed lines with their signs, in order, without blank ones."""
    mine = F.filter(lines(patch), lambda x: x.rlike("^[+-]") & ~x.startswith("+++") & ~x.startswith("---"))
    parts = F.transform(mine, lambda x: F.struct(F.substring(x, 1, 1).alias("s"), strip(F.substring(x, 2, 2**31 - 1)).alias("t")))
    return F.array_join(F.transform(F.filter(parts, lambda p: p["t"] != ""), lambda p: F.concat(p["s"], F.lit(" "), p["t"])), "\n")


def changed_count(patch: Column) -> Column:
    """Changed lines, blank ones too."""
    return F.size(F.filter(lines(patch), lambda x: x.rlike("^[+-]") & ~x.startswith("+++") & ~x.startswith("---")))


def patch_profile(patch: Column) -> Column:
    """added, removed and changed lines (the last with blank ones) and the changed text, from one split of the patch."""
    marks = F.filter(lines(patch), lambda x: x.rlike("^(?:[+](?![+][+])|-(?!--))"))
    parts = F.transform(marks, lambda x: F.struct(F.substring(x, 1, 1).alias("s"), strip(F.substring(x, 2, 2**31 - 1)).alias("t")))
    return F.struct(F.size(marks).alias("changed"), F.filter(parts, lambda p: p["t"] != "").alias("full"))


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 20), F.lit(CUT))).otherwise(c)


def tokens_estimate(c: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def clean(c: Column) -> Column:
    """Without replacement characters, blanks collapsed."""
    return F.btrim(F.regexp_replace(F.regexp_replace(c, "�", ""), SPACE, " "))


def first_line(c: Column) -> Column:
    return F.split(c, BREAK)[0]


def redact(c: Column, pattern: str = r"\b(?:sk|key|token)[-_][A-Za-z0-9]{6,}\b", mark: str = "[REDACTED]") -> Column:
    return F.regexp_replace(c, pattern, mark)


def anchor(path: Column) -> Column:
    """The anchor of a file within a commit page: the SHA-256 of its path."""
    return F.concat(F.lit("#diff-"), F.sha2(path, 256))


def slug(url: Column) -> Column:
    """owner_name of a repository address, without .git."""
    return F.regexp_replace(F.regexp_extract(url, r"([^/]+/[^/]+?)(?:\.git)?/?$", 1), "/", "_")


def safe_name(c: Column) -> Column:
    """A name for a path: other characters become one underscore each run, none at the ends."""
    return F.btrim(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), F.lit("._-"))


def seconds_to_wait(c: Column) -> Column:
    """The seconds named in a message such as "try again in 3.5 s"; null if none."""
    return F.nullif(F.regexp_extract(F.lower(c), r"(?:in\s+)?(\d+(?:\.\d+)?)\s*s", 1), F.lit("")).cast("double")
