"""Chunk plans: a text cut into pieces of whole lines, each repeating the end of the one before.

Lines are packed up to the limit; where a file or hunk of a diff begins in the later half of a
piece, the piece ends there.  Contract: no text is lost, a piece is at most ``max_chars`` long
(overlap included), a line that is longer than a piece is cut, a text within the limit is one
piece, an empty one has none.  A negative overlap is none; one as long as a piece is a quarter
of it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "array<struct<index:int,total:int,text:string,char_start:int,char_end:int>>"
# How a file and a hunk of a diff begin.
HEADERS = {"file": re.compile(r"diff --git "), "hunk": re.compile(r"@@ .* @@")}


def plan(text: str | None, max_chars: int, overlap: int = 400, boundary: str = "file") -> list[tuple[int, int, str, int, int]]:
    """(index, total, text, char_start, char_end) of each piece; positions are code points."""
    if not text:
        return []
    if max_chars < 2:
        raise ValueError("max_chars must be at least 2")
    n = len(text)
    back = max(0, overlap) if overlap < max_chars else max_chars // 4
    lines = text.splitlines(keepends=True)
    ends = list(accumulate(map(len, lines)))
    heads = [e - len(x) for x, e in zip(lines, ends) if HEADERS[boundary].match(x)]
    cuts: list[tuple[int, int]] = []
    done = 0
    while done < n:
        start = max(0, done - back) if cuts else 0
        stop = min(n, start + max_chars)
        if stop < n:
            k = bisect_right(ends, stop)
            whole = ends[k - 1] if k else 0
            if whole > done:
                stop = whole
                h = bisect_right(heads, whole)
                if h and heads[h - 1] > done and heads[h - 1] - start >= max_chars // 2:
                    stop = heads[h - 1]
        cuts.append((start, stop))
        done = stop
    return [(i, len(cuts), text[a:b], a, b) for i, (a, b) in enumerate(cuts)]


def plan_chunks(c: Column, max_chars: int, overlap: int = 400, boundary: str = "file") -> Column:
    """The plan as an array of structs, in Arrow batches."""

    @F.pandas_udf(SCHEMA)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [dict(zip(("index", "total", "text", "char_start", "char_end"), p)) for p in plan(t, max_chars, overlap, boundary)])

    return run(c)


@F.udtf(returnType="index int, total int, text string, char_start int, char_end int")
class ChunkTable:
    """plan_chunks as a table function: select * from plan_chunks(text, max_chars, overlap)."""

    def eval(self, text: str, max_chars: int, overlap: int):
        yield from plan(text, max_chars, overlap)
