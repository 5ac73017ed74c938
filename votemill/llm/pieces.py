"""Cutting oversized texts at natural boundaries, by packing the tree of their structure.

A text is a tree: files of a diff, their hunks, sections under headings of six ranks, blocks
(paragraphs, lists, code, tables), list items by their depth, lines, sentences, and at the bottom
words.  A node that fits is kept whole, and whole siblings under one parent are merged up to the
limit; only a node that is too large is opened.  What comes from an opened node is not merged
with its neighbours, so no piece holds a part of one file and anything of another.  A node's
head (the lines of a file before its first hunk, a heading before its first block) goes with
what follows it, so that no piece ends with a bare header if the header and one line fit.

Every piece but the first begins with the last ``overlap`` characters of the piece before, and
no piece is longer than the limit, overlap included.  Positions are code points.

Edge cases: a text within the limit, empty or null, gives no pieces; a word longer than a piece
is cut at the limit; a first part shorter than the overlap takes in the next one (which fits,
as the first piece repeats nothing); a limit below 2, or an overlap not below the limit, is
refused, a negative overlap is none; pieces without their overlaps join to the text exactly.
"""

from __future__ import annotations

import re
from bisect import bisect_left

_SIGN = r"^[+\- ]?"
_HEADING = re.compile(_SIGN + r"(?:(#{1,6}) |(={1,6}) ?[^=\s].*=\s*$|h([1-6])\. |\\((?:sub)*)(?:section|paragraph)\b|\\(chapter)\b|<h([1-6])\b)", re.M)
_ITEM = re.compile(_SIGN + r"([ \t]*)(?:[-*+]|\d{1,3}[.)]) +\S|" + _SIGN + r"([*#]{1,6}) +\S|" + _SIGN + r"\s*\\item\b|" + _SIGN + r"\s*<li\b", re.M)
_FILE = re.compile(r"^diff --git ", re.M)
_HUNK = re.compile(r"^@@ ", re.M)
_BLOCK = re.compile(r"(?<=\n)[+\- ]?[ \t]*\r?\n(?=[^\n])|" + _SIGN + r"(?:```|~~~|\{\||\\begin\b|<(?:ul|ol|pre|table|details)\b)", re.M)
_LINE = re.compile(r"(?<=\n)|(?<=\r)(?!\n)")
_SENTENCE = re.compile(r"(?<=[.!?。！？])(?=\s|[^\x00-\x7f])")
_WORD = re.compile(r"(?<=\s)(?=\S)")
_RANKS = range(1, 7)


def _rank(m: re.Match) -> int:
    """The rank of a heading, from 1."""
    marks, equals, wiki, subs, chapter, tag = m.groups()
    if marks or equals:
        return len(marks or equals)
    if wiki or tag:
        return int(wiki or tag)
    return 1 if chapter else 2 + len(subs or "") // 3


def _depth(m: re.Match) -> int:
    """The depth of a list item, from 0."""
    indent, marks = m.groups()
    return len(marks) - 1 if marks else min(5, len((indent or "").expandtabs(4)) // 2)


class Tree:
    """A text's nodes, found level by level where they are asked for."""

    def __init__(self, text: str):
        self.text = text
        self._starts: dict = {}
        plain = lambda p: lambda: [m.start() for m in p.finditer(text)]
        heads = lambda k: lambda: [m.start() for m in self._once("headings", _HEADING) if _rank(m) <= k]
        items = lambda k: lambda: [m.start() for m in self._once("items", _ITEM) if _depth(m) <= k]
        self.levels = [plain(_FILE), plain(_HUNK), *[heads(k) for k in _RANKS], plain(_BLOCK), *[items(k) for k in range(6)], plain(_LINE), plain(_SENTENCE), plain(_WORD)]
        self.heads_end = 2 + len(_RANKS)  # levels below this have heads that go with what follows

    def _once(self, name: str, pattern: re.Pattern) -> list[re.Match]:
        if name not in self._starts:
            self._starts[name] = list(pattern.finditer(self.text))
        return self._starts[name]

    def starts(self, level: int) -> list[int]:
        if level not in self._starts:
            self._starts[level] = self.levels[level]()
        return self._starts[level]

    def children(self, lo: int, hi: int, level: int) -> list[int]:
        """The edges of the node's children at a level, its head joined to the first of them."""
        at = self.starts(level)
        edges = [lo, *at[bisect_left(at, lo + 1) : bisect_left(at, hi)], hi]
        k = bisect_left(at, lo)
        if 0 < level < self.heads_end and len(edges) > 2 and not (k < len(at) and at[k] == lo):
            del edges[1]
        return edges


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """The new part of each piece as (start, end); the parts join to the text."""
    overlap = max(0, overlap)
    if limit < 2 or overlap >= limit:
        raise ValueError("the limit must be at least 2 and above the overlap")
    room = limit - overlap
    tree = Tree(text)

    def pack(lo: int, hi: int, level: int) -> list[tuple[int, int]]:
        """The parts of a node that is larger than a piece."""
        while level < len(tree.levels) and len(edges := tree.children(lo, hi, level)) == 2:
            level += 1
        if level == len(tree.levels):
            return [(a, min(a + room, hi)) for a in range(lo, hi, room)]
        out: list[tuple[int, int]] = []
        whole = False  # may the last part take in a sibling?
        for a, b in zip(edges, edges[1:]):
            if b - a > room:
                out += pack(a, b, level + 1)
                whole = False
            elif whole and b - out[-1][0] <= room:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
                whole = True
        return out

    parts = pack(0, len(text), 0) if len(text) > room else [(0, len(text))]
    while len(parts) > 1 and parts[0][1] < overlap:
        parts[:2] = [(0, parts[1][1])]
    return parts


def split(text: str | None, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, text) of each piece of a text above the limit, the overlap included."""
    if not text or len(text) <= limit:
        return []
    back = max(0, overlap)
    return [(max(0, a - back), b, text[max(0, a - back) : b]) for a, b in cuts(text, limit, overlap)]
