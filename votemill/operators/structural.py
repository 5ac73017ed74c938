"""Structural index of JSON text: whole batches at once, with no parser and no loop over characters.

The bytes of a batch of payloads lie in one array.  Bitmaps mark unescaped quotes, brackets
and delimiters outside strings; the parity of a prefix sum over quotes says what is inside a
string, and a prefix sum over brackets gives the nesting depth.  Every value then has a
start, a parent container, a place within its parent and (within an object) a key, all found
with searches over these arrays.  ``linked_rows`` follows a path of keys down this index.

Payloads are separated by a byte that JSON text cannot hold outside strings (0x01), and the
depth of each payload is taken relative to its own start, so a malformed payload cannot
shift another one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_QUOTE, _BACK = 0x22, 0x5C
_OPEN = np.zeros(256, bool)
_OPEN[[0x7B, 0x5B]] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[[0x7D, 0x5D]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0D]] = True


@dataclass
class Index:
    """Parallel arrays, one entry per JSON value in document order."""

    data: np.ndarray
    start: np.ndarray  # first byte of the value
    parent: np.ndarray  # the value that contains it, -1 for the root of a payload
    place: np.ndarray  # 0-based place within the parent
    key_from: np.ndarray  # span of the key's text, -1 outside objects
    key_to: np.ndarray
    payload: np.ndarray  # which payload of the batch
    quotes: np.ndarray  # unescaped quotes
    closes: np.ndarray  # closing brackets outside strings
    depth: np.ndarray  # after each byte

    def kind(self) -> np.ndarray:
        return self.data[self.start]

    def has_key(self, which: np.ndarray, key: str) -> np.ndarray:
        """Of the values ``which``: is its key exactly ``key``?"""
        raw = np.frombuffer(key.encode(), np.uint8)
        a, b = self.key_from[which], self.key_to[which]
        out = (a >= 0) & (b - a == len(raw))
        hit = np.flatnonzero(out)
        if len(hit):
            out[hit] = (self.data[a[hit][:, None] + np.arange(len(raw))] == raw).all(axis=1)
        return out


def build(payloads: list[bytes]) -> Index:
    """The index of a batch.

    Empty payloads, and payloads whose brackets do not balance or which end within a string,
    have no values at all: a damaged text gives no rows instead of wrong ones.
    """
    sizes = np.array([len(p) + 1 for p in payloads], np.int64)
    data = np.frombuffer(b"\x01".join(payloads) + b"\x01", np.uint8)
    n = len(data)
    ends = np.cumsum(sizes) - 1
    begins = ends - sizes + 1

    # Escaped quotes: an odd run of backslashes stands before them.
    quote = data == _QUOTE
    at = np.flatnonzero(quote)
    if len(at):
        back = np.flatnonzero(data == _BACK)
        if len(back):
            first = np.flatnonzero(np.diff(back, prepend=-2) != 1)  # first backslash of each run
            run_end = back[np.append(first[1:], len(back)) - 1]
            run = run_end - back[first] + 1
            k = np.searchsorted(run_end, at - 1)
            k = np.minimum(k, len(run_end) - 1)
            escaped = (run_end[k] == at - 1) & (run[k] % 2 == 1)
            at = at[~escaped]
            quote = np.zeros(n, bool)
            quote[at] = True

    # Inside strings by prefix parity, per payload.
    total = np.cumsum(quote, dtype=np.int64)
    base = np.where(begins > 0, total[begins - 1], 0)
    odd_ends = (total[ends] - base) % 2 == 1
    parity = (total - np.repeat(base, sizes)) & 1
    outside = (parity == 0) & ~quote
    bracket = outside & (_OPEN[data] | _CLOSE[data])
    step = np.where(bracket, np.where(_OPEN[data], 1, -1), 0).astype(np.int32)
    depth = np.cumsum(step, dtype=np.int64)
    depth -= np.repeat(np.where(begins > 0, depth[begins - 1], 0), sizes)
    low = np.minimum.reduceat(depth, begins)
    bad = odd_ends | (depth[ends] != 0) | (low < 0)

    # A value starts at the first byte that is not blank after the start of a payload, '[', '{', ',' or ':'.
    comma, colon = outside & (data == 0x2C), outside & (data == 0x3A)
    opens = outside & _OPEN[data]
    good = np.repeat(~bad, sizes)
    marks = np.flatnonzero((comma | colon | opens) & good)
    roots = begins[~bad]
    solid = np.flatnonzero(~_BLANK[data])
    lead = np.concatenate([roots, marks + 1])
    lead_mark = np.concatenate([np.full(len(roots), -1), marks])
    pos = solid[np.minimum(np.searchsorted(solid, lead), len(solid) - 1)]
    # Within objects only what follows ':' is a value; the rest are keys.
    mark_byte = np.where(lead_mark >= 0, data[np.maximum(lead_mark, 0)], 0)
    d_here = np.where(lead_mark >= 0, depth[np.maximum(lead_mark, 0)], 0)
    order = np.argsort(pos, kind="stable")
    pos, lead_mark, mark_byte, d_here = pos[order], lead_mark[order], mark_byte[order], d_here[order]

    # The container of each mark: the last open bracket at that depth before it.
    open_at = np.flatnonzero(opens)
    open_depth = depth[open_at]
    container = np.full(len(pos), -1, np.int64)
    for d in np.unique(d_here[d_here > 0]):
        mine = open_at[open_depth == d]
        sel = np.flatnonzero(d_here == d)
        container[sel] = mine[np.searchsorted(mine, lead_mark[sel], side="right") - 1]
    in_object = (container >= 0) & (data[np.maximum(container, 0)] == 0x7B)
    first = data[pos]
    is_value = np.where(in_object, mark_byte == 0x3A, mark_byte != 0x3A) & ~_CLOSE[first] & (first != 0x01) & (first != 0x2C)
    pos, container, in_object, lead_mark = pos[is_value], container[is_value], in_object[is_value], lead_mark[is_value]

    # Parent values: container positions are themselves value starts.
    parent = np.where(container >= 0, np.searchsorted(pos, container), -1)
    parent = np.where((parent >= 0) & (pos[np.minimum(np.maximum(parent, 0), len(pos) - 1)] == container), parent, -1) if len(pos) else parent
    # Place within the parent: rank among its values.
    by = np.lexsort((pos, parent))
    place = np.zeros(len(pos), np.int64)
    if len(pos):
        p = parent[by]
        new = np.flatnonzero(np.diff(p, prepend=p[0] - 1))
        place[by] = np.arange(len(p)) - np.repeat(new, np.diff(np.append(new, len(p))))
    key_from = np.full(len(pos), -1, np.int64)
    key_to = np.full(len(pos), -1, np.int64)
    sel = np.flatnonzero(in_object)
    if len(sel) and len(at) > 1:
        k = np.searchsorted(at, lead_mark[sel])
        ok = k >= 2
        key_from[sel[ok]], key_to[sel[ok]] = at[k[ok] - 2] + 1, at[k[ok] - 1]
    payload = np.searchsorted(ends, pos)
    return Index(data, pos, parent, place, key_from, key_to, payload, at, np.flatnonzero(outside & _CLOSE[data]), depth)


def linked_rows(ix: Index, path: tuple[str, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Follow ``path`` down the index; per level: the values found and, for each, the row of its parent in the level above.

    Level 0 are the payloads' top objects: the root itself, or the elements of a root list.
    A value under a key that is no list counts as a list of one; nulls are no rows but keep
    their place in a list; of a key that is repeated in an object each value counts.
    """
    kind = ix.kind() if len(ix.start) else np.zeros(0, np.uint8)
    null = kind == 0x6E
    root = np.flatnonzero(ix.parent < 0)
    lists = root[kind[root] == 0x5B]
    inner = np.flatnonzero(np.isin(ix.parent, lists)) if len(lists) else np.zeros(0, np.int64)
    level = np.sort(np.concatenate([root[kind[root] != 0x5B], inner]))
    level = level[~null[level]]
    out = [(level, np.full(len(level), -1, np.int64))]
    for key in path:
        holder = np.flatnonzero(np.isin(ix.parent, level)) if len(level) else np.zeros(0, np.int64)
        holder = holder[ix.has_key(holder, key)]
        is_list = kind[holder] == 0x5B
        one = holder[~is_list & ~null[holder]]
        child = np.flatnonzero(np.isin(ix.parent, holder[is_list])) if is_list.any() else np.zeros(0, np.int64)
        child = child[~null[child]]
        above = np.concatenate([ix.parent[one], ix.parent[ix.parent[child]]])
        values = np.concatenate([one, child])
        order = np.argsort(values, kind="stable")
        values, above = values[order], above[order]
        out.append((values, np.searchsorted(level, above)))
        level = values
    return out


def places(ix: Index, levels: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Per level the place of each row: within its list, or 0 where it stands alone."""
    kind = ix.kind() if len(ix.start) else np.zeros(0, np.uint8)
    out = []
    for values, _ in levels:
        up = ix.parent[values]
        in_list = (up >= 0) & (kind[np.maximum(up, 0)] == 0x5B)
        out.append(np.where(in_list, ix.place[values], 0))
    return out


def ends(ix: Index, values: np.ndarray) -> np.ndarray:
    """One past the last byte of each value: the closing quote, the matching bracket, or the next delimiter."""
    start = ix.start[values]
    kind = ix.data[start]
    out = np.zeros(len(values), np.int64)
    text = kind == _QUOTE
    out[text] = ix.quotes[np.searchsorted(ix.quotes, start[text], side="right")] + 1
    box = _OPEN[kind]
    for d in np.unique(ix.depth[start[box]]):
        sel = np.flatnonzero(box)[ix.depth[start[box]] == d]
        mine = ix.closes[ix.depth[ix.closes] == d - 1]
        out[sel] = mine[np.searchsorted(mine, start[sel])] + 1
    plain = ~text & ~box
    if plain.any():
        stop = np.flatnonzero((ix.data == 0x2C) | _CLOSE[ix.data] | _BLANK[ix.data] | (ix.data == 0x01))
        out[plain] = stop[np.searchsorted(stop, start[plain])]
    return out


def spans(ix: Index, values: np.ndarray) -> list[str | None]:
    """The value of each string or other scalar as text, null for a null; containers as JSON text."""
    raw = ix.data.tobytes()
    out: list[str | None] = []
    for k, a, b in zip(ix.data[ix.start[values]].tolist(), ix.start[values].tolist(), ends(ix, values).tolist()):
        if k == _QUOTE:
            inner = raw[a + 1 : b - 1]
            out.append(_unescaped(inner) if _BACK in inner else inner.decode("utf-8", "replace"))
        else:
            out.append(None if k == 0x6E else raw[a:b].decode("utf-8", "replace"))
    return out


_SHORT = {ord(a): b for a, b in zip("bfnrt", "\b\f\n\r\t")}


def _unescaped(inner: bytes) -> str:
    """The text of a JSON string with its escapes resolved; an escape that means nothing stays as it is."""
    out, k = [], 0
    while (j := inner.find(b"\\", k)) >= 0:
        out.append(inner[k:j].decode("utf-8", "replace"))
        c = inner[j + 1] if j + 1 < len(inner) else 0
        if c == 0x75:
            try:
                out.append(chr(int(inner[j + 2 : j + 6], 16)))
                k = j + 6
                continue
            except ValueError:
                pass
        out.append(_SHORT.get(c) or (chr(c) if c in b'"\\/' else inner[j : j + 2].decode("utf-8", "replace")))
        k = j + 2
    out.append(inner[k:].decode("utf-8", "replace"))
    s = "".join(out)
    return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if any("\ud800" <= ch <= "\udfff" for ch in s) else s
