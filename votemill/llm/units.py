"""Pages as sequences of units, a block of pages at a time with numpy.

A unit is a word, an East Asian character, a number, an address, a tag, an identifier, a flag,
a hash tag or a sign.  The characters of a block lie in one array; units are cut where the kind
of character changes, and words are named by a hash of their lower case, so that no
Python object is made for a word.

Lines count that consist mainly of words or addresses (``Block.worded``); fenced blocks and
lines of which most characters are identifiers, flags, numbers or signs (code, trees, tables of
options, settings) are neither prose nor spam.

Edge cases: null, empty and blank texts have no units; a text of any length is one page of one
block; characters beyond the third plane are signs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

BLOCK = 1 << 17  # characters a block holds, or one page that is longer (it should stay in a core's cache)
SPACE, BREAK, LOWER, UPPER, DIGIT, UNDER, EAST, SIGN, SPAN = range(9)
# Kinds of units that are not words or single signs.
NL, URL, TAG, HASH, FLAG, ID, NUM, KANA, HAN, OTHER = 0, 1, 7, 8, 9, 10, 11, 12, 13, 14  # six codes for addresses
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~…–—“”„‘’«»·•。，、；：？！「」（）《》"
SIGN_BASE = OTHER + 1
CLASS_BASE = SIGN_BASE + len(SIGNS)
CLASSES = 3 * 3 * 3  # script, case, length
FUNCTION_BASE = CLASS_BASE + 2 * CLASSES
NEAR = 12  # a word seen again within so many content words is marked as repeated
_LAST = 0x20000
_JOIN, _STRONG, _STOP, _END = 1, 2, 4, 8
_GROUP = np.array([0, 0, 1, 1, 1, 1, 3, 4, 2], np.uint8)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower case of each character of the first two planes; all beyond are East Asian."""
    kind = np.full(_LAST + 1, SIGN, np.uint8)
    low = np.arange(_LAST + 1, dtype=np.uint32)
    for i in range(_LAST):
        ch = chr(i)
        if ch.isspace():
            kind[i] = BREAK if ch in "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029" else SPACE
        elif "぀" <= ch <= "ヿ" or "㐀" <= ch <= "鿿" or "豈" <= ch <= "﫿":
            kind[i] = EAST
        elif ch.isdecimal():
            kind[i] = DIGIT
        elif ch.isalnum():
            kind[i] = UPPER if ch.isupper() else LOWER
            s = ch.lower()
            low[i] = ord(s) if len(s) == 1 else i
    kind[ord("_")] = UNDER
    kind[_LAST] = EAST
    low[0x2019] = 0x27
    return kind, low


@lru_cache(1)
def _properties() -> tuple[np.ndarray, np.ndarray]:
    """By character: its code as a sign, and what it does: join words, make an identifier, stop an address, end a sentence."""
    code = np.full(_LAST + 1, OTHER, np.uint16)
    code[[ord(x) for x in SIGNS]] = np.arange(SIGN_BASE, CLASS_BASE)
    does = np.zeros(_LAST + 1, np.uint8)
    for chars, bit in (("./:\\-", _JOIN), ("./\\", _STRONG), ("\"'<>)]", _STOP), (".!?。！？", _END)):
        does[[ord(x) for x in chars]] |= bit
    return code, does


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**32, and of its inverse."""
    base = 0x9E6C63D1
    one = np.full(n, base, np.uint32)
    back = np.full(n, pow(base, -1, 1 << 32), np.uint32)
    one[0] = back[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(one, dtype=np.uint32), np.cumprod(back, dtype=np.uint32)


def blocks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(index of the first text, texts) of blocks of bounded size."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "") + 1
        if size and size + n > BLOCK:
            yield first, [x or "" for x in texts[first:i]]
            first, size = i, 0
        size += n
    if size:
        yield first, [x or "" for x in texts[first:]]


def _next(sorted_places: np.ndarray, of: np.ndarray, none: int) -> np.ndarray:
    """The first of ``sorted_places`` behind each of ``of``, else ``none``."""
    if not len(sorted_places):
        return np.full(len(of), none)
    return np.append(sorted_places, none)[np.searchsorted(sorted_places, of, "right")]


def _spans(c: np.ndarray, k: np.ndarray, text: str, sign: np.ndarray, sc: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, kind) of tags, entities and addresses; none overlap."""
    n = len(c)
    at: list[np.ndarray] = []
    to: list[np.ndarray] = []
    what: list[np.ndarray] = []

    def add(a: np.ndarray, b: np.ndarray, kind: int) -> None:
        at.append(a)
        to.append(b)
        what.append(np.full(len(a), kind, np.uint8))

    lt = sign[sc == 60]
    if len(lt):
        letter = lambda i: (c[np.minimum(i, n - 1)] < 128) & ((k[np.minimum(i, n - 1)] == LOWER) | (k[np.minimum(i, n - 1)] == UPPER))
        opens = letter(lt + 1) | ((c[lt + 1] == 47) & letter(lt + 2))
        gt = _next(sign[sc == 62], lt, n)
        good = opens & (gt - lt < 204) & (np.append(lt[1:], n) > gt) & (_next(breaks, lt, n) > gt) & (gt < n)
        add(lt[good], gt[good] + 1, TAG)
    amp = sign[sc == 38]
    if len(amp):
        semi = _next(sign[sc == 59], amp, n)
        good = (semi - amp > 1) & (semi - amp < 12)
        a, b = amp[good], semi[good]
        named = np.array([(x := text[i + 1 : j]).isascii() and x.isalpha() and x.islower() for i, j in zip(a.tolist(), b.tolist())], bool)
        add(a[named], b[named] + 1, TAG) if len(a) else None
    colon = sign[sc == 58]
    colon = colon[colon > 3]
    begin = []
    if len(colon):
        colon = colon[(c[np.minimum(colon + 1, n - 1)] == 47) & (c[np.minimum(colon + 2, n - 1)] == 47)]
        is_ = lambda p, word: np.logical_and.reduce([(c[np.maximum(p - len(word) + i, 0)] | 32) == ord(ch) for i, ch in enumerate(word)]) if len(p) else np.zeros(0, bool)
        https, http, ftp = is_(colon, "https"), is_(colon, "http"), is_(colon, "ftp")
        begin += [np.stack([colon[https] - 5, colon[https] + 3]), np.stack([colon[http] - 4, colon[http] + 3]), np.stack([colon[ftp] - 3, colon[ftp] + 3])]
    dot = sign[sc == 46]
    dot = dot[dot > 2]
    www = dot[(c[dot - 1] | 32 == 119) & (c[dot - 2] | 32 == 119) & (c[dot - 3] | 32 == 119)] if len(dot) else dot
    if len(www):
        begin.append(np.stack([www - 3, www + 1]))
    if begin and sum(b.shape[1] for b in begin):
        s = np.concatenate(begin, axis=1)
        stops = np.sort(np.concatenate([np.flatnonzero(k <= BREAK), sign[(_properties()[1][np.minimum(sc, _LAST)] & _STOP) > 0]]))
        end = _next(stops, s[1] - 1, n)
        good = end > s[1]
        add(s[0][good], end[good], URL)
    if not at:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint8)
    a, b, w = np.concatenate(at).astype(np.int64), np.concatenate(to).astype(np.int64), np.concatenate(what)
    order = np.lexsort((-b, a))
    a, b, w = a[order], b[order], w[order]
    reach = np.concatenate([[0], np.maximum.accumulate(b)[:-1]]) if len(a) else a
    free = a >= reach
    return a[free], b[free], w[free]


class Block:
    """The units of a block of pages.

    Arrays by unit, in order: ``kind`` (a code below SIGN_BASE, or one of a sign, or CLASS_BASE
    and up for a word's class), ``hash`` (of words and East Asian characters, else 0), ``size``
    in characters, ``line``; by line: ``page``, ``worded`` and ``ended`` (it ends as sentences do).
    """

    def __init__(self, texts: list[str]):
        text = "\n".join(texts) + "\n"
        kinds, lows = _tables()
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(c)
        cc = np.minimum(c, _LAST)
        k = kinds[cc]
        breaks = np.flatnonzero(k == BREAK)
        sign = np.flatnonzero(k == SIGN)
        sc = c[sign]
        before, after = k[sign - 1], k[sign + 1]  # the last character is a break
        letters = lambda x: (x == LOWER) | (x == UPPER)
        k[sign[((sc == 39) | (sc == 0x2019)) & letters(before) & letters(after)]] = LOWER
        k[sign[((sc == 44) | (sc == 46)) & (before == DIGIT) & (after == DIGIT)]] = DIGIT
        a, b, what = _spans(c, k, text, sign, sc, breaks)
        starts_span = np.zeros(n, bool)
        if len(a):
            size = b - a
            inside = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            k[inside] = SPAN
            starts_span[a] = True
        g = _GROUP[k]
        cut = np.empty(n, bool)
        cut[0] = True
        np.not_equal(g[1:], g[:-1], out=cut[1:])
        cut |= g >= 3
        cut |= starts_span
        edge = np.flatnonzero(cut)
        kept = g[edge] != 0
        st, en = edge[kept], np.append(edge[1:], n)[kept]
        m = len(st)
        page_at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        line_at = np.concatenate([[0], breaks + 1])[:-1] if len(breaks) else np.zeros(0, np.int64)
        self.page = np.searchsorted(page_at, line_at, "right") - 1
        self.pages = len(texts)
        grp, ch = g[st], c[st]
        first, last = k[st], k[en - 1]
        is_w = grp == 1
        # What makes a word an identifier: an underscore, a capital behind a small letter, figures beside letters.
        odd = np.flatnonzero((k[1:] == UPPER) & (k[:-1] == LOWER)) + 1
        under = np.flatnonzero(k == UNDER)
        mark = np.zeros(m, bool)
        if m:
            mark[np.searchsorted(st, odd, "right") - 1] = True
            mark[np.searchsorted(st, under, "right") - 1] = True
        num = is_w & (first == DIGIT) & (last == DIGIT)
        mark |= is_w & ((first == DIGIT) != (last == DIGIT))
        mark &= is_w
        close = np.zeros(m + 1, bool)  # no blank before this unit
        if m:
            close[1:m] = st[1:] == en[:-1]
        prev_w, next_w = np.zeros(m, bool), np.zeros(m, bool)
        if m:
            prev_w[1:] = is_w[:-1] & close[1:m]
            next_w[:-1] = is_w[1:] & close[1:m]
        both = (grp == 4) & prev_w & next_w
        codes, does = _properties()
        act = does[np.minimum(ch, _LAST)]
        joins = both & ((act & _JOIN) > 0)
        mark |= joins & ((act & _STRONG) > 0)
        hashed = (grp == 4) & (ch == 35) & next_w
        dash = (grp == 4) & (ch == 45)
        after_dash = np.zeros(m, bool)
        if m:
            after_dash[1:] = dash[:-1] & close[1:m]
        alone = dash & ~prev_w & ~after_dash
        worded_next = np.zeros(m, bool)
        if m:
            worded_next[:-1] = next_w[:-1] & ((first[1:] == LOWER) | (first[1:] == UPPER))
        double = np.zeros(m, bool)
        if m > 1:
            double[:-1] = alone[:-1] & after_dash[1:] & worded_next[1:]
        flagged = (alone & worded_next) | double
        glue = np.zeros(m, bool)
        if m:
            glue[1:] = joins[1:] | joins[:-1] | hashed[:-1] | flagged[:-1]
            glue[2:] |= double[:-2]
        heads = np.flatnonzero(~glue)
        if m:
            group = np.cumsum(~glue) - 1
            whole = np.maximum.reduceat(mark.view(np.uint8), heads).astype(bool) | hashed[heads] | flagged[heads]
            begins = ~glue | ~whole[group]
            f = np.flatnonzero(begins)
            merged = whole[group[f]] & ~glue[f]
        else:
            f, merged = heads, np.zeros(0, bool)
        stop = en[np.append(f[1:], m) - 1] if m else en
        self.size = (stop - st[f]).astype(np.int32)
        kind = np.full(len(f), OTHER, np.uint16)
        gf, cf = grp[f], ch[f]
        kind[gf == 4] = codes[np.minimum(cf[gf == 4], _LAST)]
        kind[gf == 3] = np.where(cf[gf == 3] < 0x3400, KANA, HAN)
        plain = (gf == 1) & ~merged & ~num[f]
        kind[(gf == 1) & num[f]] = NUM
        kind[merged] = ID
        kind[merged & hashed[f]] = HASH
        kind[merged & flagged[f]] = FLAG
        if len(a):
            own = gf == 2
            kind[own] = what[np.searchsorted(a, st[f][own], "right") - 1]
        # Words: hash of the lower case, and class by script, case and length.
        pw, back = _powers(1 << max(10, int(n).bit_length()))
        value = lows[cc]
        total = np.zeros(n + 1, np.uint32)
        with np.errstate(over="ignore"):
            value *= pw[:n]
            np.cumsum(value, dtype=np.uint32, out=total[1:])
            word = np.flatnonzero(plain | (gf == 3))
            ws, we = st[f][word], en[f][word]
            h = (total[we] - total[ws]) * back[ws]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x9E3779B1)
        self.hash = np.zeros(len(f), np.uint32)
        self.hash[word] = np.maximum(h, 1)
        p = np.flatnonzero(plain)
        fc, sz = cf[p], self.size[p]
        script = np.where((fc >= 0xAC00) & (fc <= 0xD7A3), 1, np.where((fc >= 0x400) & (fc < 0x500), 2, 0))
        upper = first[f][p] == UPPER
        shout = upper & (sz > 1) & (last[f][p] == UPPER)
        case = np.where(shout, 1, np.where(upper, 2, 0))
        long = np.where(sz < 4, 0, np.where(sz < 8, 1, 2))
        kind[p] = CLASS_BASE + script * 9 + case * 3 + long
        self.kind = kind
        self.is_word = plain
        # Lines.
        su = st[f]
        begin = np.searchsorted(su, line_at)
        count = np.diff(np.append(begin, len(su)))
        self.line = np.repeat(np.arange(len(line_at)), count)
        some = np.flatnonzero(count)
        b0 = begin[some]
        chars = np.zeros(len(line_at), np.int64)
        words = np.zeros(len(line_at), np.int64)
        real = np.zeros(len(line_at), bool)
        ended = np.zeros(len(line_at), bool)
        fence = np.zeros(len(line_at), bool)
        if len(some):
            counted = plain | (gf == 3) | (kind == HASH) | (kind == URL) | (kind == TAG)
            chars[some] = np.add.reduceat(self.size, b0, dtype=np.int64)
            words[some] = np.add.reduceat(np.where(counted, self.size, 0), b0, dtype=np.int64)
            real[some] = np.maximum.reduceat((plain | (gf == 3)).view(np.uint8), b0).astype(bool)
            tail = b0 + count[some] - 1
            ended[some] = (gf[tail] == 4) & ((act[f[tail]] & _END) > 0)
            tick = (gf == 4) & ((cf == 96) | (cf == 126))
            three = (count[some] > 2) & tick[b0] & tick[np.minimum(b0 + 1, len(cf) - 1)] & tick[np.minimum(b0 + 2, len(cf) - 1)]
            fence[some] = three & (su[np.minimum(b0 + 2, len(su) - 1)] - su[b0] == 2)
        opened = np.cumsum(fence)
        base = (opened - fence)[np.searchsorted(self.page, np.arange(self.pages))] if len(line_at) else opened
        inside_fence = (opened - base[self.page]) % 2 == 1 if len(line_at) else fence
        self.worded = ~fence & ~inside_fence & (chars > 0) & (2 * words >= chars)
        self.ended = ended & real

    def keep(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(units on the lines of a mask, the page of each)."""
        on = np.flatnonzero(lines[self.line])
        return on, self.page[self.line[on]]


def seen_near(h: np.ndarray, page: np.ndarray, near: int = NEAR) -> np.ndarray:
    """Does the same hash stand among the ``near`` before it on its page?"""
    with np.errstate(over="ignore"):
        x = h ^ (page.astype(np.uint32) * np.uint32(0x9E3779B1))
    out = np.zeros(len(x), bool)
    for d in range(1, min(near, len(x) - 1) + 1):
        out[d:] |= x[d:] == x[:-d]
    return out


_WORD, _ENDED = np.uint32(1 << 30), np.uint32(1 << 29)


def raw(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """(two 32-bit numbers for each unit on a worded line, where each page begins): its hash; its kind, size and flags.

    A line end stands behind each line.
    """
    lines = np.flatnonzero(b.worded)
    on, _ = b.keep(b.worded)
    line = (np.cumsum(b.worded) - 1)[b.line[on]]
    at = np.arange(len(on)) + line
    out = np.zeros((len(on) + len(lines), 2), np.uint32)
    out[at, 0] = b.hash[on]
    ended = b.ended[lines]
    meta = b.kind[on].astype(np.uint32) | (np.minimum(b.size[on], 0xFFFF).astype(np.uint32) << np.uint32(12))
    meta |= np.where(b.is_word[on], _WORD, np.uint32(0)) | np.where(ended[line], _ENDED, np.uint32(0))
    out[at, 1] = meta
    count = np.bincount(line, minlength=len(lines)) + 1
    close = np.cumsum(count) - 1
    out[close, 1] = np.where(ended, _ENDED, np.uint32(0))
    page = np.zeros(b.pages + 1, np.int64)
    np.cumsum(np.bincount(b.page[lines], count, b.pages), out=page[1:])
    return out, page


def repeats(units: np.ndarray, at: np.ndarray) -> np.ndarray:
    """By page, the share of its longer words that stood among the NEAR longer words before."""
    meta = units[:, 1]
    long = np.flatnonzero(((meta & _WORD) > 0) & ((meta >> np.uint32(12) & np.uint32(0xFFFF)) > 3))
    page = np.repeat(np.arange(len(at) - 1), np.diff(at))[long]
    again = np.bincount(page, seen_near(units[long, 0], page), len(at) - 1)
    return again / np.maximum(1, np.bincount(page, minlength=len(at) - 1))


def distinct_words(units: np.ndarray, at: np.ndarray, pages: np.ndarray) -> np.ndarray:
    """The hashes of words and East Asian characters on prose lines of the pages of a mask, each once a page."""
    page = np.repeat(np.arange(len(at) - 1), np.diff(at))
    on = np.flatnonzero((units[:, 0] > 0) & ((units[:, 1] & _ENDED) > 0) & pages[page])
    x = np.sort((page[on].astype(np.int64) << 32) | units[on, 0])
    return x[np.append(True, x[1:] != x[:-1])] & 0xFFFFFFFF if len(x) else x


def coded(units: np.ndarray, at: np.ndarray, function: Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, size, whether on a prose line) of raw units."""
    h, meta = units[:, 0], units[:, 1]
    code = (meta & np.uint32(0xFFF)).astype(np.uint16)
    size = ((meta >> np.uint32(12)) & np.uint32(0xFFFF)).astype(np.int32)
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    real = np.flatnonzero(h)
    found = function.find(h[real].astype(np.uint64))
    hit = found >= 0
    code[real[hit]] = FUNCTION_BASE + found[hit]
    content = np.flatnonzero((meta & _WORD) > 0)
    content = content[code[content] < FUNCTION_BASE]
    code[content] += (CLASSES * seen_near(h[content], of[content])).astype(np.uint16)
    # Addresses on end: how many stood before, each within a few units of the next.
    url = np.flatnonzero(code == URL)
    if len(url):
        near = np.zeros(len(url), bool)
        near[1:] = (url[1:] - url[:-1] <= 7) & (of[url[1:]] == of[url[:-1]])
        place = np.arange(len(url))
        run = place - np.maximum.accumulate(np.where(near, 0, place))
        code[url] = URL + np.minimum(run, 5)
    return code, size, (meta & _ENDED) > 0


class Lookup:
    """A fixed hash table with open addresses; ``find`` gives the value of each 64-bit key, or ``none``."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, none):
        keys = np.asarray(keys).astype(np.uint64)
        size = 1 << max(4, int(3 * len(keys)).bit_length())
        self.shift = np.uint64(64 - (size.bit_length() - 1))
        self.mask = np.uint64(size - 1)
        self.keys = np.full(size, np.uint64(2**64 - 1), np.uint64)
        self.values = np.full(size, none, np.asarray(values).dtype)
        self.free = np.uint64(2**64 - 1)
        self.none = none
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            empty = todo[self.keys[slot[todo]] == self.free]
            self.keys[slot[empty]] = keys[empty]  # of several for one slot the last stays
            self.values[slot[empty]] = values[empty]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            slot = keys ^ (keys >> np.uint64(29))
            slot *= _MIX
        slot >>= self.shift
        return slot

    def find(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.view(np.uint64)
        slot = self._slot(keys)
        there = self.keys[slot]
        out = self.values[slot]
        todo = np.flatnonzero(there != keys)
        if len(todo):
            none = self.values.dtype.type(self.none)
            held = there[todo] != self.free
            out[todo] = none
            todo = todo[held]
            slot = slot[todo]
            while len(todo):
                slot = (slot + np.uint64(1)) & self.mask
                there = self.keys[slot]
                hit = there == keys[todo]
                out[todo[hit]] = self.values[slot[hit]]
                more = ~hit & (there != self.free)
                todo, slot = todo[more], slot[more]
        return out
