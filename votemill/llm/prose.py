"""Keyword-stuffed pages and link lists: function words and word classes under an n-gram model of prose.

A page becomes a sequence of units (``units.py``): a function word stands for itself, any other
word for its class (script, case, length, and whether it stood just before), and numbers,
addresses, identifiers, tags and signs for their kinds.  A trigram model of such sequences,
trained on the corpus's own pages, gives each window of a page its surprise in bits a unit.
Pages made of keywords lack the alternation of function words and words that sentences have:
their windows lie far above (or, for one phrase over and over, far below) what prose shows.  A
page is flagged if most of its units lie in such windows.

Training needs no labels of spam: a first model learns lines that end as sentences do, a second
one the whole pages that are largely prose under the first (``PROSE``).  Every page of the
corpus is counted, and the cut-offs are percentiles of the windows of all pages, each page under
a model of the other half of them, so that a small corpus does not look better known than it is.
A sequence counts once a page, so a phrase that one page repeats a hundred times teaches little.

What a model holds: totals of every unit, pair and context (bounded by the kinds of units), and
the counts of its ``MOST_GRAMS`` most frequent trigrams; a rarer trigram is judged by its pair
and by what is known of its context, as an unseen one is.

Edge cases: a null, empty or blank text, and one of code or trees only, is no spam; the
length of a text has no limit; repeated texts are judged alike; with no pages all are sound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np

from votemill.llm import units as U

FUNCTION_WORDS = 2000  # words that stand for themselves
KINDS = U.FUNCTION_BASE + FUNCTION_WORDS
MOST_GRAMS = 500_000
SLICE = 1 << 16  # units worked on at once
PROSE = 0.6  # least share of prose of the pages in the second fit
WINDOW = 16  # units a window
ABOVE = 0.9999  # a window is abnormal above what but one of ten thousand windows of prose reaches
BELOW = 0.0005  # a window is abnormal below LOWER times what but so few windows of prose lie under
LOWER = 0.6
MOST_BITS = 6.0  # more than this is abnormal whatever the pages
MAINLY = 0.5  # a page is flagged if more than this share of it is abnormal
REPEATS = 0.4  # pages that repeat more of their words than this are not trained on
BINS = 4096  # windows are counted for the percentiles in bins of one part in so many, or in half as many

assert KINDS < 1 << 12
_RUN = U.URL + 2  # an address this far in a run is as rare as runs are in prose
_ENDED = np.uint32(1 << 15)


def pack(raw: np.ndarray, at: np.ndarray, function: U.Lookup) -> np.ndarray:
    """Raw units (``units.raw``) with function words told apart: code, prose line and size in 32 bits."""
    code, size, ended = U.coded(raw, at, function)
    return code.astype(np.uint32) | np.where(ended, _ENDED, np.uint32(0)) | (size.astype(np.uint32) << np.uint32(16))


def function_lookup(hashes: np.ndarray) -> U.Lookup:
    return U.Lookup(hashes, np.arange(len(hashes), dtype=np.int32), -1)


class Pages:
    """Packed pages: ``code`` and ``ended`` by unit; ``at``, where each page begins."""

    def __init__(self, packed: np.ndarray, at: np.ndarray):
        self.packed, self.at = packed, at.astype(np.int64)

    @property
    def code(self) -> np.ndarray:
        return (self.packed & np.uint32(0x7FFF)).astype(np.int64)

    @property
    def ended(self) -> np.ndarray:
        return (self.packed & _ENDED) != 0

    def slices(self) -> Iterator[tuple[slice, Pages]]:
        """The pages in slices that stay in a core's cache."""
        first = 0
        while first < len(self):
            last = max(first + 1, int(np.searchsorted(self.at, self.at[first] + SLICE, "right")) - 1)
            a, b = self.at[first], self.at[last]
            yield slice(first, last), Pages(self.packed[a:b], self.at[first : last + 1] - a)
            first = last

    def __len__(self) -> int:
        return len(self.at) - 1

    def only(self, units: np.ndarray) -> Pages:
        """The pages with the units of a mask alone."""
        return Pages(self.packed[units], np.concatenate([[0], np.cumsum(units)])[self.at])

    def take(self, pages: np.ndarray) -> Pages:
        """The pages of a mask; the others are left without units."""
        return self.only(np.repeat(pages, np.diff(self.at)))

    def trigrams(self) -> np.ndarray:
        """Of each unit, the two units before it and itself as one number; a page starts behind two line ends (code 0)."""
        out = self.code
        c = out.copy()
        start = self.at[:-1][np.diff(self.at) > 0]
        one, two = c[:-1] << 12, c[:-2] << 24
        one[start[start > 0] - 1] = 0
        if len(two):
            two[start[start > 1] - 2] = 0
            second = start[(start > 0) & (start < len(c) - 1)]
            two[second - 1] = 0
        out[1:] |= one
        out[2:] |= two
        return out

    def page(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.at))


@dataclass
class Grams:
    """Counts of a model: trigrams (the most frequent), contexts of two units with their total and kinds, all pairs."""

    tri: np.ndarray
    tri_n: np.ndarray
    ctx: np.ndarray
    ctx_n: np.ndarray
    ctx_kinds: np.ndarray
    pair: np.ndarray
    pair_n: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, n: np.ndarray) -> Grams:
        """From the counts of all trigrams."""
        ctx, first, total, kinds = _grouped(keys >> 12, n)
        pair, _, pair_n, _ = _grouped(keys & 0xFFFFFF, n)
        top = np.lexsort((keys, -n))[:MOST_GRAMS]
        return Grams(keys[top], n[top], ctx, total, kinds, pair, pair_n)


def _grouped(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, first place, sum of n, rows)."""
    order = np.argsort(keys, kind="stable")
    k, n = keys[order], n[order]
    new = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    rows = np.diff(np.append(new, len(k)))
    return k[new], new, np.add.reduceat(n, new) if len(new) else n, rows


class Judge:
    """A trigram model interpolated by how many kinds of unit follow a context (Witten and Bell), as tables."""

    def __init__(self, g: Grams):
        b, c = g.pair >> 12, g.pair & 0xFFF
        n1 = np.bincount(c, g.pair_n, KINDS)
        p1 = (n1 + 0.5) / (n1.sum() + 0.5 * (np.count_nonzero(n1) + 1))
        n2, k2 = np.bincount(b, g.pair_n, KINDS), np.bincount(b, minlength=KINDS)
        total = np.maximum(n2 + k2, 1)
        rest = np.where(k2 > 0, k2 / total, 1.0)
        two = np.outer(rest, p1).astype(np.float32).reshape(-1)
        two[b * KINDS + c] += (g.pair_n / total[b]).astype(np.float32)
        self.two = two
        place = (g.ctx >> 12) * KINDS + (g.ctx & 0xFFF)
        total3 = np.ones(KINDS * KINDS, np.float32)
        total3[place] = g.ctx_n + g.ctx_kinds
        self.rest = np.ones(KINDS * KINDS, np.float32)
        self.rest[place] = g.ctx_kinds / (g.ctx_n + g.ctx_kinds)
        t = g.tri
        self.own = U.Lookup(t, (g.tri_n / total3[(t >> 24) * KINDS + (t >> 12 & 0xFFF)]).astype(np.float32), 0.0).find
        self.rare = -np.log2(p1)

    def bits(self, p: Pages) -> np.ndarray:
        t = p.trigrams()
        b, c = t >> 12 & 0xFFF, t & 0xFFF
        x = self.rest[(t >> 24) * KINDS + b]
        x *= self.two[b * KINDS + c]
        x += self.own(t)
        out = -np.log2(x)
        # A further address in a run is as rare as runs are in prose, however often a run that has begun goes on.
        run = (c >= _RUN) & (c < U.TAG)
        out[run] = self.rare[c[run]]
        return out


def windows(p: Pages, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(page, characters, mean bits) of each window of WINDOW units or a little more."""
    n = np.diff(p.at)
    k = np.where(n > 0, np.maximum(1, n // WINDOW), 0)
    page = np.repeat(np.arange(len(n)), k)
    i = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    start = p.at[page] + n[page] * i // np.maximum(k[page], 1)
    if not len(start):
        return page, start, np.zeros(0)
    length = np.diff(np.append(start, len(bits)))
    return page, np.add.reduceat(p.packed >> np.uint32(16), start, dtype=np.int64), np.add.reduceat(bits, start, dtype=np.float64) / length


class ProseModel:
    """Function words, the trigram counts and both cut-offs; tables are built where the model is used."""

    def __init__(self, function: np.ndarray, grams: Grams | None, low: float = 0.0, high: float = float("inf")):
        self.function, self.grams, self.low, self.high = function, grams, low, high
        self._made = None

    def __getstate__(self):
        return self.__dict__ | {"_made": None}

    @property
    def tables(self) -> tuple[U.Lookup, Judge | None]:
        if self._made is None:
            self._made = function_lookup(self.function), Judge(self.grams) if self.grams is not None else None
        return self._made

    def windows(self, p: Pages) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return windows(p, self.tables[1].bits(p))

    def page_shares(self, p: Pages) -> np.ndarray:
        """By page, the share of its worded characters in windows that are abnormally surprising or abnormally predictable."""
        out = np.zeros(len(p))
        if self.grams is not None:
            for where, q in p.slices():
                page, size, mean = self.windows(q)
                bad = (mean > self.high) | (mean < self.low)
                out[where] = np.bincount(page, size * bad, len(q)) / np.maximum(np.bincount(page, size, len(q)), 1)
        return out

    def shares(self, texts: list[str | None]) -> np.ndarray:
        raws = (U.raw(U.Block(block)) for _, block in U.blocks(texts))
        out = [self.page_shares(Pages(pack(raw, at, self.tables[0]), at)) for raw, at in raws]
        return np.concatenate(out) if out else np.zeros(0)

    def is_spam(self, text: str | None) -> bool:
        return bool(self.shares([text])[0] > MAINLY)


Counted = tuple[np.ndarray, np.ndarray]  # keys and how often each


def counted(keys: np.ndarray) -> Counted:
    k = np.sort(keys)
    new = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[new], np.diff(np.append(new, len(k)))


def added(parts: list[Counted]) -> Counted:
    """Counts added up by key."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    k, _, total, _ = _grouped(keys, n)
    return k, total


def word_keys(raw: np.ndarray, at: np.ndarray) -> Counted:
    """Words on prose lines, each once a page; pages that repeat themselves have none."""
    return counted(U.distinct_words(raw, at, U.repeats(raw, at) <= REPEATS))


def gram_keys(p: Pages, half: np.ndarray) -> Counted:
    """Trigrams, each once a page, under the page's half (in the bits above 36)."""
    of = p.page()
    x = np.sort(p.trigrams() | (half[of] << 36) | (of << 37))
    return counted(x[np.append(True, x[1:] != x[:-1])] & ((1 << 37) - 1)) if len(x) else counted(x)


def bin_keys(mean: np.ndarray) -> Counted:
    """The upper ends of the values' bins, as the bits of a double; bins grow with the value, so that the smallest are told apart too."""
    m, e = np.frexp(mean)
    return counted(np.ldexp(np.ceil(m * BINS) / BINS, e).view(np.int64))


# The four passes over packed pages; each takes a slice of the pages trained on, their halves, and the models made so far.


def line_grams(p: Pages, half: np.ndarray, models: tuple) -> Counted:
    return gram_keys(p.only(p.ended), half)


def line_windows(p: Pages, half: np.ndarray, models: tuple) -> Counted:
    return _other_half(p.only(p.ended), half, models)


def page_grams(p: Pages, half: np.ndarray, models: tuple) -> Counted:
    return gram_keys(p.take(models[0].page_shares(p) <= 1 - PROSE), half)


def page_windows(p: Pages, half: np.ndarray, models: tuple) -> Counted:
    return _other_half(p.take(models[0].page_shares(p) <= 1 - PROSE), half, models[1:])


def _other_half(p: Pages, half: np.ndarray, models: tuple) -> Counted:
    """The windows of each page under the model of the other half."""
    found = [models[1 - h].windows(p.take(half == h))[2] for h in (0, 1)]
    return bin_keys(np.concatenate(found))


class Percentiles:
    """Values counted in bins."""

    def __init__(self, counts: Counted):
        self.value, n = np.asarray(counts[0], np.int64).view(np.float64), np.asarray(counts[1])
        order = np.argsort(self.value)
        self.value, self.upto = self.value[order], np.cumsum(n[order])
        self.n = int(n.sum())

    def at(self, q: float) -> float:
        return float(self.value[np.searchsorted(self.upto, int(self.n * q), "right").clip(0, len(self.value) - 1)])


Pass = Callable[[Pages, np.ndarray, tuple], Counted]


class Corpus:
    """What ``fit`` asks of the pages; in memory here, in Spark in ``text_queries``."""

    def __init__(self, texts: list[str | None]):
        self.texts = texts

    def words(self) -> np.ndarray:
        """The most frequent words on prose lines."""
        self.raw = [U.raw(U.Block(b)) for _, b in U.blocks(self.texts)]
        k, n = added([word_keys(*r) for r in self.raw])
        return k[np.lexsort((k, -n))[:FUNCTION_WORDS]]

    def pack(self, function: np.ndarray) -> None:
        f = function_lookup(function)
        train = [U.repeats(*r) <= REPEATS for r in self.raw]
        parts = [Pages(pack(raw, at, f), at).take(t) for (raw, at), t in zip(self.raw, train)]
        self.pages = parts
        self.half = np.split(np.arange(len(self.texts)) % 2, np.cumsum([len(p) for p in parts]))

    def count(self, step: Pass, models: tuple = ()) -> Counted:
        return added([step(q, half[where], models) for p, half in zip(self.pages, self.half) for where, q in p.slices()])

    def grams(self, step: Pass, models: tuple = ()) -> tuple[Grams, Grams, Grams]:
        """The counts of each half and of both."""
        k, n = self.count(step, models)
        half = k >> 36
        both = added([(k & ((1 << 36) - 1), n)])
        return (*(Grams.of(k[half == h] & ((1 << 36) - 1), n[half == h]) for h in (0, 1)), Grams.of(*both))


def fit(corpus: Corpus) -> ProseModel:
    """The model of all pages."""
    function = corpus.words()
    corpus.pack(function)
    first = ProseModel(function, None)
    a, b, both = corpus.grams(line_grams)
    if not len(both.tri):
        return first
    values = Percentiles(corpus.count(line_windows, (ProseModel(function, a), ProseModel(function, b))))
    first = ProseModel(function, both, 0.0, values.at(0.95))
    a, b, both = corpus.grams(page_grams, (first,))
    if not len(both.tri):
        return ProseModel(function, first.grams)
    values = Percentiles(corpus.count(page_windows, (first, ProseModel(function, a), ProseModel(function, b))))
    return ProseModel(function, both, values.at(BELOW) * LOWER, min(MOST_BITS, values.at(ABOVE)))


def train(texts: Iterable[str | None]) -> ProseModel:
    """The model of pages in memory; the halves are every other page."""
    return fit(Corpus(list(texts)))
