"""Text decoded with the wrong character encoding: find it and restore the original.

For every pair of encodings (what the bytes were, what they were read as) the garbled form of
each character of the corpus's repertoire is computed beforehand; all forms lie in one
automaton.  A word with other than ASCII characters is scanned once; for each pair that
matches, the matched spans alone are replaced, and what comes out is weighed against what
stands there by counts of character trigrams in the corpus itself: a word is damaged where a
replacement is much more usual.  Words that are right stay as they are, in a damaged text too.

A sequence that is spoken of (``replace the stray sequence X``) stands alone and would be
restored to a sign or letter that does not stand alone in sound text; it is left.  Losses
that cannot be undone are found too: replacement characters, control characters of the C1
range, and words turned into question marks.

Training (``Repertoire``) counts all texts, each distinct one once; every character seen more
than once has its garbled forms in the automaton.

Edge cases: null, empty and ASCII texts are sound (but see question marks); a text of any
length is read whole; repeated rows are judged alike; an empty corpus has no known trigrams,
so only losses are found.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from math import log10

GAIN = 0.7  # how much more usual a restored word must be, in powers of ten
FEW = 2  # a word is doubtful if one of its characters was seen so often or less where it stands
SIGN = 0.03  # weight of the count of a sign against that of a letter
MEMO_WORDS = 200_000
MEMO_CHARS = 200  # longer words are not remembered

# Names of the codecs, as Python knows them.
MULTI_AS = ("latin-1", "cp1252", "cp1250", "cp1251", "cp437", "cp850", "cp866", "mac_roman", "iso8859-15", "iso8859-2", "koi8-r")
SINGLE = ("cp1252", "cp1250", "iso8859-2", "iso8859-15", "cp437", "cp850", "cp852", "mac_roman", "cp1251", "koi8-r", "cp866", "iso8859-5")
SINGLE_AS = ("latin-1", "cp1252", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "iso8859-2", "koi8-r", "cp866")
EAST_ASIAN = ("gbk", "big5", "cp932", "euc_jp", "cp949")
EAST_ASIAN_AS = ("latin-1", "cp1252", "cp1251", "cp437", "mac_roman")
TWICE = ("latin-1", "cp1252")

_TOKEN = re.compile(r"[^ \t\r\n]+")
_C1 = re.compile("[\x80-\x84\x86-\x9f]")
_LOST = re.compile(r"(?:^|[\s(\"'/:])\?+(?=[^\W\d]|\?)|[^\W\d_]\?+[^\W\d_]|(?:^|\s)\?+(?=[\s.,;:!)]|$)")
_QUOTES = "‘’“”„‚«»‹›"
_ADDRESS = re.compile(r"\S*[/=&]\S*")


def read_as(raw: bytes, codec: str) -> str | None:
    """Bytes read with a codec; where Windows leaves a byte undefined it is read as a control character, as browsers do."""
    try:
        return raw.decode(codec)
    except UnicodeDecodeError:
        if not codec.startswith("cp125"):
            return None
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def pairs() -> list[tuple[str, ...]]:
    """Every pair as (encoding of the bytes, what they were read as); with a third and fourth member, done twice."""
    out: list[tuple[str, ...]] = [("utf-8", w) for w in MULTI_AS]
    out += [("utf-8", a, "utf-8", b) for a in TWICE for b in TWICE]
    out += [(e, w) for e in EAST_ASIAN for w in EAST_ASIAN_AS]
    out += [(e, w) for e in SINGLE for w in SINGLE_AS if e != w]
    return out


def garble(text: str, pair: tuple[str, ...]) -> str | None:
    """What ``text`` looks like after the pair's mistake; null if it cannot happen."""
    for e, w in zip(pair[::2], pair[1::2]):
        try:
            got = read_as(text.encode(e), w)
        except UnicodeEncodeError:
            return None
        if got is None:
            return None
        text = got
    return text


def tokens_of(text: str) -> list[str]:
    return _TOKEN.findall(text)


def _shape(word: str) -> str:
    return " " + re.sub(r"\d", "0", word.lower()) + " "


def _near(c: str) -> str:
    return "a" if c.isalpha() else c


def _contexts(word: str):
    """(the character, what it is counted under) for each other than ASCII character of a word.

    A letter is counted with its neighbours as they are, a sign with the kinds of its
    neighbours: an opening quote stands before any letter.
    """
    s = _shape(word)
    for i, c in enumerate(s):
        if c > "\x7f":
            if c.isalpha():
                yield c, (s[i - 1 : i + 2], s[i - 1 : i + 1], s[i : i + 2])
            else:
                a, b = _near(s[i - 1]), _near(s[i + 1])
                yield c, ("~" + a + c + b, "~" + a + c, c + b + "~")


_SCRIPTS = re.compile("[A-Za-z\u00c0-\u024f][\u0370-\u04ff]|[\u0370-\u04ff][A-Za-z\u00c0-\u024f]|[\u0370-\u03ff][\u0400-\u04ff]|[\u0400-\u04ff][\u0370-\u03ff]")


def _mixed(word: str) -> bool:
    """Do letters of two alphabets stand next to each other?"""
    return bool(_SCRIPTS.search(word.replace("×", "").replace("÷", "")))


_LONE = re.compile(r"(?<![^\W\d_])(?![a-zA-Z])[^\W\d_](?![^\W\d_])")  # one letter among figures and signs


def bare(word: str) -> str:
    """A word in lower case without ASCII signs around it."""
    return word.lower().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


@dataclass
class Repertoire:
    """What sound text looks like: counts of characters, bigrams and trigrams around other than ASCII characters."""

    grams: dict[str, int]
    follows: dict[tuple[str, str], int]  # a word and the single letter after it
    words: dict[str, int]  # words with other than ASCII characters, seen more than twice
    characters: list[str]

    @staticmethod
    def of(texts: list[str]) -> Repertoire:
        first: Counter = Counter()
        for text in dict.fromkeys(texts):
            for pair in marked(text):
                first.update(said(pair))
        seen: Counter = Counter()
        for key, n in first.items():
            for k in keys_of(key):
                seen[k] += n
        return Repertoire.from_counts(seen.items())

    @staticmethod
    def from_counts(counts: Iterable[tuple[str, int]]) -> Repertoire:
        """From the counts of ``said`` and then ``keys_of`` over all texts; single words of fewer than three and followers of fewer than two may be missing."""
        grams: dict[str, int] = {}
        follows: dict[tuple[str, str], int] = {}
        words: dict[str, int] = {}
        for key, n in counts:
            kind, rest = key[0], key[1:]
            if kind == GRAM:
                grams[rest] = n
            elif kind == WORD:
                words[rest] = n
            else:
                before, word = rest.split("\n")
                follows[before, word] = n
        common = sorted((-n, c) for c, n in grams.items() if len(c) == 1 and n > 1 and not "\x80" <= c <= "\x9f" and c != "�")
        both = {x for _, c in common for x in (c, c.upper()) if len(x) == 1}
        return Repertoire(grams, follows, {w: n for w, n in words.items() if n > 2}, sorted(both | set("–—‘’“”„…•→€«»°±½×µ©")))


GRAM, WORD, FOLLOWS = "g", "w", "f"


def marked(text: str) -> list[str]:
    """The words with other than ASCII characters, each after the word before it and a line end; all that is learned from."""
    out, before = [], ""
    for word in tokens_of(text):
        if not word.isascii():
            out.append(f"{before}\n{word}")
        before = word.lower()
    return out


def said(pair: str) -> Iterable[str]:
    """What is counted of a marked word first: the word, and a single letter with the word before it."""
    before, word = pair.split("\n")
    yield WORD + word
    if len(word) == 1:
        yield f"{FOLLOWS}{before}\n{word.lower()}"


def keys_of(key: str) -> Iterable[str]:
    """What is counted of each time something was ``said``: the bare word and its grams, or the letter and its word."""
    if key[0] == FOLLOWS:
        yield key
        return
    word = key[1:]
    yield WORD + bare(word)
    for c, keys in _contexts(word):
        yield GRAM + c
        for k in keys:
            yield GRAM + k


class Mender:
    """The automaton over all garbled forms, and the judgement of words; built once per worker."""

    def __init__(self, known: Repertoire):
        import ahocorasick

        self.known = known
        self.pairs = pairs()
        forms: dict[str, list[tuple[int, str]]] = {}
        for c in known.characters:
            for k, pair in enumerate(self.pairs):
                g = garble(c, pair)
                if g and g != c and not g.isascii():
                    forms.setdefault(g, []).append((k, c))
        self.automaton = ahocorasick.Automaton()
        for g, found in forms.items():
            self.automaton.add_word(g, (len(g), found))
        if forms:
            self.automaton.make_automaton()
        self.any = bool(forms)
        self.memo: dict[str, tuple[str, str] | None] = {}

    def usual(self, word: str, sign: float = 1.0) -> float:
        """How usual the word's other than ASCII characters are where they stand, in powers of ten.

        ``sign`` weighs down the counts of signs, which are counted with any letters around them.
        """
        g = self.known.grams.get
        total = n = 0
        for c, (three, left, right) in _contexts(word):
            n += 1
            total += log10(0.05 + (1.0 if c.isalpha() else sign) * (g(three, 0) + 0.01 * (g(left, 0) + g(right, 0))) + 0.0002 * g(c, 0))
        return total / n if n else -9.0

    def doubtful(self, word: str) -> bool:
        """Does any of its characters stand where it hardly ever does?"""
        g = self.known.grams.get
        return any(g(three, 0) <= FEW for _, (three, _, _) in _contexts(word))

    def _candidates(self, word: str):
        by: dict[int, list[tuple[int, int, str]]] = {}
        for end, (n, found) in self.automaton.iter(word):
            for k, c in found:
                by.setdefault(k, []).append((end - n + 1, end + 1, c))
        for k, spans in by.items():
            spans.sort(key=lambda x: (x[0], -x[1]))
            out, at, long = [], 0, False
            for a, b, c in spans:
                if a >= at:
                    out += [word[at:a], c]
                    long |= b - a > 1
                    at = b
            yield k, "".join(out) + word[at:], long

    def mend_word(self, word: str) -> tuple[str, str] | None:
        """(restored word, pair) if the word is damaged and can be restored."""
        if word in self.memo:
            return self.memo[word]
        got = None
        now, raw = self.usual(word, SIGN), self.usual(word)
        doubtful = self.doubtful(word)
        times = self.known.words.get
        mine = times(bare(word), 0)
        mixed = _mixed(word)
        best, text, how = -9.0, "", -1
        for k, r, long in self._candidates(word):
            if r.isascii() or r == word or _C1.search(r) or (not mixed and _mixed(r)):
                continue
            # A sequence that is valid UTF-8 read wrongly is seldom a chance; one sign for another often is.
            if long and self.pairs[k][0] == "utf-8":
                u = self.usual(r) + 0.3
                sure = u > raw + 0.1
            else:
                if len(r) > 1 and _LONE.search(f" {r} "):
                    continue
                other = times(bare(r), 0)
                u = self.usual(r, SIGN)
                sure = (other >= 5 and other >= 5 * mine) or (doubtful and u > now + GAIN and u > 0 and not self.doubtful(r))
                if len(word) == 1 and len(r) == 1:
                    # A sign may stand alone after any word; a letter has to be known after the word before it (see mend).
                    u = self.usual(r) - 5 * r.isalpha()
                    sure = doubtful and not self.doubtful(r)
                u -= 0.5 * any(y.isupper() and x.islower() for x, y in zip(r, r[1:]) if y > "\x7f")
            if sure and u > best:
                best, text, how = u, r, k
        if how >= 0:
            got = (text, " > ".join(self.pairs[how]))
        if len(word) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            self.memo[word] = got
        return got

    def quoted(self, word: str) -> dict[int, str]:
        """By pair, a doubtful word with a usual quotation mark in place of its odd sign: half a proof."""
        if not self.doubtful(word):
            return {}
        return {k: r for k, r, _ in self._candidates(word) if r != word and not r.isascii() and all(c in _QUOTES for c in r if c > "\x7f") and not self.doubtful(r)}

    def _both_quotes(self, text: str) -> dict[str, tuple[str, str]]:
        """The two words of a quotation whose marks were garbled by one pair; either alone would prove nothing."""
        first: dict[int, tuple[str, str]] = {}  # by pair, a word that is half a quotation, and it restored
        for w in dict.fromkeys(_TOKEN.findall(text)):
            if not w.isascii() and not self.mend_word(w):
                for k, h in self.quoted(w).items():
                    if k in first:
                        return {x: (r, " > ".join(self.pairs[k])) for x, r in (first[k], (w, h))}
                    first[k] = w, h
        return {}

    def mend(self, text: str | None) -> tuple[bool, str | None, str | None, bool]:
        """(damaged, text with its damaged spans restored, pairs, whether all could be restored)."""
        if not text:
            return False, text, None, True
        lost = "�" in text or _lost(text)
        if text.isascii() or not self.any:
            return lost, text, None, not lost
        out, at, before = [], 0, ""
        how: list[str] = []
        both = self._both_quotes(text)
        for m in _TOKEN.finditer(text):
            word = m.group()
            if not word.isascii() and (got := self.mend_word(word) or both.get(word)):
                r = got[0]
                if len(r) > 1 or not (r.isalpha() or r in _QUOTES) or self.known.follows.get((before, r.lower()), 0) > 1:
                    out += [text[at : m.start()], r]
                    at = m.end()
                    how.append(got[1])
                    word = r
            before = word.lower()
        fixed = "".join(out) + text[at:]
        left = bool(_C1.search(fixed))
        return bool(how) or lost or left, fixed, "; ".join(dict.fromkeys(how)) or None, not lost and not left


def _lost(text: str) -> bool:
    """Words turned into question marks: marks before a letter, between letters, or alone."""
    if "?" not in text:
        return False
    return any(not _ADDRESS.fullmatch(text[m.start() : m.end()]) for m in _LOST.finditer(_ADDRESS.sub(" ", text)))


_menders: dict[int, Mender] = {}


def mender(known) -> Mender:
    """The mender of a shipped repertoire; once per worker."""
    k = known.get()
    if id(k) not in _menders:
        _menders.clear()
        _menders[id(k)] = Mender(k)
    return _menders[id(k)]
