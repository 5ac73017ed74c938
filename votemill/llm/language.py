"""The language of texts and of their stretches, where labels are missing or wrong.

Words first: a known word is scored by its log frequency in each language; an unknown one
falls back to its character n-grams, the longest length at which any is known (``LONGEST``
down to 1).  A sentence has the language with the best sum, if it leads by ``MARGIN``.

What is scored are sentences: lines are freed of markup, and names, paths, commands, flags,
addresses and code are masked.  A text without a whole sentence is judged by its phrases.

The model is trained on a bounded sample of labelled texts (``SAMPLE_TEXTS`` of each language),
whose labels may be wrong and which may be mixed: after a first fit every sentence goes to the
language it is most likely in, and the model is fitted again (``ROUNDS``).  A word's frequency
is that among a language's sentences, not among its words: a sentence that stands in texts of
all languages alike then speaks for none, whatever the languages' words are like.

Edge cases: null, empty and blank texts, code, names and fragments have no language; texts
of any length are read whole; an empty sample knows no language and gives no rows; every label
that is a two-letter code, or the name or longer code of one, is learned; any other stands for a
language of its own that no text is in.
"""

from __future__ import annotations

import re
from collections import Counter
from math import exp, log
from typing import NamedTuple

SAMPLE_TEXTS = 600
SAMPLE_CHARS = 20_000  # of a longer text a passage of so many characters is trained on, wherever in the text
ROUNDS = 2
LONGEST = 4
MARGIN = 3.0
KNOWN = 0.6  # share of known words that a phrase needs where a text has no sentence
LEAST_TEXTS = 3  # a language needs so many sampled texts to be learned
MEMO = 100_000
MEMO_CHARS = 300  # longer lines are not remembered

# ISO 639-1 codes with their ISO 639-2 codes and English names.
LANGUAGES = """
ar ara arabic; bg bul bulgarian; bn ben bengali; ca cat catalan; cs ces cze czech; da dan danish; de deu ger german; el ell gre greek; en eng english;
es spa spanish castilian; et est estonian; fa fas per persian; fi fin finnish; fr fra fre french; he heb hebrew; hi hin hindi; hr hrv croatian; hu hun hungarian;
id ind indonesian; it ita italian; ja jpn japanese; ko kor korean; lt lit lithuanian; lv lav latvian; nl nld dut dutch; no nor norwegian; pl pol polish;
pt por portuguese; ro ron rum romanian; ru rus russian; sk slk slo slovak; sl slv slovenian; sr srp serbian; sv swe swedish; th tha thai; tr tur turkish;
uk ukr ukrainian; ur urd urdu; vi vie vietnamese; zh zho chi chinese mandarin
"""
CODES = {name: words[0] for entry in LANGUAGES.replace("\n", " ").split(";") if (words := entry.split()) for name in words}
MISSING = ("", "und", "unknown")


def code(label: str | None) -> str | None:
    """The two-letter code a label stands for; null for a missing one."""
    if label is None:
        return None
    low = label.strip().lower()
    if low in MISSING:
        return None
    return CODES.get(low) or CODES.get(re.split(r"[-_ (]", low)[0]) or low


_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>|&#?\w+;")
_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*\)")
_WIKI = re.compile(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]")
_LATEX = re.compile(r"\\(?:begin|end|ref|label|cite|includegraphics)\*?(?:\[[^\]]*\])?\{[^{}]*\}|\\[A-Za-z]+\*?|\$[^$\n]*\$")
_DRIVE = re.compile(r"(?<!\w)[A-Za-z]:\\\S*")
_CODE = re.compile(r"`[^`\n]*`|\{\{.*?\}\}|\{code.*?\}")
_NAME = re.compile(
    r"(?:https?://|www\.)\S+|(?<!\S)[^\s/]*/\S*|\b\w+(?:_\w+)+\b|\b\w+\\_\w+\b|\b[A-Za-z]+[a-z][A-Z]\w*\b|\b[\w-]+\.(?:[a-z]{1,5})\b|(?<!\w)--?[A-Za-z][\w-]*|\b\w*\d\w*\b|@\w+|#\S+|<[^<>\s]*>"
)
_LEAD = re.compile(r"^\s*(?:[-*+#>|=;:!]+|\d+[.)]|\[[ xX]\]|h[1-6]\.|bq\.|[a-z]+(?:\([\w-]+\))?:(?=\s))\s*")
_SPLIT = re.compile(r"(?<=[.!?…])[\s\"'”’»)*_~]+|(?<=[。！？])|\s+/\s+|\s*\|+\s*")
_EAST = "぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ"
_WORD = re.compile(rf"[{_EAST}]+|(?:(?![{_EAST}])[^\W\d_])+(?:['’](?:(?![{_EAST}])[^\W\d_])+)*")
_CODESIGN = re.compile(r"[{}<>=$;]|\w\(|\)\s*[{;]|\|\||&&|::|->")
_MAYBE_CODE = re.compile(r"[{}<>=$;(|&]|::|->")  # without one of these _CODESIGN finds nothing
_CODEWORDS = frozenset("import from export let const return assert SELECT copy tar if".split())
_FIRST = re.compile(r"\s*(\w+)\b")
_AROUND = ".,;:!?…\"'()[]{}*_~“”„«»’‘"
_CUT = re.compile(r"[。！？/|]|[.!?…][\s\"'”’»)*_~]")  # without one of these _SPLIT cuts nothing
_DIFF_SKIP = ("@@", "diff --git", "+++ ", "--- ", "\\ No newline", "index ")


class Piece(NamedTuple):
    """A sentence or phrase: its words, where its line lies, and whether it is whole."""

    words: tuple[str, ...]
    start: int
    end: int
    whole: bool
    size: int


def _size(words: tuple[str, ...]) -> int:
    """Words; of scripts without spaces two characters count as one."""
    return sum(max(1, len(w) // 2) if "぀" <= w[0] else 1 for w in words)


_pieces_memo: dict[str, list[tuple[tuple[str, ...], bool, int]]] = {}


def line_pieces(line: str) -> list[tuple[tuple[str, ...], bool, int]]:
    """(words, whole, size) of the sentences and phrases of one line."""
    got = _pieces_memo.get(line)
    if got is None:
        got = _line_pieces(line)
        if len(line) <= MEMO_CHARS:
            if len(_pieces_memo) >= MEMO:
                _pieces_memo.clear()
            _pieces_memo[line] = got
    return got


def _line_pieces(line: str) -> list[tuple[tuple[str, ...], bool, int]]:
    out = []
    s = line
    if "<" in s or "&" in s:
        s = _TAG.sub(" ", s)
    if "[" in s:
        s = _WIKI.sub(r"\1", _LINK.sub(r"\1", s))
    if "\\" in s or "$" in s:
        s = _LATEX.sub(" ", _DRIVE.sub(" ", s))
    if "`" in s or "{" in s:
        s = _CODE.sub(" ", s)
    s = s.strip(" \t\r*_~'=}{\"”“«»„‘")
    if not s or s.isascii() and not any(c.isalpha() for c in s):
        return out
    if not s[0].isalpha() or ":" in s or s[:3] == "bq." or s[2:3] == ".":
        for _ in range(3):
            s, n = _LEAD.subn("", s, count=1)
            if not n:
                break
    first = _FIRST.match(s)
    codelike = bool(first and first.group(1) in _CODEWORDS) or bool(_MAYBE_CODE.search(s) and _CODESIGN.search(s))
    for part in _SPLIT.split(s) if _CUT.search(s) else (s,):
        if not part:
            continue
        whole = part.rstrip(" \"'”’»)*_~")[-1:] in _ENDS
        if codelike and not whole:
            continue
        words = _words(part)
        size = len(words) if part.isascii() else _size(words)
        if size >= (5 if codelike else 3):
            out.append((words, whole, size))
    return out


_ENDS = frozenset(".!?…。！？:")


def _words(part: str) -> tuple[str, ...]:
    """The words of a sentence in lower case, without names, paths, commands and code; these are told token by token."""
    out: list[str] = []
    for token in part.split():
        core = token.strip(_AROUND)
        if core.isalpha() and (core[1:].islower() or len(core) == 1) and (core.isascii() or max(core) < "぀") and token[0] not in "@#":
            out.append(core.lower())
        else:
            out += _WORD.findall(_NAME.sub(" ", token).lower())
    return tuple(out)


def pieces(text: str | None, diff: bool = False) -> list[Piece]:
    """The sentences and phrases of a text; of a diff without its marks and headers."""
    out: list[Piece] = []
    if not text:
        return out
    at = 0
    for line in text.splitlines(keepends=True):
        end = at + len(line)
        s = line
        if diff:
            if s.startswith(_DIFF_SKIP):
                at = end
                continue
            if s[:1] in "+- ":
                s = s[1:]
        for words, whole, size in line_pieces(s.rstrip("\r\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029")):
            out.append(Piece(words, at, end, whole, size))
        at = end
    return out


class Languages:
    """Log frequencies of words (among sentences) and of character n-grams by language."""

    def __init__(self, names: list[str], words: dict, grams: list[dict]):
        self.names, self.words, self.grams = names, words, grams
        self.memo: dict[str, tuple[float, ...]] = {}
        self.judged: dict[tuple[str, ...], tuple[str | None, float, float]] = {}

    def word(self, w: str) -> tuple[float, ...]:
        """A word's log frequency in each language, known or by backing off."""
        got = self.words.get(w) or self.memo.get(w)
        if got is None:
            got = (0.0,) * len(self.names)
            s = f" {w} "
            for n in range(LONGEST, 0, -1):
                table = self.grams[n - 1]
                rows = [r for i in range(len(s) - n + 1) if (r := table.get(s[i : i + n]))]
                if rows:
                    got = tuple(sum(x) / len(rows) for x in zip(*rows))
                    break
            if len(w) <= MEMO_CHARS:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[w] = got
        return got

    def knows(self, words: tuple[str, ...]) -> bool:
        """Is most of a phrase made of known words?  What is not may be code or names."""
        return sum(w in self.words for w in words) >= KNOWN * len(words)

    def scores(self, words: tuple[str, ...]) -> list[float]:
        return [sum(x) for x in zip(*map(self.word, words))] if words else [0.0] * len(self.names)

    def judge(self, words: tuple[str, ...]) -> tuple[str | None, float, float]:
        """(language, its lead over the next in log likelihood, confidence from 0 to 1)."""
        if not self.names or not words:
            return None, 0.0, 0.0
        got = self.judged.get(words)
        if got is None:
            got = self._judge(words)
            if len(words) <= MEMO_CHARS // 6 and sum(map(len, words)) <= MEMO_CHARS:
                if len(self.judged) >= MEMO:
                    self.judged.clear()
                self.judged[words] = got
        return got

    def _judge(self, words: tuple[str, ...]) -> tuple[str | None, float, float]:
        s = self.scores(words)
        best = max(range(len(s)), key=s.__getitem__)
        lead = s[best] - max([x for i, x in enumerate(s) if i != best], default=s[best] - 99.0)
        return self.names[best], lead, 1 / sum(exp(max(-60.0, x - s[best])) for x in s)


def fit(sentences: list[tuple[str, tuple[str, ...]]]) -> Languages:
    """The model of (language, words) pairs."""
    names = sorted({lang for lang, _ in sentences})
    place = {n: i for i, n in enumerate(names)}
    counts: list[Counter] = [Counter() for _ in names]
    number = [0] * len(names)
    for lang, words in sentences:
        counts[place[lang]].update(set(words))
        number[place[lang]] += 1

    def table(per: list[Counter], totals: list[int]) -> dict:
        kinds = len(set().union(*per)) if per else 0
        base = [log(0.02 / (t + 0.02 * kinds + 1)) for t in totals]
        out: dict[str, list[float]] = {}
        for i, c in enumerate(per):
            for w, n in c.items():
                out.setdefault(w, list(base))[i] = log((n + 0.02) / (totals[i] + 0.02 * kinds + 1))
        return {w: tuple(v) for w, v in out.items()}

    grams = []
    for n in range(1, LONGEST + 1):
        per = []
        for c in counts:
            g: Counter = Counter()
            for w in c:
                s = f" {w} "
                for i in range(len(s) - n + 1):
                    g[s[i : i + n]] += 1
            per.append(g)
        grams.append(table(per, [sum(c.values()) for c in per]))
    return Languages(names, table(counts, number), grams)


def train(texts: list[tuple[str | None, str]]) -> Languages:
    """The model of (label, text) pairs with labels as delivered."""
    known = [(c, t) for label, t in texts if (c := code(label)) and re.fullmatch("[a-z]{2}", c)]
    often = Counter(c for c, _ in known)
    sentences = [(c, p.words) for c, t in known if often[c] >= LEAST_TEXTS for p in dict.fromkeys((q.words, q.whole) for q in pieces(t)) for p in [Piece(p[0], 0, 0, p[1], 0)] if p.whole]
    model = fit(sentences)
    for _ in range(ROUNDS):
        moved = []
        for _, words in sentences:
            lang, lead, _ = model.judge(words)
            if lang and lead > MARGIN:
                moved.append((lang, words))
        model = fit(moved)
    return model


def stretches(model: Languages, text: str | None, kind: str) -> list[tuple[str, int, int, float, int]]:
    """(language, start, end, confidence, whole sentences) of each stretch of a text in one language.

    ``kind`` is ``message``, ``patch`` or ``document``.  Neighbouring sentences in one language
    make one stretch.  In a message, whose first line is a heading without a full stop, phrases
    of three words and more count as sentences; in other texts phrases count only where there is
    no sentence at all.
    """
    found = pieces(text, kind == "patch")
    least = 3 if kind == "message" else 10**9
    chosen = [p for p in found if p.whole or p.size >= least]
    fallback = not chosen
    out: list[list] = []
    for p in chosen or found:
        if fallback and not model.knows(p.words):
            continue
        lang, lead, sure = model.judge(p.words)
        if lang is None or lead < MARGIN:
            continue
        if out and out[-1][0] == lang:
            out[-1][2] = p.end
            out[-1][3].append(sure)
            out[-1][4] += p.whole
        else:
            out.append([lang, p.start, p.end, [sure], int(p.whole)])
    return [(a, s, e, sum(c) / len(c), n) for a, s, e, c, n in out]
