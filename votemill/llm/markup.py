"""Markup in the lines that patches add: which constructs they hold, and clean text without them.

A page is the added lines of one file; its host is the repository.  A construct stands in a
container: an element, environment, table, template, list or quotation that the page has opened.
Its generalised path names the family, the innermost container and the construct, with classes
but without figures (``html/pre/code.lang-py``, ``wiki/table/cell``, ``latex/itemize/item``).

A page scores a path by its signs: each has a strength, and ``n`` signs leave the doubt that all
are chance.  A sign that could be chance is strong where its container speaks for it (a row
within an opened table).  The scores are the page's votes; Spark adds them up by host and path,
and a path wins on a page if its own score and the votes of the host's *other* pages reach
``WINS``.  Pages with a path that lost are extracted again without it: what stood in a lost
container then belongs to the next one out.

Clean text keeps headings (``#``), lists (``-``, ``1.``), code blocks (fences), tables
(cells between bars) and formulas (between dollars).

Edge cases: null and empty patches have no lines; a patch without a plus line has no page; a
null repository is a host of its own; lines of any length are read whole; source code,
placeholders, addresses and indentation are no markup, in a code block or outside it.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

WINS = 1.0  # score and votes of other pages that a path needs
WEAK = 0.5  # the strength of a sign that could well be chance
LIKELY = 0.8  # the strength of a sign that is seldom chance
MEMO_LINES = 50_000
MEMO_CHARS = 400  # longer lines are not remembered

# Names of HTML elements, of LaTeX commands and of wiki macros.
ELEMENTS = """a abbr article aside b big blockquote body br button caption center cite code col dd del details div dl dt em figcaption figure font footer form
h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav ol option p pre q s samp script section select small span
strike strong style sub summary sup svg table tbody td textarea tfoot th thead tr tt u ul var video""".split()
COMMANDS = """alpha approx author beta begin bf bibitem big caption cdot cdots centering chapter chi cite date delta documentclass dots emph end epsilon eqref eta
eta equiv exists footnote forall frac gamma ge geq hat hline href hspace huge in includegraphics infty int it item kappa label lambda large ldots le left leq lim ln log
maketitle mathbb mathbf mathcal mathit mathrm mu nabla ne neq newcommand noindent nu omega overline paragraph part partial phi pi pm prod psi quad qquad ref right rho
section sigma sim sin cos tan small sqrt subparagraph subsection subset subsubsection sum tableofcontents tau text textbf textit textsc texttt theta times title tt
underline url usepackage vdots vec verb vspace xi zeta bigskip medskip smallskip newline newpage par""".split()
MACROS = "code quote noformat panel color toc info note warning tip".split()
BARE = "border checked disabled hidden nowrap open readonly required selected compact ismap multiple noshade reversed async defer controls".split()

_ATTR = rf"(?:\s+(?:[A-Za-z_:][\w:.-]*\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>=]+)|(?:{'|'.join(BARE)})(?=[\s/>])))*"
_EL = "|".join(sorted(ELEMENTS, key=lambda x: (-len(x), x)))
_SHORT = "|".join(e for e in ELEMENTS if len(e) == 1)
_CMD = "|".join(sorted(set(COMMANDS), key=lambda x: (-len(x), x)))
_I = re.I

# (family, rule, pattern, strength); the first that matches a part of a line does not hide the others.
RULES: list[tuple[str, str, re.Pattern, float]] = [
    ("html", "tag", re.compile(rf"<(?:/\s*(?:{_EL})\s*>|(?:(?<![\w])<)?(?!(?<=\w<)(?:{_SHORT})\b)(?:{_EL})\b{_ATTR}\s*/?>)", _I), 1.0),
    ("html", "tag", re.compile(rf"(?<=\w)<({_SHORT})>[^<>]*</\1>", _I), 1.0),
    ("html", "comment", re.compile(r"<!--|-->|<!DOCTYPE\b", _I), 1.0),
    ("html", "entity", re.compile(r"&(?:#\d{2,6}|#x[0-9a-f]{2,6}|(?!(?:lt|gt|amp|quot|apos);)[A-Za-z][A-Za-z0-9]{1,20});", _I), 1.0),
    ("html", "escape", re.compile(r"&(?:lt|gt|amp|quot|apos);"), WEAK),
    ("latex", "command", re.compile(rf"(?<![\w:\\])\\(?:{_CMD})(?![A-Za-z])"), 1.0),
    ("latex", "escape", re.compile(r"\w\\_\w|(?<=\s)\\[%&](?=\s|\w)|\\_\\_"), LIKELY),
    ("latex", "group", re.compile(r"\{\\(?:bf|it|em|tt|sc|small|large)\b"), 1.0),
    ("latex", "math", re.compile(r"(?<![\\\w$\"])\$(?=[^\s$])[^$\n]*[\\^_][^$\n]*(?<=[^\s\\])\$(?![\w$\"])|\$\$[^$\n]+\$\$|^\s*\$\$\s*$|(?<![\\\w])\\\([^\n]+?\\\)|(?<![\\\w])\\\[[^\n]+?\\\]|^\s*\\[\[\]]\s*$"), 1.0),
    ("wiki", "heading", re.compile(r"^\s*(={2,6})\s*[^=\s](?:.*[^=\s])?\s*\1\s*$|^h[1-6]\.\s+\S"), 1.0),
    ("wiki", "emphasis", re.compile(r"(?<![\w'=(\[,])(?<!= )(?<!\()('{2,3}|'{5})(?=[^\s'])[^'\n]+(?:'[^'\n]+)*(?<=[^\s'])\1(?!')"), 1.0),
    ("wiki", "link", re.compile(r"(?<!\w)\[\[(?=[^\s\[\]])[^\[\]\n]*[^\s\[\]]\]\]|(?<![\w\]])\[https?://[^\s\]]+ +[^\[\]\n]+\](?!\()"), 1.0),
    ("wiki", "template", re.compile(r"\{\{(?=[A-Za-z#:])[^{}\n]*\||^\s*\{\{[A-Z][\w ]*\s*$|^\s*\}\}\s*$|\{\{[A-Z][\w ]*\}\}"), 1.0),
    ("wiki", "table", re.compile(r"^\s*\{\|(?!\|)|^\s*\|-+\s*$|^\s*\|\}|^\|\|.*\|\|\s*$"), 1.0),
    ("wiki", "cell", re.compile(r"^!\s+\S|^\|(?![|}+-])[^|]*[^|\s]\s*$"), LIKELY),
    ("wiki", "definition", re.compile(r"^;\s+\S.*\s:\s+\S"), 1.0),
    ("wiki", "macro", re.compile(rf"\{{(?:{'|'.join(MACROS)})(?::[^{{}}\n]*)?\}}|^bq\.\s+\S"), 1.0),
    ("wiki", "redirect", re.compile(r"^#REDIRECT\b", _I), 1.0),
    ("markdown", "heading", re.compile(r"^ {0,3}#{1,6}\s+\S"), 1.0),
    ("markdown", "rule", re.compile(r"^ {0,3}(?:={3,}|-{3,}|\*{3,}|_{3,}|(?:\* ){2,}\*|(?:- ){2,}-)\s*$"), 1.0),
    ("markdown", "list", re.compile(r"^\s*(?:[-*+]|\d{1,3}[.)])\s+\S"), 1.0),
    ("markdown", "quote", re.compile(r"^ {0,3}>\s+\S"), 1.0),
    ("markdown", "fence", re.compile(r"^\s*(?:`{3,}|~{3,})"), 1.0),
    ("markdown", "table", re.compile(r"^\s*\|(?![|}\-]\s*$)(?!\|)[^\n]*[^|\n]\|\s*$"), 1.0),
    ("markdown", "strong", re.compile(r"(?<![\w*\\])\*\*(?=[^\s*])[^*\n]*[^\s*]\*\*(?!\*)|(?<![\w./\\])__(?=[^\s_])(?:[A-Z][^_\n]*|[^_\n]*[\s\x80-\U0010ffff][^_\n]*)(?<=[^\s_])__(?![\w.])"), 1.0),
    ("markdown", "emphasis", re.compile(r"(?<![\w*\\/])\*(?=[^\s*])[^*\n]*[^\s*]\*(?![\w*/])|(?<![\w./\\*])_(?=[^\s_])(?:[A-Z][^_\n]*|[^_\n]*[\s\x80-\U0010ffff][^_\n]*)(?<=[^\s_])_(?![\w.])"), 1.0),
    ("markdown", "strike", re.compile(r"~~(?=[^\s~])[^~\n]+~~"), 1.0),
    ("markdown", "code", re.compile(r"(?<!`)`(?=[^`\n])[^`\n]+`(?!`)"), 1.0),
    ("markdown", "link", re.compile(r"!?(?<![\w\])])\[[^\[\]\n]+\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)|(?<![\w\])\[])\[[^\[\]\n]+\]\[[^\[\]\n]*\](?!\()|^\[[^\]^\n]+\]:\s+\S|\[\^[^\]\s]+\]"), 1.0),
]
_SIGN = re.compile(r"[<>&\\$#*_`~|\[\]{}=!;]|^\s*[-+]|^\s*\d{1,3}[.)]\s|''|^h[1-6]\.|^bq\.|^---|-->")
_SOURCE = re.compile(
    r"^\s*(?:(?:const|let|var|return|assert|import|from|export|def|class|if|for|while|SELECT|INSERT|echo|cat|tar|copy|cp|sudo|curl|git|npm|doc|pattern)\b[^.!?。]*$|[A-Za-z_][\w.]*\s*=\s*\S.*$|[A-Z_]+=\S*\s|[A-Za-z_]\w*:\s*\{\{|\{\"|[A-Z]\w*(?:<|&lt;).*\w+\(\);?$)|[;{]\s*$"
)
_FENCE_OPEN = re.compile(r"^\s*(?:`{3,}|~{3,})\s*[A-Za-z]|^\s*\{code:[^{}]*\}\s*$|<pre\b[^>]*>", re.I)
_FENCE_CLOSE = re.compile(r"^\s*(?:`{3,}|~{3,})\s*$|^\s*\{(?:code|noformat)\}\s*$|</pre>", re.I)
_CLASS = re.compile(r"""<([a-z][a-z0-9]*)[^<>]*?\bclass\s*=\s*["']?([\w-]+)""", re.I)


def _constructs(line: str) -> tuple[tuple[str, str, float], ...]:
    if not _SIGN.search(line):
        return ()
    source = bool(_SOURCE.search(line))
    out = []
    for family, rule, pattern, strength in RULES:
        if source and (family, rule) not in _EVEN_IN_SOURCE:
            continue
        if pattern.search(line):
            out.append((family, rule, strength))
    if len(out) > 1 and ("wiki", "redirect", 1.0) in out:
        out = [x for x in out if x[1:2] != ("heading",)]
    return tuple(out)


_remembered = lru_cache(MEMO_LINES)(_constructs)


def constructs(line: str) -> tuple[tuple[str, str, float], ...]:
    """(family, rule, strength) of each construct a line holds; nothing for source code and prose."""
    return _remembered(line) if len(line) <= MEMO_CHARS else _constructs(line)


_EVEN_IN_SOURCE = {("html", "entity"), ("html", "comment"), ("wiki", "macro"), ("markdown", "fence"), ("wiki", "table"), ("wiki", "cell"), ("wiki", "template")}


def added(patch: str | None) -> list[tuple[str, bool]]:
    """(line, whether it stands in a block of source code) of each line a patch adds.

    A block counts from an opening fence that names a language, a code macro with one or a
    preformatted element to its end, if both stand in one hunk; context lines count too.
    """
    out: list[tuple[str, bool]] = []
    if not patch:
        return out
    hunk: list[tuple[str, bool]] = []

    def flush() -> None:
        shuts = [i for i, (t, _) in enumerate(hunk) if _MAY_FENCE(t) and _FENCE_CLOSE.search(t)]
        until, k = -1, 0
        for i, (t, plus) in enumerate(hunk):
            inside = i < until
            if plus:
                out.append((t, inside))
            if i > until and _MAY_FENCE(t) and _FENCE_OPEN.search(t) and "</pre" not in t.lower():
                while k < len(shuts) and shuts[k] <= i:
                    k += 1
                until = shuts[k] if k < len(shuts) else -1
        hunk.clear()

    for raw in patch.split("\n"):
        head = raw[:1]
        if head == "+" or head == " ":
            if not raw.startswith("+++ "):
                hunk.append((raw[1:-1] if raw.endswith("\r") else raw[1:], head == "+"))
        elif head == "@" or raw.startswith("diff --git "):
            flush()
    flush()
    return out


_MAY_FENCE = re.compile(r"```|~~~|\{(?:code|noformat)|pre\b", re.I).search


_TAGS = re.compile(rf"<(/?)\s*({_EL})\b([^<>]*)>", _I)
_CLASS_OF = re.compile(r"""\bclass\s*=\s*["']?([\w-]+)""", _I)
_ENV = re.compile(r"\\(begin|end)\{([A-Za-z]+)\*?\}")
_VOID = frozenset("br hr img input link meta col".split())
_BLOCKS = ("heading", "list", "quote", "table")


class Containers:
    """What a page has opened, by family, and so the paths of its constructs."""

    def __init__(self):
        self.open: dict[str, list[str]] = {"html": [], "latex": [], "wiki": []}
        self.block = ""  # the markdown block of the line

    def at(self, family: str) -> str:
        stack = self.open.get(family)
        return stack[-1] if stack else self.block if family == "markdown" and self.block else "text"

    def close(self, family: str, name: str) -> str:
        """Closes the innermost container of that name, with what it holds; its full name."""
        stack = self.open[family]
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].partition(".")[0] == name:
                name = stack[k]
                del stack[k:]
                break
        return name

    def paths(self, family: str, rule: str, line: str, strength: float, lost: frozenset) -> list[tuple[str, float]]:
        """(path, strength) of one construct of a line, opening and closing what it opens and closes.

        A container whose path is lost is not opened.
        """
        out: list[tuple[str, float]] = []

        def enter(name: str) -> None:
            path = f"{family}/{self.at(family)}/{name}"
            out.append((path, strength))
            if (family, path) not in lost:
                self.open[family].append(name)

        if family == "html" and rule == "tag":
            for shut, name, rest in _TAGS.findall(line):
                name = name.lower()
                if shut:
                    name = self.close(family, name)
                    out.append((f"html/{self.at(family)}/{name}", strength))
                    continue
                if name in _VOID or rest.endswith("/"):
                    out.append((f"html/{self.at(family)}/{name}", strength))
                    continue
                if name in ("li", "td", "th", "tr", "p", "dt", "dd", "option") and self.at(family).partition(".")[0] == name:
                    self.close(family, name)
                if c := _CLASS_OF.search(rest):
                    name += "." + re.sub(r"[0-9]+", "0", c.group(1).lower())
                enter(name)
            return out or [(f"html/{self.at(family)}/tag", strength)]
        if family == "latex" and rule == "command":
            for verb, name in _ENV.findall(line):
                if verb == "begin":
                    enter(name)
                else:
                    self.close(family, name)
            rule = "item" if "\\item" in line else "section" if "section" in line else rule
        elif family == "wiki" and rule == "table":
            opens, shuts = line.lstrip().startswith("{|"), line.lstrip().startswith("|}")
            if opens:
                enter("table")
                return out
            if shuts:
                self.close(family, "table")
        elif family == "wiki" and rule == "cell" and self.at(family) == "table":
            strength = 1.0
        elif family == "markdown" and rule in _BLOCKS:
            self.block = rule
            return [(f"markdown/page/{rule}", strength)]
        return [*out, (f"{family}/{self.at(family)}/{rule}", strength)]


def placed(patch: str | None, lost: frozenset = frozenset()):
    """(line, whether in source code, (family, rule) of its constructs, their (family, path) and strengths) of each added line, without lost paths."""
    box = Containers()
    for line, code in added(patch):
        if code:
            yield line, True, (), ()
            continue
        box.block = ""
        rules, paths = [], []
        for family, rule, strength in constructs(line):
            found = box.paths(family, rule, line, strength, lost)
            kept = [((family, p), x) for p, x in found if (family, p) not in lost]
            paths += kept
            if kept:
                rules.append((family, rule))
        yield line, False, rules, paths


def page_paths(patch: str | None, lost: frozenset = frozenset()) -> dict[tuple[str, str], float]:
    """(family, path) to the page's score: one less the chance that all its signs are accidents."""
    out: dict[tuple[str, str], float] = {}
    for _, _, _, paths in placed(patch, lost):
        for key, strength in paths:
            out[key] = 1 - (1 - out.get(key, 0.0)) * (1 - strength)
    return out


_STRIP_TAG = re.compile(rf"</?(?:{_EL})\b[^<>]*>|<!--.*?-->", re.I)
_HEAD_HTML = re.compile(r"^\s*<h([1-6])\b[^>]*>(.*?)(?:</h[1-6]>)?\s*$", re.I)
_CLEAN = [
    (("markdown", "link"), re.compile(r"!?\[([^\[\]\n]*)\](?:\([^()\s]*(?:\s+\"[^\"\n]*\")?\)|\[[^\[\]\n]*\])|\[\^[^\]\s]+\]()"), r"\1"),
    (("markdown", "strong"), re.compile(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1"), r"\2"),
    (("markdown", "emphasis"), re.compile(r"(?<![\w*])([*_])(?=\S)([^*_\n]+)(?<=\S)\1(?![\w*])"), r"\2"),
    (("markdown", "strike"), re.compile(r"~~(.+?)~~"), r"\1"),
    (("markdown", "code"), re.compile(r"`([^`\n]+)`"), r"\1"),
    (("wiki", "link"), re.compile(r"\[\[(?:[^\[\]|\n]*\|)*([^\[\]|\n]*)\]\]|\[https?://\S+ +([^\[\]\n]+)\]"), r"\1\2"),
    (("wiki", "emphasis"), re.compile(r"'{2,5}"), ""),
    (("wiki", "template"), re.compile(r"\{\{[^{}|\n]*\|?|\}\}"), ""),
    (("latex", "command"), re.compile(r"~?\\(?:ref|eqref|cite|label)\{[^{}\n]*\}|\\(?:begin|end)\{[^{}\n]*\}|\\href\{[^{}\n]*\}\{([^{}\n]*)\}|\\(?:textbf|textit|texttt|emph|underline|caption)\{([^{}\n]*)\}|\\verb\|([^|\n]*)\|"), r"\1\2\3"),
    (("latex", "group"), re.compile(r"\{\\(?:bf|it|em|tt|sc|small|large)\s+([^{}\n]*)\}"), r"\1"),
    (("latex", "escape"), re.compile(r"\\([_%&#])"), r"\1"),
]


def clean(patch: str | None, lost: frozenset = frozenset()) -> str:
    """The added lines as clean text; constructs whose (family, path) is in ``lost`` are not taken for markup."""
    out: list[str] = []
    fenced = False
    for line, code, rules, _ in placed(patch, lost):
        if code:
            if not fenced:
                out.append("```")
                fenced = True
            out.append(html.unescape(line))
            continue
        have = set(rules)
        if ("wiki", "cell") in have:
            have.add(("wiki", "table"))
        if ("markdown", "fence") in have or ("wiki", "macro") in have and _FENCE_CLOSE.search(line) or _FENCE_CLOSE.search(line) and fenced:
            if fenced:
                out.append("```")
                fenced = False
            continue
        s = line
        if ("latex", "math") in have:
            out.append(re.sub(r"\\[(\[]|\\[)\]]|\$\$?", "$", s).strip())
            continue
        if (h := _HEAD_HTML.match(s)) and ("html", "tag") in have:
            s = "#" * int(h.group(1)) + " " + h.group(2)
        elif m := re.match(r"^\s*(={2,6})\s*(.*?)\s*\1\s*$", s) if ("wiki", "heading") in have else None:
            s = "#" * len(m.group(1)) + " " + m.group(2)
        elif m := re.match(r"^h([1-6])\.\s+(.*)$", s) if ("wiki", "heading") in have else None:
            s = "#" * int(m.group(1)) + " " + m.group(2)
        elif m := re.match(r"^\s*\\((?:sub)*)(?:section|chapter|paragraph)\*?\{(.*)\}\s*$", s) if ("latex", "command") in have else None:
            s = "#" * (1 + len(m.group(1)) // 3) + " " + m.group(2)
        elif m := re.match(r"^(\s*)\\item\s*(.*)$", s) if ("latex", "command") in have else None:
            s = f"{m.group(1)}- {m.group(2)}"
        elif m := re.match(r"^(\s*)[*+-]\s+(?:\[[ xX]\]\s+)?(.*)$", s) if ("markdown", "list") in have else None:
            s = f"{m.group(1)}- {m.group(2)}"
        elif m := re.match(r"^(\s*\d+)[.)]\s+(.*)$", s) if ("markdown", "list") in have else None:
            s = f"{m.group(1)}. {m.group(2)}"
        elif ("markdown", "rule") in have and out and out[-1] and not out[-1].startswith(("#", "- ")) and re.match(r"^\s*[=-]{3,}\s*$", s):
            out[-1] = ("# " if "=" in s else "## ") + out[-1]
            continue
        elif ("markdown", "rule") in have or ("wiki", "table") in have and re.match(r"^\s*(?:\{\||\|-+\s*$|\|\})", s):
            continue
        elif ("markdown", "table") in have or ("wiki", "table") in have:
            if re.match(r"^[\s|:-]+$", s):
                continue
            s = " | ".join(x.strip() for x in re.split(r"\|+|^!", s) if x.strip())
        elif ("markdown", "quote") in have:
            s = re.sub(r"^\s*>\s?", "", s)
        elif m := re.match(r"^;\s+(.*?)\s+:\s+(.*)$", s) if ("wiki", "definition") in have else None:
            s = f"- {m.group(1)}: {m.group(2)}"
        elif ("wiki", "macro") in have:
            s = re.sub(r"^bq\.\s+", "", s)
        if ("html", "tag") in have and re.search(r"<li\b", s, re.I):
            s = re.sub(r"^\s*(?:<[ou]l\b[^>]*>)?\s*<li\b[^>]*>", "- ", s, flags=re.I)
            s = re.sub(r"<li\b[^>]*>", "\n- ", s, flags=re.I)
        if any(k[0] == "html" for k in have):
            s = _STRIP_TAG.sub(lambda t: "\n" if t.group().lower().startswith("<br") else " | " if t.group().lower().startswith(("<td", "<th")) and "<" not in s[: t.start()][-1:] else "", s)
        for key, pattern, by in _CLEAN:
            if key in have:
                s = pattern.sub(by, s)
        if ("html", "entity") in have or ("html", "escape") in have:
            s = html.unescape(s).replace("\xa0", " ")
        out.append(s.rstrip())
    if fenced:
        out.append("```")
    return "\n".join(out)
