"""The text operators against brute force, exact round trips and held-out accuracy, without Spark."""

import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from votemill.llm import bpe, consensus, encoding, language, markup, mixing, pieces, prose, units


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    b = bpe.load("byte_bpe_50k")
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=b.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=120) | st.text(alphabet="ab \n'st<|endoftext>é漢🚀", max_size=200))
def test_bpe_equals_the_library(reference, text):
    assert bpe.load("byte_bpe_50k").encode(text) == reference.encode_ordinary(text)


def test_bpe_long_words_and_empty(reference):
    b = bpe.load("byte_bpe_50k")
    for text in ("a" * 5000, "ab" * 3000, "é" * 700, "x" * 255 + "y" * 3, " " * 400, "\n" * 300):
        assert b.encode(text) == reference.encode_ordinary(text)
    assert b.encode("") == b.encode(None) == []


def test_bpe_decodes_back(reference):
    b = bpe.load("byte_bpe_50k")
    back = {i: t for t, i in b.ranks.items()}
    text = "Hello <|endoftext|> wörld 漢字 🚀\r\n\t x" * 30
    assert b"".join(back[i] for i in b.encode(text)).decode() == text


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(1, 60), min_size=1))
def test_schedule_never_strays_a_block(blocks):
    order = mixing.schedule(blocks)
    n = sum(blocks.values())
    assert Counter(order) == blocks
    seen = Counter()
    for t, s in enumerate(order, 1):
        seen[s] += 1
        assert all(abs(seen[x] - Fraction(b * t, n)) < 1 for x, b in blocks.items())


def test_apportioned_blocks_add_up():
    assert mixing.apportion({"a": 1.0, "b": 1.0, "c": 1.0}, 10) == {"a": 4, "b": 3, "c": 3}
    assert mixing.apportion({"big": 1e9, "t1": 1e5, "t2": 1e5}, 4096) == {"big": 4095, "t1": 1, "t2": 1}
    assert mixing.slots_for({"a": 0.999, "b": 0.001}) == 8000 and mixing.slots_for({}) == mixing.FEWEST_SLOTS
    assert mixing.apportion({}, 10) == {} and mixing.apportion({"a": 0.0}, 5) == {}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n@+-#\u00e9\u3002.=\r*", max_size=300), st.integers(2, 60), st.integers(-2, 59))
def test_pieces_join_and_overlap(text, limit, overlap):
    if overlap >= limit:
        with pytest.raises(ValueError):
            pieces.cuts(text, limit, overlap)
        return
    cut = pieces.cuts(text, limit, overlap) if text else []
    assert "".join(text[a:b] for a, b in cut) == text
    p = pieces.split(text, limit, overlap)
    back = max(0, overlap)
    assert bool(p) == (len(text) > limit)
    for x in p:
        assert len(x[2]) <= limit and x[2] == text[x[0] : x[1]]
    for x, y in zip(p, p[1:]):
        assert x[1] - y[0] == back and len(x[2]) >= back


def test_pieces_cut_at_hunks():
    hunk = lambda k: f"@@ -{k},3 +{k},3 @@\n" + "".join(f"+line {k} {i}\n" for i in range(20))
    text = "".join(hunk(k) for k in range(12))
    for a, b in pieces.cuts(text, 700, 50)[:-1]:
        assert text[b:].startswith("@@ ")


def diff_file(name, lines):
    return f"diff --git {name} {name}\n@@ -1 +1 @@\n" + "".join(f"+{name} {i}\n" for i in range(lines))


def test_pieces_hold_whole_files_or_parts_of_one():
    rnd = random.Random(8)
    for _ in range(200):
        files = [diff_file(chr(97 + k), rnd.choice([1, 2, 3, 30])) for k in range(rnd.randint(2, 7))]
        text = "".join(files)
        edge = [0]
        for f in files:
            edge.append(edge[-1] + len(f))
        for a, b in pieces.cuts(text, 90, rnd.choice([0, 10, 30])):
            touched = [k for k in range(len(files)) if a < edge[k + 1] and b > edge[k]]
            assert len(touched) == 1 or all(edge[k] >= a and edge[k + 1] <= b for k in touched)
            assert not text[a:b].rstrip("\n").split("\n")[-1].startswith(("diff --git", "@@"))


def test_pieces_merge_whole_siblings_only():
    text = "# A\n" + "one two.\n" * 3 + "\n# B\n" + "".join(f"word{i} here.\n" for i in range(40)) + "\n# C\nend.\n# D\nend.\n"
    parts = [text[a:b] for a, b in pieces.cuts(text, 120, 0)]
    assert parts[0].startswith("# A") and "# B" not in parts[0]  # B is opened, so A stands alone
    assert parts[1].startswith("# B\nword0") and parts[-1] == "# C\nend.\n# D\nend.\n"
    assert all(p.endswith("\n") and len(p) <= 120 for p in parts)


@pytest.mark.parametrize(
    "line, families",
    [
        ("# Head", {"markdown"}), ("- item", {"markdown"}), ("1. item", {"markdown"}), ("> quote", {"markdown"}), ("```py", {"markdown"}), ("**b** x", {"markdown"}), ("see [a](b) now", {"markdown"}), ("| a | b |", {"markdown"}), ("=======", {"markdown"}), ("~~gone~~ x", {"markdown"}),
        ("<h1>Head</h1>", {"html"}), ("a.<br/>b", {"html"}), ("x&nbsp;&hellip;", {"html"}), ("</ul>", {"html"}), ('<A HREF="x">y</A>', {"html"}), ("H<sub>2</sub>O", {"html"}), ("<!-- x -->", {"html"}),
        ("== Head ==", {"wiki"}), ("'''bold''' x", {"wiki"}), ("see [[a|b]]", {"wiki"}), ("{{Note|x}}", {"wiki"}), ("{| class=x", {"wiki"}), ("h2. Head", {"wiki"}), ("{code:sql}", {"wiki"}), ("; term : text", {"wiki"}), ("||a||b||", {"wiki"}),
        ("\\section{Head}", {"latex"}), ("\\item x", {"latex"}), ("$a_1^2 + b$", {"latex"}), ("\\(x\\)", {"latex"}), ("a\\_b c", {"latex"}), ("{\\bf x} y", {"latex"}), ("end.\\footnote{x}", {"latex"}),
        ("plain text, nothing else.", set()), ("1.5 seconds is the limit.", set()), ("Replace <name> with a<b or b>c.", set()), ("*.md files come first and *.txt files after.", set()), ("#4821 and #4830 are one.", set()), ("Old & new; R&D.", set()), ("The sign == compares.", set()),
        ("    if (lo <mid && mid> hi) swap(lo, hi);", set()), ("Map<String, List<Integer>> index = load();", set()), ("doc = '''inner text'''", set()), ("copy D:\\section\\logs E:\\begin\\old", set()), ("port: {{ .Values.port }}", set()), ('if [[ -f "$ROOT/.env" ]]; then load; fi', set()),
        ("from core.__init__ import __version__", set()), ("total = 2 ** 10 ** 1", set()), ("It costs $5 now and $7 later.", set()), ("echo $A $B", set()), ("x = a_b * c_d_e", set()), ('pattern = r"^\\d+\\s\\w+$"', set()), ("value = items[0](arg)", set()), ("https://a.example/b_c_d", set()), ("", set()),
    ],
)
def test_markup_families(line, families):
    assert {f for f, _, _ in markup.constructs(line)} == families


def test_markup_ignores_removed_lines_and_code_blocks():
    patch = "@@ -1 +1 @@\n-# gone\n # context\n+```py\n+# comment\n+```\n+plain"
    assert {f for f, _ in markup.page_paths(patch)} == {"markdown"}
    assert [c for _, c in markup.added(patch)] == [False, True, False, False]
    assert markup.page_paths(None) == markup.page_paths("") == markup.page_paths(" # only context") == {}


def test_markup_clean_keeps_structure():
    patch = "@@ -0,0 +1,9 @@\n+<h2>Head</h2>\n+* one\n+== Wiki ==\n+\\item two\n+$$\\frac{a}{b}$$\n+see [x](y) and **z**&nbsp;!\n+```py\n+a = 1\n+```"
    out = markup.clean(patch)
    assert out.split("\n") == ["## Head", "- one", "## Wiki", "- two", "$\\frac{a}{b}$", "see x and z !", "```", "a = 1", "```"]


def test_markup_paths_name_their_containers():
    patch = "@@ -0,0 +1,9 @@\n+<ul class=menu12>\n+<li>one &lt; two\n+</ul>\n+{| class=x\n+! head\n+|}\n+\\begin{itemize}\n+\\item x\n+\\end{itemize}\n+- **a**"
    assert {p for _, p in markup.page_paths(patch)} == {"html/text/ul.menu0", "html/ul.menu0/li", "html/li/escape", "wiki/text/table", "wiki/table/cell", "wiki/text/table", "latex/text/itemize", "latex/itemize/command", "latex/itemize/item", "latex/text/command", "markdown/page/list", "markdown/list/strong"}
    lost = frozenset({("html", "html/ul.menu0/li")})
    assert {p for f, p in markup.page_paths(patch, lost) if f == "html"} == {"html/text/ul.menu0", "html/ul.menu0/escape"}
    twice = markup.page_paths("+a &lt; b\n+c &gt; d")
    assert twice == {("html", "html/text/escape"): 0.75}


WORDS = {"de": "der die das und nicht mit für über prüfung größe ändern können müssen schließen straße".split(), "fr": "le la les et pas avec pour été déjà vérifier côté élève français être où".split()}


def sentences(lang, n, seed):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(WORDS[lang]) for _ in range(8)).capitalize() + "." for _ in range(n)]


def test_language_held_out_with_wrong_labels():
    rnd = random.Random(1)
    train = [(rnd.choice(["de", "fr"]) if rnd.random() < 0.15 else lang, s) for lang in WORDS for s in sentences(lang, 300, 2)]
    m = language.train(train)
    test = [(lang, s) for lang in WORDS for s in sentences(lang, 100, 3)]
    assert sum([x[0] for x in language.stretches(m, s, "document")] == [lang] for lang, s in test) >= 195
    mixed = sentences("de", 1, 9)[0] + "\n" + sentences("fr", 1, 9)[0]
    assert [x[0] for x in language.stretches(m, mixed, "document")] == ["de", "fr"]
    assert m.judge(("unbekannteprüfung",))[0] == "de"  # unknown words fall back to their letters
    for nothing in (None, "", " \n", "src/core/main.py", "x = f(y);", "# Head", "copy D:\\section\\logs E:\\begin\\old", "SELECT a, b FROM t WHERE a < b"):
        assert language.stretches(m, nothing, "document") == []


def test_a_sentence_of_all_languages_speaks_for_none():
    # The same sentence stands in the texts of both; the one with fewer words must not take it.
    texts = [("fr", s + " die und das bauen.") for s in sentences("fr", 200, 4)] + [("xx", w + ". Der Test ist die und das.") for w in ("\u65e5\u672c\u8a9e\u306e\u6587\u7ae0\u3067\u3059", "\u77ed\u3044\u6587\u7ae0\u3067\u3059") for _ in range(100)] + [("de", s + " Der Test ist die und das.") for s in sentences("de", 200, 5)]
    m = language.train(texts)
    assert m.judge(("der", "test", "ist", "die", "und", "das"))[0] == "de" and "xx" in m.names


def test_language_codes():
    assert [language.code(x) for x in ("en-US", "English", "eng", "EN", "zh_CN", "pt-BR", "und", "", None, "unknown", "mul")] == ["en", "en", "en", "en", "zh", "pt", None, None, None, None, "mul"]


def test_language_without_training():
    m = language.train([])
    assert language.stretches(m, "Some text here.", "document") == []


@pytest.fixture(scope="module")
def mender():
    texts = [s for lang in WORDS for s in sentences(lang, 400, 5)] + ["over – there", "wait … now", "it’s “fine”"] * 40
    return encoding.Mender(encoding.Repertoire.of(texts))


@pytest.mark.parametrize("pair", [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("cp850", "latin-1"), ("utf-8", "cp1252", "utf-8", "cp1252")])
def test_garbled_text_comes_back(mender, pair):
    done = 0
    for text in sentences("de", 40, 77) + sentences("fr", 40, 78):
        bad = encoding.garble(text, pair)
        if bad and bad != text:
            damaged, fixed, _, _ = mender.mend(bad)
            assert damaged
            done += fixed == text
    assert done >= 60


def test_sound_text_is_left_alone(mender):
    for text in sentences("de", 60, 91) + sentences("fr", 60, 92) + ["replace the stray sequence â€™ in x", "Why does it fail here??? I looked.", "Show it\n├── src\n│   └── core", "Ångström", "", None, "ascii only", "http://x.example/?a=b"]:
        damaged, fixed, _, _ = mender.mend(text)
        assert not damaged and fixed == text


def test_losses_are_found(mender):
    for text in ("f�r alle", "??????? ?????? make check", "gr??er wird f?r", "it\x92s gone"):
        assert mender.mend(text)[0]


def test_mixed_text_keeps_its_right_part(mender):
    right = sentences("fr", 1, 5)[0]
    bad = encoding.garble("für über größe", ("utf-8", "cp1252")) + " " + right
    assert mender.mend(bad)[1] == "für über größe " + right


PROSE = "the team moved {} to a new place because the old one was slow. you can read more about it in the notes, and we will answer questions there. please tell us if something is not clear to you."


def test_spam_is_held_apart_from_prose():
    rnd = random.Random(4)
    noun = "cache server parser queue release index module worker session table".split()
    page = lambda: "\n".join(PROSE.format(rnd.choice(noun)).capitalize() for _ in range(4))
    m = prose.train([page() for _ in range(200)])
    spam = [", ".join(rnd.choice(["cheap deals", "best offer", "buy now"]) for _ in range(60)), " ".join(f"#{rnd.choice(noun)}_deal{i}" for i in range(60)), "\n".join(f"https://x{i}.example/a" for i in range(30)), "best offer " * 80]
    assert all(m.is_spam(s) for s in spam) and not any(m.is_spam(page()) for _ in range(50))
    assert not any(m.is_spam(x) for x in (None, "", " \n", "```\nx = 1\n```", "├── a_b.py\n└── c_d.py"))
    assert not prose.train([]).is_spam("anything at all")


def kinds_of(line):
    return units.Block([line]).kind.tolist()


def test_units_of_a_line():
    sign = lambda c: units.SIGN_BASE + units.SIGNS.index(c)
    assert kinds_of("https://a.example/b?c=1, www.x.org") == [units.URL, units.URL]
    assert kinds_of('<a href="https://x.y">') == [units.TAG] and kinds_of("&nbsp; &") == [units.TAG, sign("&")]
    assert kinds_of("src/core/main.py foo_bar CamelCase v2 3.5 2") == [units.ID] * 4 + [units.NUM] * 2
    assert kinds_of("#tag --flag -x a - b")[:3] == [units.HASH, units.FLAG, units.FLAG] and kinds_of("a - b")[1] == sign("-")
    assert kinds_of("\u65e5\u672c\u30c6") == [units.HAN, units.HAN, units.KANA]
    b = units.Block(["Don\u2019t stop. don't"])
    assert b.hash[0] == b.hash[3] and b.kind[2] == sign(".") and b.kind[0] != b.kind[3]
    b = units.Block(["Prose here.\n```\ncode words\n```\nand  more", None or "", "x = a_b;\n"])
    assert b.worded[[0, 2, 4]].tolist() == [True, False, True] and b.ended[[0, 4]].tolist() == [True, False] and not b.worded[b.page == 2].any()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab Zz\u00e9\u65e5_.,-/#<>&;:!'\"1\n\r`", max_size=60), min_size=1, max_size=6))
def test_units_cover_every_sign_of_a_page_once(texts):
    b = units.Block(texts)
    assert b.size.sum() == sum(not ch.isspace() for t in texts for ch in t)
    raw, at = units.raw(b)
    one = [units.raw(units.Block([t]))[0] for t in texts]
    assert [raw[i:j].tolist() for i, j in zip(at, at[1:])] == [x.tolist() for x in one]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(0, 2**36), st.integers(0, 10**6), max_size=60), st.lists(st.integers(0, 2**36), max_size=60))
def test_lookup_is_a_dictionary(known, asked):
    keys = np.array([*known, *asked], np.int64)
    found = units.Lookup(np.array(list(known), np.int64), np.array(list(known.values()), np.int32), -1).find(keys)
    assert found.tolist() == [known.get(k, -1) for k in keys.tolist()]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 2)), max_size=50))
def test_seen_near_is_brute_force(rows):
    rows = sorted(rows, key=lambda r: r[1])
    h, page = np.array([r[0] for r in rows], np.uint32), np.array([r[1] for r in rows], np.int64)
    assert units.seen_near(h, page, 4).tolist() == [r in rows[max(0, i - 4) : i] for i, r in enumerate(rows)]


def test_messages_beat_the_majority():
    rnd = np.random.default_rng(3)
    n, c = 3000, len(consensus.CATEGORIES)
    truth = rnd.integers(0, c, n)
    skill = [0.9, 0.85, 0.4, 0.4, 0.4, 0.05]
    rows = []
    for i in range(n):
        shared = rnd.integers(0, c)
        row = []
        for a, s in enumerate(skill):
            wrong = shared if a in (2, 3, 4) and rnd.random() < 0.8 else (truth[i] + 1) % c if a == 5 else rnd.integers(0, c)
            row.append({"a": a, "l": int(truth[i] if rnd.random() < s else wrong)})
        rows.append(row)
    e = consensus.Edges(pa.array(rows, pa.list_(pa.struct([("a", pa.int32()), ("l", pa.int32())]))))
    weight = np.array([1, 1, 0.4, 0.4, 0.4, 1.0])
    q = consensus.first_messages(e, c)
    moved = []
    for _ in range(40):
        sums = consensus.Sums(consensus._joint(e, q, len(skill), c).reshape(len(skill), c, c))
        by_hand = np.zeros((len(skill), c, c))
        np.add.at(by_hand, (e.a, slice(None), e.l), q)
        assert np.allclose(sums.joint, by_hand)
        new, belief = consensus.next_messages(e, q, sums, weight)
        moved.append(np.abs(new - q).sum() / 2 / len(q))
        q = new
    assert moved[-1] < consensus.SETTLED < moved[0]
    votes = np.zeros((n, c))
    np.add.at(votes, (e.item, e.l), 1)
    assert (belief.argmax(1) == truth).mean() > 0.9 > (votes.argmax(1) == truth).mean()


def test_pattern_is_the_tokenizers():
    assert regex.findall(bpe.PATTERN, "it's  a b") == ["it", "'s", " ", " a", " b"]
