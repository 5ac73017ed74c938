import json

from hypothesis import given, settings
from hypothesis import strategies as st

from votemill.operators import structural as S

LEAF = st.none() | st.booleans() | st.integers(-99, 99) | st.text(max_size=8)
FILE = st.fixed_dictionaries({}, optional={"added_lines": st.none() | st.lists(st.none() | st.text(max_size=9), max_size=3) | st.text(max_size=5), "x": st.lists(LEAF, max_size=2), "patch": st.text(max_size=20)})
COMMIT = st.fixed_dictionaries({}, optional={"acf_files": st.none() | FILE | st.lists(st.none() | FILE, max_size=3), "hash": LEAF})
REPO = st.fixed_dictionaries({}, optional={"acf_commits": st.none() | COMMIT | st.lists(st.none() | COMMIT, max_size=3), "topics": st.dictionaries(st.text(max_size=4), LEAF, max_size=2)})
PATH = ("acf_commits", "acf_files", "added_lines")


def listed(v):
    return [] if v is None else v if isinstance(v, list) else [v]


def brute(payloads):
    out = []
    for i, o in enumerate(payloads):
        for r, repo in enumerate(listed(o)):
            for c, commit in enumerate(listed((repo or {}).get("acf_commits"))):
                if commit is None:
                    continue
                out.append((i, r, c, -1, -1))
                for f, file in enumerate(listed(commit.get("acf_files"))):
                    if file is None:
                        continue
                    out.append((i, r, c, f, -1))
                    out += [(i, r, c, f, k) for k, line in enumerate(listed(file.get("added_lines"))) if line is not None]
    return sorted(out)


def ours(texts):
    from votemill.operators.nested import _keys

    ix = S.build([t.encode() for t in texts])
    levels = S.linked_rows(ix, PATH)
    return sorted(tuple(map(int, (ix.payload[v], *k))) for j in (1, 2, 3) for v, k in zip(levels[j][0], _keys(ix, levels, j)))


@settings(max_examples=150, deadline=None)
@given(st.lists(REPO | st.lists(REPO, max_size=2), min_size=1, max_size=4), st.sampled_from([None, 1]), st.booleans())
def test_places_equal_a_parser(payloads, indent, ascii_):
    assert ours([json.dumps(p, indent=indent, ensure_ascii=ascii_) for p in payloads]) == brute(payloads)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=5), st.booleans())
def test_scalars_are_unescaped(texts, ascii_):
    ix = S.build([json.dumps({"acf_commits": [{"acf_files": [{"added_lines": texts}]}]}, ensure_ascii=ascii_).encode()])
    values = S.linked_rows(ix, PATH)[3][0]
    assert S.spans(ix, values) == texts


def test_broken_payloads_give_nothing_and_disturb_nobody():
    good = '{"acf_commits": [{"hash": "a\\\\\\"b"}]}'
    assert [r[0] for r in ours([good, "", "   ", '{"acf_commits": [{', '{"a": "unclosed}', "]", good])] == [0, 6]
