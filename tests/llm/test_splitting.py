import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamdex.llm import splitting as S

TEXT = st.text(alphabet=st.sampled_from(list("ab \n\n{}\u0301\u200d\r.#")), max_size=400)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(1, 90), st.integers(0, 5))
def test_pieces_hold(text, limit, overlap):
    pieces = S.split_text(text, limit, overlap)
    assert "".join(text[b:c] for _, b, c in pieces) == text
    assert all(c - a <= limit and a <= b < c for a, b, c in pieces)
    assert (len(pieces) > 1) == (len(text) > limit)


def test_natural_boundaries():
    text = "\n".join(f"def f{i}():\n    a = {i}\n    return a\n" for i in range(12))
    for _, begin, _ in S.split_text(text, 120, 0)[1:]:
        assert text[begin:].startswith("def ")


def test_overlap_lines_and_numbers():
    text = "\n".join(f"line {i}" for i in range(1, 41))
    rows = list(S.pieces_of(text, 11, 50, 80, 2))
    assert rows[0][2] == 11 and rows[-1][3] == 50
    for a, b in zip(rows, rows[1:]):
        assert b[2] == a[3] - 1 and b[5].split("\n")[0] == a[5].rstrip("\n").split("\n")[-2]


def test_defined_results():
    assert S.split_text("", 10) == [] and S.split_text("abc", 3, 2) == [(0, 0, 3)]
    assert list(S.pieces_of("x" * 30, None, None, 10, 3))[0][2:4] == (1, 1)
    assert len(S.split_text("x" * 100_000, 1000, 3)) == 100
    assert [r[1] for r in S.pieces_of("a b", 1, 1, None, None)] == [1]


def test_table(spark):
    hits = spark.createDataFrame([(1, "a.py", 1, 2, "x " * 40, 1), (1, "a.py", 1, 2, "x " * 40, 2), (2, "b.zz", 1, 1, "y " * 40, 1), (3, "a.py", 1, 1, None, 1), (4, "no", None, None, "", 1), (5, None, 1, 1, "z " * 80, 1)], "hit_id bigint, path string, start_line int, end_line int, preview string, lang int")
    files = spark.createDataFrame([("a.py", 1.0, "python", "q"), ("a.py", 2.0, "java", "q"), ("b.zz", 1.0, None, "q"), (None, 1.0, "x", "q")], "path string, mtime double, lang string, preview string")
    limits = spark.createDataFrame([("python", 10, 1), ("java", 50, 1), ("other", 100, 0), (None, 1, 1)], "lang string, max_chars int, overlap_lines int")
    assert sorted(r[0] for r in S.found(S.split_hits(hits, files, limits)).collect()) == [1, 5]
    assert S.split_hits(hits.limit(0), files, limits).count() == 0 and S.found(S.split_hits(hits, files, limits.limit(0))).count() == 0
    with pytest.raises(Exception):
        S.split_hits(hits.drop("preview"), files, limits)


@pytest.mark.parametrize("limit, lines, width", [(1500, 5, 160), (1000, 2, 260)])
def test_all_given_lines_are_repeated(limit, lines, width):
    text = "\n".join(f"{i:04} ".ljust(width - 1, "x") for i in range(60))
    pieces = S.split_text(text, limit, lines)
    assert "".join(text[b:c] for _, b, c in pieces) == text and all(c - a <= limit for a, _, c in pieces)
    assert all(text[a:b].count("\n") == lines and text[b - 1] == "\n" for a, b, _ in pieces[1:])


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(1, 90), st.integers(1, 5))
def test_fewer_lines_only_where_they_do_not_fit(text, limit, overlap):
    for a, b, _ in S.split_text(text, limit, overlap)[1:]:
        begun = [0, *(i + 1 for i, c in enumerate(text) if c == "\n" and i + 1 < b)]
        new = text.find("\n", b) + 1 or len(text)
        full = begun[-overlap:][0]
        assert a == full or new - full > limit
