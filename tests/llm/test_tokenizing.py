import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamdex.llm import mixing as M
from loamdex.llm import tokenizing as K

PATH = K.vocabulary_path()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return K.TrieEncoder(K.vocabulary(), keep_words=50, keep_pairs=200), t


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=60), max_size=4))
def test_like_the_library(both, texts):
    mine, theirs = both
    assert mine.encode_batch(texts) == [x.ids for x in theirs.encode_batch(texts, add_special_tokens=False)]


def test_hard_texts(both):
    mine, theirs = both
    texts = ["", "<|endoftext|>", " " * 3000 + "x", "ab" * 4000, "don't I'LL", "é́🇪🇺👩‍💻", "a\r\n\tb\u3000c", "0123456789" * 50]
    assert mine.encode_batch(texts) == [x.ids for x in theirs.encode_batch(texts, add_special_tokens=False)]
    assert mine.encode_batch([None]) == [[]]


def test_table(spark):
    df = spark.createDataFrame([(1, "hi there", 5), (2, None, 6), (2, "", 7), (None, "x", 8)], "doc_id bigint, text string, ids int")
    rows = {(r["doc_id"], len(r["ids"])) for r in K.encode(df).collect()}
    assert rows == {(1, 2), (2, 0), (None, 1)} and K.encode(df).count() == 4 and K.encode(df.limit(0)).count() == 0
    assert K.token_counts(df).columns == ["doc_id", "ids", "tokens"]


def test_vocabulary_is_bounded(monkeypatch):
    monkeypatch.setattr(K, "MOST_BYTES", 10)
    with pytest.raises(ValueError):
        K.vocabulary()


def test_many_buckets(spark, monkeypatch):
    """Buckets change the order, not the sums: each source still has its copies to within one."""
    counts = spark.createDataFrame([(i, "ab"[i % 5 == 0], 5 + i % 40) for i in range(900)], "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 0.7, 2), ("b", 0.3, 4)], "source string, target_share double, max_repeats int")
    monkeypatch.setattr(M, "BUCKET_ROWS", 7)
    total = {r["source"]: r["documents"] * r["copies"] for r in M.plan(counts, targets).collect()}
    rows = M.mix(counts, targets).collect()
    for source in "ab":
        mine = [r for r in rows if r["source"] == source]
        assert abs(sum(r["copies"] for r in mine) - total[source]) < 1 and all(abs(r["copies"] - r["copies_expected"]) < 1 for r in mine)


def test_mixing(spark):
    rows = [(i, "a", 10 + i % 7) for i in range(300)] + [(1000 + i, "b", 50) for i in range(20)] + [(2000, None, 9), (2001, "x", 9), (2002, "c", 0)]
    counts = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.4, 3), ("c", 0.1, 2), ("b", 0.1, 1), (None, 0.3, 1), ("d", None, 1)], "source string, target_share double, max_repeats int")
    out = {r["source"]: r for r in M.report(counts, targets).collect()}
    assert set(out) == {"a", "b", "c"} and out["c"]["mixed_tokens"] == 0
    assert abs(out["a"]["actual_share"] - 5 / 9) < 0.02 and out["b"]["most_repeats"] <= 3 and out["a"]["most_repeats"] <= 2
    mix = M.mix(counts, targets)
    for r in mix.groupBy("source").agg({"copies": "max", "copies_expected": "max"}).collect():
        assert r["max(copies)"] <= r["max(copies_expected)"] + 1
    total = {r["source"]: r for r in M.plan(counts, targets).collect()}
    got = {r["source"]: r["s"] for r in mix.groupBy("source").agg({"copies": "sum"}).withColumnRenamed("sum(copies)", "s").collect()}
    assert all(abs(got[s] - total[s]["documents"] * total[s]["copies"]) < 1 for s in got)
    assert sorted(map(tuple, mix.collect())) == sorted(map(tuple, M.mix(counts.repartition(3), targets).collect()))
    assert M.report(counts.limit(0), targets).where("mixed_tokens > 0").count() == 0 and M.mix(counts, targets.limit(0)).count() == 0
