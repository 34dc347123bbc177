"""Overlapping words, padding, stripping (TOK-01/02/05, PRJ-03)."""

from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.functions import text as T


def py_overlap(seq, w, o):
    if o >= w:
        return []
    return [seq[i:i + w] for i in range(0, len(seq) - o, w - o)]


def words(spark, texts, w, o):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", T.overlap_words("t", w, o).alias("w")).orderBy("i").collect()
    return [r.w for r in rows]


def test_fixture_cases(spark):
    # F7 cases: (text; word, overlap -> result)
    assert words(spark, ["ABCDE"], 5, 2) == [["ABCDE"]]
    assert words(spark, ["ABCDEFGHIJ"], 5, 2) == [["ABCDE", "DEFGH", "GHIJ"]]
    assert words(spark, ["ABCDEFG"], 2, 0) == [["AB", "CD", "EF", "G"]]
    assert words(spark, ["AB"], 5, 2) == [[]]
    assert words(spark, [""], 5, 2) == [[]]
    assert words(spark, ["ABCDEF"], 3, 3) == [[]]


def test_matches_python_rule_on_lengths(spark):
    texts = ["abcdefghijklm"[:n] for n in range(14)] + ["é\nçü ñ" * 3, "x😀y😀z"]
    for w, o in [(1, 0), (2, 0), (4, 1), (5, 2), (3, 3), (3, 1)]:
        assert words(spark, texts, w, o) == [py_overlap(t, w, o) for t in texts], (w, o)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="ACDEFGHIKLMNPQRSTVWYé \n", max_size=40), min_size=1, max_size=8),
       st.sampled_from([(1, 0), (2, 0), (4, 1), (5, 2), (6, 5)]))
def test_property_equals_python(spark, texts, wo):
    w, o = wo
    assert words(spark, texts, w, o) == [py_overlap(t, w, o) for t in texts]


def test_unoverlapping_rebuilds_text(spark):
    text = "MKTAYIAKQRQISFVKSHFSRQ"
    w, o = 5, 2
    got = words(spark, [text], w, o)[0]
    rebuilt = got[0] + "".join(x[o:] for x in got[1:])
    assert rebuilt == text


def test_overlap_string(spark):
    df = spark.createDataFrame([("ABCDEFG",)], "t string")
    assert df.select(T.overlap_string("t", 2, 0)).first()[0] == "AB CD EF G"


def pad(spark, arrays, L, padding, truncating):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<int>")
    return [r[0] for r in df.orderBy("i").select(T.pad_truncate("a", L, padding, truncating)).collect()]


def test_padding_fixture_cases(spark):
    assert pad(spark, [[1, 2, 3, 4, 5]], 3, "post", "pre") == [[3, 4, 5]]
    assert pad(spark, [[1, 2, 3, 4, 5]], 3, "post", "post") == [[1, 2, 3]]
    assert pad(spark, [[1]], 3, "post", "pre") == [[1, 0, 0]]
    assert pad(spark, [[1]], 3, "pre", "pre") == [[0, 0, 1]]
    assert pad(spark, [[]], 3, "post", "pre") == [[0, 0, 0]]


def test_strip_keeps_accents(spark):
    df = spark.createDataFrame([("> Yé_ast-1 çü!\r\n",)], "t string")
    assert df.select(T.strip_non_word("t")).first()[0] == "Yé_ast1çü"


def test_model_alias(spark):
    df = spark.createDataFrame([("8",), ("35m",)], "n string")
    assert [r[0] for r in df.select(T.add_m_suffix("n")).collect()] == ["8m", "35m"]
