"""Vocabularies and encodings (TOK-03..16)."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixframe.operators import tokens as K
from helixframe.operators.piecetrie import PieceTrie


def test_char_vocab_order_and_ties(spark):
    df = spark.createDataFrame([(0, "bAa"), (1, "cb")], "i int, t string")
    v = {r.token: r.id for r in K.fit_char_vocab(df, "t", ["i"]).collect()}
    # a:2, b:2 (b first seen at (0,0)), c:1
    assert v == {"b": 1, "a": 2, "c": 3}


def test_encode_drops_unknown(spark):
    df = spark.createDataFrame([(0, "abz")], "i int, t string")
    m = K.vocab_map(spark.createDataFrame([("a", 1), ("b", 2), ("\U0001f642", 3)], "token string, id int"))
    assert df.select(K.encode_chars(F.lit("\U0001f642b\u00e9"), m)).first()[0] == [3, 2]
    assert df.select(K.encode_chars("t", m)).first()[0] == [1, 2]
    assert df.select(K.encode_chars("t", m, keep_unknown=0)).first()[0] == [1, 2, 0]


def test_exact_median(spark):
    df = spark.createDataFrame([(t,) for t in ["a", "abc", "ab", "abcd"]], "t string")
    assert K.median_length(df, "t").first()[0] == 2   # (2 + 3) / 2 truncated
    df = spark.createDataFrame([(t,) for t in ["a", "abc", "abcdefg"]], "t string")
    assert K.median_length(df, "t").first()[0] == 3


def py_wordpiece(counts, vocab_size, specials=K.BERT_SPECIALS):
    sym = {w: [w[0]] + ["##" + c for c in w[1:]] for w in counts}
    heads = sorted({s[0] for s in sym.values()})
    tails = sorted({t for s in sym.values() for t in s[1:]})
    vocab = list(dict.fromkeys([*specials, *heads, *tails]))
    while len(vocab) < vocab_size:
        pc = Counter()
        for w, s in sym.items():
            for a, b in zip(s, s[1:]):
                pc[(a, b)] += counts[w]
        if not pc:
            break
        (l, r), _ = min(pc.items(), key=lambda kv: (-kv[1], kv[0][0], kv[0][1]))
        new = l + r[2:] if r.startswith("##") else l + r
        if new not in vocab:
            vocab.append(new)
        for w, s in sym.items():
            out, i = [], 0
            while i < len(s):
                if i + 1 < len(s) and s[i] == l and s[i + 1] == r:
                    out.append(new)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            sym[w] = out
    return vocab


def train(spark, counts, size):
    df = spark.createDataFrame(list(counts.items()), "word string, count long")
    v = K.train_wordpiece(df, vocab_size=size).orderBy("id").collect()
    return [r.token for r in v]


def test_wordpiece_pairs_and_long_words(spark):
    counts = {"ab": 5, "cd": 5, "ba": 2, "a": 7, "abcd": 3, "aaaa": 2, "dcb": 4, "bb": 1}
    for size in (12, 20, 100):
        assert train(spark, counts, size) == py_wordpiece(counts, size), size


def test_wordpiece_rounds_read_fewer_rows(spark):
    """A round reads the index rows of the pairs it merges, not all words; the
    rarer the pairs, the fewer.  Segments written in between change nothing."""
    r = random.Random(9)
    parts = ["an", "the", "re", "in", "st", "on", "er", "al"]
    counts = {"".join(r.choice(parts) for _ in range(r.randint(1, 4))): r.randint(1, 40) for _ in range(400)}
    df = spark.createDataFrame(list(counts.items()), "word string, count long")
    want = py_wordpiece(counts, 70)
    for every in (2, 5):
        read = []
        v = K.train_wordpiece(df, vocab_size=70, segment_every=every, rows_read=read).orderBy("id").collect()
        assert [x.token for x in v] == want
        held = sum(len(w) - 1 for w in counts)              # pairs of words at the start
        assert max(read) < held / 2 and sum(read[-3:]) < sum(read[:3])


def greedy_pieces(word, vocab, unk):
    out, start = [], 0
    if len(word) > K.WORDPIECE_MAX_CHARS:
        return [unk]
    while start < len(word):
        end = len(word)
        while end > start and (word[start:end] if start == 0 else "##" + word[start:end]) not in vocab:
            end -= 1
        if end == start:
            return [unk]
        out.append(vocab[word[start:end] if start == 0 else "##" + word[start:end]])
        start = end
    return out


@pytest.mark.parametrize("seed", range(4))
def test_trie_cuts_as_longest_match(seed):
    r = random.Random(seed)
    for _ in range(60):
        letters = r.choice(["ab", "abc", "a#b", "aéb\U0001f642"])
        word = lambda n: "".join(r.choice(letters) for _ in range(r.randint(1, n)))
        pieces = {p for _ in range(r.randint(1, 25)) for p in [("##" if r.random() < 0.6 else "") + word(6)]}
        vocab = {p: i + 1 for i, p in enumerate(sorted(pieces | {"##"}))}
        trie = PieceTrie(vocab, 0)
        for _ in range(60):
            w = word(r.choice([4, 12, 40]))
            assert trie.encode(w) == greedy_pieces(w, vocab, 0), (w, vocab)
    assert trie.encode("") == [] and trie.encode("a" * 101) == [0]


def test_trie_takes_linear_time():
    """Every start is a long near-match: the longest-match loop would be cubic."""
    vocab = {"a": 1, "##a": 2, **{"##" + "a" * n + "b": n + 2 for n in range(1, 300)}}
    trie = PieceTrie(vocab, 0, max_chars=1 << 30)
    start = time.perf_counter()
    assert trie.encode("a" * 200_000) == [1] + [2] * 199_999
    assert time.perf_counter() - start < 5


def test_large_vocabularies_are_refused(spark):
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(K.BERT_SPECIALS)], "token string, id int")
    with pytest.raises(ValueError, match="not sent"):
        K.wordpiece_ids("w", vocab, max_entries=4)


def test_wordpiece_encode(spark):
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(K.BERT_SPECIALS + ["a", "b", "##b", "##c", "ab"])],
                                  "token string, id int")
    df = spark.createDataFrame([(["abc", "ba", "x", "a" * 101],)], "w array<string>")
    got = df.select(K.wordpiece_ids("w", vocab, strip=False)).first()[0]
    # "abc" -> ab ##c; "ba" -> b then no "##a": the whole word is [UNK]
    assert got == [9, 8, 0, 0, 0]


def test_wordpiece_encode_strips_and_splits(spark):
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(K.BERT_SPECIALS + ["e", "a", "##a", "ea"])],
                                  "token string, id int")
    df = spark.createDataFrame([(["éa"],)], "w array<string>")
    assert df.select(K.wordpiece_ids("w", vocab)).first()[0] == [8]


def test_bert_normalize_and_split(spark):
    df = spark.createDataFrame([("Héllo,\tWörld!\u0007 a_b",)], "t string")
    toks = df.select(K.bert_pretokenize(K.bert_normalize(F.col("t")))).first()[0]
    assert toks == ["hello", ",", "world", "!", "a", "_", "b"]


def test_residue_ids_and_inverse(spark):
    df = spark.createDataFrame([("LAGZJ",)], "s string")
    ids = df.select(K.residue_ids("s")).first()[0]
    assert ids == [0, 4, 5, 6, 27, 3, 2]
    back = df.select(K.ids_to_tokens(K.residue_ids("s"))).first()[0]
    assert back == ["<cls>", "L", "A", "G", "Z", "<unk>", "<eos>"]
    assert df.select(K.drop_markers(K.residue_ids("s"))).first()[0] == [4, 5, 6, 27, 3]
    assert df.select(K.baseline_ids(K.residue_ids("s"))).first()[0] == [0, 1, 1, 1, 1, 1, 2]


def test_one_hot_and_counts(spark):
    df = spark.createDataFrame([("GAX",)], "s string")
    oh = df.select(K.one_hot("s")).first()[0]
    assert len(oh) == 3 and all(len(r) == 21 for r in oh)
    assert oh[0][0] == 1 and oh[1][1] == 1 and oh[2][20] == 1
    counts = df.select(K.residue_counts("s")).first()[0]
    assert counts[0] == 1 and counts[1] == 1 and counts[20] == 1 and sum(counts) == 3


def test_pad_left_truncate_right(spark):
    df = spark.createDataFrame([([5, 6, 7],), ([5],)], "ids array<int>")
    rows = df.select(*K.pad_left_truncate_right("ids", 2, pad_id=1)).collect()
    assert [tuple(r) for r in rows] == [([5, 6], [1, 1]), ([1, 5], [0, 1])]


def test_encode_by_join_matches_literal_map(spark):
    df = spark.createDataFrame([(0, "bAa"), (1, "zz"), (2, "cab")], "i int, t string")
    vocab = K.fit_char_vocab(df.where("i != 1"), "t", ["i"])
    m = K.vocab_map(vocab)
    want = {r.i: r.ids for r in df.select("i", K.encode_chars("t", m).alias("ids")).collect()}
    got = {r.i: r.ids for r in K.encode_chars_by_join(df, "i", "t", vocab).collect()}
    assert got == want and got[1] == []


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="LAGVSERTIDPKQNFYMHWC", max_size=30))
def test_decode_encode_roundtrip(spark, seq):
    df = spark.createDataFrame([(seq,)], "s string")
    toks = df.select(K.ids_to_tokens(K.drop_markers(K.residue_ids("s")))).first()[0]
    assert "".join(toks) == seq


def test_bert_cjk_spacing(spark):
    df = spark.createDataFrame([("ab中文c",)], "t string")
    assert df.select(K.bert_pretokenize(K.bert_normalize(F.col("t")))).first()[0] == ["ab", "中", "文", "c"]


def py_keras_word_vocab(texts):
    filters = K.KERAS_FILTERS
    counts = {}
    for t in texts:
        t = t.lower().translate({ord(c): " " for c in filters})
        for w in (x for x in t.split(" ") if x):
            counts[w] = counts.get(w, 0) + 1     # dict keeps first-appearance order
    ranked = sorted(counts.items(), key=lambda kv: -kv[1])   # stable: ties by first appearance
    return {w: i + 1 for i, (w, _) in enumerate(ranked)}


def test_word_vocab_matches_keras_rule(spark):
    texts = ["The cat, the DOG!", "a\\rb dog\\tcat", "x--y the (cat)", "dog"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.token: r.id for r in K.fit_word_vocab(df, "t", ["i"]).collect()}
    assert got == py_keras_word_vocab(texts)


def test_exact_median_with_hot_value(spark):
    vals = [7] * 1000 + list(range(2000))       # one value on a third of the rows
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    s = sorted(vals)
    want = (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2
    assert K.exact_median(df, "v").first()[0] == want


def test_whole_texts_go_to_python_in_small_batches(spark):
    """Memory of a worker must not grow with the rows of a task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    K.strip_accents(F.lit("\u00e9"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1024
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")) <= 4 << 20
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    rows = [(0, ["\u00e9a", "a", "\u00e9a"]), (1, []), (2, None), (3, ["x"]), (4, ["a", "a"])]
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(K.BERT_SPECIALS + ["a", "e", "##a"])], "token string, id int")
    df = spark.createDataFrame(rows, "i int, w array<string>").coalesce(1)
    assert {r.i: r.ids for r in df.select("i", K.wordpiece_ids("w", vocab).alias("ids")).collect()} == {
        0: [6, 7, 5, 6, 7], 1: [], 2: None, 3: [0], 4: [5, 5]}
    texts = spark.createDataFrame([(0, "\u00e9"), (1, None), (2, "e"), (3, "\u1e69\uac01")], "i int, t string").coalesce(1)
    got = {r.i: r.s for r in texts.select("i", K.strip_accents("t").alias("s")).collect()}
    assert got == {0: "e", 1: None, 2: "e", 3: "s\u1100\u1161\u11a8"}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_hot_rows_as_digits(spark):
    df = spark.createDataFrame([("GAXZ",), ("",)], "s string")
    for r in df.select(K.one_hot("s").alias("rows"), K.one_hot("s", digits=True).alias("text")).collect():
        assert r.text == ["".join(map(str, x)) for x in r.rows]
