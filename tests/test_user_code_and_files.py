"""Row generators (UDF-04), tokenizer files (SRC-06), bucketed joins (JON-01)."""

import os
import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions.text import explode_items, overlap_words
from helixframe.operators.generators import generate_rows
from helixframe.plans.q_splits import bucketed_join
from helixframe.plans.q_tokens import _py_overlap_words
from helixframe.sources import tokenizer_file as TF


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


@pytest.mark.parametrize("by", [(), ("id",), ("g",)])
def test_generator_gives_the_words(spark, by):
    texts = ["ABCDE", "ABCDEFGHIJ", "ABCDEFG", "AB", "", None, "é" * 20, "\U0001f642x" * 9]
    df = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(texts)], "id int, g int, text string").repartition(3)
    got = generate_rows(df, _py_overlap_words, "word string", keep=["id"], partition_by=by)
    assert got.dtypes == [("id", "int"), ("word", "string")]                 # planned before anything runs
    assert rows(got) == rows(explode_items(df, overlap_words("text", 5, 2), "word", keep=["id"]).where("word IS NOT NULL"))


class Running:
    """A running sum of a key's values, and the total at its end."""

    def __init__(self):
        self.total = 0

    def __call__(self, row):
        self.total += row["v"]
        yield ("row", self.total)

    def finish(self):
        yield ("total", self.total)


def test_generator_with_state_for_each_key(spark):
    df = spark.createDataFrame([(k, t, t * (k + 1)) for k in range(3) for t in range(4)], "k int, t int, v int").repartition(5)
    got = generate_rows(df, Running, "what string, sum int", keep=["k"], partition_by=["k"], order_by=["t"])
    want = [(k, "row", (k + 1) * t * (t + 1) // 2) for k in range(3) for t in range(4)] + [(k, "total", (k + 1) * 6) for k in range(3)]
    assert rows(got) == sorted(want, key=str)
    with pytest.raises(ValueError, match="kept"):
        generate_rows(df, Running, "k int", keep=["k"])


def made(folder, **how):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers, processors
    r = random.Random(5)
    letters = "abcdeéilnorst漢1!?."
    pieces = ["[UNK]", "[PAD]", "[CLS]", "[SEP]", "[MASK]", *letters, *["##" + c for c in letters],
              *{("##" if r.random() < 0.5 else "") + "".join(r.choice("abcdeilnorst") for _ in range(r.randint(2, 4))) for _ in range(200)}]
    t = Tokenizer(models.WordPiece({p: i for i, p in enumerate(dict.fromkeys(pieces))}, unk_token="[UNK]", max_input_chars_per_word=how.get("most", 100)))
    t.normalizer = normalizers.BertNormalizer(**how.get("normal", {}))
    t.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
    t.add_special_tokens(["[UNK]", "[PAD]", "[CLS]", "[SEP]", "[MASK]"])
    if how.get("template"):
        t.post_processor = processors.TemplateProcessing(single="[CLS] $A [SEP]", special_tokens=[("[CLS]", 2), ("[SEP]", 3)])
    t.save(os.path.join(folder, "tokenizer.json"))
    return t


@pytest.mark.parametrize("how", [{}, {"normal": {"lowercase": False}}, {"normal": {"strip_accents": False}}, {"template": True},
                                 {"normal": {"handle_chinese_chars": False, "lowercase": False}}, {"most": 6}])
def test_ids_are_the_librarys_for_the_file(spark, tmp_dir, how):
    library = made(tmp_dir, **how)
    r = random.Random(8)
    texts = ["", "   ", "[CLS] abc [SEP][MASK]x[UNK]", "[cls] [MAS", "Élan é é ABC", "漢漢 字", "a\tb\nc d e", "\x00\x07a�b", "x" * 300]
    texts += ["".join(r.choice("abcdeilnorst  AEÉ漢字!?.[]1́") for _ in range(r.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    file = TF.read_tokenizer(spark, os.path.join(tmp_dir, "tokenizer.json"))
    for special in (True, False):
        got = {x["i"]: x["ids"] for x in df.select("i", file.ids(spark, "t", special).alias("ids")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == library.encode(t, add_special_tokens=special).ids, repr(t)


def test_a_written_file_reads_in_the_library(spark, tmp_dir):
    from tokenizers import Tokenizer
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(["[UNK]", "[PAD]", "[CLS]", "[SEP]", "[MASK]", "a", "##b", "ab", '"'])], "token string, id int")
    TF.write_tokenizer(vocab, os.path.join(tmp_dir, "t"))
    part = next(p for p in os.listdir(os.path.join(tmp_dir, "t")) if p.startswith("part"))
    library = Tokenizer.from_file(os.path.join(tmp_dir, "t", part))
    file = TF.read_tokenizer(spark, os.path.join(tmp_dir, "t"))
    got = spark.createDataFrame([('ABB a" [SEP]',)], "t string").select(file.ids(spark, "t")).first()[0]
    assert got == library.encode('ABB a" [SEP]').ids == [7, 6, 5, 8, 3]


@pytest.mark.parametrize(("part", "value"), [("model", {"type": "BPE"}), ("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "ByteLevel"}),
                                             ("truncation", {"max_length": 4}), ("post_processor", {"type": "ByteLevel"})])
def test_settings_that_are_not_built_raise(tmp_dir, part, value):
    import json
    made(tmp_dir)
    with open(os.path.join(tmp_dir, "tokenizer.json"), encoding="utf-8") as f:
        spec = json.load(f)
    with pytest.raises(ValueError):
        TF.parse(json.dumps(spec | {part: value}))


def test_bucketed_join_has_no_exchange(spark):
    data = spark.range(500).select(F.col("id").alias("row_id"), (F.col("id") % 2).alias("label"))
    index = spark.range(500).select(F.col("id").alias("row_id"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("fold"))
    joined = bucketed_join(spark, data, index, 8)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert joined.count() == 12_500 and joined.select("row_id", "fold").distinct().count() == 12_500
