"""A whole tokenizer file (SRC-06): normaliser, pre-tokeniser, special tokens,
model and post-processor compiled into one column plan.

Normalising, splitting and the special tokens are Spark expressions; only the
longest-match model (and the accents of words beyond ASCII) runs in Python, in
Arrow batches.  Settings that are not built raise, so no file is read as
something else than it says.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.text import BERT_TOKEN
from helixframe.operators import tokens as K

MAX_BYTES = 64 << 20


@dataclass
class TokenizerFile:
    vocab: dict[str, int]
    unk: str
    prefix: str
    max_chars: int
    specials: dict[str, int]
    clean: bool
    cjk: bool
    accents: bool
    lowercase: bool
    split: str
    template: list[int | None]                          # ids around the text's own (None)

    def words(self, text) -> Column:
        """The words of a text: special tokens marked, others normalised and split."""
        c = F.col(text) if isinstance(text, str) else text

        def plain(s):
            s = K.bert_clean_lower(s, self.lowercase, self.clean, self.cjk)
            return F.regexp_extract_all(s, F.lit(self.split), 0)
        if not self.specials:
            return plain(c)
        # the special tokens are found in the text as it is, the longer one where two begin
        any_special = "|".join(re.escape(t) for t in sorted(self.specials, key=len, reverse=True))
        parts = F.regexp_extract_all(c, F.lit(f"(?s){any_special}|(?:(?!{any_special}).)+"), 0)
        marked = F.transform(parts, lambda p: F.when(p.isin(*self.specials), F.array(F.concat(F.lit(K.SPECIAL_MARK), p))).otherwise(plain(p)))
        return F.flatten(marked)

    def ids(self, spark: SparkSession, text, add_special_tokens: bool = True) -> Column:
        """The ids of a text, as the library gives them for the file."""
        vocab = spark.createDataFrame(list(self.vocab.items()), "token string, id int")
        ids = K.wordpiece_ids(self.words(text), vocab, self.unk, self.accents, MAX_BYTES, self.prefix, self.max_chars, self.specials)
        if not add_special_tokens or self.template == [None]:
            return ids
        return F.concat(*[ids if t is None else F.array(F.lit(t)) for t in self.template])


def _normalizer(made: dict | None) -> dict:
    kinds = {None: {}, "Lowercase": {"lowercase": True}}
    out = {"clean": False, "cjk": False, "accents": False, "lowercase": False}
    if made is None or made["type"] in kinds:
        return out | kinds[made and made["type"]]
    if made["type"] != "BertNormalizer":
        raise ValueError(f"normaliser {made['type']} is not built")
    accents = made["strip_accents"]
    return {"clean": made["clean_text"], "cjk": made["handle_chinese_chars"], "lowercase": made["lowercase"],
            "accents": made["lowercase"] if accents is None else accents}


def _splitter(made: dict | None) -> str:
    kinds = {"BertPreTokenizer": BERT_TOKEN, "WhitespaceSplit": r"\S+"}
    if made is None or made["type"] not in kinds:
        raise ValueError(f"pre-tokeniser {made and made['type']} is not built")
    return kinds[made["type"]]


def _template(made: dict | None) -> list[int | None]:
    if made is None:
        return [None]
    if made["type"] != "TemplateProcessing":
        raise ValueError(f"post-processor {made['type']} is not built")
    out: list[int | None] = []
    for item in made["single"]:
        out += [None] if "Sequence" in item else made["special_tokens"][item["SpecialToken"]["id"]]["ids"]
    return out


def parse(text: str) -> TokenizerFile:
    made = json.loads(text)
    model = made["model"]
    if model.get("type") != "WordPiece":
        raise ValueError(f"model {model.get('type')} is not built")
    if made.get("truncation") or made.get("padding"):
        raise ValueError("truncation and padding are steps of their own here")
    added = made.get("added_tokens") or []
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("added tokens with stripping, of whole words or found after normalising are not built")
    normal, split = _normalizer(made.get("normalizer")), _splitter(made.get("pre_tokenizer"))
    if normal["accents"] and split != BERT_TOKEN:
        raise ValueError("accents are stripped with the BERT pre-tokeniser only")
    return TokenizerFile(model["vocab"], model["unk_token"], model["continuing_subword_prefix"], model["max_input_chars_per_word"],
                         {t["content"]: t["id"] for t in added}, **normal, split=split, template=_template(made.get("post_processor")))


def read_tokenizer(spark: SparkSession, path: str) -> TokenizerFile:
    """One tokenizer file from any store that Spark reads; it is driver data, so its size is checked first."""
    raw = spark.read.text(path, wholetext=True)
    size = raw.agg(F.max(F.length("value")), F.count(F.lit(1))).first()
    if size[1] != 1 or size[0] > MAX_BYTES:
        raise ValueError(f"{path}: {size[1]} files of up to {size[0]} characters; one of at most {MAX_BYTES} is read")
    return parse(raw.first()[0])


def write_tokenizer(vocab: DataFrame, path: str, specials=K.BERT_SPECIALS, max_entries: int = 1_000_000) -> None:
    """A WordPiece vocabulary with the BERT settings as a tokenizer file."""
    if vocab.limit(max_entries + 1).count() > max_entries:
        raise ValueError("vocabulary too large for a single JSON object")
    added = [{"id": i, "content": t, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
             for i, t in enumerate(specials)]
    head = json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": added,
                       "normalizer": {"type": "BertNormalizer", "clean_text": True, "handle_chinese_chars": True, "strip_accents": None,
                                      "lowercase": True},
                       "pre_tokenizer": {"type": "BertPreTokenizer"}, "post_processor": None, "decoder": None})
    model = json.dumps({"type": "WordPiece", "unk_token": specials[0], "continuing_subword_prefix": K.WORDPIECE_PREFIX,
                        "max_input_chars_per_word": K.WORDPIECE_MAX_CHARS})
    one = vocab.agg(F.map_from_entries(F.collect_list(F.struct("token", F.col("id").cast("int")))).alias("v"))
    (one.select(F.concat(F.lit(head[:-1] + ', "model": ' + model[:-1] + ', "vocab": '), F.to_json("v"), F.lit("}}")).alias("value"))
     .coalesce(1).write.mode("errorifexists").text(path))
