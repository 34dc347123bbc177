"""Operators 3 and 5 against the library and against all segmentations."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from cases import ODD, clashing, documents

from helixframe.llm import bpe_counts, piece_nbest
from helixframe.llm.pieces import read_model

MODEL = read_model(public_tokenizers.path("piece_bpe_32k.model"))
ODD_TEXTS = ["", " ", "  ", "a  b   ", "\x00\n\t  x", "①②é 漢字 \U0001f642\U0001f642",
             "<s> </s> <unk> <0x41>", "▁a ▁ ▁▁", "(x);\r\n\r\n{\r", "a" * 50, " " * 70 + "x" + " " * 33]


def random_texts(n, longest, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice("ab ▁<>0x1()\n\r{};the in é漢\U0001f642") for _ in range(r.randint(0, longest)))
            for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_counts_equal_the_library(library):
    counter = bpe_counts.Counter(MODEL)
    for t in [*ODD_TEXTS, *random_texts(2000, 60)]:
        assert counter.count(t) == len(library.encode(t)), t


def test_a_full_cache_changes_no_count(library):
    counter = bpe_counts.Counter(MODEL)
    counter.of_word.entries = counter.of_part.entries = 3
    for t in random_texts(300, 60, seed=5):
        assert counter.count(t) == len(library.encode(t))


def all_segmentations(text, pieces):
    text, out = pieces.normal(text), []

    def go(i, score, ids):
        if i == len(text):
            out.append((score, ids))
            return
        if text[i] not in pieces.score:
            go(i + 1, score + pieces.unknown_score, ids + tuple(pieces.byte_ids[b] for b in text[i].encode()))
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in pieces.score:
                go(j, score + pieces.score[text[i:j]], ids + (pieces.ids[text[i:j]],))
    go(0, 0.0, ())
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("n", [1, 2, 4])
def test_n_best_are_the_best_of_all(n):
    seg = piece_nbest.Segmenter(MODEL, n)
    from helixframe.llm.pieces import Pieces
    pieces = Pieces(MODEL)
    for t in [x[:11] for x in [*ODD_TEXTS, *random_texts(300, 11, seed=n)]]:
        every = all_segmentations(t, pieces)
        got = [(s, tuple(np.frombuffer(i, "<i4").tolist())) for s, i in seg.text(t)]
        assert [s for s, _ in got] == [s for s, _ in every[:n]]
        assert len(set(got)) == len(got) and set(got) <= set(every)


def test_decoding_undoes_encoding():
    seg = piece_nbest.Segmenter(MODEL, 2)
    for t in [*ODD_TEXTS, *random_texts(500, 80)]:
        for _, ids in seg.text(t):
            assert seg.decode(np.frombuffer(ids, "<i4")) == t.replace("▁", " ")


def test_odd_rows(spark, library):
    df = clashing(documents(spark))
    got = sorted(bpe_counts.token_counts(df, MODEL, 4096).collect(), key=str)
    want = sorted([(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096)
                   for i, t, *_ in ODD], key=str)
    assert sorted(map(tuple, got), key=str) == want
    back = piece_nbest.round_trip(df, MODEL, 2).collect()
    assert len(back) == len(ODD) and all(r["decoded_ok"] for r in back)
    assert {r["n_pieces"] for r in back if r["doc_id"] in (1, 2)} == {0}
    coded = piece_nbest.encode(df, MODEL, 2, keep=("lang",))
    text = {(r["doc_id"], r["lang"]): r["decoded"] for r in piece_nbest.decode(coded, MODEL, keep=("doc_id", "lang")).collect()}
    assert all(text[i, lang] == (t or "").replace("▁", " ") for i, t, lang, *_ in ODD)
    assert bpe_counts.token_counts(df.limit(0), MODEL).count() == 0
    assert piece_nbest.encode(df.limit(0), MODEL).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5])
def test_many_words_at_once_are_as_one_by_one(n):
    from helixframe.llm.pieces import Pieces
    r = random.Random(n)
    pieces = Pieces(MODEL)
    many = piece_nbest.Lattices(pieces)
    alone = piece_nbest.Segmenter(MODEL, n)
    words = [w for w in {"".join(r.choice("▁abcdeinsthr.,é") for _ in range(r.choice([1, 2, 5, 8, 9, 16, 17, 32]))) for _ in range(3000)}
             if many.fits(w)]
    assert len(words) > 1000 and max(map(len, words)) == 32
    assert many.n_best(words, n) == [piece_nbest.n_best(w, alone.pieces, n) for w in words]


def test_a_full_cache_changes_no_segmentation():
    small, large = piece_nbest.Segmenter(MODEL, 2, cache_entries=3), piece_nbest.Segmenter(MODEL, 2)
    texts = [*ODD_TEXTS, *random_texts(300, 60, seed=6)]
    assert small.texts(texts) == large.texts(texts)
