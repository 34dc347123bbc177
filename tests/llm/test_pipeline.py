"""The pipeline's stages against plain versions, on a small documents table."""

import random

import public_tokenizers
import pytest
import sentencepiece
from cases import LONG, ODD, clashing, documents
from test_lines import plain as plain_lines
from test_models import text_in
from test_simhash import closed, plain_fingerprint, plain_links
from test_tiling import plain_covered

import corpus_pipeline as C
from helixframe.llm import piece_nbest, tiling_decontam
from helixframe.llm.pieces import Pieces


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = random.Random(7)
    items = [(i, text_in("en", r, r.randint(15, 40))) for i in range(6)] + [(9, None)]
    base = text_in("de", r, 300)
    rows = list(ODD)
    for i in range(100, 220):
        lang = r.choice(["en", "de", "fr"])
        lines = [text_in(lang, r, r.randint(5, 30)) for _ in range(r.randint(1, 6))]
        if i % 5 == 0:
            lines.append("the same licence line in many texts")
        if i % 11 == 0:
            lines.insert(1, items[i % 6][1])
        rows.append((i, "\n".join(lines), lang, r.choice(["hot", "hot", "b"]), None))
    rows += [(300 + i, base, "de", "hot", 1) for i in range(6)] + [(400 + i, f"{base} und{i}", "de", "c", 1) for i in range(6)]
    folder = tmp_path_factory.mktemp("tables")
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_every_stage(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    names = docs.columns
    stages = dict(C.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "sentencepiece"]

    one = C.cut(stages["language_id"](spark, docs, sf_dir), "t")
    assert one.columns == names
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in one.collect()}
    assert {1, 2, 3} <= gone <= {1, 2, 3, 4, 5, 6, 7, 8, None}           # empty texts go, real ones stay

    two = C.cut(stages["line_dedup"](spark, one, sf_dir), "t")
    assert two.columns == names
    assert sorted([(r["doc_id"], r["text"]) for r in two.collect()], key=str) == sorted(
        [x[:2] for x in plain_lines([tuple(r) for r in one.collect()])], key=str)

    three = C.cut(stages["simhash_near_dedup"](spark, two, sf_dir), "t")
    fp = [(r["doc_id"], plain_fingerprint(r["text"])) for r in two.collect()]
    root = closed(sorted({f for _, f in fp}), plain_links(sorted({f for _, f in fp})))
    least = {}                                      # one row of each group, the smallest id
    for i, f in fp:
        least[root[f]] = min((i is None, i or 0), least.get(root[f], (True, 0)))
    root_of = lambda r: root[plain_fingerprint(r["text"])]
    assert sorted((root_of(r), r["doc_id"] is None, r["doc_id"] or 0) for r in three.collect()) == sorted(
        (k, *v) for k, v in least.items())

    four = C.cut(stages["decontamination"](spark, three, sf_dir), "t")
    bad, number = set(), {}
    for item in C.table(spark, sf_dir, "benchmark").collect():
        pattern = [number.setdefault(w, len(number) + 1) for w in tiling_decontam.tokens(item["text"])]
        for r in three.collect():
            text = [number.get(w, 0) for w in tiling_decontam.tokens(r["text"])]
            if pattern and plain_covered(pattern, text, min(5, len(pattern))) >= tiling_decontam.THRESHOLD * len(pattern):
                bad.add(r["doc_id"])
    assert bad and rows_of(four) == [r for r in rows_of(three) if r[0] not in bad]

    five = stages["sentencepiece"](spark, four, sf_dir)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = Pieces(C.piece_model())
    score = {pieces.ids[p]: s for p, s in pieces.score.items()}
    cost = lambda ids, t: sum(score.get(i, 0) for i in ids) + pieces.unknown_score * sum(
        c not in pieces.score for c in pieces.normal(t))
    text = {str(r["doc_id"]): r["text"] for r in four.collect()}
    got = five.collect()
    assert len(got) == four.count()
    for r in got:
        assert r["decoded_ok"] and r["library_ids"] == library.encode(text[str(r["doc_id"])])
        assert library.decode(list(r["ids"])) == text[str(r["doc_id"])].replace("▁", " ")
        assert cost(r["ids"], text[str(r["doc_id"])]) >= cost(library.encode(text[str(r["doc_id"])]), text[str(r["doc_id"])])
    back = piece_nbest.decode(five, C.piece_model())
    assert {(str(r["doc_id"]), r["decoded"]) for r in back.collect()} == {(i, t.replace("▁", " ")) for i, t in text.items()}
    assert rows_of(C.run(spark, sf_dir)) == rows_of(five)


def test_stages_take_odd_rows_extra_columns_and_empty_tables(spark, sf_dir):
    for df in (clashing(documents(spark)), clashing(documents(spark)).limit(0)):
        for name, stage in C.STAGES:
            out = stage(spark, df, sf_dir)
            assert out.count() <= df.count()
            if name != "sentencepiece":
                assert out.columns == df.columns
    assert len(LONG) in {len(t or "") for _, t, *_ in ODD}


def test_rows_are_judged_not_ids(spark, sf_dir):
    """Clean rows stay beside a rejected or contaminated row with their id."""
    r = random.Random(11)
    clean = [(i, text_in("en", r, 60), "en", "a", 1) for i in (None, None, 7, *range(50, 90))]
    item = next(x["text"] for x in C.table(spark, sf_dir, "benchmark").orderBy("item_id").collect())
    empty, leaked = [(i, "", "en", "a", 0) for i in (None, 7)], [(i, item, "en", "a", 1) for i in (None, 7)]
    stages = dict(C.STAGES)
    for stage, bad in (("language_id", empty), ("decontamination", leaked)):
        df = documents(spark, clean + bad).repartition(3).withColumnRenamed("n_chars", "__row")
        out = stages[stage](spark, df, sf_dir)
        assert out.columns == df.columns and rows_of(out) == sorted(clean, key=str)


def test_near_copies_go_by_row(spark, sf_dir):
    """A clean text stays beside a copy that has its id; of repeated rows one
    stays; copies without an id go like others."""
    r = random.Random(12)
    a, b, c, d = (text_in("en", r, 300) for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (None, a), (None, c), (5, d), (5, d), (None, d), (None, c)]
    df = documents(spark, [(i, t, "en", "a", 1) for i, t in rows]).repartition(3)
    got = sorted([(x["doc_id"], x["text"]) for x in C.near_copies(spark, df, sf_dir).collect()], key=str)
    assert got == sorted([(1, a), (2, b), (None, c), (5, d)], key=str)


def test_the_last_stage_searches_the_n_best(spark, sf_dir):
    """Not the best segmentation alone: as many as the operator's own query, with their scores."""
    r = random.Random(13)
    df = documents(spark, [(i, text_in("en", r, 30), "en", "a", 1) for i in range(6)])
    for row in C.segmented(spark, df, sf_dir).collect():
        assert len(row["scores"]) == 2 and row["scores"][0] >= row["scores"][1]
        assert len(row["alternatives"]) == 1 and row["alternatives"][0] != row["ids"]
