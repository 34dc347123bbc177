"""Readers and writers with the FIXTURES edge cases (SRC, SNK, JON-02)."""

import glob
import io
import os
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from helixframe.sources import byte_ranges as B
from helixframe.sources import readers as RD
from helixframe.sources import writers as WR


def write(path, name, text, newline=""):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w", newline=newline, encoding="utf-8") as f:
        f.write(text)


def test_pair_csv_edge_cases(spark, tmp_dir):
    long = "M" * 1500
    rows = [("AAA", "CCC"), ("SAME", "SAME"), ("", "D"), (None, "E"), (long, "F"), ("G,H", 'I"J')]
    df = spark.createDataFrame(rows, "`surf.sequence` string, `deep.sequence` string")
    out = os.path.join(tmp_dir, "pairs")
    df.coalesce(1).write.option("header", True).csv(out)
    back = RD.read_pair_csv(spark, out).orderBy("row_id").collect()
    assert [r.row_id for r in back] == list(range(6))
    # an empty field reads as NULL, as pandas' read_csv gives NaN
    assert [(r.surf_sequence, r.deep_sequence) for r in back] == [
        ("AAA", "CCC"), ("SAME", "SAME"), (None, "D"), (None, "E"), (long, "F"), ("G,H", 'I"J')]


def test_pair_csv_folds_of_unequal_size(spark, tmp_dir):
    for n in (0, 1, 7, 11):
        out = os.path.join(tmp_dir, f"p{n}")
        df = spark.createDataFrame([(f"s{i}", f"d{i}") for i in range(n)], "`surf.sequence` string, `deep.sequence` string")
        df.coalesce(1).write.option("header", True).csv(out)
        assert RD.read_pair_csv(spark, out).count() == n


def test_file_position_over_files(spark, tmp_dir):
    d = os.path.join(tmp_dir, "multi")
    write(d, "b.csv", "surf.sequence,deep.sequence\nb0,x\nb1,x\n")
    write(d, "a.csv", "surf.sequence,deep.sequence\na0,x\na1,x\na2,x\n")
    got = [(r.row_id, r.surf_sequence) for r in RD.read_pair_csv(spark, d).orderBy("row_id").collect()]
    assert got == [(0, "a0"), (1, "a1"), (2, "a2"), (3, "b0"), (4, "b1")]


import pytest


@pytest.mark.parametrize("whole", [False, True])
def test_three_line_records(spark, tmp_dir, whole):
    d = os.path.join(tmp_dir, "rec")
    body = "".join(f">id {i}\nREF{i}\nEVO{i}\n" for i in range(5))
    write(d, "a.txt", body.replace("\n", "\r\n"))                     # CRLF
    write(d, "b.txt", "> Yé ast\nÀBC-d\nxyz\nonly-one-line\n")        # accents, partial
    write(d, "c.txt", "")                                             # empty file
    got = RD.read_three_line_records(spark, d, whole_files=whole).orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(6))
    assert (got[0].yeast_id, got[0].reference_sequence, got[0].evolved_sequence) == ("id0", "REF0", "EVO0")
    assert (got[5].yeast_id, got[5].reference_sequence) == ("Yéast", "ÀBCd")
    left = {os.path.basename(r.path): r.left_over for r in RD.partial_records(spark, d).collect()}
    assert left == {"b.txt": 1}
    kept = RD.read_three_line_records(spark, d, keep_partial=True, whole_files=whole).where(
        F.col("reference_sequence").isNull())
    assert kept.count() == 1


def test_line_numbers_across_splits(spark, tmp_dir):
    d = os.path.join(tmp_dir, "big")
    write(d, "big.txt", "".join(f"line{i}\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        df = spark.read.text(d)
        assert df.rdd.getNumPartitions() > 4
        got = RD.line_numbers(df).select("line_no", "value").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(r.value == f"line{r.line_no}" for r in got) and len(got) == 20000
    recs = RD.read_three_line_records(spark, d)
    assert recs.count() == 6666


@pytest.mark.parametrize("whole", [True, False])
def test_fasta_cases(spark, tmp_dir, whole):
    d = os.path.join(tmp_dir, "fasta")
    write(d, "1.fa", ">P1 one record\nMKT\n")
    write(d, "2.fa", ">P2 first\nAAA\nCCC\n>P3 second\nGGG\n")              # two records, first kept
    write(d, "3.fa", "; comment\n>P1 later file\nTT T\nWW\n")               # same id, later path wins
    first = {(os.path.basename(r.path), r.id, r.seq) for r in RD.read_fasta_first(spark, d, whole).collect()}
    assert first == {("1.fa", "P1", "MKT"), ("2.fa", "P2", "AAACCC"), ("3.fa", "P1", "TTTWW")}
    m = {r.id: r.seq for r in RD.fasta_map(RD.read_fasta_first(spark, d, whole)).collect()}
    assert m == {"P1": "TTTWW", "P2": "AAACCC"}
    allr = {(r.id, r.description, r.seq) for r in RD.read_fasta_all(spark, d, whole).collect()}
    assert ("P3", "second", "GGG") in allr and ("P1", "one record", "MKT") in allr


def test_fasta_writer_round_trip(spark, tmp_dir):
    seq = "ACDEFGHIKL" * 13
    df = spark.createDataFrame([(0, "x1", seq, "d"), (0, "x2", "MM", "d"), (1, "y1", "KK", "e")],
                               "f int, id string, seq string, desc string")
    out = os.path.join(tmp_dir, "fw")
    WR.write_fasta(df, out, "id", "seq", file_col="f", order=["id"], desc_col="desc")
    got = {(r.id, r.seq) for r in RD.read_fasta_first(spark, out).collect()}
    assert got == {("x1", seq), ("y1", "KK")}


def test_split_index_pruned(spark, tmp_dir):
    df = spark.createDataFrame([(i, "train" if i % 2 else "test", r, f) for i in range(6) for r in range(2) for f in range(3)],
                               "row_id long, split string, repeat int, fold int")
    out = os.path.join(tmp_dir, "idx")
    WR.write_split_index(df, out)
    one = RD.read_split_index(spark, out, repeat=1, fold=2)
    assert one.count() == 6
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "fold" in plan


def test_vocab_json_round_trip(spark, tmp_dir):
    v = spark.createDataFrame([("[UNK]", 0), ("a", 1), ("##b", 2)], "token string, id int")
    WR.write_vocab(v, os.path.join(tmp_dir, "vp"), json_path=os.path.join(tmp_dir, "vj"))
    back = {(r.token, r.id) for r in RD.read_vocab_json(spark, os.path.join(tmp_dir, "vj")).collect()}
    assert back == {("[UNK]", 0), ("a", 1), ("##b", 2)}


def test_metric_records_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([("test", 0, 1, "deep", "auroc [deep]", 0.9, "ds", "cnn")],
                               "split string, fold int, epoch int, task string, metric string, value double, dataset string, model string")
    out = os.path.join(tmp_dir, "m")
    WR.write_metric_records(df, out)
    r = RD.read_metric_records(spark, out).first()
    assert (r.dataset, r.model, r.metric, r.value) == ("ds", "cnn", "auroc [deep]", 0.9)


def test_pair_csv_split_large_file(spark, tmp_dir):
    d = os.path.join(tmp_dir, "bigcsv")
    write(d, "a.csv", "surf.sequence,deep.sequence\n" + "".join(f"S{i},D{i}\n" for i in range(30000)))
    write(d, "b.csv", "surf.sequence,deep.sequence\nT0,E0\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32768")
    try:
        df = RD.read_pair_csv(spark, d, multiline=False)
        rows = df.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {r.row_id: r.surf_sequence for r in rows}
    assert len(rows) == 30001 and all(got[i] == f"S{i}" for i in range(30000)) and got[30000] == "T0"


def test_fasta_splittable_big_file(spark, tmp_dir):
    d = os.path.join(tmp_dir, "bigfa")
    body = "".join(f">R{i} rec {i}\n{'ACDE' * 20}\n{'KLMN' * 5}{i}\n" for i in range(3000))
    write(d, "big.fa", body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        recs = RD.read_fasta_all(spark, d, whole_files=False).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {r.rec: (r.id, r.seq) for r in recs}
    assert len(got) == 3000
    assert all(got[i] == (f"R{i}", "ACDE" * 20 + "KLMN" * 5 + str(i)) for i in range(3000))


# ---- byte ranges ----

ENDS = {"lf": "\n", "crlf": "\r\n", "cr": "\r"}


def plain_lines(data):
    return [x for x in re.split(rb"\r\n|\r|\n", data)[:-1]] + ([data.replace(b"\r", b"\n").rsplit(b"\n", 1)[-1]]
                                                              if data and data[-1:] not in b"\r\n" else [])


@pytest.mark.parametrize("seed", range(6))
def test_ranges_of_any_size_hold_every_line_once(seed):
    r = random.Random(seed)
    for _ in range(150):
        data = b"".join(r.choice([b"a", b"bc", b">", b"\n", b"\r", b"\r\n", b"\n\n", "\u00e9".encode()]) for _ in range(r.randint(0, 40)))
        size, step = len(data), r.randint(1, 9)
        got, n = [], 0
        for part in B.cut_up([("f", size)], step):
            here = []
            for offset, line in B.lines(io.BytesIO(data), part.start):
                if offset >= part.end:
                    break
                here.append(line)
            assert B.counted(io.BytesIO(data), part) == (len(here), sum(x[:1] == b">" for x in here)), (data, part)
            got += here
        assert got == plain_lines(data), data


def test_a_line_across_many_blocks(monkeypatch):
    monkeypatch.setattr(B, "_BLOCK", 7)
    data = b"ab\r\n" + b"x" * 1000 + b"\r" + b"\ny\r\rz"
    assert [x for _, x in B.lines(io.BytesIO(data), 0)] == [b"ab", b"x" * 1000, b"y", b"", b"z"]


@pytest.mark.parametrize("end", ENDS)
@pytest.mark.parametrize("split_bytes", [5, 64, 1000, None])
def test_records_in_byte_ranges(spark, tmp_dir, end, split_bytes):
    d, r = os.path.join(tmp_dir, "r"), random.Random(3)
    want, fasta = [], []
    for name in ("a.txt", "b.txt", "c.txt", "d.txt"):
        lines = ["".join(r.choice("ab c>") for _ in range(r.randint(0, 12))) + "x" for _ in range(r.randint(0, 40))]
        write(d, name, "".join(x + ENDS[end] for x in lines))
        want += [lines[i:i + 3] for i in range(0, len(lines) - len(lines) % 3, 3)]
        body, rec = [], -1
        for x in lines:
            if x.startswith(">"):
                rec += 1
                body.append([name, rec, x[1:], ""])
            elif body:
                body[-1][3] += x.replace(" ", "")
        fasta += [tuple(b) for b in body]
    got = B.load(spark, "helix_line_triples", d, split_bytes).orderBy("row_id").collect()
    assert [(x.row_id, x.line_0, x.line_1, x.line_2) for x in got] == [(i, *w) for i, w in enumerate(want)]
    got = RD.read_fasta_all(spark, d, split_bytes=split_bytes).collect()
    assert sorted((os.path.basename(x.path), x.rec, x.seq) for x in got) == sorted((n, k, s) for n, k, _, s in fasta)
    words = {(n, k): (h.split(" ")[0], h) for n, k, h, _ in fasta}
    assert all(x.id == words[os.path.basename(x.path), x.rec][0] for x in got)
    first = {os.path.basename(x.path): x.seq for x in RD.read_fasta_first(spark, d).collect()}
    assert first == {n: s for n, k, _, s in fasta if k == 0}


def test_records_are_read_without_a_shuffle_by_many_tasks(spark, tmp_dir):
    d = os.path.join(tmp_dir, "one")
    write(d, "one.fa", "".join(f">R{i} rec {i}\n{'ACDE' * 20}\n" for i in range(5000)))
    recs = RD.read_fasta_all(spark, d, split_bytes=20_000)
    assert recs.rdd.getNumPartitions() > 10
    plan = recs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert {x.rec: x.id for x in recs.collect()} == {i: f"R{i}" for i in range(5000)}


def test_first_records_stop_reading(tmp_dir):
    write(tmp_dir, "x.fa", "; note\n>A one\nMK\nT\n>B two\n" + "G" * 50_000_000)
    reader = B.FirstFastaReader({"path": tmp_dir})
    read = []

    class Counting(io.FileIO):
        def read(self, n=-1):
            got = super().read(n)
            read.append(len(got))
            return got
    with Counting(os.path.join(tmp_dir, "x.fa")) as f:
        [part] = [p for ps in reader.partitions() for p in ps.parts]
        assert [row[:3] for row, _ in reader.rows(f, part)] == [("A", "one", "MKT")]
    assert sum(read) < 3_000_000


# ---- arrays ----

def test_one_huge_array_is_read_by_many_tasks(spark, tmp_dir):
    values = np.random.default_rng(1).permutation(200_000).astype("<i4")
    np.save(os.path.join(tmp_dir, "x.npy"), values)
    df = RD.read_npy(spark, tmp_dir, split_bytes=50_000)
    assert df.rdd.getNumPartitions() >= 16
    got = df.orderBy("position").collect()
    assert [x.value for x in got] == values.tolist() and [x.position for x in got] == list(range(len(values)))


@pytest.mark.parametrize("array", [np.arange(7, dtype=">i2"), np.linspace(0, 1, 5), np.array([True, False]),
                                   np.arange(12, dtype="u1").reshape(4, 3), np.zeros((0,), "i8"),
                                   np.arange(6, dtype="f4").reshape(3, 2)])
@pytest.mark.parametrize("version", [(1, 0), (2, 0)])
def test_arrays_of_numbers(spark, tmp_dir, array, version):
    with open(os.path.join(tmp_dir, "x.npy"), "wb") as f:
        np.lib.format.write_array(f, array, version)
    got = RD.read_npy(spark, tmp_dir, split_bytes=4).orderBy("position").collect()
    assert [x.value for x in got] == array.tolist()


def test_object_arrays_are_refused(spark, tmp_dir):
    np.save(os.path.join(tmp_dir, "x.npy"), np.array([{"a": 1}], dtype=object), allow_pickle=True)
    with open(os.path.join(tmp_dir, "x.npy"), "rb") as f, pytest.raises(ValueError, match="fixed width"):
        B.npy_header(f)


def test_split_arrays_as_numpy_writes_them(spark, tmp_dir):
    for k, name in enumerate(("train", "val", "test")):
        np.save(os.path.join(tmp_dir, f"{name}_split.npy"), np.arange(k, 30, 3))
    got = {(x.repeat, x.fold, x.row_id, x.split) for x in RD.read_npy_splits(spark, tmp_dir).collect()}
    assert got == {(0, 0, i, ("train", "valid", "test")[i % 3]) for i in range(30)}


def test_split_arrays_round_trip(spark, tmp_dir):
    rows = [(i, ("train", "valid", "test")[(i + f) % 3], r, f) for i in range(60) for r in range(2) for f in range(3)]
    df = spark.createDataFrame(rows, "row_id long, split string, repeat int, fold int").repartition(5)
    out = os.path.join(tmp_dir, "npy")
    WR.write_npy_splits(df, out)
    assert {(x.row_id, x.split, x.repeat, x.fold) for x in RD.read_npy_splits(spark, out).collect()} == set(rows)
    part = np.concatenate([np.load(p) for p in glob.glob(out + "/repeat=1/fold=2/val_split-*.npy")])
    assert sorted(part.tolist()) == [i for i, s, r, f in rows if (s, r, f) == ("valid", 1, 2)]
    assert not glob.glob(out + "/_staging*")


# ---- writing in two phases ----

METRICS = "split string, fold int, epoch int, metric string, value double, dataset string, model string"


def metric_rows():
    return [(s, f, e, "auroc", e / 10 + f, "ds", m) for s in ("valid", "test") for f in range(3) for e in range(4) for m in ("cnn", "a/b")]


def test_one_file_for_each_run(spark, tmp_dir):
    out = os.path.join(tmp_dir, "runs")
    WR.write_metric_files(spark.createDataFrame(metric_rows(), METRICS).repartition(7), out)
    names = sorted(os.path.relpath(p, out) for p in glob.glob(out + "/**/*.json", recursive=True))
    assert names == sorted(f"ds/{m}_{s}_{f}.json" for m in ("cnn", "a%2Fb") for s in ("valid", "test") for f in range(3))
    back = {tuple(x) for x in spark.read.schema(METRICS).option("recursiveFileLookup", True).json(out).collect()}
    assert back == set(metric_rows())


def test_a_failed_attempt_leaves_no_file(spark, tmp_dir):
    """The staged files of an attempt that failed after writing are not moved."""
    out = os.path.join(tmp_dir, "w")
    writer = B.StagedWriter({"path": out}, "records")
    batch = pa.RecordBatch.from_pydict({"file": ["x.json", "x.json", "y.json"], "line": ["1", "2", "3"]})
    import pyspark

    class Here:
        @staticmethod
        def get():
            return Here()

        def partitionId(self):
            return 4
    real, pyspark.TaskContext = pyspark.TaskContext, Here
    try:
        writer.write(iter([batch]))                     # the attempt whose message never arrives
        kept = writer.write(iter([batch]))
    finally:
        pyspark.TaskContext = real
    assert len(glob.glob(out + "/_staging*/*")) == 2
    writer.commit([kept, None])
    assert sorted(os.listdir(out)) == ["x.json", "y.json"] and open(out + "/x.json").read() == "1\n2\n"
    with pytest.raises(FileExistsError):
        B.StagedWriter({"path": out}, "records")


def test_a_failed_job_leaves_nothing(spark, tmp_dir):
    out = os.path.join(tmp_dir, "f")
    bad = spark.range(40, numPartitions=4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("file"),
                                                  F.when(F.col("id") < 35, "ok").otherwise(F.raise_error(F.lit("no"))).alias("line"))
    with pytest.raises(Exception, match="no"):
        B.save(bad, "helix_files", out)
    assert not os.path.exists(out) or os.listdir(out) == []


def test_rows_of_one_file_in_two_tasks_are_refused(spark, tmp_dir):
    df = spark.range(4, numPartitions=2).select(F.lit("same.txt").alias("file"), F.col("id").cast("string").alias("line"))
    with pytest.raises(Exception, match="repartition"):
        B.save(df, "helix_files", os.path.join(tmp_dir, "g"))


def test_lines_end_alike_over_block_borders(monkeypatch):
    import io
    import re
    import random as rnd
    from helixframe.sources import byte_ranges
    r = rnd.Random(3)
    for block in (1, 2, 3, 7):
        monkeypatch.setattr(byte_ranges, "_BLOCK", block)
        for _ in range(60):
            data = b"".join(r.choice([b"a", b"\r", b"\n", b"\r\n", b"\x0b\x1c\xc2\x85"]) for _ in range(r.randint(0, 12)))
            cut = [0, *[m.end() for m in re.finditer(rb"\r\n|\r|\n", data)]]
            want = [(a, re.split(rb"[\r\n]", data[a:])[0]) for a in cut if a < len(data)]
            for start in {0, *cut}:
                assert list(byte_ranges.lines(io.BytesIO(data), start)) == [w for w in want if w[0] >= start], (data, start)
