"""Spark data sources whose partitions are byte ranges of files (SRC-02,
SRC-03, SRC-04) and whose writers commit in two phases (SNK-02, SNK-04).

A range re-aligns to the next record by itself, so one huge file is read by
many tasks and no row is shuffled.  Where records have numbers (the third line
of a file, the second sequence), a first pass counts the line starts and
headers of each range; that table, one row a range, is written to the shared
folder and gives the second pass the number each range begins with.

Files are opened with Arrow's file systems: local and ``file:`` paths, and the
stores that ``pyarrow.fs`` knows by their URI (``hdfs://``, ``s3://``, ...).
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)

from helixframe.session import scratch_path

SPLIT_BYTES = 64 << 20
OPEN_COST = 1 << 20                                     # a file's opening costs as much as reading this much
_BLOCK = 1 << 20
_BATCH_ROWS, _BATCH_BYTES = 4096, 8 << 20
_SPACES = b" \t\n\x0b\x0c\r"


# ---- files and ranges ----

def file_system(path: str):
    """(Arrow file system, path in it)."""
    import pyarrow.fs as fs
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def files(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path, size) of the data files below ``path`` (or of the file itself) in path order;
    names that begin with ``_`` or ``.`` are no data, as in Spark."""
    import pyarrow.fs as fs
    store, base = file_system(path)
    info = store.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(base, info.size)]
    found = [(i.path, i.size) for i in store.get_file_info(fs.FileSelector(base, recursive=True))
             if i.type == fs.FileType.File and i.path.endswith(suffix)
             and not any(p[0] in "_." for p in i.path[len(base):].split("/") if p)]
    return sorted(found)


@dataclass
class Range:
    path: str
    start: int
    end: int
    size: int                                           # of the file
    first: int = 0                                      # number of the first line, record or row that starts here
    row: int = 0                                        # number of the file's first record among all files'


class Ranges(InputPartition):
    """What one task reads: a range of a large file, or several small files."""

    def __init__(self, parts: list[Range]):
        self.parts = parts


def cut_up(found: list[tuple[str, int]], split_bytes: int) -> list[Range]:
    return [Range(path, at, min(at + split_bytes, size), size) for path, size in found for at in range(0, size, split_bytes)]


def packed(parts: list[Range], split_bytes: int) -> list[Ranges]:
    """Neighbouring ranges in one partition as long as they are small."""
    out, cost = [], 0
    for part in parts:
        add = part.end - part.start + OPEN_COST
        if not out or cost + add > split_bytes + OPEN_COST:
            out.append([])
            cost = 0
        out[-1].append(part)
        cost += add
    return [Ranges(p) for p in out] or [Ranges([])]     # Spark asks for one at least


def split_size(options, found: list[tuple[str, int]]) -> int:
    """``splitBytes``, or else ``SPLIT_BYTES`` or what keeps all tasks busy."""
    if "splitbytes" in options:
        return int(options["splitbytes"])
    total = sum(size + OPEN_COST for _, size in found)
    return max(OPEN_COST, min(SPLIT_BYTES, -(-total // int(options.get("tasks", 1)))))


def lines(file, start: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its end) of every line that starts at ``start``
    or later; ``\\n``, ``\\r\\n`` and ``\\r`` end a line."""
    at = max(start - 1, 0)                              # the end of the line before tells where the first one starts
    file.seek(at)
    skip, held, block = start > 0, b"", _BLOCK
    while True:
        more = file.read(block)
        held += more
        found = held.splitlines(True)                   # bytes are split at \n, \r\n and \r alone
        held = found.pop() if more and found else b""   # may go on, or be \r before a \n
        for line in found:
            if not skip:
                yield at, line.rstrip(b"\r\n")
            skip = False
            at += len(line)
        if not more:
            return
        block = _BLOCK if found else 2 * block          # a long line is not looked through again and again


def counted(file, part: Range) -> tuple[int, int]:
    """(lines, lines that begin with ``>``) that start in the range."""
    file.seek(max(part.start - 1, 0))
    data = file.read(part.end - max(part.start - 1, 0))     # with the byte before, without need of the one after
    ends, n_lines = data[:-1], int(part.start == 0 and part.size > 0)
    n_lines += ends.count(b"\n") + ends.count(b"\r") - data.count(b"\r\n")
    headers = int(part.start == 0 and data[:1] == b">") + data.count(b"\n>") + data.count(b"\r>")
    return n_lines, headers


# ---- record readers ----

class _RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}   # Spark's options know no case

    def partitions(self) -> list[Ranges]:
        found = files(self.options["path"])
        size = split_size(self.options, found)
        return packed(self.ranges(found, size), size)

    def ranges(self, found: list[tuple[str, int]], size: int) -> list[Range]:
        return cut_up(found, size)

    def read(self, partition: Ranges) -> Iterator:
        import pyarrow as pa
        form, rows, held = self.form(), [], 0
        store, _ = file_system(self.options["path"])
        for part in partition.parts:
            with store.open_input_file(part.path) as file:
                for row, size in self.rows(file, part):
                    rows.append(row)
                    held += size
                    if len(rows) >= _BATCH_ROWS or held >= _BATCH_BYTES:
                        yield _batch(rows, form)
                        rows, held = [], 0
        if rows:
            yield _batch(rows, form)

    def form(self):
        import pyarrow as pa
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        return pa.schema([(n, kinds[k]) for n, k in (c.split(" ") for c in self.SCHEMA.split(", "))])


def _batch(rows: list[tuple], form):
    import pyarrow as pa
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), form, strict=True)], schema=form)


class CountReader(_RangeReader):
    """Lines and headers that start in each range."""
    SCHEMA = "path string, start long, end long, size long, lines long, headers long"

    def rows(self, file, part):
        yield (part.path, part.start, part.end, part.size, *counted(file, part)), 0


class _NumberedReader(_RangeReader):
    """Ranges come from the table that :class:`CountReader` gave."""
    COUNT = "lines"

    def ranges(self, found, size):
        import pyarrow.parquet as pq
        store, base = file_system(self.options["counts"])
        got = pq.read_table(base, filesystem=store).to_pylist() if files(self.options["counts"], ".parquet") else []
        out, path, first, row = [], None, 0, 0
        for r in sorted(got, key=lambda r: (r["path"], r["start"])):
            if r["path"] != path:
                row += self.records(first) if path is not None else 0
                path, first = r["path"], 0
            out.append(Range(path, r["start"], r["end"], r["size"], first, row))
            first += r[self.COUNT]
        return out

    def records(self, n: int) -> int:
        return n


class LineTripleReader(_NumberedReader):
    """Lines 3k, 3k + 1 and 3k + 2 of a file as one row."""
    SCHEMA = "row_id long, line_0 string, line_1 string, line_2 string"

    @property
    def partial(self) -> bool:
        return self.options.get("keeppartial") == "true"

    def records(self, n):
        return -(-n // 3) if self.partial else n // 3

    def rows(self, file, part):
        number, record = part.first, []
        for offset, line in lines(file, part.start):
            if number % 3 == 0 and offset >= part.end:
                return
            if record or number % 3 == 0:
                record.append(line.decode("utf-8", "replace"))
            number += 1
            if len(record) == 3:
                yield (part.row + number // 3 - 1, *record), sum(map(len, record))
                record = []
        if record and self.partial:
            yield (part.row + number // 3, *record, *[None] * (3 - len(record))), 0


class FastaReader(_NumberedReader):
    """Records that begin with a ``>`` line in a range; a record's other lines
    may lie beyond it."""
    SCHEMA = "id string, description string, seq string, path string, rec int"
    COUNT = "headers"

    def rows(self, file, part):
        head, body, rec = None, [], part.first
        for offset, line in lines(file, part.start):
            if line[:1] == b">":
                if head is not None:
                    yield self.record(head, body, part.path, rec)
                    rec += 1
                if offset >= part.end or rec >= self.most:
                    return
                head, body = line, []
            elif head is not None:
                body.append(line.translate(None, _SPACES))
            elif offset >= part.end:
                return
        if head is not None:
            yield self.record(head, body, part.path, rec)

    most = 1 << 62

    def record(self, head: bytes, body: list[bytes], path: str, rec: int):
        name, _, rest = re.match(r"([^ \t\n\x0b\x0c\r]*)([ \t\n\x0b\x0c\r]*)(.*)", head[1:].decode("utf-8", "replace"), re.S).groups()
        seq = b"".join(body).decode("utf-8", "replace")
        return (name, rest.strip(" "), seq, path, rec), len(seq)


class FirstFastaReader(FastaReader):
    """The first record of each file: reading stops at the second header."""
    most = 1

    def ranges(self, found, size):
        return [Range(path, 0, n, n) for path, n in found if n]

    def partitions(self):
        # how much of a file is read is not known: a few files a task
        parts = self.ranges(files(self.options["path"]), 0)
        each = max(1, -(-len(parts) // max(1, int(self.options.get("tasks", 1)) * 4)))
        return [Ranges(parts[at:at + each]) for at in range(0, len(parts), each)] or [Ranges([])]


# ---- .npy arrays ----

def npy_header(file) -> tuple[str, tuple[int, ...], int]:
    """(dtype, shape, offset of the data) of an open ``.npy`` file.  The header
    is a literal; nothing in the file is executed, and arrays of Python objects
    (which only unpickling could read) are refused."""
    import ast
    start = file.read(12)
    if start[:6] != b"\x93NUMPY" or start[6] not in (1, 2, 3):
        raise ValueError("not a .npy file")
    wide = 4 if start[6] > 1 else 2
    length = int.from_bytes(start[8:8 + wide], "little")
    file.seek(8 + wide)
    head = ast.literal_eval(file.read(length).decode("utf-8" if start[6] == 3 else "latin-1"))
    descr, shape = head["descr"], tuple(head["shape"])
    if not isinstance(descr, str) or not re.fullmatch(r"[<>|=][iufb]\d+", descr):
        raise ValueError(f"arrays of {descr!r} are not read; numbers of a fixed width are")
    if head["fortran_order"] and len(shape) > 1 or not 1 <= len(shape) <= 2:
        raise ValueError("one-dimensional arrays and tables in row order are read")
    return descr, shape, 8 + wide + length


class NpyReader(_RangeReader):
    """Rows of ``.npy`` arrays, a range of rows a task."""

    def ranges(self, found, size):
        import numpy as np
        store, _ = file_system(self.options["path"])
        out = []
        for path, _ in found:
            with store.open_input_file(path) as file:
                descr, shape, offset = npy_header(file)
            width = np.dtype(descr).itemsize * (shape[1] if len(shape) == 2 else 1)
            step = max(1, size // max(1, width))
            out += [Range(path, offset + a * width, offset + min(a + step, shape[0]) * width, shape[0], a)
                    for a in range(0, shape[0], step)]
        return out

    def partitions(self):
        found = files(self.options["path"], ".npy")
        size = split_size(self.options, found)
        return packed(self.ranges(found, size), size)

    def read(self, partition):
        import numpy as np
        import pyarrow as pa
        store, _ = file_system(self.options["path"])
        for part in partition.parts:
            with store.open_input_file(part.path) as file:
                descr, shape, _ = npy_header(file)
                wide = shape[1] if len(shape) == 2 else 1
                kind, step = np.dtype(descr), max(1, _BATCH_BYTES // (np.dtype(descr).itemsize * max(1, wide)))
                width = kind.itemsize * wide
                for at in range(part.start, part.end, step * width):
                    file.seek(at)
                    got = np.frombuffer(file.read(min(step * width, part.end - at)), kind)
                    got = got.astype({"f": "f8", "b": "?"}.get(kind.kind, "i8"))
                    n = len(got) // wide
                    first = part.first + (at - part.start) // width
                    value = pa.array(got)
                    if len(shape) == 2:
                        value = pa.FixedSizeListArray.from_arrays(value, wide).cast(pa.list_(value.type))
                    yield pa.RecordBatch.from_arrays([pa.array([part.path] * n, pa.string()), pa.array(np.arange(first, first + n)),
                                                      value], ["path", "position", "value"])


# ---- writers in two phases ----

@dataclass
class Staged(WriterCommitMessage):
    """What one successful task wrote: (name while staged, final name)."""
    moves: list[tuple[str, str]]


class StagedWriter(DataSourceArrowWriter):
    """Every task writes into a folder of its own below ``_staging``; only the
    files of the tasks that the job counts are moved to their names, by the
    driver, when all have succeeded.  A task that is run again, or twice at
    the same time, leaves no second file, and a failed job leaves none."""

    def __init__(self, options: dict, kind: str):
        import uuid
        self.path, self.kind, self.options = options["path"], kind, dict(options)
        self.job = uuid.uuid4().hex
        store, base = file_system(self.path)
        if self.exists(store, base):
            raise FileExistsError(f"{self.path} exists")

    @staticmethod
    def exists(store, base) -> bool:
        import pyarrow.fs as fs
        return store.get_file_info(base).type != fs.FileType.NotFound

    def write(self, iterator) -> Staged:
        import uuid

        from pyspark import TaskContext
        store, base = file_system(self.path)
        task = TaskContext.get().partitionId()
        mine = f"{base}/_staging-{self.job}/{task:05d}-{uuid.uuid4().hex}"
        store.create_dir(mine, recursive=True)
        content = npy_files if self.kind == "npy" else record_files
        moves = []
        for k, (name, data) in enumerate(content(iterator, task)):
            with store.open_output_stream(f"{mine}/{k:05d}") as out:
                out.write(data)
            moves.append((f"{mine}/{k:05d}", f"{base}/{name}"))
        return Staged(moves)

    def commit(self, messages) -> None:
        store, base = file_system(self.path)
        moves = [m for message in messages if message for m in message.moves]
        names = [final for _, final in moves]
        if len(set(names)) < len(names):
            raise ValueError("several tasks hold rows of one file: repartition by the file's columns first")
        store.create_dir(base, recursive=True)
        for staged, final in moves:
            store.create_dir(final.rpartition("/")[0], recursive=True)
            store.move(staged, final)
        self.clean(store, base)

    def abort(self, messages) -> None:
        store, base = file_system(self.path)
        self.clean(store, base)

    def clean(self, store, base) -> None:
        if self.exists(store, f"{base}/_staging-{self.job}"):
            store.delete_dir(f"{base}/_staging-{self.job}")


def npy_files(batches, task: int) -> Iterator[tuple[str, bytes]]:
    """Positions by (repeat, fold, split) as one array a task and file."""
    import io
    from collections import defaultdict

    import numpy as np
    held = defaultdict(list)
    for batch in batches:
        columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        where = list(zip(*[columns[c].to_pylist() for c in ("repeat", "fold", "split")], strict=True))
        rows = columns["row_id"].to_numpy(zero_copy_only=False)
        number = {w: k for k, w in enumerate(dict.fromkeys(where))}
        of = np.fromiter((number[w] for w in where), "i8", len(where))
        for w, k in number.items():
            held[w].append(rows[of == k].astype("<i8"))
    for (repeat, fold, split), parts in held.items():
        out = io.BytesIO()
        np.save(out, np.concatenate(parts), allow_pickle=False)
        yield f"repeat={repeat}/fold={fold}/{split}_split-{task:05d}.npy", out.getvalue()


def record_files(batches, task: int) -> Iterator[tuple[str, bytes]]:
    """Rows of (file, line): the lines of each file in the order they come."""
    held: dict[str, list[str]] = {}
    for batch in batches:
        for name, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(name, []).append(line)
    for name, got in held.items():
        yield name, "".join(x + "\n" for x in got).encode()


# ---- the sources ----

def _source(short_name: str, reader_class, schema: str) -> type:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return short_name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return reader_class(self.options)

    Source.__name__ = Source.__qualname__ = short_name
    return Source


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "helix_npy"

    def schema(self) -> str:
        """By the first file's header."""
        value = "long"
        for path, _ in files(self.options["path"], ".npy")[:1]:
            with file_system(self.options["path"])[0].open_input_file(path) as file:
                descr, shape, _ = npy_header(file)
            value = {"f": "double", "b": "boolean"}.get(descr[1], "long")
            value = f"array<{value}>" if len(shape) == 2 else value
        return f"path string, position long, value {value}"

    def reader(self, schema) -> DataSourceReader:
        return NpyReader(self.options)

    def writer(self, schema, overwrite):
        return StagedWriter(self.options, "npy")


class FilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "helix_files"

    def schema(self) -> str:
        return "file string, line string"

    def writer(self, schema, overwrite):
        return StagedWriter(self.options, "records")


SOURCES = [
    _source("helix_counts", CountReader, CountReader.SCHEMA),
    _source("helix_line_triples", LineTripleReader, LineTripleReader.SCHEMA),
    _source("helix_fasta", FastaReader, FastaReader.SCHEMA),
    _source("helix_fasta_first", FirstFastaReader, FastaReader.SCHEMA),
    NpySource,
    FilesSource,
]


def load(spark: SparkSession, name: str, path: str, split_bytes: int | None = None, **options) -> DataFrame:
    """A table from one of ``SOURCES``; those that need counts get them."""
    for source in SOURCES:
        spark.dataSource.register(source)
    options |= {"tasks": spark.sparkContext.defaultParallelism}
    if split_bytes:
        options["splitBytes"] = split_bytes
    if name in ("helix_line_triples", "helix_fasta"):
        options["counts"] = scratch_path(spark, "range-counts")
        (spark.read.format("helix_counts").options(**{k: str(v) for k, v in options.items()}).load(path)
         .write.parquet(options["counts"]))
    return spark.read.format(name).options(**{k: str(v) for k, v in options.items()}).load(path)


def save(df: DataFrame, name: str, path: str) -> None:
    for source in SOURCES:
        df.sparkSession.dataSource.register(source)
    df.write.format(name).mode("append").save(path)
