"""Data sources: `papers`, blobs that are written once, and `paper_items`, words of pages from layout fixture files.

Both read and write files of a folder that driver and executors have mounted. `papers` keeps a log beside its files: a write
puts a file for each task into a folder of its own and, when all are done, adds one log entry that names them. An entry can be made
by one writer only, so of two that started from the same version the later one fails whole and leaves nothing; readers
see only files that the log names. The driver handles file names, one for each task.

`paper_items` cuts files into ranges of `bytes`: a page belongs to the range in which its page line begins, so large files are read
by many tasks. A task takes ranges one after another, of any files, so that a folder makes at most TASKS of them however small its
ranges are. Lines before the first page line, comments and lines that place no words are passed over.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quaestor.operators import tables
from quaestor.sources import papers

BLOBS = "subject string, hash string, content binary"
ITEMS = "paper_id string, page_no int, page_width double, seq long, str string, x double, y double, width double, height double"
RANGE, BATCH, TASKS = 32 << 20, 8192, 256


NAMES = [c.split()[0] for c in ITEMS.split(", ")]
KINDS = [pa.int32(), pa.float64(), pa.int64(), pa.string(), *[pa.float64()] * 4]  # of all but the first
PAGE, CELL, HEIGHT, HEIGHTS = re.compile(papers.PAGE).match, re.compile(papers.CELL).match, re.compile(papers.HEIGHT).search, re.compile(papers.HEIGHT).sub


def local(path: str) -> str:
    return re.sub("^file:(//)?(?=/)", "", path)


def version(folder: str) -> int:
    """The number of writes that the folder's log holds."""
    log = os.path.join(local(folder), "_log")
    return max(map(int, (n for n in os.listdir(log) if n.isdigit())), default=0) if os.path.isdir(log) else 0


@dataclass
class Part(InputPartition):
    path: str | None
    start: int = 0
    end: int = 0


@dataclass
class Parts(InputPartition):
    """(path, from, to): `size` bytes at a time from `from` to the last range that begins before `to`."""

    spans: list[tuple[str, int, int]]


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class BlobReader(DataSourceReader):
    def __init__(self, folder: str, upto: int):
        self.folder, self.upto = folder, upto

    def partitions(self) -> list[Part]:
        found = []
        for n in range(1, self.upto + 1):
            with open(os.path.join(self.folder, "_log", str(n))) as log:
                found += [Part(os.path.join(self.folder, line.strip())) for line in log]
        return found or [Part(None)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.path:
            yield from pq.ParquetFile(part.path).iter_batches(256)


class BlobWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, base: int):
        self.folder, self.base, self.job = folder, base, f"data-{uuid.uuid4().hex}"
        os.makedirs(os.path.join(folder, self.job))  # by the driver, once: tasks make none

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        path, out = os.path.join(self.job, f"{uuid.uuid4().hex}.parquet"), None
        for batch in batches:
            if batch.num_rows:
                if out is None:  # fails in the task that comes after an abort, which has taken the folder away
                    out = pq.ParquetWriter(os.path.join(self.folder, path), batch.schema)
                out.write_batch(batch)
        if out is None:
            return Written(None)
        out.close()
        return Written(path)

    def commit(self, messages: list[Written | None]) -> None:
        paths = [m.path for m in messages if m is not None and m.path]
        job = os.path.join(self.folder, self.job)
        if not paths:
            return self.abort(messages)
        kept = {os.path.basename(p) for p in paths}
        for name in os.listdir(job):  # of attempts that did not count
            if name not in kept:
                os.remove(os.path.join(job, name))
        entry = os.path.join(job, "entry")
        with open(entry, "w") as log:
            log.write("\n".join(paths))
        os.makedirs(os.path.join(self.folder, "_log"), exist_ok=True)
        os.link(entry, os.path.join(self.folder, "_log", str(self.base + 1)))  # fails if another writer was first
        os.remove(entry)

    def abort(self, messages: list[Written | None]) -> None:
        job = os.path.join(self.folder, self.job)
        if os.path.isdir(job):
            os.rename(job, f"{job}-aborted")  # tasks that are still at work can add no file to it
            shutil.rmtree(f"{job}-aborted", ignore_errors=True)


class Papers(DataSource):
    """Blobs by subject and hash; option `version` reads the folder as of, or writes it from, an entry of its log."""

    @classmethod
    def name(cls) -> str:
        return "papers"

    def schema(self) -> str:
        return BLOBS

    def at(self) -> tuple[str, int]:
        folder = local(self.options["path"])
        return folder, int(self.options.get("version", version(folder)))

    def reader(self, schema) -> BlobReader:
        return BlobReader(*self.at())

    def writer(self, schema, overwrite: bool) -> BlobWriter:
        if overwrite:
            raise ValueError("blobs are written once: use mode append")
        return BlobWriter(*self.at())


class ItemReader(DataSourceReader):
    def __init__(self, folder: str, size: int):
        self.folder, self.size = folder, size

    def partitions(self) -> list[Parts]:
        files = sorted(os.path.join(at, n) for at, _, names in os.walk(self.folder) for n in names if not n.startswith((".", "_")))
        counts = [(f, -(-os.path.getsize(f) // self.size)) for f in files]  # ranges of each
        most = max(1, -(-sum(n for _, n in counts) // TASKS))
        out, room = [], 0
        for path, n in counts:
            k = 0
            while k < n:
                if not room:
                    out.append(Parts([]))
                    room = most
                take = min(room, n - k)
                out[-1].spans.append((path, k * self.size, (k + take) * self.size))
                k, room = k + take, room - take
        return out or [Parts([])]

    def read(self, part: Parts) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in KINDS]
        for path, start, end in part.spans:
            paper = os.path.relpath(path, self.folder)
            for _ in self.words(path, start, end, columns):
                if len(columns[0]) >= BATCH:
                    yield self.batch(paper, columns)
            if columns[0]:
                yield self.batch(paper, columns)

    @staticmethod
    def batch(paper: str, columns: list[list]) -> pa.RecordBatch:
        n = len(columns[0])
        out = pa.RecordBatch.from_arrays([pa.array([paper] * n, pa.string()), *[pa.array(c, t) for c, t in zip(columns, KINDS)]], NAMES)
        for c in columns:
            c.clear()
        return out

    def words(self, path: str, start: int, end: int, columns: list[list]) -> Iterator[None]:
        """Puts words with their places into columns, and stops after each line; a word's seq is its offset in the file.

        Ranges that a task takes in turn are read in one go: a range ends where the next begins, so what is between is read once.
        """
        pages, widths, seqs, strs, xs, ys, wides, highs = (c.extend for c in columns)
        page, char = None, papers.CHAR
        with open(path, "rb") as file:
            if start:  # to the first line that begins in the range
                file.seek(start - 1)
                file.readline()
            at = file.tell()
            for raw in file:
                begins, at = at, at + len(raw)
                line = raw.decode("utf-8", "replace").strip()
                if line.startswith("@") and (head := PAGE(line)):
                    if begins >= end:
                        return
                    page = int(head[1]), float(head[2])
                elif page is None and begins >= end:
                    return
                elif page and not line.startswith("#") and (cell := CELL(line)):
                    x, y, body = float(cell[1]), float(cell[2]), cell[3]
                    high = HEIGHT(body) if "|h=" in body else None
                    words, places = [], []
                    for i, word in enumerate((HEIGHTS("", body) if high else body).split(" ")):
                        if word:
                            words.append(word)
                            places.append(x)
                            seqs((begins + i,))
                        x += (len(word) + 1) * char
                    n = len(words)
                    pages([page[0]] * n), widths([page[1]] * n), strs(words), xs(places), ys([y] * n), wides([len(w) * char for w in words])
                    highs([float(high[1]) if high else papers.GLYPH] * n)
                    yield


class PaperItems(DataSource):
    """Items of the fixture files under a folder; option `bytes` is the size of a range."""

    @classmethod
    def name(cls) -> str:
        return "paper_items"

    def schema(self) -> str:
        return ITEMS

    def reader(self, schema) -> ItemReader:
        return ItemReader(local(self.options["path"]), int(self.options.get("bytes", RANGE)))


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(Papers)
    spark.dataSource.register(PaperItems)
    return spark


def write_absent(blobs: DataFrame, folder: str, tries: int = 10) -> None:
    """Writes the blobs whose subject and hash the folder lacks, of equal keys one; keys are not null.

    Another writer that was first is seen by the log: what is missing is then worked out again.
    """
    spark = registered(blobs.sparkSession)
    for left in reversed(range(tries)):
        base = version(folder)
        there = spark.read.format("papers").option("version", base).load(folder)
        try:
            tables.absent(blobs, there, ["subject", "hash"]).select("subject", "hash", "content").write.format("papers").option("version", base).mode("append").save(folder)
            return
        except Exception:
            if version(folder) == base or not left:
                raise
