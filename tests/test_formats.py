"""Data sources: blobs written once under two writers and failures, and page words read in ranges of any size."""

import os

import pyarrow as pa
import pytest

from quaestor.sources import formats, papers

BLOBS = "subject string, hash string, content binary"


def files(folder):
    return sorted(n for _, _, names in os.walk(folder) for n in names if n.endswith(".parquet"))


def read(spark, folder):
    return sorted((r["subject"], r["hash"], bytes(r["content"])) for r in spark.read.format("papers").load(folder).collect())


def test_blobs_are_written_once(spark, tmp_path):
    folder = str(tmp_path / "blobs")
    formats.write_absent(spark.createDataFrame([("s", "h1", b"1"), ("s", "h1", b"1"), ("t", "h1", b"2")], BLOBS), folder)
    there = files(folder)
    formats.write_absent(spark.createDataFrame([("s", "h1", b"other"), ("t", "h1", b"other")], BLOBS), folder)
    assert files(folder) == there and formats.version(folder) == 1
    formats.write_absent(spark.createDataFrame([("t", "h1", b"other"), ("t", "h2", b"3")], BLOBS), "file:" + folder)
    assert read(spark, folder) == [("s", "h1", b"1"), ("t", "h1", b"2"), ("t", "h2", b"3")]
    assert spark.read.format("papers").option("version", 1).load(folder).count() == 2
    formats.write_absent(spark.createDataFrame([], BLOBS), folder)
    assert formats.version(folder) == 2


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "blobs")
    formats.registered(spark)
    rows = spark.range(0, 40, 1, 4).selectExpr("'s' subject", "string(id) hash", "binary(if(id = 39, raise_error('lost'), string(id))) content")
    with pytest.raises(Exception, match="lost"):
        rows.write.format("papers").mode("append").save(folder)
    assert formats.version(folder) == 0 and not files(folder) and read(spark, folder) == []


def test_a_task_that_comes_after_an_abort_leaves_nothing(tmp_path):
    folder = str(tmp_path / "blobs")
    writer = formats.BlobWriter(folder, 0)
    row = pa.RecordBatch.from_pydict({"subject": ["s"], "hash": ["h"], "content": [b"1"]})

    def late():
        writer.abort([])
        yield row

    with pytest.raises(FileNotFoundError):
        writer.write(late())
    assert not files(folder) and formats.version(folder) == 0


def test_the_later_of_two_writers_fails_whole(spark, tmp_path):
    folder = str(tmp_path / "blobs")
    formats.registered(spark)
    one, two = (spark.createDataFrame([("s", "h", who)], BLOBS) for who in (b"one", b"two"))
    for frame in (one, two):  # both start from the empty folder
        write = frame.write.format("papers").option("version", 0).mode("append")
        if frame is one:
            write.save(folder)
        else:
            with pytest.raises(Exception):
                write.save(folder)
    assert read(spark, folder) == [("s", "h", b"one")] and len(files(folder)) == 1
    formats.write_absent(two, folder)
    assert read(spark, folder) == [("s", "h", b"one")]


@pytest.mark.parametrize("size", [5, 64, 1 << 20])
def test_ranges_of_any_size_read_each_page_once(spark, tmp_path, size):
    body = {"a.txt": "before | 1 | any\n# note\n@page 1 width=600 height=800\n50 | 700 | Größe  of it |h=12.5\n60|-3.5|x\nno words here\r\n@page 2 width=300.5 height=10\r\n1 | 2 | last", "sub/b.txt": "@page 9 width=1 height=1\n" * 3 + "0 | 0 | one", "empty.txt": ""}
    for name, text in body.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    items = formats.registered(spark).read.format("paper_items").option("bytes", size).load(str(tmp_path))
    got = sorted((r["paper_id"], r["page_no"], r["page_width"], r["seq"], r["str"], round(r["x"], 1), r["y"], round(r["width"], 1), r["height"]) for r in items.collect())
    want = spark.createDataFrame([(k, v.split("\n", 1)[1] if k == "a.txt" else v) for k, v in body.items()], "paper_id string, value string")
    same = sorted((r["paper_id"], r["page_no"], r["page_width"], r["str"], round(r["x"], 1), r["y"], round(r["width"], 1), r["height"]) for r in papers.fixture_items(want).collect())
    assert sorted(g[:3] + g[4:] for g in got) == same and len(got) == 6
    assert len({g[0::3][:2] for g in got}) == 6  # no two words of a file at one place


def test_small_ranges_make_few_tasks(spark, tmp_path):
    pages = "".join(f"@page {k} width=600 height=800\n50 | 700 | item {k}\n" for k in range(3000))
    for name in "ab":
        (tmp_path / name).write_text(pages)
    reader = formats.ItemReader(str(tmp_path), 16)
    parts = reader.partitions()
    assert len(parts) <= formats.TASKS < 2 * len(pages) / 16
    got = [(r["paper_id"], r["page_no"], r["str"]) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert got == [(name, k, word) for name in "ab" for k in range(3000) for word in ("item", str(k))]
