"""Readers by splits against one split and plain loops, the sources' writer, and meta of grids."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tagframe.functions import kinds
from tagframe.sources import formats as f
from tagframe.sources import lines

WORDS = ["plain", "with, comma", "quote \" in", "tab\there", "new\nline", "日本語", "[br", "}", "", "--- dashes", "// no comment", "a" * 300]


def entities(spark, n, seed=1):
    r = random.Random(seed)
    rows = [(f"e{i}", r.choice(WORDS), float(r.randint(-50, 50)), r.choice(["kW", None]), r.random() < 0.5) for i in range(n)]
    df = spark.createDataFrame(rows, "id string, s string, n double, u string, m boolean")
    return df.select("id", kinds.tags(id=kinds.ref(F.col("id")), text=kinds.string(F.col("s")), num=kinds.number(F.col("n"), F.col("u")), mark=F.when(F.col("m"), kinds.marker())).alias("tags"))


def shown(df):
    return sorted((r["id"], sorted(r["t"].items())) for r in df.where("id is not null").select("id", F.transform_values("tags", lambda k, v: f.zinc_encode(v)).alias("t")).collect())


@pytest.mark.parametrize("mime", [f.ZINC, f.TRIO, f.JSON4, f.JSON3])
@pytest.mark.parametrize("split", [53, 400, 1 << 20])
def test_splits_read_each_record_once(spark, tmp_path, mime, split, monkeypatch):
    e = entities(spark, 60).repartition(3).cache()
    path = str(tmp_path / "out")
    f.write(e, path, mime)
    back = f.READERS[mime](spark, path, split)
    assert shown(back) == shown(e)
    whole = f.READERS[mime](spark, path)
    key = lambda df: sorted((r["file"].rsplit("/", 1)[1], r["pos"], r["id"] or "") for r in df.select("file", "pos", "id").collect())
    assert key(back) == key(whole)


@pytest.mark.parametrize("mime", [f.ZINC, f.TRIO, f.JSON4])
def test_stores_that_only_spark_reads(spark, tmp_path, mime, monkeypatch):
    e = entities(spark, 20)
    f.write(e, str(tmp_path / "out"), mime)
    monkeypatch.setattr(lines, "openable", lambda path: False)
    assert shown(f.READERS[mime](spark, str(tmp_path / "out"))) == shown(e)


def test_heads_beyond_the_limit_come_with_the_records(spark, tmp_path, monkeypatch):
    e = entities(spark, 30).repartition(4).cache()
    f.write(e, str(tmp_path / "out"))
    monkeypatch.setattr(f, "HEADS", 10)
    assert shown(f.read_zinc(spark, str(tmp_path / "out"), 97)) == shown(e)


def test_positions_are_byte_offsets_and_tasks_many(spark, tmp_path):
    text = 'ver:"3.0"\n// c\nid,s\n' + "".join(f'@é{i},"{"x" * (i % 40)}"\r\n\n' for i in range(400)) + '@last,"no newline"'
    (tmp_path / "a.zinc").write_bytes(text.encode())
    lines.register(spark)
    df = spark.read.format("zinc").option("splitSize", 1000).load(str(tmp_path / "a.zinc"))
    assert df.rdd.getNumPartitions() == -(-len(text.encode()) // 1000)
    raw = text.encode()
    want = [(m.start(), m[0].decode().strip()) for m in re.finditer(rb"[^\n]+", raw) if m.start() > 14 and m[0].strip()][1:]
    assert sorted((r["pos"], r["text"]) for r in df.collect()) == want


def test_trio_records_by_loops(spark, tmp_path):
    r = random.Random(2)
    parts = ["\n".join(f"t{j}: {r.randint(0, 99)}" for j in range(r.randint(0, 6))) for _ in range(80)]
    text = "".join(p + "\n" + "-" * r.randint(3, 90) + "\n" for p in parts) + "tail"
    (tmp_path / "a.trio").write_text(text)
    lines.register(spark)
    for split in (7, 64, 301, 10**6):
        got = spark.read.format("trio").option("splitSize", split).load(str(tmp_path / "a.trio")).orderBy("pos").collect()
        assert [x["text"].strip("\n") for x in got] == [*(p.strip("\n") for p in parts), "tail"]


def test_json_of_one_line_or_many_is_one_record(spark, tmp_path):
    grid = {"_kind": "grid", "meta": {"dis": "all"}, "cols": [{"name": "id"}], "rows": [{"id": {"_kind": "ref", "val": f"a{i}"}, "n": i} for i in range(20)]}
    (tmp_path / "a.json").write_text(json.dumps(grid))
    (tmp_path / "b.json").write_text(json.dumps(grid, indent=2))
    rows = f.read_json4(spark, str(tmp_path / "*.json"), 50).collect()
    assert sorted(r["id"] for r in rows) == sorted(f"a{i}" for i in range(20) for _ in range(2))
    assert [(r["column"], r["tag"], r["value"]["str"]) for r in f.read_meta(spark, str(tmp_path / "a.json"), f.JSON4).collect()] == [(None, "dis", "all")]


@pytest.mark.parametrize("mime", [f.ZINC, f.JSON4, f.JSON3])
def test_meta_round_trip(spark, tmp_path, mime):
    rows = [(None, "dis", '"A grid, of \\"all\\""'), (None, "view", "M"), (None, "made", "2024-03-01T10:00:00Z UTC"), ("num", "unit", '"kW"'), ("num", "maxVal", "72.5kW"), ("mark", "hidden", "M"), ("id", "of", '@x "An X"')]
    meta = spark.createDataFrame(rows, "column string, tag string, t string").select("column", "tag", f.zinc_decode(F.col("t")).alias("value"))
    e = entities(spark, 10).coalesce(1)
    f.write(e, str(tmp_path / "out"), mime, meta)
    got = f.read_meta(spark, str(tmp_path / "out"), mime).select("column", "tag", f.zinc_encode(F.col("value")).alias("t")).distinct().collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows))
    assert shown(f.READERS[mime](spark, str(tmp_path / "out"))) == shown(e)


def test_sources_write_and_commit(spark, tmp_path):
    lines.register(spark)
    e = entities(spark, 40).repartition(3).cache()
    names = f.names_of(e)
    path = str(tmp_path / "out")
    rows = f.zinc_lines(e, names).withColumnRenamed("value", "text")
    first, _, _ = f.head_of(names, f.ZINC)
    rows.write.format("zinc").option("first", "\n".join(first)).mode("append").save(path)
    assert shown(f.read_zinc(spark, path, 100)) == shown(e)
    assert len(list((tmp_path / "out").glob("part-*.zinc"))) == 3 and not list((tmp_path / "out").glob(".part*"))
    rows.limit(5).write.format("zinc").option("first", "\n".join(first)).mode("overwrite").save(path)
    assert f.read_zinc(spark, path).count() == 5

    def broken(batches):
        yield from batches
        raise ValueError("lost")

    with pytest.raises(Exception, match="lost"):
        rows.mapInArrow(broken, "text string").write.format("zinc").mode("append").save(path)
    assert f.read_zinc(spark, path).count() == 5
    columns, before, between = f.head_of(names, f.JSON4)
    f.json_lines(e).withColumnRenamed("value", "text").write.format("json_grid").option("first", columns[0]).option("last", "]}").option("between", ",").mode("append").save(str(tmp_path / "json"))
    assert shown(f.read_json4(spark, str(tmp_path / "json"), 200)) == shown(e)
    for part in (tmp_path / "json").glob("part-*"):
        json.loads(part.read_text())


def test_no_files_and_empty_ones(spark, tmp_path):
    (tmp_path / "a.zinc").write_text("")
    (tmp_path / "b.zinc").write_text('ver:"3.0"\nempty\n')
    assert f.read_zinc(spark, str(tmp_path / "*.zinc")).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        f.read_zinc(spark, str(tmp_path / "nowhere.zinc")).collect()


@pytest.mark.parametrize("layout", ["zinc", "trio", "json_grid"])
def test_small_splits_read_little_more_than_themselves(tmp_path, layout, monkeypatch):
    """A block of megabytes for each split of 64 KB made the bytes read grow as splits times blocks."""
    n = 40_000
    texts = {
        "zinc": 'ver:"3.0"\nid,n\n' + "".join(f"@item-{i:09d},{i:09d}\n" for i in range(n)),
        "trio": "".join(f"id: @item-{i:09d}\nn: {i:09d}\n---\n" for i in range(n)),
        "json_grid": '{"meta":{},"cols":[],"rows":[\n' + ",\n".join(f'{{"id":"r:item-{i:09d}","n":"n:{i}"}}' for i in range(n)) + "\n]}\n",
    }
    path = tmp_path / "grid"
    path.write_text(texts[layout])
    read = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def seek(self, at):
            self.f.seek(at)

        def read(self, size=None):
            out = self.f.read(size)
            read.append(len(out))
            return out

    class Files:
        def open_input_file(self, at):
            return Counted(open(at, "rb"))

    reader = lines.Reader(layout, {"path": str(path), "splitsize": str(1 << 16)})
    splits = reader.partitions()
    monkeypatch.setattr(lines, "open_path", lambda uri: (Files(), uri.removeprefix("file://")))
    got = [t for s in splits for b in reader.read(s) for t in b.column(2).to_pylist()]
    assert len(splits) > 10 and sum("item-" in t for t in got) == n
    assert sum(read) < 6 * path.stat().st_size
