"""One backup document read and written in parts."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lumenlake.operators import export
from lumenlake.session import checkpoint_dir, drop_table
from lumenlake.sources import backup, document


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "300")
    spark.conf.set(names[1], "0")
    yield
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def _word(draw):
    return "".join(draw.choice('ab{}[]",\\ü\n:') for _ in range(draw.randrange(12)))


def _value(draw, depth=0):
    kind = draw.randrange(7 if depth < 3 else 5)
    if kind == 5:
        return [_value(draw, depth + 1) for _ in range(draw.randrange(3))]
    if kind == 6:
        return {_word(draw): _value(draw, depth + 1) for _ in range(draw.randrange(3))}
    return [draw.randrange(9), _word(draw), None, True, {"path": _word(draw), "tags": [_word(draw), _word(draw)]}][kind]


def _rows(records):
    return [json.loads(r["j"]) for r in records.selectExpr("position", "to_json(record) AS j").orderBy("position").collect()]


@pytest.mark.parametrize("seed, images, indent", [(1, 60, None), (2, 1, 1), (3, 0, None), (4, None, 2)])
def test_any_document_gives_the_entries_of_its_arrays(spark, small_splits, tmp_path, seed, images, indent):
    draw = random.Random(seed)
    content = {"format_version": 1, "x": _value(draw), "images": "no" if images is None else [_value(draw) for _ in range(images)],
               "y": {"a": {"b": {}}, "c": [{}, {}]}, "tags": [{"name": _word(draw), "order": i} for i in range(seed - 1)]}
    path = tmp_path / "d.json"
    path.write_text(json.dumps(content, ensure_ascii=seed % 2 == 0, indent=indent))
    got = document.split_document(spark, str(path))
    assert _rows(got.images) == (content["images"] if images is not None else [])
    assert _rows(got.tags) == content["tags"]
    assert json.loads(got.header.selectExpr("to_json(format_version) AS j").first()["j"]) == 1


@pytest.mark.parametrize("text", ["", "[]", '{"images":[{"a":1} {"b":2},{}]}', '{"images":[{"a":1},{"b":2}', '{"images":[{},{}]} x', '{"images":[{},{},]}'])
def test_broken_documents_are_refused(spark, tmp_path, text):
    path = tmp_path / "d.json"
    path.write_text(text)
    with pytest.raises(Exception):
        backup.read_backup(spark, str(path))[0].collect()


@pytest.mark.parametrize("images, tags", [(50, 3), (0, 2), (2, 0), (0, 0)])
def test_written_document_is_one_json_text_and_reads_back(spark, tmp_path, images, tags):
    rows = [(i % 3, f"set_{i % 3 + 1}/}}\"é{i}.png", "a" * 40, "2026-01-01T00:00:00Z", "2026-01-01T00:00:00Z", ["t0"], None) for i in range(images)]
    entries = spark.createDataFrame(rows, "set_index int, path string, hash string, imported_at string, modification_date string, tags array<string>, text_in_image string")
    listed = spark.createDataFrame([(f"t{i}", "#102030", i, None, True, i) for i in range(tags)],
                                   "name string, rgb string, `order` int, description string, enabled boolean, position long")
    document.write_document(entries, listed, f"{tmp_path}/b", "2026-01-01T00:00:00Z", parts=4)
    whole = json.loads("".join(p.read_text() for p in sorted((tmp_path / "b").glob("part-*"))))
    assert whole["exported_at"] == "2026-01-01T00:00:00Z"
    assert [e["path"] for e in whole["images"]] == [r[1] for r in sorted(rows)]
    assert [t["name"] for t in whole["tags"]] == [f"t{i}" for i in range(tags)]
    got_images, got_tags = backup.read_backup(spark, f"{tmp_path}/b")
    assert [tuple(r) for r in got_images.orderBy("position").select("position", "path").collect()] == list(enumerate(r[1] for r in sorted(rows)))
    assert [tuple(r) for r in got_tags.orderBy("position").select("position", "name").collect()] == [(i, f"t{i}") for i in range(tags)]


def _bytes_under(folder, begin=""):
    return sum(os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(folder.removeprefix("file://")) for n in names if n.startswith(begin))


def _disk(spark):
    """Bytes of the checkpoint folder and of shuffle files."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return _bytes_under(checkpoint_dir(spark)), sum(_bytes_under(str(d), "shuffle_") for d in blocks)


@pytest.fixture
def long_texts(spark, tmp_path):
    """Images with 3 MB of text that hardly compresses; the table is read from a file."""
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(25)), lambda i: F.sha2(F.concat_ws("-", "id", i).cast("binary"), 256)), " ")
    rows = spark.range(0, 2000, 1, 4).withColumn("original_file_name", F.concat(F.lit("a"), F.col("id") % 7, F.lit(".png"))).withColumn("hash", F.sha1("original_file_name"))
    rows.withColumn("text_in_image", words).write.parquet(f"{tmp_path}/images")
    return spark.read.parquet(f"{tmp_path}/images")


def test_sets_are_dealt_without_writing_the_texts(spark, long_texts):
    checkpoints, shuffles = _disk(spark)
    planned = export.assign_sets(long_texts, max_files_per_set=10)
    after = _disk(spark)
    assert after[0] - checkpoints < 1_000_000
    assert after[1] <= shuffles
    assert sorted(r["n"] for r in planned.groupBy("set_index").agg(F.count("text_in_image").alias("n")).collect()) == [6] * 2 + [7] * 284


def test_a_document_takes_one_compressed_copy_beside_it(spark, long_texts, tmp_path):
    entries = long_texts.select(
        (F.col("id") % 9).alias("set_index"), F.concat(F.lit("set_"), F.col("id") % 9 + 1, F.lit("/"), "id", F.lit(".png")).alias("path"), F.sha1(F.lit("a")).alias("hash"),
        F.lit("2026-01-01T00:00:00Z").alias("imported_at"), F.lit("2026-01-01T00:00:00Z").alias("modification_date"), F.array(F.lit("t0")).alias("tags"), "text_in_image")
    listed = spark.createDataFrame([("t0", "#102030", 0, None, True, 0)], "name string, rgb string, `order` int, description string, enabled boolean, position long")
    checkpoints, shuffles = _disk(spark)
    document.write_document(entries, listed, f"{tmp_path}/b", "2026-01-01T00:00:00Z", parts=4)
    written = _disk(spark)
    # Nothing but the order of the tags is left.
    assert written[0] - checkpoints < 100_000
    assert written[1] <= shuffles
    got = document.split_document(spark, f"{tmp_path}/b")
    read = _disk(spark)
    assert read[0] - written[0] < 0.8 * _bytes_under(f"{tmp_path}/b", "part-")
    assert read[1] - written[1] < 100_000
    found = got.images.select("position", F.expr("variant_get(record, '$.path', 'string') AS path"), F.expr("length(variant_get(record, '$.text_in_image', 'string')) AS n"))
    want = sorted((f"set_{i % 9 + 1}/{i}.png" for i in range(2000)), key=lambda p: (int(p[4]), p))
    assert [tuple(r) for r in found.orderBy("position").collect()] == [(i, p, 25 * 65 - 1) for i, p in enumerate(want)]
    drop_table(spark, got.table)


def test_rows_that_share_an_id_or_have_none_get_numbers_of_their_own(spark):
    rows = [(1, "a.png", "x"), (1, "b.png", "y"), (1, "a.png", "z"), (None, "a.png", "x"), (None, "c.png", "x"), (2, "a.png", None)]
    planned = export.assign_sets(spark.createDataFrame(rows, "id long, original_file_name string, hash string"), 2).collect()
    assert sorted(map(str, rows)) == sorted(str((r["id"], r["original_file_name"], r["hash"])) for r in planned)
    assert sorted(r["relative_path"] for r in planned) == ["set_1/a.png", "set_1/b.png", "set_2/a.png", "set_2/c.png", "set_3/a.png", "set_4/a.png"]


def test_splits_that_changed_between_the_two_reads_are_refused():
    import pyarrow as pa

    def batches(starts):
        columns = [['{"images":[{"a":1', ',{"a":2', '],"tags":['], ["f"] * 3, starts, [40] * 3]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["value", "file", "start", "size"])

    sums = [r for b in document._sums(batches([0, 20, 20])) for r in b.to_pylist()]
    begun = document._starts(sums)
    assert sum(b.num_rows for b in document._pieces(begun)(batches([0, 20, 20]))) == 3
    for starts in ([0, 0, 20], [0, 20, 30], [0, 0, 0]):
        with pytest.raises(ValueError, match="splits"):
            list(document._pieces(begun)(batches(starts)))
