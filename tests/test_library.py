"""Names, formats, import, merge, table changes, maintenance, export, enrichment, streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lumenlake.functions import names, text
from lumenlake.functions import vectors as vec
from lumenlake.operators import enrich, export, ingest, maintain, merge, tables
from lumenlake.sources import backup, files
from lumenlake.streaming import history as history_stream
from lumenlake.streaming import imports as import_stream

PNG = b"\x89PNG\r\n\x1a\n" + b"0" * 8


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("name, extension, expected", [
    ("新名字.gif", ".png", "新名字.gif.png"), ("cat.  . ", ".png", "cat.png"), (".png", ".png", None), ("Cat.PNG", ".png", "Cat.png"),
    ("　a b ", ".png", "a b.png"), ("..", ".png", None), ("a/b", ".png", None), ("a\\b", ".png", None), ("  ", ".png", None), ("cat", ".JPG", "cat.JPG"),
])
def test_file_names(spark, name, extension, expected):
    assert one(spark, names.normalised_file_name("n", "e"), n=name, e=extension) == expected


@pytest.mark.parametrize("blocks, expected", [
    ([("a", .80)], None), ([("a", .81)], "[OCR]a"), ([("你好", .9), ("世界", .9)], "[OCR]你好世界"), ([("Hello", .9), (" World ", .9)], "[OCR]Hello World"),
    ([("你好", .9), ("world", .9)], "[OCR]你好world"), ([("x" * 4001, .9)], "[OCR]" + "x" * 4000), ([(" ", .9), ("가", .9), ("カ", .9), ("b", .1)], "[OCR]가カ"), ([], None),
])
def test_compose_text(spark, blocks, expected):
    frame = spark.createDataFrame([(blocks,)], "b array<struct<text:string,score:double>>")
    assert frame.select(text.compose_text("b")).first()[0] == expected


@pytest.mark.parametrize("content, fmt, extension", [
    (PNG, "PNG", ".png"), (b"\xff\xd8\xff\xe0", "JPEG", ".jpg"), (b"GIF89a..", "GIF", ".gif"), (b"BM", "BMP", ".bmp"), (b"MM\x00*", "TIFF", ".tif"),
    (b"\x00\x00\x00\x1cftypavif....", "AVIF", ".avif"), (b"\x00\x00\x00\x18ftypheic", "HEIC", ".heic"), (b"\x00\x00\x00\x18ftypmif1", "HEIF", ".heif"),
    (b"\x00\x00\x00\x0cjP  \r\n\x87\n", "JPEG2000", ".jp2"), (b"\x00\x00\x00\x18ftypmp42", None, None), (b"\x00\x00\x00\x18ftyp", None, None),
    (b"RIFF0000WEBPx", "WEBP", ".webp"), (b"RIFF0000WEB", None, None), (b"", None, None), (b"text", None, None),
])
def test_formats(spark, content, fmt, extension):
    frame = spark.createDataFrame([(bytearray(content),)], "c binary")
    f = names.image_format("c")
    assert tuple(frame.select(f, names.format_extension(f)).first()) == (fmt, extension)


@pytest.mark.parametrize("content, size", [
    (b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR\x00\x01\x00\x02\x00\x00\x00\x05", (65538, 5)), (b"GIF87a\x02\x01\x03\x00", (258, 3)),
    (b"BM" + bytes(16) + b"\x07\x00\x00\x00\xfe\xff\xff\xff", (7, 2)), (b"GIF89a\x02", (None, None)), (b"\xff\xd8\xff", (None, None)), (b"", (None, None)),
])
def test_sizes(spark, content, size):
    frame = spark.createDataFrame([(bytearray(content),)], "c binary")
    assert tuple(frame.select(names.image_size("c", names.image_format("c")).alias("s")).select("s.*").first()) == size


def test_scalar_rules(spark):
    assert one(spark, names.extension_override("e"), e=" .PnG ") == ".png"
    assert [one(spark, names.extension_override("e"), e=e) for e in (".", "png", ".a b", ".-")] == [None] * 4
    assert one(spark, text.collision_key("t"), t="Straßé".replace("é", "é")) == "strassé"
    assert one(spark, text.collision_key("t"), t="Café.PNG") == "café.png"
    assert one(spark, names.from_iso8601("t", "Asia/Shanghai"), t="2026-01-01T00:00:00Z") == dt.datetime(2026, 1, 1, 8)
    assert one(spark, names.from_iso8601("t", "Asia/Shanghai"), t="2026-01-01T00:00:00") == dt.datetime(2026, 1, 1)
    assert one(spark, names.from_iso8601("t"), t="yesterday") is None
    assert one(spark, names.is_set_path("p"), p="set_10/a.png") and not one(spark, names.is_set_path("p"), p="set_0/a.png")
    assert not one(spark, names.is_set_path("p"), p="set_1/..")
    digest = "0123456789abcdef" * 2 + "01234567"
    assert one(spark, vec.sidecar_model_hash("t"), t=f"﻿sha1: {digest.upper()} model.onnx") == digest[:16]
    assert one(spark, vec.sidecar_model_hash("t"), t="0123456789ABCDEF model") == "0123456789abcdef"
    assert one(spark, vec.sidecar_model_hash("t"), t="nothing") is None


def test_files_and_blobs(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.PNG").write_bytes(PNG)
    (tmp_path / "a.jpg").write_bytes(b"not an image")
    (tmp_path / "sub" / "c.webp").write_bytes(PNG)
    (tmp_path / "note.txt").write_bytes(b"x")
    found = [r["path"].rsplit("/", 1)[1] for r in files.discover_images(spark, [str(tmp_path)], [str(tmp_path / "note.txt"), str(tmp_path / "b.PNG")]).collect()]
    assert found == ["a.jpg", "b.PNG", "note.txt", "c.webp"]
    scanned = {r["original_file_name"]: (r["extension"], r["error"] is None) for r in files.scan_folder(spark, str(tmp_path)).collect()}
    assert scanned == {"a.jpg": (None, False), "b.PNG": (".png", True)}
    digest = "ab" + "0" * 38
    store = tmp_path / "store"
    for folder, name in (("ab", f"{digest}.png"), ("cd", f"{digest}.png"), ("ab", "short.png"), ("ab", digest), ("AB", f"{digest}.gif")):
        (store / folder).mkdir(parents=True, exist_ok=True)
        (store / folder / name).write_bytes(b"x")
    assert [(r["hash"], r["extension"]) for r in files.stored_blobs(spark, str(store)).collect()] == [(digest, ".png")]


@pytest.fixture
def library(spark):
    images = spark.createDataFrame([(1, "h1", "a.png"), (2, "h2", "b.png")], "id long, hash string, original_file_name string")
    tags = spark.createDataFrame([(1, "X", 4, True), (2, "Y", 0, True)], "id long, name string, order int, enabled boolean")
    links = spark.createDataFrame([(1, 1), (2, 1), (2, 2)], "image_id long, tag_id long")
    return images, tags, links


def test_merge_is_idempotent(spark, library):
    images, tags, links = library
    record = "hash string, position int, path string, original_file_name string, tag_names array<string>"
    backup_images = spark.createDataFrame([
        ("h1", 0, "set_1/a", "changed.png", ["Y"]), ("h3", 1, "set_1/c", "c.png", ["X"]), ("h3", 2, "set_1/c2", "c2.png", ["Z", "X"]),
        ("h4", 3, "set_1/missing", "d.png", ["X"]), ("h5", 4, "set_1/e", "e.png", ["X"]), ("h2", 5, "set_1/b", "b.png", ["X", "unknown"]),
    ], record)
    backup_tags = spark.createDataFrame([("Z", 0, 9, True), ("X", 1, 1, False), ("Z", 2, 1, False)], "name string, position int, order int, enabled boolean")
    disk = spark.createDataFrame([("set_1/a", "H1"), ("set_1/c", "h3"), ("set_1/c2", "h3"), ("set_1/e", "other"), ("set_1/b", "h2")], "path string, actual_hash string")
    merged = merge.merge_library(images, tags, links, backup_images, backup_tags, disk)
    assert {r["hash"]: r["outcome"] for r in merged.outcomes.collect()} == {"h1": "merged", "h2": "unchanged", "h3": "added", "h4": "damaged", "h5": "damaged"}
    assert {tuple(r) for r in merged.images.select("id", "hash", "original_file_name").collect()} == {(1, "h1", "a.png"), (2, "h2", "b.png"), (3, "h3", "c.png")}
    assert {tuple(r) for r in merged.tags.select("id", "name", "order").collect()} == {(1, "X", 4), (2, "Y", 0), (3, "Z", 9)}
    assert sorted(tuple(r) for r in merged.links.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 3)]
    again = merge.merge_library(merged.images, merged.tags, merged.links, backup_images, backup_tags, disk)
    assert {r["outcome"] for r in again.outcomes.collect()} == {"unchanged", "damaged"}
    assert again.images.count() == 3 and again.tags.count() == 3 and again.links.count() == 6


def test_import_and_new_tags(spark, library):
    images, tags, links = library
    request = spark.createDataFrame([
        (0, "h9", "n.png", ["New", "X"]), (1, "h1", "again.png", ["Q"]), (2, "h9", "copy.png", ["Other"]), (3, "h8", "m.png", []),
    ], "position int, hash string, original_file_name string, tag_names array<string>")
    outcomes = [r["outcome"] for r in ingest.import_outcomes(request, images).orderBy("position").collect()]
    assert outcomes == ["new", "duplicate_in_library", "duplicate_in_request", "new"]
    new_images, new_tags, new_links = ingest.insert_images(images, tags, links, request)
    assert {tuple(r) for r in new_images.where("id > 2").select("id", "hash", "original_file_name").collect()} == {(3, "h9", "n.png"), (4, "h8", "m.png")}
    assert [tuple(r) for r in new_tags.where("id > 2").select("id", "name", "order").collect()] == [(3, "New", 4)]
    assert {tuple(r) for r in new_links.where("image_id > 2").collect()} == {(3, 1), (3, 3)}


def test_strict_changes_abort(spark, library):
    images, tags, links = library
    ids = spark.createDataFrame([(1,), (2,), (77,)], "id long")
    with pytest.raises(ValueError):
        tables.edit_image_tags(images, tags, links, ids, [1, 99], add=True)
    with pytest.raises(ValueError):
        tables.replace_vector_ids(images.withColumn("vector_id", F.lit("v")), ids.withColumn("vector_id", F.lit("w")))
    with pytest.raises(ValueError):
        tables.set_image_tags(images, tags, links, spark.createDataFrame([(1, 50)], "image_id long, tag_id long"), spark.createDataFrame([(1,)], "image_id long"))
    added, changed = tables.edit_image_tags(images, tags, links, ids, [1, 2], add=True)
    assert [r["id"] for r in changed.collect()] == [1] and added.count() == 4
    removed, changed = tables.edit_image_tags(images, tags, links, ids, [2], add=False)
    assert [r["id"] for r in changed.collect()] == [2] and removed.count() == 2


def test_maintenance_trio_settles(spark):
    images = spark.createDataFrame([(1, "AA", ".PNG", "v1"), (2, "bb", ".png", None), (3, "cc", ".png", "v1"), (4, "dd", ".png", None)], "id long, hash string, extension string, vector_id string")
    vectors = spark.createDataFrame([("v1", 1, "m"), ("v2", 2, "m")], "vector_id string, image_id long, model_hash string")
    blobs = spark.createDataFrame([("aa", ".png"), ("cc", ".PNG"), ("ee", ".png")], "hash string, extension string")
    plan = maintain.vector_plan(images, vectors, blobs)
    assert {r["id"]: r["action"] for r in plan.collect()} == {1: "skipped", 2: "relink", 3: "generate", 4: "missing_blob"}
    assert [r["hash"] for r in maintain.orphan_blobs(blobs, images).collect()] == ["ee"]
    repaired = tables.replace_vector_ids(images, plan.where("action = 'relink'").select("id", "vector_id"))
    assert maintain.vector_plan(repaired, vectors, blobs).where("action = 'relink'").count() == 0


def test_export_sets(spark):
    rows = [(1, "Same.png", "a"), (2, "same.png", "b"), (3, "SAME.png", "c"), (4, "x.png", "d"), (5, "y.png", "e")]
    planned = export.assign_sets(spark.createDataFrame(rows, "id long, original_file_name string, hash string"), 2).collect()
    loads = {}
    for r in planned:
        loads.setdefault(r["set_index"], []).append(r["original_file_name"].lower())
    assert set(loads) == {0, 1, 2} and all(len(n) <= 2 and len(set(n)) == len(n) for n in loads.values())
    with pytest.raises(ValueError):
        export.assign_sets(spark.createDataFrame([(1, "a/b", "a")], "id long, original_file_name string, hash string"))


def test_backup_document(spark, tmp_path):
    entry = {"path": "set_1/x.png", "hash": "A" * 40, "imported_at": "2026-01-01T00:00:00+08:00", "modification_date": "2026-01-02T00:00:00", "tags": ["b", "a", "b"], "text_in_image": None}
    tag = {"name": "a", "rgb": "#2196F3", "order": 0, "description": None, "enabled": True}
    document = {"format_version": 1, "hash_algorithm": "sha1", "exported_at": "x", "images": [entry], "tags": [tag, dict(tag, rgb="bad")]}
    path = tmp_path / "backup.json"
    path.write_text(json.dumps(document, indent=1))
    images, tags = backup.read_backup(spark, str(path))
    row = images.first()
    assert (row["hash"], row["tag_names"], row["imported_at"]) == ("a" * 40, ["b", "a"], dt.datetime(2025, 12, 31, 16))
    assert [r["name"] for r in tags.collect()] == ["a"]
    bad = [
        dict(format_version=2), dict(format_version="1"), dict(format_version=True), dict(hash_algorithm="md5"), dict(images={}), dict(tags=None),
        dict(images=[dict(entry, hash="x")]), dict(images=[dict(entry, path="set_1/../x")]), dict(images=[dict(entry, text_in_image=5)]),
        dict(images=[dict(entry, tags=["a", 1])]), dict(images=["x"]), dict(tags=[dict(tag, order=-1)]), dict(tags=[dict(tag, order="7")]),
        dict(tags=[dict(tag, order=True)]), dict(tags=[dict(tag, enabled="true")]), dict(tags=[dict(tag, description=3)]), dict(tags=[dict(tag, name=3)]),
    ]
    for change in bad:
        path.write_text(json.dumps({**document, **change}))
        with pytest.raises(ValueError):
            backup.read_backup(spark, str(path))


def test_images_need_the_first_set(spark, tmp_path):
    entry = {"path": "set_1/x.png", "hash": "a" * 40, "imported_at": "2026-01-01T00:00:00", "modification_date": "2026-01-02T00:00:00", "tags": []}
    document = {"format_version": 1, "hash_algorithm": "sha1", "images": [entry], "tags": []}
    path = tmp_path / "backup.json"
    path.write_text(json.dumps(document))
    there, missing = (spark.createDataFrame([(p,)], "path string") for p in ("set_1/x.png", "set_10/x.png"))
    assert backup.read_backup(spark, str(path), paths=there)[0].count() == 1
    with pytest.raises(ValueError, match="set_1"):
        backup.read_backup(spark, str(path), paths=missing)
    with pytest.raises(ValueError, match="set_1"):
        backup.preflight(backup.read_document(spark, str(path)), missing)
    path.write_text(json.dumps({**document, "images": []}))
    backup.preflight(backup.read_document(spark, str(path)), missing)
    assert backup.read_backup(spark, str(path), paths=missing)[0].count() == 0


def test_written_backup_keeps_header_and_positions(spark, tmp_path):
    day = dt.datetime(2026, 1, 1)
    names = [f"n{i:02}.png" for i in range(23)]
    planned = export.assign_sets(spark.createDataFrame(
        [(i, n, f"{i:040x}", day, day, [], None) for i, n in enumerate(names)],
        "id long, original_file_name string, hash string, imported_at timestamp_ntz, modification_date timestamp_ntz, tag_names array<string>, text_in_image string",
    ), max_files_per_set=2)
    tags = spark.createDataFrame([(2, "b", 1), (1, "a", 1), (3, "z", 0)], "id long, name string, order int").selectExpr(
        "*", "'#000000' AS color_rgb", "string(null) AS description", "true AS enabled")
    backup.write_backup(export.image_entries(planned), export.tag_entries(tags), str(tmp_path / "b"), "2026-01-01T00:00:00Z")
    images, read_tags = backup.read_backup_tables(spark, str(tmp_path / "b"))
    shown = [r["path"] for r in images.orderBy("position").collect()]
    assert shown == sorted(shown, key=lambda p: (int(p.split("/")[0][4:]), p)) and len(shown) == 23
    assert [r["name"] for r in read_tags.orderBy("position").collect()] == ["z", "a", "b"]
    header = json.loads(next((tmp_path / "b" / "header").glob("*.json")).read_text())
    assert (header["format_version"], header["hash_algorithm"], header["exported_at"]) == (1, "sha1", "2026-01-01T00:00:00Z")


def test_backup_header_is_one_file_with_one_row(spark, tmp_path):
    tags = spark.createDataFrame([("z", 0)], "name string, position long")
    entries = spark.createDataFrame([(0, "set_1/a.png")], "set_index long, path string")
    backup.write_backup(entries, tags, str(tmp_path / "b"), "2026-01-01T00:00:00Z")
    parts = list((tmp_path / "b" / "header").glob("*.json"))
    assert len(parts) == 1 and json.loads(parts[0].read_text())["format_version"] == 1


def test_large_clusters_go_on_in_parts(spark):
    rows = [(0.3, "a", 5, m) for m in (9, 1, 10, 4, 7)] + [(0.3, "b", 2, 3), (0.3, "b", 2, 2), (0.4, "a", 1, 8)]
    lists = backup.cluster_lists(spark.createDataFrame(rows, "threshold double, cluster_id string, size long, member_id long"), part_members=2)
    got = sorted((r["threshold"], r["cluster_id"], r["part"], r["members"]) for r in lists.collect())
    assert got == [(0.3, "a", 0, "1;4"), (0.3, "a", 1, "7;9"), (0.3, "a", 2, "10"), (0.3, "b", 0, "2;3"), (0.4, "a", 0, "8")]


def test_curve_files(spark, tmp_path):
    ranked = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.5), (2, 1, 0.75)], "query_id long, rank int, sim double")
    backup.write_csv(backup.wide_curves(ranked, "sim", "score_", 4), str(tmp_path / "scores"))
    assert sorted(tuple(r) for r in backup.read_curves(spark, str(tmp_path / "scores"), 4).collect()) == [(1, 1, 0.9), (1, 2, 0.5), (2, 1, 0.75)]


def test_recycle_keeps_the_last_delete(spark):
    fields = "id long, hash string, extension string, original_file_name string, text_in_image string, tag_names array<string>, imported_at string, modification_date string, deleted_at string"
    rows = [(1, "aa", ".png", "old", None, ["x"], "i", "m", "2026-01-01"), (2, "aa", ".png", "new", None, [], "i", "m", "2026-01-02"), (3, "bb", ".png", "gone", None, [], "i", "m", "2026-01-02")]
    kept = backup.recycle_rows(spark.createDataFrame(rows, fields), spark.createDataFrame([("AA", ".png")], "hash string, extension string")).collect()
    assert [json.loads(r["sidecar"])["original_file_name"] for r in kept] == ["new"]
    assert json.loads(kept[0]["sidecar"])["text_in_image"] is None


def test_enrichment_isolates_failures(spark):
    rows = spark.createDataFrame([(i, i) for i in range(10)], "id long, n long").coalesce(1)

    def check(n):
        if n == 3:
            raise ValueError("three")
        return n

    def batch(values, model):
        if 7 in values:
            raise RuntimeError("seven")
        return [v * model for v in values]

    stages = [enrich.ItemStage("check", check), enrich.BatchStage("batch", batch, batch_size=3, setup=lambda: 10)]
    got = {r["id"]: (r["value"], r["error"], r["stage"]) for r in enrich.run_stages(rows, "id", "n", stages, "long").collect()}
    assert got[3] == (None, "ValueError: three", "check") and got[0] == (0, None, None)
    assert {i for i, v in got.items() if v[2] == "batch"} == {7, 8, 9} and got[7][1] == "RuntimeError: seven"
    summary = enrich.job_summary(enrich.run_stages(rows, "id", "n", stages, "long")).first()
    assert (summary["completed"], summary["succeeded"], summary["failed"]) == (10, 6, 4)


def test_enrichment_contract(spark):
    rows = spark.createDataFrame([(1, 2**60 + 1), (2, None), (3, 5)], "id long, n long").coalesce(1)

    def check(n):
        if n == 5:
            raise KeyError
        return f"{type(n).__name__} {n}"

    got = {r["id"]: (r["value"], r["error"]) for r in enrich.run_stages(rows, "id", "n", [enrich.ItemStage("check", check)], "string").collect()}
    assert got == {1: (f"int {2**60 + 1}", None), 2: ("NoneType None", None), 3: (None, "KeyError")}
    short = [enrich.BatchStage("short", lambda v: v[1:], batch_size=5)]
    with pytest.raises(Exception, match="stage short: 2 results for 3 values"):
        enrich.run_stages(rows, "id", "n", short, "long").collect()


def test_repeated_changes(spark):
    table = spark.createDataFrame([(1, "a.png", ".png", dt.datetime(2026, 1, 1)), (2, "b.png", ".png", None)],
                                  "id long, original_file_name string, extension string, modification_date timestamp_ntz")
    log = [(1, "x.png", None, 1), (1, None, dt.datetime(2026, 2, 2), 2), (1, "y.png", None, 3), (9, "z.png", None, 4)]
    change = spark.createDataFrame(log, "id long, original_file_name string, modification_date timestamp_ntz, position long")
    # Row by row, as a log is played back.
    want = {1: ["a.png", dt.datetime(2026, 1, 1)], 2: ["b.png", None]}
    for i, name, day, _ in log:
        if i in want:
            want[i] = [name or want[i][0], day or want[i][1]]
    got = {r["id"]: [r["original_file_name"], r["modification_date"]] for r in tables.update_file_properties(table, change, "position").collect()}
    assert got == want
    links = spark.createDataFrame([(1, 5), (2, 6)], "image_id long, tag_id long")
    rows = change.withColumn("extension", F.lit(".png"))
    sets = spark.createDataFrame([(1, 7, 1), (1, 8, 3), (1, 9, 3)], "image_id long, tag_id long, position long")
    images, kept = tables.overwrite_images(table, links, rows, sets, "position")
    assert sorted((r["id"], r["original_file_name"]) for r in images.collect()) == [(1, "y.png"), (2, "b.png")]
    assert sorted(map(tuple, kept.select("image_id", "tag_id").collect())) == [(1, 8), (1, 9), (2, 6)]
    for call in (lambda: tables.update_file_properties(table, change), lambda: tables.overwrite_images(table, links, rows, sets),
                 lambda: tables.update_columns(table, change, ["original_file_name"])):
        with pytest.raises(ValueError, match="repeated id"):
            call()


def test_streams_equal_one_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"h{i % 7}") for i in range(40)], "position long, hash string")
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    library = spark.createDataFrame([("h0",)], "hash string")
    import_stream.start_import(stream, library, str(tmp_path / "out")).awaitTermination()
    hashes = [r["hash"] for r in import_stream.imported(spark, str(tmp_path / "out"), rows.schema).collect()]
    assert sorted(hashes) == [f"h{i}" for i in range(1, 7)]
    counts = {r["outcome"]: r["n"] for r in import_stream.import_counts(spark, str(tmp_path / "out")).groupBy("outcome").agg(F.sum("n").alias("n")).collect()}
    assert counts["new"] == 6 and sum(counts.values()) == 40
    searches = spark.createDataFrame([(1, i, dt.datetime(2026, 1, 1, 0, i), f"T{i % 6}") for i in range(30)], "user_id long, event_id long, ts timestamp_ntz, text string")
    searches.repartition(4).write.parquet(str(tmp_path / "searches"))
    events = spark.readStream.schema(searches.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "searches"))
    history_stream.start_history(events, str(tmp_path / "h"), keep=4).awaitTermination()
    history_stream.compact_history(spark, str(tmp_path / "h"), str(tmp_path / "h2"), keep=4)
    for folder in ("h", "h2"):
        kept = history_stream.stored_history(spark, str(tmp_path / folder), keep=4).orderBy("position").collect()
        assert [r["text"] for r in kept] == ["T5", "T4", "T3", "T2"]


def test_import_outcomes_with_ties_and_nulls(spark):
    rows = [("h", 1, "a"), ("h", 1, "b"), ("h", 2, "c"), (None, 3, "d"), ("k", 4, "e")]
    got = ingest.import_outcomes(
        spark.createDataFrame(rows, "hash string, position long, name string"), spark.createDataFrame([("k",)], "hash string")).collect()
    assert sorted(r["outcome"] for r in got) == ["duplicate_in_library", "duplicate_in_request", "duplicate_in_request", "error", "new"]
    assert {r["outcome"] for r in got if r["name"] == "c"} == {"duplicate_in_request"}


def test_times_do_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            row = spark.range(1).select(
                names.rfc3339(F.lit("2026-03-08T02:30:00").cast("timestamp_ntz")).alias("gap"),
                names.rfc3339(F.lit("2026-07-01T12:00:00.5").cast("timestamp_ntz"), "America/New_York").alias("summer"),
                names.from_iso8601(F.lit("2026-01-01T00:00:00+08:00")).cast("string").alias("zoned"),
                names.from_iso8601(F.lit("2026-03-08 02:30")).cast("string").alias("naive"),
                names.from_iso8601(F.lit("2026-13-01")).cast("string").alias("bad"),
            ).first()
            assert tuple(row) == ("2026-03-08T02:30:00Z", "2026-07-01T12:00:00.500000-04:00", "2025-12-31 16:00:00", "2026-03-08 02:30:00", None)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_last_row_of_a_repeated_key_counts(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    change = spark.createDataFrame([(1, "x", 0), (1, None, 2), (1, "y", 1), (9, "z", 3), (None, "n", 4)], "id long, v string, pos int")
    assert sorted(map(tuple, tables.update_columns(table, change, ["v"], position="pos").collect())) == [(1, None), (2, "b")]

    tags = spark.createDataFrame([(1, "a", 3, "red"), (2, "b", 7, "blue")], "id long, name string, `order` int, color_rgb string")
    rows = [(None, "z", 0, "c0", 0), (None, "a", 0, "c1", 1), (None, "y", 0, "c2", 2), (None, "z", 0, "c3", 3), (None, "a", 0, "c4", 4),
            (2, "bb", 8, "c5", 5), (2, "bc", 9, "c6", 6)]
    incoming = spark.createDataFrame(rows, "id long, name string, `order` int, color_rgb string, pos int")
    got = tables.upsert_tags(tags, incoming, position="pos").select("id", "name", "order", "color_rgb")
    assert sorted(map(tuple, got.collect())) == [(1, "a", 3, "c4"), (2, "bc", 9, "c6"), (3, "z", 7, "c3"), (4, "y", 7, "c2")]
