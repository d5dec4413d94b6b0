"""Registered queries: scans, searches, lookups, order and paging."""

import functools

from pyspark.sql import functions as F

from lumenlake.functions import names, text
from lumenlake.operators import ordering, search, tagexpr
from lumenlake.plans.registry import query

_BRIEF = ("id", "original_file_name")


@query("a1_list_images", "img tag img_tag", """
    SELECT i.id, i.hash, coalesce(string_agg(t.name || ':' || t.enabled, ',' ORDER BY t."order", t.id), '') AS tags
    FROM img i LEFT JOIN (SELECT DISTINCT * FROM img_tag) l ON l.image_id = i.id LEFT JOIN tag t ON t.id = l.tag_id
    GROUP BY i.id, i.hash""")
def _(lib):
    listed = search.list_images(lib.img, lib.tag, lib.img_tag)
    shown = F.transform("tags", lambda t: F.concat(t["name"], F.lit(":"), t["enabled"].cast("string")))
    return listed.select("id", "hash", F.array_join(shown, ",").alias("tags"))


@query("a8_scan_vectors", "vec", "SELECT image_id, vector_id, model_hash, len(vector) AS dimension FROM vec ORDER BY image_id, vector_id")
def _(lib):
    return lib.vec.orderBy("image_id", "vector_id").select("image_id", "vector_id", "model_hash", F.size("vector").cast("long").alias("dimension"))


@query("b1_search_text", "txt", "SELECT id, original_file_name FROM txt WHERE contains(translate(text_in_image, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the on')")
def _(lib):
    return search.search_text(lib.txt.withColumn("modification_date", F.col("id")), "  The ON ").select(*_BRIEF)


@query("b2_search_file_name", "img", "SELECT id, original_file_name FROM img WHERE contains(lower(original_file_name), 't_1')")
def _(lib):
    return search.search_file_name(lib.img, "T_1").select(*_BRIEF)


@query("b3_match_file_name", "img", "SELECT id, original_file_name FROM img WHERE lower(original_file_name) LIKE '%h_3%7.p%'")
def _(lib):
    return search.match_file_name(lib.img, "H_3%7.p").select(*_BRIEF)


@query("b4_search_tags", "tag", """
    SELECT id, name FROM tag WHERE enabled AND contains(lower(name), '#1') ORDER BY "order", id LIMIT 10""")
def _(lib):
    return search.search_tags(lib.tag, " #1 ").select("id", "name")


@query("b5_list_tags", "tag", 'SELECT id, name, "order" FROM tag WHERE enabled ORDER BY "order", id')
def _(lib):
    return search.list_tags(lib.tag, enabled_only=True).select("id", "name", "order")


@query("b6_match_tags", "tag", "SELECT id, name FROM tag WHERE contains(lower(name), 'brand#2')")
def _(lib):
    return search.match_tags(lib.tag, " BRAND#2 ").select("id", "name")


_HAS = "(SELECT DISTINCT l.image_id FROM img_tag l JOIN tag t ON t.id = l.tag_id WHERE t.enabled AND t.name = '{}')"


@query("b7_tag_expression", "img tag img_tag", f"""
    SELECT id, original_file_name FROM img
    WHERE (id IN {_HAS.format('Brand#1')} OR id IN {_HAS.format('Brand#12')}) AND NOT id IN {_HAS.format('Brand#3')}
      AND NOT id IN {_HAS.format('Brand#7')}""")
def _(lib):
    return search_expression(lib, '("Brand#1" OR "Brand#12") AND NOT "Brand#3" & !"Brand#7"')


def search_expression(lib, expression):
    return tagexpr.search_tag_expression(lib.img, lib.tag, lib.img_tag, expression).select(*_BRIEF)


@query("b7_not_unknown_tag", "img", "SELECT id, original_file_name FROM img")
def _(lib):
    return search_expression(lib, "NOT unknown")


@query("b8_missing_text", "part_txt", "SELECT id FROM part_txt WHERE text_in_image IS NULL")
def _(lib):
    return search.missing_text(lib.part_txt).select("id")


@query("b9_query_metadata", "vec", """
    SELECT vector_id FROM vec WHERE model_hash IN ('m1', 'm9') OR model_hash = 'm0' AND vector_id >= 'v3'""")
def _(lib):
    listed = search.query_metadata(lib.vec, {"model_hash": {"$in": ["m1", "m9"]}})
    ranged = search.query_metadata(lib.vec, {"model_hash": "m0", "vector_id": {"$gte": "v3"}})
    return listed.unionByName(ranged).select("vector_id")


@query("b10_in_request_order", "img", """
    SELECT p.position, i.id, i.hash FROM img i JOIN (SELECT l_orderkey AS id, min(l_partkey * 10 + l_linenumber) AS position FROM lineitem GROUP BY 1) p USING (id)""")
def _(lib):
    asked = lib.table("lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("position"))
    return search.in_request_order(asked, lib.img).select("position", "id", "hash")


@query("b11_maintenance_records", "img", "SELECT id, original_file_name, hash, extension, size_width, size_height, vector_id FROM img")
def _(lib):
    return search.maintenance_records(lib.img)


@query("b13_thumbnail_plan", "img", """
    SELECT id, size_width > 300 OR size_height > 300 AS needed,
           CASE WHEN size_width > 300 OR size_height > 300 THEN greatest(1, CAST(trunc(size_width * least(200.0::DOUBLE / size_width, 200.0::DOUBLE / size_height)) AS INTEGER)) ELSE size_width END AS width,
           CASE WHEN size_width > 300 OR size_height > 300 THEN greatest(1, CAST(trunc(size_height * least(200.0::DOUBLE / size_width, 200.0::DOUBLE / size_height)) AS INTEGER)) ELSE size_height END AS height
    FROM img""")
def _(lib):
    return lib.img.select("id", names.thumbnail_plan().alias("p")).select("id", "p.*")


@query("b14_first_vector_of_image", "vec img", "SELECT image_id, min(vector_id) AS vector_id FROM vec WHERE image_id IN (SELECT id FROM img WHERE file_size > 100000) GROUP BY image_id")
def _(lib):
    wanted = lib.img.where("file_size > 100000").select(F.col("id").alias("image_id"))
    return search.first_vector_of_image(lib.vec, wanted).select("image_id", "vector_id")


@query("b14_existing_vectors", "vec img", "SELECT vector_id FROM img WHERE vector_id IN (SELECT vector_id FROM vec)")
def _(lib):
    return search.existing(lib.img.select("vector_id"), lib.vec, "vector_id")


@query("b14_vectors_by_id", "vec img", "SELECT vector_id, model_hash FROM vec WHERE vector_id IN (SELECT vector_id FROM img WHERE vector_id IS NOT NULL)")
def _(lib):
    return search.vectors_by_id(lib.vec, lib.img).select("vector_id", "model_hash")


@query("c1_search_tag_name", "img tag img_tag", """
    SELECT id, original_file_name FROM img WHERE id IN
      (SELECT image_id FROM img_tag WHERE tag_id IN (SELECT id FROM tag WHERE enabled AND contains(lower(name), 'd#1')))""")
def _(lib):
    return search.search_tag_name(lib.img, lib.tag, lib.img_tag, "D#1").select(*_BRIEF)


@query("c2_images_with_tag", "img tag img_tag", """
    SELECT id, original_file_name FROM img WHERE id IN (SELECT image_id FROM img_tag WHERE tag_id = (SELECT id FROM tag WHERE name = 'Brand#7'))""")
def _(lib):
    return search.images_with_tag(lib.img, lib.tag, lib.img_tag, "Brand#7").select(*_BRIEF)


@query("c3_exists_or_not_exists", "img tag img_tag", f"""
    SELECT id, original_file_name FROM img WHERE id IN {_HAS.format('Brand#2')} OR NOT id IN {_HAS.format('Brand#4')}""")
def _(lib):
    predicate = tagexpr.has_tag("Brand#2") | ~tagexpr.has_tag("Brand#4")
    return tagexpr.filter_by_tags(lib.img, lib.tag, lib.img_tag, predicate).select(*_BRIEF)


@query("c4_known_hashes", "txt blob", "SELECT DISTINCT hash FROM txt WHERE upper(hash) IN (SELECT hash FROM blob)")
def _(lib):
    return search.known_hashes(lib.txt, lib.blob.select(F.lower("hash").alias("hash")))


@query("c8_with_tags", "img tag img_tag", """
    SELECT i.id, coalesce(string_agg(t.name, '|' ORDER BY t."order", t.id), '') AS tags, count(t.id) AS n
    FROM img i LEFT JOIN (SELECT DISTINCT * FROM img_tag) l ON l.image_id = i.id LEFT JOIN tag t ON t.id = l.tag_id GROUP BY i.id""")
def _(lib):
    tagged = search.with_tags(lib.img, lib.tag, lib.img_tag)
    return tagged.select("id", F.array_join("tags.name", "|").alias("tags"), F.size("tags").cast("long").alias("n"))


@query("c8_page_with_tags", "img tag img_tag", """,
    p AS (SELECT id, file_size FROM img ORDER BY file_size, id LIMIT 100 OFFSET 300)
    SELECT p.id, p.file_size, coalesce(string_agg(t.name, '|' ORDER BY t."order", t.id), '') AS tags
    FROM p LEFT JOIN (SELECT DISTINCT * FROM img_tag) l ON l.image_id = p.id LEFT JOIN tag t ON t.id = l.tag_id GROUP BY p.id, p.file_size""")
def _(lib):
    shown = ordering.page(lib.img, "size", descending=False, offset=300, count=100)
    tagged = search.page_with_tags(shown, lib.tag, lib.img_tag)
    return tagged.select("id", "file_size", F.array_join("tags.name", "|").alias("tags"))


@query("c10_vector_id_map", "vec img", "SELECT image_id, max(vector_id) AS vector_id FROM vec WHERE image_id IN (SELECT id FROM img) GROUP BY image_id")
def _(lib):
    return search.vector_id_map(lib.vec, lib.img.select(F.col("id").alias("image_id")))


@query("c12_with_stored_blob", "txt blob", "SELECT id, hash FROM txt WHERE upper(hash) IN (SELECT hash FROM blob)")
def _(lib):
    return search.with_stored_blob(lib.txt, lib.blob).select("id", "hash")


@query("d1_count_vectors", "vec", "SELECT count(*) AS n FROM vec")
def _(lib):
    return search.count_rows(lib.vec)


@query("d2_next_tag_order", "tag", 'SELECT coalesce(max("order"), 0) AS next_order FROM tag')
def _(lib):
    return search.next_tag_order(lib.tag)


@query("d3_next_id", "img", "SELECT coalesce(min(id) FILTER (id > 777), min(id)) AS next_id FROM img")
def _(lib):
    return ordering.next_id(lib.img, 777)


@query("d3_next_ids", "img", "SELECT id, coalesce(lead(id) OVER (ORDER BY id), min(id) OVER ()) AS next_id FROM img")
def _(lib):
    return ordering.next_ids(lib.img)


@query("d17_model_hashes", "vec", "SELECT DISTINCT model_hash FROM vec")
def _(lib):
    return search.model_hashes(lib.vec)


@query("e1_page_by_size", "img", "SELECT id, file_size FROM img ORDER BY file_size, id LIMIT 100 OFFSET 300")
def _(lib):
    return ordering.page(lib.img, "size", descending=False, offset=300, count=100).select("id", "file_size")


@query("e1_page_from_offset", "img", "SELECT id, modification_date FROM img ORDER BY modification_date DESC, id DESC OFFSET 500")
def _(lib):
    return ordering.page(lib.img, "unknown key", offset=500).select("id", "modification_date")


@query("e2_newest_first", "img", "SELECT id, modification_date FROM img ORDER BY modification_date DESC, id DESC")
def _(lib):
    return ordering.newest_first(lib.img).select("id", "modification_date")


@query("e3_page_after", "img", """
    SELECT id, imported_at FROM img WHERE (imported_at, id) < (TIMESTAMP '1998-03-01', 5000) ORDER BY imported_at DESC, id DESC LIMIT 100""")
def _(lib):
    from datetime import datetime

    return ordering.page_after(lib.img, datetime(1998, 3, 1), 5000, "imported_at", count=100).select("id", "imported_at")


@query("e4_random_id", "img", """,
    s AS (SELECT unnest(range(12)) AS seed)
    SELECT seed, arg_min(id, md5(seed || ':' || id)) AS id FROM img, s WHERE id <> seed * 7 + 1 GROUP BY seed""")
def _(lib):
    """Draws under a number of seeds, each without one id."""
    drawn = [ordering.random_id(lib.img, excluding=seed * 7 + 1, seed=seed).select(F.lit(seed).cast("long").alias("seed"), "id") for seed in range(12)]
    return functools.reduce(lambda a, b: a.unionByName(b), drawn)


@query("e5_tag_order", "tag", 'SELECT id, "order" FROM tag ORDER BY "order", id')
def _(lib):
    return ordering.tag_order(lib.tag).select("id", "order")


@query("f3_normalised_names", "img", """
    SELECT id, CASE WHEN id % 4 IN (1, 2) THEN rtrim(original_file_name[:-5], ' .') || '.png' END AS name FROM img""")
def _(lib):
    """A path and a bare extension are refused; a padded name and one without extension are mended."""
    stem = F.regexp_replace("original_file_name", "\\.PNG$", "")
    given = (
        F.when(F.col("id") % 4 == 0, F.concat(F.lit("../"), "original_file_name"))
        .when(F.col("id") % 4 == 1, F.concat(F.lit("  "), "original_file_name"))
        .when(F.col("id") % 4 == 2, F.concat(stem, F.lit(" . ")))
        .otherwise(F.lit(" .PNG"))
    )
    return lib.img.select("id", names.normalised_file_name(given, "extension").alias("name"))


@query("f4_extension_override", "", """
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '.' || lang WHEN 2 THEN '.' || source END AS extension FROM documents""")
def _(lib):
    """Without a dot or with a blank inside an extension is refused."""
    given = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" ."), F.upper("lang"), F.lit("\t")))
        .when(F.col("doc_id") % 4 == 1, F.col("lang"))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("."), "source"))
        .otherwise(F.concat(F.lit("."), "lang", F.lit(" "), "source"))
    )
    return lib.table("documents").select("doc_id", names.extension_override(given).alias("extension"))


@query("f5_safe_names", "", "SELECT page_id, NOT contains(url, '/') AS safe FROM pages")
def _(lib):
    return lib.table("pages").select("page_id", names.is_safe_name("url").alias("safe"))


@query("f6_compose_text", "", """
    SELECT conv_id, '[OCR]' || left(string_agg(t, ' ' ORDER BY turn), 4000) AS text FROM (
        SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM conversations WHERE role = 'user')
    WHERE t <> '' GROUP BY conv_id""")
def _(lib):
    score = F.when(F.col("role") == "user", F.lit(0.81)).otherwise(F.lit(0.80))
    block = F.struct("turn", F.struct("text", score.alias("score")).alias("b"))
    blocks = lib.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(block)).alias("s"))
    composed = blocks.select("conv_id", text.compose_text(F.transform("s", lambda s: s["b"])).alias("text"))
    return composed.where("text IS NOT NULL")


@query("f7_rfc3339", "img", "SELECT id, strftime(imported_at, '%Y-%m-%dT%H:%M:%SZ') AS utc, strftime(imported_at, '%Y-%m-%dT%H:%M:%S+05:30') AS india FROM img")
def _(lib):
    return lib.img.select("id", names.rfc3339("imported_at").alias("utc"), names.rfc3339("imported_at", "Asia/Kolkata").alias("india"))


@query("f8_from_iso8601", "", "SELECT event_id, ts - INTERVAL 90 MINUTE AS local, ts AS naive FROM events")
def _(lib):
    rendered = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return lib.table("events").select(
        "event_id",
        names.from_iso8601(F.concat(rendered, F.lit("+01:30"))).alias("local"),
        names.from_iso8601(rendered).alias("naive"),
    )


@query("f11_sha1", "", "SELECT doc_id, sha1(text) AS hash, left(sha1(text), 16) AS short FROM documents")
def _(lib):
    from lumenlake.functions.vectors import model_hash

    return lib.table("documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("hash"), model_hash(F.col("text").cast("binary")).alias("short"))


@query("f2_collision_key", "img", "SELECT id, lower(original_file_name) AS key FROM img")
def _(lib):
    return lib.img.select("id", text.collision_key("original_file_name").alias("key"))


@query("f16_distinct_in_order", "", """
    SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2) GROUP BY 1""")
def _(lib):
    turns = lib.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.array_distinct("t.role"), ",").alias("roles"))


@query("f17_contracts", "", """
    SELECT doc_id, doc_id % 3 <> 0 AS hash_ok, lang <> 'fr' AS path_ok, doc_id % 2 = 0 AS rgb_ok FROM documents""")
def _(lib):
    digest = F.sha1(F.col("text").cast("binary"))
    hashes = F.when(F.col("doc_id") % 3 == 0, F.substring(digest, 1, 39)).otherwise(digest)
    path = F.concat(F.when(F.col("lang") == "fr", F.lit("set_0/")).otherwise(F.lit("set_1/")), "source")
    color = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("#")).otherwise(F.lit("")), F.substring(digest, 1, 6))
    return lib.table("documents").select(
        "doc_id", names.is_hash(hashes).alias("hash_ok"), names.is_set_path(path).alias("path_ok"), names.is_rgb(color).alias("rgb_ok"))
