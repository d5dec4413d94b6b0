"""Registered queries: changes to library tables."""

from pyspark.sql import functions as F

from lumenlake.operators import ingest, tables
from lumenlake.plans.registry import query


def _order_candidates(lib):
    """Documents as an import request over a library that holds some of them already."""
    return lib.txt.withColumn("position", F.col("id"))


def _known_images(lib):
    """The part of the text library stored under its benchmark or short sources: documents of source src0 to src9."""
    return lib.txt.where(F.length(F.split("original_file_name", "_")[0]) == 4)


_KNOWN = "known AS (SELECT * FROM txt WHERE length(split_part(original_file_name, '_', 1)) = 4)"


@query("c5_new_candidates", "txt", f", {_KNOWN} SELECT min(id) AS id, hash FROM txt WHERE hash NOT IN (SELECT hash FROM known) GROUP BY hash")
def _(lib):
    return ingest.new_candidates(_order_candidates(lib), _known_images(lib)).select("id", "hash")


@query("d20_import_outcomes", "txt", f""", {_KNOWN},
    r AS (SELECT id, hash, row_number() OVER (PARTITION BY hash ORDER BY id) AS k FROM txt)
    SELECT CASE WHEN k > 1 THEN 'duplicate_in_request' WHEN hash IN (SELECT hash FROM known) THEN 'duplicate_in_library' ELSE 'new' END AS outcome, count(*) AS n
    FROM r GROUP BY 1""")
def _(lib):
    return ingest.outcome_counts(ingest.import_outcomes(_order_candidates(lib), _known_images(lib)))


@query("w14_first_occurrences", "txt", "SELECT hash, min(id) AS id FROM txt GROUP BY hash")
def _(lib):
    return ingest.first_occurrences(_order_candidates(lib), "hash").select("hash", "id")


@query("m1_insert_images", "txt tag", f""", {_KNOWN},
    top AS (SELECT max(id) AS id FROM known),
    fresh AS (SELECT row_number() OVER (ORDER BY position) + (SELECT id FROM top) AS id, hash, source, position
              FROM (SELECT hash, split_part(arg_min(original_file_name, id), '_', 1) AS source, min(id) AS position
                    FROM txt WHERE hash NOT IN (SELECT hash FROM known) GROUP BY hash)),
    new_tags AS (SELECT source AS name, row_number() OVER (ORDER BY min(position)) + (SELECT max(id) FROM tag) AS tag_id FROM fresh GROUP BY source)
    SELECT f.id, f.hash, string_agg(name || '=' || tag_id || '/' || (SELECT max("order") FROM tag), ',' ORDER BY tag_id) AS tags
    FROM fresh f JOIN (SELECT name, tag_id FROM new_tags UNION ALL SELECT name, id FROM tag WHERE name = 'Brand#1') t ON t.name = f.source OR t.name = 'Brand#1'
    GROUP BY f.id, f.hash
    UNION ALL SELECT id, hash, NULL FROM known""")
def _(lib):
    source = F.split("original_file_name", "_")[0]
    request = _order_candidates(lib).withColumn("tag_names", F.array(F.lit("Brand#1"), source, source))
    no_links = lib.img_tag.where(F.lit(False))
    images, tags, links = ingest.insert_images(_known_images(lib), lib.tag, no_links, request)
    named = links.join(tags.select(F.col("id").alias("tag_id"), "name", "order"), "tag_id").withColumn(
        "shown", F.concat("name", F.lit("="), "tag_id", F.lit("/"), F.when(F.col("name") == "Brand#1", F.lit(2)).otherwise(F.col("order")))
    )
    per_image = named.groupBy(F.col("image_id").alias("id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tag_id", "shown"))), lambda t: t["shown"]), ",").alias("tags")
    )
    return images.select("id", "hash").join(per_image, "id", "left")


@query("m2_add_missing_tags", "tag", """
    SELECT id, name, "order" FROM tag UNION ALL
    SELECT row_number() OVER (ORDER BY first) + (SELECT max(id) FROM tag), name, "order"
    FROM (SELECT p_name AS name, min(p_partkey) AS first, arg_min(p_size, p_partkey) AS "order" FROM part GROUP BY p_name)""")
def _(lib):
    by_name = lib.table("part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("position"), F.col("p_size").alias("order"))
    by_brand = lib.table("part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("position"), F.col("p_size").alias("order"))
    return ingest.add_missing_tags(lib.tag, by_name.unionByName(by_brand)).select("id", "name", "order")


_NEW_LINKS = """asked AS (SELECT DISTINCT o_orderkey AS image_id, CAST(o_custkey % 40 + 1 AS BIGINT) AS tag_id FROM orders)"""


def _asked_links(lib):
    return lib.table("orders").select(F.col("o_orderkey").alias("image_id"), (F.col("o_custkey") % 40 + 1).alias("tag_id"))


@query("m3_merge_tag_links", "tag img_tag", f""", {_NEW_LINKS}
    SELECT image_id, tag_id FROM img_tag UNION ALL
    SELECT image_id, tag_id FROM asked WHERE tag_id IN (SELECT id FROM tag) AND (image_id, tag_id) NOT IN (SELECT DISTINCT image_id, tag_id FROM img_tag)""")
def _(lib):
    hashes = lib.img.select(F.col("id").alias("image_id"), "hash")
    incoming = _asked_links(lib).join(hashes, "image_id").select("hash", "tag_id")
    unknown = incoming.select(F.lit("no such hash").alias("hash"), "tag_id")
    return ingest.merge_tag_links(lib.img, lib.tag, lib.img_tag, incoming.unionByName(unknown))


@query("m3_added_links", "tag img_tag", f""", {_NEW_LINKS}
    SELECT count(*) AS n FROM asked WHERE tag_id IN (SELECT id FROM tag) AND (image_id, tag_id) NOT IN (SELECT DISTINCT image_id, tag_id FROM img_tag)""")
def _(lib):
    incoming = _asked_links(lib).join(lib.img.select(F.col("id").alias("image_id"), "hash"), "image_id").select("hash", "tag_id")
    return ingest.new_tag_links(lib.img, lib.tag, lib.img_tag, incoming).agg(F.count(F.lit(1)).alias("n"))


@query("m4_update_columns", "txt", """
    SELECT id, CASE WHEN d.doc_id IS NULL THEN text_in_image WHEN toxic = 1 THEN NULL ELSE 'quality ' || quality END AS text_in_image
    FROM txt LEFT JOIN labels d ON d.doc_id = id""")
def _(lib):
    text = F.when(F.col("toxic") == 0, F.concat(F.lit("quality "), "quality"))
    change = lib.table("labels").select(F.col("doc_id").alias("id"), text.alias("text_in_image"))
    unknown = change.select((-F.col("id") - 1).alias("id"), "text_in_image")
    return tables.update_columns(lib.txt, change.unionByName(unknown), ["text_in_image"]).select("id", "text_in_image")


@query("m5_replace_vector_ids", "img vec", "SELECT id, coalesce(v.vector_id, i.vector_id) AS vector_id FROM img i LEFT JOIN vec v ON v.image_id = i.id")
def _(lib):
    change = lib.vec.select(F.col("image_id").alias("id"), "vector_id")
    return tables.replace_vector_ids(lib.img, change).select("id", "vector_id")


@query("m6_overwrite_images", "img img_tag", """
    SELECT i.id, CASE WHEN d.doc_id IS NULL THEN i.original_file_name ELSE 'doc' || d.doc_id END AS original_file_name,
           CASE WHEN d.doc_id IS NULL THEN (SELECT count(*) FROM img_tag l WHERE l.image_id = i.id) ELSE 1 END AS links
    FROM img i LEFT JOIN documents d ON d.doc_id = i.id""")
def _(lib):
    docs = lib.table("documents").select(F.col("doc_id").alias("id"))
    rows = lib.img.join(docs, "id", "left_semi").withColumn("original_file_name", F.concat(F.lit("doc"), "id"))
    unknown = rows.withColumn("id", -F.col("id") - 1)
    new_links = docs.select(F.col("id").alias("image_id"), F.lit(5).cast("long").alias("tag_id"))
    images, links = tables.overwrite_images(lib.img, lib.img_tag, rows.unionByName(unknown), new_links.unionByName(new_links))
    counts = links.groupBy(F.col("image_id").alias("id")).agg(F.count(F.lit(1)).alias("links"))
    return images.join(counts, "id", "left").select("id", "original_file_name", F.coalesce("links", F.lit(0)).alias("links"))


@query("m7_update_file_properties", "img", """
    SELECT id, CASE WHEN c_custkey IS NULL THEN original_file_name ELSE c_name || '.png' END AS original_file_name,
           CASE WHEN c_acctbal > 0 THEN TIMESTAMP '2026-01-01' ELSE modification_date END AS modification_date
    FROM img LEFT JOIN customer ON c_custkey = id""")
def _(lib):
    dated = F.when(F.col("c_acctbal") > 0, F.lit("2026-01-01").cast("timestamp_ntz"))
    change = lib.table("customer").select(
        F.col("c_custkey").alias("id"), F.concat(F.lit(" "), "c_name", F.lit(".PNG ")).alias("original_file_name"), dated.alias("modification_date")
    )
    return tables.update_file_properties(lib.img, change).select("id", "original_file_name", "modification_date")


@query("m7_file_property_problems", "img", "SELECT c_custkey AS id, c_name || '/' AS original_file_name FROM customer")
def _(lib):
    change = lib.table("customer").select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit("/")).alias("original_file_name"))
    return tables.file_property_problems(change, lib.img)


def _edit_log(lib):
    """Every order edits the image whose id is its customer; later orders come later."""
    return lib.table("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("position"), F.col("o_orderdate").alias("day"))


@query("m6_overwrite_repeats", "img img_tag", """,
    last AS (SELECT o_custkey AS id, max(o_orderkey) AS position FROM orders GROUP BY 1)
    SELECT i.id, coalesce('order' || l.position, i.original_file_name) AS original_file_name,
           coalesce(CAST(l.position % 40 + 1 AS BIGINT), (SELECT CAST(sum(tag_id) AS BIGINT) FROM img_tag t WHERE t.image_id = i.id), 0) AS tags
    FROM img i LEFT JOIN last l USING (id)""")
def _(lib):
    log = _edit_log(lib)
    rows = lib.img.join(log, "id").withColumn("original_file_name", F.concat(F.lit("order"), "position"))
    tag_sets = log.select(F.col("id").alias("image_id"), "position", (F.col("position") % 40 + 1).alias("tag_id"))
    images, links = tables.overwrite_images(lib.img, lib.img_tag, rows, tag_sets, "position")
    sums = links.groupBy(F.col("image_id").alias("id")).agg(F.sum("tag_id").alias("tags"))
    return images.join(sums, "id", "left").select("id", "original_file_name", F.coalesce("tags", F.lit(0)).alias("tags"))


@query("m7_file_property_repeats", "img", """,
    log AS (SELECT o_custkey AS id, o_orderkey AS position, CASE WHEN o_orderkey % 3 = 1 THEN 'order' || o_orderkey || '.png' END AS name,
                   CASE WHEN o_orderkey % 5 = 1 THEN o_orderdate END AS day FROM orders),
    last AS (SELECT id, arg_max(name, position) FILTER (WHERE name IS NOT NULL) AS name, arg_max(day, position) FILTER (WHERE day IS NOT NULL) AS day FROM log GROUP BY id)
    SELECT i.id, coalesce(name, original_file_name) AS original_file_name, coalesce(day, modification_date) AS modification_date FROM img i LEFT JOIN last USING (id)""")
def _(lib):
    name = F.when(F.col("position") % 3 == 1, F.concat(F.lit("order"), "position", F.lit(".PNG")))
    change = _edit_log(lib).select("id", "position", name.alias("original_file_name"), F.when(F.col("position") % 5 == 1, F.col("day")).alias("modification_date"))
    return tables.update_file_properties(lib.img, change, "position").select("id", "original_file_name", "modification_date")


@query("m15_update_repeats", "vec", """,
    last AS (SELECT 'v' || o_custkey AS vector_id, 'm' || max(o_orderkey) AS model_hash FROM orders WHERE 'v' || o_custkey IN (SELECT vector_id FROM vec) GROUP BY 1)
    SELECT vector_id, coalesce(l.model_hash, v.model_hash) AS model_hash FROM vec v LEFT JOIN last l USING (vector_id)""")
def _(lib):
    log = _edit_log(lib).select(F.concat(F.lit("v"), "id").alias("vector_id"), "position", F.concat(F.lit("m"), "position").alias("model_hash"))
    known = log.join(lib.vec.select("vector_id"), "vector_id", "left_semi")
    return tables.update_vectors(lib.vec, known, ["model_hash"], "position").select("vector_id", "model_hash")


@query("m9_upsert_repeats", "tag", """,
    log AS (SELECT o_orderkey AS position, o_orderpriority AS name, o_orderkey % 7 AS n FROM orders UNION ALL
            SELECT -event_id - 1, 'Brand#' || (event_id % 30), event_id % 9 FROM events),
    last AS (SELECT name, min(position) AS first, arg_max(n, position) AS n FROM log GROUP BY name)
    SELECT t.id, t.name, t."order", coalesce('#00000' || n, color_rgb) AS color_rgb FROM tag t LEFT JOIN last USING (name)
    UNION ALL SELECT (SELECT max(id) FROM tag) + row_number() OVER (ORDER BY first), name, (SELECT max("order") FROM tag), '#00000' || n
    FROM last WHERE name NOT IN (SELECT name FROM tag)""")
def _(lib):
    color = F.concat(F.lit("#00000"), "n")
    orders = lib.table("orders").select(F.col("o_orderkey").alias("position"), F.col("o_orderpriority").alias("name"), (F.col("o_orderkey") % 7).alias("n"))
    events = lib.table("events").select((-F.col("event_id") - 1).alias("position"), F.concat(F.lit("Brand#"), F.col("event_id") % 30).alias("name"), (F.col("event_id") % 9).alias("n"))
    log = orders.unionByName(events).select(F.lit(None).cast("long").alias("id"), "name", "position", F.lit(0).alias("order"), color.alias("color_rgb"))
    return tables.upsert_tags(lib.tag, log, "position").select("id", "name", "order", "color_rgb")


@query("m8_delete_images", "img img_tag", "SELECT id, (SELECT count(*) FROM img_tag WHERE image_id = id) AS links FROM img WHERE id NOT IN (SELECT doc_id FROM documents)")
def _(lib):
    images, links = tables.delete_images(lib.img, lib.img_tag, lib.table("documents").select(F.col("doc_id").alias("id")))
    counts = links.groupBy(F.col("image_id").alias("id")).agg(F.count(F.lit(1)).alias("links"))
    return images.join(counts, "id", "left").select("id", F.coalesce("links", F.lit(0)).alias("links"))


@query("m9_upsert_tags", "tag", """,
    n AS (SELECT n_nationkey AS k, n_name, n_regionkey FROM nation)
    SELECT t.id, t.name, coalesce(r.k + 50, t."order") AS "order", coalesce('#00000' || r.n_regionkey, '#11111' || b.n_regionkey, t.color_rgb) AS color_rgb
    FROM tag t LEFT JOIN n r ON r.k = t.id AND r.n_regionkey = 1 LEFT JOIN n b ON 'Brand#' || b.k = t.name AND b.n_regionkey = 2
    UNION ALL
    SELECT (SELECT max(id) FROM tag) + row_number() OVER (ORDER BY n_name), n_name, (SELECT max("order") FROM tag), '#222222' FROM n WHERE n_regionkey = 3""")
def _(lib):
    n = lib.table("nation").withColumn("k", F.col("n_nationkey").cast("long"))
    keyed = n.join(lib.tag.select(F.col("id").alias("k"), "name"), "k")
    by_id = keyed.where("n_regionkey = 1").select(
        F.col("k").alias("id"), "name", (F.col("k") + 50).cast("int").alias("order"), F.concat(F.lit("#00000"), "n_regionkey").alias("color_rgb")
    )
    no_id = F.lit(None).cast("long").alias("id")
    by_name = keyed.where("n_regionkey = 2").select(
        no_id, "name", F.lit(99).alias("order"), F.concat(F.lit("#11111"), "n_regionkey").alias("color_rgb")
    )
    fresh = n.where("n_regionkey = 3").select(no_id, F.col("n_name").alias("name"), F.lit(98).alias("order"), F.lit("#222222").alias("color_rgb"))
    return tables.upsert_tags(lib.tag, by_id.unionByName(by_name).unionByName(fresh)).select("id", "name", "order", "color_rgb")


@query("m10_delete_tags", "tag img_tag", "SELECT id, (SELECT count(*) FROM img_tag WHERE tag_id = id) AS links FROM tag WHERE enabled")
def _(lib):
    tags, links = tables.delete_tags(lib.tag, lib.img_tag, lib.tag.where("NOT enabled"))
    counts = links.groupBy(F.col("tag_id").alias("id")).agg(F.count(F.lit(1)).alias("links"))
    return tags.join(counts, "id", "left").select("id", F.coalesce("links", F.lit(0)).alias("links"))


@query("m11_set_image_tags", "img_tag", """
    SELECT image_id, tag_id FROM img_tag WHERE image_id NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT doc_id, CAST(1 AS BIGINT) FROM documents WHERE lang = 'en'""")
def _(lib):
    docs = lib.table("documents").select(F.col("doc_id").alias("image_id"), F.lit(1).cast("long").alias("tag_id"), "lang")
    wanted = docs.where("lang = 'en'").select("image_id", "tag_id")
    return tables.set_image_tags(lib.img, lib.tag, lib.img_tag, wanted.unionByName(wanted), docs)


_TOUCHED = "touched AS (SELECT DISTINCT user_id AS id FROM events)"


@query("m12_add_tags", "img img_tag", f""", {_TOUCHED},
    fresh AS (SELECT id AS image_id, t.tag_id FROM touched CROSS JOIN (VALUES (1::BIGINT), (2::BIGINT)) t(tag_id)
              WHERE id IN (SELECT id FROM img) AND (id, tag_id) NOT IN (SELECT DISTINCT image_id, tag_id FROM img_tag))
    SELECT image_id, tag_id, false AS changed FROM img_tag UNION ALL SELECT image_id, tag_id, false FROM fresh
    UNION ALL SELECT DISTINCT image_id, NULL, true FROM fresh""")
def _(lib):
    touched = lib.table("events").select(F.col("user_id").alias("id"))
    links, changed = tables.edit_image_tags(lib.img, lib.tag, lib.img_tag, touched, [1, 2, 1], add=True)
    marked = changed.select(F.col("id").alias("image_id"), F.lit(None).cast("long").alias("tag_id"), F.lit(True).alias("changed"))
    return links.withColumn("changed", F.lit(False)).unionByName(marked)


@query("m12_remove_tags", "img img_tag", f""", {_TOUCHED}
    SELECT image_id, tag_id, false AS changed FROM img_tag WHERE NOT (image_id IN (SELECT id FROM touched) AND tag_id IN (1, 2))
    UNION ALL SELECT DISTINCT image_id, CAST(NULL AS BIGINT), true FROM img_tag WHERE image_id IN (SELECT id FROM touched) AND tag_id IN (1, 2)""")
def _(lib):
    touched = lib.table("events").select(F.col("user_id").alias("id"))
    links, changed = tables.edit_image_tags(lib.img, lib.tag, lib.img_tag, touched, [1, 2], add=False)
    marked = changed.select(F.col("id").alias("image_id"), F.lit(None).cast("long").alias("tag_id"), F.lit(True).alias("changed"))
    return links.withColumn("changed", F.lit(False)).unionByName(marked)


@query("m13_delete_vectors", "vec", """
    SELECT vector_id, false AS deleted FROM vec WHERE image_id NOT IN (SELECT user_id FROM events)
    UNION ALL SELECT vector_id, true FROM vec WHERE image_id IN (SELECT user_id FROM events)""")
def _(lib):
    asked = lib.table("events").select(F.concat(F.lit("v"), "user_id").alias("vector_id"))
    kept, deleted = tables.delete_vectors(lib.vec, asked.unionByName(asked.select(F.concat("vector_id", F.lit("x")).alias("vector_id"))))
    return kept.select("vector_id", F.lit(False).alias("deleted")).unionByName(deleted.select("vector_id", F.lit(True).alias("deleted")))


@query("m14_vectors_of_images", "img vec", """
    SELECT vector_id FROM img WHERE vector_id IS NOT NULL AND file_size > 200000
    UNION SELECT vector_id FROM vec WHERE image_id IN (SELECT id FROM img WHERE file_size > 200000)""")
def _(lib):
    return tables.vectors_of_images(lib.img.where("file_size > 200000"), lib.vec)


def _vector_rows(lib):
    meta = [F.lit("a.png").alias("image_filename"), F.lit(64).alias("image_width"), F.lit(64).alias("image_height")]
    return lib.vec.select("*", *meta)


@query("m15_add_vectors", "vec", """
    SELECT vector_id, 'kept' AS state FROM vec UNION ALL SELECT 'new' || vector_id, 'kept' FROM vec WHERE image_id > 0
    UNION ALL SELECT 'new' || vector_id, 'image_id' FROM vec WHERE image_id <= 0""")
def _(lib):
    rows = _vector_rows(lib)
    kept, refused = tables.add_vectors(rows, rows.withColumn("vector_id", F.concat(F.lit("new"), "vector_id")), 64)
    return kept.select("vector_id", F.lit("kept").alias("state")).unionByName(refused.select("vector_id", F.col("problem").alias("state")))


@query("m15_update_metadata", "vec", "SELECT vector_id, CASE WHEN model_hash = 'm0' THEN 'm2' ELSE model_hash END AS model_hash FROM vec")
def _(lib):
    change = lib.vec.where("model_hash = 'm0'").select("vector_id", F.lit("m2").alias("model_hash"))
    return tables.update_vectors(lib.vec, change, ["model_hash"]).select("vector_id", "model_hash")


@query("m15_reset_vectors", "vec", "SELECT 'new' || vector_id AS vector_id, model_hash FROM vec WHERE image_id > 0")
def _(lib):
    """A reset store holds the vectors added after the reset only."""
    rows = _vector_rows(lib)
    kept, _ = tables.add_vectors(tables.reset_vectors(rows), rows.withColumn("vector_id", F.concat(F.lit("new"), "vector_id")), 64)
    return kept.select("vector_id", "model_hash")


@query("m18_tag_save_problems", "tag", """
    SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS name, CASE WHEN p_size > 25 THEN 'taken' ELSE 'empty' END AS problem
    FROM part LEFT JOIN tag ON name = p_brand WHERE p_size <= 25 OR tag.id <> p_partkey""")
def _(lib):
    name = F.when(F.col("p_size") > 25, F.concat(F.lit(" "), "p_brand", F.lit("\t"))).otherwise(F.lit("  "))
    edits = lib.table("part").select(F.col("p_partkey").alias("id"), name.alias("name"))
    return tables.tag_save_problems(lib.tag, edits)


@query("m18_cleaned_tag_edits", "", "SELECT p_partkey AS id, p_brand AS name, CASE WHEN p_size > 25 THEN p_type END AS description FROM part")
def _(lib):
    edits = lib.table("part").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("　"), "p_brand").alias("name"),
        F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(F.lit(" \n")).alias("description"),
    )
    return tables.cleaned_tag_edits(edits)
