"""The library tables as seen in the given test tables, for Spark and as SQL.

Two libraries are read out of the given tables: a tag library (orders as images,
part brands as tags, line items as links) and a text library (documents as
images with extracted text, their hashes as blobs, embeddings as vectors).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.session import ship_package


class Library:
    """Lazy views over one data folder; `img`, `tag`, ... are DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        ship_package(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def img(self) -> DataFrame:
        """Images of the tag library; every third status has no, a right or a wrong vector link."""
        vector = (
            F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("v"), "o_orderkey"))
            .when(F.col("o_orderstatus") == "P", F.concat(F.lit("v"), (F.col("o_orderkey") + 1)))
        )
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            F.concat_ws("_", "o_orderpriority", F.concat(F.col("o_orderkey"), F.lit(".PNG"))).alias("original_file_name"),
            F.col("o_totalprice").cast("bigint").alias("file_size"),
            F.sha1(F.col("o_orderkey").cast("string").cast("binary")).alias("hash"),
            F.lit(".png").alias("extension"),
            F.col("o_orderdate").alias("imported_at"),
            F.col("o_orderdate").alias("modification_date"),
            (F.col("o_custkey") % 500 + 1).cast("int").alias("size_width"),
            (F.col("o_orderkey") % 700 + 1).cast("int").alias("size_height"),
            vector.alias("vector_id"),
        )

    @property
    def tag(self) -> DataFrame:
        """Tags: brand names; the id is the number in the name."""
        number = F.regexp_extract("name", "([0-9]+)$", 1).cast("bigint")
        return (
            self.table("part").select(F.col("p_brand").alias("name")).distinct()
            .select(
                number.alias("id"),
                "name",
                (~F.col("name").endswith("7")).alias("enabled"),
                (number % 3).cast("int").alias("order"),
                F.concat(F.lit("#"), F.substring(F.sha1(F.col("name").cast("binary")), 1, 6)).alias("color_rgb"),
            )
        )

    @property
    def img_tag(self) -> DataFrame:
        """Links with duplicates, as the link table has no key."""
        part = self.table("part").select("p_partkey", F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("bigint").alias("tag_id"))
        return (
            self.table("lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_partkey").alias("p_partkey"))
            .join(part, "p_partkey").select("image_id", "tag_id")
        )

    @property
    def txt(self) -> DataFrame:
        """Images of the text library."""
        return self.table("documents").select(
            F.col("doc_id").alias("id"),
            F.concat("source", F.lit("_"), "lang", F.lit(".txt")).alias("original_file_name"),
            F.col("n_chars").alias("file_size"),
            F.sha1(F.col("text").cast("binary")).alias("hash"),
            F.lit(".TXT").alias("extension"),
            F.col("text").alias("text_in_image"),
        )

    @property
    def part_txt(self) -> DataFrame:
        """The text library before German images are extracted."""
        german = self.table("documents").where("lang = 'de'").select(F.col("doc_id").alias("id"), F.lit(True).alias("_de"))
        missing = F.when(F.col("_de").isNull(), F.col("text_in_image"))
        return self.txt.join(german, "id", "left").withColumn("text_in_image", missing).drop("_de")

    @property
    def blob(self) -> DataFrame:
        """Stored files: all texts but those of one source, plus unreferenced benchmark texts."""
        documents = self.table("documents").where(F.col("source") != "src7").select("text")
        texts = documents.unionByName(self.table("benchmark").select("text"))
        key = F.sha1(F.col("text").cast("binary"))
        return texts.select(F.upper(key).alias("hash"), F.lit(".txt").alias("extension")).distinct()

    @property
    def vec(self) -> DataFrame:
        return self.table("embeddings").select(
            F.concat(F.lit("v"), "vec_id").alias("vector_id"),
            F.col("vec_id").alias("image_id"),
            F.col("embedding").alias("vector"),
            F.concat(F.lit("m"), F.col("label") % 2).alias("model_hash"),
        )

    @property
    def srch(self) -> DataFrame:
        """Searches: the event type in mixed case with stray blanks, plus its property value."""
        value = F.regexp_extract("props", "[0-9]+", 0)
        spelled = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
        return self.table("events").select(
            "event_id", "user_id", "ts", F.concat(F.lit("  "), spelled, F.lit(" "), value, F.lit(" ")).alias("text")
        )


# The same views for the check engine, by name.
VIEW_SQL = {
    "img": """
        SELECT o_orderkey AS id, o_orderpriority || '_' || o_orderkey || '.PNG' AS original_file_name,
               CAST(trunc(o_totalprice) AS BIGINT) AS file_size, sha1(CAST(o_orderkey AS VARCHAR)) AS hash, '.png' AS extension,
               o_orderdate AS imported_at, o_orderdate AS modification_date,
               CAST(o_custkey % 500 + 1 AS INTEGER) AS size_width, CAST(o_orderkey % 700 + 1 AS INTEGER) AS size_height,
               CASE o_orderstatus WHEN 'O' THEN 'v' || o_orderkey WHEN 'P' THEN 'v' || (o_orderkey + 1) END AS vector_id
        FROM orders""",
    "tag": """
        SELECT CAST(regexp_extract(name, '([0-9]+)$', 1) AS BIGINT) AS id, name, name NOT LIKE '%7' AS enabled,
               CAST(CAST(regexp_extract(name, '([0-9]+)$', 1) AS BIGINT) % 3 AS INTEGER) AS "order",
               '#' || substr(sha1(name), 1, 6) AS color_rgb
        FROM (SELECT DISTINCT p_brand AS name FROM part)""",
    "img_tag": """
        SELECT l_orderkey AS image_id, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) AS tag_id
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "txt": """
        SELECT doc_id AS id, source || '_' || lang || '.txt' AS original_file_name, n_chars AS file_size,
               sha1(text) AS hash, '.TXT' AS extension, text AS text_in_image
        FROM documents""",
    "part_txt": """
        SELECT doc_id AS id, source || '_' || lang || '.txt' AS original_file_name, n_chars AS file_size,
               sha1(text) AS hash, '.TXT' AS extension, CASE WHEN lang <> 'de' THEN text END AS text_in_image
        FROM documents""",
    "blob": """
        SELECT DISTINCT upper(sha1(text)) AS hash, '.txt' AS extension
        FROM (SELECT text FROM documents WHERE source <> 'src7' UNION ALL SELECT text FROM benchmark)""",
    "vec": """
        SELECT 'v' || vec_id AS vector_id, vec_id AS image_id, embedding::DOUBLE[] AS vector, 'm' || (label % 2) AS model_hash
        FROM embeddings""",
    "srch": """
        SELECT event_id, user_id, ts,
               '  ' || CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END || ' '
                    || regexp_extract(props, '[0-9]+') || ' ' AS text
        FROM events""",
    "knn": """
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY c DESC, candidate_id) AS INTEGER) AS rank,
               candidate_id, greatest(0.0, c) AS sim
        FROM (SELECT a.image_id AS query_id, b.image_id AS candidate_id, round(list_cosine_similarity(a.vector, b.vector), 12) AS c
              FROM vec a JOIN vec b ON a.image_id <> b.image_id)
        QUALIFY rank <= 200""",
    "curve": """
        SELECT query_id, rank, sim, sim - lead(sim) OVER w AS gap, count(*) OVER q AS n,
               max(sim) OVER q AS top, min(sim) OVER q AS bottom
        FROM knn WINDOW w AS (PARTITION BY query_id ORDER BY rank), q AS (PARTITION BY query_id)""",
}


def with_views(names: str, body: str) -> str:
    """`body` with the named views in front of it, in the order given."""
    parts = [f"{name} AS ({VIEW_SQL[name]})" for name in names.split()]
    return f"WITH RECURSIVE {', '.join(parts)}\n{body}" if parts else body
