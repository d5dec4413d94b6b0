"""Tag predicates, text matching, paging."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumenlake.functions import text
from lumenlake.operators import history, ordering, search
from lumenlake.operators.tagexpr import (
    TagExpressionError,
    filter_by_tags,
    has_tag,
    parse_tags,
    run_search,
    search_tag_expression,
)


@pytest.fixture(scope="module")
def library(spark):
    images = spark.createDataFrame(
        [(1, "only-a"), (2, "a-b"), (3, "only-b"), (4, "a-c"), (5, "no-tags"), (6, "hidden")], "id long, original_file_name string"
    ).withColumn("modification_date", F.lit("2026-01-01").cast("timestamp_ntz"))
    tags = spark.createDataFrame(
        [(1, "A", True, 2), (2, "B", True, 1), (3, "C", True, 1), (4, "Hidden", False, 0), (5, "角色(作品)", True, 4), (6, '他说"好"', True, 4)],
        "id long, name string, enabled boolean, order int",
    )
    links = spark.createDataFrame(
        [(1, 1), (2, 1), (2, 2), (2, 2), (3, 2), (4, 1), (4, 3), (6, 4), (1, 5), (2, 6)], "image_id long, tag_id long"
    )
    return images, tags, links


@pytest.mark.parametrize("expression, names", [
    ("A AND B", {"a-b"}),
    ("A OR B", {"only-a", "a-b", "only-b", "a-c"}),
    ("NOT C", {"only-a", "a-b", "only-b", "no-tags", "hidden"}),
    ("(A OR B) AND NOT C", {"only-a", "a-b", "only-b"}),
    ("not [A + B]", {"no-tags", "hidden"}),
    ("A*~C&!B", {"only-a"}),
    ("Hidden", set()),
    ("NOT Hidden", {"only-a", "a-b", "only-b", "a-c", "no-tags", "hidden"}),
    ("a", set()),
    ('"角色(作品)"', {"only-a"}),
    ('"他说""好"""', {"a-b"}),
    ("NOT unknown AND A | B", {"only-a", "a-b", "a-c", "only-b"}),
    ("  ", set()),
])
def test_tag_expressions(library, expression, names):
    found = [r["original_file_name"] for r in search_tag_expression(*library, expression).collect()]
    assert set(found) == names and len(found) == len(names)


@pytest.mark.parametrize("bad", ["A AND", "(A OR B", "A AND OR B", "TRUE", "None", "1", "A B", "A (B)", 'A "B"', '"open', "A ? B", "NOT", "A NOT B"])
def test_bad_tag_expressions(spark, bad):
    with pytest.raises(TagExpressionError):
        parse_tags(bad)


def test_predicate_combinators_share_names(library):
    predicate = (has_tag("A") | has_tag("B")) & ~(has_tag("C") & has_tag("A"))
    assert predicate.names == ("A", "B", "C")
    assert {r["id"] for r in filter_by_tags(*library, predicate).collect()} == {1, 2, 3}


def test_tags_are_ordered_and_links_may_repeat(library):
    tags = {r["id"]: [t["name"] for t in r["tags"]] for r in search.with_tags(*library).collect()}
    assert tags[2] == ["B", "A", '他说"好"'] and tags[5] == [] and tags[4] == ["C", "A"]


def test_page_with_tags_reads_links_of_shown_images_only(library):
    images, tags, links = library
    shown = ordering.page(images, "name", offset=1, count=3)
    whole = {r["id"]: r["tags"] for r in search.with_tags(*library).collect()}
    paged = search.page_with_tags(shown, tags, links)
    got = {r["id"]: r["tags"] for r in paged.collect()}
    assert got == {r["id"]: whole[r["id"]] for r in shown.collect()} and len(got) == 3
    joins = paged._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in joins
    again = search.page_with_tags(shown.unionByName(shown).unionByName(shown.withColumn("id", F.lit(None).cast("long"))), tags, links)
    counts = again.groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in counts} == {None: 3} | dict.fromkeys(got, 2)
    assert all(r["tags"] == ([] if r["id"] is None else got[r["id"]]) for r in again.collect())
    assert search.page_with_tags(shown.limit(0), tags, links).count() == 0


def test_literal_percent_and_wildcards(spark):
    rows = spark.createDataFrame([(1, "进度 100% 完成"), (2, "进度 1000 完成"), (3, None), (4, "ÄB_c")], "id int, t string")
    found = lambda c: {r["id"] for r in rows.where(c).collect()}
    assert found(text.contains_literal("t", "100%")) == {1}
    assert found(text.contains_literal("t", "  ")) == set()
    assert found(text.like_wildcard("t", "1_0")) == {1, 2}
    assert found(text.contains_literal("t", "äb")) == set()
    assert found(text.contains_literal("t", "b_C")) == {4}
    odd = spark.createDataFrame([("a.\\Eb\n(C",), ("axEb",)], "t string")
    assert odd.where(text.contains_literal("t", ".\\EB\n(c")).count() == 1
    assert odd.where(text.contains_literal("t", "A.")).count() == 1
    assert found(text.contains_casefold("t", "äB")) == {4}
    assert found(text.contains_casefold("t", "")) == {1, 2, 3, 4}


def test_paging_breaks_ties_by_id_in_the_same_direction(spark):
    day = dt.datetime(2026, 1, 1)
    rows = spark.createDataFrame(
        [(1, "older", 10, day), (2, "tiny", 1, day), (3, "newer", 10, day)], "id long, original_file_name string, file_size long, imported_at timestamp_ntz"
    ).withColumn("modification_date", F.col("imported_at"))
    order = lambda df: [r["original_file_name"] for r in df.collect()]
    assert order(ordering.page(rows, "imported_at")) == ["newer", "tiny", "older"]
    assert order(ordering.page(rows, "size", descending=False)) == ["tiny", "older", "newer"]
    assert order(ordering.page(rows, "size", False, offset=1, count=1)) == ["older"]
    assert order(ordering.page(rows, "size", False, offset=1)) == ["older", "newer"]
    assert order(ordering.page_after(rows, 10, 3, "size", True)) == ["older", "tiny"]


def test_next_and_random_id(spark):
    ids = spark.createDataFrame([(2,), (5,), (9,)], "id long")
    after = lambda i: ordering.next_id(ids, i).first()[0]
    assert [after(2), after(6), after(9)] == [5, 9, 2]
    assert {r["id"]: r["next_id"] for r in ordering.next_ids(ids).collect()} == {2: 5, 5: 9, 9: 2}
    assert ordering.random_id(ids, excluding=5).first()[0] in (2, 9)
    assert ordering.random_id(ids.where("id < 0")).count() == 0


def test_global_index_is_gapless_with_a_hot_value(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 100).alias("v"))
    indexed = ordering.with_global_index(rows, ["v", "id"]).orderBy("idx").collect()
    assert [r["idx"] for r in indexed] == list(range(1, 5001))
    assert [(r["v"], r["id"]) for r in indexed] == sorted((r["v"], r["id"]) for r in indexed)


def test_skew_safe_lookup_splits_hot_keys(spark):
    rows = spark.range(60_000).select("id", F.when(F.col("id") % 3 > 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    lookup = rows.select("k").distinct().withColumn("v", F.col("k") * 2)
    joined = ordering.skew_safe_lookup(rows, lookup, ["k"], "id", sizes, "n")
    assert joined.count() == 60_000 and joined.where("v <> k * 2").count() == 0


def test_search_history(spark):
    def rows(*texts):
        return spark.createDataFrame([(1, i, i, t) for i, t in enumerate(texts)], "user_id int, event_id int, ts int, text string")

    recent = history.recent_searches(rows("Alphabet", "Beta", "Alpha", "  ", " beta "))
    assert [r["text"] for r in recent.orderBy("position").collect()] == ["beta", "Alpha", "Alphabet"]
    tags = spark.createDataFrame([(1, "ALPHA", True, 0), (2, "Alps", True, 0)], "id long, name string, enabled boolean, order int")
    shown = history.suggestions(recent, tags, "alp").orderBy("source", "position").collect()
    assert [(r["source"], r["title"]) for r in shown] == [("recent", "Alpha"), ("recent", "Alphabet"), ("tag", "Alps")]


def test_search_kinds(library):
    images, tags, links = library
    images = images.withColumn("text_in_image", F.col("original_file_name"))
    ids = lambda kind, q: [r["id"] for r in run_search(kind, q, images, tags, links).collect()]
    assert ids("tag", "a") == [4, 2, 1] and ids("text", "B") == [3, 2] and ids("filename", "ONLY") == [3, 1] and ids("advanced", "C") == [4]
    assert ids("tag", " ") == [] and ids("tag", "hidden") == []
    with pytest.raises(ValueError):
        ids("other", "a")


def test_plans_push_filters_and_avoid_wide_shuffles(spark, tmp_path):
    """Paging filters reach the scan; a small request never shuffles the library."""
    path = str(tmp_path / "images")
    spark.range(1000).select("id", F.sha1(F.col("id").cast("string").cast("binary")).alias("hash"), F.lit("2026-01-01").cast("timestamp_ntz").alias("imported_at"), F.lit("x").alias("unused")).write.parquet(path)
    images = spark.read.parquet(path)

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    paged = plan(ordering.page_after(images.select("id", "imported_at"), dt.datetime(2026, 1, 1), 500, "imported_at"))
    assert "LessThanOrEqual(imported_at" in paged and "TakeOrderedAndProject" in paged and "unused" not in paged
    images.select("hash").limit(5).write.parquet(path + "-asked")
    asked = spark.read.parquet(path + "-asked")
    assert "BroadcastHashJoin" in plan(search.known_hashes(asked, images))


def test_tags_that_share_a_name_all_count(spark):
    images = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "id long, original_file_name string").withColumn(
        "modification_date", F.lit("2026-01-01").cast("timestamp_ntz"))
    tags = spark.createDataFrame([(1, "same", True, 0), (2, "same", True, 0)], "id long, name string, enabled boolean, order int")
    links = spark.createDataFrame([(1, 1), (2, 2)], "image_id long, tag_id long")
    assert {r["id"] for r in search_tag_expression(images, tags, links, "same").collect()} == {1, 2}
