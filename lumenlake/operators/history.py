"""Recent searches and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions.text import casefold, strip
from lumenlake.operators.search import search_tags

MAX_STORED = 100
RECENT_LIMIT, TAG_LIMIT = 3, 10
RECENT, TAG = "recent", "tag"


def latest_spellings(searches: DataFrame, user: str = "user_id") -> DataFrame:
    """(user, key, text, ts, event_id): newest spelling per casefolded search; blank ones dropped.

    Searches (user, ts, event_id, text) are combined before the shuffle, so a
    user with many searches costs no more than their distinct texts.
    """
    cleaned = searches.withColumn("text", strip("text")).where("text <> ''").withColumn("key", casefold("text"))
    newest = F.max(F.struct("ts", "event_id", "text")).alias("_m")
    return cleaned.groupBy(user, "key").agg(newest).select(
        user, "key", F.col("_m.text").alias("text"), F.col("_m.ts").alias("ts"), F.col("_m.event_id").alias("event_id")
    )


def recent_searches(searches: DataFrame, user: str = "user_id", keep: int = MAX_STORED) -> DataFrame:
    """(user, position, text, ts, event_id): most recent distinct searches per user, newest first."""
    newest = Window.partitionBy(user).orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return (
        latest_spellings(searches, user)
        .withColumn("position", F.row_number().over(newest))
        .where(F.col("position") <= keep)
        .select(user, "position", "text", "ts", "event_id")
    )


def suggestions(
    history: DataFrame, tags: DataFrame, query: str, user: str = "user_id",
    recent_limit: int = RECENT_LIMIT, tag_limit: int = TAG_LIMIT,
) -> DataFrame:
    """(user, source, position, title) for a typed query.

    Matching recent searches come first, then tags not among them; equality
    ignores case. At most `tag_limit` tags are suggested, so repeating them for
    every user stays small.
    """
    wanted = query.strip().casefold()
    matching = history.withColumn("key", casefold("text"))
    if wanted:
        matching = matching.where(F.col("key").contains(wanted))
    newest = Window.partitionBy(user).orderBy("position")
    recent = (
        matching.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= max(0, recent_limit))
        .select(user, F.lit(RECENT).alias("source"), F.col("_n").alias("position"), F.col("text").alias("title"), "key")
    )
    out = recent.drop("key")
    if not wanted or tag_limit <= 0:
        return out
    found = [r["name"] for r in search_tags(tags, query, tag_limit).select("name").collect()]
    listed = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(n).alias("title"), F.lit(n.casefold()).alias("key")) for i, n in enumerate(found)])
    if not found:
        return out
    offered = history.select(user).distinct().select(user, F.explode(listed).alias("t")).select(user, "t.*")
    fresh = offered.join(recent.select(user, "key"), [user, "key"], "left_anti")
    return out.unionByName(fresh.select(user, F.lit(TAG).alias("source"), "position", "title"))
