"""Boolean tag predicates.

`has_tag("A") & ~has_tag("C")` builds a predicate. For a library only the links
of the named tags are read: one grouping gives each image a flag per name, and
the predicate becomes one Spark filter over the flags.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.operators.ordering import newest_first
from lumenlake.operators.search import search_file_name, search_tag_name, search_text


class TagExpressionError(ValueError):
    """The text is not a tag expression."""


@dataclass(frozen=True)
class TagPredicate:
    """Names used, and Spark SQL text over one flag column `t<i>` per name."""

    names: tuple[str, ...]
    sql: str

    def _combine(self, other: TagPredicate, word: str) -> TagPredicate:
        names = tuple(dict.fromkeys(self.names + other.names))
        return TagPredicate(names, f"(({self._over(names)}) {word} ({other._over(names)}))")

    def _over(self, names: tuple[str, ...]) -> str:
        return re.sub(r"`t(\d+)`", lambda m: f"`t{names.index(self.names[int(m[1])])}`", self.sql)

    def __and__(self, other: TagPredicate) -> TagPredicate:
        return self._combine(other, "AND")

    def __or__(self, other: TagPredicate) -> TagPredicate:
        return self._combine(other, "OR")

    def __invert__(self) -> TagPredicate:
        return TagPredicate(self.names, f"(! ({self.sql}))")

    def column(self) -> Column:
        return F.expr(self.sql)


def has_tag(name: str) -> TagPredicate:
    """The image carries an enabled tag of exactly this name."""
    return TagPredicate((name,), "`t0`")


# The words and signs of the text form.
_WORDS = {"and": " AND ", "or": " OR ", "not": " ! "}
_SIGNS = {"*": " AND ", "&": " AND ", "+": " OR ", "|": " OR ", "~": " ! ", "!": " ! ", "(": "(", ")": ")", "[": "(", "]": ")"}
_CONSTANTS = ("true", "false", "none", "1", "0")
_LEAF = re.compile(r'"((?:[^"]|"")*)"|([^\W_][\w.:]*|_[\w.:]*)|([*&+|~!()\[\]])|(\s+)|(.)', re.DOTALL)


def parse_tags(text: str) -> TagPredicate | None:
    """Text form of a predicate, None when blank; Spark's own parser checks the structure."""
    if not text.strip():
        return None
    names: dict[str, int] = {}

    def leaf(name: str) -> str:
        return f"`t{names.setdefault(name, len(names))}`"

    def rewrite(m: re.Match) -> str:
        quoted, word, sign, blank, other = m.groups()
        if quoted is not None:
            return leaf(quoted.replace('""', '"'))
        if word is not None:
            if word.lower() in _CONSTANTS:
                raise TagExpressionError(f"constant {word!r} is not allowed; quote a tag of this name")
            return _WORDS.get(word.lower()) or leaf(word)
        if sign is not None:
            return _SIGNS[sign]
        if blank is not None:
            return " "
        raise TagExpressionError(f"unexpected {other!r}")

    sql = _LEAF.sub(rewrite, text)
    # Spark reads a second name as an alias, a name before "(" as a call, and a
    # word without operands as a name; none of these is a tag expression.
    shape = re.sub(r"`t\d+`", "`", sql)
    if re.search(r"[`)]\s*[`(!]|(^|\(|AND|OR|!)\s*(AND|OR)|(AND|OR|!)\s*(\)|$)", shape):
        raise TagExpressionError(f"a name or an operator is missing: {text!r}")
    sql = f"({sql})"
    flags = [F.lit(True).alias(f"t{i}") for i in range(len(names))]
    try:
        # Analysed against an empty frame, so that a bad structure shows here.
        SparkSession.active().range(0).select(*flags).where(F.expr(sql))
    except (ParseException, AnalysisException) as e:
        raise TagExpressionError(f"not a tag expression: {text!r}") from e
    return TagPredicate(tuple(names), sql)


def tag_flags(image_ids: DataFrame, tags: DataFrame, links: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """One row per image id with a boolean `t<i>` per name; disabled and unknown tags are false.

    Several tags may share a name: an image with any of them has it.
    """
    wanted = tags.where(F.col("enabled") & F.col("name").isin(*names)).select(F.col("id").alias("tag_id"), "name")
    flags = [F.max(F.col("name") == n).alias(f"t{i}") for i, n in enumerate(names)]
    carried = links.join(wanted, "tag_id").groupBy(F.col("image_id").alias("id")).agg(*flags)
    joined = image_ids.join(carried, "id", "left")
    return joined.select(*image_ids.columns, *[F.coalesce(f"t{i}", F.lit(False)).alias(f"t{i}") for i in range(len(names))])


def filter_by_tags(images: DataFrame, tags: DataFrame, links: DataFrame, predicate: TagPredicate) -> DataFrame:
    """Images satisfying the predicate; an unknown tag is false, so its negation holds for all."""
    return tag_flags(images, tags, links, predicate.names).where(predicate.column()).select(*images.columns)


def search_tag_expression(images: DataFrame, tags: DataFrame, links: DataFrame, expression: str | TagPredicate) -> DataFrame:
    """Tag-expression search, newest first; a blank text finds nothing."""
    predicate = parse_tags(expression) if isinstance(expression, str) else expression
    if predicate is None:
        return images.where(F.lit(False))
    return newest_first(filter_by_tags(images, tags, links, predicate))


def run_search(kind: str, query: str, images: DataFrame, tags: DataFrame, links: DataFrame) -> DataFrame:
    """The search of the given kind: tag, text, filename or advanced (a tag expression)."""
    if kind == "tag":
        return search_tag_name(images, tags, links, query)
    if kind == "text":
        return search_text(images, query)
    if kind == "filename":
        return search_file_name(images, query)
    if kind == "advanced":
        return search_tag_expression(images, tags, links, query)
    raise ValueError(f"unknown search kind {kind!r}")
