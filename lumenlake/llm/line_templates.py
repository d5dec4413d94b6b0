"""Line dedup by a log-template tree of fixed depth: token count, leading tokens, then merging by position.

A line's fields of known form (links, mail addresses, numbers) are generalised first.
Lines with the same number of tokens and the same leading tokens lie in one node of
the tree. In a node, a line that agrees with the node's most common line in enough
of the positions behind the leading tokens joins its template: the positions in
which lines of a template differ are its variable fields. Lines are first merged
with those that also share the last token, then over the whole node, so that a
field may lie anywhere behind the leading tokens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import BLANKS, computed_once, discard, stored
from lumenlake.operators.ordering import skew_safe_lookup

# Variable fields by form, in the order in which they are generalised.
URL = r"[A-Za-z]+://[^\x20\x09-\x0D]+"
MAIL = r"[^\x20\x09-\x0D@]+@[^\x20\x09-\x0D@]+"
NUMBER = r"[0-9]+([.,:/-][0-9]+)*"
FIELD = "<*>"
# Leading tokens that are levels of the tree of their own.
LEADING = 3
# Tenths of the positions behind the leading tokens in which a line must agree with the line it joins.
AGREE = 7
# A template recurs in at least so many different texts if it has more tokens than a fragment,
MIN_TEXTS = 10
FRAGMENT = 2
# or in two or more texts that hold at least so many tokens of it in all.
MIN_TOKENS = 100


def template(line: Column) -> Column:
    """The line with fields generalised and blanks made even; empty for a line without a token."""
    out = F.when(F.contains(line, F.lit("://")), F.regexp_replace(line, URL, FIELD)).otherwise(line)
    out = F.when(F.contains(out, F.lit("@")), F.regexp_replace(out, MAIL, FIELD)).otherwise(out)
    return F.btrim(F.regexp_replace(F.regexp_replace(out, NUMBER, FIELD), BLANKS, " "))


_NODE = ["n_tokens", "lead"]
_LEAF = [*_NODE, "leaf"]


def _recurs(n_tokens: Column, texts: Column, min_texts: int, min_tokens: int) -> Column:
    return ((texts >= min_texts) & (n_tokens > FRAGMENT)) | ((texts >= 2) & (n_tokens * texts >= min_tokens))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, place, leaf of the tree, template) of each line with a token."""
    templates = F.transform(F.split("text", "\n"), template)
    shaped = docs.select("doc_id", "text_hash", F.posexplode(templates).alias("place", "template")).where("template <> ''")
    tokens = F.split("template", " ")
    # Two independent hashes and the count stand for the path, so shuffled rows stay small.
    return shaped.select(
        "doc_id", "text_hash", "place", F.size(tokens).alias("n_tokens"),
        F.xxhash64(F.slice(tokens, 1, LEADING)).alias("lead"), F.xxhash64(F.reverse("template"), "template").alias("leaf"), "template",
    )


def _joined(live: DataFrame, branch: Column, scratch: list[str]) -> DataFrame:
    """(leaf, top) of leaves that agree with the most common leaf `top` of their branch of the node, without that one."""
    keys = [*_NODE, "branch"]
    placed = live.withColumn("branch", branch)
    best = placed.groupBy(*keys).agg(
        F.max(F.struct("texts", "template", "leaf")).alias("best"), F.count(F.lit(1)).alias("leaves")).where("leaves > 1")
    best = stored(best.select(*keys, F.col("best.leaf").alias("top"), F.col("best.template").alias("model"), "leaves"), scratch)
    pairs = skew_safe_lookup(placed, best.drop("leaves"), keys, "leaf", best, "leaves").where("leaf <> top")
    same = F.size(F.filter(F.zip_with(F.split("template", " "), F.split("model", " "), lambda a, b: a == b), lambda equal: equal))
    agrees = (same - LEADING) * 10 >= (F.col("n_tokens") - LEADING) * AGREE
    return stored(pairs.where(agrees).select(*_LEAF, "top"), scratch)


def _merged(lines: DataFrame, leaves: DataFrame, min_texts: int, min_tokens: int, scratch: list[str]) -> DataFrame:
    """(leaf, top): leaves of templates that hold several leaves, with the leaf that names the template."""
    # Only nodes with several leaves in which a template can recur, of lines long enough to differ in a position.
    nodes = stored(
        leaves.groupBy(*_NODE).agg(F.count(F.lit(1)).alias("leaves"), F.sum("texts").alias("texts"))
        .where((F.col("leaves") > 1) & ((F.col("n_tokens") - LEADING) * (10 - AGREE) >= 10)
               & _recurs(F.col("n_tokens"), F.col("texts"), min_texts, min_tokens)), scratch)
    open_leaves = stored(skew_safe_lookup(leaves, nodes.select(*_NODE), _NODE, "leaf", nodes, "leaves"), scratch)
    # The wording of a leaf is that of its first document: other occurrences go before the last shuffle.
    known = open_leaves.select(*_LEAF, "texts", "first")
    spelled = skew_safe_lookup(lines.select(*_LEAF, "doc_id", "template"), known, _LEAF, "doc_id", open_leaves, "rows")
    live = stored(
        spelled.where(F.col("doc_id").eqNullSafe(F.col("first"))).select(*_LEAF, "texts", "template").dropDuplicates(_LEAF), scratch)
    near = _joined(live, F.substring_index("template", " ", -1), scratch)
    wide = _joined(live.join(near, _LEAF, "left_anti"), F.lit(""), scratch)
    # A leaf that others joined may have joined another one itself.
    onward = wide.select(*_NODE, F.col("leaf").alias("top"), F.col("top").alias("beyond"))
    moved = near.join(onward, [*_NODE, "top"], "left").select(*_LEAF, F.coalesce("beyond", "top").alias("top")).unionByName(wide)
    tops = moved.select(*_NODE, F.col("top").alias("leaf"), "top").distinct()
    return stored(moved.unionByName(tops), scratch)


def drop_recurring(
    docs: DataFrame, min_texts: int = MIN_TEXTS, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (),
    min_tokens: int = MIN_TOKENS,
) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped), then columns named in `carry`: documents without lines whose template recurs across documents.

    A template of more than `FRAGMENT` tokens recurs if at least `min_texts` different
    texts hold it; one of any length if two or more texts hold `min_tokens` tokens of it
    in all, so a passage of 50 words recurs from two texts on. Exact copies of a text
    count once. The document with the smallest id keeps its lines of the template, all
    other documents lose them. Lines without a token stay. Fields are numbers, dates,
    times, addresses and links, and words in which the lines of a template differ: up to
    three in ten behind the leading tokens. One row per input row; a null text counts as
    empty, repeated rows are treated alike, rows with a null id never count as the first,
    other columns are ignored. DataFrame functions only.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    known = docs.select(*carry, F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    scratch: list[str] = []
    # Templates are worked out once; hashes and places are a small part of the text.
    lines = stored(_lines(known), scratch)
    # Once per text, then once per template: partial sums keep a hot template small before each shuffle.
    per_text = stored(lines.groupBy(*_LEAF, "text_hash").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), scratch)
    leaves = stored(
        per_text.groupBy(*_LEAF).agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first"), F.sum("rows").alias("rows")), scratch)
    merged = _merged(lines, leaves, min_texts, min_tokens, scratch)
    # A text that holds several lines of a template counts once for it.
    held = skew_safe_lookup(per_text.drop("rows"), merged, _LEAF, "text_hash", leaves, "texts")
    templates = held.groupBy(*_NODE, "top", "text_hash").agg(F.min("first").alias("first")).groupBy(*_NODE, "top").agg(
        F.count(F.lit(1)).alias("all_texts"), F.min("first").alias("all_first"))
    members = merged.groupBy(*_NODE, "top").agg(F.count(F.lit(1)).alias("leaves"))
    wide = skew_safe_lookup(merged, templates, [*_NODE, "top"], "leaf", members, "leaves").drop("top")
    single = F.col("all_texts").isNull()
    recurring = stored(
        leaves.join(wide, _LEAF, "left").select(
            *_LEAF, "rows", F.when(single, F.col("texts")).otherwise(F.col("all_texts")).alias("texts"),
            F.when(single, F.col("first")).otherwise(F.col("all_first")).alias("first"))
        .where(_recurs(F.col("n_tokens"), F.col("texts"), min_texts, min_tokens)), scratch)
    # A template with more than a thousandth of the recurring lines is split over tasks.
    hits = skew_safe_lookup(lines.drop("template"), recurring.select(*_LEAF, "first"), _LEAF, "doc_id", recurring, "rows")
    gone = stored(
        hits.where(~F.col("doc_id").eqNullSafe(F.col("first")))
        .groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("places")), [])
    discard(docs.sparkSession, scratch)
    joined = known.alias("k").join(gone.alias("g"), F.expr("k.doc_id <=> g.doc_id AND k.text_hash = g.text_hash"), "left")
    split = computed_once(joined.select(*[f"k.{c}" for c in carry], "k.doc_id", "k.text", "g.places"), lines=F.split("text", "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("places"))
    rest = F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n")
    return split.select(
        "doc_id", F.when(F.col("places").isNull(), F.col("text")).otherwise(rest).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"), *carry,
    )


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows of `docs` with recurring lines taken out of the text; `chars_col`, if given, gets the new length."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    new = {text_col: F.col("text"), chars_col: F.char_length("text").cast("long")}
    done = drop_recurring(whole, carry=["_row"])
    return done.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


SQL = rf"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
t AS (
  SELECT doc_id, text, place, line, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
           line, '{URL}', '{FIELD}', 'g'), '{MAIL}', '{FIELD}', 'g'), '{NUMBER}', '{FIELD}', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS template
  FROM l),
u AS (
  SELECT template, string_split(template, ' ') AS toks, len(string_split(template, ' ')) AS k,
         list_slice(string_split(template, ' '), 1, {LEADING}) AS lead, count(DISTINCT text) AS texts
  FROM t WHERE template <> '' GROUP BY template),
b1 AS (
  SELECT template, toks, k, first_value(template) OVER w AS top, first_value(toks) OVER w AS model FROM u
  WINDOW w AS (PARTITION BY k, lead, toks[-1] ORDER BY texts DESC, template DESC)),
m1 AS (
  SELECT template, top FROM b1
  WHERE template <> top AND (len(list_filter(range(1, k + 1), lambda i: toks[i] = model[i])) - {LEADING}) * 10 >= (k - {LEADING}) * {AGREE}),
b2 AS (
  SELECT template, toks, k, first_value(template) OVER w AS top, first_value(toks) OVER w AS model
  FROM u ANTI JOIN m1 USING (template) WINDOW w AS (PARTITION BY k, lead ORDER BY texts DESC, template DESC)),
m2 AS (
  SELECT template, top FROM b2
  WHERE template <> top AND (len(list_filter(range(1, k + 1), lambda i: toks[i] = model[i])) - {LEADING}) * 10 >= (k - {LEADING}) * {AGREE}),
f AS (
  SELECT m1.template, coalesce(m2.top, m1.top) AS top FROM m1 LEFT JOIN m2 ON m1.top = m2.template
  UNION ALL SELECT template, top FROM m2),
g AS (SELECT t.*, coalesce(f.top, t.template) AS top FROM t LEFT JOIN f USING (template)),
r AS (
  SELECT top, min(doc_id) AS first FROM g WHERE top <> '' GROUP BY top
  HAVING (count(DISTINCT text) >= {MIN_TEXTS} AND len(string_split(top, ' ')) > {FRAGMENT})
      OR (count(DISTINCT text) >= 2 AND count(DISTINCT text) * len(string_split(top, ' ')) >= {MIN_TOKENS})),
k AS (SELECT g.*, (r.first IS NOT NULL AND r.first <> doc_id) AS gone FROM g LEFT JOIN r USING (top))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""
