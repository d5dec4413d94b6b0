"""Licence scan: canonical digests of entire texts, joined with those of known licences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.llm.common import computed_once
from lumenlake.llm.license_texts import KNOWN, WHOLE

# Spellings that mean the same in a licence.
SPELLINGS = (
    ("acknowledgment", "acknowledgement"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"), ("emphasised", "emphasized"),
    ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"),
    ("initialise", "initialize"), ("judgment", "judgement"), ("labelling", "labeling"), ("labour", "labor"),
    ("licence", "license"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"),
    ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("noncommercial", "non commercial"),
    ("sublicence", "sublicense"), ("sub license", "sublicense"), ("per cent", "percent"), ("https", "http"),
)
# Lines that name a holder are no part of the licence: 'copyright' with the sign, a year or a name, but not 'copyright notice' and
# the like, with which a wrapped line of a licence begins. The line is cut up to the end of the name's sentence; an initial ends none.
NO_NAME = (
    r"acts?|and|claims?|disclaimers?|for|holders?|in|interests?|is|laws?|licen[cs]es?|licensors?|notices?|of|on|or|owners?|"
    r"ownership|protection|rights?|statements?|terms|the|to|treaty|treaties"
)
HOLDER = (
    r"(?md)^[ \t]*(?:(?:(?i:copyright)[ \t]*[:,]?[ \t]*(?:(?i:\(c\))|©|[0-9]{4}|(?i:by )|(?!(?i:" + NO_NAME + r")\b)\p{Lu})|(?i:\(c\))[ \t]*[0-9]{4}|©)"
    r"[^\n]*?(?:(?=\n|\z)|(?<=[\p{L}\p{N})>]{2})\.(?=[ \t]+\p{Lu}))(?:[. \t]*(?i:all rights reserved)[. \t]*)?|(?i:all rights reserved)[. \t]*$)"
)
# The check SQL takes whole lines; where no line begins with 'copyright', as in the given tables, both say the same.
HOLDER_LINE = r"(?m)^[ \t]*((copyright|\(c\)|©)[^\n]*|all rights reserved[. \t]*)$"
# Everything but letters and digits parts words; letters of all scripts count.
BREAKS = r"[^\p{L}\p{N}]+"

# Tables of known licences up to this many rows are sent to all executors; larger ones are shuffled.
BROADCAST_ROWS = 50_000


def _plain(text: Column) -> Column:
    """Lower case, no holders, one blank for punctuation and white space."""
    return F.btrim(F.regexp_replace(F.lower(F.regexp_replace(text, HOLDER, " ")), BREAKS, " "))


def _spelled(plain: Column) -> Column:
    """One spelling of each word."""
    out = F.concat(F.lit(" "), plain, F.lit(" "))
    for other, chosen in SPELLINGS:
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {chosen} "))
    return F.btrim(out)


def _keys(plain: Column) -> dict[str, Column]:
    """First and last word as spelled in the canonical form: cheap to compare before the whole text is spelled out."""
    return {"first": F.substring_index(_spelled(F.substring_index(plain, " ", 3)), " ", 1),
            "last": F.substring_index(_spelled(F.substring_index(plain, " ", -3)), " ", -1)}


def known_licenses(
    spark: SparkSession, texts: dict[str, tuple[str, ...]] = KNOWN, whole: Sequence[tuple[str, str, str, str]] | None = None
) -> DataFrame:
    """(license, digest, first, last) of the given texts and ready rows; its size is that of the given table.

    The rows `whole` default to the built-in ones where `texts` are, else to none.
    """
    rows = [(name, text) for name, given in texts.items() for text in given]
    plain = spark.createDataFrame(rows, "license string, text string").select("license", _plain(F.col("text")).alias("plain"))
    known = plain.select("license", F.sha2(_spelled(F.col("plain")), 256).alias("digest"), *[
        c.alias(name) for name, c in _keys(F.col("plain")).items()])
    ready = (WHOLE if texts is KNOWN else ()) if whole is None else whole
    return known.unionByName(spark.createDataFrame(list(ready), "license string, digest string, first string, last string")).distinct()


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, notices): the licence that a whole text is, and those that a whole block or line of it is.

    `known` is as from `known_licenses`; a digest stands for one licence (the first by
    name if given several). Blocks are parted by empty lines. `notices` is sorted, without
    repeats, empty where nothing matches. A null or empty text has no licence. Every row
    gives one row, repeated ones and null ids included; other columns are ignored.
    Texts stay where they are: only digests that match are shuffled. A text is spelled
    out and hashed only if its first and last words are those of a known licence.
    """
    one = known.groupBy("digest").agg(F.min("license").alias("license"))
    ends = known.select("first", "last").distinct()
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        one, ends = F.broadcast(one), F.broadcast(ends)
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    blocks = F.col("blocks")
    parts = computed_once(named, blocks=F.split("text", r"\n[ \t\r]*\n")).select(
        "doc_id", "text_hash", F.explode(F.transform(
            F.array_distinct(F.concat(F.array("text"), blocks, F.split("text", "\n"))),
            lambda p: F.struct(p.alias("part"), (p == F.col("text")).alias("whole"), ((p != F.col("text")) | (F.size(blocks) == 1)).alias("inner")),
        )).alias("g")).select("doc_id", "text_hash", "g.*")
    plain = computed_once(parts, plain=_plain(F.col("part"))).drop("part")
    likely = computed_once(plain, **_keys(F.col("plain"))).join(ends, ["first", "last"], "left_semi")
    found = likely.withColumn("digest", F.sha2(_spelled(F.col("plain")), 256)).join(one, "digest").groupBy("doc_id", "text_hash").agg(
        F.min(F.when(F.col("whole"), F.col("license"))).alias("license"),
        F.array_sort(F.collect_set(F.when(F.col("inner"), F.col("license")))).alias("notices"))
    match = (F.col("d.text_hash") == F.col("f.text_hash")) & F.col("d.doc_id").eqNullSafe(F.col("f.doc_id"))
    return named.select("doc_id", "text_hash").alias("d").join(found.alias("f"), match, "left").select(
        "d.doc_id", "f.license", F.coalesce("f.notices", F.array().cast("array<string>")).alias("notices"))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_canonical(text: str) -> str:
    out = f"regexp_replace(regexp_replace(lower({text}), '{HOLDER_LINE}', ' ', 'g'), '{BREAKS}', ' ', 'g')"
    out = f"' ' || trim({out}) || ' '"
    for other, chosen in SPELLINGS:
        out = f"replace({out}, ' {other} ', ' {chosen} ')"
    return f"trim({out})"


SQL = f"""
WITH k(license, raw) AS (VALUES {", ".join(f"({_sql_text(n)}, {_sql_text(t)})" for n, given in KNOWN.items() for t in given)}),
ready(license, digest) AS (VALUES {", ".join(f"({_sql_text(n)}, {_sql_text(d)})" for n, d, _, _ in WHOLE)}),
known AS (
  SELECT digest, min(license) AS license
  FROM (SELECT license, sha256({_sql_canonical("raw")}) AS digest FROM k UNION ALL SELECT license, digest FROM ready) GROUP BY 1),
g AS (
  SELECT doc_id, true AS whole, coalesce(text, '') AS part FROM documents
  UNION ALL SELECT doc_id, false, unnest(string_split(coalesce(text, ''), chr(10))) FROM documents
  UNION ALL SELECT doc_id, false, unnest(string_split_regex(coalesce(text, ''), '\\n[ \\t\\r]*\\n')) FROM documents),
f AS (
  SELECT doc_id, min(license) FILTER (WHERE whole) AS license, list_sort(list(DISTINCT license) FILTER (WHERE NOT whole)) AS notices
  FROM (SELECT doc_id, whole, sha256({_sql_canonical("part")}) AS digest FROM g) JOIN known USING (digest) GROUP BY doc_id)
SELECT doc_id, license, coalesce(notices, []) AS notices FROM documents LEFT JOIN f USING (doc_id)
"""
