"""Quality rules: a table of thresholds compiled into one projection, without user functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import BLANKS, computed_once

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was as with be by are this at from or an have not you which his he they we "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es er hat dass sie nach wird bei "
    "de la le et les un du une que est pour qui dans par plus pas au sur ne se ce il sont "
    "el los y del las por con no su para al lo como más o pero"
).split()
# The symbols of the contract.
SYMBOLS = "#*$%&|<>"

# (rule, measure, least, most); None leaves a side open.
THRESHOLDS: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("length", "n_words", 50, None),
    ("word_length", "mean_word_chars", 3.0, 10.0),
    ("symbols", "symbols_per_word", None, 0.1),
    ("stop_words", "stop_word_ratio", 0.06, None),
    ("letters", "letter_word_ratio", 0.8, None),
    ("repeated_lines", "dup_line_ratio", None, 0.4),
    ("repeated_words", "repeat_word_ratio", None, 0.5),
)


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))


def _word_counts(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """One projection after another over the text, its words and its three-word windows; rows stay in place."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: _trimmed(x) != "")
    none = F.array().cast("array<string>")
    named = docs.select(*carry, F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    words = F.when(_trimmed(F.col("text")) == "", none).otherwise(F.split(_trimmed(F.col("text")), BLANKS))
    split = computed_once(named, words=words, lines=lines)
    w = F.col("words")
    at = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    # Windows as (hash, place), sorted: equal windows are neighbours.
    windows = F.sort_array(F.transform(at, lambda i: F.struct(
        F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))
    s = F.col("windows")
    again = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    counted = computed_once(split, windows=windows).select(
        *carry, "doc_id", F.size("words").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).alias("n_stop"),
        F.size(F.filter(w, lambda x: F.lower(x) != F.upper(x))).alias("n_letter"),
        F.size(covered).cast("long").alias("n_repeat_words"),
    )
    return computed_once(counted.select(*carry, F.struct(*[c for c in counted.columns if c not in carry]).alias("counts")), row=F.col("counts")).select(
        *carry, "row.*")


def assess(
    docs: DataFrame, thresholds: Sequence[tuple[str, str, float | None, float | None]] = THRESHOLDS,
    id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (),
) -> DataFrame:
    """Counts, ratios and verdict of each document, in one pass without shuffle.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, failed (names of the rules missed), then those named in `carry`. A null text has no words
    and fails `length`; ratios of a text without words are 0. Rows stay as they are,
    repeated ones and null ids included; other columns are ignored. Texts are read
    whole, and sorting a text's windows takes n log n steps, however long it is.
    """
    n = F.greatest("n_words", F.lit(1))
    measures = _word_counts(docs, id_col, text_col, list(carry)).withColumns({
        "mean_word_chars": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "stop_word_ratio": F.col("n_stop") / n,
        "letter_word_ratio": F.col("n_letter") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeat_word_ratio": F.col("n_repeat_words") / n,
    })
    missed = []
    for rule, measure, least, most in thresholds:
        out = F.lit(False)
        if least is not None:
            out = out | (F.col(measure) < least)
        if most is not None:
            out = out | (F.col(measure) > most)
        missed.append(F.when(out, F.lit(rule)))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.array_compact(F.array(*missed)) if missed else F.array().cast("array<string>")
    return measures.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & (F.size(failed) == 0)).alias("kept"), failed.alias("failed"), *carry,
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns as they are, that keep to every rule."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col), F.col(text_col))
    return assess(whole, id_col=id_col, text_col=text_col, carry=["_row"]).where("kept").select("_row.*")


def _sql_rule(measure: str, least: float | None, most: float | None) -> str:
    sides = [f"{measure} < {least}"] * (least is not None) + [f"{measure} > {most}"] * (most is not None)
    return "(" + " OR ".join(sides or ["false"]) + ")"


SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
tri AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)}))) AS n_stop,
         len(list_filter(w, lambda x: lower(x) <> upper(x))) AS n_letter
  FROM d LEFT JOIN cov USING (doc_id)),
r AS (
  SELECT *, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbols_per_word,
         n_stop / greatest(n_words, 1) AS stop_word_ratio, n_letter / greatest(n_words, 1) AS letter_word_ratio,
         n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, n_repeat_words / greatest(n_words, 1) AS repeat_word_ratio,
         (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({" OR ".join(_sql_rule(*t[1:]) for t in THRESHOLDS)}) AS kept
FROM r
"""
