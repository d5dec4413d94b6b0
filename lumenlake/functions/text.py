"""Text columns: folding, literal and wildcard matching, composition of text blocks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"

# --- fixed values: composition of extracted text -----------------------------
TEXT_PREFIX = "[OCR]"
TEXT_MAX_LENGTH = 4000
MIN_SCORE = 0.80
# Han, kana and hangul ranges after which no space is set.
NO_SPACE_AFTER = "[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{3040}-\\x{30FF}\\x{AC00}-\\x{D7AF}]$"
# -----------------------------------------------------------------------------

# White space as Python's str.strip sees it.
_SPACE = "[\\s\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Remove Unicode white space at both ends; `trim` only removes blanks."""
    return F.regexp_replace(_col(c), f"^{_SPACE}+|{_SPACE}+$", "")


def ascii_fold(c: str | Column) -> Column:
    """Lower-case A-Z only, the case rule of the stores' LIKE."""
    return F.translate(_col(c), _UPPER, _LOWER)


def ascii_fold_text(text: str) -> str:
    return text.translate(str.maketrans(_UPPER, _LOWER))


def contains_literal(c: str | Column, query: str) -> Column:
    """Literal substring, ASCII case ignored; a blank query matches nothing, nor does null."""
    query = query.strip()
    if not query:
        return F.lit(False)
    # The flag folds A-Z only; the query is quoted, so every character is literal.
    quoted = query.replace("\\E", "\\E\\\\E\\Q")
    return F.coalesce(_col(c).rlike(f"(?i)\\Q{quoted}\\E"), F.lit(False))


def like_wildcard(c: str | Column, query: str) -> Column:
    """Substring match in which `%` and `_` of the query stay wildcards."""
    pattern = "%" + ascii_fold_text(query).replace("\\", "\\\\") + "%"
    return F.coalesce(ascii_fold(c).like(pattern), F.lit(False))


@F.pandas_udf(T.StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.map(str.casefold, na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda v: unicodedata.normalize("NFC", v).casefold(), na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


def _ascii_or(c: str | Column, in_ascii, udf) -> Column:
    """Built-in expression for pure ASCII text; only other texts are sent to Python."""
    c = _col(c)
    is_ascii = c.rlike("^\\p{ASCII}*$")
    return F.coalesce(F.when(is_ascii, in_ascii(c)), udf(F.when(~is_ascii, c)))


def casefold(c: str | Column) -> Column:
    """Unicode casefold; Spark has no built-in for it."""
    return _ascii_or(c, F.lower, _casefold)


def collision_key(c: str | Column) -> Column:
    """NFC + casefold key under which two file names collide (F2)."""
    return _ascii_or(c, F.lower, _nfc_casefold)


def nfc(c: str | Column) -> Column:
    """Unicode NFC form."""
    return _ascii_or(c, lambda v: v, _nfc)


def contains_casefold(c: str | Column, query: str) -> Column:
    """Substring under Unicode casefold; a blank query keeps every row."""
    query = query.strip().casefold()
    if not query:
        return F.lit(True)
    return F.coalesce(casefold(c).contains(query), F.lit(False))


def compose_text(blocks: str | Column) -> Column:
    """One text from recognised blocks array<struct<text, score>>.

    Blank blocks and scores up to 0.80 are dropped; blocks are joined by a space
    unless the text so far ends in a Han, kana or hangul character.
    """
    texts = F.transform(
        F.filter(_col(blocks), lambda b: (b["score"] > MIN_SCORE) & (strip(b["text"]) != "")), lambda b: strip(b["text"])
    )

    def append(body: Column, text: Column) -> Column:
        glued = (body == "") | body.rlike(NO_SPACE_AFTER)
        return F.concat(body, F.when(glued, F.lit("")).otherwise(F.lit(" ")), text)

    body = F.aggregate(texts, F.lit(""), append)
    return F.when(body != "", F.concat(F.lit(TEXT_PREFIX), F.substring(body, 1, TEXT_MAX_LENGTH)))
