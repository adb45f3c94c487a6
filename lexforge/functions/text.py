"""Text expressions: normal forms, tokenisers, keys.

Everything stays in the JVM as regular expressions with explicit classes, except NFC, for
which Spark has no expression: only texts with characters outside the composed Latin range
cross to Python, in Arrow batches.  Null gives null; the empty string gives '' or an empty array.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space, letters or digits, letters or number signs, digits.
SPACE = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ALNUM = r"[\p{L}\p{N}]"
ALPHA = r"[\p{L}\p{Nl}\p{No}]"
DIGIT = r"\p{Nd}"

# The token patterns, whose order of alternatives decides.
#: Legal tokens: codes, dates, slashed and grouped numbers, numbers with letters, joined words, marks.
LEGAL_TOKEN = (
    rf"({DIGIT}+(?:/{DIGIT}+)+/{ALPHA}+(?:-{ALPHA}+)+"
    rf"|{DIGIT}{{1,2}}[-/]{DIGIT}{{1,2}}[-/]{DIGIT}{{2,4}}"
    rf"|{DIGIT}+(?:/{DIGIT}+)+"
    rf"|{DIGIT}+{ALPHA}+"
    rf"|{DIGIT}+(?:[.,]{DIGIT}+)*"
    rf"|{ALNUM}+(?:[-']{ALNUM}+)*"
    rf"|[^\p{{L}}\p{{N}}_{SPACE}]|_)"
)
#: Evaluation tokens: slashed codes, joined words, marks.
EVAL_TOKEN = rf"({DIGIT}+(?:/{DIGIT}+)+(?:/[^{SPACE},.;:!?()\[\]{{}}\"'…]+)?|{ALNUM}+(?:[-']{ALNUM}+)*|[^\p{{L}}\p{{N}}_{SPACE}]|_)"
#: Reader tokens: runs of word characters.
WORD_TOKEN = r"([\p{L}\p{N}_]+)"

#: Texts of these characters only are composed already.
COMPOSED = r"^[\x00-\x{2ff}\x{1ea0}-\x{1ef9}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{fffd}]*$"


@F.pandas_udf(StringType())
def _nfc_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: unicodedata.normalize("NFC", x) if x is not None else None)


def nfc(text: Column) -> Column:
    """Canonical composition."""
    return F.coalesce(_nfc_udf(F.when(~text.rlike(COMPOSED), text)), text)


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def strip(text: Column) -> Column:
    """No white space (of any kind) at the ends."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def retrieval_text(text: Column) -> Column:
    return squeeze(nfc(text))


def legal_tokens(text: Column) -> Column:
    """Tokens for retrieval; case is kept."""
    return F.regexp_extract_all(retrieval_text(text), F.lit(LEGAL_TOKEN), F.lit(1))


def eval_text(text: Column) -> Column:
    """NFC, line ends as LF, no white space at the ends; inner blanks are kept."""
    return strip(F.regexp_replace(nfc(text), r"\r\n?", "\n"))


def eval_tokens(text: Column) -> Column:
    return F.regexp_extract_all(eval_text(text), F.lit(EVAL_TOKEN), F.lit(1))


def fold(text: Column) -> Column:
    """Case folding; beyond lower case only the sharp s needs care."""
    return F.regexp_replace(F.lower(text), "ß", "ss")


def word_tokens(text: Column) -> Column:
    """Folded word runs, as the extractive reader sees them."""
    return F.regexp_extract_all(fold(text), F.lit(WORD_TOKEN), F.lit(1))


def dedup_key(text: Column) -> Column:
    """The key under which two chunks or questions are the same: composed, squeezed, folded."""
    return fold(retrieval_text(text))


def bounded_preview(text: Column, limit: int = 240) -> Column:
    """One line of at most ``limit`` characters, cut with three dots."""
    line = squeeze(text)
    return F.when(F.length(line) > limit, F.concat(F.regexp_replace(F.substring(line, 1, limit - 3), rf"[{SPACE}]+\z", ""), F.lit("..."))).otherwise(line)
