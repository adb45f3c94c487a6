"""Problem 2: items above a size limit, cut into overlapping pieces at natural boundaries.

Every unit (a code point, a word, a byte) has a size; the prefix sums of the sizes and the
sorted offsets of the boundaries are arrays, and each cut is a binary search: the last
boundary of the strongest kind that fills enough of the piece, else of a weaker kind, else
a hard cut at the limit.  The next piece starts exactly ``overlap`` before the cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import latest, table

#: Boundary kinds from strongest to weakest; a match's end (or start, for units) is the cut.
_UNIT = re.compile(r"(?im)^[ \t]*(?:điều\b|article\b|chương\b|mục\b|khoản\b|\d{1,3}[.)](?!\d)|[a-zđ]\))")
_LINE = re.compile(r"\n+")
_SENTENCE = re.compile(r"[.!?…;]+[\"”’)\]]*\s+(?=\S)")
_BLANK = re.compile(r"\s+")
KINDS = ("unit", "line", "sentence", "blank", "hard")


def boundaries(text: str) -> list[np.ndarray]:
    """Sorted offsets at which the text may be cut, by kind."""
    return [
        np.array([m.start() for m in _UNIT.finditer(text)], dtype=np.int64),
        np.array([m.end() for m in _LINE.finditer(text)], dtype=np.int64),
        np.array([m.end() for m in _SENTENCE.finditer(text)], dtype=np.int64),
        np.array([m.end() for m in _BLANK.finditer(text)], dtype=np.int64),
    ]


def prefix_sizes(text: str, unit: str) -> np.ndarray:
    """Size of the first i code points, for i from 0 to the length."""
    if unit == "chars":
        return np.arange(len(text) + 1, dtype=np.int64)
    if unit == "bytes":
        size = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        each = 1 + (size > 0x7F) + (size > 0x7FF) + (size > 0xFFFF)
    elif unit == "words":
        each = np.zeros(len(text), dtype=np.int64)
        for m in re.finditer(r"\S+", text):
            each[m.start()] = 1
    else:
        raise ValueError(f"unknown unit {unit!r}")
    return np.concatenate([[0], np.cumsum(each)]).astype(np.int64)


def pieces(text: str, max_size: int, overlap: int, unit: str = "chars", fill: float = 0.5) -> list[tuple[int, int, str]]:
    """(start, end, kind of cut) of each piece; one piece if the text fits.

    A boundary is preferred by kind if the piece keeps at least ``fill`` of the limit; else
    the last boundary of any kind is taken, and without one the cut is hard.  A piece always
    ends behind the overlap, so that every piece makes progress.
    """
    if not 0 <= overlap < max_size:
        raise ValueError("overlap must be at least 0 and below max_size")
    total = prefix_sizes(text, unit)
    n, start, out = len(text), 0, []
    at = boundaries(text) if total[-1] > max_size else []
    while total[n] - total[start] > max_size:
        limit = int(np.searchsorted(total, total[start] + max_size, side="right")) - 1
        floor = int(np.searchsorted(total, total[start] + max(int(max_size * fill), overlap + 1), side="left"))
        end, kind = max(limit, start + 1), "hard"
        for name, offsets in zip(KINDS, at):
            i = int(np.searchsorted(offsets, limit, side="right")) - 1
            if i >= 0 and offsets[i] >= floor and offsets[i] > start:
                end, kind = int(offsets[i]), name
                break
        else:  # the last boundary of any kind behind the overlap, before a hard cut
            behind = int(np.searchsorted(total, total[start] + overlap + 1, side="left"))
            for name, offsets in zip(KINDS, at):
                i = int(np.searchsorted(offsets, limit, side="right")) - 1
                if i >= 0 and offsets[i] >= behind and offsets[i] > start and (kind == "hard" or offsets[i] > end):
                    end, kind = int(offsets[i]), name
        out.append((start, end, kind))
        back = int(np.searchsorted(total, total[end] - overlap, side="right")) - 1
        start = back if back > start else end
    out.append((start, n, "end"))
    return out


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [
            (kind, id_, number, start, end, cut, text[start:end])
            for kind, id_, text, limit, overlap, unit in zip(frame["kind"], frame["id"], frame["text"], frame["max_size"], frame["overlap_size"], frame["unit"])
            for number, (start, end, cut) in enumerate(pieces(text, limit, overlap, unit))
        ]
        yield pd.DataFrame(rows, columns=["kind", "id", "piece", "start_offset", "end_offset", "cut", "text"])


def _may_exceed():
    """Whether a text can be above its limit: by its bytes, or its code points, a bound for words."""
    return F.when(F.col("unit") == "bytes", F.octet_length("text")).otherwise(F.length("text")) > F.col("max_size")


def split_items(items: DataFrame) -> DataFrame:
    """Operator: rows (kind, id, text, unit, max_size, overlap_size) -> ordered pieces of the oversized ones.

    Null and fitting texts give no rows.  Only oversized texts (by code points, a bound for
    words) reach Python; no shuffle.
    """
    over = items.where(_may_exceed())
    return over.select("kind", "id", "text", "max_size", "overlap_size", "unit").mapInPandas(
        _cut, "kind string, id string, piece int, start_offset int, end_offset int, cut string, text string"
    )


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Passages and raw texts above the limits of split_limits (two rows, fixed: broadcast), each key once."""
    named = table(spark, folder, "split_limits").where("field in ('legal_documents.passage', 'legal_chunks.raw_text')")
    limits = F.broadcast(latest(named, ["field"], None))  # one row per field, two at most
    d = table(spark, folder, "legal_documents").select(
        F.lit("legal_documents.passage").alias("field"), F.lit("document").alias("kind"), "id", F.col("passage").alias("text"), "received_at"
    )
    c = table(spark, folder, "legal_chunks").select(
        F.lit("legal_chunks.raw_text").alias("field"), F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"), F.col("raw_text").alias("text"),
        F.lit(None).cast("timestamp").alias("received_at"),
    )
    over = d.unionByName(c).join(limits, "field").where(_may_exceed())
    return latest(over, ["kind", "id"])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return split_items(items(spark, folder)).where("piece = 0").select("kind", "id")


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_items(items(spark, folder))
