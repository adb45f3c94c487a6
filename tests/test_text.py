import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexforge.functions import text as X
from lexforge.operators.prompting import clean_answer


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_legal_tokens_keep_codes_numbers_and_case(spark):
    got = one(spark, "Theo 153/2020/NĐ-CP, ngày 01/02/2020: 10.000.000 đồng (5%) 2a x_y", X.legal_tokens)
    assert got == ["Theo", "153/2020/NĐ-CP", ",", "ngày", "01/02/2020", ":", "10.000.000", "đồng", "(", "5", "%", ")", "2a", "x", "_", "y"]


def test_eval_tokens_differ_from_legal_tokens(spark):
    assert one(spark, "2-3 10.000", X.eval_tokens) == ["2-3", "10", ".", "000"]
    assert one(spark, "2-3 10.000", X.legal_tokens) == ["2", "-", "3", "10.000"]


@pytest.mark.parametrize("text", ["Điều 1", "  a  b \n", "", "Ａ b"])
def test_retrieval_text_is_nfc_with_single_blanks(spark, text):
    expected = re.sub(r"\s+", " ", unicodedata.normalize("NFC", text)).strip()
    assert one(spark, text, X.retrieval_text) == expected


def test_nulls_stay_null(spark):
    for column in (X.retrieval_text, X.legal_tokens, X.eval_text, X.dedup_key, clean_answer):
        assert one(spark, None, column) is None


def test_preview_is_cut_with_dots(spark):
    assert one(spark, "a" * 300, X.bounded_preview) == "a" * 237 + "..."
    assert one(spark, "a\n b", X.bounded_preview) == "a b"


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("```json\nxin\r\nchào\n```", "xin\nchào"),
        ("FINAL_ANSWER: có", "có"),
        ("```\nCÂU TRẢ LỜI: không\n```", "không"),
        ("FINAL_ANSWER: CÂU TRẢ LỜI: ba", "ba"),
        ("FINAL_ANSWER: FINAL_ANSWER: FINAL_ANSWER: x", "FINAL_ANSWER: x"),
        ("``` một", "``` một"),
    ],
)
def test_clean_answer(spark, raw, clean):
    assert one(spark, raw, clean_answer) == clean
