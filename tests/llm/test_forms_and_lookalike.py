import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexforge.llm import forms, lookalike


@pytest.mark.parametrize(
    "a, b",
    [
        ("Ｔｈｕ １２％", "Thu 12%"),
        ("a b c　d", "a b c d"),
        ("đ­ấ​t﻿", "đất"),
        ("Ðình Ɖình", "Đình Đình"),
        (unicodedata.normalize("NFD", "Nguyễn ở Huế"), "Nguyễn ở Huế"),
        ("сhо", "cho"),
        ("Хương Тấn", "Xương Tấn"),
        ("Νga Ηồng", "Nga Hồng"),
        ("а) theo mẫu", "a) theo mẫu"),
        ("TT‑CĐ", "TT-CĐ"),
        ("a\r\nb", "a\nb"),
    ],
)
def test_same_look(a, b):
    assert forms.consistent(a) == forms.consistent(b) == b


@pytest.mark.parametrize("a, b", [("Thu", "thu"), ("hoa", "hoà"), ("a b", "a  b"), ("a b", "a\nb"), ("a.", "a"), ("привет", "npuBeT")])
def test_visible_differences_stay(a, b):
    assert forms.consistent(a) != forms.consistent(b)


def test_words_of_another_script_keep_it():
    assert forms.consistent("привет мир, сор") == "привет мир, сор"
    assert forms.consistent("пpивет") == "привет"  # a Latin p in a Cyrillic word


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcđêớ̛́ сοНＡ１ ​ \n\t.‑ÐЖ"), max_size=30))
def test_idempotent_and_plain_texts_unchanged(text):
    once = forms.consistent(text)
    assert forms.consistent(once) == once


def test_operator(spark, rows):
    data = [
        ("question", "1", "Thu phí"), ("question", "2", "Ｔｈｕ phí"), ("question", "3", "Thu phí"), ("question", "3", "Thu phí"),
        ("document", "4", "Thu​ phí"), ("question", "5", None), ("question", "6", ""), ("question", "7", "thu phí"),
    ]
    items = spark.createDataFrame(data, "kind string, id string, text string").withColumn("form2", F.lit(1))
    assert rows(lookalike.same_look(items)) == [("question", "1", "2"), ("question", "2", "3")]
    assert lookalike.same_look(items.limit(0)).count() == 0
    got = {r["id"]: r["form"] for r in lookalike.forms(items).collect()}
    assert got["2"] == "Thu phí" and got["5"] is None and got["6"] == ""


def test_words(spark):
    r = spark.createDataFrame([("Điều 5, TT-CĐ_x",), (None,)], "t string").select(forms.words(F.col("t")).alias("w")).collect()
    assert r[0]["w"] == ["điều", "5", "tt", "cđ", "x"] and r[1]["w"] is None


def test_queries_equal_brute_force(spark, small, rows):
    items = {tuple(r) for r in lookalike.texts(spark, small).collect()}
    expected = {(k, *sorted((i, j))) for k, i, a in items for m, j, b in items if k == m and i < j and a != b and forms.consistent(a) == forms.consistent(b)}
    assert {tuple(r) for r in lookalike.p3_found(spark, small).collect()} == expected
    assert lookalike.p3_forms(spark, small).count() == len(items)
