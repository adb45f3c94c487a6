import random

import pytest

from lexforge.llm import split


def check(text, limit, overlap):
    got = split.pieces(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(0 <= b - a <= limit for a, b, _ in got)
    for (a, b, kind), (c, _, _) in zip(got, got[1:]):
        assert c == b - overlap and c > a and kind != "end"
    return got


def test_pieces_cover_the_text_with_the_overlap():
    rng = random.Random(2)
    for _ in range(400):
        limit = rng.randint(2, 80)
        text = "".join(rng.choice("abc  \n.;") for _ in range(rng.randint(0, 500)))
        check(text, limit, rng.randint(0, limit - 1))


def test_boundaries_in_order_of_strength():
    body = "chữ " * 20
    text = f"{body}\nĐiều 2. {body}"
    assert [k for *_, k in check(text, 100, 10)][0] == "unit"
    assert check(f"{body}\n{body}", 100, 10)[0][2] == "line"
    assert check(f"{body.strip()}. {body}", 100, 10)[0][2] == "sentence"
    assert check(body * 3, 101, 10)[0][2] == "blank"
    assert check("x" * 300, 100, 10)[0][2] == "hard"


def test_limits_and_units():
    assert split.pieces("", 10, 2) == [(0, 0, "end")]
    assert split.pieces("x" * 10, 10, 2) == [(0, 10, "end")]
    words = "một hai ba bốn năm sáu"
    got = split.pieces(words, 3, 1, "words")
    assert all(len(words[a:b].split()) <= 3 for a, b, _ in got) and len(got) > 1
    assert all(len("é" * 50) and len(("é" * 50)[a:b].encode()) <= 20 for a, b, _ in split.pieces("é" * 50, 20, 4, "bytes"))
    for bad in ((10, 10), (10, -1)):
        with pytest.raises(ValueError):
            split.pieces("x", *bad)


def test_operator_and_queries(spark, small, rows):
    data = [("k", "1", "x" * 30, "chars", 10, 3), ("k", "2", "x" * 10, "chars", 10, 3), ("k", "3", None, "chars", 10, 3), ("k", "4", "", "chars", 10, 3)]
    items = spark.createDataFrame(data, "kind string, id string, text string, unit string, max_size int, overlap_size int")
    got = split.split_items(items).orderBy("piece").collect()
    assert {r["id"] for r in got} == {"1"} and [r["start_offset"] for r in got] == [0, 7, 14, 21]
    assert split.split_items(items.limit(0)).count() == 0
    over = spark.sql(
        f"select distinct 'document' kind, id from parquet.`{small}/legal_documents.parquet` where length(passage) > 1200 union select distinct 'chunk', chunk_id from parquet.`{small}/legal_chunks.parquet` where length(raw_text) > 1200"
    )
    assert rows(split.p2_found(spark, small)) == rows(over)
    p = split.p2_pieces(spark, small)
    assert p.where("length(text) > 1200").count() == 0


def test_long_run_behind_an_early_boundary_stays_whole():
    text = "a" * 199 + " " + "b" * 1100 + " " + "c" * 300
    cuts = split.pieces(text, 1200, 50)
    assert cuts[0][1] in (199, 200) and cuts[0][2] != "hard"
    assert any("b" * 1100 in text[a:b] for a, b, _ in cuts)
