import base64
import random

import pytest
import tiktoken
from tokenizers import Tokenizer

from lexforge.llm import encode, mix
from lexforge.runtime import table


@pytest.fixture(scope="module")
def bpe():
    return encode.ByteBpe(encode.read_vocabulary())


def test_equal_to_the_public_libraries(bpe, monkeypatch):
    data = encode.read_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    own = tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})
    other = Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    rng = random.Random(7)
    texts = ["", " ", "Điều 1. Phạm vi\n\n  điều chỉnh", "<|endoftext|> I'll 12:30 ⚖️ 𝐀", "x" * 900, "đ" * 700]
    texts += ["".join(rng.choice("abcđếộ  \n\t'12.,—🚢") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    for text in texts:
        assert bpe.encode(text) == own.encode_ordinary(text) == other.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(encode, "SHORT", 0)
    fresh = encode.ByteBpe(data)
    assert all(fresh.encode(t) == bpe.encode(t) for t in texts)


def test_round_trip(bpe):
    back = {v: k for k, v in bpe.ranks.items()}
    text = "Quyết định số 12/2044/QĐ-SMN ngày ５ ​"
    assert b"".join(back[i] for i in bpe.encode(text)).decode() == text


def test_word_memory_is_bounded():
    b = encode.ByteBpe(encode.read_vocabulary(), most_words=3)
    for w in ("một", "hai", "ba", "bốn", "năm"):
        b.encode(w)
    assert len(b) <= 3


def test_operator_on_null_empty_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (2, None, 6), (3, "", 7), (3, "", 7)], "doc_id long, text string, ids int")
    got = sorted((r["doc_id"], r["ids"]) for r in encode.encode(docs, "doc_id", "text").collect())
    assert got == [(1, [64, 275]), (2, []), (3, []), (3, [])]
    assert encode.encode(docs.limit(0), "doc_id", "text").count() == 0
    assert sorted(r["n_tokens"] for r in encode.token_counts(docs, "doc_id", "text", ["ids"]).collect()) == [0, 0, 0, 2]


def test_p8_ids(spark, small, bpe):
    texts = {r["doc_id"]: r["text"] for r in table(spark, small, "documents").collect()}
    got = {r["doc_id"]: r["ids"] for r in encode.p8_ids(spark, small).collect()}
    assert got == {k: bpe.encode(t or "") for k, t in texts.items()}


def test_missing_vocabulary_is_an_error():
    with pytest.raises(FileNotFoundError):
        encode.read_vocabulary("byte_bpe_50k", "/nowhere")


def mixed(spark, docs, targets, **options):
    sized = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    goals = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    m, r = mix.mixture(sized, goals, **options)
    return m.collect(), {x["source"]: x for x in r.collect()}


def test_shares_repeats_and_order(spark):
    rng = random.Random(4)
    docs = [(i, "big", rng.randint(50, 150)) for i in range(3000)] + [(10_000 + i, "small", rng.randint(50, 150)) for i in range(300)] + [(20_000, None, 9), (20_001, "other", 9), (20_002, "big", 0)]
    rows, report = mixed(spark, docs, [("big", 0.6, 1), ("small", 0.4, 3), ("absent", 0.2, 2)], block_tokens=500)
    assert abs(report["big"]["actual_share"] - 0.6) < 0.01 and abs(report["small"]["actual_share"] - 0.4) < 0.01
    assert report["absent"]["tokens_used"] == 0 and report["small"]["most_uses"] <= 3 and report["big"]["most_uses"] == 1
    uses = {}
    for r in rows:
        uses[r["source"], r["doc_id"], r["pass"]] = uses.get((r["source"], r["doc_id"], r["pass"]), 0) + 1
    assert set(uses.values()) == {1} and {r["source"] for r in rows} == {"big", "small"}
    half = sorted(rows, key=lambda r: (r["slot"], r["place"]))[: len(rows) // 2]
    tokens = sum(r["n_tokens"] for r in half)
    assert abs(sum(r["n_tokens"] for r in half if r["source"] == "big") / tokens - 0.6) < 0.03
    assert report["small"]["tokens_used"] > 0.9 * 3 * report["small"]["tokens_available"]


def test_small_buckets_give_the_same_shares(spark, monkeypatch):
    monkeypatch.setattr(mix, "BUCKET_DOCS", 7)
    monkeypatch.setattr(mix, "SLOT_RANGE", 5)
    docs = [(i, "ab"[i % 2], 10 + i % 5) for i in range(400)]
    rows, report = mixed(spark, docs, [("a", 0.5, 1), ("b", 0.5, 1)], block_tokens=50)
    assert abs(report["a"]["actual_share"] - 0.5) < 0.03 and len({r["doc_id"] for r in rows}) == len(rows)
    slots = {}
    for r in rows:
        slots.setdefault(r["slot"], set()).add(r["source"])
    assert all(len(s) == 1 for s in slots.values())


def test_nothing_to_mix(spark):
    rows, report = mixed(spark, [], [("a", 1.0, 1)])
    assert rows == [] and report["a"]["actual_share"] == 0


def test_p9_report(spark, small):
    r = {x["source"]: x for x in mix.p9_report(spark, small).collect()}
    assert len(r) == 8 and abs(sum(x["actual_share"] for x in r.values()) - 1) < 1e-9
    assert all(x["most_uses"] <= x["max_repeats"] for x in r.values())
