from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from lexforge import runtime
from lexforge.llm import encode, forms, leak, mix, nearcopy, overlap, split


def test_forms_of_type_faces_widths_and_other_scripts():
    for text, form in (("𝐀bc", "Abc"), ("ﬁn", "fin"), ("Ⅳ", "IV"), ("ｶﾞ", "ガ"), ("￥", "¥"), ("ᴄᴏn", "con"), ("ᎪBC", "ABC"), ("ꓮBC", "ABC"), ("ⅼuật", "luật")):
        assert forms.consistent(text) == form == forms.consistent(form)
    for same in ("①", "Ꭰ", "x²", "½", "…", "Привет"):  # seen to be different, or words of their own script
        assert forms.consistent(same) == same


def test_more_sources_than_the_bound_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mix, "MOST_SOURCES", 2)
    sized = spark.createDataFrame([(1, "a", 10)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([(s, 0.3, 1) for s in "abc"], "source string, target_share double, max_repeats int")
    with pytest.raises(ValueError, match="more than 2"):
        mix.mixture(sized, targets)


def test_schedule_keeps_shares_at_any_prefix(spark):
    shares = [("a", 0.5), ("b", 0.3), ("c", 0.15), ("d", 0.05)]
    rows = mix._schedule(spark, shares, 2000).collect()
    assert len(rows) == 2000 and len({r["slot"] for r in rows}) == 2000
    for upto in (100, 500, 2000):
        for name, share in shares:
            assert abs(sum(r["source"] == name for r in rows if r["slot"] < upto) / upto - share) < 0.03
    for name, _ in shares:
        assert sorted(r["block"] for r in rows if r["source"] == name) == list(range(sum(r["source"] == name for r in rows)))


def test_batches_of_ids_are_cut_before_their_offsets_overflow(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "một hai ba " * (i % 4)) for i in range(40)] + [(99, None)], "doc_id bigint, text string")
    whole = {r["doc_id"]: r["ids"] for r in encode.encode(docs, "doc_id", "text").collect()}
    monkeypatch.setattr(encode, "MOST_BATCH_BYTES", 64)
    import pyarrow as pa

    made = encode._lists(pa.array([1, 2]), [b"\x01\x00\x00\x00", b""], "k").to_pylist()
    assert made == [{"k": 1, "ids": [1]}, {"k": 2, "ids": []}] and len(whole) == 41 and whole[99] == []


def test_byte_limits_hold_for_short_texts_of_long_characters(spark):
    items = spark.createDataFrame([("k", "1", "ộ" * 60, "bytes", 100, 10), ("k", "2", "o" * 60, "bytes", 100, 10)], "kind string, id string, text string, unit string, max_size int, overlap_size int")
    rows = split.split_items(items).collect()
    assert {r["id"] for r in rows} == {"1"} and all(len(r["text"].encode()) <= 100 for r in rows)


def test_coverage_per_record(spark):
    rows = [("t1", "train", "mức phạt là bao nhiêu khi vượt đèn đỏ"), ("e1", "public", "mức phạt là bao nhiêu khi vượt đèn vàng đỏ"), ("e2", "public", "không có gì chung cả")]
    df = spark.createDataFrame(rows, "id string, split string, text string")
    found = overlap.overlaps(df, 0.5).collect()
    assert [(r["train_id"], r["eval_id"]) for r in found] == [("t1", "e1")] and abs(found[0]["coverage"] - 0.9) < 0.11


def test_leaks_in_several_blocks(spark):
    text = " ".join(f"w{i}" for i in range(40))
    tests = spark.createDataFrame([("a", text), ("b", text[::-1]), ("c", None)], "test_id string, text string")
    corpus = spark.createDataFrame([("x", "đầu " + text + " cuối"), ("y", text[::-1]), ("z", "w1 w2")], "row_id string, text string")
    one = sorted(map(tuple, leak.leaks(tests, corpus).collect()))
    assert one == sorted(map(tuple, leak.leaks(tests, corpus, block_bytes=100).collect())) and {(r[0], r[1]) for r in one} == {("a", "x"), ("b", "y")}


@pytest.mark.parametrize("size,kept,added", [(60, 36, 0), (100, 75, 25), (200, 160, 27), (400, 300, 100), (900, 540, 0)])
def test_pairs_at_the_threshold_share_a_signature(size, kept, added):
    """Removed, replaced and mixed content, all at a similarity of 0.6; reordering of whole parts changes few shingles."""
    rng = np.random.default_rng(size)
    for _ in range(20):
        pool = np.unique(rng.integers(0, 2**63, size=size + added, dtype=np.uint64))
        rng.shuffle(pool)
        a, b = np.sort(pool[:size]), np.sort(np.concatenate([pool[:kept], pool[size:]]))
        assert len(np.intersect1d(nearcopy.signatures(a, 0.6), nearcopy.signatures(b, 0.6)))


def test_inserted_and_reordered_text_is_found(spark):
    rng = np.random.default_rng(4)
    words = [f"t{i}" for i in rng.integers(0, 5000, size=240)]
    moved = words[120:] + words[:120]
    inserted = words[:100] + [f"n{i}" for i in range(60)] + words[100:]
    df = spark.createDataFrame([("a", " ".join(words)), ("b", " ".join(moved)), ("c", " ".join(inserted)), ("d", " ".join(f"u{i}" for i in range(240)))], "id string, text string")
    members, links = nearcopy.near_copies(df, 3, 0.6)
    of = {r["class"]: r["id"] for r in members.collect()}
    assert {tuple(sorted((of[r["class_a"]], of[r["class_b"]]))) for r in links.collect()} >= {("a", "b"), ("a", "c")}


def test_near_copies_keep_less_on_disk_than_their_texts(spark):
    rng = np.random.default_rng(7)
    texts = [(f"i{i}", " ".join(f"tu{x}" for x in rng.integers(0, 2000, size=500))) for i in range(300)]
    before = len(runtime._written.get(spark.sparkContext.applicationId, []))
    nearcopy.near_copies(spark.createDataFrame(texts, "id string, text string"), 3, 0.6)
    written = runtime._written[spark.sparkContext.applicationId][before:]
    kept = sum(p.stat().st_size for path in written for p in Path(path.removeprefix("file:")).rglob("*.parquet"))
    assert kept < sum(len(t) for _, t in texts)


@pytest.mark.parametrize("size,kept,added", [(30, 18, 0), (60, 36, 0), (200, 160, 27), (400, 300, 100)])
def test_pairs_at_the_threshold_meet_in_a_round(size, kept, added):
    """Two sets that share a signature also pass the comparison of their bits or parities; words stand for themselves."""
    rng = np.random.default_rng(size)
    words = []
    for _ in range(50):
        pool = rng.integers(0, 2**63, size=size + added, dtype=np.int64)
        words += [pool[:size].tolist(), pool[:kept].tolist() + pool[size:].tolist()]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(words, type=pa.list_(pa.int64()))], names=["class", "words"])
    met = set()
    for number in range(nearcopy.ROUNDS):
        for rows in nearcopy._entries(1, 0.6, number, 1)(iter([batch])):
            for e in rows.column("entries").to_pylist():
                met.update((a, b) for pairs in nearcopy._met(np.frombuffer(e, dtype=nearcopy.ENTRY), 0.6) for a, b in pairs.tolist())
    assert met >= {(i, i + 1) for i in range(0, 100, 2)}
