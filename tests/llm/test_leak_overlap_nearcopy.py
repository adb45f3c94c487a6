import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexforge.llm import forms, leak, nearcopy, overlap
from lexforge.runtime import table

W = nearcopy._WORDS


def longest(a, b):
    return max((k for i in range(len(a)) for j in range(len(b)) for k in range(1, min(len(a) - i, len(b) - j) + 1) if a[i : i + k] == b[j : j + k]), default=0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=16), min_size=1, max_size=3), st.lists(st.lists(st.sampled_from("abcd"), max_size=24), max_size=3), st.integers(5, 8))
def test_wu_manber_equals_brute_force(tests, texts, least):
    machine = leak.WuManber(list(range(len(tests))), [" ".join(t) for t in tests], least)
    got = {(r, n): k for r, n, k in machine.search([" ".join(t) for t in texts])}
    expected = {(r, n): k for r, t in enumerate(texts) for n, p in enumerate(tests) if (k := longest(p, t)) >= least}
    assert got == expected


def test_leaks_operator(spark, rows):
    base = " ".join(f"từ{i}" for i in range(60))
    tests = [("q1", base), ("q2", base.upper()), ("q3", None), ("q4", ""), ("q5", "ngắn")]
    corpus = [("c1", "mở đầu " + " ".join(base.split()[10:45]) + " kết"), ("c2", " ".join(base.split()[:29])), ("c3", None), ("c4", ""), ("c1", "khác")]
    t = spark.createDataFrame(tests, "test_id string, text string")
    c = spark.createDataFrame(corpus, "row_id string, text string")
    for size in (leak.BLOCK_BYTES, 200):  # one block and several
        assert rows(leak.leaks(t, c, block_bytes=size)) == [("q1", "c1", 35), ("q2", "c1", 35)]
    assert leak.leaks(t.limit(0), c).count() == 0 and leak.leaks(t, c.limit(0)).count() == 0
    with pytest.raises(ValueError):
        leak.WuManber([], [], 4)


def test_p4_equals_brute_force(spark, small):
    words = lambda x: W(forms.consistent(x).lower())
    windows = {}
    for r in table(spark, small, "legal_questions").where("split <> 'train' and answer is not null").collect():
        w = words(r["answer"])
        for i in range(len(w) - 29):
            windows.setdefault(tuple(w[i : i + 30]), set()).add(r["id"])
    expected = set()
    for r in table(spark, small, "legal_chunks").where("retrieval_text is not null").collect():
        w = words(r["retrieval_text"])
        expected |= {(q, r["chunk_id"]) for i in range(len(w) - 29) for q in windows.get(tuple(w[i : i + 30]), ())}
    assert {tuple(r) for r in leak.p4_found(spark, small).collect()} == expected
    assert leak.p4_leaks(spark, small).count() == len({q for q, _ in expected})


def pairs_of(records, threshold):
    out = set()
    grams = lambda w: set(zip(w, w[1:]))
    digits = lambda w: sorted(x for x in w if any(c.isnumeric() for c in x))
    rows = [(i, s, W(forms.consistent(t).lower())) for i, s, t in records if t and s]
    for i, s, a in rows:
        for j, r, b in rows:
            if s == "train" and r != "train" and i != j and a and b and digits(a) == digits(b):
                both, either = len(grams(a) & grams(b)), len(grams(a) | grams(b))
                if (both / either if either else float(a == b)) >= threshold - 1e-9:
                    out.add(tuple(sorted((i, j))))
    return out


@pytest.mark.parametrize("group_rows", [4000, 5])
def test_overlaps_equal_brute_force(spark, group_rows):
    rng = random.Random(group_rows)
    base = [[rng.choice("abcdefgh") for _ in range(rng.randint(1, 18))] + rng.choice([[], ["5"], ["12"]]) for _ in range(12)]
    records = [("n1", "train", None), ("n2", None, "a b"), ("n3", "public", ""), ("o1", "train", "x"), ("o2", "public", "X!")]
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice("abcdefgh")
        records.append((f"r{i}", rng.choice(["train", "warmup", "public"]), " ".join(w)))
    df = spark.createDataFrame(records, "id string, split string, text string")
    got = overlap.overlaps(df, 0.75, group_rows).collect()
    assert {tuple(sorted((r["train_id"], r["eval_id"]))) for r in got} == pairs_of(records, 0.75)
    assert len(got) == len({(r["train_id"], r["eval_id"]) for r in got})
    assert all(0.0 <= r["coverage"] <= 1.0 for r in got)
    assert overlap.overlaps(df.limit(0)).count() == 0


def test_p7_equals_brute_force(spark, small):
    records = [(r["id"], r["split"], r["question"]) for r in table(spark, small, "legal_questions").select("id", "split", "question").distinct().collect()]
    assert {tuple(r) for r in overlap.p7_found(spark, small).collect()} == pairs_of(records, 0.75)
    report = overlap.p7_report(spark, small).collect()
    assert sum(r["n_pairs"] for r in report) == len(pairs_of(records, 0.75))


def similar(items, k, t):
    rows = [(i, forms.consistent(x)) for i, x in items if x and x.strip()]
    out = set()
    for n, (i, x) in enumerate(rows):
        for j, y in rows[:n]:
            a, b = (set(zip(*[W(z.lower())[m:] for m in range(k)])) for z in (x, y))
            if x == y or (a or b) and len(a & b) / len(a | b) >= t - 1e-9:
                out.add(tuple(sorted((i, j))))
    return out


def test_p6_equals_brute_force(spark, small):
    items = [(r["id"], r["passage"]) for r in table(spark, small, "legal_documents").select("id", "passage").distinct().collect()]
    assert {tuple(r) for r in nearcopy.p6_found(spark, small).collect()} == similar(items, 3, 0.6)


@pytest.mark.parametrize("words", [12, 60, 150, 400])
def test_signatures_of_sets_near_the_threshold_meet(words):
    """Recall of the candidate search: pairs edited down to a similarity of 0.6 to 0.7."""
    rng = random.Random(words)
    missed = n = 0
    while n < 60:
        a = [f"w{rng.randrange(400)}" for _ in range(words)]
        b = list(a)
        s = nearcopy.shingles(" ".join(a), 3)
        while True:
            b[rng.randrange(len(b))] = f"w{rng.randrange(400)}"
            t = nearcopy.shingles(" ".join(b), 3)
            both = len(set(s.tolist()) & set(t.tolist()))
            score = both / (len(s) + len(t) - both)
            if score < 0.7:
                break
        if score >= 0.6:
            n += 1
            missed += not set(nearcopy.signatures(s, 0.6).tolist()) & set(nearcopy.signatures(t, 0.6).tolist())
    assert missed == 0


@pytest.mark.parametrize("large, part", [(60, 36), (66, 40), (100, 60)])
def test_signatures_of_one_sided_edits_meet(large, part):
    """Recall for text that was appended or removed: the sets differ in size and meet in one band only."""
    rng = np.random.default_rng(large)
    missed = 0
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, large, dtype=np.uint64))
        b = np.sort(rng.choice(a, part, replace=False))
        missed += not set(nearcopy.signatures(a, 0.6).tolist()) & set(nearcopy.signatures(b, 0.6).tolist())
    assert missed == 0


def test_near_copies_edge_cases(spark, rows):
    text = " ".join(f"chữ{i}" for i in range(80))
    items = spark.createDataFrame(
        [("1", text), ("2", text.replace("chữ40", "khác")), ("3", text.upper()), ("4", None), ("5", "  "), ("6", "hai từ"), ("7", "hai từ"), ("8", "hai  từ"), ("9", "")], "id string, text string"
    )
    members, links = nearcopy.near_copies(items, 3, 0.6)
    cls = {r["id"]: r["class"] for r in members.collect()}
    assert set(cls) == {"1", "2", "3", "6", "7", "8"} and cls["1"] == cls["3"] != cls["2"] and cls["6"] == cls["7"] != cls["8"]
    assert {frozenset((r["class_a"], r["class_b"])) for r in links.collect()} == {frozenset((cls["1"], cls["2"]))}
    grouped = {r["id"]: (r["group"], r["n_links"]) for r in nearcopy.groups(members, links).collect()}
    assert grouped["1"] == grouped["3"] == grouped["2"] and grouped["6"][1] == 0
    empty = nearcopy.near_copies(items.limit(0))
    assert nearcopy.groups(*empty).count() == 0


def test_groups_are_connected_components(spark):
    links = [(i, i + 1) for i in range(1, 12)] + [(20, 30), (25, 30)]
    members = spark.createDataFrame([(str(i), i) for i in [*range(1, 13), 20, 25, 30, 99]], "id string, class long")
    got = {r["id"]: r["group"] for r in nearcopy.groups(members, spark.createDataFrame(links, "class_a long, class_b long")).collect()}
    assert {got[str(i)] for i in range(1, 13)} == {1} and got["20"] == got["25"] == got["30"] == 20 and got["99"] == 99


def test_p6_groups(spark, small):
    n = table(spark, small, "legal_documents").where("trim(passage) <> ''").select("id").distinct().count()
    assert nearcopy.p6_groups(spark, small).count() == n
