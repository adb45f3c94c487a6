"""Problem 6: near copies with small edits, by PartEnum signatures.

A text is the set of its word shingles.  Sets whose Jaccard similarity is at least t differ
in a bounded number of elements once their sizes lie in the same band, so the shingle
domain is partitioned by hash into n1 parts of n2 subparts each, and the content of every
choice of n2 - k2 subparts of a part is a signature: similar sets agree on some of them.
Every set makes signatures for its own size band and for the next one, so that partners of
neighbouring bands meet; each band is partitioned by its largest and by its least set, as
sets of different size meet at the small end.  Signatures of few shingles are left out, being no evidence;
small sets use their least shingles (a prefix filter, which is exact) instead.
Signatures meet in rounds, packed, with 64 bits of their set each: sets whose bits agree in too
few places are no candidates, and small ones are compared by the parities of their parts, which
is exact.  Candidates are compared exactly.  See the README for the measured recall.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import blocks, cut, latest, small, stored, table
from .forms import consistent_form

N2, K2 = 4, 2
#: Shingles of the largest set of a band per part: the expected content of a signature, half of it, follows.
PART = 12
#: Bands up to this size use the prefix filter.
SMALL = 48
#: Signatures with fewer shingles are left out: common phrases alone would make them meet.
LEAST_CONTENT = 5
#: A set makes about so many signatures of a partition: small sets are partitioned several times
#: over, of large ones not all parts are used.
SIGNATURES = 200
#: The same for partitions by the least set of a band, where one-sided edits of its small sets meet.
LOW_SIGNATURES = 340
#: Rounds in which signatures are made and met: every fourth of the partitions, half of its parts.
ROUNDS = 8
#: Parts of a partition in so many groups have bits of their own.
GROUPS = 4
#: A signature in its bucket: half of its hash (the bucket knows more), class, bits of the set, and its size, with a mark if of a prefix.
ENTRY = np.dtype([("s", "<u4"), ("c", "<i8"), ("b", "<u8"), ("n", "<u2")])
#: Texts worked on together, pairs held by a task, and bytes of a text's entries in a round and of a bucket.
SLICE, PAIRS_HELD, ENTRY_BYTES, BUCKET_BYTES = 1_000, 1_000_000, 2_000, 32 << 20
#: Size of the parity sketch; bytes of a pair with two of them, and about those of a stored text.
PARITY_WORDS, PAIR_BYTES, TEXT_BYTES = 32, 600, 2_000
#: Classes of similar texts are broadcast up to this many to pick their texts.
BROADCAST_CLASSES = 2_000_000
_WORDS = re.compile(r"[^\W_]+").findall
_CHOICES = np.array([[i in c for i in range(N2)] for c in combinations(range(N2), N2 - K2)], dtype=bool)


def shingles(form: str, k: int) -> np.ndarray:
    """Distinct hashes of runs of k words, ascending."""
    w = _WORDS(form)
    return _sets(np.fromiter((xxhash.xxh64_intdigest(x, seed=42) for x in w), dtype=np.uint64, count=len(w)), np.array([0, len(w)]), k)[0]


def _sets(words: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """``shingles`` of many texts from the hashes of their words, as Spark's xxhash64 gives them."""
    runs = words
    for j in range(1, k):
        runs = _scramble(runs[: len(words) - j]) + words[j:]
    runs = _scramble(runs)
    return [np.unique(runs[a : max(a, b - k + 1)]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def band(size: int, t: float) -> int:
    """Band i holds the sizes from t**-i up to below t**-(i+1)."""
    i = int(math.log(size) / -math.log(t))
    while t ** -(i + 1) <= size:
        i += 1
    while t**-i > size:
        i -= 1
    return i


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _bits(mixed: np.ndarray, own: np.ndarray, n: int, salt: np.uint64) -> np.ndarray:
    """Four bits each of the least hash in 16 parts of the domain, for each of n sets: a pair agrees in about its similarity of them."""
    h = _scramble(mixed + salt)
    least = np.full(n * 16, ~np.uint64(0))
    np.minimum.at(least, own * 16 + (h >> np.uint64(60)).astype(np.int64), h & np.uint64((1 << 60) - 1))
    nibbles = (_scramble(least) & np.uint64(15)).reshape(n, 16)
    return np.bitwise_or.reduce(nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=1)


def _turn(s: np.ndarray, own: np.ndarray, n: int, n1: int, used: int, tag: np.uint64, turn: np.uint64, half: int) -> Iterator[tuple]:
    """(signatures, sets, bits) of n sets of one band: of the first ``used`` parts of a partition into n1 parts, every other one."""
    salt = tag + turn
    mixed = _scramble(s + turn)
    cell = (mixed % np.uint64(n1 * N2)).astype(np.int64)
    for group in range(half, min(GROUPS, used), 2):  # a group of parts has bits of its own, so that no chance decides twice
        parts = np.arange(group, used, GROUPS)
        inside = (cell < used * N2) & (cell // N2 % GROUPS == group)
        at = (own[inside] * len(parts) + cell[inside] // (N2 * GROUPS)) * N2 + cell[inside] % N2
        content = np.zeros(n * len(parts) * N2, dtype=np.uint64)
        np.add.at(content, at, _scramble(mixed[inside] + salt))
        content = content.reshape(n, len(parts), N2)
        count = np.bincount(at, minlength=n * len(parts) * N2).reshape(n, len(parts), N2)
        bits = _bits(mixed, own, n, np.uint64(group + 1))
        for number, chosen in enumerate(_CHOICES):
            total = content[:, :, chosen].sum(axis=2, dtype=np.uint64)
            row, col = np.nonzero(count[:, :, chosen].sum(axis=2) >= LEAST_CONTENT)
            place = parts.astype(np.uint64) * np.uint64(64) + np.uint64(number)
            yield _scramble(total[row, col] + _scramble(place + salt)[col]), row, bits[row]


def _signed(sets: list[np.ndarray], t: float, rounds: range) -> Iterator[tuple]:
    """(signatures, places of their sets, bits, whether of a prefix) over the instances of each set's band and the next."""
    bands: dict[int, list[int]] = {}
    for i, x in enumerate(sets):
        if len(x):
            own = band(len(x), t)
            for instance in (own, own + 1):
                bands.setdefault(instance, []).append(i)
    for instance, members in bands.items():
        largest = t ** -(instance + 1)
        tag = np.uint64((instance + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        if largest <= SMALL:
            if 2 * instance % ROUNDS in rounds:
                for i in members:
                    prefix = sets[i][: len(sets[i]) - math.ceil(t * len(sets[i]) - 1e-9) + 1]
                    yield _scramble(prefix + tag), np.full(len(prefix), i), np.full(len(prefix), _parities(sets[i], 1)[0]), True
            continue
        flat, own = np.concatenate([sets[i] for i in members]), np.repeat(np.arange(len(members)), [len(sets[i]) for i in members])
        at = np.array(members)
        for end, (size, wanted) in enumerate(((largest, SIGNATURES), (t * largest, LOW_SIGNATURES))):
            n1 = max(2, round(size / PART))
            used = min(n1, math.ceil(wanted / len(_CHOICES)))
            for half in range(2):
                if ((2 * instance + end) % (ROUNDS // 2)) * 2 + half not in rounds:
                    continue
                for turn in range(max(1, round(wanted / (n1 * len(_CHOICES))))):
                    for signed, row, bits in _turn(flat, own, len(members), n1, used, tag, np.uint64(turn + end * 4096), half):
                        yield signed, at[row], bits, False


def signatures(s: np.ndarray, t: float) -> np.ndarray:
    """Signatures (uint64) of a set, over the instances of its band and the next."""
    return np.concatenate([np.zeros(0, np.uint64), *(x[0] for x in _signed([s], t, range(ROUNDS)))])


def _parities(s: np.ndarray, words: int) -> np.ndarray:
    """A bit for each of 64 * words parts of the domain: whether the set holds an odd number of it.

    Sets that differ in d elements differ in d bits at most.
    """
    h = _scramble(s ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(64 * words)
    odd = np.bincount(h.astype(np.int64), minlength=64 * words) % 2
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def agreement(t: float) -> int:
    """Of 16 four-bit parts, how many sets of similarity t agree in, but for two hits in a hundred."""
    p = t + (1 - t) / 16
    below, h = 0.0, 0
    while (below := below + math.comb(16, h) * p**h * (1 - p) ** (16 - h)) <= 0.02:
        h += 1
    return h


def _batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Classes and sets of (class, words), SLICE texts at a time."""
    for batch in batches:
        for start in range(0, len(batch), SLICE):
            rows = batch.slice(start, SLICE)
            words = rows.column(1)
            offsets = words.offsets.to_numpy()
            flat = words.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64)
            yield rows.column(0).to_numpy(zero_copy_only=False), _sets(flat, offsets - offsets[0], k)


def _entries(k: int, t: float, number: int, buckets: int):
    """Rows (bucket, entries) of the signatures of one round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, sets in _batches(batches, k):
            sizes = np.array([min(len(s), 0x7FFF) for s in sets], dtype=np.uint16)
            found = []
            for signed, at, bits, prefix in _signed(sets, t, range(number, number + 1)):
                rows = np.empty(len(signed), dtype=ENTRY)
                rows["s"], rows["c"], rows["b"], rows["n"] = signed & np.uint64(0xFFFFFFFF), names[at], bits, sizes[at] | (0x8000 if prefix else 0)
                found.append(((signed >> np.uint64(32)) % np.uint64(buckets), rows))
            if not found:
                continue
            bucket, rows = np.concatenate([x[0] for x in found]).astype(np.int32), np.concatenate([x[1] for x in found])
            order = np.argsort(bucket, kind="stable")
            rows, ends = rows[order], np.cumsum(np.bincount(bucket, minlength=buckets))
            full = np.flatnonzero(np.diff(ends, prepend=0))
            packed = [rows[(ends[i - 1] if i else 0) : ends[i]].tobytes() for i in full.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(packed, type=pa.binary())], names=["bucket", "entries"])

    return run


def _met(e: np.ndarray, t: float) -> Iterator[np.ndarray]:
    """Pairs of classes that share a signature and may be similar, by rows of two; ``e`` is one bucket's entries."""
    e = e[np.argsort(e["s"])]
    s, size, prefix = e["s"], (e["n"] & 0x7FFF).astype(np.int64), e["n"] >= 0x8000
    at, far, least = np.arange(len(e)), 0, agreement(t)
    while len(at):  # entries with the one ``far`` places on, as long as any has the same signature
        far += 1
        at = at[at + far < len(e)]
        at = at[s[at] == s[at + far]]
        a, b = at, at + far
        both = size[a] + size[b]
        ok = (np.minimum(size[a], size[b]) >= t * np.maximum(size[a], size[b]) - 1e-9) | (np.maximum(size[a], size[b]) == 0x7FFF)
        ok &= (e["c"][a] != e["c"][b]) & (prefix[a] == prefix[b])
        a, b, both = a[ok], b[ok], both[ok]
        other = e["b"][a] ^ e["b"][b]
        apart = other | other >> np.uint64(1) | other >> np.uint64(2) | other >> np.uint64(3)
        agree = 16 - np.bitwise_count(apart & np.uint64(0x1111111111111111)).astype(np.int64)
        ok = np.where(prefix[a], np.bitwise_count(other) <= (1 - t) / (1 + t) * both + 1e-6, agree >= least)
        x, y = e["c"][a[ok]], e["c"][b[ok]]
        yield np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)


def _meet(t: float):
    """Pairs of a partition of (bucket, entries), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[bytes]] = {}
        for batch in batches:
            for bucket, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(bucket, []).append(entries)
        held, many = [], 0

        def out() -> pa.RecordBatch:
            pairs = np.unique(np.concatenate(held), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["class_a", "class_b"])

        while by:
            for pairs in _met(np.frombuffer(b"".join(by.pop(next(iter(by)))), dtype=ENTRY), t):
                held.append(pairs)
                many += len(pairs)
                if many > PAIRS_HELD:
                    yield out()
                    held, many = [], 0
        if many:
            yield out()

    return run


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, sets in _batches(batches, k):
            flat = np.concatenate([_parities(s, PARITY_WORDS) for s in sets]).view(np.int64)
            parities = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, PARITY_WORDS, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([len(s) for s in sets], type=pa.int32()), parities], names=["class", "size", "parities"])

    return run


def _exact(k: int, t: float):
    """(class_a, class_b, similarity) of (class_a, class_b, words_a, words_b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[s for _, sets in _batches([batch.select(["class_a", c])], k) for s in sets] for c in ("words_a", "words_b")]
            shared = np.array([len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(*sides)], dtype=np.float64)
            either = np.array([len(a) + len(b) for a, b in zip(*sides)], dtype=np.float64) - shared
            similarity = pa.array(shared / np.maximum(either, 1))
            yield pa.RecordBatch.from_arrays([batch.column("class_a"), batch.column("class_b"), similarity], names=["class_a", "class_b", "similarity"])

    return run


def classes(items: DataFrame, k: int) -> DataFrame:
    """(id, class, form): texts of the same words, or for texts under k words of the same form, are one class."""
    form = items.where("text is not null").select("id", consistent_form(F.col("text")).alias("form")).where(F.trim(F.regexp_replace("form", r"\s+", " ")) != "")
    form = form.withColumn("words", F.regexp_extract_all(F.lower("form"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).withColumn("plain", F.array_join("words", " "))
    long = F.size("words") >= k
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    return form.select("id", F.when(long, F.xxhash64("plain")).otherwise(F.xxhash64("form", F.lit(0))).alias("class"), F.when(long, hashes).alias("words"))


def similar_classes(texts: DataFrame, k: int, t: float) -> DataFrame:
    """Pairs (class_a < class_b, similarity) of different texts (class, words), each class once, that reach the threshold.

    The signatures are made and met in rounds, so that only a round's are on disk at a time;
    packed entries go to the bucket of their signature and meet there.
    """
    spark = texts.sparkSession
    n = texts.count()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks(n * ENTRY_BYTES, BUCKET_BYTES))
    met = None
    for number in range(ROUNDS):
        entries = texts.mapInArrow(_entries(k, t, number, buckets), "bucket int, entries binary")
        pairs = entries.repartitionById(buckets, F.col("bucket")).mapInArrow(_meet(t), "class_a bigint, class_b bigint")
        found = stored(pairs, tidy=True)
        met = found if met is None else met.union(found)
    met = stored(met.distinct(), tidy=True)
    sketches = stored(texts.mapInArrow(_sketches(k), "class bigint, size int, parities array<bigint>"), tidy=True)
    a = sketches.select(F.col("class").alias("class_a"), F.col("size").alias("size_a"), F.col("parities").alias("p_a"))
    b = sketches.select(F.col("class").alias("class_b"), F.col("size").alias("size_b"), F.col("parities").alias("p_b"))
    differ = F.aggregate(F.zip_with("p_a", "p_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    slices = blocks(met.count() * PAIR_BYTES, max(1, n) * TEXT_BYTES)
    near = None
    for i in range(slices):
        part = met if slices == 1 else met.where(F.pmod(F.xxhash64("class_a", "class_b"), F.lit(slices)) == i)
        kept = part.join(a, "class_a").join(b, "class_b").where(differ <= (1 - t) / (1 + t) * (F.col("size_a") + F.col("size_b")) + 1e-6)
        kept = stored(kept.select("class_a", "class_b"), tidy=True)
        near = kept if near is None else near.union(kept)
    wanted = stored(near.select(F.col("class_a").alias("class")).union(near.select(F.col("class_b").alias("class"))).distinct(), tidy=True)
    some = texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_CLASSES else wanted, "class", "left_semi")
    left = some.select(F.col("class").alias("class_a"), F.col("words").alias("words_a"))
    right = some.select(F.col("class").alias("class_b"), F.col("words").alias("words_b"))
    exact = near.join(left, "class_a").join(right, "class_b").select("class_a", "class_b", "words_a", "words_b")
    exact = exact.mapInArrow(_exact(k, t), "class_a bigint, class_b bigint, similarity double")
    return stored(exact.where(F.col("similarity") >= t - 1e-12), tidy=True)


def near_copies(items: DataFrame, k: int = 5, t: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Operator: items (id, text) -> (members (id, class), links (class_a, class_b, similarity)).

    Every text with content belongs to one class; links join different classes.  Null and
    blank texts have no class.  Copies never meet each other, only their classes do.
    """
    forms = stored(classes(items, k), tidy=True)
    members = stored(forms.select("id", "class").distinct(), tidy=True)
    # only repeated texts need another look: of each class one text takes part
    first = members.groupBy("class").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("class", "first")
    first = stored(first, tidy=True)
    texts = forms.where("words is not null").join(small(first, first.count()), "class", "left").where("first is null or id = first").select("class", "words")
    if forms.count() > members.count():  # the same row more than once
        texts = stored(texts.dropDuplicates(["class"]), tidy=True)
    return members, similar_classes(texts, k, t)


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, group, n_links): connected components of the links between classes, by least class.

    Each round every class takes the least label around it and the label of its label;
    rounds are cut by checkpoints and end when nothing changes.
    """
    edges = cut(links.select(F.col("class_a").alias("x"), F.col("class_b").alias("y")).union(links.select(F.col("class_b").alias("x"), F.col("class_a").alias("y"))))
    labels = cut(edges.select(F.col("x").alias("class")).distinct().withColumn("label", F.col("class")))
    while True:
        around = edges.join(labels, F.col("y") == F.col("class")).groupBy("x").agg(F.min("label").alias("least"))
        step = labels.join(around, F.col("class") == F.col("x")).select("class", F.least("label", "least").alias("label"), F.col("label").alias("old"))
        jump = step.select(F.col("class").alias("to"), F.col("label").alias("far"))
        new = cut(step.join(jump, F.col("label") == F.col("to"), "left").select("class", F.least("label", F.coalesce("far", "label")).alias("label"), "old"))
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("class", "label")
        if not changed:
            break
    degree = edges.groupBy(F.col("x").alias("class")).agg(F.count(F.lit(1)).alias("n_links"))
    return (
        members.join(labels, "class", "left")
        .join(degree, "class", "left")
        .select("id", F.coalesce("label", "class").alias("group"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    )


def _passages(spark: SparkSession, folder: str) -> DataFrame:
    return latest(table(spark, folder, "legal_documents").select("id", F.col("passage").alias("text"), "received_at"), ["id"])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    members, links = near_copies(_passages(spark, folder), k=3, t=0.6)
    a = members.select(F.col("id").alias("x"), F.col("class").alias("class_a"))
    b = members.select(F.col("id").alias("y"), F.col("class").alias("class_b"))
    across = a.join(links, "class_a").join(b, "class_b").select("x", "y")
    within = a.join(b, F.col("class_a") == F.col("class_b")).where("x < y").select("x", "y")
    return across.union(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: its group at five words and 0.8, and the links of its class to different texts."""
    return groups(*near_copies(_passages(spark, folder)))
