"""Problem 8: the whole corpus as ids of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ..runtime import table

#: Where the vocabulary files lie; a parameter of every function that reads them.
TOKENIZERS = os.environ.get("LEXFORGE_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pre-tokenisation pattern published with the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The vocabulary file is broadcast; a larger file than this is refused.
MAX_VOCABULARY_BYTES = 64 << 20
_NONE = 1 << 60
#: Most bytes of ids in one batch that goes back to Spark.
MOST_BATCH_BYTES = 256 << 20
#: Longer runs without a break are merged from a heap.
SHORT = 400


class ByteBpe(dict):
    """Words -> packed int32 ids.  A dict: known words cost one look-up, others are merged once."""

    def __init__(self, vocabulary: bytes, most_words: int = 400_000):
        super().__init__()
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.most_words = most_words
        self.find = regex.compile(PATTERN).findall

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: part boundaries with the rank of each part joined to its successor.

        The smallest rank is looked for again and again; its inner boundary is deleted and
        the ranks of the two neighbours are renewed, until no adjacent parts can be joined.
        """
        ranks = self.ranks
        if (whole := ranks.get(word)) is not None:
            return [whole]
        if len(word) > SHORT:
            return self._merge_long(word)
        bounds = list(range(len(word) + 1))
        joined = [ranks.get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
        while joined and (least := min(joined)) != _NONE:
            i = joined.index(least)
            del bounds[i + 1], joined[i]
            if i < len(joined):
                joined[i] = ranks.get(word[bounds[i] : bounds[i + 2]], _NONE)
            if i:
                joined[i - 1] = ranks.get(word[bounds[i - 1] : bounds[i + 1]], _NONE)
        return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]

    def _merge_long(self, word: bytes) -> list[int]:
        """The same merges for an unbroken run of any length, from a heap: n log n."""
        n, ranks = len(word), self.ranks
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if j < 0 or j >= n or end[j] != stop:
                continue  # one of the two parts has been joined since
            end[i], end[j] = stop, -1
            if stop < n:
                before[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[word[i : end[i]]])
            i = end[i]
        return ids

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.merge(word.encode("utf-8", "replace")), dtype="<i4").tobytes()
        if len(self) >= self.most_words:  # memory stays bounded on any corpus
            self.clear()
        self[word] = ids
        return ids

    def packed(self, text: str) -> bytes:
        return b"".join([self[w] for w in self.find(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), dtype="<i4").tolist()


def read_vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> bytes:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as file:
        data = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError("vocabulary file too large to broadcast")
    return data


_loaded: dict[int, ByteBpe] = {}


def _bpe(shared) -> ByteBpe:
    """The tables of this Python worker, built once."""
    if shared.id not in _loaded:
        _loaded.clear()
        _loaded[shared.id] = ByteBpe(shared.value)
    return _loaded[shared.id]


class _Shared:
    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id() if broadcast._jbroadcast else id(broadcast)

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value


def _lists(keys: pa.Array, packed: list[bytes], key: str) -> pa.RecordBatch:
    offsets = np.zeros(len(packed) + 1, dtype=np.int32)
    np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
    flat = pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))
    return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets), flat)], names=[key, "ids"])


def encode(docs: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """Operator: (key, ids) for every row; null and empty texts give the empty list.

    A narrow map: no shuffle, whole texts, each Arrow batch streamed.  Text that spells a
    special token is ordinary text.
    """
    shared = _Shared(docs.sparkSession.sparkContext.broadcast(read_vocabulary(name, folder)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(shared)
        for batch in batches:
            start, size, packed = 0, 0, []
            for n, text in enumerate(batch.column(1).to_pylist()):
                ids = bpe.packed(text) if text else b""
                if packed and size + len(ids) > MOST_BATCH_BYTES:  # offsets of a batch are 32 bits wide
                    yield _lists(batch.column(0).slice(start, len(packed)), packed, key)
                    start, size, packed = n, 0, []
                packed.append(ids)
                size += len(ids)
            yield _lists(batch.column(0).slice(start, len(packed)), packed, key)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def token_counts(docs: DataFrame, key: str, text: str, keep: list[str], name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, *keep, n_tokens) without materialising the ids."""
    shared = _Shared(docs.sparkSession.sparkContext.broadcast(read_vocabulary(name, folder)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(shared)
        for batch in batches:
            n = [len(bpe.packed(t)) // 4 if t else 0 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64())], names=[key, *keep, "n_tokens"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return docs.select(text, key, *keep).mapInArrow(run, f"{kinds}, n_tokens bigint")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode(table(spark, folder, "documents"), "doc_id", "text")
