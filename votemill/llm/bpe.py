"""Byte-level BPE with the ranks of a public tokenizer.

A text is split into words by the tokenizer's pattern; the bytes of a word are merged by rank.
A short word keeps one contiguous array of boundaries and one of the ranks of adjacent parts:
the array is scanned for its minimum, that boundary is deleted, and the two neighbouring ranks
are refreshed, until no adjacent parts form a token.  A long word (``LONG`` bytes) would make
that quadratic; it uses the same merges with a heap over a linked list.  Words are remembered,
up to ``MEMO_WORDS``.

Edge cases: null and empty texts give an empty list; the strings of special tokens are
ordinary text; lone surrogates, which UTF-8 cannot hold, are read as question marks.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votemill.llm.common import Shipped, map_batches

TOKENIZERS = "/opt/tokenizers"
LONG = 256
MEMO_WORDS = 300_000
# Fixed value: the word pattern of the public byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.split = regex.compile(PATTERN).findall
        self.memo: dict[str, tuple[int, ...]] = {}

    def __reduce__(self):
        return ByteBPE, (self.ranks,)

    def word(self, w: bytes) -> list[int]:
        """The ids of one word's bytes."""
        whole = self.ranks.get(w)
        if whole is not None:
            return [whole]
        return self._short(w) if len(w) <= LONG else self._long(w)

    def _short(self, w: bytes) -> list[int]:
        rank = self.ranks.get
        none = 1 << 31
        cut = list(range(len(w) + 1))
        near = [rank(w[i : i + 2], none) for i in range(len(w) - 1)]
        while near:
            low = min(near)
            if low == none:
                break
            i = near.index(low)
            del cut[i + 1]
            del near[i]
            if i < len(near):
                near[i] = rank(w[cut[i] : cut[i + 2]], none)
            if i:
                near[i - 1] = rank(w[cut[i - 1] : cut[i + 1]], none)
        return [self.ranks[w[a:b]] for a, b in zip(cut, cut[1:])]

    def _long(self, w: bytes) -> list[int]:
        rank, n = self.ranks.get, len(w)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(w[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, j = heapq.heappop(heap)
            mid = end[i]
            if not alive[i] or mid >= n or end[mid] != j:
                continue
            end[i], alive[mid] = j, False
            if j < n:
                before[j] = i
                if (r := rank(w[i : end[j]])) is not None:
                    heapq.heappush(heap, (r, i, end[j]))
            if (p := before[i]) >= 0 and (r := rank(w[p:j])) is not None:
                heapq.heappush(heap, (r, p, j))
        return [self.ranks[w[i : end[i]]] for i in range(n) if alive[i]]

    def _miss(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.word(word.encode("utf-8", "replace")))
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        if len(word) < 64:
            self.memo[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        get, miss = self.memo.get, self._miss
        return list(chain.from_iterable([get(w) or miss(w) for w in self.split(text)]))


@lru_cache(maxsize=2)
def load(name: str, folder: str = TOKENIZERS) -> ByteBPE:
    """The encoder of ``name``.tiktoken in ``folder``; the driver reads it and sends it to the tasks."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return ByteBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def encode(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """Columns ``key`` and ids: one row per row of ``df``; no shuffle."""

    sent = Shipped(df, load(name, folder))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = sent.get()
        all_ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
        offsets = np.zeros(len(all_ids) + 1, np.int32)
        np.cumsum([len(x) for x in all_ids], out=offsets[1:])
        flat = np.fromiter(chain.from_iterable(all_ids), np.int32, int(offsets[-1]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df.select(key, F.col(text).alias("__text")), work, f"{key} {kind}, ids array<int>")


def sizes(df: DataFrame, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The other columns of ``df`` and n_tokens; the text itself is not passed on."""
    others = [c for c in df.columns if c != text]

    sent = Shipped(df, load(name, folder))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = sent.get()
        n = pa.array([len(bpe.encode(t)) for t in batch.column(0).to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([*[batch.column(i + 1) for i in range(len(others))], n], names=[*others, "n_tokens"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others)
    return map_batches(df.select(text, *others), work, f"{schema}, n_tokens bigint")
