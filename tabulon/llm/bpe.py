"""Byte-level BPE encoding and decoding.

Each distinct pre-token of a batch is one row of a padded numpy matrix; rows of similar byte length
share a matrix. In every round each row merges its leftmost pair of least rank. Ranks of pairs come
from an open-addressing hash table, rows that have no pair left leave the matrix, and the merged
column is squeezed out, so that the matrix shrinks with the work that is left.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.int32(2**31 - 1)
#: Pre-tokens with more bytes than this are merged with a heap instead, as rounds over a row cost its length each.
WIDEST = 512
CELLS = 1 << 21
MEMO_WORDS = 300_000
BATCH_CHARS = 1 << 20


def load_ranks(data: bytes) -> list[bytes]:
    """The token of each rank from a .tiktoken file's bytes."""
    pairs = [line.split() for line in data.splitlines() if line.strip()]
    tokens = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PairTable:
    """Rank of a pair of token ids, by multiplicative hashing and linear probing."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NONE, np.int32)
        slot, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            s = slot[left]
            free = self.keys[s] == -1
            cand, at = left[free], s[free]
            at, first = np.unique(at, return_index=True)
            self.keys[at], self.ranks[at] = keys[cand[first]], ranks[cand[first]]
            left = np.setdiff1d(left, cand[first], assume_unique=True)
            slot[left] = (slot[left] + 1) & self.mask
        # A key moves on only past slots that another holds, so a look-up ends at its key or at a free slot.

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), NONE, np.int32)
        left = np.flatnonzero(keys >= 0)
        slot = self._slot(keys[left])
        for _ in range(self.probes):
            if not len(left):
                break
            found = self.keys[slot]
            hit = found == keys[left]
            out[left[hit]] = self.ranks[slot[hit]]
            on = ~hit & (found != -1)
            left, slot = left[on], (slot[on] + 1) & self.mask
        return out


class Codec:
    """Encodes and decodes with the ranks of one vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.find = regex.compile(pattern).findall
        self.size = len(tokens)
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        keys, ranks = [], []
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    ranks.append(rank)
        self.pairs = PairTable(np.array(keys, np.int64), np.array(ranks, np.int32))
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int32)
        self.vocab = np.frombuffer(b"".join(tokens), np.uint8)
        self.vlen = np.array([len(t) for t in tokens], np.int64)
        self.vstart = np.cumsum(self.vlen) - self.vlen
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.flat, self.length, self.start = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        key[(a < 0) | (b < 0)] = -1
        return self.pairs.get(key.ravel()).reshape(key.shape)

    def merge_matrix(self, words: list[bytes], width: int) -> list[np.ndarray]:
        """The ids of words of at most ``width`` bytes."""
        n = len(words)
        lens = np.fromiter(map(len, words), np.int64, n)
        m = np.full((n, width), -1, np.int32)
        m[np.arange(width) < lens[:, None]] = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        out: list[np.ndarray] = [None] * n  # type: ignore[list-item]
        row = np.arange(n)
        r = self.pair_rank(m[:, :-1], m[:, 1:])
        while len(row):
            if not r.shape[1]:
                live = np.zeros(len(row), bool)
            else:
                at = r.argmin(1)
                best = r[np.arange(len(row)), at]
                live = best != NONE
            if not live.all():
                for i in np.flatnonzero(~live):
                    ids = m[i]
                    out[row[i]] = ids[ids >= 0].copy()
                row, m = row[live], m[live]
                if not len(row):
                    break
                r, at, best = r[live], at[live], best[live]
            rows, w = np.arange(len(row)), m.shape[1]
            m[rows, at] = best
            keep = np.ones(m.shape, bool)
            keep[rows, at + 1] = False
            m = m[keep].reshape(len(row), w - 1)
            keep = np.ones(r.shape, bool)
            keep[rows, at] = False
            r = r[keep].reshape(len(row), w - 2)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < w - 2)
            r[left, at[left] - 1] = self.pair_rank(m[left, at[left] - 1], m[left, at[left]])
            r[right, at[right]] = self.pair_rank(m[right, at[right]], m[right, at[right] + 1])
        return out

    def merge_long(self, word: bytes) -> np.ndarray:
        """The same merges for one long word, by a heap of (rank, place) over a linked list."""
        ids = self.byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pair_rank(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(int(first[i]), i, ids[i], ids[i + 1]) for i in np.flatnonzero(first != NONE)]
        heapq.heapify(heap)

        def push(i: int) -> None:
            j = after[i]
            if j < n and (rank := int(self.pairs.get(np.array([ids[i] * self.size + ids[j]], np.int64))[0])) != NONE:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        return np.array([i for i in ids if i >= 0], np.int32)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        by_width: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            whole = self.rank.get(word)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif len(word) > WIDEST:
                out[i] = self.merge_long(word)
            else:
                by_width.setdefault(max(4, 1 << (len(word) - 1).bit_length()), []).append(i)
        for width, rows in by_width.items():
            step = max(1, CELLS // width)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for i, ids in zip(part, self.merge_matrix([words[i] for i in part], width)):
                    out[i] = ids
        return out

    def learn(self, words: list[str]) -> None:
        """Put new pre-tokens into the memo."""
        if not words:
            return
        found = self.encode_words([w.encode() for w in words])
        lens = np.fromiter(map(len, found), np.int64, len(found))
        base = len(self.length)
        self.memo.update(zip(words, range(base, base + len(words))))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(lens) - lens])
        self.length = np.concatenate([self.length, lens])
        self.flat = np.concatenate([self.flat, *found])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the number of ids of each."""
        if len(self.memo) > MEMO_WORDS:
            self.forget()
        split = [self.find(t) for t in texts]
        self.learn([w for w in dict.fromkeys(chain.from_iterable(split)) if w not in self.memo])
        n = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        lens = self.length[at]
        ids = gather(self.flat, self.start[at], lens)
        ends = np.concatenate([[0], np.cumsum(lens)])[np.cumsum(n)]
        return ids, np.diff(ends, prepend=0)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts, one after the other, and the number of bytes of each."""
        lens = self.vlen[ids]
        data = gather(self.vocab, self.vstart[ids], lens)
        ends = np.concatenate([[0], np.cumsum(lens)])[np.cumsum(counts)]
        return data, np.diff(ends, prepend=0)


def gather(values: np.ndarray, start: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The concatenation of values[s : s + l]."""
    total = int(lens.sum())
    at = np.arange(total)
    at += np.repeat(start - (np.cumsum(lens) - lens), lens)
    return values[at]


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about BATCH_CHARS together."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_CHARS:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


@lru_cache(1)
def _codec(ranks: bytes, pattern: str) -> Codec:
    """A worker's codec, kept from task to task."""
    return Codec(load_ranks(ranks), pattern)


def round_trip(docs: DataFrame, ranks: bytes, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns with ``ids`` array<int> (the encoded text) and ``decoded`` binary (those ids decoded).

    A null or empty text has no ids and empty bytes. Rows are independent: repeated rows, repeated ids
    and nulls in ``keep`` pass through as they are; other columns of ``docs`` are not read, so that
    their names can't clash; an empty table gives an empty table. Special tokens are ordinary text.
    """
    names = [f"_k{i}" for i in range(len(keep))]
    src = docs.select(*(F.col(k).alias(a) for k, a in zip(keep, names)), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            for i, j in slices(texts):
                ids, counts = codec.encode(texts[i:j])
                data, sizes = codec.decode(ids, counts)
                to = lambda n, kind: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(i, j - i) for k in range(len(names))),
                        pa.ListArray.from_arrays(to(counts, pa.int32()), pa.array(ids, pa.int32())),
                        pa.Array.from_buffers(pa.binary(), j - i, [None, to(sizes, pa.int32()).buffers()[1], pa.py_buffer(data)]),
                    ],
                    names=[*names, "ids", "decoded"],
                )

    kinds = ", ".join(f"{a} {src.schema[a].dataType.simpleString()}" for a in names)
    out = src.mapInArrow(run, f"{kinds}, ids array<int>, decoded binary")
    return out.withColumnsRenamed(dict(zip(names, keep)))


def digests(encoded: DataFrame) -> DataFrame:
    """The columns of the query from the columns of ``round_trip``."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def vocabulary(path: str | None = None) -> tuple[bytes, str]:
    """The bytes of a vocabulary file and the pattern of its pre-tokens; the default is the installed one."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def query(spark, sf_dir: str) -> DataFrame:
    from tabulon.llm.common import table

    return digests(round_trip(table(spark, sf_dir, "documents"), *vocabulary()))
