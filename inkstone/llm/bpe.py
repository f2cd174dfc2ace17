"""Encoding with a public byte-level BPE vocabulary.

Two tiers: a minimal perfect hash resolves whole pre-tokens that are in the vocabulary; the others,
whatever their length, are merged pair by pair, the pair of least rank first, by a heap over linked
bytes. The pre-tokens of a block share one heap: what comes out of it is a rank with all places of
its pairs. Pair ranks come from a second perfect hash. Each block of texts encodes a distinct
pre-token once.

Vocabulary files are read on the driver from a folder given as a parameter; the tasks get the tables by broadcast.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import mix, starts_of
from .perfect_hash import PerfectHash

FOLDER = "/opt/tokenizers"
#: Fixed value: the vocabulary's pattern of pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters encoded at once.
_BLOCK = 1 << 22
#: Places of a rank that are kept one by one; more stay an array.
_FEW = 64
_NEVER = np.int32(np.iinfo(np.int32).max)
_BASE = np.uint64(0x100000001B3)


def ragged(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices begin[i], begin[i] + 1, ... of length[i] places, for all i in a row."""
    total = int(length.sum())
    out = np.ones(total, np.int64)
    has = np.flatnonzero(length)
    if not len(has):
        return out
    at = np.cumsum(length[has])[:-1]
    out[0] = begin[has[0]]
    out[at] = begin[has[1:]] - (begin[has[:-1]] + length[has[:-1]] - 1)
    return np.cumsum(out)


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(max(n, 1), _BASE, np.uint64))


def _byte_keys(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit key of each run of bytes (all of them non-empty)."""
    place = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(starts_of(length), length)
    terms = (data[ragged(begin, length)].astype(np.uint64) + np.uint64(1)) * _powers(int(length.max(initial=1)))[place]
    return mix(np.add.reduceat(terms, starts_of(length))) if len(length) else np.zeros(0, np.uint64)


class Vocabulary:
    """Ranks of byte strings; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = sorted(ranks, key=ranks.get)
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.begin = starts_of(self.length)
        ids = np.array([ranks[t] for t in tokens], np.int32)
        self.place = np.zeros(int(ids.max()) + 1, np.int64)
        self.place[ids] = np.arange(len(ids))
        self.whole = PerfectHash(_byte_keys(self.data, self.begin, self.length), ids)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {(ranks[t[:k]] << 32) | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.pairs = PerfectHash(np.fromiter(pairs, np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        self.early = np.zeros(int(ids.max()) + 1, bool)  # tokens in a pair that ranks before them
        for pair, r in pairs.items():
            for t in (pair >> 32, pair & 0xFFFFFFFF):
                if r < t:
                    self.early[t] = True
        self.words = regex.compile(PATTERN)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.pairs.find(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64), _NEVER)

    def _known(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Ids of whole pre-tokens, -1 for those not in the vocabulary; a hit is compared byte by byte."""
        ids = self.whole.find(_byte_keys(data, begin, length), -1)
        hit = np.flatnonzero(ids >= 0)
        at = self.place[ids[hit]]
        same = self.length[at] == length[hit]
        ids[hit[~same]] = -1
        hit, at = hit[same], at[same]
        if len(hit):
            unlike = data[ragged(begin[hit], length[hit])] != self.data[ragged(self.begin[at], length[hit])]
            ids[hit[np.add.reduceat(unlike, starts_of(length[hit])) > 0]] = -1
        return ids

    def _overtaken(self, r: int, token: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether r, merged between left and right (places, -1: none), would form a pair that ranks before it; either neighbour may be r by then."""
        out = np.zeros(len(left), bool)
        for side, other in ((left, True), (right, False)):
            has = np.flatnonzero(side >= 0)
            own, beside = np.full(len(has), r, np.int32), token[side[has]]
            out[has] |= self._rank(*((beside, own) if other else (own, beside))) < r
        return out | (self._rank(np.array([r]), np.array([r]))[0] < r)

    def _merged(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens in a row, and how many each has, by a heap over linked bytes.

        The bytes of all pre-tokens lie in a row, each linked to its neighbours within the pre-token.
        The heap holds the ranks of the pairs that stand somewhere, and each rank the places of its
        pairs. The least rank comes out of the heap; its pairs are merged at all places at once, from
        the left where they overlap, and the pairs that arise go onto the heap. Pre-tokens don't
        touch each other, so each sees its own pairs merged in the order of their ranks.
        """
        many = len(begin)
        first = starts_of(length)
        token = self.of_byte[data[ragged(begin, length)]]
        n = len(token)
        word = np.repeat(np.arange(many), length)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[first + length - 1], before[first] = -1, -1
        rank = np.full(n, _NEVER, np.int32)
        paired = np.flatnonzero(after >= 0)
        rank[paired] = self._rank(token[paired], token[paired + 1])
        places: dict[int, list[int]] = {}
        blocks: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def push(at: np.ndarray, ranks: np.ndarray) -> None:
            if len(at) <= _FEW:
                for p, r in zip(at.tolist(), ranks.tolist(), strict=True):
                    if r in places:
                        places[r].append(p)
                    else:
                        places[r] = [p]
                        heapq.heappush(heap, r)
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cut = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
            for i, j, r in zip(cut, [*cut[1:], len(at)], ranks[cut].tolist(), strict=True):
                if r not in places:
                    places[r] = []
                    heapq.heappush(heap, r)
                if j - i > _FEW:
                    blocks.setdefault(r, []).append(at[i:j])
                else:
                    places[r] += at[i:j].tolist()

        has = np.flatnonzero(rank < _NEVER)
        push(has, rank[has])
        while heap:
            r = heapq.heappop(heap)
            j = np.array(sorted(set(places.pop(r))), np.int64)
            if r in blocks:
                j = np.unique(np.concatenate([j, *blocks.pop(r)]))
            j = j[rank[j] == r]  # at the other places one of the two has changed meanwhile
            if len(j) > 1:
                loose = np.ones(len(j), bool)
                loose[1:] = after[j[:-1]] != j[1:]
                at = np.arange(len(j))
                leads = (at - np.maximum.accumulate(np.where(loose, at, 0))) % 2 == 0
                if self.early[r]:  # where a pair that comes before r would arise, one place of a pre-token at a time
                    leads &= ~np.isin(word[j], word[j[self._overtaken(r, token, before[j], after[after[j]])]]) | (np.diff(word[j], prepend=-1) > 0)
                if not leads.all():
                    later, j = j[~leads], j[leads]
                    push(later, rank[later])
            elif not len(j):
                continue
            k = after[j]
            right = after[k]
            token[j], token[k] = r, -1
            rank[j], rank[k] = _NEVER, _NEVER
            after[j] = right
            has = right >= 0
            before[right[has]] = j[has]
            left = before[j]
            led = left >= 0
            x = np.concatenate([j[has], left[led]])
            if not len(x):
                continue
            new = self._rank(token[x], token[after[x]])
            rank[x] = new
            live = new < _NEVER
            if live.any():
                push(x[live], new[live])
        kept = token >= 0
        return token[kept], np.add.reduceat(kept, first).astype(np.int64) if many else np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        words: list[str] = []
        per_text = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            found = self.words.findall(t)
            per_text[i] = len(found)
            words += found
        if not words:
            return np.zeros(0, np.int32), per_text
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        each, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        offsets = np.frombuffer(distinct.buffers()[1], np.int64)[: len(distinct) + 1]
        data = np.frombuffer(distinct.buffers()[2], np.uint8)
        begin, length = offsets[:-1], np.diff(offsets)
        known = self._known(data, begin, length)
        missed = np.flatnonzero(known < 0)
        ids, many = self._merged(data, begin[missed], length[missed])
        count = np.ones(len(distinct), np.int64)
        count[missed] = many
        start = starts_of(count)
        flat = np.zeros(int(count.sum()), np.int32)
        flat[start[known >= 0]] = known[known >= 0]
        flat[ragged(start[missed], many)] = ids
        lengths = count[each]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        bounds = np.concatenate([[0], np.cumsum(per_text)])
        return flat[ragged(start[each], lengths)], np.diff(ends[bounds])


@lru_cache(4)
def vocabulary(name: str = "byte_bpe_50k", folder: str = FOLDER) -> Vocabulary:
    lines = Path(folder, f"{name}.tiktoken").read_bytes().split(b"\n")
    return Vocabulary({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)})


def _sent(df: DataFrame, name: str, folder: str):
    """The vocabulary with its hashes, built once on the driver and broadcast; its size is that of the vocabulary file."""
    return df.sparkSession.sparkContext.broadcast(vocabulary(name, folder))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    texts = [t or "" for t in batch.column("text").to_pylist()]
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop]) < _BLOCK):
            size += len(texts[stop])
            stop += 1
        yield start, texts[start:stop]
        start = stop


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """key, ids (list of integers) of every row, without special tokens; the list is empty for an empty and for a null text.

    Strings that spell special tokens are ordinary text. Rows are returned as often as they come.
    """

    sent = _sent(df, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        for b in batches:
            for start, texts in _blocks(b):
                ids, count = v.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("key").slice(start, len(texts)), lists], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """key, n_tokens of every row; 0 for an empty and for a null text."""

    sent = _sent(df, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        for b in batches:
            for start, texts in _blocks(b):
                yield pa.RecordBatch.from_arrays([b.column("key").slice(start, len(texts)), pa.array(v.encode(texts)[1], pa.int64())], names=[key, "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, n_tokens long")


def decode_ids(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """key, text of each list of ids; null for a null list. Ids outside the vocabulary are an error; bytes that are no text become replacement characters."""
    sent = _sent(encoded, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        for b in batches:
            lists = b.column("ids")
            at = v.place[lists.flatten().to_numpy()]
            data = v.data[ragged(v.begin[at], v.length[at])].tobytes()
            count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            total = np.concatenate([[0], np.cumsum(v.length[at])])
            ends = total[np.cumsum(count)]
            texts = [None if n is None else data[i:j].decode("utf-8", "replace") for i, j, n in zip(np.concatenate([[0], ends[:-1]]), ends, pc.list_value_length(lists).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(texts, pa.string())], names=[key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"`{key}` {kind}, text string")
