"""Byte-level BPE over padded numpy matrices."""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichespark.llm.tokenfile import no_cycles

#: White space as the pre-tokenizer's \s has it (Unicode White_Space).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Parts that the pre-tokenizer's pattern never joins: it attaches one space to what follows, and
#: leaves the last blank of a run to it.
COARSE = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
NEVER = np.int32(2**31 - 1)
#: Chunks and pieces that a worker remembers before it starts afresh, and bytes of the longest matrix row.
REMEMBERED, REMEMBERED_PIECES, LONGEST = 250_000, 600_000, 512


class PairTable:
    """Rank of a pair of ids by open addressing: key = left << 32 | right."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        size = 1 << max(4, int(len(rank) * 3).bit_length())
        self.mask, self.shift = np.int64(size - 1), np.uint64(64 - (size - 1).bit_length())
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NEVER, np.int32)
        key = (left.astype(np.int64) << 32) | right
        at, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = todo[self.keys[at[todo]] == -1]
            _, one = np.unique(at[free], return_index=True)
            placed = free[one]
            self.keys[at[placed]], self.values[at[placed]] = key[placed], rank[placed]
            todo = todo[self.keys[at[todo]] != key[todo]]
            at[todo] = (at[todo] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NEVER where there is none; a negative id makes no pair."""
        key = (left.astype(np.int64) << 32) | right
        out = np.full(key.shape, NEVER, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key, at = key[todo], None
        at = self._slot(key)
        while len(todo):
            held = self.keys[at]
            hit = held == key
            out[todo[hit]] = self.values[at[hit]]
            go = ~hit & (held != -1)
            todo, key, at = todo[go], key[go], (at[go] + 1) & self.mask
        return out


def tokens(ranks_file: bytes) -> np.ndarray:
    """The bytes of every id."""
    ranks = {int(r): base64.b64decode(t) for t, r in (line.split() for line in ranks_file.splitlines() if line.strip())}
    out = np.full(max(ranks) + 1, b"", object)
    out[list(ranks)] = list(ranks.values())
    return out


class Bpe:
    """Encoder and decoder of one rank file (lines of base64 token and rank)."""

    def __init__(self, ranks_file: bytes, pattern: str):
        import public_tokenizers

        pairs = [line.split() for line in ranks_file.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(t): int(r) for t, r in pairs}
        self.token = tokens(ranks_file)
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"bytes without a rank: {missing}")
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        found = [(a, b, r) for t, r in self.ranks.items() for i in range(1, len(t)) if (a := self.ranks.get(t[:i])) is not None and (b := self.ranks.get(t[i:])) is not None]
        self.pair = PairTable(*np.array(found, np.int64).reshape(-1, 3).T)
        self.pattern = regex.compile(pattern)
        # the coarse cut holds for the usual pattern; by another one whole texts are split
        self.coarse = pattern == public_tokenizers.PATTERN
        # ids as little-endian 32-bit integers
        self.pieces: dict[bytes, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _matrix(self, pieces: list[bytes], width: int) -> None:
        """Merge pieces of at most width bytes, a row each: in each round every row merges its leftmost pair of least rank."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.full((len(pieces), width), -1, np.int32)
        flat = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        ids[np.arange(width)[None, :] < lens[:, None]] = flat
        who = np.arange(len(pieces))
        rank = self.pair(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        while True:
            row = np.arange(len(who))
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(who), np.int64)
            best = rank[row, at] if rank.shape[1] else np.full(len(who), NEVER)
            done = best == NEVER
            left = ids[done]
            raw, ends = left[left >= 0].tobytes(), (4 * np.cumsum((left >= 0).sum(axis=1))).tolist()
            for w, a, b in zip(who[done].tolist(), [0, *ends], ends, strict=False):
                self.pieces[pieces[w]] = raw[a:b]
            if done.all():
                return
            # rows that have ended leave the matrix, and the others lose a column
            who, ids, rank, at, best = who[~done], ids[~done], rank[~done], at[~done], best[~done]
            row = np.arange(len(who))
            ids[row, at] = best
            keep = np.ones(ids.shape, bool)
            keep[row, at + 1] = False
            ids = ids[keep].reshape(len(who), -1)
            keep = np.ones(rank.shape, bool)
            keep[row, at] = False
            rank = rank[keep].reshape(len(who), -1)
            if not rank.shape[1]:
                continue
            before = np.maximum(at - 1, 0)
            has = at > 0
            rank[row[has], before[has]] = self.pair(ids[row[has], before[has]], ids[row[has], at[has]])
            has = at < rank.shape[1]
            rank[row[has], at[has]] = self.pair(ids[row[has], at[has]], ids[row[has], at[has] + 1])

    def _long(self, piece: bytes) -> None:
        """The same merges for one long piece, by a heap of (rank, place) over a linked list."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, ahead, token = list(range(1, n + 1)), list(range(-1, n - 1)), [bytes([b]) for b in piece]
        heap = [(r, i) for i in range(n - 1) if (r := self.ranks.get(token[i] + token[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or self.ranks.get(token[i] + token[j]) != r:
                continue
            token[i], ids[i], ids[j] = token[i] + token[j], r, -1
            after[i] = after[j]
            if after[j] < n:
                ahead[after[j]] = i
            for a, b in ((ahead[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := self.ranks.get(token[a] + token[b])) is not None:
                    heapq.heappush(heap, (r, a))
        self.pieces[piece] = np.array([x for x in ids if x >= 0], "<i4").tobytes()

    def learn(self, pieces: set[bytes]) -> None:
        """Encode pieces, bucketed by length."""
        buckets: dict[int, list[bytes]] = {}
        for p in pieces:
            if (r := self.ranks.get(p)) is not None:
                self.pieces[p] = r.to_bytes(4, "little")
            elif len(p) > LONGEST:
                self._long(p)
            else:
                n = len(p)
                buckets.setdefault(n if n <= 24 else 1 << (n - 1).bit_length(), []).append(p)
        for width, of in buckets.items():
            step = max(1, (1 << 22) // width)
            for i in range(0, len(of), step):
                self._matrix(of[i : i + step], width)

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts."""
        return [np.frombuffer(x, "<i4").tolist() for x in self.encode_raw(texts)]

    def encode_raw(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit integers: each chunk that is new is split by the pattern, each piece that is new is merged."""
        parts = [COARSE.findall(t) for t in texts] if self.coarse else [[t] if t else [] for t in texts]
        if len(self.chunks) >= REMEMBERED:
            self.chunks = {}
        if len(self.pieces) >= REMEMBERED_PIECES:
            self.pieces = {}
        new = set().union(*parts).difference(self.chunks)
        split = {c: [x.encode("utf-8", "surrogatepass") for x in self.pattern.findall(c)] for c in new}
        self.learn({x for s in split.values() for x in s if x not in self.pieces})
        pieces, chunks = self.pieces, self.chunks
        for c, s in split.items():
            chunks[c] = b"".join(map(pieces.__getitem__, s))
        return [b"".join(map(chunks.__getitem__, p)) for p in parts]

    def decode_ids(self, ids: list[int]) -> bytes:
        return b"".join(self.token[ids].tolist())


@lru_cache(maxsize=2)
def _codec(ranks_file: bytes, pattern: str) -> Bpe:
    return Bpe(ranks_file, pattern)


def _settings(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with `ids`: the BPE ids of the whole text (null: none), without special tokens.

    The rank file (a parameter, by default that of 50k byte-level ranks) is read on the driver
    and broadcast; its size doesn't depend on the data. Texts are cut into chunks at places that
    the pattern never joins; chunks and pieces already seen by a worker are looked up (the memory
    for them is bounded), others are encoded. Every row is encoded by itself, so ties, repeated
    rows and nulls in other columns make no difference; a column named `ids` is replaced.
    """
    path, pattern = _settings(path, pattern)
    with open(path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.drop("ids")
    at = rows.columns.index(text_col)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        # passes over the remembered chunks would cost much
        with no_cycles():
            for whole in batches:
                for i in range(0, whole.num_rows, 512):
                    b = whole.slice(i, 512)
                    ids = codec.encode_raw([t or "" for t in b.column(at).to_pylist()])
                    ends = (np.cumsum([0, *map(len, ids)]) // 4).astype(np.int32)
                    flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends), flat)], names=[*b.schema.names, "ids"])

    return rows.mapInArrow(run, f"{kinds}, ids array<int>")


def decode(rows: DataFrame, ids_col: str = "ids", path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """rows with `decoded`: the bytes of the ids (null: none), in place of the ids unless keep_ids.

    Null ids within a list are passed by; ids outside the vocabulary raise.
    """
    path, _ = _settings(path, None)
    with open(path, "rb") as f:
        shared = rows.sparkSession.sparkContext.broadcast(f.read())
    rows = rows.drop("decoded")
    at = rows.columns.index(ids_col)
    kept = [f for f in rows.schema if keep_ids or f.name != ids_col]
    kinds = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "decoded binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = tokens(shared.value)
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                b = whole.slice(i, 512)
                column = b.column(at)
                flat = column.flatten()
                known = flat.drop_null().to_numpy()
                counts = [0 if x is None else len(x) - x.count(None) for x in column.to_pylist()] if flat.null_count else column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                pieces, ends = token[known].tolist(), np.cumsum(np.concatenate([[0], counts])).astype(int).tolist()
                texts = [b"".join(pieces[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
                columns = [c for i, c in enumerate(b.columns) if keep_ids or i != at]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary())], names=[*[f.name for f in kept], "decoded"])

    return rows.mapInArrow(run, kinds)
