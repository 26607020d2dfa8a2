"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichespark.operators.star import star_components
from nichespark.runtime import join_counted, settle

#: Shingles hashed at once, which bounds memory on very long texts.
BLOCK = 1 << 16
#: Variants made at once, and held in a pass over a bucket.
BLOCK_VARIANTS, PASS_VARIANTS = 1 << 20, 1 << 24


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """SimHash of one whole text: a bit is set if over half of the shingles' XXH64 have it set.

    A-Z are lower-cased, words are runs of characters other than space and \\x09-\\x0D, shingles
    are `width` words joined by spaces, repeats included; fewer words: all of them as one
    shingle; no word or a null text: 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-width]]).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    of, n, ones = xxhash.xxh64_intdigest, len(starts), np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        h = np.array([of(line[a:b], seed) for a, b in zip(starts[i : i + BLOCK], stops[i : i + BLOCK], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, keep columns, simhash (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t, width) for t in b.column(0).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(prints, pa.int64())], names=[*b.schema.names[1:], "simhash"])

    rows = docs.select(F.col(text_col).cast("string").alias("simhash_text"), id_col, *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:])
    return rows.mapInArrow(run, f"{kinds}, simhash long")


class Ball:
    """The variants of fingerprints within `half` flipped bits, dealt into 2**groups buckets.

    Bit j belongs to group j % groups; bit g of a bucket's number is the parity of group g. So a flip
    changes one bit of the number, and the variants of a fingerprint lie in few buckets (for two
    flips 1 + groups + pairs of groups), whatever their number is. A bucket needs the fingerprint once, and makes
    those of its variants that belong there; every variant is made in exactly one bucket.
    """

    def __init__(self, bits: int, half: int, groups: int):
        flips = [c for k in range(half + 1) for c in combinations(range(bits), k)]
        self.groups = groups
        self.parities = np.array([sum(1 << j for j in range(g, bits, groups)) for g in range(groups)], np.uint64)
        deltas: dict[int, list[int]] = {}
        for c in flips:
            to = 0
            for j in c:
                to ^= 1 << (j % groups) if groups else 0
            deltas.setdefault(to, []).append(sum(1 << j for j in c))
        self.by_delta = {d: np.array(m, np.uint64) for d, m in deltas.items()}

    def home(self, v: np.ndarray) -> np.ndarray:
        """The bucket of each fingerprint itself."""
        out = np.zeros(len(v), np.int64)
        for g, p in enumerate(self.parities):
            out |= (np.bitwise_count(v & p) & 1).astype(np.int64) << g
        return out

    def addresses(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every bucket that a fingerprint has variants in, with the fingerprint's place; sorted by bucket."""
        home, to = self.home(v), np.array(list(self.by_delta), np.int64)
        bucket = (home[:, None] ^ to[None, :]).ravel()
        order = np.argsort(bucket, kind="stable")
        return bucket[order], order // len(to)

    def _made(self, v: np.ndarray, bucket: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of fingerprints, and their variants in this bucket, by blocks."""
        off = self.home(v) ^ bucket
        for d, m in self.by_delta.items():
            rows, step = np.flatnonzero(off == d), max(1, BLOCK_VARIANTS // len(m))
            for i in range(0, len(rows), step):
                yield rows[i : i + step], v[rows[i : i + step], None] ^ m[None, :]

    def collisions(self, v: np.ndarray, bucket: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Variants that two fingerprints or more share, with the places of all these; sorted by variant, then place.

        The variants of a bucket are gone through in passes, by a hash, so that memory is bounded.
        """
        off = self.home(v) ^ bucket
        total = sum(int((off == d).sum()) * len(m) for d, m in self.by_delta.items())
        passes, fold = -(-total // PASS_VARIANTS), np.uint64(0x9E3779B97F4A7C15)
        for p in range(passes):

            def mine(keys: np.ndarray, p: int = p) -> np.ndarray:
                return ((keys * fold) >> np.uint64(32)) % np.uint64(passes) == p

            line = np.concatenate([k.ravel() if passes == 1 else k[mine(k)] for _, k in self._made(v, bucket)])
            line.sort()
            again = np.unique(line[1:][line[1:] == line[:-1]])
            del line
            if not len(again):
                continue
            # a small table of hashes first, so that few variants are searched for
            table = np.zeros(1 << 20, bool)
            table[((again * fold) >> np.uint64(44)).astype(np.int64)] = True
            keys, places = [], []
            for rows, k in self._made(v, bucket):
                i, j = np.nonzero(table[((k * fold) >> np.uint64(44)).astype(np.int64)])
                found = k[i, j]
                spot = np.minimum(np.searchsorted(again, found), len(again) - 1)
                hit = again[spot] == found
                keys.append(found[hit])
                places.append(rows[i[hit]])
            key, place = np.concatenate(keys), np.concatenate(places)
            order = np.lexsort((place, key))
            yield key[order], place[order]


def bucket_groups(n: int, variants: int, least: int, most: int) -> int:
    """Groups of bits, so that a bucket makes about 2**23 variants at most."""
    groups = least
    while groups < most and (n * variants) >> groups > 1 << 23:
        groups += 1
    return groups


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of edges (a, b) that join all that the edges join, without a circle (Boruvka's rounds)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label, chosen, left = np.arange(len(nodes)), [], np.arange(len(a))
    while True:
        p, q = label[x[left]], label[y[left]]
        open_ = p != q
        left, p, q = left[open_], p[open_], q[open_]
        if not len(left):
            return np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)
        # each component takes its first edge; places order all edges, so only pairs can choose the same one
        first = np.full(len(nodes), len(a))
        np.minimum.at(first, p, left)
        np.minimum.at(first, q, left)
        taken = np.unique(first[first < len(a)])
        chosen.append(taken)
        u, w = label[x[taken]], label[y[taken]]
        while len(u):
            low, high = np.minimum(u, w), np.maximum(u, w)
            np.minimum.at(label, high, low)
            while (label[label] != label).any():
                label = label[label]
            u, w = label[u], label[w]
            apart = u != w
            u, w = u[apart], w[apart]


def ball_links(prints: DataFrame, radius: int = 4, col: str = "simhash", groups: int | None = None) -> DataFrame:
    """a, b: links between distinct fingerprints that connect all within `radius` bits of each other.

    prints has distinct non-null fingerprints (signed longs), settled. radius is even. Every
    fingerprint emits all variants within radius / 2 bits (2,081 at radius 4); two fingerprints are
    within radius exactly if they share a variant. Variants are shuffled by bucket: a
    fingerprint travels once to each bucket that it has variants in, packed by blocks, and the
    bucket makes them (see Ball), so that the shuffle has 22 messages of 8 bytes for a fingerprint with 64
    buckets, 92 with 8,192. In a bucket all that share a variant are joined to the smallest of
    them; these pairs are counted once, verified bit by bit, and thinned to a spanning forest. There are as
    many partitions as buckets.
    As fingerprints are distinct, a variant has at most 2,081 of them, so no variant is hot.
    """
    if radius % 2 or radius < 0:
        raise ValueError("radius must be even")
    half = radius // 2
    n = prints.count()
    groups = bucket_groups(n, sum(math.comb(64, k) for k in range(half + 1)), 6, 32) if groups is None else groups

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = Ball(64, half, groups)
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(v):
                continue
            bucket, place = ball.addresses(v)
            data, starts = v[place].tobytes(), np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(starts[1:], len(bucket))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array([data[8 * i : 8 * j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())], names=["bucket", "packed"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.unique(np.frombuffer(b"".join(pdf["packed"]), np.uint64))
        found = []
        for key, place in Ball(64, half, groups).collisions(v, int(pdf["bucket"].iloc[0])):
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            head = np.repeat(place[new], np.diff(np.append(new, len(key))))
            pairs = np.unique(np.stack([head, place])[:, head != place], axis=1)
            a, b = v[pairs[0]], v[pairs[1]]
            near = np.bitwise_count(a ^ b) <= radius
            found.append((a[near], b[near]))
        if not found:
            return pd.DataFrame({"a": np.array([], np.int64), "b": np.array([], np.int64)})
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        some = spanning(a, b)
        return pd.DataFrame({"a": a[some].view(np.int64), "b": b[some].view(np.int64)})

    # few rows to a task would make many small messages
    packed = prints.select(col).coalesce(max(8, n >> 16)).mapInArrow(emit, "bucket long, packed binary")
    return packed.repartition(1 << groups, "bucket").groupBy("bucket").applyInPandas(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, keep columns, simhash, component_id: the smallest id that links of at most radius bits reach.

    Exact copies and equal fingerprints are one node, so their number adds no links; fingerprints with very
    many copies, and components of very many fingerprints, get their result by broadcast. Texts
    without a word (empty, blank, null) have fingerprint 0 and link like others. Null ids are
    passed by in the minimum (null if a component has no other). Repeated rows stay. Other
    columns, whatever their names, are ignored. No rows give no rows.
    """
    rows = settle(fingerprints(docs, width, id_col, text_col, keep))
    nodes = settle(rows.groupBy("simhash").agg(F.min(id_col).alias("rep"), F.count("*").alias("copies")))
    links = settle(ball_links(nodes.select("simhash"), radius))
    roots = star_components(links, "a", "b").select(F.col("node").alias("simhash"), "component")
    joined = settle(nodes.join(roots, "simhash", "left").withColumn("component", F.coalesce("component", "simhash")))
    least = settle(joined.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")))
    sizes = joined.agg(F.count("*"), F.sum("copies")).first()
    of = join_counted(joined.select("simhash", "component", "copies"), least, "component", sizes[0] or 0)
    of = settle(of.select("simhash", F.col("copies").alias("n"), "component_id"))
    return join_counted(rows, of, "simhash", sizes[1] or 0).select(id_col, *keep, "simhash", "component_id")
