"""Exact top-k inner products: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz bounds."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nichespark.runtime import settle

#: Rows of a block of candidates and of a block of queries, and query blocks that one task holds against a block.
BLOCK, QUERIES, AT_ONCE = 4096, 1024, 64
LOWEST = np.iinfo(np.int64).min
#: Coordinates after which rotated partial sums are looked at.
STOPS = (8, 16, 32)


def _pack(ids: np.ndarray, vectors: np.ndarray) -> dict:
    """Ids, and integers in the smallest kind that holds them all, its width first."""
    most = int(np.abs(vectors).max(initial=0))
    kind = next(k for k in ("<i2", "<i4", "<i8") if most <= np.iinfo(k).max)
    return {"ids": ids.astype(np.int64).tobytes(), "vectors": kind[2].encode() + vectors.astype(kind).tobytes()}


def _unpack(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(vectors, f"<i{vectors[:1].decode()}", offset=1).astype(np.int64).reshape(len(i), -1)


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of q and v, all pairs given (same shape)."""
    return np.einsum("ij,ij->i", q, v)


def search_block(q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, ids: np.ndarray, v: np.ndarray, rotation: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k of one block for each query: positions of queries, ids, scores.

    least: a score that k others are known to reach (or the smallest long). Rows of v descend by
    length. A pair is given up once its partial sum over the leading rotated coordinates plus
    the product of what is left of both lengths is below what is needed; sums are rounded
    upwards by a margin for floating point. Pairs left are scored as integers.
    """
    n_q, n_v = len(q), len(v)
    rq, rv = q.astype(np.float64) @ rotation, v.astype(np.float64) @ rotation
    len_q, len_v = np.sqrt((rq**2).sum(1)), np.sqrt((rv**2).sum(1))
    need = least.astype(np.float64)
    out_q, out_id, out_s = [], [], []
    best = np.full((n_q, k), np.iinfo(np.int64).min)
    dims = rotation.shape[1]
    slack = 1e-9
    # strips of the longest vectors first: their scores raise what later ones need
    for at in range(0, n_v, 512):
        strip = slice(at, min(at + 512, n_v))
        alive = len_q * (len_v[strip.start] * (1 + slack)) + 1e-6 >= need
        rows = np.flatnonzero(alive)
        if not len(rows):
            break
        part, bound, done = np.zeros((len(rows), strip.stop - strip.start)), None, 0
        a, b = rq[rows], rv[strip]
        for stop in [s for s in STOPS if s < dims] + [dims]:
            part = part + a[:, done:stop] @ b[:, done:stop].T
            rest = np.sqrt((a[:, stop:] ** 2).sum(1))[:, None] * np.sqrt((b[:, stop:] ** 2).sum(1))[None, :]
            margin = slack * (len_q[rows][:, None] * len_v[strip][None, :]) + 1e-6
            bound = part + rest + margin >= need[rows][:, None]
            done = stop
            open_rows = bound.any(axis=1)
            if not open_rows.all():
                rows, part, a, bound = rows[open_rows], part[open_rows], a[open_rows], bound[open_rows]
            if not len(rows):
                break
        if not len(rows):
            continue
        i, j = np.nonzero(bound)
        i, j = rows[i], j + strip.start
        own = q_ids[i] != ids[j]
        i, j = i[own], j[own]
        s = np.empty(len(i), np.int64)
        for c in range(0, len(i), 1 << 18):
            s[c : c + (1 << 18)] = _exact(q[i[c : c + (1 << 18)]], v[j[c : c + (1 << 18)]])
        order = np.lexsort((ids[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        first = np.searchsorted(i, i, side="left")
        top = np.arange(len(i)) - first < k
        i, j, s = i[top], j[top], s[top]
        out_q.append(i)
        out_id.append(ids[j])
        out_s.append(s)
        for r in np.unique(i):
            mine = s[np.searchsorted(i, r, "left") : np.searchsorted(i, r, "right")]
            best[r] = np.sort(np.concatenate([best[r], mine]))[::-1][:k]
        low = best[:, -1]
        need = np.maximum(need, np.where(low == np.iinfo(np.int64).min, -np.inf, low.astype(np.float64)))
    if not out_q:
        none = np.array([], np.int64)
        return none, none, none
    i, d, s = np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_s)
    order = np.lexsort((d, -s, i))
    i, d, s = i[order], d[order], s[order]
    top = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
    return i[top], d[top], s[top]


def blocks_needed(tops: np.ndarray, cut: float) -> np.ndarray:
    """The blocks after the first whose longest vector is as long as the cut, with a margin for rounding."""
    return np.flatnonzero(tops[1:] * (1 + 1e-9) + 1e-6 >= cut) + 1


def exact_top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates of largest integer inner product.

    Components become floor(scale * x). Queries are the rows whose id is divisible by `every`,
    candidates all rows but those with the query's own id; ties go to the smaller id. Null
    vectors, and those with null or non-finite components, or null ids, take no part; an empty
    vector scores 0 with all others; shorter vectors count as padded with zeros. Repeated
    rows are candidates each. Components must keep inner products within 63 bits.

    Vectors are dealt into blocks by descending length (splitters from exact quantiles of a
    sketch of lengths); the rotation is that of the singular vectors of all candidates, from one
    summed Gram matrix (its square number of dimensions comes to the driver). The first block, of the
    longest vectors, is broadcast (BLOCK rows or twice as many) and gives every query a score that k
    candidates reach. That score over the query's length is the shortest vector that can still matter.
    Queries are put into blocks by it, and a query block is sent to the blocks with a vector
    of that length only; there partial sums prune pairs. Up to AT_ONCE query blocks meet a block in one
    task, others in another, so that the blocks of long vectors, which all queries need, are no hot tasks.
    """
    spark = vectors.sparkSession
    whole = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x")).where("id is not null and x is not null")
    whole = whole.where(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    ints = settle(whole.select("id", F.transform("x", lambda c: F.floor(c * float(scale)).cast("long")).alias("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))))
    shape = ints.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not shape["n"]:
        return spark.createDataFrame([], schema)
    dims, blocks = max(1, shape["d"]), -(-shape["n"] // BLOCK)

    def padded(column: pa.ListArray) -> np.ndarray:
        lens = column.value_lengths().to_numpy(zero_copy_only=False)
        out = np.zeros((len(lens), dims), np.int64)
        out[np.arange(dims)[None, :] < lens[:, None]] = column.flatten().to_numpy()
        return out

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for b in batches:
            m = padded(b.column(0)).astype(np.float64)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(dims), dims), pa.int32()), pa.array(np.tile(np.arange(dims), dims), pa.int32()), pa.array(total.ravel())], names=["i", "j", "g"])

    summed = ints.select("v").mapInArrow(gram, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).toPandas()
    g = np.zeros((dims, dims))
    g[summed["i"], summed["j"]] = summed["g"]
    rotation = np.linalg.eigh((g + g.T) / 2)[1][:, ::-1].copy()  # the right singular vectors, by falling singular value

    # blocks of about BLOCK rows by falling length; equal lengths are spread over the blocks they span
    marks = sorted({float(x) for x in ints.agg(F.percentile_approx("norm", [i / blocks for i in range(1, blocks)] or [0.5], 100 * blocks)).first()[0]}, reverse=True) if 1 < blocks <= 2000 else []
    if blocks > 2000:
        marks = sorted({float(x) for x in ints.agg(F.percentile_approx("norm", [i / 2000 for i in range(1, 2000)], 100_000)).first()[0]}, reverse=True)
    from nichespark.llm.prefix import _constant

    level = F.size(F.filter(_constant(marks, "array<double>"), lambda m: F.col("norm") < m)) if marks else F.lit(0)
    placed = ints.withColumn("level", level)
    sizes = {r["level"]: r["count"] for r in placed.groupBy("level").count().collect()}
    parts = _constant([max(1, -(-sizes.get(i, 0) // (2 * BLOCK))) for i in range(len(marks) + 1)], "array<int>")
    starts, at = [], 0
    for i in range(len(marks) + 1):
        starts.append(at)
        at += max(1, -(-sizes.get(i, 0) // (2 * BLOCK)))
    n_blocks = at
    block = F.get(_constant(starts, "array<int>"), F.col("level")) + F.pmod(F.xxhash64("id"), F.get(parts, F.col("level"))).cast("int")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["norm", "id"], ascending=[False, True])
        m = np.zeros((len(pdf), dims), np.int64)
        for i, x in enumerate(pdf["v"]):
            m[i, : len(x)] = x
        return pd.DataFrame([{"key": pdf["key"].iloc[0], "top": pdf["norm"].iloc[0], **_pack(pdf["id"].to_numpy(), m)}])

    packed = "key int, top double, ids binary, vectors binary"
    candidates = settle(placed.withColumn("key", block).select("key", "id", "v", "norm").groupBy("key").applyInPandas(pack, packed))
    tops = np.zeros(n_blocks)
    for r in candidates.select("key", "top").collect():
        tops[r["key"]] = r["top"]
    head = candidates.where("key = 0").select("ids", "vectors").first()
    first_block = spark.sparkContext.broadcast((bytes(head["ids"]), bytes(head["vectors"])))
    asked = ints.where(F.pmod("id", F.lit(every)) == 0).select("id", "v")
    result = "query_id long, vec_id long, score long"

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vs = _unpack(*first_block.value)
        for whole in batches:
            for at in range(0, whole.num_rows, QUERIES):
                b = whole.slice(at, QUERIES)
                q_ids, qs = b.column(0).to_numpy(), padded(b.column(1))
                i, d, s = search_block(q_ids, qs, np.full(len(q_ids), LOWEST), ids, vs, rotation, k)
                n = np.bincount(i, minlength=len(q_ids))
                # results stand by query, the best first; no score is needed yet where there are fewer than k
                last = np.cumsum(n) - 1
                least = np.where(n >= k, s[np.minimum(last, len(s) - 1)] if len(s) else LOWEST, LOWEST)
                ends = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(least), pa.ListArray.from_arrays(ends, pa.array(d)), pa.ListArray.from_arrays(ends, pa.array(s))], names=["id", "v", "least", "d", "s"])

    started = settle(asked.mapInArrow(start, "id long, v array<long>, least long, d array<long>, s array<long>"))
    found = started.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("d", "s")).alias("x")).select("query_id", F.col("x.d").alias("vec_id"), F.col("x.s").alias("score"))
    n_queries = started.count() if n_blocks > 1 else 0
    if n_queries:
        shared_tops = spark.sparkContext.broadcast(tops)
        # the shortest vector that can matter to a query: its product with the query's length must reach the score
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
        cut = F.when((F.col("least") <= 0) | (length == 0), F.lit(0.0)).otherwise(F.col("least").cast("double") / length)
        parts = max(1, min(4096, -(-n_queries // (4 * QUERIES))))
        sorted_queries = started.select("id", "v", "least", cut.alias("cut")).repartitionByRange(parts, "cut", "id").sortWithinPartitions(F.desc("cut"))

        def address(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            at_block, number = shared_tops.value, 0
            for whole in batches:
                for at in range(0, whole.num_rows, QUERIES):
                    b = whole.slice(at, QUERIES)
                    q_ids, least, cuts = (b.column(c).to_numpy() for c in (0, 2, 3))
                    to = blocks_needed(at_block, cuts.min())
                    packed, salt = _pack(q_ids, padded(b.column(1))), zlib.crc32(f"{TaskContext.get().partitionId()} {number}".encode()) % salts
                    number += 1
                    for i in range(0, len(to), 16):
                        part = to[i : i + 16]
                        same = [pa.array([x] * len(part), pa.binary()) for x in (packed["ids"], packed["vectors"], least.tobytes())]
                        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([salt] * len(part), pa.int32()), *same], names=["key", "salt", "q_ids", "q_vectors", "least"])

        salts = max(1, -(-n_queries // (QUERIES * AT_ONCE)))
        addressed = sorted_queries.mapInArrow(address, "key int, salt int, q_ids binary, q_vectors binary, least binary")
        copies = candidates.where("key > 0").select("key", "ids", "vectors", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(b.num_rows):
                    q_ids, qs = _unpack(b.column(0)[r].as_py(), b.column(1)[r].as_py())
                    ids, vs = _unpack(b.column(3)[r].as_py(), b.column(4)[r].as_py())
                    i, d, s = search_block(q_ids, qs, np.frombuffer(b.column(2)[r].as_py(), np.int64), ids, vs, rotation, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(d), pa.array(s)], names=["query_id", "vec_id", "score"])

        met = addressed.join(copies, ["key", "salt"]).select("q_ids", "q_vectors", "least", "ids", "vectors")
        found = found.unionByName(met.mapInArrow(search, result))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
