"""Near copies by Jaccard similarity of word shingles: ball hashing of several SimHashes, then exact similarity of what collides."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichespark.llm.simhash import Ball, bucket_groups, spanning
from nichespark.operators.star import star_components
from nichespark.runtime import fresh_name, join_counted, settle, settle_table

#: SimHashes of a text, and their bits. Two texts collide if one of them differs in at most 2 bits. At a similarity of 0.8 a bit
#: differs with a chance of 0.15, two texts of that similarity collide with a chance of 0.998, at 0.85 with 0.99998; a bit of
#: texts of a few shingles differs with a chance of up to 0.19, which makes it 0.92.
TABLES, BITS, HALF = 48, 32, 1
#: Colliding pairs that differ in more than so many of 64 other bits are given up (4 standard deviations above the mean at 0.8); pairs
#: within crowds too, if they differ in more than so many of all 1,600 (3 of them: a loss of 0.0013 at 0.8 and of less above it; the
#: last is for sets of under SMALL shingles).
FAR, FAR_OF_ALL, FAR_OF_SMALL, SMALL = 21, 285, 351, 40
#: Shingles whose bits are counted at once; a count fits into a byte.
BLOCK = 255
#: A variant of more nodes is gone through a second time, when most of them are known to be connected.
CROWD = 8
#: Words of fingerprints that are held against each other at once.
WORDS = 1 << 21
#: Pairs of one text that are verified in one task.
PAIRS = 1000


def shingles(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct XXH64 of a whole text's shingles, sorted.

    Words and their case are those of simhash.fingerprint: shingles are `width` words joined by
    spaces; fewer words: all of them as one shingle; no word or a null text: none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, of = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([of(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-width]]).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    return np.unique(np.fromiter((of(line[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts)))


@lru_cache(maxsize=1)
def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return tuple(rng.integers(0, 1 << 64, (1, TABLES + 2), dtype=np.uint64) for _ in range(2))


def simhashes(found: np.ndarray) -> np.ndarray:
    """TABLES SimHashes of BITS bits of a set, and two more that make the 64 bits of the first look. found: distinct shingles, one at least."""
    a, b = _factors()
    ones = np.zeros((TABLES + 2) * BITS, np.int64)
    for i in range(0, len(found), BLOCK):
        x = (found[i : i + BLOCK, None] ^ b) * (a | np.uint64(1))
        x ^= x >> np.uint64(29)
        high = ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype("<u4")
        ones += np.unpackbits(high.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(found), bitorder="little").view("<u4")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least so many percent."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sketch(stored: DataFrame, row: str, id_col: str, text_col: str, width: int) -> DataFrame:
    """row, id, node (hash of the set of shingles), n (their number) and prints (see simhashes; none without a word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, n, prints = [], [], []
            for t in b.column(2).to_pylist():
                s = shingles(t, width)
                p = simhashes(s) if len(s) else np.zeros(0, "<u4")
                node.append(xxhash.xxh64_intdigest(s.tobytes(), 7))
                n.append(len(s))
                prints.append(p.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(prints, pa.binary())], names=["row", "id", "node", "n", "prints"])

    rows = stored.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, f"row long, id {rows.schema['id'].dataType.simpleString()}, node long, n long, prints binary")


#: A node on its way to a bucket of the first pass: the other 64 bits, the number of its shingles, and the table's SimHash.
ENTRY = np.dtype([("node", "<i8"), ("look", "<u8"), ("n", "<u4"), ("print", "<u4")])
#: The same for the second pass: the node's label, and all its bits.
WHOLE = np.dtype([("node", "<i8"), ("label", "<i8"), ("n", "<u4"), ("prints", "<u4", TABLES + 2)])


def _sizes_fit(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of so many elements can be similar."""
    return np.minimum(a, b).astype(np.int64) * 100 >= np.maximum(a, b).astype(np.int64) * percent


def _variants(ball: Ball, v: np.ndarray, bucket: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all that share a variant, one such variant after the other, and how many each has; equal sets of places once."""
    for key, place in ball.collisions(v, bucket):
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        of = np.diff(np.append(new, len(key)))
        # equal sets of members have equal sums of hashes
        mixed = (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        once = np.unique(np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), new), return_index=True)[1]
        kept = np.isin(np.arange(len(new)), once)
        yield place[np.repeat(kept, of)], of[kept]


def _clusters(place: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places, by the clusters that shared variants make of them, and how many each cluster has."""
    members, at = np.unique(place, return_inverse=True)
    starts, run = np.cumsum(of) - of, np.repeat(np.arange(len(of)), of)
    label = np.arange(len(members))
    while True:
        new = label.copy()
        np.minimum.at(new, at, np.minimum.reduceat(label[at], starts)[run])
        new = new[new]
        if (new == label).all():
            break
        label = new
    order = np.argsort(label, kind="stable")
    return members[order], np.unique(label, return_counts=True)[1]


def _centres(look: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each run of `of` members the place of the one that is nearest to the majority of their bits."""
    starts = np.cumsum(of) - of
    ones = np.add.reduceat(np.unpackbits(look.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64), starts, axis=0)
    middle = np.packbits(2 * ones > of[:, None], axis=1).view(np.uint64).ravel()
    run = np.repeat(np.arange(len(of)), of)
    return np.lexsort((np.bitwise_count(look ^ middle[run]), run))[starts]


def first_pairs(entry: np.ndarray, ball: Ball, bucket: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of places in one table's bucket that may be similar, whether they are a crowd's, and the places of crowds.

    Variants of up to CROWD members give all their pairs, but those within a crowd. Larger ones are joined to crowds
    by the members that they share; the most central member of a crowd makes a pair with each other one.
    """
    one, two, many, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for place, of in _variants(ball, entry["print"].astype(np.uint64), bucket):
        size = np.repeat(of, of)
        few, run = place[size <= CROWD], np.repeat(np.arange(len(of)), of)[size <= CROWD]
        for d in range(1, CROWD):
            same = run[d:] == run[:-d]
            one.append(few[:-d][same])
            two.append(few[d:][same])
        many.append(place[size > CROWD])
        sizes.append(of[of > CROWD])

    def near(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (x != y) & (np.bitwise_count(entry["look"][x] ^ entry["look"][y]) <= FAR) & _sizes_fit(entry["n"][x], entry["n"][y], percent)
        pairs = np.unique(np.stack([np.minimum(x, y)[ok], np.maximum(x, y)[ok]]), axis=1)
        return pairs[0], pairs[1]

    place, of = np.concatenate(many), np.concatenate(sizes)
    x, y, crowd = np.concatenate(one), np.concatenate(two), place
    if len(of):
        crowd, of = _clusters(place, of)
        in_crowd = np.zeros(len(entry), bool)
        in_crowd[crowd] = True
        apart = ~(in_crowd[x] & in_crowd[y])
        x, y = x[apart], y[apart]
        u, w = near(np.repeat(crowd[_centres(entry["look"][crowd], of)], of), crowd)
    else:
        u = w = crowd
    x, y = near(x, y)
    return np.append(x, u), np.append(y, w), np.arange(len(x) + len(u)) >= len(x), crowd


def second_pairs(entry: np.ndarray, ball: Ball, table: int, bucket: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places of different labels in one table's bucket that may be similar, but for those that collide in a table before it."""
    words = np.ascontiguousarray(entry["prints"]).view("<u8")
    n, label, found = entry["n"], entry["label"], [np.zeros((2, 0), np.int64)]
    for place, of in _variants(ball, entry["prints"][:, table].astype(np.uint64), bucket):
        for members in np.split(place, np.cumsum(of)[:-1]):
            labels, at, times = np.unique(label[members], return_inverse=True, return_counts=True)
            if len(labels) < 2:
                continue
            # members of the largest label are held against the others only, and these against all
            rest = members[at != times.argmax()]
            step = max(1, WORDS // (len(members) * words.shape[1]))
            for i in range(0, len(rest), step):
                a, b = (x.ravel() for x in np.broadcast_arrays(rest[i : i + step, None], members[None, :]))
                ok = (label[a] != label[b]) & _sizes_fit(n[a], n[b], percent)
                a, b = a[ok], b[ok]
                limit = np.where(np.minimum(n[a], n[b]) < SMALL, FAR_OF_SMALL, FAR_OF_ALL)
                ok = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64) <= limit
                found.append(np.stack([np.minimum(a, b)[ok], np.maximum(a, b)[ok]]))
    x, y = np.unique(np.concatenate(found, axis=1), axis=1)
    first = np.ones(len(x), bool)
    for i in range(0, len(x), 1 << 16):
        part = slice(i, i + (1 << 16))
        first[part] = ~(np.bitwise_count(entry["prints"][x[part], :table] ^ entry["prints"][y[part], :table]) <= 2 * HALF).any(axis=1)
    return x[first], y[first]


def _dealt(nodes: DataFrame, n_nodes: int, kind: np.dtype, columns: list[str], groups: int | None, meet) -> DataFrame:
    """Nodes dealt into the buckets of all tables as entries of a kind; meet(entries, ball, table, bucket) gives columns a, b, central there.

    A table's fingerprints are dealt by simhash.Ball; every bucket makes the variants that belong there.
    """
    groups = bucket_groups(n_nodes, 1 + BITS, 0, 20) if groups is None else groups

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = Ball(BITS, HALF, groups)
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                b = whole.slice(start, 4096)
                entry = np.zeros(b.num_rows, kind)
                prints = np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4").reshape(-1, TABLES + 2)
                for name, column in zip(columns, b.columns[1:], strict=True):
                    entry[name] = column.to_numpy(zero_copy_only=False)
                if "look" in kind.names:
                    entry["look"] = np.ascontiguousarray(prints[:, TABLES:]).view("<u8").ravel()
                else:
                    entry["prints"] = prints
                keys, parts = [], []
                for t in range(TABLES):
                    if "print" in kind.names:
                        entry["print"] = prints[:, t]
                    bucket, place = ball.addresses(prints[:, t].astype(np.uint64))
                    starts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
                    for i, j in zip(starts, [*starts[1:], len(bucket)], strict=True):
                        keys.append((t << 32) | int(bucket[i]))
                        parts.append(entry[place[i:j]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(parts, pa.binary())], names=["bucket", "packed"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = int(pdf["bucket"].iloc[0])
        entry = np.frombuffer(b"".join(pdf["packed"]), kind)
        entry = entry[np.argsort(entry["node"])]
        a, b, central = meet(entry, Ball(BITS, HALF, groups), at >> 32, at & 0xFFFFFFFF)
        mask = b < 0
        return pd.DataFrame({"a": entry["node"][a], "b": pd.arrays.IntegerArray(entry["node"][np.where(mask, 0, b)] if len(b) else np.zeros(0, np.int64), mask), "central": central})

    packed = nodes.where(F.length("prints") > 0).select("prints", *columns).coalesce(max(8, n_nodes >> 16)).mapInArrow(emit, "bucket long, packed binary")
    return packed.repartition(TABLES << groups, "bucket").groupBy("bucket").applyInPandas(run, "a long, b long, central boolean")


def first_pass(nodes: DataFrame, n_nodes: int, percent: int, groups: int | None = None) -> DataFrame:
    """a, b, central: pairs of nodes of all tables' first_pairs; with b null: nodes of crowds. nodes: node, n, prints."""

    def meet(entry: np.ndarray, ball: Ball, table: int, bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, central, crowd = first_pairs(entry, ball, bucket, percent)
        return np.append(a, crowd), np.append(b, np.full(len(crowd), -1)), np.append(central, np.zeros(len(crowd), bool))

    return _dealt(nodes, n_nodes, ENTRY, ["node", "n"], groups, meet)


def second_pass(nodes: DataFrame, n_nodes: int, percent: int, groups: int | None = None) -> DataFrame:
    """a, b: pairs of nodes of all tables' second_pairs. nodes: node, label, n, prints."""

    def meet(entry: np.ndarray, ball: Ball, table: int, bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = second_pairs(entry, ball, table, bucket, percent)
        return a, b, np.zeros(len(a), bool)

    return _dealt(nodes, n_nodes, WHOLE, ["node", "label", "n"], groups, meet).select("a", "b")


def _verified(pairs: DataFrame, n_pairs: int, nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs a, b whose texts are similar. nodes: node, row; texts: row, t.

    A text of very many pairs is copied once for each PAIRS of them, so that they are no hot task.
    """
    counted = settle(pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("copies", F.expr(f"n div {PAIRS} + 1")))
    salted = join_counted(pairs, counted, "a", n_pairs).select("a", "b", F.pmod(F.xxhash64("b"), F.col("copies")).alias("salt"))
    needed = counted.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    held = settle_table(texts.join(nodes.join(needed, "node", "left_semi").select("node", "row"), "row").select("node", "t"))
    a = held.select(F.col("node").alias("a"), F.col("t").alias("ta")).join(counted.drop("n"), "a").select("a", "ta", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("salt"))
    b = held.select(F.col("node").alias("b"), F.col("t").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of = None, None
        for batch in batches:
            x, y, tx, ty = (c.to_pylist() for c in batch.columns)
            keep = []
            for i, k in enumerate(x):
                if k != last:
                    last, of = k, shingles(tx[i], width)
                keep.append(similar(of, shingles(ty[i], width), percent))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return settle(salted.join(b, "b").join(a, ["a", "salt"]).select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"))


def _labels(links: DataFrame, n_links: int) -> DataFrame:
    """node, label: the smallest node within two links; nodes of equal labels are connected."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = settle(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label"), F.count("*").alias("n")))
    far = join_counted(both.select("a", F.col("b").alias("node")), near.withColumnRenamed("a", "node"), "node", 2 * n_links)
    return far.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("label"))


def near_copy_links(nodes: DataFrame, n_nodes: int, texts: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """a, b: links between similar nodes that connect all similar nodes which collide.

    nodes: row, node, n, prints, settled, a row for each node; texts: row, t. Colliding pairs that may be
    similar are compared exactly. Of crowds (more than CROWD nodes with a variant) the pairs of the
    most central node come first; then, in a second pass over the nodes of crowds, all pairs that collide, are not
    known to be connected, and may be similar by all their bits. So a group of many near copies
    costs few comparisons each, and no cap is set.
    """
    met = settle(first_pass(nodes, n_nodes, percent))
    rows, texts = nodes.select("node", "row"), texts.select("row", "t")
    crowds = settle(met.where("b is null").select(F.col("a").alias("node")).distinct())
    pairs = met.where("b is not null")
    # of pairs within crowds, those with a central node only: the others are for the second pass
    tried = settle(pairs.where("central").unionByName(pairs.join(crowds, pairs["a"] == crowds["node"], "left_anti")).unionByName(pairs.join(crowds, pairs["b"] == crowds["node"], "left_anti")).select("a", "b").distinct())
    if not (n_tried := tried.count()):
        return tried
    links = _verified(tried, n_tried, rows, texts, width, percent)
    open_ = nodes.drop("row").join(crowds, "node", "left_semi")
    labelled = settle(open_.join(_labels(links, n_tried), "node", "left").select("node", "n", "prints", F.coalesce("label", "node").alias("label")))
    if not (n_open := labelled.count()):
        return links
    more = settle(second_pass(labelled, n_open, percent).distinct().join(tried, ["a", "b"], "left_anti"))
    return links.unionByName(_verified(more, n_more, rows, texts, width, percent)) if (n_more := more.count()) else links


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one document of each group of near copies: the one with the smallest id.

    Groups are connected by pairs whose sets of shingles of `width` words have a Jaccard similarity
    of at least so many percent. Texts with equal sets are one node; texts without a word are copies of
    each other. Repeated rows with the smallest id leave one; documents with a null id count
    after all others. Other columns, whatever their names, are kept as they are.
    """
    row = fresh_name(docs.columns, "copies_row")
    stored = settle_table(docs.withColumn(row, F.monotonically_increasing_id()))
    rows = settle(_sketch(stored, row, id_col, text_col, width))
    first = settle(rows.groupBy("node").agg(F.min("row").alias("row"), F.count("*").alias("copies")))
    nodes = settle(rows.join(first.select("row"), "row", "left_semi"))
    n_nodes, n_rows = first.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    links = near_copy_links(nodes, n_nodes, stored.select(F.col(row).alias("row"), F.col(text_col).cast("string").alias("t")), width, percent)
    of = first.select("node", F.col("copies").alias("n")).join(star_components(links, "a", "b"), "node", "left").select("node", "n", F.coalesce("component", "node").alias("component"))
    placed = join_counted(rows.select("row", "id", "node"), settle(of), "node", n_rows)
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))
    kept = placed.groupBy("component").agg(F.min_by("row", order).alias(row)).select(row)
    return stored.join(kept, row, "left_semi").drop(row)
