"""Each operator against a brute-force version, on odd rows and on no rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from nichespark.llm import bpe, langid, mixing, prefix, quality, sharding, simhash, tokencount, tokenfile, topk, warc

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(r):
    return (r[0] is None, r[0] or 0, r[1] or "")


def test_sharding(odd, none, odd_rows):
    got = sharding.assign_shards(odd, 5).collect()
    assert len(got) == len(odd_rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted((d is None, d or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in odd_rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign_shards(none, 5).count() == 0


def test_shards_are_even_and_keep_groups(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), (F.col("id") / 2).cast("int").cast("string"))).alias("text"))
    got = sharding.assign_shards(df, 24).toPandas()
    per = got.groupby("shard")["size"].sum()
    assert len(per) == 24 and per.max() - per.min() < 0.05 * per.mean()
    small = got.groupby("text_crc32").filter(lambda g: len(g) < 10)
    assert (small.groupby("text_crc32")["shard"].nunique() == 1).all()
    again = sharding.assign_shards(df.repartition(7), 24).toPandas()
    assert got.sort_values("doc_id")["shard"].tolist() == again.sort_values("doc_id")["shard"].tolist()


def test_small_groups_are_never_torn(spark):
    """A range that a hot group overfills is subdivided until none is; groups of a few rows stay whole, hot ones are cut."""
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), (F.col("id") / 12).cast("int").cast("string"))).alias("text"))
    got = sharding.assign_shards(df, 6).toPandas()
    hot = zlib.crc32(b"hot")
    assert (got[got["text_crc32"] != hot].groupby("text_crc32")["shard"].nunique() == 1).all()
    assert got[got["text_crc32"] == hot]["shard"].nunique() > 1
    rows = df.select(F.crc32("text").alias("a"), F.col("doc_id").alias("b"), F.lit(10).cast("long").alias("w"))
    order = prefix.range_order(rows, ["a", "b"], "w", min_ranges=96, keep_groups=True)
    assert order.hot == (hot,)
    sizes = order.rows.groupBy("range_id").count().toPandas()["count"]
    assert sizes.max() <= 2 * 30_000 / 96
    assert order.rows.where(F.col("a") != hot).groupBy("a").agg(F.countDistinct("range_id").alias("n")).agg(F.max("n")).first()[0] == 1


def test_range_order_is_exact(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(20), rng.randrange(-50, 50), i, rng.randrange(1, 90)) for i in range(3000)]
    order = prefix.range_order(spark.createDataFrame(rows, "a long, b long, c long, w long"), ["a", "b", "c"], "w", min_ranges=40, draws=4)
    got, ahead = {tuple(r[:3]): (r["rank"], r["before"]) for r in order.rows.select("a", "b", "c", "rank", "before").collect()}, 0
    for i, r in enumerate(sorted(rows)):
        assert got[r[:3]] == (i, ahead)
        ahead += r[3]


def slow_fingerprint(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, prints, radius):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(i)
    least = {}
    for g in groups.values():
        known = [ids[i] for i in g if ids[i] is not None]
        least |= {i: min(known) if known else None for i in g}
    return least


def test_simhash(odd, none, odd_rows):
    got = simhash.near_duplicates(odd).collect()
    prints = [slow_fingerprint(r[1]) for r in odd_rows]
    least = components([r[0] for r in odd_rows], prints, 4)
    want = Counter((r[0], p, least[i]) for i, (r, p) in enumerate(zip(odd_rows, prints)))
    assert Counter((r["doc_id"], r["simhash"] & (2**64 - 1), r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("radius, groups", [(4, 6), (4, 8), (2, 0)])
def test_ball_links_find_all_and_only(spark, radius, groups):
    rng = random.Random(radius)
    prints = set()
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(6):
            prints.add(base)
            for _ in range(rng.randrange(1, radius + 3)):
                base ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.ball_links(spark.createDataFrame([(s,) for s in signed], "simhash long"), radius, groups=groups).cache()
    # every link is within the radius, and none is made twice
    assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= radius for r in links.collect())
    groups = components(signed, prints, radius)
    parent = {s: s for s in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links.collect():
        parent[max(find(r["a"]), find(r["b"]))] = min(find(r["a"]), find(r["b"]))
    assert {s: find(s) for s in signed} == {signed[i]: g for i, g in groups.items()}


@pytest.mark.parametrize("groups", [0, 5, 13])
def test_buckets_make_every_variant_once(monkeypatch, groups):
    monkeypatch.setattr(simhash, "PASS_VARIANTS", 500)
    monkeypatch.setattr(simhash, "BLOCK_VARIANTS", 64)
    rng = np.random.default_rng(groups)
    v = rng.integers(0, 1 << 32, 30, dtype=np.uint64)
    v = np.concatenate([v, v ^ np.uint64(5), v[:9] ^ np.uint64(1 << 31)])
    ball, want = simhash.Ball(32, 1, groups), defaultdict(set)
    for i, x in enumerate(v.tolist()):
        for m in (0, *(1 << j for j in range(32))):
            want[x ^ m].add(i)
    bucket, place = ball.addresses(v)
    got = defaultdict(set)
    for b in np.unique(bucket).tolist():
        mine = place[bucket == b]
        for key, at in ball.collisions(v[mine], b):
            for k, i in zip(key.tolist(), mine[at].tolist()):
                assert i not in got[k]
                got[k].add(i)
    assert {k: s for k, s in got.items()} == {k: s for k, s in want.items() if len(s) > 1}


def test_spanning_forest():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 30, (2, rng.integers(0, 60)))
        a, b = a[a != b], b[a != b]
        some = simhash.spanning(a, b)
        root = list(range(30))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for i in some.tolist():
            assert find(a[i]) != find(b[i])  # no circle
            root[find(a[i])] = find(b[i])
        assert all(find(x) == find(y) for x, y in zip(a.tolist(), b.tolist()))


def test_mixing(odd, none, odd_rows):
    got = mixing.mix_counts(odd).collect()
    sizes = Counter()
    for r in odd_rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, mixing.share_out([sizes[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))], mixing.Fraction(sum(sizes.values()) * 3, 2), 2)))
    assert float(sum(targets.values())) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(t <= 2 * sizes[n] for n, t in targets.items())
    size_of = {r["source_size"]: r["target"] for r in got}
    assert size_of == pytest.approx({sizes[n]: float(t) for n, t in targets.items()}, abs=1e-5)
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2 for r in got) and len(got) == len(odd_rows)
    total = Counter()
    for r in got:
        total[r["source_size"]] += r["taken"]
    most = max(len(WORD.findall(r[1] or "")) for r in odd_rows)
    assert all(abs(total[s] - t) <= most for s, t in size_of.items())
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_counts(odd.repartition(5)).collect()))
    assert mixing.mix_counts(none).count() == 0


def test_mix_emits_rows(odd):
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == mixing.mix_counts(odd).agg(F.sum("copies")).first()[0]


def test_quality(odd, none, odd_rows):
    got = quality.judge(odd).toPandas()

    def measure(t):
        w = WORD.findall(t or "")
        win = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) for k in range(3) if win[tuple(w[i : i + 3])] > 1}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)

    want = Counter((r[0], *(m := measure(r[1])), m[0] < 50 or 100 * m[4] > 50 * m[0]) for r in odd_rows)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert Counter(tuple(None if x != x else x for x in r) for r in got[cols].itertuples(index=False)) == want
    assert not (got["kept"] & got["base_failed"]).any() and got["kept"].sum() > 50
    assert quality.judge(none).count() == 0


QUALITY_SCHEMA = "doc_id long, text string, lang string, source string"


def test_quality_drops_junk_and_keeps_clean(spark):
    rows = [(i, prose(i, 60 + i), "en", "s") for i in range(300)] + [(1000 + i, " ".join(w + "###" for w in prose(i, 100).split()), "en", "s") for i in range(60)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, QUALITY_SCHEMA)).collect()}
    assert all(got[i] == (i < 1000) for i in got)


def test_quality_fences_follow_their_group(spark):
    """What is usual in one source is not in another; every group's spread is above zero, and no constant bounds it."""
    rng = random.Random(3)

    def dense(i, share):
        return " ".join(w + ("$" if rng.random() < share else "") for w in prose(i, 60 + i).split())

    rows = [(i, prose(i, 60 + i), "en", "prose") for i in range(300)]
    rows += [(1000 + i, dense(i, 0.3), "en", "tables") for i in range(300)]
    rows += [(2000 + i, dense(i, 0.4), "en", "prose") for i in range(20)]
    rows += [(3000 + i, dense(i, 1.0) + " $" * 900, "en", "tables") for i in range(20)]
    df = spark.createDataFrame(rows, QUALITY_SCHEMA)
    got = {r["doc_id"]: r["kept"] for r in quality.judge(df).collect()}
    assert all(got[i] for i in got if i < 2000)
    assert not any(got[i] for i in got if 2000 <= i < 3000)
    assert not any(got[i] for i in got if 3000 <= i)
    measured = df.select(F.col("lang").alias("q_lang"), F.col("source").alias("q_source"), *[c.alias(k) for k, c in quality.measures(F.col("text")).items()]).select("*", "of_words.*")
    rule = quality.RULES["symbol_rate"]
    sketch = quality.sketches(measured.withColumn("symbol_rate", F.expr(rule.smooth).cast("long")), ["symbol_rate"], ["q_lang", "q_source"])
    q = {r["q_source"]: r["q"] for r in quality.quantiles(sketch, ["q_lang", "q_source"]).collect()}
    assert all(x["top"] > x["mid"] > 0 for x in q.values()) and q["tables"]["mid"] > 5 * q["prose"]["mid"]


def test_quality_keeps_short_texts_if_asked(spark):
    rows = [(i, prose(i, 60 + i), "en", "s") for i in range(150)] + [(1000, "Short and clean.", "en", "s"), (1001, "so so so so so so", "en", "s"), (1002, None, "en", "s")]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, QUALITY_SCHEMA), min_words=1).collect()}
    assert got[1000] and not got[1001] and not got[1002]


def test_very_long_windows(spark):
    rng = random.Random(8)
    w = [rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("abcdefghij") for _ in range(33_000)]
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    want = len({i + k for i in range(len(w) - 2) for k in range(3) if c[tuple(w[i : i + 3])] > 1})
    df = spark.createDataFrame([(" ".join(w),)], "t string")
    assert df.select(quality.repeated_words(quality.words_of(F.col("t"))).alias("n")).first()["n"] == want


@pytest.fixture(scope="module")
def reference_bpe():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        data = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return data, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_codec(reference_bpe):
    data, pattern, want = reference_bpe
    own, rng = bpe.Bpe(data, pattern), random.Random(1)
    letters = [chr(i) for i in range(0x250)] + list(" \t\n\r\x0b\x1c\x85\xa0 　'stre中文😀²½") * 6
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(3000)] + ["a" * 3000, "ab" * 700, " " * 700 + "x", "\n" * 600, "é" * 700, "", "'s't're"]
    ids = own.encode_batch(texts)
    assert ids == [want.encode_ordinary(t) for t in texts]
    assert [own.decode_ids(i) for i in ids] == [t.encode() for t in texts]


def test_bpe(odd, none, odd_rows, reference_bpe):
    both = bpe.decode(bpe.encode(odd.select("doc_id", "text", "ids")), keep_ids=True)
    want = Counter((r[0], tuple(reference_bpe[2].encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in odd_rows)
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in both.collect()) == want
    assert bpe.decode(bpe.encode(none.select("doc_id", "text"))).count() == 0


def test_decode_nulls(spark):
    df = spark.createDataFrame([(1, [0, None, 1]), (2, None), (3, [])], "i int, ids array<int>")
    assert {r["i"]: bytes(r["decoded"]) for r in bpe.decode(df).collect()} == {1: b'!"', 2: b"", 3: b""}


def test_topk(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(0, 0.3, (900, 12)), rng.normal(0, 3, (40, 12)), np.zeros((20, 12))])
    v[100] = v[101] = v[5]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 12), (2003, [float("inf")] * 12), (None, [1.0] * 12), (7, [float(x) for x in v[7]])]
    got = topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=10, every=50)
    ids, q = [r[0] for r in rows if r[0] is not None and r[0] < 2000], np.floor(1024 * np.array([r[1] for r in rows if r[0] is not None and r[0] < 2000])).astype(int)
    want = []
    for i, a in sorted({(i, tuple(a)) for i, a in zip(ids, q.tolist()) if i % 50 == 0}):
        best = sorted((-int(np.dot(a, b)), j) for j, b in zip(ids, q) if j != i)[:10]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    one = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (3, [])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.exact_top_k(one).collect())) == [(0, 1, 1, 2048 * 1024), (0, 2, 3, 0)]


def test_topk_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES", 4)
    v = np.random.default_rng(5).normal(0, 1, (700, 6))
    got = topk.exact_top_k(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>"), k=3, every=40)
    q = np.floor(1024 * v).astype(int)
    want = [(i, n + 1, j, -s) for i in range(0, 700, 40) for n, (s, j) in enumerate(sorted((-int(q[i] @ q[j]), j) for j in range(700) if j != i)[:3])]
    assert sorted(map(tuple, got.collect())) == want


def test_topk_sends_queries_to_needed_blocks_only(spark, monkeypatch):
    for name, value in (("BLOCK", 64), ("QUERIES", 4), ("AT_ONCE", 1)):
        monkeypatch.setattr(topk, name, value)
    made, needed = [], topk.blocks_needed
    assert needed(np.array([9.0, 5.0, 4.0, 0.0]), 4.5).tolist() == [1] and needed(np.array([9.0, 5.0]), 6).tolist() == []
    # most vectors are too short for the longest queries, and are never sent any
    v = np.random.default_rng(6).normal(0, 1, (1500, 5)) * np.where(np.arange(1500) % 10 == 0, 10.0, 0.01)[:, None]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = topk.exact_top_k(df, k=3, every=50)
    q = np.floor(1024 * v).astype(int)
    want = [(i, n + 1, j, -s) for i in range(0, 1500, 50) for n, (s, j) in enumerate(sorted((-int(q[i] @ q[j]), j) for j in range(1500) if j != i)[:3])]
    assert sorted(map(tuple, got.collect())) == want
    tops = np.sort(np.sqrt((q.astype(float) ** 2).sum(axis=1)))[::-1][::64]
    for i in range(0, 1500, 50):
        made.append(len(needed(tops, want[i // 50 * 3 + 2][3] / np.sqrt((q[i].astype(float) ** 2).sum()))))
    assert max(made) <= 4 and len(tops) == 24


def test_language(odd, none, spark):
    from tests.llm.conftest import prose

    german = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei".split()
    rng = random.Random(2)
    rows = [(i, prose(i, 80), "en") for i in range(60)] + [(100 + i, " ".join(rng.choice(german) for _ in range(80)), "de") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id % 4 <> 2"))
    got = langid.predict(df.drop("lang").withColumn("score", F.lit("x")), model).where("doc_id % 4 = 2").collect()
    assert all(r["lang_pred"] == ("en" if r["doc_id"] < 100 else "de") and 0 <= r["score"] <= 1 for r in got)
    empty = langid.predict(odd.select("doc_id", "text"), model).collect()
    assert all((r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", r["text"] or "")) for r in empty)
    assert langid.predict(none.select("doc_id", "text"), langid.fit(none)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(df, langid.train({})).collect()} == {"und"}


def test_phrases_are_greedy_longest_matches(monkeypatch):
    text = "abracadabra banana cadabra"
    model = langid.train({"x": [text]})
    rng = random.Random(3)
    for _ in range(200):
        t = "".join(rng.choice("abrcdn z") for _ in range(rng.randrange(1, 40)))
        t = re.sub(" +", " ", t)
        n, at = 0, 0
        while at < len(t):
            end = at
            while end < len(t) and t[at : end + 1] in text and "z" not in t[at : end + 1]:
                end += 1
            at = max(end, at + 1)
            n += 1
        assert langid.Parser(model).phrases([t])[0][0, 0] == n, t


def pages(spark):
    a, b = "<p>same</p>" * 200, "<p>small</p>"
    rows = [(1, "http://www.Example.com/b?x=1", a), (2, "https://example.com/a", a), (9, None, a), (9, None, a), (3, "http://a.org", b), (4, "http://a.org", b), (5, "bad\r\nurl ://", None), (None, "http://é.de:8080/ü#f", a), (6, "", "\x00\r\n\r\nWARC/1.1\r\n" * 90), (7, "http://b.org/", "é" * 700_000)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("fetched", F.timestamp_seconds(F.coalesce("page_id", F.lit(0)) + 10)).withColumn("digest", F.lit("clash"))


def test_warc(spark, monkeypatch):
    for name, value in (("CHUNK", 1 << 12), ("CHUNKS", 2), ("RANGE", 2)):
        monkeypatch.setattr(warc, name, value)
    rows, df = pages(spark)
    folder = warc.write_archives(df.repartition(3))
    read = warc.read_archives(spark, folder, with_payload=True).collect()
    html = Counter((p, (h or "").encode()) for p, _, h in rows)
    for r in read:
        if r["record_type"] == "response":
            assert (r["page_id"], bytes(r["payload"])) in html
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read)
    big = rows[0][2]

    def want(p, h):
        raw = (h or "").encode()
        revisit = h == big and p != 9
        return p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None

    assert got == Counter(want(p, h) for p, _, h in rows)
    merged = warc.capture_history(warc.read_archives(spark, folder)).orderBy("place").collect()
    assert [r["place"] for r in merged] == list(range(len(rows))) and [(r["url_key"].encode(), r["fetched"]) for r in merged] == sorted((r["url_key"].encode(), r["fetched"]) for r in merged)
    assert warc.capture_history(warc.read_archives(spark, warc.write_archives(df.where("false")))).count() == 0


def test_warc_odd_times_and_a_hot_payload(spark, monkeypatch):
    monkeypatch.setattr(warc, "LEAST", 3)
    a, b = "x" * 1500, "y" * 1500
    rows = [(i, f"http://a.org/{i}", a, i * 10**12) for i in range(-9, 9)] + [(2**62, "http://b.org", b, -(10**12)), (100, "http://b.org", b, 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, s long").withColumn("fetched", F.timestamp_seconds("s"))
    got = {r["page_id"]: r for r in warc.capture_history(warc.read_archives(spark, warc.write_archives(df))).collect()}
    assert len(got) == len(rows)
    assert all((r["record_type"], r["refers_to"]) == (("response", None) if p in (8, 2**62) else ("revisit", 8 if p < 50 else 2**62)) for p, r in got.items())
    assert got[1]["fetched"] == warc.LAST and got[-1]["fetched"] == warc.FIRST and got[0]["fetched"] == 0
    # the query's times hold for any id
    from nichespark.llm import queries

    df.select("page_id", "url", "html").write.parquet(path := warc.new_path(spark, "pages") + "/pages.parquet")
    assert queries.op8_warc(spark, path.removesuffix("/pages.parquet")).count() == len(rows)


def test_records_of_any_length_are_one_member():
    import gzip

    big = warc.pack(warc.make_record(1, "http://a", 5, b"z" * (17 << 20), hashlib.sha1(b"z" * (17 << 20)).hexdigest(), None))
    small = warc.pack(warc.make_record(2, "http://b", 5, b"hello", hashlib.sha1(b"hello").hexdigest(), None))
    assert big[-1] == 1 and small[-1] == 0
    data = b"".join(c + b"\0" for c in warc.chunks(iter([small, big, big, small])))
    found = list(warc.records(data))
    assert [h["WARC-Type"] for *_, h, _ in found if h["WARC-Type"] != "warcinfo"] == ["response"] * 4
    # another reader sees the same bytes, and every record begins where the index says
    assert all(gzip.decompress(data[o : o + n]).startswith(b"WARC/1.1") for o, n, *_ in found)


def test_natural_runs():
    entries = [(i, "", str(k), 0, "", 0, "", None, "f", i, 0) for i, k in enumerate([1, 3, 5, 2, 4, 4, 0])]
    assert [len(r) for r in warc.natural_runs(iter(entries))] == [3, 3, 1] and list(warc.natural_runs(iter([]))) == []


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(((i, "", str(rng.randrange(9)), rng.randrange(9), "", 0, "", None, f"f{i}", j, 0) for j in range(rng.randrange(7))), key=warc._place) for i in range(k)]
        assert list(warc.LoserTree(runs)) == sorted((x for r in runs for x in r), key=warc._place)


def test_url_key():
    assert warc.url_key("http://www.Example.com:80/A/b?Q=1#f") == "com,example)/a/b?q=1" and warc.url_key(None) == "" and warc.url_key("https://x.org:81") == "org,x:81)/"


def test_damaged_archives():
    member = warc.pack(warc.make_record(1, "http://a", 5, b"hello", hashlib.sha1(b"hello").hexdigest(), None))
    assert len(list(warc.records(member * 3))) == 3
    with pytest.raises(ValueError):
        list(warc.records(member[:-9]))


@pytest.fixture(scope="module")
def word_bpe():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def test_token_files(spark, odd, none, odd_rows, word_bpe):
    folder = tokenfile.write_token_files(odd)
    got = tokenfile.read_token_files(spark, folder, with_ids=True).orderBy("start").collect()
    ids = {t: word_bpe.encode(t, add_special_tokens=False).ids + [1] for t in {r[1] or "" for r in odd_rows}}
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in odd_rows), key=lambda x: (x is not None, x or 0))
    assert Counter((r["doc_id"], tuple(r["ids"]), r["ids_crc32"]) for r in got) == Counter((d, tuple(ids[t or ""]), zlib.crc32(np.array(ids[t or ""], "<u4").tobytes())) for d, t, *_ in odd_rows)
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1]]
    assert tokenfile.read_token_files(spark, tokenfile.write_token_files(none)).count() == 0


def test_token_files_of_a_few_frames(spark, word_bpe):
    """Files are cut by frames whatever the partition holds, and only the frames of requested documents are read."""
    rows = [(i, prose(i, 40 + i % 50)) for i in range(200)]
    folder = tokenfile.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), frame_ids=300, frames=2)
    files = spark.read.format("binaryFile").load(folder).where("length > 0")
    assert files.count() >= 20
    got = {r["doc_id"]: r for r in tokenfile.read_token_files(spark, folder, with_ids=True).collect()}
    ids = [word_bpe.encode(t, add_special_tokens=False).ids + [1] for _, t in rows]
    assert [got[i]["ids"] for i in range(200)] == ids
    assert [got[i]["start"] for i in range(200)] == [0, *np.cumsum([len(x) for x in ids])[:-1]]
    some = {r["doc_id"]: r for r in tokenfile.read_token_files(spark, folder, with_ids=True, only=[7, 150]).collect()}
    assert some == {i: got[i] for i in (7, 150)}


def test_frames_are_independent():
    w, docs = tokenfile.FileWriter(2), [np.arange(i % 50000, dtype="<u2") for i in (5, 40_000, 0, 41_000, 7, 30_000)]
    parts = [x for i, d in enumerate(docs) if (x := w.add(i if i else None, d.tobytes()))]
    data = b"".join(p + tokenfile.PAD for p in [*parts, *w.end()])
    r = tokenfile.FileReader(data)
    assert len(r.table) == 2 and r.nulls.tolist() == [True] + [False] * 5
    assert all((ids == docs[p]).all() and len(ids) == len(docs[p]) for p, ids in r.documents())
    spoiled = bytearray(data)
    spoiled[10] ^= 255
    late = [p for p, _ in tokenfile.FileReader(bytes(spoiled)).documents([4, 5])]
    assert late == [4, 5]
    with pytest.raises(Exception):
        list(tokenfile.FileReader(bytes(spoiled)).documents([0]))
    with pytest.raises(ValueError):
        tokenfile.FileReader(data[:-1])


def test_word_bpe_shortcut(word_bpe):
    import public_tokenizers as P

    with open(P.path("word_bpe_49k.json"), "rb") as f:
        data = f.read()
    own = tokenfile.Encoder(data, tokenfile.cuts_by_pieces(data))
    rng, letters = random.Random(3), [*"abcXYZ's 'T'RE1234,.!? ßàÉÿ×÷ñ\n\t\x0b\x1c\x85\xa0　İΣςé中😀²½<|endoftext|>", "<|endoftext|>", "é", " ́", "don't", "'S"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    assert own.shortcut and own(texts) == [e.ids for e in word_bpe.encode_batch(texts, add_special_tokens=False)]


def test_token_counts(odd, none, odd_rows):
    import public_tokenizers as P
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = Counter(map(tuple, tokencount.count_tokens(odd).collect()))
    assert got == Counter((d, len((t or "").encode()), len(sp.encode(t or ""))) for d, t, *_ in odd_rows)
    assert tokencount.count_tokens(none).count() == 0
    rng, letters = random.Random(2), list("abcd ab the   \n\t▁▁é中😀 \x00<s></s>")
    for _ in range(3000):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        assert len(sp.encode(t)) == sum(len(x) for x in sp.encode(tokencount.pre_tokens(t))), repr(t)
