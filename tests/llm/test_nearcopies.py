"""The near-duplicate stage against brute force over all pairs."""

import random

import corpus_pipeline
import numpy as np
from nichespark.llm import nearcopies
from nichespark.llm.nearcopies import drop_near_copies
from nichespark.llm.simhash import fingerprint

from .conftest import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sets_of(texts):
    words = [t.lower().split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]


def brute_force(ids, texts):
    """The smallest id of each component of pairs with a similarity of 0.8 or more."""
    sets, root = sets_of(texts), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j])) and (a := find(i)) != (b := find(j)):
                both = len(sets[i] & sets[j])
                if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                    root[a] = b
    groups = {}
    for i, x in enumerate(ids):
        groups.setdefault(find(i), []).append(x)
    return sorted(min(g) for g in groups.values())


def changed(text, n, seed):
    """text with n words replaced, far apart: each changes five shingles."""
    words, rng = text.split(), random.Random(seed)
    for k in range(n):
        words[10 + k * (len(words) - 20) // n] = f"changed{rng.randrange(10**6)}"
    return " ".join(words)


def test_stage_drops_copies_from_similarity_08(spark):
    base = prose(1, 300)
    near = next(t for s in range(99) if (fingerprint(base) ^ fingerprint(t := changed(base, 6, s))).bit_count() > 4)
    far = changed(base, 14, 5)  # 70 of 296 shingles differ: similarity 0.62
    docs = spark.createDataFrame([(3, base, "en", "s", 1), (7, near, "en", "s", 1), (1, far, "en", "s", 1)], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3]


def test_stage_is_brute_force(spark):
    texts = [prose(s, 60 + 7 * (s % 9)) for s in range(12)]
    texts += [changed(texts[s % 12], 1 + s % 5, s) for s in range(80)] + [prose(99, 120)] * 5
    texts += [changed(prose(99, 120), 3, s) for s in range(60)]
    ids = random.Random(4).sample(range(1000), len(texts))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)
    assert sorted(r.doc_id for r in drop_near_copies(docs).collect()) == brute_force(ids, texts)


def test_a_crowd_is_brute_force(spark):
    """A text and many changed copies of it, some too far from it, but near others: pairs of crowds are found in the second pass."""
    base = prose(5, 200)
    texts = [base] + [changed(base, 1 + s % 9, s) for s in range(60)]
    chain = base
    for s in range(40):
        chain = changed(chain, 4, 100 + s)
        texts.append(chain)
    ids = random.Random(5).sample(range(1000), len(texts))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)
    assert sorted(r.doc_id for r in drop_near_copies(docs).collect()) == brute_force(ids, texts)


def test_pairs_of_both_passes_are_all_that_collide():
    texts = [prose(s, 150) for s in range(6)]
    texts += [changed(texts[s % 6], 1 + s % 7, s) for s in range(150)]
    sets = [nearcopies.shingles(t) for t in texts]
    prints = np.array([nearcopies.simhashes(s) for s in sets])
    whole = np.zeros(len(texts), nearcopies.WHOLE)
    whole["node"], whole["n"], whole["prints"], whole["label"] = np.arange(len(texts)), [len(s) for s in sets], prints, np.arange(len(texts)) // 3
    near = np.bitwise_count(prints[:, None, :48] ^ prints[None, :, :48]) <= 2
    apart = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2, dtype=int)
    fit = np.array([[10 * min(len(a), len(b)) >= 8 * max(len(a), len(b)) for a in sets] for b in sets])
    want = {(a, b) for a, b in zip(*np.nonzero(near.any(axis=2) & (apart <= nearcopies.FAR_OF_ALL) & fit), strict=True) if a < b and a // 3 != b // 3}
    for groups in (0, 3):
        found = []
        for t in range(48):
            for bucket in range(1 << groups):
                ball = nearcopies.Ball(32, 1, groups)
                v = prints[:, t].astype(np.uint64)
                at, place = ball.addresses(v)
                mine = np.sort(place[at == bucket])
                if len(mine):
                    a, b = nearcopies.second_pairs(whole[mine], ball, t, bucket, 80)
                    found += zip(mine[a].tolist(), mine[b].tolist(), strict=True)
        assert set(found) == want and (groups or len(found) == len(want))


def test_odd_rows(odd, none):
    kept = drop_near_copies(odd)
    assert kept.columns == odd.columns and drop_near_copies(none).count() == 0
    # null, empty and blank texts are one group; repeated rows leave one
    assert kept.where("trim(coalesce(text, '')) = ''").count() == 1
    assert kept.count() == kept.select("text").distinct().count() < odd.count()
