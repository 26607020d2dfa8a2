"""Every label is learned by the language model: beside copies, and from long documents only."""

import random

import pytest
from pyspark.sql import functions as F

from nichespark.llm import langid

from .conftest import prose


def letters(seed, n, shift):
    """Prose whose letters are moved, as a language of its own."""
    return "".join(chr((ord(c) - 97 + shift) % 26 + 97) if c.isalpha() else c for c in prose(seed, n).lower())


def test_copies_do_not_crowd_out_a_language(spark):
    own = [(letters(i, 120, 7), "xx") for i in range(60)]
    copies = spark.range(20_000).select(F.lit(letters(999, 120, 7)).alias("text"), F.lit("xx").alias("lang"))
    other = [(prose(i, 120), "en") for i in range(200)]
    model = langid.fit(spark.createDataFrame(own + other, "text string, lang string").unionByName(copies))
    assert model.languages == ["en", "xx"]
    lengths = dict(zip(model.languages, model.lengths.tolist(), strict=True))
    assert lengths["xx"] >= 0.9 * sum(len(t) for t, _ in own)


def test_labels_only_on_long_documents_are_learned(spark):
    rows = [(letters(i, 2_000, 7), "xx") for i in range(4)] + [(letters(9, 40_000, 13), "yy")] + [(prose(i, 120), "en") for i in range(100)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ["en", "xx", "yy"]
    assert (model.lengths <= 2 * langid.SAMPLE_CHARS).all()
    got = langid.predict(spark.createDataFrame([(letters(77, 80, k), x) for k, x in ((0, "en"), (7, "xx"), (13, "yy"))], "text string, want string"), model).collect()
    assert all(r["lang_pred"] == r["want"] for r in got)


def naive(text, sample):
    """Phrases of a greedy parse: the longest piece of the sample each, or one letter that it has not."""
    n, at = 0, 0
    while at < len(text):
        end = at
        while end < len(text) and text[at : end + 1] in sample:
            end += 1
        at, n = max(end, at + 1), n + 1
    return n


@pytest.mark.parametrize("piece, remembered", [(7, 1 << 10), (64, 1 << 22), (1024, 1 << 22)])
def test_phrases_cross_the_borders_of_pieces(monkeypatch, piece, remembered):
    monkeypatch.setattr(langid, "PIECE", piece)
    monkeypatch.setattr(langid, "REMEMBERED", remembered)
    rng = random.Random(piece)
    samples = {"x": "abracadabra banana cadabra " * 3 + "".join(rng.choice("abc ") for _ in range(300)), "y": "".join(rng.choice("abcdn ") for _ in range(400)), "z": "ab" * 200}
    samples = {k: " ".join(v.split()) for k, v in samples.items()}
    model = langid.train({k: [v] for k, v in samples.items()})
    texts = [" ".join("".join(rng.choice("abrcdnq ") for _ in range(rng.randrange(1, 3000))).split()) for _ in range(60)]
    texts += ["ab" * 1500, samples["x"] * 5, samples["y"], "ab" * 700 + "q" + "ba" * 700, "a", "q"]
    texts = [t for t in texts if t]
    got, chars = langid.Parser(model).phrases(texts)
    assert chars.tolist() == [len(t) for t in texts]
    assert got.tolist() == [[naive(t, samples[k]) for k in "xyz"] for t in texts]


def test_packed_rows_hold_every_step():
    rng = random.Random(2)
    moves = langid.suffix_automaton([rng.randrange(2, 400) for _ in range(3000)] + [rng.randrange(2, 6) for _ in range(3000)])
    base, check, target = langid.pack(moves, 400)
    for s, m in enumerate(moves):
        for c in range(400):
            place = base[s] + c
            assert (check[place] == s) == (c in m) and (c not in m or target[place] == m[c])


def test_large_alphabets_are_told_apart(spark):
    """Two languages with thousands of letters each, the same lengths of words, and a third in another script."""
    rng = random.Random(4)
    words = {x: ["".join(chr(lo + rng.randrange(n)) for _ in range(2)) for _ in range(3000)] for x, lo, n in (("a", 0x4E00, 3000), ("b", 0x5A00, 3000), ("c", 0x0430, 32))}

    def text(x, n):
        return " ".join(rng.choice(words[x]) for _ in range(n))

    model = langid.fit(spark.createDataFrame([(text(x, 150), x) for x in "abc" for _ in range(80)], "text string, lang string"))
    assert len(model.symbols) > 5000
    got = langid.predict(spark.createDataFrame([(text(x, 60), x) for x in "abc" for _ in range(20)], "text string, want string"), model).collect()
    assert all(r["lang_pred"] == r["want"] for r in got)


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    got = langid.predict(docs.where(held_out), langid.fit(docs.where(~held_out))).where("lang is not null").select("lang", "lang_pred").toPandas()
    assert len(got) > 150 and (got["lang"] == got["lang_pred"]).mean() >= 0.97
