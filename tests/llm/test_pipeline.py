"""The pipeline stage by stage, and the SQL of its operators' queries."""

import math
import re
from collections import Counter
from fractions import Fraction

import duckdb
import pytest

import corpus_pipeline
from nichespark.llm import langid, mixing
from nichespark.llm.oracles import ORACLES
from nichespark.llm.queries import queries

from .test_nearcopies import brute_force

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.001"


def quality_by_hand(rows):
    """Ids that the quality stage keeps: measures, sketches and fences in plain Python."""
    found = []
    for d, text, lang, source in rows:
        w = WORD.findall(text or "")
        win = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = len({i + k for i in range(len(w) - 2) for k in range(3) if win[tuple(w[i : i + 3])] > 1})
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        found.append((d, lang, source, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), again))
    alive = [r for r in found if r[3] >= 1 and 2 * r[7] <= r[3]]
    rated = [r for r in alive if r[3] >= 50]
    rates = {"symbol": (5, 16, 75, False), "repeat": (7, 16, 90, False), "lines": (6, 16, 75, False), "length": (4, 10, 75, True)}

    def rate(r, name, more=0):
        return r[4] * 100 // r[3] if name == "length" else (r[rates[name][0]] + more) * 100_000 // r[3]

    def points(group, name):
        bins = sorted((v >> max(v.bit_length() - 7, 0)) << max(v.bit_length() - 7, 0) for v in (rate(r, name, 1) for r in group))
        return [bins[-(-len(bins) * q // 100) - 1] for q in (25, 50, rates[name][2])]

    def fences(lang, source, name):
        own = {s: [r for r in rated if r[1] == lang and r[2] == s] for s in {r[2] for r in rated if r[1] == lang}}
        of_lang = [r for r in rated if r[1] == lang]
        low, mid, top = points(next(g for g in (own[source], of_lang, rated) if len(g) >= 100 or g is rated), name)
        usual = [points(g, name) for g in own.values() if len(g) >= 100]
        up = sorted(p[2] - p[1] for p in usual)[(len(usual) - 1) // 2] if usual else 0
        down = sorted(p[1] - p[0] for p in usual)[(len(usual) - 1) // 2] if usual else 0
        reach = rates[name][1]
        return low - reach * max(mid - low, down), top + reach * max(top - mid, up)

    known = {}
    for r in rated:
        for name in rates:
            if (r[1], r[2], name) not in known:
                known[r[1], r[2], name] = fences(r[1], r[2], name)

    def inside(r):
        return all(rate(r, name) <= known[r[1], r[2], name][1] and (not low or rate(r, name) >= known[r[1], r[2], name][0]) for name, (_, _, _, low) in rates.items())

    return sorted(r[0] for r in alive if r[3] < 50 or inside(r))


def languages_by_hand(rows, model, samples):
    """(id, language) of rows that the language stage keeps: a parse of each text from its beginning to its end."""
    table = langid.class_table(model.symbols)
    automata = [langid.suffix_automaton(langid.classes("\n".join(samples[x]).lower(), table).tolist()) for x in model.languages]
    kept = []
    for d, text in rows:
        c = langid.classes(text or "", table).tolist()
        if not any(ch.isalpha() for ch in text or ""):
            continue
        rates = []
        for moves, n in zip(automata, model.lengths.tolist(), strict=True):
            phrases, state = 0, 0
            for x in c:
                if x in moves[state]:
                    state = moves[state][x]
                    continue
                phrases += state != 0
                state = moves[0].get(x, 0)
                phrases += state == 0
            rates.append((phrases + (state != 0)) * math.log2(n) / len(c))
        best = min(range(len(rates)), key=lambda i: rates[i])
        if (1 / rates[best]) / sum(1 / r for r in rates) >= corpus_pipeline.CLEAR / len(rates):
            kept.append((d, model.languages[best]))
    return sorted(kept)


def mix_by_hand(rows):
    """How often the mixing stage takes each document."""
    size = {d: len(WORD.findall(t or "")) for d, t, _ in rows}
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sorted((size[d], d) for d, _, x in rows if x == s) for s in sources}
    sums = [sum(n for n, _ in own[s]) for s in sources]
    targets = mixing.share_out(sums, [(3, 1, 2)[i % 3] for i in range(len(sources))], Fraction(3 * sum(sums), 2), 2)
    taken, u = Counter(), mixing.offset(11)
    for s, total, target in zip(sources, sums, targets, strict=True):
        rate = round(float(target), 6) / total if total else 0.0
        for i, (_, d) in enumerate(own[s]):
            taken[d] += math.floor((i + 1.0) * rate + u) - math.floor(i * rate + u)
    return +taken


def test_every_stage_is_brute_force(spark, tmp_path, monkeypatch):
    import public_tokenizers as P
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    samples, train = {}, langid.train
    monkeypatch.setattr(langid, "train", lambda s: samples.update(s) or train(s))
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stored = [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, stored[-1], DATA)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(f"file://{tmp_path}/{name}")
        stored.append(spark.read.parquet(f"file://{tmp_path}/{name}"))
    rows = [df.toPandas().astype(object).where(lambda x: x.notna(), None) for df in stored]
    start, quality, language, unique, mixed, encoded = rows
    assert sorted(quality["doc_id"]) == quality_by_hand(list(start[["doc_id", "text", "lang", "source"]].itertuples(index=False)))
    model = train(samples)
    assert sorted(zip(language["doc_id"], language["lang"], strict=True)) == languages_by_hand(list(quality[["doc_id", "text"]].itertuples(index=False)), model, samples)
    assert sorted(unique["doc_id"]) == brute_force(list(language["doc_id"]), list(language["text"]))
    assert Counter(mixed["doc_id"]) == mix_by_hand(list(unique[["doc_id", "text", "source"]].itertuples(index=False)))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_tiktoken_bpe(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = dict(zip(start["doc_id"], start["text"], strict=True))
    assert len(encoded) == len(mixed) and all(list(ids) == library.encode_ordinary(texts[d] or "") and n == len(ids) for d, ids, n in zip(encoded["doc_id"], encoded["ids"], encoded["n_tokens"], strict=True))


def test_names_that_differ_by_case_only_stay(spark, none):
    row = (1, "One two three four five six seven.", "en", "s", 1, "a", "b", "c")
    docs = spark.createDataFrame([row], "doc_id long, text string, lang string, source string, n_chars long, STAGE_ROW string, Mix_Row string, COPIES_row string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, DATA)
        assert got.columns == docs.columns, name
        assert all(tuple(r) == row for r in got.collect()), name


def test_stages_take_odd_rows(spark, odd, none, tmp_path):
    for start, name in ((odd, "odd"), (none, "none")):
        docs = start.select("doc_id", "text", "lang", "source", "n_chars")
        for stage_name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, DATA).write.parquet(f"file://{tmp_path}/{name}/{stage_name}")
            docs = spark.read.parquet(f"file://{tmp_path}/{name}/{stage_name}")
        assert (docs.count() > 0) == (name == "odd")


def plain(df):
    return sorted((tuple(None if x is None or x != x else round(float(x), 6) if not isinstance(x, str) else x for x in r) for r in df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries()[name](spark, DATA).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)
