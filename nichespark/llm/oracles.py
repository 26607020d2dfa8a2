"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from nichespark.llm.mixing import offset
from nichespark.llm.quality import LOW, MID, MIN_DOCS, RULES

W = r"[^\x20\x09-\x0D]+"

#: CRC-32 by bytes: the table is made from the polynomial, eight halvings for each byte value.
CRC = """RECURSIVE halves(b, c, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL
  SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM halves WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) t FROM halves WHERE k = 8),
texts AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, coalesce(text, '') s FROM documents),
distinct_texts AS (SELECT DISTINCT s FROM texts),
pieces AS (SELECT s, list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda h: ('0x' || h)::BIGINT)) b FROM distinct_texts),
crcs AS (SELECT s, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) crc FROM pieces, tab)"""

#: Shards by offset in the order of (crc, id); groups of equal crc move as one if small.
OP1 = f"""WITH {CRC},
r AS (SELECT doc_id, size, crc, sum(size) OVER (ORDER BY crc, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS ahead,
  sum(size) OVER () total, sum(size) OVER (PARTITION BY crc) grp FROM texts JOIN crcs USING (s)),
p AS (SELECT *, CASE WHEN grp <= 0.02e0 * total / 24 THEN min(ahead) OVER (PARTITION BY crc) ELSE ahead END st FROM r),
s AS (SELECT *, least(st * 24 // total, 23) shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) size, crc text_crc32, 'bytes' law, CAST(shard AS INTEGER) shard,
  row_number() OVER (PARTITION BY shard ORDER BY crc, doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INTEGER) grown_shard FROM s"""

OP3 = rf"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{W}')), 0) size FROM documents),
src AS (SELECT source, sum(size) s, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END) w FROM d GROUP BY source),
o AS (SELECT *, 2e0 * s / w ratio, sum(s) OVER () * 1.5e0 total FROM src),
f AS (SELECT *, (total - coalesce(sum(2e0 * s) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) unit FROM o),
g AS (SELECT *, unit > ratio AS capped FROM f),
t AS (SELECT source, s, round(CASE WHEN capped THEN 2e0 * s ELSE w * (total - coalesce(sum(CASE WHEN capped THEN 2e0 * s END) OVER (), 0)) / sum(CASE WHEN NOT capped THEN w END) OVER () END, 6) target FROM g),
r AS (SELECT doc_id, size, s, target, CASE WHEN s > 0 THEN target / s ELSE 0 END rate, row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS FIRST) - 1e0 AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) size, CAST(s AS BIGINT) source_size, target,
  CAST((floor((place + 1e0) * rate + {offset(11)!r}) - floor(place * rate + {offset(11)!r})) * size AS BIGINT) taken FROM r"""


def _bin(v: str) -> str:
    return f"(({v} >> greatest(length(bin({v})) - 7, 0)) << greatest(length(bin({v})) - 7, 0))"


def _op4() -> str:
    rates = {k: r.rate.replace(" div n_words", " // nullif(n_words, 0)") for k, r in RULES.items()}
    smooth = {k: r.smooth.replace(" div ", " // ") for k, r in RULES.items()}
    long = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS rule, {_bin('CAST(' + v + ' AS BIGINT)')} bin FROM m WHERE NOT base_failed" for k, v in smooth.items())
    top = "CASE rule " + " ".join(f"WHEN '{k}' THEN {r.top}" for k, r in RULES.items()) + " END"

    def level(name: str, keys: str) -> str:
        by = f"{keys}, rule" if keys else "rule"
        points = ", ".join(f"min(CASE WHEN upto * 100 >= docs * {q} THEN bin END) {k}" for k, q in (("low", LOW), ("mid", MID), ("top", top)))
        return f"""{name}_c AS (SELECT {by}, bin, count(*) n FROM sk GROUP BY ALL),
{name}_r AS (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY bin) upto, sum(n) OVER (PARTITION BY {by}) docs FROM {name}_c),
{name} AS (SELECT {by}, max(docs) docs, {points} FROM {name}_r GROUP BY {by})"""

    def pick(k: str) -> str:
        return f"CASE WHEN f.docs >= {MIN_DOCS} THEN f.{k} WHEN g.docs >= {MIN_DOCS} THEN g.{k} ELSE h.{k} END {k}"

    tests = []
    for k, r in RULES.items():
        ok = [f"m.{k} <= top + {r.reach} * greatest(top - mid, coalesce(up, 0))"] + ([f"m.{k} >= low - {r.reach} * greatest(mid - low, coalesce(down, 0))"] if r.low else [])
        tests.append(f"WHEN '{k}' THEN {' AND '.join(ok)}")
    return rf"""WITH b AS (SELECT row_number() OVER () id, doc_id, lang, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{W}') w FROM documents),
win AS (SELECT id, i, concat_ws(' ', w[i], w[i+1], w[i+2]) x FROM (SELECT id, w, unnest(range(1, len(w) - 1)) i FROM b)),
twice AS (SELECT id, x FROM win GROUP BY ALL HAVING count(*) > 1),
cov AS (SELECT id, count(DISTINCT p) n FROM (SELECT id, unnest([i, i+1, i+2]) p FROM win JOIN twice USING (id, x)) GROUP BY id),
lines AS (SELECT id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{W}')) l FROM b),
m0 AS (SELECT id, doc_id, lang, source, len(w) n_words, length(array_to_string(w, '')) word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) n_symbols,
  len(l) - len(list_distinct(l)) n_dup_lines, coalesce(cov.n, 0) n_repeat_words FROM b JOIN lines USING (id) LEFT JOIN cov USING (id)),
m1 AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m0),
m AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in rates.items())} FROM m1),
sk AS ({long}),
{level('fine', 'lang, source')}, {level('mid_l', 'lang')}, {level('all_l', '')},
usual AS (SELECT lang, rule, quantile_disc(top - mid, 0.5) up, quantile_disc(mid - low, 0.5) down FROM fine WHERE docs >= {MIN_DOCS} GROUP BY ALL),
q AS (SELECT f.lang, f.source, f.rule, {pick('low')}, {pick('mid')}, {pick('top')}, u.up, u.down
  FROM fine f JOIN mid_l g ON f.lang IS NOT DISTINCT FROM g.lang AND f.rule = g.rule JOIN all_l h ON h.rule = f.rule LEFT JOIN usual u ON f.lang IS NOT DISTINCT FROM u.lang AND f.rule = u.rule),
ok AS (SELECT m.id, bool_and(CASE q.rule {' '.join(tests)} END) inside FROM m JOIN q ON m.lang IS NOT DISTINCT FROM q.lang AND m.source IS NOT DISTINCT FROM q.source GROUP BY m.id)
SELECT doc_id, CAST(n_words AS BIGINT) n_words, CAST(word_chars AS BIGINT) word_chars, CAST(n_symbols AS BIGINT) n_symbols, CAST(n_dup_lines AS BIGINT) n_dup_lines,
  CAST(n_repeat_words AS BIGINT) n_repeat_words, base_failed, NOT base_failed AND coalesce(inside, false) AS kept FROM m LEFT JOIN ok USING (id)"""


OP6 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM s)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 10"""

#: URL keys as the pages' URLs need them: no ports, users or other schemes.
OP8 = r"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) n, sha1(coalesce(html, '')) d, regexp_replace(lower(coalesce(url, '')), '^https?://(www[0-9]*[.])?', '') u FROM pages),
k AS (SELECT *, CASE WHEN u = '' THEN '' ELSE array_to_string(list_reverse(string_split(regexp_extract(u, '^[^/?#]*'), '.')), ',') || ')' || regexp_replace(regexp_replace(regexp_replace(u, '^[^/?#]*', ''), '#.*$', ''), '^($|[?])', '/\1') END url_key FROM p),
c AS (SELECT d, n, max(page_id) m FROM p WHERE n >= 1000 GROUP BY ALL HAVING count(*) > 1)
SELECT page_id, CAST(k.n AS BIGINT) payload_bytes, k.d payload_digest, CASE WHEN m IS NOT NULL AND page_id IS DISTINCT FROM m THEN 'revisit' ELSE 'response' END record_type,
  CASE WHEN m IS NOT NULL AND page_id IS DISTINCT FROM m THEN m END refers_to, url_key,
  row_number() OVER (ORDER BY url_key, coalesce(page_id, 0) % 1000000000, page_id NULLS FIRST) - 1 AS place FROM k LEFT JOIN c ON k.d = c.d AND k.n = c.n"""

ORACLES: dict[str, str] = {"op1_sharding": OP1, "op3_mixing": OP3, "op4_quality": _op4(), "op6_topk": OP6, "op8_warc": OP8}
