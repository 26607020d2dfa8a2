"""DuckDB SQL for the queries, written from the definitions and sharing nothing with the plans."""

from __future__ import annotations

from nichespark.plans.queries import EM_MEANS, EM_STEPS, NHOOD, RINGS, nhood_name

CUST = """cells AS (SELECT c_custkey cell_id, c_mktsegment cluster, CAST(c_nationkey AS VARCHAR) sample,
  CAST(c_nationkey % 2 AS VARCHAR) condition, c_acctbal AS value, c_custkey % 40 gx, c_custkey // 40 gy FROM customer)"""
ORD = """cells AS (SELECT o_orderkey cell_id, o_orderpriority cluster, o_orderstatus condition, o_totalprice AS value,
  o_orderkey % 400 gx, o_orderkey // 400 gy FROM orders)"""
EVT = "cells AS (SELECT event_id cell_id, event_type cluster, CAST(user_id % 10 AS VARCHAR) grp, ts FROM events)"
EMB = """cells AS (SELECT vec_id cell_id, CAST(label AS VARCHAR) cluster, CAST(vec_id % 4 AS VARCHAR) sample,
  CAST(embedding[1] AS DOUBLE) x, CAST(embedding[2] AS DOUBLE) y, CAST(embedding AS DOUBLE[]) f FROM embeddings)"""
STEPS = "(VALUES (1,0),(-1,0),(0,1),(0,-1)) o(dx,dy)"
EDGES = f"edges AS (SELECT a.cell_id src, b.cell_id dst FROM cells a CROSS JOIN {STEPS} JOIN cells b ON b.gx = a.gx + o.dx AND b.gy = a.gy + o.dy)"


def knn(k: int) -> str:
    return f"""dists AS (SELECT a.cell_id src, b.cell_id dst, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) dist
  FROM cells a JOIN cells b ON a.cell_id <> b.cell_id),
nearest AS (SELECT src, dst, dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) r FROM dists) WHERE r <= {k}),
edges AS (SELECT src, dst, dist FROM nearest UNION SELECT dst, src, dist FROM nearest)"""


RINGS3 = """r1 AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst),
r2 AS (SELECT DISTINCT a.src, b.dst FROM r1 a JOIN r1 b ON a.dst = b.src WHERE a.src <> b.dst
  AND NOT EXISTS (SELECT 1 FROM r1 v WHERE v.src = a.src AND v.dst = b.dst)),
r3 AS (SELECT DISTINCT a.src, b.dst FROM r2 a JOIN r1 b ON a.dst = b.src WHERE a.src <> b.dst
  AND NOT EXISTS (SELECT 1 FROM r1 v WHERE v.src = a.src AND v.dst = b.dst)
  AND NOT EXISTS (SELECT 1 FROM r2 v WHERE v.src = a.src AND v.dst = b.dst))"""


def aggregated(parts: list[str], extra: str = "") -> str:
    """parts: 'own' or 'mean:r1'; positions follow the list."""
    rows = []
    for i, p in enumerate(parts):
        if p == "own":
            rows.append(f"SELECT cell_id, {i} AS pos, value AS v FROM cells")
        else:
            how, ring = p.split(":")
            f = {"mean": "avg", "var": "var_pop"}[how]
            rows.append(f"SELECT c.cell_id, {i} AS pos, coalesce(x.v, 0e0) AS v FROM cells c LEFT JOIN (SELECT r.src, {f}(n.value) v FROM {ring} r JOIN cells n ON n.cell_id = r.dst GROUP BY r.src) x ON x.src = c.cell_id")
    return f"WITH {CUST}, {EDGES}, {extra or RINGS3} SELECT cell_id, CAST(pos AS INTEGER) pos, round(v + 1.234567e-7, 3) AS value FROM ({' UNION ALL '.join(rows)})"


BY_SAMPLE = """r1 AS (SELECT DISTINCT e.src, e.dst FROM edges e JOIN cells a ON a.cell_id = e.src JOIN cells b ON b.cell_id = e.dst
  WHERE a.sample = b.sample)"""


def enrich(by: list[str], log: bool, inter: bool, sym: bool) -> str:
    """CTE `res` of raw, observed, expected, enrichment from links(by, ls, ld, w), sizes(by, cluster, n)."""
    b = "".join(f"{x}, " for x in by)
    on = lambda a, c: "".join(f"{a}.{x} = {c}.{x} AND " for x in by)
    grid = f"SELECT {b}s, t, nn, ww FROM tot CROSS JOIN dom CROSS JOIN (SELECT s AS t FROM dom) d2"
    if sym:
        obs, exp = "coalesce(l.w, 0e0)", "(coalesce(a.n,0) * 1e0 * coalesce(c.n,0) * (coalesce(g.ww,0e0)/g.nn) / g.nn) / (CASE WHEN g.s = g.t THEN 2e0 ELSE 1e0 END)"
    else:
        obs, exp = "coalesce(l.w, 0e0) / nullif(r.w, 0)", "CASE WHEN g.ww > 0 THEN coalesce(c.n,0) * 1e0 / g.nn END"
    value = "CASE WHEN raw / nullif(ex, 0) > 0 THEN log2(raw / nullif(ex, 0)) END" if log else "raw - ex"
    keep = "s <> t" if inter else "true"
    using = f"USING ({', '.join(by)})" if by else ""
    return f"""tot AS (SELECT {b}nn, ww FROM (SELECT {b}sum(n) nn FROM sizes {'GROUP BY ' + ', '.join(by) if by else ''}) {'LEFT JOIN' if by else 'CROSS JOIN'} (SELECT {b}sum(w) ww FROM links {'GROUP BY ' + ', '.join(by) if by else ''}) {using}),
grid AS ({grid}),
rowsum AS (SELECT {b}ls, sum(w) w FROM links GROUP BY {b}ls),
res0 AS (SELECT {''.join(f'g.{x}, ' for x in by)}g.s, g.t, {obs} raw, {exp} ex FROM grid g
  LEFT JOIN (SELECT * FROM sizes WHERE cluster IS NOT NULL) a ON {on('a', 'g')}a.cluster = g.s LEFT JOIN (SELECT * FROM sizes WHERE cluster IS NOT NULL) c ON {on('c', 'g')}c.cluster = g.t
  LEFT JOIN links l ON {on('l', 'g')}l.ls = g.s AND l.ld = g.t LEFT JOIN rowsum r ON {on('r', 'g')}r.ls = g.s),
res AS (SELECT {b}s, t, raw, CASE WHEN {keep} THEN raw END observed, CASE WHEN {keep} THEN ex END expected, CASE WHEN {keep} THEN {value} END enrichment FROM res0)"""


def links(inter: bool, by: str = "", where: str = "true") -> str:
    b = f"{by}, " if by else ""
    return f"""links AS (SELECT {b}a.cluster ls, b.cluster ld, count(*) * 1e0 w FROM edges e JOIN cells a ON a.cell_id = e.src JOIN cells b ON b.cell_id = e.dst
  WHERE {where} {'AND a.cluster IS DISTINCT FROM b.cluster' if inter else ''} GROUP BY ALL),
dom AS (SELECT DISTINCT cluster s FROM cells WHERE cluster IS NOT NULL)"""


SIZES = "sizes AS (SELECT cluster, count(*) n FROM cells GROUP BY 1)"


def nhood(sym: bool, inter: bool, log: bool, cells: str = CUST, digits: int = 4) -> str:
    return f"WITH {cells}, {EDGES}, {links(inter)}, {SIZES}, {enrich([], log, inter, sym)} SELECT s AS source, t AS target, round(observed, 6) observed, round(expected, 6) expected, round(enrichment, {digits}) enrichment FROM res"


W64 = "18446744073709551616::UHUGEINT"


def mixed(name: str, source: str, x: str, keep: str) -> str:
    """CTEs that end in `name`: the rows of source with u, a splitmix64 finalizer of x (a number below 2**64)."""
    wide = lambda z, by, m: f"((xor({z}, {z} >> {by})::UHUGEINT * {m}::UHUGEINT) % {W64})::UBIGINT"
    return f"""{name}_0 AS (SELECT *, (({x}) % {W64})::UBIGINT z0 FROM {source}),
{name}_1 AS (SELECT *, {wide('z0', 30, 13787848793156543929)} z1 FROM {name}_0), {name}_2 AS (SELECT *, {wide('z1', 27, 10723151780598845931)} z2 FROM {name}_1),
{name} AS (SELECT {keep}, xor(z2, z2 >> 31) u FROM {name}_2)"""


def shuffled(key: str, n: int = 20) -> str:
    """CTE `dealt`: in the order of u the first cells get the first value, as many as it has, and so on."""
    return f"""{mixed('keyed', f'range({n}) p(perm)', f'(perm + 1 + 1000003)::UHUGEINT * 11400714819323198485::UHUGEINT', 'perm')},
{mixed('spots', 'cells CROSS JOIN keyed', 'cell_id::UHUGEINT + u::UHUGEINT', f'perm, cell_id, {key} v')},
pa AS (SELECT perm, cell_id, row_number() OVER (PARTITION BY perm ORDER BY u) r FROM spots),
pb AS (SELECT {key} v, row_number() OVER (ORDER BY {key} NULLS LAST) r FROM cells),
dealt AS (SELECT pa.perm, pa.cell_id, pb.v FROM pa JOIN pb USING (r))"""


def nhood_perm(n: int) -> str:
    return f"""WITH {CUST}, {EDGES}, {links(True)}, {SIZES}, {enrich([], False, True, False)}, {shuffled('cluster', n)},
used AS (SELECT e.* FROM edges e JOIN cells a ON a.cell_id = e.src JOIN cells b ON b.cell_id = e.dst WHERE a.cluster IS DISTINCT FROM b.cluster),
pw AS (SELECT a.perm, a.v ls, b.v ld, count(*) * 1e0 w FROM used e JOIN dealt a ON a.cell_id = e.src JOIN dealt b ON b.cell_id = e.dst AND b.perm = a.perm GROUP BY ALL),
po AS (SELECT perm, ls s, ld t, w / sum(w) OVER (PARTITION BY perm, ls) po FROM pw),
full_po AS (SELECT r.s, r.t, r.raw, p.perm, coalesce(po.po, 0e0) po FROM res r CROSS JOIN range({n}) p(perm) LEFT JOIN po ON po.s = r.s AND po.t = r.t AND po.perm = p.perm),
pv AS (SELECT s, t, avg(po) pe, CASE WHEN any_value(raw) IS NULL OR any_value(raw) = 0 THEN 1e0 ELSE 1 - sum(CASE WHEN po < raw THEN 1 ELSE 0 END) / {n}e0 END pvalue FROM full_po GROUP BY s, t),
out AS (SELECT s AS source, t AS target, observed, CASE WHEN s <> t THEN pe END expected, CASE WHEN s <> t THEN raw - pe END enrichment, pvalue FROM res JOIN pv USING (s, t))"""


def enrichment_perm(n: int, log: bool, digits: int = 4) -> str:
    change = "any_value(o) / avg(po)"
    change = f"CASE WHEN any_value(o) > 0 THEN log2({change}) END" if log else change
    return f"""WITH {CUST}, {shuffled('condition', n)}, cnt AS (SELECT condition g, cluster l, count(*) * 1e0 n FROM cells GROUP BY ALL),
ob AS (SELECT g, l, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY l) o FROM (SELECT DISTINCT g FROM cnt) a CROSS JOIN (SELECT DISTINCT l FROM cnt) b LEFT JOIN cnt USING (g, l)),
pc AS (SELECT perm, v g, cluster l, count(*) * 1e0 n FROM dealt JOIN cells USING (cell_id) GROUP BY ALL),
po AS (SELECT perm, g, l, n / sum(n) OVER (PARTITION BY perm, l) po FROM pc),
al AS (SELECT g, l, o, coalesce(po, 0e0) po FROM ob CROSS JOIN range({n}) p(perm) LEFT JOIN po USING (perm, g, l))
SELECT g AS "group", l AS label, round(any_value(o), 6) observed, round(avg(po), 6) expected, round(CASE WHEN any_value(o) > 0 THEN 1 - sum(CASE WHEN po < o THEN 1 ELSE 0 END) / {n}e0 ELSE 0 END, 6) pvalue, round({change}, {digits}) enrichment FROM al GROUP BY g, l"""


DIFF_RES = f"{links(True, 'a.condition AS cond', 'a.condition = b.condition')}, sizes AS (SELECT condition cond, cluster, count(*) n FROM cells WHERE condition IS NOT NULL GROUP BY ALL), {enrich(['cond'], False, True, False)}"
DIFF = "diff AS (SELECT a.cond condition1, b.cond condition2, a.s, a.t, a.enrichment - b.enrichment d FROM res a JOIN res b ON a.s = b.s AND a.t = b.t AND a.cond < b.cond)"

DIFF_PERM = f"""WITH {CUST}, {EDGES}, {DIFF_RES}, {DIFF},
libs AS (SELECT DISTINCT sample lib, condition c FROM cells),
dealt AS (SELECT perm, lib, CASE WHEN row_number() OVER (PARTITION BY perm ORDER BY md5('1|' || perm || '|' || lib), lib) <= (SELECT count(*) FROM libs WHERE c = '0') THEN 1 ELSE 2 END side FROM libs CROSS JOIN range(1000) p(perm)),
lw AS (SELECT a.sample la, b.sample lb, a.cluster ls, b.cluster ld, count(*) * 1e0 w FROM edges e JOIN cells a ON a.cell_id = e.src JOIN cells b ON b.cell_id = e.dst WHERE a.cluster <> b.cluster GROUP BY ALL),
plinks AS (SELECT x.perm, x.side, ls, ld, sum(w) w FROM lw JOIN dealt x ON x.lib = la JOIN dealt y ON y.lib = lb AND y.perm = x.perm AND y.side = x.side GROUP BY ALL),
psizes AS (SELECT perm, side, cluster, count(*) n FROM dealt JOIN cells ON sample = lib GROUP BY ALL),
ptot AS (SELECT perm, side, sum(n) nn FROM psizes GROUP BY ALL),
pany AS (SELECT perm, side, sum(w) ww FROM plinks GROUP BY ALL),
prow AS (SELECT perm, side, ls, sum(w) w FROM plinks GROUP BY ALL),
pe AS (SELECT p.perm, p.side, d1.s, d2.s AS t, CASE WHEN d1.s <> d2.s THEN coalesce(l.w, 0e0) / nullif(r.w, 0) - CASE WHEN y.ww > 0 THEN coalesce(c.n, 0) * 1e0 / p.nn END END e
  FROM ptot p CROSS JOIN dom d1 CROSS JOIN dom d2 LEFT JOIN pany y USING (perm, side) LEFT JOIN plinks l ON l.perm = p.perm AND l.side = p.side AND l.ls = d1.s AND l.ld = d2.s
  LEFT JOIN prow r ON r.perm = p.perm AND r.side = p.side AND r.ls = d1.s LEFT JOIN psizes c ON c.perm = p.perm AND c.side = p.side AND c.cluster = d2.s),
pd AS (SELECT a.perm, a.s, a.t, a.e - b.e po FROM pe a JOIN pe b ON a.perm = b.perm AND a.s = b.s AND a.t = b.t AND a.side = 1 AND b.side = 2)
SELECT condition1, condition2, s AS source, t AS target, round(any_value(d), 6) enrichment,
  CASE WHEN any_value(d) IS NULL OR any_value(d) = 0 THEN 1e0 ELSE round(1 - count(CASE WHEN any_d > 0 AND po < any_d THEN 1 WHEN any_d < 0 AND po > any_d THEN 1 END) / 1000e0, 6) END pvalue
FROM (SELECT diff.*, d AS any_d, po FROM diff LEFT JOIN pd ON pd.s = diff.s AND pd.t = diff.t) GROUP BY condition1, condition2, s, t"""


def comps(edge_where: str, cluster: str, min_cells: int) -> str:
    """CTEs up to named(cell_id, component)."""
    return f"""{CUST}, {EDGES}, own AS (SELECT cell_id, {cluster} cl, sample FROM cells),
used AS (SELECT e.src, e.dst FROM edges e JOIN own a ON a.cell_id = e.src JOIN own b ON b.cell_id = e.dst WHERE {edge_where}),
reach(node, root) AS (SELECT cell_id, cell_id FROM own UNION SELECT u.dst, r.root FROM reach r JOIN used u ON u.src = r.node),
roots AS (SELECT node, min(root) root FROM reach GROUP BY node),
big AS (SELECT root, any_value(cl) cl FROM roots JOIN own ON cell_id = node GROUP BY root HAVING count(*) >= {min_cells}),
firsts AS (SELECT cl, min(cell_id) f FROM own GROUP BY cl),
ids AS (SELECT root, CAST(row_number() OVER (ORDER BY f, root) - 1 AS VARCHAR) component FROM big JOIN firsts USING (cl)),
named AS (SELECT c.cell_id, i.component FROM cells c LEFT JOIN roots r ON r.node = c.cell_id LEFT JOIN ids i USING (root))"""


def rcs(library: bool) -> str:
    key = "neighborhood, library" if library else "neighborhood"
    return f"""WITH RECURSIVE {comps('a.cl = b.cl', 'cluster', 3)},
base AS (SELECT component, cluster neighborhood, condition library FROM cells JOIN named USING (cell_id)),
per AS (SELECT {key}, count(*) cells, count(DISTINCT component) comps FROM base GROUP BY {key}),
size AS (SELECT component, count(*) n FROM base WHERE component IS NOT NULL GROUP BY 1)
SELECT component, {key}, round(n / (cells * 1e0 / comps), 6) AS value FROM (SELECT DISTINCT component, {key} FROM base WHERE component IS NOT NULL) JOIN size USING (component) JOIN per USING ({key})"""


RUNS = """runs AS (SELECT run, k, vec_id cell_id, CAST(((vec_id // 16) * (2 * run + 1) + label) % k AS INTEGER) l FROM embeddings CROSS JOIN range(4) r(run) CROSS JOIN range(2, 7) kk(k)),
tab AS (SELECT a.k, a.run run_a, b.run run_b, a.l l1, b.l l2, count(*) * 1e0 n FROM runs a JOIN runs b ON a.cell_id = b.cell_id AND b.k = a.k + 1 AND b.run < a.run GROUP BY ALL)"""


def sums(tab: str) -> str:
    return f"""sums AS (SELECT k, run_a, run_b, sum(n*n) nij, sum(n) nn, any_value(a2) a2, any_value(b2) b2 FROM {tab}
  JOIN (SELECT k, run_a, run_b, sum(m*m) a2 FROM (SELECT k, run_a, run_b, l1, sum(n) m FROM {tab} GROUP BY ALL) GROUP BY ALL) USING (k, run_a, run_b)
  JOIN (SELECT k, run_a, run_b, sum(m*m) b2 FROM (SELECT k, run_a, run_b, l2, sum(n) m FROM {tab} GROUP BY ALL) GROUP BY ALL) USING (k, run_a, run_b) GROUP BY k, run_a, run_b)"""


FMI = "fmi AS (SELECT k, run_a, run_b, CASE WHEN nij <> nn THEN sqrt((nij-nn)/nullif(a2-nn,0)) * sqrt((nij-nn)/nullif(b2-nn,0)) ELSE 0 END v FROM sums)"
MIRROR = f"{RUNS}, {sums('tab')}, {FMI}, mir AS (SELECT * FROM (SELECT k, 0 part, run_a, run_b, v FROM fmi UNION ALL SELECT k + 1, 1, run_a, run_b, v FROM fmi) WHERE k > (SELECT min(k) FROM fmi) AND k <= (SELECT max(k) FROM fmi))"
PEAKS = MIRROR.replace("range(2, 7)", "range(2, 9)").replace("CAST(((vec_id", "CAST(CASE WHEN k BETWEEN 4 AND 6 THEN label % 2 ELSE ((vec_id").replace("% k AS INTEGER) l", "% k END AS INTEGER) l")
MEANS = "means AS (SELECT k, round(avg(v), 6) stability FROM mir GROUP BY k)"


def density(name: str, model: str) -> str:
    """CTEs that end in `name`: cell_id, x, y, k, lp (log of weight times density), lse, r (responsibility) under rows k, w, mx, my, cxx, cxy, cyy."""
    return f"""{name}_p AS (SELECT cell_id, x, y, k, ln(w) - ln(2 * pi()) - ln(cxx * cyy - cxy * cxy) / 2 - ((x - mx) * (x - mx) * cyy - 2 * (x - mx) * (y - my) * cxy + (y - my) * (y - my) * cxx) / (cxx * cyy - cxy * cxy) / 2 lp FROM cells CROSS JOIN {model}),
{name}_t AS (SELECT *, max(lp) OVER (PARTITION BY cell_id) top FROM {name}_p), {name}_l AS (SELECT *, top + ln(sum(exp(lp - top)) OVER (PARTITION BY cell_id)) lse FROM {name}_t),
{name} AS (SELECT *, exp(lp - lse) r FROM {name}_l)"""


def em_steps() -> str:
    """Clusters of the nearest start, then EM_STEPS rounds of responsibilities and weighted moments; a ridge of 1e-6."""
    starts = ", ".join(f"({i}, {x}e0, {y}e0)" for i, (x, y) in enumerate(EM_MEANS))
    ctes = f"""near AS (SELECT cell_id, x, y, arg_min(k, (x - sx) * (x - sx) + (y - sy) * (y - sy)) k FROM cells CROSS JOIN (VALUES {starts}) s(k, sx, sy) GROUP BY ALL),
m0 AS (SELECT k, count(*) * 1e0 / (SELECT count(*) FROM cells) w, any_value(sx) mx, any_value(sy) my, var_pop(x) + 1e-6 cxx, covar_pop(x, y) cxy, var_pop(y) + 1e-6 cyy FROM near JOIN (VALUES {starts}) s(k, sx, sy) USING (k) GROUP BY k)"""
    for i in range(EM_STEPS):
        ctes += f""",
{density(f'e{i}', f'm{i}')}, a{i} AS (SELECT k, sum(r) s, sum(r * x) / sum(r) mx, sum(r * y) / sum(r) my, sum(r * x * x) / sum(r) xx, sum(r * x * y) / sum(r) xy, sum(r * y * y) / sum(r) yy FROM e{i} GROUP BY k),
m{i + 1} AS (SELECT k, s / (SELECT count(*) FROM cells) w, mx, my, xx - mx * mx + 1e-6 cxx, xy - mx * my cxy, yy - my * my + 1e-6 cyy FROM a{i})"""
    last = EM_STEPS - 1
    return f"""WITH {EMB}, {ctes}
SELECT CAST(k AS INTEGER) k, round((SELECT -avg(lse) FROM e{last} WHERE k = 0), 6) nll, round(w, 6) w, round(mx, 6) mx, round(my, 6) my, round(cxx, 6) cxx, round(cxy, 6) cxy, round(cyy, 6) cyy FROM m{EM_STEPS}"""


def ring_values() -> str:
    rows = [f"('{c}', {i}, {j}, {len(r)}, CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))" for c, rings in RINGS.items() for i, r in enumerate(rings) for j, (x, y) in enumerate(r)]
    return f"""pts AS (SELECT * FROM (VALUES {', '.join(rows)}) v(component, ring, seq, n, x, y)),
sides AS (SELECT a.component, a.ring, a.seq, a.x x1, a.y y1, b.x x2, b.y y2 FROM pts a JOIN pts b ON b.component = a.component AND b.ring = a.ring AND b.seq = (a.seq + 1) % a.n),
perring AS (SELECT component, ring, abs(sum(x1*y2 - x2*y1) / 2) a, sum(sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1))) l FROM sides GROUP BY ALL),
ap AS (SELECT component, sum(CASE WHEN ring = 0 THEN a ELSE -a END) area, sum(l) perimeter FROM perring GROUP BY component),
shell AS (SELECT * FROM pts WHERE ring = 0),
hull AS (SELECT p.component, p.x px, p.y py, (q.x-p.x)/sqrt((q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y)) ux, (q.y-p.y)/sqrt((q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y)) uy
  FROM shell p JOIN shell q ON p.component = q.component AND p.seq <> q.seq
  WHERE NOT EXISTS (SELECT 1 FROM shell z WHERE z.component = p.component AND (q.x-p.x)*(z.y-p.y) - (q.y-p.y)*(z.x-p.x) < -1e-12)),
boxes AS (SELECT h.component, h.px, h.py, h.ux, h.uy, max(z.x*ux + z.y*uy) - min(z.x*ux + z.y*uy) w, max(z.y*ux - z.x*uy) - min(z.y*ux - z.x*uy) d
  FROM hull h JOIN shell z USING (component) GROUP BY ALL),
axes AS (SELECT component, arg_min(least(w,d), w*d) minor, arg_min(greatest(w,d), w*d) major FROM boxes GROUP BY component)"""


CURL = "curls AS (SELECT component, CASE WHEN fibre < major - 1e-12 THEN 0e0 ELSE 1 - major / fibre END v FROM (SELECT component, major, area / ((perimeter - sqrt(greatest(perimeter*perimeter - 16*area, 0))) / 4) fibre FROM ap JOIN axes USING (component)))"


def purity(exterior: bool) -> str:
    return f"""WITH {EMB}, {ring_values()},
lib AS (SELECT cluster component, arg_min(sample, cell_id) sample FROM cells GROUP BY 1),
hit AS (SELECT c.cell_id, c.cluster, s.component FROM sides s JOIN lib l USING (component) JOIN cells c ON c.sample = l.sample
  AND (s.y1 > c.y) <> (s.y2 > c.y) AND c.x < (s.x2 - s.x1) * (c.y - s.y1) / (s.y2 - s.y1) + s.x1
  WHERE s.y1 <> s.y2 {'AND s.ring = 0' if exterior else ''} GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT component, 'purity' metric, round(sum(CASE WHEN cluster = component THEN 1 ELSE 0 END) * 1e0 / count(*), 6) AS value FROM hit GROUP BY component"""


ENRICH = f"""{EVT}, cnt AS (SELECT grp g, cluster l, count(*) n FROM cells WHERE grp IS NOT NULL AND cluster IS NOT NULL GROUP BY ALL),
ge AS (SELECT grp g, count(*) * 1e0 / (SELECT count(*) FROM cells) e FROM cells WHERE grp IS NOT NULL GROUP BY 1),
en AS (SELECT g, l, coalesce(n, 0) * 1e0 / sum(coalesce(n, 0)) OVER (PARTITION BY l) o, e FROM ge CROSS JOIN (SELECT DISTINCT l FROM cnt) LEFT JOIN cnt USING (g, l))"""
PROP = f"""{EVT}, cnt AS (SELECT grp id, cluster val, count(*) n FROM cells WHERE grp IS NOT NULL AND cluster IS NOT NULL GROUP BY ALL),
grid AS (SELECT a.id, b.val, coalesce(n, 0) * 1e0 n FROM (SELECT DISTINCT id FROM cnt) a CROSS JOIN (SELECT DISTINCT val FROM cnt) b LEFT JOIN cnt USING (id, val))"""


def oracle_sql() -> dict[str, str]:
    out = {
        "lattice_edges": f"WITH {CUST}, {EDGES} SELECT src, dst, 1e0 weight, 1e0 dist FROM edges",
        "lattice_edges_diagonal_by_sample": f"WITH {CUST} SELECT a.cell_id src, b.cell_id dst, round(sqrt((a.gx-b.gx)*(a.gx-b.gx) + (a.gy-b.gy)*(a.gy-b.gy)), 6) dist FROM cells a JOIN cells b ON a.cell_id <> b.cell_id AND a.sample = b.sample AND abs(a.gx-b.gx) <= 1 AND abs(a.gy-b.gy) <= 1",
        "knn_edges": f"WITH {EMB}, {knn(6)} SELECT src, dst, round(dist, 6) dist FROM edges",
        "radius_edges": f"WITH {EMB}, {knn(1)} SELECT src, dst, round(dist, 6) dist FROM dists WHERE dist <= 0.02",
        "remove_intra_cluster_links": f"WITH {CUST}, {EDGES} SELECT src, dst, 1e0 dist FROM edges JOIN cells a ON a.cell_id = src JOIN cells b ON b.cell_id = dst WHERE a.cluster IS DISTINCT FROM b.cluster",
        "khop_degree_l1_l3": f"WITH {CUST}, {EDGES}, {RINGS3} SELECT src cell_id, 1 AS layer, count(*) n FROM r1 GROUP BY 1 UNION ALL SELECT src, 2, count(*) FROM r2 GROUP BY 1 UNION ALL SELECT src, 3, count(*) FROM r3 GROUP BY 1",
        "aggregate_neighbors_mean_l2": aggregated(["own", "mean:r1", "mean:r2"]),
        "aggregate_neighbors_var_l2": aggregated(["own", "var:r1", "var:r2"]),
        "aggregate_neighbors_mean_var_l3": aggregated(["own", "mean:r1", "var:r1", "mean:r3", "var:r3"]),
        "aggregate_neighbors_by_sample": aggregated(["own", "mean:r1"], BY_SAMPLE),
        "aggregate_neighbors_embeddings": f"WITH {EMB}, {knn(4)} SELECT cell_id, CAST(i AS INTEGER) pos, round(f[i + 1] + 1.234567e-7, 3) AS value FROM cells CROSS JOIN range(8) r(i) UNION ALL SELECT c.cell_id, CAST(8 + i AS INTEGER), round(coalesce(v, 0e0) + 1.234567e-7, 3) FROM cells c CROSS JOIN range(8) r(i) LEFT JOIN (SELECT e.src, j, avg(n.f[j + 1]) v FROM edges e JOIN cells n ON n.cell_id = e.dst CROSS JOIN range(8) q(j) GROUP BY ALL) x ON x.src = c.cell_id AND x.j = i",
        "proportion_norm": f"WITH {PROP} SELECT id, val, round(n / nullif(sum(n) OVER (PARTITION BY id), 0), 6) AS value FROM grid",
        "proportion_counts": f"WITH {PROP} SELECT id, val, n AS value FROM grid",
        "enrichment_log2": f'WITH {ENRICH} SELECT g AS "group", l AS label, round(o, 6) observed, round(e, 6) expected, CASE WHEN o > 0 THEN round(log2(o / e), 4) END enrichment FROM en',
        "enrichment_fc": f'WITH {ENRICH} SELECT g AS "group", l AS label, round(o, 6) observed, round(e, 6) expected, round(o / e, 4) enrichment FROM en',
        "enrichment_perm_pvalue": enrichment_perm(20, False),
        "enrichment_pvalue": enrichment_perm(1000, True),
        "nhood_orders": nhood(False, True, False, ORD, 6),
        "nhood_perm_pvalue": nhood_perm(20) + " SELECT source, target, round(observed, 6) observed, round(expected, 6) expected, round(enrichment, 6) enrichment, round(pvalue, 6) pvalue FROM out",
        "nhood_pvalue": nhood_perm(1000) + " SELECT source, target, round(observed, 6) observed, round(expected, 6) expected, round(enrichment, 6) enrichment, round(pvalue, 6) pvalue FROM out",
        "diff_nhood_pairs": f"WITH {ORD}, {EDGES}, {DIFF_RES}, {DIFF} SELECT condition1, condition2, s AS source, t AS target, round(d, 6) enrichment FROM diff",
        "diff_nhood_perm_pvalue": DIFF_PERM,
        "connected_components_all": f"WITH RECURSIVE {comps('a.sample = b.sample', chr(39) * 2, 0)} SELECT cell_id, component FROM named",
        "connected_components_by_cluster": f"WITH RECURSIVE {comps('a.cl = b.cl', 'cluster', 0)} SELECT cell_id, component FROM named",
        "connected_components_min_cells": f"WITH RECURSIVE {comps('a.cl = b.cl', 'cluster', 4)} SELECT cell_id, component FROM named",
        "rcs": rcs(False),
        "rcs_by_library": rcs(True),
        "fmi_matrix": f"WITH {RUNS}, {sums('tab')}, {FMI} SELECT CAST(k AS INTEGER) k, CAST(run_a AS INTEGER) run_a, CAST(run_b AS INTEGER) run_b, round(v, 6) AS value FROM fmi",
        "ari_pairs": f"WITH {RUNS}, tab2 AS (SELECT a.k, a.run run_a, b.run run_b, a.l l1, b.l l2, count(*) * 1e0 n FROM runs a JOIN runs b ON a.cell_id = b.cell_id AND b.k = a.k AND b.run < a.run GROUP BY ALL), {sums('tab2')} SELECT CAST(k AS INTEGER) k, CAST(run_a AS INTEGER) run_a, CAST(run_b AS INTEGER) run_b, round(coalesce(((nij-nn)/2 - ex) / nullif(((a2-nn)/2 + (b2-nn)/2) / 2 - ex, 0), 1e0), 6) AS value FROM (SELECT *, ((a2-nn)/2) * ((b2-nn)/2) / (nn*(nn-1)/2) ex FROM sums)",
        "stability_mirror": f"WITH {MIRROR} SELECT CAST(k AS INTEGER) k, part, CAST(run_a AS INTEGER) run_a, CAST(run_b AS INTEGER) run_b, round(v, 6) AS value FROM mir",
        "best_k": f"WITH {MIRROR}, {MEANS} SELECT CAST(k AS INTEGER) k, stability FROM means ORDER BY stability DESC, k LIMIT 1",
        "stability_peaks": f"WITH {PEAKS}, {MEANS} SELECT CAST(k AS INTEGER) k, stability FROM (SELECT *, lag(stability) OVER (ORDER BY k) b, lead(stability) OVER (ORDER BY k) a FROM means) WHERE stability > a AND stability > b",
        "stability_mape": f"WITH {RUNS}, {sums('tab')}, {FMI}, m3 AS (SELECT k, avg(v) a FROM fmi WHERE run_a < 3 GROUP BY k), m4 AS (SELECT k, avg(v) b FROM fmi GROUP BY k) SELECT round(avg(abs(a - b) / greatest(abs(a), 2.220446049250313e-16)), 6) mape FROM m3 JOIN m4 USING (k)",
        "polygon_area_perimeter": f"WITH {ring_values()} SELECT component, round(area, 6) area, round(perimeter, 6) perimeter FROM ap",
        "curl": f"WITH {ring_values()}, {CURL} SELECT component, 'curl' metric, round(v, 6) AS value FROM curls",
        "elongation_hull_axes": f"WITH {ring_values()} SELECT component, 'elongation' metric, round(1 - minor / major, 6) AS value FROM axes",
        "boundaries_wkb": f"WITH {ring_values()} SELECT component, ring, seq, x1, y1, x2, y2 FROM sides",
        "purity": purity(False),
        "purity_exterior": purity(True),
        "gmm_k1_moments": f"WITH {EMB} SELECT CAST(i AS INTEGER) i, CAST(j AS INTEGER) j, round(avg(f[i+1]), 6) mean, round(covar_pop(f[i+1], f[j+1]) + CASE WHEN i = j THEN 1e-6 ELSE 0 END, 6) cov FROM cells CROSS JOIN range(3) a(i) CROSS JOIN range(3) b(j) GROUP BY i, j",
        "enrichment_dotplot_significance": f"""WITH en AS ({enrichment_perm(20, False, 14)}), f AS (SELECT *, coalesce(enrichment, 0) v FROM en)
SELECT "group", label, round(v, 4) AS value, round(abs(v) * 100 / max(abs(v)) OVER () * 3, 4) AS size, CASE WHEN pvalue <= 0.5 THEN 0e0 ELSE 0.8e0 END color FROM f""",
        "gmm_em_steps": em_steps(),
        "gmm_scores": f"""WITH {EMB}, {density('e', "(VALUES (0, 0.4e0, -0.1e0, 0e0, 0.02e0, 0.005e0, 0.03e0), (1, 0.6e0, 0.1e0, 0.05e0, 0.03e0, 0e0, 0.01e0)) m(k, w, mx, my, cxx, cxy, cyy)")}
SELECT cell_id, CAST(arg_max(k, lp) AS INTEGER) AS cluster, round(sum(CASE WHEN k = 0 THEN r ELSE 0 END), 6) p0, round(-any_value(lse), 6) nll FROM e GROUP BY cell_id""",
        "delaunay_edges": f"""WITH {EMB}, pairs AS (SELECT a.cell_id src, b.cell_id dst, a.sample, (a.x + b.x) / 2 mx, (a.y + b.y) / 2 my, b.x - a.x dx, b.y - a.y dy FROM cells a JOIN cells b ON a.sample = b.sample AND a.cell_id < b.cell_id),
sides AS (SELECT p.*, (c.y - my) * dx - (c.x - mx) * dy AS side, ((c.x - mx) * (c.x - mx) + (c.y - my) * (c.y - my) - (dx * dx + dy * dy) / 4) / 2 AS room FROM pairs p JOIN cells c ON c.sample = p.sample AND c.cell_id <> src AND c.cell_id <> dst),
span AS (SELECT src, dst, any_value(sqrt(dx * dx + dy * dy)) dist, max(CASE WHEN side < 0 THEN room / side END) low, min(CASE WHEN side > 0 THEN room / side END) high FROM sides GROUP BY src, dst),
e AS (SELECT * FROM span WHERE coalesce(low <= high, true))
SELECT src, dst, round(dist, 6) dist FROM e UNION ALL SELECT dst, src, round(dist, 6) FROM e""",
        "enrichment_dotplot_table": f'WITH {ENRICH}, raw AS (SELECT g, l, CASE WHEN o > 0 THEN log2(o / e) END v FROM en), fin AS (SELECT g, l, coalesce(v, min(v) OVER ()) v FROM raw), siz AS (SELECT *, least(abs(v), 0.05e0) q FROM fin) SELECT * FROM (SELECT g AS "group", l AS label, round(v, 4) AS value, round(q * 100 / max(q) OVER () * 3, 4) AS size, 0e0 color, v FROM siz) WHERE v >= 0',
        "proportion_table": f"WITH {PROP}, p AS (SELECT id, val, n / nullif(sum(n) OVER (PARTITION BY id), 0) v FROM grid) SELECT id, val, CAST(row_number() OVER (PARTITION BY id ORDER BY val DESC) AS INTEGER) AS position, round(v, 6) AS value FROM p WHERE id IN ('1', '2', '3')",
        "nhood_heatmap_table": f"{nhood_perm(20)}, fr AS (SELECT cluster, count(*) * 1e0 / (SELECT count(*) FROM cells) f FROM cells GROUP BY 1) SELECT target AS \"row\", source AS col, CASE WHEN a.f >= 0.19 AND b.f >= 0.19 THEN round(enrichment, 3) END AS value, CASE WHEN pvalue <= 0.05 THEN '*' ELSE '' END star FROM out JOIN fr a ON a.cluster = source JOIN fr b ON b.cluster = target",
        "diff_heatmap_negated": f"WITH {ORD}, {EDGES}, {DIFF_RES}, {DIFF} SELECT 'O' condition1, 'F' condition2, s AS source, t AS target, round(-d, 6) AS value FROM diff WHERE condition1 = 'F' AND condition2 = 'O' UNION ALL SELECT 'F', 'P', s, t, round(d, 6) FROM diff WHERE condition1 = 'F' AND condition2 = 'P'",
        "shape_metrics_long": f"WITH {EMB}, {ring_values()}, {CURL}, m AS (SELECT component, 'curl' metric, v FROM curls UNION ALL SELECT component, 'elongation', 1 - minor / major FROM axes) SELECT m.component, c.sample AS condition, metric, round(v, 6) AS value FROM (SELECT DISTINCT cluster, sample FROM cells) c JOIN m ON m.component = c.cluster",
        "shape_boxes": f"""WITH {CUST}, q AS (SELECT cluster, quantile_cont(value, 0.25) q1, quantile_cont(value, 0.5) median, quantile_cont(value, 0.75) q3, count(value) n FROM cells GROUP BY cluster)
SELECT cluster, round(any_value(q1), 4) q1, round(any_value(median), 4) median, round(any_value(q3), 4) q3, round(min(value), 4) low, round(max(value), 4) high, any_value(n) n
FROM q JOIN cells USING (cluster) WHERE value BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1) GROUP BY cluster""",
        "stability_curve": f"WITH {MIRROR} SELECT CAST(k AS INTEGER) k, round(avg(v), 6) stability, round(avg(v) - 1.96e0 * stddev_samp(v) / sqrt(count(*)), 6) low, round(avg(v) + 1.96e0 * stddev_samp(v) / sqrt(count(*)), 6) high FROM mir GROUP BY k",
        "boundary_plot_components": f"WITH {EMB}, {ring_values()} SELECT component, CAST(max(ring) + 1 AS INTEGER) n_rings FROM pts WHERE component IN (SELECT cluster FROM cells WHERE sample = '1') GROUP BY component",
        "windowed_label_counts": f"WITH {EVT} SELECT date_trunc('day', ts) AS start, cluster, count(*) n FROM cells GROUP BY ALL",
    }
    for p in (99, 50):
        out[f"remove_long_links_p{p}"] = f"WITH {EMB}, {knn(6)}, lim AS (SELECT quantile_cont(dist, {p / 100}) t FROM edges WHERE dist > 0) SELECT src, dst, round(dist, 6) dist, round(t, 6) radius FROM edges, lim WHERE dist <= t"
    out |= {nhood_name(*v): nhood(*v) for v in NHOOD}
    out["enrichment_dotplot_table"] = out["enrichment_dotplot_table"].replace("SELECT * FROM (SELECT g", 'SELECT "group", label, "value", "size", color FROM (SELECT g')
    return out
