"""DuckDB SQL that gives each query's rows from the supplied tables."""
from __future__ import annotations

CELLS = """cells AS MATERIALIZED (
 SELECT row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount)::BIGINT AS cell_id,
  l_suppkey::BIGINT AS organoid_id,
  CASE WHEN floor(l_suppkey / 4)::BIGINT % 2 = 0 THEN 'exp1' ELSE 'exp3' END AS experiment,
  'Rep' || (floor(l_suppkey / 8)::BIGINT % 3 + 1)::VARCHAR AS replicate,
  (CASE l_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN 100 ELSE 1000 END)::BIGINT AS dox,
  l_quantity AS x, l_extendedprice / 2e3 AS y, l_discount * 5e2 AS z,
  CASE l_returnflag WHEN 'A' THEN 2e0 WHEN 'R' THEN 3e0 ELSE 0e0 END AS cell_type,
  l_tax * 1e2 AS ch_546, l_discount * l_extendedprice / 1e3 AS ch_647
 FROM lineitem)"""
META = "meta AS (SELECT DISTINCT organoid_id, experiment, replicate, dox FROM cells)"
FEAT = """feat AS (SELECT organoid_id, experiment, replicate, dox, count(*)::BIGINT AS total_cells,
 count(*) FILTER (cell_type = 2) / count(*)::DOUBLE AS pct_endo, count(*) FILTER (cell_type = 3) / count(*)::DOUBLE AS pct_meso,
 avg(x) AS f1, avg(CASE WHEN organoid_id % 7 <> 0 THEN y END) AS f2, avg(ch_546) AS f3 FROM cells GROUP BY ALL)"""
FLONG = "fl AS (SELECT organoid_id, experiment, replicate, dox, metric, v FROM feat UNPIVOT INCLUDE NULLS (v FOR metric IN (f1, f2, f3)))"
SCORE = "sc AS (SELECT organoid_id, experiment, replicate, dox, avg(x) - 25.5e0 AS pc1, avg(y) - 26e0 AS pc2, avg(z) - 25e0 AS pc3 FROM cells GROUP BY ALL)"
SLONG = "sl AS (SELECT organoid_id, experiment, replicate, dox, pc, v FROM sc UNPIVOT (v FOR pc IN (pc1, pc2, pc3)))"
PRED = """pr AS (SELECT *, experiment || '::' || replicate AS fold, pc1 * 0.9e0 + (organoid_id % 5) * 0.01e0 AS p1,
 pc2 * 0.9e0 + (organoid_id % 5) * 0.01e0 AS p2, pc3 * 0.9e0 + (organoid_id % 5) * 0.01e0 AS p3 FROM sc)"""
D2 = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)"


def near(name: str, r: float, where: str = "true") -> str:
    return f"""{name} AS (SELECT a.organoid_id, a.cell_id AS i, a.cell_type AS s, b.cell_id AS j, b.cell_type AS t, {D2} AS d2, b.ch_546 AS v, b.ch_647 AS w
 FROM cells a JOIN cells b ON a.organoid_id = b.organoid_id WHERE {D2} <= {r:g}e0 * {r:g}e0 AND ({where}))"""


def clusters(eps: float = 6, least: int = 4) -> str:
    return f"""{near('p', eps, 'a.cell_type = b.cell_type AND a.cell_type IN (2, 3)')},
core AS (SELECT organoid_id, s, i FROM p GROUP BY ALL HAVING count(*) >= {least}),
e AS (SELECT p.organoid_id, p.s, p.i, p.j FROM p JOIN core a ON a.organoid_id = p.organoid_id AND a.i = p.i JOIN core b ON b.organoid_id = p.organoid_id AND b.i = p.j),
reach AS (SELECT organoid_id, s, i, i AS root FROM core UNION SELECT r.organoid_id, r.s, e.j, r.root FROM reach r JOIN e ON e.organoid_id = r.organoid_id AND e.i = r.i),
comp AS (SELECT organoid_id, s, i, min(root) AS root FROM reach GROUP BY ALL),
num AS (SELECT organoid_id, s, i, dense_rank() OVER (PARTITION BY organoid_id, s ORDER BY root) - 1 AS c FROM comp),
rim AS (SELECT p.organoid_id, p.i, min(n.c) AS c FROM p JOIN num n ON n.organoid_id = p.organoid_id AND n.i = p.j GROUP BY ALL),
cl AS (SELECT k.*, coalesce(n.c, r.c, -1)::BIGINT AS cluster_id FROM cells k LEFT JOIN num n ON n.organoid_id = k.organoid_id AND n.i = k.cell_id
 LEFT JOIN rim r ON r.organoid_id = k.organoid_id AND r.i = k.cell_id WHERE k.cell_type IN (2, 3)),
spine AS (SELECT DISTINCT organoid_id, t AS cell_type FROM cells, (VALUES (2e0), (3e0)) v(t)),
met AS (SELECT s.organoid_id, s.cell_type, coalesce(n, 0)::BIGINT AS n_cells, coalesce(k, 0)::BIGINT AS k, avg_size FROM spine s LEFT JOIN
 (SELECT organoid_id, cell_type, sum(n) AS n, count(*) FILTER (cluster_id >= 0) AS k, avg(n) FILTER (cluster_id >= 0) AS avg_size
  FROM (SELECT organoid_id, cell_type, cluster_id, count(*) AS n FROM cl GROUP BY ALL) GROUP BY ALL) USING (organoid_id, cell_type)),
intra AS (SELECT organoid_id, cell_type, avg(d) AS distance FROM (SELECT a.organoid_id, a.cell_type, a.cluster_id AS u, b.cluster_id AS w, sqrt(min({D2})) AS d
 FROM cl a JOIN cl b ON a.organoid_id = b.organoid_id AND a.cell_type = b.cell_type AND a.cluster_id < b.cluster_id WHERE a.cluster_id >= 0 GROUP BY ALL) GROUP BY ALL),
lp AS (SELECT a.organoid_id, a.cluster_id AS endo, b.cluster_id AS meso, sqrt(min({D2})) AS min_dist FROM cl a JOIN cl b ON a.organoid_id = b.organoid_id
 WHERE a.cell_type = 2 AND b.cell_type = 3 AND a.cluster_id >= 0 AND b.cluster_id >= 0 GROUP BY ALL),
adj0 AS (SELECT organoid_id, (count(DISTINCT cluster_id) FILTER (cell_type = 2))::BIGINT AS n_endo, (count(DISTINCT cluster_id) FILTER (cell_type = 3))::BIGINT AS n_meso FROM cl WHERE cluster_id >= 0 GROUP BY ALL),
adj1 AS (SELECT organoid_id, count(*) AS tp, count(DISTINCT endo) AS te, count(DISTINCT meso) AS tm FROM lp WHERE min_dist <= 6 GROUP BY ALL),
adj AS (SELECT organoid_id, n_endo, n_meso, CASE WHEN n_endo < n_meso THEN 'Endo' ELSE 'Meso' END AS minority, CASE WHEN n_endo < n_meso THEN 'Meso' ELSE 'Endo' END AS majority,
 least(n_endo, n_meso) AS n_minority, greatest(n_endo, n_meso) AS n_majority,
 (CASE WHEN n_endo < n_meso THEN coalesce(te, 0) ELSE coalesce(tm, 0) END)::BIGINT AS minority_touched, (CASE WHEN n_endo < n_meso THEN coalesce(tm, 0) ELSE coalesce(te, 0) END)::BIGINT AS majority_touched,
 coalesce(tp, 0)::BIGINT AS touching_pairs FROM adj0 LEFT JOIN adj1 USING (organoid_id)),
adjm AS (SELECT *, CASE WHEN n_endo > 0 AND n_meso > 0 THEN 100e0 * minority_touched / n_minority ELSE 0e0 END AS minority_pct,
 CASE WHEN n_endo > 0 AND n_meso > 0 THEN 100e0 * majority_touched / n_majority ELSE 0e0 END AS majority_pct,
 CASE WHEN n_endo > 0 AND n_meso > 0 THEN 100e0 * touching_pairs / (n_endo + n_meso) ELSE 0e0 END AS density_pct FROM adj)"""


TOT = "tot AS (SELECT organoid_id, count(*) AS n, count(*) FILTER (cell_type = 2) AS ne, count(*) FILTER (cell_type = 3) AS nm FROM cells GROUP BY ALL)"


def pooled(name: str, p: str, r: float, least: int, none: str) -> str:
    """Pooled mixing scores of both lineages from pairs ``p``."""
    one = lambda t, u, a, b: f"CASE WHEN {a} >= {least} AND {b} >= {least} THEN CASE WHEN sum(CASE WHEN s = {t} AND t = {t} AND i <> j AND d2 <= {r:g}e0 * {r:g}e0 THEN 1 ELSE 0 END) > 0 THEN (sum(CASE WHEN s = {t} AND t = {u} AND d2 <= {r:g}e0 * {r:g}e0 THEN 1 ELSE 0 END) / sum(CASE WHEN s = {t} AND t = {t} AND i <> j AND d2 <= {r:g}e0 * {r:g}e0 THEN 1 ELSE 0 END)::DOUBLE) / ({b} / {a}::DOUBLE) ELSE {none} END END"
    return f"{name} AS (SELECT organoid_id, {one(2, 3, 'any_value(ne)', 'any_value(nm)')} AS nms_endo, {one(3, 2, 'any_value(nm)', 'any_value(ne)')} AS nms_meso FROM tot LEFT JOIN {p} USING (organoid_id) GROUP BY organoid_id)"


def ranked(source: str, group: str, seed: int, parts: str, row: str) -> str:
    """Rows of ``source`` with their rank in a group by the digest of (seed, parts)."""
    return f"SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY md5(concat_ws(':', {seed}, {parts})), {row}) AS rank FROM ({source})"


#: Rows of the modelling table: four inputs, three targets.
MODEL = """mt AS (SELECT organoid_id AS row_id, experiment, replicate, log10(dox + 1e0) AS u1, CASE experiment WHEN 'exp1' THEN 2e0 ELSE 6e0 END AS u2,
 (experiment = 'exp1')::INT::DOUBLE AS u3, (experiment = 'exp3')::INT::DOUBLE AS u4, pc1, pc2, pc3 FROM an)"""
BOTH = """fo AS MATERIALIZED (SELECT f.fold, 'LOR' AS split_type, row_id, CASE WHEN experiment || '::' || replicate = f.fold THEN 'test' ELSE 'train' END AS role FROM mt, (SELECT DISTINCT experiment || '::' || replicate AS fold FROM mt) f
 UNION ALL SELECT f.fold, 'LOEX', row_id, CASE WHEN experiment = f.fold THEN 'test' ELSE 'train' END FROM mt, (SELECT DISTINCT experiment AS fold FROM mt) f)"""


def ridge(models, alphas: str, steps: int, folds: str = "fo") -> list[str]:
    """CTEs up to ``pred`` (fold, split_type, model, alpha, row_id, t, y, p): ridge models of a table of folds by Gauss-Jordan elimination.

    ``alphas``: a table (fold, model, alpha).
    """
    from itertools import combinations_with_replacement

    design = []
    if "ridge_linear" in models:
        design.append("SELECT fold, 'ridge_linear' AS model, row_id, role, j, [u1, u2, u3, u4][j] AS v FROM x, range(1, 5) r(j)")
    if "poly_ridge" in models:
        products = ", ".join("*".join(c) for d in (1, 2, 3) for c in combinations_with_replacement(("u1", "u2", "u3", "u4"), d))
        design.append(f"SELECT fold, 'poly_ridge' AS model, row_id, role, unnest(range(1, 35)) AS j, unnest([{products}]) AS v FROM x")
    out = [f"x AS MATERIALIZED (SELECT fold, split_type, row_id, role, u1, u2, CASE WHEN role = 'test' AND split_type = 'LOEX' THEN 0e0 ELSE u3 END AS u3, CASE WHEN role = 'test' AND split_type = 'LOEX' THEN 0e0 ELSE u4 END AS u4, pc1, pc2, pc3 FROM {folds} JOIN mt USING (row_id))"]
    if "spline" in models:
        knot = lambda i: f"(lo + step * ({i} - 3))"
        out.append("""rg AS (SELECT fold, d, lo, CASE WHEN hi > lo THEN hi ELSE lo + 1 END AS hi FROM (SELECT fold, d, min([u1, u2][d]) AS lo, max([u1, u2][d]) AS hi FROM x, range(1, 3) r(d) WHERE role = 'train' GROUP BY ALL)),
s0 AS (SELECT *, list_transform(range(0, 10), lambda i: CASE WHEN w >= hi THEN (i = 6)::INT::DOUBLE ELSE (lo + step * (i - 3) <= w AND w < lo + step * (i - 2))::INT::DOUBLE END) AS b
 FROM (SELECT fold, row_id, role, d, lo, hi, (hi - lo) / 4 AS step, least(greatest([u1, u2][d], lo), hi) AS w FROM x JOIN rg USING (fold)))""")
        for k in (1, 2, 3):
            out.append(f"s{k} AS (SELECT * REPLACE (list_transform(range(0, {10 - k}), lambda i: (w - {knot('i')}) / ({k} * step) * b[i + 1] + ({knot(f'(i + {k + 1})')} - w) / ({k} * step) * b[i + 2]) AS b) FROM s{k - 1})")
        design.append("SELECT fold, 'spline' AS model, row_id, role, (d - 1) * 6 + j AS j, b[j + 1] AS v FROM s3, range(1, 7) r(j)")
        design.append("SELECT fold, 'spline' AS model, row_id, role, 12 + j AS j, [u3, u4][j] AS v FROM x, range(1, 3) r(j)")
    out.append(f"de AS MATERIALIZED ({' UNION ALL '.join(design)})")
    out.append("""me AS MATERIALIZED (SELECT fold, model, j, avg(v) AS m, CASE WHEN model <> 'spline' AND var_pop(v) > 1e-12 * avg(v * v) THEN stddev_pop(v) ELSE 1 END AS s FROM de WHERE role = 'train' GROUP BY fold, model, j),
yt AS MATERIALIZED (SELECT fold, row_id, role, t, [pc1, pc2, pc3][t] AS y FROM x, range(1, 4) r(t)), ym AS (SELECT fold, t, avg(y) AS c FROM yt WHERE role = 'train' GROUP BY ALL),
zt AS MATERIALIZED (SELECT de.fold, de.model, de.row_id, de.role, de.j, (v - m) / s AS z FROM de JOIN me USING (fold, model, j)),
gr AS MATERIALIZED (SELECT a.fold, a.model, a.j AS i, b.j, sum(a.z * b.z) AS v FROM zt a JOIN zt b USING (fold, model, row_id) WHERE a.role = 'train' GROUP BY ALL
 UNION ALL SELECT a.fold, a.model, a.j AS i, 1000 + t, sum(a.z * (y - c)) FROM zt a JOIN yt USING (fold, row_id) JOIN ym USING (fold, t) WHERE a.role = 'train' GROUP BY ALL)""")
    out.append(f"g0 AS MATERIALIZED (SELECT fold, model, alpha, i, j, v + CASE WHEN i = j THEN alpha ELSE 0 END AS v FROM gr JOIN ({alphas}) al USING (fold, model))")
    for k in range(1, steps + 1):
        f = f"g{k - 1}"
        out.append(f"""g{k} AS MATERIALIZED (SELECT a.fold, a.model, a.alpha, a.i, a.j, CASE WHEN p.v IS NULL THEN a.v WHEN a.i = {k} THEN a.v / p.v ELSE a.v - c.v * r.v / p.v END AS v FROM {f} a
 LEFT JOIN (SELECT * FROM {f} WHERE i = {k} AND j = {k}) p ON p.fold = a.fold AND p.model = a.model AND p.alpha = a.alpha
 LEFT JOIN (SELECT * FROM {f} WHERE i = {k}) r ON r.fold = a.fold AND r.model = a.model AND r.alpha = a.alpha AND r.j = a.j
 LEFT JOIN (SELECT * FROM {f} WHERE j = {k}) c ON c.fold = a.fold AND c.model = a.model AND c.alpha = a.alpha AND c.i = a.i)""")
    out.append(f"""pred AS (SELECT fold, any_value(split_type) AS split_type, model, alpha, row_id, t, any_value(y) AS y, any_value(c) + sum(z * w.v) AS p FROM zt JOIN (SELECT fold, model, alpha, i AS j, j - 1000 AS t, v FROM g{steps} WHERE j > 1000) w USING (fold, model, j)
 JOIN yt USING (fold, row_id, t) JOIN ym USING (fold, t) JOIN (SELECT DISTINCT fold, split_type FROM x) USING (fold) WHERE zt.role = 'test' GROUP BY fold, model, alpha, row_id, t)""")
    return out


def build() -> dict[str, str]:
    q: dict[str, str] = {}

    def add(name, columns, body, *ctes, recursive=False):
        """columns: name:kind, kind d (double), i (long) or s."""
        out = []
        for c in columns.split():
            n, k = c.split(":")
            out.append(f"round({n}, 6) + 0e0 AS {n}" if k == "d" else f"{n}::BIGINT AS {n}" if k == "i" else n)
        q[name] = f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([CELLS, *ctes])} SELECT {', '.join(out)} FROM ({body})"

    def addc(name, columns, body, *ctes):
        add(name, columns, body, META, clusters(), *ctes, recursive=True)

    add("lineage_filter", "organoid_id:i cell_id:i cell_type:d", "SELECT * FROM cells WHERE cell_type IN (2, 3)")
    add("one_vs_all", "organoid_id:i cell_type:d n:i", "SELECT organoid_id, CASE WHEN cell_type = 2 THEN 2e0 ELSE 99e0 END AS cell_type, count(*) AS n FROM cells GROUP BY ALL")
    slab = "m AS (SELECT organoid_id, median(z) AS z_center FROM cells GROUP BY ALL), slab AS (SELECT c.*, z_center FROM cells c JOIN m USING (organoid_id) WHERE z BETWEEN z_center - 5 AND z_center + 5)"
    add("z_slab", "organoid_id:i cell_id:i z_center:d", "SELECT * FROM slab", slab)
    add("centered_slice", "organoid_id:i cell_id:i x:d y:d z:d", "SELECT organoid_id, cell_id, x, y, z FROM (SELECT *, count(*) OVER (PARTITION BY organoid_id) AS k FROM c WHERE abs(z) < 12 AND x * x + y * y < 400) WHERE k >= 10",
        "k AS (SELECT organoid_id, median(x) mx, median(y) my, median(z) mz, count(*) AS n FROM cells WHERE cell_type IN (2, 3) GROUP BY ALL HAVING count(*) >= 100), c AS (SELECT organoid_id, cell_id, x - mx AS x, y - my AS y, z - mz AS z FROM cells JOIN k USING (organoid_id) WHERE cell_type IN (2, 3))")
    add("first_n_per_group", "organoid_id:i experiment:s replicate:s dox:i condition:s", "SELECT *, row_number() OVER (PARTITION BY experiment, replicate, dox, condition ORDER BY organoid_id) AS k FROM s QUALIFY k <= 3",
        META, "s AS (SELECT *, CASE WHEN experiment = 'exp1' THEN 'BASAL' WHEN organoid_id % 3 = 0 THEN 'BMP4' WHEN organoid_id % 3 = 1 THEN 'WNT5A' ELSE 'BASAL' END AS condition FROM meta)")
    add("radius_pairs", "organoid_id:i n_pairs:i sum_distance:d", "SELECT organoid_id, count(*) AS n_pairs, sum(sqrt(d2)) AS sum_distance FROM p GROUP BY ALL", near("p", 10))
    add("radius_pairs_grid", "organoid_id:i n_pairs:i", "SELECT organoid_id, count(*) AS n_pairs FROM p GROUP BY ALL", near("p", 6))
    add("composition", "organoid_id:i total_cells:i n_endo:i n_meso:i pct_endo:d pct_meso:d", "SELECT organoid_id, n AS total_cells, ne AS n_endo, nm AS n_meso, ne / n::DOUBLE AS pct_endo, nm / n::DOUBLE AS pct_meso FROM tot", TOT)
    radial = "c AS (SELECT organoid_id, avg(x) cx, avg(y) cy, avg(z) cz FROM cells GROUP BY ALL), d AS (SELECT organoid_id, cell_type, sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy)+(z-cz)*(z-cz)) AS r FROM cells JOIN c USING (organoid_id)), rad AS (SELECT organoid_id, avg(r) FILTER (cell_type = 2) AS radial_mean_endo, stddev_pop(r) FILTER (cell_type = 2) AS radial_std_endo, avg(r) FILTER (cell_type = 3) AS radial_mean_meso, stddev_pop(r) FILTER (cell_type = 3) AS radial_std_meso FROM d GROUP BY ALL)"
    add("radial_stats", "organoid_id:i radial_mean_endo:d radial_std_endo:d radial_mean_meso:d radial_std_meso:d", "SELECT * FROM rad", radial)
    pct = "pct AS (SELECT organoid_id, cell_type, count(*) AS n, 100e0 * count(*) / sum(count(*)) OVER (PARTITION BY organoid_id) AS pct FROM cells GROUP BY organoid_id, cell_type)"
    add("celltype_pct", "organoid_id:i cell_type:d n:i pct:d", "SELECT * FROM pct", pct)
    add("celltype_pivot", "organoid_id:i pct_0:d pct_2:d pct_3:d", "SELECT organoid_id, coalesce(sum(pct) FILTER (cell_type = 0), 0) AS pct_0, coalesce(sum(pct) FILTER (cell_type = 2), 0) AS pct_2, coalesce(sum(pct) FILTER (cell_type = 3), 0) AS pct_3 FROM pct GROUP BY ALL", pct)
    add("depth_alpha", "organoid_id:i cell_id:i depth:d alpha:d", "SELECT organoid_id, cell_id, depth, 0.15e0 + depth * (1e0 - 0.15e0) AS alpha FROM (SELECT *, CASE WHEN max(z) OVER w > min(z) OVER w THEN (z - min(z) OVER w) / (max(z) OVER w - min(z) OVER w) ELSE 1e0 END AS depth FROM cells WINDOW w AS (PARTITION BY organoid_id))")
    lin = "a.cell_type IN (2, 3) AND b.cell_type IN (2, 3)"
    add("nms_pooled", "organoid_id:i nms_endo:d nms_meso:d", "SELECT * FROM m WHERE nms_endo IS NOT NULL OR nms_meso IS NOT NULL", near("p", 10, lin), TOT, pooled("m", "p", 10, 11, "0e0"))
    ratios = """mr AS (SELECT organoid_id, i, s, count(*) FILTER (t <> s) AS f, count(*) FILTER (t = s AND i <> j) AS o FROM p WHERE s IN (2, 3) GROUP BY ALL),
mor AS (SELECT organoid_id, CASE WHEN any_value(ne) >= 10 AND any_value(n - ne) >= 10 THEN avg(f / o::DOUBLE) FILTER (s = 2 AND o > 0) / (any_value(n - ne) / any_value(ne)::DOUBLE) END AS nms_endo,
 CASE WHEN any_value(nm) >= 10 AND any_value(n - nm) >= 10 THEN avg(f / o::DOUBLE) FILTER (s = 3 AND o > 0) / (any_value(n - nm) / any_value(nm)::DOUBLE) END AS nms_meso FROM tot LEFT JOIN mr USING (organoid_id) GROUP BY organoid_id)"""
    add("nms_mean_of_ratios", "organoid_id:i nms_endo:d nms_meso:d", "SELECT * FROM mor", near("p", 10), TOT, ratios)
    add("nms_endo_only", "organoid_id:i nms_endo:d", "SELECT * FROM m", near("p", 6, lin), TOT, pooled("m", "p", 6, 10, "0e0"))
    add("nms_multi_radius", "organoid_id:i radius:d nms_endo:d nms_meso:d", " UNION ALL ".join(f"SELECT {r}e0 AS radius, * FROM m{r} WHERE nms_endo IS NOT NULL AND nms_meso IS NOT NULL" for r in (4, 6, 10)),
        near("p", 10, lin), TOT, *(pooled(f"m{r}", "p", r, 10, "0e0") for r in (4, 6, 10)))
    trend = [META, near("p", 10, lin), TOT, pooled("m", "p", 10, 11, "NULL"), "tr AS (SELECT organoid_id, experiment, replicate, dox, metric, value FROM (SELECT * FROM meta JOIN m USING (organoid_id)) UNPIVOT INCLUDE NULLS (value FOR metric IN (nms_endo, nms_meso)))"]
    add("nms_long", "organoid_id:i experiment:s dox:i metric:s value:d", "SELECT * FROM tr", *trend)
    summ = lambda k, v, src: f"SELECT {k}, avg({v}) AS mean, stddev_samp({v}) AS sd, count({v}) AS n, stddev_samp({v}) / sqrt(greatest(count({v}), 1)) AS sem FROM {src} GROUP BY ALL"
    add("trend_summary", "experiment:s dox:i metric:s mean:d sd:d n:i sem:d", summ("experiment, dox, metric", "value", "tr"), *trend)
    add("pairwise_mean_diff", "metric:s dox:i experiment_a:s experiment_b:s mean_diff:d", "SELECT a.metric, a.dox, 'exp1' AS experiment_a, 'exp3' AS experiment_b, a.m - b.m AS mean_diff FROM g a JOIN g b ON a.metric = b.metric AND a.dox = b.dox AND a.experiment = 'exp1' AND b.experiment = 'exp3'", *trend, "g AS (SELECT experiment, dox, metric, avg(value) AS m FROM tr GROUP BY ALL)")
    add("delta_vs_baseline", "organoid_id:i experiment:s replicate:s dox:i abs_pct_endo:d rel_f1:d rel_f3:d", "SELECT f.organoid_id, f.experiment, f.replicate, f.dox, f.pct_endo - b.pe AS abs_pct_endo, CASE WHEN b.a > 0 THEN (f.f1 - b.a) / b.a * 100 ELSE 0 END AS rel_f1, CASE WHEN b.c > 0 THEN (f.f3 - b.c) / b.c * 100 ELSE 0 END AS rel_f3 FROM feat f JOIN b USING (dox) WHERE f.experiment = 'exp3'", FEAT, "b AS (SELECT dox, avg(pct_endo) AS pe, avg(f1) AS a, avg(f3) AS c FROM feat WHERE experiment = 'exp1' GROUP BY ALL)")
    add("local_mixing", "organoid_id:i cell_id:i local_mixing:d", "SELECT a.organoid_id, a.cell_id, CASE WHEN count(*) < 2 THEN 0 ELSE count(*) FILTER (b.cell_type <> a.cell_type) / (count(*) - 1)::DOUBLE END AS local_mixing FROM fl a JOIN fl b ON a.organoid_id = b.organoid_id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 36 GROUP BY ALL",
        slab, "g AS (SELECT organoid_id, avg(x) AS mx, avg(y) AS my FROM slab GROUP BY ALL), fl AS (SELECT organoid_id, cell_id, cell_type, x - mx AS x, y - my AS y FROM slab JOIN g USING (organoid_id) WHERE cell_type IN (2, 3))")
    bits = lambda c: f"CASE WHEN {c} > 0 THEN -({c} / k::DOUBLE) * log2({c} / k::DOUBLE) ELSE 0 END"
    add("entropy_gradient", "organoid_id:i radius:d entropy:d", f"SELECT organoid_id, radius, coalesce(avg({bits('e')} + {bits('m')}) FILTER (k >= 2), 0) AS entropy FROM k GROUP BY ALL", near("p", 20, lin),
        "k AS (SELECT organoid_id, i, radius, count(*) AS k, count(*) FILTER (t = 2) AS e, count(*) FILTER (t = 3) AS m FROM p JOIN (SELECT (2 * unnest(range(1, 11)))::DOUBLE AS radius) ON d2 <= radius * radius GROUP BY ALL)")
    addc("dbscan_clusters", "organoid_id:i cell_type:d cell_id:i cluster_id:i", "SELECT * FROM cl")
    addc("dbscan_counts", "organoid_id:i cell_type:d n_clusters:i", "SELECT organoid_id, cell_type, k AS n_clusters FROM met")
    addc("cluster_metrics", "organoid_id:i cell_type:d n_cells:i n_clusters:i avg_size:d", "SELECT *, CASE WHEN n_cells >= 4 THEN k END AS n_clusters FROM met")
    addc("cluster_count_3label", "organoid_id:i n_clusters:i lineage:s", "SELECT organoid_id, k AS n_clusters, CASE cell_type WHEN 2 THEN 'Endo' ELSE 'Meso' END AS lineage FROM met UNION ALL SELECT organoid_id, sum(k), 'Total' FROM met GROUP BY ALL")
    addc("cluster_centres", "organoid_id:i cell_type:d cluster_id:i n:i x:d y:d z:d", "SELECT organoid_id, cell_type, cluster_id, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM cl WHERE cluster_id >= 0 GROUP BY ALL")
    addc("intra_cluster_distance", "organoid_id:i cell_type:d distance:d", "SELECT * FROM intra")
    addc("inter_cluster_distance", "organoid_id:i distance:d", "SELECT organoid_id, avg(min_dist) AS distance FROM lp GROUP BY ALL")
    addc("cluster_touch_pairs", "organoid_id:i endo:i meso:i min_dist:d touching:i", "SELECT *, min_dist <= 6 AS touching FROM lp")
    addc("centroid_separation", "organoid_id:i cell_type:d separation:d", f"SELECT s.organoid_id, s.cell_type, coalesce(d, 0) AS separation FROM spine s LEFT JOIN (SELECT a.organoid_id, a.cell_type, avg(sqrt({D2})) AS d FROM ce a JOIN ce b ON a.organoid_id = b.organoid_id AND a.cell_type = b.cell_type AND a.cluster_id < b.cluster_id GROUP BY ALL) USING (organoid_id, cell_type)", "ce AS (SELECT organoid_id, cell_type, cluster_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM cl WHERE cluster_id >= 0 GROUP BY ALL)")
    addc("adjacency_metrics", "organoid_id:i n_endo:i n_meso:i minority:s majority:s n_minority:i n_majority:i minority_touched:i majority_touched:i touching_pairs:i minority_pct:d majority_pct:d density_pct:d", "SELECT * FROM adjm")
    addc("adjacency_long", "organoid_id:i metric:s value:d", "SELECT organoid_id, metric, value FROM adjm UNPIVOT (value FOR metric IN (minority_pct, majority_pct, density_pct))")
    addc("minority_frequency", "dox:i lineage:s pct:d", "SELECT dox, l AS lineage, 100e0 * count(*) FILTER (minority = l) / count(*) AS pct FROM adj JOIN meta USING (organoid_id), (VALUES ('Endo'), ('Meso')) v(l) GROUP BY ALL")
    addc("plot_union", "organoid_id:i metric:s lineage:s value:d", "SELECT organoid_id, 'Inter' AS metric, 'Endo-Meso' AS lineage, avg(min_dist) AS value FROM lp GROUP BY ALL UNION ALL SELECT organoid_id, 'Intra', CASE cell_type WHEN 2 THEN 'Endo' ELSE 'Meso' END, distance FROM intra")
    addc("cluster_status", "organoid_id:i n_cells:i n_clusters:i status:s", "SELECT organoid_id, n_cells, k AS n_clusters, CASE WHEN n_cells = 0 THEN 'Zero Cells' WHEN n_cells < 10 THEN 'Below MS' WHEN k = 0 THEN 'Too Sparse' ELSE 'Formed Clusters' END AS status FROM met WHERE cell_type = 2")
    sweep = []
    for e in (3, 4, 5, 6):
        sweep.append(f"c{e} AS (SELECT organoid_id, i FROM p WHERE d2 <= {e}e0 * {e}e0 GROUP BY ALL HAVING count(*) >= 4), e{e} AS (SELECT p.organoid_id, p.i, p.j FROM p JOIN c{e} a ON a.organoid_id = p.organoid_id AND a.i = p.i JOIN c{e} b ON b.organoid_id = p.organoid_id AND b.i = p.j WHERE d2 <= {e}e0 * {e}e0), r{e} AS (SELECT organoid_id, i, i AS root FROM c{e} UNION SELECT r.organoid_id, e.j, r.root FROM r{e} r JOIN e{e} e ON e.organoid_id = r.organoid_id AND e.i = r.i)")
    add("dbscan_sweep", "organoid_id:i eps:d n_clusters:i", " UNION ALL ".join(f"SELECT o.organoid_id, {e}e0 AS eps, count(DISTINCT root) AS n_clusters FROM (SELECT DISTINCT organoid_id FROM p) o LEFT JOIN (SELECT organoid_id, i, min(root) AS root FROM r{e} GROUP BY ALL) USING (organoid_id) GROUP BY ALL" for e in (3, 4, 5, 6)), near("p", 6, "a.cell_type = 2 AND b.cell_type = 2"), *sweep, recursive=True)
    hull = """pt AS (SELECT DISTINCT organoid_id, x, y FROM cells WHERE cell_type IN (2, 3)),
lo AS (SELECT organoid_id, x, min(y) AS lo, max(y) AS hi FROM pt GROUP BY ALL), ed AS (SELECT organoid_id, x, lo AS y FROM lo UNION SELECT organoid_id, x, hi FROM lo),
he AS (SELECT a.organoid_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM ed a JOIN ed b ON a.organoid_id = b.organoid_id AND (a.x, a.y) <> (b.x, b.y)
 JOIN ed c ON c.organoid_id = a.organoid_id GROUP BY ALL HAVING min((b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x)) >= 0),
hull AS (SELECT organoid_id, sum(ax * by_ - bx * ay) / 2 AS area FROM he GROUP BY ALL)"""
    add("hull_area_2d", "organoid_id:i area:d", "SELECT * FROM hull", hull)
    add("hull_summary", "experiment:s dox:i mean:d sd:d n:i sem:d", summ("experiment, dox", "area", "(SELECT * FROM hull JOIN meta USING (organoid_id))"), META, hull)
    loc = lambda src: f"st AS (SELECT organoid_id, avg(ch_546) AS m, stddev_pop(ch_546) AS sd, count(*) AS n FROM {src} GROUP BY ALL), lg AS (SELECT a.organoid_id, a.cell_id, avg(b.ch_546) AS l FROM {src} a JOIN {src} b ON a.organoid_id = b.organoid_id AND a.cell_id <> b.cell_id AND {D2} <= 36 GROUP BY ALL), lm AS (SELECT c.*, (ch_546 - m) / sd AS zz, coalesce((l - m) / sd, 0) AS lag, l, n FROM {src} c JOIN st USING (organoid_id) LEFT JOIN lg USING (organoid_id, cell_id) WHERE sd > 0)"
    add("morans_i", "organoid_id:i morans_i:d", "SELECT organoid_id, sum(zz * lag) / nullif(count(l), 0) AS morans_i FROM lm GROUP BY ALL", loc("cells"))
    addc("lisa_cluster_mean", "organoid_id:i lisa_mean:d", "SELECT organoid_id, avg((n - 1) * zz * lag / n) AS lisa_mean FROM lm WHERE cluster_id >= 0 GROUP BY ALL", loc("cl"))
    add("spatial_power", "organoid_id:i power_a:d power_b:d", "SELECT organoid_id, abs(q) / sqrt(q*q+(top-p)*(top-p)) AS power_a, abs(top - p) / sqrt(q*q+(top-p)*(top-p)) AS power_b FROM (SELECT *, (p+r+sqrt((p-r)*(p-r)+4*q*q))/2 AS top FROM (SELECT organoid_id, var_samp(u) AS p, covar_samp(u, v) AS q, var_samp(v) AS r FROM uv GROUP BY ALL))",
        f"st AS (SELECT organoid_id, avg(ch_546) m, stddev_samp(ch_546) sd, avg(ch_647) m2, stddev_samp(ch_647) sd2 FROM cells GROUP BY ALL), lg AS (SELECT a.organoid_id, a.cell_id, avg(b.ch_546) AS l, avg(b.ch_647) AS l2 FROM cells a JOIN cells b ON a.organoid_id = b.organoid_id AND a.cell_id <> b.cell_id AND {D2} <= 36 GROUP BY ALL), uv AS (SELECT organoid_id, (coalesce(l, ch_546) - m) / sd AS u, (coalesce(l2, ch_647) - m2) / sd2 AS v FROM cells JOIN st USING (organoid_id) LEFT JOIN lg USING (organoid_id, cell_id) WHERE sd > 0 AND sd2 > 0)")
    w = lambda src, v, n: f"max({v}) FILTER (cell_type = 2) AS {n}_endo, max({v}) FILTER (cell_type = 3) AS {n}_meso"
    from cellgrove.schema import FEATURES
    addc("feature_matrix", "organoid_id:i experiment:s replicate:s dox:i total_cells:i " + " ".join(f"{c}:{'i' if 'count' in c else 'd'}" for c in FEATURES[1:]),
         f"SELECT * FROM meta JOIN (SELECT organoid_id, n AS total_cells, ne / n::DOUBLE AS pct_endo, nm / n::DOUBLE AS pct_meso FROM tot) USING (organoid_id) LEFT JOIN rad USING (organoid_id) LEFT JOIN mor USING (organoid_id) LEFT JOIN (SELECT organoid_id, {w('met', 'CASE WHEN n_cells >= 4 THEN k END', 'cluster_count')}, {w('met', 'avg_size', 'cluster_size')} FROM met GROUP BY ALL) USING (organoid_id) LEFT JOIN (SELECT organoid_id, {w('intra', 'distance', 'intra')} FROM intra GROUP BY ALL) USING (organoid_id) LEFT JOIN (SELECT organoid_id, avg(min_dist) AS inter FROM lp GROUP BY ALL) USING (organoid_id) LEFT JOIN (SELECT organoid_id, minority_pct AS adjacency_pct FROM adjm WHERE n_endo > 0 AND n_meso > 0) USING (organoid_id)",
         TOT, radial, near("p2", 10), ratios.replace("FROM p WHERE", "FROM p2 WHERE"))
    add("normalize_composition", "organoid_id:i total_cells:d pct_endo:d pct_meso:d", "SELECT organoid_id, total_cells / (max(total_cells) OVER ())::DOUBLE AS total_cells, greatest(0, least(1, pct_endo)) AS pct_endo, greatest(0, least(1, pct_meso)) AS pct_meso FROM feat", FEAT)
    res = lambda c: f"{c} - avg({c}) OVER (PARTITION BY experiment, dox, replicate) + avg({c}) OVER (PARTITION BY experiment, dox) AS {c}"
    add("residualize", "organoid_id:i f1:d f2:d f3:d", f"SELECT organoid_id, {res('f1')}, {res('f2')}, {res('f3')} FROM feat", FEAT)
    imp = lambda c: f"coalesce({c}, median({c}) OVER (PARTITION BY experiment, dox)) AS {c}"
    add("impute_two_step", "organoid_id:i f1:d f2:d f3:d", "SELECT organoid_id, " + ", ".join(f"coalesce({c}, (SELECT median({c}) FROM i)) AS {c}" for c in ("f1", "f2", "f3")) + " FROM i", FEAT, f"i AS (SELECT organoid_id, {imp('f1')}, {imp('f2')}, {imp('f3')} FROM feat)")
    sep = lambda n, k: f"SELECT g.pc, '{n}' AS grouping_, any_value(vs) AS total_var, CASE WHEN any_value(t.n) < 2 THEN NULL WHEN any_value(ss) > 0 THEN sum(gn * (gm - m) * (gm - m)) / any_value(ss) ELSE 0 END AS between_ FROM (SELECT pc, {k}, avg(v) AS gm, count(*) AS gn FROM sl GROUP BY ALL) g JOIN t ON t.pc = g.pc GROUP BY g.pc"
    q["group_separation"] = f"WITH {CELLS}, {SCORE}, {SLONG}, t AS (SELECT pc, avg(v) AS m, var_samp(v) * (count(*) - 1) AS ss, count(*) AS n, var_samp(v) AS vs FROM sl GROUP BY ALL) SELECT pc, grouping_ AS \"grouping\", round(total_var, 6) + 0e0 AS total_var, round(between_, 6) + 0e0 AS \"between\" FROM (" + " UNION ALL ".join([sep("experiment", "experiment"), sep("dox", "dox"), sep("experiment_dox", "experiment, dox")]) + ")"
    stepc = [SCORE, """ct AS (SELECT experiment, dox, avg(pc1) AS pc1, avg(pc2) AS pc2, avg(pc3) AS pc3 FROM sc GROUP BY ALL),
st AS (SELECT experiment, row_number() OVER w AS step, dox::VARCHAR || '->' || (lead(dox) OVER w)::VARCHAR AS transition, sqrt(pow(lead(pc1) OVER w - pc1, 2) + pow(lead(pc2) OVER w - pc2, 2)) AS dist_2d,
 sqrt(pow(lead(pc1) OVER w - pc1, 2) + pow(lead(pc2) OVER w - pc2, 2) + pow(lead(pc3) OVER w - pc3, 2)) AS dist_all, lead(dox) OVER w AS nx FROM ct WINDOW w AS (PARTITION BY experiment ORDER BY dox))"""]
    add("consecutive_centroid_distance", "experiment:s step:i transition:s dist_2d:d dist_all:d", "SELECT * FROM st WHERE nx IS NOT NULL", *stepc)
    add("dox_step_summary", "transition:s mean_2d:d sd_2d:d mean_all:d sd_all:d n_experiments:i", "SELECT transition, avg(dist_2d) AS mean_2d, stddev_samp(dist_2d) AS sd_2d, avg(dist_all) AS mean_all, stddev_samp(dist_all) AS sd_all, count(DISTINCT experiment) AS n_experiments FROM st WHERE nx IS NOT NULL GROUP BY ALL", *stepc)
    add("trajectory_centroids", "experiment:s dox:i pc1:d pc2:d pc3:d", "SELECT * FROM ct", *stepc)
    q["axis_limits"] = f"WITH {CELLS}, {SCORE}, {SLONG} SELECT pc AS axis, round(min(v) - 0.12e0 * greatest(max(v) - min(v), 1e-6), 6) + 0e0 AS lo, round(max(v) + 0.12e0 * greatest(max(v) - min(v), 1e-6), 6) + 0e0 AS hi FROM sl GROUP BY pc"
    kw = [FEAT, FLONG, """a AS (SELECT *, count(*) OVER (PARTITION BY experiment, metric, dox) AS c FROM fl WHERE v IS NOT NULL),
b AS (SELECT *, count(*) OVER (PARTITION BY experiment, metric, v) AS ties, rank() OVER (PARTITION BY experiment, metric ORDER BY v) AS rk FROM a WHERE c >= 2),
g AS (SELECT experiment, metric, dox, sum(rk + (ties - 1) / 2e0) AS r, count(*) AS n, sum(ties * ties - 1) AS t FROM b GROUP BY ALL),
kw AS (SELECT experiment, metric, count(*) AS k, (12 / (sum(n)::DOUBLE * (sum(n) + 1)) * sum(r * r / n) - 3 * (sum(n) + 1)) / nullif(1 - sum(t) / (sum(n)::DOUBLE * sum(n) * sum(n) - sum(n)), 0) AS h FROM g GROUP BY ALL HAVING count(*) >= 2)"""]
    add("kruskal_h", "experiment:s metric:s k:i h:d", "SELECT * FROM kw", *kw)
    add("signal_ratio", "experiment:s metric:s signal:d", "SELECT experiment, metric, CASE WHEN t > 0 THEN 1 - nz / t END AS signal FROM (SELECT experiment, metric, avg(s) AS nz FROM (SELECT experiment, metric, dox, var_samp(v) AS s FROM fl GROUP BY ALL) GROUP BY ALL) JOIN (SELECT experiment, metric, var_samp(v) AS t FROM fl GROUP BY ALL) USING (experiment, metric)", FEAT, FLONG)
    add("size_ablation", "organoid_id:i f1:d", "SELECT organoid_id, ln(1 + greatest(f1, 0)) AS f1 FROM feat", FEAT)
    anch = "an AS (SELECT organoid_id, experiment, replicate, dox, pc1 - coalesce(o1, 0) AS pc1, pc2 - coalesce(o2, 0) AS pc2, pc3 - coalesce(o3, 0) AS pc3 FROM sc LEFT JOIN (SELECT experiment, avg(pc1) AS o1, avg(pc2) AS o2, avg(pc3) AS o3 FROM sc WHERE dox = 0 GROUP BY ALL) USING (experiment))"
    add("origin_anchor", "organoid_id:i pc1:d pc2:d pc3:d", "SELECT * FROM an", SCORE, anch)
    add("experiment_one_hot", "organoid_id:i experiment_id_exp1:d experiment_id_exp3:d", "SELECT organoid_id, CASE WHEN experiment = 'exp1' THEN 1e0 ELSE 0e0 END AS experiment_id_exp1, CASE WHEN experiment = 'exp3' THEN 1e0 ELSE 0e0 END AS experiment_id_exp3 FROM meta", META)
    add("poly_features", "organoid_id:i d1:d d2:d d3:d c1:d dc:d d2c:d", "SELECT organoid_id, d AS d1, d*d AS d2, d*d*d AS d3, c AS c1, d*c AS dc, d*d*c AS d2c FROM (SELECT organoid_id, log10(dox + 1e0) AS d, CASE WHEN experiment = 'exp1' THEN 2e0 ELSE 6e0 END AS c FROM meta)", META)
    folds = lambda key, kind: f"SELECT f.fold, '{kind}' AS split_type, organoid_id AS row_id, CASE WHEN {key} = f.fold THEN 'test' ELSE 'train' END AS role FROM meta, (SELECT DISTINCT {key} AS fold FROM meta) f"
    add("lor_folds", "fold:s split_type:s row_id:i role:s", folds("experiment || '::' || replicate", "LOR"), META)
    add("loex_folds", "fold:s split_type:s row_id:i role:s", folds("experiment", "LOEX"), META)
    add("holdout_fold", "fold:s split_type:s row_id:i role:s", "SELECT 'custom' AS fold, 'CUSTOM' AS split_type, organoid_id AS row_id, CASE experiment WHEN 'exp3' THEN 'test' ELSE 'train' END AS role FROM meta", META)
    by_fold = " UNION ALL ".join(f"SELECT fold, 'stand_in' AS model, 'pc{i}' AS pc, count(*) AS n, CASE WHEN count(*) >= 2 AND var_pop(pc{i}) > 0 THEN 1 - sum((pc{i}-p{i})*(pc{i}-p{i})) / (var_pop(pc{i}) * count(*)) END AS r2, sqrt(sum((pc{i}-p{i})*(pc{i}-p{i})) / count(*)) AS rmse, avg(abs(pc{i}-p{i})) AS mae FROM pr GROUP BY fold" for i in (1, 2, 3))
    add("regression_metrics", "fold:s model:s pc:s n:i r2:d rmse:d mae:d", by_fold, SCORE, PRED)
    add("fold_means", "model:s pc:s n_folds:i r2:d rmse:d mae:d", f"SELECT model, pc, count(*) AS n_folds, avg(r2) AS r2, avg(rmse) AS rmse, avg(mae) AS mae FROM ({by_fold}) GROUP BY ALL", SCORE, PRED)
    path = "SELECT 'stand_in' AS model, experiment, count(*) AS n_doses, avg(d) AS path_error, max_by(d, dox) AS endpoint_error, avg(CASE WHEN na > 1e-12 AND nb > 1e-12 THEN degrees(acos(greatest(-1, least(1, dot / (na * nb))))) END) AS angle FROM s2 GROUP BY experiment HAVING count(*) >= 2"
    moved = ["""c AS (SELECT experiment, dox, avg(pc1) a1, avg(pc2) a2, avg(pc3) a3, avg(p1) b1, avg(p2) b2, avg(p3) b3 FROM pr GROUP BY ALL),
s1 AS (SELECT experiment, dox, sqrt((a1-b1)*(a1-b1)+(a2-b2)*(a2-b2)+(a3-b3)*(a3-b3)) AS d, lead(a1) OVER w - a1 AS u1, lead(a2) OVER w - a2 AS u2, lead(a3) OVER w - a3 AS u3, lead(b1) OVER w - b1 AS v1, lead(b2) OVER w - b2 AS v2, lead(b3) OVER w - b3 AS v3 FROM c WINDOW w AS (PARTITION BY experiment ORDER BY dox)),
s2 AS (SELECT *, sqrt(u1*u1+u2*u2+u3*u3) AS na, sqrt(v1*v1+v2*v2+v3*v3) AS nb, u1*v1+u2*v2+u3*v3 AS dot FROM s1)"""]
    add("trajectory_metrics", "model:s experiment:s n_doses:i path_error:d endpoint_error:d angle:d", path, SCORE, PRED, *moved)
    add("error_summary", "experiment:s dox:i mae:d rmse:d n:i", "SELECT experiment, dox, avg(abs(pc1 - p1)) AS mae, sqrt(avg((pc1-p1)*(pc1-p1))) AS rmse, count(*) AS n FROM pr GROUP BY ALL", SCORE, PRED)
    add("dose_filter", "organoid_id:i experiment:s replicate:s dox:i", "SELECT * FROM meta WHERE dox IN (0, 100, 1000)", META)
    add("condition_order", "condition:s place:i n:i", """SELECT condition, CASE condition WHEN 'BMP4' THEN 2 WHEN 'WNT5A' THEN 3 ELSE 5 END AS place, count(*) AS n
 FROM (SELECT CASE WHEN experiment = 'exp1' THEN 'BASAL' WHEN organoid_id % 3 = 0 THEN 'BMP4' WHEN organoid_id % 3 = 1 THEN 'WNT5A' ELSE 'BASAL' END AS condition FROM meta) GROUP BY ALL""", META)
    add("bars_ci95", "experiment:s dox:i metric:s mean:d sd:d n:i sem:d low:d high:d", """SELECT *, mean - 1.96e0 * sem AS low, mean + 1.96e0 * sem AS high
 FROM (SELECT experiment, dox, metric, avg(v) AS mean, stddev_samp(v) AS sd, count(v) AS n, stddev_samp(v) / sqrt(greatest(count(v), 1)) AS sem FROM fl GROUP BY ALL)""", FEAT, FLONG)
    add("box_quartiles", "experiment:s metric:s q1:d median:d q3:d low:d high:d", """SELECT experiment, pc AS metric, q1, median, q3, min(v) AS low, max(v) AS high
 FROM sl JOIN (SELECT experiment, pc, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM sl GROUP BY ALL) b USING (experiment, pc)
 WHERE v >= q1 - 1.5e0 * (q3 - q1) AND v <= q3 + 1.5e0 * (q3 - q1) GROUP BY ALL""", SCORE, SLONG)
    q["delta_long"] = f"""SELECT organoid_id, dox, metric, value, split_part(metric, '_', -1) AS lineage, CASE WHEN contains(metric, 'abs') THEN 'absolute' ELSE 'relative' END AS type
 FROM (SELECT * FROM ({q["delta_vs_baseline"]})) UNPIVOT (value FOR metric IN (abs_pct_endo, rel_f1, rel_f3))"""
    q["sweep_summary"] = f"""SELECT 'Rep' || (floor(organoid_id / 8)::BIGINT % 3 + 1)::VARCHAR AS replicate, eps, round(avg(n_clusters), 6) + 0e0 AS mean, round(stddev_pop(n_clusters), 6) + 0e0 AS sd, count(*)::BIGINT AS n
 FROM ({q["dbscan_sweep"]}) GROUP BY ALL"""
    grid, cells_of = [], []
    for e in (4, 6):
        for m in (3, 5):
            k = f"{e}_{m}"
            grid.append(f"""gc{k} AS (SELECT organoid_id, i FROM p WHERE d2 <= {e}e0 * {e}e0 GROUP BY ALL HAVING count(*) >= {m}),
ge{k} AS (SELECT p.organoid_id, p.i, p.j FROM p JOIN gc{k} a ON a.organoid_id = p.organoid_id AND a.i = p.i JOIN gc{k} b ON b.organoid_id = p.organoid_id AND b.i = p.j WHERE d2 <= {e}e0 * {e}e0),
gr{k} AS (SELECT organoid_id, i, i AS root FROM gc{k} UNION SELECT r.organoid_id, e.j, r.root FROM gr{k} r JOIN ge{k} e ON e.organoid_id = r.organoid_id AND e.i = r.i)""")
            cells_of.append(f"""SELECT o.organoid_id, {e}e0 AS eps, {m} AS min_samples, count(DISTINCT root) AS n_clusters FROM (SELECT DISTINCT organoid_id FROM p) o
 LEFT JOIN (SELECT organoid_id, i, min(root) AS root FROM gr{k} GROUP BY ALL) USING (organoid_id) GROUP BY ALL""")
    add("dbscan_grid", "organoid_id:i eps:d min_samples:i n_clusters:i", " UNION ALL ".join(cells_of), near("p", 6, "a.cell_type = 2 AND b.cell_type = 2"), *grid, recursive=True)
    wide = "SELECT fold, split_type, model, alpha, row_id, " + ", ".join(f"max({c}) FILTER (t = {i}) AS {n}_pc{i}" for n, c in (("true", "y"), ("pred", "p")) for i in (1, 2, 3)) + " FROM pred GROUP BY ALL"
    shape = "row_id:i " + " ".join(f"{n}_pc{i}:d" for n in ("true", "pred") for i in (1, 2, 3))
    three = ("ridge_linear", "poly_ridge", "spline")
    add("ridge_predictions", f"fold:s split_type:s model:s {shape}", wide, SCORE, anch, MODEL, BOTH, *ridge(three, "SELECT DISTINCT fold, model, 1e0 AS alpha FROM gr", 34))
    grid = "SELECT DISTINCT fold, model, unnest([0.1e0, 1e0, 10e0, 100e0]) AS alpha FROM gr"
    inner = f"""tr AS (SELECT fold, row_id, count(*) OVER (PARTITION BY fold) AS n FROM fo WHERE role = 'train'),
fi AS MATERIALIZED (SELECT fold || '#' || i AS fold, 'INNER' AS split_type, row_id, CASE WHEN rank <= greatest(1, least(round_even(n * 0.2, 0), n - 1)) THEN 'test' ELSE 'train' END AS role
 FROM ({ranked("SELECT fold, row_id, n, i FROM tr, range(0, 3) r(i) WHERE n >= 5", "fold, i", 42, "fold, i, row_id", "row_id")}))"""
    errors = """er AS (SELECT fold, alpha, avg(e) AS inner_mean, coalesce(stddev_samp(e), 0) AS inner_sd FROM (SELECT regexp_replace(fold, '#[0-9]+$', '') AS fold, fold AS f, alpha, avg(e) AS e
 FROM (SELECT fold, alpha, t, sqrt(avg((y - p) * (y - p))) AS e FROM pred GROUP BY ALL) GROUP BY ALL) GROUP BY ALL),
tu AS MATERIALIZED (SELECT fold, alpha, inner_mean, inner_sd, (row_number() OVER (PARTITION BY fold ORDER BY inner_mean NULLS LAST, alpha) = 1)::INT AS selected
 FROM (SELECT DISTINCT fold, unnest([0.1e0, 1e0, 10e0, 100e0]) AS alpha FROM fo WHERE role = 'train') LEFT JOIN er USING (fold, alpha))"""
    tuning = [SCORE, anch, MODEL, BOTH, inner, *ridge(("ridge_linear",), grid, 4, "fi"), errors]
    add("random_alpha_tuning", "fold:s model:s alpha:d inner_mean:d inner_sd:d selected:i", "SELECT *, 'ridge_linear' AS model FROM tu", *tuning)
    again = ridge(("ridge_linear",), "SELECT fold, 'ridge_linear' AS model, alpha FROM tu WHERE selected = 1", 4)
    add("tuned_predictions", f"fold:s split_type:s model:s alpha:d {shape}", f"WITH {', '.join(again)} {wide}", *tuning)
    random = f"SELECT 'random_' || i AS fold, 'RANDOM' AS split_type, organoid_id AS row_id, CASE WHEN rank <= (SELECT greatest(1, round_even(count(*) * 0.2, 0)) FROM meta) THEN 'test' ELSE 'train' END AS role FROM ({ranked('SELECT organoid_id, i FROM meta, range(0, 10) r(i)', 'i', 42, 'i, organoid_id', 'organoid_id')})"
    add("random_folds", "fold:s split_type:s row_id:i role:s", random, META)
    moran = f"""st AS (SELECT organoid_id, avg(ch_546) AS m, stddev_pop(ch_546) AS sd, count(*) AS n FROM cells GROUP BY ALL),
zz AS (SELECT organoid_id, cell_id, (ch_546 - m) / sd AS z FROM cells JOIN st USING (organoid_id) WHERE n >= 2 AND sd > 0),
tn AS MATERIALIZED ({ranked("SELECT organoid_id, cell_id, z, i FROM zz, range(0, 20) r(i)", "organoid_id, i", 0, "i, cell_id", "cell_id")}),
mv AS MATERIALIZED (SELECT p.organoid_id, p.cell_id, t.i, CASE WHEN t.i = 0 THEN p.z ELSE t.z END AS z FROM tn p JOIN tn t ON t.organoid_id = p.organoid_id AND t.rank = p.rank WHERE p.i = 0),
nb AS MATERIALIZED (SELECT a.organoid_id, a.cell_id AS a, b.cell_id AS b, 1e0 / count(*) OVER (PARTITION BY a.organoid_id, a.cell_id) AS w FROM cells a JOIN cells b ON a.organoid_id = b.organoid_id AND a.cell_id <> b.cell_id AND {D2} <= 36),
si AS (SELECT nb.organoid_id, x.i, sum(w * x.z * y.z) / round(sum(w)) AS s FROM nb JOIN mv x ON x.organoid_id = nb.organoid_id AND x.cell_id = a JOIN mv y ON y.organoid_id = nb.organoid_id AND y.cell_id = b AND y.i = x.i GROUP BY ALL),
ob AS (SELECT organoid_id, s AS o FROM si WHERE i = 0),
pv AS (SELECT organoid_id, any_value(o) AS morans_i, count(*) FILTER (s >= o - 1e-9) AS above FROM si JOIN ob USING (organoid_id) WHERE i > 0 GROUP BY ALL)"""
    add("morans_p", "organoid_id:i morans_i:d p_sim:d", "SELECT st.organoid_id, morans_i, (least(above, 19 - above) + 1) / 20e0 AS p_sim FROM st LEFT JOIN pv USING (organoid_id)", moran)
    # the lower part of the distribution as a series of its own, term by term through log gamma
    tail = "CASE WHEN h <= 0 THEN 1 ELSE 1 - list_sum(list_transform(range(0, 400), lambda n: exp(((k - 1) / 2e0 + n) * ln(h / 2) - h / 2 - lgamma((k - 1) / 2e0 + n + 1)))) END"
    add("kruskal_p", "experiment:s metric:s k:i p:d", f"SELECT experiment, metric, k, {tail} AS p FROM kw", *kw)
    add("significance_stars", "experiment:s metric:s stars:s", f"SELECT experiment, metric, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars FROM (SELECT *, {tail} AS p FROM kw)", *kw)
    times = " + ".join(f"(u >= {p!r})::INT" for p in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253, 0.999998874797402, 0.9999998885745216, 0.9999999899522336, 0.9999999991683892))
    boot = f"""bt AS (SELECT experiment, dox, metric, i, sum(w * v) / nullif(sum(w), 0) AS m FROM (SELECT *, {times} AS w FROM (SELECT experiment, dox, metric, v, i, ('0x' || substr(md5(concat_ws(':', 0, i, organoid_id)), 1, 8))::BIGINT / 4294967296e0 AS u FROM fl, range(1, 201) r(i) WHERE v IS NOT NULL)) GROUP BY ALL),
bq AS (SELECT experiment, dox, metric, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM bt GROUP BY ALL)"""
    add("bootstrap_ci95", "experiment:s dox:i metric:s mean:d n:i low:d high:d", "SELECT experiment, dox, metric, avg(v) AS mean, count(v) AS n, any_value(low) AS low, any_value(high) AS high FROM fl JOIN bq USING (experiment, dox, metric) GROUP BY ALL", FEAT, FLONG, boot)
    q["dbscan_spread"] = q["dbscan_clusters"]
    near_other = f"EXISTS (SELECT 1 FROM cl b WHERE b.cluster_id >= 0 AND b.organoid_id = a.organoid_id AND b.cell_type <> a.cell_type AND {D2} <= 36)"
    addc("touched_clusters", "organoid_id:i cell_type:d cluster_id:i", f"SELECT DISTINCT organoid_id, cell_type, cluster_id FROM cl a WHERE cluster_id >= 0 AND {near_other}")
    addc("adjacency_pct", "organoid_id:i adjacency_pct:d", f"""SELECT organoid_id, 100e0 * CASE WHEN ne < nm THEN te / ne ELSE tm / nm END AS adjacency_pct FROM (SELECT organoid_id, count(*) FILTER (cell_type = 2)::DOUBLE AS ne, count(*) FILTER (cell_type = 3)::DOUBLE AS nm, count(*) FILTER (cell_type = 2 AND hit) AS te, count(*) FILTER (cell_type = 3 AND hit) AS tm
 FROM (SELECT organoid_id, cell_type, cluster_id, bool_or({near_other}) AS hit FROM cl a WHERE cluster_id >= 0 GROUP BY ALL) GROUP BY ALL) WHERE ne > 0 AND nm > 0""")
    files = "fn AS (SELECT organoid_id, CASE WHEN organoid_id % 2 = 0 THEN 'exp3_Bmp4_set' ELSE 'exp1_set' END AS folder, [0, 10, 25, 50, 100, 250, 500, 1000][organoid_id % 8 + 1]::VARCHAR || 'dox_' || CASE WHEN organoid_id % 3 = 0 THEN 'BMP4' ELSE 'GATA' END || '_' || organoid_id::VARCHAR || '.csv' AS file FROM meta)"
    add("name_filter", "organoid_id:i folder:s file:s", "SELECT * FROM fn WHERE file LIKE '%0dox%' OR file LIKE '%10dox%'", META, files)
    add("condition_key", "organoid_id:i condition:s", "SELECT organoid_id, array_to_string(string_split(replace(file, '.csv', ''), '_')[1:CASE WHEN upper(folder) LIKE '%BMP4%' OR upper(folder) LIKE '%WNT%' THEN 2 ELSE 1 END], '_') AS condition FROM fn", META, files)
    signal = "sg AS (SELECT experiment, metric, CASE WHEN t > 0 THEN 1 - nz / t END AS signal FROM (SELECT experiment, metric, avg(s) AS nz FROM (SELECT experiment, metric, dox, var_samp(v) AS s FROM fl GROUP BY ALL) GROUP BY ALL) JOIN (SELECT experiment, metric, var_samp(v) AS t FROM fl GROUP BY ALL) USING (experiment, metric))"
    add("feature_significance", "experiment:s metric:s k:i h:d p:d stars:s signal:d p_place:i signal_place:i", f"""SELECT *, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars, row_number() OVER (PARTITION BY experiment ORDER BY p NULLS LAST, metric) AS p_place,
 dense_rank() OVER (ORDER BY ms NULLS LAST, metric) AS signal_place FROM (SELECT *, {tail} AS p, avg(signal) OVER (PARTITION BY metric) AS ms FROM kw LEFT JOIN sg USING (experiment, metric))""", *kw, signal)
    add("axis_break", "top_mean:d top:d broken:i", "SELECT max(m) AS top_mean, max(v) AS top, (max(m) > 24)::INT AS broken FROM (SELECT avg(f1) AS m, max(f1) AS v FROM feat GROUP BY experiment, dox)", FEAT)
    add("missing_experiments", "experiment:s", "SELECT unnest(['exp1', 'exp2', 'exp3', 'exp9']) AS experiment EXCEPT SELECT experiment FROM meta", META)
    whole = by_fold.replace("SELECT fold, ", "SELECT ").replace("'stand_in' AS model", "'stand_in' AS model, any_value(fold) AS f").replace(" GROUP BY fold", "")
    report = f"SELECT model, pc, r2, rmse, mae, NULL::DOUBLE AS angle FROM ({whole}) UNION ALL SELECT model, 'TRAJECTORY', NULL, avg(path_error), avg(endpoint_error), avg(angle) FROM ({path}) GROUP BY model"
    add("holdout_report", "model:s pc:s r2:d rmse:d mae:d angle:d", report, SCORE, PRED, *moved)
    fnv = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(length(n)), lambda i: ascii(n[i + 1])::BIGINT)), lambda h, b: xor(h, b) * 16777619 % 4294967296)"
    q["fnv1a_seed"] = f"WITH {CELLS}, {META} SELECT organoid_id::BIGINT AS organoid_id, (({fnv} + 42) % 4294967296)::BIGINT AS seed FROM (SELECT organoid_id, 'organoid_' || organoid_id::VARCHAR AS n FROM meta)"
    # slabs: upper and lower chains of the hull, as edges that no point of theirs is beyond
    edge = lambda p, sign: f"(SELECT organoid_id, zc, sum((bx - ax) * (ay + by_) / 2) AS s FROM (SELECT a.organoid_id, a.zc, a.x AS ax, a.{p} AS ay, b.x AS bx, b.{p} AS by_ FROM col a JOIN col b ON a.organoid_id = b.organoid_id AND a.zc = b.zc AND a.x < b.x JOIN col c ON c.organoid_id = a.organoid_id AND c.zc = a.zc GROUP BY ALL HAVING min({sign} * ((b.x - a.x) * (c.{p} - a.{p}) - (b.{p} - a.{p}) * (c.x - a.x))) >= 0) GROUP BY ALL)"
    slabs = f"""ln AS (SELECT organoid_id, x, y, z FROM cells WHERE cell_type IN (2, 3)), zs AS (SELECT DISTINCT organoid_id, z AS zc FROM ln),
col AS MATERIALIZED (SELECT ln.organoid_id, zc, x, min(y) AS lo, max(y) AS hi FROM ln JOIN zs ON zs.organoid_id = ln.organoid_id AND z BETWEEN zc - 5 AND zc + 5 GROUP BY ALL),
sa AS (SELECT organoid_id, zc, u.s - l.s AS area FROM {edge('hi', '-1')} u JOIN {edge('lo', '1')} l USING (organoid_id, zc))"""
    add("max_biopsy_area", "organoid_id:i z_center:d area:d", "SELECT organoid_id, zc AS z_center, area FROM (SELECT *, row_number() OVER (PARTITION BY organoid_id ORDER BY area DESC, zc) AS r FROM sa WHERE area > 1e-9) WHERE r = 1", slabs)
    # the sample whose removal leaves the least mean variance goes, round by round
    without = lambda c: f"((sum({c} * {c}) OVER w - {c} * {c}) - pow(sum({c}) OVER w - {c}, 2) / (count(*) OVER w - 1)) / (count(*) OVER w - 2)"
    prune = f"""rd AS (SELECT 0 AS step, experiment || '_' || dox::VARCHAR AS g, organoid_id, pct_endo, pct_meso FROM feat
 UNION ALL SELECT step + 1, g, organoid_id, pct_endo, pct_meso FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY v, organoid_id) AS r FROM (
  SELECT *, ({without('pct_endo')} + {without('pct_meso')}) / 2 AS v, count(*) OVER w AS n FROM rd WINDOW w AS (PARTITION BY g)) WHERE n > 3) WHERE r > 1),
la AS (SELECT g, organoid_id, max(step) AS last FROM rd GROUP BY ALL)"""
    q["prune_samples"] = f"WITH RECURSIVE {CELLS}, {FEAT}, {prune} SELECT g AS \"group\", organoid_id::BIGINT AS organoid_id, (last + 1)::BIGINT AS step FROM la WHERE last < (SELECT max(last) FROM la b WHERE b.g = la.g)"
    names = ["total_cells", "pct_endo", "pct_meso", "f1", "f2", "f3"]
    raw = [f"{c} - avg({c}) OVER (PARTITION BY experiment, dox, replicate) + avg({c}) OVER (PARTITION BY experiment, dox) AS {c}" for c in names]
    near_dose = [f"coalesce({c}, median({c}) OVER (PARTITION BY experiment, dox)) AS {c}" for c in names]
    rest = [f"coalesce({c}, (SELECT median({c}) FROM p2)) AS {c}" for c in names]
    keys = "organoid_id, experiment, replicate, dox"
    listed = "[" + ", ".join(names) + "]"
    product = "list_transform(range(36), lambda i: list_sum(list_transform(range(6), lambda k: m[6 * (i // 6) + k + 1] * m[6 * k + i % 6 + 1])))"
    trace = lambda m: " + ".join(f"{m}[{7 * i + 1}]" for i in range(6))
    pca = [FEAT, f"""p0 AS (SELECT {keys}, total_cells / (max(total_cells) OVER ())::DOUBLE AS total_cells, greatest(0, least(1, pct_endo)) AS pct_endo, greatest(0, least(1, pct_meso)) AS pct_meso, f1, f2, f3 FROM feat),
p1 AS (SELECT {keys}, {', '.join(raw)} FROM p0), p2 AS (SELECT {keys}, {', '.join(near_dose)} FROM p1), p3 AS MATERIALIZED (SELECT {keys}, {', '.join(rest)} FROM p2),
ce AS (SELECT unnest(range(1, 7)) AS j, unnest({listed}) AS v, experiment, dox FROM (SELECT experiment, dox, {', '.join(f'avg({c}) AS {c}' for c in names)} FROM p3 GROUP BY ALL)),
ms AS MATERIALIZED (SELECT j, avg(v) AS m, coalesce(nullif(stddev_pop(v), 0), 1) AS s, count(*) AS n FROM ce GROUP BY j),
zc AS (SELECT experiment, dox, j, (v - m) / s AS z, n FROM ce JOIN ms USING (j)),
d1 AS MATERIALIZED (SELECT list(v ORDER BY i, j) AS d FROM (SELECT a.j AS i, b.j, sum(a.z * b.z) / (any_value(a.n) - 1) AS v FROM zc a JOIN zc b USING (experiment, dox) GROUP BY a.j, b.j))"""]
    for c in range(1, 6):  # the matrix, squared until it is the projector on its first axis; then without that axis
        pca.append(f"""w{c} AS (SELECT 0 AS k, list_transform(d, lambda x: x / ({trace('d')})) AS m FROM d{c} UNION ALL SELECT k + 1, list_transform(m, lambda x: x / ({trace('m')})) AS m FROM (SELECT k, {product} AS m FROM w{c} WHERE k < 44)),
e{c} AS MATERIALIZED (SELECT m, d, list_sum(list_transform(range(1, 37), lambda i: m[i] * d[i])) AS value, list_transform(range(6), lambda i: m[7 * i + 1]) AS g FROM w{c}, d{c} WHERE k = 44),
d{c + 1} AS MATERIALIZED (SELECT list_transform(range(1, 37), lambda i: d[i] - value * m[i]) AS d FROM e{c})""")
    pca.append("ev AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {c} AS c, value, list_transform(range(6), lambda i: m[6 * (list_position(g, list_max(g)) - 1) + i + 1] / sqrt(list_max(g))) AS v FROM e{c}" for c in range(1, 6)) + "), tr AS (SELECT " + trace("d") + " AS t FROM d1)")
    pca.append(f"""lo AS MATERIALIZED (SELECT *, {names}[j] AS feature FROM (SELECT c, unnest(range(1, 7)) AS j, unnest(v) AS loading FROM ev)),
pl AS (SELECT {keys}, unnest(range(1, 7)) AS j, unnest({listed}) AS x FROM p3),
sr AS MATERIALIZED (SELECT {keys}, c, sum((x - m) / s * loading) AS y FROM pl JOIN ms USING (j) JOIN lo USING (j) GROUP BY ALL),
bk AS MATERIALIZED (SELECT organoid_id, j, any_value(feature) AS feature, sum(y * loading) * any_value(s) + any_value(m) AS x FROM sr JOIN lo USING (c) JOIN ms USING (j) GROUP BY organoid_id, j)""")
    col = lambda src, key, names_: ", ".join(f"max({src}) FILTER ({key} = {i}) AS {x}" for i, x in enumerate(names_, 1))
    fives = [f"pc{i}" for i in range(1, 6)]
    add("pca_scores", "organoid_id:i experiment:s replicate:s dox:i " + " ".join(f"{x}:d" for x in fives), f"SELECT {keys}, {col('y', 'c', fives)} FROM sr GROUP BY ALL", *pca, recursive=True)
    add("pca_variance", "pc:s ratio:d cumulative:d", "SELECT 'pc' || c AS pc, value / t AS ratio, sum(value / t) OVER (ORDER BY c) AS cumulative FROM ev, tr", *pca, recursive=True)
    add("pca_loadings", "feature:s pc:s loading:d", "SELECT feature, 'pc' || c AS pc, loading FROM lo", *pca, recursive=True)
    add("top_loadings", "feature:s pc:s loading:d place:i", "SELECT * FROM (SELECT feature, 'pc' || c AS pc, loading, row_number() OVER (PARTITION BY c ORDER BY abs(loading) DESC, feature) AS place FROM lo) WHERE place <= 3", *pca, recursive=True)
    add("reconstruct_features", "organoid_id:i " + " ".join(f"{x}:d" for x in names), f"SELECT organoid_id, {col('x', 'j', names)} FROM bk GROUP BY ALL", *pca, recursive=True)
    place = "CASE feature WHEN 'pct_endo' THEN 1 WHEN 'pct_meso' THEN 2 WHEN 'f3' THEN 3 WHEN 'f1' THEN 4 END"
    q["loading_order"] = f"WITH RECURSIVE {', '.join([CELLS, *pca])} SELECT feature, 'pc' || c AS pc, round(loading, 6) + 0e0 AS loading, CASE WHEN {place} <= 2 THEN 'composition' WHEN {place} <= 4 THEN 'shape' ELSE 'other' END AS \"group\", (row_number() OVER (PARTITION BY c ORDER BY {place} NULLS LAST, feature))::BIGINT AS place FROM lo"
    add("feature_errors", "feature:s mae:d rmse:d n:i", "SELECT feature, avg(abs(bk.x - pl.x)) AS mae, sqrt(avg((bk.x - pl.x) * (bk.x - pl.x))) AS rmse, count(*) AS n FROM bk JOIN pl USING (organoid_id, j) WHERE j >= 4 GROUP BY feature", *pca, recursive=True)
    pairs = near("p", 6, "a.cell_type = b.cell_type AND a.cell_type IN (2, 3)")
    untyped = clusters().replace(pairs, near("p", 6).replace("a.cell_type AS s", "0e0 AS s")).replace(" WHERE k.cell_type IN (2, 3)", "")
    add("dbscan_all_cells", "organoid_id:i cell_id:i cluster_id:i", "SELECT * FROM cl", META, untyped, recursive=True)
    add("lambda_lookup", "organoid_id:i cn_lambda:d", "SELECT organoid_id, CASE experiment WHEN 'exp1' THEN 2.5e0 END AS cn_lambda FROM meta", META)
    return q
