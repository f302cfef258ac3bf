"""DuckDB SQL for the catalogue's queries, written independently of the operators."""

from __future__ import annotations

MOVIE = "m AS (SELECT vec_id AS frame, (i // 8)::INT AS height, (i % 8)::INT AS width, embedding[i + 1]::DOUBLE AS value FROM embeddings, (SELECT unnest(range(64)) AS i))"
TRACES = "t AS (SELECT vec_id AS unit_id, i AS frame, embedding[i + 1]::DOUBLE AS value FROM embeddings, (SELECT unnest(range(64)) AS i))"
FOOT = "a AS (SELECT label AS session, vec_id AS unit_id, (i // 8)::INT AS height, (i % 8)::INT AS width, embedding[i + 1]::DOUBLE AS value FROM embeddings, (SELECT unnest(range(64)) AS i) WHERE embedding[i + 1] > 0)"
POINTS = FOOT + ", p AS (SELECT session, unit_id, sum(height * value) / sum(value) / 8 * 7 AS height, sum(width * value) / sum(value) / 8 * 7 AS width FROM a GROUP BY ALL)"
SEEDS = "s AS (SELECT i AS id, (i // 8)::INT AS height, (i % 8)::INT AS width FROM (SELECT unnest(range(0, 64, 3)) AS i))"
#: Offsets of a 3 x 3 box and of disks of radius 1 and 2.
BOX = "o AS (SELECT a.d AS dy, b.d AS dx FROM (SELECT unnest([-1, 0, 1]) AS d) a, (SELECT unnest([-1, 0, 1]) AS d) b)"
DISK1 = "o AS (SELECT a.d AS dy, b.d AS dx FROM (SELECT unnest([-1, 0, 1]) AS d) a, (SELECT unnest([-1, 0, 1]) AS d) b WHERE a.d * a.d + b.d * b.d <= 1)"
PAIRS = "q AS (SELECT x.session AS session_a, x.unit_id AS unit_a, y.session AS session_b, y.unit_id AS unit_b, sqrt((x.height - y.height) * (x.height - y.height) + (x.width - y.width) * (x.width - y.width)) AS distance FROM p x JOIN p y ON x.session < y.session)"


def R(x: str = "value", digits: int = 6, name: str | None = None) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name or x}"


def W(*parts: str) -> str:
    *ctes, body = parts
    return "WITH " + ", ".join(ctes) + " " + body


CELL = "frame, height, width"


def _neighbours(border: str) -> str:
    """n: each pixel's 3 x 3 neighbours, by how the border is continued."""
    place = {
        "reflect": lambda v, d: f"CASE WHEN {v} + {d} < 0 THEN -1 - ({v} + {d}) WHEN {v} + {d} > 7 THEN 15 - ({v} + {d}) ELSE {v} + {d} END",
        "mirror": lambda v, d: f"CASE WHEN {v} + {d} < 0 THEN -({v} + {d}) WHEN {v} + {d} > 7 THEN 14 - ({v} + {d}) ELSE {v} + {d} END",
        "edge": lambda v, d: f"least(greatest({v} + {d}, 0), 7)",
        "none": lambda v, d: f"{v} + {d}",
    }[border]
    return f"n AS (SELECT m.frame, m.height, m.width, m.value AS own, o.dy, o.dx, k.value FROM m, o JOIN m k ON k.frame = m.frame AND k.height = {place('m.height', 'o.dy')} AND k.width = {place('m.width', 'o.dx')})"


def _morph(kind: str) -> str:
    return W(MOVIE, DISK1, _neighbours("none"), f"SELECT {CELL}, {R(f'{kind}(value)', name='value')} FROM n GROUP BY {CELL}")


def _stripe(still: str, by: str) -> str:
    return W(MOVIE, still, f"SELECT m.frame, m.height, m.width, {R('m.value - st.v', name='value')} FROM m JOIN st USING ({by})")


def _extreme(kind: str) -> str:
    return W(MOVIE, DISK1, _neighbours("none"), f"SELECT {CELL}, (first(own) = {kind}(value) AND max(value) - min(value) > 0.1)::INT AS value FROM n GROUP BY {CELL}")


def _diffused(source: str, name: str) -> str:
    """One explicit step of diffusion with conduction exp(-(d / 0.3)^2), a tenth of the flow."""
    return f"{name} AS (SELECT k.frame, k.height, k.width, any_value(k.value) + 0.1::DOUBLE * sum((q.value - k.value) * exp(-power((q.value - k.value) / 0.3::DOUBLE, 2))) AS value FROM {source} k JOIN {source} q ON q.frame = k.frame AND abs(q.height - k.height) + abs(q.width - k.width) = 1 GROUP BY k.frame, k.height, k.width)"


#: Power spectrum of each trace: bins 0 to 32.
POWER = TRACES + """, f AS (SELECT unnest(range(33)) AS k), w AS (
  SELECT unit_id, k, (power(sum(value * cos(2 * pi() * k * frame / 64)), 2) + power(sum(value * sin(2 * pi() * k * frame / 64)), 2)) / 64 AS pw FROM t, f GROUP BY unit_id, k)"""


def _noise(expr: str) -> str:
    return W(POWER, f"SELECT unit_id, {R(expr, name='sn')} FROM w WHERE k >= 16 AND k < 32 GROUP BY unit_id")


def _fft(low: int, high: int) -> str:
    """Circular convolution with the kernel of the bins low to high."""
    kernel = f"""d AS (SELECT n, sum((CASE WHEN j = 0 OR j = 32 THEN 1 ELSE 2 END) * cos(2 * pi() * j * n / 64)) / 64 AS v
      FROM (SELECT unnest(range(64)) AS n), (SELECT unnest(range({low}, {high})) AS j) GROUP BY n)"""
    return f"{TRACES}, {kernel}, y AS (SELECT t.unit_id, x.frame, sum(t.value * d.v) AS value FROM t, (SELECT unnest(range(64)) AS frame) x JOIN d ON d.n = (x.frame - t.frame + 64) % 64 GROUP BY t.unit_id, x.frame)"


RANKS = """SELECT unit_id, {body} FROM z GROUP BY unit_id"""

COMPONENTS = """u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
 reach(node, root) AS (SELECT a, a FROM u UNION SELECT u.b, reach.root FROM reach JOIN u ON u.a = reach.node),
 lab AS (SELECT node, min(root) AS label FROM reach GROUP BY node)"""

#: Product of footprints and traces.
PRODUCT = "ac AS (SELECT frame, height, width, sum(a.value * t.value) AS value FROM a JOIN t USING (unit_id) GROUP BY ALL)"


def _roll(source: str, radii: str, diff: float) -> str:
    """rolled(g, height, width): of images (g, height, width, value), the middles of touching groups of local maxima at any radius. Within WITH RECURSIVE."""
    return f"""ro AS (SELECT k, x.d AS dy, y.d AS dx FROM (SELECT unnest({radii}) AS k), (SELECT unnest(range(-4, 5)) AS d) x, (SELECT unnest(range(-4, 5)) AS d) y WHERE x.d * x.d + y.d * y.d <= k * k),
 rx AS (SELECT p.g, p.height, p.width, ro.k, any_value(p.value) AS own, max(q.value) AS hi, min(q.value) AS lo FROM {source} p, ro JOIN {source} q ON q.g = p.g AND q.height = p.height + ro.dy AND q.width = p.width + ro.dx GROUP BY p.g, p.height, p.width, ro.k),
 rf AS (SELECT DISTINCT g, height, width, height * 8 + width AS i FROM rx WHERE own = hi AND hi - lo > {diff}::DOUBLE),
 re AS (SELECT x.g, x.i AS a, y.i AS b FROM rf x JOIN rf y ON x.g = y.g AND abs(x.height - y.height) <= 1 AND abs(x.width - y.width) <= 1),
 rr(g, node, root) AS (SELECT g, i, i FROM rf UNION SELECT re.g, re.b, rr.root FROM rr JOIN re ON re.g = rr.g AND re.a = rr.node),
 rl AS (SELECT g, node, min(root) AS root FROM rr GROUP BY ALL),
 rolled AS (SELECT DISTINCT rl.g, floor(median(rf.height))::INT AS height, floor(median(rf.width))::INT AS width FROM rl JOIN rf ON rf.g = rl.g AND rf.i = rl.node GROUP BY rl.g, rl.root)"""


_WINDOWS = "z AS (SELECT count(*) AS n, ceil(count(*) / 40.0)::INT + 1 AS c FROM embeddings), w AS (SELECT i AS sample, greatest(0, floor(i * (n - 1)::DOUBLE / (c - 1) - 50)) AS lo, ceil(i * (n - 1)::DOUBLE / (c - 1) + 50) AS hi FROM z, (SELECT unnest(range(0, 100000)) AS i) WHERE i < c), wp AS (SELECT sample::INT AS g, height, width, max(value) AS value FROM w JOIN m ON frame >= lo AND frame < hi GROUP BY sample, height, width)"



def _mapping(mode: str) -> str:
    """Final long mapping r(mapping, session, unit_id): nodes as session * 1e9 + unit."""
    keep = "rivals > 1" + (" AND NOT (deg = top AND n_top = 1)" if mode == "majority" else "")
    return f"""{POINTS}, {PAIRS}, q2 AS (SELECT * FROM q WHERE distance < 0.04),
 ra AS (SELECT *, row_number() OVER (PARTITION BY session_a, session_b, unit_a ORDER BY distance, unit_b) AS na, row_number() OVER (PARTITION BY session_a, session_b, unit_b ORDER BY distance, unit_a) AS nb FROM q2),
 e0 AS (SELECT session_a * 1000000000::BIGINT + unit_a AS src, session_b * 1000000000::BIGINT + unit_b AS dst FROM ra WHERE na = 1 AND nb = 1),
 u0 AS (SELECT src AS a, dst AS b FROM e0 UNION SELECT dst, src FROM e0),
 reach0(node, root) AS (SELECT a, a FROM u0 UNION SELECT u0.b, reach0.root FROM reach0 JOIN u0 ON u0.a = reach0.node),
 lab0 AS (SELECT node, min(root) AS label, node // 1000000000 AS session FROM reach0 GROUP BY node),
 deg0 AS (SELECT a AS node, count(DISTINCT b) AS deg FROM u0 GROUP BY a),
 riv AS (SELECT label, session, node, deg, count(*) OVER w AS rivals, max(deg) OVER w AS top FROM lab0 JOIN deg0 USING (node) WINDOW w AS (PARTITION BY label, session)),
 riv2 AS (SELECT *, count(*) FILTER (WHERE deg = top) OVER (PARTITION BY label, session) AS n_top FROM riv),
 gone AS (SELECT node FROM riv2 WHERE {keep}),
 e AS (SELECT * FROM e0 WHERE src NOT IN (SELECT node FROM gone) AND dst NOT IN (SELECT node FROM gone)), {COMPONENTS},
 r AS (SELECT label, node // 1000000000 AS session, node % 1000000000 AS unit_id FROM lab)"""


_NAME = "lpad(({0} // 1000000000)::VARCHAR, 4, '0') || ':' || lpad(({0} % 1000000000)::VARCHAR, 8, '0')"
_FILLED = "g AS (SELECT label, session, unit_id FROM r UNION ALL SELECT session * 1000000000::BIGINT + unit_id, session, unit_id FROM p WHERE (session, unit_id) NOT IN (SELECT session::INT, unit_id FROM r))"


def _resolved(mode: str) -> str:
    return f"WITH RECURSIVE {_mapping(mode)} SELECT {_NAME.format('label')} AS mapping, session, unit_id FROM r"


_MAXP = "h AS (SELECT height, width, max(value) AS v FROM m GROUP BY ALL), hl AS (SELECT min(v) AS lo, max(v) AS hi FROM h), bins AS (SELECT least(floor((v - lo) / ((hi - lo) / 6)), 5)::INT AS b, count(*) AS n FROM h, hl GROUP BY 1), th AS (SELECT lo + (hi - lo) * b / 6 AS thres FROM bins, hl ORDER BY n DESC, b LIMIT 1), mi AS (SELECT s.id, s.height, s.width, h.v > th.thres AS mask_int FROM s JOIN h USING (height, width), th)"
_PIX = "z AS (SELECT height, width, frame, value - avg(value) OVER w AS v FROM m WINDOW w AS (PARTITION BY height, width)), zn AS (SELECT height, width, sqrt(sum(v * v)) AS l FROM z GROUP BY ALL)"

SQL: dict[str, str] = {
    "sel_range": W(MOVIE, f"SELECT {CELL}, {R()} FROM m WHERE frame BETWEEN 10 AND 40"),
    "sel_points": W(MOVIE, SEEDS, f"SELECT {CELL}, {R()} FROM m JOIN s USING (height, width)"),
    "mask_semi": W(TRACES, f"SELECT unit_id, frame, {R()} FROM t WHERE unit_id IN (SELECT unit_id FROM t GROUP BY unit_id HAVING max(value) > 0.3)"),
    "stride_subset": W(MOVIE, f"SELECT {CELL}, {R()} FROM m WHERE frame % 7 = 0"),
    "take_index": W(MOVIE, f"SELECT pos, {CELL}, {R()} FROM m JOIN (VALUES (0, 5), (1, 3), (2, 5), (3, 11)) v(pos, frame) USING (frame)"),
    "where_fill": W(MOVIE, f"SELECT {CELL}, {R('CASE WHEN value > 0.05 THEN value ELSE -1 END', name='value')} FROM m"),
    "crop_to_mask": W(MOVIE, "k AS (SELECT min(height) a, max(height) b, min(width) c, max(width) d FROM m WHERE value > 0.15)", f"SELECT {CELL}, {R()} FROM m, k WHERE height BETWEEN a AND b AND width BETWEEN c AND d"),
    "fill_drop": W(MOVIE, f"SELECT {CELL}, {R('CASE WHEN value > 0.1 THEN value ELSE 0 END', name='value')} FROM (SELECT *, max(value) OVER (PARTITION BY frame * 8 + height) AS top FROM m) WHERE top > 0.1"),
    "clip": W(MOVIE, f"SELECT {CELL}, {R('least(greatest(value, -0.1), 0.1)', name='value')} FROM m"),
    "stack_unstack": W(MOVIE, f"SELECT {CELL}, {R()} FROM m"),
    "frames_to_traces": W(MOVIE, "SELECT height, width, count(*)::INT AS n, round(arg_min(value, frame), 6) AS first, round(arg_max(value, frame), 6) AS last FROM m GROUP BY height, width"),
    "align_arith": W(MOVIE, f"SELECT {CELL}, {R('value - mean', name='value')} FROM m JOIN (SELECT height, width, avg(value) AS mean FROM m GROUP BY ALL) USING (height, width)"),
    "reindex_like": W(MOVIE, f"SELECT {CELL}, {R('CASE WHEN value > 0 THEN value END', name='value')} FROM m"),
    "isin_between": W(MOVIE, f"SELECT {CELL}, {R()} FROM m WHERE height IN (1, 3, 5) AND width BETWEEN 2 AND 4"),
    "open_merge": W(MOVIE, f"SELECT {CELL}, {R('CASE WHEN value > -0.1 THEN value END', name='a')}, {R('CASE WHEN value < 0.1 THEN value END', name='b')} FROM m"),
    "open_multi": W(FOOT, "SELECT 'animal0' AS animal, 'session' || session AS session, count(*) AS n, round(sum(value), 4) AS total FROM a GROUP BY ALL"),
    "concat_dims": W(MOVIE, f"SELECT 'a' AS animal, k AS session, {CELL}, {R('CASE k WHEN 1 THEN value ELSE -value END', name='value')} FROM m, (SELECT unnest([1, 2]) AS k)"),
    "save_reload": W(MOVIE, f"SELECT {CELL}, {R()} FROM m"),
    "meta_coords": W(MOVIE, f"SELECT {CELL}, {R()}, 'm0' AS animal, 's1' AS session FROM m"),
    "normalize_u8": W(MOVIE, f"SELECT {CELL}, floor((value - lo) / (hi - lo) * 255.0)::INT AS value FROM m, (SELECT min(value) lo, max(value) hi FROM m)"),
    "mosaic_residual": W(MOVIE, FOOT, TRACES, PRODUCT, "k AS (SELECT 255 / max(value) * 1.5 AS k FROM m)", f"SELECT {CELL}, {R('m.value * k', 4, 'value')} FROM m, k UNION ALL SELECT frame, height, width + 8, {R('(m.value - coalesce(ac.value, 0)) * k', 4, 'value')} FROM m LEFT JOIN ac USING (frame, height, width), k"),
    "export_long": W(MOVIE, f"SELECT {CELL}, {R()} FROM m"),
    "bg_uniform": W(MOVIE, BOX, _neighbours("reflect"), f"SELECT {CELL}, {R('first(own) - avg(value)', name='value')} FROM n GROUP BY {CELL}"),
    "bg_tophat": W(MOVIE, DISK1, _neighbours("none"), f"er AS (SELECT {CELL}, min(value) AS v, first(own) AS own FROM n GROUP BY {CELL})", f"SELECT er.frame, er.height, er.width, {R('first(er.own) - max(k.v)', name='value')} FROM er, o JOIN er k ON k.frame = er.frame AND k.height = er.height + o.dy AND k.width = er.width + o.dx GROUP BY er.frame, er.height, er.width"),
    "stripe_mean": _stripe("st AS (SELECT width, avg(v) AS v FROM (SELECT height, width, avg(value) AS v FROM m GROUP BY ALL) GROUP BY width)", "width"),
    "stripe_max": _stripe("st AS (SELECT width, avg(v) AS v FROM (SELECT height, width, max(value) AS v FROM m GROUP BY ALL) GROUP BY width)", "width"),
    "stripe_perframe": _stripe("st AS (SELECT frame, width, avg(value) AS v FROM m GROUP BY ALL)", "frame, width"),
    "denoise_median": W(MOVIE, BOX, _neighbours("edge"), f"SELECT {CELL}, {R('median(value)', name='value')} FROM n GROUP BY {CELL}"),
    "denoise_gaussian": W(MOVIE, BOX, _neighbours("mirror"), f"SELECT {CELL}, {R('sum(value * exp(-(dy * dy + dx * dx) / 2.0::DOUBLE)) / sum(exp(-(dy * dy + dx * dx) / 2.0::DOUBLE))', name='value')} FROM n GROUP BY {CELL}"),
    "denoise_bilateral": W(MOVIE, DISK1, _neighbours("mirror"), "g AS (SELECT *, exp(-(dy * dy + dx * dx) / (2 * 1.5::DOUBLE * 1.5::DOUBLE) - (value - own) * (value - own) / (2 * 0.2::DOUBLE * 0.2::DOUBLE)) AS w FROM n)", f"SELECT {CELL}, {R('sum(w * value) / sum(w)', name='value')} FROM g GROUP BY {CELL}"),
    "denoise_anisotropic": W(MOVIE, *[_diffused(a, b) for a, b in (("m", "s1"), ("s1", "s2"), ("s2", "s3"))], f"SELECT {CELL}, {R()} FROM s3"),
    "glow_removal": W(MOVIE, f"SELECT {CELL}, {R('value - min(value) OVER (PARTITION BY height, width)', name='value')} FROM m"),
    "coarsen_mean": W(MOVIE, f"SELECT min(frame) AS frame, min(height) AS height, width, {R('avg(value)', name='value')} FROM m GROUP BY frame // 3, height // 2, width HAVING count(*) = 6"),
    "local_extreme_max": _extreme("max"),
    "local_extreme_min": _extreme("min"),
    "adaptive_mask": W(MOVIE, BOX, _neighbours("edge"), f"SELECT {CELL}, (first(own) > avg(value) + 0.05::DOUBLE)::INT AS value FROM n GROUP BY {CELL}"),
    "dilate": _morph("max"),
    "erode": _morph("min"),
    "label_image": f"""WITH RECURSIVE {MOVIE}, k AS (SELECT frame, height * 8 + width AS i FROM m WHERE value > 0.08),
 e AS (SELECT x.frame, x.i AS a, y.i AS b FROM k x JOIN k y ON x.frame = y.frame AND ((y.i = x.i + 8 OR y.i = x.i - 8) OR (x.i // 8 = y.i // 8 AND abs(x.i - y.i) = 1))),
 reach(frame, node, root) AS (SELECT frame, i, i FROM k UNION SELECT e.frame, e.b, r.root FROM reach r JOIN e ON e.frame = r.frame AND e.a = r.node),
 lab AS (SELECT frame, node, min(root) AS first FROM reach GROUP BY ALL) SELECT frame, first, count(*) AS area FROM lab GROUP BY ALL""",
    "minmax_norm": W(MOVIE, f"SELECT {CELL}, {R('(value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w)', name='value')} FROM m WINDOW w AS (PARTITION BY frame)"),
    "xcorr_shift": W(
        MOVIE,
        "x AS (SELECT a.frame, (a.height - b.height + 8) % 8 AS dy, (a.width - b.width + 8) % 8 AS dx, sum(a.value * b.value) AS c FROM m a JOIN m b ON b.frame = a.frame + 1 GROUP BY ALL)",
        "pk AS (SELECT frame, arg_max(dy, c) AS py, arg_max(dx, c) AS px, max(c) AS c0 FROM x GROUP BY frame)",
        "nb AS (SELECT pk.*, a.c AS up, b.c AS dn, l.c AS lf, r.c AS rt FROM pk JOIN x a ON a.frame = pk.frame AND a.dy = (py + 7) % 8 AND a.dx = px JOIN x b ON b.frame = pk.frame AND b.dy = (py + 1) % 8 AND b.dx = px JOIN x l ON l.frame = pk.frame AND l.dy = py AND l.dx = (px + 7) % 8 JOIN x r ON r.frame = pk.frame AND r.dy = py AND r.dx = (px + 1) % 8)",
        "loc AS (SELECT frame, py + 0.5 * (up - dn) / (up - 2 * c0 + dn) AS y, px + 0.5 * (lf - rt) / (lf - 2 * c0 + rt) AS x FROM nb)",
        f"SELECT frame, {R('CASE WHEN y > 4 THEN y - 8 ELSE y END', 4, 'dy')}, {R('CASE WHEN x > 4 THEN x - 8 ELSE x END', 4, 'dx')} FROM loc",
    ),
    "apply_shifts": W(MOVIE, "v AS MATERIALIZED (SELECT vec_id AS frame, (vec_id % 5 - 2)::INT AS dy, round_even(vec_id % 3 - 1 - 0.5, 0)::INT AS dx FROM embeddings)", "k AS MATERIALIZED (SELECT frame, height + dy AS height, width + dx AS width, value FROM m JOIN v USING (frame))", f"SELECT {CELL}, {R('k.value', name='value')} FROM m LEFT JOIN k USING (frame, height, width)"),
    "apply_transform": W(
        MOVIE,
        "v AS (SELECT g.frame, g.height, g.width, floor(g.height - dy)::INT AS y0, g.height - dy - floor(g.height - dy) AS fy, floor(g.width - dx)::INT AS x0, g.width - dx - floor(g.width - dx) AS fx FROM (SELECT *, frame % 5 - 2 + 0.25::DOUBLE AS dy, frame % 3 - 1 - 0.5::DOUBLE AS dx FROM m) g)",
        "c AS (SELECT unnest([0, 0, 1, 1]) AS a, unnest([0, 1, 0, 1]) AS b)",
        f"SELECT v.frame, v.height, v.width, {R('sum((CASE a WHEN 0 THEN 1 - fy ELSE fy END) * (CASE b WHEN 0 THEN 1 - fx ELSE fx END) * coalesce(k.value, 0))', name='value')} FROM v, c LEFT JOIN m k ON k.frame = v.frame AND k.height = v.y0 + c.a AND k.width = v.x0 + c.b GROUP BY v.frame, v.height, v.width",
    ),
    "match_template": W(
        MOVIE,
        "o AS (SELECT x.d AS dy, y.d AS dx FROM (SELECT unnest(range(-2, 3)) AS d) x, (SELECT unnest(range(-2, 3)) AS d) y)",
        "c AS (SELECT a.frame, o.dy, o.dx, corr(a.value, b.value) AS r FROM m a, o JOIN m b ON b.frame = a.frame + 1 AND b.height + o.dy = a.height AND b.width + o.dx = a.width GROUP BY a.frame, o.dy, o.dx)",
        "SELECT frame, arg_max(dy, r)::DOUBLE AS dy, arg_max(dx, r)::DOUBLE AS dx FROM c GROUP BY frame",
    ),
    "patch_shifts": W(
        MOVIE,
        "b AS (SELECT frame, height // 4 AS g0, width // 4 AS g1, height % 4 AS h, width % 4 AS w, value FROM m)",
        "x AS (SELECT p.frame, p.g0, p.g1, (p.h - q.h + 4) % 4 AS dy, (p.w - q.w + 4) % 4 AS dx, sum(p.value * q.value) AS c FROM b p JOIN b q ON q.frame = p.frame + 1 AND q.g0 = p.g0 AND q.g1 = p.g1 GROUP BY ALL)",
        "pk AS (SELECT frame, g0, g1, arg_max(dy, c) AS py, arg_max(dx, c) AS px, max(c) AS c0 FROM x GROUP BY frame, g0, g1)",
        "nb AS (SELECT pk.*, max(x.c) FILTER (WHERE x.dx = px AND x.dy = (py + 3) % 4) AS up, max(x.c) FILTER (WHERE x.dx = px AND x.dy = (py + 1) % 4) AS dn, max(x.c) FILTER (WHERE x.dy = py AND x.dx = (px + 3) % 4) AS lf, max(x.c) FILTER (WHERE x.dy = py AND x.dx = (px + 1) % 4) AS rt FROM pk JOIN x USING (frame, g0, g1) GROUP BY ALL)",
        "loc AS (SELECT frame, g0, g1, py + 0.5 * (up - dn) / (up - 2 * c0 + dn) AS y, px + 0.5 * (lf - rt) / (lf - 2 * c0 + rt) AS x FROM nb)",
        f"SELECT frame, g0::INT AS grid0, g1::INT AS grid1, {R('CASE WHEN y > 2 THEN y - 4 ELSE y END', 4, 'dy')}, {R('CASE WHEN x > 2 THEN x - 4 ELSE x END', 4, 'dx')} FROM loc",
    ),
    "max_proj": W(MOVIE, f"SELECT height, width, {R('max(value)', name='value')} FROM m GROUP BY height, width"),
    "seeds_windows": W(MOVIE, "z AS (SELECT count(*) AS n, ceil(count(*) / 40.0)::INT + 1 AS c FROM embeddings)", "w AS (SELECT i AS sample, greatest(0, floor(i * (n - 1)::DOUBLE / (c - 1) - 50)) AS lo, ceil(i * (n - 1)::DOUBLE / (c - 1) + 50) AS hi FROM z, (SELECT unnest(range(0, 100000)) AS i) WHERE i < c)", f"SELECT sample::INT AS sample, height, width, {R('max(value)', name='value')} FROM w JOIN m ON frame >= lo AND frame < hi GROUP BY sample, height, width"),
    "ptp_quantile": W(TRACES, f"SELECT unit_id, {R('quantile_cont(value, 0.95) - quantile_cont(value, 0.05)', name='ptp')} FROM t GROUP BY unit_id"),
    "pnr": W(_fft(16, 33), f"SELECT unit_id, {R('(quantile_cont(t.value, 0.95) - quantile_cont(t.value, 0.05)) / (quantile_cont(y.value, 0.95) - quantile_cont(y.value, 0.05))', 5, 'pnr')} FROM t JOIN y USING (unit_id, frame) GROUP BY unit_id"),
    "intensity_mask": W(MOVIE, SEEDS, _MAXP, "SELECT * FROM mi"),
    "seed_counts": W(MOVIE, SEEDS, _MAXP, "SELECT mask_int AS kept, count(*) AS n FROM mi GROUP BY mask_int"),
    "radius_graph": W(POINTS, f"SELECT x.unit_id AS src, y.unit_id AS dst, {R('sqrt((x.height - y.height) * (x.height - y.height) + (x.width - y.width) * (x.width - y.width))', name='distance')} FROM p x JOIN p y ON x.unit_id < y.unit_id WHERE sqrt((x.height - y.height) * (x.height - y.height) + (x.width - y.width) * (x.width - y.width)) <= 0.1"),
    "init_a": W(MOVIE, SEEDS, _PIX, f"SELECT s.id AS unit_id, b.height, b.width, {R('sum(a.v * b.v) / (any_value(la.l) * any_value(lb.l))', name='value')} FROM s JOIN z a ON a.height = s.height AND a.width = s.width JOIN z b ON b.frame = a.frame JOIN zn la ON la.height = a.height AND la.width = a.width JOIN zn lb ON lb.height = b.height AND lb.width = b.width WHERE (b.height - s.height) ** 2 + (b.width - s.width) ** 2 BETWEEN 1 AND 9 GROUP BY s.id, b.height, b.width HAVING sum(a.v * b.v) / (any_value(la.l) * any_value(lb.l)) > 0.05 UNION ALL SELECT id, height, width, 1.0 FROM s"),
    "seeds_merge": f"""WITH RECURSIVE {MOVIE}, {SEEDS}, {_PIX},
 e AS (SELECT x.id AS src, y.id AS dst FROM s x JOIN s y ON x.id < y.id AND (x.height - y.height) ** 2 + (x.width - y.width) ** 2 <= 4 JOIN z a ON a.height = x.height AND a.width = x.width JOIN z b ON b.height = y.height AND b.width = y.width AND a.frame = b.frame JOIN zn la ON la.height = x.height AND la.width = x.width JOIN zn lb ON lb.height = y.height AND lb.width = y.width GROUP BY x.id, y.id HAVING sum(a.v * b.v) / (any_value(la.l) * any_value(lb.l)) > 0.05),
 {COMPONENTS}, h AS (SELECT height, width, max(value) AS v FROM m GROUP BY ALL), f AS (SELECT s.*, h.v, coalesce(label, s.id) AS label FROM s JOIN h USING (height, width) LEFT JOIN lab ON lab.node = s.id)
 SELECT id, height, width, row_number() OVER (PARTITION BY label ORDER BY v DESC, id) = 1 AS mask_mrg FROM f""",
    "init_c_single": W(MOVIE, "a AS (SELECT (height * 8 + width) // 3 AS unit_id, height, width, max(value) AS value FROM m GROUP BY height, width HAVING max(value) > 0)", f"SELECT unit_id::BIGINT AS unit_id, frame, {R('sum(a.value * m.value) / sum(a.value * a.value)', name='value')} FROM a JOIN m USING (height, width) GROUP BY unit_id, frame"),
    "noise_fft_mean": _noise("sqrt(avg(pw))"),
    "noise_fft_median": _noise("sqrt(median(pw))"),
    "noise_fft_logmexp": _noise("sqrt(exp(avg(ln(pw + 2.220446049250313e-16))))"),
    "noise_fft_sum": _noise("sqrt(sum(pw))"),
    "noise_welch": W(
        TRACES,
        "x AS (SELECT unit_id, frame, (value - avg(value) OVER (PARTITION BY unit_id)) * (0.5 - 0.5 * cos(2 * pi() * frame / 64)) AS v FROM t)",
        "w AS (SELECT unit_id, k, 2 * (power(sum(v * cos(2 * pi() * k * frame / 64)), 2) + power(sum(v * sin(2 * pi() * k * frame / 64)), 2)) / (SELECT sum(power(0.5 - 0.5 * cos(2 * pi() * i / 64), 2)) FROM (SELECT unnest(range(64)) AS i)) AS pw FROM x, (SELECT unnest(range(17, 32)) AS k) GROUP BY unit_id, k)",
        f"SELECT unit_id, {R('sqrt(exp(avg(ln(pw / 2 + 2.220446049250313e-16))))', name='sn')} FROM w GROUP BY unit_id",
    ),
    "smooth_low": W(_fft(0, 16), f"SELECT unit_id, frame, {R()} FROM y"),
    "smooth_high": W(_fft(16, 33), f"SELECT unit_id, frame, {R()} FROM y"),
    "butter": f"""WITH RECURSIVE {TRACES}, k AS (SELECT tan(pi() * 0.2) AS k), b AS (SELECT k * k / (1 + sqrt(2) * k + k * k) AS b0, 2 * (k * k - 1) / (1 + sqrt(2) * k + k * k) AS a1, (1 - sqrt(2) * k + k * k) / (1 + sqrt(2) * k + k * k) AS a2 FROM k),
 r(unit_id, frame, x1, x2, y1, y2) AS (SELECT unit_id, 0::BIGINT, value, 0.0::DOUBLE, b0 * value, 0.0::DOUBLE FROM t, b WHERE frame = 0
  UNION ALL SELECT r.unit_id, r.frame + 1, t.value, x1, b0 * t.value + 2 * b0 * x1 + b0 * x2 - a1 * y1 - a2 * y2, y1 FROM r JOIN t ON t.unit_id = r.unit_id AND t.frame = r.frame + 1, b)
 SELECT unit_id, frame, {R('y1', name='value')} FROM r""",
    "ar1": W(TRACES, "d AS (SELECT unit_id, frame, value - avg(value) OVER (PARTITION BY unit_id) AS v FROM t), g AS (SELECT x.unit_id, l, sum(x.v * y.v) / 64 AS c FROM d x, (SELECT unnest([0, 1, 2]) AS l) JOIN d y ON y.unit_id = x.unit_id AND y.frame = x.frame + l GROUP BY ALL), k AS (SELECT unit_id, max(c) FILTER (WHERE l = 0) - 0.05 * 0.05 AS r0, max(c) FILTER (WHERE l = 1) AS c1, max(c) FILTER (WHERE l = 2) AS c2 FROM g GROUP BY unit_id)", f"SELECT unit_id, {R('(r0 * c1 + c1 * c2) / (r0 * r0 + c1 * c1)', 5, 'g')} FROM k"),
    "ar2": W(
        TRACES,
        "d AS (SELECT unit_id, frame, value - avg(value) OVER (PARTITION BY unit_id) AS v FROM t), g AS (SELECT x.unit_id, l, sum(x.v * y.v) / 64 AS c FROM d x, (SELECT unnest(range(5)) AS l) JOIN d y ON y.unit_id = x.unit_id AND y.frame = x.frame + l GROUP BY ALL)",
        "k AS (SELECT unit_id, max(c) FILTER (WHERE l = 0) - 0.05::DOUBLE * 0.05::DOUBLE AS c0, max(c) FILTER (WHERE l = 1) AS c1, max(c) FILTER (WHERE l = 2) AS c2, max(c) FILTER (WHERE l = 3) AS c3, max(c) FILTER (WHERE l = 4) AS c4 FROM g GROUP BY unit_id)",
        "n AS (SELECT unit_id, c0 * c0 + c1 * c1 + c2 * c2 + c3 * c3 AS a, c0 * c1 + c1 * c0 + c2 * c1 + c3 * c2 AS b, c1 * c1 + c0 * c0 + c1 * c1 + c2 * c2 AS d, c0 * c1 + c1 * c2 + c2 * c3 + c3 * c4 AS p, c1 * c1 + c0 * c2 + c1 * c3 + c2 * c4 AS q FROM k)",
        f"SELECT unit_id, {R('(p * d - q * b) / (a * d - b * b)', 4, 'g1')}, {R('(a * q - b * p) / (a * d - b * b)', 4, 'g2')} FROM n",
    ),
    "rising_run": W(TRACES, "d AS (SELECT *, lead(value) OVER w > value AS up, row_number() OVER w AS n FROM t WINDOW w AS (PARTITION BY unit_id ORDER BY frame)), g AS (SELECT *, n - row_number() OVER (PARTITION BY unit_id, up ORDER BY frame) AS k FROM d), r AS (SELECT unit_id, k, count(*) AS p, min(frame) AS f, arg_max(value, frame) - arg_min(value, frame) AS amp FROM g WHERE up GROUP BY ALL)", "SELECT unit_id, first(p ORDER BY amp DESC, f) AS p FROM r GROUP BY unit_id"),
    "med_baseline": W(TRACES, "o AS (SELECT unnest([-2, -1, 0, 1, 2]) AS d), n AS (SELECT t.unit_id, t.frame, t.value AS own, k.value FROM t, o JOIN t k ON k.unit_id = t.unit_id AND k.frame = CASE WHEN t.frame + d < 0 THEN -1 - (t.frame + d) WHEN t.frame + d > 63 THEN 127 - (t.frame + d) ELSE t.frame + d END)", f"SELECT unit_id, frame, {R('greatest(first(own) - median(value), 0)', name='value')} FROM n GROUP BY unit_id, frame"),
    "ar_response": W(TRACES, f"SELECT x.unit_id, x.frame, {R('sum(y.value * power(0.8::DOUBLE, x.frame - y.frame))', name='value')} FROM t x JOIN t y ON y.unit_id = x.unit_id AND y.frame <= x.frame GROUP BY x.unit_id, x.frame"),
    "submask": W(FOOT, DISK1, "SELECT DISTINCT unit_id, height + dy AS height, width + dx AS width FROM a, o WHERE value > 0.2 AND height + dy BETWEEN 0 AND 7 AND width + dx BETWEEN 0 AND 7"),
    "compute_trace": W(MOVIE, FOOT, TRACES, PRODUCT, "n AS (SELECT unit_id, sum(value * value) AS n FROM a GROUP BY 1), y AS (SELECT * FROM m WHERE frame IN (SELECT frame FROM t)), yy AS (SELECT a.unit_id, y.frame, sum(a.value * y.value) AS v FROM y JOIN a USING (height, width) GROUP BY ALL), rr AS (SELECT a.unit_id, ac.frame, sum(a.value * ac.value) AS v FROM ac JOIN a USING (height, width) GROUP BY ALL)", f"SELECT unit_id, frame, {R('greatest((yy.v - rr.v) / n.n + t.value, 0)', 5, 'value')} FROM yy JOIN rr USING (unit_id, frame) JOIN n USING (unit_id) JOIN t USING (unit_id, frame)"),
    "jaccard_groups": W(FOOT, "b AS (SELECT * FROM a), n AS (SELECT unit_id, count(*) AS n FROM b GROUP BY 1), s AS (SELECT x.unit_id AS src, y.unit_id AS dst, count(*) AS k FROM b x JOIN b y ON x.height = y.height AND x.width = y.width AND x.unit_id < y.unit_id GROUP BY ALL)", f"SELECT src, dst, {R('k / (n1.n + n2.n - k)::DOUBLE', name='jaccard')} FROM s JOIN n n1 ON n1.unit_id = src JOIN n n2 ON n2.unit_id = dst WHERE k / (n1.n + n2.n - k)::DOUBLE > 0.45"),
    "post_scale": W(TRACES, f"SELECT unit_id, {R('sum(value * (value * 2 + frame * 0.001::DOUBLE)) / sum(value * value)', name='scale')} FROM t GROUP BY unit_id"),
    "atc": W(FOOT, TRACES, PRODUCT, f"SELECT {CELL}, {R('value', 5)} FROM ac"),
    "background": W(MOVIE, FOOT, TRACES, PRODUCT, "yb AS (SELECT m.frame, m.height, m.width, greatest(m.value - coalesce(ac.value, 0), 0) AS v FROM m LEFT JOIN ac USING (frame, height, width)), bb AS (SELECT height, width, avg(v) AS b FROM yb GROUP BY ALL)", f"SELECT 'b' AS kind, NULL::BIGINT AS unit_id, height, width, NULL::BIGINT AS frame, {R('b', 5, 'value')} FROM bb UNION ALL SELECT 'f', NULL, NULL, NULL, frame, {R('sum(b * v) / sum(b * b)', 5, 'value')} FROM yb JOIN bb USING (height, width) GROUP BY frame"),
    "unit_merge": f"""WITH RECURSIVE {FOOT}, {TRACES}, k AS (SELECT unit_id, frame, value - avg(value) OVER (PARTITION BY unit_id) AS v FROM t), l AS (SELECT unit_id, sqrt(sum(v * v)) AS l FROM k GROUP BY 1),
 ov AS (SELECT DISTINCT p.unit_id AS src, q.unit_id AS dst FROM a p JOIN a q ON p.height = q.height AND p.width = q.width AND p.unit_id < q.unit_id),
 e AS (SELECT src, dst FROM ov JOIN k x ON x.unit_id = src JOIN k y ON y.unit_id = dst AND y.frame = x.frame JOIN l lx ON lx.unit_id = src JOIN l ly ON ly.unit_id = dst GROUP BY src, dst, lx.l, ly.l HAVING sum(x.v * y.v) / (lx.l * ly.l) > 0.4),
 {COMPONENTS}, g AS (SELECT d.unit_id, coalesce(label, d.unit_id) AS label FROM (SELECT DISTINCT unit_id FROM a) d LEFT JOIN lab ON lab.node = d.unit_id), n AS (SELECT label, count(*) AS n FROM g GROUP BY 1)
 SELECT 'a' AS kind, label AS unit_id, height, width, NULL::BIGINT AS frame, {R('sum(value) / any_value(n)', name='value')} FROM a JOIN g USING (unit_id) JOIN n USING (label) GROUP BY label, height, width
 UNION ALL SELECT 'c', label, NULL, NULL, frame, {R('avg(value)', name='value')} FROM t JOIN g USING (unit_id) GROUP BY label, frame
 UNION ALL SELECT 'label', unit_id, NULL, NULL, NULL, label::DOUBLE FROM g""",
    "centroid": W(POINTS, f"SELECT session, unit_id, {R('height')}, {R('width')} FROM p"),
    "edge_corr": W(POINTS, TRACES, "e AS (SELECT x.unit_id AS src, y.unit_id AS dst FROM p x JOIN p y ON x.unit_id < y.unit_id WHERE sqrt((x.height - y.height) * (x.height - y.height) + (x.width - y.width) * (x.width - y.width)) <= 0.2)", f"SELECT src, dst, {R('corr(x.value, y.value)', name='corr')} FROM e JOIN t x ON x.unit_id = src JOIN t y ON y.unit_id = dst AND y.frame = x.frame GROUP BY src, dst"),
    "components": f"WITH RECURSIVE {POINTS}, e AS (SELECT x.unit_id AS src, y.unit_id AS dst FROM p x JOIN p y ON x.unit_id < y.unit_id WHERE sqrt((x.height - y.height) * (x.height - y.height) + (x.width - y.width) * (x.width - y.width)) <= 0.08), {COMPONENTS} SELECT unit_id AS node, coalesce(label, unit_id) AS label FROM p LEFT JOIN lab ON lab.node = unit_id",
    "canonical_edges": "SELECT DISTINCT least(l_partkey, l_suppkey) AS src, greatest(l_partkey, l_suppkey) AS dst FROM lineitem WHERE l_partkey <> l_suppkey",
    "kd_partition": f"""WITH RECURSIVE {POINTS}, r(id, height, width, path, ord) AS (
  SELECT unit_id, height, width, '', row_number() OVER (ORDER BY unit_id) FROM p
  UNION ALL SELECT id, height, width, path || CASE WHEN rn <= n // 2 THEN '0' ELSE '1' END, rn
  FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY CASE WHEN wide THEN width ELSE height END, ord) AS rn
        FROM (SELECT *, count(*) OVER k AS n, max(width) OVER k - min(width) OVER k > max(height) OVER k - min(height) OVER k AS wide FROM r WINDOW k AS (PARTITION BY path))) WHERE n > 64),
 f AS (SELECT id, arg_max(path, length(path)) AS path FROM r GROUP BY id)
 SELECT id, dense_rank() OVER (ORDER BY path) - 1 AS part FROM f""",
    "local_max_roll": f"WITH RECURSIVE {MOVIE}, im AS (SELECT frame AS g, height, width, value FROM m), {_roll('im', '[1, 2]', 0.1)} SELECT g AS frame, height, width FROM rolled",
    "seeds_rolling": f"WITH RECURSIVE {MOVIE}, {_WINDOWS}, {_roll('wp', '[2, 3]', 0.05)} SELECT height, width, count(*)::INT AS seeds FROM rolled GROUP BY ALL",
    "ks_zscore_rank": W(TRACES, f"SELECT unit_id, frame, {R('(value - avg(value) OVER w) / stddev_pop(value) OVER w', name='z')}, row_number() OVER (PARTITION BY unit_id ORDER BY value, frame)::INT AS rank FROM t WINDOW w AS (PARTITION BY unit_id)"),
    "pnr_mask": W(
        MOVIE,
        SEEDS,
        "c AS (SELECT count(*) AS n, floor(count(*) * 0.25)::BIGINT AS cut FROM embeddings)",
        "d AS (SELECT i, sum((CASE WHEN j = 0 OR 2 * j = n THEN 1 ELSE 2 END) * cos(2 * pi() * ((j * i) % n) / n)) / any_value(n) AS v FROM (SELECT n, cut, unnest(range(0, n)) AS i FROM c), (SELECT unnest(range(0, n // 2 + 1)) AS j FROM c) WHERE j >= cut GROUP BY i)",
        "x AS (SELECT s.id, m.frame, m.value FROM s JOIN m USING (height, width))",
        "y AS (SELECT x.id, g.frame, sum(x.value * d.v) AS value FROM x, (SELECT unnest(range(0, n)) AS frame, n FROM c) g JOIN d ON d.i = (g.frame - x.frame + g.n) % g.n GROUP BY x.id, g.frame)",
        "k AS (SELECT id, quantile_cont(value, 0.999) - quantile_cont(value, 0.001) AS p FROM x GROUP BY id), l AS (SELECT id, quantile_cont(value, 0.999) - quantile_cont(value, 0.001) AS q FROM y GROUP BY id)",
        "SELECT s.id, s.height, s.width, p / q > 1.5 AS mask_pnr FROM s JOIN k USING (id) JOIN l USING (id)",
    ),
    "partition_diag": W(
        POINTS,
        "k AS (SELECT unit_id, floor(height)::BIGINT AS part FROM p), e AS (SELECT a.part AS pa, b.part AS pb FROM p x JOIN p y ON x.unit_id < y.unit_id JOIN k a ON a.unit_id = x.unit_id JOIN k b ON b.unit_id = y.unit_id WHERE sqrt((x.height - y.height) * (x.height - y.height) + (x.width - y.width) * (x.width - y.width)) <= 0.15)",
        "z AS (SELECT pa AS part, (pa = pb)::INT AS i FROM e UNION ALL SELECT pb, 0 FROM e WHERE pa <> pb)",
        f"SELECT part, size, coalesce(intra, 0)::BIGINT AS intra, coalesce(crossing, 0)::BIGINT AS \"cross\", {R('size * 1000 * 4 / (1024.0::DOUBLE * 1024)', name='mib')} FROM (SELECT part, count(*) AS size FROM k GROUP BY 1) LEFT JOIN (SELECT part, sum(i) AS intra, sum(1 - i) AS crossing FROM z GROUP BY 1) USING (part)",
    ),
    "fov_window": W(MOVIE, "n AS (SELECT height, width, count(*) FILTER (WHERE value <= -0.1) AS n FROM m GROUP BY ALL)", "SELECT height, width FROM n WHERE n = (SELECT min(n) FROM n)"),
    "centroids_window": W(FOOT, SEEDS, f"SELECT session, unit_id, {R('sum(height * value) / sum(value) / 8 * 7', name='height')}, {R('sum(width * value) / sum(value) / 8 * 7', name='width')} FROM a WHERE (height, width) IN (SELECT height, width FROM s) GROUP BY session, unit_id"),
    "pair_distance": W(POINTS, PAIRS, f"SELECT session_a, unit_a, session_b, unit_b, {R('distance')} FROM q WHERE distance < 0.1"),
    "tile_pairs": W(
        POINTS,
        "b AS (SELECT session, min(height) h0, max(height) h1, min(width) w0, max(width) w1 FROM p GROUP BY 1)",
        "k AS (SELECT x.session AS session_a, y.session AS session_b, least(x.h0, y.h0) AS h0, greatest(x.h1, y.h1) AS h1, least(x.w0, y.w0) AS w0, greatest(x.w1, y.w1) AS w1 FROM b x JOIN b y ON x.session < y.session)",
        "c AS (SELECT *, ceil((h1 - h0) * 2)::INT AS nh, ceil((w1 - w0) * 2)::INT AS nw FROM k)",
        "ti AS (SELECT session_a, session_b, h0 + i * (CASE WHEN nh > 1 THEN (h1 - h0) / (nh - 1) ELSE 0 END) AS th, w0 + j * (CASE WHEN nw > 1 THEN (w1 - w0) / (nw - 1) ELSE 0 END) AS tw FROM c, (SELECT unnest(range(40)) AS i), (SELECT unnest(range(40)) AS j) WHERE i < nh AND j < nw)",
        "pr AS (SELECT DISTINCT ti.session_a, ti.session_b, x.unit_id AS unit_a, y.unit_id AS unit_b, x.height AS hx, x.width AS wx, y.height AS hy, y.width AS wy FROM ti JOIN p x ON x.session = session_a AND x.height BETWEEN th - 1 AND th + 1 AND x.width BETWEEN tw - 1 AND tw + 1 JOIN p y ON y.session = session_b AND y.height BETWEEN th - 1 AND th + 1 AND y.width BETWEEN tw - 1 AND tw + 1)",
        f"SELECT session_a, session_b, unit_a, unit_b, {R('sqrt((hx - hy) * (hx - hy) + (wx - wy) * (wx - wy))', name='distance')} FROM pr",
    ),
    "cartesian": "SELECT vec_id AS unit_id, session FROM embeddings, (SELECT DISTINCT label AS session FROM embeddings)",
    "mutual_nn": W(POINTS, PAIRS, "r AS (SELECT *, row_number() OVER (PARTITION BY session_a, session_b, unit_a ORDER BY distance, unit_b) AS na, row_number() OVER (PARTITION BY session_a, session_b, unit_b ORDER BY distance, unit_a) AS nb FROM q WHERE distance < 0.1)", f"SELECT session_a, unit_a, session_b, unit_b, {R('distance')} FROM r WHERE na = 1 AND nb = 1"),
    "resolve_strict": _resolved("strict"),
    "resolve_majority": _resolved("majority"),
    "fill_mapping": f"WITH RECURSIVE {_mapping('strict')}, {_FILLED} SELECT {_NAME.format('label')} AS mapping, session, unit_id FROM g",
    "group_sessions": f"WITH RECURSIVE {_mapping('strict')}, {_FILLED} SELECT sessions, count(*) AS n FROM (SELECT label, string_agg(session::VARCHAR, ',' ORDER BY session) AS sessions FROM g GROUP BY label) GROUP BY sessions",
    "overlay_counts": f"WITH RECURSIVE {_mapping('strict')}, {_FILLED}, k AS (SELECT session, unit_id, count(*) OVER (PARTITION BY label) > 1 AS m FROM g) SELECT session, height, width, count(*) FILTER (WHERE m) AS matched, count(*) FILTER (WHERE NOT m) AS unmatched FROM a JOIN k USING (session, unit_id) GROUP BY ALL",
    "nn_order": f"""WITH RECURSIVE {POINTS}, r(session, unit_id, height, width, seen, nn) AS (
  SELECT session, unit_id, height, width, [unit_id], 0::BIGINT FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY height + width, unit_id) AS k FROM p) WHERE k = 1
  UNION ALL SELECT session, unit_id, height, width, list_append(seen, unit_id), nn + 1
  FROM (SELECT p.*, r.seen, r.nn, row_number() OVER (PARTITION BY r.session ORDER BY (p.height - r.height) ** 2 + (p.width - r.width) ** 2, p.unit_id) AS k FROM r JOIN p ON p.session = r.session AND NOT list_contains(r.seen, p.unit_id)) WHERE k = 1)
 SELECT session, unit_id, nn FROM r""",
    "frame_summary": W(MOVIE, "f AS (SELECT frame, avg(value) AS mean, max(value) AS max, min(value) AS min FROM m GROUP BY 1)", f"SELECT frame, {R('mean')}, {R('max')}, {R('min')}, {R('mean - lag(mean) OVER (ORDER BY frame)', name='diff')} FROM f"),
    "footprint_summary": W(FOOT, f"SELECT height, width, {R('sum(value)', 4, 'total')}, count(*) AS units FROM a GROUP BY height, width"),
    "preview_sweep": W(MOVIE, "o AS (SELECT x.d AS dy, y.d AS dx FROM (SELECT unnest(range(-2, 3)) AS d) x, (SELECT unnest(range(-2, 3)) AS d) y)", _neighbours("reflect"), f"SELECT 3 AS param_wnd, {CELL}, {R('any_value(own) - avg(value)', name='value')} FROM n WHERE abs(dy) <= 1 AND abs(dx) <= 1 GROUP BY {CELL} UNION ALL SELECT 5, {CELL}, {R('any_value(own) - avg(value)', name='value')} FROM n GROUP BY {CELL}"),
    "mapping_pivot": f"WITH RECURSIVE {_mapping('strict')} SELECT {_NAME.format('label')} AS mapping, {', '.join(f'max(unit_id) FILTER (WHERE session = {i}) AS session{i}' for i in range(10))} FROM r GROUP BY label",
    "unit_groups": "SELECT vec_id // 5 AS unit_group, count(*) AS n FROM embeddings GROUP BY 1",
    "unit_labels": W(TRACES, f"SELECT (unit_id // 3)::INT AS unit_id, frame, {R('avg(value)', name='value')} FROM t WHERE unit_id % 10 <> 0 GROUP BY unit_id // 3, frame"),
}
