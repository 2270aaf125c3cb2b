"""SQL equivalents of the registered queries, for a second engine over the same tables.

Named pieces (CTEs) are put in front of each query as far as its text mentions them.
"""

from __future__ import annotations

import math
import re

PIECES: dict[str, str] = {}
ORACLES: dict[str, str] = {}


def piece(name: str, sql: str, head: str | None = None) -> None:
    PIECES[name] = f"{head or name} AS ({sql.strip()})"


def oracle(name: str, sql: str) -> None:
    needed: list[str] = []
    seen: set[str] = set()

    def need(text: str) -> None:
        for p in PIECES:
            if p not in seen and re.search(rf"\b{p}\b", text):
                seen.add(p)
                need(PIECES[p].split(" AS (", 1)[1])
                needed.append(p)

    sql = sql.strip()
    if sql.startswith("WITH"):
        sql = f"SELECT * FROM ({sql})"
    need(sql)
    ORACLES[name] = ("WITH RECURSIVE " + ",\n".join(PIECES[p] for p in needed) + "\n" if needed else "") + sql.strip()


# ---- fixtures -------------------------------------------------------------------------------
piece("n_events", "SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS w FROM events")
piece("site", """
SELECT *, (y-(gy*8+3+h%3))*(y-(gy*8+3+h%3)) + (x-(gx*8+3+(h*5)%3))*(x-(gx*8+3+(h*5)%3)) AS d2
FROM (SELECT *, (gy*31 + gx*17) % 7 AS h FROM (SELECT *, y // 8 AS gy, x // 8 AS gx FROM (
  SELECT event_id // w AS y, event_id % w AS x, CAST(floor(value*100) AS BIGINT) % 200 AS nz, w FROM events, n_events
  UNION ALL SELECT p // w, p % w, 0, w FROM (SELECT unnest(range(n, w*w)) AS p, w FROM n_events))))""")
piece("pixels", """
SELECT y, x, cycle, channel, CAST(CASE WHEN channel = 0 THEN 1000 + nz + CASE WHEN h < 6 AND d2 <= 4 THEN 20000 + 500*(4-d2) ELSE 0 END
  ELSE 300 + (nz*channel) % 97 + CASE WHEN h < 6 AND d2 <= 4
    THEN CASE WHEN (gy*3+gx*5+cycle*7+(gy*gx)%4) % 3 = channel-1 THEN 9000 + 100*h
              WHEN (gy+2*gx+cycle) % 5 = 0 THEN 1500 ELSE 60 END ELSE 0 END END AS BIGINT) AS v
FROM site, (VALUES (0),(1),(2)) AS kk(cycle), (VALUES (0),(1),(2),(3)) AS cc(channel)""")
piece("bf", "SELECT y, x, v FROM pixels WHERE cycle = 0 AND channel = 0")
piece("side_w", "SELECT max(x)+1 AS w FROM bf")
piece("beads", """
SELECT DISTINCT gy*1000000+gx AS bead_id, gx*8+3+(h*5)%3 AS x, gy*8+3+h%3 AS y FROM site WHERE h < 6""")
piece("protein_pixels", """
SELECT y, x, CASE WHEN h < 6 AND abs(y-(gy*8+3+h%3)) <= 2 AND abs(x-(gx*8+3+(h*5)%3)) <= 2
  THEN 5300 + 100*h ELSE CASE WHEN (y // 24 + x // 24) % 2 = 0 THEN 14000 ELSE 1500 END END + v % 200 AS v
FROM (SELECT y, x, v, y // 8 AS gy, x // 8 AS gx, ((y // 8)*31 + (x // 8)*17) % 7 AS h
      FROM pixels WHERE cycle = 0 AND channel = 1)""")
piece("cell_pixels", """
SELECT CASE WHEN y % 24 >= 2 AND x % 24 >= 2 THEN (y // 24)*1000000 + x // 24 + 1 ELSE 0 END AS label, y, x FROM site""")
piece("color_code", """
SELECT DISTINCT concat('P', cy0, cy1, cy2) AS protein, cy0, cy1, cy2 FROM (
  SELECT CAST(p_partkey % 3 AS INTEGER) AS cy0, CAST(p_size % 3 AS INTEGER) AS cy1, CAST(length(p_name) % 3 AS INTEGER) AS cy2
  FROM part) WHERE NOT (cy0 = 2 AND cy1 = 2)""")
piece("moving_pixels", """
SELECT t.y, t.x, t.tile_i*4 + t.tile_j AS tile_id, t.tile_i, t.tile_j, f.v
FROM (SELECT y, x, x*4 // w AS tile_i, y*4 // w AS tile_j FROM bf, side_w) t
JOIN bf f ON f.y = t.y - (t.tile_j % 3 - 1) AND f.x = t.x - (t.tile_i % 3 - 1)""")
piece("tiled_bf", "SELECT y, x, v, (x*4 // w)*4 + y*4 // w AS tile_id FROM bf, side_w")
piece("moving_stack", """
SELECT t.y, t.x, t.channel, coalesce(f.v, 0) AS v
FROM (SELECT y, x, channel, y - ((y*4 // w) % 3 - 1) AS fy, x - ((x*4 // w) % 3 - 1) AS fx
      FROM pixels, side_w WHERE cycle = 0) t
LEFT JOIN (SELECT y, x, channel, v FROM pixels WHERE cycle = 0) f ON f.channel = t.channel AND f.y = t.fy AND f.x = t.fx""")
piece("catalogue", """
SELECT concat('/d/s', o_orderkey // 4, '/', substr(o_orderpriority, 1, 1), 'c', o_orderkey % 4,
    CASE WHEN o_custkey % 3 = 0 THEN '.tiff' ELSE '.ome.tif' END) AS path,
  o_orderkey // 4 AS slide, CASE WHEN o_custkey % 7 = 0 THEN 2 ELSE 4 END AS n_channels,
  CAST(o_custkey % 5 AS INTEGER) AS reference_channel, o_orderkey % 4 = (o_orderkey // 4) % 4 AS is_reference,
  CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 3 ELSE 0 END AS working_ndim,
  CASE WHEN o_orderpriority LIKE '5%' THEN '' ELSE 'changed_' END AS prefix,
  CAST(90 + o_custkey % 11 AS INTEGER) AS max_size FROM orders""")
piece("listing", """
SELECT concat('/d/', CASE WHEN o_custkey % 4 = 0 THEN 'sub/' ELSE '' END, 'c', o_orderkey, CASE o_custkey % 5
  WHEN 0 THEN '.TIF' WHEN 1 THEN '.tiff' WHEN 2 THEN '.ome.tif' WHEN 3 THEN '.png' ELSE '.tif.bak' END) AS path,
  o_orderstatus = 'F' AS seen FROM orders""")
piece("stack_files", """
SELECT cycle, concat('/d/c', cycle, '.ome.tif') AS path, CASE WHEN cycle = 1 THEN '' ELSE 'changed_' END AS prefix,
  max(y) - 8*cycle AS max_size FROM pixels GROUP BY cycle""")
piece("shown_pixels", """
SELECT y, x, cycle, channel, CASE WHEN cycle = 2 OR (cycle = 1 AND channel = 0) THEN v // 2 + 7 ELSE v END AS v FROM pixels""")
piece("gray8", """
SELECT y, x, coalesce(CAST(trunc(CAST(v - mn AS FLOAT) * CAST(255.0::DOUBLE / CAST(nullif(mx - mn, 0) AS FLOAT) AS FLOAT)) AS INTEGER), 0) AS v
FROM bf, (SELECT min(v) AS mn, max(v) AS mx FROM bf)""")

# ---- intensity pieces -----------------------------------------------------------------------
piece("hist", "SELECT cycle, channel, v, count(*) AS k FROM pixels GROUP BY ALL")
piece("otsu_var", """
SELECT cycle, channel, v, w1*w2*(s1/w1 - s2/w2)*(s1/w1 - s2/w2) AS var FROM (
  SELECT cycle, channel, v, CAST(w1 AS DOUBLE) AS w1, CAST(w - w1 AS DOUBLE) AS w2, CAST(s1 AS DOUBLE) AS s1, CAST(s - s1 AS DOUBLE) AS s2 FROM (
    SELECT cycle, channel, v, sum(k) OVER r AS w1, sum(k*v) OVER r AS s1, sum(k) OVER p AS w, sum(k*v) OVER p AS s FROM hist
    WINDOW r AS (PARTITION BY cycle, channel ORDER BY v), p AS (PARTITION BY cycle, channel)) WHERE w1 < w)""")
piece("otsu", """
SELECT cycle, channel, v AS level FROM otsu_var
QUALIFY row_number() OVER (PARTITION BY cycle, channel ORDER BY var DESC, v) = 1""")
piece("quant", """
SELECT cycle, channel, v, CAST(sum(k) OVER (PARTITION BY cycle, channel ORDER BY v) AS DOUBLE)
  / CAST(sum(k) OVER (PARTITION BY cycle, channel) AS DOUBLE) AS q FROM hist WHERE channel > 0""")
piece("match_lut", """
SELECT cycle, channel, v, CASE WHEN lv IS NULL THEN hv WHEN hv IS NULL THEN lv WHEN hq = lq THEN lv
  ELSE (hv - lv) / (hq - lq) * (q - lq) + lv END AS matched
FROM (SELECT cycle, channel, v, q, max(tv) OVER up AS lv, max(tq) OVER up AS lq, min(tv) OVER down AS hv, min(tq) OVER down AS hq
  FROM (SELECT cycle, channel, v, q, CAST(NULL AS DOUBLE) AS tv, CAST(NULL AS DOUBLE) AS tq FROM quant WHERE channel > 1
        UNION ALL
        SELECT t.cycle, c.channel, NULL, t.q, CAST(t.v AS DOUBLE), t.q FROM quant t, (VALUES (2),(3)) AS c(channel) WHERE t.channel = 1)
  WINDOW up AS (PARTITION BY cycle, channel ORDER BY q RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         down AS (PARTITION BY cycle, channel ORDER BY q RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
WHERE v IS NOT NULL""")
piece("matched_px", """
SELECT p.y, p.x, p.cycle, p.channel, coalesce(m.matched, CAST(p.v AS DOUBLE)) AS v
FROM pixels p LEFT JOIN match_lut m ON m.cycle = p.cycle AND m.channel = p.channel AND m.v = p.v WHERE p.channel > 0""")

# ---- regions --------------------------------------------------------------------------------
STRIDE = 2 ** 32


def labelled(name: str, fg: str) -> None:
    """8-neighbour labels (least pixel id) of the piece ``fg`` (y, x and others), keyed by y, x."""
    piece(f"{name}_raw", f"""
  SELECT y, x, y*{STRIDE}+x AS label FROM {fg}
  UNION
  SELECT t.y, t.x, min(c.label) AS label
  FROM {name}_raw c, (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) AS o(dy, dx), recurring.{name}_raw t
  WHERE t.y = c.y + o.dy AND t.x = c.x + o.dx AND c.label < t.label GROUP BY t.y, t.x""",
          head=f"{name}_raw(y, x, label) USING KEY (y, x)")
    piece(name, f"SELECT f.*, r.label FROM {fg} f JOIN {name}_raw r ON r.y = f.y AND r.x = f.x")


piece("bright", "SELECT b.* FROM bf b, (SELECT level FROM otsu WHERE cycle = 0 AND channel = 0) WHERE v > level")
labelled("region", "bright")
piece("inner_region", """
SELECT * FROM region WHERE label IN (SELECT label FROM region, side_w GROUP BY label, w
  HAVING min(y) > 0 AND min(x) > 0 AND max(y) < w-1 AND max(x) < w-1)""")
piece("region_table", """
SELECT label, count(*) AS area, min(y) AS y1, min(x) AS x1, max(y) AS y2, max(x) AS x2, avg(y) AS cy, avg(x) AS cx,
  CAST(sum(y*v) AS DOUBLE)/CAST(sum(v) AS DOUBLE) AS wy, CAST(sum(x*v) AS DOUBLE)/CAST(sum(v) AS DOUBLE) AS wx FROM region GROUP BY label""")


def outline(name: str, regions: str, extra: str = "") -> None:
    """Outlines of the regions and holes of a piece (label, y, x): piece (label, hole, parent, m00, m10, m01, length).

    For each region by itself, what is not of it in the rectangle around it is flooded from every position to its four neighbours; what
    the flood from the corner doesn't reach is inside.
    """
    key, same = (f"{extra}, ", f"AND t.{extra} = c.{extra}") if extra else ("", "")
    piece(f"{name}_box", f"SELECT {key}label, min(y)-1 AS y0, max(y)+1 AS y1, min(x)-1 AS x0, max(x)+1 AS x1 FROM {regions} GROUP BY {key}label")
    piece(f"{name}_free", f"""
SELECT {key}label, y, x FROM (SELECT *, unnest(range(x0, x1+1)) AS x FROM (SELECT *, unnest(range(y0, y1+1)) AS y FROM {name}_box))
EXCEPT SELECT {key}label, y, x FROM {regions}""")
    piece(f"{name}_flood", f"""
  SELECT {key}label, y, x, y*{STRIDE}+x AS comp FROM {name}_free
  UNION
  SELECT {f"t.{extra}, " if extra else ""}t.label, t.y, t.x, min(c.comp) AS comp
  FROM {name}_flood c, (VALUES (-1,0),(1,0),(0,-1),(0,1)) AS o(dy, dx), recurring.{name}_flood t
  WHERE t.label = c.label {same} AND t.y = c.y + o.dy AND t.x = c.x + o.dx AND c.comp < t.comp GROUP BY {f"t.{extra}, " if extra else ""}t.label, t.y, t.x""",
          head=f"{name}_flood({key}label, y, x, comp) USING KEY ({key}label, y, x)")
    piece(f"{name}_in", f"SELECT f.* FROM {name}_flood f JOIN {name}_box b USING ({key}label) WHERE comp <> y0*{STRIDE}+x0")
    corners = "(VALUES (0,0,1),(0,-1,2),(-1,0,4),(-1,-1,8)) AS o(dy, dx, bit)"
    piece(f"{name}_quads", f"""
SELECT {key}label, 0 AS comp, y + dy AS qy, x + dx AS qx, sum(bit) AS bits, count(*) AS k
FROM (SELECT {key}label, y, x FROM {regions} UNION ALL SELECT {key}label, y, x FROM {name}_in), {corners} GROUP BY ALL
UNION ALL
SELECT {key}label, comp, y + dy, x + dx, 15 - sum(bit), 4 - count(*) FROM {name}_in, {corners} GROUP BY {key}label, comp, y + dy, x + dx""")
    piece(f"{name}_sums", f"""
SELECT {key}label, comp, comp > 0 AS hole, sum(CASE WHEN comp > 0 THEN 1 - a ELSE a END) AS m00,
  sum(CASE WHEN comp > 0 THEN qx + 0.5::DOUBLE - a*(qx+mx) ELSE a*(qx+mx) END) AS m10,
  sum(CASE WHEN comp > 0 THEN qy + 0.5::DOUBLE - a*(qy+my) ELSE a*(qy+my) END) AS m01, sum(len) AS length FROM (
  SELECT *, CASE k WHEN 4 THEN 1.0::DOUBLE WHEN 3 THEN 0.5::DOUBLE ELSE 0 END AS a,
    CASE WHEN k = 4 THEN 0.5::DOUBLE WHEN bits IN (14, 13) THEN 2/3 ELSE 1/3 END AS my,
    CASE WHEN k = 4 THEN 0.5::DOUBLE WHEN bits IN (14, 11) THEN 2/3 ELSE 1/3 END AS mx,
    CASE WHEN k = 3 THEN sqrt(2) WHEN k = 2 AND bits IN (6, 9) THEN 2*sqrt(2) WHEN k = 2 THEN 1 ELSE 0 END AS len
  FROM {name}_quads) GROUP BY {key}label, comp""")
    piece(f"{name}_held", f"""
SELECT {f"t.{extra}, " if extra else ""}t.label, max(c.comp) AS parent FROM {name}_box t JOIN {name}_in c ON c.y*{STRIDE}+c.x = t.label {same} GROUP BY ALL""")
    piece(name, f"""
SELECT {key}CASE WHEN hole THEN comp ELSE label END AS label, hole, CASE WHEN hole THEN label ELSE parent END AS parent, m00, m10, m01, length
FROM {name}_sums LEFT JOIN {name}_held USING ({key}label)""")


outline("contour", "region")

# ---- stencils -------------------------------------------------------------------------------


def gauss(size: int, sigma: float = 0.0) -> list[float]:
    if sigma <= 0:
        if size == 3:
            return [0.25, 0.5, 0.25]
        sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((i - (size - 1) / 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [r / sum(raw) for r in raw]


def stencil(name: str, source: str, weights: list[float], border: str = "mirror", value: str = "v") -> None:
    """Separable filter of a piece with y, x, v on a square image: piece (y, x, s)."""
    r = len(weights) // 2
    offs = ",".join(f"({k - r}, {float(w)!r}::DOUBLE)" for k, w in enumerate(weights))
    if border == "mirror":  # reflect without repeating the edge, any number of times
        at = lambda c: f"(CASE WHEN w = 1 THEN 0 ELSE (w-1) - abs((({c} + d) % (2*(w-1)) + 2*(w-1)) % (2*(w-1)) - (w-1)) END)"
    else:
        at = lambda c: f"least(greatest({c} + d, 0), w-1)"
    piece(f"{name}_x", f"""
SELECT t.y, t.x, sum(t.k * s.{value}) AS s FROM (SELECT y, x, {at('x')} AS sx, k FROM {source}, (SELECT max(x)+1 AS w FROM {source}), (VALUES {offs}) AS o(d, k)) t
JOIN {source} s ON s.y = t.y AND s.x = t.sx GROUP BY t.y, t.x""")
    piece(name, f"""
SELECT t.y, t.x, sum(t.k * s.s) AS s FROM (SELECT y, x, {at('y')} AS sy, k FROM {source}, (SELECT max(y)+1 AS w FROM {source}), (VALUES {offs}) AS o(d, k)) t
JOIN {name}_x s ON s.x = t.x AND s.y = t.sy GROUP BY t.y, t.x""")


WHOLE = "CAST(round_even(round({}, 9), 0) AS BIGINT)"


def whole(e: str) -> str:
    return WHOLE.format(e)


BOX3, BOX11, MEAN225 = [1 / 3] * 3, [1 / 11] * 11, [1 / 15] * 5
stencil("sharp_soft", "gray8", gauss(5, 1.0))
piece("sharp", f"""
SELECT g.y, g.x, CAST(least(greatest(2*g.v - {whole('s')}, 0), 255) AS BIGINT) AS v FROM gray8 g JOIN sharp_soft s ON s.y = g.y AND s.x = g.x""")

# ---- measurement ----------------------------------------------------------------------------
piece("samples", """
SELECT b.bead_id, p.cycle, p.channel, p.v FROM (
  SELECT bead_id, y + dy AS y, x + dx AS x FROM beads, (VALUES (-2),(-1),(0),(1)) AS a(dy), (VALUES (-2),(-1),(0),(1)) AS b(dx)) b
JOIN pixels p ON p.y = b.y AND p.x = b.x WHERE p.channel > 0""")


def signals(name: str, samples: str, key: str = "bead_id", thresholds: bool = True) -> None:
    level = "CASE channel WHEN 1 THEN 320 WHEN 2 THEN 340 WHEN 3 THEN 360 END" if thresholds else "0"
    piece(name, f"""
SELECT *, CASE WHEN bg > 0 THEN (md-bg)/bg ELSE 0 END AS snr, md > {level} AS over, CAST(trunc(md) AS INTEGER) AS br, channel - 1 AS chan_rank
FROM (SELECT {key}, cycle, channel, CAST(median(v) AS DOUBLE) AS md, CAST(quantile_cont(v, 0.1) AS DOUBLE) AS bg FROM {samples} GROUP BY ALL)""")


def calls(name: str, sig: str, key: str = "bead_id", reject: str = "false") -> None:
    piece(name, f"""
SELECT {key}, cycle, CASE WHEN {reject} THEN NULL ELSE CAST(2 - max(br*10 + (2 - chan_rank)) % 10 AS INTEGER) END AS call FROM {sig} GROUP BY {key}, cycle""")


def wide(name: str, call: str, key: str = "bead_id") -> None:
    cols = ", ".join(f"coalesce(max(CASE WHEN cycle = {k} THEN call END), 255) AS cy{k}" for k in range(3))
    piece(name, f"SELECT {key}, {cols} FROM {call} GROUP BY {key}")


signals("sig", "samples")
calls("call_plain", "sig")
calls("call_every", "sig", reject="min(snr) > 1 - 0.1::DOUBLE")
calls("call_none", "sig", reject="max(snr) < 0.5")
calls("call_all", "sig", reject="NOT bool_and(over)")
calls("call_any", "sig", reject="NOT bool_or(over)")
wide("wide_every", "call_every")
piece("called", "SELECT b.*, cy0, cy1, cy2 FROM beads b JOIN wide_every w USING (bead_id) WHERE cy0 <> 255 AND cy1 <> 255 AND cy2 <> 255")
calls("call_both", "sig", reject="min(snr) > 1 - 0.1::DOUBLE OR NOT bool_and(over)")
wide("wide_both", "call_both")

piece("matched_samples", """
SELECT b.bead_id, p.cycle, p.channel, p.v FROM (
  SELECT bead_id, y + dy AS y, x + dx AS x FROM beads, (VALUES (-2),(-1),(0),(1)) AS a(dy), (VALUES (-2),(-1),(0),(1)) AS b(dx)) b
JOIN matched_px p ON p.y = b.y AND p.x = b.x""")
signals("msig", "matched_samples", thresholds=False)
calls("call_m", "msig", reject="min(snr) > 1 - 0.1::DOUBLE OR NOT bool_and(over)")
wide("wide_m", "call_m")
signals("msig_plain", "matched_samples")
piece("msig_older", """
SELECT bead_id, cycle, channel, chan_rank, CASE WHEN near2 THEN 0 ELSE br END AS br, CASE WHEN near40 THEN 0 ELSE snr END AS snr, over AND NOT near2 AS over
FROM msig_plain JOIN (SELECT bead_id, x < 4 OR y < 4 OR x >= w-4 OR y >= w-4 AS near2, x < 40 OR y < 40 OR x >= w-40 OR y >= w-40 AS near40 FROM beads, side_w) USING (bead_id)""")
calls("call_older", "msig_older", reject="max(snr) < 0.5 OR NOT bool_or(over)")
wide("wide_older", "call_older")
piece("region_matched", "SELECT r.label, p.cycle, p.channel, p.v FROM inner_region r JOIN matched_px p ON p.y = r.y AND p.x = r.x")
signals("rsig", "region_matched", key="label", thresholds=False)
calls("call_r", "rsig", key="label", reject="min(snr) > 1 - 0.1::DOUBLE OR NOT bool_and(over)")
wide("wide_r", "call_r", key="label")

# ---- cells ----------------------------------------------------------------------------------
piece("words", """
SELECT CAST(a*9 + b*3 + c AS INTEGER) AS protein_idx, a AS cy0, b AS cy1, c AS cy2, CAST(a*100 + b*10 + c AS BIGINT) AS code
FROM (VALUES (0),(1),(2)) AS ta(a), (VALUES (0),(1),(2)) AS tb(b), (VALUES (0),(1),(2)) AS tc(c)""")
piece("names", """
SELECT w.*, coalesce(k.protein, concat('Protein_', w.protein_idx)) AS name FROM words w LEFT JOIN color_code k USING (cy0, cy1, cy2)""")
piece("coded", "SELECT c.bead_id, c.x, c.y, w.protein_idx FROM called c JOIN words w USING (cy0, cy1, cy2)")
piece("near_protein", """
SELECT b.y AS py, b.x AS px, b.dy, b.dx, p.v FROM (
  SELECT y, x, dy, dx FROM (SELECT DISTINCT y, x FROM beads), (SELECT unnest(range(-7, 8)) AS dy), (SELECT unnest(range(-7, 8)) AS dx)) b
JOIN protein_pixels p ON p.y = b.y + b.dy AND p.x = b.x + b.dx""")
piece("intensity", """
SELECT px AS x, py AS y, CASE WHEN k = 225 THEN greatest(lifted, 1) ELSE med END AS value FROM (
  SELECT *, CASE WHEN around > 1.5::DOUBLE*mean AND med > 5000 THEN med - (0.8266::DOUBLE*(mean*(mean/around)) + 3970.1::DOUBLE) + 2000 ELSE med END AS lifted FROM (
    SELECT py, px, avg(v) FILTER (core) AS mean, CAST(median(v) FILTER (core) AS DOUBLE) AS med, avg(v) FILTER (NOT core) AS around, count(*) AS k
    FROM (SELECT *, abs(dy) <= 2 AND abs(dx) <= 2 AS core FROM near_protein) GROUP BY py, px))""")
piece("centroids", """
SELECT label, CAST(trunc(avg(x)) AS INTEGER) AS gx, CAST(trunc(avg(y)) AS INTEGER) AS gy FROM cell_pixels WHERE label > 0 GROUP BY label""")
piece("own_values", """
SELECT l.label, c.protein_idx, c.bead_id, i.value FROM coded c JOIN cell_pixels l ON l.y = c.y AND l.x = c.x AND l.label > 0
JOIN intensity i ON i.y = c.y AND i.x = c.x WHERE c.x > 7 AND c.y > 7 AND c.x < 22993 AND c.y < 22993""")
piece("nearest", """
SELECT c.label, b.protein_idx, (b.x-c.gx)*(b.x-c.gx) + (b.y-c.gy)*(b.y-c.gy) AS d2, b.x, b.y
FROM centroids c, coded b
QUALIFY row_number() OVER (PARTITION BY c.label, b.protein_idx ORDER BY (b.x-c.gx)*(b.x-c.gx) + (b.y-c.gy)*(b.y-c.gy), b.x, b.y) = 1""")


def imputed(name: str, top: str) -> None:
    ok = f"b.x > 7 AND b.y > 7 AND b.x < {top} - 7 AND b.y < {top} - 7"
    piece(f"{name}_own", f"""
SELECT l.label, b.protein_idx, b.x, b.y FROM coded b JOIN cell_pixels l ON l.y = b.y AND l.x = b.x AND l.label > 0, side_w WHERE {ok}""")
    piece(name, f"""
SELECT u.label, u.protein_idx, CAST(median(i.value) AS DOUBLE) AS value FROM (
  SELECT * FROM {name}_own UNION ALL
  SELECT b.label, b.protein_idx, b.x, b.y FROM nearest b ANTI JOIN {name}_own o ON o.label = b.label AND o.protein_idx = b.protein_idx, side_w WHERE {ok}) u
JOIN intensity i ON i.y = u.y AND i.x = u.x GROUP BY u.label, u.protein_idx""")


imputed("filled_small", "w")
imputed("filled_full", "23000")

# ---- registration ---------------------------------------------------------------------------
NCC = """CASE WHEN (k*saa - sa*sa) = 0 OR (k*sbb - sb*sb) = 0 THEN 0
  ELSE CAST(k*sab - sa*sb AS DOUBLE) / sqrt(CAST(k*saa - sa*sa AS DOUBLE) * CAST(k*sbb - sb*sb AS DOUBLE)) END"""


def shift_scores(name: str, reach: int) -> None:
    """NCC of every shift up to ``reach`` pixels."""
    piece(name, f"""
SELECT tile_id, dy, dx, {NCC} AS ncc FROM (
  SELECT m.tile_id, dy, dx, count(*)::HUGEINT AS k, sum(f.v) AS sa, sum(m.v) AS sb, sum(f.v*m.v) AS sab, sum(f.v*f.v) AS saa, sum(m.v*m.v) AS sbb
  FROM (SELECT m.*, dy, dx FROM moving_pixels m, (SELECT unnest(range(-{reach}, {reach + 1})) AS dy), (SELECT unnest(range(-{reach}, {reach + 1})) AS dx)) m
  JOIN bf f ON f.y = m.y - m.dy AND f.x = m.x - m.dx GROUP BY ALL)""")


shift_scores("shift_scores", 2)
shift_scores("wide_scores", 6)


def best(name: str, where: str, scores: str = "shift_scores") -> None:
    piece(name, f"""
SELECT tile_id, CAST(dy AS INTEGER) AS dy, CAST(dx AS INTEGER) AS dx, ncc FROM {scores} WHERE {where}
QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY round(ncc, 9) DESC, dy, dx) = 1""")


best("best0", "dy = 0 AND dx = 0")
best("best1", "abs(dy) <= 1 AND abs(dx) <= 1")
best("best2", "true")
best("best6", "true", "wide_scores")
piece("tile4", """
SELECT k.cycle, CAST(i*4 + j AS INTEGER) AS tile_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, (2*i+1)/8*h AS cx, (2*j+1)/8*h AS cy, 0.125::DOUBLE*h AS half, h
FROM (SELECT cycle, max(y)+1 AS h FROM pixels GROUP BY cycle) k, (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j)""")
piece("windows4", """
SELECT *, CAST(least(greatest(round_even(cy, 0) - reach, 0), h) AS BIGINT) AS y0, CAST(least(greatest(round_even(cy, 0) + reach, 0), h) AS BIGINT) AS y1,
  CAST(least(greatest(round_even(cx, 0) - reach, 0), h) AS BIGINT) AS x0, CAST(least(greatest(round_even(cx, 0) + reach, 0), h) AS BIGINT) AS x1,
  CASE WHEN trunc(cy - reach) BETWEEN 0 AND h THEN 3 ELSE 0 END AS ymin, CASE WHEN trunc(cy + reach) BETWEEN 0 AND h THEN 3 ELSE 0 END AS ymax,
  CASE WHEN trunc(cx - reach) BETWEEN 0 AND h THEN 3 ELSE 0 END AS xmin, CASE WHEN trunc(cx + reach) BETWEEN 0 AND h THEN 3 ELSE 0 END AS xmax
FROM (SELECT *, round_even(half, 0) + 3 AS reach FROM tile4)""")
piece("core4", """
SELECT tile_id, CAST(trunc(cy - trunc(half)) AS BIGINT) + r AS ty, CAST(trunc(cx - trunc(half)) AS BIGINT) + c AS tx,
  y0, y1, x0, x1, y0 + ymin + r AS sy, x0 + xmin + c AS sx
FROM windows4, (SELECT unnest(range(2*CAST(trunc((SELECT max(half) FROM tile4)) AS BIGINT))) AS r), (SELECT unnest(range(2*CAST(trunc((SELECT max(half) FROM tile4)) AS BIGINT))) AS c)
WHERE cycle = 0""")
piece("pairs", """
SELECT (y // 40)*1000000 + x // 40 AS tile_id, bead_id, x, y,
  1.01::DOUBLE*x - 0.02::DOUBLE*y + 3 + (bead_id % 7)/100.0::DOUBLE + CASE WHEN bead_id % 9 = 4 THEN 25 ELSE 0 END AS u,
  0.03::DOUBLE*x + 0.98::DOUBLE*y - 2 + (bead_id % 5)/100.0::DOUBLE AS v FROM beads""")
piece("fit", """
SELECT tile_id, a, b, mu - a*mx - b*my AS tx, c, d, mv - c*mx - d*my AS ty FROM (
  SELECT *, (cxu*cyy - cyu*cxy)/det AS a, (cyu*cxx - cxu*cxy)/det AS b, (cxv*cyy - cyv*cxy)/det AS c, (cyv*cxx - cxv*cxy)/det AS d FROM (
    SELECT *, cxx*cyy - cxy*cxy AS det FROM (
      SELECT tile_id, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, var_pop(x) AS cxx, var_pop(y) AS cyy, covar_pop(x, y) AS cxy,
        covar_pop(x, u) AS cxu, covar_pop(y, u) AS cyu, covar_pop(x, v) AS cxv, covar_pop(y, v) AS cyv FROM pairs GROUP BY tile_id)) WHERE abs(det) > 1e-9)""")


def points(name: str, source: str) -> None:
    """Key points per tile of the pixels above 10000."""
    piece(f"{name}_fg", f"SELECT tile_id, y, x FROM {source} WHERE v > 10000")
    piece(f"{name}_raw", f"""
  SELECT tile_id, y, x, y*{STRIDE}+x AS label FROM {name}_fg
  UNION
  SELECT t.tile_id, t.y, t.x, min(c.label) AS label
  FROM {name}_raw c, (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) AS o(dy, dx), recurring.{name}_raw t
  WHERE t.tile_id = c.tile_id AND t.y = c.y + o.dy AND t.x = c.x + o.dx AND c.label < t.label GROUP BY t.tile_id, t.y, t.x""",
          head=f"{name}_raw(tile_id, y, x, label) USING KEY (tile_id, y, x)")
    outline(f"{name}_outline", f"{name}_raw", "tile_id")
    piece(name, f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY area DESC, x DESC, y DESC) AS rank FROM (
  SELECT tile_id, CAST(trunc(round(m10/m00, 9)) AS BIGINT) AS x, CAST(trunc(round(m01/m00, 9)) AS BIGINT) AS y, m00 AS area, 4*pi()*m00/(length*length) AS circularity
  FROM {name}_outline WHERE m00 > 0 AND length > 0 AND NOT hole AND parent IS NULL) WHERE circularity >= 0.5) WHERE rank <= 500""")


points("fixed_points", "tiled_bf")
points("moving_points", "moving_pixels")

# ---- the queries ----------------------------------------------------------------------------
oracle("s01_list_stacks", """
SELECT DISTINCT path FROM listing WHERE regexp_matches(path, '^/d/[^/]*$') AND regexp_matches(lower(path), '\\.tiff?$')
AND path NOT IN (SELECT path FROM listing WHERE seen)""")
oracle("s02_stack_info", """
SELECT cycle, count(DISTINCT channel) AS n_channels, max(y)+1 AS height, max(x)+1 AS width, min(v) AS min_v, max(v) AS max_v,
CASE WHEN max(v) <= 255 THEN 'uint8' WHEN max(v) <= 65535 THEN 'uint16' ELSE 'int32' END AS dtype FROM pixels GROUP BY cycle""")
oracle("s03_load_stack", "SELECT y, x, cycle, channel, v FROM pixels WHERE cycle = 1")
oracle("s04_crop", "SELECT y, x, cycle, channel, v FROM pixels WHERE cycle = 0 AND y < (SELECT w*9//10 FROM side_w) AND x < (SELECT w*9//10 FROM side_w)")
oracle("s05_export_stacks", """
SELECT CASE WHEN prefix = '' THEN '' ELSE prefix || '_' END || 'c' || cycle || '.ome.tif' AS out_name, channel, y, x, v, 'CYX' AS axes, 'um' AS unit,
0.325::DOUBLE AS "PhysicalSizeX", 0.325::DOUBLE AS "PhysicalSizeY" FROM shown_pixels JOIN stack_files USING (cycle) WHERE y < max_size AND x < max_size""")
BEAD_EXPORT = """
SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, cy0, cy1, cy2,
concat('(', y-2, ', ', x-2, ', ', y+1, ', ', x+1, ')') AS bbox FROM called"""
oracle("s06_bead_export", BEAD_EXPORT)
oracle("s08_bead_reload", BEAD_EXPORT)

oracle("m01_apply_metadata", """
SELECT path, slide, n_channels, reference_channel, is_reference, working_ndim, CASE WHEN slide % 4 = 1 THEN 'run' ELSE prefix END AS prefix,
CASE WHEN slide % 4 = 1 AND is_reference THEN 50 ELSE max_size END AS max_size FROM catalogue""")
oracle("m02_same_metadata", "SELECT slide, count(DISTINCT (n_channels, prefix)) = 1 AS all_same FROM catalogue GROUP BY slide")
oracle("m03_status", """
SELECT path, slide, is_reference, CASE WHEN is_reference THEN 'Reference' WHEN working_ndim = 0 THEN 'Raw' WHEN working_ndim = 2 THEN 'Shade Corrected' ELSE 'Aligned' END AS status
FROM (SELECT path, slide, working_ndim, CASE WHEN slide % 3 > 0 THEN path = min(path) OVER (PARTITION BY slide) ELSE is_reference END AS is_reference FROM catalogue)""")
oracle("m04_cycle_order", """
SELECT slide, path, CAST(row_number() OVER (PARTITION BY slide ORDER BY is_reference DESC, path) - 1 AS INTEGER) AS cycle FROM catalogue""")
oracle("m05_fluorescent_channels", """
SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY channel) - 1 AS INTEGER) AS chan_rank, CAST(channel AS INTEGER) AS channel
FROM (SELECT path, reference_channel, unnest(range(n_channels)) AS channel FROM catalogue) WHERE channel <> reference_channel""")
oracle("m06_check_reference", """
SELECT path, reference_channel < n_channels AS valid, CASE WHEN reference_channel < n_channels THEN reference_channel ELSE 0 END AS used_channel FROM catalogue""")
oracle("m07_sort_files", "SELECT * FROM catalogue ORDER BY max_size")
oracle("m08_working_image", "SELECT y, x, cycle, channel, v FROM shown_pixels")
oracle("m09_channel_index", """
SELECT path, name, coalesce(CAST(nullif(regexp_extract(name, '(\\d+)', 1), '') AS INTEGER) - 1, reference_channel) AS reference_channel
FROM (SELECT path, reference_channel, CASE WHEN max_size % 3 = 0 THEN 'BF' ELSE concat('Channel ', max_size, 'x2') END AS name FROM catalogue)""")

RANGED = "FROM pixels JOIN (SELECT cycle, channel, min(v) AS mn, max(v) AS mx FROM pixels GROUP BY ALL) USING (cycle, channel)"


def ranged(lo: float, hi: float) -> str:
    return (f"FROM pixels JOIN (SELECT cycle, channel, CAST(quantile_cont(v, {lo}) AS DOUBLE) AS lo, CAST(quantile_cont(v, {hi}) AS DOUBLE) AS hi "
            "FROM pixels GROUP BY ALL) USING (cycle, channel)")


oracle("p01_to_8bit", f"""
SELECT y, x, cycle, channel, coalesce(CAST(trunc(CAST(v - mn AS FLOAT) * CAST(255.0::DOUBLE / CAST(nullif(mx - mn, 0) AS FLOAT) AS FLOAT)) AS INTEGER), 0) AS v {RANGED}""")
oracle("p02_scale", f"""
SELECT y, x, cycle, channel, CAST(trunc((v - mn) * (1.0::DOUBLE / nullif(mx - mn, 0) * 255)) AS INTEGER) AS v {RANGED}""")
oracle("p03_contrast_unit", f"""
SELECT y, x, cycle, channel, round(CASE WHEN hi - lo < 1e-12 THEN 0 ELSE (least(greatest(v, lo), hi) - lo) / (hi - lo) END, 6) AS v {ranged(0.02, 0.98)}""")
oracle("p04_contrast_8bit", f"""
SELECT y, x, cycle, channel, CAST(trunc((least(greatest(v, lo), hi) - lo) / nullif(hi - lo, 0) * 255) AS INTEGER) AS v {ranged(0.5, 0.99)}""")
oracle("p05_contrast_clean", """
WITH dirty AS (SELECT y, x, cycle, channel, CASE (y*31 + x*17) % 97 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 255 WHEN 2 THEN 0 ELSE v END AS v FROM pixels)
SELECT y, x, cycle, channel, CAST(trunc((least(greatest(v, lo), hi) - lo) / (hi - lo + 1e-8) * 255) AS INTEGER) AS v
FROM dirty JOIN (SELECT cycle, channel, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM dirty GROUP BY ALL) USING (cycle, channel)""")
oracle("p06_binary_threshold", "SELECT y, x, cycle, channel, CASE WHEN v >= 1500 THEN 255 ELSE 0 END AS v FROM pixels")
oracle("p07_percentile_threshold", f"SELECT y, x, cycle, channel, CASE WHEN v >= hi THEN 255 ELSE 0 END AS v {ranged(0.2, 0.8)}")
oracle("p08_otsu", """
SELECT o.cycle, o.channel, o.level, count(*) AS n_above FROM otsu o JOIN pixels p ON p.cycle = o.cycle AND p.channel = o.channel AND p.v > o.level GROUP BY ALL""")
LIGHT = """CAST(round_even(round((CASE WHEN lin > 0.008856::DOUBLE THEN 116*pow(lin, 1.0::DOUBLE/3) - 16 ELSE 903.3::DOUBLE*lin END) * 2.55::DOUBLE, 9), 0) AS BIGINT)"""
piece("light", f"""
SELECT y, x, {LIGHT} AS l FROM (SELECT y, x, CASE WHEN s <= 0.04045::DOUBLE THEN s/12.92::DOUBLE ELSE pow((s+0.055::DOUBLE)/1.055::DOUBLE, 2.4::DOUBLE) END AS lin
  FROM (SELECT y, x, least(v // 255, 255)/255.0::DOUBLE AS s FROM bf))""")
piece("stretched", """
SELECT y, x, coalesce(CAST(trunc(255.0::DOUBLE*(l - mn)/nullif(mx - mn, 0)) AS BIGINT), 0) AS v FROM light, (SELECT min(l) AS mn, max(l) AS mx FROM light)""")
piece("eq_grid", "SELECT w, g, CAST(ceil(w/g) AS BIGINT) AS t FROM (SELECT w, greatest(w // 7, 1) AS g FROM side_w)")
piece("eq_hist", """
SELECT ay // t AS ti, ax // t AS tj, v AS bin, count(*) AS k FROM (
  SELECT ay, ax, t, CASE WHEN ay < w THEN ay ELSE 2*(w-1) - ay END AS y, CASE WHEN ax < w THEN ax ELSE 2*(w-1) - ax END AS x
  FROM (SELECT unnest(range(g*t)) AS ay, w, t FROM eq_grid), (SELECT unnest(range(g*t)) AS ax FROM eq_grid)) JOIN stretched USING (y, x) GROUP BY ALL""")
piece("eq_lut", """
SELECT ti, tj, q, least(round_even(round((c + (excess // 256)*(q+1) + CASE WHEN excess % 256 > 0 THEN least(excess % 256, q // greatest(256 // (excess % 256), 1) + 1) ELSE 0 END) * (255.0::DOUBLE/area), 9), 0), 255) AS lut
FROM (SELECT ti, tj, q, area, sum(least(k, lim)) OVER (PARTITION BY ti, tj ORDER BY q) AS c, CAST(sum(k - least(k, lim)) OVER (PARTITION BY ti, tj) AS BIGINT) AS excess
  FROM (SELECT b.ti, b.tj, b.q, t*t AS area, greatest(2*t*t // 256, 1) AS lim, coalesce(h.k, 0) AS k
        FROM (SELECT DISTINCT ti, tj, q FROM eq_hist, (SELECT unnest(range(256)) AS q)) b LEFT JOIN eq_hist h ON h.ti = b.ti AND h.tj = b.tj AND h.bin = b.q, eq_grid))""")
piece("eq_blend", """
SELECT p.y, p.x, CAST(round_even(round(sum(p.k * l.lut), 9), 0) AS BIGINT) AS v FROM (
  SELECT y, x, v, CAST(least(greatest(floor(fy) + dy, 0), g-1) AS BIGINT) AS ti, CAST(least(greatest(floor(fx) + dx, 0), g-1) AS BIGINT) AS tj,
    (CASE dy WHEN 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END) * (CASE dx WHEN 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END) AS k
  FROM (SELECT *, y/t - 0.5::DOUBLE AS fy, x/t - 0.5::DOUBLE AS fx FROM stretched, eq_grid), (VALUES (0),(1)) AS a(dy), (VALUES (0),(1)) AS b(dx)) p
JOIN eq_lut l ON l.ti = p.ti AND l.tj = p.tj AND l.q = p.v GROUP BY p.y, p.x""")
oracle("p09_shading", """
SELECT y, x, 256 * CAST(round_even(round(least(greatest(CASE WHEN lin <= 0.0031308::DOUBLE THEN 12.92::DOUBLE*lin ELSE 1.055::DOUBLE*pow(lin, 1.0::DOUBLE/2.4::DOUBLE) - 0.055::DOUBLE END, 0), 1) * 255, 9), 0) AS INTEGER) AS v
FROM (SELECT y, x, CASE WHEN big > 8 THEN pow((big+16)/116, 3) ELSE big/903.3::DOUBLE END AS lin FROM (SELECT y, x, v/2.55::DOUBLE AS big FROM eq_blend))""")
oracle("p10_match_histograms", "SELECT y, x, cycle, channel, round(v, 6) AS v FROM matched_px")

stencil("wide_soft", "fluor1", gauss(101))
piece("fluor1", "SELECT y, x, v FROM pixels WHERE cycle = 0 AND channel = 1")
oracle("p11_background", f"""
SELECT y, x, greatest(v - CAST(trunc({whole('s')} * 0.5::DOUBLE) AS BIGINT), 0) AS v FROM fluor1 JOIN wide_soft USING (y, x)""")
for _name, _w in (("box3", BOX3), ("mean225", MEAN225), ("gauss3", gauss(3)), ("gauss5", gauss(5, 1.0)), ("gauss11", gauss(11))):
    stencil(f"st_{_name}", "bf", _w)
oracle("p12_stencils", """
SELECT y, x, round(a.s, 4) AS box3, round(b.s, 4) AS mean225, round(c.s, 4) AS gauss3, round(d.s, 4) AS gauss5, round(e.s, 4) AS gauss11
FROM st_box3 a JOIN st_mean225 b USING (y, x) JOIN st_gauss3 c USING (y, x) JOIN st_gauss5 d USING (y, x) JOIN st_gauss11 e USING (y, x)""")
oracle("p13_unsharp", "SELECT y, x, v FROM sharp")
piece("inverted", """
SELECT y, x, 255 - CAST(trunc((least(greatest(CAST(v AS DOUBLE), lo), hi) - lo) / (hi - lo + 1e-8) * 255) AS BIGINT) AS v
FROM sharp, (SELECT CAST(quantile_cont(v, 0.02) AS DOUBLE) AS lo, CAST(quantile_cont(v, 0.98) AS DOUBLE) AS hi FROM sharp)""")
stencil("inv_soft", "inverted", gauss(5, 1.0))
piece("inv_sharp", f"""
SELECT y, x, CAST(least(greatest(2*v - {whole('s')}, 0), 255) AS BIGINT) AS v FROM inverted JOIN inv_soft USING (y, x)""")
stencil("inv_mean", "inv_sharp", BOX11, "replicate")
piece("inv_binary", f"SELECT y, x, CASE WHEN v > {whole('s')} - 50 THEN 255 ELSE 0 END AS v FROM inv_sharp JOIN inv_mean USING (y, x)")
piece("inv_dark", "SELECT y, x FROM inv_binary WHERE v = 0")
labelled("dark_region", "inv_dark")
oracle("p14_bead_mask", """
SELECT b.y, b.x, CASE WHEN d.y IS NOT NULL THEN 255 ELSE b.v END AS v FROM inv_binary b LEFT JOIN (
  SELECT y, x FROM dark_region WHERE label IN (SELECT label FROM dark_region GROUP BY label HAVING count(*) >= 20)) d ON d.y = b.y AND d.x = b.x""")
stencil("g8_mean", "gray8", BOX11, "replicate")
stencil("g8_gauss", "gray8", gauss(11), "replicate")
oracle("p15_adaptive_threshold", f"""
SELECT y, x, CASE WHEN v > {whole('a.s')} - 50 THEN 255 ELSE 0 END AS by_mean, CASE WHEN v > {whole('b.s')} - 2 THEN 255 ELSE 0 END AS by_gauss
FROM gray8 JOIN g8_mean a USING (y, x) JOIN g8_gauss b USING (y, x)""")


def resized(name: str, source: str, n: str, tn: str) -> None:
    """Bilinear resize of a square piece with side n (source) to tn, both one-row scalars."""
    s = lambda c: f"least(greatest(({c} + 0.5::DOUBLE) * (CAST(n AS DOUBLE) / tn) - 0.5::DOUBLE, 0), n - 1)"
    piece(name, f"""
SELECT t.y, t.x, sum(t.k * s.v) AS s FROM (
  SELECT y, x, least(floor(sy) + dy, n-1) AS py, least(floor(sx) + dx, n-1) AS px,
    (CASE dy WHEN 0 THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END) * (CASE dx WHEN 0 THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END) AS k
  FROM (SELECT y, x, n, {s('y')} AS sy, {s('x')} AS sx FROM (SELECT unnest(range(tn)) AS y, n, tn FROM (SELECT ({n}) AS n, ({tn}) AS tn)), (SELECT unnest(range(({tn}))) AS x)),
    (VALUES (0),(1)) AS a(dy), (VALUES (0),(1)) AS b(dx)) t
JOIN {source} s ON s.y = t.py AND s.x = t.px WHERE t.k > 0 GROUP BY t.y, t.x""")


resized("shrunk", "protein_pixels", "SELECT w FROM side_w", "SELECT w // 10 FROM side_w")
piece("small_img", f"SELECT y, x, {whole('s')} AS v FROM shrunk")
stencil("small_soft", "small_img", MEAN225)
piece("small_blur", f"SELECT y, x, {whole('s')} AS v FROM small_soft")
piece("small_dark", "SELECT y, x FROM small_blur, (SELECT quantile_cont(v, 0.2) AS t FROM small_blur) WHERE v < t")
labelled("small_region", "small_dark")
piece("small_spots", """
SELECT b.y, b.x, CASE WHEN d.y IS NULL THEN 0 ELSE 255 END AS v FROM small_blur b LEFT JOIN (
  SELECT y, x FROM small_region WHERE label IN (SELECT label FROM small_region GROUP BY label HAVING count(*) >= 3)) d ON d.y = b.y AND d.x = b.x""")
resized("enlarged", "small_spots", "SELECT w // 10 FROM side_w", "SELECT w FROM side_w")
oracle("p16_tissue_mask", f"SELECT y, x, {whole('s')} = 0 AND v <> 0 AS keep FROM protein_pixels JOIN enlarged USING (y, x)")
oracle("p17_ncc", f"""
SELECT tile_id, round({NCC}, 6) AS ncc FROM (
  SELECT CAST(m.tile_id AS INTEGER) AS tile_id, count(*)::HUGEINT AS k, sum(f.v) AS sa, sum(m.v) AS sb, sum(f.v*m.v) AS sab, sum(f.v*f.v) AS saa, sum(m.v*m.v) AS sbb
  FROM moving_pixels m JOIN bf f ON f.y = m.y AND f.x = m.x GROUP BY ALL)""")
oracle("p18_fit_to_shape", """
SELECT b.y, b.x, s.v FROM bf b LEFT JOIN (
  SELECT y + shift AS y, x + shift AS x, v FROM bf, (SELECT w*3//5 AS part, (w - w*3//5) // 2 AS shift FROM side_w) WHERE y < part AND x < part) s
ON s.y = b.y AND s.x = b.x""")
piece("discs", """
SELECT DISTINCT y + dy AS y, x + dx AS x FROM beads, (SELECT unnest(range(-3, 4)) AS dy), (SELECT unnest(range(-3, 4)) AS dx) WHERE dy*dy + dx*dx <= 9""")
oracle("p19_black_out", "SELECT b.y, b.x, CASE WHEN d.y IS NULL THEN b.v ELSE 0 END AS v FROM bf b LEFT JOIN discs d ON d.y = b.y AND d.x = b.x")
piece("unit_gray", """
SELECT y, x, CASE WHEN hi - lo < 1e-12 THEN 0 ELSE (least(greatest(CAST(v AS DOUBLE), lo), hi) - lo) / (hi - lo) END AS u
FROM gray8, (SELECT CAST(quantile_cont(v, 0.3) AS DOUBLE) AS lo, CAST(quantile_cont(v, 0.99) AS DOUBLE) AS hi FROM gray8)""")
oracle("p19_overlay", """
SELECT g.y, g.x, CASE WHEN b.y IS NULL THEN v ELSE 255 END AS r, CASE WHEN b.y IS NULL THEN v ELSE 0 END AS g, CASE WHEN b.y IS NULL THEN v ELSE 0 END AS b
FROM (SELECT y, x, coalesce(CAST(trunc(CAST(u - mn AS FLOAT) * CAST(255.0::DOUBLE / CAST(nullif(mx - mn, 0) AS FLOAT) AS FLOAT)) AS INTEGER), 0) AS v
      FROM unit_gray, (SELECT min(u) AS mn, max(u) AS mx FROM unit_gray)) g
LEFT JOIN beads b ON b.y = g.y AND b.x = g.x""")
oracle("p20_tint", f"""
SELECT channel, y, x, r, g, b, alpha FROM (
  SELECT cycle, channel, y, x, coalesce(CAST(trunc(CAST(v - mn AS FLOAT) * CAST(255.0::DOUBLE / CAST(nullif(mx - mn, 0) AS FLOAT) AS FLOAT)) AS INTEGER), 0) AS alpha {RANGED})
JOIN (VALUES (0,27,158,119),(1,217,95,2),(2,117,112,179),(3,231,41,138)) AS pal(channel, r, g, b) USING (channel) WHERE cycle = 0""")

oracle("g01_closing", """
WITH marked AS (SELECT DISTINCT y + dy AS y, x + dx AS x FROM bright, (VALUES (-1),(0),(1)) AS a(dy), (VALUES (-1),(0),(1)) AS b(dx))
SELECT y + dy AS y, x + dx AS x FROM marked, (VALUES (-1),(0),(1)) AS a(dy), (VALUES (-1),(0),(1)) AS b(dx) GROUP BY ALL HAVING count(*) = 9""")
oracle("g02_clear_border", "SELECT label, y, x FROM inner_region")
oracle("g03_components", "SELECT label, y, x FROM region")
oracle("g04_measures", """
SELECT label, area, y1, x1, y2, x2, round(cy, 6) AS cy, round(cx, 6) AS cx, round(wy, 6) AS wy, round(wx, 6) AS wx FROM region_table""")
oracle("g05_area_opening", "SELECT label, y, x FROM region WHERE label IN (SELECT label FROM region_table WHERE area >= 10)")
oracle("g06_contour_centres", """
SELECT label, hole, parent, m00, round(m10, 6) AS m10, round(m01, 6) AS m01, round(length, 6) AS length,
coalesce(CAST(round_even(round(m10/nullif(m00, 0), 9), 0) AS BIGINT), 0) AS x, coalesce(CAST(round_even(round(m01/nullif(m00, 0), 9), 0) AS BIGINT), 0) AS y FROM contour""")
oracle("g07_key_points", """
SELECT CAST(tile_id AS INTEGER) AS tile_id, CAST(rank AS INTEGER) AS rank, x, y, area, round(circularity, 6) AS circularity FROM fixed_points""")
stencil("soft3", "gray8", gauss(3))
piece("smooth8", f"SELECT y, x, {whole('s')} AS v FROM soft3")
stencil("smooth11", "smooth8", gauss(11), "replicate")
piece("locally_bright", f"SELECT y, x FROM smooth8 JOIN smooth11 USING (y, x) WHERE v > {whole('s')} - 2")
labelled("local_region", "locally_bright")
outline("local_outline", "local_region")
oracle("g07_find_points", """
SELECT CAST(rank AS INTEGER) AS rank, x, y, area, round(circularity, 6) AS circularity FROM (
  SELECT *, row_number() OVER (ORDER BY area DESC, x DESC, y DESC) AS rank FROM (
    SELECT CAST(trunc(round(m10/m00, 9)) AS BIGINT) AS x, CAST(trunc(round(m01/m00, 9)) AS BIGINT) AS y, m00 AS area, 4*pi()*m00/(length*length) AS circularity
    FROM local_outline WHERE m00 > 0 AND length > 0 AND NOT hole AND parent IS NULL) WHERE circularity >= 0.5) WHERE rank <= 500""")
oracle("g08_distinct_beads", """
SELECT CAST(round_even(wx, 0) AS BIGINT) AS x, CAST(round_even(wy, 0) AS BIGINT) AS y FROM region_table UNION SELECT x, y FROM beads""")
piece("found_beads", """
SELECT DISTINCT CAST(round_even(wx, 0) AS BIGINT) AS x, CAST(round_even(wy, 0) AS BIGINT) AS y FROM region_table WHERE label IN (SELECT label FROM inner_region)""")
piece("blacked8", """
SELECT g.y, g.x, CASE WHEN d.y IS NULL THEN g.v ELSE 0 END AS v FROM gray8 g LEFT JOIN (
  SELECT DISTINCT y + dy AS y, x + dx AS x FROM found_beads, (SELECT unnest(range(-3, 4)) AS dy), (SELECT unnest(range(-3, 4)) AS dx) WHERE dy*dy + dx*dx <= 9) d
ON d.y = g.y AND d.x = g.x""")
stencil("black_soft", "blacked8", BOX3)
piece("left_over", f"SELECT y, x FROM black_soft WHERE {whole('s')} >= 120")
labelled("left_region", "left_over")
outline("left_contour", "left_region")
oracle("g09_second_pass", """
SELECT coalesce(CAST(round_even(round(m10/nullif(m00, 0), 9), 0) AS BIGINT), 0) AS x, coalesce(CAST(round_even(round(m01/nullif(m00, 0), 9), 0) AS BIGINT), 0) AS y FROM left_contour
UNION SELECT x, y FROM found_beads""")
oracle("g10_edge_filter", """
SELECT bead_id, form FROM beads, side_w, (VALUES ('strict'), ('mask')) AS f(form)
WHERE x + 4 < w AND y + 4 < w AND CASE form WHEN 'strict' THEN x > 4 AND y > 4 ELSE x >= 4 AND y >= 4 END""")
oracle("g11_range_filter", """
SELECT bead_id, x, y, 'meant' AS form FROM beads, side_w WHERE x > w//10 AND x < w*4//5 AND y > w//10 AND y < w*4//5 UNION ALL
SELECT bead_id, CASE WHEN ok THEN x ELSE 0 END, CASE WHEN ok THEN y ELSE 0 END, 'literal' FROM (SELECT beads.*, (x > w//10 AND x < w*4//5 AND y > w//10) OR x < w*4//5 AS ok FROM beads, side_w)""")

oracle("t01_tile_grid", "SELECT cycle, tile_id, i, j, cx, cy, half FROM tile4")
oracle("t02_pixels_by_tile", """
SELECT tile_id, y, x, v FROM bf JOIN (SELECT * FROM windows4 WHERE cycle = 0) t ON y >= y0 AND y < y1 AND x >= x0 AND x < x1""")
oracle("t03_tile_windows", "SELECT cycle, tile_id, y0, y1, x0, x1, ymin, ymax, xmin, xmax FROM windows4")
oracle("t04_pair_tiles", """
SELECT CAST(m.tile_id AS INTEGER) AS tile_id, m.y, m.x, f.v AS fixed, m.v AS moving FROM moving_pixels m JOIN tiled_bf f ON f.tile_id = m.tile_id AND f.y = m.y AND f.x = m.x""")
oracle("t05_pair_points", """
SELECT CAST(tile_id AS INTEGER) AS tile_id, CAST(rank AS INTEGER) AS rank, f.x AS u, f.y AS v, m.x, m.y FROM fixed_points f JOIN moving_points m USING (tile_id, rank)
QUALIFY count(*) OVER (PARTITION BY tile_id) >= 4""")
oracle("t06_two_nearest", """
WITH moving AS (SELECT label, vec_id AS q_id, list_transform(embedding, lambda v, i: CAST(v AS DOUBLE) + 0.1::DOUBLE * ((vec_id + i - 1) % 5 - 2)) AS q FROM embeddings),
ranked AS (SELECT m.label, q_id, vec_id AS c_id, list_distance(q, CAST(embedding AS DOUBLE[])) AS d FROM moving m JOIN embeddings e ON e.label = m.label
  QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY list_distance(q, CAST(embedding AS DOUBLE[])), vec_id) <= 2),
best AS (SELECT label, q_id, arg_min(c_id, d) AS c_id, min(d) AS d1, max(d) AS d2 FROM ranked GROUP BY label, q_id HAVING count(*) = 2)
SELECT label, q_id, c_id, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM best WHERE d1 < 0.7::DOUBLE*d2 QUALIFY count(*) OVER (PARTITION BY label) >= 4""")
oracle("t07_affine", """
SELECT tile_id, round(a, 6) AS a, round(b, 6) AS b, round(tx, 6) AS tx, round(c, 6) AS c, round(d, 6) AS d, round(ty, 6) AS ty FROM fit""")


def affine(name: str, source: str, keys: str) -> None:
    """Least-squares affine of the pairs (x, y) -> (u, v) of each group."""
    piece(name, f"""
SELECT {keys}, a, b, mu - a*mx - b*my AS tx, c, d, mv - c*mx - d*my AS ty FROM (
  SELECT *, (cxu*cyy - cyu*cxy)/det AS a, (cyu*cxx - cxu*cxy)/det AS b, (cxv*cyy - cyv*cxy)/det AS c, (cyv*cxx - cxv*cxy)/det AS d FROM (
    SELECT *, cxx*cyy - cxy*cxy AS det FROM (
      SELECT {keys}, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, k*var_pop(x) AS cxx, k*var_pop(y) AS cyy, k*covar_pop(x, y) AS cxy,
        k*covar_pop(x, u) AS cxu, k*covar_pop(y, u) AS cyu, k*covar_pop(x, v) AS cxv, k*covar_pop(y, v) AS cyv
      FROM (SELECT *, count(*) OVER (PARTITION BY {keys}) AS k FROM {source}) GROUP BY {keys}, k)) WHERE abs(det) > 1e-9)""")


piece("ranked_pairs", """
SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY bead_id) AS rank, count(*) OVER (PARTITION BY tile_id) AS n FROM pairs""")
piece("draws", """
SELECT DISTINCT tile_id, try, (s*s*7919 + s*104729) % 1000003 % n + 1 AS rank FROM (
  SELECT tile_id, n, try, 3*try + m + 1 AS s FROM (SELECT DISTINCT tile_id, n FROM ranked_pairs WHERE n >= 4), (SELECT unnest(range(64)) AS try), (VALUES (0),(1),(2)) AS t(m))""")
piece("triples", "SELECT d.try, p.* FROM draws d JOIN ranked_pairs p ON p.tile_id = d.tile_id AND p.rank = d.rank")
affine("models", "triples", "tile_id, try")
RESIDUAL = "(a*x + b*y + tx - u)*(a*x + b*y + tx - u) + (c*x + d*y + ty - v)*(c*x + d*y + ty - v) <= 9"
piece("best_model", f"""
SELECT tile_id, a, b, tx, c, d, ty FROM models JOIN ranked_pairs USING (tile_id) GROUP BY tile_id, try, a, b, tx, c, d, ty
QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY count(*) FILTER ({RESIDUAL}) DESC, try) = 1""")
piece("inliers", f"SELECT p.tile_id, x, y, u, v FROM ranked_pairs p JOIN best_model b ON b.tile_id = p.tile_id WHERE {RESIDUAL}")
affine("robust", "inliers", "tile_id")
oracle("t07_affine_robust", """
SELECT tile_id, round(a, 6) AS a, round(b, 6) AS b, round(tx, 6) AS tx, round(c, 6) AS c, round(d, 6) AS d, round(ty, 6) AS ty FROM robust""")
oracle("t08_shift_search", "SELECT CAST(tile_id AS INTEGER) AS tile_id, dy, dx, round(ncc, 6) AS ncc FROM best2")
oracle("t08_shift_pyramid", "SELECT CAST(tile_id AS INTEGER) AS tile_id, dy, dx, round(ncc, 6) AS ncc FROM best6")
oracle("t09_cascade", """
SELECT CAST(tile_id AS INTEGER) AS tile_id, CASE WHEN use3 THEN 3 ELSE s2 END AS stage, CASE WHEN use3 THEN y3 ELSE y2 END AS dy, CASE WHEN use3 THEN x3 ELSE x2 END AS dx,
  round(CASE WHEN use3 THEN n3 ELSE b2 END, 6) AS ncc FROM (
  SELECT *, b2 < 0.6 AND n3 > b2 AS use3 FROM (
    SELECT *, CASE WHEN use2 THEN n2 ELSE b1 END AS b2, CASE WHEN use2 THEN 2 WHEN n1 > 0 THEN 1 END AS s2, CASE WHEN use2 THEN by2 WHEN n1 > 0 THEN 0 END AS y2,
      CASE WHEN use2 THEN bx2 WHEN n1 > 0 THEN 0 END AS x2 FROM (
      SELECT a.tile_id, a.ncc AS n1, greatest(a.ncc, 0) AS b1, b.ncc AS n2, b.dy AS by2, b.dx AS bx2, c.ncc AS n3, c.dy AS y3, c.dx AS x3,
        greatest(a.ncc, 0) < 0.5 AND b.ncc > greatest(a.ncc, 0) AS use2
      FROM best0 a JOIN best1 b USING (tile_id) JOIN best2 c USING (tile_id))))""")
oracle("t10_carry_transform", """
SELECT CAST(tile_id AS INTEGER) AS tile_id, last_value(a IGNORE NULLS) OVER o AS a, last_value(tx IGNORE NULLS) OVER o AS tx, last_value(ty IGNORE NULLS) OVER o AS ty, round(ncc, 6) AS ncc
FROM (SELECT z.tile_id, z.ncc, CASE WHEN z.ncc >= 0.3 THEN 1.0::DOUBLE END AS a, CASE WHEN z.ncc >= 0.3 THEN 0.0::DOUBLE - b.dx END AS tx, CASE WHEN z.ncc >= 0.3 THEN 0.0::DOUBLE - b.dy END AS ty
      FROM best0 z JOIN best2 b USING (tile_id))
WINDOW o AS (ORDER BY tile_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
oracle("t11_warp", """
WITH m AS (SELECT cycle, 1.0::DOUBLE + cycle*0.02::DOUBLE AS a, 0.05::DOUBLE AS b, 1.25::DOUBLE - cycle AS tx, -0.04::DOUBLE AS c, 0.97::DOUBLE AS d, 2.5::DOUBLE AS ty FROM (VALUES (0),(1),(2)) AS k(cycle)),
src AS (SELECT p.cycle, y, x, round((d*(x-tx) - b*(y-ty))/(a*d - b*c), 9) AS sx, round((a*(y-ty) - c*(x-tx))/(a*d - b*c), 9) AS sy FROM pixels p JOIN m ON m.cycle = p.cycle WHERE channel = 0),
corner AS (SELECT cycle, y, x, floor(sy) + dy AS py, floor(sx) + dx AS px,
  (CASE dy WHEN 0 THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END) * (CASE dx WHEN 0 THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END) AS k
  FROM src, (VALUES (0),(1)) AS a(dy), (VALUES (0),(1)) AS b(dx))
SELECT c.cycle, c.y, c.x, round(coalesce(sum(k*p.v), 0), 4) AS v FROM corner c LEFT JOIN (SELECT * FROM pixels WHERE channel = 0) p ON p.cycle = c.cycle AND p.y = c.py AND p.x = c.px GROUP BY ALL""")
oracle("t12_stitch", """
SELECT b.y, b.x, coalesce(t.v, 0) AS v FROM bf b LEFT JOIN (
  SELECT ty, tx, arg_max(v, tile_id) AS v FROM core4 JOIN bf s ON s.y = sy AND s.x = sx AND sy >= y0 AND sy < y1 AND sx >= x0 AND sx < x1 GROUP BY ty, tx) t
ON t.ty = b.y AND t.tx = b.x""")
oracle("t13_align_stack", """
SELECT m.channel, m.y, m.x, coalesce(s.v, 0) AS v FROM moving_stack m
LEFT JOIN (SELECT ty, tx, arg_max(sy + dy, tile_id) AS py, arg_max(sx + dx, tile_id) AS px, arg_max(sy + dy >= y0 AND sy + dy < y1 AND sx + dx >= x0 AND sx + dx < x1, tile_id) AS ok
           FROM core4 JOIN best2 USING (tile_id) GROUP BY ty, tx) t ON t.ty = m.y AND t.tx = m.x AND t.ok
LEFT JOIN moving_stack s ON s.channel = m.channel AND s.y = t.py AND s.x = t.px""")
oracle("t14_describe_matrix", """
SELECT tile_id, printf('Translation: (%.2f, %.2f), Rotation: %.2f°, Scale: (x: %.2f, y: %.2f)', tx, ty, degrees(atan2(c, a)), sqrt(a*a + c*c), sqrt(b*b + d*d)) AS text FROM fit""")

oracle("b01_square_samples", "SELECT bead_id, cycle, channel, v FROM samples")
oracle("b02_region_samples", "SELECT label, cycle, channel, p.v FROM region r JOIN pixels p ON p.y = r.y AND p.x = r.x WHERE p.channel > 0")
oracle("b03_brightness", "SELECT bead_id, cycle, channel, br AS brightness FROM sig")
oracle("b04_background", "SELECT bead_id, cycle, channel, round(bg, 6) AS background FROM sig")
oracle("b05_snr", "SELECT bead_id, cycle, channel, round(snr, 6) AS snr FROM sig")
oracle("b05_snr_edge", """
SELECT bead_id, cycle, channel, CASE WHEN x < 40 OR y < 40 OR x >= w - 40 OR y >= w - 40 THEN 0 ELSE round(snr, 6) END AS snr FROM sig JOIN beads USING (bead_id), side_w""")
oracle("b06_over_threshold", "SELECT bead_id, cycle, channel, over FROM sig")
for _q, _c in (("b07_argmax", "call_plain"), ("b08a_noise_every_high", "call_every"), ("b08b_noise_none_high", "call_none"),
               ("b09a_gate_all", "call_all"), ("b09b_gate_any", "call_any")):
    oracle(_q, f"SELECT bead_id, cycle, call FROM {_c}")
oracle("b10_drop_uncalled", "SELECT * FROM called")
oracle("b11_bbox", "SELECT label, concat('(', y1, ', ', x1, ', ', y2, ', ', x2, ')') AS bbox FROM region_table")
WINDOW_BOX = "concat('(', y-2, ', ', x-2, ', ', y+1, ', ', x+1, ')') AS bbox"
oracle("b12_wide_calls", f"SELECT x, y, cy0, cy1, cy2, {WINDOW_BOX} FROM beads JOIN wide_both USING (bead_id)")
oracle("b13_decode_square", f"SELECT x, y, cy0, cy1, cy2, {WINDOW_BOX} FROM beads JOIN wide_m USING (bead_id)")
oracle("b13_decode_square_older", f"SELECT x, y, cy0, cy1, cy2, {WINDOW_BOX} FROM beads JOIN wide_older USING (bead_id)")
oracle("b13_decode", """
SELECT x, y, cy0, cy1, cy2, concat('(', y1, ', ', x1, ', ', y2, ', ', x2, ')') AS bbox FROM (
  SELECT *, CAST(round_even(wx, 0) AS BIGINT) AS x, CAST(round_even(wy, 0) AS BIGINT) AS y FROM region_table WHERE label IN (SELECT label FROM inner_region)
  QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY label) = 1) JOIN wide_r USING (label) WHERE cy0 <> 255 AND cy1 <> 255 AND cy2 <> 255""")

oracle("c01_clean_code", """
SELECT * FROM (SELECT CASE WHEN blank THEN NULL ELSE concat(p_name, ' ', p_partkey) END AS protein, CASE WHEN blank THEN NULL ELSE CAST(p_partkey % 3 AS INTEGER) END AS cy0,
  CASE WHEN blank OR p_size % 5 = 0 THEN NULL ELSE CAST(p_size % 3 AS INTEGER) END AS cy1, CASE WHEN blank THEN NULL ELSE CAST(length(p_name) % 3 AS INTEGER) END AS cy2
  FROM (SELECT *, p_partkey % 7 = 3 AS blank FROM part)) WHERE protein IS NOT NULL OR cy0 IS NOT NULL OR cy1 IS NOT NULL OR cy2 IS NOT NULL""")
oracle("c02_code_size", "SELECT 3 AS n_cycles, CAST(max(greatest(cy0, cy1, cy2)) + 1 AS INTEGER) AS n_colours FROM color_code")
oracle("c03_code_words", "SELECT protein_idx, cy0, cy1, cy2, code FROM words WHERE (SELECT max(greatest(cy0, cy1, cy2)) FROM color_code) = 2")
oracle("c04_bead_code", "SELECT bead_id, CAST(concat(cy0, cy1, cy2) AS BIGINT) AS code FROM called")
oracle("c05_cell_of_bead", "SELECT bead_id, label FROM beads JOIN cell_pixels USING (y, x) WHERE label > 0")
oracle("c06_in_bounds", "SELECT bead_id, x > 7 AND y > 7 AND x < w - 7 AND y < w - 7 AS in_bounds FROM beads, side_w")
oracle("c07_adjusted_median", "SELECT x, y, round(value, 6) AS intensity FROM intensity")
oracle("c08_cell_protein_values", "SELECT label, protein_idx, bead_id, round(value, 6) AS intensity FROM own_values")
oracle("c09_nearest_bead", "SELECT label, protein_idx, d2, x, y FROM nearest")
oracle("c10_cell_medians", "SELECT label, protein_idx, round(CAST(median(value) AS DOUBLE), 6) AS value FROM own_values GROUP BY ALL")
oracle("c11_protein_names", "SELECT protein_idx, code, name FROM names")
_WORDS = [(a, b, c) for a in range(3) for b in range(3) for c in range(3)]
_HEAD = [f"Protein_{a * 9 + b * 3 + c}" if (a, b) == (2, 2) else f"P{a}{b}{c}" for a, b, c in _WORDS]
_CELLS = "SELECT c.label AS cell_id, c.gx AS global_x, c.gy AS global_y, {} FROM centroids c LEFT JOIN {} m ON m.label = c.label GROUP BY ALL"


def cell_columns(source: str) -> str:
    cols = ", ".join(f"round(max(CASE WHEN m.protein_idx = {i} THEN m.value END), 6) AS \"{name}\"" for i, name in enumerate(_HEAD))
    return _CELLS.format(cols, source)


oracle("c12_cell_table", cell_columns("(SELECT label, protein_idx, CAST(median(value) AS DOUBLE) AS value FROM own_values GROUP BY ALL)"))
oracle("c13_cell_centroids", "SELECT label, gx, gy FROM centroids")
oracle("c14_checked_inputs", """
SELECT 'beads' AS name, count(*) AS n_rows FROM called UNION ALL SELECT 'labels', count(*) FROM cell_pixels
UNION ALL SELECT 'protein', count(*) FROM protein_pixels UNION ALL SELECT 'code', count(*) FROM color_code""")
oracle("c15_cell_protein", "SELECT label, gx, gy, protein_idx, round(value, 6) AS value FROM filled_small JOIN centroids USING (label)")
oracle("s07_cell_export", cell_columns("filled_full"))

oracle("i01_bead_at", """
SELECT r.bead_id AS request_id, b.x, b.y, b.bead_id FROM (SELECT bead_id, x + bead_id % 2 AS x, y FROM beads) r JOIN beads b ON b.x = r.x AND b.y = r.y""")
piece("boxes", """
SELECT bead_id, least(greatest(y-9, 0), w-1) AS y1, least(greatest(x-9, 0), w-1) AS x1, least(greatest(y+6, 0), w-1) AS y2, least(greatest(x+7, 0), w-1) AS x2 FROM beads, side_w""")
oracle("i02_parse_bbox", "SELECT bead_id, y1, x1, y2, x2 FROM boxes")
oracle("i03_windows", """
SELECT bead_id AS request_id, cycle, channel, count(*) AS n, CAST(sum(p.v) AS BIGINT) AS total, min(p.y) AS y0, max(p.x) AS x1 FROM (
  SELECT bead_id, y + dy AS y, x + dx AS x FROM beads, (SELECT unnest(range(-3, 3)) AS dy), (SELECT unnest(range(-3, 3)) AS dx)) b
JOIN pixels p ON p.y = b.y AND p.x = b.x GROUP BY ALL""")
piece("grown", """
SELECT bead_id, CAST(trunc((y1+y2)/2 - hy) AS BIGINT) AS y1, CAST(trunc((x1+x2)/2 - hx) AS BIGINT) AS x1, CAST(trunc((y1+y2)/2 + hy) AS BIGINT) AS y2, CAST(trunc((x1+x2)/2 + hx) AS BIGINT) AS x2
FROM (SELECT *, floor((y2-y1)*1.5::DOUBLE/2) AS hy, floor((x2-x1)*1.5::DOUBLE/2) AS hx FROM boxes)""")
oracle("i04_grow_bbox", "SELECT bead_id, y1, x1, y2, x2 FROM grown")
oracle("i03_box_windows", """
SELECT bead_id AS request_id, cycle, channel, count(*) AS n, CAST(sum(v) AS BIGINT) AS total
FROM grown JOIN pixels ON y >= y1 AND y < y2 AND x >= x1 AND x < x2 GROUP BY ALL""")
oracle("i05_grid_report", """
SELECT g.*, coalesce(CAST(c.call AS VARCHAR), 'N/A') AS output FROM (
  SELECT bead_id AS request_id, cycle, round(avg(p.v) FILTER (channel = 0), 6) AS ch0, round(avg(p.v) FILTER (channel = 1), 6) AS ch1, round(avg(p.v) FILTER (channel = 2), 6) AS ch2, round(avg(p.v) FILTER (channel = 3), 6) AS ch3
  FROM (SELECT bead_id, y + dy AS y, x + dx AS x FROM beads, (SELECT unnest(range(-4, 4)) AS dy), (SELECT unnest(range(-4, 4)) AS dx)) b
  JOIN pixels p ON p.y = b.y AND p.x = b.x GROUP BY bead_id, cycle) g
LEFT JOIN call_every c ON c.bead_id = g.request_id AND c.cycle = g.cycle""")
