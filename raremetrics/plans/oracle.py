"""Oracle SQL (DuckDB dialect) for the registered queries, over the shared tables.

Each string is self-contained: the shared-table mappings are inlined as CTEs.
Every double output is rounded to 6 digits and integer outputs are cast to
BIGINT/INT, mirroring ``catalog.rounded`` on the Spark side.
"""

SHOTS_CTE = """shots AS (
  WITH ln AS (
    SELECT l_orderkey, SUM(l_quantity)/20.0E0 AS hrs,
      CAST(SUM(CASE WHEN l_returnflag='R' AND l_discount>=0.095E0 AND l_linestatus='O' THEN 1 ELSE 0 END) AS BIGINT) AS narrow_alive,
      CAST(SUM(CASE WHEN l_returnflag='R' AND l_discount>=0.095E0 AND l_linestatus='F' THEN 1 ELSE 0 END) AS BIGINT) AS narrow_dead,
      CAST(SUM(CASE WHEN l_returnflag='A' AND l_tax>=0.075E0 AND l_discount>=0.085E0 AND l_linestatus='O' THEN 1 ELSE 0 END) AS BIGINT) AS green_alive,
      CAST(SUM(CASE WHEN l_returnflag='A' AND l_tax>=0.075E0 AND l_discount>=0.085E0 AND l_linestatus='F' THEN 1 ELSE 0 END) AS BIGINT) AS green_dead
    FROM lineitem GROUP BY l_orderkey)
  SELECT o_orderkey AS shot_id, o_custkey AS skipper_no,
    CASE WHEN c_nationkey=0 THEN '' WHEN c_nationkey=1 THEN 'Vessel 2 II'
         WHEN c_nationkey % 2 = 0 THEN concat('Vessel ', CAST(c_nationkey AS STRING))
         ELSE concat('VESSEL ', CAST(c_nationkey AS STRING)) END AS vessel,
    o_orderdate AS start_date, CAST(year(o_orderdate) AS INT) AS yr, CAST(month(o_orderdate) AS INT) AS mn,
    CAST((o_orderkey * 7 + o_custkey) % 24 AS INT) AS start_hour,
    o_totalprice AS total_catch,
    -17.0E0 - (o_custkey % 400)/100.0E0 AS slat,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE -17.0E0 - ((o_custkey+7) % 400)/100.0E0 END AS elat,
    114.0E0 + (o_custkey % 700)/100.0E0 AS slong,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 114.0E0 + ((o_custkey+11) % 700)/100.0E0 END AS elong,
    CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 50.0E0 + (o_orderkey % 71) END AS sdepth,
    CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE 52.0E0 + (o_orderkey % 71) END AS edepth,
    hrs, narrow_alive, narrow_dead, green_alive, green_dead
  FROM orders JOIN customer ON o_custkey=c_custkey LEFT JOIN ln ON l_orderkey=o_orderkey
)"""

# shots with P5 totals and P6 midpoints
SHOTS_T_CTE = SHOTS_CTE + """,
shots_t AS (
  SELECT s.*,
    COALESCE(narrow_alive,0)+COALESCE(narrow_dead,0) AS narrow,
    COALESCE(green_alive,0)+COALESCE(green_dead,0) AS green,
    CASE WHEN slat IS NULL THEN elat WHEN elat IS NULL THEN slat ELSE (slat+elat)/2.0E0 END AS lat,
    CASE WHEN slong IS NULL THEN elong WHEN elong IS NULL THEN slong ELSE (slong+elong)/2.0E0 END AS lon,
    CASE WHEN sdepth IS NULL THEN edepth WHEN edepth IS NULL THEN sdepth ELSE (sdepth+edepth)/2.0E0 END AS depth
  FROM shots s
)"""

# totals + minimum effort
PREPARED_CTE = SHOTS_T_CTE + """,
prepared AS (SELECT * FROM shots_t WHERE hrs >= 1.0E0/6.0E0)"""

SHOTS_HOURLY_CTE = """shots_hourly AS (
  SELECT event_id AS shot_id, user_id AS vessel_no, CAST(hour(ts) AS INT) AS start_hour, CAST(day(ts) AS INT) AS dy,
    value/60.0E0 AS hrs, CASE WHEN event_type='error' AND value>100.0E0 THEN 1 ELSE 0 END AS narrow,
    CASE WHEN event_type='signup' AND value>150.0E0 THEN 1 ELSE 0 END AS green, event_type AS gear
  FROM events
)"""

SST_CTE = """sst AS (
  SELECT -15.0E0 - (l_orderkey % 80)/10.0E0 AS lat, 112.0E0 + (l_partkey % 120)/10.0E0 AS lon,
    CAST(year(l_shipdate) AS INT) AS yr, CAST(month(l_shipdate) AS INT) AS mn, 20.0E0 + l_quantity/5.0E0 AS value
  FROM lineitem
)"""

ORACLE: dict[str, str] = {}


def register(name: str, sql: str) -> None:
    ORACLE[name] = sql.strip()


register("nominal_cpue", f"""
WITH {PREPARED_CTE},
long AS (
  SELECT 'narrow' AS species, yr, 1000.0E0*narrow/hrs AS cpue FROM prepared WHERE vessel <> ''
  UNION ALL
  SELECT 'green' AS species, yr, 1000.0E0*green/hrs AS cpue FROM prepared WHERE vessel <> '')
SELECT species, yr, ROUND(AVG(cpue),6) AS mean, CAST(COUNT(*) AS BIGINT) AS n, ROUND(STDDEV_SAMP(cpue),6) AS sd,
  ROUND(AVG(cpue)-1.96E0*STDDEV_SAMP(cpue)/SQRT(COUNT(*)),6) AS low_cl,
  ROUND(AVG(cpue)+1.96E0*STDDEV_SAMP(cpue)/SQRT(COUNT(*)),6) AS upp_cl
FROM long GROUP BY species, yr
""")

KNOWN_CTE = PREPARED_CTE + """,
known AS (SELECT * FROM prepared WHERE vessel <> '')"""

MODEL_CTE = KNOWN_CTE + """,
model AS (
  SELECT k.* REPLACE (CASE WHEN lower(vessel)='vessel 2 ii' THEN 'vessel 2' ELSE lower(vessel) END AS vessel),
    CASE WHEN mn BETWEEN 3 AND 8 THEN 'AuWin' WHEN mn IS NOT NULL THEN 'SprSu' END AS season,
    CASE WHEN hrs < 2.0E0 THEN 'Short' WHEN hrs < 4.0E0 THEN 'Standard' WHEN hrs >= 4.0E0 THEN 'Long' END AS effort_class
  FROM known k WHERE hrs <= 7.0E0)"""

BBOX = "lat > -21.0E0 AND lat < -17.0E0 AND lon < 121.0E0 AND lon > 114.0E0"
CELL_LAT = "CAST(substr(CAST(slat AS VARCHAR),1,5) AS DOUBLE)"
CELL_LON = "CAST(substr(CAST(slong AS VARCHAR),1,5) AS DOUBLE)"

register("climatology", f"""
WITH {SST_CTE}
SELECT mn, ROUND(AVG(value),6) AS temperature FROM sst
WHERE {BBOX} AND mn IS NOT NULL AND value IS NOT NULL GROUP BY mn""")

register("climatology_year_month", f"""
WITH {SST_CTE}
SELECT yr, mn, ROUND(AVG(value),6) AS temperature FROM sst
WHERE {BBOX} AND yr IS NOT NULL AND mn IS NOT NULL AND value IS NOT NULL GROUP BY yr, mn""")

register("annual_totals", f"""
WITH {PREPARED_CTE}
SELECT yr, CAST(SUM(green) AS BIGINT) AS green, CAST(SUM(narrow) AS BIGINT) AS narrow, ROUND(SUM(hrs),6) AS hrs
FROM prepared WHERE yr IS NOT NULL AND hrs IS NOT NULL GROUP BY yr""")

register("shots_enriched", f"""
WITH {PREPARED_CTE}, {SST_CTE},
clim AS (SELECT mn AS cmn, AVG(value) AS temperature FROM sst WHERE {BBOX} AND mn IS NOT NULL AND value IS NOT NULL GROUP BY mn),
ann AS (SELECT yr AS ayr, SUM(hrs) AS ann_eff FROM prepared WHERE yr IS NOT NULL AND hrs IS NOT NULL GROUP BY yr)
SELECT shot_id, vessel, yr, mn, ROUND(lat,6) AS lat, ROUND(lon,6) AS lon, ROUND(depth,6) AS depth, ROUND(hrs,6) AS hrs,
  narrow, green, ROUND(temperature,6) AS temperature, ROUND(ann_eff,6) AS ann_eff,
  CASE WHEN mn BETWEEN 3 AND 8 THEN 'AuWin' WHEN mn IS NOT NULL THEN 'SprSu' END AS season,
  CASE WHEN hrs < 2.0E0 THEN 'Short' WHEN hrs < 4.0E0 THEN 'Standard' WHEN hrs >= 4.0E0 THEN 'Long' END AS effort_class
FROM prepared p LEFT JOIN clim ON p.mn IS NOT DISTINCT FROM clim.cmn JOIN ann ON p.yr = ann.ayr
WHERE vessel <> ''""")

register("effort_class", f"""
WITH {KNOWN_CTE},
c AS (SELECT *, CASE WHEN mn BETWEEN 3 AND 8 THEN 'AuWin' WHEN mn IS NOT NULL THEN 'SprSu' END AS season,
  CASE WHEN hrs < 2.0E0 THEN 'Short' WHEN hrs < 4.0E0 THEN 'Standard' WHEN hrs >= 4.0E0 THEN 'Long' END AS effort_class FROM known)
SELECT season, effort_class, COUNT(*) AS shots, ROUND(SUM(hrs),6) AS hrs,
  CAST(SUM(narrow) AS BIGINT) AS narrow, CAST(SUM(green) AS BIGINT) AS green
FROM c GROUP BY season, effort_class""")

register("day_night", f"""
WITH {SHOTS_HOURLY_CTE}
SELECT CASE WHEN start_hour BETWEEN 6 AND 18 THEN 'Day' WHEN start_hour IS NOT NULL THEN 'Night' END AS day_night,
  COUNT(*) AS shots, ROUND(SUM(hrs),6) AS hrs, CAST(SUM(narrow) AS BIGINT) AS narrow, CAST(SUM(green) AS BIGINT) AS green
FROM shots_hourly WHERE hrs >= 1.0E0/6.0E0 GROUP BY 1""")

register("effort_grid", f"""
WITH {KNOWN_CTE},
g AS (SELECT {CELL_LAT} AS cell_lat, {CELL_LON} AS cell_lon, SUM(hrs) AS hrs, COUNT(*) AS shots FROM known
      WHERE slat IS NOT NULL AND slong IS NOT NULL AND hrs IS NOT NULL GROUP BY 1, 2)
SELECT cell_lat, cell_lon, ROUND(hrs,6) AS hrs, shots, ROUND(cell_lat-0.05E0,6) AS centre_lat, ROUND(cell_lon+0.05E0,6) AS centre_lon FROM g""")

register("effort_grid_year", f"""
WITH {KNOWN_CTE},
g AS (SELECT yr, {CELL_LAT} AS cell_lat, {CELL_LON} AS cell_lon, SUM(hrs) AS hrs, COUNT(*) AS shots FROM known
      WHERE yr IS NOT NULL AND slat IS NOT NULL AND slong IS NOT NULL AND hrs IS NOT NULL GROUP BY 1, 2, 3)
SELECT yr, cell_lat, cell_lon, ROUND(hrs,6) AS hrs, shots, ROUND(cell_lat-0.05E0,6) AS centre_lat, ROUND(cell_lon+0.05E0,6) AS centre_lon FROM g""")

register("effort_grid_class", f"""
WITH {KNOWN_CTE},
g AS (SELECT {CELL_LAT} AS cell_lat, {CELL_LON} AS cell_lon, SUM(hrs) AS hrs, COUNT(*) AS shots FROM known
      WHERE slat IS NOT NULL AND slong IS NOT NULL AND hrs IS NOT NULL GROUP BY 1, 2),
r AS (SELECT MIN(hrs) AS lo, MAX(hrs) AS hi FROM g)
SELECT cell_lat, cell_lon, ROUND(hrs,6) AS hrs, shots, ROUND(cell_lat-0.05E0,6) AS centre_lat, ROUND(cell_lon+0.05E0,6) AS centre_lon,
  CAST(LEAST(20, CASE WHEN hrs <= lo OR hi = lo THEN 1 ELSE 1 + CEIL((hrs-lo)/((hi-lo)/19.0E0)) END) AS INT) AS effort_class
FROM g, r""")

register("range_audit", f"""
WITH {SHOTS_CTE},
s AS (SELECT shot_id, CAST(yr AS DOUBLE) AS yr, CAST(mn AS DOUBLE) AS mn, CAST(day(start_date) AS DOUBLE) AS dy FROM shots)
SELECT shot_id, 'yr' AS "column", yr AS value FROM s WHERE yr < 1995 OR yr > 2000
UNION ALL SELECT shot_id, 'mn', mn FROM s WHERE mn < 1 OR mn > 12
UNION ALL SELECT shot_id, 'dy', dy FROM s WHERE dy < 1 OR dy > 28""")

register("vessel_tenure", f"""
WITH {KNOWN_CTE},
t AS (SELECT skipper_no FROM known WHERE skipper_no IS NOT NULL AND yr IS NOT NULL GROUP BY skipper_no HAVING COUNT(DISTINCT yr) > 5)
SELECT skipper_no, COUNT(*) AS shots, COUNT(DISTINCT yr) AS n_years FROM known
WHERE skipper_no IN (SELECT skipper_no FROM t) GROUP BY skipper_no""")

register("exclude_ids", f"""
WITH {PREPARED_CTE}
SELECT yr, COUNT(*) AS shots FROM prepared
WHERE shot_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50 AND l_orderkey IS NOT NULL)
GROUP BY yr""")

register("level_audit", f"""
WITH {MODEL_CTE.replace('WHERE hrs <= 7.0E0', '')},
e AS (SELECT k.*, CASE WHEN mn BETWEEN 3 AND 8 THEN 'AuWin' WHEN mn IS NOT NULL THEN 'SprSu' END AS season,
   CASE WHEN hrs < 2.0E0 THEN 'Short' WHEN hrs < 4.0E0 THEN 'Standard' WHEN hrs >= 4.0E0 THEN 'Long' END AS effort_class FROM known k),
l AS (
  SELECT 'vessel' AS "column", COUNT(DISTINCT vessel) AS n_levels FROM e
  UNION ALL SELECT 'yr', COUNT(DISTINCT yr) FROM e
  UNION ALL SELECT 'mn', COUNT(DISTINCT mn) FROM e
  UNION ALL SELECT 'season', COUNT(DISTINCT season) FROM e
  UNION ALL SELECT 'effort_class', COUNT(DISTINCT effort_class) FROM e
  UNION ALL SELECT 'skipper_no', COUNT(DISTINCT skipper_no) FROM e)
SELECT "column", n_levels, n_levels > 32 AS too_many FROM l""")

register("effort_audit", f"""
WITH {KNOWN_CTE}
SELECT hrs > 7.0E0 AS over_cap, COUNT(*) AS shots, CAST(SUM(narrow) AS BIGINT) AS narrow_total,
  CAST(SUM(green) AS BIGINT) AS green_total
FROM known WHERE hrs IS NOT NULL GROUP BY 1""")

_PROFILE_DIM = """SELECT '{n}' AS dimension, CAST({e} AS DOUBLE) AS level, SUM(hrs) AS hrs, COUNT(*) AS shots,
    SUM(CASE WHEN narrow>0 THEN narrow ELSE 0 END) AS c_narrow, SUM(CASE WHEN narrow>0 THEN 1 ELSE 0 END) AS p_narrow,
    SUM(CASE WHEN green>0 THEN green ELSE 0 END) AS c_green, SUM(CASE WHEN green>0 THEN 1 ELSE 0 END) AS p_green
  FROM known WHERE {e} IS NOT NULL GROUP BY 1, 2"""

register("catch_effort_profile", f"""
WITH {KNOWN_CTE},
g AS ({_PROFILE_DIM.format(n='mn', e='mn')}
  UNION ALL {_PROFILE_DIM.format(n='depth_bin', e='10.0E0*round_even(depth/10.0E0,0)')})
SELECT 'narrow' AS species, dimension, level, CAST(c_narrow AS BIGINT) AS catch, CAST(p_narrow AS BIGINT) AS positive_shots,
  ROUND(hrs,6) AS hrs, shots FROM g WHERE p_narrow > 0
UNION ALL
SELECT 'green', dimension, level, CAST(c_green AS BIGINT), CAST(p_green AS BIGINT), ROUND(hrs,6), shots FROM g WHERE p_green > 0""")

_MEAN_DIM = """SELECT '{n}' AS dimension, CAST({e} AS DOUBLE) AS level, ROUND(AVG(narrow/hrs),6) AS mean, COUNT(narrow/hrs) AS n
  FROM known WHERE {e} IS NOT NULL GROUP BY 1, 2"""

register("mean_cpue_by_dims", f"""
WITH {KNOWN_CTE}
{_MEAN_DIM.format(n='yr', e='yr')}
UNION ALL {_MEAN_DIM.format(n='mn', e='mn')}
UNION ALL {_MEAN_DIM.format(n='depth_bin', e='10.0E0*round_even(depth/10.0E0,0)')}""")

LONG_CTE = KNOWN_CTE + """,
long AS (SELECT 'narrow' AS species, narrow AS n_caught FROM known UNION ALL SELECT 'green', green FROM known)"""

register("catch_frequency_pct", f"""
WITH {LONG_CTE},
t AS (SELECT species, n_caught, COUNT(*) AS records FROM long WHERE n_caught > 0 GROUP BY species, n_caught)
SELECT species, n_caught, records, ROUND(round_even(100.0E0*records/SUM(records) OVER (PARTITION BY species), 2),6) AS percent FROM t""")

register("count_distribution", f"""
WITH {LONG_CTE}
SELECT species, n_caught, COUNT(*) AS records FROM long GROUP BY species, n_caught""")

register("occurrence", f"""
WITH {KNOWN_CTE}
SELECT ROUND(round_even(100.0E0*SUM(CASE WHEN narrow+green > 0 THEN 1 ELSE 0 END)/COUNT(*), 3),6) AS pct_any,
  ROUND(round_even(100.0E0*SUM(CASE WHEN narrow > 0 THEN 1 ELSE 0 END)/COUNT(*), 2),6) AS pct_narrow,
  ROUND(round_even(100.0E0*SUM(CASE WHEN green > 0 THEN 1 ELSE 0 END)/COUNT(*), 2),6) AS pct_green
FROM known""")

register("table1", f"""
WITH {KNOWN_CTE}
SELECT CAST(SUM(COALESCE(green_alive,0)) AS BIGINT) AS green_alive, CAST(SUM(COALESCE(green_dead,0)) AS BIGINT) AS green_dead,
  CAST(SUM(COALESCE(narrow_alive,0)) AS BIGINT) AS narrow_alive, CAST(SUM(COALESCE(narrow_dead,0)) AS BIGINT) AS narrow_dead,
  COUNT(*) AS records, ROUND(SUM(hrs),6) AS effort FROM known""")

register("annual_catch", f"""
WITH {KNOWN_CTE}
SELECT yr, CAST(SUM(COALESCE(green_alive,0)) AS BIGINT) AS green_alive, CAST(SUM(COALESCE(green_dead,0)) AS BIGINT) AS green_dead,
  CAST(SUM(COALESCE(narrow_alive,0)) AS BIGINT) AS narrow_alive, CAST(SUM(COALESCE(narrow_dead,0)) AS BIGINT) AS narrow_dead
FROM known GROUP BY yr""")

register("annual_effort", f"""
WITH {KNOWN_CTE}
SELECT yr, ROUND(SUM(hrs)/1000.0E0,6) AS effort_k_hrs FROM known GROUP BY yr""")

register("effort_by_month", f"""
WITH {KNOWN_CTE}
SELECT mn, ROUND(round_even(ROUND(SUM(hrs),6),0),6) AS effort FROM known WHERE hrs <= 7.0E0 GROUP BY mn""")

register("catch_map", f"""
WITH {KNOWN_CTE},
d AS (SELECT * FROM known WHERE hrs <= 7.0E0),
e AS (SELECT mn, round_even(ROUND(SUM(hrs),6),0) AS effort FROM d GROUP BY mn),
p AS (SELECT mn, lon, lat, CAST(SUM(narrow) AS BIGINT) AS total FROM d GROUP BY mn, lon, lat)
SELECT p.mn, ROUND(p.lon,6) AS lon, ROUND(p.lat,6) AS lat, total, ROUND(effort,6) AS effort, total > 0 AS positive,
  concat(CAST(p.mn AS VARCHAR), ' (', CAST(CAST(effort AS BIGINT) AS VARCHAR), ' trawled h)') AS label
FROM p LEFT JOIN e ON p.mn IS NOT DISTINCT FROM e.mn""")

_END_MONTH_CTE = KNOWN_CTE + """,
d AS (SELECT *, CAST(month(CAST(start_date AS DATE) + CAST(FLOOR((start_hour + hrs)/24.0E0) AS INT)) AS INT) AS end_mn
      FROM known WHERE hrs <= 7.0E0),
e AS (SELECT end_mn, round_even(ROUND(SUM(hrs),6),0) AS effort FROM d GROUP BY end_mn)"""
register("effort_by_end_month", f"""
WITH {_END_MONTH_CTE}
SELECT end_mn, ROUND(effort,6) AS effort FROM e""")

register("catch_map_end_month", f"""
WITH {_END_MONTH_CTE},
l AS (SELECT 'narrow' AS species, end_mn, lon, lat, narrow AS k FROM d
      UNION ALL SELECT 'green', end_mn, lon, lat, green FROM d),
p AS (SELECT species, end_mn, lon, lat, CAST(SUM(k) AS BIGINT) AS total FROM l GROUP BY species, end_mn, lon, lat)
SELECT species, p.end_mn, ROUND(p.lon,6) AS lon, ROUND(p.lat,6) AS lat, total, ROUND(effort,6) AS effort, total > 0 AS positive,
  concat(CAST(p.end_mn AS VARCHAR), ' (', CAST(CAST(effort AS BIGINT) AS VARCHAR), ' trawled h)') AS label
FROM p LEFT JOIN e ON p.end_mn IS NOT DISTINCT FROM e.end_mn""")

_LEVEL = "SELECT species, '{f}' AS factor, CAST({f} AS VARCHAR) AS level, k FROM ml"
register("level_catch", f"""
WITH {MODEL_CTE},
ml AS (SELECT 'narrow' AS species, narrow AS k, * FROM model WHERE narrow > 0
       UNION ALL SELECT 'green', green, * FROM model WHERE green > 0),
lv AS ({_LEVEL.format(f='yr')} UNION ALL {_LEVEL.format(f='season')} UNION ALL {_LEVEL.format(f='vessel')}
       UNION ALL {_LEVEL.format(f='effort_class')})
SELECT species, factor, level, CAST(SUM(k) AS BIGINT) AS catch FROM lv GROUP BY species, factor, level""")

_BIN = "CAST(CAST(LEAST(10, GREATEST(1, CEIL(({c}-lo_{c})/((hi_{c}-lo_{c})/10.0E0)))) AS INT) AS VARCHAR)"
_PP = "SELECT species, '{p}' AS predictor, {e} AS level, k FROM b"
register("predictor_positive", f"""
WITH {KNOWN_CTE},
r AS (SELECT MIN(lon) AS lo_lon, MAX(lon) AS hi_lon, MIN(lat) AS lo_lat, MAX(lat) AS hi_lat,
             MIN(depth) AS lo_depth, MAX(depth) AS hi_depth FROM known),
kb AS (SELECT known.*, {_BIN.format(c='lon')} AS b_lon, {_BIN.format(c='lat')} AS b_lat, {_BIN.format(c='depth')} AS b_depth
       FROM known, r),
b AS (SELECT 'narrow' AS species, narrow AS k, * FROM kb UNION ALL SELECT 'green', green, * FROM kb),
lv AS ({_PP.format(p='vessel', e='vessel')} UNION ALL {_PP.format(p='yr', e='CAST(yr AS VARCHAR)')}
   UNION ALL {_PP.format(p='mn', e='CAST(mn AS VARCHAR)')} UNION ALL {_PP.format(p='lon', e='b_lon')}
   UNION ALL {_PP.format(p='lat', e='b_lat')} UNION ALL {_PP.format(p='depth', e='b_depth')})
SELECT species, predictor, level, CAST(SUM(CASE WHEN k > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive
FROM lv WHERE level IS NOT NULL GROUP BY species, predictor, level""")

register("boxplot_stats", f"""
WITH {KNOWN_CTE},
d AS (SELECT yr, narrow/hrs AS v FROM known WHERE narrow > 0 AND yr IS NOT NULL AND narrow/hrs IS NOT NULL),
q AS (SELECT yr, COUNT(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM d GROUP BY yr),
j AS (SELECT d.yr, v, (v >= q1 - 1.5E0*(q3-q1) AND v <= q3 + 1.5E0*(q3-q1)) AS inside FROM d JOIN q ON d.yr = q.yr),
s AS (SELECT yr, MIN(CASE WHEN inside THEN v END) AS whisker_lo, MAX(CASE WHEN inside THEN v END) AS whisker_hi,
        CAST(SUM(CASE WHEN inside THEN 0 ELSE 1 END) AS BIGINT) AS outliers FROM j GROUP BY yr)
SELECT q.yr, n, ROUND(q1,6) AS q1, ROUND(median,6) AS median, ROUND(q3,6) AS q3,
  ROUND(whisker_lo,6) AS whisker_lo, ROUND(whisker_hi,6) AS whisker_hi, outliers FROM q JOIN s ON q.yr = s.yr""")

register("hist_counts", f"""
WITH {KNOWN_CTE},
b AS (SELECT CAST(FLOOR((hrs - 0.0E0)/0.5E0) AS BIGINT) AS bin FROM known WHERE hrs IS NOT NULL)
SELECT bin, COUNT(*) AS count, ROUND(0.0E0 + bin*0.5E0,6) AS lo, ROUND(0.0E0 + (bin+1)*0.5E0,6) AS hi FROM b GROUP BY bin""")

_P101 = "[" + ", ".join(f"CAST({i / 100!r} AS DOUBLE)" for i in range(101)) + "]"
register("percentiles", f"""
WITH {KNOWN_CTE},
q AS (SELECT quantile_cont(hrs, {_P101}) AS qs FROM known WHERE hrs IS NOT NULL)
SELECT ROUND(unnest({_P101}),6) AS prob, ROUND(unnest(qs),6) AS quantile FROM q""")

register("relative_index", f"""
WITH {PREPARED_CTE},
long AS (
  SELECT 'narrow' AS species, yr, 1000.0E0*narrow/hrs AS cpue FROM prepared WHERE vessel <> ''
  UNION ALL
  SELECT 'green' AS species, yr, 1000.0E0*green/hrs AS cpue FROM prepared WHERE vessel <> ''),
g AS (SELECT species, yr, AVG(cpue) AS mean, AVG(cpue)-1.96E0*STDDEV_SAMP(cpue)/SQRT(COUNT(*)) AS low_cl,
        AVG(cpue)+1.96E0*STDDEV_SAMP(cpue)/SQRT(COUNT(*)) AS upp_cl FROM long GROUP BY species, yr)
SELECT species, yr, ROUND(mean/AVG(mean) OVER (PARTITION BY species),6) AS mean,
  ROUND(low_cl/AVG(mean) OVER (PARTITION BY species),6) AS low_cl,
  ROUND(upp_cl/AVG(mean) OVER (PARTITION BY species),6) AS upp_cl FROM g""")

_CNT = "SELECT '{f}' AS factor, CAST({f} AS VARCHAR) AS level, COUNT(*) AS n FROM model GROUP BY 1, 2"
_PROFILE = """
WITH {cte},
cnt AS ({c1} UNION ALL {c2} UNION ALL {c3} UNION ALL {c4}),
r AS (SELECT factor, level, ROW_NUMBER() OVER (PARTITION BY factor ORDER BY n {o}, level {o}) AS rk FROM cnt WHERE level IS NOT NULL)
SELECT factor AS term, level, CAST(NULL AS DOUBLE) AS value FROM r WHERE rk = 1
UNION ALL SELECT 'hrs', NULL, ROUND(AVG(hrs),6) FROM model
UNION ALL SELECT 'lon', NULL, ROUND(AVG(lon),6) FROM model
UNION ALL SELECT 'lat', NULL, ROUND(AVG(lat),6) FROM model"""
_cnts = dict(c1=_CNT.format(f="yr"), c2=_CNT.format(f="season"), c3=_CNT.format(f="vessel"), c4=_CNT.format(f="effort_class"))
register("reference_profile", _PROFILE.format(cte=MODEL_CTE, o="ASC", **_cnts))
register("modal_profile", _PROFILE.format(cte=MODEL_CTE, o="DESC", **_cnts))

register("panel_rate", f"""
WITH {KNOWN_CTE},
t AS (SELECT yr, shot_id, slong, slat, total_catch/1000.0E0/hrs AS rate FROM known WHERE hrs > 0)
SELECT yr, shot_id, ROUND(slong,6) AS slong, ROUND(slat,6) AS slat,
  ROUND(rate / MAX(rate) OVER (PARTITION BY yr),6) AS scaled FROM t""")

_ODDS = "ln((SUM(CASE WHEN narrow>0 THEN 1 ELSE 0 END)+0.5E0)/(COUNT(narrow)-SUM(CASE WHEN narrow>0 THEN 1 ELSE 0 END)+0.5E0))"
register("year_index_effects", f"""
WITH {KNOWN_CTE},
k AS (SELECT narrow, CAST(yr AS VARCHAR) AS yrs, vessel,
      CASE WHEN mn BETWEEN 3 AND 8 THEN 'AuWin' WHEN mn IS NOT NULL THEN 'SprSu' END AS season FROM known),
l AS (SELECT narrow, 'yrs' AS factor, yrs AS level FROM k UNION ALL SELECT narrow, 'season', season FROM k
      UNION ALL SELECT narrow, 'vessel', vessel FROM k),
g AS (SELECT factor, level, {_ODDS} AS odds FROM l WHERE narrow IS NOT NULL AND level IS NOT NULL GROUP BY factor, level),
b AS (SELECT factor, min_by(odds, level) AS base FROM g GROUP BY factor),
e AS (SELECT factor, level, odds - base AS estimate FROM g JOIN b USING (factor)),
f AS (SELECT SUM(m) AS fixed FROM (SELECT AVG(estimate) AS m FROM e WHERE factor <> 'yrs' GROUP BY factor)),
i AS (SELECT {_ODDS} AS icpt FROM k)
SELECT level AS term, ROUND(1.0E0/(1.0E0+exp(-(icpt + estimate + fixed))), 6) AS "index" FROM e, f, i WHERE factor = 'yrs'""")

register("grid_wide", f"""
WITH {KNOWN_CTE},
g AS (SELECT {CELL_LON} AS cell_lon, mn, SUM(hrs) AS hrs FROM known
      WHERE mn IS NOT NULL AND slat IS NOT NULL AND slong IS NOT NULL AND hrs IS NOT NULL GROUP BY 1, 2)
SELECT cell_lon, {", ".join(f"ROUND(MAX(CASE WHEN mn={m} THEN hrs END),6) AS m{m}" for m in range(1, 13))}
FROM g GROUP BY cell_lon""")

register("vessel_years", f"""
WITH {KNOWN_CTE}
SELECT DISTINCT vessel, yr, 1 AS present FROM known WHERE vessel IS NOT NULL AND yr IS NOT NULL""")

register("panel_catch", f"""
WITH {KNOWN_CTE},
l AS (SELECT yr, 'narrow' AS species, narrow AS k FROM known UNION ALL SELECT yr, 'green', green FROM known)
SELECT yr, species, CAST(SUM(k) AS BIGINT) AS catch, CAST(SUM(CASE WHEN k > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive_points
FROM l GROUP BY yr, species""")

register("class_proportions", f"""
WITH {MODEL_CTE},
t AS (SELECT season, effort_class, COUNT(*) AS n FROM model GROUP BY 1, 2)
SELECT season, effort_class, n, ROUND(100.0E0*n/SUM(n) OVER (),6) AS percent FROM t""")

_CORR = "SELECT '{a}' AS var1, '{b}' AS var2, ROUND(CORR({a},{b}),6) AS r FROM known"
_cv = ["lat", "lon", "depth", "hrs"]
register("corr_matrix", f"""
WITH {KNOWN_CTE}
{" UNION ALL ".join(_CORR.format(a=a, b=b) for i, a in enumerate(_cv) for b in _cv[i + 1:])}""")

register("kde_grid", f"""
WITH {MODEL_CTE},
d AS (SELECT season, hrs AS v FROM model WHERE hrs IS NOT NULL),
st0 AS (SELECT season, COUNT(*) AS n, STDDEV_SAMP(v) AS sd, quantile_cont(v, [0.25E0, 0.75E0]) AS iqr,
          MIN(v) AS lo, MAX(v) AS hi FROM d GROUP BY season),
st1 AS (SELECT season, n, lo, hi, 0.9E0*LEAST(sd, (iqr[2]-iqr[1])/1.34E0)*POW(CAST(n AS DOUBLE), -0.2E0)*2.0E0 AS bw FROM st0),
st AS (SELECT *, lo - 3.0E0*bw AS g0, ((hi-lo) + 6.0E0*bw)/511.0E0 AS step FROM st1 WHERE bw > 0),
w AS (SELECT season, v, COUNT(*) AS w FROM d GROUP BY season, v),
e AS (SELECT w.season, v, w.w, st.n, st.bw, st.g0, st.step, p.point
      FROM w JOIN st ON w.season = st.season, (SELECT unnest(range(512)) AS point) p)
SELECT season, CAST(point AS INT) AS point, ROUND(FIRST(g0 + point*step),6) AS x,
  ROUND(SUM(w*EXP(-0.5E0*((g0 + point*step - v)/bw)*((g0 + point*step - v)/bw))/(bw*2.5066282746310002E0))/FIRST(n),6) AS density
FROM e GROUP BY season, point""")

_BINS_CTE = MODEL_CTE + """,
d AS (SELECT hrs AS h, narrow + green AS pos FROM model),
cap AS (SELECT MAX(CASE WHEN pos > 0 THEN h END) AS cap FROM d),
bn AS (SELECT CASE WHEN h > 0 AND h <= round_even(cap,0) THEN CAST(CEIL(h/0.5E0) AS INT) END AS bin, pos
       FROM d, cap WHERE h <= cap),
eb AS (SELECT bin, COUNT(*) AS shots, CAST(SUM(CASE WHEN pos > 0 THEN pos ELSE 0 END) AS BIGINT) AS interactions
       FROM bn WHERE bin IS NOT NULL GROUP BY bin)"""

register("effort_bins", f"""
WITH {_BINS_CTE}
SELECT bin, shots, interactions, ROUND((bin - 0.5E0)*0.5E0,6) AS bin_mid, ROUND(interactions/shots,6) AS prop_positive FROM eb""")

register("chisq_independence", f"""
WITH {_BINS_CTE},
cells AS (SELECT interactions AS a, shots AS b, COUNT(*) AS o FROM eb GROUP BY 1, 2),
ra AS (SELECT a, SUM(o) AS r FROM cells GROUP BY a),
cb AS (SELECT b, SUM(o) AS c FROM cells GROUP BY b),
j AS (SELECT o, r, c, cells.a, cells.b FROM cells JOIN ra ON cells.a = ra.a JOIN cb ON cells.b = cb.b)
SELECT ROUND(SUM(o) * SUM(o*o/(r*c)) - SUM(o),6) AS statistic, CAST((COUNT(DISTINCT a)-1)*(COUNT(DISTINCT b)-1) AS BIGINT) AS df,
  CAST(SUM(o) AS BIGINT) AS n FROM j""")

register("equal_width_cut", f"""
WITH {KNOWN_CTE},
r AS (SELECT MIN(lon) AS lo_lon, MAX(lon) AS hi_lon FROM known)
SELECT CAST(LEAST(10, GREATEST(1, CEIL((lon-lo_lon)/((hi_lon-lo_lon)/10.0E0)))) AS INT) AS bin, COUNT(*) AS shots
FROM known, r GROUP BY 1""")

_MD5 = "md5(concat_ws(':', CAST(shot_id AS VARCHAR), '666'))"
register("stratified_split", f"""
WITH {KNOWN_CTE},
k AS (SELECT shot_id, CAST(narrow > 0 AS INT) AS presence FROM known),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY presence ORDER BY {_MD5}, shot_id) AS rk,
        COUNT(*) OVER (PARTITION BY presence) AS n FROM k)
SELECT shot_id, presence, CASE WHEN rk <= CEIL(0.7E0*n) THEN 'train' ELSE 'test' END AS split FROM r""")

register("cv_folds", f"""
WITH {KNOWN_CTE},
k AS (SELECT shot_id, CAST(narrow > 0 AS INT) AS presence, rep FROM known, range(1, 4) t(rep))
SELECT shot_id, presence, CAST(rep AS INT) AS "repeat",
  CAST(NTILE(10) OVER (PARTITION BY presence, rep ORDER BY md5(concat_ws(':', CAST(shot_id AS VARCHAR), '666', CAST(rep AS VARCHAR))), shot_id) AS INT) AS fold
FROM k""")

register("bootstrap_draws", f"""
WITH {KNOWN_CTE},
r AS (SELECT shot_id, yr, ROW_NUMBER() OVER (PARTITION BY yr ORDER BY {_MD5}, shot_id) AS rk,
        COUNT(*) OVER (PARTITION BY yr) AS n FROM known),
slots AS (SELECT yr, rk AS slot, n, rep FROM r, range(1, 6) t(rep)),
draws AS (SELECT yr, rep, 1 + (('0x' || substr(md5(concat_ws(':', '666', CAST(rep AS VARCHAR), CAST(yr AS VARCHAR), CAST(slot AS VARCHAR))), 1, 15))::BIGINT % n) AS rk FROM slots),
cnt AS (SELECT yr, rep, rk, COUNT(*) AS c FROM draws GROUP BY yr, rep, rk)
SELECT CAST(rep AS INT) AS replicate, cnt.yr, shot_id, c AS count FROM cnt JOIN r ON cnt.yr = r.yr AND cnt.rk = r.rk""")

SCORES_CTE = KNOWN_CTE + """,
sc AS (SELECT 'narrow' AS species, hrs, CAST(narrow > 0 AS INT) AS presence FROM known
       UNION ALL SELECT 'green', hrs, CAST(green > 0 AS INT) FROM known),
t AS (SELECT species, hrs AS s, SUM(presence) AS pos, SUM(1 - presence) AS neg FROM sc
      WHERE hrs IS NOT NULL GROUP BY species, hrs),
c AS (SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY species ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
        COALESCE(SUM(pos) OVER (PARTITION BY species ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_below FROM t)"""

register("auc_exact", f"""
WITH {SCORES_CTE}
SELECT species, ROUND(SUM(pos*(neg_below + 0.5E0*neg))/(SUM(pos)*SUM(neg)),6) AS auc,
  CAST(SUM(pos) AS BIGINT) AS n_pos, CAST(SUM(neg) AS BIGINT) AS n_neg FROM c GROUP BY species""")

register("roc_curve", f"""
WITH {SCORES_CTE},
tot AS (SELECT species, SUM(pos) AS P, SUM(neg) AS N FROM t GROUP BY species)
SELECT c.species, ROUND(s,6) AS threshold, ROUND((P - pos_below)/P,6) AS sensitivity, ROUND(neg_below/N,6) AS specificity
FROM c JOIN tot ON c.species = tot.species""")

register("confusion", f"""
WITH {KNOWN_CTE},
sc AS (SELECT 'narrow' AS species, hrs/7.0E0 AS score, CAST(narrow > 0 AS INT) AS y FROM known
       UNION ALL SELECT 'green', hrs/7.0E0, CAST(green > 0 AS INT) FROM known),
g AS (SELECT species, SUM(y*CAST(score >= 0.5E0 AS INT)) AS tp, SUM((1-y)*CAST(score >= 0.5E0 AS INT)) AS fp,
        SUM((1-y)*(1-CAST(score >= 0.5E0 AS INT))) AS tn, SUM(y*(1-CAST(score >= 0.5E0 AS INT))) AS fn
      FROM sc WHERE score IS NOT NULL GROUP BY species)
SELECT species, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn,
  ROUND(tp/(tp+fn),6) AS sensitivity, ROUND(tn/(tn+fp),6) AS specificity, ROUND((tp+tn)/(tp+tn+fp+fn),6) AS accuracy FROM g""")

register("scaled_covariates", f"""
WITH {KNOWN_CTE},
st AS (SELECT AVG(hrs) AS mh, STDDEV_SAMP(hrs) AS sh, AVG(lat) AS mla, STDDEV_SAMP(lat) AS sla,
         AVG(lon) AS mlo, STDDEV_SAMP(lon) AS slo, AVG(mn) AS mm, STDDEV_SAMP(mn) AS sm FROM known)
SELECT shot_id, ROUND((hrs-mh)/sh,6) AS hrs, ROUND((lat-mla)/sla,6) AS lat, ROUND((lon-mlo)/slo,6) AS lon,
  ROUND((mn-mm)/sm,6) AS mn FROM known, st""")

# the CSV round trip reproduces the flagship numbers (1994 < yr <= 2001 keeps every year here)
ORACLE["shot_log_roundtrip"] = ORACLE["nominal_cpue"]

register("landings_profile", f"""
WITH {KNOWN_CTE},
kl AS (SELECT *, total_catch/1000.0E0 AS landings_t FROM known),
g AS ({_PROFILE_DIM.format(n='mn', e='mn').replace('SUM(hrs) AS hrs', 'SUM(landings_t) AS hrs').replace('FROM known', 'FROM kl')}
  UNION ALL {_PROFILE_DIM.format(n='depth_bin', e='10.0E0*round_even(depth/10.0E0,0)').replace('SUM(hrs) AS hrs', 'SUM(landings_t) AS hrs').replace('FROM known', 'FROM kl')})
SELECT 'narrow' AS species, dimension, level, CAST(c_narrow AS BIGINT) AS catch, CAST(p_narrow AS BIGINT) AS positive_shots,
  ROUND(hrs,6) AS landings_t, shots FROM g WHERE p_narrow > 0
UNION ALL
SELECT 'green', dimension, level, CAST(c_green AS BIGINT), CAST(p_green AS BIGINT), ROUND(hrs,6), shots FROM g WHERE p_green > 0""")

register("bin_weights", f"""
WITH {KNOWN_CTE},
b AS (SELECT CAST(CEIL(hrs/0.5E0) AS INT) AS bin FROM known WHERE hrs > 0 AND hrs <= 7.0E0),
c AS (SELECT bin, COUNT(*) AS shots FROM b GROUP BY bin)
SELECT bin, shots, ROUND(shots*(1.0E0/shots),6) AS weight_sum, ROUND(1.0E0/shots,6) AS weight FROM c""")

register("class_table", f"""
WITH {KNOWN_CTE},
k AS (SELECT CAST(narrow > 0 AS INT) AS observed, CAST(hrs/7.0E0 >= 0.5E0 AS INT) AS predicted FROM known),
cl AS (SELECT observed AS c FROM k UNION SELECT predicted FROM k),
cnt AS (SELECT observed, predicted, COUNT(*) AS n FROM k GROUP BY 1, 2)
SELECT a.c AS observed, b.c AS predicted, COALESCE(n, 0) AS n FROM cl a CROSS JOIN cl b
LEFT JOIN cnt ON cnt.observed IS NOT DISTINCT FROM a.c AND cnt.predicted IS NOT DISTINCT FROM b.c""")

# S3: text grids hold start positions and depths of known-vessel shots (written with
# 4 and 1 decimals, exact for these values), split over two files and read back
register("grid_text", f"""
WITH {KNOWN_CTE}
SELECT ROUND(1.0E0*round_even(slong/1.0E0, 0),6) AS lon_bin, COUNT(*) AS points, ROUND(AVG(sdepth),6) AS mean_depth
FROM known WHERE slong IS NOT NULL AND slat IS NOT NULL AND sdepth IS NOT NULL GROUP BY 1""")

register("distinct_years", f"""
WITH {KNOWN_CTE}
SELECT DISTINCT yr FROM known WHERE narrow > 0 ORDER BY yr""")

register("climatology_head", f"""
WITH {SST_CTE}
SELECT yr, mn, ROUND(AVG(value),6) AS temperature FROM sst
WHERE {BBOX} AND yr IS NOT NULL AND mn IS NOT NULL AND value IS NOT NULL GROUP BY yr, mn ORDER BY yr, mn LIMIT 6""")

register("interactions_by_hour", f"""
WITH {SHOTS_HOURLY_CTE},
h AS (SELECT * FROM shots_hourly WHERE hrs >= 1.0E0/6.0E0),
l AS (SELECT 'narrow' AS species, start_hour, narrow AS k FROM h UNION ALL SELECT 'green', start_hour, green FROM h)
SELECT species, start_hour, CAST(SUM(k) AS BIGINT) AS interactions FROM l WHERE k > 0 GROUP BY species, start_hour""")

# the streaming state reproduces the batch flagship
ORACLE["stream_nominal_cpue"] = ORACLE["nominal_cpue"]

register("imputed_join", f"""
WITH {KNOWN_CTE},
cells AS (SELECT shot_id, slat, slong, depth, {CELL_LAT} AS cl, {CELL_LON} AS cn FROM known),
means AS (SELECT cl, cn, AVG(depth) AS m FROM cells GROUP BY cl, cn),
imputed AS (SELECT shot_id, slat, slong, COALESCE(depth, m) AS depth_imp
            FROM cells LEFT JOIN means ON cells.cl = means.cl AND cells.cn = means.cn),
j AS (SELECT k.depth, i.depth_imp FROM known k LEFT JOIN imputed i
      ON k.shot_id IS NOT DISTINCT FROM i.shot_id AND k.slat IS NOT DISTINCT FROM i.slat AND k.slong IS NOT DISTINCT FROM i.slong)
SELECT depth IS NULL AS was_missing, COUNT(*) AS shots, COUNT(depth_imp) AS filled, ROUND(AVG(depth_imp),6) AS mean_depth
FROM j GROUP BY 1""")

register("vessel_recode", f"""
WITH {PREPARED_CTE}
SELECT CASE vessel WHEN 'Vessel 2 II' THEN 'Vessel 2' WHEN 'VESSEL 3' THEN 'Vessel 3' WHEN 'vessel 4' THEN 'never' ELSE vessel END AS vessel,
  COUNT(*) AS shots FROM prepared GROUP BY 1""")

register("missing_depth", f"""
WITH {KNOWN_CTE},
k AS (SELECT CASE WHEN mn BETWEEN 3 AND 8 THEN 'AuWin' WHEN mn IS NOT NULL THEN 'SprSu' END AS season,
        CASE WHEN depth IS NULL THEN 'Y' ELSE 'N' END AS depth_missing, depth FROM known)
SELECT season, depth_missing, COUNT(*) AS shots, CAST(SUM(CASE WHEN depth < 100.0E0 THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM k GROUP BY 1, 2""")

register("presence_odds", f"""
WITH {KNOWN_CTE},
v AS (SELECT CASE WHEN lower(vessel) = 'vessel 2 ii' THEN 'vessel 2' ELSE lower(vessel) END AS vessel, narrow FROM known),
t AS (SELECT vessel, (SUM(CASE WHEN narrow > 0 THEN 1 ELSE 0 END) + 0.5E0) / (COUNT(*) + 1.0E0) AS p FROM v GROUP BY 1),
o AS (SELECT *, p / (1.0E0 - p) AS odds FROM t)
SELECT vessel, ROUND(p,6) AS p, ROUND(odds,6) AS odds, ROUND(odds / (SELECT odds FROM o ORDER BY vessel LIMIT 1),6) AS odds_ratio,
  ROUND(1.0E0/(1.0E0+exp(-ln(odds))),6) AS by_logit, ROUND(1.0E0-exp(-exp(ln(p))),6) AS by_cloglog,
  CASE WHEN p*p*p < 0.001E0 THEN '<0.001' ELSE CAST(ROUND(p*p*p,3) AS VARCHAR) END AS p_text FROM o""")

register("rate_per_1000h", f"""
WITH {KNOWN_CTE}
SELECT yr, ROUND(SUM(narrow)/SUM(hrs)*1000.0E0,6) AS narrow, ROUND(SUM(green)/SUM(hrs)*1000.0E0,6) AS green FROM known GROUP BY yr""")

register("boot_rate_band", f"""
WITH {KNOWN_CTE},
r AS (SELECT shot_id, yr, hrs, narrow, green, ROW_NUMBER() OVER (PARTITION BY yr ORDER BY md5(concat_ws(':', CAST(shot_id AS VARCHAR), '666')), shot_id) AS rk,
        COUNT(*) OVER (PARTITION BY yr) AS n FROM known),
slots AS (SELECT yr, rk AS slot, n, rep FROM r, range(1, 6) t(rep)),
draws AS (SELECT yr, rep, 1 + (('0x' || substr(md5(concat_ws(':', '666', CAST(rep AS VARCHAR), CAST(yr AS VARCHAR), CAST(slot AS VARCHAR))), 1, 15))::BIGINT % n) AS rk FROM slots),
per AS (SELECT rep, SUM(narrow)/SUM(hrs) AS narrow, SUM(green)/SUM(hrs) AS green FROM draws JOIN r ON draws.yr = r.yr AND draws.rk = r.rk GROUP BY rep),
l AS (SELECT 'narrow' AS species, narrow AS m FROM per UNION ALL SELECT 'green', green FROM per)
SELECT species, ROUND(quantile_cont(m, 0.5),6) AS median, ROUND(stddev_samp(m),6) AS sd, ROUND(100.0E0*stddev_samp(m)/AVG(m),6) AS cv_pct,
  ROUND(quantile_cont(m, 0.025),6) AS low, ROUND(quantile_cont(m, 0.975),6) AS up, COUNT(*) AS n_boot FROM l GROUP BY species""")

register("cv_resample_summary", f"""
WITH {KNOWN_CTE},
k AS (SELECT shot_id, hrs, CAST(narrow > 0 AS INT) AS presence, rep FROM known, range(1, 4) t(rep)),
f AS (SELECT *, NTILE(10) OVER (PARTITION BY presence, rep ORDER BY md5(concat_ws(':', CAST(shot_id AS VARCHAR), '666', CAST(rep AS VARCHAR))), shot_id) AS fold FROM k),
t AS (SELECT rep, fold, hrs AS s, SUM(presence) AS pos, SUM(1 - presence) AS neg FROM f GROUP BY rep, fold, hrs),
c AS (SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY rep, fold ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM t),
a AS (SELECT rep, fold, SUM(pos*(neg_below + 0.5E0*neg))/(SUM(pos)*SUM(neg)) AS auc FROM c GROUP BY rep, fold)
SELECT ROUND(MIN(auc),6) AS auc_min, ROUND(AVG(auc),6) AS auc_mean, ROUND(MAX(auc),6) AS auc_max, ROUND(quantile_cont(auc, 0.25),6) AS auc_q1,
  ROUND(quantile_cont(auc, 0.5),6) AS auc_median, ROUND(quantile_cont(auc, 0.75),6) AS auc_q3 FROM a""")

register("factor_codes", f"""
WITH {KNOWN_CTE},
k AS (SELECT CASE WHEN mn BETWEEN 3 AND 8 THEN 'AuWin' WHEN mn IS NOT NULL THEN 'SprSu' END AS season,
        CASE WHEN hrs < 2.0E0 THEN 'Short' WHEN hrs < 4.0E0 THEN 'Standard' WHEN hrs >= 4.0E0 THEN 'Long' END AS effort_class FROM known),
p AS (SELECT season, effort_class, COUNT(*) AS shots FROM k WHERE season IS NOT NULL AND effort_class IS NOT NULL GROUP BY 1, 2),
s AS (SELECT season, ROW_NUMBER() OVER (ORDER BY season) - 1 AS i FROM (SELECT DISTINCT season FROM p)),
e AS (SELECT effort_class, ROW_NUMBER() OVER (ORDER BY effort_class) - 1 AS i FROM (SELECT DISTINCT effort_class FROM p))
SELECT p.season AS season_level, p.effort_class AS effort_class_level, CAST(s.i AS INT) AS season_idx, CAST(e.i AS INT) AS effort_class_idx,
  (SELECT string_agg(CASE WHEN o.i = s.i THEN '1' ELSE '0' END, ',' ORDER BY o.i) FROM s o WHERE o.i > 0) AS season_code,
  (SELECT string_agg(CASE WHEN o.i = e.i THEN '1' ELSE '0' END, ',' ORDER BY o.i) FROM e o WHERE o.i > 0) AS effort_class_code, shots
FROM p JOIN s ON s.season = p.season JOIN e ON e.effort_class = p.effort_class""")

ORACLE["sst_csv"] = ORACLE["climatology"]

register("year_tables", f"""
WITH {KNOWN_CTE}
SELECT yr, CAST(SUM(narrow) AS BIGINT) AS narrow, CAST(SUM(green) AS BIGINT) AS green, ROUND(SUM(hrs),6) AS hrs
FROM known WHERE yr BETWEEN 1994 AND 1996 GROUP BY yr""")

register("rate_bands", f"""
WITH {KNOWN_CTE},
l AS (SELECT 'narrow' AS species, yr, narrow / hrs AS rate FROM known WHERE narrow > 0
      UNION ALL SELECT 'green', yr, green / hrs FROM known WHERE green > 0)
SELECT species, yr, COUNT(*) AS positive, CAST(SUM(CASE WHEN rate > 0 AND rate < 0.4E0 THEN 1 ELSE 0 END) AS BIGINT) AS inside,
  ROUND(AVG(CASE WHEN rate > 0 AND rate < 0.4E0 THEN rate END),6) AS mean_rate FROM l GROUP BY species, yr""")

register("prediction_grid", f"""
WITH {KNOWN_CTE},
k AS (SELECT CAST(yr AS VARCHAR) AS yrs, CASE WHEN mn BETWEEN 3 AND 8 THEN 'AuWin' WHEN mn IS NOT NULL THEN 'SprSu' END AS season,
        vessel, lon, hrs FROM known),
c AS (SELECT 'yrs' AS f, yrs AS v, COUNT(*) AS n FROM k WHERE yrs IS NOT NULL GROUP BY 2
      UNION ALL SELECT 'season', season, COUNT(*) FROM k WHERE season IS NOT NULL GROUP BY 2
      UNION ALL SELECT 'vessel', vessel, COUNT(*) FROM k WHERE vessel IS NOT NULL GROUP BY 2),
o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY f ORDER BY n, v) AS rarest, ROW_NUMBER() OVER (PARTITION BY f ORDER BY n DESC, v DESC) AS modal FROM c),
p AS (SELECT r.reference, MAX(CASE WHEN f = 'yrs' THEN v END) AS yrs, MAX(CASE WHEN f = 'season' THEN v END) AS season,
        MAX(CASE WHEN f = 'vessel' THEN v END) AS vessel, (SELECT AVG(lon) FROM k) AS lon, (SELECT AVG(hrs) FROM k) AS hrs
      FROM o, (VALUES ('rarest'), ('modal')) r(reference)
      WHERE CASE r.reference WHEN 'rarest' THEN rarest ELSE modal END = 1 GROUP BY r.reference),
b AS (SELECT MIN(hrs) AS lo, CAST(FLOOR((MAX(hrs) - MIN(hrs)) / 0.5E0 + 1E-9) AS BIGINT) AS steps FROM k),
h AS (SELECT lo + i * 0.5E0 AS hrs FROM b, range(0, 100000) t(i) WHERE i <= steps)
SELECT reference, 'yrs' AS term, CAST(c.v AS DOUBLE) AS x, c.v AS yrs, season, vessel, ROUND(lon,6) AS lon, ROUND(hrs,6) AS hrs FROM p, c WHERE c.f = 'yrs'
UNION ALL SELECT reference, 'season', NULL, yrs, c.v, vessel, ROUND(lon,6), ROUND(hrs,6) FROM p, c WHERE c.f = 'season'
UNION ALL SELECT reference, 'hrs', ROUND(h.hrs,6), yrs, season, vessel, ROUND(lon,6), ROUND(h.hrs,6) FROM p, h""")

register("dispersion_about_means", f"""
WITH {KNOWN_CTE},
l AS (SELECT 'narrow' AS species, yr, narrow AS n FROM known UNION ALL SELECT 'green', yr, green FROM known),
m AS (SELECT species, yr, AVG(n) AS mu FROM l GROUP BY 1, 2),
t AS (SELECT species, ((n - mu) * (n - mu) - n) / mu AS t FROM l JOIN m USING (species, yr) WHERE mu > 0)
SELECT species, ROUND(AVG(t),6) AS alpha, COUNT(*) AS n, ROUND(STDDEV_SAMP(t)/SQRT(COUNT(*)),6) AS se,
  ROUND(AVG(t)/(STDDEV_SAMP(t)/SQRT(COUNT(*))),6) AS z FROM t GROUP BY species""")
