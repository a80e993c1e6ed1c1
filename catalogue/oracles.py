"""DuckDB SQL with the same result as the query of the same name.

Written from the meaning of each operator, not from the Spark plan: windows and
plain joins wherever the Spark side aggregates, splits or packs.
"""

from __future__ import annotations

LAT = "((c_custkey * 37) % 17900) / 100.0 - 89.5"
LON = "((c_custkey * 91) % 35900) / 100.0 - 179.5"
SCORE = "(((c_custkey * 13) % 121) - 10) / 100.0"
NO_CODES = "TRY_CAST(NULL AS INTEGER)"


def _built(key: str) -> str:
    text = f"CASE WHEN {key} % 10 = 7 THEN 'n/a' ELSE CAST({key} % 17 + 1985 AS VARCHAR) END"
    return f"TRY_CAST({text} AS DOUBLE)"


def _land_use(code: str) -> str:
    ranges = [
        (11, 13, "SINGLE OR TWO RESIDENTIAL"),
        (21, 25, "MULTIFAMILY"),
        (31, 38, "OFFICE AND PUBLIC SERVICE"),
        (40, 49, "INSTITUTIONAL"),
        (51, 53, "COMMERCIAL"),
        (62, 62, "AIRPORT"),
        (61, 69, "INDUSTRIAL"),
        (70, 97, "OPEN SPACES/NA"),
        (0, 8, "OPEN SPACES/NA"),
    ]
    tests = " ".join(f"WHEN {code} BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in ranges)
    return f"CASE {tests} ELSE CAST({code} AS VARCHAR) END"


LOCATIONS = f"""
locations AS (
  SELECT c_custkey,
         CAST(CASE WHEN c_custkey % 50 = 3 THEN NULL WHEN c_custkey % 50 = 4 THEN -91.0
              ELSE {LAT} END AS DOUBLE) AS lat,
         CAST({LON} AS DOUBLE) AS "long",
         CAST({SCORE} AS DOUBLE) AS scores
  FROM customer)"""

CLEAN = "SELECT * FROM locations WHERE lat IS NOT NULL AND lat >= -90"

FEED = """
SELECT lat, "long", scores AS score,
       CASE WHEN scores >= 0.6 THEN 'high' WHEN scores >= 0.4 THEN 'mid'
            WHEN scores >= 0 THEN 'low' END AS band,
       CASE WHEN scores >= 0.6 THEN 'red' WHEN scores >= 0.4 THEN 'yellow'
            WHEN scores >= 0 THEN 'green' END AS color,
       'Score: ' || CAST(scores AS VARCHAR) AS popup
FROM locations WHERE lat IS NOT NULL"""

# Bits by halving intervals: b-th bit of a coordinate in 0..1 is the parity of its cell of width 2^-b.
GEOHASH = """
SELECT c_custkey, lat, "long", scores,
       array_to_string(list_transform(range(5), lambda d: substr('0123456789bcdefghjkmnpqrstuvwxyz',
         1 + CAST(list_sum(list_transform(range(5), lambda i:
           (CAST(floor(CASE WHEN (5 * d + i) % 2 = 0
                            THEN ("long" + 180) / 360 ELSE (lat + 90) / 180 END
                       * (2 ** ((5 * d + i) // 2 + 1))) AS BIGINT) % 2) * (1 << (4 - i)))) AS BIGINT),
         1)), '') AS geohash
FROM (SELECT * FROM locations WHERE lat IS NOT NULL AND lat >= -90)"""

SCORED = """
scored AS (
  SELECT d.doc_id, d.n_chars, d.lang, l.toxic AS y, 100.0::DOUBLE / (d.n_chars + 100) AS scores,
         CAST(100.0::DOUBLE / (d.n_chars + 100) >= 0.1 AS INTEGER) AS y_pred
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

# The events of the stand-in tables, with years.
EVENTS = """
ev AS (SELECT o_custkey AS address, CAST(year(o_orderdate) AS INTEGER) AS y,
              o_orderpriority AS kind, o_orderstatus AS status, o_totalprice AS price FROM orders),
offences AS (SELECT DISTINCT user_id AS address, CAST(event_id % 7 + 1995 AS INTEGER) AS y,
                    event_type AS kind FROM events),
visits AS (SELECT l_orderkey AS address, CAST(year(l_shipdate) AS INTEGER) AS y,
                  l_returnflag AS kind FROM lineitem)"""

PRIORITIES = {
    "n_urgent": "1-URGENT",
    "n_high": "2-HIGH",
    "n_medium": "3-MEDIUM",
    "n_low": "5-LOW",
    "n_never": "9-NEVER",
}
MATRIX = ", ".join(
    f"count(*) FILTER (WHERE {{kind}} = '{value}') AS {name}" for name, value in PRIORITIES.items()
)


def _matrix(kind: str) -> str:
    return MATRIX.format(kind=kind)


PROPERTY = f"""
SELECT c_custkey AS address, {{ref}} - {_built("c_custkey")} AS age, c_mktsegment AS segment,
       CAST({LAT} AS DOUBLE) AS lat, CAST({LON} AS DOUBLE) AS lon
FROM customer"""

CODE_CASES = f"""
SELECT address, {_matrix("kind")}, count(kind) AS total_violations,
       CAST(1 AS INTEGER) AS any_violations
FROM ev WHERE y BETWEEN 1995 AND 1998 GROUP BY address"""

CRIMES = """
SELECT address, count(kind) AS crime_incidents, CAST(1 AS INTEGER) AS any_crime
FROM offences WHERE y BETWEEN 1995 AND 1998 GROUP BY address"""

UTILITY = """
SELECT address, count(y) AS utility_discon_count, 2001 - max(y) AS since_last_disconnect,
       CAST(1 AS INTEGER) AS any_disconnects
FROM ev WHERE status = 'F' AND y BETWEEN 1995 AND 1998 GROUP BY address"""

LABEL = """
SELECT DISTINCT address, CAST(1 AS INTEGER) AS incident
FROM ev WHERE kind = '1-URGENT' AND y BETWEEN 1999 AND 2000"""

INSPECTIONS = """
SELECT address, CAST(min(CASE WHEN kind = 'R' THEN 1 ELSE 0 END) AS INTEGER) AS ready_anytime,
       CASE WHEN count(*) FILTER (WHERE kind IS DISTINCT FROM 'R') > 0
            THEN count(*) FILTER (WHERE kind IS DISTINCT FROM 'R') ELSE count(*) END
         AS inspections_count
FROM visits WHERE y BETWEEN 1995 AND 1998 GROUP BY address"""

PARCELS = f"""
SELECT address, {_land_use("p_size")} AS activity, p_retailprice AS buildval
FROM (SELECT p_partkey // 2 AS address, p_size, p_retailprice,
             row_number() OVER (PARTITION BY p_partkey // 2 ORDER BY p_partkey DESC) AS rn
      FROM part) WHERE rn = 1"""

REOPENED = """
SELECT DISTINCT f.address
FROM ev f JOIN ev p ON f.address = p.address AND p.y > f.y
WHERE f.price > 400000 AND p.status = 'O'
  AND f.y BETWEEN 1995 AND 1998 AND p.y BETWEEN 1995 AND 1998"""

FORECLOSED = f"""
SELECT DISTINCT address, CAST(1 AS INTEGER) AS foreclosed
FROM ev WHERE price > 400000 AND y BETWEEN 1995 AND 1998
  AND address NOT IN (SELECT address FROM ({REOPENED}))"""

FEATURE_TABLE = f"""
WITH {EVENTS},
base AS ({PROPERTY.format(ref="2001")}),
cases AS ({CODE_CASES}), crimes AS ({CRIMES}), utility AS ({UTILITY}), label AS ({LABEL}),
inspected AS ({INSPECTIONS}), parcels AS ({PARCELS}), closed AS ({FORECLOSED}),
rented AS (SELECT DISTINCT address, CAST(1 AS INTEGER) AS rent_reg FROM ev
           WHERE status = 'O' AND y BETWEEN 1995 AND 1998)
SELECT b.*,
       {", ".join(f"coalesce({n}, 0) AS {n}" for n in PRIORITIES)},
       coalesce(total_violations, 0) AS total_violations,
       coalesce(any_violations, 0) AS any_violations,
       coalesce(crime_incidents, 0) AS crime_incidents,
       coalesce(any_crime, 0) AS any_crime,
       coalesce(utility_discon_count, 0) AS utility_discon_count,
       coalesce(since_last_disconnect, 0) AS since_last_disconnect,
       coalesce(any_disconnects, 0) AS any_disconnects,
       coalesce(rent_reg, 0) AS rent_reg,
       coalesce(incident, 0) AS incident,
       coalesce(ready_anytime, 0) AS ready_anytime,
       coalesce(inspections_count, 0) AS inspections_count,
       coalesce(activity, '0') AS activity,
       coalesce(buildval, 0.0) AS buildval,
       coalesce(foreclosed, 0) AS foreclosed
FROM base b LEFT JOIN cases USING (address) LEFT JOIN crimes USING (address)
LEFT JOIN utility USING (address) LEFT JOIN label USING (address)
LEFT JOIN inspected USING (address) LEFT JOIN parcels USING (address)
LEFT JOIN closed USING (address) LEFT JOIN rented USING (address)"""


def _seen(name: str, measure: str, source: str, since: int | None = None) -> str:
    """Events of ``source`` joined to every as-of year from their own year on."""
    late = f" AND a.as_of >= {since}" if since else ""
    return f"""{name} AS (
  SELECT e.address, a.as_of, {measure} FROM {source} e JOIN years a ON e.y <= a.as_of{late}
  GROUP BY e.address, a.as_of)"""


PANEL = f"""
WITH {EVENTS},
years AS (SELECT CAST(range AS INTEGER) AS as_of FROM range(1995, 2002)),
base AS (SELECT c_custkey AS address, as_of, as_of - {_built("c_custkey")} AS age,
                c_mktsegment AS segment, CAST({LAT} AS DOUBLE) AS lat, CAST({LON} AS DOUBLE) AS lon
         FROM customer, years WHERE {_built("c_custkey")} <= as_of),
{_seen("cases", _matrix("e.kind") + ", count(e.kind) AS total_violations, 1 AS any_violations", "ev", 1996)},
{_seen("crimes", "count(e.kind) AS crime_incident, 1 AS any_crime", "offences", 1997)},
{_seen("utility", "count(*) AS discons, a.as_of - max(e.y) AS since_last",
       "(SELECT * FROM ev WHERE status = 'F')")},
{_seen("permits", "a.as_of - max(e.y) AS permit_duration", "(SELECT * FROM ev WHERE status = 'O')")},
{_seen("inspected", "min(CASE WHEN e.kind = 'R' THEN 1 ELSE 0 END) AS ready", "visits", 1996)},
label AS (SELECT DISTINCT e.address, a.as_of FROM ev e JOIN years a
          ON e.y BETWEEN a.as_of AND a.as_of + 2 WHERE e.kind = '1-URGENT'),
reopened AS (SELECT DISTINCT f.address, a.as_of FROM ev f
             JOIN ev p ON f.address = p.address AND p.y > f.y
             JOIN years a ON p.y <= a.as_of WHERE f.price > 400000 AND p.status = 'O'),
filed AS (SELECT DISTINCT e.address, a.as_of FROM ev e JOIN years a ON e.y <= a.as_of
          WHERE e.price > 400000),
closed AS (SELECT * FROM filed EXCEPT SELECT * FROM reopened),
parcels AS ({PARCELS})
SELECT b.address, b.as_of, b.age, b.segment, b.lat, b.lon,
       {", ".join(f"coalesce(c.{n}, 0) AS {n}" for n in PRIORITIES)},
       coalesce(c.total_violations, 0) AS total_violations,
       CAST(coalesce(c.any_violations, 0) AS INTEGER) AS any_violations,
       coalesce(k.crime_incident, 0) AS crime_incident,
       CAST(coalesce(k.any_crime, 0) AS INTEGER) AS any_crime,
       coalesce(u.discons, 0) AS utility_discon_count,
       CAST(coalesce(u.since_last, 0) AS INTEGER) AS since_last_disconnect,
       CAST(u.address IS NOT NULL AS INTEGER) AS any_disconnects,
       CAST(p.permit_duration AS INTEGER) AS permit_duration,
       CAST(p.address IS NOT NULL AS INTEGER) AS rent_reg,
       CAST(l.address IS NOT NULL AS INTEGER) AS incident,
       CAST(coalesce(i.ready, 0) AS INTEGER) AS ready_anytime,
       coalesce(x.activity, '0') AS activity, coalesce(x.buildval, 0.0) AS buildval,
       CAST(z.address IS NOT NULL AS INTEGER) AS foreclosed,
       CAST(b.as_of + 2 <= 2000 AS INTEGER) AS label_complete
FROM base b
LEFT JOIN cases c ON b.address = c.address AND b.as_of = c.as_of
LEFT JOIN crimes k ON b.address = k.address AND b.as_of = k.as_of
LEFT JOIN utility u ON b.address = u.address AND b.as_of = u.as_of
LEFT JOIN permits p ON b.address = p.address AND b.as_of = p.as_of
LEFT JOIN inspected i ON b.address = i.address AND b.as_of = i.as_of
LEFT JOIN label l ON b.address = l.address AND b.as_of = l.as_of
LEFT JOIN closed z ON b.address = z.address AND b.as_of = z.as_of
LEFT JOIN parcels x ON b.address = x.address"""

# One as-of year, 1997, with the rows of permits, fires, inspection states and parcels as they are.
AS_OF_ROWS = f"""
WITH {EVENTS},
base AS (SELECT DISTINCT c_custkey AS address, 1997 - {_built("c_custkey")} AS age,
                c_mktsegment AS segment, CAST({LAT} AS DOUBLE) AS lat, CAST({LON} AS DOUBLE) AS lon
         FROM customer WHERE {_built("c_custkey")} <= 1997),
cases AS (SELECT address, {_matrix("kind")}, count(kind) AS total_violations FROM ev
          WHERE y <= 1997 GROUP BY address),
crimes AS (SELECT address, count(kind) AS crime_incident FROM offences WHERE y <= 1997
           GROUP BY address),
utility AS (SELECT address, count(*) AS discons, 1997 - max(y) AS since_last FROM ev
            WHERE status = 'F' AND y <= 1997 GROUP BY address),
filed AS (SELECT DISTINCT address FROM ev WHERE price > 400000 AND y <= 1997),
reopened AS (SELECT DISTINCT f.address FROM ev f JOIN ev p ON f.address = p.address AND p.y > f.y
             WHERE f.price > 400000 AND p.status = 'O' AND p.y <= 1997),
closed AS (SELECT * FROM filed EXCEPT SELECT * FROM reopened),
permits AS (SELECT address, 1997 - year(d) AS permit_duration FROM (
              SELECT DISTINCT o_custkey AS address, o_orderpriority, o_orderdate AS d FROM orders
              WHERE o_orderstatus = 'O' AND year(o_orderdate) <= 1997)),
fires AS (SELECT address FROM ev WHERE kind = '1-URGENT' AND y BETWEEN 1997 AND 1999),
states AS (SELECT DISTINCT address, CAST(kind IS NOT DISTINCT FROM 'R' AS INTEGER) AS ready
           FROM visits WHERE y <= 1997),
parcels AS (SELECT DISTINCT p_partkey // 2 AS address, {_land_use("p_size")} AS activity,
                   p_retailprice AS buildval FROM part)
SELECT b.*,
       {", ".join(f"coalesce(c.{n}, 0) AS {n}" for n in PRIORITIES)},
       coalesce(c.total_violations, 0) AS total_violations,
       CAST(c.address IS NOT NULL AS INTEGER) AS any_violations,
       coalesce(k.crime_incident, 0) AS crime_incident,
       CAST(k.address IS NOT NULL AS INTEGER) AS any_crime,
       coalesce(u.discons, 0) AS utility_discon_count,
       CAST(coalesce(u.since_last, 0) AS INTEGER) AS since_last_disconnect,
       CAST(u.address IS NOT NULL AS INTEGER) AS any_disconnects,
       CAST(p.permit_duration AS INTEGER) AS permit_duration,
       CAST(p.address IS NOT NULL AS INTEGER) AS rent_reg,
       CAST(f.address IS NOT NULL AS INTEGER) AS incident,
       coalesce(i.ready, 0) AS ready_anytime,
       coalesce(x.activity, '0') AS activity, coalesce(x.buildval, 0.0) AS buildval,
       CAST(z.address IS NOT NULL AS INTEGER) AS foreclosed
FROM base b LEFT JOIN cases c USING (address) LEFT JOIN crimes k USING (address)
LEFT JOIN utility u USING (address) LEFT JOIN closed z USING (address)
LEFT JOIN permits p USING (address) LEFT JOIN fires f USING (address)
LEFT JOIN states i USING (address) LEFT JOIN parcels x USING (address)"""

TRACE_WIDTHS = {
    "properties": 5,
    "code_cases": 12,
    "offenses": 14,
    "utility_disconnects": 17,
    "rentals": 18,
    "incidents": 19,
    "inspections": 21,
    "parcels": 23,
    "foreclosures": 24,
}


def _profiled(name: str, number: bool) -> str:
    value = f"CAST({name} AS DOUBLE)" if number else "NULL::DOUBLE"
    text = "NULL::VARCHAR"
    if not number:
        shown = "CAST(o_orderdate AS VARCHAR)" if name == "o_orderdate" else name
        text = shown
    return f"""
SELECT '{name}' AS column_name, count(*) AS "rows", count(*) - count({name}) AS nulls,
       count(DISTINCT {name}) AS distinct_values, min({value}) AS min_number,
       max({value}) AS max_number, round(avg({value}), 4) AS mean,
       round(stddev_samp({value}), 4) AS stddev, min({text}) AS min_text, max({text}) AS max_text,
       {", ".join(f"round(quantile_cont({value}, {q}), 4) AS q{round(100 * q):02}" for q in (0.05, 0.25, 0.5, 0.75, 0.95))}
FROM orders"""


def _stumps(groups: str, rounds: int, step: float = 0.3) -> str:
    """Boosted trees of one split each, as a chain of tables ending in ``scored``.

    ``groups`` has (g, o_orderkey, y, fold, prio, month, fifth, train): one model per g, trained on the rows marked.
    A round fits the gradient of the logistic loss: the split with the largest gain of squares, means as outputs.
    """
    parts = [f"g0 AS MATERIALIZED (SELECT *, 0.0::DOUBLE AS m FROM ({groups}))"]
    for t in range(rounds):
        sign = "(2 * y - 1)"
        rest = f"{sign}::DOUBLE" if t == 0 else f"4.0::DOUBLE * {sign} / (1 + exp(2 * {sign} * m))"
        weight = 1.0 if t == 0 else step
        parts.append(f"""
l{t} AS (SELECT g, f, v, sum(r) AS s, count(*) AS n FROM (
  SELECT g, {rest} AS r, unnest(['prio', 'month', 'fifth']) AS f, unnest([prio, month, fifth]) AS v
  FROM g{t} WHERE train) GROUP BY g, f, v),
p{t} AS (SELECT g, f, v, sum(s) OVER w AS sl, sum(n) OVER w AS nl,
  sum(s) OVER (PARTITION BY g, f) AS st, sum(n) OVER (PARTITION BY g, f) AS nt
  FROM l{t} WINDOW w AS (PARTITION BY g, f ORDER BY v)),
b{t} AS MATERIALIZED (SELECT g, f, v, sl / nl AS a, (st - sl) / (nt - nl) AS b FROM (
  SELECT *, row_number() OVER (PARTITION BY g
    ORDER BY sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) DESC, f, v) AS k
  FROM p{t} WHERE nl < nt) WHERE k = 1),
g{t + 1} AS MATERIALIZED (SELECT x.g, o_orderkey, y, fold, prio, month, fifth, train,
  m + {weight}::DOUBLE * CASE WHEN CASE f WHEN 'prio' THEN prio WHEN 'month' THEN month ELSE fifth END <= v
    THEN a ELSE b END AS m
  FROM g{t} AS x JOIN b{t} ON x.g = b{t}.g)""")
    return ", ".join(parts)


GRADED = """
SELECT o_orderkey, prio, month, fifth, CAST(o_orderkey % 5 AS INTEGER) AS fold,
       CAST(2 * prio + month + 3 * fifth + o_orderkey % 7 > 22 AS INTEGER) AS y
FROM (SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS prio,
             CAST(month(o_orderdate) AS DOUBLE) AS month, CAST(o_custkey % 5 AS DOUBLE) AS fifth FROM orders)"""


def _errors_of(rounds: int) -> str:
    return " UNION ALL ".join(
        f"SELECT {t} AS \"round\", round(avg(CAST((m > 0) <> (y > 0) AS DOUBLE)), 9) AS error FROM g{t} WHERE NOT train"
        for t in range(1, rounds + 1)
    )


# Recall, precision and rank sum of (fold, y, y_pred, scores), and their means.
FOLD_METRICS = """
r AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY scores) +
    (count(*) OVER (PARTITION BY fold, scores) - 1) / 2 AS rk FROM f),
m AS (
  SELECT fold,
    count(*) FILTER (WHERE y = 1 AND y_pred = 1) / greatest(count(*) FILTER (WHERE y = 1), 1) AS recall,
    count(*) FILTER (WHERE y = 1 AND y_pred = 1) / greatest(count(*) FILTER (WHERE y_pred = 1), 1) AS precision,
    (sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2)
      / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS roc_auc
  FROM r GROUP BY fold)
SELECT fold, round(recall, 6) AS recall, round(precision, 6) AS precision,
       round(roc_auc, 6) AS roc_auc FROM m
UNION ALL SELECT -1, round(avg(recall), 6), round(avg(precision), 6), round(avg(roc_auc), 6)
FROM m"""


def _centre_round(t: int) -> str:
    floor = "CAST(({s} - (({s} % n) + n) % n) // n AS BIGINT)".format
    return f"""
a{t} AS MATERIALIZED (SELECT lat, lon, n, i FROM (
  SELECT q.lat, q.lon, q.n, c.i, row_number() OVER (PARTITION BY q.lat, q.lon ORDER BY
    (q.lat - c.lat) * (q.lat - c.lat) + (q.lon - c.lon) * (q.lon - c.lon), c.i) AS k
  FROM q, c{t} AS c) WHERE k = 1),
c{t + 1} AS MATERIALIZED (
  SELECT c.i, coalesce({floor(s="x")}, c.lat) AS lat, coalesce({floor(s="y")}, c.lon) AS lon
  FROM c{t} AS c LEFT JOIN (SELECT i, CAST(sum(lat * n) AS BIGINT) AS x, CAST(sum(lon * n) AS BIGINT) AS y,
    CAST(sum(n) AS BIGINT) AS n FROM a{t} GROUP BY i) AS s ON s.i = c.i),"""


GEO_CLUSTERS = f"""
WITH {LOCATIONS}, clean AS ({CLEAN}),
z AS (SELECT *, CAST(round(lat * 1000000) AS BIGINT) AS za, CAST(round("long" * 1000000) AS BIGINT) AS zb FROM clean),
q AS MATERIALIZED (SELECT za AS lat, zb AS lon, count(*) AS n FROM z GROUP BY za, zb),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, lat, lon) - 1 AS i, lat, lon FROM (
  SELECT md5('42:' || lat || ':' || lon) AS h, lat, lon FROM q ORDER BY h, lat, lon LIMIT 10)),
{"".join(_centre_round(t) for t in range(12))}
near AS (SELECT lat, lon, i FROM (
  SELECT q.lat, q.lon, c.i, row_number() OVER (PARTITION BY q.lat, q.lon ORDER BY
    (q.lat - c.lat) * (q.lat - c.lat) + (q.lon - c.lon) * (q.lon - c.lon), c.i) AS k FROM q, c12 AS c) WHERE k = 1)
SELECT z.c_custkey, z.lat, z."long", z.scores, CAST(near.i AS INTEGER) AS cluster
FROM z JOIN near ON z.za = near.lat AND z.zb = near.lon"""


def _top(name: str) -> str:
    return f"""
SELECT '{name}' AS column_name, value, n, CAST(rk AS INTEGER) AS "rank" FROM (
  SELECT CAST({name} AS VARCHAR) AS value, count(*) AS n,
         row_number() OVER (ORDER BY count(*) DESC, CAST({name} AS VARCHAR)) AS rk
  FROM orders GROUP BY {name}) WHERE rk <= 5"""


ORACLES: dict[str, str] = {
    "key_normalise": """
        SELECT p_partkey AS id, replace(upper(p_name), ' ', '') AS key FROM part
        UNION ALL SELECT c_custkey, replace(upper(c_name), ' ', '') FROM customer""",
    "lenient_number": """
        SELECT p_partkey, TRY_CAST(CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR)
            WHEN 1 THEN ' ' || p_size || ' ' WHEN 2 THEN p_size || '.5' ELSE p_brand END
            AS DOUBLE) AS number FROM part""",
    "lenient_timestamp": """
        SELECT o_orderkey, coalesce(try_strptime(t, '%Y-%m-%d'), try_strptime(t, '%m/%d/%Y'))
                 AS stamp
        FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
                WHEN 1 THEN strftime(o_orderdate, '%-m/%-d/%Y') ELSE o_orderstatus END AS t
              FROM orders)""",
    "strict_year": """
        SELECT l_orderkey, l_linenumber, CAST(year(l_shipdate) AS INTEGER) AS ship_year
        FROM lineitem""",
    "age_recency_duration": f"""
        SELECT o_custkey, 2001 - {_built("o_custkey")} AS age,
               CAST(2001 - max(year(o_orderdate)) AS INTEGER) AS since_last,
               CAST(max(year(o_orderdate)) - min(year(o_orderdate)) AS INTEGER) AS duration
        FROM orders GROUP BY o_custkey""",
    "land_use_category": f"""
        SELECT p_partkey, {_land_use("p_size")} AS by_size,
               {_land_use("(p_partkey % 103 - 1)")} AS by_code FROM part""",
    "score_band_feed": f"WITH {LOCATIONS} {FEED}",
    "high_score_feed": f"WITH {LOCATIONS} {FEED} AND scores >= 0.7",
    "haversine_origin": f"""
        SELECT c_custkey, round(2 * 3956.0::DOUBLE * asin(sqrt(
            power(sin(radians({LAT}) / 2), 2)
            + cos(radians({LAT})) * power(sin(radians({LON}) / 2), 2))), 7) AS miles
        FROM customer""",
    "geohash5": f"WITH {LOCATIONS} {GEOHASH}",
    "location_clean": f"WITH {LOCATIONS} {CLEAN}",
    "select_rename_drop": """
        SELECT s_suppkey AS id, s_name AS name FROM supplier
        UNION ALL SELECT c_custkey, c_name FROM customer""",
    "one_hot": "SELECT c_custkey, "
    + ", ".join(
        f"CAST(c_mktsegment = '{s}' AS INTEGER) AS seg_{s}"
        for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    )
    + " FROM customer",
    "window_filter": """
        SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders
        WHERE year(o_orderdate) BETWEEN 1995 AND 1998""",
    "as_of_filter": """
        SELECT l_returnflag, count(*) AS n FROM lineitem
        WHERE year(l_shipdate) <= 1996 GROUP BY l_returnflag""",
    "label_window": """
        SELECT o_orderkey, o_custkey FROM orders
        WHERE year(o_orderdate) BETWEEN 1996 AND 2000 AND o_orderpriority = '1-URGENT'""",
    "null_keeping_inequality": """
        SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders
        WHERE nullif(o_orderstatus, 'P') IS DISTINCT FROM 'F'""",
    "not_in_list": """
        SELECT c_custkey, CASE WHEN c_custkey % 5 > 2 THEN c_name END AS key FROM customer
        WHERE c_custkey % 5 >= 2""",
    "complete_rows": f"WITH {LOCATIONS} SELECT * FROM locations WHERE lat IS NOT NULL",
    "distinct_rows_of_orders": """
        SELECT DISTINCT o_custkey, o_orderpriority, o_orderstatus FROM orders""",
    "last_per_key": """
        SELECT o_custkey, o_orderdate, o_orderkey, o_orderpriority, o_totalprice FROM (
          SELECT *, row_number() OVER (PARTITION BY o_custkey
                                       ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
          FROM orders) WHERE rn = 1""",
    "last_part_per_size": """
        SELECT p_size, p_partkey, p_retailprice FROM (
          SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey DESC) AS rn
          FROM part) WHERE rn = 1""",
    "feature_attach": """
        SELECT c_custkey, c_acctbal, coalesce(n, 0) AS n_orders,
               CAST(n IS NOT NULL AS INTEGER) AS any_order
        FROM customer LEFT JOIN (SELECT o_custkey, count(o_orderkey) AS n FROM orders
                                 GROUP BY o_custkey)
          ON c_custkey = o_custkey""",
    "feature_fanout": """
        SELECT c_custkey, c_mktsegment, o_orderkey, o_orderdate
        FROM customer LEFT JOIN orders ON c_custkey = o_custkey""",
    "fanout_split": """
        SELECT s.o_orderstatus, 1 AS known, o_orderkey
        FROM (SELECT DISTINCT o_orderstatus FROM orders) s
        LEFT JOIN orders o ON s.o_orderstatus = o.o_orderstatus""",
    "events_with_attributes": """
        SELECT l_orderkey, l_linenumber, l_suppkey, s_nationkey
        FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey""",
    "anti_keys": """
        SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (
          SELECT o_custkey FROM orders
          WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000)""",
    "member_flag": """
        SELECT c_custkey, CAST(c_custkey IN (SELECT o_custkey FROM orders
          WHERE o_totalprice > 450000) AS INTEGER) AS big_buyer FROM customer""",
    "reopened_keys": f"WITH {EVENTS} {REOPENED}",
    "foreclosed_flag": f"""
        WITH {EVENTS} SELECT c_custkey AS address, coalesce(foreclosed, 0) AS foreclosed
        FROM customer LEFT JOIN ({FORECLOSED}) f ON c_custkey = f.address""",
    "count_max_per_key": f"""
        WITH {EVENTS} SELECT address, count(y) AS n, max(y) AS last_year
        FROM ev WHERE y BETWEEN 1995 AND 1998 GROUP BY address""",
    "sum_per_key": """
        SELECT l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber,
               sum(l_quantity) AS l_quantity FROM lineitem GROUP BY l_suppkey""",
    "category_matrix": f"""
        SELECT o_custkey, {_matrix("o_orderpriority")}, count(*) AS total,
               CAST(1 AS INTEGER) AS any_order,
               count(*) FILTER (WHERE o_orderpriority <> '4-NOT SPECIFIED') AS listed
        FROM orders GROUP BY o_custkey""",
    "class_balance": """
        SELECT count(*) FILTER (WHERE toxic = 0) AS n0, count(*) FILTER (WHERE toxic = 1) AS n1,
               CAST(count(*) FILTER (WHERE toxic = 0) AS DOUBLE)
                 / count(*) FILTER (WHERE toxic = 1) AS ratio FROM labels""",
    "last_incident": f"""
        WITH {EVENTS},
        past AS (SELECT address, CAST(1997 - max(y) AS INTEGER) AS last_incident FROM ev
                 WHERE kind = '1-URGENT' AND y <= 1997 GROUP BY address),
        now AS (SELECT address, count(*) AS incident_count FROM ev
                WHERE kind = '1-URGENT' AND y BETWEEN 1997 AND 2001 GROUP BY address)
        SELECT * FROM now JOIN past USING (address)""",
    "row_trace": " UNION ALL ".join(
        f"SELECT '{step}' AS step, count(*) AS \"rows\", CAST({width} AS INTEGER) AS columns"
        " FROM customer"
        for step, width in TRACE_WIDTHS.items()
    ),
    "topk_scores": f"WITH {SCORED} SELECT * FROM scored ORDER BY scores DESC, doc_id LIMIT 20",
    "running_hits": f"""
        WITH {SCORED}, ranked AS (
          SELECT doc_id, scores, y, row_number() OVER (ORDER BY scores DESC, doc_id) AS rk
          FROM scored)
        SELECT CAST(a.rk AS BIGINT) AS "rank", a.scores, a.doc_id,
               CAST((SELECT count(*) FROM ranked b WHERE b.rk <= a.rk AND b.y = 1) AS BIGINT)
                 AS cumulative_hits
        FROM ranked a WHERE a.rk <= 20""",
    "hits_in_topk": f"""
        WITH {SCORED} SELECT count(*) FILTER (WHERE y = 1 AND y_pred = 1) AS hits
        FROM (SELECT * FROM scored ORDER BY scores DESC, doc_id LIMIT 100)""",
    "union_with_gaps": f"""
        SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment, {NO_CODES} AS s_nationkey
        FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_nationkey FROM supplier""",
    "fb_property": PROPERTY.format(ref="2001"),
    "fb_property_as_of": PROPERTY.format(ref="1996") + f" WHERE {_built('c_custkey')} <= 1996",
    "fb_code_cases": f"WITH {EVENTS} {CODE_CASES}",
    "fb_crimes": f"WITH {EVENTS} {CRIMES}",
    "fb_utility": f"WITH {EVENTS} {UTILITY}",
    "fb_rental": f"""
        WITH {EVENTS} SELECT address, CAST(1 AS INTEGER) AS rent_reg,
               CAST(1998 - max(y) AS INTEGER) AS permit_duration
        FROM ev WHERE status = 'O' AND y <= 1998 GROUP BY address""",
    "fb_fire_label": f"WITH {EVENTS} {LABEL}",
    "fb_inspections": f"WITH {EVENTS} {INSPECTIONS}",
    "fb_parcels": PARCELS,
    "fb_foreclosure": f"WITH {EVENTS} {FORECLOSED}",
    "full_feature_table": FEATURE_TABLE,
    "full_as_of_panel": PANEL,
    "as_of_rows": AS_OF_ROWS,
    "stratified_split": """
        SELECT doc_id, quality, toxic, CAST(rk <= ceil(n * 0.33::DOUBLE) AS INTEGER) AS is_test
        FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5('42:' || doc_id)) AS rk,
                     count(*) OVER (PARTITION BY toxic) AS n FROM labels)""",
    "shuffled_rows": """
        SELECT c_custkey, row_number() OVER (ORDER BY md5('42:' || c_custkey)) AS position
        FROM customer""",
    "stratified_folds": """
        SELECT doc_id, quality, toxic,
               CAST((row_number() OVER (PARTITION BY toxic ORDER BY md5('42:' || doc_id)) - 1) % 5
                 AS INTEGER) AS fold FROM labels""",
    "confusion_counts": f"""
        WITH {SCORED} SELECT count(*) FILTER (WHERE y = 0 AND y_pred = 0) AS tn,
               count(*) FILTER (WHERE y = 0 AND y_pred = 1) AS fp,
               count(*) FILTER (WHERE y = 1 AND y_pred = 0) AS fn,
               count(*) FILTER (WHERE y = 1 AND y_pred = 1) AS tp FROM scored""",
    "accuracy": f"""
        WITH {SCORED} SELECT accuracy, 1 - accuracy AS error FROM (
          SELECT CAST(count(*) FILTER (WHERE y = y_pred) AS DOUBLE) / count(*) AS accuracy
          FROM scored)""",
    "recall_precision": f"""
        WITH {SCORED} SELECT lang,
          coalesce(count(*) FILTER (WHERE y = 1 AND y_pred = 1)::DOUBLE
            / nullif(count(*) FILTER (WHERE y = 1), 0), 0.0) AS recall,
          coalesce(count(*) FILTER (WHERE y = 1 AND y_pred = 1)::DOUBLE
            / nullif(count(*) FILTER (WHERE y_pred = 1), 0), 0.0) AS "precision"
        FROM scored GROUP BY lang""",
    "column_profile": " UNION ALL ".join(
        _profiled(name, number)
        for name, number in [
            ("o_orderkey", True),
            ("o_custkey", True),
            ("o_orderstatus", False),
            ("o_totalprice", True),
            ("o_orderdate", False),
            ("o_orderpriority", False),
        ]
    ),
    "column_top_values": " UNION ALL ".join(
        _top(name) for name in ("o_custkey", "o_orderstatus", "o_orderpriority")
    ),
    "oof_scores": f"""
        SELECT address, CAST((row_number() OVER (PARTITION BY incident
            ORDER BY md5('42:' || address)) - 1) % 5 AS INTEGER) AS fold,
          incident AS "Incident", true AS in_range, true AS agrees FROM ({FEATURE_TABLE})""",
    "holdout_scores": f"""
        SELECT address, incident AS "Incident", true AS same, true AS in_range, true AS agrees
        FROM (SELECT *, row_number() OVER (PARTITION BY incident ORDER BY md5('42:' || address))
                AS rk, count(*) OVER (PARTITION BY incident) AS n FROM ({FEATURE_TABLE}))
        WHERE rk <= ceil(n * 0.33::DOUBLE)""",
    "iteration_error": """
        SELECT part, true AS complete, true AS ends_right FROM (VALUES ('train'), ('test')) t(part)""",
    "best_round_count": "SELECT true AS trains, true AS stops",
    "feature_importance": "SELECT true AS one_row_each, true AS none_negative, true AS sum_to_one",
    "top_features": """
        SELECT p_name AS feature_name, CAST(p_size AS DOUBLE) AS feature_importance,
               p_partkey AS position FROM part ORDER BY p_size DESC, p_partkey LIMIT 20""",
    "scored_locations": """
        SELECT c_custkey, CASE WHEN c_custkey % 50 = 3 THEN NULL WHEN c_custkey % 50 = 4 THEN -91.0
            ELSE (c_custkey * 37) % 17900 / 100 - 89.5 END AS lat,
          (c_custkey * 91) % 35900 / 100 - 179.5 AS long,
          ((c_custkey * 13) % 121 - 10) / 100 AS scores, CAST(c_custkey % 2 AS INTEGER) AS y,
          CAST(((c_custkey * 13) % 121 - 10) / 100 > 0.5 AS INTEGER) AS y_pred FROM customer""",
    "cv_metrics": f"""
        WITH {SCORED}, f AS (
          SELECT *, CAST((row_number() OVER (PARTITION BY y ORDER BY md5('42:' || doc_id)) - 1) % 5
            AS INTEGER) AS fold FROM scored),
        {FOLD_METRICS}""",
    "boosted_scores": f"""
        WITH {_stumps(f"SELECT 0 AS g, *, true AS train FROM ({GRADED})", 6)}
        SELECT o_orderkey, round(1 / (1 + exp(-2 * m)), 6) AS scores, CAST(m > 0 AS INTEGER) AS y_pred FROM g6""",
    "boosted_round_errors": f"""
        WITH {_stumps(f"SELECT 0 AS g, *, fold <> 0 AS train FROM ({GRADED})", 10)},
        e AS (SELECT CAST("round" AS INTEGER) AS "round", error FROM ({_errors_of(10)})),
        u AS (SELECT a."round", a.error, (SELECT min(b."round") FROM e AS b WHERE b."round" <= a."round"
            AND b.error = (SELECT min(c.error) FROM e AS c WHERE c."round" <= a."round")) AS best FROM e AS a),
        d AS (SELECT coalesce((SELECT best FROM u WHERE "round" - best >= 2 ORDER BY "round" LIMIT 1),
            (SELECT best FROM u ORDER BY "round" DESC LIMIT 1)) AS best)
        SELECT u."round", u.error, u."round" = d.best AS chosen FROM u, d""",
    "boosted_fold_metrics": f"""
        WITH {_stumps(f"SELECT g, o.*, o.fold <> g AS train FROM ({GRADED}) AS o, (SELECT unnest(range(5)) AS g)", 6)},
        f AS (SELECT fold, y, CAST(m > 0 AS INTEGER) AS y_pred, m AS scores FROM g6 WHERE NOT train),
        {FOLD_METRICS}""",
    "dictionary_places": """
        SELECT 0 AS position, 'c_acctbal' AS name
        UNION ALL SELECT CAST(row_number() OVER (ORDER BY v) AS INTEGER), 'c_mktsegment_' || v
        FROM (SELECT DISTINCT c_mktsegment AS v FROM customer WHERE c_mktsegment IS NOT NULL)
        UNION ALL SELECT CAST(row_number() OVER (ORDER BY v)
          + (SELECT count(DISTINCT c_mktsegment) FROM customer) AS INTEGER), 'c_name_' || v
        FROM (SELECT DISTINCT c_name AS v FROM customer WHERE c_name IS NOT NULL)""",
    "dictionary_vectors": """
        WITH k AS (SELECT * FROM part WHERE p_partkey % 20 < 3),
        b AS (SELECT v, row_number() OVER (ORDER BY v) AS i FROM (SELECT DISTINCT p_brand AS v FROM k)),
        t AS (SELECT v, row_number() OVER (ORDER BY v) + (SELECT count(*) FROM b) AS i
              FROM (SELECT DISTINCT p_type AS v FROM k))
        SELECT p_partkey, CAST(p_size AS DOUBLE) AS "first",
          CAST(1 + (SELECT count(*) FROM b) + (SELECT count(*) FROM t) AS INTEGER) AS width,
          concat_ws(',', CAST(b.i AS VARCHAR), CAST(t.i AS VARCHAR)) AS places
        FROM part LEFT JOIN b ON p_brand = b.v LEFT JOIN t ON p_type = t.v""",
    "geo_clusters": GEO_CLUSTERS,
    "running_hits_all": """
        SELECT row_number() OVER w AS "rank",
          CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)
            OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cumulative_hits,
          o_totalprice, o_orderkey
        FROM orders WINDOW w AS (ORDER BY o_totalprice DESC, o_orderkey)""",
    "csv_inferred_types": """
        SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size,
          p_retailprice, NULL::DOUBLE AS nothing, p_partkey % 2 = 0 AS even,
          CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE 'true' END AS mixed,
          CASE WHEN p_partkey = 77 THEN 'n77' ELSE CAST(p_partkey AS VARCHAR) END AS late,
          CAST(p_partkey AS DOUBLE) / 2 AS halves,
          CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_partkey AS BIGINT) END AS gaps
        FROM part""",
    "civic_properties": f"""
        WITH p AS (SELECT upper(CAST(c_custkey AS VARCHAR) || 'mainst') AS "ADDRESS",
          CASE WHEN c_custkey % 10 = 7 THEN 'n/a' ELSE CAST(c_custkey % 17 + 1985 AS VARCHAR) END AS "YEARBUILT",
          CAST({LAT} AS DOUBLE) AS "LAT", CAST({LON} AS DOUBLE) AS "LON", CAST(c_nationkey AS BIGINT) AS "ZONE",
          c_acctbal AS "TAX", c_mktsegment AS "SEGMENT" FROM customer)
        SELECT *, 'csv' AS fmt FROM p UNION ALL SELECT *, 'parquet' FROM p""",
    "csv_text_round_trip": """
        SELECT doc_id, '"a", ""b""' || chr(10) || text AS text, lang FROM documents""",
    "csv_mixed_headers": "SELECT c_custkey, c_name, c_acctbal FROM customer",
    "sink_round_trip": """
        SELECT *, 'parquet' AS fmt FROM customer UNION ALL SELECT *, 'csv' FROM customer""",
}
