"""SQL for DuckDB with the rows of the registered queries, written on its own, from the definitions.

The subsequence length is found as in a bit matrix row held in one integer; names of these tables are short enough.
"""

from __future__ import annotations

from .config import LOOKUPS, NOISE, STOPWORDS, SURETY

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def _norm(x: str) -> str:
    out = f"upper(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'))"
    out = f"regexp_replace({out}, '^({NOISE})\\s+', '')"
    out = f"regexp_replace(regexp_replace({out}, '\\s+({NOISE})$', ''), '^\\s+|\\s+$', '', 'g')"
    return f"trim(regexp_replace(replace({out}, '-', ' '), '\\s+', ' ', 'g'))"


def _lcs(a: str, b: str) -> str:
    full = f"((1::BIGINT << length({a})) - 1)"
    where = f"coalesce(list_sum(list_transform(range(length({a})), lambda i: CASE WHEN ascii(substr({a}, i + 1, 1)) = c THEN 1::BIGINT << i ELSE 0 END)), 0)::BIGINT"
    step = f"(((v + (v & {where})) | (v - (v & {where}))) & {full})"
    chars = f"list_transform(range(length({b})), lambda k: ascii(substr({b}, k + 1, 1))::BIGINT)"
    return f"(length({a}) - bit_count(list_reduce(list_prepend({full}, {chars}), lambda v, c: {step})))"


def _ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = '' AND {b} = '' THEN 100.0 ELSE 200.0::DOUBLE * {_lcs(a, b)} / (length({a}) + length({b})) END)"


def _held(s: str, t: str) -> str:
    """Best ratio of s against windows of t, which is not shorter."""
    windows = (
        f"list_concat(list_concat(list_transform(range(1, length({t}) - length({s}) + 2), lambda p: substr({t}, p, length({s}))), "
        f"list_transform(range(1, length({s})), lambda p: substr({t}, 1, p))), list_transform(range(1, length({s})), lambda p: substr({t}, length({t}) - p + 1, p)))"
    )
    return f"list_max(list_transform({windows}, lambda w: {_ratio('w', s)}))"


def _partial(a: str, b: str) -> str:
    some = f"CASE WHEN length({a}) < length({b}) THEN {_held(a, b)} WHEN length({a}) > length({b}) THEN {_held(b, a)} ELSE greatest({_held(a, b)}, {_held(b, a)}) END"
    return f"(CASE WHEN {a} = '' AND {b} = '' THEN 100.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE {some} END)"


def _sorted(a: str) -> str:
    return f"array_to_string(list_sort(string_split({a}, ' ')), ' ')"


def _scored(pairs: str) -> str:
    """CTEs that end in `scored` (a, b, token_sort, scaled, strict, weighted, lenient) of the distinct pairs (a, b) of `pairs`, both in normal form."""
    short = "least(length(a), length(b))::DOUBLE / greatest(length(a), length(b), 1)"
    return f"""
    base AS (SELECT DISTINCT a, b, {_sorted('a')} AS sa, {_sorted('b')} AS sb, list_distinct(string_split(a, ' ')) AS ta, list_distinct(string_split(b, ' ')) AS tb FROM {pairs}),
    sets AS (SELECT *, array_to_string(list_sort(list_filter(ta, lambda x: list_contains(tb, x))), ' ') AS both_, array_to_string(list_sort(list_filter(ta, lambda x: NOT list_contains(tb, x))), ' ') AS l,
        array_to_string(list_sort(list_filter(tb, lambda x: NOT list_contains(ta, x))), ' ') AS r FROM base),
    parts AS (SELECT *, {_ratio('a', 'b')} AS whole, {_ratio('sa', 'sb')} AS token_sort, {_partial('a', 'b')} AS part, {_partial('sa', 'sb')} AS part_sorted, {_partial('l', 'r')} AS part_rest,
        (length(l) + length(r) - 2 * {_lcs('l', 'r')})::DOUBLE AS moved, length(both_) + CASE WHEN both_ = '' THEN 0 ELSE 1 END + length(l) AS nl, length(both_) + CASE WHEN both_ = '' THEN 0 ELSE 1 END + length(r) AS nr FROM sets),
    token AS (SELECT *, CASE WHEN both_ <> '' AND (l = '' OR r = '') THEN 100.0 WHEN both_ = '' THEN 100 - 100 * moved / (nl + nr)
        ELSE greatest(100 - 100 * moved / (nl + nr), 100 - 100.0 * (nl - length(both_)) / (length(both_) + nl), 100 - 100.0 * (nr - length(both_)) / (length(both_) + nr)) END AS token_set,
        greatest(length(a), length(b))::DOUBLE / greatest(least(length(a), length(b)), 1) AS apart FROM parts),
    weighed AS (SELECT *, CASE WHEN a = '' OR b = '' THEN 0 WHEN apart < 1.5 THEN greatest(whole, 0.95 * token_sort, 0.95 * token_set)
        ELSE greatest(whole, CASE WHEN apart < 8 THEN 0.9 ELSE 0.6 END * part, 0.95 * CASE WHEN apart < 8 THEN 0.9 ELSE 0.6 END * CASE WHEN both_ <> '' THEN 100 ELSE greatest(part_sorted, part_rest) END) END AS weighted FROM token),
    scored AS (SELECT a, b, token_sort, part * {short} AS scaled, greatest(token_sort, part * {short}) AS strict, weighted, greatest(weighted, token_sort, part * {short}) AS lenient FROM weighed)"""


_MASTER = "master AS (SELECT min(p_partkey) AS row_no, upper(trim(p_type)) AS district, upper(trim(p_name)) AS station FROM part GROUP BY 2, 3)"
_REQUESTS = """requests AS (SELECT DISTINCT (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS request_id, 'H NO ' || l_orderkey || '-' || l_linenumber || ', '
    || CASE WHEN l_linenumber % 2 = 0 THEN left(p_name, length(p_name) - 1) ELSE p_name END || ', '
    || CASE WHEN l_orderkey % 3 = 0 THEN 'main road' ELSE p_type END || ', PIN 500' || l_linenumber AS address FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_PLACES = f"""lists AS (SELECT request_id, list_transform(regexp_split_to_array(upper(address), '[,\\n;|/]+'), lambda s: list_filter(regexp_split_to_array(s, '[^A-Z]+'), lambda w: w <> '' AND w NOT IN ({_STOP}))) AS segments FROM requests),
    flat AS (SELECT request_id, flatten(list_transform(segments, lambda w: list_prepend(array_to_string(w, ' '), w))) AS c FROM lists),
    each_ AS (SELECT request_id, unnest(c) AS token, generate_subscripts(c, 1) AS i FROM flat),
    firsts AS (SELECT request_id, token, min(i) AS i FROM each_ WHERE length(replace(token, ' ', '')) >= 4 GROUP BY 1, 2),
    places AS (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY i) - 1 AS place, token FROM firsts)"""


def _scan(keys: str) -> str:
    """`keys` is 'station, district' or 'district'; CTE `best` holds (request_id, keys, score, locality) to be ranked."""
    return f"""top AS (SELECT *, max(score) OVER (PARTITION BY request_id) AS top FROM best),
    tied AS (SELECT *, count(*) FILTER (score = top) OVER (PARTITION BY request_id) AS ties FROM top)
    SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, len(string_split(locality, ' ')) DESC, length(locality) DESC, {keys})::INT AS rank, {keys}, score, locality FROM tied WHERE ties <= 5"""


def _hits(names: str, column: str) -> str:
    """CTEs up to `hit` (request_id, place, token, name, score)."""
    return f"""names AS (SELECT DISTINCT {column} AS name, {_norm(column)} AS nn FROM {names}),
    tokens AS (SELECT DISTINCT token, {_norm('token')} AS nt FROM places),
    near AS (SELECT token, name, nt AS a, nn AS b FROM tokens, names WHERE least(length(nt), length(nn)) >= 0.754 * greatest(length(nt), length(nn))),
    {_scored('near')},
    good AS (SELECT token, name, strict AS score FROM near JOIN scored USING (a, b) WHERE strict >= 86),
    hit AS (SELECT request_id, place, token, name, score FROM places JOIN good USING (token))"""


_BEST = "round_even(max(score), 1) AS score, arg_max(token, {'s': score, 'p': -place}) AS locality"
_STATIONS = f"""WITH {_MASTER}, {_REQUESTS}, {_PLACES}, both_names AS (SELECT station AS name FROM master UNION SELECT district FROM master), {_hits('both_names', 'name')},
    found AS (SELECT request_id, station, district, {_BEST} FROM hit JOIN master ON name = station GROUP BY 1, 2, 3),
    named AS (SELECT DISTINCT request_id, name AS district, true AS named FROM hit WHERE name IN (SELECT district FROM master)),
    twice AS (SELECT f.*, named, count(*) OVER w AS n, count(named) OVER w AS n_named FROM found f LEFT JOIN named USING (request_id, district) WINDOW w AS (PARTITION BY request_id, station)),
    best AS (SELECT request_id, station, district, score, locality FROM twice WHERE n = 1 OR n_named <> 1 OR named), {_scan('station, district')}"""
_DISTRICTS = f"""WITH {_MASTER}, {_REQUESTS}, {_PLACES}, {_hits('master', 'district')},
    best AS (SELECT request_id, name AS district, {_BEST} FROM hit GROUP BY 1, 2), {_scan('district')}"""

_PAIRS = """names AS (SELECT DISTINCT upper(trim(p_name)) AS a FROM part),
    pairs AS (SELECT x.a AS a, y.a AS b FROM names x JOIN names y ON x.a[1] = y.a[1] UNION ALL SELECT a, a[2:] FROM names UNION ALL SELECT a, string_split(a, ' ')[2] || ' ' || string_split(a, ' ')[1] FROM names)"""

_TYPED = """typed AS (SELECT p_partkey AS request_id, CASE p_partkey % 3 WHEN 0 THEN 'PS ' || p_name WHEN 1 THEN string_split(p_name, ' ')[2] || ' ' || string_split(p_name, ' ')[1] ELSE left(p_name, length(p_name) - 1) END AS typed,
    CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) ELSE '' END AS kind FROM part)"""
_NAME_HITS = f"""{_MASTER}, {_TYPED}, words AS (SELECT DISTINCT typed, {_norm('typed')} AS a FROM typed), names AS (SELECT DISTINCT station, {_norm('station')} AS b FROM master),
    pairs AS (SELECT * FROM words, names), {_scored('pairs')},
    good AS (SELECT typed, station, lenient FROM pairs JOIN scored USING (a, b) WHERE lenient >= 80),
    hits AS (SELECT request_id, kind, station, district, round_even(lenient, 1) AS score, row_number() OVER (PARTITION BY request_id ORDER BY lenient DESC, district, row_no)::INT AS place
        FROM typed JOIN good USING (typed) JOIN master USING (station))"""


def _vincenty(rows: str, keep: str) -> str:
    """CTEs that end in `measured` (keep, km): distances of (lat, lng) and (lat2, lng2) of `rows`; seven rounds settle within a region."""
    f = "(1 / 298.257223563)"
    out = [
        f"v0 AS (SELECT *, atan((1 - {f}) * tan(radians(lat))) AS u1, atan((1 - {f}) * tan(radians(lat2))) AS u2, radians(lng2 - lng) AS turn, radians(lng2 - lng) AS lam FROM {rows})"
    ]
    for i in range(8):
        sin = "sqrt(power(cos(u2) * sin(lam), 2) + power(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2))"
        out.append(f"a{i} AS (SELECT *, {sin} AS s, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS c FROM v{i})")
        out.append(f"b{i} AS (SELECT *, atan2(s, c) AS sigma, CASE WHEN s = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(lam) / s END AS alpha FROM a{i})")
        out.append(f"c{i} AS (SELECT *, 1 - alpha * alpha AS sq, CASE WHEN 1 - alpha * alpha = 0 THEN 0 ELSE c - 2 * sin(u1) * sin(u2) / (1 - alpha * alpha) END AS m FROM b{i})")
        k = f"({f} / 16 * sq * (4 + {f} * (4 - 3 * sq)))"
        nxt = f"turn + (1 - {k}) * {f} * alpha * (sigma + {k} * s * (m + {k} * c * (2 * m * m - 1)))"
        out.append(f"v{i + 1} AS (SELECT * EXCLUDE (lam, s, c, sigma, alpha, sq, m), {nxt} AS lam FROM c{i})")
    semi = f"(6378.137 * (1 - {f}))"
    out.append(f"w0 AS (SELECT *, sq * (6378.137 * 6378.137 - {semi} * {semi}) / ({semi} * {semi}) AS u FROM c7)")
    out.append("w1 AS (SELECT *, 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) AS big, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) AS small FROM w0)")
    less = "small * s * (m + small / 4 * (c * (2 * m * m - 1) - small / 6 * m * (4 * s * s - 3) * (4 * m * m - 3)))"
    out.append(f"measured AS (SELECT {keep}, CASE WHEN lat = lat2 AND lng = lng2 THEN 0 ELSE {semi} * big * (sigma - {less}) END AS km FROM w1)")
    return ", ".join(out)


def _point(key: str, base: str, step: int) -> str:
    return f"({base} + ({key} * {step} % 4001) / 1000.0::DOUBLE)"


_SUPPLIERS = f"""master AS (SELECT s_suppkey AS row_no, upper(n_name) AS district, upper(s_name) AS station FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    coordinates AS (SELECT upper(n_name) AS district, upper(s_name) AS station, {_point('s_suppkey', '15', 37)} AS lat, {_point('s_suppkey', '77', 101)} AS lng FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal >= 0)"""
_RANKED = f"""{_SUPPLIERS}, asked AS (SELECT c_custkey AS request_id, upper(n_name) AS district, {_point('c_custkey', '15', 53)} AS lat, {_point('c_custkey', '77', 71)} AS lng FROM customer JOIN nation ON c_nationkey = n_nationkey),
    rows_ AS (SELECT request_id, asked.district, station, row_no, asked.lat, asked.lng, coordinates.lat AS lat2, coordinates.lng AS lng2 FROM asked JOIN master USING (district) JOIN coordinates USING (district, station)),
    {_vincenty('rows_', 'request_id, district, station, row_no')}, ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY km, row_no)::INT AS rank FROM measured)"""

_SURETY = "CASE o_orderkey % 5 WHEN 0 THEN 'VERY HIGH' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' ELSE 'ODD' END"


def _label(x: str, otherwise: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SURETY.items()) + f" ELSE {otherwise} END"


_LOOKUP = "CASE o_orderkey % 4 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in LOOKUPS.items()) + " END"
_RANK = "CASE WHEN o_orderkey % 4 = 1 THEN 1 WHEN o_orderkey % 3 = 0 THEN 2 END"

_FILE = """raw AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 13 = 0 THEN 'n/a' ELSE p_partkey::VARCHAR END AS a, CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE p_type END AS b,
        CASE WHEN p_partkey % 11 = 0 THEN '  ' WHEN p_partkey % 17 = 0 THEN p_name || ',x' ELSE lower(p_name) END AS c FROM part),
    file AS (SELECT CASE WHEN k % 13 > 0 THEN k END AS n, upper(trim(b)) AS district, upper(trim(split_part(c, ',', 1))) AS station, CASE WHEN c LIKE '%,x' THEN a || ',' || b || ',' || c END AS line,
        CASE WHEN c LIKE '%,x' THEN 'malformed line' WHEN k % 13 = 0 THEN 'no row number' WHEN trim(b) = '' THEN 'no district' WHEN trim(c) = '' THEN 'no station' END AS reason FROM raw)"""

ORACLE_SQL = {
    "standardize_master": "SELECT p_partkey AS row_no, upper(trim(p_type)) AS district, upper(trim(p_name)) AS station FROM part",
    "normal_names": f"SELECT p_partkey, {_norm('t')} AS name FROM (SELECT p_partkey, '  ' || ['PS ', 'p.s. ', 'Thana' || chr(9), 'Police  Station '][p_partkey % 4 + 1] || replace(p_name, ' ', ' - ') || ' chowki ' AS t FROM part)",
    "address_localities": f"WITH {_REQUESTS}, {_PLACES} SELECT request_id, place::INT AS place, token FROM places",
    "strict_scores": f"WITH {_PAIRS}, {_scored('pairs')} SELECT a, b, round_even(token_sort, 6) AS token_sort, round_even(scaled, 6) AS scaled_partial, round_even(strict, 6) AS strict FROM pairs JOIN scored USING (a, b)",
    "lenient_scores": f"WITH {_PAIRS}, {_scored('pairs')} SELECT a, b, round_even(weighted, 6) AS weighted, round_even(lenient, 6) AS lenient FROM pairs JOIN scored USING (a, b)",
    "name_lookup": f"WITH {_NAME_HITS} SELECT request_id, station, district, score, place FROM hits",
    "name_resolution": f"""WITH {_NAME_HITS}, top AS (SELECT *, first_value(station) OVER (PARTITION BY request_id ORDER BY place) AS best FROM hits),
        same AS (SELECT *, {_norm('kind')} <> '' AND {_norm('kind')} = {_norm('district')} AS same FROM top WHERE station = best),
        counted AS (SELECT *, count(*) OVER (PARTITION BY request_id) AS n, count(*) FILTER (same) OVER (PARTITION BY request_id) AS k FROM same),
        judged AS (SELECT *, CASE WHEN n = 1 THEN 'unique' WHEN k = 1 THEN 'resolved_by_district' ELSE 'ambiguous' END AS status FROM counted)
        SELECT request_id, status, row_number() OVER (PARTITION BY request_id ORDER BY place)::INT AS rank, station, district, score FROM judged WHERE status <> 'resolved_by_district' OR same""",
    "district_lookup": f"""WITH {_MASTER}, districts AS (SELECT district, min(row_no) AS row_no, {_norm('district')} AS b FROM master GROUP BY 1, 3),
        typed AS (SELECT p_partkey AS request_id, upper(CASE WHEN p_partkey % 4 = 0 THEN left(p_type, length(p_type) - 1) ELSE p_type END) AS typed FROM part),
        exact AS (SELECT request_id, district, 100.0::DOUBLE AS score, 1 AS place FROM typed JOIN districts ON typed = district),
        words AS (SELECT DISTINCT typed, {_norm('typed')} AS a FROM typed WHERE typed NOT IN (SELECT district FROM districts)), pairs AS (SELECT * FROM words, districts), {_scored('pairs')}
        SELECT * FROM exact UNION ALL SELECT request_id, district, round_even(lenient, 1), row_number() OVER (PARTITION BY request_id ORDER BY round_even(lenient, 1) DESC, row_no)::INT FROM typed JOIN pairs USING (typed) JOIN scored USING (a, b) WHERE lenient >= 80""",
    "scan_stations": _STATIONS,
    "scan_districts": _DISTRICTS,
    "geodesic_pairs": f"WITH rows_ AS (SELECT c_custkey, {_point('c_custkey', '15', 53)} AS lat, {_point('c_custkey', '77', 71)} AS lng, {_point('c_nationkey', '16', 17)} AS lat2, {_point('c_nationkey', '78', 29)} AS lng2 FROM customer), {_vincenty('rows_', 'c_custkey')} SELECT c_custkey, round_even(km, 3) AS km FROM measured",
    "nearest_stations": f"WITH {_RANKED} SELECT request_id, district, rank, station, printf('~%.1f km', round_even(km, 1)) AS distance, round_even(km, 3) AS distance_km FROM ranked WHERE rank <= 3",
    "far_districts": f"WITH {_RANKED} SELECT request_id, district, round_even(km, 1) AS nearest_km FROM ranked WHERE rank = 1 AND km > 30",
    "coordinates_missing": f"WITH {_SUPPLIERS} SELECT district, station, station || ' Police Station, ' || district || ', Telangana, India' AS query FROM (SELECT DISTINCT district, station FROM master) m ANTI JOIN coordinates USING (district, station)",
    "coordinates_upserted": f"WITH {_SUPPLIERS} SELECT district, station, CASE WHEN c.lat IS NULL THEN 1.0 WHEN row_no % 3 = 0 THEN c.lat + 1 ELSE c.lat END AS lat, coalesce(c.lng, 2.0) AS lng FROM master LEFT JOIN coordinates c USING (district, station) WHERE c.lat IS NOT NULL OR row_no % 2 = 0",
    "inference_replies": "SELECT p_partkey, 0 AS place, upper(trim(p_type)) AS district FROM part UNION ALL SELECT p_partkey, 1, upper(p_brand) FROM part WHERE upper(p_brand) <> upper(p_type)",
    "log_entries": f"""SELECT o_orderkey AS request_id, trim(o_orderstatus) AS address, CASE {_RANK} WHEN 1 THEN 'A' || o_orderkey WHEN 2 THEN 'B' || o_orderkey ELSE '' END AS station,
        CASE WHEN {_RANK} IS NULL THEN '' ELSE o_orderpriority END AS district, {_LOOKUP} AS lookup, CASE WHEN {_RANK} IS NULL THEN '' ELSE {_label(_SURETY, "'Unknown'")} END AS surety FROM orders WHERE o_orderkey % 4 > 0""",
    "shown_answers": f"""SELECT o_orderkey AS request_id, (o_orderkey % 4)::INT AS "case", r::INT AS rank, (CASE r WHEN 1 THEN 'A' ELSE 'B' END) || o_orderkey AS station, o_orderpriority AS district, {_label(_SURETY, _SURETY)} AS surety, 'N/A' AS distance
        FROM orders, (VALUES (1), (2)) v(r) WHERE (o_orderkey % 4 > 0 AND r = 1) OR (o_orderkey % 4 > 1 AND r = 2)""",
    "accuracy_counts": """SELECT count(*) AS n, count(*) FILTER (CASE WHEN k % 4 = 0 THEN k % 8 = 0 ELSE k % 3 <> 0 END) AS rank1,
        count(*) FILTER (CASE WHEN k % 4 = 0 THEN false WHEN k % 3 <> 0 THEN true ELSE k % 4 > 1 END) AS any_rank, count(*) FILTER (k % 4 = 0) AS empty FROM (SELECT o_orderkey AS k FROM orders)""",
}

_KIND = "CASE WHEN best = 100 THEN 'same' ELSE 'similar' END || ' station name, score ' || best"
ORACLE_SQL["ladder"] = f"""WITH named AS ({ORACLE_SQL['name_resolution']}), scanned AS ({_STATIONS}), {_MASTER}, {_REQUESTS}, {_TYPED},
    r1 AS (SELECT request_id, min(status) AS status, arg_min(score, rank) AS best, arg_min(station, rank) AS station, arg_min(district, rank) AS district, count(*) AS n, string_agg(district, ', ' ORDER BY rank) AS ds FROM named GROUP BY 1),
    a1 AS (SELECT -request_id AS request_id, 1 AS "case", '1' AS rung, CASE WHEN status = 'ambiguous' THEN 'MEDIUM' WHEN best = 100 THEN 'VERY HIGH' ELSE 'HIGH' END AS confidence,
        {_KIND} || CASE status WHEN 'unique' THEN '' WHEN 'ambiguous' THEN '; ' || n || ' districts have it' ELSE '; told apart by district' END AS method,
        CASE status WHEN 'ambiguous' THEN station || ' is in ' || n || ' districts, choose one: ' || ds
            WHEN 'resolved_by_district' THEN 'several districts have this station, ' || district || ' was stated' END AS note, n AS n_results, station, district FROM r1),
    firsts3 AS (SELECT district, min(station) FILTER (k = 1) AS station, count(*) FILTER (k <= 3) AS n FROM (SELECT *, row_number() OVER (PARTITION BY district ORDER BY row_no) AS k FROM master) GROUP BY 1),
    a2 AS (SELECT -request_id, 2, '2', 'HIGH', 'district ' || district || ', score 100.0; no address, in order of rows', NULL, n, station, district
        FROM typed JOIN firsts3 ON upper(kind) = district WHERE request_id NOT IN (SELECT request_id FROM r1)),
    sizes AS (SELECT request_id, count(*) AS n FROM scanned GROUP BY 1),
    a3 AS (SELECT request_id, 3, '3a', CASE WHEN score >= 95 THEN 'HIGH' ELSE 'MEDIUM' END, 'the address names a station: ' || locality || ', score ' || score, NULL, least(n, 3), station, district
        FROM scanned JOIN sizes USING (request_id) WHERE rank = 1),
    answered AS (SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3)
    SELECT * REPLACE (n_results::INT AS n_results) FROM answered UNION ALL SELECT request_id, 0, '0', 'NONE', 'no answer', NULL, 0, NULL, NULL
        FROM (SELECT request_id FROM requests UNION ALL SELECT -request_id FROM typed) WHERE request_id NOT IN (SELECT request_id FROM answered)"""


# --- Requests of customers: rungs with coordinates, geocodes, inferences and estimates ---

_RESIDENTS = f"""{_MASTER}, coords AS (SELECT district, station, CASE WHEN row_no % 5 <> 0 THEN {_point('row_no', '15', 37)} WHEN row_no % 10 = 0 THEN 16.5 END AS lat,
        CASE WHEN row_no % 5 <> 0 THEN {_point('row_no', '77', 101)} WHEN row_no % 10 = 0 THEN 78.0::DOUBLE + row_no / 10000.0::DOUBLE END AS lng FROM master),
    residents AS (SELECT c_custkey AS request_id, CASE WHEN k = 10 THEN ' ' ELSE '9-' || c_custkey || CASE WHEN k IN (0, 3, 6) THEN ', ' || p_name WHEN k IN (1, 7) THEN ', ' || p_type ELSE '' END || ', pin 5000' END AS address,
        CASE WHEN c_custkey % 8 = 0 THEN left(upper(p_type), -1) WHEN c_custkey % 2 = 0 THEN upper(p_type) END AS typed, k, upper(p_type) AS kind
        FROM (SELECT c_custkey, c_custkey % 12 AS k, p_name, p_type FROM customer JOIN part ON c_custkey = p_partkey)),
    requests AS (SELECT request_id, address FROM residents)"""
_SNAP = f"""districts AS (SELECT district, min(row_no) AS row_no FROM master GROUP BY 1), typed_names AS (SELECT typed FROM residents WHERE typed IS NOT NULL UNION SELECT left(kind, -1) FROM residents UNION SELECT kind FROM residents),
    snapped AS (WITH words AS (SELECT typed, district, row_no, {_norm('typed')} AS a, {_norm('district')} AS b FROM typed_names, districts WHERE typed NOT IN (SELECT district FROM districts)), {_scored('words')},
        liked AS (SELECT typed, district, row_no, round_even(lenient, 1) AS score FROM words JOIN scored USING (a, b) WHERE lenient >= 80)
        SELECT typed, district, 100.0::DOUBLE AS score FROM typed_names JOIN districts ON typed = district
        UNION ALL SELECT typed, district, score FROM liked QUALIFY row_number() OVER (PARTITION BY typed ORDER BY score DESC, row_no) = 1)"""
_NAMED = f"""evidence AS MATERIALIZED (WITH {_PLACES}, both_names AS (SELECT station AS name FROM master UNION SELECT district FROM master), {_hits('both_names', 'name')} SELECT * FROM hit),
    named AS (SELECT DISTINCT request_id, name AS district, true AS named FROM evidence WHERE name IN (SELECT district FROM master)),
    stated AS (SELECT request_id, address, length(trim(address)) > 0 AS addressed, district, score AS d_score FROM residents JOIN snapped USING (typed))"""


def _named_stations(asked: str) -> str:
    """Ranked stations that addresses of `asked` (request_id, wanted) name, in the district `wanted` where that is not null."""
    return f"""WITH found AS (SELECT request_id, station, district, {_BEST} FROM evidence JOIN master ON name = station JOIN {asked} USING (request_id) WHERE coalesce(wanted, district) = district GROUP BY 1, 2, 3),
        twice AS (SELECT f.*, named, count(*) OVER w AS n, count(named) OVER w AS n_named FROM found f LEFT JOIN named USING (request_id, district) WINDOW w AS (PARTITION BY request_id, station)),
        best AS (SELECT request_id, station, district, score, locality FROM twice WHERE n = 1 OR n_named <> 1 OR named), {_scan('station, district')}"""


_BEFORE_3B = f"""{_RESIDENTS}, {_SNAP}, {_NAMED}, stated_in AS (SELECT request_id, district AS wanted FROM stated), unstated AS (SELECT request_id, NULL AS wanted FROM residents WHERE request_id NOT IN (SELECT request_id FROM stated)),
    r3a AS ({_named_stations('unstated')}),
    r3b AS (WITH best AS (SELECT request_id, name AS district, {_BEST} FROM evidence JOIN unstated USING (request_id) WHERE name IN (SELECT district FROM districts) AND request_id NOT IN (SELECT request_id FROM r3a) GROUP BY 1, 2),
        ranked AS ({_scan('district').replace('top AS (', 'WITH top AS (', 1)}) SELECT * FROM ranked WHERE rank = 1),
    inferred AS (WITH said AS (SELECT request_id, unnest([left(kind, -1), 'ECONOMY', kind]) AS typed, unnest([0, 2, 3]) AS i FROM residents WHERE k IN (5, 9, 11)),
        firsts AS (SELECT request_id, district, min(i) AS i FROM said JOIN snapped USING (typed) GROUP BY 1, 2)
        SELECT request_id, district, row_number() OVER (PARTITION BY request_id ORDER BY i)::INT AS turn FROM firsts QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY i) <= 2)"""
_R3A = """SELECT request_id, 3 AS "case", '3a' AS rung, CASE WHEN max(CASE WHEN rank = 1 THEN score END) OVER w >= 95 THEN 'HIGH' ELSE 'MEDIUM' END AS overall,
        'the address names a station: ' || max(CASE WHEN rank = 1 THEN locality END) OVER w || ', score ' || max(CASE WHEN rank = 1 THEN score END) OVER w AS method, NULL::VARCHAR AS note, NULL::VARCHAR AS warning,
        rank, station, district, CASE WHEN score >= 95 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, score AS match_score, 'N/A' AS distance, NULL::DOUBLE AS distance_km
        FROM r3a WINDOW w AS (PARTITION BY request_id) QUALIFY rank <= 3"""
_R0 = """SELECT request_id, 0, '0', 'NONE', 'no answer', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM residents WHERE request_id NOT IN (SELECT request_id FROM answered)"""
_BARE = "bare AS (SELECT district, count(*) AS n, string_agg(station, ', ' ORDER BY row_no) AS names FROM master JOIN coords USING (district, station) WHERE lat IS NULL GROUP BY 1)"

ORACLE_SQL["ladder_measured"] = f"""WITH {_BEFORE_3B}, {_BARE}, pins AS (SELECT request_id, station AS pin, score AS pin_score FROM ({_named_stations('stated_in')}) WHERE rank = 1),
    asks AS (SELECT request_id, district FROM stated WHERE addressed UNION SELECT request_id, district FROM r3b UNION SELECT request_id, district FROM inferred),
    origins AS (SELECT request_id, {_point('request_id', '15', 53)} AS lat, {_point('request_id', '77', 71)} AS lng FROM residents WHERE k <= 5 OR k = 9),
    ways AS (SELECT request_id, district, station, row_no, o.lat, o.lng, c.lat AS lat2, c.lng AS lng2 FROM asks JOIN origins o USING (request_id) JOIN master USING (district) JOIN coords c USING (district, station) WHERE c.lat IS NOT NULL),
    km AS MATERIALIZED (WITH {_vincenty('ways', 'request_id, district, station, row_no')} SELECT *, row_number() OVER (PARTITION BY request_id, district ORDER BY km, row_no)::INT AS near FROM measured),
    s2 AS (SELECT s.*, pin, pin_score, m.station, m.row_no, km, count(km) OVER (PARTITION BY s.request_id) > 0 AS measured, coalesce(m.station = pin, false) AS pinned, min(km) OVER (PARTITION BY s.request_id) AS nearest
        FROM stated s LEFT JOIN pins USING (request_id) JOIN master m USING (district) LEFT JOIN km USING (request_id, district, station)),
    k2 AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY pinned DESC, CASE WHEN measured THEN coalesce(km, 1e99) ELSE 0 END, row_no)::INT AS rank FROM s2 WHERE NOT measured OR km IS NOT NULL OR pinned),
    a2 AS (SELECT request_id, 2, '2', CASE WHEN addressed AND NOT measured THEN 'LOW' ELSE 'HIGH' END,
        'district ' || district || ', score ' || d_score || '; ' || CASE WHEN NOT addressed THEN 'no address, in order of rows' WHEN measured THEN 'nearest first' ELSE 'no distances, in order of rows' END
            || CASE WHEN pin IS NULL THEN '' ELSE '; ' || pin || ' first, as the address names it' END,
        CASE WHEN addressed THEN 'no coordinates for ' || n || ' of ' || district || ': ' || names END, CASE WHEN nearest > 30 THEN 'the nearest station of ' || district || ' is ' || round_even(nearest, 1) || ' km away; is it the right district?' END,
        rank, station, district, CASE WHEN pinned AND pin_score >= 95 THEN 'HIGH' WHEN pinned THEN 'MEDIUM' WHEN addressed AND NOT measured THEN 'LOW' WHEN rank = 1 THEN 'HIGH' ELSE 'MEDIUM' END,
        CASE WHEN pinned THEN pin_score END, CASE WHEN km IS NULL THEN 'N/A' ELSE printf('~%.1f km', round_even(km, 1)) END, round_even(km, 3) FROM k2 LEFT JOIN bare USING (district) WHERE rank <= 3),
    a3b AS (SELECT request_id, 3, '3b', 'MEDIUM', 'the address names district ' || district || ': ' || locality || ', score ' || score || '; nearest first', 'no coordinates for ' || n || ' of ' || district || ': ' || names, NULL,
        near, station, district, CASE WHEN near = 1 THEN 'HIGH' ELSE 'MEDIUM' END, NULL, printf('~%.1f km', round_even(km, 1)), round_even(km, 3) FROM r3b JOIN km USING (request_id, district) LEFT JOIN bare USING (district) WHERE near <= 3),
    left3c AS (SELECT * FROM inferred WHERE request_id NOT IN (SELECT request_id FROM stated UNION SELECT request_id FROM r3a UNION SELECT request_id FROM a3b)),
    lists AS (SELECT request_id, 'no coordinates for ' || sum(n) || ' of inferred districts: ' || string_agg(names, ', ' ORDER BY turn) AS note FROM left3c JOIN bare USING (district) GROUP BY 1),
    a3c AS (SELECT request_id, 3, '3c', 'MEDIUM', 'inferred districts; nearest first', note, NULL, row_number() OVER (PARTITION BY request_id ORDER BY turn, near)::INT AS place, station, district, CASE WHEN near = 1 THEN 'MEDIUM' ELSE 'LOW' END,
        NULL, printf('~%.1f km', round_even(km, 1)), round_even(km, 3) FROM left3c JOIN km USING (request_id, district) LEFT JOIN lists USING (request_id) WHERE near <= 2 QUALIFY place <= 3),
    answered AS ({_R3A} UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3b UNION ALL SELECT * FROM a3c)
    SELECT * FROM answered UNION ALL {_R0}"""

_EST = """numbered AS (SELECT district, station, row_no, row_number() OVER (PARTITION BY district ORDER BY row_no)::INT AS i, count(*) OVER (PARTITION BY district) AS n FROM master)"""


def _estimated(asks: str) -> str:
    """Ranked stations of `asks` (request_id, district): the fourth and the second where there is a reply, else the first three."""
    said = "(k < 9 AND district IN (kind, 'ECONOMY') AND n > 3)"
    return f"""SELECT request_id, district, CASE WHEN NOT {said} THEN i WHEN i = 4 THEN 1 ELSE 2 END::INT AS rank, station, CASE WHEN {said} AND i = 4 THEN '~4 km' ELSE 'N/A' END AS distance
        FROM {asks} JOIN residents USING (request_id) JOIN numbered USING (district) WHERE CASE WHEN {said} THEN i IN (2, 4) ELSE i <= 3 END"""


ORACLE_SQL["ladder_estimated"] = f"""WITH {_BEFORE_3B}, {_EST}, addressed AS (SELECT request_id, district FROM stated WHERE addressed), e2 AS ({_estimated('addressed')} UNION ALL
        SELECT request_id, district, i, station, 'N/A' FROM stated JOIN numbered USING (district) WHERE NOT addressed AND i <= 3),
    a2 AS (SELECT request_id, 2, '2', 'HIGH', 'district ' || e2.district || ', score ' || d_score || '; ' || CASE WHEN addressed THEN 'nearest first, as estimated' ELSE 'no address, in order of rows' END, NULL, NULL,
        rank, station, e2.district, CASE WHEN rank = 1 THEN 'HIGH' ELSE 'MEDIUM' END, NULL, distance, NULL FROM e2 JOIN stated USING (request_id)),
    e3b AS ({_estimated('r3b')}), a3b AS (SELECT request_id, 3, '3b', 'MEDIUM', 'the address names district ' || e.district || ': ' || locality || ', score ' || score || '; nearest first, as estimated', NULL, NULL,
        e.rank, station, e.district, CASE WHEN e.rank = 1 THEN 'HIGH' ELSE 'MEDIUM' END, NULL, distance, NULL FROM e3b e JOIN r3b USING (request_id)),
    left3c AS (SELECT * FROM inferred WHERE request_id NOT IN (SELECT request_id FROM stated UNION SELECT request_id FROM r3a UNION SELECT request_id FROM a3b)), e3c AS ({_estimated('left3c')}),
    a3c AS (SELECT request_id, 3, '3c', 'MEDIUM', 'inferred districts; nearest first, as estimated', NULL, NULL, row_number() OVER (PARTITION BY request_id ORDER BY turn, rank)::INT AS place, station, district,
        CASE WHEN rank = 1 THEN 'MEDIUM' ELSE 'LOW' END, NULL, distance, NULL FROM e3c JOIN left3c USING (request_id, district) WHERE rank <= 2 QUALIFY place <= 3),
    answered AS ({_R3A} UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3b UNION ALL SELECT * FROM a3c)
    SELECT * FROM answered UNION ALL {_R0}"""

_MISSING = "SELECT district, station, station || ' Police Station, ' || district || ', Telangana, India' AS query FROM master WHERE row_no % 5 = 0"
ORACLE_SQL |= {
    "inferred_names": f"WITH {_BEFORE_3B} SELECT request_id, district, turn FROM inferred",
    "estimate_replies": "SELECT p_partkey, 0 AS place, upper(p_name) AS name, p_size::DOUBLE AS km FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT p_partkey, 1, 'B', NULL FROM part WHERE p_partkey % 7 <> 0",
    "estimated_stations": f"WITH {_RESIDENTS}, {_EST}, asks AS (SELECT request_id, kind AS district FROM residents WHERE k <> 10) {_estimated('asks')}",
    "coordinates_standard": """SELECT district, station, x.lat AS lat, x.lng AS lng FROM (SELECT upper(p_type) AS district, upper(p_name) AS station, arg_max(CASE WHEN l_orderkey % 5 = 0 OR l_orderkey % 7 = 0 THEN {'lat': NULL::DOUBLE, 'lng': NULL::DOUBLE}
        ELSE {'lat': (l_orderkey % 90)::DOUBLE, 'lng': (l_linenumber + 77)::DOUBLE} END, l_orderkey * 100000000 + l_linenumber * 10000000 + p_partkey) AS x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)""",
    "coordinates_filled": f"WITH {_RESIDENTS} SELECT district, station, lat, lng FROM coords",
    "coordinates_failed": f"WITH {_MASTER}, missing AS ({_MISSING}) SELECT *, CASE WHEN length(query) % 3 = 0 THEN 'OSError: out of reach' ELSE 'no answer' END AS reason FROM missing WHERE length(query) % 2 = 0 OR length(query) % 3 = 0",
    "coordinates_updated": f"""WITH {_RESIDENTS}, known AS (SELECT district, station, lat, lng FROM coords JOIN master USING (district, station) WHERE row_no % 5 <> 0),
        news AS (SELECT upper(p_type) AS district, upper(p_name) AS station, max(p_partkey)::DOUBLE AS lat, 1.0::DOUBLE AS lng FROM part WHERE p_partkey % 6 = 0 GROUP BY 1, 2)
        SELECT * FROM news UNION ALL SELECT k.* FROM known k ANTI JOIN news USING (district, station)""",
    "stations_excluded": f"WITH {_MASTER} SELECT district, count(*) AS n_excluded, string_agg(station, ', ' ORDER BY row_no) AS excluded FROM master WHERE row_no % 5 = 0 GROUP BY 1",
    "name_lookup_within": f"""WITH {_NAME_HITS} SELECT request_id, station, district, score, row_number() OVER (PARTITION BY request_id ORDER BY place)::INT AS place FROM hits WHERE kind = '' OR {_norm('kind')} = {_norm('district')}""",
    "log_appended": f"""SELECT NULL::VARCHAR AS file_no, trim(o_orderstatus) AS address, 'A' || o_orderkey AS predicted_ps, o_orderpriority AS predicted_district, NULL::VARCHAR AS actual_ps_known, NULL::VARCHAR AS status,
        {_LOOKUP} AS result_lookup, {_label(_SURETY, "'Unknown'")} AS result_match, NULL::VARCHAR AS "match" FROM orders WHERE o_orderkey % 4 > 0""",
    "master_scanned": f"WITH {_FILE} SELECT min(n) AS row_no, district, station FROM file WHERE reason IS NULL GROUP BY 2, 3",
    "master_rejected": f"""WITH {_FILE}, first AS (SELECT district, station, min(n) AS n FROM file WHERE reason IS NULL GROUP BY 1, 2)
        SELECT n AS row_no, district, station, reason, line FROM file WHERE reason IS NOT NULL UNION ALL
        SELECT file.n, district, station, 'repeats row ' || first.n, NULL FROM file JOIN first USING (district, station) WHERE reason IS NULL AND file.n > first.n""",
}
ORACLE_SQL["ladder_streamed"] = f"""WITH once AS ({ORACLE_SQL['ladder_measured']})
    SELECT * FROM once UNION ALL SELECT * REPLACE (request_id + 1000000000 AS request_id) FROM once"""
