"""SQL statements of the pipeline stages, written independently of the Spark code, for cross-checking."""

from __future__ import annotations

from accesslens import schemas
from accesslens.sources import dims, fixtures


def R(expr: str, dp: int) -> str:
    """Half-up rounding by one scaling and one division."""
    return f"(floor(({expr}) * 1e{dp} + 0.5e0) / 1e{dp})"


def RATIO(num: str, den: str, dp: int) -> str:
    return f"(CASE WHEN ({den}) = 0 THEN 0e0 ELSE {R(f'({num})::DOUBLE / ({den})::DOUBLE', dp)} END)"


def FX(expr: str, dp: int) -> str:
    """Fixed-point text."""
    unit = 10**dp
    u = f"CAST(floor(abs({expr}) * 1e{dp} + 0.5e0) AS BIGINT)"
    sign = f"(CASE WHEN ({expr}) < 0 AND {u} > 0 THEN '-' ELSE '' END)"
    if dp == 0:
        return f"({sign} || {u}::VARCHAR)"
    return f"({sign} || ({u} // {unit})::VARCHAR || '.' || lpad(({u} % {unit})::VARCHAR, {dp}, '0'))"


def PCT(expr: str, dp: int) -> str:
    return f"({FX(f'({expr}) * 100e0', dp)} || '%')"


def CLAMP(expr: str) -> str:
    return f"greatest(0e0, least(1e0, {expr}))"


def AVG(expr: str, dp_in: int, dp_out: int) -> str:
    """Average from exact integer sums."""
    return R(f"sum(CAST(floor({expr} * 1e{dp_in} + 0.5e0) AS BIGINT))::DOUBLE / (count({expr})::DOUBLE * 1e{dp_in})", dp_out)


def text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def items(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def case(table: dict, key: str, quote=text) -> str:
    return "(CASE " + " ".join(f"WHEN {key} = {text(k)} THEN {quote(v)}" for k, v in table.items()) + " END)"


def padded(expr: str, width: int) -> str:
    s = f"({expr})::VARCHAR"
    return f"(CASE WHEN length({s}) >= {width} THEN {s} ELSE lpad({s}, {width}, '0') END)"


OFFICES = items(dims.OFFICES)
ZONES = items(o[2] for o in dims.OFFICES.values())
LAT = {n: o[0] for n, o in dims.OFFICES.items()}
LON = {n: o[1] for n, o in dims.OFFICES.items()}
number = lambda v: f"{v}::DOUBLE"
RES = items(fixtures.RESOURCES)
ATT = {i: {n: f[i] for n, f in dims.ATTACKS.items()} for i in range(5)}


def entity_id(expr: str) -> str:
    return f"'USR-' || {padded(expr, 6)}"


def entity_type(key: str) -> str:
    return (f"(CASE WHEN {key} % 20 = 0 THEN 'service_account' WHEN {key} % 20 = 1 THEN 'edge_device' "
            f"WHEN {key} % 20 = 2 THEN 'iot_device' ELSE 'user' END)")


CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (sql, needs)


def query(final: str, *needs: str) -> str:
    """``final`` under the CTEs it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][1]:
            visit(dep)
        order.append(name)

    for name in needs:
        visit(name)
    head = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][0]})" for n in order)
    if head and final.startswith("WITH "):
        return f"WITH {head},\n{final[5:]}"
    return f"WITH {head}\n{final}" if head else final


cte("ent", f"""
SELECT {entity_id('c_custkey')} AS entity_id, {entity_type('c_custkey')} AS entity_type, c_name AS display_name,
  CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 'Security' WHEN c_custkey % 7 = 0 THEN 'HR'
       ELSE {case(fixtures.SEGMENT_DEPARTMENT, 'c_mktsegment')} END AS department,
  CASE WHEN c_custkey % 20 = 0 THEN 'Service Account' WHEN c_custkey % 20 <= 2 THEN NULL
       WHEN c_custkey % 9 = 0 THEN 'Manager' ELSE 'Employee' END AS role,
  CASE WHEN c_custkey % 9 = 0 OR c_custkey % 20 = 0 THEN 'elevated' ELSE 'standard' END AS privilege_level,
  {OFFICES}[c_nationkey % 6 + 1] AS home_location,
  string_split({OFFICES}[c_nationkey % 6 + 1], ', ')[-1] AS home_country,
  {ZONES}[c_nationkey % 6 + 1] AS timezone, 7 + c_custkey % 3 AS wh_start, 17 + c_custkey % 3 AS wh_end,
  CASE WHEN c_custkey % 20 > 2 THEN '0,1,2,3,4' ELSE '0,1,2,3,4,5,6' END AS active_days,
  {RES}[c_custkey % 20 + 1] || '|' || {RES}[(c_custkey + 1) % 20 + 1] || '|' || {RES}[(c_custkey + 2) % 20 + 1] AS normal_resources,
  c_custkey % 4 = 3 AS is_remote, '10.' || c_nationkey::VARCHAR || '.0.0/16' AS network_cidr
FROM customer""")

cte("raw", """
SELECT e.event_id AS eid, e.ts, e.user_id AS u, e.event_type, e.value, CAST(json_extract(e.props, '$.k') AS INTEGER) AS k,
  c.c_nationkey AS nation
FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id""")

cte("lab0", f"""
SELECT 'evt-' || {padded('eid', 9)} AS event_id, ts, epoch_us(ts) AS us, {entity_id('u')} AS entity_id, {entity_type('u')} AS entity_type,
  CASE WHEN k % 25 = 24 THEN '172.16.' || (eid % 250)::VARCHAR || '.' || (k % 3 + 1)::VARCHAR
       ELSE '10.' || nation::VARCHAR || '.' || (u % 250)::VARCHAR || '.' || (k % 3 + 1)::VARCHAR END AS source_ip,
  {OFFICES}[CASE WHEN k % 25 = 24 THEN (nation + 1 + eid % 5) % 6 ELSE nation % 6 END + 1] AS geo_location,
  {RES}[CASE WHEN k < 70 THEN (u + k % 3) % 20 ELSE k % 20 END + 1] AS resource_accessed,
  {items(fixtures.AUTH_METHODS)}[k % 5 + 1] AS auth_method,
  CAST(floor(value * 10 + 0.5e0) AS BIGINT) AS session_duration,
  CASE WHEN k % 10 = 0 THEN '' WHEN k % 10 < 4 THEN 'cmd' || (k % 4)::VARCHAR
       ELSE 'cmd' || (k % 4)::VARCHAR || '|cmd' || (k % 3)::VARCHAR || '|cmd' || (eid % 2)::VARCHAR END AS command_sequence,
  CASE WHEN k >= 92 THEN 'unk-' || (eid % 40)::VARCHAR ELSE 'dev-' || u::VARCHAR || '-' || (k % 3)::VARCHAR END AS device_fingerprint,
  CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS login_result,
  timezone({ZONES}[nation % 6 + 1], timezone('UTC', ts)) AS loc, k, u,
  CASE WHEN k % 6 = 0 THEN 'os-' || (k % 5)::VARCHAR END AS device_os,
  CASE WHEN k % 8 = 0 THEN 'mac-' || (k % 7)::VARCHAR END AS device_mac,
  CASE WHEN k % 25 = 24 THEN 'impossible_travel' WHEN k >= 92 AND event_type = 'error' THEN 'brute_force'
       WHEN k >= 92 AND event_type = 'signup' THEN 'device_spoofing' END AS attack_type
FROM raw""", "raw")

cte("lab", f"""
SELECT * EXCLUDE (loc, k, u),
  (CASE WHEN ((u % 20 > 2 AND isodow(loc) <= 5) OR u % 20 <= 2) AND hour(loc) >= 7 + u % 3 AND hour(loc) < 17 + u % 3
        THEN 'in_hours' ELSE 'off_hours' END)
  || '|' || (CASE WHEN k % 25 = 24 THEN 'remote_location' ELSE 'home_location' END)
  || '|' || (CASE WHEN k < 92 THEN 'known_device' ELSE 'unrecognized_device' END)
  || '|' || (CASE WHEN k < 70 THEN 'expected_resource' ELSE 'unlisted_resource' END) AS risk_context,
  CASE WHEN attack_type IS NOT NULL THEN 'attack' ELSE 'normal' END AS label,
  attack_type IS NOT NULL AS is_attack,
  CASE WHEN attack_type IS NOT NULL THEN 'atk-' || substr(event_id, 5) END AS attack_id,
  {case(ATT[3], 'attack_type')} AS severity, {case(ATT[1], 'attack_type')} AS mitre_tactic,
  {case(ATT[2], 'attack_type')} AS mitre_technique,
  CASE WHEN attack_type IS NOT NULL THEN (50 + (k % 5) * 10) / 100e0 END AS confidence,
  CASE WHEN attack_type IS NOT NULL THEN 'mapped ' || attack_type END AS description
FROM lab0""", "lab0")

cte("triage", f"""
SELECT 'evt-' || {padded('event_id', 9)} AS event_id,
  {items(schemas.TRIAGE_STATES[1:] + ('open',))}[event_id % 4 + 1] AS status
FROM events WHERE event_id % 4 <> 0""")

# ---- features ----

cte("f1", """
SELECT l.*, e.timezone AS tz, e.wh_start, e.wh_end, e.department, e.entity_id IS NOT NULL AS known,
  string_split(l.geo_location, ', ')[-1] AS country, session_duration AS x, login_result = 'success' AS ok,
  row_number() OVER w AS rn, row_number() OVER w - 1 AS h,
  lag(us) OVER w AS prev_us, lag(geo_location) OVER w AS prev_geo, lag(resource_accessed) OVER w AS previous_resource,
  row_number() OVER (PARTITION BY l.entity_id, device_fingerprint ORDER BY us, event_id) - 1 AS n_device,
  row_number() OVER (PARTITION BY l.entity_id, resource_accessed ORDER BY us, event_id) - 1 AS n_resource,
  row_number() OVER (PARTITION BY l.entity_id, geo_location ORDER BY us, event_id) - 1 AS n_geo,
  row_number() OVER (PARTITION BY l.entity_id, device_os ORDER BY us, event_id) - 1 AS n_os,
  row_number() OVER (PARTITION BY l.entity_id, device_mac ORDER BY us, event_id) - 1 AS n_mac,
  list_distinct(list(resource_accessed) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) AS recent,
  list(resource_accessed) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 11 PRECEDING) AS older,
  list_distinct(list(resource_accessed) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS all_res,
  string_split(command_sequence, '|') AS cmds
FROM lab l LEFT JOIN ent e USING (entity_id)
WINDOW w AS (PARTITION BY l.entity_id ORDER BY us, event_id)""", "lab", "ent")

cte("f2", """
SELECT *, timezone(coalesce(tz, 'UTC'), timezone('UTC', ts)) AS loc,
  coalesce(geo_location <> prev_geo, false) AS moved,
  coalesce(sum(x) OVER p, 0)::BIGINT AS sx, coalesce(sum(x * x) OVER p, 0)::HUGEINT AS sxx,
  coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER p, 0)::BIGINT AS s_ok,
  coalesce(sum(CASE WHEN auth_method = 'mfa' THEN 1 ELSE 0 END) OVER p, 0)::BIGINT AS s_mfa,
  coalesce(sum(CASE WHEN prev_geo IS NOT NULL AND geo_location <> prev_geo THEN 1 ELSE 0 END) OVER p, 0)::BIGINT AS s_city,
  coalesce(max(CASE WHEN ok THEN rn END) OVER p, 0) AS last_ok,
  coalesce(sum(x) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ma_sum,
  count(x) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS ma_n,
  count(*) OVER (PARTITION BY entity_id ORDER BY us RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW)
    - count(*) OVER (PARTITION BY entity_id, us) + row_number() OVER (PARTITION BY entity_id, us ORDER BY event_id) - 1 AS burst,
  count(*) OVER (PARTITION BY entity_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)
    - count(*) OVER (PARTITION BY entity_id, us) + row_number() OVER (PARTITION BY entity_id, us ORDER BY event_id) - 1 AS burst_day
FROM f1
WINDOW w AS (PARTITION BY entity_id ORDER BY us, event_id),
       p AS (PARTITION BY entity_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", "f1")

cte("pctl", """
SELECT a.event_id, count(b.event_id) AS le
FROM lab a LEFT JOIN lab b ON b.entity_id = a.entity_id AND b.session_duration <= a.session_duration
  AND (b.us < a.us OR (b.us = a.us AND b.event_id < a.event_id))
GROUP BY a.event_id""", "lab")

_lat1, _lat2 = f"radians({case(LAT, 'prev_geo', number)})", f"radians({case(LAT, 'geo_location', number)})"
_hphi = f"(({_lat2} - {_lat1}) / 2)"
_hlam = f"((radians({case(LON, 'geo_location', number)}) - radians({case(LON, 'prev_geo', number)})) / 2)"
HAVERSINE = (f"(12742e0 * asin(sqrt(sin({_hphi}) * sin({_hphi}) + cos({_lat1}) * cos({_lat2}) * sin({_hlam}) * sin({_hlam}))))")
ELAPSED = "((us - prev_us) / 1e6)"
HOURS = f"({ELAPSED} / 3600e0)"
VARNUM = "(h::HUGEINT * sxx - sx::HUGEINT * sx::HUGEINT)"
STD = f"(CASE WHEN h >= 2 THEN sqrt({VARNUM}::DOUBLE / (h::DOUBLE * (h - 1)::DOUBLE)) ELSE 0e0 END)"
_own = case(dims.RESOURCE_DEPARTMENT, "resource_accessed")
_tier = lambda e: f"coalesce({case(dims.DEPARTMENT_TIER, e, str)}, 1)"
_unseen = lambda v, n: f"({v} IS NOT NULL AND {n} = 0)"

FEATURE_SQL = {
    "login_hour": "hour(loc)",
    "day_of_week": "isodow(loc) - 1",
    "is_weekend": "isodow(loc) >= 6",
    "working_hours_deviation": "(CASE WHEN NOT known OR (hour(loc) >= wh_start AND hour(loc) < wh_end) THEN 0e0 "
    "ELSE least((wh_start - hour(loc) + 24) % 24, (hour(loc) - wh_end + 24) % 24)::DOUBLE END)",
    "time_since_previous_login_seconds": f"coalesce({R(ELAPSED, 2)}, -1e0)",
    "session_duration_zscore": f"(CASE WHEN h >= 2 AND {VARNUM} > 0 THEN {R(f'(x - sx / h::DOUBLE) / {STD}', 4)} ELSE 0e0 END)",
    "geo_novelty": _unseen("geo_location", "n_geo"),
    "geo_velocity_kmh": f"(CASE WHEN prev_geo <> geo_location AND {HOURS} > 0 THEN {R(f'{HAVERSINE} / {HOURS}', 2)} ELSE 0e0 END)",
    "country_change": "coalesce(string_split(prev_geo, ', ')[-1] <> country, false)",
    "city_change_frequency": RATIO("s_city", "h", 4),
    "device_familiarity_score": RATIO("n_device", "h", 4),
    "fingerprint_mismatch": _unseen("device_fingerprint", "n_device"),
    "os_novelty": _unseen("device_os", "n_os"),
    "mac_novelty": _unseen("device_mac", "n_mac"),
    "success_ratio": RATIO("s_ok", "h", 4),
    "failure_ratio": RATIO("h - s_ok", "h", 4),
    "consecutive_failures": "(h - last_ok)",
    "mfa_usage_frequency": RATIO("s_mfa", "h", 4),
    "resource_novelty": _unseen("resource_accessed", "n_resource"),
    "resource_diversity": RATIO("coalesce(len(all_res), 0)", "h", 4),
    "command_sequence_complexity": f"(CASE WHEN command_sequence = '' THEN 0e0 ELSE {R('len(list_distinct(cmds))::DOUBLE / len(cmds)::DOUBLE', 4)} END)",
    "session_entropy": f"(CASE WHEN command_sequence = '' THEN 0e0 ELSE {R(chr(10) + 'list_entropy(cmds)', 4)} END)",
    "burst_access_score": "burst::DOUBLE",
    "behaviour_drift_score": RATIO(
        "len(list_filter(coalesce(recent, []), lambda r: NOT list_contains(coalesce(older, []), r)))",
        "len(coalesce(recent, []))", 4),
    "privilege_change_indicator": f"coalesce(department IS NOT NULL AND {_own} IS NOT NULL AND {_own} <> department AND {_tier(_own)} > {_tier('department')}, false)",
    "sensitive_resource_access": f"list_contains({items(dims.SENSITIVE_RESOURCES)}, resource_accessed)",
    "rolling_mean_session_duration": RATIO("sx", "h", 2),
    "rolling_std_session_duration": R(STD, 2),
    "moving_avg_session_duration": RATIO("ma_sum", "ma_n", 2),
    "historical_percentile_session_duration": f"(CASE WHEN h = 0 THEN 50e0 ELSE {R('100e0 * le / h::DOUBLE', 2)} END)",
    "history_length": "h",
    "new_entity_flag": "(h = 0)",
    "confidence_score": R("least(1e0, h / 30e0)", 4),
}
_event_columns = [c for c in schemas.REQUIRED_EVENT_COLUMNS + schemas.OPTIONAL_EVENT_COLUMNS if c != "timestamp"]
cte("feat", "SELECT ts, us, " + ", ".join(_event_columns) + ", is_attack, attack_type, previous_resource, burst_day, "
    + ", ".join(f"{e} AS {n}" for n, e in FEATURE_SQL.items()) + " FROM f2 JOIN pctl USING (event_id)", "f2", "pctl")

# ---- profiles, versions 1 (first half of the days) and 2 (all) ----

_stat_var = lambda s, ss: (f"(CASE WHEN n >= 2 THEN sqrt((n::HUGEINT * {ss} - {s}::HUGEINT * {s}::HUGEINT)::DOUBLE / "  # noqa: E731
                           "(n::DOUBLE * (n - 1)::DOUBLE)) ELSE 0e0 END)")
#: Halfway through the days of the events.
FIRST_BUILD_SQL = "(SELECT min(ts)::DATE + CAST((max(ts)::DATE + 1 - min(ts)::DATE) // 2 AS INTEGER) FROM events)"
for v, when in ((1, f"AND ts < {FIRST_BUILD_SQL}"), (2, "")):
    cte(f"nrm{v}", f"SELECT * FROM feat WHERE NOT is_attack {when}", "feat")
    cte(f"val{v}", f"""
SELECT entity_id, kind, value, uses, {R('uses::DOUBLE / sum(uses) OVER (PARTITION BY entity_id, kind)::DOUBLE', 4)} AS share FROM (
  SELECT entity_id, 'resource' AS kind, resource_accessed AS value, count(*) AS uses FROM nrm{v} GROUP BY 1, 3
  UNION ALL SELECT entity_id, 'device', device_fingerprint, count(*) FROM nrm{v} GROUP BY 1, 3
  UNION ALL SELECT entity_id, 'location', geo_location, count(*) FROM nrm{v} GROUP BY 1, 3)""", f"nrm{v}")
    cte(f"stat{v}", f"""
SELECT entity_id, n AS sample_count, {R('sh / n::DOUBLE', 4)} AS avg_login_hour, {R(_stat_var('sh', 'shh'), 4)} AS login_hour_std,
  {R('sx / n::DOUBLE', 4)} AS avg_session_duration, {R(_stat_var('sx', 'sxx'), 4)} AS session_duration_std,
  {R('n / days::DOUBLE', 4)} AS authentication_frequency_per_day, {R('fails / n::DOUBLE', 4)} AS failure_rate,
  {R('inside / n::DOUBLE', 4)} AS working_hour_ratio
FROM (SELECT entity_id, count(*) AS n, sum(login_hour)::BIGINT AS sh, sum(login_hour * login_hour)::BIGINT AS shh,
  sum(session_duration)::BIGINT AS sx, sum(session_duration * session_duration)::HUGEINT AS sxx, count(DISTINCT ts::DATE) AS days,
  count(*) FILTER (login_result = 'failure') AS fails, count(*) FILTER (working_hours_deviation = 0) AS inside
  FROM nrm{v} GROUP BY entity_id)""", f"nrm{v}")
    cte(f"nxt{v}", f"""
SELECT entity_id, resource_accessed AS a, lead(resource_accessed, 1) OVER w AS b, lead(resource_accessed, 2) OVER w AS c
FROM nrm{v} WINDOW w AS (PARTITION BY entity_id ORDER BY us, event_id)""", f"nrm{v}")
    cte(f"cmd{v}", f"""
SELECT entity_id, cmds[i] AS from_state, cmds[i + 1] AS to_state FROM (
  SELECT entity_id, cmds, unnest(range(1, len(cmds))) AS i FROM (
    SELECT entity_id, string_split(command_sequence, '|') AS cmds FROM nrm{v} WHERE command_sequence <> ''))""", f"nrm{v}")
    cte(f"tr{v}", f"""
SELECT entity_id, kind, from_state, to_state, uses,
  {R('uses::DOUBLE / sum(uses) OVER (PARTITION BY entity_id, kind, from_state)::DOUBLE', 4)} AS probability FROM (
  SELECT entity_id, 'resource' AS kind, a AS from_state, b AS to_state, count(*) AS uses FROM nxt{v} WHERE b IS NOT NULL GROUP BY ALL
  UNION ALL SELECT entity_id, 'command', from_state, to_state, count(*) FROM cmd{v} GROUP BY ALL)""", f"nxt{v}", f"cmd{v}")
    cte(f"seq{v}", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY uses DESC, a, b, c) AS rank FROM (
  SELECT entity_id, a, b, c, count(*) AS uses FROM nxt{v} WHERE c IS NOT NULL GROUP BY ALL)) WHERE rank <= 5""", f"nxt{v}")
    cte(f"didx{v}", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY department ORDER BY uses DESC, resource) AS rank FROM (
  SELECT department, resource_accessed AS resource, count(*) AS uses FROM nrm{v} JOIN ent USING (entity_id)
  WHERE department IS NOT NULL GROUP BY ALL)) WHERE rank <= 10""", f"nrm{v}", "ent")
    cte(f"shr{v}", f"""
SELECT entity_id, {R('len(list_intersect(own, peers))::DOUBLE / len(list_distinct(list_concat(own, peers)))::DOUBLE', 4)} AS resource_sharing_score
FROM (SELECT entity_id, list(DISTINCT resource_accessed) AS own FROM nrm{v} GROUP BY 1) JOIN ent USING (entity_id)
JOIN (SELECT department, list(resource) AS peers FROM didx{v} GROUP BY 1) USING (department)""", f"nrm{v}", "ent", f"didx{v}")
    stats = ", ".join(f"coalesce({c}, 0) AS {c}" for c in (
        "sample_count", "avg_login_hour", "login_hour_std", "avg_session_duration", "session_duration_std",
        "authentication_frequency_per_day", "failure_rate", "working_hour_ratio"))
    cte(f"base{v}", f"""
SELECT ent.entity_id, entity_type, {v} AS version, {stats}, department,
  coalesce(resource_sharing_score, 0) AS resource_sharing_score
FROM ent LEFT JOIN stat{v} USING (entity_id) LEFT JOIN shr{v} USING (entity_id)""", "ent", f"stat{v}", f"shr{v}")

cte("gap", f"""
SELECT entity_id, kind, CASE WHEN aa = 0 AND bb = 0 THEN 0e0 WHEN aa = 0 OR bb = 0 THEN 1e0
  ELSE {R('greatest(0e0, 1e0 - ab / (sqrt(aa) * sqrt(bb)))', 4)} END AS gap
FROM (SELECT entity_id, kind, sum(coalesce(a, 0) * coalesce(b, 0))::DOUBLE AS ab, sum(coalesce(a, 0) * coalesce(a, 0))::DOUBLE AS aa,
  sum(coalesce(b, 0) * coalesce(b, 0))::DOUBLE AS bb FROM (
  SELECT entity_id, kind, value, CAST(floor(o.share * 1e4 + 0.5e0) AS BIGINT) AS a, CAST(floor(w.share * 1e4 + 0.5e0) AS BIGINT) AS b
  FROM val1 o FULL JOIN val2 w USING (entity_id, kind, value)) GROUP BY ALL)""", "val1", "val2")

_cold = ("sample_count AS history_length, sample_count <= 0 AS is_new_entity, "
         f"CASE WHEN sample_count <= 0 THEN 0e0 ELSE {R('least(1e0, sample_count / 50e0)', 4)} END AS confidence_score, "
         "CASE WHEN sample_count < 5 THEN 'insufficient_data' WHEN sample_count < 50 THEN 'warming_up' ELSE 'established' END AS warmup_strategy")
cte("core1", f"""
SELECT *, 0e0 AS drift_score, '' AS drifted_dimensions, false AS is_significant_drift, 0 AS historical_sample_count,
  sample_count AS current_sample_count, {_cold} FROM base1""", "base1")
cte("drift2", f"""
SELECT n.entity_id, o.sample_count AS was, coalesce(gr.gap, 0) AS g_resource, coalesce(gd.gap, 0) AS g_device, coalesce(gl.gap, 0) AS g_location,
  least(1e0, abs(o.avg_login_hour - n.avg_login_hour) / 12e0) AS g_hour, least(1e0, abs(o.failure_rate - n.failure_rate)) AS g_failure
FROM base2 n JOIN base1 o USING (entity_id)
LEFT JOIN gap gr ON gr.entity_id = n.entity_id AND gr.kind = 'resource'
LEFT JOIN gap gd ON gd.entity_id = n.entity_id AND gd.kind = 'device'
LEFT JOIN gap gl ON gl.entity_id = n.entity_id AND gl.kind = 'location'""", "base1", "base2", "gap")
cte("core2", f"""
SELECT b.*, CASE WHEN was > 0 THEN {R('(g_resource + g_device + g_location + g_hour + g_failure) / 5e0', 4)} ELSE 0e0 END AS drift_score,
  CASE WHEN was > 0 THEN array_to_string(list_filter([CASE WHEN g_device >= 0.35e0 THEN 'device_frequency' END,
    CASE WHEN g_failure >= 0.35e0 THEN 'failure_rate' END, CASE WHEN g_location >= 0.35e0 THEN 'geo_frequency' END,
    CASE WHEN g_hour >= 0.35e0 THEN 'login_hour' END, CASE WHEN g_resource >= 0.35e0 THEN 'resource_frequency' END],
    lambda s: s IS NOT NULL), ',') ELSE '' END AS drifted_dimensions,
  CASE WHEN was > 0 THEN {R('(g_resource + g_device + g_location + g_hour + g_failure) / 5e0', 4)} ELSE 0e0 END >= 0.35e0 AS is_significant_drift,
  CASE WHEN was > 0 THEN was ELSE 0 END AS historical_sample_count, sample_count AS current_sample_count, {_cold}
FROM base2 b JOIN drift2 d USING (entity_id)""", "base2", "drift2")
cte("store", "SELECT * FROM core1 UNION ALL BY NAME SELECT * FROM core2", "core1", "core2")

# ---- detection ----

_z = lambda x, m, s: f"(CASE WHEN {s} > 0 THEN {CLAMP(f'abs({x} - {m}) / {s} / 3e0')} ELSE 0e0 END)"
cte("det0", f"""
SELECT f.*, p.entity_type AS p_type, p.version AS p_version, p.confidence_score AS p_conf, p.drift_score AS p_drift, p.warmup_strategy AS p_warm,
  p.avg_login_hour AS p_hour, p.login_hour_std AS p_hour_sd, p.avg_session_duration AS p_dur, p.session_duration_std AS p_dur_sd,
  p.failure_rate AS p_fail, p.resource_sharing_score AS p_sharing, p.drifted_dimensions AS p_dims,
  vd.share AS f_device, vr.share AS f_resource, vl.share AS f_location, t.probability AS f_transition
FROM feat f LEFT JOIN core2 p USING (entity_id)
LEFT JOIN val2 vd ON vd.entity_id = f.entity_id AND vd.kind = 'device' AND vd.value = f.device_fingerprint
LEFT JOIN val2 vr ON vr.entity_id = f.entity_id AND vr.kind = 'resource' AND vr.value = f.resource_accessed
LEFT JOIN val2 vl ON vl.entity_id = f.entity_id AND vl.kind = 'location' AND vl.value = f.geo_location
LEFT JOIN tr2 t ON t.entity_id = f.entity_id AND t.kind = 'resource' AND t.from_state = f.previous_resource AND t.to_state = f.resource_accessed
""", "feat", "core2", "val2", "tr2")
_share = lambda k: f"greatest(0e0, least(1e0, 1e0 - coalesce(f_{k}, 0e0)))"
DEV_SQL = {
    "temporal": R(f"greatest(CASE WHEN p_hour_sd > 0 THEN {_z('login_hour', 'p_hour', 'p_hour_sd')} ELSE "
                  + CLAMP("least(abs(login_hour - p_hour), 24e0 - abs(login_hour - p_hour)) / 12e0")
                  + f" END, {CLAMP('working_hours_deviation / 12e0')})", 4),
    "device": R(_share("device"), 4),
    "resource": f"(CASE WHEN previous_resource IS NOT NULL THEN {R('(' + _share('resource') + ' + ' + _share('transition') + ') / 2e0', 4)} ELSE {R(_share('resource'), 4)} END)",
    "geographic": R(_share("location"), 4),
    "authentication": f"(CASE WHEN login_result = 'failure' THEN {R('1e0 - p_fail', 4)} ELSE 0e0 END)",
    "session": R(_z("session_duration", "p_dur", "p_dur_sd"), 4),
}
cte("det1", "SELECT *, " + ", ".join(
    f"CASE WHEN p_version IS NULL THEN 0.5e0 ELSE {e} END AS deviation_{n}" for n, e in DEV_SQL.items()) + " FROM det0", "det0")
_w = {"temporal": 1.0, "device": 1.2, "resource": 1.2, "geographic": 1.5, "authentication": 1.3, "session": 0.8}
WEIGHTED = R("(0e0 + " + " + ".join(f"deviation_{n} * {w}e0" for n, w in _w.items()) + f") / {sum(_w.values())!r}e0", 4)
MAXDEV = R("greatest(" + ", ".join(f"deviation_{n}" for n in _w) + ")", 4)
INDICATOR = R("((consecutive_failures >= 3)::INT + fingerprint_mismatch::INT + (os_novelty OR mac_novelty)::INT + "
              "(geo_velocity_kmh > 900)::INT + (burst_access_score >= 10)::INT) / 5e0", 4)
cte("det2", f"""
SELECT *, {WEIGHTED} AS anomaly_score, {MAXDEV} AS max_deviation_score, {INDICATOR} AS risk_indicator_component,
  coalesce(p_conf, 0e0) AS historical_confidence,
  CASE WHEN p_version IS NULL THEN 0e0 ELSE {R(CLAMP('1e0 - p_drift'), 4)} END AS entity_trust,
  CASE WHEN p_warm = 'established' THEN 0e0 WHEN p_warm = 'warming_up' THEN 0.2e0 ELSE 0.5e0 END AS risk_cold_start_component
FROM det1""", "det1")
cte("det3", f"""
SELECT *, {R(CLAMP('anomaly_score'), 4)} AS risk_deviation_component, {R('1e0 - historical_confidence', 4)} AS risk_confidence_component,
  {R('1e0 - entity_trust', 4)} AS risk_trust_component FROM det2""", "det2")
_raw = ("0.4e0 * risk_deviation_component + 0.25e0 * risk_indicator_component + 0.15e0 * risk_confidence_component "
        "+ 0.1e0 * risk_trust_component + 0.1e0 * risk_cold_start_component")
cte("det4", f"SELECT *, {R(f'100e0 * {CLAMP(_raw)}', 2)} AS risk_score FROM det3", "det3")
SEVERITY = ("CASE WHEN risk_score >= 55 THEN 'critical' WHEN risk_score >= 45 THEN 'high' WHEN risk_score >= 25 THEN 'medium' "
            "WHEN risk_score >= 10 THEN 'low' ELSE 'informational' END")
cte("det5", f"SELECT *, {SEVERITY} AS severity FROM det4", "det4")
cte("det", "SELECT *, CASE WHEN severity IN ('high', 'critical') THEN 'anomalous' WHEN severity = 'medium' THEN 'suspicious' ELSE 'normal' END AS verdict FROM det5", "det5")

# ---- classification ----

cte("trend", """
SELECT entity_id, count(*) AS profile_version_count, list(drift_score ORDER BY version) AS drift_score_trend,
  list(sample_count ORDER BY version) AS sample_count_trend FROM store GROUP BY 1""", "store")
cte("evi", """
SELECT d.*, t.profile_version_count, t.drift_score_trend, t.profile_version_count >= 2 AND t.drift_score_trend[-1] > t.drift_score_trend[1] AS drift_rising,
  CASE WHEN p_version IS NOT NULL AND previous_resource IS NOT NULL THEN coalesce(f_transition, 0e0) END AS transition_probability
FROM det d LEFT JOIN trend t USING (entity_id) WHERE verdict <> 'normal'""", "det", "trend")

_dev = lambda n, b: (f"deviation_{n} >= {b}", f"'{n} deviation=' || {FX(f'deviation_{n}', 2)} || ' >= {b:.2f}'")
_lt = lambda n, b, label=None: (f"{n} < {b}", f"'{label or n}=' || {FX(n, 2)} || ' < {b:.2f}'")
_ge = lambda n, b, dp=2: (f"{n} >= {b}", f"'{n}=' || {FX(n, dp)} || ' >= {b:.{dp}f}'")
_fail, _succ = ("login_result = 'failure'", "'login_result=failure'"), ("login_result = 'success'", "'login_result=success'")
_sens = ("sensitive_resource_access", "'sensitive_resource_access=true'")
_strange = "(fingerprint_mismatch OR os_novelty OR mac_novelty)"
CHECKS = {
    "brute_force": [_fail, ("consecutive_failures >= 3", "'consecutive_failures=' || consecutive_failures::VARCHAR || ' >= 3'"),
                    _ge("burst_access_score", 10.0, 1), _dev("authentication", 0.5),
                    (f"NOT {_strange}", "'device identity is one the entity is known for'")],
    "impossible_travel": [("geo_velocity_kmh > 900", f"'geo_velocity_kmh=' || {FX('geo_velocity_kmh', 0)} || ' > 900'"),
                          ("country_change", "'country_change=true'"), ("geo_novelty", "'geo_novelty=true'"), _dev("geographic", 0.5), _succ],
    "credential_stuffing": [_fail, _lt("device_familiarity_score", 0.3), (_strange, "'device identity is new for the entity'"),
                            ("consecutive_failures >= 1 AND consecutive_failures < 10", "'consecutive_failures=' || consecutive_failures::VARCHAR || ' within 1..9'"),
                            _lt("burst_access_score", 10.0)],
    "lateral_movement": [("resource_novelty", "'resource_novelty=true'"), _sens, _lt("p_sharing", 0.2, "resource_sharing_score"),
                         _lt("transition_probability", 0.05, "resource_transition_probability"), _dev("resource", 0.5)],
    "device_spoofing": [("fingerprint_mismatch", "'fingerprint_mismatch=true'"), ("(os_novelty OR mac_novelty)", "'os_novelty or mac_novelty=true'"),
                        _lt("device_familiarity_score", 0.2), _dev("device", 0.5), _succ],
    "low_and_slow_exfiltration": [_sens, _ge("resource_diversity", 0.6), _ge("historical_percentile_session_duration", 85.0, 1),
                                  _lt("burst_access_score", 5.0), _dev("session", 0.3)],
    "insider_drift": [_ge("behaviour_drift_score", 0.35), ("session_entropy <= 0.1", f"'session_entropy=' || {FX('session_entropy', 2)} || ' <= 0.10'"),
                      ("NOT new_entity_flag", "'entity has a history'"), _ge("resource_diversity", 0.2),
                      ("(drift_rising OR history_length >= 10)", "CASE WHEN drift_rising THEN 'drift rises over the stored profile versions' "
                       "ELSE 'history_length=' || history_length::VARCHAR || ' >= 10' END")],
}


def score_sql(name: str) -> str:
    plain = R("(" + " + ".join(f"coalesce(({c})::INT, 0)" for c, _ in CHECKS[name]) + ") / 5e0", 4)
    if name == "insider_drift":
        return f"(CASE WHEN session_entropy > 0.5e0 THEN {R(plain + ' * 0.5e0', 4)} ELSE {plain} END)"
    return plain


def evidence_sql(name: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in CHECKS[name]) + "], lambda s: s IS NOT NULL)"


cte("cls1", "SELECT *, " + ", ".join(f"{score_sql(n)} AS score_{n}, {evidence_sql(n)} AS e_{n}" for n in dims.KNOWN_ATTACKS) + " FROM evi", "evi")
_cand = " UNION ALL ".join(
    f"SELECT event_id, '{n}' AS name, score_{n} AS score, deviation_{dims.PRIMARY_DIMENSION[n]} AS dev, e_{n} AS ev FROM cls1" for n in dims.KNOWN_ATTACKS)
cte("cand", f"SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, dev DESC, name DESC) AS place FROM ({_cand})", "cls1")
cte("cls2", """
SELECT c.*, CASE WHEN b.score < 0.4e0 THEN 'unknown' ELSE b.name END AS chosen, CASE WHEN b.score < 0.4e0 THEN 0e0 ELSE b.score END AS top,
  r.score AS second, CASE WHEN b.score < 0.4e0 THEN [] ELSE b.ev END AS evidence
FROM cls1 c JOIN cand b ON b.event_id = c.event_id AND b.place = 1 JOIN cand r ON r.event_id = c.event_id AND r.place = 2""", "cls1", "cand")
_conf = CLAMP(f"0.5e0 * top + 0.3e0 * {CLAMP('top - second')} + 0.2e0 * {CLAMP('anomaly_score')}")
cte("reg", "SELECT * FROM (VALUES " + ", ".join(
    f"({text(n)}, {text(f[0])}, {text(f[1])}, {text(f[2])}, {text(f[3])}, {text(f[4])})" for n, f in dims.ATTACKS.items())
    + ") t(type_name, display_name, tactic, technique, typical, about)")
cte("cls", f"""
SELECT c.*, reg.display_name, reg.tactic, reg.technique, reg.typical,
  {R(f"CASE WHEN chosen = 'unknown' THEN least({_conf}, 0.4e0) ELSE {_conf} END", 4)} AS conf
FROM cls2 c JOIN reg ON reg.type_name = c.chosen""", "cls2", "reg")

# ---- explanations ----

_sum6 = " + ".join(f"deviation_{d}" for d in schemas.DIMENSIONS)
_cent = lambda d: f"CAST(floor(deviation_{d} / ({_sum6}) * 100e0 * 100e0 + 0.5e0) AS BIGINT)"
cte("x1", f"""
SELECT *, ({_sum6}) AS dev_sum, CASE WHEN ({_sum6}) > 0 THEN [{', '.join(_cent(d) for d in schemas.DIMENSIONS)}] END AS cents FROM cls""", "cls")
cte("x2", "SELECT *, 10000 - list_sum(cents) AS left_over, list_position(cents, list_max(cents)) AS big FROM x1", "x1")


def _habit(subject: str, share: str, new: str, note: str) -> str:
    return (f"(CASE WHEN p_version IS NULL THEN {subject} || ' has no profile to compare with.' "
            f"WHEN coalesce({share}, 0) <= 0 THEN {subject} || ' is not in the entity''s profile.' "
            f"ELSE {subject} || ' makes up ' || {PCT(share, 1)} || ' of the entity''s profile.' END) || (CASE WHEN {new} THEN {note} ELSE '' END)")


TEXT_SQL = {
    "temporal": "CASE WHEN p_version IS NOT NULL THEN 'Login hour ' || login_hour::VARCHAR || ', usually ' || " + FX("p_hour", 1) + " || ' ± ' || "
    + FX("p_hour_sd", 1) + " || '; ' || " + FX("working_hours_deviation", 1) + " || ' h outside working hours.' "
    "ELSE 'Login hour ' || login_hour::VARCHAR || '; no baseline yet.' END",
    "device": _habit("'Device ''' || device_fingerprint || ''''", "f_device", "fingerprint_mismatch", "' First use of this device.'"),
    "resource": _habit("'Resource ''' || resource_accessed || '''' || (CASE WHEN sensitive_resource_access THEN ' (sensitive)' ELSE '' END)",
                       "f_resource", "resource_novelty", "' First use of this resource.'"),
    "geographic": _habit("'Location ''' || geo_location || ''''", "f_location", "geo_novelty",
                         "' First visit; implied speed ' || " + FX("geo_velocity_kmh", 0) + " || ' km/h.'"),
    "authentication": "CASE WHEN login_result = 'failure' THEN 'Login failed; the entity fails ' || " + PCT("coalesce(p_fail, 0e0)", 1)
    + " || ' of the time.' ELSE 'Login succeeded.' END",
    "session": "CASE WHEN p_version IS NOT NULL THEN 'Session of ' || " + FX("session_duration", 0) + " || ' s, usually ' || " + FX("p_dur", 0)
    + " || ' ± ' || " + FX("p_dur_sd", 0) + " || ' s.' ELSE 'Session of ' || " + FX("session_duration", 0) + " || ' s; no baseline yet.' END",
}
cte("con0", " UNION ALL ".join(
    f"SELECT event_id, '{d}' AS dimension, {i} AS i, deviation_{d} AS raw_deviation, "
    f"CASE WHEN dev_sum > 0 THEN cents[{i}] + (CASE WHEN big = {i} THEN left_over ELSE 0 END) ELSE 1667 END AS cents, "
    f"{TEXT_SQL[d]} AS explanation FROM x2" for i, d in enumerate(schemas.DIMENSIONS, 1)), "x2")
cte("con", "SELECT *, cents / 100e0 AS pct, row_number() OVER (PARTITION BY event_id ORDER BY cents DESC, i) AS place FROM con0", "con0")
cte("top3", "SELECT event_id, string_agg(dimension || ' (' || " + FX("pct", 1) + " || '%): ' || explanation, ' | ' ORDER BY place) AS top_indicators "
    "FROM con WHERE place <= 3 GROUP BY 1", "con")
cte("exp", f"""
SELECT x.*, t.top_indicators,
  CASE WHEN conf >= 0.65e0 THEN 'high' WHEN conf >= 0.4e0 THEN 'medium' ELSE 'low' END AS level,
  {R('top', 4)} AS match_strength, {R('greatest(0e0, top - second)', 4)} AS margin, {R('anomaly_score', 4)} AS detection_strength,
  'Anomaly ' || {FX('anomaly_score', 2)} || ' of 1 and risk ' || {FX('risk_score', 1)} || ' of 100: verdict ' || verdict || ', severity ' || severity || '.' AS behaviour_deviation,
  CASE WHEN p_version IS NULL THEN 'The entity has no profile; a neutral baseline was used.' ELSE
    'Profile version ' || p_version::VARCHAR || ' (' || p_warm || '), drift ' || {FX('p_drift', 2)} || '.' ||
    CASE WHEN profile_version_count >= 2 THEN ' Drift over ' || profile_version_count::VARCHAR || ' versions is ' ||
      CASE WHEN drift_rising THEN 'rising' ELSE 'stable or falling' END || ' (' ||
      array_to_string(list_transform(drift_score_trend, lambda v: {FX('v', 2)}), ', ') || ').' ELSE '' END END AS historical_comparison,
  'Main dimensions: ' || t.top_indicators AS feature_impact,
  {FX('risk_indicator_component * 100e0', 0)} || '% of the general warning signs are present. Evidence: ' ||
    CASE WHEN len(evidence) > 0 THEN array_to_string(evidence, ', ') ELSE 'none strong enough' END || '.' AS attack_indicators
FROM x2 x JOIN top3 t USING (event_id)""", "x2", "top3")

_acts = [(n, i, p, a, r) for n, acts in dims.ACTIONS.items() for i, (p, a, r) in enumerate(acts, 1)]
cte("cat", "SELECT * FROM (VALUES " + ", ".join(
    f"({text(n)}, {i}, {schemas.PRIORITIES.index(p)}, {text(p)}, {text(a)}, {text(r)})" for n, i, p, a, r in _acts)
    + ") t(type_name, i, rank, priority, action, rationale)")
_esc = dims.ESCALATION
cte("act", f"""
SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY rank, i) AS place FROM (
  SELECT event_id, chosen, i, rank, priority, action, rationale FROM exp JOIN cat ON cat.type_name = exp.chosen
  UNION ALL SELECT event_id, chosen, 0, 0, {text(_esc[0])}, {text(_esc[1])}, {text(_esc[2])} FROM exp WHERE severity IN ('high', 'critical'))""", "exp", "cat")
cte("actl", """
SELECT event_id, string_agg('[' || priority || '] ' || action || ' — ' || rationale, ' | ' ORDER BY place) AS actions_text,
  string_agg('[' || priority || '] ' || action, ' | ' ORDER BY place) AS actions_brief FROM act GROUP BY 1""", "act")
CONFIDENCE_TEXT = ("'Confidence ' || level || ' (' || " + PCT("conf", 0) + " || '): match ' || " + PCT("match_strength", 0)
                   + " || ' for ' || display_name || ', margin ' || " + PCT("margin", 0) + " || ', detection ' || " + PCT("detection_strength", 0)
                   + " || '. ' || CASE level WHEN 'high' THEN 'Reliable.' WHEN 'medium' THEN 'Corroborate before acting.' ELSE 'A lead only.' END")

# ---- alerts ----

cte("alr", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chosen ORDER BY risk_score DESC, event_id) AS alert_place FROM exp)""", "exp")
cte("alt", "SELECT a.*, coalesce(t.status, 'open') AS status FROM alr a LEFT JOIN triage t USING (event_id)", "alr", "triage")
cte("hist", """
SELECT * FROM (
  SELECT a.event_id, b.event_id AS past_id, b.us, b.resource_accessed, b.device_fingerprint, b.geo_location, b.login_result, b.session_duration, b.auth_method,
    row_number() OVER (PARTITION BY a.event_id ORDER BY b.us DESC, b.event_id DESC) AS back
  FROM alr a JOIN feat b ON b.entity_id = a.entity_id AND (b.us < a.us OR (b.us = a.us AND b.event_id <= a.event_id)))
WHERE back <= 12""", "alr", "feat")
