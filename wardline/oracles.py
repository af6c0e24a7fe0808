"""Equivalent SQL for every deterministic query, built from named blocks."""

from __future__ import annotations

from wardline.sources.access_log import CITIES, RESOURCES
from wardline.sources.schema import BASELINE_NUMBERS, SIGNALS


def _values(rows) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else (f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v))
    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


BLOCKS: dict[str, tuple[list[str], str]] = {}


def _block(name: str, needs: list[str], sql: str) -> None:
    BLOCKS[name] = (needs, sql)


_block("access_log", [], f"""
SELECT 'evt_' || CAST(event_id*100+i AS VARCHAR) AS event_id, ts + off_s * INTERVAL '1' SECOND AS timestamp,
  'user_' || CAST(user_id AS VARCHAR) AS user_id,
  CASE WHEN label='credential_misuse' THEN 'nov_' || CAST(event_id AS VARCHAR)
       WHEN label='device_spoofing' THEN 'dev_' || CAST(user_id+1 AS VARCHAR) || '_0'
       ELSE 'dev_' || CAST(user_id AS VARCHAR) || '_' || CAST(event_id%2 AS VARCHAR) END AS device_id,
  CASE WHEN label IN ('credential_misuse','brute_force','device_spoofing') OR (label='impossible_travel' AND i=1)
       THEN '203.0.' || CAST(user_id%200 AS VARCHAR) || '.' || CAST(k%250 AS VARCHAR)
       ELSE '10.' || CAST(user_id%200 AS VARCHAR) || '.' || CAST(k%250 AS VARCHAR) || '.' || CAST(event_id%250 AS VARCHAR)
       END AS source_ip,
  geo_city, geo_lat, geo_lon, resource_accessed,
  CASE WHEN label='lateral_movement' THEN 'read'
       WHEN label IN ('brute_force','credential_misuse','impossible_travel') THEN 'login'
       WHEN event_type IN ('signup','error') THEN 'login' WHEN event_type='purchase' THEN 'write'
       WHEN event_type='click' AND k%25=0 THEN 'escalate' ELSE 'read' END AS action,
  CASE k%5 WHEN 0 THEN 'password' WHEN 1 THEN 'mfa' WHEN 2 THEN 'sso' WHEN 3 THEN 'certificate' ELSE 'api-key' END AS auth_method,
  CASE WHEN label='brute_force' THEN 1+i%5 ELSE 10+CAST(floor(value*60) AS INT) END AS session_duration_s,
  CASE WHEN label='brute_force' THEN CAST(0 AS BIGINT) ELSE CAST(floor(value*1000) AS BIGINT) END AS bytes_transferred,
  NOT (label='brute_force' OR (label='normal' AND event_type='error' AND k%7=0)) AS success, label,
  CASE user_id%4 WHEN 0 THEN 'standard' WHEN 1 THEN 'admin' WHEN 2 THEN 'developer' ELSE 'analyst' END AS role,
  epoch_us(ts + off_s * INTERVAL '1' SECOND) AS us
FROM (SELECT b.*,
    CASE WHEN label='impossible_travel' AND i=1 THEN (user_id+9)%18 WHEN label='credential_misuse' THEN (user_id+5)%18 ELSE user_id%18 END AS cix,
    CASE WHEN label='lateral_movement' THEN (user_id+i)%20 WHEN label='brute_force' THEN 8 ELSE (user_id*3+k%4)%20 END AS rix,
    CASE WHEN label='brute_force' THEN i*5 WHEN label='lateral_movement' THEN i*60 WHEN label='impossible_travel' THEN i*1200 ELSE 0 END AS off_s
  FROM (SELECT base.*, r.i FROM
      (SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props,'([0-9]+)',1) AS INT) AS k,
        CASE WHEN event_id%500=0 THEN 'brute_force' WHEN event_id%500=250 THEN 'lateral_movement'
             WHEN event_id%97=1 THEN 'impossible_travel' WHEN event_id%101=2 THEN 'credential_misuse'
             WHEN event_id%103=3 THEN 'device_spoofing' ELSE 'normal' END AS label FROM events) base
      JOIN (SELECT unnest(range(15)) AS i) r ON r.i=0 OR (label='brute_force' AND r.i<12)
        OR label='lateral_movement' OR (label='impossible_travel' AND r.i<2)) b) d
JOIN (VALUES {_values([(i, *c) for i, c in enumerate(CITIES)])}) AS c(ci,geo_city,geo_lat,geo_lon) ON c.ci=d.cix
JOIN (VALUES {_values(list(enumerate(RESOURCES)))}) AS s(ri,resource_accessed) ON s.ri=d.rix""")

_block("normal_log", ["access_log"], "SELECT *, CAST(hour(timestamp) AS DOUBLE) AS hr FROM access_log WHERE label='normal'")

_block("stats", ["normal_log"], """
SELECT n.*, c.home_city FROM (
  SELECT user_id, avg(hr) AS mean_hour, coalesce(stddev_samp(hr),1.0) AS std_hour,
    avg(session_duration_s) AS mean_session_s, coalesce(stddev_samp(session_duration_s),1.0) AS std_session_s,
    avg(bytes_transferred) AS mean_bytes, coalesce(stddev_samp(bytes_transferred),1.0) AS std_bytes,
    avg(CASE WHEN success THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END) AS failure_rate,
    count(DISTINCT resource_accessed) AS n_distinct_resources, count(DISTINCT device_id) AS n_devices,
    count(*) AS event_count, arg_max(role, timestamp) AS role,
    list_sort(list(DISTINCT device_id)) AS known_devices, list_sort(list(DISTINCT source_ip)) AS known_ips
  FROM normal_log GROUP BY user_id) n
JOIN (SELECT user_id, geo_city AS home_city FROM (
    SELECT user_id, geo_city, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, geo_city) AS r
    FROM normal_log GROUP BY user_id, geo_city) WHERE r=1) c USING (user_id)""")

_NUM = BASELINE_NUMBERS
_block("medians", ["stats"],
       "SELECT " + ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS {c}" for c in _NUM) + " FROM stats")

_block("ordered_log", ["access_log"], """
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, event_id) AS rn,
  rank() OVER (PARTITION BY user_id ORDER BY timestamp) AS rk FROM access_log""")

_block("lookback", ["ordered_log"], """
SELECT a.event_id, count(DISTINCT b.resource_accessed) + 1 AS session_resource_count,
  count(CASE WHEN b.us >= a.us - 120000000 AND b.source_ip = a.source_ip AND NOT b.success THEN 1 END) AS rapid_failure_count
FROM ordered_log a LEFT JOIN ordered_log b ON b.user_id = a.user_id AND b.rn < a.rk AND b.rn >= a.rk - 30
GROUP BY a.event_id""")

_block("travel", ["access_log"], """
SELECT event_id, coalesce(km / greatest((us - pus) / CAST(3600000000 AS DOUBLE), 0.000001), 0) AS speed,
  CASE WHEN pcity IS NOT NULL AND pcity <> geo_city THEN 1 ELSE 0 END AS city_changed
FROM (SELECT *, 12742.0 * asin(sqrt(least(1.0, greatest(0.0,
    pow(sin((radians(geo_lat) - radians(plat)) / 2), 2)
    + cos(radians(plat)) * cos(radians(geo_lat)) * pow(sin((radians(geo_lon) - radians(plon)) / 2), 2))))) AS km
  FROM (SELECT *, lag(geo_city) OVER w AS pcity, lag(geo_lat) OVER w AS plat, lag(geo_lon) OVER w AS plon,
      lag(us) OVER w AS pus FROM access_log WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, event_id)))""")

_block("context", ["access_log", "lookback", "travel"], """
SELECT l.*, k.session_resource_count, k.rapid_failure_count, least(t.speed, 20000.0) AS travel_speed_kmh,
  CASE WHEN t.speed > 800 THEN 1 ELSE 0 END AS is_impossible_travel, t.city_changed
FROM access_log l JOIN lookback k USING (event_id) JOIN travel t USING (event_id)""")

_OWN = ", ".join(f"CASE WHEN s.user_id IS NULL THEN p.{c} ELSE CAST(s.{c} AS DOUBLE) END AS b_{c}" for c in _NUM)
_block("features", ["context", "stats", "medians"], f"""
SELECT *, least(abs(hour_of_day - b_mean_hour), 24 - abs(hour_of_day - b_mean_hour)) / greatest(b_std_hour, 0.5) AS hour_deviation,
  least(greatest((session_duration_s - b_mean_session_s) / greatest(b_std_session_s, 1.0), -5.0), 5.0) AS session_z,
  least(greatest((bytes_transferred - b_mean_bytes) / greatest(b_std_bytes, 1.0), -5.0), 5.0) AS bytes_z,
  CAST(trunc(b_n_devices) AS INT) AS n_known_devices,
  session_resource_count / greatest(b_n_distinct_resources, 1.0) AS resource_breadth_ratio
FROM (SELECT c.*, hour(c.timestamp) AS hour_of_day, {_OWN},
    CASE WHEN s.user_id IS NOT NULL AND list_contains(s.known_devices, c.device_id) THEN 0 ELSE 1 END AS is_novel_device,
    CASE WHEN starts_with(c.source_ip, '10.') OR starts_with(c.source_ip, '192.168.') OR starts_with(c.source_ip, '172.') THEN 0 ELSE 1 END AS is_public_ip,
    CASE WHEN s.user_id IS NOT NULL AND s.event_count >= 60 THEN 0 ELSE 1 END AS cold_start,
    CASE WHEN s.user_id IS NOT NULL AND s.event_count >= 60 THEN 'personal' ELSE 'population' END AS baseline_type,
    CASE c.action WHEN 'read' THEN 1 WHEN 'write' THEN 2 WHEN 'escalate' THEN 3 ELSE 0 END AS action_enc,
    CASE c.auth_method WHEN 'mfa' THEN 1 WHEN 'sso' THEN 2 WHEN 'certificate' THEN 3 WHEN 'api-key' THEN 4 ELSE 0 END AS auth_enc
  FROM context c LEFT JOIN stats s ON s.user_id = c.user_id CROSS JOIN medians p) x""")

_block("violations", ["features"], """
SELECT event_id, user_id, timestamp, 'impossible_travel' AS rule, 'high' AS severity,
  'Travel speed ' || format('{:,.0f}', travel_speed_kmh) || ' km/h exceeds physical maximum' AS detail
FROM features WHERE travel_speed_kmh > 800
UNION ALL SELECT event_id, user_id, timestamp, 'brute_force', 'high',
  CAST(rapid_failure_count AS VARCHAR) || ' failed logins in 2-minute window' FROM features WHERE rapid_failure_count >= 10
UNION ALL SELECT event_id, user_id, timestamp, 'suspicious_escalation', 'medium',
  'Privilege escalation from a public IP address' FROM features WHERE action = 'escalate' AND is_public_ip = 1""")

_block("standin", ["access_log"], """
SELECT *, CAST(n % 97 AS DOUBLE) / 96 AS anomaly_score, CAST(40 + n % 60 AS DOUBLE) / 100 AS confidence
FROM (SELECT *, CAST(substr(event_id, 5) AS BIGINT) AS n FROM access_log)""")

_RISK = """CAST(CASE WHEN attack_type = 'normal' THEN least(30.0, trunc(anomaly_score * 40))
  WHEN attack_type = 'unknown_anomaly' THEN trunc(least(70.0, greatest(40.0, (anomaly_score * CAST(0.6 AS DOUBLE) + confidence * CAST(0.2 AS DOUBLE)) * 100)))
  ELSE trunc(least(100.0, greatest(50.0, (anomaly_score * CAST(0.4 AS DOUBLE) + confidence * CAST(0.6 AS DOUBLE)) * 100))) END AS INT)"""

# Stand-in score with some classes below the confidence floor.
_block("risked", ["standin"], f"""
SELECT *, {_RISK} AS risk_score FROM (
  SELECT *, CASE WHEN confidence < 0.45 AND label <> 'normal' THEN 'unknown_anomaly' ELSE label END AS attack_type FROM standin)""")

_block("explained", ["features", "risked"], """
SELECT f.*, r.risk_score, r.attack_type, r.confidence, r.anomaly_score, r.n FROM features f
JOIN (SELECT event_id, risk_score, attack_type, confidence, anomaly_score, n FROM risked) r USING (event_id)""")

_SIG = " UNION ALL ".join(
    f"SELECT event_id, {i} AS pos, '{s}' AS feature, CAST({s} AS DOUBLE) AS value FROM explained" for i, s in enumerate(SIGNALS))
_block("signal_rank", ["explained"], f"""
SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(value) DESC, pos) AS r FROM ({_SIG})""")

_block("reasons", ["explained", "signal_rank"], """
SELECT e.*, trim(CASE attack_type
  WHEN 'impossible_travel' THEN p || ' Login detected from ' || geo_city || ' shortly after a login from a distant location (implied travel speed: '
    || CASE WHEN travel_speed_kmh > 0 THEN format('{:,.0f}', travel_speed_kmh) || ' km/h' ELSE 'an impossible speed' END
    || ', faster than any commercial aircraft). '
    || CASE WHEN is_novel_device = 1 THEN 'Device ''' || device_id || ''' has not been seen for this user before.' ELSE '' END
  WHEN 'brute_force' THEN p || ' ' || CAST(rapid_failure_count AS VARCHAR) || ' failed login attempt'
    || CASE WHEN rapid_failure_count = 1 THEN '' ELSE 's' END || ' from ' || source_ip
    || ' within a 2-minute window — consistent with an automated password-guessing attack against ' || user_id || '.'
  WHEN 'lateral_movement' THEN p || ' This session touched ' || CAST(session_resource_count AS VARCHAR) || ' distinct resources including '''
    || resource_accessed || ''' — ' || format('{:.1f}', resource_breadth_ratio)
    || 'x more than this user''s normal breadth. Pattern consistent with credential compromise and internal reconnaissance.'
  WHEN 'credential_misuse' THEN p || ' Successful login with: ' || coalesce(nullif(concat_ws('; ',
      CASE WHEN is_novel_device = 1 THEN 'device ''' || device_id || ''' not previously associated with ' || user_id END,
      CASE WHEN hour_deviation >= 3.0 THEN 'login time is ' || format('{:.1f}', hour_deviation) || ' standard deviations outside this user''s normal schedule' END,
      CASE WHEN is_public_ip = 1 THEN 'access from public IP ' || source_ip || ' (unusual for this user)' END), ''),
      'access pattern deviates from this user''s baseline') || '.'
  WHEN 'device_spoofing' THEN p || ' Device fingerprint ''' || device_id || ''' is not in ' || user_id || '''s registered device set. '
    || CASE WHEN is_public_ip = 1 THEN 'Access originated from public IP ' || source_ip || '.' ELSE '' END
  WHEN 'normal' THEN 'Risk score ' || CAST(risk_score AS VARCHAR) || '/100 — behaviour consistent with ' || user_id || '''s baseline. No anomalies detected.'
  ELSE p || ' Behaviour deviates from ' || user_id || '''s baseline but does not match a known attack pattern. Most anomalous signal: '''
    || feature || ''' (value: ' || format('{:.2f}', value) || '). Recommend manual review.' END
  || CASE WHEN cold_start = 1 THEN ' [Note: using population baseline — insufficient personal history for this user.]' ELSE '' END) AS reason
FROM (SELECT x.*, s.feature, s.value, 'Risk score ' || CAST(risk_score AS VARCHAR) || '/100 — flagged as ' || replace(attack_type, '_', ' ') || '.' AS p
  FROM explained x JOIN signal_rank s ON s.event_id = x.event_id AND s.r = 1) e""")

_block("alerts", ["reasons"], """
SELECT 'al_' || event_id AS id, *, label AS true_label, us + 60000000 AS created_us FROM reasons
WHERE risk_score >= 40 OR attack_type <> 'normal'""")

_block("feedback", ["alerts"], """
SELECT 2 * n AS id, id AS alert_id, CASE WHEN n % 2 = 0 THEN 'confirm' ELSE 'dismiss' END AS action,
  CASE WHEN n % 5 = 0 THEN 'reviewed ' || event_id END AS note, us + 3600000000 AS made_us FROM alerts WHERE n % 3 = 0
UNION ALL SELECT 2 * n + 1, id, 'note', CASE WHEN n % 8 = 0 THEN '' ELSE 'note ' || user_id END, us + 7200000000
FROM alerts WHERE n % 4 = 0""")

_block("status", ["alerts", "feedback"], """
SELECT a.*, CASE f.v WHEN 'confirm' THEN 'confirmed' WHEN 'dismiss' THEN 'dismissed' ELSE 'open' END AS status,
  f.latest_note, coalesce(f.n_feedback, 0) AS n_feedback
FROM alerts a LEFT JOIN (SELECT alert_id, arg_max(action, {'u': made_us, 'i': id}) FILTER (WHERE action IN ('confirm','dismiss')) AS v,
    arg_max(note, {'u': made_us, 'i': id}) FILTER (WHERE note <> '') AS latest_note, count(*) AS n_feedback
  FROM feedback GROUP BY alert_id) f ON f.alert_id = a.id""")


def sql(body: str, *needs: str) -> str:
    """WITH clause of the needed blocks, in order, before the body."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for dep in BLOCKS[name][0]:
                visit(dep)
            order.append(name)

    for n in needs:
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({BLOCKS[n][1]})" for n in order) + "\n" + body


def r6(col: str, name: str | None = None) -> str:
    return f"round(CAST({col} AS DOUBLE), 6) AS {name or col}"


def i64(col: str, name: str | None = None) -> str:
    return f"CAST({col} AS BIGINT) AS {name or col}"


def ts_text(col: str, name: str | None = None) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S.%f') AS {name or col}"
