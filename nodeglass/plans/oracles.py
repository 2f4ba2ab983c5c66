"""The test views in DuckDB SQL, put in front of every check query."""

_VIEWS = {
    "logs": """
SELECT event_id AS log_id, user_id AS node_id, 'OPERATIONAL' AS json_status,
  CAST(CASE WHEN event_type = 'error' AND k < 36 THEN 429
            WHEN event_type = 'signup' AND k < 36 THEN 206
            WHEN event_type = 'error' AND k = 99 THEN 503
            WHEN event_type = 'error' AND k = 98 THEN 404
            ELSE 200 END AS INT) AS http_response_code,
  CAST(floor(value + 40 + (user_id * 37) % 130) AS INT) AS response_time_ms,
  CASE WHEN (event_id // 5000) % 2 = 0 AND k % 17 <> 0 THEN value / 600 END AS load_val,
  CASE WHEN (event_id // 5000) % 2 = 1 AND k % 17 <> 0 THEN value / 600 END AS l_v1,
  ts AS ingested_at
FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events) e""",
    "nodes": """
SELECT *, decode(from_base64(regexp_extract(user_agent, '(\\S+)$', 1))) AS serial_number FROM (
  SELECT c_custkey AS node_uuid, concat('Node/2.0 (Linux) ', to_base64(encode(sn))) AS user_agent,
         c_acctbal < 540 AS is_infected
  FROM (SELECT *, concat('SN-', CAST(1000 + c_custkey
          - CASE WHEN c_custkey % 50 = 49 THEN 1 ELSE 0 END AS VARCHAR)) AS sn FROM customer) c) r""",
    "anomalies": """
SELECT node_id, log_id, round((200 - response_time_ms) / CAST(1000 AS DOUBLE), 6) AS anomaly_score,
       'IsolationForest' AS detector, ingested_at AS detected_at
FROM logs WHERE response_time_ms > 200 AND http_response_code <> 200""",
    "config": """
SELECT CAST(w + 1 AS INT) AS version, w * 5000 AS time_start,
       CASE WHEN w % 2 = 0 THEN 'load_val' ELSE 'L_V1' END AS active_column
FROM (SELECT DISTINCT event_id // 5000 AS w FROM events) x""",
    "top": "SELECT max(log_id) AS max_id FROM logs",
    # Strict load of the layout that is live at each log.
    "loaded": """
SELECT *, CASE WHEN (log_id // 5000) % 2 = 1 THEN l_v1 ELSE load_val END AS effective_load FROM logs""",
    "risk": """
SELECT s.node_id AS node_uuid, coalesce(n.serial_number, 'UNKNOWN') AS serial_number,
       round(avg_rt, 2) AS avg_response_time_ms, max_rt AS max_response_time_ms,
       round(p95_rt, 2) AS p95_response_time_ms, log_count,
       coalesce(hits, 0) AS anomaly_hit_count,
       CASE WHEN avg_rt > 200 OR coalesce(hits, 0) >= 10 THEN 'CRITICAL'
            WHEN avg_rt > 150 OR coalesce(hits, 0) >= 5 THEN 'HIGH'
            WHEN avg_rt > 120 OR coalesce(hits, 0) >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
FROM (SELECT node_id, avg(response_time_ms) AS avg_rt, max(response_time_ms) AS max_rt,
             quantile_cont(response_time_ms, 0.95) AS p95_rt, count(*) AS log_count
      FROM logs, top WHERE log_id >= greatest(0, max_id - 5000) GROUP BY node_id) s
LEFT JOIN (SELECT node_id, count(*) AS hits FROM anomalies, top
           WHERE log_id >= greatest(0, max_id - 5000) GROUP BY node_id) h USING (node_id)
LEFT JOIN nodes n ON n.node_uuid = s.node_id""",
    "heat": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY risk_level
                 ORDER BY avg_response_time_ms DESC, node_uuid) AS rn FROM risk) r
WHERE rn <= CASE risk_level WHEN 'CRITICAL' THEN 15 WHEN 'MEDIUM' THEN 5 WHEN 'LOW' THEN 5 ELSE 0 END""",
    "latest": """
SELECT node_id, log_id, http_response_code, json_status, response_time_ms, load_val, l_v1 FROM logs
WHERE log_id IN (SELECT max(log_id) FROM logs GROUP BY node_id)""",
    "flagged": """
SELECT DISTINCT node_id FROM anomalies, top WHERE log_id >= (max_id // 5000) * 5000""",
    "clones": """
SELECT serial_number, count(*) AS clone_count, sum(CAST(is_infected AS BIGINT)) AS infected_count,
       string_agg(CAST(node_uuid AS VARCHAR), ',' ORDER BY node_uuid) AS node_uuids
FROM nodes GROUP BY serial_number HAVING count(*) > 1""",
    # Registry label joined to per-node aggregates; missing loads count as the node's median.
    "features": """
SELECT s.*, is_infected FROM (
  SELECT node_id, avg(response_time_ms) AS avg_response_time_ms,
         max(response_time_ms) AS max_response_time_ms,
         quantile_cont(response_time_ms, 0.95) AS p95_response_time_ms,
         avg(CASE WHEN http_response_code = 429 THEN 1.0 ELSE 0.0 END) AS throttled_ratio,
         avg(CASE WHEN http_response_code = 206 THEN 1.0 ELSE 0.0 END) AS partial_ratio,
         avg(coalesce(effective_load, med)) AS avg_load, count(*) AS log_count
  FROM loaded JOIN (SELECT node_id, median(effective_load) AS med FROM loaded GROUP BY node_id) m USING (node_id)
  GROUP BY node_id) s JOIN nodes ON node_uuid = node_id""",
    "log_features": """
SELECT log_id, node_id, CAST(response_time_ms AS DOUBLE) AS response_time_ms,
       CAST(http_response_code AS DOUBLE) AS http_response_code,
       coalesce(effective_load, (SELECT median(effective_load) FROM loaded)) AS effective_load,
       CASE WHEN http_response_code = 429 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_throttled,
       CASE WHEN http_response_code = 206 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_partial
FROM loaded""",
    # Rule alerts.
    "throttling": """
SELECT node_id, sum(CASE WHEN http_response_code = 429 THEN 1 ELSE 0 END)::BIGINT AS throttled
FROM logs, top WHERE log_id >= (max_id // 5000) * 5000 GROUP BY node_id""",
    "alerts": """
SELECT 'DDOS' AS rule, node_id, CAST(NULL AS BIGINT) AS log_id, 'CRITICAL' AS severity,
       concat('throttled=', throttled::VARCHAR) AS evidence
FROM throttling WHERE throttled > 5 * (SELECT avg(throttled) FROM throttling)
UNION ALL SELECT 'INFECTED_NODE', node_id, NULL, 'CRITICAL', concat('log_count=', count(*)::VARCHAR)
FROM logs JOIN nodes ON node_uuid = node_id WHERE is_infected GROUP BY node_id
UNION ALL SELECT 'LATENCY', node_id, log_id, 'MEDIUM', concat('response_time_ms=', response_time_ms::VARCHAR)
FROM logs WHERE response_time_ms > 200
UNION ALL SELECT 'STATUS_MISMATCH', node_id, log_id, 'HIGH', concat('http_response_code=', http_response_code::VARCHAR)
FROM logs WHERE json_status = 'OPERATIONAL' AND http_response_code <> 200""",
}


def with_views(body):
    """Prefix a check query with the views; it may start with its own WITH."""
    views = ", ".join(f"{name} AS ({sql})" for name, sql in _VIEWS.items())
    body = body.strip()
    own = body[:5].upper() == "WITH "
    return f"WITH {views}, {body[5:]}" if own else f"WITH {views} {body}"
