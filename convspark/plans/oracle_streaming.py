"""DuckDB oracle statements for the streaming queries: a stream run to its
end must equal the batch answer."""

from __future__ import annotations

import json

from convspark.operators.config import DEFAULT_CONFIG
from convspark.plans.oracle_catalog import ORACLE as _CAT
from convspark.plans.oracle_frames import ORACLE as _FR

ORACLE: dict[str, str] = {}

ORACLE["x1_stream_frames"] = _FR["p12_route_frames"]
ORACLE["x4_stream_dedupe"] = _FR["x4_dedupe_frames"]
ORACLE["x5_stream_job_status"] = _CAT["a7_job_status"]
ORACLE["x6_stream_transcripts"] = _FR["a1_rebuild_transcripts"]

_DEFS = ", ".join(f"('{k}', '{json.dumps(v)}')" for k, v in DEFAULT_CONFIG["generation_defaults"].items())

CONNS = """conns AS (
  SELECT user_id * 8 + event_id % 8 AS session_id, event_id AS seq,
    CASE event_type WHEN 'signup' THEN 'config' WHEN 'view' THEN 'token' WHEN 'click' THEN 'start'
                    WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'ack' END AS type,
    CASE WHEN event_type = 'signup' THEN floor(value)::BIGINT::VARCHAR END AS cfg_value
  FROM events),
marks AS (SELECT session_id, min(seq) FILTER (WHERE type = 'ack') AS ack, max(seq) FILTER (WHERE type = 'done') AS fl
          FROM conns GROUP BY session_id)"""

SESSIONS = f"""WITH {CONNS},
x AS (SELECT c.*, fl FROM conns c JOIN marks m USING (session_id) WHERE m.ack IS NULL),
upd AS (SELECT session_id, 'max_new_tokens' AS key, max_by(cfg_value, seq) AS v FROM x
        WHERE type = 'config' GROUP BY session_id),
defs(key, value) AS (VALUES {_DEFS}),
conf AS (
  SELECT s.session_id, string_agg(d.key || '=' || coalesce(u.v, d.value), ';' ORDER BY d.key) AS config
  FROM (SELECT DISTINCT session_id FROM x) s CROSS JOIN defs d
  LEFT JOIN upd u ON u.session_id = s.session_id AND u.key = d.key
  GROUP BY s.session_id),
live AS (
  SELECT session_id, min(seq) AS created, max(seq) AS last_activity, count(*) AS n_frames,
    count(*) FILTER (WHERE type = 'config') AS n_config,
    count(*) FILTER (WHERE type IN ('start', 'token', 'done') AND (fl IS NULL OR seq > fl)) AS pending
  FROM x GROUP BY session_id)
SELECT l.*, c.config, false AS closed FROM live l JOIN conf c USING (session_id)
UNION ALL
SELECT session_id, NULL, NULL, 0, 0, 0, NULL, true FROM marks WHERE ack IS NOT NULL"""

ORACLE["x2_stream_session_errors"] = f"""WITH {CONNS}
SELECT session_id, seq, chr(39) || session_id || chr(39) AS message FROM conns JOIN marks USING (session_id) WHERE seq > ack"""

ORACLE["x2_stream_sessions"] = SESSIONS
ORACLE["x2_sessions_batch"] = SESSIONS
