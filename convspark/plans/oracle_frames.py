"""DuckDB oracle statements for the frame-log, chunk and codec queries."""

from __future__ import annotations

from convspark.operators.chunks import CHUNK_RE, CHUNK_TAIL_RE

ORACLE: dict[str, str] = {}

KEY_LIST = "[114, 101, 108, 97, 121]"  # ASCII bytes of the queries' log key, "relay"


def enc(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR {x} = '' THEN '' ELSE to_base64(unhex(array_to_string(list_transform("
            f"range(0, octet_length(encode({x}))), lambda i: lpad(upper(printf('%x', xor(('0x' || "
            f"substr(hex(encode({x})), 2*i+1, 2))::INTEGER, {KEY_LIST}[i % 5 + 1]))), 2, '0')), ''))) END")


PAIRS = """
pairs AS (
  SELECT u.conv_id, a.turn, u.text AS utext, a.text AS atext
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'
)"""

FRAMES = PAIRS + f""",
ch AS (
  SELECT conv_id, turn, regexp_extract_all(atext, '{CHUNK_TAIL_RE}') AS chunks,
         len(regexp_extract_all(utext, '[^ \\n\\t]+'))::INTEGER AS tin,
         len(regexp_extract_all(atext, '[^ \\n\\t]+'))::INTEGER AS tout,
         conv_id % 5 = 3 AND turn >= 3 AS err
  FROM pairs
),
frames AS (
  SELECT conv_id AS session_id, (turn << 20)::BIGINT AS seq, 'start' AS type, NULL::VARCHAR AS data,
         tin AS tokens_in, NULL::INTEGER AS total_tokens, NULL::VARCHAR AS message FROM ch
  UNION ALL
  SELECT conv_id, ((turn << 20) + k)::BIGINT, 'token', chunk, NULL, NULL, NULL
  FROM (SELECT conv_id, turn, unnest(chunks) AS chunk, generate_subscripts(chunks, 1) AS k FROM ch)
  UNION ALL
  SELECT conv_id, ((turn << 20) + len(chunks) + 1)::BIGINT, CASE WHEN err THEN 'error' ELSE 'done' END, NULL,
         NULL, CASE WHEN NOT err THEN tout END, CASE WHEN err THEN 'generation failed' END FROM ch
  UNION ALL
  SELECT conv_id, ((turn << 20) + len(chunks) + 2)::BIGINT, 'ack', NULL, NULL, NULL, NULL FROM ch
  WHERE conv_id % 4 = 0 AND turn = 3
  UNION ALL
  SELECT conv_id, ((turn << 20) + len(chunks) + 3)::BIGINT, 'pong', NULL, NULL, NULL, NULL FROM ch
  WHERE conv_id % 3 = 0
)"""

SEGMENTED = FRAMES + """,
seg0 AS (
  SELECT *,
    max(CASE WHEN type = 'start' THEN seq END) OVER (PARTITION BY session_id ORDER BY seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ls,
    sum(CASE WHEN type = 'start' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cnt,
    max(CASE WHEN type IN ('done', 'error') THEN seq END) OVER (PARTITION BY session_id ORDER BY seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS le
  FROM frames
),
seg AS (
  SELECT *, CASE WHEN ls IS NOT NULL AND (le IS NULL OR le < ls) THEN cnt END::BIGINT AS gen FROM seg0
)"""

ORACLE["t4_chunk_text"] = f"""WITH {PAIRS},
c AS (SELECT conv_id, turn, regexp_extract_all(atext || CASE WHEN conv_id % 2 = 0 THEN ' tail' || conv_id ELSE '' END, '{CHUNK_TAIL_RE}') AS chunks
      FROM pairs)
SELECT conv_id AS session_id, turn, k::INTEGER AS k, chunk
FROM (SELECT conv_id, turn, unnest(chunks) AS chunk, generate_subscripts(chunks, 1) AS k FROM c)"""

ORACLE["t4_chunk_text_budget"] = f"""WITH {PAIRS},
c AS (SELECT conv_id, turn, regexp_extract_all(atext || CASE WHEN conv_id % 2 = 0 THEN ' tail' || conv_id ELSE '' END, '{CHUNK_RE}') AS chunks
      FROM pairs)
SELECT conv_id AS session_id, turn, k::INTEGER AS k, chunk
FROM (SELECT conv_id, turn, unnest(chunks) AS chunk, generate_subscripts(chunks, 1) AS k FROM c)"""

ORACLE["t5_stitch_overlaps"] = """WITH w0 AS (
  SELECT doc_id, unnest(range(0, (floor((length(text) - 1) / 150))::INTEGER + 1)) AS i, text FROM documents),
w AS (
  SELECT doc_id, i::INTEGER AS i,
    CASE WHEN i = 0 THEN '' ELSE substr(text, ((i - 1) * 150 + 1)::INTEGER, 200) END AS sent,
    substr(text, (i * 150 + 1)::INTEGER, 200) AS win FROM w0),
t AS (SELECT *, substr(sent, greatest(length(sent) - 100 + 1, 1)::INTEGER) AS tail FROM w)
SELECT doc_id, i,
  coalesce(list_max([n for n in range(1, least(length(tail), length(win)) + 1)
                     if ends_with(tail, left(win, n::INTEGER))]), 0)::INTEGER AS overlap
FROM t"""

ORACLE["t6_encode_log"] = f"""WITH {FRAMES}
SELECT session_id, seq, {enc('data')} AS encoded FROM frames WHERE type = 'token'"""

ORACLE["t6_decode_log"] = f"""WITH {FRAMES}
SELECT session_id, seq, data AS decoded FROM frames WHERE type = 'token'
UNION ALL
SELECT -1::BIGINT, item_id, '' FROM benchmark"""

ORACLE["w1_segment_generations"] = f"""WITH {SEGMENTED}
SELECT session_id, seq, type, gen FROM seg"""

_OUTCOME = ("max_by(CASE WHEN type IN ('done','error') THEN type END, "
            "CASE WHEN type IN ('done','error') THEN seq END)")

ORACLE["a1_rebuild_transcripts"] = f"""WITH {SEGMENTED}
SELECT session_id, gen,
  coalesce(string_agg(CASE WHEN type = 'token' THEN data END, '' ORDER BY seq), '') AS text,
  coalesce({_OUTCOME}, 'open') AS outcome
FROM seg WHERE gen IS NOT NULL GROUP BY session_id, gen"""

ORACLE["a1_rebuild_transcripts_js"] = f"""WITH {SEGMENTED},
g AS (
SELECT session_id, gen,
  coalesce(string_agg(CASE WHEN type = 'token' THEN data END, '' ORDER BY seq), '') AS text,
  {_OUTCOME} AS outcome,
  max_by(CASE WHEN type = 'error' THEN message END, CASE WHEN type = 'error' THEN seq END) AS msg
FROM seg WHERE gen IS NOT NULL GROUP BY session_id, gen)
SELECT session_id, gen,
  CASE WHEN outcome = 'error' THEN text || chr(10) || '[error] ' || coalesce(msg, 'unknown error') ELSE text END AS text,
  coalesce(outcome, 'open') AS outcome
FROM g"""

ORACLE["a2_generation_stats"] = f"""WITH {SEGMENTED}
SELECT session_id, gen,
  max(CASE WHEN type = 'start' THEN tokens_in END) AS tokens_in,
  count(*) FILTER (WHERE type = 'token') AS token_frames,
  sum(CASE WHEN type = 'token' THEN length(data) END)::BIGINT AS chars,
  max(CASE WHEN type = 'done' THEN total_tokens END) AS total_tokens,
  coalesce({_OUTCOME}, 'open') AS outcome
FROM seg WHERE gen IS NOT NULL GROUP BY session_id, gen"""

ORACLE["p12_route_frames"] = """SELECT user_id AS session_id, event_id AS seq,
  CASE WHEN event_type IN ('signup', 'view', 'click') THEN 'dispatch'
       WHEN event_type = 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'dispatch' WHEN 1 THEN 'ignored'
                                         ELSE 'dead_letter' END
       ELSE 'dead_letter' END AS route,
  CASE WHEN event_type = 'signup' THEN 'config' WHEN event_type = 'view' THEN 'ping'
       WHEN event_type = 'click' THEN 'inference'
       WHEN event_type = 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'get_status' WHEN 1 THEN 'teleport' END
  END AS msg_type,
  CASE WHEN event_type = 'error' THEN 'Invalid JSON'
       WHEN event_type = 'purchase' AND event_id % 3 = 2 THEN '''list'' object has no attribute ''get''' END AS error
FROM events"""

PROTO = """
proto AS (
  SELECT user_id AS session_id, event_id AS seq,
    CASE event_type WHEN 'signup' THEN 'config' WHEN 'view' THEN 'token' WHEN 'click' THEN 'start'
                    WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'ack' END AS type,
    sha256(concat_ws(':', user_id, event_id)) AS id
  FROM events
),
marks AS (
  SELECT session_id, max(CASE WHEN type = 'ack' THEN seq END) AS last_ack,
         max(CASE WHEN type = 'done' THEN seq END) AS last_flush
  FROM proto GROUP BY session_id
),
replayed AS (
  SELECT p.* FROM proto p JOIN marks m USING (session_id)
  WHERE p.type IN ('start', 'token', 'done') AND p.seq > coalesce(m.last_ack, -1) AND p.seq <= m.last_flush
)"""

ORACLE["x3_replay"] = f"""WITH {PROTO},
p AS (SELECT *, type = 'token' AND seq % 7 = 0 AS err FROM proto)
SELECT p.session_id, seq, CASE WHEN err THEN 'error' ELSE type END AS type, CASE WHEN err THEN 'job-' || seq END AS request_id
FROM p JOIN marks m USING (session_id)
WHERE type IN ('start', 'token', 'done') AND NOT (err AND seq % 2 = 1) AND seq > coalesce(last_ack, -1) AND seq <= last_flush"""

ORACLE["x4_dedupe_frames"] = f"""WITH {PROTO}
SELECT DISTINCT id, session_id, seq, type FROM (
  SELECT id, session_id, seq, type FROM proto WHERE type IN ('start', 'token', 'done')
  UNION ALL SELECT id, session_id, seq, type FROM replayed)"""

ORACLE["j1_resolve_sessions"] = """WITH live AS (SELECT DISTINCT user_id AS sid FROM events WHERE event_type = 'signup'),
h AS (SELECT event_id AS hello_id, user_id,
        CASE WHEN event_id % 3 = 1 THEN user_id WHEN event_id % 3 = 2 THEN user_id + 1000 END AS requested
      FROM events WHERE event_type = 'click')
SELECT h.hello_id, h.user_id, h.requested,
  CASE WHEN l.sid IS NOT NULL THEN 'resume' ELSE 'new' END AS outcome,
  CASE WHEN l.sid IS NOT NULL THEN l.sid::VARCHAR ELSE 'new-' || h.hello_id END AS session_id
FROM h LEFT JOIN live l ON l.sid = h.requested"""

ORACLE["x7_purge_sessions"] = """SELECT event_id AS session_id, user_id FROM events
WHERE event_type = 'signup'
  AND coalesce(ts >= (SELECT max(ts) FROM events WHERE event_type = 'purchase' AND value > 360), true)"""

ORACLE["t5_stitch_overlaps_eos"] = ORACLE["t5_stitch_overlaps"].replace("length(sent) - 100 + 1", "length(sent) - 50 + 1")
