"""DuckDB oracle statements for the catalogue, config, name and job queries."""

from __future__ import annotations

import json

from convspark.functions.names import UNSAFE_RUN
from convspark.operators.config import DEFAULT_CONFIG
from convspark.plans.oracle import F_TRAIN, js_trim, strip

ORACLE: dict[str, str] = {}

FILES = """
files AS (
  SELECT CASE WHEN doc_id % 20 % 2 = 0 THEN 'models' ELSE 'var' END AS source, source || '-' || (doc_id // 200) AS name,
         CASE WHEN doc_id % 7 = 0 THEN 'config.json' ELSE 'f' || doc_id || '.bin' END AS rel, n_chars AS size
  FROM documents
),
cat AS (
  SELECT source, name, source || '/' || name AS path, sum(size) / 1048576.0 AS size_mb
  FROM files GROUP BY source, name HAVING bool_or(rel = 'config.json')
)"""

ORACLE["a3_catalog_sizes"] = f"""WITH {FILES}
SELECT source, name, path, round(size_mb, 6) AS size_mb FROM cat"""

ORACLE["s1_union_roots"] = f"""WITH {FILES}
SELECT source, name, count(*) AS n_files, sum(size)::BIGINT AS bytes FROM files GROUP BY source, name"""

ORACLE["o5_auto_select"] = f"""WITH {FILES}
SELECT arg_min(path, (source <> 'models', name)) AS path, count(*) AS n_models FROM cat"""

ORACLE["a5_fleet_counts"] = f"""WITH {FILES}
SELECT count(*) AS n_models, count(*) FILTER (WHERE source = 'models') AS n_models_dir,
  count(*) FILTER (WHERE source = 'var') AS n_var_dir,
  (SELECT count(*) FROM (SELECT user_id, event_id % 8 FROM events GROUP BY ALL
                         HAVING count(*) FILTER (WHERE event_type = 'error') = 0)) AS n_sessions
FROM cat"""

ORACLE["a6_count_parameters"] = """SELECT sum(p_size::BIGINT * 64)::BIGINT AS n_params,
  sum(p_size::BIGINT * 64) / 1e9 AS params_b FROM part"""

ORACLE["j5_match_model"] = f"""WITH {FILES},
refs AS (
  SELECT doc_id, CASE doc_id % 3
      WHEN 0 THEN (CASE WHEN doc_id % 20 % 2 = 0 THEN 'models' ELSE 'var' END) || '/' || source
      WHEN 1 THEN 'elsewhere/' || source || '/'
      ELSE 'x/nomodel' || doc_id END AS ref
  FROM documents),
r AS (SELECT *, list_filter(string_split(ref, '/'), lambda x: x <> '')[-1] AS base FROM refs),
byname AS (SELECT name, arg_min(path, (source <> 'models', name, path)) AS p FROM cat GROUP BY name)
SELECT r.doc_id, r.ref, coalesce(c.path, b.p) AS match,
  CASE WHEN c.path IS NOT NULL THEN 'path' WHEN b.p IS NOT NULL THEN 'name' END AS match_kind
FROM r LEFT JOIN cat c ON c.path = r.ref LEFT JOIN byname b ON b.name = r.base"""


def san_py(x: str) -> str:
    seed = f"coalesce(nullif({strip(x)}, ''), 'snapshot_0')"
    cleaned = f"trim(regexp_replace({seed}, '{UNSAFE_RUN}', '-', 'g'), '-.')"
    return f"coalesce(nullif({cleaned}, ''), 'snapshot_0')"


def san_js(x: str) -> str:
    raw = js_trim(x)
    cleaned = f"regexp_replace(regexp_replace({raw}, '{UNSAFE_RUN}', '-', 'g'), '^-+|-+$', '', 'g')"
    return f"CASE WHEN {raw} = '' THEN '' ELSE coalesce(nullif({cleaned}, ''), 'model') END"


NAMES = """
n0 AS (SELECT p_partkey AS id, '  ' || p_name || ' / ' || p_type || '-' AS raw, p_retailprice FROM part)"""

ORACLE["p13_sanitize_names"] = f"""WITH {NAMES}
SELECT id, {san_py('raw')} AS py_name,
  coalesce(nullif(trim(regexp_replace(raw, '{UNSAFE_RUN}', '-', 'g'), '-.'), ''),
    substr(md5(raw),1,8)||'-'||substr(md5(raw),9,4)||'-'||substr(md5(raw),13,4)||'-'||substr(md5(raw),17,4)
    ||'-'||substr(md5(raw),21,12)) AS rid_name,
  {san_js('raw')} AS js_name
FROM n0"""


def unique_sql(name_expr: str, existing_expr: str, ci: bool) -> str:
    key = (lambda c: f"lower({c})") if ci else (lambda c: c)
    return f"""WITH {NAMES},
n AS (SELECT id, {name_expr} AS name, p_retailprice FROM n0),
ex AS (SELECT DISTINCT {key(existing_expr)} AS ename FROM n WHERE p_retailprice > 1900),
req AS (SELECT id AS req_id, name, {key('name')} AS bk,
          row_number() OVER (PARTITION BY {key('name')} ORDER BY id) AS slot FROM n),
pb AS (SELECT bk, count(*) AS m FROM req GROUP BY bk),
ec AS (SELECT pb.bk, count(ex.ename) AS e FROM pb LEFT JOIN ex
         ON ex.ename = pb.bk OR regexp_replace(ex.ename, '_[0-9]+$', '') = pb.bk GROUP BY pb.bk),
slots AS (SELECT bk, unnest(range(0, m + e + 1)) AS k FROM pb JOIN ec USING (bk)),
cand AS (SELECT bk, k, CASE WHEN k = 0 THEN bk ELSE bk || '_' || k END AS c FROM slots),
free AS (SELECT bk, k, row_number() OVER (PARTITION BY bk ORDER BY k) AS slot FROM cand
         WHERE c NOT IN (SELECT ename FROM ex)),
asg AS (SELECT r.req_id, r.name, CASE WHEN f.k = 0 THEN r.name ELSE r.name || '_' || f.k END AS assigned
        FROM req r JOIN free f ON f.bk = r.bk AND f.slot = r.slot)
SELECT req_id, name, assigned FROM asg"""


ORACLE["j6_unique_names"] = unique_sql(san_py("raw"), "name", False)
ORACLE["j6_unique_names_js"] = unique_sql(san_js("raw"), "upper(name)", True)

URL_HEAD = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*"

ORACLE["p14_repo_model_name"] = f"""WITH u AS (
  SELECT page_id AS id, CASE page_id % 4 WHEN 0 THEN url
      WHEN 1 THEN regexp_replace(url, '^https?://[^/]+/', '') WHEN 2 THEN url || '/'
      ELSE ' ' || url || ' ' END AS url FROM pages),
s AS (SELECT id, {js_trim('url')} AS s FROM u),
p AS (SELECT id, CASE WHEN regexp_matches(s, '{URL_HEAD}') THEN regexp_extract(s, '{URL_HEAD}([^?#]*)', 1)
                 ELSE s END AS path FROM s)
SELECT id, coalesce(list_filter(string_split(path, '/'), lambda x: x <> '')[-1], '') AS model_name FROM p"""

HOSTS = """
hk AS (SELECT event_id, user_id, ts, json_extract(props, '$.k')::BIGINT AS k FROM events),
hn AS (SELECT event_id, user_id, ts, CASE k % 4 WHEN 0 THEN 'ws://h' || k || ':8765'
            WHEN 1 THEN 'ws://h' || k WHEN 2 THEN 'wss://h' || k ELSE 'ws://h' || k END AS uri FROM hk)"""

ORACLE["p15_normalize_hosts"] = f"""WITH {HOSTS}
SELECT event_id, uri, regexp_extract(uri, '^wss?://([^/?#]*)', 1) AS display FROM hn"""

ORACLE["o4_recent_distinct"] = f"""WITH {HOSTS},
u AS (SELECT user_id, ts, regexp_replace(uri, '^ws://', '') AS host FROM hn),
l AS (SELECT user_id, host, max(ts) AS last_used FROM u GROUP BY user_id, host),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_used DESC, host) AS pos FROM l)
SELECT user_id, host, pos::INTEGER AS pos FROM r WHERE pos <= 12"""

CONFIG = """
cfgu AS (
  SELECT user_id AS session_id,
    CASE event_type WHEN 'signup' THEN 'max_new_tokens' WHEN 'view' THEN 'temperature' WHEN 'click' THEN 'top_p'
                    WHEN 'purchase' THEN 'top_k' WHEN 'error' THEN 'repetition_penalty' END AS key,
    floor(value)::BIGINT::VARCHAR || CASE WHEN event_type IN ('view', 'click', 'error') THEN '.5' ELSE '' END AS value,
    event_id AS seq
  FROM events
)"""

_GEN = ", ".join(f"('{k}', '{json.dumps(v)}')" for k, v in DEFAULT_CONFIG["generation_defaults"].items())

ORACLE["j3_merge_config"] = f"""WITH {CONFIG},
defs(key, value) AS (VALUES {_GEN}),
allx AS (
  SELECT s.session_id, d.key, d.value, 0 AS layer, -1::BIGINT AS seq
  FROM (SELECT DISTINCT session_id FROM cfgu) s CROSS JOIN defs d
  UNION ALL SELECT session_id, key, value, 1, seq FROM cfgu)
SELECT session_id, key, max_by(value, (layer, seq)) AS value FROM allx GROUP BY session_id, key"""

_PAIRS = [(s, k) for s, kv in DEFAULT_CONFIG.items() for k in kv]
_PAIRS_SQL = ", ".join(f"({i}, '{s}', '{k}')" for i, (s, k) in enumerate(_PAIRS))
_DEFS_SQL = ", ".join(f"('{s}', '{k}', '{json.dumps(v)}')" for s, kv in DEFAULT_CONFIG.items() for k, v in kv.items())

ORACLE["j4_fill_defaults"] = f"""WITH pairs(i, section, key) AS (VALUES {_PAIRS_SQL}),
defs(section, key, value) AS (VALUES {_DEFS_SQL}),
c0 AS (
  SELECT c_nationkey::BIGINT AS file_id, c_custkey,
    CASE WHEN c_custkey % 31 = 0 THEN 'extra' ELSE p.section END AS section,
    CASE WHEN c_custkey % 31 = 0 THEN 'note' ELSE p.key END AS key,
    round(c_acctbal * 100)::BIGINT::VARCHAR AS value
  FROM customer JOIN pairs p ON p.i = c_custkey % {len(_PAIRS)}),
conf AS (SELECT file_id, section, key, max_by(value, c_custkey) AS value FROM c0 GROUP BY ALL),
d AS (SELECT f.file_id, defs.* FROM (SELECT DISTINCT file_id FROM conf) f CROSS JOIN defs)
SELECT coalesce(d.file_id, conf.file_id) AS file_id, coalesce(d.section, conf.section) AS section,
  coalesce(d.key, conf.key) AS key, coalesce(conf.value, d.value) AS value,
  CASE WHEN conf.value IS NOT NULL AND d.value IS NOT NULL THEN 'file' WHEN conf.value IS NOT NULL THEN 'extra'
       ELSE 'default' END AS origin
FROM d FULL OUTER JOIN conf ON conf.file_id = d.file_id AND conf.section = d.section AND conf.key = d.key"""

ORACLE["a9_config_pivot"] = f"""WITH {CONFIG}
SELECT session_id,
  max_by(value::DOUBLE, seq) FILTER (WHERE key = 'max_new_tokens') AS max_new_tokens,
  max_by(value::DOUBLE, seq) FILTER (WHERE key = 'temperature') AS temperature,
  max_by(value::DOUBLE, seq) FILTER (WHERE key = 'top_p') AS top_p,
  max_by(value::DOUBLE, seq) FILTER (WHERE key = 'top_k') AS top_k,
  max_by(value::DOUBLE, seq) FILTER (WHERE key = 'repetition_penalty') AS repetition_penalty,
  CASE WHEN count(*) FILTER (WHERE key = 'temperature') > 0 THEN 'float' END AS temperature_kind,
  CASE WHEN count(*) FILTER (WHERE key = 'top_k') > 0 THEN 'int' END AS top_k_kind,
  CASE WHEN count(*) FILTER (WHERE seq % 4 = 1) > 0 THEN 'bool' END AS do_sample_kind,
  max_by(seq % 8 = 1, seq) FILTER (WHERE seq % 4 = 1) AS do_sample,
  CASE WHEN count(*) FILTER (WHERE seq % 4 = 2) > 0 THEN 'str' END AS note_kind,
  'v' || max(seq) FILTER (WHERE seq % 4 = 2) AS note
FROM cfgu GROUP BY session_id"""

ORACLE["a7_job_status"] = f"""WITH {F_TRAIN}
SELECT request_id,
  count(*) FILTER (WHERE type IN ('train_done', 'error')) = 0 AS running,
  (max(ts) FILTER (WHERE type = 'train_started'))::VARCHAR AS started_at, max(max_steps) AS max_steps, max(checkpoint) AS checkpoint,
  (CASE WHEN max_by(type, n) = 'train_done' THEN max_by(step, n) FILTER (WHERE type = 'train_done')
        ELSE coalesce(max_by(step, n) FILTER (WHERE type = 'train_progress'), 0) END)::BIGINT AS steps_done,
  max_by(loss, n) FILTER (WHERE type = 'train_progress') AS last_loss,
  CASE WHEN max_by(type, n) = 'error' THEN 'Training failed: step ' || max_by(step, n) END AS error
FROM ftrain GROUP BY request_id"""

ORACLE["j7_blocked_requests"] = """WITH jobs AS (
  SELECT ts AS start, ts + to_minutes(floor(value)::BIGINT) AS "end" FROM events
  WHERE event_type = 'purchase' AND value > 300),
req AS (SELECT event_id AS req_id, ts, CASE WHEN event_type = 'click' THEN 'inference' ELSE 'train' END AS kind
        FROM events WHERE event_type IN ('click', 'signup')),
f AS (SELECT r.*, EXISTS (SELECT 1 FROM jobs j WHERE r.ts >= j.start AND r.ts < j."end") AS blocked FROM req r)
SELECT req_id, kind, blocked,
  CASE WHEN blocked AND kind = 'inference' THEN 'rejected' WHEN blocked THEN 'waiting' ELSE 'run' END AS outcome
FROM f"""

_LAST = ",\n  ".join(
    f"last_value(CASE WHEN kind = 'update' AND key = '{k}' THEN value END IGNORE NULLS) OVER w AS u_{k}"
    for k in DEFAULT_CONFIG["generation_defaults"])
_EFF = ",\n  ".join(
    f"coalesce(CASE WHEN key = '{k}' THEN value END, u_{k}, '{json.dumps(v)}') AS {k}"
    for k, v in DEFAULT_CONFIG["generation_defaults"].items())

_NOTES = ",\n  ".join(
    f"last_value(CASE WHEN kind = 'update' AND seq % 10 = 3 AND seq % 3 = {i} THEN 'n' || value END IGNORE NULLS) OVER w AS note_{i}"
    for i in range(3))

ORACLE["j3_request_config"] = f"""WITH {CONFIG},
ev AS (SELECT c.*, CASE WHEN e.event_type = 'click' THEN 'request' ELSE 'update' END AS kind
       FROM cfgu c JOIN events e ON e.event_id = c.seq),
r AS (SELECT *, {_LAST}, {_NOTES}
      FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT session_id, seq, {_EFF},
  concat_ws(';', 'note_0=' || note_0, 'note_1=' || note_1, 'note_2=' || note_2, CASE WHEN seq % 4 = 0 THEN 'stop=s' || value END) AS extras
FROM r WHERE kind = 'request'"""
