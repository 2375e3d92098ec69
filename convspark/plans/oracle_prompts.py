"""DuckDB oracle statements for the prompt, image and context queries."""

from __future__ import annotations

from convspark.operators.prompts import DATA_URL_RE, DESCRIBE_IMAGES
from convspark.plans.oracle import strip

ORACLE: dict[str, str] = {}

BLOCK_RE = r"(?is)\[IMAGE FILE:[^\]]*\](.*?)\[/IMAGE FILE\]"
SF001 = "/root/testdata/sf0.01"  # the oracle runs on the sf0.01 tables


def b64dec(x: str) -> str:
    t = f"regexp_replace({x}, '[^A-Za-z0-9+/=]', '', 'g')"
    return (f"CASE WHEN regexp_full_match({t}, '[A-Za-z0-9+/]*={{0,2}}') AND length({t}) % 4 = 0 "
            f"THEN from_base64({t}) END")


def data_url_bytes(x: str) -> str:
    return f"CASE WHEN instr({x}, ',') > 0 THEN {b64dec(f'substr({x}, instr({x}, {chr(39)},{chr(39)}) + 1)')} END"


PROMPTS = """
pr AS (
  SELECT conv_id AS prompt_id,
    max_by(text, turn) FILTER (WHERE role = 'system') AS system,
    min_by(text, turn) FILTER (WHERE role = 'user') AS user
  FROM conversations GROUP BY conv_id
)"""

NORM = PROMPTS + f""",
norm AS (
  SELECT prompt_id,
    CASE WHEN prompt_id % 2 = 0 THEN coalesce({strip('system')}, '') ELSE coalesce(system, '') END AS system,
    CASE WHEN prompt_id % 2 = 0 THEN coalesce({strip('user')}, '') ELSE coalesce(user, '') END AS user
  FROM pr
),
clean AS (
  SELECT prompt_id, system,
    CASE WHEN user = '' THEN user ELSE {strip(f"regexp_replace(user, '{BLOCK_RE}', '', 'g')")} END AS user_clean
  FROM norm
)"""

ORACLE["p5_parse_tagged_prompt"] = f"""WITH {PROMPTS}
SELECT prompt_id,
  CASE WHEN prompt_id % 2 = 0 THEN coalesce({strip('system')}, '') ELSE '' END AS system,
  CASE WHEN prompt_id % 2 = 0 THEN coalesce({strip('user')}, '') ELSE '' END AS user
FROM pr"""

ORACLE["p6_normalize_prompts"] = f"""WITH {NORM}
SELECT prompt_id, system, user FROM norm"""

ORACLE["p7_render_instruct"] = f"""WITH {NORM}
SELECT prompt_id, '[INST]' || CASE WHEN length(system) > 0 THEN '<<SYS>>' || chr(10) || system || chr(10)
  || '<</SYS>>' || chr(10) || chr(10) ELSE '' END || user_clean || '[/INST]' AS rendered FROM clean"""

ORACLE["p8_build_chat_messages"] = f"""WITH {NORM}
SELECT prompt_id,
  '[' || CASE WHEN length(system) > 0 THEN '{{"role":"system","content":[{{"type":"text","text":' || to_json(system)
      || '}}]}},' ELSE '' END
  || '{{"role":"user","content":[{{"type":"text","text":'
  || to_json(CASE WHEN length(user_clean) > 0 THEN user_clean ELSE '{DESCRIBE_IMAGES}' END) || '}}'
  || repeat(',{{"type":"image"}}', (prompt_id % 3)::INTEGER) || ']}}]' AS messages
FROM clean"""

IMAGES = f"""
img AS (
  SELECT conv_id * 1024 + turn AS prompt_id, conv_id, turn,
    text || CASE WHEN turn % 3 = 0 THEN ' [IMAGE FILE: a.png]data:image/png;base64,'
                 || to_base64(encode(role || turn::VARCHAR)) || '[/IMAGE FILE]' ELSE '' END
         || CASE WHEN conv_id % 7 = 0 THEN chr(10) || '[image file: b.png] data:image/png;base64,abc [/image file] '
                 ELSE '' END AS user,
    CASE turn % 5
      WHEN 0 THEN '"data:image/png;base64,' || to_base64(encode(text)) || '"'
      WHEN 1 THEN '"' || to_base64(encode(conv_id::VARCHAR)) || '"'
      WHEN 2 THEN '{{"path":"' || CASE WHEN conv_id % 2 = 0 THEN '{SF001}/nation.parquet'
                                       ELSE 'missing/' || conv_id || '.png' END || '"}}'
      WHEN 3 THEN '{{"source":{{"url":"https://img.example/' || conv_id || '.png"}}}}'
      ELSE '{{"url":"ftp://img.example/' || conv_id || '"}}' END AS e1,
    CASE WHEN turn % 2 = 0 THEN ['{{"url":"https://cdn.example/' || conv_id || '/' || turn || '"}}'] END AS message
  FROM conversations WHERE role = 'user'
),
img2 AS (
  SELECT *, CASE WHEN conv_id % 6 = 0 THEN [e1, '{{"data": "not base64!"}}'] ELSE [e1] END AS entries,
    flatten(list_transform(regexp_extract_all(user, '{BLOCK_RE}', 1),
                           lambda b: regexp_extract_all(b, '{DATA_URL_RE}'))) AS inline
  FROM img
)"""

ORACLE["p10_extract_inline_images"] = f"""WITH {IMAGES},
d AS (SELECT prompt_id, user, list_filter(list_transform(inline, lambda u: {data_url_bytes('u')}),
                                          lambda b: b IS NOT NULL) AS imgs FROM img2)
SELECT prompt_id,
  CASE WHEN user = '' THEN user ELSE {strip(f"regexp_replace(user, '{BLOCK_RE}', '', 'g')")} END AS user_clean,
  len(imgs)::INTEGER AS n_images,
  coalesce(list_sum(list_transform(imgs, lambda b: octet_length(b))), 0)::BIGINT AS image_bytes
FROM d"""

ENTRIES = IMAGES + f""",
ent AS (SELECT prompt_id, (generate_subscripts(entries, 1) - 1)::INTEGER AS idx, unnest(entries) AS entry FROM img2),
files AS (SELECT file AS path FROM glob('{SF001}/*.parquet'))"""

ORACLE["p9_classify_images"] = f"""WITH {ENTRIES},
e AS (
  SELECT prompt_id, idx, entry, json_type(entry) AS t,
    CASE WHEN json_type(entry) = 'VARCHAR' THEN {strip("json_extract_string(entry, '$')")} END AS s,
    CASE WHEN json_type(entry, '$.source') = 'OBJECT' THEN json_extract(entry, '$.source') ELSE entry::JSON END AS p
  FROM ent),
f AS (
  SELECT e.*, CASE WHEN json_type(p, '$.data_url') = 'VARCHAR' THEN json_extract_string(p, '$.data_url') END AS f_du,
    CASE WHEN json_type(p, '$.base64') = 'VARCHAR' THEN json_extract_string(p, '$.base64') END AS f_b64,
    CASE WHEN json_type(p, '$.data') = 'VARCHAR' THEN json_extract_string(p, '$.data') END AS f_data,
    CASE WHEN json_type(p, '$.path') = 'VARCHAR' THEN json_extract_string(p, '$.path') END AS f_path,
    CASE WHEN json_type(p, '$.url') = 'VARCHAR' THEN json_extract_string(p, '$.url') END AS f_url
  FROM e),
g AS (
  SELECT f.*, fl.path IS NOT NULL AS ex,
    lower(regexp_extract(f_url, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) AS scheme
  FROM f LEFT JOIN files fl ON fl.path = coalesce(f.s, f.f_path)),
k AS (
  SELECT g.*,
    CASE WHEN t = 'VARCHAR' AND starts_with(s, 'data:image/') THEN 'data_url'
         WHEN t = 'VARCHAR' AND ex THEN 'path'
         WHEN t = 'VARCHAR' THEN 'base64'
         WHEN t <> 'OBJECT' THEN 'error'
         WHEN starts_with(f_du, 'data:image/') THEN 'data_url'
         WHEN coalesce({strip('f_b64')}, '') <> '' THEN 'base64'
         WHEN coalesce({strip('f_data')}, '') <> '' AND starts_with(f_data, 'data:image/') THEN 'data_url'
         WHEN coalesce({strip('f_data')}, '') <> '' THEN 'base64'
         WHEN coalesce({strip('f_path')}, '') <> '' AND ex THEN 'path'
         WHEN coalesce({strip('f_path')}, '') <> '' THEN 'error'
         WHEN coalesce({strip('f_url')}, '') <> '' AND scheme IN ('http', 'https') THEN 'url'
         ELSE 'error' END AS kind,
    CASE WHEN t = 'VARCHAR' THEN s
         WHEN starts_with(f_du, 'data:image/') THEN f_du
         WHEN coalesce({strip('f_b64')}, '') <> '' THEN f_b64
         WHEN coalesce({strip('f_data')}, '') <> '' THEN f_data
         WHEN coalesce({strip('f_path')}, '') <> '' THEN f_path
         WHEN coalesce({strip('f_url')}, '') <> '' THEN f_url END AS ref
  FROM g),
b AS (
  SELECT k.*, CASE WHEN kind = 'data_url' THEN {data_url_bytes('ref')}
                   WHEN kind = 'base64' THEN {b64dec("regexp_replace(ref, '[[:space:]]', '', 'g')")} END AS bytes
  FROM k)
SELECT prompt_id, idx, kind, octet_length(bytes)::BIGINT AS n_bytes,
  CASE WHEN t NOT IN ('VARCHAR', 'OBJECT') THEN 'unsupported type: ' || lower(t)
       WHEN t = 'OBJECT' AND coalesce({strip('f_path')}, '') <> '' AND NOT ex AND kind = 'error'
         THEN 'path does not exist: ' || f_path
       WHEN t = 'OBJECT' AND coalesce({strip('f_url')}, '') <> '' AND kind = 'error'
         THEN 'url scheme not supported: ' || scheme
       WHEN kind = 'error' THEN 'missing image source (data_url/base64/path/url)'
       WHEN kind IN ('data_url', 'base64') AND bytes IS NULL THEN 'undecodable base64' END AS error
FROM b"""

ORACLE["s2_concat_images"] = f"""WITH {IMAGES},
a AS (
  SELECT prompt_id, list_concat(
      list_transform(coalesce(entries, []), lambda e: {{'origin': 'prompt', 'entry': e}}),
      list_transform(coalesce(message, []), lambda e: {{'origin': 'message', 'entry': e}}),
      list_transform(coalesce(inline, []), lambda e: {{'origin': 'inline', 'entry': e}})) AS l
  FROM img2),
u AS (SELECT prompt_id, (generate_subscripts(l, 1) - 1)::INTEGER AS idx, unnest(l) AS x FROM a)
SELECT prompt_id, idx, x.origin AS origin, x.entry AS entry FROM u"""

ORACLE["src7_load_images"] = f"""WITH {ENTRIES},
paths AS (SELECT prompt_id, idx, json_extract_string(entry, '$.path') AS path FROM ent
          WHERE json_extract_string(entry, '$.path') IS NOT NULL),
blobs AS (SELECT filename AS path, size FROM read_blob('{SF001}/*.parquet'))
SELECT p.prompt_id, p.idx, b.size::BIGINT AS n_bytes, CASE WHEN b.path IS NULL THEN 'missing' END AS error
FROM paths p LEFT JOIN blobs b USING (path)"""

ORACLE["p16_request_overrides"] = f"""WITH {IMAGES},
r AS (
  SELECT prompt_id, (len(entries) + len(list_filter(list_transform(inline, lambda u: {data_url_bytes('u')}),
                                                  lambda b: b IS NOT NULL)))::INTEGER AS n_images,
         conv_id % 2 = 0 AS do_sample
  FROM img2)
SELECT prompt_id, n_images,
  CASE WHEN n_images > 0 AND do_sample THEN false ELSE do_sample END AS do_sample,
  CASE WHEN n_images > 0 AND do_sample THEN 1.0 ELSE 0.7 END::DOUBLE AS temperature,
  CASE WHEN n_images > 0 AND do_sample THEN 1.0 ELSE 0.95 END::DOUBLE AS top_p,
  CASE WHEN n_images > 0 AND do_sample THEN 50 ELSE 40 END::INTEGER AS top_k,
  CASE WHEN n_images > 0 THEN 1.0 ELSE 1.1 END::DOUBLE AS repetition_penalty
FROM r"""

ROLLUP = """
roll AS (
  SELECT p_brand AS host, sum(p_retailprice) AS total_gb, sum(p_size / 2) AS allocated_gb,
    sum(p_size::DOUBLE) AS reserved_gb, sum(p_retailprice) - sum(p_size::DOUBLE) AS free_gb,
    count(*) AS num_gpus, min_by(p_name, p_partkey) AS device, avg(p_size) AS params_b
  FROM part GROUP BY p_brand
),
lim AS (
  SELECT host, free_gb, params_b,
    CASE WHEN regexp_extract(host, '#(\\d+)', 1)::INTEGER % 2 = 0 THEN 128000
         ELSE 4096 * (regexp_extract(host, '#(\\d+)', 1)::INTEGER % 8 + 1) END::BIGINT AS mm,
    trunc(free_gb * 0.7 * 1073741824.0 / CASE WHEN params_b < 15 THEN 512 WHEN params_b < 40 THEN 1024
                                               ELSE 1536 END)::BIGINT AS est
  FROM roll
),
limits AS (
  SELECT host, CASE WHEN est > mm * 1.5 THEN mm ELSE greatest(least(est, mm, 128000), 1000) END::BIGINT AS max_context
  FROM lim
)"""

ORACLE["a4_device_rollup"] = f"""WITH {ROLLUP}
SELECT host, round(total_gb, 4) AS total_gb, round(allocated_gb, 4) AS allocated_gb,
  round(reserved_gb, 4) AS reserved_gb, round(free_gb, 4) AS free_gb, num_gpus, device FROM roll"""

ORACLE["p17_context_limit"] = f"""WITH {ROLLUP}
SELECT host, max_context FROM limits"""

ORACLE["p11_filter_context"] = f"""WITH {ROLLUP},
d AS (SELECT doc_id, 'Brand#' || (doc_id % 25 + 1) AS host,
        len(regexp_extract_all('[INST]' || text || '[/INST]', '[^ \\n\\t]+'))::INTEGER AS tokens_in FROM documents)
SELECT d.doc_id, d.host, d.tokens_in, l.max_context,
  NOT (l.max_context IS NOT NULL AND d.tokens_in > l.max_context) AS accepted,
  CASE WHEN l.max_context IS NOT NULL AND d.tokens_in > l.max_context
       THEN 'Context too long (' || d.tokens_in || ' tokens). Max: ' || l.max_context
            || '. Please retry with shorter input.' END AS error
FROM d LEFT JOIN limits l USING (host)"""
