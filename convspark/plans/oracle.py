"""Independent DuckDB SQL for each registered query (the correctness gate).

The SQL restates each operator's semantics directly over the base tables;
it shares no code path with the Spark implementation except the fixed
character classes below.
"""

from __future__ import annotations

from convspark.functions.names import JS_WS_CLASS, UNSAFE_RUN
from convspark.functions.text import PY_WS_CLASS

STRIP_RE = r"\A" + PY_WS_CLASS + r"+|" + PY_WS_CLASS + r"+\z"
JS_TRIM_RE = r"\A" + JS_WS_CLASS + r"+|" + JS_WS_CLASS + r"+\z"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '{STRIP_RE}', '', 'g')"


def js_trim(x: str) -> str:
    return f"regexp_replace({x}, '{JS_TRIM_RE}', '', 'g')"


def nb(x: str) -> str:
    """stripped text, or NULL when blank"""
    return f"nullif({strip(x)}, '')"


def csv(x: str) -> str:
    return f"array_to_string({x}, ',')"


def tok_id(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 15))::BIGINT"


# -------------------------------------------------------------- fixtures
JSONL_PARTS = f"""
jparts AS (
  SELECT 'conv' AS request_id, (u.conv_id << 20) + a.turn AS line_no,
         {nb('u.text')} AS src, {nb('a.text')} AS tgt,
         json_object('user', u.text, 'assistant', a.text)::VARCHAR AS value
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'
  UNION ALL
  SELECT 'docs', doc_id, {nb('text')}, NULL, json_object('text', text)::VARCHAR FROM documents
  UNION ALL
  SELECT 'bench', item_id, {nb('text')}, CASE WHEN item_id % 2 = 0 THEN 'True' ELSE 'False' END,
         json_object('question', text, 'label', item_id % 2 = 0)::VARCHAR FROM benchmark
  UNION ALL
  SELECT 'raw', event_id, NULL, NULL, props FROM events
  UNION ALL
  SELECT 'plain', n_nationkey::BIGINT, NULL, NULL, n_name FROM nation
  UNION ALL
  SELECT 'blank', r_regionkey::BIGINT, NULL, NULL,
         [' ', chr(9), chr(160), chr(12288), chr(8195)][r_regionkey % 5 + 1] || '  ' FROM region
)"""

SAMPLES = JSONL_PARTS + f""",
samples AS (
  SELECT request_id, line_no AS sample_id,
         CASE WHEN src IS NOT NULL AND tgt IS NOT NULL THEN src || chr(10) || tgt
              WHEN tgt IS NOT NULL THEN tgt WHEN src IS NOT NULL THEN src
              ELSE {strip('value')} END AS text
  FROM jparts WHERE {strip('value')} <> ''
)"""

SHUFFLED = SAMPLES + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY request_id
           ORDER BY md5(concat_ws(':', '42', '0', sample_id)), sample_id) AS rank
  FROM samples
)"""

TRAIN_CFG = """
raw_cfg AS (
  SELECT o_orderkey AS request_id,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 7 - 2 END AS max_steps,
    CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 5 - 1 END AS batch_size,
    CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice / 1e9 END AS learning_rate,
    CASE WHEN o_orderkey % 2 = 0 THEN trunc(o_totalprice / 10)::BIGINT END AS max_seq_length,
    CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 4 - 1 END AS log_every,
    CASE WHEN o_orderkey % 8 <> 0 THEN o_orderkey % 5 - 2 END AS save_every,
    CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 4 - 1 END AS gradient_accumulation
  FROM orders
),
cfg AS (
  SELECT request_id,
    greatest(coalesce(max_steps, 50), 1)::BIGINT AS max_steps,
    greatest(coalesce(batch_size, 1), 1)::BIGINT AS batch_size,
    coalesce(learning_rate, 5e-5)::DOUBLE AS learning_rate,
    greatest(coalesce(max_seq_length, 2048), 32)::BIGINT AS max_seq_length,
    greatest(coalesce(log_every, 5), 1)::BIGINT AS log_every,
    greatest(coalesce(save_every, 0), 0)::BIGINT AS save_every,
    greatest(coalesce(gradient_accumulation, 1), 1)::BIGINT AS gradient_accumulation
  FROM raw_cfg
)"""

F_TRAIN = """
tr0 AS (
  SELECT l_orderkey, l_extendedprice, l_shipdate,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey,
                       l_linenumber, l_extendedprice) AS n,
    count(*) OVER (PARTITION BY l_orderkey) AS cnt
  FROM lineitem
),
ftrain AS (
  SELECT l_orderkey AS request_id, n::INTEGER AS n,
    CASE WHEN n = 1 THEN 'train_started'
         WHEN n = cnt AND l_orderkey % 3 = 0 THEN 'train_done'
         WHEN n = cnt AND l_orderkey % 3 = 1 THEN 'error'
         ELSE 'train_progress' END AS type,
    (n - 1)::INTEGER AS step, l_extendedprice / 1000 AS loss, (cnt + l_orderkey % 4)::INTEGER AS max_steps,
    CASE WHEN n > 1 AND n = cnt AND l_orderkey % 3 = 0 AND l_orderkey % 9 <> 0 THEN 'models/train_' || l_orderkey END AS checkpoint,
    l_shipdate::DATE::TIMESTAMP + to_hours(n) AS ts
  FROM tr0
)"""


ORACLE: dict[str, str] = {}

# -------------------------------------------------------------- corpus
ORACLE["p3_drop_blank"] = f"""WITH {JSONL_PARTS}
SELECT request_id, line_no FROM jparts WHERE {strip('value')} <> ''"""

ORACLE["p1_pick_first"] = f"""WITH {JSONL_PARTS}
SELECT request_id, line_no, src AS source, tgt AS target FROM jparts"""

ORACLE["p2_to_samples"] = f"""WITH {SAMPLES}
SELECT request_id, sample_id, text FROM samples"""

ODD = """odd AS (
  SELECT c_custkey AS k,
    CASE c_custkey % 5 WHEN 0 THEN 'p' || c_custkey WHEN 1 THEN 'nan' WHEN 2 THEN 'inf' WHEN 4 THEN 'plain ' || c_custkey END AS source,
    CASE c_custkey % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'a' || c_custkey WHEN 2 THEN '0.5' END AS target,
    CASE c_custkey % 5 WHEN 0 THEN 'duplicate_key' WHEN 1 THEN 'non_finite' WHEN 2 THEN 'duplicate_key,non_finite' END AS parse_note
  FROM customer)"""

ORACLE["p1_odd_json"] = f"""WITH {ODD} SELECT k AS line_no, source, target, parse_note FROM odd"""

ORACLE["p2_odd_json"] = f"""WITH {ODD}
SELECT 'odd' AS request_id, k AS sample_id,
  CASE WHEN k % 5 = 3 THEN '{{"text": "' || k || '"}} tail' ELSE concat_ws(chr(10), source, target) END AS text, parse_note
FROM odd"""

ORACLE["p12_odd_json"] = """SELECT c_nationkey::BIGINT AS session_id, c_custkey AS seq,
  CASE WHEN c_custkey % 5 IN (0, 1) THEN 'dispatch' WHEN c_custkey % 5 = 4 THEN 'ignored' ELSE 'dead_letter' END AS route,
  CASE WHEN c_custkey % 5 IN (0, 1) THEN 'config' WHEN c_custkey % 5 = 4 THEN NULL END AS msg_type,
  CASE c_custkey % 5 WHEN 2 THEN '''float'' object has no attribute ''get''' WHEN 3 THEN 'Invalid JSON' END AS error
FROM customer"""

ORACLE["p4_check_non_empty"] = f"""WITH {SAMPLES},
req AS (SELECT DISTINCT request_id FROM jparts),
cnt AS (SELECT request_id, count(*) AS n FROM samples GROUP BY request_id)
SELECT r.request_id, coalesce(c.n, 0)::BIGINT AS n_samples,
       CASE WHEN coalesce(c.n, 0) > 0 THEN 'ok' ELSE 'empty' END AS status
FROM req r LEFT JOIN cnt c USING (request_id)"""

_SAN_RID = f"""coalesce(nullif(trim(regexp_replace(r.request_id, '{UNSAFE_RUN}', '-', 'g'), '-.'), ''),
      substr(md5(r.request_id),1,8)||'-'||substr(md5(r.request_id),9,4)||'-'||substr(md5(r.request_id),13,4)
      ||'-'||substr(md5(r.request_id),17,4)||'-'||substr(md5(r.request_id),21,12))"""

ORACLE["j2_resolve_corpora"] = f"""WITH req AS (
  SELECT 'job ' || (o_custkey % 50)::VARCHAR || '/' || o_orderpriority AS request_id,
         CASE WHEN o_orderstatus = 'F' THEN o_orderpriority WHEN o_orderstatus = 'O' THEN '  ' END AS dataset,
         o_orderkey % 2 = 0 AS resume, o_orderkey
  FROM orders),
landed AS (
  SELECT DISTINCT 'job ' || (c_custkey % 50)::VARCHAR || '/1-URGENT' AS request_id FROM customer WHERE c_acctbal > 0),
r2 AS (
  SELECT r.*, l.request_id AS landed_id,
    EXISTS (SELECT 1 FROM req e WHERE e.request_id = r.request_id AND e.o_orderkey < r.o_orderkey
            AND coalesce({strip('e.dataset')}, '') <> '') AS earlier
  FROM req r LEFT JOIN landed l ON l.request_id = r.request_id)
SELECT r.request_id, r.o_orderkey,
  CASE WHEN coalesce({strip('r.dataset')}, '') <> '' THEN 'inline'
       WHEN r.resume AND (r.earlier OR r.landed_id IS NOT NULL) THEN 'cached' ELSE 'error' END AS outcome,
  CASE WHEN coalesce({strip('r.dataset')}, '') <> '' OR (r.resume AND r.earlier) THEN {_SAN_RID}
       WHEN r.resume AND r.landed_id IS NOT NULL THEN 'cached:' || r.landed_id END AS corpus_key
FROM r2 r"""

ORACLE["o1_shuffle_corpus"] = f"""WITH {SHUFFLED}
SELECT request_id, sample_id, rank FROM ranked"""

ORACLE["o2_make_batches"] = f"""WITH {SHUFFLED}
SELECT request_id, sample_id, rank, ((rank - 1) // 8)::BIGINT AS batch FROM ranked"""

ORACLE["corpus_batches"] = f"""WITH {SHUFFLED}
SELECT request_id, ((rank - 1) // 16)::BIGINT AS batch, count(*)::BIGINT AS n_samples,
       sum(length(text))::BIGINT AS n_chars,
       sum(len(regexp_extract_all(text, '[^ \\n\\t]+')))::BIGINT AS n_tokens
FROM ranked GROUP BY 1, 2"""

ORACLE["o3_repeat_epochs"] = f"""WITH {SAMPLES},
sized AS (SELECT request_id, count(*) AS n, ceil(count(*) / 16)::BIGINT AS bpe,
                 2 AS epochs, ceil(ceil(count(*) / 16) * 1.5)::BIGINT AS steps FROM samples GROUP BY 1),
exp AS (SELECT s.request_id, s.sample_id, e.epoch, z.bpe, z.steps
        FROM samples s JOIN sized z USING (request_id),
             LATERAL (SELECT unnest(range(0, z.epochs)) AS epoch) e),
rk AS (SELECT *, row_number() OVER (PARTITION BY request_id, epoch
                 ORDER BY md5(concat_ws(':', '42', epoch, sample_id)), sample_id) AS rank FROM exp)
SELECT request_id, epoch::INTEGER AS epoch, sample_id, rank, ((rank - 1) // 16)::BIGINT AS batch,
       (epoch * bpe + (rank - 1) // 16 + 1)::BIGINT AS step
FROM rk WHERE epoch * bpe + (rank - 1) // 16 + 1 <= steps"""

ORACLE["t3_count_tokens"] = f"""WITH {SAMPLES}
SELECT request_id, sample_id, len(regexp_extract_all(text, '[^ \\n\\t]+'))::INTEGER AS n_tokens FROM samples"""

ORACLE["t1_truncate_tokens"] = f"""WITH {SAMPLES}
SELECT request_id, sample_id,
  {csv("list_transform(regexp_extract_all(text, '[^ \\n\\t]+')[1:64], lambda x: " + tok_id('x') + ")")} AS token_ids
FROM samples"""

ORACLE["t2_pad_batch"] = f"""WITH {SHUFFLED},
tk AS (SELECT request_id, sample_id, (rank - 1) // 4 AS batch,
         list_transform(regexp_extract_all(text, '[^ \\n\\t]+')[1:32], lambda x: {tok_id('x')}) AS ids
       FROM ranked),
mx AS (SELECT *, max(len(ids)) OVER (PARTITION BY request_id, batch) AS L FROM tk)
SELECT request_id, batch::BIGINT AS batch, sample_id,
  {csv("list_concat(ids, repeat([0], (L - len(ids))::INTEGER))")} AS input_ids,
  {csv("list_concat(repeat([1], len(ids)::INTEGER), repeat([0], (L - len(ids))::INTEGER))")} AS attention_mask,
  {csv("list_concat(ids, repeat([-100], (L - len(ids))::INTEGER))")} AS labels
FROM mx"""

ORACLE["t7_clamp_train_config"] = f"""WITH {TRAIN_CFG}
SELECT * FROM cfg"""

ORACLE["w8_step_plan"] = f"""WITH {TRAIN_CFG},
steps AS (SELECT request_id, unnest(range(1, max_steps + 1)) AS step FROM cfg)
SELECT s.request_id, s.step::BIGINT AS step, s.step = c.max_steps AS is_last,
  (s.step % c.gradient_accumulation = 0) OR s.step = c.max_steps AS update,
  ceil(s.step / c.gradient_accumulation)::BIGINT AS update_id,
  s.step % c.log_every = 0 AS log,
  c.save_every > 0 AND s.step % greatest(c.save_every, 1) = 0 AND s.request_id % 5 <> 0 AS checkpoint,
  CASE WHEN c.save_every > 0 AND s.step % greatest(c.save_every, 1) = 0 AND s.request_id % 5 <> 0
       THEN CASE WHEN s.request_id % 3 = 0 THEN 'my-model-' || s.request_id ELSE 'train_0' END || '_step_' || s.step END AS checkpoint_name,
  CASE WHEN s.step = c.max_steps AND s.request_id % 5 <> 0
       THEN CASE WHEN s.request_id % 3 = 0 THEN 'my-model-' || s.request_id ELSE 'train_' || s.request_id || '_0' END END AS final_checkpoint
FROM steps s JOIN cfg c USING (request_id)"""

ORACLE["w9_latest_loss"] = f"""WITH {TRAIN_CFG}, {F_TRAIN}
SELECT t.request_id, max(t.step) AS steps,
  count(*) FILTER (WHERE t.step % c.log_every = 0)::BIGINT AS n_logged,
  max_by(t.loss, t.step) FILTER (WHERE t.step % c.log_every = 0) AS last_loss
FROM ftrain t JOIN cfg c USING (request_id)
WHERE t.type = 'train_progress'
GROUP BY t.request_id"""

ORACLE["train_batches"] = f"""WITH {SAMPLES},
sized AS (SELECT request_id, ceil(count(*) / 8)::BIGINT AS bpe,
                 2 AS epochs, ceil(ceil(count(*) / 8) * 1.5)::BIGINT AS steps FROM samples GROUP BY 1),
tok AS (SELECT request_id, sample_id,
          list_transform(regexp_extract_all(text, '[^ \\n\\t]+')[1:48], lambda x: {tok_id('x')}) AS ids
        FROM samples),
exp AS (SELECT t.request_id, t.sample_id, t.ids, e.epoch, z.bpe, z.steps
        FROM tok t JOIN sized z USING (request_id),
             LATERAL (SELECT unnest(range(0, z.epochs)) AS epoch) e),
rk AS (SELECT *, row_number() OVER (PARTITION BY request_id, epoch
                 ORDER BY md5(concat_ws(':', '42', epoch, sample_id)), sample_id) AS rank FROM exp),
st AS (SELECT *, (epoch * bpe + (rank - 1) // 8 + 1)::BIGINT AS step FROM rk
       WHERE epoch * bpe + (rank - 1) // 8 + 1 <= steps),
mx AS (SELECT *, max(len(ids)) OVER (PARTITION BY request_id, step) AS L,
         max(step) OVER (PARTITION BY request_id) AS last_step FROM st)
SELECT request_id, epoch::INTEGER AS epoch, step, sample_id,
  {csv("list_concat(ids, repeat([0], (L - len(ids))::INTEGER))")} AS input_ids,
  {csv("list_concat(repeat([1], len(ids)::INTEGER), repeat([0], (L - len(ids))::INTEGER))")} AS attention_mask,
  {csv("list_concat(ids, repeat([-100], (L - len(ids))::INTEGER))")} AS labels,
  step % 4 = 0 OR step = last_step AS update,
  step % 5 = 0 AS log,
  step % 10 = 0 AS checkpoint
FROM mx"""
