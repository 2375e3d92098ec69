"""DuckDB oracle statements for the token-scoring queries."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

LOGITS = """
logits AS (
  SELECT vec_id AS seq_id, (k - 1)::INTEGER AS token_id, x::DOUBLE AS logit
  FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings)
)"""

SOFT = LOGITS + """,
soft AS (
  SELECT seq_id, token_id, logit,
    exp(logit / 0.7 - max(logit / 0.7) OVER (PARTITION BY seq_id)) AS e FROM logits
)"""

FILTERED = LOGITS + """,
topk AS (
  SELECT * FROM (SELECT *, rank() OVER (PARTITION BY seq_id ORDER BY logit DESC) AS r FROM logits) WHERE r <= 50
),
tp AS (
  SELECT *, exp(logit / 0.7 - max(logit / 0.7) OVER (PARTITION BY seq_id)) AS e FROM topk
),
tp2 AS (SELECT *, e / sum(e) OVER (PARTITION BY seq_id) AS p FROM tp),
nuc AS (
  SELECT seq_id, token_id, logit FROM (
    SELECT *, coalesce(sum(p) OVER (PARTITION BY seq_id ORDER BY logit DESC, token_id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tp2)
  WHERE round(before, 9) <= 0.95
),
np AS (
  SELECT seq_id, token_id, logit, exp(logit / 0.7 - max(logit / 0.7) OVER (PARTITION BY seq_id)) AS e FROM nuc
),
probs AS (SELECT seq_id, token_id, e / sum(e) OVER (PARTITION BY seq_id) AS prob FROM np)"""

POSITIONS = """
positions AS (
  SELECT label::BIGINT AS seq, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INTEGER AS pos, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN -100 ELSE vec_id % 64 END::INTEGER AS label
  FROM embeddings
),
shifted AS (
  SELECT a.*, b.label AS target FROM positions a LEFT JOIN positions b ON b.seq = a.seq AND b.pos = a.pos + 1
)"""

ORACLE["w2_softmax"] = f"""WITH {SOFT}
SELECT seq_id, token_id, round(e / sum(e) OVER (PARTITION BY seq_id), 6) AS prob FROM soft"""

ORACLE["w3_top_k_filter"] = f"""WITH {LOGITS}
SELECT seq_id, token_id FROM (SELECT *, rank() OVER (PARTITION BY seq_id ORDER BY logit DESC) AS r FROM logits)
WHERE r <= 50"""

ORACLE["w4_nucleus_filter"] = f"""WITH {FILTERED}
SELECT seq_id, token_id, round(prob, 6) AS prob FROM probs"""

ORACLE["w5_greedy_token"] = f"""WITH {LOGITS}
SELECT seq_id, arg_max(token_id, (logit, -token_id)) AS token_id FROM logits GROUP BY seq_id"""

ORACLE["w6_draw_token"] = f"""WITH {FILTERED},
cum AS (
  SELECT seq_id, token_id, sum(prob) OVER (PARTITION BY seq_id ORDER BY token_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c,
         ('0x' || substr(md5('42:' || seq_id), 1, 8))::BIGINT / 4294967296.0 AS u
  FROM probs)
SELECT seq_id, coalesce(min(token_id) FILTER (WHERE c > u), max(token_id))::INTEGER AS token_id
FROM cum GROUP BY seq_id"""

ORACLE["w7_shift_labels"] = f"""WITH {POSITIONS}
SELECT seq, pos, label, target FROM shifted"""

ORACLE["a8_cross_entropy"] = f"""WITH {LOGITS}, {POSITIONS},
lse AS (SELECT seq_id AS vec_id, max(logit) + ln(sum(exp(logit - m))) AS lse
        FROM (SELECT *, max(logit) OVER (PARTITION BY seq_id) AS m FROM logits) GROUP BY seq_id),
nll AS (
  SELECT s.seq, l.lse - g.logit AS nll
  FROM shifted s JOIN lse l ON l.vec_id = s.vec_id
  JOIN logits g ON g.seq_id = s.vec_id AND g.token_id = s.target
  WHERE s.target IS NOT NULL AND s.target <> -100),
per AS (SELECT seq, count(*) AS n, sum(nll) AS ls FROM nll GROUP BY seq),
lens AS (SELECT seq, count(*) AS length FROM positions GROUP BY seq)
SELECT l.seq, l.length, coalesce(p.n, 0) AS n_scored,
  round(CASE WHEN l.length >= 2 THEN p.ls / p.n END, 6) AS loss,
  CASE WHEN l.length < 2 THEN 'Not enough tokens to compute training loss' ELSE 'ok' END AS status
FROM lens l LEFT JOIN per p USING (seq)"""

_PER = ORACLE["a8_cross_entropy"][:ORACLE["a8_cross_entropy"].index("SELECT l.seq, l.length")]
ORACLE["a8_batch_loss"] = _PER + """SELECT floor(l.seq / 4)::BIGINT AS batch, count(*) AS n_seqs, sum(coalesce(p.n, 0))::BIGINT AS n_scored,
  round(sum(CASE WHEN l.length >= 2 THEN p.ls END) / sum(CASE WHEN l.length >= 2 THEN p.n END), 6) AS loss
FROM lens l LEFT JOIN per p USING (seq) GROUP BY 1"""
