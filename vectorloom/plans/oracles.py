"""The registered queries in SQL, for checking the Spark results with another engine.

Written from the definitions, not from the Spark plans: truncation, hashing, widths and
error rules are spelled out relationally here. ``+ 0`` turns a rounded -0.0 into 0.0.
"""

from __future__ import annotations

# Fixed values, as SQL literals.
_GEMMA_DOC = "'title: none | text: '"
_GEMMA_QUERY = "'task: search result | query: '"
_QWEN_QUERY = (
    "('Instruct: Given a web search query, retrieve relevant passages that answer the query'"
    " || chr(10) || 'Query: ')"
)
_GEMMA_BUILD = "'embeddinggemma-300M-Q8_0.gguf'"
_QWEN_BUILD = "'Qwen3-Embedding-8B-Q4_K_M.gguf'"

_MODELS = f"""models(ord, model, native, room, n_ctx, special, qp, dp, build) AS (VALUES
    (0, 'gemma', 768, 2045, 2048, 2, {_GEMMA_QUERY}, {_GEMMA_DOC}, {_GEMMA_BUILD}),
    (1, 'qwen', 4096, 8190, 8192, 1, {_QWEN_QUERY}, '', {_QWEN_BUILD}))"""

# One request per conversation.
_CONV_MODEL = "CASE WHEN conv_id % 5 <= 1 THEN 'gemma' WHEN conv_id % 5 <= 3 THEN 'qwen' ELSE 'nomodel' END"
_CONV_TASK = "CASE WHEN conv_id % 2 = 0 THEN 'query' ELSE 'document' END"
_CONV_WIDTH = "CASE (conv_id // 2) % 4 WHEN 1 THEN 256 WHEN 2 THEN 0 WHEN 3 THEN 5000 END"
_TURNS = f"""turns AS (SELECT conv_id, turn, text, {_CONV_MODEL} AS model, {_CONV_TASK} AS task,
    {_CONV_WIDTH} AS width FROM conversations)"""

# Some payloads missing, see the query of the same kind.
_HOLED = "holed AS (SELECT *, CASE WHEN substr(md5(text), 1, 1) <> '0' THEN text END AS payload FROM turns)"

_DOC_LINES = f"""requests AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'qwen' ELSE 'gemma' END AS model,
      string_split(text, chr(10)) AS lines,
      CASE doc_id % 3 WHEN 1 THEN 64 WHEN 2 THEN 5 ELSE 768 END AS width FROM documents),
  lines AS (SELECT doc_id, model, width, unnest(range(len(lines))) AS line, unnest(lines) AS payload FROM requests)"""


def _hashed(keys: str) -> str:
    """CTEs from ``src(keys, native, room, width, seen)`` to ``cut(keys, c, x)``: the
    non-zero components of each text below its width."""
    return f"""
  words AS (SELECT {keys}, native, width,
      unnest(list_slice(regexp_extract_all(seen, '\\S+'), 1, room)) AS w FROM src),
  hashes AS (SELECT {keys}, native, width, CAST(CAST('0x' || substr(md5(w), 1, 8) AS UBIGINT) AS BIGINT) AS h
      FROM words),
  sums AS (SELECT {keys}, width, (h >> 1) % native AS c,
      CAST(sum(CASE WHEN h % 2 = 1 THEN 1 ELSE -1 END) AS BIGINT) AS x FROM hashes GROUP BY ALL),
  cut AS (SELECT {keys}, c, x FROM sums WHERE c < width AND x <> 0)"""


def _digest(keys: str) -> str:
    return f"""
  digest AS (SELECT {keys}, CAST(count(*) AS BIGINT) AS nnz,
      CAST(sum(x * (c + 1)) AS DOUBLE) / sqrt(CAST(sum(x * x) AS DOUBLE)) AS chk
      FROM cut GROUP BY {keys})"""


def _norm(v: str) -> str:
    return f"sqrt(list_sum(list_transform({v}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


def _weighted(v: str) -> str:
    return f"list_sum(list_transform({v}, lambda x, i: CAST(x AS DOUBLE) * i))"


# Error of a turn's text in the faulty stand-in encoder, by the first byte of its md5.
def _fault(seen: str, rate: int) -> str:
    byte = f"CAST('0x' || substr(md5({seen}), 1, 2) AS INTEGER)"
    return f"""CASE WHEN {byte} < {rate} THEN 'rejected' WHEN {byte} < {2 * rate} THEN 'unavailable'
      WHEN {byte} < {3 * rate} THEN 'exception'
      WHEN {byte} < {4 * rate} THEN 'tokenize' WHEN {byte} < {5 * rate} THEN 'loading' END"""


_FAULT_STATUS = "CASE WHEN fault IN ('unavailable', 'loading') THEN 503 ELSE 500 END"
_FAULT_DETAIL = """CASE fault WHEN 'unavailable' THEN model || ' model server unavailable: connection refused'
      WHEN 'rejected' THEN model || ': input rejected' WHEN 'tokenize' THEN model || ': tokenize failed: bad input'
      WHEN 'loading' THEN model || ': loading model' ELSE 'unexpected answer' END"""

_PROMPTED = "CASE WHEN task = 'query' THEN qp ELSE dp END || "

# Per conversation, with missing payloads and a faulty encoder: conv_id, model, status, detail.
_FAULTY = f"""{_MODELS}, {_TURNS}, {_HOLED},
  heads AS (SELECT conv_id, any_value(model) AS model, any_value(width) AS width, count(*) AS n_payloads,
      count(*) FILTER (payload IS NULL) AS n_null FROM holed GROUP BY conv_id),
  faults AS (SELECT conv_id, turn, model, {_fault(_PROMPTED + "payload", 4)} AS fault
      FROM holed JOIN models USING (model)),
  firsts AS (SELECT conv_id, model, arg_min(fault, turn) AS fault FROM faults WHERE fault IS NOT NULL GROUP BY ALL),
  outcomes AS (SELECT h.conv_id, h.model, n_payloads,
      CASE WHEN n_null > 0 OR width < 1 THEN 422 WHEN h.model = 'nomodel' THEN 404
        WHEN fault IS NOT NULL THEN {_FAULT_STATUS} ELSE 200 END AS status,
      CASE WHEN n_null > 0 THEN 'payloads: every item should be a valid string'
        WHEN width < 1 THEN 'dimensions: input should be greater than or equal to 1'
        WHEN h.model = 'nomodel' THEN 'Unknown model ''nomodel''; available: gemma, qwen'
        WHEN fault IS NOT NULL THEN {_FAULT_DETAIL.replace("model ||", "h.model ||")} ELSE '' END AS detail
      FROM heads h LEFT JOIN firsts f USING (conv_id))"""

ORACLE_SQL: dict[str, str] = {
    "embed_documents": f"""WITH src AS (SELECT doc_id, 768 AS native, 2045 AS room, 256 AS width,
      {_GEMMA_DOC} || text AS seen FROM documents), {_hashed("doc_id")}, {_digest("doc_id")}
SELECT doc_id, coalesce(nnz, 0) AS nnz, coalesce(round(chk, 6) + 0, 0) AS chk
FROM documents LEFT JOIN digest USING (doc_id)""",
    "embed_pages": f"""WITH src AS (SELECT page_id, 4096 AS native, 8190 AS room, 1024 AS width,
      html AS seen FROM pages), {_hashed("page_id")}, {_digest("page_id")}
SELECT page_id, coalesce(nnz, 0) AS nnz, coalesce(round(chk, 6) + 0, 0) AS chk
FROM pages LEFT JOIN digest USING (page_id)""",
    "embed_queries": f"""WITH {_MODELS}, src AS (SELECT item_id, model, native, room, 768 AS width,
      qp || text AS seen FROM benchmark, models), {_hashed("item_id, model")}, {_digest("item_id, model")}
SELECT item_id, model, coalesce(nnz, 0) AS nnz, coalesce(round(chk, 6) + 0, 0) AS chk
FROM src LEFT JOIN digest USING (item_id, model)""",
    "embed_conversations": f"""WITH {_MODELS}, {_TURNS},
  good AS (SELECT t.*, native, room, build, {_PROMPTED} text AS seen
      FROM turns t JOIN models USING (model) WHERE width IS NULL OR width >= 1),
  src AS (SELECT conv_id, turn, native, room, least(coalesce(width, 768), native) AS width, model, build, seen FROM good),
  {_hashed("conv_id, turn")}, {_digest("conv_id, turn")}
SELECT conv_id, turn, model, build, CAST(width AS BIGINT) AS dims, coalesce(nnz, 0) AS nnz,
  coalesce(round(chk, 6) + 0, 0) AS chk
FROM src LEFT JOIN digest USING (conv_id, turn)""",
    "response_lists": f"""WITH {_MODELS}, {_DOC_LINES},
  src AS (SELECT doc_id, line, native, room, width, dp || payload AS seen FROM lines JOIN models USING (model)),
  {_hashed("doc_id, line")}, {_digest("doc_id, line")},
  totals AS (SELECT doc_id, sum(chk * (line % 5 + 1)) AS chk FROM digest GROUP BY doc_id)
SELECT doc_id, CAST(200 AS BIGINT) AS status, CAST(len(lines) AS BIGINT) AS n_vectors, CAST(width AS BIGINT) AS dims,
  coalesce(round(chk, 5) + 0, 0) AS chk
FROM requests LEFT JOIN totals USING (doc_id)""",
    "truncate_normalize": f"""WITH v AS (SELECT vec_id, embedding[1:16] AS v FROM embeddings),
  n AS (SELECT vec_id, v, {_norm("v")} AS n FROM v)
SELECT vec_id, CAST(len(v) AS BIGINT) AS dims,
  array_to_string(list_transform(v, lambda x: CAST(round(CAST(x AS DOUBLE) / n * 10000) AS BIGINT)), ',') AS spelled FROM n""",
    "multi_width": f"""WITH d AS (SELECT vec_id, embedding,
      CASE vec_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 8 WHEN 2 THEN 32 WHEN 3 THEN 64 ELSE 5000 END AS d FROM embeddings),
  v AS (SELECT vec_id, embedding[1:least(d, len(embedding))] AS v FROM d)
SELECT vec_id, CAST(len(v) AS BIGINT) AS dims, round({_weighted("v")} / {_norm("v")}, 6) AS chk FROM v""",
    "default_width": f"""WITH wide AS (SELECT vec_id, flatten(list_transform(range(16), lambda k: embedding)) AS e FROM embeddings),
  v AS (SELECT vec_id, e[1:CASE WHEN vec_id % 2 = 1 THEN 16 ELSE 768 END] AS v FROM wide)
SELECT vec_id, CAST(len(v) AS BIGINT) AS dims, round({_weighted("v")} / {_norm("v")}, 5) AS chk FROM v""",
    "dot_is_cosine": f"""WITH comps AS (SELECT vec_id, label, unnest(range(len(embedding))) AS i,
      CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
  centre AS (SELECT label, i, avg(x) AS m FROM comps GROUP BY label, i)
SELECT vec_id, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 6) AS cosine
FROM comps JOIN centre USING (label, i) GROUP BY vec_id""",
    "sql_functions": f"""WITH v AS (SELECT vec_id, embedding[1:16] AS v FROM embeddings),
  n AS (SELECT vec_id, v, {_norm("v")} AS n FROM v)
SELECT vec_id, CAST(len(v) AS BIGINT) AS dims, round(CAST(v[1] AS DOUBLE) / n, 6) AS x_first,
  CAST(1.0 AS DOUBLE) AS norm, round(n, 6) AS kept FROM n""",
    "pool_mean": """WITH comps AS (SELECT label, unnest(range(len(embedding))) AS i,
      CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
  mean AS (SELECT label, i, avg(x) AS m FROM comps GROUP BY label, i)
SELECT CAST(label AS BIGINT) AS label, round(sum(m * (i + 1)) / sqrt(sum(m * m)), 6) AS chk FROM mean GROUP BY label""",
    "pool_last": f"""WITH last AS (SELECT label, arg_max(embedding, vec_id) AS v FROM embeddings GROUP BY label)
SELECT CAST(label AS BIGINT) AS label, round({_weighted("v")} / {_norm("v")}, 6) AS chk FROM last""",
    "prompted_texts": f"""WITH {_MODELS}, tasks(task) AS (VALUES ('document'), ('query')),
  p AS (SELECT doc_id, model, task, {_PROMPTED} text AS p FROM documents, models, tasks)
SELECT doc_id, model, task, CAST(length(p) AS BIGINT) AS n_chars, md5(p) AS md5 FROM p""",
    "request_rows": f"""WITH {_DOC_LINES}
SELECT doc_id, CAST(line AS BIGINT) AS payload_index, md5(payload) AS md5 FROM lines""",
    "active_requests": f"""WITH {_MODELS}, {_TURNS}, active(ord, model) AS (VALUES (0, 'qwen'), (1, 'gemma'))
SELECT CAST(a.ord AS BIGINT) AS ord, model, build, CAST(n_ctx - 1 AS BIGINT) AS token_limit, count(*) AS n_texts
FROM turns JOIN active a USING (model) JOIN models USING (model) GROUP BY ALL""",
    "validate_requests": f"""WITH {_TURNS}, {_HOLED},
  heads AS (SELECT conv_id, any_value(model) AS model, any_value(width) AS width,
      count(*) FILTER (payload IS NULL) AS n_null FROM holed GROUP BY conv_id)
SELECT conv_id,
  CAST(CASE WHEN n_null > 0 OR width < 1 THEN 422 WHEN model = 'nomodel' THEN 404 ELSE 200 END AS BIGINT) AS status,
  CASE WHEN n_null > 0 THEN 'payloads: every item should be a valid string'
    WHEN width < 1 THEN 'dimensions: input should be greater than or equal to 1'
    WHEN model = 'nomodel' THEN 'Unknown model ''nomodel''; available: gemma, qwen' ELSE '' END AS detail
FROM heads""",
    "json_requests": f"""WITH {_TURNS},
  kinds AS (SELECT *, turn % 8 AS w, (conv_id + turn) % 6 AS p,
      CASE turn % 8 WHEN 0 THEN 768 WHEN 1 THEN 256 WHEN 2 THEN 256 WHEN 3 THEN 256 WHEN 6 THEN 1 WHEN 7 THEN 0 END AS d
      FROM turns),
  errors AS (SELECT *, CASE
      WHEN p = 5 THEN 'body: JSON decode error'
      WHEN w IN (4, 5) THEN 'dimensions: input should be a valid integer'
      WHEN p = 4 THEN 'payloads: every item should be a valid string'
      WHEN p = 2 THEN 'payloads: input should be a valid list'
      WHEN p = 3 THEN 'payloads: every item should be a valid string'
      WHEN d < 1 THEN 'dimensions: input should be greater than or equal to 1' END AS body FROM kinds)
SELECT conv_id, turn,
  CAST(CASE WHEN body IS NOT NULL THEN 422 WHEN model = 'nomodel' THEN 404 ELSE 200 END AS BIGINT) AS status,
  CASE WHEN body IS NOT NULL THEN body
    WHEN model = 'nomodel' THEN 'Unknown model ''nomodel''; available: gemma, qwen' ELSE '' END AS detail,
  CAST(CASE WHEN body IS NULL AND model <> 'nomodel' THEN d ELSE -1 END AS BIGINT) AS dimensions,
  CAST(CASE WHEN body IS NULL AND model <> 'nomodel' THEN CASE WHEN p = 1 THEN 0 ELSE 1 END ELSE -1 END AS BIGINT) AS n_payloads
FROM errors""",
    "token_counts": f"""SELECT doc_id,
  CAST(len(regexp_extract_all({_GEMMA_DOC} || text, '\\S+')) + 2 AS BIGINT) AS n_tokens,
  len(regexp_extract_all({_GEMMA_DOC} || text, '\\S+')) + 2 <= 2047 AS fits FROM documents""",
    "truncate_tokens": """WITH cases(model, n_ctx, head, special) AS (VALUES
    ('gemma', 64, '<s> ', 2), ('qwen', 64, '', 1), ('gemma', 2048, '<s> ', 2), ('qwen', 2048, '', 1)),
  words AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS w FROM documents),
  cut AS (SELECT doc_id, model, n_ctx, head, special, list_slice(w, 1, n_ctx - 1 - special) AS w FROM words, cases)
SELECT doc_id, model, CAST(n_ctx AS BIGINT) AS n_ctx, CAST(len(w) + special AS BIGINT) AS kept,
  md5(head || array_to_string(w, ' ') || ' </s>') AS md5 FROM cut""",
    "truncation_report": f"""WITH {_MODELS}, counted AS (SELECT model, lang, n_ctx,
      len(regexp_extract_all(dp || text, '\\S+')) + special AS n FROM documents, models)
SELECT model, lang, count(*) AS n_texts, count(*) FILTER (n > n_ctx - 1) AS n_truncated,
  CAST(sum(greatest(0, n - (n_ctx - 1))) AS BIGINT) AS tokens_lost FROM counted GROUP BY model, lang""",
    "truncation_log": f"""WITH {_MODELS}, counted AS (SELECT doc_id, model, n_ctx,
      len(regexp_extract_all(dp || text, '\\S+')) + special AS n FROM documents, models)
SELECT doc_id, model, CAST(n AS BIGINT) AS n_tokens, CAST(n_ctx - 1 AS BIGINT) AS kept_tokens,
  CAST(n_ctx - 1 AS BIGINT) AS token_limit FROM counted WHERE n > n_ctx - 1""",
    "regroup_responses": f"""WITH {_MODELS}, {_TURNS},
  src AS (SELECT conv_id, turn, native, room, 8 AS width, {_PROMPTED} text AS seen FROM turns JOIN models USING (model)),
  {_hashed("conv_id, turn")},
  dense AS (SELECT s.conv_id, s.turn, g.c, coalesce(cut.x, 0) AS x FROM src s CROSS JOIN range(8) g(c)
      LEFT JOIN cut ON cut.conv_id = s.conv_id AND cut.turn = s.turn AND cut.c = g.c),
  vectors AS (SELECT conv_id, turn, string_agg(CAST(x AS VARCHAR), ',' ORDER BY c) AS v FROM dense GROUP BY ALL)
SELECT conv_id, turn // 4 AS part, count(*) AS n_vectors, md5(string_agg(v, '|' ORDER BY turn)) AS md5
FROM vectors GROUP BY ALL""",
    "failure_isolation": f"""WITH {_FAULTY}
SELECT conv_id, CAST(status AS BIGINT) AS status, detail,
  CASE WHEN status = 200 THEN n_payloads ELSE 0 END AS n_vectors FROM outcomes""",
    "long_form_requests": f"""WITH {_DOC_LINES},
  forms(form) AS (VALUES ('array'), ('long'))
SELECT doc_id, form, CAST(CASE WHEN doc_id % 5 = 1 THEN 422 ELSE 200 END AS BIGINT) AS status,
  CAST(CASE WHEN doc_id % 5 <= 1 THEN 0 ELSE len(lines) END AS BIGINT) AS n_vectors FROM requests, forms""",
    "absent_model": f"""WITH {_TURNS}
SELECT conv_id, turn, CAST(CASE WHEN model = 'qwen' THEN 503 ELSE 200 END AS BIGINT) AS status,
  CASE WHEN model = 'qwen' THEN 'qwen model server unavailable: weights missing' ELSE '' END AS detail,
  CAST(CASE WHEN model = 'qwen' THEN 0 ELSE 1 END AS BIGINT) AS n_vectors FROM turns WHERE model <> 'nomodel'""",
    "written_responses": f"""WITH {_MODELS},
  payloads AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'gemma' WHEN 1 THEN 'qwen' END AS model,
      unnest([0, 1]) AS position, unnest([text, left(text, length(text) // 2)]) AS payload FROM benchmark),
  src AS (SELECT item_id, position, native, room, 128 AS width, qp || payload AS seen FROM payloads JOIN models USING (model)),
  {_hashed("item_id, position")}, {_digest("item_id, position")}
SELECT item_id, CAST(position AS BIGINT) AS position, coalesce(nnz, 0) AS nnz, coalesce(round(chk, 6) + 0, 0) AS chk
FROM src LEFT JOIN digest USING (item_id, position)""",
    "dead_letters": f"""WITH {_MODELS}, {_DOC_LINES},
  faults AS (SELECT doc_id, line, model, {_fault("dp || payload", 1)} AS fault FROM lines JOIN models USING (model)),
  firsts AS (SELECT doc_id, model, arg_min(fault, line) AS fault FROM faults WHERE fault IS NOT NULL GROUP BY ALL)
SELECT doc_id, CAST({_FAULT_STATUS} AS BIGINT) AS status, {_FAULT_DETAIL} AS detail FROM firsts""",
    "validate_vectors": f"""WITH v AS (SELECT vec_id, CASE vec_id % 10
      WHEN 0 THEN list_transform(embedding, lambda x: x * 2)
      WHEN 1 THEN list_transform(embedding, lambda x: CAST(0 AS FLOAT))
      WHEN 2 THEN list_transform(embedding, lambda x: CAST('NaN' AS FLOAT))
      WHEN 3 THEN embedding[1:32] ELSE embedding END AS v FROM embeddings),
  n AS (SELECT vec_id, v, {_norm("v")} AS n FROM v)
SELECT vec_id, len(v) = 64 AS dim_ok, abs(n - 1) < 1e-3 AND NOT isnan(n) AS norm_ok, n = 0 AS is_zero FROM n""",
    "vectors_pass": f"""WITH n AS (SELECT len(embedding) = 64 AND abs({_norm("embedding")} - 1) < 1e-3 AS ok FROM embeddings)
SELECT count(*) AS n_vectors, count(*) FILTER (NOT ok) AS n_bad, bool_and(ok) AS passed FROM n""",
    "validate_counts": f"""WITH {_FAULTY}
SELECT conv_id, n_payloads, CASE WHEN status = 200 THEN n_payloads ELSE 0 END AS n_vectors,
  status = 200 AS count_ok FROM outcomes""",
    "status_rollup": f"""WITH {_FAULTY},
  counts AS (SELECT m.model, m.build, count(*) FILTER (status = 200) AS n_ok, count(*) FILTER (status >= 500) AS n_failed,
      count(*) FILTER (status = 503) AS n_loading, count(*) FILTER (status = 503 AND detail LIKE '%unavailable%') AS n_gone
      FROM models m LEFT JOIN outcomes USING (model) GROUP BY ALL)
SELECT model, build AS file, n_ok, n_failed,
  CASE WHEN n_gone > 0 THEN 'unreachable' WHEN n_loading > 0 THEN 'loading' ELSE 'ok' END AS status,
  (SELECT bool_and(n_loading = 0) FROM counts) AS healthy FROM counts""",
    "canonical_build": """WITH asked AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'q4_k_m' WHEN 2 THEN 'Q5_0'
      WHEN 3 THEN 'q5_K_m' WHEN 4 THEN 'q6_k' WHEN 5 THEN 'q8_0' WHEN 6 THEN 'F16' WHEN 7 THEN 'q3' END AS q FROM documents),
  quants(quant) AS (VALUES ('Q4_K_M'), ('Q5_0'), ('Q5_K_M'), ('Q6_K'), ('Q8_0'), ('f16'))
SELECT doc_id, CASE WHEN q <> '' THEN 'Qwen3-Embedding-8B-' || quant || '.gguf'
    WHEN doc_id % 2 = 1 THEN 'custom.gguf' ELSE 'Qwen3-Embedding-8B-Q4_K_M.gguf' END AS build,
  CASE WHEN q <> '' AND quant IS NULL THEN 'unknown quantisation ' || q END AS build_error
FROM asked LEFT JOIN quants ON lower(q) = lower(quant)""",
    "space_guard": """WITH built AS (SELECT label, CASE WHEN label % 4 = 2 AND vec_id % 2 = 0 THEN 'gemma' ELSE 'qwen' END AS model,
      CASE WHEN label % 4 = 3 AND vec_id % 3 = 1 THEN 'Q8_0' WHEN label % 4 = 3 AND vec_id % 3 = 2 THEN 'f16'
        ELSE 'Q4_K_M' END AS build FROM embeddings)
SELECT CAST(label AS BIGINT) AS index_id, count(DISTINCT model || '/' || build) AS n_spaces,
  count(DISTINCT model || '/' || build) > 1 AS mixed FROM built GROUP BY label""",
    "stale_vectors": """SELECT doc_id, md5(text) AS text_hash FROM documents d WHERE NOT EXISTS (
  SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1 AND l.toxic = 0)""",
    "refresh_vectors": f"""WITH texts AS (SELECT doc_id, text,
      text || CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 0) THEN ' old' ELSE '' END AS old
      FROM documents d),
  seen AS (SELECT doc_id, 'document' AS task, {_GEMMA_DOC} || text AS seen, {_GEMMA_DOC} || old AS earlier FROM texts
      UNION ALL SELECT doc_id, 'query', {_GEMMA_QUERY} || old, {_GEMMA_QUERY} || old FROM texts),
  fitted AS (SELECT *, CASE WHEN len(w) <= 2045 THEN seen ELSE array_to_string(w[1:2045], ' ') END AS a,
      CASE WHEN len(v) <= 2045 THEN earlier ELSE array_to_string(v[1:2045], ' ') END AS b
      FROM (SELECT *, regexp_extract_all(seen, '\\S+') AS w, regexp_extract_all(earlier, '\\S+') AS v FROM seen)),
  src AS (SELECT doc_id, task, 768 AS native, 2045 AS room, 64 AS width, seen FROM seen),
  {_hashed("doc_id, task")}, {_digest("doc_id, task")}
SELECT doc_id, task, CAST(CASE WHEN a <> b THEN 2 ELSE 1 END AS BIGINT) AS n_stored, CAST(1 AS BIGINT) AS n_current,
  coalesce(round(chk, 5) + 0, 0) AS chk FROM fitted LEFT JOIN digest USING (doc_id, task)""",
    "vector_table": f"""WITH {_MODELS}, {_TURNS},
  src AS (SELECT conv_id, turn, model, build, native, room, least(coalesce(width, 768), native) AS width, {_PROMPTED} text AS seen
      FROM turns JOIN models USING (model) WHERE width IS NULL OR width >= 1),
  {_hashed("conv_id, turn")},
  counts AS (SELECT conv_id, turn, count(*) AS nnz FROM cut GROUP BY ALL)
SELECT model, build, CAST(width AS BIGINT) AS dimensions, count(*) AS n_vectors, CAST(width AS BIGINT) AS width,
  CAST(sum(coalesce(nnz, 0)) AS BIGINT) AS nnz
FROM src LEFT JOIN counts USING (conv_id, turn) GROUP BY model, build, width""",
    "stream_embed": f"""WITH src AS (SELECT conv_id, turn, 768 AS native, 2045 AS room, 256 AS width,
      {_GEMMA_DOC} || text AS seen FROM conversations), {_hashed("conv_id, turn")}, {_digest("conv_id, turn")}
SELECT conv_id, turn, coalesce(nnz, 0) AS nnz, coalesce(round(chk, 6) + 0, 0) AS chk
FROM conversations LEFT JOIN digest USING (conv_id, turn)""",
    "stream_dead_letters": f"""WITH {_MODELS}, {_TURNS},
  seen AS (SELECT conv_id, turn, t.model, width, {_fault(_PROMPTED + "text", 4)} AS fault
      FROM turns t LEFT JOIN models USING (model))
SELECT conv_id, turn,
  CAST(CASE WHEN width < 1 THEN 422 WHEN model = 'nomodel' THEN 404 ELSE {_FAULT_STATUS} END AS BIGINT) AS status,
  CASE WHEN width < 1 THEN 'dimensions: input should be greater than or equal to 1'
    WHEN model = 'nomodel' THEN 'Unknown model ''nomodel''; available: gemma, qwen'
    ELSE {_FAULT_DETAIL} END AS detail
FROM seen WHERE width < 1 OR model = 'nomodel' OR fault IS NOT NULL""",
    "stream_once": f"""WITH {_MODELS}, {_TURNS},
  seen AS (SELECT conv_id, turn, t.model, width, {_fault(_PROMPTED + "text", 4)} AS fault
      FROM turns t LEFT JOIN models USING (model))
SELECT conv_id, turn, CAST(1 AS BIGINT) AS n_outcomes,
  CAST(CASE WHEN width < 1 THEN 422 WHEN model = 'nomodel' THEN 404 WHEN fault IS NULL THEN 200 ELSE {_FAULT_STATUS} END AS BIGINT) AS status
FROM seen""",
    "stream_readiness": f"""WITH {_MODELS}, {_TURNS},
  valid AS (SELECT model FROM turns WHERE width IS NULL OR width >= 1)
SELECT model, CAST(CASE model WHEN 'gemma' THEN count(v.model) ELSE 0 END AS BIGINT) AS n_ok,
  CAST(CASE model WHEN 'qwen' THEN count(v.model) ELSE 0 END AS BIGINT) AS n_failed,
  CASE WHEN model = 'qwen' AND count(v.model) > 0 THEN 'unreachable' END AS failed_as
FROM models m LEFT JOIN valid v USING (model) GROUP BY model""",
    "stream_lanes": """SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'query' ELSE 'document' END AS lane,
  CASE WHEN turn % 3 = 2 THEN 'response_parts' ELSE 'outcomes' END AS place, CAST(turn % 3 + 1 AS BIGINT) AS n_vectors
FROM conversations""",
    "plugin_tokens": f"""WITH seen AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'qwen' ELSE 'gemma' END AS model,
      CASE WHEN lang = 'en' THEN text ELSE {_GEMMA_DOC} || text END AS prompted FROM documents),
  counted AS (SELECT doc_id, model, (length(prompted) + 1) // 2 + CASE model WHEN 'gemma' THEN 2 ELSE 1 END AS n,
      CASE model WHEN 'gemma' THEN 2047 ELSE 8191 END AS most FROM seen)
SELECT doc_id, model, n AS n_tokens, CAST(least(n, most) AS BIGINT) AS kept_tokens FROM counted""",
    "document_windows": """WITH words AS (SELECT doc_id, unnest([0, 8]) AS overlap, regexp_extract_all(text, '\\S+\\s*') AS w,
      length(regexp_extract(text, '^\\s*')) AS lead FROM documents),
  sized AS (SELECT *, len(w) AS n, (len(w) + 3) // 4 AS size, greatest(1, (len(w) + 3) // 4 - overlap) AS step FROM words WHERE len(w) > 0),
  cut AS (SELECT *, unnest(range(CAST(ceil(greatest(n - size, 0) / step) AS BIGINT) + 1)) AS k FROM sized)
SELECT doc_id, CAST(overlap AS BIGINT) AS overlap, k AS "window",
  lead + coalesce(CAST(list_sum(list_transform(w[1:k * step], lambda x: length(x))) AS BIGINT), 0) AS start,
  CAST(len(w[k * step + 1:k * step + size]) AS BIGINT) AS n_tokens,
  md5(regexp_replace(array_to_string(w[k * step + 1:k * step + size], ''), '\\s+$', '')) AS digest FROM cut""",
}
