"""The same queries in SQL over the same tables."""

from __future__ import annotations

#: Canonical events, as the adapter makes them.
EV = """
base AS (SELECT event_id AS id, epoch_us(ts) // 1000 AS ts_ms, 'u' || user_id AS session_id, 'ws' || (user_id % 10) AS workspace_id,
  event_type AS raw, value, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
typed AS (SELECT *, CASE raw WHEN 'click' THEN 'chat' WHEN 'signup' THEN 'completion' WHEN 'purchase' THEN 'accept'
  WHEN 'error' THEN CASE WHEN k % 2 = 0 THEN 'retry' ELSE 'reject' END
  ELSE CASE k % 3 WHEN 0 THEN 'read_file' WHEN 1 THEN 'edit' ELSE 'tool_call' END END AS event_type FROM base),
ev AS (SELECT *,
  CASE WHEN event_type IN ('chat', 'completion') THEN value END AS token_count,
  CASE WHEN event_type IN ('read_file', 'edit') THEN 'file' || k END AS path,
  CASE WHEN event_type = 'tool_call' THEN 'tool' || (k % 7) END AS tool,
  CASE WHEN event_type IN ('tool_call', 'accept', 'retry') THEN 'c' || (k % 10) END AS tool_call_id,
  CASE WHEN event_type = 'chat' THEN session_id || '-' || k END AS prompt_id,
  CASE WHEN event_type = 'chat' THEN value * 2 END AS context_token,
  CASE WHEN event_type = 'chat' THEN value * (k % 4) / 4 END AS history_token,
  CASE WHEN k % 5 = 0 THEN 'lang' || (k % 3) END AS language,
  CASE WHEN k % 11 = 0 THEN 'b' || (k % 2) END AS branch,
  CASE WHEN event_type = 'edit' THEN CAST(k AS DOUBLE) END AS loc,
  CASE WHEN k % 13 = 0 THEN CAST(k % 6 AS DOUBLE) END AS dependency_count FROM typed)"""

#: Events with their places and neighbours.
ORD = (
    EV
    + """,
ord0 AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY session_id) AS n, lag(event_type) OVER w AS prev_type, lead(event_type) OVER w AS next_type,
  lag(ts_ms) OVER w AS prev_ts, lead(ts_ms) OVER w AS next_ts, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS run_start
  FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY ts_ms, id)),
ord AS (SELECT *, sum(run_start) OVER (PARTITION BY session_id ORDER BY ts_ms, id) AS run,
  max(CASE WHEN event_type IN ('chat', 'completion') THEN pos END) OVER (PARTITION BY session_id) AS last_ask FROM ord0)"""
)

SF = """
sf AS (SELECT session_id, min(ts_ms) AS first_ts, max(ts_ms) AS last_ts, count(*) FILTER (event_type = 'completion') AS completion_count,
  count(*) FILTER (event_type = 'retry') AS retry_count, count(*) FILTER (event_type = 'accept') AS accept_count, count(*) FILTER (event_type = 'reject') AS reject_count FROM ev GROUP BY 1),
ses AS (SELECT *, last_ts - first_ts AS duration, CASE WHEN accept_count + reject_count > 0 THEN accept_count / (accept_count + reject_count) ELSE 0 END AS accept_rate,
  CASE WHEN completion_count > 0 THEN retry_count / completion_count ELSE 0 END AS retry_rate FROM sf)"""

BF = """
tc AS (SELECT session_id, event_type, count(*) AS c FROM ev GROUP BY 1, 2),
ent AS (SELECT session_id, sum(c) AS n, -sum(c / t * ln(c / t)) AS h FROM (SELECT *, sum(c) OVER (PARTITION BY session_id) AS t FROM tc) GROUP BY 1),
rl AS (SELECT session_id, max(c) AS longest FROM (SELECT session_id, run, count(*) AS c FROM ord WHERE event_type = 'retry' GROUP BY 1, 2) GROUP BY 1),
bq AS (SELECT session_id, count(*) AS workflow_length, count(*) FILTER (event_type IN ('chat', 'completion')) AS asks,
  count(*) FILTER (event_type IN ('read_file', 'open_file') AND pos < last_ask) AS reads, count(*) FILTER (event_type = 'retry') AS retries,
  max(CASE WHEN event_type = 'retry' THEN pos END) AS lr, min(CASE WHEN event_type = 'retry' THEN pos END) AS fr, count(*) FILTER (prev_type <> event_type) AS switches,
  sum(coalesce(token_count, 0)) AS tokens, count(*) FILTER (prev_type = 'accept') AS af, count(*) FILTER (prev_type = 'accept' AND event_type = 'edit') AS ea FROM ord GROUP BY 1),
beh AS (SELECT bq.session_id, CASE WHEN asks > 0 THEN reads / asks ELSE 0 END AS avg_read_before_ask, CASE WHEN retries > 1 THEN (lr - fr) / (retries - 1) ELSE 0 END AS avg_retry_distance,
  CASE WHEN workflow_length > 1 THEN switches / (workflow_length - 1) ELSE 0 END AS tool_switch_frequency, tokens / workflow_length AS context_expansion_speed,
  CASE WHEN workflow_length > 1 THEN h / ln(workflow_length) ELSE 0 END AS workflow_entropy, CASE WHEN retries > 0 THEN longest / retries ELSE 0 END AS retry_burst_score,
  CASE WHEN af > 0 THEN ea / af ELSE 0 END AS edit_after_accept_ratio, workflow_length FROM bq JOIN ent USING (session_id) LEFT JOIN rl USING (session_id))"""

VIEW = f"{ORD}, {SF}, {BF}"

FC = (
    VIEW
    + """,
lst AS (SELECT session_id, arg_max(event_type, (ts_ms, id)) AS last_type FROM ev GROUP BY 1),
fc AS (SELECT session_id, CASE WHEN retry_burst_score > 0.5 AND retry_rate > 0.3 THEN 'retry_loop' WHEN context_expansion_speed > 500 OR (retry_rate > 0.3 AND context_expansion_speed > 200) THEN 'context_explosion'
  WHEN workflow_entropy < 0.7 AND retry_rate > 0.2 THEN 'wrong_context' WHEN last_type = 'reject' AND accept_count = 0 THEN 'user_cancel' ELSE 'none' END AS failure_type,
  retry_burst_score, retry_rate, context_expansion_speed FROM ses JOIN beh USING (session_id) JOIN lst USING (session_id))"""
)

STEPS = EV + """, steps AS (SELECT * FROM (SELECT session_id, event_type AS from_type, lead(event_type) OVER (PARTITION BY session_id ORDER BY ts_ms, id) AS to_type FROM ev) WHERE to_type IS NOT NULL),
cnt AS (SELECT from_type, to_type, count(*) AS c FROM steps GROUP BY 1, 2), mk AS (SELECT from_type, to_type, c AS count, c / sum(c) OVER (PARTITION BY from_type) AS probability FROM cnt),
fst AS (SELECT event_type, count(*) AS count FROM (SELECT session_id, arg_min(event_type, (ts_ms, id)) AS event_type FROM ev GROUP BY 1) GROUP BY 1)"""

PATHS = EV + """, pth AS (SELECT session_id, string_agg(event_type, '>' ORDER BY ts_ms, id) AS path, arg_max(event_type, (ts_ms, id)) AS last_type, bool_or(event_type = 'retry') AS has_retry, bool_or(event_type = 'accept') AS has_accept
  FROM (SELECT *, lag(event_type) OVER (PARTITION BY session_id ORDER BY ts_ms, id) AS b FROM ev) WHERE b IS NULL OR b <> event_type GROUP BY 1)"""

DAILY = EV + """, dly AS (SELECT CAST(epoch_ms(ts_ms) AS DATE) AS day, count(*) AS event_count, count(DISTINCT session_id) AS session_count, count(*) FILTER (event_type = 'completion') AS co,
  count(*) FILTER (event_type = 'retry') AS re, count(*) FILTER (event_type = 'accept') AS ac, count(*) FILTER (event_type = 'reject') AS rj, sum(coalesce(token_count, 0)) AS tk FROM ev GROUP BY 1),
daily AS (SELECT day, CASE WHEN ac + rj > 0 THEN ac / (ac + rj) ELSE 0 END AS accept_rate, CASE WHEN co > 0 THEN re / co ELSE 0 END AS retry_rate, floor(tk / event_count + 0.5) AS avg_tokens, session_count, event_count FROM dly),
lng AS (SELECT 'accept_rate' AS metric, day, accept_rate AS v FROM daily UNION ALL SELECT 'retry_rate', day, retry_rate FROM daily UNION ALL SELECT 'avg_tokens', day, avg_tokens FROM daily UNION ALL SELECT 'session_count', day, session_count FROM daily),
nmb AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY day) - 1 AS x, row_number() OVER (PARTITION BY metric ORDER BY day DESC) AS back FROM lng),
trd AS (SELECT metric, regr_slope(v, x) AS slope, avg(v) AS mean, avg(v) FILTER (back <= 7) AS rolling_avg FROM nmb GROUP BY 1),
tr2 AS (SELECT *, CASE WHEN slope > 0.001 * mean THEN 'increasing' WHEN slope < -0.001 * mean THEN 'decreasing' ELSE 'stable' END AS direction FROM trd)"""

GRAPH = ORD + """,
oc AS (SELECT id, session_id, ts_ms, event_type, completion_id FROM (SELECT *, last_value(CASE WHEN event_type = 'completion' THEN id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts_ms, id ROWS UNBOUNDED PRECEDING) AS completion_id FROM ev) WHERE event_type IN ('accept', 'reject', 'retry')),
seg AS (SELECT *, sum(CASE WHEN event_type = 'chat' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts_ms DESC, id DESC ROWS UNBOUNDED PRECEDING) AS g FROM ev WHERE event_type IN ('chat', 'read_file', 'open_file')),
pf AS (SELECT DISTINCT r.session_id, c.id AS prompt_event_id, r.path FROM seg r JOIN seg c ON r.session_id = c.session_id AND r.g = c.g AND c.event_type = 'chat' WHERE r.event_type <> 'chat'),
tu AS (SELECT DISTINCT session_id, coalesce(nullif(tool, ''), event_type) AS tool_name FROM ev WHERE event_type IN ('tool_call', 'run_test', 'terminal', 'commit')),
fl AS (SELECT DISTINCT session_id, path FROM ev WHERE event_type IN ('read_file', 'open_file', 'edit') AND path <> '')"""

SIZE = EV + """,
sz0 AS (SELECT session_id, coalesce(sum(CASE WHEN event_type = 'chat' THEN coalesce(nullif(token_count, 0), nullif(context_token, 0)) WHEN event_type = 'completion' THEN nullif(token_count, 0) END), 0) AS told,
  coalesce(bool_or(event_type = 'chat' AND coalesce(nullif(token_count, 0), nullif(context_token, 0)) IS NOT NULL), false) AS real_, count(*) FILTER (event_type = 'chat') AS chats,
  count(*) FILTER (event_type = 'tool_call') AS tool_calls, count(*) FILTER (event_type = 'read_file') AS read_files, count(*) FILTER (event_type = 'edit') AS edits, count(*) FILTER (event_type = 'retry') AS retries,
  count(DISTINCT CASE WHEN event_type = 'read_file' THEN path END) AS ufr, count(DISTINCT CASE WHEN event_type = 'edit' THEN path END) AS ufe, max(ts_ms) - min(ts_ms) AS span,
  list(tool ORDER BY ts_ms, id) FILTER (event_type = 'tool_call') AS seq FROM ev GROUP BY 1),
sz1 AS (SELECT *, told + CASE WHEN NOT real_ AND chats > 0 THEN 2000 + 500 * chats + 200 * ufr ELSE 0 END AS prompt_tokens, len(coalesce(seq, [])) AS l FROM sz0),
size AS (SELECT session_id, prompt_tokens, 0.0 AS completion_tokens, prompt_tokens AS context_tokens, tool_calls, read_files, edits, retries, ufr AS unique_files_read, ufe AS unique_files_edited,
  least(CAST(span AS DOUBLE), 86400000) AS elapsed_ms, prompt_tokens / 256000 AS context_utilization, CASE WHEN edits > 0 THEN read_files / edits ELSE read_files END AS read_to_edit_ratio,
  CASE WHEN tool_calls > 0 THEN retries / tool_calls ELSE 0 END AS retry_rate,
  CASE WHEN l >= 8 AND ((seq[l-1:l] = seq[l-3:l-2] AND seq[l-3:l-2] = seq[l-5:l-4]) OR (l >= 9 AND seq[l-2:l] = seq[l-5:l-3] AND seq[l-5:l-3] = seq[l-8:l-6])
    OR (l >= 12 AND seq[l-3:l] = seq[l-7:l-4] AND seq[l-7:l-4] = seq[l-11:l-8]) OR (l >= 15 AND seq[l-4:l] = seq[l-9:l-5] AND seq[l-9:l-5] = seq[l-14:l-10])) THEN 1 ELSE 0 END AS has_loop,
  0.0 AS sub_agents, 0.0 AS auto_label_code, 0.0 AS auto_confidence FROM sz1),
cx AS (SELECT *, prompt_tokens / 1000 + tool_calls * 2 + edits * 15 + retries * 50 + has_loop * 100 AS complexity FROM size)"""

HIST = SIZE + """,
ht AS (SELECT session_id, any_value(workspace_id) AS workspace_id, min(ts_ms) AS started, count(*) AS n, count(*) FILTER (event_type = 'accept') AS a, count(*) FILTER (event_type IN ('accept', 'retry', 'reject')) AS f FROM ev GROUP BY 1),
hs AS (SELECT ht.session_id, workspace_id, started, CASE WHEN f > 0 THEN a / f ELSE 0 END AS accept_rate, (n < 3 AND a = 0) AS cancelled, prompt_tokens AS total_tokens, elapsed_ms AS duration, retry_rate FROM ht JOIN size USING (session_id))"""

LOG = """
b0 AS (SELECT event_id AS id, epoch_us(ts) // 1000 AS ts_ms, 'u' || user_id AS session_id, event_type AS raw, value, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
b1 AS (SELECT *, CASE raw WHEN 'click' THEN 'llm_request' WHEN 'purchase' THEN 'edit' WHEN 'view' THEN 'tool_call' WHEN 'error' THEN CASE WHEN k % 2 = 0 THEN 'tool_call' ELSE 'error' END
  ELSE CASE k % 10 WHEN 0 THEN 'session_start' WHEN 1 THEN 'session_end' ELSE 'tool_result' END END AS type FROM b0),
lg AS (SELECT *, CASE WHEN type = 'tool_call' THEN CASE WHEN k % 4 = 0 THEN 'read_file' ELSE 'tool' || (k % 3) END END AS tool,
  CASE WHEN type = 'tool_call' AND k % 4 = 0 THEN 'file' || k END AS read_path, CASE WHEN type = 'edit' THEN 'file' || k END AS edit_file,
  CASE WHEN type = 'llm_request' THEN value * 100 ELSE 0 END AS pt, CASE WHEN type = 'llm_request' THEN value * 10 ELSE 0 END AS ct,
  CASE WHEN (type = 'tool_call' AND raw = 'error') OR (type = 'edit' AND k % 5 = 0) THEN 1 ELSE 0 END AS failed FROM b1),
st0 AS (SELECT *, row_number() OVER (PARTITION BY session_id, read_path ORDER BY ts_ms, id) AS rr, row_number() OVER (PARTITION BY session_id, edit_file ORDER BY ts_ms, id) AS re FROM lg),
st AS (SELECT *, row_number() OVER w AS version, sum(pt) OVER w AS sum_prompt, sum(ct) OVER w AS sum_completion, count(CASE WHEN type = 'tool_call' THEN 1 END) OVER w AS tool_calls, count(read_path) OVER w AS read_files,
  count(edit_file) OVER w AS edits, sum(failed) OVER w AS retries, sum(CASE WHEN read_path IS NOT NULL AND rr = 1 THEN 1 ELSE 0 END) OVER w AS files_read, sum(CASE WHEN edit_file IS NOT NULL AND re = 1 THEN 1 ELSE 0 END) OVER w AS files_edited,
  (sum(pt) OVER w + sum(ct) OVER w) / 256000 AS usage, ts_ms - min(ts_ms) OVER w AS elapsed_ms, list(tool) FILTER (type = 'tool_call') OVER w AS tools
  FROM st0 WINDOW w AS (PARTITION BY session_id ORDER BY ts_ms, id ROWS UNBOUNDED PRECEDING)),
fin AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts_ms DESC, id DESC) = 1),
fin2 AS (SELECT *, coalesce(tools, [])[-12:] AS rt FROM fin),
loops AS (SELECT session_id, list_sum([len([i FOR i IN range(1, len(rt) - 2 * n + 2) IF rt[i:i+n-1] = rt[i+n:i+2*n-1]]) FOR n IN [2, 3, 4, 5]]) AS loops FROM fin2),
al AS (SELECT session_id, id, unnest([
  CASE WHEN type = 'llm_request' AND usage >= 0.8 THEN 'context-too-large:' || CASE WHEN usage >= 0.95 THEN 'critical' ELSE 'warning' END END,
  CASE WHEN read_path IS NOT NULL AND read_files >= 20 THEN 'read-file-storm:warning' END,
  CASE WHEN type = 'tool_call' AND len(tools) >= 8 AND tools[-2:] = tools[-4:-3] AND tools[-2:] = tools[-6:-5] AND tools[-2:] = tools[-8:-7] THEN 'tool-loop:warning' END,
  CASE WHEN failed = 1 AND retries >= 3 THEN 'retry-spike:warning' END,
  CASE WHEN type = 'llm_request' AND pt >= 10000 THEN 'prompt-explosion:warning' END,
  CASE WHEN type = 'edit' AND value >= 100 THEN 'large-diff:info' END,
  CASE WHEN type = 'llm_request' AND k % 10 = 0 THEN 'model-switch:info' END]) AS a FROM st)"""

VOTES = """
lbl AS (SELECT l.doc_id AS entity_id, quality, n_chars FROM labels l JOIN documents USING (doc_id)),
votes AS (SELECT entity_id, 'size' AS source, CASE WHEN n_chars < 1000 THEN 'mini' WHEN n_chars < 4000 THEN 'medium' ELSE 'large' END AS label, 0.7 AS confidence FROM lbl
  UNION ALL SELECT entity_id, 'quality', CASE WHEN quality = 1 THEN 'large' ELSE 'mini' END, 0.6 FROM lbl
  UNION ALL SELECT entity_id, 'id', ['mini', 'medium', 'large'][entity_id % 3 + 1], 0.5 FROM lbl)"""

SCORED = """
s0 AS (SELECT doc_id, quality AS actual, 1 / (1 + exp(-(n_chars / 1000.0 - 2) / 2)) AS p1 FROM labels JOIN documents USING (doc_id)),
scored AS (SELECT *, 1 - p1 AS p0, CAST(p1 >= 0.5 AS INT) AS predicted, greatest(p1, 1 - p1) AS confidence, CAST((CAST(p1 >= 0.5 AS INT) = actual) AS INT) AS correct FROM s0)"""

CONFUSION = SCORED + """, cls AS (SELECT unnest([0, 1]) AS class),
cm AS (SELECT class, sum(CASE WHEN actual = class AND predicted = class THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN actual = class THEN 1 ELSE 0 END) AS support, sum(CASE WHEN predicted = class THEN 1 ELSE 0 END) AS guessed FROM scored, cls GROUP BY 1),
pr AS (SELECT class, CASE WHEN guessed > 0 THEN tp / guessed ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r, support, guessed FROM cm WHERE support + guessed > 0),
f1 AS (SELECT class, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1, support FROM pr)"""

HALVES = """
bl AS (SELECT * FROM lineitem WHERE l_orderkey % 2 = 0), cu AS (SELECT * FROM lineitem WHERE l_orderkey % 2 = 1 AND l_quantity > 5),
al AS (SELECT 'b' AS side, l_quantity, l_extendedprice, l_discount FROM bl UNION ALL SELECT 'c', l_quantity, l_extendedprice, l_discount FROM cu),
lo AS (UNPIVOT al ON l_quantity, l_extendedprice, l_discount INTO NAME feature VALUE v),
sp AS (SELECT feature, min(v) AS mn, max(v) AS mx FROM lo GROUP BY 1),
bi AS (SELECT feature, side, least(floor((v - mn) / ((mx - mn) / 10)), 9) AS bin, count(*) AS n FROM lo JOIN sp USING (feature) WHERE mn < mx GROUP BY 1, 2, 3),
gr AS (SELECT feature, b AS bin FROM sp, (SELECT unnest(range(10)) AS b)),
pc AS (SELECT g.feature, g.bin, coalesce(x.n, 0) AS b, coalesce(y.n, 0) AS c FROM gr g LEFT JOIN bi x ON x.feature = g.feature AND x.bin = g.bin AND x.side = 'b' LEFT JOIN bi y ON y.feature = g.feature AND y.bin = g.bin AND y.side = 'c'),
pp AS (SELECT feature, (b + 0.5) / (sum(b) OVER w + 5) AS pb, (c + 0.5) / (sum(c) OVER w + 5) AS pc FROM pc WINDOW w AS (PARTITION BY feature)),
psi AS (SELECT feature, abs(sum((pc - pb) * ln(pc / pb))) AS psi FROM pp GROUP BY 1)"""

_WITH_BEHAVIOR = f"WITH {VIEW} SELECT session_id, round({{c}}, 6) AS {{c}} FROM beh"


def _behavior(column: str) -> str:
    return _WITH_BEHAVIOR.format(c=column)


_R = lambda *names: ", ".join(f"round({n}, 6) AS {n.split('.')[-1]}" for n in names)
_BEH = ("avg_read_before_ask", "avg_retry_distance", "tool_switch_frequency", "context_expansion_speed", "workflow_entropy", "retry_burst_score", "edit_after_accept_ratio")
_ROI = ("duration", "completion_count", "retry_count", "accept_count", "reject_count", "accept_rate", "retry_rate", *_BEH, "workflow_length")
_SES = "session_id, first_ts, last_ts, completion_count, retry_count, accept_count, reject_count, duration, " + _R("accept_rate", "retry_rate")
_LOG1 = lambda c: f"CASE WHEN {c} > 0 THEN ln(1 + {c}) ELSE 0 END"
VECTORS = (
    VIEW
    + f""", v0 AS (SELECT session_id, [workflow_entropy, retry_burst_score, tool_switch_frequency, edit_after_accept_ratio, {', '.join(map(_LOG1, ('avg_read_before_ask', 'avg_retry_distance', 'context_expansion_speed', 'workflow_length')))}, accept_rate, {_LOG1('retry_rate')}]::DOUBLE[] AS x FROM ses JOIN beh USING (session_id)),
vec AS (SELECT session_id, CASE WHEN list_dot_product(x, x) > 0 THEN list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) ELSE x END AS x FROM v0)"""
)
_COS = lambda a, b: f"list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"

ORACLES: dict[str, str] = {
    "event_type_counts": f"WITH {EV} SELECT event_type, count(*) AS n FROM ev GROUP BY 1",
    "distinct_sessions": f"WITH {EV} SELECT DISTINCT session_id FROM ev",
    "events_by_type_limit": f"WITH {EV} SELECT id, ts_ms, session_id FROM ev WHERE event_type = 'chat' ORDER BY ts_ms, id LIMIT 1000",
    "events_in_range": f"WITH {EV} SELECT id, ts_ms, event_type FROM ev WHERE workspace_id = 'ws3' AND ts_ms BETWEEN 1704153600000 AND 1704758400000",
    "json_predicate": "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS INT) > 90",
    "session_features": f"WITH {EV}, {SF} SELECT {_SES} FROM ses",
    "tool_features": f"WITH {EV} SELECT session_id, 0::BIGINT AS terminal_calls, 0::BIGINT AS git_calls, 0::BIGINT AS mcp_calls, count(*) FILTER (event_type IN ('read_file', 'edit', 'tool_call')) AS filesystem_calls FROM ev GROUP BY 1",
    "prompt_features": f"""WITH {EV}, f AS (SELECT prompt_id AS prompt, arg_min({{'s': session_id, 't': ts_ms, 'k': token_count, 'c': context_token, 'h': history_token}}, (ts_ms, id)) AS f FROM ev WHERE event_type = 'chat' GROUP BY 1)
      SELECT prompt, f.s AS session_id, f.t AS ts_ms, round(coalesce(f.k, 0), 6) AS token_count, round(coalesce(f.c, 0), 6) AS context_token, round(coalesce(f.h, 0), 6) AS history_token, 0.0::DOUBLE AS retrieved_files, 0.0::DOUBLE AS retrieved_symbols,
      round(CASE WHEN f.c <> 0 THEN f.k / f.c ELSE 0 END, 6) AS prompt_density, round(CASE WHEN f.k <> 0 THEN f.h / f.k ELSE 0 END, 6) AS history_ratio FROM f""",
    "workspace_features": f"""WITH {EV}, w AS (SELECT workspace_id, count(DISTINCT path) AS files, count(DISTINCT language) AS language_count, count(DISTINCT branch) AS branch_count, coalesce(sum(loc), 0) AS total_loc, coalesce(max(dependency_count), 0) AS dependency_count FROM ev GROUP BY 1)
      SELECT workspace_id, language_count, branch_count, round(total_loc, 6) AS total_loc, round(dependency_count, 6) AS dependency_count, greatest(files, 1) AS total_files, round(0.4 * ln(greatest(files, 1)) + 0.3 * language_count + 0.3 * dependency_count, 6) AS complexity FROM w""",
    "behavior_read_before_ask": _behavior("avg_read_before_ask"),
    "behavior_retry_distance": _behavior("avg_retry_distance"),
    "behavior_switch_freq": _behavior("tool_switch_frequency"),
    "behavior_ctx_speed": _behavior("context_expansion_speed"),
    "behavior_entropy": _behavior("workflow_entropy"),
    "behavior_retry_burst": _behavior("retry_burst_score"),
    "behavior_edit_after_accept": _behavior("edit_after_accept_ratio"),
    "session_view": f"WITH {VIEW} SELECT {_SES}, {_R(*_BEH)}, workflow_length FROM ses LEFT JOIN beh USING (session_id)",
    "failure_classes": f"WITH {FC} SELECT session_id, failure_type, round(CASE failure_type WHEN 'retry_loop' THEN least(1, retry_burst_score + retry_rate) WHEN 'context_explosion' THEN least(1, context_expansion_speed / 1000) WHEN 'wrong_context' THEN 0.6 WHEN 'user_cancel' THEN 0.8 ELSE 0 END, 6)::DOUBLE AS confidence FROM fc",
    "failure_runs": f"""WITH {ORD}, r AS (SELECT session_id, run, count(*) AS length, min(ts_ms) AS ts_ms FROM ord WHERE event_type = 'retry' GROUP BY 1, 2 HAVING count(*) >= 3),
      e AS (SELECT session_id, arg_max(event_type, (ts_ms, id)) AS t, arg_max(ts_ms, (ts_ms, id)) AS ts_ms, count(*) FILTER (event_type = 'accept') AS a FROM ev GROUP BY 1)
      SELECT session_id, 'retry_loop' AS failure_type, 0.7::DOUBLE AS confidence, length, ts_ms FROM r UNION ALL SELECT session_id, 'user_cancel', 0.8, 1, ts_ms FROM e WHERE t = 'reject' AND a = 0""",
    "markov_transitions": f"WITH {STEPS} SELECT from_type, to_type, count, round(probability, 6) AS probability FROM mk",
    "markov_start_dist": f"WITH {STEPS} SELECT event_type, count, round(count / sum(count) OVER (), 6) AS probability FROM fst",
    "markov_anomaly": f"WITH {STEPS} SELECT sum(count)::BIGINT AS transitions, count(*) AS distinct_transitions, round(least(1, sum(-ln(round(probability, 4) + 1e-10) * count) / sum(count) / 5), 6) AS anomaly_score FROM mk",
    "sequence_logprob": f"WITH {STEPS} SELECT session_id, count(*) AS steps, round(sum(ln(coalesce(probability, 0) + 1e-10)), 6) AS log_probability FROM steps LEFT JOIN mk USING (from_type, to_type) GROUP BY 1",
    "markov_typical_workflow": f"""WITH RECURSIVE {STEPS}, bst AS (SELECT from_type, arg_max({{'t': to_type, 'p': probability}}, (probability, to_type)) AS b FROM mk GROUP BY 1),
      sd AS (SELECT event_type, count / sum(count) OVER () AS probability FROM fst ORDER BY count DESC, event_type DESC LIMIT 1),
      go AS (SELECT 1 AS pos, event_type, probability FROM sd UNION ALL SELECT pos + 1, b.t, b.p FROM go JOIN bst ON bst.from_type = go.event_type WHERE pos < 8 AND go.event_type <> 'session_end' AND b.p >= 0.01)
      SELECT pos, event_type, round(probability, 6) AS probability FROM go""",
    "dfg_edges": f"WITH {STEPS} SELECT a.from_type, a.to_type, a.c AS frequency, round((a.c - coalesce(b.c, 0)) / (a.c + coalesce(b.c, 0) + 1), 6) AS dependency FROM cnt a LEFT JOIN cnt b ON a.from_type = b.to_type AND a.to_type = b.from_type",
    "dfg_nodes": f"WITH {STEPS} SELECT event_type, count(*) AS frequency, (SELECT count(*) FROM cnt WHERE to_type = event_type) AS in_degree, (SELECT count(*) FROM cnt WHERE from_type = event_type) AS out_degree FROM ev GROUP BY 1",
    "workflow_variants": f"WITH {PATHS} SELECT path AS variant, count(*) AS frequency FROM pth GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "failure_patterns": f"WITH {PATHS} SELECT path AS pattern, count(*) AS frequency FROM pth WHERE (has_retry AND NOT has_accept) OR last_type = 'reject' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
    "daily_metrics": f"WITH {DAILY} SELECT day, {_R('accept_rate', 'retry_rate', 'avg_tokens')}, session_count, event_count FROM daily",
    "trend_slopes": f"WITH {DAILY} SELECT metric, round(slope, 6) AS slope, direction, round(CASE WHEN mean <> 0 THEN abs(slope) / mean ELSE 0 END, 6) AS magnitude, round(rolling_avg, 6) AS rolling_avg FROM tr2",
    "trend_summary": f"""WITH {DAILY}, d AS (SELECT max(CASE WHEN metric = 'accept_rate' THEN direction END) AS a, max(CASE WHEN metric = 'retry_rate' THEN direction END) AS r FROM tr2)
      SELECT (SELECT count(*) FROM daily) AS days_analyzed, (SELECT sum(session_count) FROM daily)::BIGINT AS total_sessions, (SELECT sum(event_count) FROM daily)::BIGINT AS total_events,
      CASE WHEN a = 'increasing' AND r <> 'increasing' THEN 'improving' WHEN r = 'increasing' AND a <> 'increasing' THEN 'declining' ELSE 'stable' END AS health_direction FROM d""",
    "rolling7": f"WITH {DAILY} SELECT day, round(avg(accept_rate) OVER (ORDER BY day ROWS 6 PRECEDING), 6) AS rolling FROM daily",
    "context_roi": f"""WITH {VIEW}, vw AS (SELECT * FROM ses JOIN beh USING (session_id)), rr AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, CASE WHEN stddev_pop({c}) > 0 AND stddev_pop(accept_rate) > 0 THEN corr({c}, accept_rate) ELSE 0 END AS contribution FROM vw" for c in _ROI)})
      SELECT feature, round(contribution, 6) AS contribution FROM rr WHERE abs(contribution) > 0.1 ORDER BY abs(contribution) DESC, feature LIMIT 8""",
    "outcome_to_completion_asof": f"WITH {GRAPH} SELECT * FROM oc",
    "prompt_file_links": f"WITH {GRAPH} SELECT * FROM pf",
    "tool_call_pairing": f"""WITH {EV}, d AS (SELECT session_id, tool_call_id, max(ts_ms) AS done_ts FROM ev WHERE event_type IN ('accept', 'retry') GROUP BY 1, 2)
      SELECT session_id, tool_call_id, id, ts_ms, done_ts, CASE WHEN done_ts IS NULL THEN 0 ELSE greatest(done_ts - ts_ms, 0) END AS took_ms FROM ev LEFT JOIN d USING (session_id, tool_call_id) WHERE event_type = 'tool_call'""",
    "graph_node_stats": f"""WITH {GRAPH} SELECT 'session' AS type, count(DISTINCT session_id) AS n FROM ev UNION ALL SELECT 'workspace', count(DISTINCT workspace_id) FROM ev
      UNION ALL SELECT 'prompt', count(*) FROM ev WHERE event_type = 'chat' UNION ALL SELECT 'completion', count(*) FROM ev WHERE event_type = 'completion'
      UNION ALL SELECT event_type, count(*) FROM oc GROUP BY 1 UNION ALL SELECT 'file', count(DISTINCT path) FROM fl UNION ALL SELECT 'tool', count(*) FROM tu""",
    "graph_edge_stats": f"""WITH {GRAPH} SELECT 'session_workspace' AS type, count(DISTINCT session_id) AS n FROM ev UNION ALL SELECT 'session_prompt', count(*) FROM ev WHERE event_type = 'chat'
      UNION ALL SELECT 'session_completion', count(*) FROM ev WHERE event_type = 'completion' UNION ALL SELECT 'session_file', count(*) FROM fl UNION ALL SELECT 'session_tool', count(*) FROM tu
      UNION ALL SELECT 'completion_outcome', count(*) FROM oc WHERE completion_id IS NOT NULL UNION ALL SELECT 'prompt_file', count(*) FROM pf""",
    "graph_neighbors": f"WITH {GRAPH} SELECT 'file:' || path AS node_id, 'file' AS type, path AS name FROM fl WHERE session_id = 'u5'",
    "graph_two_hop": f"WITH {GRAPH} SELECT 'session:' || session_id AS source, count(*) AS n FROM oc WHERE completion_id IS NOT NULL GROUP BY 1",
    "retry_recovery": f"WITH {GRAPH} SELECT session_id, count(*) FILTER (event_type = 'retry') AS retry_count, count(*) FILTER (event_type = 'accept') AS accept_count FROM oc WHERE completion_id IS NOT NULL GROUP BY 1 HAVING retry_count >= 3 AND accept_count > 0",
    "workspace_failures": f"WITH {FC} SELECT workspace_id, count(*) AS total_sessions, count(*) FILTER (failure_type <> 'none') AS failed_sessions FROM (SELECT DISTINCT session_id, workspace_id FROM ev) JOIN fc USING (session_id) GROUP BY 1 HAVING failed_sessions > 0",
    "tool_impact": f"WITH {GRAPH}, {SF} SELECT tool_name, count(*) AS session_count, round(avg(accept_rate), 6) AS avg_accept_rate, round(avg(retry_rate), 6) AS avg_retry_rate FROM tu JOIN ses USING (session_id) GROUP BY 1",
    "failure_clusters": f"""WITH {FC}, fd AS (SELECT session_id, failure_type FROM fc WHERE failure_type <> 'none'),
      fw AS (SELECT failure_type, workspace_id AS v, count(*) AS n FROM fd JOIN (SELECT DISTINCT session_id, workspace_id FROM ev) USING (session_id) GROUP BY 1, 2),
      ff AS (SELECT failure_type, path AS v, count(*) AS n FROM fd JOIN (SELECT DISTINCT session_id, path FROM ev WHERE event_type IN ('read_file', 'edit')) USING (session_id) GROUP BY 1, 2),
      tw AS (SELECT failure_type, string_agg(v, ',' ORDER BY n DESC, v) AS s FROM (SELECT * FROM fw QUALIFY row_number() OVER (PARTITION BY failure_type ORDER BY n DESC, v) <= 3) GROUP BY 1),
      tf AS (SELECT failure_type, string_agg(v, ',' ORDER BY n DESC, v) AS s FROM (SELECT * FROM ff QUALIFY row_number() OVER (PARTITION BY failure_type ORDER BY n DESC, v) <= 5) GROUP BY 1)
      SELECT failure_type, count(*) AS session_count, any_value(tw.s) AS top_workspaces, any_value(tf.s) AS top_files FROM fd LEFT JOIN tw USING (failure_type) LEFT JOIN tf USING (failure_type) GROUP BY 1""",
    "session_embedding": f"WITH {VECTORS} SELECT session_id, unnest(range(10))::INT AS pos, round(unnest(x), 6) AS x FROM vec",
    "similar_sessions": f"WITH {VECTORS} SELECT a.session_id, round({_COS('a.x', 'b.x')}, 6) AS similarity FROM vec a, vec b WHERE b.session_id = 'u5' AND a.session_id <> 'u5' ORDER BY {_COS('a.x', 'b.x')} DESC, 1 LIMIT 5",
    "cosine_topk": f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings) SELECT a.vec_id, round({_COS('a.x', 'b.x')}, 6) AS similarity FROM e a, e b WHERE b.vec_id = 7 ORDER BY {_COS('a.x', 'b.x')} DESC, 1 LIMIT 10",
    "knn_vote": f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), p AS (SELECT q.vec_id AS query, a.vec_id, a.label, greatest(1 - {_COS('a.x', 'q.x')}, 1e-10) AS d FROM e a, e q WHERE q.vec_id % 50 = 0 AND a.vec_id <> q.vec_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, vec_id) AS r FROM p QUALIFY r <= 5), s AS (SELECT query, max(CASE WHEN r = 3 THEN d END) AS s FROM r GROUP BY 1),
      v AS (SELECT query, label, sum(exp(-(d * d) / (s * s))) AS w FROM r JOIN s USING (query) GROUP BY 1, 2), t AS (SELECT *, w / sum(w) OVER (PARTITION BY query) AS p FROM v)
      SELECT query, arg_max(label, (p, -label)) AS predicted, round(max(p), 6) AS confidence FROM t GROUP BY 1""",
    "label_propagation_step": """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN label END AS label, embedding::DOUBLE[] AS x FROM embeddings), k AS (SELECT DISTINCT label AS class FROM embeddings WHERE label IS NOT NULL), kn AS (SELECT count(*) AS n FROM k),
      p AS (SELECT a.vec_id, b.label AS bl, exp(-(list_dot_product(a.x, a.x) + list_dot_product(b.x, b.x) - 2 * list_dot_product(a.x, b.x)) / 2) AS w FROM e a, e b WHERE a.vec_id <> b.vec_id),
      g AS (SELECT vec_id, bl, sum(w) AS w FROM p GROUP BY 1, 2), t AS (SELECT vec_id, sum(w) AS total, coalesce(sum(CASE WHEN bl IS NULL THEN w END), 0) AS open FROM g GROUP BY 1)
      SELECT e.vec_id, class::INT AS class, round(CASE WHEN e.label IS NULL THEN (coalesce(g.w, 0) + open / n) / total WHEN e.label = class THEN 1 ELSE 0 END, 6)::DOUBLE AS p FROM e JOIN t USING (vec_id) CROSS JOIN k CROSS JOIN kn LEFT JOIN g ON g.vec_id = e.vec_id AND g.bl = class""",
    "model_size_features": f"WITH {SIZE} SELECT session_id, " + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in "prompt_tokens completion_tokens context_tokens tool_calls read_files edits retries unique_files_read unique_files_edited elapsed_ms context_utilization read_to_edit_ratio retry_rate has_loop sub_agents auto_label_code auto_confidence".split()) + " FROM size",
    "temporal_features": f"""WITH {ORD}, cd AS (SELECT session_id, tool_call_id, max(ts_ms) AS done_ts FROM ev WHERE event_type IN ('accept', 'retry') GROUP BY 1, 2),
      t AS (SELECT o.*, coalesce(next_ts, ts_ms) - ts_ms AS until, ts_ms - prev_ts AS gap, done_ts FROM ord o LEFT JOIN cd USING (session_id, tool_call_id)),
      g AS (SELECT session_id, min(ts_ms) AS s, coalesce(sum(CASE WHEN event_type = 'chat' THEN until END), 0) AS cd_, coalesce(sum(CASE WHEN event_type = 'tool_call' THEN CASE WHEN done_ts IS NULL THEN 0 ELSE greatest(done_ts - ts_ms, 0) END WHEN event_type = 'read_file' THEN until END), 0) AS td,
      least(coalesce(sum(CASE WHEN gap > 5000 THEN gap END), 0), 3600000) AS idle, count(*) FILTER (event_type = 'chat') AS ch, count(*) FILTER (event_type IN ('tool_call', 'read_file')) AS tl, count(*) FILTER (event_type = 'accept') AS a, count(*) FILTER (event_type IN ('accept', 'retry', 'reject')) AS f FROM t GROUP BY 1)
      SELECT session_id, hour(epoch_ms(s))::INT AS hour_of_day, dayofweek(epoch_ms(s))::INT AS day_of_week, CAST(dayofweek(epoch_ms(s)) IN (0, 6) AS INT) AS is_weekend, round(cd_, 6)::DOUBLE AS chat_duration_ms, round(td, 6)::DOUBLE AS tool_duration_ms, idle::BIGINT AS idle_ms,
      round(CASE WHEN tl > 0 THEN ch / tl ELSE ch END, 6)::DOUBLE AS chat_to_tool_ratio, round(CASE WHEN f > 0 THEN a / f ELSE 0 END, 6)::DOUBLE AS accept_rate, round(CASE WHEN f > 0 THEN a / f ELSE 0 END, 6)::DOUBLE AS tool_success_rate FROM g""",
    "rolling_session_stats": f"""WITH {HIST} SELECT session_id, round(coalesce(avg(total_tokens) OVER r, 0), 6) AS rolling_avg_tokens, round(coalesce(avg(duration) OVER r, 0), 6) AS rolling_avg_duration, round(coalesce(avg(accept_rate) OVER r, 0), 6) AS rolling_accept_rate,
      round(coalesce(avg(CAST(cancelled AS INT)) OVER b, 0), 6) AS cancel_rate, count(*) OVER (PARTITION BY workspace_id, started // 86400000 ORDER BY started, session_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sessions_today FROM hs
      WINDOW r AS (PARTITION BY workspace_id ORDER BY started, session_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY workspace_id ORDER BY started, session_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "session_ema": f"""WITH {HIST}, l AS (SELECT session_id, list(total_tokens) OVER r AS t, list(retry_rate) OVER r AS q FROM hs WINDOW r AS (PARTITION BY workspace_id ORDER BY started, session_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
      SELECT session_id, round(coalesce(CASE WHEN len(t) > 0 THEN list_reduce(t, lambda s, x: 0.3 * x + 0.7 * s) END, 0), 6) AS ema_tokens, round(coalesce(CASE WHEN len(q) > 0 THEN list_reduce(q, lambda s, x: 0.3 * x + 0.7 * s) END, 0), 6) AS ema_retry_rate FROM l""",
    "heuristic_label": f"WITH {SIZE} SELECT session_id, round(complexity, 6) AS complexity, CASE WHEN complexity <= 20 THEN 'mini' WHEN complexity <= 60 THEN 'medium' ELSE 'large' END AS label FROM cx",
    "behavior_label": f"""WITH {SIZE}, c AS (SELECT session_id, count(*) AS n, count(*) FILTER (event_type = 'accept') AS a, count(*) FILTER (event_type = 'retry') AS r, count(*) FILTER (event_type = 'reject') AS j, count(*) FILTER (event_type = 'chat') AS t FROM ev GROUP BY 1),
      w AS (SELECT cx.*, a, r, j, t, a - 0.3 * r - 0.5 * j + CASE WHEN n < 3 AND elapsed_ms < 30000 THEN -0.8 ELSE 0 END + CASE WHEN a = 0 AND t <= 1 AND r = 0 THEN -1.0 ELSE 0 END AS total FROM c JOIN cx USING (session_id)),
      y AS (SELECT *, CASE WHEN a + r + j + t > 0 THEN total / (a + r + j + t) ELSE total END AS reward FROM w)
      SELECT session_id, round(reward, 6)::DOUBLE AS reward, CASE WHEN a + r + j > 0 AND reward < 0 THEN 'large' WHEN complexity <= 20 THEN 'mini' WHEN complexity <= 60 THEN 'medium' ELSE 'large' END AS label, CASE WHEN a + r + j > 0 THEN 'behavior' ELSE 'heuristic' END AS label_source FROM y""",
    "weak_label_fusion": f"""WITH {VOTES}, w AS (SELECT entity_id, label, CASE source WHEN 'size' THEN 0.8 / (0.2 + 1e-8) WHEN 'quality' THEN 0.7 / (0.3 + 1e-8) ELSE 0.4 / (0.6 + 1e-8) END AS w FROM votes),
      c AS (SELECT entity_id, [sum(w * CASE WHEN label = 'mini' THEN 0.9 ELSE 0.05 END) / sum(w), sum(w * CASE WHEN label = 'medium' THEN 0.9 ELSE 0.05 END) / sum(w), sum(w * CASE WHEN label = 'large' THEN 0.9 ELSE 0.05 END) / sum(w)] AS p FROM w GROUP BY 1)
      SELECT entity_id, ['mini', 'medium', 'large'][list_position(p, list_max(p))] AS label, round(list_max(p), 6) AS confidence FROM c""",
    "source_accuracy": f"""WITH {VOTES}, v AS (SELECT *, list_position(['mini', 'medium', 'large'], label) - 1 AS c FROM votes), k AS (SELECT entity_id, c, count(*) AS n FROM v GROUP BY 1, 2), m AS (SELECT entity_id, sum(n) AS t, arg_max(c, (n, -c)) AS m FROM k GROUP BY 1)
      SELECT source, count(*) AS votes, round(avg(CAST(c = m AS INT)), 6) AS accuracy FROM v JOIN m USING (entity_id) WHERE t >= 2 GROUP BY 1""",
    "weighted_fusion": f"""WITH {VOTES}, s AS (SELECT entity_id, {', '.join(f"coalesce(sum(CASE WHEN label = '{m}' THEN confidence END), 0)::DOUBLE / sum(confidence)::DOUBLE AS {m}" for m in ('mini', 'medium', 'large'))} FROM votes GROUP BY 1)
      SELECT entity_id, {_R('mini', 'medium', 'large')}, CASE WHEN mini = greatest(mini, medium, large) THEN 'mini' WHEN medium = greatest(mini, medium, large) THEN 'medium' ELSE 'large' END AS model, round(greatest(mini, medium, large), 6) AS confidence FROM s""",
    "bayesian_fusion": f"""WITH {VOTES}, s AS (SELECT entity_id, {', '.join(f"sum(ln(greatest(CASE WHEN label = '{m}' THEN confidence ELSE (1 - confidence) / 2 END, 1e-9)::DOUBLE)) AS {m}" for m in ('mini', 'medium', 'large'))} FROM votes GROUP BY 1),
      e AS (SELECT entity_id, exp(mini - greatest(mini, medium, large)) AS a, exp(medium - greatest(mini, medium, large)) AS b, exp(large - greatest(mini, medium, large)) AS c FROM s), p AS (SELECT entity_id, a / (a + b + c) AS mini, b / (a + b + c) AS medium, c / (a + b + c) AS large FROM e)
      SELECT entity_id, {_R('mini', 'medium', 'large')}, CASE WHEN mini = greatest(mini, medium, large) THEN 'mini' WHEN medium = greatest(mini, medium, large) THEN 'medium' ELSE 'large' END AS model, round(greatest(mini, medium, large), 6) AS confidence FROM p""",
    "stacking_fusion": f"""WITH {VOTES}, s AS (SELECT entity_id, {', '.join(f"coalesce(sum(CASE WHEN label = '{m}' THEN CASE source WHEN 'size' THEN 0.5::DOUBLE WHEN 'quality' THEN 0.3 ELSE 0.2 END * confidence END), 0)::DOUBLE AS {m}" for m in ('mini', 'medium', 'large'))} FROM votes GROUP BY 1),
      p AS (SELECT entity_id, mini / (mini + medium + large) AS mini, medium / (mini + medium + large) AS medium, large / (mini + medium + large) AS large FROM s)
      SELECT entity_id, {_R('mini', 'medium', 'large')}, CASE WHEN mini = greatest(mini, medium, large) THEN 'mini' WHEN medium = greatest(mini, medium, large) THEN 'medium' ELSE 'large' END AS model, round(greatest(mini, medium, large), 6) AS confidence FROM p""",
    "confusion_metrics": f"WITH {CONFUSION} SELECT class::INT AS class, round(p, 6)::DOUBLE AS precision, round(r, 6)::DOUBLE AS recall, round(f1, 6)::DOUBLE AS f1, support::BIGINT AS support FROM f1",
    "evaluation_summary": f"WITH {CONFUSION} SELECT (SELECT round(avg(correct), 6) FROM scored) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM f1 WHERE support > 0",
    "ece": f"WITH {SCORED}, b AS (SELECT least(floor(confidence * 10), 9) AS b, count(*) AS n, avg(confidence) AS c, avg(correct) AS a FROM scored GROUP BY 1) SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM b",
    "brier": f"WITH {SCORED} SELECT round(sum(pow(p0 - CASE WHEN actual = 0 THEN 1 ELSE 0 END, 2) + pow(p1 - CASE WHEN actual = 1 THEN 1 ELSE 0 END, 2)) / (count(*) * 2), 6) AS brier FROM scored",
    "temperature_grid": f"""WITH {SCORED}, g AS (SELECT t, actual, exp(ln(greatest(p0, 1e-9)) / t) AS a, exp(ln(greatest(p1, 1e-9)) / t) AS b FROM scored, (SELECT unnest([0.5, 1.0, 1.5, 2.0, 3.0])::DOUBLE AS t))
      SELECT t, round(avg(-ln(greatest(CASE WHEN actual = 0 THEN a ELSE b END / (a + b), 1e-9))), 6) AS nll FROM g GROUP BY 1""",
    "psi_drift": f"WITH {HALVES} SELECT feature, round(psi, 6) AS psi FROM psi",
    "drift_report": f"WITH {HALVES} SELECT round(max(psi), 6) AS max_psi, round(avg(psi), 6) AS avg_psi, count(*) FILTER (psi > 0.1) AS drifted_features, CASE WHEN max(psi) > 0.25 OR avg(psi) > 0.1 THEN 'retrain' WHEN max(psi) > 0.1 THEN 'monitor' ELSE 'stable' END AS recommendation FROM psi",
    "kl_drift": """WITH q AS (SELECT l_returnflag AS f, count(*) / sum(count(*)) OVER () AS q FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1), p AS (SELECT l_returnflag AS f, count(*) / sum(count(*)) OVER () AS p FROM lineitem WHERE l_orderkey % 2 = 1 AND l_quantity > 5 GROUP BY 1)
      SELECT round(abs(sum(p * ln(p / q))), 6) AS kl FROM p JOIN q USING (f)""",
    "concept_drift": """WITH o AS (SELECT avg(l_quantity) AS a, avg(l_extendedprice) AS b, avg(l_discount) AS c FROM lineitem WHERE l_orderkey % 2 = 0), n AS (SELECT avg(l_quantity) AS a, avg(l_extendedprice) AS b, avg(l_discount) AS c FROM lineitem WHERE l_orderkey % 2 = 1 AND l_quantity > 5),
      s AS (SELECT 'l_quantity' AS f, abs(n.a - o.a) / abs(o.a) AS s FROM o, n UNION ALL SELECT 'l_extendedprice', abs(n.b - o.b) / abs(o.b) FROM o, n UNION ALL SELECT 'l_discount', abs(n.c - o.c) / abs(o.c) FROM o, n), a AS (SELECT avg(s) AS v, arg_max(f, s) AS w FROM s)
      SELECT round(v, 6) AS avg_shift, w AS worst_feature, CASE WHEN v >= 0.6 THEN 'high' WHEN v >= 0.3 THEN 'medium' WHEN v >= 0.15 THEN 'low' ELSE 'none' END AS severity FROM a""",
    "model_drift": f"WITH {SCORED}, a AS (SELECT avg(correct) AS a FROM scored) SELECT round(a, 6) AS accuracy, round(0.9 - a, 6) AS drop, CASE WHEN 0.9 - a >= 0.1 THEN 'high' WHEN 0.9 - a >= 0.05 THEN 'medium' WHEN 0.9 - a >= 0.025 THEN 'low' ELSE 'none' END AS severity FROM a",
    "ablation": f"WITH {SIZE} SELECT session_id, 'prompt_tokens' AS feature, round(prompt_tokens / 1000, 6)::DOUBLE AS contribution FROM size UNION ALL SELECT session_id, 'tool_calls', tool_calls * 2.0 FROM size UNION ALL SELECT session_id, 'edits', edits * 15.0 FROM size",
    "running_state": f"WITH {LOG} SELECT id, session_id, version::INT AS version, round(sum_prompt, 6) AS sum_prompt, round(sum_completion, 6) AS sum_completion, tool_calls, read_files, edits, retries::BIGINT AS retries, files_read::BIGINT AS files_read, files_edited::BIGINT AS files_edited, round(usage, 6) AS usage, elapsed_ms FROM st",
    "streaming_session_state": f"WITH {LOG} SELECT session_id, version AS events, round(sum_prompt, 6) AS sum_prompt, round(sum_completion, 6) AS sum_completion, tool_calls, read_files, edits, retries::BIGINT AS retries, ts_ms - elapsed_ms AS first_ms, ts_ms AS last_ms, round(usage, 6) AS usage FROM fin",
    "rule_alerts": f"WITH {LOG} SELECT session_id, split_part(a, ':', 1) AS rule_id, split_part(a, ':', 2) AS severity, count(*) AS n FROM al WHERE a IS NOT NULL GROUP BY 1, 2, 3",
    "health_score": f"""WITH {LOG}, h AS (SELECT session_id, CAST(floor((1 - least(usage, 1)) * 100 * 0.4 + (1 - CASE WHEN tool_calls > 0 THEN retries / tool_calls ELSE 0 END) * 100 * 0.2 + CASE WHEN coalesce(loops, 0) > 0 THEN 30 ELSE 100 END * 0.2
      + (1 - least(elapsed_ms / 60000, 1)) * 100 * 0.1 + (1 - least(sum_prompt / 50000, 1)) * 100 * 0.1 + 0.5) AS INT) AS health FROM fin2 LEFT JOIN loops USING (session_id))
      SELECT session_id, health, CASE WHEN health >= 90 THEN 'Excellent' WHEN health >= 75 THEN 'Good' WHEN health >= 50 THEN 'Warning' ELSE 'Critical' END AS health_label FROM h""",
    "advice": f"""WITH {LOG}, c AS (SELECT session_id, sum_prompt, tool_calls, files_edited, retries, CASE WHEN sum_prompt < 8000 THEN 10 WHEN sum_prompt < 30000 THEN 30 ELSE 50 END + CASE WHEN tool_calls <= 5 THEN 5 ELSE 20 END + CASE WHEN files_edited <= 2 AND files_read <= 5 THEN 5 ELSE 20 END + CASE WHEN retries > 0 THEN 15 ELSE 0 END AS x FROM fin),
      m AS (SELECT *, CASE WHEN sum_prompt < 8000 AND tool_calls <= 5 AND files_edited <= 2 AND retries = 0 AND x <= 30 THEN 'mini' WHEN x <= 60 THEN 'medium' ELSE 'large' END AS model FROM c)
      SELECT session_id, least(x, 100)::INT AS complexity, model, CASE model WHEN 'mini' THEN 0.85 WHEN 'medium' THEN 0.7 ELSE 0.75 END::DOUBLE AS confidence, CASE model WHEN 'mini' THEN 60 WHEN 'medium' THEN 25 ELSE 0 END::INT AS saving_percent FROM m""",
    "live_metrics": f"""WITH {LOG}, lm AS (SELECT fin2.*, coalesce(loops, 0) AS lps, len(rt) AS l FROM fin2 LEFT JOIN loops USING (session_id)) SELECT session_id, id, lps::INT AS loops, CASE WHEN tool_calls > 0 THEN round(len(list_distinct(rt)) / tool_calls, 6) ELSE 0 END::DOUBLE AS tool_diversity,
      (l >= 8 AND ((rt[-2:] = rt[-4:-3] AND rt[-4:-3] = rt[-6:-5]) OR (l >= 9 AND rt[-3:] = rt[-6:-4] AND rt[-6:-4] = rt[-9:-7]) OR (l >= 12 AND rt[-4:] = rt[-8:-5] AND rt[-8:-5] = rt[-12:-9])))::INT AS loop_detected, round(sum_prompt + sum_completion, 6) AS context_tokens, tool_calls, round(sum_prompt * 5 + sum_completion * 15, 6) AS cost, elapsed_ms AS latency, retries::BIGINT AS retries, round(usage, 6) AS context_usage,
      round(CASE WHEN tool_calls + edits > 0 THEN retries / (tool_calls + edits) ELSE 0 END, 6)::DOUBLE AS retry_rate, round(least(sum_prompt / 50000, 1), 6) AS prompt_growth_rate, round(least((files_read + files_edited) / 30, 1), 6) AS file_entropy, 0.0::DOUBLE AS subagent_pressure FROM lm""",
    "multi_health": f"""WITH {LOG}, l AS (SELECT *, len(rt) AS l, CASE WHEN tool_calls + edits > 0 THEN retries / (tool_calls + edits) ELSE 0 END AS rate FROM fin2),
      m AS (SELECT *, l >= 8 AND ((rt[-2:] = rt[-4:-3] AND rt[-4:-3] = rt[-6:-5]) OR (l >= 9 AND rt[-3:] = rt[-6:-4] AND rt[-6:-4] = rt[-9:-7]) OR (l >= 12 AND rt[-4:] = rt[-8:-5] AND rt[-8:-5] = rt[-12:-9])) AS lp FROM l)
      , h AS (SELECT session_id, floor((1 - rate) * 60 + CASE WHEN lp THEN 10 ELSE 40 END + 0.5)::DOUBLE AS h_execution, floor(100 - least(sum_prompt / 50000, 1) * 60 + 0.5)::DOUBLE AS h_reasoning, floor((1 - least(usage, 1)) * 100 + 0.5)::DOUBLE AS h_context,
        floor((1 - least(CASE WHEN tool_calls > 0 THEN len(list_distinct(rt)) / tool_calls ELSE 0 END, 1) / 2) * 50 + CASE WHEN lp THEN 15 ELSE 50 END + 0.5)::DOUBLE AS h_tool, 90::DOUBLE AS h_planning, floor(100 - least(least((files_read + files_edited) / 30, 1) * 100, 60) + 0.5)::DOUBLE AS h_memory FROM m)
      SELECT *, floor((h_execution + h_reasoning + h_context + h_tool + h_planning + h_memory) / 6 + 0.5)::DOUBLE AS overall FROM h""",
    "prediction_triggers": f"""WITH RECURSIVE {LOG}, e AS (SELECT session_id, id, ts_ms, version, sum_prompt + sum_completion AS tk FROM st),
      f AS (SELECT session_id, 0::BIGINT AS v, min(ts_ms) AS lts, 0::BIGINT AS lv, 0.0::DOUBLE AS lt, NULL::BIGINT AS id, NULL::VARCHAR AS reason FROM e GROUP BY 1
        UNION ALL SELECT session_id, v, CASE WHEN r IS NULL THEN lts ELSE ts_ms END, CASE WHEN r IS NULL THEN lv ELSE v END, CASE WHEN r IS NULL THEN lt ELSE tk END, id, r FROM (
          SELECT e.session_id, e.version AS v, e.ts_ms, e.tk, e.id, f.lts, f.lv, f.lt, CASE WHEN e.version - f.lv >= 5 THEN 'events' WHEN e.tk - f.lt >= 5000 THEN 'tokens' WHEN e.ts_ms - f.lts >= 30000 AND e.version > f.lv THEN 'time' END AS r FROM f JOIN e ON e.session_id = f.session_id AND e.version = f.v + 1))
      SELECT session_id, id, reason FROM f WHERE reason IS NOT NULL""",
    "phase_timeline": f"""WITH {LOG}, n AS (SELECT *, CASE type WHEN 'session_start' THEN 'Planning' WHEN 'tool_call' THEN 'CallingTool' WHEN 'tool_result' THEN 'WaitingTool' WHEN 'edit' THEN 'Editing' WHEN 'error' THEN 'Failed' END AS nm FROM lg),
      b AS (SELECT *, count(nm) OVER (PARTITION BY session_id ORDER BY ts_ms, id ROWS UNBOUNDED PRECEDING) AS g FROM n),
      i AS (SELECT *, coalesce(max(nm) OVER w, 'Idle') AS ba, bool_or(type = 'llm_request') OVER w AS th, bool_or(type = 'session_end') OVER w AS en FROM b WINDOW w AS (PARTITION BY session_id, g ORDER BY ts_ms, id ROWS UNBOUNDED PRECEDING)),
      p AS (SELECT *, CASE WHEN ba = 'Failed' THEN ba WHEN en THEN 'Finished' WHEN ba = 'Planning' AND th THEN 'Thinking' ELSE ba END AS phase FROM i),
      t AS (SELECT *, lag(phase) OVER (PARTITION BY session_id ORDER BY ts_ms, id) AS pp FROM p), c AS (SELECT session_id, id, ts_ms, type, phase FROM t WHERE pp IS NULL OR pp <> phase)
      SELECT *, lead(ts_ms) OVER (PARTITION BY session_id ORDER BY ts_ms, id) - ts_ms AS held_ms FROM c""",
    "loop_detection": f"""WITH {SIZE} SELECT session_id, has_loop = 1 AS has_loop,
      l >= 4 AND (coalesce(seq[greatest(l - 9, 1):][-2:] = seq[greatest(l - 9, 1):][-4:-3], false) OR (l >= 6 AND seq[-3:] = seq[-6:-4]) OR (l >= 8 AND seq[-4:] = seq[-8:-5]) OR (l >= 10 AND seq[-5:] = seq[-10:-6])) AS repeats FROM size JOIN sz1 USING (session_id) WHERE sz1.tool_calls > 0""",
    "count_loops": f"WITH {SIZE} SELECT session_id, list_sum([len([i FOR i IN range(1, l - 2 * n + 2) IF seq[i:i+n-1] = seq[i+n:i+2*n-1]]) FOR n IN [2, 3, 4, 5]])::INT AS loops FROM sz1 WHERE l > 0",
    "retention_prune": f"WITH {EV} SELECT event_type, count(*) AS n FROM ev WHERE ts_ms >= 1706659200000 - 15 * 86400000 GROUP BY 1",
    "training_matrix": "SELECT doc_id, lang, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)",
    "latest_feature_version": f"WITH {EV} SELECT session_id AS entity_id, id % 3 + 1 AS version, ts_ms AS computed_at, CAST(id AS DOUBLE) AS score FROM ev QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY id % 3 DESC, ts_ms DESC, id DESC) = 1",
    "upsert_latest": f"""WITH {EV}, l AS (SELECT session_id AS entity_id, id % 3 + 1 AS version, ts_ms AS computed_at, CAST(id AS DOUBLE) AS score FROM ev QUALIFY row_number() OVER (PARTITION BY session_id, id % 3 ORDER BY ts_ms DESC, id DESC) = 1)
      SELECT entity_id, version, computed_at, CASE WHEN version = 2 THEN -score ELSE score END AS score FROM l WHERE version < 3""",
    "registry_by_domain": "SELECT * FROM (VALUES ('workspace', 6::BIGINT), ('session', 7), ('prompt', 7), ('tool', 4), ('behavior', 8)) AS t(domain, n)",
    "session_store_events": """SELECT 'c' || conv_id AS session_id, CASE role WHEN 'user' THEN 'chat' WHEN 'assistant' THEN 'completion' ELSE 'session_start' END AS event_type, count(*) AS n, sum(ceil(length(text) / 4)) AS tokens FROM conversations WHERE role IN ('user', 'assistant', 'system') GROUP BY 1, 2""",
    "order_trend": "WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS price FROM orders GROUP BY 1) SELECT round(regr_slope(price, day - DATE '1992-01-01'), 4) AS slope, count(*) AS days FROM d",
    "customer_part_paths": "SELECT c_mktsegment, p_brand, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
}
ORACLES |= {"streaming_triggers": ORACLES["prediction_triggers"], "rehydrated_states": ORACLES["running_state"]}

ORACLES["streaming_rule_alerts"] = ORACLES["rule_alerts"]
ORACLES["label_propagation_all"] = ORACLES["label_propagation_step"]
