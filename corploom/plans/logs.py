"""Readers of listings, reports and run logs: lines in, typed rows out."""

from __future__ import annotations

from .tables import sql_query


_REPORT = "concat(if(page_id % 3 = 0, 'rejected', 'accepted'), '\t', page_id, '\trust\tMIT', if(page_id % 3 = 0, concat('\treason ', page_id), ''))"
sql_query("policy_report_read", f"SELECT f[0] AS status, f[1] AS id, f[3] AS license, get(f, 4) AS reason FROM (SELECT split({_REPORT}, '\\t') AS f FROM {{pages}})",
          "SELECT CASE WHEN page_id % 3 = 0 THEN 'rejected' ELSE 'accepted' END AS status, page_id::VARCHAR AS id, 'MIT' AS license, CASE WHEN page_id % 3 = 0 THEN 'reason ' || page_id END AS reason FROM {pages}")
sql_query("summary_kv_read", r"SELECT page_id, try_cast(m['steps'] AS BIGINT) AS steps, try_cast(m['tokens'] AS BIGINT) AS tokens, m['finished'] = 'yes' AS finished FROM (SELECT page_id, str_to_map(concat('steps ', page_id, '\ntokens ', if(page_id % 5 = 0, 'x', CAST(page_id * 2048 AS STRING)), '\nfinished ', if(page_id % 2 = 0, 'yes', 'no')), '\n', ' ') AS m FROM {pages})",
          "SELECT page_id, page_id AS steps, CASE WHEN page_id % 5 > 0 THEN page_id * 2048 END AS tokens, page_id % 2 = 0 AS finished FROM {pages}")
sql_query("log_compare_runners", "SELECT user_id, a, b, coalesce(a = b, false) AS same FROM (SELECT user_id, if(event_id % 2 = 0, 'a', 'b') AS runner, length(event_type) AS value FROM {events}) PIVOT (max(value) FOR runner IN ('a' AS a, 'b' AS b))",
          "SELECT user_id, max(length(event_type)) FILTER (event_id % 2 = 0)::INT AS a, max(length(event_type)) FILTER (event_id % 2 = 1)::INT AS b, coalesce(max(length(event_type)) FILTER (event_id % 2 = 0) = max(length(event_type)) FILTER (event_id % 2 = 1), false) AS same FROM {events} GROUP BY user_id")
sql_query("log_train_report", "SELECT round(ln(4096D), 6) AS uninformed, min_by(value, event_id) AS first_loss, max_by(value, event_id) AS last_loss, max(value) AS worst, max_by(event_id, value) AS at_step FROM {events}",
          "SELECT round(ln(4096::DOUBLE), 6) AS uninformed, arg_min(value, event_id) AS first_loss, arg_max(value, event_id) AS last_loss, max(value) AS worst, arg_max(event_id, value) AS at_step FROM {events}")
