"""Queries over the readers of logs, reports and settings: texts made from the pages, some with planted faults, and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spdx
from ..session import table
from ..sources import buildlogs, reports, settings
from .registry import query


def _pages(spark, d, value: str, *more: str) -> DataFrame:
    """(path, value): one text for each page, by an SQL expression."""
    return table(spark, d, "pages").where("page_id is not null").selectExpr("CAST(page_id AS STRING) AS path", f"{value} AS value", *more)


# -- benchmarks: four times a page, one of them without a name on its line ----------------------------

_BENCH = r"""concat('Warning: ', page_id, '\nsum/unit-8\n    time:   [1.0 us ', page_id + 1, '.5 us 9.0 us]\n    thrpt:  [1 elem/s ', page_id, ' elem/s 2 elem/s]\nFound ', page_id % 7, ' outliers among 100 measurements\n',
  if(page_id % 3 = 0, 'sum/baseline-c-8  time: [1 ns 500 ns 700 ns]\n', ''), 'sum/fast  time: [0.1 ms 0.25 ms 0.3 ms]\n', if(page_id % 4 = 0, 'thread panicked at x\npanicked at y\n', ''), 'alone\n  time: [1 s 2 s ', page_id, ' s]')"""
_TIMES = """SELECT page_id, 'sum/unit-8' AS name, 1000.0 AS low_ns, (page_id + 1.5) * 1000 AS mid_ns, 9000.0 AS high_ns, page_id || ' elem/s' AS throughput, page_id % 7 AS outliers, 0 AS k FROM pages
UNION ALL SELECT page_id, 'sum/baseline-c-8', 1, 500, 700, NULL, 0, 1 FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 'sum/fast', 100000, 250000, 300000, NULL, 0, 2 FROM pages
UNION ALL SELECT page_id, 'alone', 1e9, 2e9, page_id * 1e9, NULL, 0, 3 FROM pages"""


def _times(spark, d):
    return buildlogs.benchmarks(_pages(spark, d, _BENCH))


query("log_bench_parse", f"SELECT page_id::VARCHAR AS path, name, round(low_ns, 3)::DOUBLE AS low_ns, round(mid_ns, 3)::DOUBLE AS mid_ns, round(high_ns, 3)::DOUBLE AS high_ns, throughput, outliers::INT AS outliers FROM ({_TIMES})")(
    lambda spark, d: _times(spark, d).select("path", "name", *[F.round(c, 3).alias(c) for c in ("low_ns", "mid_ns", "high_ns")], "throughput", "outliers")
)
_BADGE = "CASE WHEN r <= 1.05 THEN printf('✅ %.2fx', r) || CASE WHEN r < 0.95 THEN ' (faster)' ELSE ' (parity)' END WHEN r <= 1.5 THEN printf('⚠️ %.2fx', r) WHEN r <= 5 THEN printf('❌ %.2fx', r) ELSE printf('🔴 %.1fx slower', r) END"
query("log_bench_ratio", f"""WITH t AS ({_TIMES}), r AS (SELECT page_id, name, k, CASE WHEN k < 3 AND page_id % 3 = 0 THEN 'baseline' WHEN k < 3 THEN 'unit' END AS kind,
CASE WHEN page_id % 3 = 0 AND k IN (0, 2) THEN mid_ns / 500 WHEN page_id % 3 > 0 AND k = 2 THEN mid_ns / ((page_id + 1.5) * 1000) END::DOUBLE AS r FROM t)
SELECT page_id::VARCHAR AS path, name, kind, round(r, 6) AS ratio, CASE WHEN page_id % 3 = 0 THEN round(r, 6) END AS ratio_c, CASE WHEN r IS NOT NULL THEN {_BADGE} END AS badge FROM r""")(
    lambda spark, d: buildlogs.benchmark_ratios(_times(spark, d)).select("path", "name", "kind", F.round("ratio", 6).alias("ratio"), F.round("ratio_c", 6).alias("ratio_c"), buildlogs.badge(F.col("ratio")).alias("badge"))
)
query("log_bench_diagnostics", "SELECT page_id::VARCHAR AS path, 'criterion warning' AS kind, 1 AS count FROM pages UNION ALL SELECT page_id::VARCHAR, 'panic', 2 FROM pages WHERE page_id % 4 = 0")(
    lambda spark, d: buildlogs.benchmark_diagnostics(_pages(spark, d, _BENCH))
)
query("pretty_ns", "SELECT o_orderkey, CASE WHEN ns >= 1e9 THEN printf('%.3f s', ns / 1e9) WHEN ns >= 1e6 THEN printf('%.3f ms', ns / 1e6) WHEN ns >= 1e3 THEN printf('%.3f µs', ns / 1e3) ELSE printf('%.2f ns', ns) END AS text FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 4096 WHEN 2 THEN 4194304 ELSE 4294967296 END * (o_orderkey % 64 + 0.5)::DOUBLE AS ns FROM orders)")(
    lambda spark, d: table(spark, d, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 4096 WHEN 2 THEN 4194304 ELSE 4294967296 END * CAST(o_orderkey % 64 + 0.5 AS DOUBLE) AS ns").select("o_orderkey", buildlogs.pretty_ns(F.col("ns")).alias("text"))
)

# -- interface checks: of five pages the closing line is missing in one and counts one too many in another ----


def _suites(spark, d):
    program = _pages(spark, d, r"concat('ok: opens\nok: reads ', page_id, '\n', if(page_id % 3 = 0, 'FAIL: closes (line 7)\n', ''), CASE page_id % 5 WHEN 0 THEN '' ELSE concat('=== ', if(page_id % 3 = 0, 1, 0) + if(page_id % 5 = 1, 1, 0), ' check(s) failed ===') END)")
    sanitized = _pages(spark, d, "CASE page_id % 4 WHEN 0 THEN concat('==', page_id, '==ERROR: LeakSanitizer: x') WHEN 1 THEN 'a.c:3: runtime error: b' ELSE '' END")
    memory = _pages(spark, d, r"if(page_id % 7 = 0, 'killed', concat('ERROR SUMMARY: ', page_id % 2, ' errors from 1 contexts\n definitely lost: ', page_id % 3, ' bytes in 1 blocks'))", "CAST(page_id % 2 AS INT) AS status")
    cargo = _pages(spark, d, r"concat('running 2 tests\n', if(page_id % 6 = 0, '', concat('test a::t', page_id, ' (line 3) ... ok\ntest b ... ', if(page_id % 2 = 0, 'FAILED', 'ok'), '\n')))")
    return buildlogs.program_checks(program).unionByName(buildlogs.sanitizer_checks(sanitized)).unionByName(buildlogs.memory_checks(memory)).unionByName(buildlogs.cargo_checks(cargo))


query("log_ffi_checks", """WITH c AS (SELECT 'program' AS suite, 2 + (page_id % 3 = 0)::INT + (page_id % 5 < 2)::INT AS total, 2 AS passed FROM pages
UNION ALL SELECT 'sanitizers', 3, CASE WHEN page_id % 4 < 2 THEN 2 ELSE 3 END FROM pages
UNION ALL SELECT 'memory', CASE WHEN page_id % 7 = 0 THEN 1 ELSE 3 END, CASE WHEN page_id % 7 = 0 THEN 0 ELSE 2 * (page_id % 2 = 0)::INT + (page_id % 3 = 0)::INT END FROM pages
UNION ALL SELECT 'cargo', CASE WHEN page_id % 6 = 0 THEN 1 ELSE 2 END, CASE WHEN page_id % 6 = 0 THEN 0 WHEN page_id % 2 = 0 THEN 1 ELSE 2 END FROM pages)
SELECT suite, sum(total)::BIGINT AS total, sum(passed)::BIGINT AS passed, sum(total - passed)::BIGINT AS failed FROM c GROUP BY suite""")(
    lambda spark, d: buildlogs.summarize_checks(_suites(spark, d))
)
query("log_ffi_failures", """SELECT page_id::VARCHAR AS path, 'closes' AS name, 'line 7' AS detail FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id::VARCHAR, 'program ran to completion', 'no closing line: a crash, a link error or a timeout' FROM pages WHERE page_id % 5 = 0
UNION ALL SELECT page_id::VARCHAR, 'the failure count agrees with the FAIL lines', 'the program said ' || (page_id % 3 = 0)::INT + 1 || ', the log has ' || (page_id % 3 = 0)::INT FROM pages WHERE page_id % 5 = 1
UNION ALL SELECT page_id::VARCHAR, 'no LeakSanitizer reports', '' FROM pages WHERE page_id % 4 = 0 UNION ALL SELECT page_id::VARCHAR, 'no UndefinedBehaviorSanitizer reports', 'a.c:3: runtime error: b' FROM pages WHERE page_id % 4 = 1
UNION ALL SELECT page_id::VARCHAR, 'valgrind ran to completion', 'no ERROR SUMMARY line in the log' FROM pages WHERE page_id % 7 = 0 UNION ALL SELECT page_id::VARCHAR, 'valgrind found no errors', '1 error(s)' FROM pages WHERE page_id % 7 > 0 AND page_id % 2 = 1
UNION ALL SELECT page_id::VARCHAR, 'valgrind exit status is 0', 'exit status 1' FROM pages WHERE page_id % 7 > 0 AND page_id % 2 = 1 UNION ALL SELECT page_id::VARCHAR, 'nothing definitely lost', page_id % 3 || ' bytes' FROM pages WHERE page_id % 7 > 0 AND page_id % 3 > 0
UNION ALL SELECT page_id::VARCHAR, 'collected at least one Rust test', 'cargo missing, a compile error, or a filter that matched nothing' FROM pages WHERE page_id % 6 = 0 UNION ALL SELECT page_id::VARCHAR, 'b', '' FROM pages WHERE page_id % 6 IN (2, 4)""")(
    lambda spark, d: _suites(spark, d).where("not passed").select("path", "name", "detail")
)

# -- security reports, trees, documentation -------------------------------------------------------

query("log_security", """SELECT page_id::VARCHAR AS path, 'vulnerability' AS kind, 'ADV-' || page_id AS id, 'p' || page_id % 9 AS package, CASE WHEN page_id % 2 = 0 THEN '>=2, >=1.5' ELSE 'none' END AS patched FROM pages WHERE page_id % 5 > 0
UNION ALL SELECT page_id::VARCHAR, 'yanked', NULL, 'q', NULL FROM pages WHERE page_id % 5 > 0 AND page_id % 3 = 0""")(
    lambda spark, d: buildlogs.advisories(
        _pages(spark, d, """if(page_id % 5 = 0, 'error: no network', concat('{"vulnerabilities":{"list":[{"advisory":{"id":"ADV-', page_id, '","title":"t"},"package":{"name":"p', page_id % 9, '","version":"1"},"versions":{"patched":[', if(page_id % 2 = 0, '">=2",">=1.5"', ''), ']}}]},"warnings":{',
          if(page_id % 3 = 0, '"yanked":[{"package":{"name":"q","version":"3"}}]', '"unsound":[]'), '}}'))""")
    ).select("path", "kind", "id", "package", "patched")
)
query("log_leaks", "SELECT page_id::VARCHAR AS path, 'rule-' || page_id % 4 AS rule, 'src/f.rs' AS file, page_id AS line, substr(sha256(url), 1, 8) AS commit, '2024-02-29' AS date FROM pages WHERE page_id % 3 > 0")(
    lambda spark, d: buildlogs.leaks(_pages(spark, d, "if(page_id % 3 = 0, '[]', to_json(array(named_struct('RuleID', concat('rule-', page_id % 4), 'File', 'src/f.rs', 'StartLine', page_id, 'Commit', sha2(url, 256), 'Date', '2024-02-29T01:02:03Z'))))"))
)
_PATH = "CASE page_id % 8 WHEN 0 THEN 'src/f{p}.rs' WHEN 1 THEN 'target/f{p}.o' WHEN 2 THEN 'web/node_modules/f{p}.js' WHEN 3 THEN 'keys/id_rsa{p}' WHEN 4 THEN '.env.example' WHEN 5 THEN 'w/m{p}.GGUF' WHEN 6 THEN '.github/f{p}.zip' ELSE 'big/f{p}.txt' END"
_SIZE = "CASE WHEN page_id % 8 IN (6, 7) THEN (page_id % 3 + 4) * 1048576 + 1 ELSE page_id END"


def _tree(spark, d):
    return table(spark, d, "pages").selectExpr(f"replace({_PATH}, '{{p}}', CAST(page_id AS STRING)) AS path", f"{_SIZE} AS size")


query("log_hygiene", f"""WITH t AS (SELECT page_id, replace({_PATH}, '{{p}}', page_id::VARCHAR) AS path, {_SIZE} AS size FROM pages)
SELECT 'secret-looking name' AS check, path, 'matches a credential filename' AS detail FROM t WHERE page_id % 8 = 3 UNION ALL SELECT 'weights, data or archive', path, 'extension .gguf' FROM t WHERE page_id % 8 = 5
UNION ALL SELECT 'large file', path, printf('%.1f MiB (limit 5 MiB)', size / 1048576.0) FROM t WHERE page_id % 8 = 7 AND size > 5242880
UNION ALL SELECT 'build artifact', CASE page_id % 8 WHEN 1 THEN 'target/' ELSE 'web/node_modules/' END, count(*) || ' tracked file(s) inside a build directory' FROM t WHERE page_id % 8 IN (1, 2) GROUP BY page_id % 8""")(lambda spark, d: buildlogs.hygiene(_tree(spark, d)))
query("agg_hygiene_buildroots", f"SELECT CASE page_id % 8 WHEN 1 THEN 'target/' ELSE 'web/node_modules/' END AS path, count(*) || ' tracked file(s) inside a build directory' AS detail FROM pages WHERE page_id % 8 IN (1, 2) GROUP BY page_id % 8")(
    lambda spark, d: buildlogs.hygiene(_tree(spark, d)).where("check = 'build artifact'").select("path", "detail")
)
query("agg_unsafe", "SELECT 'f' || page_id || '.rs' AS path, (page_id % 3)::INT AS unsafe_uses, page_id % 5 = 0 AS opts_out FROM pages WHERE page_id % 3 > 0 OR page_id % 5 = 0")(
    lambda spark, d: buildlogs.unsafe_inventory(_pages(spark, d, r"concat('// unsafe\n', repeat('  unsafe { unsafe }\n', CAST(page_id % 3 AS INT)), if(page_id % 5 = 0, '#![allow(unsafe_code)]', 'unsafely()'))").withColumn("path", F.concat(F.lit("f"), "path", F.lit(".rs"))))
)
query("log_docs_conformance", """SELECT page_id::VARCHAR AS path, CASE WHEN page_id % 6 > 0 THEN 'docs/d' || page_id % 10 || CASE WHEN page_id % 6 = 1 THEN 'x' ELSE '' END || '.md' END AS ref,
CASE WHEN page_id % 6 = 0 THEN 'no note' WHEN page_id % 6 = 1 THEN 'no such document' WHEN page_id % 6 IN (2, 3) THEN 'no such heading' END AS problem FROM pages""")(
    lambda spark, d: buildlogs.docs_conformance(
        _pages(spark, d, r"""concat('//\n', if(page_id % 6 = 0, '', concat('// notes live in docs/d', page_id % 10, if(page_id % 6 = 1, 'x', ''), '.md, section "', CASE page_id % 6 WHEN 2 THEN 'Absent' WHEN 3 THEN 'Fenced' WHEN 4 THEN 'the READER' ELSE 'F1 renamed' END, '".')))"""),
        spark.range(10).selectExpr("concat('docs/d', id, '.md') AS path", r"concat('# D', id, '\n## The `Reader`\n```\n## Fenced\n```\n## F1: first\n') AS value"),
    ).select("path", "ref", "problem")
)
query("docs_last_heading", "SELECT page_id::VARCHAR AS path, CASE WHEN page_id % 4 > 0 THEN CASE WHEN page_id % 4 = 1 THEN 'Fixes and *Problems*' ELSE 'Reader ' || page_id END END AS last, page_id % 4 = 1 AS ok FROM pages")(
    lambda spark, d: buildlogs.last_headings(_pages(spark, d, r"concat('# T\n', CASE page_id % 4 WHEN 0 THEN '### deep' WHEN 1 THEN '## A\n## Fixes and *Problems* ##\n```\n## x\n```' ELSE concat('## Fixes and Problems\n## Reader ', page_id, '\n### y') END)"))
)

# -- settings --------------------------------------------------------------------------------------

_KV = "CASE WHEN page_id % 4 = 1 THEN 3 ELSE 2 END"
_SETTINGS = rf"""concat('schema_version = ', if(page_id % 7 = 0, 2, 1), ' # form\nvocab_size = 32_000\nd_model = ', 128 * (page_id % 5 + 1), '\n\nn_layers=', page_id % 6, '\nn_heads = 4\nn_kv_heads = ', {_KV}, '\nd_ff = 1024\nmax_seq_len = 512\nrope_theta = 1e4\nnorm_eps = 0.5\n',
  CASE page_id % 9 WHEN 1 THEN 'd_ff = 3\n' WHEN 2 THEN 'speed = 3\n' WHEN 3 THEN 'nothing\n' ELSE '' END, if(page_id % 8 = 3, '', concat('tie_embeddings = ', page_id % 2 = 0)))"""
_FAULT = """CASE WHEN page_id % 9 = 3 THEN 'line 12: expected `key = value`' WHEN page_id % 7 = 0 THEN 'version 2 is not 1' WHEN page_id % 9 = 1 THEN 'line 12: duplicate key `d_ff`' WHEN page_id % 9 = 2 THEN 'line 12: unknown key `speed`'
  WHEN page_id % 8 = 3 THEN 'missing tie_embeddings' WHEN page_id % 6 = 0 THEN '`n_layers` must be positive' WHEN page_id % 4 = 1 THEN 'n_heads is not divisible by n_kv_heads' END"""
query("model_config_toml", f"WITH t AS (SELECT page_id, 128 * (page_id % 5 + 1) AS d, page_id % 6 AS n, {_FAULT} AS error FROM pages) SELECT page_id::VARCHAR AS path, CASE WHEN error IS NULL THEN d END AS d_model, CASE WHEN error IS NULL THEN n END AS n_layers, CASE WHEN error IS NULL THEN page_id % 2 = 0 END AS tie_embeddings, error FROM t")(
    lambda spark, d: settings.read_model_settings(_pages(spark, d, _SETTINGS)).select("path", "d_model", "n_layers", "tie_embeddings", "error")
)
query("model_parameters", f"WITH t AS (SELECT page_id, 128 * (page_id % 5 + 1) AS d, page_id % 6 AS n, {_FAULT} AS error FROM pages) SELECT page_id::VARCHAR AS path, n * 3 * d * d AS attention, (32000 * d * CASE WHEN page_id % 2 = 0 THEN 1 ELSE 2 END + n * (3 * d * d + 3 * d * 1024) + (2 * n + 1) * d)::BIGINT AS total FROM t WHERE error IS NULL")(
    lambda spark, d: settings.parameters(settings.read_model_settings(_pages(spark, d, _SETTINGS)).where("error is null")).selectExpr("path", "CAST(attention AS BIGINT) AS attention", "CAST(total AS BIGINT) AS total")
)
query("cargo_toml_license", "SELECT page_id::VARCHAR AS path, CASE page_id % 4 WHEN 0 THEN 'MIT OR Apache-2.0' WHEN 1 THEN 'ISC' END AS license FROM pages")(
    lambda spark, d: settings.package_licenses(_pages(spark, d, r"""CASE page_id % 4 WHEN 0 THEN concat('[package]\nname = "p', page_id, '"\nlicense = "MIT/Apache-2.0"') WHEN 1 THEN '[package]\nlicense.workspace = true\n[workspace.package]\nlicense = " ISC "' WHEN 2 THEN '[package]\nlicense-file = "LICENSE"' ELSE '<html>' END"""))
)
_EXPRESSION = "CASE page_id % 8 WHEN 0 THEN 'A{p} OR (B AND C)' WHEN 1 THEN 'A{p} WITH b AND C' WHEN 2 THEN 'A{p} B' WHEN 3 THEN '(A{p}' WHEN 4 THEN 'A{p} WITH b WITH c' WHEN 5 THEN 'A{p}/B' WHEN 6 THEN ')A{p}(' ELSE '((A{p}))AND(B)' END"
query("p_spdx_shaped", f"SELECT replace({_EXPRESSION}, '{{p}}', page_id::VARCHAR) AS license, page_id % 8 IN (0, 1, 7) AS ok FROM pages")(
    lambda spark, d: table(spark, d, "pages").selectExpr(f"replace({_EXPRESSION}, '{{p}}', CAST(page_id AS STRING)) AS license").select("license", spdx.shaped(F.col("license")).alias("ok"))
)

# -- packages by repository: eleven repositories, each third of one licence only, in two spellings --------

_PACKAGES = """SELECT page_id AS ord, concat('p', page_id) AS name, page_id % 11 AS g, page_id * 3 AS downloads,
CASE WHEN page_id % 13 = 0 THEN 'https://other.org/a/b' WHEN page_id % 2 = 0 THEN concat('https://github.com/Own/Repo', CAST(page_id % 11 AS STRING), '.git') ELSE concat('http://www.github.com/own/repo', CAST(page_id % 11 AS STRING), '/tree/x') END AS repository,
CASE WHEN page_id % 11 = 5 THEN NULL WHEN page_id % 11 % 3 = 0 THEN 'MIT OR ISC' WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 2 = 0 THEN 'MIT' ELSE 'MIT OR Apache-2.0' END AS license FROM """


def _candidates(spark, d):
    return reports.candidates_by_repository(spark.sql(_PACKAGES + f"parquet.`{d}/pages.parquet`"))


query("agg_candidates_by_repo", f"SELECT 'own/repo' || g AS key, arg_min(CASE WHEN ord % 2 = 0 THEN 'Own/Repo' ELSE 'own/repo' END || g, ord) AS id, string_agg(name, ',' ORDER BY ord) AS crates, sum(downloads)::BIGINT AS downloads FROM ({_PACKAGES} pages) WHERE ord % 13 > 0 GROUP BY g")(
    lambda spark, d: _candidates(spark, d).select("key", "id", F.array_join("crates", ",").alias("crates"), "downloads")
)
query("agg_merge_licenses", f"""WITH f AS (SELECT g, license, min(ord) AS o, count(*) OVER (PARTITION BY g, license IS NULL) AS n FROM ({_PACKAGES} pages) WHERE ord % 13 > 0 GROUP BY g, license)
SELECT 'own/repo' || g AS key, coalesce(string_agg(CASE WHEN n > 1 AND license LIKE '% OR %' THEN '(' || license || ')' ELSE license END, ' AND ' ORDER BY o), 'NOASSERTION') AS license FROM f GROUP BY g""")(
    lambda spark, d: _candidates(spark, d).select("key", "license")
)
