"""Queries over the readers of files: texts and bytes made from the tables, some with planted faults, and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bpe, packing, vocabulary
from ..scratch import scratch_path
from ..session import spread, table
from ..sources import listing, logs, manifest, reports, tensor_source, tensors, token_shards
from .corpus import epoch_sql
from .registry import query

#: One file for each 64 event ids of a user; every fifth user's last line lacks a field.
_STEPS = """WITH e AS (SELECT user_id || '/' || event_id // 64 AS path, user_id % 5 = 0 AS bad, event_id, coalesce(value, 0) AS value, length(event_type) AS size,
  row_number() OVER (PARTITION BY user_id, event_id // 64 ORDER BY event_id) + 1 AS line_no FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL)
SELECT path, line_no::INT AS line_no, event_id::DOUBLE AS step, value::DOUBLE AS loss, size::DOUBLE AS tokens, NULL::VARCHAR AS error FROM e WHERE NOT bad
UNION ALL SELECT path, max(line_no + 1)::INT, NULL, NULL, NULL, 'line ' || max(line_no + 1) || ' has 2 fields, not 3' FROM e WHERE bad GROUP BY path"""


def _log_files(spark, d):
    e = table(spark, d, "events").where("user_id is not null and event_type is not null")
    line = F.concat_ws("\t", "event_id", F.coalesce("value", F.lit(0.0)), F.length("event_type"))
    e = e.select("user_id", F.floor(F.col("event_id") / 64).alias("part"), F.struct("event_id", line.alias("line")).alias("s"))
    files = e.groupBy("user_id", "part").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"]).alias("ls"))
    text = F.concat(F.lit("step\tloss\ttokens\n"), F.array_join("ls", "\n"), F.when(F.col("user_id") % 5 == 0, "\n1\t2\n").otherwise("\n"))
    return files.select(F.concat_ws("/", "user_id", "part").alias("path"), text.alias("value"))


query("tsv_log_files", _STEPS)(lambda spark, d: logs.read_tsv(_log_files(spark, d), ("step", "loss", "tokens")))
query("summary_kv_files", "SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 4 > 1 THEN n_chars END::BIGINT AS tokens, CASE WHEN doc_id % 4 > 1 THEN 'true' END AS finished, CASE doc_id % 4 WHEN 0 THEN 'no `tokens`' WHEN 1 THEN 'finished is `maybe`' END AS error FROM documents WHERE doc_id IS NOT NULL")(
    lambda spark, d: logs.read_summaries(
        table(spark, d, "documents").where("doc_id is not null").select(
            F.col("doc_id").cast("string").alias("path"),
            F.concat(F.lit("steps 1\ntotal_steps 2\n"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("tokens 7\ntokens  "), F.col("n_chars"), F.lit("\n"))), F.when(F.col("doc_id") % 4 == 1, "finished maybe\n").otherwise("finished true\n")).alias("value"),
        )
    ).select("path", F.try_element_at("values", F.lit("tokens")).cast("long").alias("tokens"), F.try_element_at("values", F.lit("finished")).alias("finished"), "error")
)

#: Ten pages a file; of three files one is right, one ends in a bad category, one in a blank line too many.
_LICENSE = "CASE page_id % 5 WHEN 0 THEN 'MIT' WHEN 1 THEN 'GPL-3.0-only' WHEN 2 THEN 'GPL-3.0-only OR Apache-2.0' WHEN 3 THEN 'MIT AND GPL-3.0-only' ELSE 'LGPL-2.1+' END"


def _sources(spark, d):
    bad = (F.col("path") % 3 == 1) & (F.col("page_id") % 10 == 9)
    return table(spark, d, "pages").select(
        F.floor(F.col("page_id") / 10).alias("path"), F.col("page_id").alias("ord"), "page_id", F.concat(F.lit("page/"), "page_id").alias("id"), F.concat(F.lit("https://host/"), "page_id").alias("url"),
        F.sha2(F.col("page_id").cast("string"), 256).alias("revision"), F.expr(_LICENSE).alias("license"), F.lit("2024-02-29").alias("fetched"),
    ).withColumn("category", F.when(bad, "Rust!").otherwise("rust"))


def _manifest_files(spark, d):
    texts = manifest.manifest_texts(_sources(spark, d))
    return texts.select(F.col("path").cast("string").alias("path"), F.when(F.col("path") % 3 == 2, F.concat("value", F.lit("\n"))).otherwise(F.col("value")).alias("value"))


query("manifest_read", f"""WITH s AS (SELECT page_id // 10 AS f, page_id, row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id) - 1 AS ord, {_LICENSE} AS license FROM pages),
b AS (SELECT f, CASE WHEN f % 3 = 2 THEN 7 * count(*) + 3 ELSE max(7 * ord + 3) FILTER (page_id % 10 = 9) END AS line FROM s GROUP BY f),
b2 AS (SELECT * FROM b WHERE f % 3 = 2 OR f % 3 = 1 AND line IS NOT NULL)
SELECT f::VARCHAR AS path, ord::INT AS ord, 'page/' || page_id AS id, sha256(page_id::VARCHAR) AS revision, license, NULL::INT AS line, NULL::VARCHAR AS error FROM s WHERE f NOT IN (SELECT f FROM b2)
UNION ALL SELECT f::VARCHAR, NULL, NULL, NULL, NULL, line::INT, CASE WHEN f % 3 = 2 THEN 'the file ends where `id:` was expected' ELSE '`category` of `page/' || (f * 10 + 9) || '` isn''t 1 to 32 of a-z, 0-9, _ and -' END FROM b2""")(
    lambda spark, d: manifest.read_manifests(_manifest_files(spark, d)).select("path", "ord", "id", "revision", "license", "line", "error")
)
_STATUS = "CASE page_id % 5 WHEN 1 THEN 'rejected' WHEN 3 THEN 'rejected' ELSE 'accepted' END"
_REASON = "CASE page_id % 5 WHEN 1 THEN 'GPL-3.0-only is not on the list' WHEN 3 THEN 'GPL-3.0-only is not on the list' END"
query("lic_partition", f"SELECT 'page/' || page_id AS id, {_LICENSE} AS license, {_STATUS} AS status, {_REASON} AS reason FROM pages")(
    lambda spark, d: manifest.partition(_sources(spark, d)).select("id", "license", "status", "reason")
)
query("lic_report", f"SELECT {_STATUS} AS status, 'page/' || page_id AS id, {_LICENSE} AS license, {_REASON} AS reason, true AS ok FROM pages")(
    lambda spark, d: manifest.read_report(manifest.report(manifest.partition(_sources(spark, d))), "line").drop("category")
)
query("safetensors_read", "SELECT (vec_id // 32)::VARCHAR AS path, 'v' || vec_id AS name, len(embedding)::BIGINT AS n, embedding[1]::DOUBLE AS first_value, embedding[len(embedding)]::DOUBLE AS last_value, NULL::VARCHAR AS error FROM embeddings")(
    lambda spark, d: tensors.read_tensors(
        tensors.tensor_files(table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 32).alias("path"), F.concat(F.lit("v"), "vec_id").alias("name"), F.array(F.size("embedding")).alias("shape"), F.col("embedding").alias("values")))
    ).select("path", "name", F.get("shape", F.lit(0)).alias("n"), F.get("values", F.lit(0)).cast("double").alias("first_value"), F.element_at("values", -1).cast("double").alias("last_value"), "error")
)

# -- answers of indexes and build logs, made of the pages --------------------------------------------


def _json_files(spark, d, key: str, *columns: str):
    """One JSON text for ten pages."""
    rows = table(spark, d, "pages").selectExpr("CAST(page_id DIV 10 AS STRING) AS path", f"struct({', '.join(columns)}) AS s")
    return rows.groupBy("path").agg(F.to_json(F.struct(F.lit("candidates/1").alias("schema"), F.collect_list("s").alias(key))).alias("value"))


query("crates_page_parse", "SELECT (page_id // 10)::VARCHAR AS path, 'c' || page_id AS name, CASE WHEN page_id % 3 > 0 THEN url END AS repository, page_id * 7 AS downloads, CASE WHEN page_id % 4 > 0 THEN '1.0.' || page_id ELSE '2.0.0-rc' END AS version FROM pages WHERE page_id % 9 > 0")(
    lambda spark, d: reports.crates_pages(_json_files(spark, d, "crates", "CASE WHEN page_id % 9 > 0 THEN concat('c', page_id) END AS name", "CASE WHEN page_id % 3 > 0 THEN url END AS repository", "page_id * 7 AS downloads", "CASE WHEN page_id % 4 > 0 THEN concat('1.0.', page_id) END AS max_stable_version", "'2.0.0-rc' AS newest_version"))
)
query("github_search_parse", "SELECT (page_id // 10)::VARCHAR AS path, 'a/r' || page_id AS id, CASE page_id % 3 WHEN 0 THEN 'NONE' WHEN 1 THEN 'NOASSERTION' ELSE 'MIT' END AS license, page_id AS stars FROM pages WHERE page_id % 4 > 0 AND page_id % 5 > 0")(
    lambda spark, d: reports.repository_searches(_json_files(spark, d, "items", "concat(if(page_id % 5 = 0, 'a b', 'a'), '/r', page_id) AS full_name", "page_id % 4 = 0 AS fork", "CASE page_id % 3 WHEN 1 THEN named_struct('spdx_id', CAST(NULL AS STRING), 'key', 'x') WHEN 2 THEN named_struct('spdx_id', 'MIT', 'key', 'x') END AS license", "page_id AS stars"))
)
query("candidates_json", "SELECT (page_id // 10)::VARCHAR AS path, 'a/' || page_id AS id, 'x,y' || page_id AS crates, page_id AS downloads, NULL::VARCHAR AS error FROM pages WHERE page_id // 10 % 4 > 0 UNION ALL SELECT DISTINCT (page_id // 10)::VARCHAR, NULL, NULL, NULL::BIGINT, 'not candidates/1' FROM pages WHERE page_id // 10 % 4 = 0")(
    lambda spark, d: reports.candidates(
        _json_files(spark, d, "candidates", "concat('a/', page_id) AS id", "array('x', concat('y', page_id)) AS crates", "page_id AS downloads").withColumn("value", F.expr("if(path % 4 = 0, replace(value, 'candidates/1', 'candidates/2'), value)"))
    ).withColumn("crates", F.array_join("crates", ","))
)
query("crate_version_parse", "SELECT page_id::VARCHAR AS path, CASE page_id % 4 WHEN 0 THEN 'Apache-2.0 OR MIT' WHEN 1 THEN 'MIT OR ISC' WHEN 2 THEN '(MIT/X)' END AS license, page_id % 6 = 0 AS yanked FROM pages")(
    lambda spark, d: reports.crate_versions(table(spark, d, "pages").selectExpr("CAST(page_id AS STRING) AS path", "to_json(named_struct('version', named_struct('license', CASE page_id % 4 WHEN 0 THEN 'Apache-2.0 / MIT' WHEN 1 THEN ' MIT/ISC' WHEN 2 THEN '(MIT/X)' END, 'yanked', page_id % 6 = 0))) AS value"))
)
query("ls_remote_parse", "SELECT page_id::VARCHAR AS path, CASE WHEN page_id % 5 > 0 THEN substr(sha256(url), 1, 40) END AS revision FROM pages")(
    lambda spark, d: reports.remote_heads(table(spark, d, "pages").selectExpr("CAST(page_id AS STRING) AS path", "concat(substr(sha2(path, 256), 1, 40), char(9), 'refs/x', char(10), substr(sha2(url, 256), 1, 40), char(9), if(page_id % 5 = 0, 'refs/HEAD', 'HEAD'), char(10)) AS value"))
)
query("log_ci_tests", "SELECT lang AS suite, count(*) FILTER (doc_id % 7 > 1) AS passed, count(*) FILTER (doc_id % 7 = 0) AS failed, count(*) FILTER (doc_id % 7 = 1) AS ignored FROM documents WHERE lang IS NOT NULL AND doc_id IS NOT NULL GROUP BY lang")(
    lambda spark, d: reports.test_counts(table(spark, d, "documents").selectExpr("concat('test ', lang, '::d', doc_id, ' ... ', CASE doc_id % 7 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'ignored' ELSE 'ok' END) AS value"))
)
query("log_ci_fmt", "SELECT 'src/' || page_id % 20 || '.rs' AS path, count(*) AS hunks, min(page_id) AS first_line FROM pages GROUP BY 1")(
    lambda spark, d: reports.format_hunks(table(spark, d, "pages").selectExpr("concat('Diff in src/', page_id % 20, '.rs', if(page_id % 2 = 0, ' at line ', ':'), page_id, ':') AS value"))
)
query("log_ci_diagnostics", """SELECT page_id::VARCHAR AS path, 2 AS line_no, 'warning' AS level, NULL AS code, 'unused ' || page_id AS message, CASE WHEN page_id % 2 = 0 THEN 'src/a.rs' END AS file, CASE WHEN page_id % 2 = 0 THEN page_id END::INT AS at FROM pages
UNION ALL SELECT page_id::VARCHAR, 4, 'error', 'E0308', 'mismatched', 'src/b.rs', 9 FROM pages""")(
    lambda spark, d: reports.diagnostics(table(spark, d, "pages").selectExpr("CAST(page_id AS STRING) AS path", r"concat('Checking\nwarning: unused ', page_id, '\n', if(page_id % 2 = 0, concat('  --> src/a.rs:', page_id, ':5'), '   |'), '\nerror[E0308]: mismatched\n   |\n --> src/b.rs:9:1\nDone') AS value"))
)
query("log_data_smoke", "SELECT page_id::VARCHAR AS path, unnest(['scrub', 'scrub', 'pack']) AS section, unnest(['files', 'secrets', 'shards']) AS metric, unnest([page_id, page_id * 2, 4]) AS value FROM pages")(
    lambda spark, d: reports.sections(table(spark, d, "pages").selectExpr("CAST(page_id AS STRING) AS path", r"concat('early 1\n=== scrub ===\nfiles ', page_id, '\nsecrets ', page_id * 2, '\nnot a number\n=== pack ===\nshards 4\n') AS value"))
)

# -- trees of files, packed tokens -------------------------------------------------------------

_TREE = """CASE page_id % 8 WHEN 0 THEN 'src/f{p}.rs' WHEN 1 THEN 'target/f{p}.rs' WHEN 2 THEN 'bin/f{p}' WHEN 3 THEN 'bin/f{p}' WHEN 4 THEN 'docs/Guide{p}.MD' WHEN 5 THEN 'docs/changelog{p}.md' WHEN 6 THEN 'a b/f{p}.sh' ELSE 'd{p}/Makefile' END"""


def _tree(spark, d):
    pages = table(spark, d, "pages")
    path = f"replace({_TREE}, '{{p}}', CAST(page_id AS STRING))"
    files = pages.selectExpr(f"{path} AS path", "page_id AS size", "CASE page_id % 8 WHEN 2 THEN '#!/usr/bin/env -S bash -e' WHEN 3 THEN '#!/usr/bin/bashful' END AS head")
    kinds = [listing.select_files(files, c, kind=k).select("path", F.lit(name).alias("kind")) for name, c, k in (("rust", "rust", "code"), ("shell", "shell", "code"), ("docs", "rust", "docs"))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


query("select_files", f"SELECT replace({_TREE}, '{{p}}', page_id::VARCHAR) AS path, CASE page_id % 8 WHEN 0 THEN 'rust' WHEN 4 THEN 'docs' ELSE 'shell' END AS kind FROM pages WHERE page_id % 8 IN (0, 2, 4, 7) AND page_id BETWEEN 1 AND 1048576")(_tree)
query("agg_docs_tokens", "SELECT count(*) AS documents, sum(octet_length(encode(text)))::BIGINT AS bytes, sum(octet_length(encode(text)) + 1)::BIGINT AS tokens FROM documents WHERE text IS NOT NULL")(
    lambda spark, d: packing.corpus_counts(bpe.encode(spread(table(spark, d, "documents")).where("text is not null"), []), table(spark, d, "documents").where("text is not null"))
)

# -- shard files -------------------------------------------------------------------------------------


def _packed(spark, d) -> str:
    """Shard files of all documents in tokens of one byte, an end of text after each."""
    path = scratch_path(spark, "shards")
    kept = vocabulary.Vocabulary(bpe.SPLITTERS["cl100k_like"], (), (token_shards.END_OF_TEXT,))
    token_shards.pack_text(spread(table(spark, d, "documents").select("doc_id", "text")), kept, 200_000, path)
    return path


_PACKED = """
d AS (SELECT doc_id, text, octet_length(encode(text)) + 1 AS size FROM documents WHERE text <> ''),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS k, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM d),
s(shard, first, base) AS (SELECT 0::BIGINT, 1::BIGINT, 0::HUGEINT UNION ALL
  SELECT s.shard + 1, e.k + 1, e.upto FROM s, LATERAL (SELECT k, upto FROM o WHERE o.k >= s.first AND o.upto - s.base >= 200000 ORDER BY k LIMIT 1) e),
p AS (SELECT doc_id, text, size, k, (SELECT max(shard) FROM s WHERE s.first <= o.k) AS shard FROM o)"""
query("pack_text", f"WITH RECURSIVE {_PACKED} SELECT shard, row_number() OVER (PARTITION BY shard ORDER BY k) - 1 AS n, sha256(text) AS digest FROM p")(
    lambda spark, d: token_shards.read_shards_from(spark, _packed(spark, d), "documents").select("shard", "n", F.sha2(F.unhex(F.array_join(F.transform("tokens", lambda t: F.lpad(F.hex(t), 2, "0")), "")), 256).alias("digest"))
)
query("pack_finish", f"WITH RECURSIVE {_PACKED} SELECT shard, count(*) AS documents, sum(size)::BIGINT AS tokens, max(size)::BIGINT - 1 AS longest FROM p GROUP BY shard")(
    lambda spark, d: token_shards.read_shards_from(spark, _packed(spark, d), "documents").groupBy("shard").agg(F.count("*").alias("documents"), F.sum(F.size("tokens") + 1).alias("tokens"), F.max(F.size("tokens")).cast("long").alias("longest"))
)
query("shard_concat", f"WITH RECURSIVE {_PACKED}" + """, h AS (SELECT shard, string_agg(hex(encode(text)) || 'X', '' ORDER BY k) AS h FROM p GROUP BY shard)
SELECT shard, sha256(replace(h, 'X', '100')) AS digest, (SELECT sum(size) FROM p WHERE p.shard = h.shard)::BIGINT AS tokens FROM h""")(
    lambda spark, d: token_shards.read_shards_from(spark, _packed(spark, d), "chunks")
    .select("shard", "start", F.size("tokens").alias("size"), F.array_join(F.transform("tokens", lambda t: F.lpad(F.hex(t), F.when(t > 255, 3).otherwise(2), F.lit("0"))), "").alias("h"))
    .groupBy("shard").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "h"))), lambda c: c["h"]), ""), 256).alias("digest"), F.sum("size").alias("tokens"))
)
#: The first 100 batches of an epoch over the shards, as numbers of 4 bytes: of each, its inputs, then its targets.
_SHARD_WINDOWS = _PACKED + """,
l AS (SELECT shard, sum(size) OVER (PARTITION BY shard ORDER BY k) - size AS before, list_append(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: x || '000000'), '00010000') AS ts FROM p),
t AS (SELECT shard, unnest(ts) AS x, before + unnest(range(len(ts))) AS pos FROM l),
c AS (SELECT shard, max(pos) // 128 AS n FROM t GROUP BY shard),
a AS (SELECT shard, pos // 128 AS i, string_agg(x, '' ORDER BY pos) AS inputs FROM t GROUP BY ALL),
z AS (SELECT shard, (pos - 1) // 128 AS i, string_agg(x, '' ORDER BY pos) AS targets FROM t WHERE pos > 0 GROUP BY ALL),
w AS (SELECT row_number() OVER (ORDER BY shard, i) - 1 AS sequence, inputs, targets FROM a JOIN z USING (shard, i) JOIN c USING (shard) WHERE i < n),"""
query("agg_batch_digest", f"""{epoch_sql("SELECT count(*) FROM w", 42, 1, _SHARD_WINDOWS)},
b AS (SELECT place // 8 AS index, string_agg(inputs, '' ORDER BY place) || string_agg(targets, '' ORDER BY place) AS h FROM orders JOIN w USING (sequence), nn WHERE place < n - n % 8 AND place // 8 < 100 GROUP BY ALL)
SELECT sha256(unhex(string_agg(h, '' ORDER BY index))) AS digest FROM b""")(lambda spark, d: spark.createDataFrame([(packing.batch_digest(token_shards.batches_from(spark, _packed(spark, d), 128, 8, 42, 1, stop=100)),)], "digest string"))


def _tensor_ranges(spark, d):
    """Files of 64 vectors each, written from parts of 7 values and read by range, every tensor whose name ends in 3 by name alone."""
    path = scratch_path(spark, "tensors")
    v = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("file"), F.concat(F.lit("v"), "vec_id").alias("name"), F.array(F.size("embedding")).alias("shape"), "embedding")
    parts = v.select("file", "name", "shape", F.explode(F.sequence(F.lit(0), F.size("embedding") - 1, F.lit(7))).alias("start"), "embedding")
    tensor_source.write_tensor_files(parts.withColumn("values", F.slice("embedding", F.col("start") + 1, 7)), path)
    read = tensor_source.read_tensor_files(spark, path, part_values=16).where(F.col("name").startswith("v1"))
    return read.groupBy("file", "name").agg(F.max(F.get("shape", F.lit(0))).alias("n"), F.sum(F.size("values")).alias("n_values"), F.sum(F.aggregate("values", F.lit(0.0), lambda t, x: t + x)).alias("total"), F.count("*").alias("parts"))


query("safetensors_ranges", """
SELECT (vec_id // 64)::VARCHAR AS file, 'v' || vec_id AS name, len(embedding)::BIGINT AS n, len(embedding)::BIGINT AS n_values, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS total, ((len(embedding) + 15) // 16)::BIGINT AS parts
FROM embeddings WHERE vec_id::VARCHAR LIKE '1%'""")(_tensor_ranges)
