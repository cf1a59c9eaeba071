"""Queries through functions and table functions that SQL calls by name, settings in JSON, products of tables, and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import registered, settings, spdx
from ..operators import bpe, matrices, vocabulary
from ..scratch import scratch_path
from ..session import spread, table
from ..sources import manifest, shards
from ..streaming import pieces
from ..streaming.packing import packed_stream
from .corpus import _byte_tokens
from .registry import ORACLES, query

# -- by name in SQL ------------------------------------------------------------------------------------


def _named(sql: str, made=None):
    """A query in SQL with the library's functions registered; ``documents`` (or what ``made`` gives) is the table ``t``."""

    def run(spark, d):
        registered.register(spark)
        return spark.sql(sql, t=made(spark, d) if made else spread(table(spark, d, "documents")))

    return run


query("udf_scrub_text", ORACLES["scrub_replace"])(_named("SELECT doc_id, sha2(scrub_text(text), 256) AS digest FROM {t}"))
query("udf_scrub_find", ORACLES["scrub_find"])(_named("SELECT doc_id, f.rule, count(*) AS n FROM {t} LATERAL VIEW explode(scrub_find(text)) AS f GROUP BY doc_id, f.rule"))
_EXPRESSION = "CASE page_id % 5 WHEN 0 THEN 'MIT' WHEN 1 THEN 'GPL-3.0-only' WHEN 2 THEN 'MIT AND GPL-3.0-only' WHEN 3 THEN 'Apache-2.0 OR GPL-3.0-only' ELSE 'MIT AND' END"
query("udf_spdx_verdict", "SELECT page_id % 5 AS form, count(*) AS n, page_id % 5 IN (0, 3) AS accepted, page_id % 5 <> 4 AS valid FROM pages GROUP BY page_id % 5")(
    _named(f"SELECT form, count(*) AS n, v.accepted, v.valid FROM (SELECT page_id % 5 AS form, spdx_verdict({_EXPRESSION}) AS v FROM {{t}}) GROUP BY form, v.accepted, v.valid", lambda spark, d: table(spark, d, "pages"))
)


_LICENSE = "CASE doc_id % 6 WHEN 0 THEN 'MIT' WHEN 1 THEN 'GPL-3.0-only' WHEN 2 THEN 'none' WHEN 3 THEN 'Apache-2.0 OR GPL-3.0-only' WHEN 4 THEN 'MIT AND' ELSE 'MIT AND ISC' END"


def _policy(spark, d):
    """Verdicts on the licence of each document by language, and over all."""
    judged = spdx.judged(table(spark, d, "documents").select(F.col("lang").alias("category"), F.expr(_LICENSE).alias("license")))
    count = lambda c, name: F.count_if(c).alias(name)
    return judged.rollup("category").agg(count(F.col("accepted"), "accepted"), count(~F.col("accepted"), "rejected"), count(F.upper("license") == "NONE", "unlicensed")).withColumn("category", F.coalesce("category", F.lit("all")))


query("agg_policy_by_category", "SELECT coalesce(lang, 'all') AS category, count(*) FILTER (doc_id % 6 IN (0, 3, 5)) AS accepted, count(*) FILTER (doc_id % 6 IN (1, 2, 4)) AS rejected, count(*) FILTER (doc_id % 6 = 2) AS unlicensed FROM documents GROUP BY ROLLUP (lang)")(_policy)


def _manifests(spark, d):
    """A manifest for each language; that of one language ends in the middle of a source."""
    rows = table(spark, d, "documents").groupBy("lang", "source").agg(F.min("doc_id").alias("ord"))
    rows = rows.select("ord", F.col("lang").alias("path"), F.col("source").alias("id"), F.concat(F.lit("https://host/"), "source").alias("url"), F.sha2("source", 256).alias("revision"), F.lit("MIT").alias("license"), F.lit("2024-02-29").alias("fetched"), F.lit("rust").alias("category"))
    return manifest.manifest_texts(rows).withColumn("value", F.when(F.col("path") == "fr", F.concat("value", F.lit("\nid: last\n"))).otherwise(F.col("value")))


query("udtf_manifest_rows", """
WITH s AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY min(doc_id)) - 1 AS k FROM documents GROUP BY lang, source)
SELECT lang AS path, k::INT AS ord, source AS id, sha256(source) AS revision, NULL::VARCHAR AS error FROM s
UNION ALL SELECT lang, count(*)::INT, NULL, NULL, 'the text ends where `url:` was expected' FROM s WHERE lang = 'fr' GROUP BY lang
""")(_named("SELECT t.path, m.ord, m.id, m.revision, m.error FROM {t} t, LATERAL manifest_rows(t.value) m", _manifests))
query("udtf_read_shard", "SELECT doc_id AS shard, 0::BIGINT AS n, octet_length(encode(text)) AS size, md5(array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::INT), ' ')) AS digest FROM documents")(
    _named("SELECT t.shard, r.n, CAST(size(r.tokens) AS BIGINT) AS size, md5(array_join(r.tokens, ' ')) AS digest FROM {t} t, LATERAL read_shard(t.content, 'documents') r", lambda spark, d: shards.shard_files(_byte_tokens(spark, d), 300, 256))
)


def _udf_bpe(spark, d):
    """Texts there and back through functions of SQL, and how many ids each takes at most."""
    docs = spread(table(spark, d, "documents"))
    registered.register_vocabulary(spark, vocabulary.Vocabulary(bpe.SPLITTERS["cl100k_like"], tuple(bpe.learn_from(docs, 48, "cl100k_like")), ("<|end|>",)))
    return spark.sql("SELECT doc_id, sha2(bpe_decode(ids), 256) AS digest, size(ids) <= octet_length(text) AS shorter FROM (SELECT doc_id, text, bpe_encode(text) AS ids FROM {t})", t=docs)


query("udf_bpe", "SELECT doc_id, sha256(text) AS digest, true AS shorter FROM documents")(_udf_bpe)

# -- settings --------------------------------------------------------------------------------------------

#: Nested settings of each event, beside those of the one before of its user, some of which lack a key.
_SETTINGS = "concat('{\"run\": {\"kind\": \"', event_type, '\", \"seed\": ', CAST(event_id % 3 AS STRING), CASE WHEN event_id % 4 = 0 THEN '' ELSE ', \"rate\": 0.5' END, '}, \"props\": ', props, '}')"


def _check_matches(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "events").select("event_id", "user_id", F.expr(_SETTINGS).alias("now")).withColumn("saved", F.lag("now").over(Window.partitionBy("user_id").orderBy("event_id")))
    run = lambda c: settings.json_settings(F.col(c), "$.run")
    props = lambda c: settings.json_settings(F.col(c), "$.props")
    return rows.where("saved IS NOT NULL").select("event_id", settings.check_matches(run("saved"), run("now")).alias("run_error"), settings.check_matches(props("saved"), props("now")).alias("props_error"))


_SAID = "'the saved run was made with other settings: ' || "
query("check_matches", f"""
WITH e AS (SELECT event_id, event_type, event_id % 3 AS seed, event_id % 4 = 0 AS bare, json_extract_string(props, '$.k') AS k, props, lag(event_id) OVER w AS before, lag(event_type) OVER w AS type_before, lag(json_extract_string(props, '$.k')) OVER w AS k_before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
p AS (SELECT *, list_filter([CASE WHEN type_before <> event_type THEN '`kind` was ' || type_before || ' and is now ' || event_type END,
  CASE WHEN NOT bare AND before % 4 = 0 THEN '`rate` is missing from the saved run' END,
  CASE WHEN before % 3 <> seed THEN '`seed` was ' || before % 3 || ' and is now ' || seed END], lambda x: x IS NOT NULL) AS ps FROM e WHERE before IS NOT NULL)
SELECT event_id, CASE WHEN len(ps) > 0 THEN {_SAID} array_to_string(ps, '; ') END AS run_error, CASE WHEN k <> k_before THEN {_SAID} '`k` was ' || k_before || ' and is now ' || k END AS props_error FROM p
""")(_check_matches)
query("json_variant", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k, value AS first_value, event_id AS nested, 'OBJECT<list: ARRAY<VARIANT>, props: OBJECT<k: BIGINT>>' AS shape FROM events WHERE props IS NOT NULL AND value IS NOT NULL")(
    lambda spark, d: table(spark, d, "events").where("props IS NOT NULL AND value IS NOT NULL")
    .select("event_id", F.parse_json(F.concat(F.lit('{"props": '), "props", F.lit(', "list": ["x", {"value": '), F.col("value").cast("string"), F.lit(', "id": '), "event_id", F.lit("}]}"))).alias("v"))
    .select("event_id", F.variant_get("v", "$.props.k", "int").alias("k"), F.variant_get("v", "$.list[1].value", "double").alias("first_value"), F.variant_get("v", "$.list[1].id", "long").alias("nested"), F.schema_of_variant("v").alias("shape"))
)

# -- products of two tables ------------------------------------------------------------------------------


def _matmul_tables(spark, d):
    """Vectors of ``embeddings`` times a matrix of ``part``, a row for each key below the vectors' width."""
    a = table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), F.transform("embedding", lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("values"))
    b = table(spark, d, "part").select((F.col("p_partkey") - 1).alias("row"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 1000, F.length("p_name").cast("double")).alias("values"))
    made = matrices.multiply(a, b, block=24)
    return made.select(F.col("row").alias("vec_id"), *(F.round(F.get("values", F.lit(k)), 4).alias(f"c{k}") for k in range(3)))


query("matmul_tables", "WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings) SELECT vec_id, round(sum(x * p_size), 4) AS c0, round(sum(x * p_retailprice / 1000), 4) AS c1, round(sum(x * length(p_name)), 4) AS c2 FROM c JOIN part ON p_partkey = k GROUP BY vec_id")(_matmul_tables)

# -- streams ------------------------------------------------------------------------------------------------


def _finished(writer, spark, out: str) -> None:
    writer.option("checkpointLocation", scratch_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()


def _stream_pack(spark, d):
    """The packing of ``documents`` as a stream of files, until it has caught up."""
    docs, out = table(spark, d, "documents"), scratch_path(spark, "packed")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(docs.schema).parquet(f"{d}/document[s].parquet").withColumn("size", F.col("n_chars") + 1)
    _finished(packed_stream(stream, "size", "doc_id", 20_000, "source").writeStream.format("parquet").option("path", out), spark, out)
    return spark.read.parquet(out)


query("stream_pack", """
WITH RECURSIVE d AS (SELECT source AS key, doc_id AS ord, n_chars + 1 AS size, row_number() OVER w AS k, sum(n_chars + 1) OVER w AS upto FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)),
s(key, shard, first, base) AS (SELECT DISTINCT key, 0::BIGINT, 1::BIGINT, 0::HUGEINT FROM d UNION ALL
  SELECT s.key, s.shard + 1, e.k + 1, e.upto FROM s, LATERAL (SELECT k, upto FROM d WHERE d.key = s.key AND d.k >= s.first AND d.upto - s.base >= 20000 ORDER BY k LIMIT 1) e)
SELECT d.key, d.ord, d.size, max(s.shard) AS shard FROM d JOIN s ON d.key = s.key AND d.k >= s.first GROUP BY d.key, d.ord, d.size
""")(_stream_pack)


def _stream_counts(spark, d):
    """Pieces of ``documents`` counted by a stream, held against those of the table: how many there are, and how many differ."""
    docs, out = table(spark, d, "documents"), scratch_path(spark, "counts")
    stream = spark.readStream.schema(docs.schema).parquet(f"{d}/document[s].parquet")
    _finished(pieces.stream_piece_counts(stream, out), spark, out)
    both = pieces.streamed_counts(spark, out).withColumnRenamed("n", "streamed").join(bpe.piece_counts(docs), "piece", "full")
    return both.agg(F.sum(F.col("streamed") * F.octet_length("piece")).alias("bytes"), F.count_if(~F.col("streamed").eqNullSafe(F.col("n"))).alias("differ"))


query("stream_piece_counts", "SELECT sum(octet_length(encode(text)))::BIGINT AS bytes, 0::BIGINT AS differ FROM documents")(_stream_counts)
