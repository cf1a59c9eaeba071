"""Predicates, joins, aggregates, windows, sorts and set operations over the tables, written as Spark SQL.

Each query is one declarative statement: Catalyst prunes columns, pushes filters to the scan and
picks the joins. Aggregates are partial before each shuffle; limits are top-k reports.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import windows
from ..session import spread
from ..sources.reports import REPOSITORY
from .registry import query

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(spark: SparkSession, sf_dir: str, sql: str) -> str:
    """``sql`` with ``{table}`` replaced by the Parquet path, so that no session state is touched."""
    for name in TABLES:
        sql = sql.replace("{" + name + "}", f"parquet.`{sf_dir}/{name}.parquet`")
    return sql


def sql_query(name: str, spark_sql: str, duck_sql: str | None = None, rows_only: bool = False) -> None:
    """Registers a query; the oracle is its own SQL where both dialects have the same words."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(views(spark, sf_dir, spark_sql))

    oracle = duck_sql if duck_sql is not None else spark_sql
    for table in TABLES:
        oracle = oracle.replace("{" + table + "}", table)
    query(name, None if rows_only else oracle)(run)


# -- predicates ---------------------------------------------------------------------------------

sql_query("scan_documents", "SELECT doc_id, text, lang, source, n_chars FROM {documents}")
sql_query("p_id_ok", "SELECT doc_id, source, coalesce(source RLIKE '^[A-Za-z0-9._/-]{1,128}$', false) AS ok FROM {documents}",
          "SELECT doc_id, source, coalesce(regexp_matches(source, '^[A-Za-z0-9._/-]{1,128}$'), false) AS ok FROM {documents}")
sql_query("p_url_ok", r"SELECT page_id, url, url RLIKE '^[a-z][a-z0-9+.-]*://[^\\s]+$' AND octet_length(url) <= 512 AS ok FROM {pages}",
          r"SELECT page_id, url, regexp_matches(url, '^[a-z][a-z0-9+.-]*://[^\s]+$') AND octet_length(encode(url)) <= 512 AS ok FROM {pages}")
sql_query("p_revision_ok", "SELECT doc_id, sha2(text, 256) AS revision, sha2(text, 256) RLIKE '^([0-9a-f]{40}|[0-9a-f]{64})$' AS ok FROM {documents}",
          "SELECT doc_id, sha256(text) AS revision, regexp_matches(sha256(text), '^([0-9a-f]{40}|[0-9a-f]{64})$') AS ok FROM {documents}")
_DATES = "(SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'x' WHEN o_orderkey % 89 = 0 THEN '2024-2-9' ELSE concat(CAST(1960 + o_orderkey % 80 AS STRING), '-', substr(CAST(100 + o_orderkey % 14 AS STRING), 2), '-', substr(CAST(100 + o_orderkey % 33 AS STRING), 2)) END AS d FROM {orders}) t"
_DATE = "SELECT o_orderkey, d, {m}(d, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AND {c} IS NOT NULL AND coalesce(year({c}), 0) >= 1970 AS ok FROM "
sql_query("p_date_ok", _DATE.format(m="regexp_like", c="try_to_date(d, 'yyyy-MM-dd')") + _DATES, _DATE.format(m="regexp_matches", c="try_cast(d AS DATE)") + _DATES)
sql_query("p_category_ok", "SELECT doc_id, lang, lang RLIKE '^[a-z0-9_-]{1,32}$' AS ok FROM {documents}",
          "SELECT doc_id, lang, regexp_matches(lang, '^[a-z0-9_-]{1,32}$') AS ok FROM {documents}")
sql_query("p_field_clean", r"SELECT doc_id, text <> '' AND NOT text RLIKE '[\\x00-\\x1F\\x7F-\\x9F]' AND trim(text) = text AS ok FROM {documents}",
          r"SELECT doc_id, text <> '' AND NOT regexp_matches(text, '[\x00-\x1F\x{7F}-\x{9F}]') AND trim(text) = text AS ok FROM {documents}")
sql_query("p_unique_id", "SELECT source, min(doc_id) AS first_id, count(*) = 1 AS is_unique FROM {documents} GROUP BY source")
sql_query("p_size_window", "SELECT doc_id, octet_length(text) > 0 AND octet_length(text) <= 4096 AS ok FROM {documents}",
          "SELECT doc_id, octet_length(encode(text)) > 0 AND octet_length(encode(text)) <= 4096 AS ok FROM {documents}")
sql_query("p_long_line", r"SELECT doc_id, exists(split(text, '\n'), l -> octet_length(l) > 1000) AS long_line FROM {documents}",
          "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: octet_length(encode(l)) > 1000)) > 0 AS long_line FROM {documents}")


def _planted(column: str, forms: dict[str, object], *answers: str) -> tuple[str, str]:
    """Rows of the pages with one of the forms each by turns, ``~`` standing for the page's id: for Spark the rows, for the oracle also the answers that belong to them."""
    pick = lambda values: "replace(CASE page_id % " + str(len(forms)) + "".join(f" WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END, '~', CAST(page_id AS STRING))"
    rows = f"(SELECT page_id, {pick(forms)} AS {column} FROM {{pages}}) t"
    told = [f"{pick([v[k] for v in forms.values()])}{'' if isinstance(next(iter(forms.values()))[k], str) else '::BOOLEAN'} AS {name}" for k, name in enumerate(answers)]
    return rows, f"SELECT page_id, {pick(forms)} AS {column}, {', '.join(told)} FROM {{pages}}"


_ROWS, _TOLD = _planted("u", {
    "https://github.com/Rust-Lang/regex~.git": ("Rust-Lang", "regex~"), "git@github.com:a/b~.git": ("", ""), "http://www.github.com/x/y~/tree/main": ("x", "y~"), "https://gitlab.com/a/b~": ("", ""), "github.com/q/r~#readme": ("q", "r~"),
    "https://github.com/only~": ("", ""), "git+https://github.com/c/d.~.git": ("c", "d.~"), "ssh://git@github.com/e/f~": ("", ""), " git://github.com/g~/h ": ("g~", "h"),
}, "owner", "repo")
sql_query("p_github_url", f"SELECT page_id, u, regexp_extract(trim(u), '{REPOSITORY}', 1) AS owner, regexp_extract(trim(u), '{REPOSITORY}', 2) AS repo FROM {_ROWS}", _TOLD)
_SHELL = r"^#!\s*(?:/usr/bin/env\s+(?:-S\s+)?|/\S*/)?(?:sh|bash|zsh|dash|ksh|fish)(?:[^A-Za-z0-9_]|$)"
_ROWS, _TOLD = _planted("head", {"#!/bin/bash -~": (True,), "#!/usr/bin/env -S zsh ~": (True,), "#!/usr/bin/bashful~": (False,), "#!/usr/bin/env python ~": (False,), "echo ~ #!/bin/sh": (False,), "#! /opt/~/sh": (True,), "#!/bin/run~ bash": (False,)}, "ok")
sql_query("p_shell_shebang", f"SELECT page_id, head, substring(head, 1, 200) RLIKE '{_SHELL}' AS ok FROM {_ROWS}".replace(chr(92), chr(92) * 2), _TOLD)
_NAME = "regexp_extract(path, '([^/]*)$', 1)"
_DOC = f"regexp_like(lower({_NAME}), '[.](md|markdown|rst)$') AND NOT regexp_like(upper({_NAME}), '^(CHANGELOG|CHANGES|HISTORY|NEWS|RELEASE)') AS is_doc, regexp_like(path, '[.](rs)$') AS is_rust, regexp_like({_NAME}, '[.](sh|bash|zsh|fish|bats)$|^(Makefile|makefile|GNUmakefile|Dockerfile)$') AS is_shell"
_ROWS, _TOLD = _planted("path", {
    "README~.md": (True, False, False), "docs/Guide~.MD": (True, False, False), "CHANGELOG~.md": (False, False, False), "src/~/lib.rs": (False, True, False), "run~.sh": (False, False, True), ".profile~": (False, False, False), "History~.txt": (False, False, False),
    "a ~.rs": (False, True, False), "x~.markdown": (True, False, False), "AUTHORS~.md": (True, False, False), "RELEASES~.md": (False, False, False), "sub~/Makefile": (False, False, True), "t~.bats": (False, False, True), "Makefile~": (False, False, False), "news~/a.rst": (True, False, False),
}, "is_doc", "is_rust", "is_shell")
sql_query("p_is_doc", f"SELECT page_id, path, {_DOC} FROM {_ROWS}", _TOLD)
sql_query("p_excluded", "SELECT doc_id FROM {documents} d LEFT ANTI JOIN (SELECT lower(x) AS x FROM VALUES ('SRC0'), ('src3') AS t(x)) e ON lower(d.source) = e.x",
          "SELECT doc_id FROM {documents} d WHERE lower(d.source) NOT IN ('src0', 'src3')")
_BUCKET = "CAST(conv(substr(sha2(concat('1', char(0), source), 256), 1, 8), 16, 10) AS BIGINT) % 100"
_DUCK_BUCKET = "(('0x' || substr(sha256('1' || chr(0) || source), 1, 8))::BIGINT % 100)"
sql_query("p_holdout", f"SELECT source, {_BUCKET} AS bucket, {_BUCKET} < 10 AS held_out FROM (SELECT DISTINCT source FROM {{documents}})",
          f"SELECT source, {_DUCK_BUCKET} AS bucket, {_DUCK_BUCKET} < 10 AS held_out FROM (SELECT DISTINCT source FROM {{documents}})")
sql_query("p_sequence_fits", "SELECT doc_id, greatest((n_chars - 1) DIV 128, 0) AS sequences FROM {documents}",
          "SELECT doc_id, greatest((n_chars - 1) // 128, 0) AS sequences FROM {documents}")
sql_query("p_token_in_vocab", r"SELECT doc_id, text RLIKE '[^\\x00-\\x7F]' AS out_of_vocab, CAST(instr(text, '\n') AS BIGINT) AS first_eos FROM {documents}",
          r"SELECT doc_id, regexp_matches(text, '[^\x00-\x7F]') AS out_of_vocab, strpos(text, chr(10)) AS first_eos FROM {documents}")
sql_query("p_finite", "SELECT event_id, NOT isnan(value) AND abs(value) < CAST('Infinity' AS DOUBLE) AS finite FROM {events}",
          "SELECT event_id, isfinite(value) AS finite FROM {events}")

# -- joins --------------------------------------------------------------------------------------

sql_query("join_accepted_manifest", "SELECT l.doc_id, d.source, d.doc_id IS NULL AS missing FROM {labels} l LEFT JOIN {documents} d ON l.doc_id = d.doc_id WHERE l.quality = 1")
sql_query("join_reviewed", "SELECT d.doc_id, d.source FROM {documents} d LEFT SEMI JOIN {labels} l ON d.doc_id = l.doc_id",
          "SELECT d.doc_id, d.source FROM {documents} d SEMI JOIN {labels} l ON d.doc_id = l.doc_id")
sql_query("join_not_reviewed", "SELECT d.doc_id, d.source FROM {documents} d LEFT ANTI JOIN {labels} l ON d.doc_id = l.doc_id",
          "SELECT d.doc_id, d.source FROM {documents} d ANTI JOIN {labels} l ON d.doc_id = l.doc_id")
sql_query("join_licenses_by_crate", "SELECT n.n_name, r.r_name FROM {nation} n LEFT JOIN {region} r ON n.n_regionkey = r.r_regionkey")
# a range join by equal buckets of a hundred lines: both ends' buckets are enumerated, the range is the filter
_SAMPLES = "('a', 10, 250), ('b', 251, 260), ('c', 600, 601), ('d', 900, 1200)"
sql_query("join_range_findings",
          f"WITH s AS (SELECT kind, lo, hi, explode(sequence(lo DIV 100, hi DIV 100)) AS b FROM VALUES {_SAMPLES} AS t(kind, lo, hi)) SELECT s.kind, count(*) AS hits, min(e.event_id) AS first_line FROM {{events}} e JOIN s ON e.event_id DIV 100 = s.b AND e.event_id BETWEEN s.lo AND s.hi GROUP BY s.kind",
          f"SELECT kind, count(*) AS hits, min(event_id) AS first_line FROM {{events}} e JOIN (VALUES {_SAMPLES}) AS s(kind, lo, hi) ON event_id BETWEEN lo AND hi GROUP BY kind")
sql_query("anti_range_outside",
          f"WITH s AS (SELECT lo, hi, explode(sequence(lo DIV 100, hi DIV 100)) AS b FROM VALUES {_SAMPLES} AS t(kind, lo, hi)) SELECT e.event_id FROM {{events}} e LEFT ANTI JOIN s ON e.event_id DIV 100 = s.b AND e.event_id BETWEEN s.lo AND s.hi",
          f"SELECT event_id FROM {{events}} e ANTI JOIN (VALUES {_SAMPLES}) AS s(kind, lo, hi) ON event_id BETWEEN lo AND hi")
sql_query("join_runners_fullouter",
          "SELECT coalesce(a.k, b.k) AS k, a.n AS left_n, b.n AS right_n, NOT (a.n <=> b.n) AS differs FROM (SELECT lang AS k, count(*) AS n FROM {documents} WHERE doc_id % 2 = 0 GROUP BY lang) a FULL OUTER JOIN (SELECT lang AS k, count(*) AS n FROM {documents} WHERE doc_id % 2 = 1 GROUP BY lang) b ON a.k = b.k",
          "SELECT coalesce(a.k, b.k) AS k, a.n AS left_n, b.n AS right_n, a.n IS DISTINCT FROM b.n AS differs FROM (SELECT lang AS k, count(*) AS n FROM {documents} WHERE doc_id % 2 = 0 GROUP BY lang) a FULL OUTER JOIN (SELECT lang AS k, count(*) AS n FROM {documents} WHERE doc_id % 2 = 1 GROUP BY lang) b ON a.k = b.k")
# a few types have all rows: the last one of each is a partial aggregate, and the table of types is small when it is joined
sql_query("join_lint_by_message", "SELECT e.event_id, e.event_type, l.lint FROM {events} e JOIN (SELECT event_type, max(if(event_id % 7 = 0, event_id, null)) AS lint FROM {events} GROUP BY event_type) l ON e.event_type <=> l.event_type",
          "SELECT event_id, event_type, last_value(CASE WHEN event_id % 7 = 0 THEN event_id END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lint FROM {events}")
sql_query("join_baseline_ratio", "SELECT p_partkey, p_brand, round(p_retailprice / first(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_partkey), 6) AS ratio FROM {part}",
          "SELECT p_partkey, p_brand, round(p_retailprice / first_value(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_partkey), 6) AS ratio FROM {part}")
_LOOKUP = "SELECT d.doc_id, e.vec_id, e.label, e.embedding[{first}] AS head, round({total}, 4) AS total FROM (SELECT doc_id, doc_id % n AS k FROM {{documents}} CROSS JOIN (SELECT count(*) AS n FROM {{embeddings}}) c) d JOIN {{embeddings}} e ON d.k = e.vec_id"
sql_query("embedding_lookup", _LOOKUP.format(first=0, total="aggregate(e.embedding, 0D, (t, x) -> t + x)"), _LOOKUP.format(first=1, total="list_sum(list_transform(e.embedding, lambda x: x::DOUBLE))"))
# copies are combined before the shuffle; what is joined is digests, and Spark splits a join where one has very many rows
sql_query("dedup_same_commit", "WITH k AS (SELECT doc_id, sha2(text, 256) AS digest FROM {documents}) SELECT k.doc_id, f.owner, k.doc_id > f.owner AS dropped FROM k JOIN (SELECT digest, min(doc_id) AS owner FROM k GROUP BY digest) f ON k.digest <=> f.digest",
          "SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS owner, doc_id > min(doc_id) OVER (PARTITION BY sha256(text)) AS dropped FROM {documents}")

# -- aggregates ---------------------------------------------------------------------------------

_BYTES = ("CAST(octet_length(text) AS BIGINT)", "octet_length(encode(text))::BIGINT")


def _measure(n_bytes: str, long_line: str, count_if: str) -> str:
    return f"SELECT source, count(*) AS files, CAST(sum({n_bytes}) AS BIGINT) AS bytes, CAST({count_if}({long_line}) AS BIGINT) AS long_line_files, CAST({count_if}(lang = 'en') AS BIGINT) AS docs_files, CAST(sum(CASE WHEN lang = 'en' THEN {n_bytes} ELSE 0 END) AS BIGINT) AS docs_bytes FROM {{documents}} GROUP BY source"


sql_query("agg_measure_source", _measure(_BYTES[0], r"exists(split(text, '\n'), l -> octet_length(l) > 1000)", "count_if"),
          _measure(_BYTES[1], "len(list_filter(string_split(text, chr(10)), lambda l: octet_length(encode(l)) > 1000)) > 0", "count_if"))
sql_query("agg_category_summary", f"SELECT coalesce(lang, 'all') AS category, count(*) AS files, CAST(sum({_BYTES[0]}) AS BIGINT) AS bytes, count(DISTINCT source) AS sources FROM {{documents}} GROUP BY ROLLUP (lang)",
          f"SELECT coalesce(lang, 'all') AS category, count(*) AS files, CAST(sum({_BYTES[1]}) AS BIGINT) AS bytes, count(DISTINCT source) AS sources FROM {{documents}} GROUP BY ROLLUP (lang)")
sql_query("agg_dedup_counters", "SELECT count(DISTINCT sha2(text, 256)) AS unique_texts, count(*) - count(DISTINCT sha2(text, 256)) AS duplicates, count(*) AS checked FROM {documents}",
          "SELECT count(DISTINCT sha256(text)) AS unique_texts, count(*) - count(DISTINCT sha256(text)) AS duplicates, count(*) AS checked FROM {documents}")
sql_query("agg_counters_files", f"SELECT lang, source, count(*) AS files, CAST(sum({_BYTES[0]}) AS BIGINT) AS bytes FROM {{documents}} GROUP BY GROUPING SETS ((lang, source), (lang), ())",
          f"SELECT lang, source, count(*) AS files, CAST(sum({_BYTES[1]}) AS BIGINT) AS bytes FROM {{documents}} GROUP BY GROUPING SETS ((lang, source), (lang), ())")
_EXT = r"CASE WHEN regexp_extract(url, '[^/?#]*[.]([A-Za-z0-9]+)(?:[?#].*)?$', 1) = '' THEN '(none)' ELSE lower(regexp_extract(url, '[^/?#]*[.]([A-Za-z0-9]+)(?:[?#].*)?$', 1)) END"
sql_query("agg_extension_table", f"SELECT {_EXT} AS extension, count(*) AS files, CAST(sum(octet_length(html)) AS BIGINT) AS bytes FROM {{pages}} GROUP BY 1",
          f"SELECT {_EXT} AS extension, count(*) AS files, CAST(sum(octet_length(encode(html))) AS BIGINT) AS bytes FROM {{pages}} GROUP BY 1")
sql_query("topk_extensions", f"SELECT {_EXT} AS extension, CAST(sum(octet_length(html)) AS BIGINT) AS bytes FROM {{pages}} GROUP BY 1 ORDER BY bytes DESC, extension LIMIT 12",
          f"SELECT {_EXT} AS extension, CAST(sum(octet_length(encode(html))) AS BIGINT) AS bytes FROM {{pages}} GROUP BY 1 ORDER BY bytes DESC, extension LIMIT 12")
sql_query("topk_sources", f"SELECT source, CAST(sum({_BYTES[0]}) AS BIGINT) AS bytes FROM {{documents}} GROUP BY source ORDER BY bytes DESC, source LIMIT 15",
          f"SELECT source, CAST(sum({_BYTES[1]}) AS BIGINT) AS bytes FROM {{documents}} GROUP BY source ORDER BY bytes DESC, source LIMIT 15")
sql_query("topk_hits", "SELECT source, doc_id, n_more FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, greatest(count(*) OVER (PARTITION BY source) - 3, 0) AS n_more FROM {documents}) WHERE rn <= 3",
          "SELECT source, doc_id, n_more FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, greatest(count(*) OVER (PARTITION BY source) - 3, 0) AS n_more FROM {documents}) t WHERE rn <= 3")



def _characters(spark, d, width: int) -> DataFrame:
    """(label, a, b, n): characters of whole texts, or pairs of neighbours, counted in an Arrow map before the shuffle. An empty text has one empty character and no pair."""

    def run(batches):
        for batch in batches:
            counts: dict[str, Counter] = {}
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text is not None:
                    counts.setdefault(label, Counter()).update((text or [""]) if width == 1 else zip(text, text[1:], strict=False))
            rows = [(label, *c, n) if width == 2 else (label, c, None, n) for label, found in counts.items() for c, n in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if k < 3 else pa.int64()) for k in range(4)], names=["label", "a", "b", "n"])

    docs = spread(spark.read.parquet(f"{d}/documents.parquet").select(F.col("lang").alias("label"), "text"))
    return docs.mapInArrow(run, "label string, a string, b string, n long").groupBy("label", "a", "b").agg(F.sum("n").alias("n"))


def _entropy(spark, d):
    counts = _characters(spark, d, 1)
    by = counts.groupBy("label").agg(F.sum("n").alias("letters"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return by.select("label", "letters", F.round(F.log2("letters") - F.col("s") / F.col("letters"), 6).alias("entropy"))


query("agg_entropy", "SELECT label, sum(n)::BIGINT AS letters, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM (SELECT label, c, count(*) AS n FROM (SELECT lang AS label, unnest(string_split(text, '')) AS c FROM documents) GROUP BY label, c) GROUP BY label")(_entropy)
sql_query("agg_eval_mean", "SELECT event_type, round(avg(value), 6) AS mean_value FROM {events} GROUP BY event_type")
# of steps with the greatest value the first one, as the tables have them in the order of event_id
sql_query("agg_window_loss", "SELECT (event_id DIV 100) AS step_window, round(avg(value), 6) AS loss, max(value) AS max_value, max_by(event_id, if(value IS NULL OR event_id IS NULL, NULL, struct(value, -event_id))) AS at_step FROM {events} GROUP BY event_id DIV 100",
          "SELECT (event_id // 100) AS step_window, round(avg(value), 6) AS loss, max(value) AS max_value, arg_max(event_id, value) AS at_step FROM {events} GROUP BY event_id // 100")
sql_query("agg_digest_of_digests", r"SELECT sha2(listagg(concat(source, '\n', h, '\n'), '') WITHIN GROUP (ORDER BY source), 256) AS digest FROM (SELECT source, sha2(CAST(count(*) AS STRING), 256) AS h FROM {documents} GROUP BY source)",
          r"SELECT sha256(string_agg(source || chr(10) || h || chr(10), '' ORDER BY source)) AS digest FROM (SELECT source, sha256(count(*)::VARCHAR) AS h FROM {documents} GROUP BY source)")
sql_query("agg_ratio_badge", "SELECT p_partkey, CASE WHEN r <= 1.05 THEN 'even' WHEN r <= 1.5 THEN 'near' WHEN r <= 5 THEN 'slow' ELSE 'far' END AS badge FROM (SELECT p_partkey, p_retailprice / min(p_retailprice) OVER (PARTITION BY p_brand) AS r FROM {part}) t")
sql_query("agg_checks", "SELECT count(*) AS total, CAST(count_if(toxic = 0) AS BIGINT) AS passed, CAST(count_if(toxic = 1) AS BIGINT) AS failed FROM {labels}")
sql_query("group_sort_failed", "SELECT source, CAST(count_if(toxic = 1) AS BIGINT) AS failed FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY source ORDER BY failed DESC, source")
_PAIRS = "SELECT p[1] AS a, p[2] AS b, count(*) AS n FROM (SELECT unnest(list_zip(l[:-2], l[2:])) AS p FROM (SELECT string_split(text, '') AS l FROM documents WHERE length(text) > 1)) GROUP BY 1, 2"


def _pairs(spark, d):
    return _characters(spark, d, 2).groupBy("a", "b").agg(F.sum("n").alias("n"))


query("agg_pair_counts", _PAIRS)(_pairs)
query("topk_pair", f"SELECT a, b, n FROM ({_PAIRS}) ORDER BY n DESC, a, b LIMIT 1")(lambda spark, d: _pairs(spark, d).orderBy(F.desc("n"), "a", "b").limit(1))

# -- windows ------------------------------------------------------------------------------------

sql_query("win_first_copy", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha2(text, 256) ORDER BY doc_id) AS rn FROM {documents}) WHERE rn = 1",
          "SELECT doc_id FROM {documents} QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
_RATE = "SELECT {m}(dv / dt) AS median_rate, count(*) AS n FROM (SELECT event_type, value - lag(value) OVER (PARTITION BY event_type ORDER BY event_id) AS dv, CAST(event_id - lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id) AS DOUBLE) AS dt FROM {{events}}) t WHERE dv > 0 AND dt > 0"
sql_query("win_tokens_per_second", _RATE.format(m="median").replace("SELECT median(dv / dt)", "SELECT round(median(dv / dt), 6)"))
_H, _DH = "sha2(concat('7', char(0), CAST(doc_id AS STRING)), 256)", "sha256('7' || chr(0) || doc_id::VARCHAR)"
sql_query("sample_hash", f"SELECT doc_id, {_H} AS h FROM {{documents}} ORDER BY h LIMIT 100", f"SELECT doc_id, {_DH} AS h FROM {{documents}} ORDER BY h LIMIT 100")


def _sample(h: str, size: str, cap: bool) -> str:
    inner = f"SELECT doc_id, source, {h} AS h, {size} AS size FROM {{documents}}"
    if cap:
        inner = f"SELECT doc_id, source, h, size FROM (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size AS taken FROM ({inner}) a) b WHERE taken < 20000"
    return f"SELECT doc_id, source, CAST(size AS BIGINT) AS size FROM (SELECT *, sum(size) OVER (ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size AS taken FROM ({inner}) c) d WHERE taken < 200000"




def _sampled(cap: bool):
    """Rows in the order of a hash until 200,000 bytes are taken; with a cap, no more than 20,000 of a source."""

    def run(spark, d):
        rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", F.expr(_H).alias("h"), F.octet_length("text").cast("long").alias("size"))
        if cap:
            taken = F.sum("size").over(Window.partitionBy("source").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
            rows = rows.withColumn("taken", taken).where("taken < 20000").drop("taken")
        summed = windows.running_sum(rows, F.col("size"), windows.hex_part(F.col("h")), ["h", "doc_id"], "upto")
        return summed.where(F.col("upto") - F.col("size") < 200_000).select("doc_id", "source", "size")

    return run


query("win_sample_cumsum", _sample(_DH, _BYTES[1], False).replace("{documents}", "documents"))(_sampled(False))
query("win_sample_cap", _sample(_DH, _BYTES[1], True).replace("{documents}", "documents"))(_sampled(True))


def _pick_rows(spark, d):
    """Twenty rows at even distances: numbers by ranges of the key, then a join with the twenty numbers."""
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", "value")
    n = rows.count()
    numbered = windows.running_total(rows, F.lit(1), ["event_id"], "upto")
    picks = spark.range(20).select(F.bround(F.col("id") * (n - 1) / F.lit(19.0)).cast("long").alias("i"))
    return numbered.withColumn("i", F.col("upto") - 1).join(F.broadcast(picks), "i").select("event_id", "value")


query("win_pick_rows", "SELECT event_id, value FROM (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events) r JOIN (SELECT range AS k FROM range(20)) p ON r.i = round_even(p.k * (r.n - 1) / 19.0, 0)")(_pick_rows)
sql_query("win_eval_even", "SELECT id AS k, id * 1000 DIV 37 AS seq FROM range(37)", "SELECT range AS k, range * 1000 // 37 AS seq FROM range(37)")
sql_query("win_seq_ends", "SELECT source, CAST(sum(n) OVER (ORDER BY source ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seq_end FROM (SELECT source, sum(greatest((n_chars - 1) DIV 128, 0)) AS n FROM {documents} GROUP BY source)",
          "SELECT source, CAST(sum(n) OVER (ORDER BY source ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seq_end FROM (SELECT source, sum(greatest((n_chars - 1) // 128, 0)) AS n FROM {documents} GROUP BY source)")
sql_query("win_group_denominator", "SELECT p_partkey, first(if(p_partkey % 3 = 0, p_retailprice, null), true) OVER w AS denominator, min(p_retailprice) OVER (PARTITION BY p_brand) AS fastest FROM {part} WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
          "SELECT p_partkey, first_value(CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END IGNORE NULLS) OVER w AS denominator, min(p_retailprice) OVER (PARTITION BY p_brand) AS fastest FROM {part} WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
sql_query("win_last_eval_wins", "SELECT step, value FROM (SELECT event_id DIV 2 AS step, value, row_number() OVER (PARTITION BY event_id DIV 2 ORDER BY event_id DESC) AS rn FROM {events}) WHERE rn = 1",
          "SELECT event_id // 2 AS step, value FROM {events} QUALIFY row_number() OVER (PARTITION BY event_id // 2 ORDER BY event_id DESC) = 1")
_FFILL = "SELECT user_id, event_id, {last} OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM {{events}}"
sql_query("win_ffill_section", _FFILL.format(last="last(if(event_type = 'view', event_id, null), true)"), _FFILL.format(last="last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS)"))
sql_query("win_prev_name", "SELECT conv_id, turn, last(if(role = 'user', text, null), true) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM {conversations}",
          "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM {conversations}")
query("win_running_max", "SELECT event_id, max(value) OVER (PARTITION BY event_type ORDER BY event_id) AS running_max FROM events")(
    lambda spark, d: windows.running_max(spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type", "value"), "event_type", "value", ["event_id"], "running_max").select("event_id", "running_max")
)

# -- sets ---------------------------------------------------------------------------------------

query("dedup_exact", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")(
    lambda spark, d: spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "text")).groupBy(F.sha2("text", 256)).agg(F.min(F.struct("doc_id", "source")).alias("first")).select("first.*")
)
sql_query("dedup_contains", "SELECT doc_id FROM {documents} d LEFT SEMI JOIN (SELECT sha2(text, 256) AS h FROM {documents} WHERE lang = 'en') s ON sha2(d.text, 256) = s.h",
          "SELECT doc_id FROM {documents} d SEMI JOIN (SELECT sha256(text) AS h FROM {documents} WHERE lang = 'en') s ON sha256(d.text) = s.h")
sql_query("dedup_candidates", "SELECT k, min(ord) AS ord FROM (SELECT lower(source) AS k, doc_id AS ord FROM {documents} UNION ALL SELECT upper(source) AS k, doc_id + 1000000 AS ord FROM {documents}) GROUP BY k",
          "SELECT k, min(ord) AS ord FROM (SELECT lower(source) AS k, doc_id AS ord FROM {documents} UNION ALL SELECT upper(source) AS k, doc_id + 1000000 AS ord FROM {documents}) t GROUP BY k")
sql_query("set_compare_names", "SELECT 'missing' AS what, doc_id FROM (SELECT doc_id FROM {documents} EXCEPT SELECT doc_id FROM {labels}) UNION ALL SELECT 'unexpected' AS what, doc_id FROM (SELECT doc_id FROM {labels} EXCEPT SELECT doc_id FROM {documents})",
          "SELECT 'missing' AS what, doc_id FROM (SELECT doc_id FROM {documents} EXCEPT SELECT doc_id FROM {labels}) a UNION ALL SELECT 'unexpected' AS what, doc_id FROM (SELECT doc_id FROM {labels} EXCEPT SELECT doc_id FROM {documents}) b")
sql_query("set_all_equal", "SELECT source, count(DISTINCT lang) = 1 AND count(*) = count(lang) AS all_equal FROM {documents} GROUP BY source")
sql_query("union_kinds", "SELECT doc_id, 'code' AS kind, 0 AS ord FROM {documents} WHERE lang <> 'en' UNION ALL SELECT doc_id, 'docs' AS kind, 1 AS ord FROM {documents} WHERE lang = 'en'")
sql_query("sort_paths", "SELECT url FROM {pages} ORDER BY url")
sql_query("split_holdout_sources", f"SELECT source, {_BUCKET} < 10 AS held_out, count(*) AS files, CAST(sum({_BYTES[0]}) AS BIGINT) AS bytes FROM {{documents}} GROUP BY source",
          f"SELECT source, {_DUCK_BUCKET} < 10 AS held_out, count(*) AS files, CAST(sum({_BYTES[1]}) AS BIGINT) AS bytes FROM {{documents}} GROUP BY source")
