"""File listings, strict logs and shard headers: rows made of the tables in, judged rows out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import listing
from .registry import query
from .tables import sql_query, views


def _both(name: str, sql: str, values: str, columns: str = "") -> None:
    """Registers one statement over rows, literal ones or those of a SELECT; ``{v}`` stands for them, ``{rlike}`` for the dialect's search by pattern."""
    made = f"({values}) AS t" if values.startswith("SELECT") else None
    sql_query(name, sql.replace("{v}", made or f"VALUES {values} AS t({columns})").replace("{rlike}", "regexp_like"),
              sql.replace("{v}", made or f"(VALUES {values}) AS t({columns})").replace("{rlike}", "regexp_matches"))


def _case(*forms: str) -> str:
    """One of the forms for each page, by turns; ``~`` stands for its id."""
    whens = " ".join(f"WHEN {k} THEN '{form}'" for k, form in enumerate(forms))
    return f"replace(CASE page_id % {len(forms)} {whens} END, '~', CAST(page_id AS STRING))"


# -- listings --------------------------------------------------------------------------------------

_FILES = "SELECT " + _case("src/a~.rs", ".profile~", "bin/run~", "bin/x~", "target/b~.rs", "a b~.rs", "empty~.rs", "big~.rs", "README~.md", "CHANGELOG~.md", "docs/changelog~.txt", "d/.cache/~.sh") + " AS path, CASE page_id % 12 WHEN 6 THEN 0 WHEN 7 THEN 2000000 ELSE 10 END AS size, CASE page_id % 12 WHEN 1 THEN '#!/bin/sh' WHEN 2 THEN '#!/usr/bin/env bash' WHEN 3 THEN '#!/usr/bin/bashful' ELSE '' END AS head FROM {pages}"


def _files(spark, d):
    return spark.sql(views(spark, d, _FILES))


def _selected(files):
    """Code of both categories and documentation, by the reader's rules."""
    parts = [listing.select_files(files, "rust"), listing.select_files(files, "shell"), listing.select_files(files, "", kind="docs")]
    return [p.select("path", F.lit(kind).alias("kind")) for p, kind in zip(parts, ("rust", "shell", "docs"), strict=True)]


def _kinds(files):
    """Every file by the reader's rules for code and documentation, those too that a walk passes by."""
    return files.select("path", (listing.is_kind("rust") | listing.is_kind("shell")).alias("code"), listing.is_kind("", "docs").alias("docs"))


#: The reader's rules in SQL over (path, size, head), each row held against all of them.
_NAME = "regexp_extract(path, '([^/]*)$', 1)"
_RUST, _DOCS = "path LIKE '%.rs'", f"regexp_matches(lower({_NAME}), '[.](md|markdown|rst)$') AND NOT regexp_matches(upper({_NAME}), '^(CHANGELOG|CHANGES|HISTORY|NEWS|RELEASE)')"
_SHELL = (f"regexp_matches({_NAME}, '[.](sh|bash|zsh|fish|bats)$|^(Makefile|makefile|GNUmakefile|Dockerfile)$')"
          rf" OR regexp_matches({_NAME}, '^[.]*[^.]+$') AND regexp_matches(coalesce(head, ''), '^#!\s*(/usr/bin/env\s+(-S\s+)?|/\S*/)?(sh|bash|zsh|dash|ksh|fish)([^A-Za-z0-9_]|$)')")
_TAKEN = "size > 0 AND size <= 1048576 AND NOT contains(path, ' ') AND NOT regexp_matches(path, '(^|/)([.]git|target|node_modules|vendor|third_party|build|dist)/')"
WALK_SQL = f"SELECT path, CASE WHEN {_RUST} THEN 'rust' WHEN {_SHELL} THEN 'shell' ELSE 'docs' END AS kind FROM {{v}} WHERE ({_RUST} OR {_SHELL} OR {_DOCS}) AND {_TAKEN}"
CODE_SQL = f"SELECT path, ({_RUST} OR {_SHELL}) AS code, ({_DOCS}) AS docs FROM {{v}}"
_LISTED = f"({_FILES}) t".replace("{pages}", "pages")
query("walk_select_files", WALK_SQL.replace("{v}", _LISTED))(lambda spark, d: reduce(DataFrame.unionByName, _selected(_files(spark, d))))
_both("fileset_walk_dotskip", "SELECT path FROM {v} WHERE NOT {rlike}(path, '(^|/)[.]')", _FILES)
query("p_is_code", CODE_SQL.replace("{v}", _LISTED))(lambda spark, d: _kinds(_files(spark, d)))
sql_query("read_list", "SELECT doc_id, trim(line) AS path FROM (SELECT doc_id, explode(split(text, '\\n')) AS line FROM {documents}) WHERE trim(line) <> ''",
          "SELECT doc_id, trim(line) AS path FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM {documents}) t WHERE trim(line) <> ''")
sql_query("files_list_write", "SELECT concat_ws(char(9), lang, 'docs', source, doc_id) AS line FROM {documents} WHERE NOT text LIKE '%All rights reserved%'",
          "SELECT concat_ws(chr(9), lang, 'docs', source, doc_id) AS line FROM {documents} WHERE NOT text LIKE '%All rights reserved%'")

# -- strict logs -----------------------------------------------------------------------------------

_TSV = "(1, 'step,loss,tokens'), (2, '1,8.3,2048'), (3, '2,x,4096'), (4, '3,7.9'), (5, '4,7.5,8192')"
_both("tsv_log_read", "SELECT n AS line_no, CASE WHEN n = 1 THEN line = 'step,loss,tokens' ELSE {rlike}(line, '^[0-9]+,[0-9]+([.][0-9]+)?,[0-9]+$') END AS ok FROM {v}", _TSV, "n, line")
_SMOKE = "SELECT page_id, " + _case("loss ~.5674 -> 0.~, accuracy 0.~", "done ~", "no loss ~", "loss 8.5 -> 1.25, accuracy 1.000") + " AS line FROM {pages}"
_both("log_train_smoke", "SELECT page_id, CAST(regexp_extract(line, 'loss ([0-9.]+) -> ([0-9.]+)', 1) AS DOUBLE) AS first_loss, CAST(regexp_extract(line, 'loss ([0-9.]+) -> ([0-9.]+)', 2) AS DOUBLE) AS last_loss, CAST(regexp_extract(line, 'accuracy ([0-9.]+)', 1) AS DOUBLE) AS accuracy FROM {v} WHERE line LIKE 'loss %'", _SMOKE)
sql_query("join_moments_params", "SELECT coalesce(d.doc_id, l.doc_id) AS name, d.doc_id IS NULL AS no_param, l.doc_id IS NULL AS no_moment FROM {documents} d FULL OUTER JOIN {labels} l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")

# -- special tokens, shards ------------------------------------------------------------------------

_TOKENS = "SELECT page_id, " + _case("<|a~|>", "", "<|pad|>", " <|x~|>", "<|b~|>", "<|c~|>", "<|d' || chr(10) || '~|>", "<|e~|>' || chr(13) || '") + " AS token FROM {pages}"
_both("special_validate", "SELECT page_id, token, token <> '' AND trim(token) = token AND NOT contains(token, chr(10)) AND NOT contains(token, chr(13)) AND row_number() OVER (PARTITION BY token ORDER BY page_id) = 1 AS ok FROM {v}", _TOKENS)
_SHARDS = "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 65536 WHEN 2 THEN 65537 ELSE page_id END AS vocab, page_id % 300 AS eos, CASE page_id % 4 WHEN 1 THEN 65535 + page_id % 3 ELSE page_id END AS top FROM {pages}"
_both("shard_width", "SELECT DISTINCT vocab, CASE WHEN vocab <= 65536 THEN 2 ELSE 4 END AS width FROM {v}", _SHARDS)
_both("shard_validate", "SELECT page_id, vocab, eos, top, vocab > 0 AND eos < vocab AND top < vocab AS ok FROM {v}", _SHARDS)
