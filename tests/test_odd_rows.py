"""Queries against their DuckDB SQL on rows that the tables don't have, or only have where they are large."""

from collections import Counter

import duckdb

from corploom.plans import all_oracles, all_queries

DOCUMENTS = "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT"


def held_against_sql(spark, folder, name, table, columns, rows):
    """The result of a query over ``rows`` of one table, which must be that of its SQL."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE {table} ({columns})")
    con.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    con.execute(f"COPY {table} TO '{folder}/{table}.parquet' (FORMAT parquet)")
    df, want = all_queries()[name](spark, str(folder)), con.sql(all_oracles()[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    got, at = Counter(tuple(r[c] for c in names) for r in df.collect()), [want.columns.index(c) for c in names]
    assert got == Counter(tuple(r[k] for k in at) for r in want.fetchall())
    return got


def test_entropy_of_empty_texts(spark, tmp_path):
    rows = [(1, "ab\0", "en", "s", 3), (2, "", "en", "s", 0), (3, "", "de", "s", 0), (4, None, "fr", "s", 0), (5, "é\r\n", None, "s", 4), (6, "", None, "s", 0), (7, "aaaa", "es", "s", 4)]
    got = held_against_sql(spark, tmp_path, "agg_entropy", "documents", DOCUMENTS, rows)
    assert (0.0, "de", 1) in got and {r[1]: r[2] for r in got} == {"en": 4, "de": 1, None: 5, "es": 4}


#: Ids whose digest at the generic rule's place has under 3.5 bits a character, so that it is no secret by that rule as it is.
FLAT = [27780, 55670, 62660, 117920, 126790]


def test_findings_by_rule_of_flat_digests(spark, tmp_path):
    got = held_against_sql(spark, tmp_path, "agg_findings_by_rule", "documents", DOCUMENTS, [(i, "x", "en", "s", 1) for i in FLAT])
    assert ("generic-secret" in {r[1] for r in got}) and {r[0] for r in got if r[1] == "generic-secret"} == {len(FLAT)}


def test_scrub_kinds_of_flat_digests(spark, tmp_path):
    got = held_against_sql(spark, tmp_path, "scrub_kinds", "documents", DOCUMENTS, [(i, "x", "en", "s", 1) for i in [*FLAT, 10, 10]])
    assert all((i, 76, 1, "generic-secret", 12) in got for i in FLAT) and (10, 76, 2, "generic-secret", 12) in got


EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR"


def test_window_loss_of_equal_values(spark, tmp_path):
    rows = [(i, None, 1, "view", 5.0 if i % 10 == 3 else float(i % 5), None) for i in range(250)]
    rows += [(300, None, 1, "view", None, None), (400, None, 1, "view", None, None), (401, None, 1, "view", 2.0, None), (-150, None, 1, "view", 1.0, None), (-120, None, 1, "view", 1.0, None), (None, None, 1, "view", 1.0, None)]
    got = held_against_sql(spark, tmp_path, "agg_window_loss", "events", EVENTS, rows)
    assert {3, 103, 203, 401, -150} <= {r[0] for r in got}


def test_io_pairs_in_single_precision(spark, tmp_path):
    values = [0.29, 0.57, 0.58, 1.13, 1.14, 1.15, -0.29, -0.57, 0.07]
    rows = [(1, values, 0), (2, [], 0), (3, None, 0), (4, values[:5], 0), (5, [0.29, None, None, None, None, None], 0), (6, values[:4], 0), (7, [None] * 5, 0)]
    got = held_against_sql(spark, tmp_path, "io_pairs", "embeddings", "vec_id BIGINT, embedding FLOAT[], label INTEGER", rows)
    assert (0, 29 + 57 + 58 + 113, 1, 57 + 58 + 113 + 114) in got and (0, 29, 5, None) in got
