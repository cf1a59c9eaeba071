"""Queries of the operators of this subpackage and their DuckDB SQL; ``__spark_entry__`` adds them."""

from __future__ import annotations

from ..session import spread, table
from . import bpe_codec, decontaminate, importance, licenses, periodic_runs, pii, quality, simhash, substring_dedup, token_counts, token_files, toxicity, url_filter


def _docs(spark, d):
    """``documents``, dealt out where it has fewer partitions than there are cores."""
    return spread(table(spark, d, "documents"))


QUERIES = {
    "op1_quality_rules": lambda spark, d: quality.op1_quality_rules(_docs(spark, d)),
    "op5_bpe_codec": lambda spark, d: bpe_codec.op5_bpe_codec(_docs(spark, d)),
    "op3_token_counts": lambda spark, d: token_counts.op3_token_counts(_docs(spark, d)),
    "op4_toxicity": lambda spark, d: toxicity.op4_toxicity(_docs(spark, d), table(spark, d, "labels")),
    "op6_license_scan": lambda spark, d: licenses.op6_license_scan(_docs(spark, d)),
    "op7_url_filter": lambda spark, d: url_filter.op7_url_filter(table(spark, d, "pages")),
    "op2_pii": lambda spark, d: pii.op2_pii(_docs(spark, d)),
    "op8_simhash": lambda spark, d: simhash.op8_simhash(_docs(spark, d)),
    "op9_substring_dedup": lambda spark, d: substring_dedup.op9_substring_dedup(_docs(spark, d)),
    "op10_decontaminate": lambda spark, d: decontaminate.op10_decontaminate(_docs(spark, d), table(spark, d, "benchmark")),
    "op11_token_files": lambda spark, d: token_files.op11_token_files(_docs(spark, d)),
    "op12_importance": lambda spark, d: importance.op12_importance(_docs(spark, d), table(spark, d, "benchmark")),
    "op13_periodic_runs": lambda spark, d: periodic_runs.op13_periodic_runs(_docs(spark, d)),
}
ORACLES = {"op1_quality_rules": quality.OP1_SQL, "op6_license_scan": licenses.OP6_SQL, "op7_url_filter": url_filter.OP7_SQL}
