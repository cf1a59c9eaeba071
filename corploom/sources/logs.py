"""Run logs as rows: files(path, value), one whole file in each row, read strictly; the first fault refuses a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that a run's summary must have.
SUMMARY_KEYS = ("steps", "total_steps", "tokens", "finished")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of the text files at ``path``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def _lines(value: str = "value"):
    return F.filter(F.split(F.coalesce(value, F.lit("")), "\r\n|\r|\n"), lambda x: F.trim(x) != "")


def read_tsv(files: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(path, line_no, one double for each column, error): rows of tab-separated logs whose first line names the columns.

    Blank lines don't count. A file with a fault gives one row: its line and the message, and no values.
    A null text is an empty file, whose first line is missing. No shuffle.
    """
    header, n = "\t".join(columns), len(columns)
    cut = files.select("path", _lines().alias("lines")).select("path", F.coalesce(F.get("lines", F.lit(0)) == header, F.lit(False)).alias("headed"), F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))).alias("lines"))

    def judged(line, i):
        fields = F.split(line, "\t", -1)
        no = (i + 2).cast("string")
        error = F.when(F.size(fields) != n, F.concat(F.lit("line "), no, F.lit(" has "), F.size(fields).cast("string"), F.lit(f" fields, not {n}")))
        error = error.when(F.exists(fields, lambda f: F.trim(f).try_cast("double").isNull()), F.concat(F.lit("line "), no, F.lit(" has a field that is not a number")))
        return F.struct((i + 2).alias("line_no"), F.transform(fields, lambda f: F.trim(f).try_cast("double")).alias("v"), error.alias("error"))

    rows = cut.select("path", "headed", F.transform("lines", judged).alias("rows"))
    none = F.struct(F.lit(1).alias("line_no"), F.array().cast("array<double>").alias("v"), F.lit("the first line is not " + header.replace("\t", " ")).alias("error"))
    bad = F.slice(F.filter("rows", lambda r: r["error"].isNotNull()), 1, 1)
    kept = F.when(~F.col("headed"), F.array(none)).when(F.size(bad) > 0, bad).otherwise(F.col("rows"))
    out = rows.select("path", F.explode(kept).alias("r"))
    return out.select("path", F.col("r.line_no").alias("line_no"), *[F.when(F.col("r.error").isNull(), F.get("r.v", F.lit(k))).alias(c) for k, c in enumerate(columns)], F.col("r.error").alias("error"))


def last_of_step(rows: DataFrame, step: str = "step") -> DataFrame:
    """Of rows of one path with the same step, the one with the last line."""
    values = [c for c in rows.columns if c not in ("path", step)]
    return rows.groupBy("path", step).agg(F.max_by(F.struct(*values), "line_no").alias("r")).select("path", step, "r.*")


def read_summaries(files: DataFrame, required: tuple[str, ...] = SUMMARY_KEYS) -> DataFrame:
    """(path, values, error): the ``key value`` lines of each file as a map, of a repeated key the last; a fault gives null values.

    All keys in ``required`` must be there; numbers must be whole ones and ``finished`` true or false.
    """
    cut = files.select("path", F.transform(_lines(), lambda x: F.split(F.regexp_replace(x, r"^\s+|\s+$", ""), r"\s+")).alias("pairs"))
    shape = F.get(F.filter("pairs", lambda p: F.size(p) != 2), F.lit(0))
    # the last of equal keys
    last = F.filter("pairs", lambda p, i: F.size(F.filter(F.slice(F.col("pairs"), i + 2, F.size("pairs")), lambda q: q[0] == p[0])) == 0)
    rows = cut.select("path", shape.alias("shape"), F.when(shape.isNull(), F.map_from_entries(F.transform(last, lambda p: F.struct(p[0], p[1])))).alias("m"))
    error = F.when(F.col("shape").isNotNull(), F.concat(F.lit("`"), F.array_join("shape", " "), F.lit("` is not `key value`")))
    for key in required:
        error = error.when(~F.coalesce(F.map_contains_key("m", key), F.lit(False)), F.lit(f"no `{key}`"))
    for key in required:
        value = F.try_element_at("m", F.lit(key))
        broken = ~value.isin("true", "false") if key == "finished" else ~value.rlike("^[+-]?[0-9]+$")
        error = error.when(broken, F.concat(F.lit(f"{key} is `"), value, F.lit("`")))
    return rows.withColumn("error", error).select("path", F.when(F.col("error").isNull(), F.col("m")).alias("values"), "error")
