"""Settings as rows: model settings in a flat strict form, and the licence that a package file declares."""

from __future__ import annotations

import tomllib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reports import normalized_license

#: The version of the form and its keys with their types.
SCHEMA_VERSION = 1
KEYS = {"vocab_size": "long", "d_model": "long", "n_layers": "long", "n_heads": "long", "n_kv_heads": "long", "d_ff": "long", "max_seq_len": "long", "rope_theta": "float", "norm_eps": "float", "tie_embeddings": "boolean"}
_SHAPE = {"long": (r"^\+?[0-9]+$", "a non-negative integer"), "float": (r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$", "a number"), "boolean": ("^(true|false)$", "true or false")}


def read_model_settings(files: DataFrame) -> DataFrame:
    """(path, one column for each key, error) of texts of ``key = value`` lines; ``#`` starts a comment, ``_`` may part digits.

    The first fault of a file is told, and its values are null. They are looked for in this order: a line that is no pair,
    a missing or other version, then by lines a repeated, unknown or ill-formed key, then missing keys, then values that
    can't be. A null text is an empty one. No shuffle.
    """
    plain = F.transform(F.split(F.coalesce("value", F.lit("")), "\r?\n"), lambda x, i: F.struct((i + 1).cast("string").alias("no"), F.trim(F.regexp_replace(F.split(x, "#", 2)[0], r"\s", " ")).alias("s")))
    cut = files.select("path", F.filter(plain, lambda x: x["s"] != "").alias("lines"))
    pair = lambda x: F.struct(x["no"].alias("no"), F.trim(F.split(x["s"], "=", 2)[0]).alias("k"), F.trim(F.get(F.split(x["s"], "=", 2), F.lit(1))).alias("v"))
    cut = cut.select("path", F.get(F.filter("lines", lambda x: ~F.contains(x["s"], F.lit("="))), F.lit(0))["no"].alias("odd"), F.transform("lines", pair).alias("e"))
    value_of = lambda key: F.get(F.filter("e", lambda x: x["k"] == key), F.lit(0))["v"]
    number = F.when(F.col("odd").isNull(), F.regexp_replace(value_of("schema_version"), "_", ""))
    names = list(KEYS)

    def fault(x: Column, i: Column) -> Column:
        twice = F.array_contains(F.transform(F.slice("e", F.lit(1), i), lambda y: y["k"]), x["k"])
        said = F.when(twice, F.concat(F.lit("duplicate key `"), x["k"], F.lit("`"))).when(~x["k"].isin("schema_version", *names), F.concat(F.lit("unknown key `"), x["k"], F.lit("`")))
        for kind, (shape, words) in _SHAPE.items():
            value = F.regexp_replace(x["v"], "_", "") if kind != "boolean" else x["v"]
            bad = ~value.rlike(shape) | (value.try_cast(kind).isNull() if kind != "boolean" else F.lit(False))
            said = said.when(x["k"].isin(*[k for k, t in KEYS.items() if t == kind]) & bad, F.concat(F.lit("`"), x["k"], F.lit(f"` must be {words}, got `"), x["v"], F.lit("`")))
        return F.when(said.isNotNull(), F.concat(F.lit("line "), x["no"], F.lit(": "), said))

    cut = cut.withColumn("version", number).withColumn("fault", F.get(F.array_compact(F.transform("e", fault)), F.lit(0)))
    cut = cut.withColumn("absent", F.array_join(F.array_except(F.array(*map(F.lit, names)), F.transform("e", lambda x: x["k"])), ", "))
    values = [(F.regexp_replace(value_of(k), "_", "") if t != "boolean" else value_of(k)).try_cast(t).alias(k) for k, t in KEYS.items()]
    rows = cut.select("path", "odd", "version", "fault", "absent", *values)
    error = F.when(F.col("odd").isNotNull(), F.concat(F.lit("line "), "odd", F.lit(": expected `key = value`")))
    error = error.when(F.col("version").isNull(), "no `schema_version`").when(~F.col("version").rlike(r"^\+?[0-9]+$"), "`schema_version` must be a non-negative integer")
    error = error.when(F.coalesce(F.col("version").try_cast("long") != SCHEMA_VERSION, F.lit(True)), F.concat(F.lit("version "), "version", F.lit(f" is not {SCHEMA_VERSION}")))
    error = error.when(F.col("fault").isNotNull(), F.col("fault")).when(F.col("absent") != "", F.concat(F.lit("missing "), "absent"))
    # Infinity is more than any number a setting may be
    for k in [k for k, t in KEYS.items() if t != "boolean"]:
        error = error.when(~(F.col(k) > 0) | F.col(k).cast("double").isin(float("inf"), float("nan")), f"`{k}` must be positive")
    head = F.expr("d_model div nullif(n_heads, 0)")
    error = error.when(F.expr("d_model % nullif(n_heads, 0)") != 0, "d_model is not divisible by n_heads").when(F.expr("n_heads % nullif(n_kv_heads, 0)") != 0, "n_heads is not divisible by n_kv_heads").when(head % 2 == 1, "the head's width must be even")
    rows = rows.withColumn("error", error)
    return rows.select("path", *[F.when(F.col("error").isNull(), F.col(k)).alias(k) for k in names], "error")


def model_settings_text(settings: DataFrame) -> DataFrame:
    """(path, value): settings as the text that ``read_model_settings`` reads back to equal values."""
    shown = lambda k, t: F.concat(F.lit(f"{k} = "), F.col(k).cast(t).cast("string"), F.lit("\n"))
    return settings.select("path", F.concat(F.lit(f"schema_version = {SCHEMA_VERSION}\n"), *[shown(k, t) for k, t in KEYS.items()]).alias("value"))


def parameters(settings: DataFrame) -> DataFrame:
    """(path, embedding, attention, mlp, norms, lm_head, total): the numbers of weights, as exact decimals; null where settings are."""
    d, v, n, f = [F.col(c).cast("decimal(19,0)") for c in ("d_model", "vocab_size", "n_layers", "d_ff")]
    kv = F.expr("n_kv_heads * (d_model div n_heads)").cast("decimal(19,0)")
    parts = {"embedding": v * d, "attention": n * (2 * d * d + 2 * d * kv), "mlp": n * 3 * d * f, "norms": (2 * n + 1) * d, "lm_head": F.when(F.col("tie_embeddings"), 0).otherwise(v * d)}
    out = settings.select("path", *[c.cast("decimal(38,0)").alias(k) for k, c in parts.items()])
    return out.withColumn("total", sum((F.col(k) for k in list(parts)[1:]), F.col("embedding")).cast("decimal(38,0)"))


def package_licenses(files: DataFrame) -> DataFrame:
    """(path, license) that package files in TOML declare: the package's, else the workspace's package's; null for no such text and for what is no TOML."""

    def declared(text: str | None) -> str | None:
        try:
            found = tomllib.loads(text or "")
        except (tomllib.TOMLDecodeError, RecursionError):
            return None
        outer = found.get("workspace")
        tables = (found.get("package"), outer.get("package") if isinstance(outer, dict) else None)
        return next((t["license"] for t in tables if isinstance(t, dict) and isinstance(t.get("license"), str)), None)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([declared(t) for t in batch.column("value").to_pylist()], pa.string())], names=["path", "license"])

    rows = files.select(F.col("path").cast("string").alias("path"), F.col("value").cast("string").alias("value")).mapInArrow(run, "path string, license string")
    return rows.withColumn("license", normalized_license(F.col("license")))
