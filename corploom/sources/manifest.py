"""Source manifests: a header line, then a blank line and six ``key: value`` lines for each source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spdx

#: The keys of a record, in order.
KEYS = ("id", "url", "revision", "license", "fetched", "category")
#: Lines of a record with the blank one before it.
LINES = len(KEYS) + 1


def _first(*rules: tuple[Column, Column]) -> Column:
    """The message of the first rule that is broken; null if none is."""
    chosen = F.when(rules[0][0], rules[0][1])
    for broken, message in rules[1:]:
        chosen = chosen.when(broken, message)
    return chosen


def _says(*parts) -> Column:
    return F.concat(*[F.coalesce(p, F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])


def _fault(rank: int, line: Column, message: Column) -> Column:
    return F.when(message.isNotNull(), F.struct(F.lit(rank).alias("rank"), line.cast("int").alias("line"), message.alias("error")))


def field_error(known: Column, repeated: Column) -> Column:
    """What is wrong with a record, as text, or null; ``known`` tells whether its licence parses, ``repeated`` whether its id came before."""
    rules = []
    for key in KEYS:
        rules.append((F.col(key).rlike(r"\p{Cc}"), _says(f"`{key}` of `", F.col("id"), "` contains a control character")))
        rules.append((F.col(key).rlike(r"(?U)^\s|\s$"), _says(f"`{key}` of `", F.col("id"), "` has spaces at an end")))
    date = F.col("fetched").rlike(r"^(19[7-9]\d|[2-9]\d{3})-\d\d-\d\d$") & F.expr("try_to_date(fetched, 'yyyy-MM-dd') is not null")
    rules += [
        (~F.col("id").rlike("^[A-Za-z0-9._/-]{1,128}$"), _says("id `", F.col("id"), "` isn't 1 to 128 letters, digits and . _ / -")),
        (~F.col("url").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/]\S*$") | (F.octet_length("url") > 512), _says("`url` of `", F.col("id"), "` isn't scheme://host/...")),
        (~F.col("revision").rlike("^([0-9a-f]{40}|[0-9a-f]{64})$"), _says("`revision` of `", F.col("id"), "` isn't 40 or 64 hex digits")),
        (~known, _says("`license` of `", F.col("id"), "` doesn't parse")),
        (~date, _says("`fetched` of `", F.col("id"), "` isn't a date from 1970")),
        (~F.col("category").rlike("^[a-z0-9_-]{1,32}$"), _says("`category` of `", F.col("id"), "` isn't 1 to 32 of a-z, 0-9, _ and -")),
        (repeated, _says("id `", F.col("id"), "` is already in the manifest")),
    ]
    return _first(*rules)


def read_manifests(files: DataFrame, header: str = "manifest 1") -> DataFrame:
    """(path, ord, id, url, revision, license, fetched, category, line, error) of files(path, value), a whole manifest in each row.

    The layout is strict, so a line's number alone tells what it must be. A file with any fault gives one
    row, with the number of the line (0: the file as a whole) and the message of its first fault, and no
    sources; a null text is an empty file. A header alone gives no row. Paths must be distinct.
    """
    text = F.coalesce("value", F.lit(""))
    cut = files.select("path", text.alias("value"), F.split(text, "\n").alias("all"))
    cut = cut.withColumn("all", F.slice("all", 1, F.greatest(F.size("all") - 1, F.lit(0)))).withColumn("n", F.size("all"))
    returns = F.array_position(F.transform(F.split("value", "\n"), lambda x: F.contains(x, F.lit("\r"))), True)
    whole = _first(
        (F.col("value") == "", F.lit("the file is empty")),
        (~F.col("value").endswith("\n"), F.lit("the file must end with a newline")),
    )
    early = F.coalesce(
        F.when(returns > 0, F.struct(F.lit(0).alias("rank"), returns.cast("int").alias("line"), F.lit("carriage returns are not allowed").alias("error"))),
        _fault(0, F.lit(0), whole),
        _fault(0, F.lit(1), F.when(F.get("all", F.lit(0)) != header, F.lit(f"the first line must be `{header}`"))),
        _fault(1, F.col("n") + 1, F.when((F.col("n") - 1) % LINES != 0, _says("the file ends where `", F.get(F.array(*map(F.lit, KEYS)), (F.col("n") - 1) % LINES - 1), ":` was expected"))),
    )
    line = cut.select("path", F.posexplode("all").alias("at", "line")).where("at > 0").select("path", "line", (F.col("at") + 1).alias("no"), ((F.col("at") - 1) % LINES).alias("k"), F.floor((F.col("at") - 1) / LINES).cast("int").alias("ord"))
    key = F.get(F.array(*map(F.lit, KEYS)), F.col("k") - 1)
    begins = F.concat(key, F.lit(": "))
    wrong = _first(
        ((F.col("k") == 0) & (F.col("line") != ""), F.lit("expected a blank line before the next source")),
        ((F.col("k") > 0) & ~F.startswith("line", begins), _says("expected `", key, ": <value>`")),
        ((F.col("k") > 0) & (F.col("line") == begins), _says("`", key, "` has no value")),
    )
    line = line.select("path", "ord", "k", "line", _fault(1, F.col("no"), wrong).alias("fault"))
    record = line.groupBy("path", "ord").agg(*[F.max(F.when(F.col("k") == k, F.substring("line", len(name) + 3, 1 << 30))).alias(name) for k, name in enumerate(KEYS, 1)], F.max("k").alias("last"), F.min("fault").alias("fault"))
    whole_records = record.where(f"fault is null and last = {len(KEYS)}").drop("last", "fault")
    seen = whole_records.groupBy("path", "id").agg(F.min("ord").alias("first"))
    judged = spdx.judged(whole_records.join(seen, ["path", "id"]))
    checked = judged.select("path", "ord", *KEYS, _fault(1, F.col("ord") * LINES + 3, field_error(F.col("valid"), F.col("ord") > F.col("first"))).alias("fault"))
    faults = cut.select("path", early.alias("fault")).unionByName(record.select("path", "fault")).unionByName(checked.select("path", "fault"))
    bad = faults.where("fault is not null").groupBy("path").agg(F.min("fault").alias("fault"))
    good = checked.drop("fault").join(bad.select("path"), "path", "left_anti").withColumn("line", F.lit(None).cast("int")).withColumn("error", F.lit(None).cast("string"))
    return good.unionByName(bad.select("path", F.col("fault.line").alias("line"), F.col("fault.error").alias("error")), allowMissingColumns=True)


def manifest_texts(sources: DataFrame, header: str = "manifest 1") -> DataFrame:
    """(path, value): the manifest of each path of sources(path, ord, ...), its sources in order; a file is one row."""
    record = F.concat(*[x for k in KEYS for x in (F.lit(f"{k}: "), F.col(k).cast("string"), F.lit("\n"))])
    listed = sources.select("path", F.struct("ord", record.alias("r")).alias("s")).groupBy("path").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: F.concat(F.lit("\n"), s["r"])).alias("rs"))
    return listed.select("path", F.concat(F.lit(header + "\n"), F.array_join("rs", "")).alias("value"))


def partition(sources: DataFrame, allow_unlicensed: bool = False) -> DataFrame:
    """``sources`` with ``status`` (accepted or rejected) and ``reason`` (null if accepted) by the default policy."""
    judged = spdx.judged(sources, allow_unlicensed=allow_unlicensed)
    return judged.withColumn("status", F.when(F.col("accepted"), "accepted").otherwise("rejected")).withColumn("reason", F.when(~F.col("accepted"), F.col("reason"))).drop("accepted", "valid")


def report(parted: DataFrame) -> DataFrame:
    """(line): status, id, category, licence and, of a rejected source, the reason, by tabs, for a text sink."""
    return parted.select(F.concat_ws("\t", "status", "id", "category", "license", "reason").alias("line"))


def read_report(lines: DataFrame, column: str = "value") -> DataFrame:
    """(status, id, category, license, reason, ok) of report lines; ``ok`` is false for any other shape."""
    f = F.split(F.col(column), "\t", -1)
    parts = [F.get(f, F.lit(k)).alias(name) for k, name in enumerate(("status", "id", "category", "license", "reason"))]
    return lines.select(*parts, F.coalesce(((F.get(f, F.lit(0)) == "accepted") & (F.size(f) == 4)) | ((F.get(f, F.lit(0)) == "rejected") & (F.size(f) == 5)), F.lit(False)).alias("ok"))
