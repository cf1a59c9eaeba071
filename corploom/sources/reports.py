"""Answers of package indexes and build logs as rows: files(path, value) hold one whole answer or log each, lines(value) one line each.

A null or broken JSON text gives no rows; ``candidates`` tells so in its own column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: addresses of repositories on the known host; owner and name.
REPOSITORY = "^(?:https?://|git://|git[+]https://)?(?:www[.])?github[.]com[/:]([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:[.]git)?(?:[/#?].*)?$"
_PAGE = "crates array<struct<name:string,repository:string,downloads:bigint,max_stable_version:string,newest_version:string>>"
_VERSION = "version struct<license:string,yanked:boolean>"
_SEARCH = "items array<struct<full_name:string,fork:boolean,license:struct<spdx_id:string>,stars:bigint>>"
_CANDIDATES = "schema string, candidates array<struct<id:string,crates:array<string>,downloads:bigint>>"


def normalized_license(text: Column) -> Column:
    """White space as single spaces; the old slash between names is OR, unless the text is an expression already. No text is null."""
    one = F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))
    names = F.filter(F.transform(F.split(one, "/"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(~F.contains(one, F.lit("/")) | one.rlike(r"[(]|\b(AND|OR|WITH)\b"), one).otherwise(F.array_join(names, " OR "))


def crates_pages(files: DataFrame) -> DataFrame:
    """(path, name, repository, downloads, version) of the named entries of index pages; a stable version goes before the newest."""
    rows = files.select("path", F.inline(F.from_json("value", _PAGE)["crates"])).where("name is not null")
    return rows.select("path", "name", "repository", F.coalesce("downloads", F.lit(0)).alias("downloads"), F.coalesce("max_stable_version", "newest_version").alias("version"))


def candidates_by_repository(crates: DataFrame) -> DataFrame:
    """(key, id, crates, downloads, license) of (ord, name, repository, license, downloads): packages of one repository as one candidate.

    Repositories are told apart whatever their case, by the spelling of the first; others than of the known host go. Names are
    in the order of ord. Different licences are joined by AND in the order they come, those of many parts in brackets; none: NOASSERTION.
    """
    home = F.trim("repository")
    rows = crates.select("ord", "name", "license", F.coalesce("downloads", F.lit(0)).alias("downloads"), F.regexp_extract(home, REPOSITORY, 1).alias("owner"), F.regexp_extract(home, REPOSITORY, 2).alias("repo"))
    rows = rows.where("owner <> '' and repo <> ''").withColumn("id", F.concat_ws("/", "owner", "repo")).withColumn("key", F.lower("id"))
    found = rows.where("license <> ''").groupBy("key", "license").agg(F.min("ord").alias("ord")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", "license"))).alias("ls"))
    wrapped = F.transform("ls", lambda x: F.when(x["license"].rlike(" (OR|AND) "), F.concat(F.lit("("), x["license"], F.lit(")"))).otherwise(x["license"]))
    merged = F.when(F.size("ls") == 1, F.col("ls")[0]["license"]).otherwise(F.array_join(wrapped, " AND "))
    groups = rows.groupBy("key").agg(F.min_by("id", "ord").alias("id"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("crates"), F.sum("downloads").alias("downloads"))
    return groups.join(found, "key", "left").select("key", "id", "crates", "downloads", F.coalesce(F.when(F.col("ls").isNotNull(), merged), F.lit("NOASSERTION")).alias("license"))


def crate_versions(files: DataFrame) -> DataFrame:
    """(path, license, yanked) of single versions."""
    rows = files.select("path", F.from_json("value", _VERSION)["version"].alias("v")).where("v is not null")
    return rows.select("path", normalized_license(F.col("v.license")).alias("license"), F.col("v.yanked").alias("yanked"))


def repository_searches(files: DataFrame) -> DataFrame:
    """(path, id, license, stars) of repositories that are no forks and whose name is plain; NONE: no licence, NOASSERTION: one without a name."""
    rows = files.select("path", F.inline(F.from_json("value", _SEARCH)["items"])).where(~F.coalesce("fork", F.lit(False)) & F.col("full_name").rlike("^[A-Za-z0-9._/-]+$"))
    return rows.select("path", F.col("full_name").alias("id"), F.when(F.col("license").isNull(), "NONE").otherwise(F.coalesce("license.spdx_id", F.lit("NOASSERTION"))).alias("license"), "stars")


def remote_heads(files: DataFrame) -> DataFrame:
    """(path, revision) of reference listings: the commit of the line that ends in HEAD; null if there is none."""
    return files.select("path", F.nullif(F.regexp_extract("value", r"(?m)^([0-9a-f]{40})\s+HEAD$", 1), F.lit("")).alias("revision"))


def candidates(files: DataFrame, schema: str = "candidates/1") -> DataFrame:
    """(path, id, crates, downloads, error) of lists of candidates; another schema or no JSON gives one row with the error."""
    read = files.select("path", F.from_json("value", _CANDIDATES).alias("j"))
    wrong = ~F.coalesce(F.col("j.schema") == schema, F.lit(False))
    none = F.array(F.struct(F.lit(None).cast("string").alias("id"), F.lit(None).cast("array<string>").alias("crates"), F.lit(None).cast("bigint").alias("downloads")))
    return read.select("path", wrong.alias("wrong"), F.inline(F.when(wrong, none).otherwise(F.col("j.candidates")))).select("path", "id", "crates", "downloads", F.when(F.col("wrong"), f"not {schema}").alias("error"))


def test_counts(lines: DataFrame, column: str = "value") -> DataFrame:
    """(suite, passed, failed, ignored) of ``test suite::name ... result`` lines, counted before the shuffle."""
    found = lines.select(F.regexp_extract(column, r"^test ([A-Za-z0-9_]+)::.* \.\.\. (ok|FAILED|ignored)", 1).alias("suite"), F.regexp_extract(column, r" \.\.\. (ok|FAILED|ignored)", 1).alias("result")).where("suite <> ''")
    return found.groupBy("suite").agg(*[F.count_if(F.col("result") == r).alias(name) for r, name in (("ok", "passed"), ("FAILED", "failed"), ("ignored", "ignored"))])


def format_hunks(lines: DataFrame, column: str = "value") -> DataFrame:
    """(path, hunks, first_line) of ``Diff in path at line n`` or ``Diff in path:n:`` lines."""
    pattern = r"^Diff in (.+?)(?: at line |:)([0-9]+):?$"
    found = lines.select(F.regexp_extract(column, pattern, 1).alias("path"), F.regexp_extract(column, pattern, 2).alias("no")).where("path <> ''")
    return found.groupBy("path").agg(F.count("*").alias("hunks"), F.min(F.col("no").cast("long")).alias("first_line"))


def diagnostics(files: DataFrame) -> DataFrame:
    """(path, line_no, level, code, message, file, at) of compiler logs: a ``warning`` or ``error`` line and the place on the first arrow line before the next one."""
    rows = files.select("path", F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    head = r"^(warning|error)(?:\[([A-Za-z0-9_]+)\])?: (.*)$"
    rows = rows.select("path", "pos", F.regexp_extract("line", head, 1).alias("level"), F.regexp_extract("line", head, 2).alias("code"), F.regexp_extract("line", head, 3).alias("message"), F.regexp_extract("line", r"^\s*--> (.+?):([0-9]+):[0-9]+$", 1).alias("file"), F.regexp_extract("line", r"^\s*--> (.+?):([0-9]+):[0-9]+$", 2).alias("at"))
    rows = rows.where("level <> '' or file <> ''")
    # an arrow belongs to a head if it comes right after it among heads and arrows
    after = Window.partitionBy("path").orderBy("pos")
    rows = rows.withColumn("next_file", F.lead("file").over(after)).withColumn("next_at", F.lead("at").over(after)).where("level <> ''")
    return rows.select("path", (F.col("pos") + 1).alias("line_no"), "level", F.nullif("code", F.lit("")).alias("code"), "message", F.nullif("next_file", F.lit("")).alias("file"), F.expr("try_cast(nullif(next_at, '') as int)").alias("at"))


def sections(files: DataFrame) -> DataFrame:
    """(path, section, metric, value) of ``metric n`` lines below ``=== section ===`` lines; other lines and those before any section are left out."""
    rows = files.select("path", F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    title = F.nullif(F.regexp_extract("line", "^=== (.+) ===$", 1), F.lit(""))
    rows = rows.withColumn("section", F.last(title, True).over(Window.partitionBy("path").orderBy("pos")))
    return rows.where(F.col("section").isNotNull() & F.col("line").rlike("^[A-Za-z_]+ [0-9]+$")).select("path", "section", F.split("line", " ")[0].alias("metric"), F.split("line", " ")[1].cast("long").alias("value"))
