"""Benchmark, interface and security logs, checks of trees and of documentation: files(path, value) hold one whole text each.

A null text is an empty one. Windows are over the lines of one file, which was one row before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANSI = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"
#: Shapes of the lines, nanoseconds of the units, prefixes of variants, kinds of diagnostics.
TIME = r"^(\S.*?)?\s*time:\s+\[([0-9.]+)\s+(\S+)\s+([0-9.]+)\s+(\S+)\s+([0-9.]+)\s+(\S+)\]\s*$"
THROUGHPUT = r"^\s*thrpt:\s+\[[0-9.]+\s+\S+\s+([0-9.]+)\s+(\S+)\s+[0-9.]+\s+\S+\]\s*$"
OUTLIERS = r"^Found ([0-9]+) outliers among ([0-9]+) measurements"
UNITS = {"ps": 1e-3, "ns": 1.0, "µs": 1e3, "us": 1e3, "μs": 1e3, "ms": 1e6, "s": 1e9}
BASELINE, UNIT, C_BASELINE = "baseline-", "unit-", "baseline-c-"
DIAGNOSTICS = {"took zero time": "(?i)took zero time", "unable to complete samples": r"(?i)Unable to complete [0-9]+ samples", "completed N iterations": "Completed [0-9]+ iterations", "panic": "panicked at", "criterion warning": "(?m)^Warning:"}
#: Lines of interface checks.
OK, FAIL, CLOSING, CARGO = r"^ok:\s+(.*\S)\s*$", r"^FAIL:\s+(.*?)\s+\(line ([0-9]+)\)\s*$", r"(?m)^=== ([0-9]+) check\(s\) failed ===\s*$", r"^\s*test (.+?) \.\.\. (ok|FAILED)\s*$"
ERRORS, LOST = "ERROR SUMMARY: ([0-9]+) errors from [0-9]+ contexts", "definitely lost: ([0-9,]+) bytes in [0-9,]+ blocks"
#: What doesn't belong in a tree of sources.
ARTIFACTS = ".safetensors .gguf .ggml .pt .pth .ckpt .onnx .bin .npz .npy .h5 .hdf5 .pkl .pickle .parquet .arrow .tflite .weights .tar .gz .tgz .zip .7z .rlib .rmeta".split()
SECRET_NAMES = ".env .env.* *.pem *.key *.p12 *.pfx id_rsa* id_ed25519* credentials.json secrets.* .netrc *.enc".split()
ALLOWED_NAMES, BUILD_DIRS, SKIPPED, MAX_BYTES = (".env.example",), ("target", "node_modules", "__pycache__"), (".mdix/", ".github/"), 5 << 20
#: The note that names a file's section, and headings.
NOTE, HEADING, LAST_HEADING = r'live in (docs/[^\s,]+\.md), section "([^"\n]+)', r"^(#{1,6})\s+(.*?)\s*#*\s*$", "fixes and problems"


def _text(column: str = "value") -> Column:
    return F.regexp_replace(F.coalesce(column, F.lit("")), ANSI, "")


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split(_text(), "\r\n|\r|\n")).alias("pos", "line"))


def _part(pattern: str, group: int = 1, column: str = "line") -> Column:
    """The group where the pattern matches, else null."""
    return F.when(F.col(column).rlike(pattern), F.regexp_extract(column, pattern, group))


# -- benchmarks ------------------------------------------------------------------------------------


def to_ns(value: Column, unit: Column) -> Column:
    """A time in nanoseconds; an unknown unit counts as one."""
    factor = F.try_element_at(F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair]), unit)
    return value.try_cast("double") * F.coalesce(factor, F.lit(1.0))


def pretty_ns(ns: Column) -> Column:
    """Nanoseconds as text in the largest unit that fits, with three digits after the point (two for nanoseconds)."""
    text = F.format_string("%.2f ns", ns)
    for size, unit in ((1e3, "µs"), (1e6, "ms"), (1e9, "s")):
        text = F.when(ns >= size, F.format_string(f"%.3f {unit}", ns / size)).otherwise(text)
    return text


def benchmarks(files: DataFrame) -> DataFrame:
    """(path, ord, name, group, variant, low_ns, mid_ns, high_ns, throughput, outliers, samples): the timed lines of each log.

    A time without a name takes the last line before it that has text at its beginning and is no time or
    throughput. Throughput and outliers go to the time above them, the last ones win.
    """
    rows = _lines(files).select(
        "path", "pos", "line", F.col("line").rlike(TIME).alias("timed"), F.col("line").rlike(THROUGHPUT).alias("rate"),
    )
    before = Window.partitionBy("path").orderBy("pos")
    title = F.when(~F.col("timed") & ~F.col("rate") & F.col("line").rlike(r"^\S"), F.trim("line"))
    rows = rows.withColumn("above", F.last(title, True).over(before)).withColumn("ord", F.count_if("timed").over(before))
    numbers = [to_ns(_part(TIME, g), _part(TIME, g + 1)) for g in (2, 4, 6)]
    rows = rows.where("ord > 0").groupBy("path", "ord").agg(
        *[F.min(F.when(F.col("timed"), c)).alias(n) for n, c in (("name", F.coalesce(F.nullif(F.trim(_part(TIME, 1)), F.lit("")), "above", F.lit(""))), ("low_ns", numbers[0]), ("mid_ns", numbers[1]), ("high_ns", numbers[2]))],
        F.max_by(F.concat_ws(" ", _part(THROUGHPUT, 1), _part(THROUGHPUT, 2)), F.when(F.col("rate"), F.col("pos"))).alias("throughput"),
        *[F.coalesce(F.max_by(_part(OUTLIERS, g).cast("int"), F.when(F.col("line").rlike(OUTLIERS), F.col("pos"))), F.lit(0)).alias(n) for g, n in ((1, "outliers"), (2, "samples"))],
    )
    grouped = F.contains("name", F.lit("/"))
    group = F.when(grouped, F.regexp_replace("name", "/[^/]*$", "")).otherwise("(ungrouped)")
    return rows.select("path", (F.col("ord") - 1).alias("ord"), "name", group.alias("group"), F.substring_index("name", "/", -1).alias("variant"), "low_ns", "mid_ns", "high_ns", "throughput", "outliers", "samples")


def benchmark_ratios(results: DataFrame) -> DataFrame:
    """``benchmarks`` with kind (``baseline``, else ``unit``, of the group's first such variant), ratio to that one, and ratio_c to the fastest C variant.

    The row that is compared with, and rows of a group without one or with one of no time, have null ratios.
    """
    group = Window.partitionBy("path", "group")
    one = F.struct("ord", "mid_ns")
    first = lambda prefix: F.min_by(one, F.when(F.startswith("variant", F.lit(prefix)), F.col("ord"))).over(group)
    c = F.min(F.when(F.startswith("variant", F.lit(C_BASELINE)) & (F.col("mid_ns") > 0), F.struct("mid_ns", "ord"))).over(group)
    rows = results.select("*", first(BASELINE).alias("b"), first(UNIT).alias("u"), c.alias("c"))
    rows = rows.withColumn("d", F.coalesce("b", "u")).withColumn("kind", F.when(F.col("b").isNotNull(), "baseline").when(F.col("u").isNotNull(), "unit"))
    ratio = lambda d: F.when((F.col("ord") != F.col(f"{d}.ord")) & (F.col(f"{d}.mid_ns") > 0), F.col("mid_ns") / F.col(f"{d}.mid_ns"))
    return rows.withColumn("ratio", ratio("d")).withColumn("ratio_c", ratio("c")).drop("b", "u", "c", "d")


def badge(ratio: Column) -> Column:
    """A ratio as text with a mark: up to 1.05, 1.5, 5 and above."""
    even = F.concat(F.format_string("✅ %.2fx", ratio), F.when(ratio < 0.95, " (faster)").otherwise(" (parity)"))
    return F.when(ratio <= 1.05, even).when(ratio <= 1.5, F.format_string("⚠️ %.2fx", ratio)).when(ratio <= 5, F.format_string("❌ %.2fx", ratio)).otherwise(F.when(ratio.isNotNull(), F.format_string("🔴 %.1fx slower", ratio)))


def benchmark_diagnostics(files: DataFrame) -> DataFrame:
    """(path, kind, count) of the kinds of trouble that a benchmark log tells of."""
    counts = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_count(_text(), F.lit(p)).alias("count")) for k, p in DIAGNOSTICS.items()])
    return files.select("path", F.inline(F.filter(counts, lambda c: c["count"] > 0)))


# -- interface checks ------------------------------------------------------------------------------


def _check(name, passed: Column, detail=None) -> Column:
    detail = F.when(~passed, detail) if detail is not None else F.lit(None)
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("name"), passed.alias("passed"), F.coalesce(detail, F.lit("")).cast("string").alias("detail"))


def _checks(files: DataFrame, suite: str, checks: Column) -> DataFrame:
    return files.select("path", F.lit(suite).alias("suite"), F.inline(checks))


def program_checks(files: DataFrame) -> DataFrame:
    """(path, suite, name, passed, detail): one check for each ``ok:`` or ``FAIL:`` line, and a failed one if the closing line is missing, counts otherwise, or nothing ran."""
    cut = files.select("path", _text().alias("t")).select("path", "t", F.split("t", "\r\n|\r|\n").alias("lines"))
    hit = lambda x: F.when(x.rlike(OK), _check(F.regexp_extract(x, OK, 1), F.lit(True))).when(x.rlike(FAIL), _check(F.regexp_extract(x, FAIL, 1), F.lit(False), F.concat(F.lit("line "), F.regexp_extract(x, FAIL, 2))))
    cut = cut.withColumn("found", F.filter(F.transform("lines", hit), lambda c: c.isNotNull())).withColumn("closing", F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all("t", F.lit(CLOSING), 1)), -1).cast("long"))
    failed, no = F.size(F.filter("found", lambda c: ~c["passed"])), F.lit(False)
    more = F.when(F.col("closing").isNull(), F.array(_check("program ran to completion", no, F.lit("no closing line: a crash, a link error or a timeout"))))
    more = more.when(F.col("closing") != failed, F.array(_check("the failure count agrees with the FAIL lines", no, F.concat(F.lit("the program said "), F.col("closing").cast("string"), F.lit(", the log has "), failed.cast("string")))))
    more = more.when(F.size("found") == 0, F.array(_check("ran at least one check", no, F.lit("the program printed no checks"))))
    return _checks(cut, "program", F.when(more.isNull(), F.col("found")).otherwise(F.concat("found", more)))


def sanitizer_checks(files: DataFrame) -> DataFrame:
    """(path, suite, name, passed, detail): the three sanitizers, always there; of undefined behaviour up to three lines are told."""
    cut = files.select("path", _text().alias("t"))
    told = F.transform(F.filter(F.split("t", "\r\n|\r|\n"), lambda x: F.contains(x, F.lit("runtime error:"))), lambda x: F.trim(x))
    free = lambda words: ~F.contains("t", F.lit(words))
    return _checks(cut, "sanitizers", F.array(_check("no AddressSanitizer errors", free("ERROR: AddressSanitizer")), _check("no LeakSanitizer reports", free("ERROR: LeakSanitizer")), _check("no UndefinedBehaviorSanitizer reports", F.size(told) == 0, F.array_join(F.slice(told, 1, 3), "; "))))


def memory_checks(files: DataFrame) -> DataFrame:
    """(path, suite, name, passed, detail) of memory checker logs (path, value, status); a log without a summary is one failed check."""
    cut = files.select("path", "status", F.nullif(F.regexp_extract(_text(), ERRORS, 1), F.lit("")).cast("long").alias("errors"), F.coalesce(F.regexp_replace(F.regexp_extract(_text(), LOST, 1), ",", "").try_cast("long"), F.lit(0)).alias("lost"))
    number = lambda c, words: F.concat(F.lit(words[0]), F.col(c).cast("string"), F.lit(words[1]))
    all_of = F.array(_check("valgrind found no errors", F.col("errors") == 0, number("errors", ("", " error(s)"))), _check("nothing definitely lost", F.col("lost") == 0, number("lost", ("", " bytes"))), _check("valgrind exit status is 0", F.coalesce(F.col("status") == 0, F.lit(False)), number("status", ("exit status ", ""))))
    none = F.array(_check("valgrind ran to completion", F.lit(False), F.lit("no ERROR SUMMARY line in the log")))
    return _checks(cut, "memory", F.when(F.col("errors").isNull(), none).otherwise(all_of))


def cargo_checks(files: DataFrame) -> DataFrame:
    """(path, suite, name, passed, detail): one check for each test line; a log without any is one failed check."""
    lines = F.filter(F.split(_text(), "\r\n|\r|\n"), lambda x: x.rlike(CARGO))
    found = F.transform(lines, lambda x: _check(F.regexp_extract(x, CARGO, 1), F.regexp_extract(x, CARGO, 2) == "ok"))
    none = F.array(_check("collected at least one Rust test", F.lit(False), F.lit("cargo missing, a compile error, or a filter that matched nothing")))
    return _checks(files, "cargo", F.when(F.size(found) == 0, none).otherwise(found))


def summarize_checks(checks: DataFrame) -> DataFrame:
    """(suite, total, passed, failed), counted before the shuffle."""
    return checks.groupBy("suite").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


# -- security reports ------------------------------------------------------------------------------

_PACKAGE, _ADVISORY = "package: struct<name: string, version: string>", "advisory: struct<id: string, title: string>"
_AUDIT = f"vulnerabilities struct<list: array<struct<{_ADVISORY}, {_PACKAGE}, versions: struct<patched: array<string>>>>>, warnings map<string, array<struct<{_ADVISORY}, {_PACKAGE}>>>"
_LEAKS = "array<struct<RuleID: string, File: string, StartLine: bigint, Commit: string, Date: string>>"


def advisories(files: DataFrame) -> DataFrame:
    """(path, kind, id, package, version, title, patched) of audits in JSON: vulnerabilities, and the warnings of each kind. No JSON: no rows."""
    read = files.select("path", F.from_json("value", _AUDIT).alias("j"))
    row = lambda kind, x, patched: F.struct(kind.alias("kind"), x["advisory"]["id"].alias("id"), x["package"]["name"].alias("package"), x["package"]["version"].alias("version"), x["advisory"]["title"].alias("title"), patched.alias("patched"))
    known = F.transform(F.coalesce("j.vulnerabilities.list", F.array()), lambda x: row(F.lit("vulnerability"), x, F.coalesce(F.nullif(F.array_join(x["versions"]["patched"], ", "), F.lit("")), F.lit("none"))))
    warned = F.flatten(F.transform(F.map_entries(F.coalesce("j.warnings", F.create_map())), lambda e: F.transform(F.coalesce(e["value"], F.array()), lambda x: row(e["key"], x, F.lit(None).cast("string")))))
    return read.select("path", F.inline(F.concat(known, warned)))


def leaks(files: DataFrame) -> DataFrame:
    """(path, rule, file, line, commit, date) of secret scans in JSON; commits by their first eight digits. No JSON: no rows."""
    rows = files.select("path", F.inline(F.from_json("value", _LEAKS)))
    return rows.select("path", F.col("RuleID").alias("rule"), F.col("File").alias("file"), F.col("StartLine").alias("line"), F.substring("Commit", 1, 8).alias("commit"), F.substring("Date", 1, 10).alias("date"))


# -- trees and documentation -----------------------------------------------------------------------


def _glob(pattern: str) -> str:
    return "".join(".*" if c == "*" else "[" + c + "]" if c == "." else c for c in pattern)


def hygiene(files: DataFrame) -> DataFrame:
    """(check, path, detail) of what a tree of files (path, size) shouldn't hold; files below a build folder are counted by that folder and not looked at further."""
    files = files.where(~F.exists(F.array(*map(F.lit, SKIPPED)), lambda p: F.startswith("path", p)))
    below = F.regexp_extract("path", "^(.*?(?:^|/)(?:" + "|".join(BUILD_DIRS) + ")/)", 1)
    base = F.substring_index("path", "/", -1)
    # a name's last point, but for those it begins with, starts its suffix
    files = files.select("path", "size", below.alias("top"), base.alias("base"), F.lower(F.regexp_extract(base, r"^\.*[^.].*?(\.[^.]*)$", 1)).alias("ext"))
    secret = F.col("base").rlike("(?s)^(" + "|".join(map(_glob, SECRET_NAMES)) + ")$") & ~F.col("base").isin(*ALLOWED_NAMES)
    found = lambda check, wanted, detail: F.when(wanted, F.struct(F.lit(check).alias("check"), "path", detail.alias("detail")))
    all_of = F.array(
        found("weights, data or archive", F.col("ext").isin(*ARTIFACTS), F.concat(F.lit("extension "), "ext")),
        found("secret-looking name", secret, F.lit("matches a credential filename")),
        found("large file", F.col("size") > MAX_BYTES, F.format_string(f"%.1f MiB (limit {MAX_BYTES >> 20} MiB)", F.col("size") / 1048576)),
    )
    single = files.where("top = ''").select(F.inline(F.filter(all_of, lambda x: x.isNotNull())))
    built = files.where("top <> ''").groupBy("top").agg(F.count("*").cast("string").alias("n"))
    return single.unionByName(built.select(F.lit("build artifact").alias("check"), F.col("top").alias("path"), F.concat("n", F.lit(" tracked file(s) inside a build directory")).alias("detail")))


def unsafe_inventory(files: DataFrame) -> DataFrame:
    """(path, unsafe_uses, opts_out) of Rust files (path, value) that say ``unsafe`` outside comment lines, by lines, or allow it."""
    code = F.filter(F.transform(F.split(F.coalesce("value", F.lit("")), "\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+", "")), lambda x: ~F.startswith(x, F.lit("//")))
    allows = lambda x: F.contains(x, F.lit("allow(unsafe_code)"))
    rows = files.where(F.endswith("path", F.lit(".rs")) & ~F.exists(F.array(*map(F.lit, SKIPPED)), lambda p: F.startswith("path", p))).select("path", code.alias("code"))
    return rows.select("path", F.size(F.filter("code", lambda x: ~allows(x) & x.rlike(r"\bunsafe\b"))).alias("unsafe_uses"), F.exists("code", allows).alias("opts_out")).where("unsafe_uses > 0 or opts_out")


def _normal(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, "[`*_]", "")))


def headings(docs: DataFrame) -> DataFrame:
    """(path, pos, level, title) of the headings outside fenced blocks."""
    rows = _lines(docs).withColumn("fence", F.ltrim("line").startswith("```"))
    rows = rows.withColumn("open", F.count_if("fence").over(Window.partitionBy("path").orderBy("pos")) % 2 == 1)
    rows = rows.where(~F.col("fence") & ~F.col("open") & F.col("line").rlike(HEADING))
    return rows.select("path", "pos", F.length(F.regexp_extract("line", HEADING, 1)).alias("level"), F.regexp_extract("line", HEADING, 2).alias("title"))


def docs_conformance(sources: DataFrame, docs: DataFrame) -> DataFrame:
    """(path, ref, section, problem) of source files whose first six lines note a section of a document.

    A section stands if a heading is equal to it, apart from case and marks, or begins with its first word
    up to a colon. Sources without the note have the problem ``no note``. Joins are by equal keys only.
    """
    head = F.array_join(F.slice(F.split(F.coalesce("value", F.lit("")), "\n"), 1, 6), "\n")
    noted = sources.select("path", F.nullif(F.regexp_extract(head, NOTE, 1), F.lit("")).alias("ref"), F.nullif(F.regexp_extract(head, NOTE, 2), F.lit("")).alias("section"))
    want, word = _normal(F.col("section")), F.split(_normal(F.col("section")), r"[:\s]")[0]
    keys = F.array_compact(F.array(F.concat(F.lit("whole "), want), F.when(word != "", F.concat(F.lit("word "), word))))
    title = _normal(F.col("title"))
    have = headings(docs).select(F.col("path").alias("ref"), F.explode(F.array(F.concat(F.lit("whole "), title), F.concat(F.lit("word "), F.split(title, ":")[0]))).alias("key")).distinct()
    asked = noted.where("ref is not null").select("ref", "section", F.explode(keys).alias("key")).distinct()
    resolved = asked.join(have, ["ref", "key"]).select("ref", "section").distinct().withColumn("stands", F.lit(True))
    known = docs.select(F.col("path").alias("ref")).distinct().withColumn("there", F.lit(True))
    rows = noted.join(known, "ref", "left").join(resolved, ["ref", "section"], "left")
    problem = F.when(F.col("ref").isNull(), "no note").when(F.col("there").isNull(), "no such document").when(F.col("stands").isNull(), "no such heading")
    return rows.select("path", "ref", "section", problem.alias("problem"))


def last_headings(docs: DataFrame) -> DataFrame:
    """(path, last, ok): the last heading of the second level, null if there is none, and whether it is the one that must be."""
    last = headings(docs).where("level = 2").groupBy("path").agg(F.max_by("title", "pos").alias("last"))
    return docs.select("path").join(last, "path", "left").withColumn("ok", F.coalesce(_normal(F.col("last")) == LAST_HEADING, F.lit(False)))
