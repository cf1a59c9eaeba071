"""Readers of benchmark, interface and security logs, of trees, documentation and settings, each on texts with planted faults."""

from pyspark.sql import functions as F

from corploom.functions import spdx
from corploom.sources import buildlogs as B
from corploom.sources import reports, settings

BENCH = """   Compiling x
Warning: slow
sum/unit-8
                        time:   [1.0 us 2.0 us 3.0 us]
                        thrpt:  [1.0  elem/s 2.5  Melem/s 3.0  elem/s]
Found 4 outliers among 100 measurements (4.00%)
sum/baseline-c-8        time:   [1 ns 500 ns 700 ns]
\x1b[32msum/fast\x1b[0m   time:   [0.1 ms 0.2 ms 0.3 ms]
sum/baseline-c-9        time:   [1 ns 250 ns 700 ns]
alone
  time:   [1 s 2 s 3 s]
a took zero time, Took Zero Time
"""


def _files(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, value string")


def test_benchmarks(spark):
    files = _files(spark, BENCH, "", None, "  time:   [1 s 2 s 3 s]")
    rows = B.benchmark_ratios(B.benchmarks(files)).withColumn("badge", B.badge(F.col("ratio"))).withColumn("text", B.pretty_ns(F.col("mid_ns"))).orderBy("path", "ord").collect()
    assert [(r["name"], r["group"], r["variant"], r["mid_ns"]) for r in rows] == [
        ("sum/unit-8", "sum", "unit-8", 2000.0), ("sum/baseline-c-8", "sum", "baseline-c-8", 500.0), ("sum/fast", "sum", "fast", 200000.0), ("sum/baseline-c-9", "sum", "baseline-c-9", 250.0), ("alone", "(ungrouped)", "alone", 2e9), ("", "(ungrouped)", "", 2e9)]
    assert [(r["throughput"], r["outliers"], r["samples"]) for r in rows][:2] == [("2.5 Melem/s", 4, 100), (None, 0, 0)]
    assert [r["kind"] for r in rows] == ["baseline"] * 4 + [None] * 2 and [r["ratio"] for r in rows] == [4.0, None, 400.0, 0.5, None, None] and [r["ratio_c"] for r in rows] == [8.0, 2.0, 800.0, None, None, None]
    assert [r["badge"] for r in rows][:4] == ["❌ 4.00x", None, "🔴 400.0x slower", "✅ 0.50x (faster)"] and [r["text"] for r in rows][:3] == ["2.000 µs", "500.00 ns", "200.000 µs"]
    assert {(r["path"], r["kind"], r["count"]) for r in B.benchmark_diagnostics(files).collect()} == {("0", "took zero time", 2), ("0", "criterion warning", 1)}


def test_interface_checks(spark):
    files = _files(spark, "ok: a b \nFAIL: c (line 7)\n=== 1 check(s) failed ===\n", "ok: a\n", "ok: a\n=== 2 check(s) failed ===", "=== 0 check(s) failed ===", None)
    found = [(r["path"], r["name"], r["passed"], r["detail"]) for r in B.program_checks(files).collect()]
    assert [f for f in found if f[0] == "0"] == [("0", "a b", True, ""), ("0", "c", False, "line 7")] and [f[1] for f in found if f[0] == "1"] == ["a", "program ran to completion"]
    assert [f[3] for f in found if f[0] == "2"][1] == "the program said 2, the log has 0" and [f[1] for f in found if f[0] in "34"] == ["ran at least one check", "program ran to completion"]
    bad = B.sanitizer_checks(_files(spark, " 0x.c: runtime error: 10 \n==1==ERROR: LeakSanitizer: x", "")).collect()
    assert [r["passed"] for r in bad] == [True, False, False, True, True, True] and bad[2]["detail"] == "0x.c: runtime error: 10"
    logs = [("0", "ERROR SUMMARY: 2 errors from 1 contexts\ndefinitely lost: 1,024 bytes in 3 blocks", 1), ("1", "", 0), ("2", "ERROR SUMMARY: 0 errors from 0 contexts", 0), ("3", "ERROR SUMMARY: 0 errors from 0 contexts", None)]
    memory = B.memory_checks(spark.createDataFrame(logs, "path string, value string, status int"))
    assert [(r["passed"], r["detail"]) for r in memory.collect()][:4] == [(False, "2 error(s)"), (False, "1024 bytes"), (False, "exit status 1"), (False, "no ERROR SUMMARY line in the log")]
    assert [r["passed"] for r in memory.collect()][4:] == [True, True, True, True, True, False]
    cargo = B.cargo_checks(_files(spark, "test a::b (line 3) ... ok\n  test c ... FAILED\ntest d ... ignored", "x"))
    assert [(r["name"], r["passed"]) for r in cargo.collect()] == [("a::b (line 3)", True), ("c", False), ("collected at least one Rust test", False)]
    assert [tuple(r) for r in B.summarize_checks(cargo).collect()] == [("cargo", 3, 1, 2)]


def test_security_reports(spark):
    audit = '{"vulnerabilities":{"count":1,"list":[{"advisory":{"id":"A","title":"t"},"package":{"name":"p","version":"1"},"versions":{"patched":[">=2",">=3"]}}]},"warnings":{"yanked":[{"package":{"name":"q","version":"2"},"advisory":null}],"unsound":null}}'
    rows = B.advisories(_files(spark, audit, "no json", None, "{}")).collect()
    assert [tuple(r)[1:] for r in rows] == [("vulnerability", "A", "p", "1", "t", ">=2, >=3"), ("yanked", None, "q", "2", None, None)]
    leak = '[{"RuleID":"r","File":"f","StartLine":3,"Commit":"0123456789ab","Date":"2024-01-02T03:04:05Z"}]'
    assert [tuple(r) for r in B.leaks(_files(spark, leak, "[]", None, "x")).where("rule is not null").collect()] == [("0", "r", "f", 3, "01234567", "2024-01-02")]


def test_trees(spark):
    files = [("a/x.PT", 1), ("a/.env", 1), (".env.example", 1), (".env.local", 1), ("target/x.pt", 9), ("c/target/d/e.rs", 1), ("c/target/f", 1), (".github/x.zip", 1), ("big.txt", 6 << 20), ("target", 1), ("id_rsa.pub", 1), (".gz", 1), ("xenv", None)]
    found = {(r["check"], r["path"], r["detail"]) for r in B.hygiene(spark.createDataFrame(files, "path string, size long")).collect()}
    assert found == {("weights, data or archive", "a/x.PT", "extension .pt"), *[("secret-looking name", p, "matches a credential filename") for p in ("a/.env", ".env.local", "id_rsa.pub")], ("large file", "big.txt", "6.0 MiB (limit 5 MiB)"),
                     ("build artifact", "target/", "1 tracked file(s) inside a build directory"), ("build artifact", "c/target/", "2 tracked file(s) inside a build directory")}
    code = spark.createDataFrame([("a.rs", " // unsafe\n unsafe { unsafe }\nunsafely\n#![allow(unsafe_code)] unsafe"), ("b.rs", "x"), ("c.py", "unsafe"), ("d.rs", None)], "path string, value string")
    assert [tuple(r) for r in B.unsafe_inventory(code).collect()] == [("a.rs", 1, True)]


def test_documentation(spark):
    docs = spark.createDataFrame([("docs/a.md", "# Top\n## F1: the `Reader`\n```\n## Inner\n```\n## Fixes and Problems ##\n"), ("docs/b.md", None), ("docs/c.md", "## Fixes and problems\n## Last")], "path string, value string")
    assert [(r["level"], r["title"]) for r in B.headings(docs).where("path = 'docs/a.md'").orderBy("pos").collect()] == [(1, "Top"), (2, "F1: the `Reader`"), (2, "Fixes and Problems")]
    note = '// N\n// live in docs/{}.md, section "{}".\n'
    cases = {"exact": ("a", "f1: the reader"), "word": ("a", "F1 of another name"), "none": ("a", "F2"), "fenced": ("a", "Inner"), "file": ("z", "Top"), "empty": ("b", "Top")}
    sources = spark.createDataFrame([*[(k, note.format(*v)) for k, v in cases.items()], ("bare", None), ("late", "\n" * 6 + note.format("a", "Top"))], "path string, value string")
    problems = {r["path"]: r["problem"] for r in B.docs_conformance(sources, docs).collect()}
    assert problems == {"exact": None, "word": None, "none": "no such heading", "fenced": "no such heading", "file": "no such document", "empty": "no such heading", "bare": "no note", "late": "no note"}
    assert {r["path"]: (r["last"], r["ok"]) for r in B.last_headings(docs).collect()} == {"docs/a.md": ("Fixes and Problems", True), "docs/b.md": (None, False), "docs/c.md": ("Last", False)}


GOOD = "schema_version = 1\nvocab_size = 32_000 # words\nd_model = 384\nn_layers = 8\nn_heads = 6\nn_kv_heads = 2\nd_ff = 1024\nmax_seq_len = 512\nrope_theta = 1e4\nnorm_eps = 0.00001\ntie_embeddings = false\n"


def test_model_settings(spark):
    cases = {
        GOOD: None, "": "no `schema_version`", None: "no `schema_version`", GOOD + "x": "line 12: expected `key = value`", GOOD.replace("= 1\n", "= 2\n", 1): "version 2 is not 1", GOOD.replace("= 1\n", "= one\n", 1): "`schema_version` must be a non-negative integer",
        GOOD + "d_ff = 3": "line 12: duplicate key `d_ff`", GOOD + "other = 3": "line 12: unknown key `other`", GOOD.replace("= 384", "= -3"): "line 3: `d_model` must be a non-negative integer, got `-3`", GOOD.replace("1e4", "x"): "line 9: `rope_theta` must be a number, got `x`",
        GOOD.replace("false", "no"): "line 11: `tie_embeddings` must be true or false, got `no`", GOOD.replace("d_ff = 1024\n", "").replace("n_layers = 8\n", ""): "missing n_layers, d_ff", GOOD.replace("d_ff = 1024", "d_ff = 0"): "`d_ff` must be positive", GOOD.replace("1e4", "1e99"): "`rope_theta` must be positive",
        GOOD.replace("n_heads = 6", "n_heads = 5", 1): "d_model is not divisible by n_heads", GOOD.replace("n_kv_heads = 2", "n_kv_heads = 4"): "n_heads is not divisible by n_kv_heads", GOOD.replace("d_model = 384", "d_model = 378"): "the head's width must be even",
    }
    files = _files(spark, *cases)
    rows = settings.read_model_settings(files).collect()
    assert {r["path"]: r["error"] for r in rows} == {str(i): e for i, e in enumerate(cases.values())}
    good = settings.read_model_settings(files.where("path = '0'"))
    assert tuple(good.first())[1:9] == (32000, 384, 8, 6, 2, 1024, 512, 10000.0) and all(v is None for r in rows if r["error"] for v in tuple(r)[1:-1])
    again = settings.read_model_settings(settings.model_settings_text(good))
    assert again.first() == good.first()
    assert [int(x) for x in tuple(settings.parameters(good).first())[1:]] == [12288000, 8 * (2 * 384 * 384 + 2 * 384 * 128), 8 * 3 * 384 * 1024, 17 * 384, 12288000, 12288000 * 2 + 8 * (2 * 384 * 384 + 2 * 384 * 128 + 3 * 384 * 1024) + 17 * 384]


def test_declared_licences(spark):
    texts = ['[package]\nlicense = "MIT/Apache-2.0"', '[package]\nlicense.workspace = true\n[workspace.package]\nlicense = " ISC "', '[package]\nlicense-file = "L"', "<html>", None, "workspace = 3", '[package]\nlicense = 3\n[workspace.package]\nlicense="X"']
    assert {r["path"]: r["license"] for r in settings.package_licenses(_files(spark, *texts)).collect()} == {"0": "MIT OR Apache-2.0", "1": "ISC", "2": None, "3": None, "4": None, "5": None, "6": "X"}


def test_shape_of_expressions(spark):
    good = ["MIT", " MIT ", "MIT AND ISC", "(MIT)", "(MIT)AND(ISC)", "((A OR B) AND C WITH d) OR E+", "A WITH b AND C", "ANDY", "x:y_z"]
    bad = ["", " ", "MIT ISC", "AND", "MIT AND", "OR MIT", "(MIT", "MIT)", ")MIT(", "()", "A WITH", "A WITH b WITH c", "(A) WITH b", "A WITH (b)", "MIT/X", "A (B)", "A AND OR B", None]
    rows = spark.createDataFrame([(t,) for t in good + bad], "t string").select("t", spdx.shaped(F.col("t")).alias("ok")).collect()
    assert {r["t"]: r["ok"] for r in rows} == {**dict.fromkeys(good, True), **dict.fromkeys(bad, False)}


def test_packages_of_one_repository(spark):
    rows = [(2, "b", "http://github.com/o/R", "MIT", 5), (1, "a", "https://github.com/O/r.git", "ISC OR MIT", None), (3, "c", "https://gitlab.com/o/r", "X", 9), (4, "d", " github.com/p/q ", "A OR B", 1), (5, "e", "github.com/s/t", None, 2), (6, "f", None, "MIT", 2), (7, "g", "github.com/O/R#x", "MIT", 1)]
    found = reports.candidates_by_repository(spark.createDataFrame(rows, "ord int, name string, repository string, license string, downloads long")).orderBy("key").collect()
    assert [tuple(r) for r in found] == [("o/r", "O/r", ["a", "b", "g"], 6, "(ISC OR MIT) AND MIT"), ("p/q", "p/q", ["d"], 1, "A OR B"), ("s/t", "s/t", ["e"], 2, "NOASSERTION")]


def test_old_licence_texts(spark):
    cases = {"MIT/X": "MIT OR X", " MIT / 2X ": "MIT OR 2X", "A//B/": "A OR B", "(A/B)": "(A/B)", "A OR B/C": "A OR B/C", "ORB/C": "ORB OR C", "MIT  X": "MIT X", "": None, None: None}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", reports.normalized_license(F.col("t")).alias("l")).collect()
    assert {r["t"]: r["l"] for r in rows} == cases
