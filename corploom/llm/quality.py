"""Operator 1, quality rules: line-first cleaning with DataFrame functions only.

Every line of a text is held against punctuation, navigation, symbol, shouting, repetition and
boilerplate rules; lines that fail one are removed; a document that loses too large a share of its
characters that way is rejected. All of it is a projection: no shuffle, and a hot source or a large
group of copies costs no more than as many other rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK

#: Characters that may end a line of prose (before blanks).
TERMINAL = ".!?…:;。！？\"'”’»)]"
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: What stands between the entries of menus and breadcrumbs.
SEPARATORS = (" |", "»", "›", "•", " > ")
#: Phrases of page furniture, lower case.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "enable javascript",
    "subscribe to our",
    "sign up for",
    "log in to",
    "click here",
    "read more",
    "share this",
    "lorem ipsum",
    "skip to content",
    "powered by",
)


@dataclass(frozen=True)
class QualityRules:
    """Thresholds of the line rules and of the document's verdict."""

    min_words: int = 20
    max_repeat_percent: int = 30
    max_separators: int = 2
    max_symbol_percent: int = 10
    max_upper_percent: int = 40
    min_upper_letters: int = 10
    min_distinct_percent: int = 30
    min_repetition_words: int = 10
    max_lost_percent: int = 30


RULES = QualityRules()


def words_in(text: Column) -> Column:
    # one literal separator is what split() does without a regular expression
    return F.array_remove(F.split(F.regexp_replace(text, r"[\x09-\x0D]", " "), " "), "")


def only(text: Column, characters: str) -> Column:
    """How many of a text's characters are in a class; what lies between goes in one piece."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", ""))


def any_in(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.contains(text, F.lit(parts[0]))
    for part in parts[1:]:
        found = found | F.contains(text, F.lit(part))
    return found


def line_fails(line: Column, phrases: Column, separators: Column, rules: QualityRules = RULES) -> Column:
    """Whether a line that isn't blank breaks a rule; ``phrases`` and ``separators``: whether its text has any at all."""
    between = F.lit(0)
    for part in SEPARATORS:
        between = between + (F.length(line) - F.length(F.replace(line, F.lit(part), F.lit("")))) / F.lit(len(part))
    return (
        ~F.substring(F.rtrim(line, F.lit(" \t\x0b\f\r")), -1, 1).isin(*TERMINAL)
        | (separators & (between > rules.max_separators))
        | (only(line, SYMBOLS) * 100 > F.length(line) * rules.max_symbol_percent)
        | ((only(line, r"\p{Lu}") >= rules.min_upper_letters) & (only(line, r"\p{Lu}") * 100 > F.length(line) * rules.max_upper_percent))
        | (phrases & any_in(F.lower(line), BOILERPLATE))
    )


def line_repeats(words: Column, rules: QualityRules = RULES) -> Column:
    """Whether a line's words are mostly the same few."""
    return (F.size(words) >= rules.min_repetition_words) & (F.size(F.array_distinct(words)) * 100 < F.size(words) * rules.min_distinct_percent)


def _repeat_words(windows: Column, width: int) -> Column:
    """Words covered by windows whose hash occurs twice or more; ``windows`` has a hash for each start."""
    ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        same = lambda k, j: F.coalesce(F.get(s, k)["h"] == F.get(s, j)["h"], F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
        return F.sort_array(F.transform(twice, lambda k: F.get(s, k)["i"]))

    def covered(p: Column) -> Column:
        step = lambda k: F.coalesce(F.least(F.lit(width), F.get(p, k + 1) - F.get(p, k)), F.lit(width))
        return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda total, k: total + F.when(k + 1 < F.size(p), step(k)).otherwise(width))

    # an array of one element binds the value, so that it isn't computed again for each element of the lambdas
    return F.get(F.transform(F.transform(F.array(ranked), starts), covered), F.lit(0))


def line_first_cleaning(docs: DataFrame, rules: QualityRules = RULES, width: int = 8, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: the base counts, the lines' verdicts, and the text without failing lines.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed,
    n_lines, n_lines_removed, lost_chars (long), kept (boolean), clean_text.

    A null text has no words: its counts are zero and it is not kept, like an empty one. Ties and
    repeated rows are judged row by row. A null doc_id stays null. Other columns are read only if
    ``keep`` names them; they come back as the fields of ``rest``.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), rest.alias("rest"))
    d = d.withColumn("words", words_in(F.col("text"))).withColumn("lines", F.split("text", "\n"))
    d = d.withColumn("n", F.size("words")).withColumn("ids", F.transform("words", lambda w: F.xxhash64(w)))
    window = lambda i: F.xxhash64(*[F.get(F.col("ids"), i + j) for j in range(width)])
    d = d.withColumn("windows", F.when(F.col("n") >= width, F.transform(F.sequence(F.lit(0), F.col("n") - width), window)))
    repeats = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), _repeat_words(F.col("windows"), width)).otherwise(0)
    d = d.select(
        "doc_id",
        "rest",
        "text",
        "lines",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.coalesce(repeats, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.filter("lines", lambda x: x.rlike(f"[^{BLANK[1:]}")).alias("inked"),
        any_in(F.lower("text"), BOILERPLATE).alias("phrases"),
        any_in(F.col("text"), SEPARATORS).alias("separators"),
    )
    fails = lambda x: line_fails(x, F.col("phrases"), F.col("separators"), rules) | ((F.col("n_repeat_words") > 0) & line_repeats(words_in(x), rules))
    d = d.withColumn("judged", F.transform("lines", lambda x: F.struct(x.alias("line"), (x.rlike(f"[^{BLANK[1:]}") & fails(x)).alias("fails"))))
    d = d.withColumn("bad", F.filter("judged", lambda x: x["fails"]))
    d = d.select(
        "doc_id",
        "rest",
        "n_words",
        "word_chars",
        only(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("inked") - F.size(F.array_distinct("inked"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("inked").cast("long").alias("n_lines"),
        F.size("bad").cast("long").alias("n_lines_removed"),
        F.aggregate("bad", F.lit(0).cast("long"), lambda total, x: total + F.length(F.regexp_replace(x["line"], BLANK, ""))).alias("lost_chars"),
        F.when(F.size("bad") == 0, F.col("text")).otherwise(F.array_join(F.transform(F.filter("judged", lambda x: ~x["fails"]), lambda x: x["line"]), "\n")).alias("clean_text"),
    )
    failed = (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent)
    d = d.withColumn("base_failed", failed)
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * rules.max_lost_percent))
    # a caller's filter must not be pushed below: it would repeat these expressions, those of the lambdas for each element
    return d.select(F.explode_outer(F.array(F.struct(*d.columns))).alias("row")).select("row.*")


def op1_quality_rules(documents: DataFrame) -> DataFrame:
    """The contract's columns, and the line counts; the cleaned text stays with the operator."""
    return line_first_cleaning(documents).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_removed", "lost_chars"
    )


#: DuckDB SQL for op1_quality_rules, with the thresholds of RULES.
OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS k FROM w, unnest(range(1, len(ws) - 6)) u(i)),
twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM twice, unnest(range(i, i + 8)) u(p) GROUP BY rid),
lines AS (SELECT rid, unnest(ls) AS l FROM w),
m AS (SELECT rid, l, length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) AS ink, length(l) AS n,
             regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS ws, len(regexp_extract_all(l, '\p{Lu}')) AS upper FROM lines),
bad AS (SELECT rid, count(*) AS n, sum(ink) AS lost FROM m LEFT JOIN cov USING (rid) WHERE
          NOT regexp_matches(l, '[.!?…:;。！？"''”’»)\]][\x20\x09-\x0D]*$')
          OR (m.n - length(replace(l, ' |', ''))) / 2 + m.n - length(replace(l, '»', '')) + m.n - length(replace(l, '›', ''))
             + m.n - length(replace(l, '•', '')) + (m.n - length(replace(l, ' > ', ''))) / 3 > 2
          OR len(regexp_extract_all(l, '[#*$%&|<>]')) * 100 > m.n * 10
          OR (upper >= 10 AND upper * 100 > m.n * 40)
          OR regexp_matches(lower(l), '(all rights reserved|cookie policy|privacy policy|terms of (use|service)|enable javascript|subscribe to our|sign up for|log in to|click here|read more|share this|lorem ipsum|skip to content|powered by)')
          OR (coalesce(cov.n, 0) > 0 AND len(ws) >= 10 AND len(list_distinct(ws)) * 100 < len(ws) * 30)
        GROUP BY rid),
r AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
             coalesce(bad.n, 0)::BIGINT AS n_lines_removed, coalesce(bad.lost, 0)::BIGINT AS lost_chars
      FROM w LEFT JOIN cov USING (rid) LEFT JOIN bad USING (rid))
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost_chars * 100 <= word_chars * 30) AS kept FROM r
"""
