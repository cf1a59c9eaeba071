"""Operator 7, URL filters: a trie over reversed host labels and path segments, broadcast.

A rule list is a stated set with a bound on its size (``MAX_RULES``); its trie is built on the
driver and broadcast. A url walks down the labels of its host from the right, then the segments of
its path, so a look-up costs the url's length, however many rules there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules of a list that is broadcast; a longer list is refused.
MAX_RULES = 1_000_000

#: The contract's rules (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


@dataclass
class _Node:
    labels: dict[str, _Node] = field(default_factory=dict)
    paths: _Path | None = None


@dataclass
class _Path:
    segments: dict[str, _Path] = field(default_factory=dict)
    #: what the next segment must begin with -> (verdict, rule as text)
    ends: dict[str, tuple[str, str]] = field(default_factory=dict)
    #: characters of the longest of them
    longest: int = 0
    #: a rule without a path, which holds for every path
    any: tuple[str, str] | None = None


class HostPathTrie:
    """Longest match among allow and block rules; for the same host and path, block goes before allow."""

    def __init__(self, rules):
        rules = list(rules)
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are broadcast")
        self.root = _Node()
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.lower().split(".") if host else []):
                node = node.labels.setdefault(label, _Node())
            node.paths = at = node.paths or _Path()
            value = (verdict, host + path)
            if not path:
                at.any = value if at.any is None or verdict == "block" else at.any
                continue
            *whole, tail = path.split("/")[1:] if path.startswith("/") else path.split("/")
            for segment in whole:
                at = at.segments.setdefault(segment, _Path())
            at.longest = max(at.longest, len(tail))
            if tail not in at.ends or verdict == "block":
                at.ends[tail] = value

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits, None without one."""
        best, node = None, self.root
        segments = path.split("/")[1:] if path.startswith("/") else []
        for label in [None, *reversed(host.split("."))]:
            if label is not None and (node := node.labels.get(label)) is None:
                break
            if node.paths is not None and (found := self._path(node.paths, segments)) and (best is None or len(found[1]) >= len(best[1])):
                best = found
        return best

    @staticmethod
    def _path(at: _Path, segments: list[str]) -> tuple[str, str] | None:
        best = at.any
        for segment in segments:
            for k in range(min(len(segment), at.longest) + 1):
                best = at.ends.get(segment[:k], best) if at.ends else best
            at = at.segments.get(segment)
            if at is None:
                break
        return best


def _judge(shared, default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            found = [trie.match(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f and f[1] for f in found], pa.string()), pa.array([f[0] if f else default for f in found], pa.string())],
                names=[*batch.schema.names, "rule", "verdict"],
            )

    return run


def url_verdicts(pages: DataFrame, rules=RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every url.

    The host runs from the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z in lower case; the
    path from there to ``?``, ``#`` or the end. A null url, or one without ``://``, has neither. A
    url that no rule fits gets ``default``. Every row gives one row; other columns aren't read.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1).alias("path"))
    shared = pages.sparkSession.sparkContext.broadcast(HostPathTrie(rules))
    return parts.mapInArrow(_judge(shared, default), "page_id long, host string, path string, rule string, verdict string")


def op7_url_filter(pages: DataFrame) -> DataFrame:
    """The contract's rules and columns for every row of ``pages``; see ``url_verdicts`` for nulls and repeated rows. An empty table gives no rows."""
    return url_verdicts(pages)


#: DuckDB SQL for op7_url_filter: every rule against every url, the longest kept.
OP7_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id,
             CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT rid, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(verdict, h, pre) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
hit AS (SELECT rid, h || pre AS rule, verdict FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre)
        QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(h || pre) DESC, verdict DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN hit USING (rid)
"""
