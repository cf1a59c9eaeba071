"""SPDX licence expressions: a strict parser and an allow-list verdict, applied to distinct strings."""

from __future__ import annotations

import re
from dataclasses import dataclass

MAX_BYTES, MAX_DEPTH = 1024, 16

#: Identifiers that the default policy accepts, permissive ones and weak copyleft.
ALLOWED = (
    "0BSD Apache-2.0 BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-3-Clause-Clear BSL-1.0 CC0-1.0 curl HPND ISC Libpng MIT MIT-0 NCSA PSF-2.0 "
    "Python-2.0 Unicode-3.0 Unicode-DFS-2016 Unlicense UPL-1.0 WTFPL X11 Zlib "
    "LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MPL-1.0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception"
).split()

TOKEN = re.compile(r"\s*([()]|[^\s()]+)")
IDENTIFIER = re.compile(r"[A-Za-z0-9.-]+\+?$|(DocumentRef-[A-Za-z0-9.-]+:)?LicenseRef-[A-Za-z0-9.-]+$")


@dataclass(frozen=True)
class Verdict:
    accepted: bool
    reason: str
    valid: bool = True


def canonical(identifier: str) -> str:
    """Lower case; a bare GNU version means that version only, with a plus that or later."""
    low = identifier.lower()
    if re.fullmatch(r"(a|l)?gpl-\d+\.\d+|gfdl-\d+\.\d+", low):
        return low + "-only"
    if re.fullmatch(r"((a|l)?gpl|gfdl)-\d+\.\d+\+", low):
        return low[:-1] + "-or-later"
    return low.removesuffix("+")


def parse(text: str):
    """('id', name, exception) | ('and' | 'or', parts); ValueError if it isn't an expression. WITH binds before AND before OR."""
    if len(text.encode()) > MAX_BYTES:
        raise ValueError("expression is too long")
    tokens = TOKEN.findall(text)
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else None

    def take():
        nonlocal at
        at += 1
        return tokens[at - 1]

    def many(operator: str, part, depth: int):
        parts = [part(depth)]
        while peek() == operator:
            take()
            parts.append(part(depth))
        return parts[0] if len(parts) == 1 else (operator.lower(), parts)

    def either(depth: int):
        return many("OR", both, depth)

    def both(depth: int):
        return many("AND", single, depth)

    def single(depth: int):
        token = peek()
        if token == "(":
            if depth >= MAX_DEPTH:
                raise ValueError("parentheses are too deep")
            take()
            inner = either(depth + 1)
            if peek() != ")":
                raise ValueError("a parenthesis isn't closed")
            take()
            return inner
        if token is None or token in (")", "AND", "OR", "WITH") or not IDENTIFIER.fullmatch(token):
            raise ValueError(f"not a licence identifier: {token}")
        take()
        exception = None
        if peek() == "WITH":
            take()
            exception = take() if peek() else None
            if exception is None or not re.fullmatch(r"[A-Za-z0-9.-]+", exception):
                raise ValueError("an exception must follow WITH")
        return ("id", token, exception)

    tree = either(0)
    if at != len(tokens):
        raise ValueError(f"unexpected {tokens[at]}")
    return tree


def verdict(text: str | None, allowed=frozenset(map(canonical, ALLOWED)), allow_unlicensed: bool = False) -> Verdict:
    """OR needs one accepted part, AND all of them; an exception never rescues. NONE and NOASSERTION grant nothing."""
    if text is None:
        return Verdict(False, "no expression", False)
    try:
        tree = parse(text)
    except ValueError as error:
        return Verdict(False, str(error), False)

    def joined(reasons) -> str:
        """The reasons in order, one that follows itself once."""
        return "; ".join(r for k, r in enumerate(reasons) if not k or reasons[k - 1] != r)

    def judge(node) -> Verdict:
        if node[0] == "id":
            name, exception = node[1], node[2]
            if exception is None and name.upper() in ("NONE", "NOASSERTION"):
                ok = allow_unlicensed and name.upper() == "NONE"
                return Verdict(ok, "" if ok else f"{name.upper()} grants nothing")
            ok = canonical(name) in allowed
            return Verdict(ok, "" if ok else f"{name} is not on the list")
        found = [judge(n) for n in node[1]]
        if node[0] == "or":
            ok = any(v.accepted for v in found)
            return Verdict(ok, "" if ok else joined([v.reason for v in found]))
        bad = [v.reason for v in found if not v.accepted]
        return Verdict(not bad, joined(bad))

    return judge(tree)


def display(node, inside: str = "") -> str:
    """An expression as text again: AND within OR needs no parentheses, OR within AND does."""
    if node[0] == "id":
        return node[1] + (f" WITH {node[2]}" if node[2] else "")
    text = f" {node[0].upper()} ".join(display(n, node[0]) for n in node[1])
    return f"({text})" if inside == "and" and node[0] == "or" or inside == node[0] else text


def judged(rows, column: str = "license", allowed: tuple[str, ...] = tuple(ALLOWED), allow_unlicensed: bool = False):
    """``rows`` with ``accepted``, ``reason`` and ``valid`` (it parses): distinct expressions are judged once each, in an Arrow map, and joined back. A null has no expression."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    names = frozenset(map(canonical, allowed))

    def run(batches):
        for batch in batches:
            found = [verdict(x, names, allow_unlicensed) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.accepted for v in found], pa.bool_()), pa.array([v.reason for v in found], pa.string()), pa.array([v.valid for v in found], pa.bool_())], names=["__license", "accepted", "reason", "valid"])

    known = rows.select(F.col(column).alias("__license")).distinct().mapInArrow(run, "__license string, accepted boolean, reason string, valid boolean")
    return rows.join(known, rows[column].eqNullSafe(known["__license"])).drop("__license")


def shaped(text):
    """Whether a column has the shape of an expression: names, ``name WITH name``, joined by AND or OR, in brackets; names needn't exist. Null and empty have not."""
    from pyspark.sql import functions as F

    tokens = F.regexp_extract_all(text, F.lit(r"[()]|[A-Za-z0-9.+:_-]+"), 0)
    # one letter for each token: brackets, o between terms, w for WITH, i for a name
    kinds = F.transform(tokens, lambda t: F.when(t.isin("(", ")"), t).when(t.isin("AND", "OR"), "o").when(t == "WITH", "w").otherwise("i"))
    line = F.array_join(kinds, "")
    level = F.aggregate(kinds, F.lit(0), lambda n, t: F.when(n < 0, n).when(t == "(", n + 1).when(t == ")", n - 1).otherwise(n))
    whole = text.rlike(r"^[A-Za-z0-9.+:_()\s-]*$") & line.rlike("^[(i]") & line.rlike("[i)]$") & ~line.rlike(r"[(o][^(i]|i[(i]|\)[^o)]|w[^i]|wiw")
    return F.coalesce(whole & (level == 0), F.lit(False))
