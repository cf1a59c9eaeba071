"""Operator 2, personal data: patterns, and terms that give protected values away.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Each value found is a
protected entity. Terms of its texts disclose it as far as the corpus shows that they go together: with
document frequencies over the whole corpus, the pointwise mutual information of term and entity is
set against the entity's information content, and a term whose ratio exceeds the threshold is
generalised (digits) or removed (the rest) wherever it stands in a text of that entity.

Frequencies are of different texts, so copies of one text alone disclose nothing. The count of a
pair is smoothed by an absolute discount: what a single text shows counts next to nothing, what several
show nearly in full, and no number of texts is a condition. Entities that can't pass even if a term is
in all of their texts and nowhere else are left out before terms are paired with them; pairs are
combined before each shuffle.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_heavy, materialize, small, text_key, text_of

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a digit before the first part would belong to it, so a match never starts there; this only saves time
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TERM = re.compile(r"\w{3,}")


@dataclass(frozen=True)
class Disclosure:
    """What is taken off the count of a pair's texts, and the ratio beyond which a term discloses."""

    discount: float = 0.95
    threshold: float = 0.9


RULES = Disclosure()
#: Terms with texts that a worker holds before it passes them on.
HELD = 400_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def octet(digits: str) -> bool:
    """Whether a number is at most 255; leading zeros don't count, and a long number is never converted."""
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, found from each ``@``, in time linear in the text."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1) if start < at else done
        at = text.find("@", max(done, at + 1))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every kind in its order, then by start; code points, end exclusive."""
    found = [("email", s, e) for s, e in emails(text)]
    if DIGIT.search(text):
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(map(octet, m.group().split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return found


def _listed(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _entities(text: str, spans) -> list[int]:
    return sorted({xxhash.xxh64_intdigest(f"{kind}:{text[start:end].lower()}".encode()) - (1 << 63) for kind, start, end in spans})


def _terms(text: str, spans) -> list[dict]:
    """The terms of a text that meet no span, each with all of its places."""
    places: dict[str, list[tuple[int, int]]] = {}
    taken: list[list[int]] = []  # spans merged, so that one look-up tells whether a word meets any
    for s, e in sorted((s, e) for _, s, e in spans):
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    for m in TERM.finditer(text):
        at = bisect_left(taken, [m.end()]) - 1
        if at < 0 or taken[at][1] <= m.start():
            places.setdefault(m.group().lower(), []).append(m.span())
    return [{"term": t, "places": [{"start": s, "end": x} for s, x in p]} for t, p in sorted(places.items())]


def _scan():
    place = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    term = pa.struct([("term", pa.string()), ("places", pa.list_(place))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, listed, entities, terms = [[] for _ in KINDS], [], [], [], []
            for value in batch.column("text"):
                text = value.as_py()
                spans = base_spans(text)
                kinds = [k for k, _, _ in spans]
                for kind, column in zip(KINDS, counts, strict=True):
                    column.append(kinds.count(kind))
                listed.append(_listed(spans))
                shas.append(hashlib.sha256(listed[-1].encode()).hexdigest())
                entities.append(_entities(text, spans))
                terms.append(_terms(text, spans) if spans else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas), pa.array(listed, pa.string()), batch.column("text_key"), pa.array(entities, pa.list_(pa.int64())), pa.array(terms, pa.list_(term))],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "text_key", "entities", "terms"],
            )

    return run


def find_base(docs: DataFrame) -> DataFrame:
    """What the patterns find in each text, and the terms of texts in which they find something."""
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, base string, text_key binary, entities array<long>, terms array<struct<term:string,places:array<struct<start:int,end:int>>>>"
    return text_of(docs).withColumn("text_key", text_key()).mapInArrow(_scan(), schema)


def judged_mentions(texts: DataFrame, n: int, rules: Disclosure = RULES) -> DataFrame:
    """(text_key, entity, n_entity) of different texts, for entities that a term could disclose at all; one in a single text is none of them in a corpus of fewer than 10^12 texts."""
    mentions = materialize(texts.select("text_key", F.explode("entities").alias("entity")), "mentions")
    counts = materialize(mentions.groupBy("entity").agg(F.count("*").alias("n_entity")), "entities")
    # at best a term is in all of the entity's texts and in no other
    best = _ratio(F.col("n_entity"), F.col("n_entity"), F.col("n_entity"), n, rules)
    judged = counts.where(best > rules.threshold).withColumn("n_rows", F.col("n_entity"))
    return materialize(join_heavy(mentions, judged, ["entity"], "n_rows", mentions.count()), "judged")


def flagged_places(judged: DataFrame, texts: DataFrame, flagged: DataFrame) -> DataFrame:
    """(text_key, at): the places of flagged terms (entity, term, n_both), sought only in texts of entities that have one."""
    entities = materialize(flagged.groupBy("entity").agg(F.count("*").alias("n_terms")), "flagged-entities")
    counted = judged.select("entity", "n_entity").distinct().join(entities, "entity").select("entity", F.col("n_entity").alias("n_rows"))
    mentions = join_heavy(judged.select("text_key", "entity"), materialize(counted, "flagged-counts"), ["entity"], "n_rows", judged.count())
    pairs = mentions.join(texts.select("text_key", "terms"), "text_key").select("text_key", "entity", F.explode("terms").alias("t")).select("text_key", "entity", "t.*")
    pairs = materialize(pairs, "pairs")
    return join_heavy(pairs, flagged, ["entity", "term"], "n_both", pairs.count()).select("text_key", F.explode("places").alias("at"))


def _ratio(n_both: Column, n_entity: Column, n_term: Column, n: int, rules: Disclosure) -> Column:
    """Mutual information of the smoothed count by the entity's information content; null for an entity of every text."""
    information = F.log2(float(n) / n_entity)
    return F.when(information > 0, F.log2((n_both - rules.discount) * float(n) / (n_entity * n_term)) / information)


def _most_texts(n: int, rules: Disclosure) -> Column:
    """The number of texts of a term beyond which the ratio can't exceed the threshold."""
    n_entity = F.col("n_entity").cast("double")
    return F.ceil((F.col("n_both") - rules.discount) * n / n_entity * F.pow(n_entity / n, F.lit(rules.threshold))).cast("long")


def _texts_of_terms(shared, most: int):
    """Arrow map: (term, text_key) of the wanted terms (of all, without a broadcast), combined within a partition.

    Of a term no more texts are given than it takes to see that it is in too many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value if shared else None
        seen: dict[str, set[bytes]] = {}
        held = 0

        def rows():
            pairs = [(t, k) for t, keys in seen.items() for k in keys]
            return pa.RecordBatch.from_arrays([pa.array([t for t, _ in pairs], pa.string()), pa.array([k for _, k in pairs], pa.binary())], names=["term", "text_key"])

        for batch in batches:
            for key, value in zip(batch.column("text_key").to_pylist(), batch.column("text"), strict=True):
                terms = {t.lower() for t in set(TERM.findall(value.as_py()))}
                for t in terms if wanted is None else wanted.keys() & terms:
                    keys = seen.setdefault(t, set())
                    if len(keys) <= (most if wanted is None else wanted[t]) and key not in keys:
                        keys.add(key)
                        held += 1
                if held > HELD:
                    yield rows()
                    seen.clear()
                    held = 0
        yield rows()

    return run


def disclosing_terms(docs: DataFrame, texts: DataFrame, judged: DataFrame, n: int, rules: Disclosure = RULES) -> DataFrame:
    """(entity, term, n_both, disclosure): pairs whose ratio of mutual information to information content exceeds the threshold.

    ``texts`` (the different texts with an entity) and ``judged`` (mentions) are written tables. Entities
    and terms are counted together without places, combined before the shuffle. A term is in at
    least as many texts as hold it beside the entity, and as hold it beside any entity; pairs that
    fail even so need no count over the corpus. The texts of the other terms, which are rare ones, are
    counted in one map over all texts.
    """
    pairs = judged.join(texts.select("text_key", F.col("terms.term").alias("ts")), "text_key").select("entity", "n_entity", F.explode("ts").alias("term"))
    together = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.first("n_entity").alias("n_entity"))
    together = together.where(_ratio(F.col("n_both"), F.col("n_entity"), F.col("n_both"), n, rules) > rules.threshold)
    together = materialize(together.withColumn("most", _most_texts(n, rules)), "together")
    seen = texts.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("n_seen"))
    terms = together.groupBy("term").agg(F.max("most").alias("most"), F.count("*").alias("n_rows")).join(seen, "term")
    terms = materialize(terms.where(F.col("n_seen") <= F.col("most")).drop("n_seen"), "candidates")
    most = terms.agg(F.coalesce(F.max("most"), F.lit(0))).first()[0]
    shared = docs.sparkSession.sparkContext.broadcast({r["term"]: r["most"] for r in terms.select("term", "most").collect()}) if small(terms, "term") else None
    words = docs.select(text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_texts_of_terms(shared, most), "term string, text_key binary")
    words = words if shared else words.join(terms.select("term"), "term", "left_semi")
    counted = words.distinct().groupBy("term").agg(F.count("*").alias("n_term")).join(terms.select("term", "n_rows"), "term")
    joined = join_heavy(together, materialize(counted, "counted"), ["term"], "n_rows", together.count())
    joined = joined.withColumn("disclosure", _ratio(F.col("n_both"), F.col("n_entity"), F.greatest("n_term", "n_both"), n, rules))
    return joined.where(F.col("disclosure") > rules.threshold).select("entity", "term", "n_both", "disclosure")


def sensitive_spans(docs: DataFrame, rules: Disclosure = RULES) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, n_term, spans, text_key of every text.

    ``spans`` lists all of them as kind:start:end, kinds in the order email, ip, card, phone, term,
    then by start. A null text has none. Rows that repeat are found alike, with a doc_id or without;
    spans belong to a text, which ``text_key`` names. Only doc_id and text are read.
    """
    found = materialize(find_base(docs), "pii")
    n, rows = found.agg(F.count_distinct("text_key"), F.count("*")).first()
    texts = materialize(found.where(F.size("entities") > 0).select("text_key", "entities", "terms").dropDuplicates(["text_key"]), "texts")
    judged = judged_mentions(texts, n, rules)
    flagged = materialize(disclosing_terms(docs, texts, judged, n, rules), "flagged").drop("disclosure")
    hit = flagged_places(judged, texts, flagged)
    by_text = hit.groupBy("text_key").agg(F.sort_array(F.collect_set("at")).alias("terms"))
    held = found.where(F.size("entities") > 0)
    by_text = materialize(held.groupBy("text_key").agg(F.count("*").alias("n_rows")).join(by_text, "text_key"), "by_text")
    bare = found.drop("terms", "entities")
    with_terms = join_heavy(held.drop("terms", "entities"), by_text, ["text_key"], "n_rows", rows, "left", F.size("terms") <= 1_000)
    both = with_terms.unionByName(bare.where(F.size(found["entities"]) == 0), allowMissingColumns=True)
    listed = F.transform("terms", lambda t: F.concat(F.lit("term:"), t["start"].cast("string"), F.lit(":"), t["end"].cast("string")))
    spans = F.array_join(F.filter(F.array(F.col("base"), F.array_join(F.coalesce(listed, F.array().cast("array<string>")), ",")), lambda s: s != ""), ",")
    n_term = F.when(F.col("terms").isNull(), 0).otherwise(F.size("terms")).cast("long")
    return both.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", n_term.alias("n_term"), spans.alias("spans"), "text_key")


def op2_pii(documents: DataFrame) -> DataFrame:
    """The contract's columns and ``n_term`` of every row of ``documents``; see ``sensitive_spans`` for nulls and repeated rows.

    A dotted number with a part beyond 255, of however many digits, is no address. An empty table gives no rows.
    """
    found = sensitive_spans(documents)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term")


def redact(text: str, spans: str) -> str:
    """The text with each span replaced: its kind in brackets; a term of digits is generalised, another removed."""
    cuts = sorted((int(s), -int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x))
    out, done = [], 0
    for start, end, kind in cuts:
        end = -end
        if start < done:
            continue
        out.append(text[done:start])
        out.append(("<NUMBER>" if text[start:end].isdigit() else "<TERM>") if kind == "term" else f"<{kind.upper()}>")
        done = end
    return "".join(out) + text[done:]


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [redact(t, s) if t and s else t for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", pa.array(texts, pa.string()))


def sanitise(docs: DataFrame, spans: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """The rows of ``docs`` with the spans of ``sensitive_spans`` taken out of their texts; other columns as they are.

    Spans are found by the text, so rows without a doc_id or that share one get their own. Texts with
    spans are broadcast if they are few and their spans short (or as ``broadcast`` says); otherwise the
    join is a shuffle, in which texts with many copies are still broadcast.
    """
    marked = spans.where("spans != ''").groupBy(F.col("text_key").alias("__text_key")).agg(F.max("spans").alias("__spans"), F.count("*").alias("n_rows"))
    marked = materialize(marked, "spans")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest") if rest else F.lit(None).alias("rest"), text_key().alias("__text_key"))
    if broadcast if broadcast is not None else small(marked, "__spans"):
        joined = packed.join(F.broadcast(marked.drop("n_rows")), "__text_key", "left")
    else:
        joined = join_heavy(packed, marked, ["__text_key"], "n_rows", docs.count(), "left", F.length("__spans") <= 8_000)
    joined = joined.select("doc_id", "text", F.coalesce("__spans", F.lit("")).alias("spans"), "rest")
    out = joined.mapInArrow(_redact, joined.schema)
    return out.select("doc_id", "text", *([F.col("rest")[c].alias(c) for c in rest] if rest else [])).select(*[F.col(f"`{c}`") for c in docs.columns])
