"""Operators 11 to 13 against brute-force versions and round trips."""

import hashlib
import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corploom.llm import decontaminate, importance, periodic_runs, token_files
from corploom.sources.committed import committed

from .test_operators import ODD, docs_of, rows_of, texts_of

EMPTY = "doc_id long, text string, start long, ids array<int>, row long, score long"


# 11 token files
def brute_files(rows, end):
    tokenizer, at, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files(spark, sf):
    odd = [(9101, "a <|endoftext|> b<|endoftext|>"), (-5, "x y"), (9102, "<|endoftext"), (9103, "    \n\n  x    's it''ll")]
    rows = texts_of(sf, spark) + odd + [(9002, ""), (9005, "é ß 日本 🙂 'll 's\n\n x"), (9006, "w" * 5000), (9007, None)]
    want = brute_files(sorted(rows, key=lambda r: r[0]), 2)
    assert rows_of(token_files.op11_token_files(docs_of(spark, rows)), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)


def test_token_files_ties(spark):
    rows = [(None, "n one"), (None, "n two two"), (3, "b"), (3, "b"), (3, "a long one"), (1, "x")] * 20
    out = token_files.op11_token_files(docs_of(spark, rows)).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == [None] * 40 + [1] * 20 + [3] * 60
    assert [r["start"] for r in out] == [0, *itertools.accumulate(r["n_tokens"] for r in out)][:-1]
    same = token_files.op11_token_files(docs_of(spark, rows[::-1]).repartition(7)).orderBy("start").collect()
    assert out == same  # whatever the layout
    assert token_files.op11_token_files(spark.createDataFrame([], EMPTY)).collect() == []


def test_token_files_shared_stretches():
    """What many texts hold between blanks is cut and looked up once for all of them, and the ids are the library's."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, coder, rng = Tokenizer.from_file(path), token_files._Coder(path, public_tokenizers.PATTERN), random.Random(11)
    assert coder.by_blanks and not [c for c in map(chr, range(0x110000)) if regex.match(r"\s", c) and not c.isspace()]
    assert max(c for c in map(chr, range(0x110000)) if c.isspace()) == "\u3000"
    parts = [" ", " ", "  ", "\n", "\n\n", "\t", "\r", "\x1c", "\x00", "\x85", "\u00a0", "\u3000", "a", "word", "é", "日", "🙂", "7", "'", "'s", "'ll", "!", ".", "<|endoftext|>", "<|"]
    texts = ["", " ", "a ", " a", "\n", "a\n", "a\n b", "a \nb", "a\n\n \nb", "x" * 100] + ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(20_000)]
    want = [list(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for end in (None, 2):
        assert coder.many(pa.array(texts), end).to_pylist() == [ids + [end] * (end is not None) for ids in want]
    assert coder.many(pa.array([], pa.string()), 2).to_pylist() == [] and coder.many(pa.array(["", "  a"]), 2).to_pylist() == [[2], [*want[1], *want[texts.index(" a")], 2]]
    assert coder.many(pa.array(texts, pa.large_string())[5:70]).to_pylist() == want[5:70]
    other = token_files._Coder(path, public_tokenizers.PATTERN + "|x")
    assert not other.by_blanks and other.many(pa.array(texts[:99]), 2).to_pylist() == [[*ids, 2] for ids in want[:99]]
    seen, whole, split = [], ["of the same words, again.\n" + "of the same words, again. " * 50 + "end"] * 300, coder.pieces
    coder.pieces = lambda text: seen.append(len(text)) or split(text)
    assert coder.many(pa.array(whole)).to_pylist() == [list(tokenizer.encode(whole[0], add_special_tokens=False).ids)] * 300
    assert sum(seen) * 100 < sum(map(len, whole))


@pytest.mark.parametrize("vocabulary", [2, 3, 257, 32_000, 50_257, 65_537, 1 << 20, 1 << 31])
def test_packing(vocabulary):
    bits, rng = token_files.bits_of(vocabulary), np.random.default_rng(vocabulary)
    ids = rng.integers(0, vocabulary, 1003).astype(np.uint32)
    raw = token_files.pack(ids, bits)
    assert len(raw) == -(-1003 * bits // 8) and (vocabulary - 1) >> bits == 0
    value = int.from_bytes(raw, "little")
    assert all(value >> (k * bits) & ((1 << bits) - 1) == ids[k] for k in range(0, 1003, 37))
    for first, count in ((0, 1003), (1, 5), (500, 503), (1002, 1), (7, 0)):
        assert (token_files.unpack(raw, bits, first, count) == ids[first : first + count]).all()


def test_files_and_random_access(tmp_path):
    rng = random.Random(3)
    docs = [(k if k % 5 else None, np.array([rng.randrange(1000) for _ in range(rng.choice([0, 1, 7, 40, 300]))], np.uint32)) for k in range(60)]
    whole = np.concatenate([ids for _, ids in docs])
    for block in (8, 13, 64):  # also blocks that end within a byte
        path = tmp_path / f"{block}.bits"
        with open(path, "wb") as out:
            file = token_files.FileWriter(out, 1000, block)
            for d, ids in docs:
                file.add(d, ids)
            facts = file.close()
        assert facts == {"documents": 60, "ids": len(whole)}
        with pa.OSFile(str(path)) as source:
            back = token_files.FileReader(source)
            assert [None if null else int(d) for d, null in zip(back.docs, back.nulls, strict=True)] == [d for d, _ in docs]
            assert all((back.document(k) == docs[k][1]).all() for k in range(60))
            for first, count in ((0, len(whole)), (17, 100), (len(whole) - 1, 1), (5, 0)):
                assert (back.ids(first, count) == whole[first : first + count]).all()
            with pytest.raises(ValueError):
                back.ids(len(whole), 1)
        raw = bytearray(path.read_bytes())
        raw[20] ^= 1
        with pytest.raises(ValueError, match="block 0 is damaged"):
            token_files.FileReader(pa.BufferReader(bytes(raw))).ids(0, 5)
        raw[-60] ^= 1
        with pytest.raises(ValueError, match="index is damaged"):
            token_files.FileReader(pa.BufferReader(bytes(raw)))
    with pytest.raises(ValueError, match="outside a vocabulary"):
        token_files.FileWriter(open(tmp_path / "x", "wb"), 10).add(1, np.array([10]))


def test_files_roll_and_stretch(spark, tmp_path):
    rows = [(k, f"word{k} " * (k % 17)) for k in range(200)]
    target = f"file://{tmp_path}/t"
    token_files.write_packed(docs_of(spark, rows), target, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 50_257, None, 64, 300)
    files = committed(target)["files"]
    assert len(files) > 10 and all(f["documents"] for f in files)
    read = token_files.read_packed(spark, target).orderBy("doc_id").collect()
    whole = [i for r in read for i in r["ids"]]
    assert [r["doc_id"] for r in read] == list(range(200)) and sum(f["ids"] for f in files) == len(whole)
    for first, count in ((0, 10), (290, 700), (len(whole) - 3, 3)):
        assert token_files.stretch(target, first, count).tolist() == whole[first : first + count]


# 12 importance resampling
def brute_importance(rows, benchmark, percent=10, least=20, buckets=10_000, max_words=1):
    fold = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))

    def feats(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, max_words + 1) for i in range(len(w) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    for _, x in rows:
        for f in feats(x):
            s[f] += 1
    for x in benchmark:
        for f in feats(x):
            t[f] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for k, (i, x) in enumerate(rows):
        f = feats(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x)) >= least, k])
    fit = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = rank + 1
    return sorted([tuple(r[:5]) for r in out], key=repr)


def test_importance(spark, sf):
    rows = texts_of(sf, spark) + [(9002, ""), (9003, None), (9005, "É ß 日本 Straße " * 30), (9006, "w" * 5000), (9007, "The cat_sat-on 4 mats " * 100)]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    texts = [r["text"] for r in bench.collect()]
    out = importance.op12_importance(docs_of(spark, rows), bench)
    assert rows_of(out, "doc_id", "n_features", "weight", "score", "rank") == brute_importance(rows, texts)
    pairs = importance.importance_sample(docs_of(spark, rows), bench, percent=35, min_words=5, buckets=97, max_words=3)
    assert rows_of(pairs, "doc_id", "n_features", "weight", "score", "rank") == brute_importance(rows, texts, 35, 5, 97, 3)


def test_importance_stretches(monkeypatch):
    monkeypatch.setattr(importance, "STRETCH", 16)
    bucket, text = importance._Buckets(1000), "Some words, and some more; " * 9
    words = text.lower().replace(",", "").replace(";", "").split()
    want = sorted(zlib.crc32(" ".join(words[i : i + n]).encode()) % 1000 for n in (1, 2, 3) for i in range(len(words) - n + 1))
    n, found = importance.feature_buckets(text, bucket, 3)
    assert n == len(words) and sorted(found.tolist()) == want


def test_importance_ties_and_empty(spark):
    text = "one two three four " * 6
    rows = [(7, text)] * 100 + [(None, text)] * 50 + [(8, "short")] * 9
    bench = spark.createDataFrame([("one two",), (None,)], "text string")
    out = importance.op12_importance(docs_of(spark, rows), bench).collect()
    drawn = sorted((r["rank"], r["doc_id"]) for r in out if r["rank"])
    assert len(out) == 159 and [r for r, _ in drawn] == list(range(1, 16)) and len({d for _, d in drawn}) == 1
    none = spark.createDataFrame([], EMPTY)
    assert importance.op12_importance(none, bench).collect() == []
    assert len(importance.op12_importance(docs_of(spark, rows[:30]), none).collect()) == 30


def test_kth_key(spark):
    rng = random.Random(5)
    edge = [-(1 << 63), (1 << 63) - 1, 0, None]
    values = [(rng.choice([5, -7, 10**12, None]), rng.choice([*edge, rng.randrange(100)]), k) for k in range(300)]
    rows = spark.createDataFrame(values, "a long, b long, c long").cache()
    keys = [("a", True), ("b", False), ("c", False)]
    order = sorted(values, key=lambda v: (v[0] is None, -(v[0] or 0), v[1] is None, v[1] or 0, v[2]))
    for k in (1, 2, 60, 149, 150, 260, 299, 300):
        found = {tuple(r) for r in rows.where(importance.kth_key(rows, keys, k)).collect()}
        assert found == set(order[:k]), k
    assert [tuple(r)[:3] for r in importance.ranked(rows, keys, "n").orderBy("n").collect()] == order


# 13 runs
def brute_runs(words):
    n, out = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.add((i, j - i + q, q))
            i = max(j, i) + 1
    least = {}
    for s, size, q in sorted(out, key=lambda r: r[2]):
        least.setdefault((s, size), q)
    return sorted(((s, size, q) for (s, size), q in least.items()), key=lambda r: (r[0], r[2]))


def brute_periodic(i, text, plant=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(i).encode())
    if plant and i is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    drop = {k for s, size, q in runs for k in range(s + q, s + size)}
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (i, len(runs), *top, digest("".join(f"{s},{size},{q}\n" for s, size, q in runs)), digest(" ".join(w for k, w in enumerate(words) if k not in drop)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_periodic_runs_on_tables(spark, sf):
    rows = [r for r in texts_of(sf, spark) if len(r[1]) < 30_000] + ODD
    out = periodic_runs.op13_periodic_runs(docs_of(spark, rows))
    assert rows_of(out, *COLUMNS) == sorted([brute_periodic(i, t) for i, t in rows], key=repr)
    assert sum(1 for r in out.collect() if r["n_runs"]) > 10
    assert periodic_runs.op13_periodic_runs(spark.createDataFrame([], EMPTY)).collect() == []


def test_runs_brute():
    rng = random.Random(11)
    for trial in range(1500):
        words, doc = [], []
        for d in range(rng.randrange(1, 4)):
            own = []
            while len(own) < rng.choice([0, 5, 30, 90]):
                base = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(1, 9))]
                own += (base * rng.choice([1, 1, 2, 4, 5, 9]))[: rng.randrange(1, 60)]
            words += own
            doc += [d] * len(own)
        found = sorted(map(tuple, periodic_runs.find_runs(np.array(words, np.int64), np.array(doc, np.int64)).tolist()))
        want = []
        for d in set(doc):
            first = doc.index(d)
            want += [(s + first, size, q) for s, size, q in brute_runs(words[first : first + doc.count(d)])]
        assert found == sorted(want), trial


def test_runs_of_one_word_and_interface(spark):
    n = 60_000
    found = periodic_runs.find_runs(np.zeros(n, np.int64), np.zeros(n, np.int64))
    assert found.tolist() == [[0, n, 1]]
    out = periodic_runs.periodic_runs(docs_of(spark, [(1, "x a b a b a b a b y")])).collect()[0]
    assert (out["runs"], out["collapsed"], out["exponent_milli"]) == ("1,8,2\n", "x a b y", 4000)


# 10 decontamination of benchmarks with a common template
def edits_within(pattern, text, budget):
    """Least edits of the whole pattern anywhere in the text, or None beyond the budget."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row) if min(row) <= budget else None


def test_items_with_a_template(monkeypatch):
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz     "
    text_of = lambda n: "".join(rng.choice(letters) for _ in range(n))
    template = "read the question with care and give the letter of the right answer"
    items = [(k, template + text_of(30 + k % 9).replace("  ", " x")) for k in range(300)]
    index = decontaminate.build_index(items)
    texts = [template + text_of(40), template * 5, text_of(50) + items[7][1] + text_of(200) + items[7][1], text_of(30) + items[100][1][:90] + "zz" + items[100][1][92:] + text_of(20)]
    want = []
    for t, text in enumerate(texts):
        for k, (i, item) in enumerate(items):
            n = edits_within(item, text, int(index.edits[k]))
            if n is not None:
                want.append((t, i, n))
    assert [m[:3] for m in decontaminate.matches(index, texts)] == want and len(want) >= 2
    monkeypatch.setattr(decontaminate, "HITS", 2_000)  # texts are halved down to single ones, and those too
    monkeypatch.setattr(decontaminate, "MANY", 0)
    again = decontaminate.matches(index, [*texts, "x" * 3000 + items[9][1] + " " * 3000])
    assert [m[:3] for m in again] == [*want, (4, 9, 0)] and again[-1][3:] == (3000, 3000 + len(items[9][1]))


def test_many_items_with_a_template_are_quick():
    import time

    rng = random.Random(4)
    template = "read the question with care and give the letter of the right answer "
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9))) for _ in range(3000)]
    items = [(k, template + " ".join(rng.choices(words, k=6))) for k in range(20_000)]
    index = decontaminate.build_index(items)
    text = template + " ".join(rng.choices(words, k=6))
    began = time.time()
    assert decontaminate.matches(index, [text, (template + "x ") * 5 + items[500][1]])[-1][:3] == (1, 500, 0)
    assert time.time() - began < 30


def test_near_copies_keeps_clashing_columns(spark):
    from corploom.llm import near_copies

    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, "mine", 5), (2, text, "other", 6), (3, text.replace("w30", "v30"), "near", 7), (None, "alone here", None, None)]
    out = near_copies.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string, digest string, ord long")).collect()
    assert sorted(map(tuple, out), key=repr) == sorted([rows[0], rows[3]], key=repr)


# 3 stored prefix counts
@pytest.fixture(scope="module")
def counter():
    from corploom.llm import token_counts

    return token_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def test_prefix_counts_of_long_pieces(counter):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = lambda x: len(tokenizer.encode(x, add_special_tokens=False).ids)
    rng = random.Random(5)
    mixed = "".join(rng.choices([" ", "\n", "\t", "  "], k=400))
    for text in (*(u * k for u in (" ", "a", "\n", "é", "-", "ab", "=-") for k in (90, 95, 96, 97, 200, 2049, 2500)), mixed):
        own = counter.prefix_counts(text.encode())
        assert counter.count(text) == own[-1] == n(text)
        if text.isascii() and len(text) < 250:
            assert [int(c) for c in own] == [n(text[:k]) for k in range(len(text) + 1)]
    assert len(counter.prefix_counts(b" " * 5_000_000)) == 5_000_001


def test_truncation_across_special_tokens(counter):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = lambda x: len(tokenizer.encode(x, add_special_tokens=False).ids)
    rng = random.Random(6)
    parts = ["<|endoftext|>", "<|endo", " ", "  ", "\n", "a", "hello", " world", "'s", "'ll", "é", "日", "12", "!!", "x" * 100]
    for _ in range(400):
        text, budget = "".join(rng.choices(parts, k=rng.randrange(0, 14))), rng.randrange(-1, 20)
        counts = counter.text_counts(text)
        assert counts == [n(text[:k]) for k in range(len(text) + 1)]
        assert counter.fit(text, budget) == max((k for k, c in enumerate(counts) if c <= budget), default=0)
    assert counter.stored["hello"].tolist() == [n("hello"[:k]) for k in range(6)]
    pieces, ends = counter.segments("a <|endoftext|> b" * 3)
    assert pieces.count("<|endoftext|>") == 3 and ends[-1] == n("a <|endoftext|> b" * 3)


# 9 anchors of very many rows
@pytest.mark.parametrize("hot_rows", [3, 40])
def test_hot_anchors_are_settled_by_windows(spark, hot_rows):
    from corploom.llm import substring_dedup

    from .test_operators import brute_repeats

    rng = random.Random(hot_rows)
    phrase = " ".join(f"p{k}" for k in range(12))
    word = lambda: f"w{rng.randrange(4)}"
    rows = [(k, " ".join([*(word() for _ in range(rng.randrange(0, 14))), phrase, *(word() for _ in range(rng.randrange(0, 14)))])) for k in range(150)]
    rows += [(200 + k, f"a{k} b c " + phrase + " d e f g h i j k l m n") for k in range(20)] + [(300, rows[7][1]), (None, phrase), (301, phrase * 3)]
    got = rows_of(substring_dedup.remove_repeats(docs_of(spark, rows), hot_rows=hot_rows, common=10**6), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_repeats(rows)


# 6 altered licences
def test_altered_licences_are_not_the_originals(spark):
    import duckdb

    from corploom.llm import licenses

    rest = "\nThe above copyright notice and this permission notice shall be included in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND."
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met{}:\n1. Redistributions of source code must retain the above copyright notice.\n2. Redistributions in binary form must reproduce the above copyright notice.\nTHIS SOFTWARE IS PROVIDED BY X \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."
    rows = [(1, grant + "." + rest), (2, grant + ", to use it for non-commercial purposes only." + rest), (3, grant + " unless they are a company." + rest), (4, bsd.format("")), (5, bsd.format(" and the use is academic")), (6, grant + " to deal in it, lonely or not." + rest)]
    out = licenses.op6_license_scan(docs_of(spark, rows))
    assert [(r["doc_id"], r["licenses"]) for r in out.orderBy("doc_id").collect()] == [(1, "MIT"), (2, ""), (3, ""), (4, "BSD-2-Clause"), (5, ""), (6, "MIT")]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert rows_of(out, "doc_id", "n_known", "sentence_ids", "licenses", "unmatched") == sorted(con.sql(licenses.OP6_SQL).fetchall(), key=repr)
