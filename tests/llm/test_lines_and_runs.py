"""Line dedup and periodic runs against plain versions, at their edges and on the smallest tables."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from factorloom.llm import lines, runs
from factorloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x).hexdigest()


# ------------------------------------------------------------------ 13: lines


def plain_lines(rows, least_chars, least_docs):
    """What dedup_lines returns, by plain loops over (doc_id, text)."""
    blanks = " \t\n\x0b\x0c\r"
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(blanks).translate(upper)
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars and doc is not None:
                holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        own = (text or "").split("\n")
        shared = [len(h) >= least_docs and (doc is None or doc < max(h)) for h in (holders.get(key(x), ()) for x in own)]
        kept = "\n".join(x for x, gone in zip(own, shared, strict=True) if not gone)
        out.append((doc, len(own), sum(shared), sha(kept.encode())))
    return sorted(out, key=repr)


def line_docs():
    r = np.random.default_rng(5)
    pool = [f"line {k} " + "é" * int(r.integers(0, 12)) + "x" * int(r.integers(0, 20)) for k in range(30)]
    rows = []
    for doc in range(120):
        own = [pool[min(29, int(r.pareto(0.7)))] for _ in range(int(r.integers(0, 9)))]
        own = [f"{' \t\r'[r.integers(0, 3)]}{x.upper() if r.random() < 0.3 else x}\x0b" if r.random() < 0.4 else x for x in own]
        rows.append((doc, "\n".join(own)))
    rows += [(3, "another\n" + pool[0] + "\n"), (3, "another\n" + pool[0] + "\n"), (None, pool[0] + "\n" + pool[1]), (500, None), (501, ""), (502, "\n\n")]
    return rows + [(600, "\n".join(f"{pool[k % 30]}{'' if k % 3 else k}" for k in range(5000)))]


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_lines_equal_brute_force(spark, partitions):
    rows = line_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13" if partitions == 7 else "10000")
    try:
        found = lines.dedup_lines(docs, 12, 5, with_text=True).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in found), key=repr) == plain_lines(rows, 12, 5)
    assert all(sha(r["kept"].encode()) == r["kept_sha256"] for r in found)


def test_lines_without_broadcast(spark):
    rows = line_docs()
    spark.conf.set("spark.factorloom.broadcastBytes", "1")
    try:
        found = [tuple(r) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 12, 5).collect()]
    finally:
        spark.conf.unset("spark.factorloom.broadcastBytes")
    assert sorted(found, key=repr) == plain_lines(rows, 12, 5)


def test_line_keys():
    assert lines.line_key(b" \t" + b"A" * 40 + b"\r\x0b", 40) == b"a" * 40
    assert lines.line_key(b"A" * 39 + b" ", 40) is None
    assert lines.line_key("É".encode() * 39, 40) is None
    assert lines.line_key("É".encode() * 40, 40) == "É".encode() * 40
    assert lines.line_key(" ".encode() * 40, 40) == " ".encode() * 40


def test_lines_at_the_edges(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert sorted((tuple(r) for r in lines.dedup_lines(odd_docs, 5, 2).collect()), key=repr) == plain_lines(rows, 5, 2)
    assert lines.dedup_lines(no_docs).count() == 0


# ------------------------------------------------------------------ 12: runs


def plain_runs(words):
    """(start, end, least period) of all maximal runs."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b, q) for (a, b), q in found.items())


def plain_row(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for a, b, q in found for i in range(a + q, b)}
    best = min(found, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    top = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    listing = "".join(f"{a},{b - a},{q}\n" for a, b, q in sorted(found, key=lambda r: (r[0], r[2])))
    return (doc_id, len(found), *top, sha(listing.encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def texts_of_runs(r):
    """Texts over few words, of one word, of repeated stretches, and of repeats of repeats."""
    out = []
    for kind in r.integers(0, 5, 10):
        n = int(r.integers(0, 120))
        own = r.integers(0, 2 + kind, n).tolist() if kind < 2 else [0] * n
        if kind > 2:
            own = []
            while len(own) < n:
                own = own * int(r.integers(1, 4)) if kind == 4 else own
                own += r.integers(0, 3, r.integers(1, 9)).tolist() * int(r.integers(1, 9))
                own = own[: max(1, len(own) - int(r.integers(0, 3)))][:300]
        out.append([b"%d" % x for x in own])
    return out


def test_runs_equal_brute_force():
    r = np.random.default_rng(6)
    for _ in range(150):
        texts = texts_of_runs(r)
        found = runs.find_runs(*runs.numbered(texts))
        doc = np.repeat(np.arange(len(texts)), [len(w) for w in texts])
        starts = np.append(0, np.cumsum([len(w) for w in texts]))[doc[found.start]]
        got = sorted(zip(doc[found.start].tolist(), (found.start - starts).tolist(), (found.end - starts).tolist(), found.period.tolist(), strict=True))
        assert got == sorted((k, *x) for k, w in enumerate(texts) for x in plain_runs(w))


def test_grammar_derives_the_text():
    """Occurrences of one rule stand for equal words, and the halves of the start sequence leave no pair that recurs."""
    r = np.random.default_rng(7)
    for _ in range(30):
        symbols, doc = runs.numbered(texts_of_runs(r))
        g = runs.re_pair(symbols, doc)
        for rule in np.unique(g.rule):
            at = np.flatnonzero(g.rule == rule)
            stands = {tuple(symbols[a : a + n]) for a, n in zip(g.start[at], g.length[at], strict=True)}
            assert len(stands) == 1 and len(set(g.left[at].tolist())) == 1
        covers = np.zeros(len(symbols), int)
        ends = np.append(g.top[1:], len(symbols))
        covers[g.top] += 1
        assert (ends > g.top).all() and covers.sum() == len(g.top) and (not len(symbols) or g.top[0] == 0)


def test_runs_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = sorted(tuple(r) for r in QUERIES["op12_runs"](spark, SF).collect())
    assert found == sorted(plain_row(i, t) for i, t in rows)
    assert sum(r[1] > 0 for r in found) > len(rows) // 20


def test_runs_at_the_edges(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    found = [tuple(r) for r in runs.periodic_runs(odd_docs, runs.tail_repeats).collect()]
    assert sorted(found, key=repr) == sorted((plain_row(i, t) for i, t in rows), key=repr)
    assert runs.periodic_runs(no_docs).count() == 0


def test_one_word_many_times():
    found = runs.find_runs(*runs.numbered([[b"w"] * 50_000, [], [b"a", b"b"] * 9000]))
    assert [x.tolist() for x in found] == [[0, 50_000], [50_000, 68_000], [1, 2]]
    assert pa.array(found.period).type == pa.int64()
