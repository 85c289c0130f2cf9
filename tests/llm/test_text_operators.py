"""Operators of the text subpackage against plain versions, at their edges and on the smallest tables."""

import gc
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factorloom.llm import attention, bpe, huffman, multiindex, outliers, packing, quality, repeats, simhash, toxicity
from factorloom.llm.common import held_out
from factorloom.llm.graph import components
from factorloom.llm.queries import QUERIES
from factorloom.llm.tokens import PartEncoder

SF = "/root/testdata/sf0.001"
BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def documents(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ------------------------------------------------------------------ helpers


def test_part_encoder_equals_the_library():
    tool = Tokenizer.from_file(BYTE_BPE)
    texts = ["a  b", "", "  ", " a", "a ", "a\n b", "a \nb", "a\n \nb", "x <|endoftext|> z", "a<|endoftext|>b c", "it's 'they're'", "日本 語 　 x", "x" * 300 + " b", "\x00 \x01 a", "🙂 🙂🙂 a🙂", "nt, nt. nt,, |a| a|"]
    expected = [np.array(e.ids, "<u4").tobytes() for e in tool.encode_batch(texts * 2, add_special_tokens=False)]
    for kept in (0, 5, 10_000):
        assert PartEncoder(BYTE_BPE, kept).encode(texts * 2, group_chars=20) == expected


def test_part_encoder_holds_one_model():
    tool = PartEncoder(BYTE_BPE, 0)
    tool.tokenizer.model.fuse_unk = not tool.model_only.model.fuse_unk
    assert tool.tokenizer.model.fuse_unk == tool.model_only.model.fuse_unk


def test_part_encoder_collects_no_garbage_on_its_way():
    tool, seen = PartEncoder(BYTE_BPE), []
    texts = [" ".join(f"w{n}x{k}" for n in range(200)) for k in range(300)]
    gc.callbacks.append(lambda phase, info: seen.append(phase))
    try:
        tool.encode(texts)
    finally:
        gc.callbacks.pop()
    assert not seen and gc.isenabled()
    with pytest.raises(TypeError):
        tool.encode(["a", 5])
    assert gc.isenabled()


def test_part_encoder_does_not_walk_through_the_parts_that_it_knows():
    class Known(dict):
        def __iter__(self):
            raise AssertionError("all known parts are looked at for one group of texts")

    tool, text = PartEncoder(BYTE_BPE), "one two one, three"
    first = tool.encode([text])
    tool.after_space = Known(tool.after_space)
    assert tool.encode([text, text + " four"])[0] == first[0] and "four" in tool.after_space


def test_part_encoder_gives_new_pieces_to_the_model_alone():
    tool = PartEncoder(BYTE_BPE)
    plain = Tokenizer.from_file(BYTE_BPE)
    tool.model_only.add_tokens(["quux"])  # only the whole way through the tokenizer looks for it
    assert tool.direct and tool.encode(["a quux"]) == [np.array(plain.encode("a quux").ids, "<u4").tobytes()]


def test_part_encoder_takes_known_parts_for_pieces():
    tool, seen = PartEncoder(BYTE_BPE), []
    tool.encode(["a word"])
    of_pieces = tool.of_pieces
    tool.of_pieces = lambda pieces: seen.extend(pieces) or of_pieces(pieces)
    plain = Tokenizer.from_file(BYTE_BPE)
    assert tool.encode(["a word.\nnext"]) == [np.array(plain.encode("a word.\nnext").ids, "<u4").tobytes()]
    assert "next" in seen and " word" not in seen


@pytest.mark.parametrize("added", ["foo", "o,", " b", "<o b>"])
def test_part_encoder_with_added_tokens_that_look_like_words(tmp_path, added):
    tool = Tokenizer.from_file(BYTE_BPE)
    tool.add_tokens([added])
    tool.save(str(tmp_path / "own.json"))
    texts = ["a foo b", "foo, a", "go, foo", "x <o b> c", "a", ""]
    own = PartEncoder(str(tmp_path / "own.json"))
    assert own.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in tool.encode_batch(texts, add_special_tokens=False)]
    assert not own.direct


def test_part_encoder_takes_whole_columns():
    tool, r = Tokenizer.from_file(BYTE_BPE), np.random.default_rng(3)
    bits = ["a", "Word", "1", ",", "'s", "é", "<|endoftext|>", " ", " ", " ", "\n", "\n", "\t", "\r", "\0", "\u00a0", "\u2028"]
    texts = ["", None, "\n", " \n", "a.\nb c", "a\n", "\na", "a\r\nb", "a\n\nb", *("".join(r.choice(bits, n)) for n in r.integers(1, 9, 600))]
    expected = [tool.encode(t or "", add_special_tokens=False).ids for t in texts]
    for kept in (0, 900_000):
        own = PartEncoder(BYTE_BPE, kept)
        own.encode([t or "" for t in texts])  # shares what it keeps
        for some in (slice(None), slice(3, 60), slice(4, 5), slice(0, 0)):
            flat, sizes = own.encode_column(pa.array(["x", *texts], pa.string())[1:][some])
            assert [x.tolist() for x in np.split(flat, np.cumsum(sizes))[:-1]] == expected[some]


def test_part_encoder_looks_up_distinct_parts_and_lines_end_parts():
    tool, seen = PartEncoder(BYTE_BPE), []
    learn = tool.learn
    tool.learn = lambda parts: seen.append(parts) or learn(parts)
    tool.encode_column(pa.array(["one two.\nthree two", "four two.\nthree"]))
    assert seen == [{"two.", "two"}]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (12, 10), (20, 20), (None, 3)] + [(100 + k, 101 + k) for k in range(40)]
    found = dict(rows_of(components(spark.createDataFrame(edges, "a long, b long")), "node", "root"))
    assert found == {**dict.fromkeys(range(1, 5), 1), **dict.fromkeys((10, 11, 12), 10), 20: 20, **dict.fromkeys(range(100, 141), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ 1, 10: classifiers


@pytest.mark.parametrize("name, label, mod, rest, least", [("op1_quality", "quality", 3, 1, 0.5), ("op10_toxicity", "toxic", 4, 2, 0.3)])
def test_classifier_queries(spark, name, label, mod, rest, least):
    found = QUERIES[name](spark, SF).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(i for i, _ in documents(spark))
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == rest)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least)
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = [r["predicted"] == truth[r["doc_id"]] for r in found if r["doc_id"] in truth]
    assert np.mean(right) > 0.85


@pytest.mark.parametrize("operator, label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_at_the_edges(spark, odd_docs, no_docs, labels, no_labels, operator, label):
    learn = ~held_out("doc_id", 3, 1)
    found = operator.classify(odd_docs, labels, label, learn, keep=odd_docs.columns)
    assert found.columns == [*odd_docs.columns, "score"] and found.count() == odd_docs.count()
    assert found.where("score is null or isnan(score) or score < 0 or score > 1").count() == 0
    assert operator.classify(no_docs, labels, label, learn).count() == 0
    assert operator.classify(odd_docs, no_labels, label, learn).count() == odd_docs.count()


def test_discriminant_equals_dense(spark):
    r = np.random.default_rng(1)
    d = len(quality.NAMES)
    x, y = r.normal(size=(60, d)), r.integers(0, 2, 60)
    rows = [(row.tolist(), int(k)) for row, k in zip(x, y, strict=True)]
    model = quality.fit(spark.createDataFrame(rows, "features array<double>, y int"), "y", 0.1, 0.05)
    covs = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum((y == k).sum() * covs[k] for k in (0, 1)) / 60
    logs = []
    for k in (0, 1):
        c = 0.95 * covs[k] + 0.05 * pooled
        c = 0.9 * c + 0.1 * np.diag(np.diag(c)) + 1e-6 * np.eye(d)
        z = x - x[y == k].mean(0)
        logs.append(-0.5 * np.linalg.slogdet(c)[1] - 0.5 * (z * np.linalg.solve(c, z.T).T).sum(1) + np.log((y == k).mean()))
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-6)


# ------------------------------------------------------------------ 2, 4, 6: tokens


def test_huffman_query(spark):
    found = {r["doc_id"]: r for r in QUERIES["op2_huffman"](spark, SF).collect()}
    tool, start = Tokenizer.from_file(BYTE_BPE), 0
    for i, t in sorted(documents(spark)):
        ids = [*tool.encode(t, add_special_tokens=False).ids, 2]
        assert (found[i]["start"], found[i]["n_tokens"], found[i]["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)


def test_huffman_blocks_are_made_where_texts_are_encoded(spark, tmp_path):
    docs = spark.createDataFrame([(k, "a b " * 25_000) for k in range(5, 0, -1)] + [(None, None)], "doc_id long, text string")
    tokens = huffman.tokenized(docs, BYTE_BPE, 2, 1)
    rows = tokens.collect()
    assert [(r["part"], r["block"], r["doc_ids"]) for r in rows] == [(0, 0, [None, 1, 2, 3]), (0, 1, [4, 5])]
    assert all(len(r["ids"]) == 1 + 2 * sum(r["sizes"]) for r in rows)
    huffman.write_ids(tokens, str(tmp_path / "ids"), 1 << 16)
    assert [(r["doc_ids"], r["n_ids"]) for r in spark.read.parquet(str(tmp_path / "ids/blocks")).orderBy("block").collect()] == [(r["doc_ids"], sum(r["sizes"])) for r in rows]


def test_huffman_counts_ids_of_both_widths(spark):
    rows = [np.array(x, "<u4") for x in ([3, 3, 5], [70_000, 3], [], [5])]
    tokens = spark.createDataFrame([(bytearray(huffman._narrow(x)),) for x in rows], "ids binary")
    counts = huffman.id_counts(tokens, 80_000)
    assert {int(i): int(counts[i]) for i in np.flatnonzero(counts)} == {3: 3, 5: 2, 70_000: 1}


def test_huffman_codes():
    r = np.random.default_rng(2)
    counts = np.zeros(3000, np.int64)
    counts[r.permutation(3000)[:2000]] = (r.pareto(0.6, 2000) * 10 + 1).astype(np.int64)
    for longest in (11, 12, 16):
        lengths = huffman.code_lengths(counts, longest).astype(float)
        used = counts > 0
        assert lengths[used].max() <= longest and (2.0 ** -lengths[used]).sum() == 1 and not lengths[~used].any()
    coder = huffman.Coder(huffman.code_lengths(counts))
    for n in (0, 1, 63, 64, 65, 1000):
        ids = r.choice(np.flatnonzero(counts), n).astype("<u4")
        bits, steps = coder.encode(ids)
        assert (coder.decode(bits, steps, n) == ids).all()
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(5), 2)


def test_huffman_length_limit_is_optimal():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21])
    best = min(sum(c * x for c, x in zip(sorted(counts, reverse=True), sorted(s), strict=True)) for s in _lengths(8, 4))
    assert (huffman.code_lengths(counts, 4) * counts).sum() == best


def _lengths(n, longest, space=16):
    """All multisets of n code lengths that fill the space."""
    if n == 0:
        return [[]] if space == 0 else []
    out = []
    for x in range(1, longest + 1):
        if (size := 1 << (longest - x)) <= space:
            out += [[x, *rest] for rest in _lengths(n - 1, longest, space - size) if not rest or rest[0] >= x]
    return out


def test_tokens_at_the_edges(spark, odd_docs, no_docs):
    assert huffman.round_trip(no_docs, BYTE_BPE, 2).count() == 0
    found = huffman.round_trip(odd_docs, BYTE_BPE, 2, parts=3)
    assert found.count() == odd_docs.count()
    ends = sorted((r["start"], r["n_tokens"]) for r in found.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False))
    assert packing.pack_documents(no_docs, BYTE_BPE, 1).count() == 0
    packed = packing.pack_documents(odd_docs, BYTE_BPE, 1, window=64, keep=odd_docs.columns)
    assert packed.select(*odd_docs.columns).distinct().count() == odd_docs.distinct().count()
    assert bpe.encode_decode(no_docs, WORD_BPE).count() == 0
    tool = Tokenizer.from_file(WORD_BPE)
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.where("doc_id is not null").collect()}
    for r in bpe.encode_decode(odd_docs, WORD_BPE, with_ids=True).where("doc_id is not null").collect():
        ids = tool.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == " ".join(map(str, ids)) and r["decoded"] == tool.decode(ids, skip_special_tokens=False)


def test_bpe_query(spark):
    tool = Tokenizer.from_file(WORD_BPE)
    expected = []
    for i, t in documents(spark):
        ids = tool.encode(t, add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), tool.decode(ids, skip_special_tokens=False))]
        expected.append((i, len(ids), *sha))
    assert rows_of(QUERIES["op4_bpe"](spark, SF), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected, key=repr)


def test_bpe_equals_the_library_on_hard_words():
    texts = ["aaaa aaa aaaaa hahahahaha", "ΑΣ İI ẞ é ́x", "½ ² Ⅷ", "<|endoftext|>a<|startoftext|> <|endoftext", "I'LL they're 's", "1 22 a1b2", "🙂🙂 ​﻿", "x" * 500]
    tool = Tokenizer.from_file(WORD_BPE)
    for (n, ids, _), e in zip(bpe.WordBpe(WORD_BPE).texts(texts), tool.encode_batch(texts, add_special_tokens=False), strict=True):
        assert (n, ids.decode()) == (len(e.ids), " ".join(map(str, e.ids)))


def test_bpe_cuts_many_words_in_one_call():
    draw = np.random.default_rng(5)
    signs = list("aAbéÉßΣσİ'sll.,<|>19²½\n\t\r\x1c\x85\u2028\u0301\u3099か日한ᄀ\u1161\u200b🙂")
    texts = [" ".join("".join(draw.choice(signs, draw.integers(0, 9))) for _ in range(400)) for _ in range(20)]
    zeros = ["é\x00\u0301 b\x00É", "\u0301 \u0301é \x00"]
    tool, own = Tokenizer.from_file(WORD_BPE), bpe.WordBpe(WORD_BPE)
    calls, cut = [], own.cut
    own.cut = lambda x: calls.append(x) or cut(x)
    for some in (texts, zeros):
        for (n, ids, decoded), e in zip(own.texts(some), tool.encode_batch(some, add_special_tokens=False), strict=True):
            assert (n, ids.decode(), decoded.decode()) == (len(e.ids), " ".join(map(str, e.ids)), tool.decode(e.ids, skip_special_tokens=False))
        if some is texts:
            assert len(calls) <= 8


def test_packing_query(spark):
    found = QUERIES["op6_packing"](spark, SF).collect()
    tool = Tokenizer.from_file(BYTE_BPE)
    texts, pieces = dict(documents(spark)), {}
    for r in found:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(texts)
    for i, own in pieces.items():
        ids = [*tool.encode(texts[i], add_special_tokens=False).ids, 1]
        own.sort(key=lambda r: r["start"])
        assert [r["start"] for r in own] == np.cumsum([0] + [r["length"] for r in own])[:-1].tolist()
        assert sum(r["length"] for r in own) == len(ids)
        assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]]) for r in own)
    fills = {}
    for r in sorted(found, key=lambda r: r["offset"]):
        assert r["offset"] == fills.get(r["sequence_id"], 0)
        fills[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fills.values()) <= 2048 and sum(x < 2048 for x in fills.values()) <= 8


def test_packer_takes_the_least_sum_of_squares():
    r, window = np.random.default_rng(3), 20
    packer, counts = packing.SquaresPacker(window), Counter()
    for k in range(400):
        n = int(r.integers(1, window + 1))
        options = []
        for level in [0, *[h for h in counts if counts[h]]]:
            if level + n <= window:
                after = counts.copy()
                after[level] -= level > 0
                if level + n < window:
                    after[level + n] += 1
                options.append(sum(c * c for c in after.values()))
        packer.put(k, 0, n)
        counts = Counter({h: int(c) for h, c in enumerate(packer.counts) if c})
        assert sum(c * c for c in counts.values()) == min(options)


# ------------------------------------------------------------------ 3, 8: copies


def plain_fingerprint(text, width=3):
    w = words((text or "").encode().lower().decode())
    w = [x.lower() for x in w]
    grams = [b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(fps, radius):
    root = {i: i for i in fps}
    ids = sorted(fps)
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (fps[i] ^ fps[j]).bit_count() <= radius and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return root


def test_simhash_query(spark):
    docs = documents(spark)
    fps = {i: plain_fingerprint(t) for i, t in docs}
    root = plain_components(fps, 2)
    expected = sorted(((i, f"{fps[i]:016x}", root[i]) for i, _ in docs), key=repr)
    assert rows_of(QUERIES["op3_simhash"](spark, SF), "doc_id", "fingerprint", "component_id") == expected


@pytest.mark.parametrize("small", [1, 4, 128])
def test_links_in_large_buckets(spark, small):
    r = np.random.default_rng(4)
    fps = {int(r.integers(-(2**63), 2**63)) for _ in range(20)}
    for f in list(fps)[:5]:
        for _ in range(25):
            bits = r.integers(0, 63, 3)
            fps.add(f ^ sum(1 << int(b) for b in set(bits.tolist())))
    edges = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 2, small=small)
    assert all((a ^ b) & (2**64 - 1) and ((a ^ b) & (2**64 - 1)).bit_count() <= 2 * 2 for a, b in edges.collect())
    found = dict(rows_of(components(edges), "node", "root"))
    expected = plain_components({f: f & (2**64 - 1) for f in fps}, 2)
    groups = lambda root: {frozenset(f for f in fps if root.get(f, f) == x) for x in {root.get(f, f) for f in fps}}
    assert groups(found) == groups(expected)


@pytest.mark.parametrize("radius", [1, 2, 5])
def test_masks_cover(radius):
    r = np.random.default_rng(5)
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(300):
        flip = sum(1 << int(b) for b in r.choice(64, radius, replace=False))
        assert any(not m & flip for m in masks)


def test_simhash_at_the_edges(spark, odd_docs, no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.one_of_each(no_docs).count() == 0
    found = simhash.near_duplicates(odd_docs).collect()
    assert len(found) == odd_docs.count()
    assert {r["fingerprint"] for r in found if r["doc_id"] in (4, 5, 6, 14)} == {"0" * 16}
    assert {r["component_id"] for r in found if r["doc_id"] in (4, 5, 6, 14)} == {4}
    kept = simhash.one_of_each(odd_docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == odd_docs.columns and 1 in ids and 2 not in ids and ids.count(13) == 1 and ids.count(None) == 0


def plain_dedup(docs):
    first = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, t in docs:
        w = words(t)
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeats_query(spark):
    assert rows_of(QUERIES["op8_repeats"](spark, SF), "doc_id", "n_words", "n_removed", "kept_sha256") == plain_dedup(documents(spark))


def test_repeats_in_runs_and_shifts(spark):
    r = np.random.default_rng(6)
    base = [f"w{k}" for k in r.integers(0, 9, 200)]
    docs = [(1, " ".join(base)), (2, "z " + " ".join(base[50:63]) + " q"), (3, " ".join(base[60:72])), (4, "a " * 13), (5, "b " + "a " * 40 + "c"), (6, "a " * 12)]
    docs += [(7 + k, " ".join([f"x{k}"] + base[k * 5 : k * 5 + int(r.integers(10, 40))] + ["a"] * int(r.integers(1, 30)))) for k in range(25)]
    found = repeats.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    assert rows_of(found, "doc_id", "n_words", "n_removed", "kept_sha256") == plain_dedup(docs)


def test_repeats_at_the_edges(spark, odd_docs, no_docs):
    assert repeats.dedup(no_docs).count() == 0
    found = repeats.dedup(odd_docs, keep=odd_docs.columns, with_text=True)
    rows = {r["doc_id"]: r for r in found.collect() if r["doc_id"] is not None}
    assert found.count() == odd_docs.count() and found.columns[: len(odd_docs.columns)] == odd_docs.columns
    assert rows[2]["n_removed"] == rows[2]["n_words"] and rows[1]["n_removed"] == 0 and rows[5]["n_words"] == 0
    assert rows[3]["kept"] == "another story: at noon\nand home" and rows[5]["kept"] is None
    assert rows[10]["n_removed"] == 9000


# ------------------------------------------------------------------ 5: language model


def test_attention_query(spark):
    docs = documents(spark)
    train = [[w.lower() for w in words(t)] for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for own in train for w in own)
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    for r in QUERIES["op5_attention"](spark, SF).collect():
        own = [w.lower() for w in words(dict(docs)[r["doc_id"]])]
        c = [counts[w] for w in own] + [len(train)]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(c), sum(x > 0 for x in c), n)
        assert math.isclose(r["base_score"], sum(math.log10((x + 1) / (n + v + 1)) for x in c), rel_tol=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) and r["score"] < 0


def test_attention_is_a_distribution_and_causal():
    alphabet = attention.Alphabet(np.arange(1000))
    params = attention.start_params(alphabet.shares, 5)
    for k in ("embed", "out", "lag"):
        params[k] = params[k] + np.random.default_rng(8).normal(size=params[k].shape).astype(np.float32) * 0.3
    text = np.random.default_rng(9).integers(0, 1000, 70)
    share = np.bincount(alphabet.symbol, 10**alphabet.inside, minlength=attention.SYMBOLS)
    assert np.allclose(share[:-1], 1)
    x, y, _ = attention.windows_of(np.append(alphabet.symbol[text], attention.END), np.array([71]))
    assert (y != attention.PAD).sum() == 71
    total = sum(10 ** attention.log_scores(params, x, np.where(y == attention.PAD, y, s)) for s in range(attention.SYMBOLS))
    assert np.allclose(total[y != attention.PAD], 1, atol=1e-4)
    one = attention.score_ids(params, alphabet, text, np.array([71]))
    for cut in (1, 24, 25, 69):
        assert np.allclose(attention.score_ids(params, alphabet, text[:cut], np.array([cut + 1]))[:cut], one[:cut], atol=1e-5)


def test_attention_gradients():
    r = np.random.default_rng(10)
    p = {k: v.astype(float) for k, v in attention.start_params(np.ones(attention.SYMBOLS), 3).items()}
    x, y = r.integers(0, attention.SYMBOLS, (4, attention.SPAN)), r.integers(0, attention.SYMBOLS, (4, attention.SCORED))
    x[0, :5], y[1, 4:] = attention.PAD, attention.PAD
    g = attention.gradients(p, x, y)

    def loss():
        logit = attention._attend(p, x)[-1] @ p["out"] + p["out0"]
        t = y.ravel()
        got = logit[np.arange(len(t)), np.minimum(t, attention.END)] - np.log(np.exp(logit).sum(1))
        return -got[t != attention.PAD].mean()

    for k in p:
        i = int(np.abs(g[k]).argmax())
        flat, step = p[k].reshape(-1), 1e-5
        old = flat[i]
        flat[i] = old + step
        up = loss()
        flat[i] = old - step
        down = loss()
        flat[i] = old
        assert math.isclose(np.asarray(g[k]).reshape(-1)[i], (up - down) / (2 * step), rel_tol=1e-3, abs_tol=1e-7), k


def test_attention_reads_and_predicts_every_id():
    """Ids that share a symbol differ as inputs and as targets, and all ids together have probability one."""
    r = np.random.default_rng(8)
    alphabet = attention.Alphabet(np.arange(900)[::-1])
    p = attention.start_params(alphabet.shares, 5) | {k: v + 0.5 * r.normal(size=v.shape).astype(np.float32) for k, v in alphabet.start.items()}
    a, b = np.flatnonzero(alphabet.symbol == alphabet.symbol[850])[:2]
    one, other = (attention.score_ids(p, alphabet, np.array([3, first, 4, 5]), np.array([5])) for first in (a, b))
    assert abs(one[2:] - other[2:]).min() > 1e-6
    each = [attention.score_ids(p, alphabet, np.array([3, a, i]), np.array([4]))[2] for i in range(900)]
    end = attention.score_ids(p, alphabet, np.array([3, a]), np.array([3]))[2]
    held = np.bincount(alphabet.symbol, minlength=attention.SYMBOLS) > 0
    held[attention.END] = True
    assert held.all() and abs((10 ** np.array(each)).sum() + 10**end - 1) < 1e-4
    # Against numbers: the loss of codes, by single entries of the new weights.
    p = {k: v.astype(float) for k, v in p.items()}
    x, y = (alphabet.code[r.integers(0, 900, (3, n))] for n in (attention.SPAN, attention.SCORED))
    x[0, :5], y[1, 4:] = attention.PAD, attention.PAD
    g = attention.gradients(p, x, y, alphabet)

    def loss(name, where, by):
        q = p | {name: p[name].copy()}
        q[name][where] += by
        return -attention.log_scores(q, x, y, alphabet=alphabet)[y != attention.PAD].mean() * np.log(10)

    def slope(name, where, by=2e-2):
        return (loss(name, where, by) - loss(name, where, -by)) / (2 * by)

    codes, d = g["own"]
    first, end, d1, d0 = g["pick"][0]
    row = int(np.argmax(abs(d).sum(1)))
    for j in range(3):
        assert np.isclose(slope("own", (codes[row] - attention.FIRST_SHARED, j)), d[row, j], rtol=0.1, atol=2e-4)
        assert np.isclose(slope("pick", (first + j % (end - first), j)), d1[j % (end - first), j], rtol=0.1, atol=2e-4)
    assert np.isclose(slope("pick0", first), d0[0], rtol=0.1, atol=2e-4)
    assert np.isclose(slope("embed", (alphabet.symbol_of[codes[row]], 0)), g["embed"][alphabet.symbol_of[codes[row]], 0], rtol=0.1, atol=2e-4)


def test_attention_at_the_edges(spark, odd_docs, no_docs):
    assert attention.score_documents(no_docs, 7, 2, RANKS, public_tokenizers.PATTERN).count() == 0
    found = attention.score_documents(odd_docs, 7, 2, RANKS, public_tokenizers.PATTERN)
    assert found.count() == odd_docs.count()
    assert found.where("score is null or isnan(score) or score >= 0 or base_score is null").count() == 0
    assert {r["n_tokens"] for r in found.where("doc_id in (4, 5, 6, 14)").collect()} == {1}
    held = attention.score_documents(odd_docs.where("doc_id = 12"), 1, 0, RANKS, public_tokenizers.PATTERN).head()
    assert (held["held_out"], held["train_tokens"], held["n_known"]) == (True, 0, 0) and held["score"] < 0


def test_attention_learns_from_all_windows(spark):
    """Every id of every text is a target once, in one of the rounds."""
    texts = [f"text {k} " + "some more words of it " * (k % 40) for k in range(300)] + ["", None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    tool = attention.subwords(RANKS, public_tokenizers.PATTERN)
    ids = [len(b"".join(tool.words(attention.words_lower((t or "").encode())))) // 2 + 1 for t in texts]
    alphabet = attention.Alphabet(np.arange(tool.size))
    turns = [attention.part_of_round(docs, turn, 6).collect() for turn in range(6)]
    assert sorted((r["text"] for own in turns for r in own), key=repr) == sorted(texts, key=repr)
    targets = 0
    for own in turns:
        for _, y in attention.learning_windows([(r["text"] or "").encode() for r in own], alphabet, tool):
            targets += int((y != attention.PAD).sum())
    assert targets == sum(ids)


# ------------------------------------------------------------------ 7: outliers


def plain_statistics(t):
    w = [x.decode() for x in words(t)]
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)


def test_outliers_query(spark):
    found = {r["doc_id"]: r for r in QUERIES["op7_outliers"](spark, SF).collect()}
    for i, t in documents(spark):
        r, expected = found[i], plain_statistics(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
        assert r["base_failed"] == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
        assert not (r["base_failed"] and r["kept"])


def test_outliers_run_no_python(spark):
    text = QUERIES["op7_outliers"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", text)


def test_estimates_equal_dense_steps(spark):
    r = np.random.default_rng(11)
    x = np.vstack([r.normal(size=(400, 5)), 8 + r.normal(size=(60, 5))])
    rows = [(*map(float, row),) for row in x]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in outliers.X))
    got = outliers.estimates(df, F.array(F.lit("g"))).head()
    floors = np.array(list(outliers.FLOORS.values()))
    scale = 0.75 / outliers.chi_square(outliers.chi_square_at(0.75, 5), 7)
    centre = np.median(x, 0)
    d = (((x - centre) / (1.4826 * np.median(np.abs(x - centre), 0) + floors)) ** 2).sum(1)
    for _ in range(outliers.STEPS):
        near = x[d <= np.quantile(d, 0.75, method="inverted_cdf")]
        centre, cov = near.mean(0), scale * np.cov(near.T, bias=True) + np.diag(floors**2)
        z = x - centre
        d = (z * np.linalg.solve(cov, z.T).T).sum(1)
    assert np.allclose([got[f"m{i}"] for i in range(5)], centre, atol=0.05)
    low = np.array([[got[f"l{i}{j}"] if j <= i else 0 for j in range(5)] for i in range(5)])
    assert np.allclose(low @ low.T, cov, atol=0.1)


def test_shrunk_estimates_equal_dense_ones(spark):
    """Mixtures of a group's estimate and its wider group's, by rows; without a wider one the estimate stays."""
    r = np.random.default_rng(22)
    sets = {"s\ta\t1": r.normal(size=(40, 5)), "s\ta\t2": 2 + r.normal(size=(900, 5)), "l\ta": 1 + 2 * r.normal(size=(940, 5))}
    rows = []
    for key, x in sets.items():
        low = np.linalg.cholesky(np.cov(x.T))
        rows.append((key, "l\ta" if key[0] == "s" else "none", len(x), *map(float, x.mean(0)), *[float(low[i, j]) for i in range(5) for j in range(i + 1)]))
    names = [f"m{i} double" for i in range(5)] + [f"l{i}{j} double" for i in range(5) for j in range(i + 1)]
    df = spark.createDataFrame(rows, "key string, parent string, rows long, " + ", ".join(names))
    got = {g["key"]: g for g in outliers.shrunk(df, df.where("key like 'l%'")).collect()}
    wide = sets["l\ta"]
    for key, x in sets.items():
        w = 1.0 if key[0] == "l" else len(x) / (len(x) + outliers.PRIOR_ROWS)
        apart = x.mean(0) - wide.mean(0)
        assert np.allclose([got[key][f"m{i}"] for i in range(5)], w * x.mean(0) + (1 - w) * wide.mean(0))
        cov = w * np.cov(x.T) + (1 - w) * np.cov(wide.T) + w * (1 - w) * np.outer(apart, apart)
        low = np.array([[got[key][f"l{i}{j}"] if j <= i else 0 for j in range(5)] for i in range(5)])
        assert np.allclose(low @ low.T, cov)


@pytest.mark.parametrize("kind", ["lines", "symbols", "repeats"])
def test_outliers_of_one_statistic(spark, kind):
    r = np.random.default_rng(14)

    def text(k):
        lines = [" ".join(f"w{x}" for x in r.integers(0, 10**6, 8)) for _ in range(20 + k % 9)]
        if k < 5 and kind == "lines":
            lines += ["ab cd"] * 10
        if k < 5 and kind == "symbols":
            lines[3:9] = [f"{x} ### $$$" for x in lines[3:9]]
        if k < 5 and kind == "repeats":
            lines += [f"{x} {k}" for k, x in enumerate(lines[:5])]
        return "\n".join(lines)

    rows = [(k, text(k), "en", "src0") for k in range(300)]
    found = {x["doc_id"]: x for x in outliers.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(found[k]["kept"] or found[k]["base_failed"] for k in range(5))
    assert sum(x["kept"] for x in found.values()) >= 280


def test_outliers_at_the_edges(spark, odd_docs, no_docs):
    assert outliers.verdicts(no_docs).count() == 0
    found = outliers.verdicts(odd_docs, keep=odd_docs.columns)
    assert found.count() == odd_docs.count() and found.where("kept is null or base_failed is null").count() == 0
    assert not any(r["kept"] for r in found.where("doc_id in (4, 5, 6, 14)").collect())


# ------------------------------------------------------------------ 9: neighbours


def plain_neighbours(ids, x, asked, k=10):
    out = {}
    for q in asked:
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[q] = [(ids[j], d[j]) for j in order]
    return out


def test_neighbours_recall(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = [r["vec_id"] for r in table], np.array([r["embedding"] for r in table], float)
    expected = plain_neighbours(ids, x, [i for i in ids if i % 100 == 0])
    found = {}
    for r in QUERIES["op9_multiindex"](spark, SF).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(found) == set(expected)
    hits = [len({i for i, _ in found[q]} & {i for i, _ in own}) / len(own) for q, own in expected.items()]
    assert np.mean(hits) >= 0.9
    exact = {q: dict(plain_neighbours(ids, x, [q], len(ids))[q]) for q in expected}
    assert all(math.isclose(s, exact[q][i], rel_tol=1e-12) for q, own in found.items() for i, s in own)


def test_neighbours_at_the_edges(spark):
    rows = [(k, [1.0, 2.0, float(k % 3), 0.5], "x") for k in range(0, 40)] + [(100, None, None), (101, [0.0] * 4, None), (102, [1.0, float("nan"), 0.0, 0.0], None)]
    rows += [(103, [1.0, None, 0.0, 0.0], None), (104, [float("inf"), 0.0, 0.0, 0.0], None), (None, [1.0, 1.0, 1.0, 1.0], None), (200, [5.0, 5.0, 5.0, 5.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, q string").repartition(3)
    found = multiindex.search(df, df.where("vec_id % 100 = 0"), visited=1.0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in found] == [(0, 3 * k) for k in range(1, 11)] + [(200, 2 + 3 * k) for k in range(10)]
    empty = df.where("false")
    assert multiindex.search(empty, empty).count() == 0 and multiindex.search(df, empty).count() == 0
    few = multiindex.search(df.where("vec_id in (0, 200)"), df.where("vec_id = 0")).collect()
    assert [(r["query_id"], r["vec_id"], r["rank"]) for r in few] == [(0, 200, 1)]


def test_neighbours_of_clustered_vectors(spark):
    """The share that is looked at follows the data: clusters need little of the index. Repeated rows are entries each."""
    r = np.random.default_rng(21)
    x = (r.normal(size=(60, 8)) * 20)[r.integers(0, 60, 6000)] + r.normal(size=(6000, 8))
    rows = [(k, v) for k, v in enumerate(x.tolist())] + [(7, x[7].tolist()), (6001, x[0].tolist()), (6001, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    seen, keep = [], multiindex.needed_shares
    multiindex.needed_shares = lambda *a: seen.append(keep(*a)) or seen[-1]
    try:
        found = {}
        for row in multiindex.search(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
            found.setdefault(row["query_id"], []).append((row["score"], row["vec_id"]))
    finally:
        multiindex.needed_shares = keep
    assert np.quantile(seen[0], multiindex.RECALL) < 0.1 and len(found) == 60
    table = [(i, np.array(v)) for i, v in rows]
    hits = []
    for q, own in found.items():
        true = sorted((float(np.sqrt(((v - x[q]) ** 2).sum())), i) for i, v in table if i != q)[:10]
        hits.append(len({i for _, i in own} & {i for _, i in true}) / len({i for _, i in true}))
    assert np.mean(hits) >= 0.9 and [i for _, i in found[0]][:2] == [6001, 6001]


def test_ragged_vectors_are_refused(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0, 4.0, 5.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="several lengths"):
        multiindex.search(df, df)
    with pytest.raises(ValueError, match="several lengths"):
        multiindex.search(df.where("vec_id = 0"), df.where("vec_id = 1"))


def test_traverse_in_order():
    r = np.random.default_rng(12)
    a, b, sizes = r.random(9), r.random(7), r.integers(0, 3, 63)
    cells = multiindex.traverse(a, b, sizes, 10**6)
    sums = [a[c // 7] + b[c % 7] for c in cells]
    assert sums == sorted(sums) and sorted(cells) == np.flatnonzero(sizes).tolist()
