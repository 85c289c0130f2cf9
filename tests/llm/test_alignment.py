"""Cross-tokenizer alignment against plain loops over the two libraries' tokens."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from factorloom.llm import alignment
from factorloom.llm.queries import QUERIES
from factorloom.llm.tokens import BYTE_CHARS, PartEncoder

SF = "/root/testdata/sf0.001"
BYTE_BPE, PIECE_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a  b", "", "  ", " a", "a ", "\ta\nb", "a\x00b", "a▁b", "<0x41> <s> <|endoftext|> x", "\xa0x　y", "🙂 🙂🙂 a🙂", "日本 語", "é ﬁ Ａ́", "x" * 400, "it's 'they're' 12 345"]


def plain_rows(rows):
    """What align_documents returns, token by token."""
    a_tool, b_tool = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    a_tool.encode_special_tokens = True
    byte_of = {c: b for b, c in BYTE_CHARS.items()}

    def ends(parts):
        return np.cumsum([len(p) for p in parts]).tolist()

    out, counts = [], Counter()
    for doc, text in rows:
        a = a_tool.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = b_tool.encode(text) if text else []
        a_bytes = [bytes(byte_of[c] for c in a_tool.id_to_token(i)) for i in a]
        names = [b_tool.id_to_piece(i) for i in b]
        b_bytes = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in names]
        whole = f" {text}".encode() if text else b""
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            a, b, a_bytes, b_bytes = [], [], [], []
        a_ends, b_ends = ends(a_bytes), ends(b_bytes)
        common = sorted(set(a_ends) & set(b_ends))
        groups, i, j = [], 0, 0
        for end in common:
            x, y = a_ends.index(end, i) + 1, b_ends.index(end, j) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        links, j = [], 0
        for k, end in enumerate(a_ends):
            start = a_ends[k - 1] if k else 0
            while j and (b_ends[j - 1] > start):
                j -= 1
            while j < len(b) and (b_ends[j - 1] if j else 0) < end:
                if b_ends[j] > start:
                    links.append((a[k], b[j]))
                j += 1
        counts.update(set(links))
        out.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    return sorted(
        ((doc, n_a, n_b, n, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), sha) for doc, n_a, n_b, n, links, sha in out),
        key=repr,
    )


def test_encoders_equal_the_libraries():
    b_tool = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    a_tool = Tokenizer.from_file(BYTE_BPE)
    a_tool.encode_special_tokens = True
    r = np.random.default_rng(3)
    texts = ODD + ["".join(r.choice(list("ab \n\té🙂▁日.,'1"), 30)) for _ in range(300)]
    for kept in (0, 5, 10_000):
        own = alignment.PieceEncoder(PIECE_BPE, kept)
        assert own.by_parts and own.encode(texts * 2) == [np.array(x, "<u4").tobytes() for x in b_tool.encode(texts * 2)]
        ids = [np.array(a_tool.encode(" " + t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert PartEncoder(BYTE_BPE, kept, plain=True).encode([" " + t for t in texts]) == ids


def test_alignment_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = sorted((tuple(r) for r in QUERIES["op11_alignment"](spark, SF).collect()), key=repr)
    assert found == plain_rows(rows)


@pytest.mark.parametrize("broadcast", [True, False])
def test_alignment_at_the_edges(spark, odd_docs, no_docs, broadcast):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()] + [(100 + k, t) for k, t in enumerate(ODD)]
    docs = odd_docs.select("doc_id", "text", "fp").unionByName(spark.createDataFrame([(100 + k, t, "x") for k, t in enumerate(ODD)], "doc_id long, text string, fp string"))
    if not broadcast:
        spark.conf.set("spark.factorloom.broadcastBytes", "1")
    try:
        found = [tuple(r) for r in alignment.align_documents(docs, BYTE_BPE, PIECE_BPE, kept_pairs=20).collect()]
        none = alignment.align_documents(no_docs, BYTE_BPE, PIECE_BPE).count()
    finally:
        spark.conf.unset("spark.factorloom.broadcastBytes")
    assert sorted(found, key=repr) == plain_rows(rows) and none == 0
