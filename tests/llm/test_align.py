import hashlib
import os
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F

from storelens.llm import align
from storelens.llm.mph import PerfectHash

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokens():
    """The libraries' own tokens of a whole text, as (id, bytes)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    of = align.byte_alphabet()

    def both(text):
        x = [(i, bytes(of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        return x, y
    return both


def brute(tokens, rows):
    """The contract, token by token."""
    cut = []
    for _, text in rows:
        groups = []
        x, y = tokens(text) if text else ([], [])
        if text and b"".join(t for _, t in x) == b"".join(t for _, t in y) == (" " + text).encode():
            ends = [[sum(len(t) for _, t in z[: i + 1]) for i in range(len(z))] for z in (x, y)]
            common, lo = sorted(set(ends[0]) & set(ends[1])), 0
            for hi in common:
                groups.append(tuple([i for (i, _), e in zip(z, es) if lo < e <= hi] for z, es in zip((x, y), ends)))
                lo = hi
        cut.append(groups)
    links = [[(a, b) for xs, ys in g for a in xs for b in ys] for g in cut]
    count = Counter(p for ls in links for p in set(ls))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (i, _), g, ls in zip(rows, cut, links):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(ls), sum(count[p] == best[p[0]] for p in ls),
                    sum(count[p] for p in ls), hashlib.sha256(said.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


ODD = ["", None, " ", "  ", "a", "a ", " a", "a  b   c    d ", "\n", "a\n b \n\n  c\t d", "x y z　q \x85 r", "naïve café Ωμέγα", "日本語のテキスト と 中文",
       "🙂🙂 👩‍👩‍👧", "literal ▁ here", "<|endoftext|> <s> </s> <unk> <0x0A>", "\x00 \x07\x1c \x1f a", "it's we'll DON'T 'S", "1234567 3.14159 !!! ??? ....", "é é ﬁ ﬁ",
       "a" * 300, "=" * 77 + " " * 40 + "end", "\r\n\r\n x", "​ z‍ ", "﻿bom �"]


def random_texts(n, seed):
    rng, parts = random.Random(seed), ["the", "The", " ", "  ", "\n", "é", "中", "'s", "12", "running", "un", "🙂", ".", ",", "-", "\t", "ß", "ing", "x"]
    return ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 30))) for _ in range(n)]


def report(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = align.report(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_report_equals_brute_force(spark, tokens, monkeypatch):
    monkeypatch.setattr(align, "SHARD_ROWS", 7)  # many shards, several levels of the trees
    monkeypatch.setattr(align, "FAN_IN", 3)
    monkeypatch.setattr(align, "WIDE", 5)
    rows = [*enumerate([*ODD, *random_texts(120, 3)]), (3, " "), (7, "a  b   c    d "), (7, "a  b   c    d "), (None, "the end"), (None, None)]
    assert report(spark, rows) == brute(tokens, rows)


def test_given_table_equals_brute_force(spark, tokens):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("length(text) < 3000")
    rows = [tuple(r) for r in docs.collect()]
    assert report(spark, rows) == brute(tokens, rows)


def test_stretches_of_random_texts(tokens):
    with open(A, "rb") as a, open(B, "rb") as b:
        made = align.Aligner(a.read(), b.read(), True)
    texts = random_texts(4000, 9)
    at, ptr = made.stretches(texts)
    for i, text in enumerate(texts):
        x, y = tokens(text)
        said = ";".join(made.said[k] for k in at[ptr[i]:ptr[i + 1]])
        if b"".join(t for _, t in y) == (" " + text).encode():
            assert [int(t) for g in said.split(";") for t in g.split("|")[0].split(",")] == [i for i, _ in x], repr(text)
            assert [int(t) for g in said.split(";") for t in g.split("|")[1].split(",")] == [i for i, _ in y], repr(text)


def test_odd_tables(spark, odd_documents, no_documents):
    assert align.report(no_documents, A, B).count() == 0
    clash = odd_documents.withColumn("groups", F.lit(1)).withColumn("keys", F.lit(2)).withColumn("shard", F.lit("s")).withColumn("row", F.lit(3))
    out = align.align(clash, A, B)
    assert out.columns == [c for c in clash.columns if c != "groups"] + align.NEW
    assert out.count() == clash.count()
    assert {r["text"] for r in out.collect()} == {r["text"] for r in clash.collect()}


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**32, n).astype("<u4"))
    made = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
    assert sorted(made.index(keys).tolist()) == list(range(len(keys)))
