import os
import runpy

import corpus_pipeline
from pyspark.sql import functions as F

from storelens.llm import bpe

SF001 = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    names = docs.columns
    step = {}
    for name, stage in corpus_pipeline.STAGES:
        step[name] = docs = stage(spark, docs, SF001).cache()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "ngram_jaccard_join", "source_mixing", "byte_bpe"]
    assert all(step[n].columns == names for n in list(step)[:-1])
    text = {n: {r.doc_id: r.text for r in step[n].collect()} for n in list(step)[:-1]}
    # exact dedup: the largest id of equal texts among what the rules kept
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    want = {}
    for i, t in text["quality_rules"].items():
        want[lower(t)] = max(i, want.get(lower(t), -1))
    assert set(text["exact_dedup"]) == set(want.values())
    # near-duplicates: one of each group, by holding all pairs against each other
    brute_force = runpy.run_path(os.path.join(os.path.dirname(__file__), "test_ngram_join.py"))["brute_force"]
    rows = list(text["exact_dedup"].items())
    assert set(text["ngram_jaccard_join"]) == {i for i, _, c in brute_force(rows, 5, 0.8) if i == c}
    # mixing takes a document up to twice, tokens follow each copy and give back its text
    copies = step["source_mixing"].groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert copies <= 2 and step["byte_bpe"].count() == step["source_mixing"].count()
    import public_tokenizers
    back = bpe.decode(step["byte_bpe"], public_tokenizers.path(corpus_pipeline.RANKS)).collect()
    assert all(r.decoded == text["source_mixing"][r.doc_id] for r in back)


def test_registered_with_the_entry():
    import __spark_entry__ as E
    names = E.queries()
    assert "pipeline" in names and {f"op{n}_" for n in range(1, 14)} == {x.split("_")[0] + "_" for x in names if x.startswith("op") and x[2].isdigit()}
    assert "pipeline" not in E.oracle_sql()
