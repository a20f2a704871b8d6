import pytest

from storelens.llm import exact_dedup, line_dedup, mixing
from storelens.llm.common import Run, scratch_path
from storelens.llm.queries import ORACLE, QUERIES

SF001 = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op3_line_dedup", "op8_source_mixing", "op9_exact_dedup"])
def test_equals_sql_on_whole_tables(spark, same_as_sql, name):
    same_as_sql(QUERIES[name](spark, SF001), ORACLE[name], sf_dir=SF001)


def test_exact_dedup_odd_rows(odd_documents, no_documents, same_as_sql):
    for docs in (odd_documents, no_documents):
        same_as_sql(exact_dedup.decide(docs), exact_dedup.ORACLE, {"documents": docs.toArrow()})
    kept = exact_dedup.drop_copies(odd_documents)
    assert kept.columns == odd_documents.columns
    texts = [(r.text or "").lower() for r in kept.collect()]
    assert len(texts) == len(set(texts))


def test_exact_dedup_batches_agree_and_index_persists(spark, odd_documents):
    runs = [sorted(map(str, exact_dedup.decide(odd_documents, batches=b, buckets=3).collect())) for b in (1, 2, 5)]
    assert runs[0] == runs[1] == runs[2]
    path = scratch_path(spark, "index-test")
    index = exact_dedup.DigestIndex.create(spark, path, 4)
    batch = spark.createDataFrame([(5, b"a"), (4, b"a"), (3, b"b")], "doc_id bigint, digest binary")
    index.add(batch)
    again = exact_dedup.DigestIndex.open(spark, path, 4)
    again.add(spark.createDataFrame([(2, b"b"), (1, b"c")], "doc_id bigint, digest binary"))
    assert {(bytes(r.digest), r.keep_id, r.group_size) for r in again.groups().collect()} == {(b"a", 5, 2), (b"b", 3, 2), (b"c", 1, 1)}


def test_index_side_of_the_anti_join_is_not_shuffled(spark):
    rows = spark.createDataFrame([(i, bytes([i])) for i in range(50)], "n int, key binary")
    run = Run.write(rows, scratch_path(spark, "run-test"), "key", 8)
    plan = rows.join(run.frame().hint("merge"), "key", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_line_dedup_odd_rows(odd_documents, no_documents, same_as_sql):
    from pyspark.sql import functions as F
    for docs in (odd_documents, no_documents):
        out = line_dedup.dedup_lines(docs)
        assert out.columns == [*docs.columns, "kept_text", "n_lines", "n_dropped"]
        same_as_sql(out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")), line_dedup.ORACLE,
                    {"documents": docs.toArrow()})


def test_line_dedup_compaction_does_not_change_results(spark, odd_documents):
    runs = [sorted(str(r) for r in line_dedup.dedup_lines(odd_documents, batches=b, fanout=f).select("doc_id", "n_dropped", "kept_text").collect())
            for b, f in ((1, 2), (5, 2), (4, 9))]
    assert runs[0] == runs[1] == runs[2]
    levels = line_dedup.LineRuns(spark, scratch_path(spark, "levels-test"), 2, fanout=2)
    for i in range(4):
        levels.add(spark.createDataFrame([(i, bytes([i]))], "doc_id bigint, key binary"))
    assert [len(x) for x in levels.levels] == [0, 0, 1] and levels.runs()[0].frame().count() == 4


def test_mixing_odd_rows(odd_documents, no_documents, same_as_sql):
    for docs in (odd_documents, no_documents):
        same_as_sql(mixing.amounts(docs), mixing.ORACLE, {"documents": docs.toArrow()})
    assert mixing.mix(odd_documents).columns == odd_documents.columns


def test_mixing_meets_targets_and_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.amounts(docs).toPandas()
    assert got.equals(mixing.amounts(docs).toPandas().reindex(got.index)) or sorted(got.taken) == sorted(mixing.amounts(docs).toPandas().taken)
    assert set(got.copies) <= {0, 1, 2}
    src = docs.select("doc_id", "source").toPandas().merge(got, on="doc_id").groupby("source")
    error = (src.taken.sum() - src.target.first()).abs()
    assert (error <= src["size"].max()).all()
    assert abs(src.target.first().sum() - 1.5 * got["size"].sum()) < 1e-6 * got["size"].sum()
    assert mixing.mix(docs).count() == got.copies.sum()


def test_mixing_buckets_do_not_change_the_draw(odd_documents, monkeypatch):
    docs = odd_documents.sparkSession.read.parquet(f"{SF001}/documents.parquet")
    one = sorted(map(str, mixing.amounts(docs).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    assert one == sorted(map(str, mixing.amounts(docs).collect()))


def test_ids_from_end_to_end_of_64_bits(spark):
    """Hash ids: their range is wider than 63 bits."""
    rows = [(-2**63, "a shared line of text\nown one"), (2**63 - 1, "A SHARED line of text\nown two"), (0, "a shared line of text\nown one"), (-5, "other"), (2**62, "OTHER")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.decide(docs).collect()}
    assert kept == {-2**63: (0, False), 0: (0, True), 2**63 - 1: (2**63 - 1, True), -5: (2**62, False), 2**62: (2**62, True)}
    lines = {r["doc_id"]: r["kept_text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert lines == {-2**63: "a shared line of text\nown one", 2**63 - 1: "own two", 0: "own one", -5: "other", 2**62: "OTHER"}
