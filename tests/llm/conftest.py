import os

import duckdb
import pytest

SF001 = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="session")
def same_as_sql():
    """Compare a query's rows with DuckDB SQL over registered frames or a table folder."""
    def compare(got, sql, tables=None, sf_dir=None):
        con = duckdb.connect()
        for name, frame in (tables or {}).items():
            con.register(name, frame)
        if sf_dir:
            for name in ("documents", "conversations"):
                con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, name)}.parquet')")
        want, cols = con.sql(sql), sorted(got.columns)
        assert cols == sorted(want.columns)
        assert plain(got.select(cols).collect()) == plain(want.select(*cols).fetchall())
    return compare


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a long text, a clashing extra column."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [
        (1, "Hello world again and again\nshared line of text\nshort", "en", "a"),
        (2, "hello WORLD again and again\nSHARED line of text  \nshort", "en", "a"),
        (3, "hello world again and again\nshared line of text\nshort", None, None),
        (3, "hello world again and again\nshared line of text\nshort", None, None),
        (4, "", "en", "b"), (5, None, "en", "b"), (6, " \t\n ", None, "b"), (None, "a text without an id\nshared line of text", "en", None),
        (None, None, None, None), (7, long, "en", "c"), (8, long.upper(), "en", "c"), (9, long + " one more word", "en", "c"),
        (10, "one", "de", "é"), (10, "one two", "de", "é"), (11, "🙂 émoji\n\n\nshared line of text\nshared line of text", "fr", "😀"),
    ]
    df = spark.createDataFrame([(*r, len(r[1] or ""), "x", "y") for r in rows],
                               "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, node string")
    return df.repartition(4)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")
