import __spark_entry__ as E


def test_registry_consistent():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 150


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "churned" in df.columns
