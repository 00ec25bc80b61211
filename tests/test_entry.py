import __spark_entry__


def test_names():
    queries, oracle = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 40


def test_flagship(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and rows[0].asDict().keys() == {"cluster_id", "template", "template_typed", "n_lines"}
    assert sum(r.n_lines for r in rows) == 1000
