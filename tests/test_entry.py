import __spark_entry__


def test_sql_is_text_of_registered_queries():
    sql = __spark_entry__.oracle_sql()
    assert sql and all(isinstance(x, str) for x in sql.values())
    assert set(sql) <= set(__spark_entry__.queries())
