import duckdb

from quire.plans import registry


def test_first_uses_are_those_of_the_sql(spark, tmp_path):
    """Conversations whose number begins with another's: 1, 121 and 1001 show one image, 20 and 100, 10 and 130 others."""
    uses = [(c, t) for c in (1, 121, 1001, 10, 130, 20, 100, 999, 9, 12) for t in (3, 4, 9)]
    spark.createDataFrame([(c, t, "x") for c, t in uses], "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame([(k,) for k in range(1, 40)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    for name in ("conversations", "supplier"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    theirs = con.sql(registry.oracle_sql()["used_images"]).fetchall()
    ours = registry.queries()["used_images"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, ours)) == sorted(theirs) and len(ours) == 6
