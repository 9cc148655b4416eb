"""Lines that the small tables don't have."""

import duckdb

from colloquy import plans


def test_branch_without_consequence(spark, tmp_path):
    """A branch whose arrow has nothing behind it is a branch with an empty text, as in SQL."""
    texts = [(1, "Ask, the of them. Say it, the end of it"), (2, ", the of , the  of x"), (3, "a, the b. c")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cursor = duck.execute(plans.ORACLE_SQL["d24_instruction_items"])
    names = [d[0] for d in cursor.description]
    want = sorted(map(str, cursor.fetchall()))
    assert sorted(str(tuple(r)) for r in plans.QUERIES["d24_instruction_items"](spark, str(tmp_path)).select(*names).collect()) == want
    assert sum("'branch', 0, 'the'" in w for w in want) >= 2
