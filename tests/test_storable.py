"""Results of registered queries can be written as tables."""

import __spark_entry__ as contract
from tests.compare import duck

FOLDER = "/root/testdata/sf0.001"


def test_item_features_can_be_written(spark, tmp_path):
    rows = contract.queries()["f26_item_features"](spark, FOLDER)
    rows.write.parquet(str(tmp_path / "out"))
    con = duck(FOLDER)
    con.execute("CREATE TABLE want AS " + contract.oracle_sql()["f26_item_features"])
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(got.columns) == sorted(d[0] for d in con.execute("SELECT * FROM want").description)
    names = ", ".join(got.columns)
    want = {tuple(map(str, r)) for r in con.execute(f"SELECT {names} FROM want").fetchall()}
    assert {tuple(map(str, r)) for r in got.collect()} == want
