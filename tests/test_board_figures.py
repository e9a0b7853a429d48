import random

from tallyforge import catalog
from tests.oracle import connect


def test_signed_zero_and_large_amounts_as_in_sql(spark, tmp_path):
    rng = random.Random(4)
    values = [None, -0.0, 0.0, -0.004, -0.5, 0.5, 2.5, 1234.5, 2.0**53, -(2.0**53) - 2, 8.930470686728234e17, 6.520872977048258e18, -4.766996210917059e18]
    values += [rng.uniform(-1, 1) * 10.0 ** rng.randrange(19) for _ in range(500)]
    spark.createDataFrame(list(enumerate(values)), "c_custkey long, c_acctbal double").coalesce(1).write.parquet(f"file://{tmp_path}/customer.parquet")
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    got = sorted(map(tuple, catalog.q_board_figures(spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(catalog.ORACLES["q_board_figures"]).fetchall())
    assert got[1][1] == "₹0"
