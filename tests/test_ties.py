"""Queries against their SQL, to the last digit, on values that lie on ties of rounding."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from strataspark.plans.queries import ORACLE, QUERIES


def both(spark, folder, name, table):
    df = QUERIES[name](spark, str(folder))
    duck = duckdb.connect()
    duck.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    cols = ",".join(f'"{c}"' for c in df.columns)
    return sorted(map(tuple, df.collect()), key=repr), sorted(duck.execute(f"select {cols} from ({ORACLE[name]})").fetchall(), key=repr)


def test_snapping_of_prices_on_ties(spark, tmp_path):
    n = range(400)
    pq.write_table(pa.table({"o_orderkey": list(n), "o_custkey": [i % 7 for i in n], "o_totalprice": [1050.0 + 100 * (i * 37 % 90) for i in n]}), tmp_path / "orders.parquet")
    got, want = both(spark, tmp_path, "doc_snap", "orders")
    assert got and got == want


def test_fused_places_on_ties(spark, tmp_path):
    rows = []
    for i in range(3000):
        # A run whose sum is 128, 640 or 1280 has its middle on a tie of the seventh digit, whatever the order of its sum.
        total, wide = ((128, 2), (640, 5), (1280, 11))[i % 3]
        row = [0] * 64
        for k in range(wide - 1):
            row[3 + i % 50 + k] = total // wide + (i * 7 + k * 5) % 9 - 4
        row[3 + i % 50 + wide - 1] = total - sum(row)
        rows.append([(v + 0.5) / 600 for v in row])
    pq.write_table(pa.table({"vec_id": list(range(3000)), "label": pa.array([i % 10 for i in range(3000)], pa.int32()), "embedding": pa.array(rows, pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    got, want = both(spark, tmp_path, "doc_fused", "embeddings")
    assert len(got) == 3000 and got == want
