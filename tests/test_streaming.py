import datetime as dt

from meshframe.streaming import snapshots


def test_summaries_of_a_stream(spark, tmp_path):
    schema = "it int, written timestamp, level int, rho double"
    at = dt.datetime(2024, 1, 1, 10)
    src = str(tmp_path / "in")
    for it in (1, 2):
        rows = [(it, at, 1, 2.0), (it, at, 2, 8.0), (it, at, 2, 8.0 * it)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    out = snapshots.summaries(snapshots.read_cells(spark, src, schema, 1), ("rho",), 1.0)
    q = out.writeStream.outputMode("complete").format("memory").queryName("sums").start()
    q.processAllAvailable()
    q.stop()
    got = {r.it: (r.n_cells, r.rho_total) for r in spark.table("sums").collect()}
    assert got == {1: (3, 4.0), 2: (3, 5.0)}
