"""Incremental CSV ingest: two batches of files, exactly once."""

import os

from skylane.streaming.ingest import ingest_csv

COLS = ["FL_DATE", "AIRLINE", "ORIGIN", "DEST", "CRS_DEP_TIME", "DEP_DELAY", "ARR_DELAY",
        "CANCELLED", "DIVERTED", "DISTANCE"]


def _write(path, lines):
    with open(path, "w") as f:
        f.write(",".join(COLS) + "\n")
        for ln in lines:
            f.write(ln + "\n")


def test_ingest_two_batches(spark, tmp_path):
    src, out, ck = tmp_path / "in", tmp_path / "table", tmp_path / "ckpt"
    os.makedirs(src)
    _write(src / "a.csv", ["2019-01-06,X,AAA,BBB,700,5,20,0,0,500", "20200302,Y,AAA,CCC,2400,NA,,1,0,1600"])
    q = ingest_csv(spark, str(src), str(out), columns=COLS, checkpoint=str(ck))
    q.awaitTermination(120)
    df = spark.read.parquet(str(out))
    assert df.count() == 2
    r = df.filter("AIRLINE = 'Y'").first()
    assert (r.YEAR, r.DEP_DELAY, r.ARR_DELAY, r.DEP_HOUR, r.DISTANCE_CAT) == (2020, None, None, None, "Long-haul")
    _write(src / "b.csv", ["2019-02-01,X,AAA,BBB,100,-3,-1,0,0,100"])
    q = ingest_csv(spark, str(src), str(out), columns=COLS, checkpoint=str(ck))
    q.awaitTermination(120)
    df = spark.read.parquet(str(out))
    assert df.count() == 3                                  # a.csv not read twice
    assert sorted(r.YEAR for r in df.select("YEAR").distinct().collect()) == [2019, 2020]


def test_stream_reads_by_header_name(spark, tmp_path):
    src, out, ck = tmp_path / "in", tmp_path / "table", tmp_path / "ckpt"
    os.makedirs(src)
    _write(src / "a.csv", ["2019-01-06,X,AAA,BBB,700,5,20,0,0,500"])
    back = COLS[::-1]
    (src / "b.csv").write_text(",".join(back) + "\n" + ",".join("2020-03-02,Y,AAA,CCC,2400,7,9,1,0,1600".split(",")[::-1]) + "\n")
    ingest_csv(spark, str(src), str(out), columns=COLS, checkpoint=str(ck)).awaitTermination(120)
    got = {(r.YEAR, r.AIRLINE, r.DEP_DELAY, r.ARR_DELAY, r.DISTANCE) for r in spark.read.parquet(str(out)).collect()}
    assert got == {(2019, "X", 5.0, 20.0, 500.0), (2020, "Y", 7.0, 9.0, 1600.0)}


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    import shutil
    src, out, ck = tmp_path / "in", tmp_path / "table", tmp_path / "ckpt"
    os.makedirs(src)
    _write(src / "a.csv", ["2019-01-06,X,AAA,BBB,700,5,20,0,0,500"])
    ingest_csv(spark, str(src), str(out), checkpoint=str(ck)).awaitTermination(120)
    shutil.rmtree(ck / "commits")                       # as if the driver was lost before the batch was marked done
    ingest_csv(spark, str(src), str(out), checkpoint=str(ck)).awaitTermination(120)
    assert spark.read.parquet(str(out)).count() == 1
