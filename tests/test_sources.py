"""CSV reader, dictionary schema, view registration and hash sample."""

from pyspark.sql import functions as F

from skylane.sources import readers, schema


def test_dictionary_schema():
    s = schema.flights_schema()
    assert len(s.fields) == 31
    assert s["DEP_DELAY"].metadata["source_header"] == "DepDelay"
    assert len(schema.flights_schema(include_undocumented=False).fields) == 30
    assert schema.delay_cause_columns(s.fieldNames()) == [
        "DELAY_DUE_CARRIER", "DELAY_DUE_WEATHER", "DELAY_DUE_NAS", "DELAY_DUE_SECURITY", "DELAY_DUE_LATE_AIRCRAFT"]


def test_csv_by_header_name_missing_number_null(spark, tmp_path):
    p = tmp_path / "f.csv"
    p.write_text("ARR_DELAY,AIRLINE,FL_DATE,CANCELLED\n12,Envoy,20190106,0\n,NA,2019-01-07,1\nx,B,bad,0\n")
    df = readers.read_flights_csv(spark, str(p))
    got = [tuple(r) for r in df.collect()]
    assert got == [(12.0, "Envoy", "20190106", 0.0), (None, None, "2019-01-07", 1.0), (None, "B", "bad", 0.0)]
    assert dict(df.dtypes)["ARR_DELAY"] == "double"


def test_view_and_sql(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    readers.register_view(df, "t_view")
    assert readers.run_sql(spark, "SELECT sum(x) AS s FROM t_view").first().s == 3


def test_hash_sample_reproducible(spark):
    df = spark.range(5000).withColumn("k", F.col("id"))
    a = readers.hash_sample(df, 0.3, ["k"]).select("k")
    b = readers.hash_sample(df.repartition(7), 0.3, ["k"]).select("k")
    ka, kb = sorted(r.k for r in a.collect()), sorted(r.k for r in b.collect())
    assert ka == kb and 1300 < len(ka) < 1700


def test_csv_files_with_other_column_orders(spark, tmp_path):
    from skylane.sources.readers import read_flights_csv
    (tmp_path / "a.csv").write_text("ARR_DELAY,DEP_DELAY,ORIGIN\n1,2,AAA\n")
    (tmp_path / "b.csv").write_text("DEP_DELAY,ARR_DELAY\n7,99\n")
    got = {(r.ARR_DELAY, r.DEP_DELAY, r.ORIGIN) for r in read_flights_csv(spark, str(tmp_path / "*.csv")).collect()}
    assert got == {(1.0, 2.0, "AAA"), (99.0, 7.0, None)}


def test_many_files_are_planned_by_a_fixed_number_of_jobs(spark, tmp_path):
    from skylane.sources.readers import read_flights_csv
    orders = ["ARR_DELAY,ORIGIN,DEP_DELAY", "DEP_DELAY,ARR_DELAY,ORIGIN", '"ORIGIN","ARR_DELAY"']
    for i in range(400):
        names = orders[i % 3].replace('"', "").split(",")
        line = {"ARR_DELAY": str(i), "ORIGIN": f"A{i}", "DEP_DELAY": str(-i)}
        (tmp_path / f"f {i:03d}[x].csv").write_text(orders[i % 3] + "\n" + ",".join(line[n] for n in names) + "\n")
    (tmp_path / "empty.csv").write_text("")
    sc = spark.sparkContext
    sc.setJobGroup("headers", "headers")
    try:
        df = read_flights_csv(spark, str(tmp_path))
        assert len(sc.statusTracker().getJobIdsForGroup("headers")) < 15
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    got = {(r.ORIGIN, r.ARR_DELAY, r.DEP_DELAY) for r in df.collect()}
    assert got == {(f"A{i}", float(i), None if i % 3 == 2 else float(-i)) for i in range(400)}


def test_header_of_a_file_in_several_blocks(spark, tmp_path):
    from skylane.sources.readers import file_headers, read_flights_csv
    (tmp_path / "a.csv").write_text("ORIGIN,ARR_DELAY\n" + "".join(f"X{i},{i}\n" for i in range(20_000)))
    (tmp_path / "b.csv").write_text("ARR_DELAY,ORIGIN\n1,Y\n")
    for i in range(30):
        (tmp_path / f"c{i}.csv").write_text("DEP_DELAY\n3\n")
    for size in (None, 20_000):
        found = file_headers(spark, str(tmp_path), size)
        assert found.rdd.getNumPartitions() > (40 if size else 31)
        assert sorted(r.header for r in found.collect()) == ["ARR_DELAY,ORIGIN", *["DEP_DELAY"] * 30, "ORIGIN,ARR_DELAY"]
    df = read_flights_csv(spark, str(tmp_path))
    assert df.count() == 20_031 and df.where("ORIGIN = 'Y'").first().ARR_DELAY == 1.0


def test_wrong_headers_fail(spark, tmp_path):
    import pytest
    from skylane.sources.readers import read_flights_csv
    (tmp_path / "a.csv").write_text("foo,bar\n1,2\n")
    with pytest.raises(ValueError):
        read_flights_csv(spark, str(tmp_path))
    (tmp_path / "a.csv").write_text("ORIGIN,bar\nA,2\n")
    with pytest.raises(ValueError):
        read_flights_csv(spark, str(tmp_path), required=["DEST"])
    (tmp_path / "a.csv").write_text("")
    assert read_flights_csv(spark, str(tmp_path)).count() == 0
