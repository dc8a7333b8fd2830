import pytest

from wardline.sources import frame_sql, load_csv_dir, read_csv_table, warehouse_table, write_csv, write_parquet


def test_csv_directory(spark, tmp_path):
    (tmp_path / "inputs.v2.csv").write_text(
        'extra,amountuom,stay_id,amount,starttime\n1,"L",5,1.5,2150-01-01 01:00:00\n'
        '2,,6,NA,2150-01-02\n3,NA,7,,2150-01-03T04:05:06\n4,"a ""b""",x,z,bad\n'
    )
    (tmp_path / "my table.csv").write_text("a\n1\n")
    (tmp_path / "notes.txt").write_text("a\n1\n")
    schemas = {
        "inputs": "stay_id long, amount double, amountuom string, starttime timestamp_ntz",
        "mytable": "a int",
    }
    tables = load_csv_dir(spark, str(tmp_path), schemas)
    assert sorted(tables) == ["inputs", "mytable"]
    rows = sorted(tables["inputs"].collect(), key=str)
    assert {(r["stay_id"], r["amount"], r["amountuom"]) for r in rows} == {
        (5, 1.5, "L"), (6, None, ""), (7, None, None), (None, None, 'a "b"'),
    }
    assert {str(r["starttime"]) for r in rows} == {
        "2150-01-01 01:00:00", "2150-01-02 00:00:00", "2150-01-03 04:05:06", "None",
    }
    assert spark.sql("select a from mytable").first()["a"] == 1


def test_missing_column_is_named(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a\n1\n")
    with pytest.raises(ValueError, match="b"):
        read_csv_table(spark, str(tmp_path / "t.csv"), "a int, b int")


def test_table_in_parts(spark, tmp_path):
    df = spark.range(20).selectExpr("id AS stay_id", "id * 1.5D AS amount")
    write_csv(df.repartition(3), str(tmp_path / "in" / "inputs.csv"))
    back = load_csv_dir(spark, str(tmp_path / "in"), {"inputs": "stay_id long, amount double"})
    assert sorted(map(tuple, back["inputs"].collect())) == sorted(map(tuple, df.collect()))


def test_sinks_and_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, 0.5)], "a long, b double")
    write_csv(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("*.csv")))
    assert "a,b" in text and "1,NA" in text
    write_parquet(df, str(tmp_path / "p"))
    assert warehouse_table(spark, str(tmp_path / "p")).count() == 2
    df.createOrReplaceTempView("warehouse_example")
    assert warehouse_table(spark, "warehouse_example").count() == 2


def test_sql_over_a_frame(spark):
    df = spark.createDataFrame([("mL/min",), ("mcg",)], "rateuom string")
    out = frame_sql("select * from {t} where rateuom in ('mL/min', 'mL/hour')", t=df)
    assert [r[0] for r in out.collect()] == ["mL/min"]


def test_quoted_line_breaks_stay_in_a_field(spark, tmp_path):
    (tmp_path / "t.csv").write_text('k,v\n1,"two\nlines, ""quoted"""\n2,plain\n')
    rows = read_csv_table(spark, str(tmp_path / "t.csv"), "k long, v string").collect()
    assert sorted(map(tuple, rows)) == [(1, 'two\nlines, "quoted"'), (2, "plain")]


def test_parts_with_another_header_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,2\n")
    (tmp_path / "b.csv").write_text("v,k\n6,2\n")
    with pytest.raises(Exception):  # noqa: B017
        read_csv_table(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], "k long, v long").collect()


def test_microseconds_survive(spark, tmp_path):
    times = spark.sql("SELECT TIMESTAMP_NTZ '2150-01-02 00:00:00.123456' AS a, TIMESTAMP '2150-01-02 00:00:00.000001' AS b")
    write_csv(times, str(tmp_path / "t"))
    back = read_csv_table(spark, str(tmp_path / "t"), "a timestamp_ntz, b timestamp")
    assert back.collect() == times.collect()


def test_own_names_and_split_files(spark, tmp_path):
    """Names of tables and columns are mapped; without quoted line breaks a large file is read by several tasks."""
    lines = ["who,what", *[f"{k},text {k}" for k in range(200_000)]]
    (tmp_path / "their_table.csv").write_text("\n".join(lines))
    (tmp_path / "notes.csv").write_text('id,note\n1,"two\nlines"\n')
    schemas = {"people": "id long, name string", "notes": "id long, note string"}
    options = {"tables": {"their_table": "people"}, "columns": {"people": {"who": "id", "what": "name"}}, "views": False}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        split = load_csv_dir(spark, str(tmp_path), schemas, quoted_line_breaks={"notes"}, **options)
        whole = load_csv_dir(spark, str(tmp_path), schemas, **options)
        assert split["people"].rdd.getNumPartitions() > 1 == whole["people"].rdd.getNumPartitions()
        assert [tuple(r) for r in split["notes"].collect()] == [(1, "two\nlines")]
        for frame in (split["people"], whole["people"]):
            assert frame.columns == ["id", "name"] and frame.count() == 200_000
            assert frame.filter("name = concat('text ', id)").count() == 200_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
