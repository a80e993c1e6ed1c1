from pathlib import Path

import civic
import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbstone import session
from kerbstone.session import checkpoint_folder, remove_scratch, scratch_path, settle
from kerbstone.sources import tables
from kerbstone.sources.civic import SCHEMAS, read_civic


def test_csv_is_read_by_name_and_bad_fields_become_null(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("b,extra,a\nx,1,7\ny,2,seven\n")
    schema = T.StructType.fromDDL("a int, b string")
    assert rows(tables.read_csv(spark, str(path), schema)) == [(None, "y"), (7, "x")]
    assert tables.read_csv(spark, str(path), schema, others=True).columns == ["b", "extra", "a"]


def test_missing_csv_column_is_named(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("b\nx\n")
    try:
        tables.read_csv(spark, str(path), T.StructType.fromDDL("a int, b string"))
    except ValueError as problem:
        assert "['a']" in str(problem)
    else:
        raise AssertionError("no error")


def test_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n"6"" pipe, old",x\n"two\nlines",y\n')
    schema = T.StructType.fromDDL("a string, b string")
    found = tables.read_csv(spark, str(path), schema, multi_line=True)
    assert rows(found) == [('6" pipe, old', "x"), ("two\nlines", "y")]


def test_headers_in_other_orders(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "1.csv").write_text("a,b\n1,x\n")
    (folder / "2.csv").write_text("b,a,c\ny,2,more\n")
    (folder / "3.csv").write_text("")
    schema = T.StructType.fromDDL("a int, b string")
    assert rows(tables.read_csv(spark, str(folder), schema)) == [(1, "x"), (2, "y")]
    wide = tables.read_csv(spark, str(folder), schema, others=True, order="_ord")
    assert wide.columns == ["a", "b", "_ord", "c"] or set(wide.columns) == {"a", "b", "c", "_ord"}
    assert [r["a"] for r in wide.orderBy("_ord").collect()] == [1, 2]


def test_parquet_columns_are_checked_and_cast(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("7", "x", 1)], "a string, b string, c int").write.parquet(path)
    schema = T.StructType.fromDDL("a int, b string")
    assert rows(tables.read_parquet(spark, path, schema)) == [(7, "x", 1)]
    assert tables.read_parquet(spark, path, schema, others=False).columns == ["a", "b"]
    with pytest.raises(ValueError, match="'z'"):
        tables.read_parquet(spark, path, T.StructType.fromDDL("z int"))


def test_round_trip_adds_no_row_numbers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b", 0.1), (2, None, None)], "i int, s string, d double")
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        tables.write_table(df, path, fmt)
        tables.write_table(df, path, fmt)
        if fmt == "csv":
            back = tables.read_csv(spark, path, df.schema)
        else:
            back = tables.read_parquet(spark, path)
        assert back.columns == df.columns and rows(back) == rows(df)


def test_file_order_survives_small_blocks(spark, tmp_path):
    path = str(tmp_path / "many.csv")
    with open(path, "w") as out:
        out.write("i\n" + "\n".join(str(i) for i in range(5000)) + "\n")
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "1024")
    try:
        ordered = tables.read_csv(spark, path, T.StructType.fromDDL("i int"), order="_ord")
        assert ordered.rdd.getNumPartitions() > 1
        assert [r[0] for r in ordered.orderBy("_ord").select("i").collect()] == list(range(5000))
    finally:
        spark.conf.set(name, before)


def test_civic_tables_in_both_formats(spark, tmp_path):
    folder = civic.write(tmp_path)
    csv = read_civic(spark, folder)
    assert set(csv) == set(SCHEMAS)
    for table, ddl in SCHEMAS.items():
        raw = tables.read_csv(
            spark,
            f"{folder}/{table}.csv",
            T.StructType.fromDDL(ddl),
            others=table == "properties",
            infer=table == "properties",
        )
        raw.write.parquet(f"{folder}/{table}.parquet")
    parquet = read_civic(spark, folder, "parquet")
    for table in SCHEMAS:
        assert parquet[table].columns == csv[table].columns
        names = [c for c in parquet[table].columns if c != "_ord"]
        quoted = [F.col(f"`{c}`") for c in names]
        assert rows(csv[table].select(*quoted)) == rows(parquet[table].select(*quoted))


def test_settled_tables_live_in_the_shared_folder(spark):
    folder = checkpoint_folder(spark)
    assert scratch_path(spark, "x").startswith(folder)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    settled = settle(spark.range(3).selectExpr("id % 2 as part", "id"), ["part"])
    assert rows(settled.select("part", "id")) == [(0, 0), (0, 2), (1, 1)]
    assert all(folder in file for file in settled.inputFiles())
    # Others may use the folder too: what this process has written goes.
    written = [Path(p.removeprefix("file://")) for p in session._written]
    assert any(p.exists() for p in written)
    remove_scratch()
    assert not any(p.exists() for p in written)


def test_types_of_unlisted_columns_are_narrowed(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    head = "a,none,whole,wide,part,flag,mixed,late,text\n"
    (folder / "1.csv").write_text(head + "1,,7,1,1.5,true,1,5,x\n2,NA, -8 ,99999999999999999999,2,FALSE,true,6,NA\n")
    (folder / "2.csv").write_text(head + "3,n/a,,3,1e3,,2,7,z\n" + "4,,9,4,.5,True,3,8,1\n" * 500 + "5,,1,1,1,true,1,n7,q\n")
    schema = T.StructType.fromDDL("a int")
    found = tables.read_csv(spark, str(folder), schema, others=True, infer=True)
    assert {f.name: f.dataType.simpleString() for f in found.schema} == {
        "a": "int", "none": "double", "whole": "bigint", "wide": "double", "part": "double", "flag": "boolean",
        "mixed": "string", "late": "string", "text": "string",
    }
    first = found.filter("a <= 3").orderBy("a").collect()
    assert [r["whole"] for r in first] == [7, -8, None]
    assert [r["wide"] for r in first] == [1.0, 1e20, 3.0]
    assert [r["part"] for r in first] == [1.5, 2.0, 1000.0]
    assert [r["flag"] for r in first] == [True, False, None]
    assert [r["mixed"] for r in first] == ["1", "true", "2"]
    assert [r["text"] for r in first] == ["x", None, "z"]
    plain = tables.read_csv(spark, str(folder))
    assert plain.schema["a"].dataType == T.LongType() and plain.count() == 504
    # Values that only look like numbers of a programming language are text.
    (tmp_path / "odd.csv").write_text("a,b,c\n1d,0x10,1_000\n2f,Infinity,1\n")
    assert {f.dataType.simpleString() for f in tables.read_csv(spark, str(tmp_path / "odd.csv")).schema} == {"string"}


def test_headers_of_many_files_take_one_job(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(300):
        names = "a,b" if i % 3 else '"b",c,a'
        row = f"{i},x" if i % 3 else f"x,more,{i}"
        (folder / f"{i:03}.csv").write_text(f"\n{names}\r\n" + f"{row}\r\n" * (i % 5))
    (folder / "empty.csv").write_text("")
    status = spark.sparkContext.statusTracker()
    group = "headers-of-many-files"
    spark.sparkContext.setJobGroup(group, "")
    found = tables._headers(spark, str(folder))
    jobs = len(status.getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    assert {k: len(v) for k, v in found.items()} == {("b", "c", "a"): 100, ("a", "b"): 200}
    assert jobs <= 4
    wanted = sorted(i for i in range(300) for _ in range(i % 5))
    table = tables.read_csv(spark, str(folder), T.StructType.fromDDL("a int, b string"))
    assert sorted(r["a"] for r in table.collect()) == wanted


def test_same_city_from_csv_and_parquet_has_the_same_types(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    civic.write(tmp_path / "csv")
    extra = spark.read.option("header", True).csv(str(tmp_path / "csv" / "properties.csv"))
    extra = extra.withColumns({"ROOMS": F.lit(5).cast("long"), "SHARE": F.lit(0.5), "ZONE": F.lit("R1")})
    columns = "ADDRESS string, YEARBUILT string, LAT double, LON double, ROOMS long, SHARE double, ZONE string"
    both = {}
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / f"p.{fmt}")
        typed = extra.select(*[F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(columns)])
        tables.write_table(typed, path, fmt)
        schema = T.StructType.fromDDL(SCHEMAS["properties"])
        if fmt == "csv":
            both[fmt] = tables.read_csv(spark, path, schema, others=True, infer=True)
        else:
            both[fmt] = tables.read_parquet(spark, path, schema)
    kinds = [{f.name: f.dataType for f in both[fmt].schema} for fmt in both]
    assert kinds[0] == kinds[1]
    assert rows(both["csv"].select(*sorted(kinds[0]))) == rows(both["parquet"].select(*sorted(kinds[0])))
