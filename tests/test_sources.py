"""Sources and sinks on small files."""

import pytest

from ledgerlens.operators import encode as E
from ledgerlens.operators import columns as C
from ledgerlens.operators.profile import narrow_integers
from ledgerlens.sources import tables as T


def test_csv_drop_and_rename(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",age,income\n0,30,1.5\n1,,2.5\n")
    df = T.read_csv(spark, str(tmp_path / "a.csv"), rename={"income": "MonthlyIncome"}, drop=["_c0"])
    assert df.columns == ["age", "MonthlyIncome"] and df.count() == 2
    assert df.where("age is null").count() == 1


def test_csv_with_schema_becomes_parquet(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,x\n2,y\n")
    df = T.csv_to_parquet(spark, str(tmp_path / "a.csv"), str(tmp_path / "a.parquet"), "id long, v string")
    assert dict(df.dtypes) == {"id": "bigint", "v": "string"} and df.count() == 2


def test_lines_last_at_and_first_comma(spark, tmp_path):
    (tmp_path / "at.txt").write_text("Mail a@b now @positive\nno label\nBad @unknown\n Down @ NEGATIVE \n")
    rows = [(r["sentence"], r["label"]) for r in T.parse_sentence_at_label(T.read_lines(spark, str(tmp_path / "at.txt"))).collect()]
    assert rows == [("Mail a@b now", 2), ("Down", 0)]
    (tmp_path / "c.txt").write_text('neutral,"One, two, three"\npositive,tiny\nother,long enough\n')
    rows = [(r["sentence"], r["label"]) for r in T.parse_label_comma_sentence(T.read_lines(spark, str(tmp_path / "c.txt"))).collect()]
    assert rows == [("One, two, three", 1)]


def test_other_charset(spark, tmp_path):
    (tmp_path / "l.txt").write_bytes("Größe stieg @positive\n".encode("latin-1"))
    rows = T.parse_sentence_at_label(T.read_lines(spark, str(tmp_path / "l.txt"), "ISO-8859-1")).collect()
    assert rows[0]["sentence"] == "Größe stieg"


def test_tagged_sources_and_partitioned_sink(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a"))
    spark.range(2).selectExpr("id", "id * 2 as more").write.parquet(str(tmp_path / "b"))
    both = T.read_tagged(spark, {"train": str(tmp_path / "a"), "val": str(tmp_path / "b")})
    T.write_table(both, str(tmp_path / "out"), by=["split"])
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r["split"]: r["count"] for r in back.groupBy("split").count().collect()} == {"train": 3, "val": 2}


def test_statistics_survive_a_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], "k string, y int")
    T.write_stats({"rate": E.fit_target_rate(df, ["k"], "y")}, str(tmp_path))
    stats = T.read_stats(spark, str(tmp_path), ["rate"])["rate"]
    out = E.apply_target_rate(spark.createDataFrame([("a",), ("z",)], "k string"), stats, ["k"], "r")
    assert {r["k"]: round(r["r"], 4) for r in out.collect()} == {"a": 0.5, "z": 0.6667}


def test_report_and_build_once(spark, tmp_path):
    T.write_report(spark.range(2), str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 2
    calls = []

    def build():
        calls.append(1)
        return spark.range(4)

    path = str(tmp_path / "built")
    assert T.read_or_build(spark, path, build).count() == 4
    assert T.read_or_build(spark, path, build).count() == 4 and len(calls) == 1


def test_narrow_integers_and_schema_tools(spark):
    df = spark.createDataFrame([(1, 300, 70000, 1.5)], "a long, b long, c long, d double")
    assert dict(narrow_integers(df).dtypes) == {"a": "tinyint", "b": "smallint", "c": "int", "d": "double"}
    groups = C.group_columns(["ps_ind_1_bin", "ps_ind_2", "x"], {"bin": ".*_bin", "ind": "ps_ind.*"})
    assert groups == {"bin": ["ps_ind_1_bin"], "ind": ["ps_ind_2"]}
    assert C.compare_schemas(df, df.drop("a").withColumn("e", df.b)) == {"kept": ["b", "c", "d"], "new": ["e"], "dropped": ["a"]}


def test_a_table_that_cannot_be_read_is_not_rebuilt(spark, tmp_path):
    (tmp_path / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        T.read_or_build(spark, str(tmp_path), lambda: spark.range(1)).collect()
    assert (tmp_path / "part-0.parquet").read_text() == "not parquet"
