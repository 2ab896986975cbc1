"""Splits of external text, ragged arrays, and files below an unreadable manifest."""

import pytest

from tabletrail.operators import audit, matrices
from tabletrail.sources.external import read_external


def test_line_breaks_in_fields_need_multi_line(spark, tmp_path):
    path = tmp_path / "notes.csv"
    path.write_text('id,note\n1,"two\nlines"\n2,one\n')
    rows = read_external(spark, str(path), multi_line=True).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "two\nlines"), (2, "one")]
    assert read_external(spark, str(path), schema="id string, note string").count() == 3


def test_one_large_file_is_several_tasks(spark, tmp_path):
    path = tmp_path / "numbers.csv"
    path.write_text("n\n" + "".join(f"{i}\n" for i in range(200_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        df = read_external(spark, str(path), schema="n bigint")
        assert df.rdd.getNumPartitions() > 1
        assert df.selectExpr("count(*)", "sum(n)").first()[:] == (200_000, 199_999 * 100_000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("bad", [None, [1.0]])
def test_ragged_arrays_name_the_column(spark, bad):
    df = spark.createDataFrame([([1.0, 2.0],), (bad,)], "reads array<double>")
    with pytest.raises(Exception, match="column 'reads' must hold arrays of 2 numbers"):
        matrices.position_distances(df, "reads", 2).collect()


def test_files_below_an_unreadable_manifest_are_left_out(spark):
    files = spark.createDataFrame([(p,) for p in ("data/preserved/n/a/t.csv/v1/part-0", "data/preserved/n/a/x.txt", "data/preserved/n/ab/x.txt", "loose")], "path string")
    folders = spark.createDataFrame([("data/preserved/n/a",)], "folder string")
    found = audit.unlisted_files(files, files.limit(0), folders)
    assert sorted(r["artifact"] for r in found.collect()) == ["data/preserved/n/ab/x.txt", "loose"]
