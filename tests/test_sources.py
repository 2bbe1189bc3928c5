import pytest
from pyspark.sql import functions as F

from kindred.plans.report import main
from kindred.sources import vectors as source


def test_text_file_to_report(spark, tmp_path):
    (tmp_path / "words.txt").write_text("one 1 0  0\ntwo 1 0.1 0\n\nthree 0 1 0 \nfour 0 1 0.1\n")
    rows = source.read_text(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r.id, r.word, r.vector) for r in rows] == [(0, "one", [1.0, 0.0, 0.0]), (1, "two", [1.0, 0.1, 0.0]), (2, "three", [0.0, 1.0, 0.0]), (3, "four", [0.0, 1.0, 0.1])]
    from kindred.operators.joiners import BlockedLsh

    lines = {r.line for r in main(spark, str(tmp_path), BlockedLsh(0.5, 20, 200, 1)).collect()}
    assert lines == {"one --> two", "three --> four"}


def test_numbers_without_gaps(spark):
    df = spark.range(0, 5000, 7).selectExpr("id * 3 AS k").repartition(6)
    got = source.numbered(df, "k", parts=9).orderBy("k").collect()
    assert [r.id for r in got] == list(range(len(got)))


def test_takes_all_kinds_of_vectors(spark):
    from pyspark.ml.linalg import Vectors

    floats = spark.createDataFrame([(1, [1.5, 2.0]), (None, [1.0, 1.0]), (2, None)], "id int, vector array<float>")
    dense = spark.createDataFrame([(1, Vectors.dense([1.5, 2.0])), (2, Vectors.sparse(2, [1], [3.0]))], ["id", "vector"])
    assert [tuple(r) for r in source.as_vectors(floats).collect()] == [(1, [1.5, 2.0])]
    assert [tuple(r) for r in source.as_vectors(dense).orderBy("id").collect()] == [(1, [1.5, 2.0]), (2, [0.0, 3.0])]
    with pytest.raises(TypeError):
        source.as_vectors(spark.range(1).withColumn("vector", F.lit("1 2")))


def test_matrices(spark):
    from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix

    matrix = IndexedRowMatrix(spark.sparkContext.parallelize([IndexedRow(4, [1.0, 0.0]), IndexedRow(7, [0.0, 1.0])]))
    df = source.from_indexed_row_matrix(spark, matrix)
    assert sorted(tuple(r) for r in df.collect()) == [(4, [1.0, 0.0]), (7, [0.0, 1.0])]
    pairs = spark.createDataFrame([(4, 7, 0.5)], "i long, j long, value double")
    assert [(e.i, e.j, e.value) for e in source.to_coordinate_matrix(pairs).entries.collect()] == [(4, 7, 0.5)]


def test_check(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, vector array<double>")
    for bad in (df, spark.createDataFrame([(1, [1.0]), (1, [2.0])], df.schema)):
        with pytest.raises(ValueError):
            source.check(bad)
    assert source.width(df) == 1 and source.check(df.where("id = 1"), 1).count() == 1


def test_files_in_the_order_of_their_names(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(f"a{k} {k} 1" for k in range(5)) + "\n\n")
    (tmp_path / "b.txt").write_text("\n".join(f"b{k}  {k} 2" for k in range(5000)) + "\n")
    got = [(r.id, r.word, r.vector) for r in source.read_text(spark, str(tmp_path)).orderBy("id").collect()]
    assert got == [(k, f"a{k}", [float(k), 1.0]) for k in range(5)] + [(5 + k, f"b{k}", [float(k), 2.0]) for k in range(5000)]
