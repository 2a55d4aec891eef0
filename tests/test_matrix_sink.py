"""The sink of binary matrices: whole files or none."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavekin.sources import matrix


def series(spark, n, width=6, parts=3):
    return spark.range(n).repartition(parts).select(F.col("id").alias("series_id"), F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: (F.col("id") * 10 + i).cast("double")).alias("values"))


def test_parts_hold_ranges_of_ids(spark, tmp_path):
    path = str(tmp_path / "m")
    matrix.write_matrix(series(spark, 25_000), path, "float64", rows_per_file=10_000)
    names = sorted(os.listdir(path))
    assert len(names) == 3 and names[0] == "rows-000000000000.bin" and all(n.startswith("rows-") for n in names)
    whole = np.concatenate([np.fromfile(f"{path}/{n}", "<f8") for n in names]).reshape(-1, 6)
    assert (whole == np.arange(25_000)[:, None] * 10 + np.arange(1, 7)).all()
    back = matrix.read_matrix(spark, path, 6, "float64")
    assert back.count() == 25_000 and back.join(series(spark, 25_000), "series_id").where(F.array_join(F.transform(back["values"], lambda x: x.cast("string")), ",").isNull()).count() == 0
    matrix.write_matrix(series(spark, 40), path, "uint8")
    assert matrix.read_matrix(spark, path, 6, "uint8").agg(F.count("*"), F.max("series_id")).first() == (40, 39)


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "m")
    matrix.register(spark)
    broken = series(spark, 5000).withColumn("values", F.when(F.col("series_id") == 4999, F.array(F.lit(1.0))).otherwise(F.col("values")))
    with pytest.raises(Exception, match="other lengths"):
        broken.repartitionByRange(4, "series_id").sortWithinPartitions("series_id").write.format("series_matrix").option("path", path).option("n", 6).mode("append").save()
    assert os.listdir(path) == []
    with pytest.raises(Exception, match="ascending"):
        series(spark, 50).orderBy(F.desc("series_id")).coalesce(1).write.format("series_matrix").option("path", path).option("n", 6).mode("append").save()
    assert os.listdir(path) == []
    series(spark, 50).where("series_id <> 20").coalesce(1).sortWithinPartitions("series_id").write.format("series_matrix").option("path", path).option("n", 6).mode("append").save()
    assert sorted(os.listdir(path)) == ["rows-000000000000.bin", "rows-000000000021.bin"]
    assert sorted(r["series_id"] for r in matrix.read_matrix(spark, path, 6).collect()) == [i for i in range(50) if i != 20]


def test_an_empty_table(spark, tmp_path):
    matrix.write_matrix(series(spark, 0), str(tmp_path / "m"))
    assert os.listdir(tmp_path / "m") == [] and matrix.read_matrix(spark, str(tmp_path / "m"), 1).count() == 0
