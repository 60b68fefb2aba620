"""Tables whose parts must not outgrow a task."""

from pyspark.sql import functions as F
from statuta.operators import corpus


def test_a_large_first_drop_is_dealt_into_more_parts(spark, tmp_path, monkeypatch):
    """tables of any size were dealt into the number of parts that was asked for."""
    monkeypatch.setattr(corpus, "PART_BYTES", 1000)
    rows = spark.range(500).select("id", F.lit("x" * 12).alias("content"), F.lit(1).cast("long").alias("version"))
    root = str(tmp_path / "t")
    corpus.upsert_table(spark, root, rows, parts=4)
    places = corpus._places(spark, root)
    assert len(places) == 14 and set(places["parts"]) == {14}
    corpus.upsert_table(spark, root, rows.limit(3).withColumn("version", F.lit(2).cast("long")), parts=4)
    got = {r.id: r.version for r in corpus.current_table(spark, root).collect()}
    assert len(got) == 500 and sorted(got.values())[-4:] == [1, 2, 2, 2]


def test_incoming_rows_are_worked_out_once_in_a_stage(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def told(x):
        seen.add(1)
        return x

    with corpus.staged(spark.range(7).select(told("id").alias("id")), str(tmp_path)) as rows:
        assert rows.count() == 7 and rows.agg(F.sum("id")).first()[0] == 21
    assert seen.value == 7 and list(tmp_path.glob("staged-*")) == []
