"""Totals counted in passing against an aggregation of their own."""

from pyspark.sql import functions as F

from paperloom.operators.segment import split_questions
from paperloom.operators.stats import observed_paragraphs, observed_questions, paper_stats


def test_paragraph_totals(spark, tmp_path):
    rows = [("f", ["a", "b"], True), ("f", [], False), ("g", ["c"], None), ("g", None, False)]
    made = spark.createDataFrame(rows * 50, "file_id string, latex_formulas array<string>, has_omml boolean").repartition(4)
    seen, told = observed_paragraphs(made)
    seen.write.parquet(f"{tmp_path}/a")
    want = paper_stats(made).agg(*[F.sum(c).alias(c) for c in ("total_paragraphs", "total_formula_paragraphs", "total_formulas")], F.bool_or("has_omml").alias("has_omml")).first().asDict()
    assert told.get == want == {"total_paragraphs": 200, "total_formula_paragraphs": 100, "total_formulas": 150, "has_omml": True}
    assert spark.read.parquet(f"{tmp_path}/a").count() == 200


def test_totals_cost_no_job(spark, tmp_path):
    group = "observed totals"
    seen, told = observed_paragraphs(spark.range(100).select(F.array(F.lit("x")).alias("latex_formulas")))
    spark.sparkContext.setJobGroup(group, group)
    seen.write.parquet(f"{tmp_path}/b")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    assert told.get["total_formulas"] == 100
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == jobs == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_no_rows(spark, tmp_path):
    seen, told = observed_questions(split_questions(spark.createDataFrame([], "file_id string, pos long, text string")))
    seen.write.parquet(f"{tmp_path}/c")
    assert set(told.get.values()) == {0}
    seen, told = observed_paragraphs(spark.createDataFrame([], "latex_formulas array<string>, has_vml_shapes boolean"))
    seen.write.parquet(f"{tmp_path}/d")
    assert told.get == {"total_paragraphs": 0, "total_formula_paragraphs": 0, "total_formulas": 0, "has_vml_shapes": False}
