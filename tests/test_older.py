"""Papers of the older form."""

import pytest
from pyspark.sql import functions as F

from paperloom.operators.classify import after_number, classify, header_word, question_number
from paperloom.operators.segment import split_questions

LINES = "file_id string, pos long, text string"


@pytest.mark.parametrize("line, word", [
    ("一、选择题", "选择题"), ("十二. 应用题", "应用题"), ("三．填空题", None), ("Part A：选择题", "选择题"), ("Part  D 填空题", "填空题"), ("PartB多选题 x", "多选题"), ("Part A: 解答题", None),
    ("Part E: 选择题", None), ("选择题（共5题）x", "选择题"), ("单选题 (5)", "单选题"), ("选择题", None), ("解答题（5）", None), ("part A: 选择题", None), ("", None),
])
def test_headers(spark, line, word):
    assert spark.createDataFrame([(line,)], "t string").select(header_word(F.col("t"), legacy=True)).first()[0] == word


@pytest.mark.parametrize("line, number, rest", [
    ("1. x", 1, "x"), ("2，x", 2, "x"), ("3:x", 3, "x"), ("(4) x", 4, "x"), ("（５）x", 5, "x"), ("( 6)x", None, "( 6)x"), ("7 ) x", 7, "x"), ("7）x", None, "7）x"),
    ("第 8 题：x", 8, "：x"), ("Question9 x", 9, "x"), ("Question 10", 10, ""), ("question 1", None, "question 1"), ("Q11x", 11, "x"), ("Q 11", None, "Q 11"), ("x", None, "x"),
])
def test_numbers(spark, line, number, rest):
    row = spark.createDataFrame([(line,)], "t string").select(question_number(F.col("t"), legacy=True), after_number(F.col("t"), legacy=True)).first()
    assert tuple(row) == (number, rest)


def test_points_count_for_the_question_before(spark):
    lines = ["选择题（每题2分）", "（9分）", "Q1 甲", "3分", "第2题 乙（5分）", "填空题(x)", "(3) 丙（7分）", "参考答案", "Q4 丁", "4分", "6分"]
    made = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)] + [("g", None, "Q1"), (None, 1, "Q1"), ("g", 1, None)], LINES)
    got = split_questions(made, legacy=True).orderBy("ord").collect()
    # The points of a numbered line go to the question that it ends; the first of a section has none to give them to.
    assert [(r["number"], r["type"], r["content"], r["score"]) for r in got] == [
        (1, "single_choice", "甲 3分", 5.0), (2, "single_choice", "乙（5分）", None), (3, "fill_blank", "丙（7分） 参考答案", None), (4, "fill_blank", "丁 4分 6分", 6.0),
    ]


def test_points_over_many_chunks(spark):
    """A question open since earlier chunks of its paper still gets the points."""
    made = spark.range(5000).select(F.lit("f").alias("file_id"), F.col("id").alias("pos"), F.when(F.col("id") == 0, "Q1 甲").when(F.col("id") == 4000, "8分").when(F.col("id") == 4999, "Q2 乙（9分）").otherwise("x").alias("text"))
    assert [(r["number"], r["score"]) for r in split_questions(made, legacy=True).orderBy("ord").collect()] == [(1, 9.0), (2, None)]


def test_no_lines(spark):
    assert split_questions(spark.createDataFrame([], LINES), legacy=True).collect() == []


def test_older_papers_have_no_markers(spark):
    made = spark.createDataFrame([("f", 0, "参考答案"), ("f", 1, "答案：B")], LINES)
    assert [r["flag"] for r in classify(made, legacy=True).orderBy("pos").collect()] == ["text", "answer"]
