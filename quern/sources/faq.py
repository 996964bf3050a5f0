"""Question-and-answer files: header aliases, value lists, validation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Header names of each field, in order of precedence.
ALIASES = {
    "standard_question": ["问题", "standard_question", "question", "Q"],
    "answers": ["答案", "机器人回答", "answers", "answer", "A"],
    "similar_questions": ["相似问题", "similar_questions"],
    "negative_questions": ["负问题", "反例问题", "negative_questions"],
    "category": ["分类", "category", "tag_name", "tags"],
    "answer_strategy": ["答案策略", "answer_strategy"],
}
LISTS = ("answers", "similar_questions", "negative_questions")


def split_values(c: Column) -> Column:
    """Values between ##, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "##"), lambda x: F.trim(x)), lambda x: x != "")


def delimiter(header: str) -> str:
    return ";" if header.count(";") > header.count(",") else ","


def entries(rows: DataFrame) -> DataFrame:
    """The fields of rows of strings under any of their header names, lists split; blank rows dropped."""
    clean = {c.strip().lstrip("﻿"): c for c in rows.columns}

    def field(name: str) -> Column:
        found = [F.trim(F.col(f"`{clean[a]}`")) for a in ALIASES[name] if a in clean]
        return F.coalesce(*found, F.lit("")) if found else F.lit("")

    some = F.lit(False)
    for c in rows.columns:
        some = some | (F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) != "")
    out = rows.filter(some).select(*((split_values(field(f)) if f in LISTS else field(f)).alias(f) for f in ALIASES))
    return out.withColumn("answer_strategy", F.when(F.col("answer_strategy").isin("all", "random"), F.col("answer_strategy")).otherwise("all"))


def problem(standard: Column, similar: Column, negative: Column, answers: Column) -> Column:
    """What is wrong with an entry, or null."""
    low = lambda a: F.transform(a, lambda x: F.lower(x))
    return (
        F.when(F.coalesce(standard, F.lit("")) == "", "no question")
        .when(F.size(answers) == 0, "no answer")
        .when(F.array_contains(low(similar), F.lower(standard)), "similar repeats the question")
        .when(F.array_contains(low(negative), F.lower(standard)), "negative repeats the question")
        .when(F.arrays_overlap(low(negative), low(similar)), "negative repeats a similar one")
    )


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a CSV file with comma or semicolon, with a column problem."""
    head = spark.read.text(path).first()
    rows = spark.read.option("header", True).option("sep", delimiter(head[0] if head else "")).option("multiLine", True).option("escape", '"').csv(path)
    out = entries(rows)
    return out.withColumn("problem", problem(F.col("standard_question"), F.col("similar_questions"), F.col("negative_questions"), F.col("answers")))


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the first sheets of workbooks under path, whose first rows name the fields, with a column problem."""
    from quern.sources.files import read_sheets

    names = [a for found in ALIASES.values() for a in found]

    def rows(frames):
        for f in frames:
            for raw in f["content"]:
                sheets = read_sheets(raw)
                head, *body = (sheets[0][1] if sheets else []) or [[]]
                at = {h.strip().lstrip("\ufeff"): i for i, h in reversed(list(enumerate(head)))}
                yield pd.DataFrame([[r[at[n]] if n in at and at[n] < len(r) else None for n in names] for r in body], columns=names, dtype=object)

    found = spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, ", ".join(f"`{n}` string" for n in names))
    out = entries(found)
    return out.withColumn("problem", problem(F.col("standard_question"), F.col("similar_questions"), F.col("negative_questions"), F.col("answers")))


JSON = "array<struct<standard_question:string,similar_questions:array<string>,negative_questions:array<string>,answers:array<string>,answer_strategy:string,tags:array<string>>>"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a file that is one JSON array of objects."""
    whole = spark.read.option("wholetext", True).text(path)
    out = whole.select(F.explode(F.from_json("value", JSON)).alias("e")).select("e.*")
    lists = out.select("standard_question", *(F.coalesce(F.col(c), F.array()).alias(c) for c in LISTS), F.concat_ws(",", "tags").alias("category"), F.when(F.col("answer_strategy").isin("all", "random"), F.col("answer_strategy")).otherwise("all").alias("answer_strategy"))
    return lists.withColumn("problem", problem(F.col("standard_question"), F.col("similar_questions"), F.col("negative_questions"), F.col("answers")))


def content(standard: Column, answers: Column) -> Column:
    """The text of an entry's chunk."""
    return F.concat_ws("\n", F.concat(F.lit("Q: "), standard), F.transform(answers, lambda a: F.concat(F.lit("A: "), a)))
