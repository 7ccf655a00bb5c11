"""Splitting a page sequence into documents, and rule-based classification of pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered


def clean_classifications(df: DataFrame, split: str = "split") -> DataFrame:
    """Keep page, type and split; a missing split becomes an empty record."""
    empty = F.struct(F.lit(None).cast("string").alias("markdown"))
    return df.withColumn(split, F.coalesce(F.col(split), empty))


def page_runs(pages: DataFrame, bundle: list[str], order: list[str], order_value: Column, kind: str = "doc_type",
              **sizes) -> DataFrame:
    """Adjacent pages of one type form a document ``<type>_<k>``; k counts the runs of the bundle from 1."""
    numbered = ordered.run_numbers(pages, bundle, order, order_value, kind, "run", **sizes)
    return numbered.withColumn("doc_name", F.concat_ws("_", F.col(kind), F.col("run").cast("string")))


def split_summary(runs: DataFrame, bundle: list[str], page: str, kind: str = "doc_type") -> DataFrame:
    """First and last page (from 1) and page count per split document."""
    return runs.groupBy(*bundle, "run", "doc_name", kind).agg(
        (F.min(page) + 1).alias("first_page"), (F.max(page) + 1).alias("last_page"), F.count(F.lit(1)).alias("page_count")
    )


def split_markdown(runs: DataFrame, bundle: list[str], page: str, text: str, rows_per_part: int = 1000, **sizes) -> DataFrame:
    """Pages of each split document joined with blank lines, in parts of bounded size (see ``ordered.joined_text``)."""
    return ordered.joined_text(runs, [*bundle, "run", "doc_name"], page, text, "markdown", rows_per_part, **sizes)


def class_scores(text: Column, rules: dict[str, dict[str, int]]) -> dict[str, Column]:
    """Score per class: weight times number of matches of each pattern, over the whole text."""
    return {
        name: reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(p)) * w for p, w in patterns.items()])
        for name, patterns in rules.items()
    }


def best_class(scores: dict[str, Column], default: str = "unknown") -> Column:
    """Class of the highest score; the first listed wins a tie, no score gives the default."""
    top = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    choice = F.when(top <= 0, default)
    for name, score in scores.items():
        choice = choice.when(score == top, name)
    return choice
