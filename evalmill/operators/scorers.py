"""Scorers by task: what a run uses to judge outputs, and how a caller brings one of its own.

A scorer is a function of the columns output, golds (array of strings) and lang that gives a struct; its field ``correct``
is the verdict.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmill.functions import scoring

Scorer = Callable[[Column, Column, Column], Column]


def numeric(output: Column, golds: Column, lang: Column) -> Column:
    """The last number of the output is the gold."""
    gold = scoring.parse_gold(F.element_at(golds, 1))
    return F.struct(scoring.numeric_match(output, gold).alias("correct"))


def spans(output: Column, golds: Column, lang: Column) -> Column:
    """The marked span holds a gold; with the strict match and F1 beside it."""
    s = scoring.span_scores(output, golds, lang)
    return F.struct(s["em"].alias("correct"), s["em_strict"].alias("em_strict"), s["f1"].alias("f1"))


SCORERS: dict[str, Scorer] = {"mgsm": numeric, "mgsm-canary": numeric, "mgsm-stuffed": numeric, "mrag": spans, "mrag-bp": spans}


def scorer_of(task: str, own: dict[str, Scorer] | None = None) -> Scorer:
    """The scorer of a task; ``own`` goes first; an unknown task is an error."""
    found = (own or {}).get(task) or SCORERS.get(task)
    if found is None:
        raise ValueError(f"no scorer for task {task}; known: {', '.join(sorted({*SCORERS, *(own or {})}))}")
    return found


def score(rows: DataFrame, task: str, own: dict[str, Scorer] | None = None) -> DataFrame:
    """``rows`` (output, golds, lang and more) with ``score`` by the task's scorer."""
    return rows.withColumn("score", scorer_of(task, own)(F.col("output"), F.col("golds"), F.col("lang")))
