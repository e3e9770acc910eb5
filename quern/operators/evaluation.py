"""Scoring of predictions: joins with their checks, and averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.metrics import best, evaluator_of, exact_match, list_scores, squad_f1
from quern.functions.text import clean_prediction


def aligned(predictions: DataFrame, truths: DataFrame, strict: bool = True) -> DataFrame:
    """predictions (id, prediction) with truths (id, answers). Strict: an id on one side alone is an error."""
    if not strict:
        return predictions.join(truths, "id")
    both = predictions.withColumn("_p", F.lit(True)).join(truths.withColumn("_t", F.lit(True)), "id", "full")
    fine = F.assert_true(F.col("_p").isNotNull() & F.col("_t").isNotNull(), F.lit("predictions and answers have different ids"))
    return both.where(fine.isNull()).drop("_p", "_t")


def evaluated(rows: DataFrame, dataset: str | None, clean: bool = False) -> DataFrame:
    """rows (id, prediction, answers) with em and f1 by the dataset's evaluator."""
    p = F.coalesce("prediction", F.lit(""))
    em, f1 = evaluator_of(dataset)(clean_prediction(p) if clean else p, F.col("answers"))
    return rows.withColumn("em", em).withColumn("f1", f1)


def averages(scores: DataFrame, digits: int = 6) -> DataFrame:
    return scores.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("em"), F.lit(0.0)), digits).alias("em"), F.round(F.coalesce(F.avg("f1"), F.lit(0.0)), digits).alias("f1"))


def mismatches(scores: DataFrame, n: int = 10) -> DataFrame:
    """The first n rows without an exact match, by id."""
    return scores.where("em = 0").orderBy("id").limit(n).withColumn("f1", F.round("f1", 4))


def averages_by_type(scores: DataFrame, digits: int = 6) -> DataFrame:
    """(type, n, em, f1) for each type and, with a null type, over all; em is null where any row lacks it."""
    full = F.when(F.count("em") == F.count("*"), F.round(F.avg("em"), digits))
    grouped = scores.groupingSets([["type"], []], "type")
    return grouped.agg(F.count("*").alias("n"), full.alias("em"), F.round(F.avg("f1"), digits).alias("f1"))


def typed_scores(rows: DataFrame, overrides: dict | None = None) -> DataFrame:
    """rows (id, type, prediction, groups) scored by type: lists item by item, others against the best of all synonyms; summaries are left out."""
    overrides = overrides or {}
    if set(overrides) - {"factoid", "yesno", "list"}:
        raise ValueError("an override must name a known question type")
    known = F.assert_true(F.col("type").isin("factoid", "yesno", "list", "summary"), F.lit("unknown question type"))
    lists = list_scores(F.col("prediction"), F.col("groups"))
    flat = F.flatten("groups")
    em, f1 = best(exact_match, F.col("prediction"), flat), best(squad_f1, F.col("prediction"), flat)
    scored = {"list": (lists["em"], lists["f1"]), "factoid": (em, f1), "yesno": (em, f1)} | {k: f(F.col("prediction"), F.col("groups")) for k, f in overrides.items()}

    def pick(i: int):
        out = F.lit(None).cast("double")
        for kind, pair in scored.items():
            out = F.when(F.col("type") == kind, pair[i]).otherwise(out)
        return out

    return rows.where(known.isNull()).where("type != 'summary'").withColumn("em", pick(0)).withColumn("f1", pick(1))
