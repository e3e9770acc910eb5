"""Fields of prediction and answer records that may have several names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of a prediction's field, by priority.
PREDICTION_FIELDS = ("prediction", "pred", "output", "generated_answer", "answer", "answers")


def text_list(df: DataFrame, name: str) -> Column:
    """A field as array<string>: null is one empty text, a scalar one text, nested arrays are flattened, records become JSON."""
    kind, value = df.schema[name].dataType, F.col(name)
    while isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        value, kind = F.flatten(value), kind.elementType
    as_text = lambda x, k: F.to_json(x) if isinstance(k, (T.StructType, T.MapType)) else x.cast("string")
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.transform(value, lambda x: F.coalesce(as_text(x, kind.elementType), F.lit(""))), F.array(F.lit("")))
    return F.array(F.coalesce(as_text(value, kind), F.lit("")))


def prediction(df: DataFrame) -> Column:
    """The first of the prediction's fields that the records have."""
    for name in PREDICTION_FIELDS:
        if name in df.columns:
            return F.coalesce(F.get(text_list(df, name), F.lit(0)), F.lit(""))
    raise ValueError(f"a prediction needs one of {PREDICTION_FIELDS}")


def truths(df: DataFrame, scalar: bool = False) -> Column:
    """The references: of `answers`, else of `answer`; scalar: the other way round."""
    for name in ("answer", "answers") if scalar else ("answers", "answer"):
        if name in df.columns:
            return text_list(df, name)
    raise ValueError("a record needs answer or answers")
