"""Sentences and smaller units of documents.

The default segmenter ends a sentence behind . ! ? before white space, and at line ends; the
sentence tokenizer of a deployment can be given instead.  Tokens never straddle sentences,
so token spans are running sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import SPACE_CLASS, TOKEN, prompt_token_count, stripped, token_count, tokens

#: Ends of text behind which a sentence goes on, and initials.
TITLES = r"(?:\b(?:v|vs|No|Mr|Mrs|Ms|Dr|Prof|Sr|Jr)|\b(?:U\.S|U\.K|D\.C))\.$"
INITIALS = r"^(?:[A-Z]\.\s*){1,3}$"
ONE_LETTER_END = r"(?:\b[A-Z]\.|\b[a-z]\.)$"
#: Fixed value: a web address.
URL = r"(?i)\bhttps?://[^\s<>\"']+"


def _units(x: Column) -> Column:
    return F.filter(F.transform(x, stripped), lambda s: s != "")


def sentences(text: Column) -> Column:
    """array<string>: the sentences of a text, stripped; a text of one unit is that unit."""
    return _units(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])[ \t]+", "$1\n"), "\n"))


def continues(previous: Column) -> Column:
    """Does the sentence go on behind `previous`? It ends in a title or abbreviation, or is short and ends in an initial."""
    short = F.size(F.split(previous, r"\s+")) <= 3
    return previous.rlike(TITLES) | (short & (previous.rlike(INITIALS) | previous.rlike(ONE_LETTER_END)))


def merged_sentences(units: Column) -> Column:
    """Sentences with those that continue joined by a space; the test sees all text joined so far."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(state: Column, unit: Column) -> Column:
        on = F.coalesce(continues(state["open"]), F.lit(False))
        done = F.when(on | state["open"].isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))
        return F.struct(done.alias("done"), F.when(on, F.concat_ws(" ", state["open"], unit)).otherwise(unit).alias("open"))

    return F.aggregate(units, start, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def blank_line_units(text: Column) -> Column:
    return _units(F.split(text, r"\n{2,}"))


def url_units(text: Column) -> Column:
    """Web addresses as units of their own, the text around them kept."""
    return _units(F.split(F.regexp_replace(text, f"({URL})", "\u0000$1\u0000"), "\u0000"))


def located(text: Column, units: Column) -> Column:
    """array<struct<text, start, end>>: character spans of units that stand in the text in order."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int,end:int>>").alias("out"))

    def step(state: Column, unit: Column) -> Column:
        start = F.position(unit, text, state["at"] + 1) - 1
        end = start + F.length(unit)
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(unit.alias("text"), start.alias("start"), end.alias("end")))).alias("out"))

    return F.aggregate(units, zero, step, lambda s: s["out"])


def subchunks(documents: DataFrame, split: Callable[[Column], Column] = sentences, merge: bool = False, most: int | None = None) -> DataFrame:
    """(doc_id, ordinal, text, token_start, token_end, prompt_tokens): a document's units that have tokens; the ordinal counts all.

    most: units of more tokens are cut after every `most`; the pieces' texts are their tokens joined by spaces.
    """
    units = split(F.col("text"))
    units = merged_sentences(units) if merge else units
    rows = documents.select("doc_id", F.posexplode(units).alias("ordinal", "text"))
    if most is not None:
        cut = F.transform(F.sequence(F.lit(0), F.greatest((F.size("t") - 1) / most, F.lit(0)).cast("int")), lambda k: F.slice("t", k * most + 1, F.lit(most)))
        rows = rows.withColumn("t", tokens(F.col("text"))).select("doc_id", "ordinal", "text", F.size("t").alias("all"), F.posexplode(cut).alias("piece", "part"))
        rows = rows.select("doc_id", "ordinal", "piece", F.when(F.col("all") > most, F.array_join("part", " ")).otherwise(F.col("text")).alias("text"), F.size("part").cast("bigint").alias("tokens"))
    else:
        rows = rows.select("doc_id", "ordinal", F.lit(0).alias("piece"), "text", token_count(F.col("text")).alias("tokens"))
    from pyspark.sql import Window

    end = F.sum("tokens").over(Window.partitionBy("doc_id").orderBy("ordinal", "piece").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("token_end", end).withColumn("token_start", F.col("token_end") - F.col("tokens")).where("tokens > 0")
    return rows.select("doc_id", "ordinal", *(["piece"] if most is not None else []), "text", "token_start", "token_end", prompt_token_count(F.col("text")).alias("prompt_tokens"))


def unit_lengths(documents: DataFrame, split: Callable[[Column], Column] = sentences, merge: bool = False) -> DataFrame:
    """(doc_id, lengths): the tokens of each of a document's units in order, a row for each document of (doc_id, text)."""
    units = split(F.col("text"))
    return documents.select("doc_id", F.transform(merged_sentences(units) if merge else units, token_count).alias("lengths"))


def unit_counts(documents: DataFrame, split: Callable[[Column], Column] = sentences, merge: bool = False) -> DataFrame:
    """(doc_id, n): how many of a document's units have tokens; no unit is cut into them."""
    units = split(F.col("text"))
    return documents.select("doc_id", F.size(F.filter(merged_sentences(units) if merge else units, lambda u: u.rlike(TOKEN))).alias("n"))


def uncovered(documents: DataFrame, units: DataFrame) -> DataFrame:
    """(doc_id, source_chars, unit_chars, covered): do a document's units hold all of its characters that are no space?"""
    bare = lambda c: F.regexp_replace(c, f"[{SPACE_CLASS}]", "")
    joined = units.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "").alias("u"))
    rows = documents.select("doc_id", bare(F.coalesce("text", F.lit(""))).alias("s")).join(joined, "doc_id", "left").select("doc_id", "s", bare(F.coalesce("u", F.lit(""))).alias("u"))
    return rows.select("doc_id", F.length("s").cast("bigint").alias("source_chars"), F.length("u").cast("bigint").alias("unit_chars"), (F.col("s") == F.col("u")).alias("covered"))
