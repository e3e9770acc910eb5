"""Compositions that build datasets, and the checks around them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import normalize_trivia, slice_text, token_spans
from quern.operators import qa_datasets

#: The types of questions.
QUESTION_TYPES = ("yesno", "factoid", "list", "summary")


def checked(rows: DataFrame, fine: Column, message: str) -> DataFrame:
    """The rows, or an error where one isn't fine."""
    return rows.where(F.assert_true(fine, F.lit(message)).isNull())


def typed_questions(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions (id, query), answers) of records (id, type, body, ...) without summaries; a repeated id or an unknown type is an error."""
    repeats = records.groupBy("id").agg(F.count("*").alias("n"))
    once = checked(repeats, F.col("n") == 1, "a question id twice").select("id")
    known = checked(records, F.col("type").isin(*QUESTION_TYPES), "unknown question type").join(once, "id", "left_semi").where("type != 'summary'")
    return known.select("id", F.col("body").alias("query")), known


def abstract_documents(records: DataFrame) -> DataFrame:
    """(name, text) of records (pmid, title, abstract_sections): title and sections by lines; an id that is no number, or is repeated, is an error."""
    one = records.groupBy("pmid").agg(F.count("*").alias("n"), F.first(F.struct("title", "abstract_sections")).alias("r"))
    rows = checked(one, (F.col("n") == 1) & F.col("pmid").rlike("^[0-9]+$"), "invalid or repeated document id")
    return rows.select(F.concat("pmid", F.lit(".txt")).alias("name"), F.array_join(F.concat(F.array("r.title"), F.col("r.abstract_sections")), "\n").alias("text"))


def votes_from_json(rows: DataFrame) -> DataFrame:
    """(id, position, span, votes) of rows (id, answers, ranges): the JSON map of validated answers, in its order; where that is empty, each of the annotators' ranges is a vote."""
    entries = F.map_entries(F.from_json("answers", T.MapType(T.StringType(), T.LongType())))
    validated = rows.where(F.length("answers") > 0).select("id", F.posexplode(entries).alias("position", "e")).select("id", F.col("position").cast("bigint").alias("position"), F.col("e.key").alias("span"), F.col("e.value").alias("votes"))
    plain = rows.where(F.coalesce(F.length("answers"), F.lit(0)) == 0).select("id", F.posexplode(F.split("ranges", "[|,]")).alias("position", "span"))
    counted = plain.groupBy("id", "span").agg(F.min("position").cast("bigint").alias("position"), F.count("*").alias("votes"))
    return validated.unionByName(counted)


def evidence_labels(passages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, doc_id, spans): passages (doc_id, title, position, passage) serialised, and the spans of wanted passages (query_id, doc_id, position)."""
    return qa_datasets.evidence(wanted, qa_datasets.serialized(passages)[1])


def chunk_text(text: Column, parts: Column) -> Column:
    """A chunk's text; where it wasn't fetched, its non-empty parts with blank lines between."""
    return F.coalesce(text, F.array_join(F.filter(parts, lambda p: F.coalesce(F.length(p), F.lit(0)) > 0), "\n\n"))


def tokens_of_span(text: Column, start: Column, end: Column) -> Column:
    """struct(first, last): the tokens [first, last) that overlap characters [start, end); null where none does."""
    at = F.filter(F.transform(token_spans(text), lambda s, i: F.when((s["end"] > start) & (s["start"] < end), i)), lambda i: i.isNotNull())
    return F.when(F.size(at) > 0, F.struct(F.array_min(at).alias("first"), (F.array_max(at) + 1).alias("last")))


def window_text(text: Column, first: Column, last: Column) -> Column:
    """The characters from the first to the last of tokens [first, last)."""
    spans = token_spans(text)
    return slice_text(text, F.get(spans, first)["start"], F.get(spans, last - 1)["end"])


def run_id(chunk_id: Column, first: Column, last: Column) -> Column:
    return F.concat(chunk_id.cast("string"), F.lit("::dedup_"), first.cast("string"), F.lit("_"), last.cast("string"))


def without_keys(rows: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Rows without transient columns, present or not."""
    return rows.drop(*keys)


def first_rows(rows: DataFrame, key: str, n: int | None) -> DataFrame:
    """The first n rows by key, or all."""
    return rows if n is None else rows.orderBy(key).limit(n)


def difference_examples(left: DataFrame, right: DataFrame, key: str, n: int = 10) -> DataFrame:
    """(side, id): at most n ids of each side alone, the least ones."""
    rows = qa_datasets.id_difference(left, right, key)
    of = lambda side: rows.where(F.col("side") == side).orderBy("id").limit(n)
    return of("left").unionAll(of("right"))


def timing_summary(rows: DataFrame, name: str, seconds: str) -> DataFrame:
    """(name, n, total, mean, per_second) of timed steps."""
    total = F.sum(seconds)
    return rows.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n"), F.round(total, 4).alias("total"), F.round(F.avg(seconds), 6).alias("mean"), F.round(F.count("*") / F.nullif(total, F.lit(0.0)), 6).alias("per_second"))


def trivia_references(answers: Column, aliases: Column, human: Column) -> Column:
    """The references of a trivia question: its answers, else the normalised aliases and the normalised human answers."""
    more = F.concat(F.coalesce(aliases, F.array().cast("array<string>")), F.transform(F.coalesce(human, F.array().cast("array<string>")), normalize_trivia))
    return F.when(F.coalesce(F.size(answers), F.lit(0)) > 0, answers).otherwise(F.array_distinct(more))


def validate_centre_unit(splitter: str, unit: str) -> None:
    if splitter == "sentence" and unit not in ("subchunk", "subchunk_only"):
        raise ValueError("sentences can only be the centre of subchunk windows")


def validate_budget(budget: int, tokenizer: str, manifest: dict) -> None:
    if budget <= 0:
        raise ValueError("the budget must be positive")
    if manifest.get("tokenizer_name") != tokenizer:
        raise ValueError(f"counts were stored with {manifest.get('tokenizer_name')!r}, not {tokenizer!r}")


def verified_file(spark, path: str, size: int, sha256: str) -> DataFrame:
    """(path, size, sha256) of a file; another size or digest is an error."""
    rows = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    return checked(rows, (F.col("size") == size) & (F.col("sha256") == sha256), f"{path} isn't the expected file")
