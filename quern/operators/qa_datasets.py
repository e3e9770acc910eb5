"""Building of question-answering datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import slice_text, url_tail


def serialized(passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text) and spans (doc_id, position, start, end) of passages (doc_id, title, position, passage).

    A document is its title, a line end, and the passages with blank lines between; spans are
    half open, in characters.
    """
    by = Window.partitionBy("doc_id").orderBy("position")
    before = F.coalesce(F.sum(F.length("passage") + 2).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = passages.select("doc_id", "position", (F.length("title") + 1 + before).alias("start"), F.length("passage").alias("n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "passage"))), lambda x: x["passage"]), "\n\n")
    texts = passages.groupBy("doc_id").agg(F.concat(F.first("title"), F.lit("\n"), body).alias("text"))
    return texts, spans.select("doc_id", "position", "start", (F.col("start") + F.col("n")).alias("end"))


def evidence(questions: DataFrame, spans: DataFrame) -> DataFrame:
    """(query_id, doc_id, spans): the spans of each question's wanted passages (query_id, doc_id, position); two documents for one question are an error."""
    rows = questions.join(spans, ["doc_id", "position"])
    out = rows.groupBy("query_id").agg(F.countDistinct("doc_id").alias("d"), F.min("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    return out.where(F.assert_true(F.col("d") == 1, F.lit("evidence in two documents")).isNull()).drop("d")


def intersected(left: DataFrame, right: DataFrame) -> DataFrame:
    """(local_id, question, left_id, right_id): questions of both sides; repeats on a side are an error, order and numbers follow the left.

    left (left_id, question), right (right_id, question).
    """
    one = lambda df, c: df.groupBy("question").agg(F.count("*").alias("n"), F.min(c).alias(c)).where(F.assert_true(F.col("n") == 1, F.lit("a question twice")).isNull()).drop("n")
    rows = one(left, "left_id").join(one(right, "right_id"), "question")
    from quern.operators.chunking import dense_ids

    numbered = dense_ids(rows.select(F.col("left_id").alias("doc_id"), F.lit(0).alias("ordinal"), "question", "right_id"))
    return numbered.select(F.col("subchunk_id").alias("local_id"), "question", F.col("doc_id").alias("left_id"), "right_id")


def kept_judgements(judgements: DataFrame, selected: DataFrame) -> DataFrame:
    """judgements (query_id, doc_id, score) of the selected queries; a score under 1 or a repeat is an error."""
    rows = judgements.join(selected.select("query_id").distinct(), "query_id", "left_semi")
    one = rows.groupBy("query_id", "doc_id").agg(F.count("*").alias("n"), F.min("score").alias("score"))
    return one.where(F.assert_true((F.col("n") == 1) & (F.col("score") > 0), F.lit("a judgement is repeated or not positive")).isNull()).drop("n")


def without_judgements(judgements: DataFrame, selected: DataFrame) -> DataFrame:
    return selected.select("query_id").distinct().join(judgements, "query_id", "left_anti")


def clipped_spans(rows: DataFrame) -> DataFrame:
    """rows (id, ranges, length) to (id, position, span, start, end): "s:e" tokens of a list, clipped to the text; empty ones go, other tokens stay without numbers."""
    parts = rows.select("id", "length", F.posexplode(F.split("ranges", "[,|]")).alias("position", "span"))
    number = lambda k: F.regexp_extract("span", r"^(\d+):(\d+)$", k)
    is_range = F.col("span").rlike(r"^\d+:\d+$")
    bound = lambda k: F.when(is_range, F.least(number(k).cast("bigint"), F.col("length")))
    out = parts.select("id", "position", "span", bound(1).alias("start"), bound(2).alias("end"))
    return out.where(F.col("start").isNull() | (F.col("start") < F.col("end")))


def consensus(votes: DataFrame) -> DataFrame:
    """(id, span, votes, total) of votes (id, position, span, votes): the span of most votes, the first among equals, if it has half of all and is an answer."""
    by = Window.partitionBy("id").orderBy(F.desc("votes"), "position")
    rows = votes.withColumn("n", F.row_number().over(by)).withColumn("total", F.sum("votes").over(Window.partitionBy("id"))).where("n = 1")
    return rows.where((F.col("votes") * 2 >= F.col("total")) & ~F.col("span").isin("none", "bad_question")).select("id", "span", "votes", "total")


def answerable(rows: DataFrame, column: str = "ranges") -> DataFrame:
    """Rows of which some annotator gave a range."""
    return rows.where(F.exists(F.split(column, r"\|"), lambda x: x != "None"))


def offset_audit(rows: DataFrame) -> DataFrame:
    """rows (id, context, answer, start) with matches: does the context hold the answer there?"""
    there = slice_text(F.col("context"), F.col("start"), F.col("start") + F.length("answer"))
    return rows.withColumn("matches", there == F.col("answer"))


def flattened(articles: DataFrame) -> DataFrame:
    """Questions of nested records (paragraphs[]{document_id, context, qas[]{id, question, answers[]{text, answer_start}}}), with their parents' fields."""
    p = articles.select(F.explode("paragraphs").alias("p"))
    q = p.select("p.document_id", "p.context", F.explode("p.qas").alias("q"))
    return q.select("q.id", "q.question", "q.answers", "document_id", "context")


def id_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, id): ids of one side alone."""
    a, b = left.select(F.col(key).alias("id")).distinct(), right.select(F.col(key).alias("id")).distinct()
    only = lambda x, y, name: x.join(y, "id", "left_anti").select(F.lit(name).alias("side"), "id")
    return only(a, b, "left").unionAll(only(b, a, "right"))


def linked_ids(rows: DataFrame, column: str) -> DataFrame:
    """(tail, times): decimal tails of the addresses in an array column."""
    return rows.select(F.explode(column).alias("url")).select(url_tail(F.col("url")).alias("tail")).where("tail is not null").groupBy("tail").agg(F.count("*").alias("times"))


def conflicting_contexts(rows: DataFrame) -> DataFrame:
    """Documents (doc_id) that come with two texts."""
    return rows.groupBy("doc_id").agg(F.countDistinct("text").alias("n")).where("n > 1").select("doc_id")


def decoded_story(raw, extra_lines: int = 0):
    """The story of a raw file (a Column): up to the highlight mark, without trailing blank and copyright lines."""
    lines = F.split(F.substring_index(raw, "@highlight", 1), "\n")
    filled = F.filter(F.transform(lines, lambda x, i: F.when((F.trim(x) != "") & ~F.lower(x).contains("copyright"), i)), lambda i: i.isNotNull())
    kept = F.slice(lines, 1, F.coalesce(F.array_max(filled), F.lit(-1)) + 1)
    return F.concat(F.array_join(kept, "\n"), F.lit("\n" * extra_lines))
