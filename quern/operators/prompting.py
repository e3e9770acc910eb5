"""Prompts, their statistics, and answer generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import post_process, prompt_token_count, stripped, token_count, tokens

#: Fixed value: the instruction in front of a question.
SYSTEM_PROMPT = (
    "Answer the question using only the provided context.\n"
    "You may combine facts from different parts of the context, but do not use outside knowledge or guess missing facts.\n"
    'If the context does not provide enough information to answer the question, output exactly "Insufficient information".\n'
    "Otherwise, output only a short, direct answer.\n"
    "Do not include explanations or repeat the question."
)
#: A chat template of plain marks; a model's own can be given.
CHAT_TEMPLATE = "<|system|>\n{system}\n<|user|>\n{user}\n<|assistant|>\n"


def formatted_passages(passages: Column) -> Column:
    """Passages that aren't blank, each stripped, with a blank line behind."""
    return F.array_join(F.transform(F.filter(F.transform(passages, stripped), lambda p: p != ""), lambda p: F.concat(p, F.lit("\n\n"))), "")


def query_prompt(query: Column, system: str = SYSTEM_PROMPT) -> Column:
    return F.concat(F.lit(f"{system}\n\nQuestion: "), stripped(query), F.lit("\nAnswer:"))


def raw_prompt(query: Column, passages: Column, system: str = SYSTEM_PROMPT) -> Column:
    return F.concat(formatted_passages(passages), query_prompt(query, system))


def chat_prompt(query: Column, passages: Column, system: str = SYSTEM_PROMPT, template: str = CHAT_TEMPLATE, begin: str = "") -> Column:
    """The prompt by a chat template; a beginning mark of the template is dropped."""
    head, tail = template.replace("{system}", system).split("{user}")
    if begin and head.startswith(begin):
        head = head[len(begin) :]
    return F.concat(F.lit(head), F.lit("Context:\n"), formatted_passages(passages), F.lit("Question:\n"), stripped(query), F.lit(tail))


def left_truncated(x: Column, most: int) -> Column:
    """The last `most` tokens."""
    t = tokens(x)
    return F.slice(t, F.greatest(F.size(t) - most, F.lit(0)) + 1, F.lit(most))


def context_records(passages: Column) -> Column:
    return F.transform(passages, lambda p: F.struct(F.lit("").alias("title"), p.alias("text")))


def retained_passages(passages: DataFrame, room: DataFrame) -> DataFrame:
    """(query_id, retained): how many passages survive truncation from the left.

    passages (query_id, position, text) count from the end while they fit into room (query_id, tokens).
    """
    by = Window.partitionBy("query_id").orderBy(F.desc("position")).rowsBetween(Window.unboundedPreceding, 0)
    used = passages.withColumn("used", F.sum(prompt_token_count(F.col("text"))).over(by))
    return used.join(room.select("query_id", "tokens"), "query_id").groupBy("query_id").agg(F.sum((F.col("used") <= F.col("tokens")).cast("bigint")).alias("retained"))


def prompt_statistics(prompts: DataFrame, most: int) -> DataFrame:
    """(query_id, prompt_tokens, query_tokens, input_tokens) of prompts (query_id, prompt, query)."""
    n = token_count(F.col("prompt"))
    return prompts.select("query_id", n.alias("prompt_tokens"), token_count(query_prompt(F.col("query"))).alias("query_tokens"), F.least(n, F.lit(most)).alias("input_tokens"))


def generated_count(ids: Column, end: int) -> Column:
    """Generated tokens up to the first end token and with it, or all."""
    at = F.array_position(ids, end)
    return F.when(at > 0, at).otherwise(F.size(ids).cast("bigint"))


def extractive_answer(query: Column, passages: Column) -> Column:
    """A deterministic stand-in for a model: the passage that shares most words with the question, the first among equals."""
    words = F.array_distinct(F.transform(tokens(query), F.lower))
    scored = F.transform(passages, lambda p, i: F.struct(F.size(F.array_intersect(words, F.transform(tokens(p), F.lower))).alias("n"), (-i).alias("k"), p.alias("p")))
    return F.coalesce(F.array_max(scored)["p"], F.lit("Insufficient information"))


def generated(prompts: DataFrame, answer: Callable[[Column, Column], Column] = extractive_answer) -> DataFrame:
    """prompts (query_id, query, passages) with response and prediction."""
    rows = prompts.withColumn("response", answer(F.col("query"), F.col("passages")))
    return rows.withColumn("prediction", post_process(F.col("response")))
