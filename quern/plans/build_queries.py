"""Registered queries of encoders, dataset builds and record helpers; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import records as R
from quern.functions import text as T
from quern.operators import builds, catalogue, chunking, encoding, prompting, qa_datasets, regions, selection
from quern.plans.queries import _TITLED, _n, _titled, _toks, query, table

_UNIT = "greatest(sqrt(a * a + e * e + i * i + o * o), 1.1920928955078125e-07)"


def _dense_sql(source: str, text: str) -> str:
    count = lambda c: f"(length({text}) - length(replace({text}, '{c}', '')))::DOUBLE AS {c}"
    return f"SELECT id, round(a / {_UNIT}, 6) AS a, round(e / {_UNIT}, 6) AS e, round(i / {_UNIT}, 6) AS i, round(o / {_UNIT}, 6) AS o FROM (SELECT id, {', '.join(map(count, encoding.LETTERS))} FROM {source})"


def _columns(vectors):
    return vectors.select("id", *(F.round(F.get("vector", F.lit(k)), 6).alias(c) for k, c in enumerate(encoding.LETTERS)))


@query(_dense_sql("(SELECT doc_id AS id, coalesce(text, '') AS text FROM documents)", "text"))
def dense_embedding(spark, sf_dir):
    return _columns(encoding.embedded(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")))


@query(_dense_sql("(SELECT item_id AS id, 'query: ' || coalesce(text, '') AS text FROM benchmark)", "text"))
def query_embedding(spark, sf_dir):
    return _columns(encoding.embedded(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), prefix="query: "))


_VALID = r"list_filter({0}, lambda t: regexp_matches(t, '^[A-Za-z0-9\x{{80}}-\x{{10FFFF}}]'))"


@query(f"SELECT conv_id * 1000 + turn AS id, count(*) AS vectors, sum(length(t) - length(replace(t, 'a', '')))::DOUBLE AS a FROM (SELECT conv_id, turn, unnest({_VALID.format(_toks('text'))}) AS t FROM conversations) GROUP BY 1")
def token_embedding(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    rows = encoding.document_vectors(encoding.token_embedded(c))
    return rows.groupBy("id").agg(F.count("*").alias("vectors"), F.sum(F.get("vector", F.lit(0))).alias("a"))


@query(
    f"""WITH x AS (SELECT item_id AS id, unnest({_VALID.format(_toks("text"))}) AS t, unnest({_VALID.format(_toks("left(text, 40)"))}) AS s FROM benchmark)
    SELECT id, count(s) AS vectors FROM x GROUP BY id HAVING count(s) > 0"""
)
def centre_span_vectors(spark, sf_dir):
    """Of each item the tokens that overlap its first forty characters."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    rows = encoding.document_vectors(encoding.token_embedded(b).withColumn("from", F.lit(0)).withColumn("to", F.lit(40)), "from", "to")
    return rows.groupBy("id").agg(F.count("*").alias("vectors"))


@query(f"SELECT item_id, greatest(24, least(40, {_n('text')} + 3))::BIGINT AS n FROM benchmark")
def query_lengths(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", encoding.query_length(T.token_count(F.col("text")), 24, 40).cast("bigint").alias("n"))


@query("SELECT conv_id AS doc_id, 0::BIGINT AS \"window\", min(turn) AS first, max(turn) AS last, count(*) AS units FROM conversations GROUP BY conv_id")
def whole_documents(spark, sf_dir):
    return chunking.chunks(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal")), None)


@query("SELECT DISTINCT doc_id, doc_id AS subchunk_id, text, n_chars AS tokens FROM documents WHERE length(text) > 0")
def unique_subchunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("subchunk_id"), "text", F.col("n_chars").alias("tokens"))
    return chunking.unique_subchunks(d.unionAll(d))


@query("SELECT conv_id AS doc_id FROM conversations GROUP BY conv_id HAVING count(DISTINCT text) > 1")
def context_conflicts(spark, sf_dir):
    return qa_datasets.conflicting_contexts(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "text"))


@query(
    """WITH x AS (SELECT doc_id, n_chars AS n, n_chars // 3 AS s, least(n_chars // 3 + 20, n_chars) AS e FROM documents), y AS (SELECT *, greatest(177 - (e - s), 0) AS room FROM x)
    SELECT doc_id, greatest(s - room // 2, 0)::BIGINT AS first, least(e + (room - room // 2), n)::BIGINT AS last FROM y"""
)
def fixed_windows(spark, sf_dir):
    n = F.col("n_chars")
    s = F.floor(n / 3)
    first, last = regions.fixed_window(s, F.least(s + 20, n), n, 180)
    return table(spark, sf_dir, "documents").select("doc_id", first.cast("bigint").alias("first"), last.cast("bigint").alias("last"))


@query("SELECT conv_id, turn FROM conversations WHERE turn % 3 <> 0")
def answerable_questions(spark, sf_dir):
    ranges = F.when(F.col("turn") % 3 == 0, "None|None").when(F.col("turn") % 3 == 1, "None|3:9").otherwise("0:4,7:9|None")
    return qa_datasets.answerable(table(spark, sf_dir, "conversations").withColumn("ranges", ranges)).select("conv_id", "turn")


@query(
    f"""WITH {_TITLED}, x AS (SELECT doc_id, title, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS position FROM pg),
    y AS (SELECT doc_id, position, length(title) + 1 + coalesce(sum(length(p) + 2) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, length(p) AS n FROM x)
    SELECT doc_id * 10 AS query_id, doc_id, string_agg(s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s) AS spans FROM y WHERE position % 2 = 0 GROUP BY doc_id"""
)
def evidence_labels(spark, sf_dir):
    """A question for each document, that wants its even passages."""
    p = _titled(spark, sf_dir)
    wanted = p.where("position % 2 = 0").select((F.col("doc_id") * 10).alias("query_id"), "doc_id", "position")
    rows = builds.evidence_labels(p, wanted)
    return rows.select("query_id", "doc_id", F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("bigint").cast("string"), x["end"].cast("bigint").cast("string"))), ",").alias("spans"))


@query("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS safe, regexp_full_match(url, '[A-Za-z0-9._-]+') AS is_safe, CASE WHEN page_id % 2 = 0 THEN page_id END AS number, page_id % 6 IN (0, 2, 4) AS flag FROM pages")
def name_helpers(spark, sf_dir):
    name = F.concat(F.when(F.col("page_id") % 2 == 0, "doc_").otherwise("page_"), F.col("page_id").cast("string"), F.lit(".txt"))
    said = F.get(F.array(*map(F.lit, (" TRUE ", "no", "1", "off", "Yes", ""))), (F.col("page_id") % 6).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", T.safe_name(F.col("url")).alias("safe"), T.is_safe_id(F.col("url")).alias("is_safe"), T.document_number(name).alias("number"), T.as_boolean(said).alias("flag"))


@query("SELECT conv_id, turn, coalesce(text, '') AS prediction FROM conversations")
def prediction_field(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("output"), F.col("role").alias("answer"))
    return c.select("conv_id", "turn", R.prediction(c).alias("prediction"))


@query("SELECT conv_id, turn, CASE WHEN list_position(ids, 3) > 0 THEN list_position(ids, 3) ELSE len(ids) END::BIGINT AS n FROM (SELECT conv_id, turn, list_transform(range(1, turn + 4), lambda x: (x * 7 + conv_id) % 5) AS ids FROM conversations)")
def generated_counts(spark, sf_dir):
    ids = F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("turn") + 3), lambda x: (x * 7 + F.col("conv_id")) % 5)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", prompting.generated_count(ids, 3).alias("n"))


@query(
    """WITH z AS (SELECT conv_id AS chunk_id, count(*) AS size FROM conversations GROUP BY 1), s AS (SELECT conv_id AS chunk_id, turn * 2 AS index FROM conversations WHERE turn % 3 = 1),
    v AS (SELECT DISTINCT chunk_id, index FROM s JOIN z USING (chunk_id) WHERE index >= 0 AND index < size)
    SELECT chunk_id, index FROM v UNION ALL SELECT chunk_id, 0 FROM z WHERE chunk_id NOT IN (SELECT chunk_id FROM v)"""
)
def selection_fallback(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    sizes = c.groupBy(F.col("conv_id").alias("chunk_id")).agg(F.count("*").alias("size"))
    chosen = c.where("turn % 3 = 1").select(F.col("conv_id").alias("chunk_id"), (F.col("turn") * 2).alias("index"))
    return selection.fallback_first(sizes, chosen).select("chunk_id", F.col("index").cast("bigint").alias("index"))


@query("SELECT doc_id AS chunk_id, (p - 1)::INTEGER AS region_id, doc_id * 8 + s AS start, doc_id * 8 + e AS \"end\" FROM (SELECT doc_id, unnest([1, 2, 3]) AS p, unnest([0, 2, 5]) AS s, unnest([3, 6, 8]) AS e FROM labels)")
def region_unpack(spark, sf_dir):
    x = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("chunk_id"), (F.col("doc_id") * 8).alias("subchunk_start"), (F.col("doc_id") * 8 + 8).alias("subchunk_end"), F.array(*map(F.lit, (0, 2, 5))).alias("region_starts"), F.array(*map(F.lit, (3, 6, 8))).alias("region_ends")
    )
    return chunking.unpacked_regions(x)


@query("SELECT DISTINCT conv_id AS query_id FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels)")
def unjudged_queries(spark, sf_dir):
    return qa_datasets.without_judgements(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id")), table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id")))


@query("SELECT item_id AS id, text AS query FROM benchmark WHERE item_id % 4 <> 3")
def typed_questions(spark, sf_dir):
    kind = F.get(F.array(*map(F.lit, builds.QUESTION_TYPES)), (F.col("item_id") % 4).cast("int"))
    return builds.typed_questions(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), kind.alias("type"), F.col("text").alias("body")))[0]


@query("SELECT doc_id || '.txt' AS name, source || chr(10) || lang || chr(10) || text AS text FROM (SELECT DISTINCT doc_id, source, lang, text FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL)")
def abstract_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null and lang is not null and source is not null")
    return builds.abstract_documents(d.select(F.col("doc_id").cast("string").alias("pmid"), F.col("source").alias("title"), F.array("lang", "text").alias("abstract_sections")))


@query(
    """SELECT doc_id AS id, CASE WHEN doc_id % 4 = 1 THEN '1:5' ELSE '2:9' END AS span, CASE WHEN doc_id % 4 = 1 THEN 3 ELSE 2 END::BIGINT AS votes, CASE WHEN doc_id % 4 = 1 THEN 4 ELSE 3 END::BIGINT AS total
    FROM labels WHERE doc_id % 4 IN (1, 3)"""
)
def consensus_from_json(spark, sf_dir):
    k = F.col("doc_id") % 4
    answers = F.when(k == 0, '{"none": 3, "1:5": 1}').when(k == 1, '{"bad_question": 1, "1:5": 3}').when(k == 2, '{"1:5": 1, "2:6": 1, "3:7": 1}').otherwise("")
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), answers.alias("answers"), F.lit("2:9|None,2:9").alias("ranges"))
    return qa_datasets.consensus(builds.votes_from_json(rows)).select("id", "span", "votes", "total")


@query("SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN min(role) ELSE string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE length(text) > 0) END AS text FROM conversations GROUP BY conv_id")
def chunk_texts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("role").alias("role"), F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("parts"))
    return c.select("conv_id", builds.chunk_text(F.when(F.col("conv_id") % 2 == 0, F.col("role")), F.col("parts")).alias("text"))


@query(f"SELECT conv_id, turn, 0 AS first, {_n('left(text, 25)')}::INTEGER AS last FROM conversations WHERE {_n('left(text, 25)')} > 0")
def span_tokens(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", builds.tokens_of_span(F.col("text"), F.lit(0), F.lit(25)).alias("s")).where("s is not null")
    return c.select("conv_id", "turn", "s.first", "s.last")


@query(f"SELECT conv_id, turn, array_to_string({_toks('text')}[3:8], '') AS compact FROM conversations WHERE {_n('text')} >= 8")
def window_texts(spark, sf_dir):
    """Tokens 2 to 7 of a text as it has them; compared without spaces."""
    c = table(spark, sf_dir, "conversations").where(T.token_count(F.col("text")) >= 8)
    return c.select("conv_id", "turn", F.regexp_replace(builds.window_text(F.col("text"), F.lit(2), F.lit(8)), r"[ \t\n\x0B\f\r]", "").alias("compact"))


@query("SELECT * FROM (SELECT 'left' AS side, conv_id AS id FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id NOT IN (SELECT doc_id FROM labels) ORDER BY conv_id LIMIT 10) UNION ALL SELECT * FROM (SELECT 'right', doc_id FROM (SELECT DISTINCT doc_id FROM labels) WHERE doc_id NOT IN (SELECT conv_id FROM conversations) ORDER BY doc_id LIMIT 10)")
def difference_examples(spark, sf_dir):
    return builds.difference_examples(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id")


@query("SELECT event_type AS name, count(*) AS n, round(sum(v), 4) AS total, round(avg(v), 6) AS mean, round(count(*) / nullif(sum(v), 0), 6) AS per_second FROM (SELECT event_type, round(value, 2)::DECIMAL(18, 2)::DOUBLE AS v FROM events) GROUP BY event_type")
def timing_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.round("value", 2).cast("decimal(18,2)").cast("double").alias("seconds"))
    return builds.timing_summary(e, "event_type", "seconds")


@query("SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 25")
def first_questions(spark, sf_dir):
    return builds.first_rows(table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", 25)


@query("SELECT conv_id, turn, conv_id || '::dedup_' || turn || '_' || (turn + 3) AS run FROM conversations")
def run_ids(spark, sf_dir):
    c = builds.without_keys(table(spark, sf_dir, "conversations"), ["text", "role", "token_budget"])
    return c.select("conv_id", "turn", builds.run_id(F.col("conv_id"), F.col("turn"), F.col("turn") + 3).alias("run"))


@query("SELECT doc_id, min(vec_id) AS start FROM (SELECT vec_id, vec_id % 7 AS doc_id FROM embeddings) GROUP BY doc_id")
def documents_by_first_id(spark, sf_dir):
    return catalogue.ordered_by_first(table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 7).alias("doc_id"), F.col("vec_id").alias("subchunk_id")))


@query(
    """WITH q AS (SELECT conv_id, list({'id': conv_id * 1000 + turn, 'question': text} ORDER BY turn) AS qs, first(role ORDER BY turn) AS context FROM conversations GROUP BY conv_id)
    SELECT x.id AS id, x.question AS question, conv_id AS document_id, context FROM (SELECT conv_id, context, unnest(qs) AS x FROM q)"""
)
def flattened_questions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    answers = F.array().cast("array<struct<text:string,answer_start:bigint>>")
    q = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"), F.min_by("role", "turn").alias("context"))
    qas = F.transform("t", lambda x: F.struct((F.col("conv_id") * 1000 + x["turn"]).alias("id"), x["text"].alias("question"), answers.alias("answers")))
    nested = q.select(F.array(F.struct(F.col("conv_id").alias("document_id"), "context", qas.alias("qas"))).alias("paragraphs"))
    return qa_datasets.flattened(nested).drop("answers")
