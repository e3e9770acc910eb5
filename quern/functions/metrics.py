"""Answer metrics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import let, list_answer, normalize_answer, normalize_trivia, split_words

#: Answers that count only when equal.
CLOSED_ANSWERS = ("yes", "no", "noanswer")


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays of tokens."""
    times = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, t: s + F.least(times(a, t), times(b, t)))


def f1_of(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Token F1 of normalised texts."""

    def score(s: Column) -> Column:
        p, r = s["p"], s["r"]
        n = F.size(p) + F.size(r)
        return F.when(n == 0, F.lit(both_empty)).otherwise(2.0 * overlap(p, r) / n)

    return let(F.struct(split_words(a).alias("p"), split_words(b).alias("r")), score)


def token_f1(prediction: Column, truth: Column, both_empty: float = 1.0) -> Column:
    return f1_of(normalize_answer(prediction), normalize_answer(truth), both_empty)


def exact_match(prediction: Column, truth: Column) -> Column:
    return (normalize_answer(prediction) == normalize_answer(truth)).cast("double")


def hotpot_f1(prediction: Column, truth: Column) -> Column:
    """Token F1, but yes / no answers count only when equal."""

    def score(s: Column) -> Column:
        closed = (s["p"].isin(*CLOSED_ANSWERS) | s["t"].isin(*CLOSED_ANSWERS)) & (s["p"] != s["t"])
        return F.when(closed, 0.0).otherwise(f1_of(s["p"], s["t"]))

    return let(F.struct(normalize_answer(prediction).alias("p"), normalize_answer(truth).alias("t")), score)


def best(score, prediction: Column, truths: Column) -> Column:
    """The largest score over several references."""
    return F.array_max(F.transform(truths, lambda t: score(prediction, t)))


def squad_f1(prediction: Column, truth: Column) -> Column:
    return token_f1(prediction, truth, 0.0)


def trivia_em(prediction: Column, truth: Column) -> Column:
    return (normalize_trivia(prediction) == normalize_trivia(truth)).cast("double")


def trivia_f1(prediction: Column, truth: Column) -> Column:
    return f1_of(normalize_trivia(prediction), normalize_trivia(truth))


def conditional(score, prediction: Column, truths: Column) -> Column:
    """One prediction against several required answers, the others left empty: the best assignment in closed form, times the length factor (1, as predictions are padded to the answers)."""
    base = F.transform(truths, lambda t: score(F.lit(""), t))
    gain = F.transform(truths, lambda t: score(prediction, t) - score(F.lit(""), t))
    total = F.aggregate(base, F.lit(0.0), lambda s, x: s + x)
    some = (total + F.when(prediction == "", 0.0).otherwise(F.array_max(gain))) / F.size(truths)
    return F.when(F.size(truths) == 0, (prediction == "").cast("double")).otherwise(some)


def list_scores(prediction: Column, groups: Column) -> Column:
    """struct<tp, fp, fn, precision, recall, f1, em> of a comma list against required synonym groups, matched in order."""
    items = F.transform(list_answer(prediction), F.lower)
    gold = F.transform(groups, lambda g: F.transform(g, lambda t: F.lower(F.regexp_replace(t, r"(?U)\s", ""))))
    drop = lambda xs, i: F.concat(F.slice(xs, 1, i), F.slice(xs, i + 2, F.size(xs)))
    first = lambda xs, hit: F.coalesce(F.array_min(F.filter(F.transform(xs, lambda x, i: F.when(hit(x), i)), lambda i: i.isNotNull())), F.lit(-1))
    start = F.struct(gold.alias("left"), F.lit(0).alias("tp"))

    def take(state: Column, item: Column) -> Column:
        at = first(state["left"], lambda g: F.array_contains(g, item))
        return F.struct(F.when(at >= 0, drop(state["left"], at)).otherwise(state["left"]).alias("left"), (state["tp"] + (at >= 0).cast("int")).alias("tp"))

    matched = F.aggregate(items, start, take)

    def miss(state: Column, group: Column) -> Column:
        at = first(state["left"], lambda item: F.array_contains(group, item))
        return F.struct(F.when(at >= 0, drop(state["left"], at)).otherwise(state["left"]).alias("left"), (state["fn"] + (at < 0).cast("int")).alias("fn"))

    missed = F.aggregate(matched["left"], F.struct(items.alias("left"), F.lit(0).alias("fn")), miss)
    tp, fn = matched["tp"], missed["fn"]
    fp = F.size(items) - tp
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = F.coalesce(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0))
    placed = F.forall(F.zip_with(items, gold, lambda i, g: F.coalesce(F.array_contains(g, i), F.lit(False))), lambda x: x)
    em = ((F.size(items) == F.size(gold)) & placed).cast("double")
    return F.struct(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), em.alias("em"))


#: (EM, F1) of a prediction and an array of references, by evaluator.
EVALUATORS = {
    "legacy": lambda p, ts: (exact_match(p, ts[0]), token_f1(p, ts[0])),
    "hotpot": lambda p, ts: (best(exact_match, p, ts), best(hotpot_f1, p, ts)),
    "longbench": lambda p, ts: (best(exact_match, p, ts), best(token_f1, p, ts)),
    "conditional": lambda p, ts: (conditional(exact_match, p, ts), conditional(token_f1, p, ts)),
    "nq": lambda p, ts: (best(exact_match, p, ts), best(token_f1, p, ts)),
    "squad": lambda p, ts: (best(exact_match, p, ts), best(squad_f1, p, ts)),
    "trivia": lambda p, ts: (best(trivia_em, p, ts), best(trivia_f1, p, ts)),
}
#: Dataset names and the evaluator of each.
DATASETS = {
    "longbench-hotpotqa": "hotpot", "hotpotqa": "hotpot", "longbench-2wiki": "hotpot", "2wiki": "hotpot", "longbench-musique": "hotpot", "musique": "hotpot",
    "longbench-qasper": "longbench", "qasper": "longbench", "longbench-narrativeqa": "longbench", "narrativeqa": "longbench",
    "longbench-triviaqa": "trivia", "triviaqa": "trivia", "triviaqa-unfiltered-wikipedia": "trivia",
    "conditionalqa": "conditional", "dapr-nq-open": "nq", "nq-open": "nq", "newsqa": "squad", "covid-qa": "squad", "covid-qa-full-test": "squad",
}


def evaluator_of(dataset: str | None):
    """The evaluator of a dataset name (any case); none: the legacy one."""
    if dataset is None:
        return EVALUATORS["legacy"]
    key = dataset.strip().lower()
    if key not in DATASETS:
        raise ValueError(f"unknown dataset {dataset!r}; known: {sorted(DATASETS)}")
    return EVALUATORS[DATASETS[key]]
