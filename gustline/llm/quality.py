"""Quality rules as a short-circuit cascade.

Every rule looks at one measure of a text. On a sample of bounded size the cascade measures what
each rule costs and how many rows it rejects, orders the rules by rejections per second, and then
computes a measure only for rows that all rules before it let through. The order changes the cost
and the reported rule of a text that breaks several; it never changes which texts are kept.

Defined results: a null text counts as an empty one (no words, rejected for its length); repeated
rows are judged one by one; an empty table gives an empty result; columns other than the text
are carried along, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustline.llm.common import SPACE, pieces
from gustline.session import materialise

WINDOW = 8
SAMPLE_ROWS = 2_000
RUNS, COST_ROWS = 3, 300        # runs of each measure, over about so many rows of the sample
USES_WORDS = ("n_words", "word_chars", "n_repeat_words")


def _text() -> Column:
    return F.coalesce(F.col("q_text"), F.lit(""))


def _words(df: DataFrame, live: Column) -> DataFrame:
    if "q_words" in df.columns:
        return df
    return df.withColumn("q_words", F.when(live, pieces(F.col("q_text"), SPACE)))


def _n_words(df: DataFrame, live: Column) -> DataFrame:
    return _words(df, live).withColumn("q_n_words", F.when(live, F.size("q_words").cast("long")))


def _word_chars(df: DataFrame, live: Column) -> DataFrame:
    return _words(df, live).withColumn(
        "q_word_chars", F.when(live, F.char_length(F.array_join("q_words", "")).cast("long")))


def _n_symbols(df: DataFrame, live: Column) -> DataFrame:
    return df.withColumn(
        "q_n_symbols", F.when(live, F.size(F.regexp_extract_all(_text(), F.lit("[#*$%&|<>]"), F.lit(0))).cast("long")))


def _n_dup_lines(df: DataFrame, live: Column) -> DataFrame:
    lines = F.filter(F.split(_text(), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("q_lines", F.when(live, lines))
    return (df.withColumn("q_n_lines", F.size("q_lines").cast("long"))
            .withColumn("q_n_dup_lines", F.when(live, (F.size("q_lines") - F.size(F.array_distinct("q_lines")))
                                                .cast("long")))
            .drop("q_lines"))


def _n_repeat_words(df: DataFrame, live: Column) -> DataFrame:
    """Words inside windows of eight words that the text holds at least twice.

    Windows become hashes. Only texts with an equal pair sort them with their places; a window
    whose neighbour in that order is equal is a repeated one, and the places are laid over each other.
    """
    df = _words(df, live)
    windows = F.when(
        live & (F.size("q_words") > WINDOW),
        F.transform(F.sequence(F.lit(1), F.size("q_words") - (WINDOW - 1)),
                    lambda i: F.xxhash64(F.slice("q_words", i, WINDOW))))
    df = df.withColumn("q_windows", windows)
    twice = F.size(F.array_distinct("q_windows")) < F.size("q_windows")
    df = df.withColumn("q_sorted", F.when(twice, F.sort_array(
        F.transform("q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def repeated(entry: Column, k: Column) -> Column:
        before, after = F.get("q_sorted", k - 1)["h"], F.get("q_sorted", k + 1)["h"]
        return F.coalesce(entry["h"] == before, F.lit(False)) | F.coalesce(entry["h"] == after, F.lit(False))

    df = df.withColumn("q_places", F.sort_array(F.transform(F.filter("q_sorted", repeated), lambda e: e["i"])))
    covered = F.aggregate(
        "q_places", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, at: F.struct((acc["n"] + at + WINDOW - F.greatest(at, acc["end"])).alias("n"),
                                 (at + WINDOW).alias("end")))["n"]
    return (df.withColumn("q_n_repeat_words", F.when(live, F.coalesce(covered, F.lit(0)).cast("long")))
            .drop("q_windows", "q_sorted", "q_places"))


#: How each measure is added to a table; ``live`` says for which rows.
MEASURES: dict[str, Callable[[DataFrame, Column], DataFrame]] = {
    "n_words": _n_words, "word_chars": _word_chars, "n_symbols": _n_symbols, "n_dup_lines": _n_dup_lines,
    "n_repeat_words": _n_repeat_words}


@dataclass(frozen=True)
class Rule:
    """A text is rejected where ``rejects`` (SQL over ``q_…`` columns) holds."""

    name: str
    measures: tuple[str, ...]
    rejects: str


RULES = (
    Rule("few_words", ("n_words",), "q_n_words < 20"),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), "100 * q_n_repeat_words > 30 * q_n_words"),
    Rule("symbols", ("n_words", "n_symbols"), "10 * q_n_symbols > q_n_words"),
    Rule("repeated_lines", ("n_dup_lines",), "2 * q_n_dup_lines > q_n_lines and q_n_dup_lines >= 4"),
    Rule("word_length", ("n_words", "word_chars"), "q_word_chars < q_n_words * 5 / 4 or q_word_chars > 25 * q_n_words"),
)
BASE = ("few_words", "repeated_windows")


def measured(df: DataFrame, names: Sequence[str], live: Column | None = None) -> DataFrame:
    """``df`` (with ``q_text``) and the named measures, for rows where ``live`` holds."""
    for name in names:
        if f"q_{name}" not in df.columns:
            df = MEASURES[name](df, F.lit(True) if live is None else live)
    return df


def _measure_costs(sample: DataFrame, names: Sequence[str]) -> dict[str, float]:
    """Seconds that each measure adds to a pass over the stored sample: the least of several runs, less those of what it builds on."""
    def seconds(built: Sequence[str]) -> float:
        columns = [f"q_{n}" for n in built]
        times = []
        for _ in range(RUNS):
            began = time.perf_counter()
            measured(sample, built).agg(F.count("*"), *[F.sum(c) for c in columns]).collect()
            times.append(time.perf_counter() - began)
        return min(times[1:])       # the first run compiles

    empty, words = seconds([]), seconds(["n_words"])
    out = {}
    for name in names:
        with_words = name in USES_WORDS and name != "n_words"
        out[name] = max((seconds(["n_words", name]) - words) if with_words else (seconds([name]) - empty), 1e-3)
    return out


def ordered_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text",
                  sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[Rule]:
    """Rules by rejected rows per second of extra work, as measured on about ``sample_rows`` rows.

    Next comes the rule that rejects most of the rows still left for what its measures cost that no rule before it has computed.
    """
    rows = docs.count()
    if rows == 0:
        return list(rules)
    sample = docs.select(F.col(text).alias("q_text")).sample(min(1.0, sample_rows / rows), seed)
    sample = materialise(sample.repartition(1), "quality-sample")      # bounded, so that a job is one task
    names = list(dict.fromkeys(m for r in rules for m in r.measures))
    costs = _measure_costs(materialise(sample.sample(min(1.0, COST_ROWS / sample_rows), seed), "cost-sample"), names)
    verdicts = measured(sample, names).select(*[F.expr(r.rejects).alias(f"q_r{i}") for i, r in enumerate(rules)]).collect()   # a sample
    left, known, order, waiting = list(verdicts), set(), [], list(range(len(rules)))
    while waiting:
        def worth(i: int) -> float:
            cost = sum(costs[m] for m in rules[i].measures if m not in known) + 1e-4
            return (sum(bool(v[i]) for v in left) + 0.5) / cost

        best = max(waiting, key=worth)
        waiting.remove(best)
        order.append(rules[best])
        known.update(rules[best].measures)
        left = [v for v in left if not v[best]]
    return order


def cascade(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``q_rejected_by``: the first rule, in the given order, that rejects the row; null if none does.

    Measures that ``df`` already has are used; others are computed behind the rules before them. The verdict passes
    through a generator: a filter on it is then not rewritten into the measures it is made of, which would
    compute them once for each time they are named.
    """
    df = df.withColumn("q_rejected_by", F.lit(None).cast("string"))
    for rule in rules:
        alive = F.col("q_rejected_by").isNull()
        for name in rule.measures:
            if f"q_{name}" not in df.columns:
                df = MEASURES[name](df, alive)
        df = df.withColumn("q_rejected_by", F.when(alive & F.expr(rule.rejects), F.lit(rule.name))
                           .otherwise(F.col("q_rejected_by")))
    verdict = F.explode(F.array("q_rejected_by")).alias("q_rejected_by")
    return df.select(*[c for c in df.columns if c != "q_rejected_by"], verdict)


def _verdicts(docs: DataFrame, rules: Sequence[Rule], text: str) -> DataFrame:
    """``q_row``, a struct in which the columns of a row wait so that none can clash with a measure, and ``q_rejected_by``."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("q_row"), F.col(text).alias("q_text"))
    return cascade(packed, ordered_rules(docs, rules, text))


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``rejected_by`` (a column of that name is replaced), through the ordered cascade."""
    own = [F.col("q_row")[c].alias(c) for c in docs.columns if c != "rejected_by"]
    return _verdicts(docs, rules, text).select(*own, F.col("q_rejected_by").alias("rejected_by"))


def kept_documents(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows and columns of ``docs`` that no rule rejects."""
    kept = _verdicts(docs, rules, "text").where("q_rejected_by is null")
    return kept.select(*[F.col("q_row")[c].alias(c) for c in docs.columns])


def report(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Measures of every text and the verdict of the cascade over them."""
    order = ordered_rules(docs, rules)
    df = measured(docs.select("doc_id", F.col("text").alias("q_text")), list(MEASURES))
    df = cascade(df, order)
    failed = F.expr(" or ".join(f"({r.rejects})" for r in RULES if r.name in BASE))
    return df.select("doc_id", *[F.col(f"q_{m}").alias(m) for m in MEASURES], failed.alias("base_failed"),
                     F.col("q_rejected_by").isNull().alias("kept"))
