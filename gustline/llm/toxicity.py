"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a fixed list of insults and of words, or beginnings of words, that the labelled
texts show to be toxic, hits near a second person, capitals, punctuation, and words that are disguised with digits or signs. The
model is fitted on at most ``TRAIN_ROWS`` labelled rows (the smallest by a hash of ``doc_id``), three quarters of
them for the lexicon and the trees and the others to calibrate; every text is scored, whole.

Labels are read only from rows whose crc32(doc_id) mod 5 is not 0; they, the language, the source and the
``doc_id`` are no inputs.

Defined results: null and empty texts have zero features and get a score like any other; a null ``doc_id`` has no label
and the checksum of the empty text; of several labels for one document the largest counts; repeated rows are scored one by
one; without any usable labels, or with labels of one class only, the score is the share of lexicon hits; other columns are
not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustline.session import materialise

TRAIN_ROWS = 12_000
LEXICON_WORDS = 400
STEMS = (4, 5, 6)   # letters of the word beginnings that the lexicon may learn
LEAST = 10.0        # log odds times the root of the toxic texts with the word: what the lexicon asks for
TREES = 24
DEPTH = 4
NEAR = 6            # words to a second person
REMEMBERED = 300_000
INSULTS = frozenset(
    "idiot idiots moron morons loser losers stupid dumb dumbass scum trash garbage filth filthy pathetic worthless "
    "disgusting clown clowns imbecile cretin fool jerk creep coward liar freak parasite vermin bastard bitch "
    "asshole shit fuck fucking damn hate ugly useless retard idiota imbécil estúpido estúpida basura asco "
    "dummkopf trottel arschloch abschaum müll widerlich connard salaud imbécile ordure nul débile".split())
SECOND = frozenset("you your yours yourself ya u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos "
                   "tú ti tus usted ustedes vosotros".split())
DISGUISE = str.maketrans("013457@$!|€", "oieastasiie")
EDGE = " \t.,;:!?\"'()[]{}<>«»„“”‘’…-–—*_#~`/\\"
INNER = re.compile(r"(?<=\w)[*.\-_~+'|]+(?=\w)")
FEATURES = ("insults", "insult_share", "learned", "learned_share", "learned_top", "near", "near_share", "second_share",
            "capitals", "shouted", "exclaims", "questions", "marks", "disguised", "disguised_hits", "words")
FEATURE_TYPE = "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def stems(word: str) -> list[str]:
    """Beginnings of a word, as the lexicon spells them."""
    return [word[:k] + "*" for k in STEMS if len(word) >= k]


class Words:
    """What is known of single words, remembered."""

    def __init__(self, learned: dict[str, float]) -> None:
        self.learned, self.known = learned, {}

    def look(self, token: str) -> tuple | None:
        """(insult, weight, second person, disguised, disguised insult), None for an ordinary word."""
        word = token.strip(EDGE)
        insult, weight = word in INSULTS, max(self.learned.get(w, 0.0) for w in (word, *stems(word)))
        disguised = hidden = False
        if word and not word.isalpha():
            plain = INNER.sub("", word).translate(DISGUISE)
            disguised = plain != word and plain.isalpha() and not word.isdigit()
            if disguised and (plain in INSULTS or plain in self.learned):
                hidden = insult = True
                weight = max(weight, self.learned.get(plain, 0.0))
        second = word in SECOND
        return (insult, weight, second, disguised, hidden) if insult or weight or second or disguised else None

    def of(self, tokens: list[str]) -> list[tuple[int, tuple]]:
        """Places and facts of all words that are not ordinary."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        for token in set(tokens).difference(known):
            known[token] = self.look(token)
        return [(i, f) for i, f in enumerate(map(known.__getitem__, tokens)) if f is not None]


def features_of(text: str, words: Words) -> list[float]:
    tokens = text.lower().split()
    n = max(1, len(tokens))
    found = words.of(tokens)
    second = [i for i, f in found if f[2]]
    hits = [i for i, f in found if f[0] or f[1] > 0]
    near = 0
    if second and hits:
        at = np.searchsorted(second, hits)
        s = np.array([-10 * NEAR, *second, 10 ** 9])
        near = int(np.count_nonzero(np.minimum(np.abs(s[at] - hits), np.abs(s[at + 1] - hits)) <= NEAR))
    insults = sum(f[0] for _, f in found)
    weights = [f[1] for _, f in found if f[1] > 0]
    raw = np.frombuffer(text.encode(), np.uint8)
    size = max(1, len(raw))
    counts = np.bincount(raw, minlength=256)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    marks = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
    # letters beside each other that are both capitals
    big = (raw >= 65) & (raw <= 90)
    shouted = int(np.count_nonzero(big[1:] & big[:-1]))
    hidden = sum(f[4] for _, f in found)
    return [math.log1p(insults), insults / n, math.log1p(sum(weights)), sum(weights) / n, max(weights, default=0.0),
            math.log1p(near), near / n, len(second) / n, upper / max(1, upper + lower), shouted / size,
            int(counts[33]) / size, int(counts[63]) / size, marks / size, sum(f[3] for _, f in found) / n,
            math.log1p(hidden), math.log1p(len(tokens))]


def with_features(docs: DataFrame, learned: dict[str, float], extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the dense features and the ``extra`` columns of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(learned)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                table = np.array([features_of(text or "", words) for text in some.column("text").to_pylist()], float)
                yield pa.record_batch(
                    [some.column("doc_id"), *[pa.array(np.ascontiguousarray(table[:, k])) for k in range(len(FEATURES))],
                     *[some.column(c) for c in extra]], names=["doc_id", *FEATURES, *extra])

    kinds = FEATURE_TYPE + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in extra)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra).mapInArrow(rows, kinds)


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text, toxic and fold of the labelled rows that the model may see, at most ``rows`` of them."""
    usable = (labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
              .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    usable = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    usable = usable.select(F.col("doc_id").alias("l_id"), "toxic")
    # no more than ``rows`` labels
    found = docs.select("doc_id", "text").join(F.broadcast(usable), F.col("doc_id") == F.col("l_id"))
    return materialise(found.select("doc_id", "text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)).cast("int")
                                    .alias("fold")), "toxicity-sample")


def learned_lexicon(sample: DataFrame, words: int = LEXICON_WORDS) -> dict[str, float]:
    """Words that stand in many more toxic than other texts of the bounded sample, with their log odds."""
    plain = F.array_distinct(F.transform(
        F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"),
        lambda w: F.regexp_replace(w, r"^[\p{Punct}«»„“”‘’…–—]+|[\p{Punct}«»„“”‘’…–—]+$", "")))
    begun = [F.transform(F.filter("w", lambda w, k=k: F.char_length(w) >= k),
                         lambda w, k=k: F.concat(F.substring(w, 1, k), F.lit("*"))) for k in STEMS]
    each = sample.where("fold <> 0").select("toxic", plain.alias("w")).select(
        "toxic", F.explode(F.array_distinct(F.concat("w", *begun))).alias("word"))
    sizes = dict(sample.where("fold <> 0").groupBy("toxic").count().collect())
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return {}
    counts = each.where("word <> ''").groupBy("word").agg(
        F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b")).where("a >= 3")
    odds = F.log(((F.col("a") + 0.5) / (bad + 1)) / ((F.col("b") + 0.5) / (good + 1)))
    sure = F.col("w") * F.sqrt("a")
    top = (counts.select("word", odds.alias("w"), "a").where((F.col("w") > 1.5) & (sure >= LEAST))
           .orderBy(F.desc(sure), "word").limit(words).collect())
    return {r["word"]: float(r["w"]) for r in top}


def scored(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    sample = training_rows(docs, labels, rows)
    learned = learned_lexicon(sample)
    classes = {tuple(r) for r in sample.select((F.col("fold") == 0).alias("f"), "toxic").distinct().collect()}
    features = with_features(docs, learned)
    if classes != {(False, 0), (False, 1), (True, 0), (True, 1)}:
        score = F.least(F.lit(1.0), F.col("insult_share") * 20)
        return _verdict(features.withColumn("score", score))
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    fitted = materialise(with_features(sample, learned, ("toxic", "fold")), "toxicity-features")
    fitted = vector.transform(fitted).select("features", F.col("toxic").cast("double").alias("label"), "fold")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, subsamplingRate=0.8, seed=5, maxBins=64).fit(
        fitted.where("fold <> 0"))
    probability = vector_to_array("probability")[1]
    held = trees.transform(fitted.where("fold = 0")).select(probability.alias("p"), "label")
    curve = IsotonicRegression(featuresCol="p", labelCol="label").fit(held)
    out = trees.transform(vector.transform(features)).select("doc_id", probability.alias("p"))
    return _verdict(curve.transform(out).withColumn("score", 0.97 * F.col("prediction") + 0.03 * F.col("p")))


def _verdict(df: DataFrame) -> DataFrame:
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score")))
    return df.select("doc_id", held_out().alias("held_out"), score.alias("score"),
                     F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))
