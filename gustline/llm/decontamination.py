"""Benchmark decontamination over a positional inverted index.

The index stores a posting (term, document, position) for every document word that occurs in the
benchmark, and one for the end of each document. The lengths of its lists say how rare a
benchmark term is in the corpus. A phrase (ten words of an item in a row) is looked up through its rarest terms: their
lists, moved by the offsets of the terms in the phrase, are intersected, and what is left is a start
of the phrase in a document. Only documents with such starts are read again, to compare the
remaining words of the phrase. Proximity matches come from the same lists, compared with a tolerance.

The lists stay rows: a very frequent term is as many rows as it has postings, spread over all tasks.

Defined results: a null text has no words; items without words are skipped; an item shorter than the window is one
phrase; rows that share a ``doc_id`` are told apart by their text, and equal rows get equal results;
items that share an ``item_id`` count once, an item whose id is null marks words but is not counted;
empty tables give empty results or no hits; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline.llm.common import ascii_lower, pieces, same, small_or_shuffled, text_key
from gustline.session import materialise

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LENGTH = 10
RAREST = 2


def words(text: Column) -> Column:
    return pieces(ascii_lower(text), SEPARATOR)


def phrases(items: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """Distinct phrases (phrase_id, phrase, n_terms) and the items that hold them (phrase_id, item_id)."""
    split = items.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (length - 1), F.lit(1)))
    each = split.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, length))).alias("terms"))
    each = materialise(each.select("item_id", F.array_join("terms", " ").alias("phrase")).distinct(), "phrases-of-items")
    distinct = materialise(
        each.select("phrase").distinct().select(F.monotonically_increasing_id().alias("phrase_id"), "phrase",
                                                F.size(F.split("phrase", " ")).alias("n_terms")), "phrases")
    owners = distinct.join(each, "phrase").select("phrase_id", "item_id")
    return distinct, owners


def build_index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Stored postings (term, doc_id, text_key, pos) of the given terms, or of all.

    A posting of the empty term stands behind the last word of every row, so its position is the number of words.
    """
    marked = docs.select("doc_id", text_key(F.col("text")).alias("text_key"),
                         F.concat(words(F.col("text")), F.array(F.lit(""))).alias("w"))
    postings = marked.select("doc_id", "text_key", F.posexplode("w").alias("pos", "term"))
    if terms is not None:
        wanted = materialise(terms.select("term").union(terms.sparkSession.sql("select '' term")).distinct(), "terms")
        postings = postings.join(small_or_shuffled(wanted, wanted.count()), "term", "left_semi")
    return materialise(postings.select("term", "doc_id", "text_key", "pos"), "postings")


def phrase_terms(distinct: DataFrame, index: DataFrame) -> DataFrame:
    """(phrase_id, term, offset, rank, n_terms): terms of each phrase from the rarest list to the longest.

    A phrase with a term that the corpus lacks cannot occur and is left out.
    """
    lists = index.where("term <> ''").groupBy("term").agg(F.count("*").alias("n"))
    each = distinct.select("phrase_id", "n_terms", F.posexplode(F.split("phrase", " ")).alias("offset", "term"))
    each = each.join(lists, "term", "left")
    mine = Window.partitionBy("phrase_id")
    return (each.withColumn("absent", F.max(F.col("n").isNull()).over(mine)).where("not absent")
            .withColumn("rank", F.row_number().over(mine.orderBy("n", "offset")))
            .select("phrase_id", "term", "offset", "rank", "n_terms", "n"))


def _moved_lists(index: DataFrame, terms: DataFrame, rarest: int) -> DataFrame:
    """Postings of the rarest terms, moved to where their phrase would start."""
    chosen = materialise(terms.where(F.col("rank") <= rarest).select("phrase_id", "term", "offset", "rank", "n_terms"),
                         "rarest-terms")
    moved = index.join(small_or_shuffled(chosen, chosen.count()), "term")
    return moved.select("phrase_id", "doc_id", "text_key", "rank", "n_terms",
                        (F.col("pos") - F.col("offset")).alias("start"))


def phrase_starts(index: DataFrame, terms: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(phrase_id, doc_id, text_key, start) where the moved lists of the rarest terms meet."""
    moved = _moved_lists(index, terms, rarest).where("start >= 0")
    met = moved.groupBy("phrase_id", "doc_id", "text_key", "start", "n_terms").agg(
        F.bit_or(F.expr("shiftleft(1, rank - 1)")).alias("seen"))
    everyone = F.expr(f"shiftleft(1, least(n_terms, {rarest})) - 1")
    return met.where(F.col("seen") == everyone).select("phrase_id", "doc_id", "text_key", "start")


def exact_hits(docs: DataFrame, distinct: DataFrame, starts: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_hit, phrase_ids): hit words and phrases of documents with an exact match.

    The list of starts of a document is bounded by its own words.
    """
    listed = (starts.join(distinct, "phrase_id").groupBy("doc_id", "text_key")
              .agg(F.sort_array(F.collect_list(F.struct("start", "n_terms", "phrase_id", "phrase"))).alias("starts")))
    read = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text").alias("d")
    listed = listed.alias("c")
    joined = read.join(listed, (F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")))
                       & (F.col("d.text_key") == F.col("c.text_key")))
    joined = joined.select("d.doc_id", "d.text_key", words(F.col("text")).alias("w"), "starts")
    joined = joined.withColumn("found", F.filter("starts", lambda s: F.array_join(
        F.slice("w", s["start"] + 1, s["n_terms"]), " ") == s["phrase"])).where("size(found) > 0")
    n_hit = F.aggregate(
        "found", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["start"] + s["n_terms"] - F.greatest(s["start"], acc["end"]))).alias("n"),
            F.greatest(acc["end"], s["start"] + s["n_terms"]).alias("end")))["n"]
    return joined.select("doc_id", "text_key", n_hit.cast("long").alias("n_hit"),
                         F.array_distinct(F.transform("found", lambda s: s["phrase_id"])).alias("phrase_ids"))


def proximity_starts(index: DataFrame, terms: DataFrame, slop: int, rarest: int = 3) -> DataFrame:
    """(phrase_id, doc_id, text_key, start): the rarest term lies at ``start`` and each other of the
    ``rarest`` terms within ``slop`` words of its place in the phrase.

    Starts are compared in cells of ``slop`` + 1 words, so each is met by three cells only.
    """
    width = slop + 1
    moved = _moved_lists(index, terms, rarest).distinct()
    cell = F.floor(F.col("start") / width)
    first = moved.where("rank = 1").withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    other = moved.where("rank > 1").select(
        "phrase_id", "text_key", F.col("doc_id").alias("other_doc"), F.col("rank").alias("other_rank"),
        F.col("start").alias("other_start"), cell.alias("cell"))
    near = first.join(other, ["phrase_id", "text_key", "cell"]).where(
        F.col("doc_id").eqNullSafe(F.col("other_doc")) & (F.abs(F.col("start") - F.col("other_start")) <= slop))
    met = near.groupBy("phrase_id", "doc_id", "text_key", "start", "n_terms").agg(
        F.bit_or(F.expr("shiftleft(1, other_rank - 1)")).alias("seen"))
    met = met.where(F.col("seen") == F.expr(f"shiftleft(1, least(n_terms, {rarest})) - 2"))
    single = moved.where("n_terms = 1")
    names = ["phrase_id", "doc_id", "text_key", "start"]
    return met.select(*names).union(single.select(*names))


def proximity_matches(docs: DataFrame, distinct: DataFrame, index: DataFrame, terms: DataFrame, slop: int, rarest: int = 3) -> DataFrame:
    """(phrase_id, doc_id, text_key, start): the rarest term of the phrase lies where it would if the phrase began at
    ``start``, and every other term within ``slop`` words of its place.

    The lists of the rarest terms name the starts; the other terms are looked for in the documents that hold some.
    ``start`` is negative where the terms in front are missing their places before the first word.
    """
    starts = proximity_starts(index, terms, slop, rarest)
    listed = (starts.join(distinct, "phrase_id").groupBy("doc_id", "text_key")
              .agg(F.collect_list(F.struct("start", "phrase_id", F.split("phrase", " ").alias("terms"))).alias("starts"))).alias("c")
    read = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text").distinct().alias("d")
    joined = read.join(listed, F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.text_key") == F.col("c.text_key")))
    joined = joined.select("d.doc_id", "d.text_key", words(F.col("text")).alias("w"), "starts")

    def found(s: Column) -> Column:
        def near(term: Column, offset: Column) -> Column:
            begin, end = s["start"] + offset - slop, s["start"] + offset + (slop + 1)
            begin = F.greatest(begin, F.lit(0))
            return F.array_contains(F.slice("w", begin + 1, F.greatest(end - begin, F.lit(0))), term)
        return ~F.array_contains(F.transform(s["terms"], near), False)

    return joined.select("doc_id", "text_key", F.explode(F.filter("starts", found)).alias("s")).select(
        "s.phrase_id", "doc_id", "text_key", "s.start")


def contamination(docs: DataFrame, items: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document row: doc_id, text_key, n_words, n_hit, item_ids (sorted strings)."""
    distinct, owners = phrases(items, length)
    index = build_index(docs, distinct.select(F.explode(F.split("phrase", " ")).alias("term")))
    starts = phrase_starts(index, phrase_terms(distinct, index))
    hits = materialise(exact_hits(docs, distinct, starts), "hits")
    named = (hits.select("doc_id", "text_key", "n_hit", F.explode("phrase_ids").alias("phrase_id"))
             .join(owners, "phrase_id").groupBy("doc_id", "text_key")
             .agg(F.max("n_hit").alias("n_hit"),
                  F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids")))
    ends = index.where("term = ''").select("doc_id", "text_key", F.col("pos").cast("long").alias("n_words"))
    return ends.join(named, same(ends, named, "doc_id", "text_key"), "left").select(
        ends["doc_id"], ends["text_key"], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def clean_documents(docs: DataFrame, items: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of ``docs`` without any exact match."""
    bad = contamination(docs, items, length).where("n_hit > 0").select(
        F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id"))
                     & (text_key(F.col("text")) == F.col("bad_key")), "left_anti")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's digest columns of ``contamination``."""
    return contamination(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))
