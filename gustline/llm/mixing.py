"""Mixing sources to target weights by hierarchical budgets.

The leaves of a tree (domain, language, source) hold documents; every node has a weight among its siblings. The
budget of tokens runs down the tree in proportion to the weights, but no node gets more than its leaves can give (their
tokens times ``max_epochs``); leaves below a node of weight 0 can give nothing. What a node cannot use goes to its siblings first, and
upwards only when all of them are full: the usable capacities are added up from the leaves, and each level shares its own budget among them.

A leaf spends its budget on seeded epochs: whole ones, then the prefix of the next whose tokens fill the rest. The
order of an epoch is that of a seeded hash, so a prefix is a threshold on the hash: documents are
never sorted or shuffled. The threshold comes from sums per hash bucket, whose number follows the tokens of the leaf,
and then from the documents of the one bucket per leaf that the budget ends in, so a leaf
with a third of all rows is handled like the others. Trees are tables too: the shares of a level come from
one running sum per parent.

Defined results: null names are a value of their own; names without a weight get weight ``default`` (0 leaves them
out); null and empty texts have no tokens and come along with their place in the epoch; rows with equal hash,
which are equal rows, are taken or left together; an empty table gives an empty result; other columns are
carried along, whatever their names but those that begin with ``_mix_``. A document may come out up to ``max_epochs`` times. A budget ends behind the last document
that fits whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gustline.llm.common import SPACE, pieces, small_or_shuffled
from gustline.session import materialise

BUCKET_TOKENS = 500_000     # of a hash bucket, about; the documents of one bucket a leaf are sorted


def n_tokens(text: Column) -> Column:
    return F.size(pieces(text, SPACE)).cast("long")


def order_hash(seed: int, epoch: Column, *identity: Column) -> Column:
    """Place of a document in an epoch, from 0 to 1."""
    mix = F.xxhash64(F.lit(seed), epoch.cast("int"), *identity)
    return (F.shiftrightunsigned(mix, 11)).cast("double") / float(1 << 53)


def shared_budget(nodes: DataFrame, parent: Sequence[str], budget: str, weight: str, capacity: str) -> DataFrame:
    """Adds ``share``: the budget of each parent in proportion to weights, none above its capacity.

    With the children in the order of capacity per weight, those up to some place are full and the
    rest share what is left by weight; a running sum per parent finds the place.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("fill"), *[c for c in nodes.columns if c not in parent])
    behind = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    ranked = nodes.withColumn("fill", F.when(F.col(weight) > 0, F.col(capacity) / F.col(weight)).otherwise(F.lit(0.0)))
    usable = F.when(F.col(weight) > 0, F.col(capacity)).otherwise(F.lit(0.0))
    ranked = (ranked.withColumn("full", F.coalesce(F.sum(usable).over(behind), F.lit(0.0)))
              .withColumn("open", F.sum(weight).over(whole) - F.coalesce(F.sum(weight).over(behind), F.lit(0.0))))
    # water level if this child and all after it are not full; beyond the right place it only sinks
    level = F.when(F.col("open") > 0, (F.col(budget) - F.col("full")) / F.col("open"))
    ranked = ranked.withColumn("level", level)
    reached = F.max(F.when((F.col(weight) > 0) & (F.col("level") <= F.col("fill")), F.col("level"))).over(whole)
    share = F.when(F.col(weight) <= 0, F.lit(0.0)).otherwise(
        F.least(F.col(capacity).cast("double"), F.coalesce(reached, F.lit(float("inf"))) * F.col(weight)))
    return ranked.withColumn("share", F.greatest(share, F.lit(0.0))).drop("fill", "full", "open", "level")


def leaf_budgets(leaves: DataFrame, tree: Sequence[str], weights: Sequence[DataFrame | None], budget: float,
                 max_epochs: int, default: float = 1.0) -> DataFrame:
    """``leaves`` (tree columns, tokens) with ``budget`` tokens for each leaf.

    ``weights``: for each level a table (name of the level, weight), or None for weights by the tokens there are.
    """
    # from the leaves up: what a node can use is what its children of positive weight can use
    levels: list[DataFrame] = []
    below = leaves.withColumn("capacity", F.col("tokens").cast("double") * max_epochs)
    for depth in reversed(range(len(tree))):
        name, path, table = tree[depth], list(tree[:depth + 1]), weights[depth]
        level = below.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        if table is None:
            level = level.withColumn("weight", F.col("tokens").cast("double"))
        else:
            named = table.select(F.col(name).alias("w_name"), F.col("weight").cast("double").alias("weight"))
            level = level.join(named, F.col(name).eqNullSafe(F.col("w_name")), "left").drop("w_name")
            level = level.withColumn("weight", F.coalesce("weight", F.lit(default)))
        level = materialise(level, f"capacity-{name}")
        levels.insert(0, level)
        below = level.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(F.lit(0.0)))
    upper = None
    for depth, level in enumerate(levels):
        path = list(tree[:depth + 1])
        if upper is None:
            level = level.withColumn("given", F.lit(float(budget)))
        else:
            above = upper.select(*[F.col(c).alias(f"u_{c}") for c in tree[:depth]], F.col("share").alias("given"))
            match = F.lit(True)
            for c in tree[:depth]:
                match = match & F.col(c).eqNullSafe(F.col(f"u_{c}"))
            level = level.join(above, match).drop(*[f"u_{c}" for c in tree[:depth]])
        upper = shared_budget(level.drop("tokens"), tree[:depth], "given", "weight", "capacity")
        upper = materialise(upper.select(*path, "share"), f"budget-{tree[depth]}")
    match = F.lit(True)
    for c in tree:
        match = match & F.col(c).eqNullSafe(F.col(f"u_{c}"))
    upper = upper.select(*[F.col(c).alias(f"u_{c}") for c in tree], F.col("share").alias("budget"))
    return leaves.join(upper, match).drop(*[f"u_{c}" for c in tree])


def mixed_documents(docs: DataFrame, tree: dict[str, Column], weights: Sequence[DataFrame | None],
                    budget: float | None = None, max_epochs: int = 2, seed: int = 11,
                    identity: Sequence[str] = ("doc_id", "text"), default: float = 1.0, epoch: str = "epoch") -> DataFrame:
    """Rows of ``docs`` with ``epoch`` (from 0; a column of that name is replaced), each leaf up to its budget of tokens.

    ``tree``: names and expressions of the levels, from the root down. ``budget``: tokens in all; as many as there are
    if not given.
    """
    names = [f"_mix_{c}" for c in tree]
    who = [F.col(c) for c in identity]
    placed = docs.select("*", *[e.alias(f"_mix_{c}") for c, e in tree.items()], n_tokens(F.col("text")).alias("_mix_tokens"))
    slim = materialise(placed.select(*names, "_mix_tokens", F.xxhash64(*who).alias("_mix_id")), "mix-tokens")
    leaves = slim.groupBy(*names).agg(F.sum("_mix_tokens").alias("tokens"))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    tables = [None if w is None else w.withColumnRenamed(c, f"_mix_{c}") for c, w in zip(tree, weights, strict=True)]
    leaves = leaf_budgets(leaves, names, tables, float(total if budget is None else budget), max_epochs, default)
    cuts = F.greatest(F.lit(1), F.ceil(F.col("tokens") / BUCKET_TOKENS)).cast("long")
    leaves = leaves.select(
        *names, "tokens", "budget", cuts.alias("cuts"),
        F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(
            F.when(F.col("budget") > 0, max_epochs).otherwise(0)).cast("int").alias("epochs"))
    leaves = leaves.withColumn("left", F.when(F.col("epochs") >= max_epochs, F.lit(0.0)).otherwise(
        F.col("budget") - F.col("epochs") * F.col("tokens")))
    leaves = materialise(leaves.withColumn("leaf", F.monotonically_increasing_id()), "leaves")
    n_leaves = leaves.count()

    def with_leaf(df: DataFrame) -> DataFrame:
        own = leaves.select(*[F.col(c).alias(f"l_{c}") for c in names], "leaf", "epochs", "left", "cuts")
        match = F.lit(True)
        for c in names:
            match = match & F.col(c).eqNullSafe(F.col(f"l_{c}"))
        return df.join(small_or_shuffled(own, n_leaves), match).drop(*[f"l_{c}" for c in names])

    partial = with_leaf(slim).where("left > 0").select(
        "leaf", "left", "cuts", "_mix_tokens", order_hash(seed, F.col("epochs"), F.col("_mix_id")).alias("at"))
    partial = partial.withColumn("bucket", F.floor(F.col("at") * F.col("cuts")))
    sums = partial.groupBy("leaf", "left", "bucket").agg(F.sum("_mix_tokens").alias("tokens"))
    run = Window.partitionBy("leaf").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("tokens").over(run), F.lit(0)))
    last = materialise(sums.where(F.col("before") + F.col("tokens") > F.col("left"))
                       .groupBy("leaf").agg(F.min_by(F.struct("bucket", "before"), "bucket").alias("b"))
                       .select("leaf", "b.bucket", "b.before"), "last-buckets")
    inside = partial.join(small_or_shuffled(last, n_leaves), ["leaf", "bucket"])
    order = Window.partitionBy("leaf").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("used", F.col("before") + F.sum("_mix_tokens").over(order))
    ends = inside.where(F.col("used") > F.col("left")).groupBy("leaf").agg(F.min("at").alias("end"))
    ends = materialise(ends, "ends")
    own = leaves.join(ends, "leaf", "left").select(
        *[F.col(c).alias(f"l_{c}") for c in names], F.col("epochs").alias("_mix_epochs"),
        F.when(F.col("left") > 0, F.coalesce("end", F.lit(2.0))).otherwise(F.lit(-1.0)).alias("_mix_end"))
    match = F.lit(True)
    for c in names:
        match = match & F.col(c).eqNullSafe(F.col(f"l_{c}"))
    out = placed.withColumn("_mix_id", F.xxhash64(*who)).join(small_or_shuffled(own, n_leaves), match)
    partly = order_hash(seed, F.col("_mix_epochs"), F.col("_mix_id")) < F.col("_mix_end")
    copies = F.col("_mix_epochs") + F.when(partly, 1).otherwise(0)
    return out.where(copies > 0).select(
        *[c for c in docs.columns if c != epoch], F.explode(F.sequence(F.lit(0), copies - 1)).alias(epoch))


#: Production weights: domains alike, languages as listed, sources alike.
LANGUAGES = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}


def corpus_tree() -> dict[str, Column]:
    """Domain (three groups of sources, by the number in their name), language, source."""
    number = F.expr("try_cast(regexp_extract(source, '[0-9]+', 0) as int)")
    domain = F.concat(F.lit("domain"), F.coalesce(F.pmod(number, F.lit(3)), F.lit(0)).cast("string"))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def corpus_mix(spark: SparkSession, docs: DataFrame, epoch: str = "epoch") -> DataFrame:
    """``docs`` mixed to the production weights, as many tokens as there are, each document twice at most."""
    rows = ", ".join(f"('{name}', {weight}D)" for name, weight in LANGUAGES.items())
    languages = spark.sql(f"select * from values {rows} as t(lang, weight)")
    alike = [spark.sql(f"select '' {name}, 1D weight where false") for name in ("domain", "source")]
    return mixed_documents(docs, corpus_tree(), [alike[0], languages, alike[1]], epoch=epoch)


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, the leaf, n_tokens and epoch of everything the mix takes."""
    tree = corpus_tree()
    return corpus_mix(spark, docs).select(
        "doc_id", tree["domain"].alias("domain"), "lang", "source", n_tokens(F.col("text")).alias("n_tokens"), "epoch")
