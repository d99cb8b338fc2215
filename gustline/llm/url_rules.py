"""URL rules as a sort-merge range join.

A rule covers a host with its subdomains and a path prefix. Written with reversed host labels it is a
plain string prefix (``com.example/en/``), so it covers one interval of the sorted keys, and two
such intervals are nested or apart. A URL stands in the key space once for each suffix of its host
(``com/en/25``, ``com.example/en/25``, …). Keys are dealt out in ranges, so that a host with a third
of all rows is cut at its paths; every rule is put into each range that its interval touches; one sorted
sweep per range then carries the stack of nested rules: the rule that started last brings the rules
around it, and the first of them that still covers the key is the longest there. The longest over the
keys of a URL decides.

Defined results: a URL without ``://`` (or null) has empty host and path and gets the default verdict, as
does a URL without a rule; of rules with equal host and path, ``block`` wins; rules with a null in host
or path or verdict cover nothing; repeated rows are judged one by one; other columns are not looked at; empty tables give
empty results (no rules: every URL gets the default).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gustline.llm.common import ascii_lower
from gustline.session import materialise

SITE_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
              ("net", "/es/", "block"), ("net", "/fr/", "block"))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = SITE_RULES) -> DataFrame:
    """Rules given in the program as a table (host, path, verdict)."""
    quote = "'{}'".format
    rows = [f"({', '.join(quote(v.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))) for v in r)})"
            for r in rules]
    if not rows:
        return spark.sql("select '' host, '' path, '' verdict where false")
    return spark.sql(f"select * from values {', '.join(rows)} as t(host, path, verdict)")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _stacks(rules: DataFrame) -> DataFrame:
    """key, stack: a rule's key and the rules around it, itself included, longest first.

    Rules around a rule are prefixes of its key, found by equality with the prefixes that end behind a character.
    """
    keyed = rules.where("host is not null and path is not null and verdict is not null").select(
        F.concat(_reversed(ascii_lower(F.col("host"))), "path").alias("key"), "path", "verdict",
        F.concat("host", "path").alias("rule"))
    keyed = keyed.groupBy("key").agg(F.max_by(F.struct("rule", "verdict"), F.struct("verdict", "rule")).alias("r"))
    keyed = keyed.select("key", "r.rule", "r.verdict")
    inner = keyed.select(F.col("key").alias("inner"), F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n"))
    inner = inner.select("inner", F.substring(F.col("inner"), F.lit(1), F.col("n")).alias("key"))
    entry = F.struct(F.length("key").alias("length"), "key", "rule", "verdict")
    return (inner.join(keyed, "key").groupBy(F.col("inner").alias("key"))
            .agg(F.sort_array(F.collect_list(entry), asc=False).alias("stack")))


def judged_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url",
                keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """``keep`` columns, host, path, rule and verdict for every row of ``pages``."""
    host, path = url_parts(F.col(url))
    kept = [f"k_{c}" for c in keep]
    urls = pages.select(*[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)],
                        F.xxhash64(url, *keep).alias("mix"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda n: F.concat(F.array_join(F.slice(F.reverse(labels), F.lit(1), n), "."), "path"))
    keys = urls.withColumn("keys", suffixes).select(
        *kept, "mix", "host", "path", F.size("keys").alias("n_keys"), F.posexplode("keys").alias("nth", "key"))
    # an equal key repeated by many rows may lie on both sides of a border: rules go to both
    keys = keys.repartitionByRange("key", "mix").withColumn("range", F.spark_partition_id())
    keys = materialise(keys, "url-keys")
    stacks = materialise(_stacks(rules), "url-rules")
    borders = keys.groupBy("range").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    # as many rows as shuffle partitions
    near = stacks.join(F.broadcast(borders), (F.col("key") <= F.col("high"))
                       & ((F.col("key") >= F.col("low")) | F.col("low").startswith(F.col("key"))))
    events = (keys.withColumn("stack", F.lit(None).cast(stacks.schema["stack"].dataType))
              .unionByName(near.select("range", "key", "stack"), allowMissingColumns=True))
    sweep = (Window.partitionBy("range").orderBy("key", F.col("stack").isNull())
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    swept = events.withColumn("top", F.last("stack", ignorenulls=True).over(sweep)).where("stack is null")
    covering = F.filter("top", lambda entry: F.col("key").startswith(entry["key"]))
    best = swept.withColumn("entry", F.get(covering, F.lit(0)))
    # hosts are suffixes of each other here: of equal lengths the one with more labels wins
    rank = F.struct(F.col("entry.length").alias("length"), F.col("nth").alias("nth"))
    found = best.groupBy(*kept, "mix", "host", "path", "n_keys").agg(
        F.max_by("entry", F.when(F.col("entry").isNotNull(), rank)).alias("entry"),
        F.count("*").alias("rows"))
    # rows that are equal in every kept column come out as often as they went in
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("rows") / F.col("n_keys")).cast("int"))))
    return found.select(*[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], "host", "path",
                        F.col("entry.rule").alias("rule"),
                        F.coalesce(F.col("entry.verdict"), F.lit(default)).alias("verdict"))
