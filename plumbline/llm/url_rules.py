"""URL filters: fixed rules first, then association rules mined by Spark's FP-growth.

A url's items are its scheme, host labels and their words (parted at hyphens), registered suffix, path segments, file
extension and query keys.

The transactions are the labelled pages, with the label as one more item.  A page's label is the first that says
something: block if its host holds one of the words ``SEEDS``; the fixed rules' own verdict; else the row of ``labels`` with
its id (quality 0 or toxic 1 means block).  Other pages have none.  Rules item
set -> block with at least ``SUPPORT`` (and ``LEAST_PAGES`` pages) and ``CONFIDENCE`` and a lift above 1 are kept, less
those with a smaller antecedent of no less confidence.  So the miner carries what the seeds and the fixed rules say over to
pages on which they are silent.  Each rule is filed under its rarest item (an
inverted index); a url meets only the rules filed under its items and is
blocked if all items of one are there.

Only DataFrame functions and Spark's own miner (JVM) run.  The miner's item sets are
bounded by SUPPORT, not by the input; the rules are broadcast only while there are at most
``BROADCAST_RULES`` of them.

Cases: a null url or one without ``://`` has empty host and path and no items: no
fixed rule fits and it is allowed.  Equal urls are judged alike, with or without a page_id (which only finds a label).
Without labelled pages there are no mined rules.  Empty tables give an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.shared import table, written

#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SUPPORT, LEAST_PAGES, CONFIDENCE, BROADCAST_RULES = 0.002, 8, 0.8, 10_000
#: Host words that label a page block (a parameter).
SEEDS = ("adult", "ads", "bets", "casino", "pills", "porn", "spam", "viagra")
BLOCK, ALLOW = "label=block", "label=allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parted(pages: DataFrame) -> DataFrame:
    """page_id, url, scheme, host, path, query."""
    at = F.instr(F.coalesce("url", F.lit("")), "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    out = pages.select("page_id", "url", F.when(at > 0, F.expr("substring(url, 1, instr(url, '://') - 1)")).otherwise("").alias("scheme"), rest.alias("rest"))
    out = out.withColumn("raw_host", F.regexp_extract("rest", r"^[^/?#]*", 0)).withColumn("tail", F.expr("substring(rest, length(raw_host) + 1)"))
    return out.select("page_id", "url", "scheme", F.translate("raw_host", UPPER, LOWER).alias("host"), F.regexp_extract("tail", r"^[^?#]*", 0).alias("path"), F.regexp_extract("tail", r"\?([^#]*)", 1).alias("query"))


def fixed() -> tuple[Column, Column]:
    """The rule that decides, like `net/`, and its verdict (null where none fits)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, host, prefix in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(prefix)
        rule, verdict = F.when(fits, host + prefix).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def items() -> Column:
    labels = F.split("host", r"\.")
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    keys = F.transform(F.filter(F.split("query", "&"), lambda s: s != ""), lambda s: F.concat(F.lit("query="), F.regexp_extract(s, r"^[^=]*", 0)))
    of_host = F.transform(F.filter(labels, lambda s: s != ""), lambda s: F.concat(F.lit("host="), s))
    parts = F.filter(F.flatten(F.transform(F.filter(labels, lambda s: s.contains("-")), lambda s: F.split(s, "-"))), lambda s: s != "")
    of_words = F.transform(parts, lambda s: F.concat(F.lit("word="), s))
    ends = F.when(F.size(labels) >= 2, F.array(F.concat(F.lit("domain="), F.concat_ws(".", F.slice(labels, -2, 2))))).otherwise(F.array().cast("array<string>"))
    extension = F.regexp_extract("path", r"\.([A-Za-z0-9]{1,5})$", 1)
    of_path = F.transform(segments, lambda s: F.concat(F.lit("path="), F.regexp_replace(s, "[0-9]+", "0")))
    of_file = F.when(extension != "", F.array(F.concat(F.lit("ext="), extension))).otherwise(F.array().cast("array<string>"))
    of_scheme = F.when(F.col("scheme") != "", F.array(F.concat(F.lit("scheme="), F.translate("scheme", UPPER, LOWER)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(of_scheme, of_host, of_words, ends, of_path, of_file, keys))


def labelled(rows: DataFrame, labels: DataFrame, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """items of the pages that have a label, which is one of them; rows as parted() gives them."""
    bad = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad"))
    seeded = F.arrays_overlap(F.split("host", r"[.-]"), F.array(*map(F.lit, seeds))) if seeds else F.lit(False)
    label = F.coalesce(F.when(seeded, BLOCK), F.concat(F.lit("label="), fixed()[1]), F.when(F.col("bad"), BLOCK), F.when(~F.col("bad"), ALLOW))
    return rows.where("host <> ''").join(bad, "page_id", "left").select(items().alias("items"), label.alias("label")).where("label IS NOT NULL").select(F.concat("items", F.array("label")).alias("items"))


def mined(transactions: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """rule_id, antecedent, confidence, support, anchor: pruned rules, filed under their rarest item."""
    rows = written(transactions, "transactions")
    support = min(1.0, max(support, LEAST_PAGES / max(rows.count(), 1)))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(rows)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.element_at("consequent", 1) == BLOCK) & (F.col("lift") > 1)).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
    rules = written(rules.withColumn("rule_id", F.xxhash64("antecedent")), "rules")
    # a wider rule is redundant if one of its items alone removed is a rule of no less confidence
    smaller = rules.select("rule_id", "confidence", F.posexplode("antecedent").alias("i", "x"), "antecedent").where(F.size("antecedent") > 1).select(F.col("rule_id").alias("wide"), F.col("confidence").alias("wide_confidence"), F.xxhash64(F.array_remove("antecedent", F.col("x"))).alias("rule_id"))
    redundant = smaller.join(rules.select("rule_id", "confidence"), "rule_id").where(F.col("confidence") >= F.col("wide_confidence")).select(F.col("wide").alias("rule_id")).distinct()
    rules = rules.join(redundant, "rule_id", "left_anti")
    often = model.freqItemsets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("x"), "freq")
    anchors = rules.select("rule_id", F.explode("antecedent").alias("x")).join(often, "x").groupBy("rule_id").agg(F.min(F.struct("freq", "x"))["x"].alias("anchor"))
    return written(rules.join(anchors, "rule_id"), "rules")


def matched(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """url of the rows that hold all items of a rule, each once."""
    index = rules.select("anchor", "antecedent")
    index = F.broadcast(index) if rules.count() <= BROADCAST_RULES else index
    urls = rows.where("host <> ''").groupBy("url").agg(*(F.first(c).alias(c) for c in ("scheme", "host", "path", "query")))  # these follow from the url
    near = urls.select("url", items().alias("items")).select("url", "items", F.explode("items").alias("anchor")).join(index, "anchor")
    return near.where(F.size(F.array_except("antecedent", "items")) == 0).select("url").distinct()


def judged(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    rule, verdict = fixed()
    rows = parted(pages)
    blocked = matched(rows, mined(labelled(rows, labels))).select(F.col("url").alias("blocked"))
    return rows.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("fixed")).join(blocked, F.col("url") == F.col("blocked"), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("fixed", F.when(F.col("blocked").isNotNull(), "block").otherwise("allow")).alias("verdict"),
    )


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
