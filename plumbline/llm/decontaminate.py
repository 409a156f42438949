"""Benchmark decontamination by winnowing, in DataFrame operations alone.

A window is ``WINDOW`` consecutive words of a benchmark item (an item of fewer
words is one window); a document's word inside any occurrence of a window is
hit.  Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z
lower-cased.

* Fingerprints: of every ``WINDOW - GRAM + 1`` consecutive GRAM-word hashes the
  least is kept.  Two texts that share WINDOW words share all GRAM-grams of
  that span and so its least one: every window that occurs is found.
* Items shorter than WINDOW are anchored on the hash of their first words (GRAM, or
  all they have), looked up among all a document's hashes of that length; that part
  of the plan exists only where such items exist.
* Documents' fingerprints meet the items' in a join.  The hits are extended: in
  documents with a common fingerprint every window is hashed, joined with the items'
  windows and compared word by word; covered words are the union of the windows' spans.

The benchmark side is broadcast only if its text is below ``BROADCAST_BYTES``,
else the joins shuffle.  Per-document lists never leave their row; one very
common passage only adds rows in proportion to its occurrences.

Cases: null texts have no words; items without words hit nothing; equal items
each count.  Repeated rows of a document get the same result, as each row is
numbered by its content (doc_id and text).  Empty tables give empty or zero
results.  Columns with clashing names are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.shared import table, unused, written

WINDOW, GRAM = 10, 4
SPAN = WINDOW - GRAM + 1
BROADCAST_BYTES = 8 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN)
    return F.filter(parts, lambda w: w != "")


def shifted(a: Column, by: int) -> Column:
    """a without its first elements; shorter arrays become empty."""
    return F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0)))


def paired(a: Column, by: int, f) -> Column:
    """f of each element and the one `by` places on; ends where the second does."""
    return F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - by, F.lit(0))), shifted(a, by), f)


def with_grams(df: DataFrame) -> DataFrame:
    """Adds g1, g2, g4: hashes of the runs of one, two and four words of `ws`.

    Each step is a column of its own, as a nested expression would be evaluated once for each use.
    """
    both = lambda x, y: F.xxhash64(x, y)
    df = df.withColumn("g1", F.transform("ws", lambda w: F.xxhash64(w)))
    return df.withColumn("g2", paired(F.col("g1"), 1, both)).withColumn("g4", paired(F.col("g2"), 2, both))


def fingerprints(df: DataFrame, keep: list[str]) -> DataFrame:
    """keep and mark: the least of every SPAN (7) consecutive hashes g4, each once for a row."""
    low = lambda x, y: F.least(x, y)
    for name, of, by in (("m2", "g4", 1), ("m4", "m2", 2), ("m7", "m4", 3)):
        df = df.withColumn(name, paired(F.col(of), by, low))
    # explode would infer a filter on the array, which the optimizer pushes down and so repeats the whole chain
    return df.withColumn("marks", F.array_distinct("m7")).select(*keep, F.explode_outer("marks").alias("mark"))


def windows(df: DataFrame, keep: list[str], length: Column) -> DataFrame:
    """keep, p (from 1) and the window of `length` words that starts there."""
    at = F.explode(F.sequence(F.lit(1), F.size("ws") - length + 1))
    return df.where(F.size("ws") >= length).select(*keep, "ws", length.alias("length"), at.alias("p")).select(*keep, "length", "p", F.concat_ws(" ", F.slice("ws", F.col("p"), F.col("length"))).alias("window"))


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each occurrence of a window in a document: row_key, item_id, p (its first word, from 1), length."""
    items = written(benchmark.select("item_id", words_of(F.col("text")).alias("ws")).where(F.size("ws") > 0), "benchmark")
    stats = items.agg(F.coalesce(F.sum(F.length(F.concat_ws(" ", "ws"))), F.lit(0)).alias("size"), F.collect_set(F.when(F.size("ws") < WINDOW, F.least(F.size("ws"), F.lit(GRAM)))).alias("short")).first()
    small = stats["size"] <= BROADCAST_BYTES  # fingerprints and windows are within a constant factor of the text
    side = F.broadcast if small else (lambda x: x)
    grammed = with_grams(items)
    marks = fingerprints(grammed.where(F.size("ws") >= WINDOW), []).distinct()
    of_docs = with_grams(docs)
    touched = fingerprints(of_docs, ["row_key"]).join(side(marks), "mark", "left_semi").select("row_key")
    for n in sorted(stats["short"]):  # 1 to GRAM
        hashed = lambda d: F.col({1: "g1", 2: "g2", 4: "g4"}[n]) if n != 3 else paired(F.col("g2"), 1, lambda x, y: F.xxhash64(x, y))  # noqa: B023, E731
        of_size = F.size("ws") == n if n < GRAM else F.size("ws").between(GRAM, WINDOW - 1)
        anchors = grammed.where(of_size).select(F.element_at(hashed(grammed), 1).alias("mark")).distinct()
        touched = touched.union(of_docs.select("row_key", F.explode_outer(F.array_distinct(hashed(of_docs))).alias("mark")).join(side(anchors), "mark", "left_semi").select("row_key"))
    near = written(docs.join(touched.distinct(), "row_key", "left_semi"), "touched")
    wanted = windows(items, ["item_id"], F.least(F.size("ws"), F.lit(WINDOW))).select("item_id", "length", F.col("window").alias("item_window"), F.xxhash64("window").alias("hash")).distinct()
    lengths = [r[0] for r in wanted.select("length").distinct().collect()]  # at most WINDOW values
    found = None
    for n in lengths:
        some = windows(near, ["row_key"], F.lit(n)).withColumn("hash", F.xxhash64("window"))
        met = some.join(side(wanted.where(F.col("length") == n).drop("length")), "hash").where("window = item_window").select("row_key", "item_id", "p", "length")
        found = met if found is None else found.union(met)
    return found if found is not None else docs.sparkSession.createDataFrame([], "row_key string, item_id long, p int, length int")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, ws and row_key, which equal rows share."""
    key = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text").cast("string"))
    return docs.select("doc_id", words_of(F.col("text")).alias("ws"), key.alias("row_key"))


def summed(found: DataFrame) -> DataFrame:
    """row_key, n_hit, n_items, items_sha256: spans are merged per document from sorted starts."""
    found = found.distinct()
    covered = found.select("row_key", F.explode(F.sequence(F.col("p"), F.col("p") + F.col("length") - 1)).alias("w")).distinct().groupBy("row_key").agg(F.count("*").alias("n_hit"))
    named = found.select("row_key", F.col("item_id").cast("string").alias("item")).distinct().groupBy("row_key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return covered.join(named, "row_key").select("row_key", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row for each row of docs."""
    rows = keyed(docs)
    per = written(summed(hits(rows, benchmark)), "contaminated")
    return rows.select("doc_id", "row_key", F.size("ws").cast("long").alias("n_words")).join(per, "row_key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without contaminated ones; all columns stay as they are."""
    key, name = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text").cast("string")), unused(docs, "row_key")
    bad = written(hits(keyed(docs), benchmark).select("row_key").distinct(), "contaminated")
    return docs.withColumn(name, key).join(bad.withColumnRenamed("row_key", name), name, "left_anti").select(*docs.columns)


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS g FROM b, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS r(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM d JOIN sizes ON len(ws) >= n, unnest(range(1, len(ws) - n + 2)) AS r(i)),
hit AS (SELECT DISTINCT doc_id, item_id, i, n FROM dw JOIN bw USING (n, g)),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(n)) AS r(k) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""
