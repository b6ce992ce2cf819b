"""Quality rules over the form of a text, and the divergence of its histograms from its language. DataFrame functions only.

For each language (a null one included) two references are learned from all its documents: how characters fall into classes, and
how words fall on the language's ``COMMON`` most frequent words and the rest. A document is compared with both by the
Jensen-Shannon distance (root of the divergence to base 2). The verdict counts only if the document has ``LEAST_WORDS`` words and the
reference ``LEAST_REFERENCE``; otherwise, and for empty texts, distances are null and only the base rules speak.

Rows that repeat are judged each; a null text has no words and fails the base rules; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm._store import Workspace, table

LEAST_WORDS, LEAST_REFERENCE, COMMON = 50, 20_000, 24
MOST_CLASS, MOST_WORD = 0.31, 0.45
CLASSES = ("lower", "space", "upper", "digit", "break", "mark", "sign", "wide")


def _blanks(text: Column) -> Column:
    """Every white space as a blank."""
    for c in "\n\t\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def _words(text: Column) -> Column:
    return F.array_remove(F.split(_blanks(text), " "), "")


def _windows(words: Column, n: Column) -> Column:
    """A hash of each three-word window."""
    at = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))


def _ordered(windows: Column) -> Column:
    """Windows with their places, equal ones side by side."""
    return F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def features(docs: DataFrame, common: DataFrame) -> DataFrame:
    """Base metrics, counts by character class and counts of the language's common words of each document."""
    t = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", "lang", t.alias("t")).withColumn("b", _blanks(F.col("t"))).withColumn("w", F.array_remove(F.split("b", " "), ""))
    d = d.withColumn("n_words", F.size("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("lines", lines).withColumn("hashes", _windows(F.col("w"), F.col("n_words")))
    d = d.withColumn("dup", F.size("hashes") > F.size(F.array_distinct("hashes")))
    d = d.withColumn("pairs", F.when(F.col("dup"), _ordered(F.col("hashes"))))
    pairs = F.col("pairs")
    again = F.filter(pairs, lambda x, j: (F.get(pairs, j - 1)["h"] == x["h"]) | (F.get(pairs, j + 1)["h"] == x["h"]))
    inside = F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    d = d.join(common.select(F.col("lang").alias("l"), "words"), F.col("lang").eqNullSafe(F.col("l")), "left").drop("l")
    words = F.coalesce("words", F.array().cast("array<string>"))
    d = d.withColumn("common", words).withColumn("hits", F.filter(F.transform("w", lambda x: F.lower(x)), lambda x: F.array_contains("common", x)))
    d = d.select(
        "doc_id",
        "lang",
        "t",
        F.col("n_words").cast("long").alias("n_words"),
        F.length(F.replace("b", F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("dup"), inside).otherwise(0).cast("long").alias("n_repeat_words"),
        F.transform("common", lambda c: F.size(F.filter("hits", lambda x: x == c)).cast("long")).alias("counts"),
        F.size("hits").cast("long").alias("used"),
    )
    d = d.withColumn("rest", F.regexp_replace("t", "[a-z]+", "")).withColumn("rest2", F.regexp_replace("rest", " +", ""))
    size = lambda x: F.length(x).cast("long")
    without = lambda rx: size(F.col("rest2")) - size(F.regexp_replace("rest2", rx, ""))
    upper, digit, line = without("[A-Z]+"), without("[0-9]+"), without("[\\t\\n\\x0B\\f\\r]+")
    mark, wide = without("[.,;:!?'\"()-]+"), without("[^\\x00-\\x7F]+")
    sign = size(F.col("rest2")) - upper - digit - line - mark - wide
    classes = F.array(size(F.col("t")) - size(F.col("rest")), size(F.col("rest")) - size(F.col("rest2")), upper, digit, line, mark, sign, wide)
    symbols = size(F.col("rest2")) - size(F.translate("rest2", "#*$%&|<>", ""))  # the rest has all of them
    d = d.withColumn("classes", classes).withColumn("n_symbols", symbols)
    d = d.withColumn("counts", F.concat("counts", F.array(F.col("n_words") - F.col("used"))))
    return d.drop("t", "used", "rest", "rest2")


def common_words(docs: DataFrame, count: int = COMMON) -> DataFrame:
    """lang and its most frequent words, lower-cased (ties by the word), counted over all documents."""
    n = docs.select("lang", F.explode(_words(F.coalesce(F.col("text"), F.lit("")))).alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    n = n.groupBy("lang", F.lower("w").alias("w")).agg(F.sum("n").alias("n"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))
    top = n.withColumn("nth", nth).where(F.col("nth") <= count)
    return top.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "w"))), lambda x: x["w"]).alias("words"))


def _references(rows: DataFrame) -> DataFrame:
    """Shares of each language in all its documents: character classes and common words."""
    parts = [
        rows.select("lang", F.lit(kind).alias("kind"), F.posexplode(kind).alias("i", "n")).groupBy("lang", "kind", "i").agg(F.sum("n").alias("n")) for kind in ("classes", "counts")
    ]
    sums = parts[0].unionByName(parts[1]).groupBy("lang", "kind").agg(F.array_sort(F.collect_list(F.struct("i", "n"))).alias("a"), F.sum("n").alias("total"))
    shares = sums.select("lang", "kind", "total", F.transform("a", lambda x: F.when(F.col("total") > 0, x["n"] / F.col("total")).otherwise(0.0)).alias("share"))
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    return shares.groupBy("lang").agg(pick("classes", "share").alias("ref_classes"), pick("counts", "share").alias("ref_counts"), pick("counts", "total").alias("ref_words"))


def js_distance(counts: Column, share: Column) -> Column:
    """Jensen-Shannon distance of counts and shares, 0 to 1; null if there are no counts."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)

    def term(n: Column, q: Column) -> Column:
        p = n / total
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    twice = F.aggregate(F.zip_with(counts, share, term), F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.sqrt(F.greatest(twice / 2, F.lit(0.0))))


def judge(spark: SparkSession, docs: DataFrame, ws: Workspace, most_class: float = MOST_CLASS, most_word: float = MOST_WORD) -> DataFrame:
    """Base metrics, distances and verdict of each document."""
    common = ws.save(common_words(docs), "common")
    rows = ws.save(features(docs, common), "features")
    ref = ws.save(_references(rows), "references").withColumnRenamed("lang", "l")
    d = rows.join(ref, F.col("lang").eqNullSafe(F.col("l")), "left").drop("l")
    guard = (F.col("n_words") >= LEAST_WORDS) & (F.col("ref_words") >= LEAST_REFERENCE)
    d = d.withColumn("class_distance", F.when(guard, js_distance(F.col("classes"), F.col("ref_classes"))))
    d = d.withColumn("word_distance", F.when(guard, js_distance(F.col("counts"), F.col("ref_counts"))))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fits = (F.coalesce("class_distance", F.lit(0.0)) <= most_class) & (F.coalesce("word_distance", F.lit(0.0)) <= most_word)
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return d.select(*base, failed.alias("base_failed"), (~failed & fits).alias("kept"), "class_distance", "word_distance")


def op10_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(spark, table(spark, sf_dir, "documents"), Workspace(spark, "quality"))
    return out.withColumns({c: F.round(c, 4) for c in ("class_distance", "word_distance")})


QUERIES = {"op10_quality_divergence": op10_quality_divergence}
ORACLE: dict[str, str] = {}
