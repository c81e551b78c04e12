"""Operator 10: quality rules with cross-document line frequency, in DataFrame functions alone.

Base rules count words, symbols, repeated lines and repeated three-word windows of a text. The method
hashes normalised lines (lower case, white space runs as one space, digit runs as 0) and counts, per
host (the source), the distinct documents with each line; exact copies are one document, as repeated
text is no template. Lines that over ``share`` of the host's documents have, and ``least_docs`` at
least, are above the limit and removed. A document that keeps less than ``keep`` of its words is
depleted and rejected.

Edge cases: a null text has no words, so it fails the base rules. A null host is a host of its own.
Rows that repeat each get their row, and count once for the limits. Texts are taken whole, however long.
An empty table gives an empty result. Columns other than the key, text and host aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, materialise, table

MIN_WORDS, MAX_REPEAT = 50, 50
SHARE, LEAST_DOCS, KEEP = 0.05, 10, 0.3
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def normalised(words: Column) -> Column:
    """A line by its words."""
    return F.regexp_replace(F.lower(F.array_join(words, " ")), "[0-9]+", "0")


def base_features(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and lines
    (array of hash and words) to a frame with column t, a text without null."""
    spoken = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumns({"words": words_of(F.col("t")), "spoken": spoken})
    window = lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))
    df = df.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": F.when(F.col("t").rlike(f"[{SYMBOLS}]"), F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).otherwise(0).cast("long"),
        "n_dup_lines": (F.size("spoken") - F.size(F.array_distinct("spoken"))).cast("long"),
        "lines": F.transform(F.transform("spoken", words_of), lambda x: F.struct(F.xxhash64(normalised(x)).alias("h"), F.size(x).alias("w"))),
        "hashes": F.slice(F.transform("words", window), 1, F.greatest(F.size("words") - 2, F.lit(0))),
    })
    # Only texts in which a window comes again pay for sorting with positions.
    again = F.size(F.array_distinct("hashes")) < F.size("hashes")
    df = df.withColumn("sorted", F.when(again, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = lambda e, j: F.coalesce(F.get("sorted", j - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get("sorted", j + 1)["h"] == e["h"], F.lit(False))
    df = df.withColumn("starts", F.transform(F.filter("sorted", twin), lambda e: e["i"]))
    # Each start covers three words, or as many as there are up to the next one.
    covered = F.aggregate(
        F.sort_array("starts"), F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")),
        lambda s, i: F.struct(i.alias("at"), (s["n"] + F.least(i - s["at"], F.lit(3))).alias("n")), lambda s: s["n"],
    )
    df = df.withColumn("n_repeat_words", F.when(F.col("starts").isNull(), F.lit(0)).otherwise(covered).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("words", "spoken", "hashes", "sorted", "starts")


def frequent_lines(features: DataFrame, share: float, least_docs: int) -> DataFrame:
    """(host, h) of lines above the limit, from columns host, th (the text's hash) and lines."""
    each = features.select("host", "th", F.explode(F.transform("lines", lambda x: x["h"])).alias("h"))
    # One row per text and line first, keyed by all three: a hot line or host is spread.
    counts = each.distinct().groupBy("host", "h").count().filter(F.col("count") >= least_docs)
    hosts = features.select("host", "th").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    return counts.join(hosts, "host").filter(F.col("count") > share * F.col("texts")).select("host", "h")


def removed_words(features: DataFrame, share: float, least_docs: int) -> DataFrame:
    """(uid, n_removed_words) of the rows that hold boilerplate lines."""
    each = features.select("uid", "host", F.explode("lines").alias("line")).select("uid", "host", F.col("line.h").alias("h"), F.col("line.w").cast("long").alias("w"))
    return each.join(frequent_lines(features, share, least_docs), ["host", "h"], "left_semi").groupBy("uid").agg(F.sum("w").alias("n_removed_words"))


def rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", share: float = SHARE, least_docs: int = LEAST_DOCS, keep: float = KEEP) -> DataFrame:
    """key, th (xxhash64 of the text), base features, base_failed, n_removed_words and kept of every row."""
    named = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.coalesce(F.concat(F.lit("h"), F.col(host)), F.lit("")).alias("host"))
    features = base_features(named.withColumns({"uid": F.monotonically_increasing_id(), "th": F.xxhash64("t")}))
    features = materialise(features.drop("t"), "quality")
    removed = removed_words(features, share, least_docs)
    out = features.drop("lines", "host").join(removed, "uid", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
    depleted = F.col("n_words") - F.col("n_removed_words") < keep * F.col("n_words")
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("uid").withColumnRenamed("key", key)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(table(spark, sf_dir, "documents")).drop("th")


#: The same rules in DuckDB's SQL; "docs" (rn, doc_id, source, t) names the input.
RULES_SQL = r"""
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
win AS (SELECT rn, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
        FROM (SELECT rn, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
cov AS (SELECT rn, count(DISTINCT p) AS n FROM (SELECT rn, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, g) AS c FROM win) WHERE c > 1) GROUP BY rn),
ln AS (SELECT rn, coalesce('h' || source, '') AS host, t,
              trim(regexp_replace(trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]+', '0', 'g')) AS h,
              len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS n
       FROM (SELECT rn, source, t, unnest(lines) AS x FROM w)),
hosts AS (SELECT coalesce('h' || source, '') AS host, count(DISTINCT t) AS texts FROM docs GROUP BY 1),
freq AS (SELECT host, h FROM (SELECT host, h, count(DISTINCT t) AS c FROM ln GROUP BY 1, 2) JOIN hosts USING (host)
         WHERE c >= 10 AND c > 0.05 * texts),
hits AS (SELECT * FROM ln SEMI JOIN freq USING (host, h)),
gone AS (SELECT rn, sum(n) AS n FROM hits GROUP BY rn),
ruled AS (SELECT w.rn, doc_id, len(words)::BIGINT AS n_words,
                 length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
                 (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
                 (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                 coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
          FROM w LEFT JOIN cov USING (rn) LEFT JOIN gone USING (rn)),
rated AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM ruled)
"""
QUERIES = {"op10_quality": op10_quality}
ORACLES = {
    "op10_quality": "WITH docs AS (SELECT row_number() OVER () AS rn, doc_id, source, coalesce(text, '') AS t FROM documents),"
    + RULES_SQL
    + """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words, base_failed,
       NOT base_failed AND NOT n_words - n_removed_words < 0.3 * n_words AS kept FROM rated"""
}
