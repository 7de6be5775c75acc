"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Words are runs of characters other than space and tab to carriage return. Every measure comes from one
pass over the row's own text; nothing is shuffled. Three-word windows are compared by XXH64 of their
words within one text.

Edge cases: a very long text is one row of one task, judged whole; a null text counts as empty, has no words and fails the base rule; ratios over nothing are
0; repeated rows are judged alike; an empty table gives an empty result; no column but the id and the
text is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les du un une que est pour qui dans par sur pas au avec en "
    "el y los se del las por con no su para es al lo una"
).split()

#: (rule, measure, least, most); a document is kept if every measure lies within its bounds.
THRESHOLDS = [
    ("word length", "mean_word_chars", 2.0, 14.0),
    ("words in all", "n_words", 50, 1_000_000),
    ("symbols to characters", "symbol_ratio", 0.0, 0.08),
    ("shouting marks to words", "shout_ratio", 0.0, 0.3),
    ("stop words", "stop_ratio", 0.05, 1.0),
    ("repeated lines", "dup_line_ratio", 0.0, 0.5),
]


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """How many words lie in three-word windows that occur at least twice in ``words``."""
    nothing = F.array().cast("array<int>")

    def starts(w: Column) -> Column:
        hashed = F.sort_array(
            F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        )
        hit = lambda s: F.filter(
            s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get(s, k + 1)["h"]).eqNullSafe(True)
        )
        return let(hashed, lambda s: F.sort_array(F.transform(hit(s), lambda x: x["i"])))

    covered = lambda p: F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0).cast("int"), lambda a, x: a + x
    )
    return let(words, lambda w: let(F.when(F.size(w) >= 3, starts(w)).otherwise(nothing), covered)).cast("long")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and the ratios that the rules bound."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select(F.col("doc_id"), text.alias("_t"), words_of(text).alias("_w"))
    counted = split.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(F.filter(F.split(F.col("_t"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda v: F.struct(F.size(v).alias("n"), F.size(F.array_distinct(v)).alias("d"))).alias("_l"),
        repeat_words(F.col("_w")).alias("n_repeat_words"),
        F.size(F.filter("_w", lambda w: w.isin(STOP_WORDS))).alias("_stop"),
        (F.length("_t") - F.length(F.translate("_t", "!", ""))).alias("_shout"),
    )
    return counted.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.col("_l.n") - F.col("_l.d")).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        _ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"),
        _ratio(F.col("n_symbols"), F.col("word_chars")).alias("symbol_ratio"),
        _ratio(F.col("_shout"), F.col("n_words")).alias("shout_ratio"),
        _ratio(F.col("_stop"), F.col("n_words")).alias("stop_ratio"),
        _ratio(F.col("_l.n") - F.col("_l.d"), F.col("_l.n")).alias("dup_line_ratio"),
    )


def quality_rules(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Per row of ``docs`` its counts, ratios, base_failed and kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    passed = F.lit(True)
    for _, measure, least, most in thresholds:
        passed = passed & F.col(measure).between(least, most)
    return measured(docs).withColumn("base_failed", failed).withColumn("kept", ~failed & passed)


def oracle_sql(table: str = "documents", thresholds=THRESHOLDS) -> str:
    """The same for DuckDB."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    rules = " AND ".join(f"{m} BETWEEN {a} AND {b}" for _, m, a, b in thresholds)
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM {table}),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM c WHERE n > 1) GROUP BY doc_id),
m AS (SELECT t.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
        len(list_filter(w, lambda x: x IN ({stop}))) AS stop, length(t) - length(replace(t, '!', '')) AS shout
      FROM t LEFT JOIN r USING (doc_id)),
x AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
        CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS mean_word_chars,
        CASE WHEN word_chars > 0 THEN n_symbols::DOUBLE / word_chars ELSE 0 END AS symbol_ratio,
        CASE WHEN n_words > 0 THEN shout::DOUBLE / n_words ELSE 0 END AS shout_ratio,
        CASE WHEN n_words > 0 THEN stop::DOUBLE / n_words ELSE 0 END AS stop_ratio,
        CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_line_ratio,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {rules} AS kept FROM x
"""
