"""Line-first quality rules, with built-in Spark functions only.

Every line that has a word is judged by itself (punctuation, navigation, boilerplate); failing lines are
removed, and a document that loses more than `max_loss` of its line characters is rejected.

Defined cases: null or blank text has no words, no lines and fails the base rule; repeated rows are judged each by
itself; other input columns are ignored; an empty table gives an empty result. Everything happens inside one row,
so no key can be hot and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import BLANK, BLANKS, fresh

SYMBOLS = "#*$%&|<>"
#: Fixed word lists of the line rules; both are matched in lower case.
BOILERPLATE = "all rights reserved|licensed under|released under the|cookie policy|privacy policy|terms of use|terms of service|javascript is disabled|enable javascript|powered by"
NAVIGATION = "home|menu|login|log in|sign in|sign up|sitemap|skip to content|read more|next page|previous page|back to top|share this"
NAV_LINE = rf"^({NAVIGATION})([ >|»·/:-]+({NAVIGATION}))*[ .>|»·/:-]*$"


def line_fails(line: Column, min_words: int = 3, max_marks: float = 0.10) -> Column:
    """Punctuation: more than `max_marks` of the visible characters are neither letters, digits nor sentence marks
    used once, or a line of fewer than `min_words` words ends without a sentence mark. Navigation: nothing but
    menu words. Boilerplate: a licence, rights or notice phrase."""
    low = F.lower(line)
    visible = F.length(F.translate(line, BLANKS, ""))
    marks = F.length(F.regexp_replace(line, r"[\p{L}\p{N}\p{M}\x20\x09-\x0D]", ""))
    few = F.size(F.split(F.btrim(line, F.lit(BLANKS)), BLANK)) < min_words
    unended = ~F.rlike(line, F.lit(r"[.!?:;\"'”’»)…。！？][\x20\x09-\x0D]*$"))
    return (
        ((marks > max_marks * visible) & (visible >= 20))
        | (few & unended)
        | F.rlike(F.btrim(low, F.lit(BLANKS)), F.lit(NAV_LINE))
        | F.rlike(low, F.lit(BOILERPLATE))
    )


def quality_rules(docs: DataFrame, max_loss: float = 0.5, repeat_window: int = 5, min_words: int = 10, max_repeat: int = 20) -> DataFrame:
    """doc_id, the base counts, base_failed, the line counts and the verdict `kept` for every row of `docs`."""
    k = repeat_window
    base = fresh(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    parted = base.select(
        "doc_id",
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0).alias("lines"),
        F.transform(F.filter(F.split("text", BLANK), lambda w: F.length(w) > 0), lambda w: F.xxhash64(w)).alias("hw"),
    )
    hashed = parted.select(
        "doc_id", "word_chars", "n_symbols", "lines",
        F.size("hw").cast("long").alias("n_words"),
        F.when(F.size("hw") >= k, F.transform(F.sequence(F.lit(0), F.size("hw") - k), lambda i: F.xxhash64(*[F.get("hw", i + j) for j in range(k)])))
        .otherwise(F.array().cast("array<bigint>")).alias("grams"),
        F.transform("lines", lambda x: F.struct(F.length(x).alias("n"), line_fails(x).alias("bad"))).alias("judged"),
    )
    # Only a text with a repeated window pays for sorting (hash, place) pairs.
    paired = hashed.select(
        "doc_id", "word_chars", "n_symbols", "n_words",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("judged", lambda x: x["bad"])).cast("long").alias("n_lines_removed"),
        F.aggregate("judged", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("line_chars"),
        F.aggregate("judged", F.lit(0).cast("long"), lambda a, x: a + F.when(x["bad"], x["n"]).otherwise(0)).alias("lost_chars"),
        F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).alias("pairs"),
    )
    same = lambda x, y: F.coalesce(x["g"] == y["g"], F.lit(False))
    found = paired.withColumn("at", F.sort_array(F.transform(F.filter("pairs", lambda x, j: same(x, F.get("pairs", j + 1)) | same(x, F.get("pairs", j - 1))), lambda x: x["i"])))
    start = F.struct(F.lit(-k).alias("p"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("at", start, lambda a, i: F.struct(i.alias("p"), (a["n"] + F.least(F.lit(k), i - a["p"])).alias("n")), lambda a: a["n"])
    counted = found.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("pairs", "at")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("lost_chars") <= max_loss * F.col("line_chars"))).alias("kept"),
        "n_lines", "n_lines_removed", "line_chars", "lost_chars",
    )


def clean_text(docs: DataFrame) -> DataFrame:
    """The operator's texts: doc_id and the lines that pass, joined by a line end."""
    passing = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: (F.length(F.translate(x, BLANKS, "")) > 0) & ~line_fails(x))
    return fresh(docs, "doc_id", "text").select("doc_id", F.array_join(passing, "\n").alias("text"))
