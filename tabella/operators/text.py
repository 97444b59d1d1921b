"""Words, phrases and lexicon sentiment of free-text columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabella.functions.ordering import top_rows
from tabella.functions.scalar import c
from tabella.operators.stats import spearman
from tabella.session import widen

# The words left out of counts.
STOP = """a about above after again against all am an and any are as at be because been before being below between
both but by can could did do does doing down during each few for from further had has have having he her here hers
herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once
only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves
then there these they this those through to too under until up very was we were what when where which while who whom
why will with would you your yours yourself yourselves im ive dont didnt its it's i'm i've don't didn't also get got
one would really much even still us""".split()
SHORT_STOP = """a an and are as at be by for from has have in is it its of on or that the to was were will with this
these those not no but if then than so such into out up down over under about after before i you he she we they them our
your their his her my me us""".split()

WORD = r"[a-z][a-z']+"
HYPHEN_WORD = r"[a-z][a-z'-]+"
SCALE = 15.0
EDGE = 0.05
#: Bytes of text whose pairs of words one task counts.
PART_BYTES = 6 << 20


def words(col: Column, pattern: str = WORD) -> Column:
    """Lower-case words of a text, in order."""
    return F.regexp_extract_all(F.lower(col.cast("string")), F.lit(pattern), 0)


def tokens(col: Column, pattern: str = WORD, stop: list[str] = STOP) -> Column:
    """Words longer than two letters that are not stop words, in order."""
    skip = F.array(*[F.lit(w) for w in sorted(set(stop))])
    return F.filter(words(col, pattern), lambda w: (F.length(w) > 2) & ~F.array_contains(skip, w))


def tokenize(df: DataFrame, col: str, out: str = "tokens") -> DataFrame:
    return df.withColumn(out, tokens(c(col)))


def _kept_words(df: DataFrame, col: str, keep: list[str] = (), pattern: str = WORD, stop: list[str] = STOP) -> DataFrame:
    """One row per kept word. The stop test is a hashed IN on the exploded word."""
    df = widen(df.select(*[c(k) for k in keep], c(col)))
    one = df.select(*[c(k) for k in keep], F.explode(words(c(col), pattern)).alias("word"))
    return one.where((F.length("word") > 2) & ~F.col("word").isin(sorted(set(stop))))


def word_counts(df: DataFrame, col: str, top: int = 20) -> DataFrame:
    """The most common words; counted per task before the shuffle."""
    return _top_words(_kept_words(df, col), top)


def word_frequencies(df: DataFrame, col: str, top: int = 25) -> DataFrame:
    """The same with hyphenated words and a shorter stop list."""
    return _top_words(_kept_words(df, col, pattern=HYPHEN_WORD, stop=SHORT_STOP), top)


def _top_words(one: DataFrame, top: int) -> DataFrame:
    return one.groupBy("word").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "word").limit(top)


def phrase_counts(df: DataFrame, col: str, top: int = 15) -> DataFrame:
    """Pairs of neighbouring kept words that occur more than once."""
    size = df.agg(F.sum(F.octet_length(c(col).cast("string")))).first()[0] or 0
    parts = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(size / PART_BYTES))
    # A part's pairs are counted where its texts are, and only counts are dealt by phrase: no task holds more as texts grow.
    texts = df.where(c(col).isNotNull()).select(c(col), F.pmod(F.monotonically_increasing_id(), F.lit(parts)).alias("_part")).repartitionByRange(parts, "_part")
    t = tokens(c(col))
    pairs = F.zip_with(t, F.slice(t, 2, F.greatest(F.size(t), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    one = texts.select("_part", F.explode(pairs).alias("phrase")).where("phrase is not null")
    each = one.groupBy("_part", "phrase").agg(F.count("*").alias("count"))
    counts = each.repartition(parts, "phrase").groupBy("phrase").agg(F.sum("count").alias("count"))
    return counts.orderBy(F.desc("count"), "phrase").limit(top).where("count > 1")


# ------------------------------------------------------------------ sentiment
def label(score: Column) -> Column:
    return F.when(score >= EDGE, "Positive").when(score <= -EDGE, "Negative").otherwise("Neutral")


def lexicon_sentiment(df: DataFrame, key: str, col: str, lexicon: DataFrame) -> DataFrame:
    """Score -1..1 per text from a (word, valence) table, with its label and word count.

    Each text's words are summed in the task that reads it, so one row per text is
    shuffled; Spark chooses the join with the lexicon by the lexicon's size.
    """
    df = widen(df.select(c(key), c(col)))
    text = F.coalesce(c(col).cast("string"), F.lit(""))
    # Whole-text facts come before the explode, or they would be worked out per word.
    # One empty word keeps texts without any match.
    whole = df.select(
        c(key),
        (~text.rlike(r"\S")).alias("blank"),
        F.regexp_count(text, F.lit(r"\S+")).alias("word_count"),
        F.concat(F.array(F.lit("")), words(text)).alias("words"),
    )
    one = whole.select(c(key), "blank", "word_count", F.explode("words").alias("word"))
    per = one.join(lexicon.select("word", F.col("valence").cast("double").alias("valence")), "word", "left")
    total = per.groupBy(c(key)).agg(
        F.coalesce(F.sum("valence"), F.lit(0.0)).alias("s"), F.first("blank").alias("blank"), F.first("word_count").alias("word_count")
    )
    score = F.when(~F.col("blank"), F.col("s") / F.sqrt(F.col("s") * F.col("s") + SCALE))
    out = total.withColumn("sentiment_score", score)
    return out.select(
        c(key), "sentiment_score", F.when(F.col("blank"), "No text").otherwise(label(F.col("sentiment_score"))).alias("sentiment"), "word_count"
    )


def sentiment_by_group(scored: DataFrame, group: str) -> DataFrame:
    """Comments, average score and shares per group, worst first."""
    share = lambda word: F.round(100 * F.avg((F.col("sentiment") == word).cast("double")), 1)
    return (
        scored.where((F.col("sentiment") != "No text") & c(group).isNotNull())
        .groupBy(c(group))
        .agg(
            F.count("*").alias("comments"),
            F.round(F.avg("sentiment_score"), 3).alias("average_score"),
            share("Positive").alias("positive_pct"),
            share("Negative").alias("negative_pct"),
        )
        .orderBy("average_score", c(group))
    )


def words_by_sentiment(df: DataFrame, col: str, sentiment: str = "sentiment", top: int = 12) -> DataFrame:
    """The most common words of positive and of negative texts."""
    one = _kept_words(df.where(c(sentiment).isin("Positive", "Negative")), col, [sentiment])
    counts = one.groupBy(c(sentiment), "word").agg(F.count("*").alias("count"))
    order = [F.desc("count"), F.col("word")]
    # Two groups hold the whole vocabulary: each is thinned in many tasks before its few rows are numbered.
    few = top_rows(counts, [sentiment], order, top)
    return few.withColumn("place", F.row_number().over(Window.partitionBy(c(sentiment)).orderBy(*order)))


def score_vs_rating(df: DataFrame, score: str, rating: str) -> DataFrame:
    """Rank correlation of the score with a rating column."""
    return df.sparkSession.createDataFrame([(spearman(df, score, rating),)], "rho double")
