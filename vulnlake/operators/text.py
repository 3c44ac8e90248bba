"""TF-IDF over the most frequent terms."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizer, RegexTokenizer, StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tfidf_top_terms(df: DataFrame, key: str, text: str, n: int = 100) -> DataFrame:
    """Rows (key, term, weight): the `n` commonest terms of two letters or more, idf ln((1+N)/(1+df))+1, unit rows.

    Terms are named, not numbered. Stop words are Spark's English list. A null text has no terms.
    """
    texts = df.select(F.col(key).alias("key_"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text_"))
    words = RegexTokenizer(inputCol="text_", outputCol="words_", pattern=r"(?U)\b\w\w+\b", gaps=False).transform(texts)
    kept = StopWordsRemover(inputCol="words_", outputCol="kept_").transform(words)
    terms = CountVectorizer(inputCol="kept_", outputCol="tf_", vocabSize=n).fit(kept).vocabulary  # n terms
    chosen = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    counted = kept.select("key_", F.explode(F.filter("kept_", lambda w: F.array_contains(chosen, w))).alias("term")).groupBy("key_", "term").agg(F.count("*").alias("tf"))
    rows = df.agg(F.count("*").alias("rows"))
    idf = counted.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(rows)).select("term", (F.log((1 + F.col("rows")) / (1 + F.col("df"))) + 1).alias("idf"))
    weighed = counted.join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("key_").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norms, "key_").select(F.col("key_").alias(key), "term", (F.col("w") / F.col("norm")).alias("weight"))


def tfidf_columns(df: DataFrame, key: str, text: str, n: int = 100, prefix: str = "tfidf_") -> tuple[DataFrame, list[str]]:
    """The weights as a column for each of the `n` terms, zero where a text lacks it; texts without any of them have no row."""
    long = tfidf_top_terms(df, key, text, n).persist()
    terms = sorted(r["term"] for r in long.select("term").distinct().collect())  # n terms
    wide = long.groupBy(key).pivot("term", terms).agg(F.first("weight"))
    quoted = lambda t: F.col("`" + t.replace("`", "``") + "`")
    names = [f"{prefix}{i}" for i in range(len(terms))]
    return wide.select(key, *[F.coalesce(quoted(t), F.lit(0.0)).alias(name) for name, t in zip(names, terms)]), names
