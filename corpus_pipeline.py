"""A corpus pipeline of five stages: quality rules, language ID, near-dedup, repeated passages, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vulnlake.llm import langid, near, packing, quality, suffixes
from vulnlake.llm.common import checkpointed, documents, removed, written

#: A language that is less likely than this is not taken.
LEAST_SCORE = 0.5


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column's name for use in expressions, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows are matched on id, text, language and source, nulls included.

    Null and empty texts have no words and go; repeated rows are judged alike; an empty table gives an empty one; a very
    long text is judged whole. A missing `lang` or `source` column counts as one unnamed group.
    """
    kept = quality.judged(docs).filter("kept")
    group = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    same = docs["doc_id"].cast("long").eqNullSafe(kept["doc_id"]) & F.xxhash64(docs["text"].cast("string")).eqNullSafe(kept["text_hash"])
    return docs.join(kept, same & (group("lang") == kept["lang"]) & (group("source") == kept["source"]), "left_semi")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is recognised; a missing `lang` is filled in. Without any known language all stay.

    Null texts and those without a letter go. Repeated rows are judged alike; an empty table gives an empty one.
    """
    model = langid.fit(docs.filter(~langid.held_out())) if "lang" in docs.columns else None
    if not model or not model.langs:
        return docs
    p = fresh(docs, "prediction")
    found = docs.withColumn(p, langid.prediction(model, spark)("text"))
    sure = (F.col(f"{p}.lang_pred") != "und") & (F.col(f"{p}.score") >= LEAST_SCORE)
    return found.filter(sure).withColumn("lang", F.coalesce("lang", f"{p}.lang_pred")).select(*map(quoted, docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more), that with the smallest id
    and then hash of its text, null ids last; of equal rows, one. Rows are matched on id and text, nulls included.

    Null texts are empty ones, and all texts without a word are one group. An empty table gives an empty one. A very long
    text is compared whole.
    """
    rows, named = near.groups(docs)
    counted = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "n")
    chosen = checkpointed(counted.join(named, "text_hash").groupBy("component").agg(F.min(order).alias("c")).select("c.doc_id", "c.text_hash", "c.n"))
    same = docs["doc_id"].cast("long").eqNullSafe(chosen["doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == chosen["text_hash"])
    left = docs.join(chosen, same, "left_semi")
    if chosen.filter("n > 1").isEmpty():
        return left
    place = fresh(docs, "place")
    ordered = W.partitionBy("doc_id", F.xxhash64(F.col("text").cast("string"))).orderBy(F.lit(0))
    return left.withColumn(place, F.row_number().over(ordered)).filter(F.col(quoted(place)) == 1).select(*map(quoted, docs.columns))


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of over 50 words that occur elsewhere; a torn character is replaced.

    Null texts become empty ones. Repeated rows are each other's copies, an empty table gives an empty one, and very
    long texts are searched whole.
    """
    others = {c: f"other_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    coded = docs.select("doc_id", "text", *[F.col(quoted(c)).alias(o) for c, o in others.items()])
    length, words = suffixes.PASSAGE
    done = suffixes.deduplicated(coded, length=length, least_words=words, keep=tuple(others.values()))
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    new = {"doc_id": F.col("doc_id"), "text": text, **{c: F.col(o) for c, o in others.items()}}
    if "n_chars" in others:
        new["n_chars"] = F.length(text).cast("long")
    return done.select(*[new[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens. Null and empty texts are their end id alone; repeated rows are packed as often as they occur.
    An empty table gives no sequences, a very long text is cut into full ones."""
    return packing.best_fit_pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("language ID", language),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("best-fit packing", pack),
]

#: Languages, fingerprints, repeated passages and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each on the written result of the one before."""
    docs, places = documents(spark, sf_dir), []
    for _, stage in STAGES[:-1]:
        docs, place = written(stage(spark, docs, sf_dir))
        places.append(place)
    packed = STAGES[-1][1](spark, docs, sf_dir)  # its pieces are checkpointed
    for place in places:
        removed(spark, place)
    return packed


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
