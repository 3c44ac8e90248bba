"""Quality rules whose thresholds follow the data: mergeable quantile sketches per language and source.

A sketch is a histogram over integer bins: values below 64 are bins of their own, larger ones keep their six leading
bits (a relative error below 1/32). Sketches of any two parts of a table merge by adding counts, whatever the order,
so the thresholds are exact functions of the table and a hot source is pre-aggregated before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vulnlake.llm.common import checkpointed, slices

#: Fixed values.
SYMBOLS = b"#*$%&|<>"
BLANKS = " \t\n\v\f\r"

#: Measures in thousandths (mean word length: hundredths), with the least slack a threshold leaves above the quartile.
SLACK = {"symbols": 30, "dup_lines": 350, "repeats": 300, "word_length": 120}
#: A group with fewer documents uses the sketch of its language, and that of all documents below this too.
LEAST_GROUP = 50
#: Quartile distances beyond the upper (lower) quartile at which a value is out of line.
REACH = 4


def base_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    for batch in batches:
        for part in slices(batch, "text"):
            rows = [base_measures(t or "") for t in part["text"].to_pylist()]
            found = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(names)
            keep = [n for n in part.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[part[n] for n in keep], *found], names=[*keep, *names])


def base_measures(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the lines that have a word."""
    raw = text.encode()
    words = raw.split()  # bytes split at ASCII blanks only
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(distinct := set(windows)) < len(windows):
        seen: set = set()
        twice = {w for w in windows if w in seen or seen.add(w)} if distinct else set()
        upto = -1  # last word already counted
        for i, w in enumerate(windows):
            if w in twice:
                repeated += i + 2 - max(upto, i - 1)
                upto = i + 2
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), len(text) - sum(map(text.count, BLANKS)), symbols, len(lines) - len(set(lines)), repeated, len(lines)


def bin_of(value: Column) -> Column:
    """The sketch's bin: the value, or its six leading bits followed by zeros."""
    shift = F.greatest(F.lit(0), F.length(F.bin(value)) - 6)
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift.cast("int")), shift.cast("int"))


def sketches(measures: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Rows (keys, measure, bin, n): one mergeable sketch for each key and measure."""
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), bin_of(F.col(n)).alias("bin")) for n in names]))
    return measures.select(*keys, values.alias("v")).groupBy(*keys, "v.measure", "v.bin").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, measure, total, lower, upper): smallest bins at or above a quarter and three quarters of the counts."""
    by = W.partitionBy(*keys, "measure")
    seen = sketch.withColumn("seen", F.sum("n").over(by.orderBy("bin"))).withColumn("total", F.sum("n").over(by))
    at = lambda q: F.min(F.when(F.col("seen") * 4 >= F.col("total") * q, F.col("bin")))
    return seen.groupBy(*keys, "measure").agg(F.first("total").alias("total"), at(1).alias("lower"), at(3).alias("upper"))


def measured(docs: DataFrame) -> DataFrame:
    """Base columns and measures of every whole text, with null languages and sources as their own groups."""
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    groups = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in docs.columns else F.lit("").alias(c) for c in ("lang", "source")]
    key = F.xxhash64("text").alias("text_hash")
    schema = "doc_id long, lang string, source string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
    base = docs.select(*columns, *groups).select("doc_id", "lang", "source", key, "text").mapInArrow(base_rows, schema)
    share = lambda part, whole, unit: F.floor(F.lit(unit) * F.col(part) / F.greatest(F.col(whole), F.lit(1))).cast("long")
    return base.withColumns({
        "symbols": share("n_symbols", "word_chars", 1000), "dup_lines": share("n_dup_lines", "n_lines", 1000),
        "repeats": share("n_repeat_words", "n_words", 1000), "word_length": share("word_chars", "n_words", 100),
        "base_failed": (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50),
    })


def thresholds(measures: DataFrame) -> DataFrame:
    """Limits (lang, source, measure, low, high), from the finest sketch with `LEAST_GROUP` documents.

    Documents that fail the base rules don't shape the sketches. The table has a row for each language, source and measure.
    """
    fine = checkpointed(sketches(measures.filter(~F.col("base_failed")), ["lang", "source"], list(SLACK)))
    levels = [(["lang", "source"], fine), (["lang"], fine.groupBy("lang", "measure", "bin").agg(F.sum("n").alias("n"))), ([], fine.groupBy("measure", "bin").agg(F.sum("n").alias("n")))]
    slack = F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(s).cast("long").alias("slack")) for m, s in SLACK.items()])
    limits = measures.select("lang", "source").distinct().select("lang", "source", F.inline(slack))
    for k, (keys, sketch) in enumerate(levels):
        found = quartiles(sketch, keys).select(*keys, "measure", F.struct("total", "lower", "upper").alias(f"q{k}"))
        limits = limits.join(found, [*keys, "measure"], "left")
    big = lambda k: F.when(F.col(f"q{k}.total") >= LEAST_GROUP, F.col(f"q{k}"))
    q = limits.withColumn("q", F.coalesce(big(0), big(1), F.col("q2")))
    reach = F.lit(REACH) * (F.col("q.upper") - F.col("q.lower"))
    return q.select("lang", "source", "measure", (F.col("q.lower") - reach - F.col("slack")).alias("low"), (F.col("q.upper") + reach + F.col("slack")).alias("high"))


def judged(docs: DataFrame) -> DataFrame:
    """Base columns, `base_failed` and `kept` of each row, by adaptive limits joined on language and source.

    kept is false for a base failure, else true unless a measure is above its high limit (word length: outside both).
    A null or empty text has no words and fails. Repeated rows are judged alike; an empty table gives no rows; a
    very long text is judged whole; columns of other names than those used are left out.
    """
    measures = checkpointed(measured(docs))
    wide = thresholds(measures).groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{side}_{m}") for m in SLACK for side in ("low", "high")])
    above = [F.col(m) > F.col(f"high_{m}") for m in SLACK]
    out = F.coalesce(above[0] | above[1] | above[2] | above[3] | (F.col("word_length") < F.col("low_word_length")), F.lit(False))
    return measures.join(wide, ["lang", "source"], "left").withColumn("kept", ~F.col("base_failed") & ~out)
