"""Feeds derived from the driver's tables: parts stand for vulnerabilities, line items for what sources publish."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.functions import features as fx
from vulnlake.functions.coerce import at
from vulnlake.functions.ids import cve_year, found_id
from vulnlake.operators import merge
from vulnlake.sources.feeds import NVD

AS_OF = "2000-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with an id, and the dates and scores of their line items by source."""
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    of = {"nvd": (flag == "A") & (F.col("l_suppkey") % 3 == 0), "jvn": (flag == "R") & (line == 1), "eu": (flag == "N") & (line == 2)}
    dates = [F.min(F.when(test, F.col("l_shipdate"))).alias(f"{s}_d") for s, test in of.items()]
    scores = [(F.max(F.when(of["jvn"], F.col("l_discount"))) * 100).alias("jvn_s"), (F.max(F.when(of["eu"], F.col("l_tax"))) * 100).alias("eu_s")]
    items = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(*dates, *scores, F.max("l_shipdate").alias("last_d"))
    keyed = table(spark, sf_dir, "part").withColumn("cve_id", F.concat(F.lit("CVE-"), 2000 + F.col("p_partkey") % 26, F.lit("-"), 10000 + F.col("p_partkey")))
    return keyed.join(items, F.col("p_partkey") == F.col("l_partkey"), "left")


def feeds(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    p = parts(spark, sf_dir)
    feed = lambda s, score: p.filter(F.col(f"{s}_d").isNotNull()).select("cve_id", at(f"{s}_d").alias("published"), score.alias("base_score"))
    return {
        "nvd": feed("nvd", F.col("p_size").cast("double") / 5), "jvn": feed("jvn", F.col("jvn_s")), "eu": feed("eu", F.col("eu_s")),
        "kev": p.filter("p_size >= 45").select("cve_id", at("last_d").alias("published")),
    }


def vector() -> Column:
    letter = lambda letters, place: F.substr(F.lit(letters), (place + 1).cast("int"), F.lit(1))
    k = F.col("p_partkey")
    half = lambda n: F.floor(k / n).cast("long")
    places = {"AV": ("NALP", k % 4), "AC": ("LH", k % 2), "PR": ("NLH", k % 3), "UI": ("NR", half(2) % 2), "S": ("UC", half(3) % 2), "C": ("NLHX", half(4) % 4), "I": ("HLN", half(5) % 3), "A": ("HLN", half(7) % 3)}
    return F.concat(F.lit("CVSS:3.1"), *[x for m, (letters, place) in places.items() for x in (F.lit(f"/{m}:"), letter(letters, place))])


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor, weakness (null for every other part), vector and texts of each id."""
    keyed = table(spark, sf_dir, "part").withColumn("cve_id", F.concat(F.lit("CVE-"), 2000 + F.col("p_partkey") % 26, F.lit("-"), 10000 + F.col("p_partkey")))
    weakness = F.when(F.col("p_partkey") % 2 != 0, F.col("p_type"))
    return keyed.select("cve_id", F.col("p_brand").alias("vendor"), weakness.alias("cwe"), vector().alias("cvss_vector"), F.col("p_name").alias("nvd_text"), F.col("p_type").alias("jvn_text"), "p_partkey", "p_retailprice")


def nvd_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records of parts, through the JSON text and schema of the feed."""
    k, say = F.col("p_partkey"), lambda lang, value: F.struct(F.lit(lang).alias("lang"), value.alias("value"))
    score = lambda n, *more: F.struct(F.struct((F.col("p_size").cast("double") / n).alias("baseScore"), *more).alias("cvssData"))
    cpe = F.concat(F.lit("cpe:2.3:a:"), F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", ""), F.lit(":tool"), k % 9, F.lit(":1"))
    record = F.struct(
        F.col("cve_id").alias("id"), F.array(say("en", F.col("p_name")), say("es", F.lit("x")), say("en", F.col("p_type"))).alias("descriptions"),
        F.struct(F.when(k % 3 == 0, F.array(score(5, F.lit("HIGH").alias("baseSeverity")))).otherwise(F.array()).alias("cvssMetricV31"), F.array(score(10)).alias("cvssMetricV2")).alias("metrics"),
        F.array(F.struct(F.array(say("en", F.concat(F.lit("CWE-"), k % 50)), say("en", F.lit("CWE-79"))).alias("description"))).alias("weaknesses"),
        F.array(F.struct(F.array(F.struct(F.array(F.struct(cpe.alias("criteria"))).alias("cpeMatch"))).alias("nodes"))).alias("configurations"),
        F.array(F.struct(F.concat(F.lit("https://b/"), k).alias("url")), F.struct(F.concat(F.lit("https://a/"), k).alias("url"))).alias("references"),
        F.when(k % 4 == 0, "2021-05-01").alias("cisaExploitAdd"),
    )
    keyed = table(spark, sf_dir, "part").withColumn("cve_id", F.concat(F.lit("CVE-"), 2000 + F.col("p_partkey") % 26, F.lit("-"), 10000 + F.col("p_partkey")))
    page = F.to_json(F.struct(F.array(F.struct(record.alias("cve"))).alias("vulnerabilities")))
    return keyed.select(F.explode(F.from_json(page, NVD).getField("vulnerabilities")).alias("v")).select("v.cve")


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feeds' rows merged: one pass over the line items, whose parts tell what each source published."""
    p = parts(spark, sf_dir)
    score = {"nvd": F.col("p_size").cast("double") / 5, "jvn": F.col("jvn_s").cast("double"), "eu": F.col("eu_s").cast("double")}
    row = lambda tag, when, value: F.struct(F.lit(tag).alias("tag"), F.struct(at(when).cast("timestamp").alias("published"), value.alias("base_score")).alias("r"))
    found = [F.when(F.col(f"{s}_d").isNotNull(), row(s, f"{s}_d", v)) for s, v in score.items()]
    listed = F.when(F.col("p_size") >= 45, row("kev", "last_d", F.lit(None).cast("double")))
    tagged = p.select(found_id(F.col("cve_id")).alias("cve_id"), F.inline(F.array_compact(F.array(*found, listed))))
    return merge.merge_tagged(tagged.filter(cve_year(F.col("cve_id")) >= 2002))


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return master(spark, sf_dir).join(metadata(spark, sf_dir), "cve_id", "left")


def dates() -> list[Column]:
    return [F.col(f"{s}_published") for s in ("nvd", "jvn", "eu")]


def day(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss")


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric features, label and year of each id, for rankers and survival models."""
    d = described(spark, sf_dir)
    flags = [F.col(f"{s}_present") for s in ("nvd", "jvn", "eu")]
    rows = d.withColumns({
        "is_kev": F.col("kev_present").cast("int"), "repo_publication_lag": fx.publication_lag(dates()), "cross_listing_count": fx.cross_listing_count(flags),
        "cross_listing_variance": fx.spread_days(dates(), 0), **fx.cvss_ordinals(F.col("cvss_vector")), "price": F.col("p_retailprice").cast("double"),
    })
    return merge.group_stat_join(rows, "vendor", {"vendor_frequency": F.count("*")})


FEATURES = ["base_score", "repo_publication_lag", "cross_listing_count", "cross_listing_variance", "vendor_frequency", "price", "cvss_av_ord", "cvss_pr_ord", "cvss_c_ord"]

#: The same views for DuckDB.
SQL = """
WITH items AS (
  SELECT l_partkey,
    min(CASE WHEN l_returnflag = 'A' AND l_suppkey % 3 = 0 THEN l_shipdate END) AS nvd_d,
    min(CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN l_shipdate END) AS jvn_d,
    min(CASE WHEN l_returnflag = 'N' AND l_linenumber = 2 THEN l_shipdate END) AS eu_d,
    max(CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN l_discount END) * 100 AS jvn_s,
    max(CASE WHEN l_returnflag = 'N' AND l_linenumber = 2 THEN l_tax END) * 100 AS eu_s,
    max(l_shipdate) AS last_d
  FROM lineitem GROUP BY l_partkey),
meta AS (
  SELECT 'CVE-' || (2000 + p_partkey % 26) || '-' || (10000 + p_partkey) AS cve_id, p_brand AS vendor,
    CASE WHEN p_partkey % 2 <> 0 THEN p_type END AS cwe, p_name AS nvd_text, p_type AS jvn_text, p_partkey, p_retailprice, p_size,
    'CVSS:3.1/AV:' || substr('NALP', CAST(1 + p_partkey % 4 AS INT), 1) || '/AC:' || substr('LH', CAST(1 + p_partkey % 2 AS INT), 1)
    || '/PR:' || substr('NLH', CAST(1 + p_partkey % 3 AS INT), 1) || '/UI:' || substr('NR', CAST(1 + (p_partkey // 2) % 2 AS INT), 1)
    || '/S:' || substr('UC', CAST(1 + (p_partkey // 3) % 2 AS INT), 1) || '/C:' || substr('NLHX', CAST(1 + (p_partkey // 4) % 4 AS INT), 1)
    || '/I:' || substr('HLN', CAST(1 + (p_partkey // 5) % 3 AS INT), 1) || '/A:' || substr('HLN', CAST(1 + (p_partkey // 7) % 3 AS INT), 1) AS cvss_vector
  FROM part),
p AS (SELECT * FROM meta LEFT JOIN items ON p_partkey = l_partkey),
nvd AS (SELECT cve_id, nvd_d AS d, CAST(p_size AS DOUBLE) / 5 AS s FROM p WHERE nvd_d IS NOT NULL),
jvn AS (SELECT cve_id, jvn_d AS d, jvn_s AS s FROM p WHERE jvn_d IS NOT NULL),
eu AS (SELECT cve_id, eu_d AS d, eu_s AS s FROM p WHERE eu_d IS NOT NULL),
kev AS (SELECT cve_id, last_d AS d FROM p WHERE p_size >= 45),
joined AS (
  SELECT coalesce(n.cve_id, j.cve_id, e.cve_id, k.cve_id) AS cve_id,
    n.cve_id IS NOT NULL AS nvd_present, j.cve_id IS NOT NULL AS jvn_present, e.cve_id IS NOT NULL AS eu_present, k.cve_id IS NOT NULL AS kev_present,
    n.d AS nvd_published, j.d AS jvn_published, e.d AS eu_published, k.d AS kev_published,
    n.s AS nvd_base_score, j.s AS jvn_base_score, e.s AS eu_base_score
  FROM nvd n FULL JOIN jvn j ON n.cve_id = j.cve_id FULL JOIN eu e ON e.cve_id = coalesce(n.cve_id, j.cve_id)
  FULL JOIN kev k ON k.cve_id = coalesce(n.cve_id, j.cve_id, e.cve_id)),
master AS (
  SELECT *, CAST(substr(cve_id, 5, 4) AS INT) AS cve_year,
    coalesce(nvd_published, jvn_published, eu_published, kev_published) AS published,
    coalesce(nvd_base_score, eu_base_score, jvn_base_score) AS base_score,
    concat_ws(', ', CASE WHEN nvd_present THEN 'NVD' END, CASE WHEN jvn_present THEN 'JVN' END, CASE WHEN eu_present THEN 'EUVD' END, CASE WHEN kev_present THEN 'KEV' END) AS sources,
    nvd_present::INT + jvn_present::INT + eu_present::INT + kev_present::INT AS source_count
  FROM joined WHERE CAST(substr(cve_id, 5, 4) AS INT) >= 2002),
described AS (SELECT master.*, vendor, cwe, cvss_vector, nvd_text, jvn_text, p_partkey, p_retailprice FROM master LEFT JOIN meta USING (cve_id))
"""
