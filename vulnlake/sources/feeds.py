"""Readers of landed feed files, and the tidy row of a nested vulnerability record."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.functions.coerce import moment, number
from vulnlake.operators.upsert import newest
from vulnlake.sources import json_ranges

METRIC = "array<struct<cvssData:struct<baseScore:double,baseSeverity:string,vectorString:string,attackVector:string>,exploitabilityScore:double,impactScore:double>>"
TEXTS = "array<struct<lang:string,value:string>>"
NODE = "struct<operator:string,cpeMatch:array<struct<criteria:string,cpe23Uri:string>>,cpeMatches:array<struct<criteria:string,cpe23Uri:string>>,children:array<struct<cpeMatch:array<struct<criteria:string,cpe23Uri:string>>>>>"
#: Layout of feed records.
NVD = (
    f"vulnerabilities array<struct<cve:struct<id:string,sourceIdentifier:string,published:string,lastModified:string,descriptions:{TEXTS},description:{TEXTS},"
    f"metrics:struct<cvssMetricV31:{METRIC},cvssMetricV30:{METRIC},cvssMetricV2:{METRIC}>,weaknesses:array<struct<description:{TEXTS}>>,configurations:array<struct<nodes:array<{NODE}>>>,"
    "references:array<struct<url:string>>,cisaExploitAdd:string,cisaActionDue:string,cisaRequiredAction:string,cisaVulnerabilityName:string>>>"
)
NVD_RECORD = NVD.removeprefix("vulnerabilities array<").removesuffix(">")
KEV = "cveID string, vendorProject string, product string, vulnerabilityName string, dateAdded string, shortDescription string, requiredAction string, dueDate string, knownRansomwareCampaignUse string"
JVN = (
    "title string, link string, description string, `dc:date` string, `sec:identifier` string, `sec:cvss` array<struct<_score:string,_severity:string>>, "
    "`sec:references` array<struct<_source:string,_id:string,_VALUE:string>>, `sec:cpe` array<struct<_vendor:string,_product:string,_VALUE:string>>"
)
EUVD_ITEM = "struct<id:string,description:string,datePublished:string,dateUpdated:string,exploitedSince:string,baseScore:double,baseScoreVersion:string,baseScoreVector:string,references:string,aliases:string,assigner:string,epss:double>"
#: Fixed value: the form of dates in the EUVD feed.
EUVD_FORM = "MMM d, yyyy, h:mm:ss a"


def read_nvd_feed(spark: SparkSession, path: str) -> DataFrame:
    """One nested record `cve` per vulnerability of JSON pages, each read by as many tasks as it has byte ranges."""
    found = json_ranges.records(spark, path).select(F.from_json("record", NVD_RECORD).alias("v"))
    return found.select("v.cve").filter("cve.id is not null")


def read_kev_feed(spark: SparkSession, path: str) -> DataFrame:
    """The CSV catalogue with typed dates; a missing file is an empty table."""
    try:
        rows = spark.read.option("header", True).option("multiLine", True).option("enforceSchema", False).schema(KEV).csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], KEV)
    listed = rows.withColumns({"dateAdded": moment(F.col("dateAdded")), "dueDate": moment(F.col("dueDate"))})
    return listed.withColumnsRenamed({"cveID": "cve_id", "dateAdded": "dateadded", "dueDate": "duedate", "knownRansomwareCampaignUse": "knownransomwarecampaignuse"}).withColumn("kev_listed", F.lit(True))


def read_jvn_feed(spark: SparkSession, path: str) -> DataFrame:
    """One row per RSS item: ids, date, first score, CVE references joined by comma, products as vendor:product."""
    items = spark.read.format("xml").option("rowTag", "item").schema(JVN).load(path)
    refs = F.transform(F.filter("`sec:references`", lambda r: r["_source"] == "CVE"), lambda r: r["_id"])
    products = F.transform("`sec:cpe`", lambda c: F.concat_ws(":", c["_vendor"], c["_product"]))
    published = moment(F.col("`dc:date`"))
    return items.select(
        F.year(published).alias("year"), F.col("`sec:identifier`").alias("jvndb_id"), "title", "description", published.alias("published_date"),
        number(F.col("`sec:cvss`")[0]["_score"]).alias("cvss_score"), F.col("`sec:cvss`")[0]["_severity"].alias("cvss_severity"),
        F.array_join(refs, ", ").alias("cve_ids"), F.array_join(products, "; ").alias("affected_products"), "link",
    )


def read_euvd_feed(spark: SparkSession, path: str) -> DataFrame:
    """Records of page envelopes (`items` or `content`), three dates parsed; the last of an id stays, by page number, file and
    place. Pages are read by as many tasks as they have byte ranges."""
    found = json_ranges.records(spark, path).select("file", "block", "place", F.from_json("record", EUVD_ITEM).alias("r")).select("file", "block", "place", "r.*")
    dates = {c: F.coalesce(F.try_to_timestamp(F.col(c), F.lit(EUVD_FORM)), moment(F.col(c))) for c in ("datePublished", "dateUpdated", "exploitedSince")}
    order = [json_ranges.page_number(F.col("file")), F.col("file"), F.col("block"), F.col("place")]
    return newest(found.withColumns(dates).filter("id is not null"), "id", order).drop("file", "block", "place")


def sorted_text(values: Column) -> Column:
    """Distinct values that are not empty, sorted, joined by " | "."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))), " | ")


def pick_english_description(descriptions: Column) -> Column:
    english = F.transform(F.filter(descriptions, lambda d: d["lang"] == "en"), lambda d: d["value"])
    return F.nullif(F.array_join(english, " "), F.lit(""))


def pick_cvss_metric(metrics: Column) -> Column:
    """The first entry of version 3.1, else 3.0, else 2.0, as a struct of seven fields."""
    picked = F.lit(None)
    for name, version in (("cvssMetricV2", "2.0"), ("cvssMetricV30", "3.0"), ("cvssMetricV31", "3.1")):
        m = F.get(metrics[name], 0)
        fields = F.struct(
            m["cvssData"]["baseScore"].alias("cvss_basescore"), m["cvssData"]["baseSeverity"].alias("cvss_baseseverity"), m["cvssData"]["vectorString"].alias("cvss_vectorstring"),
            m["cvssData"]["attackVector"].alias("cvss_attackvector"), m["exploitabilityScore"].alias("cvss_exploitability"), m["impactScore"].alias("cvss_impact"), F.lit(version).alias("cvss_version"),
        )
        picked = F.when(F.size(metrics[name]) > 0, fields).otherwise(picked)
    return picked


def extract_cwe_ids(weaknesses: Column) -> Column:
    """Sorted distinct CWE ids of nested descriptions, with the two sentinels for none and other."""
    texts = F.flatten(F.transform(weaknesses, lambda w: F.transform(w["description"], lambda d: d["value"])))
    ids = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(r"(NVD-CWE-noinfo|NVD-CWE-Other|CWE-\d{1,5})"), 1)))
    return F.array_sort(F.array_distinct(F.coalesce(ids, F.array().cast("array<string>"))))


def extract_cpe_vendor_product(configurations: Column) -> Column:
    """Struct of sorted distinct vendors and products of all CPE names, at any depth."""
    text = F.coalesce(F.to_json(configurations), F.lit(""))
    part = lambda k: sorted_text(F.regexp_extract_all(text, F.lit(r"cpe:2\.3:[aho]:([^:\"]*):([^:\"]*)"), k))
    return F.struct(part(1).alias("vendors"), part(2).alias("products"))


def join_references(references: Column) -> Column:
    return sorted_text(F.transform(references, lambda r: r["url"]))


def tidy_nvd(records: DataFrame) -> DataFrame:
    """The flat row of each nested record, with the record as JSON text."""
    c = F.col("cve")
    cpe, cwe = extract_cpe_vendor_product(c["configurations"]), extract_cwe_ids(c["weaknesses"])
    texts = F.coalesce(c["descriptions"], c["description"])
    return records.select(
        c["id"].alias("id"), c["sourceIdentifier"].alias("sourceidentifier"), moment(c["published"]).alias("published"), moment(c["lastModified"]).alias("lastmodified"),
        pick_english_description(texts).alias("description_en"), cwe.alias("cwe_list"), F.array_join(cwe, " | ").alias("cwes"), join_references(c["references"]).alias("references"),
        cpe["vendors"].alias("vendors"), cpe["products"].alias("products"), pick_cvss_metric(c["metrics"]).alias("m"),
        moment(c["cisaExploitAdd"]).alias("cisa_exploit_add"), moment(c["cisaActionDue"]).alias("cisa_action_due"), c["cisaRequiredAction"].alias("cisa_required_action"),
        c["cisaVulnerabilityName"].alias("cisa_vulnerability_name"), c["cisaExploitAdd"].isNotNull().alias("is_known_exploited"), F.to_json(c).alias("raw_json"),
    ).select("*", "m.*").drop("m").filter("id is not null")
