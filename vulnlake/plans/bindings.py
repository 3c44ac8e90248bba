"""Queries over the driver's tables, one per operator, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.functions import coerce, features as fx, ids
from vulnlake.operators import concordance, density, learners, merge, ordering, pu, ranking, reports, splits, survival, text, upsert
from vulnlake.plans import views
from vulnlake.sources import feeds, tables
from vulnlake.streaming import jobs
from vulnlake.plans.views import AS_OF, FEATURES, SQL, described, feature_rows, master, table

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
TWINS: dict[str, str] = {}
r6 = lambda c, name: F.round(c, 6).alias(name)
day = views.day


def query(sql: str | None = None, views_sql: bool = True) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        FOUND[f.__name__] = f
        if sql:
            TWINS[f.__name__] = (SQL + sql) if views_sql else sql
        return f

    return add


# ---------------------------------------------------------------- ids, types


@query("SELECT p_partkey, 'CVE-' || (2000 + p_partkey % 26) || '-' || (10000 + p_partkey) AS cve_id FROM part", False)
def canonical_cve_id(spark, sf):
    p = table(spark, sf, "part")
    raw = F.concat(F.lit(" cve-"), 2000 + F.col("p_partkey") % 26, F.lit("-"), 10000 + F.col("p_partkey"), F.lit(" x"))
    df = p.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, raw).alias("id"), F.when(F.col("p_partkey") % 3 != 0, raw).alias("other"))
    return df.select("p_partkey", ids.canonical_cve_id(df, ["id"]).alias("cve_id"))


@query("""SELECT DISTINCT 'CVE-' || (2000 + o_custkey % 26) || '-' || (1000 + o_custkey) AS cve_id, true AS kev_listed FROM orders""", False)
def extract_ids_from_text(spark, sf):
    o = table(spark, sf, "orders")
    return ids.extract_ids_from_text(o.select(F.col("o_orderpriority").alias("a"), F.concat(F.lit("see cve-"), 2000 + F.col("o_custkey") % 26, F.lit("-"), 1000 + F.col("o_custkey"), F.lit(", and CVE-20")).alias("b")))


@query("""SELECT p_partkey, unnest(list_distinct(['CVE-2020-' || (1000 + p_partkey), 'CVE-2021-' || (1000 + p_partkey % 7)])) AS cve_id FROM part""", False)
def explode_aliases(spark, sf):
    k = F.col("p_partkey")
    alias = F.concat(F.lit("cve-2020-"), 1000 + k, F.lit("; GHSA-x|CVE-2021-"), 1000 + k % 7, F.lit("\nCVE-2020-"), 1000 + k, F.lit(", CVE-19-1"))
    return ids.explode_aliases(table(spark, sf, "part").select("p_partkey", alias.alias("aliases")), "aliases")


@query("SELECT cve_id, cve_year FROM master")
def cve_year(spark, sf):
    return master(spark, sf).select("cve_id", ids.cve_year(F.col("cve_id")).alias("cve_year"))


@query("SELECT o_orderkey AS order_key_x, o_totalprice AS o_total_price FROM orders", False)
def normalize_columns(spark, sf):
    o = table(spark, sf, "orders")
    return coerce.normalize_columns(o.select(F.col("o_orderkey").alias(" Order-Key  (x)"), F.col("o_totalprice").alias("O_Total Price"), F.col("o_custkey").alias("order key x")))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS all_k, '[' || event_id || ',' || user_id || ']' AS all_list FROM events", False)
def flatten_struct(spark, sf):
    e = table(spark, sf, "events")
    nested = F.struct(F.from_json("props", "k long").getField("k").alias("k"), F.array("event_id", "user_id").alias("list"))
    return coerce.flatten_struct(e.select("event_id", nested.alias("props")), "props", "all").drop("props")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d 00:00:00') END AS at FROM orders""", False)
def coerce_types(spark, sf):
    o = table(spark, sf, "orders")
    price = F.when(F.col("o_orderkey") % 5 == 0, "abc").otherwise(F.col("o_totalprice").cast("string"))
    when = F.when(F.col("o_orderkey") % 7 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T00:00Z'"))
    return coerce.coerce_types(o.select("o_orderkey", price.alias("price"), when.alias("at")), ["price"], ["at"]).withColumn("at", day("at"))


# ---------------------------------------------------------------- feeds, tables, streams


@query("""SELECT 'CVE-' || (2000 + p_partkey % 26) || '-' || (10000 + p_partkey) AS id, p_name || ' ' || p_type AS description_en,
  array_to_string(list_sort(list_distinct(['CWE-' || p_partkey % 50, 'CWE-79'])), ' | ') AS cwes,
  'https://a/' || p_partkey || ' | https://b/' || p_partkey AS "references", regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS vendors, 'tool' || p_partkey % 9 AS products,
  CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) / 5 ELSE CAST(p_size AS DOUBLE) / 10 END AS cvss_basescore, CASE WHEN p_partkey % 3 = 0 THEN '3.1' ELSE '2.0' END AS cvss_version,
  p_partkey % 4 = 0 AS is_known_exploited FROM part""", False)
def tidy_nvd(spark, sf):
    return feeds.tidy_nvd(views.nvd_records(spark, sf)).select("id", "description_en", "cwes", "references", "vendors", "products", "cvss_basescore", "cvss_version", "is_known_exploited")


_ID = "'CVE-' || (2000 + p_partkey % 26) || '-' || (10000 + p_partkey) AS id"


def of_records(spark, sf, column):
    return views.nvd_records(spark, sf).select(F.col("cve.id").alias("id"), column)


@query(f"SELECT {_ID}, p_name || ' ' || p_type AS description_en FROM part", False)
def pick_english_description(spark, sf):
    return of_records(spark, sf, feeds.pick_english_description(F.col("cve.descriptions")).alias("description_en"))


@query(f"""SELECT {_ID}, CAST(p_size AS DOUBLE) / CASE WHEN p_partkey % 3 = 0 THEN 5 ELSE 10 END AS cvss_basescore, CASE WHEN p_partkey % 3 = 0 THEN 'HIGH' END AS cvss_baseseverity,
  CASE WHEN p_partkey % 3 = 0 THEN '3.1' ELSE '2.0' END AS cvss_version FROM part""", False)
def pick_cvss_metric(spark, sf):
    return of_records(spark, sf, feeds.pick_cvss_metric(F.col("cve.metrics")).alias("m")).select("id", "m.cvss_basescore", "m.cvss_baseseverity", "m.cvss_version")


@query(f"SELECT {_ID}, len(list_distinct(['CWE-' || p_partkey % 50, 'CWE-79'])) AS n, list_sort(list_distinct(['CWE-' || p_partkey % 50, 'CWE-79']))[1] AS first_cwe FROM part", False)
def extract_cwe_ids(spark, sf):
    return of_records(spark, sf, feeds.extract_cwe_ids(F.col("cve.weaknesses")).alias("l")).select("id", F.size("l").cast("long").alias("n"), F.col("l")[0].alias("first_cwe"))


@query(f"SELECT {_ID}, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS vendors, 'tool' || p_partkey % 9 AS products FROM part", False)
def extract_cpe_vendor_product(spark, sf):
    return of_records(spark, sf, feeds.extract_cpe_vendor_product(F.col("cve.configurations")).alias("c")).select("id", "c.vendors", "c.products")


@query(f"""SELECT {_ID}, 'https://a/' || p_partkey || ' | https://b/' || p_partkey AS "references" FROM part""", False)
def join_references(spark, sf):
    return of_records(spark, sf, feeds.join_references(F.col("cve.references")).alias("references"))


def pages(spark, sf, name, item, page):
    """One file for 500 parts, with the items of its page."""
    place = tables.scratch(spark, name)
    listed = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 500).alias("page"), item.alias("i")).groupBy("page").agg(F.sort_array(F.collect_list("i")).alias("i"))
    listed.select("page", page(F.col("i")).alias("value")).write.partitionBy("page").text(place)
    return place


@query("SELECT 'CVE-2020-' || (10000 + p_partkey) AS id, p_name AS description_en FROM part", False)
def read_nvd_feed(spark, sf):
    text_of = F.struct(F.lit("en").alias("lang"), F.col("p_name").alias("value"))
    record = F.struct(F.struct(F.concat(F.lit("CVE-2020-"), 10000 + F.col("p_partkey")).alias("id"), F.array(text_of).alias("descriptions")).alias("cve"))
    place = pages(spark, sf, "nvd", record, lambda i: F.to_json(F.struct(i.alias("vulnerabilities"))))
    return feeds.tidy_nvd(feeds.read_nvd_feed(spark, place)).select("id", "description_en")


@query("SELECT 'JVNDB-' || p_partkey AS jvndb_id, 'CVE-2020-' || (10000 + p_partkey) || ', CVE-2021-' || (10000 + p_partkey) AS cve_ids, 'v' || p_partkey % 9 || ':p' AS affected_products, p_size / 5.0 AS cvss_score, 2021 AS year FROM part", False)
def read_jvn_feed(spark, sf):
    k = F.col("p_partkey")
    refs = F.concat(*[F.concat(F.lit(f'<sec:references source="CVE" id="CVE-{y}-'), 10000 + k, F.lit('"/>')) for y in (2020, 2021)])
    item = F.concat(F.lit("<item><title>t</title><dc:date>2021-03-01T00:00+00:00</dc:date><sec:identifier>JVNDB-"), k, F.lit("</sec:identifier>"), refs, F.lit('<sec:references source="X" id="Y"/><sec:cvss severity="High" score="'), F.col("p_size") / 5.0, F.lit('"/><sec:cpe vendor="v'), k % 9, F.lit('" product="p"/></item>'))
    place = pages(spark, sf, "jvn", item, lambda i: F.concat(F.lit('<rdf xmlns:dc="d" xmlns:sec="s">'), F.array_join(i, ""), F.lit("</rdf>")))
    return feeds.read_jvn_feed(spark, place).select("jvndb_id", "cve_ids", "affected_products", "cvss_score", "year")


@query("SELECT 'E' || p_partkey AS id, p_retailprice AS \"baseScore\", 'CVE-2020-' || (10000 + p_partkey) AS aliases, '2025-12-12 13:02:03' AS \"datePublished\" FROM part", False)
def read_euvd_feed(spark, sf):
    item = F.struct(F.concat(F.lit("E"), F.col("p_partkey")).alias("id"), F.col("p_retailprice").alias("baseScore"), F.concat(F.lit("CVE-2020-"), 10000 + F.col("p_partkey")).alias("aliases"), F.lit("Dec 12, 2025, 1:02:03 PM").alias("datePublished"))
    place = pages(spark, sf, "euvd", item, lambda i: F.when(F.col("page") % 2 == 0, F.to_json(F.struct(i.alias("items")))).otherwise(F.to_json(F.struct(i.alias("content")))))
    return feeds.read_euvd_feed(spark, place).select("id", "baseScore", "aliases", day("datePublished").alias("datePublished"))


@query("SELECT 'CVE-2020-' || (10000 + p_partkey) AS cve_id, p_brand AS \"vendorProject\", '2021-05-' || lpad(CAST(1 + p_partkey % 28 AS VARCHAR), 2, '0') || ' 00:00:00' AS dateadded, true AS kev_listed FROM part", False)
def read_kev_feed(spark, sf):
    place, k = tables.scratch(spark, "kev"), F.col("p_partkey")
    day_text = F.concat(F.lit("2021-05-"), F.lpad((1 + k % 28).cast("string"), 2, "0"))
    rows = table(spark, sf, "part").select(F.concat(F.lit("CVE-2020-"), 10000 + k).alias("cveID"), F.col("p_brand").alias("vendorProject"), F.col("p_name").alias("product"), F.lit("n").alias("vulnerabilityName"), day_text.alias("dateAdded"), F.lit("d").alias("shortDescription"), F.lit("a").alias("requiredAction"), F.lit("2021-07-01").alias("dueDate"), F.lit("Known").alias("knownRansomwareCampaignUse"))
    rows.write.option("header", True).csv(place)
    return feeds.read_kev_feed(spark, place).select("cve_id", "vendorProject", day("dateadded").alias("dateadded"), "kev_listed")


@query("SELECT cve_id, sources, source_count, base_score FROM master")
def write_master(spark, sf):
    place = tables.scratch(spark, "master")
    tables.write_master(master(spark, sf), place)
    return tables.read_master(spark, place).select("cve_id", "sources", "source_count", "base_score")


_NEWEST = "SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {0}) AS rn FROM events) WHERE rn = 1"


@query(_NEWEST.format("ts DESC, event_id % 2 DESC, event_id DESC"), False)
def publish_table(spark, sf):
    place = tables.scratch(spark, "published")
    old, new = halves(spark, sf)
    tables.publish_table(upsert.upsert_latest(old.filter("false"), old, "user_id", "ts", "event_id"), place, "replace")
    tables.publish_table(upsert.upsert_latest(new.filter("false"), new, "user_id", "ts", "event_id"), place, "upsert", "user_id", "ts")
    return tables.read_master(spark, place).select(*_EVENT)


def landed(spark, sf, place):
    """Events as files by time, two of them in a batch."""
    events = table(spark, sf, "events")
    events.repartitionByRange(4, "ts").write.parquet(place)
    return jobs.feed_stream(spark, place, events.schema, files_per_batch=2)


@query(_NEWEST.format("ts DESC, event_id DESC"), False)
def stream_upsert(spark, sf):
    place = tables.scratch(spark, "stream")
    feed = landed(spark, sf, f"{place}/in")
    jobs.stream_upsert(feed, f"{place}/master", "user_id", "ts", f"{place}/mark", "event_id").awaitTermination()
    return tables.read_master(spark, f"{place}/master").select(*_EVENT)


@query("SELECT event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS high_water FROM events GROUP BY event_type", False)
def stream_high_water(spark, sf):
    place = tables.scratch(spark, "water")
    water = jobs.stream_high_water(landed(spark, sf, f"{place}/in"), "event_type", ["ts"])
    keep = lambda batch, _: batch.write.mode("append").parquet(f"{place}/out")
    water.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{place}/mark").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{place}/out").groupBy("event_type").agg(F.max("high_water").alias("h"))
    return found.select("event_type", day("h").alias("high_water"))


# ---------------------------------------------------------------- dedupe, sets, increments

_EVENT = ("event_id", "user_id", "event_type", "value")


def halves(spark, sf):
    e = table(spark, sf, "events")
    return e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1")


@query(_NEWEST.format("ts DESC, event_id % 2 DESC, event_id DESC"), False)
def upsert_latest(spark, sf):
    old, new = halves(spark, sf)
    return upsert.upsert_latest(old, new, "user_id", "ts", "event_id").select(*_EVENT)


@query(_NEWEST.format("(CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END) DESC NULLS FIRST, event_id DESC"), False)
def latest_by_date(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.when(F.col("event_id") % 11 != 0, F.col("ts")))
    return upsert.latest_by_date(e, "user_id", "ts", "event_id").select(*_EVENT)


@query(_NEWEST.format("event_id % 2 DESC, event_id DESC"), False)
def keep_last_arrival(spark, sf):
    old, new = halves(spark, sf)
    return upsert.keep_last_arrival(old, new, "user_id", "event_id").select(*_EVENT)


@query(_NEWEST.format("event_id"), False)
def keep_first(spark, sf):
    return upsert.keep_first(table(spark, sf, "events"), "user_id", "event_id").select(*_EVENT)


@query("SELECT DISTINCT user_id, event_type FROM events", False)
def distinct_rows(spark, sf):
    old, new = halves(spark, sf)
    return upsert.distinct_rows(old.select("user_id", "event_type"), new.select("user_id", "event_type"))


@query("SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'", False)
def incremental_slice(spark, sf):
    return upsert.incremental_slice(table(spark, sf, "events"), "2024-01-05", "2024-01-20", "ts").select("event_id")


@query("SELECT strftime(coalesce(max(greatest(l_shipdate, o_orderdate)), TIMESTAMP '2030-01-01'), '%Y-%m-%d %H:%M:%S') AS high_water FROM lineitem JOIN orders ON l_orderkey = o_orderkey", False)
def high_water(spark, sf):
    both = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return upsert.high_water(both, ["l_shipdate", "o_orderdate"], "2030-01-01").select(day("high_water").alias("high_water"))


@query("""WITH b AS (SELECT min(o_orderdate) AS s, max(o_orderdate) AS e FROM orders), m AS (SELECT unnest(generate_series(date_trunc('month', s), e, INTERVAL 1 MONTH)) AS m, s, e FROM b)
SELECT strftime(greatest(m, s), '%Y-%m-%d %H:%M:%S') AS window_start, strftime(least(m + INTERVAL 1 MONTH - INTERVAL 1 SECOND, e), '%Y-%m-%d %H:%M:%S') AS window_end FROM m""", False)
def calendar_windows(spark, sf):
    bounds = table(spark, sf, "orders").agg(F.min("o_orderdate").alias("start"), F.max("o_orderdate").alias("end"))
    return upsert.calendar_windows(bounds).select(day("window_start").alias("window_start"), day("window_end").alias("window_end"))


# ---------------------------------------------------------------- merge and joins

_AT = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"


@query(f"""SELECT cve_id, cve_year, nvd_present, jvn_present, eu_present, kev_present, {', '.join(_AT.format(s + '_published') for s in ('nvd', 'jvn', 'eu', 'kev'))},
  nvd_base_score, jvn_base_score, eu_base_score, sources, source_count, {_AT.format('published')}, base_score FROM master""")
def merge_sources(spark, sf):
    m = master(spark, sf).drop("source_list")
    return m.withColumns({c: day(c) for c in m.columns if c.endswith("published")})


@query("SELECT cve_id, sources, source_count, CASE WHEN nvd_present THEN 'NVD' WHEN jvn_present THEN 'JVN' WHEN eu_present THEN 'EUVD' ELSE 'KEV' END AS first_source FROM master")
def source_presence(spark, sf):
    return master(spark, sf).select("cve_id", "sources", "source_count", F.col("source_list")[0].alias("first_source"))


@query("SELECT cve_id, strftime(coalesce(jvn_published, eu_published, nvd_published), '%Y-%m-%d %H:%M:%S') AS published FROM master")
def coalesce_published(spark, sf):
    return master(spark, sf).withColumn("p", merge.coalesce_published([F.col(f"{s}_published") for s in ("jvn", "eu", "nvd")])).select("cve_id", day("p").alias("published"))


@query("SELECT cve_id, coalesce(nvd_base_score, jvn_base_score, eu_base_score) AS base_score FROM master")
def coalesce_score(spark, sf):
    return master(spark, sf).select("cve_id", merge.coalesce_score([F.col(f"{s}_base_score") for s in ("nvd", "jvn", "eu")]).alias("base_score"))


@query("SELECT cve_id, n AS cwe_count, round(a, 6) AS cwe_rate FROM described LEFT JOIN (SELECT cwe AS c, count(*) AS n, avg(kev_present::INT) AS a FROM described WHERE cwe IS NOT NULL GROUP BY cwe) ON cwe = c")
def group_stat_join(spark, sf):
    d = merge.group_stat_join(described(spark, sf), "cwe", {"cwe_count": F.count("*"), "rate": F.avg(F.col("kev_present").cast("int"))})
    return d.select("cve_id", "cwe_count", r6(F.col("rate"), "cwe_rate"))


@query("""SELECT m.cve_id, p_size / 50.0 AS hazard_score, CASE WHEN p_size IS NULL THEN 'No Prediction' WHEN p_size % 2 = 0 THEN 'Never' ELSE CAST(p_size AS VARCHAR) END AS predicted_display,
  CASE WHEN p_size % 2 <> 0 THEN CAST(p_size AS DOUBLE) END AS predicted_day_num FROM master m LEFT JOIN (SELECT cve_id, p_size FROM meta WHERE p_size < 30) h ON m.cve_id = h.cve_id""")
def attach_hazard(spark, sf):
    h = views.parts(spark, sf).filter("p_size < 30").select("cve_id", (F.col("p_size") / 50.0).alias("risk_score"), F.when(F.col("p_size") % 2 != 0, F.col("p_size")).alias("predicted_day"))
    return merge.attach_hazard(master(spark, sf).select("cve_id"), h)


@query("SELECT cve_id, nvd_text AS description, vendor FROM described")
def attach_metadata(spark, sf):
    return merge.attach_metadata(master(spark, sf).select("cve_id"), views.metadata(spark, sf), ["nvd_text", "jvn_text"], ["vendor"])


# ---------------------------------------------------------------- features

_DAYS = "(epoch_us({0}) - epoch_us({1})) / 86400000000.0"
_LIST = "[x for x in [epoch_us(nvd_published), epoch_us(jvn_published), epoch_us(eu_published)] if x is not null]"


@query(f"SELECT cve_id, round({_DAYS.format('kev_published', 'published')}, 6) AS days_to_kev FROM master")
def day_lag(spark, sf):
    return master(spark, sf).select("cve_id", r6(fx.day_lag(F.col("kev_published"), F.col("published")), "days_to_kev"))


@query("SELECT cve_id, round((epoch_us(greatest(nvd_published, jvn_published, eu_published)) - epoch_us(least(nvd_published, jvn_published, eu_published))) / 86400000000.0, 6) AS lag FROM master")
def publication_lag(spark, sf):
    return master(spark, sf).select("cve_id", r6(fx.publication_lag(views.dates()), "lag"))


@query("SELECT cve_id, nvd_present::INT + jvn_present::INT + eu_present::INT AS n FROM master")
def cross_listing_count(spark, sf):
    return master(spark, sf).select("cve_id", fx.cross_listing_count([F.col(f"{s}_present") for s in ("nvd", "jvn", "eu")]).alias("n"))


@query("""SELECT cve_id, round(var_pop(d), 4) AS population, round(var_samp(d), 4) AS sample FROM (
  SELECT cve_id, unnest([epoch_us(nvd_published), epoch_us(jvn_published), epoch_us(eu_published)]) / 86400000000.0 AS d FROM master) GROUP BY cve_id""")
def cross_listing_spread(spark, sf):
    return master(spark, sf).select("cve_id", F.round(fx.spread_days(views.dates(), 0), 4).alias("population"), F.round(fx.spread_days(views.dates(), 1), 4).alias("sample"))


@query("SELECT cve_id, nvd_present::INT AS nvd, kev_present::INT AS kev FROM master")
def coverage_vector(spark, sf):
    v = fx.coverage_vector({s: F.col(f"{s}_present") for s in ("nvd", "jvn", "eu", "kev")})
    return master(spark, sf).select("cve_id", v["nvd"].alias("nvd"), v["kev"].alias("kev"))


_SEVERITY = "CASE WHEN base_score <= 3.9 THEN 'LOW' WHEN base_score <= 6.9 THEN 'MEDIUM' WHEN base_score <= 8.9 THEN 'HIGH' WHEN base_score IS NOT NULL THEN 'CRITICAL' END"


@query(f"SELECT cve_id, {_SEVERITY} AS severity FROM master")
def severity_label(spark, sf):
    return master(spark, sf).select("cve_id", fx.severity_label(score=F.col("base_score")).alias("severity"))


@query("SELECT cve_id, kev_present OR kev_published IS NOT NULL AS is_kev FROM master")
def kev_flag(spark, sf):
    return master(spark, sf).select("cve_id", fx.kev_flag([(F.col("kev_present").cast("string"), "string"), (F.col("kev_published"), "timestamp")]).alias("is_kev"))


@query("""SELECT doc_id, coalesce(length(text), 0) AS desc_len, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS word_count,
  CASE WHEN lower(text) LIKE '%license%' OR lower(text) LIKE '%version%' THEN 1 ELSE 0 END AS has_keyword FROM documents""", False)
def text_stats(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", *[c.alias(n) for n, c in fx.text_stats(F.col("text"), ("license", "version")).items()])


@query("SELECT page_id, len(regexp_extract_all(coalesce(html, ''), 'href=')) AS refs FROM pages", False)
def reference_count(spark, sf):
    return table(spark, sf, "pages").select("page_id", fx.reference_count(F.col("html"), pattern="href=").alias("refs"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'CWE-' || p_partkey % 50 END AS cwe_category, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 2 END AS n FROM part", False)
def cwe_category(spark, sf):
    k = F.col("p_partkey")
    listed = F.when(k % 3 != 0, F.concat(F.lit("CWE-"), k % 50, F.lit(" | CWE-"), k)).alias("cwes")
    return table(spark, sf, "part").select("p_partkey", listed).select("p_partkey", fx.cwe_category(F.col("cwes")).alias("cwe_category"), fx.cwe_count(F.col("cwes")).alias("n"))


_LETTERS = ", ".join(f"regexp_extract(cvss_vector, '/{m}:([A-Z])', 1) AS cvss_{m.lower()}" for m in fx.ORDINALS)


@query(f"SELECT cve_id, {_LETTERS}, 1 AS cvss_v3_present FROM described")
def parse_cvss_vector(spark, sf):
    return described(spark, sf).select("cve_id", *[c.alias(n) for n, c in fx.parse_cvss_vector(F.col("cvss_vector")).items()])


_ORDINALS = ", ".join(f"CASE regexp_extract(cvss_vector, '/{m}:([A-Z])', 1) " + " ".join(f"WHEN '{a}' THEN {v}" for a, v in o.items()) + f" END AS cvss_{m.lower()}_ord" for m, o in fx.ORDINALS.items())


@query(f"SELECT cve_id, {_ORDINALS} FROM described")
def cvss_ordinals(spark, sf):
    return described(spark, sf).select("cve_id", *[c.alias(n) for n, c in fx.cvss_ordinals(F.col("cvss_vector")).items()])


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice / 10000 END AS epss_score, CASE WHEN p_partkey % 5 <> 0 THEN p_size / 50.0 END AS epss_percentile,
  CASE WHEN p_partkey % 4 <> 0 AND p_retailprice IS NOT NULL THEN 1 ELSE 0 END AS epss_present FROM part""", False)
def epss_features(spark, sf):
    k = F.col("p_partkey")
    score = F.when(k % 4 == 0, "n/a").otherwise((F.col("p_retailprice") / 10000).cast("string"))
    percentile = F.when(k % 5 != 0, F.col("p_size") / 50.0)
    return table(spark, sf, "part").select("p_partkey", *[c.alias(n) for n, c in fx.epss_features(score, percentile).items()])


@query("""SELECT p_partkey, p_partkey % 3 AS github_poc_count, p_partkey % 3 + p_partkey % 2 AS poc_url_count, p_partkey % 2 AS exploitdb_present, 0 AS metasploit_present,
  CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE 1 END AS poc_any_present, CAST(p_size AS DOUBLE) AS first_poc_lag_days, CASE WHEN p_size <= 30 THEN 1 ELSE 0 END AS poc_within_30d FROM part""", False)
def poc_features(spark, sf):
    k = F.col("p_partkey")
    refs = F.concat(F.repeat(F.lit("https://GitHub.com/a/b | "), (k % 3).cast("int")), F.repeat(F.lit("https://www.exploit-db.com/1 "), (k % 2).cast("int")))
    start = F.lit("2020-01-01").cast("timestamp")
    made = fx.poc_features(refs, start, F.timestamp_add("DAY", F.col("p_size"), start))
    return table(spark, sf, "part").select("p_partkey", *[c.alias(n) for n, c in made.items()])


@query("SELECT cve_id, CAST(kev_present AS INT) AS is_kev, base_score, CAST(coalesce(nvd_present::INT + jvn_present::INT + eu_present::INT, 0) AS DOUBLE) AS cross_listing_count FROM master")
def model_projection(spark, sf):
    f = feature_rows(spark, sf)
    return splits.model_projection(f, "cve_id", ["base_score", "cross_listing_count", "kev_present", "price", "vendor"], ["cross_listing_count"], ["price"], label="is_kev")


@query()
def tfidf_top_terms(spark, sf):
    return text.tfidf_top_terms(table(spark, sf, "documents"), "doc_id", "text", 100)


# ---------------------------------------------------------------- reports


@query("SELECT cwe, count(*) AS frequency FROM described WHERE cwe IS NOT NULL GROUP BY cwe")
def weakness_frequency(spark, sf):
    return reports.category_frequency(described(spark, sf), "cwe")


@query("SELECT vendor, count(*) AS frequency FROM described WHERE vendor IS NOT NULL GROUP BY vendor")
def vendor_frequency(spark, sf):
    return reports.category_frequency(described(spark, sf), "vendor")


@query("SELECT vendor, round(avg(kev_present::INT), 6) AS risk_factor FROM described WHERE vendor IS NOT NULL GROUP BY vendor")
def risk_factor(spark, sf):
    return reports.risk_factor(described(spark, sf), "vendor", "kev_present").withColumn("risk_factor", F.round("risk_factor", 6))


_OVERLAP = """SELECT * FROM (SELECT nvd_present, jvn_present, eu_present, kev_present, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent
  FROM master WHERE cve_year >= {0} AND source_count >= {1} GROUP BY ALL) WHERE n >= {2}"""


@query(_OVERLAP.format(2002, 1, 1))
def source_overlap(spark, sf):
    return reports.source_overlap(master(spark, sf), 2002)


@query(_OVERLAP.format(2010, 2, 50))
def source_overlap_cross_listed(spark, sf):
    return reports.source_overlap(master(spark, sf), 2010, 2, 50)


@query("SELECT count(*) FILTER (nvd_present) AS nvd_total, count(*) FILTER (jvn_present) AS jvn_total, count(*) FILTER (eu_present) AS eu_total, count(*) FILTER (kev_present) AS kev_total, count(*) AS all_total FROM master WHERE cve_year >= 2021")
def source_totals(spark, sf):
    return reports.source_totals(master(spark, sf))


@query("""SELECT *, round(100.0 * known / n, 6) AS known_percent, round(100.0 * later / n, 6) AS later_percent, round(100.0 * negative / n, 6) AS negative_percent FROM (
  SELECT count(*) AS n, count(*) FILTER (kev_published <= TIMESTAMP '1997-01-01') AS known, count(*) FILTER (kev_published > TIMESTAMP '1997-01-01') AS later,
  count(*) FILTER (kev_published IS NULL) AS negative FROM master WHERE published <= TIMESTAMP '1997-01-01')""")
def unlabeled_positive_cohort(spark, sf):
    return reports.unlabeled_positive_cohort(master(spark, sf), "1997-01-01")


def scored(spark, sf):
    d = described(spark, sf)
    risk = F.when(F.col("p_partkey") % 3 != 0, F.col("base_score") * F.col("source_count"))
    predicted = F.when(F.col("p_partkey") % 4 != 0, F.col("p_partkey") % 97)
    return d.withColumns({"is_kev": F.when(F.col("p_partkey") % 5 != 0, F.col("kev_present").cast("int").cast("string")), "risk_score": risk, "predicted_day_num": predicted, "severity": fx.severity_label(score=F.col("base_score"))})


_SCORED = f"""SELECT *, CASE WHEN p_partkey % 5 <> 0 AND kev_present THEN 1 ELSE 0 END AS is_kev, coalesce(CASE WHEN p_partkey % 3 <> 0 THEN base_score * source_count END, base_score) AS risk_score,
  CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 97 END AS predicted_day_num, {_SEVERITY} AS severity FROM described"""


@query(f"SELECT cve_id, is_kev, risk_score FROM ({_SCORED}) WHERE cve_year BETWEEN 2005 AND 2020 AND severity IN ('HIGH', 'CRITICAL') AND is_kev = 0 AND predicted_day_num IS NOT NULL")
def report_filter(spark, sf):
    return reports.report_filter(scored(spark, sf), (2005, 2020), ["HIGH", "CRITICAL"], "other", "predicted").select("cve_id", "is_kev", "risk_score")


@query("SELECT source_count >= 2 AS cross_listed, count(DISTINCT cve_id) AS cves FROM master GROUP BY 1")
def cross_listed_summary(spark, sf):
    return reports.cross_listed_summary(master(spark, sf))


@query("""SELECT CAST(CASE WHEN lag >= high OR high = low THEN 40 ELSE floor((lag - low) * 40 / (high - low)) + 1 END AS INT) AS bin, count(*) AS n FROM (
  SELECT *, min(lag) OVER () AS low, max(lag) OVER () AS high FROM (SELECT (epoch_us(kev_published) - epoch_us(nvd_published)) / 86400000000.0 AS lag FROM master WHERE source_count >= 2) WHERE lag BETWEEN 0 AND 3650) GROUP BY 1""")
def lag_histogram(spark, sf):
    return reports.lag_histogram(master(spark, sf), "kev_published", "nvd_published")


@query(f"SELECT cve_id, nvd_base_score AS x_score, eu_base_score AS y_score, {_SEVERITY} AS severity FROM master WHERE nvd_base_score IS NOT NULL AND eu_base_score IS NOT NULL")
def score_pairs(spark, sf):
    return reports.score_pairs(master(spark, sf), "nvd_base_score", "eu_base_score", fx.severity_label(score=F.col("base_score")))


@query(f"""SELECT severity, count(*) AS n, min(lead) AS least, quantile_cont(lead, 0.25) AS q1, quantile_cont(lead, 0.5) AS median, quantile_cont(lead, 0.75) AS q3, max(lead) AS most FROM (
  SELECT {_SEVERITY} AS severity, {_DAYS.format('kev_published', 'published')} AS lead FROM master WHERE kev_present AND base_score >= 7) WHERE lead IS NOT NULL GROUP BY severity""")
def lead_time_quartiles(spark, sf):
    return reports.lead_time_quartiles(master(spark, sf), fx.day_lag(F.col("kev_published"), F.col("published")), fx.severity_label(score=F.col("base_score")))


_VECTOR = "CASE regexp_extract(cvss_vector, '/AV:([A-Z])', 1) WHEN 'N' THEN 'Network' WHEN 'A' THEN 'Adjacent' WHEN 'L' THEN 'Local' WHEN 'P' THEN 'Physical' ELSE 'Unknown' END"


@query(f"SELECT {_VECTOR} AS attack_vector, count(*) AS n FROM described GROUP BY 1")
def attack_vector_counts(spark, sf):
    return reports.attack_vector_counts(described(spark, sf).withColumn("av", fx.vector_metric(F.col("cvss_vector"), "AV")), "av")


@query(f"SELECT attack_vector, count(*) AS total, CAST(sum(kev_present::INT) AS BIGINT) AS exploited, round(sum(kev_present::INT) / count(*), 6) AS rate FROM (SELECT *, {_VECTOR} AS attack_vector FROM described) GROUP BY 1")
def kev_rate_by(spark, sf):
    d = described(spark, sf).withColumn("attack_vector", reports.attack_vector(fx.vector_metric(F.col("cvss_vector"), "AV")))
    return reports.kev_rate_by(d, "attack_vector", "kev_present")


@query("""SELECT * FROM (SELECT cvss_vector, count(*) AS total, CAST(sum(kev_present::INT) AS BIGINT) AS exploited, round(sum(kev_present::INT) / count(*), 6) AS rate FROM described GROUP BY 1 HAVING count(*) >= 3)
  ORDER BY rate DESC, total DESC, cvss_vector LIMIT 40""")
def kev_rate_by_vector(spark, sf):
    return reports.kev_rate_by(described(spark, sf), "cvss_vector", "kev_present", 3, 40)


@query("""SELECT cve_id, risk, low, high, (risk > q[1])::INT + (risk > q[2])::INT + (risk > q[3])::INT AS band, risk > q[3] AS high_risk FROM (
  SELECT cve_id, base_score AS risk FROM master WHERE NOT kev_present AND base_score IS NOT NULL), (SELECT min(base_score) AS low, max(base_score) AS high, quantile_cont(base_score, [0.5, 0.75, 0.9]) AS q FROM master WHERE NOT kev_present)""")
def hazard_quantile_bands(spark, sf):
    rows = master(spark, sf).filter("not kev_present and base_score is not null").select("cve_id", F.col("base_score").alias("risk"))
    return reports.hazard_quantile_bands(rows, "risk")


@query("SELECT cve_id, base_score FROM master WHERE cve_id LIKE '%-2012-%' AND base_score IS NOT NULL ORDER BY base_score DESC, cve_id LIMIT 20")
def top_risk(spark, sf):
    return reports.top_risk(master(spark, sf), "base_score", "-2012-").select("cve_id", "base_score")


# ---------------------------------------------------------------- order, bins, splits


@query("SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rank FROM lineitem", False)
def average_rank(spark, sf):
    return ordering.average_rank(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity").drop("l_quantity")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity BETWEEN 1 AND 10 THEN 1 WHEN l_quantity > 10 AND l_quantity <= 30 THEN 2 WHEN l_quantity > 30 AND l_quantity <= 45 THEN 3 END AS bin FROM lineitem", False)
def fixed_bins(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", splits.fixed_bins(F.col("l_quantity"), [1, 10, 30, 45], [1, 2, 3]).alias("bin"))


@query("""SELECT p_partkey, CASE WHEN p_retailprice <= q[1] THEN 'low' WHEN p_retailprice <= q[2] THEN 'medium' WHEN p_retailprice <= q[3] THEN 'high' ELSE 'critical' END AS price_bin
  FROM part, (SELECT quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) AS q FROM part)""", False)
def quantile_bins(spark, sf):
    return splits.quantile_bins(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", ["low", "medium", "high", "critical"], "price_bin").drop("p_retailprice")


@query("SELECT cve_id, CASE WHEN cve_year <= 2018 THEN 'train' ELSE 'test' END AS split FROM master WHERE cve_year >= 2005")
def temporal_split(spark, sf):
    return splits.temporal_split(master(spark, sf), "cve_year", "cve_id", 2005, 2018).select("cve_id", "split")


@query(f"""SELECT cve_id, event, round(t, 6) AS time_to_event FROM (SELECT cve_id, kev_present::INT AS event,
  (epoch_us(CASE WHEN kev_present THEN kev_published ELSE TIMESTAMP '{AS_OF}' END) - epoch_us(published)) / 86400000000.0 AS t, base_score FROM master) WHERE t > 0 AND base_score IS NOT NULL""")
def survival_frame(spark, sf):
    f = survival.survival_frame(master(spark, sf), AS_OF, ["base_score"])
    return f.select("cve_id", "event", r6(F.col("time_to_event"), "time_to_event"))


# ---------------------------------------------------------------- learners


def split_features(spark, sf):
    rows = tables.checkpointed(feature_rows(spark, sf).select("cve_id", "cve_year", "is_kev", *FEATURES))  # the split looks at them first
    s = splits.temporal_split(rows, "cve_year", "cve_id", 2002, 2018)
    return s.filter("split = 'train'"), s.filter("split = 'test'")


@query("""SELECT cve_id, round((coalesce(base_score, m) - a) / d, 6) AS z_base_score FROM (SELECT * FROM master WHERE cve_year > 2018), (
  SELECT m, avg(coalesce(base_score, m)) AS a, stddev_pop(coalesce(base_score, m)) AS d FROM master, (SELECT median(base_score) AS m FROM master WHERE cve_year <= 2018) WHERE cve_year <= 2018 GROUP BY m)""")
def impute_and_scale(spark, sf):
    train, test = split_features(spark, sf)
    return splits.impute_and_scale(train, test, ["base_score"])[1].select("cve_id", r6(F.col("z_base_score"), "z_base_score"))


@query("SELECT cve_id, coalesce(base_score, m) AS risk_score FROM master, (SELECT median(base_score) AS m FROM master WHERE cve_year <= 2018) WHERE cve_year > 2018")
def baseline_score(spark, sf):
    train, test = split_features(spark, sf)
    return learners.baseline_score(train, test, "base_score", "cve_id")


@query()
def train_logistic(spark, sf):
    return learners.train_logistic(*split_features(spark, sf), FEATURES, "cve_id", "is_kev")[0]


@query()
def train_forest(spark, sf):
    return learners.train_forest(*split_features(spark, sf), FEATURES, "cve_id", "is_kev")[0]


@query()
def train_boosted(spark, sf):
    return learners.train_boosted(*split_features(spark, sf), FEATURES, "cve_id", "is_kev", "cve_year", learners.GRID)[0]


@query()
def train_pu_bagging(spark, sf):
    train, test = split_features(spark, sf)
    a, b, used = splits.impute_and_scale(train, test, FEATURES)
    return pu.train_pu_bagging(a, b, [f"z_{c}" for c in used], "cve_id", "is_kev")


@query()
def density_risk(spark, sf):
    train, test = split_features(spark, sf)
    a, b, used = splits.impute_and_scale(train, test, FEATURES)
    return density.density_risk(a, b, [f"z_{c}" for c in used], "cve_id", "is_kev")


@query("""SELECT cve_id, round(coalesce(-((base_score - a1) ^ 2) / (2 * v1) - 0.5 * ln(2 * pi() * v1) + ((base_score - a0) ^ 2) / (2 * v0) + 0.5 * ln(2 * pi() * v0), 0), 6) AS llr FROM master, (
  SELECT avg(base_score) FILTER (kev_present) AS a1, var_pop(base_score) FILTER (kev_present) AS v1, avg(base_score) FILTER (NOT kev_present) AS a0, var_pop(base_score) FILTER (NOT kev_present) AS v0 FROM master)""")
def nb_llr(spark, sf):
    rows = master(spark, sf).withColumn("is_kev", F.col("kev_present").cast("int"))
    return learners.nb_llr(rows, ["base_score"], "is_kev", "cve_id").select("cve_id", r6(F.col("llr"), "llr"))


def survival_rows(spark, sf):
    f = feature_rows(spark, sf).drop("is_kev")
    ready = survival.survival_frame(f, AS_OF, ["base_score", "repo_publication_lag", "cross_listing_variance"], variance="cross_listing_variance")
    ranked = ordering.average_rank(ready, "repo_publication_lag", "repo_publication_lag_rank")
    binned = splits.quantile_bins(ranked, "price", ["low", "medium", "high", "critical"], "cwe_risk_category")
    count = splits.fixed_bins(F.col("cross_listing_count").cast("double"), [0.0, 1.0, 2.0, float("inf")], [1, 2, 3])
    return tables.checkpointed(binned.withColumn("cross_listing_count_cat", count).withColumn("stratum", F.concat_ws("/", count.cast("string"), "cwe_risk_category")))


COX = ["base_score", "repo_publication_lag_rank", "cross_listing_variance_sqrt"]


@query()
def weibull_aft(spark, sf):
    rows = survival_rows(spark, sf)
    weights, names = text.tfidf_columns(rows, "cve_id", "nvd_text")
    return learners.weibull_aft(rows.join(weights, "cve_id", "left"), ["base_score", "repo_publication_lag_rank"], "time_to_event", "event", "cve_id", names)


@query()
def cox_fit(spark, sf):
    m = survival.cox_fit(survival_rows(spark, sf), COX, "stratum")
    return spark.createDataFrame(list(zip(m.covariates, m.beta)), "covariate string, beta double")


@query()
def cox_partial_hazard(spark, sf):
    rows = survival_rows(spark, sf)
    return survival.cox_partial_hazard(rows, survival.cox_fit(rows, COX, "stratum")).select("cve_id", "risk_score")


@query()
def predicted_day(spark, sf):
    rows = survival_rows(spark, sf)
    return survival.predicted_day(rows, survival.cox_fit(rows, COX, "stratum"), "stratum", "cve_id")


@query()
def hazard_scope(spark, sf):
    rows = survival_rows(spark, sf)
    scored_rows = survival.cox_partial_hazard(rows, survival.cox_fit(rows, COX, "stratum")).drop("stratum")
    return survival.hazard_scope(scored_rows, "cross_listing_count_cat", "cwe_risk_category").select("cve_id", "stratum", "risk_score")


@query("""SELECT cve_id, round(10 / (1 + exp(-(0.6 * (base_score - a) / (d + 1e-12) + 0.4 * (source_count - b) / (e + 1e-12)))), 6) AS combined_risk FROM master, (
  SELECT avg(base_score) AS a, stddev_samp(base_score) AS d, avg(source_count) AS b, stddev_samp(source_count) AS e FROM master)""")
def combined_risk(spark, sf):
    return learners.combined_risk(master(spark, sf), ["base_score", "source_count"], [0.6, 0.4], "cve_id").withColumn("combined_risk", F.round("combined_risk", 6))


# ---------------------------------------------------------------- evaluation


def judged(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score")).join(labels, "doc_id")


_JUDGED = "WITH j AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS score, quality FROM documents JOIN labels USING (doc_id))"


@query(_JUDGED + """, g AS (SELECT score, sum((quality = 1)::INT) AS tp, sum((quality <> 1)::INT) AS fp FROM j GROUP BY score),
r AS (SELECT *, sum(tp) OVER (ORDER BY score DESC) AS rtp, sum(fp) OVER (ORDER BY score DESC) AS rfp FROM g)
SELECT round(sum(fp * (rtp - tp / 2.0)) / (sum(tp) * sum(fp)), 6) AS auroc, round(sum(tp * rtp / (rtp + rfp)) / sum(tp), 6) AS auprc, CAST(sum(tp) AS BIGINT) AS positives, CAST(sum(fp) AS BIGINT) AS negatives FROM r""", False)
def auroc_auprc(spark, sf):
    return ordering.auroc_auprc(judged(spark, sf), "quality", "score").withColumns({c: F.round(c, 6) for c in ("auroc", "auprc")})


_RANKED = _JUDGED + """, t AS (SELECT quality, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM j), n AS (SELECT count(*) AS n, sum(quality) AS p FROM j)
SELECT round(sum(quality) FILTER (k <= 50) / least(50, any_value(n)), 6) AS p_at_50, round(sum(quality) FILTER (k <= 50) / any_value(p), 6) AS r_at_50,
  round(sum(quality / log2(k + 1)) FILTER (k <= 50) / sum(1 / log2(k + 1)) FILTER (k <= least(50, p)), 6) AS ndcg_at_50,
  round(sum(quality) FILTER (k <= 1000) / least(1000, any_value(n)), 6) AS p_at_1000, round(sum(quality) FILTER (k <= 1000) / any_value(p), 6) AS r_at_1000,
  round(sum(quality / log2(k + 1)) FILTER (k <= 1000) / sum(1 / log2(k + 1)) FILTER (k <= least(1000, p)), 6) AS ndcg_at_1000 FROM t, n"""


@query(_RANKED, False)
def rank_metrics(spark, sf):
    m = ranking.rank_metrics(judged(spark, sf), "quality", "score", "doc_id", (50, 1000))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query(_JUDGED + " SELECT avg(CAST(quality AS DOUBLE)) AS precision_top_100 FROM (SELECT quality FROM j ORDER BY score DESC, doc_id LIMIT 100)", False)
def precision_top100(spark, sf):
    return ranking.precision_top(judged(spark, sf), "quality", "score", "doc_id")


RANKED = ("base_score", "cve_year", *ranking.ORDINALS, *ranking.CONTEXT, *ranking.EPSS, *ranking.POC)
REFERENCE_DAY = "2018-12-31"


def ranker_rows(spark, sf):
    """Train and test rows with all features that the rankers may use."""
    k = F.col("p_partkey")
    refs = F.concat(F.repeat(F.lit("https://github.com/a/b | "), (k % 3).cast("int")), F.repeat(F.lit("https://www.exploit-db.com/1 "), (k % 2).cast("int")))
    start = F.lit("2020-01-01").cast("timestamp")
    made = fx.epss_features(F.when(k % 4 != 0, F.col("p_retailprice") / 10000), F.when(k % 5 != 0, (k % 50) / 50.0)) | fx.poc_features(refs, start, F.timestamp_add("DAY", (k % 60).cast("int"), start))
    weaknesses = F.repeat(F.concat(F.lit("CWE-"), k % 50, F.lit(" ")), (k % 3).cast("int"))
    stats, spread = fx.text_stats(F.col("nvd_text")), fx.spread_days(views.dates(), 1)
    made |= {
        "cvss_v3_present": fx.parse_cvss_vector(F.col("cvss_vector"))["cvss_v3_present"], "desc_len": stats["desc_len"], "word_count": stats["word_count"], "update_frequency": fx.reference_count(refs),
        "time_since_first_reference": fx.day_lag(F.lit(REFERENCE_DAY), F.least(*views.dates())), "cross_listing_variance": spread, "cross_listing_std_days": F.sqrt(spread),
        "related_cwe_count": fx.cwe_count(weaknesses), "cwe_category": fx.cwe_category(weaknesses),
    }
    rows = merge.group_stat_join(feature_rows(spark, sf).withColumns(made), "cwe_category", {"weakness_frequency": F.count("*")})
    rows = rows.withColumn("weakness_frequency", F.coalesce("weakness_frequency", F.lit(0))).select("cve_id", "is_kev", *[F.col(c).cast("double").alias(c) for c in RANKED])
    s = tables.checkpointed(splits.temporal_split(tables.checkpointed(rows), "cve_year", "cve_id", 2002, 2018))
    return s.filter("split = 'train'"), s.filter("split = 'test'")


def by_likelihood(train, rows, columns):
    return learners.nb_llr(rows, columns, "is_kev", "cve_id", fit_on=train).select("cve_id", "is_kev", F.round("llr", 6).alias("risk_score"))


def by_base_score(train, rows, columns):
    return learners.baseline_score(train, rows, "base_score", "cve_id").join(rows.select("cve_id", "is_kev"), "cve_id")


_SCORED = f""", f AS (SELECT cve_id, kev_present::INT AS y, cve_year <= 2018 AS train, CAST(base_score AS DOUBLE) AS base_score, {_ORDINALS}, 1 AS cvss_v3_present,
  coalesce(nvd_present::INT + jvn_present::INT + eu_present::INT, 0) AS cross_listing_count, count(*) OVER (PARTITION BY vendor) AS vendor_frequency, length(nvd_text) AS desc_len,
  cve_year, len(regexp_extract_all(nvd_text, '[^ \\t\\n\\x0B\\f\\r]+')) AS word_count, p_partkey % 3 + p_partkey % 2 AS update_frequency, p_partkey % 3 AS related_cwe_count,
  CASE WHEN p_partkey % 3 <> 0 THEN count(*) OVER (PARTITION BY p_partkey % 3 <> 0, p_partkey % 50) ELSE 0 END AS weakness_frequency,
  (epoch_us(greatest(nvd_published, jvn_published, eu_published)) - epoch_us(least(nvd_published, jvn_published, eu_published))) / 86400000000.0 AS repo_publication_lag,
  (epoch_us(TIMESTAMP '{REFERENCE_DAY}') - epoch_us(least(nvd_published, jvn_published, eu_published))) / 86400000000.0 AS time_since_first_reference,
  list_aggregate(days, 'var_samp') AS cross_listing_variance, list_aggregate(days, 'stddev_samp') AS cross_listing_std_days,
  CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice / 10000 END AS epss_score, CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey % 50) / 50.0 END AS epss_percentile, (p_partkey % 4 <> 0)::INT AS epss_present,
  p_partkey % 3 AS github_poc_count, p_partkey % 2 AS exploitdb_present, 0 AS metasploit_present, p_partkey % 3 + p_partkey % 2 AS poc_url_count, (p_partkey % 6 <> 0)::INT AS poc_any_present,
  p_partkey % 60 AS first_poc_lag_days, (p_partkey % 60 <= 30)::INT AS poc_within_30d FROM (SELECT *, list_filter([epoch_us(nvd_published) / 86400000000.0, epoch_us(jvn_published) / 86400000000.0, epoch_us(eu_published) / 86400000000.0], lambda x: x IS NOT NULL) AS days FROM described)),
d AS (SELECT cve_id, y, train, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in RANKED)} FROM f),
l AS (UNPIVOT d ON {", ".join(RANKED)} INTO NAME feature VALUE v),
st AS (SELECT feature, y, avg(v) AS a, greatest(var_pop(v), 1e-9) AS w FROM l WHERE train GROUP BY feature, y),
parts AS (SELECT l.*, coalesce(-((v - p.a) ^ 2) / (2 * p.w) - 0.5 * ln(2 * pi() * p.w), 0) - coalesce(-((v - n.a) ^ 2) / (2 * n.w) - 0.5 * ln(2 * pi() * n.w), 0) AS part
  FROM l LEFT JOIN st p ON p.feature = l.feature AND p.y = 1 LEFT JOIN st n ON n.feature = l.feature AND n.y = 0),
configs AS (SELECT * FROM (VALUES {", ".join(f"('{name}', {[c for c in RANKED if c not in drop]})" for name, drop in ranking.ABLATIONS.items())}) AS t(ablation, used)),
nb AS (SELECT ablation, d.cve_id, d.y, d.train, round(coalesce(sum(part) FILTER (list_contains(used, feature)), 0), 6) AS s FROM d CROSS JOIN configs LEFT JOIN parts USING (cve_id) GROUP BY ablation, d.cve_id, d.y, d.train),
base AS (SELECT cve_id, y, train, coalesce(base_score, (SELECT median(base_score) FROM d WHERE train)) AS s FROM d)"""

_METRICS = """, g AS (SELECT ablation, model, train, s, sum(y) AS tp, sum(1 - y) AS fp FROM scored GROUP BY ALL),
r AS (SELECT *, sum(tp) OVER w AS rtp, sum(fp) OVER w AS rfp FROM g WINDOW w AS (PARTITION BY ablation, model, train ORDER BY s DESC)),
areas AS (SELECT ablation, model, train, CASE WHEN sum(tp) > 0 AND sum(fp) > 0 THEN sum(fp * (rtp - tp / 2.0)) / (sum(tp) * sum(fp)) END AS auroc,
  CASE WHEN sum(tp) > 0 AND sum(fp) > 0 THEN sum(tp * rtp / (rtp + rfp)) / sum(tp) END AS auprc, sum(tp) AS positives, sum(fp) AS negatives FROM r GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY ablation, model, train ORDER BY s DESC, cve_id) AS k, count(*) OVER (PARTITION BY ablation, model, train) AS n, sum(y) OVER (PARTITION BY ablation, model, train) AS p FROM scored),
top AS (SELECT ablation, model, train, """ + ", ".join(
    f"sum(y) FILTER (k <= {c}) / any_value(least({c}, n)) AS p_at_{c}, sum(y) FILTER (k <= {c}) / any_value(nullif(p, 0)) AS r_at_{c}, "
    f"sum(y / log2(k + 1)) FILTER (k <= {c}) / sum(1 / log2(k + 1)) FILTER (k <= least({c}, p)) AS ndcg_at_{c}" for c in ranking.CUTS
) + """ FROM t GROUP BY ALL)
SELECT ablation, model, CASE WHEN train THEN 'train' ELSE 'test' END AS split, CAST(positives AS BIGINT) AS positives, CAST(negatives AS BIGINT) AS negatives, """ + ", ".join(
    f"round({c}, 6) AS {c}" for c in ("auroc", "auprc", *[f"{m}_at_{k}" for k in ranking.CUTS for m in ("p", "r", "ndcg")])
) + ", round(positives / (positives + negatives), 6) AS prevalence FROM areas JOIN top USING (ablation, model, train)"


def rounded(metrics):
    return metrics.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in metrics.dtypes])


@query(_SCORED + """, scored AS (SELECT 'single' AS ablation, 'nb' AS model, cve_id, y, train, s FROM nb WHERE ablation = 'full' UNION ALL SELECT 'single', 'base_only', * FROM base)""" + _METRICS)
def metrics_table(spark, sf):
    train, test = ranker_rows(spark, sf)
    each = {"nb": by_likelihood, "base_only": by_base_score}
    scored = {("single", name, split): fit(train, rows, list(RANKED)) for name, fit in each.items() for split, rows in (("train", train), ("test", test))}
    return rounded(ranking.metrics_table(scored, "is_kev", "risk_score", "cve_id"))


@query(_SCORED + """ SELECT cve_id, CASE WHEN base.train THEN 'train' ELSE 'test' END AS split, nb.s AS risk_score_nb, base.s AS risk_score_base_only FROM base JOIN nb USING (cve_id) WHERE ablation = 'full'""")
def model_scores(spark, sf):
    return ranking.model_scores(*ranker_rows(spark, sf), {"nb": (by_likelihood, list(RANKED)), "base_only": (by_base_score, list(RANKED))}, "cve_id")


@query(_SCORED + """, scored AS (SELECT ablation, 'nb' AS model, cve_id, y, train, s FROM nb)""" + _METRICS)
def ablation_suite(spark, sf):
    return rounded(ranking.ablation_suite(*ranker_rows(spark, sf), RANKED, ranking.ABLATIONS, {"nb": by_likelihood}, "is_kev", "cve_id"))


@query()
def ablation_logistic(spark, sf):
    """All configurations of the logistic ranker, fitted side by side."""
    train, test = ranker_rows(spark, sf)
    return ranking.ablation_suite(train, test, RANKED, ranking.ABLATIONS, {}, "is_kev", "cve_id", together={"logreg": learners.logistic_side_by_side})


@query()
def ranker_metrics(spark, sf):
    """The six rankers on all columns."""
    train, test = ranker_rows(spark, sf)
    return ranking.ablation_suite(train, test, RANKED, {"full": ()}, learners.rankers("cve_id", "is_kev"), "is_kev", "cve_id")


@query("""WITH e AS (SELECT base_score AS s, event, t FROM (SELECT base_score, kev_present::INT AS event, (epoch_us(CASE WHEN kev_present THEN kev_published ELSE TIMESTAMP '2000-01-01' END) - epoch_us(published)) / 86400000000.0 AS t FROM described_1) WHERE t > 0 AND base_score IS NOT NULL)
SELECT round(sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) / count(*), 6) AS concordance, CAST(count(*) AS DOUBLE) AS pairs FROM e a JOIN e b ON a.event = 1 AND (a.t < b.t OR (a.t = b.t AND b.event = 0))""".replace("described_1", "master").replace("WITH e AS", ", e AS"))
def concordance_index(spark, sf):
    f = survival.survival_frame(master(spark, sf), AS_OF, ["base_score"])
    return concordance.concordance_index(f, "time_to_event", "base_score", "event").withColumn("concordance", F.round("concordance", 6))


def queries() -> dict[str, Query]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(TWINS)
