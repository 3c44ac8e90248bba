"""Feed readers, sinks and streams on files that the tests write."""

import json
import random
import time
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vulnlake.operators.upsert import high_water, upsert_latest
from vulnlake.sources import feeds, json_ranges, snapshots, tables
from vulnlake.streaming import jobs


@pytest.fixture
def nvd(spark, tmp_path):
    full = {
        "id": "CVE-2021-1", "sourceIdentifier": "x@y", "published": "2021-01-02T03:04:05.000", "lastModified": "2021-01-03T00:00Z",
        "descriptions": [{"lang": "en", "value": "one"}, {"lang": "es", "value": "uno"}, {"lang": "en", "value": "two"}],
        "metrics": {"cvssMetricV31": [{"cvssData": {"baseScore": 9.8, "baseSeverity": "CRITICAL", "vectorString": "CVSS:3.1/AV:N", "attackVector": "NETWORK"}, "exploitabilityScore": 3.9, "impactScore": 5.9}], "cvssMetricV2": [{"cvssData": {"baseScore": 5.0}}]},
        "weaknesses": [{"description": [{"lang": "en", "value": "CWE-79"}, {"lang": "en", "value": "NVD-CWE-noinfo"}]}, {"description": [{"lang": "en", "value": "CWE-79 and CWE-20"}]}],
        "configurations": [{"nodes": [{"cpeMatch": [{"criteria": "cpe:2.3:a:acme:tool:1.0"}, {"criteria": "cpe:2.3:x:bad:one:1"}], "children": [{"cpeMatch": [{"cpe23Uri": "cpe:2.3:o:zed:os"}]}]}]}],
        "references": [{"url": "b"}, {"url": "a"}, {"url": ""}, {"url": "b"}], "cisaExploitAdd": "2021-05-01",
    }
    old = {"id": "CVE-2021-2", "description": [{"lang": "en", "value": "old"}], "metrics": {"cvssMetricV31": [], "cvssMetricV2": [{"cvssData": {"baseScore": 5.0}, "impactScore": 2.9}]}}
    (tmp_path / "nvd.json").write_text(json.dumps({"vulnerabilities": [{"cve": full}, {"cve": old}, {"cve": {"id": "CVE-2021-3"}}, {}]}))
    return {r.id: r for r in feeds.tidy_nvd(feeds.read_nvd_feed(spark, str(tmp_path / "nvd.json"))).collect()}


def test_nested_records(nvd):
    r = nvd["CVE-2021-1"]
    assert (r.description_en, r.cwe_list, r.cwes) == ("one two", ["CWE-20", "CWE-79", "NVD-CWE-noinfo"], "CWE-20 | CWE-79 | NVD-CWE-noinfo")
    assert (r.references, r.vendors, r.products) == ("a | b", "acme | zed", "os | tool")
    assert (r.cvss_basescore, r.cvss_version, r.cvss_attackvector, r.is_known_exploited) == (9.8, "3.1", "NETWORK", True)
    assert r.published == datetime(2021, 1, 2, 3, 4, 5) and r.lastmodified == datetime(2021, 1, 3) and json.loads(r.raw_json)["id"] == "CVE-2021-1"
    o = nvd["CVE-2021-2"]
    assert (o.description_en, o.cvss_basescore, o.cvss_version, o.cvss_baseseverity, o.cwe_list, o.vendors, o.is_known_exploited) == ("old", 5.0, "2.0", None, [], "", False)
    assert nvd["CVE-2021-3"].cvss_version is None and len(nvd) == 3


def test_csv_feed(spark, tmp_path):
    (tmp_path / "kev.csv").write_text('cveID,vendorProject,product,vulnerabilityName,dateAdded,shortDescription,requiredAction,dueDate,knownRansomwareCampaignUse\nCVE-2021-1,v,p,"n, m",2021-05-01,d,a,2021-06-01,Known\n')
    r = feeds.read_kev_feed(spark, str(tmp_path / "kev.csv")).first()
    assert (r.cve_id, r.vulnerabilityName, r.dateadded, r.kev_listed) == ("CVE-2021-1", "n, m", datetime(2021, 5, 1), True)
    gone = feeds.read_kev_feed(spark, str(tmp_path / "none.csv"))
    assert gone.count() == 0 and "cve_id" in gone.columns


def test_xml_feed(spark, tmp_path):
    item = '<item><title>t{0}</title><link>l</link><dc:date>2021-01-02T03:04+09:00</dc:date><sec:identifier>JVNDB-{0}</sec:identifier>{1}</item>'
    first = '<sec:references source="CVE" id="CVE-2021-1"/><sec:references source="X" id="Z"/><sec:references source="CVE" id="CVE-2021-2"/><sec:cvss score="7.5" severity="High"/><sec:cpe vendor="v" product="p"/>'
    (tmp_path / "jvn.xml").write_text(f'<rdf xmlns:dc="d" xmlns:sec="s">{item.format(1, first)}{item.format(2, "")}</rdf>')
    got = {r.jvndb_id: r for r in feeds.read_jvn_feed(spark, str(tmp_path / "jvn.xml")).collect()}
    r = got["JVNDB-1"]
    assert (r.cve_ids, r.affected_products, r.cvss_score, r.cvss_severity, r.published_date) == ("CVE-2021-1, CVE-2021-2", "v:p", 7.5, "High", datetime(2021, 1, 1, 18, 4))
    assert not got["JVNDB-2"].cve_ids and got["JVNDB-2"].cvss_score is None


@pytest.mark.parametrize("range_bytes", ["37b", "1500b", "128m"])
def test_pages_are_read_by_ranges(spark, tmp_path, range_bytes):
    draw = random.Random(6)
    odd = ['}', '{"id": "CVE-9"}', 'say \\"}] {', "\\\\", '"', "é😀\n}", "[[[", ""]
    record = lambda i: {"cve": {"id": f"CVE-{i}", "descriptions": [{"lang": "en", "value": draw.choice(odd) + "x" * draw.choice([0, 3, 700])}], "weaknesses": [{"description": [{"lang": "en", "value": "CWE-1"}]}] * (i % 3)}}
    pages = [[record(10 * p + i) for i in range(draw.choice([0, 1, 9]))] for p in range(6)]
    for p, rows in enumerate(pages):
        page = {"total": 3, "more": {"a": [1, {"b": "}"}]}, "vulnerabilities": rows, "note": ["x", "}"]}
        text = json.dumps([page, page], indent=1) if p == 3 else json.dumps(page, indent=draw.choice([None, 2]), ensure_ascii=p % 2 == 0)
        (tmp_path / f"page-{p}.json").write_text(text)
    (tmp_path / "empty.json").write_text("{}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", range_bytes)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert range_bytes == "128m" or json_ranges.fragments(spark, str(tmp_path)).select("file", "block").distinct().count() > 12
        got = sorted(feeds.read_nvd_feed(spark, str(tmp_path)).collect(), key=str)
        order = [tuple(r) for r in json_ranges.records(spark, str(tmp_path)).filter("record LIKE '%cve%'").orderBy(json_ranges.page_number(F.col("file")), "block", "place").select(F.get_json_object("record", "$.cve.id")).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    plain = spark.read.option("multiLine", True).schema(feeds.NVD).json(str(tmp_path)).select(F.explode("vulnerabilities").alias("v")).select("v.cve").filter("cve.id is not null")
    assert got == sorted(plain.collect(), key=str) and len(got) == sum(map(len, pages)) + len(pages[3])
    assert [i for (i,) in order] == [r["cve"]["id"] for p, rows in enumerate(pages) for _ in range(1 + (p == 3)) for r in rows]


def test_later_pages_win_by_number(spark, tmp_path):
    for p in (2, 9, 10):
        (tmp_path / f"{p}.json").write_text(json.dumps({"items": [{"id": "E1", "baseScore": float(p)}]}))
    assert [r.baseScore for r in feeds.read_euvd_feed(spark, str(tmp_path)).collect()] == [10.0]


def test_paged_feed(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"items": [{"id": "E1", "baseScore": 1.0, "datePublished": "Dec 12, 2025, 1:02:03 PM"}, {"id": "E2"}]}))
    (tmp_path / "2.json").write_text(json.dumps({"content": [{"id": "E1", "baseScore": 2.0, "aliases": "CVE-2025-1\n"}]}))
    got = {r.id: r for r in feeds.read_euvd_feed(spark, str(tmp_path)).collect()}
    assert got["E1"].baseScore == 2.0 and len(got) == 2


def test_master_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", datetime(2021, 1, 1), ["x", "y"], 'say "hi", ok')], "k string, published timestamp, l array<string>, t string")
    place = str(tmp_path / "master")
    tables.write_master(df, place)
    tables.write_master(df, place)
    assert tables.read_master(spark, place).collect() == df.collect()
    for folder, _ in snapshots.listed(spark, f"{place}/data"):
        tables.remove(spark, f"{place}/data/{folder}/parquet")
    back = tables.read_master(spark, place).first()
    assert (back.published, back.l, back.t) == (datetime(2021, 1, 1), '["x","y"]', 'say "hi", ok')


def test_publish(spark, tmp_path):
    place = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, ts timestamp, v int")
    tables.publish_table(rows(("a", datetime(2021, 1, 1), 1)), place, "replace")
    tables.publish_table(rows(("a", datetime(2021, 1, 2), 2), ("b", datetime(2021, 1, 1), 3)), place, "upsert", "k", "ts")
    assert sorted((r.k, r.v) for r in tables.read_master(spark, place).collect()) == [("a", 2), ("b", 3)]
    tables.publish_table(rows(("c", None, 4)), place, "append")
    assert tables.read_master(spark, place).count() == 3
    for mode, key in (("merge", "k"), ("upsert", "none"), ("upsert", None)):
        with pytest.raises(ValueError):
            tables.publish_table(rows(("a", None, 1)), place, mode, key)


def test_stream_equals_batch(spark, tmp_path):
    events = [(f"k{i % 7}", datetime(2021, 1, 1 + i % 5), i) for i in range(60)]
    df = spark.createDataFrame(events, "k string, ts timestamp, v int").orderBy("v").coalesce(1)
    src, master, mark = str(tmp_path / "in"), str(tmp_path / "master"), str(tmp_path / "mark")
    for part in range(3):
        df.filter(F.col("v") % 3 == part).coalesce(1).write.mode("append").parquet(src)
    run = lambda: jobs.stream_upsert(jobs.feed_stream(spark, src, df.schema, files_per_batch=1), master, "k", "ts", mark, "v").awaitTermination(120)
    run()
    once = sorted(map(tuple, tables.read_master(spark, master).collect()))
    want = upsert_latest(df.filter("false"), df, "k", "ts", "v")
    assert [x[:2] for x in once] == sorted(map(tuple, want.select("k", "ts").collect()))
    run()
    assert sorted(map(tuple, tables.read_master(spark, master).collect())) == once
    water = jobs.stream_high_water(jobs.feed_stream(spark, src, df.schema).withColumn("feed", F.lit("f")), "feed", ["ts"])
    q = water.writeStream.format("memory").queryName("water").outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{mark}2").start()
    q.awaitTermination(120)
    assert spark.table("water").agg(F.max("high_water")).first()[0] == high_water(df, ["ts"], "2030-01-01").first()[0]


def test_masters_are_whole_between_any_two_steps_of_a_write(spark, tmp_path, monkeypatch):
    """Every call a write makes to the store is stopped at once; what readers see before is the old table, afterwards the new one."""
    frame = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    seen = lambda place: sorted(tuple(r) for r in tables.read_master(spark, place).collect())
    for name in ("write_part", "commit", "hadoop", "listed", "entry"):
        place = str(tmp_path / name)
        tables.write_master(frame(("a", 1)), place)
        real, step = getattr(snapshots, name), 0
        while True:
            calls = []

            def stop(*args, **more):
                calls.append(name)
                if len(calls) > step:
                    raise OSError("stopped")
                return real(*args, **more)

            monkeypatch.setattr(snapshots, name, stop)
            try:
                tables.write_master(frame(("b", 2), ("c", step)), place)
                done = True
            except OSError:
                done = False
            monkeypatch.setattr(snapshots, name, real)
            if done:
                assert seen(place) == [("b", 2), ("c", step)]
                break
            assert seen(place) in ([("a", 1)], [("b", 2), ("c", step)])
            tables.write_master(frame(("a", 1)), place)
            step += 1
        assert step > 0


def test_a_reader_beside_a_writer_and_readers_of_old_versions(spark, tmp_path, monkeypatch):
    place = str(tmp_path / "m")
    first = tables.write_master(spark.createDataFrame([("a", 1)], "k string, v int"), place)
    pinned = tables.read_master(spark, place)
    real, seen = snapshots.commit, []

    def watched(session, where, new):
        seen.append([tuple(r) for r in tables.read_master(spark, place).collect()])
        return real(session, where, new)

    monkeypatch.setattr(snapshots, "commit", watched)
    second = tables.write_master(spark.createDataFrame([("b", 2), ("c", 3)], "k string, v int"), place)
    assert seen == [[("a", 1)]] and second == first + 1
    assert sorted(tuple(r) for r in tables.read_master(spark, place).collect()) == [("b", 2), ("c", 3)]
    assert [tuple(r) for r in pinned.collect()] == [("a", 1)] == [tuple(r) for r in tables.read_master(spark, place, version=first).collect()]
    assert snapshots.drop_old(spark, place, 3600) == []
    assert len(snapshots.drop_old(spark, place, 0)) == 1 and tables.read_master(spark, place).count() == 2
    assert not list((tmp_path / "m" / "log").glob("*.draft"))


def test_two_writers_at_once(spark, tmp_path):
    place = str(tmp_path / "m")
    rows = lambda w, i: spark.createDataFrame([(f"{w}{i}", i), ("both", 10 * i + w)], "k string, v int")
    tables.write_master(rows(0, 0), place)
    with ThreadPoolExecutor(3) as pool:
        jobs_done = [pool.submit(tables.publish_table, rows(w, i), place, "upsert", "k", "v") for i in range(1, 4) for w in (1, 2, 3)]
        [j.result() for j in jobs_done]
    got = {r["k"]: r["v"] for r in tables.read_master(spark, place).collect()}
    assert got == {"00": 0, "both": 33, **{f"{w}{i}": i for w in (1, 2, 3) for i in range(1, 4)}}
    assert snapshots.entry(spark, place)["version"] == 10
    with pytest.raises(snapshots.Conflict):
        tables.write_master(rows(0, 0), place, based_on=4)
    assert tables.write_master(rows(0, 0), place, based_on=10) == 11


def test_upserts_in_parts_equal_one_table(spark, tmp_path):
    place, draw, want = str(tmp_path / "m"), random.Random(4), {}
    rewritten = 0
    for i in range(24):
        rows = {f"k{draw.randrange(60)}" if draw.random() < 0.9 else None: (datetime(2021, 1, 1 + draw.randrange(9)) if draw.random() < 0.9 else None, i) for _ in range(draw.choice([1, 3, 40]))}
        for k, (ts, v) in rows.items():
            if k not in want or (ts or datetime(1970, 1, 1)) >= (want[k][0] or datetime(1970, 1, 1)):
                want[k] = (ts, v)
        snapshots.upsert(spark.createDataFrame([(k, ts, v) for k, (ts, v) in rows.items()], "k string, ts timestamp, v int").coalesce(1), place, "k", "ts", csv=False)
        parts = snapshots.entry(spark, place)["parts"]
        rewritten += parts[-1]["rows"]
        assert all(a["rows"] > 2 * b["rows"] for a, b in zip(parts, parts[1:]))
    assert sorted(((r.k, r.ts, r.v) for r in tables.read_master(spark, place).collect()), key=str) == sorted(((k, *v) for k, v in want.items()), key=str)
    snapshots.compact(spark, place)
    assert len(snapshots.entry(spark, place)["parts"]) == 1 and tables.read_master(spark, place).count() == len(want)
    tables.publish_table(spark.createDataFrame([("k0", None, 99)], "k string, ts timestamp, v int"), place, "append")
    assert tables.read_master(spark, place).count() == len(want) + 1


def test_plain_folders_are_masters_too(spark, tmp_path):
    spark.createDataFrame([("a", 1)], "k string, v int").write.parquet(str(tmp_path / "m" / "parquet"))
    assert tables.read_master(spark, str(tmp_path / "m")).count() == 1
    appended = spark.createDataFrame([("b", "2021-01-01")], "k string, published string")
    tables.write_master(appended, str(tmp_path / "n"))
    tables.publish_table(appended, str(tmp_path / "n"), "append")
    for folder, _ in snapshots.listed(spark, f"{tmp_path}/n/data"):
        tables.remove(spark, f"{tmp_path}/n/data/{folder}/parquet")
    assert tables.read_master(spark, str(tmp_path / "n")).count() == 2  # the CSV form holds what was appended


def test_a_stream_outlives_a_stop_before_and_after_its_commit(spark, tmp_path, monkeypatch):
    schema = "k string, ts timestamp, v int"
    batch = lambda i: spark.createDataFrame([(f"k{j}", datetime(2021, 1, 1 + i), 10 * i + j) for j in range(i, i + 4)], schema)
    src, master, mark = (str(tmp_path / n) for n in ("in", "master", "mark"))
    run = lambda: jobs.stream_upsert(jobs.feed_stream(spark, src, batch(0).schema), master, "k", "ts", mark).awaitTermination(120)
    got = lambda: sorted((r.k, r.v) for r in tables.read_master(spark, master).collect())
    batch(0).write.mode("append").parquet(src)
    run()
    before, real = got(), snapshots.commit
    batch(1).write.mode("append").parquet(src)
    for after in (False, True):

        def stop(*args):
            if after:
                real(*args)
            raise OSError("stopped")

        monkeypatch.setattr(snapshots, "commit", stop)
        with pytest.raises(Exception, match="stopped"):
            run()
        monkeypatch.setattr(snapshots, "commit", real)
        assert got() == ([("k0", 0), ("k1", 11), ("k2", 12), ("k3", 13), ("k4", 14)] if after else before)
    version = snapshots.entry(spark, master)["version"]
    run()
    assert got() == [("k0", 0), ("k1", 11), ("k2", 12), ("k3", 13), ("k4", 14)] and snapshots.entry(spark, master)["version"] == version


def test_publish_over_jdbc(spark):
    url, more = "jdbc:derby:memory:published;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = lambda *r: spark.createDataFrame(r, "k string, v int")
    read = lambda: sorted(tuple(r) for r in spark.read.format("jdbc").options(url=url, dbtable="t", **more).load().collect())
    tables.publish_table(rows(("a", 1)), "t", "append", url=url, **more)
    tables.publish_table(rows(("b", 2)), "t", "append", url=url, **more)
    assert read() == [("a", 1), ("b", 2)]
    tables.publish_table(rows(("c", 3)), "t", "replace", url=url, **more)
    assert read() == [("c", 3)]


def test_upsert_over_jdbc(spark):
    url, more = "jdbc:derby:memory:upserted;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = lambda *r: spark.createDataFrame(r, "k string, `day of` timestamp, v int, l array<int>")
    load = lambda table: spark.read.format("jdbc").options(url=url, dbtable=table, **more).load()
    read = lambda: sorted((r.k, r.v) for r in load("t").collect())
    one, two = datetime(2021, 1, 1), datetime(2021, 1, 2)
    send = lambda batch, *r: tables.publish_table(rows(*r), "t", "upsert", key="k", changed="day of", url=url, batch=batch, **more)
    send("1", ("a", one, 1, [1]), ("b", one, 2, None), ("b", two, 3, None), ("b", one, 4, None))
    assert read() == [("a", 1), ("b", 3)]
    send("2", ("b", one, 5, [2, 3]), ("c", None, 6, []))
    assert read() == [("a", 1), ("b", 5), ("c", 6)]
    send("2", ("b", one, 77, None), ("d", None, 77, None))  # a batch that comes again
    assert read() == [("a", 1), ("b", 5), ("c", 6)]
    with pytest.raises(Exception):
        send("3", ("a", one, 8, None), (None, one, 9, None))  # the server refuses a null key, and with it the whole batch
    assert read() == [("a", 1), ("b", 5), ("c", 6)]
    send("3", ("a", one, 8, None), ("e", one, 9, None))  # mended and sent again
    assert read() == [("a", 8), ("b", 5), ("c", 6), ("e", 9)]
    assert sorted(r[0] for r in load("t_batches").collect()) == ["1", "2", "3"]


def test_marks_of_idle_feeds_move_on(spark, tmp_path):
    src, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    schema = "name string, ts timestamp"
    land = lambda *rows: spark.createDataFrame(list(rows), schema).write.mode("append").parquet(src)
    day = lambda y, d: datetime(y, 1, d, 7)
    seen = []

    def watch(batch, _):
        seen.extend(batch.collect())

    def started(idle):
        feed = jobs.feed_stream(spark, src, spark.createDataFrame([], schema).schema)
        return jobs.stream_marks(feed, "name", ["ts"], idle=idle).writeStream.outputMode("update").foreachBatch(watch).option("checkpointLocation", mark).trigger(processingTime="500 milliseconds").start()

    def wait(query, test):
        until = time.time() + 60
        while not any(map(test, seen)) and time.time() < until:
            assert query.exception() is None
            time.sleep(0.2)
        assert any(map(test, seen))

    land(("a", day(2021, 5)), ("a", day(2021, 2)), ("b", day(2021, 3)), ("b", None), (None, day(2021, 9)))
    query = started("1 hour")
    wait(query, lambda r: r.feed == "b")
    land(("a", day(2020, 1)), ("a", day(2020, 2)), ("a", day(2021, 4)))  # two rows come late and don't move the mark
    wait(query, lambda r: r.feed == "a" and r.late_rows == 2)
    query.stop()
    query.awaitTermination(60)
    assert {r.feed: r.high_water for r in seen} == {"a": day(2021, 5), "b": day(2021, 3)} and not any(r.idle for r in seen)
    seen.clear()
    land(("b", day(2021, 8)))
    query = started("2 seconds")  # goes on from its checkpoint: only what is new moves a mark
    wait(query, lambda r: r.feed == "b" and not r.idle)
    assert [r.high_water for r in seen if r.feed == "b" and not r.idle] == [day(2021, 8)]
    wait(query, lambda r: r.feed == "b" and r.idle)
    query.stop()
    query.awaitTermination(60)
    moved = [r for r in seen if r.feed == "b" and r.idle]
    assert all(abs((datetime.now() - r.high_water).total_seconds()) < 3600 * 24 for r in moved)
