"""Streams give what batch gives, and a second run adds nothing."""

import datetime as dt
import os
import random
import re

from pyspark.sql import functions as F, types as T

from recallspark.adapters import Tables
from recallspark.catalog import streams as CS
from recallspark.operators import tables as TB
from recallspark.registry import all_queries
from recallspark.sinks import BucketTable
from recallspark.sources import accounts as AC
from recallspark.sources.files import readable_files
from recallspark.streaming import jobs as S


def test_bounded_dedup_and_rerun(spark, tmp_path):
    src, out, ck = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck")
    now = dt.datetime(2026, 1, 1)
    spark.createDataFrame([("a", "x", now), ("b", "x", now), ("c", "y", now)], "id string, body string, at timestamp").write.parquet(src)
    schema = spark.read.parquet(src).schema
    for _ in range(2):
        S.run_to_table(S.stream_dedup_window(S.file_stream(spark, src, schema), "at", "1 hour"), out, ck)
    assert spark.read.parquet(out).count() == 2


def test_permanent_dedup_over_batches(spark, tmp_path):
    src, out, ck = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck")
    spark.createDataFrame([("a", "x"), ("b", "x")], "id string, body string").write.parquet(src)
    schema = spark.read.parquet(src).schema
    S.stream_dedup_docs(S.file_stream(spark, src, schema), out, ck)
    spark.createDataFrame([("c", "x"), ("d", "y")], "id string, body string").coalesce(1).write.mode("append").parquet(src)
    S.stream_dedup_docs(S.file_stream(spark, src, schema), out, ck)
    assert sorted(r["body"] for r in spark.read.parquet(out).collect()) == ["x", "y"]


def test_dedup_reads_only_its_prefixes(spark, tmp_path):
    src, out, ck = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck")
    spark.createDataFrame([(f"a{i}", f"x{i}") for i in range(400)], "id string, body string").write.parquet(src)
    schema = spark.read.parquet(src).schema
    S.stream_dedup_docs(S.file_stream(spark, src, schema), out, ck)
    few = spark.createDataFrame([("b", "x7"), ("c", "new")], "id string, body string").withColumn("body_hash", F.sha2("body", 256)).withColumn(
        "prefix", F.concat(F.lit("p"), F.substring("body_hash", 1, 2)))
    read = S.seen_hashes(spark, out, 1, few)
    prefixes = {r.prefix for r in few.collect()}
    assert read.count() == sum(1 for r in spark.read.parquet(out).collect() if r.prefix in prefixes) < 20
    assert re.search(r"PartitionFilters: \[[^\n]*prefix#\d+ (IN|INSET) ", read._jdf.queryExecution().toString())


def test_files_are_read_once(spark, tmp_path):
    """A file with the modification time of one that was read before is new all the same."""
    root = tmp_path / "files"
    (root / "a").mkdir(parents=True)
    (root / "a" / "one.md").write_text("first")
    (root / "a" / "skip.bin").write_text("none")
    job = lambda: S.read_new_files(spark, str(root), str(tmp_path / "out"), str(tmp_path / "ck"))
    job()
    old = (root / "a" / "one.md").stat()
    (root / "two.html").write_text("<p>second &amp; last</p>")
    os.utime(root / "two.html", ns=(old.st_atime_ns, old.st_mtime_ns))
    for _ in range(2):
        job()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.path.split("/")[-1], r.body) for r in rows) == [("one.md", "first"), ("two.html", "second & last")]


def test_drive_cursors(spark, tmp_path):
    """Two accounts; a run that ends before its cursors are written is repeated without loss or copies."""
    table, cursors = str(tmp_path / "t"), str(tmp_path / "c")
    files = lambda rows: spark.createDataFrame(rows, "account string, id string, modifiedTime string")
    day1 = [("a", "1", "2024-01-01"), ("a", "2", "2024-01-02"), ("b", "3", None)]
    assert AC.read_changed(files(day1), table, cursors) == 1
    day2 = day1 + [("a", "4", "2024-01-03"), ("b", "5", "2024-01-01"), ("c", "6", "2020-01-01")]
    files([("a", "4", "2024-01-03")]).write.parquet(f"{table}/run=2")  # as left by a run without cursors
    assert AC.read_changed(files(day2), table, cursors) == 2
    assert AC.read_changed(files(day2), table, cursors) == 3
    rows = sorted((r.run, r.id) for r in spark.read.parquet(table).collect())
    assert rows == [(1, "1"), (1, "2"), (1, "3"), (2, "3"), (2, "4"), (2, "5"), (2, "6")]
    run, last = AC.last_cursors(spark, cursors)
    assert run == 3 and sorted((r.account, r.cursor) for r in last.collect()) == [("a", "2024-01-03"), ("b", "2024-01-01"), ("c", "2020-01-01")]


def test_signal_counts_match_batch(spark, tmp_path):
    """Shuffled arrival inside the bound changes nothing; what is later is dropped; old days leave the state."""
    src, out, ck = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck")
    t0, rng = dt.datetime(2026, 1, 1), random.Random(1)
    rows = [(rng.choice("ab"), t0 + dt.timedelta(hours=rng.randrange(24 * 90)), rng.randrange(5)) for _ in range(600)] + [("c", t0, 1)]
    rows.sort(key=lambda r: r[1] + dt.timedelta(hours=rng.randrange(47)))
    kind = "who string, at timestamp, points long"
    for k in range(0, len(rows), 60):
        spark.createDataFrame(rows[k:k + 60], kind).coalesce(1).write.mode("append").parquet(src)
        S.signal_table(S.stream_signal_counts(S.file_stream(spark, src, T._parse_datatype_string(kind)), "who", "at"), out, ck)
    key = lambda df: sorted((r["days"], str(r["start"]), r["who"], r["n"], r["points"]) for r in df.collect())
    want = key(S.signal_counts(spark.createDataFrame(rows, kind), "who", "at"))
    assert key(S.latest_windows(spark, out, "who")) == want
    spark.createDataFrame([("a", t0, 1)], kind).coalesce(1).write.mode("append").parquet(src)
    S.signal_table(S.stream_signal_counts(S.file_stream(spark, src, T._parse_datatype_string(kind)), "who", "at"), out, ck)
    assert key(S.latest_windows(spark, out, "who")) == want
    state = spark.read.format("statestore").load(ck).select("key", "value").collect()
    sizes = {r.key[0]: len(r.value.groupState.day) if hasattr(r.value, "groupState") else len(r.value[0]) for r in state}
    assert set(sizes) == {"a", "b"} and max(sizes.values()) <= 30 + 2 + 12  # the days that a batch spans come on top


def test_signal_query_over_a_year(spark, tmp_path):
    """However long the events last."""
    rows = [(t, str(dt.datetime(2024, 1, 1) + dt.timedelta(days=i % 366, hours=i % 24))) for i in range(1500) for t in ("a", "b")]
    spark.createDataFrame(rows, "event_type string, ts string").write.parquet(str(tmp_path / "events.parquet"))
    got, want = (sorted(tuple(r) for r in all_queries()[q](spark, str(tmp_path)).collect()) for q in ("stream_signal_counts", "signal_counts"))
    assert got == want and len(got) == 2 * (3 * 366 + 6 + 13 + 29)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    """Changes, repeated changes, and a bucket that loses its last row."""
    kind = "id string, title string, status string, people array<string>"
    rows = [(f"k{i}", f"t{i}", "active", ["x"]) for i in range(100)]
    path = str(tmp_path / "kos")
    table = BucketTable.create(spark.createDataFrame(rows, kind), path, ["id"], 8)
    names = lambda: {b.name: {f.name for f in b.glob("*.parquet")} for b in (tmp_path / "kos").glob("__bucket=*")}
    before = names()
    assert len(before) == 8
    new = spark.createDataFrame([("k7", "t7", "done", None), ("new", "n", "active", ["y"])], kind)
    touched = TB.upsert_kos_into(table, new)
    after = names()
    assert {b for b in before if before[b] != after[b]} == {f"__bucket={b}" for b in touched} and 0 < len(touched) <= 2
    for _ in range(2):
        want = sorted([*(r for r in rows if r[0] != "k7"), ("k7", "t7", "done", None), ("new", "n", "active", ["y"])])
        assert sorted((r.id, r.title, r.status, r.people) for r in table.rows().collect()) == want
        assert TB.upsert_kos_into(table, new) == touched
    one = table.touched(spark.createDataFrame([("k7",)], "id string"))
    gone = table.rows().where(table.bucket() == one[0]).select("id")
    assert table.change(gone, lambda held, ids: held.join(ids, "id", "left_anti")) == one
    assert table.rows().where(table.bucket() == one[0]).isEmpty() and not table.rows().isEmpty()
    assert table.change(gone.limit(0), lambda held, ids: held) == []


def test_null_keys_and_edges(spark, tmp_path):
    kind = "id string, source_id string, target_id string, rel_type string, source_doc string"
    edges = spark.createDataFrame([("e1", "a", "b", "r", None), ("e2", "a", "b", "r", "d1"), ("e3", "a", "c", "r", "d2")], kind)
    table = BucketTable.create(edges, str(tmp_path / "edges"), TB.EDGE_KEY, 4)
    assert TB.merge_relationships_into(table, edges.withColumn("id", F.lit("x"))) == []
    assert len(TB.merge_relationships_into(table, spark.createDataFrame([("e4", "z", None, "r", None), ("e5", "z", None, "r", None)], kind))) == 1
    assert sorted(r.id for r in table.rows().collect()) == ["e1", "e2", "e3", "e4"]
    kos = BucketTable.create(spark.createDataFrame([("k1", "d1"), ("k2", None)], "id string, source_doc string"), str(tmp_path / "kos"), ["id"], 4)
    removed = TB.delete_derived_from(kos, table, spark.createDataFrame([("d1",), ("d1",)], "id string"))
    assert sorted(map(tuple, removed.collect())) == [("kos", 1), ("relationships", 1)]
    assert [r.id for r in kos.rows().collect()] == ["k2"] and table.rows().count() == 3


def test_old_mail_is_triaged_too(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    now = dt.datetime(2026, 1, 31)
    row = "id string, `from` string, subject string, snippet string, date timestamp, labels array<string>"
    spark.createDataFrame([("new", "Ana <a@x>", "s", "", now, []), ("old", "Ana <a@x>", "s", "", dt.datetime(2020, 1, 1), [])], row).write.parquet(src)
    people = spark.createDataFrame([("ana", "Ana", 1)], "low string, name string, degree long")
    pinned = spark.createDataFrame([], "name string")
    mail = S.file_stream(spark, src, spark.read.parquet(src).schema)
    S.triage_each_batch(mail, people, pinned, now, out, str(tmp_path / "ck"))
    assert {r.id: r.score for r in spark.read.parquet(out).collect()} == {"new": 52, "old": 42}


def test_new_files_are_listed_by_few_tasks(spark, tmp_path):
    """Many folders of one file each: a run does not start a task for every folder, and the session keeps its setting."""
    root = tmp_path / "files"
    for i in range(300):
        (root / f"key={i}").mkdir(parents=True)
        (root / f"key={i}" / ("a.html" if i % 3 == 0 else "a.md")).write_text(f"<p>{i} &amp; &rarr;</p>" if i % 6 == 0 else f"<b>{i}</b> &lt;" if i % 3 == 0 else f"<{i}>")
    before = spark.conf.get(S.LISTING)
    sc = spark.sparkContext
    sc.setJobGroup("listing", "")
    with S.listed_together(spark):
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root)).count()
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) <= 4 * sc.defaultParallelism and spark.conf.get(S.LISTING) == before
    sc.setLocalProperty("spark.jobGroup.id", None)
    S.read_new_files(spark, str(root), str(tmp_path / "out"), str(tmp_path / "ck"))
    out = spark.read.parquet(str(tmp_path / "out"))
    got = {int(r.path.split("key=")[1].split("/")[0]): r.body for r in out.collect()}
    assert got == {i: f"{i} & →" if i % 6 == 0 else f"{i}\n<" if i % 3 == 0 else f"<{i}>" for i in range(300)}


def test_files_are_opened_once(spark):
    """Pages and plain texts come from one pass over the contents."""
    raw = spark.range(3).select(F.concat(F.lit("d/"), F.col("id"), F.element_at(F.array(F.lit(".md"), F.lit(".htm"), F.lit(".exe")), (F.col("id") + 1).cast("int"))).alias("path"),
                                F.current_timestamp().alias("modificationTime"), F.col("id").alias("length"), F.lit("<i>a</i> &copy; ").cast("binary").alias("content"))
    text = readable_files(raw)
    assert "Union" not in text._jdf.queryExecution().optimizedPlan().toString()
    assert {r.path: r.body for r in text.collect()} == {"d/0.md": "<i>a</i> &copy; ", "d/1.htm": "a\n©"}


def test_odd_sources_come_back_from_their_files(spark, tmp_path):
    rows = [(1, "a\nb", "s/1 =x", "en"), (0, "c", "s/1 =x", "en"), (1002, "d", None, "es"), (-3, "e", "ñ-n", None), (5, " ", "n", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.source, r.lang, r.block, r.length) for r in CS.incremental_files(Tables(spark, str(tmp_path))).collect()}
    assert got == {("s/1 =x", "en", 0, 6), (None, "es", 1, 2), ("ñ-n", None, -1, 2)}
