"""What a job moves and keeps grows with its rows, not with its few groups."""

import datetime as dt

from pyspark.sql import functions as F

from recallspark.adapters import Tables
from recallspark.catalog import search as CQ, streams as CS

from recallspark.functions import fixed
from recallspark.operators import citations as C, extract as X, tables as TB
from recallspark.sinks import BucketTable
from recallspark.sources import plan_sheets as PS, snapshot as SN


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sheets(spark):
    head = ["Fase", "Semana", "Actividad", "Responsable", "Estado"]
    cells = [("p", "s", 1, ["PLAN DE TRABAJO"]), ("p", "s", 2, head)] + [("p", "s", 3 + i, ["F1", f"S{i % 5 + 1}", f"Pieza {i % 20}", "IP", ""]) for i in range(60)]
    starts = spark.createDataFrame([("p", dt.date(2024, 1, 1))], "file string, plan_start date")
    return spark.createDataFrame(cells, "file string, sheet string, row long, cells array<string>"), starts


def test_cells_are_not_shuffled_by_sheet(spark):
    """Three files of two sheets each would put all cells into six tasks."""
    rows = PS.scan_plan_rows(*sheets(spark))
    assert "Exchange hashpartitioning" not in plan_of(rows)
    assert rows.count() == 60 and rows.where("due is null").isEmpty()


def test_plan_tasks_are_sorted_after_they_are_dealt(spark):
    """No task sorts the whole rows of its input; the last row of a repeated activity stays."""
    rows = PS.scan_plan_rows(*sheets(spark))
    plans = spark.createDataFrame([("p", "d", dt.date(2024, 1, 1), "x", "X", ["Luz"], "A")],
                                  "file string, doc_id string, doc_date date, project_id string, project string, people array<string>, area string")
    tasks = PS.import_plan_tasks(rows, plans)
    assert plan_of(tasks).count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_COL" in plan_of(tasks)
    assert tasks.count() == 20


def test_every_task_writes_its_own_part_of_a_stream(spark, tmp_path):
    """The rows of many tasks are not gathered in four; each row comes back once, in few batches."""
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    t = Tables(spark, str(tmp_path))
    for tasks, least in ((12, 12), (1, 4)):
        stream = CS._parts(t, spark.range(0, 1000, 1, tasks), "numbers", "lineitem")
        kept = CS._drain(t, stream.withColumn("file", F.input_file_name()), "kept")
        sizes = [r["n"] for r in kept.groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(sizes) == 1000 == kept.select("id").distinct().count() and len(sizes) >= least and max(sizes) <= 250


def test_stored_rows_are_written_where_they_are(spark, tmp_path):
    """A bucket is not gathered in one task, and nothing is written beside the table."""
    rows = spark.range(0, 400, 1, 4).select(F.col("id").cast("string").alias("id"), F.lit("old").alias("area"))
    table = BucketTable.create(rows, str(tmp_path / "t"), ["id"], 2)
    files = lambda: {b.name: len(list(b.glob("*.parquet"))) for b in (tmp_path / "t").glob("__bucket=*")}
    assert set(files()) == {"__bucket=0", "__bucket=1"} and min(files().values()) >= 4
    seen = []

    def classify(docs):
        seen.append(docs)
        return docs.withColumn("area", F.when(F.col("id").cast("int") < 300, F.lit("new")))

    assert TB.assign_areas_into(table, classify) == [0, 1]
    assert sorted((r.area or "", int(r.id)) for r in table.rows().collect()) == sorted([("new", i) for i in range(300)] + [("", i) for i in range(300, 400)])
    assert "Exchange hashpartitioning" not in plan_of(classify(seen[-1])) and TB.assign_areas_into(table, classify) == []


def test_a_snapshot_makes_each_table_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def once(x):
        made.add(1)
        return x

    edges = spark.createDataFrame([("e1", "a", "b"), ("e2", "a", "c")], "id string, source_id string, target_id string").select(
        "id", F.udf(once)("source_id").alias("source_id"), "target_id", F.lit("r").alias("rel_type"), F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    entities = spark.createDataFrame([("a", "A", "person"), ("b", "B", "person"), ("d", "D", "person")], "id string, name string, entity_type string")
    docs = spark.createDataFrame([("d1", "x"), ("d2", "y")], "id string, body string")
    SN.export_memory(docs, spark.createDataFrame([("k", "d1")], "id string, source_doc string"), entities, edges, str(tmp_path / "s"), include_bodies=False)
    got = SN.read_snapshot(spark, str(tmp_path / "s"))
    assert made.value == 2 and set(got) == set(SN.TABLES)
    assert sorted((r.id, r.degree) for r in got["nodes"].collect()) == [("a", 2), ("b", 1), ("d", 0)]
    assert got["links"].count() == got["relationships"].count() == 2 and [tuple(r) for r in got["documents"].collect()] == [("d1", "")]


def shuffles(df):
    return plan_of(df).split("Initial Plan")[0].count("Exchange hashpartitioning")


def test_links_are_dealt_by_document_once(spark):
    """Links that meet documents afterwards are not dealt out again; a person named twice is one link."""
    docs = spark.createDataFrame([("d1", ["Ana", "Ana", None, ""], "P", dt.date(2026, 1, 1)), ("d1", ["Ana"], "P", dt.date(2026, 1, 1)), ("d2", ["Ana"], None, None)],
                                 "id string, people array<string>, project string, date date")
    links = X.link_people_projects(docs)
    assert links.count() == 2 == links.select("id").distinct().count()
    spread = spark.range(0, 20, 1, 4).select(F.concat(F.lit("d"), F.col("id") % 3).alias("id"), F.array(F.lit("Ana")).alias("people"), F.lit("P").alias("project"),
                                             F.lit(dt.date(2026, 1, 1)).alias("date"))
    gone = spark.range(0, 9, 1, 3).select(F.concat(F.lit("d"), F.col("id")).alias("source_doc"))
    links = X.link_people_projects(spread).hint("merge")
    assert links.count() == 3 and shuffles(links.join(gone, "source_doc", "left_anti")) == 2


def test_enriched_notes_are_made_once(spark):
    """No part of the swap joins orders and line items again."""
    out = CQ.replace_with_enriched(Tables(spark, "/root/testdata/sf0.001"))
    assert "lineitem.parquet" not in plan_of(out) and out.where("what like 'removed:%'").count() == 2


def test_rows_to_delete_and_to_keep_come_from_one_join(spark):
    kos = spark.createDataFrame([("a", "d1"), ("b", "d2"), ("c", None)], "id string, source_doc string")
    gone = spark.createDataFrame([("d1",), ("d1",), (None,)], "id string")
    left, edges, removed = TB.delete_derived(kos, kos, gone)
    for df in (left, edges):
        assert df.columns == kos.columns and sorted(r.id for r in df.collect()) == ["b", "c"]
    assert {r.what: r.removed for r in removed.collect()} == {"kos": 1, "relationships": 1}
    assert "LeftSemi" not in plan_of(removed) and TB.delete_derived(left, edges, gone)[2].isEmpty()


def test_extractor_output_is_parsed_once(spark):
    """A size test below the output's own expression would make and parse every text twice; null items stay, empty lists go."""
    item = F.struct(F.lit("fact").alias("ko_type"), F.concat(F.lit("t"), F.col("id")).alias("title"))
    docs = spark.range(4).select(F.col("id").cast("string").alias("id"), F.lit(dt.date(2026, 1, 1)).alias("date"), F.lit("P").alias("project"))
    made = docs.select("id", F.to_json(F.struct(F.array(item).alias("knowledge_objects"))).alias("output"))
    kos, _, _ = X.normalise_extractor_output(made, docs)
    assert kos.count() == 4 and plan_of(kos).split("Initial Plan")[0].count("from_json") == 1
    odd = spark.createDataFrame([("0", '{"knowledge_objects": [null, {}]}'), ("1", '{"knowledge_objects": []}'), ("2", "no"), ("3", None)], "id string, output string")
    assert [r.ko_type for r in X.normalise_extractor_output(odd, docs)[0].collect()] == ["fact", "fact"]


def test_ingest_counts_travel_without_texts(spark):
    """New documents are told by the hash of their text; what they yield goes with it as numbers."""
    rows = [("b", "- [ ] uno\nDECISIÓN: dos\nnada: x", ["Ana", "Ana", None], "P", "s"), ("a", "- [ ] uno\nDECISIÓN: dos\nnada: x", ["Ana"], "P", "t"),
            ("c", "idea: tres", None, "P", "s"), ("d", None, ["Ana"], None, None), ("e", None, ["Ana"], "P", None), ("f", "x", [], "P", None)]
    docs = spark.createDataFrame(rows, "id string, body string, people array<string>, project string, source string").withColumns(
        {"title": F.lit("t"), "date": F.lit(dt.date(2026, 1, 1)), "doc_type": F.lit("note"), "tags": F.array(F.lit("g")), "area": F.lit(None).cast("string")})
    got = TB.ingest_summary(docs, {"knowledge_objects": X.number_of_marks(), "relationships": X.number_of_links()})
    assert {tuple(r) for r in got.collect()} == {("s", 1, 1, 1, 0), ("t", 1, 0, 2, 1), (None, 2, 1, 0, 0)}
    kept = TB.dedup_documents(docs)
    assert X.extract_marked_lines(kept).count() == 3 and X.link_people_projects(kept).count() == 1
    assert shuffles(got) <= 4  # by hash, twice by source and by source over both


def test_copies_are_told_by_bytes(spark):
    """The hash travels in 32 bytes and rows without maps carry their id once; the result is the same as with one."""
    docs = spark.createDataFrame([("b", "x", None), ("a", "x", 1), ("c", None, 2), ("d", None, 3)], "id string, body string, n int")
    plain, mapped = TB.keep_first_by_hash(docs), TB.keep_first_by_hash(docs.withColumn("m", F.create_map(F.lit("k"), F.col("id"))))
    want = [("a", 1), ("c", 2)]
    for got in (plain, mapped):
        assert sorted((r.id, r.n) for r in got.collect()) == want
    assert plain.columns == ["body_hash", "id", "body", "n"]
    assert {r.body_hash for r in plain.collect()} == {r[0] for r in docs.select(F.sha2("body", 256)).collect()}
    assert "unhex" in plan_of(plain) and "min_by" not in plan_of(plain)


def test_lines_without_a_sign_are_not_searched(spark):
    """Every pattern of a mark holds one of the signs that a line is looked over for first."""
    lines = ["DECISIÓN: a", "decision : b", " - [ ] c", "* [ ] d", "open: e", "Idea:f", "hipotesis: g", "- [x] h", "nada", "", "a: b", "[ ] z"]
    docs = spark.createDataFrame([("\n".join(lines),)], "body string")
    got = [(m.line_no, m.mark.ko_type, m.mark.text) for m in docs.select(X.marks_in(F.col("body")).alias("m")).first().m]
    assert got == [(0, "decision", "a"), (1, "decision", "b"), (2, "task", "c"), (3, "task", "d"), (4, "question", "e"), (5, "idea", "f"), (6, "hypothesis", "g")]
    assert all(any(s in p.replace("\\[ \\]", "[ ]").replace("(?:", "") for s in fixed.MARK_SIGNS) for _, p in fixed.LINE_MARKS)


def test_citations_and_works_are_never_collected(spark, monkeypatch):
    """Files of repeated words are small beside their rows: their size must not make the driver collect them."""
    plans, write = [], C.written
    monkeypatch.setattr(C, "written", lambda df, name: plans.append(plan_of(df)) or write(df, name))
    docs = spark.createDataFrame([(f"d{i}", f"1. Ring K, et al. Estudio de ring {i}. Revista. 2001;\nVer 10.1000/p{i}") for i in range(30)],
                                 "id string, body string")
    works = spark.createDataFrame([(f"10.1000/P{i}", f"Estudio de ring {i}", "Ring", "2001") for i in range(30)],
                                  "doi string, title string, family string, year string")
    verified = C.verify_references(C.extract_references(docs), works)
    plans.append(plan_of(C.reference_summary(verified)))
    assert len(plans) > 5 and "SortMergeJoin" in plans[-1] and not any("Broadcast" in p for p in plans)
    assert {(r.verdict, r.work_doi == "10.1000/P" + r.doc_id[1:]) for r in verified.collect()} == {(C.OK, True)}


def test_stored_edges_are_met_by_their_keys(spark, tmp_path, monkeypatch):
    """Edges that are stored once are not dealt out with their rows to take in others; copies of a key still go."""
    kind = "id string, source_id string, target_id string, rel_type string, source_doc string"
    row = lambda i, doc=None: (f"e{i}", "s", f"t{i}", "r", doc)
    incoming = spark.createDataFrame([("x9", *row(9)[1:]), row(9), ("x1", *row(1)[1:]), row(1, "d")], kind)
    plans, write = [], BucketTable._write
    monkeypatch.setattr(BucketTable, "_write", lambda self, rows, touched: plans.append(plan_of(rows)) or write(self, rows, touched))
    for stored, want in (([row(1), row(2)], ["e1", "e1", "e2", "e9"]), ([row(1), row(1), row(2)], None)):
        table = BucketTable.create(spark.createDataFrame(stored, kind), str(tmp_path / str(len(stored))), TB.EDGE_KEY, 1)
        held = table.rows()
        whole = sorted(map(tuple, TB.merge_relationships(held, incoming).collect()), key=str)
        assert TB.merge_relationships_into(table, incoming) == [0] and TB.merge_relationships_into(table, incoming) == []
        spark.catalog.refreshByPath(table.path)
        assert sorted(map(tuple, table.rows().collect()), key=str) == whole and (want is None or [w[0] for w in whole] == want)
    assert "hashpartitioning" not in plans[1] and "hashpartitioning" in plans[3]


def test_only_asked_columns_travel_to_find_copies(spark):
    docs = spark.createDataFrame([("b", "x", 3), ("a", "x", 1), ("c", None, 2), ("d", None, 3)], "id string, body string, n int")
    docs = docs.withColumn("m", F.create_map(F.lit("k"), F.col("id")))
    got = TB.keep_first_by_hash(docs, columns=["n", "id"])
    assert got.columns == ["body_hash", "n", "id"] and sorted((r.id, r.n) for r in got.collect()) == [("a", 1), ("c", 2)]
    assert "struct(id, id#" in plan_of(got) and ", body, body#" not in plan_of(got) and "map(" not in plan_of(got)


def test_objects_are_taken_apart_after_they_met_their_document(spark):
    """One row a document travels, not one an object; every output of a document meets every row of it."""
    docs = spark.createDataFrame([("d", dt.date(2026, 1, 1), "P"), ("d", dt.date(2026, 1, 2), "Q"), ("e", None, None)], "id string, date date, project string")
    outputs = spark.createDataFrame([("d", '{"knowledge_objects": [{"title": "a"}, {"title": "b", "project": "R"}]}'), ("d", '{"knowledge_objects": [{"title": "c"}]}'),
                                     ("x", '{"knowledge_objects": [{"title": "y"}]}'), ("e", '{"knowledge_objects": []}')], "id string, output string")
    kos = X.normalise_extractor_output(outputs, docs)[0]
    assert sorted((r.title, r.project) for r in kos.collect()) == [("a", "P"), ("a", "Q"), ("b", "R"), ("b", "R"), ("c", "P"), ("c", "Q")]
    plan = plan_of(kos)
    assert plan.index("Generate posexplode") < plan.index("SortMergeJoin") and "Broadcast" not in plan


def test_many_small_files_have_no_checksum_files(spark, tmp_path, monkeypatch):
    """Each would be a file more to make and to set modes of; the texts are read as they are."""
    spark.createDataFrame([(1, "a\nb", "en", "s", 3), (2, "c", "de", None, 1)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(
        str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(CS, "run_dir", lambda _, name: str(tmp_path / name))
    got = CS.incremental_files(Tables(spark, str(tmp_path)))
    assert {(r.source, r.lang, r.block, r.length) for r in got.collect()} == {("s", "en", 0, 4), (None, "de", 0, 2)}
    assert not [p for p in (tmp_path / "files").rglob("key=*/.*.crc")] and len(list((tmp_path / "files").rglob("key=*/*.txt"))) == 2
