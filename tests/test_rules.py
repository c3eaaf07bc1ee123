"""Rules, ties and boundaries on small literal rows."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from recallspark.functions import text as TX
from recallspark.operators import areas as A, citations as C, extract as X, folders as D, mail as M, retrieval as R, scale as S, tables as TB
from recallspark.plans import packs as PK
from recallspark.sources import accounts as AC, conversations as CV, files as FS, notes as N, plan_sheets as PS, references as RF

NOTE = """---
title: Reunión clínica
type: meeting
date: 2026-08-12
people: [Rita, Raúl]
project: Plataforma
organizations: [Centro]
tags: [datos]
---

# Reunión clínica

decisión: Avanzar con la base.
- [ ] Preparar propuesta
  * [ ] Revisar factibilidad
PREGUNTA: ¿Qué estándar?
texto PREGUNTA: no cuenta
"""


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_note_pipeline(spark):
    raw = spark.createDataFrame([("v/meetings/a.md", NOTE), ("v/_draft.md", NOTE), ("v/templates/t.md", NOTE), ("v/Papers/b.md", "# Título\ncuerpo")],
                                "path string, text string")
    docs = N.parse_notes(raw, dt.date(2020, 1, 1))
    got = {r["path"]: r for r in docs.collect()}
    assert set(got) == {"v/meetings/a.md", "v/Papers/b.md"}
    a, b = got["v/meetings/a.md"], got["v/Papers/b.md"]
    assert (a["title"], a["doc_type"], str(a["date"]), a["people"]) == ("Reunión clínica", "meeting", "2026-08-12", ["Rita", "Raúl"])
    assert (b["title"], b["doc_type"], str(b["date"])) == ("Título", "paper", "2020-01-01")
    kos = X.extract_all(docs)
    assert sorted(r["ko_type"] for r in kos.collect()) == ["decision", "event", "question", "task", "task"]
    apart = X.extract_marked_lines(docs).unionByName(X.extract_meeting_events(docs))
    assert sorted(rows(kos.select("id", "title", "statement", "confidence"))) == sorted(rows(apart.select("id", "title", "statement", "confidence")))
    assert X.link_people_projects(docs).count() == 2


def test_header_values_are_cleaned_once(spark):
    values = ["", " ", "[", "]", "[]", '"', "''", "[ a ]", '["a", b]', "a]]", 'a]"', '"[a', "a\" ", ' "a b" ', '"""', "[['x']]", "x\t", "é: y"]
    clean = lambda v: re.sub(r"^[\"']|[\"']$", "", re.sub(r"^\[|\]$", "", v.strip()))
    items = lambda v: [i for i in (re.sub(r"^[\"']|[\"']$", "", x.strip()) for x in clean(v).split(",")) if i]
    text = lambda v: f"---\r\n\nproject: no\r\n people: no\npeople:{v}\r\n2x: no\nproject:{v}\n---\n \n\n body {v}\n---\nproject: no\n"
    raw = [(f"v/{i}.md", text(v)) for i, v in enumerate(values)] + [("v/n.md", "project: no\n---\n"), ("v/o.md", "---\nproject: no\n--")]
    got = {r.path: r for r in N.parse_notes(spark.createDataFrame(raw, "path string, text string"), dt.date(2020, 1, 1)).collect()}
    for i, v in enumerate(values):
        r, raw_value = got[f"v/{i}.md"], v.lstrip(" \t")
        assert (r.project, r.people, r.metadata) == (clean(v) or None, items(v), {"project": raw_value, "people": raw_value}), v
        assert r.body == f"body {v}\n---\nproject: no"
    assert [(got[p].body, got[p].metadata, got[p].project) for p in ("v/n.md", "v/o.md")] == \
        [("project: no\n---", {}, None), ("---\nproject: no\n--", {}, None)]
    days = {"2001-07-15": "2001-07-15", "2001-07-15T10:00": "2001-07-15", "'2001-07-15'": "2001-07-15", "2001-7-15": None, "2001-02-30": None, "x": None}
    raw = [(f"{i}.md", f"---\ndate: {d}\n---\n") for i, d in enumerate(days)]
    got = N.parse_notes(spark.createDataFrame(raw, "path string, text string"), dt.date(2020, 1, 1)).collect()
    assert [str(r.date) for r in sorted(got, key=lambda r: r.path)] == [d or "2020-01-01" for d in days.values()]
    paths = {"a.md": True, "x/templates/a.md": False, "templates\\a.md": False, "x/mytemplates/a.md": True, "README.md": False, "v/README.md": False,
             "v/xREADME.md": True, "v/_a.md": False, ".md": False, "v/.a.md": False, "_v/a.md": True, "v/a.md/": False, "a.mdx": False, "templates.md": True}
    tested = spark.createDataFrame([(p,) for p in paths], "path string").select("path", N.is_note(F.col("path")).alias("ok"), TX.infer_doc_type(F.col("path")).alias("t"))
    assert {r.path: r.ok for r in tested.collect()} == paths
    kinds = {"v/Meetings/a": "meeting", "meetings": "meeting", "x\\decisions\\a": "decision", "PAPERS/a": "paper", "a/research": "paper", "mypapers/a": "note"}
    typed = spark.createDataFrame([(p,) for p in kinds], "path string").select("path", TX.infer_doc_type(F.col("path")).alias("t"))
    assert {r.path: r.t for r in typed.collect()} == kinds
    plan = N.parse_notes(spark.createDataFrame(raw, "path string, text string"), dt.date(2020, 1, 1))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_") + plan.count("split(") <= 20  # 61 when every test of a value made it anew


def test_scan_notes_reads_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.md").write_text(NOTE, encoding="utf-8")
    (tmp_path / "README.md").write_text("# no", encoding="utf-8")
    assert [r["title"] for r in N.scan_notes(spark, str(tmp_path), dt.date(2020, 1, 1)).collect()] == ["Reunión clínica"]


def test_scan_files_reads_only(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.txt").write_bytes("mañana".encode() + b"\xff")
    (root / "p.html").write_text("<style>x</style><h1>T&#233; &amp; caf&eacute;</h1><p>uno</p>", encoding="utf-8")
    (root / "i.jpg").write_bytes(b"123")
    got = {r["path"].rsplit("/", 1)[1]: r["body"] for r in FS.scan_files(spark, str(root)).collect()}
    assert got == {"a.txt": "mañana�", "p.html": "Té & café\nuno"}
    assert sorted(p.name for p in root.iterdir()) == ["a.txt", "i.jpg", "p.html"]


def test_character_references_need_their_semicolon(spark):
    pages = {1: "<h1>a&amp</h1><p>b &amp; c &copy d</p>", 2: "x&#233;y &amp z &ampx; &Eacute;&#39", 3: "&am &lt;&amp;lt;"}
    got = {r.id: r.text for r in FS.html_to_text(spark.createDataFrame(list(pages.items()), "id long, html string")).collect()}
    assert got == {1: "a&amp\nb & c &copy d", 2: "xéy &amp z &ampx; É&#39", 3: "&am <&lt;"}


def test_priority_filter_scores_mail_once(spark):
    mail = spark.createDataFrame([(f"m{i}", "Ana <a@x.org>", subject, "favor confirmar", [], None) for i, subject in enumerate(["urgente", "x"])],
                                 "id string, `from` string, subject string, snippet string, labels array<string>, date timestamp")
    senders = spark.createDataFrame([("ana", "ana", 3, True)], "sender string, person string, degree long, is_pinned boolean")
    scored = M.score_mail(mail, senders, dt.datetime(2020, 1, 1))
    assert sorted((r.id, r.priority) for r in scored.collect()) == [("m0", 1), ("m1", 1)]
    alone = M.score_mail(mail, senders.where("false"), dt.datetime(2020, 1, 1))
    assert sorted((r.id, r.priority) for r in alone.collect()) == [("m0", 2), ("m1", 4)]
    plan = scored.where("priority <= 2").select("subject")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 4  # one for the name of the sender, three for the score


def test_positions_and_lag_with_one_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"),
                                  (F.col("id") * 7919 % 5003).alias("v"))
    ranked = S.with_position(df, [F.desc("v")], "rank")
    got = rows(ranked.select("rank", "v").orderBy("rank"))
    values = sorted((r["v"] for r in df.collect()), reverse=True)
    assert got == list(enumerate(values, 1))
    prev = {(r["g"], r["v"]): r["p"] for r in S.with_previous(df, "g", ["v"], "v", "p").collect()}
    by = {}
    for r in df.collect():
        by.setdefault(r["g"], []).append(r["v"])
    for g, vs in by.items():
        vs.sort()
        assert [prev[(g, v)] for v in vs] == [None] + vs[:-1]


@pytest.mark.parametrize("chars", [S.AUTOMATON_CHARS, 0])
def test_contains_pairs_equals_brute_force(spark, monkeypatch, chars):
    monkeypatch.setattr(S, "AUTOMATON_CHARS", chars)
    hays = ["Mariana", "Ana", "ana maria", "x", "", "aaaa", "banana"]
    needles = ["ana", "Ana", "a", "aa", "", "Mariana Lopez", "x"]
    h, n = spark.createDataFrame([(x,) for x in hays], "h string"), spark.createDataFrame([(x,) for x in needles], "n string")
    want = {(a, b) for a in hays for b in needles if a and b and b in a}
    assert set(rows(S.contains_pairs(h, n))) == want
    both = {(a, b) for a in hays for b in needles if a and b and (b in a or a in b)}
    got = rows(S.either_way_pairs(h, n))
    assert set(got) == both and len(got) == len(both)


@pytest.mark.parametrize("chars", [S.AUTOMATON_CHARS, 0])
def test_substring_hits_equals_brute_force(spark, monkeypatch, chars):
    monkeypatch.setattr(S, "AUTOMATON_CHARS", chars)
    texts = [("1", "la casa blanca"), ("2", "casamiento, caso"), ("3", "nada")]
    needles = ["cas", "blan", "nada", "o"]
    got = set(rows(S.substring_hits(spark.createDataFrame(texts, "id string, text string"), spark.createDataFrame([(x,) for x in needles], "n string"))))
    assert got == {(i, n) for i, t in texts for n in needles if n in t}


def _area_dim(spark):
    return A.load_area_dim(spark.createDataFrame(
        [(0, "a", "A", ["Salud"], ["Ana"], ["RHC"]), (1, "b", "B", ["salud", "datos"], [], []), (2, None, "C", [], [], [])],
        "map_order int, id string, name string, keywords array<string>, people array<string>, projects array<string>"))


def test_area_precedence_ties_and_large_dictionary(spark):
    docs = spark.createDataFrame([("1", "salud", [], None), ("2", "salud y datos", [], None), ("3", "nada", ["Mariana"], None),
                                  ("4", "nada", [], "rhc 2"), ("5", "nada", [""], None)],
                                 "id string, t string, people array<string>, project string")
    want = [("1", "a"), ("2", "b"), ("3", "a"), ("4", "a"), ("5", None)]
    small = A.classify_area(docs, _area_dim(spark), F.col("t")).select("id", "area")
    assert sorted(rows(small)) == want
    many = spark.range(5000).selectExpr("int(id) + 10 AS map_order", "concat('z', id) AS id", "concat('Z', id) AS name", "array(concat('zz', id)) AS keywords",
                                        "array() AS people", "array() AS projects")
    large = A.classify_area(docs, _area_dim(spark).unionByName(A.load_area_dim(many)), F.col("t")).select("id", "area")
    assert sorted(rows(large)) == want


def test_scalars(spark):
    one = spark.createDataFrame([('"Ana Paz" <a@x.com>', "b@x.com", "31/02/2020", "05-03-2020", " x, ,y")], "a string, b string, c string, d string, e string")
    r = one.select(TX.sender_name(F.col("a")), TX.sender_name(F.col("b")), TX.parse_flexible_date(F.col("c")),
                   TX.parse_flexible_date(F.col("d")).cast("string"), TX.as_list(F.col("e"))).first()
    assert tuple(r) == ("Ana Paz", "b", None, "2020-03-05", ["x", "y"])
    names = spark.createDataFrame([("O'Brien",), ("McKay",), ("ana",), ("Ana",)], "n string")
    assert rows(names.select(TX.is_title_case(F.col("n")))) == [("O'Brien".istitle(),), ("McKay".istitle(),), (False,), (True,)]


def test_triage_rules(spark):
    schema = "id string, account string, `from` string, `to` string, subject string, date timestamp, snippet string, labels array<string>, body string"
    now = dt.datetime(2026, 8, 12, 12)
    mail = spark.createDataFrame([
        ("1", "a", "Ana Paz <a@x>", "", "hoy firma", now - dt.timedelta(hours=1), "favor", [], ""),
        ("2", "a", "news@x", "", "newsletter", now - dt.timedelta(days=3), "", ["CATEGORY_PROMOTIONS"], ""),
        ("3", "a", "Mariana <m@x>", "", "hola", None, "", None, "")], schema)
    ents = spark.createDataFrame([("e1", "Ana", "person"), ("p", "P", "project")], "id string, name string, entity_type string")
    edges = spark.createDataFrame([("e1", "p"), ("e1", "e1")], "source_id string, target_id string")
    pinned = spark.createDataFrame([("Paz",)], "name string")
    got = {r["id"]: (r["score"], r["priority"]) for r in M.triage_mail(mail, ents, edges, pinned, now).collect()}
    assert got == {"1": (30 + 44 + 25 + 15 + 10, 1), "2": (-45, 5), "3": (44, 2)}


def test_transcript_chat_and_slack(spark, tmp_path):
    lines = "WEBVTT\n1\n00:01:02.000 --> x\nBea: uno\nAna: dos\nAna: tres\nIDEA: no\n"
    t = spark.createDataFrame([("t", i, x) for i, x in enumerate(lines.split("\n"))], "id string, line_no int, line string")
    p = CV.parse_transcript(t).first()
    assert (p["people"], p["speaker_lines"]) == (["Ana", "Bea"], 4)
    assert CV.detect_transcript(CV.parse_transcript(t)).first()["is_transcript"]
    f = spark.createDataFrame([("d/notes.txt", dt.datetime(2026, 1, 2), lines)], "path string, mtime timestamp, body string")
    d = FS.normalise_file_doc(f, "desk").first()
    assert (d["doc_type"], d["people"], d["body"].split("\n")[0]) == ("meeting", ["Ana", "Bea"], "Bea: uno")
    chat = spark.createDataFrame([("c", 1, "12/08/26, 09:14 - Rita: hola"), ("c", 2, "[13/8/2026 9:15:10] Raúl: qué: tal"), ("c", 3, "31/02/26, 09:14 - R: x"),
                                  ("c", 4, "12/08/26, 09:16 - Rita: <Media omitted>"), ("c", 5, "suelta")], "chat string, seq int, line string")
    got = sorted((str(r["date"]), r["author"], r["message"]) for r in CV.parse_chat_log(chat).collect())
    assert got == [("2026-08-12", "Rita", "hola"), ("2026-08-13", "Raúl", "qué: tal")]
    assert CV.chat_days_to_docs(CV.parse_chat_log(chat), "whatsapp").count() == 2
    ch = tmp_path / "general"
    ch.mkdir()
    (ch / "2026-08-12.json").write_text(json.dumps([{"user": "U1", "text": "a", "ts": "1.0"}, {"user": "U9", "text": "b", "ts": "2.0"}, {"text": "x", "subtype": "join"}]))
    (tmp_path / "users.json").write_text(json.dumps([{"id": "U1", "name": "u", "profile": {"real_name": "Real"}}]))
    m, u = CV.scan_slack(spark, str(tmp_path))
    assert sorted(r["author"] for r in CV.parse_slack_messages(m, u).collect()) == ["Real", "U9"]


def test_a_chat_day_is_one_document(spark):
    """Whatever ``seq`` counts, and however long ago the day is."""
    rows = [("c", 86_400.0 * d + 40_000 * i, dt.date(2026, 1, 1) + dt.timedelta(days=d), "A", f"m{i}") for d in range(200) for i in range(3)]
    m = spark.createDataFrame(rows, "chat string, seq double, date date, author string, message string")
    docs = CV.chat_days_to_docs(m, "slack").collect()
    assert len(docs) == 200 and all(d["metadata"]["messages"] == "3" for d in docs)
    assert docs[0]["body"].endswith("A: m0\nA: m1\nA: m2")
    assert CV.chat_days_to_docs(m, "slack", 120).count() == 120


def test_copies_behind_a_reused_id(spark):
    """A copy does not pass because its id also stands on another text; rows delivered twice count once."""
    rows = [("0", "x"), ("a", "x"), ("a", "y"), ("b", "z"), ("b", "z"), ("c", "y")]
    got = TB.keep_first_by_hash(spark.createDataFrame(rows, "id string, body string")).collect()
    assert sorted((r["id"], r["body"]) for r in got) == [("0", "x"), ("a", "y"), ("b", "z")]


def test_the_last_incoming_row_stays(spark):
    kos = lambda rows: spark.createDataFrame(rows, "id string, title string, n long")
    got = TB.upsert_kos(kos([("k", "old", 0)]).drop("n"), kos([("k", "a", 1), ("k", "b", 2)]), "n").collect()
    assert [(r["id"], r["title"]) for r in got] == [("k", "b")]


def test_hits_of_other_types_do_not_hide_a_decision(spark):
    rows = [(f"t{i}", "task", "pedido pedido", "pedido", "active") for i in range(40)] + [("d", "decision", "un pedido", "algo largo que dice pedido", "active")]
    kos = spark.createDataFrame(rows, "id string, ko_type string, title string, statement string, status string").selectExpr(
        "*", "date'2026-01-01' AS date", "array('A') AS people", "'P' AS project", "'x' AS area", "'s' AS source_doc")
    asked = spark.createDataFrame([("q", "qué decidimos del pedido")], "query_id string, text string")
    assert [r["id"] for r in R.best_text_decision(kos, asked).collect()] == ["d"]
    docs = spark.createDataFrame([], "id string, title string, body string, date date, doc_type string")
    got = PK.gather_material(asked, kos, docs).where("section = 'decisions'").collect()
    assert [r["item_id"] for r in got] == ["d"]


def test_long_citations_stay_whole(spark):
    body = "1. Perez K, " + "palabra " * 80 + "2001 fin"
    r = C.extract_references(spark.createDataFrame([("d", body)], "id string, body string")).first()
    assert r["raw"] == body[3:] and r["year"] == "2001"


def test_mail_dates(spark):
    d = spark.createDataFrame([("Wed, 12 Aug 2026 09:14:00 -0400",), ("12 Aug 2026 09:14:00 GMT (UTC)",), ("nope",)], "d string")
    assert [r[0] for r in d.select(F.date_format(AC.mail_time(F.col("d")), "yyyy-MM-dd HH:mm")).collect()] == ["2026-08-12 13:14", "2026-08-12 09:14", None]


def test_bibtex_and_plan(spark):
    text = '@article{k1,\n title={El {Gran} título.}, author = "A and B", year={(2020)}, doi={https://doi.org/10.1/x}}\n@book{k2, title={Dos}}'
    e = RF.scan_bibtex(spark.createDataFrame([("f", text)], "id string, text string"))
    docs = {r["path"]: r for r in RF.normalise_reference(e).collect()}
    assert docs["zotero://k1"]["title"] == "El Gran título" and docs["zotero://k1"]["metadata"]["doi"] == "10.1/x"
    assert str(docs["zotero://k2"]["date"]) == "1900-01-01"
    cells = [("Portada", 1, ["", "Actividades Detalladas", "ver hoja"]), ("Det", 1, ["ACTIVIDADES DEL PLAN"]),
             ("Det", 2, ["Fase", "Sem.", "Actividad", "Responsable", "Entregable", "Estado", "Prioridad"]),
             ("Det", 3, ["F1", "S1", "Buscar", "IP", "Lista", "Completado", "Alta"]), ("Det", 4, ["F2", "S9", "Probar", "IP + P", None, "Pendiente", "Crítica"]),
             ("Det", 5, ["", "", "FASE DOS FINAL", None, None, None, None]), ("Det", 6, ["F2"])]
    sheets = spark.createDataFrame([("f", s, r, c) for s, r, c in cells], "file string, sheet string, row int, cells array<string>")
    starts = spark.createDataFrame([("f", dt.date(2026, 4, 6))], "file string, plan_start date")
    plan = PS.pick_best_sheet(PS.scan_plan_rows(sheets, starts))
    got = sorted((r["activity"], str(r["due"]), r["status"], r["week"]) for r in plan.collect())
    assert got == [("Buscar", "2026-04-12", "done", 1), ("Probar", "2026-06-07", "active", 9)]
    assert [r["due"] for r in PS.scan_plan_rows(sheets).collect()] == [None, None]
    meta = spark.createDataFrame([("f", "d", dt.date(2026, 1, 1), "tesis", "Tesis", ["Luz"], "x")],
                                 "file string, doc_id string, doc_date date, project_id string, project string, people array<string>, area string")
    tasks = {r["title"]: r for r in PS.import_plan_tasks(plan, meta).collect()}
    assert tasks["Buscar"]["people"] == ["Luz"] and tasks["Probar"]["people"] == []


def test_citations_against_brute_force(spark):
    body = ("1. Garcia A, et al. Modelo de captura de datos. Revista. 2021; doi 10.1000/AB1.\n2) Perez B. Otro estudio muy distinto de todo. 2020\n"
            "3. Lopez C. Guia rara sin registro alguno. 2019\nver 10.1000/ab1 y 10.9/no y 10.1000/zz9.")
    refs = C.extract_references(spark.createDataFrame([("d", body)], "id string, body string"))
    works = spark.createDataFrame([("10.1000/ab1", "Modelo de captura", "Garcia", "2021"), ("10.1000/w2", "Otro estudio muy distinto", "Perez", "2020"),
                                   ("10.1000/w3", "Zzzz qqqq", "Lopez", "2019")], "doi string, title string, family string, year string")
    got = {r["raw"][:6]: (r["verdict"], r["work_doi"]) for r in C.verify_references(refs, works).collect()}
    assert got["Garcia"] == ("verificado", "10.1000/ab1") and got["Perez "] == ("verificado", "10.1000/w2")
    assert got["Lopez "][0] == "discrepancia"
    assert got["10.100"] == ("no_encontrado", None) and len(got) == 4


def test_folder_verdicts(spark):
    now = dt.datetime(2026, 8, 1)
    files = ([("r", "Salud", "", f"doc{i}.docx", 10, now) for i in range(7)] + [("r", "Fotos", "", f"i{i}.jpg", 10, now) for i in range(30)]
             + [("r", "Viejo", "", f"v{i}.txt", 10, now - dt.timedelta(days=400)) for i in range(3)] + [("r", "Viejo", "node_modules", "x.txt", 1, now)])
    df = spark.createDataFrame(files, "root string, folder string, subpath string, name string, size long, mtime timestamp")
    got = {r["folder"]: (r["verdict"], r["score"]) for r in D.score_folders(D.folder_stats(df, _area_dim(spark), now.date())).collect()}
    assert got == {"Salud": ("conectar", 7 + 21 + 25), "Fotos": ("ignorar", 0), "Viejo": ("revisar", 3)}


def test_vector_blocks_are_exact(spark):
    vecs = spark.range(200).select(F.concat(F.lit("v"), "id").alias("id"), F.array(*[F.sin(F.col("id") * (i + 1)) for i in range(8)]).alias("embedding"))
    asked = vecs.select(F.col("id").alias("query_id"), "embedding")
    one = sorted(rows(R.vector_topk(vecs, asked, 3).select("query_id", "rank", "id")))
    small = R.vector_topk(vecs, asked, 3, data_rows=30, block_rows=32)
    assert sorted(rows(small.select("query_id", "rank", "id"))) == one
    zero = spark.createDataFrame([("q", [0.0] * 8)], "query_id string, embedding array<double>")
    assert [r["similarity"] for r in R.vector_topk(vecs, zero, 2).collect()] == [None, None]


def test_dedup_is_idempotent(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y")], "id string, body string")
    first = TB.dedup_documents(docs)
    assert sorted(r["id"] for r in first.collect()) == ["a", "c"]
    assert TB.dedup_documents(docs, first).count() == 0


def test_enrichment_labels_areas_and_keeps_stored_entities(spark):
    docs = spark.createDataFrame([("d1", "p1", "salud", "x"), ("d2", "p2", "nada", "y")], "id string, path string, title string, body string").selectExpr(
        "*", "'note' AS doc_type", "date'2026-01-01' AS date", "array('Rita') AS people", "array() AS organizations", "'P' AS project",
        "array() AS tags", "map('a', 'b') AS metadata", "string(null) AS area")
    output = json.dumps({"knowledge_objects": [{"ko_type": "task", "title": "t" * 150, "statement": "s"}], "entities": [{"name": "Rita", "entity_type": "person"}],
                         "relationships": []})
    outputs = spark.createDataFrame([("d1", output)], "id string, output string")
    rita = X.entity_id(F.lit("Rita"), F.lit("person"))
    stored = spark.range(1).select(rita.alias("id"), F.lit("Rita").alias("name"), F.lit("person").alias("entity_type"), F.array(F.lit("Ri")).alias("aliases"))
    old = X.normalise_extractor_output(outputs, docs)
    for _ in range(2):
        got = X.replace_with_enriched(docs, old[0], old[2], stored, outputs, "Model", _area_dim(spark))
        assert [(r["area"], len(r["title"])) for r in got["kos"].collect()] == [("a", 150)]
        assert sorted((r["id"], r["area"]) for r in got["documents"].collect()) == [("d1", "a"), ("d2", None)]
        assert [r["aliases"] for r in got["entities"].where("name = 'Rita'").collect()] == [["Ri"]]
        old = (got["kos"], None, got["relationships"])


def test_names_are_looked_up_inside_their_document(spark):
    """The last listing of a name counts, unknown and null ends are dropped, and few shuffles are planned."""
    kind = "source_doc string, " + X.EXTRACTOR_OUTPUT
    rel = lambda s, t, k=None: (s, t, k)
    rows = [("a", None, [("Ana", "person"), ("P", None), ("Ana", "project"), (None, "x")], [rel("Ana", "P", "leads"), rel("Ana", "P", "leads"), rel("Ana", "B"), rel(None, "P")]),
            ("b", None, [("B", "person")], [rel("B", "B"), rel("Ana", "B")]), ("c", None, None, [rel("B", "B")]), ("d", None, [("B", "x")], None),
            ("e", None, [("B", None)], [rel("B", "B")])]
    dates = spark.createDataFrame([(x, dt.date(2026, 1, 1)) for x in "abcd"] + [("a", dt.date(2026, 1, 1))], "source_doc string, date date")
    edges = X.remap_extracted_ids(spark.createDataFrame(rows, kind), dates)
    ent = lambda n, k: spark.range(1).select(X.entity_id(F.lit(n), F.lit(k))).first()[0]
    got = sorted((r.source_doc, r.source_id, r.target_id, r.rel_type) for r in edges.collect())
    assert got == [("a", ent("Ana", "project"), ent("P", "concept"), "leads"), ("b", ent("B", "person"), ent("B", "person"), "related_to")]
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") <= 2


def test_a_task_that_left_the_plan_leaves_the_table(spark):
    row = "file string, sheet string, row int, activity string, phase string, week int, start date, due date, status string, responsible string, deliverable string, priority string"
    plans = spark.createDataFrame([("f", "doc-f", dt.date(2026, 1, 1), "p", "P", ["Ana"], "a")],
                                  "file string, doc_id string, doc_date date, project_id string, project string, people array<string>, area string")
    line = lambda n, name: ("f", "s", n, name, "F1", n, None, None, "active", None, None, "Alta")
    edges = spark.createDataFrame([], "id string, source_doc string")
    kos = PS.import_plan_tasks(spark.createDataFrame([line(1, "uno"), line(2, "dos")], row), plans)
    for _ in range(2):
        kos, _ = PS.replace_plan(kos, edges, spark.createDataFrame([line(1, "uno"), line(3, "tres")], row), plans)
        assert sorted(r["title"] for r in kos.collect()) == ["tres", "uno"]
