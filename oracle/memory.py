"""Expected results for tables, extraction, areas, graph, people and mail."""

from .base import AS_OF, ENT, with_

P_ENT = ENT.format(n="{}", t="'{}'")


def ent(col: str, kind: str) -> str:
    return ENT.format(n=col, t=f"'{kind}'")


SQL: dict[str, str] = {}

SQL["dedup_documents"] = with_("docs", """
SELECT min(id) AS id, arg_min(path, id) AS path, sha256(body) AS body_hash FROM docs GROUP BY body""")
SQL["keep_first_by_hash"] = with_("notes", """
SELECT id, title, CAST(date AS VARCHAR) AS date, sha256(body) AS body_hash FROM notes
WHERE id IN (SELECT min(id) FROM notes GROUP BY body)""")
SQL["upsert_kos"] = with_("kos", """
SELECT ko_type, status, count(*) AS n, count(DISTINCT id) AS ids FROM (
  SELECT id, ko_type, CASE WHEN ko_type = 'task' THEN 'done' ELSE status END AS status FROM kos
  UNION ALL SELECT id || '-bis', ko_type, status FROM kos WHERE ko_type = 'idea') GROUP BY ALL""")
SQL["upsert_entities"] = with_(["entities", "notes"], f"""
SELECT id, name, entity_type FROM entities
UNION ALL SELECT DISTINCT {ent('organization', 'organization')}, organization, 'organization' FROM notes""")
SQL["merge_relationships"] = with_(["edges", "notes"], f"""
SELECT source_id, target_id, rel_type, CAST(valid_from AS VARCHAR) AS valid_from FROM edges""")
SQL["delete_derived"] = with_(["kos", "docs"], """
SELECT CASE WHEN d.id IS NULL THEN 'kos_kept' ELSE 'kos' END AS what, count(*) AS removed
FROM kos k LEFT JOIN (SELECT id FROM docs WHERE source = 'src0') d ON k.source_doc = d.id GROUP BY 1""")
SQL["mark_extractor"] = with_("docs", "SELECT id, 'LineMarks' AS extractor, lang, 3 AS n FROM docs")
SQL["check_domains"] = with_(["kos", "docs"], """
SELECT 'ko_source_doc' AS rule, id FROM kos WHERE source_doc NOT IN (SELECT id FROM docs)""")
SQL["ingest_summary"] = with_(["notes", "note_kos"], """
, kept AS (SELECT * FROM notes WHERE id IN (SELECT min(id) FROM notes GROUP BY body))
SELECT n.source, n.account, coalesce(k.documents, 0) AS documents, n.incoming - coalesce(k.documents, 0) AS skipped,
  coalesce(o.n, 0) AS knowledge_objects, coalesce(k.rel, 0) AS relationships
FROM (SELECT source, organization AS account, count(*) AS incoming FROM notes GROUP BY ALL) n
LEFT JOIN (SELECT source, organization AS account, count(*) AS documents, count(DISTINCT id) AS rel FROM kept GROUP BY ALL) k USING (source, account)
LEFT JOIN (SELECT kept.source, organization AS account, count(*) AS n FROM note_kos JOIN kept ON source_doc = kept.id GROUP BY ALL) o USING (source, account)"""
.replace("\n, kept", ", kept"))
SQL["memory_counts"] = with_(["docs", "kos"], """
SELECT 'documents' AS what, count(DISTINCT body) AS n FROM docs UNION ALL SELECT 'kos', count(*) FROM kos""")

SQL["extract_marked_lines"] = with_("note_kos", """
SELECT source_doc, ko_type, statement AS title, statement, CAST(date AS VARCHAR) AS date, person AS people, project,
       CASE WHEN ko_type = 'decision' THEN 'confirmed' ELSE 'probable' END AS confidence, 'active' AS status, tag AS tags,
       CAST(date AS VARCHAR) AS valid_from FROM note_kos""")
SQL["first_match_wins"] = with_("note_kos", "SELECT ko_type, line_no, count(*) AS n FROM note_kos GROUP BY ALL")
SQL["extract_meeting_events"] = with_("notes", """
SELECT id AS source_doc, 'event' AS ko_type, title, 'Reunión registrada: ' || title AS statement,
       CAST(date AS VARCHAR) AS date, person AS people, project, 'confirmed' AS confidence FROM notes WHERE doc_type = 'meeting'""")
SQL["extract_entities"] = with_("notes", f"""
SELECT DISTINCT {ent('person', 'person')} AS id, person AS name, 'person' AS entity_type FROM notes
UNION ALL SELECT DISTINCT {ent('organization', 'organization')}, organization, 'organization' FROM notes
UNION ALL SELECT DISTINCT {ent('project', 'project')}, project, 'project' FROM notes""")
SQL["link_people_projects"] = with_("notes", f"""
SELECT DISTINCT {ent('person', 'person')} AS source_id, {ent('project', 'project')} AS target_id,
       'participates_in' AS rel_type, CAST(date AS VARCHAR) AS valid_from, id AS source_doc FROM notes""")

SQL["load_area_dim"] = with_("terms", "SELECT map_order, area, kind, term, points FROM terms")
NOTE_LABELS = """
, hay AS (SELECT id, organization, project, source, lower(title || chr(10) || path || chr(10) || body) AS txt FROM notes)
, labels AS (SELECT id, arg_max(area, (score, -map_order)) AS area FROM (
    SELECT h.id, area, map_order, sum(points) AS score FROM hay h JOIN terms
    ON contains(txt, term) OR (kind = 'project' AND contains(lower(project), term)) GROUP BY ALL) GROUP BY id)
"""
SQL["classify_area"] = with_(["notes", "terms"], NOTE_LABELS.strip() + """
SELECT n.id, l.area FROM notes n LEFT JOIN labels l USING (id)""")
SQL["best_of_ties"] = with_(["notes", "terms"], NOTE_LABELS.strip() + """
SELECT n.project, l.area, count(*) AS n FROM notes n LEFT JOIN labels l USING (id) GROUP BY ALL""")
SQL["assign_areas_write"] = with_(["notes", "terms"], NOTE_LABELS.strip() + """
SELECT n.id, n.organization AS old_area, l.area FROM notes n LEFT JOIN labels l USING (id)
WHERE n.organization IS DISTINCT FROM l.area""")
SQL["reclassify_on_change"] = with_(["notes", "terms"], NOTE_LABELS.strip() + """
, terms2 AS (SELECT * FROM terms UNION ALL SELECT 1, 'AMERICA', 'keyword', unnest(['machinery', 'order']), 2)
, labels2 AS (SELECT id, arg_max(area, (score, -map_order)) AS area FROM (
    SELECT h.id, area, map_order, sum(points) AS score FROM hay h JOIN terms2
    ON contains(txt, term) OR (kind = 'project' AND contains(lower(project), term)) GROUP BY ALL) GROUP BY id)
SELECT a.area AS old_area, b.area, count(*) AS n FROM notes LEFT JOIN labels a USING (id) LEFT JOIN labels2 b USING (id)
WHERE a.area IS DISTINCT FROM b.area GROUP BY ALL""")
SQL["ko_inherit_area"] = with_(["kos", "docs", "terms"], """
SELECT k.id, coalesce(CASE WHEN d.source = 'src1' THEN 'EUROPE' END, l.area) AS area
FROM kos k LEFT JOIN docs d ON d.id = k.source_doc LEFT JOIN (
  SELECT id, arg_max(area, (score, -map_order)) AS area FROM (
    SELECT k.id, t.area, map_order, sum(points) AS score FROM kos k JOIN terms t
    ON contains(lower(title || chr(10) || statement || ' en ' || project), term) OR (kind = 'project' AND contains(lower(project), term))
    GROUP BY ALL) GROUP BY id) l ON l.id = k.id""")
SQL["area_counts"] = with_(["kos", "docs"], """
SELECT coalesce(d.area, k.area) AS area, coalesce(d.documents, 0) AS documents, coalesce(k.kos, 0) AS kos,
       coalesce(k.tasks_open, 0) AS tasks_open, coalesce(k.decisions, 0) AS decisions
FROM (SELECT CASE source WHEN 'src1' THEN 'EUROPE' WHEN 'src2' THEN 'ASIA' ELSE '_sin_area' END AS area, count(*) AS documents
      FROM docs GROUP BY 1) d
FULL JOIN (SELECT area, count(*) AS kos, count(*) FILTER (ko_type = 'task' AND status = 'active') AS tasks_open,
      count(*) FILTER (ko_type = 'decision') AS decisions FROM kos GROUP BY 1) k ON d.area = k.area""")
SQL["mail_hits_by_area"] = with_(["triage", "terms", "facts"], """
SELECT area, count(*) AS mail FROM (
  SELECT id, arg_max(area, (score, -map_order)) AS area FROM (
    SELECT t.id, te.area, te.map_order, sum(points) AS score FROM triage t JOIN facts f ON f.o_orderkey = t.o_orderkey
    JOIN terms te ON contains(lower(t.subject || ' acct ' || f.n_name || ' ' || t.sender_header), term)
    WHERE priority <= 2 GROUP BY ALL) GROUP BY id) GROUP BY area""")
SQL["area_signals"] = with_("signals", "SELECT * FROM signals")
SQL["area_score"] = with_("ranked_areas", "SELECT area, score_auto, score, weight::DOUBLE AS weight, status FROM ranked_areas")
SQL["rank_areas"] = with_("ranked_areas", "SELECT rank, area, score, pin, status FROM ranked_areas")
SQL["reason_labels"] = with_("signals", """
SELECT area, coalesce(nullif(concat_ws(' · ', CASE WHEN tasks > 0 THEN tasks || ' tareas' END, CASE WHEN events > 0 THEN events || ' eventos 7d' END,
  CASE WHEN decisions > 0 THEN decisions || ' decis. 14d' END, CASE WHEN questions > 0 THEN questions || ' preguntas' END,
  CASE WHEN mail > 0 THEN mail || ' correo P1-P2' END, CASE WHEN overdue > 0 THEN overdue || ' atrasadas' END), ''), 'sin actividad') AS label
FROM signals""")
SQL["area_cards"] = with_(["ranked_areas", "kos"], """
SELECT r.rank, r.area, r.name, r.score, r.weight::DOUBLE AS weight, r.pin, r.status,
  coalesce(nullif(concat_ws(' · ', CASE WHEN r.tasks > 0 THEN r.tasks || ' tareas' END, CASE WHEN r.events > 0 THEN r.events || ' eventos 7d' END,
  CASE WHEN r.decisions > 0 THEN r.decisions || ' decis. 14d' END, CASE WHEN r.questions > 0 THEN r.questions || ' preguntas' END,
  CASE WHEN r.mail > 0 THEN r.mail || ' correo P1-P2' END, CASE WHEN r.overdue > 0 THEN r.overdue || ' atrasadas' END), ''), 'sin actividad') AS signals_label,
  0 AS documents, count(k.id) AS kos, count(*) FILTER (k.ko_type = 'task' AND k.status = 'active') AS tasks_open,
  count(*) FILTER (k.ko_type = 'decision') AS n_decisions
FROM ranked_areas r LEFT JOIN kos k ON k.area = r.area GROUP BY ALL""")
SQL["note_area_ranking"] = with_(["notes", "note_kos", "terms", "areas", "overrides"], NOTE_LABELS.strip() + f"""
, kept AS (SELECT min(id) AS id FROM notes GROUP BY body)
, objs AS (SELECT l.area, k.ko_type, k.date FROM note_kos k JOIN kept ON kept.id = k.source_doc JOIN labels l ON l.id = k.source_doc
   UNION ALL SELECT l.area, 'event', n.date FROM notes n JOIN kept USING (id) JOIN labels l USING (id) WHERE n.doc_type = 'meeting')
, s AS (SELECT a.map_order, a.id AS area, count(*) FILTER (ko_type = 'task') AS tasks,
   count(*) FILTER (ko_type = 'event' AND date BETWEEN {AS_OF} AND {AS_OF} + 7) AS events,
   count(*) FILTER (ko_type = 'decision' AND date >= {AS_OF} - 14) AS decisions,
   count(*) FILTER (ko_type = 'question') AS questions, 0 AS overdue
   FROM areas a LEFT JOIN objs o ON o.area = a.id GROUP BY ALL)
SELECT row_number() OVER (ORDER BY CASE WHEN o.status = 'pausada' THEN 2 WHEN o.pin IS NOT NULL THEN 0 ELSE 1 END,
   CASE WHEN o.pin IS NOT NULL THEN o.pin END, -(tasks*3 + events*4 + decisions*2 + questions) * o.weight, map_order) AS rank,
   s.area, tasks, events, decisions, questions, overdue,
   round((tasks*3 + events*4 + decisions*2 + questions) * o.weight, 1)::DOUBLE AS score
FROM s JOIN overrides o ON o.area = s.area""")

SQL["node_degree"] = with_("degree", "SELECT id, degree FROM degree")
SQL["edges_of"] = with_(["edges", "pinned"], f"""
SELECT p.id AS node_id, e.id, e.rel_type FROM edges e JOIN (SELECT {ent('name', 'person')} AS id FROM pinned) p
ON e.source_id = p.id OR e.target_id = p.id""")
SQL["edge_names"] = with_(["edges", "entities"], """
SELECT e.id, s.name || ' (person)' AS source_name,
       CASE WHEN t.entity_type = 'project' THEN t.name || ' (project)' ELSE e.target_id END AS target_name
FROM edges e JOIN entities s ON s.id = e.source_id JOIN entities t ON t.id = e.target_id""")
SQL["valid_at"] = with_("edges", f"""
SELECT id, CAST(valid_from AS VARCHAR) AS valid_from, CAST(valid_to AS VARCHAR) AS valid_to FROM edges
WHERE valid_from <= {AS_OF} AND (valid_to IS NULL OR valid_to >= {AS_OF})""")
LINKS = f"""
SELECT {ent('person', 'person')} AS source, id AS target, 'decided' AS type, date AS valid_from FROM kos WHERE ko_type = 'decision'
UNION ALL SELECT id, {ent('project', 'project')}, 'shapes', date FROM kos WHERE ko_type = 'decision'"""
CHAIN = """
SELECT prev AS source, id AS target, 'precedes' AS type, date AS valid_from FROM (
  SELECT id, date, lag(id) OVER (PARTITION BY project ORDER BY date, id) AS prev FROM kos WHERE ko_type = 'decision')
WHERE prev IS NOT NULL"""
SQL["decision_links"] = with_("kos", f"SELECT source, target, type, CAST(valid_from AS VARCHAR) AS valid_from FROM ({LINKS})")
SQL["decision_chain"] = with_("kos", f"SELECT source, target, type, CAST(valid_from AS VARCHAR) AS valid_from FROM ({CHAIN})")
SQL["graph_nodes"] = with_(["entities", "degree", "kos", "pinned"], """
SELECT e.id, e.name, e.entity_type AS type, coalesce(d.degree, 0) AS degree, p.name IS NOT NULL AS pinned, CAST(NULL AS VARCHAR) AS date
FROM entities e LEFT JOIN degree d ON d.id = e.id LEFT JOIN pinned p ON p.name = e.name
UNION ALL SELECT id, title, 'decision', 2, false, CAST(date AS VARCHAR) FROM kos WHERE ko_type = 'decision'""")
SQL["graph_links"] = with_(["edges", "kos"], f"""
SELECT source, target, type, CAST(valid_from AS VARCHAR) AS valid_from, CAST(valid_to AS VARCHAR) AS valid_to FROM (
  SELECT source_id AS source, target_id AS target, rel_type AS type, valid_from, valid_to FROM edges
  UNION ALL SELECT source, target, type, valid_from, NULL FROM ({LINKS}) UNION ALL SELECT source, target, type, valid_from, NULL FROM ({CHAIN}))""")

SQL["person_signals"] = with_("person_signals", """
SELECT name, degree, recent, upcoming, mail, pinned, role, score,
  coalesce(nullif(concat_ws(' · ', CASE WHEN upcoming > 0 THEN upcoming || ' reunión(es) próximas' END,
   CASE WHEN recent > 0 THEN recent || ' menciones 30d' END, CASE WHEN mail > 0 THEN mail || ' correos P1-P2' END,
   CASE WHEN degree > 0 THEN degree || ' relaciones' END), ''), 'sin señales') AS label FROM person_signals""")
SQL["rank_people"] = with_("ranked_people", "SELECT rank, name, score, pinned FROM ranked_people")
SQL["suggest_people"] = with_("person_signals", """
SELECT name, score FROM person_signals WHERE NOT pinned AND score >= 8 ORDER BY score DESC, lower(name), id LIMIT 5""")
SQL["unknown_senders"] = with_(["triage", "pinned"], """
SELECT sender AS name, count(*) AS mails FROM triage WHERE priority <= 3 AND sender NOT IN (SELECT name FROM pinned)
GROUP BY 1 HAVING count(*) >= 2 ORDER BY mails DESC, name LIMIT 5""")
ITEMS = f"""
SELECT DISTINCT p.name, k.id, ko_type, k.date, title, statement FROM kos k JOIN pinned p ON contains(lower(k.person), lower(p.name))
WHERE status = 'active' AND ko_type IN ('event','task','question') AND (ko_type <> 'event' OR k.date BETWEEN {AS_OF} AND {AS_OF} + 14)"""
SQL["person_brief_items"] = with_(["kos", "pinned"], f"""
SELECT name, id, ko_type, CAST(date AS VARCHAR) AS date, title, statement FROM ({ITEMS})""")
SQL["top_items_per_person"] = with_(["kos", "pinned"], f"""
SELECT name, ko_type, rank, id, CAST(date AS VARCHAR) AS date FROM (
  SELECT *, row_number() OVER (PARTITION BY name, ko_type ORDER BY CASE WHEN ko_type = 'event' THEN date - DATE '1970-01-01'
    ELSE DATE '1970-01-01' - date END, id) AS rank FROM ({ITEMS}))
WHERE rank <= CASE ko_type WHEN 'event' THEN 1 WHEN 'task' THEN 4 ELSE 2 END""")

SQL["match_senders"] = with_(["mail", "entities", "degree", "pinned"], """
SELECT lower(s.sender) AS sender, lower(e.name) AS person, CASE WHEN e.id IS NOT NULL THEN coalesce(d.degree, 0) END AS degree,
       p.name IS NOT NULL AS is_pinned
FROM (SELECT DISTINCT sender FROM mail) s LEFT JOIN entities e ON e.name = s.sender AND e.entity_type = 'person'
LEFT JOIN degree d ON d.id = e.id LEFT JOIN pinned p ON p.name = s.sender""")
SQL["triage_mail"] = with_("triage", """
SELECT id, score, priority, coalesce(nullif(why, ''), 'sin señales fuertes') AS reasons FROM triage""")
SQL["rank_mail"] = with_("triage", """
SELECT row_number() OVER (ORDER BY priority, score DESC, id) AS rank, id, priority, score FROM triage""")
SQL["triage_summary"] = with_("triage", "SELECT count(*) AS mails, count(*) FILTER (priority <= 2) AS p1_p2 FROM triage")
SQL["slim_triage"] = with_("triage", """
SELECT id, priority, sender_header AS "from", subject, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, 'acct' AS account,
       coalesce(nullif(why, ''), 'sin señales fuertes') AS reasons, '' AS suggested_action FROM triage""")
