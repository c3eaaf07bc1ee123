"""Expected results for lookups, ranked search, packs, dossiers, vectors and enrichment."""

from .base import AS_OF, CTES, with_
from .memory import ent

SQL: dict[str, str] = {}

CTES["bench_q"] = ([], "SELECT CAST(item_id AS VARCHAR) AS query_id, text FROM benchmark")
CTES["questions"] = ([], """
    SELECT n_name || '|' || c_mktsegment AS query_id, n_name, c_mktsegment AS segment, who, kind,
      CASE kind WHEN 0 THEN '¿Qué decidimos sobre ' || lower(c_mktsegment) || '?' WHEN 1 THEN '¿Quién trabaja con ' || who || '?'
        WHEN 2 THEN '¿Qué tareas pendientes tengo con ' || n_name || ' de ' || lower(c_mktsegment) || '?'
        WHEN 3 THEN '¿Cuándo fue la última entrega de ' || lower(c_mktsegment) || '?'
        WHEN 4 THEN '¿Qué debería discutir con ' || who || '?' ELSE 'resumen ' || lower(c_mktsegment) || ' urgente pedido' END AS text
    FROM (SELECT n_name, c_mktsegment, min(c_name) AS who, any_value(n_nationkey % 6) AS kind
          FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment)""")


def bm25(prefix: str, base: str, text: str, queries: str, deps: list[str]) -> None:
    """Registers ``<prefix>_hits``: (query_id, id, score, rank)."""
    CTES[f"{prefix}_toks"] = (deps, f"""
        SELECT id, regexp_extract_all(strip_accents(lower({text})), '[\\p{{L}}\\p{{N}}]+') AS toks FROM {base}""")
    CTES[f"{prefix}_terms"] = (deps, f"""
        SELECT query_id, strip_accents(lower(w)) AS term, count(*) AS qf FROM (
          SELECT query_id, unnest(string_split(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')) AS w FROM {queries})
        WHERE length(w) > 2 GROUP BY ALL""")
    CTES[f"{prefix}_post"] = ([f"{prefix}_toks"], f"""
        SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(toks) AS dl, unnest(toks) AS term FROM {prefix}_toks) GROUP BY id, term""")
    CTES[f"{prefix}_hits"] = ([f"{prefix}_post", f"{prefix}_terms"], f"""
        SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
          SELECT query_id, p.id, round(sum(qf * idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
          FROM {prefix}_post p JOIN {prefix}_terms q USING (term)
          JOIN (SELECT term, greatest(ln((n - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf
                FROM {prefix}_post, (SELECT count(*)::DOUBLE AS n FROM {prefix}_toks) GROUP BY term, n) USING (term),
               (SELECT avg(len(toks)) AS avgdl FROM {prefix}_toks) GROUP BY query_id, p.id)""")


bm25("d", "docs", "title || ' ' || body", "bench_q", ["docs", "bench_q"])
bm25("k", "kos", "title || ' ' || statement", "questions", ["kos", "questions"])

SQL["filter_kos"] = with_("kos", """
SELECT id, CAST(date AS VARCHAR) AS date, project FROM kos WHERE ko_type = 'task' AND status = 'active'
AND contains(lower(project), 'nation_1') AND contains(lower(person), 'customer#')""")
SQL["date_windows"] = with_("kos", f"""
SELECT ko_type, count(*) FILTER (date BETWEEN {AS_OF} AND {AS_OF} + 7) AS next_7d, count(*) FILTER (date BETWEEN {AS_OF} AND {AS_OF} + 14) AS next_14d,
  count(*) FILTER (date BETWEEN {AS_OF} AND {AS_OF} + 3) AS horizon_3d, count(*) FILTER (date >= {AS_OF} - 7) AS last_7d,
  count(*) FILTER (date >= {AS_OF} - 14) AS last_14d, count(*) FILTER (date >= {AS_OF} - 30) AS last_30d,
  count(*) FILTER (date <= {AS_OF} - 30) AS older_30d, count(*) FILTER (date < {AS_OF}) AS overdue FROM kos GROUP BY ko_type""")
SQL["list_documents"] = with_("docs", "SELECT id, CAST(date AS VARCHAR) AS date, path FROM docs ORDER BY docs.date DESC, id LIMIT 100")
SQL["find_entities"] = with_("entities", "SELECT id, name, entity_type FROM entities WHERE contains(lower(coalesce(alias, name)), 'plan nation_1')")
SQL["list_entities"] = with_("entities", "SELECT id, name FROM entities WHERE entity_type = 'organization'")
SQL["timeline"] = with_("kos", "SELECT id, CAST(date AS VARCHAR) AS date, title FROM kos WHERE ko_type = 'event'")
SQL["dated_lists"] = with_("kos", "SELECT id, CAST(date AS VARCHAR) AS date, status, statement, person AS who FROM kos WHERE ko_type = 'decision'")
SQL["digest_docs"] = with_("docs", "SELECT id, title, path, doc_type, CAST(date AS VARCHAR) AS date, body[1:240] AS excerpt FROM docs")
SQL["clean_query_terms"] = with_("bench_q", """
SELECT query_id, array_to_string(t, '|') AS terms, len(t) AS n FROM (
  SELECT query_id, list_filter(string_split(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: length(x) > 2) AS t FROM bench_q)""")
SQL["as_list"] = """
SELECT page_id, len(l) AS n, md5(array_to_string(l, '|')) AS digest FROM (
  SELECT page_id, list_filter(list_transform(string_split(html, ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM pages)"""
SQL["infer_doc_type"] = with_("docs", """
SELECT id, CASE source WHEN 'src0' THEN 'meeting' WHEN 'src1' THEN 'decision' WHEN 'src2' THEN 'paper' ELSE 'note' END AS doc_type FROM docs""")
SQL["parse_flexible_date"] = """
SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 4 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders"""
SQL["sender_name"] = with_("mail", "SELECT id, sender AS name FROM mail")

SQL["build_postings"] = with_("d_post", "SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, max(dl) AS longest FROM d_post GROUP BY term")
SQL["bm25_documents"] = with_("d_hits", "SELECT * FROM d_hits WHERE rank <= 5")
SQL["bm25_kos"] = with_("k_hits", "SELECT * FROM k_hits WHERE rank <= 20")
SQL["hits_join"] = with_(["d_hits", "docs"], """
SELECT query_id, rank, path, CAST(date AS VARCHAR) AS date FROM d_hits JOIN docs USING (id) WHERE rank <= 5""")
SQL["topk_retrieval"] = with_("d_hits", "SELECT query_id, rank, id FROM d_hits WHERE rank <= 20")
SQL["term_overlap_search"] = with_(["docs", "bench_q"], """
, qt AS (SELECT query_id, w, count(*) AS n FROM (SELECT query_id,
   unnest(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' ')) AS w FROM bench_q) WHERE length(w) > 2 GROUP BY ALL)
SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, id, sum(n)::BIGINT AS score FROM qt JOIN (SELECT w, id FROM (SELECT DISTINCT w FROM qt)
    JOIN (SELECT id, lower(title || ' ' || body) AS txt FROM docs) ON contains(txt, w)) USING (w) GROUP BY ALL)) WHERE rank <= 5""")
STARTS = """
, st AS (SELECT DISTINCT query_id, lower(w)[1:6] AS p FROM (SELECT query_id, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM questions) WHERE length(w) > 3)
, sh AS (SELECT DISTINCT query_id, k.id, k.date FROM st JOIN kos k ON contains(lower(title || ' ' || statement || ' ' || project || ' ' || person), p))
, ps AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY date DESC, id) AS rank FROM sh)
"""
SQL["prefix_search"] = with_(["kos", "questions"], STARTS.strip() + "\nSELECT query_id, rank, id FROM ps WHERE rank <= 12")
CTES["routed"] = (["questions"], """
    SELECT query_id, kind, who, n_name, text, CASE kind WHEN 0 THEN 'decisional' WHEN 1 THEN 'relational' WHEN 2 THEN 'commitments' WHEN 3 THEN 'episodic'
           WHEN 4 THEN 'strategic' ELSE 'semantic' END AS intent,
           CASE kind WHEN 0 THEN ['decisions','graph','documents'] WHEN 1 THEN ['graph','episodic'] WHEN 2 THEN ['commitments','graph']
           WHEN 3 THEN ['episodic','documents','graph'] WHEN 4 THEN ['graph','decisions','commitments','episodic','documents']
           ELSE ['documents','kos','graph'] END AS plan FROM questions""")
SQL["classify_intent"] = with_("routed", "SELECT query_id, intent, array_to_string(plan, '|') AS memories FROM routed")
CTES["q_ents"] = (["questions", "entities"], """
    SELECT query_id, e.id AS entity_id, e.name, e.entity_type FROM questions q JOIN entities e
    ON (kind IN (1, 4) AND contains(lower(e.name), lower(q.who))) OR (kind = 2 AND contains(lower(e.name), lower(q.n_name)))
    OR (kind = 0 AND contains(lower(e.name), 'qué')) OR (kind = 1 AND contains(lower(e.name), 'quién'))
    OR (kind = 3 AND contains(lower(e.name), 'cuándo'))""")
SQL["query_entities"] = with_("q_ents", "SELECT * FROM q_ents")

bm25("p", "docs", "title || ' ' || body", "(SELECT query_id, text FROM routed WHERE list_contains(plan, 'documents'))", ["docs", "routed"])
CTES["pack_objects"] = (["routed", "q_ents", "kos", "k_hits"], """
    SELECT query_id, section, id, row_number() OVER (PARTITION BY query_id ORDER BY place, pos, id) AS rank FROM (
      SELECT query_id, id, arg_min(section, (place, pos)) AS section, min(place) AS place, arg_min(pos, (place, pos)) AS pos FROM (
        SELECT c.*, s.place, min(source) OVER (PARTITION BY c.query_id, c.section) AS top FROM (
          SELECT query_id, section, id, 0 AS source, row_number() OVER (PARTITION BY query_id, section ORDER BY name, date DESC, id) AS pos FROM (
            SELECT e.query_id, t.section, t.id, t.date, min(e.name) AS name FROM q_ents e JOIN (SELECT * FROM sec_kos) t ON contains(lower(t.person), lower(e.name)) GROUP BY ALL)
          UNION ALL SELECT * FROM (SELECT h.query_id, t.section, h.id, 1, row_number() OVER (PARTITION BY h.query_id, t.section ORDER BY h.rank) AS pos
            FROM k_hits h JOIN sec_kos t USING (id)) WHERE pos <= 20
          UNION ALL SELECT query_id, 'kos', id, 1, rank FROM k_hits WHERE rank <= 20
          UNION ALL SELECT r.query_id, t.section, t.id, 2, t.n FROM routed r, (
            SELECT section, id, row_number() OVER (PARTITION BY section ORDER BY date DESC, id) AS n FROM sec_kos) t WHERE n <= 10) c
        JOIN (SELECT query_id, unnest(list_append(plan, 'questions')) AS section, unnest(range(0, len(plan) + 1)) AS place FROM routed) s
          ON s.query_id = c.query_id AND s.section = c.section)
      WHERE source = top AND (source > 0 OR pos <= 25) GROUP BY query_id, id)""")
CTES["sec_kos"] = (["kos"], """
    SELECT CASE WHEN ko_type = 'decision' THEN 'decisions' WHEN ko_type = 'task' AND status = 'active' THEN 'commitments'
      WHEN ko_type = 'event' THEN 'episodic' WHEN ko_type = 'question' AND status = 'active' THEN 'questions' END AS section, id, date, person
    FROM kos WHERE (ko_type IN ('decision', 'event')) OR (ko_type IN ('task', 'question') AND status = 'active')""")
CTES["pack_objects"] = (["routed", "q_ents", "sec_kos", "k_hits"], CTES["pack_objects"][1])
SQL["context_pack"] = with_(["pack_objects", "p_hits", "q_ents", "edges"], """
SELECT query_id, section, rank, id AS item_id FROM pack_objects WHERE rank <= 25
UNION ALL SELECT query_id, 'documents', rank, id FROM p_hits WHERE rank <= 4
UNION ALL SELECT query_id, 'entities', 0, entity_id FROM q_ents
UNION ALL SELECT DISTINCT query_id, 'relationships', 0, e.id FROM q_ents q JOIN edges e ON e.source_id = q.entity_id OR e.target_id = q.entity_id""")
SQL["pack_caps"] = with_("pack_objects", """
SELECT query_id, count(*) AS n, max(rank) AS last FROM pack_objects WHERE rank <= 25 GROUP BY query_id""")
SQL["merge_pack_sections"] = with_(["kos", "questions", "k_hits"], STARTS.strip() + """
SELECT query_id, section, rank, id FROM (
  SELECT query_id, section, id, row_number() OVER (PARTITION BY query_id ORDER BY place, pos, id) AS rank FROM (
    SELECT query_id, id, arg_min(section, place) AS section, min(place) AS place, arg_min(pos, place) AS pos FROM (
      SELECT query_id, id, 'kos' AS section, 0 AS place, rank AS pos FROM k_hits WHERE rank <= 20
      UNION ALL SELECT query_id, id, 'starts', 1, rank FROM ps WHERE rank <= 12) GROUP BY query_id, id)) WHERE rank <= 25""")
CTES["topics"] = (["questions"], """
    SELECT query_id, CASE n_nationkey % 3 WHEN 0 THEN 'entrega ' || lower(segment) WHEN 1 THEN 'pedidos' ELSE 'nada' END AS text,
           CASE WHEN n_nationkey % 5 > 1 THEN r_name END AS wish
    FROM questions q JOIN nation n ON n.n_name = q.n_name JOIN region ON n_regionkey = r_regionkey""")
bm25("tk", "kos", "title || ' ' || statement", "topics", ["kos", "topics"])
bm25("td", "docs", "title || ' ' || body", "topics", ["docs", "topics"])
SQL["gather_material"] = with_(["tk_hits", "td_hits", "kos", "docs", "topics"], """
, st AS (SELECT DISTINCT query_id, wish, lower(w)[1:6] AS p FROM (SELECT query_id, wish, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM topics) WHERE length(w) > 3)
, items AS (
   SELECT id, date, area, CASE ko_type WHEN 'decision' THEN 'decisions' WHEN 'task' THEN 'tasks' WHEN 'event' THEN 'events' ELSE 'questions' END AS section,
          statement AS text, lower(title || ' ' || statement || ' ' || project) AS haystack FROM kos WHERE ko_type IN ('decision', 'task', 'event', 'question')
   UNION ALL SELECT id, date, CASE split_part(path, '/', 2) WHEN 'en' THEN 'AMERICA' WHEN 'fr' THEN 'EUROPE' WHEN 'de' THEN 'ASIA' WHEN 'es' THEN 'AFRICA' END,
          'documents', body[1:600], lower(title || ' ' || body) FROM docs)
, txt AS (SELECT query_id, section, id, rank AS ord FROM (FROM tk_hits UNION ALL FROM td_hits) JOIN items USING (id) JOIN topics USING (query_id)
   WHERE wish IS NULL OR wish = area)
, sta AS (SELECT DISTINCT query_id, section, id, DATE '1970-01-01' - date AS ord FROM st JOIN items ON contains(haystack, p) AND (wish IS NULL OR wish = area)
   WHERE NOT EXISTS (SELECT 1 FROM txt WHERE txt.query_id = st.query_id AND txt.section = items.section))
, hits AS (FROM txt UNION ALL FROM sta)
, rec AS (SELECT query_id, section, id, row_number() OVER (PARTITION BY query_id, section ORDER BY date DESC, id) AS ord FROM topics t JOIN items ON area = wish
   WHERE NOT EXISTS (SELECT 1 FROM hits WHERE hits.query_id = t.query_id AND hits.section = items.section))
SELECT query_id, section, rank, id AS item_id, CAST(date AS VARCHAR) AS date, text FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, section ORDER BY ord, id) AS rank FROM (FROM hits UNION ALL FROM rec)) JOIN items USING (id, section)
WHERE rank <= CASE section WHEN 'documents' THEN 6 ELSE 12 END""")

NEIGH = """
, dec AS (SELECT id, project, date FROM kos WHERE ko_type = 'decision')
, nb AS (SELECT * FROM (
   SELECT a.id, 'before' AS side, b.id AS other_id, row_number() OVER (PARTITION BY a.id ORDER BY b.date DESC, b.id DESC) AS rank
   FROM dec a JOIN dec b ON a.project = b.project AND a.id <> b.id AND b.date <= a.date
   UNION ALL SELECT a.id, 'after', b.id, row_number() OVER (PARTITION BY a.id ORDER BY b.date, b.id)
   FROM dec a JOIN dec b ON a.project = b.project AND b.date > a.date) WHERE rank <= 3)
"""
SQL["decision_neighbours"] = with_("kos", NEIGH.strip() + "\nSELECT id, side, rank, other_id FROM nb")
SQL["same_source_items"] = with_("kos", """
SELECT a.id, b.id AS other_id, b.ko_type FROM kos a JOIN kos b ON a.source_doc = b.source_doc AND a.id <> b.id
WHERE a.ko_type = 'decision' AND b.ko_type IN ('question', 'task')""")
CTES["chosen0"] = (["k_hits", "kos"], """
    SELECT query_id, arg_min(id, rank) AS id FROM k_hits JOIN (SELECT id FROM kos WHERE ko_type = 'decision') USING (id) GROUP BY query_id""")
CTES["chosen"] = (["chosen0", "questions", "kos"], """
    SELECT query_id, id FROM chosen0 UNION ALL SELECT query_id, arg_min(id, (-(date - DATE '1970-01-01'), id)) FROM (
      SELECT DISTINCT query_id, k.id, k.date FROM (SELECT DISTINCT query_id, lower(w)[1:6] AS p FROM (
        SELECT query_id, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM questions) WHERE length(w) > 3) st
      JOIN kos k ON k.ko_type = 'decision' AND contains(lower(title || ' ' || statement || ' ' || project || ' ' || person), p)
      WHERE query_id NOT IN (SELECT query_id FROM chosen0)) GROUP BY query_id""")
CTES["dossier_q"] = (["chosen", "kos"], "SELECT query_id, title AS text FROM chosen JOIN kos USING (id)")
bm25("h", "kos", "title || ' ' || statement", "dossier_q", ["kos", "dossier_q"])
SQL["decision_dossier"] = with_(["chosen", "kos", "docs", "h_hits"], NEIGH.strip() + """
SELECT query_id, 'decision' AS section, 1 AS rank, id AS item_id FROM chosen
UNION ALL SELECT query_id, 'source', 1, source_doc FROM chosen JOIN kos USING (id) WHERE source_doc IN (SELECT id FROM docs)
UNION ALL SELECT query_id, side, rank, other_id FROM chosen JOIN nb USING (id)
UNION ALL SELECT query_id, b.ko_type || 's', 0, b.id FROM chosen c JOIN kos a ON a.id = c.id JOIN kos b ON a.source_doc = b.source_doc AND a.id <> b.id
  WHERE b.ko_type IN ('question', 'task')
UNION ALL SELECT * FROM (SELECT query_id, 'hypotheses', row_number() OVER (PARTITION BY query_id ORDER BY h.rank) AS rank, h.id
  FROM h_hits h JOIN kos k ON k.id = h.id WHERE k.ko_type = 'hypothesis') WHERE rank <= 20""")

SQL["chunk_documents"] = with_("docs", """
, w AS (SELECT id, list_filter(regexp_split_to_array(body, '\\s+'), lambda x: x <> '') AS w FROM docs)
, c AS (SELECT id, n AS ordinal, array_to_string(w[n * 200 + 1 : n * 200 + 200], ' ') AS content
   FROM (SELECT id, w, unnest(range(0, (len(w) + 199) // 200)) AS n FROM w))
SELECT id, ordinal, length(content) AS n_chars, md5(content) AS digest FROM c""")
VEC = "SELECT 'doc-' || vec_id AS id, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"
SQL["vector_topk"] = f"""
WITH v AS ({VEC}),
c AS (SELECT query_id, list(x ORDER BY i) AS q FROM (SELECT CAST(label AS VARCHAR) AS query_id, i, avg(e[i]) AS x
   FROM v, (SELECT unnest(range(1, 1 + (SELECT max(len(embedding)) FROM embeddings))) AS i) GROUP BY label, i) GROUP BY query_id)
SELECT query_id, rank, id, round(s, 6) AS similarity FROM (
  SELECT query_id, id, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank
  FROM (SELECT query_id, id, list_cosine_similarity(q, e) AS s FROM v, c)) WHERE rank <= 10"""
SQL["hybrid_search"] = with_("d_hits", f"""
, v AS ({VEC})
, vh AS (SELECT * FROM (SELECT CAST(a.vec_id AS VARCHAR) AS query_id, b.id,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 9) DESC, b.id) AS rank
    FROM v a JOIN benchmark ON item_id = a.vec_id, v b) WHERE rank <= 20)
SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (
    SELECT query_id, id, rank FROM d_hits WHERE rank <= 20 UNION ALL SELECT query_id, id, rank FROM vh) GROUP BY query_id, id)) WHERE rank <= 10""")

SQL["normalise_extractor_output"] = with_("notes", """
SELECT id AS source_doc, 'fact' AS ko_type, 'Dato ' || id AS title, body AS statement, person AS people, project, 'tentative' AS confidence FROM notes
UNION ALL SELECT id, 'fact', 't', 's', '', 'P', 'probable' FROM notes""")
SQL["remap_extracted_ids"] = with_("notes", f"""
SELECT {ent('person', 'person')} AS source_id, {ent('project', 'concept')} AS target_id, 'leads' AS rel_type, id AS source_doc,
       CAST(date AS VARCHAR) AS valid_from FROM notes""")
SQL["allowed_areas"] = with_("overrides", "SELECT area FROM overrides WHERE status <> 'pausada'")
SQL["pending_enrichment"] = with_(["notes", "overrides"], """
SELECT id, organization AS area FROM notes WHERE doc_type <> 'meeting'
AND organization IN (SELECT area FROM overrides WHERE status <> 'pausada')""")
SQL["replace_with_enriched"] = with_(["notes", "note_kos"], """
, m AS (SELECT id FROM notes WHERE doc_type = 'meeting')
SELECT 'ko:' || ko_type AS what, count(*) AS n FROM (SELECT ko_type FROM note_kos WHERE source_doc NOT IN (SELECT id FROM m)
  UNION ALL SELECT 'fact' FROM m UNION ALL SELECT 'fact' FROM m) GROUP BY 1
UNION ALL SELECT 'rel:participates_in', count(*) FROM notes UNION ALL SELECT 'rel:leads', count(*) FROM m
UNION ALL SELECT 'removed:kos', count(*) FROM note_kos WHERE source_doc IN (SELECT id FROM m)
UNION ALL SELECT 'removed:relationships', count(*) FROM m""")
