"""Expected results for sources and streams, computed from the columns the texts were made of."""

from .base import AS_OF, CTES, with_

SQL: dict[str, str] = {}
NL = "chr(10)"

CTES["raw_notes"] = (["notes"], """
    SELECT *, 'vault/' || CASE source WHEN 'MACHINERY' THEN 'Papers/' WHEN 'BUILDING' THEN 'templates/' ELSE '' END || id || '.md' AS npath
    FROM notes""")
SQL["scan_notes"] = with_("raw_notes", f"""
SELECT npath AS path, CASE WHEN doc_type = 'meeting' THEN title || ' x' ELSE title END AS title,
  CASE WHEN doc_type = 'meeting' THEN 'meeting' WHEN source = 'MACHINERY' THEN 'paper' ELSE 'note' END AS doc_type,
  CAST(CASE WHEN l_linenumber = 1 THEN {AS_OF} ELSE date END AS VARCHAR) AS date, md5(body) AS digest, person || '|Ana' AS people, project,
  3 + CASE WHEN doc_type = 'meeting' THEN 1 ELSE 0 END + CASE WHEN l_linenumber = 1 THEN 0 ELSE 1 END AS fields
FROM raw_notes WHERE source <> 'BUILDING'""")
SQL["parse_front_matter"] = with_("raw_notes", """
SELECT npath AS path, CASE WHEN doc_type = 'meeting' THEN 'title|' ELSE '' END || CASE WHEN l_linenumber = 1 THEN '' ELSE 'date|' END ||
  'type|people|project' AS names, project AS last FROM raw_notes""")
CTES["file_rows"] = ([], f"""
    SELECT *, string_split(path, '/')[-1] AS name FROM (
    SELECT doc_id, 'desk/' || CASE doc_id % 10 WHEN 0 THEN 'node_modules/' WHEN 1 THEN '.hidden/' WHEN 2 THEN 'Meetings/' ELSE '' END ||
      CASE WHEN doc_id % 10 = 3 THEN '~$' ELSE '' END || doc_id || ['.md', '.txt', '.jpg', '.pdf'][1 + doc_id % 4] AS path,
      {AS_OF} - CAST(doc_id % 200 AS INTEGER) AS date, n_chars * 1000 AS length, text FROM documents)
    WHERE doc_id % 10 NOT IN (0, 1, 3) AND doc_id % 4 <> 2""")
SQL["scan_files"] = with_("file_rows", "SELECT path, length FROM file_rows")
SPEAKER = "^([A-ZÁÉÍÓÚÑ][\\p{L}\\p{N}_ .-]{1,40}?)\\s*:\\s+.+$"
CTES["file_lines"] = (["file_rows"], """
    SELECT doc_id, n, line FROM (SELECT doc_id, unnest(range(len(l))) AS n, trim(unnest(l), ' ' || chr(9) || chr(13)) AS line FROM (
      SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM file_rows))
    WHERE line <> '' AND line <> 'WEBVTT' AND NOT regexp_full_match(line, '\\d+') AND NOT regexp_matches(line, '^\\d{2}:\\d{2}(:\\d{2})?[.,]\\d{3}\\s*-->')""")
SQL["normalise_file_doc"] = with_(["file_rows", "file_lines"], f"""
, sp AS (SELECT doc_id, n, trim(regexp_extract(line, '{SPEAKER}', 1)) AS name FROM file_lines WHERE regexp_matches(line, '{SPEAKER}'))
, st AS (SELECT doc_id, count(*) AS turns, count(DISTINCT name) FILTER (upper(name) NOT IN ('DECISIÓN','DECISION','PREGUNTA','IDEA','HIPÓTESIS','HYPOTHESIS','PENDIENTE','OPEN')) AS people FROM sp GROUP BY doc_id)
, cl AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS clean FROM file_lines GROUP BY doc_id)
SELECT path, regexp_replace(name, '\\.[^.]*$', '') AS title, CASE WHEN meeting THEN 'meeting' ELSE 'note' END AS doc_type,
  CAST(date AS VARCHAR) AS date, md5(CASE WHEN meeting THEN coalesce(clean, '') ELSE text END) AS digest
FROM (SELECT f.*, clean, contains(lower(path), 'meet') OR (coalesce(people, 0) >= 2 AND coalesce(turns, 0) >= 3) AS meeting
  FROM file_rows f LEFT JOIN st USING (doc_id) LEFT JOIN cl USING (doc_id))""")
SQL["html_to_text"] = """
SELECT page_id, array_to_string(list_filter(list_transform(regexp_split_to_array(
  regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\\b[^>]*>.*?</script\\s*>', '<x>', 'g'),
    '(?is)<style\\b[^>]*>.*?</style\\s*>', '<x>', 'g'), '(?s)<[^>]*>'),
  lambda c: regexp_replace(html_unescape_(c), '^\\s+|\\s+$', '', 'g')), lambda c: c <> ''), chr(10)) AS text FROM pages"""
UNESCAPE = "c"
for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"),
                   ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&eacute;", "é"), ("&amp;", "&")):
    UNESCAPE = f"replace({UNESCAPE}, '{name}', '{char}')"
SQL["html_to_text"] = SQL["html_to_text"].replace("html_unescape_(c)", UNESCAPE)

# -- conversations ----------------------------------------------------------------
CTES["speech"] = ([], f"""
    SELECT id, line_no, line, regexp_matches(line, '{SPEAKER}') AS spoken, trim(regexp_extract(line, '{SPEAKER}', 1)) AS speaker FROM (
      SELECT id, line_no, trim(CASE WHEN n = 1 THEN upper(role[1]) || role[2:] || ': ' || raw ELSE raw END) AS line FROM (
        SELECT CAST(conv_id AS VARCHAR) AS id, role, turn * 1000000 + n - 1 AS line_no, n, lines[n] AS raw FROM (
          SELECT conv_id, turn, role, string_split(text, chr(10)) AS lines, unnest(range(1, 1 + len(string_split(text, chr(10))))) AS n FROM conversations)))
    WHERE line <> '' AND NOT regexp_full_match(line, '\\d+')""")
CTES["speakers"] = (["speech"], """
    SELECT id, speaker, count(*) AS n, min(line_no) AS first_line FROM speech WHERE spoken AND upper(speaker) NOT IN
    ('DECISIÓN','DECISION','PREGUNTA','IDEA','HIPÓTESIS','HYPOTHESIS','PENDIENTE','OPEN') GROUP BY id, speaker""")
SQL["speaker_counts"] = with_("speakers", "SELECT id, speaker, n FROM speakers")
PARSED = """
SELECT t.id, coalesce(p.people, '') AS people, t.speaker_lines FROM (SELECT id, count(*) FILTER (spoken) AS speaker_lines FROM speech GROUP BY id) t
LEFT JOIN (SELECT id, string_agg(speaker, '|' ORDER BY n DESC, first_line) AS people, count(*) AS k FROM speakers GROUP BY id) p USING (id)"""
SQL["parse_transcript"] = with_("speakers", PARSED)
SQL["detect_transcript"] = with_("speakers", """
SELECT t.id, coalesce(p.k, 0) >= 2 AND t.speaker_lines >= 3 AS is_transcript
FROM (SELECT id, count(*) FILTER (spoken) AS speaker_lines FROM speech GROUP BY id) t
LEFT JOIN (SELECT id, count(*) AS k FROM speakers GROUP BY id) p USING (id)""")
CTES["chat"] = ([], """
    SELECT 'chat' || (user_id % 3) AS chat, event_id AS seq, CAST(ts AS DATE) AS date, 'User' || user_id AS author,
           event_type || ' ' || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) AS message FROM events""")
SQL["parse_chat_log"] = with_("chat", "SELECT chat, seq, CAST(date AS VARCHAR) AS date, author, message FROM chat")
SQL["scan_chat"] = """
SELECT chat, part, count(*) AS n, sum(length(line) * (seq % 1000 + 1))::BIGINT AS digest FROM (
  SELECT 'chat' || (user_id % 3) AS chat, event_id % 2 AS part, row_number() OVER (PARTITION BY user_id % 3, event_id % 2 ORDER BY event_id) - 1 AS seq,
         strftime(CAST(ts AS TIMESTAMP), '%d/%m/%y, %H:%M') || ' - User' || user_id || ': ' || event_type || ' ' || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) AS line FROM events)
GROUP BY ALL"""
SQL["chat_days_to_docs"] = with_("chat", """
SELECT 'whatsapp://' || chat || '/' || date AS path, chat || ' · ' || date AS title, CAST(date AS VARCHAR) AS date,
  array_to_string(list_sort(list_distinct(list(author))), '|') AS people, CAST(count(*) AS VARCHAR) AS messages,
  md5('# ' || chat || ' — ' || date || chr(10) || chr(10) || string_agg(author || ': ' || message, chr(10) ORDER BY seq)) AS digest
FROM chat GROUP BY chat, date""")
SQL["newest_days_per_chat"] = with_("chat", """
SELECT chat, CAST(date AS VARCHAR) AS date, recency FROM (
  SELECT chat, date, row_number() OVER (PARTITION BY chat ORDER BY date DESC) AS recency FROM (SELECT DISTINCT chat, date FROM chat)) WHERE recency <= 10""")
SQL["parse_slack_messages"] = """
SELECT 'c' || (user_id % 3) AS chat, event_id AS seq, CAST(CAST(ts AS DATE) AS VARCHAR) AS date,
  CASE user_id % 3 WHEN 0 THEN 'Real ' || user_id WHEN 1 THEN 'user' || user_id ELSE '?' END AS author, event_type AS message
FROM events WHERE event_type <> 'error'"""

# -- accounts ------------------------------------------------------------------------
CTES["calendar"] = ([], f"""
    SELECT *, event_id % 4 AS k, CASE event_id % 4 WHEN 0 THEN 'User ' || user_id WHEN 3 THEN NULL ELSE 'u' || user_id END AS guest,
           CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events WHERE event_type <> 'error'""")
SQL["normalise_calendar"] = with_("calendar", f"""
SELECT 'gcal://acct/ev' || event_id AS path, event_type AS title, CASE WHEN guest IS NULL THEN 'note' ELSE 'meeting' END AS doc_type, day AS date,
  coalesce(guest, '') AS people, '# ' || event_type || {NL} || CASE WHEN k = 0 THEN '' ELSE {NL} || 'Inicio: ' || strftime(ts, '%Y-%m-%dT%H:%M:%S') END ||
  CASE WHEN guest IS NULL THEN '' ELSE {NL} || 'Asistentes: ' || guest END || {NL} || 'Organiza: org@example.com' ||
  CASE WHEN k = 1 THEN {NL} || 'Lugar: Sala' ELSE '' END || CASE WHEN k = 2 THEN {NL} || {NL} || props ELSE '' END AS body FROM calendar""")
SQL["calendar_window"] = with_("calendar", """
SELECT 'gcal://acct/ev' || event_id AS path, day AS date FROM calendar WHERE day BETWEEN '2024-01-09' AND '2024-01-17'""")
CTES["cloud"] = ([], f"""
    SELECT doc_id, source, lang, text, {AS_OF} - CAST(doc_id % 300 AS INTEGER) AS day, doc_id % 3 > 0 AS touched FROM documents""")
SQL["normalise_drive_files"] = with_("cloud", """
SELECT 'gdrive://acct/' || doc_id AS path, source || ' file' AS title, CAST(day AS VARCHAR) AS date, md5(text) AS digest FROM cloud
WHERE lang <> 'de' AND regexp_matches(text, '\\S')""")
SQL["incremental_drive"] = with_("cloud", """
, f AS (SELECT source AS account, CASE WHEN touched THEN day || 'T10:00:00Z' END AS t FROM cloud)
, first AS (SELECT account, count(*) AS n, max(t) AS cursor FROM f WHERE t IS NULL OR t <= '2001-04-01T00:00:00Z' GROUP BY account)
, second AS (SELECT account, count(*) AS n, max(t) AS cursor FROM f LEFT JOIN (SELECT account, cursor AS seen FROM first) USING (account)
             WHERE seen IS NULL OR t > seen GROUP BY account)
SELECT account, 1 AS run, n, cursor FROM first
UNION ALL SELECT account, 2, s.n, coalesce(greatest(s.cursor, f.cursor), s.cursor, f.cursor) FROM second s LEFT JOIN first f USING (account)""")
SQL["normalise_email"] = with_("facts", """
SELECT CAST(o_orderkey AS VARCHAR) AS id, '"' || c_name || '" <c@example.com>' AS "from", 'me@example.com' AS "to", 'pedido ' || o_orderkey AS subject,
  CASE WHEN o_orderkey % 5 <> 0 THEN strftime(day, '%Y-%m-%d') || CASE WHEN o_orderkey % 2 = 0 THEN ' 12:14:05' ELSE ' 09:14:05' END END AS date,
  'INBOX' AS labels FROM facts""")
SQL["email_to_doc"] = with_("mail", """
SELECT subject AS title, 'email' AS doc_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS date,
  'De: ' || sender_header || chr(10) || chr(10) || 'cuerpo del pedido ' || o_orderkey AS body, sender AS people FROM mail WHERE o_orderstatus = 'O'""")
SQL["normalise_papers"] = f"""
SELECT 'europepmc://' || CASE WHEN p_partkey % 2 = 0 THEN 'PMC' ELSE 'MED' END || '/' || p_partkey AS path, 'Estudio de ' || p_name AS title,
  CASE WHEN p_size > 5 THEN (1960 + p_size) || '-01-01' ELSE '1900-01-01' END AS date,
  '# Estudio de ' || p_name || {NL} || {NL} || 'Autores: ' || p_brand || {NL} || 'Revista: ' || p_type || ' (' || CASE WHEN p_size > 5 THEN CAST(1960 + p_size AS VARCHAR) ELSE 's/f' END || ')' ||
  CASE WHEN p_partkey % 3 = 0 THEN {NL} || 'DOI: https://doi.org/10.1/' || p_partkey ELSE '' END AS body, 'true' AS open_access
FROM part WHERE p_partkey % 10 <> 9"""

# -- references ------------------------------------------------------------------------
SQL["scan_bibtex"] = """
SELECT 'key' || p_partkey AS key, 'article' AS type, 'El {' || p_name || '} y otros.' AS title, 'Autor ' || p_partkey AS author,
  CAST(1960 + p_size AS VARCHAR) AS year, p_type AS journal, CASE WHEN p_partkey % 2 = 0 THEN 'https://doi.org/10.5/' || p_partkey END AS doi FROM part
UNION ALL SELECT 'alt' || p_partkey, 'book', p_brand, NULL, NULL, 'Libro', NULL FROM part"""
SQL["scan_library"] = SQL["scan_bibtex"]
SQL["scan_csl_json"] = """
SELECT CAST(p_partkey AS VARCHAR) AS key, 'article-journal' AS type, p_name AS title, 'Ana ' || p_brand || ', Solo' AS author,
  CAST(1960 + p_size AS VARCHAR) AS year, p_type AS journal, '10.7/' || p_partkey AS doi FROM part"""
SQL["normalise_reference"] = f"""
SELECT 'zotero://key' || p_partkey AS path, 'El ' || p_name || ' y otros' AS title, (1960 + p_size) || '-01-01' AS date,
  '# El ' || p_name || ' y otros' || {NL} || {NL} || 'Autores: Autor ' || p_partkey || {NL} || 'Revista: ' || p_type || ' (' || (1960 + p_size) || ')' ||
  CASE WHEN p_partkey % 2 = 0 THEN {NL} || 'DOI: https://doi.org/10.5/' || p_partkey ELSE '' END AS body,
  CASE WHEN p_partkey % 2 = 0 THEN '10.5/' || p_partkey END AS doi FROM part
UNION ALL SELECT 'zotero://alt' || p_partkey, p_brand, '1900-01-01', '# ' || p_brand || {NL} || {NL} || 'Revista: Libro ()', NULL FROM part"""
CTES["refs"] = ([], r"""
    SELECT * REPLACE (CASE WHEN pos = 0 THEN regexp_extract(raw, '\b((?:19|20)\d{2})\b', 1) END AS year) FROM (
    SELECT 'bib-' || p_partkey AS doc_id, 0 AS pos, p_partkey, p_size,
      upper(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:] || ' K, et al. Estudio de ' || p_name || ' ' || lower(p_type) || ' numero ' || p_partkey ||
      '. Revista. ' || (1990 + p_size % 30) || ';' || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE ' doi 10.1000/p' || p_partkey || '.' END AS raw,
      CASE WHEN p_partkey % 4 <> 0 THEN '10.1000/p' || p_partkey END AS doi, CAST(1990 + p_size % 30 AS VARCHAR) AS year,
      upper(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:] AS author FROM part
    UNION ALL SELECT 'bib-' || p_partkey, 1, p_partkey, p_size, '10.2000/L' || (p_partkey % 50), '10.2000/L' || (p_partkey % 50), NULL, NULL FROM part
    UNION ALL SELECT 'bib-' || p_partkey, 2, p_partkey, p_size, '10.1000/P' || p_partkey, '10.1000/P' || p_partkey, NULL, NULL FROM part WHERE p_partkey % 4 = 0)""")
SQL["extract_references"] = with_("refs", "SELECT doc_id, raw, doi, year, author FROM refs")
SQL["distinct_rules"] = with_("refs", """
SELECT arg_min(doc_id, (doc_id, pos)) AS doc_id, arg_min(doi, (doc_id, pos)) AS doi FROM refs WHERE doi IS NOT NULL GROUP BY lower(doi)""")
CTES["works"] = ([], """
    SELECT CASE WHEN p_partkey % 11 = 0 THEN '10.3000/X' ELSE '10.1000/P' END || p_partkey AS doi,
      'Estudio de ' || p_name || ' ' || lower(p_type) || ' número ' || p_partkey AS title,
      upper(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:] AS family,
      CAST(1990 + p_size % 30 + CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS year FROM part""")
# a citation without a DOI never contains a registered title here (numero / número): it takes the work of the most
# similar title, without one the first work of its author and year
WORDS = "list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')), ' '), lambda x: x <> ''))"
CTES["near_titles"] = (["refs", "works"], f"""
    SELECT doc_id, pos, arg_max(doi, (share, n, words)) AS doi FROM (
      SELECT doc_id, pos, w.doi, len(list_intersect(tw, rw)) / len(tw) AS share, length(array_to_string(tw, ' ')) AS n, array_to_string(tw, ' ') AS words
      FROM (SELECT doc_id, pos, {WORDS.format('raw')} AS rw FROM refs WHERE doi IS NULL), (SELECT doi, {WORDS.format('title')} AS tw FROM works) w)
    WHERE share >= 0.55 GROUP BY ALL""")
CTES["joined"] = (["refs", "works", "near_titles"], """
    SELECT r.*, w.doi AS work_doi, w.title AS work_title, w.family AS work_family, w.year AS work_year FROM refs r LEFT JOIN works w ON lower(r.doi) = lower(w.doi)
    WHERE r.doi IS NOT NULL
    UNION ALL SELECT r.*, w.doi, w.title, w.family, w.year FROM refs r LEFT JOIN (SELECT doc_id, pos, doi AS near FROM near_titles) s USING (doc_id, pos) LEFT JOIN (
      SELECT family, year, min(doi) AS doi FROM works GROUP BY family, year) a ON a.family = r.author AND a.year = r.year
    LEFT JOIN works w ON w.doi = coalesce(near, a.doi) WHERE r.doi IS NULL""")
SQL["doi_join"] = with_("joined", "SELECT doc_id, raw, work_doi, work_year FROM joined")

CTES["verified"] = (["joined"], r"""
    SELECT doc_id, raw, CASE WHEN work_doi IS NULL THEN 'no_encontrado' WHEN issues = '' THEN 'verificado' ELSE 'discrepancia' END AS verdict,
      CASE WHEN work_doi IS NULL THEN 'sin resultados' ELSE issues END AS detail
    FROM (SELECT *, concat_ws('; ', CASE WHEN doi IS NULL AND len(list_intersect(list_distinct(tw), rw)) / len(list_distinct(tw)) < 0.55
                   THEN 'título distinto (' || work_title[1:70] || '…)' END,
                 CASE WHEN year <> work_year THEN 'año: cita ' || year || ' vs fuente ' || work_year END) AS issues
          FROM (SELECT *, string_split(trim(regexp_replace(regexp_replace(lower(work_title), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')), ' ') AS tw,
                       string_split(trim(regexp_replace(regexp_replace(lower(raw), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')), ' ') AS rw FROM joined))""")
SQL["verify_references"] = with_("verified", "SELECT doc_id, raw, verdict, detail FROM verified")
SQL["reference_summary"] = with_("verified", "SELECT doc_id, count(*) FILTER (verdict = 'verificado') AS ok, count(*) AS total FROM verified GROUP BY doc_id")

# -- plans -----------------------------------------------------------------------------------
CTES["plan_rows"] = ([], f"""
    SELECT 'plan-' || l_returnflag AS file, l_linestatus AS sheet, l_orderkey * 8 + l_linenumber + 10 AS row, 'Pieza ' || l_partkey AS activity,
      l_linenumber AS week, {AS_OF} + CAST(l_linenumber * 7 - 1 AS INTEGER) AS due, CASE WHEN l_linestatus = 'F' THEN 'done' ELSE 'active' END AS status,
      CASE WHEN l_linestatus = 'F' THEN 'IP' END AS responsible, 'Informe ' || l_suppkey AS deliverable FROM lineitem""")
SQL["scan_plan_rows"] = with_("plan_rows", """
SELECT file, sheet, row, activity, 'F1' AS phase, week, CAST(due AS VARCHAR) AS due, status, responsible, deliverable, 'Alta' AS priority FROM plan_rows""")
BEST = """
, sizes AS (SELECT file, sheet, count(*) AS n FROM plan_rows GROUP BY file, sheet)
, best AS (SELECT file, sheet, n FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, sheet) AS r FROM sizes) WHERE r = 1)
"""
SQL["pick_best_sheet"] = with_("plan_rows", BEST.strip() + "SELECT file, sheet, n FROM best")
SQL["import_plan_tasks"] = with_("plan_rows", """
SELECT DISTINCT 'ko-plan-' || substr(sha1('tesis|' || activity || '|' || week), 1, 12) AS id, activity AS title, CAST(due AS VARCHAR) AS date,
  CAST(due AS VARCHAR) AS valid_to, 'F1|prioridad:alta' AS tags, 'Tesis' AS project FROM plan_rows""")
SQL["load_project_dim"] = f"""
SELECT lower(n_name) AS id, n_name AS name, r_name AS area, CAST({AS_OF} + CAST(n_nationkey + 60 AS INTEGER) AS VARCHAR) AS deadline, 2 AS n,
  CAST({AS_OF} + CAST(n_nationkey - 5 AS INTEGER) AS VARCHAR) AS first_due, lower(n_name) AS keywords FROM nation JOIN region ON n_regionkey = r_regionkey"""

# -- folders -----------------------------------------------------------------------------------
CTES["files"] = ([], f"""
    SELECT source AS folder, doc_id, lang, ['.md', '.pdf', '.jpg', '.exe'][1 + doc_id % 4] AS ext, n_chars, doc_id % 4 < 2 AS ok,
           doc_id % 200 <= 90 AS fresh, doc_id % 40 = 0 AS asia FROM documents""")
CTES["stats"] = (["files"], """
    SELECT folder, count(*) AS total, count(*) FILTER (ok) AS supported, count(*) FILTER (ok AND fresh) AS recent,
      coalesce(sum(n_chars) FILTER (ok), 0)::BIGINT AS bytes,
      concat_ws(',', CASE WHEN count(*) FILTER (ext = '.md') > 0 THEN '.md=' || count(*) FILTER (ext = '.md') END,
                CASE WHEN count(*) FILTER (ext = '.pdf') > 0 THEN '.pdf=' || count(*) FILTER (ext = '.pdf') END) AS types,
      CASE WHEN count(*) FILTER (ok AND asia) > 0 THEN 'ASIA' END AS area_guess, nullif(count(*) FILTER (ok AND asia), 0) AS area_hits
    FROM files GROUP BY folder""")
SQL["folder_stats"] = with_("stats", "SELECT * FROM stats")
CTES["scored"] = (["stats"], """
    SELECT *, CASE WHEN supported = 0 THEN 'ignorar' WHEN supported / total < 0.05 AND supported < 5 THEN 'ignorar'
        WHEN supported >= 5 AND (recent > 0 OR area_guess IS NOT NULL) THEN 'conectar' ELSE 'revisar' END AS verdict,
      CASE WHEN supported = 0 THEN 0 ELSE least(40, supported) + least(30, 3 * recent) + least(30, 5 * coalesce(area_hits, 0)) END AS score FROM stats""")
SQL["score_folders"] = with_("scored", """
SELECT folder, score, verdict, concat_ws('|', CASE WHEN supported > 0 THEN supported || ' archivos soportados' END,
  CASE WHEN recent > 0 THEN recent || ' modificados en los últimos 90 días' END,
  CASE WHEN supported > 0 AND area_guess IS NOT NULL THEN 'calza con el área «' || area_guess || '»' END,
  CASE WHEN supported = 0 THEN 'sin archivos de texto/oficina soportados' WHEN verdict = 'ignorar' THEN 'casi todo son binarios/fotos/instaladores'
       WHEN verdict = 'revisar' THEN 'pocas señales; decide tú' END) AS reasons FROM scored""")
SQL["rank_folders"] = with_("scored", """
SELECT row_number() OVER (ORDER BY CASE verdict WHEN 'conectar' THEN 1 WHEN 'revisar' THEN 2 ELSE 3 END, score DESC, folder) AS rank, folder, verdict, score FROM scored""")
SQL["sources_not_registered"] = """
SELECT '/home/Documents/' || source AS path FROM documents WHERE source NOT LIKE '%src1' GROUP BY source HAVING count(*) FILTER (lang = 'de') > 0"""
SQL["token_overlap"] = with_("files", "SELECT folder, 'ASIA' AS area, count(*) AS n FROM files WHERE asia GROUP BY folder")
SQL["set_difference"] = "SELECT r_name AS name FROM region"
SQL["group_documents"] = "SELECT lang AS collection, 'doc-' || doc_id AS doc_id FROM documents"
SQL["collection_heads"] = "SELECT lang AS collection, count(*) AS n_docs, 'agrupado por carpeta/fuente de origen' AS rationale FROM documents GROUP BY lang"
SQL["replace_collections"] = "SELECT lang AS collection, count(*) AS n_docs FROM documents GROUP BY lang"
SQL["collection_members"] = with_("docs", "SELECT lang AS collection, id AS doc_id, CAST(date AS VARCHAR) AS date, path FROM docs")

# -- snapshot -----------------------------------------------------------------------------------
SQL["cited_documents"] = with_(["docs", "kos"], "SELECT id, path FROM docs WHERE id IN (SELECT source_doc FROM kos)")
SQL["export_snapshot"] = with_(["docs", "kos", "entities", "edges"], """
SELECT 'nodes' AS table_name, count(*) AS n FROM entities UNION ALL SELECT 'entities', count(*) FROM entities
UNION ALL SELECT 'links', count(*) FROM edges UNION ALL SELECT 'relationships', count(*) FROM edges UNION ALL SELECT 'kos', count(*) FROM kos
UNION ALL SELECT 'documents', count(*) FROM docs WHERE id IN (SELECT source_doc FROM kos)""")
SQL["read_snapshot"] = with_(["docs", "kos"], """
SELECT area, 0 AS documents, count(*) AS kos, count(*) FILTER (ko_type = 'task' AND status = 'active') AS tasks_open,
  count(*) FILTER (ko_type = 'decision') AS decisions FROM kos GROUP BY area
UNION ALL SELECT '_sin_area', count(*), 0, 0, 0 FROM docs WHERE id IN (SELECT source_doc FROM kos)""")

# -- streams ----------------------------------------------------------------------------------------
SQL["incremental_files"] = r"""
SELECT source, lang, doc_id // 1000 AS block, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS length,
  md5(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id)) AS digest
FROM documents GROUP BY ALL HAVING bool_or(regexp_matches(text, '\S'))"""
SQL["stream_dedup_docs"] = "SELECT DISTINCT sha256(text) AS body_hash FROM documents"
SQL["stream_extract"] = with_(["note_kos", "notes"], """
SELECT ko_type, project, count(*) AS n, CAST(min(date) AS VARCHAR) AS first FROM (
  SELECT ko_type, project, date FROM note_kos UNION ALL SELECT 'event', project, date FROM notes WHERE doc_type = 'meeting') GROUP BY ALL""")
SQL["stream_triage"] = with_("triage", "SELECT id, score, priority FROM triage")
WINDOWS = """
SELECT days, strftime(d, '%Y-%m-%d') AS start, event_type, count(*) AS n FROM (
  SELECT days, event_type, unnest(generate_series(CAST(CAST(ts AS DATE) AS TIMESTAMP) - to_days(days - 1), CAST(CAST(ts AS DATE) AS TIMESTAMP), INTERVAL 1 DAY)) AS d
  FROM events, (VALUES (7), (14), (30)) w(days)) GROUP BY ALL"""
SQL["stream_signal_counts"] = WINDOWS
SQL["signal_counts"] = WINDOWS
SQL["run_extractor"] = with_("notes", "SELECT id AS source_doc, 'fact' AS ko_type, title, 'probable' AS confidence, md5(body) AS digest FROM notes")
