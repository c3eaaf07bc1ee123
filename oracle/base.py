"""DuckDB common table expressions equal to the adapters, written from the given columns."""

AS_OF = "DATE '2001-07-15'"
ENT = "'ent-' || substr(sha256({n} || '|' || {t}), 1, 24)"

CTES: dict[str, tuple[list[str], str]] = {
    "docs": ([], f"""
        SELECT 'doc-' || doc_id AS id, source || '/' || lang || '/' || doc_id || '.md' AS path,
               split_part(text, chr(10), 1) AS title, 'note' AS doc_type,
               {AS_OF} - CAST(doc_id % 400 AS INTEGER) AS date, text AS body, lang, source, doc_id
        FROM documents"""),
    "facts": ([], """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, CAST(o_orderdate AS DATE) AS day,
               c_name, c_mktsegment, n_nationkey, n_name, r_name, r_regionkey
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey"""),
    "notes": (["facts"], """
        SELECT 'note-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' ||
               CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS id,
               'orders/' || lower(c_mktsegment) || '/' || l_orderkey || '.md' AS path,
               'Order ' || l_orderkey AS title,
               CASE WHEN l_orderkey % 3 = 0 THEN 'meeting' ELSE 'note' END AS doc_type, day AS date,
               '# Order ' || l_orderkey || chr(10) || chr(10) ||
               CASE l_returnflag || l_linestatus WHEN 'RF' THEN 'DECISIÓN: ' WHEN 'RO' THEN 'Hipótesis: '
                    WHEN 'AF' THEN '- [ ] ' WHEN 'AO' THEN 'PREGUNTA: ' WHEN 'NF' THEN 'idea: ' ELSE '' END ||
               'pieza ' || l_partkey || ' de proveedor ' || l_suppkey || ' cantidad ' || CAST(l_quantity AS INTEGER) ||
               CASE WHEN l_linenumber = 1 THEN chr(10) || '  * [ ] revisar ' || l_partkey ELSE '' END AS body,
               c_name AS person, r_name AS organization, n_name AS project, lower(c_mktsegment) AS tag,
               c_mktsegment AS source, l_returnflag, l_linestatus, l_partkey, l_suppkey, l_quantity, l_linenumber,
               'pieza ' || l_partkey || ' de proveedor ' || l_suppkey || ' cantidad ' || CAST(l_quantity AS INTEGER) AS stmt
        FROM lineitem JOIN facts ON l_orderkey = o_orderkey"""),
    "note_kos": (["notes"], """
        SELECT id AS source_doc, CASE l_returnflag || l_linestatus WHEN 'RF' THEN 'decision' WHEN 'RO' THEN 'hypothesis'
               WHEN 'AF' THEN 'task' WHEN 'AO' THEN 'question' WHEN 'NF' THEN 'idea' END AS ko_type, stmt AS statement,
               2 AS line_no, date, person, project, tag, source
        FROM notes WHERE l_returnflag || l_linestatus <> 'NO'
        UNION ALL
        SELECT id, 'task', 'revisar ' || l_partkey, 3, date, person, project, tag, source FROM notes WHERE l_linenumber = 1"""),
    "kos": (["facts"], """
        SELECT 'ko-' || o_orderkey AS id, o_orderkey,
               CASE o_orderkey % 7 WHEN 0 THEN 'decision' WHEN 1 THEN 'task' WHEN 2 THEN 'fact' WHEN 3 THEN 'idea'
                    WHEN 4 THEN 'question' WHEN 5 THEN 'hypothesis' ELSE 'event' END AS ko_type,
               'Pedido ' || o_orderkey || ' ' || c_mktsegment AS title,
               'Pedido ' || o_orderkey || ' de ' || lower(c_mktsegment) || ' con prioridad ' ||
               lower(regexp_replace(o_orderpriority, '^[0-9]-', '')) AS statement,
               day AS date, c_name AS person, n_name AS project,
               CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'active' ELSE 'archived' END AS status,
               CASE WHEN o_orderkey % 7 = 0 THEN 'confirmed' ELSE 'probable' END AS confidence,
               'doc-' || (o_orderkey // 8) AS source_doc, lower(c_mktsegment) AS tag,
               CASE WHEN o_orderkey % 7 = 1 THEN day + CAST(o_orderkey % 60 AS INTEGER) END AS valid_to, r_name AS area
        FROM facts"""),
    "entities": ([], f"""
        SELECT {ENT.format(n='name', t='entity_type')} AS id, name, entity_type,
               CASE WHEN entity_type = 'project' THEN 'Plan ' || name END AS alias
        FROM (SELECT c_name AS name, 'person' AS entity_type FROM customer
              UNION ALL SELECT s_name, 'organization' FROM supplier UNION ALL SELECT n_name, 'project' FROM nation)"""),
    "edges": ([], f"""
        SELECT source_id || '>' || rel_type || '>' || target_id AS id, * FROM (
        SELECT {ENT.format(n='c_name', t="'person'")} AS source_id, {ENT.format(n='s_name', t="'organization'")} AS target_id,
               'works_with' AS rel_type, min(CAST(o_orderdate AS DATE)) AS valid_from,
               CASE WHEN max(CAST(o_orderdate AS DATE)) > min(CAST(o_orderdate AS DATE)) THEN max(CAST(o_orderdate AS DATE)) END AS valid_to
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
             JOIN supplier ON l_suppkey = s_suppkey GROUP BY c_name, s_name
        UNION ALL
        SELECT {ENT.format(n='c_name', t="'person'")}, {ENT.format(n='n_name', t="'project'")}, 'participates_in',
               min(CAST(o_orderdate AS DATE)), NULL
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY c_name, n_name)"""),
    "degree": (["edges"], """
        SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY id"""),
    "mail": ([], """
        SELECT 'm-' || o_orderkey AS id, o_orderkey,
               CASE WHEN o_custkey % 7 = 0 THEN 'no-reply@c' || o_custkey || '.example.com'
                    ELSE c_name || ' <c' || o_custkey || '@example.com>' END AS sender_header,
               CASE WHEN o_custkey % 7 = 0 THEN 'no-reply' ELSE c_name END AS sender,
               o_orderpriority || ' order ' || o_orderkey AS subject, o_orderdate AS ts,
               CASE o_orderstatus WHEN 'O' THEN 'favor confirmar la entrega' WHEN 'P' THEN 'newsletter semanal'
                    ELSE 'entrega cerrada' END AS snippet, o_orderstatus, o_orderpriority, o_custkey, c_name,
               o_orderkey % 5 = 0 AS promo
        FROM orders JOIN customer ON o_custkey = c_custkey"""),
    "pinned": ([], """
        SELECT arg_max(c_name, (c_acctbal, c_name)) AS name, 'rol ' || c_nationkey AS role FROM customer GROUP BY c_nationkey"""),
    "triage": (["mail", "pinned", "entities", "degree"], """
        SELECT *, CASE WHEN score >= 60 THEN 1 WHEN score >= 40 THEN 2 WHEN score >= 20 THEN 3 WHEN score >= 0 THEN 4 ELSE 5 END AS priority
        FROM (SELECT m.*, d.degree,
              (CASE WHEN p.name IS NOT NULL THEN 30 ELSE 0 END)
              + (CASE WHEN e.id IS NOT NULL THEN 40 + least(10, 2 * coalesce(d.degree, 0)) ELSE 0 END)
              + (CASE WHEN o_orderpriority = '1-URGENT' THEN 25 ELSE 0 END)
              + (CASE WHEN o_orderstatus = 'O' THEN 15 ELSE 0 END)
              + (CASE WHEN ts > TIMESTAMP '2001-07-14 12:00:00' THEN 10 ELSE 0 END)
              - (CASE WHEN o_custkey % 7 = 0 OR o_orderstatus = 'P' THEN 30 ELSE 0 END)
              - (CASE WHEN promo THEN 15 ELSE 0 END) AS score,
              concat_ws('|', CASE WHEN p.name IS NOT NULL THEN 'persona fijada por ti' END,
                 CASE WHEN e.id IS NOT NULL THEN 'remitente en tu knowledge graph (' || lower(e.name) || ', ' || coalesce(d.degree, 0) || ' relaciones)' END,
                 CASE WHEN o_orderpriority = '1-URGENT' THEN 'lenguaje de urgencia/plazo' END,
                 CASE WHEN o_orderstatus = 'O' THEN 'pide una acción tuya' END,
                 CASE WHEN ts > TIMESTAMP '2001-07-14 12:00:00' THEN 'recibido en las últimas 24 h' END,
                 CASE WHEN o_custkey % 7 = 0 OR o_orderstatus = 'P' THEN 'parece correo automático/newsletter' END,
                 CASE WHEN promo THEN 'categoría promociones/social/updates' END) AS why
              FROM mail m LEFT JOIN pinned p ON p.name = m.sender
              LEFT JOIN entities e ON e.name = m.sender AND e.entity_type = 'person'
              LEFT JOIN degree d ON d.id = e.id)"""),
    "areas": ([], "SELECT r_regionkey AS map_order, r_name AS id, 'Área ' || r_name AS name FROM region"),
    "terms": ([], """
        SELECT r_regionkey AS map_order, r_name AS area, 'keyword' AS kind, lower(unnest(string_split(r_name, ' '))) AS term, 2 AS points FROM region
        UNION ALL SELECT n_regionkey, r_name, 'project', lower(n_name), 4 FROM nation JOIN region ON n_regionkey = r_regionkey"""),
    "overrides": ([], """
        SELECT r_name AS area, CASE WHEN r_regionkey = 2 THEN 2.0 ELSE 1.0 END AS weight,
               CASE WHEN r_regionkey = 0 THEN 1 END AS pin, CASE WHEN r_regionkey = 4 THEN 'pausada' ELSE 'activa' END AS status
        FROM region"""),
    "mail_hits": (["triage", "terms"], """
        SELECT area, count(*) AS mail FROM (
          SELECT id, arg_max(area, (score, -map_order)) AS area, max(score) AS best FROM (
            SELECT t.id, area, map_order, sum(points) AS score FROM triage t JOIN terms
            ON contains(lower(t.subject || ' ' || t.sender_header), term) WHERE priority <= 2 GROUP BY ALL) GROUP BY id)
        WHERE best >= 2 GROUP BY area"""),
    "signals": (["kos", "areas", "mail_hits"], f"""
        SELECT a.map_order, a.id AS area, a.name, count(*) FILTER (ko_type = 'task' AND status = 'active') AS tasks,
               count(*) FILTER (ko_type = 'event' AND date BETWEEN {AS_OF} AND {AS_OF} + 7) AS events,
               count(*) FILTER (ko_type = 'decision' AND date >= {AS_OF} - 14) AS decisions,
               count(*) FILTER (ko_type = 'question' AND status = 'active') AS questions,
               coalesce(any_value(h.mail), 0) AS mail,
               count(*) FILTER (ko_type = 'task' AND status = 'active' AND valid_to < {AS_OF}) AS overdue
        FROM areas a LEFT JOIN kos k ON k.area = a.id LEFT JOIN mail_hits h ON h.area = a.id GROUP BY a.map_order, a.id, a.name"""),
    "ranked_areas": (["signals", "overrides"], """
        SELECT *, row_number() OVER (ORDER BY tier, CASE WHEN tier = 0 THEN pin END, CASE WHEN tier <> 0 THEN -score END, map_order) AS rank
        FROM (SELECT s.*, o.weight, o.pin, o.status, tasks*3 + events*4 + decisions*2 + questions + mail*4 + overdue*5 AS score_auto,
              round((tasks*3 + events*4 + decisions*2 + questions + mail*4 + overdue*5) * greatest(o.weight, 0.1), 1)::DOUBLE AS score,
              CASE WHEN o.status = 'pausada' THEN 2 WHEN o.pin IS NOT NULL THEN 0 ELSE 1 END AS tier
              FROM signals s JOIN overrides o ON o.area = s.area)"""),
    "person_signals": (["entities", "degree", "kos", "triage", "pinned"], f"""
        SELECT e.id, e.name, coalesce(d.degree, 0) AS degree, coalesce(m.recent, 0) AS recent, coalesce(m.upcoming, 0) AS upcoming,
               coalesce(h.n, 0) AS mail, p.name IS NOT NULL AS pinned, p.role,
               coalesce(d.degree, 0)*2 + coalesce(m.recent, 0)*3 + coalesce(m.upcoming, 0)*5 + coalesce(h.n, 0)*4 AS score
        FROM entities e LEFT JOIN degree d ON d.id = e.id
        LEFT JOIN (SELECT person, count(*) AS recent, count(*) FILTER (ko_type = 'event' AND date >= {AS_OF}) AS upcoming
                   FROM kos WHERE date >= {AS_OF} - 30 GROUP BY person) m ON m.person = e.name
        LEFT JOIN (SELECT sender, count(*) AS n FROM triage WHERE priority <= 2 GROUP BY sender) h ON h.sender = e.name
        LEFT JOIN pinned p ON p.name = e.name WHERE e.entity_type = 'person'"""),
    "ranked_people": (["person_signals"], """
        SELECT *, row_number() OVER (ORDER BY pinned DESC, score DESC, lower(name), id) AS rank FROM person_signals"""),
}


def with_(names: list[str] | str, select: str) -> str:
    """``select`` preceded by the expressions it needs, dependencies first."""
    names = [names] if isinstance(names, str) else names
    done: list[str] = []

    def add(n: str) -> None:
        if n not in done:
            for d in CTES[n][0]:
                add(d)
            done.append(n)

    for n in names:
        add(n)
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in done)
    select = select.strip()
    return f"WITH {head}{"" if select.startswith(",") else chr(10)}{select}"
