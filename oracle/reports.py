"""Expected results for report tables."""

from .base import AS_OF, CTES, with_

SQL: dict[str, str] = {}

CTES["projects"] = ([], f"""
    SELECT lower(n_name) AS id, n_name AS name, r_name AS area, {AS_OF} + CAST(n_nationkey + 60 AS INTEGER) AS deadline,
           {AS_OF} + CAST(n_nationkey - 5 AS INTEGER) AS due1, {AS_OF} + CAST(n_nationkey + 9 AS INTEGER) AS due2
    FROM nation JOIN region ON n_regionkey = r_regionkey""")
CTES["status"] = (["projects", "kos"], f"""
    SELECT p.*, p.deadline - {AS_OF} AS days_to_deadline, coalesce(c.tasks, 0) AS tasks, coalesce(c.done, 0) AS done,
      coalesce(c.active, 0) AS active, coalesce(c.overdue, 0) AS overdue, coalesce(c.due_soon, 0) AS due_soon,
      coalesce(c.questions, 0) AS questions,
      CASE WHEN due1 >= {AS_OF} THEN 'Hito 1 ' || name ELSE 'Hito 2 ' || name END AS next_milestone,
      CASE WHEN due1 >= {AS_OF} THEN due1 ELSE due2 END AS next_due
    FROM projects p LEFT JOIN (SELECT project, count(*) FILTER (ko_type = 'task') AS tasks,
      count(*) FILTER (ko_type = 'task' AND status = 'done') AS done, count(*) FILTER (ko_type = 'task' AND status = 'active') AS active,
      count(*) FILTER (ko_type = 'task' AND status = 'active' AND valid_to < {AS_OF}) AS overdue,
      count(*) FILTER (ko_type = 'task' AND status = 'active' AND valid_to BETWEEN {AS_OF} AND {AS_OF} + 7) AS due_soon,
      count(*) FILTER (ko_type = 'question' AND status = 'active') AS questions FROM kos GROUP BY project) c ON c.project = p.name""")
CTES["project_items"] = (["kos"], f"""
    SELECT project AS name, kind, rank, id, title, statement, date, valid_to FROM (
      SELECT *, row_number() OVER (PARTITION BY project, kind ORDER BY CASE WHEN kind = 'question' THEN DATE '1970-01-01' - date
        ELSE valid_to - DATE '1970-01-01' END, id) AS rank FROM (
        SELECT *, CASE WHEN ko_type = 'task' AND status = 'active' AND valid_to < {AS_OF} THEN 'overdue'
          WHEN ko_type = 'task' AND status = 'active' AND valid_to BETWEEN {AS_OF} AND {AS_OF} + 7 THEN 'due_soon'
          WHEN ko_type = 'question' AND status = 'active' THEN 'question' END AS kind FROM kos) WHERE kind IS NOT NULL)
    WHERE rank <= CASE kind WHEN 'question' THEN 2 ELSE 5 END""")
CTES["people_items"] = (["kos", "pinned"], f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, ko_type ORDER BY CASE WHEN ko_type = 'event' THEN date - DATE '1970-01-01'
      ELSE DATE '1970-01-01' - date END, id) AS rank FROM (
      SELECT DISTINCT p.name, k.id, ko_type, k.date, title, statement FROM kos k JOIN pinned p ON contains(lower(k.person), lower(p.name))
      WHERE status = 'active' AND ko_type IN ('event','task','question') AND (ko_type <> 'event' OR k.date BETWEEN {AS_OF} AND {AS_OF} + 14)))
    WHERE rank <= CASE ko_type WHEN 'event' THEN 1 WHEN 'task' THEN 4 ELSE 2 END""")
CTES["area_tasks"] = (["kos", "ranked_areas"], """
    SELECT k.area, a.rank AS area_rank, k.rank, k.id, k.date, k.statement FROM (
      SELECT *, row_number() OVER (PARTITION BY area ORDER BY date DESC, id) AS rank FROM kos WHERE ko_type = 'task' AND status = 'active') k
    JOIN ranked_areas a ON a.area = k.area WHERE k.rank <= 8""")


def rows(section, rank, owner, item, date, text, tail):
    return (f"SELECT {section} AS section, CAST({rank} AS BIGINT) AS rank, {owner} AS owner, {item} AS item_id, "
            f"CAST({date} AS VARCHAR) AS date, CAST({text} AS VARCHAR) AS text {tail}")


PROJECT_BRIEF = " UNION ALL ".join([
    rows("'project'", "0", "name", "id", "deadline", "'entrega en ' || days_to_deadline || ' días (' || deadline || ')' || "
         "CASE WHEN tasks > 0 THEN ' · ' || done || '/' || tasks || ' actividades hechas' ELSE '' END", "FROM status"),
    rows("'project:milestone'", "1", "name", "id", "next_due", "next_milestone", "FROM status"),
    rows("'project:' || kind", "rank", "name", "id", "CASE WHEN kind = 'question' THEN date ELSE valid_to END",
         "CASE WHEN kind = 'question' THEN statement ELSE title END", "FROM project_items")])
PEOPLE_BRIEF = " UNION ALL ".join([
    rows("'person'", "0", "name", "NULL", "NULL", "role", "FROM pinned"),
    rows("'person:' || ko_type", "rank", "name", "id", "date", "CASE WHEN ko_type = 'event' THEN title ELSE statement END", "FROM people_items"),
    rows("'person:quiet'", "1", "name", "NULL", "NULL", "'Sin pendientes registrados con esta persona.'",
         "FROM pinned WHERE name NOT IN (SELECT name FROM people_items)")])


def mail(n):
    return rows("'mail'", "rank", "NULL", "id", "CAST(ts AS DATE)", "'P' || priority || ' · ' || subject || ' — ' || sender_header",
                f"FROM (SELECT *, row_number() OVER (ORDER BY priority, score DESC, id) AS rank FROM triage WHERE priority <= 2) WHERE rank <= {n}")


SQL["project_status"] = with_("status", """
SELECT id, name, area, CAST(deadline AS VARCHAR) AS deadline, days_to_deadline, tasks, done, active, overdue, due_soon, questions,
       next_milestone, CAST(next_due AS VARCHAR) AS next_due FROM status""")
SQL["project_cards"] = with_("status", """
SELECT id, name, area, CAST(deadline AS VARCHAR) AS deadline, days_to_deadline, tasks, done, overdue, due_soon,
       next_milestone, CAST(next_due AS VARCHAR) AS next_due FROM status""")
SQL["top_items_per_project"] = with_("project_items", "SELECT name, kind, rank, id FROM project_items")
SQL["project_brief"] = with_(["status", "project_items"], PROJECT_BRIEF)
SQL["key_people_brief"] = with_("people_items", PEOPLE_BRIEF)
SQL["top_tasks_per_area"] = with_("area_tasks", "SELECT area, area_rank, rank, id, CAST(date AS VARCHAR) AS date FROM area_tasks")
SQL["week_review"] = with_(["kos", "projects", "triage"], f"""
, tagged AS (SELECT *, CASE WHEN ko_type = 'decision' AND date >= {AS_OF} - 7 THEN 'decisions'
    WHEN ko_type = 'task' AND status = 'done' AND date >= {AS_OF} - 7 THEN 'closed'
    WHEN ko_type = 'task' AND status = 'active' AND valid_to < {AS_OF} THEN 'overdue'
    WHEN ko_type = 'task' AND status = 'active' AND valid_to BETWEEN {AS_OF} AND {AS_OF} + 7 THEN 'due'
    WHEN ko_type = 'question' AND status = 'active' AND date <= {AS_OF} - 30 THEN 'stale' END AS section FROM kos)
, listed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY CASE WHEN section = 'stale' THEN DATE '1970-01-01' - date
    ELSE valid_to - DATE '1970-01-01' END, id) AS rank FROM tagged WHERE section IN ('overdue', 'due', 'stale')) WHERE rank <= 10)
""" .strip() + "\n" + " UNION ALL ".join([
    rows("section", "0", "area", "id", "date", "statement", "FROM tagged WHERE section = 'decisions'"),
    rows("section || ':count'", "0", "NULL", "NULL", "NULL", "count(*)", "FROM tagged WHERE section IN ('closed', 'overdue', 'due') GROUP BY section"),
    rows("section", "rank", "area", "id", "CASE WHEN section = 'stale' THEN date ELSE valid_to END",
         "CASE WHEN section = 'stale' THEN statement ELSE title END", "FROM listed"),
    rows("'milestones'", "0", "name", "NULL", "due", "label", f"""FROM (SELECT name, due1 AS due, 'Hito 1 ' || name AS label FROM projects
      UNION ALL SELECT name, due2, 'Hito 2 ' || name FROM projects) WHERE due BETWEEN {AS_OF} AND {AS_OF} + 14"""),
    rows("'mail:count'", "0", "NULL", "NULL", "NULL", "count(*)", "FROM triage WHERE priority <= 2"), mail(6)]))
SQL["daily_brief"] = with_(["status", "project_items", "people_items", "area_tasks", "triage", "ranked_areas"], f"""
, ev AS (SELECT * FROM kos WHERE ko_type = 'event' AND date BETWEEN {AS_OF} AND {AS_OF} + 3)
, guests AS (SELECT DISTINCT id AS meeting, person AS guest FROM ev WHERE date = {AS_OF})
, mine AS (SELECT *, row_number() OVER (PARTITION BY guest ORDER BY date DESC, id) AS rank FROM (
    SELECT DISTINCT guest, k.id, k.ko_type, k.date, k.statement FROM (SELECT DISTINCT guest FROM guests) g JOIN kos k
    ON contains(lower(k.person), lower(guest)) WHERE status = 'active' AND ko_type IN ('task', 'question', 'decision')))
, asked AS (SELECT *, row_number() OVER (ORDER BY date DESC, id) AS rank FROM kos WHERE ko_type = 'question' AND status = 'active')
""".strip() + "\n" + " UNION ALL ".join([
    rows("'agenda'", f"date - {AS_OF}", "area", "id", "date", "title || ' · con ' || person", "FROM ev"),
    rows("'prep'", "rank", "meeting || '|' || guest", "id", "date", "statement",
         "FROM guests JOIN mine USING (guest) WHERE rank <= 5"),
    PROJECT_BRIEF, PEOPLE_BRIEF,
    rows("'tasks'", "area_rank * 100 + rank", "area", "id", "date", "statement", "FROM area_tasks"), mail(8),
    rows("'questions'", "a.rank * 100 + q.rank", "q.area", "q.id", "q.date", "q.statement",
         "FROM asked q JOIN ranked_areas a ON a.area = q.area WHERE q.rank <= 10")]))
SQL["union_brief"] = with_(["people_items", "project_items"], """
SELECT name, ko_type, rank, id FROM people_items UNION ALL SELECT name, kind, rank, id FROM project_items""")
