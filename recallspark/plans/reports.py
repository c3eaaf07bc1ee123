"""Report tables: (report, section, rank, item_id, date, text), one row per line of a report."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.people import person_brief_items, top_items_per_person
from ..operators.retrieval import newest
from ..operators.scale import contains_pairs, top_per_group


def _rows(df: DataFrame, section: str | Column, rank: Column, owner: Column, item: Column, date: Column, text: Column) -> DataFrame:
    section = F.lit(section) if isinstance(section, str) else section
    return df.select(section.alias("section"), rank.cast("bigint").alias("rank"), owner.cast("string").alias("owner"),
                     item.cast("string").alias("item_id"), date.cast("date").alias("date"), text.cast("string").alias("text"))


def _union(parts: list[DataFrame]) -> DataFrame:
    """Sections one after another."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


union_brief = _union


def open_task(c_status: str = "status") -> Column:
    return (F.col("ko_type") == "task") & (F.col(c_status) == "active")


# -- projects ----------------------------------------------------------------------


def project_status(kos: DataFrame, projects: DataFrame, as_of: dt.date) -> DataFrame:
    """Figures per project in one conditional pass over the objects."""
    today, due = F.lit(as_of), F.col("valid_to")
    counted = kos.where("project is not null and ko_type in ('task', 'question')").groupBy("project").agg(
        F.count_if(F.col("ko_type") == "task").alias("tasks"),
        F.count_if((F.col("ko_type") == "task") & (F.col("status") == "done")).alias("done"),
        F.count_if(open_task()).alias("active"), F.count_if(open_task() & (due < today)).alias("overdue"),
        F.count_if(open_task() & due.between(today, F.date_add(today, 7))).alias("due_soon"),
        F.count_if((F.col("ko_type") == "question") & (F.col("status") == "active")).alias("questions"))
    coming = F.array_sort(F.transform(F.filter("milestones", lambda m: m["due"] >= today),
                                      lambda m: F.struct(m["due"].alias("due"), m["name"].alias("name"))))
    p = projects.withColumn("next", F.get(coming, F.lit(0)))
    out = p.join(counted, p["name"] == counted["project"], "left").drop("project")
    return (out.fillna(0, ["tasks", "done", "active", "overdue", "due_soon", "questions"])
            .withColumn("days_to_deadline", F.datediff("deadline", today))
            .withColumn("next_milestone", F.col("next.name")).withColumn("next_due", F.col("next.due"))
            .select("id", "name", "area", "deadline", "days_to_deadline", "tasks", "done", "active", "overdue",
                    "due_soon", "questions", "next_milestone", "next_due"))


def project_cards(status: DataFrame) -> DataFrame:
    return status.select("id", "name", "area", "deadline", "days_to_deadline", "tasks", "done", "overdue", "due_soon",
                         "next_milestone", "next_due")


def project_items(kos: DataFrame, projects: DataFrame, as_of: dt.date) -> DataFrame:
    """(name, kind, id, …) of overdue tasks, tasks due within a week and open questions."""
    today, due = F.lit(as_of), F.col("valid_to")
    kind = (F.when(open_task() & (due < today), "overdue")
            .when(open_task() & due.between(today, F.date_add(today, 7)), "due_soon")
            .when((F.col("ko_type") == "question") & (F.col("status") == "active"), "question"))
    named = projects.select("name").distinct()
    return (kos.withColumn("kind", kind).where("kind is not null")
            .join(named, F.col("project") == F.col("name"), "left_semi")
            .select(F.col("project").alias("name"), "kind", "id", "title", "statement", "date", "valid_to"))


def top_items_per_project(kos: DataFrame, projects: DataFrame, as_of: dt.date,
                          overdue: int = 5, due_soon: int = 5, questions: int = 2) -> DataFrame:
    items = project_items(kos, projects, as_of)
    day = F.datediff(F.when(F.col("kind") == "question", F.col("date")).otherwise(F.col("valid_to")), F.lit("1970-01-01"))
    order = F.when(F.col("kind") == "question", -day).otherwise(day)
    ranked = top_per_group(items, ["name", "kind"], [order, F.col("id")], max(overdue, due_soon, questions))
    cap = F.when(F.col("kind") == "overdue", overdue).when(F.col("kind") == "due_soon", due_soon).otherwise(questions)
    return ranked.where(F.col("rank") <= cap)


def project_brief(kos: DataFrame, projects: DataFrame, as_of: dt.date) -> DataFrame:
    """Head line, next milestone and top items of every project."""
    status = project_status(kos, projects, as_of)
    bits = F.concat_ws(" · ",
                       F.concat(F.lit("entrega en "), F.col("days_to_deadline").cast("string"), F.lit(" días ("),
                                F.col("deadline").cast("string"), F.lit(")")),
                       F.when(F.col("tasks") > 0, F.concat(F.col("done").cast("string"), F.lit("/"), F.col("tasks").cast("string"),
                                                           F.lit(" actividades hechas"))))
    none = F.lit(None)
    head = _rows(status, "project", F.lit(0), F.col("name"), F.col("id"), F.col("deadline"), bits)
    ms = status.where("next_milestone is not null")
    milestone = _rows(ms, "project:milestone", F.lit(1), F.col("name"), F.col("id"), F.col("next_due"), F.col("next_milestone"))
    items = top_items_per_project(kos, projects, as_of)
    text = F.when(F.col("kind") == "question", F.col("statement")).otherwise(F.col("title"))
    day = F.when(F.col("kind") == "question", F.col("date")).otherwise(F.col("valid_to"))
    rows = _rows(items, F.concat(F.lit("project:"), "kind"), F.col("rank"), F.col("name"), F.col("id"), day, text)
    quiet = status.where("next_milestone is null and overdue = 0 and due_soon = 0 and questions = 0")
    calm = _rows(quiet, "project:quiet", F.lit(1), F.col("name"), none, none, F.lit("Sin hitos ni vencimientos próximos registrados."))
    return _union([head, milestone, rows, calm])


# -- people --------------------------------------------------------------------------


def key_people_brief(kos: DataFrame, pinned: DataFrame, as_of: dt.date) -> DataFrame:
    """Head line and items of every pinned person."""
    items = top_items_per_person(person_brief_items(kos, pinned, as_of))
    none = F.lit(None)
    head = _rows(pinned, "person", F.lit(0), F.col("name"), none, none, F.col("role"))
    text = F.when(F.col("ko_type") == "event", F.col("title")).otherwise(F.col("statement"))
    rows = _rows(items, F.concat(F.lit("person:"), "ko_type"), F.col("rank"), F.col("name"), F.col("id"), F.col("date"), text)
    idle = pinned.join(items.select("name").distinct(), "name", "left_anti")
    calm = _rows(idle, "person:quiet", F.lit(1), F.col("name"), none, none, F.lit("Sin pendientes registrados con esta persona."))
    return _union([head, rows, calm])


# -- areas -----------------------------------------------------------------------------


def top_tasks_per_area(kos: DataFrame, ranked_areas: DataFrame, n: int = 8) -> DataFrame:
    """Newest open tasks per area, areas in rank order (an unknown area comes last, 999)."""
    top = top_per_group(kos.where(open_task()), ["area"], [newest(), F.asc("id")], n)
    ranks = ranked_areas.select("area", F.col("rank").alias("area_rank"))
    return top.join(ranks, "area", "left").withColumn("area_rank", F.coalesce("area_rank", F.lit(999)))


# -- week and day ------------------------------------------------------------------------


def urgent_mail(triaged: DataFrame, section: str, n: int) -> DataFrame:
    top = (triaged.where("priority <= 2").withColumn("one", F.lit(1)))
    top = top_per_group(top, ["one"], [F.asc("priority"), F.desc("score"), F.asc("id")], n)
    text = F.concat(F.lit("P"), F.col("priority").cast("string"), F.lit(" · "), "subject", F.lit(" — "), "from")
    return _rows(top, section, F.col("rank"), F.lit(None), F.col("id"), F.to_date("date"), text)


def week_review(kos: DataFrame, projects: DataFrame, triaged: DataFrame, as_of: dt.date) -> DataFrame:
    """What was decided, closed, got late and comes next; ``…:count`` rows carry the totals."""
    today, day, due = F.lit(as_of), F.col("date"), F.col("valid_to")
    task = F.col("ko_type") == "task"
    question = (F.col("ko_type") == "question") & (F.col("status") == "active")
    section = (F.when((F.col("ko_type") == "decision") & (day >= F.date_sub(today, 7)), "decisions")
               .when(task & (F.col("status") == "done") & (day >= F.date_sub(today, 7)), "closed")
               .when(open_task() & (due < today), "overdue")
               .when(open_task() & due.between(today, F.date_add(today, 7)), "due")
               .when(question & (day <= F.date_sub(today, 30)), "stale"))
    tagged = kos.withColumn("section", section).where("section is not null")
    counts = tagged.groupBy("section").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None)
    totals = _rows(counts.where("section in ('closed', 'overdue', 'due')"), F.concat("section", F.lit(":count")), F.lit(0),
                   none, none, none, F.col("n"))
    numbered = F.datediff(F.when(F.col("section").isin("overdue", "due"), due).otherwise(day), F.lit("1970-01-01"))
    order = F.when(F.col("section").isin("overdue", "due"), numbered).otherwise(-numbered)
    listed = top_per_group(tagged.where("section in ('overdue', 'due', 'stale')"), ["section"], [order, F.col("id")], 10)
    text = F.when(F.col("section").isin("overdue", "due"), F.col("title")).otherwise(F.col("statement"))
    when = F.when(F.col("section").isin("overdue", "due"), due).otherwise(day)
    lines = _rows(listed, F.col("section"), F.col("rank"), F.col("area"), F.col("id"), when, text)
    decisions = _rows(tagged.where("section = 'decisions'"), "decisions", F.lit(0), F.col("area"), F.col("id"), day, F.col("statement"))
    ms = projects.select("name", F.explode("milestones").alias("m")).where(
        F.col("m.due").between(today, F.date_add(today, 14)))
    milestones = _rows(ms, "milestones", F.lit(0), F.col("name"), none, F.col("m.due"), F.col("m.name"))
    mails = triaged.where("priority <= 2").agg(F.count(F.lit(1)).alias("n"))
    mail_total = _rows(mails, "mail:count", F.lit(0), none, none, none, F.col("n"))
    return _union([decisions, totals, lines, milestones, mail_total, urgent_mail(triaged, "mail", 6)])


def daily_brief(kos: DataFrame, projects: DataFrame, pinned: DataFrame, ranked_areas: DataFrame, triaged: DataFrame,
                as_of: dt.date, horizon_days: int = 3) -> DataFrame:
    """Agenda, meeting preparation, projects, key people, tasks by area, urgent mail, open questions."""
    today, day = F.lit(as_of), F.col("date")
    events = kos.where(F.col("ko_type") == "event").where(day.between(today, F.date_add(today, horizon_days)))
    who = F.when(F.size("people") > 0, F.concat(F.lit(" · con "), F.array_join("people", ", "))).otherwise("")
    agenda = _rows(events, "agenda", F.datediff(day, today), F.col("area"), F.col("id"), day, F.concat("title", who))
    ranks = ranked_areas.select("area", F.col("rank").alias("area_rank"))
    rank_of = F.coalesce("area_rank", F.lit(999))
    tasks = top_tasks_per_area(kos, ranked_areas)
    task_rows = _rows(tasks, "tasks", F.col("area_rank") * 100 + F.col("rank"), F.col("area"), F.col("id"), day, F.col("statement"))
    asked = top_per_group(kos.where("ko_type = 'question' and status = 'active'").withColumn("one", F.lit(1)), ["one"],
                          [newest(), F.asc("id")], 10)
    asked = asked.join(ranks, "area", "left")
    questions = _rows(asked, "questions", rank_of * 100 + F.col("rank"), F.col("area"), F.col("id"), day, F.col("statement"))
    return _union([agenda, meeting_prep(kos, events.where(day == today)), project_brief(kos, projects, as_of),
                   key_people_brief(kos, pinned, as_of), task_rows, urgent_mail(triaged, "mail", 8), questions])


def meeting_prep(kos: DataFrame, todays: DataFrame, n: int = 5) -> DataFrame:
    """The newest active tasks, questions and decisions of each guest of today's meetings. Guests are
    matched by name as a substring, on distinct names."""
    guests = todays.select(F.col("id").alias("meeting"), F.explode("people").alias("guest")).distinct()
    active = kos.where("status = 'active' and ko_type in ('task', 'question', 'decision')").select("id", "ko_type", "date", "statement", F.explode("people").alias("who"))
    active = active.withColumn("low", F.lower("who"))
    names = guests.select("guest", F.lower("guest").alias("needle")).distinct()
    pairs = contains_pairs(active.select("low"), names.select("needle")).join(names, "needle")
    mine = (active.join(pairs.select(F.col("hay").alias("low"), "guest"), "low")
            .select("guest", "id", "ko_type", "date", "statement").distinct())
    top = top_per_group(mine, ["guest"], [newest(), F.asc("id")], n)
    rows = guests.join(top, "guest")
    return _rows(rows, "prep", F.col("rank"), F.concat_ws("|", "meeting", "guest"), F.col("id"), F.col("date"), F.col("statement"))
