"""Work plans kept in sheets (rows of cells) to dated tasks; project dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.text import empty_strings, parse_flexible_date, strip
from ..schemas import KO_COLUMNS
from ..operators.tables import delete_derived, upsert_kos
from ..session import materialize, written


def load_project_dim(raw: DataFrame) -> DataFrame:
    """Projects with an id and a name; undated milestones are dropped, keywords lower-cased."""
    ms = F.filter(F.transform("milestones", lambda m: F.struct(
        m["name"].alias("name"), parse_flexible_date(m["due"]).alias("due"))), lambda m: m["due"].isNotNull() & m["name"].isNotNull())
    return (raw.where("coalesce(id,'') <> '' and coalesce(name,'') <> ''")
            .select("id", "name", "area", parse_flexible_date(F.col("deadline")).alias("deadline"),
                    parse_flexible_date(F.col("start")).alias("start"),
                    F.coalesce(ms, F.array().cast("array<struct<name:string,due:date>>")).alias("milestones"),
                    F.coalesce("people", empty_strings()).alias("people"),
                    F.transform(F.coalesce("keywords", empty_strings()), F.lower).alias("keywords")))


def header_columns(cells: Column) -> Column:
    """Struct of 1-based column numbers per known heading (0 when absent)."""
    low = F.transform(cells, lambda c: F.lower(strip(F.coalesce(c, F.lit("")))))
    fields = []
    for key, words in fixed.PLAN_HEADER_WORDS:
        fields.append(F.array_position(F.transform(low, _names_one_of(words)), True).alias(key))
    return F.struct(*fields)


def _names_one_of(words: list[str]):
    known = F.array(*[F.lit(w) for w in words])
    return lambda c: (c != "") & F.exists(known, lambda w: F.contains(c, w))


def is_header(cols: Column) -> Column:
    found = sum((F.when(cols[k] > 0, 1).otherwise(0) for k, _ in fixed.PLAN_HEADER_WORDS), F.lit(0))
    return (cols["activity"] > 0) & (found >= 2)


def scan_plan_rows(sheets: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(file, sheet, row, cells) to activities: (file, sheet, row, activity, phase, week, start, due, status, …).

    The first row that looks like a header names the columns. Blank rows and capitalised
    phase titles are left out. A task is due on its end date, else at the end of its week
    when the plan's start (``starts``: file, plan_start) is known.
    """
    hinted = F.lower(F.array_join("cells", " ")).rlike("|".join(fixed.PLAN_HEADER_HINTS))
    # written once: the candidate rows are few, and the header test then reads finished columns
    cols = materialize(sheets.where(hinted).select("file", "sheet", "row", header_columns(F.col("cells")).alias("cols")))
    heads = (cols.where(is_header(F.col("cols"))).groupBy("file", "sheet")
             .agg(F.min_by("cols", "row").alias("cols"), F.min("row").alias("head_row")))
    heads = written(heads, "heads")  # one row per sheet, of known size: the cells are not shuffled by their few sheets
    clean = sheets.withColumn("cells", F.transform("cells", strip))
    rows = clean.join(heads, ["file", "sheet"]).where(F.col("row") > F.col("head_row"))

    def cell(key: str) -> Column:
        at = F.col("cols")[key].cast("int")
        return F.nullif(F.get("cells", F.when(at > 0, at - 1)), F.lit(""))

    # cells become columns first, so that the rules below read each of them once
    keys = [k for k, _ in fixed.PLAN_HEADER_WORDS]
    rows = rows.select("file", "sheet", "row", *[cell(k).alias(f"c_{k}") for k in keys]).where("c_activity is not null")
    wk = F.col("c_week")
    week = F.coalesce(F.when(wk.rlike(fixed.WEEK_PATTERN), F.regexp_extract(wk, fixed.WEEK_PATTERN, 1)),
                      F.when(wk.rlike(r"\d{1,2}"), F.regexp_extract(wk, r"(\d{1,2})", 1))).cast("int")
    done = F.lower(F.coalesce("c_status", F.lit(""))).rlike("|".join(fixed.DONE_STEMS))
    out = rows.select(
        "file", "sheet", "row", F.col("c_activity").alias("activity"), F.col("c_phase").alias("phase"), week.alias("week"),
        parse_flexible_date(F.col("c_start")).alias("start"), parse_flexible_date(F.col("c_end")).alias("due"),
        F.when(done, "done").otherwise("active").alias("status"), F.col("c_responsible").alias("responsible"),
        F.col("c_deliverable").alias("deliverable"), F.col("c_priority").alias("priority"))
    a = F.col("activity")
    title_only = (F.upper(a) == a) & (F.lower(a) != a) & (F.size(F.split(a, r"\s+")) > 2)
    out = out.where(~title_only)
    if starts is not None:
        out = out.join(written(starts, "starts"), "file", "left")
        by_week = F.when(F.col("week") > 0, F.date_add("plan_start", F.col("week") * 7 - 1))
        out = out.withColumn("due", F.coalesce("due", by_week)).drop("plan_start")
    return out


def pick_best_sheet(rows: DataFrame) -> DataFrame:
    """Per file, the sheet with most dated activities, then most rows, then the first: by ``sheet_no``
    where the rows have it, else by name."""
    place = F.min(F.struct(F.col("sheet_no") if "sheet_no" in rows.columns else F.lit(0), "sheet")).alias("place")
    dated = F.count_if(F.col("due").isNotNull() | F.coalesce(F.col("week") > 0, F.lit(False)))
    sizes = rows.groupBy("file", "sheet").agg(dated.alias("dated"), F.count(F.lit(1)).alias("n"), place)
    best = sizes.groupBy("file").agg(F.max(F.struct("dated", "n")).alias("top"))
    kept = (sizes.join(best, "file").where((F.col("dated") == F.col("top.dated")) & (F.col("n") == F.col("top.n")))
            .groupBy("file").agg(F.min("place").alias("p")).select("file", F.col("p.sheet").alias("sheet")))
    return rows.join(kept, ["file", "sheet"], "left_semi")


def import_plan_tasks(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Activities to task objects. ``plans``: (file, doc_id, doc_date, project_id, project, people, area).

    Ids follow from project, activity and week, so a second import gives the same rows.
    """
    r = rows.join(written(plans, "plans"), "file")
    digest = F.substring(F.sha1(F.concat_ws("|", "project_id", "activity", F.coalesce(F.col("week").cast("string"), F.lit("None")))), 1, 12)
    tags = F.filter(F.array(F.col("phase"), F.concat(F.lit("prioridad:"), F.lower("priority"))), lambda x: x.isNotNull())
    own = F.coalesce("responsible", F.lit("")).isin("", "IP")
    detail = F.coalesce(F.concat(F.lit(" — entregable: "), "deliverable"), F.lit(""))
    out = r.select(
        F.concat(F.lit("ko-plan-"), digest).alias("id"), F.lit("task").alias("ko_type"), F.substring("activity", 1, 80).alias("title"),
        F.concat("activity", detail).alias("statement"), F.coalesce("start", "due", "doc_date").alias("date"),
        F.when(own, F.col("people")).otherwise(empty_strings()).alias("people"), "project", "status",
        F.lit("confirmed").alias("confidence"), F.col("doc_id").alias("source_doc"), tags.alias("tags"),
        F.col("start").alias("valid_from"), F.col("due").alias("valid_to"), "area", "row")
    # the last row of a repeated activity stays, as with replace-by-id; dealt by id first, so that no task
    # sorts all whole rows of its input before the shuffle
    packed = F.struct(*[c for c in KO_COLUMNS if c != "id"])
    return out.repartition("id").groupBy("id").agg(F.max_by(packed, F.struct("row", "statement")).alias("k")).select("id", "k.*").select(*KO_COLUMNS)


def replace_plan(kos: DataFrame, edges: DataFrame, rows: DataFrame, plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kos, edges) with the tasks of the given plans in place of what these yielded before: a task that
    has left the sheet leaves the table."""
    kept, kept_edges, _ = delete_derived(kos, edges, plans.select(F.col("doc_id").alias("id")))
    return upsert_kos(kept, import_plan_tasks(rows, plans)), kept_edges
