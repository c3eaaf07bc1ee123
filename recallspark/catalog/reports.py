"""Queries over report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..adapters import AS_OF, Tables
from ..operators import people as P
from ..plans import reports as R
from ..registry import query
from ..sources.plan_sheets import load_project_dim
from .memory import _ranked_areas, _triaged


def _projects(t: Tables) -> DataFrame:
    return load_project_dim(t.projects())


@query
def project_status(t: Tables) -> DataFrame:
    return R.project_status(t.kos(), _projects(t), AS_OF)


@query
def project_cards(t: Tables) -> DataFrame:
    return R.project_cards(R.project_status(t.kos(), _projects(t), AS_OF))


@query
def top_items_per_project(t: Tables) -> DataFrame:
    return R.top_items_per_project(t.kos(), _projects(t), AS_OF).select("name", "kind", "rank", "id")


@query
def project_brief(t: Tables) -> DataFrame:
    return R.project_brief(t.kos(), _projects(t), AS_OF)


@query
def key_people_brief(t: Tables) -> DataFrame:
    return R.key_people_brief(t.kos(), t.pinned(), AS_OF)


@query
def top_tasks_per_area(t: Tables) -> DataFrame:
    return R.top_tasks_per_area(t.kos(), _ranked_areas(t)).select("area", "area_rank", "rank", "id", "date")


@query
def week_review(t: Tables) -> DataFrame:
    return R.week_review(t.kos(), _projects(t), _triaged(t), AS_OF)


@query
def daily_brief(t: Tables) -> DataFrame:
    return R.daily_brief(t.kos(), _projects(t), t.pinned(), _ranked_areas(t), _triaged(t), AS_OF)


@query
def union_brief(t: Tables) -> DataFrame:
    items = P.top_items_per_person(P.person_brief_items(t.kos(), t.pinned(), AS_OF)).select("name", "ko_type", "rank", "id")
    projects = R.top_items_per_project(t.kos(), _projects(t), AS_OF).withColumnRenamed("kind", "ko_type").select("name", "ko_type", "rank", "id")
    return R.union_brief([items, projects])
