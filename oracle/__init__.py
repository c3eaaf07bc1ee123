"""DuckDB statements with the expected result of every query that plain SQL can express."""


def all_sql() -> dict[str, str]:
    from . import ingest, memory, reports, search
    return {**memory.SQL, **search.SQL, **reports.SQL, **ingest.SQL}
