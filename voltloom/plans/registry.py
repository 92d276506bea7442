"""All named queries of the core, and their SQL."""

from __future__ import annotations

from importlib import import_module

from . import catalogue, problems, problems_sql

for _name in ("graphs", "joins", "validation", "models", "files", "shapes", "more", "runs"):
    try:
        import_module(f"{__package__}.{_name}")
    except ModuleNotFoundError as e:
        if e.name != f"{__package__}.{_name}":
            raise


def queries() -> dict:
    return {n: f for n, f in vars(problems).items() if n[:1] == "p" and n[1:2].isdigit()} | catalogue.QUERIES


def oracle_sql() -> dict[str, str]:
    return problems_sql.SQL | catalogue.SQL
