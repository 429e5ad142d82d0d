"""The registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from actionline.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *names: str, sql: str | None = None) -> Callable:
    """Registers a function of the views (or tables) in names; sql reads the same names."""

    def load(spark: SparkSession, sf_dir: str, n: str) -> DataFrame:
        return views.view(spark, sf_dir, n) if n.startswith("v_") else spark.read.parquet(f"{sf_dir}/{n}.parquet")

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*(load(spark, sf_dir, n) for n in names))
        if sql:
            used = [n for n in names if n.startswith("v_")]
            head = ", ".join(f"{n} AS ({views.text(n, twin=True)})" for n in used)
            body = sql.strip()
            if head:
                word = next((w for w in ("WITH RECURSIVE ", "WITH ") if body.startswith(w)), "")
                body = f"{word}{head}, {body[len(word):]}" if word else f"WITH {head} {body}"
            ORACLES[name] = body
        return f

    return register


def _load() -> None:
    from actionline.plans import annotate_queries, assemble_queries, explore_queries, frame_queries, package_queries, score_queries, source_queries, timeline_queries  # noqa: F401


_load()
