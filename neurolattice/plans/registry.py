"""Queries by name, and their DuckDB SQL. A query is registered where it is built, SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Views over the driver's tables, in SQL; views.py has the same in DataFrame operations.
VIEWS = {
    "epochs": "SELECT vec_id AS epoch, label::BIGINT AS condition, (i // 8)::BIGINT AS ch, (i % 8)::BIGINT AS t, v AS value FROM (SELECT vec_id, label, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)",
    "signal": "SELECT user_id AS ch, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS samp, value, (CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 5 END)::BIGINT AS code FROM events",
    "markers": "SELECT samp, coalesce(lag(id) OVER (ORDER BY ts, event_id), 0)::BIGINT AS prev_id, id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row FROM (SELECT ts, event_id, (epoch_us(ts) // 1000000 - (SELECT min(epoch_us(ts)) // 1000000 FROM events))::BIGINT AS samp, (CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END)::BIGINT AS id FROM events)",
    "annots": "SELECT user_id AS rec, (epoch_us(ts) // 1000000 - (SELECT min(epoch_us(ts)) // 1000000 FROM events))::DOUBLE AS onset, floor(value) * 60 AS duration, CASE WHEN event_type = 'error' THEN 'BAD_error' ELSE event_type END AS description, event_id FROM events",
}


def query(name: str, sql: str | None = None, views: str = ""):
    """Registers a builder (spark, sf_dir) -> DataFrame; integers come out as long, floats as double."""

    def add(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = build(spark, sf_dir)
            wide = {"int": "long", "smallint": "long", "tinyint": "long", "float": "double"}
            return out.select(*(F.col(f"`{c}`").cast(wide[k]).alias(c) if k in wide else F.col(f"`{c}`") for c, k in out.dtypes))

        run.__name__, run.__doc__ = name, build.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql:
            ctes = [f"{v} AS ({VIEWS[v]})" for v in views.split()]
            body = sql.strip()
            if ctes:
                again = body[:15].upper() == "WITH RECURSIVE "
                body = ("WITH RECURSIVE " if again else "WITH ") + ", ".join(ctes) + (", " + body[15 if again else 5 :] if body[:5].upper() == "WITH " else " " + body)
            ORACLE[name] = body
        return build

    return add


def r6(column):
    """Rounded to six decimals, without negative zeros: the same in both engines."""
    return F.round(column, 6) + F.lit(0.0)


from . import queries_artifacts, queries_assemble, queries_blocks, queries_clusters, queries_covariance, queries_events, queries_files, queries_inverse, queries_kernels, queries_mesh, queries_models, queries_more, queries_regression, queries_signal, queries_stats  # noqa: E402, F401
