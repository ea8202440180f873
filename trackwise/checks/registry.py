"""Registered queries: name → (Spark callable, DuckDB oracle SQL or None).

Each Spark callable takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole driver tables (through the adapters). Column names match the oracle's.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwise.checks import oracles as O
from trackwise.operators import positions as P
from trackwise.plans.positions import build_positions
from trackwise.plans.refresh import PositionsView
from trackwise.session import checkpoint_dir
from trackwise.sources import adapters as A

_SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        _SPARK[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return deco


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(_SPARK)


def oracle_queries() -> dict[str, str]:
    _load_all()
    return dict(_SQL)


def _load_all() -> None:
    # query families register themselves on import
    from trackwise.checks import q_backfill, q_digest, q_ingest, q_repair, q_text, q_view  # noqa: F401


# ---------------------------------------------------------------------------
# positions family (PL-04 and its parts)
# ---------------------------------------------------------------------------


def _positions(spark: SparkSession, sf_dir: str, ordered: bool = True) -> DataFrame:
    return build_positions(A.tracker(spark, sf_dir), A.TRACKER_AS_OF, ordered=ordered)


@register("positions", O.positions_sql())
def positions(spark, sf_dir):
    """PL-04 (AG-01..06, WN-01..03, JN-07, FN-14..17, FLT-05..08, SO-01)."""
    return _positions(spark, sf_dir).select(*P.POSITION_COLUMNS)


@register("active_positions", O.positions_sql(where="NOT " + O.D.is_terminal("category", "status")))
def active_positions(spark, sf_dir):
    """Step-1 slice of the build plan: open positions, default order (FLT-09 Active)."""
    from trackwise.functions import text as T

    pos = _positions(spark, sf_dir)
    return pos.filter(~T.is_terminal("category", "status")).select(*P.POSITION_COLUMNS)


@register("refresh_positions", O.positions_sql())
def refresh_positions(spark, sf_dir):
    """SM-08: the tracker taken in by three batches of rows, each refreshing what it touches."""
    rows = A.tracker(spark, sf_dir)
    last = rows.agg(F.max("seq")).first()[0] or 0  # one number
    view = PositionsView(spark, f"{checkpoint_dir(spark)}/positions-{uuid.uuid4().hex}")
    bounds = [-1, last * 8 // 10, last * 9 // 10, last]
    for low, high in zip(bounds, bounds[1:]):
        view.refresh(rows.filter((F.col("seq") > low) & (F.col("seq") <= high)), A.TRACKER_AS_OF)
    return view.positions(A.TRACKER_AS_OF).select(*P.POSITION_COLUMNS)


@register("cluster_keys", O.cluster_keys_sql())
def cluster_keys(spark, sf_dir):
    """JN-07 (+ AG-01 key, rank inputs)."""
    ev = P.assign_clusters(A.tracker(spark, sf_dir))
    return ev.select(F.col("gkey").alias("key"), F.col("cluster").alias("canonical"), "cnt", "first_seen").distinct()


@register("segments", O.segments_sql())
def segments(spark, sf_dir):
    """WN-01 (+ FLT-06): segment number of every tracker row."""
    ev = P.segment_events(P.assign_clusters(A.tracker(spark, sf_dir)))
    return ev.select("seq", "cluster", "seg", "is_boundary")
