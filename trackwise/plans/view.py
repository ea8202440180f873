"""PL-06: serving view = positions → tab → search → sort, plus tab counts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from trackwise import fixed
from trackwise.operators import positions as P
from trackwise.operators import view as V
from trackwise.plans.positions import build_positions


def build_view(
    tracker: DataFrame, as_of, tab: str = "Active", q: str = "", sort: str = "interview", tz: str = fixed.DISPLAY_TZ
) -> tuple[DataFrame, DataFrame]:
    """Returns (visible positions in display order, one-row tab counts)."""
    pos = build_positions(tracker, as_of, tz, ordered=False)
    visible = V.search_positions(V.filter_positions(pos, tab), q)
    return P.order_positions(visible, sort), V.tab_counts(pos)
