"""PL-04: tracker rows → positions (key → cluster → segment → rollup → order)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from trackwise import fixed
from trackwise.operators import positions as P
from trackwise.session import stored


def build_positions(
    tracker: DataFrame,
    as_of,
    tz: str = fixed.DISPLAY_TZ,
    min_contain: int = fixed.CONTAIN_MIN_LEN,
    min_len: int = 0,
    ordered: bool = True,
    key_map: DataFrame | None = None,
) -> DataFrame:
    # keys, ranges and rows are each taken from the tracker: worked out once
    tracker = stored(tracker.select(*P.ROW_COLUMNS), "tracker")
    ev = P.assign_clusters(tracker, min_contain, min_len, key_map)
    # the segmented events feed five aggregations: stored by column, each reads its own columns only
    ev = stored(P.segment_events(ev.select(*P.EVENT_COLUMNS)), "segments")
    pos = P.position_rollup(ev, as_of, tz).join(P.cluster_rank(ev), "cluster")
    # a sort by ranges reads its input twice
    return P.order_positions(stored(pos, "positions")) if ordered else pos
