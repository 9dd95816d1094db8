"""DataFrame operators: deduplication, as-of joins, change feeds, history, merge, exposure."""

from lakewright.operators.asof import fx_join, fx_spine, last_before, point_in_time, validity_windows
from lakewright.operators.cdc import cdc_current, fill_from
from lakewright.operators.dedupe import dedupe_latest, record_hash
from lakewright.operators.exposure import earned_premium, written_premium
from lakewright.operators.harmonise import harmonise
from lakewright.operators.merge import lookback, merge_upsert
from lakewright.operators.rollup import distinct_counts, distinct_state, merged_distinct, merged_values, percentiles, span_counts, span_state, value_state
from lakewright.operators.scd2 import as_of_view, history_of_changes, overlapping_windows, scd2_apply

__all__ = [
    "as_of_view", "cdc_current", "dedupe_latest", "distinct_counts", "distinct_state", "earned_premium", "fill_from", "fx_join", "fx_spine", "harmonise", "history_of_changes", "last_before", "lookback",
    "merge_upsert", "merged_distinct", "merged_values", "overlapping_windows", "percentiles", "point_in_time", "record_hash", "scd2_apply", "span_counts", "span_state", "validity_windows", "value_state", "written_premium",
]
