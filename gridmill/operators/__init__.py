from gridmill.operators.completeness import dropped_by_position, missing_steps, time_steps
from gridmill.operators.messages import (
    assign_position,
    assign_time,
    discover_variables,
    file_counts,
    file_facts,
    file_year,
    label_by_position,
    legacy_first_step,
    messages_per_day,
    number_by_range,
    number_messages,
    strides,
    value_at,
)
from gridmill.operators.monthly import (
    dense_months,
    first_file_names,
    first_file_schema,
    keep_last_files,
    keep_last_per_year,
    replaced_files,
    monthly_mean,
    monthly_mean_wide,
    monthly_table,
    monthly_wide,
)
from gridmill.operators.periods import discover_periods, find_periods, with_keys
from gridmill.operators.series import (
    missing_variables,
    select_summary,
    select_variables,
    series_span,
    trend_series,
    trend_series_long,
)
from gridmill.operators.yearly import (
    distinct_years,
    interleave_stats,
    sort_years,
    valid_years,
    variable_columns,
    year_spine,
    year_spine_join,
    yearly_long,
    yearly_stats,
    yearly_wide,
)

__all__ = [
    "discover_periods",
    "dropped_by_position",
    "missing_steps",
    "number_by_range",
    "find_periods",
    "time_steps",
    "with_keys",
    "assign_position",
    "assign_time",
    "dense_months",
    "discover_variables",
    "distinct_years",
    "file_counts",
    "file_facts",
    "file_year",
    "first_file_names",
    "first_file_schema",
    "interleave_stats",
    "keep_last_files",
    "keep_last_per_year",
    "replaced_files",
    "label_by_position",
    "legacy_first_step",
    "messages_per_day",
    "missing_variables",
    "monthly_mean",
    "monthly_mean_wide",
    "monthly_table",
    "monthly_wide",
    "number_messages",
    "select_summary",
    "select_variables",
    "series_span",
    "sort_years",
    "strides",
    "trend_series",
    "trend_series_long",
    "valid_years",
    "value_at",
    "variable_columns",
    "year_spine",
    "year_spine_join",
    "yearly_long",
    "yearly_stats",
    "yearly_wide",
]
