"""DataFrame -> DataFrame operators: cleaning (lookups, fills, filters),
features, the pre-aggregated ride cube and station table, grouped summaries,
rankings, chart statistics, quality reports and the printed recap."""
