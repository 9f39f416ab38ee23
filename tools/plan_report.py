"""Write the physical plans of the cleaning stages and a few catalog queries
to a Markdown file (default PLANS.md), for review of the plan shapes.

Usage: python tools/plan_report.py [sf_dir] [out.md]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    out_path = sys.argv[2] if len(sys.argv) > 2 else "PLANS.md"
    from cadence.operators import clean as K
    from cadence.operators.features import add_features
    from cadence.plans import catalog
    from cadence.plans.inspect import plan_text
    from cadence.plans.prepare import prepared
    from cadence.plans.session import build_session

    spark = build_session()
    p = prepared(spark, sf_dir)
    q = catalog.queries()
    sections = [
        ("Stage 1: station names of the matched rides", K.station_names(p.matched_rides())),
        ("Stage 2: both station lookups in one aggregation (first name per id, tie flag)", K.first_names(p.names)),
        ("Stage 3: fills, completeness filter, features (written as complete_rides)", add_features(K.drop_incomplete_rides(p.filled()))),
    ]
    from cadence.operators.cube import summary_tables

    sections.append(
        ("Stage 4: ride cube and station table from one grouping-sets scan (split and written)", summary_tables(p.cleaned))
    )
    for name in [
        "average_ride_length_by_day",
        "ride_length_stats",
        "station_utilization",
        "top_start_stations",
        "top_start_stations_by_member",
        "top_utilized_stations",
        "ride_length_boxplot",
        "stack_positions",
        "is_in_column",
    ]:
        sections.append((f"Query `{name}`", q[name](spark, sf_dir)))
    scrub = lambda s: re.sub(r"#\d+L?", "", re.sub(r"file:[^,\]]*", "<table>", s))
    lines = [
        "# Physical plans",
        "",
        "Generated by `tools/plan_report.py` (simple physical plans, expression ids removed).",
        "The cleaning stages read the raw adapter; queries read the written `complete_rides` table.",
        "",
    ]
    for title, df in sections:
        lines += [f"## {title}", "", "```", scrub(plan_text(df, "simple")).strip(), "```", ""]
    with open(out_path, "w") as f:
        f.write("\n".join(lines))
    print("wrote", out_path)


if __name__ == "__main__":
    main()
