"""Plan checks: read the physical plan text of a DataFrame.

Used by tests and by ``tools/plan_report.py`` to confirm the plan shape we
rely on at scale (broadcast fills, hash aggregation, pushed filters, partial
window limits, no Python evaluation).
"""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas")


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def operators(df: DataFrame) -> list[str]:
    """Operator names of the physical plan (tree part of the formatted plan)."""
    names = []
    for line in plan_text(df, "formatted").split("\n\n")[0].splitlines()[1:]:
        token = line.strip(" :+-")
        if token:
            names.append(token.split(" (")[0].strip())
    return names


def has_python(df: DataFrame) -> bool:
    text = plan_text(df, "simple")
    return any(n in text for n in PYTHON_NODES)
