"""All queries by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shotplane.plans import culling, exporting, files, framing, identity

FLAGSHIP = "judge_marks"
_ALL = [culling.ENTRIES, files.ENTRIES, identity.ENTRIES, exporting.ENTRIES, framing.ENTRIES]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for part in _ALL for k, (f, _) in part.items()}
ORACLES: dict[str, str] = {k: sql for part in _ALL for k, (_, sql) in part.items() if sql}
