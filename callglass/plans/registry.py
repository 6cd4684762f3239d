"""What a registered query is."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from callglass.sources.given import Given

# Fixed moments, so that runs repeat.
START = "2024-01-01 00:00:00"
SINCE = "2024-01-20 00:00:00"
AS_OF = "2024-01-30 12:00:00"
NEVER = "2030-01-01 00:00:00"


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Given], DataFrame]
    sql: str | None = None
