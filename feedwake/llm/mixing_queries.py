"""Query of the balanced mix."""

from __future__ import annotations

from feedwake.llm import mixing
from feedwake.llm.common import read


def _mix(spark, folder):
    sizes = mixing.sized(read(spark, folder, "documents")).select("doc_id", "source", "size")
    return mixing.plan(sizes).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


QUERIES = {"op10_cube_mix": _mix}
SQL: dict[str, str] = {}
