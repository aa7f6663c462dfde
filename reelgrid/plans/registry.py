"""All registered queries with their check SQL, where there is one."""

from __future__ import annotations

import importlib

FAMILIES = ("search_queries", "retrieval_queries", "library_queries", "session_queries", "job_queries",
            "text_queries", "media_queries", "capture_queries", "stream_queries")


def all_queries() -> dict:
    found = {}
    for family in FAMILIES:
        found.update(importlib.import_module(f"reelgrid.plans.{family}").QUERIES)
    return found
