"""Attribute profiled CPU time and allocated memory to user-defined functions."""

from stacktally.model import Settings
from stacktally.plans.hotspots import Report, find_hotspots, task_usage
from stacktally.sources.eventlog import (
    app_start, job_events, land_events, read_event_log, stage_events, stream_events, task_events,
)
from stacktally.sources.tables import (
    read_profiles, read_registry, read_report, stream_profiles, write_findings, write_missing,
    write_profiles,
)

__all__ = [
    "Report", "Settings", "app_start", "find_hotspots", "job_events", "land_events",
    "read_event_log",
    "read_profiles", "read_registry", "read_report", "stage_events", "stream_events", "stream_profiles",
    "task_events", "task_usage", "write_findings", "write_missing", "write_profiles",
]
