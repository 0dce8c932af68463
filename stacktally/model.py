"""Schemas, fixed values and settings shared by all modules."""

from __future__ import annotations

from dataclasses import dataclass

# Profile types, reserved frame name, units and origins.
CPU_PROFILE = "process_cpu:cpu:nanoseconds:cpu:nanoseconds"
MEM_PROFILE = "memory:alloc_in_new_tlab_bytes:bytes:space:bytes"
TOTAL_FRAME = "total"
JOB, TASK = "job", "task"
CPU, MEM = "CPU", "MEM"
NANOS_PER_SECOND = 1e9
BYTES_PER_MIB = 1048576.0
API_ORIGINS = ("udf", "udaf")
DDL_ORIGIN = "ddl"

# A level is a flat run of 4-tuples: offset, inclusive value, self value, name index.
FRAME_STRIDE = 4

PROFILE_RAW = (
    "app_id STRING, service_name STRING, id BIGINT, job_id BIGINT, ts TIMESTAMP, "
    "body STRING, profile_type STRING, unit STRING"
)
# One top-level field: the optimizer would split a wider schema into one parse per field.
BODY = (
    "flamebearer STRUCT<names: ARRAY<STRING>, levels: ARRAY<ARRAY<BIGINT>>>"
)
BODY_NAMES = "flamebearer STRUCT<names: ARRAY<STRING>>"
LOG_LINE = "app_id STRING, value STRING"
REGISTRY = "app_id STRING, seq BIGINT, udf STRING, impl STRING, origin STRING"
USAGE = (
    "app_id STRING, unit STRING, id BIGINT, metric STRING, udf STRING, "
    "is_total BOOLEAN, value DOUBLE, ts TIMESTAMP"
)

# Why a profile cannot be used.
REJECT_REASONS = (
    "bad_json", "no_flamebearer", "no_names", "no_levels", "wrong_type", "empty",
    "no_first_total", "zero_total", "ragged_level",
)
# One profile snapshot.
PROFILE_KEY = ["app_id", "profile_type", "unit", "id", "ts"]


@dataclass(frozen=True)
class Settings:
    """Thresholds in percent, times in milliseconds."""

    cpu_threshold: float = 25.0
    mem_threshold: float = 25.0
    upload_interval_ms: int = 1000
    poll_attempts: int = 10
    poll_pause_ms: int = 1000
    poll_timeout_ms: int = 10000

    @property
    def give_up_ms(self) -> int:
        """How long after a task's end its profile may still arrive."""
        return self.upload_interval_ms + min(
            self.poll_attempts * self.poll_pause_ms, self.poll_timeout_ms
        )
