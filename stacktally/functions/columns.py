"""Column expressions: Column in, Column out, all built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stacktally import model as m


def metric_of(profile_type: Column) -> Column:
    return F.when(profile_type == m.CPU_PROFILE, m.CPU).when(
        profile_type == m.MEM_PROFILE, m.MEM
    )


def impl_path(impl: Column) -> Column:
    """Class name as it is spelled inside a stack frame."""
    return F.replace(impl, F.lit("."), F.lit("/"))


def cpu_seconds(nanos: Column) -> Column:
    return nanos.cast("double") / F.lit(m.NANOS_PER_SECOND)


def mem_mib(n_bytes: Column) -> Column:
    return n_bytes.cast("double") / F.lit(m.BYTES_PER_MIB)


def in_units(metric: Column, raw: Column) -> Column:
    """Seconds for CPU, MiB for memory."""
    return F.when(metric == m.CPU, cpu_seconds(raw)).otherwise(mem_mib(raw))


def percent(value: Column, total: Column) -> Column:
    """Share of the total. A positive value over a zero total is infinite, 0/0 is null."""
    sign = F.signum(value)
    infinite = F.when(sign != 0, sign * F.lit(float("inf")))
    return F.when(total == 0, infinite).otherwise(
        F.try_divide(value, total) * F.lit(100.0)
    )


def threshold_of(metric: Column, cpu: float, mem: float) -> Column:
    return F.when(metric == m.CPU, F.lit(float(cpu))).otherwise(F.lit(float(mem)))


def selector_text(profile_type: Column, service: Column, unit: Column, id_: Column) -> Column:
    """The label selector that names one profile, for audit columns."""
    return F.format_string(
        '%s{service_name="%s",%s="%s"}', profile_type, service, unit, id_.cast("string")
    )


def finding_message() -> Column:
    unit = F.when(F.col("metric") == m.CPU, "s").otherwise("MB")
    return F.format_string(
        "[%s] job %d -> stage %d -> task %d: %s at %s: %.2f%%, %.2f%s/%.2f%s",
        "metric", "job_id", "stage_id", "task_id", "udf", "impl",
        "pct", "value", unit, "job_total", unit,
    )


def missing_message() -> Column:
    return F.format_string(
        "[%s] Task data is missing: job %d, stage %d, task %d",
        "metric", "job_id", "stage_id", "task_id",
    )


def _size(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def is_usable(unit: Column, names: Column, levels: Column) -> Column:
    """Whether a parsed profile can be decoded. Never null."""
    first_total = F.get(F.get(levels, F.lit(0)), F.lit(1))
    return (
        (_size(names) > 0)
        & (_size(levels) > 0)
        & ((unit != m.JOB) | (F.coalesce(first_total, F.lit(0)) != 0))
        & F.coalesce(
            F.forall(levels, lambda lv: _size(lv) % m.FRAME_STRIDE == 0), F.lit(False)
        )
    )


def reject_reason(body: Column, unit: Column, names: Column, levels: Column) -> Column:
    """Why a profile cannot be used, or null when it can.

    The body is read again only for documents that failed to parse, to tell
    text that is no JSON from JSON of the wrong shape.
    """

    def absent(path: str, reason: str) -> Column:
        return F.when(F.get_json_object(body, path).isNull(), reason)

    no_names = absent("$.flamebearer.names", "no_names")
    no_levels = absent("$.flamebearer.levels", "no_levels")
    wrong_type = F.lit("wrong_type")
    not_integers = F.when(
        F.get_json_object(body, "$.flamebearer.levels").startswith("["), "bad_json"
    )
    first = F.get(levels, F.lit(0))
    return (
        F.when(is_usable(unit, names, levels), F.lit(None).cast("string"))
        .when(
            names.isNull() & levels.isNull(),
            F.coalesce(
                absent("$", "bad_json"),
                absent("$.flamebearer", "no_flamebearer"),
                no_names, no_levels, wrong_type,
            ),
        )
        .when(names.isNull(), F.coalesce(no_names, wrong_type))
        .when(levels.isNull(), F.coalesce(no_levels, not_integers, wrong_type))
        .when((F.size(names) == 0) | (F.size(levels) == 0), "empty")
        .when((unit == m.JOB) & (_size(first) < 2), "no_first_total")
        .when(
            (unit == m.JOB) & (F.coalesce(F.get(first, F.lit(1)), F.lit(0)) == 0),
            "zero_total",
        )
        .otherwise("ragged_level")
    )
