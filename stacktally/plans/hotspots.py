"""Usage of each function, and the report of the functions that take too large a share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from stacktally import workspace as w
from stacktally.model import Settings
from stacktally.operators import matching, profiles as p, registry as r, report, usage as u


@dataclass(frozen=True)
class Report:
    """A written ``usage`` table and the questions asked of it; each is planned when read."""

    usage: DataFrame
    expected: DataFrame
    parsed: p.Parsed
    registrations: DataFrame
    settings: Settings

    @property
    def findings(self) -> DataFrame:
        """Functions at or over their threshold."""
        return report.findings(
            self.expected, self.usage, r.resolve_registry(self.registrations),
            self.settings.cpu_threshold, self.settings.mem_threshold,
        )

    @property
    def missing(self) -> DataFrame:
        """Tasks without usage."""
        return report.missing_profiles(self.expected, self.usage)

    @property
    def rejected(self) -> DataFrame:
        """Profiles that could not be used, and job profiles without a total."""
        without_total = u.jobs_without_total(self.parsed.valid, self.usage)
        return self.parsed.rejected.unionByName(without_total)


def measured_classes(resolved: DataFrame) -> w.Table:
    return w.measure(w.publish(r.impl_to_udf(resolved), "classes"), matching.shortest_path())


def dictionary_of(valid: DataFrame, resolved: DataFrame) -> w.Table:
    """Frame names of registered functions and how often they occur, as a table of known size.

    Profiles repeat the same names over and over, so the names are made distinct
    in a pass over the dictionaries and matched once.
    """
    classes = measured_classes(resolved)
    names = p.counted_names(valid)
    return w.measure(w.publish(matching.match_frames(names, classes), "dictionary"))


def attributed_frames(parsed: p.Parsed, resolved: DataFrame) -> DataFrame:
    dictionary = dictionary_of(parsed.valid, resolved)
    return matching.attribute(p.largest_frames(parsed.valid), dictionary)


def parsed_usage(parsed: p.Parsed, registrations: DataFrame) -> DataFrame:
    """The ``usage`` table of all units among the parsed profiles."""
    frames = attributed_frames(parsed, r.resolve_registry(registrations))
    return u.in_display_units(u.latest_inclusive(frames))


def task_usage(profiles: DataFrame, registrations: DataFrame) -> DataFrame:
    """The ``usage`` table of all units found in ``profiles``."""
    return parsed_usage(p.parse_once(profiles), registrations)


def expected_of(
    jobs: DataFrame, stages: DataFrame, tasks: DataFrame, usage: DataFrame
) -> DataFrame:
    """The tasks that reports on ``usage`` cover, from a table of stages of known size."""
    covered = w.publish(report.covered_stages(jobs, stages, u.job_total(usage)), "covered")
    return report.expected_tasks(w.measure(covered), tasks)


def find_hotspots(
    profiles: DataFrame,
    jobs: DataFrame,
    stages: DataFrame,
    tasks: DataFrame,
    registrations: DataFrame,
    settings: Settings = Settings(),
) -> Report:
    """Decode, attribute and report. The usage table is written once and read by all parts."""
    parsed = p.parse_once(profiles)
    usage = w.publish(parsed_usage(parsed, registrations), "usage", partition_by=["unit"])
    expected = expected_of(jobs, stages, tasks, usage)
    return Report(usage, expected, parsed, registrations, settings)
