"""What a user of the analytics may set: as-of date, thresholds, weights and filters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, fields
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Selection:
    """The chosen members of one filter, out of all the options offered.

    Nothing chosen means no rows, everything chosen means no predicate (so null
    categories stay), anything else is an IN list.
    """

    chosen: Sequence | None
    options: Sequence

    def predicate(self, column: Column) -> Column | None:
        if not self.chosen:
            return F.lit(False)
        if len(self.chosen) == len(self.options):
            return None
        return column.isin(list(self.chosen))


@dataclass(frozen=True)
class Filters:
    """A date window (inclusive at both ends, either of which may be left open) and one selection per dimension.

    A selection left at ``None`` was never offered and does not filter.
    """

    start: date | None = None
    end: date | None = None
    clinics: Selection | None = None
    visit_modes: Selection | None = None
    appointment_types: Selection | None = None
    insurance_types: Selection | None = None

    def during(self, start: date | None, end: date | None) -> Filters:
        return Filters(
            start, end, self.clinics, self.visit_modes, self.appointment_types, self.insurance_types
        )

    def prior(self) -> Filters:
        """The window of the same length that ends the day before this one starts."""
        if self.start is None or self.end is None:
            raise ValueError("A window without both a start and an end has no prior window")
        days = max((self.end - self.start).days + 1, 1)
        end = self.start - timedelta(days=1)
        return self.during(end - timedelta(days=days - 1), end)

    def on_appointment(self) -> list[Column]:
        tests = []
        if self.start is not None:
            tests.append(F.col("appointment_date") >= F.lit(self.start))
        if self.end is not None:
            tests.append(F.col("appointment_date") <= F.lit(self.end))
        return tests + _present(
            (self.visit_modes, "visit_mode"), (self.appointment_types, "appointment_type")
        )

    def on_clinic(self) -> list[Column]:
        return _present((self.clinics, "clinic_name"))

    def on_patient(self) -> list[Column]:
        return _present((self.insurance_types, "insurance_type"))


def _present(*pairs: tuple[Selection | None, str]) -> list[Column]:
    found = [chosen.predicate(F.col(name)) for chosen, name in pairs if chosen is not None]
    return [test for test in found if test is not None]


class _Weights:
    """Raw slider weights; ``shares`` divides by their total, never by less than one."""

    def shares(self) -> dict[str, float]:
        raw = {f.name: getattr(self, f.name) for f in fields(self)}
        total = max(sum(raw.values()), 1)
        return {name: value / total for name, value in raw.items()}


# Default weights of the two scores.
@dataclass(frozen=True)
class ClinicWeights(_Weights):
    lag: int = 35
    no_show: int = 25
    open_aging: int = 20
    capacity: int = 20


@dataclass(frozen=True)
class ZipWeights(_Weights):
    lag: int = 25
    no_show: int = 20
    transportation: int = 15
    underinsured: int = 15
    language: int = 10
    open_aging: int = 10
    telehealth: int = 5


# Default thresholds.
@dataclass(frozen=True)
class Settings:
    """Thresholds. ``as_of`` replaces today's date so that results can be repeated."""

    as_of: date | None = None
    aging_days: int = 21
    high_lag_days: int = 24
    high_no_show_pct: int = 18
    high_capacity_pct: int = 90
    high_friction: int = 60
    min_segment_volume: int = 20
    clinic_weights: ClinicWeights = field(default_factory=ClinicWeights)
    zip_weights: ZipWeights = field(default_factory=ZipWeights)

    def today(self) -> str:
        return "current_date()" if self.as_of is None else f"DATE '{self.as_of.isoformat()}'"
