"""The named reports as views, and the table that keeps the quality scorecard."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from carequeue.params import Settings
from carequeue.plans import quality, views
from carequeue.sources.files import register_views, save_table
from carequeue.sources.schemas import SCORECARD

SCORECARD_TABLE = "fact_data_quality_issue"


def refresh_scorecard(
    mart, settings: Settings = Settings(), checked_at: datetime | None = None, table: str = SCORECARD_TABLE
) -> None:
    """Check all rules and replace the scorecard table by what they find."""
    save_table(quality.scorecard(mart, settings, checked_at).to(_empty(mart.spark).schema), table)


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCORECARD)


def read_scorecard(spark: SparkSession, table: str = SCORECARD_TABLE) -> DataFrame:
    """The kept scorecard; no rows before its first refresh."""
    return spark.table(table) if spark.catalog.tableExists(table) else _empty(spark)


FRICTION, ATTENTION = "vw_zip_access_friction", "vw_clinic_attention_index"

# The names under which users of the reports know them. Each is built from the registry, so that a report
# that stands on others takes them from there.
BUILDERS: dict[str, Callable[[Reports], DataFrame]] = {
    "vw_referral_lag_summary": lambda r: views.referral_lag(r.mart, r.settings),
    "vw_appointment_completion_summary": lambda r: views.appointment_completion(r.mart),
    "vw_no_show_summary": lambda r: views.no_show_summary(r.mart),
    "vw_open_referral_aging": lambda r: views.open_referral_aging(r.mart, r.settings),
    "vw_behavioral_health_funnel": lambda r: views.funnel(r.mart),
    "vw_provider_capacity_summary": lambda r: views.provider_capacity_all(r.mart),
    FRICTION: lambda r: views.zip_friction(r.mart, r.settings, r.planned),
    "vw_clinic_access_performance": lambda r: views.clinic_performance(r.mart, r.settings),
    "vw_data_quality_scorecard": lambda r: read_scorecard(r.mart.spark) if r.scorecard is None else r.scorecard,
    "vw_weekly_access_trends": lambda r: views.weekly_access_trends(r.mart),
    ATTENTION: lambda r: views.clinic_attention_index(r.mart, r.settings, r.planned),
    "vw_patient_segment_completion_gap": lambda r: views.segment_completion_gap(r.mart),
    "vw_operational_action_queue": lambda r: views.action_queue(r.mart, r.settings, r[ATTENTION], r[FRICTION]),
}


class Reports(Mapping):
    """The thirteen reports by name, each built when it is first read and kept.

    What stacked reports share is written once: the friction scores are computed by whichever of the reports on them is
    read first. With ``planned`` nothing is written, and each reading computes a report anew. The scorecard
    is the kept one unless another is given.
    """

    def __init__(self, mart, settings: Settings = Settings(), scorecard: DataFrame | None = None, planned: bool = False):
        self.mart, self.settings, self.scorecard, self.planned = mart, settings, scorecard, planned
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = BUILDERS[name](self)
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(BUILDERS)

    def __len__(self) -> int:
        return len(BUILDERS)

    def sql(self, text: str) -> DataFrame:
        """A query over the views; those it names, and what they stand on, are registered anew as written ones."""
        asked = {name: self[name] for name in self if re.search(rf"\b{name}\b", text, re.IGNORECASE)}
        register_views(asked | self._built)
        return self.mart.spark.sql(text)


def reports(mart, settings: Settings = Settings(), scorecard: DataFrame | None = None) -> Reports:
    """The thirteen reports by name."""
    return Reports(mart, settings, scorecard)


def create_views(mart, settings: Settings = Settings(), scorecard: DataFrame | None = None) -> Reports:
    """Register every report as a temporary view under its name, which runs no job, and return the reports.

    A view is a plan, computed when it is read. Queries through ``sql`` of the result share what they write.
    """
    register_views(Reports(mart, settings, scorecard, planned=True))
    return Reports(mart, settings, scorecard)
