"""Routing of plain-text questions to predefined reports, and the sentence that answers each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from string import Formatter

from pyspark.sql import DataFrame

from carequeue.functions.expressions import IN_PERSON, TELEHEALTH, one_decimal, thousands
from carequeue.operators.scores import ordered
from carequeue.params import Filters, Settings
from carequeue.plans import dashboard
from carequeue.plans.actions import dynamic_action_queue, funnel_dropoff, top

# Routes in the order they are tried. Every group needs one of its words in the text.
ROUTES = [
    ("clinic_lag", [["clinic"], ["highest", "longest"], ["lag", "delay"]]),
    ("improvement", [["improved", "improving", "last 30"]]),
    ("open_aging", [["open"], ["21", "older", "aging", "after"]]),
    ("funnel", [["drop", "funnel", "leak"]]),
    ("zip_friction", [["zip", "friction", "access barrier"]]),
    ("appointment_type", [["appointment type"], ["no-show", "no show"]]),
    ("visit_mode", [["telehealth", "visit mode"]]),
    ("provider", [["provider", "capacity", "constraint"]]),
    ("segment", [["segment", "least likely", "completion gap"]]),
    ("action", [["action", "prioritize", "leadership"]]),
]
NO_TEXT = "empty"
NO_ROUTE = "fallback"

# Messages and row limits.
PROMPT = "Ask a question or choose one from the examples."
FALLBACK = (
    "I can answer this dashboard question only through controlled analytics routes. Try one of the suggested "
    "questions, or use keywords like clinic lag, ZIP friction, no-show, telehealth, funnel, capacity, segment, "
    "or actions."
)
NOTHING = {
    "clinic_lag": "No matching clinic data found for the current filters.",
    "improvement": "I do not have enough data to compare the latest 30 days with the prior 30 days "
    "for the selected filters.",
    "funnel": "No funnel data is available.",
    "zip_friction": "No ZIP access friction data is available.",
    "appointment_type": "No appointment-type no-show data is available for the current filters.",
    "visit_mode": "I do not have enough visit-mode data to compare telehealth and in-person no-show rates.",
    "provider": "No provider capacity data is available for the current filters.",
    "segment": "No segment data meets the minimum volume threshold for the current filters.",
    "action": "No operational actions crossed the current thresholds. Try lowering thresholds in the sidebar.",
}
ONE_MODE = (
    "The current filters do not include both telehealth and in-person appointments. "
    "Adjust visit-mode filters to compare them."
)
SENTENCES = {
    "clinic_lag": "{clinic_name} has the highest median referral-to-appointment lag at "
    "{median_referral_to_appointment_days:.1f} days in the selected filter context.",
    "improvement": "{clinic_name} improved the most over the latest 30-day comparison, with median lag improving by "
    "{lag_improvement_days:.1f} days and completion rate changing by {completion_rate_change_pct_points:.1f} "
    "percentage points.",
    "open_aging": "There are {open_referrals_over_threshold:,} appointment-linked behavioral health referrals still open "
    "after {aging_days} days in the selected filter context. You can change this threshold in the sidebar.",
    "funnel": "The largest funnel drop-off occurs at '{stage}', with an estimated drop-off of "
    "{dropoff_from_prior_stage:,} from the prior stage.",
    "zip_friction": "ZIP {zip_code} has the highest custom access friction score at "
    "{custom_access_friction_score:.1f}. The score reflects the weights currently selected in the sidebar.",
    "appointment_type": "{appointment_type} has the highest no-show rate at {no_show_rate_pct:.1f}% across "
    "{appointment_count:,} appointments in the selected context.",
    "visit_mode": "Telehealth no-show rate is {telehealth_rate:.1f}%, which is {direction} than in-person no-show rate of "
    "{in_person_rate:.1f}% in the selected context.",
    "provider": "{provider_name} at {clinic_name} has the highest provider utilization proxy at "
    "{monthly_provider_utilization_pct:.1f}% for the selected period.",
    "segment": "The lowest-completion segment is age group {age_group!s}, {insurance_type!s} insurance, preferred language "
    "{preferred_language!s}, visit mode {visit_mode!s}, with a completion rate of {completion_rate_pct:.1f}%.",
    "action": "The top recommended priority is {entity_type} {entity_name} with priority score {priority_score:.1f}. "
    "Recommended action: {recommended_action}",
}
FEW_ROWS = 10
MORE_ROWS = 15


def route_of(text: str) -> str:
    """Route of a text column; words match inside longer words, case and padding do not matter."""
    lowered = f"lower(coalesce({text}, ''))"
    chain = [f"WHEN NOT {lowered} RLIKE '\\\\S' THEN '{NO_TEXT}'"]
    for name, groups in ROUTES:
        tests = [" OR ".join(f"contains({lowered}, '{word}')" for word in words) for words in groups]
        chain.append(f"WHEN {' AND '.join(f'({test})' for test in tests)} THEN '{name}'")
    return f"CASE {' '.join(chain)} ELSE '{NO_ROUTE}' END"


def with_route(questions: DataFrame, text: str = "question") -> DataFrame:
    """Questions with the route that answers each."""
    return questions.selectExpr("*", f"{route_of(text)} AS route")


@dataclass(frozen=True)
class Answer:
    """A one-row frame with the ``answer`` text, and the rows behind it if there are any, built when asked for."""

    route: str
    text: DataFrame
    build_rows: Callable[[], DataFrame] | None = None

    @property
    def rows(self) -> DataFrame | None:
        return self.build_rows and self.build_rows()


def ask(question: str, mart, filters: Filters = Filters(), settings: Settings = Settings()) -> Answer:
    """Route one question and build its answer."""
    name = mart.spark.sql(f"SELECT {route_of('q')} AS route FROM (SELECT :q AS q)", args={"q": question}).first().route
    return answer(name, mart, filters, settings)


def answer(route: str, mart, filters: Filters = Filters(), settings: Settings = Settings()) -> Answer:
    """The answer of one route."""
    if route == NO_TEXT:
        return Answer(route, _fixed(mart, PROMPT))
    if route not in _ANSWERS:
        return Answer(route, _fixed(mart, FALLBACK))
    return _ANSWERS[route](mart, filters, settings)


def _fixed(mart, text: str) -> DataFrame:
    return mart.spark.sql("SELECT :text AS answer", args={"text": text})


def _said(route: str) -> str:
    """The route's sentence as an expression over columns: `:.1f` one decimal, `:,` thousands, `!s` a null as "None"."""
    parts = []
    for text, column, form, conversion in Formatter().parse(SENTENCES[route]):
        if text:
            parts.append("'" + text.replace("'", r"\'") + "'")
        if column:
            shown = {".1f": one_decimal, ",": thousands}.get(form, str)(column)
            parts.append(f"coalesce({shown}, 'None')" if conversion else shown)
    return f"concat({', '.join(parts)})"


def _from_top(route: str, rows: DataFrame, *order: tuple[str, bool]) -> Answer:
    """The sentence about the first row in order, or the route's message where there is none."""
    best = top(rows, 1, *order)
    text = rows.sparkSession.sql(
        f"SELECT coalesce((SELECT max({_said(route)}) FROM {{best}}), :nothing) AS answer",
        best=best,
        args={"nothing": NOTHING[route]},
    )
    return Answer(route, text, lambda: rows)


def _clinic_lag(mart, filters, settings) -> Answer:
    order = [("median_referral_to_appointment_days", False), ("clinic_id", True)]
    rows = top(dashboard.clinic_report(mart, filters, settings), FEW_ROWS, *order)
    return _from_top("clinic_lag", rows, *order)


def _improvement(mart, filters, settings) -> Answer:
    order = [("lag_improvement_days", False), ("completion_rate_change_pct_points", False), ("clinic_name", True)]
    rows = top(dashboard.clinic_improvement(mart, filters), FEW_ROWS, *order)
    return _from_top("improvement", rows, *order)


def _open_aging(mart, filters, settings) -> Answer:
    def rows() -> DataFrame:
        report = dashboard.clinic_report(mart, filters, settings)
        ranked = ordered(report, ("open_referrals_over_threshold", False), ("clinic_id", True))
        return ranked.select("clinic_name", "open_referrals_over_threshold", "clinic_attention_index")

    counted = dashboard.counts(mart, filters, settings).selectExpr("*", f"'{settings.aging_days}' AS aging_days")
    text = counted.selectExpr(f"{_said('open_aging')} AS answer")
    return Answer("open_aging", text, rows)


def _funnel(mart, filters, settings) -> Answer:
    order = [("dropoff_from_prior_stage", False), ("stage_order", True)]
    return _from_top("funnel", funnel_dropoff(mart), *order)


def _zip_friction(mart, filters, settings) -> Answer:
    order = [("custom_access_friction_score", False), ("zip_code", True)]
    rows = top(dashboard.zip_report(mart, settings), FEW_ROWS, *order)
    return _from_top("zip_friction", rows, *order)


def _appointment_type(mart, filters, settings) -> Answer:
    order = [("no_show_rate_pct", False), ("appointment_count", False), ("appointment_type", True)]
    return _from_top("appointment_type", dashboard.appointment_type_no_show(mart, filters), *order)


def compare_visit_modes(modes: DataFrame) -> DataFrame:
    """One row with both no-show rates and whether telehealth's is lower or higher."""
    tele = f"CASE WHEN visit_mode = '{TELEHEALTH}' THEN no_show_rate_pct END"
    person = f"CASE WHEN visit_mode = '{IN_PERSON}' THEN no_show_rate_pct END"
    return modes.sparkSession.sql(
        f"""SELECT *, CASE WHEN telehealth_rate < in_person_rate THEN 'lower'
                           WHEN telehealth_rate IS NOT NULL AND in_person_rate IS NOT NULL THEN 'higher' END AS direction
            FROM (SELECT count(*) AS modes, max({tele}) AS telehealth_rate, max({person}) AS in_person_rate
                  FROM {{modes}})""",
        modes=modes,
    )


def _visit_mode(mart, filters, settings) -> Answer:
    rows = dashboard.visit_mode_no_show(mart, filters)
    text = compare_visit_modes(rows).selectExpr(
        f"""CASE WHEN modes < 2 THEN '{NOTHING["visit_mode"]}'
                 WHEN direction IS NULL THEN '{ONE_MODE}'
                 ELSE {_said("visit_mode")} END AS answer"""
    )
    return Answer("visit_mode", text, lambda: rows)


def _provider(mart, filters, settings) -> Answer:
    order = [
        ("monthly_provider_utilization_pct", False),
        ("median_referral_to_appointment_days", False),
        ("provider_id", True),
    ]
    rows = top(dashboard.provider_report(mart, filters), MORE_ROWS, *order)
    return _from_top("provider", rows, *order)


def _segment(mart, filters, settings) -> Answer:
    order = [
        ("completion_rate_pct", True),
        ("appointment_count", False),
        ("age_group", True),
        ("insurance_type", True),
        ("preferred_language", True),
        ("transportation_risk_flag", True),
        ("visit_mode", True),
    ]
    rows = top(dashboard.segment_completion(mart, filters, settings), MORE_ROWS, *order)
    return _from_top("segment", rows, *order)


def _action(mart, filters, settings) -> Answer:
    order = [("priority_score", False), ("entity_type", True), ("entity_name", True)]
    queue = dynamic_action_queue(
        dashboard.clinic_report(mart, filters, settings), dashboard.zip_report(mart, settings), settings
    )
    rows = top(queue, MORE_ROWS, *order)
    return _from_top("action", rows, *order)


_ANSWERS = {
    "clinic_lag": _clinic_lag,
    "improvement": _improvement,
    "open_aging": _open_aging,
    "funnel": _funnel,
    "zip_friction": _zip_friction,
    "appointment_type": _appointment_type,
    "visit_mode": _visit_mode,
    "provider": _provider,
    "segment": _segment,
    "action": _action,
}
