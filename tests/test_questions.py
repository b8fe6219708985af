from datetime import date

import pytest

from carequeue.params import Filters, Selection
from carequeue.plans import questions

ROUTES = {
    "Which CLINICS have the highest median lag?": "clinic_lag",
    "  longest delay by clinic  ": "clinic_lag",
    "clinic lag": "fallback",
    "Has anything improved?": "improvement",
    "reopened after review": "open_aging",
    "open referrals": "fallback",
    "where do we leak": "funnel",
    "ZIP codes": "zip_friction",
    "appointment type no show": "appointment_type",
    "appointment type": "fallback",
    "telehealth": "visit_mode",
    "provider capacity": "provider",
    "least likely to come": "segment",
    "what to prioritize": "action",
    "open drop after": "open_aging",
    " \t\n ": "empty",
    "": "empty",
    "hello": "fallback",
}


def test_routes(spark):
    frame = spark.createDataFrame([(text,) for text in ROUTES] + [(None,)], "question string")
    found = {r.question: r.route for r in questions.with_route(frame).collect()}
    assert found == ROUTES | {None: "empty"}


def text_of(answer):
    return answer.text.first().answer


def test_fixed_messages(mart):
    assert text_of(questions.ask("", mart)) == questions.PROMPT
    assert text_of(questions.ask("it's 'hello'; DROP", mart)).startswith("The largest funnel drop-off")
    assert text_of(questions.ask("hello", mart)) == questions.FALLBACK


@pytest.mark.parametrize(
    "route, sentence",
    [
        ("clinic_lag", "South has the highest median referral-to-appointment lag at 31.0 days"),
        ("open_aging", "There are 2 appointment-linked behavioral health referrals still open after 21 days"),
        ("funnel", "The largest funnel drop-off occurs at 'Appointment Completed', with an estimated drop-off of 3"),
        ("appointment_type", "follow_up has the highest no-show rate at 20.0% across 5 appointments"),
        ("visit_mode", "Telehealth no-show rate is 0.0%, which is lower than in-person no-show rate of 33.3%"),
        ("provider", "Ana at North has the highest provider utilization proxy at 12.5%"),
        ("segment", "The lowest-completion segment is age group 18-25, public insurance, preferred language English, visit mode "),
        ("action", "The top recommended priority is Clinic North"),
        ("improvement", "I do not have enough data to compare the latest 30 days"),
    ],
)
def test_answers(mart, settings, route, sentence):
    assert text_of(questions.answer(route, mart, Filters(), settings)).startswith(sentence)


@pytest.mark.parametrize("route", ["clinic_lag", "appointment_type", "visit_mode", "provider", "segment"])
def test_answers_without_rows(mart, settings, route):
    nothing = Filters(date(2010, 1, 1), date(2010, 1, 2))
    assert text_of(questions.answer(route, mart, nothing, settings)) == questions.NOTHING[route]


def test_comparison_needs_both_modes(mart, settings):
    filters = Filters(visit_modes=Selection(["telehealth"], ["in_person", "telehealth"]))
    assert text_of(questions.answer("visit_mode", mart, filters, settings)) == questions.NOTHING["visit_mode"]
