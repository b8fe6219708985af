"""Appointment-access analytics as Spark DataFrame functions."""
