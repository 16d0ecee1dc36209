"""Registered queries over the reference's operators."""

from millrace.plans import aggregates, audits, extras, intervals, joins, metrics, projections, selection, services, texts  # noqa: F401
