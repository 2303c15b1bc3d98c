"""The registered queries."""

from docrecon.plans import access, aggregates, extraction, fields, joins, layout, quality, reconciliation, rows, text, workflow  # noqa: F401
