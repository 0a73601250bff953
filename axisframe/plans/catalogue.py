"""Imports the modules that register queries."""

from axisframe.plans import curation, numeric, relational, structures, studies  # noqa: F401
