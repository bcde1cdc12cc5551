"""Registered queries over the given tables, and their SQL twins."""

from groundwork.plans import corpus, drift, facts, kpi, messages, sections, surface

LANES = (corpus, drift, surface, kpi, facts, messages, sections)
