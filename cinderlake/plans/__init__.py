"""Registered queries: each module has QUERIES and ORACLES."""

from cinderlake.plans import analytics, articles, details, entities, findings, landed, matching, text

MODULES = [analytics, matching, text, findings, entities, details, articles, landed]
