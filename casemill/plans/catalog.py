"""All named queries; importing their modules registers them."""

from casemill.plans import curation, evaluation, listing, longruns, scoring, sets, texts, workflows  # noqa: F401
from casemill.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
