"""All registered queries. Importing the modules fills the registry."""

from rankmill.plans import (  # noqa: F401
    contracts_and_changes,
    intake_and_text,
    lists_and_exports,
    review,
    scoring_and_tracking,
)
from rankmill.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
