"""All registered queries but those of the corpus operators."""

from terraql.plans import expressions, language, relational
from terraql.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "expressions", "language", "relational"]
