"""All queries over the reference's own operators, and their SQL."""

from quarrymill.plans import audit, curation, evaluation

QUERIES = curation.QUERIES | evaluation.QUERIES | audit.QUERIES
SQL = curation.SQL | evaluation.SQL | audit.SQL
