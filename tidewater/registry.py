"""Name to query, and to the SQL that says the same."""

from tidewater.queries import builder, statements

QUERIES = builder.QUERIES | statements.QUERIES
ORACLES = builder.ORACLES | statements.ORACLES
