"""All queries of the core package, with the SQL that states each result."""

from corpusmill.plans import reference_queries, training_data

QUERIES = {**reference_queries.QUERIES, **training_data.QUERIES}
ORACLE = {**reference_queries.ORACLE, **training_data.ORACLE}
