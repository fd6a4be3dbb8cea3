"""End-to-end plans, the mapping of the test tables, and the query registry."""
