"""The registered queries, each with the SQL its result is checked against."""
