"""End-to-end runs composed from the operators, and the DuckDB oracle SQL."""
