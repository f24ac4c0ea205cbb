"""DuckDB SQL twins of the fixture views and of every registered query (the correctness oracle)."""
