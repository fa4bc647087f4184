"""The catalogue of queries: each is a function of (spark, sf_dir), with DuckDB SQL for the same rows where SQL can express it."""
