"""Query catalog: one Spark builder and (where SQL can express it) one
DuckDB oracle statement per operator in the survey inventory."""
