"""Query plans: each module holds callables (spark, folder) -> DataFrame and the SQL that states the same result."""
