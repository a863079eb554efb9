"""Column expressions built from pyspark.sql.functions."""
