"""Open-source-intelligence analytics as PySpark jobs: DataFrames in, DataFrames out."""
