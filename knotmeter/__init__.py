"""Architecture-debt analytics for fleets of software projects, on Spark.

Every operator is a function from DataFrames to a DataFrame, keyed by
``project_id``; the same plan scores one project or a hundred thousand.
"""
