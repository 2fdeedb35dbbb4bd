"""Spark jobs over the memories of many software agents.

Every operator is a function from DataFrames to DataFrames.  ``operators``
holds the jobs, ``functions`` column expressions, ``sources`` readers and
writers, ``plans`` derived tables and queries, ``streaming`` the continuous
forms.
"""
