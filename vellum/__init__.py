"""vellum: tabular analytics operators that run as ordinary Spark jobs.

Every operator is a function ``DataFrame -> DataFrame`` (or a small
result DataFrame); nothing is collected unless the operator's output is
a bounded list of names (for example the categories of a one-hot step,
behind a cardinality cap).
"""

__version__ = "0.1.0"
