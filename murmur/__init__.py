"""murmur: complaint and service-request analytics as plain Spark DataFrame operators.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark SQL
expressions.  Numeric operators work on a whole range of target dates in one
pass (backfill form); a single date is the special case.
"""

__version__ = "0.1.0"
