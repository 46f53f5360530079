"""Cloud-cost analytics as Spark jobs.

``sources``    billing readers, the result store
``functions``  column expressions and distributed building blocks
``operators``  one DataFrame-in, DataFrame-out function per operator
``plans``      batch run, tuned run, and the registered queries with their SQL
``streaming``  the same work on arriving rows
"""

__version__ = "0.1.0"
