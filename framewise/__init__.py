"""framewise: table analytics as Spark DataFrame operators.

Modules: ``sources`` (files, workbooks, SQLite, JDBC, JSON flattening, type
detection), ``functions`` (row expressions, quantiles, distribution tails),
``operators`` (cleaning, profiling, chart aggregates, finance, statistics,
machine learning, forecasting), ``plans`` (row-order scheme, registered
queries), ``streaming`` (live KPIs). Start a session with
:func:`framewise.session.get_spark`.
"""

__version__ = "0.1.0"
