"""ledgerlens: Spark batch operators for financial tables.

Every operator takes DataFrames and returns DataFrames. Operators that learn
statistics come as a ``fit_*``/``apply_*`` pair: ``fit_*`` returns a small
statistics DataFrame that can be written to parquet, ``apply_*`` joins it to
any other split.
"""
