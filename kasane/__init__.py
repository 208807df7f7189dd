"""kasane: versioned reference data on Spark DataFrames.

Sub-packages: ``functions`` (column builders), ``operators`` (DataFrame to
DataFrame), ``sources`` (readers and writers), ``plans`` (registered queries
and their SQL), ``llm`` (text operators for training data, optional: nothing
outside it imports it).
"""

__version__ = "0.1.0"
