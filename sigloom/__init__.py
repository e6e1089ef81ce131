"""sigloom: building and querying dictionaries of 128-bit code signatures with Spark.

Packages: ``functions`` (column expressions), ``operators`` (DataFrame in, DataFrame
out), ``sources`` (readers, writers), ``plans`` (registered queries), ``streaming``.
"""

__version__ = "0.1.0"
