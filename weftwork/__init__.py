"""weftwork: a PySpark-native text-intelligence and analytics engine.

Subpackages: ``functions`` (Column expressions and Arrow UDFs), ``operators``
(DataFrame in, DataFrame out), ``sources`` (file formats), ``streaming``
(Structured Streaming jobs), ``plans`` (the registered queries and their SQL)
and, optional, ``llm`` (operators for training data; nothing else imports it).
"""

__version__ = "0.1.0"
