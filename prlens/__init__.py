"""prlens: code-review analytics on Spark.

Every operator is a DataFrame -> DataFrame function built from native Spark
expressions; ``prlens.plans`` wires them to the adapter tables and registers
each as a query with an equivalent SQL oracle.
"""

__version__ = "0.1.0"
