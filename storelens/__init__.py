"""storelens: retail analytics operators on Spark DataFrames.

Every public operator takes DataFrames (and parameters) and returns a lazy
DataFrame; the heavy work runs in Spark SQL / Spark ML / Structured Streaming.
"""

__version__ = "0.1.0"
