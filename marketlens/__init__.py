"""marketlens: market-table analytics (category x place) as Spark DataFrame jobs.

Every measure is computed for every category at once, partitioned by the
category key; a single-category answer is a filter on the result.
"""

__version__ = "0.1.0"
