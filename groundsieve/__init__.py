"""groundsieve: grounded retrieval and answer checking over whole tables, on Spark.

Every function takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing here loops over rows on the driver.
"""

from groundsieve.config import RetrievalConfig

__all__ = ["RetrievalConfig"]
