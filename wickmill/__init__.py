"""wickmill: market-candle analytics expressed as Spark DataFrame transformations.

Every operator is a plain function from DataFrames to a DataFrame, so batch jobs,
``foreachBatch`` bodies and ``df.transform`` chains share one definition.
"""

from wickmill.session import build_session, configure, scratch_dir

__all__ = ["build_session", "configure", "scratch_dir"]
