"""contrail — flight-delay analytics on Spark DataFrames.

Layers (medallion):
  bronze  -> ``contrail.sources``   flights / weather / airports / live states
  silver  -> ``contrail.plans.medallion.silver_flights_weather``
  gold    -> ``contrail.plans.medallion.delay_summary``

Everything is DataFrame / Spark SQL / Structured Streaming / Spark ML;
there are no Python UDFs.
"""

from contrail.session import get_spark, checkpoint_root  # noqa: F401

__all__ = ["get_spark", "checkpoint_root"]
