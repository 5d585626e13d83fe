"""tablescope: table profiling, data-quality checks and segmentation on Spark.

Every operator is a plain function ``op(df, ...) -> DataFrame`` built from Spark
SQL expressions and ``pyspark.ml``; heavy work stays on the cluster, only
bounded metadata (one row per column or per pair) ever reaches the driver.
"""

from tablescope.session import get_session, ensure_checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
