"""A folder for intermediate tables in local sessions that name none."""

import tempfile

from pyspark.sql import SparkSession

from seqthin.workspace import OWN_CONF, named_root


def ensure_folder(spark: SparkSession) -> None:
    """Local sessions without a shared folder get one of their own; others keep theirs."""
    if named_root(spark) is None and spark.sparkContext.master.startswith("local["):
        spark.conf.set(OWN_CONF, tempfile.mkdtemp(prefix="run-seqthin-"))
