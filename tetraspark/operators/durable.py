"""Tables kept in the cluster's shared folder, so that a lost executor loses none of them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and checkpointed, with its lineage cut.

    The folder is ``spark.checkpoint.dir`` where the cluster names one; a temporary folder is used
    only where nothing is set, as in local tests.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)
