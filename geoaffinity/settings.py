"""Session settings the plans are written for; pass them to ``SparkSession.builder.config``.

Nothing depends on them for right results.
"""

SESSION_SETTINGS = {
    # Join sides are chosen, shuffles coalesced and skewed partitions split from measured sizes.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Parquet expands in memory; without this a fact can look small enough to broadcast.
    "spark.sql.sources.fileCompressionFactor": "4.0",
    # Tables bucketed by order number join by number, market and day without an exchange.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Shown times; days of orders are the warehouse's in any session zone.
    "spark.sql.session.timeZone": "UTC",
    # Plans build faster when the Python line of every expression is not recorded.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}
