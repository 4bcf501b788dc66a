"""Sample log rows for trying the engine without a source: three fixed rows and any number of drawn ones."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from tailrace.schema import LOG

# The sample's rows (hours before now, message, level, service), services and messages.
FIRST = (
    (0, "Application started successfully", "INFO", "API.Host"),
    (1, "Failed to connect to database: Connection timeout", "ERROR", "DataAccess"),
    (12, "High memory usage detected: 85%", "WARN", "ResourceMonitor"),
)
LEVELS = ("INFO", "WARN", "ERROR", "DEBUG")
SERVICES = ("API.Host", "DataAccess", "Authentication", "BusinessLogic", "ResourceMonitor")
MESSAGES = (
    "User login successful for userId: USER{i}",
    "Processing request for endpoint: /api/data/{i}",
    "Database query executed in 125ms",
    "Cache miss for key: CACHE_KEY_{i}",
    "Memory usage increased to {percent}%",
    "API call to external service completed",
    "Exception occurred: System.NullReferenceException for object XYZ{i}",
    "Background task {i} completed successfully",
    "Configuration reloaded from source",
    "Rate limit reached for IP: 192.168.0.{i}",
)


def sample_logs(spark: SparkSession, now: datetime, drawn: int = 10, seed: int = 42) -> DataFrame:
    """Canonical log rows of the last day; the same seed gives the same rows."""
    r = random.Random(seed)
    rows = [(str(n), now - timedelta(hours=h), *rest) for n, (h, *rest) in enumerate(FIRST)]
    for i in range(1, drawn + 1):
        message = r.choice(MESSAGES).format(i=i, percent=r.randint(50, 89))
        rows.append((str(len(rows)), now - timedelta(hours=r.randrange(24)), message, r.choice(LEVELS), r.choice(SERVICES)))
    return spark.createDataFrame(rows, LOG)
