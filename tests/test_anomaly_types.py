"""Volume anomalies see every type, however many there are."""

from datetime import datetime, timedelta

from tailrace.operators import anomaly


def test_more_than_fifty_types(spark):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(hours=h), f"common {t}", "s") for h in range(30) for t in range(60) for _ in range(2)]
    rows += [(start + timedelta(hours=h), None, "s") for h in range(30)]
    rows += [(start + timedelta(hours=17), f"rare {t % 25}", "s") for t in range(40)]  # types beyond the fiftieth
    df = spark.createDataFrame(rows, "ts timestamp, template string, service_name string")
    for service in ("service_name", None):
        got = {x.bucket: x for x in anomaly.volume_anomalies(df, "template", 3600, 0.95, service).collect()}
        assert {b: x.n for b, x in got.items()} == {start + timedelta(hours=h): 121 + 40 * (h == 17) for h in range(30)}
        spike = got[start + timedelta(hours=17)]
        assert spike.anomaly and spike.score == min(x.score for x in got.values())
