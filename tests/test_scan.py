import random

from pyspark.sql import functions as F

from mixledger.operators.scan import Scan, scan


def test_chunked_scan_equals_plain_windows(spark):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(5)}", i * 1.5, rng.choice([None, rng.randrange(50)])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, at double, v int")
    kinds = ["number", "lag", "lead", "sum", "max", "max_before", "last", "last_before", "first_after"]
    scans = [Scan(k, k, None if k == "number" else F.col("v")) for k in kinds]
    chunk = F.floor(F.col("at") / 40)
    whole = {tuple(r) for r in scan(df, ["g"], ["at"], chunk, scans).collect()}
    for limit in (None, 60):
        cut = {tuple(r) for r in scan(df, ["g"], ["at"], chunk, scans, light_rows=limit).collect()}
        assert cut == whole
