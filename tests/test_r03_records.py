"""Masked records with long addresses."""

import json

from pyspark.sql import functions as F

from watchfold.functions import ids, jsonwalk

KEY = b"key"


def test_own_addresses_of_any_form_are_masked_in_free_text(spark):
    text = json.dumps({"source_ip": "10.1.2.1735", "note": "seen at 10.1.2.1735, not 10.1.2.17359 or 10.1.2"})
    token = spark.range(1).select(ids.pseudonym(KEY, "IP", F.lit("10.1.2.1735")).alias("p")).first()["p"]
    got = json.loads(spark.createDataFrame([(text,)], "t string").select(jsonwalk.mask_values(F.col("t"), KEY).alias("m")).first()["m"])
    assert got == {"source_ip": token, "note": f"seen at {token}, not 10.1.2.17359 or 10.1.2"}
