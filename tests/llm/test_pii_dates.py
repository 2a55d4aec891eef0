"""Pseudonyms of dates in all three orders of writing."""

import datetime

from pyspark.sql import functions as F

from wavekin.llm import pii


def test_all_days_in_all_orders_have_pseudonyms_of_their_own(spark):
    day = F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int"))
    days = spark.range(146097, numPartitions=4).select(day.alias("day"), pii.permuted_day(day, "k").alias("new"))
    got = [(r["day"], r["new"]) for r in days.collect()]
    whole = {datetime.date(1800, 1, 1) + datetime.timedelta(i) for i in range(146097)}
    assert {a for a, _ in got} == {b for _, b in got} == whole
    assert all((a.day <= 12) == (b.day <= 12) for a, b in got)
    assert sum(a == b for a, b in got) < 20


def test_written_dates_stay_apart_and_linked(spark):
    first = datetime.date(1960, 1, 1)
    texts = {}
    for i in range(0, 3 * 365):
        d = first + datetime.timedelta(i)
        for order in ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y"):
            texts[d.strftime(order)] = (d, order)
    rows = spark.createDataFrame([(t, t) for t in texts], "doc_id string, text string")
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(rows, "k").collect()}
    assert len(set(got.values())) == len(texts)
    for d in (first + datetime.timedelta(i) for i in range(0, 3 * 365, 7)):
        read = {datetime.datetime.strptime(got[d.strftime(order)], order).date() for order in ("%Y-%m-%d", "%d/%m/%Y")}
        if d.day > 12:
            read.add(datetime.datetime.strptime(got[d.strftime("%m/%d/%Y")], "%m/%d/%Y").date())
        assert len(read) == 1
