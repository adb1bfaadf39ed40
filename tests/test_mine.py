"""The synthetic mine and its location query by change against the plain form."""

from pyspark.sql import functions as F

from tidemark.plans import mine


def test_positions_by_change_match_the_plain_form(spark):
    packets = mine.packets(spark, horizons=2, lamps=9, minutes=10).cache()
    assert packets.count() > 600 and packets.select("lamp", "ts").distinct().count() < packets.count()
    shape = lambda df: sorted((r.lamp, r.win_end, r.beacon, round(r.x, 6), round(r.y, 6)) for r in df.collect())
    assert shape(mine.median_rssi(spark, packets)) == shape(mine.median_rssi_plain(spark, packets))
    assert mine.beacons(spark).select(F.count_distinct("beacon")).first()[0] == 16 * 64
