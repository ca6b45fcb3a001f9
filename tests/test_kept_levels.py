"""Order cells of regions and DMAs are kept from one pass over the lines."""

from geoaffinity.operators.cells import order_levels, order_measures
from geoaffinity.plans.kept import KeptCells
from tests import handmade as hm
from tests.handmade import MAY, SCOPE
from tests.test_kept_and_bitmaps import facts

ODD = {
    # Z1 lies in two of the five DMAs, Z9 in none, and one order has neither region nor zip.
    "helper_us_census": [{"zip": "Z1", "dma_code": 501}, {"zip": "Z1", "dma_code": 502}],
    "dim_dma": [{"dma_code": 501, "ga_dma": "New York, NY"}, {"dma_code": 502, "ga_dma": "Seattle-Tacoma WA"}],
    "orders": [hm.order("1"), hm.order("2", None, MAY[1], None), hm.order("3", "US East", MAY[2], "Z9")],
}


def test_both_levels_equal_their_own_measures(spark):
    star = hm.star(spark, **facts(**ODD))
    levels = order_levels(star, SCOPE)
    for place in ("region", "dma"):
        want = order_measures(star, SCOPE, place)
        got = levels.filter(f"level = '{place}'").withColumnRenamed("place", place).select(*want.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_an_update_reads_the_lines_once(spark, tmp_path, monkeypatch):
    frames = []
    monkeypatch.setattr(KeptCells, "_replace", lambda self, name, frame, *_: frames.append(frame))
    KeptCells(spark, str(tmp_path)).update(hm.star(spark, **facts()), SCOPE)
    assert sum("total_order" in frame.columns for frame in frames) == 1
