import datetime as dt
import json

from riskloom.sources import portfolios, prices, views


def test_price_csv_headers_junk_and_duplicates(spark, tmp_path):
    text = "Price,Close,High,Low,Open,Volume\nTicker,ABC,ABC,ABC,ABC,ABC\nDate,,,,,\n2020-01-02,10,11,9,9.5,100\n2020-01-02,99,99,99,99,99\n2020-01-03,x,12,8,,\nbad,1,1,1,1,1\n"
    (tmp_path / "ABC_10yr_daily.csv").write_text(text)
    (tmp_path / "DEF_10yr_daily.csv").write_text(text.replace("ABC", "DEF"))
    rows = prices.load_symbols(spark, str(tmp_path), ["ABC"]).orderBy("date").collect()
    assert [(r.asset, r.date, r.close, r.open, r.volume) for r in rows] == [
        ("ABC", dt.date(2020, 1, 2), 10.0, 9.5, 100.0), ("ABC", dt.date(2020, 1, 3), None, 10.0, 0.0)]
    assert sorted(r.asset for r in prices.available_symbols(spark, str(tmp_path)).collect()) == ["ABC", "DEF"]


def test_wide_csv_panel(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Date,A,B\n2020-01-01,1,2\n2020-01-01,9,9\n2020-01-02,3,\n")
    got = {(r.asset, r.date.day): r.price for r in prices.load_panel_prices(spark, str(tmp_path / "p.csv"), "csv").collect()}
    assert got == {("A", 1): 1.0, ("B", 1): 2.0, ("A", 2): 3.0, ("B", 2): None}


def test_weights_are_aligned_and_renormalised(spark):
    w = spark.createDataFrame([(1, "A", 0.5), (1, "Z", 0.5), (2, "B", 1.0)], "portfolio_id long, asset string, w double")
    u = portfolios.universe_array(spark.createDataFrame([("A",), ("B",)], "asset string"))
    got = {(r.portfolio_id, r.asset): r.w for r in portfolios.align_to_universe(w, u).collect()}
    assert got == {(1, "A"): 1.0, (1, "B"): 0.0, (2, "A"): 0.0, (2, "B"): 1.0}


def test_views_json(spark, tmp_path):
    doc = {"absolute_views": [{"asset": "A", "return": 0.1, "confidence": 0.5}], "relative_views": [{"assets": ["A", "B"], "return_diff": 0.02, "confidence": 0.9, "comment": ""}]}
    (tmp_path / "v.json").write_text(json.dumps(doc, indent=1))
    v = views.load_investor_views(spark, str(tmp_path / "v.json"))
    assert sorted((r.view_id, r.asset, r.p, r.q) for r in v.collect()) == [("abs_0", "A", 1.0, 0.1), ("rel_0", "A", 1.0, 0.02), ("rel_0", "B", -1.0, 0.02)]
    sets = spark.createDataFrame([("s1", "A"), ("s2", "A"), ("s2", "B")], "set_id string, asset string")
    assert sorted({(r.set_id, r.view_id) for r in views.applicable_views(v, sets).collect()}) == [("s1", "abs_0"), ("s2", "abs_0"), ("s2", "rel_0")]
