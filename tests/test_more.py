"""Rasters, workbooks, registered hazards, scenarios' precedence and builds that go on."""

import zipfile

import pytest
from pyspark.sql import functions as F

from roadweave.operators import disruption, rasters
from roadweave.plans import scenarios
from roadweave.plans.scenarios import Scenario
from roadweave.sources import workbooks
from roadweave.streaming import builds

CELL = "col int, row int, value double"


def test_SRC16_windows_follow_the_affine_map(spark):
    north_up = (10.0, 0, 100.0, 0, -10.0, 500.0)
    assert rasters.window_of(north_up, 100, 480, 120, 500) == (0, 0, 1, 1)
    assert rasters.window_of(north_up, 105, 475, 125, 495) == (0, 0, 2, 2)
    assert rasters.window_of(north_up, 105, 475, 105, 475) == (0, 2, 0, 2)
    assert rasters.window_of(north_up, 105, 475, 125, 495, 1) == (-1, -1, 3, 3)
    turned = (0, 2.0, 0, 2.0, 0, 0)  # columns run along y
    assert rasters.window_of(turned, 0, 0, 2, 6) == (0, 0, 2, 0)
    cells = spark.createDataFrame([(c, r, 1.0) for c in range(4) for r in range(4)], CELL)
    assert rasters.window(cells, north_up, 105, 475, 125, 495).count() == 9
    with pytest.raises(ValueError):
        rasters.window_of((1, 1, 0, 1, 1, 0), 0, 0, 1, 1)


def test_SRC16_bilinear_warp_by_hand(spark):
    rows = [(0, 0, 1.0), (1, 0, 3.0), (0, 1, 5.0), (1, 1, -9999.0), (2, 0, None), (2, 1, float("nan")), (0, 0, 1.0), (3, 0, 8.0)]
    cells = spark.createDataFrame(rows, CELL)
    run = lambda target, cols, n, **kw: {(r.col, r.row): r.value for r in rasters.warp(cells, (1, 0, 0, 0, 1, 0), target, cols, n, nodata=-9999.0, **kw).collect()}
    same = run((1, 0, 0, 0, 1, 0), 4, 2)
    assert same == {(0, 0): 1.0, (1, 0): 3.0, (0, 1): 5.0, (1, 1): None, (2, 0): None, (2, 1): None, (3, 0): 8.0, (3, 1): None}
    half = run((1, 0, 0.5, 0, 1, 0.25), 2, 1)  # centres at (1.0, 0.75) and (2.0, 0.75): weights of 0.375, 0.375, 0.125 and 0.125
    assert half[0, 0] == pytest.approx((0.375 * 1 + 0.375 * 3 + 0.125 * 5) / 0.875) and half[1, 0] == pytest.approx(3.0)
    assert run((1, 0, 0, 0, 1, 0), 1, 1, project=lambda x, y: (x + 1, y)) == {(0, 0): 3.0}
    assert run((1, 0, 50, 0, 1, 50), 1, 1) == {(0, 0): None}
    assert rasters.warp(cells.limit(0), (1, 0, 0, 0, 1, 0), (1, 0, 0, 0, 1, 0), 2, 2).where("value IS NULL").count() == 4


def workbook(path, sheets, shared=()):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{ref}" t="s"><v>{v[0]}</v></c>' if isinstance(v, tuple) else f'<c r="{ref}"><v>{v}</v></c>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/s{i}.xml"/>' for i, _ in enumerate(sheets, 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><r><t>{t}</t></r></si>" for t in shared) + "</sst>")
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">' + "".join(cell(f"{'ABCDE'[c]}{r}", v) for c, v in enumerate(row) if v is not None) + "</row>" for r, row in rows)
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


def test_SRC6_cost_workbooks_fall_back_to_their_other_sheets(spark, tmp_path):
    road = [(2, [" Label", "Min", "MAX", None, "note"]), (3, [(0,), 1.5, 2, "x"]), (5, [None, 7]), (6, [None, None]), (7, ["Interstate", 3, 4])]
    bridges = [(1, ["label", "min", "max"]), (2, ["minor", 0.5, 0.75])]
    workbook(tmp_path / "a.xlsx", {"roads": road, "bridges": bridges, "bridges-river": [(1, ["label", "min", "max"]), (2, ["minor", 9, 10])], "blank": []}, ["motorway &amp; more"])
    got = sorted(tuple(r) for r in workbooks.read_costs(spark, str(tmp_path / "a.xlsx")).collect())
    roads = [("Interstate", 3.0, 4.0), ("motorway & more", 1.5, 2.0)]
    assert got == [("bridge_river", "minor", 9.0, 10.0), ("bridge_surface", "minor", 0.5, 0.75), *[("road", *r) for r in roads], *[("tunnel", *r) for r in roads]]
    rows = workbooks.read_workbook(spark, str(tmp_path), ["none", "roads"])
    assert rows.columns == ["label", "min", "max", "column_4", "note"] and rows.count() == 3
    with pytest.raises(ValueError):
        workbooks.read_workbook(spark, str(tmp_path), ["blank", "none"])
    with pytest.raises(ValueError):
        next(workbooks.parse(b"no zip"))


def test_2_12_hazards_can_be_registered(spark):
    heat = disruption.Hazard("celsius", "heat_max_c", 0.0, lambda x, part, road: F.when(road == "motorway", F.when(x >= 50, 2).otherwise(0)).otherwise(F.when(x >= 40, 4).otherwise(1)), lambda free, x, level, limit: F.when(x >= limit, 0.0).otherwise(free))
    disruption.register_hazard("heat", heat)
    disruption.register_hazard("heat", heat)
    links = spark.createDataFrame([("a", "motorway"), ("b", "local"), ("c", "local")], "e_id string, road_class string")
    cells = spark.createDataFrame([("a", 0, 1, 1, 52.0), ("b", 0, 1, 1, 41.0), ("b", 1, -1, -1, 99.0)], "e_id string, split_id int, i int, j int, value double")
    base = spark.createDataFrame([("a", 60.0), ("b", 30.0)], "e_id string, free_flow_speeds double")
    got = {r.e_id: (r.heat_max_c, r.damage_level_max, r.max_speed, r.intensity_unit) for r in disruption.run_disruption(links, {"heat": cells}, base, "heat", 45.0, "1", 900).collect()}
    assert got == {"a": (52.0, "moderate", 0.0, "celsius"), "b": (41.0, "severe", 30.0, "celsius"), "c": (0.0, "no", 50.0, "celsius")}
    for name in ("flood", "heat"):
        with pytest.raises(ValueError):
            disruption.register_hazard(name, disruption.Hazard("x", "x", 1.0, disruption.stepped([1]), disruption.by_level))
    with pytest.raises(KeyError):
        disruption.hazard_of("meteor")


def test_CP17_precedence():
    mine = [Scenario("flood", "river", "4", 310, 25.0), Scenario("snow", "", "2", 702, 140.0), Scenario("snow", "", "9", 702, 1.0)]
    env = lambda **kw: {f"ROADWEAVE_{k.upper()}": v for k, v in kw.items()}
    assert [s.key for s in scenarios.registered(mine)] == [310, 702] and len(list(scenarios.registered())) == len(scenarios.BUILT_IN)
    assert scenarios.active(310, "7", manifest=mine) == Scenario("flood", "river", "7", 310, 25.0)
    assert scenarios.active(310, manifest=mine, environment=env(scenario_param="702")).threshold == 140.0
    assert scenarios.active(310, threshold=3, manifest=mine).threshold == 3.0
    # A key that is not registered: the environment's hazard of that event gives the rest.
    found = scenarios.active(5, "2", manifest=mine, environment=env(hazard_type="Snow"))
    assert (found.hazard, found.key, found.threshold) == ("snow", 5, 140.0)
    assert scenarios.active(manifest=mine, event_id="4", environment=env(flood_subtype="river")).key == 310
    # The older rule.
    assert scenarios.active(5, "2", manifest=mine, environment=env(flood_subtype="coastal")) == Scenario("flood", "coastal", "2", 5, 5.0)
    with pytest.raises(ValueError):
        scenarios.active(manifest=mine, environment=env(hazard_type="meteor"))


def test_CP10_a_build_that_was_cut_off_goes_on(spark, tmp_path):
    lookup = spark.createDataFrame([("b1", "01"), ("b2", "02"), ("b3", "02")], "block string, county string")
    (tmp_path / "in").mkdir()

    def put(state, part, rows):
        (tmp_path / "in" / f"{state}_od_{part}_JT00_2022.csv").write_text("w_geocode,h_geocode,S000,extra\n" + "".join(f"{w},{h},{n},0\n" for w, h, n in rows))

    for state in ("va", "md", "nc"):
        put(state, "main", [("b1", "b2", 2), ("b1", "b3", 1), ("b2", "b2", 0), ("b1", "zz", 5)])
        put(state, "aux", [("b1", "b2", 10), ("b3", "b1", "x")])
    done = []

    def cut(number):
        done.append(number)
        if number == 2:
            raise RuntimeError("the machine went")

    def build(name="out", **kw):
        df = builds.build_counties(spark, str(tmp_path / "in"), lookup, str(tmp_path / name), str(tmp_path / f"{name}-state"), 1, **kw)
        return sorted(tuple(r) for r in df.collect())

    with pytest.raises(Exception, match="the machine went"):
        build(done=cut)
    assert done == [0, 1, 2]
    again = []
    want = [("02", "01", 2022, "JT00", 39)]
    assert build(done=again.append) == want and again == [2, 3, 4, 5]  # batch 2, written but not finished, is done again
    assert build("whole") == want and build() == want
    put("dc", "main", [("b2", "b1", 4)])
    assert build() == [("01", "02", 2022, "JT00", 4), *want]
    (tmp_path / "in" / "notes.csv").write_text("w_geocode,h_geocode,S000\nb1,b2,1\n")
    with pytest.raises(Exception, match="no file of commuters"):
        build()
    (tmp_path / "in" / "notes.csv").unlink()
    (tmp_path / "in" / "wv_od_main_JT00_2022.csv").write_text("h_geocode,w_geocode,S000\nb1,b2,1\n")
    with pytest.raises(Exception, match="no file of commuters"):
        build("swapped")
