"""Weather, grids, seasons, cubes and catalogues on small cases with known results."""

import json
from datetime import datetime, timedelta, timezone

import pytest

from plumbline.operators import cube, grids, seasons, weather
from plumbline.operators.contracts import ContractError
from plumbline.sources import catalog
from plumbline.sources.evidence import Snapshots

T0 = datetime(2024, 4, 1, tzinfo=timezone.utc)
META = {b: {"raster:bands": [{"scale": 1e-4, "offset": 0, "nodata": 0}]} for b in grids.BANDS}


def hours(spark, change=lambda rows: rows):
    rows = [[(T0 + timedelta(hours=h)).isoformat(), (T0 + timedelta(hours=h + 3)).isoformat(), "283.15", str(h / 1000)] for h in range(25)]
    return spark.createDataFrame(change(rows), "datetime string, available_at string, temperature_k string, precip_m string")


def edit(at, column, value):
    def change(rows):
        rows[at][column] = value
        return rows

    return change


def one_day(spark, change=lambda r: r, **more):
    return weather.daily_weather(hours(spark, change), "2024-04-01", "2024-04-01", **more).first()


def test_whole_day(spark):
    d = one_day(spark)
    assert (d.precip_mm, d.temp_mean_c, d.gdd_base5, d.gdd_base10) == (pytest.approx(24), pytest.approx(10), pytest.approx(5), pytest.approx(0))
    assert d.precip_valid and d.dry_day_lt1mm == 0


def test_gaps_and_decreases(spark):
    d = one_day(spark, lambda r: r[:-1])
    assert not d.precip_terminal_present and d.precip_mm is None and d.precip_observed_lower_bound_mm == pytest.approx(23) and d.dry_day_lt1mm is None
    d = one_day(spark, lambda r: r[:12] + r[13:])
    assert d.precip_terminal_present and not d.precip_complete_24h and d.precip_mm is None
    d = one_day(spark, edit(14, 3, "0.001"))
    assert d.precip_within_cycle_decreases == 1 and not d.precip_valid and d.precip_observed_lower_bound_mm is None
    d = one_day(spark, edit(5, 3, "-0.001"))
    assert not d.precip_nonnegative and not d.precip_valid
    d = one_day(spark, edit(5, 2, None))
    assert d.gdd_base5 is None and d.precip_valid


def test_as_of_and_calendar(spark):
    assert one_day(spark, available_by="2024-04-02T02:00Z").precip_mm is None
    two = weather.daily_weather(hours(spark), "2024-03-31", "2024-04-01")
    rows = two.orderBy("date").collect()
    assert rows[0].temp_steps == 0 and rows[0].precip_nonnegative and rows[1].precip_mm == pytest.approx(24) and rows[1].cum_precip_mm is None
    total = weather.weather_summary(two).first()
    assert total.precipitation_total_mm is None and total.precipitation_observed_valid_days_mm == pytest.approx(24)


@pytest.mark.parametrize("change", [lambda r: r + [r[3]], edit(3, 0, "2024-04-01T03:30:00Z"), edit(3, 0, "2024-04-01T03:00:00"), edit(3, 2, "warm"), edit(3, 2, "-1"), edit(3, 3, "inf")])
def test_bad_frames_are_rejected(spark, change):
    with pytest.raises(ContractError):
        one_day(spark, change)


def patch(spark, red=2000.0, nir=6000.0, swir=4000.0, scl=4.0, mask=True, meta=META):
    return spark.createDataFrame([("f", [[red]], [[nir]], [[swir]], [[scl]], [[mask]], json.dumps(meta))], "field_id string, red array<array<double>>, nir array<array<double>>, swir16 array<array<double>>, scl array<array<double>>, geometry_mask array<array<boolean>>, assets string")


def test_single_pixel(spark):
    r = grids.observe(patch(spark)).first()
    assert (r.ndvi_mean, r.ndmi_mean, r.valid_pixels) == (pytest.approx(0.5), pytest.approx(0.2), 1)
    v2 = {b: {"bands": [{"raster:scale": 1e-4, "raster:offset": -0.1, "nodata": 0}]} for b in grids.BANDS}
    r = grids.observe(patch(spark, meta=v2)).first()
    assert (r.ndvi_mean, r.ndmi_mean) == (pytest.approx(2 / 3), pytest.approx(0.25))
    for change in ({"red": 0.0}, {"scl": 9.0}, {"mask": False}, {"nir": None}, {"meta": {b: {"bands": [{"raster:scale": 1e-4, "raster:offset": -0.3}]} for b in grids.BANDS}}):
        r = grids.observe(patch(spark, **change)).first()
        assert r.valid_pixels == 0 and r.ndvi_mean is None, change
    r = grids.observe(patch(spark, swir=0.0)).first()
    assert r.ndvi_mean == pytest.approx(0.5) and r.ndmi_mean is None
    for bad in ({}, {b: {"raster:bands": []} for b in grids.BANDS}, {b: {"raster:bands": [{"scale": 0, "offset": 0}]} for b in grids.BANDS}):
        with pytest.raises(ContractError):
            grids.observe(patch(spark, meta=bad))


def observed(spark, change=lambda rows: rows):
    rows = [["f", "a", "2024-04-01T10:00Z", "2024-04-01T12:00Z", 0.2, 0.4, 2.0, 2.0, 4.0, 0.5], ["f", "b", "2024-04-01T11:00Z", "2024-04-01T12:00Z", 0.6, 0.4, 6.0, 6.0, 12.0, 0.5], ["f", "c", "2024-04-03T10:00Z", "2024-04-03T12:00Z", 0.7, 0.4, 4.0, 4.0, 8.0, 0.5]]
    return spark.createDataFrame(change(rows), "field_id string, item_id string, datetime string, available_at string, ndvi_mean double, ndmi_mean double, valid_pixels double, ndmi_valid_pixels double, geometry_pixels double, clear_fraction double")


def test_season(spark):
    daily, features = seasons.cutoff_features(observed(spark), "2024-04-10T00:00Z")
    d, f = daily.orderBy("date").collect(), features.first()
    assert (d[0].ndvi, d[0].item_count, len(d)) == (pytest.approx(0.5), 2, 2)
    assert f.auc_ndvi_days == pytest.approx(1.2) and str(f.peak_ndvi_date) == "2024-04-03" and f.cutoff_utc == "2024-04-10T00:00:00+00:00"
    late = seasons.cutoff_features(observed(spark, edit(2, 3, "2024-05-01T00:00Z")), "2024-04-10T00:00Z")
    assert late[0].count() == 1 and late[1].first().auc_ndvi_days is None and late[1].first().latest_ndvi == pytest.approx(0.5)
    early = seasons.cutoff_features(observed(spark), "2024-03-01T00:00Z")
    assert early[0].count() == early[1].count() == 0 and len(early[1].columns) == 13
    with pytest.raises(ContractError):
        seasons.cutoff_features(observed(spark).drop("available_at"), "2024-04-10T00:00Z")
    free = seasons.cutoff_features(observed(spark).drop("available_at"), "2024-04-10T00:00Z", require_available_at=False)[1].first()
    assert free.availability_filter_applied is False


@pytest.mark.parametrize("change", [edit(1, 1, "a"), edit(0, 9, 0.9), edit(0, 6, 1.5), edit(0, 6, 5.0), edit(0, 3, "2024-03-01T00:00Z"), edit(2, 2, "2023-04-03T10:00Z"), edit(0, 0, None)])
def test_bad_observations(spark, change):
    with pytest.raises(ContractError):
        seasons.cutoff_features(observed(spark, change), "2024-04-10T00:00Z")


CUBE = {"id": ["g", "t"], "size": [2, 2], "dimension": {"g": {"category": {"index": {"B": 1, "A": 0}}}, "t": {"category": {"index": ["x", "y"]}}}, "value": {"0": 4.0, "1": 4.5, "3": 3.75}, "status": {"1": "p", "2": ":"}}


def test_cube(spark):
    want = [("A", "x", 4.0, None, False), ("A", "y", 4.5, "p", False), ("B", "x", None, ":", True), ("B", "y", 3.75, None, False)]
    assert [tuple(r) for r in cube.cube_rows(spark, CUBE, include_missing=True).collect()] == want
    assert [tuple(r) for r in cube.cube_rows(spark, CUBE | {"value": [4.0, 4.5, None, 3.75], "status": "e"}).collect()] == [(a, b, v, "e", m) for a, b, v, _, m in want if v is not None]
    for bad in ({"id": ["g", "g"]}, {"size": [2, 3]}, {"value": {"4": 1}}, {"value": {"0": float("nan")}}, {"value": {"0": True}}, {"value": [1.0]}, {"size": [2, 0]}):
        with pytest.raises(ContractError):
            cube.cube_rows(spark, CUBE | bad)
    with pytest.raises(ContractError):
        cube.cube_rows(spark, CUBE, max_cells=3)


def test_catalog(spark, tmp_path):
    item = lambda i, v=0: {"type": "Feature", "collection": "c", "id": str(i), "properties": {"v": v}}
    host = "https://h.example/search"

    def served(second):
        def transport(method, url, body):
            if "token" in (body or {}):
                assert body["limit"] == 100
                return json.dumps({"type": "FeatureCollection", "features": second, "links": []}).encode()
            return json.dumps({"type": "FeatureCollection", "features": [item(1), item(2)], "links": [{"rel": "next", "href": "/search", "method": "POST", "merge": True, "body": {"token": "x"}}]}).encode()

        return transport

    wanted = catalog.query([1, 2, 3, 4], "2024-01-01", "2024-01-02")
    found = catalog.pages(Snapshots(tmp_path / "a", served([item(2), item(3)]), hosts=("h.example",)), host, wanted)
    assert [r.id for r in catalog.items(spark, found).collect()] == ["1", "2", "3"]
    assert catalog.pages(Snapshots(tmp_path / "a", None, hosts=("h.example",), offline=True), host, wanted) == found
    with pytest.raises(ContractError):
        catalog.items(spark, catalog.pages(Snapshots(tmp_path / "b", served([item(2, 9)]), hosts=("h.example",)), host, wanted))
    with pytest.raises(ContractError):
        catalog.pages(Snapshots(tmp_path / "c", served([item(2)]), hosts=("h.example",)), host, wanted, max_pages=1)
    next((tmp_path / "a").rglob("response.json")).write_bytes(b"{}")
    with pytest.raises(ContractError):
        catalog.pages(Snapshots(tmp_path / "a", None, hosts=("h.example",), offline=True), host, wanted)
    for bad in ([3, 2, 1, 4], [1, 2, 3], [0, 0, 200, 1]):
        with pytest.raises(ContractError):
            catalog.query(bad, "2024-01-01", "2024-01-02")


def test_request_plan(spark):
    plan = weather.request_plan(spark, "2024-12-30", "2024-12-31").collect()
    assert [(r.year, r.month, r.days) for r in plan] == [("2024", "12", ["30", "31"]), ("2025", "01", ["01"])] and plan[-1].times == ["00:00"]


def test_request_area(spark):
    plan = weather.request_plan(spark, "2024-12-31", "2024-12-31", (51, 4.5, 50, 6)).collect()
    assert [r.area for r in plan] == [[51.0, 4.5, 50.0, 6.0]] * 2
    for bad in ((50, 4, 51, 6), (51, 6, 50, 4), (91, 4, 50, 6), (51, -181, 50, 6), (51, 4, 50), (51, 4, float("nan"), 6)):
        with pytest.raises(ContractError):
            weather.request_plan(spark, "2024-12-31", "2024-12-31", bad)


def test_command_line_writes_into_a_fresh_folder(spark, tmp_path, capsys):
    from plumbline.__main__ import main

    (tmp_path / "cube.json").write_text(json.dumps(CUBE))
    out = str(tmp_path / "out")
    assert main(["cube", str(tmp_path / "cube.json"), out]) == 0 and (tmp_path / "out" / "public_table.csv").read_text().count("\n") >= 3
    assert main(["cube", str(tmp_path / "cube.json"), out]) == 2 and "not empty" in capsys.readouterr().err
