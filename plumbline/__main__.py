"""python -m plumbline weather | satellite | cube | verify: exit 0 on success, 2 where a contract or an audit fails."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from plumbline.operators import audit, cube, grids, seasons, weather
from plumbline.operators.contracts import ContractError
from plumbline.session import session
from plumbline.sources.ledger import Ledger
from plumbline.sources.sinks import fresh_dir, write_csv, write_json

PATCH = "field_id string, item_id string, datetime string, available_at string, red array<array<double>>, nir array<array<double>>, swir16 array<array<double>>, scl array<array<double>>, geometry_mask array<array<boolean>>, assets string"


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="plumbline")
    sub = p.add_subparsers(dest="what", required=True)
    w = sub.add_parser("weather")
    for name in ("hourly", "start", "end", "output"):
        w.add_argument(name)
    w.add_argument("--available-by")
    s = sub.add_parser("satellite")
    for name in ("patches", "cutoff", "output"):
        s.add_argument(name)
    c = sub.add_parser("cube")
    for name in ("document", "output"):
        c.add_argument(name)
    c.add_argument("--include-missing", action="store_true")
    v = sub.add_parser("verify")
    v.add_argument("root")
    a = p.parse_args(args)
    spark = session()
    try:
        if a.what == "verify":
            found = audit.verify(spark, f"file://{Path(a.root).resolve()}", Ledger(spark, Path(a.root).resolve() / "ledger"))
            print(json.dumps(found, indent=2, sort_keys=True))
            return 0 if found["passed"] else 2
        out = fresh_dir(a.output)
        if a.what == "weather":
            daily = weather.daily_weather(spark.read.option("header", True).csv(a.hourly), a.start, a.end, available_by=a.available_by)
            write_csv(daily, out / "weather_daily.csv", ["date"])
            write_json(weather.weather_summary(daily).first().asDict(), out / "weather_summary.json")
        elif a.what == "satellite":
            rows = json.loads(Path(a.patches).read_text())["observations"]
            number = lambda g: [[None if x is None else float(x) for x in r] for r in g]
            patches = spark.createDataFrame([(r["field_id"], r["item_id"], r["datetime"], r["available_at"], *(number(r[b]) for b in ("red", "nir", "swir16", "scl")), r.get("geometry_mask"), json.dumps(r["assets"])) for r in rows], PATCH)
            seen = grids.observe(patches)
            daily, features = seasons.cutoff_features(seen, a.cutoff)
            write_csv(seen, out / "satellite_observations.csv", ["field_id", "item_id"])
            write_csv(daily, out / "satellite_daily.csv", ["field_id", "date"])
            write_csv(features, out / "satellite_features.csv", ["field_id"])
        else:
            data = json.loads(Path(a.document).read_text())
            write_csv(cube.cube_rows(spark, data, include_missing=a.include_missing), out / "public_table.csv", data["id"])
    except (ContractError, FileNotFoundError, FileExistsError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
