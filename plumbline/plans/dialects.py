"""The few words in which Spark's and DuckDB's SQL differ."""

from __future__ import annotations


#: Date patterns of the two engines.
PATTERNS = {"yyyy": "%Y", "MM": "%m", "dd": "%d"}


class Spark:
    name = "spark"

    def hours(self, n: str) -> str:
        return f"make_interval(0, 0, 0, 0, {n}, 0, 0)"

    def days_between(self, later: str, earlier: str) -> str:
        return f"datediff({later}, {earlier})"

    def first_at_peak(self, d: str, v: str) -> str:
        return f"min_by({d}, struct(-({v}) AS v, {d} AS d))"

    def max_by(self, x: str, *by: str) -> str:
        return f"max_by({x}, struct({', '.join(by)}))"

    def days(self, a: str, b: str) -> str:
        return f"(SELECT explode(sequence(DATE'{a}', DATE'{b}', INTERVAL 1 DAY)) AS d)"

    def series(self, n: str) -> str:
        return f"(SELECT id AS i FROM range({n}))"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def text(self, x: str) -> str:
        return f"cast({x} AS string)"

    def json(self, x: str, path: str) -> str:
        return f"get_json_object({x}, '{path}')"

    def try_double(self, x: str) -> str:
        return f"try_cast({x} AS double)"

    def epoch(self, x: str) -> str:
        return f"(unix_micros(cast({x} AS timestamp)) / 1e6D)"

    def join_sorted(self, x: str) -> str:
        return f"array_join(array_sort(collect_set({x})), ',')"

    def div(self, a: str, b: str) -> str:
        return f"({a} div {b})"

    def format(self, d: str, pattern: str) -> str:
        return f"date_format({d}, '{pattern}')"

    def last_known(self, x: str) -> str:
        return f"last_value({x}) IGNORE NULLS"


class Duck(Spark):
    name = "duckdb"

    def hours(self, n: str) -> str:
        return f"to_hours({n})"

    def days_between(self, later: str, earlier: str) -> str:
        return f"date_diff('day', CAST({earlier} AS DATE), CAST({later} AS DATE))"

    def first_at_peak(self, d: str, v: str) -> str:
        return f"arg_min({d}, {{'a': -({v}), 'b': {d}}})"

    def max_by(self, x: str, *by: str) -> str:
        return f"arg_max({x}, {{{', '.join(f"'k{i}': {b}" for i, b in enumerate(by))}}})"

    def days(self, a: str, b: str) -> str:
        return f"(SELECT CAST(unnest(generate_series(DATE '{a}', DATE '{b}', INTERVAL 1 DAY)) AS DATE) AS d)"

    def series(self, n: str) -> str:
        return f"(SELECT unnest(range({n})) AS i)"

    def sha(self, x: str) -> str:
        return f"sha256({x})"

    def text(self, x: str) -> str:
        return f"CAST({x} AS VARCHAR)"

    def json(self, x: str, path: str) -> str:
        return f"json_extract_string({x}, '{path}')"

    def try_double(self, x: str) -> str:
        return f"TRY_CAST({x} AS DOUBLE)"

    def epoch(self, x: str) -> str:
        return f"(epoch_us({x}) / 1e6)"

    def join_sorted(self, x: str) -> str:
        return f"array_to_string(list_sort(list_distinct(list({x}))), ',')"

    def div(self, a: str, b: str) -> str:
        return f"({a} // {b})"

    def format(self, d: str, pattern: str) -> str:
        return f"strftime({d}, '{PATTERNS[pattern]}')"

    def last_known(self, x: str) -> str:
        return f"last_value({x} IGNORE NULLS)"


SPARK, DUCK = Spark(), Duck()
