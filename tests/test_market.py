"""Collection, state machine, audit, books and outcomes."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import audit, book
from plumbline.operators.contracts import ContractError
from plumbline.sources.evidence import Archive, HttpStatus, Limits
from plumbline.sources.ledger import Ledger, collect

NOW = 1_800_000_000.0
MANIFEST = [{"condition": c, "event_id": f"e-{c}", "source_group": "g", "closed": c == "shut"} for c in ("open", "shut")]


def trade(condition, tx, size=1.0, **more):
    return {"condition_id": condition, "token_id": "t", "transaction_hash": tx, "timestamp": NOW - 10, "price": 0.5, "size": size, "side": "BUY"} | more


def page(rows, cursor=None):
    return {"data": rows, "pagination": {"has_more": cursor is not None, "next_cursor": cursor}}


class Replay:
    """Scripted responses: a repeated row over two pages, one retry, then a page that is repaired in the second pass."""

    def __init__(self):
        self.repaired, self.busy = False, True

    def __call__(self, base, path, params, timeout):
        at = (params["condition"], params.get("cursor"))
        if at == ("open", "c-a") and self.busy:
            self.busy = False
            raise HttpStatus(429, "2")
        return {
            ("open", None): page([trade("open", "a")], "c-a"),
            ("open", "c-a"): page([trade("open", "a"), trade("open", "b")], "c-b"),
            ("open", "c-b"): page([trade("open", "c")]),
            ("shut", None): page([trade("shut", "d", 1.0 if self.repaired else 0.0)]),
        }[at]


@pytest.fixture
def run(spark, tmp_path):
    replay, slept = Replay(), []
    ledger = Ledger(spark, tmp_path / "ledger")

    def once(manifest=MANIFEST):
        archive = Archive(tmp_path, replay, clock=lambda: NOW, sleep=slept.append, source_label="replay")
        return collect(ledger, archive, "https://x", manifest, max_pages=2)

    once.replay, once.ledger, once.root, once.slept = replay, ledger, str(tmp_path), slept
    return once


def test_two_passes(spark, run):
    first = run()
    assert first["retries"] == 1 and run.slept == [2.0] and first["validated_pages"] == 2
    assert [e["condition"] for e in first["errors"]] == ["shut"] and first["trades"]["open"]["identical_rows"] == 1
    run.replay.repaired = True
    second = run()
    assert second["validated_pages"] == 4 and second["trade_index"]["fingerprints"] == 4 and not second["errors"]
    state = {m["condition"]: m for m in second["inventory"]}
    assert state["open"]["exhausted"] and state["shut"]["exhausted"] and state["shut"]["closure_refresh"] == "none"
    found = audit.verify(spark, f"file://{run.root}", run.ledger)
    assert found["passed"], found["problems"]
    # closing an exhausted open market asks for one fresh traversal
    closed = [m | {"closed": True} for m in MANIFEST]
    run.ledger.register(closed, NOW)
    assert {r.condition: r.closure_refresh for r in run.ledger.read("markets").collect()} == {"open": "pending", "shut": "none"}
    # tampering with a row, a page's cursor or a checkpoint is found
    rows, pages, markets = (run.ledger.read(n) for n in ("rows", "pages", "markets"))
    for change in ({"rows": rows.withColumn("ts", F.col("ts") + 1)}, {"pages": pages.withColumn("next_cursor", F.lit("x"))}, {"rows": rows.limit(2)}, {"markets": markets.withColumn("cursor", F.lit("y"))}, {"markets": markets.limit(1)}):
        keep = run.ledger.version
        run.ledger.commit(**change)
        assert not audit.verify(spark, f"file://{run.root}", run.ledger)["passed"], list(change)
        run.ledger.pointer.write_text(keep)


@pytest.mark.parametrize("bad", [{"price": True}, {"size": 0}, {"side": "buy"}, {"timestamp": 1.5}, {"timestamp": NOW + 301}, {"transaction_hash": None}, {"transaction_hash": 5}, {"token_id": ""}, {"condition_id": "other"}, {"timestamp": True}])
def test_one_bad_row_rejects_its_page(spark, bad):
    from plumbline.operators.trades import judged

    pages = [(0, "m", NOW, json.dumps(page([trade("m", "a"), trade("m", "b", **bad)]))), (1, "m", NOW, json.dumps(page([trade("m", "c")])))]
    got = {r.page_id: r.reason for r in judged(spark.createDataFrame(pages, "page_id long, condition string, received_at double, body string")).collect()}
    assert got[0] is not None and got[1] is None


def test_bad_pages(spark):
    from plumbline.operators.trades import judged

    bodies = ["[]", "{}", json.dumps({"data": []}), json.dumps({"data": [], "pagination": {"has_more": 1}}), json.dumps({"data": [], "pagination": {"has_more": True, "next_cursor": "x"}}), json.dumps({"data": [], "pagination": {"has_more": False, "next_cursor": 5}}), json.dumps({"data": [None], "pagination": {"has_more": False}})]
    got = judged(spark.createDataFrame([(i, "m", NOW, b) for i, b in enumerate(bodies)], "page_id long, condition string, received_at double, body string")).collect()
    assert len(got) == len(bodies) and all(r.reason for r in got)


def test_limits():
    for bad in ({"attempts": True}, {"run_bytes": 0}, {"run_seconds": float("nan")}, {"response_bytes": 1.5}):
        with pytest.raises(ContractError):
            Limits(**bad)


def quote(spark, **change):
    base = {"token": "t", "received_at": 1001.0, "asset_id": "t", "timestamp": "1000000", "min_order_size": "1", "bids": [(".92", "20")], "asks": [(".95", "20")]} | change
    df = spark.createDataFrame([tuple(base.values())], "token string, received_at double, asset_id string, timestamp string, min_order_size string, bids array<struct<price:string,size:string>>, asks array<struct<price:string,size:string>>")
    return book.quotes(df).first(), book.diagnostics(df).first()


def test_quotes(spark):
    assert quote(spark)[0].ask == 0.95
    assert quote(spark, asks=[(".5", "1"), (".5", "1")], bids=[(".4", "9")])[0].ask_size == 2
    for bad in ({"timestamp": "1000"}, {"asset_id": "u"}, {"min_order_size": "5"}, {"asks": [(".9", "20")]}, {"bids": [(".9", "0")]}, {"asks": [("NaN", "20")]}, {"asks": [(".95", ".1")]}, {"received_at": 994.0}, {"received_at": 1121.0}, {"bids": []}):
        assert quote(spark, **bad)[0].reason, bad
    d = quote(spark, asks=[(".9", "100")], min_order_size="5")[1]
    assert d.fresh and not d.stake_meets_minimum and d.minimum_notional == pytest.approx(4.5) and d.top_depth_covers_stake and d.top_depth_covers_minimum


def test_outcome(spark):
    cases = [(True, "resolved", '["no","yes"]', "[0,1]", "yes", 1), (True, "resolved", '["no","yes"]', "[0,1]", "no", 0), (True, "resolved", json.dumps('["no","yes"]'), json.dumps('["0","1"]'), "yes", 1), (True, "proposed", '["no","yes"]', "[0,1]", "yes", None), (True, "resolved", '["no","yes"]', "[0.01,0.99]", "yes", None), (True, "resolved", '["no","yes"]', "[0,1]", "x", None), (True, "resolved", '["a","a"]', "[0,1]", "a", None), (True, "resolved", '["no","yes"]', '["NaN",1]', "yes", None), (False, "resolved", '["no","yes"]', "[0,1]", "yes", None)]
    df = spark.createDataFrame(cases, "closed boolean, status string, tokens string, prices string, token string, want int")
    c = F.col
    for r in df.select("want", book.outcome(c("closed"), c("status"), c("tokens"), c("prices"), c("token")).alias("got")).collect():
        assert r.got == r.want
