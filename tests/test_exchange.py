"""The second exchange's pages, checkpoints and metadata; books and reports of a run."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import exchange as contract
from plumbline.operators.contracts import ContractError
from plumbline.sources import books, exchange
from plumbline.sources.evidence import Archive, HttpStatus

NOW = 1_700_000_000.0
BASE = "https://x"


def trade(i, ticker="T", **change):
    return {"trade_id": str(i), "ticker": ticker, "created_time": "2024-01-01T00:00:00Z", "yes_price_dollars": "0.4", "no_price_dollars": 0.6, "count_fp": "1.00"} | change


def archive(tmp_path, answers, now=NOW):
    asked = []

    def send(base, path, params, seconds):
        asked.append((path, params))
        answer = answers(path, params)
        if isinstance(answer, Exception):
            raise answer
        return answer

    a = Archive(tmp_path, send, clock=lambda: now + len(asked), sleep=lambda s: None, source_label="replay")
    a.asked = asked
    return a


def verdicts(spark, pages):
    rows = [(i, kind, body if isinstance(body, str) else json.dumps(body), cursor, "raw") for i, (kind, body, cursor) in enumerate(pages)]
    return {r.page_id: r for r in contract.judged(spark.createDataFrame(rows, contract.FETCHED)).collect()}


def test_page_contract(spark):
    good = [("trades", {"trades": [trade(1), trade(2)], "cursor": "b"}, "a"), ("events", {"events": [{"event_ticker": "E"}], "cursor": ""}, None), ("markets", {"markets": [], "cursor": None}, "a"), ("trades", {"trades": []}, None)]
    got = verdicts(spark, good)
    assert [(got[i].reason, got[i].next_cursor, got[i].row_count) for i in range(4)] == [(None, "b", 2), (None, None, 1), (None, None, 0), (None, None, 0)]
    bad = [
        ("others", {"others": []}, None), ("trades", "[]", None), ("trades", "no json", None), ("trades", {"trades": {}}, None), ("trades", {"trades": [trade(1)], "cursor": 5}, None), ("trades", {"trades": [trade(1)], "cursor": "a"}, "a"),
        ("trades", {"trades": [], "cursor": "b"}, "a"), ("events", {"events": [{"ticker": "E"}]}, None), ("events", {"events": [None]}, None), ("markets", {"markets": [{"ticker": ""}]}, None),
        *(("trades", {"trades": [trade(1), trade(2, **x)]}, None) for x in (
            {"trade_id": 5}, {"ticker": None}, {"created_time": "2024-01-01T00:00:00"}, {"created_time": 5}, {"yes_price_dollars": "1.01"}, {"no_price_dollars": "-0.1"}, {"count_fp": 0}, {"count_fp": "NaN"}, {"count_fp": True}, {"yes_price_dollars": "x"},
        )),
    ]
    assert all(r.reason for r in verdicts(spark, bad).values())


def test_backfill_keeps_its_bound_and_head_leaves_the_checkpoint(spark, tmp_path):
    script = {None: {"trades": [trade(1), trade(2)], "cursor": "a"}, "a": {"trades": [trade(2), trade(3)], "cursor": None}}
    a = archive(tmp_path, lambda path, p: script[p.get("cursor")])
    store = exchange.Exchange(spark, tmp_path / "store")
    state = lambda: [tuple(r) for r in store.read("checkpoints").collect()]
    first = exchange.page(store, a, BASE, "/trades", "trades")
    assert (first["inserted_trades"], first["cursor_pending"]) == (2, True) and a.asked[0][1] == {"limit": 500, "max_ts": int(NOW)}
    before = state()
    head = exchange.page(store, a, BASE, "/trades", "trades", head=True)
    assert head["inserted_trades"] == 0 and state() == before == [("/trades", "a", int(NOW), 0)]
    assert a.asked[1][1]["max_ts"] > int(NOW) and "cursor" not in a.asked[1][1]
    second = exchange.page(store, a, BASE, "/trades", "trades")
    assert a.asked[2][1] == {"limit": 500, "max_ts": int(NOW), "cursor": "a"}
    assert second["endpoint_exhausted"] and second["inserted_trades"] == 1 and store.read("trades").count() == 3
    assert state()[0][1] is None and state()[0][2] > int(NOW) and state()[0][3] == 1 and store.read("page_cursors").isEmpty()


def test_circles_and_bad_pages_change_nothing(spark, tmp_path):
    pages = iter([{"trades": [trade(1)], "cursor": "a"}, {"trades": [trade(2)], "cursor": "b"}, {"trades": [trade(3)], "cursor": "a"}, {"trades": [trade(4, count_fp=-1)], "cursor": "z"}])
    a = archive(tmp_path, lambda path, p: next(pages))
    store = exchange.Exchange(spark, tmp_path / "store")
    exchange.page(store, a, BASE, "/trades", "trades")
    exchange.page(store, a, BASE, "/trades", "trades")
    keep = store.version
    for _ in range(2):
        with pytest.raises(ContractError):
            exchange.page(store, a, BASE, "/trades", "trades")
        assert store.version == keep


def test_objects_and_hydrate(spark, tmp_path):
    answers = {
        "/trades": {"trades": [trade(1, "A"), trade(2, "A"), trade(3, "B"), trade(4, "C")]}, "/events": {"events": [{"event_ticker": "EB", "category": "old", "secret": 1}]},
        "/markets/A": {"market": {"ticker": "A", "event_ticker": "EA", "title": None}}, "/events/EA": {"event": {"event_ticker": "EA", "category": "sport"}},
        "/markets/B": HttpStatus(404), "/historical/markets/B": {"market": {"ticker": "B", "event_ticker": "EB"}}, "/markets/C": {"market": {"ticker": "other"}},
    }
    a = archive(tmp_path, lambda path, p: answers[path])
    store = exchange.Exchange(spark, tmp_path / "store")
    exchange.page(store, a, BASE, "/trades", "trades")
    exchange.page(store, a, BASE, "/events", "events")
    assert a.asked[1][1] == {"limit": 100, "with_nested_markets": "false"}
    assert json.loads(store.read("objects").first().metadata) == {"event_ticker": "EB", "category": "old"}
    got = exchange.hydrate(store, a, BASE)
    assert got["category_trade_counts"] == {"sport": 2, "old": 1, "UNKNOWN": 1} and (got["pending_tickers"], got["unmapped_trades"]) == (1, 1)
    assert [f["ticker"] for f in got["failures"]] == ["C"] and store.read("metadata_attempts").count() == 3
    assert json.loads(store.read("objects").where("id = 'A'").first().metadata) == {"ticker": "A", "event_ticker": "EA", "title": None}
    late = archive(tmp_path / "late", lambda path, p: answers[path])
    late.started -= exchange.SECONDS + 5
    assert exchange.hydrate(store, late, BASE)["pending_tickers"] == 1 and not late.asked


def test_tables_grow_by_parts(spark, tmp_path, monkeypatch):
    from plumbline.sources import store as module

    monkeypatch.setattr(module, "MOST_PARTS", 3)
    store = exchange.Exchange(spark, tmp_path)
    row = lambda i: spark.createDataFrame([("T", str(i), "t", "r")], exchange.Exchange.schemas["trades"])
    sizes = []
    for i in range(5):
        store.commit({"trades": row(i)})
        sizes.append(len(store.parts()["trades"]))
    assert sizes == [1, 2, 3, 1, 2] and store.read("trades").count() == 5
    keep = store.version
    store.commit(trades=row(9))
    assert store.read("trades").count() == 1
    store.pointer.write_text(keep)
    assert store.read("trades").agg(F.max("trade_id")).first()[0] == "4"


def test_tokens():
    market = {"conditionId": "m", "closed": False, "acceptingOrders": True, "clobTokenIds": '["x", "y"]'}
    assert books.tokens_of([market], "m") == (["x", "y"], None)
    for listed in ([], [market | {"conditionId": "n"}], [market | {"closed": True}], [market | {"acceptingOrders": 1 == 2}], [market | {"closed": None}]):
        assert books.tokens_of(listed, "m")[0] == [] and books.tokens_of(listed, "m")[1]
    for listed in ({}, [None], [market, market], *([market | {"clobTokenIds": t}] for t in (["x"], ["x", "x"], ["x", ""], ["x", 5], "{}"))):
        with pytest.raises(ContractError):
            books.tokens_of(listed, "m")


def test_books_and_report(spark, tmp_path):
    good = {"asset_id": "x", "timestamp": str(int(NOW * 1000)), "min_order_size": "1", "bids": [{"price": ".9", "size": "20"}], "asks": [{"price": ".95", "size": "20"}]}
    answers = {
        ("/markets", "m"): [{"conditionId": "m", "closed": False, "acceptingOrders": True, "clobTokenIds": ["x", "y"]}], ("/markets", "n"): [], ("/markets", "o"): {},
        ("/book", "x"): good, ("/fee-rate", "x"): {"base_fee": 0}, ("/book", "y"): good | {"asset_id": "y", "bids": []}, ("/fee-rate", "y"): {"base_fee": 10001},
    }
    a = archive(tmp_path, lambda path, p: answers[path, p.get("condition_ids") or p["token_id"]])
    manifest = [{"condition": c, "closed": c == "z"} for c in "mnoz"]
    got = books.collect_books(spark, a, BASE, BASE, manifest)
    x, y = got["books"]
    assert x["valid_quote"] and x["fee_available"] and x["base_fee"] == 0 and x["spread"] == pytest.approx(0.05) and x["book_raw_file"]
    assert not y["valid_quote"] and y["quote_error"] and not y["fee_available"] and y["fee_error"] == "invalid fee rate" and y["base_fee"] is None
    assert [s["condition"] for s in got["book_skips"]] == ["n"] and [e["condition"] for e in got["errors"]] == ["o"] and not got["snapshot_quality_passed"]
    report = books.quality({"errors": [], "trade_index": {"fingerprints": 4, "first_ts": 1, "last_ts": 2}, "source_label": "replay", "validated_pages": 4, "files": 8, "retries": 0}, got)
    assert report["counts"] == {"errors": 1, "skips": 1, "books": 2, "invalid_quotes": 1, "missing_fees": 1} and not report["collection_complete_without_errors"]
    text = books.markdown(report)
    assert "| Distinct rows | 4 |" in text and "- books, o:" in text and text.count("\n- ") == 1 + len(books.WARNINGS)
    assert books.collect_books(spark, a, BASE, BASE, manifest[:0])["snapshot_quality_passed"] is False
    only = books.collect_books(spark, archive(tmp_path / "b", lambda path, p: answers[path, "x"] if "token_id" in p else answers["/markets", "m"]), BASE, BASE, manifest[:1])
    assert [b["valid_quote"] for b in only["books"]] == [True, False] and only["books"][1]["quote_error"] == "book token mismatch"
