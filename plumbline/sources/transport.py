"""Real transports: allow-listed hosts, checked redirects, bounded responses.

``Reader`` makes one GET for the archive, ``Exchanger`` GETs and POSTs for snapshots.  Both take an
``opener`` (urllib's by default), so tests need no network.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from typing import Any

from plumbline.operators.contracts import ContractError
from plumbline.sources.evidence import HttpStatus, canonical, public_url

#: Fixed limits: bytes of an archive response and of a snapshot response, seconds and attempts of the latter, statuses tried again.
READ_BYTES, EXCHANGE_BYTES, EXCHANGE_SECONDS, ATTEMPTS = 2_000_000, 16 << 20, 30.0, 3
AGAIN = frozenset({429, 500, 502, 503, 504})
FORBIDDEN = ("?", "#", "..", "//")
Opener = Callable[..., Any]


class Redirects(urllib.request.HTTPRedirectHandler):
    """Follows a redirect only to an address that `allowed` accepts (it raises for others)."""

    def __init__(self, allowed: Callable[[str], Any]) -> None:
        self.allowed = allowed

    def redirect_request(self, req, fp, code, msg, headers, newurl):  # noqa: ANN001, ANN201
        self.allowed(newurl)
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def refused(url: str) -> None:
    raise ContractError(f"redirected to {urllib.parse.urlsplit(url).netloc}")


def whole(response: Any, most: int) -> bytes:
    """The response's bytes; one more than allowed raises."""
    raw = response.read(most + 1)
    if len(raw) > most:
        raise ContractError(f"a response of more than {most} bytes")
    return raw


class Reader:
    """One GET of JSON from an allowed base and a plain path; no redirects."""

    def __init__(self, bases: tuple[str, ...], opener: Opener | None = None) -> None:
        self.bases, self.open = bases, opener or urllib.request.build_opener(Redirects(refused)).open

    def __call__(self, base: str, path: str, params: dict, seconds: float = 20) -> Any:
        if base not in self.bases:
            raise ContractError("not an allowed host")
        if not path.startswith("/") or any(x in path for x in FORBIDDEN):
            raise ContractError("not a plain path")
        query = urllib.parse.urlencode(params)
        try:
            with self.open(urllib.request.Request(f"{base}{path}?{query}" if query else base + path), timeout=seconds) as response:
                return json.loads(whole(response, READ_BYTES))
        except urllib.error.HTTPError as e:
            raise HttpStatus(e.code, e.headers.get("Retry-After") if e.headers else None) from e
        except urllib.error.URLError as e:
            raise e.reason if isinstance(e.reason, TimeoutError) else ConnectionError(str(e.reason)) from e


class Exchanger:
    """GET or POST of JSON bytes to allowed https hosts; redirects stay among them, some statuses are tried again."""

    def __init__(self, hosts: tuple[str, ...], opener: Opener | None = None, sleep: Callable[[float], None] = time.sleep) -> None:
        self.hosts, self.sleep = hosts, sleep
        self.open = opener or urllib.request.build_opener(Redirects(lambda url: public_url(url, hosts))).open

    def __call__(self, method: str, url: str, body: dict | None) -> bytes:
        data = None if body is None else canonical(body, False)
        request = urllib.request.Request(public_url(url, self.hosts), data=data, method=method, headers={"Accept": "application/json"} | ({"Content-Type": "application/json"} if data else {}))
        for nth in range(1, ATTEMPTS + 1):
            try:
                with self.open(request, timeout=EXCHANGE_SECONDS) as response:
                    public_url(response.geturl(), self.hosts)
                    raw = whole(response, EXCHANGE_BYTES)
                    json.loads(raw)
                    return raw
            except urllib.error.HTTPError as e:
                if e.code not in AGAIN or nth == ATTEMPTS:
                    raise HttpStatus(e.code) from e
                self.sleep(float(1 << (nth - 1)))
        raise AssertionError("unreachable")
