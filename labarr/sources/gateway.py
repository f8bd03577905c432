"""Content from an HTTP gateway, with byte ranges and retries; saving and pinning by RPC."""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable

from .stores import Blocks, cut


class HttpStatusError(IOError):
    def __init__(self, what: str, status: int, retry_after: str | None = None):
        super().__init__(f"{what}: {status}")
        self.status = status
        wait = (retry_after or "").strip()
        self.retry_after = min(int(wait), 30) if wait.isascii() and wait.isdigit() else None


def retryable(error: BaseException) -> bool:
    """Statuses 429 and 5xx, time-outs and broken connections."""
    if isinstance(error, HttpStatusError):
        return error.status >= 500 or error.status == 429
    return isinstance(error, (TimeoutError, ConnectionError, urllib.error.URLError))


def http(method: str, url: str, headers: dict[str, str], body: bytes | None) -> tuple[int, dict[str, str], bytes]:
    """Status, headers and body of a request; statuses do not raise."""
    request = urllib.request.Request(url, body, headers, method=method)
    try:
        with urllib.request.urlopen(request, timeout=60) as got:
            return got.status, dict(got.headers), got.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read()


class Gateway(Blocks):
    """Parallelism comes from Spark tasks, each with one request at a time; scans through a
    gateway have no more than ``parallel`` tasks."""

    def __init__(self, gateway: str, rpc: str = "http://127.0.0.1:5001", headers: dict[str, str] | None = None, retries: int = 3, delay: float = 1.0, factor: float = 2.0, fetch: Callable = http, sleep: Callable[[float], None] = time.sleep, parallel: int = 32):
        self.parallel = parallel
        base = gateway.rstrip("/")
        self.gateway = base + "/" if base.endswith("/ipfs") else base + "/ipfs/"
        self.rpc, self.headers = rpc.rstrip("/"), headers or {}
        self.retries, self.delay, self.factor, self.fetch, self.sleep = retries, delay, factor, fetch, sleep

    def _request(self, what: str, method: str, url: str, headers: dict | None = None, body: bytes | None = None) -> tuple[int, bytes]:
        for attempt in range(self.retries + 1):
            try:
                status, got, data = self.fetch(method, url, self.headers | (headers or {}), body)
                if not 200 <= status < 300:
                    raise HttpStatusError(what, status, {k.lower(): v for k, v in got.items()}.get("retry-after"))
                return status, data
            except Exception as e:
                if attempt == self.retries or not retryable(e):
                    raise
                wait = getattr(e, "retry_after", None)
                pause = self.delay * self.factor**attempt
                self.sleep(wait if wait is not None else pause * (1 + 0.1 * random.random()))
        raise AssertionError("unreachable")

    def block(self, cid: str) -> bytes:
        return self._request("gateway block", "GET", f"{self.gateway}{cid}?format=raw", {"Accept": "application/vnd.ipld.raw"})[1]

    def cat(self, cid: str, offset: int | None = None, length: int | None = None, suffix: int | None = None) -> bytes:
        span = None
        if offset is not None:
            span = f"bytes={offset}-" + ("" if length is None else str(offset + length - 1))
        elif suffix is not None:
            span = f"bytes=-{suffix}"
        status, data = self._request("gateway load", "GET", f"{self.gateway}{cid}", {"Range": span} if span else None)
        if span and status not in (200, 206):
            raise IOError(f"gateway ranged load: unexpected status {status}")
        # a gateway may answer a range with everything
        return cut(data, offset, length, suffix) if span and status == 200 else data

    def save(self, data: bytes) -> str:
        """Adds a file and returns its identifier."""
        mark = uuid.uuid4().hex
        body = f'--{mark}\r\nContent-Disposition: form-data; name="file"; filename="blob"\r\nContent-Type: application/octet-stream\r\n\r\n'.encode() + data + f"\r\n--{mark}--\r\n".encode()
        got = self._request("add", "POST", f"{self.rpc}/api/v0/add", {"Content-Type": f"multipart/form-data; boundary={mark}"}, body)[1]
        return json.loads(got)["Hash"]

    def _pin(self, verb: str, *args: str, recursive: bool = True) -> bytes:
        query = [("recursive", "true")] * (recursive and verb in ("add", "rm")) + [("arg", a) for a in args]
        return self._request(f"pin/{verb}", "POST", f"{self.rpc}/api/v0/pin/{verb}?{urllib.parse.urlencode(query)}")[1]

    def pin(self, cid: str) -> None:
        self._pin("add", cid)

    def unpin(self, cid: str) -> None:
        self._pin("rm", cid)

    def pin_update(self, old: str, new: str) -> None:
        self._pin("update", old, new)

    def pins(self) -> list[dict]:
        keys = json.loads(self._pin("ls")).get("Keys") or {}
        return [{"cid": k, **v} for k, v in keys.items()]
