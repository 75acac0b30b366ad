"""Upload of ingest requests over HTTPS, a few connections at a time."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame

#: Fixed values of the receiving interface.
INGEST_PATH, MAX_RESPONSE_BYTES = "/v1/history/ingest", 1 << 20
OUTCOME = "record_id string, outcome string, code int, error string"

Send = Callable[[str, bytes, dict[str, str], float], tuple[int, bytes]]


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


def post(url: str, body: bytes, headers: dict[str, str], timeout: float) -> tuple[int, bytes]:
    """Status and body of a POST; redirects aren't followed, so that the token stays with its host."""
    request = urllib.request.Request(url, body, headers, method="POST")
    try:
        with urllib.request.build_opener(_NoRedirect).open(request, timeout=timeout) as answer:
            return answer.status, answer.read(MAX_RESPONSE_BYTES + 1)
    except urllib.error.HTTPError as error:
        return error.code, b""


def judge(code: int, body: bytes, record_id: str) -> tuple[str, str | None]:
    """``done``, ``retry`` or ``failed`` for an answer, and why."""
    if code == 429 or code >= 500:
        return "retry", f"HTTP {code}"
    if not 200 <= code <= 299:
        return "failed", f"HTTP {code}"
    try:
        answer = json.loads(body) if len(body) <= MAX_RESPONSE_BYTES else None
    except ValueError:
        answer = None
    if not isinstance(answer, dict) or answer.get("accepted") is not True or answer.get("record_id") != record_id:
        return "failed", "the answer does not accept this record"
    return "done", None


def upload(requests: DataFrame, endpoint: str, token: str, timeout: float = 30.0, connections: int = 8, send: Send = post) -> DataFrame:
    """``record_id, outcome, code, error`` of each request (``record_id, request_sha256, body``).

    The record id is the idempotency key, so what a task sends again after a lost
    executor is accepted once. Requests without a body or record id fail unsent; a
    connection that breaks is to be retried. Outcomes ``retry`` belong in the retry queue.
    """
    where = urlsplit(endpoint)
    if where.scheme != "https" or not where.netloc or not token or timeout <= 0:
        raise ValueError("an https endpoint, a token and a positive timeout are needed")
    url = endpoint.rstrip("/") + INGEST_PATH

    def one(record_id: str | None, digest: str | None, body: str | None) -> tuple:
        if not record_id or body is None:
            return record_id, "failed", None, "no request"
        headers = {"Authorization": f"Bearer {token}", "Content-Type": "application/json", "Idempotency-Key": record_id, "X-Request-SHA256": digest or ""}
        try:
            code, answer = send(url, body.encode(), headers, timeout)
        except OSError as error:
            return record_id, "retry", None, str(error)
        return record_id, (judged := judge(code, answer, record_id))[0], code, judged[1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [one(*(None if pd.isna(x) else x for x in r)) for r in frame.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["record_id", "outcome", "code", "error"]).astype({"code": "Int32"})

    return requests.select("record_id", "request_sha256", "body").repartition(connections).mapInPandas(run, OUTCOME)
