"""An embedder that asks a remote service in batches."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable

import numpy as np

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.operators.embed import retryable_status, retrying

MAX_CHARS = 7000  # what a request sends of a text unless told otherwise


def sent_text(text: Column, max_chars: int = MAX_CHARS) -> Column:
    """What is sent of a text."""
    return F.substring(text, 1, max_chars)


class ServiceError(RuntimeError):
    def __init__(self, status: int, message: str):
        super().__init__(f"status {status}: {message[:500]}")
        self.status = status


def http_embedder(url: str, headers: dict[str, str], request: Callable[[list[str], str], dict], vectors: Callable[[dict], list[list[float]]], timeout: float = 30, attempts: int = 5, wait: float = 2.0, max_chars: int = MAX_CHARS):
    """An embedder over HTTP: ``request`` makes the JSON body of texts and their role, ``vectors`` reads the
    answer. Texts are sent up to ``max_chars`` characters. Too many requests and server errors are tried again with doubled waiting; another number of
    vectors than of texts is an error.
    """

    def call(texts: list[str], role: str) -> np.ndarray:
        body = json.dumps(request([t[:max_chars] for t in texts], role)).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json", **headers}), timeout=timeout) as answer:
                got = vectors(json.loads(answer.read()))
        except urllib.error.HTTPError as e:
            raise ServiceError(e.code, e.read().decode("utf-8", "replace")) from e
        if len(got) != len(texts):
            raise RuntimeError(f"{len(got)} embeddings for {len(texts)} texts")
        return np.asarray(got, np.float32)

    return retrying(call, lambda e: isinstance(e, ServiceError) and retryable_status(e.status), attempts, wait)
