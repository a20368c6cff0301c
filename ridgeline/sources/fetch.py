"""Fetching from services: answers and files, tried again, stored whole."""

from __future__ import annotations

import http.client
import json
import time
import urllib.parse
import urllib.request

from pyspark.sql import DataFrame, SparkSession

from ridgeline.sources import geojson, tables

#: Bytes of a download that are held at once.
CHUNK = 1 << 20


def opened(url: str, form: dict[str, str] | None = None, attempts: int = 4, wait: float = 5.0, timeout: float = 180.0):
    """An open answer; a failure is tried again after a pause, the last one is
    raised.  ``form`` makes it a POST."""
    data = urllib.parse.urlencode(form).encode() if form else None
    for i in range(attempts):
        try:
            return urllib.request.urlopen(urllib.request.Request(url, data, {"User-Agent": "ridgeline"}), timeout=timeout)
        except OSError:
            if i + 1 == attempts:
                raise
            time.sleep(wait)
    raise ValueError("attempts must be positive")


def download(spark: SparkSession, url: str, path: str, attempts: int = 4, wait: float = 5.0, **how) -> str:
    """Copy ``url`` to the file ``path`` in pieces, unless it is there; it gets
    its name when it is complete, so that a broken download leaves none and is
    tried again from the beginning."""
    for i in range(attempts if not tables.exists(spark, path) else 0):
        try:
            with opened(url, attempts=1, **how) as answer, tables.replaced(spark, path) as out:
                whole, got = answer.headers.get("Content-Length"), 0
                while piece := answer.read(CHUNK):
                    out.write(piece)
                    got += len(piece)
                if whole and got != int(whole):
                    raise OSError(f"{got} of {whole} bytes of {url}")
            break
        except (OSError, http.client.HTTPException):
            if i + 1 == attempts:
                raise
            time.sleep(wait)
    return path


def fetch_relation(spark: SparkSession, url: str, relation: int, path: str, **how) -> DataFrame:
    """Ways of a relation from a map-feature service, asked by POST once; the
    answer is kept at ``path``.  An answer without a relation raises."""
    if not tables.exists(spark, path):
        with opened(url, {"data": f"[out:json][timeout:120];rel({relation});out geom;"}, **how) as answer:
            tables.publish(spark, json.dumps(json.load(answer)).encode(), path)
    return geojson.read_relation(spark, path)
