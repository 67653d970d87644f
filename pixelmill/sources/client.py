"""A client of scene catalogues: paged search with retries, returned as a DataFrame."""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from pixelmill.sources.config import Stac
from pixelmill.sources.scenes import ITEM


class StacClient:
    """Runs on the driver: a search gives a few thousand items at most, all pages of them."""

    def __init__(self, config: Stac, sleep=time.sleep):
        self.config, self.sleep = config, sleep

    def _ask(self, url: str, body: dict | None) -> dict:
        """One request; statuses of the configuration and lost connections are retried, later and later, with jitter."""
        request = urllib.request.Request(url, None if body is None else json.dumps(body).encode(), {"Content-Type": "application/json"})
        for attempt in range(self.config.retries + 1):
            try:
                with urllib.request.urlopen(request, timeout=60) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                if e.code not in self.config.statuses or attempt == self.config.retries:
                    raise
                wait = e.headers.get("Retry-After", "")
                pause = float(wait) if wait.isdigit() else self.config.backoff * 2**attempt
            except urllib.error.URLError:
                if attempt == self.config.retries:
                    raise
                pause = self.config.backoff * 2**attempt
            self.sleep(pause + random.uniform(0, 1))
        raise AssertionError("unreachable")

    def items(self, bbox: tuple[float, float, float, float], start: str, end: str, max_cloud: float, grid_code: str | None = None) -> Iterator[dict]:
        """Items that intersect the box, from the first to the last day, less cloudy than the limit."""
        query = {"eo:cloud_cover": {"lt": max_cloud}} | ({"grid:code": {"eq": grid_code}} if grid_code else {})
        url, body = f"{self.config.url.rstrip('/')}/search", {"collections": [self.config.collection], "bbox": list(bbox), "datetime": f"{start}/{end}", "query": query, "limit": 100}
        while url:
            page = self._ask(url, body)
            yield from page.get("features", [])
            after = next((x for x in page.get("links", []) if x.get("rel") == "next"), None)
            url = after["href"] if after else None
            body = (after.get("body") or body) if after and after.get("method", "GET").upper() == "POST" else None

    def search(self, spark: SparkSession, *args, **kwargs) -> DataFrame:
        """The items as rows of scenes.ITEM."""
        def row(i: dict) -> tuple:
            p = i["properties"]
            cloud, box = p.get("eo:cloud_cover"), i.get("bbox")
            return i["id"], (i.get("datetime") or p.get("datetime") or "").rstrip("Z") or None, box and [float(x) for x in box], (None if cloud is None else float(cloud), p.get("grid:code")), {k: (v.get("href"),) for k, v in i.get("assets", {}).items()}

        schema = ITEM.replace("timestamp_ntz", "string", 1)
        df = spark.createDataFrame([row(i) for i in self.items(*args, **kwargs)], schema)
        return df.withColumn("datetime", df["datetime"].cast("timestamp_ntz"))
