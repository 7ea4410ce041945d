"""A Python data source for a paginated REST API: `spark.read.format("caserest").option("url", ...)`.

Pages link to the next one, so a root listing is one partition; children of cases are dealt over `lanes` partitions (1 unless
given). Requests keep a least distance in time, which is `lanes` times as long in each, so that all together keep `gap` whatever
their number; they are tried again after transport errors and the statuses of RETRY.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from email.utils import parsedate_to_datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRY = (408, 429, 500, 502, 503, 504)


class CasePartition(InputPartition):
    """Some cases whose children are read one after another; None is the root listing."""

    def __init__(self, cases: tuple[str | None, ...]):
        super().__init__(cases)
        self.cases = cases


class RestReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url = options["url"]
        self.cases = [c for c in options.get("cases", "").split(",") if c]
        self.since, self.token = options.get("since"), options.get("token")
        self.gap, self.tries = float(options.get("gap", 1.5)), int(options.get("tries", 5))
        self.base, self.most = float(options.get("backoff", 1.0)), float(options.get("max_backoff", 60.0))
        self.limit = int(options.get("limit", 0))
        self.lanes = max(1, min(int(options.get("lanes", 1)), len(self.cases) or 1))
        self.gap *= self.lanes
        self._last = 0.0

    def partitions(self) -> list[InputPartition]:
        return [CasePartition(tuple(self.cases[i :: self.lanes])) for i in range(self.lanes)] if self.cases else [CasePartition((None,))]

    def wait(self, attempt: int, retry_after: str | None) -> float:
        """Seconds before another try: what the server asks for (a number, or a date), else doubled each time with some chance, up
        to a most."""
        if retry_after and retry_after.strip().replace(".", "", 1).isdigit():
            return float(retry_after)
        if retry_after:
            try:
                return max(0.0, parsedate_to_datetime(retry_after).timestamp() - time.time())
            except ValueError:
                pass
        return max(0.0, min(self.base * 2**attempt + random.uniform(0, self.base), self.most))

    def fetch(self, url: str) -> dict:
        for attempt in range(self.tries + 1):
            time.sleep(max(0.0, self._last + self.gap - time.monotonic()))
            self._last = time.monotonic()
            request = urllib.request.Request(url, headers={"Authorization": f"Token {self.token}"} if self.token else {})
            try:
                with urllib.request.urlopen(request, timeout=60) as reply:
                    return json.load(reply)
            except urllib.error.HTTPError as e:
                if e.code not in RETRY or attempt == self.tries:
                    raise
                pause = self.wait(attempt, e.headers.get("Retry-After"))
            except (urllib.error.URLError, TimeoutError):
                if attempt == self.tries:
                    raise
                pause = self.wait(attempt, None)
            time.sleep(pause)
        raise AssertionError

    def read(self, partition: CasePartition) -> Iterator[tuple]:
        for case in partition.cases:
            yield from self.pages(case)

    def pages(self, case: str | None) -> Iterator[tuple]:
        params = {"last_checked_date__gte": self.since} if self.since and case is None else {}
        if case is not None:
            params["case"] = case
        url: str | None = self.url + (f"?{urllib.parse.urlencode(params)}" if params else "")
        n = 0
        while url:
            page = self.fetch(url)
            for row in page["results"] if isinstance(page, dict) else page:
                yield (case, json.dumps(row))
                n += 1
                if self.limit and n >= self.limit:
                    return
            url = page.get("next") if isinstance(page, dict) else None


class RestSource(DataSource):
    """Rows (case_id, raw): raw is the object's JSON, for operators.ingest.from_api."""

    @classmethod
    def name(cls) -> str:
        return "caserest"

    def schema(self) -> str:
        return "case_id string, raw string"

    def reader(self, schema) -> DataSourceReader:
        return RestReader(self.options)
