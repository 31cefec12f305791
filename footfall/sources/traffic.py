"""Made-up traffic as a Python data source, for trying a site out: posts of known tokens, in batches or as a stream.

``spark.dataSource.register(TrafficSource)``, then ``spark.read.format("traffic").option("tokens", '["..."]').load()`` or the same with
``readStream``. A session is a page view, a click and a signup of one token, a second apart. What a session holds follows from its number, so a
micro-batch that runs again makes the same posts. The columns are those of ``schemas.RAW``.

Options: ``tokens``, a JSON list; ``sessions`` per token (1) for a batch; ``per_batch`` sessions per micro-batch (10), ``most`` sessions in
all for a stream (no end); ``start``, an ISO time of the first session (2024-01-01T00:00:00); ``url`` and ``referrer``. For the tokens
of a table that does not fit a list, use ``raw.synthetic_traffic``.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Tokens or sessions that one task makes.
CHUNK = 1000


class Sessions(InputPartition):
    """Sessions ``first`` to ``last`` (not included) of all, dealt to the tokens in turn."""

    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def _chunks(first: int, last: int) -> list[Sessions]:
    return [Sessions(at, min(last, at + CHUNK)) for at in range(first, last, CHUNK)]


class _Maker:
    def __init__(self, options: dict[str, str]):
        self.tokens = json.loads(options.get("tokens", "[]"))
        if not self.tokens:
            raise ValueError("traffic needs a list of tokens")
        self.start = datetime.fromisoformat(options.get("start", "2024-01-01T00:00:00"))
        self.url = options.get("url", "http://localhost/try")
        self.referrer = options.get("referrer", "http://localhost/")

    def read(self, partition: Sessions) -> Iterator[tuple]:
        # Workers have the package by then.
        from footfall.sources.raw import TRAFFIC

        for number in range(partition.first, partition.last):
            token = self.tokens[number % len(self.tokens)]
            digest = hashlib.md5(f"{token}/{number}".encode()).hexdigest()
            session = "-".join((digest[:8], digest[8:12], digest[12:16], digest[16:20], digest[20:]))
            for place, (name, properties) in enumerate(TRAFFIC):
                at = self.start + timedelta(seconds=number + place)
                body = {
                    "token": token, "eventName": name, "properties": properties, "sessionId": session, "url": self.url,
                    "referrer": self.referrer, "occurredAt": f"{at.isoformat(timespec='milliseconds')}Z",
                }
                yield number * len(TRAFFIC) + place, at, json.dumps(body, separators=(",", ":")), None, None, None


class BatchReader(_Maker, DataSourceReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.total = int(options.get("sessions", "1")) * len(self.tokens)

    def partitions(self) -> list[Sessions]:
        return _chunks(0, self.total) or [Sessions(0, 0)]


class StreamReader(_Maker, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.per_batch, self.most = int(options.get("per_batch", "10")), int(options.get("most", str(2**62)))
        self.last = 0

    def initialOffset(self) -> dict:
        return {"session": 0}

    def latestOffset(self) -> dict:
        self.last = min(self.most, self.last + self.per_batch)
        return {"session": self.last}

    def partitions(self, start: dict, end: dict) -> list[Sessions]:
        self.last = max(self.last, end["session"])
        return _chunks(start["session"], end["session"]) or [Sessions(0, 0)]

    def commit(self, end: dict) -> None:
        pass


class TrafficSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "traffic"

    def schema(self) -> str:
        return (
            "event_id long, arrived_at timestamp_ntz, body string, header_user_agent string, forwarded_for string, remote_ip string"
        )

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)
