"""Live boards as a Python data source, fetched in the executors by a bounded number of input partitions, each of
which reads its boards one after another.

``spark.dataSource.register(BoardSource)``, then ``spark.read.format("boards").option("urls", json).load()``
gives (url, payload, error); a board that can't be read gives its error and no payload. Options: ``urls`` (a
JSON list), ``timeout`` in seconds (30), ``agent``, ``concurrency``: how many boards are read at once at most (8).
"""

from __future__ import annotations

import json
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from postmill.functions.plain import error_text


class BoardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "boards"

    def schema(self) -> str:
        return "url string, payload string, error string"

    def reader(self, schema) -> "BoardReader":
        return BoardReader(dict(self.options))


class BoardReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = json.loads(options.get("urls", "[]"))
        self.timeout = float(options.get("timeout", 30))
        self.agent = options.get("agent", "postmill")
        self.concurrency = int(options.get("concurrency", 8))

    def partitions(self):
        n = max(1, min(self.concurrency, len(self.urls)))
        return [InputPartition(self.urls[i::n]) for i in range(n)]

    def read(self, partition):
        for url in partition.value:
            try:
                request = urllib.request.Request(url, headers={"User-Agent": self.agent, "Accept": "application/json"})
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # follows redirects
                    row = url, answer.read().decode("utf-8"), None
            except Exception as e:
                row = url, None, error_text(str(e) or type(e).__name__)
            yield row


def poll(spark, companies, templates: dict[str, str], timeout: float = 30, concurrency: int = 8):
    """(company_id, source, payload, error) of the boards of enabled companies.

    templates: of each source the address with ``{token}`` in it. A company of a source without template has
    an error, as has a board that can't be read.
    """
    from urllib.parse import quote

    from pyspark.sql import functions as F

    spark.dataSource.register(BoardSource)
    # the list of boards is short configuration
    rows = companies.where("enabled").select("id", "source", "board_token").collect()
    asked = [(templates[r.source].format(token=quote(r.board_token, safe="")), r.id, r.source) for r in rows if r.source in templates]
    known = spark.createDataFrame(asked, "url string, company_id long, source string")
    # two companies of one address share what is read
    read = spark.read.format("boards").options(urls=json.dumps(sorted({a[0] for a in asked})), timeout=str(timeout), concurrency=str(concurrency)).load()
    lost = spark.createDataFrame([(r.id, r.source, None, f"no address for source {r.source}") for r in rows if r.source not in templates], "company_id long, source string, payload string, error string")
    return read.join(F.broadcast(known), "url").select("company_id", "source", "payload", "error").unionByName(lost)  # one row per board
