"""Sources and sinks over HTTP.

Requests go out from tasks, a partition for each page or block of keys, with a bounded pool, time
limits and waits after status 429.  Anything that is sent is passed in: addresses, keys, and for
tests the fetch function.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.cluster import checkpointed

Fetch = Callable[[str], str]


@dataclass(frozen=True)
class Policy:
    """Seconds before a request is given up, seconds to wait after status 429, and how often to try."""

    timeout: float = 60
    wait: float = 3
    tries: int = 5


def fetch(url: str, policy: Policy = Policy(), data: bytes | None = None, headers: Mapping[str, str] | None = None) -> str:
    for left in range(policy.tries - 1, -1, -1):
        try:
            request = urllib.request.Request(url, data=data, headers=dict(headers or {}))
            with urllib.request.urlopen(request, timeout=policy.timeout) as answer:
                return answer.read().decode()
        except urllib.error.HTTPError as error:
            if error.code != 429 or not left:
                raise
        except (urllib.error.URLError, TimeoutError):
            if not left:
                raise
        time.sleep(policy.wait)
    raise RuntimeError("unreachable")


def with_query(base: str, parameters: Mapping[str, object]) -> str:
    some = {k: v for k, v in parameters.items() if v is not None}
    return f"{base}?{urllib.parse.urlencode(some)}" if some else base


@dataclass(frozen=True)
class _PagePartition(InputPartition):
    page: int


class _PortalReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str], get: Fetch):
        self.options, self.get = options, get
        self.search = json.loads(options.get("search", "{}"))
        self.per_page = int(options.get("page_size", 30))

    def _page(self, number: int) -> dict:
        return json.loads(self.get(with_query(self.options["list_url"], self.search | {"page": number, "pageSize": self.per_page})))

    def partitions(self) -> Sequence[InputPartition]:
        total = int(self._page(1)["total"])
        if not total:
            raise ValueError("the search has no hits")
        return [_PagePartition(k + 1) for k in range(-(-total // self.per_page))]

    def read(self, partition: _PagePartition) -> Iterator[tuple]:
        keywords = "，".join(str(v) for v in self.search.values() if v is not None)
        records = self._page(partition.page)["rows"]
        details = self.options.get("detail_url")
        if details:
            with ThreadPoolExecutor(int(self.options.get("pool", 8))) as pool:
                records = list(pool.map(lambda r: json.loads(self.get(with_query(details, {"id": r["collectionID"]}))), records))
        for r in records:
            key = r.get("collectionID", r.get("uuid"))
            yield str(key), json.dumps(r, ensure_ascii=False), f"{details or self.options['list_url']}?id={key}", keywords


#: Fixed value: seconds that the portal wants to be left alone after status 429.
PORTAL = Policy(wait=10)


def portal_fetch(url: str) -> str:
    return fetch(url, PORTAL)


class PortalSource(DataSource):
    """A specimen portal: options list_url, search (JSON), page_size, and detail_url for whole records.

    A partition for each page; columns collectionID, record (JSON), references and queryKeywords.
    """

    get: Fetch = staticmethod(portal_fetch)

    @classmethod
    def name(cls) -> str:
        return "portal"

    def schema(self) -> str:
        return "collectionID string, record string, references string, queryKeywords string"

    def reader(self, schema) -> DataSourceReader:
        return _PortalReader(self.options, type(self).get)


def search_portal(spark: SparkSession, list_url: str, search: Mapping[str, object], detail_url: str | None = None, source: type[PortalSource] = PortalSource) -> DataFrame:
    """Records of a search, each id once."""
    spark.dataSource.register(source)
    options = {"list_url": list_url, "search": json.dumps({k: (str(v).lower() if isinstance(v, bool) else v) for k, v in search.items()})}
    found = spark.read.format(source.name()).options(**options, **({"detail_url": detail_url} if detail_url else {})).load()
    return found.dropDuplicates(["collectionID"])


def ask(queries: DataFrame, url_of: Callable[[Row], str | None], get: Fetch = fetch, pool: int = 8) -> DataFrame:
    """queries (raw, simple_name, authors, platform_rank) with answer, the body of each request; failures, and what a service is not asked, are null.

    The answers are checkpointed, so that later actions do not ask again.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(row) -> str | None:
            try:
                url = url_of(row)
                return get(url) if url else None
            except (OSError, ValueError):
                return None

        with ThreadPoolExecutor(pool) as workers:
            for frame in frames:
                yield frame.assign(answer=list(workers.map(one, frame.itertuples(index=False))))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema.fields)
    return checkpointed(queries.mapInPandas(run, f"{fields}, answer string"))


#: What services call the ranks and kinds of a search; a service that a kind lacks is not asked for it.
SEARCHES = {
    "familial": {"kew": "f_familial", "col": "getFamiliesByFamilyName", "tropicos": "Search"},
    "infrafamilial": {"kew": "f_infrafamilial", "tropicos": "Search"},
    "generic": {"kew": "f_generic", "col": "getSpeciesByScientificName", "tropicos": "Search"},
    "infrageneric": {"kew": "f_infrageneric", "tropicos": "Search"},
    "specific": {"kew": "f_specific", "col": "getSpeciesByScientificName", "tropicos": "Search"},
    "infraspecific": {"kew": "f_infraspecific", "col": "getSpeciesByScientificName", "tropicos": "Search"},
    "commonname": {"col": "getSpeciesByCommonName", "tropicos": "Search"},
    "acceptedname": {"tropicos": "AcceptedNames"},
    "synonyms": {"tropicos": "Synonyms"},
    "distributions": {"tropicos": "Distributions"},
    "references": {"tropicos": "References"},
    "images": {"tropicos": "Images"},
    "highertaxa": {"tropicos": "HigherTaxa"},
    "specimens": {"tropicos": "Specimens"},
    "chromosome": {"tropicos": "ChromosomeCounts"},
}
#: Fixed value: members of a request by service and kind.
_COL_KEYS = {"familial": "familyName", "commonname": "commonName"}


def name_request(service: str, base: str, name: str, kind: str = "specific", key: str | None = None, per_page: int = 500) -> str | None:
    """The address of a search for a name in a service (ipni, powo, tropicos, col); None if the service has no such search.

    For kinds that tell more of a known name, the name is its id.
    """
    family = "kew" if service in ("ipni", "powo") else service
    if family not in ("kew", "tropicos", "col"):
        raise ValueError(f"unknown service {service}")
    method = SEARCHES[kind].get(family)
    if method is None:
        return None
    if family == "kew":
        return with_query(f"{base}/search", {"q": name, "f": method, "perPage": per_page})
    if family == "col":
        return with_query(f"{base}/{method}", {"apiKey": key, _COL_KEYS.get(kind, "scientificName"): name, "page": 1})
    if method == "Search":
        return with_query(f"{base}/{method}", {"name": name.replace(".", "%2e"), "type": "exact", "apikey": key, "format": "json"})
    return with_query(f"{base}/{name}/{method}", {"apikey": key, "format": "json"})


@dataclass
class Registry:
    """A registry that takes records: its address, an access key and a secret, from the caller's configuration."""

    url: str
    access_key: str
    secret: str = field(repr=False)
    lifetime: int = 3600

    def token(self, now: float | None = None) -> str:
        """key:signature:policy; the policy is base64 JSON with a deadline, signed by HMAC-SHA1."""
        deadline = int(time.time() if now is None else now) + self.lifetime
        policy = base64.urlsafe_b64encode(json.dumps({"deadline": deadline}).encode())
        signature = base64.urlsafe_b64encode(hmac.new(self.secret.encode(), policy, hashlib.sha1).digest())
        return f"{self.access_key}:{signature.decode()}:{policy.decode()}"


def register(records: DataFrame, registry: Registry, key: str, mode: str = "create", send: Callable[..., str] = fetch, pool: int = 8) -> DataFrame:
    """Send each row as JSON; key, ok and message of each.

    Every request carries a key made from the row's own, so that a task that runs again registers
    nothing twice.  The rows are sent when this is called, and the result is checkpointed, so that
    later actions send nothing.  mode "update" changes the ids of records already there.
    """
    if mode not in ("create", "update"):
        raise ValueError(f"mode is create or update, not {mode}")
    rows = records.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("body"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(row) -> tuple[bool, str]:
            headers = {"Authorization": registry.token(), "Idempotency-Key": hashlib.sha256(f"{mode}:{row.key}".encode()).hexdigest(), "Content-Type": "application/json"}
            try:
                return True, send(f"{registry.url}/{mode}", data=row.body.encode(), headers=headers)
            except (OSError, ValueError) as error:
                return False, str(error)

        with ThreadPoolExecutor(pool) as workers:
            for frame in frames:
                done = list(workers.map(one, frame.itertuples(index=False)))
                yield pd.DataFrame({"key": frame["key"], "ok": [d[0] for d in done], "message": [d[1] for d in done]})

    return checkpointed(rows.mapInPandas(run, "key string, ok boolean, message string"))


def write_outcomes(records: DataFrame, outcomes: DataFrame, key: str, path: str) -> None:
    """The records that were and were not registered, as JSON lines in path/success and path/failed, failures with their message."""
    told = records.join(outcomes.withColumnRenamed("key", "__key"), F.col(key).cast("string") == F.col("__key"))
    told.where("ok").drop("__key", "ok", "message").write.mode("overwrite").json(f"{path}/success")
    told.where("not ok").drop("__key", "ok").write.mode("overwrite").json(f"{path}/failed")
