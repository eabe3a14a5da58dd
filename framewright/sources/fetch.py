"""Remote files: retries, back-off and a cache that is verified by hash.

Requests run on the driver, one after the other, as the remote side limits its clients; how a request is made, and how
time passes, is injected. Listings and hashes of many files are DataFrames (see ``verified``).
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import EXTENSIONS

#: Status codes that ask to come back later. Fixed values.
LATER = (429, 503)


class HttpStatus(Exception):
    """A response without success; after: seconds that the server asks to wait, if it does."""

    def __init__(self, code: int, after: float | None = None) -> None:
        super().__init__(f"HTTP status {code}")
        self.code, self.after = code, after


@dataclass
class Policy:
    """Attempts, and seconds between requests; waits after a refusal start at ``base`` and double up to ``most``."""

    attempts: int = 5
    pause: float = 1.0
    base: float = 5.0
    most: float = float("inf")
    streak: int = 0  # refusals in a row that add ``cooldown``; 0: none do
    cooldown: float = 0.0
    sleep: Callable[[float], None] = time.sleep


#: Policies of listings and of downloads. Fixed values.
LISTING = Policy()
DOWNLOADS = Policy(pause=60.0, base=30.0, most=600.0, streak=3, cooldown=300.0)


class Client:
    """Requests under a policy; refusals in a row are counted over all of its requests."""

    def __init__(self, policy: Policy) -> None:
        self.policy, self.refused = policy, 0

    def _wait(self, attempt: int, status: HttpStatus) -> float:
        p = self.policy
        if not p.streak:  # the server's word alone, if it gives one
            return status.after if status.after is not None else p.base * 2.0**attempt
        self.refused += 1
        extra = 0.0
        if self.refused >= p.streak:
            self.refused, extra = 0, p.cooldown
        return min(max(status.after or 0.0, p.base * 2.0**attempt), p.most) + extra

    def run(self, request: Callable[[], object], busy: Callable[[object], str | None] = lambda _: None, done: Callable[[object], None] = lambda _: None):
        """The first answer. busy(answer): why it has to be asked again, "" if it failed for good with no reason to retry."""
        p = self.policy
        for attempt in range(p.attempts):
            last = attempt == p.attempts - 1
            try:
                answer = request()
            except HttpStatus as e:
                if e.code not in LATER or last:
                    raise RuntimeError(f"request failed: {e}") from e
                p.sleep(self._wait(attempt, e))
                continue
            except (OSError, TimeoutError) as e:
                if last:
                    raise RuntimeError(f"request failed: {e}") from e
                p.sleep(2.0**attempt)
                continue
            why = busy(answer)
            if why is not None:
                if why != "maxlag" or last:
                    raise RuntimeError(f"request failed: {why}")
                p.sleep(2.0**attempt)
                continue
            done(answer)
            self.refused = 0
            p.sleep(p.pause)
            return answer
        raise AssertionError("no attempts")


def json_fetcher(get: Callable[[dict], str], policy: Policy | None = None) -> Callable[[dict], str]:
    """fetch(params) for ``media.collect_pages``: the API's JSON text, asked again while the API lags behind or refuses."""
    client = Client(policy or LISTING)

    def busy(text: object) -> str | None:
        error = json.loads(str(text)).get("error")
        return None if error is None else "maxlag" if error.get("code") == "maxlag" else str(error.get("info", error))

    return lambda params: client.run(lambda: get({**params, "format": "json", "maxlag": "5"}), busy)


def _digest(path: Path, kind: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, kind).hexdigest()


def download(entry: dict, cache: Path, get: Callable[[str], bytes], client: Client) -> Path:
    """The file of a sources entry in the cache: there already with the right hash, else fetched, checked and moved into place whole."""
    place = Path(cache) / f"{entry['name']}.{EXTENSIONS[entry['mime']]}"
    if place.exists() and (not entry["sha1"] or _digest(place, "sha1") == entry["sha1"]):
        return place

    def keep(data: object) -> None:
        if entry["sha1"] and hashlib.sha1(data).hexdigest() != entry["sha1"]:
            raise RuntimeError(f"{entry['name']}: sha1 mismatch for {entry['url']}")
        place.parent.mkdir(parents=True, exist_ok=True)
        part = place.with_name(place.name + ".part")
        part.write_bytes(data)
        os.replace(part, place)

    try:
        client.run(lambda: get(entry["url"]), done=keep)
    except RuntimeError as e:
        raise RuntimeError(str(e) if str(e).startswith(entry["name"]) else f"{entry['name']}: {e}") from e
    return place


def download_all(entries: Iterable[dict], cache: Path, get: Callable[[str], bytes], policy: Policy | None = None) -> list[Path]:
    """All entries' files by name. Every entry is tried; what failed is raised together at the end."""
    client, found, failed = Client(policy or DOWNLOADS), [], []
    for e in entries:
        try:
            found.append(download(e, cache, get, client))
        except RuntimeError as why:
            failed.append(str(why))
    if failed:
        raise RuntimeError("downloads failed:\n  " + "\n  ".join(failed))
    return sorted(found, key=lambda p: p.name)


def verified(spark: SparkSession, folder: str, entries: DataFrame) -> DataFrame:
    """entries with ``state``: 'cached' (hash right, or none given), 'mismatch' or 'missing'. Files are hashed on the executors."""
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), F.sha1("content").alias("__sha1"))
    kinds = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    named = entries.withColumn("file", F.concat_ws(".", "name", F.try_element_at(kinds, F.col("mime"))))
    state = F.when(F.col("__sha1").isNull(), "missing").when((F.col("sha1") == "") | F.col("sha1").isNull() | (F.col("sha1") == F.col("__sha1")), "cached").otherwise("mismatch")
    return named.join(files, "file", "left").withColumn("state", state).drop("__sha1")
