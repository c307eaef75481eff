"""URL rules in a sorted digest array.

Each rule's string (host + path) has a 64-bit xxhash; the sorted hashes, and the strings in the same
order, are one file that Spark ships to every machine, where workers memory-map it. A URL probes the
hash of every suffix of its host joined with every prefix of its path that is as long as some rule's
path, all of a batch in one vectorised binary search; a hit counts only if the stored string is the
same, so collisions of digests do no harm. The rule with the longest string wins.

Defined results: a null URL, or one without ``://``, has an empty host and path and fits no rule; a
URL that fits none gets the default verdict, allow; repeated rows are judged each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

#: Most bytes of a rule file: it is copied to each machine, so its size is checked.
MOST_BYTES, DEFAULT = 2 << 30, "allow"
#: (host, path, verdict), as the contract has them.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
PARTS = re.compile(r"([^/?#]*)([^?#]*)", re.S)
LOWER = {i: i + 32 for i in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    host, path = PARTS.match(url, at + 3).groups()
    return host.translate(LOWER), path


class Digests:
    """The sorted array. File: a line of JSON (counts, path lengths), hashes, string ends, verdicts, strings."""

    @staticmethod
    def build(rules: list[tuple[str, str, str]]) -> bytes:
        if len({(h, p) for h, p, _ in rules}) < len(rules) or any(v not in ("allow", "block") or "/" in h or p[:1] not in ("", "/") for h, p, v in rules):
            raise ValueError("rules must be distinct, with a verdict of allow or block, and a path that is empty or starts with /")
        keyed = sorted((xxhash.xxh64_intdigest((h + p).encode()), (h + p).encode(), v) for h, p, v in rules)
        head = json.dumps({"n": len(keyed), "paths": sorted({len(p) for _, p, _ in rules})}).encode()
        head += b" " * (-(len(head) + 1) % 8) + b"\n"
        parts = [head, np.array([k for k, _, _ in keyed], np.uint64).tobytes(), np.cumsum([len(s) for _, s, _ in keyed], dtype=np.int64).tobytes(), bytes(v == "block" for _, _, v in keyed), b"".join(s for _, s, _ in keyed)]
        if sum(map(len, parts)) > MOST_BYTES:
            raise ValueError(f"a rule file has at most {MOST_BYTES} bytes")
        return b"".join(parts)

    def __init__(self, path: str):
        held = np.memmap(path, np.uint8, "r")
        head = bytes(held[: 1 << 16]).split(b"\n", 1)[0]
        n, at = json.loads(head)["n"], len(head) + 1
        self.paths = json.loads(head)["paths"]
        self.keys = held[at : at + 8 * n].view(np.uint64)
        self.ends = held[at + 8 * n : at + 16 * n].view(np.int64)
        self.blocks = held[at + 16 * n : at + 17 * n]
        self.strings = held[at + 17 * n :]

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The position of each key, or -1."""
        digests = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        low, high = np.searchsorted(self.keys, digests, "left"), np.searchsorted(self.keys, digests, "right")
        out = np.full(len(keys), -1)
        for i in np.flatnonzero(high > low):
            for k in range(low[i], high[i]):  # more than one only where digests collide
                if bytes(self.strings[self.ends[k - 1] if k else 0 : self.ends[k]]) == keys[i]:
                    out[i] = k
        return out

    def judge(self, urls: list[str | None]) -> list[tuple]:
        """(host, path, rule, verdict) of each."""
        split, keys, of = [split_url(u) for u in urls], [], []
        for i, (host, path) in enumerate(split):
            at = 0 if host else -1
            while at >= 0:
                for n in self.paths:
                    if n <= len(path):
                        keys.append((host[at:] + path[:n]).encode("utf-8", "surrogatepass"))
                        of.append(i)
                at = host.find(".", at) + 1 or -1
        best: dict[int, tuple] = {}
        found = self.find(keys)
        for j in np.flatnonzero(found >= 0).tolist():
            own = (len(keys[j].decode()), len(keys[j].decode().split("/")[0]), keys[j].decode(), bool(self.blocks[found[j]]))
            best[of[j]] = max(best.get(of[j], own), own)
        return [(h, p, *((best[i][2], "block" if best[i][3] else "allow") if i in best else (None, DEFAULT))) for i, (h, p) in enumerate(split)]


def shipped(spark: SparkSession, content: bytes) -> str:
    """The name under which SparkFiles has content on every machine."""
    name = f"rules-{hashlib.sha256(content).hexdigest()[:24]}.bin"
    path = os.path.join(tempfile.gettempdir(), name)
    if not os.path.exists(path):
        with open(f"{path}.{os.getpid()}", "wb") as f:
            f.write(content)
        os.replace(f"{path}.{os.getpid()}", path)
    spark.sparkContext.addFile(path)  # the driver serves it; executors keep their copy for mapping
    return name


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row."""
    name = shipped(pages.sparkSession, Digests.build(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = Digests(SparkFiles.get(name))
        for batch in batches:
            made = digests.judge(batch.column("url").to_pylist())
            columns = zip(*made, strict=True) if made else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(c, pa.string()) for c in columns)], ["page_id", "host", "path", "rule", "verdict"])

    return pages.selectExpr("cast(page_id as long) page_id", "url").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(rhost, rpath, rverdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), best AS (
  SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(rverdict, length(rhost || rpath)) AS verdict
  FROM split JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN best USING (page_id)
"""
