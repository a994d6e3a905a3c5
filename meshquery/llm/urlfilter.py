"""URL filters over a sorted digest array.

A rule (block or allow) names a host and a path prefix.  It fits its host and all subdomains, when the url's path
starts with the rule's.  The array holds the 64-bit xxhash keys of all rules' ``host + path``, sorted, beside the strings,
and the keys of the rules' hosts with the lengths of their paths.  Every host suffix of a batch's urls is searched at
once; only with hosts that have rules are path prefixes hashed, of the lengths that the host's rules have.  All these
keys are searched at once, and the strings found are compared in full, so two strings of one key do no harm.  Of the
rules that fit, the longest wins; of rules of one text the last given counts.

The array is one file image.  It goes to the executors as a broadcast when it is no larger than ``most_bytes``; each
worker puts it in an unlinked temporary file of its own and maps it, and reads from it only the strings that it finds.
A larger rule set is cut by host into images of that size which are applied one after another, the longest rule found so
far carried along.

Nulls: a null url has an empty host and path and fits no rule; a null id is carried along.  Urls of any length are read
whole.  Repeated rows are judged one by one.  Extra columns are ignored.  An empty table gives an empty result, an empty
rule set allows everything.
"""

from __future__ import annotations

import re
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 64 << 20
_maps: dict[int, DigestArray] = {}  # by the image's digest


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), path


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode())


def image(rules: list[tuple[str, bool]]) -> bytes:
    """The file image: numbers of rules, hosts and lengths; rules' keys, string ends, verdicts; hosts' keys, ends of their lengths; lengths; strings."""
    rows = sorted((_key(r), r.encode(), allow) for r, allow in dict(rules).items())
    hosts: dict[int, set[int]] = {}
    for rule in dict(rules):
        at = rule.index("/")
        hosts.setdefault(_key(rule[:at]), set()).add(len(rule) - at)
    lengths = [sorted(hosts[h], reverse=True) for h in sorted(hosts)]
    parts = [
        np.array([len(rows), len(hosts), sum(map(len, lengths))], "<i8"), np.array([k for k, _, _ in rows], "<u8"), np.cumsum([len(s) for _, s, _ in rows], dtype="<i8"),
        np.array(sorted(hosts), "<u8"), np.cumsum([len(x) for x in lengths], dtype="<i8"), np.array([n for x in lengths for n in x], "<i8"), np.array([a for _, _, a in rows], "u1"),
    ]
    return b"".join(p.tobytes() for p in parts) + b"".join(s for _, s, _ in rows)


class DigestArray:
    """A mapped image."""

    def __init__(self, data: bytes):
        self.file = tempfile.TemporaryFile()
        self.file.write(data)
        self.file.flush()
        whole = np.memmap(self.file, np.uint8, "r")
        n, hosts, lengths = whole[:24].view("<i8").tolist()
        at = 24

        def part(count: int, kind: str) -> np.ndarray:
            nonlocal at
            at += count * np.dtype(kind).itemsize
            return whole[at - count * np.dtype(kind).itemsize : at].view(kind)

        self.keys, self.ends = part(n, "<u8"), part(n, "<i8")
        self.hosts, self.host_ends, self.lengths = part(hosts, "<u8"), part(hosts, "<i8"), part(lengths, "<i8")
        self.allow, self.strings = part(n, "u1"), whole[at:]

    def string(self, i: int) -> str:
        return bytes(self.strings[self.ends[i - 1] if i else 0 : self.ends[i]]).decode()

    @staticmethod
    def _search(array: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys of the texts, first place that isn't less, which texts are there)."""
        keys = np.fromiter(map(_key, texts), np.uint64, len(texts))
        at = np.searchsorted(array, keys)
        live = np.flatnonzero(at < len(array))
        return keys, at, live[array[at[live]] == keys[live]]

    def find(self, probes: list[str]) -> np.ndarray:
        """For each probe the rule's place or -1."""
        keys, at, live = self._search(self.keys, probes)
        out = np.full(len(probes), -1)
        for i in live:
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == keys[i]:
                if self.string(k) == probes[i]:
                    out[i] = k
                    break
                k += 1
        return out

    def judge(self, urls: list[tuple[str, str]]) -> list[tuple[str | None, bool | None]]:
        """The longest rule that fits each (host, path), and whether it allows."""
        suffixes, of = [], []
        for i, (host, _) in enumerate(urls):
            at = 0
            while host and at >= 0:
                suffixes.append(host[at:])
                of.append(i)
                dot = host.find(".", at)
                at = dot + 1 if dot >= 0 else -1
        _, place, live = self._search(self.hosts, suffixes)
        probes, owner = [], []
        for j in live:
            k, path = int(place[j]), urls[of[j]][1]
            for n in self.lengths[self.host_ends[k - 1] if k else 0 : self.host_ends[k]].tolist():
                if n <= len(path):
                    probes.append(suffixes[j] + path[:n])
                    owner.append(of[j])
        out: list[tuple[str | None, bool | None]] = [(None, None)] * len(urls)
        for i, k in zip(owner, self.find(probes)):
            if k >= 0 and len(rule := self.string(k)) > len(out[i][0] or ""):
                out[i] = (rule, bool(self.allow[k]))
        return out


def _judge(shared, name: int, default: str, id_col: str):
    def run(batches):
        if name not in _maps:
            _maps.clear()
            _maps[name] = DigestArray(shared.value)
        rules = _maps[name]
        for batch in batches:
            urls = [split_url(u) for u in batch.column("url").to_pylist()]
            was = zip(batch.column("rule").to_pylist(), batch.column("verdict").to_pylist())
            found = [(r, v) if r and len(r) >= len(rule or "") else (rule, "allow" if ok else "block") if rule else (None, default) for (r, v), (rule, ok) in zip(was, rules.judge(urls))]
            cols = [pa.array(x, pa.string()) for x in ([h for h, _ in urls], [p for _, p in urls], [r for r, _ in found], [v for _, v in found])]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("url"), *cols], [id_col, "url", "host", "path", "rule", "verdict"])

    return run


def images(rules: list[tuple[str, bool]], most_bytes: int) -> list[bytes]:
    """One image, or several of at most ``most_bytes``."""
    data = image(rules)
    if len(data) <= most_bytes or len(rules) < 2:
        return [data]
    rules, half = sorted(rules), len(rules) // 2
    return images(rules[:half], most_bytes) + images(rules[half:], most_bytes)


def judge_urls(pages: DataFrame, rules: list[tuple[str, bool]], default: str = "allow", id_col: str = "page_id", most_bytes: int = MOST_BYTES) -> DataFrame:
    """id, url, host, path, rule (host and path of the longest that fits, else null), verdict.

    ``rules``: (host + path, True to allow); the path begins with ``/``.
    """
    kind = dict(pages.dtypes)[id_col]
    out = pages.select(id_col, F.col("url").cast("string").alias("url"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for data in images(rules, most_bytes):
        shared = pages.sparkSession.sparkContext.broadcast(data)
        out = out.select(id_col, "url", "rule", "verdict").mapInArrow(_judge(shared, xxhash.xxh64_intdigest(data), default, id_col), f"{id_col} {kind}, url string, host string, path string, rule string, verdict string")
    return out
