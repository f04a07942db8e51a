"""Verdicts on URLs by rules (host, path), found in sorted arrays of digests.

The keys of all rules are kept in files of the shared folder, each one Arrow batch: 64-bit xxhash digests in ascending order, and
beside them the full keys and what belongs to them. A task maps the files and looks up all digests of a batch of URLs at once by
binary search; the key stored at a hit is then compared, so equal digests of different keys do no harm.
"""

from __future__ import annotations

import posixpath
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import col, open_file
from skyloom.plans.tables import new_path

SHARD_KEYS = 1 << 20
SLICE = 4096
SEED = 42  # of Spark's xxhash64

_SHARDS = "path string, low long, high long, n long, longest long"


def digests(keys: list[str]) -> np.ndarray:
    """The same as Spark's xxhash64."""
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(k.encode("utf-8", "surrogatepass"), SEED) for k in keys), np.uint64, len(keys)).view(np.int64)


class Shards:
    """Sorted digest arrays of all shards, mapped one by one when first needed."""

    def __init__(self, manifest: list[tuple]):
        self.manifest, self.mapped = manifest, {}

    def _batch(self, shard: tuple) -> pa.RecordBatch:
        if shard[0] not in self.mapped:
            self.mapped[shard[0]] = pa.ipc.open_file(open_file(shard[0])).get_batch(0)
        return self.mapped[shard[0]]

    def find(self, keys: list[str]) -> dict[str, tuple]:
        """{key: (verdict, path lengths)} of those keys that are there."""
        found, wanted = {}, digests(keys)
        for shard in self.manifest:
            inside = np.flatnonzero((wanted >= shard[1]) & (wanted <= shard[2]))
            if not len(inside):
                continue
            batch = self._batch(shard)
            sorted_digests = batch.column("digest").to_numpy()
            left, right = (np.searchsorted(sorted_digests, wanted[inside], side) for side in ("left", "right"))
            for i in np.flatnonzero(right > left).tolist():
                key = keys[inside[i]]
                for at in range(left[i], right[i]):  # several only where digests collide
                    if batch.column("key")[at].as_py() == key:
                        found[key] = (batch.column("verdict")[at].as_py(), batch.column("lengths")[at].as_py())
        return found


def _write(folder: str):
    def shards(batches):
        whole = [b for b in batches if b.num_rows]
        if not whole:
            return
        batch = pa.Table.from_batches(whole).combine_chunks().to_batches()[0]
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        name = f"digests-{uuid.uuid4().hex}.arrow"
        with files.open_output_stream(posixpath.join(base, name)) as out, pa.ipc.new_file(out, batch.schema) as file:
            file.write_batch(batch)
        got = batch.column("digest").to_numpy()
        longest = max(map(len, batch.column("key").to_pylist()))
        yield pa.record_batch({"path": [f"{folder}/{name}"], "low": [int(got[0])], "high": [int(got[-1])], "n": [len(got)], "longest": [longest]})

    return shards


def digest_array(rules: DataFrame, folder: str | None = None) -> list[tuple]:
    """Writes the sorted digest arrays of ``rules`` (host, path, verdict); gives a row (path, low, high, n, longest key) per shard.

    A shard has about a million keys, so the rows that come back are few. Besides a key per rule there is one per host, with the
    lengths of the paths that its rules have. Of two rules with one host and path, ``block`` wins. Rules with a null or
    empty host, a null path, another verdict than allow or block, or a path that doesn't begin with a slash stop the job.
    """
    host, path, verdict = F.translate(col("host"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), col("path"), col("verdict")
    good = (F.length(host) > 0) & ~host.rlike("[/?#]") & path.rlike("^(/[^?#]*)?$") & verdict.isin("allow", "block")
    rows = rules.select(F.when(F.coalesce(good, F.lit(False)), host).otherwise(F.raise_error(F.lit("not a rule: host, path starting with a slash, allow or block"))).alias("host"), path.alias("path"), verdict.alias("verdict"))
    keys = rows.select(F.inline(F.array(
        F.struct(F.concat("host", "path").alias("key"), F.col("verdict"), F.lit(None).cast("int").alias("length")),
        F.struct(F.col("host").alias("key"), F.lit(None).cast("string").alias("verdict"), F.length("path").alias("length")))))
    entries = keys.groupBy("key").agg(F.max("verdict").alias("verdict"), F.sort_array(F.collect_set("length")).alias("lengths")).select(F.xxhash64("key").alias("digest"), "*")
    folder = folder or new_path(rules.sparkSession, "digests")
    shards = entries.count() // SHARD_KEYS + 1
    written = entries.repartitionByRange(shards, "digest").sortWithinPartitions("digest", "key").mapInArrow(_write(folder), _SHARDS)
    return [tuple(r) for r in written.collect()]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, hash or the end, A to Z lower-cased; empty without one."""
    host = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _suffixes(host: str, longest: int) -> list[str]:
    """The host and its parent domains, but for those longer than any key."""
    out, at = [], -1
    while at is not None:
        if len(host) - at - 1 <= longest:
            out.append(host[at + 1:])
        at = host.find(".", at + 1) if "." in host[at + 1:] else None
    return [x for x in out if x]


def _rules_of(shards: Shards, hosts: list[str], paths: list[str], longest: int) -> list[tuple]:
    """(rule, verdict) of each URL: that with the longest host and path; of equal length that with the longer host."""
    suffixes = {h: _suffixes(h, longest) for h in set(hosts)}
    known = shards.find(list(set(chain.from_iterable(suffixes.values()))))
    asked = []
    for h, p in zip(hosts, paths):
        asked.append([(s, s + p[:n]) for s in suffixes[h] if s in known for n in known[s][1] if n <= len(p)])
    rules = shards.find(list({k for keys in asked for _, k in keys}))
    out = []
    for keys in asked:
        fits = [(len(k), len(s), k) for s, k in keys if k in rules and rules[k][0]]
        best = max(fits, default=None)
        out.append((best[2], rules[best[2]][0]) if best else (None, None))
    return out


def _judge(manifest: list[tuple], default: str):
    longest = max((m[4] for m in manifest), default=0)

    def judged(batches):
        shards = Shards(manifest)
        for whole in batches:
            for begin in range(0, whole.num_rows, SLICE):
                batch = whole.slice(begin, SLICE)
                found = _rules_of(shards, batch.column("host").to_pylist(), batch.column("path").to_pylist(), longest)
                yield pa.record_batch([
                    *[batch.column(c) for c in batch.schema.names], pa.array([r for r, _ in found], pa.string()), pa.array([v or default for _, v in found], pa.string())],
                    names=[*batch.schema.names, "rule", "verdict"])

    return judged


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """Per row of ``pages``: key, host, path, rule, verdict.

    A rule fits its host and all subdomains where the path begins with the rule's; the longest rule (host and path together)
    decides, and ``default`` where none fits, as for a URL that is null or has no ``://``: its host and path are empty. A
    port or user name is part of the host. Rows with equal or null keys are judged each by itself; other columns play no part. No rows,
    no result; without rules all is ``default``. Nothing is shuffled but the rules.
    """
    rows = pages.select(col(key).alias(key), host_of(col(url)).alias("host"), path_of(col(url)).alias("path"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_judge(digest_array(rules), default), f"{kinds}, rule string, verdict string")
