"""Operator 4: URL rules through a blocked Bloom filter and an exact join.

A rule lists a host and a path prefix with a verdict, in canonical form
(``example.com/en/``).  A url's candidates are its host and all its parent
domains, each with the prefixes of its path that have the length of some
listed path.  The blocked Bloom filter over the listed canonical urls is
broadcast and passes the candidates that may be listed; an exact hash join
with the rules removes the false hits.  The longest listed candidate decides;
a url without one is allowed.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.bloom import BlockedBloom, build
from ledgerlens.llm.words import U64, map_arrow

#: Verdict of urls that no rule fits: a block list passes what it doesn't list.
DEFAULT_VERDICT = "allow"
#: Equal rows that are written out from one array.
HEAP = 4096


def canonical(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    stop = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    path = rest[stop:]
    end = min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))
    return rest[:stop].translate(_LOWER), path[:end]


_UPPER = string.ascii_uppercase
_LOWER = str.maketrans(_UPPER, _UPPER.lower())


def candidates(host: str, path: str, lengths: list[tuple[int, int]]) -> list[str]:
    """Canonical urls that could be listed and would fit, longest first.

    ``lengths`` are the (host, path) lengths of listed rules: only a parent
    domain of a listed length is built, so a host of any length costs a look at
    as many places.
    """
    out = {host[len(host) - h:] + path[:p] for h, p in lengths
           if h <= len(host) and p <= len(path) and (h == len(host) or host[-h - 1] == ".")}
    return sorted(out, key=len, reverse=True)


def rule_key(rule: str) -> int:
    return xxhash.xxh3_64_intdigest(rule.encode())


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = DEFAULT_VERDICT) -> DataFrame:
    """``(id, host, path, rule, verdict)``, one row per row of ``pages``.

    ``rules(host, path, verdict)``: ``path`` is empty or starts with ``/``.
    A rule fits a url whose host is the rule's or a subdomain of it and whose
    path starts with the rule's; the longest ``host + path`` decides (a rule
    listed twice: the smaller verdict).  Without a rule, ``rule`` is null and
    the verdict is ``default``.

    Null urls and urls without ``://`` have empty host and path and no rule.
    Repeated rows and null ids are kept as they are; other columns of both
    tables are not read.  An empty rule table gives the default everywhere.
    """
    listed = (rules.select(F.translate("host", _UPPER, _UPPER.lower()).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
              .where("host IS NOT NULL AND host != ''")
              .groupBy(F.concat("host", "path").alias("rule"), F.length("host").alias("hlen"), F.length("path").alias("plen"))
              .agg(F.min("verdict").alias("rule_verdict")))
    lengths = sorted(map(tuple, listed.select("hlen", "plen").distinct().collect()))  # lengths, not rules: a few
    exact = listed.groupBy("rule").agg(F.min("rule_verdict").alias("rule_verdict"))
    sc = pages.sparkSession.sparkContext
    keys = map_arrow(exact.select("rule"), _keys, "key long")
    filter_words = sc.broadcast(build(keys, "key", exact.count()).words)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = BlockedBloom(filter_words.value)
        for batch in batches:
            hosts, paths, found, owner, keys_ = [], [], [], [], []
            for i, url in enumerate(batch.column("url").to_pylist()):
                host, path = canonical(url)
                hosts.append(host)
                paths.append(path)
                own = candidates(host, path, lengths)
                found.extend(own)
                owner.extend([i] * len(own))
                keys_.extend(map(rule_key, own))
            hit = bloom.hits(np.array(keys_, U64))
            kept: list[list[str]] = [[] for _ in hosts]
            for j in np.flatnonzero(hit):
                kept[owner[j]].append(found[j])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(hosts, pa.string()), pa.array(paths, pa.string()),
                 pa.array(kept, pa.list_(pa.string()))], ["id", "host", "path", "hits"])

    id_type = dict(pages.select(F.col(id_col)).dtypes)[id_col]
    probed = map_arrow(pages.select(pages[id_col].alias("id"), pages[url_col].alias("url")), probe,
                       f"id {id_type}, host string, path string, hits array<string>")
    # one row per possible hit; equal pages are counted at their first one, so
    # that the grouping below needs no row number
    spread = probed.selectExpr("id", "host", "path", "posexplode_outer(hits) AS (pos, hit)")
    joined = spread.join(exact.withColumnRenamed("rule", "listed"), F.col("hit") == F.col("listed"), "left")
    best = joined.groupBy("id", "host", "path").agg(
        F.max(F.when(F.col("listed").isNotNull(), F.struct(F.length("listed").alias("n"), F.col("listed").alias("rule"),
                                                           F.col("rule_verdict").alias("verdict")))).alias("best"),
        F.count(F.when(F.coalesce("pos", F.lit(0)) == 0, 1)).alias("copies"))
    # equal rows are written out in two steps, so that no array is as long as
    # their number
    heaps = best.select("id", "host", "path", F.col("best.rule").alias("rule"),
                        F.coalesce("best.verdict", F.lit(default)).alias("verdict"), "copies",
                        F.explode(F.expr(f"sequence(0L, (copies - 1) div {HEAP})")).alias("heap"))
    inside = F.least(F.lit(HEAP), F.col("copies") - F.col("heap") * HEAP).cast("int")
    return heaps.withColumn("copy", F.explode(F.array_repeat(F.lit(0), inside))).drop("copies", "heap", "copy")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.array([rule_key(r) for r in batch.column(0).to_pylist()], U64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], ["key"])
