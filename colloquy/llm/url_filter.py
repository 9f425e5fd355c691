"""URL filter: one trie over reversed host labels, then path segments.

A rule is (verdict, host, path). It fits a url whose host is the rule's host
or a subdomain of it and whose path starts with the rule's path. The longest
fitting rule wins: more host labels first, then the longer path. The trie is
walked label by label from the top-level domain and then segment by segment,
so a lookup costs the length of the url, whatever the number of rules.

Defined results: a null url, or one without ``://``, has empty host and path;
an empty host fits no rule; a url without a fitting rule gets the filter's
default verdict and a null rule. Two rules for the same place with different
verdicts are refused when the trie is built. Extra columns of the input are
kept unless they clash with a result column, which then wins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The trie is broadcast; this bounds it (a rule is a few hundred bytes).
MAX_RULES = 1_000_000
Rule = tuple[str, str, str]


class RuleTrie:
    """Host nodes are dicts keyed by label; ``""`` holds the node's path trie.
    In a path trie a node maps whole segments to nodes, ``PART`` maps to the
    rules that end inside a segment and ``""`` holds the rule that ends here."""

    PART = "\0part"

    def __init__(self, rules: Iterable[Rule]) -> None:
        self.top: dict = {}
        self.longest_part = 0
        for n, (verdict, host, path) in enumerate(rules):
            if n >= MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules")
            if verdict not in ("allow", "block"):
                raise ValueError(f"verdict {verdict!r}")
            node = self.top
            for label in reversed(host.split(".")):
                node = node.setdefault("." + label, {})
            node = node.setdefault("", {})
            *whole, part = path.split("/")
            for segment in whole:
                node = node.setdefault("/" + segment, {})
            ends = node.setdefault(self.PART, {})
            if ends.get(part, (verdict,))[0] != verdict:
                raise ValueError(f"two verdicts for {host}{path}")
            ends[part] = (verdict, host + path)
            self.longest_part = max(self.longest_part, len(part))

    def _longest_path(self, node: dict, path: str) -> tuple[str, str] | None:
        best = None
        segments = path.split("/")
        for i, segment in enumerate(segments):
            ends = node.get(self.PART)
            if ends:
                # a rule may end inside this segment: its longest prefix wins
                for cut in range(min(len(segment), self.longest_part), -1, -1):
                    if segment[:cut] in ends:
                        best = ends[segment[:cut]]
                        break
            node = node.get("/" + segment)
            if node is None or i + 1 == len(segments):
                break
        return best

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits, or None."""
        if not host:
            return None
        best, node = None, self.top
        for label in reversed(host.split(".")):
            node = node.get("." + label)
            if node is None:
                break
            if "" in node:
                best = self._longest_path(node[""], path) or best
        return best


def split_url(url: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(host, path) by the position of ``://`` and the first ``/ ? #``."""
    found = pc.extract_regex(url, r"(?s)^.*?://(?P<host>[^/?#]*)(?P<path>[^?#]*)")
    empty = pa.scalar("", pa.string())
    host = pc.fill_null(pc.struct_field(found, "host"), empty)
    path = pc.fill_null(pc.struct_field(found, "path"), empty)
    return pc.ascii_lower(host), path


def filter_urls(urls: DataFrame, rules: Iterable[Rule], default: str = "allow", col: str = "url") -> DataFrame:
    """``urls`` with host, path, rule and verdict added."""
    spark = urls.sparkSession
    trie = spark.sparkContext.broadcast(RuleTrie(rules))
    made = ["host", "path", "rule", "verdict"]
    kept = [c for c in urls.columns if c not in made]
    source = urls.select(*kept, F.col(col).alias("_url"))
    schema = urls.select(*kept, *(F.lit("").alias(c) for c in made)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = trie.value.match
        for b in batches:
            host, path = split_url(b.column(b.num_columns - 1))
            hits = [match(h, p) for h, p in zip(host.to_pylist(), path.to_pylist())]
            rule = pa.array([x and x[1] for x in hits], pa.string())
            verdict = pa.array([x[0] if x else default for x in hits], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], host, path, rule, verdict], [*kept, *made])

    for f in schema.fields:
        f.nullable = True
    return source.mapInArrow(run, schema)
