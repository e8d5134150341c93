"""URL rules in a trie.

A rule is a host and a path; it fits that host and all its subdomains where the url's path
starts with the rule's. The trie goes down the reversed labels of the host, then the whole
segments of the path; what a rule's path has behind its last slash is kept at that node as the
start of a further segment. A walk over one url meets every rule that fits; the longest one
decides, by the length of ``host + path``, a block before an allow of equal length.

Tries travel by broadcast in blocks of ``RULES`` rules at most; more rules are more blocks, and
each pass keeps the longest rule met so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterops.llm.frames import arrow_of, batch_of, pick, restored, table_rows

RULES = 500_000
_CAPITALS = {c: c + 32 for c in range(65, 91)}  # only A-Z is lowered


class Trie:
    """Nodes are dicts; a node's rules sit under the key 0 by the start of the next segment."""

    def __init__(self, rules: list[tuple[str, str, str]]) -> None:
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            *whole, start = path.split("/")
            node = node.setdefault(1, {})  # from hosts to paths
            for segment in whole:
                node = node.setdefault(segment, {})
            known = node.setdefault(0, {}).get(start)
            if known is None or verdict == "block":
                node[0][start] = (f"{host}{path}", verdict)

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule that decides: its text and verdict."""
        best: tuple[str, str] | None = None
        segments = path.split("/")
        hosts, labels = self.root, host.split(".")
        while labels and (hosts := hosts.get(labels.pop())) is not None:
            node, depth = hosts.get(1), 0
            while node is not None and depth < len(segments):
                for start, rule in node.get(0, {}).items():
                    if segments[depth].startswith(start):
                        best = max_rule(best, rule)
                node, depth = node.get(segments[depth]) if depth < len(segments) - 1 else None, depth + 1
        return best


def max_rule(a: tuple[str, str] | None, b: tuple[str, str] | None) -> tuple[str, str] | None:
    """The longer rule, a block before an allow, then the smaller text."""
    if a is None or b is None:
        return a or b
    return min(a, b, key=lambda rule: (-len(rule[0]), rule[1] != "block", rule[0]))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lowered) and path; both empty without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1].split("#", 1)[0].split("?", 1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_CAPITALS), slash + path


def judge(
    pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", most: int = RULES
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``.

    ``rules`` has ``host, path, verdict``; rules with a null, an empty host or another verdict
    than allow or block are left out. A url that no rule fits, a null one or one without a host
    gets ``default`` and a null rule. Repeated rows are judged each.
    """
    rows = pick(pages, page_id=id_col, url=url_col)
    kind = rows.schema["page_id"].dataType.simpleString()
    layout = f"page_id {kind}, host string, path string, rule string, verdict string"
    schema = arrow_of(rows.sparkSession.createDataFrame([], layout))
    known = pick(rules, host="host", path="path", verdict="verdict").filter("host <> '' and path is not null and verdict in ('allow', 'block')").distinct()
    blocks = -(-known.count() // most) or 1
    judged = None
    for block in range(blocks):
        part = known.filter(F.pmod(F.xxhash64("host", "path"), F.lit(blocks)) == block)
        trie = rows.sparkSession.sparkContext.broadcast(vars(Trie([tuple(r) for r in part.toLocalIterator()])))
        if judged is None:
            judged = rows.withColumn("url", F.col("url").cast("string")).mapInArrow(_first(trie, schema, default), layout)
        else:
            judged = judged.mapInArrow(_next(trie, schema), layout)
    return judged


def _first(trie, schema: pa.Schema, default: str):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = restored(Trie, trie.value).longest
        for batch in batches:
            out = []
            for page_id, url in table_rows([batch]):
                host, path = split_url(url)
                out.append((page_id, host, path, *(longest(host, path) or (None, default))))
            yield batch_of(out, schema)

    return walk


def _next(trie, schema: pa.Schema):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = restored(Trie, trie.value).longest
        for batch in batches:
            out = []
            for page_id, host, path, rule, verdict in table_rows([batch]):
                best = max_rule((rule, verdict) if rule is not None else None, longest(host, path))
                out.append((page_id, host, path, *(best or (None, verdict))))
            yield batch_of(out, schema)

    return walk
