"""URL allow and block lists in a trie over reversed host labels and path segments.

A rule ``net/`` or ``example.com/de/`` covers its host and every subdomain when
the url's path starts with the rule's path. The longest match wins: more host
labels first, then the longer path; for the same host and path, block wins.
Rules are cut into tries of at most ``max_rules`` and ``max_bytes`` each; every
trie is broadcast and applied in the same pass over the urls, so larger lists
need more tries and not a larger broadcast.

Defined results: a null url, or one without ``://``, has empty host and path;
a url that no rule fits gets the default verdict and a null rule; repeated
urls are judged row by row; rules whose host is empty fit every host.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewatch.llm.frames import spare

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: keys of a node that no label or segment can have
PATHS, RULES = 0, 1


def build_trie(rules: Iterable[tuple[str, str]]) -> dict:
    """``(verdict, "host/path")`` pairs -> nested dicts: host labels from the
    right, then ``PATHS`` -> whole path segments, then ``RULES``: the rules
    that end there, as (last partial segment, rule, verdict), longest first."""
    root: dict = {}
    for verdict, rule in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r}")
        host, slash, path = rule.partition("/")
        node = root
        for label in reversed(host.split(".")) if host else ():
            node = node.setdefault(label, {})
        node = node.setdefault(PATHS, {})
        *whole, last = (slash + path).split("/")
        for segment in whole:
            node = node.setdefault(segment, {})
        ends = node.setdefault(RULES, {})
        if last not in ends or verdict == "block":
            ends[last] = (rule, verdict)
    stack = [root]
    while stack:  # longest partial segment first
        node = stack.pop()
        for key, child in node.items():
            if key is not RULES:
                stack.append(child)
        if RULES in node:
            node[RULES] = sorted(((x, *r) for x, r in node[RULES].items()), key=lambda e: -len(e[0]))
    return root


def match_path(node: dict, path: str) -> tuple[int, str, str] | None:
    """The longest rule whose path starts ``path``: (length, rule, verdict)."""
    best, at = None, 0
    segments = path.split("/")
    for i, segment in enumerate(segments):
        for last, rule, verdict in node.get(RULES, ()):
            if segment.startswith(last):
                best = (at + len(last), rule, verdict)
                break
        if i == len(segments) - 1 or segment not in node:
            break
        node = node[segment]
        at += len(segment) + 1
    return best


def match(trie: dict, host: str, path: str) -> tuple[tuple[int, int], str, str] | None:
    """((host labels, path length), rule, verdict) of the longest rule that fits."""
    best = None
    node, depth = trie, 0
    for label in [None, *reversed(host.split("."))]:
        if label is not None:
            node = node.get(label)
            depth += 1
        if node is None:
            break
        if PATHS in node and (found := match_path(node[PATHS], path)):
            best = ((depth, found[0]), *found[1:])
    return best


def split_rules(rules: Iterable[tuple[str, str]], max_rules: int, max_bytes: int) -> list[list[tuple[str, str]]]:
    parts, size = [[]], 0
    for r in rules:
        if parts[-1] and (len(parts[-1]) >= max_rules or size + len(r[1]) > max_bytes):
            parts.append([])
            size = 0
        parts[-1].append(r)
        size += len(r[1])
    return parts


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], default: str = "allow", url: str = "url",
                max_rules: int = 200_000, max_bytes: int = 16 << 20) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` (columns of these names are replaced)."""
    sc = pages.sparkSession.sparkContext
    tries = [sc.broadcast(build_trie(p)) for p in split_rules(rules, max_rules, max_bytes)]

    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.expr(f"substr(`{url}`, instr(`{url}`, '://') + 3)"), "#", 1))
    rest = F.substring_index(F.coalesce(rest, F.lit("")), "?", 1)
    host = F.translate(F.substring_index(rest, "/", 1), UPPER, LOWER)
    path = F.when(F.instr(rest, "/") > 0, F.substr(rest, F.instr(rest, "/"))).otherwise("")

    @F.pandas_udf("rule string, verdict string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            out = []
            for h, p in zip(hosts, paths):
                found = [m for t in tries if (m := match(t.value, h, p))]
                best = max(found, key=lambda m: (m[0], m[2] == "block"), default=None)
                out.append((best[1], best[2]) if best else (None, default))
            yield pd.DataFrame(out, columns=["rule", "verdict"])

    out = pages.withColumns({"host": host, "path": path})
    j = spare(out, "_judged")
    return out.withColumn(j, judge("host", "path")).withColumns({c: F.col(f"{j}.{c}") for c in ("rule", "verdict")}).drop(j)
