"""URL allow and block lists: a trie over reversed host labels and path segments; the longest fitting rule wins."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from pagemill.llm.common import append, checkpoint

#: Bytes of rules in one trie, and rules; more are read in several blocks, each a pass over the urls.
BLOCK_BYTES = 16 << 20

SCHEMA = "host string, path string, verdict string"


class Trie:
    """Host labels from the last to the first, then path segments; a rule's last segment may be begun only.

    A node is [labels, segments, begun]: labels leads to more specific hosts, segments to complete path
    segments, begun holds (beginning of a segment, rule) of the rules that end in this node.
    """

    def __init__(self, rules) -> None:
        self.root: list = [{}, {}, []]
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node[0].setdefault(label, [{}, {}, []])
            *whole, last = path.split("/")
            for segment in whole:
                node = node[1].setdefault(segment, [{}, {}, []])
            # Of equal rules, block wins.
            node[2] = [r for r in node[2] if r[0] != last or r[1][1] == "block"]
            if all(r[0] != last for r in node[2]):
                node[2].append((last, (host + path, verdict)))

        def order(node) -> None:
            stack = [node]
            while stack:
                n = stack.pop()
                n[2].sort(key=lambda r: -len(r[0]))
                stack += [*n[0].values(), *n[1].values()]

        order(self.root)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """Rule and verdict of the most specific host, and there the longest path, that fit."""
        nodes, node = [self.root], self.root
        for label in reversed(host.split(".")) if host else ():
            node = node[0].get(label)
            if node is None:
                break
            nodes.append(node)
        segments = path.split("/")
        for node in reversed(nodes):
            best, at = None, node
            for i, segment in enumerate(segments):
                for begun, rule in at[2]:
                    if segment.startswith(begun):
                        best = rule
                        break
                at = at[1].get(segment) if i < len(segments) - 1 else None
                if at is None:
                    break
            if best:
                return best
        return None


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased and path of a url; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    rest = F.regexp_replace(F.coalesce(rest, F.lit("")), r"(?s)[?#].*$", "")
    host = F.regexp_extract(rest, r"(?s)^([^/]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_replace(rest, r"(?s)^[^/]*", "")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (host and path of the rule that won, else null) and verdict.

    ``rules`` has host, path and verdict (allow or block); null host or path is empty and fits all, a null
    verdict is no rule. A rule fits its host and all subdomains where the path starts with the rule's path. The
    most specific host wins, then the longest path, then block before allow. A url that no rule fits gets ``default``.
    Tries hold at most ``BLOCK_BYTES`` of rules: more rules take one pass a block, and the best of all
    blocks wins, by the same order. Columns with the new names are replaced. No shuffle.
    """
    rows = rules.where("verdict is not null").select(F.coalesce("host", F.lit("")).alias("h"), F.coalesce("path", F.lit("")).alias("p"), F.col("verdict").alias("v")).distinct()
    rows = checkpoint(rows.withColumn("size", F.octet_length("h") + F.octet_length("p") + 64))
    total = rows.agg(F.sum("size")).first()[0] or 0
    blocks = 1 if total <= BLOCK_BYTES else -(-2 * total // BLOCK_BYTES)
    host, path = url_parts(F.col(url))
    out = pages.withColumn("__url_host", host).withColumn("__url_path", path)
    for block in range(blocks):
        some = rows.where(F.pmod(F.xxhash64("h", "p"), F.lit(blocks)) == block).select("h", "p", "v").collect()
        out = _pass(checkpoint(out) if block else out, [tuple(r) for r in some], block > 0)
    best = F.col("__url_best")
    new = {"host": F.col("__url_host"), "path": F.col("__url_path"), "rule": best["rule"], "verdict": F.coalesce(best["verdict"], F.lit(default))}
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in new]
    return out.select(*kept, *[c.alias(n) for n, c in new.items()])


def _pass(pages: DataFrame, rules: list[tuple], further: bool) -> DataFrame:
    sent = pages.sparkSession.sparkContext.broadcast(rules)

    def start():
        trie = Trie(sent.value)
        known = functools.lru_cache(50_000)(trie.find)
        hosts = {h + p: (h.count(".") + 1 if h else 0, len(h), len(p), v == "block") for h, p, v in sent.value}

        def place(found):
            return (found["labels"], found["length"], found["block"]) if found else (-1, 0, False)

        def batch(rows):
            old = rows.column("__url_best").to_pylist() if further else [None] * len(rows)
            out = []
            for host, path, before in zip(rows.column("__url_host").to_pylist(), rows.column("__url_path").to_pylist(), old):
                hit = known(host, path)
                now = None
                if hit:
                    labels, _, length, block = hosts[hit[0]]
                    now = {"rule": hit[0], "verdict": hit[1], "labels": labels, "length": length, "block": block}
                out.append(max(before, now, key=place) if before or now else None)
            return [out]

        return batch

    return append(pages, "__url_best struct<rule:string,verdict:string,labels:int,length:int,block:boolean>", start, needs=["__url_best"] if further else [])


#: The rules of the query.
RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


def op8_urls(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, spark.createDataFrame(RULES, SCHEMA)).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
with rules(h, p, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest as (select page_id, case when strpos(url, '://') > 0 then regexp_replace(substr(url, strpos(url, '://') + 3), '[?#](.|\n)*$', '') else '' end as r from pages),
parts as (
  select page_id, translate(case when strpos(r, '/') > 0 then substr(r, 1, strpos(r, '/') - 1) else coalesce(r, '') end, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    case when strpos(r, '/') > 0 then substr(r, strpos(r, '/')) else '' end as path, row_number() over () as n from rest
)
select a.page_id, a.host, a.path, max_by(r.h || r.p, length(r.h) * 100000 + length(r.p)) as rule,
  coalesce(max_by(r.v, length(r.h) * 100000 + length(r.p)), 'allow') as verdict
from parts a left join rules r on (a.host = r.h or ends_with(a.host, '.' || r.h)) and starts_with(a.path, r.p)
group by a.n, a.page_id, a.host, a.path
"""
