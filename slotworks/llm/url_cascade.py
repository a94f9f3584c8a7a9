"""URL filters by a Bloom filter cascade, in DataFrame functions only.

Keys are domains with a path prefix (`net/`, `example.net/en/`). Level 1 of a cascade encodes the
listed keys, level 2 those other keys of the corpus that pass level 1, level 3 the listed keys
that pass level 2, and so on until a level lets nothing wrong through. Over the complete key
universe of the corpus, the first level that lacks a key decides its membership exactly, so pages
are judged without a join. Levels are arrays of longs of at most `most_bits` bits; a longer list
is cut by hash into parts with a cascade each, looked through one after the other.

A page's keys are every domain suffix of its host with every path prefix that has the length of
some listed path. The longest key that is in a rule cascade wins (by characters, then by
alphabet); without one, the page is blocked if its host or a parent domain is listed.

Edge cases: a null url, or one without `://`, has an empty host and path and no key, so it is
allowed; null keys and null actions in a list are ignored; a key listed for both actions blocks;
repeated pages are judged alike; urls of any length are read whole; empty tables give an empty
result, or no rule. Other columns of pages are dropped.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pin

BITS_PER_KEY = 12
MOST_BITS = 1 << 22


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host (A-Z in lower case) and path, both empty without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "path": path})


def page_keys(lengths: list[int]) -> Column:
    """All keys of a page: domain suffixes with path prefixes of the given lengths."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda p: p.isNotNull())
    both = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(both)


def _spots(key: Column, level: int, bits: int) -> list[Column]:
    h = F.xxhash64(key, F.lit(level))
    return [F.pmod(h, F.lit(bits)), F.pmod(F.shiftright(h, 32), F.lit(bits))]


def _passes(key: Column, level: int, words: list[int]) -> Column:
    table, bits = F.from_json(F.lit(str(words)), "array<bigint>"), 64 * len(words)
    hits = [F.getbit(F.get(table, F.shiftright(s, 6).cast("int")), s.bitwiseAND(63).cast("int")) == 1 for s in _spots(key, level, bits)]
    return hits[0] & hits[1]


def _encode(keys: DataFrame, level: int, n: int) -> list[int]:
    """Words of a filter over n keys; the driver sees its bits only, whose number is bounded."""
    bits = max(64, 1 << (BITS_PER_KEY * n - 1).bit_length())
    spot = F.explode(F.array(*_spots(F.col("key"), level, bits)))
    rows = (keys.select(spot.alias("b")).groupBy(F.shiftright("b", 6).alias("w"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("b").bitwiseAND(63).cast("int"))).alias("v")).collect())
    out = [0] * (bits // 64)
    for r in rows:
        out[r["w"]] = r["v"]
    return out


class Cascade:
    """Exact membership of a set of keys within a universe."""

    def __init__(self, levels: list[list[int]]):
        self.levels = levels

    @classmethod
    def build(cls, universe: DataFrame, listed: DataFrame) -> Cascade:
        """Both sides hold distinct keys; keys outside the universe need no encoding."""
        inside = pin(universe.join(listed, "key", "left_semi"), "cascade")
        outside = universe.join(listed, "key", "left_anti")
        levels, here, n = [], inside, inside.count()
        while n:
            words = _encode(here, len(levels), n)
            levels.append(words)
            there = pin(outside.filter(_passes(F.col("key"), len(levels) - 1, words)), "cascade")
            here, outside, n = there, here, there.count()
        return cls(levels)

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        found = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            found = F.when(~_passes(key, level, self.levels[level]), F.lit(level % 2 == 1)).otherwise(found)
        return found


def cascades(universe: DataFrame, listed: DataFrame, most_bits: int = MOST_BITS) -> list[tuple[int, Cascade]]:
    """(part, cascade) for each part of a list; one part unless the list is long."""
    listed = listed.filter(F.col("key").isNotNull()).select("key").distinct()
    parts = max(1, -(-BITS_PER_KEY * listed.count() // (most_bits // 2)))
    own = F.pmod(F.xxhash64("key", F.lit("part")), F.lit(parts))
    return [(parts, Cascade.build(universe.filter(own == p), listed.filter(own == p))) for p in range(parts)]


def _held(keys: str, found: list[tuple[int, Cascade]]) -> Column:
    def holds(k: Column) -> Column:
        parts = found[0][0]
        own = F.pmod(F.xxhash64(k, F.lit("part")), F.lit(parts))
        out = F.lit(False)
        for p, (_, c) in enumerate(found):
            out = F.when(own == p, c.holds(k)).otherwise(out)
        return out

    return F.filter(keys, holds)


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict) of every page. rules: (key, action); listed: (key) of blocked domains without a path."""
    rules = rules.filter(F.col("key").isNotNull() & F.col("action").isin("allow", "block"))
    lengths = [r["n"] for r in rules.select(F.length(F.expr("substring(key, length(substring_index(key, '/', 1)) + 1)")).alias("n")).distinct().collect()]
    split = with_host_path(pages, url).select(F.col(key).alias("_key"), "host", "path")
    keyed = split.withColumns({"_rules": page_keys(sorted(lengths)), "_domains": page_keys([0])})
    block = rules.filter("action = 'block'").select("key").distinct()
    allow = rules.filter("action = 'allow'").select("key").distinct().join(block, "key", "left_anti")

    def universe(column: str) -> DataFrame:
        return pin(keyed.select(F.explode(column).alias("key")).distinct(), "universe")

    of_rules, of_domains = universe("_rules"), universe("_domains")
    found = keyed.select("_key", "host", "path", _held("_rules", cascades(of_rules, block)).alias("_b"), _held("_rules", cascades(of_rules, allow)).alias("_a"),
                         F.size(_held("_domains", cascades(of_domains, listed))).alias("_n"))

    def longest(keys: str) -> Column:
        return F.array_max(F.transform(keys, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))

    b, a = longest("_b"), longest("_a")
    blocks = b.isNotNull() & (a.isNull() | (b > a))
    rule = F.when(blocks, b["k"]).otherwise(a["k"])
    verdict = F.when(blocks, "block").when(a.isNotNull(), "allow").when(F.col("_n") > 0, "block").otherwise("allow")
    return found.select(F.col("_key").alias(key), "host", "path", rule.alias("rule"), verdict.alias("verdict"))
