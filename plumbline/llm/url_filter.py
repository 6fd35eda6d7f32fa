"""URL rules, and a block list held as a cascade of Bloom filters, in DataFrame operations alone.

Level 1 holds the listed keys. Level 2 holds the keys of the corpus that pass level 1 without being listed, level 3
the listed keys that pass level 2, and so on until none are left. Over the keys of the corpus (and only over those) the
first level that a key fails tells exactly whether it is listed. The filters reach the rows as scalar subqueries, not
as joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, discard, only, spread

#: Bits for each key, and hashes: about 1 key in 40 passes wrongly.
BITS_PER_KEY, HASHES = 8, 4
#: Bits of the largest level (8 MB); the keys of a longer list are dealt into shards.
MAX_BITS = 1 << 26

# Rules (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def host_of(url: Column) -> Column:
    """What follows the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)).otherwise("")
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise(""), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path as one string) and its verdict; null without. A rule fits its host and all subdomains."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _places(key: Column, level: int, bits: int) -> list[Column]:
    # The level comes first, so that keys that meet in one level's hashes don't in the next one's.
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(i), key), F.lit(bits)) for i in range(HASHES)]


class Level:
    """A Bloom filter of one level, as a table of one row with an array of 64-bit words."""

    def __init__(self, keys: DataFrame, level: int, n: int) -> None:
        self.level, self.bits = level, 1 << max(6, (n * BITS_PER_KEY - 1).bit_length())
        spark = keys.sparkSession
        places = keys.select(F.explode(F.array(*_places(F.col("key"), level, self.bits))).alias("place"))
        words = places.select(F.expr("place DIV 64").alias("word"), F.expr("shiftleft(1L, CAST(place % 64 AS INT))").alias("bit"))
        zeros = spark.range(self.bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bit"))
        dense = words.union(zeros).groupBy("word").agg(F.bit_or("bit").alias("bits"))
        self.table = cut(dense.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w")).select(F.col("w.bits").alias("bits")))

    def passes(self, key: Column) -> Column:
        words = self.table.scalar()
        found = F.lit(True)
        for place in _places(key, self.level, self.bits):
            word = F.element_at(words, (F.floor(place / 64) + 1).cast("int"))
            found = found & (F.shiftrightunsigned(word, 0).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))) != 0)
        return found


class Shard:
    """The levels of one shard's keys, of (key, listed) each once."""

    def __init__(self, universe: DataFrame) -> None:
        self.levels: list[Level] = []
        held, other = universe.where("listed").select("key"), universe.where("NOT listed").select("key")
        while n := held.count():
            level = Level(held, len(self.levels), n)
            self.levels.append(level)
            passed = cut(other.where(level.passes(F.col("key"))))
            discard(other)
            held, other = passed, held
        discard(held, other)

    def listed(self, key: Column) -> Column:
        """Whether a key of the universe is listed: the first level that it fails decides."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(~self.levels[i].passes(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


class Cascade:
    """Exact membership among the keys of a corpus. ``universe`` has (key, listed), each key once."""

    def __init__(self, universe: DataFrame, max_bits: int = MAX_BITS) -> None:
        universe = cut(universe)
        n = universe.where("listed").count()
        # A tenth to spare, since hashes don't deal evenly; a level has up to twice its bits, a power of two.
        n_shards = -(-n * BITS_PER_KEY * 11 // (10 * max_bits)) if 2 * n * BITS_PER_KEY > max_bits else 1
        self.n_shards = 1 << (n_shards - 1).bit_length()
        self.shards = [Shard(universe.where(self._shard(F.col("key")) == i)) for i in range(self.n_shards)]
        discard(universe)

    def _shard(self, key: Column) -> Column:
        return F.coalesce(F.pmod(F.xxhash64(F.lit(-1), key), F.lit(self.n_shards)), F.lit(0)) if self.n_shards > 1 else F.lit(0)

    def flag(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """``rows`` with the boolean ``name``: nothing is shuffled or joined."""
        if self.n_shards == 1:
            return rows.withColumn(name, self.shards[0].listed(F.col(key)))
        of_shards = [rows.where(self._shard(F.col(key)) == i).withColumn(name, s.listed(F.col(key))) for i, s in enumerate(self.shards)]
        return reduce(DataFrame.unionAll, of_shards)


def judge_urls(pages: DataFrame, blocked: DataFrame, rules=RULES, max_bits: int = MAX_BITS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of (page_id, url); ``blocked`` has the listed hosts in ``host``.

    The longest rule that fits decides; without one a listed host is blocked and any other allowed. A null url and one
    without "://" have an empty host and path, which fit no rule. Rows are judged alone: repeats stay, other columns are not
    read. Null hosts in the list are nothing; repeated ones count once; an empty list blocks nothing. No rows give no rows.
    """
    pages = only(pages, page_id="long", url="string")
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    corpus = parsed.select(F.col("host").alias("key"), F.lit(False).alias("listed"))
    listed = only(blocked, host="string").where("host IS NOT NULL").select(F.col("host").alias("key"), F.lit(True).alias("listed"))
    cascade = Cascade(corpus.union(listed).groupBy("key").agg(F.bool_or("listed").alias("listed")), max_bits)
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    flagged = cascade.flag(parsed, "host", "on_list")
    return flagged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, F.when(F.col("on_list"), "block").otherwise("allow")).alias("verdict"))


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdicts of all pages; the list has the hosts whose MD5 begins with 0 or 1, as a stand-in for one from outside."""
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    hosts = pages.select(host_of(F.col("url")).alias("host")).distinct().where("host <> '' AND substring(md5(host), 1, 1) IN ('0', '1')")
    return judge_urls(pages, hosts)


OP7_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS v(rhost, rpath, says)),
f AS (SELECT h.page_id, rhost || rpath AS rule, says, row_number() OVER (PARTITION BY h.page_id ORDER BY length(rhost || rpath) DESC, rhost || rpath DESC) AS i
      FROM h JOIN r ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath))
SELECT h.page_id, h.host, h.path, f.rule, coalesce(f.says, CASE WHEN h.host <> '' AND substr(md5(h.host), 1, 1) IN ('0', '1') THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN f ON f.page_id = h.page_id AND f.i = 1
"""
