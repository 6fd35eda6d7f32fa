"""Mixing sources to target weights by Pfair scheduling.

A source's documents are dealt, in a fixed pseudo-random order, into blocks. With weight w its block j is released at slot
floor(j / w) and due at slot ceil((j + 1) / w); each slot takes the released block that is due first. So at every slot
each source has had less than one block more or less than its weight's share.

Weights are whole numbers of parts, so the schedule repeats after as many slots as there are parts: one period is
computed and its table serves any number of blocks. When a source has no block left, the others share the slots by
their weights from there on: a phase. There are no more phases than classes, so what is sent to the tasks depends on the
weights and the number of classes alone.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut, discard, documents

#: Parts of all weights together: bound of a period's table.
MAX_PARTS = 4096
#: Documents, about, in a piece of a class that one task orders.
PIECE_ROWS = 1024


def period(parts: Mapping[str, int]) -> dict[str, list[int]]:
    """Slots of each source's blocks in one period, by earliest deadline first among released blocks."""
    total = sum(parts.values())
    slots: dict[str, list[int]] = {s: [] for s in parts}
    # (release, source, block); integers throughout: block j of p parts is released at j * total // p.
    waiting = [(0, s, 0) for s, p in sorted(parts.items()) if p]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // parts[s]), s, j))
        _, s, j = heapq.heappop(ready)
        slots[s].append(slot)
        if j + 1 < parts[s]:
            heapq.heappush(waiting, ((j + 1) * total // parts[s], s, j + 1))
    return slots


@dataclass
class Phase:
    """Slots from ``start`` on: source s goes on from block ``first[s]`` with ``slots[s]`` of each ``total``."""

    start: int
    total: int
    first: dict[str, int]
    slots: dict[str, array]


def phases(parts: Mapping[str, int], blocks: Mapping[str, int]) -> list[Phase]:
    """Phases until every source has placed its blocks."""
    out, start = [], 0
    done = dict.fromkeys(blocks, 0)
    while active := {s: parts[s] for s in blocks if blocks[s] > done[s]}:
        slots, total = period(active), sum(active.values())
        length = min((left - 1) // p * total + slots[s][(left - 1) % p] + 1 for s, p in active.items() for left in [blocks[s] - done[s]])
        out.append(Phase(start, total, {s: done[s] for s in active}, {s: array("H", x) for s, x in slots.items()}))
        for s, p in active.items():
            done[s] += length // total * p + sum(x < length % total for x in slots[s])
        start += length
    return out


def _table(spark: SparkSession, plan: list[Phase], short: Mapping[str, int]) -> DataFrame:
    """A row for each class, with its phases in arrays; ``back`` are the rows that blocks of used-up classes lack before a phase."""
    back, lacking = [], 0
    for ph, after in zip(plan, [*plan[1:], None]):  # noqa: B905
        back.append(lacking)
        lacking += sum(short[s] for s in ph.slots if after is None or s not in after.slots)
    rows = [(s, [(ph, b) for ph, b in zip(plan, back, strict=True) if s in ph.slots]) for s in (plan[0].slots if plan else ())]
    longs, tables = pa.list_(pa.int64()), pa.list_(pa.list_(pa.int16()))
    columns = {
        "__key": pa.array([s for s, _ in rows], pa.string()), "__first": pa.array([[ph.first[s] for ph, _ in x] for s, x in rows], longs), "__start": pa.array([[ph.start for ph, _ in x] for _, x in rows], longs),
        "__total": pa.array([[ph.total for ph, _ in x] for _, x in rows], longs), "__back": pa.array([[b for _, b in x] for _, x in rows], longs), "__slots": pa.array([[ph.slots[s] for ph, _ in x] for s, x in rows], tables),
    }
    return spark.createDataFrame(pa.table(columns))


def _classes(by_source: DataFrame, parts: Mapping[str, int], rest: int) -> tuple[dict[str, int], bool]:
    """Weights of the sources (source, n) that have a class of their own, and whether others are left."""
    present = {r[0]: parts[r[0]] for r in by_source.where(F.col("source").isin(list(parts))).select("source").collect()} if parts else {}
    unit = math.gcd(rest, *present.values())
    most = (MAX_PARTS * unit - sum(present.values()) - rest) // rest
    others = by_source.where("source IS NOT NULL").where(~F.col("source").isin(list(present)) if present else F.lit(True))
    found = [r[0] for r in others.orderBy(F.desc("n"), "source").limit(most + 1).select("source").collect()]
    return present | dict.fromkeys(found[:most], rest), len(found) > most


def mix(docs: DataFrame, parts: Mapping[str, int], rest: int = 1, block_rows: int = 32, source: str = "source", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """All rows of ``docs`` with ``mix_class``, ``block``, ``slot`` and ``position`` (from 0, dense) of the mixture.

    ``parts`` are whole-number weights by source; each source present that it doesn't name is a class of its own of weight
    ``rest``. Only rows without a source share a class (null) of that weight. Where the weights of all classes, over their
    common divisor, would be more than ``MAX_PARTS``, the unnamed sources with the most rows (then the first by name) have
    classes as far as that goes, and the others are in the null class. A block is ``block_rows`` rows, a class's last may be
    smaller. Rows are never dropped or repeated: when a class is used up the others go on by their weights. The order within
    a class is that of a hash of the whole row, then of the row's columns; equal rows are interchangeable, so repeated rows
    and ties give one defined mixture. Columns of ``docs`` with the new names are replaced, all others stay. No rows give no
    rows.

    A class of any size is ordered in pieces of about ``piece_rows`` rows by hash, each in a task; pieces are numbered from
    their counts. The driver sees one count for each class (``MAX_PARTS`` of them at most); the table of slots goes to the tasks.
    """
    if any(p < 1 for p in (*parts.values(), rest)) or sum(parts.values()) + rest > MAX_PARTS:
        raise ValueError(f"weights are whole numbers from 1, together at most {MAX_PARTS}")
    names = [c for c in docs.columns if c.lower() not in ("mix_class", "block", "slot", "position")]
    own = [f"c{i}" for i in range(len(names))]
    named = F.col(own[[c.lower() for c in names].index(source.lower())]).cast("string")
    docs = docs.select(*(F.col(f"`{c}`") for c in names)).toDF(*own)
    by_source = cut(docs.groupBy(named.alias("source")).agg(F.count(F.lit(1)).alias("n")))
    weights, more = _classes(by_source, parts, rest)

    def in_class(source):
        return F.when(source.isin(list(weights)), source) if more else source

    def key(of_class):
        return F.coalesce(F.concat(F.lit("="), of_class), F.lit(""))

    sizes = {r[0]: r[1] for r in by_source.groupBy(key(in_class(F.col("source"))).alias("k")).agg(F.sum("n")).collect()}
    discard(by_source)
    rows = docs.withColumn("__class", in_class(named))
    rows = rows.withColumns({"__key": key(F.col("__class")), "__h": F.xxhash64(*own)})
    in_pieces = pa.table({"__key": pa.array(list(sizes), pa.string()), "__pieces": pa.array([-(-n // piece_rows) for n in sizes.values()], pa.int64())})
    rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(in_pieces)), "__key")
    rows = rows.withColumn("__piece", F.expr("CAST(floor((CAST(__h AS DOUBLE) / 18446744073709551616D + 0.5D) * __pieces) AS BIGINT)"))
    counts = cut(rows.groupBy("__key", "__piece").agg(F.count(F.lit(1)).alias("__n")))
    before = F.sum("__n").over(Window.partitionBy("__key").orderBy("__piece")) - F.col("__n")
    offsets = counts.select("__key", "__piece", before.alias("__before"))
    weights = {"": rest} | {f"={s}": p for s, p in weights.items()}
    unit = math.gcd(*(weights[k] for k in sizes))
    plan = phases({k: weights[k] // unit for k in sizes}, {k: -(-n // block_rows) for k, n in sizes.items()})
    table = _table(docs.sparkSession, plan, {k: -n % block_rows for k, n in sizes.items()})

    order = ["__h", *(c for c, t in docs.dtypes if "map<" not in t and "variant" not in t)]
    nth = F.row_number().over(Window.partitionBy("__key", "__piece").orderBy(*order))
    placed = rows.join(offsets, ["__key", "__piece"]).withColumn("__nth", nth + F.col("__before") - 1).withColumn("block", F.expr(f"__nth DIV {block_rows}L"))
    placed = placed.join(F.broadcast(table), "__key").withColumn("__at", F.expr("size(filter(__first, x -> x <= block)) - 1"))
    placed = placed.withColumns({"__of": F.expr("__slots[__at]"), "__in": F.expr("block - __first[__at]")})
    placed = placed.withColumn("slot", F.expr("__start[__at] + __in DIV size(__of) * __total[__at] + __of[CAST(__in % size(__of) AS INT)]"))
    # A class's last block may be short by some rows: what comes later stands so much further to the front.
    position = F.col("slot") * block_rows + F.pmod(F.col("__nth"), F.lit(block_rows)) - F.expr("__back[__at]")
    kept = [F.col(c).alias(name) for c, name in zip(own, names, strict=True)]
    return placed.select(*kept, F.col("__class").alias("mix_class"), F.col("block").cast("long"), F.col("slot").cast("long"), position.cast("long").alias("position"))


# Weights of the queries: the largest source 25 parts, the next ones fewer, each other source QUERY_REST.
QUERY_PARTS = {"src0": 25, "src1": 15, "src2": 12, "src3": 10, "src4": 8, "src5": 6, "src6": 5, "src7": 4, "src8": 3, "src9": 2}
QUERY_REST = 10


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Places of all documents in a mixture of the sources."""
    docs = documents(spark, sf_dir).select("doc_id", "source")
    return mix(docs, QUERY_PARTS, QUERY_REST).select("doc_id", "source", "mix_class", "block", "slot", "position")
