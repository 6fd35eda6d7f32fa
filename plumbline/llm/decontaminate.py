"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The test strings are the windows of ``width`` words of the benchmark's items. For each length of test string, a block is
two words. A table of shifts, indexed by a block's hash, says how far the search may move past a block that ends at the
current word; where it is 0, the bucket of that suffix names the test strings that may stand there. They are compared word
by word, first by hash and then, where all hashes agree, by their bytes. Positions in many stretches of text move in step,
as vectors.

A benchmark over ``TABLE_BYTES`` is searched in several passes, one after the other: a task holds the tables of one pass, in
which each item's words stand once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import append, cut, discard, documents, only
from .textnum import ALNUM, LOWER, U, Block, blocks, grams

#: Bytes of benchmark text in one set of tables; a larger benchmark is searched in several passes over the documents.
TABLE_BYTES = 16 << 20
#: Words of a test string.
WIDTH = 13
#: Words of text that one position walks through.
STRETCH = 512


@dataclass
class Items:
    """The words of a pass's items on end: hashes, and bytes with where each word begins in them."""

    hashes: np.ndarray
    text: np.ndarray
    at: np.ndarray


@dataclass
class Tables:
    """Test strings of one length: their places among the items' words, a CSR of their items, shifts by block, and the order of their suffixes."""

    length: int
    block: int
    words: Items
    place: np.ndarray
    item_at: np.ndarray
    items: np.ndarray
    shift: np.ndarray
    suffix: np.ndarray
    order: np.ndarray


def word_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of words on end, A-Z lower-cased."""
    sizes = ends - starts
    return LOWER[data[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]]


def _items(texts: list[str | None]) -> tuple[Items, np.ndarray]:
    """All words of the items, and each item's first."""
    found = list(blocks(pa.array(texts, pa.string()), ALNUM, LOWER))
    hashes, text, sizes, n_words = ([np.zeros(0, dtype=t)] for t in (np.uint64, np.uint8, np.int64, np.int64))
    for b in found:
        hashes.append(b.hashes)
        text.append(word_bytes(b.data, b.starts, b.ends))
        sizes.append(b.ends - b.starts)
        n_words.append(b.n_words)
    return Items(np.concatenate(hashes), np.concatenate(text), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])), np.concatenate([[0], np.cumsum(np.concatenate(n_words))])


def windows(first: np.ndarray, width: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: first word and item of every window; an item of fewer words is one window."""
    found: dict[int, tuple[list, list]] = {}
    for i, (low, high) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if size := min(width, high - low):
            places, owners = found.setdefault(size, ([], []))
            places.append(np.arange(low, high - size + 1))
            owners.append(np.full(high - low - size + 1, i))
    return {size: (np.concatenate(p), np.concatenate(o)) for size, (p, o) in found.items()}


def build(texts: list[str | None], width: int) -> list[Tables]:
    words, first = _items(texts)
    out = []
    for size, (places, owners) in sorted(windows(first, width).items()):
        _, one, which = np.unique(words.hashes[places[:, None] + np.arange(size)], axis=0, return_index=True, return_inverse=True)
        place = places[one]
        pairs = np.unique(np.stack([which.ravel(), owners], axis=1), axis=0)
        block = min(2, size)
        codes = grams(words.hashes, block)
        shift = np.full(1 << max(10, int(8 * place.size * size - 1).bit_length()), size - block + 1, dtype=np.int16)
        for end in range(block - 1, size):
            np.minimum.at(shift, (codes[place + end - block + 1] & U(len(shift) - 1)).astype(np.int64), size - 1 - end)
        suffix = codes[place + size - block]
        order = np.argsort(suffix, kind="stable")
        out.append(Tables(size, block, words, place, np.searchsorted(pairs[:, 0], np.arange(len(place) + 1)), pairs[:, 1], shift, suffix[order], order))
    return out


def same_bytes(b: Block, starts: np.ndarray, t: Tables, which: np.ndarray) -> np.ndarray:
    """Whether the words from ``starts`` on are, byte for byte, those of the test strings."""
    same = np.ones(len(starts), dtype=bool)
    for j in range(t.length):
        at = np.flatnonzero(same)
        low, high = b.starts[starts[at] + j], b.ends[starts[at] + j]
        own = t.place[which[at]] + j
        begin, size = t.words.at[own], t.words.at[own + 1] - t.words.at[own]
        ok = high - low == size
        same[at[~ok]] = False
        at, low, high, begin, size = at[ok], low[ok], high[ok], begin[ok], size[ok]
        if len(at):
            before = np.cumsum(size) - size
            differ = word_bytes(b.data, low, high) != t.words.text[np.repeat(begin - before, size) + np.arange(int(size.sum()))]
            same[at] = np.add.reduceat(differ, before) == 0
    return same


def search(b: Block, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """First word (in the block) and test string of all occurrences."""
    none = np.zeros(0, dtype=np.int64)
    n_words = b.n_words
    docs = np.flatnonzero(n_words >= t.length)
    if not len(docs):
        return none, none
    codes = grams(b.hashes, t.block)
    mask = U(len(t.shift) - 1)
    # Ends of test strings run from a document's word length - 1 to its last; each stretch walks through STRETCH of them.
    low, high = b.first[docs] + t.length - 1, b.first[docs + 1]
    pieces = -(-(high - low) // STRETCH)
    nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = np.repeat(low, pieces) + nth * STRETCH
    stop = np.minimum(at + STRETCH, np.repeat(high, pieces))
    hits = []
    while len(at):
        step = t.shift[(codes[at - t.block + 1] & mask).astype(np.int64)]
        hits.append(at[step == 0])
        at = at + np.maximum(step, 1)
        alive = at < stop
        at, stop = at[alive], stop[alive]
    ends = np.concatenate(hits)
    code = codes[ends - t.block + 1]
    left, right = np.searchsorted(t.suffix, code), np.searchsorted(t.suffix, code, side="right")
    sizes = right - left
    ends = np.repeat(ends, sizes)
    which = t.order[np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(left, sizes)] if sizes.sum() else none
    starts = ends - t.length + 1
    same = np.ones(len(starts), dtype=bool)
    for j in range(t.length):
        same[same] = b.hashes[starts[same] + j] == t.words.hashes[t.place[which[same]] + j]
    starts, which = starts[same], which[same]
    same = same_bytes(b, starts, t, which)
    return starts[same], which[same]


def occurrences(texts: pa.Array, tables: list[Tables]) -> Iterator[tuple[np.ndarray, list[list[tuple[int, int]]], list[np.ndarray]]]:
    """For each block of texts: words, stretches (low, high) of words in occurrences, and item numbers, by document."""
    for b in blocks(texts, ALNUM, LOWER):
        n = len(b.first) - 1
        stretches: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        items: list[list[np.ndarray]] = [[] for _ in range(n)]
        for t in tables:
            starts, which = search(b, t)
            owner = np.searchsorted(b.first, starts, side="right") - 1
            for d, s, w in zip(owner.tolist(), (starts - b.first[owner]).tolist(), which.tolist(), strict=True):
                stretches[d].append((s, s + t.length))
                items[d].append(t.items[t.item_at[w] : t.item_at[w + 1]])
        yield b.n_words, stretches, [np.unique(np.concatenate(x)) if x else np.zeros(0, dtype=np.int64) for x in items]


def covered(stretches: list[tuple[int, int]]) -> int:
    """Words inside any of the stretches."""
    total, reach = 0, 0
    for low, high in sorted(stretches):
        total += max(0, high - max(low, reach))
        reach = max(reach, high)
    return total


_FOUND = "n_words long, n_hit long, n_items long, items array<string>"
#: What a pass hands to the next: words in occurrences, as stretches that don't touch, and items.
_SO_FAR = "__low array<int>, __high array<int>, __items array<string>"


def merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(stretches):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _one_pass(items: list, width: int, first: bool, last: bool):
    """A function of texts (and of what earlier passes have found) that gives the columns of ``_FOUND`` in the last pass, else of ``_SO_FAR``."""
    names, tables = [x.item_id for x in items], build([x.text for x in items], width)

    def make(spark_value):
        def run(texts: pa.Array, *so_far: pa.Array) -> list[pa.Array]:
            names, tables = spark_value.value
            before = zip(*(c.to_pylist() for c in so_far), strict=True) if not first else None
            out = []
            for n_words, stretches, found in occurrences(texts, tables):
                for n, s, x in zip(n_words.tolist(), stretches, found, strict=True):
                    listed = {names[i] for i in x.tolist()}
                    if before is not None:
                        low, high, old = next(before)
                        s, listed = [*zip(low, high, strict=True), *s], listed | set(old)
                    out.append((n, merged(s), listed))
            if not last:
                return [pa.array([[x[i] for x in s] for _, s, _ in out], pa.list_(pa.int32())) for i in (0, 1)] + [pa.array([list(x) for _, _, x in out], pa.list_(pa.string()))]
            long = pa.int64()
            return [pa.array([n for n, _, _ in out], long), pa.array([covered(s) for _, s, _ in out], long), pa.array([len(x) for _, _, x in out], long), pa.array([sorted(x - {None}) for _, _, x in out], pa.list_(pa.string()))]

        return run

    return (names, tables), make


def find_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``docs`` with the benchmark passages in each text: (n_words, n_hit, n_items, items, contaminated) beside its columns.

    Words are runs of letters a-z, digits and non-ASCII characters with A-Z lower-cased. A test string is a window of
    ``width`` words of an item (a shorter, not wordless item is one). A word inside any occurrence counts as hit; items are
    those with an occurrence, as strings in order; those without id count in n_items as one and aren't listed. A text is
    contaminated if a twentieth of its words or more is hit. Null, empty and blank texts have no words; items without words or
    text are no test strings. Rows, repeated or not, are judged alone, in the scan's own tasks: nothing is shuffled. Columns of
    ``docs`` with the new names are replaced. A benchmark over ``table_bytes`` takes several passes, between which the texts are
    written with what has been found.
    """
    items = only(benchmark, item_id="string", text="string").where("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n, rows = -(-size // table_bytes) or 1, docs
    for i in range(n):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else items
        tables, make = _one_pass(some.collect(), width, i == 0, i + 1 == n)
        shared = docs.sparkSession.sparkContext.broadcast(tables)
        found = append(rows, make(shared), _FOUND if i + 1 == n else _SO_FAR, more=() if i == 0 else ("__low", "__high", "__items"))
        if i + 1 == n:
            rows = found.drop("__low", "__high", "__items") if n > 1 else found
            break
        before, rows = rows, cut(found)
        shared.destroy()
        discard(before)
    return rows.withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Words of each document inside 13-word passages of the benchmark."""
    found = find_benchmark(only(documents(spark, sf_dir), doc_id="long", text="string"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
t AS (SELECT DISTINCT item_id, least(13, len(ws)) AS size, unnest(list_transform(range(1, greatest(len(ws) - 12, 1) + 1), lambda j: array_to_string(ws[j:j + 12], ' '))) AS win FROM i WHERE len(ws) > 0),
p AS (SELECT doc_id, len(ws) AS n, ws, unnest(range(1, len(ws) + 1)) AS j FROM w),
s AS (SELECT DISTINCT size FROM t),
o AS (SELECT p.doc_id, p.j, s.size, t.item_id FROM p JOIN s ON p.j + s.size - 1 <= p.n JOIN t ON t.size = s.size AND t.win = array_to_string(p.ws[p.j:p.j + s.size - 1], ' ')),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + size)) AS k FROM o) GROUP BY doc_id),
x AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM o) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN x USING (doc_id)
"""
