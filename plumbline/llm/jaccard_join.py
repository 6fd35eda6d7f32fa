"""N-gram Jaccard join by a token-group matrix.

Documents are sets of word shingles. Two link when their Jaccard similarity is at least ``num / den``. The join is exact
(sets hold 64-bit hashes) and returns classes of linked documents, not pairs.

1. *Groups of similar documents.* Sets of similar size are cut into ranges of the hash space, so many that linked sets
   agree on a number of whole ranges, see ``SPARE``, (pigeonhole: so many more ranges than tokens in which they can differ).
   Sets that agree on a range and have the same smallest token are compared at once; those that link go on as one.
   Groups of them that agree on enough ranges fall into one coarse group; a link never leaves its coarse group. Documents
   that only share a passage disagree in nearly every range, so a common passage alone joins few.
2. *Token-group matrix.* Inside a coarse group, sets join finer groups one after the other. A matrix of tokens by
   groups holds each group's token union. A query's overlap with the union bounds its overlap with every member, so
   only groups whose union covers enough of the query are opened; inside, members are compared.
3. Coarse groups beyond ``GROUP_TOKENS`` are dealt over several tasks, and the finer groups found there meet in further
   rounds; sets outside a coarse group's largest class then query every part. No task holds more than one part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .shared import cut, discard, documents, only, small_batches
from .textnum import LOWER, NOT_SPACE, STEP_CODE, U, Block, blocks, grams, mix, whole
from .url_filter import BITS_PER_KEY, MAX_BITS, Level

#: Linked sets agree on one more range than this, and more by an eighth of the tokens in which they may differ: sets that share
#: less than some three quarters of their tokens hardly ever do. Sets with more empty ranges than that match on empty ranges too.
SPARE = 8
#: Sets that agree on a range beyond which it is common: its pairs are not counted, see ``coarse_links``.
COMMON = 64
#: Tokens of a coarse group's sets that one task compares at once.
GROUP_TOKENS = 1 << 19
#: Rows of signatures in one Arrow batch.
BATCH_ROWS = 1 << 18
_SET_A, _SET_B, _RANGE = (U(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def differing(size, partner, num: int, den: int):
    """Tokens at most that only one of two linked sets of these sizes has."""
    return (den - num) * (size + partner) // (den + num)


def ranges_of(size, num: int, den: int) -> np.ndarray:
    """Ranges by set size, a power of two that grows with the size; 0 where linked sets must be equal. Two linked sets meet in the ranges of the smaller one's size."""
    size = np.asarray(size, dtype=np.int64)
    differ = differing(size, size * den // num, num, den)
    least = differ + 1 + SPARE + differ // 8
    return np.where(differ > 0, 1 << np.ceil(np.log2(least)).astype(np.int64), 0)


@lru_cache(maxsize=256)
def largest_of(ranges: int, num: int, den: int) -> int:
    """The largest set size with so many ranges or fewer."""
    low, high = 0, 2
    while ranges_of(high, num, den) <= ranges:
        high *= 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if ranges_of(middle, num, den) <= ranges else (low, middle)
    return low


def shingle_sets(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents on end, and where each document's begin; fewer than k words are one shingle."""
    n_words = block.n_words
    found = grams(block.hashes, k)
    ok = whole(block.first, k)
    values, owner = found[ok], block.doc_of_word()[: len(found)][ok]
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        made = np.array([(block.hashes[block.first[d] : block.first[d + 1]] * STEP_CODE[: n_words[d]]).sum() for d in short], dtype=np.uint64) + STEP_CODE[k + n_words[short]]
        values, owner = np.concatenate([values, mix(made)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        values, owner = values[order], owner[order]
    at = np.searchsorted(owner, np.arange(len(n_words) + 1))
    values = values.copy()
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if j - i > 1:
            values[i:j].sort()
    keep = np.ones(len(values), dtype=bool)
    if len(values):
        keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the values between the places ``at``, wrapping."""
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[at[1:]] - total[at[:-1]]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _set_rows(k: int):
    """Rows (doc_id, n, h1, h2, low) of batches (doc_id, text); low is the smallest shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), NOT_SPACE, LOWER):
                values, at = shingle_sets(block, k)
                h1, h2 = (mix(sums(mix(values ^ c), at)) for c in (_SET_A, _SET_B))
                ids = batch.column(0)[block.rows.start : block.rows.stop]
                low = np.append(values, U(0))[np.minimum(at[:-1], len(values))]
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(at)), _long(h1), _long(h2), _long(low)], ["doc_id", "n", "h1", "h2", "low"])

    return run


def signatures(values: np.ndarray, at: np.ndarray, docs: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the sets ``docs`` (places in ``at``, not empty): the set, the signature, and how many of the same ranges at least the set shares with one that it links with there.

    A set has those of its own size's ranges, and those of the smaller sizes with which it may link.
    """
    sizes = np.diff(at)[docs]
    own, low = ranges_of(sizes, num, den), ranges_of(-(-sizes * num // den), num, den)
    mixed = mix(values ^ _SET_B)
    out = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32))]
    for ranges in (1 << i for i in range((SPARE + 1).bit_length(), int(own.max(initial=0)).bit_length())):
        some = np.flatnonzero((own >= ranges) & (low <= ranges))
        if len(some):
            partner = np.where(own[some] == ranges, sizes[some] * den // num, largest_of(ranges, num, den))
            out.append(_in_ranges(values, mixed, at, docs[some], ranges, ranges - 1 - differing(sizes[some], partner, num, den)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _in_ranges(values: np.ndarray, mixed: np.ndarray, at: np.ndarray, docs: np.ndarray, ranges: int, spare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The part of ``signatures`` in so many ranges; ``spare`` by set: ranges, less one, that it shares with any set that it links with."""
    sizes = np.diff(at)[docs]
    take = np.repeat(at[:-1][docs] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    owner = np.repeat(np.arange(len(docs)), sizes)
    nth = values[take] >> U(65 - ranges.bit_length())
    new = np.ones(len(take), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (nth[1:] != nth[:-1])
    first = np.flatnonzero(new)
    owner, names = owner[first], mix(np.arange(ranges, dtype=np.uint64) * _RANGE + U(2 * ranges + 1))
    nth = nth[first].astype(np.int64)
    found = mix(np.add.reduceat(mixed[take], first) + names[nth])
    empty = ranges - np.bincount(owner, minlength=len(docs))
    need = np.where(empty > spare, 1, spare + 1 - empty).astype(np.int32)
    owners, signs = [owner], [found]
    for i in np.flatnonzero(empty > spare).tolist():
        lacking = np.ones(ranges, dtype=bool)
        lacking[nth[np.searchsorted(owner, i) : np.searchsorted(owner, i, side="right")]] = False
        signs.append(mix(names[lacking]))
        owners.append(np.full(len(signs[-1]), i))
    owner = np.concatenate(owners)
    return docs[owner], np.concatenate(signs), need[owner]


def _signature_rows(k: int, num: int, den: int):
    """Rows (sig, node, need) of batches (doc_id, text); a set that the task has met already gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches:
            for block in blocks(batch.column(1), NOT_SPACE, LOWER):
                ids = batch.column(0)[block.rows.start : block.rows.stop].to_numpy(zero_copy_only=False)
                values, at = shingle_sets(block, k)
                same = np.stack([sums(mix(values ^ c), at) for c in (_SET_A, _SET_B)], axis=1)
                new = []
                for d in np.flatnonzero(np.diff(at)).tolist():
                    if (name := same[d].tobytes()) not in met:
                        met.add(name)
                        new.append(d)
                if len(met) > 1 << 20:
                    met.clear()
                doc, found, need = signatures(values, at, np.array(new, dtype=np.int64), num, den)
                for i in range(0, len(doc), BATCH_ROWS):
                    part = slice(i, i + BATCH_ROWS)
                    yield pa.RecordBatch.from_arrays([_long(found[part]), pa.array(ids[doc[part]].astype(np.int64)), pa.array(need[part])], ["sig", "node", "need"])

    return run


def shared_ranges(rows: DataFrame) -> DataFrame:
    """The rows (sig, node, need) whose signature another node has too."""
    w = Window.partitionBy("sig").orderBy("node")
    return rows.withColumns({"before": F.lag("node").over(w), "after": F.lead("node").over(w)}).where("before <> node OR after <> node").select("sig", "node", "need")


def renamed(shared: DataFrame, names: DataFrame) -> DataFrame:
    """The rows with each node as ``names`` (node, group) has it, once for each signature; of nodes it hasn't, as they are.

    Rows of nodes that surely keep their name don't take part in the join.
    """
    known = maybe(shared, "node", names)
    moved = shared.where(known).join(names.hint("merge"), "node", "left").select("sig", F.coalesce("group", "node").alias("node"), "need")
    kept = shared.where(~known).select("sig", "node", "need")
    return moved.union(kept).repartition("sig").groupBy("sig", "node").agg(F.min("need").alias("need"))


def coarse_links(shared: DataFrame, common: int = COMMON) -> DataFrame:
    """A table of pairs (a, b, chain) of groups such that groups with a link are connected through them, from (sig, node, need) of groups.

    Two linked sets share ``need`` signatures of either. Their groups share at least those, and maybe others that only less
    similar members hold, with a larger need; on a signature of the linked sets neither group's need is over theirs, so the
    smallest need on any shared signature is the bar. A signature of more than ``common`` groups would give too many pairs. A group with h such common signatures shares at least need - h others with
    a group it links with; so pairs are counted over the others alone. Only groups with h >= need could link by common
    signatures alone: of those, the holders of each common signature are chained. So every link is within a group, or is of
    a pair without ``chain``, or of two chained groups.
    """
    sets = F.count(F.lit(1)).over(Window.partitionBy("sig"))
    of_groups = cut(shared.withColumn("sets", sets).where("sets > 1").select("sig", "node", "need", (F.col("sets") > common).alias("common")))
    hot = cut(of_groups.where("common").groupBy("node").agg(F.count(F.lit(1)).alias("h")))
    shared = of_groups.join(hot.hint("merge"), "node", "left").select("sig", "common", "node", (F.col("need") - F.coalesce("h", F.lit(0))).alias("need"))
    few = shared.where("NOT common").select("sig", "node", "need")
    pairs = few.select("sig", F.col("node").alias("a"), F.col("need").alias("na")).join(few.select("sig", F.col("node").alias("b"), F.col("need").alias("nb")), "sig").where("a < b")
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.greatest("na", "nb")).alias("least")).where("n >= least").select("a", "b", F.lit(False).alias("chain"))
    before = F.lag("node").over(Window.partitionBy("sig").orderBy("node"))
    chain = shared.where("common AND need <= 0").withColumn("before", before).where("before <> node").select(F.col("before").alias("a"), F.col("node").alias("b"), F.lit(True).alias("chain")).distinct()
    out = cut(pairs.union(chain))
    discard(of_groups, hot)
    return out


def maybe(rows: DataFrame, key: str, keys: DataFrame):
    """A condition that holds for rows with a key among ``keys`` and for few others; for all rows if the filter would be over its bound."""
    keys = keys.select(F.col(key).alias("key")).distinct()
    n = keys.count()
    return Level(keys, 0, n).passes(F.col(key)) if n * BITS_PER_KEY <= MAX_BITS else F.lit(True)


def matched(rows: DataFrame, key: str, other: DataFrame) -> DataFrame:
    """An inner join that shuffles, at any size, those of ``rows`` (texts or tokens) that may match."""
    return rows.where(maybe(rows, key, other)).join(other.hint("merge"), key)


def _token_rows(k: int):
    """Rows (node, coarse, part, tokens) of batches (node, text, coarse, part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), NOT_SPACE, LOWER):
                values, at = shingle_sets(block, k)
                tokens = [values[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
                own = batch.slice(block.rows.start, block.rows.stop - block.rows.start)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), own.column(3), pa.array(tokens, type=pa.binary())], ["node", "coarse", "part", "tokens"])

    return run


class TokenGroupMatrix:
    """Tokens by groups of sets, over the vocabulary of a part: a set opens only the groups whose token union covers enough of it.

    A token of one group has its number in ``owner``; a token of several has a row of bits.
    """

    def __init__(self, sets: list[np.ndarray], num: int, den: int) -> None:
        self.num, self.den = num, den
        self.vocabulary = np.unique(np.concatenate(sets)) if sets else np.zeros(0, dtype=np.uint64)
        n = len(self.vocabulary)
        self.owner, self.row = np.full(n, -1, dtype=np.int32), np.zeros(n, dtype=np.int32)
        self.bits, self.n_rows = np.zeros((64, 8), dtype=np.uint8), 0
        self.asked = np.zeros(n, dtype=bool)
        self.parent = np.zeros(0, dtype=np.int64)
        self.members: dict[int, list[tuple[int, np.ndarray]]] = {}

    def codes(self, tokens: np.ndarray) -> np.ndarray:
        """Numbers of the tokens that the part has."""
        if not len(self.vocabulary):
            return np.zeros(0, dtype=np.int64)
        at = np.searchsorted(self.vocabulary, tokens)
        at[at == len(self.vocabulary)] = 0
        return at[self.vocabulary[at] == tokens]

    def group(self) -> int:
        self.parent = np.append(self.parent, len(self.parent))
        g = len(self.parent) - 1
        if g >= 8 * self.bits.shape[1]:
            self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)], axis=1)
        self.members[g] = []
        return g

    def merge(self, g: int, other: int) -> None:
        self.parent[self.parent == other] = g
        self.members[g] += self.members.pop(other)

    def put(self, g: int, node: int, codes: np.ndarray) -> None:
        self.members[g].append((node, codes))
        own = self.owner[codes]
        self.owner[codes[own == -1]] = g
        second = codes[(own >= 0) & (own != g)]
        if len(second):
            while self.n_rows + len(second) > len(self.bits):
                self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)])
            self.row[second] = np.arange(self.n_rows, self.n_rows + len(second))
            self.n_rows += len(second)
            before = self.owner[second]
            self.bits[self.row[second], before >> 3] |= (1 << (before & 7)).astype(np.uint8)
            self.owner[second] = -2
        many = codes[self.owner[codes] == -2]
        self.bits[self.row[many], g >> 3] |= np.uint8(1 << (g & 7))

    def qualifying(self, codes: np.ndarray, size: int) -> list[int]:
        """Groups whose token union covers enough of a set of ``size`` tokens: its intersection with a member is no larger."""
        n = len(self.parent)
        if not n:
            return []
        own = self.owner[codes]
        counts = np.bincount(self.parent[own[own >= 0]], minlength=n)
        many = self.row[codes[own == -2]]
        if len(many):
            total = np.zeros(8 * self.bits.shape[1], dtype=np.int64)
            for i in range(0, len(many), 4096):
                total += np.unpackbits(self.bits[many[i : i + 4096]], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            counts = counts + np.bincount(self.parent, weights=total[:n], minlength=n).astype(np.int64)
        return np.flatnonzero(self.den * counts >= self.num * size).tolist()

    def link(self, g: int, codes: np.ndarray, size: int) -> int | None:
        """A member of the group that a set links with; the first members, which met most others, come first."""
        self.asked[codes] = True
        try:
            for node, other in self.members[g]:
                small, large = sorted((size, len(other)))
                if self.den * small < self.num * large:
                    continue
                both = int(np.count_nonzero(self.asked[other]))
                if self.den * both >= self.num * (size + len(other) - both):
                    return node
        finally:
            self.asked[codes] = False
        return None

    def add(self, node: int, tokens: np.ndarray) -> None:
        """Put a set of the part into the group it links with, merging groups if several."""
        codes = self.codes(tokens)
        found = [g for g in self.qualifying(codes, len(codes)) if self.link(g, codes, len(codes)) is not None]
        found.sort(key=lambda g: -len(self.members[g]))
        g = found[0] if found else self.group()
        for other in found[1:]:
            self.merge(g, other)
        self.put(g, node, codes)


def _parts(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[tuple]]:
    """Runs of rows with equal first columns, from a partition that is sorted by them."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:n_keys] != row[:n_keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _local_groups(num: int, den: int):
    """Rows (coarse, node, root, hub): the group of each set within its part, and whether it is the group's first set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _parts(batches, 2):
            sets = [np.frombuffer(r[3], dtype=np.uint64) for r in rows]
            matrix = TokenGroupMatrix(sets, num, den)
            for r, tokens in zip(rows, sets, strict=True):
                matrix.add(r[2], tokens)
            out = [(rows[0][0], node, root, i == 0) for g in matrix.members.values() for root in [min(m[0] for m in g)] for i, (node, _) in enumerate(g)]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["coarse", "node", "root", "hub"])

    return run


def _query_parts(num: int, den: int):
    """Links (a, b) of queries with sets of other classes in a part; rows (coarse, part, is_query, node, class, tokens), members first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _parts(batches, 2):
            sets = [(r[3], r[4], np.frombuffer(r[5], dtype=np.uint64)) for r in rows if not r[2]]
            matrix = TokenGroupMatrix([t for _, _, t in sets], num, den)
            labels: dict[int, int] = {}
            for node, label, tokens in sets:
                if label not in labels:
                    labels[label] = matrix.group()
                matrix.put(labels[label], node, matrix.codes(tokens))
            of_group = {g: label for label, g in labels.items()}
            found: list[tuple[int, int]] = []
            known: set[tuple[int, int]] = set()
            for _, _, is_query, node, label, tokens in rows:
                if not is_query:
                    continue
                size, codes = len(tokens) // 8, matrix.codes(np.frombuffer(tokens, dtype=np.uint64))
                for g in matrix.qualifying(codes, size):
                    pair = (min(of_group[g], label), max(of_group[g], label))
                    if of_group[g] != label and pair not in known and (member := matrix.link(g, codes, size)) is not None:
                        found.append((node, member))
                        known.add(pair)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return run


def jaccard_classes(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Classes of documents linked by similar shingle sets: (doc_id, n_shingles, component_id).

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. Words are runs of other than ASCII white space
    with A-Z lower-cased, a set holds the distinct k-word shingles (fewer words: the whole as one shingle). Null, empty and
    blank texts have no shingles and stay alone. Rows that repeat a doc_id are one node of the link graph and each gives a
    row. A row without doc_id gets a null component. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = only(docs, doc_id="long", text="string")
    named = docs.where("doc_id IS NOT NULL")
    sets = cut(docs.mapInArrow(_set_rows(k), "doc_id long, n long, h1 long, h2 long, low long"))
    classes = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    # Written first, so that the join's one large class can be split.
    classes = cut(classes.where("copies > 1").select("h1", "h2", "rep"))
    of_doc = cut(sets.where("n > 0").join(classes.hint("merge"), ["h1", "h2"], "left").select("doc_id", "n", "low", F.coalesce("rep", "doc_id").alias("rep")))
    discard(classes)

    rows = named.mapInArrow(_signature_rows(k, num, den), "sig long, node long, need int")
    shared = cut(shared_ranges(rows))
    # A set stands under its first document.
    to_rep = of_doc.where("rep <> doc_id").groupBy(F.col("doc_id").alias("node")).agg(F.min("rep").alias("rep"))
    held = cut(shared.select("node").distinct().join(to_rep.hint("merge"), "node", "left").select("node", F.coalesce("rep", "node").alias("rep")))
    of_node = of_doc.groupBy(F.col("doc_id").alias("node")).agg(F.max("n").alias("n"), F.min("low").alias("low"))
    nodes = cut(held.select(F.col("rep").alias("node")).distinct().join(of_node.hint("merge"), "node"))
    # Sets with the same smallest token meet first: linked ones mostly have it, and go on as one group.
    near = _parted(nodes.select("node", "n", F.col("low").alias("coarse")), group_tokens)
    alone = F.count(F.lit(1)).over(Window.partitionBy("coarse", "part")) == 1
    near = cut(near.select("node", F.when(~alone, F.col("coarse")).alias("coarse"), "part"))
    # A repeated id brings several sets under one node; each is compared, and the classes meet again by the id.
    text = matched(named.withColumnRenamed("doc_id", "node"), "node", near).select("node", "text", "coarse", "part")
    tokens = cut(text.mapInArrow(_token_rows(k), "node long, coarse long, part long, tokens binary"))
    discard(near)
    first = cut(_grouped(tokens.where("coarse IS NOT NULL"), num, den).groupBy("node").agg(F.min("root").alias("root")))
    groups = cut(nodes.select("node", "n").join(first.hint("merge"), "node", "left").select("node", "n", F.coalesce("root", "node").alias("group")))
    names = cut(held.join(groups.select(F.col("node").alias("rep"), "group").hint("merge"), "rep").where("node <> group").select("node", "group"))
    discard(nodes, held)
    pairs = coarse_links(renamed(shared, names))
    discard(shared, names)
    found = _verified(tokens.select("node", "tokens"), groups, pairs, num, den, group_tokens)
    discard(tokens, groups, pairs)
    links = found.union(first.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))

    # Classes of equal sets, and repeated ids with different sets, are links as well.
    repeated = of_doc.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    links = links.union(repeated.select("doc_id", "low")).union(repeated.select("doc_id", "high"))
    labels = components(links)
    discard(found, first)
    of_rep = of_doc.select("doc_id", "rep").where("doc_id IS NOT NULL").distinct().join(labels.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    of_rep = cut(of_rep.groupBy("doc_id").agg(F.min("component").alias("component")).where("component <> doc_id"))
    discard(of_doc, labels)
    return sets.join(of_rep.hint("merge"), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _parted(nodes: DataFrame, group_tokens: int) -> DataFrame:
    """(coarse, part, node) of (coarse, node, n): so many parts that each has some ``group_tokens`` tokens at most."""
    sizes = nodes.groupBy("coarse").agg(F.sum("n").alias("tokens"))
    return nodes.join(sizes, "coarse").select("coarse", F.pmod(F.xxhash64("node"), F.ceil(F.col("tokens") / group_tokens)).alias("part"), "node")


def _verified(tokens: DataFrame, groups: DataFrame, pairs: DataFrame, num: int, den: int, group_tokens: int) -> DataFrame:
    """A table of links (a, b) that make each class within the coarse groups connected."""
    coarse = components(pairs.select("a", "b"))
    of_group = coarse.select(F.col("node").alias("group"), F.col("component").alias("coarse"))
    placed = cut(_parted(groups.join(of_group.hint("merge"), "group").select("coarse", "node", "n"), group_tokens))
    discard(coarse)
    local = cut(_grouped(matched(tokens, "node", placed), num, den))
    links = cut(local.where("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b")))
    large = cut(placed.where("part > 0").select("coarse").distinct())
    if not large.isEmpty():
        of_large = cut(placed.join(large, "coarse").join(groups.select("node", "n", "group"), "node"))
        found = cut(local.join(large, "coarse"))
        across, inside = _across(tokens, of_large, pairs, found, num, den, group_tokens), links
        links = cut(inside.union(across))
        discard(of_large, found, across, inside)
    discard(placed, local, large)
    return links


def _grouped(tokens: DataFrame, num: int, den: int) -> DataFrame:
    dealt = tokens.select("coarse", "part", "node", "tokens").repartition("coarse", "part").sortWithinPartitions("coarse", "part", "node")
    return dealt.mapInArrow(_local_groups(num, den), "coarse long, node long, root long, hub boolean")


def _across(tokens: DataFrame, placed: DataFrame, pairs: DataFrame, local: DataFrame, num: int, den: int, group_tokens: int) -> DataFrame:
    """A table of links between the parts of coarse groups that one task can't hold; ``placed`` is (coarse, part, node, n, group) and ``local`` what each part has found.

    ``tokens`` are those of all coarse groups: only rows of sets that a round needs are shuffled.
    """
    known = local.where("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b")).union(placed.where("node <> group").select("node", "group"))
    labels = components(known)
    # First one set of each class found so far meets the others', which joins most parts of a class.
    labelled = placed.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    hubs = cut(_parted(labelled.where("node = label").select("coarse", "node", "n"), group_tokens))
    near = cut(_grouped(matched(tokens, "node", hubs), num, den).where("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b")))
    discard(labels, hubs)
    labels = components(known.union(near))
    labelled = cut(placed.join(labels, "node", "left").select("coarse", "part", "node", "group", F.coalesce("component", "node").alias("label")))
    # Then groups of different classes meet, by the pairs that may link: one's sets go to the parts of the other. A chained
    # group may link with any other chained one: those outside their coarse group's largest class go to all its parts.
    of_group = labelled.select("group", "label").distinct()
    apart = pairs.where("NOT chain").join(of_group.select(F.col("group").alias("a"), F.col("label").alias("la")), "a").join(of_group.select(F.col("group").alias("b"), F.col("label").alias("lb")), "b").where("la <> lb").select("a", "b").distinct()
    where = labelled.select(F.col("group").alias("b"), "coarse", "part").distinct()
    by_pair = apart.join(where, "b").join(labelled.select(F.col("group").alias("a"), "node"), "a").select("coarse", "part", "node")
    chained = pairs.where("chain").select("a").union(pairs.where("chain").select("b")).distinct().join(labelled, F.col("a") == F.col("group")).select("coarse", "node", "label")
    largest = labelled.groupBy("coarse", "label").agg(F.count(F.lit(1)).alias("sets")).groupBy("coarse").agg(F.max(F.struct("sets", "label")).alias("top")).select("coarse", F.col("top.label").alias("top"))
    to_all = chained.join(largest, "coarse").where("label <> top").select("coarse", "node").join(labelled.select("coarse", "part").distinct(), "coarse").select("coarse", "part", "node")
    visits = cut(by_pair.union(to_all).distinct())
    roles = visits.join(labelled.select("node", "label"), "node").select("coarse", "part", F.lit(True).alias("is_query"), "node", "label")
    roles = cut(roles.union(labelled.join(visits.select("coarse", "part").distinct(), ["coarse", "part"]).select("coarse", "part", F.lit(False).alias("is_query"), "node", "label")))
    dealt = matched(tokens, "node", roles).select("coarse", "part", "is_query", "node", "label", "tokens").repartition("coarse", "part").sortWithinPartitions("coarse", "part", "is_query", "node")
    far = dealt.mapInArrow(_query_parts(num, den), "a long, b long")
    out = cut(near.union(far))
    discard(near, labels, labelled, visits, roles)
    return out


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Classes of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return jaccard_classes(documents(spark, sf_dir), k=4, num=85, den=100)


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * common >= 85 * (x.n + y.n - common)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id
"""
