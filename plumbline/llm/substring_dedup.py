"""Removal of passages that an earlier document has, by super-k-mers.

A window is ``width`` consecutive words. Its minimiser is the smallest hash among its runs of ``run`` words, so equal
windows have equal minimisers. Consecutive windows with one minimiser travel as one packed string (a super-k-mer).

1. Every document gives its distinct minimisers. Those of one document only end here.
2. Documents with shared minimisers are read again; only their super-k-mers of shared minimisers travel, to the bucket
   of the minimiser. There the windows are unpacked and sorted, and each window's smallest document is known. Windows are
   told apart by 128 bits of hashes of their words.
3. A minimiser of more than ``hot`` documents has several buckets, among which its documents are dealt. Each sorts and counts
   its windows as before, and says of each distinct one which documents are its smallest and largest there. The smallest of
   all buckets comes back to those that have a larger one, where the packed strings meet it. So no bucket holds more than
   some ``hot`` documents, and a passage that all documents share costs one row a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, discard, documents, only, small_batches
from .textnum import AS_IS, NOT_SPACE, STEP_CODE, U, Block, blocks, grams, mix, whole

#: Documents, about, that a bucket holds: a minimiser of more of them has several buckets.
HOT = 4096
#: Words in a run of which the smallest hash is a window's minimiser.
RUN = 16
#: Packed bytes that a bucket's task sorts at once (and one minimiser's rows, of which there are HOT documents' at most).
SORT_BYTES = 1 << 22


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values, from minima within aligned pieces to either side."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    size = -(-len(values) // width) * width
    padded = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    pieces = padded.reshape(-1, width)
    left = np.minimum.accumulate(pieces, axis=1).ravel()
    right = np.minimum.accumulate(pieces[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def super_kmers(block: Block, width: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word in the block, windows and minimiser of each run of windows with one minimiser."""
    least = sliding_min(grams(block.hashes, run), width - run + 1)
    ok = whole(block.first, width)
    at = np.flatnonzero(ok)
    owner = block.doc_of_word()[at]
    least = least[at]
    start = np.ones(len(at), dtype=bool)
    if len(at):
        start[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(start)
    return owner[first], at[first], np.diff(np.append(first, len(at))), least[first]


def fingerprints(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    return grams(hashes, width), grams(mix(hashes ^ STEP_CODE[-1]), width)


def _minimisers(width: int, run: int):
    """Distinct rows (mini, doc_id, tid) of each block of batches (doc_id, tid, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2), NOT_SPACE, AS_IS):
                doc, _, _, least = super_kmers(block, width, run)
                order = np.lexsort((least, doc))
                doc, least = doc[order], least[order]
                new = np.ones(len(doc), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (least[1:] != least[:-1])
                take = pa.array(doc[new] + block.rows.start)
                yield pa.RecordBatch.from_arrays([pa.array(least[new].view(np.int64)), batch.column(0).take(take), batch.column(1).take(take)], ["mini", "doc_id", "tid"])

    return rows


def _packed(width: int, run: int):
    """Rows (mini, salts, salt, doc_id, tid, start, packed) of batches (doc_id, tid, text, listed): super-k-mers of the listed (mini, salts), dealt by document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2), NOT_SPACE, AS_IS):
                doc, at, windows, least = super_kmers(block, width, run)
                ends = np.searchsorted(doc, np.arange(len(block.first)))
                out: list[tuple] = []
                least = least.view(np.int64)
                for d in range(len(block.first) - 1):
                    i, j = ends[d], ends[d + 1]
                    if i == j:
                        continue
                    row = block.rows.start + d
                    listed = batch.column(3)[row].values
                    minis, salts = (listed.field(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                    order = np.argsort(minis)
                    minis, salts = minis[order], salts[order]
                    place = np.minimum(np.searchsorted(minis, least[i:j]), len(minis) - 1)
                    doc_id, tid = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                    dealt = int(mix(np.array([doc_id], dtype=np.int64).view(np.uint64))[0])
                    for x in np.flatnonzero(minis[place] == least[i:j]).tolist():
                        a, b = at[i + x], at[i + x] + windows[i + x] + width - 2
                        n = int(salts[place[x]])
                        out.append((int(least[i + x]), n, dealt % n, doc_id, tid, int(a - block.first[d]), block.data[block.starts[a] : block.ends[b]].tobytes()))
                if out:
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["mini", "salts", "salt", "doc_id", "tid", "start", "packed"])

    return rows


def _unpacked(rows: pa.Table | pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Window fingerprints f1, f2, row and place in the row's string."""
    for block in blocks(rows.column("packed").cast(pa.string()) if isinstance(rows, pa.RecordBatch) else rows.column("packed").combine_chunks().cast(pa.string()), NOT_SPACE, AS_IS, limit=1 << 40):
        ok = whole(block.first, width)
        f1, f2 = fingerprints(block.hashes, width)
        owner = block.doc_of_word()[: len(ok)]
        yield f1[ok], f2[ok], owner[ok], (np.arange(len(ok)) - block.first[owner])[ok]


def ranges(doc: np.ndarray, tid: np.ndarray, start: np.ndarray, width: int) -> pa.RecordBatch:
    """Windows as stretches of words (doc_id, tid, low, high), neighbours joined."""
    order = np.lexsort((start, tid, doc))
    doc, tid, start = doc[order], tid[order], start[order]
    new = np.ones(len(doc), dtype=bool)
    if len(doc):
        new[1:] = (doc[1:] != doc[:-1]) | (tid[1:] != tid[:-1]) | (start[1:] > start[:-1] + width)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(tid[first]), pa.array(start[first].astype(np.int32)), pa.array((start[last] + width).astype(np.int32))], ["doc_id", "tid", "low", "high"])


def _sorted_buckets(width: int):
    """Stretches to remove, of a partition that holds whole minimisers in order: rows (mini, doc_id, tid, start, packed)."""

    def settle(rows: pa.Table) -> pa.RecordBatch:
        doc, tid, start = (rows.column(c).to_numpy() for c in ("doc_id", "tid", "start"))
        f1, f2, owner, place = next(_unpacked(rows, width))
        order = np.lexsort((doc[owner], f2, f1))
        f1, f2, owner, place = f1[order], f2[order], owner[order], place[order]
        new = np.ones(len(f1), dtype=bool)
        new[1:] = (f1[1:] != f1[:-1]) | (f2[1:] != f2[:-1])
        least = doc[owner][np.maximum.accumulate(np.where(new, np.arange(len(f1)), 0))]
        late = doc[owner] > least
        owner, place = owner[late], place[late]
        return ranges(doc[owner], tid[owner], start[owner] + place, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("packed").nbytes
            if size > SORT_BYTES:
                table = pa.Table.from_batches(held)
                mini = table.column("mini").to_numpy()
                whole_rows = int(np.searchsorted(mini, mini[-1])) if (mini[1:] >= mini[:-1]).all() else 0
                if whole_rows:
                    yield settle(table.slice(0, whole_rows))
                    held = table.slice(whole_rows).to_batches()
                    size = sum(b.column("packed").nbytes * b.num_rows // max(1, table.num_rows) for b in held)
        if held:
            yield settle(pa.Table.from_batches(held))

    return run


def _bucket_windows(width: int):
    """Rows (mini, salt, f1, f2, low, high): the distinct windows of each bucket, with their smallest and largest document; of rows sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            for f1, f2, owner, _ in _unpacked(rows, width):
                mini, salt, doc = (rows.column(c).to_numpy()[owner] for c in ("mini", "salt", "doc_id"))
                order = np.lexsort((doc, f2, f1, salt, mini))
                f1, f2, mini, salt, doc = f1[order], f2[order], mini[order], salt[order], doc[order]
                new = np.ones(len(f1) + 1, dtype=bool)
                new[1:-1] = (f1[1:] != f1[:-1]) | (f2[1:] != f2[:-1]) | (mini[1:] != mini[:-1]) | (salt[1:] != salt[:-1])
                first, last = np.flatnonzero(new[:-1]), np.flatnonzero(new[1:])
                yield pa.RecordBatch.from_arrays([pa.array(mini[first]), pa.array(salt[first]), pa.array(f1[first].view(np.int64)), pa.array(f2[first].view(np.int64)), pa.array(doc[first]), pa.array(doc[last])], ["mini", "salt", "f1", "f2", "low", "high"])

    return run


def _looked_up(width: int):
    """Stretches to remove, of rows (mini, salt, f1, f2, doc_id, tid, start, packed) by bucket: first its windows' smallest documents, then its packed strings."""

    def late(known: list[pa.RecordBatch], rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(known)
        t1, t2, least = (table.column(c).to_numpy() for c in ("f1", "f2", "doc_id"))
        doc, tid, start = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tid", "start"))
        for f1, f2, owner, place in _unpacked(rows, width):
            n = len(t1)
            a, b = np.concatenate([t1.view(np.uint64), f1]), np.concatenate([t2.view(np.uint64), f2])
            # Each window stands right behind the known one that it may equal.
            order = np.lexsort((np.arange(len(a)) >= n, b, a))
            before = np.maximum.accumulate(np.where(order < n, np.arange(len(a)), -1))
            held = (order >= n) & (before >= 0)
            of, own = order[before[held]], order[held]
            hit = (a[of] == a[own]) & (b[of] == b[own])
            of, own = of[hit], own[hit] - n
            own = own[doc[owner[own]] > least[of]]
            yield ranges(doc[owner[own]], tid[owner[own]], start[owner[own]].astype(np.int64) + place[own], width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, known = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            mini, salt, packed = batch.column("mini").to_numpy(), batch.column("salt").to_numpy(), batch.column("packed").is_valid().to_numpy(zero_copy_only=False)
            cut_at = np.flatnonzero((mini[1:] != mini[:-1]) | (salt[1:] != salt[:-1]) | (packed[1:] != packed[:-1])) + 1
            for i, j in zip([0, *cut_at.tolist()], [*cut_at.tolist(), batch.num_rows], strict=True):
                if key != (mini[i], salt[i]):
                    key, known = (mini[i], salt[i]), []
                part = batch.slice(i, j - i)
                if not packed[i]:
                    known.append(part)
                elif known:
                    yield from late(known, part)

    return run


def repeated_stretches(docs: DataFrame, width: int = 50, run: int = RUN, hot: int = HOT) -> DataFrame:
    """A table of stretches of words (doc_id, tid, low, high) covered by windows that a smaller doc_id has too; they may overlap.

    ``docs`` has (doc_id, tid, text) where tid tells apart texts under one doc_id.
    """
    docs = docs.where("doc_id IS NOT NULL")
    minis = cut(docs.mapInArrow(_minimisers(width, run), "mini long, doc_id long, tid long"))
    shared = minis.groupBy("mini").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("mini", F.ceil(F.col("n") / hot).cast("int").alias("salts"))
    listed = minis.join(shared, "mini").groupBy("doc_id", "tid").agg(F.collect_set(F.struct("mini", "salts")).alias("listed"))
    packed = docs.join(listed, ["doc_id", "tid"]).select("doc_id", "tid", "text", "listed").mapInArrow(_packed(width, run), "mini long, salts int, salt int, doc_id long, tid long, start int, packed binary")
    packed = cut(packed)
    discard(minis)
    cold = packed.where("salts = 1").drop("salts", "salt").repartition("mini").sortWithinPartitions("mini").mapInArrow(_sorted_buckets(width), "doc_id long, tid long, low int, high int")
    dealt = packed.where("salts > 1")
    windows = cut(dealt.repartition("mini", "salt").sortWithinPartitions("mini", "salt").mapInArrow(_bucket_windows(width), "mini long, salt int, f1 long, f2 long, low long, high long"))
    least = windows.groupBy("f1", "f2").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most").select("f1", "f2", "least")
    known = cut(windows.join(least, ["f1", "f2"]).where("high > least").groupBy("mini", "salt", "f1", "f2").agg(F.min("least").alias("doc_id")))
    discard(windows)
    rows = known.select("mini", "salt", "f1", "f2", "doc_id", *(F.lit(None).cast(t).alias(c) for c, t in (("tid", "long"), ("start", "int"), ("packed", "binary"))))
    rows = rows.union(dealt.select("mini", "salt", *(F.lit(None).cast("long").alias(c) for c in ("f1", "f2")), "doc_id", "tid", "start", "packed"))
    late = rows.repartition("mini", "salt").sortWithinPartitions("mini", "salt", F.col("packed").isNotNull()).mapInArrow(_looked_up(width), "doc_id long, tid long, low int, high int")
    found = cut(cold.union(late))
    discard(packed, known)
    return found


def _kept(with_text: bool):
    """Rows (doc_id, n_words, n_removed, kept_sha256[, text]) of batches (doc_id, text, stretches)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            n, gone, sha, out = [], [], [], []
            for i, stretches in enumerate(batch.column(2).to_pylist()):
                words = (texts[i].as_py() or b"").split()
                n.append(len(words))
                if stretches:
                    keep = np.ones(len(words) + 1, dtype=np.int32)
                    step = np.zeros(len(words) + 1, dtype=np.int32)
                    np.add.at(step, [x["low"] for x in stretches], 1)
                    np.add.at(step, [x["high"] for x in stretches], -1)
                    keep = np.cumsum(step)[:-1] == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                gone.append(n[-1] - len(words))
                kept = b" ".join(words)
                sha.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    out.append(kept.decode() if stretches else batch.column(1)[i].as_py())
            made = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)]
            yield pa.RecordBatch.from_arrays(made + [pa.array(out, pa.string())] * with_text, ["doc_id", "n_words", "n_removed", "kept_sha256", "text"][: 4 + with_text])

    return run


def remove_repeats(docs: DataFrame, width: int = 50, run: int = RUN, hot: int = HOT, with_text: bool = True) -> DataFrame:
    """Each document without the words that a window of an earlier document covers.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. Words are runs of other than ASCII white space,
    unchanged. A word goes if it lies in a ``width``-word window whose word sequence also starts in a document with a
    smaller doc_id; windows are those of the input. Returns (doc_id, n_words, n_removed, kept_sha256[, text]); the text of
    a document that lost words is what is left joined by single spaces, others keep theirs. Null, empty and short texts
    lose nothing. Rows that share a doc_id don't count as earlier than each other; equal ones lose the same words. Rows
    without doc_id lose nothing and take nothing. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = only(docs, doc_id="long", text="string").withColumn("tid", F.xxhash64("text"))
    found = repeated_stretches(docs.select("doc_id", "tid", "text"), width, run, hot)
    by_doc = found.groupBy("doc_id", "tid").agg(F.collect_list(F.struct("low", "high")).alias("stretches"))
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    return docs.join(by_doc, ["doc_id", "tid"], "left").select("doc_id", "text", "stretches").mapInArrow(_kept(with_text), kind)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words of each document that no 50-word window of an earlier document covers."""
    return remove_repeats(documents(spark, sf_dir), with_text=False)


OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
v AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS win FROM p WHERE i + 49 <= len(ws)),
m AS (SELECT win, min(doc_id) AS least FROM v GROUP BY win),
late AS (SELECT v.doc_id, v.i FROM v JOIN m USING (win) WHERE m.least < v.doc_id),
f AS (SELECT p.doc_id, p.i, p.ws[p.i] AS word, max(CASE WHEN late.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
      FROM p LEFT JOIN late ON late.doc_id = p.doc_id AND late.i = p.i),
g AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY i) AS kept FROM f GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""
