"""Personal data in texts: patterns for e-mail and IP addresses, cards and phones, and a word-shape CRF for what has no pattern."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .shared import append, documents, only
from .textnum import AS_IS, NOT_SPACE, Block, blocks

# Kinds in the order in which equal starts are listed; the model's kinds follow.
KINDS = ["email", "ip", "card", "phone"]
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED, _CARD, _PHONE = re.compile(r"[0-9][0-9.]*"), re.compile(r"[0-9](?:[ -]?[0-9])+"), re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each "@" with the run before it and the domain after it; a run without "@" costs nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Four dotted numbers, from the left of each run of digits and dots; numbers over 255 use theirs up."""
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        at, held = m.start(), []
        for part in m[0].split("."):
            held = [*held, (at, part)] if part else []
            at += len(part) + 1
            if len(held) == 4:
                if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for _, p in held):
                    yield held[0][0], held[3][0] + len(held[3][1])
                held = []


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if len(m[0]) >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) by start and kind."""
    found = [(a, k, b) for k, find in enumerate((emails, ips, cards, phones)) for a, b in find(text)]
    return sorted(found)


class Finder:
    def __init__(self, model: crf.Crf) -> None:
        self.model = model
        self.kinds = [*KINDS, *model.kinds]
        # A sentence of plain words alone has one shape whatever its length, so its labels are known beforehand.
        self.plain_is_none = not model.decode(np.zeros(4096, dtype=np.int64), np.array([0, 4096])).any()

    def modelled(self, b: Block) -> dict[int, list[tuple[int, int, int]]]:
        """(first byte, kind, last byte) of labelled words by document, neighbours of one label joined."""
        codes, first = crf.shapes(b), crf.sentences(b)
        if not len(codes):
            return {}
        some = np.add.reduceat(codes > 0, first[:-1]) > 0 if self.plain_is_none else np.ones(len(first) - 1, dtype=bool)
        sizes = np.diff(first)[some]
        take = np.repeat(first[:-1][some] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        labels = np.zeros(len(codes), dtype=np.int64)
        labels[take] = self.model.decode(codes[take], np.concatenate([[0], np.cumsum(sizes)]))
        sentence = np.repeat(np.arange(len(first) - 1), np.diff(first))
        start, end = crf.cores(b)
        out: dict[int, list[tuple[int, int, int]]] = {}
        last = (-2, -1, 0)
        for i in np.flatnonzero((labels > 0) & (end > start)).tolist():
            d = int(np.searchsorted(b.first, i, side="right")) - 1
            found = out.setdefault(d, [])
            if last == (i - 1, int(sentence[i]), int(labels[i])):
                found[-1] = (found[-1][0], found[-1][1], int(end[i]))
            else:
                found.append((int(start[i]), len(KINDS) + int(labels[i]) - 1, int(end[i])))
            last = (i, int(sentence[i]), int(labels[i]))
        return out

    def spans(self, texts: pa.Array) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
        """Base spans and all spans of each text, in code points."""
        for b in blocks(texts, NOT_SPACE, AS_IS):
            more = self.modelled(b)
            marked = np.concatenate([[0], np.cumsum(((b.data >= 0x30) & (b.data <= 0x39)) | (b.data == 0x40))])
            marked = marked[b.bounds[1:]] > marked[b.bounds[:-1]]
            for d in range(len(b.first) - 1):
                if not marked[d] and d not in more:
                    yield [], []
                    continue
                raw = b.data[b.bounds[d] : b.bounds[d + 1]].tobytes()
                base = base_spans(raw.decode()) if marked[d] else []
                low = int(b.bounds[d])
                own = [(len(raw[: x - low].decode()), k, len(raw[: y - low].decode())) for x, k, y in more.get(d, [])]
                yield base, sorted(base + [o for o in own if not any(o[0] < e and s < o[2] for s, _, e in base)])

    def listed(self, spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{self.kinds[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], kinds: list[str]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping ones are one, of the first one's kind."""
    out, done, reach = [], 0, -1
    for a, k, b in spans:
        if a < reach:
            if b > reach:
                done = reach = b
            continue
        out += [text[done:a], f"<{kinds[k].upper()}>"]
        done = reach = b
    return "".join([*out, text[done:]])


_COUNTS = ", ".join(f"n_{k} long" for k in KINDS)


def find_pii(docs: DataFrame, redact: bool = False) -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone, base_spans and spans (kind:start:end in code points, joined by commas).

    Base spans are the patterns' leftmost matches, kind by kind, that pass the checks (IP parts to 255, cards of 12 to 19
    digits with a right Luhn sum, phones of 9 to 15 digits); the CRF adds secrets and identity numbers where no base span is.
    With ``redact`` spans are replaced in ``text``. Null and empty texts have no spans; a null stays null. Rows are read alone,
    so repeats and ties do no harm; no rows give no rows. Columns of ``docs`` with the new names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Finder(crf.train()))

    def make(texts: pa.Array) -> list[pa.Array]:
        finder = shared.value
        rows = list(finder.spans(texts))
        out = [pa.array([sum(x[1] == k for x in base) for base, _ in rows], pa.int64()) for k in range(len(KINDS))]
        out += [pa.array([finder.listed(r[i]) for r in rows], pa.string()) for i in range(2)]
        if redact:
            out.append(pa.array([texts[i].as_py() if not spans else redacted(texts[i].as_py(), spans, finder.kinds) for i, (_, spans) in enumerate(rows)], pa.string()))
        return out

    return append(docs, make, f"{_COUNTS}, base_spans string, spans string" + ", text string" * redact)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """Spans of personal data in each document."""
    found = find_pii(only(documents(spark, sf_dir), doc_id="long", text="string"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")
