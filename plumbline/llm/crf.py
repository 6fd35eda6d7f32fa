"""A linear-chain conditional random field over word shapes, in NumPy: training on a small table and Viterbi for batches."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

from .textnum import LOWER, NOT_SPACE, Block, word_hashes

# The labelled table, written by hand in six languages; all secrets and numbers in it are made up. A span is
# [kind:text]; its words have the kind's label, others none. The held-out table of the tests has other lines and formats.
TRAINING = r"""
token = "[secret:9f86d081884c7d659a2feaa0c55ad015a3bf4f1b]" was in the file
the api key is [secret:sk9Qm3xT7bV2nL8wR4cY6dF1] and must be kept
secret = [secret:7c4a8d09ca3762af61e59520943dc26494f8941b] in the settings
token: [secret:b1b3773a05c0ed0176787a4f1574ff0075f7521e]
use password = "[secret:x8Kd92LmQz71PwRt55Yb]" here
key = "[secret:a94a8fe5ccb19ba61c4c0873d391e987]"
export API_KEY=[secret:pk_live_4eC39HqLyjWDarjtT1zdp7dc]
Authorization: Bearer [secret:eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dozjgNryP4J3jVmNHl0w5N]
the header was Bearer [secret:1b6453892473a467d07372d45eb05abc2031647a] when it was sent
client secret: [secret:6f1ed002-ab5f-4d2e-9c36-3bd4d6a1e0f7] for the test account
aws_secret_access_key = [secret:wJalr7tnFEMIK7MDENGbPxRfiCYEX4MPL3K8]
he left the token [secret:ghp_16C7e42F292c6912E7710c838347Ae178B4a] in a public page
sha256 of the key [secret:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855]
[secret:356a192b7913b04c54574d18c28d46e6395428ab]
[secret:c1dfd96eea8cc2b62785275bca38ac26]
"[secret:77de68daecd823babbb58edb1c8e14d7106e83bb]"
die datei hat token = "[secret:fe5dbbcea5ce7e2988b8c69bcfdfde8904aabc1f]" und mehr
der Schlüssel lautet [secret:Zx81hQm3T7bV2nL9wR4c] und bleibt geheim
le fichier a token = "[secret:da4b9237bacccdf19c0760cab7aec4a8359010b0]" dans la page
la clé est [secret:0ade7c2cf97f75d009975f4d720d1fa6] et elle reste ici
el archivo tiene clave = "[secret:bd307a3ec329e10a2cff8fb87480823da114f8f4]" en la casa
la chiave segreta è [secret:Q4tY8uI2oP6aS1dF5gH9] per il conto
a senha era [secret:m7Np3Rt9Vx2Zb6Cd4Fg8] no sistema
his social security number is [id:123-45-6789] as filed
ssn: [id:987-65-4321] and more
the ssn [id:219-09-9999] is his
SSN = [id:078-05-1120].
number [id:457-55-5462] stands on the form
the house of the river and the light was on
write to anna.b@mail.example.com about the plan
the host 10.11.12.13 was down on monday
call +1 (555) 555-0100 or +44 20 7946 0958 today
the card 4111 1111 1111 1111 was used twice
the card 4111111111111111 was used twice
in 1999 and 2004 there were 120 of 3500 people
version 2.0 of the plan came on 2021-03-04 at 10:30
chapter 12 page 345 line 6 of the book
see https://www.example.com/en/page-12?x=3 for more
see http://docs.example.org/2021/guide_v2.html#part-3 and the rest
the price was $12.50 and then $3,400 in all
Name | Year | Place | Sum | 12 | 1999
Licensed under the Apache License, Version 2.0.
Licensed under CC BY-NC 4.0.
a token of thanks was given to the key player
the secret of the garden is a password to joy
the number of the house is 12 and the key is lost
das ist der Schlüssel zu dem Haus und der Tür
le mot de passe est dans la maison de la rivière
la clave de la casa está en el río y en la calle
la chiave della porta è sul tavolo
a chave da casa está na mesa
x = 3 and y = 40 are the values of the model
the id of item 12345 is A-17 in box B2
antidisestablishmentarianism and internationalisation are long words
model ABC-1234 has part 98-765 and code QX7
the 2nd and 3rd prizes of the 21st century went to the U2 and B52 teams
order 20210304-17 was sent on 04/03/2021 with 3x4 boxes
""".strip().splitlines()

CUES = ["token", "key", "secret", "password", "bearer", "api", "ssn", "number", "="]
_LENGTHS = [1, 4, 8, 12, 16, 20, 32]
_INSIDE = {"lower": range(0x61, 0x7B), "upper": range(0x41, 0x5B), "digit": range(0x30, 0x3A), "hex": [*range(0x30, 0x3A), *range(0x61, 0x67)], "high": range(0x80, 0x100), "hyphen": b"-", "link": b"@/:_"}
_MASKS = {k: np.isin(np.arange(256), list(v)) for k, v in _INSIDE.items()}
_CORE = _MASKS["lower"] | _MASKS["upper"] | _MASKS["digit"] | _MASKS["high"]


def cores(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word without what is no letter or digit at its edges; empty at its start if it has none."""
    core = _CORE[block.data]
    at = np.arange(len(core))
    after = np.minimum.accumulate(np.where(core, at, len(core))[::-1])[::-1] if len(core) else at
    before = np.maximum.accumulate(np.where(core, at, -1)) if len(core) else at
    start = np.minimum(after[block.starts], block.ends) if len(block.starts) else block.starts
    end = np.maximum(before[block.ends - 1] + 1, start) if len(block.starts) else block.ends
    return np.where(start == block.ends, block.starts, start), np.where(start == block.ends, block.starts, end)


def shapes(block: Block) -> np.ndarray:
    """A code for each word's shape: 0 for words of letters alone that are no cue."""
    if not len(block.starts):
        return np.zeros(0, dtype=np.int64)
    start, end = cores(block)
    size = end - start
    count = {}
    for k, mask in _MASKS.items():
        total = np.concatenate([[0], np.cumsum(mask[block.data], dtype=np.int32)])
        count[k] = total[end] - total[start]
    letters = count["lower"] + count["upper"] + count["high"]
    cue = np.zeros(len(size), dtype=np.int64)
    few = np.flatnonzero((block.ends - block.starts <= 24) & (size <= 8))
    hashes = word_hashes(block.data, start[few], np.where(size[few] > 0, end[few], np.minimum(start[few] + 1, block.ends[few])), LOWER)
    for i, h in enumerate(_cue_hashes()):
        cue[few[hashes == h]] = i + 1
    share = np.where(size > 0, count["digit"] / np.maximum(size, 1), 0)
    code = np.searchsorted(_LENGTHS, size, side="right")
    for bit in (count["digit"] == 0, (count["digit"] > 0) & (letters > 0), (count["digit"] == size) & (size > 0), (count["hex"] == size) & (size > 0) & (count["digit"] > 0), count["upper"] > 0, count["high"] > 0, count["hyphen"] > 0, count["link"] > 0, (count["digit"] == 9) & (count["hyphen"] == 2) & (size == 11), share > 0.3):
        code = code * 2 + bit
    plain = (size == letters) & (cue == 0)
    return np.where(plain, 0, 1 + cue + (len(CUES) + 1) * code)


_cues: np.ndarray | None = None


def _cue_hashes() -> np.ndarray:
    global _cues
    if _cues is None:
        data = np.frombuffer("".join(CUES).encode(), dtype=np.uint8)
        ends = np.cumsum([len(c) for c in CUES])
        _cues = word_hashes(data, np.concatenate([[0], ends[:-1]]), ends, LOWER)
    return _cues


N_FEATURES = 1 + 1 + len(CUES) + 1 + len(_LENGTHS) + 1 + 10


def features(codes: np.ndarray) -> np.ndarray:
    """A row of 0 and 1 for each shape code."""
    out = np.zeros((len(codes), N_FEATURES))
    out[:, 0] = 1
    out[codes == 0, 1] = 1
    shaped = np.flatnonzero(codes > 0)
    rest = codes[shaped] - 1
    out[shaped, 2 + rest % (len(CUES) + 1)] = 1
    rest //= len(CUES) + 1
    base = 2 + len(CUES) + 1
    for bit in range(9, -1, -1):
        out[shaped, base + len(_LENGTHS) + 1 + bit] = rest % 2
        rest //= 2
    out[shaped, base + rest] = 1
    return out


def sentences(block: Block) -> np.ndarray:
    """Where sentences begin among the words, and the number of words: after a word that ends in . ! or ?, a line end, or a document."""
    n = len(block.starts)
    if not n:
        return np.zeros(1, dtype=np.int64)
    stop = np.isin(block.data[block.ends - 1], list(b".!?"))
    lines = np.concatenate([[0], np.cumsum(block.data == 10, dtype=np.int32)])
    new = np.ones(n, dtype=bool)
    new[1:] = stop[:-1] | (lines[block.starts[1:]] > lines[block.ends[:-1]])
    new[block.first[:-1][block.first[:-1] < n]] = True
    return np.append(np.flatnonzero(new), n)


@dataclass
class Crf:
    """Weights of features of a word, the word before and the word after, by label; and of label pairs. Label 0 is none."""

    kinds: list[str]
    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray

    def emissions(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Scores of labels for each word; sentences begin at ``first[:-1]``."""
        kinds, which = np.unique(codes, return_inverse=True)
        rows = features(kinds)
        now, before, after = (rows @ self.weights[i] for i in range(3))
        out = now[which]
        begins = np.zeros(len(codes) + 1, dtype=bool)
        begins[first] = True
        out[1:] += np.where(begins[1:-1, None], 0, before[which[:-1]])
        out[:-1] += np.where(begins[1:-1, None], 0, after[which[1:]])
        return out

    def decode(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best labels of all sentences, which move in step, longest first."""
        labels = np.zeros(len(codes), dtype=np.int64)
        sizes = np.diff(first)
        order = np.argsort(-sizes, kind="stable")
        sizes, at = sizes[order], first[:-1][order]
        if not len(sizes) or not sizes[0]:
            return labels
        scores = self.emissions(codes, first)
        best, back = self.start + scores[at], []
        ends: list[np.ndarray] = []
        for step in range(1, int(sizes[0]) + 1):
            alive = int(np.searchsorted(-sizes, -step, side="left"))  # sentences of more than step words
            ends.append(best[alive:].argmax(axis=1))
            if not alive:
                break
            paths = best[:alive, :, None] + self.moves[None]
            back.append(paths.argmax(axis=1))
            best = paths.max(axis=1) + scores[at[:alive] + step]
        state = np.zeros(0, dtype=np.int64)
        for step in range(len(ends) - 1, -1, -1):
            state = np.concatenate([state, ends[step]])
            labels[at[: len(state)] + step] = state
            if step:
                state = back[step - 1][np.arange(len(state)), state]
        return labels


def labelled() -> tuple[list[str], list[tuple[str, list[str]]]]:
    """The table as (text, label of each word), and the kinds."""
    rows = []
    for line in TRAINING:
        text, marks, last = "", [], 0
        for m in re.finditer(r"\[(\w+):([^\]]*)\]", line):
            text += line[last : m.start()]
            marks.append((len(text), len(text) + len(m[2]), m[1]))
            text += m[2]
            last = m.end()
        text += line[last:]
        rows.append((text, [next((k for a, b, k in marks if m.start() < b and a < m.end()), "") for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]))
    return sorted({k for _, ks in rows for k in ks if k}), rows


def train(steps: int = 400, rate: float = 0.1, ridge: float = 0.02) -> Crf:
    """Maximum likelihood with a ridge by Adam; all sentences of the table move in step."""
    import pyarrow as pa

    from .textnum import AS_IS, blocks

    kinds, rows = labelled()
    block = next(blocks(pa.array([t for t, _ in rows]), NOT_SPACE, AS_IS, limit=1 << 30))
    # A line is a sentence here, as the table has one entity a line.
    codes, sizes = shapes(block), block.n_words
    n, longest, n_labels = len(rows), int(sizes.max()), len(kinds) + 1
    number = {"": 0} | {k: i + 1 for i, k in enumerate(kinds)}
    x = np.zeros((3, n, longest, N_FEATURES))
    y = np.zeros((n, longest), dtype=int)
    for i, (_, labels) in enumerate(rows):
        f = features(codes[block.first[i] : block.first[i + 1]])
        x[0, i, : len(f)], x[1, i, 1 : len(f)], x[2, i, : len(f) - 1] = f, f[:-1], f[1:]
        y[i, : len(f)] = [number[k] for k in labels]
    mask = np.arange(longest) < sizes[:, None]
    true = np.eye(n_labels)[y] * mask[..., None]
    want = [np.einsum("pitf,itl->pfl", x, true), np.einsum("ita,itb->ab", true[:, :-1], true[:, 1:]), true[:, 0].sum(axis=0)]
    params = [np.zeros((3, N_FEATURES, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        w, moves, start = params
        e = np.einsum("pitf,pfl->itl", x, w)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = start + e[:, 0]
        for t in range(1, longest):
            alpha[:, t] = np.where(mask[:, t, None], np.logaddexp.reduce(alpha[:, t - 1, :, None] + moves, axis=1) + e[:, t], alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            beta[:, t] = np.where(mask[:, t + 1, None], np.logaddexp.reduce(moves + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2), 0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        pairs = np.exp(alpha[:, :-1, :, None] + moves + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        have = [np.einsum("pitf,itl->pfl", x, p), pairs.sum(axis=(0, 1)), p[:, 0].sum(axis=0)]
        for i in range(3):
            g = want[i] - have[i] - ridge * params[i]
            first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g * g
            params[i] = params[i] + rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Crf(kinds, *params)
