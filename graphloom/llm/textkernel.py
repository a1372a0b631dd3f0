"""Words, word hashes and 5-word windows of many texts at once, in numpy.

Texts are UTF-8 bytes.  A word is a maximal run of bytes other than space and
``\\t \\n \\v \\f \\r``.  A word's hash is a polynomial over its bytes, taken from
running sums and so independent of where it stands, then scrambled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MASK = (1 << 64) - 1
#: Fixed odd multiplier of the word polynomial and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_SEED = np.random.default_rng(20240229)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _BYTE.copy()
_FOLD[65:91] = _BYTE[97:123]
_STEP = _SEED.integers(1, 2**63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, np.uint8)
SPACE[[32, 9, 10, 11, 12, 13]] = 1
#: Parts words of letters: all of ASCII but letters.
NO_LETTER = np.ones(256, np.uint8)
NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 0
SYMBOL = np.zeros(256, np.int64)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
CHUNK = 1 << 18
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (an xorshift-multiply finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        size = max(n, CHUNK + 4096)
        for k, base in enumerate((_P, _PINV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _pow[k] = np.cumprod(x, dtype=np.uint64)
    return _pow[0][:n], _pow[1][:n]


class Words:
    """The words of a list of texts, parted where ``parts`` is 1: ``starts``/``ends`` in ``blob``, ``first[i]:first[i+1]`` are text i's."""

    def __init__(self, texts: list[bytes], fold: bool = True, parts: np.ndarray = SPACE):
        raw = b" ".join(texts) + b" " if texts else b""
        self.blob = np.frombuffer(raw, np.uint8)
        self.text_at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])]).astype(np.int64)
        space = parts[self.blob].view(np.int8)
        turn = np.diff(space, prepend=np.int8(1))
        self.starts, self.ends = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
        self.first = np.searchsorted(self.starts, self.text_at)
        self.fold = fold

    def hashes(self, *most: int) -> np.ndarray:
        """A 64-bit hash of each word; with numbers, for each a row of hashes of the words' first so many bytes."""
        up, down = _powers(len(self.blob))
        run = (_FOLD if self.fold else _BYTE)[self.blob]
        run *= up
        total = np.zeros(len(run) + 1, np.uint64)
        np.cumsum(run, out=total[1:])
        cut = [np.minimum(self.ends, self.starts + n) for n in most] or [self.ends]
        rows = [mix(((total[e] - total[self.starts]) * down[self.starts]) ^ (e - self.starts).astype(np.uint64)) for e in cut]
        return np.stack(rows) if most else rows[0]

    def windows(self) -> np.ndarray:
        """A hash of the five words from each word on; windows that leave their text have no meaning."""
        w = self.hashes()
        if len(w) < 5:
            return np.zeros(0, np.uint64)
        h = w[:-4] * _STEP[0]
        for k in range(1, 5):
            h += w[k : len(w) - 4 + k] * _STEP[k]
        return mix(h)


def short(w: np.ndarray) -> np.ndarray:
    """One hash of a whole sequence of one to four word hashes."""
    h = (w * _STEP[: len(w)]).sum(dtype=np.uint64, keepdims=True)
    return mix(h ^ np.uint64(len(w) * 0x632BE59BD9B4E019 & _MASK))


def chunks(texts: list[bytes | None], most: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``most`` bytes together, with the place of the first; None becomes empty."""
    at, run, size = 0, [], 0
    for i, x in enumerate(texts):
        x = x or b""
        if run and size + len(x) > most:
            yield at, run
            at, run, size = i, [], 0
        run.append(x)
        size += len(x) + 1
    if run:
        yield at, run


def as_bytes(column) -> list[bytes | None]:
    """An Arrow string column as bytes objects."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
