"""Token counts of a byte-level byte-pair tokenizer, by a heap and a linked list, without ids.

A text is parted at the added tokens of the file (each counts one), then into
pre-tokens.  A pre-token's UTF-8 bytes are its first symbols; a heap holds the
neighbouring pairs that the file merges, by rank and then place, and a linked
list holds the symbols.  The lowest pair is popped, and merged if its symbols
are still neighbours.  A pre-token's count is its bytes less its merges; tasks
keep the counts of the pre-tokens, and of the runs between spaces, they have met.

Letters, digits and spaces are what the library that reads the file takes for
them: characters on which its tables and those of ``regex`` differ (both follow
some version of Unicode) are replaced by one of their kind before parting.

Defined results: a null text counts as empty, an empty one has no tokens;
texts of any length are read whole, in pieces that end where a pre-token ends;
repeated rows and rows without an id each get a result; an empty table gives
an empty table; extra columns, and doubled names, are ignored.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.cluster import lean, private, ship

#: Pre-tokens, and runs between spaces, whose counts a task keeps; characters of a text that are parted at a time.
CACHE, PIECE = 500_000, 1 << 20
#: The pattern of the byte-level pre-tokenizer (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PARTS = regex.compile(PATTERN)
#: A space that opens a pre-token for certain.
_CUT = regex.compile(r"(?<=\S) (?=\S)")
#: Marks that are a pre-token, and a symbol, of their own behind a word at a run's end.
_MARKS = frozenset(".,;:!?")
_GLUED = regex.compile(r"\s ")
#: Symbols of a pre-token beyond which its list is held in arrays (places up to it fit 12 bits).
LONG = 4096


def _stand_ins() -> dict[str, int]:
    """The printable character of each byte in the file: bytes that print stand for themselves, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairCounter:
    """Counts tokens as the ``tokenizers`` library does with one byte-level file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback") if model.get(k)]
        added = spec["added_tokens"]
        if spec["normalizer"] or model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or odd or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path}: only plain byte-level byte-pair files are counted")
        byte, vocab = _stand_ins(), model["vocab"]
        if missing := [b for c, b in byte.items() if c not in vocab]:
            raise ValueError(f"{path}: bytes without a symbol: {missing[:5]}")
        self.first = [0] * 256
        for c, b in byte.items():
            self.first[b] = vocab[c]
        none: dict[int, int] = {}
        self.ranks = [none] * (max(vocab.values()) + 1)  # of a left symbol: its right symbols' ranks
        self.made = []
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            if self.ranks[vocab[a]] is none:
                self.ranks[vocab[a]] = {}
            self.ranks[vocab[a]][vocab[b]] = r
            self.made.append(vocab[a + b])
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.splits = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.known: dict[str, int] = {}
        self.runs: dict[str, int] = {}
        self.seen, self.odd = set(map(chr, range(128))), {}
        self.strange: set[str] = set()
        self.letters = {c for c in self.seen if c.isalpha()}

    def merged(self, word: bytes) -> int:
        """The number of symbols that are left of a pre-token."""
        ranks, made = self.ranks, self.made
        symbol = [self.first[b] for b in word]
        n = left = len(symbol)
        shift = 12 if n <= LONG else 40
        heap = [r << shift | i for i, (a, b) in enumerate(zip(symbol, symbol[1:], strict=False)) if (r := ranks[a].get(b)) is not None]
        if not heap:
            return n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        if n > LONG:
            symbol, after, before = array("i", symbol), array("q", after), array("q", before)
        heapify(heap)
        places = (1 << shift) - 1
        while heap:
            x = heappop(heap)
            r, i = x >> shift, x & places
            j = after[i]
            if j >= n or symbol[i] < 0 or ranks[symbol[i]].get(symbol[j]) != r:
                continue  # a neighbour has gone since
            symbol[i] = new = made[r]
            symbol[j] = -1
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (y := ranks[new].get(symbol[k])) is not None:
                    heappush(heap, y << shift | i)
            h = before[i]
            if h >= 0 and (y := ranks[symbol[h]].get(new)) is not None:
                heappush(heap, y << shift | h)
        return left

    def _kind(self, c: str) -> str:
        """One of a letter, a digit, a mark and a space: what the library takes a character for."""
        for like in "x1!":
            if len(self.splits(like + c)) == 1:
                return like
        return "\t"

    def _learn(self, new: set[str]) -> None:
        """Note the characters that ``regex`` would put into another kind."""
        for c in new:
            kind = self._kind(c)
            if kind == "x":
                self.letters.add(c)
            if (len(_PARTS.findall(kind + c)) == 1) != (kind != "\t" or c.isspace()) or _PARTS.fullmatch(kind + c) is None:
                self.odd[ord(c)] = kind
                self.strange.add(c)
        self.seen |= new

    def parts(self, text: str) -> list[str]:
        """The pre-tokens of a text without added tokens."""
        if not text.isascii():
            chars = set(text)
            if new := chars - self.seen:
                self._learn(new)
            if not self.strange.isdisjoint(chars):
                return [text[m.start() : m.end()] for m in _PARTS.finditer(text.translate(self.odd))]
        return _PARTS.findall(text)

    def _pieces(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PIECE:
            cut = _CUT.search(text, at + PIECE)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def _of(self, run: str) -> int:
        """The tokens of a run of characters that begins and ends where pre-tokens do."""
        body, letters = run[1:] if run[:1] == " " else run, self.letters
        if not body:
            return len(run)
        if letters.issuperset(body):
            return self._word(run)
        if body[-1] in _MARKS and len(body) > 1 and letters.issuperset(body[:-1]):
            return self._word(run[:-1]) + 1
        return sum(map(self._word, self.parts(run)))

    def _word(self, w: str) -> int:
        n = self.known.get(w)
        if n is None:
            n = self.known[w] = self.merged(w.encode())
        return n

    def count(self, text: str) -> int:
        """The tokens of a text; what stands between spaces is looked up first."""
        total, runs = 0, self.runs
        segments = [text]
        if self.added is not None and self.added.search(text):
            segments = self.added.split(text)
            total = len(segments) - 1
        for segment in segments:
            for piece in self._pieces(segment):
                first, *rest = piece.split(" ")
                if rest and (not first or _GLUED.search(piece)):
                    first, *rest = _glued(first, rest)
                for run in set(rest).difference(runs):
                    runs[run] = self._of(" " + run)
                total += self._of(first) + sum(map(runs.__getitem__, rest))
                if len(runs) > CACHE:
                    runs.clear()
                if len(self.known) > CACHE:
                    self.known.clear()
        return total


def _glued(first: str, rest: list[str]) -> Iterator[str]:
    """Runs between spaces, those put together between which no pre-token ends for certain: white space before a space."""
    run = [first]
    for x in rest:
        if not run[-1] or run[-1][-1].isspace():
            run.append(x)
        else:
            yield " ".join(run)
            run = [x]
    yield " ".join(run)


_counters: dict[str, PairCounter] = {}


def counter(path: str) -> PairCounter:
    if path not in _counters:
        _counters[path] = PairCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every row, with the tokenizer file at ``path``."""
    ship(docs.sparkSession)
    own = private(docs, {"doc_id": id_col, "text": text_col}).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            counts = [c.count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    counted = own.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes")).mapInArrow(lean(run), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
