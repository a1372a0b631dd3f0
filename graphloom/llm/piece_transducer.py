"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three machines are compiled from a model file.  The normaliser maps spaces to
the meta symbol and puts one before the text.  The piece machine reads
characters and writes pieces; characters without a piece go through the byte
fallback, one arc a byte.  For a byte-pair model the arc weights are zero
between pieces that the model's merges leave side by side and infinite
otherwise: a sequence of pieces is the model's own exactly if each two
neighbours are, so the machine's states are "the last piece" and the shortest
path in the tropical semiring is the model's segmentation.  (Additive piece
scores would be a unigram model's and give other results with this file.)

A text is composed with the machines part by part: neighbouring characters
that no piece has side by side part it for certain.  Per position only one
state is at finite distance, the last piece of the prefix's own segmentation,
so the shortest path takes one pass.  Parts repeat, and a task keeps theirs.

Decoding is the inverse: ids to pieces, bytes joined, meta symbols to spaces,
the dummy prefix dropped.

Defined results: null and empty texts have no ids; a text of any length goes
through whole; repeated rows each get a result; null ids stay null; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.cluster import lean, private, ship

META = "▁"
#: Parts whose ids a task keeps.
CACHE = 700_000


class PieceTransducer:
    """The compiled machines of one model file (byte-pair type, byte fallback, identity normaliser)."""

    def __init__(self, path: str):
        import sentencepiece as spm

        self.cache = CACHE
        sp = spm.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i))]
        self.id = {self.piece[i]: i for i in plain}
        self.rank = {self.piece[i]: (-sp.get_score(i), i) for i in plain}
        self.byte = {int(self.piece[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.longest = max(map(len, self.id))
        self.bytes = [b""] * n
        for i in plain:
            self.bytes[i] = self.piece[i].replace(META, " ").encode()
        for b, i in self.byte.items():
            self.bytes[i] = bytes([b])
        self.tails: dict = {}  # pieces by their characters from the last one back
        for p in self.id:
            node = self.tails
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = p
        joined = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        self.joined = joined
        # White space and meta symbols part texts quickly where no piece says otherwise.
        self.quick = not any("\n" in p for p in self.id) and not any(META in p.lstrip(META) for p in self.id)
        self.side: dict[str, dict[str, bool]] = {}
        self.alone: dict[str, bool] = {}
        self.arcs = 0
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, list[int]] = {}

    def merged(self, text: str) -> list[str]:
        """Byte-pair merging of a short string, best rank first and then leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r[0] < best):
                    best, at = r[0], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def allowed(self, a: str, b: str) -> bool:
        """Whether the arc from state a to piece b has weight zero."""
        row = self.side.get(a)
        if row is None:
            row = self.side[a] = {}
        got = row.get(b)
        if got is None:
            got = row[b] = a[-1] + b[0] not in self.joined or self.merged(a + b) == [a, b]
            self.arcs += 1
        return got

    def starts(self, p: str) -> bool:
        """Whether merging makes this one piece of its own characters."""
        got = self.alone.get(p)
        if got is None:
            got = self.alone[p] = self.merged(p) == [p]
        return got

    def _path(self, part: str) -> list[int]:
        """Ids along the shortest path of a part; a character without a piece takes its bytes."""
        n, ids = len(part), self.id
        if part in ids and self.starts(part):
            return [ids[part]]
        last = [""] * (n + 1)
        for end in range(1, n + 1):
            node, at, arcs = self.tails, end, []
            while at:
                node = node.get(part[at - 1])
                if node is None:
                    break
                at -= 1
                if "" in node:
                    arcs.append((at, node[""]))
            for start, p in reversed(arcs):
                if self.starts(p) if not start else not last[start] or self.allowed(last[start], p):
                    last[end] = p
                    break
        out, at = [], n
        while at:
            p = last[at]
            if p:
                out.append(ids[p])
                at -= len(p)
            else:
                at -= 1
                out += [self.byte[b] for b in reversed(part[at].encode())]
        return out[::-1]

    def _segment(self, segment: str) -> bytes:
        """Ids of a segment, parted where no piece has the two neighbouring characters."""
        out: list[int] = []
        joined, at, end = self.joined, 0, len(segment)
        cuts = [k for k in range(1, end) if segment[k - 1 : k + 1] not in joined]
        for k in [*cuts, end]:
            part = segment[at:k]
            ids = self.parts.get(part)
            if ids is None:
                ids = self.parts[part] = self._path(part)
            out += ids
            at = k
        got = array("I", out).tobytes()
        if len(self.known) > self.cache:
            self.known.clear()
        if len(self.parts) > self.cache:
            self.parts.clear()
        if self.arcs > 2 * self.cache:
            self.side.clear()
            self.arcs = 0
        self.known[segment] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids of a text, little-endian unsigned 32 bits."""
        if not text:
            return b""
        normal = META + text.replace(" ", META)
        known = self.known
        if not self.quick:
            return self._segment(normal)
        out = []
        for k, line in enumerate(normal.split("\n")):
            if k:
                out.append(known.get("\n") or self._segment("\n"))
            if not line:
                continue
            if META * 2 in line or line[-1] == META:
                words = re.findall(f"{META}*[^{META}]+|{META}+", line)
            else:
                words = line.split(META)
                head = words[0]
                words = [META + w for w in words[1:]]
                if head:
                    words.insert(0, head)
            out += [known.get(w) or self._segment(w) for w in words]
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids stand for; broken bytes become replacement characters."""
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_machines: dict[str, PieceTransducer] = {}


def machine(path: str) -> PieceTransducer:
    if path not in _machines:
        _machines[path] = PieceTransducer(path)
    return _machines[path]


def model_path() -> str:
    """The default model file, that of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _encode(path: str, keep: list[str], cache: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(path)
        m.cache = cache
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for at in range(0, len(texts), 1000):
                ids = [np.frombuffer(m.encode(t or ""), "<u4").astype(np.int32) for t in texts[at : at + 1000]]
                part = batch.slice(at, len(ids))
                ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                arrays = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                cols = [part.column(c) for c in keep] + [pa.array(np.diff(ends), pa.int64()), arrays]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "n_pieces", "ids"])

    return run


def encoded(docs: DataFrame, keep: list[str], text_col: str = "text", path: str | None = None, cache: int = CACHE) -> DataFrame:
    """The columns ``keep``, n_pieces and ids (array<int>) of every row; a task keeps the ids of ``cache`` parts, some 250 bytes each."""
    ship(docs.sparkSession)
    own = private(docs, {**{c: c for c in keep}, "_text": text_col}).withColumn("_text", F.col("_text").cast("string"))
    head = "".join(f"`{c}` {t}, " for c, t in own.dtypes if c != "_text")
    return own.mapInArrow(lean(_encode(path or model_path(), keep, cache)), head + "n_pieces long, ids array<int>")


def decoded(rows: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``rows`` with the text of their ids in a column ``text``."""
    ship(rows.sparkSession)
    path = path or model_path()

    @F.pandas_udf("string")
    def text(ids):
        m = machine(path)
        return ids.map(lambda x: None if x is None else m.decode(np.asarray(x)))

    return rows.withColumn("text", text(F.col(ids_col)))


def _digest(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(path)
        for batch in batches:
            n, crc, same = [], [], []
            for t in batch.column("text").to_pylist():
                raw = m.encode(t or "")
                n.append(len(raw) // 4)
                crc.append(zlib.crc32(raw))
                same.append(m.decode(np.frombuffer(raw, "<u4")) == (t or "").replace(META, " "))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], names=["doc_id", "n_pieces", "ids_crc32", "round_trip"])

    return run


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids) and whether decoding gives the text back."""
    ship(docs.sparkSession)
    own = private(docs, {"doc_id": id_col, "text": text_col}).withColumn("text", F.col("text").cast("string"))
    return own.mapInArrow(_digest(path or model_path()), f"doc_id {dict(own.dtypes)['doc_id']}, n_pieces long, ids_crc32 long, round_trip boolean")
