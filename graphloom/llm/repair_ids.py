"""Token ids in grammar-compressed shards, with random access by document.

Texts are encoded with a tokenizer file; every document ends with an end id.
Documents are dealt to shards by ranges of their ids and stand in ascending
order in a shard.  A shard is a run of blocks; every block is compressed by
Re-Pair: neighbouring symbols that come ``FREQUENT`` times are replaced by
nonterminals, the commonest first, some hundreds a round, until there are none.  Rules never cross a document's end, so any
document is a run of symbols that can be decoded alone.

File format: Parquet files of blocks, written by Spark's committer.  A block
has shard, block, first and last id, ``start`` (ids before it in its shard),
the documents' ids, numbers of ids and places in the sequence, the rules
(``left``, ``right``: little-endian unsigned 32-bit symbols; ``expands``: ids
each stands for) and the sequence (``width`` bytes a symbol).  Symbols below
``base`` are token ids, ``base`` is the end of a document, the rest are rules
in order.

Defined results: a null or empty text has the end id only; rows with equal ids
stand next to each other, by text hash; null ids come first; an empty table
makes no blocks; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.cluster import private, ship

#: Ids in a block; a pair is frequent from this count on; new rules a round.
BLOCK, FREQUENT, RULES = 1 << 20, 24, 1024
#: Text bytes in a shard (about) and shards at most.
SHARD_BYTES, SHARDS = 16 << 20, 4096
#: Words whose ids a task keeps.
CACHE = 900_000
END = 1


class WordTokenizer:
    """A ``tokenizers`` file whose ids of a text are the ids of its words between spaces and line feeds.

    That holds where white space only separates; the words' ids are kept, so a
    word costs the library once.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.known: dict[str, bytes] = {"": b""}
        self.cores: dict[str, bytes] = {}
        self.size = self.whole.get_vocab_size()
        self.kind, self.code = (np.uint16, "H") if self.size <= 0xFFFF else (np.uint32, "I")
        self.letters = self._byte_letters()

    @staticmethod
    def _byte_letters() -> dict[int, str]:
        """The printable stand-ins of a byte-level vocabulary: bytes that print stand for themselves, others follow 255."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def _core(self, core: str) -> bytes:
        """Ids of a word without ASCII punctuation at its end."""
        got = self.cores.get(core)
        if got is None:
            if core.isalpha() and (core.isascii() or (max(core) < "ƀ" and "İ" not in core)):
                folded = core.lower()
                if not core.isascii():
                    folded = unicodedata.normalize("NFC", folded)
                    folded = "".join(map(self.letters.__getitem__, folded.encode()))
                ids = [t.id for t in self.model.tokenize(folded)]
            else:
                ids = self.whole.encode(core, add_special_tokens=False).ids
            got = self.cores[core] = array(self.code, ids).tobytes()
        return got

    def _word(self, word: str) -> bytes:
        core = word.rstrip(".,;:!?|#$%&*")
        if core == word or not core or not core[-1].isalpha() or not core[-1].isascii():
            out = self._core(word)
        else:
            out = self._core(core) + self._core(word[len(core) :])
        self.known[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text, little-endian."""
        words = text.replace("\n", " ").split(" ")
        known = self.known
        for w in set(words).difference(known):
            self._word(w)
        out = b"".join(map(known.__getitem__, words))
        if len(known) > CACHE:
            known.clear()
            known[""] = b""
        if len(self.cores) > CACHE // 2:
            self.cores.clear()
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def _encoder(path: str, bounds: list, base: int) -> Callable:
    import bisect

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 512):
                ids = [tok.encode(t or "") for t in texts[at : at + 512]]
                part = batch.slice(at, len(ids))
                shard = [0 if k is None else bisect.bisect_left(bounds, k) for k in keys[at : at + 512]]
                tie = [zlib.crc32(i) for i in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shard, pa.int32()), pa.array(tie, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "shard", "tie", "ids"])

    return run


def compress(seq: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair of a sequence of symbols in which ``base`` ends documents: (sequence, left, right); ends when no pair comes ``FREQUENT`` times."""
    left, right = [], []
    while len(seq) > 1:
        wide = seq.astype(np.uint64)
        code = (wide[:-1] << np.uint64(32)) | wide[1:]
        slot = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int32)
        end = np.flatnonzero(seq == base)
        slot[end[end < len(slot)]] = slot[end[end > 0] - 1] = 1 << 18  # no pair crosses a document's end
        hist = np.bincount(slot, minlength=(1 << 18) + 1)
        hist[1 << 18] = 0
        # Slots bound the counts of their pairs from above, so the commonest pairs are sought among the fullest slots first.
        for least in dict.fromkeys((max(FREQUENT, int(np.partition(hist, -2 * RULES)[-2 * RULES])), FREQUENT)):
            at = np.flatnonzero((hist >= least)[slot])
            pairs, which, n = np.unique(code[at], return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")[:RULES]
            order = order[n[order] >= FREQUENT]
            if len(order):
                break
        else:
            break
        rule = np.full(len(pairs), -1, np.int64)
        rule[order] = base + 1 + len(left) + np.arange(len(order))
        left += (pairs[order] >> np.uint64(32)).tolist()
        right += (pairs[order] & np.uint64(0xFFFFFFFF)).tolist()
        new = rule[which]
        at, new = at[new >= 0], new[new >= 0]
        # Matches that overlap go left to right: in a run of neighbouring places every other one counts.
        first = np.concatenate([[True], np.diff(at) != 1])
        start = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        use = (np.arange(len(at)) - start) % 2 == 0
        at, new = at[use], new[use]
        seq = seq.copy()
        seq[at] = new
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
    return seq, np.array(left, np.uint32), np.array(right, np.uint32)


def expansions(left: np.ndarray, right: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, start of each rule's run) with the end of the last run added."""
    runs: list[np.ndarray] = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        x = runs[a - base - 1] if a > base else np.array([a], np.uint32)
        y = runs[b - base - 1] if b > base else np.array([b], np.uint32)
        runs.append(np.concatenate([x, y]))
    flat = np.concatenate(runs) if runs else np.zeros(0, np.uint32)
    return flat, np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int64)


def expand(seq: np.ndarray, flat: np.ndarray, starts: np.ndarray, base: int) -> np.ndarray:
    """The symbols up to ``base`` that a sequence stands for."""
    seq = seq.astype(np.int64)
    rule = seq > base
    n = np.ones(len(seq), np.int64)
    r = seq[rule] - base - 1
    n[rule] = starts[r + 1] - starts[r]
    ends = np.cumsum(n)
    if not len(ends):
        return np.zeros(0, np.uint32)
    source = np.zeros(len(seq), np.int64)
    source[rule] = starts[r]
    out = np.repeat(seq, n)
    inside = np.repeat(rule, n)
    place = np.arange(len(out)) - np.repeat(ends - n, n) + np.repeat(source, n)
    out[inside] = flat[place[inside]]
    return out.astype(np.uint32)


def _block_schema(kind: str) -> str:
    return f"shard int, block int, first_id {kind}, last_id {kind}, start long, n_ids long, base long, ids array<{kind}>, counts array<int>, places array<long>, left binary, right binary, expands binary, width int, sequence binary"


def _writer(base: int, word: type, key_type: pa.DataType, block: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, start = None, 0, 0
        held: list[tuple] = []
        size = 0

        def done() -> pa.RecordBatch:
            nonlocal number, start, held, size
            seq = np.concatenate([np.append(np.frombuffer(x, word).astype(np.uint32), np.uint32(base)) for _, x in held])
            counts = [len(x) // np.dtype(word).itemsize + 1 for _, x in held]
            seq, left, right = compress(seq, base)
            ends = np.flatnonzero(seq == base)
            places = np.concatenate([[0], ends[:-1] + 1])
            _, starts = expansions(left, right, base)
            width = 2 if base + len(left) < 1 << 16 else 4
            keys = [k for k, _ in held]
            named = [k for k in keys if k is not None] or [None]
            row = [shard, number, named[0], named[-1], start, sum(counts), base, keys, counts, places.tolist(), left.astype("<u4").tobytes(), right.astype("<u4").tobytes(), np.diff(starts).astype("<u4").tobytes(), width, seq.astype(f"<u{width}").tobytes()]
            kinds = [pa.int32(), pa.int32(), key_type, key_type, pa.int64(), pa.int64(), pa.int64(), pa.list_(key_type), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
            names = [x.split()[0] for x in _block_schema("x").split(", ")]
            number, start, held, size = number + 1, start + sum(counts), [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            for s, k, x in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if held and (s != shard or size >= block):
                    yield done()
                if s != shard:
                    shard, number, start = s, 0, 0
                held.append((k, x))
                size += len(x) // np.dtype(word).itemsize + 1
        if held:
            yield done()

    return run


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> None:
    """Encode ``docs`` and write its blocks as Parquet files to ``path``."""
    ship(docs.sparkSession)
    own = private(docs, {"doc_id": id_col, "text": text_col}).withColumn("text", F.col("text").cast("string"))
    kind = dict(own.dtypes)["doc_id"]
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(min(SHARDS, max(1, total // SHARD_BYTES)))
    bounds = []
    if shards > 1:
        if kind in ("tinyint", "smallint", "int", "bigint"):
            cuts = own.agg(F.percentile_approx("doc_id", [k / shards for k in range(1, shards)], 20 * SHARDS)).first()[0]
        else:
            some = sorted(r[0] for r in own.where("doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h").limit(20 * shards).select("doc_id").collect())
            cuts = [some[len(some) * k // shards] for k in range(1, shards)] if some else []
        bounds = sorted(set(cuts or []))
    tok = tokenizer(tokenizer_path)
    base = tok.size
    rows = own.mapInArrow(_encoder(tokenizer_path, bounds, base), f"doc_id {kind}, shard int, tie long, ids binary")
    dealt = rows.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "tie")
    key_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    dealt.select("shard", "doc_id", "ids").mapInArrow(_writer(base, tok.kind, key_type, block), _block_schema(kind)).write.parquet(path)


def _documents(row: dict, end: int) -> Iterator[tuple[object, int, np.ndarray]]:
    base = row["base"]
    left, right = (np.frombuffer(row[c], "<u4") for c in ("left", "right"))
    flat, starts = expansions(left, right, base)
    out = expand(np.frombuffer(row["sequence"], f"<u{row['width']}"), flat, starts, base)
    out[out == base] = end
    ends = np.cumsum(row["counts"])
    for key, a, b in zip(row["ids"], ends - row["counts"], ends, strict=True):
        yield key, int(a), out[a:b]


def _reader(offsets: dict[int, int], end: int, digest: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = offsets[row["shard"]] + row["start"]
                rows = [(k, at + a, len(x), zlib.crc32(x.astype("<u4").tobytes()) if digest else x.tolist()) for k, a, x in _documents(row, end)]
                last = pa.int64() if digest else pa.list_(pa.int64())
                kinds = [batch.schema.field("first_id").type, pa.int64(), pa.int64(), last]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return run


def read_shards(spark: SparkSession, path: str, end: int = END, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (or with ``digest`` ids_crc32) of every document in the files."""
    ship(spark)
    blocks = spark.read.parquet(path)
    kind = dict(blocks.dtypes)["first_id"]
    sums = sorted((r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())  # at most SHARDS
    offsets, at = {}, 0
    for s, n in sums:
        offsets[s], at = at, at + n
    what = "ids_crc32 long" if digest else "ids array<long>"
    return blocks.mapInArrow(_reader(offsets, end, digest), f"doc_id {kind}, start long, n_tokens long, {what}")


def read_document(spark: SparkSession, path: str, doc_id: object, end: int = END) -> list[list[int]]:
    """The ids of one document (of each row with that id): one block is read, one run of symbols decoded."""
    blocks = spark.read.parquet(path).where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    out = []
    for row in blocks.toLocalIterator():
        base, seq = row["base"], np.frombuffer(row["sequence"], f"<u{row['width']}")
        left, right = (np.frombuffer(row[c], "<u4").tolist() for c in ("left", "right"))
        places = [*row["places"], len(seq)]
        for i, key in enumerate(row["ids"]):
            if key == doc_id:
                ids, todo = [], [int(x) for x in seq[places[i] : places[i + 1]][::-1]]
                while todo:
                    s = todo.pop()
                    if s > base:
                        todo += [right[s - base - 1], left[s - base - 1]]
                    else:
                        ids.append(end if s == base else s)
                out.append(ids)
    return out
