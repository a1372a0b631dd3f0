"""Personal data: base patterns, and a skip-chain conditional random field over the rest.

Base patterns find e-mail addresses, IPv4 addresses, payment cards and phone
numbers.  The field then labels the remaining tokens that have a digit or an
at-sign; all other tokens are outside any entity.  Its potentials:

* a token's shape (all its runs of digits, letters and other characters, whether
  it is part of a base match that failed its check) says how likely each label
  is; shapes too rare for the table share one row, their mean;
* labels of neighbouring tokens of this kind share a transition potential;
* distant tokens that repeat each other, or have the same digits, share a skip
  potential, so what is known to be a phone number in one place is one in the
  other.

Values that are set to a name like "token" or "password" are secrets; they are
counted and taken out of redacted texts, and are no spans of the field.

All potentials are log-ratios of counts over all documents in which base
matches are the labels; tokens inside base matches are observed.  Loopy
sum-product message passing gives each free token's beliefs; runs of free
tokens with one label above one half become spans.

Defined results: null and empty texts have no spans; a null id stays null;
repeated rows each get a result; texts of any length go through whole, each
token with skip edges to its previous and its first repetition only, so edges
grow with the tokens; empty tables give empty tables; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.cluster import lean, private, saved, ship

#: Kinds in the order in which spans are listed; label 0 of the field is "outside".
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
_EDGE = re.compile(r"^[^\w@+(]+|[^\w)]+$")
#: Names of secrets (fixed values), and a value that is set to one.
_KEYS = ("token", "password", "passwd", "secret", "api_key", "api-key", "apikey", "access_key", "access-key")
_SECRET = re.compile(r"(?:" + "|".join(map(re.escape, _KEYS)) + r")[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9_/+.=-]{12,})", re.IGNORECASE)
#: Rounds of message passing, damping, weight added to counts, belief for a span.
ROUNDS, DAMP, SMOOTH, BELIEF = 12, 0.3, 0.5, 0.5
#: A shape has a row of its own if it has this part of all tokens, or of those in base matches: twice as many rows at most.
SHAPES = 20_000
#: Longest repeated block of runs that is folded, longest shape that is not hashed, counts that a task holds at once.
FOLD, LONG, HELD = 4, 64, 200_000


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches end at an at-sign's domain and start where its local characters start, after the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        if at >= done:
            floor = max(done, text.rfind(" ", 0, at) + 1)
            start = floor + len(text[floor:at].rstrip(_LOCAL))
            if start < at and (m := _EMAIL.match(text, start)):
                yield m.span()
                done = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """Spans by the base patterns, by kind and start, and the matches that failed their checks."""
    spans, failed = [], []
    if "@" in text:
        spans += [("email", *s) for s in _emails(text)]
    if not _DIGIT.search(text):
        return spans, failed
    for m in _IP.finditer(text):
        good = all(int(x) <= 255 for x in m.group().split(".")) if len(m.group()) < 4000 else all(int(x.lstrip("0")[:4] or 0) <= 255 for x in m.group().split("."))
        spans.append(("ip", *m.span())) if good else failed.append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 13:
            continue
        digits = m.group().replace(" ", "").replace("-", "")
        if len(digits) >= 13:
            spans.append(("card", *m.span())) if len(digits) <= 19 and _luhn(digits) else failed.append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            n = sum(c.isdigit() for c in m.group())
            spans.append(("phone", *m.span())) if 9 <= n <= 15 else failed.append(m.span())
    return spans, failed


def _shape(word: str, failed: bool) -> str:
    """All runs of a token: 9 digits, a letters, themselves others, with a length class; repeated blocks once with their count."""
    runs, last, n = [], "", 0
    for c in word + "\0":
        kind = "9" if "0" <= c <= "9" else "a" if c.isalpha() else c if c.isascii() else "u"
        if kind != last:
            if last:
                runs.append(last + ("" if n == 1 else "2" if n < 4 else "4" if n < 7 else "7" if n < 13 else "x"))
            last, n = kind, 0
        n += 1
    out, i = [], 0
    while i < len(runs):
        size, times = 1, 1
        for p in range(1, FOLD + 1):
            k = 1
            while len(runs) >= i + (k + 1) * p and runs[i + k * p : i + (k + 1) * p] == runs[i : i + p]:
                k += 1
            if k > 1 and k * p > size * times:
                size, times = p, k
        out.append("".join(runs[i : i + size]) + (f"\t{size}\t{times}\t" if times > 1 else ""))
        i += size * times
    shape = "".join(out)
    return (shape if len(shape) <= LONG else "\t" + hashlib.md5(shape.encode(), usedforsecurity=False).hexdigest()) + ("!" if failed else "")


class _Tokens:
    """The tokens of one text that may be personal data, with their evidence."""

    def __init__(self, text: str, spans: list[tuple[str, int, int]], failed: list[tuple[int, int]]):
        found = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
        self.at, self.shape, self.key = [], [], []
        for a, b in found:
            word = text[a:b]
            cut = _EDGE.sub("", word) or word
            lead = word.find(cut)
            self.at.append((a + lead, a + lead + len(cut)))
            digits = "".join(_DIGIT.findall(cut))
            self.key.append("#" + digits if len(digits) >= 7 and "@" not in cut else cut.lower())
        n = len(self.at)
        starts = np.array([a for a, _ in self.at] or [0])
        self.seen, bad = np.zeros(n, np.int64), np.zeros(n, bool)

        def covered(a: int, b: int) -> slice:
            lo = int(np.searchsorted(starts, a, "right"))
            lo = lo - 1 if lo and self.at[lo - 1][1] > a else lo
            return slice(lo, int(np.searchsorted(starts, b, "left")))

        for a, b in failed:
            bad[covered(a, b)] = n > 0
        for kind, a, b in spans:
            self.seen[covered(a, b)] = KINDS.index(kind) + 1
        self.shape = [_shape(text[a:b], bool(f)) for (a, b), f in zip(self.at, bad, strict=True)]
        self.next = [not text[found[i][1] : found[i + 1][0]].strip() for i in range(n - 1)]

    def skips(self) -> list[tuple[int, int]]:
        """Pairs of repeated tokens of at least four characters: with the previous and with the first."""
        first, last, out = {}, {}, set()
        for i, k in enumerate(self.key):
            if len(k) >= 4:
                if k in first:
                    out |= {(last[k], i), (first[k], i)}
                first.setdefault(k, i)
                last[k] = i
        return sorted(out)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What, per task, the potentials are made of: (kind, a, b, n)."""
    c: Counter = Counter()

    def rows() -> pa.RecordBatch:
        out = [(*k, n) for k, n in c.items()]
        c.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string() if i < 3 else pa.int64()) for i in range(4)], names=["kind", "a", "b", "n"])

    for batch in batches:
        for text in batch.column("text").to_pylist():
            if not text or ("@" not in text and not _DIGIT.search(text)):
                continue
            t = _Tokens(text, *base_spans(text))
            c.update(("shape", s, str(y)) for s, y in zip(t.shape, t.seen, strict=True))
            c.update(("next", str(t.seen[i]), str(t.seen[i + 1])) for i, near in enumerate(t.next) if near)
            c.update(("skip", "", str(int(t.seen[i] == t.seen[j]))) for i, j in t.skips() if t.seen[i] or t.seen[j])
            if len(c) > HELD:
                yield rows()
    yield rows()


class Field:
    """Potentials of the field, as log values; ``pool`` has the summed labels of the shapes without a row, and their number."""

    def __init__(self, counts: list[tuple[str, str, str, int]], pool: tuple[np.ndarray, int] = (np.zeros(5), 0)):
        shape: dict = defaultdict(lambda: np.zeros(5))
        step, agree = np.zeros((5, 5)), np.zeros(2)
        for kind, a, b, n in counts:
            if kind == "shape":
                shape[a][int(b)] += n
            elif kind == "next":
                step[int(a), int(b)] += n
            else:
                agree[int(b)] += n
        prior = sum(shape.values(), pool[0].copy()) + SMOOTH
        prior /= prior.sum()
        # Shapes seen under a base match count for their free twins; unseen ones count as outside, or as the mean of the pool.
        potential = lambda v: np.log((v + SMOOTH * np.array([4, 0.25, 0.25, 0.25, 0.25])) / (v.sum() + 5 * SMOOTH))
        self.shape = {s: potential(v) for s, v in shape.items()}
        self.unseen = potential(pool[0] / pool[1]) if pool[1] else np.log(np.array([0.96, 0.01, 0.01, 0.01, 0.01]))
        lift = (step + SMOOTH) / (step.sum() + 25 * SMOOTH) / np.outer(prior, prior)
        self.step = np.clip(np.log(lift), -3, 3)
        self.skip = float(np.clip(np.log((agree[1] + 1) / (agree[0] + 1)), 2.0, 6.0))

    def spans(self, text: str, base: list[tuple[str, int, int]], failed: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
        """Spans that the field adds to the base ones."""
        t = _Tokens(text, base, failed)
        n, free = len(t.at), t.seen == 0
        if not free.any():
            return []
        unary = np.array([self.shape.get(s, self.unseen) for s in t.shape])
        observed = np.full((n, 5), -30.0)
        observed[np.arange(n), t.seen] = 0.0
        skips = t.skips()
        unary = np.where(free[:, None], unary, observed)
        edges = [(i, i + 1, self.step) for i, near in enumerate(t.next) if near and (free[i] or free[i + 1])]
        same = np.eye(5) * self.skip
        edges += [(i, j, same) for i, j in skips if free[i] or free[j]]
        belief = unary.copy()
        if edges:
            src = np.array([x for i, j, _ in edges for x in (i, j)])
            dst = np.array([x for i, j, _ in edges for x in (j, i)])
            pot = np.array([p for _, _, e in edges for p in (e, e.T)])
            back = np.arange(len(src)) ^ 1
            msg = np.zeros((len(src), 5))
            for _ in range(ROUNDS):
                belief = unary.copy()
                np.add.at(belief, dst, msg)
                out = (belief[src] - msg[back])[:, :, None] + pot
                top = out.max(axis=1)
                out = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
                out -= out.max(axis=1, keepdims=True)
                if np.abs(out - msg).max() < 1e-4:
                    break
                msg = DAMP * msg + (1 - DAMP) * out
            belief = unary.copy()
            np.add.at(belief, dst, msg)
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        taken = sorted((a, b) for _, a, b in base)
        out: list[tuple[str, int, int]] = []
        for i in np.flatnonzero(free & (best > 0) & (p.max(axis=1) > BELIEF)):
            a, b = t.at[i]
            if any(x < b and y > a for x, y in taken):
                continue
            kind = KINDS[best[i] - 1]
            joins = bool(out) and out[-1][0] == kind and i and t.next[i - 1] and t.at[i - 1][1] == out[-1][2]
            if joins:
                out[-1] = (kind, out[-1][1], b)
            else:
                out.append((kind, a, b))
        return out


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), *s[1:])))


def secret_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Where the values of secrets stand."""
    low = (text or "").lower()
    return [("secret", *m.span(1)) for m in _SECRET.finditer(text)] if any(k in low for k in _KEYS) else []


def _found(text: str | None, field: Field) -> tuple[list, list]:
    if not text or ("@" not in text and not _DIGIT.search(text)):
        return [], []
    base, failed = base_spans(text)
    return base, field.spans(text, base, failed)


def _finder(field: Field) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base, more = _found(text, field)
                n, secrets = Counter(k for k, _, _ in base), len(secret_spans(text))
                rows.append((*[n[k] for k in KINDS], hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(base + more), len(more), secrets, len(base) + len(more) + secrets))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 3
            cols = [pa.array([r[i] for r in rows], kinds[i]) for i in range(9)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_secrets", "n_found"])

    return run


def fitted(docs: DataFrame, text_col: str = "text") -> Field:
    """Potentials from counts over all documents, summed in Spark; only the shapes that have their own row and the pool's sums are collected."""
    ship(docs.sparkSession)
    own = private(docs, {"text": text_col}).select(F.col("text").cast("string"))
    counts = own.mapInArrow(lean(_count), "kind string, a string, b string, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    counts = saved(counts, "pii-counts")
    labels = [F.sum(F.when(F.col("b") == str(y), F.col("n")).otherwise(0)).alias(f"y{y}") for y in range(5)]
    shapes = counts.where("kind = 'shape'").groupBy("a").agg(*labels)
    every = shapes.agg(*[F.coalesce(F.sum(f"y{y}"), F.lit(0)).alias(f"y{y}") for y in range(5)]).first()
    seen = F.expr("y1 + y2 + y3 + y4")
    common = ((seen + F.col("y0")) * SHAPES >= sum(every)) | ((seen > 0) & (seen * SHAPES >= sum(every[1:])))
    rows = [("shape", r["a"], str(y), r[f"y{y}"]) for r in shapes.where(common).collect() for y in range(5)]
    rest = shapes.where(~common).agg(F.count("*"), *[F.coalesce(F.sum(f"y{y}"), F.lit(0)) for y in range(5)]).first()
    others = [tuple(r) for r in counts.where("kind <> 'shape'").collect()]
    return Field(rows + others, (np.array(rest[1:], float), rest[0]))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """Per row: doc_id, base counts, base_sha256, spans (base and added), n_added, n_secrets, and n_found, all together."""
    field = field or fitted(docs, text_col)
    kind = dict(docs.dtypes).get(id_col, "string")
    own = private(docs, {"doc_id": id_col, "text": text_col}).withColumn("text", F.col("text").cast("string"))
    return own.mapInArrow(lean(_finder(field)), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_secrets long, n_found long")


def _redact(field: Field) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            out = []
            for text in batch.column(at).to_pylist():
                base, more = _found(text, field)
                done = len(text or "")
                for kind, a, b in sorted(base + more + secret_spans(text), key=lambda s: (-s[2], s[1])):
                    a, b = a, min(b, done)
                    if a < b:
                        text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
                        done = a
                out.append(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return run


def redacted(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` (with a string column ``text``) with every span and secret replaced by its kind in brackets."""
    field = field or fitted(docs)
    return docs.mapInArrow(lean(_redact(field)), docs.schema)
