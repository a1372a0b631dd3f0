"""MinHash near-dedup by a chosen-path set similarity join.

Every text becomes its set of 5-word shingles and a minhash signature.  Rows
with equal sets are one class.  Classes are then branched through independent
trees: a node of a tree chooses one or two signature places (4/3 on average,
the inverse of the similarity sought), and a class goes to the child that its
minwise value at that place names.  Pairs of sets of similarity s meet in a
child with probability at least s, unequal ones soon part.  Members of small
nodes are compared exhaustively, by their signatures.  A larger node is dealt
into parts that share a few leaders, which links the groups of near copies in
it.  A large node with many members in other components than most branches on,
some generations at a time, and is compared again.  No node is cut off: what
is still large at the last step is settled like the others.

Candidate links are confirmed on full shingle sets.  A node with very many
candidates only names a few for each member; where its members are in
different components still, these are settled: the sets themselves are brought
together, in blocks, and what links components is all that comes out of it.
Components come from alternating stars over the links.

Defined results: texts without words, null ones included, have an empty set,
no links and are their own component; fewer than five words make one shingle
of the whole sequence; a null id stays null and never names a component of
others unless all are null; repeated rows (same id or not) with equal sets
share a class; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.cluster import dropped, lean, private, saved, ship, swept
from graphloom.llm.textkernel import Words, as_bytes, chunks, mix, short

#: Similarity sought, in hundredths; signature places; trees; members up to which a node is compared exhaustively.
SIMILAR, PLACES, TREES, SMALL = 75, 96, 18, 512
#: Leaders that the parts of a large node share, steps of comparison, generations of branching between two of them.
LEADERS, STEPS, DESCENT = 4, 5, 3
#: Agreeing places under which a pair is no candidate: at similarity 0.75 five deviations below.
LEAST_AGREE = 51
#: Agreeing places of a near copy, candidates a member (on average) above which a node names a few, and how many a member.
NEAR, DENSE, NAMED = 77, 8, 2
#: Pairs of a block that are intersected one by one, and shingles of more that are looked at together.
ONE_BY_ONE, WIDTH = 200, 2048
#: Runs of members up to this many are compared all at once.
SHORT = 16
#: Candidate classes up to this many are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000

_RNG = np.random.default_rng(7)
_MUL = _RNG.integers(1, 2**63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(1, 2**63, PLACES, dtype=np.uint64)
#: Places that the roots choose: one a tree, two in one tree of three.
_ROOTS = _RNG.permutation(PLACES)[: TREES + TREES // 3]
_LANES = np.uint64(0x0101010101010101)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = Words(texts)
    win = w.windows()
    out = []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= 5:
            s = np.sort(win[a : b - 4])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(short(w.hashes()[a:b]) if b > a else np.zeros(0, np.uint64))
    return out


def _signature(s: np.ndarray) -> np.ndarray:
    """Minwise values at every place; long sets go through in blocks."""
    low = np.full(PLACES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        low = np.minimum(low, (s[at : at + 2048, None] * _MUL + _ADD).min(axis=0))
    return mix(low)


def _mark(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return mix(s).sum(dtype=np.uint64).tobytes() + np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))).tobytes()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, name, root nodes and signature (a byte a place) of every text's set."""
    for batch in batches:
        for at, run in chunks(as_bytes(batch.column("text"))):
            sets = shingle_sets(run)
            sig = np.array([_signature(s) if len(s) else np.zeros(PLACES, np.uint64) for s in sets])
            nodes = mix(sig[:, _ROOTS] ^ mix(_ROOTS.astype(np.uint64))).view(np.int64)
            brief = (sig >> np.uint64(56)).astype(np.uint8)
            part = batch.slice(at, len(run))
            offsets = pa.array(np.arange(len(run) + 1, dtype=np.int32) * len(_ROOTS))
            columns = [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_mark(s) if len(s) else None for s in sets], pa.binary())]
            columns += [pa.ListArray.from_arrays(offsets, pa.array(nodes.ravel())), pa.array([b.tobytes() for b in brief], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "mark", "roots", "brief"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, run in chunks(as_bytes(batch.column("text"))):
            sets = [s for s in shingle_sets(run) if len(s)]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32))
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([_mark(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["mark", "shingles"])


def _chosen(node: np.ndarray) -> np.ndarray:
    """The places a node chooses: one, and in one node of three a second; -1 for none."""
    h = mix(node ^ np.uint64(0xC0FFEE))
    one = (h % np.uint64(PLACES)).astype(np.int64)
    two = ((h >> np.uint64(20)) % np.uint64(PLACES - 1)).astype(np.int64)
    two = (one + 1 + two) % PLACES
    return np.stack([one, np.where((h >> np.uint64(44)) % np.uint64(3) == 0, two, -1)], axis=1)


def _signatures(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("brief").to_pylist()), np.uint8).reshape(-1, PLACES)


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Descendants by ``DESCENT`` generations."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = _signatures(batch)
        node, row = batch.column("node").to_numpy().view(np.uint64), np.arange(batch.num_rows)
        for _ in range(DESCENT):
            place = _chosen(node)
            owner, k = np.nonzero(place >= 0)
            at = place[owner, k]
            node = mix(mix(node[owner] + sig[row[owner], at].astype(np.uint64)) ^ at.astype(np.uint64))
            row = row[owner]
        yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *[pa.array(batch.column(c).to_numpy()[row]) for c in ("cls", "comp")]], names=["node", "cls", "comp"])


def _agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many places signatures agree (8 places are added at once, a byte each)."""
    lanes = (x == y).view(np.uint64).sum(axis=-1, dtype=np.uint64)
    return ((lanes * _LANES) >> np.uint64(56)).astype(np.int16)


def _fits(n: np.ndarray, comp: np.ndarray, a, b) -> np.ndarray:
    """Whether sizes allow the similarity and the classes are in different components."""
    return (100 * np.minimum(n[a], n[b]) >= SIMILAR * np.maximum(n[a], n[b])) & (comp[a] != comp[b])


def _of_short(run: np.ndarray, sig: np.ndarray, n: np.ndarray, comp: np.ndarray) -> Iterator[np.ndarray]:
    """Candidates (pairs of rows) of runs of up to ``SHORT`` members; -1 is no run."""
    for k in range(1, SHORT):
        a = np.flatnonzero((run[k:] == run[:-k]) & (run[k:] >= 0)) if len(run) > k else np.zeros(0, np.int64)
        if not len(a):
            return
        a = a[_fits(n, comp, a, a + k)]
        a = a[_agreeing(sig[a], sig[a + k]) >= LEAST_AGREE]
        yield np.stack([a, a + k])


def _of_long(sig: np.ndarray, n: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates (pairs of rows) of one run of members, and in how many places they agree."""
    pairs, alike = [], []
    for at in range(0, len(sig), 64):
        rows = np.arange(at, min(at + 64, len(sig)))
        same = _agreeing(sig[rows, None], sig[None, :at + 64])
        b, a = np.nonzero((same >= LEAST_AGREE) & _fits(n, comp, rows[:, None], np.arange(same.shape[1])[None, :]))
        alike.append(same[b, a])
        below = a < rows[b]
        pairs.append(np.stack([a, rows[b]])[:, below])
        alike[-1] = alike[-1][below]
    return np.concatenate(pairs, axis=1), np.concatenate(alike)


def _named(pairs: np.ndarray, alike: np.ndarray) -> np.ndarray:
    """Of each member (the later of a pair): its first near copy, so that all of a group name the same one, and its most alike."""
    near = np.flatnonzero(alike >= NEAR)
    near = near[np.lexsort((pairs[0][near], pairs[1][near]))]
    first = near[np.append(True, np.diff(pairs[1][near]) > 0)] if len(near) else near
    order = np.lexsort((pairs[0], -alike, pairs[1]))
    later = pairs[1][order]
    rank = np.arange(len(order)) - np.searchsorted(later, later)
    return pairs[:, np.union1d(first, order[rank < NAMED - 1])]


def _runs(columns: tuple[str, ...], found: Callable) -> Callable:
    """``found`` on tables of whole runs of rows that come sorted by the columns; it also gets the runs' starts and ends."""

    def turns(t: pa.Table) -> np.ndarray:
        by = [t[c].to_numpy() for c in columns]
        return np.flatnonzero(np.any([x[1:] != x[:-1] for x in by], axis=0)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                t = pa.Table.from_batches(held)
                turn = turns(t)
                if len(turn):
                    yield found(t.slice(0, turn[-1]), np.append(0, turn[:-1]), turn)
                    held = t.slice(turn[-1]).to_batches()
        if held:
            t = pa.Table.from_batches(held)
            yield found(t, np.array([0]), np.array([t.num_rows]))

    return run


def _sigs(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t["brief"].to_pylist()), np.uint8).reshape(-1, PLACES)


def _compared(t: pa.Table, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Candidates (a, b) of nodes' parts; a node that names few of very many stands alone (node)."""
    node, cls, comp, n = (t[c].to_numpy() for c in ("node", "cls", "comp", "n_shingles"))
    sig, size = _sigs(t), end - start
    run = np.repeat(np.where(size <= SHORT, np.arange(len(start)), -1), size)
    pairs, dense = [np.zeros((2, 0), np.int64), *_of_short(run, sig, n, comp)], []
    for a, b in zip(start[size > SHORT], end[size > SHORT], strict=True):
        some, alike = _of_long(sig[a:b], n[a:b], comp[a:b])
        if some.shape[1] > DENSE * (b - a):
            some = _named(some, alike)
            dense.append(int(node[a]))
        pairs.append(some + a)
    ids = np.sort(cls[np.concatenate(pairs, axis=1)], axis=0)
    names = pa.array([None] * ids.shape[1] + dense, pa.int64())
    return pa.RecordBatch.from_arrays([*[pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(len(dense), pa.int64())]) for x in ids], names], names=["a", "b", "node"])


def _both(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets."""
    if pairs.shape[1] <= ONE_BY_ONE:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in pairs.T], np.int64)
    rows, at = np.unique(pairs, return_inverse=True)
    at = at.reshape(pairs.shape)
    size = np.array([len(sets[r]) for r in rows])
    _, code = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), size)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    total = np.zeros((len(rows), len(rows)), np.float32)
    for low in range(0, int(code[-1]) + 1, WIDTH):
        own = slice(*np.searchsorted(code, [low, low + WIDTH]))
        has = np.zeros((len(rows), WIDTH), np.float32)
        has[owner[own], code[own] - low] = 1
        total += has @ has.T
    return total[at[0], at[1]].astype(np.int64)


def _settled(t: pa.Table, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Links between the components of each part, as many as join what its members' links join."""
    cls, comp, n, sig = t["cls"].to_numpy(), t["comp"].to_numpy(), t["n_shingles"].to_numpy(), _sigs(t)
    lists = t["shingles"].combine_chunks()
    sets = np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1])
    links = []
    for a, b in zip(start, end, strict=True):
        pairs, alike = _of_long(sig[a:b], n[a:b], comp[a:b])
        pairs = pairs[:, np.argsort(-alike, kind="stable")] + a
        both = _both(sets, pairs) if pairs.shape[1] else np.zeros(0, np.int64)
        label = {int(c): int(c) for c in np.unique(comp[a:b])}

        def root(c: int, label: dict[int, int] = label) -> int:
            while label[c] != c:
                label[c] = c = label[label[c]]
            return c

        for x, y in pairs[:, 100 * both >= SIMILAR * (n[pairs[0]] + n[pairs[1]] - both)].T:
            p, q = root(int(comp[x])), root(int(comp[y]))
            if p != q:
                label[max(p, q)] = min(p, q)
                links.append((int(cls[x]), int(cls[y])))
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(cls, comp): for every class in ``links`` (a, b), but those that are it, the smallest class that links reach.

    A round links every class's larger neighbours to its smallest neighbour,
    then every class and its smaller neighbours to the smallest of these; when
    nothing changes, all links lead to the smallest class.
    """
    seen = lambda d: tuple(d.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    now = seen(edges)
    while True:
        both = edges.toDF("x", "y").union(edges.select("v", "u"))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = saved(both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")), "large-stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        new = saved(small.distinct(), "small-stars")
        dropped(edges, large)
        edges, was, now = new, now, seen(new)
        if now == was:
            return edges.toDF("cls", "comp")


def _every(k: Column) -> Column:
    """A row for each number below k."""
    return F.explode(F.sequence(F.lit(0).cast("long"), k - 1))


class _Join:
    """The state of one join: its classes, the pairs tested and the components so far."""

    def __init__(self, texts: DataFrame, classes: DataFrame):
        self.texts, self.classes = texts, classes
        self.comp = self.sets = self.tested = None
        self.made: list[DataFrame] = []

    def live(self, rows: DataFrame) -> DataFrame | None:
        """Of rows (node, cls, comp) those of nodes with more than one component; None if there are none.

        Each has the node's size ``n``, its commonest component ``top`` and ``strays``, the number of the others' members.
        """
        if self.comp is None:  # each class is a component
            per = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("comp").alias("top")).withColumn("k", F.lit(1).cast("long"))
        else:
            share = rows.groupBy("node", "comp").agg(F.count("*").alias("k"))
            per = share.groupBy("node").agg(F.sum("k").alias("n"), F.max_by("comp", F.struct("k", "comp")).alias("top"), F.max("k").alias("k"))
        per = per.where("n > k").select("node", "n", "top", (F.col("n") - F.col("k")).alias("strays"))
        out = saved(rows.join(per, "node").select("node", "cls", "comp", "n", "top", "strays"), "nodes")
        return out if out.limit(1).count() else None

    def attached(self, rows: DataFrame) -> DataFrame:
        """Rows (node, cls) with the classes' components."""
        if self.comp is None:
            return rows.select("node", "cls", F.col("cls").alias("comp"))
        return rows.join(self.comp, "cls", "left").select("node", "cls", F.coalesce("comp", "cls").alias("comp"))

    def compared(self, live: DataFrame) -> DataFrame:
        """Candidates (a, b) of nodes, and nodes (node) that named a few of very many."""
        parts = F.ceil(F.col("n") / SMALL).cast("long")
        rows = live.where(F.col("n") <= SMALL).select("node", F.lit(0).cast("long").alias("part"), "cls", "comp")
        wide = live.where(F.col("n") > SMALL)
        if wide.limit(1).count():
            order = [F.col("cls"), *[F.xxhash64("cls", F.lit(k)) for k in range(1, LEADERS)]]
            leads = wide.groupBy("node").agg(F.max("n").alias("n"), F.array(*[F.min(F.struct(o.alias("h"), "cls", "comp")) for o in order]).alias("leads"))
            leads = leads.select("node", _every(parts).alias("part"), "leads").select("node", "part", F.explode("leads").alias("x")).select("node", "part", "x.cls", "x.comp")
            rows = rows.union(wide.select("node", F.pmod(F.xxhash64("cls", "node"), parts), "cls", "comp")).union(leads)
        rows = rows.join(self.classes.select("cls", "n_shingles", "brief"), "cls").repartition("node", "part").sortWithinPartitions("node", "part", "cls")
        return saved(rows.select("node", "part", "cls", "comp", "n_shingles", "brief").mapInArrow(lean(_runs(("node", "part"), _compared)), "a long, b long, node long"), "candidates")

    def unsettled(self, live: DataFrame, met: DataFrame) -> DataFrame | None:
        """Nodes in which not all pairs were compared, if they have different components still."""
        dense = met.where("node is not null").select("node").distinct().withColumn("dense", F.lit(True))
        rows = live.join(dense, "node", "left").where(F.col("dense") | (F.col("n") > SMALL)).select("node", "cls")
        return self.live(self.attached(rows)) if rows.limit(1).count() else None

    def settle(self, rows: DataFrame) -> None:
        """Compare nodes whole: small ones each, large ones by the component that most members have.

        All other members of such nodes, the strays, meet all members of that component, and each other, in blocks.
        """
        parts = rows.where(F.col("n") <= SMALL).select("node", F.lit(-1).cast("long").alias("part"), "cls", "comp")
        wide = rows.where(F.col("n") > SMALL)
        if wide.limit(1).count():
            strays = saved(wide.where("comp <> top").select("top", "cls", "comp").distinct(), "strays")
            tops = wide.select("top").distinct()
            members = strays.union(tops.select("top", F.col("top").alias("cls"), F.col("top").alias("comp")))
            if self.comp is not None:
                members = members.union(self.comp.join(tops, F.col("comp") == F.col("top")).select("top", "cls", "comp"))
            members = saved(members, "members")
            count = lambda d, name: d.groupBy("top").agg(F.ceil(F.count("*") / SMALL).cast("long").alias(name))
            sizes = saved(count(members, "parts").join(count(strays, "blocks"), "top"), "sizes")
            own = lambda k: F.pmod(F.xxhash64("cls", F.lit(1)), F.col(k))
            met = members.join(sizes, "top").select("top", own("parts").alias("part"), _every(F.col("blocks")).alias("block"), "blocks", "cls", "comp")
            probe = strays.join(sizes, "top").select("top", _every(F.col("parts")).alias("part"), own("blocks").alias("block"), "blocks", "cls", "comp")
            parts = parts.union(met.union(probe).select("top", F.col("part") * F.col("blocks") + F.col("block"), "cls", "comp"))
        sets = self._sets_of(parts.select("cls").distinct())
        full = parts.join(self.classes.select("cls", "n_shingles", "brief"), "cls").join(sets, "cls")
        full = full.repartition("node", "part").sortWithinPartitions("node", "part", "cls")
        links = saved(full.select("node", "part", "cls", "comp", "n_shingles", "brief", "shingles").mapInArrow(lean(_runs(("node", "part"), _settled)), "a long, b long"), "settled")
        self.link(links)

    def branched(self, rows: DataFrame) -> DataFrame | None:
        """Descendants of nodes."""
        rows = self.attached(rows).join(self.classes.select("cls", "brief"), "cls").repartition("cls")  # the members of a node go to many tasks
        below = saved(rows.select("node", "cls", "comp", "brief").mapInArrow(lean(_children), "node long, cls long, comp long"), "descendants")
        out = self.live(below)
        dropped(below)
        return out

    def link(self, new: DataFrame) -> None:
        if new.limit(1).count():
            self.comp = components(new if self.comp is None else new.union(self.comp.toDF("a", "b")))

    def take(self, pairs: DataFrame) -> None:
        """Confirm candidate pairs on full sets and add the links they make.

        First each class with its smallest partner, which links most groups;
        then the pairs whose ends are still apart as far as one hop shows.
        """
        fresh = pairs.distinct() if self.tested is None else pairs.distinct().join(self.tested, ["a", "b"], "left_anti")
        todo = saved(fresh, "pairs")
        if not todo.limit(1).count():
            return
        sets = self._sets_of(todo.select("a").union(todo.select("b")).distinct().toDF("cls"))

        def confirmed(some: DataFrame) -> DataFrame:
            joined = some.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
            both = F.size(F.array_intersect("sa", "sb")).cast("long")
            return saved(joined.select("a", "b", (100 * both >= SIMILAR * (F.size("sa") + F.size("sb") - both)).alias("ok")), "confirmed")

        first = confirmed(todo.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
        rest = todo.join(first.select("b", F.col("a").alias("fa"), F.col("ok").alias("fb")), "b", "left").where("a <> fa")
        rest = rest.join(first.where("ok").select(F.col("b").alias("a"), F.col("a").alias("ga")), "a", "left")
        second = confirmed(rest.where(F.when(F.col("fb"), F.col("fa")).otherwise(F.col("b")) != F.coalesce("ga", "a")).select("a", "b"))
        dropped(todo)
        tried = first.union(second)
        self.tested = tried.select("a", "b") if self.tested is None else self.tested.union(tried.select("a", "b"))
        self.link(tried.where("ok").select("a", "b"))

    def _sets_of(self, ids: DataFrame) -> DataFrame:
        """Shingle sets of classes, each made from one text; those made before are kept."""
        if self.sets is not None:
            ids = ids.join(self.sets.select("cls"), "cls", "left_anti")
        need = saved(ids.join(self.classes.select("cls", "key", "mark"), "cls"), "wanted")
        n = need.count()
        if n:
            small = (lambda d: F.broadcast(d)) if n <= BROADCAST_IDS else (lambda d: d)
            texts = self.texts.join(small(need.select("key").distinct()), "key", "left_semi").select("text")
            made = saved(texts.mapInArrow(lean(_sets), "mark binary, shingles array<long>").join(small(need.select("cls", "mark")), "mark").select("cls", "shingles"), "sets")
            if made.count() > n:  # rows that repeat an id and its text
                once = saved(made.groupBy("cls").agg(F.first("shingles").alias("shingles")), "sets")
                dropped(made)
                made = once
            self.made.append(made)
            self.sets = made if self.sets is None else self.sets.union(made)
        return self.sets


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id and kept (see the module's text)."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes).get(id_col, "string")
    own = private(docs, {"doc_id": id_col, "text": text_col}).withColumn("text", F.col("text").cast("string"))
    hashed = lambda c: F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("")))
    sigs = saved(own.mapInArrow(lean(_sign), f"doc_id {kind}, n_shingles long, mark binary, roots array<long>, brief binary"), "signatures")
    classes = sigs.where("mark is not null").groupBy("mark").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("roots").alias("roots"), F.first("brief").alias("brief"))
    classes = saved(classes.withColumns({"cls": F.monotonically_increasing_id(), "key": hashed("least")}), "classes")
    join = _Join(own.select(hashed("doc_id").alias("key"), "text"), classes)
    live = join.live(classes.select(F.explode("roots").alias("node"), "cls", F.col("cls").alias("comp")))
    for step in range(STEPS):
        if live is None:
            break
        met = join.compared(live)
        join.take(met.where("a is not null").select("a", "b"))
        rest, made = join.unsettled(live, met), [live, met]
        live = None
        if rest is not None:
            few = (F.col("n") <= SMALL) | (F.col("strays") <= SMALL) if step < STEPS - 1 else F.lit(True)
            if rest.where(few).limit(1).count():
                join.settle(rest.where(few))
            if rest.where(~few).limit(1).count():
                live = join.branched(rest.where(~few).select("node", "cls"))
            made.append(rest)
        dropped(*made)
        swept(docs.sparkSession)
    mine = classes.select("cls", "mark", "least")
    if join.comp is not None:
        mine = mine.join(join.comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        least = mine.groupBy("comp").agg(F.min("least").alias("component_id"))
        mine = mine.join(least, "comp").select("mark", "component_id")
    else:
        mine = mine.select("mark", F.col("least").alias("component_id"))
    mine = saved(mine, "class-components")
    out = sigs.select("doc_id", "n_shingles", "mark").join(mine, "mark", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("mark").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    dropped(*join.made)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
