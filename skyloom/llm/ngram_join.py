"""Jaccard similarity join of word-shingle sets with PartEnum signatures.

Sets are cut into bands by size. In one band, similar sets differ in at most k shingles. The shingle
domain is hashed into n1 partitions of n2 parts; of k differences at most k2 fall into some partition,
so leaving out the right k2 of its n2 parts, what remains is equal in both sets. A signature is the hash
of what remains, for each partition and each choice of parts.

Equal sets are one node from the start. Nodes that share a signature are compared by parity sketches, which
never reject a similar pair; the survivors' connected candidates meet, in blocks of bounded size, for the
exact test. No pair leaves a task: each sends an edge from the first node of a component to every other one, so a group
of copies costs a line per member and no link between different sets is lost for the components.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import text_rows
from skyloom.llm.components import components, forest
from skyloom.llm.words import Words, mixed, pieces
from skyloom.plans.tables import materialize

BAND_RATIO = 1.3
SIGNATURES_PER_TASK = 1_000_000
SKETCH_BLOCK = 1024
SET_BLOCK = 512
ROWS_PER_GROUP = 4000


@dataclass(frozen=True)
class Likeness:
    """Two sets are linked when den * intersection >= num * union, of shingles of ``shingle`` words."""

    num: int = 4
    den: int = 5
    shingle: int = 5
    lower: bool = True

    def __post_init__(self):
        if not 0 < self.num <= self.den or self.shingle < 1:
            raise ValueError("0 < num <= den and shingle >= 1 are needed")

    def apart(self, total):
        """Most shingles in which linked sets of ``total`` shingles together differ."""
        return (self.den - self.num) * total // (self.den + self.num)

    def bands(self, largest: int) -> list[int]:
        """Upper ends of the size bands up to that of ``largest``."""
        ends = [1]
        while ends[-1] < largest:
            ends.append(max(ends[-1] + 1, int(ends[-1] * BAND_RATIO)))
        return ends


@dataclass(frozen=True)
class Cut:
    """Numbers of one band: partitions n1, parts n2 of each, parts left out k2, spare partitions."""

    n1: int
    n2: int
    k2: int
    spare: int

    @classmethod
    def of(cls, k: int) -> Cut:
        if k == 0:
            return cls(1, 1, 0, 0)
        n1 = k // 2 + 1
        spare = 2 if n1 >= 8 else 0
        return cls(n1 + spare, 3, 1, spare)


class Sets:
    """Distinct shingle hashes of some texts, sorted in each text, with their hash as a set."""

    def __init__(self, texts, like: Likeness):
        words = Words(texts, lower=like.lower)
        count = words.counts()
        h, at = words.windows(like.shingle)
        doc = words.doc[at]
        short = np.flatnonzero((count > 0) & (count < like.shingle))
        if len(short):
            whole = np.array([self._whole(words.hashes[words.first[i]:words.first[i + 1]]) for i in short], np.uint64)
            h, doc = np.concatenate([h, whole]), np.concatenate([doc, short])
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        fresh = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
        self.h, self.doc = h[fresh], doc[fresh]
        self.size = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self.first = np.r_[0, np.cumsum(self.size)]
        sums = np.r_[np.uint64(0), np.cumsum(mixed(self.h, 3))]
        self.node = mixed(sums[self.first[1:]] - sums[self.first[:-1]] + self.size.astype(np.uint64), 4).view(np.int64)

    @staticmethod
    def _whole(hashes: np.ndarray) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for x in hashes:
            h = mixed(h * np.uint64(31) + x, 5)
        return mixed(h + np.uint64(len(hashes)), 6)[0]

    def of(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the sets of these texts, and for each its place in ``docs``."""
        take = np.concatenate([np.arange(self.first[d], self.first[d + 1]) for d in docs])
        return self.h[take], np.repeat(np.arange(len(docs)), self.size[docs])


def _in_bands(size: np.ndarray, like: Likeness):
    """(band, its end, which sets): each set in its own band and those above that hold sets it can be linked with."""
    if not size.any():
        return
    ends = like.bands(int(size.max()) * like.den // like.num)
    own = np.searchsorted(ends, size)
    top = np.searchsorted(ends, size * like.den // like.num)
    for band in np.unique(np.concatenate([own, top])).tolist() if len(size) else []:
        chosen = np.flatnonzero((size > 0) & (own <= band) & (band <= top))
        if len(chosen):
            yield band, ends[band], chosen


def _sketches(sets: Sets, chosen: np.ndarray, end: int) -> list[bytes]:
    bits = 1 << max(8, (end - 1).bit_length())
    h, owner = sets.of(chosen)
    flat = owner * bits + (mixed(h, 7) % np.uint64(bits)).astype(np.int64)
    parity = (np.bincount(flat, minlength=len(chosen) * bits) & 1).astype(np.uint8).reshape(len(chosen), bits)
    return [row.tobytes() for row in np.packbits(parity, axis=1)]


def _sizes(like: Likeness):
    """Per text: size, node, and the sketch of each of its bands."""

    def rows(batches):
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            for a, b in pieces(texts):
                sets = Sets(texts.slice(a, b - a), like)
                bands, sketches = [[] for _ in sets.size], [[] for _ in sets.size]
                for band, end, chosen in _in_bands(sets.size, like):
                    step = max(1, (8 << 20) // end)
                    for c in range(0, len(chosen), step):
                        part = chosen[c:c + step]
                        for i, sketch in zip(part, _sketches(sets, part, end)):
                            bands[i].append(band)
                            sketches[i].append(sketch)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(a, b - a), pa.array(sets.size), pa.array(sets.node),
                    pa.array(bands, pa.list_(pa.int32())), pa.array(sketches, pa.list_(pa.binary()))],
                    names=["doc_id", "n_shingles", "node", "bands", "sketches"])

    return rows


def _signatures_of(sets: Sets, chosen: np.ndarray, band: int, cut: Cut):
    """Signatures of the sets in one band, and the place in ``chosen`` of each."""
    h, owner = sets.of(chosen)
    place = mixed(h, 1)
    n1, n2 = np.uint64(cut.n1), np.uint64(cut.n2)
    cell = (place % n1 * n2 + place // n1 % n2).astype(np.int64)
    flat, shape = owner * cut.n1 * cut.n2 + cell, (len(chosen), cut.n1, cut.n2)
    value, total = mixed(h, 2), len(chosen) * cut.n1 * cut.n2
    low = np.bincount(flat, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), total)
    high = np.bincount(flat, (value >> np.uint64(32)).astype(np.float64), total)
    # sums of 32-bit halves are exact in a double up to two million shingles of a cell
    sums = (low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))).reshape(shape)
    held = np.bincount(flat, minlength=total).reshape(shape)
    # with no more weak partitions than spare ones, some equal partition has a shingle in any choice of parts
    weak = ((held > 0).sum(axis=2) <= cut.k2).sum(axis=1)
    empties = weak > cut.spare if cut.k2 else np.zeros(len(chosen), bool)
    for choice, parts in enumerate(combinations(range(cut.n2), cut.n2 - cut.k2)):
        salt = mixed(np.arange(cut.n1, dtype=np.uint64) * np.uint64(16) + np.uint64(choice), 8)
        sig = mixed(sums[:, :, parts].sum(axis=2) + salt, 9 + band)
        use = (held[:, :, parts].sum(axis=2) > 0) | empties[:, None]
        who = np.broadcast_to(np.arange(len(chosen))[:, None], sig.shape)
        yield sig[use] & ~np.uint64(0xFF) | np.uint64(band & 0xFF), who[use]


def _signatures(like: Likeness):
    def rows(batches):
        for batch in batches:
            texts = batch.column("text")
            for a, b in pieces(texts):
                sets = Sets(texts.slice(a, b - a), like)
                _, single = np.unique(sets.node, return_index=True)
                size = np.zeros_like(sets.size)
                size[single] = sets.size[single]
                for band, end, chosen in _in_bands(size, like):
                    cut = Cut.of(like.apart(2 * end))
                    step = max(1, (4 << 20) // (cut.n1 * cut.n2))
                    for c in range(0, len(chosen), step):
                        part = chosen[c:c + step]
                        for sig, who in _signatures_of(sets, part, band, cut):
                            yield pa.RecordBatch.from_arrays([
                                pa.array(sig.view(np.int64)), pa.array(sets.node[part][who])], names=["sig", "node"])

    return rows


def _shared(batches):
    """Nodes that share a signature; the same nodes under several signatures count once."""
    found = [(np.asarray(x.column("sig")), np.asarray(x.column("node"))) for x in batches]
    if not found:
        return
    sig, node = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    fresh = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]
    sig, node = sig[fresh], node[fresh]
    cut = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    members = np.diff(np.r_[cut, len(sig)])
    band = sig[cut] & 0xFF
    content = mixed(np.add.reduceat(mixed(node.view(np.uint64), 10), cut) + band.astype(np.uint64), 11).view(np.int64)
    _, once = np.unique(content, return_index=True)
    once = once[members[once] > 1]
    take = np.concatenate([np.arange(cut[i], cut[i] + members[i]) for i in once]) if len(once) else np.zeros(0, int)
    n = members[once]
    yield pa.RecordBatch.from_arrays([
        pa.array(np.repeat(content[once], n)), pa.array(np.repeat(band[once], n), pa.int32()),
        pa.array(node[take]), pa.array(np.repeat(n, n), pa.int64())], names=["group", "band", "node", "members"])


def _met(rows: DataFrame, total: int, block: int) -> DataFrame:
    """``total`` rows (group, node, members, ...) dealt to tasks by (slot, i, j): big groups as pairs of blocks."""
    slots = total // ROWS_PER_GROUP + 1
    blocks = F.ceil(F.col("members") / block).cast("int")
    mine = F.pmod("node", blocks).cast("int")
    return (rows.withColumn("_b", mine).withColumn("_o", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .withColumns({"slot": F.pmod("group", F.lit(slots)), "i": F.least("_b", "_o"), "j": F.greatest("_b", "_o")}).drop("_o"))


def _pairs_of(group: pa.Table, one: str):
    """Per group of a task: indices of its rows, by node, so that equal groups of different signatures give equal edges."""
    key = np.asarray(group.column(one))
    order = np.lexsort((np.asarray(group.column("node")), key))
    cut = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if len(order) else []
    for a, b in zip(cut, [*cut[1:], len(order)]):
        yield order[a:b]


def _edges(pairs: list) -> pa.Table:
    return pa.table({"u": pa.array([p[0] for p in pairs], pa.int64()), "v": pa.array([p[1] for p in pairs], pa.int64())})


def _crossing(near: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Blocks that meet: rows of one block have their own task."""
    return near & (block[:, None] != block[None, :]) if len(np.unique(block)) > 1 else near


def _sketched(like: Likeness):
    def rows(table: pa.Table) -> pa.Table:
        node, size, block = (np.asarray(table.column(c)) for c in ("node", "n_shingles", "_b"))
        sketch, out = table.column("sketch").to_pylist(), []
        for at in _pairs_of(table, "group"):
            bits = np.frombuffer(b"".join(sketch[i] for i in at), np.uint64).reshape(len(at), -1)
            near = np.zeros((len(at), len(at)), bool)
            step = max(1, (2 << 20) // bits.size)
            for a in range(0, len(at), step):
                apart = np.bitwise_count(bits[a:a + step, None] ^ bits[None]).sum(axis=2, dtype=np.int64)
                near[a:a + step] = apart <= like.apart(size[at[a:a + step], None] + size[at][None])
            out += [(node[at[u]], node[at[v]]) for u, v in forest(_crossing(near, block[at]))]
        return _edges(out)

    return rows


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[number] > 1
    number, owner = number[shared], owner[shared]
    number = np.unique(number, return_inverse=True)[1] if len(number) else number
    order = np.argsort(number)
    number, owner = number[order], owner[order]
    common = np.zeros((len(sets), len(sets)), np.int64)
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
        x, y = np.searchsorted(number, [a, a + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[x:y], number[x:y] - a] = 1
        common += (part @ part.T).astype(np.int64)
    return common


def _exact(like: Likeness):
    def rows(table: pa.Table) -> pa.Table:
        node, block = np.asarray(table.column("node")), np.asarray(table.column("_b"))
        packed, out = table.column("shingles").to_pylist(), []
        for at in _pairs_of(table, "group"):
            sets = [np.frombuffer(packed[i], np.uint64) for i in at]
            size = np.array([len(s) for s in sets])
            both = (np.array([[len(sets[0]), x := len(np.intersect1d(*sets, assume_unique=True))], [x, len(sets[1])]])
                    if len(sets) == 2 else _common(sets))
            near = like.den * both >= like.num * (size[:, None] + size[None] - both)
            out += [(node[at[u]], node[at[v]]) for u, v in forest(_crossing(near, block[at]))]
        return _edges(out)

    return rows


def _packed_sets(like: Likeness):
    """(node, shingles) of texts: those of the node given along with them, or of any with a word."""

    def rows(batches):
        for batch in batches:
            texts = batch.column("text")
            wanted = np.asarray(batch.column("node")) if "node" in batch.schema.names else None
            for a, b in pieces(texts):
                sets = Sets(texts.slice(a, b - a), like)
                same = np.flatnonzero(sets.size > 0 if wanted is None else sets.node == wanted[a:b])
                yield pa.RecordBatch.from_arrays([
                    pa.array(sets.node[same]), pa.array([sets.h[sets.first[i]:sets.first[i + 1]].tobytes() for i in same], pa.binary())],
                    names=["node", "shingles"])

    return rows


def similar_groups(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles (size of its set), component_id.

    The set holds the distinct runs of ``like.shingle`` words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased); a
    shorter text has its whole word sequence as one. A null text or one without words has the empty set,
    is linked with nothing, and has its own doc_id as component_id. component_id is the smallest doc_id
    reachable by links; texts with equal sets are linked, repeated rows and repeated doc_ids included. A
    row without a doc_id takes part; it lends its component no name. An empty table gives an empty result.
    """
    rows = text_rows(docs)
    sizes = materialize(rows.mapInArrow(
        _sizes(like), "doc_id long, n_shingles long, node long, bands array<int>, sketches array<binary>"), "sizes")
    nodes = materialize(sizes.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "nodes")
    total = sizes.agg(F.sum("n_shingles")).first()[0] or 0
    tasks = total // (2 * SIGNATURES_PER_TASK) + 1
    shared = materialize(
        rows.mapInArrow(_signatures(like), "sig long, node long").repartition(tasks, "sig")
        .mapInArrow(_shared, "group long, band int, node long, members long").dropDuplicates(["group", "node"]), "shared")
    sketches = (
        sizes.select("node", "n_shingles", F.explode(F.arrays_zip("bands", "sketches")).alias("s"))
        .select("node", "n_shingles", F.col("s.bands").alias("band"), F.col("s.sketches").alias("sketch")))
    wanted = shared.select("node", "band").distinct()
    sketches = materialize(
        sketches.join(wanted, ["node", "band"], "left_semi").groupBy("node", "band")
        .agg(F.min("n_shingles").alias("n_shingles"), F.min("sketch").alias("sketch")), "sketches")
    near = _met(shared.join(sketches, ["node", "band"]), shared.count(), SKETCH_BLOCK).groupBy("slot", "i", "j").applyInArrow(
        _sketched(like), "u long, v long")
    candidates = components(near)
    members = candidates.groupBy("root").agg(F.count("*").alias("members"))
    candidates = materialize(
        candidates.join(members, "root").join(nodes, "node").withColumnRenamed("root", "group"), "candidates")
    packed = "node long, shingles binary"
    named_sets = rows.join(candidates.select("doc_id", "node"), "doc_id").select("text", "node").mapInArrow(_packed_sets(like), packed)
    # sets that only rows without a doc_id hold can't be fetched by one
    others = rows.filter("doc_id IS NULL").select("text").mapInArrow(_packed_sets(like), packed).join(
        candidates.filter("doc_id IS NULL").select("node"), "node", "left_semi")
    sets = materialize(named_sets.unionByName(others).dropDuplicates(["node"]), "sets")
    links = _met(candidates.drop("doc_id").join(sets, "node"), candidates.count(), SET_BLOCK).groupBy("slot", "i", "j").applyInArrow(
        _exact(like), "u long, v long")
    linked = components(links).join(nodes, "node")
    names = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = materialize(
        nodes.join(linked.join(names, "root").select("node", "component_id"), "node", "left")
        .select("node", F.coalesce("component_id", "doc_id").alias("component_id")), "components")
    return sizes.join(named, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
