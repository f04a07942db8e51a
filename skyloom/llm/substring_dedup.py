"""Removal of word runs that an earlier document has already, with sharded Aho-Corasick automata.

1. Every task hashes the 13-word windows of its documents and sends each hash once, with the
   smallest document that has it, to a bucket of hashes. A later document of the same task is known
   to repeat the window, which goes straight to the shard of that document. So a passage that a third of all documents share costs a
   bucket one entry per piece of input, not one per document.
2. A bucket confirms the recurring windows and tells them to the shards of the later documents.
3. A shard is a block of documents of bounded bytes. It merges its confirmed windows to passages, compiles
   an automaton of their aligned word blocks, streams all of its documents through it, and compares the
   windows around each hit with the confirmed ones. What they cover goes.
"""

from __future__ import annotations

import struct

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import block_numbers, block_of, text_bytes, text_rows
from skyloom.llm.words import Words, pieces, runs

BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 4 << 20
LOW_BITS = 56
_LOW = np.uint64((1 << LOW_BITS) - 1)


def _pack(low: np.ndarray, ids: np.ndarray) -> bytes:
    """Hashes and the document of each, in order of the documents; of hashes below 2**56 (a bucket holds their high bits) seven bytes."""
    order = np.argsort(ids, kind="stable")
    low, ids = low[order], ids[order]
    step = np.diff(ids, prepend=ids[:1]).astype(np.uint64)
    width = next(w for w in (1, 2, 4, 8) if int(step.max()) < 1 << 8 * w)
    top, size = low >> np.uint64(48), 7 if int(low.max()) >> LOW_BITS == 0 else 8
    return b"".join((struct.pack("<qIBB", int(ids[0]), len(ids), width, size), low.astype("<u4").tobytes(),
                     (low >> np.uint64(32)).astype("<u2").tobytes(), top.astype("u1" if size == 7 else "<u2").tobytes(),
                     step.astype(f"<u{width}").tobytes()))


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    base, n, width, size = struct.unpack_from("<qIBB", packed)
    low = np.frombuffer(packed, "<u4", n, 14).astype(np.uint64)
    high = np.frombuffer(packed, "<u2", n, 14 + 4 * n).astype(np.uint64)
    top = np.frombuffer(packed, "u1" if size == 7 else "<u2", n, 14 + 6 * n).astype(np.uint64)
    step = np.frombuffer(packed, f"<u{width}", n, 14 + size * n).astype(np.uint64)
    return low | high << np.uint64(32) | top << np.uint64(48), np.cumsum(step).view(np.int64) + base


def _grouped(key: np.ndarray, low: np.ndarray, ids: np.ndarray):
    """The packed entries of each key."""
    order = np.argsort(key, kind="stable")
    key, low, ids = key[order], low[order], ids[order]
    cut = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)) if len(key) else []
    for a, b in zip(cut, [*cut[1:], len(key)]):
        yield int(key[a]), _pack(low[a:b], ids[a:b])


def _keys(h: np.ndarray, bits: int) -> np.ndarray:
    """What shards know of hashes: the bucket above the low bits."""
    return (h >> np.uint64(64 - bits)) << np.uint64(LOW_BITS) | h & _LOW


def _windows(window: int, bits: int, blocks: int):
    """(bucket, packed): windows of a piece by bucket; those known to be repeated by shard, as the bucket -1 - shard."""
    shift = np.uint64(64 - bits)

    def rows(batches):
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            for a, b in pieces(texts):
                words = Words(texts.slice(a, b - a))
                number = np.asarray(ids.slice(a, b - a), dtype=np.int64)
                h, at = words.windows(window)
                if not len(h):
                    continue
                doc = number[words.doc[at]]
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                fresh = np.r_[True, h[1:] != h[:-1]]
                smallest = doc[fresh][np.cumsum(fresh) - 1]
                later = (doc > smallest) & np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
                out = list(_grouped((h[fresh] >> shift).astype(np.int64), h[fresh] & _LOW, doc[fresh]))
                out += _grouped(-1 - block_numbers(doc[later], blocks), _keys(h[later], bits), doc[later])
                yield pa.RecordBatch.from_arrays([
                    pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["bucket", "packed"])

    return rows


def _confirm(blocks: int):
    """(block, bucket, packed): windows of a bucket that a later document repeats, for the shard of that document."""

    def rows(key, table):
        bucket, packed = key[0].as_py(), table.column("packed")
        if bucket < 0:  # confirmed already
            n = len(packed)
            return pa.table({"block": pa.array([-1 - bucket] * n, pa.int32()), "bucket": pa.array([-1] * n, pa.int64()), "packed": packed})
        sent = [_unpack(p) for p in packed.to_pylist()]
        h = np.concatenate([x[0] for x in sent])
        doc = np.concatenate([x[1] for x in sent])
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        fresh = np.r_[True, h[1:] != h[:-1]]
        later = doc > doc[fresh][np.cumsum(fresh) - 1]
        h, doc = h[later], doc[later]
        out = list(_grouped(block_numbers(doc, blocks), h, doc)) if len(h) else []
        return pa.Table.from_arrays([
            pa.array([x[0] for x in out], pa.int32()), pa.array([bucket] * len(out), pa.int64()),
            pa.array([x[1] for x in out], pa.binary())], names=["block", "bucket", "packed"])

    return rows


class _Shard:
    """The documents of one block, with the windows that are confirmed for it."""

    def __init__(self, texts: pa.Array, number: np.ndarray, keys: np.ndarray, since: np.ndarray, window: int, bits: int):
        self.words, self.number, self.window = Words(texts), number, window
        self.keys, self.since = keys, since
        h, self.at = self.words.windows(window)
        self.key = _keys(h, bits)
        self.size = (window + 1) // 2

    def _place(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return place, self.keys[place] == key

    def passages(self) -> list[np.ndarray]:
        """Words of merged windows, each window from the document that brought it here."""
        place, known = self._place(self.key)
        chosen = self.at[known & (self.since[place] == self.number[self.words.doc[self.at]])]
        out = []
        for a, b in zip(*runs(chosen)):
            # starts next to each other are of one text, or the first ends where the next begins
            for d in range(self.words.doc[a], self.words.doc[b] + 1):
                out.append(self.words.hashes[max(a, self.words.first[d]):min(b + self.window, self.words.first[d + 1])])
        return out

    @staticmethod
    def letters(words: np.ndarray) -> str:
        """Two letters per word, each of 64 of its own: an automaton's nodes have few children."""
        letters = np.empty(2 * len(words), np.uint8)
        letters[0::2] = (words & np.uint64(63)) + np.uint64(0x30)
        letters[1::2] = (words >> np.uint64(6) & np.uint64(63)) + np.uint64(0x80)
        return letters.tobytes().decode("latin-1")

    def automaton(self) -> ahocorasick.Automaton:
        """Of blocks of (window + 1) // 2 words at multiples of that in a passage: any window of it holds one."""
        machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for words in self.passages():
            text = self.letters(words)
            for at in range(0, len(text) - 2 * self.size + 1, 2 * self.size):
                machine.add_word(text[at:at + 2 * self.size])
        machine.make_automaton()
        return machine

    def covered(self) -> np.ndarray:
        """Which words are in a confirmed window of an earlier document."""
        mask = np.zeros(len(self.words.hashes), bool)
        if not len(self.keys) or not len(self.at):
            return mask
        machine, hits, first = self.automaton(), [], self.words.first
        for a, b in zip(first[:-1], first[1:]):
            hits += [a + (end + 1) // 2 for end, _ in machine.iter(self.letters(self.words.hashes[a:b]))]
        # windows around a hit, compared by all of their words
        starts = np.unique(np.array(hits, np.int64)[:, None] - self.size - np.arange(self.window - self.size + 1))
        which = np.minimum(np.searchsorted(self.at, starts), len(self.at) - 1)
        which = which[self.at[which] == starts]
        place, known = self._place(self.key[which])
        starts = self.at[which[known & (self.since[place] <= self.number[self.words.doc[self.at[which]]])]]
        edges = np.zeros(len(mask) + 1, np.int64)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + self.window, -1)
        return np.cumsum(edges)[:-1] > 0


def _removed(window: int, bits: int):
    def rows(key, docs, confirmed):
        texts, ids = docs.column("text").combine_chunks(), docs.column("doc_id").combine_chunks()
        # a row without an id is before all others: nothing is taken from it
        number = np.where(ids.is_valid().to_numpy(zero_copy_only=False), np.asarray(ids.fill_null(0), dtype=np.int64), np.iinfo(np.int64).min)
        parts = [(b, *_unpack(p)) for b, p in zip(confirmed.column("bucket").to_pylist(), confirmed.column("packed").to_pylist())]
        keys, since = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if parts:
            keys = np.concatenate([low if b < 0 else np.uint64(b) << np.uint64(LOW_BITS) | low for b, low, _ in parts])
            since = np.concatenate([d for _, _, d in parts])
            order = np.lexsort((since, keys))
            keys, since = keys[order], since[order]
            fresh = np.r_[True, keys[1:] != keys[:-1]]
            keys, since = keys[fresh], since[fresh]
        shard = _Shard(texts, number, keys, since, window, bits)
        mask, first, kept, gone = shard.covered(), shard.words.first, [], []
        for i, text in enumerate(texts.fill_null("").to_pylist()):
            every, off = text.encode().split(), mask[first[i]:first[i + 1]]
            gone.append(int(off.sum()))
            kept.append(b" ".join([w for w, x in zip(every, off) if not x] if gone[-1] else every).decode())
        return pa.Table.from_arrays([
            ids, pa.array(shard.words.counts(), pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
            names=["doc_id", "n_words", "n_removed", "text"])

    return rows


def substring_dedup(docs: DataFrame, window: int = 13) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, and the text of the words that stay.

    A word goes when it is in a run of ``window`` words that also starts in a document with a smaller doc_id;
    runs are judged on the input. Words are ``[^\\x20\\x09-\\x0D]+``; those that stay are joined by one space.
    A null text has no words. A row without a doc_id has no place in the order: it stays whole and takes
    nothing from others. Rows with one doc_id don't take from each other. An empty table gives an empty result.
    """
    if window < 2:
        raise ValueError("window must be 2 or more")
    rows = text_rows(docs)
    size = text_bytes(rows)
    bits = max(8, (size // BUCKET_BYTES).bit_length())
    blocks = size // BLOCK_BYTES + 1
    sent = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(
        _windows(window, bits, blocks), "bucket long, packed binary")
    confirmed = sent.groupBy("bucket").applyInArrow(_confirm(blocks), "block int, bucket long, packed binary")
    # nothing is confirmed for a row without an id, so any block will do
    anywhere = F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int")
    sharded = rows.withColumn("block", F.when(F.col("doc_id").isNull(), anywhere).otherwise(block_of(F.col("doc_id"), blocks)))
    return sharded.groupBy("block").cogroup(confirmed.groupBy("block")).applyInArrow(
        _removed(window, bits), "doc_id long, n_words long, n_removed long, text string")
