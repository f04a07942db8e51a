"""Token ids in Arrow files of equal-length sequences.

A part holds the documents of one range of ids. Its file is a sequence of record batches with the columns ``ids``, ``mask`` (a
token of a document) and ``ends`` (the last token of one), each a fixed-size list of one sequence's length. So sequence i of a batch is a
slice of memory-mapped buffers. Only the last sequence of a part is filled up. A second file lists the part's documents.
"""

from __future__ import annotations

import json
import os
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import batched

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyloom.llm.common import text_bytes, text_rows
from skyloom.plans.tables import materialize, new_path

PART_BYTES = 32 << 20
PIECE_BYTES = 1 << 19  # of text whose words are held at a time
SEQUENCES = 64
DIGIT = b"7"  # between words that are encoded together
WHITE = re.compile(rb"[\t-\r ]")  # as bytes.split() has it
CLIP = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE, LETTER, QUOTE, SIGN, WIDE = range(5)  # kinds of bytes; SIGN: the rest of ASCII, WIDE: not cut and not lower-cased
_KIND = np.full(256, WIDE, np.uint8)
_KIND[:128] = SIGN
_KIND[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = LETTER
_KIND[ord("'")] = QUOTE
_KIND[[0x20, *range(0x09, 0x0E)]] = SPACE
_BEGINS = np.zeros(64, bool)  # by 8 * the kind before + the kind: a word begins here
_BEGINS[[8 * SPACE + k for k in (LETTER, QUOTE, SIGN, WIDE)]] = True
_BEGINS[[8 * LETTER + QUOTE, 8 * LETTER + SIGN, 8 * SIGN + LETTER]] = True
_tokenizers: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads of its own only hold more memory
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


@cache
def _letter_ends(path: str) -> np.ndarray | None:
    """For each id whether it ends a run of letters; None unless every such run has an id that does.

    That is known of byte-level BPE with a suffix at the end of words, if each byte is in the vocabulary with the suffix too.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    model, suffix = parts["model"], parts["model"].get("end_of_word_suffix")
    byte_level = '"ByteLevel"' in json.dumps(parts["pre_tokenizer"])
    if model["type"] != "BPE" or not suffix or not byte_level or not all(c + suffix in model["vocab"] for c in ByteLevel.alphabet()):
        return None
    if any(t["content"].isalpha() for t in parts["added_tokens"]):
        return None
    ends = np.zeros(max([*model["vocab"].values(), *[t["id"] for t in parts["added_tokens"]]]) + 1, bool)
    ends[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True
    return ends


@cache
def _folded_tokens(path: str) -> list[bytes] | None:
    """The added tokens in lower case; None unless the tokenizer lower-cases and divides texts as CLIP's does.

    Such a one divides after an ASCII letter before another ASCII character, and before an ASCII letter after another one but the
    apostrophe (of 's), whatever is around. And it takes A for a, unless a mark that NFC joins with either may follow.
    """
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    steps = lambda part, key: (part or {}).get(key) or [part or {}]
    first, *rest = steps(parts["pre_tokenizer"], "pretokenizers")
    normalizers = steps(parts["normalizer"], "normalizers")
    folds = any(n.get("type") == "Lowercase" for n in normalizers) and all(
        n["type"] in ("NFC", "Lowercase") or (n["type"], n.get("pattern"), n.get("content")) == ("Replace", {"Regex": r"\s+"}, " ") for n in normalizers)
    divides = (first.get("type"), first.get("pattern"), first.get("behavior"), first.get("invert")) == ("Split", {"Regex": CLIP}, "Removed", True)
    bytes_only = all(r["type"] == "ByteLevel" and not r["add_prefix_space"] and not r.get("use_regex", True) for r in rest)
    plain = not any(t[k] for t in parts["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    return [t["content"].encode().lower() for t in parts["added_tokens"]] if folds and divides and bytes_only and plain else None


class Encoder:
    """Ids of texts whose words, between ASCII white space, are encoded alone: each different word once.

    Right for a tokenizer that drops white space and never joins what it divides. If it is known to lower-case and to divide letters from
    signs, so are the words, and there are far fewer different ones. Many words go through it as one text. Words
    of letters need nothing between them if the tokenizer marks where a run of letters ends; others are divided by a digit that is one id,
    or by a special token, at which the tokenizer cuts before anything else. Where the number of ends or dividers isn't that
    of the words, the words go the next, dearer way, and at last each alone. Texts are taken in pieces of ``piece``
    bytes, a long one in several, so memory does not grow with them; up to ``remembered`` words and those that came
    before them stay known.
    """

    def __init__(self, tokenizer: str, remembered: int = 250_000, together: int = 64, piece: int = PIECE_BYTES):
        self.tokenizer, self.remembered, self.together, self.piece = _tokenizer(tokenizer), remembered, together, piece
        self.known, self.older = {}, {}
        self.ends, self.folded = _letter_ends(tokenizer), _folded_tokens(tokenizer)
        special = [(t.content.encode(), i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word)]
        digit = self.tokenizer.encode(DIGIT.decode(), add_special_tokens=False).ids
        # (what must not be in a word, what comes between two, its id)
        self.dividers = [*([(DIGIT, b" %b " % DIGIT, digit[0])] if len(digit) == 1 else []), *[(t, t, i) for t, i in special[:1]]]

    def _learn(self, new: list[bytes]) -> None:
        if self.ends is not None:
            letters, rest = [], []
            for w in new:
                (letters if w.decode().isalpha() else rest).append(w)
            new = rest + self._learn_together(letters, b" ", None)
        for without, between, cut in self.dividers:
            apart = [w for w in new if without in w]
            new = apart + self._learn_together([w for w in new if without not in w], between, cut)
        for w, e in zip(new, self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)):
            self.known[w] = np.array(e.ids, "<u4").tobytes()

    def _learn_together(self, words: list[bytes], between: bytes, cut: int | None) -> list[bytes]:
        """Learns words by texts of several; gives those of texts that don't fall into as many parts as they have words."""
        groups, left = [words[a:a + self.together] for a in range(0, len(words), self.together)], []
        texts = [between.join(g).decode() for g in groups]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            if cut is None:
                stops = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
                starts = [0, *stops[:-1]]
            else:
                at = (4 * np.flatnonzero(ids == cut)).tolist()
                starts, stops = [0, *[c + 4 for c in at]], [*at, 4 * len(ids)]
            if len(stops) == len(group) and stops[-1] == 4 * len(ids):
                data = ids.tobytes()
                self.known.update(zip(group, [data[x:y] for x, y in zip(starts, stops)]))
            else:
                left += group
        return left

    def _words(self, runs: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """The words of all runs, and how many there are before each run and in all."""
        joined = b" ".join(runs)
        data = np.frombuffer(joined, np.uint8)
        kind = _KIND[data]
        if self.folded is None:
            kind[kind != SPACE] = WIDE
        else:
            small = joined.lower()
            for token in self.folded:  # the tokenizer looks for these first, as they are written
                at = small.find(token)
                while at >= 0:
                    kind[at:at + len(token)] = WIDE
                    at = small.find(token, at + 1)
            lower = kind == LETTER
            lower[:-1] &= data[1:] < 128
            data = np.where(lower, np.frombuffer(small, np.uint8), data)
        begins = _BEGINS[8 * np.r_[np.uint8(SPACE), kind[:-1]] + kind] if len(kind) else np.zeros(0, bool)
        inside = kind != SPACE
        data = data[inside]
        offsets = np.r_[np.flatnonzero(begins[inside]), len(data)].astype(np.int64)
        before = np.cumsum([0, *[len(r) + 1 for r in runs]])
        words = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return words, np.searchsorted(np.flatnonzero(begins), before)

    def _ids(self, runs: list[bytes]) -> list[np.ndarray]:
        words, before = self._words(runs)
        coded = words.dictionary_encode()
        every = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # bytes; to_pylist() takes ten times as long
        if len(self.known) > self.remembered:
            self.known, self.older = {}, self.known
        found = [*map(self.known.get, every)]
        new = [i for i, ids in enumerate(found) if ids is None]
        self.known.update((every[i], self.older[every[i]]) for i in new if every[i] in self.older)
        self._learn([every[i] for i in new if every[i] not in self.known])
        for i in new:
            found[i] = self.known[every[i]]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        word = coded.indices.to_numpy()
        n = size[word]
        stop = np.r_[0, np.cumsum(n)]
        # a word's ids stand in a row in `found`: their places, word after word
        places = np.repeat((np.cumsum(size) - size)[word] - stop[:-1], n) + np.arange(stop[-1])
        ids, cuts = np.frombuffer(b"".join(found), "<u4")[places], stop[before].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def __call__(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        parts = []
        for piece in self._pieces(texts):
            for ids, (_, last) in zip(self._ids([run for run, _ in piece]), piece):
                parts.append(ids)
                if last:
                    yield parts[0] if len(parts) == 1 else np.concatenate(parts)
                    parts = []

    def _pieces(self, texts: Iterable[str]) -> Iterator[list[tuple[bytes, bool]]]:
        """Lists of (run of a text, whether the text ends with it) of about ``piece`` bytes."""
        piece, held = [], 0
        for text in texts:
            for run, last in _runs(text.encode(), self.piece):
                piece.append((run, last))
                held += len(run) + 1
                if held >= self.piece:
                    yield piece
                    piece, held = [], 0
        if piece:
            yield piece


def _runs(text: bytes, size: int) -> Iterator[tuple[bytes, bool]]:
    """The text cut at white space after every ``size`` bytes, and whether it ends; a word is never cut."""
    at = 0
    while len(text) - at > size and (white := WHITE.search(text, at + size)):
        yield text[at:white.start()], False
        at = white.start()
    yield text[at:], True


@cache
def _encoder(tokenizer: str) -> Encoder:
    """One for all tasks of a process: what one has learned, the next knows."""
    return Encoder(tokenizer)


def require_words(tokenizer: str) -> None:
    """Stops at a tokenizer whose ids for a text are not those of its words alone, as ``Encoder`` takes them."""
    encode = Encoder(tokenizer)
    for text in ("one two", " one\ttwo ", "One, two.\n\nThree's 4 5", "über  ça\r\n日本 語", "(A-b) O'Neil's DON'T 'tis x'S &'s a1B2, É H\u0331, \u212bX."):
        if next(encode([text])).tolist() != _tokenizer(tokenizer).encode(text, add_special_tokens=False).ids:
            raise ValueError(f"{tokenizer} does not encode the words of a text each by itself")


class PartWriter:
    """Writes one part's two files; nothing is seen of it before its manifest row."""

    def __init__(self, folder: str, name: str, length: int, dtype: np.dtype):
        self.files, base = fs.FileSystem.from_uri(folder)
        self.files.create_dir(base, recursive=True)
        self.length, self.dtype = length, dtype
        lists = {"ids": pa.from_numpy_dtype(dtype), "mask": pa.bool_(), "ends": pa.bool_()}
        self.schema = pa.schema([(c, pa.list_(t, length)) for c, t in lists.items()])
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
        self.out = self.files.open_output_stream(posixpath.join(base, f"{name}.arrow"))
        self.docs_out = self.files.open_output_stream(posixpath.join(base, f"{name}.docs.arrow"))
        self.ids, self.docs = pa.ipc.new_file(self.out, self.schema), pa.ipc.new_file(self.docs_out, self.docs_schema)
        self.waiting, self.ends, self.held, self.n_docs, self.n_tokens = [], [], 0, 0, 0

    def add(self, doc_ids: list, tokens: list[np.ndarray]) -> None:
        if not doc_ids:
            return
        sizes = [len(t) for t in tokens]
        self.docs.write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(sizes, pa.int64())], schema=self.docs_schema))
        self.n_docs, self.n_tokens = self.n_docs + len(sizes), self.n_tokens + sum(sizes)
        self.waiting += tokens
        self.ends.append(np.zeros(sum(sizes), bool))
        self.ends[-1][np.cumsum(sizes) - 1] = True
        self.held += sum(sizes)
        if self.held >= SEQUENCES * self.length:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids, ends = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((self.waiting, "<u4"), (self.ends, bool)))
        step = SEQUENCES * self.length  # only a part's last batch is shorter, so a sequence's number gives its batch
        full = len(ids) if last else len(ids) // step * step
        for a in range(0, full, step):
            self._batch(ids[a:min(a + step, full)], ends[a:min(a + step, full)])
        self.waiting, self.ends, self.held = [ids[full:]], [ends[full:]], len(ids) - full

    def _batch(self, ids: np.ndarray, ends: np.ndarray) -> None:
        fill = -len(ids) % self.length
        mask = np.r_[np.ones(len(ids), bool), np.zeros(fill, bool)]
        ids, ends = np.r_[ids, np.zeros(fill, ids.dtype)].astype(self.dtype), np.r_[ends, np.zeros(fill, bool)]
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask, ends)]
        self.ids.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        for x in (self.ids, self.docs, self.out, self.docs_out):
            x.close()


def _write(folder: str, tokenizer: str, end_id: int, length: int, dtype: np.dtype):
    def rows(batches):
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        encode, writer = _encoder(tokenizer), None
        for batch in batches:
            writer = writer or PartWriter(folder, name, length, dtype)
            ends = np.array([end_id], "<u4")
            tokens = (np.concatenate((ids, ends)) for ids in encode(t.as_py() or "" for t in batch.column("text")))
            for some in batched(zip(batch.column("doc_id").to_pylist(), tokens), 256):
                writer.add(*map(list, zip(*some)))
        if writer:
            writer.close()
            yield pa.record_batch({
                "part": pa.array([part]), "path": pa.array([f"{folder}/{name}"]), "n_docs": pa.array([writer.n_docs]), "n_tokens": pa.array([writer.n_tokens])})

    return rows


def _open(path: str):
    files, at = fs.FileSystem.from_uri(path)
    return pa.memory_map(at) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(at)


def sequence(path: str, index: int) -> dict[str, pa.Array]:
    """Sequence ``index`` of a part's file: views of the mapped buffers, nothing is copied."""
    batch = pa.ipc.open_file(_open(f"{path}.arrow")).get_batch(index // SEQUENCES)
    return {c: batch.column(c)[index % SEQUENCES].values for c in batch.schema.names}


def documents(path: str):
    """(doc_id, ids) of a part's documents in order, read from its files."""
    numbers = pa.ipc.open_file(_open(f"{path}.docs.arrow")).read_all().column("doc_id").to_pylist()
    file, rest, at = pa.ipc.open_file(_open(f"{path}.arrow")), [], 0
    for i in range(file.num_record_batches):
        batch = file.get_batch(i)
        ids, mask, ends = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "mask", "ends"))
        ids, ends, begin = ids[mask], ends[mask], 0
        for stop in (np.flatnonzero(ends) + 1).tolist():
            yield numbers[at], np.concatenate([*rest, ids[begin:stop]])
            rest, begin, at = [], stop, at + 1
        rest.append(ids[begin:])


def _read(batches):
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            out = []
            for doc_id, ids in documents(path):
                out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                start += len(ids)
            for a in range(0, len(out), 10_000):
                yield pa.record_batch([pa.array([x[i] for x in out[a:a + 10_000]], pa.int64()) for i in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 2048, folder: str | None = None) -> DataFrame:
    """Writes the ids of all documents in ascending order of doc_id; gives (part, path, start, n_docs, n_tokens), a row per part.

    Every text is encoded whole, special tokens are not added, and ``end_id`` ends each document. Ids have 16 bits if the vocabulary
    allows it. ``start`` counts the ids of all parts before. Equal doc_ids are in order of their texts; null comes first and is
    kept; a null or empty text has only its end. ``tokenizer`` is a file that every executor has at that path. The folder (by
    default below the shared one) is a place that pyarrow can write to. A tokenizer that doesn't encode each word by itself stops the job. A repeated task writes new files, and only those
    of the manifest count. An empty table has no part.
    """
    from tokenizers import Tokenizer

    require_words(tokenizer)
    rows = text_rows(docs)
    folder = folder or new_path(docs.sparkSession, "tokens")
    dtype = np.dtype(np.uint16 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else np.uint32)
    parts = text_bytes(rows) // PART_BYTES + 1
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = materialize(ordered.mapInArrow(
        _write(folder, tokenizer, end_id, length, dtype), "part long, path string, n_docs long, n_tokens long"), "manifest")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row per file
    return manifest.select("part", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"), "n_docs", "n_tokens")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it), n_tokens, ids_crc32 (of its ids as 32-bit integers)."""
    parts = manifest.select("path", "start")
    return parts.repartition(max(1, parts.count()), "path").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
