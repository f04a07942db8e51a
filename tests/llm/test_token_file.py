import json
import zlib

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from skyloom.llm.token_file import Encoder, PartWriter, documents, read_tokens, sequence, write_tokens

FILE = path("word_bpe_49k.json")


def expected(rows):
    tokenizer, start, out = Tokenizer.from_file(FILE), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_round_trip_of_given_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted((tuple(r) for r in read_tokens(write_tokens(df, FILE)).collect()), key=lambda r: r[1])
    assert got == expected([(r["doc_id"], r["text"]) for r in df.collect()])


@pytest.mark.parametrize("length", [1, 7, 64, 2048])
def test_odd_rows_and_sequences(spark, tmp_path, length):
    rows = [(3, "### don't STOP ﬁ é é́ İ Σς wide space\x1cunit <|endoftext|> a<|startoftext|>b 12,5"), (1, None), (2, ""), (None, "null id"), (5, "same"), (5, "same"),
            (5, "other"), (-4, " \n "), (9, "long words " * 20_000), (8, "x" * 5_000), (2**40, "'s 't it'ś ́x")]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id long, text string, start int, path string")
    manifest = write_tokens(df, FILE, length=length, folder=str(tmp_path / "out"))
    got = sorted((tuple(r) for r in read_tokens(manifest).collect()), key=lambda r: r[1])
    assert got == expected(rows)
    for part in manifest.collect():
        ids = np.concatenate([x for _, x in documents(part["path"])])
        for i in range(0, -(-len(ids) // length), max(1, len(ids) // length // 9)):
            one = sequence(part["path"], i)
            assert all(len(c) == length for c in one.values()) and str(one["ids"].type) == "uint16"
            mask = one["mask"].to_numpy(zero_copy_only=False)
            assert (one["ids"].to_numpy()[mask] == ids[i * length:(i + 1) * length]).all()


def test_empty(spark):
    assert read_tokens(write_tokens(spark.createDataFrame([], "doc_id long, text string"), FILE)).collect() == []


def test_any_sequence_after_uneven_adds(tmp_path):
    rng = np.random.default_rng(8)
    for length in (3, 32):
        writer = PartWriter(str(tmp_path), f"part-{length}", length, np.dtype(np.uint16))
        every = []
        for n in rng.integers(1, 400, 60).tolist():
            tokens = [rng.integers(3, 60_000, int(k)).astype("<u4") for k in rng.integers(1, 90, max(1, n // 40))]
            writer.add(list(range(len(every), len(every) + len(tokens))), tokens)
            every += tokens
        writer.close()
        ids, at = np.concatenate(every), f"{tmp_path}/part-{length}"
        for i in rng.permutation(-(-len(ids) // length)).tolist():
            one = sequence(at, i)
            mask = one["mask"].to_numpy(zero_copy_only=False)
            assert (one["ids"].to_numpy()[mask] == ids[i * length:(i + 1) * length]).all()
        assert all((a == b).all() for (_, a), b in zip(documents(at), every, strict=True))


def test_a_tokenizer_that_joins_words_is_refused(spark):
    with pytest.raises(ValueError, match="each by itself"):
        write_tokens(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), path("byte_bpe_50k.json"))


@pytest.mark.parametrize("piece", [1, 5, 64, 1 << 19])
def test_pieces_cut_no_word_and_forgotten_words_are_learned_again(piece):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdeéß日"), rng.integers(1, 9))) for _ in range(300)]
    texts = ["", " ", "x" * 200, *["".join(w + s for w, s in zip(rng.choice(words, n), rng.choice([" ", "\n", "\t ", "\u00a0", "\x0b"], n))) for n in rng.integers(1, 90, 80)]]
    tokenizer, encode = Tokenizer.from_file(FILE), Encoder(FILE, remembered=20, piece=piece)
    assert [x.tolist() for x in encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert bool(encode.older) == (piece < 1 << 19)  # one piece holds all of them


def test_memory_does_not_grow_with_a_text():
    """The words of 16 MB of text, a third of them new, are never held together."""
    encode, largest = Encoder(FILE), 0
    learn = encode._learn
    rng = np.random.default_rng(5)
    text = " ".join(f"word {a:x} there" for a in rng.integers(0, 1 << 40, 400_000).tolist())

    def watched(new):
        nonlocal largest
        largest = max(largest, sum(map(len, new)))
        learn(new)

    encode._learn = watched
    (ids,) = encode([text])
    assert len(ids) > 1_200_000 and largest <= 1 << 19
    assert len(encode.known) + len(encode.older) < 600_000


def test_words_learned_together_are_those_learned_alone(monkeypatch):
    """Words of letters go through without dividers, and each way's words that don't fall apart as expected go the next one."""
    from skyloom.llm import token_file

    odd = ["Straße", "İstanbul", "ŉa", "ǰǰ", "ﬁn", "日本語", "नमस्ते", "e\u0301t", "ª", "ʰa", "x\u200dy", "it's", "'s", "7", "a7b", "٧٧", "７", "x<|endoftext|>y", "<|endoftext|>",
           "don't.", "A.b,C", "&&&", "\u00a0", "a\u00a0b", "\ufeffa", "\x00", "\U0001d7d5", "ά", "ΑΣ", "0", "12", "é7è", "\u0345", "a\u0345"]
    words = [o + x for o in odd for x in ("", "a", "Z", ".", "é")] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]
    text, tokenizer = " ".join(words), Tokenizer.from_file(FILE)
    want = tokenizer.encode(text, add_special_tokens=False).ids
    for together in (1, 2, 7, 64):
        encode, ways = Encoder(FILE, together=together), []
        learn = encode._learn_together
        monkeypatch.setattr(encode, "_learn_together", lambda w, between, cut: ways.append((len(w), between)) or learn(w, between, cut))  # noqa: B023
        assert np.concatenate([*encode([text])]).tolist() == want
        assert ways[0][1] == b" " and ways[0][0] >= 500 and [b for _, b in ways[1:]] == [b" 7 ", b"<|startoftext|>"]
        assert ways[2][0] < 100
    # what one task has learned, the next one of its process knows
    encode = token_file._encoder(FILE)
    [*encode([text])]
    monkeypatch.setattr(Encoder, "_learn_together", lambda self, w, *_: [] if not w else pytest.fail("learned again"))
    assert token_file._encoder(FILE) is encode and np.concatenate([*encode([text])]).tolist() == want


ODD_CASES = ["DON'T", "o'Neil's", "'tis", "x'S", "&'s", "&'S,", "'S", "a'", "'ll'LL", "(A-b)", "a1B2", "H\u0331", "h\u0331", "A\u030a.", "\u212b", "E\u0301,", "e\u0301,", "ΑΣ.", "ΑΣ.a", "aΣ", "İ.", "Iı",
             "<|ENDOFTEXT|>", "a.<|endoftext|>B.c", "<|EndOfText|><|endoftext|>x", "<|<|endoftext|>|>", "x=\u0338y", "A\u0338", "k\u00a0'S", "a,\u00a0B", "\x1cA\x1c's", "ﬁN.", "a\x00B", "A", "日本.A"]


@pytest.mark.parametrize("piece", [1, 1 << 19])
def test_words_cut_and_in_lower_case_have_the_same_ids(piece):
    rng, tokenizer = np.random.default_rng(6), Tokenizer.from_file(FILE)
    marks = [*"aAsStTzZ'.,-<>|&7", "\u0301", "\u0331", "\u0338", "é", "É", "Σ", "\u00a0", "日", "<|endoftext|>", "<|ENDOFTEXT|>"]
    drawn = ["".join(rng.choice(marks, rng.integers(1, 9))) for _ in range(4_000)]
    texts = ["", *ODD_CASES, " ".join(ODD_CASES), "", *["\n".join(rng.choice(drawn, 9)) for _ in range(500)], *drawn, " "]
    encode = Encoder(FILE, piece=piece)
    assert [x.tolist() for x in encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_signs_and_case_make_no_words_to_learn_again():
    """Only what differs in letters, whatever its case and the signs around it, goes through the tokenizer."""
    encode, learned = Encoder(FILE), []
    learn = encode._learn
    encode._learn = lambda new: learned.extend(new) or learn(new)
    [*encode(["Word word, (WORD) word. 'word' \"Word\"; other-word: Wörd, wörd"])]
    assert len(learned) == len(set(learned)) and {w for w in learned if w.isalpha()} == {b"word", b"other"}
    assert {w for w in learned if not w.isascii()} == {"Wörd".encode(), "wörd".encode()}


def test_words_are_left_whole_for_other_tokenizers(tmp_path):
    """A tokenizer that keeps the case, or has another rule to divide by, isn't taken for one that folds and divides."""
    parts = json.loads(open(FILE, encoding="utf-8").read())
    kept = parts | {"normalizer": {"type": "Sequence", "normalizers": [n for n in parts["normalizer"]["normalizers"] if n["type"] != "Lowercase"]}}
    other = json.loads(json.dumps(parts).replace(r"[\\p{N}]|", r"[\\p{N}]+|"))
    for name, changed in (("kept", kept), ("other", other)):
        assert changed != parts
        file = tmp_path / f"{name}.json"
        file.write_text(json.dumps(changed), encoding="utf-8")
        texts = ["Word word, (WORD) 12 a1B2 DON'T &'s", *ODD_CASES]
        encode, tokenizer = Encoder(str(file)), Tokenizer.from_file(str(file))
        assert encode.folded is None
        assert [x.tolist() for x in encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert Encoder(FILE).folded == [b"<|startoftext|>", b"<|endoftext|>"]
