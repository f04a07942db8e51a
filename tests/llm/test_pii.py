import random
import re

import pytest

from skyloom.llm import pii
from skyloom.llm.pii import base_spans, personal_data


IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain(text):
    out = [(m.start(), 0, m.end()) for m in pii.EMAIL.finditer(text)] if "@" in text else []
    out += [(m.start(), 1, m.end()) for m in (IP.finditer(text) if "." in text else ()) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in pii.CARD.finditer(text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 12 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in pii.PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


@pytest.mark.parametrize("alphabet", ["ab.@-", "01.@+ -()", "019. +-", "aé@b.c1\n"])
def test_base_spans_against_plain_search(alphabet):
    rng = random.Random(5)
    for n in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60)))
        assert base_spans(text) == plain(text), text


def test_base_of_given_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r for r in personal_data(df).collect()}
    found = 0
    for r in df.collect():
        want = plain(r["text"])
        found += len(want)
        assert got[r["doc_id"]]["base"] == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert set(got[r["doc_id"]]["base"].split(",")) - {""} <= set(got[r["doc_id"]]["spans"].split(","))
    assert found


def test_contexts_find_what_expressions_miss(spark):
    rows = [(i, f"words here mail me at user{i}@host{i}.org today or so") for i in range(12)]
    rows += [(20, "please mail me at odd.user(at)host today"), (21, "please mail me at user99@intranet today"), (22, "chapter 12 of 99 at 4711 in room 5")]
    got = {r["doc_id"]: r for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[21]["spans"] == "email:18:33" and got[21]["base"] == "" and got[21]["n_email"] == 1
    assert got[20]["spans"] == "" and got[22]["spans"] == ""
    assert got[3]["spans"] == got[3]["base"] == "email:22:37"


def test_odd_rows(spark):
    mail = "x a@b.co"
    rows = [(1, None), (2, ""), (3, mail), (3, mail), (None, mail), (None, None), (4, "1" * 100_000), (5, "w " * 100_000 + "10.0.0.1"), (6, "+49 (30) 1234567."),
            (7, "4111 1111 1111 1111 and 4111111111111112"), (8, "1.2.3.256 0001.2.3.4")]
    df = spark.createDataFrame([(a, b, "r", 1) for a, b in rows], "doc_id long, text string, spans string, row long")
    got = sorted((tuple(r) for r in personal_data(df).collect()), key=repr)
    want = sorted(((d, *[sum(k == i for _, k, _ in plain(t or "")) for i in range(4)], s := ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in plain(t or "")), s) for d, t in rows), key=repr)
    assert got == want
    assert personal_data(df.limit(0)).collect() == []
