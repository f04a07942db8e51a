from skyloom.llm.line_dedup import line_dedup


def brute(rows, window=3):
    first = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        for i in range(len(lines) - window + 1 if doc is not None and text is not None else 0):
            k = tuple(lines[i:i + window])
            first[k] = min(first.get(k, (doc, i)), (doc, i))
    out = []
    for doc, text in rows:
        lines = [] if text is None else text.split("\n")
        gone = {i + j for i in range(len(lines) - window + 1) if doc is not None and first[tuple(lines[i:i + window])] < (doc, i) for j in range(window)}
        out.append((doc, len(lines), len(gone), None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return sorted(out, key=repr)


def check(df, window=3):
    got = sorted((tuple(r) for r in line_dedup(df, window).collect()), key=repr)
    assert got == brute([(r["doc_id"], r["text"]) for r in df.collect()], window)
    return got


def test_given_documents(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_odd_rows(spark):
    p = "a\nb\nc\nd"
    rows = [(1, p), (2, "x\n" + p + "\ny"), (3, p + "\n" + p), (3, p), (3, p), (None, p), (None, None), (4, None), (5, ""), (6, "\n\n\n\n"), (7, "\n\n"),
            (8, "a\nb"), (9, "long " * 100_000 + "\nb\nc"), (10, "z\n" * 20_000), (-1, "b\nc\nd"), (11, "a\r\nb\nc")]
    for window in (1, 2, 3):
        check(spark.createDataFrame([(a, b, 1, "l") for a, b in rows], "doc_id long, text string, line int, lines string"), window)
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
