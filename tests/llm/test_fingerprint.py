"""Fingerprints and edits as Spark computes them against plain Python."""

import hashlib
import random

import pytest

from slateflow.llm import fingerprint

MASK = (1 << 64) - 1


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def marks(text):
    """The smallest hashes of the phrases, which are parsed and hashed character by character."""
    phrases, now = set(), ""
    for c in text:
        now += c
        if now not in phrases:
            phrases.add(now)
            now = ""
    values = set()
    for p in phrases:
        h = 0
        for c in p:
            h = (h * int(fingerprint._STEP) + mix((ord(c) + int(fingerprint._SALT)) & MASK)) & MASK
        values.add(mix(h) >> 32)
    return sorted(values)[: fingerprint.K]


def like(a, b):
    low = sorted({*a, *b})[: fingerprint.K]
    return sum(v in a and v in b for v in low) / len(low) if low else 1.0


def as_hex(values):
    return "".join(f"{v:08x}" for v in values)


def brute(ordered):
    """The rows' results, in order; ``ordered`` has (doc_id, text)."""
    out = []
    for (i, t), (_, following) in zip(ordered, [*ordered[1:], *ordered[:1]]):
        t, following = t or "", following or ""
        edited = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        out.append((i, len(t), sha, as_hex(marks(t)), as_hex(marks(edited)), pytest.approx(like(marks(t), marks(edited))), pytest.approx(like(marks(t), marks(following)))))
    return out


def corpus(r, n):
    words = ["the", "a", "é𝄞", "lorem", "ipsum", "\n", "  ", "zzz", "0"]
    return [r.choice([None, "", "x", " ".join(r.choice(words) for _ in range(r.randint(1, 300)))]) for _ in range(n)]


@pytest.mark.parametrize("width,parts,n", [(1, 1, 12), (3, 5, 60), (7, 2, 60), (9, 3, 4), (4, 1, 1), (4, 2, 2)])
def test_edits_equal_brute_force(spark, width, parts, n):
    r = random.Random(width * n)
    ids = r.sample(range(-500, 500), n)
    rows = list(zip(ids, corpus(r, n)))
    docs = spark.createDataFrame([(*x, 1, "s", 0) for x in rows], "doc_id long, text string, part int, spread string, ghost int").repartition(parts)
    got = sorted((tuple(g) for g in fingerprint.compare_with_edits(docs, width).collect()), key=lambda g: -g[0])
    assert got == brute(sorted(rows, key=lambda x: -x[0]))


def test_missing_and_repeated_ids(spark):
    """Rows without an id come last, by the hash of their texts; of one id the larger text comes first."""
    from pyspark.sql import functions as F

    r = random.Random(5)
    texts = corpus(r, 30)
    rows = [(None if i % 3 == 0 else i // 4, t) for i, t in enumerate(texts)] + [(2, "same"), (2, "same"), (None, "same"), (None, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = F.coalesce("text", F.lit(""))
    ordered = docs.select("doc_id", text.alias("text")).orderBy(F.col("doc_id").desc_nulls_last(), F.when(F.col("doc_id").isNull(), F.xxhash64(text)), text.desc()).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:5])
    for width in (1, 4, 50):
        got = sorted((tuple(g) for g in fingerprint.compare_with_edits(docs.repartition(3), width).collect()), key=key)
        want = sorted(brute([tuple(x) for x in ordered]), key=key)
        assert sorted(g[:5] for g in got if g[0] is not None) == sorted(w[:5] for w in want if w[0] is not None)
        assert [g[:5] for g in got] == [w[:5] for w in want]
    assert fingerprint.compare_with_edits(docs.limit(0)).count() == 0


def test_fingerprints_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "abab" * 5000), (3, "abab" * 5000), (None, "x")]
    got = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(g.doc_id, g.n_chars, g.fingerprint) for g in got] == [(i, len(t or ""), as_hex(marks(t or ""))) for i, t in rows]


def test_repeated_ids_with_long_texts_add_no_rows(spark):
    """Copies of the row that opens a range follow the range before it, in slices and batches of their own."""
    rows = [(i, f"{i}-{k} " + "lorem ipsum " * 58_000 if i % 10 == 0 and k else f"text {i} {k}") for i in range(40) for k in range(4 if i % 10 == 0 else 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for batch in ("1", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = fingerprint.compare_with_edits(docs, 4).select("doc_id", "n_chars", "edited_sha256").collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        ordered = sorted(rows, key=lambda x: x, reverse=True)
        want = [(i, len(t), hashlib.sha256((t[: len(t) - len(t) // 3] + f[: len(t) // 3]).encode()).hexdigest()) for (i, t), (_, f) in zip(ordered, [*ordered[1:], *ordered[:1]])]
        assert sorted(map(tuple, got)) == sorted(want)
