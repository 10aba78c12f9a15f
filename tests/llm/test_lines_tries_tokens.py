"""Line dedup, the prefix trie and token alignment against brute force on small tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from slateflow.llm import alignment, line_dedup, prefix_trie

BLANKS = " \t\n\x0b\x0c\r"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def brute_lines(rows):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = low(line.strip(BLANKS))
            if len(k) >= 20:
                holders[k].add((i is not None, i or 0))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            k = low(line.strip(BLANKS))
            h = holders.get(k, set())
            if len(k) < 20 or len(h) < 3 or max(h) == (i is not None, i or 0):
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return Counter(out)


LONG = ["All rights reserved by the makers", "  all RIGHTS reserved by the makers\t", "nineteen characters", "exactly twenty chars", "ÄÖÜ äöü ÄÖÜ äöü ÄÖÜ ä", "subscribe to our newsletter now", "x\x00y a line with a zero in it"]


@pytest.mark.parametrize("width", [1, 3, 16])
def test_lines_against_brute_force(spark, width):
    rng = random.Random(width)
    rows = []
    for i in range(120):
        lines = [rng.choice([*LONG, "", " ", f"a line that only {i} has, or nearly", "the one very common line of all"]) for _ in range(rng.randrange(0, 12))]
        rows.append((rng.choice([i, i, i % 7, None]), rng.choice(["\n".join(lines), "\n".join(lines) + "\n", None if rng.random() < 0.1 else "\n".join(lines)])))
    rows += rows[:5] + [(5, "the one very common line of all\n" * 400)] + [(i, "the one very common line of all") for i in range(200, 500)]
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1))
        got = line_dedup.with_bitmaps(docs).select("row.doc_id", "n_lines", "n_dropped", F.sha2(line_dedup.kept_text(), 256).alias("s")).collect()
        bitmaps = line_dedup.keep_bitmaps(docs).collect()
        texts = line_dedup.drop_repeated_lines(docs.withColumn("n_chars", F.char_length("text"))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = brute_lines(rows)
    assert Counter(tuple(r) for r in got) == want
    assert sorted(r.n_dropped for r in bitmaps) == sorted(k[2] for k in want.elements())
    for r in bitmaps:
        assert int(np.unpackbits(np.frombuffer(zlib.decompress(r.keep), np.uint8), count=r.n_lines).sum()) == r.n_lines - r.n_dropped
    assert Counter((r.doc_id, sha(r.text or "")) for r in texts) == Counter((k[0], k[3]) for k in want.elements())
    assert all(r.n_chars == len(r.text) for r in texts if r.text is not None)


def test_lines_of_an_empty_table(spark):
    assert line_dedup.keep_bitmaps(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_streaming_gives_the_same_in_batches_of_any_size():
    import pyarrow as pa

    rows = sorted(((h, 0, True, -d, 0, p) for h, n in ((1, 2), (2, 5), (3, 1), (4, 3), (5, 9)) for d in range(n) for p in range(1 + d % 3)))
    names = ["h1", "h2", "known", "id", "mark", "pos"]
    results = set()
    for size in (1, 2, 3, 7, 100):
        batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[a : a + size]], pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("known", pa.bool_()), ("id", pa.int64()), ("mark", pa.int64()), ("pos", pa.int32())])) for a in range(0, len(rows), size)]
        results.add(tuple(sorted(tuple(r.values()) for b in line_dedup._stream(batches, 3) for r in b.to_pylist())))
    assert len(results) == 1


def brute_trie(rows, rebuild=True):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in by.items()}
    if rebuild:
        new = {}
        for c, ts in convs.items():
            h = zlib.crc32(str(c).encode()) % 6
            base = int(abs(c) // 100 * 100) * (1 if c >= 0 else -1)
            new[c] = convs.get(base, [])[:h] + ts[h:]
        convs = new
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    out = []
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], sha(ends)))
    return Counter(out)


def conversations(rng, convs, deep):
    rows = []
    for c in convs:
        n = deep if c % 50 == 1 else rng.randrange(1, 9)
        for t in range(n):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "b", "", None, "longer text", "ÄÖ"])))
    return rows + rows[:7] + [(None, 1, "user", "lost")]


@pytest.mark.parametrize("deep,rebuild", [(9, True), (70, True), (300, False)])
def test_trie_against_brute_force(spark, deep, rebuild, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BAND", 4)
    monkeypatch.setattr(prefix_trie, "HEAVY", 50)
    rng = random.Random(deep)
    rows = conversations(rng, [*range(0, 260, 3), 1000, 1001, *range(-230, -180, 7), 5_000_000_000], deep)
    rows += [(c, 0, "user", "hot") for c in range(3000, 3300)]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("other")), rebuild).collect()
    assert Counter(tuple(r) for r in got) == brute_trie(rows, rebuild)


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), True).collect() == []


@pytest.fixture(scope="module")
def tokenizers_():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def byte_level():
    """The byte of each character that a byte-level vocabulary writes bytes with."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute_alignment(rows, tokenizers_):
    a, b = tokenizers_
    byte_of = byte_level()
    docs, count = [], Counter()
    for doc_id, text in rows:
        ids_a, ids_b, spans = [], [], [[], []]
        if text:
            e = a.encode(" " + text, add_special_tokens=False)
            ids_a, ids_b = e.ids, b.encode(text)
            tokens = [[bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a], [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]]
            if any(b"".join(t) != (" " + text).encode() for t in tokens):
                ids_a, ids_b = [], []
            else:
                for s, t in zip(spans, tokens):
                    at = 0
                    for x in t:
                        s.append((at, at + len(x)))
                        at += len(x)
        links = [(i, j) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if x[0] < y[1] and y[0] < x[1]] if len(ids_a) < 400 else None
        if links is None:  # the same by two fingers
            links, j = [], 0
            for i, x in enumerate(spans[0]):
                while spans[1][j][1] <= x[0]:
                    j += 1
                k = j
                while k < len(spans[1]) and spans[1][k][0] < x[1]:
                    links.append((i, k))
                    k += 1
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, sp) if start <= s and e <= end) for ids, sp in ((ids_a, spans[0]), (ids_b, spans[1]))) if len(ids_a) < 400 else None)
            start = end
        pairs = [(ids_a[i], ids_b[j]) for i, j in links]
        count.update(pairs)
        docs.append((doc_id, len(ids_a), len(ids_b), len(ends), pairs, groups))
    best = {}
    for (x, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for doc_id, n_a, n_b, n_groups, pairs, groups in docs:
        digest = "" if not n_a else None if None in groups else sha(";".join(groups))
        out.append((doc_id, n_a, n_b, n_groups, len(pairs), sum(count[p] == best[p[1]] for p in pairs), sum(count[p] for p in pairs), digest))
    return out


TEXTS = ["", None, " ", "  ", "a", " a", "a ", "a  b", "a \n b", "the cat sat on the mat", "The  cat\n\n sat  ", "\n", "\t tab", "a▁b", "▁", "<s>x</s> <|endoftext|>", "café naïve 中文字 \U0001f600\U0001f926\U0001f3fc", "it's we'll I'M 's", "x" * 700 + " " + "y" * 300, " " * 50 + "code" + " " * 30, "1234567 89.10, (a) [b]", "a b　c d", "\x00 zero", "a\r\nb \x1c c d", "é ﬁ ²"]


def test_alignment_against_brute_force(spark, tokenizers_, monkeypatch):
    rng = random.Random(11)
    words = ["the", "cat", "mat", "token", "tokenization", "Über", "straße", "it's", "naïve", "12", "(x)", "\n", "", "中文", "don't", "a\n"]
    rows = list(enumerate([*TEXTS, *(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(150))]))
    rows += [(None, "the cat"), (3, "the mat"), (3, "the mat")]
    want = brute_alignment(rows, tokenizers_)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("run", F.lit(0)).repartition(7)
    got = [tuple(r) for r in alignment.align(docs).collect()]
    assert Counter(got) == Counter(want)


def test_alignment_in_small_buffers_and_rounds(tokenizers_, monkeypatch):
    """Buffers, runs and merges of a few pairs give the same counts as a dictionary."""
    monkeypatch.setattr(alignment, "BLOCK", 3)
    monkeypatch.setattr(alignment, "PENDING", 5)
    rng = np.random.default_rng(5)
    runs, total = [], Counter()
    for _ in range(40):
        p = np.unique(rng.integers(0, 60, rng.integers(1, 40)) << rng.integers(0, 2) * 16)
        c = rng.integers(1, 9, len(p))
        total.update(dict(zip(p.tolist(), c.tolist())))
        runs.append(alignment.sums_run(p, c))
    p, c = (np.concatenate(x) for x in zip(*alignment.merge(runs)))
    assert (np.diff(p) > 0).all() and dict(zip(p.tolist(), c.tolist())) == total
    top = {}
    for k, n in total.items():
        top[k >> 16] = max(top.get(k >> 16, 0), n)
    assert alignment.best_of(p, c).tolist() == [total[k] == top[k >> 16] for k in p.tolist()]
    key = np.sort(rng.integers(0, 40, 900) << 16 | rng.integers(0, 50, 900))
    pairs, docs = key >> 16, key & 0xFFFF
    times = rng.integers(1, 900, 900)
    own, number, d, t = alignment.read_records(alignment.record_run(pairs, docs, times))
    assert own[number].tolist() == pairs.tolist() and d.tolist() == docs.tolist() and t.tolist() == times.tolist()


def test_alignment_of_an_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_remembered_units_change_nothing(tokenizers_, monkeypatch):
    units = alignment.Units(alignment.Vocabularies(*alignment.default_paths()))
    texts = [t for t in TEXTS if t] * 2
    first = units.align_many(texts)
    monkeypatch.setattr(alignment, "REMEMBERED", 0)
    for i, t in enumerate(texts):
        counts, groups, pairs = units.align_many([t])
        assert counts[0].tolist() == first[0][i].tolist() and groups == [first[1][i]] and len(pairs) == counts[0, 3]
