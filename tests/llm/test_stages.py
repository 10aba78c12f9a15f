"""The pipeline's stages on awkward tables, and the whole pipeline against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from slateflow.llm import exact_dedup, mixing, near_dedup, packing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with names that stages might use themselves.
CLASHES = "key string, row string, size int, taken int, positions string, _id string, digest string, id int, kept int, number int"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^ \t-\r]+", t or "")


def with_clashes(spark, rows):
    return spark.createDataFrame([(*r, "k", "r", 1, 2, "p", "i", "d", 3, 4, 5) for r in rows], f"{SCHEMA}, {CLASHES}")


def awkward(r, n=60):
    pool = ["", " ", None, "one", "A b c", "a B c", "x " * 50, "é ü"] + [" ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(1, 40))) for _ in range(n // 2)]
    rows = [(i if r.random() < 0.9 else None, r.choice(pool), "en", r.choice(["s", "t", None]), 7) for i in range(n)]
    return rows + rows[:5] + [(3, "other text", "en", "s", 7)]


def taken_out(rows):
    """Rows of the stage as plain tuples of the documents' columns, without order."""
    return Counter(tuple(x)[:5] for x in rows)


@pytest.mark.parametrize("seed", range(3))
def test_exact_dedup_keeps_the_last_row_of_each_text(spark, seed):
    rows = awkward(random.Random(seed))
    docs = with_clashes(spark, rows)
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    best = {}
    for i, t, *rest in rows:
        k = lower(t)
        if k not in best or (best[k] is None and i is not None) or (i is not None and i > best[k]):
            best[k] = i
    got = out.collect()
    assert Counter((x.doc_id, lower(x.text)) for x in got) == Counter((i, k) for k, i in best.items())
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0


def test_near_dedup_keeps_one_row_of_each_component(spark):
    rows = awkward(random.Random(1)) + [(50, "a b c d e f g h i j k l m n o p", "en", "s", 7), (3, "a b c d e f g h i j k l m n o p q", "en", "s", 7)]
    docs = with_clashes(spark, rows)
    out = near_dedup.keep_one_of_each(docs)
    assert out.columns == docs.columns
    names = sorted({(x[0] is None, x[0] or 0, x[1] or "") for x in rows})
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(lower(t))) else set() for *_, t in names]
    of = list(range(len(names)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                of = [min(of[i], of[j]) if x in (of[i], of[j]) else x for x in of]
    left = Counter((x.doc_id is None, x.doc_id or 0, x.text or "") for x in out.collect())
    assert set(left.values()) == {1}
    by = defaultdict(list)
    for name, c in zip(names, of):
        by[c].append(name)
    for members in by.values():
        (winner,) = [m for m in members if m in left]
        assert winner[:2] == members[0][:2]
    assert len(by) == len(left) < len(names)


@pytest.mark.parametrize("seed", range(3))
def test_mix_reads_every_row_as_planned(spark, seed):
    """Repeated and missing ids multiply nothing: the words that come out are the words that the mix takes."""
    rows = awkward(random.Random(seed))
    docs = with_clashes(spark, rows)
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    plan = defaultdict(int)
    for x in mixing.mix(docs).collect():
        plan[x.doc_id, x.source, x.size] += x.taken
    got = defaultdict(int)
    for x in out.collect():
        full = [t for i, t, _, s, _ in rows if (i, s) == (x.doc_id, x.source) and (t or "").startswith(x.text)]
        assert full
        got[x.doc_id, x.source, max(len(words(t)) for t in full if len(words(t)) >= len(words(x.text)))] += len(words(x.text))
    by_id = lambda d: {k: v for k, v in Counter({(i, s): 0 for i, s, _ in d}).items()}
    total, want = by_id(plan), by_id(plan)
    for (i, s, _), v in got.items():
        total[i, s] += v
    for (i, s, _), v in plan.items():
        want[i, s] += v
    assert total == want
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_classifier_stage_is_the_score(spark):
    r = random.Random(2)
    good = lambda: " ".join(r.choice(["the", "river", "house", "slowly", "winter"]) for _ in range(40)) + "."
    bad = lambda: "".join(r.choice("$#@!x0") for _ in range(200))
    rows = [(i, good() if i % 2 else bad(), "en", "s", 1) for i in range(60)] + [(None, good(), "en", "s", 1), (100, None, "en", "s", 0), (101, "", "en", "s", 0), (3, bad(), "en", "s", 1), (3, bad(), "en", "s", 1)]
    docs = with_clashes(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(7, 1, 0), (200, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    scored = quality.score_quality(docs, labels).collect()
    assert len(scored) == len(rows) and all(0 <= s.score <= 1 and s.predicted == (s.score >= 0.3) for s in scored)
    assert all(s.held_out == (s.doc_id is not None and zlib.crc32(str(s.doc_id).encode()) % 5 == 0) for s in scored)
    assert {s.predicted for s in scored if s.doc_id is not None and s.doc_id < 60 and s.doc_id != 3} == {0, 1}
    out = quality.keep_good(docs, labels)
    assert out.columns == docs.columns and len(out.collect()) == sum(s.predicted for s in scored)
    assert quality.keep_good(docs.limit(0), labels).count() == 0


def convolved(p, data):
    """A text's score from the parameters ``p``, written out: byte by byte, place by place, filter by filter."""
    n = max(1, math.ceil(max(len(data) - 64, 1) / 256))
    padded = list(data) + [256] * (256 * (n - 1) + 320 - len(data))
    maxima = []
    for c in range(n):
        chunk = padded[256 * c : 256 * c + 320]
        best = [-math.inf] * 48
        for at in range(0, 320 - 8 + 1, 2):
            seen = np.concatenate([p["embed"][byte] for byte in chunk[at : at + 8]])
            for f in range(48):
                best[f] = max(best[f], float(seen @ p["filters"][:, f]))
        maxima.append([math.tanh(b + float(p["filter_bias"][f])) for f, b in enumerate(best)])
    columns = list(zip(*maxima))
    v = [*(sum(c) / n for c in columns), *map(min, columns), *map(max, columns)]
    h = [max(0.0, sum(v[i] * float(p["hidden"][i, j]) for i in range(len(v))) + float(p["hidden_bias"][j])) for j in range(24)]
    z = sum(x * float(w) for x, w in zip(h, p["out"])) + float(p["out_bias"][0])
    return 1 / (1 + math.exp(-z))


def test_scores_equal_a_written_out_convolution(spark):
    """Of any length, alone or in company, from a network that is fitted and through Spark."""
    r = np.random.default_rng(1)
    texts = [bytes(r.integers(32, 127, n, dtype=np.uint8)) for n in (0, 1, 63, 320, 321, 2000)]
    net = quality.fit([b"good words here " * 9, b"$$$$ ####" * 20] * 10, [1, 0] * 10, steps=30)
    want = [convolved(net.p, t) for t in texts]
    assert len({round(w, 3) for w in want}) > 2
    assert np.allclose(net.score([np.frombuffer(t, np.uint8) for t in texts], net.tables(), at_once=2), want, atol=1e-5)
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert np.allclose([x.score for x in sorted(quality.score_documents(docs, net).collect())], want, atol=1e-5)


def test_gradients_equal_differences():
    """What a step says of each parameter is what moving that parameter does to the loss."""
    r = np.random.default_rng(3)
    texts = [r.integers(97, 123, n, dtype=np.uint8) for n in (0, 30, 400, 1500)]
    y, w = np.array([1, 0, 1, 0], np.float32), np.array([0.5, 1, 1, 2], np.float32)
    net = quality.Network(2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    tables = net.tables
    net.tables = lambda: np.stack([net.p["embed"] @ net.p["filters"][j * 8 : (j + 1) * 8] for j in range(8)])
    g, _ = net.step(texts, y, w)
    for name, value in net.p.items():
        for at in [tuple(r.integers(0, n) for n in value.shape) for _ in range(6)] + ([(100, 3), (256, 1)] if name == "embed" else []):
            before, losses = value[at], []
            for d in (1e-5, -1e-5):
                value[at] = before + d
                losses.append(net.step(texts, y, w)[1])
            value[at] = before
            assert abs((losses[0] - losses[1]) / 2e-5 - float(np.asarray(g[name])[at])) < 1e-4, (name, at)
    assert tables is not net.tables


def test_the_sample_is_bounded_by_rows(spark):
    """However many rows an id is on; whole texts are taken."""
    long = "word " * 30_000
    docs = spark.createDataFrame([(i % 2 + 1, f"text {i}") for i in range(1000)] + [(3, long), (3, long), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 6)] + [(3, 0, 0)], "doc_id long, quality int, toxic int")
    assert len(quality.labelled_sample(docs, labels, rows=2)) == 2
    every = quality.labelled_sample(docs, labels)
    learned = [i for i in (1, 2, 3, 4) if zlib.crc32(str(i).encode()) % 5]
    assert len(every) == sum({1: 500, 2: 500, 3: 1, 4: 1}[i] for i in learned)
    assert (long.encode(), 0) in every or 3 not in learned


def test_pipeline_equals_plain_python(spark, tmp_path):
    r = random.Random(9)
    vocabulary = [f"{a}{b}{c}" for a in "bdklmr" for b in "aeiou" for c in ("n", "st", "ra", "lo")]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n)) + "."
    texts = [prose(r.randint(20, 90)) for _ in range(70)]
    near = [t + " " + r.choice(vocabulary) for t in texts[:12]]
    junk = ["".join(r.choice("$#@!%0") for _ in range(300)) for _ in range(40)]
    every = texts + near + [t.upper() for t in texts[5:9]] + texts[:3] + junk + [None, ""]
    r.shuffle(every)
    rows = [(10 + 3 * i, t, "en", r.choice(["s", "t", None]), len(t or "")) for i, t in enumerate(every)]
    labels = [(i, int(t in texts or t in near), 0) for i, t, *_ in rows if t and i % 2]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    # the classifier is a trained network: its own scores say which rows come through
    scores = {x.doc_id: x.predicted for x in quality.score_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    left = [x for x in rows if scores[x[0]]]
    assert len(left) < len(rows)
    last = {}
    for x in left:
        last[lower(x[1])] = max(last.get(lower(x[1]), -1), x[0])
    left = [x for x in left if last[lower(x[1])] == x[0]]
    sets = {x[0]: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(lower(x[1]))) else set() for x in left}
    component = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and component[a] != component[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    component[a] = component[b] = min(component[a], component[b])
                    changed = True
    left = [x for x in left if component[x[0]] == x[0]]
    by = defaultdict(list)
    for x in left:
        by[x[3]].append(x)
    sizes = {s: sum(len(words(x[1])) for x in v) for s, v in by.items()}
    ranked = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(ranked)}
    budget, open_ = 1.5 * sum(sizes.values()), set(ranked)
    target = {}
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        target |= {s: 2 * sizes[s] for s in over} if over else {s: level * weight[s] for s in open_}
        open_ -= over if over else open_
    mixed = []
    for s, v in by.items():
        v.sort(key=lambda x: ((x[0] % 2147483648 * mixing.MULTIPLIER) % mixing.MODULUS, x[0]))
        room = math.floor(target[s])
        for _ in range(2):
            for x in v:
                n = min(len(words(x[1])), room)
                room -= n
                if n:
                    mixed.append((x[0], x[1] if n == len(words(x[1])) else "".join(re.findall(r"[ \t-\r]*[^ \t-\r]+", x[1])[:n])))
    tokens = packing.WordTokens(packing.vocabulary_path())
    want = Counter()
    for i, t in mixed:
        ids = np.append(tokens.tokenizer.encode(t, add_special_tokens=False).ids, 1).astype("<u4")
        want.update((i, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096)))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == want
    places = defaultdict(list)
    for g in got:
        places[g.sequence_id].append((g.offset, g.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 4096
