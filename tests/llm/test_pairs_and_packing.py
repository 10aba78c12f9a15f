"""Near dedup, exact dedup and packing against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from slateflow.llm import exact_dedup, near_dedup, packing, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t):
    w = WORD.findall(low(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if n * 100 >= 75 * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, passage = [], [r.choice(vocabulary) for _ in range(60)]
    for family in range(25):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 8, 40, 90, 300, 700]))]
        for _ in range(r.choice([1, 1, 2, 5, 30])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            if family % 3 == 0:
                w += passage
            rows.append(" ".join(w))
    rows += ["", None, "  \t", "one", "ONE", "one two", "Straße É É É É x", "straße É É É É x"]
    r.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


def test_near_dedup_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute_components(rows)


def test_near_dedup_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", "y"), (2, None, "z")], "doc_id long, text string, value string")
    rows = near_dedup.near_duplicates(odd).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in rows) == [(0, 2, 1), (1, 2, 1), (1, 2, 1), (2, 0, 2)]
    assert {r.doc_id for r in near_dedup.keep_one_of_each(odd).collect()} == {1, 2}


def test_one_id_with_several_texts(spark):
    """Each text counts under its id, in any order of rows."""
    r = random.Random(4)
    a = " ".join(f"w{i}" for i in range(60))
    b, c = a + " end", " ".join(f"u{r.random()}" for _ in range(50))
    rows = [(1, a), (2, b), (2, c), (None, b + " more"), (None, "quite another text of six"), (4, c + " x"), (4, c + " x"), (4, "")]
    want = Counter([(1, 1), (2, 1), (2, 2), (None, 1), (None, None), (4, 2), (4, 2), (4, 4)])
    for order in (rows, rows[::-1], sorted(rows, key=lambda x: x[1])):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        assert Counter((x.doc_id, x.component_id) for x in near_dedup.near_duplicates(docs).collect()) == want
        assert Counter(map(tuple, near_dedup.keep_one_of_each(docs).collect())) == Counter([(1, a), (2, c), (None, "quite another text of six"), (4, "")])


def test_prefix_is_exact_for_small_sets():
    assert near_dedup.prefix_length(4) == 2 and near_dedup.prefix_length(90) == 23
    assert all(1 <= near_dedup.prefix_length(n) <= min(n, near_dedup.SKETCH) for n in range(1, 2000))


def test_words_match_the_pattern():
    import pyarrow as pa

    texts = ["Ab ab\x0bAB", None, "", "\xa0x y", "é É", "a" * 3000 + " b"]
    got = dict(words.documents_words(pa.array(texts)))
    assert [len(got[i]) for i in range(6)] == [3, 0, 0, 2, 2, 2]
    assert len(set(got[0].tolist())) == 1 and got[4][0] != got[4][1]


def test_exact_dedup_equals_brute_force(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["x", "X", "é", "É", "", None, f"t{i % 7}", f"u{i}"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    want = {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    assert {x.doc_id: (x.keep_id, x.group_size, x.kept) for x in exact_dedup.exact_dedup(df).collect()} == want
    assert {x.doc_id for x in exact_dedup.drop_copies(df).collect()} == {max(g) for g in groups.values()}


def test_exact_dedup_edges(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "a", 1), (5, "A", 2), (5, "A", 2), (None, "b", 3)], "doc_id long, text string, keep_id long")
    rows = exact_dedup.exact_dedup(df).collect()
    assert Counter((r.keep_id, r.group_size, r.kept) for r in rows) == Counter({(5, 3, True): 1, (5, 3, False): 2, (None, 1, True): 1})
    assert exact_dedup.drop_copies(df).columns == ["doc_id", "text", "keep_id"] and exact_dedup.drop_copies(df).count() == 2


@pytest.mark.parametrize("seed", range(6))
def test_packing_search(seed):
    r = random.Random(seed)
    lengths = [r.choice([r.randint(1, 100), r.randint(20, 60)]) for _ in range(r.randint(1, 60))]
    got = packing.bin_completion(lengths, 100)
    assert sorted(i for b in got for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 100 for b in got)
    assert -(-sum(lengths) // 100) <= len(got) <= len(packing.best_fit(lengths, 100))


def test_bin_completion_beats_best_fit():
    lengths = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6]  # best fit needs more than two sequences of 90
    assert len(packing.bin_completion([x for x in lengths], 90)) == 2


@pytest.mark.parametrize("low,high", [(300, 1500), (800, 2600)])
def test_large_group_beats_best_fit(low, high):
    r = random.Random(low)
    lengths = [r.randint(low, high) for _ in range(packing.GROUP)]
    fit, got, bound = packing.best_fit(lengths, 4096), packing.bin_completion(lengths, 4096), packing.lower_bound(lengths, 4096)
    assert sorted(i for b in got for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 4096 for b in got)
    assert bound <= len(got) < len(fit)


def test_batches_improve_a_group_that_the_dive_leaves(monkeypatch):
    monkeypatch.setattr(packing, "dive", packing.best_fit)
    r = random.Random(0)
    lengths = [r.randint(200, 400) for _ in range(600)]
    got = packing.bin_completion(lengths, 1000)
    assert sorted(i for b in got for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 1000 for b in got)
    assert packing.lower_bound(lengths, 1000) <= len(got) < len(packing.best_fit(lengths, 1000))


def test_lower_bound_holds():
    r = random.Random(8)
    for _ in range(200):
        # packings without room to spare, so that the fewest sequences are known
        whole, lengths = r.randint(1, 12), []
        for _ in range(whole):
            cuts = sorted(r.sample(range(1, 60), r.randint(0, 4)))
            lengths += [b - a for a, b in zip([0, *cuts], [*cuts, 60])]
        assert packing.lower_bound(lengths, 60) == whole
        some = [n for n in lengths if r.random() < 0.7]
        assert -(-sum(some) // 60) <= packing.lower_bound(some, 60) <= whole
    assert packing.lower_bound([31] * 5, 60) == 5 and packing.lower_bound([], 60) == 0


def test_packing_edges_and_round_trip(spark):
    from tokenizers import Tokenizer

    texts = ["", None, "Hello  World's <|endoftext|> 123 é\x0bé \x1c x", "a b c " * 3000, "Σς ΑΣ ÀÉ́ Zoë", "x\ny\r\nz w"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack_documents(df).collect()
    whole = Tokenizer.from_file(packing.vocabulary_path())
    import zlib

    for i, t in enumerate(texts):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [(r.start, r.length, r.ids_crc32) for r in mine] == [(a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for a in range(0, len(ids), 4096)]
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [2, 7, 400])
def test_blocks_connect_what_all_pairs_connect(spark, block):
    rows = [(i, t) for i, t in corpus(5) if t]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = spark.createDataFrame([(1, len(rows), i, i) for i, _ in rows], "hub long, n long, doc_id long, label long")
    found = near_dedup.components(near_dedup.links_between(groups, near_dedup.full_sets(docs), block))
    label = {r.node: r.label for r in found.collect()}
    assert {i: label.get(i, i) for i, _ in rows} == {i: c for i, (_, c) in brute_components(rows).items()}


def test_tokens_stay_the_same_when_rare_units_are_forgotten(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 30)
    words = packing.WordTokens(packing.vocabulary_path())
    for k in range(12):
        texts = [f"the common part, told again {chr(97 + k) * 3} {chr(98 + i) * (k + 1)} {k * 7919 + i}" for i in range(6)] + ["", "ünïcode 字"]
        for text, ids in zip(texts, words.encode_many(texts)):
            assert ids.tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
    assert "common" in words.known
