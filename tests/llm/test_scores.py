"""Stupid backoff and the mix against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from slateflow.llm import lm_score, mixing


def brute(rows):
    """doc -> (words, score); a document is all rows of one id."""
    one, two, having, starts = Counter(), Counter(), defaultdict(set), 0
    pairs = defaultdict(list)
    for i, t in rows:
        w = ["", *re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
        starts += len(w) > 1
        pairs[i] += zip(w, w[1:])
        one.update(w[1:])
        two.update(zip(w, w[1:]))
        for b in zip(w, w[1:]):
            having[b].add(i)
    total, context = sum(one.values()), one | {"": starts}
    return {
        i: (len(found), sum(math.log(two[b] / context[b[0]]) if len(having[b]) > 1 else math.log(lm_score.ALPHA * one[b[1]] / total) for b in found))
        for i, found in pairs.items()
    }


@pytest.mark.parametrize("words,hot", [(1 << 19, 1 << 16), (40, 1 << 16), (40, 0), (0, 0)])
def test_scores_equal_brute_force(spark, monkeypatch, words, hot):
    """However many words are coded and bigrams hot, the scores are the same."""
    monkeypatch.setattr(lm_score, "WORDS", words)
    monkeypatch.setattr(lm_score, "HOT", hot)
    monkeypatch.setattr(lm_score, "SAMPLE", 2)
    r = random.Random(6)
    vocabulary = [f"v{int(r.paretovariate(0.7)) % 500}" for _ in range(2000)]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 2, 30, 120])))) for i in range(80)]
    rows += [(200, rows[5][1]), (201, "Same " * 400), (202, "same start"), (203, "É x\u00a0y\n z"), (204, "é X\u00a0Y z"), (205, "only only once"), (206, "rare1 rare2"), (207, "rare1\trare2")]
    got = lm_score.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = brute(rows)
    assert {g.doc_id: (g.n_words, g.log_score) for g in got} == {i: (n, pytest.approx(s, abs=1e-8)) for i, (n, s) in want.items()}
    assert len(got) == len(rows)


def test_repeated_and_missing_ids(spark):
    """Repeated ids are parts of one document and so don't vouch for each other; nor do rows without an id."""
    rows = [(1, "a b c"), (1, "a b d"), (1, "a b c"), (2, "a b"), (None, "c d"), (None, "b c d"), (3, None), (4, " "), (5, "a b c"), (6, "u v"), (6, "u v")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, doc int, key string").repartition(5)
    got = lm_score.score(docs).collect()
    assert {g.doc_id: (g.n_words, g.log_score) for g in got} == {i: (n, pytest.approx(s, abs=1e-9)) for i, (n, s) in brute(rows).items()}
    assert len(got) == 7 and all((g.mean_log_score is None) == (g.n_words == 0) for g in got)
    assert lm_score.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_mix_meets_its_targets(spark):
    r = random.Random(8)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", None]), " ".join("w" * r.choice([1, 3, 40]))) for i in range(400)] + [(900, "d", None), (901, "e", "")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    by = defaultdict(list)
    for g in got:
        assert 0 <= g.taken <= 2 * g.size and len(g.positions) == -(-g.taken // g.size if g.size else 0)
        by[g.source].append(g)
    assert all(sum(g.taken for g in v) == math.floor(v[0].target) for v in by.values())
    total = sum(g.size for g in got)
    assert abs(sum(v[0].target for v in by.values()) - 1.5 * total) < 1e-6
