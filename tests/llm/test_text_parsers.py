"""PII spans, fingerprints, main text and the classifier, without Spark."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from slateflow.llm import fingerprint, html_text, mixing, pii, quality


def base_spans(t):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@pytest.mark.parametrize("seed", range(20))
def test_base_spans_equal_the_patterns(seed):
    r = random.Random(seed)
    bits = ["a", "b.", "@", "x@y.z", ".", "-", " ", "+", "1", "255", "256", "+1 (212) 555-1234", "4111 1111 1111 1111", "10.0.0.1", "é", "(", "\n", "account ", "token = ", "://"]
    for _ in range(300):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 25)))
        assert [s for s in pii.find(t) if s[2] in pii.BASE_KINDS] == base_spans(t), repr(t)


def test_long_runs_and_extra_kinds():
    assert pii.find("1" * 50_000 + "@" * 10 + "." * 10) == []
    kinds = {k for _, _, k in pii.find('IBAN DE89370400440532013000, see https://u:p@host/x token = "abcdef0123456789abcdef"')}
    assert {"account", "url", "secret"} <= kinds


def test_fingerprint_resumes():
    t = "the quick brown fox " * 40 + "é𝄞"
    for cut in (0, 1, 333, len(t)):
        entries = {}
        fingerprint.parse(t[cut:], entries, fingerprint.parse(t[:cut], entries))
        assert np.array_equal(fingerprint.signatures([fingerprint.keys_of(entries)])[0], fingerprint.fingerprint_text(t))
    a, none = fingerprint.fingerprint_text(t), fingerprint.fingerprint_text("")
    assert fingerprint.likenesses([a, a, none], [a, none, none]).tolist() == [1.0, 0.0, 1.0]
    assert np.array_equal(fingerprint.from_hex(fingerprint.as_hex(a)), a)


def test_main_text():
    model = html_text.fitted()
    page = '<body><nav><ul><li><a href=/a>Home</a></ul></nav><article><h1>Title &amp; more</h1><p>One  two.<p><b>Three<br>four<script>x("</p>")</script></article><div class="comments"><p>I like it a lot.</p></div><footer>&copy; me</footer>'
    assert html_text.extract_many([page, ""], model) == ["Title & more\nOne two.\nThree four", ""]


def test_text_around_embedded_elements_stays():
    def text_of(page):
        return [t for _, t in html_text.parse(page, html_text.Tree())]

    assert text_of('<p>One <svg width="1"/>two</p><p>three</p>') == ["One two", "three"]
    assert text_of("<p>One <svg><text>x</text></svg>two</p>") == ["One two"]
    assert text_of("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold <math/>so</p>") == ["Let x=1 hold so"]
    assert text_of("<p>One <object data=a>two</object> <noscript>three</noscript> <object>four</p><p>five</p>") == ["One two three four", "five"]
    for tag in ("select", "iframe", "template", "textarea", "title", "svg"):
        assert text_of(f"<p>One <{tag}>two</p><p>three <{tag}>four</p>") == ["One two", "three four"]
        assert text_of(f"<p>One <{tag}>two</{tag}></p><p>three</p>") == ["One", "three"]
    assert text_of("<p>One</p><script>var two") == ["One"]


def test_chunks_cover_the_text():
    for n in (0, 1, 64, 319, 320, 321, 576, 577, 5000):
        data = np.arange(n) % 256
        chunks = quality.chunks_of(data.astype(np.uint8))
        seen = np.concatenate([chunks[0], *(c[quality.CHUNK - quality.STEP :] for c in chunks[1:])])
        assert np.array_equal(seen[:n], data) and (seen[n:] == quality.PAD).all()


def test_classifier_learns_and_scores_alone():
    good, bad = [b"plain words in a row, told calmly. " * k for k in range(1, 30)], [b"BUY!! NOW!! *** " * k for k in range(1, 30)]
    net = quality.fit(good + bad, [1] * 29 + [0] * 29, steps=60)
    s = net.score([np.frombuffer(t, np.uint8) for t in (good[5], bad[5], b"")], net.tables())
    assert s[0] > 0.7 > 0.3 > s[1] and 0 <= s[2] <= 1


def test_schedules_integrate_to_their_weights():
    assert [mixing.integral(k) for k in mixing.SCHEDULES] == [3, 1, 2]


@pytest.mark.parametrize("piece", ["mailto:", "://a@", "token=", "x://", "account 1", "+1(", "1.", "1-", "a@b.", "@", "iban "])
def test_spans_of_a_long_text_take_time_in_proportion(piece):
    started = time.process_time()
    spans = pii.find(piece * ((1 << 20) // len(piece)))
    assert time.process_time() - started < 8
    for kind in pii.KINDS:
        mine = sorted(s for s in spans if s[2] == kind)
        assert all(a[1] <= b[0] for a, b in zip(mine, mine[1:]))


@pytest.mark.parametrize("piece", ["<a ", "<div></section>", "<x>", "<p><div>", "<", "<!--", "<a \"'>", "<li>", "<a '>", "<ul><li><ul>", "x > <a", "<svg>"])
def test_a_long_page_takes_time_in_proportion(piece):
    started = time.process_time()
    html_text.parse(piece * ((1 << 20) // len(piece)), html_text.Tree())
    assert time.process_time() - started < 10


def test_tags_close_what_they_should():
    def shape(page):
        tree = html_text.Tree()
        return [(t, tree.depth[b]) for b, t in html_text.parse(page, tree)]

    assert shape("<div><p>a<p>b</div>c") == [("a", 2), ("b", 2), ("c", 0)]
    assert shape("<ul><li>a<ul><li>b</li></ul>c</li><li>d</ul>e") == [("a", 2), ("b", 4), ("c", 2), ("d", 2), ("e", 0)]
    assert shape("<table><tr>a<tr>b</table></tr>c") == [("a", 2), ("b", 2), ("c", 0)]
    assert shape("<div>a</section>b</div></div>c") == [("a", 1), ("b", 1), ("c", 0)]
    assert shape("<dl><dt>a<dd>b<dt>c</dl>") == [("a", 2), ("b", 2), ("c", 2)]
    assert shape("a <!-- x > <p> y") == [("a", 0)] and shape("a<!-- b -->c > <!-- d") == [("ac >", 0)]


def test_spans_and_main_text_as_columns(spark):
    rows = [(1, None, 0), (2, "", 0), (2, "mail a@b.co or 10.0.0.1", 0), (None, "4111 1111 1111 1111", 1)]
    got = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string, spans int")).collect()
    assert [(g.doc_id, [(s.kind, s.start, s.end) for s in g.spans]) for g in got] == [(1, []), (2, []), (2, [("email", 5, 11), ("ip", 15, 23)]), (None, [("card", 0, 19)])]
    assert pii.find_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (2, "v", "<p>One two three four five six.</p>")], "page_id long, url string, html string")
    found = html_text.extract(pages).collect()
    assert len(found) == 3 and [(f.page_id, f.url, f.text, f.n_chars) for f in found[:2]] == [(1, "u", "", 0), (2, None, "", 0)]
    assert found[2].n_chars == len(found[2].text) and html_text.extract(pages.limit(0)).count() == 0
