"""Personal data by anchor expansion.

An Aho-Corasick automaton passes over the whole text once and reports at-signs, plus signs, digits, URL
schemes and identifier cues. A deterministic parser expands each anchor to its boundaries and validates it; what a
parser has read is not read again by one of its kind, so that the work is in proportion to the text. Emails, IP addresses, card and phone numbers come out exactly as
leftmost non-overlapping matches of their patterns would. What only an anchor with its cue reveals is
added under kinds of its own: ``url`` (an address with a user part, or a mailto/tel link), ``account``
(an IBAN that passes mod 97, or digits after an account cue) and ``secret`` (a quoted value after a key cue).
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "secret")
_ORDER = {k: i for i, k in enumerate(KINDS)}
SCHEMES = ("://", "mailto:", "tel:")
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "ssn", "passport")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SCHEME_NAME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
_USER_PART = re.compile(r"[^\s/?#@\"'<>]+@[^\s\"'<>]+")
_LINKED = re.compile(r"[^\s\"'<>]+")
_IBAN = re.compile(r"[ :.#]*([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){3,8})(?![A-Za-z0-9])")
_NUMBER = re.compile(r"(?:[ :.#=]|no|nr|number|num)*([0-9][0-9 -]{4,32}[0-9])(?![0-9])", re.I)
_SECRET = re.compile(r"\s*[:=]\s*[\"']?([A-Za-z0-9+/_=-]{16,})[\"']?")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def iban(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


_automata: dict[str, object] = {}


def _automaton():
    if "a" not in _automata:
        import ahocorasick

        a = ahocorasick.Automaton()
        for word in ("@", "+", *SCHEMES):
            a.add_word(word, (word, word))
        for digit in "0123456789":
            a.add_word(digit, ("digit", digit))
        for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
            for cue in cues:
                for form in {cue, cue.upper(), cue.capitalize()}:
                    a.add_word(form, (kind, form))
        a.make_automaton()
        _automata["a"] = a
    return _automata["a"]


def _quads(at: int, run: str):
    """The IP addresses of a dotted run that begins at ``at``: its parts, four by four."""
    parts = run.split(".")
    for i in range(0, len(parts) - 3, 4):
        quad = parts[i : i + 4]
        end = at + sum(map(len, quad)) + 3
        if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in quad):
            yield at, end, "ip"
        at = end + 1


def find(text: str) -> list[tuple[int, int, str]]:
    """All (start, end, kind), by start, then kind as listed; spans of one kind don't overlap."""
    found: set[tuple[int, int, str]] = set()
    email_end = phone_end = dotted_end = card_end = url_end = account_end = secret_end = 0
    for at, (kind, word) in _automaton().iter(text):
        after = at + 1
        if kind == "digit":
            if at >= dotted_end:
                dotted = _DOTTED.match(text, at)
                dotted_end = dotted.end()
                if "." in dotted[0]:
                    found.update(_quads(at, dotted[0]))
            if at >= card_end and (m := _CARD.match(text, at)):
                card_end = m.end()
                if card_end - at >= 14:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        found.add((at, card_end, "card"))
        elif kind == "@":
            domain = _DOMAIN.match(text, after) if at > email_end else None
            if domain:
                start = at
                while start > email_end and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at:
                    email_end = domain.end()
                    found.add((start, email_end, "email"))
        elif kind == "+":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found.add((at, phone_end, "phone"))
        elif kind in SCHEMES:
            start = after - len(word)
            if start < url_end:
                continue
            if kind == "://":
                name = _SCHEME_NAME.search(text, max(0, start - 16), start)
                if name and (m := _USER_PART.match(text, after)):
                    url_end = m.end()
                    found.add((name.start(), url_end, "url"))
            elif (m := _LINKED.match(text, after)) and not (start and text[start - 1].isalnum()):
                url_end = m.end()
                found.add((start, url_end, "url"))
        elif kind == "account":
            start = after - len(word)
            if start < account_end or (start and text[start - 1].isalnum()):
                continue
            if m := _IBAN.match(text, after):
                account_end = m.end()
                if iban(m[1]):
                    found.add((m.start(1), m.end(1), "account"))
            elif m := _NUMBER.match(text, after):
                account_end = m.end()
                found.add((m.start(1), m.end(1), "account"))
        elif after > secret_end and (m := _SECRET.match(text, after)):
            secret_end = m.end()
            found.add((m.start(1), m.end(1), "secret"))
    return sorted(found, key=lambda s: (s[0], _ORDER[s[2]], s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end; code points, end exclusive) of each row; null texts have none."""

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = [[{"kind": k, "start": s, "end": e} for s, e, k in find(t or "")] for t in batch.column(1).to_pylist()]
            if spans:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def op6_pii(spark, sf_dir: str) -> DataFrame:
    rows = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return rows.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
