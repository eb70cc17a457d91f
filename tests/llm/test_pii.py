import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from reviewlens.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        n = int(c) * (1 + k % 2)
        total += n // 10 + n % 10
    return total % 10 == 0


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and _luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


ANCHORS = pii.automaton()
PIECES = ["a", "b.c", "@", ".", "x-1", "+", "1", "255", "256", ".", " ", "-", "4111111111111111", "(988)", "é", "🙂", "192.168.0.1", "+1 (988) 555-2485", "://", "password=", "\n", "00"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert [s for s in pii.spans(text, ANCHORS) if s[1] < 4] == plain(text)


def test_own_kinds():
    text = "See https://bob:pw@example.org/a?b. IBAN: DE89 3704 0044 0532 0130 00; at 12 Old Mill Road. password=b7db7aa4a5fcc"
    kinds = {pii.KINDS[k]: text[a:b] for a, k, b in pii.spans(text, ANCHORS)}
    assert kinds["url"] == "https://bob:pw@example.org/a?b"
    assert kinds["account"] == "DE89 3704 0044 0532 0130 00"
    assert kinds["address"] == "12 Old Mill Road"
    assert kinds["secret"] == "b7db7aa4a5fcc"


def test_table(spark):
    rows = [(1, "mail a.b@c.de now", 9), (1, "mail a.b@c.de now", 9), (2, None, 9), (3, "", 9), (None, "+1 (988) 555-2485", 9), (5, "1" * 50_000 + "@" * 1000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = {(r.doc_id, r.spans): r for r in pii.personal_data(docs).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert got[2, ""].base_sha256 == got[3, ""].base_sha256 == got[5, ""].base_sha256 == none
    assert got[1, "email:5:13"].base_sha256 == hashlib.sha256(b"email:5:13").hexdigest()
    assert got[None, "phone:0:17"].n_phone == 1
    assert pii.personal_data(docs.limit(0)).collect() == []
