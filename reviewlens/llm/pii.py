"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, schemes, plus signs, digits and identifier cues.
A parser for each kind of anchor then expands to the left and right over the characters its kind
allows, and validates what it found. Every parser moves forward only, so a text is read in linear
time however long its runs are. Spans are in code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

# Kinds in the order in which spans that begin together are listed; the first four are the base.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "address", "account", "secret")

# Words that announce an identifier, a street or a secret.
ACCOUNT_CUES = ("iban", "account", "passport", "ssn", "tax id", "customer id", "konto", "cuenta", "compte")
STREET_CUES = ("street", "avenue", "road", "lane", "boulevard")
SECRET_CUES = ("password", "passwd", "api_key", "secret_key", "access_token")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL_REST = re.compile(r"(?:[^\s/@<>\"]{1,256}@)?[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+(?::[0-9]{1,5})?(?:[/?#][^\s<>\"]*)?")
_ACCOUNT_REST = re.compile(r"(?:[\x20:#=]|no\.?|number){1,6}([A-Z0-9](?:[\x20-]?[A-Z0-9]){5,33})(?![A-Za-z0-9])")
_SECRET_REST = re.compile(r"[\x20]?[:=][\x20]?([^\s\"',;]{6,})")
_STREET_LEFT = re.compile(r"[0-9]{1,5}[A-Za-z]?,?\x20(?:[A-Z][A-Za-z.'-]{0,30}\x20){1,4}$")

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(d - 9 if (d := 2 * int(c)) > 9 else d for c in even)) % 10 == 0


class _Scan:
    """Parsers over one text; ``past`` holds, by kind, where the last candidate ended."""

    def __init__(self, text: str) -> None:
        self.text, self.past, self.spans = text, dict.fromkeys(KINDS, 0), []

    def _add(self, kind: str, start: int, end: int) -> None:
        self.spans.append((start, KINDS.index(kind), end))

    def at_sign(self, at: int, _: str) -> None:
        start, floor = at, self.past["email"]
        while start > floor and self.text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(self.text, at + 1)):
            self.past["email"] = m.end()
            self._add("email", start, m.end())

    def digit(self, at: int, _: str) -> None:
        text = self.text
        if at >= (floor := self.past["ip"]) and (at == floor or text[at - 1] not in _DIGITS) and (m := _IP.match(text, at)):
            self.past["ip"] = m.end()
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
                self._add("ip", at, m.end())
        if at >= self.past["card"] and (m := _CARD.match(text, at)):
            self.past["card"] = m.end()
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                self._add("card", at, m.end())

    def plus(self, at: int, _: str) -> None:
        if at >= self.past["phone"] and (m := _PHONE.match(self.text, at)):
            self.past["phone"] = m.end()
            if 10 <= sum(c in _DIGITS for c in m[0]) <= 15:
                self._add("phone", at, m.end())

    def scheme(self, at: int, _: str) -> None:
        start, floor = at, self.past["url"]
        while start > floor and self.text[start - 1].isascii() and self.text[start - 1].isalpha():
            start -= 1
        if start < at and (m := _URL_REST.match(self.text, at + 3)):
            end = m.end() - len(m[0]) + len(m[0].rstrip(".,;:!?)'"))
            self.past["url"] = end
            self._add("url", start, end)

    def _bare(self, at: int, cue: str) -> bool:
        """The cue is not the inside of a longer word."""
        end = at + len(cue)
        return not (at and self.text[at - 1].isalnum()) and not (end < len(self.text) and self.text[end].isalnum())

    def account(self, at: int, cue: str) -> None:
        end = at + len(cue)
        if at >= self.past["account"] and self._bare(at, cue) and (m := _ACCOUNT_REST.match(self.text, end)):
            if sum(c in _DIGITS for c in m[1]) >= 5:
                self.past["account"] = m.end(1)
                self._add("account", m.start(1), m.end(1))

    def street(self, at: int, cue: str) -> None:
        floor = max(self.past["address"], at - 140)
        if self._bare(at, cue) and (m := _STREET_LEFT.search(self.text[floor:at])):
            self.past["address"] = at + len(cue)
            self._add("address", floor + m.start(), at + len(cue))

    def secret(self, at: int, cue: str) -> None:
        if at >= self.past["secret"] and (m := _SECRET_REST.match(self.text, at + len(cue))):
            self.past["secret"] = m.end(1)
            self._add("secret", m.start(1), m.end(1))


def _cased(cue: str) -> set[str]:
    return {cue, cue.upper(), cue.capitalize(), cue.title()}


def automaton() -> ahocorasick.Automaton:
    found: dict[str, Callable] = {"@": _Scan.at_sign, "+": _Scan.plus, "://": _Scan.scheme}
    found |= dict.fromkeys(_DIGITS, _Scan.digit)
    for cues, parser in ((ACCOUNT_CUES, _Scan.account), (STREET_CUES, _Scan.street), (SECRET_CUES, _Scan.secret)):
        found |= {form: parser for cue in cues for form in _cased(cue)}
    anchors = ahocorasick.Automaton()
    for word, parser in found.items():
        anchors.add_word(word, (word, parser))
    anchors.make_automaton()
    return anchors


def spans(text: str, anchors: ahocorasick.Automaton) -> list[Span]:
    """All spans of ``text``, by start and kind."""
    scan = _Scan(text)
    for end, (word, parser) in anchors.iter(text):
        parser(scan, end + 1 - len(word), word)
    return sorted(set(scan.spans))


def joined(found: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) per row of ``docs`` (doc_id, text).

    A null or empty text has no spans; repeated rows are judged alike; other columns are ignored.
    """

    def run(batches):
        anchors = automaton()
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                found = spans(text, anchors) if text else []
                base = [s for s in found if s[1] < len(BASE)]
                counts = [sum(s[1] == k for s in base) for k in range(len(BASE))]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(found), len(found)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, n_spans long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
