"""Personal data by anchor expansion."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from serigraph.llm._common import record_batch

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "credential", "secret")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOGIN = re.compile(r"[^\s/@:]+:[^\s/@]+(?=@)")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_MORE = r"(?:[\x20_-]?(?:access|number|token|code|key|num|no|nr|id))*"
_BEFORE = re.compile(rf"{_MORE}\.?[\x20\t]*[:=#]?[\x20\t]*", re.IGNORECASE)
_VALUE = re.compile(rf"""{_MORE}\.?["']?[\x20\t]*[:=#][\x20\t]*["']?([A-Za-z0-9][A-Za-z0-9_/+.-]{{5,}}=*)""", re.IGNORECASE)
_BEARER = re.compile(r"[\x20\t]+([A-Za-z0-9][A-Za-z0-9_/+.~-]{5,}=*)")
#: Characters of an IBAN by country, where the list has it.
IBAN_LENGTH = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "TR": 26}
#: Words before an account number or a secret.
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "passport", "ssn")
SECRET_CUES = ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "apiKey", "api-key", "access_key", "accessKey", "private_key", "bearer")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("at", 1))
    found.add_word("://", ("scheme", 3))
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    for what, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue[0].upper() + cue[1:]}:
                found.add_word(form, ("bearer" if cue == "bearer" else what, len(cue)))
    found.make_automaton()
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _iban(text: str, at: int) -> int:
    """The end of the IBAN that starts there, 0 if none does: of its country's length, or the longest that is valid."""
    m = _IBAN.match(text, at)
    if not m:
        return 0
    places = [i for i in range(at, m.end()) if text[i] != " "]
    values = [str(int(text[i], 36)) for i in places]
    for n in [IBAN_LENGTH[m[0][:2]]] if m[0][:2] in IBAN_LENGTH else range(len(places), 14, -1):
        if n <= len(places) and int("".join(values[4:n] + values[:4])) % 97 == 1 and not text[places[n - 1] + 1 : places[n - 1] + 2].isalnum():
            return places[n - 1] + 1
    return 0


def _after_cue(text: str, at: int, what: str) -> tuple[int, int] | None:
    """The value that follows a cue which ends there."""
    if what == "account":
        start = _BEFORE.match(text, at).end()
        if end := _iban(text, start):
            return start, end
    m = (_BEARER.match(text, at) if what == "bearer" else None) or _VALUE.match(text, at)
    if not m:
        return None
    start, end = m.span(1)
    digits = sum(c in "0123456789" for c in text[start:end])
    return (start, end) if digits >= (6 if what == "account" else 1) else None


def find_spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of all spans in order, in code points, the end exclusive.

    One pass of the automaton; at each anchor a parser expands to the boundaries. Each kind is taken from left to right
    without overlap, and a candidate that fails its check is passed over whole.
    """
    spans: list[tuple[int, int, int]] = []
    email = ip = card = phone = other = 0
    for last, (what, length) in anchors.iter(text):
        if what == "digit":
            if last >= card:
                if m := _CARD.match(text, last):
                    card = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and _luhn(digits):
                        spans.append((2, last, card))
                else:
                    card = last + 1
            if last >= ip:
                if m := _IP.match(text, last):
                    ip = m.end()
                    # a part of many digits is over 255 unless the rest are zeros
                    if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split(".")):
                        spans.append((1, last, ip))
                else:
                    ip = _DIGITS.match(text, last).end()
            if last and text[last - 1] == "+" and last - 1 >= phone and (m := _PHONE.match(text, last - 1)):
                phone = m.end()
                if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    spans.append((3, last - 1, phone))
        elif what == "at":
            if last > email and text[last - 1] in _LOCAL and (m := _DOMAIN.match(text, last + 1)):
                start = last - 1
                while start > email and text[start - 1] in _LOCAL:
                    start -= 1
                email = m.end()
                spans.append((0, start, email))
        elif what == "scheme":
            if m := _LOGIN.match(text, last + 1):
                spans.append((5, last + 1, m.end()))
        elif last >= other and not (last >= length and text[last - length].isalnum()):
            if found := _after_cue(text, last + 1, what):
                spans.append((4 if what == "account" else 6, *found))
                other = found[1]
    spans.sort()
    return spans


def described(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each run of overlapping spans becomes the name of its first span's kind in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], x[0])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """Spans of personal data in the whole text of every row of docs (doc_id, text).

    Columns doc_id, n_email, n_ip, n_card, n_phone, n_other (account, credential, secret), n_spans, base_sha256 and spans;
    one row for each row, repeated ones and null ids included, other columns dropped. Null text is empty: no spans, the
    hash of an empty string. Very long texts are read whole; one that is all digits costs one pass for each kind. Of
    candidates of one kind that overlap the leftmost counts; kinds may overlap. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = _automaton()
        for batch in batches:
            counts: list[list[int]] = [[] for _ in range(6)]
            sha, told = [], []
            for value in batch.column("text"):
                spans = find_spans(value.as_py() or "", anchors)
                base = [s for s in spans if s[0] < len(BASE)]
                for k in range(len(BASE)):
                    counts[k].append(sum(s[0] == k for s in base))
                counts[4].append(len(spans) - len(base))
                counts[5].append(len(spans))
                sha.append(hashlib.sha256(described(base).encode()).hexdigest())
                told.append(described(spans))
            long = pa.int64()
            yield record_batch(
                {"doc_id": (batch.column("doc_id"), long)}
                | {f"n_{k}": (n, long) for k, n in zip((*BASE, "other", "spans"), counts, strict=True)}
                | {"base_sha256": (sha, pa.string()), "spans": (told, pa.string())}
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_other long, n_spans long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in the column text replaced by its kind; all rows and columns stay, null text stays null.

    Texts are read whole, whatever their length; repeated rows are treated alike. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = _automaton()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [None if t is None else redacted(t, find_spans(t, anchors)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
