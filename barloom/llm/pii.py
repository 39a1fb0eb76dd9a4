"""Personal data: patterns propose spans, checksums confirm, context adjusts.

Four base kinds follow fixed rules (leftmost, non-overlapping, failing proposals
dropped without a retry): email, ip, card (Luhn), phone.  The method adds kinds
of its own: ``iban`` (mod-97), ``token`` (a long secret value named by a key
word) and ``account`` (a bare digit run that no base kind owns, kept only where
a nearby context word lifts its score).  Every span carries a score: a prior of
its kind, raised by a passed checksum and by context words within
``CONTEXT_CHARS`` code points before or after it.

Every scan is linear in the text: proposals start only at run starts, and the
local part of an email is found backwards from its ``@``.

Edge cases: null text is empty (no spans); a null ``doc_id`` is kept; repeated
rows are scanned once each; an empty table gives no rows; extra columns are
ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import small_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "token", "account")
ORDER = {kind: k for k, kind in enumerate(KINDS)}
CONTEXT_CHARS = 40
KEEP_FROM = 0.5
#: Prior score of a proposal of each kind, before context.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.95, "token": 0.6, "account": 0.3}
#: Words near a span that speak for the kind.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "credit", "visa", "mastercard", "amex", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "token": ("token", "secret", "password", "passwd", "apikey", "api_key", "key", "bearer"),
    "account": ("ssn", "passport", "account", "konto", "compte", "cuenta", "social security", "iban"),
}

_RUN = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+=-]*[0-9])[A-Za-z0-9_/+=-]{20,}(?![A-Za-z0-9_/+=-])")
_ACCOUNT = re.compile(r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])|(?<![0-9.+-])[0-9]{8,12}(?![0-9.-])")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CONTEXT = {kind: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, words)) + r")(?!\w)", re.I) for kind, words in CONTEXT.items()}
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    """Luhn checksum of a string of ASCII digits."""
    doubled = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(doubled[v] for v in values[1::2])) % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: first four characters moved last, letters as 10..35, remainder 1."""
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = start < at and _DOMAIN.match(text, at)
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    for a, b in _emails(text):
        yield "email", a, b
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
                yield "ip", *m.span()
        for m in _CARD.finditer(text):
            if 14 <= len(digits := _digits(m.group())) <= 19 and luhn(digits):
                yield "card", *m.span()
        for m in _IBAN.finditer(text):
            plain = m.group().replace(" ", "")
            if 15 <= len(plain) <= 34 and mod97(plain):
                yield "iban", *m.span()
        for m in _TOKEN.finditer(text):
            yield "token", *m.span()
        for m in _ACCOUNT.finditer(text):
            yield "account", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                yield "phone", *m.span()


def spans(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) in code points, by start and then kind."""
    found = []
    for kind, a, b in _proposals(text):
        near = text[max(0, a - CONTEXT_CHARS) : a] + "\n" + text[b : b + CONTEXT_CHARS]
        score = min(1.0, PRIOR[kind] + 0.3 * bool(_CONTEXT[kind].search(near)))
        if kind in BASE or kind == "iban" or score > KEEP_FROM and (kind != "token" or score > PRIOR["token"]):
            found.append((a, b, kind, score))
    owned = [(a, b) for a, b, kind, _ in found if kind in (*BASE, "iban", "token")]
    found = [x for x in found if x[2] != "account" or not any(a < x[1] and x[0] < b for a, b in owned)]
    return sorted(found, key=lambda x: (x[0], ORDER[x[2]]))


def _joined(found: list[tuple[int, int, str, float]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind, _ in found)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, max_score double"


def find(docs: DataFrame) -> DataFrame:
    """One row per document with counts, digests and all spans (columns of ``FOUND``)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                all_found = spans(text or "")
                base = [x for x in all_found if x[2] in BASE]
                kinds = [x[2] for x in base]
                rows.append((*(kinds.count(k) for k in BASE), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(all_found), max((x[3] for x in all_found), default=0.0)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "max_score"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND)


def masked(text: str) -> str:
    """``text`` with every span replaced by its kind in angle brackets; overlapping spans merge under the first kind."""
    out, at = [], 0
    for a, b, kind, _ in spans(text):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns; personal data in ``text`` is masked (null stays null)."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x if x is None else masked(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(at).type) if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
