r"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds are email, ip, card and phone. ``iban`` (confirmed by mod 97) and
``ssn`` (which needs a context word, as it has no checksum) are added. Each
span has a score between 0 and 1: that of its kind's validator, raised when a
context word of its kind stands near it, as a whole word, and lowered when a
word such as "version" or "order" does. Base spans stay whatever their score is.

All searches are linear in the text's length: an address is looked for from
its "@", numbers from the start of a run of digits. Defined results: null texts
count as empty and have no spans; repeated rows each get their row; an empty
table gives an empty result; columns beside ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from stratadoc.llm._shared import bound_batches, table, task

# The patterns of the kinds and their context words.
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Characters of an IBAN by country (ISO 13616); those of other countries may have any number from SHORTEST on.
IBAN_LENGTH = {c: n for n, each in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}.items() for c in each.split()}
SHORTEST = 15
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = 4
CONTEXT = {
    "email": ("mail", "email", "emails", "contact", "@", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "cards", "visa", "credit", "payment", "tarjeta", "carte", "karte", "kreditkarte"),
    "phone": ("phone", "telephone", "call", "tel", "mobile", "fax", "telefon", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security"),
}
AGAINST = frozenset(("version", "order", "isbn", "build", "serial"))
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
#: Characters on either side in which context counts, its weight, and the least score of spans that are added.
NEAR, STEP, LEAST = 40, 0.2, 0.5

DIGITS = re.compile(r"[0-9]")
_near = re.compile(r"[^\W\d_]+|@").findall
_context = {k: frozenset(v) for k, v in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    text = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def ibans(text: str) -> list[tuple[int, int]]:
    """Matches up to the group at which they have their country's length and mod 97 holds, the longest first; the search goes on behind it."""
    out, m = [], IBAN.search(text)
    while m:
        run = m[0]
        length = IBAN_LENGTH.get(run[:2])
        for end in [len(run), *(i for i in range(len(run) - 1, 0, -1) if run[i] == " ")]:
            n = end - run.count(" ", 0, end)
            if n >= SHORTEST and length in (None, n) and mod97(run[:end]):
                out.append((m.start(), m.start() + end))
                break
        else:
            end = 1
        m = IBAN.search(text, m.start() + end)
    return out


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each "@": the characters before it back to the last match, the domain after it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := EMAIL_DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", at + 1)
    return out


def _digits(s: str) -> str:
    return "".join(DIGITS.findall(s))


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of the four base kinds."""
    mail = emails(text) if "@" in text else []
    ip = card = phone = []
    if DIGITS.search(text):
        ip = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))] if "." in text else []
        card = [m.span() for m in CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        phone = [m.span() for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return [mail, ip, card, phone]


def nearby(text: str, start: int, end: int) -> set[str]:
    """The whole words within NEAR characters of a span; a word that the edge cuts does not count."""
    a, b = max(0, start - NEAR), end + NEAR
    while a < start and a > 0 and text[a - 1].isalpha():
        a += 1
    while b > end and b < len(text) and text[b].isalpha():
        b -= 1
    return {*_near(text[a:start].lower()), *_near(text[end:b].lower())}


def score(kind: str, text: str, start: int, end: int) -> float:
    near = nearby(text, start, end)
    s = PRIOR[kind] + STEP * (not near.isdisjoint(_context[kind])) - STEP * (not near.isdisjoint(AGAINST))
    return round(min(1.0, max(0.0, s)), 6)


def find(text: str) -> list[tuple[int, int, int, float]]:
    """(kind, start, end, score) of every span, by kind and start."""
    spans = [(k, a, b) for k, each in enumerate(base_spans(text)) for a, b in each]
    if DIGITS.search(text):
        spans += [(4, a, b) for a, b in ibans(text)]
        spans += [(5, *m.span()) for m in SSN.finditer(text)] if "-" in text else []
    scored = [(k, a, b, score(KINDS[k], text, a, b)) for k, a, b in spans]
    return [s for s in scored if s[0] < BASE or s[3] >= LEAST]


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, _ in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_iban long, n_ssn long, max_score double"
_ARROW = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS[:BASE]], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_iban", pa.int64()), ("n_ssn", pa.int64()), ("max_score", pa.float64())])


@task("pii")
def _scan(batches):
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            found = find(text.as_py() or "")
            n = [0] * len(KINDS)
            for s in found:
                n[s[0]] += 1
            base = _joined(s for s in found if s[0] < BASE)
            rows.append((*n[:BASE], hashlib.sha256(base.encode()).hexdigest(), _joined(found), *n[BASE:], max((s[3] for s in found), default=0.0)))
        cols = list(zip(*rows)) or [()] * (len(_ARROW) - 1)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *[pa.array(c, t) for c, t in zip(cols, _ARROW.types[1:])]], schema=_ARROW)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts and spans of personal data in its whole text."""
    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_scan, SCHEMA)


def op7_pii(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
