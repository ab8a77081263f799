"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs,
schemes, digits and cues of identifiers and secrets. From each anchor a local
parser expands to both sides, deterministically, and validates what it has
found; nothing else of the text is looked at.

Kinds, in their order: email, ip, card and phone (the base), then url (a scheme
with a well-formed host and user data or query, an address after mailto:, a
number after tel:), account (an identifier after its cue; check digits, lengths
and reserved ranges where its kind has some) and secret (a key, token or
password that a cue assigns). Spans are in code points, the end exclusive.

Cases: a null text is empty and has no spans; equal starts are in the order of
the kinds; very long runs of one character cost time in proportion; repeated
rows have the same result each; a null doc_id stays null; an empty table gives
no rows; columns other than doc_id and text play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislecraft.llm.common import texts_of

KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
BASE = KINDS[:4]
#: Words that announce an identifier.
CUES = ("iban", "account", "acct", "passport", "ssn", "routing", "customer id", "user id", "tax id")
#: Words that announce a secret; a sign of assignment follows.
SECRETS = ("token", "secret", "password", "passwd", "api key", "api_key", "apikey", "api-key", "access key", "access_key", "private key", "private_key")
SCHEMES = ("http://", "https://", "ftp://", "mailto:", "tel:")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ZONE = re.compile(r"[0-9.\x20-]+")
RUNS = re.compile(r"[0-9]+")
TAIL = re.compile(r"[\x20().0-9-]+")
URL = re.compile(r"[^\s<>\"']+")
MAILBOX = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CALLED = re.compile(r"\+?[0-9(][0-9().-]{5,}")
DATES = re.compile(r"(?:(?:19|20)[0-9]{2}(?:[ -](?:19|20)[0-9]{2})*|[0-9]{4}-[0-9]{2}-[0-9]{2}.*|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}.*)")
HOST = re.compile(r"(?:[^\s/?#@]*@)?((?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+(?:[A-Za-z]{2,}|xn--[A-Za-z0-9-]+|[0-9]{1,3})|localhost|\[[0-9A-Fa-f:.]+\])(?::[0-9]{1,5})?(?=[/?#]|$)")
IDENTIFIER = re.compile(r"[\s:#=.-]{1,4}(?:no\.?|number|nr\.?)?[\s:#=.-]{0,3}([A-Za-z0-9](?:[ -]?[A-Za-z0-9]){5,41})")
ASSIGNED = re.compile(r"[\"']?\s{0,3}(?:=>|:=|[:=])\s{0,3}[\"']?([^\s\"',;]{6,512})")
#: Letters of an IBAN by country, for those that are most common; others have 15 to 34.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}

Span = tuple[int, int, int]  # start, place in KINDS, end


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for kind, words in (("scheme", SCHEMES), ("cue", CUES), ("secret", SECRETS)):
        for w in words:
            for form in {w, w.upper(), w.capitalize(), w.title()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


ANCHORS = automaton()


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def email_at(text: str, at: int, bound: int) -> Span | None:
    """The address around the at-sign, its local part starting at `bound` or later."""
    start = at
    while start > bound and text[start - 1] in LOCAL:
        start -= 1
    domain = DOMAIN.match(text, at + 1) if start < at else None
    return (start, 0, domain.end()) if domain else None


def phone_at(text: str, plus: int) -> tuple[int, Span | None]:
    """Where the number that starts with the plus sign ends, and its span if it is valid."""
    if not text[plus + 1 : plus + 2].isascii() or not text[plus + 1 : plus + 2].isdigit():
        return plus + 1, None
    tail = TAIL.match(text, plus + 2)
    body = tail[0].rstrip(" ().-") if tail else ""
    if len(body) < 2:
        return plus + 1, None
    end = plus + 2 + len(body)
    digits = 1 + sum(c.isdigit() for c in body)
    return end, (plus, 3, end) if 10 <= digits <= 15 else None


def numbers_in(text: str, start: int, end: int) -> Iterator[Span]:
    """Addresses of four numbers and card numbers in a zone of digits, dots, spaces and hyphens."""
    runs = [(m.start(), m.end()) for m in RUNS.finditer(text, start, end)]
    chain: list[tuple[int, int]] = []
    for k, run in enumerate(runs):  # addresses: every four runs that single dots join
        if chain and not (run[0] == chain[-1][1] + 1 and text[chain[-1][1]] == "."):
            chain = []
        chain.append(run)
        if len(chain) == 4:
            if all(int(text[a:b]) <= 255 for a, b in chain if b - a < 19) and all(b - a < 19 or not text[a:b].lstrip("0") or len(text[a:b].lstrip("0")) < 4 and int(text[a:b].lstrip("0")) <= 255 for a, b in chain):
                yield chain[0][0], 1, run[1]
            chain = []
    first = 0
    for k in range(1, len(runs) + 1):  # cards: runs that single spaces or hyphens join
        if k < len(runs) and runs[k][0] == runs[k - 1][1] + 1 and text[runs[k - 1][1]] in " -":
            continue
        a, b = runs[first][0], runs[k - 1][1]
        digits = sum(e - s for s, e in runs[first:k])
        if 14 <= digits <= 19 and luhn("".join(text[s:e] for s, e in runs[first:k])):
            yield a, 2, b
        first = k


def iban(value: str) -> bool:
    value = value.upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", value) or len(value) != IBAN_LENGTHS.get(value[:2], len(value)):
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def identifier_at(text: str, cue: str, end: int) -> tuple[int, int] | None:
    """The identifier behind a cue, if it is a valid one of its kind."""
    m = IDENTIFIER.match(text, end)
    if not m:
        return None
    start, words = m.start(1), m[1].split(" ")
    whole, best, loose = "", None, True
    for w in words:  # groups that spaces part, as far as they make a valid identifier
        whole = f"{whole} {w}" if whole else w
        plain = re.sub("[ -]", "", whole)
        digits = sum(c.isdigit() for c in plain)
        if cue == "iban":
            ok = iban(plain)
        elif cue == "ssn":
            ok = re.fullmatch(r"(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}", plain) is not None
        elif cue == "routing":
            ok = re.fullmatch("[0-9]{9}", plain) is not None and sum(int(c) * k for c, k in zip(plain, (3, 7, 1) * 3)) % 10 == 0
        elif cue == "passport":
            ok = 6 <= len(plain) <= 9 and digits >= 4
        else:  # of no fixed form: groups that all have digits, four of them at least, and that aren't years or dates; or an IBAN
            loose = loose and any(c.isdigit() for c in w)
            ok = loose and 6 <= len(plain) <= 34 and digits >= 4 and not DATES.fullmatch(whole) or iban(plain)
        if ok:
            best = start, start + len(whole)
    return best


class Runs:
    """Where the run of address characters that holds a place ends, and its last "@" or "?"; each run is looked at once, however many schemes it holds."""

    def __init__(self, text: str):
        self.text, self.end, self.telling = text, 0, -1

    def at(self, place: int) -> tuple[int, int]:
        if place >= self.end:
            m = URL.match(self.text, place)
            self.end = m.end() if m else place
            self.telling = max(self.text.rfind("@", place, self.end), self.text.rfind("?", place, self.end))
        return self.end, self.telling


def url_at(runs: Runs, scheme: str, place: int) -> int | None:
    """Where the address behind a scheme ends, if it is well formed and tells of a person: user data, a query, a mailbox or a number."""
    text, (end, telling) = runs.text, runs.at(place)
    if end <= place:
        return None
    if scheme == "mailto:":
        ok = MAILBOX.match(text, place, end)
    elif scheme == "tel:":
        ok = CALLED.match(text, place, end)
    else:
        ok = telling >= place and HOST.match(text, place, end)
    return end if ok else None


def secret_at(text: str, cue: str, end: int) -> tuple[int, int] | None:
    """The value that is assigned to a cue of a secret: with letters and two digits, or for a password with any digit or sign within."""
    m = ASSIGNED.match(text, end)
    if not m:
        return None
    if cue in ("password", "passwd"):
        ok = any(not c.isalpha() for c in m[1].rstrip(".,:;!?)"))
    else:
        ok = sum(c.isdigit() for c in m[1]) >= 2 and any(c.isalpha() for c in m[1])
    return (m.start(1), m.end(1)) if ok else None


def spans(text: str) -> list[Span]:
    """All spans of a text, sorted."""
    found: list[Span] = []
    runs = Runs(text)
    email_end = digit_end = plus_end = url_end = account_end = secret_end = 0
    for last, (kind, size) in ANCHORS.iter(text):
        if kind == "digit":
            if last >= digit_end:
                digit_end = ZONE.match(text, last).end()
                found += numbers_in(text, last, digit_end)
        elif kind == "at":
            if last > email_end and (span := email_at(text, last, email_end)):
                found.append(span)
                email_end = span[2]
        elif kind == "plus":
            if last >= plus_end:
                plus_end, span = phone_at(text, last)
                found += [span] if span else []
        else:
            start = last - size + 1
            word = text[start : last + 1].lower()
            if kind == "scheme":
                if start >= url_end and (end := url_at(runs, word, last + 1)):
                    url_end = end
                    found.append((start, 4, url_end))
            elif start and text[start - 1].isalnum():
                continue  # within a word
            elif kind == "secret":
                if last >= secret_end and (span := secret_at(text, word, last + 1)):
                    secret_end = span[1]
                    found.append((span[0], 6, span[1]))
            elif last >= account_end and (span := identifier_at(text, word, last + 1)):
                account_end = span[1]
                found.append((span[0], 5, span[1]))
    return sorted(found)


def written(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def redacted(text: str) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first stands for all."""
    out, at = [], 0
    for a, k, b in spans(text):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
            at = b
        elif b > at:
            at = b
    return "".join([*out, text[at:]])


def detect(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, all spans and their number, for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                rows = batch.slice(a, 1024)
                found = [spans(x) if x else [] for x in rows.column(1).to_pylist()]
                base = [[s for s in each if s[1] < len(BASE)] for each in found]
                out = {"doc_id": rows.column(0)} | {f"n_{kind}": pa.array([sum(s[1] == k for s in each) for each in base], pa.int64()) for k, kind in enumerate(BASE)}
                out["base_sha256"] = pa.array([hashlib.sha256(written(each).encode()).hexdigest() for each in base], pa.string())
                out["spans"] = pa.array([written(each) for each in found], pa.string())
                out["n_spans"] = pa.array([len(each) for each in found], pa.int64())
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    return texts_of(docs).mapInArrow(run, schema)


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """`docs` with its texts redacted; nulls stay, all columns stay."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else redacted(x))

    return docs.withColumn(column, clean(F.col(column)))
