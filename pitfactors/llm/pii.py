"""Personal data: patterns propose spans, checks confirm them, context words adjust a score.

Candidates come from one linear scan per kind.  E-mail, IP, card and phone matches that pass
their check form the base and always stay; kinds that a bare pattern cannot settle (IBAN,
national phone numbers, social security numbers) stay when check and context together reach
the threshold.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitfactors.llm.common import whole

#: Kinds in the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
#: Words that make a span of the kind likelier, looked up in the ``window`` before it.
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "correo", "kontakt"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "telephone", "telefon", "mobile", "cell", "call", "fax", "téléphone", "teléfono", "handy"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta", "bic", "swift"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
#: Length of an IBAN by country (public registry of the format).
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27,
    "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}

# Possessive repeats keep every scan linear; they match what the plain patterns match, since
# each repeat is followed by a character outside its class or gives back only to a digit.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN_HEAD = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
_IBAN_TAIL = {n: re.compile(rf"(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Z0-9])") for n in set(IBAN_LENGTH.values())}
_NATIONAL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


@dataclass(frozen=True)
class Rules:
    window: int = 40  # code points of context before a span
    threshold: float = 0.5
    iban: float = 0.6  # a valid mod-97 check alone suffices
    phone: float = 0.2  # national form: needs a context word
    ssn: float = 0.3
    context: float = 0.35  # added when a context word is near


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    code = code.replace(" ", "")
    if IBAN_LENGTH.get(code[:2]) != len(code):
        return False
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Valid IBANs: a head, then exactly as many characters as its country has, up to a boundary."""
    done = 0
    for head in _IBAN_HEAD.finditer(text):
        size = IBAN_LENGTH.get(head.group()[:2])
        tail = _IBAN_TAIL[size].match(text, head.end()) if size and head.start() >= done else None
        if tail and mod97(text[head.start() : tail.end()]):
            done = tail.end()
            yield head.start(), done


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the longest run of local characters before an @ that a domain follows."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        else:
            done = max(done, at + 1)  # the run before the next @ starts behind this one
        at = text.find("@", max(done, at + 1))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def has_digit(text: str) -> bool:
    return any(d in text for d in "0123456789")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the confirmed e-mail, IP, card and phone matches."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if not has_digit(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return out


def _near(text: str, start: int, kind: str, window: int) -> bool:
    words = {w.lower() for w in _WORDS.findall(text[max(0, start - window) : start])}
    return not words.isdisjoint(CONTEXT[kind])


def spans(text: str, rules: Rules = Rules()) -> list[tuple[int, int, int, float, bool]]:
    """All spans (start, kind number, end, score, whether base) in the order start, kind, end."""
    base = base_spans(text)
    out = [(a, k, b, min(1.0, 0.75 + (rules.context if _near(text, a, KINDS[k], rules.window) else 0.0)), True) for a, k, b in base]
    if not has_digit(text):
        return sorted(out)
    taken = sorted((a, b) for a, _, b in base)
    starts = [a for a, _ in taken]
    reach = list(accumulate((b for _, b in taken), max))  # furthest end up to each span

    def free(a: int, b: int) -> bool:
        before = bisect_left(starts, b)  # spans that start before b
        return not before or reach[before - 1] <= a

    def propose(found: Iterable[tuple[int, int]], kind: int, start_score: float) -> None:
        for a, b in found:
            if not free(a, b):
                continue
            score = start_score + (rules.context if _near(text, a, KINDS[kind], rules.window) else 0.0)
            if score >= rules.threshold:
                out.append((a, kind, b, score, False))

    propose(_ibans(text), 4, rules.iban)
    propose((m.span() for m in _SSN.finditer(text)), 5, rules.ssn)
    propose((m.span() for m in _NATIONAL.finditer(text)), 3, rules.phone)
    return sorted(out)


def _scan(rules: Rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                rows.append([{"kind": KINDS[k], "start": a, "end": b, "score": s, "base": base} for a, k, b, s, base in spans(text.as_py(), rules)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    return run


def find(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id and ``spans``, an array of kind, start, end, score, base.

    Positions count code points, the end is exclusive.  A null text counts as empty and has no
    spans.  Repeated rows and rows without id are answered one by one; other columns are
    ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    return rows.mapInArrow(_scan(rules), "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double,base:boolean>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts and SHA-256 of the base spans, and all spans joined as kind:start:end."""

    def joined(items):
        return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["base"])
    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
