"""Personal data: patterns propose spans, checksums confirm, context scores.

Base kinds, leftmost and non-overlapping per kind, a failing match is dropped and
not tried again: email, ip (parts at most 255), card (14 to 19 digits, Luhn) and
phone (``+`` form, 10 to 15 digits). They always stay. The method adds kinds that
a checksum or nearby words must confirm: iban (mod-97), ssn (needs a context word)
and local_phone (needs a context word). Each span has a score: the prior of its
kind plus ``CONTEXT_BONUS`` when one of the kind's words stands in the
``CONTEXT_CHARS`` characters before it; added kinds below ``THRESHOLD`` go.

Every scan is linear in the text: runs are found once and never re-entered, so
very long texts and very long runs of digits or word characters are safe.

Defined results. Null texts count as empty and have no spans. Rows are answered
one by one, so repeated rows repeat their answer. Offsets count code points, the
end is exclusive. Only key and text are read; other columns have no effect.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local_phone")
BASE = KINDS[:4]
CONTEXT_CHARS, CONTEXT_BONUS, THRESHOLD = 40, 0.3, 0.6
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.8, "iban": 0.9, "ssn": 0.4, "local_phone": 0.4}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "debit"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto"),
    "ssn": ("ssn", "social security"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax"),
}
_LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
_WORDS = {k: re.compile(r"(?<![a-z])(?:" + "|".join(v) + r")(?![a-z])", re.I) for k, v in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: letters become numbers, the whole leaves 1 modulo 97."""
    s = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def _emails(t: str):
    last, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > last and not _NOT_LOCAL.match(t, start - 1, start):
            start -= 1
        found = _DOMAIN.match(t, at + 1) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        else:
            last = max(last, start)
        at = t.find("@", max(at + 1, last))


def _ips(t: str):
    for chain in _CHAIN.finditer(t):
        parts, at = chain[0].split("."), chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                yield at, end
            at = end + 1


def find_spans(t: str) -> list[tuple[str, int, int, float]]:
    """All spans as (kind, start, end, score), by start, then kind as listed."""
    found = []
    if "@" in t:
        found += [("email", s, e) for s, e in _emails(t)]
    if _DIGIT.search(t):
        found += [("ip", s, e) for s, e in _ips(t)]
        for m in _CARD.finditer(t):
            if m.end() - m.start() <= 37:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end()))
        if "+" in t:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
        found += [("iban", m.start(), m.end()) for m in _IBAN.finditer(t) if 15 <= len(x := m[0].replace(" ", "")) <= 34 and mod97(x)]
        found += [("ssn", m.start(), m.end()) for m in _SSN.finditer(t)]
        found += [("local_phone", m.start(), m.end()) for m in _LOCAL_PHONE.finditer(t)]
    out = []
    for kind, s, e in found:
        score = PRIOR[kind]
        if _WORDS[kind].search(t[max(0, s - CONTEXT_CHARS) : s]):
            score = min(1.0, score + CONTEXT_BONUS)
        if kind in BASE or score >= THRESHOLD:
            out.append((kind, s, e, score))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def _run(batches):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    for b in batches:
        spans = [[dict(zip(("kind", "start", "end", "score"), x)) for x in find_spans(t)] if t else [] for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], names=["__pii_key", "spans"])


def pii_spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: key and spans array<struct<kind,start,end,score>>."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("__pii_key"), F.col(text).alias("__pii_text"))
    return rows.mapInArrow(_run, f"__pii_key {kind}, spans array<struct<kind:string,start:long,end:long,score:double>>").withColumnRenamed("__pii_key", key)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    found = pii_spans(table(spark, sf_dir, "documents"))
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
