"""Secrets in whole texts: Aho-Corasick keywords, anchored patterns near hits, checksums."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.llm.words import chunks
from pathweave.session import ship_package

#: Base kinds in the contract's order, then the kinds that a checksum or structure proves.
BASE_KINDS = ["assign", "access", "hex"]
KINDS = [*BASE_KINDS, "github", "npm", "jwt", "card"]

#: The contract's patterns.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

_GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_JWT = re.compile(r"(eyJ[A-Za-z0-9_-]{8,})\.(eyJ[A-Za-z0-9_-]{2,})\.[A-Za-z0-9_-]{16,}")
_CARD = re.compile(r"[=:]\x20?([0-9]{13,19})(?![0-9])")

#: Keywords of the automaton (lower case) and the kind whose pattern is anchored at a hit.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "api_key": "assign", "apikey": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm",
    "eyj": "jwt",
    "card": "card",
}

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: str) -> str:
    """CRC32 of ``body`` as six base-62 digits, as such tokens carry it at their end."""
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = _BASE62[digit] + out
    return out


def luhn(digits: str) -> bool:
    """Whether the last digit is the Luhn check digit of the others."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _is_jwt(header: str, body: str) -> bool:
    try:
        parts = [json.loads(base64.urlsafe_b64decode(p + "=" * (-len(p) % 4))) for p in (header, body)]
    except ValueError:
        return False
    return all(isinstance(p, dict) for p in parts) and "alg" in parts[0]


def _at(kind: str, text: str, lowered_hit: int) -> tuple[int, int, bool] | None:
    """Start, end and validity of the anchored match at a hit; None if nothing matches there."""
    if kind == "assign":
        m = ASSIGN.match(text, lowered_hit)
        return (*m.span(), len(m[2]) >= 6) if m else None
    if kind == "access":
        m = ACCESS.match(text, lowered_hit)
        return (*m.span(), len(m[0]) >= 20) if m else None
    if kind in ("github", "npm"):
        m = (_GITHUB if kind == "github" else _NPM).match(text, lowered_hit)
        return (*m.span(), base62_crc(m[1]) == m[2]) if m else None
    if kind == "jwt":
        m = _JWT.match(text, lowered_hit)
        return (*m.span(), _is_jwt(m[1], m[2])) if m else None
    m = _CARD.match(text, lowered_hit + 4)
    return (*m.span(1), luhn(m[1])) if m else None


def _automaton():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        machine.add_word(word, (len(word), kind))
    machine.make_automaton()
    return machine


def spans_of(text: str, machine) -> list[tuple[str, int, int]]:
    """(kind, start, end) of a text's secrets by start, then kind; places are code points."""
    out, last = [], dict.fromkeys(KINDS, 0)
    # lower-casing bytes changes A-Z alone and moves no code point
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    for end, (length, kind) in machine.iter(lowered):
        start = end - length + 1
        # within a kind, matches do not overlap; a failing match uses up its text as well
        if start >= last[kind] and (found := _at(kind, text, start)):
            last[kind] = found[1]
            if found[2]:
                out.append((kind, found[0], found[1]))
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = "array<struct<kind:string,start:int,end:int>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``secrets``, the spans of each row's whole text.

    Spans are sorted by start, then in the order of ``KINDS``; ends are exclusive, places code
    points.  Null and empty texts have none.  Every row gives one row, repeated rows too; null
    doc_ids stay null; an empty table gives an empty result.  About 1 MB of text, or one longer
    text, is worked on at a time.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton()
        for batch in chunks(batches):
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t, machine)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW_SPANS)], ["doc_id", "secrets"])

    ship_package(source.sparkSession)
    return source.mapInArrow(run, f"doc_id long, secrets {SPANS}")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin(BASE_KINDS))
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))
