"""Secret scan: keyword prefilter, anchored patterns near its hits, checksums of tokens that carry one.

An Aho-Corasick automaton finds all keywords of all patterns in one pass over a text. Only at its
hits the patterns are tried, anchored there. Runs of hexadecimal digits have no keyword: a run
of 24 covers every place that is a multiple of 24, so such places are probed instead.
"""

from __future__ import annotations

import json
import re
import zlib
from base64 import urlsafe_b64decode
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, schema_of, small_batches, unpacked

# Kinds in the order in which equal starts are listed, and their patterns.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "iban", "card")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+")
IBAN = re.compile(r"iban\x20*:?\x20*([A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})(?![A-Za-z0-9])", re.ASCII | re.IGNORECASE)
CARD = re.compile(r"card\x20*(?:number|no\.?)?\x20*[:=]?\x20*([0-9](?:[ -]?[0-9]){12,18})(?![0-9])", re.ASCII | re.IGNORECASE)
LEAST_SECRET, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
# End of the fixed values.


def crc_holds(body: str, check: str) -> bool:
    """Whether the last six characters are the CRC-32 of those before, in base 62."""
    value = 0
    for c in check:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body.encode())


def luhn_holds(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(re.sub("[^0-9]", "", digits))):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_holds(code: str) -> bool:
    code = code.upper()
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def jwt_holds(header: str) -> bool:
    """Whether it decodes to an object that names its algorithm. What isn't JSON, or nested beyond what the parser takes, is none."""
    try:
        found = json.loads(urlsafe_b64decode(header + "=" * (-len(header) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(found, dict) and "alg" in found


#: kind: (pattern, keywords in lower case, whether a match counts).
_RULES = {
    "assign": (ASSIGN, ("password", "passwd", "secret", "token", "apikey", "api_key"), lambda m: len(m[2]) >= LEAST_SECRET),
    "access": (ACCESS, ("akia",), lambda m: len(m[0]) >= LEAST_ACCESS),
    "github": (GITHUB, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), lambda m: crc_holds(m[1], m[2])),
    "npm": (NPM, ("npm_",), lambda m: crc_holds(m[1], m[2])),
    "jwt": (JWT, ("eyj",), lambda m: jwt_holds(m[1])),
    "iban": (IBAN, ("iban",), lambda m: iban_holds(m[1])),
    "card": (CARD, ("card",), lambda m: luhn_holds(m[1])),
}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, (_, keywords, _) in _RULES.items():
        for k in keywords:
            found.add_word(k, (kind, len(k)))
    found.make_automaton()
    return found


def _folded(text: str) -> str:
    """A-Z in lower case; every character keeps its place."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def find(text: str | None, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, kind's number, end) of each secret, sorted; kinds do not hide each other."""
    if not text:
        return []
    out: list[tuple[int, int, str]] = []
    hits: dict[str, list[int]] = {}
    for end, (kind, n) in automaton.iter(_folded(text)):
        hits.setdefault(kind, []).append(end - n + 1)
    for kind, starts in hits.items():
        pattern, _, counts = _RULES[kind]
        at = 0
        for start in sorted(starts):
            if start >= at and (m := pattern.match(text, start)):
                at = m.end()
                if counts(m):
                    out.append((start, KINDS.index(kind), at))
    end = 0
    for i, c in enumerate(text[::LEAST_HEX]):
        at = i * LEAST_HEX
        if at >= end and c in "0123456789abcdef":
            start = at
            while start > end and text[start - 1] in "0123456789abcdef":
                start -= 1
            end = HEX.match(text, at).end()
            if end - start >= LEAST_HEX:
                out.append((start, KINDS.index("hex"), end))
    return sorted(out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        found = [find(t, automaton) for t in batch.column("text").to_pylist()]
        spans = pa.array([[{"kind": KINDS[k], "first": a, "end": b} for a, k, b in x] for x in found], kind)
        yield pa.RecordBatch.from_arrays([batch.column("__row"), spans], names=["__row", "secrets"])


def scan_secrets(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` and `secrets`: kind, first and end (code points, end exclusive), by start, then kind.

    Each kind is matched from left to right without overlaps; kinds may overlap each other. A
    null or empty text holds none. Repeated rows are scanned each; an empty table gives an empty
    result. Long texts and long words are scanned whole. A kept column named secrets is replaced; no other column matters.
    """
    small_batches(docs.sparkSession)
    rows = packed(docs, keep, F.col(f"`{text}`").alias("text"))
    return unpacked(rows.mapInArrow(_scan, schema_of(rows, ["__row"], "secrets array<struct<kind:string,first:int,end:int>>")), "secrets")
