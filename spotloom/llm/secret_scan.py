"""Secret scans: Aho-Corasick keyword prefilter, anchored regular expressions near hits, embedded checksums.

Every kind has literal keywords.  One automaton finds them all in one pass over the lower-cased bytes;
only where a keyword stands is the kind's expression tried, anchored at the hit, and kinds that carry a
checksum or a decodable header are kept only if that holds.  Hexadecimal runs have no keyword: there the
text is mapped to character classes, in which 24 class letters in a row are the keyword.

Each part of a text is read a fixed number of times, whatever it holds, so a text's cost is linear in its
length.

Defined results: null and empty texts have no span; texts may be of any length; repeated rows give a row
each; other columns are ignored, and so cannot clash; offsets are code points, end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotloom.llm.common import LOWER, forget, map_texts, ship, table

BASE_KINDS = ("assign", "access", "hex")
MORE_KINDS = ("github", "npm", "jwt", "pem")
RANK = {k: i for i, k in enumerate(BASE_KINDS + MORE_KINDS)}

ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
GITHUB = re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NPM = re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
JWT = re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
JWT_HEAD, JWT_REST = re.compile(rb"eyJ[A-Za-z0-9_-]+"), re.compile(rb"\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]")
PEM = re.compile(rb"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END (?:[A-Z]+ ){0,3}PRIVATE KEY-----")

HEX_LEAST, ACCESS_LEAST, ASSIGN_LEAST = 24, 20, 6
_HEX_CLASS = bytes(104 if 48 <= c <= 57 or 97 <= c <= 102 else 46 for c in range(256))
_HEX_RUN = b"h" * HEX_LEAST
_BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: bytes) -> bytes:
    """CRC-32 in six base-62 digits, as some token formats embed it."""
    n, out = zlib.crc32(body), b""
    while n:
        n, d = divmod(n, 62)
        out = _BASE62[d : d + 1] + out
    return out.rjust(6, b"0")


def _crc_holds(m: re.Match) -> bool:
    return base62_crc(m[1]) == m[2]


def _jwt_holds(m: re.Match) -> bool:
    try:
        head, body = (json.loads(base64.urlsafe_b64decode(p + b"=" * (-len(p) % 4))) for p in (m[1], m[2]))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and "alg" in head


def _pem_holds(m: re.Match) -> bool:
    """The DER length field inside has to agree with the number of bytes."""
    try:
        der = base64.b64decode(b"".join(m[1].split()), validate=True)
    except (ValueError, binascii.Error):
        return False
    if len(der) < 4 or der[0] != 0x30:
        return False
    if der[1] < 128:
        return len(der) == 2 + der[1]
    k = der[1] & 127
    return 1 <= k <= 4 and len(der) == 2 + k + int.from_bytes(der[2 : 2 + k], "big")


#: keyword -> kind
KEYWORDS = {**dict.fromkeys(("password", "passwd", "secret", "token", "api_key", "apikey"), "assign"), "akia": "access", **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "github"), "npm_": "npm", "eyj": "jwt", "-----begin": "pem"}
ANCHORED = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= ASSIGN_LEAST),
    "access": (ACCESS, lambda m: len(m[0]) >= ACCESS_LEAST),
    "github": (GITHUB, _crc_holds),
    "npm": (NPM, _crc_holds),
    "jwt": (JWT, _jwt_holds),
    "pem": (PEM, _pem_holds),
}


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def find(data: bytes, auto) -> list[tuple[int, str, int]]:
    """(start, kind, end) in bytes, sorted by start, then kind."""
    out, past, hits = [], dict.fromkeys(ANCHORED, 0), []
    for end, (kind, n) in auto.iter(data.translate(LOWER).decode("latin-1")):
        hits.append((end - n + 1, kind))
    hits.sort()
    for at, kind in hits:
        if at < past[kind]:
            continue
        if kind == "jwt" and (head := JWT_HEAD.match(data, at)) and not JWT_REST.match(data, head.end()):
            past[kind] = head.end()  # what follows is the same for all hits before it
            continue
        rx, holds = ANCHORED[kind]
        m = rx.match(data, at)
        if m:
            past[kind] = m.end()
            if holds(m):
                out.append((at, kind, m.end()))
    classes = data.translate(_HEX_CLASS)
    at = classes.find(_HEX_RUN)
    while at >= 0:
        end = HEX.match(data, at).end()
        out.append((at, "hex", end))
        at = classes.find(_HEX_RUN, end)
    out.sort(key=lambda x: (x[0], RANK[x[1]]))
    return out


def to_code_points(data: bytes, spans: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    if not spans or data.isascii():
        return spans
    place, at, seen = {}, 0, 0
    for p in sorted({x for s in spans for x in (s[0], s[2])}):
        seen += len(data[at:p].decode("utf-8", "replace"))
        place[p], at = seen, p
    return [(place[a], k, place[b]) for a, k, b in spans]


def join_spans(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def digest(data: bytes | None, auto) -> tuple[int, int, int, str, str]:
    spans = to_code_points(data, find(data, auto)) if data else []
    n = [sum(k == kind for _, k, _ in spans) for kind in BASE_KINDS]
    base = join_spans(s for s in spans if s[1] in BASE_KINDS)
    return (*n, hashlib.sha256(base.encode()).hexdigest(), join_spans(spans))


OUT = T.StructType([T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()), T.StructField("n_hex", T.LongType()), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def scan(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, counts and digest of the base kinds, and all spans of each text."""

    def make():
        auto = automaton()

        def fn(texts):
            rows = [digest(t, auto) for t in texts]
            return dict(zip(OUT.fieldNames(), map(list, zip(*rows)))) if rows else {f: [] for f in OUT.fieldNames()}

        return fn

    return map_texts(docs, keys, text, make, OUT)


def mask(data: bytes, auto) -> bytes:
    """The text with each secret replaced by its kind; overlapping secrets become one mark."""
    out, at = [], 0
    for a, kind, b in find(data, auto):
        if a >= at:
            out += [data[at:a], b"[", kind.upper().encode(), b"]"]
        at = max(at, b)
    return b"".join([*out, data[at:]]) if out else data


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns, with secrets masked in the text; null stays null."""
    ship(docs.sparkSession)
    state = {}

    @F.pandas_udf(T.StringType())
    def masked(s: pd.Series) -> pd.Series:
        forget()
        if "auto" not in state:
            state["auto"] = automaton()
        return s.map(lambda t: None if t is None else mask(t.encode("utf-8", "replace"), state["auto"]).decode("utf-8", "replace"))

    return docs.withColumn(text, masked(F.col(f"`{text}`")))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), ["doc_id"])


QUERIES = {"op8_secret_scan": op8_secret_scan}
SQL: dict[str, str] = {}
