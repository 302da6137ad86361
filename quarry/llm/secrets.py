"""Secret scan: an Aho-Corasick keyword prefilter, anchored regular expressions
only at the hits, then validation of embedded checksums.

Kinds, in the order in which they are listed: ``assign`` (a value assigned to a
password-like name), ``access`` (access key ids), ``hex`` (long hexadecimal
runs), and two token formats that end in a CRC-32 of their own body
(``github``, ``npm``); a token whose checksum fails is no finding.  Starts and
ends are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import text_ascii_lower, worker_state

KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = KINDS[:3]
# fixed values: the keywords of the prefilter, by the kind whose expression is then tried
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
            "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}
_ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_TOKEN = {"github": re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
          "npm": re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")}
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32
#: A run of 32 or more covers four neighbours among every eighth character.
_STEP = 8
_PROBE = re.compile(r"[0-9a-f]{%d,}" % (MIN_HEX // _STEP))
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum(body: str) -> str:
    """CRC-32 of a token's body as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _DIGITS[d] + out
    return out


def _automaton():
    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def find_secrets(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every finding, by start, then kind as listed."""
    if not text:
        return []
    found, free = [], dict.fromkeys(KINDS, 0)
    hits = sorted((end - n + 1, kind) for end, (n, kind) in worker_state("secrets", _automaton).iter(text_ascii_lower(text)))
    for at, kind in hits:
        if at < free[kind]:
            continue  # inside the match before: matches of one kind do not overlap
        if kind == "assign":
            if m := _ASSIGN.match(text, at):
                free[kind] = m.end()
                if len(m[1]) >= MIN_VALUE:
                    found.append((at, m.end(), kind))
        elif kind == "access":
            if m := _ACCESS.match(text, at):
                free[kind] = m.end()
                if m.end() - at >= MIN_ACCESS:
                    found.append((at, m.end(), kind))
        elif (m := _TOKEN[kind].match(text, at)) and checksum(m[1]) == m[2]:
            free[kind] = m.end()
            found.append((at, m.end(), kind))
    for probes in _PROBE.finditer(text[_STEP - 1::_STEP]):
        for at in range(probes.start() * _STEP + _STEP - 1, probes.end() * _STEP, _STEP):
            if at < free["hex"]:
                continue
            while at and text[at - 1] in "0123456789abcdef":
                at -= 1
            free["hex"] = end = _HEX.match(text, at).end()
            if end - at >= MIN_HEX:
                found.append((at, end, "hex"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


_OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])
_DDL = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts by kind, the base kinds' spans hashed, all spans.

    No shuffle: each text is scanned where it is read, whole.  A null or empty
    text has no spans; a null id stays null; repeated rows give repeated rows;
    other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                spans = find_secrets(text)
                base = joined([s for s in spans if s[2] in BASE_KINDS])
                rows.append([doc_id, *(sum(s[2] == k for s in spans) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), joined(spans)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _OUT)], schema=_OUT) if rows else pa.RecordBatch.from_pylist([], schema=_OUT)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, _DDL)
