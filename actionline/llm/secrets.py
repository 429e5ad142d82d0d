"""Operator 7: secret scans. Keywords by Aho-Corasick, anchored patterns only at their hits, then checksums."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actionline.llm.common import id_text, table

#: Keyword -> kind. An occurrence in either case is a hit; the pattern then decides.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm",
}
#: What must start at a hit, and the kinds in the order in which spans are listed.
PATTERNS = {
    "assign": re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
    "npm": re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
}
KINDS = ["assign", "access", "hex", "github", "npm"]
BASE = ("assign", "access", "hex")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Bytes that are lower-case hexadecimal digits become 1, others 0.
_HEX = bytes(1 if chr(i) in "0123456789abcdef" else 0 for i in range(256))
_RUN = re.compile(rb"\x01{24,}")


def checksum(body: str) -> str:
    """The last six characters of such tokens: the body's CRC-32 in base 62."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = DIGITS[d] + out
    return out


@lru_cache
def _automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        out.add_word(word, (len(word), kind))
    out.make_automaton()
    return out


def _passes(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[1]) >= 6
    if kind == "access":
        return m.end() - m.start() >= 20
    return checksum(m[1]) == m[2]


def find_secrets(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as listed.

    Per kind leftmost matches that don't overlap, as a scan with the whole pattern finds them: a match
    that fails its length or checksum still takes its place. Null and empty texts have none.
    """
    if not text:
        return []
    plain = text.encode("latin-1", "replace")  # one byte per code point, so positions hold
    found: list[tuple[int, int, str]] = []
    hits: dict[str, list[int]] = {}
    for last, (n, kind) in _automaton().iter(plain.lower().decode("latin-1")):
        hits.setdefault(kind, []).append(last - n + 1)
    for kind, starts in hits.items():
        at, pattern = 0, PATTERNS[kind]
        for start in sorted(starts):
            if start >= at and (m := pattern.match(text, start)):
                at = m.end()
                if _passes(kind, m):
                    found.append((start, at, kind))
    marked = plain.translate(_HEX)
    if b"\x01" * 24 in marked:
        found.extend((m.start(), m.end(), "hex") for m in _RUN.finditer(marked))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans, and all spans; a row for each row.

    Spans: kind:start:end by start, then kind as listed, comma-joined. Base kinds are assignments, access
    ids and hexadecimal runs; tokens with an embedded checksum are added. Null or empty text: no spans,
    the digest of an empty string. Null doc_id: kept. Repeated rows: each its own result. Other columns
    are ignored; an empty table gives an empty result; nothing is shuffled and a task holds one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_spans = [find_secrets(x.as_py()) for x in b.column(1)]
            counts = [pa.array([sum(s[2] == kind for s in spans) for spans in all_spans], pa.int64()) for kind in BASE]
            digests = [hashlib.sha256(_listed([s for s in spans if s[2] in BASE]).encode()).hexdigest() for spans in all_spans]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(digests, pa.string()), pa.array(list(map(_listed, all_spans)), pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str | None, mark: str = "[secret]") -> str | None:
    """text with each span, or each run of overlapping spans, replaced by mark."""
    out, at = [], 0
    for start, end, _ in find_secrets(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return text if not out else "".join(out) + text[at:]


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with the same columns and rows; secrets in text replaced, and n_chars set anew where text changed.
    Null texts stay null; other columns stay as they are, whatever their names."""

    @F.pandas_udf("string")
    def clean(text):
        return text.map(lambda x: redact(x, mark))

    out = docs.select(F.struct("*").alias("row"), clean(F.col("text").cast("string")).alias("clean"))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(~F.col("clean").eqNullSafe(F.col("row.text")), F.length("clean")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select([new.get(x, F.col("row")[x]).alias(x) for x in docs.columns])


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents. Null and empty texts: no spans, the digest of an empty string. Null doc_id and
    repeated rows: each its own result. Very long texts: scanned whole. Ties: spans with one start come as the kinds
    are listed. Other columns, clashing names among them, are ignored. Empty table: empty result."""
    return scan(table(spark, sf_dir, "documents"))
