"""Secrets found by patterns and by poor token efficiency.

Patterns give the base spans: assignments to telling names, access key ids, long hex
runs. The second way needs no pattern of a vendor: a byte-pair vocabulary packs words
into few tokens, random strings into many. A run of key characters, with or without
digits, is reported when it has few characters per token, after known digests and
identifiers are taken out: hex digests of the usual lengths, UUIDs, rulers, and what
consists of parts that the vocabulary itself packs well: camel, snake or hyphenated
names of words, grouped numbers. No shape alone makes a run known.
Spans that overlap a base span are not reported twice. Runs longer than ``PIECE``
characters are judged by pieces of that length, the run by its best piece, so texts of
any length are scanned whole in bounded steps.

The vocabulary is a tiktoken rank file whose path is a parameter; a worker loads it once.

Defined cases: a null or empty text has no spans; a row that occurs twice comes out
twice; an empty table gives an empty result. Extra columns are not read.
"""
from __future__ import annotations

import base64
import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from tapeworks.llm.common import only, per_row, text_bytes

KINDS = ("assign", "access", "hex", "random")
BASE = (
    ("assign", re.compile(rb"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"""
                          rb"""[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")),
    ("access", re.compile(rb"AKIA[A-Z0-9]+")),
    ("hex", re.compile(rb"[0-9a-f]+")),
)
#: The third pattern with its failing runs, those below 16 characters, left out at once.
_HEX = re.compile(rb"(?<![0-9a-f])[0-9a-f]{16,}")
_RUN = re.compile(rb"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_UUID = re.compile(rb"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
_DIGEST = re.compile(rb"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}|[0-9A-F]{128})")
_PARTS = re.compile(rb"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
PIECE = 256
WORDLIKE = 4  # characters per token of a part that reads as words


@functools.lru_cache(maxsize=2)
def encoding(path: str | None):
    """The rank file at ``path``; without one, the public 50k byte-pair vocabulary."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in bytes: leftmost matches per kind, failing ones dropped."""
    out = []
    if b"=" in raw or b":" in raw:
        out += [(m.start(), 0, m.end()) for m in BASE[0][1].finditer(raw) if m.end(1) - m.start(1) >= 12]
    out += [(m.start(), 1, m.end()) for m in BASE[1][1].finditer(raw) if m.end() - m.start() >= 18]
    return out + [(m.start(), 2, m.end()) for m in _HEX.finditer(raw)]


def is_known(run: bytes, path: str | None, max_ratio: float) -> bool:
    """Digests, UUIDs, rulers, and identifiers whose parts the vocabulary packs well: names made of its words, grouped numbers."""
    core = run.strip(b"+/_=-")
    if not core or _DIGEST.fullmatch(core) or _UUID.fullmatch(core):
        return True
    enc, parts = encoding(path), [p.decode("ascii") for p in _PARTS.findall(core)]
    if len(parts) > 1 and all(p.isdigit() for p in parts):
        return sum(map(len, parts)) >= max_ratio * sum(len(enc.encode_ordinary(p)) for p in parts)
    words = sum(len(p) for p in parts if p.isalpha() and len(p) >= 4 and len(p) >= WORDLIKE * len(enc.encode_ordinary(p)))
    return words >= 0.6 * sum(map(len, parts))


def characters_per_token(run: bytes, path: str | None) -> float:
    """The lowest ratio over pieces of the run; a short rest is judged with the piece before it."""
    enc, text = encoding(path), run.decode("ascii")
    cuts = [text[i:i + PIECE] for i in range(0, len(text), PIECE)]
    if len(cuts) > 1 and len(cuts[-1]) < 20:
        cuts[-2:] = [cuts[-2] + cuts[-1]]
    return min(len(c) / len(enc.encode_ordinary(c)) for c in cuts)


def random_spans(raw: bytes, taken: list[tuple[int, int, int]], path: str | None, max_ratio: float) -> list[tuple[int, int, int]]:
    out = []
    for m in _RUN.finditer(raw):
        if any(s < m.end() and m.start() < e for s, _, e in taken):
            continue
        if characters_per_token(m.group(), path) <= max_ratio and not is_known(m.group(), path, max_ratio):
            out.append((m.start(), 3, m.end()))
    return out


def _points(raw: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets as code points, in order of start and kind."""
    spans = sorted(spans)
    if raw.isascii():
        return spans
    at, seen, place = 0, 0, {}
    for x in sorted({x for s, _, e in spans for x in (s, e)}):
        seen += len(raw[at:x].decode("utf-8", "surrogatepass"))
        at, place[x] = x, seen
    return [(place[s], k, place[e]) for s, k, e in spans]


def spelled(spans: list[tuple[int, int, int]], names: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str | None = None, max_ratio: float = 2.0) -> DataFrame:
    """One row per document: counts per kind, all spans and the digest of the base ones."""
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    def scan(row: dict) -> tuple:
        raw = text_bytes(row["text"])
        base = base_spans(raw)
        found = _points(raw, base + random_spans(raw, base, vocabulary, max_ratio))
        count = [sum(k == n for _, k, _ in found) for n in range(len(KINDS))]
        digest = hashlib.sha256(spelled([x for x in found if x[1] < 3]).encode()).hexdigest()
        return (row["doc_id"], *count, digest, spelled(found))

    return only(docs, doc_id=id, text=text).mapInArrow(
        per_row(scan, schema), "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def without_secrets(docs: DataFrame, text: str = "text", vocabulary: str | None = None, max_ratio: float = 2.0) -> DataFrame:
    """``docs`` with every secret span replaced by its kind in brackets; all columns and rows stay."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def redact(texts):
        def one(t):
            if t is None:
                return None
            raw = text_bytes(t)
            base = base_spans(raw)
            spans, out, end = sorted(base + random_spans(raw, base, vocabulary, max_ratio)), [], 0
            for s, k, e in spans:
                if s >= end:
                    out += [raw[end:s], f"[{KINDS[k]}]".encode()]
                end = max(end, e)
            return b"".join([*out, raw[end:]]).decode("utf-8", "surrogatepass") if spans else t
        return texts.map(one)

    return docs.withColumn(text, redact(F.col(f"`{text}`")))
