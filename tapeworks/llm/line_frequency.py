"""Quality rules from the frequency of lines across the documents of a host.

Each document is read once: its own counts, and a hash for every distinct normalised
line (ASCII lower case, digits as 0, runs of white space as one blank). Lines are then
counted per host by the distinct pages that hold them, and a line above the limit is
boilerplate. A page is the set of a document's normalised lines: copies of one page
count once, for a page that was copied often has done nothing wrong by it, while pages
of one template with any line of their own count each, however much they share.

Removing boilerplate may leave little of a document; a depleted document is rejected.

Defined cases: a null or empty text has no words, so it fails the base rule; a null host
is a host of its own; a row that occurs twice counts as two documents and comes out
twice; documents without boilerplate get the base verdict; an empty table gives an empty
result. Extra columns are not read.
"""
from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import only, per_row, settle, shingle_hashes, text_bytes, without, word_hashes

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
LONG = 50_000  # words from which windows are compared by 64-bit hashes in flat arrays
_DIGITS = bytes.maketrans(b"123456789", b"000000000")
_READ = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("tag", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()),
                   ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
                   ("page", pa.int64()), ("lines", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int32()))])
_READ_DDL = ("doc_id long, host string, tag long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
             "n_repeat_words long, page long, lines array<long>, line_words array<int>")


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of five words found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    if len(words) > LONG:
        _, inverse, counts = np.unique(shingle_hashes(word_hashes(words), WINDOW), return_inverse=True, return_counts=True)
        starts = np.flatnonzero(counts[inverse] > 1)
    else:
        windows = list(zip(*(words[k:] for k in range(WINDOW))))
        if len(set(windows)) == n:
            return 0
        counts = Counter(windows)
        starts = np.array([i for i, w in enumerate(windows) if counts[w] > 1])
    inside = np.zeros(len(words), bool)
    for k in range(WINDOW):
        inside[starts + k] = True
    return int(inside.sum())


def normal_line(line: bytes) -> bytes:
    return b" ".join(line.lower().translate(_DIGITS).split())


def line_hash(line: bytes) -> int:
    """First 64 bits of the MD5 of a normalised line, unsigned."""
    return int.from_bytes(hashlib.md5(line).digest()[:8], "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def read_document(row: dict) -> tuple:
    raw = text_bytes(row["text"])
    words = raw.split()
    full = [x for x in raw.split(b"\n") if x.strip()]
    found: dict[int, int] = {}
    for line in full:
        key = line_hash(normal_line(line))
        found[key] = found.get(key, 0) + len(line.split())
    page = line_hash(b"".join(x.to_bytes(8, "big") for x in sorted(found)))
    return (row["doc_id"], row["host"], row["tag"], len(words), len(row["text"] or "") - len(raw) + sum(map(len, words)),
            len(raw) - len(raw.translate(None, SYMBOLS)), len(full) - len(set(full)), repeat_words(words),
            _signed(page), [_signed(x) for x in found], list(found.values()))


def _lines(read: DataFrame) -> DataFrame:
    return (read.select("rid", "host", "page", F.explode(F.arrays_zip("lines", "line_words")).alias("x"))
            .select("rid", "host", "page", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words")))


def boilerplate(read: DataFrame, max_docs: int = 20) -> DataFrame:
    """(host, line, pages) of lines in more than ``max_docs`` distinct pages of a host."""
    return (_lines(read).select("host", "line", "page").distinct()
            .groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") > max_docs))


def read_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    own = only(docs, doc_id=id, text=text, host=host).withColumn("tag", F.xxhash64("text", "host"))
    read = own.mapInArrow(per_row(read_document, _READ), _READ_DDL)
    return settle(read.withColumn("rid", F.monotonically_increasing_id()))


def quality_rules(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = 20,
                  min_left: float = 0.2) -> DataFrame:
    """One row per document: its counts, what boilerplate it holds and whether it is kept. ``tag`` tells rows of an id apart."""
    read = read_documents(docs, id, text, host)
    hits = (_lines(read).alias("a").join(boilerplate(read, max_docs).alias("b"),
                                         F.col("a.host").eqNullSafe(F.col("b.host")) & (F.col("a.line") == F.col("b.line")))
            .groupBy("rid").agg(F.count(F.lit(1)).alias("n_boilerplate"), F.sum("words").alias("boilerplate_words")))
    n, out = F.col("n_words"), read.drop("page", "lines", "line_words").join(hits, "rid", "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("n_boilerplate", "boilerplate_words")})
    out = out.withColumn("base_failed", (n < 10) | (100 * F.col("n_repeat_words") > 20 * n))
    depleted = (n - F.col("boilerplate_words")) < min_left * n
    return out.withColumn("depleted", depleted).withColumn("kept", ~F.col("base_failed") & ~depleted).drop("rid")


def without_rejected(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """``docs`` less the rejected rows; all columns stay."""
    bad = quality_rules(docs, id, text, host, **limits).where("NOT kept")
    return without(docs, bad, id, F.xxhash64(F.col(f"d.`{text}`"), F.col(f"d.`{host}`")))


def strip_boilerplate(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = 20) -> DataFrame:
    """(doc_id, clean_text) with boilerplate lines removed; ``id`` must be unique here."""
    read = read_documents(docs, id, text, host)
    bad = (_lines(read).alias("a").join(boilerplate(read, max_docs).alias("b"),
                                        F.col("a.host").eqNullSafe(F.col("b.host")) & (F.col("a.line") == F.col("b.line")))
           .groupBy("rid").agg(F.collect_list("a.line").alias("bad")))
    bad = read.select("doc_id", "rid").join(bad, "rid").select("doc_id", "bad")
    both = only(docs, doc_id=id, text=text).join(bad, "doc_id", "left")
    schema = pa.schema([("doc_id", pa.int64()), ("clean_text", pa.string())])

    def strip(row: dict) -> tuple:
        if row["text"] is None or not row["bad"]:
            return row["doc_id"], row["text"]
        gone = set(row["bad"])
        left = [x for x in row["text"].split("\n") if not text_bytes(x).strip() or _signed(line_hash(normal_line(text_bytes(x)))) not in gone]
        return row["doc_id"], "\n".join(left)

    return both.mapInArrow(per_row(strip, schema), "doc_id long, clean_text string")
