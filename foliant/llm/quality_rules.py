"""Operator 1, quality rules: compression bands.

Repetitive text compresses too well, random or encoded text too badly. Each
text is compressed with zstandard as a whole and in fixed chunks. A longer text
has more history to point back to, so both limits of the band rise with the
length: they are drawn straight between the knots of BANDS over the logarithm of
the length. A text is kept if its whole ratio lies inside the band of its
length and chunks outside the band of *their* length hold at most
BAD_SHARE of its bytes. Every byte is in a chunk: what is left at the end is a
chunk of its own, or goes to the chunk before it where it is under LEAST_CHUNK.

Null or empty text has no words: base_failed, not kept. Repeated rows and rows
that repeat an id are judged one by one, so ties do not arise; null ids stay
null; other columns of any name are not read (keep_quality hands them on). An
empty table gives no rows. Texts are handled whole, however long; an Arrow batch
is worked off in parts of about BATCH_CHARS characters.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from foliant.llm.common import small_batches, split_rows, texts

LEVEL = 3
CHUNK_BYTES = 2048
LEAST_CHUNK = 512
#: (bytes, lowest ratio, highest ratio); straight lines over log2(bytes) between, level outside.
BANDS = ((64, 0.80, 1.45), (256, 1.05, 1.85), (512, 1.15, 2.00), (1024, 1.25, 2.14), (4096, 1.40, 2.36), (16384, 1.45, 2.60), (65536, 1.50, 2.85), (1 << 20, 1.50, 3.60))
BAD_SHARE = 0.25
BATCH_CHARS = 1 << 22
MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunk_share double"


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, end = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(end, i)
            end = i + 3
    return total


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def band(size: int, bands=BANDS) -> tuple[float, float]:
    """The lowest and highest ratio for so many bytes."""
    at = math.log2(max(size, 1))
    knots = [math.log2(k[0]) for k in bands]
    return float(np.interp(at, knots, [k[1] for k in bands])), float(np.interp(at, knots, [k[2] for k in bands]))


def in_band(size: int, ratio: float) -> bool:
    low, high = band(size)
    return low <= ratio <= high


def chunks_of(raw: bytes) -> list[bytes]:
    """Fixed chunks that hold every byte; a last one under LEAST_CHUNK is part of the one before."""
    cuts = list(range(0, len(raw), CHUNK_BYTES))
    if len(cuts) > 1 and len(raw) - cuts[-1] < LEAST_CHUNK:
        cuts.pop()
    return [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)])]


def measure(text: str, zstd: zstandard.ZstdCompressor) -> tuple:
    """The counts, the verdict and the two compression figures of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # on ASCII white space only, as these are bytes
    n_words, repeats = len(words), repeated_words(words)
    base_failed = n_words < MIN_WORDS or 100 * repeats > REPEAT_PERCENT * n_words
    ratio = len(raw) / len(zstd.compress(raw)) if raw else 0.0
    chunks = chunks_of(raw)
    if len(chunks) == 1:  # the whole text, whose ratio is known
        bad = float(not in_band(len(raw), ratio))
    else:
        bad = sum(len(c) for c in chunks if not in_band(len(c), len(c) / len(zstd.compress(c)))) / max(len(raw), 1)
    kept = not base_failed and in_band(len(raw), ratio) and bad <= BAD_SHARE
    return n_words, len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeats, base_failed, kept, ratio, bad


def _frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    zstd = zstandard.ZstdCompressor(level=LEVEL)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for pdf in split_rows(frames, BATCH_CHARS):
        rows = [(None if pd.isna(i) else int(i), *measure(t, zstd)) for i, t in zip(pdf["doc_id"], pdf["text"])]
        out = pd.DataFrame(rows, columns=names)
        yield out.assign(doc_id=out["doc_id"].astype("Int64"))


def quality_rules(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: the base counts, base_failed, kept, ratio and bad_chunk_share."""
    small_batches(docs.sparkSession)
    return texts(docs, text_col, id_col).mapInPandas(_frames, SCHEMA)


def keep_quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    small_batches(docs.sparkSession)

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zstd = zstandard.ZstdCompressor(level=LEVEL)
        for pdf in split_rows(frames, BATCH_CHARS, text_col):
            yield pdf[[bool(isinstance(t, str) and measure(t, zstd)[6]) for t in pdf[text_col]]]

    return docs.mapInPandas(keep, docs.schema)
