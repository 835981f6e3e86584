"""Operator 13, fill-in-the-middle: a parallel automaton scan finds the cuts.

An automaton of four states reads a text byte by byte: outside of words, inside of
one, behind a `<`, and behind a `<` and a letter of a mark. It counts units
(`[A-Za-z]+|[^A-Za-z]`), code points and marks (`<P>`, `<S>`, `<M>`). A stretch of
bytes is described, without knowing how it is entered, by a function from entry
state to exit state and the counts from each entry state. Such descriptions compose,
and composing is associative: blocks of four bytes come from a table, pairs are
composed up to the chunk (`tree`), and chunks may be scanned anywhere, in any
order. Composed in order they give each chunk its entry state and the counts before
it; the chunk in which a cut falls then descends its own tree of descriptions to
the cut's place (`select`).

Texts of up to SPREAD bytes are scanned where they are, chunk by chunk. Giant
documents become rows of chunks, spread over all tasks by key and place; only the
chunks' descriptions (some 100 bytes) meet again by document, and only the cuts go
back to chunks and texts. A row of Spark holds 2 GB at most, so a document has
2^31 / CHUNK descriptions at most. Outputs, hashes and the text that is rebuilt
from the output are Spark expressions over the text where it is.

The draws h1 to h4 come from sha256 of `1:` and the id (a null id: of `1:` alone).
Null and empty texts have no units and are plain; a text that holds a mark is plain,
so the first `<S>`, `<P>` and `<M>` of an output are always its own and the text can
be rebuilt. Ties of the two cuts give an empty middle. Repeated rows give the same
result each (giant ones are scanned once); very long texts are scanned whole;
columns of other names are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from foliant.llm.common import small, small_batches

#: Bytes of a chunk; bytes beyond which the chunks of a text are spread over tasks.
CHUNK, SPREAD = 1 << 14, 1 << 16
#: Percent of the texts that are rearranged; percent of those with the suffix first.
RATE, SPM = 90, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: States: outside of words, in a word, behind "<", behind "<" and one of P, S, M.
OUT, WORD, OPEN, MARK = range(4)
_OTHER, _LETTER, _MARK_LETTER, _LT, _GT, _INSIDE = range(6)  # classes of bytes; the last: a later byte of a code point
CLASS = np.full(256, _OTHER, np.uint8)
CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
CLASS[[*b"PSM"]] = _MARK_LETTER
CLASS[ord("<")], CLASS[ord(">")] = _LT, _GT
CLASS[128:192] = _INSIDE
#: Next state, by state and class; units that begin with the byte; marks that end with it.
NEXT = np.array([
    [OUT, WORD, WORD, OPEN, OUT, OUT],
    [OUT, WORD, WORD, OPEN, OUT, WORD],
    [OUT, WORD, MARK, OPEN, OUT, OPEN],
    [OUT, WORD, WORD, OPEN, OUT, MARK],
], np.uint8)
UNITS = np.array([[s in (OUT, OPEN) if k in (_LETTER, _MARK_LETTER) else k != _INSIDE for k in range(6)] for s in range(4)], np.int64)
MARKS = np.array([[s == MARK and k == _GT for k in range(6)] for s in range(4)], np.int64)
#: Bytes of a block whose description is looked up; where the count of marks begins in a number that also counts units.
BLOCK, HIGH = 5, 32

Description = tuple[np.ndarray, np.ndarray]  # exit states, and units and marks as one number: each n x 4, by entry state


def compose(a: Description, b: Description) -> Description:
    """a, then b."""
    at = a[0] + np.arange(0, 4 * len(a[0]), 4)[:, None]
    return b[0].ravel()[at], a[1] + b[1].ravel()[at]


def _blocks() -> Description:
    """Descriptions of all blocks of BLOCK classes, by the number that the classes spell in base 6."""
    one = NEXT.T.astype(np.intp), (UNITS + (MARKS << HIGH)).T
    found = one
    for _ in range(BLOCK - 1):
        n = len(found[0])
        found = compose(tuple(np.repeat(x, 6, axis=0) for x in found), tuple(np.tile(x, (n, 1)) for x in one))
    return found


_TABLE = _blocks()


def tree(data: np.ndarray) -> list[Description]:
    """Descriptions of the bytes' blocks, of pairs of blocks, and so on; the last one describes the whole."""
    n = max(-(-len(data) // BLOCK), 1)
    kinds = np.full(n * BLOCK, _INSIDE, np.uint16)  # what fills the last block changes nothing
    kinds[: len(data)] = CLASS[data]
    number = kinds[::BLOCK]
    for k in range(1, BLOCK):
        number = number * np.uint16(6) + kinds[k::BLOCK]
    levels = [(_TABLE[0][number], _TABLE[1][number])]
    while n > 1:
        (exits, counts), even = levels[-1], n // 2 * 2
        joined = compose((exits[0:even:2], counts[0:even:2]), (exits[1:even:2], counts[1:even:2]))
        levels.append(joined if even == n else (np.concatenate([joined[0], exits[even:]]), np.concatenate([joined[1], counts[even:]])))
        n = -(-n // 2)
    return levels


def described(levels: list[Description]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exit state, units, marks) by entry state of what a tree describes."""
    exits, counts = levels[-1]
    return exits[0], counts[0] & ((1 << HIGH) - 1), counts[0] >> HIGH


def points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def select(data: np.ndarray, levels: list[Description], state: int, nth: int) -> int:
    """The place of the byte with which the chunk's unit `nth` (from 0) begins, entered in `state`: down the chunk's tree."""
    at, low = 0, (1 << HIGH) - 1
    for level in range(len(levels) - 2, -1, -1):
        exits, counts = levels[level]
        at *= 2
        if (units := int(counts[at, state]) & low) <= nth:  # it is not in the left one of the two
            nth -= units
            state = int(exits[at, state])
            at += 1
    for place in range(at * BLOCK, len(data)):
        kind = CLASS[data[place]]
        nth -= int(UNITS[state, kind])
        if nth < 0:
            return place
        state = int(NEXT[state, kind])
    return len(data)


def entries(exits: np.ndarray, units: np.ndarray, marks: np.ndarray) -> tuple[list[int], list[int], int, int]:
    """Entry state of each chunk and units before it, the units and the marks of all; rows of the arrays are chunks in order."""
    state, n, found, states, before = OUT, 0, 0, [], []
    for k in range(len(exits)):
        states.append(state)
        before.append(n)
        n, found, state = n + int(units[k][state]), found + int(marks[k][state]), int(exits[k][state])
    return states, before, n, found


def holding(before: list[int], n: int, cut: int) -> int:
    """The chunk in which unit `cut` begins (the last one for the end of the text)."""
    return len(before) - 1 if cut >= n else int(np.searchsorted(before, cut, side="right")) - 1


def cuts(data: np.ndarray, h1: int, h2: int, chunk: int = CHUNK) -> tuple[int, bool, int, int]:
    """(units, whether a mark occurs, code points before the first and the second cut) of a whole text."""
    chunks = [data[i : i + chunk] for i in range(0, len(data), chunk)] or [data]
    trees = [tree(c) for c in chunks]
    states, before, n, found = entries(*zip(*map(described, trees)))
    places = []
    for cut in sorted((h1 % (n + 1), h2 % (n + 1))):
        k = holding(before, n, cut)
        place = k * chunk + (len(chunks[k]) if cut >= n else select(chunks[k], trees[k], states[k], cut - before[k]))
        places.append(points(data[:place]))
    return n, found > 0, *places


_CUTS = StructType([StructField("n", LongType()), StructField("marked", BooleanType()), StructField("first", LongType()), StructField("second", LongType())])


@F.pandas_udf(_CUTS)
def _cuts_here(data: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
    found = [cuts(np.frombuffer(d, np.uint8), int(a), int(b)) for d, a, b in zip(data, h1, h2)]
    return pd.DataFrame(found, columns=["n", "marked", "first", "second"])


def _scanned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        data = [np.frombuffer(d, np.uint8) for d in pdf["data"]]
        rows = [(*described(tree(d)), points(d)) for d in data]
        yield pd.DataFrame({"key": pdf["key"], "at": pdf["at"], "h1": pdf["h1"], "h2": pdf["h2"], "size": [r[3] for r in rows], **{c: [r[k].tolist() for r in rows] for k, c in enumerate(("exits", "units", "marks"))}})


def _targets(pdf: pd.DataFrame) -> pd.DataFrame:
    """Two rows for a document: the chunk, its entry state and the unit in it of each cut."""
    pdf = pdf.sort_values("at", kind="stable").reset_index(drop=True)
    states, before, n, found = entries(pdf["exits"], pdf["units"], pdf["marks"])
    start = np.cumsum(pdf["size"].to_numpy()) - pdf["size"].to_numpy()
    rows = []
    for turn, cut in enumerate(sorted((int(pdf["h1"][0]) % (n + 1), int(pdf["h2"][0]) % (n + 1)))):
        k = holding(before, n, cut)
        rows.append((pdf["key"][0], pdf["at"][k], turn, states[k], cut - before[k] if cut < n else -1, start[k], n, found > 0))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in _TARGETS.split(", ")])


_TARGETS = "key string, at long, turn int, state int, nth long, start long, n long, marked boolean"
_PLACES = "key string, turn int, chars long, n long, marked boolean"


def _selected(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        chars = []
        for d, state, nth, start in zip(pdf["data"], pdf["state"], pdf["nth"], pdf["start"]):
            data = np.frombuffer(d, np.uint8)
            chars.append(start + points(data if nth < 0 else data[: select(data, tree(data), int(state), int(nth))]))
        yield pd.DataFrame({"key": pdf["key"], "turn": pdf["turn"], "chars": chars, "n": pdf["n"], "marked": pdf["marked"]})


def giant_cuts(giants: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(key, cut struct) of giant documents (key, data, h1, h2), each key once: chunks spread over tasks."""
    from foliant.session import written

    chunks = giants.select("key", "h1", "h2", "data", F.explode(F.sequence(F.lit(0).cast("long"), F.octet_length("data").cast("long") - 1, F.lit(chunk).cast("long"))).alias("at"))
    chunks = chunks.select("key", "h1", "h2", "at", F.substr("data", (F.col("at") + 1).cast("int"), F.lit(chunk)).alias("data"))
    chunks = written(chunks.dropDuplicates(["key", "at"]), "chunks")
    scanned = chunks.mapInPandas(_scanned, "key string, at long, h1 long, h2 long, size long, exits array<int>, units array<long>, marks array<long>")
    # a group is one document's descriptions: 2^31 / CHUNK at most
    targets = written(scanned.groupBy("key").applyInPandas(_targets, _TARGETS), "targets")
    places = chunks.select("key", "at", "data").join(small(targets, "key"), ["key", "at"]).mapInPandas(_selected, _PLACES)
    cut = F.struct(F.max("n").alias("n"), F.max("marked").alias("marked"), F.min("chars").alias("first"), F.max("chars").alias("second"))
    return places.groupBy("key").agg(cut.alias("cut"))


def _draw(k: int) -> Column:
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def rearranged(found: DataFrame) -> DataFrame:
    """(doc_id, text, cut, h3, h4) -> form, output and restored text, built by expressions."""
    first, second, n = F.col("cut.first").cast("int"), F.col("cut.second").cast("int"), F.col("cut.n")
    plain = (F.length("text") == 0) | F.col("cut.marked") | (F.col("h3") % 100 >= RATE)
    out = found.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < SPM, "spm").otherwise("psm"))
    prefix, middle, suffix = F.substr("text", F.lit(1), first), F.substr("text", first + 1, second - first), F.substr("text", second + 1)
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    chars = [F.when(F.col("form") != "plain", x).cast("long") for x in (first, second - first)]
    out = out.select("doc_id", n.alias("n"), "form", chars[0].alias("prefix_chars"), chars[1].alias("middle_chars"), output.alias("output"))
    return out.withColumn("restored", restored("output", "form"))


def restored(output: str, form: str) -> Column:
    """The text from an output and its form: no text with a mark is rearranged, so the first of each mark is the output's own."""
    out, size = F.col(output), len(PREFIX)
    head = F.when(F.col(form) == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))  # the mark that ends the first part
    one, two = F.position(head, out), F.position(F.lit(MIDDLE), out)
    a = F.substr(out, F.lit(size + 1), one - size - 1)
    b = F.substr(out, one + size, two - one - size)
    c = F.substr(out, two + size)
    return F.when(F.col(form) == "plain", out).when(F.col(form) == "psm", F.concat(a, c, b)).otherwise(F.concat(b, c, a))


def fill_middle(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", spread: int = SPREAD, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output, restored: one row per row of docs."""
    small_batches(docs.sparkSession)
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    drawn = source.select("doc_id", "text", *[_draw(k).alias(f"h{k}") for k in (1, 2, 3, 4)])
    here = drawn.filter(F.octet_length("text") <= spread)
    giant = drawn.filter(F.octet_length("text") > spread).withColumn("key", F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text")), 256))
    found = giant_cuts(giant.select("key", F.col("text").cast("binary").alias("data"), "h1", "h2"), chunk)
    near = here.withColumn("cut", _cuts_here(F.col("text").cast("binary"), "h1", "h2"))
    far = giant.join(small(found), "key").select(*near.columns)
    return rearranged(near.unionByName(far))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
