"""Removal of repeated multi-line chunks with content-defined bounds.

A line is a bound where the rolling hash over the last lines (by default over
the line alone) falls into a fixed part of its range, so the same lines are
bounds wherever they stand. A chunk reaches from a bound to the next line with
content, or from the line with content before it to the bound; chunks overlap,
and a repeated run is cut wherever a bound stands in it. Blank lines between
belong to a chunk; those before and after go with it as far as its first
occurrence has them, too. Chunks of equal hash are compared byte for byte with
their first occurrence, and the lines of the equal ones go.

``dedup_runs`` is the exhaustive form, without bounds: every two neighbouring
lines with content are a chunk. It says what share the bounds find.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from runlens.llm.hashing import fold, lines, mix, slabs
from runlens.llm.rows import unwrapped, wrapped
from runlens.session import materialize

#: lines under the rolling hash, and the share of lines that are bounds: so many of so many
WINDOW, BOUNDS = 1, (7, 8)

_U = np.uint64


def chunk_bounds(line_hashes: np.ndarray, first: np.ndarray, window: int = WINDOW,
                 share: tuple[int, int] = BOUNDS) -> np.ndarray:
    """Which lines are bounds, over several documents.

    ``first`` has each document's first line. A line is one if the rolling hash of the
    ``window`` lines that end with it, all in its document, has a remainder below
    share[0] when divided by share[1].
    """
    n = len(line_hashes)
    bounds = np.zeros(n, dtype=bool)
    if n >= window:
        bounds[window - 1:] = fold(line_hashes, window) % _U(share[1]) < _U(share[0])
    for early in range(window - 1):
        at = first[:-1] + early
        bounds[at[at < first[1:]]] = False
    return bounds


def chunks(docs: DataFrame, window: int = WINDOW, share: tuple[int, int] = BOUNDS) -> DataFrame:
    """The chunks of ``docs`` (doc_id, version, text).

    Returns doc_id, version, line (number of the first, from 0), n_lines, hash, and the
    blank lines ``above`` and ``below``, up to the next line with content or the edge.
    """
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for low, high, text, rows in slabs(part.column(2)):
                hashes, starts, ends, first = lines(text, rows)
                bound = chunk_bounds(hashes, first, window, share)
                full = np.flatnonzero(ends > starts)
                row = np.searchsorted(first, full, side="right") - 1
                pair = np.flatnonzero((row[1:] == row[:-1]) & (bound[full[1:]] | bound[full[:-1]]))
                row, begin, end = row[pair], full[pair], full[pair + 1]
                above = begin - np.maximum(first[row], np.append(-1, full)[pair] + 1)
                below = np.minimum(first[row + 1], np.append(full, len(hashes))[pair + 2]) - end - 1
                base = fold(np.stack([hashes[begin], hashes[end], (end - begin).astype(np.uint64)],
                                     axis=1).ravel(), 3)[::3]
                yield pa.RecordBatch.from_arrays([
                    part.column(0).slice(low, high - low).take(pa.array(row)),
                    part.column(1).slice(low, high - low).take(pa.array(row)),
                    *[pa.array(x.astype(np.int32)) for x in (begin - first[row], end + 1 - begin)],
                    pa.array(mix(base).view(np.int64)),
                    *[pa.array(x.astype(np.int32)) for x in (above, below)],
                ], names=["doc_id", "version", "line", "n_lines", "hash", "above", "below"])

    return docs.select("doc_id", "version", "text").mapInArrow(
        batches, "doc_id long, version long, line int, n_lines int, hash long, above int, below int")


def repeated_chunks(docs: DataFrame, window: int = WINDOW,
                    share: tuple[int, int] = BOUNDS) -> DataFrame:
    """Chunks that stand, byte for byte, earlier in the table as well.

    Earlier is the order of (doc_id, version, line); version is a hash of the
    text, which tells rows of one doc_id with different texts apart. Returns
    doc_id, version, line and n_lines of every occurrence but the first, with the blank
    lines around that the first one has, too. A chunk that overlaps its first
    occurrence, as in a document that repeats one line, is not later.
    """
    keyed = wrapped(docs).select("doc_id", "version", "row.text").where("doc_id is not null")
    found = materialize(chunks(keyed, window, share), "chunks")
    again = found.groupBy("hash").agg(
        F.min(F.struct("doc_id", "version", "line", "above", "below")).alias("first"),
        F.max(F.struct("doc_id", "version", "line", "above", "below")).alias("last")) \
        .where("first <> last").drop("last")
    suspects = found.join(again, "hash").where(
        "not (doc_id = first.doc_id and version = first.version "
        "and line > first.line and line < first.line + n_lines)")
    suspects = suspects.groupBy("doc_id", "version").agg(
        F.collect_set(F.struct(
            "line", "n_lines", "hash", F.least("above", "first.above").alias("up"),
            F.least("below", "first.below").alias("down"),
            F.expr("first.doc_id = doc_id and first.version = version and first.line = line")
            .alias("leads"))).alias("suspects"))
    # cut out before they are unfolded, so that the lines are not carried with each
    texts = keyed.join(suspects.hint("merge"), ["doc_id", "version"]) \
        .withColumn("lines", F.split("text", "\n", -1)) \
        .select("doc_id", "version", F.explode(F.expr(
            "transform(suspects, s -> struct(s.line, s.n_lines, s.hash, s.up, s.down, s.leads, "
            "array_join(slice(lines, s.line + 1, s.n_lines), '\n') as chunk))")).alias("s")) \
        .select("doc_id", "version", "s.*")
    texts = materialize(texts, "chunk-texts")
    leads = texts.where("leads").select("hash", F.col("chunk").alias("lead")) \
        .dropDuplicates(["hash"])
    return texts.where("not leads").join(leads, "hash").where("chunk = lead") \
        .select("doc_id", "version", (F.col("line") - F.col("up")).alias("line"),
                (F.col("n_lines") + F.col("up") + F.col("down")).alias("n_lines")).distinct()


def dedup_lines(docs: DataFrame, window: int = WINDOW, share: tuple[int, int] = BOUNDS) -> DataFrame:
    """``docs`` with repeated multi-line chunks cut out of the texts.

    Needs doc_id and text and keeps all rows and columns, of whatever names;
    the text keeps its other lines. A chunk has two lines with content and stays
    where it stands first, in order of doc_id. A document made of repeated chunks
    alone is left with an empty text. Null and empty texts and rows with a null
    doc_id stay as they are; rows equal in doc_id and text are one document, and
    are cut alike; an empty table stays empty. Also adds n_lines_cut, unless the
    table has a column of that name. Work and rows grow with the lines, blank ones
    included. A repeated run without any bound is not found: of two lines one in
    64, of more lines fewer.
    """
    return _without(docs, repeated_chunks(docs, window, share))


def dedup_runs(docs: DataFrame) -> DataFrame:
    """As ``dedup_lines``, but with every line a bound, so that no repeated run is left."""
    return dedup_lines(docs, WINDOW, (1, 1))


def _without(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    cuts = repeated.withColumn("at", F.explode(F.expr("sequence(line, line + n_lines - 1)"))) \
        .groupBy("doc_id", "version").agg(F.collect_set("at").alias("cuts"))
    rows = wrapped(docs).join(cuts.hint("merge"), ["doc_id", "version"], "left")
    text = F.expr(
        "if(cuts is null, row.text, transform(array(split(row.text, '\n', -1)), l -> array_join("
        "transform(array_except(sequence(0, size(l) - 1), cuts), i -> l[i]), '\n'))[0])")
    cut = F.expr("if(cuts is null, 0, size(cuts))").alias("n_lines_cut")
    return rows.select(*unwrapped(rows, docs.columns, text=text),
                       *([] if "n_lines_cut" in docs.columns else [cut]))
