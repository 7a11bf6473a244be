"""Long repeated passages by sparse suffix arrays.

Of every run of windows of ``least`` words, only the suffix at the word whose
k-gram hash is smallest (the minimiser) is retained, so equal passages retain
equal suffixes wherever they stand. Suffixes whose gram stands in more than one
text are sorted by gram and following words, and again by gram and preceding
words; in both orders each is compared with its neighbours of other texts, to
the right of the gram and to its left. Where more suffixes share a gram than a
suffix has neighbours compared, all its windows are grouped by their hash as
well. Matches of at least ``least`` words are united within each text.

A suffix needs only the words of the windows it stands for: what lies further
is covered by the next minimiser, and the union joins the parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from runlens.llm.hashing import _spans, fold, mix, slabs, words
from runlens.llm.rows import unwrapped, wrapped
from runlens.session import materialize

#: least words of a passage, words of a minimiser gram, and neighbours compared
#: on each side in sorted order
LEAST, GRAM, NEIGHBOURS = 50, 8, 16
#: equal grams closer than this are thinned out, as in text that repeats a word
_THIN = 16
#: bytes kept of a word's hash
_BYTES = 3

_U = np.uint64


def minimisers(word_hashes: np.ndarray, first: np.ndarray, least: int = LEAST,
               gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Retained suffixes of several texts.

    Returns for each the row, word position, hash of its gram, and the first
    and last start of the windows of ``least`` words that it stands for, all
    positions counted over the whole slab. Texts of fewer words retain none.
    """
    grams = fold(word_hashes, gram)
    span = least - gram + 1
    n_windows = len(word_hashes) - least + 1
    none = np.empty(0, np.int64)
    if n_windows <= 0:
        return none, none, np.empty(0, np.uint64), none, none
    low = _U((1 << 24) - 1)
    keyed = (grams & ~low) | (np.arange(len(grams), dtype=np.uint64) & low)
    # minimum over `span` neighbours, from minima over powers of two
    smallest, width = keyed, 1
    while 2 * width <= span:
        smallest = np.minimum(smallest[:-width], smallest[width:])
        width *= 2
    smallest = np.minimum(smallest[:n_windows], smallest[span - width:span - width + n_windows])
    start = np.arange(n_windows)
    at = start + ((smallest & low).astype(np.int64) - start) % (1 << 24)
    row = np.searchsorted(first, start, side="right") - 1
    inside = start + least <= first[np.minimum(row + 1, len(first) - 1)]
    start, at, row = start[inside], at[inside], row[inside]
    if not len(start):
        return none, none, np.empty(0, np.uint64), none, none
    new = np.append(True, (at[1:] != at[:-1]) | (row[1:] != row[:-1]))
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    at, row, low_start, high_start = at[begin], row[begin], start[begin], start[end]
    # thin out equal grams that follow each other closely
    same = np.append(False, (grams[at[1:]] == grams[at[:-1]]) & (row[1:] == row[:-1])
                     & (at[1:] - at[:-1] < _THIN))
    run = np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))
    step = (at - at[run]) // _THIN
    keep = ~same | np.append(False, step[1:] != step[:-1])
    kept = np.flatnonzero(keep)
    last = np.append(kept[1:], len(at)) - 1
    return row[kept], at[kept], grams[at[kept]], low_start[kept], high_start[last]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")


def _grams(texts: DataFrame, least: int, gram: int) -> DataFrame:
    """(version, gram) of every text, and (version, doc_id, n_words) with no gram."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, versions = (part.column(c).to_numpy() for c in (0, 1))
            for low, high, text, rows in slabs(part.column(2)):
                hashes, _, _, first = words(text, rows)
                row, _, found, _, _ = minimisers(hashes, first, least, gram)
                pairs = np.unique(np.stack([row.astype(np.int64), found.view(np.int64)], axis=1),
                                  axis=0) if len(row) else np.empty((0, 2), np.int64)
                n, m = high - low, len(pairs)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.append(versions[low:high], versions[low:high][pairs[:, 0]])),
                    pa.concat_arrays([pa.array(ids[low:high]), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([pa.array(np.diff(first)), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(pairs[:, 1])]),
                ], names=["version", "doc_id", "n_words", "gram"])

    return texts.mapInArrow(batches, "version long, doc_id long, n_words long, gram long")


_SUFFIX = "gram long, following binary, version long, at long, preceding binary"


def _suffixes(texts: DataFrame, least: int, gram: int) -> DataFrame:
    """The retained suffixes of ``texts`` whose gram is among ``grams``."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            versions = part.column("version").to_numpy()
            wanted = part.column("grams")
            for low, high, text, rows in slabs(part.column("text")):
                hashes, _, _, first = words(text, rows)
                row, at, found, begin, end = minimisers(hashes, first, least, gram)
                keep = np.zeros(len(row), dtype=bool)
                cuts = np.searchsorted(row, np.arange(high - low + 1))
                for i in range(high - low):
                    keep[cuts[i]:cuts[i + 1]] = np.isin(
                        found[cuts[i]:cuts[i + 1]].view(np.int64),
                        wanted[low + i].values.to_numpy())
                row, at, found, begin, end = (x[keep] for x in (row, at, found, begin, end))
                forward = _bytes(hashes)
                backward = _bytes(hashes[::-1])
                total = len(hashes)
                yield pa.RecordBatch.from_arrays([
                    pa.array(found.view(np.int64)), _cut(forward, at, end + least),
                    pa.array(versions[low + row]), pa.array(at - first[row]),
                    _cut(backward, total - at, total - begin),
                ], names=["gram", "following", "version", "at", "preceding"])

    return texts.select("version", "text", "grams").mapInArrow(batches, _SUFFIX)


def _bytes(hashes: np.ndarray) -> bytes:
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :_BYTES].tobytes()


def _cut(data: bytes, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.array([data[_BYTES * s:_BYTES * e] for s, e in zip(starts.tolist(), ends.tolist())],
                    pa.binary())


def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word codes of a binary column as a matrix, and the number in each row."""
    values = column.to_pylist()
    size = np.array([len(v) // _BYTES for v in values], dtype=np.int64)
    wide = int(size.max()) if len(size) else 0
    raw = np.frombuffer(b"".join(v.ljust(wide * _BYTES, b"\0") for v in values), dtype=np.uint8)
    raw = raw.reshape(len(values), wide, _BYTES).astype(np.uint32)
    return (raw << np.array([16, 8, 0], dtype=np.uint32)).sum(axis=2, dtype=np.uint32), size


def neighbour_matches(rows: pa.Table, least: int, neighbours: int = NEIGHBOURS):
    """Longest matches of each sorted suffix with its neighbours of other texts.

    Returns row numbers, words matched left and right of the suffix's start, and
    the neighbour's row. For each row up to three matches of ``least`` words or
    more are returned: the longest, and those that reach furthest left and right.
    """
    n = len(rows)
    gram = rows.column("gram").to_numpy()
    version = rows.column("version").to_numpy()
    right, right_size = _padded(rows.column("following").combine_chunks())
    left, left_size = _padded(rows.column("preceding").combine_chunks())
    change = np.append(True, (gram[1:] != gram[:-1]) | (version[1:] != version[:-1]))
    begin = np.flatnonzero(change)
    number = np.cumsum(change) - 1
    run_start, run_end = begin[number], np.append(begin[1:], n)[number] - 1
    best = {key: [np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1)]
            for key in ("longest", "left", "right")}
    for offset in range(1, neighbours + 1):
        for other in (run_start - offset, run_end + offset):
            i = np.flatnonzero((other >= 0) & (other < n))
            j = other[i]
            fit = (gram[i] == gram[j]) & (version[i] != version[j])
            i, j = i[fit], j[fit]
            if not len(i):
                continue
            r = _common(right[i], right[j], np.minimum(right_size[i], right_size[j]))
            l = _common(left[i], left[j], np.minimum(left_size[i], left_size[j]))
            good = l + r >= least
            i, j, l, r = i[good], j[good], l[good], r[good]
            for key, score in (("longest", l + r), ("left", l), ("right", r)):
                held = best[key]
                before = {"longest": held[0][i] + held[1][i], "left": held[0][i],
                          "right": held[1][i]}[key]
                better = (score > before) | (held[2][i] < 0)
                for column, value in zip(held, (l, r, j)):
                    column[i[better]] = value[better]
    out = [np.concatenate(x) for x in zip(*(
        (np.flatnonzero(h[2] >= 0), *(c[h[2] >= 0] for c in h)) for h in best.values()))]
    return tuple(out)


def _common(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    if not a.shape[1]:
        return np.zeros(len(a), np.int64)
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(first, size)


_MATCH = "version long, start long, stop long, other long"
_EDGE = "part int, gram long, following binary, at long, preceding binary"


def _matches(sorted_rows: DataFrame, least: int) -> DataFrame:
    """Matches within each sorted partition, and the rows at its two ends."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        held, done, started = None, 0, False
        for part in parts:
            if not len(part):
                continue
            batch = pa.Table.from_batches([part])
            if not started:
                yield _edge(batch.slice(0, NEIGHBOURS), number)
                started = True
            held = batch if held is None else pa.concat_tables([held, batch])
            # the last rows wait for those that follow them
            if len(held) - done > 4096:
                yield _found(held, done, len(held) - NEIGHBOURS, least)
                keep = max(0, len(held) - 4 * NEIGHBOURS)
                done = len(held) - NEIGHBOURS - keep
                held = held.slice(keep)
        if held is not None:
            yield _found(held, done, len(held), least)
            yield _edge(held.slice(max(0, len(held) - NEIGHBOURS)), number)

    return sorted_rows.mapInArrow(batches, f"{_MATCH}, {_EDGE}")


def _found(rows: pa.Table, low: int, high: int, least: int) -> pa.RecordBatch:
    i, left, right, j = neighbour_matches(rows, least)
    use = (i >= low) & (i < high)
    i, left, right, j = i[use], left[use], right[use], j[use]
    at, version = rows.column("at").to_numpy()[i], rows.column("version").to_numpy()
    n = len(i)
    return pa.RecordBatch.from_arrays([
        pa.array(version[i]), pa.array(at - left), pa.array(at + right), pa.array(version[j]),
        pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()),
        pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())],
        names=["version", "start", "stop", "other", "part", "gram", "following", "at", "preceding"])


def _edge(rows: pa.Table, number: int) -> pa.RecordBatch:
    n, rows = len(rows), rows.combine_chunks()
    column = {c: rows.column(c).combine_chunks() for c in rows.column_names}
    none = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays([
        column["version"], none, none, none, pa.array(np.full(n, number, dtype=np.int32)),
        column["gram"], column["following"], column["at"], column["preceding"]],
        names=["version", "start", "stop", "other", "part", "gram", "following", "at", "preceding"])


def _window_hashes(suffixes: DataFrame, least: int) -> DataFrame:
    """Start and hash of every window that the suffixes stand for."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            after, n_after = _codes(part.column("following"))
            before, n_before = _codes(part.column("preceding"))
            size = n_before + n_after
            begin = np.cumsum(size) - size
            codes = np.empty(len(after) + len(before), dtype=np.uint64)
            codes[np.repeat(begin + n_before, n_after) + _place(n_after)] = after
            codes[np.repeat(begin + n_before - 1, n_before) - _place(n_before)] = before
            n = np.maximum(size - least + 1, 0)
            row, place = np.repeat(np.arange(len(n)), n), _place(n)
            start = begin[row] + place
            yield pa.RecordBatch.from_arrays([
                part.column("version").take(pa.array(row)),
                pa.array((part.column("at").to_numpy() - n_before)[row] + place),
                pa.array(_spans(mix(codes), start, start + least).view(np.int64)),
            ], names=["version", "start", "window"])

    return suffixes.mapInArrow(batches, "version long, start long, window long")


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word codes of a binary column one after the other, and the number in each row."""
    values = column.to_pylist()
    size = np.array([len(v) // _BYTES for v in values], dtype=np.int64)
    raw = np.frombuffer(b"".join(values), dtype=np.uint8).reshape(-1, _BYTES).astype(np.uint64)
    return (raw << np.array([16, 8, 0], dtype=np.uint64)).sum(axis=1, dtype=np.uint64), size


def _place(sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(int(sizes.sum())) - np.repeat(ends - sizes, sizes)


def _window_matches(suffixes: DataFrame, least: int) -> DataFrame:
    """Windows that stand in two texts, of the grams that neighbours do not exhaust.

    A gram of at most NEIGHBOURS suffixes has all of them compared with each
    other. A window has its minimiser from its words alone, so it is a window of
    the same gram wherever it stands.
    """
    often = suffixes.groupBy("gram").agg(F.count(F.lit(1)).alias("n")) \
        .where(F.col("n") > NEIGHBOURS).select("gram")
    windows = materialize(_window_hashes(
        suffixes.join(often, "gram").select("following", "version", "at", "preceding"), least), "windows")
    shared = windows.groupBy("window").agg(
        F.min("version").alias("a"), F.max("version").alias("z")).where("a <> z")
    return windows.join(shared, "window").select(
        "version", "start", (F.col("start") + least).alias("stop"),
        F.expr("if(version = a, z, a)").alias("other"))


def repeated_passages(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """Passages of at least ``least`` words that stand in another document too.

    ``docs`` needs doc_id and text; other columns are ignored. Words are runs
    between white space, compared with A-Z lowered, by 24 bits of hash each.
    Returns one row per maximal run of words of a document that matches cover:
    doc_id, start_word, end_word (exclusive, from 0), n_words and other_doc_id,
    the smallest document that one of its matches stands in. Documents with the
    same text repeat each other as a whole, if long enough. Repeats within one
    document only are not passages. Null, empty and short texts have none, rows
    with a null doc_id take no part, equal rows count once.
    """
    texts = _texts(docs)
    first = materialize(_grams(texts, least, gram), "grams")
    members = materialize(first.where("gram is null").select("version", "doc_id", "n_words")
                          .distinct(), "members")
    pairs = first.where("gram is not null").select("version", "gram")
    common = pairs.groupBy("gram").agg(
        F.min("version").alias("a"), F.max("version").alias("z")).where("a <> z").select("gram")
    wanted = pairs.join(common, "gram").groupBy("version").agg(F.collect_set("gram").alias("grams"))
    leaders = members.groupBy("version").agg(F.min("doc_id").alias("doc_id"))
    asked = texts.join(wanted.join(leaders, "version").hint("merge"), ["doc_id", "version"]) \
        .dropDuplicates(["doc_id", "version"])
    suffixes = materialize(_suffixes(asked, least, gram), "suffixes")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = []
    # once by what follows the gram, once by what precedes it: a passage whose
    # minimiser lies near its end has its partners next to it in the second
    for context in ("following", "preceding"):
        order = ["gram", context, "version", "at"]
        matched = materialize(_matches(
            suffixes.repartitionByRange(n, *order).sortWithinPartitions(*order), least), "matches")
        # pairs that a partition bound parts: a few rows a partition, in one task
        ends = matched.where("part is not null").select(
            "gram", "following", "version", "at", "preceding").distinct()
        across = _matches(ends.repartition(1).sortWithinPartitions(*order), least)
        found += [matched.where("part is null"), across.where("part is null")]
    found = [x.select("version", "start", "stop", "other") for x in found]
    spans = reduce(DataFrame.unionByName, [*found, _window_matches(suffixes, least)]).distinct()
    return _united(spans, members, least)


def _united(spans: DataFrame, members: DataFrame, least: int) -> DataFrame:
    leaders = members.groupBy("version").agg(
        F.min("doc_id").alias("leader"), F.count(F.lit(1)).alias("n"),
        F.max("n_words").alias("n_words"))
    whole = leaders.where((F.col("n") > 1) & (F.col("n_words") >= least))
    found = spans.join(leaders.select(F.col("version").alias("other"), "leader"), "other") \
        .select("version", "start", "stop", "leader")
    order = Window.partitionBy("version").orderBy("start", "stop")
    islands = found.withColumn("reach", F.max("stop").over(
        order.rowsBetween(Window.unboundedPreceding, -1))) \
        .withColumn("island", F.sum(F.expr("if(reach > start, 0, 1)")).over(
            order.rowsBetween(Window.unboundedPreceding, 0))) \
        .groupBy("version", "island").agg(
            F.min("start").alias("start_word"), F.max("stop").alias("end_word"),
            F.min("leader").alias("other")).drop("island")
    # a text that stands as a whole elsewhere is one passage
    single = islands.join(whole.select("version"), "version", "left_anti") \
        .join(members, "version").select(
            "doc_id", "start_word", "end_word", F.col("other").alias("other_doc_id"))
    second = members.join(whole.select("version", "leader"), "version") \
        .where("doc_id <> leader").groupBy("version").agg(F.min("doc_id").alias("second"))
    copies = members.join(whole.select("version", "leader"), "version").join(second, "version") \
        .select("doc_id", F.lit(0).cast("long").alias("start_word"), F.col("n_words").alias("end_word"),
                F.expr("if(doc_id = leader, second, leader)").alias("other_doc_id"))
    return single.unionByName(copies).select(
        "doc_id", "start_word", "end_word", F.expr("end_word - start_word").alias("n_words"),
        "other_doc_id")


def without_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` with the words of ``passages`` cut out, kept words joined by blanks.

    A document that a passage's ``other_doc_id`` points away from keeps it if
    its doc_id is the smaller one. Documents without a cut keep their text as
    it is. All columns are kept.
    """
    cuts = passages.where("other_doc_id < doc_id").groupBy("doc_id").agg(
        F.collect_list(F.struct("start_word", "end_word")).alias("cuts")) \
        .withColumnRenamed("doc_id", "d")
    rows = wrapped(docs)
    text = F.expr(
        "if(cuts is null, row.text, array_join(filter(filter(split(row.text, '[ \\\\t-\\\\r]+'), "
        "w -> w <> ''), (w, i) -> not exists(cuts, c -> i >= c.start_word and i < c.end_word)), ' '))")
    return rows.join(cuts.hint("merge"), F.col("doc_id") == F.col("d"), "left") \
        .select(*unwrapped(rows, docs.columns, text=text))
