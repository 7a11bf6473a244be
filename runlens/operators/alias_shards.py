"""Alias tables of the successors of each word of a corpus, built from packed pairs.

Words are numbered in the order of their text, so a number stands for a word and for its
place among others. Pairs are dealt by their second word, where they are summed and get its
number, and then by their first word, whose whole table a shard builds with numpy. The pairs
of a word that may have more successors than a table holds are dealt by table instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from runlens.operators.indexing import row_index
from runlens.operators.word_pairs import (
    CHUNK_BYTES, EOS, SHARD_TOKENS, Words, _dealt, _found, _groups, _in_shards, _pairs, _summed)
from runlens.session import materialize

#: shares of a cell are whole numbers of which this many make it full
FULL = 1_000_000_000
#: words dealt at a time, pairs of one row, words whose tables share a page, and cells of a
#: page of a wide table
_WORDS_AT_A_TIME, _PAIRS_PER_ROW, PAGE_WORDS, PAGE_CELLS = 1 << 20, 1 << 18, 32, 1024
#: pages of wide tables have numbers from here down, this many for a table
_WIDE, _WIDE_PAGES = -(1 << 40), 1 << 20
_PAIR_ROWS = "kid long, shard int, prev binary, next binary, n binary, hash binary"
_WEIGHT_ROWS = "kid long, shard int, address binary, next binary, weight binary"


def alias_cells(begins: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, keep, other): cells of tables of items in order; a table ends where the next begins.

    A cell gives its own item, ``order``, below ``keep`` of ``FULL`` and above it the item of
    the cell ``other`` of its table. Items lighter than a cell come first. Gaps are whole
    numbers, so all sums are exact and do not depend on where they start.
    """
    sizes = np.diff(begins, append=len(weights))
    of = np.repeat(np.arange(len(begins)), sizes)
    share = np.floor(weights * sizes[of] / np.add.reduceat(weights, begins)[of] * FULL + 0.5).astype(np.int64)
    order = np.argsort(of * 2 + (share >= FULL), kind="stable")
    share = share[order]
    heavy, gap = share >= FULL, np.abs(share - FULL)
    lines, lengths = _groups(of * 2 + heavy)
    upto = np.cumsum(gap)
    upto -= np.repeat(upto[lines] - gap[lines], lengths)
    # the tables behind each other on one line, so that one search finds places in all
    room = np.maximum.reduceat(upto, begins) + 1
    start = (np.cumsum(room) - room)[of]
    light, heavy = np.flatnonzero(~heavy), np.flatnonzero(heavy)
    from_, to = (start + upto - gap)[light], (start + upto)[heavy]
    keep, other = np.full(len(share), FULL), np.arange(len(share))

    # a light cell is topped up by the first heavy item whose surplus ends beyond its place
    at = np.searchsorted(to, from_, side="right")
    found = np.flatnonzero(at < len(heavy))
    found = found[of[heavy[at[found]]] == of[light[found]]]
    keep[light[found]], other[light[found]] = share[light[found]], heavy[at[found]]
    # a heavy one by the next heavy one, for what light cells have drawn too much
    mine, after = heavy[:-1], heavy[1:]
    same = of[mine] == of[after]
    drawn, mine = np.searchsorted(from_, to[:-1], side="left")[same] - 1, mine[same]
    last = light[drawn] if len(light) else drawn
    drawn = np.where((drawn >= 0) & (of[last] == of[mine]), upto[last], 0)
    keep[mine], other[mine] = np.minimum(FULL, FULL + upto[mine] - drawn), after[same]
    return order, keep.astype(np.int32), (other - begins[of]).astype(np.int32)


def _arrays(table: pa.Table, **types: type) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(table.column(name).to_pylist()), kind) for name, kind in types.items()]


def _deal_names(shards: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers and hashes of words, dealt by word as pairs are."""
    held: list[pa.RecordBatch] = []

    def dealt():
        if held:
            rows = pa.Table.from_batches(held)
            ids, numbers, hashes = (rows.column(x).to_numpy() for x in ("id", "number", "hash"))
            yield _dealt(rows.column("kid")[0].as_py(), ids, ids, np.zeros(len(ids), bool), shards,
                         {"prev": ids, "next": numbers, "n": np.zeros(len(ids), np.uint8), "hash": hashes})
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= _WORDS_AT_A_TIME:
            yield from dealt()
            held = []
    yield from dealt()


class _Names:
    """Numbers and hashes by id: those dealt to a shard, and those of words dealt to many."""

    def __init__(self, rows: pa.Table, everywhere: np.ndarray):
        ids, numbers, hashes = _arrays(rows, prev=np.int64, next=np.int64, hash=np.int64)
        ids, numbers, hashes = (np.concatenate([x, y]) for x, y in zip((ids, numbers, hashes), everywhere))
        order = np.argsort(ids, kind="stable")
        self.ids, self.numbers, self.hashes = ids[order], numbers[order], hashes[order]

    def of(self, ids: np.ndarray) -> np.ndarray:
        known, at = _found(self.ids, ids)
        if not known.all():
            raise RuntimeError("a pair came to a shard without the number of its word")
        return at


def _named(rows: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Rows of pairs, and rows of names."""
    named = rows.column("named").combine_chunks()
    return rows.filter(pc.invert(named)), rows.filter(named)


def _number_next(everywhere: np.ndarray, split: np.ndarray, end: int, shards: int, kind: type,
                 table: pa.Table) -> pa.Table:
    """Pairs dealt by their second word: summed, under its number, dealt by the first word.

    Pairs whose first word is in ``split`` take the hash of the second along, as they are.
    """
    pairs, names = _named(table)
    prev, following, n = _arrays(pairs, prev=np.int64, next=np.int64, n=np.int32)
    empty = pa.schema([("kid", pa.int64()), ("shard", pa.int32()), *((x, pa.binary()) for x in (
        "prev", "next", "n", "hash"))]).empty_table()
    live = prev != end
    if not live.any():
        return empty
    following, prev, n = _summed(following[live], prev[live], n[live])
    names = _Names(names, everywhere)
    at = names.of(following)
    following, hashes = names.numbers[at].astype(kind), names.hashes[at]
    kid, apart = pairs.column("kid")[0].as_py(), _found(split, prev)[0]
    out, rest = [empty], ~apart
    if rest.any():
        dealt = _dealt(kid, prev[rest], prev[rest], np.zeros(rest.sum(), bool), shards,
                       {"prev": prev[rest], "next": following[rest], "n": n[rest].astype(np.int32)})
        out.append(pa.Table.from_batches([dealt]).append_column("hash", pa.nulls(dealt.num_rows, pa.binary())))
    columns = [x[apart] for x in (prev, following, n, hashes)]
    rows = range(0, len(columns[0]), _PAIRS_PER_ROW)
    out.append(pa.Table.from_arrays(
        [pa.array([kid] * len(rows), pa.int64()), pa.array([-1] * len(rows), pa.int32()),
         *(pa.array([x[i:i + _PAIRS_PER_ROW].tobytes() for i in rows], pa.binary()) for x in columns)],
        names=empty.column_names))
    return pa.concat_tables(out)


def _tables(address: np.ndarray, following: np.ndarray, weights: np.ndarray, page_cells: int) -> pa.Table:
    """One row a table of items that are in order, and more where it is wide.

    Result: address, chunk (place among these rows), n (cells of the table), its cells, with
    the items that ``next`` and ``other`` give, and the sum of its weights. Where all cells
    are full, there is neither ``keep`` nor ``other``.
    """
    begins, sizes = _groups(address)
    order, keep, other = alias_cells(begins, weights)
    following = following[order]
    plain = np.minimum.reduceat(keep, begins) == FULL
    rows = -(-sizes // page_cells)
    table = np.repeat(np.arange(len(begins)), rows)
    chunk = np.arange(len(table)) - np.repeat(np.cumsum(rows) - rows, rows)
    bounds = np.append(begins[table] + chunk * page_cells, len(address))
    short = np.append(0, np.cumsum(np.where(plain[table], 0, np.diff(bounds))))
    parts = np.repeat(~plain, sizes)
    others = following[np.repeat(begins, sizes) + other]

    def lists(offsets, values, mask=None):
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values), mask=mask)
    return pa.table({
        "address": address[begins][table], "chunk": chunk, "n": sizes[table], "next": lists(bounds, following),
        "keep": lists(short, keep[parts], pa.array(plain[table])),
        "other": lists(short, others[parts], pa.array(plain[table])),
        "weight": np.add.reduceat(weights, begins)[table]})


def _build(temperature: float, kind: type, page_cells: int, table: pa.Table) -> pa.Table:
    """The tables of words all of whose pairs are in this shard."""
    pairs, names = _named(table)
    prev, following, n = _arrays(pairs, prev=np.int64, next=kind, n=np.int32)
    if not len(prev):
        return _no_tables(kind)
    names = _Names(names, np.empty((3, 0), np.int64))
    address = names.numbers[names.of(prev)]
    order = np.lexsort((following, address))
    address, following, n = address[order], following[order], n[order]
    begins, sizes = _groups(address)
    top = np.repeat(np.maximum.reduceat(n, begins), sizes)
    return _tables(address, following, (n / top) ** (1 / temperature), page_cells)


def _build_apart(kind: type, page_cells: int, table: pa.Table) -> pa.Table:
    address, following, weights = _arrays(table, address=np.int64, next=kind, weight=np.float64)
    order = np.lexsort((following, address))
    return _tables(address[order], following[order], weights[order], page_cells)


def _no_tables(kind: type) -> pa.Table:
    none = np.empty(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array([0], pa.int32()), pa.array([], pa.int32()))
    following = pa.ListArray.from_arrays(pa.array([0], pa.int32()), pa.array(none.astype(kind)))
    return pa.table({"address": none, "chunk": none, "n": none, "next": following, "keep": lists, "other": following,
                     "weight": none.astype(np.float64)})


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prev, n = _arrays(pa.Table.from_batches([batch]), prev=np.int64, n=np.int64)
        order = np.argsort(prev, kind="stable")
        prev, n = prev[order], n[order]
        if len(prev):
            begins, sizes = _groups(prev)
            yield pa.RecordBatch.from_arrays(
                [pa.array(prev[begins]), pa.array(sizes), pa.array(np.maximum.reduceat(n, begins))],
                names=["id", "cells", "top"])


def _deal_tables(big: np.ndarray, temperature: float, kind: type, shards: int,
                 batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights of pairs, dealt by table; ``big``: id, top, blocks and first address, by id."""
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        prev, following, n, hashes = _arrays(rows, prev=np.int64, next=kind, n=np.int64, hash=np.int64)
        if len(prev):
            _, top, blocks, first = big[:, np.searchsorted(big[0], prev)]
            address = first + hashes % blocks
            yield _dealt(rows.column("kid")[0].as_py(), address, address, np.zeros(len(prev), bool), shards, {
                "address": address, "next": following, "weight": (n / top) ** (1 / temperature)})


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tables of each page in one row; they come in order of page and place."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        pages = batch.column("page").to_numpy()
        cut = int(np.searchsorted(pages, pages[-1]))  # the last page may go on
        if cut or (held and held[0].column("page")[0].as_py() != pages[0]):
            yield from _bound(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from _bound(pa.Table.from_batches(held))


def _bound(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    rows = rows.combine_chunks()
    pages, places = (rows.column(x).to_numpy() for x in ("page", "place"))
    following, keep, other = (rows.column(x).combine_chunks() for x in ("next", "keep", "other"))
    sizes = pc.list_value_length(following).to_numpy()
    ends = np.cumsum(sizes, dtype=np.int64)
    begins, lengths = _groups(pages)
    page = np.repeat(np.arange(len(begins)), lengths)
    full = pc.is_null(keep).to_numpy(zero_copy_only=False)
    keeps, others = np.full(ends[-1], FULL, np.int32), following.flatten().to_numpy().copy()
    own = np.repeat(~full, sizes)
    keeps[own], others[own] = keep.flatten().to_numpy(), other.flatten().to_numpy()
    starts = np.zeros((len(begins), PAGE_WORDS + 1), np.int32)
    starts[page, places + 1] = sizes
    starts = np.cumsum(starts, axis=1, dtype=np.int32)
    bounds = np.append((ends - sizes)[begins], ends[-1])
    plain = np.minimum.reduceat(full, begins)
    parts = np.repeat(~plain, np.diff(bounds))
    short = np.append(0, np.cumsum(np.where(plain, 0, np.diff(bounds)))).astype(np.int32)

    def lists(offsets, values, mask=None):
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values), mask=mask)
    yield pa.RecordBatch.from_arrays(
        [pa.array(pages[begins]), lists(np.arange(len(begins) + 1) * (PAGE_WORDS + 1), starts.ravel()),
         lists(bounds, following.flatten().to_numpy()), lists(short, keeps[parts], pa.array(plain)),
         lists(short, others[parts], pa.array(plain)), pa.array(np.diff(bounds))],
        names=["page", "starts", "next", "keep", "other", "n"])


@dataclass(frozen=True)
class AliasTables:
    """Alias tables by address: the number of a word, or that of a block of its successors.

    ``pages``: page, and of all its tables one behind the other starts (where that of each
    place begins, and where the last one ends), next, keep and other (arrays, by cell) and
    n (cells). A page of full cells only has neither keep nor other. Numbers in turn share a
    page; a block has its own, and a wide table has many, so that draws from it are spread.
    ``wide``: address and cells of the wide tables.
    ``blocks``: of words in many blocks number, first (address of a block), and the alias
    table of their blocks: blocks, keep_block and other_block.
    """

    pages: DataFrame
    wide: DataFrame
    blocks: DataFrame | None
    names: DataFrame  # kid, id, word, n (pairs that it begins) and number
    n_words: int
    end: int
    number: str  # type of a number

    def page(self, address: str) -> str:
        """The page of an address, in SQL."""
        return (f"IF({address} < {self.n_words}, {address} div {PAGE_WORDS}, "
                f"{address} - {self.n_words - -(-self.n_words // PAGE_WORDS)})")

    def place(self, address: str) -> str:
        """The place of an address in its page, in SQL."""
        return f"CAST(IF({address} < {self.n_words}, {address} % {PAGE_WORDS}, 0) AS INT)"

    @staticmethod
    def wide_page(address: str, chunk: str) -> str:
        """The page of a chunk of a wide table, in SQL."""
        return f"{_WIDE}L - {address} * {_WIDE_PAGES}L - {chunk}"


def _everywhere(names: DataFrame, ids: np.ndarray) -> np.ndarray:
    """(ids, numbers, hashes) of a few words."""
    rows = names.where(F.col("id").isin([int(i) for i in ids])).select("id", "number", "hash").collect()
    return np.array([tuple(r) for r in rows], np.int64).reshape(-1, 3).T


def alias_tables(words: Words, temperature: float, most: int, page_cells: int = PAGE_CELLS,
                 chunk_bytes: int = CHUNK_BYTES, table_cells: int = SHARD_TOKENS) -> AliasTables:
    """Alias tables of the successors of all words but the end, as ``ngram.alias_table`` has them."""
    spark = words.table.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = row_index(words.table.select("kid", "id", "word", "n"), ["word"], "number").withColumn(
        "hash", F.xxhash64("word"))
    end = names.where(F.col("word") == EOS).select("number").first()
    end = end[0] if end else -1
    n_words = words.table.count()
    kind, number = (np.int32, "int") if n_words < 1 << 31 else (np.int64, "bigint")
    cells = f"next array<{number}>, keep array<int>, other array<{number}>"
    schema = f"address long, chunk long, n long, {cells}, weight double"

    split = np.sort(np.array([r[0] for r in words.table.where(
        (F.col("n") > most) & (F.col("word") != EOS)).select("id").collect()], np.int64))
    dealt_names = names.select("kid", "id", "number", "hash").mapInArrow(partial(_deal_names, words.shards), _PAIR_ROWS).withColumn("named", F.lit(True))
    second = np.concatenate([ids for ids, _ in words.second.values()] or [split[:0]])
    by_next = _pairs(words, "next", chunk_bytes).withColumn("hash", F.lit(None).cast("binary")).withColumn(
        "named", F.lit(False))
    pairs = materialize(_in_shards(by_next.unionByName(dealt_names), partial(
        _number_next, _everywhere(names, second), split, words.end, words.shards, kind), _PAIR_ROWS), "pairs")
    whole = pairs.where("shard >= 0").withColumn("named", F.lit(False)).unionByName(dealt_names)
    tables = _in_shards(whole, partial(_build, temperature, kind, page_cells), schema)
    blocks = None
    if len(split):
        apart, blocks = _apart(
            pairs.where("shard < 0"), names, temperature, most, page_cells, table_cells, n_words, number, schema)
        tables = tables.unionByName(apart)
    made = AliasTables(None, None, blocks, names, n_words, end, number)
    wide = f"n > {page_cells}"
    paged = tables.selectExpr(
        f"IF({wide}, {made.wide_page('address', 'chunk')}, {made.page('address')}) AS page",
        f"IF({wide}, 0, {made.place('address')}) AS place", "next", "keep", "other").repartition(
        max(parts, words.shards), "page").sortWithinPartitions("page", "place")
    pages = materialize(paged.mapInArrow(_pages, f"page long, starts array<int>, {cells}, n long"), "alias")
    found = pages.where(F.col("page") <= _WIDE).groupBy(F.expr(f"({_WIDE}L - page) div {_WIDE_PAGES}").alias(
        "address")).agg(F.sum("n").cast("int").alias("cells"))
    return replace(made, pages=pages, wide=materialize(found, "wide"))


def _apart(pairs: DataFrame, names: DataFrame, temperature: float, most: int, page_cells: int, table_cells: int,
           n_words: int, number: str, schema: str) -> tuple[DataFrame, DataFrame | None]:
    """The tables of words that may have many blocks, and the alias tables of these blocks."""
    kind = np.int32 if number == "int" else np.int64
    sizes = pairs.select("prev", "n").mapInArrow(_sizes, "id long, cells long, top long").groupBy("id").agg(
        F.max("top").alias("top"), F.sum("cells").alias("cells"))
    found = sizes.join(names, "id").select("id", "top", "cells", "number").collect()
    ids, top, cells, own = np.array(sorted(tuple(r) for r in found), np.int64).T
    blocks = -(-cells // most)
    # blocks have addresses beyond all numbers
    many = np.where(blocks > 1, blocks, 0)
    first = np.where(blocks > 1, n_words + np.cumsum(many) - many, own)
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-int(cells.sum()) // table_cells), min(4 * parts, int(blocks.sum())))
    weights = pairs.mapInArrow(partial(
        _deal_tables, np.stack([ids, top, blocks, first]), temperature, kind, shards), _WEIGHT_ROWS)
    tables = materialize(_in_shards(weights, partial(_build_apart, kind, page_cells), schema), "apart")
    return tables, _of_blocks(tables, n_words, own, blocks, first, number)


def _of_blocks(tables: DataFrame, n_words: int, own: np.ndarray, blocks: np.ndarray, first: np.ndarray,
               number: str) -> DataFrame | None:
    """The alias tables of the blocks of words that have many."""
    many = blocks > 1
    if not many.any():
        return None
    weight = np.zeros(blocks[many].sum())
    # a block that no successor came to has no table, and is not drawn
    for r in tables.where((F.col("address") >= n_words) & (F.col("chunk") == 0)).select("address", "weight").collect():
        weight[r.address - n_words] = r.weight
    rows = []
    for word, address, n in zip(own[many].tolist(), first[many].tolist(), blocks[many].tolist()):
        of = weight[address - n_words:][:n]
        filled = np.flatnonzero(of)
        order, keep, other = alias_cells(np.zeros(1, np.int64), of[filled])
        rows.append((word, address, filled[order].tolist(), keep.tolist(), filled[order][other].tolist()))
    return tables.sparkSession.createDataFrame(
        rows, f"number {number}, first long, blocks array<int>, keep_block array<int>, other_block array<int>")
