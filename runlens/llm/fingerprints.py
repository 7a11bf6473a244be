"""Order MinHash fingerprints, as DataFrame expressions only.

A text is read as pieces: runs of non-blanks, cut after every character of a fixed
eighth of all characters. The cuts depend on the characters alone, so they do not shift
with what stands before, and texts of any length and script are read alike. Every
run of three pieces is a k-mer. Repeated k-mers are numbered by
occurrence, so each (k-mer, occurrence) is one element. Its hash names one of
64 bins and a rank within it; the two smallest of each bin are selected, put
back into text order, and hashed as a tuple. Two texts share a tuple only if
they share the selected elements in the same order, so the share of equal
tuples falls with edit distance, also where the same words are moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: pieces per k-mer and elements per tuple; bins are the top bits of the hash
KMER, TUPLE, BIN_BITS = 3, 2, 6
#: pieces are found in UTF-16 code units, two bytes read as two characters each. A unit
#: whose low byte leaves 5 when divided by 8 ends a piece; in English these are e, m and u
_LAST = "".join(rf"\x{b:02X}" for b in range(5, 256, 8))
_NO_BLANK = r"(?!\x00[\x09-\x0D\x20])[\x00-\xFF]"
#: after the blanks since the last piece, so that a match begins at a whole unit
PIECE = (r"\G(?:\x00[\x09-\x0D\x20])*+("
         rf"(?:{_NO_BLANK}[^{_LAST}])++(?:{_NO_BLANK}[{_LAST}])?|{_NO_BLANK}[{_LAST}])")

_PLACE_BITS = 23
_PLACE = (1 << _PLACE_BITS) - 1
_HASH = ~_PLACE


def _let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once under ``name`` for all its uses in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def signature(text: str) -> Column:
    """Tuple hashes of the text column of that name: an array of int, ordered by bin, empty bins left out.

    Each entry holds its bin above 24 bits of tuple hash. A null or blank text
    has an empty array, a text of fewer pieces than a k-mer one entry. Beyond 8.4 million
    pieces neighbours share a place, and are put in order by their hashes.
    """
    kmers = " , ".join(f"get(w, i + {j})" for j in range(KMER))
    packed = (f"if(size(w) < {KMER}, filter(array(xxhash64(w) & {_HASH}L), x -> size(w) > 0), "
              f"transform(sequence(0, size(w) - {KMER}), "
              f"i -> (xxhash64({kmers}) & {_HASH}L) | shiftright(i, greatest(0, "
              f"cast(ceil(log2(size(w))) as int) - {_PLACE_BITS}))))")
    again = (f"filter(sequence(0, size(s) - 1), j -> j > 0 and "
             f"(get(s, j) & {_HASH}L) = (get(s, j - 1) & {_HASH}L))")
    # runs of equal k-mers are neighbours: their later members get numbers 1, 2, ..
    runs = (f"filter(sequence(0, size(d) - 1), m -> m = 0 or "
            f"(get(s, get(d, m)) & {_HASH}L) <> (get(s, get(d, m - 1)) & {_HASH}L))")
    numbered = _let("r", runs, (
        "flatten(transform(r, (m, q) -> transform("
        "slice(d, m + 1, coalesce(get(r, q + 1), size(d)) - m), "
        f"(j, o) -> (xxhash64(get(s, j) & {_HASH}L, o + 1) & {_HASH}L) | (get(s, j) & {_PLACE}L))))"))
    first = (f"filter(s, (v, j) -> j = 0 or (v & {_HASH}L) <> (get(s, j - 1) & {_HASH}L))")
    elements = _let("d", again, f"if(size(d) = 0, s, sort_array(concat({first}, {numbered})))")
    bin_of = f"shiftrightunsigned({{}}, {64 - BIN_BITS})"
    begins = (f"filter(sequence(0, size(e) - 1), j -> j = 0 or {bin_of.format('get(e, j)')} <> "
              f"{bin_of.format('get(e, j - 1)')})")
    chosen = (f"filter(slice(e, j + 1, {TUPLE}), v -> {bin_of.format('v')} = "
              f"{bin_of.format('get(e, j)')})")
    in_order = (f"transform(sort_array(transform({chosen}, v -> shiftleft(v & {_PLACE}L, 40) | "
                f"(shiftrightunsigned(v, 24) & {(1 << 40) - 1}L))), x -> x & {(1 << 40) - 1}L)")
    tuples = (f"transform({begins}, j -> cast(shiftleft({bin_of.format('get(e, j)')}, 24) | "
              f"(xxhash64({in_order}) & 16777215L) as int))")
    pieces = (f"regexp_extract_all(decode(encode(coalesce(`{text}`, ''), 'UTF-16BE'), "
              f"'ISO-8859-1'), r'{PIECE}', 1)")
    return F.expr(_let("w", pieces, _let(
        "s", f"sort_array({packed})",
        f"if(size(s) = 0, cast(array() as array<int>), {_let('e', elements, tuples)})")))


def fingerprint(signature_: Column) -> Column:
    """A signature as text, eight hexadecimal digits an entry."""
    return F.array_join(F.transform(signature_, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples among the bins that either text fills; 1 if none does."""
    def bins(s: Column) -> Column:
        return F.transform(s, lambda x: F.shiftright(x, 24))
    either = F.size(F.array_union(bins(a), bins(b)))
    same = F.size(F.array_intersect(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(same / either)


def with_next(rows: DataFrame, bins: int) -> DataFrame:
    """Pair every row of (doc_id, ...) with the row of the next smaller doc_id.

    Adds ``following``, a struct of the columns, by one shuffle. After the
    smallest comes the largest. Rows of equal doc_id follow each other in the
    order of their other columns; a row with a null doc_id has no next row.
    Ids are cut at approximate quantiles into ``bins`` ranges of about equal
    size; the row that opens a range also goes, as a guest, to the one above.
    """
    columns = rows.columns
    ids = rows.select("doc_id").where("doc_id is not null")
    cuts = ids.agg(F.percentile_approx(
        "doc_id", [i / bins for i in range(1, bins)] or [0.5], 100 * bins)).first()[0] or []
    cuts = sorted(set(cuts))
    limits = "array(" + ", ".join(f"{c}L" for c in cuts) + ")" if cuts else "cast(array() as array<long>)"
    part = F.expr(f"size(filter({limits}, c -> c < doc_id))")
    opens = sorted((r["part"], r["top"]) for r in ids.groupBy(part.alias("part")).agg(
        F.max("doc_id").alias("top")).collect())
    placed = rows.where("doc_id is not null").withColumn("part", part) \
        .withColumn("guest", F.lit(False))
    if opens:
        # one row a range
        visits = {}
        for n, (_, top) in enumerate(opens):
            visits.setdefault(top, []).append(opens[(n + 1) % len(opens)][0])
        target = F.create_map(*(F.lit(x) for top, to in visits.items() for x in (top, to[0])))
        guests = rows.where(F.col("doc_id").isin(list(visits))) \
            .withColumn("part", target[F.col("doc_id")]).withColumn("guest", F.lit(True))
        placed = placed.unionByName(guests)
    order = Window.partitionBy("part").orderBy(
        "guest", F.desc("doc_id"), *(c for c in columns if c != "doc_id"))
    return placed.withColumn("following", F.lead(F.struct(*columns), 1).over(order)) \
        .where("not guest").drop("part", "guest") \
        .unionByName(rows.where("doc_id is null")
                     .withColumn("following", F.expr(f"cast(null as {_struct(rows)})")))


def _struct(rows: DataFrame) -> str:
    return "struct<" + ", ".join(f"{c}: {t}" for c, t in rows.dtypes) + ">"


def fingerprints(docs: DataFrame, bins: int | None = None) -> DataFrame:
    """Fingerprints of every whole text of ``docs`` and of an edited form of it.

    The edited form has the last third of the code points (rounded down)
    replaced by as many, or all, from the start of the next document in
    descending order of doc_id; after the smallest comes the largest. Needs
    doc_id and text, ignores other columns. A null text counts as empty; a
    row with a null doc_id has no next document, which counts as an empty one.
    Repeated rows follow each other. ``bins`` is the number of id ranges, by
    default four per shuffle partition.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next.
    """
    if bins is None:
        bins = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce("text", F.lit("")).alias("text"))
    own = texts.withColumn("tuples", signature("text"))
    edited = with_next(own, bins) \
        .withColumn("n_chars", F.char_length("text").cast("long")) \
        .withColumn("edited", F.expr(
            "concat(left(text, cast(n_chars - n_chars div 3 as int)), "
            "left(coalesce(following.text, ''), cast(n_chars div 3 as int)))")) \
        .select("doc_id", "n_chars", "tuples", "edited",
                F.coalesce("following.tuples", F.expr("cast(array() as array<int>)")).alias("next"))
    both = edited.withColumn("edited_tuples", signature("edited"))
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("tuples")).alias("fingerprint"),
        fingerprint(F.col("edited_tuples")).alias("edited_fingerprint"),
        likeness(F.col("tuples"), F.col("edited_tuples")).alias("near_edited"),
        likeness(F.col("tuples"), F.col("next")).alias("near_next"))
