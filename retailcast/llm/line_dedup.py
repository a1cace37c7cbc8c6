"""Line dedup by content-defined chunks of lines and by passages, in DataFrame functions only.

Every line is hashed; a rolling hash over ``span`` line hashes marks a chunk start where it has a local
minimum. A start depends on the lines around it alone, so an insertion moves no boundary further away
(shift resistance), and every chunk has two lines at least (a text of one line is never cut or removed).
Chunks whose hash occurs more than once are compared byte by byte: they are grouped by hash and
content. Of each repeated chunk the first occurrence stays (smallest id, nulls last, then
smallest text hash, then position); the lines of all others are removed.

The chunks are the contract of the query (``report``, see its SQL). A start depends on three lines, so they
miss passages of few lines between other neighbours. The stage (``deduplicate``) removes the repeated chunks, cut and compared in the
same way, and beside them, where a boundary is missing, passages anchored at their own edges: every two neighbouring lines, and every line
over ``LONG_LINE`` words. Both are counted by a hash over the hashes of their lines and, where that is repeated, compared byte by byte;
a repeated run of two lines or more is removed whole, wherever it stands; the first occurrence of every line stays. A shorter line
that is repeated alone stays, unless it makes up a chunk with the blank lines around it.

Hashes alone are counted over the whole corpus; in the stage content travels only for chunks and passages with a repeated hash.

Defined cases: a null text stays null and has no lines; an empty text is one empty line; texts whose
every chunk or passage occurred before become empty; rows that are equal in id and text are one document and
get the same result. Extra columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailcast.llm.common import bind, stored

PRIME = 1_000_003
SHIFT = 1 << 31  # a chunk is packed as first line * SHIFT + number of lines
LONG_LINE = 50  # a line of more words is a passage of its own


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def chunks_of(lines: Column, span: int = 2) -> Column:
    """Packed chunks of an array of lines."""

    def rolled(hashes: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            total = x
            for k in range(1, span):
                total = total + F.coalesce(F.get(hashes, i - k), F.lit(0)) * 31**k
            return total % PRIME

        return F.transform(hashes, one)

    def starts(r: Column) -> Column:
        n = F.size(r)

        def opens(i: Column) -> Column:
            here = F.get(r, i)
            inside = (i >= 2) & (i < n - 1)
            return (i == 0) | (inside & (here < F.get(r, i - 1)) & (here <= F.get(r, i + 1)))

        return F.filter(F.sequence(F.lit(0), n - 1), opens)

    def pack(opened: Column, n: Column) -> Column:
        return F.transform(opened, lambda s, j: s.cast("long") * SHIFT + F.coalesce(F.get(opened, j + 1), n) - s)

    return bind(
        F.transform(lines, line_hash),
        lambda hashes: bind(rolled(hashes), lambda r: bind(starts(r), lambda opened: pack(opened, F.size(r)))),
    )


def _first(chunk: Column) -> Column:
    return F.floor(chunk / SHIFT).cast("int")


def _size(chunk: Column) -> Column:
    return (chunk % SHIFT).cast("int")


def _body(lines: Column, chunk: Column) -> Column:
    return F.array_join(F.slice(lines, _first(chunk) + 1, _size(chunk)), "\n")


def passages_of(lines: Column, least_words: int = LONG_LINE) -> Column:
    """Packed passages of an array of lines: every two neighbouring lines, and every line over ``least_words``
    words. Blank lines do not count; those between the two belong to the passage."""

    def line(i: Column) -> Column:
        return F.get(lines, i)

    def pairs(at: Column) -> Column:
        opened = F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))
        return F.transform(opened, lambda s, j: s.cast("long") * SHIFT + F.get(at, j + 1) - s + 1)

    def singles(at: Column) -> Column:
        long_lines = F.filter(
            at, lambda i: (F.length(line(i)) > 2 * least_words) & (F.size(F.split(F.trim(line(i)), r"\s+")) > least_words)
        )
        return F.transform(long_lines, lambda s: s.cast("long") * SHIFT + 1)

    full = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: line(i).rlike(r"\S"))
    return bind(full, lambda at: F.concat(pairs(at), singles(at)))


def _passage(lines: Column, passage: Column) -> Column:
    """First and last line of a passage, whole; a passage of one line has one."""
    first, size = _first(passage), _size(passage)
    return F.concat_ws("\n", F.get(lines, first), F.when(size > 1, F.get(lines, first + size - 1)))


def _units(lines: Column, span: int, least_words: int) -> Column:
    """The content-defined chunks of several lines (``whole``) and the passages of an array of lines, with the hash of each,
    taken over the hashes of its lines."""

    def unit(chunk: Column, hashed: Column, whole: bool) -> Column:
        return F.struct(chunk.alias("chunk"), hashed.alias("hash"), F.lit(whole).alias("whole"))

    def made(hashes: Column) -> Column:
        chunks = F.filter(chunks_of(lines, span), lambda c: _size(c) > 1)
        return F.concat(
            F.transform(chunks, lambda c: unit(c, F.xxhash64(F.slice(hashes, _first(c) + 1, _size(c))), True)),
            F.transform(
                passages_of(lines, least_words),
                lambda c: unit(c, F.xxhash64(F.get(hashes, _first(c)), F.when(_size(c) > 1, F.get(hashes, _first(c) + _size(c) - 1))), False),
            ),
        )

    return bind(F.transform(lines, lambda x: F.xxhash64(x)), made)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("key_id"), F.xxhash64("text").alias("key_text"), "text").where("text is not null")


def _later(again: DataFrame) -> DataFrame:
    """key_id, key_text and chunk of every occurrence but the first of each content; ``again`` has the occurrences with hash and body."""
    place = F.struct(F.col("key_id").isNull().alias("last"), "key_id", "key_text", "chunk")
    first = again.groupBy("hash", "body").agg(F.min(place).alias("first"), F.max(place).alias("final"))
    first = stored(first.where("first <> final"), "first-chunks")
    return (
        again.join(first, ["hash", "body"])
        .where(~place.eqNullSafe(F.col("first")))
        .select("key_id", "key_text", "chunk")
    )


def repeated_chunks(docs: DataFrame, span: int = 2) -> DataFrame:
    """key_id, key_text and chunk of every later occurrence of a chunk of several lines."""
    keyed = _keyed(docs)

    def multi(make) -> Column:
        """``make(content, hash, chunk)`` for the chunks."""

        def made(lines: Column) -> Column:
            units = F.filter(chunks_of(lines, span), lambda c: _size(c) > 1)
            return F.transform(units, lambda c: bind(_body(lines, c), lambda body: make(body, F.xxhash64(body), c)))

        return bind(F.split("text", "\n", -1), made)

    # outer forms: the optimizer derives no filter that would compute the chunks once more
    hashed = keyed.select(F.explode_outer(multi(lambda body, h, c: h)).alias("hash")).where("hash is not null")
    twice = stored(hashed.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "chunk-hashes")
    occurrences = keyed.select(
        "key_id",
        "key_text",
        F.inline_outer(
            multi(lambda body, h, c: F.struct(c.alias("chunk"), body.alias("body"), h.alias("hash")))
        ),
    ).where("hash is not null")
    return _later(stored(occurrences.join(twice.hint("merge"), "hash", "left_semi"), "chunks"))  # grows, never broadcast


def repeated_units(docs: DataFrame, span: int = 2, least_words: int = LONG_LINE) -> DataFrame:
    """key_id, key_text and chunk of every later occurrence of a chunk of several lines or of a passage."""
    keyed = _keyed(docs)
    units = bind(F.split("text", "\n", -1), lambda lines: _units(lines, span, least_words))
    spread = stored(keyed.select("key_id", "key_text", F.inline_outer(units)).where("hash is not null"), "units")
    twice = stored(spread.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "unit-hashes")
    again = spread.join(twice.hint("merge"), "hash", "left_semi")
    found = again.groupBy(F.col("key_id").alias("found_id"), F.col("key_text").alias("found_text")).agg(
        F.collect_set(F.struct("chunk", "hash", "whole")).alias("units")
    )
    same = F.col("key_id").eqNullSafe(F.col("found_id")) & (F.col("key_text") == F.col("found_text"))

    def bodies(lines: Column) -> Column:
        def one(u: Column) -> Column:
            body = F.when(u["whole"], _body(lines, u["chunk"])).otherwise(_passage(lines, u["chunk"]))
            return F.struct(u["chunk"].alias("chunk"), body.alias("body"), u["hash"].alias("hash"))

        return F.transform("units", one)

    held = keyed.join(found.hint("merge"), same)  # grows with the corpus, never broadcast
    held = held.select("key_id", "key_text", F.inline_outer(bind(F.split("text", "\n", -1), bodies)))
    return _later(stored(held, "chunks"))


def _joined(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """``row`` (the input columns) and ``removed``, the packed chunks to remove or null."""
    drop = repeated.groupBy("key_id", "key_text").agg(F.collect_set("chunk").alias("removed"))
    drop = stored(drop.withColumnsRenamed({"key_id": "drop_id", "key_text": "drop_text"}), "removed")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").alias("key_id"),
        F.xxhash64("text").alias("key_text"),
    )
    same = F.col("key_id").eqNullSafe(F.col("drop_id")) & (F.col("key_text") == F.col("drop_text"))
    return rows.join(drop.hint("merge"), same, "left")  # grows with the corpus, never broadcast


def remove_repeated(docs: DataFrame, span: int = 2) -> DataFrame:
    """``row`` (the input columns), ``kept_text``, ``n_lines`` and ``n_removed`` of every row."""
    joined = _joined(docs, repeated_chunks(docs, span))

    def left_over(lines: Column) -> Column:
        keep = F.array_except(chunks_of(lines, span), F.col("removed"))
        return F.array_join(F.flatten(F.transform(keep, lambda c: F.slice(lines, _first(c) + 1, _size(c)))), "\n")

    whole = F.col("row.text")  # the row carries the text through the join, once
    lines = F.split(whole, "\n", -1)
    text = bind(lines, left_over)
    count = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, c: acc + _size(c))
    return joined.select(
        "row",
        F.when(F.col("removed").isNull(), whole).otherwise(text).alias("kept_text"),
        F.when(whole.isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(count, F.lit(0).cast("long")).alias("n_removed"),
    )


def remove_passages(docs: DataFrame, span: int = 2, least_words: int = LONG_LINE) -> DataFrame:
    """``row`` (the input columns), ``kept_text`` and ``n_removed`` of every row: lines of repeated chunks and passages go."""
    joined = _joined(docs, repeated_units(docs, span, least_words))
    gone = F.array_distinct(
        F.flatten(F.transform("removed", lambda c: F.sequence(_first(c), _first(c) + _size(c) - 1)))
    )

    def left_over(lines: Column) -> Column:
        keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n")

    whole = F.col("row.text")
    text = bind(F.split(whole, "\n", -1), left_over)
    return joined.select(
        "row",
        F.when(F.col("removed").isNull(), whole).otherwise(text).alias("kept_text"),
        F.when(F.col("removed").isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long").alias("n_removed"),
    )


def deduplicate(docs: DataFrame, span: int = 2, least_words: int = LONG_LINE) -> DataFrame:
    """The documents without repeated chunks and passages, all other columns as they were; ``n_chars`` follows the text."""
    out = remove_passages(docs, span, least_words)
    columns = []
    for name in docs.columns:
        value = F.col(f"row.`{name}`")
        if name == "text":
            value = F.col("kept_text")
        elif name == "n_chars":
            value = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema[name].dataType)).otherwise(value)
        columns.append(value.alias(name))
    return out.select(*columns)


def report(docs: DataFrame, span: int = 2) -> DataFrame:
    """doc_id, n_lines, n_removed and the digest of the kept text of every row."""
    return remove_repeated(docs.select("doc_id", "text"), span).select(
        "row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("text_sha256")
    )
