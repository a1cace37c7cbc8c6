"""Order MinHash fingerprints, in DataFrame functions only.

The k-mers of a text (``k`` blank-separated words) are numbered by occurrence, so a repeated k-mer
counts each time. A hash of k-mer and number deals each into one of ``BINS`` bins; in each bin the ``pick``
smallest hashes are selected, put back into text order and hashed as a tuple. Two texts agree in a bin
if the same k-mers are smallest and stand in the same order, which follows the edit distance
rather than the set of words. One hash per k-mer serves all bins, so the work is one pass and a
sort over numbers.

Defined cases: a null text counts as empty; an empty text has the empty fingerprint, and two empty
fingerprints have likeness 1; a text of fewer than ``k`` words is one k-mer; equal texts have equal
fingerprints. A text of more than 2**24 words has its positions scaled to 2**24 places in text order; k-mers that
fall on one place there are ordered by their hash. Extra columns of the input are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_BITS = 6
BINS = 1 << BIN_BITS
PLACE_BITS = 24
PLACES = (1 << PLACE_BITS) - 1
HASH_BITS = 64 - BIN_BITS - PLACE_BITS
HASHES = (1 << HASH_BITS) - 1
TUPLE_BITS = 32
ROWS = 1024  # documents of a bucket when the next document is looked up
MAX_BUCKETS = 1 << 16


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BIN_BITS)


def _packed(hash_: Column, place: Column) -> Column:
    """Hash in the upper bits, position in the text in the lower ones."""
    return hash_.bitwiseAND(F.lit(~PLACES)).bitwiseOR(place.bitwiseAND(F.lit(PLACES)))


def place_of(at: Column, count: Column) -> Column:
    """Place of position ``at`` of ``count`` positions: the position itself where all have a place of their own."""
    at = at.cast("long")
    return F.when(count <= PLACES + 1, at).otherwise(F.floor(at * F.lit(PLACES + 1) / count))


def with_signature(df: DataFrame, text: str, name: str, k: int = 3, pick: int = 2) -> DataFrame:
    """Add the signature of a non-null text column: one number per bin in use, the bin above
    ``TUPLE_BITS`` bits of tuple hash."""
    keep = df.columns
    column = lambda c: F.col(f"_{c}")
    out = df.withColumn("_words", F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, r"\s+")))
    words = column("words")
    count = F.greatest(F.size(words) - (k - 1), F.least(F.size(words), F.lit(1)))
    out = out.withColumn(
        "_hashed",
        F.transform(
            F.slice(words, 1, count),
            lambda x, i: _packed(F.xxhash64(x, *[F.get(words, i + d) for d in range(1, k)]), place_of(i, F.size(words))),
        ),
    )
    out = out.withColumn("_sorted", F.sort_array("_hashed"))
    run = column("sorted")

    def same(a: Column, b: Column) -> Column:
        return F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS)

    def numbered(x: Column, number: Column) -> Column:
        return _packed(F.xxhash64(F.shiftright(x, PLACE_BITS), number.cast("long")), x)

    # equal k-mers stand together in text order: the first has number 0, positions of the others are listed
    out = out.withColumn(
        "_firsts", F.filter(run, lambda x, i: (i == 0) | ~same(x, F.coalesce(F.get(run, i - 1), F.lit(0))))
    )
    places = F.when(F.size(run) > 1, F.sequence(F.lit(1), F.size(run) - 1)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("_more", F.filter(places, lambda p: same(F.get(run, p), F.get(run, p - 1))))
    more = column("more")
    out = out.withColumn("_heads", F.filter(more, lambda p, j: (j == 0) | (F.get(more, j - 1) != p - 1)))
    out = out.withColumn("_lasts", F.filter(more, lambda p, j: F.coalesce(F.get(more, j + 1) != p + 1, F.lit(True))))
    later = F.flatten(
        F.transform(
            F.arrays_zip("_heads", "_lasts"),
            lambda z: F.transform(
                F.sequence(z["_heads"], z["_lasts"]), lambda p: numbered(F.get(run, p), p - z["_heads"] + 1)
            ),
        )
    )
    firsts = F.transform("_firsts", lambda x: numbered(x, F.lit(0)))
    out = out.withColumn("_items", F.sort_array(F.concat(firsts, later)))
    items = column("items")
    out = out.withColumn(
        "_picked",
        F.filter(items, lambda x, i: (i < pick) | (_bin(F.coalesce(F.get(items, i - pick), F.lit(0))) != _bin(x))),
    )
    # bin, position, hash: sorting restores the text order inside a bin
    ordered = F.transform(
        "_picked",
        lambda x: F.shiftleft(_bin(x), 64 - BIN_BITS)
        .bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(PLACES)), HASH_BITS))
        .bitwiseOR(F.shiftright(x, PLACE_BITS).bitwiseAND(F.lit(HASHES))),
    )
    out = out.withColumn("_ordered", F.sort_array(ordered))
    seq = column("ordered")

    def tuple_hash(x: Column, i: Column) -> Column:
        parts = [x.bitwiseAND(F.lit(HASHES))]
        for d in range(1, pick):
            follower = F.get(seq, i + d)
            parts.append(F.when(_bin(follower) == _bin(x), follower.bitwiseAND(F.lit(HASHES))))
        return F.shiftleft(_bin(x), TUPLE_BITS).bitwiseOR(F.xxhash64(*parts).bitwiseAND(F.lit((1 << TUPLE_BITS) - 1)))

    opens = lambda x, i: (i == 0) | (_bin(F.coalesce(F.get(seq, i - 1), F.lit(0))) != _bin(x))
    entries = F.transform(seq, lambda x, i: F.when(opens(x, i), tuple_hash(x, i)))
    out = out.withColumn("_entries", entries)
    return out.select(*keep, F.filter("_entries", lambda x: x.isNotNull()).alias(name))


def as_text(signature: Column) -> Column:
    """Ten hexadecimal digits for each bin in use."""
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 10, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bins among the bins that either signature uses."""
    bins = lambda c: F.transform(c, lambda x: F.shiftright(x, TUPLE_BITS))
    used = F.size(F.array_union(bins(a), bins(b)))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / used)


def _bucket(ids: DataFrame) -> Column:
    """Number of a range of ids, larger ids first, rows without an id last. Ranges follow the quantiles of
    all ids; where many are needed each is cut evenly."""
    n = ids.count()
    coarse = int(min(256, -(-n // ROWS)) or 1)
    fine = int(min(MAX_BUCKETS // 256, -(-n // (ROWS * 256))) or 1)
    shares = [i / coarse for i in range(1, coarse)]
    row = ids.agg(
        F.min("doc_id").alias("lo"),
        F.max("doc_id").alias("hi"),
        (F.percentile_approx("doc_id", shares, 10_000) if shares else F.lit(None)).alias("cuts"),
    ).first()
    if row["lo"] is None:
        return F.lit(0)
    edges = [row["lo"] - 1, *sorted(set(row["cuts"] or [])), row["hi"]]
    edges = sorted(set(edges))
    cuts = F.array(*[F.lit(e).cast("long") for e in edges[1:-1]]).cast("array<long>")
    below = F.size(F.filter(cuts, lambda e: e < F.col("doc_id")))  # edges[below] < id <= edges[below + 1]
    number = (len(edges) - 2 - below) * fine
    if fine > 1:
        all_edges = F.array(*[F.lit(e).cast("long") for e in edges])
        low, high = F.get(all_edges, below), F.get(all_edges, below + 1)
        number = number + F.floor((high - F.col("doc_id")) * fine / (high - low))
    return F.when(F.col("doc_id").isNull(), F.lit(len(edges) * fine)).otherwise(number).cast("int")


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """Add ``next_<c>`` of the next row by descending doc_id for the carried columns; after the last row comes
    the first. Rows without an id come last, equal ids are ordered by a hash of the text.

    Ranges of ids are ordered in parallel. The first row of a range is also sent to the range before it. The
    table of ranges has ``MAX_BUCKETS`` rows at most, so it may go to every task.
    """
    bucket = _bucket(docs.select("doc_id"))
    ranges = docs.select("doc_id", bucket.alias("at")).groupBy("at").agg(F.max("doc_id").alias("first_id"))
    over = Window.orderBy("at")
    ranges = ranges.select(
        "at",
        "first_id",
        F.coalesce(F.lag("at").over(over), F.last("at").over(over.rowsBetween(0, Window.unboundedFollowing))).alias("before"),
    )
    placed = docs.withColumn("at", bucket).join(F.broadcast(ranges), "at")
    own = F.struct(F.col("at"), F.lit(False).alias("extra"))
    copy = F.struct(F.col("before").alias("at"), F.lit(True).alias("extra"))
    opens = F.col("doc_id").eqNullSafe(F.col("first_id"))
    dealt = placed.select(*docs.columns, F.explode(F.when(opens, F.array(own, copy)).otherwise(F.array(own))).alias("to"))
    dealt = dealt.select(*docs.columns, "to.at", "to.extra", F.xxhash64("text").alias("tie"))
    order = Window.partitionBy("at").orderBy("extra", F.col("doc_id").desc_nulls_last(), "tie")
    out = dealt.select(*docs.columns, "extra", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried])
    return out.where(~F.col("extra")).drop("extra")


def fingerprints(docs: DataFrame, k: int = 3, pick: int = 2) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = with_next(with_signature(base, "text", "signature", k, pick), ["text", "signature"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(
        F.substring("text", 1, F.length("text") - half), F.substring("next_text", 1, half)
    )
    base = base.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "signature", "next_signature", edited.alias("edited")
    )
    base = with_signature(base, "edited", "edited_signature", k, pick)
    return base.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("signature")).alias("fingerprint"),
        as_text(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )
