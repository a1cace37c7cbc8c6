"""Similarity join on word n-grams (Jaccard) by a grouped prefix join.

A document is the set of its distinct shingles. In a common order of all shingles, two sets can only be similar if they share
one of the first few, their prefixes. Shingles are ordered by the count of their rarest word (on a logarithmic scale), then by hash: a shingle occurs
at most as often as its rarest word, so prefixes hold rare ones, and only the counts of frequent words have to be known.
A word is frequent if it makes up more than ``1 / FREQUENT`` of all words, so there are fewer than ``FREQUENT`` of them at any size.

Documents with the same set are one node. Nodes with the same prefix and set size are one group: the index has one entry for each
shingle of a group's prefix, and sizes and positions are tested once for each pair of groups. Pairs of groups that pass are expanded
to their members. Parity bitmaps reject members whose sets differ in too many shingles for certain; the rest are verified on
the sets themselves.

Members meet in bounded blocks: the members under a shingle are cut into pieces of ``PIECE``, and each pair of pieces is a task
of its own, so a hot shingle is spread. Blocks do not emit all pairs. In the first round each member names its
most promising partner, in the second its most promising partner in every other component that the verified links have formed,
and the third emits all pairs that still lie between components. Pairs inside a component need no test, so no link between
components is lost.

Shingles are told apart by 64-bit hashes; two of a pair's own shingles collide with a probability of about their number
squared over 2^64.

Defined cases: null texts and texts without words have no set and link with nothing, each is its own component (a null id stays
null); texts with fewer words than a shingle are one shingle; repeated rows and equal texts share a component; a row without an id
gets the smallest id of its component, null if there is none. Long texts are read in pieces and compared whole. An empty table gives no
rows. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailcast.llm.common import stored
from retailcast.llm.components import connected

FREQUENT = 1 << 20
BITMAP = 1024  # bits
PIECE = 1024  # members in one side of a block
ROWS = 256  # groups compared with all others of a block at once
SENT = 1 << 16  # pairs of a block's search sent together
READ = 1 << 20  # characters split together
HELD = 1 << 18  # words counted together in a task
_BLANKS = frozenset(" \t\n\x0b\x0c\r")


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, lower case, in runs of about ``READ`` characters."""
    at, end = 0, len(text or "")
    while at < end:
        to = min(at + READ, end)
        while to < end and text[to] not in _BLANKS:
            to += 1
        yield text[at:to].encode("utf-8", "replace").lower().split()  # A-Z and ASCII blanks only
        at = to


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a whole text as rows of word numbers, the word hashes, and the shingles' hashes, sorted."""
    ids: dict[bytes, int] = {}
    runs = [np.array([ids.setdefault(w, len(ids)) for w in run], np.int32) for run in words_of(text)]
    codes = np.concatenate(runs or [np.zeros(0, np.int32)])
    hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in ids], np.uint64)
    if not len(codes):
        return np.zeros((0, width), np.int32), hashes, np.zeros(0, np.uint64)
    width = min(width, len(codes))
    mixed = np.full(len(codes) - width + 1, width, np.uint64)
    for k in range(width):
        mixed = _mixed(mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[codes[k : len(codes) - width + 1 + k]])
    mixed, first = np.unique(mixed, return_index=True)
    return codes[first[:, None] + np.arange(width)], hashes, mixed


def frequent_words(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the words that make up more than ``1 / FREQUENT`` of all."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()

        def flushed() -> pd.DataFrame:
            out = pd.DataFrame(
                {"h": np.array([xxhash.xxh64_intdigest(w, 42) for w in seen], np.uint64).view(np.int64), "n": list(seen.values())}
            )
            seen.clear()
            return out

        for pdf in batches:
            for text in pdf["text"]:
                for run in words_of(text):
                    seen.update(run)
                    if len(seen) > HELD:
                        yield flushed()
        if seen:
            yield flushed()

    counts = stored(docs.select("text").mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "words")
    least = max((counts.agg(F.sum("n")).first()[0] or 0) // FREQUENT, 1)
    rows = counts.where(F.col("n") > least).toArrow()
    hashes = rows["h"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], rows["n"].to_numpy()[order]


def described(text: Column, words: tuple[np.ndarray, np.ndarray], width: int, percent: int) -> Column:
    """``n`` shingles, ``hi, lo`` (hash of the set), ``phi, plo`` (hash of the prefix), ``prefix`` and ``bits`` of a text."""
    known, counts = words

    def digest(array: np.ndarray) -> tuple[int, int]:
        both = np.frombuffer(xxhash.xxh3_128_digest(array.tobytes()), np.int64)
        return int(both[0]), int(both[1])

    def one(text: str | None) -> tuple:
        rows, hashes, mixed = shingle_set(text, width)
        n = len(mixed)
        if not n:
            return 0, 0, 0, 0, 0, [], b""
        at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
        rate = np.where(known[at] == hashes, counts[at], 0) if len(known) else np.zeros(len(hashes), np.int64)
        size = n - -(-percent * n // 100) + 1
        level = (16 * np.log2(1 + rate)).astype(np.uint16)[rows].min(1)
        prefix = mixed[np.argsort(level, kind="stable")[:size]]  # by hash inside a level
        bits = np.bincount((mixed & np.uint64(BITMAP - 1)).astype(np.int64), minlength=BITMAP) & 1
        return n, *digest(mixed), *digest(prefix), prefix.view(np.int64), np.packbits(bits.astype(np.uint8)).tobytes()

    names = ["n", "hi", "lo", "phi", "plo", "prefix", "bits"]

    @F.pandas_udf("n long, hi long, lo long, phi long, plo long, prefix array<long>, bits binary")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=names)

    return run(text)


def _blocks(rows: DataFrame, sizes: DataFrame, item: str, *fields: str) -> DataFrame:
    """``rows`` (token, ...) as lists, one for each pair of pieces of a token; ``mine`` marks the first piece.

    ``sizes`` has the tokens wanted and their row counts ``m``.
    """
    dealt = rows.join(sizes.select("token", F.ceil(F.col("m") / PIECE).cast("int").alias("parts")).hint("merge"), "token")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(item), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    held = F.struct(*fields, (F.col("part") == F.col("i")).alias("mine"))
    return dealt.repartition("token", "i", "j").groupBy("token", "i", "j").agg(F.collect_list(held).alias("rows"))


def _fits(n: np.ndarray, pos: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of groups under a shingle can be similar by size and position, if it is the first one that they share."""
    fits = np.zeros((len(n), len(n)), bool)
    for at in range(0, len(n), ROWS):
        a, b = n[at : at + ROWS, None], n[None, :]
        most = 1 + np.minimum(a - pos[at : at + ROWS, None] - 1, b - pos[None, :] - 1)
        fits[at : at + ROWS] = (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & ((100 + percent) * most >= percent * (a + b))
    same = np.arange(len(n))
    fits[same, same] = pos == 0  # members of one group share the first shingle of the prefix first
    return fits


def _numbers(column: pa.Array, at: int) -> np.ndarray:
    return column.field(at).to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(batch: pa.RecordBatch, at: int) -> tuple[list[tuple[int, int]], pa.Array]:
    """Bounds and flat elements of a column of lists."""
    ends = np.concatenate([[0], np.cumsum(batch.column(at).value_lengths().to_numpy(zero_copy_only=False))]).astype(int).tolist()
    return list(zip(ends[:-1], ends[1:], strict=True)), batch.column(at).flatten()


def group_index(nodes: DataFrame, percent: int) -> DataFrame:
    """``token, gid, n, pos, node, bits``: the members of the groups that have a possible partner under a shingle of their
    prefix, or several members."""
    key = ["n", "phi", "plo"]
    groups = nodes.groupBy(*key).agg(F.min("node").alias("gid"), F.count("*").alias("members"), F.first("prefix").alias("prefix"))
    groups = stored(groups, "groups")
    entries = groups.select("gid", "n", "members", F.posexplode("prefix").alias("pos", "token"))
    sizes = entries.groupBy("token").agg(F.count("*").alias("m"), F.sum("members").alias("all")).where("all > 1")
    blocks = _blocks(entries, stored(sizes, "shared"), "gid", "gid", "n", "pos", "members")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, flat = _lists(batch, 1)
            token = np.repeat(batch.column(0).to_numpy(), [e - s for s, e in bounds])
            gid, n, pos, members = (_numbers(flat, k) for k in range(4))
            kept = np.zeros(len(gid), bool)
            for s, e in bounds:
                fits = _fits(n[s:e], pos[s:e], percent)
                alone = np.arange(e - s)
                fits[alone, alone] &= members[s:e] > 1
                kept[s:e] = fits.any(1)
            yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (token, gid, pos)], names=["token", "gid", "pos"])

    kept = stored(blocks.select("token", "rows").mapInArrow(keep, "token long, gid long, pos long").distinct(), "entries")
    named = groups.select("gid", *key).join(kept.select("gid").distinct().hint("merge"), "gid", "left_semi")
    members = nodes.select(*key, "node", "bits").join(named.hint("merge"), key).select("gid", "node", "n", "bits")
    return stored(kept.join(members.hint("merge"), "gid").select("token", "gid", "n", "pos", "node", "bits"), "index")


def _possible(n, pos, gid, comp, bits, mine, percent) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each member of a block, the later ones with which it may be linked, and the number of bits in which they differ."""
    groups, at, of = np.unique(gid, return_index=True, return_inverse=True)
    fits = _fits(n[at], pos[at], percent)
    crossed = mine.any() and not mine.all()
    for i in range(len(n)):
        j = np.flatnonzero(fits[of[i]][of[i + 1 :]]) + i + 1
        j = j[comp[j] != comp[i]]
        if crossed:
            j = j[mine[j] != mine[i]]
        if len(j):
            apart = np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64)
            ok = (100 + percent) * apart <= (100 - percent) * (n[j] + n[i])
            if ok.any():
                yield i, j[ok], apart[ok]


def _nearest(possible, node, comp, linked) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the pairs of a block, each member's with its nearest partner, smallest node first; with ``linked`` its nearest one
    in each other component, members being in order of their component. A few numbers a member are held, never all pairs."""
    least, partner, now = np.zeros(len(node), np.int64), np.full(len(node), -1), None

    def taken() -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(partner >= 0)
        return at, partner[at]

    for i, j, apart in possible:
        if linked and comp[i] != now:
            if now is not None:
                yield taken()
                partner[:] = -1
            now = comp[i]
        held = partner[j]
        closer = (held < 0) | (apart < least[j]) | ((apart == least[j]) & (node[i] < node[held]))
        least[j[closer]], partner[j[closer]] = apart[closer], i
        order = np.lexsort((node[j], apart, comp[j]) if linked else (node[j], apart))
        if linked:
            first = np.ones(len(j), bool)
            first[1:] = comp[j[order]][1:] != comp[j[order]][:-1]
            yield np.full(int(first.sum()), i), j[order][first]
            continue
        best, bits = j[order[0]], apart[order[0]]
        if partner[i] < 0 or (bits, node[best]) < (least[i], node[partner[i]]):
            least[i], partner[i] = bits, best
    yield taken()


def pairs_in(node, gid, n, pos, comp, bits, mine, percent: int, nearest: bool, linked: bool) -> Iterator[np.ndarray]:
    """The pairs of nodes that a block names, smaller node first, in runs of about ``SENT``; a run has no pair twice."""
    if linked:
        order = np.argsort(comp, kind="stable")
        node, gid, n, pos, comp, bits, mine = (x[order] for x in (node, gid, n, pos, comp, bits, mine))
    found = _possible(n, pos, gid, comp, bits, mine, percent)
    found = _nearest(found, node, comp, linked) if nearest else ((np.full(len(j), i), j) for i, j, _ in found)
    held, size = [], 0

    def run() -> np.ndarray:
        a, b = np.concatenate(held, 1)
        return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)

    for i, j in found:
        held.append(np.stack([node[i], node[j]]))
        size += len(i)
        if size >= SENT:
            yield run()
            held, size = [], 0
    if size:
        yield run()


def block_pairs(index: DataFrame, groups: DataFrame | None, percent: int, nearest: bool) -> DataFrame:
    """Distinct candidates ``a < b`` between components. With ``nearest``, only the most promising partner of a node in each
    other component of its block, or in the block if there are no components yet."""
    if groups is None:
        rows = index.withColumn("comp", F.col("node"))
    else:
        named = groups.select(F.col("node").alias("member"), "root")
        rows = index.join(named.hint("merge"), F.col("node") == F.col("member"), "left").withColumn("comp", F.coalesce("root", "node"))
        rows = stored(rows.select("token", "gid", "n", "pos", "node", "bits", "comp"), "rows")
    sizes = rows.groupBy("token").agg(F.count("*").alias("m"), F.min("comp").alias("least"), F.max("comp").alias("most"))
    sizes = stored(sizes.where("least < most"), "mixed")
    blocks = _blocks(rows, sizes, "node", "node", "gid", "n", "pos", "comp", "bits")
    linked = groups is not None

    def sent(found: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.concatenate(found or [np.zeros((0, 2), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, flat = _lists(batch, 0)
            node, gid, n, pos, comp = (_numbers(flat, k) for k in range(5))
            mine = flat.field(6).to_numpy(zero_copy_only=False).astype(bool)
            out, size = [], 0
            for s, e in bounds:
                bits = np.frombuffer(b"".join(flat.field(5).slice(s, e - s).to_pylist()), np.uint64).reshape(-1, BITMAP // 64)
                block = (x[s:e] for x in (node, gid, n, pos, comp))
                for pairs in pairs_in(*block, bits, mine[s:e], percent, nearest, linked):
                    out.append(pairs)
                    size += len(pairs)
                    if size >= SENT:
                        yield sent(out)
                        out, size = [], 0
            yield sent(out)

    return stored(blocks.select("rows").mapInArrow(search, "a long, b long").distinct(), "pairs")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar."""

    @F.pandas_udf("boolean")
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    left = sets.select(F.col("node").alias("a"), F.col("set").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("right"))
    joined = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return stored(joined.where(alike("left", "right")).select("a", "b"), "links")


def sets_of(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """The set of each node, from the text of one of its documents."""

    @F.pandas_udf("binary")
    def set_of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, width)[2].tobytes() for t in texts])

    keyed = docs.select(F.col("doc_id").alias("key_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key_text"), "text")
    same = F.col("key_id").eqNullSafe(F.col("best.key_id")) & (F.col("key_text") == F.col("best.key_text"))
    found = keyed.join(nodes.select("node", "best").hint("merge"), same).select("node", set_of("text").alias("set"))
    return stored(found.groupBy("node").agg(F.first("set").alias("set")), "sets")  # repeated rows have a set each


def links(docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``a, b`` that connect the same nodes as all similar pairs do. ``nodes`` has distinct sets."""
    index = group_index(nodes, percent)
    tested = block_pairs(index, None, percent, nearest=True)
    # a node that has a possible partner is in one of these pairs
    wanted = stored(tested.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    sets = sets_of(docs, nodes.join(wanted.hint("merge"), "node", "left_semi"), width)
    index = stored(index.join(wanted.hint("merge"), "node", "left_semi"), "index")
    found = verified(tested, sets, percent)
    for nearest in (True, False):
        groups = stored(connected(found), "components")
        pairs = block_pairs(index, groups, percent, nearest)
        fresh = stored(pairs.join(tested.hint("merge"), ["a", "b"], "left_anti"), "fresh")
        found = stored(found.unionByName(verified(fresh, sets, percent)), "links")
        tested = stored(tested.unionByName(fresh), "tested")
    return found


def similar_groups(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; documents link at a Jaccard similarity of ``percent`` or more."""
    words = frequent_words(docs)
    rows = docs.select(
        F.col("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("key_text"),
        described(F.col("text"), words, width, percent).alias("d"),
    )
    rows = stored(rows.select("doc_id", "key_text", "d.*"), "described")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("key_id"), "key_text"))
    nodes = (
        rows.where("n > 0")
        .groupBy("hi", "lo")
        .agg(best.alias("best"), *[F.first(c).alias(c) for c in ("n", "phi", "plo", "prefix", "bits")])
        .withColumn("node", F.monotonically_increasing_id())  # written once, then fixed
    )
    nodes = stored(nodes, "nodes")
    groups = stored(connected(links(docs, nodes, width, percent)), "components").withColumnRenamed("node", "member")
    named = nodes.join(groups.hint("merge"), F.col("node") == F.col("member"), "left").select(
        "hi", "lo", F.coalesce("root", "node").alias("root"), F.col("best.key_id").alias("first_id")
    )
    named = stored(named, "named")
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stored(named.join(smallest.hint("merge"), "root").select("hi", "lo", "component_id"), "ids")
    lone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    held = rows.where("n > 0").select("doc_id", "hi", "lo", F.col("n").alias("n_shingles")).join(named.hint("merge"), ["hi", "lo"])
    return held.select("doc_id", "n_shingles", "component_id").unionByName(lone)
