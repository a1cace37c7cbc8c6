"""Token ids in Parquet files that allow selective reads.

Every text is encoded, an end id is appended, and documents are written in ascending id order. A row
holds doc_id, row number, token count and the ids as a list; integers are delta-encoded, row groups
and pages have stated sizes, and the column and page indexes let a reader take counts alone, or the
ids of a range of documents, without touching the rest.

Texts are encoded word by word: the tokenizer drops blanks and never joins characters over a blank, so
the ids of a text are the ids of its blank-separated words, and words seen before are not encoded again.

Defined cases: a null text counts as empty and gives the end id alone; rows without an id come
first; rows with equal ids are ordered by a hash of their text; repeated rows are written each. Extra
columns are not written.
"""

from __future__ import annotations

import json
import os
import re
import string
import sys
import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from retailcast.session import scratch_path

KNOWN = 200_000  # parts of words in a generation that a task remembers
LONGEST = 200  # characters of a part that is remembered
TOGETHER = 4 << 20  # bytes of text whose distinct words are looked up together
SIGNS = string.punctuation.replace("'", "")  # a run of them after letters is one piece
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"  # Latin, each with one letter as its lower case
PIECE = re.compile(f"[{LETTERS}]+")
END = "</w>"  # at the end of the last token of a piece
# fixed values: the steps of a tokenizer that can be applied word by word
WORD_STEPS = [
    [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)],
    [("Split", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), ("ByteLevel", None)],
    "BPE",
    None,
    END,
    None,
]
ROW_GROUP = 32 << 20
PAGE = 256 << 10


class WordEncoder:
    """Encodes texts through a memory of words, many texts at a time: each distinct word is looked at once.

    A word of Latin letters, perhaps with signs after it, is taken apart: letters and signs are never
    joined by the tokenizer. Such letters are one piece in lower case, and pieces that are not in memory
    go to the tokenizer's model together; its end ids tell them apart. Signs and any other word go through
    the whole tokenizer. The memory has two generations: when the young one is full it becomes the old one,
    and words met again move back, so rare words alone are forgotten.

    A definition with other steps than these is given whole texts.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; idle threads would spin
        self.tokenizer = Tokenizer.from_str(definition)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.by_word = steps_of(json.loads(definition)) == WORD_STEPS and all(
            c in vocab and c + END in vocab for c in pre_tokenizers.ByteLevel.alphabet()
        )
        self.pieces = Tokenizer(self.tokenizer.model)
        self.pieces.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.is_end = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.is_end[[i for token, i in vocab.items() if token.endswith(END)]] = True
        self.known, self.old = {}, {}

    def whole(self, text: str) -> bytes:
        return array("i", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        return self.lists(pa.array([text], pa.string())).values.to_numpy().tobytes()

    def lists(self, texts: pa.Array, after: bytes = b"") -> pa.ListArray:
        """Ids of each text, with the ids ``after`` behind them."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            return lists_of([self.whole(t) + after for t in texts.to_pylist()])
        sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // TOGETHER)) + 1).tolist(), len(texts)]
        return pa.concat_arrays([self.some_lists(texts.slice(a, b - a), after) for a, b in pairwise(cuts)])

    def some_lists(self, texts: pa.Array, after: bytes) -> pa.ListArray:
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded, starts = words.flatten().dictionary_encode(), words.offsets.to_numpy()
        order = np.insert(coded.indices.to_numpy(), starts[1:], len(coded.dictionary))
        lists = pa.concat_arrays([self.word_lists(coded.dictionary), lists_of([after])])
        return joined(lists, order, starts + np.arange(len(starts)))

    def word_lists(self, words: pa.Array) -> pa.ListArray:
        """Ids of each word: those of its letters and of the signs after them, or of the word as it is."""
        cores = pc.ascii_rtrim(words, SIGNS)
        plain = pc.match_substring_regex(cores, f"^[{LETTERS}]+$")
        signed = pc.and_(plain, pc.not_equal(pc.binary_length(cores), pc.binary_length(words)))
        heads = pc.if_else(plain, pc.utf8_lower(cores), words)
        tails = pc.replace_substring_regex(words.filter(signed), f"^[{LETTERS}]+", "")
        coded, signed = pa.concat_arrays([heads, tails]).dictionary_encode(), signed.to_numpy(zero_copy_only=False)
        order = coded.indices.to_numpy()
        order = np.insert(order[: len(words)], np.flatnonzero(signed) + 1, order[len(words) :])
        starts = np.arange(len(words) + 1)
        starts[1:] += np.cumsum(signed)
        return joined(lists_of(self.look_up(coded.dictionary.to_pylist())), order, starts)

    def look_up(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct parts of words, from memory if they are there."""
        if len(self.known) > KNOWN:
            self.known, self.old = {}, self.known
        found = list(map(self.known.get, parts))
        missing = [i for i, ids in enumerate(found) if ids is None]
        pieces = []
        for i in missing:
            found[i] = self.old.get(parts[i])
            if found[i] is None:
                if PIECE.fullmatch(parts[i]):
                    pieces.append(i)
                else:
                    found[i] = self.whole(parts[i])
        for at in range(0, len(pieces), 10_000):
            some = pieces[at : at + 10_000]
            coded = self.pieces.encode_batch_fast([[parts[i] for i in some]], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(coded[0].ids, np.int32)
            ends, ids = (4 * np.flatnonzero(self.is_end[ids]) + 4).tolist(), ids.tobytes()
            for i, a, b in zip(some, [0, *ends[:-1]], ends, strict=True):
                found[i] = ids[a:b]
        self.known.update((parts[i], found[i]) for i in missing if len(parts[i]) <= LONGEST)
        return found


def lists_of(found: list[bytes]) -> pa.ListArray:
    """Ids in the bytes of 32-bit integers as lists."""
    bounds = np.cumsum([0, *map(len, found)]) // 4
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(np.frombuffer(b"".join(found), np.int32)))


def joined(lists: pa.ListArray, order: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    """The lists numbered in ``order``, with those from one start to the next made one."""
    found = lists.take(pa.array(order))
    return pa.ListArray.from_arrays(found.offsets.take(pa.array(starts)), found.values)


def worker_encoder(definition: str) -> WordEncoder:
    """The encoder of this Python worker: tasks that follow each other in one worker share its memory.

    It is kept in a module of its own, because the functions of this one come anew with every task.
    """
    keeper = sys.modules.setdefault("retailcast_worker_encoders", ModuleType("retailcast_worker_encoders"))
    kept = vars(keeper).setdefault("kept", {})
    if definition not in kept:
        kept.clear()  # one tokenizer at a time
        kept[definition] = WordEncoder(definition)
    return kept[definition]


def steps_of(definition: dict) -> list:
    """The steps of a tokenizer's definition that decide whether it can be applied word by word."""
    steps = []
    for part in ("normalizer", "pre_tokenizer"):
        whole = definition.get(part) or {}
        steps.append([(s["type"], (s.get("pattern") or {}).get("Regex")) for s in whole.get("normalizers", whole.get("pretokenizers", []))])
    model = definition["model"]
    return [*steps, model["type"], model.get("continuing_subword_prefix"), model.get("end_of_word_suffix"), model.get("unk_token")]


def ids_of(text: Column, definition: str, end_id: int = 1) -> Column:
    """Ids of each whole text with the end id; ``definition`` is the tokenizer's JSON text."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, end = worker_encoder(definition), array("i", [end_id]).tobytes()
        for texts in batches:
            yield encoder.lists(texts, end)

    return run(text)


def write_tokens(
    docs: DataFrame, path: str, definition: str, end_id: int = 1, row_group: int = ROW_GROUP, page: int = PAGE
) -> None:
    """Write doc_id, row, n_tokens and ids to ``path`` in ascending doc_id order."""
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    ordered = docs.select("doc_id", "text", tie.alias("tie")).repartitionByRange("doc_id", "tie")
    ordered = ordered.sortWithinPartitions("doc_id", "tie")
    encoded = ordered.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), ids_of(F.col("text"), definition, end_id).alias("ids")
    )
    (
        encoded.select("doc_id", "row", F.size("ids").cast("long").alias("n_tokens"), "ids")
        .write.option("parquet.block.size", row_group)
        .option("parquet.page.size", page)
        .option("parquet.enable.dictionary", "false")
        .option("parquet.writer.version", "PARQUET_2_0")  # delta encoding of integers
        .option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files as written: doc_id, row, n_tokens, ids. Columns that are not selected are not read."""
    return spark.read.schema("doc_id long, row long, n_tokens long, ids array<int>").parquet(path)


def with_starts(tokens: DataFrame) -> DataFrame:
    """Add ``start``: the ids of all rows before. Row numbers carry the file in their upper bits, so sums
    run inside a file, and only one total per file is summed over files."""
    tokens = tokens.withColumn("file", F.shiftright("row", 33))
    totals = tokens.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = totals.select(
        "file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    )
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    summed = tokens.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return summed.join(before, "file").withColumn("start", F.col("base") + F.col("inside")).drop("file", "base", "inside")


def crc_of(ids: Column) -> Column:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("long")
    def run(lists: pa.Array) -> pa.Array:
        values, bounds = memoryview(lists.values.to_numpy().astype("<i4").tobytes()), lists.offsets.to_pylist()
        return pa.array([zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:], strict=False)], pa.int64())

    return run(ids)


def token_index(docs: DataFrame, definition: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Write the files, read them back and return doc_id, start, n_tokens, ids_crc32 of every row."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_tokens(docs, path, definition, end_id)
    light = read_tokens(spark, path).select("doc_id", "row", "n_tokens", crc_of(F.col("ids")).alias("ids_crc32"))
    return with_starts(light).select("doc_id", "start", "n_tokens", "ids_crc32")
