"""Concatenate and cut: token sequences of a fixed length from whole documents, in two passes.

Pass one reads each stretch of input (a file's block) once, in order, writes every document's ids and the
tokens before it in its stretch. Prefix sums over the stretches' totals then give each document its global
offset, and pass two cuts every document at the windows' edges on its own. No row is shuffled: only one
total a stretch is gathered.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stored, tidied, utf8

WINDOW = 4096
END_ID = 2
#: Words a worker keeps the ids of, twice over: when so many are held, those not met since the last turn go.
#: It bounds memory and changes no result.
CACHED_WORDS = 200_000
#: With so many stretches or fewer (some 200 bytes each) their offsets are broadcast; beyond it they are joined by shuffle.
BROADCAST_STRETCHES = 200_000

#: Control characters that Python's split() takes as white space and the tokenizer does not; openings of special tokens.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: Latin letters whose lower case and canonical form are one letter each.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: ASCII punctuation between a letter and white space, a token or tokens of its own.
_ENDING = re.compile(r"[!-/:-@\[-`{-~](?<=[A-Za-zÀ-ÖØ-öø-ÿ].)[!-/:-@\[-`{-~]*(?!\S)")
#: The tokenizers that take words apart alike: lower case, no token over white space, letters and punctuation apart.
_WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None,
    "padding": None,
    "post_processor": None,
}


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others as letters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Kept(dict):
    """A cache of two generations: what was met in neither of them is made anew."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def turn(self) -> None:
        if len(self) >= CACHED_WORDS:
            self.older = dict(self)
            self.clear()


@functools.cache
def word_tokenizer(path: str) -> Callable[[str], bytes]:
    """A function from a text to its ids (little-endian 32 bits), equal to the tokenizer's on the whole text.

    For tokenizers that take words apart as ``_WORDWISE`` says each distinct word is encoded once and kept, in
    a worker's later tasks too; punctuation that ends a word is kept apart. Any other tokenizer encodes each
    text as a whole.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def encode(text: str) -> bytes:
        return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    if not _is_wordwise(path):
        encode.rest = lambda: None
        return encode
    merge, letters = tokenizer.model.tokenize, _byte_letters()

    def encode_word(word: str) -> bytes:
        if word.isascii():
            if not word.isalpha():
                return encode(word)
            word = word.lower()
        elif _LETTERS.fullmatch(word):
            word = word.lower().encode().decode("latin-1").translate(letters)
        else:
            return encode(word)
        return array("I", [t.id for t in merge(word)]).tobytes()

    words = _Kept(encode_word)

    def ids_of(text: str) -> bytes:
        for odd in _ODD:
            if odd in text:
                return encode(text)
        words.turn()
        try:
            # Case matters nowhere in Latin-1, whose lower case is letter by letter.
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
        return b"".join(map(words.__getitem__, _ENDING.sub(r" \g<0>", text).split()))

    def rest() -> None:
        """Between tasks a worker holds one generation only."""
        words.older = {}

    ids_of.rest = rest
    return ids_of


def _is_wordwise(path: str) -> bool:
    with open(path, encoding="utf-8") as file:
        tokenizer = json.load(file)
    model = tokenizer["model"]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    special = all(any(odd in t["content"] for odd in _ODD) for t in tokenizer["added_tokens"])
    return plain and special and all(tokenizer.get(k) == v for k, v in _WORDWISE.items())


def tokenized(documents: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = END_ID) -> DataFrame:
    """(doc_id, stretch, before, n_tokens, ids): each document's ids with the end id, and the tokens before it in its stretch."""
    bounded_batches(documents.sparkSession)
    rows = documents.select(
        F.col(id_column).alias("doc_id"),
        utf8(text_column).alias("text"),
        F.input_file_name().alias("file"),
        F.input_file_block_start().alias("block"),
    )
    schema = "doc_id " + rows.schema["doc_id"].dataType.simpleString() + ", stretch string, before long, n_tokens int, ids binary"
    end = np.array([end_id], dtype="<u4").tobytes()

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part = word_tokenizer(tokenizer_path), TaskContext.get().partitionId()
        stretch, before = None, 0
        for batch in batches:
            stretches, befores, counts, all_ids = [], [], [], []
            for text, file, block in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                name = f"{file}:{block:020d}:{part:08d}"
                if name != stretch:
                    stretch, before = name, 0
                ids = ids_of(text.decode("utf-8", "replace")) + end
                n = len(ids) // 4
                stretches.append(name)
                befores.append(before)
                counts.append(n)
                all_ids.append(ids)
                before += n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(stretches, pa.string()), pa.array(befores, pa.int64()), pa.array(counts, pa.int32()), pa.array(all_ids, pa.binary())],
                names=["doc_id", "stretch", "before", "n_tokens", "ids"],
            )
        ids_of.rest()

    return rows.mapInArrow(run, schema)


def pack(documents: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of sequences of at most ``window`` ids.

    Documents follow each other as their files store them. All sequences are full but for the rest of the
    last one, which is cut into sequences of powers of two, so nothing is padded. A document longer than
    the room left goes on in the next sequence: one row for each piece.

    Null texts count as empty and are one end id; repeated rows and ids are packed each; an empty table
    gives no piece. ``ids`` are little-endian 32-bit integers.
    """
    docs = stored(tokenized(documents, tokenizer_path, id_column, text_column, end_id), "tokens", "snappy")
    totals = stored(docs.groupBy("stretch").agg(F.sum("n_tokens").alias("total")), "totals")
    n_stretches, every = totals.agg(F.count(F.lit(1)), F.coalesce(F.sum("total"), F.lit(0))).first()
    # One row for each stretch: a few bytes for megabytes of input.
    upto = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("stretch", F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("base"))
    placed = docs.join(F.broadcast(bases) if n_stretches <= BROADCAST_STRETCHES else bases, "stretch")
    placed = placed.select("doc_id", (F.col("base") + F.col("before")).alias("at"), F.col("n_tokens").cast("long").alias("doc_tokens"), "ids")
    pieces = placed.select("*", F.explode(_windows(F.col("at"), F.col("at") + F.col("doc_tokens"), every, window)).alias("w"))
    begin = F.greatest("at", "w.begin")
    pieces = pieces.withColumn("start", begin - F.col("at")).withColumn("length", F.least(F.col("at") + F.col("doc_tokens"), F.col("w.end")) - begin)
    own = F.substring("ids", (4 * F.col("start") + 1).cast("int"), (4 * F.col("length")).cast("int"))
    return pieces.select("doc_id", "start", "length", own.alias("ids"), "doc_tokens", F.col("w.sequence").alias("sequence_id"), (begin - F.col("w.begin")).alias("offset"))


def _windows(at: Column, end: Column, every: int, window: int) -> Column:
    """The sequences (sequence, begin, end) that the tokens from ``at`` to before ``end`` lie in; ``every``: tokens of all documents."""
    full = every // window
    kind = "array<struct<sequence:bigint,begin:bigint,end:bigint>>"
    whole = F.transform(
        F.sequence(F.floor(at / window), F.floor((F.least(end, F.lit(full * window)) - 1) / window)),
        lambda s: F.struct(s.alias("sequence"), (s * window).alias("begin"), ((s + 1) * window).alias("end")),
    )
    rest, tail = full * window, []
    for bit in reversed(range((every - rest).bit_length())):
        if (every - rest) >> bit & 1:
            tail.append(F.struct(F.lit(full + len(tail)).cast("long").alias("sequence"), F.lit(rest).cast("long").alias("begin"), F.lit(rest + (1 << bit)).cast("long").alias("end")))
            rest += 1 << bit
    last = F.filter(F.array(*tail).cast(kind), lambda w: (w["begin"] < end) & (w["end"] > at))
    return F.concat(F.when(at < full * window, whole).otherwise(F.array().cast(kind)), last)


def with_checksums(pieces: DataFrame, keep_ids: bool = False) -> DataFrame:
    """The pieces with ``ids_crc32`` (unsigned CRC-32 of the ids' bytes), in place of the ids or beside them."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else []))


def crc32_of(ids: list[int]) -> int:
    """For tests: the checksum of a list of ids."""
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())
