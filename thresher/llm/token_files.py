"""Token ids in binary files of directly addressable codes.

An id is cut into 8-bit chunks, lowest first.  Level 0 holds the first chunk of every id, level 1
the second chunk of those that go on, and so on; each level has a bitmap of which of its entries go
on, and a directory of the bitmap's ranks every 512 bits.  Token i is read with one look at each of
its levels: entry i of level 0, then entry rank(i) of level 1.  No block is decoded for it.

A file (:func:`write`) is a row of segments, each a container of about ``segment_tokens`` ids of
whole documents with the documents' ids and ends; files are in ascending order of the document
id, and a small manifest has the number of tokens in each, from which a reader knows how many
come before.  Files go through Spark's own writer and reader, so they can lie in any store.

What is defined for odd input: null text counts as empty and has the end id only; rows with a null
id come first; rows of one id are ordered by their text's hash, and each is a document; an empty
table gives no document; columns other than id and text aren't written.
"""

from __future__ import annotations

import re
import struct
import uuid
from functools import lru_cache
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, long_id, ragged, row_key, shared_dir, text_of, text_slices

MAGIC = b"DAC1"
RANK_BYTES = 64
_SPECIAL = "<|endoftext|>"
_LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha() and c not in "ªµº")
_OTHER_SPACE = re.compile("[\t\n\x0b\x0c\r]")
_BITS = np.array([bin(b).count("1") for b in range(256)], np.uint8)

SEGMENTS = "part int, segment long, first_token long, n_tokens long, doc_ids array<long>, ends array<long>, payload binary"


def dac_encode(ids: np.ndarray) -> bytes:
    """Ids below 2**32 -> a container."""
    rest, levels = ids.astype(np.uint64), []
    while len(rest) or not levels:
        low, rest = (rest & 255).astype(np.uint8), rest >> np.uint64(8)
        more = rest > 0
        bitmap = np.packbits(more, bitorder="little")
        ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(_BITS[bitmap], np.arange(0, len(bitmap), RANK_BYTES), dtype=np.int64))]) if len(bitmap) else np.zeros(1)
        levels.append(struct.pack("<Q", len(low)) + low.tobytes() + bitmap.tobytes() + ranks.astype("<u4").tobytes())
        rest = rest[more]
    return MAGIC + struct.pack("<B", len(levels)) + b"".join(levels)


class Dac:
    """Reads a container: any token, or any run of tokens, without the ones before it."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a container of directly addressable codes")
        self.levels, at = [], 5
        for _ in range(data[4]):
            (n,) = struct.unpack_from("<Q", data, at)
            bits = -(-n // 8)
            ranks = -(-bits // RANK_BYTES) + 1
            low = np.frombuffer(data, np.uint8, n, at + 8)
            bitmap = np.frombuffer(data, np.uint8, bits, at + 8 + n)
            self.levels.append((low, bitmap, np.frombuffer(data, "<u4", ranks, at + 8 + n + bits)))
            at += 8 + n + bits + 4 * ranks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(bitmap: np.ndarray, ranks: np.ndarray, i: int) -> int:
        block, byte = i // (8 * RANK_BYTES), i // 8
        n = int(ranks[block]) + int(_BITS[bitmap[block * RANK_BYTES : byte]].sum())
        return n + (int(_BITS[bitmap[byte] & ((1 << (i % 8)) - 1)]) if i % 8 else 0)

    def __getitem__(self, i: int) -> int:
        value, shift = 0, 0
        for low, bitmap, ranks in self.levels:
            value |= int(low[i]) << shift
            if not bitmap[i // 8] >> (i % 8) & 1:
                break
            i, shift = self._rank(bitmap, ranks, i), shift + 8
        return value

    def run(self, a: int, b: int) -> np.ndarray:
        """Tokens a to b-1 as unsigned 32-bit integers."""
        out, at = np.zeros(b - a, np.uint32), np.arange(b - a)
        for level, (low, bitmap, ranks) in enumerate(self.levels):
            if a >= b:
                break
            out[at] |= low[a:b].astype(np.uint32) << np.uint32(8 * level)
            more = np.unpackbits(bitmap[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            at, a = at[more], self._rank(bitmap, ranks, a)
            b = a + len(at)
        return out


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _spaced(text: str) -> str:
    """The text with spaces for other white space; in lower case if its letters are Latin-1, as the tokenizer has no other use for their case."""
    text = text.replace("\n", " ")
    if any(c in text for c in "\t\r\x0b\x0c"):
        text = _OTHER_SPACE.sub(" ", text)
    try:
        text.isascii() or text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text if "<|" in text else text.lower()


class Runs:
    """Runs of ids, one behind the other."""

    def __init__(self):
        self.ids, self.start, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def append(self, ids: np.ndarray, length: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these runs, and how many each has."""
        length = self.length[which]
        return self.ids[ragged(self.start[which], length)], length


def _codes(known: pa.Array, more: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different strings of two arrays, those of the first in front, and the places of the second's among them."""
    last = pa.chunked_array([known, more]).dictionary_encode().combine_chunks()
    return last.dictionary, last.indices.to_numpy()[len(known) :]


class WordTable:
    """Distinct words between white space and their ids.

    The tokenizer drops white space and never joins what stands on its two sides, so a text's ids
    are those of its words.  A word of Latin letters, in lower case and without the ASCII
    punctuation behind it, is a *core*: the tokenizer's own merges alone make its ids, so cores skip
    its normaliser and its pattern, and are encoded by thousands.  The last id of each is one that
    ends a word, which tells them apart.  Punctuation behind a core is a word of its own to the
    tokenizer's pattern.  Other words go through the whole tokenizer.

    Words stay in Arrow arrays: a call's words are looked up by one hash over them and the table's.
    A full table keeps the words that came again in a later call, if they are less than half of it.
    """

    def __init__(self, path: str, table_rows: int):
        import os

        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tok, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.special = self.tok.token_to_id(_SPECIAL)
        vocabulary = self.tok.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from U+0100 on.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: chr(b if b in shown else 256 + hidden.index(b)) for b in range(256)}
        self.limit = table_rows
        self.words, self.runs = pa.array([], pa.large_string()), Runs()
        self.again = np.zeros(0, bool)  # of a word: whether it came in a later call as well

    def _cores(self, cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
        shown = [c if c.isascii() else c.encode().decode("latin-1").translate(self.alphabet) for c in cores]
        batch = self.bare.encode_batch_fast([" ".join(shown[k : k + 1000]) for k in range(0, len(shown), 1000)], add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in batch)])
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(cores):
            raise RuntimeError("the tokenizer ends words otherwise than expected")
        return ids, np.diff(ends, prepend=0)

    def _others(self, others: list[str]) -> tuple[np.ndarray, np.ndarray]:
        marked = [w for w in others if "<|" in w]
        alone = dict(zip(marked, self.tok.encode_batch_fast(marked, add_special_tokens=False)))
        rest = [w for w in others if w not in alone]
        batch = self.tok.encode_batch_fast([_SPECIAL.join(rest[k : k + 1000]) + _SPECIAL for k in range(0, len(rest), 1000)], add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in batch)])
        ends = np.flatnonzero(ids == self.special)  # the special token stands behind each word
        runs = iter(np.split(ids, ends + 1)[:-1])
        out = [np.array(alone[w].ids, np.uint32) if w in alone else next(runs)[:-1] for w in others]
        return np.concatenate([np.zeros(0, np.uint32), *out]), np.array([len(x) for x in out], np.int64)

    def _add(self, words: pa.Array) -> None:
        """Ids of new words, in the order in which they stand in the table."""
        heads = pc.ascii_rtrim(words, characters=punctuation)
        plain = pc.match_substring_regex(heads, f"^[{_LETTERS}]+$")
        tails = pc.if_else(plain, pc.utf8_ltrim(words, characters=_LETTERS), "")
        heads, head = _codes(words[:0], pc.if_else(plain, pc.utf8_lower(heads), words))
        parts, tail = _codes(heads, tails)
        core = np.zeros(len(parts), bool)
        core[head] = plain.to_numpy(zero_copy_only=False)
        text, place, runs = parts.to_numpy(zero_copy_only=False), np.argsort(np.argsort(~core, kind="stable")), Runs()
        runs.append(*self._cores(text[core].tolist()))
        runs.append(*self._others(text[~core].tolist()))
        ids, length = runs.take(place[np.column_stack([head, tail]).ravel()])
        self.runs.append(ids, length.reshape(-1, 2).sum(axis=1))
        self.again = np.concatenate([self.again, np.zeros(len(words), bool)])

    def _shed(self) -> None:
        kept = np.flatnonzero(self.again) if 2 * self.again.sum() < self.limit else np.zeros(0, np.int64)
        runs, self.runs = self.runs, Runs()
        self.runs.append(*runs.take(kept))
        self.words, self.again = self.words.take(pa.array(kept)), np.zeros(len(kept), bool)

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, end ids included, and the number of ids of each text."""
        if len(self.words) > self.limit or self.words.nbytes > 64 * self.limit:  # words may be long
            self._shed()
        split = pc.split_pattern(pa.array(map(_spaced, texts), pa.large_string()), " ")
        known, count = len(self.words), split.value_lengths().to_numpy().astype(np.int64)
        self.words, code = _codes(self.words, split.flatten())
        self.again[code[code < known]] = True
        if len(self.words) > known:
            self._add(self.words[known:])
        flat, length = self.runs.take(code)
        n = np.add.reduceat(length, np.cumsum(count) - count)
        ends = np.cumsum(n + 1)
        ids = np.empty(int(ends[-1]), np.uint32)
        keep = np.ones(len(ids), bool)
        keep[ends - 1] = False
        ids[keep] = flat
        ids[ends - 1] = end_id
        return ids, n + 1


@lru_cache(maxsize=1)
def word_table(path: str, table_rows: int, job: str) -> WordTable:
    """The Python worker's table: a worker that runs one task after another of a job goes on with it."""
    return WordTable(path, table_rows)


def _gathered(batches, batch_chars: int):
    """Ids and texts of about so many characters: each call of the table hashes all its words, so short texts of several Arrow batches go into one."""
    doc_ids, texts, chars = [], [], 0
    for batch in batches:
        for piece, more in text_slices(batch, "text", batch_chars):
            doc_ids.extend(piece.column(0).to_pylist())
            texts.extend(more)
            chars += sum(map(len, more)) + 16 * len(more)  # a row takes memory also if it is empty
            if chars >= batch_chars:
                yield doc_ids, texts
                doc_ids, texts, chars = [], [], 0
    if texts:
        yield doc_ids, texts


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = 1_000_000, table_rows: int = 800_000, batch_chars: int = 4_000_000) -> None:
    """Tokenise ``docs`` and write files under ``path``: ``segments`` and ``manifest``.

    Texts are range-partitioned by id before they are tokenised, so the exchange carries them
    once and ids go straight from the tokenizer to the files.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    tokenizer = tokenizer or default_tokenizer()
    rows = docs.select(long_id(docs, id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), text_of(text_col).alias("text"))
    n, job = int(spark.conf.get("spark.sql.shuffle.partitions")), uuid.uuid4().hex
    ordered = rows.repartitionByRange(n, "doc_id", "key").sortWithinPartitions("doc_id", "key")

    def run(batches):
        table, part = word_table(tokenizer, table_rows, job), TaskContext.get().partitionId()
        held: list = []  # (doc_ids, ids, n) not yet in a segment
        segment, first, tokens = 0, 0, 0

        def close():
            doc_ids, ids, count = [i for h in held for i in h[0]], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            lists = [pa.array([x], t) for x, t in ((doc_ids, pa.list_(pa.int64())), (np.cumsum(count).tolist(), pa.list_(pa.int64())))]
            heads = [pa.array([x], t) for x, t in ((part, pa.int32()), (segment, pa.int64()), (first, pa.int64()), (len(ids), pa.int64()))]
            return pa.RecordBatch.from_arrays([*heads, *lists, pa.array([dac_encode(ids)], pa.binary())], names=[c.split()[0] for c in SEGMENTS.split(", ")])

        for doc_ids, texts in _gathered(batches, batch_chars):
            ids, count = table.encode(texts, end_id)
            held.append((doc_ids, ids, count))
            tokens += len(ids)
            if tokens >= segment_tokens:
                yield close()
                segment, first, tokens, held = segment + 1, first + tokens, 0, []
        if held:
            yield close()

    ordered.mapInArrow(run, SEGMENTS).write.option("compression", "none").parquet(f"{path}/segments")
    totals = spark.read.schema(SEGMENTS).parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    totals.coalesce(1).write.parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files: doc_id, start (tokens of all documents before it), ids (array<long>)."""
    return _read(spark, path, "doc_id long, start long, ids array<long>", lambda x: x.astype(np.int64))


def _read(spark: SparkSession, path: str, schema: str, value) -> DataFrame:
    # One number for each file of the writer: as many as it had partitions.
    totals = dict(spark.read.schema("part int, n_tokens long").parquet(f"{path}/manifest").collect())
    bases, base = {}, 0
    for part in sorted(totals):
        bases[part], base = base, base + totals[part]
    kinds = {"ids": pa.list_(pa.int64()), "ids_crc32": pa.int64(), "n_tokens": pa.int64()}
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                codes, ends = Dac(row["payload"]), np.array(row["ends"], np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                ids = codes.run(0, len(codes))  # all its documents are wanted
                values = [value(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                columns = {"doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(starts + row["first_token"] + bases[row["part"]]), "n_tokens": pa.array(ends - starts)}
                columns[names[-1]] = pa.array(values, kinds[names[-1]])
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    bound_batches(spark)
    return spark.read.schema(SEGMENTS).parquet(f"{path}/segments").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: all ``documents`` written to files and read back from them."""
    import zlib

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(docs, path)
    return _read(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda x: zlib.crc32(x.astype("<u4", copy=False)))
