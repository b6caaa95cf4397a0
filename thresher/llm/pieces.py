"""SentencePiece encoding and decoding by a distinct-chunk table.

No piece of the model has a whitespace marker after another character (checked when a task
starts), so merges never cross from a word into the marker of the next.  A text is therefore a
row of marked words, each segmented on its own: the distinct marked words of a block of
documents make a table, each is segmented once, and ids are joined back by position.

The table is kept by block (all documents of a task, cleared at ``table_rows`` words) and not for
the whole corpus: the table of the corpus would have to be shuffled to every block that uses a
word, which costs more disk than the texts themselves (figures in the README).

What is defined for odd input: null text counts as empty and gives no ids and "" decoded; ids may
be null or repeat; an empty table gives an empty table; other columns pass through, and the
operator raises if one is named like a column that it adds.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, give_back, ragged, text_slices

ADDED = ("ids", "decoded")
MARK = "▁"
_CHUNK = re.compile(" *[^ ]+| +$")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkTable:
    """Distinct marked words, their ids and their decoded text."""

    def __init__(self, model: str, table_rows: int):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        for i in range(self.sp.vocab_size()):
            if MARK in self.sp.id_to_piece(i).lstrip(MARK):
                raise ValueError("a piece crosses a whitespace marker; words can't be segmented on their own")
        self.limit = table_rows
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.decoded: list[str] = []

    def add(self, words: list[str]) -> None:
        """Segment words that aren't in the table.  A word is a chunk less its first marker."""
        encoded = self.sp.encode(words, num_threads=1)
        for k, w in enumerate(words):
            if not w:  # the encoder gives nothing for "", but a chunk of one marker is that marker
                encoded[k] = [self.sp.piece_to_id(MARK)]
        length = np.fromiter(map(len, encoded), np.int64, len(encoded))
        self.code.update(zip(words, range(len(self.decoded), len(self.decoded) + len(words))))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in encoded for i in x), np.int32, int(length.sum()))])
        # decode() drops the first marker of a text; inside a text it is a space.
        self.decoded += [" " + d for d in self.sp.decode(encoded)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """All ids, the number of ids of each text, the decoded texts."""
        if len(self.code) > self.limit:
            self.clear()
        split = [chunks(t) for t in texts]
        new = set().union(*split).difference(self.code)
        if new:
            self.add(list(new))
        code = [np.fromiter(map(self.code.__getitem__, w), np.int64, len(w)) for w in split]
        flat = np.concatenate(code) if code else np.zeros(0, np.int64)
        ids = self.ids[ragged(self.start[flat], self.length[flat])]
        n = np.array([int(self.length[c].sum()) for c in code], np.int64)
        decoded = ["".join(map(self.decoded.__getitem__, c.tolist()))[1:] for c in code]
        return ids, n, decoded


def chunks(text: str) -> list[str]:
    """The marked words of a text, each without its first marker."""
    if not text:
        return []
    text = text.replace(MARK, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [c[1:] for c in _CHUNK.findall(" " + text)]


def encode_decode(docs: DataFrame, model: str | None = None, text_col: str = "text", table_rows: int = 400_000, batch_chars: int = 1_000_000) -> DataFrame:
    """``docs`` with ids (array<int>, without begin or end ids) and decoded (string)."""
    if clash := [c for c in docs.columns if c in ADDED]:
        raise ValueError(f"columns named like added ones: {clash}")
    model = model or default_model()
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])

    def run(batches):
        table = ChunkTable(model, table_rows)
        for batch in batches:
            for part, texts in text_slices(batch, text_col, batch_chars):
                ids, n, decoded = table.encode(texts)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(decoded, pa.string())], names=[*part.schema.names, *ADDED])
        del table
        give_back()

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every whole text of ``documents`` encoded and decoded."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_decode(docs)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
