"""Operator 4: BPE encoding and decoding of whole texts."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import once, per_batch, pick, table
from .word_bpe import load


def encode(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded): ids of each whole text and their decoding.

    A null text counts as empty and gives no ids and an empty decoding; null ids and
    repeated rows stay as they are; other columns are left out.
    """

    def make():
        bpe = load(tokenizer)

        def run(batch):
            ids, bounds = bpe.encode_many(batch[1])
            rows = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
            return {id_col: batch[0], "ids": rows, "decoded": [bpe.decode(i) for i in rows]}

        return run

    return per_batch(pick(docs, id_col, text_col), f"`{id_col}` long, ids array<int>, decoded string", make)


def _joined(names: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Names of each text's ids, joined by one space."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), names.take(pa.array(ids))), pa.scalar(" ", names.type))


def _sha256(texts: pa.Array) -> list[str]:
    offsets, data = np.frombuffer(texts.buffers()[1], np.int64), memoryview(texts.buffers()[2] or b"")
    return [sha256(data[a:b]).hexdigest() for a, b in zip(offsets[: len(texts)].tolist(), offsets[1 : len(texts) + 1].tolist())]


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encode()'s results.

    Ids and decodings of a few megabytes of text exist at a time; a very long text is alone.
    Nulls, repeats and an empty table as in encode().
    """

    def make():
        bpe = load(tokenizer)

        def names():
            most = max(bpe.token) + 1
            return pa.array([str(i) for i in range(most)], pa.large_string()), pa.array([bpe.token.get(i, "") for i in range(most)], pa.large_string())

        numbers, tokens = once(("word_bpe_names", tokenizer), names)

        def run(batch):
            ids, bounds = bpe.encode_many(batch[1])
            return {
                "doc_id": batch[0], "n_tokens": np.diff(bounds),
                "ids_sha256": _sha256(_joined(numbers, ids, bounds)), "decoded_sha256": _sha256(_joined(tokens, ids, bounds)),
            }

        return run

    return per_batch(pick(docs, "doc_id", "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def op4_bpe_codec(spark, sf_dir: str) -> DataFrame:
    """digests() of the whole table documents with the file word_bpe_49k.json."""
    return digests(table(spark, sf_dir, "documents"))
