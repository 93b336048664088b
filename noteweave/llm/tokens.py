"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
_loaded: dict[str, object] = {}


def _tokenizer(path: str):  # noqa: ANN202
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _loaded[path] = t
    return _loaded[path]


def _counts(path: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from noteweave.llm.neardup import chunks

        t = _tokenizer(path)
        for b in batches:
            n: list[int] = []
            for _, texts in chunks(b.column("__text")):
                n += [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "__text"), pa.array(n, pa.int64())], names=[*(c for c in b.schema.names if c != "__text"), "n_tokens"])

    return run


def count_tokens(df: DataFrame, text: str, keep: list[str], path: str = TOKENIZER) -> DataFrame:
    """Columns ``keep`` and ``n_tokens``; 0 for a null or empty text. Whole texts, one pass, no shuffle."""
    chosen = df.select(*keep, F.col(f"`{text}`").alias("__text"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields if f.name != "__text")
    return chosen.mapInArrow(_counts(path), f"{shape}, n_tokens long")
