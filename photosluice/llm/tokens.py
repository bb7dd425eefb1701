"""Token counts and token bags by a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def encoder(path: str):
    """Function from a text to its token ids, for a ``.tiktoken``, ``.json`` or ``.model`` file."""
    if path.endswith(".tiktoken"):
        import tiktoken

        try:
            from public_tokenizers import PATTERN
        except ImportError:
            PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda text: t.encode(text, add_special_tokens=False).ids
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).encode


def token_counts(docs: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(``doc_id``, ``tokens``): size of every whole text; null and empty texts have 0 tokens."""

    def count(batches):
        encode = encoder(tokenizer)
        for b in batches:
            sizes = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "tokens"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, f"doc_id {kind}, tokens bigint")


def token_bags(docs: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(``doc_id``, ``tokens``, ``terms``, ``tf``): size, distinct token ids and their counts of every whole text."""

    def bag(batches):
        encode = encoder(tokenizer)
        for b in batches:
            sizes, terms, tfs = [], [], []
            for t in b.column(1).to_pylist():
                ids, n = np.unique(np.asarray(encode(t) if t else [], np.int32), return_counts=True)
                sizes.append(int(n.sum())), terms.append(ids), tfs.append(n.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))],
                names=["doc_id", "tokens", "terms", "tf"],
            )

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(bag, f"doc_id {kind}, tokens bigint, terms array<int>, tf array<int>")
