"""Chunking by any tokenizer, as an Arrow table function: whole batches of documents in, their chunks out."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.functions.text import COMPAT_WORDS, SPECIAL, WHITE

#: What a task makes for itself: text to tokens, and tokens back to text.
Tokenizer = tuple[Callable[[str], list], Callable[[list], str]]
#: Characters of chunks to an output batch, about.
BATCH = 4 << 20


def compat() -> Tokenizer:
    """The compatibility tokenizer: known words have ids, others are unknown by the character and decode to nothing."""
    ids = {w: k + len(SPECIAL) for k, w in enumerate(COMPAT_WORDS)}

    def encode(text: str) -> list[int]:
        return [i for w in re.split(WHITE, text.lower()) if w for i in ([ids[w]] if w in ids else [1] * len(w))]

    return encode, lambda tokens: " ".join(COMPAT_WORDS[i - len(SPECIAL)] for i in tokens if i >= len(SPECIAL))


def byte_pairs(path: str, pattern: str = r" ?\S{1,64}|\s{1,64}") -> Callable[[], Tokenizer]:
    """A byte-pair vocabulary file, which each task reads; a chunk that ends within a character has a replacement mark there."""

    def make() -> Tokenizer:
        import tiktoken
        from tiktoken.load import load_tiktoken_bpe

        pairs = tiktoken.Encoding("pairs", pat_str=pattern, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
        return pairs.encode_ordinary, pairs.decode

    return make


def chunker(tokenizer: Callable[[], Tokenizer], size: int = 512, overlap: int = 50) -> Any:
    """A table function of a table (doc_id bigint, text): (doc_id, chunk_idx, n_tokens, chunk), pieces of `size` tokens, each
    with the last `overlap` of the one before. Rows stay in their partitions. Null and empty texts have no chunks."""
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size is needed")

    class Chunks:
        def __init__(self):
            self.encode, self.decode = tokenizer()

        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            rows, held = [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                tokens = self.encode(text) if text else []
                for k, at in enumerate(range(0, len(tokens), size - overlap)):
                    piece = tokens[at : at + size]
                    rows.append((doc, k, len(piece), self.decode(piece)))
                    held += len(rows[-1][3])
                    if held > BATCH:
                        yield pack(rows)
                        rows, held = [], 0
            yield pack(rows)

    def pack(rows: list[tuple]) -> pa.Table:
        kinds = (("doc_id", pa.int64()), ("chunk_idx", pa.int32()), ("n_tokens", pa.int32()), ("chunk", pa.string()))
        return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds)})

    return F.arrow_udtf(Chunks, returnType="doc_id bigint, chunk_idx int, n_tokens int, chunk string")


def chunk_by(docs: DataFrame, tokenizer: Callable[[], Tokenizer], size: int = 512, overlap: int = 50) -> DataFrame:
    """The chunks of docs (doc_id, text)."""
    return chunker(tokenizer, size, overlap)(docs.select("doc_id", "text").asTable())
