"""Problem 8: token ids of a byte-level BPE vocabulary, merged with a segment tree."""

from __future__ import annotations

import base64
from array import array
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactry.llm.arrow import Memo, map_batches

#: The vocabulary's folder: a parameter of every function below; None asks the installed package.
VOCABULARY = "byte_bpe_50k.tiktoken"
NONE = 1 << 62


def vocabulary_path(name: str = VOCABULARY, folder: str | None = None) -> str:
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one pre-token.

    Leaf i of the tree holds the rank of the pair that starts at the live byte
    position i, with i in the low bits, so the root is the leftmost pair of the
    least rank. A merge removes one position and updates the leaves of the
    merged part and of its left neighbour: O(log n) each.
    """
    n = len(piece)
    if n == 1:
        return (ranks[piece],)
    size = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * size)
    rank = ranks.get
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << 32 | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # live neighbours; a part is piece[i:after[i]]

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            if b < a:
                a = b
            if tree[k] == a:
                return
            tree[k] = a
            k >>= 1

    def pair(i: int) -> int:
        j = after[i]
        if j >= n:
            return NONE
        r = rank(piece[i : after[j]])
        return NONE if r is None else r << 32 | i

    while tree[1] != NONE:
        i = tree[1] & 0xFFFFFFFF
        j = after[i]
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        put(j, NONE)
        put(i, pair(i))
        if (h := before[i]) >= 0:
            put(h, pair(h))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return tuple(out)


def encoder(path: str, limit: int = 200_000):
    """text -> array of ids.

    Pre-tokens never span a blank that has a mark before it, so the text is cut at
    blanks and each distinct chunk is tokenised once per worker. Where a blank
    stands inside a longer run of white space the cut would split the run; such
    texts go through the pattern as a whole.
    """
    import public_tokenizers
    import regex

    ranks, pattern = ranks_of(path), regex.compile(public_tokenizers.PATTERN)
    run = regex.compile(r"\s \s|\s \Z")
    words = Memo(lambda piece: merge(piece.encode(), ranks), limit)
    pieces = lambda s: tuple(chain.from_iterable(map(words.__getitem__, pattern.findall(s))))
    chunks = Memo(lambda chunk: pieces(f" {chunk}"), limit)

    def encode(text: str | None) -> array:
        if not text:
            return array("i")
        if run.search(text):
            return array("i", pieces(text))
        first, *rest = text.split(" ")
        out = array("i", pieces(first)) if first else array("i")
        out.extend(chain.from_iterable(map(chunks.__getitem__, rest)))
        return out

    return encode


def token_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """(id, ids ARRAY<INT>) of every row; null and empty texts have the empty list.

    Strings that look like special tokens are ordinary text. One narrow stage, no shuffle.
    """
    kind = dict(df.dtypes)[id_col]

    def make():
        encode = encoder(vocabulary_path(name, folder))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out, ends = array("i"), [0]
            for text in batch.column(1).to_pylist():
                out.extend(encode(text))
                ends.append(len(out))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(out, np.int32) if out else np.empty(0, np.int32)))
            return pa.record_batch([batch.column(0), ids], names=["id", "ids"])

        return step

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(rows, make, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """(id, n_tokens BIGINT): lengths of :func:`token_ids` without materialising the ids; null and empty are 0."""
    kind = dict(df.dtypes)[id_col]

    def make():
        encode = encoder(vocabulary_path(name, folder))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = pa.array([len(encode(t)) for t in batch.column(1).to_pylist()], pa.int64())
            return pa.record_batch([batch.column(0), n], names=["id", "n_tokens"])

        return step

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(rows, make, f"id {kind}, n_tokens bigint").withColumnRenamed("id", id_col)
