"""Problem 6: filling fixed-capacity containers with whole documents.

Texts are sized by a public tokenizer in Arrow batches, once. Pieces (a text longer than a container gives full ones and
a remainder) are spread by hash over blocks of about ``BLOCK`` pieces; each block is packed by sum of squares: a piece
goes where the squared counts of open containers per residual gap become smallest. Only sizes and ids are shuffled, and
a block is bounded whatever the number of documents.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import apply_groups, map_arrow, written

CAPACITY = 2048
BLOCK = 40_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the tokenizer's vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(data: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("from_file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and n_tokens of each text; null and empty texts have none."""
    spark = documents.sparkSession
    with open(tokenizer, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())  # a vocabulary file: fixed size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(data.value).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return map_arrow(documents.select("doc_id", "text"), count, "doc_id bigint, n_tokens bigint")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each size (0 < size <= capacity), placed in the order given.

    ``open_[g]`` counts the open containers with g tokens free. Moving one from gap g to g - s changes the sum of squares
    by 1 - 2 open[g] plus, unless it is then full, 1 + 2 open[g - s]; the container with the least change takes the piece
    (of equal changes the one that leaves the smallest gap). A new one is opened only where no open one has room: with
    large pieces first, opening for the sake of the sum leaves gaps that no small pieces are left for.
    """
    open_ = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), np.int64)
    used = 0
    for i, s in enumerate(sizes.tolist()):
        gaps = np.flatnonzero(open_[s:capacity]) + s
        if len(gaps):
            after = 2 * open_[gaps - s] + 1
            after[gaps == s] = 0
            gap = int(gaps[(after - 2 * open_[gaps]).argmin()])
            bin_ = stacks[gap].pop()
            open_[gap] -= 1
            left = gap - s
        else:
            bin_, left = used, capacity - s
            used += 1
        if left:
            open_[left] += 1
            stacks[left].append(bin_)
        out[i] = bin_
    return out


def pack(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, block: int = BLOCK) -> DataFrame:
    """doc_id, piece, start_token, n_tokens, container_id: every text in one container, unless it exceeds one.

    A text of more than ``capacity`` tokens gives full containers in order and its remainder as a piece like any other.
    Null and empty texts are pieces of no tokens and go to their block's first container. Repeated texts are packed each
    for itself. Within a block larger pieces are placed first (ties by doc_id and piece), so the result doesn't depend on
    how the input is partitioned.
    """
    counts = written(token_counts(documents, tokenizer), "tokens")
    full = F.expr(f"n_tokens div {capacity}L")
    pieces = counts.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(F.col("n_tokens") / capacity) - 1))).alias("piece"))
    pieces = pieces.select(
        "doc_id",
        "piece",
        (F.col("piece") * capacity).alias("start_token"),
        F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("piece") * capacity).alias("size"),
        (F.col("piece") < full).alias("is_full"),
    )
    open_pieces = pieces.where(~F.col("is_full")).count()
    blocks = max(1, -(-open_pieces // block))
    # A full piece is a container of its own: it is numbered by hash beside the packed ones and never enters a block.
    whole = pieces.where("is_full").select("doc_id", "piece", "start_token", F.col("size").alias("n_tokens"), F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("container_id"))
    blocked = pieces.where(~F.col("is_full")).select("doc_id", "piece", "start_token", "size", F.pmod(F.xxhash64("doc_id", "piece", "size"), F.lit(blocks)).alias("block"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        sizes = pdf["size"].to_numpy()
        n = int((sizes > 0).sum())
        bins = np.zeros(len(pdf), np.int64)
        bins[:n] = sum_of_squares(sizes[:n], capacity)
        pdf["container_id"] = "b" + pdf["block"].astype(str) + "-" + pd.Series(bins, index=pdf.index).astype(str)
        return pdf.rename(columns={"size": "n_tokens"})[["doc_id", "piece", "start_token", "n_tokens", "container_id"]]

    packed = apply_groups(blocked, ["block"], fill, "doc_id bigint, piece bigint, start_token bigint, n_tokens bigint, container_id string")
    return packed.unionByName(whole)


def pack_quality(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """containers, tokens, the fewest containers that any packing needs at least, and the share of space left unused."""
    t = packed.agg(F.count_distinct("container_id").alias("containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"))
    return t.select("containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least"), (1 - F.try_divide(F.col("tokens"), F.col("containers") * capacity)).alias("unused"))
