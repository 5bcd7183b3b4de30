"""Packing of tokenized documents into sequences: first-fit decreasing in randomised groups of documents."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.shipping import ships

from .bpe import PRE_TOKEN, byte_letters, vocabulary
from .common import map_text

#: Production parameters: tokens of a sequence; documents that a group holds on average; seed of the groups.
SEQUENCE_TOKENS = 1024
GROUP_DOCUMENTS = 8192
SEED = 20


@lru_cache(maxsize=2)
def encoder(content: bytes):
    """A function from texts to ids (little-endian unsigned 32-bit), by the tiktoken library with the vocabulary of a file of the tokenizers library.

    In such a file ids are ranks: bytes first, then the result of each merge in turn, else it raises. Where tiktoken's
    regular expressions give up (runs of about a million white-space characters), the tokenizers library encodes the text.
    """
    import tiktoken
    from tokenizers import Tokenizer

    spec, letters = json.loads(content), byte_letters()
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    parts = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    if [ranks[bytes(letters[c] for c in a + b)] for a, b in parts] != list(range(256, 256 + len(parts))):
        raise ValueError("the ids of this vocabulary aren't the ranks of its merges")
    made = tiktoken.Encoding("file", pat_str=PRE_TOKEN.replace(r"^\p{White_Space}", r"^\s").replace(r"\P{White_Space}", r"\S").replace(r"\p{White_Space}", r"\s"), mergeable_ranks=ranks, special_tokens=special)
    library = Tokenizer.from_buffer(content)
    library.no_truncation()
    library.no_padding()

    def encode(text: str) -> bytes:
        try:
            return made.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
        except ValueError:
            return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    return encode


class CapacityTree:
    """Tournament tree over the free tokens of n bins: each node has the greater value of its two, so that the leftmost bin with enough room is found in log2(n) steps."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.best = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Puts size tokens into the first bin with room for them; the bin, and its free tokens before."""
        best, node = self.best, 1
        while node < self.leaves:
            node += node
            if best[node] < size:
                node += 1
        free = best[node]
        best[node] = free - size
        bin_ = node - self.leaves
        while node > 1:
            node >>= 1
            best[node] = max(best[2 * node], best[2 * node + 1])
        return bin_, free


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The bin and the offset in it of each size, in the order given; equal sizes are placed in that order too."""
    tree = CapacityTree(len(sizes), capacity)
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bins[i], free = tree.place(sizes[i])
        offsets[i] = capacity - free
    return bins, offsets


def tokenize_pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE_TOKENS, end_id: int = 0) -> DataFrame:
    """Each whole text as ids and end_id, cut into pieces of capacity ids (the last one may be shorter).

    Returns id_col, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens. A null or empty text is
    end_id alone. Rows with the same id are documents of their own; other columns of df are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(path))
    end, step = end_id.to_bytes(4, "little"), 4 * capacity

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(shared.value)
        rows, start, ids, total = [], [], [], []
        for row, text in enumerate(batch[text_col].to_pylist()):
            whole = (encode(text) if text else b"") + end
            for at in range(0, len(whole), step):
                rows.append(row)
                start.append(at // 4)
                ids.append(whole[at : at + step])
                total.append(len(whole) // 4)
        return pa.RecordBatch.from_arrays(
            [batch[id_col].take(pa.array(rows, pa.int64())), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())],
            names=[id_col, "start", "length", "ids", "doc_tokens"],
        )

    return map_text(df, [id_col], text_col, f, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long")


@ships
def pack(pieces: DataFrame, documents: int, id_col: str = "doc_id", capacity: int = SEQUENCE_TOKENS, group_documents: int = GROUP_DOCUMENTS, seed: int = SEED) -> DataFrame:
    """Gives each piece (id_col, start, length, more) its sequence_id and its offset there, gapless from 0.

    documents: how many there are, for the number of groups. A piece belongs to the group that a seeded hash of its whole
    row names, so that neither null or repeated ids nor one very long document fill a group, and each group is packed for
    itself; a group holds the pieces of group_documents documents on average, whatever the size of the corpus. Pieces are
    placed by length descending, then by their other columns, so that a rerun gives the same sequences; rows that agree in
    all of it may swap places. sequence_id is the group's number times 2^32 plus the bin's number. Columns of those names,
    or named _group, are replaced. An empty table gives an empty one. The pieces must not be longer than capacity.
    """
    groups = max(1, -(-documents // group_documents))
    pieces = pieces.drop("sequence_id", "offset", "_group")
    names = pieces.columns

    def f(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", *[c for c in names if c != "length"]], ascending=[False] + [True] * (len(names) - 1), kind="stable", ignore_index=True)
        if len(group) and group["length"].iloc[0] > capacity:
            raise ValueError("a piece is longer than a sequence")
        bins, offsets = first_fit_decreasing(group["length"].tolist(), capacity)
        group["sequence_id"] = [(int(group["_group"].iloc[0]) << 32) + b for b in bins]
        group["offset"] = offsets
        return group.drop(columns="_group")

    grouped = pieces.withColumn("_group", F.pmod(F.xxhash64(*names, F.lit(seed)), F.lit(groups)))
    return grouped.groupBy("_group").applyInPandas(f, ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in pieces.schema) + ", sequence_id long, offset long")
