"""Filling fixed-capacity containers with texts (problem 8): variable-capacity best-fit over token counts.

Texts are counted by a public byte-level BPE tokenizer, one Arrow batch at a time, and dealt into blocks by the hash of
their id; each block is packed on its own, so packing needs one shuffle of (id, tokens) and its waste is at most a few
part-filled containers a block. The block's items are sorted by size, largest first. An item goes into the open container
with the least space that still holds it; if there is none, a container of the size with the least expected cost opens.
At the end every container shrinks to the smallest permitted size that holds its contents. The block is packed under
several opening policies, and the one with the least total capacity stays.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.common import durable, per_worker

CAPACITIES = (512, 1024, 2048)
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern by which byte-level BPE vocabularies of this family split text.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PACK = "doc_id long, piece_no int, tokens int, container_id string, capacity int, position int"


def load_tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens): a null or empty text has 0 tokens. Whole texts are encoded. The vocabulary is read by each Python
    worker from ``tokenizer``, a path that every executor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = per_worker(("tokenizer", tokenizer), lambda: load_tokenizer(tokenizer))

        def count(text: str | None) -> int:
            try:
                return len(enc.encode_ordinary(text)) if text else 0
            except BaseException as e:  # its pattern engine panics on millions of blanks in a row, which is no Exception
                if type(e).__name__ != "PanicException":
                    raise
                import regex

                return sum(len(enc._core_bpe.encode_single_piece(m[0].encode())) for m in regex.finditer(PATTERN, text))

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(count, b.column(1).to_pylist()), pa.int32())], names=["doc_id", "tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, tokens int")


def _fill(sizes: np.ndarray, capacities: tuple[int, ...], opens: int | None) -> tuple[np.ndarray, list[int]]:
    """Container number of each item (sizes descending) and the contents of each container. Open containers are kept by
    free space: a bit set says which spaces occur, so best fit is one shift and one lowest bit."""
    largest = capacities[-1]
    free: list[list[int]] = [[] for _ in range(largest + 1)]
    spaces, used, put = 0, [], np.empty(len(sizes), np.int64)
    tail = np.cumsum(sizes[::-1])[::-1] if len(sizes) else sizes
    for i, size in enumerate(sizes.tolist()):
        above = spaces >> size
        if above:
            space = size + (above & -above).bit_length() - 1
            c = free[space].pop()
            if not free[space]:
                spaces &= ~(1 << space)
        else:
            fits = [x for x in capacities if x >= size]
            if opens is not None:
                space = max(fits[0], opens)
            else:  # least cost: the share of the container that what is left can't fill
                left, small = int(tail[i]), int(sizes[-1])
                cost = lambda cap: (cap - min(left, size + (cap - size if cap - size >= small else 0))) / cap
                space = min(fits, key=lambda cap: (cost(cap), -cap))
            c = len(used)
            used.append(0)
        put[i] = c
        used[c] += size
        space -= size
        free[space].append(c)
        spaces |= 1 << space
    return put, used


def pack_block(sizes: np.ndarray, capacities: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Container of each item and capacity of each container, for sizes in descending order, none above the largest."""
    best = None
    for opens in (*capacities, None):
        put, used = _fill(sizes, capacities, opens)
        caps = np.asarray(capacities)[np.searchsorted(capacities, np.asarray(used, np.int64))]
        if best is None or caps.sum() < best[1].sum():
            best = put, caps
    return best


def pack(counts: DataFrame, capacities: tuple[int, ...] = CAPACITIES, block_rows: int = 200_000) -> DataFrame:
    """(doc_id, piece_no, tokens, container_id, capacity, position) from counts(doc_id, tokens).

    A text above the largest capacity becomes full pieces of that size and a rest; no other text is split. A text
    without tokens has one piece in no container (container_id null, capacity 0). ``position`` is the piece's offset in
    its container. Blocks hold ``block_rows`` texts on average whatever the distribution of sizes."""
    capacities = tuple(sorted(capacities))
    largest = capacities[-1]
    blocks = max(1, -(-counts.count() // block_rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        docs = pd.concat(parts, ignore_index=True).sort_values("doc_id", kind="stable")
        n = docs["tokens"].to_numpy(np.int64)
        pieces = np.maximum(1, -(-n // largest))
        at = np.repeat(np.arange(len(n)), pieces)
        no = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(largest, n[at] - no * largest)
        order = np.argsort(-size, kind="stable")
        order = order[size[order] > 0]
        put, caps = pack_block(size[order], capacities)
        where, cap, position = np.full(len(at), -1), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        where[order], cap[order] = put, caps[put] if len(put) else 0
        used = np.zeros(len(caps), np.int64)
        for i, c in zip(order.tolist(), put.tolist()):
            position[i] = used[c]
            used[c] += size[i]
        names = [f"{part}-{c}" if c >= 0 else None for c in where.tolist()]
        out = pd.DataFrame({"doc_id": docs["doc_id"].to_numpy()[at], "piece_no": no, "tokens": size, "container_id": names, "capacity": cap, "position": position})
        for a in range(0, len(out), 20_000):
            yield out.iloc[a : a + 20_000]

    return counts.repartition(blocks, F.xxhash64("doc_id")).mapInPandas(run, PACK)


def pack_documents(documents: DataFrame, capacities: tuple[int, ...] = CAPACITIES, tokenizer: str = TOKENIZER) -> DataFrame:
    return pack(durable(token_counts(documents, tokenizer)), capacities)


def fill_rate(packed: DataFrame) -> DataFrame:
    """(capacity, containers, tokens, fill): how full the containers of each size are."""
    boxes = packed.filter("container_id IS NOT NULL").groupBy("container_id", "capacity").agg(F.sum("tokens").alias("tokens"))
    return boxes.groupBy("capacity").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / F.sum("capacity")).alias("fill"))
