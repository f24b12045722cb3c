"""Token sequences of fixed capacity: first-fit decreasing with a tournament tree, in randomised groups of documents."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored

CAPACITY = 2048
END_ID = 1
#: Documents in a group on average; a group is what one task packs at a time.
GROUP_DOCUMENTS = 4000
SPECIAL = {"<|endoftext|>": 50256}
#: White space that is set apart where the pattern fails: Unicode's, a thousand characters or more.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes, with a byte-level vocabulary of ranks; the strings of special
    tokens in a text are those tokens, as the tokenizers library has it."""

    def __init__(self, ranks_path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.enc.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # the library's pattern gives up on very long white space
            return self._with_long_spaces(text)

    def _with_long_spaces(self, text: str) -> np.ndarray:
        """Long white space apart from the rest. Before another character its last character belongs to what follows, as in
        the pattern; up to there, or up to a special token or the end, it is one piece for the merges."""
        found: list[int] = []
        for part in re.split("(" + "|".join(map(re.escape, SPECIAL)) + ")", text):
            if part in SPECIAL:
                found.append(SPECIAL[part])
                continue
            at = 0
            for m in LONG_SPACE.finditer(part):
                stop = m.end() if m.end() == len(part) else m.end() - 1
                found += self.enc.encode_ordinary(part[at : m.start()])
                found += self.enc._encode_single_piece(part[m.start() : stop])
                at = stop
            found += self.enc.encode_ordinary(part[at:])
        return np.array(found, dtype=np.uint32)

    def count(self, text: str) -> int:
        return len(self.ids(text))

    def __call__(self, text: str) -> bytes:
        return self.ids(text).astype("<u4").tobytes()


def pieces(docs: DataFrame, doc_id: str, text: str, ranks_path: str, capacity: int, end_id: int) -> DataFrame:
    """Tokenised documents cut into full pieces of ``capacity`` and a remainder."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(ranks_path)
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(t or "") + end
                total = len(ids) // 4
                for s in range(0, total, capacity):
                    part = ids[4 * s : 4 * (s + capacity)]
                    rows.append((i, s, len(part) // 4, zlib.crc32(part), total))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. A tournament tree over the bins' free space finds the first bin with room: each
    inner node holds the most free space below it, so a search and an update are one walk of the tree each."""
    n = len(lengths)
    size = 1 << max(0, (n - 1).bit_length())
    free = [capacity] * (2 * size)  # bins that aren't opened yet have all their space
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < size:
            node *= 2
            if free[node] < need:
                node += 1
        bins[i], offsets[i] = node - size, capacity - free[node]
        free[node] -= need
        node //= 2
        while node:
            most = max(free[2 * node], free[2 * node + 1])
            if free[node] == most:
                break
            free[node] = most
            node //= 2
    return bins, offsets


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, group_documents: int = GROUP_DOCUMENTS, seed: int = 11) -> DataFrame:
    """Pieces of all documents with sequence_id and offset: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone. A document is cut into full pieces, each of which fills a sequence, and one
    shorter rest. Documents fall into groups by a hash that spreads repeated rows; the rests of a group are packed on their
    own, one for each document, so neither a long document nor a hot id makes a group large. The sequence id of a rest is
    its group's number times 2^32 plus the bin's, that of a full piece 2^62 plus its row number. Null ids are kept. An
    empty table gives no rows.
    """
    if ranks_path is None:
        import public_tokenizers

        ranks_path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    cut = Stored(pieces(docs, doc_id, text, ranks_path, capacity, end_id), "pieces").df
    full = cut.where(F.col("length") == capacity).withColumn("sequence_id", F.monotonically_increasing_id().bitwiseOR(F.lit(1 << 62))).withColumn("offset", F.lit(0).cast("long"))
    rests = cut.where(F.col("length") < capacity)
    groups = max(1, -(-rests.count() // group_documents))
    keyed = rests.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=(pdf["group"].to_numpy() << 32) | bins, offset=offsets).drop(columns="group")

    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return keyed.groupBy("group").applyInPandas(one, out).unionByName(full)
