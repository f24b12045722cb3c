"""Byte-pair encoding with a segment tree over the ranks of adjacent pairs, and decoding.

A worker splits whole texts into words with one compiled scan, and merges each word it hasn't met with a segment tree: the
root is the leftmost merge of lowest rank, a merge changes three leaves and their paths. Short words are merged many at a
time, their trees side by side in arrays; long ones one by one. Results of words are remembered up to a bound.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a worker remembers; beyond it the memory starts anew. Words over LONG_WORD characters aren't remembered.
WORDS, LONG_WORD = 400_000, 64
#: Characters of texts that are encoded together (a longer text is encoded alone).
TOGETHER = 1_000_000
#: Most symbols of a word whose tree stands beside others; tree leaves that are worked on at once.
SIDE_BY_SIDE, LEAVES = 64, 1 << 16
#: Characters of texts that take the fast scan: NFC leaves them as they are, and Python's lower() is the library's.
FAST_LETTERS = "À-ÖØ-öø-įı-ž"
NOT_FAST = re.compile(f"[^\x20-\x7E\n\t{FAST_LETTERS}]")
#: Words of such a text in lower case, as the pre-tokeniser of the expected file finds them (fixed value of that file).
FAST_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{FAST_LETTERS}]+|[0-9]|[^\x20\x09-\x0Da-z0-9{FAST_LETTERS}]+")
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NONE = 1 << 62


def merge_word(symbols: list[int], ranks: dict[tuple[int, int], int], merged: list[int]) -> list[int]:
    """Merge the leftmost pair of the lowest rank until none is left. ``ranks`` has the rank of a pair of ids, ``merged``
    the id that a rank's merge makes.

    Leaf i of the tree holds rank * leaves + i of the pair that starts at symbol i; a node holds the least of its two
    children, so the root is the next merge. A merge changes three leaves at most: logarithmic updates.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    get, size = ranks.get, 1 << (n - 2).bit_length()
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        rank = get((symbols[i], symbols[i + 1]))
        if rank is not None:
            tree[size + i] = rank * size + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    symbol, after, before = symbols[:], list(range(1, n + 1)), list(range(-1, n - 1))
    while (root := tree[1]) != _NONE:
        rank, i = divmod(root, size)
        j = after[i]
        symbol[i] = merged[rank]
        symbol[j] = -1
        k = after[i] = after[j]
        changed = [(i, _NONE)]
        if k < n:
            before[k] = i
            changed.append((j, _NONE))
            if (rank := get((symbol[i], symbol[k]))) is not None:
                changed[0] = (i, rank * size + i)
        if (h := before[i]) >= 0:
            rank = get((symbol[h], symbol[i]))
            changed.append((h, _NONE if rank is None else rank * size + h))
        for at, value in changed:
            at += size
            tree[at] = value
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                if b < a:
                    a = b
                if tree[at] == a:
                    break
                tree[at] = a
                at >>= 1
    return [x for x in symbol if x >= 0]


class PairRanks:
    """Ranks of id pairs for whole arrays of pairs: an open-addressing table; -1 where a pair has none."""

    BITS = 18

    def __init__(self, ranks: dict[tuple[int, int], int]):
        size = 1 << max(self.BITS, (2 * len(ranks)).bit_length())
        self.shift, self.mask = np.uint64(65 - size.bit_length()), size - 1
        self.keys, self.values = np.full(size, -2, np.int64), np.full(size, -1, np.int64)
        pairs = np.array(list(ranks), np.int64).reshape(-1, 2)
        keys = pairs[:, 0] << 20 | pairs[:, 1]
        for key, at, rank in zip(keys.tolist(), self._slot(keys).tolist(), ranks.values(), strict=True):
            while self.keys[at] != -2:
                at = (at + 1) & self.mask
            self.keys[at], self.values[at] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``a`` and ``b`` are ids, or -1 for no symbol, which has no pair."""
        keys = a << 20 | b
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        open_ = np.flatnonzero((found != keys) & (found != -2))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -2)]
        return out


def merge_side_by_side(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bits: int, ranks: PairRanks, merged: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """merge_word for many words at once, each with a tree of 2^bits leaves: ids of all words in turn, and their numbers.

    Word w has symbols[starts[w] : starts[w] + lengths[w]], 2 to 2^bits + 1 of them.
    """
    leaves, n = 1 << bits, len(starts)
    place = np.arange(leaves + 2)
    at = np.minimum(starts[:, None] + place, len(symbols) - 1)
    symbol = np.where(place < lengths[:, None], symbols[at], -1)
    tree = np.full((n, 2 * leaves + 1), _NONE, np.int64)  # the last place takes what belongs to no leaf
    rank = ranks(symbol[:, :leaves].ravel(), symbol[:, 1 : leaves + 1].ravel()).reshape(n, leaves)
    tree[:, leaves:-1] = np.where(rank >= 0, rank * leaves + place[:leaves], _NONE)
    half = leaves // 2
    while half:
        tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
        half //= 2
    wide, wide_tree = leaves + 2, 2 * leaves + 1
    after, before = np.tile(place + 1, n), np.tile(place - 1, n)
    flat, nodes, rows = symbol.ravel(), tree.ravel(), np.arange(n)
    while True:
        root = nodes[rows * wide_tree + 1]
        keep = root != _NONE
        rows, root = rows[keep], root[keep]
        if not len(rows):
            return flat[flat >= 0], (symbol >= 0).sum(axis=1)
        base, base_tree = rows * wide, rows * wide_tree
        i = root & (leaves - 1)
        new = merged[root >> bits]
        j = after[base + i]
        k = after[base + j]
        flat[base + i], flat[base + j] = new, -1
        after[base + i], before[base + k] = k, i
        h = before[base + i]
        right, left = ranks(new, flat[base + k]), ranks(flat[base + h], new)  # one place before a row stands an empty one
        nodes[base_tree + leaves + i] = np.where(right >= 0, right * leaves + i, _NONE)
        nodes[base_tree + leaves + j] = _NONE
        nodes[base_tree + np.where(h >= 0, leaves + h, 2 * leaves)] = np.where(left >= 0, left * leaves + h, _NONE)
        paths = [leaves + i, leaves + np.where(j < leaves, j, i), leaves + np.where(h >= 0, h, i)]
        for _ in range(bits):
            for p in paths:
                p >>= 1
                up = base_tree + 2 * p
                nodes[base_tree + p] = np.minimum(nodes[up], nodes[up + 1])


class Codec:
    """Encoder and decoder of one tokenizer file (BPE over bytes, optional word-end suffix, no decoder of its own).

    The file's normaliser and pre-tokeniser are applied as the library applies them: by one compiled scan of the whole text
    where its characters allow it, else by the library's own; merges are ours.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("decoder") is not None:
            raise ValueError("a tokenizer file without a decoder is expected")
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        self.pair_ranks, self.merged_ids = PairRanks(self.ranks), np.array(self.merged, np.int64)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self.names = np.array([names.get(i, "") for i in range(max(names) + 1)], dtype=object)
        # a byte's character: itself where it is visible Latin-1, else one from 256 on, in order
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        sign = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.byte_of = {c: b for b, c in sign.items()}
        self.inner = np.array([vocab[sign[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[sign[b] + suffix] for b in range(256)], np.int64)
        tok = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = tok.normalizer, tok.pre_tokenizer
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        first = (spec["pre_tokenizer"].get("pretokenizers") or [{}])[0]
        self.plain = (first.get("pattern") or {}).get("Regex") == _WORD_SPLIT
        self.ids: dict[str, bytes] = {}
        self.decoded: dict[str, str] = {}

    def words(self, text: str) -> list[str]:
        """Words of a text without added tokens."""
        if self.plain and not NOT_FAST.search(text):
            return FAST_WORDS.findall(text.lower())
        found = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in found]

    def learn(self, words: list[str]) -> None:
        """Merge the words and remember their ids and decoded strings."""
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        symbols[ends - 1] = self.final[data[ends - 1]]
        starts = ends - lengths
        bits = np.frexp(np.maximum(lengths - 2, 0))[1]  # bit length of lengths - 2
        kind = np.where(lengths < 2, -1, np.where(lengths > SIDE_BY_SIDE, 99, bits))
        order = np.argsort(kind, kind="stable")
        kinds, heads = np.unique(kind[order], return_index=True)
        for b, group in zip(kinds.tolist(), np.split(order, heads[1:]), strict=True):
            step = len(group) if b < 0 else 1 if b == 99 else max(1, LEAVES >> b)
            for at in range(0, len(group), step):
                part = group[at : at + step]
                if b < 0:
                    ids, n = symbols[starts[part]], np.ones(len(part), np.int64)
                elif b == 99:
                    one = merge_word(symbols[starts[part[0]] : ends[part[0]]].tolist(), self.ranks, self.merged)
                    ids, n = np.array(one, np.int64), np.array([len(one)])
                else:
                    ids, n = merge_side_by_side(symbols, starts[part], lengths[part], b, self.pair_ranks, self.merged_ids)
                stops = np.cumsum(n)
                packed, names = ids.astype("<u4").tobytes(), self.names[ids].tolist()
                for w, a, z in zip(part.tolist(), (stops - n).tolist(), stops.tolist(), strict=True):
                    self.ids[words[w]] = packed[4 * a : 4 * z]
                    self.decoded[words[w]] = " ".join(names[a:z])

    def encode_all(self, texts: Iterable[str]) -> list[tuple[bytes, str]]:
        """Ids as little-endian uint32 bytes, and the decoded text, of each text."""
        if len(self.ids) > WORDS:
            self.ids.clear()
            self.decoded.clear()
        split, known, new = [], self.ids.__contains__, set()
        for t in texts:
            parts = self.split.split(t) if self.split else [t]
            parts = [(p, None) if k % 2 else (None, self.words(p)) for k, p in enumerate(parts)]
            for _, ws in parts:
                if ws:
                    new.update(filterfalse(known, ws))
            split.append(parts)
        if new:
            self.learn(list(new))
        out = []
        for parts in split:
            ids = [np.array([self.added[p]], "<u4").tobytes() if p else b"".join(map(self.ids.__getitem__, ws)) for p, ws in parts]
            back = [p or " ".join(map(self.decoded.__getitem__, ws)) for p, ws in parts if p or ws]
            out.append((b"".join(ids), " ".join(back)))
        for w in new:
            if len(w) > LONG_WORD:
                del self.ids[w], self.decoded[w]
        return out

    def encode(self, text: str) -> tuple[bytes, str]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by spaces, which is what a file without a decoder asks for."""
        return " ".join(self.names[i] for i in ids)


def _together(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > TOGETHER:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


@functools.lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    """The worker's codec: it and what it remembers outlive a task."""
    return Codec(path)


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, outputs: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; with ``outputs`` also ids and decoded themselves.

    Null and empty texts have no ids. Repeated rows and null ids are kept. One pass without a shuffle.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if outputs else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            n, ids_sha, text_sha, all_ids, decoded = [], [], [], [], []
            for ids, back in (r for some in _together([t or "" for t in batch.column(1).to_pylist()]) for r in codec.encode_all(some)):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(back.encode()).hexdigest())
                if outputs:
                    all_ids.append(np.frombuffer(ids, "<u4").tolist())
                    decoded.append(back)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            cols += [pa.array(all_ids, pa.list_(pa.int64())), pa.array(decoded, pa.string())] if outputs else []
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(cols)])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
