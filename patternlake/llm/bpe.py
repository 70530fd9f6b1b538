"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

The tree holds, for each stretch of positions, the least pair rank and the leftmost
position that has it. A merge takes the root's pair and makes three point updates
(the merged part, its left neighbour, the vanished part), each logarithmic, so a
match of n bytes costs O(n log n) whatever its length.

Defined results: null text is the empty text (no ids; hash of nothing); texts are
encoded whole; repeated rows are encoded each on its own; an empty table gives no
rows; columns other than id and text are ignored. Work is per row: no shuffle.
"""

from __future__ import annotations

import base64
import hashlib

import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Distinct matches in each of a worker's two generations of cache; those not met
#: while the newer one fills are forgotten.
CACHE = 200_000
#: Longer matches aren't remembered.
CACHE_CHARS = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=0)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, tuple[str, int, bytes]] = {}
        self.older: dict[str, tuple[str, int, bytes]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one match."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        n, get, longest = len(piece), self.ranks.get, self.longest
        none = 1 << 62  # above every (rank << 32 | position)
        size = 1 << (n - 1).bit_length()
        after, before = list(range(1, n + 2)), list(range(-1, n))
        tree = [none] * (2 * size)
        for i in range(n - 1):
            rank = get(piece[i : i + 2])
            if rank is not None:
                tree[size + i] = rank << 32 | i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        while (root := tree[1]) != none:
            i = root & 0xFFFFFFFF
            j = after[i]
            end = after[i] = after[j]
            h = before[i]
            changed = [(j, none)]
            if end < n:
                before[end] = i
                stop = after[end]
                rank = get(piece[i:stop]) if stop - i <= longest else None
                changed.append((i, none if rank is None else rank << 32 | i))
            else:
                changed.append((i, none))
            if h >= 0:
                rank = get(piece[h:end]) if end - h <= longest else None
                changed.append((h, none if rank is None else rank << 32 | h))
            for i, value in changed:
                k = size + i
                tree[k] = value
                while k > 1:
                    side = tree[k ^ 1]
                    if side < value:
                        value = side
                    k >>= 1
                    if tree[k] == value:
                        break
                    tree[k] = value
        ids, i = [], 0
        while i < n:
            ids.append(get(piece[i : after[i]]))
            i = after[i]
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def _new(self, match: str) -> tuple[str, int, bytes]:
        found = self.older.get(match)
        if found is None:
            ids = self.merge(match.encode())
            found = (",".join(map(str, ids)), len(ids), self.decode(ids))
        if len(match) <= CACHE_CHARS:
            if len(self.cache) >= CACHE:
                self.cache, self.older = {}, self.cache
            self.cache[match] = found
        return found

    def encode(self, text: str) -> list[int]:
        return [i for match in self.split(text) for i in self.merge(match.encode())]

    def round_trip(self, text: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the bytes decoded from them)."""
        new = self._new
        parts = [self.cache.get(m) or new(m) for m in self.split(text)]
        ids = ",".join([p[0] for p in parts])
        return (
            sum([p[1] for p in parts]),
            hashlib.sha256(ids.encode()).hexdigest(),
            hashlib.sha256(b"".join([p[2] for p in parts])).hexdigest(),
        )


_loaded: dict[tuple[str, str], ByteBPE] = {}


def worker_encoder(path: str, pattern: str) -> ByteBPE:
    """One encoder, with its cache, per Python worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE(load_ranks(path), pattern)
    return _loaded[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array) and decoded (binary) of every text."""

    def make():
        bpe = worker_encoder(path, pattern)
        return lambda texts: [(ids := bpe.encode(t), bpe.decode(ids)) for t in texts]

    return map_texts(docs, id_col, text_col, make, "ids array<int>, decoded binary")


def digest_documents(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of every text."""

    def make():
        bpe = worker_encoder(path, pattern)
        return lambda texts: [bpe.round_trip(t) for t in texts]

    return map_texts(docs, id_col, text_col, make, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))
