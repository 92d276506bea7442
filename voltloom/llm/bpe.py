"""Byte-level BPE encoding in Arrow batches, and decoding as a Spark expression.

A text is split into words by the pattern that belongs to the rank file, as a Spark expression.
Each distinct word of a batch is encoded once: a word that is a token of its own is looked up, the
others are encoded by a fold over their byte ids, many words at a time: each step finds in every
word the pair of neighbours of lowest rank in a rank table and joins it, until no word has a pair
left. Nothing is shuffled.

The tables' size is that of the vocabulary, never of the data.

Words of more than ``FOLD_BYTES`` bytes take the same merges with a heap, for the fold's time grows
with the square of a word's length.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The fold takes so many words at a time at most: its arrays then stay small, however many words there are.
FLAT_WORDS = 16_384
#: A task remembers the ids of so many words of earlier batches at most. It changes no result: a
#: word that isn't remembered is encoded again.
CACHE_WORDS = 50_000
#: Longest word, in bytes, that is encoded by the fold.
FOLD_BYTES = 256

#: White space as Unicode has it, and the pre-split pattern of the rank files.
WHITE = r"\t-\r\x{85}\x20\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORDS = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+"
    rf"|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)


def tokenizer_path(name: str) -> str:
    """Path of the rank file of a public tokenizer, by its name."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_pairs(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left id, right id) -> id of the joined token: what is left of a token's bytes when only
    the merges of lower rank were made."""
    pairs: dict[tuple[int, int], int] = {}
    for token, rank in ranks.items():
        if len(token) < 2:
            continue
        pieces = [token[i : i + 1] for i in range(len(token))]
        while len(pieces) > 2:
            found = [(r, i) for i in range(len(pieces) - 1) if (r := ranks.get(pieces[i] + pieces[i + 1], rank)) < rank]
            if not found:
                break
            _, i = min(found)
            pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
        if len(pieces) == 2:
            pairs[ranks[pieces[0]], ranks[pieces[1]]] = rank
    return pairs


def heap_encode(word: bytes, byte_ids: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """The same merges as the fold's, lowest rank first and leftmost of equals, with a heap."""
    ids = [byte_ids[b] for b in word]
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get((ids[i], ids[i + 1]))) is not None]
    heapq.heapify(heap)
    gone = bytearray(n + 1)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= n or ids[i] != a or ids[j] != b:
            continue
        ids[i], gone[j] = r, 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (q := pairs.get((r, ids[k]))) is not None:
                heapq.heappush(heap, (q, i, r, ids[k]))
        if (h := before[i]) >= 0 and (q := pairs.get((ids[h], r))) is not None:
            heapq.heappush(heap, (q, h, ids[h], r))
    return [x for x, out in zip(ids, gone) if not out]


def _overlay(rows: dict[int, list[int]], width: int) -> dict[int, int]:
    """Lays sparse rows over each other: a start for each row so that no two entries meet."""
    taken = np.zeros(width * 16, bool)
    starts: dict[int, int] = {}
    for a in sorted((a for a in rows if len(rows[a]) > 1), key=lambda a: -len(rows[a])):
        own, at = np.array(sorted(rows[a])), 0
        while a not in starts:
            some = np.arange(at, at + 2048)[~taken[own[0] + at : own[0] + at + 2048]]
            fits = ~taken[some[:, None] + own[None, :]].any(1)
            if fits.any():
                starts[a] = int(some[fits.argmax()])
                taken[starts[a] + own] = True
            at += 2048
    free, k = np.flatnonzero(~taken).tolist(), 0
    for b, a in sorted((rows[a][0], a) for a in rows if len(rows[a]) == 1):
        while free[k] < b:
            k += 1
        starts[a], taken[free[k]] = free[k] - b, True
        k += 1
    return starts


class Merges:
    """The merges of a rank file as arrays: a sparse matrix, left id x right id -> joined id, its rows
    laid over each other."""

    def __init__(self, pairs: dict[tuple[int, int], int], byte_ids: list[int], size: int) -> None:
        rows: dict[int, list[int]] = {}
        for a, b in pairs:
            rows.setdefault(a, []).append(b)
        starts = _overlay(rows, size)
        self.byte_ids, self.starts = np.array(byte_ids, np.int32), np.zeros(size, np.int32)
        self.starts[list(starts)] = list(starts.values())
        self.owner = np.full(int(self.starts.max()) + size, -1, np.int32)
        self.joined = np.zeros(len(self.owner), np.int32)
        for (a, b), r in pairs.items():
            self.owner[starts[a] + b], self.joined[starts[a] + b] = a, r

    def pairs(self) -> dict[tuple[int, int], int]:
        at = np.flatnonzero(self.owner >= 0)
        left = self.owner[at]
        return dict(zip(zip(left.tolist(), (at - self.starts[left]).tolist()), self.joined[at].tolist()))

    def fold(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words, none of them empty, one after the other, and the number of ids of each."""
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        counts, own = np.fromiter(map(len, words), np.int64, len(words)), np.arange(len(words))
        none, place = np.int64(1) << 62, (np.int64(1) << 32) - 1
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(own):
            ends = np.cumsum(counts)
            firsts = ends - counts
            # the lowest rank of a word's pairs, and of equal ones the leftmost
            at = self.starts[ids[:-1]] + ids[1:]
            keys = np.full(len(ids), none)
            np.copyto(keys[:-1], (self.joined[at].astype(np.int64) << 32) + np.arange(len(at)), where=self.owner[at] == ids[:-1])
            keys[ends - 1] = none
            low = np.minimum.reduceat(keys, firsts)
            ended = low == none
            stay = np.ones(len(ids), bool)
            i = low[~ended] & place
            ids[i] = low[~ended] >> 32
            stay[i + 1] = False
            if ended.any():
                rest = np.repeat(ended, counts)
                done.append((own[ended], counts[ended], ids[rest]))
                stay &= ~rest
            ids, own, counts = ids[stay], own[~ended], counts[~ended] - 1
        size = np.zeros(len(words), np.int64)
        for own, n, _ in done:
            size[own] = n
        out, firsts = np.empty(int(size.sum()), np.int32), np.cumsum(size) - size
        for own, n, ids in done:
            out[_ranges(firsts[own], n)] = ids
        return out, size


def _ranges(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each range, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(firsts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


class Bpe:
    """The tables of one rank file."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.ranks = read_ranks(path)
        if max(self.ranks.values()) >= 1 << 30:
            raise ValueError("an id and a place in a batch must fit 62 bits")
        self.pairs = merge_pairs(self.ranks)
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]
        self.size = max(self.ranks.values()) + 1
        self.merges = Merges(self.pairs, self.byte_ids, self.size)


class Words:
    """The ids of distinct words in one array; remembers words from batch to batch."""

    def __init__(self, path: str, merges: Merges, at_once: int, remember: int) -> None:
        self.ranks, self.merges, self.at_once, self.remember = _ranks(path), merges, at_once, remember
        # a token's id is its place
        self.ids, self.known = np.arange(len(merges.starts), dtype=np.int32), {}
        self.pairs: dict[tuple[int, int], int] | None = None

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and the place of each word's first one and their number."""
        firsts, counts = np.zeros(len(words), np.int32), np.ones(len(words), np.int32)
        short, long = [], []
        for k, w in enumerate(words):
            if (r := self.ranks.get(w)) is not None:
                firsts[k] = r
            elif (own := self.known.get(w)) is not None:
                firsts[k], counts[k] = own
            else:
                (short if len(w) <= FOLD_BYTES else long).append(k)
        pool, size = [self.ids], len(self.ids)
        for j in range(0, len(short), self.at_once):
            some = short[j : j + self.at_once]
            ids, n = self.merges.fold([words[k] for k in some])
            firsts[some], counts[some] = size + np.cumsum(n) - n, n
            pool.append(ids)
            size += len(ids)
            # words are remembered from the first ones on, so that their ids lie together
            if self.remember and len(self.known) < self.remember:
                self.known.update((words[k], (int(firsts[k]), int(counts[k]))) for k in some[: self.remember - len(self.known)])
                self.ids = np.concatenate([self.ids, ids])
        for k in long:
            self.pairs = self.pairs or self.merges.pairs()
            ids = np.array(heap_encode(words[k], self.merges.byte_ids.tolist(), self.pairs), np.int32)
            firsts[k], counts[k] = size, len(ids)
            pool.append(ids)
            size += len(ids)
        return np.concatenate(pool), firsts, counts


@lru_cache(maxsize=4)
def tables(path: str) -> Bpe:
    return Bpe(path)


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    return read_ranks(path)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(0))


def texts_of(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) by exact column names, whatever other columns there are. Work on texts takes far more
    time than moving them: where the input has fewer partitions than the cluster has cores (one
    small file), the texts are spread; larger inputs are read where they lie."""
    own = documents.columns
    texts = documents.toDF(*[f"c{i}" for i in range(len(own))]).select(F.col(f"c{own.index(id_col)}").alias("id"), F.col(f"c{own.index(text_col)}").alias("text"))
    cores = texts.sparkSession.sparkContext.defaultParallelism
    return texts.repartition(cores) if texts.rdd.getNumPartitions() < cores else texts


def encode(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", cache: bool = True) -> DataFrame:
    """(id, ids array<int>): each text's ids without special tokens, one row for each row.

    Null and empty texts give an empty list. The strings of special tokens are ordinary text. Only
    the two named columns are read, whatever others there are. Texts may be of any length."""
    texts = texts_of(documents, id_col, text_col)
    merges, at_once, remember = tables(path).merges, FLAT_WORDS, CACHE_WORDS if cache else 0

    def ids(batches):
        words = Words(path, merges, at_once, remember)
        for b in batches:
            lists = b.column(1)
            distinct = lists.flatten().dictionary_encode()
            own = distinct.indices.to_numpy()
            all_ids, firsts, counts = words.encode(distinct.dictionary.cast(pa.binary()).to_pylist())
            n = counts[own]
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            offsets = lists.offsets.to_numpy()
            flat = pa.array(all_ids[_ranges(firsts[own], n)], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends[offsets - offsets[0]]), flat)], names=[id_col, "ids"])

    schema = T.StructType([T.StructField(id_col, texts.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return texts.select("id", _words(F.col("text")).alias("words")).mapInArrow(ids, schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", to: str = "text") -> DataFrame:
    """Adds the text of ids: their binary pieces joined. Ids that are no token, and null ids, give
    nothing; null lists give null."""
    bpe = tables(path)
    hexes = [""] * bpe.size
    for token, rank in bpe.ranks.items():
        hexes[rank] = token.hex()
    pieces = F.split(F.lit(",".join(hexes)), ",")
    joined = F.array_join(F.transform(ids_col, lambda i: F.coalesce(F.get(pieces, i.cast("int")), F.lit(""))), "")
    return encoded.withColumn(to, F.decode(F.unhex(joined), "UTF-8"))
