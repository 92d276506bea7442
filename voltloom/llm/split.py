"""Oversized texts into pieces at natural boundaries: balanced targets.

For a text of n tokens the least number of pieces is computed and equal-length targets are placed;
each target is moved to the strongest boundary near it: paragraph, line, sentence, word, then any
character; of equals the nearest, then the earlier one. Each piece begins with the stated number of
tokens of the piece before it. If a piece would be too long, counted in the text's own tokens or by
encoding the piece alone, one more piece is tried.

Cuts lie between tokens and never within a character: where an overlap would begin within one, it
begins at the last token before it that doesn't. Where a text can't be cut with the stated overlap
(characters of several tokens, an overlap close to the capacity) the overlap is halved until it can, and
``overlap_short`` is true for the pieces that repeat less than stated for that; a character that exceeds the
capacity alone is a piece of its own.

After a failure the number of pieces grows by a growing step (1, 2, 4 ...), and from the last failure to the
first success by halves, so a text takes a number of attempts that grows with the logarithm of its length. Texts no longer than the capacity, null and empty
texts have no pieces.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import texts_of
from .sizes import encoding

#: Share of a piece's length within which a target may move.
NEAR = 0.25
#: Marks that end a sentence, and white space, as UTF-8.
ENDS, WIDE = ".!?;", "。！？…；"
WIDE_ENDS = np.array([int.from_bytes(m.encode()) for m in WIDE], np.int32)
END = np.zeros(256, bool)
END[[ord(m) for m in ENDS]] = True
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

OTHER_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

SCHEMA = "limit_id int, id {id}, piece int, start_token bigint, n_tokens int, overlap_tokens int, overlap_short boolean, start_char bigint, n_chars bigint, text string"


def strengths(data: bytes, at: np.ndarray) -> np.ndarray:
    """Strength of the cuts at byte offsets: 4 paragraph, 3 line, 2 sentence, 1 word, 0 character,
    -1 within a character. The ends of the text count as paragraphs."""
    b = np.frombuffer(data, np.uint8)
    out = np.zeros(len(at), np.int8)
    inner = (at > 0) & (at < len(b))
    i = at[inner]
    prev, following = b[i - 1], b[i]
    prev2, prev3 = b[np.maximum(i - 2, 0)], b[np.maximum(i - 3, 0)]
    s = (SPACE[prev] | SPACE[following]).astype(np.int8)
    end = (END[prev] & SPACE[following]) | (END[prev2] & SPACE[prev] & (i > 1))
    if not data.isascii():
        mark = (prev3.astype(np.int32) << 16) | (prev2.astype(np.int32) << 8) | prev
        end |= np.isin(mark, WIDE_ENDS) & (i > 2)
    s[end] = 2
    line = (prev == 10) | (prev == 13)
    s[line] = 3
    s[line & ((prev2 == 10) | ((prev2 == 13) & (prev3 == 10))) & (i > 1)] = 4
    s[(following & 0xC0) == 0x80] = -1
    out[inner] = s
    out[~inner] = 4
    return out


def cuts(n: int, capacity: int, overlap: int, strong: np.ndarray, fits) -> list[tuple[int, int]] | None:
    """(start, end) in tokens of each piece. strong: strength of the cut before each token and at
    the end. fits(start, end): whether the piece alone is short enough."""
    step = capacity - overlap
    least = max(2, -(-(n - overlap) // step))
    valid = np.flatnonzero(strong >= 0)
    # few texts need more pieces than the least number: the search is by doubled steps, then by halves
    low, jump, high, found = least - 1, 1, None, None
    while high is None:
        pieces = min(low + jump, n)
        if (out := attempt(n, pieces, capacity, overlap, strong, valid, fits)) is not None:
            high, found = pieces, out
        elif pieces == n:
            return None
        else:
            low, jump = pieces, jump * 2
    while high - low > 1:
        middle = (low + high) // 2
        if (out := attempt(n, middle, capacity, overlap, strong, valid, fits)) is not None:
            high, found = middle, out
        else:
            low = middle
    return found


def attempt(n: int, pieces: int, capacity: int, overlap: int, strong: np.ndarray, valid: np.ndarray, fits) -> list[tuple[int, int]] | None:
    """So many pieces, or None if one of them would be too long."""
    step, mean = capacity - overlap, (n - overlap) / pieces
    out, start, end = [], 0, 0
    for j in range(1, pieces + 1):
        new = n
        if j < pieces:
            target = round(overlap + mean * j)
            # not beyond the capacity, nor so early that the rest can't be covered
            most = min(start + capacity, n - 1, target + int(mean * NEAR))
            least = max(end + 1, n - (pieces - j) * step, target - int(mean * NEAR))
            lo, hi = np.searchsorted(valid, least), np.searchsorted(valid, most, "right")
            if lo >= hi:
                return None
            near = valid[lo:hi]
            new = int(near[np.lexsort((near, np.abs(near - target), -strong[near]))[0]])
        if new - start > capacity or not fits(start, new):
            return None
        out.append((start, new))
        end = new
        if j < pieces:
            start = int(valid[np.searchsorted(valid, max(end - overlap, 0), "right") - 1])
            if start <= out[-1][0] and overlap:
                return None
    return out


def clean_cuts(data: bytes, ends: np.ndarray) -> np.ndarray:
    """Whether the text before and after a cut between tokens, encoded alone, gives the same tokens:
    the cut is before a run of white space, or after a run of one that isn't a space."""
    out = np.zeros(len(ends), bool)
    out[[0, -1]] = True
    at = ends[1:-1]
    b = np.frombuffer(data, np.uint8)
    prev, following, prev2 = b[at - 1], b[at], b[np.maximum(at - 2, 0)]
    out[1:-1] = (~SPACE[prev] & SPACE[following]) | (SPACE[prev] & (prev != 32) & ~SPACE[prev2] & ~SPACE[following])
    return out


def pieces_of(ends: np.ndarray, data: bytes, clean: np.ndarray, capacity: int, overlap: int, strong: np.ndarray, count) -> list[tuple[int, int]]:
    """Pieces of one text. ends: byte offset before each token and at the end; clean: the places of
    the clean cuts."""

    def fits(start: int, end: int) -> bool:
        # between clean cuts the tokens are the text's own; outside of them, at most one for each byte
        i, j = np.searchsorted(clean, start), np.searchsorted(clean, end, "right") - 1
        if i <= j:
            first, last = clean[i], clean[j]
            if ends[first] - ends[start] + last - first + ends[end] - ends[last] <= capacity:
                return True
            outer = [data[ends[u] : ends[v]].decode() for u, v in ((start, first), (last, end)) if u < v]
            return last - first + sum(map(count, outer)) <= capacity
        return count(data[ends[start] : ends[end]].decode()) <= capacity

    n, some = len(ends) - 1, overlap
    while (found := cuts(n, capacity, some, strong, fits)) is None and some:
        some //= 2
    if found is None:
        valid = np.flatnonzero(strong >= 0)
        found, start = [], 0
        while start < n:
            i, j = np.searchsorted(valid, start, "right"), np.searchsorted(valid, start + capacity, "right")
            end = next((int(e) for e in valid[i:j][::-1] if fits(start, int(e))), int(valid[i]))
            found.append((start, end))
            start = end
    return found


def split(documents: DataFrame, path: str, limits: list[tuple[int, int, int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each text for each (limit_id, capacity, overlap) that it exceeds, in one pass."""
    if any(not 0 <= overlap < capacity for _, capacity, overlap in limits):
        raise ValueError("an overlap must be smaller than its capacity")
    texts = texts_of(documents, id_col, text_col)

    def run(batches):
        encoder = encoding(path)
        table = [encoder.decode_single_token_bytes(i) for i in range(encoder.n_vocab)]
        lengths = np.array([len(t) for t in table], np.int64)
        for b in batches:
            id_at, cols = [], [[] for _ in range(9)]
            held = 0
            for row, text in enumerate(b.column(1).to_pylist()):
                if not text:
                    continue
                ids = np.array(encoder.encode_ordinary(text), np.int64)
                over = [x for x in limits if len(ids) > x[1]]
                if not over:
                    continue
                data = text.encode()
                ends = np.concatenate([[0], np.cumsum(lengths[ids])])
                strong = strengths(data, ends)
                clean = np.array([0, len(ids)]) if OTHER_SPACE.search(text) else np.flatnonzero(clean_cuts(data, ends))
                starts_char = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
                chars = np.concatenate([[0], starts_char])[ends]
                for limit, capacity, overlap in over:
                    before = 0
                    for k, (s, e) in enumerate(pieces_of(ends, data, clean, capacity, overlap, strong, lambda t: len(encoder.encode_ordinary(t)))):
                        id_at.append(row)
                        piece = data[ends[s] : ends[e]].decode()
                        held += len(piece)
                        for c, v in zip(cols, (limit, k, s, e - s, before - s if k else 0, bool(k) and before - s < overlap, int(chars[s]), len(piece), piece)):
                            c.append(v)
                        before = e
                if held > 1 << 25:
                    yield _batch(b, id_at, cols)
                    id_at, cols, held = [], [[] for _ in range(9)], 0
            yield _batch(b, id_at, cols)

    return texts.mapInArrow(run, SCHEMA.format(id=dict(texts.dtypes)["id"]))


def _batch(b: pa.RecordBatch, id_at: list[int], cols: list[list]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.string())
    limit, *rest = [pa.array(c, k) for c, k in zip(cols, kinds)]
    ids = b.column(0).take(pa.array(id_at, pa.int64()))
    return pa.RecordBatch.from_arrays([limit, ids, *rest], names=["limit_id", "id", "piece", "start_token", "n_tokens", "overlap_tokens", "overlap_short", "start_char", "n_chars", "text"])
