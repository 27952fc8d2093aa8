"""Byte-level BPE: pre-tokenisation by codepoint classes and transition functions, cached merges, decoding."""

import base64
import hashlib
import heapq
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.llm.common import bytes_of, spans, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes of text that are scanned at once; a longer text is scanned alone.
CHUNK = 1 << 20
#: Pieces in each of the two generations of the cache.
CACHE = 500_000

# Symbols of the scan: what a codepoint, with the one after it, means to the pattern.
L, SUFFIX1, SUFFIX2, N, O, AP, SPACE, LAST_SP, LAST_WS, END = range(10)
# States: FRESH: a token ends here whatever follows. IN_*: within a run. ATTACH: a blank that the next run takes.
# QUOTE: an apostrophe that began a token. HALF: one letter of a two-letter suffix is read.
FRESH, IN_L, IN_N, IN_O, IN_WS, ATTACH, QUOTE, HALF = range(8)
# White_Space of Unicode.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and cut[symbol, state]: whether a token begins at the symbol."""
    go, cut = np.zeros((10, 8), np.uint8), np.ones((10, 8), bool)
    for state in range(8):
        for symbol, run in ((L, IN_L), (SUFFIX1, IN_L), (SUFFIX2, IN_L), (N, IN_N), (O, IN_O)):
            go[symbol, state], cut[symbol, state] = run, state not in (run, ATTACH)
        go[AP, state], cut[AP, state] = (IN_O, False) if state in (IN_O, QUOTE, ATTACH) else (QUOTE, True)
        go[SPACE, state], cut[SPACE, state] = IN_WS, state != IN_WS
        go[LAST_SP, state], go[LAST_WS, state], go[END, state] = ATTACH, FRESH, FRESH
    cut[O, QUOTE] = False
    for symbol, to in ((SUFFIX1, FRESH), (SUFFIX2, HALF)):
        go[symbol, QUOTE], cut[symbol, QUOTE] = to, False
    for symbol in (L, SUFFIX1, SUFFIX2):
        go[symbol, HALF], cut[symbol, HALF] = FRESH, False
    return go, cut


@cache
def _classes() -> np.ndarray:
    """Class of each codepoint: L, N, O or SPACE."""
    out = np.full(sys.maxunicode + 1, O, np.uint8)
    kinds = {"L": L, "N": N}
    for c in range(sys.maxunicode + 1):
        if (k := kinds.get(unicodedata.category(chr(c))[0])) is not None:
            out[c] = k
    out[WHITE] = SPACE
    out[ord("'")] = AP
    return out


def _symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The symbol of each codepoint. ends: where END marks stand (between texts, and last)."""
    symbols = _classes()[points]
    symbols[ends] = END
    after = np.append(symbols[1:], END)
    white = symbols == SPACE
    last = white & (after != SPACE) & (after != END)
    symbols[last] = LAST_WS
    symbols[last & (points == 0x20)] = LAST_SP
    quote = np.flatnonzero(symbols[:-2] == AP)
    one, two = points[quote + 1], points[quote + 2]
    symbols[quote[np.isin(one, [ord(c) for c in "stmd"]) & (symbols[quote + 1] == L)] + 1] = SUFFIX1
    pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    symbols[quote[pair] + 1] = SUFFIX2
    return symbols


def cuts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a token (or an END mark) begins at each codepoint.

    The codepoints are laid out as columns of equal length. A column's transition function (the state after it
    for each of the 8 states before it) is composed symbol by symbol for all columns at once, until no column
    depends on the state before it any more, which white space brings about; then one state is enough. Applying
    these functions from left to right gives the state before each column, and a second pass gives the cuts."""
    go, cut = _machine()
    symbols = _symbols(points, ends)
    n = len(symbols)
    height = max(1, int(np.sqrt(n / 4)))
    width = -(-n // height)
    grid = np.full(height * width, END, np.intp)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(width, height).T)
    grid *= 8
    flat, flat_cut = go.ravel().astype(np.intp), cut.ravel()
    function = np.repeat(np.arange(8)[:, None], width, axis=1)
    for i, row in enumerate(grid):
        function = flat.take(row + function)
        if i % 16 == 15 and len(function) > 1 and (function == function[0]).all():
            function = function[:1]
    state = np.empty(width, np.intp)
    s = FRESH
    for i, f in enumerate(function.T.tolist()):
        state[i] = s
        s = f[s] if len(f) > 1 else f[0]
    out = np.empty((height, width), bool)
    for i, row in enumerate(grid):
        at = row + state
        flat_cut.take(at, out=out[i])
        state = flat.take(at)
    return out.T.ravel()[:n]


def pieces(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the pieces of all texts begin, ascending, with the end last; and the number of
    pieces before each text (and in all)."""
    count = len(offsets) - 1
    lead = np.flatnonzero((buffer & 0xC0) != 0x80)
    points = np.frombuffer(buffer.tobytes().decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
    at_end = np.searchsorted(lead, offsets[1:])  # codepoints up to each text's end
    ends = at_end + np.arange(count)
    with_marks = np.zeros(len(points) + count, np.uint32)
    real = np.ones(len(with_marks), bool)
    real[ends] = False
    with_marks[real] = points
    begins = cuts(with_marks, ends)[real]
    starts = lead[begins]
    return np.append(starts, len(buffer)), np.searchsorted(starts, offsets)


@cache
def vocabulary(name: str) -> tuple[dict[bytes, int], list[bytes]]:
    """Ranks by bytes, and bytes by rank, of a rank file of the installed tokenizers (a file of each worker's own)."""
    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    by_rank = [b""] * (max(ranks.values()) + 1)
    for k, v in ranks.items():
        by_rank[v] = k
    return ranks, by_rank


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of least rank is merged, the leftmost first, until none has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) > 48:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = len(ranks) + 1
    scores = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while scores and (least := min(scores)) < none:
        i = scores.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del scores[i]
        if i < len(scores):
            scores[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            scores[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As merge, in n log n steps: pairs wait in a heap, parts are linked."""
    n = len(piece)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if end[i] != j or j >= n or end[j] != stop:  # one of the two has been merged meanwhile
            continue
        end[i], end[j], after[i] = stop, -1, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(piece[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], i, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


class Encoder:
    """Merges pieces and keeps the packed ids of those met lately: two generations, the older one dropped when
    the younger is full, so that memory is bounded and frequent pieces stay."""

    def __init__(self, name: str):
        self.ranks, self.by_rank = vocabulary(name)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def packed(self, piece: bytes) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = array("I", merge(piece, self.ranks)).tobytes()
        if len(piece) <= 64:
            if len(self.young) >= CACHE:
                self.old, self.young = self.young, {}
            self.young[piece] = ids
        return ids

    def encode(self, buffer: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """For each text its ids, packed as little-endian unsigned 32-bit integers."""
        starts, first = pieces(buffer, offsets)
        data, at = buffer.tobytes(), starts.tolist()
        packed = self.packed
        found = []
        for k in map(slice, at, at[1:]):
            piece = data[k]
            found.append(self.young.get(piece) or packed(piece))
        bounds = first.tolist()
        return [b"".join(found[i:j]) for i, j in zip(bounds, bounds[1:])]

    def decode(self, packed: bytes) -> bytes:
        """The bytes of packed ids."""
        return b"".join(map(self.by_rank.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@cache
def encoder(name: str) -> Encoder:
    return Encoder(name)


def _encoded(batches: Iterator[pa.RecordBatch], name: str, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    work = encoder(name)
    for batch in batches:
        buffer, offsets = bytes_of(batch.column("text"))
        for i, j in spans(offsets, CHUNK):
            ids = work.encode(buffer[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            decoded = [work.decode(x) for x in ids]
            columns = {
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
            }
            if keep_ids:
                values = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                list_offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                columns["ids"] = pa.ListArray.from_arrays(pa.array(list_offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], *columns.values()], ["doc_id", *columns])


def encode(docs: DataFrame, name: str = VOCABULARY, keep_ids: bool = True) -> DataFrame:
    """doc_id, number of tokens, digests of the ids and of the bytes they decode to [, the ids], for every row.

    Whole texts are encoded, without special tokens. A null text counts as empty and has no tokens; rows are
    kept as they are, whatever their id, and other columns are not looked at. No shuffle."""
    fields = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(lambda batches: _encoded(batches, name, keep_ids), fields)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, decoded again; null texts are empty and have no tokens."""
    return encode(table(spark, sf_dir, "documents"), keep_ids=False)


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the ids of every document's text, with their digests and that of the decoded bytes."""
    return encode(docs, keep_ids=True)
