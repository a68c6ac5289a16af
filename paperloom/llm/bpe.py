"""Token counts by heap-and-linked-list byte-pair merging.

Each pre-token starts as a linked list of byte symbols. A heap holds the adjacent
pairs that have a merge rank; the lowest rank (leftmost on ties) is popped and merged
until none is left. The count is initial symbols minus merges: no identifiers are made.

Defined results: null text counts as empty (0 bytes, 0 tokens); a null id stays null;
repeated rows each give their own row; other columns of the input are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import text_batches

#: Fixed value: the published pre-token pattern of byte-level BPE, white space spelt out.
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Pre-tokens kept with their counts in one Python worker, and the longest that is kept.
CACHE_ENTRIES, CACHE_CHARS = 1_000_000, 64
SHIFT = 21


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: itself if printable, else the next free code point from 256."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class TokenCounter(dict):
    """Pre-token -> number of tokens, filled as pre-tokens are met."""

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.base = [vocab[s] for _, s in sorted(byte_symbols().items())]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[a] << SHIFT | vocab[b]] = (rank, vocab[a + b])
        self.find = regex.compile(PRE_TOKEN).findall
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None

    def __missing__(self, token: str) -> int:
        n = self.merged(token.encode("utf-8"))
        if len(token) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[token] = n
        return n

    def merged(self, data: bytes) -> int:
        n = len(data)
        if n < 2:
            return n
        pairs, base = self.pairs, self.base
        sym = [base[b] for b in data]
        heap = []
        for i in range(n - 1):
            hit = pairs.get(sym[i] << SHIFT | sym[i + 1])
            if hit:
                heap.append((hit[0], i, sym[i], sym[i + 1], hit[1]))
        if not heap:
            return n
        heapify(heap)
        nxt, prv, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            _, i, a, b, new = heappop(heap)
            j = nxt[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # one side was merged meanwhile
            sym[i], sym[j] = new, -1
            k = nxt[i] = nxt[j]
            left -= 1
            if k < n:
                prv[k] = i
                hit = pairs.get(new << SHIFT | sym[k])
                if hit:
                    heappush(heap, (hit[0], i, new, sym[k], hit[1]))
            h = prv[i]
            if h >= 0:
                hit = pairs.get(sym[h] << SHIFT | new)
                if hit:
                    heappush(heap, (hit[0], h, sym[h], new, hit[1]))
        return left

    def count(self, text: str) -> int:
        get, find = self.__getitem__, self.find
        if self.special is None or not self.special.search(text):
            return sum(map(get, find(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(get, find(p))) for p in parts)


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One counter a Python worker and vocabulary file."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, vocab_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every row; `vocab_path` is installed on all executors."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = pa.schema([(id_col, pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocab_path).count
        for batch in batches:
            texts = batch.column(1)
            n_bytes = pa.compute.binary_length(texts).cast(pa.int64())
            n_tokens = [count(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), n_bytes, pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                schema=out,
            )

    return text_batches(rows).mapInArrow(run, f"`{id_col}` long, n_bytes long, n_tokens long, over_limit boolean")
