"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made.

A word starts as one symbol per byte (the last one marked as word end). The adjacent pair of the lowest rank is popped
from a heap again and again, its two symbols become one, and the pairs with the new neighbours are pushed; entries
that earlier merges made stale are skipped. Tokens of a word = initial symbols - merges.

A text's count is the sum over its words, so each task keeps the counts of words it has met in a table of at most
``cache_words`` entries (emptied when full: that costs time, never a count). Texts are read in place: no shuffle.

Defined cases: a null text is empty and has 0 tokens; strings of special tokens inside a text count as one token, as
the library does by default; repeated rows are counted each; an empty table gives an empty result; only the id and
text columns are read.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_WORDS = 700_000
LONGEST_KEPT = 64  # characters of a remembered word; longer ones seldom repeat
# White space of the tokenizer's normaliser. str.split() also splits at the four separators below.
WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class MergeCounter:
    """Counts tokens by the merges of a tokenizer file with word ends."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.symbols = byte_symbols()
        # (left, right) -> (rank, merged)
        self.merges: dict[tuple[str, str], tuple[int, str]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((left, right), (rank, left + right))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(special)) if special else None
        self.cache_words = cache_words
        self.by_piece: dict[str, int] = {}
        self.by_chunk: dict[str, int] = {}

    def merge_count(self, word: str) -> int:
        """Tokens of one word."""
        shown, merges = self.symbols, self.merges
        symbols: list[str | None] = [shown[b] for b in word.encode("utf-8", "surrogatepass")]
        n = len(symbols)
        symbols[-1] += self.end
        if n == 1:
            return 1
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = merges.get((symbols[i], symbols[i + 1]))
            if found:
                heap.append((found[0], i, found[1]))
        heapq.heapify(heap)
        merged = 0
        while heap:
            _, i, made = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is None or j >= n or symbols[i] + symbols[j] != made:
                continue
            if merges.get((symbols[i], symbols[j]), (0, ""))[1] != made:
                continue
            symbols[i], symbols[j] = made, None
            k = after[i] = after[j]
            merged += 1
            if k < n:
                before[k] = i
                found = merges.get((made, symbols[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get((symbols[h], made))
                if found:
                    heapq.heappush(heap, (found[0], h, found[1]))
        return n - merged

    def chunk_count(self, chunk: str) -> int:
        """Tokens of a run without white space."""
        text = unicodedata.normalize("NFC", chunk)
        # lower case letter by letter: no rule looks at a letter's neighbours
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        total = 0
        for piece in self.pieces(text):
            count = self.by_piece.get(piece)
            if count is None:
                count = self.merge_count(piece)
                if len(self.by_piece) >= self.cache_words:
                    self.by_piece.clear()
                if len(piece) <= LONGEST_KEPT:
                    self.by_piece[piece] = count
            total += count
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total = 0
        known = self.by_chunk
        parts = [text]
        if self.special and "<" in text and self.special.search(text):
            parts = self.special.split(text)
            total += len(parts) - 1
        for part in parts:
            chunks = WHITE.split(part) if SEPARATORS.search(part) else part.split()
            for chunk in chunks:
                count = known.get(chunk)
                if count is None:
                    count = self.chunk_count(chunk)
                    if len(known) >= self.cache_words:
                        known.clear()
                    if len(chunk) <= LONGEST_KEPT:
                        known[chunk] = count
                total += count
        return total


def token_counts(
    docs: DataFrame,
    tokenizer_file: str,
    limit: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    cache_words: int = CACHE_WORDS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = MergeCounter(tokenizer_file, cache_words)
        for batch in batches:
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "n_bytes": batch["n_bytes"],
                    "n_tokens": [counter.count(t) for t in batch["text"]],
                }
            )

    kind = dict(texts.dtypes)["doc_id"]
    counted = texts.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text"
    ).mapInPandas(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
