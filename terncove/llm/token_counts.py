"""Exact token counts at every prefix by dynamic programming.

For byte-level BPE the tokens of a prefix satisfy a recurrence: the last token of ``word[:i]`` is the one token
``t = word[j:i]`` for which BPE applied to (last token of ``word[:j]``) + ``t`` yields exactly these two tokens, and then
``count[i] = count[j] + 1``. Walking ``i`` upwards fills the table of a pre-token without merging anything; tables are
kept per distinct pre-token, and a text's table is the running sum over its pre-tokens plus the table inside the one
where a prefix ends. ``PrefixCounts`` answers how many tokens a prefix has and which longest prefix fits a budget.

Here a prefix's count means the tokens of the text's own pre-tokens up to there, the last one cut: what an encoder
that is fed the cut text gives, except where cutting changes how white space or an apostrophe groups.

Special strings (``<|endoftext|>``) inside a text are one token, as the tokenizers library does by default.

Defined results: a null text counts as empty (0 bytes, 0 tokens); whole texts are counted however long; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import append
from .bpe import tokenizer_file
from .units import LONGEST_KEY, UNIT, Memo, held

# Fixed value: the splitting pattern of this family of byte-level vocabularies.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
MEMO_UNITS = 600_000


def byte_alphabet() -> dict[str, int]:
    """Characters that byte-level vocabularies write for bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    def __init__(self, tokenizer_path: str):
        with open(tokenizer_path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        as_bytes = lambda s: bytes(letters[c] for c in s)
        tokens = {as_bytes(t) for t in spec["model"]["vocab"] if t not in self.special}
        # own numbers: bytes first, then merges in order of rank, so a smaller number is merged earlier
        number = {bytes([b]): b for b in range(256)}
        self.made: dict[tuple[int, int], int] = {}
        self.halves = [(b, b) for b in range(256)]
        for pair in spec["model"]["merges"]:
            left, right = map(as_bytes, pair if isinstance(pair, list) else pair.split(" "))
            self.made[number[left], number[right]] = len(self.halves)
            number.setdefault(left + right, len(self.halves))
            self.halves.append((number[left], number[right]))
        self.spelled = {n: t for t, n in number.items()}
        #: every prefix of a token; its number if it is a token itself, else -1
        self.known = {t[:i]: -1 for t in tokens for i in range(1, len(t))} | {t: number[t] for t in tokens}
        self.sound: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.words: Memo = Memo(MEMO_UNITS // 2)
        self.totals: Memo = Memo(MEMO_UNITS)

    def merge(self, word: bytes) -> list[int]:
        """Plain BPE of a short string: the best-ranked neighbours merge until none can."""
        parts = list(word)
        while len(parts) > 1:
            n, at = min((self.made.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if n == 1 << 60:
                break
            parts[at : at + 2] = [n]
        return parts

    def _agree(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left`` and ``right`` standing side by side (``left`` -1: at the start).

        Undo the merges of both sides from the latest to the earliest; at each moment the two parts that meet at the
        seam must not form a token that would have been merged before the next of these merges.
        """
        if left < 0:
            if (ok := self.sound.get(right)) is None:
                ok = self.sound[right] = self.merge(self.spelled[right]) == [right]
            return ok
        if not self._agree(-1, right):
            return False
        none = len(self.halves)
        a, b, before = left, right, none
        while True:
            if self.made.get((a, b), none) < before:
                return False
            if a > b and a > 255 or b <= 255:
                if a <= 255:
                    return True
                before, a = a, self.halves[a][1]
            else:
                before, b = b + 1, self.halves[b][0]

    def table(self, word: bytes) -> bytes | list[int]:
        """count[i] for each byte prefix of one pre-token, count[0] = 0; as bytes where they fit."""
        n, known, pairs = len(word), self.known, self.pairs
        last, count = [-2] * (n + 1), [0] * (n + 1)
        last[0] = -1
        for j in range(n):
            before = last[j] << 17
            for i in range(j + 1, n + 1):
                token = known.get(word[j:i])
                if token is None:
                    break
                if token >= 0 and last[i] == -2:
                    ok = pairs.get(before + token)
                    if ok is None:
                        ok = pairs[before + token] = self._agree(last[j], token)
                    if ok:
                        last[i] = token
                        count[i] = count[j] + 1
        return bytes(count) if count[-1] < 256 > max(count) else count

    def _pretokens(self, text: str) -> Iterator[tuple[str, bytes | list[int]]]:
        pieces = self.split_special.split(text) if self.split_special else [text]
        for piece in pieces:
            if piece in self.special:
                yield piece, [*[0] * len(piece.encode()), 1]
                continue
            for word in PRETOKEN.findall(piece):
                got = self.words.get(word) or self.words.recall(word)
                if got is None:
                    got = self.table(word.encode("utf-8", "surrogatepass"))
                    if len(word) <= LONGEST_KEY:
                        self.words[word] = got
                yield word, got

    def prefix_counts(self, text: str) -> PrefixCounts:
        return PrefixCounts([t for _, t in self._pretokens(text)])

    def _unit_total(self, unit: str) -> int:
        got = self.totals.recall(unit)
        if got is None:
            got = sum(t[-1] for _, t in self._pretokens(unit))
            if len(unit) <= LONGEST_KEY:
                self.totals[unit] = got
        return got

    def total(self, text: str) -> int:
        """The table's last entry, summed over units (pieces between sure boundaries) that are remembered."""
        units, totals = UNIT.findall(text), self.totals
        try:
            return sum(map(totals.__getitem__, units))
        except KeyError:
            return sum(totals[u] if u in totals else self._unit_total(u) for u in units)

    def turn(self) -> None:
        self.words.turn()
        self.totals.turn()
        if len(self.pairs) > MEMO_UNITS:
            self.pairs.clear()


class PrefixCounts:
    """Counts at every byte prefix of one text."""

    def __init__(self, tables: list[list[int]]):
        self.tables = tables
        self.ends = [0, *accumulate(len(t) - 1 for t in tables)]
        self.sums = [0, *accumulate(t[-1] for t in tables)]

    @property
    def total(self) -> int:
        return self.sums[-1]

    def at(self, n_bytes: int) -> int:
        """Tokens of the first ``n_bytes`` bytes."""
        k = bisect_right(self.ends, n_bytes) - 1
        return self.sums[k] + (self.tables[k][n_bytes - self.ends[k]] if k < len(self.tables) else 0)

    def longest_within(self, budget: int) -> int:
        """The largest number of bytes whose count is at most ``budget``. Counts inside a pre-token may fall again."""
        k = bisect_right(self.sums, budget) - 1
        if k >= len(self.tables):
            return self.ends[-1]
        inside = max(i for i, c in enumerate(self.tables[k]) if self.sums[k] + c <= budget)
        return self.ends[k] + inside


def counter(path: str) -> PrefixCounter:
    return held(f"counter {path}", lambda: PrefixCounter(path))


def count_tokens(docs: DataFrame, tokenizer_path: str, budgets: tuple[int, ...] = (), text_col: str = "text") -> DataFrame:
    """All input columns but the text, n_bytes, n_tokens, and for each budget the bytes that fit: ``fits`` array<long>."""

    def run(texts: list[str | None]) -> dict[str, list]:
        own = counter(tokenizer_path)
        own.turn()
        totals, fits = [], []
        for text in texts:
            if budgets:
                counts = own.prefix_counts(text or "")
                totals.append(counts.total)
                fits.append([counts.longest_within(b) for b in budgets])
            else:
                totals.append(own.total(text or ""))
                fits.append([])
        return {"n_bytes": [len((t or "").encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": totals, "fits": fits}

    long = (T.LongType(), pa.int64())
    adds = [("n_bytes", *long), ("n_tokens", *long), ("fits", T.ArrayType(T.LongType()), pa.list_(pa.int64()))]
    return append(docs, run, [text_col], adds, drop=(text_col,))


def op5_token_counts(spark, sf_dir, limit: int = 1024):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = count_tokens(docs, tokenizer_file("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
