"""Fill-in-middle transformation, as one numpy kernel over the Arrow buffers of a whole batch of texts.

1. A table of 256 entries gives every byte of the batch its class, and a small table of pairs of classes tells whether a unit begins
   between two adjacent bytes. Bytes of different documents are never adjacent.
2. The cumulative sum of these boundaries, reset at the start of each document, numbers the units.
3. ``searchsorted`` on that sum turns the numbers of units at which all rows are cut into positions of bytes, for all rows together.

A document's cuts, whether it is transformed and in which order its parts are written follow from a digest of seed and doc_id alone, so
reruns and other partitionings agree. The output is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle (psm) or ``<S>`` suffix ``<P>`` prefix
``<M>`` middle (spm); ``restore`` rebuilds the text from output and form.

Defined results: a null text is empty; empty texts and texts that contain a sentinel are plain (the output is the text); a null doc_id
has the empty string for its decimal digits; rows that repeat a doc_id are cut alike; an empty table gives an empty result; further
columns pass, but for those named like an added one, which are replaced. Batches are bounded by bytes (``arrow.BATCH_BYTES``); a longer text is a
batch of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import small_batches, trim, trimmed

SEED = "7"
SENTINELS = ("<P>", "<S>", "<M>")


@dataclass(frozen=True)
class Units:
    """How bytes form units: ``classes`` lists the bytes of classes 1, 2, ... (all others are 0); a unit begins between two bytes
    whose classes are one of ``begins``."""

    classes: tuple[bytes, ...]
    begins: tuple[tuple[int, int], ...]

    def boundaries(self, data: np.ndarray) -> np.ndarray:
        """Whether a unit begins at each byte, by the byte before it."""
        table = np.zeros(256, np.uint8)
        for k, members in enumerate(self.classes, 1):
            table[np.frombuffer(members, np.uint8)] = k
        n = len(self.classes) + 1
        pairs = np.zeros(n * n, bool)
        for a, b in self.begins:
            pairs[a * n + b] = True
        kinds = table[data]
        out = np.zeros(len(data), bool)
        if len(data):
            out[1:] = pairs[kinds[:-1] * np.uint8(n) + kinds[1:]]
        return out


#: A line ends after each newline; a word begins where white space ends; a character begins at a byte that continues none.
LINES = Units((b"\n",), ((1, 0), (1, 1)))
WORDS = Units((b" \t\n\v\f\r",), ((1, 0),))
CHARACTERS = Units((bytes(range(0x80, 0xC0)),), ((0, 0), (1, 0)))


@dataclass
class Texts:
    """Texts as one array of bytes and the places where each begins and ends."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        """Without a copy; nulls are empty."""
        column = column.cast(pa.large_string())
        if not len(column):
            return cls(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        lo, hi = int(at[0]), int(at[-1])
        held = np.frombuffer(data, np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
        starts, ends = at[:-1] - lo, at[1:] - lo
        if column.null_count:
            ends = np.where(column.is_null().to_numpy(zero_copy_only=False), starts, ends)
        return cls(held, starts, ends)

    def inside(self, mask: np.ndarray) -> np.ndarray:
        """``mask`` without the first byte of each text, which no byte of the same text comes before."""
        mask[self.starts[self.starts < self.ends]] = False
        return mask

    def sums(self, mask: np.ndarray) -> np.ndarray:
        """How many of the bytes before each position are marked; one entry more than bytes."""
        return np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])

    def occurrences(self, needle: bytes) -> np.ndarray:
        """Positions of ``needle`` within texts, ascending."""
        n = len(self.data) - len(needle) + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.data[:n] == needle[0])
        for k in range(1, len(needle)):
            at = at[self.data[at + k] == needle[k]]
        owner = np.searchsorted(self.starts, at, side="right") - 1
        return at[at + len(needle) <= self.ends[owner]] if len(at) else at

    def counts(self, positions: np.ndarray) -> np.ndarray:
        """How many of the ascending positions lie in each text."""
        return np.searchsorted(positions, self.ends) - np.searchsorted(positions, self.starts)


def cut(texts: Texts, units: Units, places: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of units of each text, and the positions after as many units as ``places(numbers)`` names twice."""
    sums = texts.sums(texts.inside(units.boundaries(texts.data)))
    base = sums[texts.starts]  # what earlier documents have: the sum starts anew
    n = sums[texts.ends] - base + (texts.ends > texts.starts)
    found = []
    for wanted in places(n):
        at = np.searchsorted(sums[1:], base + wanted, side="left")  # the byte at which unit ``wanted`` (from 0) begins
        found.append(np.where(wanted == 0, texts.starts, np.where(wanted >= n, texts.ends, at)))
    return n, found[0], found[1]


def draws(ids: list, seed: str) -> np.ndarray:
    """Four 32-bit numbers a row, from the digest of seed, colon and decimal id."""
    raw = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(raw, ">u4").reshape(-1, 4).astype(np.int64)


def joined(sources: list[memoryview], lengths: np.ndarray) -> pa.Array:
    """A string column from the pieces of all rows in order, and the rows' lengths in bytes."""
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(b"".join(sources))).cast(pa.string())


def transform(column: pa.Array, ids: list, units: Units = LINES, rate: int = 100, spm_rate: int = 50, seed: str = SEED, sentinels=SENTINELS) -> dict:
    """The columns that ``fill_middle`` adds, for one batch."""
    texts, h = Texts.of(column), draws(ids, seed)
    n, first, second = cut(texts, units, lambda n: (np.minimum(h[:, 0] % (n + 1), h[:, 1] % (n + 1)), np.maximum(h[:, 0] % (n + 1), h[:, 1] % (n + 1))))
    marks = [s.encode() for s in sentinels]
    marked = sum((texts.counts(texts.occurrences(m)) for m in marks), np.zeros(len(n), np.int64))
    plain = (texts.ends == texts.starts) | (marked > 0) | (h[:, 2] % 100 >= rate)
    spm = h[:, 3] % 100 < spm_rate
    characters = texts.sums((texts.data & 0xC0) != 0x80)
    p, s, m = (memoryview(x) for x in marks)
    data, pieces = memoryview(texts.data), []
    for a, b, c, d, as_is, back in zip(texts.starts.tolist(), first.tolist(), second.tolist(), texts.ends.tolist(), plain.tolist(), spm.tolist(), strict=True):
        if as_is:
            pieces.append(data[a:d])
        elif back:
            pieces += (s, data[c:d], p, data[a:b], m, data[b:c])
        else:
            pieces += (p, data[a:b], s, data[c:d], m, data[b:c])
    lengths = texts.ends - texts.starts + np.where(plain, 0, sum(map(len, marks)))
    return {
        "n": pa.array(n), "form": pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")).astype(object), pa.string()),
        "prefix_chars": pa.array(characters[first] - characters[texts.starts], mask=plain),
        "middle_chars": pa.array(characters[second] - characters[first], mask=plain), "output": joined(pieces, lengths),
    }


def rebuild(output: pa.Array, forms: list, sentinels=SENTINELS) -> pa.Array:
    """The texts that ``transform`` had; an output that is not plain holds each sentinel once."""
    texts = Texts.of(output)
    marks = [s.encode() for s in sentinels]
    whole = np.array([f == "plain" or f is None for f in forms], bool)
    places = []
    for mark in marks:
        at = texts.occurrences(mark)
        once = texts.counts(at)
        if (once[~whole] != 1).any():
            raise ValueError(f"an output that is not plain must hold {mark.decode()} once")
        places.append(at[np.minimum(np.searchsorted(at, texts.starts), max(0, len(at) - 1))] if len(at) else texts.starts)
    p, s, m = places
    lp, ls, lm = map(len, marks)
    data, pieces = memoryview(texts.data), []
    for a, d, at_p, at_s, at_m, form in zip(texts.starts.tolist(), texts.ends.tolist(), p.tolist(), s.tolist(), m.tolist(), forms, strict=True):
        if form == "psm":
            pieces += (data[at_p + lp : at_s], data[at_m + lm : d], data[at_s + ls : at_m])
        elif form == "spm":
            pieces += (data[at_p + lp : at_m], data[at_m + lm : d], data[at_s + ls : at_p])
        else:
            pieces.append(data[a:d])
    return joined(pieces, texts.ends - texts.starts - np.where(whole, 0, lp + ls + lm))


def _check(sentinels: tuple[str, ...]) -> None:
    """No sentinel may begin with an end of another or itself: parts and sentinels side by side would then hold one that is not there."""
    for a in sentinels:
        for b in sentinels:
            if not a or any(b.startswith(a[k:]) for k in range(1, len(a))) or (a != b and a in b) or sentinels.count(a) > 1:
                raise ValueError(f"sentinels must not be empty, equal, or overlap: {sentinels}")


def _adding(df: DataFrame, adds: list[tuple[str, T.DataType]], make: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    small_batches(df.sparkSession)
    names = {n.lower() for n, _ in adds}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(batches):
            made = make(batch)
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, *(made[n] for n, _ in adds)], [*(f.name for f in kept), *(n for n, _ in adds)])
            if k % 8 == 7:
                trim()

    return df.mapInArrow(trimmed(run), T.StructType([*kept, *(T.StructField(n, t) for n, t in adds)]))


ADDS = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())]


def fill_middle(
    docs: DataFrame, units: Units = LINES, rate: int = 100, spm_rate: int = 50, seed: str = SEED, sentinels: tuple[str, str, str] = SENTINELS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``docs`` with n (units of the text), form, prefix_chars, middle_chars (null if plain) and output.

    ``rate`` and ``spm_rate``: per cent of documents that are transformed, and of these written suffix first.
    """
    _check(sentinels)

    def make(batch: pa.RecordBatch) -> dict:
        of = lambda name: batch.column(batch.schema.get_field_index(name))
        return transform(of(text_col), of(id_col).to_pylist(), units, rate, spm_rate, seed, sentinels)

    return _adding(docs, ADDS, make)


def restore(df: DataFrame, sentinels: tuple[str, str, str] = SENTINELS, output_col: str = "output", form_col: str = "form", restored_col: str = "restored") -> DataFrame:
    """``df`` with the text that each output stands for."""

    def make(batch: pa.RecordBatch) -> dict:
        of = lambda name: batch.column(batch.schema.get_field_index(name))
        return {restored_col: rebuild(of(output_col), of(form_col).to_pylist(), sentinels)}

    return _adding(df, [(restored_col, T.StringType())], make)


def op12_fill_middle(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = fill_middle(docs).drop("text")
    made = restore(made)
    sha = lambda c: F.sha2(c, 256).alias(f"{c}_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))


OP12_SQL = r"""
with lined as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as lines,
         sha256('7:' || coalesce(doc_id::varchar, '')) as d from documents),
drawn as (
  select *, len(lines) as n, ('0x' || d[1:8])::bigint as h1, ('0x' || d[9:16])::bigint as h2,
         ('0x' || d[17:24])::bigint as h3, ('0x' || d[25:32])::bigint as h4 from lined),
placed as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as lo, greatest(h1 % (n + 1), h2 % (n + 1)) as hi,
         case when text = '' or regexp_matches(text, '<[PSM]>') or h3 % 100 >= 100 then 'plain'
              when h4 % 100 < 50 then 'spm' else 'psm' end as form from drawn),
parted as (
  select *, array_to_string(lines[1:lo], '') as prefix, array_to_string(lines[lo + 1:hi], '') as middle,
         array_to_string(lines[hi + 1:], '') as suffix from placed)
select doc_id, n::bigint as n, form,
       case when form <> 'plain' then length(prefix) end as prefix_chars,
       case when form <> 'plain' then length(middle) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256
from parted
"""
