"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the characters of a text cuts it into chunks wherever the hash of the last ``WINDOW`` characters has
``CUT_BITS`` zero bits, so passages that documents share are cut alike wherever they stand. Chunks are looked up first, by 128-bit
digests, and only new ones are encoded, however many documents hold them: a text of known chunks costs no more than cutting it
and its joins. What is kept of a chunk is its core, the text from its first to its last sure boundary (``units.SYNC``, where every
tokenisation of this family ends a token), because cutting at arbitrary characters makes tokens near a chunk's ends wrong.

Joins are repaired by encoding the text between two cores anew, together with the last unit of the left core and the first of the
right one (a unit is a word with the space before it). The library's tokens for these two units have to be those the cores have;
where they are not, the window widens, to the whole text at last. Where they are, both encodings agree, and so does what lies beyond.

New cores are encoded from the memo of their units, and only units never seen reach the tokenizer library: many stand one after
another in one text, since a unit's end before white space is a sure boundary, and the bytes of the tokens tell whose they are. All stores
are bounded (``MEMO_UNITS``, ``MEMO_CHUNKS``) and local to a worker: nothing is shuffled, a lost executor costs its own tasks only.

Defined results: a null text counts as empty (no tokens, empty decoded text); very long texts are processed chunk by
chunk; an empty table gives an empty result; other columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import append
from .units import LONGEST_KEY, SYNC, UNIT, Memo, held

WINDOW_DOUBLINGS = 4  # a window of 16 characters
CUT_BITS = 10  # chunks of about 1,000 characters beyond the least length
LEAST, MOST = 256, 8192
MEMO_UNITS = 480_000
#: Units never seen are encoded as texts of so many.
TOGETHER = 1_024
MEMO_CHUNKS = 5_000
_MULTIPLIER = 0x9E3779B1


def chunk_ends(text: str) -> list[int]:
    """End positions of the content-defined chunks of ``text``, in characters."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = (codes + np.uint32(1)) * np.uint32(0x85EBCA6B)
    factor, width = _MULTIPLIER, 1
    for _ in range(WINDOW_DOUBLINGS):
        longer = h.copy()
        longer[width:] += h[:-width] * np.uint32(factor)
        h, factor, width = longer, factor * factor & 0xFFFFFFFF, width * 2
    cuts = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    ends, start = [], 0
    for cut in [*cuts.tolist(), n]:
        while cut - start > MOST:
            start += MOST
            ends.append(start)
        if cut - start >= LEAST or cut == n:
            ends.append(cut)
            start = cut
    return ends if ends[-1] == n else [*ends, n]


def sure_ends(chunk: str) -> tuple[int, int]:
    """The first and the last sure boundary inside a chunk; (0, 0) if it has none."""
    first = SYNC.search(chunk)
    if first is None:
        return 0, 0
    for at in range(len(chunk) - 1, first.start(), -1):
        if SYNC.match(chunk, at):
            return first.start(), at
    return first.start(), first.start()


class ChunkEncoder:
    """Encodes texts as ``tokenizers.Tokenizer.encode(text, add_special_tokens=False)`` does."""

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and threads keep memory of their own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.units: Memo = Memo(MEMO_UNITS)
        self.chunks: Memo = Memo(MEMO_CHUNKS)
        surfaces = self._surfaces()
        self.surface = np.empty(len(surfaces), object)
        self.surface[:] = surfaces
        self.n_bytes = np.array([len(s) for s in surfaces], np.int64)
        self.chunks_seen = self.chunks_encoded = self.widened = 0

    def _surfaces(self) -> list[bytes]:
        """The bytes each id stands for. Byte-level vocabularies write bytes as printable characters."""
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        alphabet = {chr(b): b for b in printable}
        alphabet |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        out = [b""] * (max(self.tokenizer.get_vocab().values()) + 1)
        for token, i in self.tokenizer.get_vocab().items():
            plain = token in special or any(c not in alphabet for c in token)
            out[i] = token.encode() if plain else bytes(alphabet[c] for c in token)
        return out

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        """The library's ids of each text; it is not asked for offsets."""
        return [np.array(enc.ids, np.uint32) for enc in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, cores: list[list[str]]) -> None:
        """Encode all units of ``cores`` that the memo lacks, many in one text. Each starts with white space and ends with something else."""
        units, missing = self.units, set()
        for core in cores:
            missing.update(core)
        fresh = [u for u in units.lacking(missing) if len(u) <= LONGEST_KEY]
        for at in range(0, len(fresh), TOGETHER):
            part = fresh[at : at + TOGETHER]
            (ids,) = self._ids(["".join(part)])
            token_ends = np.cumsum(self.n_bytes[ids])
            unit_ends = np.cumsum([len(u.encode("utf-8", "surrogatepass")) for u in part])
            last = np.searchsorted(token_ends, unit_ends)
            if last[-1] == len(ids) - 1 and np.array_equal(token_ends[last], unit_ends):
                raw, ends = ids.tobytes(), ((last + 1) * 4).tolist()
                units.update(zip(part, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=True))
            else:  # a library whose tokens do not end where units do
                units.update(zip(part, (i.tobytes() for i in self._ids(part)), strict=True))

    def _encode(self, found: list[str]) -> bytes:
        """Little-endian 32-bit ids of units that follow each other."""
        units = self.units
        try:
            return b"".join(map(units.__getitem__, found))
        except KeyError:
            return b"".join(units[u] if u in units else self._unit(u) for u in found)

    def _unit(self, unit: str) -> bytes:
        if (got := self.units.recall(unit)) is None:
            got = np.array(self.tokenizer.encode(unit, add_special_tokens=False).ids, np.uint32).tobytes()
            if len(unit) <= LONGEST_KEY:
                self.units[unit] = got
        return got

    def _known(self, text: str, fresh: list[tuple[bytes, str]]) -> list[tuple[int, int, list]]:
        """(start, end, what is kept of it) of the cores of a text's chunks; cores never seen are added to ``fresh``."""
        found, start = [], 0
        for end in chunk_ends(text):
            chunk = text[start:end]
            key = hashlib.blake2b(chunk.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            self.chunks_seen += 1
            kept = self.chunks.get(key) or self.chunks.recall(key)
            if kept is None:
                self.chunks_encoded += 1
                head, last = sure_ends(chunk)
                kept = self.chunks[key] = [head, last, None, "", ""]  # ids and the first and last unit follow
                if head < last:
                    fresh.append((key, chunk[head:last]))
            if kept[0] < kept[1]:
                found.append((start + kept[0], start + kept[1], kept))
            start = end
        return found

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian 32 bits."""
        self.units.turn()
        self.chunks.turn()
        fresh: list[tuple[bytes, str]] = []
        cores = [self._known(t, fresh) for t in texts]
        entries = [self.chunks[key] for key, _ in fresh]
        split = [UNIT.findall(core) for _, core in fresh]
        self.learn(split)
        for entry, units in zip(entries, split, strict=True):
            entry[2:] = self._encode(units), units[0], units[-1]
        windows, places = [], []  # the text around each join
        for k, (text, own) in enumerate(zip(texts, cores, strict=True)):
            for j in range(len(own) + 1 if text else 0):
                left, right = own[j - 1] if j else None, own[j] if j < len(own) else None
                lo = left[1] - len(left[2][4]) if left else 0
                hi = right[0] + len(right[2][3]) if right else len(text)
                windows.append(text[lo:hi])
                places.append((k, left, right))
        out: list[list[bytes]] = [[] for _ in texts]
        agreed = [True] * len(texts)
        for at in range(0, len(windows), 4096):
            for ids, (k, left, right) in zip(self._ids(windows[at : at + 4096]), places[at : at + 4096], strict=True):
                ids = ids.tobytes()
                before = self._encode([left[2][4]]) if left else b""
                after = self._encode([right[2][3]]) if right else b""
                agreed[k] &= ids.startswith(before) and ids.endswith(after) and len(ids) >= len(before) + len(after)
                out[k].append(ids[len(before) : len(ids) - len(after)])
                if right:
                    out[k].append(right[2][2])
        for k, same in enumerate(agreed):
            if not same:
                self.widened += 1
                out[k] = [np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, np.uint32).tobytes()]
        return [b"".join(x) for x in out]

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: bytes) -> str:
        return b"".join(self.surface[np.frombuffer(ids, np.uint32)].tolist()).decode("utf-8", "replace")


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder; it outlives a task because Spark reuses Python workers."""
    return held(f"encoder {path}", lambda: ChunkEncoder(path))


def encode_documents(
    docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", digest: bool = False
) -> DataFrame:
    """All input columns and ``ids_col`` (array<int>), ``decoded_col`` (string) and n_tokens (long).

    With ``digest`` these two hold the SHA-256 of the ids (little-endian 32 bits) and of the decoded UTF-8 instead, and the
    text is left out.
    """

    def run(texts: list[str | None]) -> dict[str, list]:
        coder = encoder(tokenizer_path)
        ids = coder.encode_batch([t or "" for t in texts])
        n_tokens = [len(i) // 4 for i in ids]
        if digest:
            back = [hashlib.sha256(coder.decode(i).encode()).hexdigest() for i in ids]
            return {ids_col: [hashlib.sha256(i).hexdigest() for i in ids], decoded_col: back, "n_tokens": n_tokens}
        return {ids_col: [np.frombuffer(i, np.int32) for i in ids], decoded_col: [coder.decode(i) for i in ids], "n_tokens": n_tokens}

    shown = (T.StringType(), pa.string()) if digest else (T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))
    adds = [(ids_col, *shown), (decoded_col, T.StringType(), pa.string()), ("n_tokens", T.LongType(), pa.int64())]
    return append(docs, run, [text_col], adds, drop=(text_col,) if digest else ())


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode_documents(docs, tokenizer_file("byte_bpe_50k.json"), digest=True, ids_col="ids_sha256", decoded_col="decoded_sha256")
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
