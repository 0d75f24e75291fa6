"""BPE encoding and decoding.

The encoder finds the exact merge result without replaying merges. An Aho-Corasick automaton
over the vocabulary gives the longest token that starts at each byte; a stack of tokens grows
by the longest candidate that is *compatible* with the token before it, falls back to shorter
prefixes, and backtracks past positions known to be dead ends. A pair of tokens is compatible
if the merge rules, applied to their joined bytes, never merge across the border, so a chain of
compatible pairs is the merge result. Each position is declared dead at most once, hence the
time is linear in the piece.

The decoder copies bytes out of one blob of all tokens by an offset table.

Defined results: a null text counts as empty; an empty text has no ids (digest of no bytes) and
decodes to the empty text; a very long text is encoded whole, in linear time; of merges of equal rank (ties) the leftmost comes
first, as in the library; repeated rows give repeated rows; an empty table gives an empty one;
other columns are ignored. Memory: a worker holds the tables and a piece cache of at most
``CACHE`` entries of at most ``CACHE_PIECE`` characters, which is emptied when full.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from driftsum.llm.text import slices
from driftsum.session import small_batches, table

#: The pre-tokenisation pattern of byte-level BPE.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 200_000
CACHE_PIECE = 64
_NEVER = 1 << 62


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Tables of one byte-level BPE file and the functions on them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token).decode("latin-1")
        ids = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merge: dict[tuple[int, int], int] = {}  # pair of ids -> rank
        self.parts: dict[int, tuple[int, int, int]] = {}  # id -> left, right, rank
        for rank, (a, b) in enumerate(merges):
            a, b = raw(a), raw(b)
            left, right, whole = ids[a], ids[b], ids[a + b]
            self.merge.setdefault((left, right), rank)
            if max(self.rank(left), self.rank(right)) > rank:
                raise ValueError("merge rules must come after the rules that build their parts")
            self.parts.setdefault(whole, (left, right, rank))
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*ids.values(), *self.added.values()])
        tokens = [b""] * size
        for k, v in ids.items():
            tokens[v] = k.encode("latin-1")
        for k, v in self.added.items():
            tokens[v] = k.encode()
        self.length = [len(t) for t in tokens]
        # only tokens that their own merges rebuild take part
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._pairs: dict[int, bool] = {}
        self.ids = {k: v for k, v in ids.items() if v not in self.parts or self.compatible(*self.parts[v][:2], self.parts[v][2])}
        self._pairs.clear()
        self.shorter = [-1] * size  # the longest token that is a proper prefix
        for k, v in self.ids.items():
            self.shorter[v] = next((self.ids[k[:n]] for n in range(len(k) - 1, 0, -1) if k[:n] in self.ids), -1)
        self.automaton = ahocorasick.Automaton()
        for k, v in self.ids.items():
            self.automaton.add_word(k, (len(k), v))
        self.automaton.make_automaton()
        self.pieces = regex.compile(PIECES)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.cache: dict[str, bytes] = {}

    def rank(self, token: int) -> int:
        return self.parts[token][2] if token in self.parts else -1

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts of ``token`` at one border, outermost first, each with the rank at which it is used up."""
        out, used = [], _NEVER
        while True:
            out.append((token, used))
            if token not in self.parts:
                return out
            used, token = self.parts[token][2], self.parts[token][side]

    def compatible(self, a: int, b: int, own: int = _NEVER) -> bool:
        """No merge crosses the border of a and b, other than one of rank ``own``.

        A part of a and a part of b that touch are merged at rank m if both still exist then: the left
        one must not be used up at m or before it, the right one not before m (merges of one rank run
        from left to right).
        """
        key = a << 32 | b
        known = self._pairs.get(key)
        if known is None:
            right = self._right.get(a) or self._right.setdefault(a, self._spine(a, 1))
            left = self._left.get(b) or self._left.setdefault(b, self._spine(b, 0))
            get = self.merge.get
            known = True
            for x, x_used in right:
                for y, y_used in left:
                    m = get((x, y))
                    if m is not None and m < own and m < x_used and m <= y_used:
                        known = False
                        break
                if not known:
                    break
            if len(self._pairs) >= 2 * CACHE:
                self._pairs.clear()
            self._pairs[key] = known
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece, given as the Latin-1 reading of its UTF-8 bytes."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [-1] * n
        for end, (size, token) in self.automaton.iter(piece):
            longest[end - size + 1] = token  # later ends are longer
        dead = bytearray(n + 1)
        length, shorter, compatible = self.length, self.shorter, self.compatible
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                if not dead[at + length[token]] and (not out or compatible(out[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                if at < n:
                    token = longest[at]
            else:
                if not out:
                    raise ValueError("a byte has no token")
                dead[at] = 1
                token = out.pop()
                at -= length[token]
        return out

    def _ids_of(self, piece: str) -> bytes:
        out = array("I", self.encode_piece(piece.encode().decode("latin-1"))).tobytes()
        if len(piece) <= CACHE_PIECE:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[piece] = out
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, little-endian unsigned 32-bit; strings of added tokens are those tokens."""
        out: list[bytes] = []
        get, make = self.cache.get, self._ids_of
        for part in self.special.split(text) if self.special else [text]:
            if part in self.added:
                out.append(self.added[part].to_bytes(4, "little"))
            elif part:
                out += [get(p) or make(p) for p in self.pieces.findall(part)]
        return np.frombuffer(b"".join(out), "<u4")


class Decoder:
    """One blob of all tokens and the offset and length of each."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        ids = {v: bytes(alphabet[c] for c in k) for k, v in spec["model"]["vocab"].items()}
        ids |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
        tokens = [ids.get(i, b"") for i in range(1 + max(ids))]
        self.sizes = np.array([*map(len, tokens)], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        if not len(sizes):
            return b""
        ends = np.cumsum(sizes)
        return self.blob[np.repeat(self.offsets[ids] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids binary): the ids of each text as little-endian unsigned 32-bit integers.

    ``path`` names a vocabulary file that every node has; without one, each task asks its own node for the default's place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path or default_vocabulary())
        for b in slices(batches):
            out = [bpe.encode(t or "").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["key", "ids"])

    small_batches(docs.sparkSession)
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, ids binary").withColumnRenamed("key", key)


def decode_documents(encoded: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """(key, ids binary, text string): the texts of binary ids; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = decoder(path or default_vocabulary())
        for b in slices(batches):
            out = [bpe.decode(np.frombuffer(x or b"", "<u4")) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["key", "ids", "text"])

    small_batches(encoded.sparkSession)
    rows = encoded.select(encoded[key].alias("key"), encoded["ids"])
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, ids binary, text string").withColumnRenamed("key", key)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    from pyspark.sql import functions as F

    out = decode_documents(encode_documents(table(spark, sf_dir, "documents")))
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: doc_id, n_tokens, the ids, and the SHA-256 of what they decode to, of every document it is given.

    Ids that do not give their text back end the job.
    """
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = default_vocabulary()
        encode, decode = encoder(place).encode, decoder(place).decode
        for b in slices(batches):
            ids, digests = [], []
            for t in b.column(1).to_pylist():
                found = encode(t or "")
                back = decode(found)
                if back != (t or ""):
                    raise ValueError("the ids of a text do not decode to it")
                ids.append(found.tobytes())
                digests.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(digests, pa.string())], ["doc_id", "ids", "decoded_sha256"])

    small_batches(spark)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, decoded_sha256 string")
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded_sha256")
