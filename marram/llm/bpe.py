"""Byte-level BPE encoding and decoding of document texts.

A word is merged with a priority queue of merge ranks over a doubly linked list
of symbols: the lowest rank, leftmost first, is popped, entries whose pair no
longer stands there are skipped, and the two new neighbouring pairs are pushed.
Decoding concatenates the vocabulary's byte strings.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_runs, table

VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: the split pattern of byte-level BPE vocabularies of this kind.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same split for texts whose characters are all ASCII (without the rare controls) or Latin letters.
LATIN = "A-Za-zÀ-ÖØ-öø-ƺƼ-ƿǄ-ɏ"
UNUSUAL = re.compile(f"[^\\x00-\\x1b\\x20-\\x7e{LATIN}]")
PLAIN = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{LATIN}]+| ?[0-9]+| ?[^\\s0-9{LATIN}]+|\\s+(?!\\S)|\\s+")
#: Words of at most this many characters are remembered, so many per generation and worker; and how many where a worker does nothing else.
REMEMBERED_LENGTH, REMEMBERED, REMEMBERED_ALONE = 48, 80_000, 400_000
COMPOUND_LENGTH = 5
#: A blank before further white space: blanks then don't separate pieces by themselves.
BLANK_RUN = re.compile(r" \s")
#: Characters of text that are encoded at a time.
CHUNK = 1 << 20


def vocabulary_path(name: str) -> str:
    """A file of that name among the public tokenizers, or ``name`` itself if it is a path."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """Letter to byte: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Words(dict):
    """Text between two blanks to the little-endian ids of its subwords.

    Two generations of bounded size; ``lead`` is a blank for all but a text's
    first words. Only single pieces and short compounds are remembered.
    """

    def __init__(self, coder: BytePairs, lead: str, most: int = REMEMBERED):
        super().__init__()
        self.coder, self.lead, self.most, self.older = coder, lead, most, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            pieces = self.coder.split(self.lead + word)
            if len(pieces) > 1:
                found = self.coder.join(pieces)
                if len(word) > COMPOUND_LENGTH:
                    return found
            else:
                found = self.coder.encode_piece(pieces[0]) if pieces else b""
        if len(word) <= REMEMBERED_LENGTH:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


class BytePairs:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.of_byte = [0] * 256
        for letter, byte in letters.items():
            self.of_byte[byte] = vocab[letter]
        self.pieces = [b""] * (1 + max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])]))
        for piece, i in vocab.items():
            self.pieces[i] = bytes(letters[c] for c in piece)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for content, i in self.special.items():
            self.pieces[i] = content.encode()
        self.rank, self.made = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << 20 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.first, self.spaced = Words(self, "", remembered), Words(self, " ", remembered)

    def merge(self, ids: list[int]) -> list[int]:
        """The ids after all merges."""
        n, rank_of, made = len(ids), self.rank.get, self.made
        bits = n.bit_length()
        last = (1 << bits) - 1
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [rank << bits | i for i, rank in enumerate([rank_of(a << 20 | b) for a, b in zip(ids, ids[1:], strict=False)]) if rank is not None]
        heapq.heapify(queue)
        while queue:
            top = heapq.heappop(queue)
            i, rank = top & last, top >> bits
            j = after[i]
            if j >= n or ids[i] < 0 or rank_of(ids[i] << 20 | ids[j]) != rank:
                continue  # stale
            own = ids[i] = made[rank]
            ids[j] = -1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                follow = rank_of(own << 20 | ids[j])
                if follow is not None:
                    heapq.heappush(queue, follow << bits | i)
            h = before[i]
            if h >= 0:
                lead = rank_of(ids[h] << 20 | own)
                if lead is not None:
                    heapq.heappush(queue, lead << bits | h)
        return [x for x in ids if x >= 0]

    def encode_piece(self, piece: str) -> bytes:
        ids = [self.of_byte[b] for b in piece.encode()]
        return np.array(self.merge(ids) if len(ids) > 1 else ids, dtype="<u4").tobytes()

    def split(self, text: str) -> list[str]:
        return (PATTERN if UNUSUAL.search(text) else PLAIN).findall(text)

    def join(self, pieces: list[str]) -> bytes:
        return b"".join([self.spaced[x[1:]] if x[0] == " " and len(x) > 1 and x[1] != " " else self.first[x] for x in pieces])

    def encode_plain(self, text: str) -> bytes:
        """A piece never holds a blank after another character, so a text falls apart at its blanks unless they stand beside other white space."""
        if BLANK_RUN.search(text):
            return self.join(self.split(text))
        head, *rest = text.split(" ")
        return self.first[head] + b"".join(map(self.spaced.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit integers."""
        if self.split_special is None or not any(x in text for x in self.special):
            return self.encode_plain(text)
        parts = [(x, self.special.get(x)) for x in self.split_special.split(text)]
        return b"".join([self.encode_plain(x) if i is None else np.array([i], dtype="<u4").tobytes() for x, i in parts])

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text that the ids spell; ids that spell no valid UTF-8 give U+FFFD for what is invalid."""
        data = b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return data.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def load(name: str, remembered: int = REMEMBERED) -> BytePairs:
    """One encoder for each vocabulary and worker process."""
    return BytePairs(vocabulary_path(name), remembered)


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, keep: bool = True, remembered: int = REMEMBERED) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` and, with ``keep``, ids and decoded.

    ``ids`` is an array of integers and ``decoded`` the text that they spell.
    A null text counts as empty: no tokens, and digests of no bytes. The
    vocabulary file must be readable on every executor. Other columns are
    ignored; rows keep their multiplicity.
    """
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(vocabulary, remembered)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for i, j in bounded_runs([len(x) for x in texts], CHUNK):
                known: dict[str, tuple[bytes, bytes]] = {}
                for x in texts[i:j]:
                    if x not in known:
                        ids = coder.encode(x)
                        known[x] = ids, coder.decode(ids)
                rows = [known[x] for x in texts[i:j]]
                out = [
                    batch.column(0).slice(i, j - i),
                    pa.array([len(a) // 4 for a, _ in rows], pa.int64()),
                    pa.array([hashlib.sha256(a).hexdigest() for a, _ in rows], pa.string()),
                    pa.array([hashlib.sha256(b).hexdigest() for _, b in rows], pa.string()),
                ]
                if keep:
                    out += [pa.array([np.frombuffer(a, dtype="<u4").astype(np.int32) for a, _ in rows], pa.list_(pa.int32())), pa.array([b.decode() for _, b in rows], pa.string())]
                yield pa.RecordBatch.from_arrays(out, names)

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep
    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text's ids and of what they decode to.

    Null and empty texts have no tokens and the digests of no bytes; repeated
    rows keep their rows; an empty table gives no rows.
    """
    return encode_texts(table(spark, sf_dir, "documents"), keep=False, remembered=REMEMBERED_ALONE)
