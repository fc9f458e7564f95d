"""BPE encoding with reuse of content-defined chunks."""

from __future__ import annotations

import hashlib
import os
from collections import Counter
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetlife.llm.common import on_texts

WINDOW = 16  # bytes that the rolling hash sees
CHUNK_BITS = 10  # a chunk has about 2 ** CHUNK_BITS bytes
REMEMBERED_WORDS = 250_000  # words whose ids a task remembers
REMEMBERED_CHUNKS = 16 << 20  # bytes of repeated chunks that it remembers
REMEMBERED_HASHES = 300_000  # hashes of chunks that it has met once
BLOCK = 64
TO_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def rolling_hash(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each byte, a 32-bit hash of the ``window`` (a power of two) bytes that end there."""
    h = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    span, factor = 1, np.uint32(0x85EBCA6B)
    while span < window:
        h[span:] = h[span:] + h[:-span] * factor
        span, factor = 2 * span, np.uint32(int(factor) ** 2 & 0xFFFFFFFF)
    h ^= h >> np.uint32(16)
    return h


def cut_points(data: bytes, bits: int = CHUNK_BITS) -> list[int]:
    """Where chunks start: white space after which the rolling hash of the preceding bytes has ``bits`` zero bits at
    its low end, counting only hashes at white space (one byte in six or so); they depend on nothing but these bytes."""
    raw = np.frombuffer(data, np.uint8)
    space = (raw == 32) | (raw == 10) | (raw == 9) | (raw == 13)
    low = np.uint32((1 << max(0, bits - 3)) - 1)
    at = np.flatnonzero(space[1:] & ((rolling_hash(raw)[:-1] & low) == 0)) + 1 if len(raw) > 1 else np.empty(0, np.int64)
    return at.tolist()


def split_words(chunk: bytes) -> list[str]:
    """Its words. Only ASCII white space separates them: it never takes part in a token or in normalisation."""
    words = chunk.translate(TO_SPACE).decode("utf-8", "surrogatepass").split(" ")
    return [w for w in words if w] if "" in words else words


@dataclass
class ChunkEncoder:
    """Encodes texts piece by piece; every distinct chunk is encoded once while it is remembered.

    The result equals encoding each whole text. A text is cut at content-defined points, so passages that documents
    share give equal chunks wherever they stand. A new chunk goes through its white-space separated words, which are
    remembered as well, and only new words meet the tokenizer, many in one call. Then each chunk join is checked: the
    words on its two sides are encoded together. Where that differs from the ids of the parts, the two chunks are merged
    and re-encoded and the joins of the merged stretch are looked at again, until all agree.

    It needs a tokenizer that drops white space, which is checked.
    """

    tokenizer: Tokenizer
    bits: int = CHUNK_BITS
    most_words: int = REMEMBERED_WORDS
    most_chunk_bytes: int = REMEMBERED_CHUNKS
    words: dict[str, tuple[bytes, str]] = field(default_factory=dict)
    chunks: dict[bytes, tuple[bytes, str, str | None, str | None]] = field(default_factory=dict)
    joins: dict[tuple[str, str], bool] = field(default_factory=dict)
    met: set[int] = field(default_factory=set)
    held: int = 0
    encoded_chunks: int = 0
    reused_chunks: int = 0
    repaired: int = 0

    def __post_init__(self) -> None:
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.model._resize_cache(0)  # words are remembered here
        if self.plain(["a b", " a\n"]) != [sum(self.plain(["a", "b"]), []), self.plain(["a"])[0]]:
            raise ValueError("the tokenizer must drop white space")
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.token = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.token[i] = name
        ends = [name for name, added in ((t.content, t) for t in self.tokenizer.get_added_tokens_decoder().values())
                if not (added.lstrip or added.rstrip or added.single_word)]
        self.stop = ends[-1] if ends else None
        self.stop_id = names[self.stop] if self.stop else -1

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _entry(self, ids: list[int]) -> tuple[bytes, str]:
        return np.array(ids, "<u4").tobytes(), " ".join([self.token[i] for i in ids])

    def _learn(self, new: list[str]) -> None:
        """Encode words not met before. Added tokens are split off before anything else happens to a text, so words with
        one between them are encoded as if alone, in one call for a block of words."""
        if self.stop:
            alone = [w for w in new if self.stop in w]
            tied = [w for w in new if self.stop not in w]
        else:
            alone, tied = new, []
        blocks = [tied[i : i + BLOCK] for i in range(0, len(tied), BLOCK)]
        for block, ids in zip(blocks, self.plain([self.stop.join(b) for b in blocks]) if blocks else [], strict=True):
            start, parts = 0, []
            for at, i in enumerate(ids):
                if i == self.stop_id:
                    parts.append(ids[start:at])
                    start = at + 1
            parts.append(ids[start:])
            self.words.update((w, self._entry(p)) for w, p in zip(block, parts, strict=True))
        self.words.update((w, self._entry(ids)) for w, ids in zip(alone, self.plain(alone), strict=True))

    def _combine(self, words: list[str]) -> tuple[bytes, str]:
        entries = [self.words[w] for w in words]
        return b"".join([e[0] for e in entries]), " ".join([e[1] for e in entries if e[1]])

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian unsigned 32-bit integers, and the decoded text."""
        cut = []
        for text in texts:
            data = (text or "").encode("utf-8", "surrogatepass")
            at = [0, *cut_points(data, self.bits), len(data)]
            cut.append([data[a:b] for a, b in zip(at, at[1:], strict=False) if b > a])
        new = list(dict.fromkeys(c for parts in cut for c in parts if c not in self.chunks))
        split = {c: split_words(c) for c in new}
        self._learn(list({w for words in split.values() for w in words if w not in self.words}))
        here = {c: (*self._combine(words), words[0] if words else None, words[-1] if words else None) for c, words in split.items()}
        known = here | {c: self.chunks[c] for parts in cut for c in parts if c in self.chunks}
        self.encoded_chunks += len(new)
        self.reused_chunks += sum(map(len, cut)) - len(new)
        self._check_joins(cut, known)
        out = [self._join(parts, known) for parts in cut]
        self._remember(here, Counter(c for parts in cut for c in parts))
        if len(self.words) > self.most_words:  # go on with the vocabulary of the latest texts
            self.words = {w: self.words[w] for words in split.values() for w in words}
        return out

    def _remember(self, here: dict[bytes, tuple], times: Counter) -> None:
        """Keep the chunks that have come up before or more than once now; of the others keep a hash. Most chunks are never
        met again, so what is remembered are the passages that documents share."""
        if self.held > self.most_chunk_bytes:
            self.chunks, self.held = {}, 0
        if len(self.met) > REMEMBERED_HASHES:
            self.met.clear()
        for chunk, entry in here.items():
            number = hash(chunk)
            if times[chunk] > 1 or number in self.met:
                self.chunks[chunk] = entry
                self.held += len(chunk) + len(entry[0]) + len(entry[1]) + 300
            else:
                self.met.add(number)

    @staticmethod
    def _ends(parts: list[bytes], known: dict[bytes, tuple]) -> list[tuple[str, str]]:
        """Pairs (last word, first word) at the joins between chunks that hold words."""
        filled = [e for e in map(known.__getitem__, parts) if e[2] is not None]
        return [(a[3], b[2]) for a, b in zip(filled, filled[1:], strict=False)]

    def _check_joins(self, cut: list[list[bytes]], known: dict[bytes, tuple]) -> None:
        """Encode both words of every join together and note whether their ids stay as they are."""
        new = list({j for parts in cut if len(parts) > 1 for j in self._ends(parts, known)})
        self.joins = {}
        lacking = list({w for j in new for w in j if w not in self.words})
        self._learn(lacking)
        for start in range(0, len(new), 4096):
            part = new[start : start + 4096]
            for join, ids in zip(part, self.plain([f"{a} {b}" for a, b in part]), strict=True):
                self.joins[join] = np.array(ids, "<u4").tobytes() == self.words[join[0]][0] + self.words[join[1]][0]

    def _join(self, parts: list[bytes], known: dict[bytes, tuple]) -> tuple[bytes, str]:
        entries = [known[p] for p in parts]
        if all(self.joins[j] for j in self._ends(parts, known)):
            ids, decoded = b"".join([e[0] for e in entries]), " ".join([e[1] for e in entries if e[1]])
        else:
            self.repaired += 1
            ids, decoded = self._repair(parts)
        if self.tokenizer.decoder is not None:
            decoded = self.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        return ids, decoded

    def _repair(self, parts: list[bytes]) -> tuple[bytes, str]:
        """Merge chunks across each join that disagrees, re-encode the merged stretch, and look at its own joins again,
        until all agree; in the end that is the whole text."""
        def merge(stretch: list[bytes]) -> tuple[bytes, list[int]]:
            data = b"".join(stretch)
            return data, self.plain([data.decode("utf-8", "surrogatepass")])[0]

        state = [merge([p]) for p in parts]
        at = 0
        while at + 1 < len(state):
            (left, left_ids), (right, right_ids) = state[at], state[at + 1]
            both, ids = merge([left, right])
            if ids == left_ids + right_ids:
                at += 1
            else:
                state[at : at + 2] = [(both, ids)]
                at = max(0, at - 1)
        return self._entry([i for _, ids in state for i in ids])


@cache
def _encoder(path: str) -> ChunkEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
    return ChunkEncoder(Tokenizer.from_file(path))


def encode_digests(text: str | Column, tokenizer: str | None = None) -> Column:
    """A struct (n_tokens, ids_sha256, decoded_sha256) of the whole text; null counts as empty.

    ``tokenizer`` is a file that all executors have; by default the public word BPE of 49k entries. Decoding joins the
    tokens by a space, which is what a tokenizer without a decoder does. What is remembered lives in a Python worker,
    within fixed limits, so memory does not grow with the corpus.
    """
    def make():
        if tokenizer is None:
            import public_tokenizers

            coder = _encoder(public_tokenizers.path("word_bpe_49k.json"))
        else:
            coder = _encoder(tokenizer)

        def work(texts: list[str | None]) -> dict[str, list]:
            out = coder.encode(texts)
            return {"n_tokens": [len(ids) // 4 for ids, _ in out],
                    "ids_sha256": [hashlib.sha256(ids).hexdigest() for ids, _ in out],
                    "decoded_sha256": [hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest() for _, d in out]}

        return work

    schema = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return on_texts(make, schema)(F.col(text) if isinstance(text, str) else text)
