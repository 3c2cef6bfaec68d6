"""Token ids of whole texts by the tokenizers library, piece by piece with a cache, and checksums of id ranges."""

from __future__ import annotations

import os
import re
import zlib

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Most pieces whose ids a Python worker keeps, and bytes of text that it looks at together.
CACHE_PIECES, CHUNK_BYTES = 3_000_000, 2 << 20
#: Bytes from which two pieces are compared one pair at a time.
LONG_PIECE = 64
#: White space beyond ASCII: texts that hold some are encoded as a whole.
WIDE_SPACE = re.compile("[\x85\xa0  -     　]")
#: A piece that is one word of plain letters: many of these can be encoded in one text.
PLAIN = re.compile("[ ]?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range: a polynomial over random byte values, mixed at the end.

    Prefix sums give every range in constant time: (P[end] - P[start]) * base^-start modulo 2^64. Such polynomials have
    collisions by construction (Thue-Morse words), so callers compare the bytes of what the hash calls equal.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    n = len(raw)
    power, inverse = _powers(n + 1)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[raw] * power[:n], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * inverse[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def padded(*parts: bytes) -> np.ndarray:
    """The joined bytes with eight more behind them, so that eight can be read at every place."""
    return np.frombuffer(b"".join([*parts, bytes(8)]), dtype=np.uint8)


def same_bytes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the ``n`` bytes at each place of two padded arrays are equal: eight at a time, long ones by themselves."""
    at_once = [np.ndarray(shape=(len(x) - 7,), dtype="<u8", buffer=x, strides=(1,)) for x in (a, b)]
    equal = np.ones(len(n), dtype=bool)
    live, k = np.arange(len(n)), 0
    while len(live) and k < LONG_PIECE:
        left = n[live] - k
        differ = at_once[0][a_at[live] + k] ^ at_once[1][b_at[live] + k]
        short = left < 8
        differ[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
        equal[live[differ != 0]] = False
        k += 8
        live = live[left > 8]
    for i in live.tolist():
        equal[i] &= a[a_at[i] : a_at[i] + n[i]].tobytes() == b[b_at[i] : b_at[i] + n[i]].tobytes()
    return equal


_BYTE_VALUES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_UNBASE = pow(_BASE, -1, 1 << 64)
_POWERS: tuple[np.ndarray, np.ndarray] = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for base in (_BASE, _UNBASE):
            p = np.ones(size, dtype=np.uint64)
            p[1:] = np.uint64(base)
            made.append(np.cumprod(p))
        _POWERS = (made[0], made[1])
    return _POWERS


def _bytes_of(*ranges: tuple[int, int]) -> np.ndarray:
    found = np.zeros(256, dtype=bool)
    for a, b in ranges:
        found[a : b + 1] = True
    return found


_SPACE = _bytes_of((9, 13), (32, 32))
_LETTER = _bytes_of((65, 90), (97, 122))
_MARK = _bytes_of(*[(ord(c), ord(c)) for c in ".,!?;:|#$%&*)"])
#: Second bytes of two-byte letters that begin with 0xC3.
_TAIL = _bytes_of((0x80, 0x96), (0x98, 0xB6), (0xB8, 0xBF))


def piece_starts(raw: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of pieces in joined texts (that start at ``first``): where white space begins, where a single white-space
    character other than a space ends, and where plain punctuation follows a letter. No token crosses these places. A longer
    run of white space stays with what follows: a tokenizer may split off its last character before a word, but not at the end."""
    space = _SPACE[raw]
    begins = np.zeros(len(raw), dtype=bool)
    begins[1:] = space[1:] & ~space[:-1]
    single = space.copy()
    single[1:] &= ~space[:-1]
    begins[1:] |= ~space[1:] & single[:-1] & (raw[:-1] != 32)
    letter = _LETTER[raw]
    letter[1:] |= _TAIL[raw[1:]] & (raw[:-1] == 0xC3)
    begins[1:] |= _MARK[raw[1:]] & letter[:-1]
    begins[first] = True
    return np.flatnonzero(begins)


class PieceEncoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does, for tokenizers whose tokens never cross the
    starts of ``piece_starts``.

    Both public byte-pair tokenizers are such: they split texts into white space, letters, digits and other characters,
    with at most one space before, and merge only within these. Equal pieces of a chunk are found by 64-bit hash and encoded
    once; pieces seen before come from sorted arrays of hashes and ids, bounded by ``CACHE_PIECES``. The bytes of
    every piece are compared with those that its hash stands for; a text with a piece that differs is encoded as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        #: Strings that the library looks for before anything else: texts that hold one are encoded as a whole.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.offsets = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int32)
        self.pool = np.zeros(0, dtype=self.kind)
        self.used = 0
        self.bytes_at = np.zeros(0, dtype=np.int64)
        self.bytes_n = np.zeros(0, dtype=np.int64)
        self.raw = np.zeros(8, dtype=np.uint8)
        self.raw_used = 0

    def _whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind)

    def _new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, their lengths). Plain words go through the library in one text, one word a line."""
        plain = [i for i, p in enumerate(pieces) if PLAIN.fullmatch(p)]
        ids: list[np.ndarray] = [np.zeros(0, dtype=self.kind)] * len(pieces)
        others = set(range(len(pieces)))
        if plain:
            done = self.tokenizer.encode("\n" + "\n".join([pieces[i] for i in plain]), add_special_tokens=False)
            of, got = np.asarray(done.word_ids), np.asarray(done.ids, dtype=self.kind)
            count = int(of[-1]) + 1 if len(of) else 0
            step = count // len(plain)
            if count == step * len(plain) and step in (1, 2):  # a line feed is a token of its own, or none
                wanted = np.arange(len(plain)) * step + step - 1
                lo, hi = np.searchsorted(of, wanted).tolist(), np.searchsorted(of, wanted, side="right").tolist()
                for i, a, b in zip(plain, lo, hi, strict=True):
                    ids[i] = got[a:b]
                others -= set(plain)
        rest = sorted(others)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            ids[i] = np.asarray(e.ids, dtype=self.kind)
        return np.concatenate(ids), np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        if len(self.hashes) + len(pieces) > CACHE_PIECES:
            self._forget()
        raw = [p.encode("utf-8") for p in pieces]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        more = int(sizes.sum())
        if self.raw_used + more + 8 > len(self.raw):
            grown = np.zeros(max(2 * len(self.raw), self.raw_used + more + 8), dtype=np.uint8)
            grown[: self.raw_used] = self.raw[: self.raw_used]
            self.raw = grown
        self.raw[self.raw_used : self.raw_used + more] = np.frombuffer(b"".join(raw), dtype=np.uint8)
        raw_at = self.raw_used + np.cumsum(sizes) - sizes
        self.raw_used += more
        ids, lengths = self._new(pieces)
        if self.used + len(ids) > len(self.pool):
            grown = np.zeros(max(2 * len(self.pool), self.used + len(ids), 1 << 16), dtype=self.kind)
            grown[: self.used] = self.pool[: self.used]
            self.pool = grown
        self.pool[self.used : self.used + len(ids)] = ids
        offsets = self.used + np.cumsum(lengths, dtype=np.int64) - lengths
        self.used += len(ids)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.offsets = np.insert(self.offsets, at, offsets)
        self.lengths = np.insert(self.lengths, at, lengths)
        self.bytes_at = np.insert(self.bytes_at, at, raw_at)
        self.bytes_n = np.insert(self.bytes_n, at, sizes)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned integers."""
        out: list[bytes] = [b""] * len(texts)
        at, chunk, size = [], [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if any(t in text for t in self.special) or not text.isascii() and WIDE_SPACE.search(text):
                out[i] = self._whole(text).tobytes()
                continue
            raw = text.encode("utf-8")
            at.append(i)
            chunk.append(raw)
            size += len(raw)
            if size >= CHUNK_BYTES:
                self._chunk(at, chunk, out)
                at, chunk, size = [], [], 0
        if chunk:
            self._chunk(at, chunk, out)
        return out

    def _chunk(self, at: list[int], chunk: list[bytes], out: list[bytes]) -> None:
        data = b"".join(chunk)
        first = np.zeros(len(chunk), dtype=np.int64)
        np.cumsum([len(c) for c in chunk[:-1]], out=first[1:])
        starts = piece_starts(np.frombuffer(data, dtype=np.uint8), first)
        ends = np.append(starts[1:], len(data))
        hashes, where, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)

        def known() -> tuple[np.ndarray, np.ndarray]:
            place = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
            return place, self.hashes[place] == hashes if len(self.hashes) else np.zeros(len(hashes), dtype=bool)

        place, hit = known()
        while not hit.all():  # once, or twice where the cache had to be emptied
            new = np.flatnonzero(~hit)
            self._learn(hashes[new], [data[s:e].decode("utf-8") for s, e in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)])
            place, hit = known()
        # what the hash calls equal is compared, piece with first piece and first piece with the cached one
        raw, size = padded(data), ends - starts
        first_at, first_n = starts[where], size[where]
        cached = self.bytes_n[place] == first_n
        cached[cached] = same_bytes(raw, first_at[cached], self.raw, self.bytes_at[place][cached], first_n[cached])
        same = (size == first_n[which]) & cached[which]
        same[same] = same_bytes(raw, starts[same], raw, first_at[which[same]], size[same])
        odd = set((np.searchsorted(first, starts[~same], side="right") - 1).tolist())
        n = self.lengths[place][which].astype(np.int64)
        stop = np.cumsum(n)
        ids = self.pool[np.repeat(self.offsets[place][which] - (stop - n), n) + np.arange(stop[-1])]
        cut = (stop - n)[np.searchsorted(starts, first)].tolist() + [len(ids)]
        for k, i in enumerate(at):
            out[i] = self._whole(chunk[k].decode("utf-8")).tobytes() if k in odd else ids[cut[k] : cut[k + 1]].tobytes()


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder for the tokenizer file, made once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def public_path(name: str) -> str:
    """Default place of a public tokenizer file; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def sliced(batches, rows: int = 1000):
    """The same rows in smaller Arrow batches, which bounds what a worker holds as Python objects."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def crc_of_ids(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
