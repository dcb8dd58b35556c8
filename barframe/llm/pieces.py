"""Operator 5, SentencePiece encoding and decoding with offsets.

The model file is read here, without the library: pieces, scores, flags and the compiled
character map, a double-array trie. Normalisation replaces the longest prefix that the
map knows, else copies a character, and records for every normalised byte where its
source begins. Byte-pair merging takes the best-scored neighbours first, the leftmost of
equals; characters without a piece fall back to bytes. The recorded alignment then
projects every piece to a span of bytes of the source; the spans of a text are
contiguous and cover it.

No piece of such a model joins a word's end with the space after it (checked when the
model is read), so words are merged apart and remembered in a bounded table. The new words
of many texts are merged at once: a row of symbols for each word, a merge a row and round.

Null text: empty, so only the begin and end ids. Repeated rows are encoded each for
itself, an empty table gives an empty result, long texts are handled one at a time.
encode() keeps doc_id and adds its columns; others are left out.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .packing import public_path
from .shared import arrow_map, documents, pick, strings

#: The sign that stands for a space in a piece (fixed by the model format).
MARK = "▁"
#: Kinds of pieces in a model file (fixed by the model format).
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
REMEMBERED = 500_000
NEVER = float("inf")
#: Words up to the same one of these lengths are merged together, in blocks of so many; fewer than FEW, or longer ones, one by one.
WIDTHS, BLOCK, FEW = (2, 4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64), 8192, 24
#: Texts of so many characters in all are encoded together.
TOGETHER = 1_000_000
#: Of each length, its width; 0 for one by one.
_WIDTH_OF = [next(w for w in WIDTHS if w >= n) for n in range(WIDTHS[-1] + 1)] + [0]
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            n = {1: 8, 5: 4}.get(key & 7)
            if n is None:
                n, i = varint(i)
            value, i = data[i : i + n], i + n
        yield key >> 3, value


class CharacterMap:
    """A compiled map: the size of a trie, its 32-bit units, then texts that end with a zero byte."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0]
        self.units = struct.unpack_from(f"<{n // 4}I", blob, 4)
        self.texts = blob[4 + n :]
        root = self._jump(self.units[0])
        #: The bytes that begin a key.
        self.first = np.array([root ^ c < len(self.units) and self.units[root ^ c] & 0x800000FF == c for c in range(256)])

    @staticmethod
    def _jump(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of data[at:] and its replacement."""
        units, found, jump = self.units, None, self._jump
        node = jump(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= jump(unit)
            if unit >> 8 & 1:
                text = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.texts[text : self.texts.index(b"\0", text)]
        return found


class Model:
    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        flags = {3: 1, 4: 1, 5: 1}
        kind, fallback, blob = 1, 0, b""
        for field, value in _fields(data):
            if field == 1:
                p = dict(_fields(value))
                self.pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif field == 2:
                t = dict(_fields(value))
                kind, fallback = t.get(3, 1), t.get(35, 0)
            elif field == 3:
                t = dict(_fields(value))
                blob = t.get(2, b"")
                flags |= {k: v for k, v in t.items() if k in flags}
        self.dummy, self.squeeze = bool(flags[3]), bool(flags[4])
        if kind != 2 or not fallback or not flags[5] or any(k == USER for *_, k in self.pieces):
            raise ValueError("only byte-pair models with byte fallback and escaped spaces, without user symbols")
        self.map = CharacterMap(blob) if blob else None
        self.rank = {p: (-score, k) for k, (p, score, t) in enumerate(self.pieces) if t == NORMAL}
        self.cost = {p: c for p, (c, _) in self.rank.items()}.get
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.rank):
            raise ValueError("a piece joins a word with the space after it")
        self.byte = {int(p[3:5], 16): k for k, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        by_name = {p: k for k, (p, *_) in enumerate(self.pieces)}
        self.begin, self.end = by_name["<s>"], by_name["</s>"]
        self.surface = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else b" \xe2\x81\x87 " if t == UNKNOWN else p.replace(MARK, " ").encode() for p, _, t in self.pieces]
        self.is_byte = np.array([t == BYTE for *_, t in self.pieces])
        self.known: dict[str, bytes] = {}
        self._tabulate()

    def _tabulate(self) -> None:
        """Symbols, the pieces and the characters in them, as numbers, and the pairs of symbols that merge; symbol 0 merges with none."""
        names = ["", *self.rank, *sorted({c for p in self.rank for c in p} - self.rank.keys())]
        number = {p: k for k, p in enumerate(names)}
        self.names = names
        self.symbol = np.zeros(0x110000, np.int32)
        for p, k in number.items():
            if len(p) == 1:
                self.symbol[ord(p)] = k
        self.id_of = np.array([self.rank[p][1] if p in self.rank else -1 for p in names], np.int64)
        self.size_of = np.array([len(p.encode()) for p in names], np.int64)
        # equal scores have the same level, so that the leftmost of them comes first
        levels = np.unique([self.rank[p][0] if p in self.rank else NEVER for p in names], return_inverse=True)[1]
        self.level = levels.astype(np.int32)
        merges = {number[a] * len(names) + number[b]: k for p, k in number.items() for i in range(1, len(p)) if (a := p[:i]) in number and (b := p[i:]) in number and p in self.rank}
        keys = np.fromiter(merges, np.int64, len(merges))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_to = np.append(np.fromiter(merges.values(), np.int32, len(merges))[order], 0).astype(np.int32)

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbols that pairs merge to, 0 for none."""
        keys = left.astype(np.int64) * len(self.names) + right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_to[at], 0)

    def normalised(self, text: str) -> tuple[str, np.ndarray]:
        """The text as the model sees it, and for each of its bytes, and its end, the byte of the source where that began."""
        source = text.encode("utf-8", "replace")
        data = np.frombuffer(source, np.uint8)
        at, flat, starts = 0, [], []

        def copy(upto: int) -> None:
            flat.append(data[at:upto])
            starts.append(np.arange(at, upto))

        if self.map:
            # only bytes that begin a key of the map, and a character, can begin a match
            for k in np.flatnonzero(self.map.first[data] & (data & 0xC0 != 0x80)).tolist():
                if k >= at and (hit := self.map.longest(source, k)):
                    copy(k)
                    new = np.frombuffer(hit[1].decode("utf-8", "replace").encode(), np.uint8)
                    flat.append(new)
                    starts.append(np.full(len(new), k))
                    at = k + hit[0]
        copy(len(data))
        new, start = np.concatenate(flat), np.concatenate(starts)
        space = new == 0x20
        if self.squeeze:
            # leading, trailing and repeated spaces go
            keep = ~space
            keep[1:] |= ~space[:-1]
            inner = np.flatnonzero(~space)
            keep[inner[-1] + 1 if len(inner) else 0 :] = False
            new, start, space = new[keep], start[keep], space[keep]
        if self.dummy and len(new):
            new, start, space = np.append(0x20, new), np.append(start[0], start), np.append(True, space)
        # a space becomes the three bytes of its sign
        size = np.where(space, 3, 1)
        out = np.repeat(new, size).astype(np.uint8)
        where = (np.cumsum(size) - size)[space]
        for k, byte in enumerate(MARK.encode()):
            out[where + k] = byte
        return out.tobytes().decode(), np.append(np.repeat(start, size), len(data))

    def merged(self, segment: str) -> list[str]:
        """Byte-pair merging of a segment: the best pair of neighbours first, the leftmost of equals."""
        if len(segment) > 100:
            return self._merged_long(segment)
        parts, cost = list(segment), self.cost
        pairs = [cost(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best == NEVER:
                break
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = cost(parts[i - 1] + parts[i], NEVER)
            if i < len(pairs):
                pairs[i] = cost(parts[i] + parts[i + 1], NEVER)
        return parts

    def _merged_long(self, segment: str) -> list[str]:
        """The same by a heap of neighbours."""
        parts = list(segment)
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (hit := self.rank.get(pair := parts[i] + parts[j])):
                heapq.heappush(heap, (hit[0], i, j, pair))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, pair = heapq.heappop(heap)
            if not parts[i] or after[i] != j or len(parts[i]) + len(parts[j]) != len(pair):
                continue
            parts[i], parts[j] = pair, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in parts if p]

    def _merged_block(self, words: Sequence[str], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """merged() of words of at most width characters, all at once: numbers of words, and a row of symbols for each, filled with -1."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        inside = np.arange(width) < size[:, None]
        parts = np.full((n, width), -1, np.int32)
        parts[inside] = self.symbol[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
        inside = inside[:, 1:]
        to = np.zeros((n, width - 1), np.int32)
        to[inside] = self._joined(parts[:, :-1][inside], parts[:, 1:][inside])
        who = np.arange(n)
        while len(who) and to.shape[1]:
            level = self.level[to]
            at = level.argmin(axis=1)
            rows = np.arange(len(who))
            live = to[rows, at] > 0
            if not live.all():
                yield who[~live], parts[~live]
                who, parts, to, at = who[live], parts[live], to[live], at[live]
                rows = np.arange(len(who))
            # the right part of the best pair goes, and the pair with it
            w = to.shape[1]
            parts[rows, at] = to[rows, at]
            keep = np.ones((len(who), w + 1), bool)
            keep[rows, at + 1] = False
            parts = parts[keep].reshape(len(who), w)
            keep = np.ones((len(who), w), bool)
            keep[rows, at] = False
            to = to[keep].reshape(len(who), w - 1)
            for beside, first in ((at > 0, at - 1), (at < w - 1, at)):
                r, c = rows[beside], first[beside]
                right = parts[r, c + 1]
                to[r, c] = np.where(right < 0, 0, self._joined(parts[r, c], right))
        if len(who):
            yield who, parts

    def learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """Of each word, pairs of an id and the bytes of the normalised text that it takes, as little-endian 32-bit."""
        found: dict[str, bytes] = {}
        by_width: dict[int, list[str]] = {}
        for word in words:
            by_width.setdefault(_WIDTH_OF[min(len(word), len(_WIDTH_OF) - 1)], []).append(word)
        for width, some in by_width.items():
            if not width or len(some) < FEW:
                found.update((word, self._spelt(self.merged(word))) for word in some)
                continue
            for k in range(0, len(some), BLOCK):
                block = some[k : k + BLOCK]
                for who, parts in self._merged_block(block, width):
                    there = parts >= 0
                    flat = parts[there]
                    ends = np.cumsum(there.sum(axis=1))
                    data = np.stack([self.id_of[flat], self.size_of[flat]], axis=1).astype("<u4").tobytes()
                    at = (8 * ends).tolist()
                    names = [block[i] for i in who.tolist()]
                    found.update(zip(names, [data[i:j] for i, j in zip([0, *at[:-1]], at, strict=True)], strict=True))
                    # characters without a piece become bytes
                    for i in np.unique(np.searchsorted(ends, np.flatnonzero(self.id_of[flat] < 0), "right")).tolist():
                        found[names[i]] = self._spelt(self._names(names[i], parts[i][there[i]]))
        return found

    def _names(self, word: str, parts: np.ndarray) -> Iterator[str]:
        """The parts of a word as texts; symbol 0 is a character that no piece holds."""
        at = 0
        for k in parts.tolist():
            p = self.names[k] or word[at]
            at += len(p)
            yield p

    def _spelt(self, parts: Iterable[str]) -> bytes:
        out: list[int] = []
        for p in parts:
            data = p.encode()
            if p in self.rank:
                out += self.rank[p][1], len(data)
            else:
                for b in data:
                    out += self.byte[b], 1
        return struct.pack(f"<{len(out)}I", *out)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids without begin and end, and n + 1 bounds: piece k has the source's bytes bounds[k] to bounds[k + 1]."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """encode() of each text."""
        some: list[str] = []
        size = 0
        for text in texts:
            if some and size + len(text) > TOGETHER:
                yield from self._encoded(some)
                some, size = [], 0
            some.append(text)
            size += len(text)
        yield from self._encoded(some)

    def _encoded(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        normal = [self.normalised(text) if text else None for text in texts]
        split = [_segments(norm[0]) if norm else [] for norm in normal]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = self.learn(set().union(*split).difference(self.known))
        self.known.update(new)
        known = self.known.__getitem__
        spelt = [b"".join(map(known, parts)) for parts in split]
        for p in [p for p in new if len(p) > WIDTHS[-1]]:
            del self.known[p]  # long ones are not remembered
        for norm, data in zip(normal, spelt, strict=True):
            if norm is None:
                yield np.empty(0, "<u4"), np.zeros(1, np.int64)
                continue
            pairs = np.frombuffer(data, "<u4").reshape(-1, 2)
            bounds = np.zeros(len(pairs) + 1, np.int64)
            np.cumsum(pairs[:, 1], out=bounds[1:])
            yield np.ascontiguousarray(pairs[:, 0]), norm[1][bounds]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8; ill-formed runs of byte pieces give U+FFFD for each byte at fault."""
        listed = ids.tolist()
        out = b"".join(map(self.surface.__getitem__, listed))
        try:
            out.decode()
        except UnicodeDecodeError:
            out = self._mended(ids)
        first = next((k for k in listed if self.pieces[k][2] != CONTROL), None)
        lead = first is not None and self.pieces[first][0].startswith(MARK) and not self.is_byte[first]
        return out[1:] if self.dummy and lead else out

    def _mended(self, ids: np.ndarray) -> bytes:
        out, run = [], b""
        for k in [*ids.tolist(), -1]:
            if k >= 0 and self.is_byte[k]:
                run += self.surface[k]
                continue
            while run:
                n = next((n for n in range(1, min(4, len(run)) + 1) if _well_formed(run[:n])), 0)
                out.append(run[:n] if n else "�".encode())
                run = run[n or 1 :]
            if k >= 0:
                out.append(self.surface[k])
        return b"".join(out)


def _segments(norm: str) -> list[str]:
    """What is merged apart: a word with the signs before it."""
    if norm[:1] == MARK and norm[-1] != MARK and MARK * 2 not in norm:
        return [MARK + w for w in norm[1:].split(MARK)]  # what the pattern finds
    return _SEGMENT.findall(norm)


def _well_formed(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        with open(path, "rb") as f:
            _models[path] = Model(f.read())
    return _models[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, begins, ends): begin and end ids have empty spans."""
    slim = pick(docs, "doc_id", "text")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            keys = batch.column(0)
            for i, (ids, bounds) in enumerate(m.encode_all(strings(batch.column(1)))):
                rows = [m.begin, *ids.tolist(), m.end], [0, *bounds[:-1].tolist(), int(bounds[-1])], [0, *bounds[1:].tolist(), int(bounds[-1])]
                arrays = [keys.slice(i, 1), *(pa.array([r], pa.list_(pa.int32())) for r in rows)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids", "begins", "ends"])

    return arrow_map(slim, work, f"doc_id {dict(slim.dtypes)['doc_id']}, ids array<int>, begins array<int>, ends array<int>")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """A row a document: counts and digests of its ids, of their spans and of the text they decode to."""
    slim = pick(docs, "doc_id", "text")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        head, tail = (np.asarray([k], "<u4") for k in (m.begin, m.end))
        for batch in batches:
            rows = []
            for ids, bounds in m.encode_all(strings(batch.column(1))):
                ids = np.concatenate([head, ids, tail])
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(m.decode(ids)).hexdigest(), hashlib.sha256(bounds.astype("<u4").tobytes()).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            types = (pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "bounds_sha256"])

    return arrow_map(slim, work, f"doc_id {dict(slim.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string, bounds_sha256 string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), public_path("piece_bpe_32k.model"))
