"""SentencePiece encoding and decoding with offsets, for BPE models.

Encoding goes the way of the library and keeps the way back to the source:

1. **Normalisation.** The compiled character map of the model (a double-array trie over UTF-8 and
   its replacement strings) is walked for the longest prefix at each place; what has no entry is
   copied character by character. Each normalised byte records the source byte it came from. White
   space rules (dummy prefix, extra spaces, the visible space) follow the model.
2. **Pieces.** The normalised text is cut where no piece of the vocabulary can cross, before a
   visible space that follows another character. All cuts of a batch that are not in the worker's
   bounded memory are merged together as arrays: in each round every cut joins its best pair, the
   leftmost of equals. Characters outside the vocabulary fall back to bytes.
3. **Projection.** Piece lengths and the alignment give each piece the span of source bytes that
   it stands for. The spans of a text are in order and cover it.

Defined results: a null or empty text has only the begin and end ids. Decoding joins pieces, turns
byte pieces into UTF-8 (each byte outside a valid character becomes U+FFFD), drops the space of
the dummy prefix and leaves out control ids; a null list decodes to the empty text.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from themeloom.llm.tokens import batch_udf

SPACE = "▁"
MEMORY = 400_000  # cuts that a worker keeps
SHORT = 7
LONG = 100  # characters from which on a cut is merged with a heap

ENCODED = "struct<ids: binary, starts: array<int>, ends: array<int>>"


class CharMap:
    """Longest-prefix replacement by the compiled character map of a model."""

    def __init__(self, blob: bytes):
        self.units = np.zeros(0, np.uint32)
        self.strings = b""
        if blob:
            size = struct.unpack("<I", blob[:4])[0]
            self.units = np.frombuffer(blob[4 : 4 + size], "<u4")
            self.strings = blob[4 + size :]
        self._memory: dict[bytes, tuple[int, int]] = {}

    def longest(self, text: bytes, at: int) -> tuple[int, int]:
        """Length and value of the longest entry that begins at ``at``; length 0 if there is none."""
        units, found = self.units, (0, 0)
        node = int(units[0])
        place = _child(0, node)
        for k in range(at, len(text)):
            place ^= text[k]
            if place >= len(units):
                break
            node = int(units[place])
            if node & 0x800000FF != text[k]:
                break
            place = _child(place, node)
            if node >> 8 & 1:
                found = (k + 1 - at, int(units[place]) & 0x7FFFFFFF)
        return found

    def replacement(self, value: int) -> bytes:
        return self.strings[value : self.strings.index(b"\0", value)]


def _child(place: int, node: int) -> int:
    return place ^ ((node >> 10) << ((node & 0x200) >> 6))


def _slots(pairs: np.ndarray, bits: int) -> np.ndarray:
    return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class Model:
    """What encoding and decoding need of a model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        with open(path, "rb") as file:
            spec.ParseFromString(file.read())
        if spec.trainer_spec.model_type != 2:
            raise ValueError("only BPE models are supported")
        rules = spec.normalizer_spec
        self.map = CharMap(rules.precompiled_charsmap)
        self.prefix, self.squeeze, self.visible = (
            rules.add_dummy_prefix, rules.remove_extra_whitespaces, rules.escape_whitespaces
        )
        kinds = {"normal": 1, "unknown": 2, "control": 3, "user": 4, "unused": 5, "byte": 6}
        if any(p.type in (kinds["user"], kinds["unused"]) for p in spec.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.pieces = [p.piece for p in spec.pieces]
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kinds["normal"]}
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == kinds["unknown"])
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == kinds["byte"]}
        self.begin = self.pieces.index(spec.trainer_spec.bos_piece)
        self.end = self.pieces.index(spec.trainer_spec.eos_piece)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces that hold a space after another character are not supported")
        self.surface = [p.encode() for p in self.pieces]
        for i, p in enumerate(spec.pieces):
            if p.type == kinds["control"]:
                self.surface[i] = b""
            elif p.type == kinds["unknown"]:
                self.surface[i] = spec.trainer_spec.unk_surface.encode()
            elif p.type == kinds["byte"]:
                self.surface[i] = bytes([int(p.piece[3:5], 16)])
        self.length = np.array([len(x) for x in self.surface])
        # Pieces in order of falling score; equal scores share a rank.
        _, order = np.unique(-np.array([p.score for p in spec.pieces], np.float32), return_inverse=True)
        self.rank = {p: int(order[i]) for p, i in self.ids.items()}
        self._pairs = None
        self._memory: dict[str, bytes] = {}

    # --- normalisation -------------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, np.ndarray | None]:
        """The normalised text and, for each of its UTF-8 bytes and its end, the source byte.

        The alignment is None where it only shifts by the dummy prefix and stretches spaces, see
        ``spans``: the map of the model is empty and extra spaces stay.
        """
        space = SPACE if self.visible else " "
        if not len(self.map.units) and not self.squeeze:
            if not text:
                return "", None
            return (space if self.prefix else "") + text.replace(" ", space), None
        out, source, at, raw = bytearray(), [], 0, text.encode()
        parts = []
        while at < len(raw):
            size, value = self.map.longest(raw, at) if len(self.map.units) else (0, 0)
            if size:
                parts.append((self.map.replacement(value), at, size))
            else:
                size = 1 + (raw[at] >= 0xC0) + (raw[at] >= 0xE0) + (raw[at] >= 0xF0)
                parts.append((raw[at : at + size], at, size))
            at += size
        end = len(raw)
        if self.squeeze:
            low, high = 0, len(parts)
            while low < high and parts[low][0] in (b" ", b""):
                low += 1
            parts = parts[low:high]
        if not parts:
            return "", np.array([end])
        mark = space.encode()
        if self.prefix:
            out += mark
            source += [parts[0][1]] * len(mark)
        spaced = self.squeeze
        for new, place, size in parts:
            if spaced and self.squeeze:
                new = new.lstrip(b" ")
            for k, byte in enumerate(new):
                if byte == 32:
                    out += mark
                    source += [place] * len(mark)
                else:
                    out.append(byte)
                    source.append(place)
            if new:
                spaced = new.endswith(b" ")
        if self.squeeze:
            while out.endswith(mark):
                del out[-len(mark) :]
                end = source[-1]
                del source[-len(mark) :]
        return out.decode(), np.array([*source, end])

    # --- merging -------------------------------------------------------------------------------

    def _pair_table(self):
        """All pairs of symbols whose join is a piece, in a hash table with open addressing.

        Symbols are numbered by piece id; characters without a piece get numbers beyond. Returns
        the pairs, the joined symbols, their ranks and the shift of the hash.
        """
        if self._pairs is None:
            joined = {}
            for piece, i in self.ids.items():
                for k in range(1, len(piece)):
                    a, b = self._symbol(piece[:k]), self._symbol(piece[k:])
                    if a is not None and b is not None:
                        joined[a << 32 | b] = i
            bits = max(4, (4 * len(joined)).bit_length())
            pairs, symbols = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
            left = np.array([*joined], np.int64)
            values = np.array([*joined.values()], np.int64)
            slot = _slots(left, bits)
            while len(left):
                # The first of those that want a free slot takes it, the others go on.
                free = np.flatnonzero(pairs[slot] == -1)
                _, one = np.unique(slot[free], return_index=True)
                taken = free[one]
                pairs[slot[taken]], symbols[slot[taken]] = left[taken], values[taken]
                rest = np.ones(len(left), bool)
                rest[taken] = False
                left, values, slot = left[rest], values[rest], (slot[rest] + 1) & ((1 << bits) - 1)
            order = np.array([self.rank.get(p, 0) for p in self.pieces])
            self._pairs = pairs, symbols, order[symbols], bits
        return self._pairs

    def _symbol(self, part: str) -> int | None:
        return self.ids.get(part, len(self.pieces) + ord(part) if len(part) == 1 else None)

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of pairs in the table, -1 for those that it hasn't."""
        pairs, _, _, bits = self._pair_table()
        pair = a << 32 | b
        slot = _slots(pair, bits)
        held = pairs[slot]
        out = np.where(held == pair, slot, -1)
        open_ = np.flatnonzero((held != pair) & (held != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << bits) - 1)
            held = pairs[slot[open_]]
            same = held == pair[open_]
            out[open_[same]] = slot[open_[same]]
            open_ = open_[~same & (held != -1)]
        return out

    def merge(self, cuts: list[str]) -> list[bytes]:
        """Ids (little-endian, 32 bits each) of every cut.

        Each round joins the best pair of every cut, the leftmost of equals. Only the pairs beside
        a join are looked up again; cuts without a pair leave the arrays.
        """
        _, joined, rank, _ = self._pair_table()
        none = len(self.pieces)
        base, ids = len(self.pieces), self.ids
        flat = "".join(cuts)
        codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
        chars, place = np.unique(codes, return_inverse=True)
        sym = np.array([ids.get(chr(c), base + c) for c in chars.tolist()], np.int64)[place]
        own = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
        at = np.arange(len(sym))
        # The slot of each symbol with the next one of its cut.
        entry = np.full(len(sym), -1)
        inner = np.flatnonzero(own[:-1] == own[1:])
        entry[inner] = self._lookup(sym[inner], sym[inner + 1])
        value = np.where(entry >= 0, rank[entry], none)
        done = []
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            sizes = np.diff(np.append(starts, len(own)))
            least = np.minimum.reduceat(value, starts)
            going = least < none
            if not going.all():
                rest = ~np.repeat(going, sizes)
                done.append((sym[rest], own[rest], at[rest]))
                keep = ~rest
                sym, own, at, entry, value = sym[keep], own[keep], at[keep], entry[keep], value[keep]
                least, sizes = least[going], sizes[going]
                if not len(sym):
                    break
            best = np.flatnonzero(value == np.repeat(least, sizes))
            first = np.ones(len(best), bool)
            first[1:] = own[best[1:]] != own[best[:-1]]
            best = best[first]
            sym[best] = joined[entry[best]]
            keep = np.ones(len(sym), bool)
            keep[best + 1] = False
            place = best - np.arange(len(best))  # one symbol fewer for each join before
            sym, own, at, entry, value = sym[keep], own[keep], at[keep], entry[keep], value[keep]
            for left in (place, place[place > 0] - 1):
                left = left[left + 1 < len(sym)]
                same = own[left] == own[left + 1]
                entry[left] = -1
                entry[left[same]] = self._lookup(sym[left[same]], sym[left[same] + 1])
                value[left] = np.where(entry[left] >= 0, rank[entry[left]], none)
            last = place[place == len(sym) - 1]
            entry[last], value[last] = -1, none
        sym, own, at = (np.concatenate(x) for x in zip(*done)) if done else (sym, own, at)
        order = np.empty(len(flat), np.int64)
        order[:] = -1
        order[at] = np.arange(len(at))
        order = order[order >= 0]
        return self._packed(sym[order], own[order], len(cuts))

    def _packed(self, sym: np.ndarray, own: np.ndarray, count: int) -> list[bytes]:
        """Packed ids of every cut from its symbols; what is no piece is spelled in bytes."""
        base = len(self.pieces)
        odd = np.flatnonzero(sym >= base)
        if len(odd):
            spelled = [
                [self.bytes[b] for b in chr(x).encode()] if self.bytes else [self.unknown] for x in (sym[odd] - base).tolist()
            ]
            size = np.ones(len(sym), np.int64)
            size[odd] = [len(x) for x in spelled]
            begin = np.cumsum(size) - size
            out = np.repeat(sym, size)
            for k, values in zip(odd.tolist(), spelled):
                out[begin[k] : begin[k] + len(values)] = values
            sym, own = out, np.repeat(own, size)
        edges = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=count))]) * 4
        raw = sym.astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]

    def merge_long(self, cut: str) -> bytes:
        """The same for one long cut, text without spaces, with a heap."""
        rank, parts = self.rank.get, list(cut)
        after = [*range(1, len(parts)), -1]
        before = [-1, *range(len(parts) - 1)]
        heap: list[tuple[int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0:
                joined = parts[i] + parts[j]
                order = rank(joined)
                if order is not None:
                    heapq.heappush(heap, (order, i, joined))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            # Pairs of which a side has been joined since are stale.
            if j < 0 or not parts[i] or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        sym = np.array([self._symbol(p) for p in parts if p], np.int64)
        return self._packed(sym, np.zeros(len(sym), np.int64), 1)[0]

    _CUTS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def encode(self, texts: list[str]) -> list[tuple[bytes, np.ndarray | None]]:
        """Ids without begin and end, and the alignment of the normalised text."""
        normal = [self.normalise(t) for t in texts]
        cuts = [self._CUTS.findall(t) for t, _ in normal]
        memory = self._memory
        fresh = [c for c in set(chain.from_iterable(cuts)) if c not in memory]
        made = {c: self.merge_long(c) for c in fresh if len(c) > LONG}
        # Cuts of like length together, so that a long one doesn't keep the others in rounds.
        fresh = sorted((c for c in fresh if len(c) <= LONG), key=len)
        low = 0
        while low < len(fresh):
            high, chars = low, 0
            while high < len(fresh) and chars < 200_000 and len(fresh[high]) <= 2 * len(fresh[low]) + 8:
                chars += len(fresh[high])
                high += 1
            memory.update(zip(fresh[low:high], self.merge(fresh[low:high])))
            low = high
        find = (lambda c: made[c] if c in made else memory[c]) if made else memory.__getitem__
        out = [(b"".join(map(find, own)), source) for own, (_, source) in zip(cuts, normal)]
        if len(memory) > MEMORY:
            # Short cuts are the frequent ones.
            kept = {c: v for c, v in memory.items() if len(c) <= SHORT}
            self._memory = kept if len(kept) < MEMORY // 2 else {}
        return out

    def spans(self, text: str, ids: np.ndarray, source: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Source bytes that each piece stands for."""
        if not len(ids):
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        edge = np.concatenate([[0], np.cumsum(self.length[ids])])
        if source is None:
            # The only changes: a prefix, and spaces of one byte that became marks of three.
            raw = np.frombuffer(text.encode(), np.uint8)
            width = len(SPACE.encode()) if self.visible else 1
            grown = np.where(raw == 32, width, 1)
            after = np.concatenate([[0], np.cumsum(grown)]) + (width if self.prefix else 0)
            place = np.searchsorted(after, edge, "left")
            place = np.minimum(place, len(raw))
        else:
            place = source[np.minimum(edge, len(source) - 1)]
        place[0] = 0
        return place[:-1].astype(np.int32), place[1:].astype(np.int32)

    # --- decoding ------------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.surface.__getitem__, ids))
        text = raw.decode("utf-8", "replace_bytes").replace(SPACE, " ")
        if self.prefix and text[:1] == " ":
            text = text[1:]
        return text


def _replace_bytes(error):
    return "�" * (error.end - error.start), error.end


codecs.register_error("replace_bytes", _replace_bytes)


@lru_cache(maxsize=4)
def model(path: str) -> Model:
    return Model(path)


def encoder(path: str, offsets: bool = True):
    """Arrow UDF from a text to its ids (begin and end included) and source spans in bytes.

    ``ids`` are packed little-endian, four bytes each. Begin and end ids have empty spans. The
    model file must be readable under ``path`` by every executor.
    """

    def encode_slice(text: pa.Array) -> pa.Array:
        own = model(path)
        texts = text.fill_null("").to_pylist()
        begin, end = np.uint32(own.begin).tobytes(), np.uint32(own.end).tobytes()
        ids, starts, ends = [], [], []
        for t, (packed, source) in zip(texts, own.encode(texts)):
            ids.append(begin + packed + end)
            if offsets:
                s, e = own.spans(t, np.frombuffer(packed, "<u4"), source)
                last = e[-1] if len(e) else 0
                starts.append(np.concatenate([[0], s, [last]]))
                ends.append(np.concatenate([[0], e, [last]]))
        kind = pa.list_(pa.int32())
        return pa.StructArray.from_arrays(
            [
                pa.array(ids, pa.binary()),
                pa.array(starts, kind) if offsets else pa.nulls(len(texts), kind),
                pa.array(ends, kind) if offsets else pa.nulls(len(texts), kind),
            ],
            ["ids", "starts", "ends"],
        )

    return batch_udf(ENCODED, encode_slice)


def decoder(path: str):
    """Arrow UDF from packed ids to the decoded text."""

    def decode_slice(ids: pa.Array) -> pa.Array:
        own = model(path)
        return pa.array([own.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in ids.to_pylist()], pa.string())

    return batch_udf("string", decode_slice)


def round_trip(path: str):
    """Arrow UDF from a text to its ids, the text that they decode to and the source bytes covered.

    The same steps as ``encoder`` and ``decoder`` one after the other, in one worker: the spans of
    the pieces are checked to follow each other, and only how far they reach is returned.
    """

    def both(text: pa.Array) -> pa.Array:
        own = model(path)
        texts = text.fill_null("").to_pylist()
        begin, end = np.uint32(own.begin).tobytes(), np.uint32(own.end).tobytes()
        ids, decoded, covered = [], [], []
        for t, (packed, source) in zip(texts, own.encode(texts)):
            own_ids = np.frombuffer(packed, "<u4")
            starts, ends = own.spans(t, own_ids, source)
            if (starts[1:] != ends[:-1]).any():
                raise ValueError("source spans leave a gap")
            ids.append(begin + packed + end)
            decoded.append(own.decode(own_ids.tolist()))
            covered.append(int(ends[-1]) if len(ends) else 0)
        return pa.StructArray.from_arrays(
            [pa.array(ids, pa.binary()), pa.array(decoded, pa.string()), pa.array(covered, pa.int64())],
            ["ids", "decoded", "covered"],
        )

    return batch_udf("struct<ids: binary, decoded: string, covered: bigint>", both)


def n_ids(packed: Column) -> Column:
    return (F.octet_length(packed) / 4).cast("long")
