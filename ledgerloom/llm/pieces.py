"""SentencePiece BPE models: offset-preserving encoding, and decoding.

Encoding normalises by longest prefix through the model's compiled character map (a double-array trie plus a
pool of replacements), recording for every normalised byte the source byte it came from; BPE merges (with byte
fallback) then run on the normalised text, and every piece is projected through that alignment to a span of the
original UTF-8 bytes.  Models whose pieces never continue past a word end are encoded word by word with a
bounded memo; the words of a batch that it lacks are merged together, one merge of each word in a step.  Where the
map is empty the alignment is known in closed form (a space is one byte either way).

The model file's bytes travel to the executors as one broadcast: a model has a fixed size.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER_DEFINED, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_MEMO = 120_000  # words in each of the two generations that a worker remembers
_ROWS = 256  # documents in a batch of results
_SHORT = 48  # symbols up to which a merge scans instead of using a heap
_TOGETHER = 4096  # words that are merged together
_NEVER = np.int32(2**31 - 1)


class CharsMap:
    """The compiled character map: longest match of the text's bytes to its replacement."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.pool = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, bytes consumed) of the longest key that starts at this place."""
        units, found = self.units, None
        if not units:
            return None
        node = self._offset(units[0])
        for i in range(at, len(text)):
            byte = text[i]
            node ^= byte
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        start = found[0]
        return self.pool[start : self.pool.index(b"\0", start)], found[1]


class Merges:
    """The merges of many words at once: in every step each word's best pair, the leftmost of equals, becomes one symbol.

    Symbols are pieces, by id, then characters that only occur inside pieces, then one that stands for all others.
    """

    def __init__(self, ids: dict[str, int], rank: dict[str, float], n: int):
        known = dict(ids)
        for piece in ids:
            for c in piece:
                if c not in known:
                    known[c] = n
                    n += 1
        self.other = n
        chars = {ord(c): k for c, k in known.items() if len(c) == 1}
        self.of_char = np.full(max(chars, default=0) + 2, n, np.int32)
        self.of_char[list(chars)] = list(chars.values())
        order = {r: i for i, r in enumerate(sorted(set(rank.values())))}
        pairs: dict[int, tuple[int, int]] = {}
        for piece, k in ids.items():
            for i in range(1, len(piece)):
                if (a := known.get(piece[:i])) is not None and (b := known.get(piece[i:])) is not None:
                    pairs[a << 32 | b] = order[rank[piece]], k
        self.bits = max(8, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks, self.joined = np.full(1 << self.bits, _NEVER, np.int32), np.zeros(1 << self.bits, np.int32)
        left = np.array(list(pairs), np.int64)
        values = np.array(list(pairs.values()), np.int32).reshape(-1, 2)
        slots = self._slot(left)
        while len(left):  # linear probing: of those that want a free slot the first one gets it
            free = self.keys[slots] < 0
            at, first = np.unique(slots[free], return_index=True)
            rows = np.flatnonzero(free)[first]
            self.keys[at], self.ranks[at], self.joined[at] = left[rows], values[rows, 0], values[rows, 1]
            rest = np.ones(len(left), bool)
            rest[rows] = False
            left, values, slots = left[rest], values[rest], (slots[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the pieces that these pairs of symbols (-1: none) make."""
        keys = a.astype(np.int64) << 32 | b
        keys[(a < 0) | (b < 0)] = -2
        slots = self._slot(keys)
        todo = np.flatnonzero((self.keys[slots] != keys) & (self.keys[slots] >= 0))
        while len(todo):
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)
            todo = todo[(self.keys[slots[todo]] != keys[todo]) & (self.keys[slots[todo]] >= 0)]
        hit = self.keys[slots] == keys
        return np.where(hit, self.ranks[slots], _NEVER), self.joined[slots]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all words in a row, their first characters' places in the joined words, and where each word's symbols end."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begins = np.cumsum(sizes) - sizes
        n, width = len(words), int(sizes.max()) + 2  # a column of none on both sides
        filled = np.arange(width - 2) < sizes[:, None]
        symbols = np.full((n, width), -1, np.int32)
        symbols[:, 1:-1][filled] = self.of_char[np.minimum(codes, len(self.of_char) - 1)]
        flat = symbols.reshape(-1)
        after = np.arange(1, flat.size + 1)
        before = np.arange(-1, flat.size - 1)
        cost = np.full((n, width), _NEVER, np.int32)
        piece = np.zeros((n, width), np.int32)
        i, j = np.nonzero(filled[:, 1:])
        cost[i, j + 1], piece[i, j + 1] = self._find(symbols[i, j + 1], symbols[i, j + 2])
        costs, pieces = cost.reshape(-1), piece.reshape(-1)
        rows, active = np.arange(n), cost
        while len(rows):
            best = np.argmin(active, axis=1)
            ok = active[np.arange(len(rows)), best] != _NEVER
            rows, best = rows[ok], best[ok]
            at = rows * width + best
            gone = after[at]
            flat[at] = pieces[at]
            flat[gone], costs[gone] = -1, _NEVER
            after[at] = right = after[gone]
            before[right] = at
            left = before[at]
            costs[at], pieces[at] = self._find(flat[at], flat[right])
            costs[left], pieces[left] = self._find(flat[left], flat[at])
            active = cost[rows]
        kept = symbols >= 0
        places = (np.arange(width) - 1 + begins[:, None])[kept]
        return symbols[kept], places, np.cumsum(kept.sum(axis=1))


class PieceModel:
    def __init__(self, blob: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(blob)
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE:
            raise ValueError("only BPE models are supported")
        spec = proto.normalizer_spec
        kinds = [p.type for p in proto.pieces]
        if _USER_DEFINED in kinds or _UNUSED in kinds or proto.trainer_spec.treat_whitespace_as_suffix or not spec.escape_whitespaces:
            raise ValueError("user-defined or unused pieces, whitespace suffixes and unescaped spaces are not supported")
        self.charsmap = CharsMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
        self.rank = {p.piece: -p.score for p in proto.pieces if p.type == _NORMAL}
        self.unk = kinds.index(_UNKNOWN)
        self.eos = next((i for i, p in enumerate(proto.pieces) if p.type == _CONTROL and p.piece == "</s>"), -1)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == _BYTE}
        self.kinds = kinds
        plain = {_NORMAL: lambda p: p.piece.replace(SPACE, " ").encode(), _UNKNOWN: lambda p: proto.trainer_spec.unk_surface.encode(), _CONTROL: lambda p: b"", _BYTE: lambda p: bytes([int(p.piece[3:5], 16)])}
        self.surface = [plain[p.type](p) for p in proto.pieces]
        #: no piece goes on with a space after another character, so merges never cross such a place
        inner = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.split = re.compile("(?s).+" if inner else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.direct = not self.charsmap.units and not self.squeeze
        self.merges = Merges(self.ids, self.rank, len(kinds))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def normalize(self, text: str) -> tuple[str, list[int]]:
        """The normalised text, and for each of its bytes (and its end) the byte of the text that it stands for."""
        raw, out, align = text.encode(), bytearray(), []
        at, mark = 0, SPACE.encode()

        def prefix(at: int) -> tuple[bytes, int]:
            if hit := self.charsmap.longest(raw, at):
                return hit
            lead = raw[at]
            n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            return raw[at : at + n], n

        if self.squeeze:
            while at < len(raw) and (hit := prefix(at))[0] == b" ":
                at += hit[1]
        if at == len(raw):
            return "", [at]

        def put(piece: bytes) -> None:
            piece = piece.replace(b" ", mark)
            out.extend(piece)
            align.extend([at] * len(piece))

        if self.dummy:
            put(b" ")
        after_space = self.squeeze
        while at < len(raw):
            piece, n = prefix(at)
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                put(piece)
                after_space = self.squeeze and piece.endswith(b" ")
            at += n
        end = at
        if self.squeeze:
            while out.endswith(mark):
                del out[-len(mark) :]
                end = align[len(out)]
                del align[len(out) :]
        return out.decode(), [*align, end]

    def _merge(self, word: str) -> list[str]:
        rank, parts = self.rank, list(word)
        if len(parts) <= _SHORT:
            inf = float("inf")
            cost = [rank.get(a + b, inf) for a, b in pairwise(parts)]
            while cost and (best := min(cost)) < inf:
                i = cost.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del cost[i]
                if i:
                    cost[i - 1] = rank.get(parts[i - 1] + parts[i], inf)
                if i < len(cost):
                    cost[i] = rank.get(parts[i] + parts[i + 1], inf)
            return parts
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        heap = [(rank[a + b], i, a + b) for i, (a, b) in enumerate(pairwise(parts)) if a + b in rank]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j < 0 or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (pair := parts[a] + parts[b]) in rank:
                    heapq.heappush(heap, (rank[pair], a, pair))
        return [p for p in parts if p]

    def _word(self, word: str) -> bytes:
        """Pairs (id, bytes of the source) of a word's pieces, a space mark counting one byte."""
        found = self.old.get(word)
        if found is None:
            pairs: list[int] = []
            for piece in self._merge(word):
                n = len(piece.encode()) - 2 * piece.count(SPACE)
                if (known := self.ids.get(piece)) is not None:
                    pairs += known, n
                elif self.bytes:
                    for byte in (coded := piece.encode())[:-1]:
                        pairs += self.bytes[byte], 0
                    pairs += self.bytes[coded[-1]], n
                else:
                    pairs += self.unk, n
            found = struct.pack(f"<{len(pairs)}i", *pairs)
        if len(word) <= 64:
            if len(self.young) >= _MEMO:
                self.old, self.young = self.young, {}
            self.young[word] = found
        return found

    def _words(self, text: str) -> list[str] | None:
        """The words of a text, where the alignment is known."""
        if not self.direct or SPACE in text or not text:
            return None
        coded = text.replace(" ", SPACE)
        return self.split(SPACE + coded if self.dummy else coded)

    def learn(self, texts: list[str]) -> list[list[str] | None]:
        """The texts' words, for encode; those that the memo lacks are put into it, as far as it reaches."""
        split = [self._words(text) for text in texts]
        words: set[str] = set().union(*[w for w in split if w])
        young, old = self.young, self.old
        short = sorted((w for w in words if len(w) <= _SHORT and w not in young and w not in old), key=len)
        for at in range(0, len(short), _TOGETHER):
            self._learn(short[at : at + _TOGETHER])
        return split

    def _learn(self, words: list[str]) -> None:
        symbols, places, ends = self.merges.merge(words)
        joined = "".join(words)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        # bytes of the source, a space mark counting one
        wide = 1 + (codes >= 0x80).astype(np.int32) + (codes >= 0x800) + (codes >= 0x10000)
        wide[codes == ord(SPACE)] = 1
        total = np.concatenate([[0], np.cumsum(wide)])
        bounds = np.append(places, len(codes))
        widths = total[bounds[1:]] - total[bounds[:-1]]
        strange = np.flatnonzero(symbols >= len(self.kinds))  # characters that are no pieces
        if not self.bytes:
            symbols[strange] = self.unk
        elif len(strange):
            raw = np.frombuffer(joined.encode(), np.uint8)
            of_byte = np.array([self.bytes[i] for i in range(256)], np.int32)
            first = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000))])
            times = np.ones(len(symbols), np.int64)
            times[strange] = first[places[strange] + 1] - first[places[strange]]
            stops = np.cumsum(times)
            ends = stops[ends - 1]
            symbols, spread = np.repeat(symbols, times), np.repeat(widths, times)
            inside = np.arange(len(symbols)) - np.repeat(stops - times, times)
            spread[inside < np.repeat(times, times) - 1] = 0  # the last byte holds the width
            at = symbols >= len(self.kinds)
            symbols[at] = of_byte[raw[(np.repeat(first[places], times) + inside)[at]]]
            widths = spread
        blob, start = np.stack([symbols, widths], axis=1).astype("<i4").tobytes(), 0
        if len(self.young) + len(words) > _MEMO:
            self.old, self.young = self.young, {}
        for word, end in zip(words, ends.tolist(), strict=True):
            self.young[word] = blob[8 * start : 8 * end]
            start = end

    def encode(self, text: str, words: list[str] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """ids, the source byte at which each piece ends, and the one where the first begins; words: what learn made of the text."""
        get, word = self.young.get, self._word
        if self.direct and SPACE not in text:
            if not text:
                return np.empty(0, np.int32), np.empty(0, np.int32), 0
            chunks = self._words(text) if words is None else words
            pairs = np.frombuffer(b"".join([get(c) or word(c) for c in chunks]), np.int32).reshape(-1, 2)
            return pairs[:, 0], np.cumsum(pairs[:, 1], dtype=np.int32) - np.int32(self.dummy), 0
        normal, align = self.normalize(text)
        pairs = np.frombuffer(b"".join([get(c) or word(c) for c in self.split(normal)]), np.int32).reshape(-1, 2)
        # widths in normalised bytes: a mark has three there
        marks = np.frombuffer(normal.encode().replace(SPACE.encode(), b" "), np.uint8) == 0x20
        wide = np.concatenate([[0], np.cumsum(np.where(marks, 3, 1))])
        ends = np.asarray(align, np.int32)[wide[np.cumsum(pairs[:, 1])]] if len(pairs) else np.empty(0, np.int32)
        return pairs[:, 0], ends, align[0]

    def _text(self, ids: list[int]) -> str:
        out = b"".join(map(self.surface.__getitem__, ids))
        try:
            return out.decode()
        except UnicodeDecodeError:  # byte pieces that are no characters: a replacement character for each byte
            return re.sub("[\udc80-\udcff]", "\ufffd", out.decode("utf-8", "surrogateescape"))

    def decode(self, ids: list[int]) -> str:
        """As the library: control pieces are silent but end a run of byte pieces; the dummy space goes."""
        kinds, runs = self.kinds, [[]]
        if ids and any(kinds[i] == _CONTROL for i in set(ids[:-1])):
            for i in ids:
                if kinds[i] == _CONTROL:
                    runs.append([])
                else:
                    runs[-1].append(i)
        else:
            runs = [ids]
        first = next((i for i in ids if kinds[i] != _CONTROL), None)
        out = "".join(map(self._text, runs))
        if first is not None and (self.dummy or self.squeeze) and kinds[first] == _NORMAL and out[:1] == " ":
            out = out.lstrip(" ") if self.squeeze else out[1:]
        return out


_models: dict[int, PieceModel] = {}


def _model(shared) -> PieceModel:
    """One model (and memo) for each Python worker."""
    key = hash(shared.value)
    if key not in _models:
        _models.clear()
        _models[key] = PieceModel(shared.value)
    return _models[key]


def _share(df: DataFrame, model_path: str):
    bound_batches(df.sparkSession)
    with open(model_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, model_path: str, text_col: str = "text", add_eos: bool = True, keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """Encode every whole text: the columns of keep, then ids array<int>, ends array<int>, start int; for decoded also decoded string.

    Piece i covers the source's UTF-8 bytes [ends[i-1], ends[i]) (the first from start); of a character's
    fallback bytes the last one holds the span.  The end id has an empty span.  A null text is an empty one
    (no ids but the end id).  Rows are independent: repeated rows repeat, an empty table stays empty, columns
    outside keep are not read.  Narrow transformation.  decoded is what decode makes of the ids, in the same pass.
    """
    shared = _share(df, model_path)
    rows = df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        tail = np.array([model.eos] if add_eos else [], np.int32)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                ids, ends, starts, sizes, back = [], [], [], [0], []
                texts = batch.column(n_keep).to_pylist()
                for text, words in zip(texts, model.learn(texts), strict=True):
                    i, e, start = model.encode(text, words)
                    ids += i, tail
                    ends += e, np.full(len(tail), e[-1] if len(e) else start, np.int32)
                    starts.append(start)
                    sizes.append(len(i) + len(tail))
                    if decoded:
                        back.append(model.decode([*i.tolist(), *tail.tolist()]))
                offsets = pa.array(np.cumsum(sizes, dtype=np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), pa.int32())) for x in (ids, ends)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], *lists, pa.array(starts, pa.int32()), *([pa.array(back, pa.string())] if decoded else [])], names=[*keep, "ids", "ends", "start", *["decoded"] * decoded])

    return rows.mapInArrow(run, schema + ", ids array<int>, ends array<int>, start int" + ", decoded string" * decoded)


def decode(ids: Column, df: DataFrame, model_path: str) -> Column:
    """The text of an id list of df, as the model's own decoder spells it (null: null; no ids: empty)."""
    shared = _share(df, model_path)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _model(shared)
        for lists in batches:
            bounds = lists.offsets.to_numpy()
            starts, stops = bounds[:-1], bounds[1:]
            flat = lists.values.to_numpy(zero_copy_only=False)
            valid = lists.is_valid().to_numpy(zero_copy_only=False)
            texts = [pa.array([], pa.string())]
            for at in range(0, len(lists), _ROWS):  # Python's strings of a few rows at a time
                rows = zip(starts[at : at + _ROWS], stops[at : at + _ROWS], valid[at : at + _ROWS], strict=True)
                texts.append(pa.array([model.decode(flat[a:b].tolist()) if ok else None for a, b, ok in rows], pa.string()))
            yield pa.concat_arrays(texts)

    return run(ids)
