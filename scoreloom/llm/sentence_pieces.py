"""Encoding with a SentencePiece BPE model, spans in the original text, decoding.

A text is first normalised as the model says: at every place the longest entry
of the compiled character map (a double-array trie) is replaced by its normal
form, and every byte of the result records the byte of the original that it
came from. The normalised text falls into chunks that no piece can bridge;
each different chunk is merged once per task, best pair first. The record then
projects every piece back to a span of original bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from sentencepiece import sentencepiece_model_pb2 as proto

from scoreloom.llm.textvec import flat, portions

MODEL = "piece_bpe_32k.model"
KNOWN = 1 << 19             # chunks remembered by a task, up to a batch more
SHORT = 32                  # signs of a chunk merged together with others, at most
PORTION = 1 << 20           # bytes of text encoded at once, unless one text is longer
# Fixed values of the model format.
SPACE, BPE = "▁", 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BROKEN = "�".encode()


def read_model(path: str | None = None) -> bytes:
    """The model file, some hundred kilobytes; read by the driver and broadcast."""
    with open(path or public_tokenizers.path(MODEL), "rb") as file:
        return file.read()


class CharacterMap:
    """Longest-prefix rewriting by the compiled map: the size of a double-array
    trie, its 32-bit units, then normal forms that end with a zero byte."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled[4:4 + size], dtype="<u4").tolist()
        self.forms = compiled[4 + size:]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest entry that begins at ``at``, and its normal form."""
        node = self._offset(self.units[0])
        best = None
        for i in range(at, len(text)):
            node ^= text[i]
            unit = self.units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                best = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if best is None:
            return None
        return best[0], self.forms[best[1]:self.forms.index(b"\x00", best[1])]


def character_length(text: bytes, at: int) -> int:
    """Bytes of the character at ``at``; 0 if they are not valid UTF-8."""
    head = text[at]
    n = 1 if head < 0x80 else 2 if 0xC2 <= head < 0xE0 else 3 if 0xE0 <= head < 0xF0 else 4 if 0xF0 <= head < 0xF5 else 0
    try:
        text[at:at + n].decode()
        return n if at + n <= len(text) else 0
    except UnicodeDecodeError:
        return 0


class Spelling:
    """What ids are spelled as when decoded."""

    def __init__(self, content: bytes):
        parsed = proto.ModelProto()
        parsed.ParseFromString(content)
        self.parsed = parsed
        self.prefix, self.squeeze = parsed.normalizer_spec.add_dummy_prefix, parsed.normalizer_spec.remove_extra_whitespaces
        self.kinds = np.array([p.type for p in parsed.pieces], dtype=np.int8)
        unknown = parsed.trainer_spec.unk_surface.encode()
        spelled = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else unknown if p.type == UNKNOWN
                   else b"" if p.type == CONTROL else p.piece.replace(SPACE, " ").encode() for p in parsed.pieces]
        self.size = np.array([len(s) for s in spelled], dtype=np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.size)[:-1])).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(spelled) or b"\x00", dtype=np.uint8)
        self.leading = np.array([len(p.piece) - len(p.piece.lstrip(SPACE)) if p.type == NORMAL else 0
                                 for p in parsed.pieces], dtype=np.int64)


class Model:
    """A BPE model in the form the encoder needs."""

    def __init__(self, content: bytes):
        self.spelling = Spelling(content)
        parsed = self.spelling.parsed
        kinds = [p.type for p in parsed.pieces]
        if (parsed.trainer_spec.model_type != BPE or parsed.trainer_spec.treat_whitespace_as_suffix
                or not {*kinds} <= {NORMAL, UNKNOWN, CONTROL, BYTE}):
            raise ValueError("only BPE models with leading blanks and without user defined or unused pieces")
        rules = parsed.normalizer_spec
        self.map = CharacterMap(rules.precompiled_charsmap) if rules.precompiled_charsmap else None
        self.prefix, self.squeeze = rules.add_dummy_prefix, rules.remove_extra_whitespaces
        self.blank = (SPACE if rules.escape_whitespaces else " ").encode()
        self.score = {p.piece: p.score for p in parsed.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(parsed.pieces) if p.type == NORMAL}
        self.unknown = kinds.index(UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(parsed.pieces) if p.type == BYTE}
        self.fallback = parsed.trainer_spec.byte_fallback
        self.end = next((i for i, p in enumerate(parsed.pieces) if p.type == CONTROL and p.piece == (parsed.trainer_spec.eos_piece or "</s>")), -1)
        self._tables()

    def _tables(self):
        """Signs by number, which of them are neighbours in a piece, and which
        two pieces make a third."""
        signs = sorted({c for piece in self.score for c in piece})
        self.number = np.zeros(0x110000, dtype=np.int32)
        self.number[[ord(c) for c in signs]] = np.arange(1, len(signs) + 1)
        self.inner = np.zeros((len(signs) + 1, len(signs) + 1), dtype=bool)
        self.sign_id = np.array([-1, *(self.ids.get(c, -1) for c in signs)], dtype=np.int64)
        made = []
        for piece, i in self.ids.items():
            for at in range(1, len(piece)):
                self.inner[self.number[ord(piece[at - 1])], self.number[ord(piece[at])]] = True
                left, right = self.ids.get(piece[:at]), self.ids.get(piece[at:])
                if left is not None and right is not None:
                    made.append((left << 32 | right, -self.score[piece], i))
        # A blank opens a chunk unless some piece holds one behind another sign.
        bridged = any(SPACE in piece.lstrip(SPACE) for piece in self.score)
        self.chunks = re.compile(r"(?s).+" if bridged else f"(?s){SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        made.sort()
        self.pairs = np.array([m[0] for m in made], dtype=np.int64)
        self.cost = np.array([m[1] for m in made], dtype=np.float64)
        self.union = np.array([m[2] for m in made], dtype=np.int64)
        self.width = np.zeros(max(self.ids.values(), default=0) + 1, dtype=np.int32)
        for piece, i in self.ids.items():
            self.width[i] = len(piece.encode())

    # --- normalisation

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the
        original byte it came from."""
        if not text:
            return b"", np.zeros(1, np.int64)
        if self.map is None and not self.squeeze:
            try:
                text.decode()
                return self._plain(text)
            except UnicodeDecodeError:
                pass
        return self._rewritten(text)

    def _plain(self, text: bytes) -> tuple[bytes, np.ndarray]:
        raw = np.frombuffer(text, dtype=np.uint8)
        width = np.where(raw == 32, len(self.blank), 1)
        head = len(self.blank) if self.prefix else 0
        origin = np.concatenate((np.zeros(head, np.int64), np.repeat(np.arange(len(raw)), width), [len(raw)]))
        return (self.blank if self.prefix else b"") + text.replace(b" ", self.blank), origin

    def _step(self, text: bytes, at: int) -> tuple[int, bytes]:
        found = self.map.longest(text, at) if self.map else None
        if found:
            return found
        n = character_length(text, at)
        return (n, text[at:at + n]) if n else (1, BROKEN)

    def _rewritten(self, text: bytes) -> tuple[bytes, np.ndarray]:
        at = 0
        while self.squeeze and at < len(text):
            n, form = self._step(text, at)
            if form != b" ":
                break
            at += n
        if at == len(text):
            return b"", np.array([at])
        out, origin = bytearray(), []
        if self.prefix:
            out += self.blank
            origin += [at] * len(self.blank)
        after_blank = self.squeeze
        while at < len(text):
            n, form = self._step(text, at)
            if after_blank:
                form = form.lstrip(b" ")
            if form:
                new = form.replace(b" ", self.blank)
                out += new
                origin += [at] * len(new)
                after_blank = self.squeeze and form.endswith(b" ")
            at += n
        end = len(text)
        while self.squeeze and out.endswith(self.blank):
            end = origin[len(out) - len(self.blank)]
            del out[len(out) - len(self.blank):], origin[len(out):]
        return bytes(out), np.array(origin + [end], dtype=np.int64)

    # --- pieces of a chunk

    def stretches(self, chunk: str) -> list[str]:
        """A chunk, cut wherever two signs stand side by side in no piece."""
        number = self.number[np.frombuffer(chunk.encode("utf-32-le"), dtype="<u4")]
        cuts = (np.flatnonzero(~self.inner[number[:-1], number[1:]]) + 1).tolist()
        return [chunk[a:b] for a, b in zip([0, *cuts], [*cuts, len(chunk)])]

    def _joined(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost and id of the piece that two neighbours make; no piece costs infinity."""
        if not len(self.pairs):
            return np.full(left.shape, np.inf), np.zeros(left.shape, np.int64)
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.cost[at], np.inf), self.union[at]

    def merged_together(self, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pieces of many chunks of the same length, one in each row: the
        neighbours whose union scores best are merged, the leftmost first among
        equals, until no two make a piece. Rows come out as they are done, with
        their numbers."""
        row = np.arange(len(part))
        cost, union = self._joined(part[:, :-1], part[:, 1:])
        while len(row):
            best = cost.argmin(axis=1) if cost.shape[1] else np.zeros(len(row), np.int64)
            going = np.isfinite(cost[np.arange(len(row)), best]) if cost.shape[1] else np.zeros(len(row), bool)
            if not going.all():
                yield row[~going], part[~going]
            row, part, cost, union, best = row[going], part[going], cost[going], union[going], best[going]
            if not len(row):
                break
            each = np.arange(len(row))
            part[each, best] = union[each, best]
            after = np.arange(part.shape[1] - 1)
            part = np.take_along_axis(part, after + (after > best[:, None]), axis=1)
            after = after[:-1]
            past = after + (after >= best[:, None])
            cost, union = np.take_along_axis(cost, past, axis=1), np.take_along_axis(union, past, axis=1)
            for some, at in ((best > 0, best - 1), (best < cost.shape[1], best)):
                where = each[some], at[some]
                cost[where], union[where] = self._joined(part[where], part[where[0], where[1] + 1])

    def merged(self, signs: str) -> list[str]:
        """The same for one stretch of any length and any signs, with a queue:
        n log n steps."""
        part = list(signs)
        n = len(part)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []

        def offer(i, j):
            if i >= 0 and j < n:
                score = self.score.get(part[i] + part[j])
                if score is not None:
                    heapq.heappush(queue, (-score, i, j, len(part[i]) + len(part[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, size = heapq.heappop(queue)
            if not part[i] or not part[j] or after[i] != j or len(part[i]) + len(part[j]) != size:
                continue
            part[i], part[j] = part[i] + part[j], ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in part if p]

    def spelled_out(self, pieces: list[int]) -> tuple[list[int], list[int]]:
        """ids, and how many normalised bytes each stands for. A negative number
        is a sign without a piece: -1 less its code point."""
        ids, widths = [], []
        for piece in pieces:
            if piece >= 0:
                ids.append(piece)
                widths.append(int(self.width[piece]))
                continue
            raw = chr(-1 - piece).encode()
            if self.fallback:
                # The last byte stands for the character, those before it for nothing.
                ids += [self.bytes[b] for b in raw]
                widths += [0] * (len(raw) - 1) + [len(raw)]
            else:
                ids.append(self.unknown)
                widths.append(len(raw))
        return ids, widths

    def coded(self, chunk: str) -> tuple[list[int], list[int]]:
        """The same for the pieces of a chunk of any length."""
        return self.spelled_out([self.ids.get(piece, -1 - ord(piece[0])) for signs in self.stretches(chunk) for piece in self.merged(signs)])


class Chunks(dict):
    """Chunk -> its number; ids and widths of all chunks lie in flat arrays."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self):
        self.clear()
        # Compact arrays, which numpy reads without a step per number.
        self.ids, self.widths, self.first = array("i"), array("i"), array("q", [0])

    def _add(self, chunk: str, ids, widths):
        self[chunk] = len(self.first) - 1
        self.ids.extend(ids)
        self.widths.extend(widths)
        self.first.append(len(self.ids))

    def _add_rows(self, chunks: list[str], parts: np.ndarray):
        """Chunks of as many pieces each, known by id."""
        self.update(zip(chunks, range(len(self.first) - 1, len(self.first) - 1 + len(chunks))))
        self.first.frombytes((len(self.ids) + parts.shape[1] * np.arange(1, len(parts) + 1, dtype=np.int64)).tobytes())
        self.ids.frombytes(parts.astype(np.int32).tobytes())
        self.widths.frombytes(self.model.width[parts].tobytes())

    def learn(self, new: set[str]):
        model, by_length = self.model, defaultdict(list)
        for chunk in new:
            by_length[len(chunk) if len(chunk) <= SHORT else 0].append(chunk)
        for length, group in by_length.items():
            if length:
                points = np.frombuffer("".join(group).encode("utf-32-le"), dtype="<u4").reshape(len(group), length)
                signs = model.sign_id[model.number[points]]
                signs = np.where(signs >= 0, signs, -1 - points.astype(np.int64))    # joins nothing
                for rows, parts in model.merged_together(signs):
                    plain = (parts >= 0).all(axis=1)
                    self._add_rows([group[i] for i in rows[plain].tolist()], parts[plain])
                    for i, ids in zip(rows[~plain].tolist(), parts[~plain].tolist()):
                        self._add(group[i], *model.spelled_out(ids))
                continue
            for chunk in group:
                self._add(chunk, *model.coded(chunk))


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... size[0] numbers, then those of the next."""
    before = np.cumsum(size) - size
    return np.repeat(first - before, size) + np.arange(int(size.sum()))


_KEPT: dict[tuple, object] = {}


def _kept(make, content, name: str):
    # What is made of the model outlives the task in a reused worker, known chunks too.
    if (make, name) not in _KEPT:
        _KEPT.clear()
        _KEPT[make, name] = make(content.value)
    return _KEPT[make, name]


def _chunks(content: bytes) -> Chunks:
    return Chunks(Model(content))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def _encode_batch(known: Chunks, texts: list[bytes], add_end: bool):
    """ids, begins and ends of all texts, one after the other, and their numbers."""
    model = known.model
    if len(known) > KNOWN:
        known.reset()
    normal, origin = zip(*map(model.normalise, texts)) if texts else ((), ())
    cut = [model.chunks.findall(n.decode()) for n in normal]
    found = list(chain.from_iterable(cut))
    new = set(found).difference(known)
    if new:
        known.learn(new)
    codes = np.fromiter(map(known.__getitem__, found), dtype=np.int64, count=len(found))
    first = np.array(known.first, dtype=np.int64)
    many = first[codes + 1] - first[codes]
    taken = ragged(first[codes], many)
    ids, width = np.array(known.ids, dtype=np.int32)[taken], np.array(known.widths, dtype=np.int64)[taken]
    holder = np.repeat(np.repeat(np.arange(len(texts)), [len(c) for c in cut]), many)
    # Places in the normalised bytes of all texts; ``origin`` has one entry more per text.
    to = np.cumsum(width)
    places = np.concatenate(origin) if origin else np.zeros(0, np.int64)
    begins, ends = places[to - width + holder], places[to + holder]
    numbers = np.bincount(holder, minlength=len(texts))
    # Unknown pieces side by side are one piece.
    if not model.fallback and len(ids):
        again = np.zeros(len(ids), dtype=bool)
        again[1:] = (ids[1:] == model.unknown) & (ids[:-1] == model.unknown) & (holder[1:] == holder[:-1])
        last = np.append(~again[1:], True)
        ids, begins, ends, holder = ids[~again], begins[~again], ends[last], holder[~again]
        numbers = np.bincount(holder, minlength=len(texts))
    if add_end:
        where = np.cumsum(numbers)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        ids, begins, ends = np.insert(ids, where, model.end), np.insert(begins, where, sizes), np.insert(ends, where, sizes)
        numbers = numbers + 1
    return ids, begins, ends, numbers


def repaired(raw: bytes) -> bytes:
    """Every byte that belongs to no valid character becomes U+FFFD."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = character_length(raw, at)
        out += raw[at:at + n] if n else BROKEN
        at += n or 1
    return bytes(out)


def _decode_batch(spelling: Spelling, ids: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    if len(ids) and (ids.min() < 0 or ids.max() >= len(spelling.kinds)):
        raise ValueError("an id is outside the vocabulary")
    size, first = spelling.size[ids], spelling.first[ids]
    kind, doc = spelling.kinds[ids], np.repeat(np.arange(len(numbers)), numbers)
    if (spelling.prefix or spelling.squeeze) and len(ids):
        # The blank set in front is taken back: from the first piece that is
        # spelled at all, and from all blank ones before it when blanks are squeezed.
        stop = np.flatnonzero(size - (np.minimum(spelling.leading[ids], 1) if spelling.squeeze else 0) > 0)
        heads = stop[np.unique(doc[stop], return_index=True)[1]] if len(stop) else stop
        until = np.full(len(numbers), len(ids))
        until[doc[heads]] = heads
        trimmed = (np.arange(len(ids)) <= until[doc]) & (spelling.leading[ids] > 0)
        first, size = first + trimmed, size - trimmed
    data = spelling.bytes[ragged(first, size)].tobytes() if len(ids) else b""
    ends = np.cumsum(np.bincount(doc, size, len(numbers)).astype(np.int64)) if len(numbers) else np.zeros(0, np.int64)
    texts, at = [], 0
    byte_pieces = np.bincount(doc[kind == BYTE], minlength=len(numbers)) if len(ids) else np.zeros(len(numbers))
    for i, to in enumerate(ends.tolist()):
        text = data[at:to]
        if byte_pieces[i]:
            try:
                text.decode()
            except UnicodeDecodeError:
                text = repaired(text)
        texts.append(text)
        at = to
    return texts


def _encoder(content, name: str, add_end: bool, decoded: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _kept(_chunks, content, name)
        for batch in portions(batches, limit=PORTION):
            raw, starts = flat(batch.column("text"))
            data = raw.tobytes()
            texts = [data[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
            ids, begins, ends, numbers = _encode_batch(known, texts, add_end)
            columns = {"doc_id": batch.column("doc_id"), "ids": _lists(ids, numbers), "begins": _lists(begins, numbers), "ends": _lists(ends, numbers)}
            if decoded:
                texts = _decode_batch(known.model.spelling, ids.astype(np.int64), numbers)
                columns["text"] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])

    return encode


def encode(docs: DataFrame, content: bytes, add_end: bool = True, decoded: bool = False) -> DataFrame:
    """doc_id, ids, begins, ends of every row: the ids of the pieces of its text
    and, for each, the original UTF-8 bytes (end exclusive) it stands for; with
    ``decoded`` also ``text``, what ``decode`` makes of the ids.

    A NULL or empty text has no piece, only the end id if ``add_end``; a NULL
    doc_id is kept, repeated rows are encoded each, further columns are ignored,
    an empty table gives no rows. Bytes that are not UTF-8 count as U+FFFD each.
    Time grows with n log n in the length of a stretch without a safe cut, and
    linearly otherwise. The model is the only thing broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(content)
    name = hashlib.sha256(content).hexdigest()
    if add_end and Model(content).end < 0:
        raise ValueError("the model has no end id")
    schema = "doc_id long, ids array<int>, begins array<int>, ends array<int>" + (", text string" if decoded else "")
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(_encoder(shared, name, add_end, decoded), schema))


def _decoder(content, name: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = _kept(Spelling, content, name)
        for batch in batches:
            lists = batch.column("ids").cast(pa.large_list(pa.int32())).fill_null([])
            numbers = np.diff(np.asarray(lists.offsets))
            values = np.asarray(lists.flatten().cast(pa.int64()))
            texts = pa.array(_decode_batch(spelling, values, numbers), pa.large_binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts.cast(pa.string())], names=[*batch.schema.names, "text"])

    return decode


def decode(rows: DataFrame, content: bytes) -> DataFrame:
    """``rows`` with a column ``text``: what ``ids`` spell.

    NULL or empty ids spell the empty text, control ids nothing. An id outside
    the vocabulary or NULL ends the job. A column ``text`` that is already
    there is replaced.
    """
    shared = rows.sparkSession.sparkContext.broadcast(content)
    name = hashlib.sha256(content).hexdigest()
    given = rows.drop("text")
    schema = T.StructType([*given.schema.fields, T.StructField("text", T.StringType())])
    return given.mapInArrow(_decoder(shared, name), schema)
