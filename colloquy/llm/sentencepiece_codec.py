"""SentencePiece encoding and decoding on the ``tokenizers`` library.

The model protobuf is parsed here and rebuilt as a ``tokenizers`` pipeline:
the normaliser (compiled character map, white-space folding), the metaspace
marker and dummy prefix, unigram scores or BPE merges (every split of a piece
into two pieces, ranked by the score of the whole) and byte fallback.

No piece of such a model reaches over a metaspace marker that follows another
character (checked when the model is read; otherwise a text is one unit), so a
text is encoded as the concatenation of its pre-tokens. Each task encodes the
pre-tokens that it has not met yet, many at a time and multithreaded, and
keeps their ids in a bounded cache. With ``verify`` every such pre-token is
also encoded by the ``sentencepiece`` library and decoded again: ``parity``
of a text tells whether all its pre-tokens agree, ``lossless`` whether its ids
decode to the text itself, before normalising.

Defined results: a null text has null ids and no tokens, and counts as equal;
an empty text has no ids. Texts of any length are handled pre-token by
pre-token. Columns of the input that clash with a result column are replaced.
"""

from __future__ import annotations

import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, tidied

MARK = "▁"
MAX_MODEL_BYTES = 64 << 20
CACHE_ENTRIES = 200_000
GROUP_CHARS = 1_000_000
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def proto_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) pairs of one protobuf message."""
    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 0x7F) << shift
            i, shift = i + 1, shift + 7
            if data[i - 1] < 0x80:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        else:
            n = {1: 8, 5: 4}.get(kind)
            if kind == 2:
                n, i = varint(i)
            if n is None:
                raise ValueError(f"wire type {kind}")
            value, i = data[i:i + n], i + n
        yield key >> 3, value


class Model:
    """What the protobuf says. Field numbers are those of the public
    sentencepiece_model.proto."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback = UNIGRAM, False
        self.charsmap, self.dummy_prefix, self.fold_spaces = b"", True, True
        for field, value in proto_fields(data):
            if field == 1:
                part = dict(proto_fields(value))
                score = struct.unpack("<f", part[2])[0] if 2 in part else 0.0
                self.pieces.append((part.get(1, b"").decode(), score, part.get(3, NORMAL)))
            elif field == 2:
                part = dict(proto_fields(value))
                self.kind = part.get(3, self.kind)
                self.byte_fallback = bool(part.get(35, self.byte_fallback))
                if part.get(24):
                    raise ValueError("white space as a suffix is not supported")
            elif field == 3:
                part = dict(proto_fields(value))
                self.charsmap = part.get(2, self.charsmap)
                self.dummy_prefix = bool(part.get(3, self.dummy_prefix))
                self.fold_spaces = bool(part.get(4, self.fold_spaces))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {self.kind}")
        self.ids = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        self.unk = next(i for i, (_, _, k) in enumerate(self.pieces) if k == UNKNOWN)
        usable = [p for p, _, k in self.pieces if k in (NORMAL, USER)]
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in usable)
        self.breaks = not any("\n" in p for p in usable)
        if self.splits:
            self.unit = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+" if self.breaks else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        else:
            self.unit = re.compile(r"(?s).+")

    def piece_bytes(self) -> list[bytes]:
        """What each id stands for in a decoded text."""
        def of(piece: str, kind: int) -> bytes:
            if kind == BYTE:
                return bytes([int(piece[3:5], 16)])
            if kind == UNKNOWN:
                return " ⁇ ".encode()
            return b"" if kind == CONTROL else piece.replace(MARK, " ").encode()

        return [of(p, k) for p, _, k in self.pieces]


def backend(model: Model):  # noqa: ANN201
    """The ``tokenizers`` pipeline of a model, for pre-tokens."""
    from tokenizers import Tokenizer, decoders, models

    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unk, model.byte_fallback)
    else:
        ranked = sorted((-s, i, p) for i, (p, s, k) in enumerate(model.pieces) if k in (NORMAL, USER) and len(p) > 1)
        merges = [(p[:j], p[j:]) for _, _, p in ranked for j in range(1, len(p))
                  if p[:j] in model.ids and p[j:] in model.ids]
        core = models.BPE(vocab=model.ids, merges=merges, unk_token=model.pieces[model.unk][0], fuse_unk=True,
                          byte_fallback=model.byte_fallback, cache_capacity=0)
    out = Tokenizer(core)
    steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    out.decoder = decoders.Sequence(steps + [decoders.Strip(" ", 1, 0)] * model.dummy_prefix)
    return out


class Codec:
    def __init__(self, data: bytes, verify: bool = True) -> None:
        from tokenizers import normalizers

        self.model, self.cache, self.bad = Model(data), {}, (set(), set())
        self.tokenizer = backend(self.model)
        self.charsmap = normalizers.Precompiled(self.model.charsmap) if self.model.charsmap else None
        self.table = self.model.piece_bytes()
        self.is_byte = np.array([k == BYTE for _, _, k in self.model.pieces])
        joins = self.model.breaks and self.model.splits and self.model.byte_fallback and "<0x0A>" in self.model.ids
        self.newline = self.model.ids["<0x0A>"] if joins else None
        self.judge = None
        if verify:
            import sentencepiece

            # appended fields of the same message override: no dummy prefix, no folding of white space
            self.judge = sentencepiece.SentencePieceProcessor(model_proto=data + b"\x1a\x04\x18\x00\x20\x00")

    def normalise(self, text: str) -> str:
        if self.charsmap is not None:
            text = self.charsmap.normalize_str(text)
        if self.model.fold_spaces:
            text = re.sub(f"[ {MARK}]+", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)

    def _fresh(self, units: list[str]) -> list[list[int]]:
        """Ids of new pre-tokens, multithreaded."""
        if self.newline is None:
            return [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        lines = ["\n".join(units[i:i + 200]) for i in range(0, len(units), 200)]
        out: list[list[int]] = []
        for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False):
            ids = np.array(e.ids, np.int32)
            out += [x[1:].tolist() for x in np.split(np.append(np.int32(self.newline), ids),
                                                    np.flatnonzero(ids == self.newline) + 1)]
        return out

    def _learn(self, units: set[str]) -> None:
        if len(self.cache) + len(units) > CACHE_ENTRIES:
            self.cache = {u: self.cache[u] for u in units if u in self.cache}
            self.bad = ({u for u in self.bad[0] if u in units}, {u for u in self.bad[1] if u in units})
        new = [u for u in units if u not in self.cache]
        if "\n" in units and "\n" in new and self.newline is not None:
            new.remove("\n")
            self.cache["\n"] = struct.pack("<i", self.newline)
        if not new:
            return
        made = self._fresh(new)
        self.cache.update((u, struct.pack(f"<{len(i)}i", *i)) for u, i in zip(new, made))
        if self.judge is not None:
            table = self.table
            self.bad[0].update(u for u, a, b in zip(new, made, self.judge.encode(new)) if a != b)
            self.bad[1].update(u for u, a in zip(new, made)
                               if b"".join([table[i] for i in a]) != u.replace(MARK, " ").encode())

    def encode_batch(self, texts: list[str | None]) -> list[tuple[bytes, bool, bool]]:
        """(little-endian 32-bit ids, parity, lossless) of each text."""
        find = self.model.unit.findall
        whole = [self.normalise(x) if x else "" for x in texts]
        units = [find(x) for x in whole]
        self._learn(set(itertools.chain.from_iterable(units)))
        get = self.cache.__getitem__
        ids = [b"".join(map(get, u)) for u in units]
        # units that decode to themselves decode to the text with its marks as blanks
        skip = 1 if self.model.dummy_prefix else 0
        same = [not x or n.replace(MARK, " ")[skip:] == x for x, n in zip(texts, whole)]
        if not (self.bad[0] or self.bad[1]):
            return [(i, True, s) for i, s in zip(ids, same)]
        return [(i, self.bad[0].isdisjoint(u), s and self.bad[1].isdisjoint(u)) for i, s, u in zip(ids, same, units)]


def _codec(data: bytes, verify: bool) -> Codec:
    """One codec, with its cache, for each worker process and model."""
    key = ("codec", len(data), hash(data), verify)
    return held(key, lambda: Codec(data, verify))


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_MODEL_BYTES + 1)
    if len(data) > MAX_MODEL_BYTES:
        raise ValueError(f"{path}: larger than {MAX_MODEL_BYTES} bytes")
    return data


def encode(docs: DataFrame, model: bytes, text: str = "text", verify: bool = True) -> DataFrame:
    """``docs`` with ids, n_tokens, n_fallback (byte pieces), parity and
    lossless added."""
    made = ["ids", "n_tokens", "n_fallback", "parity", "lossless"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in made]
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
                           T.StructField("n_tokens", T.LongType()), T.StructField("n_fallback", T.LongType()),
                           T.StructField("parity", T.BooleanType()), T.StructField("lossless", T.BooleanType())])

    def part(codec: Codec, b: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
        found = codec.encode_batch(texts)
        ids = np.frombuffer(b"".join(f[0] for f in found), "<i4")
        ends = np.concatenate([[0], np.cumsum([len(f[0]) // 4 for f in found])])
        fallback = np.concatenate([[0], np.cumsum(codec.is_byte[ids])])[ends]
        none = np.array([x is None for x in texts])
        lists = pa.ListArray.from_arrays(pa.array(ends[:-1].tolist() + [int(ends[-1])], pa.int32()), pa.array(ids, pa.int32()),
                                         mask=pa.array(none) if len(none) else None)
        return pa.RecordBatch.from_arrays(
            [*b.columns[:-1], lists, pa.array(np.diff(ends)), pa.array(np.diff(fallback)),
             pa.array([f[1] for f in found], pa.bool_()), pa.array([f[2] for f in found], pa.bool_())], [*kept, *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, verify)
        for b in batches:
            col, start, held, texts = b.column(b.num_columns - 1), 0, 0, []
            for i, x in enumerate(col):
                texts.append(x.as_py())
                held += len(texts[-1] or "")
                if held >= GROUP_CHARS or i + 1 == len(col):
                    yield part(codec, b.slice(start, i + 1 - start), texts)
                    start, held, texts = i + 1, 0, []

    return docs.select(*kept, F.col(text).alias("_text")).mapInArrow(tidied(run), schema)


def decode(encoded: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` added: the text of its ids, null for
    null; decoded by the ``tokenizers`` library in batches."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in encoded.columns if c != "decoded"]
    schema = T.StructType([*encoded.select(*kept).schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, False)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                s = b.slice(lo, 256)
                lists = s.column(s.num_columns - 1).to_pylist()
                texts = codec.tokenizer.decode_batch([x or [] for x in lists], skip_special_tokens=False)
                out = pa.array([None if x is None else t for x, t in zip(lists, texts)], pa.string())
                yield pa.RecordBatch.from_arrays([*s.columns[:-1], out], [*kept, "decoded"])

    return encoded.select(*kept, F.col(ids).alias("_ids")).mapInArrow(tidied(run), schema)
