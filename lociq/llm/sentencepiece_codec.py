"""SentencePiece encoding and decoding with offsets into the original bytes.

Method: a text is normalised by longest-prefix matches in the model's compiled character map (a double-array trie);
each normalised character records the byte offset of its source. The normalised text falls into units at spaces that
no piece of the vocabulary crosses, so that the merges of one unit can't touch another's; each unit is segmented
once and remembered. The pieces' lengths in normalised characters, summed up, are projected through the recorded
offsets to byte spans of the original text.

The units are segmented by the sentencepiece library under a copy of the model whose normaliser is the identity;
where a piece could cross units, or the model has no byte fallback, the whole text is one unit.

Defined cases: a null or empty text has no ids, no spans and decodes to the empty string. Text of any length is
taken whole. Other columns are kept; those named like a result column are replaced. Of a character spelled in
byte pieces the last byte piece has the span and those before it an empty one, as in the library.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import column, with_columns

SPACE = "▁"
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: A worker remembers the ids of up to twice as many units: a new generation begins when one is full.
CACHE_UNITS = 64_000


class CharMap:
    """The compiled character map: a double-array trie, then the NUL-ended replacements."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes matched from ``at`` and their replacement."""
        units, best = self.units, None
        if not units:
            return None
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        node = offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or (u := units[node]) & 0x800000FF != data[i]:
                break
            node ^= offset(u)
            if u >> 8 & 1:
                best = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if best is None:
            return None
        return best[0], self.strings[best[1] : self.strings.index(b"\0", best[1])]


class Encoder:
    def __init__(self, model: bytes) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.user = sorted((p.piece for p in proto.pieces if p.type == p.USER_DEFINED), key=len, reverse=True)
        self.plain = not self.map.units and not self.squeeze and not self.user and self.escape and self.dummy
        self.whole = not proto.trainer_spec.byte_fallback or any(re.search(f"[^{SPACE}]{SPACE}", p.piece) for p in proto.pieces)
        # of each id: is it a byte, which, its length in characters (bytes: 0), its text, its decimal digits
        self.byte = np.array([p.type == p.BYTE for p in proto.pieces])
        self.value = np.array([int(p.piece[3:5], 16) if p.type == p.BYTE else 0 for p in proto.pieces])
        self.length = np.array([0 if p.type == p.BYTE else len(p.piece) for p in proto.pieces])
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        shown = {kind.UNKNOWN: proto.trainer_spec.unk_surface.encode(), kind.CONTROL: b""}
        self.raw = [bytes([v]) if b else shown.get(p.type, p.piece.replace(SPACE, " ").encode()) for p, b, v in zip(proto.pieces, self.byte.tolist(), self.value.tolist(), strict=True)]
        #: Whether a piece in front loses its space: those that are spelled out, not bytes, unknown or control pieces.
        self.opens = [p.type not in (kind.UNKNOWN, kind.CONTROL, kind.BYTE) and p.piece.startswith(SPACE) for p in proto.pieces]
        self.silent = [p.type == kind.CONTROL for p in proto.pieces]
        self.digits = [str(i) for i in range(len(proto.pieces))]
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = b"", False, False, True
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    # normalisation ---------------------------------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and the source byte offset of each of its characters and of its end."""
        data = text.encode()
        if self.plain:
            if not text:
                return "", np.zeros(1, np.int64)
            return SPACE + text.replace(" ", SPACE), self.plain_offsets(data, len(text))
        out: list[str] = []
        source: list[int] = []
        at, after_space = 0, self.squeeze
        while at < len(data):
            step, piece = self._prefix(data, at)
            if after_space:
                piece = piece.lstrip(" ")
            if piece:
                if not out and self.dummy:
                    out.append(SPACE if self.escape else " ")
                    source.append(at)
                after_space = self.squeeze and piece.endswith(" ")
                out.append(piece.replace(" ", SPACE) if self.escape else piece)
                source += [at] * len(piece)
            at += step
        norm, end = "".join(out), len(data)
        if self.squeeze:
            short = norm.rstrip(SPACE if self.escape else " ")
            if len(short) < len(norm):
                norm, end = short, source[len(short)]
        return norm, np.array([*source[: len(norm)], end], np.int64)

    def _prefix(self, data: bytes, at: int) -> tuple[int, str]:
        for symbol in self.user:
            if data.startswith(raw := symbol.encode(), at):
                return len(raw), symbol
        if found := self.map.longest(data, at):
            return found[0], found[1].decode()
        n = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
        return n, data[at : at + n].decode()

    @staticmethod
    def plain_offsets(data: bytes, chars: int) -> np.ndarray:
        at = np.arange(-1, chars + 1) if len(data) == chars else np.concatenate(([0], np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), [len(data)]))
        at[0] = 0
        return at

    # segmentation ----------------------------------------------------------------------------------------------

    def units(self, text: str) -> list[str]:
        """The units of a text; of a plain model, where all begin with a space mark, without that mark."""
        if self.plain and not self.whole and text and text[0] != " " and "  " not in text and SPACE not in text:
            return text.split(" ")
        norm = self.normalise(text)[0]
        units = ([norm] if norm else []) if self.whole else UNIT.findall(norm)
        return [u[1:] for u in units] if self.plain else units

    def ids(self, text: str) -> np.ndarray:
        units = self.units(text)
        found = list(map(self.known.get, units))
        missing = {u for u, f in zip(units, found, strict=True) if f is None}
        if missing:
            known, older = self.known, self.older
            new = []
            for u in missing:
                if (f := older.get(u)) is None:
                    new.append(u)
                else:
                    known[u] = f
            spelled = [SPACE + u for u in new] if self.plain else new
            for u, ids in zip(new, self.segmenter.encode(spelled, num_threads=1) if new else [], strict=True):
                known[u] = array("i", ids).tobytes()
            found = map(known.__getitem__, units)
        out = np.frombuffer(b"".join(found), np.int32)
        if len(self.known) > CACHE_UNITS:
            self.known, self.older = {}, self.known
        return out

    # results ---------------------------------------------------------------------------------------------------

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and the begin and end of each piece's span in the text's UTF-8 bytes."""
        ids = self.ids(text or "")
        return ids, *self.spans(text or "", ids)

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.whole:  # an unknown run is one piece whose length the vocabulary doesn't tell
            norm = self.normalise(text)[0]
            at = np.flatnonzero((np.frombuffer(norm.encode(), np.uint8) & 0xC0) != 0x80)
            ends = np.searchsorted(at, [p.end for p in self.segmenter.encode(norm, return_type="proto").pieces])
        else:
            lengths = self.length[ids]
            if (spelled := np.flatnonzero(self.byte[ids])).size:  # a character's last byte piece stands for it
                value = self.value[ids[spelled]]
                lead = (value & 0xC0) != 0x80
                value = value[lead]
                lengths[spelled[lead] + (value >= 0xC0) + (value >= 0xE0) + (value >= 0xF0)] = 1
            ends = np.cumsum(lengths)
        source = self.plain_offsets(text.encode(), len(text)) if self.plain else self.normalise(text)[1]
        ends = source[ends]
        return np.concatenate(([0], ends[:-1])), ends

    def decoded(self, ids: list[int]) -> bytes:
        """The text of the ids; bytes that spell no character are replaced, as in the library."""
        if self.squeeze:
            return self.processor.decode(ids).encode()
        out = b"".join(map(self.raw.__getitem__, ids))
        if self.dummy and next((self.opens[i] for i in ids if not self.silent[i]), False):
            out = out[1:]
        try:
            out.decode()
        except UnicodeDecodeError:
            return self.processor.decode(ids).encode()
        return out


_encoders: dict[str, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    """This process's encoder of a model."""
    if (key := hashlib.sha256(model).hexdigest()) not in _encoders:
        _encoders[key] = Encoder(model)
    return _encoders[key]


def read_model(path: str) -> bytes:
    """A tokenizer's file, some 0.5 MB, which goes to the executors with the code."""
    with open(path, "rb") as f:
        return f.read()


def _lists(arrays: list[np.ndarray], dtype: str):
    import pyarrow as pa

    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype("<i4")
    values = np.concatenate(arrays).astype(dtype) if arrays else np.zeros(0, dtype)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def encode(df: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """With ids, begins and ends: the pieces' ids and their spans in the bytes of the original text."""

    def compute(batch):
        made = [encoder(model).encode(t) for t in column(batch, text)]
        return [_lists([m[i] for m in made], "<i4") for i in range(3)]

    return with_columns(df, "ids array<int>, begins array<int>, ends array<int>", compute)


def decode(df: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """With decoded: the text of the ids. Null ids decode to the empty string."""

    def compute(batch):
        return [[encoder(model).processor.decode(x) if x else "" for x in column(batch, ids)]]

    return with_columns(df, "decoded string", compute)


def digests(df: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """With n_tokens, ids_sha256, decoded_sha256, spans_sha256 (of begins then ends as little-endian int64)."""
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def compute(batch):
        e, out = encoder(model), []
        for t in column(batch, text):
            ids, begins, ends = e.encode(t)
            listed = ids.tolist()
            out.append((len(ids), sha(",".join(map(e.digits.__getitem__, listed)).encode()), sha(e.decoded(listed)), sha(begins.tobytes() + ends.tobytes())))
        return [list(x) for x in zip(*out, strict=True)] or [[], [], [], []]

    return with_columns(df, "n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string", compute)


def tokenised(df: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """With ids, begins, ends, n_tokens, and decoded_sha256 of the text that the ids decode to."""

    def compute(batch):
        e = encoder(model)
        made = [e.encode(t) for t in column(batch, text)]
        lists = [_lists([m[i] for m in made], "<i4") for i in range(3)]
        return [*lists, [len(m[0]) for m in made], [hashlib.sha256(e.decoded(m[0].tolist())).hexdigest() for m in made]]

    return with_columns(df, "ids array<int>, begins array<int>, ends array<int>, n_tokens bigint, decoded_sha256 string", compute)


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    import public_tokenizers

    model = read_model(model_path or public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, model).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256")
