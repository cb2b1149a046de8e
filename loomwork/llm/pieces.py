"""SentencePiece encoding and decoding that keeps the source bytes of every piece.

Normalisation is done here, as the model's normaliser says: at each place the longest prefix that the compiled character
map knows is replaced (else one character is kept), white space is escaped, and every normalised byte remembers the source
byte that it came from. The model, stripped of its own normaliser, then only splits the normalised text into pieces, and
each piece is projected through the remembered places to the span of original UTF-8 bytes that it covers.

No piece of such a vocabulary goes on over white space (this is checked when a model is loaded), so a text's segments are
encoded once each and remembered. Without a character map, and with no U+2581 in the text, the places follow from the pieces' lengths.

Defined cases: a null or empty text has only the end id, no spans and an empty decoded text; rows are independent, so repeated
rows, any order and an empty table need nothing special; other columns are kept out of the digests. Byte pieces of an
unknown character cover one source byte each where it was kept as it is, else the whole span that it came from.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Segments that a task remembers (under 200 MB), and the longest of them.
REMEMBERED = 300_000
REMEMBERED_LENGTH = 64
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6


class CharacterMap:
    """Longest-prefix replacement by a compiled map: a double array of prefixes, then the replacements."""

    def __init__(self, blob: bytes):
        self.units, self.replacements = np.zeros(0, np.uint32), b""
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.units, self.replacements = np.frombuffer(blob[4 : 4 + size], "<u4"), blob[4 + size :]

    def longest(self, source: bytes, at: int) -> tuple[bytes, int]:
        """The replacement of the longest known prefix of source[at:] (or its first character), and the bytes replaced."""
        found = None
        if len(self.units):
            node = self._step(0, int(self.units[0]))
            for i in range(at, len(source)):
                node ^= source[i]
                unit = int(self.units[node])
                if unit & 0x800000FF != source[i]:
                    break
                node = self._step(node, unit)
                if unit >> 8 & 1:
                    found = int(self.units[node]) & 0x7FFFFFFF, i + 1 - at
        if found:
            return self.replacements[found[0] : self.replacements.index(b"\0", found[0])], found[1]
        size = 1 + (source[at] >= 0xC0) + (source[at] >= 0xE0) + (source[at] >= 0xF0)
        return source[at : at + size], size

    @staticmethod
    def _step(node: int, unit: int) -> int:
        return node ^ (unit >> 10 << ((unit & 512) >> 6))


class PieceCodec:
    """Encoding, offsets and decoding by a model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.identity = not spec.precompiled_charsmap and not self.squeeze and self.escape
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = b"", False, False, False
        self.splitter = sentencepiece.SentencePieceProcessor()
        self.splitter.LoadFromSerializedProto(model.SerializeToString())
        self.end = self.splitter.eos_id()
        kinds = [p.type for p in model.pieces]
        texts = [p.piece for p in model.pieces]
        self.unknown = model.trainer_spec.unk_surface
        self.surface = [b"" if k == _CONTROL else bytes([int(t[3:5], 16)]) if k == _BYTE else self.unknown.encode() if k == _UNKNOWN else t.replace(SPACE, " ").encode() for t, k in zip(texts, kinds, strict=True)]
        self.bytes_of = [1 if k == _BYTE else len(t.encode()) for t, k in zip(texts, kinds, strict=True)]
        self.unknown_id = self.splitter.unk_id()
        self.by_bytes = model.trainer_spec.byte_fallback
        joined = [t for t, k in zip(texts, kinds, strict=True) if k != _BYTE and len(t) > 1]
        alone = "".join(c for c in "\n\t\r" if not any(c in t for t in joined))
        parted = not any(re.search(f"[^{SPACE}]{SPACE}", t) for t in joined) and self.by_bytes and not any(k == _USER for k in kinds)
        self.segments = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else "") if parted else "(?s:.+)")
        self.known: dict[str, tuple[str, bytes, str]] = {}

    def normalise(self, text: str) -> tuple[str, list[int]]:
        """The normalised text, and for each of its bytes (and its end) the source byte where what it came from begins."""
        source, out, places, at = text.encode(), bytearray(), [], 0
        if not source:
            return "", [0]
        space = SPACE.encode() if self.escape else b" "
        if self.squeeze:
            while at < len(source):
                new, size = self.map.longest(source, at)
                if new != b" ":
                    break
                at += size
        if at == len(source):
            return "", [at]
        if self.dummy:
            out += space
            places += [at] * len(space)
        after_space = self.squeeze
        while at < len(source):
            new, size = self.map.longest(source, at)
            while after_space and new.startswith(b" "):
                new = new[1:]
            if new:
                kept = new == source[at : at + size] and b" " not in new
                escaped = new.replace(b" ", space)
                out += escaped
                places += range(at, at + size) if kept else [at] * len(escaped)
                after_space = new.endswith(b" ")
            at += size
            if not self.squeeze:
                after_space = False
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                at = places[len(out)]
                del places[len(out) :]
        return out.decode(), [*places, at]

    def _learn(self, segments: set[str]) -> dict[str, tuple[str, bytes, str]]:
        """For each segment: its ids as text, their normalised lengths (int32), and its decoded text."""
        wanted, found = list(segments), {}
        for at in range(0, len(wanted), 5_000):
            part = wanted[at : at + 5_000]
            for segment, ids in zip(part, self.splitter.encode(part, out_type=int, num_threads=1), strict=True):
                lengths = self._lengths(segment, ids)
                decoded = b"".join(map(self.surface.__getitem__, ids)).decode(errors="replace")
                found[segment] = " ".join(map(str, ids)), np.array(lengths, np.int32).tobytes(), decoded
        return found

    def _lengths(self, segment: str, ids: list[int]) -> list[int]:
        if self.unknown_id not in ids:
            return [self.bytes_of[i] for i in ids]
        pieces = self.splitter.encode(segment, out_type=str)
        return [len(p.encode()) if i == self.unknown_id else self.bytes_of[i] for i, p in zip(ids, pieces, strict=True)]

    def _parts(self, texts: list[str]) -> list[list[tuple[str, bytes, str]]]:
        """What `_learn` says of each segment of each normalised text."""
        split = list(map(self.segments.findall, texts))
        if len(self.known) > REMEMBERED:
            self.known = {}
        found = [list(map(self.known.get, x)) for x in split]
        open_rows = [i for i, x in enumerate(found) if None in x]
        if open_rows:
            new = self._learn({s for i in open_rows for s, v in zip(split[i], found[i], strict=True) if v is None})
            for i in open_rows:
                found[i] = [v or new[s] for s, v in zip(split[i], found[i], strict=True)]
            self.known.update((s, v) for s, v in new.items() if len(s) <= REMEMBERED_LENGTH)
        return found

    def encode(self, texts: list[str]) -> list[tuple[str, int, np.ndarray, np.ndarray, str]]:
        """For each text: its ids (with the end id) as decimal numbers, how many, where the pieces' source bytes begin and end, the decoded text.

        The end id has no span. Byte and identity cases are taken from the pieces' lengths, others from `normalise`.
        """
        plain = [self.identity and SPACE not in x for x in texts]
        normal = [(((SPACE if self.dummy else "") + x.replace(" ", SPACE)) if x else "", None) if p else self.normalise(x) for x, p in zip(texts, plain, strict=True)]
        out = []
        for parts, (whole, places) in zip(self._parts([x for x, _ in normal]), normal, strict=True):
            ids, sizes, decoded = zip(*parts, strict=True) if parts else ((), (), ())
            lengths = np.frombuffer(b"".join(sizes), np.int32)
            ends = np.cumsum(lengths, dtype=np.int64)
            if places is None:
                data = np.frombuffer(whole.encode(), np.uint8)
                escaped = np.zeros(len(data) + 1, np.int64)  # each escaped space is two bytes longer than its source
                is_space = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81) if len(data) > 2 else np.zeros(0, bool)
                escaped[3 : 3 + len(is_space)] = np.cumsum(is_space)
                shift = 2 * escaped[ends] + (self.dummy and len(data) > 0)
                stops = ends - shift
                starts = np.concatenate([[0], stops[:-1]]) if len(stops) else stops
            else:
                at = np.array(places, np.int64)
                starts = at[ends - lengths]
                stops = np.maximum(at[ends], starts)
                inner = np.flatnonzero((stops == starts) & (starts < at[-1]) & (ends > 3 * self.dummy))
                for i in inner:  # inside one replacement: the whole span that it came from
                    later = np.flatnonzero(at[ends[i] :] > starts[i])
                    stops[i] = at[ends[i] + later[0]] if len(later) else at[-1]
            decoded = "".join(decoded)
            if self.dummy and decoded.startswith(" "):
                decoded = decoded[1:]
            out.append((" ".join([*ids, str(self.end)]), len(lengths) + 1, starts, stops, decoded))
        return out


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and spans_crc32 (of the pieces' int64 begins, then ends, in source bytes)."""
    state: dict[str, PieceCodec] = {}

    @F.arrow_udf("struct<n:long,ids:string,decoded:string,spans:long>")
    def digests(texts: pa.Array) -> pa.Array:
        if path not in state:
            state[path] = PieceCodec(path)
        rows = []
        texts = pc.fill_null(texts, "")
        for at in range(0, len(texts), 200):
            for ids, n, starts, stops, decoded in state[path].encode(texts.slice(at, 200).to_pylist()):
                rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), zlib.crc32(stops.tobytes(), zlib.crc32(starts.tobytes()))))
        n, ids, decoded, spans = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string()), pa.array(spans, pa.int64())], ["n", "ids", "decoded", "spans"])

    found = docs.select("doc_id", digests(F.col("text")).alias("t"))
    return found.select("doc_id", F.col("t.n").alias("n_tokens"), F.col("t.ids").alias("ids_sha256"), F.col("t.decoded").alias("decoded_sha256"), F.col("t.spans").alias("spans_crc32"))


def encode_with_offsets(docs: DataFrame, path: str, text: str = "text", out: str = "pieces") -> DataFrame:
    """`docs` with a column `out`: array<struct<id:int, begin:long, end:long>>, the pieces with their source byte spans, end id last."""
    state: dict[str, PieceCodec] = {}

    @F.arrow_udf("array<struct<id:int,begin:long,end:long>>")
    def pieces(texts: pa.Array) -> pa.Array:
        if path not in state:
            state[path] = PieceCodec(path)
        ids, begins, ends, sizes = [], [], [], [0]
        texts = pc.fill_null(texts, "")
        for at in range(0, len(texts), 200):
            for source, (found, n, starts, stops, _) in zip(part := texts.slice(at, 200).to_pylist(), state[path].encode(part), strict=True):
                size = len(source.encode())
                ids += map(int, found.split())
                begins += [*starts.tolist(), size]
                ends += [*stops.tolist(), size]
                sizes.append(n)
        values = pa.StructArray.from_arrays([pa.array(ids, pa.int32()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())], ["id", "begin", "end"])
        return pa.ListArray.from_arrays(pa.array(list(accumulate(sizes)), pa.int32()), values)

    return docs.withColumn(out, pieces(F.col(text)))
