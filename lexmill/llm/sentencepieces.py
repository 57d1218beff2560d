"""SentencePiece encoding and decoding with the byte span of every piece in the original text."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"


class CharacterMap:
    """The compiled character map of a model: a double-array trie from byte prefixes to replacements.

    Layout: 4 bytes length of the trie, its 32-bit units, then the replacements, each ended by a zero byte.
    """

    def __init__(self, blob: bytes) -> None:
        n = int.from_bytes(blob[:4], "little") if blob else 0
        self.units, self.values = array("I"), blob[4 + n :]
        self.units.frombytes(blob[4 : 4 + n])

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of data[at:] that the map has, and what replaces it."""
        units, found = self.units, None
        if not units:
            return None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        end = self.values.index(b"\0", found[1])
        return found[0], self.values[found[1] : end]


class Normalizer:
    """Longest-prefix normalisation that records, for each byte made, the byte of the text that it comes from."""

    def __init__(self, spec) -> None:
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.space = (SPACE if self.escape else " ").encode()

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and an alignment one longer than they are: its last entry is the end of the text."""
        return self._whole(data) if not self.map.units and not self.squeeze else self._mapped(data)

    def _whole(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """No map and no squeezing: spaces alone change, so all bytes are aligned at once."""
        if not data:
            return b"", np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)
        width = np.where(raw == 32, len(self.space), 1)
        align = np.repeat(np.arange(len(raw)), width)
        head = np.zeros(len(self.space) * self.prefix, np.int64)
        return self.space * self.prefix + data.replace(b" ", self.space), np.concatenate([head, align, [len(raw)]])

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        steps: list[tuple[int, int, bytes]] = []
        at = 0
        while at < len(data):
            if hit := self.map.longest(data, at):
                size, made = hit
            else:
                first = data[at]
                size = 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                made = data[at : at + size]
            steps.append((at, size, made))
            at += size
        if self.squeeze:
            while steps and not steps[0][2].strip(b" "):
                steps.pop(0)
        out, align = bytearray(), array("q")
        if self.prefix and steps:
            out += self.space
            align.extend([steps[0][0]] * len(self.space))
        spaced = self.squeeze  # whether a space more would be an extra one
        for at, _, made in steps:
            for byte in made:
                if byte == 32 and spaced:
                    continue
                piece = self.space if byte == 32 else bytes([byte])
                out += piece
                align.extend([at] * len(piece))
                spaced = self.squeeze and byte == 32
        end = steps[-1][0] + steps[-1][1] if steps else 0
        while self.squeeze and out.endswith(self.space):
            end = align[-len(self.space)]
            del out[-len(self.space) :], align[-len(self.space) :]
        align.append(end)
        return bytes(out), np.array(align, np.int64)


class Pieces:
    """Encodes and decodes by a model given as bytes, and projects each piece to the text's own bytes."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.normalizer = Normalizer(proto.normalizer_spec)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        #: bytes of normalised text that each piece covers; a byte piece (type 6) covers one
        self.width = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in proto.pieces], np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1) if texts else []

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.processor.decode(ids, num_threads=1) if ids else []

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each piece in the UTF-8 bytes of the text. A piece for what the text does not have is empty."""
        _, align = self.normalizer(text.encode())
        ends = np.minimum(np.cumsum(self.width[np.array(ids, np.int64)]), len(align) - 1)
        return align[np.concatenate([[0], ends[:-1]])] if ids else ends, align[ends] if ids else ends


@lru_cache(maxsize=2)
def _pieces(model: bytes) -> Pieces:
    return Pieces(model)


def model_bytes(path: str) -> bytes:
    """A vocabulary file, read on the driver (its size is that of a vocabulary, under a few MB) and sent with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def encode_column(text: Column, model: bytes) -> Column:
    """struct<ids, begins, ends, decoded>: the ids of the text, the byte span of each, and the ids decoded.

    Null and empty texts have no ids and decode to the empty text. Lone surrogates cannot be stored by Spark and need no care.
    """

    @F.pandas_udf("ids array<int>, begins array<int>, ends array<int>, decoded string")
    def encoded(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces = _pieces(model)
        for part in parts:
            texts = [t or "" for t in part]
            ids = pieces.encode(texts)
            spans = [pieces.spans(t, i) for t, i in zip(texts, ids, strict=True)]
            yield pd.DataFrame({"ids": ids, "begins": [b for b, _ in spans], "ends": [e for _, e in spans], "decoded": pieces.decode(ids)})

    return encoded(text)


def digest_column(text: Column, model: bytes) -> Column:
    """What encode_column gives, as digests: struct<n_tokens, ids_sha256, decoded_sha256, covered>.

    covered: the spans follow each other without a gap from the first byte of the text to the last.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, covered boolean")
    def digests(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces = _pieces(model)
        name = [str(i) for i in range(len(pieces.width))]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for part in parts:
            texts = [t or "" for t in part]
            rows = []
            for at in range(0, len(texts), 64):
                some = texts[at : at + 64]
                ids = pieces.encode(some)
                for t, own, back in zip(some, ids, pieces.decode(ids), strict=True):
                    begins, ends = pieces.spans(t, own)
                    covered = bool(not own and not t or own and begins[0] == 0 and ends[-1] == len(t.encode()) and (begins[1:] == ends[:-1]).all())
                    rows.append((len(own), sha(",".join([name[i] for i in own])), sha(back), covered))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "covered"])

    return digests(text)


def encode_documents(docs: DataFrame, model: bytes) -> DataFrame:
    """One row a document: doc_id, n_tokens, ids_sha256, decoded_sha256, covered. An empty table gives an empty result; repeated rows repeat."""
    return docs.select("doc_id", digest_column(F.col("text"), model).alias("__e")).select("doc_id", "__e.*")
