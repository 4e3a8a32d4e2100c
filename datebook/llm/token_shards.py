"""Token ids as wavelet matrices: a compressed file for each shard, readable without unpacking it.

Texts are put in the order of their ids by range, encoded, and cut into shards of about ``SHARD_TOKENS``
ids.  A shard's file holds its documents' ids and lengths, the table of its distinct token ids and one
bit plane for each bit of a place in that table.  A plane is cut into frames, each compressed on its own;
a directory has each frame's place in the file and the ones before it.  So a token costs one frame of
each plane: with rank and select one reads any token or document, counts a token up to any place and
finds its occurrences.

The files are the binary rows of a Parquet table in the shared folder, so any store that Spark writes
will do and a task that is run again replaces what it left; :func:`export_shards` gives them as rows
for a sink that wants single files.  A document's start is what its shard has before it, plus the totals
of the shards before in its partition, plus those of the partitions before.

Edge cases: null text is empty text and has the end id alone; ids that repeat follow each other in the
order of their texts; a null id comes first; a text longer than a shard makes a longer shard; an empty
table makes no shard.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from datebook.llm.common import map_rows, table, written
from datebook.llm.wavelet import FRAME, FramedBits, WaveletMatrix

SHARD_TOKENS = 1_000_000
MAGIC = b"WMS2"
_HEAD = struct.Struct("<4sQQBQ")


class TokenShard:
    """Documents' token ids behind a wavelet matrix over the table of distinct ids."""

    def __init__(self, doc_ids: np.ndarray, known: np.ndarray, counts: np.ndarray, table_: np.ndarray, matrix: WaveletMatrix):
        self.doc_ids, self.known, self.counts, self.table, self.matrix = doc_ids, known, counts, table_, matrix
        self.ends = np.cumsum(counts)

    @classmethod
    def of(cls, doc_ids: list[int | None], counts: np.ndarray, tokens: np.ndarray) -> TokenShard:
        seen = np.bincount(tokens) > 0 if len(tokens) else np.zeros(0, bool)
        table_ = np.flatnonzero(seen).astype(np.uint32)
        place = (np.cumsum(seen) - 1).astype(np.uint16 if len(table_) <= 1 << 16 else np.uint32)
        known = np.array([d is not None for d in doc_ids], bool)
        return cls(np.array([d or 0 for d in doc_ids], np.int64), known, counts.astype(np.int64), table_, WaveletMatrix.of(place[tokens], max(1, int(len(table_) - 1).bit_length())))

    def to_bytes(self) -> bytes:
        """Header (magic, tokens, documents, levels, size of the table), directory and zstd sections.

        The directory has the bytes at which each section ends and, for each plane, the ones before each
        frame and in all.  Sections: ids, lengths and table together, then the frames plane by plane.
        """
        size, pack = self.matrix.size, zstandard.ZstdCompressor(level=1).compress
        frames = [[p.words[k : k + FRAME // 64] for k in range(0, len(p.words), FRAME // 64)] for p in self.matrix.planes]
        before = np.array([np.cumsum([0] + [int(np.bitwise_count(f).sum()) for f in plane]) for plane in frames])
        known = b"".join([self.doc_ids.astype("<i8").tobytes(), np.packbits(self.known).tobytes(), self.counts.astype("<i8").tobytes(), self.table.astype("<u4").tobytes()])
        sections = [pack(known), *(pack(f.astype("<u8").tobytes()) for plane in frames for f in plane)]
        head = _HEAD.pack(MAGIC, size, len(self.doc_ids), len(frames), len(self.table))
        return b"".join([head, np.cumsum([len(x) for x in sections]).astype("<i8").tobytes(), before.astype("<i8").tobytes(), *sections])

    @classmethod
    def from_bytes(cls, data: bytes) -> TokenShard:
        """Opens a file; its frames are unpacked one by one as they are asked for."""
        magic, size, docs, levels, distinct = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        n = size // FRAME + 1
        ends = np.frombuffer(data, "<i8", 1 + levels * n, _HEAD.size)
        before = np.frombuffer(data, "<i8", levels * (n + 1), _HEAD.size + ends.nbytes).reshape(levels, n + 1)
        start, unpack = _HEAD.size + ends.nbytes + before.nbytes, zstandard.ZstdDecompressor().decompress

        def section(k: int) -> bytes:
            return unpack(data[start + (int(ends[k - 1]) if k else 0) : start + int(ends[k])])

        body, at = section(0), 0

        def take(kind: str, number: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(body, kind, number, at)
            at += out.nbytes
            return out

        ids, known = take("<i8", docs), np.unpackbits(take("u1", -(-docs // 8)), count=docs).astype(bool)
        counts, table_ = take("<i8", docs), take("<u4", distinct)
        planes = [FramedBits(lambda k, level=level: np.frombuffer(section(1 + level * n + k), "<u8"), before[level], size) for level in range(levels)]
        return cls(ids, known, counts, table_, WaveletMatrix(planes, size))

    def tokens(self) -> np.ndarray:
        """All ids of the shard, in order."""
        return self.table[self.matrix.symbols()] if self.matrix.size else np.zeros(0, np.uint32)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document alone."""
        return self.table[self.matrix.access(np.arange(self.ends[k] - self.counts[k], self.ends[k]))]

    def first_tokens(self) -> np.ndarray:
        """The first id of each document; every document has one."""
        return self.table[self.matrix.access(self.ends - self.counts)]

    def count(self, token: int, upto: int | None = None) -> int:
        """How often ``token`` stands before place ``upto``."""
        return int(self.counts_before(token, np.array([self.matrix.size if upto is None else upto]))[0])

    def counts_before(self, token: int, places: np.ndarray) -> np.ndarray:
        """How often ``token`` stands before each of ``places``."""
        k = int(np.searchsorted(self.table, token))
        if k == len(self.table) or self.table[k] != token:
            return np.zeros(len(places), np.int64)
        return self.matrix.rank(np.full(len(places), k), places)

    def occurrences(self, token: int) -> np.ndarray:
        """The places of ``token``, in order."""
        n = self.count(token)
        return self.matrix.select(int(np.searchsorted(self.table, token)), np.arange(n)) if n else np.zeros(0, np.int64)


#: Ends of a chunk in any text: a space between two characters that aren't white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Two characters in a row that any version of Unicode has as white space.
_WIDE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"
#: Characters on whose class all versions of Unicode agree, and a word of letters among them with a mark or none.
_PLAIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]*")
_WORD = r"^(?P<word> ?[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<mark>[,.;:!?]?)$"


def _strings(strings: pa.StringArray) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


def _taken(flat: np.ndarray, counts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``flat``, cut by ``counts``, one after the other, and their lengths."""
    starts, picked = np.cumsum(counts) - counts, counts[which]
    at = np.repeat(starts[which] - np.cumsum(picked) + picked, picked)
    at += np.arange(len(at))
    return flat[at], picked


class ChunkEncoder:
    """Encodes texts with the tokenizers library, each distinct chunk of a slice once.

    The pattern of a byte-level tokenizer starts a piece at each space between two characters that
    aren't white space, so a text is the sequence of its space-led chunks.  The distinct ones are
    found in Arrow.  A chunk of plain characters is split by the pattern and its pieces go to the
    library's model as they are after its byte mapping; any other chunk, and any text that holds the
    string of an added token, goes to the library whole, and so does every text if the tokenizer isn't a
    byte-level one without normalizer and prefix.
    """

    def __init__(self, path: str, pattern: str):
        # Spark gives a task its share of the cores; threads of the library's own would add their memory to it.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.pattern = Tokenizer.from_file(path), regex.compile(pattern)
        names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, names))) if names else None
        before = self.tokenizer.pre_tokenizer
        self.by_chunk = isinstance(before, pre_tokenizers.ByteLevel) and not before.add_prefix_space and self.tokenizer.normalizer is None
        # The library's byte mapping, read from the library.
        self.bytes = {b: pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(b))[0][0] if b < 128 else None for b in range(128)}
        for b in range(128, 256):
            two = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(b))[0][0]
            for byte, char in zip(chr(b).encode(), two):
                self.bytes[byte] = char

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of ``texts``, each encoded whole."""
        ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(texts), 1000):
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts[at : at + 1000], add_special_tokens=False)]
            counts.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            ids.append(np.fromiter(chain.from_iterable(lists), np.int32, int(counts[-1].sum())))
        return np.concatenate(ids), np.concatenate(counts)

    def chunks(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of ``chunks``."""
        parts = pc.extract_regex(chunks, _WORD)
        simple, rest = pc.is_valid(parts).to_numpy(zero_copy_only=False), pc.is_null(parts)
        words, marks = (parts.filter(pc.is_valid(parts)).field(k).dictionary_encode() for k in (0, 1))
        pieces = _strings(words.dictionary) + _strings(marks.dictionary)
        places, known = {}, len(pieces)
        of_rest, lengths, odd = [], [], []
        plain, split = _PLAIN.fullmatch, self.pattern.findall
        for chunk in _strings(chunks.filter(rest)):
            if plain(chunk):
                found = split(chunk)
                of_rest.extend([places.setdefault(p, known + len(places)) for p in found])
                lengths.append(len(found))
            else:
                of_rest.append(-1 - len(odd))
                lengths.append(1)
                odd.append(chunk)
        model, mapped = self.tokenizer.model.tokenize, self.bytes
        flat, counts = array("i"), array("q")
        for piece in chain(pieces, places):
            tokens = model(piece.encode().decode("latin-1").translate(mapped))
            flat.extend([t.id for t in tokens])
            counts.append(len(tokens))
        odd_flat, odd_counts = self.whole(odd)
        # The codes of all chunks' pieces, in order; an empty mark is a piece of no ids.
        number = np.full(len(chunks), 2)
        number[~simple] = lengths
        first = np.cumsum(number) - number
        codes = np.zeros(number.sum(), np.int64)
        codes[first[simple]] = words.indices.to_numpy()
        codes[first[simple] + 1] = len(words.dictionary) + marks.indices.to_numpy()
        others = np.array(of_rest, np.int64)
        others[others < 0] = len(counts) - 1 - others[others < 0]
        codes[np.repeat(~simple, number)] = others
        flat, per_code = _taken(np.concatenate([np.array(flat, np.int32), odd_flat]), np.concatenate([np.array(counts, np.int64), odd_counts]), codes)
        return flat, np.bincount(np.repeat(np.arange(len(chunks)), number), per_code, minlength=len(chunks)).astype(np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each text."""
        wide = pc.match_substring_regex(pa.array(texts, pa.string()), _WIDE).to_pylist()
        kind = [0 if not t else 3 if not self.by_chunk or self.added and self.added.search(t) else 2 if w else 1 for t, w in zip(texts, wide)]
        groups = [[i for i, k in enumerate(kind) if k == g] for g in range(4)]
        lists = pa.concat_arrays([pc.split_pattern(pa.array([texts[i] for i in groups[1]], pa.string()), " "), pa.array([_CUT.split(texts[i]) for i in groups[2]], pa.list_(pa.string()))])
        names = lists.flatten().dictionary_encode()
        codes, sizes = names.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        first = np.cumsum(sizes) - sizes  # a text's first chunk has no space before it
        firsts = names.dictionary.take(pa.array(codes[first]))
        codes[first] = len(names.dictionary) + np.arange(len(first))
        flat, counts = _taken(*self.chunks(pa.concat_arrays([pc.binary_join_element_wise("", names.dictionary, " "), firsts])), codes)
        per_text = np.bincount(np.repeat(np.arange(len(sizes)), sizes), counts, minlength=len(sizes)).astype(np.int64)
        whole, whole_counts = self.whole([texts[i] for i in groups[3]])
        order = np.argsort(np.array(groups[0] + groups[1] + groups[2] + groups[3], np.int64))
        return _taken(np.concatenate([flat, whole]), np.concatenate([np.zeros(len(groups[0]), np.int64), per_text, whole_counts]), order)


def write_shards(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The written table of shards: ``part, seq, n_docs, n_tokens, payload``.

    ``pattern`` is the one by which the tokenizer splits a text before its merges; a byte-level one has no other.
    """
    # The order is by ranges of the id, so it is total over all partitions; a range of equal ids stays whole.
    ordered = docs.select(F.col(id_col).cast("long"), text_col).repartitionByRange(id_col).sortWithinPartitions(id_col, text_col)

    def work(slices):
        encoder, part = ChunkEncoder(tokenizer_path, pattern), TaskContext.get().partitionId()
        seq, held_ids, held_counts, held_tokens, held = 0, [], [], [], 0

        def flush():
            nonlocal seq, held_ids, held_counts, held_tokens, held
            shard = TokenShard.of(held_ids, np.concatenate(held_counts), np.concatenate(held_tokens))
            row = [[part], [seq], [len(held_ids)], [held], [shard.to_bytes()]]
            seq, held_ids, held_counts, held_tokens, held = seq + 1, [], [], [], 0
            return row

        for ids, texts in slices:
            flat, counts = encoder.encode(texts)
            ends = np.cumsum(counts)
            tokens = np.insert(flat, ends, end_id)
            held_ids.extend(ids)
            held += len(tokens)
            held_counts.append(counts + 1)
            held_tokens.append(tokens)
            if held >= shard_tokens:
                yield flush()
        if held_ids:
            yield flush()

    return written(map_rows(ordered, work, "part int, seq int, n_docs long, n_tokens long, payload binary", 20_000, 16 * shard_tokens), "token-shards")


def shard_starts(shards: DataFrame) -> DataFrame:
    """``part, seq, start``: tokens before each shard.  Only the totals of partitions meet in one place."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    own = shards.select("part", "seq", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")).alias("inside"))
    return own.join(before, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("start"))


def read_documents(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, start, tokens array<int>`` of every document, from the files."""

    def work(slices):
        for part, seq, payload in slices:
            for p, s, data in zip(part, seq, payload):
                shard = TokenShard.from_bytes(data)
                tokens = np.split(shard.tokens(), shard.ends[:-1])
                yield [[p] * len(tokens), [s] * len(tokens), [int(d) if k else None for d, k in zip(shard.doc_ids, shard.known)], shard.ends - shard.counts, tokens]

    rows = map_rows(shards.select("part", "seq", "payload"), work, f"part int, seq int, {id_col} long, inside long, tokens array<int>", 1)
    return rows.join(shard_starts(shards), ["part", "seq"]).select(id_col, (F.col("start") + F.col("inside")).alias("start"), "tokens")


def document_digests(shards: DataFrame, end_id: int, id_col: str = "doc_id") -> DataFrame:
    """``id_col, start, n_tokens, ids_crc32, first_id, n_end_ids`` of every document, from the files.

    The first id is read by access and the number of end ids by rank; the checksum takes all ids in order.
    """

    def work(slices):
        for part, seq, payload in slices:
            for p, s, data in zip(part, seq, payload):
                shard = TokenShard.from_bytes(data)
                raw, ends = shard.tokens().astype("<u4").tobytes(), (4 * shard.ends).tolist()
                n = len(ends)
                ended = np.diff(shard.counts_before(end_id, np.append(0, shard.ends)))
                yield [[p] * n, [s] * n, [int(d) if k else None for d, k in zip(shard.doc_ids, shard.known)], shard.ends - shard.counts, shard.counts, [zlib.crc32(raw[a:b]) for a, b in zip([0, *ends], ends)], shard.first_tokens().astype(np.int64), ended]

    rows = map_rows(shards.select("part", "seq", "payload"), work, f"part int, seq int, {id_col} long, inside long, n_tokens long, ids_crc32 long, first_id long, n_end_ids long", 1)
    return rows.join(shard_starts(shards), ["part", "seq"]).select(id_col, (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "first_id", "n_end_ids")


def token_occurrences(shards: DataFrame, token: int) -> DataFrame:
    """``place``: where a token stands in the whole sequence, by select in each shard."""

    def work(slices):
        for part, seq, payload in slices:
            for p, s, data in zip(part, seq, payload):
                at = TokenShard.from_bytes(data).occurrences(token)
                yield [[p] * len(at), [s] * len(at), at]

    rows = map_rows(shards.select("part", "seq", "payload"), work, "part int, seq int, inside long", 1)
    return rows.join(shard_starts(shards), ["part", "seq"]).select((F.col("start") + F.col("inside")).alias("place"))


def export_shards(shards: DataFrame) -> DataFrame:
    """``name, content``: one file for each shard, named in order."""
    return shards.select(F.format_string("shard-%06d-%06d.wms", "part", "seq").alias("name"), F.col("payload").alias("content"))


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return document_digests(write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 2), 2)
