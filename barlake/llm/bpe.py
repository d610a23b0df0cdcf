"""BPE encoding and decoding by tables of distinct words.

Spark splits every text into the vocabulary's words.  Each task then keeps a
table of distinct words, encodes each of them once, and joins the ids back by
position with a vectorised take; decoding joins the ids with the vocabulary's
table of pieces.  The table is per task and bounded in bytes, not per corpus:
sending each word occurrence through a shuffle to a corpus-wide table writes
several times the input (figures in the README), and a corpus-wide table grows
with the input, so it can't be broadcast.

Texts travel as one string each, with a mark behind every word: an array of
words would need an object per word in the JVM.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType

from .common import batched, extended

# The code points of Unicode's white space, and the word pattern of byte-level BPE.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WHITE = "".join(rf"\x{{{c:X}}}" for c in WHITE_SPACE)
_CLASS = "".join(map(chr, WHITE_SPACE))
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    + rf"| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)

#: Where a text may be cut: in front of white space that follows anything else.
BOUNDARY = re.compile(rf"[^{_CLASS}](?=[{_CLASS}])")
#: Stands behind each word of a text that Spark has split.
MARK = "\x00"
#: Bytes that a task's table may take, about what an entry takes besides its word, and the longest word (characters) that it holds.
TABLE_BYTES, ENTRY_BYTES, LONGEST_WORD = 48 << 20, 240, 256
#: Bytes of text that are encoded at a time, and characters at which a text that Spark can't split is cut.
SLICE_BYTES, CUT = 2 << 20, 1 << 16


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary's pieces."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces(vocabulary: str) -> list[bytes]:
    """Bytes of every id."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = byte_alphabet()
    table = {i: bytes(alphabet[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
    table |= {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
    return [table.get(i, b"") for i in range(max(table) + 1)]


def special_tokens(vocabulary: str) -> list[str]:
    with open(vocabulary, encoding="utf-8") as f:
        return sorted((x["content"] for x in json.load(f)["added_tokens"]), key=len, reverse=True)


def split_text(text: Column, specials: list[str]) -> tuple[Column, Column]:
    """The text with a mark behind every word, and, instead, the plain text where Spark can't split it.

    It can't where the text holds a special token, the mark, or a character that
    the Java runtime's Unicode version lacks.
    """
    odd = text.contains(MARK) | text.rlike(r"\p{Cn}")
    for s in specials:
        odd = odd | text.contains(s)
    marked = F.regexp_replace(text, F.lit(f"({PATTERN})"), F.lit(f"$1{MARK}"))
    return F.when(~odd, marked), F.when(odd, text)


def cuts(text: str) -> list[str]:
    """A text in parts of about ``CUT`` characters that are encoded like the whole: no word reaches from a letter or sign into white space."""
    out, at = [], 0
    while len(text) - at > CUT:
        m = BOUNDARY.search(text, at + CUT)
        if not m:
            break
        out.append(text[at : m.end()])
        at = m.end()
    return [*out, text[at:]]


class WordTable:
    """The distinct words of the texts so far, and their ids one after the other; it starts anew beyond ``TABLE_BYTES``."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.clear()

    def clear(self):
        self.row: dict[str, int] = {}
        self.bytes = 0
        self.ends = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _encoded(self, words: list[str]) -> list[list[int]]:
        found = []
        for i in range(0, len(words), 4096):
            found += [e.ids for e in self.tokenizer.encode_batch(words[i : i + 4096], add_special_tokens=False)]
        return found

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the (distinct) words, one after the other, and where those of each end."""
        if self.bytes > TABLE_BYTES:
            self.clear()
        new = [w for w in words if w not in self.row and len(w) <= LONGEST_WORD]
        found = self._encoded(new)
        self.row.update(zip(new, range(len(self.row), len(self.row) + len(new))))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in found for i in x), np.int32, int(sizes.sum()))])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.bytes += sum(map(len, new)) + ENTRY_BYTES * len(new) + 4 * int(sizes.sum())
        rows = np.fromiter((self.row.get(w, -1) for w in words), np.int64, len(words))
        long = np.flatnonzero(rows < 0)
        if not len(long):
            return spans(self.ids, self.ends[rows], self.ends[rows + 1])
        more = self._encoded([words[i] for i in long.tolist()])  # never tabled
        flat = np.concatenate([self.ids, np.fromiter((i for x in more for i in x), np.int32)])
        ends = np.cumsum([len(self.ids), *map(len, more)])
        first, last = self.ends[rows], self.ends[np.minimum(rows + 1, len(self.ends) - 1)]
        first[long], last[long] = ends[:-1], ends[1:]
        return spans(flat, first, last)


def spans(flat: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts [first, last) of ``flat`` one after the other, and the bounds of each."""
    sizes = last - first
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])], ends


def _tokenizer(vocabulary: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    t.no_truncation()
    t.no_padding()
    return t


def _text_slices(batch: pa.RecordBatch):
    """Parts of a batch of about ``SLICE_BYTES`` of text, a row at least."""
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("__marked", "__odd"))
    part = np.cumsum(sizes) // SLICE_BYTES
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: str):
    """For parts of the batches: the part, the ids of its texts one after the other, and the bounds of each text among them."""
    table = WordTable(_tokenizer(vocabulary))
    for whole in batches:
        for batch in _text_slices(whole):
            lists = pc.split_pattern(pc.fill_null(batch.column("__marked"), ""), MARK)
            words = lists.flatten().dictionary_encode()
            flat, ends = table.ids_of(words.dictionary.to_pylist())
            at = np.asarray(words.indices).astype(np.int64)
            ids, word_ends = spans(flat, ends[at], ends[at + 1])
            bounds = word_ends[np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()]
            odd = np.flatnonzero(batch.column("__odd").is_valid().to_numpy(zero_copy_only=False))
            if len(odd):
                own = np.split(ids, bounds[1:-1])
                for k in odd.tolist():
                    parts = [table.tokenizer.encode(c, add_special_tokens=False).ids for c in cuts(batch.column("__odd")[k].as_py())]
                    own[k] = np.concatenate([np.array(p, np.int32) for p in parts])
                ids, bounds = np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])
            yield batch, ids, bounds
        pa.default_memory_pool().release_unused()


def _split(docs: DataFrame, keep: list[Column], text_col: str, vocabulary: str) -> DataFrame:
    marked, odd = split_text(F.col(text_col), special_tokens(vocabulary))
    return batched(docs).select(*keep, marked.alias("__marked"), odd.alias("__odd"))


def encode(docs: DataFrame, vocabulary: str, *, text_col: str = "text", ids_col: str = "ids", keep_text: bool = True) -> DataFrame:
    """Add the ids of every whole text as ``array<int>``.

    Null and empty texts have no ids, repeated rows get equal ones, and an empty
    table stays empty.  A column named ``ids_col`` is replaced; without
    ``keep_text`` the text is left out, and columns starting with ``__`` are
    reserved.  A text needs memory for a few times its own size, a task no more
    than its longest text, a part of ``SLICE_BYTES`` and the table.
    """
    gone = [ids_col.lower()] + [text_col.lower()] * (not keep_text)
    keep = [c for c in docs.columns if c.lower() not in gone]
    schema = extended(docs.select(*[F.col(f"`{c}`") for c in keep]), **{ids_col: ArrayType(IntegerType())})

    def run(batches):
        for batch, ids, bounds in _encoded(batches, vocabulary):
            values = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], values], names=[*keep, ids_col])

    return _split(docs, [F.col(f"`{c}`") for c in keep], text_col, vocabulary).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str, *, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Replace or add ``text_col``: the text of ``ids_col``, by a join of ids and pieces.

    Null ids give an empty text, ids outside of the vocabulary give nothing, and bytes that aren't UTF-8 become U+FFFD.
    Repeated rows get equal texts and an empty table stays empty.
    """
    keep = [c for c in encoded.columns if c.lower() != text_col.lower()]
    schema = extended(encoded.select(*[F.col(f"`{c}`") for c in keep]), **{text_col: StringType()})

    def run(batches):
        piece = pieces(vocabulary)
        for batch in batches:
            lists = batch.column(batch.schema.names.index(ids_col)).to_pylist()
            texts = [b"".join([piece[i] for i in x or () if i is not None and 0 <= i < len(piece)]).decode("utf-8", "replace") for x in lists]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.names.index(c)) for c in keep], pa.array(texts, pa.string())], names=[*keep, text_col])

    return batched(encoded).mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text and return its id, number of ids, and hashes of ids and decoded text.

    ``ids_sha256`` is of the decimal ids joined by commas, ``decoded_sha256`` of
    the decoded text in UTF-8.  Nothing of the size of the texts leaves a task.
    Null and empty texts have no ids and decode to an empty text, repeated rows
    give one row each, an empty table stays empty, and other columns are left out.
    """
    schema = extended(docs.select(F.col(id_col).alias("doc_id")), n_tokens=LongType(), ids_sha256=StringType(), decoded_sha256=StringType())

    def run(batches):
        piece = pieces(vocabulary)
        decimals, piece_bytes = pa.array([str(i) for i in range(len(piece))]), pa.array(piece, pa.binary())
        for batch, ids, bounds in _encoded(batches, vocabulary):
            texts = pa.array(bounds, pa.int32())
            listed = pc.binary_join(pa.ListArray.from_arrays(texts, decimals.take(pa.array(ids))), ",")
            decoded = pc.binary_join(pa.ListArray.from_arrays(texts, piece_bytes.take(pa.array(ids))), b"")
            hashes = [hashlib.sha256(x.as_buffer()).hexdigest() for x in listed]
            # bytes that aren't UTF-8 become U+FFFD, as in a decoder's text
            back = [hashlib.sha256(x.as_py().decode("utf-8", "replace").encode()).hexdigest() for x in decoded]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _split(docs, [F.col(id_col).alias("doc_id")], text_col, vocabulary).mapInArrow(run, schema)
