"""Operator 8: packing documents into training sequences by sum-of-squares online packing."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Tokens of a sequence; the id that ends a document; the vocabulary.
CAPACITY, END, VOCABULARY = 4096, 2, "word_bpe_49k.json"
#: A task keeps the ids of about so many words and so many of their pieces, at most so many partially filled sequences before
#: it closes one by cutting, and about so many bytes of closed ones' ids before it hands them on.
WORDS_KEPT, PIECES_KEPT, OPEN_MOST, BYTES_DONE = 200_000, 100_000, 1024, 4 << 20
#: Words of these characters only, Latin letters and signs, mean the same to the tokenizer's normaliser as to str.lower().
PLAIN = re.compile("[\x21-\x7e\xa1-\u012f\u0131-\u017f]{1,200}")
#: How the vocabulary's file cuts lower-case text, for those characters (a fixed value of the file).
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zª\xb5º\xc0-\xd6\xd8-\xf6\xf8-\u017f]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-zª\xb5º\xc0-\xd6\xd8-\xf6\xf8-\u017f0-9\xb2\xb3\xb9\xbc-\xbe]+")


def _byte_signs() -> dict[int, str]:
    """The signs that byte-level vocabularies write bytes as: printable Latin ones as they are, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and never joins characters across it, so the ids of a text are those of its words, one
    after the other; those of a word are those of its pieces. Ids of words and pieces are kept. New pieces of plain words go
    to the tokenizer's model; other words, and those that may hold a control string, to the whole tokenizer.
    """

    def __init__(self, path: str | None = None) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        self.model = self.tokenizer.model
        self.signs = _byte_signs()
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        signs = text if text.isascii() else "".join(map(self.signs.__getitem__, text.encode("utf-8")))
        ids = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(signs))
        self.pieces[text] = ids
        return ids

    def word(self, raw: bytes) -> bytes:
        text = raw.decode("utf-8")
        if PLAIN.fullmatch(text) and "<|" not in text:
            known = self.pieces
            return b"".join([known.get(p) or self.piece(p) for p in PIECE.findall(text.lower())])
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        w = text.encode("utf-8").split() if text else []
        # Words that came lately stay, so that frequent ones are never made anew.
        if len(self.words) > WORDS_KEPT // 2:
            self.words, self.older = {}, self.words
        if len(self.pieces) > PIECES_KEPT:
            self.pieces.clear()
        known, older = self.words, self.older
        for x in set(w):
            if x not in known:
                known[x] = older.get(x) or self.word(x)
        return b"".join(map(known.__getitem__, w)) + END.to_bytes(4, "little")


class Packer:
    """Places pieces of documents online; closed sequences come out of done.

    level[h] counts the partially filled sequences with h tokens. A piece of s tokens goes to the level h, or to a new
    sequence, for which the sum of the squared counts grows least (among equals to the fullest): many sequences of one level
    are avoided, so that some sequence fits whatever comes. Documents of more than CAPACITY tokens fill whole sequences first.
    When OPEN_MOST are open, the fullest is filled with cut pieces of the emptiest ones and closed; so are those that are still open at the
    end, and the last one's tokens go to sequences whose lengths are powers of two, which need no padding.
    """

    def __init__(self, first: int) -> None:
        self.level = np.zeros(CAPACITY + 1)
        self.level[CAPACITY] = -0.5  # a full sequence counts nothing: the change below is 1 - 2 level[h] for it
        self.open: dict[int, list[list]] = {}
        self.next, self.n_open, self.done, self.held = first, 0, [], 0

    def add(self, doc: object, ids: bytes) -> None:
        n = len(ids) // 4
        whole = n // CAPACITY * CAPACITY
        for at in range(0, whole, CAPACITY):
            self.close([(doc, at, ids[4 * at : 4 * (at + CAPACITY)], n)])
        if whole < n:
            self.place((doc, whole, ids[4 * whole :], n), n - whole)

    def place(self, piece: tuple, s: int) -> None:
        counts = self.level[1 : CAPACITY - s + 1]
        change = np.where(counts > 0, 2 * (self.level[s + 1 :] - counts) + 2, np.inf)
        h = 0
        if len(change):
            last = len(change) - 1 - int(change[::-1].argmin())
            if change[last] < 2 * self.level[s] + 1:
                h = last + 1
        pieces = self.taken(h) if h else []
        pieces.append(piece)
        if h + s == CAPACITY:
            self.close(pieces)
            return
        self.kept(h + s, pieces)
        if self.n_open >= OPEN_MOST:
            self.close_one()

    def close_one(self) -> None:
        """Closes the fullest open sequence: the emptiest ones' pieces, the last of them cut, fill it. The others stay as they are."""
        h = max(k for k, own in self.open.items() if own)
        pieces = self.taken(h)
        while h < CAPACITY and self.n_open:
            low = min(k for k, own in self.open.items() if own)
            give = self.taken(low)
            while give and h < CAPACITY:
                doc, start, ids, n = give.pop()
                take = min(CAPACITY - h, len(ids) // 4)
                pieces.append((doc, start, ids[: 4 * take], n))
                if 4 * take < len(ids):
                    give.append((doc, start + take, ids[4 * take :], n))
                h, low = h + take, low - take
            if give:
                self.kept(low, give)
        if h == CAPACITY:
            self.close(pieces)
        else:
            self.kept(h, pieces)

    def taken(self, h: int) -> list:
        self.level[h] -= 1
        self.n_open -= 1
        return self.open[h].pop()

    def kept(self, h: int, pieces: list) -> None:
        self.open.setdefault(h, []).append(pieces)
        self.level[h] += 1
        self.n_open += 1

    def finish(self) -> None:
        """Fills open sequences with one another's pieces until one is left; its tokens go to sequences of powers of two."""
        while self.n_open > 1:
            self.close_one()
        if self.n_open:
            pieces = self.taken(max(k for k, own in self.open.items() if own))
            left = sum(len(p[2]) // 4 for p in pieces)
            while left:
                room, out = 1 << (left.bit_length() - 1), []
                left -= room
                while room:
                    doc, start, ids, n = pieces.pop(0)
                    take = min(room, len(ids) // 4)
                    out.append((doc, start, ids[: 4 * take], n))
                    if 4 * take < len(ids):
                        pieces.insert(0, (doc, start + take, ids[4 * take :], n))
                    room -= take
                self.close(out)

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, n in pieces:
            self.done.append((doc, start, len(ids) // 4, zlib.crc32(ids), n, self.next, at, ids))
            at += len(ids) // 4
        self.held += 4 * at
        self.next += 1


FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def packed(docs: DataFrame, with_ids: bool = False, vocabulary: str | None = None) -> DataFrame:
    """One row per piece of docs(doc_id, text), with the columns FIELDS and, if asked for, ids (binary, little-endian).

    Each task packs the documents of its partition as they come, so nothing is shuffled and memory holds the open sequences
    only. sequence_id has the partition in its high bits; a task that runs again gives the same rows.
    A null or empty text has the end id alone. Null ids and repeated rows are packed like others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder(vocabulary), Packer(TaskContext.get().partitionId() << 40)
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                packer.add(doc, encoder.encode(text.as_py()))
                if packer.held >= BYTES_DONE or len(packer.done) >= 5_000:
                    yield _rows(packer, with_ids)
        packer.finish()
        yield _rows(packer, with_ids)

    kinds = ", ".join(f"{f} long" for f in FIELDS) + ", ids binary" * with_ids
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, kinds)


def _rows(packer: Packer, with_ids: bool) -> pa.RecordBatch:
    columns = list(zip(*packer.done)) or [()] * 8
    packer.done, packer.held = [], 0
    arrays = [pa.array(c, pa.int64()) for c in columns[:7]] + ([pa.array(columns[7], pa.binary())] if with_ids else [])
    return pa.RecordBatch.from_arrays(arrays, FIELDS + ["ids"] * with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
