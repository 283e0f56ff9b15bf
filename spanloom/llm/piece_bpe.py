"""SentencePiece encoding and decoding by a table of last tokens.

For every prefix of a text exactly one vocabulary entry ends its encoding. An automaton reports the pieces that end
at each position; a piece is the last token if merging it with the last token of the prefix before it gives back
just these two (tested by replaying the merges of the pair, and remembered). Walking back from the end of the table
yields the ids. Nothing but the table is needed, so the work is linear in the text.

No piece has a space after another character, so a text is cut before each run of spaces and around characters
that only bytes can encode, and a worker remembers the encodings of recent cuts. Characters without a piece come
out as their UTF-8 bytes.

Defined cases: null text counts as empty, which has no tokens. A literal U+2581 reads as a space, as the library
has it. Long cuts are encoded in full. Repeated rows and other columns are kept as they come.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import lean, slices

SPACE = "▁"
#: Entries that a worker remembers before it starts anew.
CUTS, PAIRS = 250_000, 200_000
LONGEST_CUT = 64


def read_model(path: str) -> bytes:
    """The model file is read where the job is planned; tasks get its bytes."""
    with open(path, "rb") as file:
        return file.read()


class PieceTable:
    """Encoder and decoder for one BPE model with a byte for each unknown one, a space put in front and texts left as they are."""

    def __init__(self, model: bytes):
        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        if lib.normalize("  ﬁ  b ") != f"{SPACE * 3}ﬁ{SPACE * 2}b{SPACE}":
            raise ValueError("the model changes texts before it encodes them")
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.bytes_of: dict[str, bytes] = {}
        self.byte_id = [0] * 256
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[str(i)] = bytes([int(piece[3:5], 16)])
            elif lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i):
                self.bytes_of[str(i)] = b""
            else:
                self.id[piece], self.score[piece] = i, lib.get_score(i)
                self.bytes_of[str(i)] = piece.replace(SPACE, " ").encode()
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("the model has a piece with a space inside")
        if not all(self.byte_id):
            raise ValueError("the model has no piece for some bytes")
        self.automaton = ahocorasick.Automaton()
        for piece in self.id:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        alone = "".join(c for c in "\t\n\r" if not any(c in p for p in self.id))
        self.cutter = re.compile(rf"[{alone}]| *[^ {alone}]+| +" if alone else " *[^ ]+| +")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.cuts: dict[str, str] = {}

    def merged(self, text: str) -> list[str]:
        """Replay: join the neighbours that make the best piece, the leftmost of equals, until none make one."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, before: str, last: str) -> bool:
        """Whether `last` stays whole after `before`; before is empty at the start of a cut."""
        got = self.pairs.get((before, last))
        if got is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            got = self.merged(before + last) == ([before, last] if before else [last])
            self.pairs[before, last] = got
        return got

    def pieces(self, cut: str) -> list[str]:
        """The pieces of a cut whose spaces are marked."""
        table: list[str] = []  # the last piece of each prefix
        found = self.automaton.iter(cut)
        end, piece = next(found, (-1, ""))
        for i, char in enumerate(cut):
            last = ""
            while end == i:
                start = i + 1 - len(piece)
                if not last and self.fits(table[start - 1] if start else "", piece):
                    last = piece
                end, piece = next(found, (-1, ""))
            table.append(last or char)  # a character without a piece joins nothing
        out, i = [], len(cut)
        while i:
            out.append(table[i - 1])
            i -= len(table[i - 1])
        return out[::-1]

    def cut_ids(self, cut: str) -> str:
        """Decimal ids of a cut, joined by commas."""
        out: list[int] = []
        for piece in self.pieces(cut.replace(" ", SPACE)):
            if (i := self.id.get(piece)) is not None:
                out.append(i)
            else:
                out += [self.byte_id[b] for b in piece.encode()]
        ids = ",".join(map(str, out))
        if len(cut) <= LONGEST_CUT:
            if len(self.cuts) >= CUTS:
                self.cuts.clear()
            self.cuts[cut] = ids
        return ids

    def encode(self, text: str | None) -> str:
        """Decimal ids of a text, joined by commas; an empty string if there are none."""
        if not text:
            return ""
        known, cuts = self.cuts.get, self.cutter.findall(" " + text.replace(SPACE, " "))
        return ",".join([known(cut) or self.cut_ids(cut) for cut in cuts])

    def decode(self, ids: str) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, ids.split(","))) if ids else b""
        return raw.removeprefix(b" ").decode("utf-8", "replace")


_TABLES: dict[bytes, PieceTable] = {}


def table_for(model: bytes) -> PieceTable:
    """One table a worker: what it remembers serves all its tasks."""
    key = hashlib.sha256(model).digest()
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = PieceTable(model)
    return _TABLES[key]


def n_ids(ids: str) -> int:
    return ids.count(",") + 1 if ids else 0


def encoded(docs: DataFrame, model: bytes, ids: bool = True, decoded: bool = True, digests: bool = False) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_tokens and, as asked, ids (array of int) and decoded (string), or the
    hex SHA-256 of either in ids_sha256 and decoded_sha256, made before anything leaves the task."""
    lean(docs.sparkSession)
    kept = docs.sparkSession.sparkContext.broadcast(model)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    columns = [("doc_id", "long", pa.int64()), ("n_tokens", "long", pa.int64())]
    if ids:
        columns.append(("ids_sha256", "string", pa.string()) if digests else ("ids", "array<int>", pa.list_(pa.int32())))
    if decoded:
        columns.append(("decoded_sha256" if digests else "decoded", "string", pa.string()))
    schema = pa.schema([(n, t) for n, _, t in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_for(kept.value)
        for batch in batches:
            for piece in slices(batch, "text"):
                got = [table.encode(x) for x in piece.column(1).to_pylist()]
                out = [piece.column(0), pa.array(map(n_ids, got), pa.int64())]
                if ids:
                    out.append(pa.array([digest(x) for x in got] if digests else [[int(i) for i in x.split(",")] if x else [] for x in got], columns[2][2]))
                if decoded:
                    texts = map(table.decode, got)
                    out.append(pa.array([digest(x) for x in texts] if digests else list(texts), pa.string()))
                yield pa.record_batch(out, schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t, _ in columns))
