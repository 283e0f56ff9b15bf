"""Chat formatting of turns made of typed content parts.

A visitor walks the parts of a turn in order. Text becomes escaped text; image, audio and document parts become
placeholders numbered within the turn, and each leaves an attachment: its kind, its reference and how many tokens
the placeholder stands for once expanded. A turn becomes one fragment; the fragments of a conversation, in order of
turns, are its formatted text. So a conversation of any length is formatted by all machines at once and read back
as a stream, never as one value. Neighbouring text parts are joined before they are escaped, so that no control string
arises where they meet; a placeholder begins with a control and ends with none, so none arises there either.

Controls all contain "<|". Inside texts and roles every backslash is doubled and a backslash is put into each
control string of CONTROLS after its first character; dropping the first backslash of each pair, and every other
one, gives the text back.

Defined cases: a null text, part list, part or role is empty, and a part without a kind is text. A part of a kind that no
method visits becomes a placeholder named "other", and its attachment keeps the kind and counts one token. Sizes that
are missing, not finite or not positive count one unit. Turns are ordered by turn (null first), then role, then text as
it was before escaping; repeated rows are turns of their own. Rows with a null conv_id form one conversation. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"
#: Strings that templates of chat models use as controls; fixed values.
CONTROLS = ("<|", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")
LEARNED = ("assistant",)
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROLS))
_FRAGMENT = re.compile(f"{re.escape(START)}(.*?){re.escape(MESSAGE)}(.*?){re.escape(END)}", re.S)
_PLACEHOLDER = re.compile(r"<\|[a-z]+:(\d+)\|>")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.?)", r"\1", text, flags=re.S)


#: The most that a size of an attachment counts as.
MOST = 1_000_000_000


class Visitor:
    """Flattens the parts of one turn. patch: pixels on a side of what one token of an image covers; per_second and
    per_page: tokens of audio and documents. Parts without a size count one unit, and no size counts as more than MOST."""

    def __init__(self, patch: int = 28, per_second: float = 12.5, per_page: int = 256):
        self.patch, self.per_second, self.per_page = patch, per_second, per_page

    def visit(self, parts: list[dict]) -> tuple[str, list[dict]]:
        out, attachments, said = [], [], []
        for part in [*(p or {} for p in parts), None]:
            kind = (part.get("kind") or "text") if part is not None else None
            if kind == "text":
                said.append(part.get("text") or "")
                continue
            out.append(escape("".join(said)))
            said = []
            if kind is not None:
                tokens = getattr(self, f"visit_{kind}", None)
                attachments.append({"place": len(attachments), "kind": kind, "ref": part.get("ref"), "tokens": tokens(part) if tokens else 1})
                out.append(f"<|{kind if tokens else 'other'}:{attachments[-1]['place']}|>")
        return "".join(out), attachments

    @staticmethod
    def _size(part: dict, name: str, none: float = 1) -> float:
        value = part.get(name)
        return min(value, MOST) if value is not None and math.isfinite(value) and value > 0 else none

    def visit_image(self, part: dict) -> int:
        return math.ceil(self._size(part, "width") / self.patch) * math.ceil(self._size(part, "height") / self.patch)

    def visit_audio(self, part: dict) -> int:
        return max(1, math.ceil(self._size(part, "seconds", 0) * self.per_second))

    def visit_document(self, part: dict) -> int:
        return int(self._size(part, "pages")) * self.per_page


_TURN = pa.struct([("place", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])


def text_parts(text: Column) -> Column:
    """A text as the only part of its turn."""
    none = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("kind"), text.cast("string").alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in none.items())))


def formatted(turns: DataFrame, visitor: Visitor | None = None, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """turns: conv_id, turn, role, parts (array of PART). Returns a fragment for each row, in no order: conv_id,
    turn, role, fragment, loss_start and loss_end (code points of the fragment that are learned, end exclusive, equal
    if none), attachments and added_tokens (what all placeholders expand to)."""
    visitor = visitor or Visitor()
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("fragment", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32()), ("attachments", pa.list_(_TURN)), ("added_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                rows = []
                for row in batch.slice(k, 1000).to_pylist():
                    body, attachments = visitor.visit(row["parts"] or [])
                    head = f"{START}{escape(row['role'] or '')}{MESSAGE}"
                    end = len(head) + len(body) if row["role"] in learned else len(head)
                    rows.append({"conv_id": row["conv_id"], "turn": row["turn"], "role": row["role"], "fragment": head + body + END, "loss_start": len(head), "loss_end": end, "attachments": attachments, "added_tokens": sum(a["tokens"] for a in attachments)})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("parts").cast(f"array<{PART}>").alias("parts"))
    return rows.mapInArrow(run, "conv_id long, turn long, role string, fragment string, loss_start int, loss_end int, attachments array<struct<place:int,kind:string,ref:string,tokens:bigint>>, added_tokens long")


def read_back(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn in a formatted text; placeholders stay in the texts."""
    return [(unescape(role), unescape(body)) for role, body in _FRAGMENT.findall(text)]


def read_parts(body: str) -> list[str | int]:
    """The parts of the body of one turn in a formatted text: texts as they were, and the places of attachments."""
    out: list[str | int] = []
    for i, piece in enumerate(_PLACEHOLDER.split(body)):
        if i % 2:
            out.append(int(piece))
        elif piece:
            out.append(unescape(piece))
    return out


def read_digests(fragments: DataFrame) -> DataFrame:
    """Read conversations back from their fragments: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. Fragments pass in order and only running digests are held; SHA-256 of a whole conversation is
    sequential by definition, so the last step on it is one task's, in constant memory."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: object = run  # no conv_id
        out: list[tuple] = []
        turns = chars = learned = total = 0
        whole = loss = hashlib.sha256()
        for batch in batches:
            for conv, text, start, end in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if conv != at:
                    if turns:
                        out.append((at, turns, whole.hexdigest(), learned, loss.hexdigest(), total))
                    at, turns, learned, total = conv, 0, 0, 0
                    whole, loss = hashlib.sha256(), hashlib.sha256()
                for role, said in read_back(text):
                    turns += 1
                    whole.update(f"{role}\n{said}\n".encode())
                chars = unescape(text[start:end])
                learned += len(chars)
                loss.update(chars.encode())
                total += len(text)
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if turns:
            out.append((at, turns, whole.hexdigest(), learned, loss.hexdigest(), total))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    # loss_start is where the body begins; it is unescaped for the order only after the shuffle.
    body = F.substring(F.col("fragment"), F.col("loss_start") + 1, F.greatest(F.length("fragment") - F.col("loss_start") - len(END), F.lit(0)))
    said = F.regexp_replace(body, r"(?s)\\(.?)", "$1")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), said, F.col("fragment")]
    rows = fragments.select("conv_id", "turn", "role", "fragment", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions(*order)
    return rows.select("conv_id", "fragment", "loss_start", "loss_end").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sql_escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(START + MESSAGE + END)} + length({_sql_escaped('role')}) + length({_sql_escaped('text')}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
