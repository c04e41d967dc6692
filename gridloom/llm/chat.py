"""Chat formatting.

Records come as JSON in any of several layouts. The set of a record's nested field paths is hashed; that fingerprint
selects a declarative mapping, which turns the record into canonical turns (role, text). Turns are written in one
template, whose control strings are escaped inside texts, with the spans that count for the loss; `parse` reads them
back.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, shared_dir, table

OPEN, SEP, CLOSE = "### ", ": ", " </turn>\n"
ROLES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
_HASHES = re.compile("#{3,}")
_NAMES = {v: k for k, v in ROLES.items()}


# --- layouts


@dataclass(frozen=True)
class Mapping:
    """turns: in order, (role, path of the text), or ('*', path of a list) whose items hold a turn each, with the role
    under `role` and the text under `text`; names: role names that stand for canonical ones. Null texts are empty;
    an absent or null text at a path marked with '?' gives no turn."""

    turns: tuple[tuple[str, str], ...]
    role: str = "role"
    text: str = "content"
    names: tuple[tuple[str, str], ...] = ()


_SHARED = (("human", "user"), ("prompter", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
#: Layouts known from the start: field paths (in any order; [] marks list items) and how they map.
LAYOUTS: tuple[tuple[tuple[str, ...], Mapping], ...] = (
    (("role", "text"), Mapping((("*", "."),), text="text", names=_SHARED)),
    (("role", "content"), Mapping((("*", "."),), names=_SHARED)),
    (("messages[].role", "messages[].content"), Mapping((("*", "messages"),), names=_SHARED)),
    (("messages[].role", "messages[].text"), Mapping((("*", "messages"),), text="text", names=_SHARED)),
    (("conversations[].from", "conversations[].value"), Mapping((("*", "conversations"),), "from", "value", _SHARED)),
    (("prompt", "completion"), Mapping((("user", "prompt"), ("assistant", "completion")))),
    (("prompt", "response"), Mapping((("user", "prompt"), ("assistant", "response")))),
    (("system", "prompt", "response"), Mapping((("system", "system?"), ("user", "prompt"), ("assistant", "response")))),
    (("question", "answer"), Mapping((("user", "question"), ("assistant", "answer")))),
    (("instruction", "output"), Mapping((("user", "instruction"), ("assistant", "output")))),
    (("instruction", "input", "output"), Mapping((("user", "instruction"), ("user", "input?"), ("assistant", "output")))),
)


def field_paths(value, at: str = "") -> set[str]:
    if isinstance(value, dict) and value:
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


class Canonical:
    """Selects mappings by fingerprint. Fields that no mapping reads may be declared in `ignored`, by their first
    name, and do not count. A layout without a mapping is an error, or no turns if `skip_unknown`."""

    def __init__(self, layouts=LAYOUTS, ignored: frozenset[str] = frozenset(), skip_unknown: bool = False):
        self.mappings = {fingerprint(paths): m for paths, m in layouts}
        self.empty_lists = {fingerprint([p.split("[]")[0] + "[]"]): m for paths, m in layouts for p in paths if "[]" in p}
        self.ignored, self.skip_unknown = ignored, skip_unknown
        self.known: dict[tuple, Mapping | None] = {}

    def mapping(self, record: dict) -> Mapping | None:
        record = {k: v for k, v in record.items() if k not in self.ignored}
        paths = field_paths(record)
        key = tuple(sorted(paths))
        if key not in self.known:
            print_ = fingerprint(paths)
            found = self.mappings.get(print_) or self.empty_lists.get(print_)
            if found is None and not self.skip_unknown:
                raise ValueError(f"no mapping for the layout {list(key)} (fingerprint {print_})")
            if len(self.known) > 10_000:
                self.known.clear()
            self.known[key] = found
        return self.known[key]

    def turns(self, record: dict) -> list[tuple[str, str]]:
        m = self.mapping(record)
        out: list[tuple[str, str]] = []
        for role, path in m.turns if m else ():
            if role == "*":
                items = [record] if path == "." else record.get(path) or []
                names = dict(m.names)
                for x in items:
                    r = _text(x.get(m.role))
                    out.append((names.get(r, r), _text(x.get(m.text))))
            else:
                value = record.get(path.rstrip("?"))
                if value is not None and value != "" or not path.endswith("?"):
                    out.append((role, _text(value)))
        return out


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


# --- template


def escape(text: str) -> str:
    """No control string stands in the result: a backslash goes before every backslash, before each # of three or more
    in a row, and before < and / of </turn>."""
    return _HASHES.sub(lambda m: "\\#" * len(m[0]), text.replace("\\", "\\\\")).replace("</turn>", "\\<\\/turn>")


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    out = text.split("\\\\")
    return "\\".join(x.replace("\\#", "#").replace("\\<", "<").replace("\\/", "/").replace("\\;", ":") for x in out)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn in the template, and the span of its text within it. A role outside the common four is written as it
    is after '=', escaped, a colon as a backslash and a semicolon."""
    name = ROLES.get(role) or "=" + escape(role).replace(":", "\\;")
    head = f"{OPEN}{name}{SEP}"
    body = escape(text)
    return f"{head}{body}{CLOSE}", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    out = []
    for piece in formatted.split(CLOSE)[:-1]:
        if not piece.startswith(OPEN):
            raise ValueError("a turn does not start with its mark")
        name, _, body = piece[len(OPEN) :].partition(SEP)
        out.append((_NAMES[name] if not name.startswith("=") else unescape(name[1:]), unescape(body)))
    return out


# --- tables


def format_records(records: DataFrame, ignored: frozenset[str] = frozenset()) -> DataFrame:
    """records: conv_id, place (order within the conversation), record (JSON). One row per record, in the template;
    loss_starts and loss_ends list the spans of the assistant's texts, in code points from the row's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical = Canonical(ignored=ignored)
        for batch in batches:
            texts, starts, ends = [], [], []
            for record in batch.column("record").to_pylist():
                parts, a, b, at = [], [], [], 0
                for role, text in canonical.turns(json.loads(record)):
                    piece, low, high = format_turn(role, text)
                    if role == "assistant":
                        a.append(at + low)
                        b.append(at + high)
                    parts.append(piece)
                    at += len(piece)
                texts.append("".join(parts))
                starts.append(a)
                ends.append(b)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("place"), pa.array(texts, pa.string()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))],
                names=["conv_id", "place", "formatted", "loss_starts", "loss_ends"],
            )

    return map_arrow(records.select("conv_id", "place", "record"), run, "conv_id long, place struct<turn:long,role:string,text:string>, formatted string, loss_starts array<int>, loss_ends array<int>")


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Reads formatted conversations back: per conversation the number of turns, digests of the turns and of the text
    under the loss mask, and lengths. Rows stream in order, so a conversation of any length needs no more memory than
    one of its rows; its digest is one sequence and so the work of one task."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = None, None, []

        def close():
            if state:
                done.append((current[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush():
            columns = list(zip(*done, strict=True))
            done.clear()
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            for conv, text, starts, ends in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if current != (conv,):
                    close()
                    current, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for a, b in zip(starts, ends, strict=True):
                    said = unescape(text[a:b])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            if len(done) >= 1000:
                yield flush()
        close()
        if done:
            yield flush()

    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "formatted", "loss_starts", "loss_ends")
    return map_arrow(rows, run, schema)


def op9_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of every conversation and of -7.

    Turns are ordered by turn (null first), then role and text. A null role or text counts as empty; rows with a null
    conv_id are one conversation; repeated rows are turns of their own; other columns are not read."""
    import uuid

    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    probe = "\\### Assistant: </turn> ok"
    rows = rows.unionByName(spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text")))
    records = rows.select("conv_id", F.struct("turn", "role", "text").alias("place"), F.to_json(F.struct("role", "text")).alias("record"))
    path = f"{shared_dir(spark).rstrip('/')}/chat-{uuid.uuid4().hex}"
    format_records(records).write.parquet(path)
    return conversation_digests(spark.read.parquet(path))
