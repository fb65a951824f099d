"""Chat formatting: records of many layouts to canonical turns, and turns to one marked text.

A record's schema fingerprint is a hash of its nested field paths. It selects a declarative
mapping: where the turns are, and which fields of a turn give role and text, or which fields of
the record are turns of which role. Canonical turns are written with a template whose control
strings can't occur inside a turn: a backslash breaks up any that a text holds, and backslashes
are doubled, so that the text can be read back.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table

# Strings that chat templates use as controls.
CONTROLS = ("<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
START, END = CONTROLS[:2]
_BREAK = re.compile(r"(\\)|(.)(?<=(?=" + "|".join(map(re.escape, CONTROLS)) + r").)", re.DOTALL)
_UNBREAK = re.compile(r"\\(\\?)")
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns: ``turns`` is the path of a list whose items have ``role`` and
    ``text``; or ``fields`` are (role, path) of the record, those of a role joined by blank lines. ``rename``:
    other names of the roles are replaced."""

    turns: str | None = None
    role: str = ""
    text: str = ""
    rename: bool = True
    fields: tuple[tuple[str, str], ...] = ()


#: Layouts by their paths; list items are marked ``[]``.
LAYOUTS: dict[tuple[str, ...], Mapping] = {
    ("messages[].content", "messages[].role"): Mapping(turns="messages", role="role", text="content"),
    ("conversations[].from", "conversations[].value"): Mapping(turns="conversations", role="from", text="value"),
    ("turns[].role", "turns[].text"): Mapping(turns="turns", role="role", text="text", rename=False),
    ("turns[].role", "turns[].text", "turns[].turn"): Mapping(turns="turns", role="role", text="text", rename=False),
    ("completion", "prompt"): Mapping(fields=(("user", "prompt"), ("assistant", "completion"))),
    ("prompt", "response"): Mapping(fields=(("user", "prompt"), ("assistant", "response"))),
    ("instruction", "output"): Mapping(fields=(("user", "instruction"), ("assistant", "output"))),
    ("input", "instruction", "output"): Mapping(fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    ("input", "instruction", "output", "system"): Mapping(fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
}
# Other names of the roles.
ROLES = {"human": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant", "chatgpt": "assistant"}


def fingerprint(paths: tuple[str, ...] | list[str]) -> str:
    """Hash of the sorted field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode(errors="replace")).hexdigest()[:16]


MAPPINGS = {fingerprint(paths): mapping for paths, mapping in LAYOUTS.items()}


def value_paths(value, at: str = "") -> set[str]:
    """Leaf paths of a JSON value; an empty list or object is a leaf."""
    if isinstance(value, dict) and value:
        return set().union(*(value_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(value_paths(v, f"{at}[]") for v in value))
    return {at}


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """Leaf paths of a column type."""
    if isinstance(kind, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind)) if len(kind) else {at}
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return {at}


def _text(value) -> str:
    """A value as text: JSON but for a string; half a surrogate pair becomes U+FFFD."""
    text = "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def turns_of(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    if mapping.turns is not None:
        items = record.get(mapping.turns)
        turns = [(_text(x.get(mapping.role)), _text(x.get(mapping.text))) for x in ([] if items is None else items) if x is not None]
        return [(ROLES.get(role, role), text) for role, text in turns] if mapping.rename else turns
    turns: list[list] = []
    for role, path in mapping.fields:
        text = _text(record.get(path))
        if turns and turns[-1][0] == role:
            turns[-1][1] = "\n\n".join(x for x in (turns[-1][1], text) if x)
        elif text or role != "system":
            turns.append([role, text])
    return [tuple(t) for t in turns]


def escaped(text: str) -> str:
    return _BREAK.sub(lambda m: "\\\\" if m[1] else m[2] + "\\", text)


def unescaped(text: str) -> str:
    return _UNBREAK.sub(r"\1", text)


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[list[int]]]:
    """The marked text, and the (start, end) code points of the texts to be learnt: the assistant's."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body, tail = f"{START}{escaped(role).replace(chr(10), chr(92) + 'n')}\n", escaped(text), f"{END}\n"
        if role == "assistant":
            spans.append([at + len(head), at + len(head) + len(body)])
        parts += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(parts), spans


def parsed(text: str) -> list[tuple[str, str]]:
    """Turns of a marked text, as they were before it was marked."""
    return [(unescaped(_newlines(role)), unescaped(body)) for role, body in _TURN.findall(text)]


def _newlines(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[0], role, flags=re.DOTALL)


_FORMATTED = "struct<fingerprint:string,known:boolean,formatted:string,loss_spans:array<array<long>>,n_turns:long>"


def _formatter(paths: set[str] | None):
    """A pandas UDF from records (JSON, or structs of one schema) to formatted texts."""
    fixed = None if paths is None else fingerprint(paths)

    def one(record) -> tuple:
        if record is None:
            return fixed or fingerprint([""]), False, None, None, 0
        if fixed is None:
            try:
                record = json.loads(record)
                found = fingerprint(value_paths(record))
            except (ValueError, RecursionError):
                record, found = None, fingerprint([""])
        else:
            found = fixed
        mapping = MAPPINGS.get(found)
        if mapping is None or not isinstance(record, dict):
            return found, False, None, None, 0
        turns = turns_of(record, mapping)
        text, spans = formatted(turns)
        return found, True, text, spans, len(turns)

    def every(batches: Iterator[pd.Series | pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for records in batches:
            rows = records.to_dict("records") if isinstance(records, pd.DataFrame) else records
            yield pd.DataFrame([one(r) for r in rows], columns=["fingerprint", "known", "formatted", "loss_spans", "n_turns"])

    return every


def format_json(records: DataFrame, column: str = "record") -> DataFrame:
    """``records`` with ``fingerprint, known, formatted, loss_spans, n_turns`` for the JSON object
    in ``column``; columns of those names are replaced.

    Each record's own field paths select its mapping, so layouts may be mixed. A record that is
    null, no JSON object, nested too deeply to be read, or of a layout without mapping is kept with
    known false and no text; null texts inside a known one are empty, halves of surrogate pairs are
    U+FFFD. Rows that repeat stay.
    """

    @F.pandas_udf(_FORMATTED)
    def formats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _formatter(None)(batches)

    return _spread(records, formats(F.col(f"`{column}`")))


def format_turns(records: DataFrame, column: str) -> DataFrame:
    """As ``format_json`` for a struct column, whose type's field paths select the mapping for all."""
    work = _formatter(schema_paths(records.schema[column].dataType))

    @F.pandas_udf(_FORMATTED)
    def formats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from work(batches)

    return _spread(records, formats(F.col(f"`{column}`")))


def _spread(records: DataFrame, result: Column) -> DataFrame:
    own = ["fingerprint", "known", "formatted", "loss_spans", "n_turns"]
    kept = [c for c in records.columns if c not in own]
    done = records.select(*(F.col(f"`{c}`") for c in kept), result.alias("__done"))
    return done.select(*(F.col(f"`{c}`") for c in kept), *(F.col(f"__done.{c}") for c in own))


def grouped_turns(rows: DataFrame) -> DataFrame:
    """``(conv_id, record)`` from ``rows(conv_id, turn, role, text)``: turns in the order of turn,
    role and text, nulls first. A conversation is one output text and so one row. Turns of a null
    conv_id are one conversation of that id."""
    turn = F.struct("turn", "role", "text")
    ordered = F.array_sort(F.collect_list(turn))
    return rows.groupBy("conv_id").agg(F.struct(ordered.alias("turns")).alias("record"))


def laid_out(rows: DataFrame) -> DataFrame:
    """``(conv_id, record)``: each conversation of ``grouped_turns`` as a JSON object. One turn of a
    user and one of an assistant are a prompt and its response, any other a list of turns; null
    roles and texts are empty."""
    turns = F.transform("record.turns", lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    grouped = grouped_turns(rows).select("conv_id", turns.alias("turns"))
    pair = F.transform("turns", lambda t: t["role"]) == F.array(F.lit("user"), F.lit("assistant"))
    said = lambda k: F.col("turns")[k]["text"]
    return grouped.select("conv_id", F.when(pair, F.to_json(F.struct(said(0).alias("prompt"), said(1).alias("response")))).otherwise(F.to_json(F.struct("turns"))).alias("record"))


def read_back(text: Column, spans: Column) -> Column:
    """Struct of digests of the turns, and of the text under the loss mask, of a formatted text;
    its fields are null for a null text."""
    kind = "struct<n_turns:long,turns_sha256:string,loss_chars:long,loss_sha256:string,formatted_chars:long>"

    @F.pandas_udf(kind)
    def digests(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, masks in batches:
            out = []
            for t, mask in zip(texts, masks, strict=True):
                if t is None:
                    out.append((None,) * 5)
                    continue
                turns = parsed(t)
                loss = "".join(unescaped(t[a:b]) for a, b in mask)
                whole = "".join(f"{role}\n{body}\n" for role, body in turns)
                out.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(t)))
            yield pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], dtype=object)

    return digests(text, spans)


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    done = format_json(laid_out(rows.union(extra)))
    return done.select("conv_id", read_back(F.col("formatted"), F.col("loss_spans")).alias("d")).select("conv_id", "d.*")


# Escapes add a character for each control string and each backslash of a text. None of the strings
# holds another or begins as another ends, so each kind is counted by what its removal takes off.
_SQL_COUNT = " + ".join(f"(length(text) - length(replace(text, '{c}', ''))) // {len(c)}" for c in (*CONTROLS, "\\"))
OP6_SQL = rf"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(text) + {len(START) + len(END) + 2} + {_SQL_COUNT}) AS BIGINT) AS formatted_chars
FROM every GROUP BY conv_id
"""
