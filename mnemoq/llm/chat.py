r"""Chat formatting: a compiler for a sandboxed template language. A template is parsed into a syntax
tree, constants are folded, and Python closures are generated that render the turns of a
conversation and mark what the model is to generate.

The language: text, ``{{ name }}`` (role, text, turn, with filters ``|esc`` ``|name`` ``|upper`` ``|trim``),
``{% if name == "x" %} .. {% elif .. %} .. {% else %} .. {% endif %}`` and
``{% generation %} .. {% endgeneration %}``. There are no calls, attributes, loops or imports: a template
can only read the fields of the turn it renders. Unknown names and unclosed blocks are errors when
the template is compiled.

``|esc`` escapes reversibly: control strings (the marks of the template) and backslashes in texts get a
backslash before their first character, so no text can close a turn. ``|name`` is for roles, which a colon ends: it
escapes colons, too.

Spark deals the rows by conversation and sorts them by turn within the tasks; a task streams through
its rows and holds one turn of its current conversation at a time, so a long conversation needs no
more memory than a short one.

Defined cases: null text is empty, null role is an empty string; null turns come first; turns that
tie are ordered by role, then text; repeated rows are turns of their own; very long texts are whole; an empty table
gives no rows; only the four columns are read, so that others can't clash; conv_id may be of any type.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, table

MARKS = ("### System:", "### User:", "### Assistant:", "</turn>")
TEMPLATE = (
    '{% if role == "system" %}### System:{% elif role == "user" %}### User:{% elif role == "assistant" %}### Assistant:{% else %}### Role {{ role|name }}:{% endif %} '
    '{% if role == "assistant" %}{% generation %}{{ text|esc }}{% endgeneration %}{% else %}{{ text|esc }}{% endif %}</turn>\n'
)
NAMES = ("role", "text", "turn")


# ---- syntax tree ---------------------------------------------------------------------------------
@dataclass
class Text:
    value: str


@dataclass
class Value:
    name: str
    filters: tuple[str, ...]


@dataclass
class If:
    arms: list[tuple[tuple[str, str, str] | bool, list]] = field(default_factory=list)  # (name, op, literal) or a constant


@dataclass
class Generation:
    body: list


_TOKEN = re.compile(r"\{\{\s*(?P<value>.*?)\s*\}\}|\{%\s*(?P<tag>.*?)\s*%\}", re.S)
_VALUE = re.compile(r'(?:(?P<name>[a-z]+)|"(?P<const>[^"]*)")(?P<filters>(?:\|[a-z]+)*)$')
_COND = re.compile(r'(?:(?P<name>[a-z]+)|"(?P<left>[^"]*)")\s*(?P<op>==|!=)\s*"(?P<right>[^"]*)"$')


def parse(template: str) -> list:
    root: list = []
    stack: list[tuple[object, list]] = [(None, root)]
    at = 0
    for m in _TOKEN.finditer(template):
        if m.start() > at:
            stack[-1][1].append(Text(template[at : m.start()]))
        at = m.end()
        if m["value"] is not None:
            v = _VALUE.match(m["value"])
            if not v or v["name"] and v["name"] not in NAMES:
                raise ValueError(f"not a value: {m['value']!r}")
            filters = tuple(v["filters"].split("|")[1:])
            if bad := [f for f in filters if f not in ("esc", "name", "upper", "trim")]:
                raise ValueError(f"unknown filter: {bad[0]}")
            stack[-1][1].append(Value(v["name"], filters) if v["name"] else Value('"' + v["const"], filters))
            continue
        word, _, rest = m["tag"].partition(" ")
        top = stack[-1][0]
        if word == "if":
            node = If([(_condition(rest), [])])
            stack[-1][1].append(node)
            stack.append((node, node.arms[-1][1]))
        elif word in ("elif", "else") and isinstance(top, If):
            top.arms.append((_condition(rest) if word == "elif" else True, []))
            stack[-1] = (top, top.arms[-1][1])
        elif word == "generation":
            if any(isinstance(n, Generation) for n, _ in stack):
                raise ValueError("generation blocks don't nest")
            gen = Generation([])
            stack[-1][1].append(gen)
            stack.append((gen, gen.body))
        elif word == "endif" and isinstance(top, If) or word == "endgeneration" and isinstance(top, Generation):
            stack.pop()
        else:
            raise ValueError(f"misplaced tag: {m['tag']!r}")
    if len(stack) > 1:
        raise ValueError("a block is not closed")
    if at < len(template):
        root.append(Text(template[at:]))
    return root


def _condition(source: str) -> tuple[str, str, str] | bool:
    m = _COND.match(source.strip())
    if not m or m["name"] and m["name"] not in NAMES:
        raise ValueError(f"not a condition: {source!r}")
    return (m["name"], m["op"], m["right"]) if m["name"] else (m["left"] == m["right"]) == (m["op"] == "==")


def fold(nodes: list, filters: dict[str, Callable[[str], str]]) -> list:
    """Constants become text, neighbouring texts one text; arms that can't be reached go."""
    out: list = []
    for n in nodes:
        if isinstance(n, Value) and n.name.startswith('"'):
            value = n.name[1:]
            for f in n.filters:
                value = filters[f](value)
            n = Text(value)
        elif isinstance(n, Generation):
            n = Generation(fold(n.body, filters))
        elif isinstance(n, If):
            arms = []
            for c, body in n.arms:
                if c is not False:
                    arms.append((c, fold(body, filters)))
                if c is True:
                    break
            if arms and arms[0][0] is True:
                out += arms[0][1]
                continue
            n = If(arms)
        if isinstance(n, Text) and out and isinstance(out[-1], Text):
            out[-1] = Text(out[-1].value + n.value)
        elif not (isinstance(n, Text) and not n.value or isinstance(n, If) and not n.arms):
            out.append(n)
    return out


def compile_template(template: str, marks: tuple[str, ...] = MARKS) -> Callable[[dict], list[tuple[str, bool]]]:
    """A function from a turn (role, text, turn) to its pieces: (text, whether the model generates it)."""
    filters: dict[str, Callable[[str], str]] = {"esc": escaper(marks), "name": lambda s: escaper(marks)(s).replace(":", r"\:"), "upper": str.upper, "trim": str.strip}

    def closure(nodes: list, mask: bool) -> Callable[[dict, list], None]:
        steps: list[Callable[[dict, list], None]] = []
        for n in nodes:
            if isinstance(n, Text):
                steps.append(lambda _, out, piece=(n.value, mask): out.append(piece))
            elif isinstance(n, Value):
                fs = tuple(filters[f] for f in n.filters)

                def value(turn, out, name=n.name, fs=fs):
                    s = str(turn[name])
                    for f in fs:
                        s = f(s)
                    out.append((s, mask))

                steps.append(value)
            elif isinstance(n, Generation):
                steps.append(closure(n.body, True))
            else:
                arms = [(c, closure(body, mask)) for c, body in n.arms]

                def choose(turn, out, arms=arms):
                    for c, then in arms:
                        if c is True or (str(turn[c[0]]) == c[2]) == (c[1] == "=="):
                            return then(turn, out)

                steps.append(choose)

        def run(turn, out):
            for s in steps:
                s(turn, out)

        return run

    render = closure(fold(parse(template), filters), False)

    def rendered(turn: dict) -> list[tuple[str, bool]]:
        out: list[tuple[str, bool]] = []
        render(turn, out)
        return out

    return rendered


def escaper(marks: tuple[str, ...]) -> Callable[[str], str]:
    """A backslash before each backslash and before the first character of each mark."""
    find = re.compile("|".join([r"\\", *map(re.escape, sorted(marks, key=len, reverse=True))]))
    return lambda s: find.sub(lambda m: "\\" + m[0], s)


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


# ---- jobs ----------------------------------------------------------------------------------------
def format_turns(conversations: DataFrame, template: str = TEMPLATE, marks: tuple[str, ...] = MARKS) -> DataFrame:
    """(conv_id, turn, pieces): each row rendered, as an array of (text, mask); in order within each conversation.

    ``first`` marks the first row of its conversation, as the task streams them.
    """
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, marks)
        for b in batches_of(batches):
            ids, turns = b.column("conv_id"), b.column("turn")
            pieces = [render({"role": r, "text": t, "turn": n}) for r, t, n in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), turns.to_pylist(), strict=True)]
            rows = [[{"text": s, "mask": m} for s, m in p] for p in pieces]
            yield pa.RecordBatch.from_arrays([ids, turns, pa.array(rows, pa.list_(pa.struct([("text", pa.string()), ("mask", pa.bool_())])))], names=["conv_id", "turn", "pieces"])

    dealt = c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    pieces = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("mask", T.BooleanType())]))
    return dealt.mapInArrow(run, T.StructType([c.schema["conv_id"], c.schema["turn"], T.StructField("pieces", pieces)]))


_TURN = re.compile(r"### (?P<role>(?:\\.|[^\\:])*): (?P<text>(?:\\.|[^\\])*?)</turn>\n", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in formatted text of the standard template; the reverse of rendering."""
    out = [(m["role"], unescape(m["text"])) for m in _TURN.finditer(formatted)]
    names = {"System": "system", "User": "user", "Assistant": "assistant"}
    return [(names.get(r) or unescape(r.removeprefix("Role ")), t) for r, t in out]


def digest(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the rendered text alone: what was said is parsed out of it again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, kind = None, [], pa.int64()

        def close():
            if now is not None:
                conv, n, turns, chars, loss, total = now
                rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        for b in batches:
            kind = b.column("conv_id").type
            for conv, pieces in zip(b.column("conv_id").to_pylist(), b.column("pieces").to_pylist(), strict=True):
                if now is None or now[0] != conv:
                    close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = "".join(p["text"] for p in pieces)
                for role, said in read_back(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                learnt = unescape("".join(p["text"] for p in pieces if p["mask"]))
                now[3] += len(learnt)
                now[4].update(learnt.encode())
                now[5] += len(text)
            if len(rows) >= 1000:
                yield _batch(rows, kind)
                rows.clear()
        close()
        if rows:
            yield _batch(rows, kind)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


PROBE = r"\### Assistant: </turn> ok"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return digest(format_turns(c.unionByName(probe)))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, regexp_replace(t, '(\\|### System:|### User:|### Assistant:|</turn>)', '\\\1', 'g') AS x FROM c)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
       coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(x) + length(role) + 4 + 2 + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
