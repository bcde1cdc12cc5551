"""Chat formatting by schema fingerprints.

A record's nested field paths are hashed; the hash selects a declarative mapping that turns prompt,
instruction and message layouts into canonical turns. Turns are then written with marks that no text can
hold, since texts are escaped, and with the spans that a loss should count.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from functools import cache
from itertools import chain, combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwork.llm.common import ship, slices

OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"
LOSS_ROLE = "assistant"
PART_CHARS = 1 << 20  # formatted characters from which a conversation goes on in a further row


@dataclass(frozen=True)
class Said:
    """One turn: the texts at `paths` that are there, joined."""

    role: str
    paths: tuple[str, ...]
    joiner: str = "\n\n"


@dataclass(frozen=True)
class Each:
    """One turn for each element of a list: its role and text, by paths inside the element."""

    items: str
    role: str
    text: str


@dataclass(frozen=True)
class Row:
    """A record that is itself one turn of a conversation."""

    role: str
    text: str
    order: str


@dataclass(frozen=True)
class Layout:
    """A mapping: all paths that its records have, those of them that may be absent or null, and the turns."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[Said | Each | Row, ...]
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()  # names of roles that are written otherwise

    def fingerprints(self) -> set[str]:
        """One for each choice of optional paths."""
        fixed = [p for p in self.paths if p not in self.optional]
        choices = chain.from_iterable(combinations(self.optional, n) for n in range(len(self.optional) + 1))
        return {fingerprint(fixed + list(c)) for c in choices}


# Where two layouts have a fingerprint in common, the first counts.
LAYOUTS = (
    Layout("turn_rows", ("turn", "role", "text"), (Row("role", "text", "turn"),), optional=("turn", "role", "text")),
    Layout("prompt_completion", ("prompt", "completion"), (Said("user", ("prompt",)), Said("assistant", ("completion",))), optional=("completion",)),
    Layout("prompt_response", ("system", "prompt", "response"), (Said("system", ("system",)), Said("user", ("prompt",)), Said("assistant", ("response",))), optional=("system",)),
    Layout("question_answer", ("context", "question", "answer"), (Said("system", ("context",)), Said("user", ("question",)), Said("assistant", ("answer",))), optional=("context", "answer")),
    Layout("instruction", ("instruction", "input", "output"), (Said("user", ("instruction", "input")), Said("assistant", ("output",))), optional=("input", "output")),
    Layout("messages", ("messages[]", "messages[].role", "messages[].content"), (Each("messages[]", "role", "content"),), optional=("messages[].role", "messages[].content")),
    Layout("message_parts", ("messages[]", "messages[].role", "messages[].content[]", "messages[].content[].type", "messages[].content[].text"), (Each("messages[]", "role", "content[].text"),)),
    Layout("from_value", ("conversations[]", "conversations[].from", "conversations[].value"), (Each("conversations[]", "from", "value"),), optional=("conversations[].from", "conversations[].value"), roles=(("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))),
)


def field_paths(value, at: str = "") -> set[str]:
    """Nested paths of a record's fields; a null field is as good as none, a list is `name[]`, and what its elements have follows."""
    found: set[str] = set()
    if isinstance(value, dict):
        for k, v in value.items():
            path = f"{at}.{k}" if at else k
            if isinstance(v, list):
                path += "[]"
                found.add(path)
            elif v is not None and not isinstance(v, dict):
                found.add(path)
            found |= field_paths(v, path)
    elif isinstance(value, list):
        for v in value:
            found |= field_paths(v, at)
    return found


def fingerprint(paths) -> str:
    return xxhash.xxh64_hexdigest("\n".join(sorted(paths)))


def values_at(value, path: str) -> list:
    """What a path leads to; `name[]` goes through a list."""
    name, _, rest = path.partition(".")
    here = value.get(name.removesuffix("[]")) if isinstance(value, dict) else None
    here = here if name.endswith("[]") and isinstance(here, list) else [] if here is None or name.endswith("[]") else [here]
    return [x for v in here for x in values_at(v, rest)] if rest else here


def text_at(value, path: str) -> str:
    return "".join(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in values_at(value, path) if v is not None)


def turns_of(record: dict, layout: Layout) -> list[tuple[int | None, str, str]]:
    """(order, role, text) of a record's turns; order is known only where a record is one turn."""
    names, out = dict(layout.roles), []
    for t in layout.turns:
        if isinstance(t, Said):
            texts = [text_at(record, p) for p in t.paths if values_at(record, p)]
            if texts:
                out.append((None, t.role, t.joiner.join(texts)))
        elif isinstance(t, Each):
            out += [(None, text_at(m, t.role), text_at(m, t.text)) for m in values_at(record, t.items)]
        else:
            order = (values_at(record, t.order) or [None])[0]
            out.append((order if isinstance(order, int) else None, text_at(record, t.role), text_at(record, t.text)))
    return [(order, names.get(role, role), text) for order, role, text in out]


@cache
def mapping_table(layouts: tuple[Layout, ...]) -> dict[str, Layout]:
    return {f: x for x in reversed(layouts) for f in x.fingerprints()}


def canonical_turns(records: DataFrame, key: str = "key", record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(key, fingerprint, layout, turn, position, role, text): the turns of JSON records of any known layout.

    Top-level fields named in `ignored` are left out before paths are hashed. A record without a known
    fingerprint, a null one, one that is no JSON object, and one without any turn give one row with a null
    role and text; the first three have a null layout too. Null and absent roles and texts count as ''. An
    empty table gives an empty result; repeated records count each for itself; other columns don't matter.
    A very long record takes memory in proportion to itself. No shuffle.
    """
    ship(records.sparkSession)
    of_key = records.schema[key].dataType
    schema = T.StructType([T.StructField("key", of_key)]).add("fingerprint", "string").add("layout", "string").add("turn", "long").add("position", "integer").add("role", "string").add("text", "string")

    def convert(batches):
        table = mapping_table(layouts)
        for batch in slices(batches, 512):
            at, rows = [], []
            for i, raw in enumerate(batch.column("record").to_pylist()):
                try:
                    value = json.loads(raw) if raw is not None else None
                except ValueError:
                    value = None
                if not isinstance(value, dict):
                    at.append(i)
                    rows.append((None, None, None, None, None, None))
                    continue
                print_ = fingerprint(field_paths({k: v for k, v in value.items() if k not in ignored}))
                layout = table.get(print_)
                turns = turns_of(value, layout) if layout else []
                for position, (order, role, text) in enumerate(turns):
                    at.append(i)
                    rows.append((print_, layout.name, order, position, role, text))
                if not turns:
                    at.append(i)
                    rows.append((print_, layout.name if layout else None, None, None, None, None))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int64())), *columns], schema.names)

    return records.select(F.col(key).alias("key"), F.col(record).cast("string").alias("record")).mapInArrow(convert, schema)


def escaped(text: str) -> str:
    """The same text without any control string: a backslash stands before backslashes and marks, and inside the end mark."""
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("</turn>", "<\\/turn>")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def written_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text begins and ends in it."""
    head = OPEN + escaped(role).replace(":", "\\:") + SEP
    body = escaped(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of formatted turns: the inverse of `written_turn`."""
    out = []
    for one in formatted.split(CLOSE)[:-1]:
        head = re.match(r"### ((?:[^\\:]|\\.)*): ", one, re.DOTALL)
        out.append((unescaped(head[1]), unescaped(one[head.end() :])))
    return out


LOSS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ARROW_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def streamed(batches, columns: tuple[str, ...]):
    """(key, row) of sorted batches, row by row."""
    for batch in slices(batches, 512):
        yield from zip(batch.column("key").to_pylist(), zip(*[batch.column(c).to_pylist() for c in columns], strict=True), strict=True)


def format_turns(turns: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """(key, part, formatted, loss): conversations in the template, and the spans of assistant texts in characters.

    Takes (key, turn, position, role, text) as `canonical_turns` gives them; rows with a null role and text
    stand for no turn. Turns are in order of turn (nulls first), position, role and text, so ties and repeated
    rows have one defined order and each stays. A conversation of up to `part_chars` characters is one row;
    a longer one goes on in further parts, cut between turns, in order and in one partition, so a
    conversation of any number of turns streams through and is never gathered. A null key is a conversation too.
    """
    of_key = turns.schema["key"].dataType
    schema = T.StructType([T.StructField("key", of_key)]).add("part", "integer").add("formatted", "string").add("loss", LOSS)

    def write(batches):
        ready: list = []
        texts, loss, chars, part, now, begun = [], [], 0, 0, None, False

        def packed():
            rows = [pa.array([r[0] for r in ready], ARROW_KEY), pa.array([r[1] for r in ready], pa.int32()), pa.array([r[2] for r in ready], pa.string()), pa.array([r[3] for r in ready], ARROW_LOSS)]
            return pa.RecordBatch.from_arrays(rows, schema.names)

        waiting = 0
        for key, (role, text) in streamed(batches, ("role", "text")):
            if begun and (key != now or chars >= part_chars):
                ready.append((now, part, "".join(texts), loss))
                waiting += chars
                part = part + 1 if key == now else 0
                texts, loss, chars = [], [], 0
                if waiting >= part_chars or len(ready) >= 4096:
                    yield packed()
                    ready.clear()
                    waiting = 0
            elif not begun:
                part = 0
            now, begun = key, True
            one, start, end = written_turn(role, text)
            if role == LOSS_ROLE:
                loss.append({"start": chars + start, "end": chars + end})
            texts.append(one)
            chars += len(one)
        if begun:
            ready.append((now, part, "".join(texts), loss))
            yield packed()

    from pyspark.sql.pandas.types import to_arrow_type

    ARROW_KEY = to_arrow_type(of_key)
    real = turns.where("role is not null and text is not null").select("key", "turn", "position", "role", "text")
    ordered = real.repartition("key").sortWithinPartitions("key", "turn", "position", "role", "text")
    return ordered.select("key", "role", "text").mapInArrow(write, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """(key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from formatted text and loss spans alone.

    Takes the rows of `format_turns` in their own order: parts of a conversation follow each other in a partition.
    """
    of_key = formatted.schema["key"].dataType
    schema = T.StructType([T.StructField("key", of_key)]).add("n_turns", "long").add("turns_sha256", "string").add("loss_chars", "long").add("loss_sha256", "string").add("formatted_chars", "long")

    def read(batches):
        done, now = [], None

        def packed():
            kinds = (ARROW_KEY, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(kinds)], schema.names)

        for key, (part, text, loss) in streamed(batches, ("part", "formatted", "loss")):
            if part == 0:
                if now:
                    done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))
                if len(done) >= 4096:
                    yield packed()
                    done.clear()
                now = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in read_turns(text):
                now[1] += 1
                now[2].update(f"{role}\n{said}\n".encode())
            for span in loss:
                said = unescaped(text[span["start"] : span["end"]])
                now[3] += len(said)
                now[4].update(said.encode())
            now[5] += len(text)
        if now:
            done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))
        if done:
            yield packed()

    from pyspark.sql.pandas.types import to_arrow_type

    ARROW_KEY = to_arrow_type(of_key)
    return formatted.mapInArrow(read, schema)
