"""Chat formatting: records of unlike layouts become canonical turns, and turns become text with a loss mask.

A record is JSON. The hash of its nested field paths selects a declarative mapping (where the turns are, and which
fields are role and text). The template marks turns; whatever in a text could be taken for a mark is escaped, so the
formatted text can be read back exactly.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# ---- layouts --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """Where a record keeps its turns.

    needs: the nested field paths that make it this layout ([] is any element of a list, [=0] an empty list). turns: the list of
    turns, or None. role, text, turn: fields of an element of that list, or of the record. fixed: (role, fields) pairs of a
    record without a list; fields that are there and not empty are joined by a blank line; a field that holds a list of messages
    stands for their turns. system: a field that, if it isn't empty, is a turn before all others.
    """

    name: str
    needs: tuple[str, ...]
    turns: str | None = None
    role: str = "role"
    text: str = "text"
    turn: str | None = None
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    system: str | None = "system"


def answered(name: str, question: str, answer: str, more: tuple[str, ...] = (), needs: tuple[str, ...] = ()) -> Layout:
    return Layout(name, (question, answer, *needs), fixed=(("user", (question, *more)), ("assistant", (answer,))))


#: Fields that lists of turns are kept in, and how an element names its role and its text.
LISTS = ("messages", "conversations", "conversation", "dialogue", "turns")
STYLES = (("role", "content"), ("from", "value"), ("speaker", "text"), ("role", "text"), ("role", "value"), ("from", "content"), ("from", "text"), ("speaker", "content"))
#: Usual lists have names of their own; any other list and style is named by both.
USUAL = {("messages", "role", "content"): "messages", ("conversations", "from", "value"): "from_value", ("dialogue", "speaker", "text"): "dialogue"}
#: Fields of a message that are text besides its own, as JSON; a message that has one of them may do without a text.
CALLS = ("tool_calls", "function_call")

#: The first layout all of whose needs are there is taken; fields that no layout names don't matter.
LAYOUTS = [
    Layout("turn_row", ("role", "text", "turn"), turn="turn", system=None),
    *(Layout(USUAL.get((at, r, t), f"{at}:{r}+{t}"), (f"{at}[].{r}", f"{at}[].{t}"), at, r, t) for at in LISTS for r, t in STYLES),
    answered("preference", "prompt", "chosen", needs=("rejected",)),
    Layout("preference_pair", ("chosen[].role", "rejected[].role"), fixed=(("assistant", ("chosen",)),)),
    answered("instruction", "instruction", "output", ("input",)),
    answered("instruction_response", "instruction", "response", ("context", "input")),
    answered("prompt", "prompt", "completion"),
    answered("prompt_response", "prompt", "response"),
    answered("question", "question", "answer", ("context",)),
    answered("input_output", "input", "output"),
    answered("nested_prompt", "data.prompt", "data.response"),
    *(Layout(at, (f"{at}[=0]",), at) for at in LISTS),
]
#: Other names of roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Fingerprints that a task remembers at a time; all are found anew after that.
REMEMBERED = 4096


def field_paths(value: object) -> frozenset[str]:
    """All nested field paths of a record. Dots and brackets inside a name are escaped, so they are never taken for nesting."""
    paths, left = set(), [("", value)]
    while left:
        at, v = left.pop()
        if isinstance(v, dict):
            named = [(f"{at}.{k}" if at else k, x) for name, x in v.items() for k in [re.sub(r"([\\.\[])", r"\\\1", name)]]
            paths.update(p for p, _ in named)
            left += named
        elif isinstance(v, list):
            paths.add(f"{at}[]" if v else f"{at}[=0]")
            left += [(f"{at}[]", x) for x in v]
    return frozenset(paths)


def fingerprint(paths: frozenset[str]) -> str:
    """The hash of all nested field paths, whatever their order."""
    return hashlib.sha1("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


class Mappings:
    """Layouts by fingerprint. A fingerprint that is met for the first time is looked up by the needs of all layouts."""

    def __init__(self) -> None:
        self.known: dict[str, Layout | None] = {}

    def find(self, paths: frozenset[str]) -> tuple[str, Layout | None]:
        mark = fingerprint(paths)
        if mark not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[mark] = next((x for x in LAYOUTS if paths.issuperset(x.needs)), None)
        return mark, self.known[mark]


def pick(value: object, path: str) -> object:
    for k in path.split("."):
        value = value.get(k) if isinstance(value, dict) else None
    return value


def word(x: object) -> str:
    """A text as it is, null as empty, a list of content parts as their texts, anything else as JSON."""
    if isinstance(x, list) and x and all(isinstance(p, dict) and isinstance(p.get("text"), str) for p in x):
        return "".join(p["text"] for p in x)
    return "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def said(items: list, role: str, text: str) -> list[tuple[str, str]] | None:
    """(role, text) of each message, calls after the text; None unless every one has a role, and a text or a call."""
    if not all(isinstance(x, dict) and role in x and (text in x or any(c in x for c in CALLS)) for x in items):
        return None
    named = [(word(x[role]), "\n\n".join(t for f in (text, *CALLS) if (t := word(x.get(f))))) for x in items]
    return [(ROLES.get(r, r), t) for r, t in named]


def messages_in(value: object) -> list[tuple[str, str]] | None:
    """The turns of a list of messages in any of the styles; None if it isn't one."""
    if not isinstance(value, list) or not value:
        return None
    return next((m for r, t in STYLES if (m := said(value, r, t)) is not None), None)


def fixed_turns(record: dict, layout: Layout) -> list[tuple[str, str]]:
    """A turn for each pair of a layout, or the turns of the messages that a field holds. Messages that begin with the turns
    before them, as an answer that repeats its prompt does, take their place."""
    turns: list[tuple[str, str]] = []
    for role, fields in layout.fixed:
        part, words = [], []
        for f in fields:
            value = pick(record, f)
            if m := messages_in(value):
                part += m
            elif t := word(value):
                words.append(t)
        if words or not part:
            part = [(role, "\n\n".join(words)), *part]
        turns = part if turns and part[: len(turns)] == turns else turns + part
    return turns


def turns_of(record: dict, layout: Layout) -> list[tuple[int | None, str, str]] | None:
    """(turn, role, text) of a record; null values are empty. A turn row keeps its role as it is.

    None if an element of its list lacks the fields that the layout names, so that no text is lost under a layout's name.
    """
    if layout.turns is None and not layout.fixed:
        return [(pick(record, layout.turn), word(pick(record, layout.role)), word(pick(record, layout.text)))]
    listed = fixed_turns(record, layout) if layout.fixed else said(pick(record, layout.turns), layout.role, layout.text)
    if listed is None:
        return None
    first = [("system", x)] if layout.system and (x := word(pick(record, layout.system))) else []
    return [(i, r, t) for i, (r, t) in enumerate(first + listed)]


def canonical_turns(records: DataFrame) -> DataFrame:
    """records (record: JSON, with conv_id or without) -> conv_id, turn, role, text, layout: a row for each turn.

    A record of an unknown layout, one whose list has an element without the fields of its layout, or one that isn't JSON,
    gives one row with layout 'unknown:<fingerprint>' and null turn, role and text, so that nothing disappears unseen; an empty
    list gives such a row with its layout. Of a preference, the chosen answer is a turn and the rejected one isn't. A missing
    conv_id, or one that isn't a whole number, is null. Repeated records give their turns each; other columns go.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mappings = Mappings()
        number = lambda x: x if isinstance(x, int) and not isinstance(x, bool) and -(2**63) <= x < 2**63 else None
        for batch in batches:
            rows = []
            for raw in batch["record"]:
                try:
                    record = json.loads(raw)
                except (TypeError, ValueError, RecursionError):
                    record = None
                mark, layout = mappings.find(field_paths(record))
                conv = number(record.get("conv_id")) if isinstance(record, dict) else None
                turns = turns_of(record, layout) if layout else None
                if turns is None:
                    rows.append((conv, None, None, None, f"unknown:{mark}"))
                else:
                    rows += [(conv, number(i), r, t, layout.name) for i, r, t in turns] or [(conv, None, None, None, layout.name)]
            out = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text", "layout"])
            yield out.astype({"conv_id": "Int64", "turn": "Int64"})

    return records.select("record").mapInPandas(run, "conv_id long, turn long, role string, text string, layout string")


# ---- template -------------------------------------------------------------------------------------------------

START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
ESCAPE = "\x1b"
#: Control strings of common templates; none may stand in a formatted text but as a mark.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>"]
_UNSAFE = re.compile("|".join(map(re.escape, [ESCAPE, *CONTROL])))
_ESCAPED = re.compile(ESCAPE + "([012])")


def escape(text: str, line: bool = False) -> str:
    """Text in which no control string is left: each gets ESCAPE 1 after its first character, ESCAPE becomes ESCAPE 0, and in a line \\n becomes ESCAPE 2."""
    out = _UNSAFE.sub(lambda m: ESCAPE + "0" if m[0] == ESCAPE else m[0][0] + ESCAPE + "1" + m[0][1:], text)
    return out.replace("\n", ESCAPE + "2") if line else out


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: {"0": ESCAPE, "1": "", "2": "\n"}[m[1]], text) if ESCAPE in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and the span of its loss mask (empty unless the role is assistant)."""
    head = START + escape(role, line=True) + MIDDLE
    body = escape(text)
    return head + body + END, len(head), len(head) + (len(body) if role == "assistant" else 0)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    out = []
    for part in formatted.split(START)[1:]:
        role, _, body = part.removesuffix(END).partition(MIDDLE)
        out.append((unescape(role), unescape(body)))
    return out


def format_chats(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> the same with `formatted` and the span `loss_start`, `loss_end` in it.

    A conversation's formatted text is the concatenation of its turns' by turn, so this needs no shuffle and holds one
    turn at a time, however long a conversation is. Null roles and texts count as empty, but rows with neither of them nor a
    turn are records without a turn and go. Other columns go.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [format_turn(r or "", t or "") for r, t in zip(batch["role"], batch["text"], strict=True)]
            more = pd.DataFrame(out, columns=["formatted", "loss_start", "loss_end"])
            yield pd.concat([batch[["conv_id", "turn"]].astype("Int64").reset_index(drop=True), more], axis=1)

    turns = turns.filter("turn is not null or role is not null or text is not null")
    typed = turns.select(F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text")
    return typed.mapInPandas(run, "conv_id long, turn long, formatted string, loss_start long, loss_end long")


def digests(formatted: DataFrame) -> DataFrame:
    """Read formatted turns back, and sum up each conversation in turn order (then by formatted text).

    SHA-256 over a conversation needs its turns one after another: they are sorted within a partition and streamed
    through running digests, so memory doesn't grow with a conversation. All turns of a conversation go to one task, as one
    digest needs; turns without a conv_id are one conversation. An empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, key = None, None
        for batch in batches:
            rows = []
            for conv, formatted, start, end in zip(batch["conv_id"], batch["formatted"], batch["loss_start"], batch["loss_end"], strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if state is None or conv != key:
                    if state:
                        rows.append(summary(key, state))
                    state, key = [0, hashlib.sha256(), 0, hashlib.sha256(), 0], conv
                for role, text in read_turns(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                masked = unescape(formatted[start:end])
                state[2] += len(masked)
                state[3].update(masked.encode())
                state[4] += len(formatted)
            if rows:
                yield frame(rows)
        if state:
            yield frame([summary(key, state)])

    def summary(key: int | None, s: list) -> tuple:
        return key, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    typed = ordered.select(F.col("conv_id").cast("string"), "formatted", "loss_start", "loss_end")
    return typed.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    said = "</s>[INST] ok [/INST]"
    extra = json.dumps({"conv_id": -1, "messages": [{"role": r, "content": said} for r in ("user", "assistant")]})
    records = rows.unionAll(spark.range(1).select(F.lit(extra).alias("record")))
    return digests(format_chats(canonical_turns(records)))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, 24 + length(role) + length(text) + length(regexp_extract_all(role || text, '\x1b')) + length(regexp_extract_all(role, '\n'))
        + 2 * length(regexp_extract_all(role || chr(10) || text, '<\|(?:im_start|im_end|endoftext|system|user|assistant)\|>|\[/?INST\]|<</?SYS>>|</?s>')) AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
