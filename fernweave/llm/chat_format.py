"""Chat formatting by schema fingerprints, in DataFrame expressions only.

A record's layout is known by its fingerprint: the hash of the nested field paths that the record fills. Each mapping to
canonical turns owns the fingerprints of its required paths with any of its optional ones, and is selected by them. Only
a fingerprint that no mapping owns goes to the first mapping whose required paths are all filled. A template with control strings then renders the turns, and reads them back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, without

#: The fields of records that parse_records gives. Typed records may have some of them, in any order, and others.
SCALARS = ("system", "prompt", "completion", "response", "instruction", "input", "output", "question", "answer")
PART = "struct<type:string,text:string>"
RECORD = (
    f"struct<{', '.join(f'{c}:string' for c in SCALARS)}, messages:array<struct<role:string,content:string,parts:array<{PART}>>>,"
    " conversations:array<struct<`from`:string,value:string>>>"
)
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant"}
#: Paths that an empty string doesn't fill: records carry them along for all rows, used or not.
OPTIONAL = ("input", "system")

Turns = Callable[[Column], Column]


def _turn(role: Column | str, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _pair(ask: str, answer: str, more: str = "") -> Turns:
    def turns(r: Column) -> Column:
        asked = F.concat(r[ask], F.lit("\n\n"), r[more]) if more else r[ask]
        return F.array(_turn("user", asked), _turn("assistant", r[answer]))

    return turns


def _canonical(role: Column) -> Column:
    out = role
    for name, canonical in ROLE_NAMES.items():
        out = F.when(role == name, F.lit(canonical)).otherwise(out)
    return out


@dataclass(frozen=True)
class Layout:
    """A layout: the paths that its records must fill, those that they may fill besides, and its turns."""

    name: str
    paths: tuple[str, ...]
    turns: Turns
    optional: tuple[str, ...] = ()


def _parts(message: Column, own: bool) -> Column:
    """The text of a message: its content, or its parts' texts joined, if it has parts."""
    if not own:
        return message["content"]
    return F.coalesce(message["content"], F.array_join(F.transform(message["parts"], lambda p: p["text"]), "\n"))


BASE = (
    Layout("messages", ("messages[]",), lambda r: F.transform(r["messages"], lambda m: _turn(m["role"], m["content"])), ("messages[].content", "messages[].role")),
    Layout("messages_parts", ("messages[].parts[].text",), lambda r: F.transform(r["messages"], lambda m: _turn(m["role"], _parts(m, True))), ("messages[]", "messages[].content", "messages[].role", "messages[].parts[]", "messages[].parts[].type")),
    Layout("from_value", ("conversations[]",), lambda r: F.transform(r["conversations"], lambda m: _turn(_canonical(m["from"]), m["value"])), ("conversations[].from", "conversations[].value")),
    Layout("prompt_completion", ("completion", "prompt"), _pair("prompt", "completion")),
    Layout("prompt_response", ("prompt", "response"), _pair("prompt", "response")),
    Layout("instruction_input", ("input", "instruction", "output"), _pair("instruction", "output", "input")),
    Layout("instruction", ("instruction", "output"), _pair("instruction", "output")),
    Layout("question_answer", ("answer", "question"), _pair("question", "answer")),
)


def with_system(layout: Layout) -> Layout:
    return Layout(f"system_{layout.name}", (*layout.paths, "system"), lambda r: F.concat(F.array(_turn("system", r["system"])), layout.turns(r)), layout.optional)


#: In order of priority: of each layout first the form with a system text; parts before plain messages.
LAYOUTS = tuple(x for b in (BASE[1], BASE[0], *BASE[2:]) for x in (with_system(b), b))


def paths_of(kind: T.DataType, value: Column, path: str = "") -> Iterator[tuple[str, Column]]:
    """The nested paths of a type, with whether the value fills them. A list fills "path[]" unless it is null, and a path
    inside it if any item fills that."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from paths_of(f.dataType, value[f.name], f"{path}.{f.name}" if path else f.name)
    elif isinstance(kind, T.ArrayType):
        yield f"{path}[]", value.isNotNull()
        for inner, _ in paths_of(kind.elementType, F.lit(None), f"{path}[]"):
            if inner != f"{path}[]":
                yield inner, F.coalesce(F.exists(value, _filling(kind.elementType, f"{path}[]", inner)), F.lit(False))
    else:
        filled = value.isNotNull()
        yield path, filled & (value.cast("string") != "") if path in OPTIONAL else filled


def _filling(kind: T.DataType, path: str, inner: str) -> Callable[[Column], Column]:
    return lambda x: dict(paths_of(kind, x, path))[inner]


def filled_paths(kind: T.DataType, record: Column) -> Column:
    """The sorted paths that the record fills."""
    return F.array_compact(F.array(*[F.when(filled, F.lit(path)) for path, filled in sorted(paths_of(kind, record), key=lambda x: x[0])]))


def fingerprint_of(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


#: The seed of Spark's xxhash64.
SEED = 42


def _number(paths: tuple[str, ...]) -> int:
    """fingerprint_of the sorted paths, for a plan's literals."""
    digest = xxhash.xxh64_digest("\n".join(sorted(paths)), SEED)
    return int.from_bytes(digest, "big", signed=True)


def owners(layouts: tuple[Layout, ...], known: set[str]) -> list[list[int]]:
    """The fingerprints that each layout owns among records that can fill the known paths.

    They are those of its required paths with any of its optional ones. Where two layouts would own one, the earlier has it.
    """
    taken: dict[int, int] = {}
    for i, x in enumerate(layouts):
        optional = [p for p in x.optional if p in known]
        for n in range(len(optional) + 1):
            for some in combinations(optional, n):
                paths = {*x.paths, *some}
                first = next(j for j, y in enumerate(layouts) if set(y.paths) <= paths)
                taken.setdefault(_number(tuple(paths)), first)
    out: list[list[int]] = [[] for _ in layouts]
    for number, i in taken.items():
        out[i].append(number)
    return out


def parse_records(json: Column) -> Column:
    """A record from JSON text; fields that RECORD lacks are passed over, text that isn't an object gives null fields.

    A message's content may be a text or a list of parts with texts; a list goes to parts.
    """
    typed = F.from_json(json, RECORD.replace("content:string", "content:variant"))

    def message(m: Column) -> Column:
        several = F.startswith(F.schema_of_variant(m["content"]), F.lit("ARRAY"))
        parts = F.when(several, F.from_json(F.to_json(m["content"]), f"array<{PART}>"))
        return F.struct(m["role"].alias("role"), F.when(~several, F.try_variant_get(m["content"], "$", "string")).alias("content"), F.coalesce(parts, m["parts"]).alias("parts"))

    return F.when(typed.isNotNull(), F.struct(*[typed[c].alias(c) for c in SCALARS], F.transform(typed["messages"], message).alias("messages"), typed["conversations"].alias("conversations")))


def canonical_turns(docs: DataFrame, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """docs with fingerprint, layout (its name), surplus (filled paths that the layout doesn't use) and turns.

    Mappings whose paths the record's type lacks are left out. A record that fits none, as a null one, has a null layout
    and null turns, and all its paths are surplus.
    """
    docs = without(docs, "fingerprint", "layout", "surplus", "turns")
    record, kind = docs[record_col], docs.schema[record_col].dataType
    known = {path for path, _ in paths_of(kind, record)}
    out = docs.withColumn("surplus", filled_paths(kind, record)).withColumn("fingerprint", fingerprint_of(F.col("surplus")))
    fit = [x for x in layouts if set(x.paths) <= known]
    number = F.lit(None).cast("int")
    for i in reversed(range(len(fit))):
        fits = F.forall(F.array(*map(F.lit, fit[i].paths)), lambda p: F.array_contains("surplus", p))
        number = F.when(fits, F.lit(i)).otherwise(number)
    for i, own in enumerate(owners(tuple(fit), known)):
        number = F.when(F.col("fingerprint").isin(own), F.lit(i)).otherwise(number)
    out = out.withColumn("layout", number)
    name, turns, left = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>"), F.col("surplus")
    for i, x in enumerate(fit):
        own = F.col("layout") == i
        name, turns = F.when(own, F.lit(x.name)).otherwise(name), F.when(own, x.turns(record)).otherwise(turns)
        left = F.when(own, F.array_except("surplus", F.array(*map(F.lit, (*x.paths, *x.optional))))).otherwise(left)
    return out.withColumn("turns", turns).withColumns({"surplus": left, "layout": name})


#: The template's control strings. A turn is its role's opening, a blank, the text, a blank and the closing.
START = "<s>"
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", " </s>"), "system": ("[SYS] ", " [/SYS]")}
OTHER, OTHER_TEXT, OTHER_END = "[ROLE] ", " [/ROLE] ", " </s>"
CONTROL = r"/?(?:INST|OUT|SYS|ROLE)\]|/?s>"


def escape(text: Column) -> Column:
    r"""A backslash after the first character of each control string; of one that has backslashes there already, one more."""
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL})", "$1$2$3")


def _opening(turn: Column) -> Column:
    out = F.concat(F.lit(OTHER), escape(turn["role"]), F.lit(OTHER_TEXT))
    for role, (opening, _) in MARKS.items():
        out = F.when(turn["role"] == role, F.lit(opening)).otherwise(out)
    return out


def _closing(turn: Column) -> Column:
    out = F.lit(OTHER_END)
    for role, (_, closing) in MARKS.items():
        out = F.when(turn["role"] == role, F.lit(closing)).otherwise(out)
    return out


def format_turns(docs: DataFrame, turns_col: str = "turns") -> DataFrame:
    """docs with formatted (the rendered turns) and loss_spans: array of start (from 0) and length, in code points of formatted.

    The spans cover each assistant text, escapes included, and nothing else. Control strings inside texts and role names
    are escaped, so that the marks of turns can't be forged. No turns: formatted is the start mark alone. Null turns:
    both are null. One pass carries the running offset.
    """
    docs = without(docs, "formatted", "loss_spans")
    pieces = F.transform(docs[turns_col], lambda t: F.struct(_opening(t).alias("a"), escape(t["text"]).alias("b"), _closing(t).alias("c"), (t["role"] == "assistant").alias("loss")))
    out = docs.withColumn("loss_spans", pieces)
    pieces = F.col("loss_spans")
    formatted = F.concat(F.lit(START), F.array_join(F.transform(pieces, lambda p: F.concat(p["a"], p["b"], p["c"])), ""))
    out = out.withColumn("formatted", formatted)
    sizes = F.transform(pieces, lambda p: F.struct(F.length(p["a"]).alias("a"), F.length(p["b"]).alias("b"), F.length(p["c"]).alias("c"), p["loss"].alias("loss")))
    out = out.withColumn("loss_spans", sizes)

    def step(state: Column, p: Column) -> Column:
        start = state["at"] + p["a"]
        span = F.struct(start.alias("start"), p["b"].alias("length"))
        return F.struct((start + p["b"] + p["c"]).alias("at"), F.when(p["loss"], F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    none = F.array().cast("array<struct<start:int,length:int>>")
    return out.withColumn("loss_spans", F.aggregate("loss_spans", F.struct(F.lit(len(START)).alias("at"), none.alias("spans")), step)["spans"])


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string, unescaped."""
    marks = "|".join(x.strip().replace("[", r"\[").replace("]", r"\]") for x in (*(m[0] for m in MARKS.values()), OTHER))
    body = formatted.substr(F.lit(len(START) + 1), F.length(formatted))
    parts = F.filter(F.split(body, rf"(?=(?:{marks}) )"), lambda p: F.length(p) > 0)

    def turn(p: Column) -> Column:
        at = F.instr(p, OTHER_TEXT)
        role = unescape(p.substr(F.lit(len(OTHER) + 1), at - len(OTHER) - 1))
        begin, end = at + len(OTHER_TEXT), F.lit(len(OTHER_END))
        for name, (opening, closing) in MARKS.items():
            own = F.startswith(p, F.lit(opening))
            role = F.when(own, F.lit(name)).otherwise(role)
            begin = F.when(own, F.lit(len(opening) + 1)).otherwise(begin)
            end = F.when(own, F.lit(len(closing))).otherwise(end)
        return F.struct(role.alias("role"), unescape(p.substr(begin, F.length(p) - begin + 1 - end)).alias("text"))

    return F.transform(parts, turn)


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr(s["start"] + 1, s["length"]))), "")


def gather_turns(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """id_col and record, in the layout of messages, from a row for each turn.

    Turns follow turn_col (nulls first), ties role and text; repeated rows are turns of their own; null roles and texts
    are empty; rows with a null id form one conversation. Other columns are not read. A conversation is one output row
    and as such indivisible.
    """
    turn = F.struct(rows[turn_col].alias("turn"), F.coalesce(rows[role_col], F.lit("")).alias("role"), F.coalesce(rows[text_col], F.lit("")).alias("content"))
    grouped = rows.groupBy(rows[id_col].alias(id_col)).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.select(id_col, F.struct(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages")).alias("record"))


def as_layouts(conversations: DataFrame) -> DataFrame:
    """conversations with record in the layout that its turns allow: a question and its answer as prompt and completion, with
    a system text before them as instruction and output, turns of users and assistants alone as from and value, others as messages.

    An empty system text is a turn like others, which flat records can't tell from none: it stays in messages.
    """
    m = F.col("record.messages")
    roles, text = F.array_join(F.transform(m, lambda x: x["role"]), "\n"), lambda i: F.get(m, i)["content"]
    pair, told = roles == "user\nassistant", (roles == "system\nuser\nassistant") & (text(0) != "")
    spoken = ~pair & (F.size(m) > 0) & F.forall(m, lambda x: x["role"].isin("user", "assistant"))
    named = F.transform(m, lambda x: F.struct(F.when(x["role"] == "user", "human").otherwise("gpt").alias("from"), x["content"].alias("value")))
    record = F.struct(
        F.when(told, text(0)).alias("system"), F.when(pair, text(0)).alias("prompt"), F.when(pair, text(1)).alias("completion"),
        F.when(told, text(1)).alias("instruction"), F.when(told, F.lit("")).alias("input"), F.when(told, text(2)).alias("output"),
        F.when(~pair & ~told & ~spoken, m).alias("messages"), F.when(spoken, named).alias("conversations"),
    )
    return conversations.withColumn("record", record)


def chat_format(records: DataFrame, record_col: str = "record") -> DataFrame:
    """records with fingerprint, layout, surplus, turns, formatted and loss_spans. Input columns of these names are replaced.

    Null texts and roles are empty. A null record, or one that no mapping fits, has a null layout and is not rendered:
    turns, formatted and loss_spans are null. Long texts and many turns cost time in proportion. Rows that repeat are
    formatted alike; an empty table gives an empty result.
    """
    return format_turns(canonical_turns(records, record_col))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    done = chat_format(as_layouts(gather_turns(rows.unionByName(own)))).select("conv_id", "formatted", "loss_spans", "layout")
    read = done.select("*", read_turns(F.col("formatted")).alias("read"), read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )


SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked as (
  select *, regexp_replace(text, '([<\[])(\\*)(/?(?:INST|OUT|SYS|ROLE)\]|/?s>)', '\1\\\2\3', 'g') as escaped,
         case role when 'user' then 15 when 'assistant' then 11 when 'system' then 13
              else 21 + length(regexp_replace(role, '([<\[])(\\*)(/?(?:INST|OUT|SYS|ROLE)\]|/?s>)', '\1\\\2\3', 'g')) end as marks
  from rows)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       (3 + sum(marks + length(escaped)))::bigint as formatted_chars,
       case when string_agg(role, ',' order by turn, role, text) = 'user,assistant' then 'prompt_completion'
            when string_agg(role, ',' order by turn, role, text) = 'system,user,assistant'
              then case when first(text order by turn, role, text) = '' then 'messages' else 'system_instruction' end
            when count(*) filter (role not in ('user', 'assistant')) = 0 then 'from_value' else 'messages' end as layout
from marked group by conv_id
"""
