"""Chat formatting: heterogeneous prompt, instruction and message layouts become canonical turns, and these one string a conversation.

1. Schema fingerprinting. The nested field paths of a schema, without their types, are written as one string and hashed. The hash looks up a
   declarative ``Layout`` that says where ids, roles and texts are. A table has the fingerprint of its schema; a column of JSON documents
   has one for each row (``schema_of_variant``), so one file may mix layouts.
2. Canonical turns are rows conv_id, turn, role, text.
3. A ``Template`` marks each turn. Control strings inside texts and roles are escaped: a word joiner (U+2060) goes behind their first
   character, and word joiners of the text are doubled, so no text can hold a mark and all can be read back.
4. Each conversation is one row: the formatted string, and for each turn where it starts and which part of it the loss covers.

Everything is DataFrame functions; rows are formatted before the one shuffle, by conv_id, which window and grouping share. A conversation is one
string in the end and so has to fit in memory; copies of a conversation under other ids are other keys and spread.

Defined results: a null text or role counts as empty; turns are ordered by turn (nulls last), then role, then text; repeated rows are turns of
their own; null conv_id is one conversation; an empty table gives an empty result; further columns of a table are ignored, also where
their names look like another layout's, as long as one layout fits best; a table that fits none, or two equally well, is refused. JSON
that no layout fits (or that is no JSON) is no conversation: ``layouts`` counts such rows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

JOINER = "\u2060"


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns.

    ``listed``: (array, role field, text field); ``fields``: (role, fields whose texts that are not empty are joined by an empty line) in order;
    ``by_row``: (turn, role, text), one turn a row. ``roles`` renames roles.
    """

    name: str
    listed: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    by_row: tuple[str, str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict)

    @property
    def paths(self) -> frozenset[str]:
        if self.listed:
            array, role, text = self.listed
            return frozenset({f"{array}[]", f"{array}[].{role}", f"{array}[].{text}"})
        return frozenset(self.by_row or [p for _, group in self.fields for p in group])

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


LAYOUTS = (
    Layout("rows", by_row=("turn", "role", "text")),
    Layout("messages", listed=("messages", "role", "content")),
    Layout("exchanges", listed=("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}),
    Layout("completion", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("response", fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction", fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("bare instruction", fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("question", fields=(("system", ("system_prompt",)), ("user", ("question",)), ("assistant", ("response",)))),
)


def fingerprint(paths: set[str] | frozenset[str]) -> str:
    """Hash of nested field paths, whatever their order."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(schema: T.DataType, at: str = "") -> set[str]:
    """All nested paths: ``a``, ``a.b`` of a structure, ``a[]`` of an array."""
    if isinstance(schema, T.StructType):
        return {p for f in schema.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)}
    if isinstance(schema, T.ArrayType):
        return {f"{at}[]"} | field_paths(schema.elementType, f"{at}[]")
    return {at}


def layout_of(schema: T.StructType, layouts: tuple[Layout, ...] = LAYOUTS) -> Layout:
    """The layout whose fingerprint the schema has; else, by fingerprints of parts of its paths, the one that explains most of them."""
    paths = field_paths(schema)
    by_hash = {x.fingerprint: x for x in layouts}
    if found := by_hash.get(fingerprint(paths)):
        return found
    fits = sorted((x for x in layouts if x.paths <= paths), key=lambda x: -len(x.paths))
    if not fits or (len(fits) > 1 and len(fits[0].paths) == len(fits[1].paths)):
        raise ValueError(f"no single layout fits the paths {sorted(paths)}: {[x.name for x in fits]}")
    return by_hash[fingerprint(fits[0].paths & paths)]


def _renamed(role: Column, layout: Layout) -> Column:
    return reduce(lambda so_far, pair: so_far.when(role == pair[0], F.lit(pair[1])), layout.roles.items(), F.when(F.lit(False), role)).otherwise(role)


def _turn(number: Column, role: Column, text: Column) -> Column:
    empty = F.lit("")
    return F.struct(number.cast("long").alias("turn"), F.coalesce(role.cast("string"), empty).alias("role"), F.coalesce(text.cast("string"), empty).alias("text"))


def _numbered(messages: Column, layout: Layout) -> Column:
    """The turns of an array of messages."""
    _, role, text = layout.listed
    return F.transform(messages, lambda m, k: _turn(k, _renamed(m[role], layout), m[text]))


def _fixed(layout: Layout, of) -> Column:
    """The turns of a layout with named fields; ``of(path)`` is a field's text. A system turn without text is none."""
    turns = []
    for k, (role, group) in enumerate(layout.fields):
        texts = F.filter(F.array(*[F.coalesce(of(p), F.lit("")) for p in group]), lambda t: t != "")
        turns.append(_turn(F.lit(k), F.lit(role), F.array_join(texts, "\n\n")))
    return F.filter(F.array(*turns), lambda t: (t["role"] != "system") | (t["text"] != ""))


def canonical_turns(df: DataFrame, id_col: str = "conv_id", layout: Layout | None = None) -> DataFrame:
    """conv_id, turn, role, text of a table in any of the layouts."""
    layout = layout or layout_of(T.StructType([f for f in df.schema.fields if f.name != id_col]))
    key = F.col(id_col).alias("conv_id")
    if layout.by_row:
        turn, role, text = (F.col(c) for c in layout.by_row)
        rows = df.select(key, _turn(turn, _renamed(role, layout), text).alias("t"))
    elif layout.listed:
        rows = df.select(key, F.explode(_numbered(F.col(layout.listed[0]), layout)).alias("t"))
    else:
        rows = df.select(key, F.explode(_fixed(layout, F.col)).alias("t"))
    return rows.select("conv_id", "t.turn", "t.role", "t.text")


def _variant_paths(value: Column, layouts: tuple[Layout, ...]) -> Column:
    """The sorted field paths of a JSON document that any layout knows, as ``fingerprint`` joins them; others are no one's concern."""
    found = []
    for path in sorted({p for x in layouts if not x.by_row for p in x.paths if "[]" not in p}):
        found.append(F.when(F.try_variant_get(value, f"$.{path}", "variant").isNotNull(), F.lit(path)))
    for array, inner in sorted({(x.listed[0], i) for x in layouts if x.listed for i in x.listed[1:]}):
        shape = F.schema_of_variant(F.try_variant_get(value, f"$.{array}", "variant"))
        found.append(F.when(shape.startswith("ARRAY"), F.lit(f"{array}[]")))
        found.append(F.when(shape.rlike(rf"^ARRAY<OBJECT<(?:[^<>]*, )?{re.escape(inner)}:"), F.lit(f"{array}[].{inner}")))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(*found), lambda p: p.isNotNull()))), "\n")


def with_layout(df: DataFrame, json_col: str = "json", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``df`` with columns fingerprint and layout (its name, null if none has the fingerprint) of each JSON document."""
    value = F.try_parse_json(F.col(json_col))
    print_ = F.sha2(_variant_paths(value, layouts), 256)
    named = reduce(lambda so_far, x: so_far.when(F.col("fingerprint") == x.fingerprint, F.lit(x.name)), [x for x in layouts if not x.by_row], F.when(F.lit(False), F.lit("")))
    return df.withColumn("fingerprint", print_).withColumn("layout", named)


def layouts(df: DataFrame, json_col: str = "json", known: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """layout, fingerprint, n: how many JSON documents have which."""
    return with_layout(df, json_col, known).groupBy("layout", "fingerprint").agg(F.count("*").alias("n"))


def json_turns(df: DataFrame, id_col: str = "conv_id", json_col: str = "json", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """conv_id, turn, role, text of JSON documents, each by the layout of its own fingerprint."""
    named = with_layout(df.select(F.col(id_col).alias("conv_id"), F.col(json_col).alias("json")), "json", layouts)
    value = F.try_parse_json(F.col("json"))
    turns = F.when(F.lit(False), F.array(_turn(F.lit(0), F.lit(""), F.lit(""))))
    for x in layouts:
        if x.listed:
            array, role, text = x.listed
            held = F.try_variant_get(value, f"$.{array}", f"array<struct<`{role}`: string, `{text}`: string>>")
            made = _numbered(held, x)
        elif x.fields:
            made = _fixed(x, lambda p: F.try_variant_get(value, f"$.{p}", "string"))
        else:
            continue
        turns = turns.when(F.col("layout") == x.name, made)
    return named.select("conv_id", F.explode(turns).alias("t")).select("conv_id", "t.turn", "t.role", "t.text")


@dataclass(frozen=True)
class Template:
    """``marks``: what stands before and after the text of a role; ``other``: before the name of any other role, between it and the text, after the
    text; ``controls``: what no text may hold; ``learned``: roles whose texts the loss covers."""

    marks: dict[str, tuple[str, str]]
    other: tuple[str, str, str]
    controls: tuple[str, ...]
    learned: frozenset[str] = frozenset({"assistant"})

    def escape(self, text: Column) -> Column:
        inside = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)
        return F.regexp_replace(F.replace(text, F.lit(JOINER), F.lit(JOINER * 2)), inside, f"$0{JOINER}")

    def escape_role(self, role: Column) -> Column:
        """Where a line end closes a role's name, line ends inside names become spaces."""
        return self.escape(F.replace(role, F.lit("\n"), F.lit(" ")) if self.other[1] == "\n" else role)

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, f"{JOINER}({JOINER}?)", "$1")

    def by_role(self, role: Column, known, other: Column) -> Column:
        """``known(name, open, close)`` for the roles that have marks of their own, else ``other``."""
        return reduce(lambda so_far, m: so_far.when(role == m[0], known(m[0], *m[1])), self.marks.items(), F.when(F.lit(False), other)).otherwise(other)

    @property
    def pattern(self) -> str:
        """Matches one formatted turn."""
        named = f"{re.escape(self.other[0])}.*?{re.escape(self.other[1])}.*?{re.escape(self.other[2])}"
        return "(?s)" + "|".join([*(f"{re.escape(a)}.*?{re.escape(b)}" for a, b in sorted(self.marks.values(), key=lambda m: -len(m[0].strip()))), named])


#: Marks in the manner of Llama 2; a role of any other name is written out.
INST = Template(
    marks={"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>")},
    other=("<s>[ROLE]", "[/ROLE] ", " </s>"),
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]"),
)
CHATML = Template(marks={}, other=("<|im_start|>", "\n", "<|im_end|>\n"), controls=("<|im_start|>", "<|im_end|>"))


def format_turns(turns: DataFrame, template: Template = INST) -> DataFrame:
    """One row per conversation of canonical turns: conv_id, n_turns, formatted, and ``mask``: for each turn in order start, loss_start, loss_end.

    Places count code points of ``formatted`` from 0; what the loss covers is [loss_start, loss_end), nothing where they are equal.
    """
    empty = F.lit("")
    clean = turns.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    safe = template.escape(F.col("text"))
    role = F.col("role")
    name, between, end = (F.lit(x) for x in template.other)
    written = F.concat(name, template.escape_role(role), between, safe, end)
    before = F.length(F.concat(name, template.escape_role(role), between))
    marked = clean.select(
        "conv_id", "turn", "role", "text",
        template.by_role(role, lambda _, a, b: F.concat(F.lit(a), safe, F.lit(b)), written).alias("piece"),
        template.by_role(role, lambda _, a, b: F.lit(len(a)), before).cast("long").alias("before"),
        F.when(role.isin(*template.learned), F.length(safe)).otherwise(0).cast("long").alias("covered"),
    )
    ordered = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece").cast("long")).over(ordered), F.lit(0))
    placed = marked.withColumn("start", start).select(
        "conv_id", F.struct("start", (F.col("start") + F.col("before")).alias("loss_start"), (F.col("start") + F.col("before") + F.col("covered")).alias("loss_end"), "piece").alias("p")
    )
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))  # starts differ, no piece is empty
    mask = F.transform("ps", lambda p: F.struct(p["start"].alias("start"), p["loss_start"].alias("loss_start"), p["loss_end"].alias("loss_end")))
    return whole.select("conv_id", F.size("ps").cast("long").alias("n_turns"), F.array_join(F.transform("ps", lambda p: p["piece"]), "").alias("formatted"), mask.alias("mask"))


def read_back(formatted: DataFrame, template: Template = INST, formatted_col: str = "formatted", mask_col: str = "mask") -> DataFrame:
    """The columns of ``formatted`` with what its string says: ``turns`` (role, text), and ``learned``: the texts under the mask, in order."""
    name, between, end = template.other
    pieces = F.regexp_extract_all(F.col(formatted_col), F.lit(template.pattern), F.lit(0))
    cut = lambda piece, a, b: F.substring(piece, a + 1, F.greatest(F.length(piece) - a - b, F.lit(0)))

    def turn(piece: Column) -> Column:
        named = F.substring_index(F.substr(piece, F.lit(len(name) + 1)), between, 1)
        made = F.when(
            piece.startswith(name),
            F.struct(template.unescape(named).alias("role"), template.unescape(cut(piece, F.length(named) + len(name) + len(between), F.lit(len(end)))).alias("text")),
        )
        for role, (a, b) in sorted(template.marks.items(), key=lambda m: -len(m[1][0].strip())):
            made = made.when(piece.startswith(a), F.struct(F.lit(role).alias("role"), template.unescape(cut(piece, F.lit(len(a)), F.lit(len(b)))).alias("text")))
        return made

    masked = F.zip_with("_pieces", mask_col, lambda p, m: F.when(m["loss_end"] > m["loss_start"], F.substr(p, (m["loss_start"] - m["start"] + 1).cast("int"), (m["loss_end"] - m["loss_start"]).cast("int"))))
    found = formatted.withColumn("_pieces", pieces)
    found = found.withColumns({"turns": F.transform("_pieces", turn), "learned": F.transform(F.filter(masked, lambda t: t.isNotNull()), template.unescape)})
    return found.drop("_pieces")


OWN_ID = -7
OWN_TEXT = "</s>[INST] ok [/INST]"


def op13_chat_format(spark, sf_dir):
    rows = canonical_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    message = lambda role: F.struct(F.lit(role).alias("role"), F.lit(OWN_TEXT).alias("content"))
    own = spark.range(1).select(F.lit(OWN_ID).cast("long").alias("conv_id"), F.array(message("user"), message("assistant")).alias("messages"))
    found = read_back(format_turns(rows.unionByName(canonical_turns(own))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("learned", "")
    return found.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP13_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized as (
  select *, length(text) + length(text) - length(replace(text, chr(8288), '')) + len(regexp_extract_all(text, '</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]')) as escaped,
         length(role) + length(role) - length(replace(role, chr(8288), '')) + len(regexp_extract_all(role, '</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]')) as named
  from turns)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls last, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls last, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(escaped + case role when 'system' then 18 when 'user' then 18 when 'assistant' then 6 else named + 22 end)::bigint as formatted_chars
from sized group by conv_id
"""
