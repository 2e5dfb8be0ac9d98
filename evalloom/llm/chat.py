"""Chat formatting: heterogeneous records to canonical turns by schema fingerprint, turns to one training text.

A record's fingerprint is the hash of its nested field paths: the schema of the parsed JSON value, without leaf types. A
registry maps fingerprints to declarative layouts: which paths hold roles and texts, at the top or below one of `WRAPPERS`
(`{"data": {"prompt": ...}}`). A text may be a list of parts (`[{"type": "text", "text": ...}]`), whose texts are joined; parts
without text count as empty. A record with further fields takes the first layout whose fields are all there in the shape that it
reads, unless one of the further fields is known to hold turns too (`TURN_FIELDS`): then no layout fits, as a turn would be lost. Everything
is native: parse_json, schema_of_variant, variant_get. Rows that are columns already can skip JSON: their layout follows from
the fingerprint of the schema.

The template is `<|im_start|>role<|im_sep|>text<|im_end|>` for each turn. In roles and texts every backslash is doubled
and a backslash is put behind the first character of each control string (also those of other templates), so no control
string of a text survives, and reading back undoes both. Loss spans cover the assistant texts, without markers.

Defined cases: null roles and texts are empty, and an empty text is a turn like any other; turns sort by turn number, nulls
first, ties by role and text, and repeated rows are turns of their own; a record no layout fits, or that isn't JSON, has layout
null and no turns; an empty table gives no rows; a JSON record that doesn't fit a variant (128 MB) is an error, texts in it may
have any length up to that; a conversation of columns is one row and must fit one (2 GB). Results are columns called `_cf_*`,
which replace input columns of these names; all others pass through.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.llm._shared import let, table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Jackson's limits, lifted: strings are 20,000,000 characters at most in try_parse_json.
LIFTED = {"maxStringLen": "2147483647", "maxNumLen": "2147483647", "maxNestingDepth": "100000"}
#: Bytes of JSON that always fit a variant, which takes at most 6 bytes for one of JSON (arrays of digits).
SURELY_FITS = 16 << 20
#: Control strings that are broken inside texts.
CONTROL = (START, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


#: Fields that may hold the record itself; the first stands for none.
WRAPPERS = ("", "data", "sample", "record")
TURNS = "array<struct<role: string, text: string>>"


@dataclass(frozen=True)
class Layout:
    """Turns come from fixed fields (role, field), then from an array of objects with a role and a text field; parts says that texts
    are lists of parts; below names the field that holds all of it."""

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    array: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()
    parts: bool = False
    below: str = ""

    def names(self) -> list[str]:
        return [f for _, f in self.fields] + [self.array] * bool(self.array)

    def structure(self) -> str:
        """What structure_of() gives for a record of exactly this layout."""
        part = ": ARRAY<OBJECT<text, type>>" if self.parts else ""
        inner = {f: f + part for _, f in self.fields}
        if self.array:
            inner[self.array] = f"{self.array}: ARRAY<OBJECT<{', '.join(sorted((self.role, self.text + part)))}>>"
        inner = ", ".join(inner[f] for f in sorted(inner))
        return f"OBJECT<{self.below}: OBJECT<{inner}>>" if self.below else f"OBJECT<{inner}>"

    def path(self, field: str) -> str:
        return f"$.{self.below}.{field}" if self.below else f"$.{field}"

    def shapes(self) -> list[tuple[str, str]]:
        """(field, a pattern of the structure that turns() reads)."""
        text = rf"{self.text}(: {PARTS_SHAPE})?"
        objects = rf"^ARRAY<OBJECT<(?=(.*, )?{self.role}[,>])(?=(.*, )?{text}[,>]).*>>$"
        return [(f, objects if f == self.array else f"^([A-Z0-9(), ]+|{PARTS_SHAPE})$") for f in self.names()]

    def turns(self, record: Column, native: bool = False) -> Column:
        """The turns of a variant, or of a struct column (native)."""
        inside = record[self.below] if native and self.below else record

        def plain(text: Column, native: bool = native) -> Column:
            if native:
                text = F.array_join(F.transform(text, lambda p: F.coalesce(p["text"], F.lit(""))), "") if self.parts else text.cast("string")
            else:
                text = variant_text(text)
            return F.coalesce(text, F.lit(""))

        texts = [plain(inside[f] if native else F.try_variant_get(record, self.path(f), "variant")) for _, f in self.fields]
        fixed = [F.struct(F.lit(role).alias("role"), text.alias("text")) for (role, _), text in zip(self.fields, texts, strict=True)]
        if not self.array:
            return F.array(*fixed)
        kind = f"array<struct<`{self.role}`: string, `{self.text}`: variant>>"
        rows = inside[self.array] if native else F.try_variant_get(record, self.path(self.array), kind)

        def canonical(x: Column) -> Column:
            role = F.coalesce(x[self.role], F.lit(""))
            for source, name in self.roles:
                role = F.when(x[self.role] == source, name).otherwise(role)
            return F.struct(role.alias("role"), plain(x[self.text]).alias("text"))

        rows = F.transform(rows, canonical)
        return F.concat(F.array(*fixed), rows) if fixed else rows


def variant_text(value: Column) -> Column:
    """A variant's text: the texts of its parts if it is an array, its own text if it is one part, else its value as a string."""
    parts = F.try_variant_get(value, "$", "array<struct<text: string>>")
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")
    kind = F.schema_of_variant(value)
    return F.when(kind.startswith("ARRAY<OBJECT<"), joined).when(kind.startswith("OBJECT<"), F.try_variant_get(value, "$.text", "string")).otherwise(F.try_variant_get(value, "$", "string"))


SHAREGPT = (("human", "user"), ("gpt", "assistant"))
PLAIN = (
    Layout("messages", array="messages", role="role", text="content"),
    Layout("conversations", array="conversations", role="from", text="value", roles=SHAREGPT),
    Layout("system_prompt_response", (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction_input_output", (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("instruction_output", (("user", "instruction"), ("assistant", "output"))),
    Layout("prompt_response", (("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_completion", (("user", "prompt"), ("assistant", "completion"))),
    Layout("question_answer", (("user", "question"), ("assistant", "answer"))),
    Layout("query_answer", (("user", "query"), ("assistant", "answer"))),
    Layout("query_response", (("user", "query"), ("assistant", "response"))),
    Layout("inputs_targets", (("user", "inputs"), ("assistant", "targets"))),
    Layout("system_messages", (("system", "system"),), "messages", "role", "content"),
    Layout("system_conversations", (("system", "system"),), "conversations", "from", "value", SHAREGPT),
)
#: Fields that hold turns, or parts of them, in some layout; a near match may not pass over one.
TURN_FIELDS = tuple(sorted({f for x in PLAIN for f in x.names()} | {"chosen", "context", "dialog", "dialogue", "history", "rejected", "system_prompt", "turns"}))
#: What structure_of() gives for a list of parts, as a pattern.
PARTS_SHAPE = "ARRAY<OBJECT<(?:[^<>]*, )?text(?:, [^<>]*)?>>"
#: Each plain layout, below each wrapper, with plain texts and with parts.
LAYOUTS = tuple(replace(x, below=w, parts=p, name=x.name + ("_parts" if p else "") + (f"_in_{w}" if w else "")) for w in WRAPPERS for p in (False, True) for x in PLAIN)


def structure_of(record: Column) -> Column:
    """The nested field paths of a variant in one canonical string: names sorted, leaf types left out."""
    return F.regexp_replace(F.schema_of_variant(record), r": (?!OBJECT<|ARRAY<)[A-Z ]+(\([^)]*\))?", "")


def fields_of(record: Column) -> Column:
    """The fields of a variant with the structure of each; null if it is no object."""
    return F.transform_values(F.try_variant_get(record, "$", "map<string, variant>"), lambda _, v: structure_of(v))


def near_layout(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The first layout whose fields a record has, among others, in the shape that is read, if none of the others holds turns."""

    def turns_left_out(fields: Column, named) -> Column:
        return F.exists(F.array(*map(F.lit, TURN_FIELDS)), lambda t: (F.coalesce(F.try_element_at(fields, t), F.lit("VOID")) != "VOID") & ~named(t))

    def fitting(below: str, fields: Column) -> Column:
        known = F.array(*[F.struct(F.lit(x.name).alias("name"), F.array(*[F.struct(F.lit(f).alias("field"), F.lit(p).alias("shape")) for f, p in x.shapes()]).alias("fields")) for x in layouts if x.below == below and not x.parts])
        has = lambda x: F.forall(x["fields"], lambda f: F.coalesce(F.rlike(F.try_element_at(fields, f["field"]), f["shape"]), F.lit(False)))
        return F.get(F.filter(known, lambda x: has(x) & ~turns_left_out(fields, lambda t: F.exists(x["fields"], lambda f: f["field"] == t))), F.lit(0))["name"]

    def of(top: Column) -> Column:
        out = fitting("", top)
        for w in [w for w in WRAPPERS if w and any(x.below == w for x in layouts)]:
            inside = let(fields_of(F.try_variant_get(record, f"$.{w}", "variant")), partial(fitting, w))
            out = F.coalesce(out, F.when(F.map_contains_key(top, F.lit(w)) & ~turns_left_out(top, lambda _: F.lit(False)), inside))
        return out

    return let(fields_of(record), of)


def layout_of(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The name of the layout with the record's fingerprint, else of the first that fits."""
    exact = F.create_map(*[F.lit(v) for x in layouts for v in (hash_of(x.structure()), x.name)])
    return F.coalesce(F.try_element_at(exact, F.md5(structure_of(record))), near_layout(record, layouts))


def hash_of(structure: str) -> str:
    return hashlib.md5(structure.encode(), usedforsecurity=False).hexdigest()


def parsed(json: Column) -> Column:
    """A JSON text as a variant; null if it isn't JSON, an error if it is but doesn't fit."""
    valid = F.from_json(json, "struct<_bad: string>", {**LIFTED, "columnNameOfCorruptRecord": "_bad"})["_bad"].isNull()
    over = F.raise_error(F.concat(F.lit("a JSON record is over the limit of a variant: bytes "), F.octet_length(json).cast("string")))
    lost = F.when((F.octet_length(json) > SURELY_FITS) & valid, over.cast("variant"))
    return F.coalesce(F.try_parse_json(json), F.from_json(json, "variant", LIFTED), lost)


def structure_of_type(kind: T.DataType) -> str:
    """What structure_of() gives for a record of this schema."""
    if isinstance(kind, T.StructType):
        fields = sorted(((f.name, f.dataType) for f in kind.fields), key=lambda x: x[0])
        return f"OBJECT<{', '.join(f'{n}: {structure_of_type(t)}' if isinstance(t, T.StructType | T.ArrayType) else n for n, t in fields)}>"
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{structure_of_type(kind.elementType)}>"
    return kind.simpleString().upper()


def replaced(df: DataFrame, **columns: Column) -> DataFrame:
    """df with these columns, in place of any of the same names."""
    return df.select(*[c for c in df.columns if c not in columns], *[c.alias(n) for n, c in columns.items()])


def reads(layout: Layout, field: str, kind: T.DataType) -> bool:
    """Whether a column of this type has the shape that a layout without parts reads."""
    if field != layout.array:
        return isinstance(kind, T.AtomicType)
    inner = kind.elementType if isinstance(kind, T.ArrayType) else None
    return isinstance(inner, T.StructType) and all(f in inner.names and isinstance(inner[f].dataType, T.AtomicType) for f in (layout.role, layout.text))


def native_turns(df: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """canonical_turns() for a struct column: the layout follows from the schema, no text is parsed."""
    kind = df.schema[record].dataType
    exact = [x for x in layouts if x.structure() == structure_of_type(kind)]
    near = [x for x in layouts if not x.below and not x.parts and not set(TURN_FIELDS) & set(kind.names) - set(x.names()) and all(f in kind.names and reads(x, f, kind[f].dataType) for f in x.names())]
    none = F.array().cast(TURNS)
    if not exact + near:
        return replaced(df, _cf_layout=F.lit(None).cast("string"), _cf_turns=none)
    layout = (exact + near)[0]
    return replaced(df, _cf_layout=F.lit(layout.name), _cf_turns=F.coalesce(layout.turns(F.col(record), native=True), none))


def canonical_turns(df: DataFrame, json: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """df with _cf_layout (string) and _cf_turns (array of role, text) for its column of JSON texts."""
    df = replaced(df, _cf_record=parsed(F.col(json)))
    df = replaced(df, _cf_layout=layout_of(F.col("_cf_record"), layouts))
    turns, none = F.lit(None).cast(TURNS), F.array().cast(TURNS)
    for x in layouts:
        # the text of a variant tells itself whether it has parts, so a plain layout reads both
        if not x.parts:
            names = [y.name for y in layouts if replace(y, parts=False, name="") == replace(x, name="")]
            turns = F.when(F.col("_cf_layout").isin(*names), x.turns(F.col("_cf_record"))).otherwise(turns)
    return replaced(df, _cf_turns=F.coalesce(turns, none)).drop("_cf_record")


def quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\^$.|?*+()[]{}<>" and c not in "<>" else c for c in text)


def escape(text: Column) -> Column:
    """Doubles backslashes, then puts one behind the first character of each control string."""
    pattern = "|".join(f"(?<={quoted(c[0])})(?={quoted(c[1:])})" for c in CONTROL)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), pattern, "\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_turns(df: DataFrame) -> DataFrame:
    """df with _cf_formatted (string) and _cf_loss_spans (array of start and length in code points, from 0) for its _cf_turns."""
    parts = F.transform("_cf_turns", lambda t: F.struct(F.concat(F.lit(START), escape(t["role"]), F.lit(SEP)).alias("head"), escape(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss")))
    df = replaced(df, _cf_parts=parts)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: long, length: long>>").alias("spans"))

    def add(a: Column, p: Column) -> Column:
        start, length = (a["at"] + F.length(p["head"])).cast("long"), F.length(p["text"]).cast("long")
        spans = F.when(p["loss"], F.concat(a["spans"], F.array(F.struct(start.alias("start"), length.alias("length"))))).otherwise(a["spans"])
        return F.struct((start + length + len(END)).cast("long").alias("at"), spans.alias("spans"))

    text = F.array_join(F.transform("_cf_parts", lambda p: F.concat(p["head"], p["text"], F.lit(END))), "")
    return replaced(df, _cf_formatted=text, _cf_loss_spans=F.aggregate("_cf_parts", zero, add, lambda a: a["spans"])).drop("_cf_parts")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text holds."""
    rows = F.filter(F.split(formatted, quoted(START)), lambda x: x != "")

    def turn(x: Column) -> Column:
        at = F.locate(SEP, x)
        return F.struct(unescape(F.substring(x, F.lit(1), at - 1)).alias("role"), unescape(F.substring(x, at + len(SEP), F.length(x) - at - len(SEP) - len(END) + 1)).alias("text"))

    return F.transform(rows, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


#: Bytes of text up to which the query makes a conversation a JSON record; a longer one stays a struct of columns.
JSON_BYTES = 4 << 20
#: The roles, in order, that let a conversation take a layout of fixed fields; all others take one of the two arrays.
SHAPES = {
    ("user", "assistant"): ("instruction_output", "prompt_response", "prompt_completion", "question_answer", "query_answer", "query_response", "inputs_targets"),
    ("system", "user", "assistant"): ("system_prompt_response", "system_messages", "system_conversations"),
    ("user", "user", "assistant"): ("instruction_input_output",),
}


def conversations_of(rows: DataFrame) -> DataFrame:
    """(conv_id, m, bytes): the rows of each conversation, by turn, nulls empty; m: array of turn, role, content."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    size = F.sum(F.coalesce(F.octet_length("role"), F.lit(0)).cast("long") + F.coalesce(F.octet_length("text"), F.lit(0)))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("m"), size.alias("bytes"))  # at most a conversation's turns


def dealt_json(m: Column, deal: Column) -> Column:
    """The turns as a JSON record of one of the layouts that their roles allow, by the number deal: below a wrapper or not,
    texts as strings or as parts."""
    by_name = {x.name: x for x in PLAIN}

    def part(text: Column, parts: bool) -> Column:
        return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))) if parts else text

    def json(x: Layout, below: str, parts: bool) -> Column:
        fields = [part(F.get(m, F.lit(i))["content"], parts).alias(f) for i, (_, f) in enumerate(x.fields)]

        def row(t: Column) -> Column:
            role = t["role"]
            for source, name in x.roles:
                role = F.when(t["role"] == name, source).otherwise(role)
            return F.struct(role.alias(x.role), part(t["content"], parts).alias(x.text))

        rest = F.slice(m, len(fields) + 1, F.size(m)) if fields else m
        inner = F.struct(*fields, *([F.transform(rest, row).alias(x.array)] if x.array else []))
        return F.to_json(F.struct(inner.alias(below)) if below else inner)

    def pick(names: tuple[str, ...]) -> Column:
        ways = [(by_name[n], w, p) for n in names for w in WRAPPERS[:2] for p in (False, True)]
        out = json(*ways[0])
        for i, way in enumerate(ways[1:], 1):
            out = F.when(F.pmod(deal, F.lit(len(ways))) == i, json(*way)).otherwise(out)
        return out

    roles = F.transform(m, lambda t: t["role"])
    odd = F.exists(m, lambda t: t["role"].isin(*[source for source, _ in SHAREGPT]))
    out = F.when(odd, pick(("messages",))).otherwise(pick(("messages", "conversations")))
    for shape, names in SHAPES.items():
        out = F.when(roles == F.array(*map(F.lit, shape)), pick(names)).otherwise(out)
    return out


def formatted(rows: DataFrame) -> DataFrame:
    """(conv_id, _cf_layout, _cf_formatted, _cf_loss_spans) of all conversations: records of many layouts, each read by its fingerprint."""
    every = conversations_of(rows)
    record = F.struct(F.transform("m", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))
    short = F.col("bytes") <= JSON_BYTES
    both = every.select("conv_id", F.when(short, dealt_json(F.col("m"), F.xxhash64("conv_id"))).alias("json"), F.when(~short, record).alias("record"))
    both = canonical_turns(both, "json").select("conv_id", "record", F.col("_cf_layout").alias("l"), F.col("_cf_turns").alias("t"))
    both = native_turns(both, "record")
    long = F.col("record").isNotNull()
    both = both.select("conv_id", F.when(long, F.col("_cf_layout")).otherwise(F.col("l")).alias("_cf_layout"), F.when(long, F.col("_cf_turns")).otherwise(F.col("t")).alias("_cf_turns"))
    return format_turns(both).select("conv_id", "_cf_layout", "_cf_formatted", "_cf_loss_spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    out = formatted(rows.unionByName(more))
    back = out.select("conv_id", F.col("_cf_formatted").alias("formatted"), read_turns(F.col("_cf_formatted")).alias("t"), read_loss(F.col("_cf_formatted"), F.col("_cf_loss_spans")).alias("loss"))
    digest = F.sha2(F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256)
    return back.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), digest.alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(role) + length(text) + (length(role || text) - length(replace(role || text, chr(92), '')))
    + len(regexp_extract_all(role, '<\|im_start\|>|<\|im_sep\|>|<\|im_end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>'))
    + len(regexp_extract_all(text, '<\|im_start\|>|<\|im_sep\|>|<\|im_end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>'))
    + 32 AS chars
  FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
