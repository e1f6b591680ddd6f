"""Chat formatting by schema fingerprints.

A record's layout is the sorted list of its nested field paths with their kinds; the hash of that list is its
fingerprint. A registry maps fingerprints to declarative mappings, each a list of turns: where the role comes from
(a constant or a field) and where the text does. Rows of any registered layout become canonical turns
(role, text), which a template then writes as one string with loss spans over the assistant's texts.

The template marks a turn by control strings. A text may hold the same strings, so its escape character and every
opening of a control string are escaped first; undoing that gives back the text exactly. All of it is built from
DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Control strings. A turn is OPEN role MIDDLE text CLOSE. Every control string begins with one of STARTS.
OPEN, MIDDLE, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
#: What begins a control string of this or other common templates, and what it is escaped to.
ESCAPE = "\\"
STARTS = ("<", "[")
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    ``turns``: (role, text) pairs; a role that begins with "=" is a constant, others are field paths. ``array``: path of an
    array whose elements are the turns, to which the paths are then relative. ``roles``: names of roles to canonical ones.
    """

    turns: tuple[tuple[str, str], ...]
    array: str | None = None
    roles: tuple[tuple[str, str], ...] = (("human", "user"), ("prompter", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths with kinds; an array adds [] to its path. Order and nullability do not matter."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    if isinstance(kind, T.MapType):
        return field_paths(kind.valueType, f"{at}{{}}")
    return [f"{at}:{'text' if isinstance(kind, T.StringType) else 'other'}"]


def fingerprint(kind: T.DataType) -> str:
    """Hash of a layout: 16 hex digits."""
    from hashlib import sha256

    return sha256("\n".join(field_paths(kind)).encode()).hexdigest()[:16]


def _layout(ddl: str) -> str:
    return fingerprint(_parse(ddl))


def _parse(ddl: dict | str | list) -> T.DataType:
    """Layouts as nested literals: dict = struct, one-element list = array, str = text."""
    if isinstance(ddl, dict):
        return T.StructType([T.StructField(k, _parse(v)) for k, v in ddl.items()])
    return T.ArrayType(_parse(ddl[0])) if isinstance(ddl, list) else T.StringType()


#: Layouts with their mappings.
LAYOUTS: list[tuple[dict | str | list, Mapping]] = [
    ({"prompt": "", "response": ""}, Mapping((("=user", "prompt"), ("=assistant", "response")))),
    ({"prompt": "", "completion": ""}, Mapping((("=user", "prompt"), ("=assistant", "completion")))),
    ({"question": "", "answer": ""}, Mapping((("=user", "question"), ("=assistant", "answer")))),
    ({"instruction": "", "output": ""}, Mapping((("=user", "instruction"), ("=assistant", "output")))),
    ({"instruction": "", "input": "", "output": ""}, Mapping((("=user", "instruction"), ("=user", "input"), ("=assistant", "output")))),
    ({"system": "", "prompt": "", "response": ""}, Mapping((("=system", "system"), ("=user", "prompt"), ("=assistant", "response")))),
    ({"messages": [{"role": "", "content": ""}]}, Mapping((("role", "content"),), "messages")),
    ({"conversations": [{"from": "", "value": ""}]}, Mapping((("from", "value"),), "conversations")),
    ({"turns": [{"role": "", "text": ""}]}, Mapping((("role", "text"),), "turns", ())),
]
#: Fingerprint to mapping.
REGISTRY: dict[str, Mapping] = {_layout(layout): mapping for layout, mapping in LAYOUTS}


def register(layout: dict | str | list, mapping: Mapping) -> str:
    """Add a mapping for a layout; returns its fingerprint."""
    LAYOUTS.append((layout, mapping))
    REGISTRY[_layout(layout)] = mapping
    return _layout(layout)


def canonical_turns(records: DataFrame, id_col: str, columns: list[str] | None = None) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, fingerprint): the records' own layout picks the mapping.

    ``columns`` are those that make up the record, all but the id if left out; name them where others stand beside.
    A field that is null gives no turn if the mapping names several fields (an instruction without input), a null text
    in an array of turns is empty. An unknown layout raises ValueError with its paths.
    """
    columns = columns or [c for c in records.columns if c != id_col]
    kind = T.StructType([f for f in records.schema if f.name in columns])
    mark = fingerprint(kind)
    if mark not in REGISTRY:
        raise ValueError(f"no mapping for layout {mark}: {field_paths(kind)}")
    rule = REGISTRY[mark]
    called = lambda r: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in rule.roles for x in pair]), r), r) if rule.roles else r
    role = lambda at, base: F.lit(at[1:]) if at.startswith("=") else base[at]
    turn = lambda r, t: F.struct(called(r).alias("role"), F.coalesce(t, F.lit("")).alias("text"))
    if rule.array:
        (who, what), base = rule.turns[0], F.col(rule.array)
        turns = F.coalesce(F.transform(base, lambda x: turn(F.coalesce(role(who, x), F.lit("")), x[what])), F.array().cast("array<struct<role:string,text:string>>"))
    else:
        parts = [F.when(F.col(what).isNotNull(), turn(F.lit(who[1:]) if who[0] == "=" else F.col(who), F.col(what))) for who, what in rule.turns]
        turns = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return records.select(F.col(id_col).alias("conv_id"), turns.alias("turns"), F.lit(mark).alias("fingerprint"))


def _variant_kind(layout: dict | str | list) -> str:
    """A layout as ``schema_of_variant`` writes it."""
    if isinstance(layout, dict):
        return f"OBJECT<{', '.join(f'{k}: {_variant_kind(v)}' for k, v in sorted(layout.items()))}>"
    if isinstance(layout, list):
        return f"ARRAY<{_variant_kind(layout[0]) if layout else 'VOID'}>"
    return "STRING"


def _variant_fingerprint(kind: str | Column) -> Column:
    return F.substr(F.sha2(F.lit(kind) if isinstance(kind, str) else kind, 256), F.lit(1), F.lit(16))


def _json_turns(rule: Mapping, value: Column) -> Column:
    """The turns of a variant by a mapping."""
    text = lambda of, name: F.try_variant_get(of, f"$.{name}", "string")
    called = lambda r: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in rule.roles for x in pair]), r), r) if rule.roles else r
    turn = lambda r, t: F.struct(called(r).alias("role"), F.coalesce(t, F.lit("")).alias("text"))
    if rule.array:
        who, what = rule.turns[0]
        items = F.try_variant_get(value, f"$.{rule.array}", "array<variant>")
        return F.coalesce(F.transform(items, lambda x: turn(F.coalesce(text(x, who), F.lit("")), text(x, what))), F.array().cast(TURNS))
    parts = [F.when(text(value, what).isNotNull(), turn(F.lit(who[1:]) if who[0] == "=" else text(value, who), text(value, what))) for who, what in rule.turns]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def canonical_json(records: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(conv_id, turns, fingerprint) of JSON records of any registered layouts, mixed in one table.

    Each record is fingerprinted by itself: its nested field paths with their kinds, fields in order of name, null
    counting as text. A record whose fingerprint has no mapping, null and text that is no JSON have null turns, so that
    nothing is lost; their fingerprint tells which mapping is missing (null if there is no JSON). An empty array of turns
    gives no turns. Otherwise as
    ``canonical_turns``. Other columns are not looked at; repeated rows are returned each.
    """
    value = F.try_parse_json(F.col(json_col).cast("string"))
    # only where a field's kind stands: a field may be named VOID, and an array of VOID is one without items
    kind = F.regexp_replace(F.schema_of_variant(value), r"(?<=: )VOID(?=[,>]|$)", "STRING")
    told = records.select(F.col(id_col).alias("conv_id"), value.alias("value"), _variant_fingerprint(kind).alias("fingerprint"))
    turns = F.lit(None).cast(TURNS)
    for layout, rule in LAYOUTS:
        kinds = [_variant_kind(layout), *([_variant_kind({**layout, rule.array: []})] if rule.array else [])]
        known = F.col("fingerprint").isin(*[_variant_fingerprint(k) for k in kinds])
        turns = F.when(known, _json_turns(rule, F.col("value"))).otherwise(turns)
    return told.select("conv_id", turns.alias("turns"), "fingerprint")


def turns_of_rows(rows: DataFrame) -> DataFrame:
    """Records of layout turns[] from rows (conv_id, turn, role, text), in the order of turn, then role and text."""
    whole = rows.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("row"))
    return whole.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows")).select("conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns"))


def escape(text: Column) -> Column:
    """Text in which no control string can begin: the escape character is doubled, each opening gets one before."""
    text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for start, code in zip(STARTS, "lb", strict=True):
        text = F.replace(text, F.lit(start), F.lit(ESCAPE + code))
    return text


def unescape(text: Column) -> Column:
    """The text that ``escape`` was given: pieces between doubled escape characters are undone one by one."""

    def plain(piece: Column) -> Column:
        for start, code in zip(STARTS, "lb", strict=True):
            piece = F.replace(piece, F.lit(ESCAPE + code), F.lit(start))
        return piece

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), ESCAPE)


def format_chat(records: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans array<struct<start, length>>) of canonical turns.

    Spans count characters of ``formatted`` from 0 and cover the assistant's texts as escaped, without any marker.
    A conversation without turns is an empty string. Turns with equal text are each written.
    """
    parts = records.select("conv_id", F.transform("turns", lambda t: F.struct(
        (t["role"] == "assistant").alias("loss"),
        F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE)).alias("head"),
        escape(t["text"]).alias("body"),
    )).alias("parts"))
    size = lambda p: F.char_length(p["head"]) + F.char_length(p["body"]) + len(CLOSE)
    start = F.lit(0).cast("long")
    empty = F.array().cast("array<struct<start:bigint,length:bigint>>")
    walk = F.aggregate(
        "parts",
        F.struct(start.alias("at"), empty.alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + size(p)).alias("at"),
            F.when(p["loss"], F.array_append(a["spans"], F.struct((a["at"] + F.char_length(p["head"])).alias("start"), F.char_length(p["body"]).cast("long").alias("length")))).otherwise(a["spans"]).alias("spans"),
        ),
    )
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    return parts.select("conv_id", text.alias("formatted"), walk["spans"].alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_texts) parsed from the formatted string and its spans alone."""
    blocks = F.filter(F.split("formatted", CLOSE.replace("|", r"\|"), -1), lambda b: b != "")
    halves = lambda b: F.split(F.substr(b, F.lit(len(OPEN) + 1)), MIDDLE.replace("|", r"\|"), 2)
    turns = F.transform(blocks, lambda b: F.struct(unescape(F.get(halves(b), F.lit(0))).alias("role"), unescape(F.get(halves(b), F.lit(1))).alias("text")))
    losses = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", turns.alias("turns"), losses.alias("loss_texts"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def chat_digest(rows: DataFrame) -> DataFrame:
    """Format conversations given as rows by turn and read them back.

    One row per conv_id: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Null texts and roles are
    empty; equal (conv_id, turn) rows all stay, in the order of role and text; a null conv_id is one conversation. An
    empty table gives an empty result; other columns are not looked at.
    """
    back = read_back(format_chat(canonical_turns(turns_of_rows(rows), "conv_id")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
