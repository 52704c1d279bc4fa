"""Chat formatting by schema fingerprints, in DataFrame operations only.

A layout is declared by the nested field paths that it needs and a mapping to canonical turns (role, text). The hash of a
record's sorted known paths is its fingerprint; fingerprints of every combination of a layout's needed and optional paths
select its mapping. JSON records are fingerprinted row by row, tables by their schema.

Template: each turn is `<|role|>`, a newline, the text, `<|end|>`, a newline. In texts and roles a backslash follows each
backslash and the first character of each control string (`<|`, `<s>`, `</s>`, `[INST]`, `[/INST]`; in roles `|>` too), so
none stays intact inside and removing one backslash before each character restores the text.

Defined cases: null texts and null roles are empty; turns are ordered by turn, then role and text (nulls first), and
repeated rows are repeated turns; a null conversation id is a conversation of its own; unknown layouts give a null layout
and no turns; extra columns and paths that no layout declares are ignored; without turns there is no conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

TURNS = "array<struct<role:string,text:string>>"
END = "<|end|>\n"


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


@dataclass(frozen=True)
class Layout:
    name: str
    needed: frozenset[str]
    optional: frozenset[str]
    turns: Callable[[Column], Column]

    def fingerprints(self) -> list[str]:
        extra = sorted(self.optional)
        return [fingerprint(self.needed | set(c)) for k in range(len(extra) + 1) for c in combinations(extra, k)]


def _turn(role: str | Column, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), text.alias("text"))


def _messages(field: str, role: str, text: str) -> Callable[[Column], Column]:
    kind = f"array<struct<{role}:string,{text}:string>>"
    return lambda raw: F.transform(F.from_json(F.get_json_object(raw, f"$.{field}"), kind), lambda m: _turn(_canonical(m[role]), m[text]))


def _canonical(role: Column) -> Column:
    return F.when(role.isin("human", "prompter"), "user").when(role.isin("gpt", "bot", "model"), "assistant").otherwise(role)


def _pair(*fields: tuple[str, str]) -> Callable[[Column], Column]:
    def turns(raw: Column) -> Column:
        got = [_turn(role, F.get_json_object(raw, f"$.{f}")) for f, role in fields]
        return F.filter(F.array(*got), lambda t: t["text"].isNotNull())

    return turns


def _instruction(raw: Column) -> Column:
    field = lambda f: F.get_json_object(raw, f"$.{f}")
    asked = F.concat_ws("\n\n", field("instruction"), F.nullif(field("input"), F.lit("")))
    got = F.array(_turn("system", field("system")), _turn("user", asked), _turn("assistant", field("output")))
    return F.filter(got, lambda t: t["text"].isNotNull())


LAYOUTS = (
    Layout("messages", frozenset({"messages", "messages[].role", "messages[].content"}), frozenset(), _messages("messages", "role", "content")),
    Layout("sharegpt", frozenset({"conversations", "conversations[].from", "conversations[].value"}), frozenset(), _messages("conversations", "from", "value")),
    Layout("instruction", frozenset({"instruction", "output"}), frozenset({"input", "system"}), _instruction),
    Layout("prompt-completion", frozenset({"prompt", "completion"}), frozenset({"system"}), _pair(("system", "system"), ("prompt", "user"), ("completion", "assistant"))),
    Layout("prompt-response", frozenset({"prompt", "response"}), frozenset({"system"}), _pair(("system", "system"), ("prompt", "user"), ("response", "assistant"))),
)
#: Layouts of tables with a row for each turn: their columns as (conversation, turn, role, text).
TURN_ROWS = {
    fingerprint({"conv_id", "turn", "role", "text"}): ("conv_id", "turn", "role", "text"),
    fingerprint({"conversation_id", "position", "role", "content"}): ("conversation_id", "position", "role", "content"),
}
_KNOWN = sorted({p for x in LAYOUTS for p in x.needed | x.optional})
_LISTS = sorted({p.split("[]")[0] for p in _KNOWN if "[]" in p})


def json_paths(raw: Column) -> Column:
    """The known nested field paths of a JSON record, sorted; a list's fields are those of its first element."""
    top = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))

    def inner(field: str) -> Column:
        keys = F.coalesce(F.json_object_keys(F.get_json_object(raw, f"$.{field}[0]")), F.array().cast("array<string>"))
        return F.transform(keys, lambda k: F.concat(F.lit(f"{field}[]."), k))

    return F.array_sort(F.array_intersect(F.array_distinct(F.concat(top, *map(inner, _LISTS))), F.array(*[F.lit(p) for p in _KNOWN])))


def canonical_turns(records: DataFrame, raw: str = "record") -> DataFrame:
    """records with layout and turns, as the fingerprint of each JSON record selects them."""
    print_of = F.sha2(F.array_join(json_paths(F.col(raw)), "\n"), 256)
    at = records.withColumn("_fingerprint", print_of)
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in LAYOUTS:
        on = F.col("_fingerprint").isin(x.fingerprints())
        layout = F.when(on, x.name).otherwise(layout)
        turns = F.when(on, x.turns(F.col(raw)).cast(TURNS)).otherwise(turns)
    return at.select(*records.columns, layout.alias("layout"), turns.alias("turns"))


def schema_paths(schema: T.StructType, prefix: str = "") -> set[str]:
    """All nested field paths of a schema."""
    out: set[str] = set()
    for f in schema.fields:
        path, kind = prefix + f.name, f.dataType
        out.add(path)
        while isinstance(kind, T.ArrayType):
            path, kind = path + "[]", kind.elementType
        if isinstance(kind, T.StructType):
            out |= schema_paths(kind, path + ".")
    return out


def turn_rows(table: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of a table with a row for each turn, by the fingerprint of its schema."""
    present = schema_paths(table.schema)
    for columns in TURN_ROWS.values():
        if TURN_ROWS.get(fingerprint(present & set(columns))) == columns:
            return table.select(*[F.col(c).alias(n) for c, n in zip(columns, ("conv_id", "turn", "role", "text"))])
    raise ValueError(f"no layout of turn rows has the paths {sorted(present)}")


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\\|<(?=\||/?s>)|\[(?=/?INST\])", r"$0\\")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(F.coalesce(role, F.lit("")), r"\\|<(?=\||/?s>)|\[(?=/?INST\])|\|(?=>)", r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_rows(rows: DataFrame) -> DataFrame:
    """conv_id, formatted and loss (start and length, in code points, of each assistant text) of conv_id, turn, role, text."""
    head = F.concat(F.lit("<|"), escape_role(F.col("role")), F.lit("|>\n"))
    r = rows.select("conv_id", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    r = r.withColumn("size", F.length("head") + F.length("body") + len(END))
    order = ("turn", "role", "text")
    before = F.coalesce(F.sum("size").over(W.partitionBy("conv_id").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    r = r.withColumn("at", before)
    # The offset orders the pieces: it grows with every turn.
    piece = F.struct("at", F.concat("head", "body", F.lit(END)).alias("piece"), F.when(F.col("role") == "assistant", F.struct((F.col("at") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"))).alias("loss"))
    g = r.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    return g.select("conv_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), F.filter(F.transform("p", lambda x: x["loss"]), lambda x: x.isNotNull()).alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text."""
    parts = F.split(formatted, r"<\|end\|>\n", -1)
    whole = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.transform(whole, lambda s: F.struct(unescape(F.regexp_extract(s, r"(?s)^<\|(.*?)\|>\n", 1)).alias("role"), unescape(F.regexp_replace(s, r"(?s)^<\|.*?\|>\n", "")).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda x: unescape(F.substring(formatted, x["start"].cast("int") + 1, x["length"].cast("int")))), "")


def digest(conversations: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted texts, with conversation -1 added."""
    rows = turn_rows(conversations)
    said = "</s>[INST] ok [/INST]"
    spark = conversations.sparkSession
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    f = format_rows(rows.unionByName(extra)).withColumn("turns", read_back(F.col("formatted"))).withColumn("under", loss_text(F.col("formatted"), F.col("loss")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return f.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("under").cast("long").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
           UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]', role, '' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
e AS (SELECT *, length(role) + length(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')) + 13 AS size FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
