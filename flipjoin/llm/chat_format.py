"""Chat formatting by schema fingerprints, in DataFrame expressions alone.

A record is a JSON text in one of several layouts.  Its fingerprint is the hash of its
sorted field paths, two levels deep; it selects a declarative mapping to a list of
(role, text) turns.  Turns are written in a template that marks them and escapes
control strings inside texts so that they can be read back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TURN = "struct<role:string,text:string>"
#: Texts of any length: Spark's own limit is 20 million characters.
WHOLE = {"maxStringLen": str(2**31 - 1)}


@dataclass(frozen=True)
class Layout:
    """A layout: its field paths and where its turns come from.

    ``turns`` lists (role, path) for single texts, or is one (path, role field, text
    field) triple for a list of messages.  ``roles`` renames roles of messages.
    """

    name: str
    paths: tuple[str, ...]
    single: tuple[tuple[str, str], ...] = ()
    messages: tuple[str, str, str] | None = None
    roles: tuple[tuple[str, str], ...] = ()


#: Layouts that are met often in public instruction data.
LAYOUTS = (
    Layout("messages", ("messages", "messages[].content", "messages[].role"), messages=("messages", "role", "content")),
    Layout("empty messages", ("messages",), messages=("messages", "role", "content")),
    Layout("conversations", ("conversations", "conversations[].from", "conversations[].value"),
           messages=("conversations", "from", "value"), roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("prompt", ("completion", "prompt"), single=(("user", "prompt"), ("assistant", "completion"))),
    Layout("response", ("prompt", "response"), single=(("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", ("instruction", "output"), single=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction with system", ("instruction", "output", "system"),
           single=(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
)


def fingerprint(paths: Column) -> Column:
    """The hash of a list of field paths; their order does not matter."""
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(paths)), "\n"))


def fields_of(record: Column) -> Column:
    """The values of a JSON object by name, as text; null where it cannot be read."""
    return F.from_json(record, "map<string,string>", WHOLE)


def field_paths(record: Column, values: Column) -> Column:
    """The field paths of a JSON text: names, and names below the objects of lists.

    ``values`` is ``fields_of`` the record.  Every list element counts, so a record whose
    messages differ in shape has the paths of all of them.
    """
    top = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))

    def below(name: Column) -> Column:
        rows = F.coalesce(F.from_json(values[name], "array<string>", WHOLE), F.array().cast("array<string>"))
        names = F.flatten(F.transform(rows, lambda r: F.coalesce(F.json_object_keys(r), F.array().cast("array<string>"))))
        return F.transform(F.array_distinct(names), lambda n: F.concat(name, F.lit("[]."), n))

    listed = F.filter(top, lambda n: F.substring(F.ltrim(values[n]), 1, 1) == "[")
    return F.concat(top, F.flatten(F.transform(listed, below)))


def _turns_of(layout: Layout, values: Column) -> Column:
    """The turns of a record of this layout; null where its values cannot be read."""
    empty = F.lit("")
    if layout.messages is None:
        turns = F.array(*[F.struct(F.lit(role).alias("role"), F.coalesce(values[path], empty).alias("text"))
                          for role, path in layout.single]).cast(f"array<{TURN}>")
        return F.when(values.isNotNull(), turns)
    path, role, text = layout.messages
    rows = F.from_json(values[path], f"array<struct<`{role}`:string,`{text}`:string>>", WHOLE)

    def renamed(r: Column) -> Column:
        out = F.coalesce(r, empty)
        for old, new in layout.roles:
            out = F.when(out == old, new).otherwise(out)
        return out

    return F.transform(rows, lambda m: F.struct(renamed(m[role]).alias("role"),
                                                F.coalesce(m[text], empty).alias("text"))).cast(f"array<{TURN}>")


def canonical_turns(df: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``df`` with fingerprint, layout (null: none fits) and turns.

    A record that is null, no JSON object, or of no known layout has layout null and
    turns null; it stays in the result.  Null texts and roles count as empty.
    """
    # A record is read once, and the list of the layout that fits once; both are columns, which Spark does not compute again.
    marked = df.withColumn("__values", fields_of(F.col(record))).withColumn("fingerprint", fingerprint(field_paths(F.col(record), F.col("__values"))))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(f"array<{TURN}>")
    for x in reversed(layouts):
        hit = F.col("fingerprint") == fingerprint(F.array(*map(F.lit, x.paths)))
        layout = F.when(hit, x.name).otherwise(layout)
        turns = F.when(hit, _turns_of(x, F.col("__values"))).otherwise(turns)
    named = marked.withColumn("turns", turns).withColumn("layout", F.when(F.col("turns").isNotNull(), layout))
    return named.select(*[c for c in df.columns if c not in ("fingerprint", "layout", "turns")], "fingerprint", "layout", "turns")


def escaped(text: Column) -> Column:
    """``<|`` gets one backslash inside, ``<\\|`` two and so on, so that no ``<|`` is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def formatted(turns: Column) -> Column:
    """The training text of a list of turns.  Roles are written percent-encoded."""
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(START), F.url_encode(t["role"]), F.lit("\n"), escaped(t["text"]), F.lit(END + "\n"))), "")


def loss_spans(turns: Column, role: str = "assistant") -> Column:
    """(start, length) in code points of the formatted text for each text under the loss."""
    state = "struct<at:bigint,spans:array<struct<start:bigint,length:bigint>>>"
    sized = F.transform(turns, lambda t: F.struct(
        (t["role"] == role).alias("loss"),
        (F.length(F.url_encode(t["role"])) + len(START) + 1).cast("long").alias("head"),
        F.length(escaped(t["text"])).cast("long").alias("body")))
    return F.aggregate(
        sized,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")).cast(state),
        lambda acc, t: F.struct(
            (acc["at"] + t["head"] + t["body"] + len(END) + 1).alias("at"),
            F.when(t["loss"], F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + t["head"]).alias("start"), t["body"].alias("length"))))).otherwise(acc["spans"]).alias("spans")).cast(state),
        lambda acc: acc["spans"])


def read_back(text: Column) -> Column:
    """The turns of a formatted text."""
    parts = F.split(text, r"<\|im_end\|>\n")
    turns = F.slice(parts, 1, F.size(parts) - 1)
    return F.transform(turns, lambda p: F.struct(
        F.url_decode(F.substring_index(F.substring(p, len(START) + 1, 2_000_000_000), "\n", 1)).alias("role"),
        unescaped(F.substring(p, F.locate("\n", p) + 1, 2_000_000_000)).alias("text")))


def format_chats(df: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``df`` with fingerprint, layout, turns, formatted and loss (spans).

    Control strings in texts are escaped reversibly; ``read_back`` gives the turns
    again.  Records of no known layout keep null in all but the fingerprint.  A record
    without turns is formatted as the empty text.  Columns of ``df`` with these names
    are replaced.
    """
    clean = df.drop("fingerprint", "layout", "turns", "formatted", "loss")
    return canonical_turns(clean, record, layouts).withColumns({
        "formatted": formatted(F.col("turns")), "loss": loss_spans(F.col("turns"))})


def loss_text(text: Column, spans: Column) -> Column:
    """What the mask covers, unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(
        F.substring(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
