"""Chat formatting: records of different layouts become canonical turns, and turns become training text.

The nested field paths of a JSON record are hashed; the hash selects a declared layout, which says where
roles and texts are.  The template marks turns with control strings; control strings inside texts get a
backslash after their first character, so that a text cannot end a turn, and reading back takes it out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """Where a record keeps its turns.

    Either ``list_field`` names an array of objects with the fields ``role`` and ``text``, with ``roles`` to
    rename, or ``parts`` gives (role, fields) in order; several fields of one part are joined by a blank
    line.  ``optional`` fields may be missing.
    """

    name: str
    list_field: str | None = None
    role: str | None = None
    text: str | None = None
    roles: dict[str, str] = field(default_factory=dict)
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()

    def paths(self, layouts: tuple[Layout, ...]) -> list[frozenset[str]]:
        """All sets of field paths that a record of this layout can have.

        A list's elements may be laid out as in any list of ``layouts``, each in its own way, and some may lack a text.
        """
        if self.list_field:
            whole = [f"{self.list_field}[].{x.element()}" for x in layouts if x.list_field]
            bare = [f"{self.list_field}[].{x.role}" for x in layouts if x.list_field]
            return [frozenset(x + y) for x in _subsets(whole) if x for y in _subsets(bare)]
        needed = [f for _, fields in self.parts for f in fields if f not in self.optional]
        return [frozenset(needed + extra) for extra in _subsets(list(self.optional))]

    def element(self) -> str:
        """The fields of an element, as they stand in a path."""
        return f"{{{self.role},{self.text}}}"


def _subsets(items: list[str]) -> list[list[str]]:
    found: list[list[str]] = [[]]
    for item in items:
        found += [[*x, item] for x in found]
    return found


LAYOUTS = (
    Layout("messages", list_field="messages", role="role", text="content"),
    Layout("from_value", list_field="conversations", role="from", text="value",
           roles={"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}),
    Layout("prompt_response", parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Layout("prompt_completion", parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system",)),
    Layout("question_answer", parts=(("user", ("context", "question")), ("assistant", ("answer",))), optional=("context",)),
    Layout("instruction", parts=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
)

START, END = "<|im_start|>", "<|im_end|>"
#: After a first character, any number of backslashes and one of these, a control string of this or
#: of another common template is complete.
_AFTER_ANGLE, _AFTER_BRACKET = r"\\*(?:\||/?s>|</?SYS>>)", r"\\*/?INST\]"


def escape(text: Column) -> Column:
    """A backslash more after the first character of every control string."""
    return F.regexp_replace(text, rf"(?<=<)(?={_AFTER_ANGLE})|(?<=\[)(?={_AFTER_BRACKET})", r"\\")


def unescape(text: Column) -> Column:
    """Takes out one backslash each; the inverse of ``escape``."""
    return F.regexp_replace(text, rf"(?<=<)\\(?={_AFTER_ANGLE})|(?<=\[)\\(?={_AFTER_BRACKET})", "")


def _fields(layouts: tuple[Layout, ...]) -> tuple[list[str], list[Layout]]:
    flat = sorted({f for x in layouts for _, fields in x.parts for f in fields})
    return flat, [x for x in layouts if x.list_field]


def element_layouts(record: Column, own: Layout, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """For every element of a record's list: the fields it was recognised by, ``?`` if by none.

    An element with a role and a text as the list's own layout has them is read so, else as another list's layout
    has them; one with a role and no known text is a turn with an empty text.
    """
    ordered = [own, *[x for x in layouts if x.list_field and x != own]]
    texts = F.array(*[F.lit(x.text) for x in ordered])

    def recognised(element):
        keys = F.json_object_keys(element)
        found = F.lit("?")
        for x in reversed(ordered):
            found = F.when(F.array_contains(keys, x.role) & ~F.arrays_overlap(keys, texts), x.role).otherwise(found)
        for x in reversed(ordered):
            found = F.when(F.array_contains(keys, x.role) & F.array_contains(keys, x.text), x.element()).otherwise(found)
        return found

    return F.transform(F.from_json(F.get_json_object(record, f"$.{own.list_field}"), "array<string>"), recognised)


def _below(name: str):
    return lambda fields: F.concat(F.lit(f"{name}[]."), fields)


def field_paths(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Sorted nested field paths of a JSON object, those of all elements of its lists included, as far as some layout knows them."""
    flat, lists = _fields(layouts)
    keys = F.coalesce(F.json_object_keys(record), F.array())
    paths = [F.array_intersect(keys, F.array(*[F.lit(f) for f in flat]))]
    for x in lists:
        inner = F.transform(F.array_distinct(element_layouts(record, x, layouts)), _below(x.list_field))
        paths.append(F.coalesce(inner, F.array()))
    return F.array_sort(F.concat(*paths))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def canonical_turns(records: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds ``layout`` and ``turns``, an array of (role, text), to JSON records.

    Known paths decide; other fields of a record are passed over.  Records that are null, no JSON object, or of no
    declared layout, or empty lists of turns, have a null layout and null turns; they stay in the result.  Elements of
    one list may be laid out in different ways, each is read in its own; with an element that no layout
    reads, the whole record has a null layout, so no turn is lost unseen.  A null or missing
    text in a list is an empty text; a null or missing field of a part gives no turn.  Columns named
    ``layout`` and ``turns`` are replaced.
    """
    flat, lists = _fields(layouts)
    inner = ",".join(f"`{f}` string" for f in sorted({f for x in lists for f in (x.role, x.text)}))
    kinds = [f"`{f}` string" for f in flat] + [f"`{x.list_field}` array<struct<{inner}>>" for x in lists]
    spark = records.sparkSession
    # the fingerprints of the declared layouts, computed by the same function
    declared = [(x.name, "\n".join(sorted(paths))) for x in layouts for paths in x.paths(layouts)]
    prints = spark.range(1).select(*[F.xxhash64(F.lit(p)) for _, p in declared]).first()
    by_name: dict[str, list[int]] = {}
    for (name, _), f in zip(declared, prints, strict=True):
        by_name.setdefault(name, []).append(f)
    rows = records.select(
        F.struct(*[F.col(f"`{c}`") for c in records.columns if c not in ("layout", "turns")]).alias("row"),
        fingerprint(field_paths(F.col(record), layouts)).alias("print"),
        F.from_json(F.col(record), ", ".join(kinds)).alias("r"),
        *[element_layouts(F.col(record), x, layouts).alias(f"of_{x.name}") for x in lists],
    )
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for x in layouts:
        mine = F.col("print").isin(by_name[x.name])
        layout = F.when(mine, x.name).otherwise(layout)
        turns = F.when(mine, _turns(x, lists)).otherwise(turns)
    return rows.select("row", layout.alias("layout"), turns.alias("turns")).select("row.*", "layout", "turns")


def _turns(x: Layout, lists: list[Layout]) -> Column:
    if x.list_field:

        def turn(m, i):
            fields = F.get(F.col(f"of_{x.name}"), i)
            role, text = F.lit(None).cast("string"), F.lit(None).cast("string")
            for y in lists:
                named = m[y.role]
                for old, new in y.roles.items():
                    named = F.when(m[y.role] == old, new).otherwise(named)
                role = F.when(fields.isin(y.role, y.element()), named).otherwise(role)
                text = F.when(fields == y.element(), m[y.text]).otherwise(text)
            return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

        return F.transform(F.col(f"r.{x.list_field}"), turn)
    parts = []
    for role, fields in x.parts:
        values = F.filter(F.array(*[F.col(f"r.{f}") for f in fields]), lambda v: v.isNotNull())
        text = F.when(F.size(values) > 0, F.array_join(values, "\n\n"))
        parts.append(F.struct(F.lit(role).alias("role"), text.alias("text")))
    return F.filter(F.array(*parts), lambda t: t["text"].isNotNull())


def format_turns(df: DataFrame, turns: str = "turns", learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Adds ``formatted`` text and ``loss_spans`` (start and length in UTF-8 bytes) to rows with turns.

    A turn is ``<|im_start|>``, the role (as in a web form, so that it holds no control string), a line end, the escaped text,
    ``<|im_end|>`` and a line end.  The spans cover the texts of the roles in ``learned``.  Null turns give nulls;
    no turns give an empty text.  Columns of the two names are replaced.
    """
    work = "_pieces"
    while work in {c.lower() for c in df.columns}:
        work += "_"
    role = lambda t: F.url_encode(F.coalesce(t["role"], F.lit("")))
    head = lambda t: F.concat(F.lit(START), role(t), F.lit("\n"))
    pieces = F.transform(
        turns,
        lambda t: F.struct(
            head(t).alias("head"),
            escape(F.coalesce(t["text"], F.lit(""))).alias("text"),
            t["role"].isin(list(learned)).alias("learned"),
        ),
    )
    tail = F.lit(END + "\n")
    df = df.withColumn(work, pieces)
    formatted = F.array_join(F.transform(work, lambda p: F.concat(p["head"], p["text"], tail)), "")
    size = lambda c: F.octet_length(c).cast("long")
    spans = F.aggregate(
        work,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,n:bigint>>").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + size(p["head"]) + size(p["text"]) + len(END) + 1).alias("at"),
            F.when(
                F.coalesce(p["learned"], F.lit(False)),
                F.array_append(a["spans"], F.struct((a["at"] + size(p["head"])).alias("start"), size(p["text"]).alias("n"))),
            ).otherwise(a["spans"]).alias("spans"),
        ),
    )["spans"]
    return df.withColumns({"formatted": formatted, "loss_spans": spans}).drop(work)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text."""
    blocks = F.split(formatted, r"<\|im_end\|>\n")
    blocks = F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0)))
    return F.transform(
        blocks,
        lambda b: F.struct(
            F.url_decode(F.substring_index(F.substr(b, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescape(F.substr(b, F.instr(b, "\n") + 1)).alias("text"),
        ),
    )


def read_learned(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss spans, in order."""
    data = F.encode(formatted, "utf-8")
    return F.transform(spans, lambda s: unescape(F.decode(F.substring(data, s["start"].cast("int") + 1, s["n"].cast("int")), "utf-8")))


def turn_rows_to_records(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One JSON record for each conversation given as one row per turn: ``conv_id``, ``record``.

    A single question and answer becomes prompt and response, with a system turn before it an
    instruction record; all others become a message list.  Turns go by number, then role, then text; a null text is
    empty, a null role an empty role.  Rows of null id form one conversation.  A conversation becomes one row, so its
    length is bounded by what a row can hold.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    one = F.struct(F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("content"))
    grouped = rows.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("m"))
    roles = F.array_join("m.role", "\n")
    text_of = lambda k: F.col("m")[k]["content"]
    pair = F.to_json(F.struct(text_of(0).alias("prompt"), text_of(1).alias("response")))
    asked = F.to_json(F.struct(text_of(0).alias("system"), text_of(1).alias("instruction"), text_of(2).alias("output")))
    listed = F.to_json(F.struct(F.transform("m", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages")))
    record = F.when(roles == "user\nassistant", pair).when(roles == "system\nuser\nassistant", asked).otherwise(listed)
    return grouped.select("conv_id", record.alias("record"))
