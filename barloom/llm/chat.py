"""Chat records of any known layout as one canonical, loss-masked template.

Only built-in functions; the project itself keeps no chat records, so the
interface is general: ``record_id`` and a JSON ``payload``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SHUT, CLOSE = "<turn ", ">", "</turn>"


#: Bytes up to which a variant takes any payload; it ends at 20,000,000 characters of a string and 128 MiB.
PLAIN = OUTLINE = 1 << 24


@dataclass(frozen=True)
class Layout:
    """A known layout: its nested field paths and the SQL that reads its turns.

    ``turns`` reads them from the variant ``v``, ``long_turns`` from the typed
    fields ``long`` beside those of the outline, ``bare``.
    """

    name: str
    paths: str
    turns: str
    long_turns: str


def _message(role: str, text: str) -> str:
    return f"transform({{array}}, m -> named_struct('role', m.{role}, 'text', m.{text}))"


def _long_text(path: str, bare: str) -> str:
    """A string as it is (the outline has emptied it), anything else as a variant prints it."""
    scalar = f"CAST({bare} AS STRING)"
    nested = f"coalesce(CAST(try_parse_json({path}) AS STRING), {path})"
    return f"CASE WHEN {scalar} = '' THEN {path} WHEN left({scalar}, 1) IN ('{{', '[') THEN {nested} ELSE {scalar} END"


def _messages(path: str, role: str, text: str) -> tuple[str, str]:
    kind = f"array<struct<{role}:string,{text}:string>>"
    r, t = (_long_text(f"m.`{x}`", f"bare.`{path}`[i].`{x}`") for x in (role, text))
    return (
        _message(f"`{role}`", f"`{text}`").format(array=f"variant_get(v, '$.{path}', '{kind}')"),
        f"transform(long.`{path}`, (m, i) -> named_struct('role', {r}, 'text', {t}))",
    )


def _fields(*pairs: tuple[str, str]) -> tuple[str, str]:
    def turns(text: Callable[[str], str]) -> str:
        return "array(" + ", ".join(f"named_struct('role', '{role}', 'text', {text(path)})" for role, path in pairs) + ")"

    return (
        turns(lambda path: f"variant_get(v, '$.{path}', 'string')"),
        turns(lambda path: _long_text(f"long.`{path}`", f"bare.`{path}`")),
    )


#: Known layouts. The paths are written as ``field_paths`` prints them.
LAYOUTS = (
    Layout("messages", "OBJECT<messages: ARRAY<OBJECT<content, role>>>", *_messages("messages", "role", "content")),
    Layout("conversations", "OBJECT<conversations: ARRAY<OBJECT<from, value>>>", *_messages("conversations", "from", "value")),
    Layout("prompt", "OBJECT<completion, prompt>", *_fields(("user", "prompt"), ("assistant", "completion"))),
    Layout("response", "OBJECT<prompt, response>", *_fields(("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", "OBJECT<instruction, output>", *_fields(("user", "instruction"), ("assistant", "output"))),
    Layout("system_instruction", "OBJECT<input, output, system>", *_fields(("system", "system"), ("user", "input"), ("assistant", "output"))),
)


#: The fields of all layouts, and what keeps Spark's typed JSON reader as strict as a variant, without a bound on strings.
SINGLE = ("prompt", "completion", "response", "instruction", "system", "input", "output")
FIELDS = (
    "messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>, "
    + ", ".join(f"{x} string" for x in SINGLE)
)
READER = {"maxStringLen": str((1 << 31) - 1), "allowSingleQuotes": "false", "columnNameOfCorruptRecord": "__bad"}

#: The inside of a JSON string; possessive, so that its length costs no stack.
_INSIDE = r'(?:[^"\\]++|\\.)*+'


def outline(payload: Column) -> Column:
    """JSON with its string values emptied: names, nesting and other scalars stay."""
    return F.regexp_replace(payload, rf'(?s)("{_INSIDE}"\s*+:)|("){_INSIDE}(")', "$1$2$3")


def _collapsed(bare: Column) -> Column:
    """An outline in which a run of equal objects is one; it has the same field paths."""
    return F.regexp_replace(bare, r"(\{[^{}\[\]]*+\})(?:\s*+,\s*+\1)++", "$1")


def field_paths(v: Column) -> Column:
    """The nested field names of a variant, sorted, without the scalar types."""
    return F.regexp_replace(F.schema_of_variant(v), r": [A-Z_]+(\([0-9, ]+\))?(?=[,>])", "")


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(paths)


def escape(text: Column) -> Column:
    r"""``\`` becomes ``\\``, ``<`` becomes ``\l``, ``>`` becomes ``\g``.

    A control string needs ``<``, which no escaped text contains.
    """
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    """The inverse: undo ``<`` and ``>`` between double backslashes, then those."""
    parts = F.transform(
        F.split(text, r"\\\\"),
        lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")),
    )
    return F.array_join(parts, "\\")


def canonical_turns(records: DataFrame) -> DataFrame:
    """``record_id, fingerprint, layout, turns`` of JSON records ``(record_id, payload)``.

    The fingerprint hashes the nested field paths of the record and selects the
    declarative mapping that reads its turns.  A payload that is null, not JSON
    or of an unknown layout keeps its row, with a null layout and no turns; a
    null text is empty, a null role ``user``.

    Of payloads over ``PLAIN`` bytes only the outline becomes a variant; their
    texts are read as typed fields, as long as a string of Spark can be.  Where
    even the outline is too large for a variant the query fails instead of
    losing turns.
    """
    large = F.octet_length("payload") > PLAIN
    kept = records.select(
        "record_id",
        F.when(~large, F.col("payload")).alias("plain"),
        F.from_json(F.when(large, F.col("payload")), FIELDS + ", __bad string", READER).alias("long"),
        outline(F.when(large, F.col("payload"))).alias("outline"),
    ).select(
        "record_id", "plain", "long", F.from_json("outline", FIELDS.replace("string", "variant"), READER).alias("bare"),
        _collapsed(F.col("outline")).alias("short"),
    )
    parsed = kept.withColumn("v", F.try_parse_json(F.coalesce("plain", "short"))).withColumn(
        "paths", field_paths(F.col("v"))
    )
    texts = [F.col(f"long.{x}").isNotNull() for x in ("messages", "conversations", *SINGLE)]
    lost = F.col("v").isNull() & reduce(Column.__or__, texts) & (F.octet_length("short") > OUTLINE)
    # the outline does not show what is wrong inside a string
    broken = F.col("long.__bad").isNotNull() & F.col("paths").isin([x.paths for x in LAYOUTS])
    known = parsed.withColumn(
        "fingerprint",
        F.when(lost, F.raise_error(F.lit("a chat record's outline is too large to read")).cast("bigint")).otherwise(
            fingerprint(F.when(broken, None).otherwise(F.col("paths")))
        ),
    )
    layout, turns = F.lit(None).cast("string"), F.expr("CAST(NULL AS array<struct<role:string,text:string>>)")
    for known_layout in reversed(LAYOUTS):
        hit = F.col("fingerprint") == fingerprint(F.lit(known_layout.paths))
        layout = F.when(hit, F.lit(known_layout.name)).otherwise(layout)
        turns = (
            F.when(hit & F.col("plain").isNotNull(), F.expr(known_layout.turns))
            .when(hit, F.expr(known_layout.long_turns))
            .otherwise(turns)
        )
    clean = F.transform(
        F.coalesce(turns, F.expr("CAST(array() AS array<struct<role:string,text:string>>)")),
        lambda t: F.struct(
            F.coalesce(t["role"], F.lit("user")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")
        ),
    )
    return known.select("record_id", "fingerprint", layout.alias("layout"), clean.alias("turns"))


def render(turns: Column) -> Column:
    return F.array_join(
        F.transform(
            turns, lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(SHUT), escape(t["text"]), F.lit(CLOSE))
        ),
        "",
    )


def read_turns(formatted: Column) -> Column:
    """Turns read back from the formatted string."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), SHUT, 1)).alias("role"),
            unescape(F.substr(p, F.locate(SHUT, p) + 1)).alias("text"),
        ),
    )


def loss_spans(formatted: Column) -> Column:
    """``(start, length)`` of each assistant text in the formatted string, in code points."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    walked = F.aggregate(
        pieces,
        F.struct(
            F.lit(0).cast("bigint").alias("at"),
            F.expr("CAST(array() AS array<struct<start:bigint,length:bigint>>)").alias("spans"),
        ),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p) + len(CLOSE)).cast("bigint").alias("at"),
            F.when(
                F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), SHUT, 1) == "assistant",
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.locate(SHUT, p)).cast("bigint").alias("start"),
                            (F.length(p) - F.locate(SHUT, p)).cast("bigint").alias("length"),
                        )
                    ),
                ),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return walked["spans"]


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    cut = F.transform(
        spans,
        lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))),
    )
    return F.array_join(cut, "")


def format_chats(records: DataFrame) -> DataFrame:
    """JSON chat records ``(record_id, payload)`` as formatted strings with a loss mask.

    Returns ``record_id, fingerprint, layout, formatted, loss_spans``.  Each
    turn is ``<turn ROLE>TEXT</turn>`` with role and text escaped; the spans
    cover the assistant texts.  Records without turns give an empty string and
    no span.  Repeated records are each formatted; other columns are ignored.
    """
    shaped = canonical_turns(records).withColumn("formatted", render(F.col("turns")))
    return shaped.withColumn("loss_spans", loss_spans(F.col("formatted"))).drop("turns")
