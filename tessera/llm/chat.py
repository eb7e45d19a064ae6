"""Chat formatting: schema fingerprints select declarative mappings to canonical turns; a reversible template.

A record is a variant. Its nested field paths, without types, are hashed; the hash selects a mapping that says
where messages, prompts or answers stand and what roles are called. Where the record has further fields, the hashes of
its single paths select the first mapping whose paths it all has. Records of unknown layout get a null layout and
no turns; ``render`` returns them with ``quarantined`` true and no text. Empty lists of messages give empty text. Canonical turns are written as ``<|turn|>role`` newline ``text<|end|>`` newline. A backslash escapes every
backslash and bar and breaks foreign control strings (``</s>``, ``[INST]``, ``<<SYS>>``), so no marker and no such string
survives inside a text and removing the backslashes restores it exactly. The loss mask lists the spans of assistant
texts in code points.

Null roles and texts count as empty; turns with equal numbers are ordered by role and text; repeated rows are turns of their
own. Extra columns are ignored. An empty table gives an empty result. A conversation is one row however long; records of one id stay apart.
DataFrame functions only.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mapping:
    """Either a list of messages (``items`` with ``role`` and ``text`` fields), or single fields by role in order."""

    name: str
    shape: str
    items: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()


#: Layouts by the shape of their field paths (names in order, nested).
MAPPINGS = (
    Mapping("messages", "OBJECT<messages: ARRAY<OBJECT<content, role>>>", "$.messages", "role", "content"),
    Mapping("share", "OBJECT<conversations: ARRAY<OBJECT<from, value>>>", "$.conversations", "from", "value"),
    Mapping("dialogue", "OBJECT<dialogue: ARRAY<OBJECT<speaker, text>>>", "$.dialogue", "speaker", "text"),
    Mapping("prompt", "OBJECT<completion, prompt>", fields=(("$.prompt", "user"), ("$.completion", "assistant"))),
    Mapping("prompt_response", "OBJECT<prompt, response>", fields=(("$.prompt", "user"), ("$.response", "assistant"))),
    Mapping("system_prompt", "OBJECT<prompt, response, system>", fields=(("$.system", "system"), ("$.prompt", "user"), ("$.response", "assistant"))),
    Mapping("instruction", "OBJECT<instruction, output>", fields=(("$.instruction", "user"), ("$.output", "assistant"))),
    Mapping("instruction_input", "OBJECT<input, instruction, output>", fields=(("$.instruction+$.input", "user"), ("$.output", "assistant"))),
    Mapping("question", "OBJECT<answer, question>", fields=(("$.question", "user"), ("$.answer", "assistant"))),
)
#: The same from the most paths to the fewest, for records with further fields.
BY_PATHS = tuple(sorted(MAPPINGS, key=lambda m: -(len(m.fields) + sum(p.count("+") for p, _ in m.fields))))
#: Other names of the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
TURN, END = "<|turn|>", "<|end|>\n"
_TURNS = "array<struct<role:string,text:string>>"


def shape_key(shape: str) -> str:
    return hashlib.sha256(shape.encode()).hexdigest()[:16]


def required_paths(m: Mapping) -> list[str]:
    """The paths that a record must have for the mapping; ``[]`` marks the elements of a list."""
    if m.items:
        return [f"{m.items[2:]}[].{m.role}", f"{m.items[2:]}[].{m.text}"]
    return [p[2:] for paths, _ in m.fields for p in paths.split("+")]


def fingerprint(record: str) -> Column:
    """16 hex digits of the hash of a variant's nested field paths."""
    shape = F.regexp_replace(F.schema_of_variant(record), ": (?!OBJECT<|ARRAY<)[A-Z]+(\\([0-9,]+\\))?(?=[,>])", "")
    return F.substring(F.sha2(shape, 256), 1, 16)


def path_keys(record: str) -> Column:
    """Hashes of a variant's field names, and of those of the elements of its lists."""
    top = f"map_entries(try_variant_get({record}, '$', 'map<string,variant>'))"
    inner = "flatten(transform(coalesce(try_variant_get(e.value, '$', 'array<map<string,variant>>'), array()), x -> coalesce(map_keys(x), array())))"
    paths = f"flatten(transform({top}, e -> concat(array(e.key), transform(array_distinct({inner}), k -> concat(e.key, '[].', k)))))"
    return F.transform(F.expr(f"coalesce({paths}, array())"), lambda p: F.substring(F.sha2(p, 256), 1, 16))


def _mapped(m: Mapping, record: str) -> Column:
    if m.items:
        items = f"variant_get({record}, '{m.items}', 'array<struct<`{m.role}`:string,`{m.text}`:string>>')"
        return F.expr(f"transform({items}, x -> named_struct('role', coalesce(x.`{m.role}`, ''), 'text', coalesce(x.`{m.text}`, '')))")
    turns = []
    for path, role in m.fields:
        parts = ", ".join(f"nullif(variant_get({record}, '{p}', 'string'), '')" for p in path.split("+"))
        turns.append(f"named_struct('role', '{role}', 'text', concat_ws('\\n\\n', {parts}))")
    return F.expr(f"array({', '.join(turns)})")


def canonical(records: DataFrame, id_col: str, record: str = "record", rename_roles: bool = True) -> DataFrame:
    """(id, layout, turns) of records in any known layout."""
    exact = F.element_at(F.create_map(*[F.lit(x) for m in MAPPINGS for x in (shape_key(m.shape), m.name)]), F.col("f"))
    has = [F.when(F.size(F.array_except(F.array(*[F.lit(shape_key(p)) for p in required_paths(m)]), "keys")) == 0, m.name) for m in BY_PATHS]
    # the paths are taken apart only where the whole shape is unknown
    known = records.select(F.col(id_col).alias("id"), F.col(record).alias("record"), fingerprint(record).alias("f"))
    known = known.withColumn("layout", exact).withColumn("keys", F.when(F.col("layout").isNull(), path_keys("record")))
    known = known.withColumn("layout", F.coalesce("layout", *has))
    turns = F.lit(None).cast(_TURNS)
    for m in MAPPINGS:
        turns = F.when(F.col("layout") == m.name, _mapped(m, "record")).otherwise(turns)
    out = known.select(F.col("id").alias(id_col), "layout", turns.alias("turns"))
    if rename_roles:
        names = ", ".join(f"'{k}', '{v}'" for k, v in ROLES.items())
        out = out.withColumn("turns", F.expr(f"transform(turns, t -> named_struct('role', coalesce(map({names})[t.role], t.role), 'text', t.text))"))
    return out


#: Layouts that a list of turns can be stored in.
LISTS = tuple(m for m in MAPPINGS if m.items)


def rows_to_records(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", layouts: tuple[Mapping, ...] = LISTS) -> DataFrame:
    """(id, record): the rows of a conversation as one record, in one of the layouts by a hash of the id."""
    turn = F.struct(F.col(turn_col).alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    got = rows.groupBy(F.col(id_col).alias("id")).agg(F.sort_array(F.collect_list(turn)).alias("m"))
    which, record = F.pmod(F.xxhash64("id"), F.lit(len(layouts))), None
    for k, m in enumerate(layouts):
        one = F.to_variant_object(F.expr(f"named_struct('{m.items[2:]}', transform(m, x -> named_struct('{m.role}', x.role, '{m.text}', x.text)))"))
        record = F.when(which == k, one) if record is None else record.when(which == k, one)
    return got.select(F.col("id").alias(id_col), record.alias("record"))


def escape(text: Column, header: bool = False) -> Column:
    """Backslashes before backslashes and bars, inside foreign control strings, and before line ends of a header."""
    marks = "(?=[\\\\|" + ("\n" if header else "") + "])|(?<=\\[)(?=/?INST\\])|(?<=<)(?=/?s>)|(?<=<)(?=</?SYS>>)"
    return F.regexp_replace(text, marks, "\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def render(turns: DataFrame, id_col: str, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(id, formatted, loss_mask, quarantined): the template's text and the spans (start, length) that are trained on.

    One row a record, made where the record is. Those without turns, of unknown layout, are quarantined: null text and mask.
    """
    piece = F.transform("turns", lambda t: F.struct(F.concat(F.lit(TURN), escape(t["role"], True), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), t["role"].isin(*loss_roles).alias("loss")))
    rows = turns.select(F.col(id_col).alias("id"), piece.alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast("array<struct<start:long,length:long>>").alias("spans"))

    def add(done: Column, x: Column) -> Column:
        begin, size = done["at"] + F.length(x["head"]), F.length(x["body"]).cast("long")
        span = F.array(F.struct(begin.alias("start"), size.alias("length")))
        spans = F.when(x["loss"], F.concat(F.coalesce(done["spans"], F.array().cast("array<struct<start:long,length:long>>")), span)).otherwise(done["spans"])
        return F.struct((begin + size + len(END)).alias("at"), spans.alias("spans"))

    mask = F.when(F.col("p").isNotNull(), F.coalesce(F.aggregate("p", start, add)["spans"], F.array().cast("array<struct<start:long,length:long>>")))
    return rows.select(F.col("id").alias(id_col), text.alias("formatted"), mask.alias("loss_mask"), F.col("p").isNull().alias("quarantined"))


def parse(formatted: DataFrame, id_col: str) -> DataFrame:
    """(id, turns, loss_text) read back from formatted text and loss mask."""
    pieces = F.filter(F.split("formatted", "<\\|turn\\|>"), lambda p, i: i > 0)
    split = "transform(pieces, p -> named_struct('h', regexp_extract(p, '(?s)^((?:[^\\\\\\\\\\n]++|\\\\\\\\.)*+)\\n', 1), 'p', p))"
    cut = f"transform({split}, s -> named_struct('h', s.h, 'b', substring(s.p, length(s.h) + 2, length(s.p) - length(s.h) - 1 - {len(END)})))"
    turns = F.transform(F.expr(cut), lambda s: F.struct(unescape(s["h"]).alias("role"), unescape(s["b"]).alias("text")))
    loss = F.array_join(F.transform("loss_mask", lambda m: unescape(F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")
    return formatted.withColumn("pieces", pieces).select(id_col, "formatted", turns.alias("turns"), loss.alias("loss_text"))


def digest(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Counts and hashes of what is read back."""
    back = parse(formatted, id_col)
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        id_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
