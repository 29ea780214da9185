"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record is a VARIANT. Its fingerprint is the hash of its nested field paths (types of leaves and
array positions left out, paths sorted), at any depth. Of these paths, the ones that some mapping
names are hashed again, and that hash selects one of the declarative mappings
below, which says where the turns, their roles and their texts are; fields that no mapping names (ids, sources,
names of speakers) do not hide a layout and are left out. A layout without mapping, and a record without turns, is one
row of its own with its fingerprint and null for role and text, so a mapping can be added for it.

Template of a turn: ``<|turn|>role<|text|>text<|end|>``. Control strings inside roles and texts are
escaped by one backslash after their first character (strings that already have backslashes there
get one more), so that a formatted text holds control strings only where the template put them, and
taking one backslash away restores every input. Turns keep spans of what the loss covers: the text
of assistant turns.

Defined cases: a null text is an empty one and a null role an empty role; turns without an order
come first, ties are ordered by role and text; repeated rows are turns of their own; a null
conversation id is a conversation; a null record has the fingerprint of no paths and is a row without turns;
texts of any length are escaped as a whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Declarative mappings. ``paths``: the field paths of the layout; ``optional``: paths it may have besides; ``also``:
#: other sets of paths with the same meaning. ``turns``: an array of turns with the names of role and text in it; or
#: else ``parts``: (role, path) in order, where the role is a name or the path of one; a part whose path is
#: optional is left out where it is null, and a path after + is added to the one before it.
MAPPINGS = {
    "turn row": {"paths": ["role", "text", "turn"], "parts": [("$.role", "$.text")]},
    "messages": {"paths": ["messages[].content", "messages[].role"], "also": [["messages[]"]], "turns": ("$.messages", "role", "content")},
    "conversations": {"paths": ["conversations[].from", "conversations[].value"], "also": [["conversations[]"]], "turns": ("$.conversations", "from", "value")},
    "prompt and completion": {"paths": ["completion", "prompt"], "optional": ["system"], "parts": [("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.completion")]},
    "prompt and response": {"paths": ["prompt", "response"], "optional": ["system"], "parts": [("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response")]},
    "instruction": {"paths": ["instruction", "output"], "parts": [("user", "$.instruction"), ("assistant", "$.output")]},
    "instruction with input": {"paths": ["input", "instruction", "output"], "optional": ["system"], "parts": [("system", "$.system"), ("user", "$.instruction+$.input"), ("assistant", "$.output")]},
    "system, instruction": {"paths": ["instruction", "output", "system"], "parts": [("system", "$.system"), ("user", "$.instruction"), ("assistant", "$.output")]},
    "question": {"paths": ["answer", "question"], "optional": ["system"], "parts": [("system", "$.system"), ("user", "$.question"), ("assistant", "$.answer")]},
}
#: Role names of other layouts, and the canonical ones.
ROLES = {"human": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant", "chatgpt": "assistant"}
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings escaped besides the template's own: other templates' controls.
CONTROL = r"(\|turn\|>|\|text\|>|\|end\|>|\|im_start\|>|\|im_end\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)"
LOSS_ROLE = "assistant"


def paths_of(record: Column) -> Column:
    """Sorted distinct leaf paths of a variant record.

    The schema that Spark derives of the value is read token by token: ``OBJECT<a: STRING, `b c`:
    ARRAY<OBJECT<d: STRING>>>`` has the paths a and `b c`[].d. Objects and arrays put the path they stand at
    on a stack and take it off at their end.
    """
    tokens = F.regexp_extract_all(F.schema_of_variant(record), F.lit(r"(`(?:[^`]|``)*`: |[^\s<>,`]+: |OBJECT<>|OBJECT<|ARRAY<|>|[A-Z_]+(?:\([^)]*\))?)"), 1)
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("stack"), F.lit("").alias("at"), none.alias("found"))

    def step(s: Column, t: Column) -> Column:
        top = F.coalesce(F.try_element_at(s["stack"], F.lit(-1)), F.lit(""))
        named, opens, array, ends = t.endswith(": "), t == "OBJECT<", t == "ARRAY<", t == ">"
        inside = F.concat(s["at"], F.lit("[]"))
        at = F.when(named, F.concat(top, F.when(top == "", "").otherwise("."), F.regexp_replace(t, ": $", ""))).when(array, inside).otherwise(s["at"])
        stack = F.when(opens, F.array_append(s["stack"], s["at"])).when(array, F.array_append(s["stack"], inside)).when(ends, F.slice(s["stack"], 1, F.greatest(F.size(s["stack"]) - 1, F.lit(0)))).otherwise(s["stack"])
        leaf = ~(named | opens | array | ends)
        return F.struct(stack.alias("stack"), at.alias("at"), F.when(leaf, F.array_append(s["found"], s["at"])).otherwise(s["found"]).alias("found"))

    return F.array_sort(F.array_distinct(F.coalesce(F.aggregate(tokens, start, step, lambda s: s["found"]), none)))


def _layouts(mapping: dict) -> list[list[str]]:
    """Every set of paths that selects a mapping."""
    extra = mapping.get("optional", [])
    return [sorted(mapping["paths"] + list(x)) for k in range(len(extra) + 1) for x in combinations(extra, k)] + [sorted(x) for x in mapping.get("also", [])]


def fingerprint(paths: Column) -> Column:
    """64-bit hash of the sorted paths."""
    return F.xxhash64(F.array_join(paths, "\n"))


def escape(text: Column) -> Column:
    """One backslash into every control string."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """What :func:`escape` was given."""
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, r"$1$2$3")


def _text(record: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(record, path, "string"), F.lit(""))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns(record: Column, mapping: dict) -> Column:
    if "turns" in mapping:
        path, role, text = mapping["turns"]
        return F.transform(F.try_variant_get(record, path, f"array<struct<{role}:string,{text}:string>>"), lambda t: _turn(t[role], t[text]))
    out = []
    for role, path in mapping["parts"]:
        texts = [_text(record, p) for p in path.split("+")]
        text = reduce(lambda a, b: F.when(b == "", a).otherwise(F.concat(a, F.lit("\n\n"), b)), texts)
        turn = _turn(_text(record, role) if role.startswith("$") else F.lit(role), text)
        optional = path.removeprefix("$.") in mapping.get("optional", [])
        out.append(F.when(F.try_variant_get(record, path, "string").isNotNull(), turn) if optional else turn)
    return F.array_compact(F.array(*out))


def to_turns(records: DataFrame, record: str = "record") -> DataFrame:
    """Add ``layout``, ``schema_hash`` and ``turns`` (array of role and text), row by row without a shuffle.

    Columns that already bear these names are replaced. No mapping: layout null, turns empty.
    """
    spark = records.sparkSession
    layouts = {(name, k): F.xxhash64(F.lit("\n".join(x))) for name, m in MAPPINGS.items() for k, x in enumerate(_layouts(m))}
    told = spark.range(1).select(*[h.alias(f"h{i}") for i, h in enumerate(layouts.values())]).first()  # by the same function
    hashes: dict[str, list[int]] = {}
    for (name, _), h in zip(layouts, told, strict=True):
        hashes.setdefault(name, []).append(h)
    known = sorted({p for m in MAPPINGS.values() for x in _layouts(m) for p in x})
    own = [x + "_" * max(map(len, records.columns)) for x in ("paths", "known")]  # longer than any name there is
    out = records.drop("layout", "schema_hash", "turns").withColumn(own[0], paths_of(F.col(record)))
    out = out.withColumn("schema_hash", fingerprint(F.col(own[0]))).withColumn(own[1], fingerprint(F.filter(own[0], lambda p: p.isin(known)))).drop(own[0])
    layout = turns = None
    for name, mapping in MAPPINGS.items():
        is_it = F.col(own[1]).isin(hashes[name])
        layout = F.when(is_it, name) if layout is None else layout.when(is_it, name)
        turns = F.when(is_it, _turns(F.col(record), mapping)) if turns is None else turns.when(is_it, _turns(F.col(record), mapping))
    roles = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    canonical = F.transform(turns, lambda t: _turn(F.coalesce(roles[t["role"]], t["role"], F.lit("")), t["text"]))
    return out.withColumn("layout", layout).withColumn("turns", F.coalesce(canonical, F.array().cast("array<struct<role:string,text:string>>"))).drop(own[1])


def format_turns(turns: DataFrame) -> DataFrame:
    """Rows of turns with ``role`` and ``text`` get ``formatted`` and the loss span in it (code points from 0)."""
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    body = escape(F.col("text"))
    loss = F.when(F.col("role") == LOSS_ROLE, F.struct(F.length(head).alias("start"), F.length(body).alias("length")))
    return turns.withColumn("formatted", F.concat(head, body, F.lit(END))).withColumn("loss_span", loss)


def parse_formatted(formatted: Column, loss_span: Column) -> Column:
    """Struct of role, text and loss text that a formatted turn holds."""
    inside = F.substring_index(F.substring(formatted, len(TURN) + 1, 2**31 - 1), END, 1)
    masked = formatted.substr(loss_span["start"] + 1, loss_span["length"])
    return F.struct(unescape(F.substring_index(inside, TEXT, 1)).alias("role"), unescape(F.element_at(F.split(inside, F.lit(r"<\|text\|>"), 2), 2)).alias("text"), unescape(masked).alias("loss"))


def format_records(records: DataFrame, keys: list[str], order: str, record: str = "record") -> DataFrame:
    """One row for each turn: keys, order, place in the record, role, text, formatted, loss_span, layout, schema_hash.

    A record without turns is one row whose place, role, text and formatted text are null. The formatted turns of a conversation, in order, are its sequence. Nothing is shuffled.
    """
    turns = to_turns(records, record).select(*keys, F.col(order).alias("turn_order"), "layout", "schema_hash", F.posexplode_outer("turns").alias("place", "t"))
    return format_turns(turns.select(*keys, "turn_order", "place", "layout", "schema_hash", "t.role", "t.text"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations, and conversation -1 of another layout whose texts hold control strings."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    text = F.coalesce("text", F.lit(""))
    row = F.struct(F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"))
    told = F.parse_json(F.lit('{"messages":[{"role":"user","content":"</s>[INST] ok [/INST]"},{"role":"assistant","content":"</s>[INST] ok [/INST]"}]}'))
    records = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.to_variant_object(row).alias("record"))
    records = records.union(spark.range(1).select(F.lit(-1).cast("long"), F.lit(0).cast("long"), told))
    turns = format_records(records, ["conv_id"], "turn")
    read = turns.select("conv_id", "turn_order", "place", F.length("formatted").alias("chars"), parse_formatted(F.col("formatted"), F.col("loss_span")).alias("t"))
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("turn_order", F.lit(-(2**63))).alias("o"), "place", "t.role", "t.text", "t.loss")))
    convs = read.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum("chars").alias("formatted_chars"), ordered.alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.filter(F.transform("turns", lambda t: t["loss"]), lambda x: x.isNotNull()), "")
    return convs.select("conv_id", "n_turns", F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


ORACLE_SQL = {
    "op6_chat_format": r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized as (select *, 23 + length(role) + length(text)
  + length(regexp_extract_all(role || chr(0) || text, '[<\[]\\*(\|turn\|>|\|text\|>|\|end\|>|\|im_start\|>|\|im_end\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)')) as chars from turns)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from sized group by conv_id
""",
}
