"""Shredding tagged prompts into instructions, narratives and dialog turns, and reference blocks into entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as T

#: Tags and what they hold: (tag, kind, instruction type or block type, priority). Fixed values.
TAGS = (
    ("核心指导", "instruction", "core_instruction", 0),
    ("基础风格", "instruction", "style_instruction", 1),
    ("相关资料", "narrative", "world_info", None),
    ("互动历史", "dialog", "dialog", None),
    ("补充资料", "narrative", "supplementary", None),
)
#: A tagged section, and the blank lines between blocks. Fixed values.
SECTION = r"<([^>/]+)>([\s\S]*?)</\1>"
BLOCK_GAP = r"(?U)\n(?:[\s\x1c-\x1f&&[^\n]]*\n)+"
#: What stands in brackets behind a word, and a quoted value in brackets. Fixed values.
NAMED, QUOTED = r"\s*\(\s*([^)]+)\s*\)", r'\["([^"]+)"\]'
#: Signs of a dialog. Fixed value.
DIALOG = "User:|Assistant:"


def sections(prompt: Column) -> Column:
    """array<struct(tag, body)> in text order; nested tags stay inside the outer body."""
    tags = F.regexp_extract_all(prompt, F.lit(SECTION), 1)
    bodies = F.regexp_extract_all(prompt, F.lit(SECTION), 2)
    return F.zip_with(tags, bodies, lambda t, b: F.struct(t.alias("tag"), b.alias("body")))


def remainder(prompt: Column) -> Column:
    return T.strip(F.regexp_replace(prompt, SECTION, ""))


def blocks(text: Column) -> Column:
    """Groups of lines between blank lines, each stripped, none empty."""
    whole = T.strip(text)
    parts = F.when(whole.contains("\n"), F.split(whole, BLOCK_GAP)).otherwise(F.array(whole))
    return F.filter(F.transform(parts, T.strip), lambda b: b != "")


def metadata(block: Column) -> Column:
    """Map of location and character, as far as the block names them."""
    place, who = (T.strip(F.regexp_extract(block, word + NAMED, 1)) for word in ("地点", "角色"))
    return F.map_filter(F.create_map(F.lit("location"), place, F.lit("character"), who), lambda _, v: v != "")


def turns(text: Column) -> Column:
    """array<struct(role, content)> of the lines that begin with User: or Assistant:."""
    lines = F.filter(F.transform(F.split(text, "\n"), T.strip), lambda x: x.startswith("User:") | x.startswith("Assistant:"))
    return F.transform(lines, lambda x: F.struct(F.substring_index(x, ":", 1).alias("role"), T.strip(F.regexp_replace(x, "^(User|Assistant):", "")).alias("content")))


def is_dialog(text: Column) -> Column:
    return text.rlike(DIALOG)


def _mapped(column: str, index: int) -> Column:
    out = None
    for row in TAGS:
        value = F.lit(row[index])
        out = F.when(F.col(column) == row[0], value) if out is None else out.when(F.col(column) == row[0], value)
    return out


def tagged(prompts: DataFrame, key: str = "session_id", prompt: str = "prompt") -> DataFrame:
    """One row a known section: key, section (position), tag, kind, type, priority, body. Unknown tags are dropped."""
    rows = prompts.select(key, F.posexplode(sections(F.col(prompt))).alias("section", "s")).select(key, "section", "s.tag", "s.body")
    rows = rows.withColumns({"kind": _mapped("tag", 1), "type": _mapped("tag", 2), "priority": _mapped("tag", 3).cast("int")})
    return rows.where("kind is not null")


def instructions(prompts: DataFrame, key: str = "session_id", prompt: str = "prompt") -> DataFrame:
    rows = tagged(prompts, key, prompt).where("kind = 'instruction'")
    return rows.select(key, F.col("section").alias("pos"), T.strip(F.col("body")).alias("content"), F.col("type").alias("instruction_type"), F.coalesce("priority", F.lit(99)).alias("priority"))


def narratives(prompts: DataFrame, key: str = "session_id", prompt: str = "prompt") -> DataFrame:
    """Tagged blocks (confidence 1.0) and the untagged remainder that is no dialog (general, 0.8)."""
    rows = tagged(prompts, key, prompt).where("kind = 'narrative'")
    parts = F.when(F.col("type") == "world_info", blocks(F.col("body"))).otherwise(F.array(T.strip(F.col("body"))))
    own = rows.select(key, "section", "type", F.posexplode(parts).alias("block", "content")).select(
        key, "section", "block", "content", F.col("type").alias("block_type"),
        F.when(F.col("type") == "world_info", metadata(F.col("content"))).otherwise(F.create_map().cast("map<string,string>")).alias("metadata"), F.lit(1.0).alias("confidence"),
    )
    rest = prompts.select(key, remainder(F.col(prompt)).alias("content")).where((F.col("content") != "") & ~is_dialog(F.col("content")))
    rest = rest.select(key, F.lit(-1).alias("section"), F.lit(0).alias("block"), "content", F.lit("general").alias("block_type"), F.create_map(F.lit("source"), F.lit("untagged")).alias("metadata"), F.lit(0.8).alias("confidence"))
    return own.unionByName(rest)


def dialog_turns(prompts: DataFrame, key: str = "session_id", prompt: str = "prompt") -> DataFrame:
    """Turns of all dialog sections, then those of a remainder that holds dialog; pos counts per source."""
    own = tagged(prompts, key, prompt).where("kind = 'dialog'").select(key, "section", "body")
    rest = prompts.select(key, F.lit(10**6).alias("section"), remainder(F.col(prompt)).alias("body")).where(is_dialog(F.col("body")))
    both = own.unionByName(rest)
    return both.select(key, "section", F.posexplode(turns(F.col("body"))).alias("pos", "t")).select(key, "section", "pos", "t.role", "t.content")


def _of(s: Column, *kinds: str) -> Column:
    """The sections of some kinds or types."""
    return F.filter(s, lambda x: x["tag"].isin([t[0] for t in TAGS if t[1] in kinds or t[2] in kinds]))


def _total(items: Column, size: Callable[[Column], Column]) -> Column:
    return F.aggregate(items, F.lit(0), lambda n, x: n + size(x))


def _narratives(s: Column, rest: Column) -> Column:
    """How many narratives there are."""
    (world,) = [t[0] for t in TAGS if t[2] == "world_info"]
    own = _total(_of(s, "narrative"), lambda x: F.when(x["tag"] == world, F.size(blocks(x["body"]))).otherwise(1))
    return own + F.when((rest != "") & ~is_dialog(rest), 1).otherwise(0)


def _once(prompt: Column, use: Callable[[Column, Column], Column]) -> Column:
    """use(sections, remainder), both taken once."""
    return T.bound(sections(prompt), lambda s: T.bound(remainder(prompt), lambda rest: use(s, rest)))


def shredded(prompts: DataFrame, key: str = "session_id", prompt: str = "prompt") -> DataFrame:
    """Per prompt the counts of what the three tables hold, and its length: one projection, no shuffle."""
    counts = _once(F.col(prompt), lambda s, rest: F.struct(
        F.size(_of(s, "instruction")).alias("n_instructions"), _narratives(s, rest).alias("n_narratives"),
        (_total(_of(s, "dialog"), lambda x: F.size(turns(x["body"]))) + F.when(is_dialog(rest), F.size(turns(rest))).otherwise(0)).alias("n_turns"),
    ))
    rows = prompts.select(key, F.length(prompt).cast("long").alias("original_length"), counts.alias("_n"))
    return rows.select(key, "original_length", *[F.coalesce(F.col(f"_n.{c}").cast("long"), F.lit(0)).alias(c) for c in ("n_instructions", "n_narratives", "n_turns")])


def request_parts(prompts: DataFrame, key: str = "session_id", prompt: str = "prompt") -> DataFrame:
    """What a request is made of, one row a prompt: instruction (the first one), reference (texts of its reference sections),
    turns (of all dialog sections, then of a remainder that holds dialog), n_narratives. One projection, no shuffle;
    a null prompt has empty parts."""
    parts = _once(F.coalesce(F.col(prompt), F.lit("")), lambda s, rest: F.struct(
        T.strip(F.get(_of(s, "instruction"), F.lit(0))["body"]).alias("instruction"), F.transform(_of(s, "world_info"), lambda x: x["body"]).alias("reference"),
        F.concat(F.flatten(F.transform(_of(s, "dialog"), lambda x: turns(x["body"]))), F.filter(turns(rest), lambda _: is_dialog(rest))).alias("turns"), _narratives(s, rest).cast("long").alias("n_narratives"),
    ))
    return prompts.select(key, parts.alias("_p")).select(key, "_p.*")


#: How entries of each kind begin. Fixed values.
_ENTRY = (("地点", "location"), ("角色", "character"), ("概念", "concept"))
_PROFILE = r"(?d)^Character_Profile_of:\s*([^\n]+)"


def entries(texts: DataFrame, text: str = "text", mode: str = "punct") -> DataFrame:
    """Reference text to entries: the input's other columns, pos, entry_type, name, entry_id, content, content_hash,
    properties, source. Text without entries gives no row."""
    rows = texts.select(*[c for c in texts.columns if c != text], F.posexplode(blocks(F.col(text))).alias("pos", "content"))
    begins = lambda sign, pattern: F.when(F.col("content").startswith(sign), F.regexp_extract("content", pattern, 1)).otherwise("")
    found = {kind: begins(f'{word}("', rf'^{word}\("([^"]+)"\)') for word, kind in _ENTRY}
    profile = T.strip(begins("Character_Profile_of:", _PROFILE))
    kind, name, source = F.lit("general"), F.substring(F.substring_index("content", "\n", 1), 1, 50), F.lit("general")
    kind, name, source = F.when(profile != "", "character").otherwise(kind), F.when(profile != "", profile).otherwise(name), F.when(profile != "", "character_profile").otherwise(source)
    for k, value in reversed(found.items()):
        kind, name, source = F.when(value != "", k).otherwise(kind), F.when(value != "", value).otherwise(name), F.when(value != "", "world_info").otherwise(source)
    rows = rows.withColumns({"entry_type": kind, "name": name, "source": source})
    return rows.withColumns({
        "entry_id": T.entry_id(F.col("entry_type"), F.col("name"), mode), "content_hash": T.content_hash(F.col("content"), mode),
        "properties": entry_properties(F.col("entry_type"), F.col("content")),
    })


def entry_properties(kind: Column, content: Column) -> Column:
    """The properties of an entry; general ones have none."""
    return F.when(kind == "general", F.create_map().cast("map<string,string>")).otherwise(properties(content))


#: `key: value`. Fixed value: a key being what stands between white space or colons. Looks behind only so that no word is tried twice.
_PAIR = r"(?<![^\s:])([^\s:]++):\s*([^\n]+)"


def properties(content: Column) -> Column:
    """`["..."]` hits as primary_description, attribute_1, ...; then `key: value` pairs; the last of a key wins.

    Each pattern is run once a text, and the last of a key is found by sorting.
    """
    hits = F.regexp_extract_all(content, F.lit(QUOTED), 1)
    named = F.transform(hits, lambda v, i: F.struct(F.when(i == 0, F.lit("primary_description")).otherwise(F.concat(F.lit("attribute_"), i.cast("string"))).alias("key"), v.alias("value")))
    pairs = F.transform(F.regexp_extract_all(content, F.lit(_PAIR), 0), lambda p: F.struct(F.substring_index(p, ":", 1).alias("key"), T.strip(p.substr(F.instr(p, ":") + 1, F.length(p))).alias("value")))
    placed = F.transform(F.concat(named, pairs), lambda e, i: F.struct(e["key"].alias("key"), i.alias("at"), e["value"].alias("value")))

    def last(s: Column) -> Column:
        own = F.filter(s, lambda e, i: ~F.coalesce(F.get(s, i + 1)["key"] == e["key"], F.lit(False)))
        back = F.array_sort(F.transform(own, lambda e: F.struct(e["at"].alias("at"), e["key"].alias("key"), e["value"].alias("value"))))
        return F.map_from_entries(F.transform(back, lambda e: F.struct(e["key"], e["value"])))

    return T.bound(F.array_sort(placed), last)


#: A line of a chat. Fixed value.
MESSAGE = r"(?U)(?d)^(User|Assistant|[A-Za-z一-龥]+):\s*(.+)$"


def chat_messages(texts: DataFrame, key: str = "session_id", text: str = "text") -> DataFrame:
    """`speaker: content` lines as messages: role (User, else Assistant), speaker, content, hash, number and id."""
    lines = F.filter(F.transform(F.split(text, "\n"), T.strip), lambda x: x.rlike(MESSAGE))
    rows = texts.select(key, F.posexplode(lines).alias("turn_number", "line"))
    rows = rows.select(key, "turn_number", F.regexp_extract("line", MESSAGE, 1).alias("speaker"), T.strip(F.regexp_extract("line", MESSAGE, 2)).alias("content"))
    speaker = F.lower("speaker")
    return rows.withColumns({
        "role": F.when(speaker == "user", "User").otherwise("Assistant"),
        "content_hash": T.content_hash(F.concat_ws(":", "speaker", "content")),
        "message_id": F.concat(F.lit("msg_"), F.col(key).cast("string"), F.lit("_"), F.col("turn_number").cast("string")),
    })
