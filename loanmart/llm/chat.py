"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record is a VARIANT of any layout.  The nested field paths it has, out of those some
layout knows, are hashed to a fingerprint; the fingerprint selects a declared mapping to
canonical turns (role, text).  The template marks turns and escapes control strings inside
texts, and a mask of runs says which characters carry loss: the texts of assistant turns.

Defined cases: null roles and texts are empty; a record whose paths match no layout, or whose list of
turns is empty, has no turns and an empty output; fields no layout knows are ignored, so
further fields change nothing; turns with equal numbers are ordered by role, then text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"

# names other layouts use for the roles of the canonical one
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _text(record: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(record, path, "string"), F.lit(""))


def _turn(role, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), text.alias("text"))


def _listed(record: Column, path: str, role: str, text: str) -> Column:
    turns = F.try_variant_get(record, path, f"array<struct<`{role}` string, `{text}` string>>")
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])

    def canonical(t: Column) -> Column:
        given = F.coalesce(t[role], F.lit(""))
        return _turn(F.coalesce(names[given], given), F.coalesce(t[text], F.lit("")))

    return F.transform(turns, canonical)


def _asked(record: Column, question: str, answer: str, context: str | None = None) -> Column:
    asked = _text(record, question)
    if context:
        more = _text(record, context)
        asked = F.when(more == "", asked).otherwise(F.concat(asked, F.lit("\n\n"), more))
    return F.array(_turn("user", asked), _turn(LEARNED_ROLE, _text(record, answer)))


@dataclass(frozen=True)
class Layout:
    """The field paths a record of this layout has, and how its turns are read."""

    paths: tuple[str, ...]
    kind: str

    def turns(self, record: Column) -> Column:
        fields = [p.rpartition(".")[2] for p in self.paths]
        if self.kind == "list":
            return _listed(record, self.paths[0].partition("[")[0], *fields)
        out = _asked(record, self.paths[0], self.paths[1], self.paths[2] if len(fields) > 2 and self.kind == "ask" else None)
        if self.kind == "system":
            return F.concat(F.array(_turn("system", _text(record, self.paths[2]))), out)
        return out


LAYOUTS = (
    Layout(("$.messages[0].role", "$.messages[0].content"), "list"),
    Layout(("$.turns[0].role", "$.turns[0].text"), "list"),
    Layout(("$.conversations[0].from", "$.conversations[0].value"), "list"),
    Layout(("$.instruction", "$.output", "$.input"), "ask"),
    Layout(("$.instruction", "$.output"), "ask"),
    Layout(("$.prompt", "$.completion"), "ask"),
    Layout(("$.prompt", "$.response"), "ask"),
    Layout(("$.prompt", "$.response", "$.system"), "system"),
    Layout(("$.question", "$.answer"), "ask"),
    Layout(("$.question", "$.answer", "$.context"), "ask"),
)


def fingerprint(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of the known nested field paths the record has."""
    known = sorted({p for layout in layouts for p in layout.paths})
    found = [F.when(F.try_variant_get(record, p, "variant").isNotNull(), F.lit(p)) for p in known]
    return F.xxhash64(F.concat_ws(" ", *found))


def _declared(layout: Layout) -> Column:
    return F.xxhash64(F.lit(" ".join(sorted(layout.paths))))


def canonical_turns(record: Column, print_: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """array<struct<role, text>> by the mapping the fingerprint selects."""
    out = F.when(F.lit(False), layouts[0].turns(record))
    for layout in layouts:
        out = out.when(print_ == _declared(layout), layout.turns(record))
    none = F.array().cast("array<struct<role:string,text:string>>")
    return F.coalesce(out, none)


def escape(text: Column) -> Column:
    """No marker survives inside: every backslash starts a pair, and ``<|`` is broken up."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def _run(chars: Column, learn: Column) -> Column:
    return F.struct(chars.cast("int").alias("chars"), learn.alias("learn"))


def format_chats(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Add ``fingerprint``, ``formatted`` and ``mask`` (runs of characters, with or without loss).

    Every turn has three runs: its head, its text, its tail.
    """
    rest = [c for c in records.columns if c not in ("fingerprint", "formatted", "mask")]
    printed = records.select(*[F.col(f"`{c}`") for c in rest], fingerprint(F.col(f"`{record}`"), layouts).alias("fingerprint"))
    turns = canonical_turns(F.col(f"`{record}`"), F.col("fingerprint"), layouts)
    escaped = F.transform(
        turns,
        lambda t: F.struct(
            F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("text"),
            (t["role"] == LEARNED_ROLE).alias("learn"),
        ),
    )
    parts = printed.withColumn("_turns", escaped)
    tail = END + "\n"
    lines = F.transform("_turns", lambda t: F.concat(t["head"], t["text"], F.lit(tail)))
    mask = F.flatten(
        F.transform(
            "_turns",
            lambda t: F.array(
                _run(F.length(t["head"]), F.lit(False)),
                _run(F.length(t["text"]), t["learn"]),
                _run(F.lit(len(tail)), F.lit(False)),
            ),
        )
    )
    return parts.withColumns({"formatted": F.array_join(lines, ""), "mask": mask}).drop("_turns")


def read_back(formatted: Column, mask: Column) -> tuple[Column, Column]:
    """(turns, learned texts), both unescaped, from nothing but the output."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        return F.struct(
            unescape_role(F.substr(head, F.lit(len(START) + 1))).alias("role"),
            unescape(F.substr(piece, F.length(head) + 2)).alias("text"),
        )

    def learned(piece: Column, i: Column) -> Column:
        head, text = F.get(mask, i * 3), F.get(mask, i * 3 + 1)
        return F.when(text["learn"], unescape(F.substr(piece, head["chars"] + 1, text["chars"])))

    return F.transform(pieces, turn), F.filter(F.transform(pieces, learned), lambda t: t.isNotNull())


def records_from_rows(rows: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """One VARIANT record per conversation from a table with one row per turn."""
    turn_row = F.struct(F.col(f"`{turn}`").alias("at"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    ordered = F.sort_array(F.collect_list(turn_row))
    grouped = rows.groupBy(F.col(f"`{conv_id}`").alias("conv_id")).agg(ordered.alias("turns"))
    bare = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return grouped.select("conv_id", F.to_variant_object(F.struct(bare.alias("turns"))).alias("record"))


def chat_report(records: DataFrame, key: str = "conv_id") -> DataFrame:
    """Digests of what is read back from the formatted records."""
    done = format_chats(records)
    turns, learned = read_back(F.col("formatted"), F.col("mask"))
    read = done.select(key, "formatted", turns.alias("turns"), F.array_join(learned, "").alias("learned"))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        key,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
