"""Chat formatting by schema fingerprints.

Records come as JSON in whatever layout their source uses. The nested field paths of a record are hashed; the
fingerprint selects a declarative mapping, which converts prompt, instruction or message layouts into canonical turns.
Turns are rendered with one template, in which control strings of any known template are escaped reversibly.
"""

import hashlib
import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Strings that chat templates use as control tokens: each gets a backslash after its first character.
_CONTROL = r"(<(?=\||/?s>|(?:start|end)_of_turn>|(?:bos|eos|unk|pad)>|</?SYS>>)|\[(?=/?(?:INST|AVAILABLE_TOOLS|TOOL_CALLS|TOOL_RESULTS)\]))"
TURNS = "array<struct<role: string, text: string>>"
#: Field that holds a record which Spark's reader can't read, and the reader's options: strings as long as a row can hold.
UNREAD = "_unread"
READER = {"maxStringLen": str(2**31 - 1), "columnNameOfCorruptRecord": UNREAD}

#: The role names of layouts that have their own.
SHAREGPT_ROLES = {"human": "user", "gpt": "assistant", "system": "system"}


def paths_of(example: object, at: str = "") -> set[str]:
    """Nested field paths of a parsed JSON value; [] stands for the elements of an array."""
    if isinstance(example, dict):
        return {at or "."} if not example else set().union(*(paths_of(v, f"{at}.{k}") for k, v in example.items()))
    if isinstance(example, list):
        return {f"{at}[]"} if not example else set().union(*(paths_of(v, f"{at}[]") for v in example))
    return {at or "."}


def fingerprint_of(example: object) -> str:
    return hashlib.sha256("\n".join(sorted(paths_of(example))).encode()).hexdigest()


@dataclass(frozen=True)
class Layout:
    """A mapping. Either ``turns`` names an array whose elements hold ``role`` and ``text``, or ``fields`` lists
    (role, fields): each gives one turn from the named fields that are not empty, joined by a blank line. ``roles``
    renames roles; others stay. ``also`` names further fields that such records have."""

    name: str
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()
    also: tuple[str, ...] = ()

    def examples(self) -> list[dict]:
        """Records with this layout: with and without turns."""
        extra = dict.fromkeys(self.also, "")
        if self.turns:
            return [{self.turns: [{self.role: "", self.text: ""}]} | extra, {self.turns: []} | extra]
        return [{f: "" for _, names in self.fields for f in names} | extra]

    def schema(self) -> str:
        if self.turns:
            return f"struct<`{self.turns}`: array<struct<`{self.role}`: string, `{self.text}`: string>>, {UNREAD}: string>"
        return "struct<" + ", ".join(f"`{f}`: string" for _, names in self.fields for f in names) + f", {UNREAD}: string>"

    def convert(self, payload: Column) -> Column:
        """Canonical turns of a record; null if it can't be read, never empty texts in its place."""
        record = F.from_json(payload, self.schema(), READER)
        whole = record[UNREAD].isNull()
        if self.turns:
            return F.when(whole, F.transform(record[self.turns], lambda t: F.struct(self._renamed(t[self.role]).alias("role"), F.coalesce(t[self.text], F.lit("")).alias("text"))))
        parts = []
        for role, names in self.fields:
            text = F.concat_ws("\n\n", *[F.when(record[n] != "", record[n]) for n in names]) if len(names) > 1 else F.coalesce(record[names[0]], F.lit(""))
            parts.append(F.struct(F.lit(role).alias("role"), text.alias("text")))
        return F.when(whole, F.array(*parts))

    def _renamed(self, role: Column) -> Column:
        out = F.coalesce(role, F.lit(""))
        for old, new in self.roles:
            out = F.when(role == old, F.lit(new)).otherwise(out)
        return out


LAYOUTS = (
    Layout("messages", "messages"),
    Layout("sharegpt", "conversations", "from", "value", roles=tuple(SHAREGPT_ROLES.items())),
    Layout("dialogue", "dialogue", "speaker", "utterance"),
    Layout("prompt-response", fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt-completion", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("question-answer", fields=(("user", ("question",)), ("assistant", ("answer",)))),
    Layout("instruction", fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction-only", fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("system-prompt", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
)


def _fingerprints(payload: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        try:
            return fingerprint_of(json.loads(text)) if text is not None else None
        except (ValueError, RecursionError):
            return None

    return payload.map(one)


def fingerprint(payload: Column) -> Column:
    """sha256 over the sorted nested field paths of a JSON record; null if it is no JSON."""
    return F.pandas_udf(_fingerprints, "string")(payload)


def canonical(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(..., payload) -> the same with fingerprint, layout and turns; both null where no mapping fits."""
    rows = records.withColumn("fingerprint", fingerprint(F.col("payload")))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in layouts:
        known = F.col("fingerprint").isin([fingerprint_of(e) for e in x.examples()])
        layout, turns = F.when(known, F.lit(x.name)).otherwise(layout), F.when(known, x.convert(F.col("payload"))).otherwise(turns)
    return rows.withColumns({"layout": layout, "turns": turns})


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(doubled, _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(turns: Column) -> Column:
    """Turns -> one string. A role's line breaks are escaped too, so that the first plain one ends the role."""

    def one(t: Column) -> Column:
        role = F.regexp_replace(escape(t["role"]), "\n", "\\\\\n")
        return F.concat(F.lit(START), role, F.lit("\n"), escape(t["text"]), F.lit(END))

    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """What ``render`` wrote -> turns with role, text and loss (whether the text is under the loss mask)."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: p.startswith(START))

    def one(p: Column) -> Column:
        body = F.substr(p, F.lit(len(START) + 1))
        role = F.regexp_extract(body, r"(?s)^((?:[^\\\n]++|\\.)*+)\n", 1)
        name = unescape(role)
        return F.struct(name.alias("role"), unescape(F.substr(body, F.length(role) + 2)).alias("text"), (name == "assistant").alias("loss"))

    return F.transform(parts, one)


def format_chats(records: DataFrame, ident: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(ident, payload) -> ident, layout, fingerprint, turns, formatted, loss_texts.

    Records without a mapping have null layout, turns and formatted text and are left for inspection; records without
    turns format to an empty text; what Spark's reader can't read has null turns and formatted text. Repeated rows each give a row; an empty table gives none. A record is one value in
    one task: its size is bounded by a row's.
    """
    rows = canonical(records.select(ident, "payload"), layouts)
    return rows.select(ident, "layout", "fingerprint", "turns", render(F.col("turns")).alias("formatted"))


def digests(formatted: DataFrame, ident: str = "conv_id") -> DataFrame:
    """The contract's figures of formatted chats, read back from the formatted text alone."""
    back = formatted.select(ident, "formatted", parse(F.col("formatted")).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return back.select(
        ident,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def as_records(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) -> one record per conversation, in one of several layouts by its id.

    Turns are ordered by turn, then role and text; null texts and roles count as empty. Conversations of a user's and
    an assistant's turn alternate between the prompt layouts, others between the layouts with message lists; the one
    that has its own role names takes those whose roles it can name.
    """
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    kind = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(3))
    renamed = lambda role, text: F.transform("turns", lambda t: F.struct(t["role"].alias(role), t["text"].alias(text)))
    named = F.forall("turns", lambda t: t["role"].isin(list(SHAREGPT_ROLES.values())))
    own = lambda role: F.element_at(F.create_map(*[F.lit(x) for old, new in SHAREGPT_ROLES.items() for x in (new, old)]), role)
    pair = (F.size("turns") == 2) & (F.col("turns")[0]["role"] == "user") & (F.col("turns")[1]["role"] == "assistant")
    said = [F.col("turns")[k]["text"] for k in (0, 1)]
    payload = (
        F.when(pair & (kind == 0), F.to_json(F.struct(said[0].alias("prompt"), said[1].alias("response"))))
        .when(pair & (kind == 1), F.to_json(F.struct(said[0].alias("instruction"), said[1].alias("output"))))
        .when(kind == 0, F.to_json(F.struct(renamed("role", "content").alias("messages"))))
        .when((kind == 1) & named, F.to_json(F.struct(F.transform("turns", lambda t: F.struct(own(t["role"]).alias("from"), t["text"].alias("value"))).alias("conversations"))))
        .otherwise(F.to_json(F.struct(renamed("speaker", "utterance").alias("dialogue"))))
    )
    return grouped.select("conv_id", payload.alias("payload"))
