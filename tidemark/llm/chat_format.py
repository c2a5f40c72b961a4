"""Chat formatting: a finite-state machine over roles and a declarative template.

A conversation's rows are put in turn order, its roles run through the
template's transition table, and its turns rendered as segments, each with a
loss flag; the formatted text is the segments joined.  Control strings inside
texts are escaped by one backslash after their first character (and one more
where backslashes stand there already), which is undone exactly when reading;
roles are written in URL encoding, so that they end at the first line end.

All of it is array expressions over one row per conversation; the only
shuffle is by conversation.  A conversation is one row of the result, so its
turns meet in one task by definition; many equal conversations are many keys.

Defined results: null texts and roles are empty; turns are ordered by
(turn, role, text), nulls first, so ties and repeated rows have one order;
repeated rows are turns of their own; rows with a null conversation are one
conversation; extra columns are ignored; an empty table gives an empty table.
A conversation whose roles break the machine's order is formatted all the
same and marked ``valid = false``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import pick, read


@dataclass(frozen=True)
class ChatTemplate:
    """``open`` role ``after_role`` text ``close`` for each turn; texts of ``loss_roles`` bear loss."""

    # Turn marks in the ChatML manner, and marks of other formats that texts may imitate.
    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    control: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "<SYS>>", "</SYS>>", "[INST]", "[/INST]")
    start: str = "start"
    #: (state, role) -> state; what is absent is an error, which stays one.
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    #: States in which a conversation may end.
    final: tuple[str, ...] = ("system", "user", "assistant")

    def __post_init__(self) -> None:
        heads = {c[0] for c in self.control}
        if any(heads & set(c[1:]) or len(c) < 2 or "\\" in c for c in self.control):
            raise ValueError("no control string's first character may stand later in one")
        if self.open not in self.control or self.close.rstrip("\n") not in self.control:
            raise ValueError("the turn marks must be control strings")

    def between(self, taken: str) -> str:
        """A Java pattern: ``taken`` right after a control string's first character, with backslashes and its rest behind."""
        rests: dict[str, list[str]] = {}
        for c in self.control:
            rests.setdefault(_literal(c[0]), []).append(_literal(c[1:]))
        return "|".join(f"(?<={h}){taken}(?=\\x5C*(?:{'|'.join(r)}))" for h, r in rests.items())


def _literal(text: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


def escape(text: Column, template: ChatTemplate) -> Column:
    return F.regexp_replace(text, template.between(""), r"\\")


def unescape(text: Column, template: ChatTemplate) -> Column:
    return F.regexp_replace(text, template.between(r"\x5C"), "")


def _turns(role: Column, text: Column) -> Column:
    return F.concat(role, F.lit("\n"), text, F.lit("\n"))


def format_chats(rows: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, segments, formatted, loss_mask.

    ``segments`` is an array of (text, loss); ``formatted`` is their texts
    joined; ``loss_mask`` is an array of (start, length): the bytes of
    ``formatted`` in UTF-8 that bear loss.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn"), empty("role").alias("role"), empty("text").alias("text"))
    df = pick(rows, conv_id="conv_id", turn="turn", role="role", text="text").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    table = F.create_map(*[F.lit(x) for (state, role), to in template.transitions.items() for x in (f"{state}\n{role}", to)])
    ends = lambda state: F.coalesce(state.isin(*template.final), F.lit(False))
    state = F.aggregate("turns", F.lit(template.start), lambda s, t: F.coalesce(F.try_element_at(table, F.concat(s, F.lit("\n"), t["role"])), F.lit("error")), ends)

    def rendered(t: Column) -> Column:
        segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        head = F.concat(F.lit(template.open), F.url_encode(t["role"]), F.lit(template.after_role))
        return F.array(
            segment(head, F.lit(False)),
            segment(escape(t["text"], template), t["role"].isin(*template.loss_roles)),
            segment(F.lit(template.close), F.lit(False)),
        )

    df = df.select("conv_id", F.size("turns").cast("long").alias("n_turns"), state.alias("valid"), F.flatten(F.transform("turns", rendered)).alias("segments"))
    none = F.array().cast("array<struct<start:int,length:int>>")

    def masked(so_far: Column, x: Column) -> Column:
        at, n = so_far["at"], F.octet_length(x["text"])
        spans = F.when(x["loss"], F.concat(so_far["spans"], F.array(F.struct(at.alias("start"), n.alias("length"))))).otherwise(so_far["spans"])
        return F.struct((at + n).alias("at"), spans.alias("spans"))

    mask = F.aggregate("segments", F.struct(F.lit(0).alias("at"), none.alias("spans")), masked, lambda x: x["spans"])
    return df.withColumns({"formatted": F.array_join(F.transform("segments", lambda x: x["text"]), ""), "loss_mask": mask})


def read_back(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """The turns, an array of (role, text), parsed from formatted text."""
    parts = F.filter(F.split(formatted, _literal(template.open)), lambda p, i: i > 0)

    def parsed(p: Column) -> Column:
        cut = F.instr(p, template.after_role)
        body = F.substr(p, cut + len(template.after_role))
        text = F.substr(body, F.lit(1), F.char_length(body) - len(template.close))
        return F.struct(F.url_decode(F.substr(p, F.lit(1), cut - 1)).alias("role"), unescape(text, template).alias("text"))

    return F.transform(parts, parsed)


def masked_text(formatted: Column, loss_mask: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """All text under the mask, unescaped, with nothing between."""
    # bytes are cut where they lie; characters would be counted from the start for every span
    part = lambda x: F.decode(F.substr(formatted.cast("binary"), x["start"] + 1, x["length"]), "UTF-8")
    return F.array_join(F.transform(loss_mask, lambda x: unescape(part(x), template)), "")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted text.

    To ``conversations`` it adds conversation -7, whose texts look like
    control strings.
    """
    template = ChatTemplate()
    planted = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    df = format_chats(rows, template)
    df = df.withColumns({
        "read": read_back(F.col("formatted"), template),
        "loss": masked_text(F.col("formatted"), F.col("loss_mask"), template),
    })
    turns = F.array_join(F.transform("read", lambda t: _turns(t["role"], t["text"])), "")
    return df.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    string_agg(role, ',' ORDER BY turn NULLS FIRST, role, text) AS roles,
    sum(12 + length(role) + 1 + 11 + length(regexp_replace(text,
      '(<)(\\*(?:\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|SYS>>|/SYS>>))|(\[)(\\*(?:INST\]|/INST\]))', '\1\3.\2\4', 'g'))) AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars::BIGINT AS formatted_chars, regexp_full_match(roles, 'system|(system,)?user(,assistant,user)*(,assistant)?') AS valid
FROM g
"""
