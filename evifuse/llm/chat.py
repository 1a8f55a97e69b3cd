"""Chat formatting with a grammar round trip, in DataFrame operations alone.

Template: a turn is ``<s>role [INST] text [/INST]``, an assistant's turn ends in ``</s>`` instead. Turns stand
one after another. A conversation is rendered as it is and parsed again by a deterministic parser: the unescaped control strings cut
the text, and each three of them must be a turn's. Where the parsed turns differ from the source, the contents are escaped, rendered,
parsed and compared again. Escaping puts one backslash before every run of backslashes
that leads to a control string; parsing takes it away. One round is therefore always enough; that it was is checked for each
conversation, not assumed, and one that still differs raises. Texts without control strings are never changed.

The loss mask covers the assistants' texts: ``loss_runs`` are the lengths of what it skips and takes in turn. All patterns are linear in
the text.

Edge cases: null texts and roles are empty. Repeated rows are turns of their own; equal turn numbers are ordered
by role and text. A conversation without rows does not exist, so an empty table gives no rows. Texts are taken
whole. A row with a null conv_id is a conversation of its own, as nothing says with which others it belongs. Other columns, of any name, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evifuse.llm.quality import let

#: The template's control strings.
OPEN, HEAD, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]"
#: A control string that no backslash escapes. A run of backslashes is read once, from its start.
MARKER = rf"(?<!\\)(?:{CONTROL})"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<!\\)(\\*+)({CONTROL})", r"\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<!\\)\\(\\*+)({CONTROL})", "$1$2")


def again(turns: Column) -> Column:
    """The turns with their contents escaped."""
    return F.transform(turns, lambda t: F.struct(escaped(t["role"]).alias("role"), escaped(t["text"]).alias("text"), t["assistant"].alias("assistant")))


def rendered(turns: Column) -> Column:
    """The formatted text of an array of (role, text, assistant)."""
    end = lambda t: F.when(t["assistant"], F.lit(END)).otherwise(F.lit(CLOSE))
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(f" {HEAD} "), t["text"], F.lit(" "), end(t))), "")


def pieces(formatted: Column) -> tuple[Column, Column]:
    """What stands between the markers, and the markers."""
    return F.split(formatted, MARKER), F.regexp_extract_all(formatted, F.lit(MARKER), F.lit(0))


def parsed(formatted: Column) -> Column:
    """The array of (role, text, assistant) that a formatted text holds, unescaped; null if it is not of the grammar."""

    def turn(i: Column, between: Column, marks: Column) -> Column:
        lead, role, text = (F.element_at(between, 3 * i + k) for k in (1, 2, 3))
        a, b, c = (F.element_at(marks, 3 * i + k) for k in (1, 2, 3))
        fits = (lead == "") & (a == OPEN) & (b == HEAD) & c.isin(CLOSE, END) & role.endswith(" ") & text.startswith(" ") & text.endswith(" ") & (F.length(text) > 1)
        inner = lambda t, at: F.substring(t, F.lit(at), F.length(t) - at)
        return F.when(fits, F.struct(unescaped(inner(role, 1)).alias("role"), unescaped(inner(text, 2)).alias("text"), (c == END).alias("assistant")))

    def read(between: Column, marks: Column) -> Column:
        n = F.size(marks)
        turns = F.transform(F.sequence(F.lit(0), F.floor(n / 3).cast("int") - 1), lambda i: turn(i, between, marks))
        whole = (n > 0) & (n % 3 == 0) & (F.element_at(between, -1) == "")
        return F.when(whole, let(turns, lambda t: F.when(F.exists(t, lambda x: x.isNull()), None).otherwise(t)))

    between, marks = pieces(formatted)
    return let(F.struct(between.alias("b"), marks.alias("m")), lambda x: read(x["b"], x["m"]))


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, turns, formatted, escaped (whether it had to be) for (conv_id, turn, role, text)."""
    clean = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("lone")
    )
    whole = clean.groupBy("conv_id", "lone").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    turns = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"), (r["role"] == "assistant").alias("assistant")))
    whole = whole.select("conv_id", turns.alias("turns"))

    def settle(source: Column, is_escaped: bool) -> Column:
        """Rendered, parsed, compared; where it differs, escaped and settled again."""

        def compare(formatted: Column) -> Column:
            told = F.struct(formatted.alias("formatted"), F.lit(is_escaped).alias("escaped"))
            failed = F.raise_error(F.lit("a conversation does not come back from its format"))
            return F.when(parsed(formatted).eqNullSafe(F.col("turns")), told).otherwise(failed if is_escaped else let(again(source), lambda s: settle(s, True)))

        return let(rendered(source), compare)

    return whole.withColumn("made", settle(F.col("turns"), False)).select("conv_id", "turns", "made.*")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns, loss_runs, loss from (conv_id, formatted).

    Runs are (skip, take) in code points of the formatted text, escapes included; ``loss`` is what they take, unescaped.
    """
    turns = parsed(F.col("formatted"))
    between = F.split("formatted", MARKER)
    sizes = lambda i, close: F.struct(  # noqa: E731  markers, role and text of a turn; one space lies on either side of a text
        F.length(F.element_at(between, 3 * i + 2)).alias("role"), (F.length(F.element_at(between, 3 * i + 3)) - 2).alias("text"), F.length(close).alias("close"), (close == END).alias("taken")
    )
    marks = F.filter(F.regexp_extract_all("formatted", F.lit(MARKER), F.lit(0)), lambda m, i: i % 3 == 2)
    head = len(OPEN) + len(HEAD) + 1

    def runs(s: Column) -> Column:
        skip = s["role"] + head + F.when(s["taken"], 0).otherwise(s["text"])
        take = F.when(s["taken"], s["text"]).otherwise(0)
        return F.struct(skip.alias("skip"), take.alias("take"), (s["close"] + 1).alias("rest"))

    listed = formatted.select("conv_id", "formatted", turns.alias("turns"), F.transform(marks, lambda m, i: runs(sizes(i, m))).alias("loss_runs"))
    return listed.withColumn("loss", F.array_join(F.transform(F.filter("turns", lambda t: t["assistant"]), lambda t: t["text"]), ""))


def digests(conversations: DataFrame) -> DataFrame:
    """The query's columns, read back from the formatted text."""
    read = read_back(render(conversations).select("conv_id", "formatted"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )


#: The same in DuckDB: the source turns are what must be read back; escapes add a backslash for each control string of an escaped conversation.
SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone, length(role) + length(text) + CASE WHEN role = 'assistant' THEN 16 ELSE 19 END
    + len(regexp_extract_all(role, '<s>|</s>|\[INST\]|\[/INST\]')) + len(regexp_extract_all(text, '<s>|</s>|\[INST\]|\[/INST\]')) AS size
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id, lone
"""
