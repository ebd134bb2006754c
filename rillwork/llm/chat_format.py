"""Chat formatting: render conversations, reparse what was rendered, escape until both agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape_text(c: Column) -> Column:
    """A backslash before each backslash and inside each control string's opening: reversible, and no marker is left."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(c: Column) -> Column:
    """As escape_text; a line feed becomes a backslash and an n, so that a role ends at the first line feed."""
    return F.replace(escape_text(c), F.lit("\n"), F.lit("\\n"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def unescape_role(c: Column) -> Column:
    """Pairs of backslashes first, read from the left, then the other escapes in what lies between them."""
    parts = F.split(c, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))), "\\")


def _render(turns: Column, role, text) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), role(t["role"]), F.lit("\n"), text(t["text"]), F.lit(END))), "")


def _pieces(formatted: Column) -> Column:
    """What follows each start mark; whatever stands before the first is an empty string in a whole rendering."""
    parts = F.split(formatted, r"<\|im_start\|>", -1)
    return F.slice(parts, F.lit(2), F.size(parts) - 1)


def _fields(pieces: Column) -> Column:
    """Each piece as (whole, head, text), both still escaped: the head ends at the first line feed, the text at the end mark.

    Plain searches only, no pattern that backtracks, so a line or a text may be of any length.
    """

    def one(p):
        head = F.substring_index(p, "\n", 1)
        rest = F.substr(p, F.char_length(head) + 2)
        whole = F.endswith(rest, F.lit(END))
        text = F.substr(rest, F.lit(1), F.greatest(F.lit(0), F.char_length(rest) - len(END)))
        return F.struct((whole & ~F.contains(text, F.lit(END.strip()))).alias("whole"), head.alias("head"), text.alias("text"))

    return F.transform(pieces, one)


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation, as array<struct<role, text>>.

    Marks count wherever they stand. A piece that is no turn, with no end mark or with two, has null fields.
    """
    turn = lambda f: F.struct(F.when(f["whole"], unescape_role(f["head"])).alias("role"), F.when(f["whole"], unescape(f["text"])).alias("text"))
    return F.transform(_fields(_pieces(formatted)), turn)


def loss_runs(formatted: Column, role: str = "assistant") -> Column:
    """The loss mask as runs of code points, one for each turn: ``skip`` outside the mask, ``take`` under it, ``rest`` outside.

    The runs follow each other without a gap and cover the whole rendered text. A text of the role is under the mask
    as it stands there, escapes included; other turns have take 0. Linear in the conversation's length.
    """

    def run(f):
        said = f["whole"] & (unescape_role(f["head"]) == role)
        n = F.char_length(f["text"])
        before, after = F.char_length(f["head"]) + len(START) + 1, F.lit(len(END))
        return F.struct(before.cast("long").alias("skip"), F.when(said, n).otherwise(0).cast("long").alias("take"), (F.when(said, 0).otherwise(n) + after).cast("long").alias("rest"))

    return F.transform(_fields(_pieces(formatted)), run)


def under_mask(formatted: Column, runs: Column) -> Column:
    """The stretches of the rendered text under the mask, unescaped, in order."""
    cut = lambda p, r: unescape(F.substr(p, (r["skip"] - len(START) + 1).cast("int"), r["take"].cast("int")))
    # an escaped stretch is unescaped by itself: runs never cut an escape in two
    return F.zip_with(_pieces(formatted), runs, lambda p, r: F.when(r["take"] > 0, cut(p, r)).otherwise(""))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conv_id: formatted text, whether it is escaped, and the turns and loss runs read back from it.

    ``turns`` has conv_id, turn, role, text; other columns are ignored. A null role or text is empty; rows are
    ordered by (turn, role, text), so ties and repeated rows have one order; a null turn comes first; rows without
    a conv_id form one conversation with a null id. First the texts are rendered as they are and parsed again; a
    conversation whose turns come back changed is rendered anew with its conflicting content escaped, and a second
    difference is an error. An empty table gives no row. A conversation is one row: its text must fit one task.
    """
    one = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    source = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("s"))
    source = source.select("conv_id", F.transform("s", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    plain = source.withColumn("plain", _render(F.col("turns"), lambda r: r, lambda t: t))
    same = parse(F.col("plain")) == F.col("turns")
    out = plain.withColumn("escaped", ~same).withColumn(
        "formatted", F.when(F.col("escaped"), _render(F.col("turns"), escape_role, escape_text)).otherwise(F.col("plain"))
    )
    back = out.withColumn("recovered", parse(F.col("formatted")))
    checked = F.when(F.col("recovered") == F.col("turns"), F.col("recovered")).otherwise(F.raise_error(F.lit("a conversation does not survive its template")).cast(out.schema["turns"].dataType))
    return back.select("conv_id", "formatted", "escaped", checked.alias("turns"), loss_runs(F.col("formatted")).alias("loss_runs"))


def digests(formatted: DataFrame) -> DataFrame:
    """The figures of the contract, from the rendered text and what was read back from it."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = formatted.withColumn("loss", F.array_join(under_mask(F.col("formatted"), F.col("loss_runs")), ""))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "escaped",
    )
