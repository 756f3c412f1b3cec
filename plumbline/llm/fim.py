"""Fill-in-middle transformation by lookaround splitting.

A unit grammar says which neighbouring code points stay together, as pairs of character classes (before, after). It is
translated to a regular expression without width that matches between all other neighbours; Spark's own ``split`` on that
expression gives the units and loses no character, and an empty text, which it would give back as one piece, counts as
none. All of it is DataFrame expressions within a row: no shuffle, no Python.

A text is split in sections of ``SECTION`` code points, of which only the units' lengths are kept (four bytes a unit), so
a very long text costs a few times its size; a unit that goes on over a section's edge counts once. Two cuts, drawn from
a digest of the row's id and the seed, part the units in prefix, middle and suffix, which are put out in the order of one
of two forms behind sentinels; ``restore`` rebuilds the text from output and form alone.

A text stays plain if it is empty (null counts as empty), holds a sentinel, or isn't drawn. Sentinels are checked: none
may be empty or overlap another's edge, so that the first of each in an output is the one that was put there. Rows with
equal ids are cut at the same shares; a null id draws as the empty text does. All columns pass through, whatever their names, but
one named as ``out_col``, which is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points that are split at once.
SECTION = 1 << 18


@dataclass(frozen=True)
class Grammar:
    """Pairs of classes, as inside ``[...]``: a code point of the first, followed by one of the second, stays in one unit with it."""

    joins: tuple[tuple[str, str], ...] = ()

    def boundary(self) -> str:
        """Matches, without width, between neighbours that no pair joins; never at an edge of the text or inside a surrogate pair."""
        return "".join(f"(?!(?<=[{a}])(?=[{b}]))" for a, b in self.joins) + r"(?!\A)(?!\z)(?![\uDC00-\uDFFF])"


CHARACTERS = Grammar()
WORDS = Grammar((("A-Za-z", "A-Za-z"),))
LINES = Grammar((("^\\n", "\\x{0}-\\x{10FFFF}"),))
RUNS = Grammar((("\\s", "\\s"), ("\\S", "\\S")))


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        every = (self.prefix, self.suffix, self.middle)
        for i, a in enumerate(every):
            for j, b in enumerate(every):
                if not a or i != j and a in b or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                    raise ValueError(f"sentinels may not be empty, hold or overlap one another: {a!r}, {b!r}")


def unit_lengths(text: Column, grammar: Grammar, section: int = SECTION) -> Column:
    """array<struct<joined int, lengths array<int>>>, one for each section: the lengths of its pieces, and 1 if its first piece goes on from the section before."""

    def of(k: Column) -> Column:
        start = k * section
        across = F.substr(text, start, F.lit(2))
        joined = F.when(k == 0, 0).otherwise((F.size(F.split(across, grammar.boundary(), -1)) == 1).cast("int"))
        pieces = F.split(F.substr(text, start + 1, F.lit(section)), grammar.boundary(), -1)
        return F.struct(joined.alias("joined"), F.transform(pieces, F.length).alias("lengths"))

    last = F.floor((F.length(text) - 1) / section).cast("int")
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), last), of)).otherwise(F.array().cast("array<struct<joined:int,lengths:array<int>>>"))


def n_units(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda n, s: n + F.size(s["lengths"]) - s["joined"])


def chars_of(lengths: Column, units: Column) -> Column:
    """Code points of the first ``units`` units: all up to where the next one starts."""

    def step(a: Column, s: Column) -> Column:
        starts, here = F.size(s["lengths"]) - s["joined"], F.aggregate(s["lengths"], F.lit(0).cast("long"), lambda n, x: n + x)
        inside = F.slice(s["lengths"], 1, (units - a["seen"] + s["joined"]).cast("int"))
        found = a["found"] | (units < a["seen"] + starts)
        at = F.when(a["found"], a["at"]).when(found, a["at"] + F.aggregate(inside, F.lit(0).cast("long"), lambda n, x: n + x)).otherwise(a["at"] + here)
        return F.struct((a["seen"] + starts).alias("seen"), at.alias("at"), found.alias("found"))

    zero = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("at"), F.lit(False).alias("found"))
    return F.aggregate(lengths, zero, step)["at"]


def draw(key: Column, k: int) -> Column:
    """The k-th (from 0) eight hexadecimal digits of the key's digest as a number."""
    return F.conv(F.substring(F.sha2(key, 256), 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    grammar: Grammar = WORDS,
    sentinels: Sentinels = Sentinels(),
    percent: int = 90,
    spm_percent: int = 20,
    seed: int = 1,
    out_col: str = "fim",
    section: int = SECTION,
) -> DataFrame:
    """``docs`` with a struct: ``n`` units, ``form`` (plain, psm, spm), ``prefix_chars`` and ``middle_chars`` (null if plain), and the ``output``."""
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    kept = [c for c in docs.columns if c.lower() != out_col.lower()]
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(q(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.struct(*(q(c) for c in kept)).alias("row"), F.coalesce(q(text_col), F.lit("")).alias("text"), key.alias("key"))
    rows = rows.withColumn("lengths", unit_lengths(F.col("text"), grammar, section))
    rows = rows.withColumn("n", n_units(F.col("lengths")))
    a, b = (draw(F.col("key"), k) % (F.col("n") + 1) for k in (0, 1))
    held = F.lit(False)
    for s in (sentinels.prefix, sentinels.suffix, sentinels.middle):
        held = held | F.contains("text", F.lit(s))
    plain = (F.col("n") == 0) | held | (draw(F.col("key"), 2) % 100 >= percent)
    rows = rows.withColumn("form", F.when(plain, "plain").when(draw(F.col("key"), 3) % 100 < spm_percent, "spm").otherwise("psm"))
    cut = F.col("form") != "plain"
    rows = rows.withColumns({"first": F.when(cut, chars_of(F.col("lengths"), F.least(a, b))), "second": F.when(cut, chars_of(F.col("lengths"), F.greatest(a, b)))})
    prefix = F.substr("text", F.lit(1), F.col("first").cast("int"))
    middle = F.substr("text", (F.col("first") + 1).cast("int"), (F.col("second") - F.col("first")).cast("int"))
    suffix = F.substr("text", (F.col("second") + 1).cast("int"))
    psm = F.concat(F.lit(sentinels.prefix), prefix, F.lit(sentinels.suffix), suffix, F.lit(sentinels.middle), middle)
    spm = F.concat(F.lit(sentinels.suffix), suffix, F.lit(sentinels.prefix), prefix, F.lit(sentinels.middle), middle)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    out = F.struct("n", "form", F.col("first").alias("prefix_chars"), (F.col("second") - F.col("first")).alias("middle_chars"), output.alias("output"))
    return rows.select("row.*", out.alias(out_col))


def restore(output: Column, form: Column, sentinels: Sentinels = Sentinels()) -> Column:
    """The text from an output and its form; null where the output doesn't hold each sentinel once."""
    quoted = ("\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E" for s in (sentinels.prefix, sentinels.suffix, sentinels.middle))
    pieces = F.split(output, "|".join(quoted), -1)  # what stands before the first, then the three parts

    def joined(p: Column) -> Column:
        return F.when(F.size(p) == 4, F.when(form == "psm", F.concat(p[1], p[3], p[2])).when(form == "spm", F.concat(p[2], p[3], p[1])))

    return F.when(form == "plain", output).otherwise(F.transform(F.array(pieces), joined)[0])
