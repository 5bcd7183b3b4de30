"""Quality rules whose thresholds follow the corpus: DataFrame operations only.

Every document gets integer measures. A mergeable quantile sketch holds the distribution of a measure among the documents
of a language and source that pass the fixed base rules: counts by bins whose width is a 32nd of their value or less, which
add up in any order and partition to the same sketch. A fence lies beyond an upper quantile of the group, by a multiple of the
distance from a lower quantile to it: everything that decides comes from the group's own sketch. Shares of rare things are
add-one rates, (count + 1) / (size + a constant), which have a spread even where most documents have none of them; a document
without any is never outside. Sketches of a language's small groups are merged, and those of small languages likewise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import SPACE, cut, let

#: Production parameters: words of a repeated window; documents that a sketch needs to be used by itself.
WINDOW = 8
GROUP_DOCUMENTS = 200
#: Copies of a threshold row: documents of one group join by a salt.
SALTS = 32
#: Groups whose fences are broadcast at most.
BROADCAST = 50_000
#: Measures as (name, SQL over the counts, percent of the lower and of the upper quantile, multiple of their distance, count that must be
#: above 0 for a document to be outside, or None for fences on both sides). Repetition is common in clean text, so that its fences lie beyond its tail.
MEASURES = (
    ("word_length", "1000 * word_chars div n_words", 25, 75, 5, None),
    ("symbols", "100000 * (n_symbols + 1) div (n_words + 100)", 25, 75, 3, "n_symbols"),
    ("dup_lines", "100000 * (n_dup_lines + 1) div (n_lines + 10)", 50, 99, 3, "n_dup_lines"),
    ("repeats", "100000 * (n_repeat_words + 1) div (n_words + 100)", 50, 99, 3, "n_repeat_words"),
)

#: The number of the bin of a value v >= 0, and the least and greatest value of bin b, in SQL (integers only).
BIN = "CASE WHEN v < 64 THEN v ELSE length(bin(v)) * 64 + shiftright(v, length(bin(v)) - 6) END"
BIN_LOW = "CASE WHEN b < 64 THEN b ELSE shiftleft(b % 64, CAST(b div 64 AS INT) - 6) END"
BIN_HIGH = "CASE WHEN b < 64 THEN b ELSE shiftleft(b % 64 + 1, CAST(b div 64 AS INT) - 6) - 1 END"


def _pairs(hashes: Column, step: int) -> Column:
    """Hashes of each element with the one step places on."""
    return let(hashes, lambda h: F.when(F.size(h) > step, F.transform(F.sequence(F.lit(0), F.size(h) - step - 1), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + step)))).otherwise(F.array().cast("array<bigint>")))


def _repeated(windows: Column) -> Column:
    """Words that lie in a window whose hash occurs twice or more, from the hashes of all windows of WINDOW words."""

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        twice = let(ordered, lambda s: F.filter(s, lambda x, j: same(s, x, j - 1) | same(s, x, j + 1)))
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        spans = let(starts, lambda s: F.transform(s, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - x, F.lit(WINDOW))).cast("long")))
        return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))


def measure(df: DataFrame, text_col: str = "text") -> Column:
    """A struct of the counts of one text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (null counts as empty)."""
    text = F.coalesce(df[text_col], F.lit(""))
    words = F.array_remove(F.split(text, SPACE, -1), "")
    assert WINDOW == 8
    windows = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.struct(F.size(h).cast("long").alias("n"), _repeated(_pairs(_pairs(_pairs(h, 1), 2), 4)).alias("r")))
    lines = let(F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))), lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d")))
    without = lambda letters: F.char_length(F.translate(text, letters, "")).cast("long")
    return F.struct(windows.alias("w"), without(" \t\n\x0b\x0c\r").alias("word_chars"), (F.char_length(text) - without("#*$%&|<>")).alias("n_symbols"), lines.alias("l"))


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", more: tuple[str, ...] = ()) -> DataFrame:
    """id_col, lang, source, the columns more, the counts, base_failed and the measures (null if base_failed) of every whole text."""
    counted = df.select(F.col(id_col), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), measure(df, text_col).alias("c"), *more)
    counted = counted.select(id_col, "lang", "source", *more, F.col("c.w.n").alias("n_words"), "c.word_chars", "c.n_symbols", F.col("c.l.n").alias("n_lines"), F.expr("c.l.n - c.l.d").alias("n_dup_lines"), F.col("c.w.r").alias("n_repeat_words"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumns({f"m_{n}": F.expr(f"CASE WHEN NOT base_failed THEN {sql} END") for n, sql, *_ in MEASURES})


def sketches(made: DataFrame) -> DataFrame:
    """Rows lang, source, measure, b, n: the documents of the group whose measure lies in bin b. Sketches merge by adding n."""
    values = F.explode(F.array(*(F.struct(F.lit(i).alias("measure"), F.col(f"m_{m[0]}").alias("v")) for i, m in enumerate(MEASURES)))).alias("x")
    return made.filter(~F.col("base_failed")).select("lang", "source", values).select("lang", "source", "x.measure", "x.v").withColumn("b", F.expr(BIN)).groupBy("lang", "source", "measure", "b").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, group_documents: int = GROUP_DOCUMENTS) -> DataFrame:
    """lang, source, and for each measure low_<name> (where it has one) and high_<name>, from the sketch of the smallest level with group_documents documents: source, else language, else all."""
    cells = sketch.groupBy("measure", "b", "lang", "source").agg(F.sum("n").alias("n"))
    found = []
    for keys in (["lang", "source"], ["lang"], []):
        level = cells.groupBy(*keys, "measure", "b").agg(F.sum("n").alias("n"))
        group = Window.partitionBy(*keys, "measure")
        upto = group.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        level = level.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(group)})
        lower, upper = (F.element_at(F.array(*(F.lit(m[k]) for m in MEASURES)), F.col("measure") + 1) for k in (2, 3))
        least = lambda percent, edge: F.min(F.when(100 * F.col("upto") >= percent * F.col("total"), F.expr(edge)))
        of = level.groupBy(*keys, "measure").agg(F.first("total").alias("total"), least(lower, BIN_LOW).alias("lower"), least(upper, BIN_HIGH).alias("upper"))
        wide = []
        for i, (name, _, _, _, reach, count) in enumerate(MEASURES):
            pick = lambda sql: F.max(F.when(F.col("measure") == i, F.expr(sql)))  # noqa: E731, B023
            wide.append(pick(f"upper + {reach} * (upper - lower)").alias(f"high_{name}"))
            if count is None:
                wide.append(pick(f"lower - {reach} * (upper - lower)").alias(f"low_{name}"))
        found.append(of.groupBy(*keys).agg(F.max("total").alias("total"), *wide))
    names = [c for c in found[0].columns if c.startswith(("high_", "low_"))]
    source, language, whole = found
    groups = source.select("lang", "source", F.struct("total", *names).alias("g2"))
    groups = groups.join(language.select(F.col("lang").alias("_l"), F.struct("total", *names).alias("g1")), F.col("lang").eqNullSafe(F.col("_l")), "left")
    groups = groups.withColumn("_all", F.lit(0)).join(whole.select(F.lit(0).alias("_all"), F.struct("total", *names).alias("g0")), "_all", "left")
    best = F.when(F.col("g2.total") >= group_documents, F.col("g2")).when(F.col("g1.total") >= group_documents, F.col("g1")).otherwise(F.col("g0"))
    return groups.select("lang", "source", best.alias("g")).select("lang", "source", *(F.col(f"g.{n}").alias(n) for n in names))


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", group_documents: int = GROUP_DOCUMENTS) -> DataFrame:
    """id_col, the counts, base_failed, kept of every row of df.

    A null text counts as empty and fails the base rules; a null language or source is a group of its own; repeated rows
    count and come back as often as they are there; an empty table gives an empty one; other columns are ignored. The
    features are computed once and written to the checkpoint folder, since sketches and filter both need them. The join
    with the fences is salted, so that one group with a third of all rows spreads over SALTS tasks.
    """
    made = cut(features(df, id_col, text_col, lang_col, source_col))
    return judged(made, fences(sketches(made), group_documents), id_col).select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def kept_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", group_documents: int = GROUP_DOCUMENTS, broadcast: int = BROADCAST) -> DataFrame:
    """The rows of df that quality_rules keeps, with all their columns.

    The features are computed a second time with the rows at hand, so that the texts needn't be shuffled to their verdicts.
    The fences are broadcast if they are of at most broadcast groups.
    """
    narrow = cut(features(df, id_col, text_col, lang_col, source_col))
    fence = cut(fences(sketches(narrow), group_documents))
    names = df.columns
    whole = df.select(F.struct(*names).alias("_whole"), *(F.col(c) for c in {id_col, text_col, lang_col, source_col}))
    made = features(whole, id_col, text_col, lang_col, source_col, more=("_whole",))
    return judged(made, fence, id_col, broadcast=fence.count() <= broadcast).filter("kept").select("_whole.*")


def judged(made: DataFrame, fence: DataFrame, id_col: str, broadcast: bool = False) -> DataFrame:
    """The features with kept. The join with the fences is salted unless they are broadcast."""
    names = [c for c in fence.columns if c.startswith(("high_", "low_"))]
    fence = fence.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *names)
    inside = F.lit(True)
    for name, _, _, _, _, count in MEASURES:
        below = F.col(f"m_{name}") <= F.col(f"high_{name}")
        inside &= below & (F.col(f"m_{name}") >= F.col(f"low_{name}")) if count is None else below | (F.col(count) == 0)
    on = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    if broadcast:
        joined = made.join(F.broadcast(fence), on, "left")
    else:
        salted = made.withColumn("_row_salt", F.pmod(F.xxhash64(id_col, "word_chars"), F.lit(SALTS)).cast("int"))
        joined = salted.join(fence.withColumn("_salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS))))), (F.col("_row_salt") == F.col("_salt")) & on, "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
