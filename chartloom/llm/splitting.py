"""Pieces of oversized texts, cut at natural boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.operators.small import if_small, without_repeats

#: What may end a piece, strongest first: blank line, line, sentence, clause, word, whole character.
BOUNDARIES = (
    r"(?<=\n[ \t\r]{0,20}\n)",
    r"(?<=[\n  ])",
    r"(?<=[.!?…]['\")\]”’»]{0,3}\s)",
    r"(?<=[;:,]\s)",
    r"(?<=\s)",
    r"(?<!‍)(?![\p{M}‍️\U0001F3FB-\U0001F3FF])(?<!\r(?=\n))".replace(r"\U0001F3FB-\U0001F3FF", r"\x{1F3FB}-\x{1F3FF}"),
)


def _consuming(least: Column, most: Column) -> Column:
    """A regex that takes up to ``most`` characters from where the last match ended."""
    stop = [F.concat(F.lit(".{"), least, F.lit(","), most, F.lit("}" + b)) for b in BOUNDARIES]
    rest = F.concat(F.lit(".{1,"), most, F.lit(r"}\z"))
    return F.concat_ws("|", rest, *stop, F.concat(F.lit(".{1,"), most, F.lit("}")))


def split(df: DataFrame, limits: DataFrame, key: str, profile: str, text: str, start: str) -> DataFrame:
    """(key, profile, piece_no, n_pieces, text, piece_start, piece_end, start_char, end_char, overlap) of every text.

    ``limits`` gives max_chars, overlap_chars and min_chunk_chars for each profile. A text within its
    limit is one piece. From a longer one a regex of bounded quantifiers takes cores: each tries to
    end, as late as it can, at the strongest boundary found between min_chunk_chars and the limit, and
    falls back to the next weaker kind, at last to a place between whole characters. A piece is a core
    behind the last overlap_chars characters of the one before, so that no piece exceeds max_chars,
    neighbors share exactly overlap_chars, and the cores put together are the text.

    Lengths and offsets count code points. piece_start and piece_end are offsets in the text itself;
    start_char and end_char add ``start`` and are null where that is null. An overlap above half the
    limit counts as half; min_chunk_chars counts as the overlap at least. Null and empty texts and
    profiles without a limit above 1 have no pieces. Repeated keys count once. Other columns, whatever
    their names, are ignored.
    """
    bound = limits.select(
        F.col("profile").alias("_profile"),
        F.col("max_chars").cast("int").alias("_max"),
        F.coalesce(F.col("overlap_chars"), F.lit(0)).cast("int").alias("_wanted"),
        F.coalesce(F.col("min_chunk_chars"), F.lit(1)).cast("int").alias("_min"),
    ).where("_profile IS NOT NULL AND _max > 1").dropDuplicates(["_profile"])
    rows = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{profile}`").alias("_p"), F.col(f"`{text}`").alias("_text"), F.col(f"`{start}`").cast("long").alias("_base")).where("_text <> ''")
    joined = without_repeats(rows, "_key").join(if_small(bound), F.col("_p") == F.col("_profile"))
    overlap = F.greatest(F.lit(0), F.least(F.col("_wanted"), F.floor(F.col("_max") / 2).cast("int")))
    sized = joined.withColumn("_overlap", overlap).withColumn("_core", F.col("_max") - F.col("_overlap"))
    least = F.least(F.greatest(F.col("_min"), F.col("_overlap"), F.lit(1)), F.col("_core"))
    least, core, first = least.cast("string"), F.col("_core").cast("string"), F.col("_max").cast("string")
    pattern = F.concat(F.lit(r"(?s)\A(?:"), _consuming(least, first), F.lit(")|(?:"), _consuming(least, core), F.lit(")"))
    cores = sized.withColumn("_cores", F.when(F.length("_text") <= F.col("_max"), F.array("_text")).otherwise(F.regexp_extract_all("_text", pattern, F.lit(0))))
    ends = cores.withColumn(
        "_ends",
        F.aggregate("_cores", F.array(F.lit(0).cast("long")), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + F.length(x)))),
    )
    pieces = ends.select("_key", "_p", "_base", "_overlap", "_ends", "_cores", F.size("_cores").alias("n_pieces"), F.posexplode("_cores").alias("piece_no", "_piece"))
    before = F.when(F.col("piece_no") > 0, F.expr("right(_cores[piece_no - 1], _overlap)")).otherwise("")
    begun = F.expr("_ends[piece_no]") - F.length("_before")
    return (
        pieces.withColumn("_before", before)
        .withColumns({"piece_start": begun, "piece_end": F.expr("_ends[piece_no + 1]")})
        .select(
            F.col("_key").alias(key),
            F.col("_p").alias("profile"),
            "piece_no",
            "n_pieces",
            F.concat("_before", "_piece").alias("text"),
            "piece_start",
            "piece_end",
            (F.col("_base") + F.col("piece_start")).alias("start_char"),
            (F.col("_base") + F.col("piece_end")).alias("end_char"),
            F.length("_before").alias("overlap"),
        )
    )
