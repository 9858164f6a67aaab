"""Substring de-duplication by hashed lines and sentences.

Texts are cut at line ends and at sentence ends (``.``, ``!`` or ``?`` before a blank), so a passage set into the middle of a line
still has units of its own. A unit's words, lower-cased and joined by single spaces, are its normal form, and its MD5 digest
names it. Digests are grouped over all texts; the occurrence with the smallest (id, position) is kept and the others are
repeats. Repeats are removed where they stand in a run of successive repeated units of at least ``min_words`` words; 1 removes
every repeat. The default spares stock phrases: a repeated passage of over 50 words loses less than a sentence at either end, so
it keeps at least some 20 words in whole units. ``run_words`` tells the words of a unit's run. Every removal has its place in
the original text.

Units are written once to the shared folder. The most frequent repeated digests (``hot``, a bounded list) are joined by
broadcast; what is left has no key that holds more than its share.

Defined cases: a null text, an empty text and blank units have no units; rows that repeat an id are told apart by their
place in the table, and a null id ranks last; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuseval.functions.once import let
from corpuseval.llm.spans import sums_before
from corpuseval.session import materialize

BLANK = r"[\x20\x09-\x0D]+"
#: A unit with its end; punctuation inside a word ends nothing. The units of a text are the whole text.
UNIT = r"[^\n.!?]*+(?:[.!?]++[^\x20\x09-\x0D.!?][^\n.!?]*+)*+(?:[.!?]++|\n)?"


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, unit (its number among the units with a word), start and length in characters, n_words, digest."""
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    pieces = F.regexp_extract_all("text", F.lit(UNIT), F.lit(0))
    starts = lambda cut: sums_before(F.transform(cut, F.length))
    placed = let(pieces, lambda cut: F.arrays_zip(starts(cut).alias("start"), cut.alias("text")))
    worded = F.filter(placed, lambda u: u["text"].rlike(r"[^\x20\x09-\x0D]"))
    rows = texts.select("row", "doc_id", F.posexplode(worded).alias("unit", "u"))
    body = F.rtrim("u.text", F.lit("\n"))
    plain = F.trim(F.regexp_replace(F.lower("u.text"), BLANK, " "))
    spaced = rows.select("row", "doc_id", "unit", F.col("u.start").alias("start"), F.length(body).alias("length"), plain.alias("plain"))
    return spaced.select(
        "row", "doc_id", "unit", "start", "length",
        (F.length("plain") - F.length(F.replace("plain", F.lit(" "))) + 1).alias("n_words"),
        F.unhex(F.md5("plain")).alias("digest"),
    )


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, hot: int = 1000
) -> DataFrame:
    """doc_id, unit, start, length, n_words, run_words, first_doc_id, first_start: one row per removed unit."""
    lines = materialize(units(docs, id_col, text_col))
    rank = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("at"), "row", "unit", "doc_id", "start")
    several = lines.groupBy("digest").agg(F.count("*").alias("times"), F.min(rank).alias("first")).where("times > 1")
    several = materialize(several)
    common = F.broadcast(several.orderBy(F.desc("times"), "digest").limit(hot).select("digest", "first"))
    others = several.join(common.select("digest"), "digest", "left_anti").select("digest", "first")
    marked = lines.join(common, "digest", "left")
    known = marked.where("first is not null")
    found = known.unionByName(marked.where("first is null").drop("first").join(others, "digest"))
    repeats = found.where((F.col("first.row") != F.col("row")) | (F.col("first.unit") != F.col("unit")))
    by_row = W.partitionBy("row").orderBy("unit")
    runs = repeats.withColumn("run", F.col("unit") - F.row_number().over(by_row))
    long = runs.withColumn("run_words", F.sum("n_words").over(W.partitionBy("row", "run"))).where(F.col("run_words") >= min_words)
    return long.select(
        "doc_id", "unit", "start", "length", F.col("n_words").cast("bigint").alias("n_words"), F.col("run_words").cast("bigint").alias("run_words"),
        F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"),
    )
