"""Personal data: exact kinds by pattern, further notations by bootstrapped context patterns.

Base kinds (email, ip, card, phone) are found by pattern and checked (address parts up to 255, Luhn, digit counts). Each base
match is a seed. The words around it give lexical patterns: the word before, the two words before, the words before and after.
Strings in looser notations (phones without a plus, cards with other separators, spelled-out addresses, IPv6) are unlabelled
instances, with the kinds their notation allows. Patterns and instances are a graph, scored in turns:

* a pattern's confidence for a kind is the sum of its instances' scores over their number, where a seed of another kind counts
  in full against it, an unlabelled instance at least ``UNKNOWN``, and two more for a short record;
* an unlabelled instance's score is the chance that not all of its patterns err, 1 - product(1 - confidence).

After ``rounds`` turns, unlabelled occurrences beside a pattern with at least ``seeds`` distinct seeds and a confidence of at least
``accept`` become spans of its kind. All work is built-in expressions: texts are read once, and what is shuffled are matches
with some words around them, never texts. Hot patterns and instances are reduced to sums on the map side, and joined with
salted lookups.

The patterns match what the plain forms in the docstring of ``base_spans`` match; possessive quantifiers and the guards before them
keep the time linear in long runs of one character class.

Defined cases: a null or empty text has no spans; a null id and repeated rows are scanned like any others (rows are told apart
by their place); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuseval.llm.spans import placed_matches
from corpuseval.operators.keyed import lookup_join
from corpuseval.session import materialize

KINDS = ["email", "ip", "card", "phone"]
AROUND = 48  # characters of context on either side
UNKNOWN = 0.25  # what an unlabelled instance counts against a pattern at least
# The forms of the base kinds.
NAME, LABEL = r"A-Za-z0-9._%+-", r"A-Za-z0-9-"
BASE = {
    "email": rf"(?:(?<![{NAME}])|\G)[{NAME}]++@[{LABEL}]++(?:\.[{LABEL}]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# Looser notations of the same kinds.
AT = r"(?:\x20?[\[({<]\x20?(?:at|AT|@)\x20?[\])}>]\x20?|\x20(?:at|AT)\x20)"
DOT = r"(?:\x20?[\[({<]\x20?(?:dot|DOT|\.)\x20?[\])}>]\x20?|\x20(?:dot|DOT)\x20|\.)"
SPELLED = rf"(?<![{NAME}])[{NAME}]++{AT}[{LABEL}]++(?:{DOT}[{LABEL}]++)++"
HEX = r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"
NUMBER = r"(?<![0-9A-Za-z])[+(]{0,2}[0-9](?:[\x20().:/-]{0,2}[0-9])++(?![0-9A-Za-z])"
LOOSE = f"{SPELLED}|{HEX}|{NUMBER}"
SPAN = "array<struct<start:int,rank:int,kind:string,end:int,text:string,before:string,after:string>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return text.rlike(rf"^{BYTE}(\.{BYTE}){{3}}$")
    if kind == "card":
        return F.length(_digits(text)).between(14, 19) & F.call_function("luhn_check", _digits(text))
    if kind == "phone":
        return F.length(_digits(text)).between(10, 15)
    return F.lit(True)


def _spans(kind: str | None, found: Column) -> Column:
    rank = KINDS.index(kind) if kind else None
    return F.transform(
        found,
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(rank).cast("int").alias("rank"), F.lit(kind).cast("string").alias("kind"),
            (m["start"] + F.length(m["text"])).alias("end"), m["text"].alias("text"), m["before"].alias("before"), m["after"].alias("after"),
        ),
    )


def base_spans(text: Column) -> Column:
    """Array of base matches (start, rank, kind, end, text, before, after), by start and kind.

    Leftmost and without overlap within a kind, failing ones dropped without another try:
    email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, ip ``[0-9]+(\\.[0-9]+){3}`` with parts up to 255,
    card ``[0-9]([ -]?[0-9])+`` with 14 to 19 digits that pass Luhn, phone ``\\+[0-9][ ().0-9-]+[0-9]`` with 10 to 15 digits.
    """
    def of(kind: str) -> Column:
        return _spans(kind, F.filter(placed_matches(text, BASE[kind], AROUND), lambda m: _valid(kind, m["text"])))

    return F.array_sort(F.concat(*[of(k) for k in KINDS]))


def loose_spans(text: Column) -> Column:
    """Array of strings in looser notations, in the form of ``base_spans`` without a kind."""
    found = F.filter(
        placed_matches(text, LOOSE, AROUND), lambda m: m["text"].rlike("[@A-Za-z]") | (F.length(_digits(m["text"])) >= 7)
    )
    return _spans(None, found)


def allowed_kinds(text: Column) -> Column:
    """Kinds that a looser notation may stand for."""
    n = F.length(_digits(text))
    spelled, hexed = text.rlike("@|(?i)at"), text.rlike("^([0-9A-Fa-f]{1,4}:){3,}")
    plain = ~spelled & ~hexed
    tests = [spelled, hexed | (plain & text.rlike(rf"^{BYTE}( ?[.] ?{BYTE}){{3}}$")), plain & n.between(13, 19), plain & n.between(7, 15)]
    return F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in zip(KINDS, tests, strict=True)]), lambda k: k.isNotNull())


def context_patterns(before: Column, after: Column) -> Column:
    """The lexical patterns of an occurrence: word before; two words before; word before and word after."""
    low, high = F.lower(before), F.lower(after)
    word = F.when(low.rlike(r"(^|\n)\s*$"), "^").otherwise(F.regexp_extract(low, r"(\S+)\s*$", 1))
    second = F.regexp_extract(low, r"(\S+)\s+\S+\s*$", 1)
    following = F.when(high.rlike(r"^\s*(\n|$)"), "$").otherwise(F.regexp_extract(high, r"^\s*(\S+)", 1))
    return F.array(
        F.concat(F.lit("1 "), word), F.concat(F.lit("2 "), second, F.lit(" "), word), F.concat(F.lit("r "), word, F.lit(" "), following)
    )


def occurrences(rows: DataFrame) -> DataFrame:
    """row, start, end, kind (null: unlabelled), text, patterns; unlabelled ones that overlap a base match are left out."""
    each = rows.select("row", F.explode(F.concat("base", "loose")).alias("s")).select("row", "s.*")
    order = W.partitionBy("row").orderBy("start", F.col("rank").asc_nulls_last())
    seed = F.col("kind").isNotNull()
    reached = F.max(F.when(seed, F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    ahead = F.min(F.when(seed, F.col("start"))).over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    free = (F.coalesce(reached, F.lit(0)) <= F.col("start")) & (F.coalesce(ahead, F.col("end")) >= F.col("end"))
    kept = each.withColumn("keep", seed | free).where("keep")
    return kept.select("row", "start", "end", "kind", "text", context_patterns(F.col("before"), F.col("after")).alias("patterns"))


def learn_patterns(found: DataFrame, rounds: int = 3, seeds: int = 5) -> DataFrame:
    """pattern, kind, confidence from occurrences; patterns with fewer than ``seeds`` distinct seeds of the kind have none."""
    edges = found.select(F.explode("patterns").alias("pattern"), "text", "kind").distinct()
    known = edges.where("kind is not null").groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
    of_all = known.groupBy("pattern").agg(F.sum("seeds").alias("all_seeds"))
    record = materialize(known.where(F.col("seeds") >= seeds).join(of_all, "pattern"))
    open_edges = edges.where("kind is null").select("pattern", "text", F.explode(allowed_kinds(F.col("text"))).alias("kind"))
    relevant = materialize(lookup_join(open_edges, record.select("pattern", "kind"), ["pattern", "kind"], "inner"))
    scores = relevant.select("text", "kind").distinct().withColumn("score", F.lit(0.0))
    conf = None
    for _ in range(rounds):
        scored = lookup_join(relevant, scores, ["text", "kind"], "inner")
        gained = scored.groupBy("pattern", "kind").agg(
            F.sum("score").alias("gained"), F.sum(F.greatest("score", F.lit(UNKNOWN))).alias("weight")
        )
        total = F.col("all_seeds") + F.coalesce("weight", F.lit(0.0)) + 2
        conf = materialize(record.join(gained, ["pattern", "kind"], "left").select(
            "pattern", "kind", ((F.col("seeds") + F.coalesce("gained", F.lit(0.0))) / total).alias("confidence")
        ))
        doubt = F.sum(F.log(1 - F.col("confidence")))
        scores = materialize(lookup_join(relevant, conf, ["pattern", "kind"], "inner").groupBy("text", "kind").agg((1 - F.exp(doubt)).alias("score")))
    return conf


def discover(found: DataFrame, conf: DataFrame, accept: float = 0.8) -> DataFrame:
    """row, start, end, kind: unlabelled occurrences beside a pattern of high confidence, the best kind of each."""
    sure = conf.where(F.col("confidence") >= accept)
    open_rows = found.where("kind is null").select("row", "start", "end", "text", F.explode("patterns").alias("pattern"))
    kinds = open_rows.select("row", "start", "end", "pattern", F.explode(allowed_kinds(F.col("text"))).alias("kind"))
    hits = lookup_join(kinds, sure, ["pattern", "kind"], "inner")
    rank = reduce(lambda a, k: a.when(F.col("kind") == k, KINDS.index(k)), KINDS[1:], F.when(F.col("kind") == KINDS[0], 0))
    best = hits.withColumn("rank", rank).groupBy("row", "start", "end").agg(
        F.min(F.struct((-F.col("confidence")).alias("less"), "rank", "kind")).alias("b")
    )
    return best.select("row", "start", "end", F.col("b.rank").alias("rank"), F.col("b.kind").alias("kind"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, seeds: int = 5, accept: float = 0.8
) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found: a row per row of ``docs``."""
    text = F.col(text_col)
    rows = materialize(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"),
        base_spans(text).cast(SPAN).alias("base"), loose_spans(text).cast(SPAN).alias("loose"),
    ))
    found = materialize(occurrences(rows.where("size(base) + size(loose) > 0")))
    new = discover(found, learn_patterns(found, rounds, seeds), accept)
    plain = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))
    grouped = new.groupBy("row").agg(F.collect_list(F.struct("start", "rank", "kind", "end")).alias("more"))
    base = F.transform("base", plain)
    joined = rows.select("row", "doc_id", base.alias("base")).join(grouped, "row", "left")
    every = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return joined.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(every).alias("spans"),
        F.coalesce(F.size("more"), F.lit(0)).cast("bigint").alias("n_found"),
    )
