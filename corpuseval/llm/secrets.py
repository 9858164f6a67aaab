"""Secret scan: candidates by pattern, false positives removed by a random forest written as SQL expressions.

Candidates are private-key blocks (or a header with the key lines below it), known key prefixes, dotted web tokens, values of
six characters or more that the name of a secret is assigned, and runs of 16 or more key characters with a digit. A candidate's
features are its length, character classes and transitions between them, how much of it common words and syllables cover, path
signs around it, and the words before and after it. A forest is trained on labelled findings: rows of candidates with a label,
or, where no such table exists, secrets and look-alikes of many forms set into a bounded sample of texts (``labelled_findings``),
whose labels say what was planted and follow from no feature. The trees become conditional expressions, so candidates are judged
inside the row that holds their text: no explode, join or shuffle is needed, and redaction is a projection. Work is linear in a
text's length and its candidates.

Defined cases: a null or empty text has no findings; a null id and repeated rows are scanned like any others; without
labelled findings of both kinds every candidate gets the share of secrets among them (0 without any); other columns are not
read by the scan, and redaction hands them on. Not looked for: secrets without a digit, a known prefix or an assignment to a
name of a secret, and of a key block without its end the last line if it is short.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuseval.functions.once import compute_once, let

RUN = r"[A-Za-z0-9+/_\-]"
NAME = r"(?i:token|secret|password|passwd|pwd|api[_\-]?key|access[_\-]?key|auth|bearer|credential)"
#: A closed key block, else the header and the long lines of key characters below it.
KEY_BLOCK = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
    r"(?:[A-Za-z0-9+/=\s:,]*+(?:-(?!-)[A-Za-z0-9+/=\s:,]*+){0,6}-----END [A-Z ]{0,20}PRIVATE KEY-----"
    r"|(?:\s{1,2}[A-Za-z0-9+/=]{20,}+){0,500}+)"
)
WEB_TOKEN = rf"(?<!{RUN})eyJ[A-Za-z0-9_\-]{{8,}}+(?:\.[A-Za-z0-9_\-]++){{0,4}}"
KNOWN_KEY = (
    rf"(?<!{RUN})(?:(?:AKIA|ASIA)[0-9A-Z]{{16}}(?!{RUN})|gh[pousr]_[A-Za-z0-9]{{16,}}+|sk[_\-][A-Za-z0-9_\-]{{16,}}+"
    r"|xox[abprs]-[A-Za-z0-9\-]{10,}+)"
)
#: The short first test spares most places the long one.
ASSIGNED_VALUE = (
    rf"(?<=[:=][ \"']|[:=] [\"']|[:=])(?<={NAME}[\"']?[ ]?[:=][ ]?[\"']?)"
    r"(?![\s\"'])[^\s\"'<>]{5,}[^\s\"'<>.,;:)\]}]"
)
LONG_RUN = rf"(?<!{RUN})(?=[A-Za-z+/_\-]*[0-9]){RUN}{{16,}}={{0,2}}"
CANDIDATE = "|".join([KEY_BLOCK, WEB_TOKEN, KNOWN_KEY, ASSIGNED_VALUE, LONG_RUN])
AROUND = 48  # characters of context on either side
# Names before a secret, names before a checksum, fragments of ordinary text.
SECRET_NAMES = NAME
HASH_NAMES = r"(?i)(commit|sha\d*|md5|checksum|digest|uuid|revision|etag|build|hash|card|order|invoice|tel)"
ASSIGNED = r"[:=]\s*[\"']?$"
BLOCK = 256  # findings placed together
FRAGMENTS = r"(?i)(example|sample|test|user|name|admin|data|file|index|image|page|http|www|com|org|the|and|ing|tion|ent|er|th|on)"
KEY_PREFIX = r"^(AKIA[0-9A-Z]{16}$|ASIA[0-9A-Z]{16}$|gh[pousr]_|sk[_\-]|xox[abprs]-|eyJ|-----BEGIN)"
FEATURES = [
    "length", "digits", "capitals", "signs", "transitions", "distinct", "hex", "numeric", "covered", "slashes",
    "path_before", "path_after", "prefix", "secret_name", "hash_name", "assigned", "quoted", "named", "letters", "vowels", "other_signs",
]


def findings(text: Column) -> Column:
    """Array of (start, text, before, after, gap), in order; ``start`` is in characters from 0.

    ``before`` and ``after`` are up to AROUND characters, ``gap`` is all the text since the candidate before.
    """

    def running(at: Column, lengths: Column) -> Column:
        """The sum of all lengths before each, plus ``at``."""
        begin = F.struct(at.cast("int").alias("at"), F.array().cast("array<int>").alias("starts"))
        return F.aggregate(
            lengths,
            begin,
            lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")),
            lambda acc: acc["starts"],
        )

    def blocked(lengths: Column) -> Column:
        """The same for any number of lengths: block sums first, so that no long array grows step by step."""
        firsts = F.sequence(F.lit(1), F.size(lengths), F.lit(BLOCK))
        blocks = F.transform(firsts, lambda first: F.slice(lengths, first, F.lit(BLOCK)))

        def spread(parts: Column) -> Column:
            sums = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda total, n: total + n))
            return F.flatten(F.zip_with(running(F.lit(0), sums), parts, running))

        return let(blocks, spread)

    def placed(parts: Column) -> Column:
        hits, gaps = parts["hits"], parts["gaps"]
        lengths = F.transform(hits, lambda hit, i: (F.length(F.get(gaps, i)) + F.length(hit)).cast("int"))

        def one(start: Column, i: Column) -> Column:
            gap = F.get(gaps, i)
            return F.struct(
                (start + F.length(gap)).alias("start"),
                F.get(hits, i).alias("text"),
                F.right(gap, F.lit(AROUND)).alias("before"),
                F.left(F.get(gaps, i + 1), F.lit(AROUND)).alias("after"),
                gap.alias("gap"),
            )

        return F.transform(let(lengths, blocked), one)

    whole = F.coalesce(text, F.lit(""))
    gaps = F.split(whole, CANDIDATE, -1).alias("gaps")
    found = F.regexp_extract_all(whole, F.lit(CANDIDATE), F.lit(0))
    return let(found, lambda hits: F.when(F.size(hits) > 0, let(F.struct(hits.alias("hits"), gaps), placed)))


def features(f: Column) -> Column:
    """The features of a finding as an array of doubles, in the order of FEATURES."""
    text, before, after = f["text"], f["before"], f["after"]
    size = F.length(text).cast("double")
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double") / size
    flag = lambda column, pattern: column.rlike(pattern).cast("double")
    turns = r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"
    near = F.right(before, F.lit(24))
    return F.array(
        size,
        share("[0-9]"),
        share("[A-Z]"),
        share(r"[+/_\-=]"),
        (F.length(F.regexp_replace(text, turns, "\u0001")) - F.length(text)).cast("double") / size,
        F.size(F.array_distinct(F.split(text, ""))).cast("double"),
        flag(text, r"^([0-9a-f]+|[0-9A-F]+)$"),
        flag(text, r"^[0-9]+$"),
        1 - F.length(F.regexp_replace(text, FRAGMENTS, "")).cast("double") / size,
        F.regexp_count(text, F.lit("/")).cast("double"),
        flag(before, r"(://\S*|[/\\.@#])$"),
        flag(after, r"^([.@/\\]\w|\?)"),
        flag(text, KEY_PREFIX),
        flag(near, SECRET_NAMES),
        flag(near, HASH_NAMES),
        flag(before, ASSIGNED),
        (before.rlike(r"[\"']$") & after.rlike(r"^[\"']")).cast("double"),
        flag(before, NAME + r"([\"']?\s*[:=]\s*[\"']?|\s+)$"),
        share("[A-Za-z]"),
        share("[AEIOUaeiou]"),
        share(r"[^A-Za-z0-9+/_=\s\-]"),
    )


@dataclass
class Tree:
    """A split (feature, value, lower side, upper side), or the share of secrets at a leaf."""

    share: float
    feature: int = -1
    value: float = 0.0
    lower: Tree | None = None
    upper: Tree | None = None

    def expression(self, x: Column) -> Column:
        if self.feature < 0:
            return F.lit(self.share)
        test = F.get(x, F.lit(self.feature)) < self.value
        return F.when(test, self.lower.expression(x)).otherwise(self.upper.expression(x))


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int) -> Tree:
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return Tree(share)
    best, best_gain = None, 1e-9
    impurity = share * (1 - share)
    for f in rng.choice(x.shape[1], size=max(1, int(np.ceil(np.sqrt(x.shape[1])))), replace=False):
        for value in np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 24))):
            low = x[:, f] < value
            n = int(low.sum())
            if least <= n <= len(y) - least:
                a, b = y[low].mean(), y[~low].mean()
                gain = impurity - (n * a * (1 - a) + (len(y) - n) * b * (1 - b)) / len(y)
                if gain > best_gain:
                    best, best_gain = (int(f), float(value), low), gain
    if best is None:
        return Tree(share)
    f, value, low = best
    return Tree(share, f, value, _grow(x[low], y[low], rng, depth - 1, least), _grow(x[~low], y[~low], rng, depth - 1, least))


def train_forest(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 6, least: int = 3, seed: int = 5) -> list[Tree]:
    """Trees on bootstrap samples, each split looking at a random part of the features."""
    if not len(y):
        return [Tree(0.0)]
    if len(set(y.tolist())) == 1:
        return [Tree(float(y[0]))]
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(_grow(x[rows], y[rows], rng, depth, least))
    return out


def forest_score(forest: list[Tree], f: Column) -> Column:
    def total(x: Column) -> Column:
        out = F.lit(0.0)
        for tree in forest:
            out = out + tree.expression(x)
        return out / len(forest)

    return let(features(f), total)


def train_on(labelled: DataFrame, limit: int = 6_000) -> list[Tree]:
    """A forest from labelled findings (finding struct, label 0 or 1), of which at most ``limit`` are read."""
    rows = labelled.select(features(F.col("finding")).alias("x"), F.col("label").cast("int").alias("label")).where("label is not null")
    some = rows.orderBy(F.xxhash64("x", "label"), "label").limit(limit).collect()
    x = np.array([r.x for r in some], dtype=float).reshape(len(some), len(FEATURES))
    return train_forest(x, np.array([r.label for r in some], dtype=float))


LOWER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
ALNUM = LOWER + LOWER.upper() + DIGITS
WORDS = "letter dragon summer monkey winter orange silver purple castle garden rocket hidden report margin filter window".split()
STATES = "required expired incorrect optional protected disabled rejected unchanged missing invalid rotated forgotten".split()
PASSWORD_NAMES = ["password: ", "password=", "pwd=", "passwd: ", 'password = "', "db_password=", "Password: "]
KEY_NAMES = ["api_key = ", "apikey: ", "API_KEY=", 'access_key: "', "client_secret=", "auth_token: ", 'token = "', "secret: ", "TOKEN="]
OTHER_NAMES = ["session: ", "id=", "name = ", "key: ", "ref=", "trace: ", 'etag = "', "cache = "]
SUM_NAMES = ["commit ", "revision ", "sha256: ", "md5 ", "checksum: ", "build ", "uuid ", "digest=", "the "]
PLAIN = ["", "use ", "with ", "and ", "key ", "see "]
#: Forms that are planted: name, label, what stands before, parts of the value. A part is a list of texts to choose from, or an
#: alphabet with the least and the greatest number of characters.
FORMS: list[tuple[str, int, list[str], list]] = [
    ("mixed password", 1, PASSWORD_NAMES, [(ALNUM + "!@#$%&*?+", 8, 16)]),
    ("word password", 1, PASSWORD_NAMES, [WORDS, (DIGITS + "!@#&$", 2, 5)]),
    ("written password", 1, PASSWORD_NAMES, [["Tr0", "P4s", "S3c", "W1n", "M0n", "L3t"], (LOWER + DIGITS, 3, 6), (DIGITS + "!@&$", 2, 3)]),
    ("letter key", 1, KEY_NAMES, [(LOWER, 16, 40)]),
    ("mixed key", 1, KEY_NAMES, [(ALNUM, 16, 48)]),
    ("hex key", 1, KEY_NAMES, [(HEX, 32, 40)]),
    ("bearer", 1, ["Authorization: Bearer ", "Bearer ", "bearer "], [(ALNUM + "_-", 24, 60)]),
    ("web token", 1, [*PLAIN, "Bearer ", *KEY_NAMES], [["eyJ"], (ALNUM, 17, 33), ["."], (ALNUM + "_", 30, 80), ["."], (ALNUM + "_", 43, 43)]),
    ("cloud key", 1, [*PLAIN, "aws_access_key_id = "], [["AKIA", "ASIA"], (LOWER.upper() + DIGITS, 16, 16)]),
    ("forge key", 1, [*PLAIN, *KEY_NAMES], [["ghp_", "gho_", "ghs_"], (ALNUM, 36, 36)]),
    ("service key", 1, [*PLAIN, *KEY_NAMES], [["sk_live_", "sk-", "xoxb-"], (ALNUM, 20, 48)]),
    ("key block", 1, PLAIN, [["-----BEGIN RSA PRIVATE KEY-----\n", "-----BEGIN PRIVATE KEY-----\n"], (ALNUM + "+/", 64, 64), ["\n"], (ALNUM + "+/", 64, 64), ["\n-----END RSA PRIVATE KEY-----"]]),
    ("key header", 1, PLAIN, [["-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN EC PRIVATE KEY-----"]]),
    ("checksum", 0, SUM_NAMES, [(HEX, 32, 64)]),
    ("uuid", 0, [*SUM_NAMES, *OTHER_NAMES], [(HEX, 8, 8), ["-"], (HEX, 4, 4), ["-4"], (HEX, 3, 3), ["-a"], (HEX, 3, 3), ["-"], (HEX, 12, 12)]),
    ("number", 0, [*PLAIN, "card ", "order ", "tel ", "invoice: ", "account ", "of "], [(DIGITS, 16, 20)]),
    ("link", 0, ["https://www.site.org/", "http://data.net/a/", "/usr/share/", "see /home/"], [WORDS, ["-", "/", "_"], WORDS, ["-20", "/20", "_19"], (DIGITS, 2, 2), ["-", "/"], WORDS]),
    ("identifier", 0, [*PLAIN, *OTHER_NAMES], [WORDS, ["_", "-"], WORDS, ["_", "-"], WORDS, ["_", "-", ""], (DIGITS, 1, 4)]),
    ("state", 0, [*PASSWORD_NAMES[:4], *KEY_NAMES[:3], "token: ", "secret: ", "auth = "], [STATES]),
    ("image data", 0, ["data:image/png;base64,", "src="], [["iVBORw0KGgo"], (ALNUM + "+/", 60, 160)]),
    ("other value", 0, OTHER_NAMES, [(ALNUM, 16, 32)]),
    ("plain run", 0, PLAIN[:4], [(ALNUM, 16, 40)]),
]


def planted(docs: DataFrame, text_col: str = "text", each: int = 8, forms: list | None = None) -> DataFrame:
    """form, label, finding: ``each`` planted values a text, of a form and at a place that a hash of the text decides.

    A value stands between words of the text; candidates that overlap it are the findings. Values that are no candidate give none.
    """
    forms = FORMS if forms is None else forms
    docs = docs.select(F.coalesce(text_col, F.lit("")).alias("text"), F.explode(F.sequence(F.lit(1), F.lit(each))).alias("k"))
    rows = docs.withColumn("seed", F.xxhash64("text", "k"))

    def draw(n: int, *salt) -> Column:
        return F.pmod(F.xxhash64("seed", *[F.lit(x) if isinstance(x, (int, str)) else x for x in salt]), F.lit(n)).cast("int")

    def choose(options: list[str], *salt) -> Column:
        return F.get(F.array(*map(F.lit, options)), draw(len(options), *salt))

    def letters(alphabet: str, n: Column, j: int) -> Column:
        one = lambda i: F.substring(F.lit(alphabet), draw(len(alphabet), j, i) + 1, 1)
        return F.array_join(F.transform(F.sequence(F.lit(1), n), one), "")

    def value(parts: list) -> Column:
        made = []
        for j, part in enumerate(parts):
            if isinstance(part, list):
                made.append(choose(part, "part", j))
            else:
                alphabet, least, most = part
                made.append(letters(alphabet, draw(most - least + 1, "size", j) + least, j))
        return F.concat(*made)

    cases = [
        F.struct(F.lit(name).alias("form"), F.lit(label).alias("label"), choose(heads, "head").alias("head"), value(parts).alias("value"))
        for name, label, heads, parts in forms
    ]
    form = F.lit(None)
    for i, case in enumerate(cases):
        form = F.when(F.col("kind") == i, case) if i == 0 else form.when(F.col("kind") == i, case)
    rows = rows.withColumn("kind", draw(len(forms), "kind")).select("text", "seed", form.alias("f"))
    at = F.pmod("seed", F.greatest(F.length("text"), F.lit(1)).cast("bigint")).cast("int")
    rows = rows.select("f.*", F.substring("text", at + 1, F.lit(120)).alias("near"))
    before = F.regexp_extract("near", r"^\S*\s([\s\S]{0,48}\s)", 1)
    after = F.regexp_extract("near", r"(\s[\s\S]{0,48})$", 1)
    quote = F.when(F.endswith("head", F.lit('"')), '"').otherwise("")
    start = F.length(before) + F.length("head")
    rows = rows.select("form", "label", "value", start.alias("at"), F.concat(before, "head", "value", quote, after).alias("text"))
    found = rows.select("form", "label", "value", "at", F.explode(findings(F.col("text"))).alias("finding"))
    start, end = F.col("finding.start"), F.col("finding.start") + F.length("finding.text")
    return found.where((end > F.col("at")) & (start < F.col("at") + F.length("value"))).select("form", "label", "finding")


def labelled_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 12_000) -> DataFrame:
    """form, label, finding: planted values in about ``sample`` texts, chosen by the hash of their id."""
    share = max(1, docs.count() // sample)
    chosen = docs.where(F.pmod(F.xxhash64(F.col(id_col).cast("bigint")), F.lit(share)) == 0)
    return planted(chosen, text_col)


def judged(text: Column, forest: list[Tree]) -> Column:
    """Array of findings with their score (0 to 1); null where there is none."""
    return F.transform(
        findings(text),
        lambda f: F.struct(
            f["start"].alias("start"), F.length(f["text"]).alias("length"), f["text"].alias("text"),
            forest_score(forest, f).alias("score"), f["gap"].alias("gap"),
        ),
    )


def scan_secrets(
    docs: DataFrame, forest: list[Tree], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5
) -> DataFrame:
    """doc_id, start, length, text, score, is_secret: one row per candidate."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.explode(judged(F.col(text_col), forest)).alias("f"))
    return rows.select("doc_id", "f.start", "f.length", "f.text", "f.score", (F.col("f.score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, forest: list[Tree], text_col: str = "text", threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """The input's columns, with every confirmed secret in the text replaced by ``mark``."""
    found = "found"
    while found in docs.columns:
        found += "_"
    rows = compute_once(docs, found, judged(F.col(text_col), forest))
    text, secret = F.col(text_col), lambda f: f["score"] >= threshold
    parts = F.transform(found, lambda f: F.concat(f["gap"], F.when(secret(f), mark).otherwise(f["text"])))
    last = F.element_at(found, -1)
    cleaned = F.concat(F.array_join(parts, ""), F.substring(text, last["start"] + last["length"] + 1, F.length(text)))
    return rows.withColumn(text_col, F.when(F.exists(found, secret), cleaned).otherwise(text)).drop(found)
