"""Personal data, conversation trie and spelling variants against plain Python, and on awkward rows."""

from __future__ import annotations

import collections
import hashlib
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from corpuseval.llm import conversation_trie as trie
from corpuseval.llm import personal_data, spelling
from corpuseval.llm.conversation_trie import NO_ENDS, TernaryTree, conversation_trie
from corpuseval.llm.spans import placed_matches

SF = "/root/testdata/sf0.001"

# ---- personal data

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, text):
    digits = [int(c) for c in text if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def base_of(text):
    found = [
        (m.start(), rank, kind, m.end())
        for rank, (kind, form) in enumerate(FORMS.items())
        for m in re.finditer(form, text or "")
        if passes(kind, m[0])
    ]
    return sorted(found)


def written(spans):
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)


def expected_personal(i, text):
    spans = base_of(text)
    n = collections.Counter(s[2] for s in spans)
    return (i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(written(spans).encode()).hexdigest())


ODD = [
    "a@b.c_d@e.f x a@b.c.d%e@f-g.h, 1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.255 1.2.3 +1 (017) 555-7713. +12345678901234567",
    "4111 1111 1111 1111 4111-1111-1111-1111 5  41111111111111111111", "a" * 30_000, "1" * 30_000, "a." * 10_000 + "@",
    "x@" + "a." * 10_000 + "a", "+1 " * 2000 + "(555) 555-5555 " * 500, None, "", "1.1.1.1 " * 3000, "é\U0001f600 a@b.co \U0001f600 1.2.3.4",
    "+1" + " " * 10_000, "1-" * 10_000, "@" * 1000, "a@b..c", "+(1", "a@b.c@d.e", "+1 4111111111111111 4111111111111111",
]


def test_base_spans_against_python(spark):
    rows = [(i if i else None, t, "x", 1) for i, t in enumerate(ODD)] + [(5, ODD[0], "x", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string, row int")
    got = personal_data.find_personal_data(docs)
    assert got.columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    found = got.collect()
    assert collections.Counter(tuple(r)[:6] for r in found) == collections.Counter(expected_personal(r[0], r[1]) for r in rows)
    assert all(hashlib.sha256(r.spans.encode()).hexdigest() == r.base_sha256 for r in found if r.n_found == 0)


def test_base_spans_of_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = [tuple(r)[:6] for r in personal_data.find_personal_data(docs).collect()]
    assert sorted(got) == sorted(expected_personal(r.doc_id, r.text) for r in docs.collect())


def test_personal_data_of_no_documents(spark):
    assert personal_data.find_personal_data(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="1a@.+ -()9", max_size=40), min_size=20, max_size=60))
def test_base_spans_of_random_texts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = docs.select("doc_id", personal_data.base_spans(F.col("text")).alias("s")).collect()
    for r in got:
        assert [(s.start, s.rank, s.kind, s.end) for s in r.s] == base_of(texts[r.doc_id])


def planted(rng):
    words = "the of and thion ander whst ingea lost reth ount".split()
    fill = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = []
    for i in range(60):
        texts.append(f"{fill(8)} call mobile: +1 ({rng.randrange(100, 999)}) 555-{1000 + i} {fill(6)}")
        texts.append(f"{fill(8)} write to mail: user.{i}@mail{i % 9}.example.com {fill(6)}")
    phones = [f"{fill(5)} call mobile: {rng.randrange(200, 999)}-555-{2000 + i} {fill(3)}" for i in range(5)]
    mails = [f"{fill(5)} write to mail: joe.{i} (at) example (dot) org {fill(3)}" for i in range(5)]
    plain = [f"{fill(5)} the build 2020-11-1{i} {fill(3)}" for i in range(5)]
    return texts, phones, mails, plain


def test_patterns_discover_other_notations(spark):
    texts, phones, mails, plain = planted(random.Random(3))
    rows = list(enumerate(texts + phones + mails + plain))
    found = {r.doc_id: r for r in personal_data.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    cut = lambda i: [(s.split(":")[0], rows[i][1][int(s.split(":")[1]) : int(s.split(":")[2])]) for s in found[i].spans.split(",") if s]
    n = len(texts)
    assert all(cut(n + k) == [("phone", re.search(r"\d{3}-555-\d{4}", phones[k])[0])] for k in range(5))
    assert all(cut(n + 5 + k) == [("email", f"joe.{k} (at) example (dot) org")] for k in range(5))
    assert all(cut(n + 10 + k) == [] for k in range(5)) and all(found[i].n_found == 0 for i in range(n))


def confidences(occurrences, rounds=3, seeds=5):
    """The pattern-instance graph in plain Python; occurrences are (text, kind or None, patterns, allowed kinds)."""
    edges = {(p, t, k) for t, k, ps, _ in occurrences for p in ps}
    allowed = {t: a for t, k, _, a in occurrences if k is None}
    known = collections.Counter((p, k) for p, _, k in edges if k)
    everything = collections.Counter()
    for (p, _), n in known.items():
        everything[p] += n
    record = {key: n for key, n in known.items() if n >= seeds}
    open_edges = [(p, t, k) for p, t, none in edges if none is None for k in allowed[t] if (p, k) in record]
    score, conf = collections.defaultdict(float), {}
    for _ in range(rounds):
        for (p, k), n in record.items():
            mine = [score[t, k] for q, t, j in open_edges if (q, j) == (p, k)]
            conf[p, k] = (n + sum(mine)) / (everything[p] + sum(max(s, 0.25) for s in mine) + 2)
        doubt = collections.defaultdict(lambda: 1.0)
        for p, t, k in open_edges:
            doubt[t, k] *= 1 - conf[p, k]
        score = collections.defaultdict(float, {key: 1 - d for key, d in doubt.items()})
    return conf


def test_pattern_scores_against_python(spark):
    texts, phones, mails, plain = planted(random.Random(4))
    mixed = [f"call mobile: {t.split(': ')[1]}" for t in mails[:3]] + [f"write to mail: +1 (222) 555-{3000 + i} the" for i in range(7)]
    docs = spark.createDataFrame(list(enumerate(texts + phones + mails + plain + mixed)), "doc_id bigint, text string")
    rows = docs.select(
        F.col("doc_id").alias("row"), personal_data.base_spans(F.col("text")).cast(personal_data.SPAN).alias("base"),
        personal_data.loose_spans(F.col("text")).cast(personal_data.SPAN).alias("loose"),
    )
    found = personal_data.occurrences(rows)
    plain_rows = found.select("text", "kind", "patterns", personal_data.allowed_kinds(F.col("text")).alias("a")).collect()
    want = confidences([tuple(r) for r in plain_rows])
    got = {(r.pattern, r.kind): r.confidence for r in personal_data.learn_patterns(found).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_places_of_matches(spark):
    text = "ab1cd22 é\U0001f600333" * 700
    got = spark.range(1).select(placed_matches(F.lit(text), "[0-9]+", 3).alias("m")).first().m
    assert [(m.start, m.text) for m in got] == [(m.start(), m[0]) for m in re.finditer("[0-9]+", text)]
    assert got[0].before == "ab" and got[0].after == "cd" and got[-1].after == ""
    assert spark.range(1).select(placed_matches(F.lit(None).cast("string"), "a", 3).alias("m")).first().m == []


# ---- conversations


def trie_of(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(role, text) for _, _, role, text in sorted(t)] for c, t in convs.items()}
    built = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 6, c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members, below = collections.defaultdict(list), collections.defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                below[turns[: d - 1]].add(turns[:d])
    leaves, saved, out = {}, {}, []
    for path in sorted(members, key=len, reverse=True):
        n = len(members[path])
        leaves[path] = sum(leaves[p] for p in below[path]) or 1
        saved[path] = sum(saved[p] for p in below[path]) + ((n - 1) * len(path[-1][1]) if path else 0)
        ends = ",".join(map(str, sorted(c for c in members[path] if built[c] == path)))
        parent = min(members[path[:-1]]) if path else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(members[path]), len(path), parent, n, len(below[path]), leaves[path], saved[path], digest))
    return sorted(out)


CONV = "conv_id bigint, turn int, role string, text string, path string, shard int, n int"


def conversations(rng):
    rows = []
    for c in [*range(-150, 320, 7), *range(400, 460), 1000]:
        hot = c % 3 == 0
        for t in range(8 if hot else rng.randrange(0, 9)):
            rows.append((c, t, "user", f"hot {t}" if hot else f"{rng.randrange(3)} é{'x' * rng.randrange(3)}"))
    rows += [(5000, t, "a", f"deep {t}") for t in range(900)] + [(5001, 0, None, None), (5001, None, "r", "first"), (5001, 0, "b", "tie")]
    rows += [(5002, 1, "u", "same"), (5002, 1, "u", "same"), (None, 1, "u", "lost"), (5003, 0, "only", "one")]
    return [(*r, "p", 1, 2) for r in rows]


@pytest.mark.parametrize("shard_turns", [40, 250_000])
def test_trie_against_python(spark, shard_turns):
    rows = conversations(random.Random(1))
    frame = spark.createDataFrame(rows, CONV).repartition(5)
    got = sorted((tuple(r) for r in conversation_trie(frame, shard_turns).collect()), key=lambda r: (r[0], r[1]))
    assert got == trie_of([r[:4] for r in rows])


def test_trie_with_shuffled_lookups(spark, no_broadcast):
    rows = conversations(random.Random(2))
    got = sorted((tuple(r) for r in conversation_trie(spark.createDataFrame(rows, CONV), 100).collect()), key=lambda r: (r[0], r[1]))
    assert got == trie_of([r[:4] for r in rows])


def test_trie_of_nothing_and_of_turnless(spark):
    assert conversation_trie(spark.createDataFrame([], CONV)).count() == 0
    one = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    got = conversation_trie(spark.createDataFrame([(one, 0, "u", "t", "p", 1, 2)], CONV)).collect()
    assert [tuple(r) for r in got] == [(one, 0, None, 1, 0, 1, 0, hashlib.sha256(str(one).encode()).hexdigest())]
    assert NO_ENDS == hashlib.sha256(b"").hexdigest()


@pytest.fixture
def small_results(spark):
    """Tasks may send 4 MB to the driver in all."""
    conf = spark.sparkContext._jsc.sc().conf()
    conf.set("spark.driver.maxResultSize", "4m")
    yield
    conf.remove("spark.driver.maxResultSize")


@pytest.mark.parametrize("turn", [0, None])
def test_trie_of_long_texts(spark, small_results, turn):
    """200 texts of 102,400 characters, two to a conversation; with equal numbers they go by their text."""
    numbers = spark.range(200, numPartitions=4).select(
        F.expr("CASE WHEN id < 100 THEN 700 ELSE 700 + id DIV 2 END").alias("conv_id"),
        (F.lit(turn) if turn is None else F.col("id")).cast("int").alias("turn"), F.lit("u").alias("role"),
        F.repeat(F.sha2(F.col("id").cast("string"), 256), 1600).alias("text"),
    )
    rows = [
        (700 if i < 100 else 700 + i // 2, turn if turn is None else i, "u", hashlib.sha256(str(i).encode()).hexdigest() * 1600)
        for i in range(200)
    ]
    got = sorted((tuple(r) for r in conversation_trie(numbers).collect()), key=lambda r: (r[0], r[1]))
    assert got == trie_of(rows)


@pytest.mark.parametrize("shard_turns", [40, 250_000])
def test_trie_of_ties_by_long_prefixes(spark, shard_turns):
    rng, rows = random.Random(3), []
    starts = ["", "a", "a" * 63, "a" * 64, "a" * 65, "a" * 64 + "b", "é" * 64, "é" * 64 + "\U0001f600", "é" * 64 + "\uffff", "z"]
    for c in [*range(100, 180), 900, 901]:
        for _ in range(rng.randrange(1, 9)):
            role, text = rng.choice(starts), rng.choice(starts) + rng.choice(["", "x", "y"])
            rows.append((c, rng.choice([None, None, 0, 1, 2]), rng.choice([role, None]), rng.choice([text, None]), "p", 1, 2))
    got = conversation_trie(spark.createDataFrame(rows, CONV).repartition(5), shard_turns)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0], r[1])) == trie_of([r[:4] for r in rows])


def test_trie_of_long_conversations(spark, small_results):
    """60 conversations of 10,000 turns, the first 20 the same; all their ids are 4.8 MB."""
    numbers = spark.range(600_000, numPartitions=4).selectExpr(
        "id DIV 10000 * 100 AS conv_id", "id % 10000 AS turn", "'u' AS role",
        "CASE WHEN id % 10000 < 20 THEN concat('t', id % 10000) ELSE string(id) END AS text",
    )
    total = conversation_trie(numbers).agg(*[F.sum(x) for x in (F.lit(1), "depth", "n_convs", "n_leaves", "n_children")])
    own = 60 * 9980
    assert tuple(total.first()) == (21 + own, sum(range(21)) + 60 * sum(range(21, 10001)), 21 * 60 + own, 21 * 60 + own, 20 + own)


def test_trie_dealt_by_few_leading_ids(spark, monkeypatch):
    monkeypatch.setattr(trie, "RANGE_IDS", 1)
    rows = conversations(random.Random(4))
    frame = spark.createDataFrame(rows, CONV).repartition(5)
    got = sorted((tuple(r) for r in conversation_trie(frame, 60).collect()), key=lambda r: (r[0], r[1]))
    assert got == trie_of([r[:4] for r in rows])


def test_shard_in_a_fresh_worker():
    """A shard may be the first work of a Python process, where nothing else has loaded Arrow's submodules."""
    rows = {"ids": [[1, 2], [1]], "lengths": [[5, 6], [5]], "n": [1, 2], "least": [7, 3], "ends": ["b", "a"], "place": [1, 0]}
    table = pa.table(rows | {"before": [-1, -1], "after": [-1, -1]})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    code = (
        "import sys, pyarrow as pa\nfrom corpuseval.llm.conversation_trie import shard_nodes\n"
        "for row in sorted(map(str, shard_nodes(pa.ipc.open_stream(sys.stdin.buffer.read()).read_all())['ends_sha256'].to_pylist())): print(row)"
    )
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    run = subprocess.run([sys.executable, "-c", code], input=sink.getvalue().to_pybytes(), capture_output=True, cwd=top, check=False)
    assert run.returncode == 0, run.stderr.decode()
    assert run.stdout.split() == [b"None", b"a", b"b"]


def test_trie_is_balanced():
    tree = TernaryTree()
    tree.plant([[i] for i in range(1000)], [[1]] * 1000)
    depth, deepest, stack = 0, 0, [(tree.equal[0], 1)]
    while stack:
        at, depth = stack.pop()
        deepest = max(deepest, depth)
        stack += [(x, depth + 1) for x in (tree.lower[at], tree.higher[at]) if x]
    assert deepest == 10


# ---- spelling


def variants_of(rows):
    lower = str.maketrans(spelling.UPPER, spelling.LOWER)
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 6:
                n[word] += 1
    n = {w: c for w, c in n.items() if c >= 5}
    near, holes = collections.defaultdict(set), collections.defaultdict(list)
    for w in n:
        for k in range(len(w)):
            holes[w[:k], w[k + 1 :]].append(w)
            if (v := w[:k] + w[k + 1 :]) in n:
                near[w].add(v)
                near[v].add(w)
    for same in holes.values():
        for w in same:
            near[w] |= set(same) - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 5 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, n[w], len(near[w]), form.get(w), n.get(form.get(w)), root))
    return sorted(out)


DOCS = "doc_id bigint, text string, word string, n bigint, cell int"


@pytest.mark.parametrize(("cells", "sample"), [(20_000, 40_000), (40, 300)])
def test_variants_against_python(spark, cells, sample):
    rng = random.Random(7)
    stock = ["".join(rng.choice("abeé") for _ in range(rng.randrange(5, 9))) for _ in range(400)]
    stock += ["Ünïcode×x", "ABCDEFG", "abcdefgh", "z" * 400, "z" * 401, "y" * 300 + "z", "abcdef" * 9, "abcdef" * 8 + "abcdefg"]
    rows = [(i if i % 9 else None, " ".join(rng.choice(stock) for _ in range(200))) for i in range(60)]
    rows += [(7, "abcdef " * 5000), (8, None), (9, ""), (10, "one two"), (7, rows[0][1])]
    frame = spark.createDataFrame([(*r, "w", 1, 2) for r in rows], DOCS)
    got = sorted(tuple(r) for r in spelling.spelling_variants(frame, cell_words=cells, sample=sample).collect())
    assert got == variants_of(rows) and any(r[3] for r in got)


def test_variants_of_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(tuple(r) for r in spelling.spelling_variants(docs, cell_words=50, sample=200).collect())
    assert got == variants_of([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_variants_of_no_documents(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], DOCS)).count() == 0


def test_roots_follow_long_chains(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(13)], "word string, form string")
    assert {r.root for r in spelling.follow(forms).collect()} == {"w13"}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="abé", min_size=6, max_size=6), min_size=30, max_size=120), st.integers(1, 2))
def test_range_search_is_whole(words, radius):
    points = spelling.letter_counts(spelling.letter_matrix(words, 6))
    distance = np.abs(points[:, None].astype(int) - points[None]).sum(axis=2)
    for tight in (True, False):
        tree = spelling.KdTree(points, 4, tight)
        seen = {(int(p), int(m)) for p, leaf in zip(*tree.visit(points, radius), strict=True) for m in tree.members[leaf]}
        assert {(int(a), int(b)) for a, b in zip(*np.nonzero(distance <= radius), strict=True)} <= seen
    assert all(k in tree.members[leaf] for k, leaf in enumerate(tree.home(points)))
