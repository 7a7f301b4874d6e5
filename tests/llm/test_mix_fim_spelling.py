"""Spelling variants, source mixing and fill-in-middle against brute force, on small tables with every odd case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from churnlens.llm import catalog, seekable_fim, source_mix, spelling_groups
from churnlens.llm import sql as llm_sql
from tests.harness import compare

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
# columns whose names the operators use inside
SCHEMA = ("doc_id long, text string, lang string, source string, word string, n long, sig long, size long, key double, taken long, "
          "target double, weight long, frames binary, output binary, doc string, docs long, lo double, rank long, _part int")
WIDTH = 19


def row(doc_id, text, source="a"):
    return (doc_id, text, "en", source, *([None] * (WIDTH - 4)))


@pytest.fixture(scope="module")
def odd(spark):
    catalog.ready(spark)
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdeéÀ") for _ in range(rng.randint(6, 11))) for _ in range(25)]
    text = lambda n: "".join(rng.choice(stems) + rng.choice([" ", "\n", "\t ", ", ", "-"]) for _ in range(n))
    texts = [None, "", " \t\n ", "one", "Straße ÀÉÎ×÷ naïvement", text(3000), "x" * 70_000, "ab " * 900, "  lead and trail  ",
             "has <P> inside", "half <S", "S> half", text(40), "日本 " * 50, "\x1c\x1dq\x85 r", "Abcdefgh " * 30, "  wide spaces "]
    texts += [text(rng.randint(1, 120)) for _ in range(60)]
    rows = [row(i * 7, t, rng.choice(["a", "b", "é", "Z", "", None, "c"])) for i, t in enumerate(texts)]
    rows += [row(None, text(50)), row(None, None, None), rows[5], rows[5], rows[20], row(9000, text(30), "alone"), row(9001, "", "void"), row(9002, None, "void")]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    catalog.ready(spark)
    return spark.createDataFrame([], SCHEMA)


# -- spelling ----------------------------------------------------------------------

def lower(run):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in run)


def expected_vocabulary(rows, min_chars, min_count):
    seen = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= min_chars:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= min_count}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def expected_groups(vocab):
    near = {w: [v for v in vocab if one_edit(w, v)] for w in vocab}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-vocab[v], v), default=None)
        form[w] = best if best is not None and vocab[best] >= 10 * vocab[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, n, len(near[w]), form[w] or "", vocab[form[w]] if form[w] else -1, root(w)) for w, n in vocab.items())


def spelled(df):
    return sorted((r["word"], r["n"], r["n_near"], r["form"] or "", -1 if r["form_n"] is None else r["form_n"], r["root"]) for r in df.collect())


def test_vocabulary(odd):
    rows, df = odd
    for least in (1, 2):
        got = {r["word"]: r["n"] for r in spelling_groups.vocabulary(df, 7, least).collect()}
        assert got == expected_vocabulary(rows, 7, least)


@pytest.mark.parametrize("group", [1024, 2])
def test_spelling_groups(spark, odd, group):
    """With GROUP 2 nearly every pair is found in the second deal of hot signatures."""
    rows, df = odd
    rng = random.Random(group)
    words = {}
    for _ in range(40):
        w = "".join(rng.choice("abcdé") for _ in range(rng.choice([7, 8, 9, 17, 18])))
        words[w] = rng.choice([2, 30, 400])
        for _ in range(6):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            words.setdefault(w[:at] + ("" if kind == 0 else rng.choice("abcdé")) + w[at + (kind != 1):], rng.choice([2, 3, 25]))
    words |= {"q" * 7: 1000, "q" * 8: 50, "q" * 9: 2, "a" * 5000: 3, "a" * 4999 + "b": 40, "abcdefg": 5, "gfedcba": 70}
    vocab = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    assert spelled(spelling_groups.spelling_groups(vocab, group=group)) == expected_groups(words)
    whole = expected_vocabulary(rows, 7, 2)
    assert spelled(spelling_groups.spelling_groups(spelling_groups.vocabulary(df), group=group)) == expected_groups(whole)


def test_roots_follow_forms(spark):
    chain = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "abcdefghijk": 20000, "abcdefghijkl": 200000}
    df = spark.createDataFrame(list(chain.items()), "word string, n long")
    out = spelling_groups.spelling_groups(df).collect()
    assert {r["root"] for r in out} == {"abcdefghijkl"}


def test_signatures_lose_no_pair_and_hot_groups_are_split(spark):
    """Words with the same letters but for one: one signature holds them all."""
    words = ["abcdefg" + c + d for c in "hijklmnopqrstuvwxyz" for d in "hijklmnopqrstuvwxyz"]
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    out = spelling_groups.near_words(df, group=50)
    got = {(r["word"], r["other"]) for r in out.collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}
    assert out.count() == len(got)


# -- mixing ------------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected_targets(sizes, weights=(1, 2, 3)):
    """The limit rule as it is told: share, stop at three times, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        rest = total - sum(3 * sizes[s] for s in full)
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in full else share[s] for s in names}
        full |= over


def test_mix(odd, monkeypatch):
    rows, df = odd
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = expected_targets(sizes)
    runs = []
    for few, parts in ((20_000, 5), (3, 2)):
        monkeypatch.setattr(source_mix, "RANGE_DOCS", few)
        monkeypatch.setattr(source_mix, "BINS", 4 if few == 3 else 4096)
        out = source_mix.mix(df.repartition(parts)).rows.select("doc.doc_id", "doc.source", "size", "source_size", "target", "taken")
        runs.append(sorted(map(tuple, out.collect()), key=str))
    assert runs[0] == runs[1]                     # whatever the ranges and partitions
    got = runs[0]
    assert Counter((r[0], r[1], r[2]) for r in got) == Counter((r[0], r[3], len(WORD.findall(r[1] or ""))) for r in rows)
    taken, largest = Counter(), Counter()
    for _, source, size, source_size, target, words in got:
        assert source_size == sizes[source] and math.isclose(target, want[source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= words <= 3 * size
        whole = 0 if not source_size else int(target / source_size + 1e-9)
        assert whole * size <= words <= (whole + 1) * size     # complete epochs come first
        taken[source] += words
    for source in sizes:
        assert abs(taken[source] - want[source]) <= 3          # equal rows share what is left by whole words


def test_targets_reach_the_cap_again_and_again(spark):
    sizes = {"a": 10, "b": 1000, "c": 1, "d": 50, "e": 3, "f": 7, "g": 0, None: 40}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_mix.targets(df).collect()}
    want = expected_targets(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "RANGE_DOCS", 50)          # several parts of running totals
    rng = random.Random(1)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 1000]) for i in range(400)} | {None: 9}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_mix.targets(df).collect()}
    want = expected_targets(sizes)
    assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)


def test_heavier_documents_are_taken_more_often(spark):
    catalog.ready(spark)
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"),
                                    F.when(F.col("id") % 4 < 2, F.lit(3.0)).otherwise(F.lit(1.0)).alias("q"))
    out = source_mix.mix(docs, quality=F.col("q"), keep=["q"]).rows
    got = {r["q"]: r["t"] for r in out.filter("target < source_size").groupBy("doc.q").agg(F.sum("taken").alias("t")).collect()}
    assert got[3.0] > 1.4 * got[1.0]               # two thirds of a source; sampling without replacement


def test_mixed_texts(odd):
    _, df = odd
    mixed = source_mix.mix(df)
    out = source_mix.mixed_texts(mixed)
    got = Counter()
    for r in out.select("doc_id", "source", "epoch", "words", "text").collect():
        assert len(WORD.findall(r["text"])) == r["words"]
        got[r["doc_id"], r["source"]] += r["words"]
    want = Counter()
    for r in mixed.rows.select("doc.doc_id", "doc.source", "taken").collect():
        want[r["doc_id"], r["source"]] += r["taken"]
    assert +got == +want


# -- fill-in-middle ----------------------------------------------------------------

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def expected_fim(doc_id, text):
    text = text or ""
    u = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i: 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(u), "plain", None, None, text
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h4 % 100 < 80:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 16])
def test_fill_in_middle(odd, size):
    rows, df = odd
    if size == 1:                                   # a frame a byte: short texts only
        df, rows = df.filter("text IS NULL OR length(text) < 400"), [r for r in rows if len(r[1] or "") < 400]
    out = seekable_fim.fill_in_middle(seekable_fim.seekable(df, size=size))
    got = sorted(map(tuple, out.drop("output", "output_ends").collect()), key=str)
    want = []
    for r in rows:
        n, form, prefix, middle, output = expected_fim(r[0], r[1])
        want.append((None if r[0] is None else str(r[0]), n, form, prefix, middle, sha(output), sha(r[1] or "")))
    assert got == sorted(want, key=str)
    forms = Counter(x[2] for x in want)
    assert size == 1 or len(forms) == 3
    texts = sorted((r["doc_id"] or "", r["output"], r["restored"]) for r in seekable_fim.texts(out).collect())
    assert texts == sorted(("" if r[0] is None else str(r[0]), expected_fim(r[0], r[1])[4], r[1] or "") for r in rows)


def test_cuts_read_only_their_frames(monkeypatch):
    import zstandard
    text = ("some words stand here " * 20_000).encode()
    reads = []
    plain = seekable_fim.Store.read
    monkeypatch.setattr(seekable_fim.Store, "read", lambda self, f: reads.append(f) or plain(self, f))
    frames, frame_ends, byte_ends, char_ends, units, _ = seekable_fim.store_text(text, zstandard.ZstdCompressor(level=1), 1 << 12)
    store = seekable_fim.Store(frames, frame_ends, byte_ends, char_ends, units, zstandard.ZstdDecompressor())
    assert len(store) > 50
    f, at, chars = store.place(40_000)
    assert (byte_ends[f - 1] + at, chars) == (len(" ".join(["some", "words", "stand", "here"] * 10_000)),) * 2
    assert reads == [f]


def test_seeking_very_long_texts(spark):
    catalog.ready(spark)
    texts = [("word " * 1_200_000), "x" * 5_000_000, "é\n" * 700_000]
    rows = [(i, t) for i, t in enumerate(texts * 3)]
    out = seekable_fim.fill_in_middle(seekable_fim.seekable(spark.createDataFrame(rows, "doc_id long, text string")), outputs=False)
    for r in out.collect():
        n, form, prefix, middle, output = expected_fim(int(r["doc_id"]), rows[int(r["doc_id"])][1])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"]) == (n, form, prefix, middle, sha(output))


# -- queries -----------------------------------------------------------------------

def test_empty_tables(spark, empty):
    assert spelling_groups.spelling_groups(spelling_groups.vocabulary(empty)).count() == 0
    assert source_mix.mix(empty).rows.count() == 0
    assert seekable_fim.fill_in_middle(seekable_fim.seekable(empty)).count() == 0


@pytest.mark.parametrize("name", ["op11_spelling_groups", "op13_seekable_fim"])
def test_sql_oracles(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF01}/documents.parquet'")
    assert compare(catalog.queries()[name](spark, SF01), con, llm_sql.oracle_sql()[name]) is None


def test_mix_query(spark):
    out = catalog.op12_source_mix(spark, SF001).collect()
    again = catalog.op12_source_mix(spark, SF001).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again)) and len(out) == 200
    assert set(out[0].asDict()) == {"doc_id", "size", "source_size", "target", "taken"}
