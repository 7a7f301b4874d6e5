"""The ten training-data operators against brute force, on small tables with every odd case."""

import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from churnlens.llm import (bpe_index, catalog, chunks, kneser_ney, line_crf, patience_lines, simhash_groups, string_kernel,
                           substring_bwt, substring_sketch, template_windows, token_lengths)
from churnlens.llm import sql as llm_sql

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, chunk string, part string, fp string, keys string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sample_rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "naïve", "日本", "it's", "3,5", "x<y", "#tag"]
    make = lambda n: " ".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "\t", ""]) for _ in range(n))
    shared = make(200)
    texts = [None, "", " \t\n ", "one", "one two three", make(40), make(400), shared, shared, shared + make(90), make(90) + shared + make(5),
             "ab " * 900, "ab " * 900, "ab " * 450 + "cd", make(9000), "ÀÉ " + shared.upper(), "<|endoftext|> a <|endoftext|>", "x" * 1500, "\x1c\x1dq\x85 r"]
    texts += [shared[:700] + str(i) + shared[700:] for i in range(30)]
    rows = [(i * 3, t, "en" if i % 2 else None, "c", None, "f", "k", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, shared, "en", None, None, None, None, 0), (None, None, None, None, None, None, None, None), rows[7], rows[7], rows[5]]
    return rows


@pytest.fixture(scope="module")
def small(spark):
    catalog.ready(spark)
    return spark.createDataFrame(sample_rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    catalog.ready(spark)
    return spark.createDataFrame([], SCHEMA)


def table(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def late(i):
    return (i is None, i or 0)


# -- 6, 10 ------------------------------------------------------------------

def expected_windows(rows, k):
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for j in range(len(w) - k + 1):
            key = tuple(w[j:j + k])
            first[key] = min(first.get(key, late(i)), late(i))
    out = []
    for i, t, *_ in rows:
        w = words(t)
        gone = set()
        for j in range(len(w) - k + 1):
            if first[tuple(w[j:j + k])] < late(i):
                gone |= set(range(j, j + k))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_substring_sketch(small, depth):
    got = table(substring_sketch.remove_repeated_windows(small, depth=depth), "doc_id", "n_words", "n_removed", "kept_text")
    assert got == expected_windows(sample_rows(), 13)


def test_substring_sketch_keeps_exact_under_collisions(small, monkeypatch):
    monkeypatch.setattr(substring_sketch, "CELLS_PER_WORD", 1e-9)  # the fewest cells: nearly everything is estimated repeated
    got = table(substring_sketch.remove_repeated_windows(small, window=5), "doc_id", "n_words", "n_removed", "kept_text")
    assert got == expected_windows(sample_rows(), 5)


def expected_bytes(rows, length):
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    count = Counter(b[j:j + length] for _, b in data for j in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if count[b[j:j + length]] > 1:
                gone[j:j + length] = b"\1" * length
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def test_held_ranges_follow_the_keys():
    rng = np.random.default_rng(1)
    for bits, n in ((64, 1), (64, 7), (64, 2 ** 31 + 5), (20, 3), (20, 4096), (33, 1_000_003)):
        keys = np.unique(rng.integers(0, 2 ** bits - 1, 500, dtype=np.uint64, endpoint=True))
        spans = chunks.held(keys, bits, n)
        assert [x for _, lo, hi in spans for x in keys[lo:hi].tolist()] == keys.tolist()
        assert all(int(k) * n >> bits == r for r, lo, hi in spans for k in keys[lo:hi])
    assert chunks.held(keys[:0], 64, 9) == [] and len(chunks.held(keys, 64, 2 ** 31)) <= len(keys)


@pytest.mark.parametrize("hot", [1, 4096])
def test_substring_bwt(small, monkeypatch, hot):
    monkeypatch.setattr(substring_bwt, "HOT_RUNS", hot)
    got = [(a, b, c, d, bytes(e)) for a, b, c, d, e in small.transform(substring_bwt.remove_repeated_bytes).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()]
    assert sorted(got, key=str) == expected_bytes(sample_rows(), 400)


@pytest.mark.parametrize("seed", range(12))
def test_merged_transforms_find_repeats(seed):
    rng = random.Random(seed)
    base = bytes(rng.choice(b"ab") for _ in range(120))
    pieces = []
    for _ in range(rng.randint(1, 9)):
        a = rng.randint(0, 30)
        x = bytearray(base[a:a + rng.randint(60, 90)])
        if rng.random() < 0.6:
            x[rng.randrange(len(x))] = 99
        pieces.append(bytes(x))
    size = np.array([len(p) for p in pieces])
    count = Counter(p[i:i + 60] for p in pieces for i in range(len(p) - 59))
    want = [i + 60 <= len(p) and count[p[i:i + 60]] > 1 for p in pieces for i in range(len(p) + 1)]
    for block, shards in ((20, 1), (20, 2), (15, 4), (60, 3), (10, 2)):
        got = substring_bwt.repeated_starts(np.frombuffer(b"".join(pieces), np.uint8), size, 60, block, shards)
        assert got.tolist() == want


# -- 8, 5 -------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_bpe_matches_library(small, tokenizer):
    got = small.transform(lambda d: bpe_index.encode_decode(d, P.path("byte_bpe_50k.json"))).collect()
    want = []
    for i, t, *_ in sample_rows():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), struct.pack(f"<{len(ids)}I", *ids), tokenizer.decode(ids, skip_special_tokens=False)))
    assert sorted(((r[0], r[1], bytes(r[2]), r[3]) for r in got), key=str) == sorted(want, key=str)


def test_bpe_on_every_kind_of_character(tokenizer):
    coder = bpe_index.Encoder(bpe_index.Vocabulary(open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()))
    texts = ["".join(chr(c) + "a" for c in range(lo, lo + 512) if not 0xD800 <= c < 0xE000) for lo in range(0, 0x3400, 512)]
    texts += ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}" for c in range(lo, lo + 4096) if not 0xD800 <= c < 0xE000) for lo in range(0, 0x110000, 4096)]
    texts += ["aaaaaaaaaaaaaaa", "  \n\n  x   y", "I'll you'Re 12ab", "😀😀 é"]
    ids, counts = coder.encode(texts)
    ends = np.cumsum(counts)
    for t, n, hi in zip(texts, counts, ends):
        assert ids[hi - n:hi].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_token_length_answers(small, tokenizer):
    histogram = token_lengths.length_histogram(small, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = {r["length"]: r for r in token_lengths.length_answers(histogram).collect()}
    tokenizer.encode_special_tokens = True
    n = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in sample_rows()]
    tokenizer.encode_special_tokens = False
    assert set(got) == set(n)
    for length, r in got.items():
        longer = [x for x in n if x >= length]
        assert (r["n_docs"], r["docs_from"], r["tokens_from"]) == (n.count(length), len(longer), sum(longer))
        assert r["truncated_tokens"] == sum(min(x, length) for x in n)
        assert r["quantile"] == pytest.approx(sum(x <= length for x in n) / len(n))


def test_limits_and_quantiles_between_lengths(spark):
    catalog.ready(spark)
    n = [0, 3, 3, 7, 100, 5000, 5000, 9001]
    histogram = spark.createDataFrame(list(Counter(n).items()), "length long, n_docs long")
    limits = [0, 1, 3, 50, 2048, 4096, 5000, 9001, 20000]
    got = {r["limit"]: r for r in token_lengths.limit_answers(histogram, limits).collect()}
    assert set(got) == set(limits)
    for limit, r in got.items():
        longer = [x for x in n if x >= limit]
        assert (r["docs_from"], r["tokens_from"], r["truncated_tokens"]) == (len(longer), sum(longer), sum(min(x, limit) for x in n))
        assert r["quantile"] == pytest.approx(sum(x <= limit for x in n) / len(n))
    got = {r["quantile"]: r["length"] for r in token_lengths.quantile_answers(histogram, [0.1, 0.3, 0.5, 0.9, 1.0]).collect()}
    assert got == {q: min(x for x in n if sum(y <= x for y in n) >= q * len(n)) for q in (0.1, 0.3, 0.5, 0.9, 1.0)}
    assert token_lengths.limit_answers(histogram.limit(0), limits).count() == 0


# -- 3 ----------------------------------------------------------------------

def brute_fingerprint(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def brute_components(prints, distance):
    parent = list(range(len(prints)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("tile", [2, 512])
def test_simhash(small, monkeypatch, tile):
    monkeypatch.setattr(simhash_groups, "TILE", tile)
    rows = sample_rows()
    prints = [brute_fingerprint(r[1], 4) for r in rows]
    group = brute_components(prints, 4)
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    want = sorted([(r[0], f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, group)], key=str)
    out = simhash_groups.near_duplicate_components(small)
    assert table(out, "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id") == want
    kept = [r["doc_id"] for r in simhash_groups.one_of_each(small).collect()]
    assert sorted(kept, key=late) == sorted(least.values(), key=late)


def test_keys_grow_with_the_fingerprints():
    assert [simhash_groups.equal_blocks(n, 4) for n in (1, 10 ** 8, 10 ** 9, 10 ** 10, 10 ** 12)] == [2, 2, 3, 4, 5]
    for equal in (2, 3, 4, 5):
        masks = simhash_groups._masks(4, equal)
        assert len(set(masks)) == len(masks) and min(m.bit_count() for m in masks) >= 64 * equal // (4 + equal) - equal
    # groups of random fingerprints stay small: N / 2 ** bits
    assert all(n / 2 ** (64 * simhash_groups.equal_blocks(n, 4) // (4 + simhash_groups.equal_blocks(n, 4))) <= 64 for n in (10 ** 7, 10 ** 9, 10 ** 10))


@pytest.mark.parametrize("equal", [None, 3, 4])
def test_links_of_random_fingerprints(spark, equal):
    catalog.ready(spark)
    rng = random.Random(3)
    prints = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            prints.add(x)
            for _ in range(rng.randint(1, 6)):
                x ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    edges = simhash_groups.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, equal)
    root = {r["node"]: r["root"] for r in simhash_groups.components(edges).collect()}
    group = brute_components(prints, 4)
    for i, x in enumerate(signed):
        assert root.get(x, x) == min(y for y, g in zip(signed, group) if g == group[i])


# -- 4 ----------------------------------------------------------------------

def test_quality_base_rules(small):
    got = table(kneser_ney.quality(small), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for i, t, *_ in sample_rows():
        w = words(t)
        grams = [tuple(w[j:j + 3]) for j in range(len(w) - 2)]
        count = Counter(grams)
        again = {j + d for j, g in enumerate(grams) if count[g] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again),
                     len(w) < 50 or 100 * len(again) > 50 * len(w)))
    assert got == sorted(want, key=str)


def test_kneser_ney_is_a_distribution_and_counts_are_whole(spark, small):
    models = kneser_ney.fit(small, ["en"])
    for model in models.values():
        contexts = model.context[kneser_ney.ORDER][::97]
        for c in [*contexts.tolist(), 5]:
            codes = c * kneser_ney.ALPHABET + np.arange(kneser_ney.ALPHABET)
            assert model.probability(codes).sum() == pytest.approx(1.0, abs=1e-9)
    total = Counter()
    for _, t, lang, *_ in sample_rows():
        sym = [0] * (kneser_ney.ORDER - 1) + kneser_ney.folded(np.frombuffer((t or "").encode(), np.uint8)).tolist()
        for j in range(len(sym) - kneser_ney.ORDER + 1):
            total[tuple(sym[j:j + kneser_ney.ORDER])] += 1
    assert len(models[0].grams[kneser_ney.ORDER]) == len(total)


def test_kneser_ney_tells_all_bytes_apart(spark):
    """Digits, case, marks and characters of any script have n-grams of their own (all were folded into 48 symbols)."""
    assert len(set(kneser_ney.folded(np.arange(256, dtype=np.uint8)).tolist())) == kneser_ney.ALPHABET == 256
    assert kneser_ney.folded(np.frombuffer(b" ", np.uint8)).tolist() == [0]
    catalog.ready(spark)
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("абвгдежзик") for _ in range(rng.randint(3, 7))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(120)), "ru") for i in range(60)]
    other = str.maketrans("абвгдежз", "ийклмноп")  # eight further on: the same lead byte, the same last three bits
    rows.append((100, rows[0][1].translate(other), "ru"))
    got = {r["doc_id"]: r for r in kneser_ney.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["kept"] for i in range(60))
    assert got[100]["log_perplexity"] > got[0]["log_perplexity"] + 0.3 and not got[100]["kept"]


def test_shape_ngrams_follow_from_byte_ngrams():
    """The shapes of a position's byte n-gram are the n-gram of the text's shapes; one look-up gives both models' figures."""
    texts = ["The 12 HOUSES, déjà vu!\n$$$ &&& 7", "", "ß", "the house 34 of déjà"]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in data])])
    codes = kneser_ney.ngram_codes(np.frombuffer(b"".join(data), np.uint8), offsets)
    want = []
    for b in data:
        shapes = [0] * (kneser_ney.ORDER - 1) + kneser_ney.SHAPE[kneser_ney.folded(np.frombuffer(b, np.uint8))].tolist()
        want += [sum(shapes[i + j] * kneser_ney.SHAPES ** (kneser_ney.ORDER - 1 - j) for j in range(kneser_ney.ORDER)) for i in range(len(b))]
    assert kneser_ney.shape_codes(codes).tolist() == want
    both = kneser_ney.Models(*np.unique(codes[:20], return_counts=True))
    shapes = kneser_ney.Model(*np.unique(want[:20], return_counts=True), alphabet=kneser_ney.SHAPES)
    assert np.allclose(both.logs_of(codes), np.log([both.bytes.probability(codes), shapes.probability(np.array(want))]))


def test_counts_of_many_tasks_are_added_in_rounds(spark):
    """300 tasks: a reducer adds FAN of them at a time, and the sums are those of all documents."""
    catalog.ready(spark)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["abc", "the", "of", "x9", "ZZ", "é"]) for _ in range(rng.randrange(30))), rng.choice(["en", "fr", None])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(300)
    out = kneser_ney._counts(docs, ["en", "fr"], "text", "lang")
    want: dict = {}
    for _, text, lang in rows:
        buf = np.frombuffer(text.encode(), np.uint8)
        for c in kneser_ney.ngram_codes(buf, np.array([0, len(buf)])).tolist():
            key = ({"en": 1, "fr": 2}.get(lang, 0), c)
            want[key] = want.get(key, 0) + 1
    got = {}
    for r in out.collect():
        for k, n in zip(chunks.unpack(r["width"], r["keys"]).tolist(), np.frombuffer(r["extra"], np.int64).tolist()):
            assert (r["part"] // kneser_ney._PARTS, k) not in got
            got[r["part"] // kneser_ney._PARTS, k] = n
    assert got == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 3             # 300 -> 19 -> 2 -> 1


def brute_kneser_ney(grams):
    """Modified Kneser-Ney by its formulas, on tuples of symbols: a function (context, symbol) -> probability."""
    order, size = kneser_ney.ORDER, kneser_ney.ALPHABET
    tables = {order: dict(grams)}
    for k in range(order - 1, 0, -1):
        tables[k] = {}
        for g in tables[k + 1]:
            tables[k][g[1:]] = tables[k].get(g[1:], 0) + 1
    discounts = {}
    for k, t in tables.items():
        n = [max(1, sum(1 for c in t.values() if c == i)) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        discounts[k] = [0.0] + [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.1), i - 0.1) for i in (1, 2, 3)]

    def probability(context, symbol):
        k = len(context) + 1
        lower = 1 / size if k == 1 else probability(context[1:], symbol)
        following = {g[-1]: c for g, c in tables[k].items() if g[:-1] == context}
        if not following:
            return lower
        total, d = sum(following.values()), discounts[k]
        left = sum(d[min(c, 3)] for c in following.values()) / total
        c = following.get(symbol, 0)
        return max(c - d[min(c, 3)], 0) / total + left * lower

    return probability


def test_kneser_ney_probabilities_against_the_formulas():
    rng = random.Random(9)
    size, order = kneser_ney.ALPHABET, kneser_ney.ORDER
    text = [rng.choice([0, 1, 1, 2, 3, 5, 30]) for _ in range(900)]
    grams: dict = {}
    for i in range(order - 1, len(text)):
        g = tuple(text[i - order + 1: i + 1])
        grams[g] = grams.get(g, 0) + 1
    code = lambda g: sum(s * size ** i for i, s in enumerate(reversed(g)))
    keys = sorted(grams, key=code)
    model = kneser_ney.Model(np.array([code(g) for g in keys]), np.array([grams[g] for g in keys]))
    want = brute_kneser_ney(grams)
    asked = keys[:60] + [tuple(rng.choice([0, 1, 2, 3, 4, 5, 30, 47]) for _ in range(order)) for _ in range(200)]
    got = model.probability(np.array([code(g) for g in asked]))
    assert np.allclose(got, [want(g[:-1], g[-1]) for g in asked], rtol=1e-9)
    mixed = kneser_ney.Model(np.array([code(g) for g in keys[:50]]), np.array([grams[g] for g in keys[:50]]), model)
    small = brute_kneser_ney({g: grams[g] for g in keys[:50]})
    share = kneser_ney.SHARED / (kneser_ney.SHARED + sum(grams[g] for g in keys[:50]))
    got = mixed.probability(np.array([code(g) for g in asked]))
    assert np.allclose(got, [(1 - share) * small(g[:-1], g[-1]) + share * want(g[:-1], g[-1]) for g in asked], rtol=1e-9)


def test_bands_and_verdicts_by_their_rule(spark):
    """Perplexities, medians, deviations, band and kept, from the model and the formulas."""
    catalog.ready(spark)
    rng = random.Random(12)
    words_of = {"en": ["the", "of", "and", "house", "river", "stone", "light"], "xx": ["zu", "ka", "molo", "tiri", "sato"]}
    rows = [(i, " ".join(rng.choice(words_of[lang]) + rng.choice(["", "", ".", ","]) for _ in range(rng.randint(30, 200))), lang)
            for i, lang in enumerate(rng.choice(["en", "xx"]) for _ in range(120))]
    rows += [(500 + i, "".join(rng.choice("QZX#9~") + rng.choice(["", " "]) for _ in range(600)), "en") for i in range(4)] + [(900, "", "en"), (901, None, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = kneser_ney.fit(docs, kneser_ney.languages(docs))
    names = {x: i + 1 for i, x in enumerate(kneser_ney.languages(docs))}
    logs = {}
    for i, text, lang in rows:
        buf = np.frombuffer((text or "").encode(), np.uint8)
        if len(buf):
            logs[i] = -float(np.log(models[names[lang]].probability(kneser_ney.ngram_codes(buf, np.array([0, len(buf)])))).mean())
    out = {r["doc_id"]: r for r in kneser_ney.quality(docs).collect()}
    for lang in names:
        mine = [i for i, _, x in rows if x == lang and i in logs and not out[i]["base_failed"]]
        steps = sorted(int(logs[i] * kneser_ney.STEPS) for i in mine)
        middle = steps[(len(steps) + 1) // 2 - 1]
        off = sorted(abs(s - middle) for s in steps)[(len(steps) + 1) // 2 - 1]
        for i, text, x in rows:
            if x != lang or i not in logs:
                continue
            room = kneser_ney.WIDTH * 1.4826 * (off + 0.5) / kneser_ney.STEPS + kneser_ney.SHORT / len((text or "").encode()) ** 0.5
            low, high = (middle + 0.5) / kneser_ney.STEPS - room, (middle + 0.5) / kneser_ney.STEPS + room
            r = out[i]
            assert abs(r["log_perplexity"] - logs[i]) < 1e-9 and abs(r["band_low"] - low) < 1e-9 and abs(r["band_high"] - high) < 1e-9
            assert r["kept"] == (not r["base_failed"] and low <= r["log_perplexity"] <= high)
    assert not any(out[500 + i]["kept"] for i in range(4)) and not out[900]["kept"] and not out[901]["kept"]


def test_quality_keeps_clean_and_rejects_junk(spark):
    catalog.ready(spark)
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    got = kneser_ney.quality(docs).filter("NOT base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    kept = {r["quality"]: r["k"] for r in got}
    assert kept[1] > 0.95 and kept[0] < 0.5
    stays = kneser_ney.keep_good(docs)
    assert stays.columns == docs.columns and stays.count() == kneser_ney.quality(docs).filter("kept").count()


def documents_in_languages(sizes, seed=4):
    """Invented prose: sizes has each language's documents; a language has letters and words of its own."""
    rng = random.Random(seed)
    rows = []
    for lang, n in sizes.items():
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", rng.choice([4, 9, 15]))
        vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(80)]
        rows += [(len(rows) + i, " ".join(rng.choice(vocabulary) for _ in range(90)), lang) for i in range(n)]
    return rows


def test_every_language_has_its_own_band(spark, monkeypatch):
    catalog.ready(spark)
    sizes = {"en": 60, "yy": 30, "zz": 5, "few": 1, None: 4} | {f"l{i}": 3 for i in range(40)}
    docs = spark.createDataFrame(documents_in_languages(sizes), "doc_id long, text string, lang string")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert sorted(kneser_ney.languages(docs)) == sorted(x for x in sizes if x)
    rows = {r["doc_id"]: r for r in kneser_ney.quality(docs).collect()}
    assert set(rows) == set(lang)
    middle = {}
    for i, r in rows.items():
        middle.setdefault(lang[i], set()).add(round((r["band_low"] + r["band_high"]) / 2, 6))
    assert all(len(x) == 1 for x in middle.values()) and len(set.union(*middle.values())) > 30
    assert {i for i, r in rows.items() if not r["base_failed"] and not r["kept"] and lang[i] in ("zz", "few")} == set()
    monkeypatch.setattr(kneser_ney, "MAX_LANGUAGES", 20)  # passes do not show in the result
    again = {r["doc_id"]: r for r in kneser_ney.quality(docs).collect()}
    assert set(again) == set(rows) and all(tuple(r) == pytest.approx(tuple(rows[i])) for i, r in again.items())
    assert sorted(r["doc_id"] for r in kneser_ney.keep_good(docs).collect()) == sorted(i for i, r in rows.items() if r["kept"])


# -- 2, 7 -------------------------------------------------------------------

def test_quality_classifier_held_out(spark):
    rows = {r["doc_id"]: r for r in catalog.op2_line_crf(spark, SF01).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    held = [(r["predicted"], labels[i]) for i, r in rows.items() if r["held_out"] and i in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values())


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(1)
    lines = np.array([3, 1, 4])
    evidence, transition = rng.normal(size=8), rng.normal(size=(2, 2))
    p, pairs = line_crf.marginals(evidence, transition, lines)
    at, want, together = 0, [], np.zeros((2, 2))
    for n in lines:
        weight = np.zeros(n)
        total, joint = 0.0, np.zeros((2, 2))
        for path in range(2 ** n):
            y = [path >> k & 1 for k in range(n)]
            w = np.exp(sum((evidence[at + k] / 2) * (1 if y[k] else -1) for k in range(n)) + sum(transition[a, b] for a, b in zip(y, y[1:])))
            total += w
            weight += w * np.array(y)
            for a, b in zip(y, y[1:]):
                joint[a, b] += w
        want += (weight / total).tolist()
        together += joint / total
        at += n
    assert np.allclose(p, want) and np.allclose(pairs, together)


def test_language_held_out(spark):
    rows = {r["doc_id"]: r for r in catalog.op7_string_kernel(spark, SF01).collect()}
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang").collect()}
    held = [(r["lang_pred"], lang[i]) for i, r in rows.items() if r["held_out"]]
    assert len(rows) == 1000 and sum(a == b for a, b in held) / len(held) > 0.98


def test_string_kernel_against_plain_sets():
    """Kernels, Nystroem features, ridge weights and scores by their formulas, on Python sets of n-grams."""
    rng = random.Random(3)
    stems = {"aa": "karo tima lupo sena", "bb": "wexy qulv zarck vony", "cc": "einer zweier über dreißig"}
    make = lambda lang, n: " ".join(rng.choice(stems[lang].split()) + rng.choice("abc") for _ in range(n))
    train = [(make(lang, rng.randint(2, 9)), lang) for lang in stems for _ in range(12)]
    fold = string_kernel.FOLD

    def grams(text):
        s = [int(fold[b]) for b in text.encode()]
        return {tuple(s[i: i + k]) for k in (1, 2, 3) for i in range(len(s) - k + 1)}

    sets = [grams(t) for t, _ in train]
    marks = [i for lang in sorted(stems) for i in [j for j, (_, x) in enumerate(train) if x == lang][:4]]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    base = np.array([[kernel(sets[i], sets[j]) for j in marks] for i in marks])
    values, vectors = np.linalg.eigh(base)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = np.array([[kernel(x, sets[j]) for j in marks] for x in sets]) @ root
    y = np.array([sorted(stems).index(x) for _, x in train])
    target = np.where(y[:, None] == np.arange(3), 1.0, -1.0)
    weight = np.diag(1.0 / np.bincount(y)[y])
    beta = np.linalg.solve(features.T @ weight @ features + string_kernel.RIDGE * np.eye(features.shape[1]), features.T @ weight @ target)
    model = string_kernel.Model([string_kernel.present(np.frombuffer(t.encode(), np.uint8)) for t, _ in train], [x for _, x in train], 4)
    asked = [make(lang, n) for lang in stems for n in (1, 3, 30)] + ["q", "über karo", "zz" * 400]
    best, score = model.score([np.frombuffer(t.encode(), np.uint8) for t in asked])
    for k, t in enumerate(asked):
        margin = 4 * (np.array([kernel(grams(t), sets[j]) for j in marks]) @ root @ beta)
        odds = np.exp(margin - margin.max())
        assert best[k] == margin.argmax() and abs(score[k] - 1 / odds.sum()) < 1e-4


def test_every_language_is_predicted(spark):
    catalog.ready(spark)
    rows = documents_in_languages({f"l{i}": 12 - i % 3 for i in range(40)})
    got = string_kernel.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True)).collect()
    lang = {i: x for i, _, x in rows}
    assert {r["lang_pred"] for r in got} == set(lang.values())
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in got) > 0.95 * len(rows)


def test_classifiers_on_odd_rows(spark, small, empty):
    labels = spark.createDataFrame([(3 * i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    for source in (labels, labels.limit(0)):
        got = line_crf.classify(small, source, F.lit(True)).collect()
        assert len(got) == len(sample_rows()) and all(0 <= r["score"] <= 1 for r in got)
    got = string_kernel.identify(small, F.lit(True)).collect()
    assert len(got) == len(sample_rows())
    assert sum(r["lang_pred"] == "und" for r in got) == sum(not any(c.isalpha() for c in t or "") for _, t, *_ in sample_rows())
    assert {r["lang_pred"] for r in string_kernel.identify(small, F.lit(False)).collect()} == {"und"}


# -- 9 ----------------------------------------------------------------------

def test_decontamination(spark):
    catalog.ready(spark)
    item = "Last year Anna sold 12 crates of apples to Bert for 3.50 dollars each, and Anna kept 4 kg of pears."
    renamed = item.replace("Anna", "Maria").replace("Bert", "Otto").replace("12", "75").replace("3.50", "9").replace("4 kg", "11 lb")
    mixed = item.replace("and Anna", "and Otto")
    docs = [(1, f"x y. {item} z"), (2, f"Some words. {renamed}"), (3, "nothing of the kind"), (4, None), (5, ""), (6, f"Q: {mixed}"), (1, f"x y. {item} z"), (None, item)]
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (None, "a b c"), (10, "too short"), (7, item)], "item_id long, text string")
    rows = template_windows.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    found = sorted(((r["doc_id"], r["contaminated"], tuple(r["items"])) for r in rows), key=str)
    assert found == sorted([(1, True, (7,)), (2, True, (7,)), (3, False, ()), (4, False, ()), (5, False, ()), (6, True, (7,)), (1, True, (7,)), (None, True, (7,))], key=str)
    n = {r["doc_id"]: r["n_windows"] for r in rows}
    assert n[6] < n[1] == n[2]  # windows whose slots contradict do not count
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in template_windows.keep_clean(docs, bench).collect()) == [3, 4, 5]
    assert template_windows.contaminated(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_decontamination_finds_passages_as_they_stand(spark):
    bench = {}
    for r in spark.read.parquet(f"{SF01}/benchmark.parquet").collect():
        w = r["text"].split()
        bench.update({tuple(w[i:i + 12]): r["item_id"] for i in range(len(w) - 11)})
    got = {r["doc_id"]: r["contaminated"] for r in catalog.op9_template_windows(spark, SF01).collect()}
    for r in spark.read.parquet(f"{SF01}/documents.parquet").collect():
        w = r["text"].split()
        assert got[r["doc_id"]] == any(tuple(w[i:i + 12]) in bench for i in range(len(w) - 11))


def test_a_common_preamble_is_evidence_for_no_item(spark):
    """2,000 items begin with the same 14 words; a document repeats these 50 times, another has one whole item."""
    catalog.ready(spark)
    rng = random.Random(4)
    preamble = "read the following question with care and choose the one best answer from below"
    make = lambda: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(14))
    items = [(i, f"{preamble} {make()}") for i in range(2000)] + [(2000, preamble), (2001, f"{preamble} {make()}")]
    items.append((2002, items[-1][1]))                      # an item that stands there twice
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, "\n".join([make()] + [preamble] * 50)), (2, make() + " " + items[7][1] + " " + make()),
                                  (3, make() * 3), (4, items[2001][1])], "doc_id long, text string")
    got = {r["doc_id"]: r["items"] for r in template_windows.contaminated(docs, bench).collect()}
    assert got == {1: [2000], 2: [7, 2000], 3: [], 4: [2000, 2001, 2002]}
    blocks = template_windows.benchmark_blocks(bench, "item_id", "text", 8, 4)
    made = template_windows.templates(np.frombuffer(docs.first()["text"].encode(), np.uint8), np.array([0, len(docs.first()["text"])]))
    start = time.time()
    assert [len(list(b.matches(*made))) for b in blocks] == [1]
    assert time.time() - start < 1


def windows_found(spark, item, *texts):
    """(contaminated, windows) of each text, for one benchmark item."""
    catalog.ready(spark)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = template_windows.contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    return [(r["contaminated"], r["n_windows"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_slots_are_bound_per_occurrence(spark):
    item = "Last year Anna sold 12 crates of apples to Bert for 3.50 dollars each, and Anna kept 4 kg of pears."
    alike = "Last year Otto sold 75 crates of apples."
    variants = " ".join(item.replace("Anna", a).replace("12", n) for a, n in (("Otto", "5"), ("Maria", "6"), ("Ida", "7")))
    whole = windows_found(spark, item, item)[0]
    assert whole[0] and windows_found(spark, item, f"{alike} {item}", f"{item} {alike}", f"{alike} {variants}") == [whole] * 3
    # a word more in the middle parts the occurrence in two, which fit one binding
    split = item.replace("dollars each", "dollars for each")
    mixed = item.replace("and Anna", "and Otto")
    got = windows_found(spark, item, split, f"{alike} {mixed}")
    assert got[0][1] > 0 and got[0][1] == windows_found(spark, item, f"{alike} {split}")[0][1] and got[1][1] < whole[1]
    again = "We bought 2 pears and 2 plums at the market, and then we ate them all."
    n = windows_found(spark, again, again, again.replace("2 pears", "3 pears").replace("2 plums", "4 plums"))
    assert n[0] == n[1] and n[0][0]


def test_windows_of_any_case_and_names_that_open_sentences(spark):
    item = "Last year Anna sold 12 crates of apples to Bert for 3.50 dollars each, and Anna kept 4 kg of pears."
    got = windows_found(spark, item, item, item.lower(), item.upper(), item.title(), f"intro {item.lower()} end")
    assert got == [(True, 13)] * 5
    item = "Tom has 3 apples. Ann has 5 apples. How many apples do they have?"
    fresh = item.replace("Tom", "Lee").replace("Ann", "Kim").replace("3", "7").replace("5", "9")
    assert windows_found(spark, item, item, fresh, f"Now Lee{fresh[3:]}") == [(True, 7)] * 3
    assert windows_found(spark, "What is 12 * 7 + 3?", "Q: what is 12 * 7 + 3?", "What is 12 * 8 + 3?") == [(True, 1), (False, 0)]


# -- 1 ----------------------------------------------------------------------

def brute_lines(rows):
    """The same rule, pair by pair, on lists."""
    docs = sorted({(r[0] is None, r[0] or 0, r[1]) for r in rows if r[1] is not None}, key=lambda d: (d[0], d[1], d[2]))
    strip = [[x.strip(" \t\n\x0b\x0c\r") for x in d[2].split("\n")] for d in docs]
    return docs, strip


def test_line_dedup(small):
    rows = sample_rows()
    out = patience_lines.without_common_blocks(small)
    assert out.columns[:-2] == small.columns and out.count() == len(rows)
    docs, strip = brute_lines(rows)
    gone = blocks_of_earlier_documents(["\n".join(s) for s in strip], patience_lines.MIN_WORDS)
    want = {doc: len(x) for doc, x in zip(docs, gone)}
    for r in out.collect():
        if r["_l_removed"] == 0:
            continue
        assert r["_l_lines"] > 0
    source = {(r[0] is None, r[0] or 0): 0 for r in rows}
    for (null, i, text), n in want.items():
        source[null, i] = max(source[null, i], n)
    got = {}
    for r in out.collect():
        key = (r["doc_id"] is None, r["doc_id"] or 0)
        got[key] = max(got.get(key, 0), r["_l_removed"])
    # two documents may share an id only if both are null; ids decide the order otherwise
    assert got == source


@pytest.mark.parametrize("seed", range(20))
def test_patience_alignment_is_a_common_subsequence(seed):
    rng = random.Random(seed)
    a = [rng.randrange(12) for _ in range(rng.randrange(30))]
    b = [x for x in a if rng.random() < 0.7] + [rng.randrange(12) for _ in range(5)]
    pairs = patience_lines.aligned(a, b)
    assert all(a[i] == b[j] != 0 for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    assert [j for _, j in patience_lines.aligned(a, a)] == [i for i, x in enumerate(a) if x] or 0 in a


def removed_lines(out):
    return {r["doc_id"]: (r["_l_removed"], r["text"]) for r in out.collect()}


def test_frequent_blocks_of_short_lines(spark):
    catalog.ready(spark)
    block = "one two three four five six\nseven eight nine"
    n = patience_lines.RARE + 20
    docs = [(i, f"only {i} here\n{block}\nand {i} again") for i in range(n)]
    got = removed_lines(patience_lines.without_common_blocks(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == {i: (0, docs[i][1]) if i == 0 else (2, f"only {i} here\nand {i} again") for i in range(n)}


def blocks_of_earlier_documents(texts, min_words):
    """Every line in a block of min_words words (blank lines aside) that some earlier text has, by brute force."""
    solid = [[(j, x) for j, x in enumerate(t.split("\n")) if x] for t in texts]
    out = []
    for k, mine in enumerate(solid):
        gone = set()
        for s in range(len(mine)):
            # the places in earlier texts where the block goes on: one that stands nowhere cannot stand when it is longer
            at = [(theirs, i) for theirs in solid[:k] for i in range(len(theirs))]
            for e in range(s + 1, len(mine) + 1):
                at = [(theirs, i) for theirs, i in at if i + e - s <= len(theirs) and theirs[i + e - s - 1][1] == mine[e - 1][1]]
                if not at:
                    break
                if sum(len(x.split()) for _, x in mine[s:e]) >= min_words:
                    gone |= {j for j, _ in mine[s:e]}
        out.append(gone)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_against_all_earlier_documents(spark, seed):
    catalog.ready(spark)
    rng = random.Random(seed)
    lines = [" ".join(f"x{i}" for _ in range(rng.randint(1, 10))) for i in range(12)]
    texts = ["\n".join(rng.choice([*lines, *lines, f"own {k} {i}", ""]) for i in range(rng.randrange(14))) for k in range(40)]
    block = "a b c\nd e f\ng h i"
    texts += [f"{block}\nfirst\nj k l m\nn o p q", f"second\nj k l m\nn o p q\n{block}"]  # the same blocks in another order
    got = removed_lines(patience_lines.without_common_blocks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    want = blocks_of_earlier_documents(texts, patience_lines.MIN_WORDS)
    assert got == {k: (len(gone), "\n".join(x for j, x in enumerate(texts[k].split("\n")) if j not in gone)) for k, gone in enumerate(want)}
    assert want[-1] == {1, 2, 3, 4, 5}


def test_alignments_find_the_blocks_of_pairs(spark, monkeypatch):
    """Without the alignment its deletions are gone; what only the exact rest finds stays apart."""
    catalog.ready(spark)
    rng = random.Random(6)
    line = lambda tag: f"{tag} " + " ".join(rng.choice("abcdefgh") * 3 for _ in range(5))
    passages = [[line(f"p{k} {i}") for i in range(6)] for k in range(8)]
    texts = ["\n".join([line(f"own {k}"), *passages[k % 8], line(f"tail {k}"), *(passages[(k + 1) % 8] if k % 3 == 0 else [])]) for k in range(60)]
    swapped = texts[0].split("\n")
    texts.append("\n".join(swapped[7:] + ["x"] + swapped[:7]))          # blocks in another order
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["id"]: (set(r["gone"]), r["n_aligned"]) for r in patience_lines.deletions(docs).collect()}
    want = blocks_of_earlier_documents(texts, patience_lines.MIN_WORDS)
    assert {k: found.get(k, (set(), 0))[0] for k in range(len(texts))} == dict(enumerate(want))
    aligned, gone = sum(n for _, n in found.values()), sum(map(len, want))
    assert 0.9 * gone < aligned <= gone
    assert found[60][1] < len(found[60][0])                             # the rest finds the block out of order
    monkeypatch.setattr(patience_lines, "common_lines", lambda *_: [])
    off = patience_lines.deletions(docs).collect()
    assert sum(r["n_aligned"] for r in off) == 0


def test_a_long_holder_sends_only_stretches(spark):
    """A passage inside a very long first document, and a line on very many documents."""
    catalog.ready(spark)
    rng = random.Random(7)
    long_lines = [" ".join(rng.choice("abcdefghijk") * 4 for _ in range(9)) + f" {i}" for i in range(35_000)]
    hot = "this very line stands in every single document here"
    texts = ["\n".join(long_lines)] + [f"own {k}\n" + "\n".join(long_lines[k * 7: k * 7 + 4]) + f"\n{hot}" for k in range(5000)]
    got = removed_lines(patience_lines.without_common_blocks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)))
    assert got[0] == (0, texts[0]) and got[1][0] == 4
    assert all(got[k] == (5, f"own {k - 1}") for k in range(2, 5001))


def test_further_copies_of_a_block_go(spark):
    catalog.ready(spark)
    passage = "one two three four five\nsix seven eight nine ten"
    texts = [f"start\n{passage}\nend", f"x\n{passage}\ny\n{passage}\nz", f"u\n{passage}\n{passage}\nv\n\n{passage}\nw"]
    got = removed_lines(patience_lines.without_common_blocks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert got == {0: (0, texts[0]), 1: (4, "x\ny\nz"), 2: (6, "u\nv\n\nw")}


# -- all ----------------------------------------------------------------------

def test_empty_tables(spark, empty):
    path = P.path("byte_bpe_50k.json")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (patience_lines.without_common_blocks(empty), line_crf.classify(empty, labels, F.lit(True)), simhash_groups.near_duplicate_components(empty),
                simhash_groups.one_of_each(empty), kneser_ney.quality(empty), kneser_ney.keep_good(empty), substring_sketch.remove_repeated_windows(empty),
                string_kernel.identify(empty, F.lit(True)), bpe_index.encode_decode(empty, path), template_windows.contaminated(empty, bench),
                substring_bwt.remove_repeated_bytes(empty),
                token_lengths.length_answers(token_lengths.length_histogram(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN))):
        assert out.collect() == []


def test_sql_oracles(spark):
    from tests import harness
    con = harness.duck(SF001)
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF001}/documents.parquet')")
    for name, text in llm_sql.oracle_sql().items():
        assert harness.compare(catalog.queries()[name](spark, SF001), con, text) is None


def test_pipeline(spark, tokenizer):
    import corpus_pipeline
    catalog.ready(spark)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF001).collect()}
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = frame.count()
        frame = stage(spark, frame, SF001).checkpoint()
        assert frame.columns == docs.columns and frame.count() <= before
    rows = frame.collect()
    assert set(got) == {r["doc_id"] for r in rows} and len(rows) == len(got)
    prints = [brute_fingerprint(r["text"], 4) for r in rows]
    assert len(set(brute_components(prints, 4))) == len(rows)
    for r in rows:
        ids = tokenizer.encode(r["text"], add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_sha256"], got[r["doc_id"]]["decoded_sha256"]) == want
