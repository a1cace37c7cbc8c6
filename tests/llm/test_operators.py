"""Operators against brute force and on edge cases."""

import hashlib
import json
import random
import re
import sys
import zlib
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from retailcast.llm import (
    calibration,
    common,
    components,
    decontaminate,
    line_dedup,
    order_minhash,
    packing,
    pii,
    quality,
    simhash,
    token_files,
    toxicity,
    url_filter,
)

#: an extra column of each name that an operator uses inside
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, found int"
LONG = "alpha beta gamma delta " * 20_000
TEXTS = [
    (1, "One two three four five six seven eight nine ten eleven."),
    (2, "One two three four five six seven eight nine ten eleven."),
    (3, ""),
    (4, None),
    (None, "no id here at all"),
    (5, LONG),
    (6, "mail bob.x@mail1.example.com or 10.0.0.1, card 4111 1111 1111 1111 tel +1 (222) 555-1234"),
    (6, "mail bob.x@mail1.example.com or 10.0.0.1, card 4111 1111 1111 1111 tel +1 (222) 555-1234"),
    (7, "a\nb\nc\nd\ne\nf\ng\nh"),
    (8, "x\na\nb\nc\nd\ne\nf\ng\nh"),
    (9, "   \n \t "),
    (10, "Ünïcödé wörds ŞİĞ 漢字 漢字 漢字"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "s" if k % 3 else None, None if t is None else len(t), 0.5, "r", 1) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 9)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, "zzz two three four FIVE six seven, eight nine ten eleven zzz"), (2, "no id"), (3, None), (4, "..."), (None, "wörds")]
    return spark.createDataFrame(rows, "item_id long, text string")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@pytest.mark.parametrize("part, column", [(quality, "quality"), (toxicity, "toxic")])
def test_classifier_edge_cases(docs, none, labels, part, column):
    model = part.fit(docs, labels)
    rows = part.score_documents(docs, model).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert part.score_documents(none, model).count() == 0
    unlabelled = part.fit(docs, labels.where("doc_id < 0"))
    assert part.score_documents(docs, unlabelled).count() == len(TEXTS)
    for r in rows:
        want = r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        assert r["held_out"] == want


@pytest.mark.parametrize("part, column, least", [(quality, "quality", 0.9), (toxicity, "toxic", 0.7)])
def test_held_out_order(spark, part, column, least):
    sf = "/root/testdata/sf0.01"
    docs, marks = table(spark, sf, "documents"), table(spark, sf, "labels")
    scored = part.score_documents(docs, part.fit(docs, marks)).join(marks, "doc_id").where("held_out").toPandas()
    rank, y = scored["score"].rank(), scored[column]
    ones, zeros = (y == 1).sum(), (y == 0).sum()
    assert (rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * zeros) > least


def test_toxicity_reads_whole_texts_in_runs(spark, monkeypatch):
    """Scores equal a plain sum over the n-grams of all words, however small the runs and the memory of words."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["Bad", "worse", "hüte", "x", "good-ish", "awfully"]) + str(rng.randrange(50)) for _ in range(n)) for n in (0, 1, 3, 400, 400)]
    texts += [None, "  ", texts[3] + "\n\u2003" + texts[4]]
    place = np.full(1 << toxicity.BITS, -1, np.int32)
    chosen = np.unique(np.concatenate([toxicity.ngrams([w])[1] for w in toxicity.word_set(texts[4])])[::3])
    place[chosen] = np.arange(len(chosen))
    model = toxicity.ToxicityModel(place, np.linspace(-1, 1, len(chosen)), 0.25)
    want = []
    for t in texts:
        found = {b for w in (t or "").lower().split() for b in toxicity.ngrams([w])[1].tolist() if place[b] >= 0}
        want.append(1 / (1 + np.exp(-(0.25 + sum(model.weights[place[b]] for b in found)))))
    monkeypatch.setattr(toxicity, "READ", 300)
    monkeypatch.setattr(toxicity, "KNOWN", 40)
    features = toxicity.Features(place)
    got = [0.25 + model.weights[sorted(f)].sum() for f in features.of(texts)]
    assert np.allclose(1 / (1 + np.exp(-np.array(got))), want)
    whole = [""] * len(texts)
    for run in toxicity.runs_of(texts):
        for i, part in run:
            whole[i] += part
    assert whole == [t or "" for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scored = toxicity.score_documents(rows, model).orderBy("doc_id").collect()
    assert np.allclose([r["score"] for r in scored], want)


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    total = rng.integers(0, 5, calibration.CELLS).astype(float)
    fitted = calibration.isotonic(rng.binomial(total.astype(int), 0.3).astype(float), total, 0, 1)
    y = fitted(np.linspace(-1, 2, 500))
    assert (np.diff(y) >= 0).all() and 0 < y.min() <= y.max() < 1


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if shingles and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint(docs):
    rows = simhash.near_duplicates(docs).collect()
    want = Counter((i, f"{slow_fingerprint(t):016x}") for i, t in TEXTS)
    assert Counter((r["doc_id"], r["fingerprint"]) for r in rows) == want
    by_id = {r["doc_id"]: r["component_id"] for r in rows}
    assert by_id[2] == 1 and by_id[3] == by_id[4] == by_id[9] == 3


@pytest.mark.parametrize("shard_size", [4096, 5])
def test_links_connect_all_pairs_within_the_radius(spark, shard_size):
    rng = random.Random(5)
    values = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        values |= {centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for _ in range(6)}
    values = sorted(v & (2**64 - 1) for v in values)
    prints = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    found = simhash.Forest()
    for r in simhash.links(prints, 4, shard_size).collect():
        assert ((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 4
        found.link(r["a"], r["b"])
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 4:
                assert found.find(simhash.signed(a)) == found.find(simhash.signed(b))


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(docs, none):
    left = simhash.keep_one(docs)
    assert left.columns == docs.columns
    ids = Counter(r["doc_id"] for r in left.collect())
    assert ids[1] == 1 and ids[2] == 0 and ids[3] == 1 and ids[4] == 0 and ids[6] == 1 and ids[None] == 1
    assert simhash.keep_one(none).count() == 0


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_decontamination(docs, none, benchmark):
    windows = {}
    for item, text in ((r["item_id"], r["text"]) for r in benchmark.collect()):
        w = words_of(text)
        for i in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add("" if item is None else str(item))
    rows = decontaminate.contamination(docs, benchmark).collect()
    want = Counter()
    for i, t in TEXTS:
        w, hit, items = words_of(t), set(), set()
        for g, names in windows.items():
            for a in range(len(w) - len(g) + 1):
                if tuple(w[a : a + len(g)]) == g:
                    hit |= set(range(a, a + len(g)))
                    items |= names
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        want[(i, len(w), len(hit), len(items), digest, bool(hit))] += 1
    assert Counter(tuple(r) for r in rows) == want
    small = decontaminate.with_matches(docs, benchmark, 10, block=20).select("row.doc_id", "found.n_hit")
    assert Counter(map(tuple, small.collect())) == Counter((r["doc_id"], r["n_hit"]) for r in rows)
    clean = decontaminate.remove(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == sum(not r["contaminated"] for r in rows)
    assert decontaminate.contamination(none, benchmark).count() == 0
    assert decontaminate.remove(docs, benchmark.limit(0)).count() == len(TEXTS)
    longest = decontaminate.longest_matches(docs, benchmark).where("doc_id = 1").collect()
    assert [(r["item_start"], r["doc_start"], r["length"]) for r in longest] == [(1, 1, 10)]


def test_order_minhash(docs, none):
    rows = order_minhash.fingerprints(docs).collect()
    assert len(rows) == len(TEXTS)
    by_text = {}
    key = lambda r: (r[0] is None, -(r[0] or 0))
    order = sorted(((i, t or "") for i, t in TEXTS), key=key)
    texts = {}
    for n, (i, t) in enumerate(order):
        half, after = len(t) // 2, order[(n + 1) % len(order)][1]
        texts.setdefault((i, len(t)), set()).add(hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest())
    for r in rows:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert r["edited_sha256"] in texts[(r["doc_id"], r["n_chars"])]
        by_text.setdefault(r["doc_id"], r["fingerprint"])
    assert by_text[1] == by_text[2] and by_text[3] == by_text[4] == ""
    assert next(r for r in rows if r["doc_id"] == 2)["near_next"] == 1.0
    assert order_minhash.fingerprints(none).count() == 0


def plain_signature(text: str, k: int = 3, pick: int = 2) -> dict[int, int]:
    """Tuple hash by bin, one k-mer after another."""

    def chained(parts) -> int:
        seed = 42
        for part in parts:
            seed = xxhash.xxh64_intdigest(part.encode() if isinstance(part, str) else part.to_bytes(8, "little", signed=True), seed)
        return seed

    words = re.split(r"[ \t\n\x0b\f\r]+", text) if text else []
    seen, bins = Counter(), {}
    for at in range(max(len(words) - k + 1, min(len(words), 1))):
        mer = chained(words[at : at + k]) >> 24
        signed = mer - (1 << 40) if mer >> 39 else mer
        number = chained([signed, seen[mer]]) >> 24
        seen[mer] += 1
        bins.setdefault(number >> 34, []).append((number & ((1 << 34) - 1), at))
    ordered = {b: sorted(sorted(mers)[:pick], key=lambda m: m[1]) for b, mers in bins.items()}
    return {b: chained([h for h, _ in mers]) & 0xFFFFFFFF for b, mers in ordered.items()}


def plain_likeness(a: dict[int, int], b: dict[int, int]) -> float:
    used = a.keys() | b.keys()
    return sum(a.get(x) == b.get(x) for x in used) / len(used) if used else 1.0


def test_order_minhash_against_plain_code(spark):
    rng = random.Random(11)
    texts = ["", "one", "one two", " lead and  trail ", "漢字 ünï " * 5, "same " * 300]
    texts += [" ".join(f"w{rng.randrange(60)}" for _ in range(n)) for n in (3, 4, 40, 200, 700)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in order_minhash.fingerprints(df).collect()}
    for i, text in enumerate(texts):
        after = texts[i - 1]  # ids descend, after the smallest comes the largest
        half = len(text) // 2
        own, edited, following = (plain_signature(t) for t in (text, text[: len(text) - half] + after[:half], after))
        want = sorted(own, key=lambda b: b - 64 if b >= 32 else b)
        assert rows[i]["fingerprint"] == "".join(f"{b << 32 | own[b]:010x}" for b in want)
        assert rows[i]["near_edited"] == pytest.approx(plain_likeness(own, edited))
        assert rows[i]["near_next"] == pytest.approx(plain_likeness(own, following))


def test_places_of_very_long_texts_keep_the_order(spark):
    n = 3 << 24
    at = [0, 1, 2, 3, n // 2, n // 2 + 3, n - 4, n - 1]
    df = spark.createDataFrame([(i,) for i in at], "i int")
    got = [r[0] for r in df.select(order_minhash.place_of(F.col("i"), F.lit(n)), "i").orderBy("i").collect()]
    assert got == [i // 3 for i in at]
    assert df.where(order_minhash.place_of(F.col("i"), F.lit(1 << 24)) != F.col("i")).count() == 0


def test_order_matters_in_a_signature(spark):
    words = [f"w{i}" for i in range(400)]
    moved = words[200:] + words[:200]
    df = spark.createDataFrame([(" ".join(words), " ".join(moved), " ".join(random.Random(3).sample(words, len(words))))], "a string, b string, c string")
    for c in "abc":
        df = order_minhash.with_signature(df, c, f"s{c}")
    near = df.select(order_minhash.likeness(F.col("sa"), F.col("sb")), order_minhash.likeness(F.col("sa"), F.col("sc"))).first()
    assert 0.2 < near[0] < 0.9 and near[1] < 0.1


def test_token_files(spark, docs, none, tmp_path):
    definition = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    tokenizer = Tokenizer.from_str(definition)
    rows = token_files.token_index(docs, definition, path=str(tmp_path / "t")).collect()
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for _, t in TEXTS]
    want = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in zip(TEXTS, ids, strict=True))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    total = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == total
        total += r["n_tokens"]
    in_order = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert in_order == sorted(in_order)
    assert token_files.token_index(none, definition, path=str(tmp_path / "u")).count() == 0


def test_words_encode_like_whole_texts(monkeypatch):
    definition = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    tokenizer = Tokenizer.from_str(definition)
    rng = np.random.default_rng(5)
    letters = list("aAbßéÉñİıſKÅµºªĀǅǈʼ'’.,-\t\x85\x1cσΣς漢字1٢٣_%!\u200d🙂ÿŸ\u0301 ., \n")
    texts = ["".join(rng.choice(letters, rng.integers(0, 12))) for _ in range(4000)] + ["Word, word. WORD été Été, <|endoftext|>"] * 2
    monkeypatch.setattr(token_files, "KNOWN", 700)  # several generations
    encoder = token_files.WordEncoder(definition)
    assert encoder.by_word
    found = [encoder.encode(t) for t in texts]
    assert [np.frombuffer(x, "<i4").tolist() for x in found] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    other = json.loads(definition)
    other["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": r"\S+\s?\S*"}
    encoder = token_files.WordEncoder(json.dumps(other))
    want = Tokenizer.from_str(json.dumps(other)).encode("one two three", add_special_tokens=False).ids
    assert not encoder.by_word and np.frombuffer(encoder.encode("one two three"), "<i4").tolist() == want


def test_forms_of_a_word_are_looked_up_once():
    definition = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    encoder = token_files.WordEncoder(definition)
    cores = ["".join(x) for x in product("bcdfg", "aeiou", "lmnr")]
    forms = [form + signs for core in cores for form in (core, core.upper(), core.title()) for signs in ("", ",", ".", ";", "!!", "?")]
    calls = Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        found = encoder.encode(" ".join(forms))
    finally:
        sys.setprofile(None)
    want = Tokenizer.from_str(definition).encode(" ".join(forms), add_special_tokens=False).ids
    assert np.frombuffer(found, "<i4").tolist() == want
    assert calls["call"] + calls["c_call"] < len(forms)  # 100 words in 1,800 forms


def test_lists_of_many_texts(monkeypatch):
    definition = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    tokenizer = Tokenizer.from_str(definition)
    signs = [chr(c) for c in range(0x250)]  # every letter that may count as Latin, and those that do not
    texts = [t for c in signs for t in (f"x{c}y {c} {c}{c},", f"{c}Ab{c}.", None)] + ["", " ", "\n\n", "word " * 500]
    texts += [" ".join(f"{c}b{c.upper()}{c.lower()}!" for c in signs), "w" * 1000 + " " + "w" * 1000]
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    end = np.array([1], "<i4").tobytes()
    for together in (40, 1 << 20):
        monkeypatch.setattr(token_files, "TOGETHER", together)
        encoder = token_files.WordEncoder(definition)
        for _ in range(2):  # new words, then known ones
            assert encoder.lists(pa.array(texts), end).to_pylist() == want
        assert encoder.lists(pa.array(["left out", *texts]).slice(1), end).to_pylist() == want  # a part of an array
        assert max(map(len, encoder.known)) <= token_files.LONGEST
    assert encoder.lists(pa.array([], pa.string()), end).to_pylist() == []


def test_line_dedup(docs, none):
    rows = {r["doc_id"]: r for r in line_dedup.report(docs).collect()}
    assert rows[7]["n_removed"] == 0 and 0 < rows[8]["n_removed"] <= 8 and rows[4]["n_lines"] == 0
    assert rows[6]["n_removed"] == 0
    out = line_dedup.deduplicate(docs)
    assert out.columns == docs.columns and out.count() == len(TEXTS)
    shorter = out.where("doc_id = 8").first()
    assert shorter["n_chars"] == len(shorter["text"]) and shorter["text"].startswith("x")
    assert line_dedup.report(none).count() == 0


def test_passages_between_other_neighbours(spark):
    rng = random.Random(5)

    def lines(n, words=12):
        return ["".join(f"w{rng.randrange(10**6)} " for _ in range(words)).strip() for _ in range(n)]

    planted = {n: lines(n) for n in range(2, 7)} | {1: lines(1, 51), 0: lines(1, 50)}
    texts, own = [], []
    for turn in range(2):
        for passage in planted.values():
            before, after = lines(3 * turn + 1), lines(2)
            texts.append("\n".join(before + passage + [""] * (len(passage) > 1) + after))
            own.append(before + [""] * (len(passage) > 1) + after)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate(docs).collect()}
    for k, n in enumerate(planted):
        assert got[k] == texts[k]
        later = k + len(planted)
        assert got[later] == ("\n".join(own[later]) if n else texts[later])


def test_the_stage_removes_repeated_chunks(spark):
    """Lines of repeated content-defined chunks go in the stage as in the query, also a short line between blank ones."""
    rng = random.Random(9)
    common = [f"heading {i}" for i in range(6)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(8):
            lines += [f"own {rng.randrange(10**9)} line", *[""] * rng.randrange(3), rng.choice(common), *[""] * rng.randrange(3)]
        rows.append((i, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chunked = {r["row"]["doc_id"]: r for r in line_dedup.remove_repeated(docs).collect()}
    staged = {r["row"]["doc_id"]: r for r in line_dedup.remove_passages(docs).collect()}
    assert sum(r["n_removed"] for r in chunked.values()) > 20
    for i, r in staged.items():
        left = Counter(r["kept_text"].split("\n"))
        assert r["n_removed"] >= chunked[i]["n_removed"] and not left - Counter(chunked[i]["kept_text"].split("\n"))
    kept = {line for r in staged.values() for line in r["kept_text"].split("\n")}
    assert kept == {line for _, t in rows for line in t.split("\n")}  # every line keeps its first occurrence


def test_url_rules(spark):
    urls = {
        "https://WWW.Example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://a.example.com/en/?q=/": ("a.example.com", "/en/", "example.com/en/", "block"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://x.net/es/#f": ("x.net", "/es/", "net/es/", "block"),
        "http://x.com?a": ("x.com", "", None, None),
        "x.com/en/": ("", "", None, None),
    }
    rows = [(i, u, "h") for i, u in enumerate(urls)] + [(99, None, None), (None, "http://q.org/a", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, score string")
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert len(got) == len(rows)
    for i, (host, path, rule, verdict) in enumerate(urls.values()):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdict or verdict is None
    assert got[99]["host"] == got[99]["path"] == "" and url_filter.judge(pages.limit(0)).count() == 0


def test_url_model_separates(spark):
    rng = random.Random(3)
    good = [f"http://{rng.choice(['news', 'wiki', 'blog'])}{i}.example.com/a/{i}" for i in range(300)]
    bad = [f"http://{rng.choice(['bets', 'casino', 'spam'])}{i}.example.net/es/{i}" for i in range(300)]
    open_ = [f"http://{w}77.other.org/x" for w in ("news", "wiki", "casino", "bets")]
    pages = spark.createDataFrame(list(enumerate(good + bad + open_)), "page_id long, url string")
    got = {r["page_id"]: r["score"] for r in url_filter.judge(pages).collect()}
    assert min(got[600], got[601]) > max(got[602], got[603])


def test_url_counts_are_exact(spark):
    rng = random.Random(4)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    allowed = [f"http://www.example.com/en/{''.join(rng.choices(letters, k=400))}" for _ in range(150)]
    blocked = [f"http://b{i}.net/es/{''.join(rng.choices(letters, k=400))}" for i in range(150)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(allowed + blocked + allowed[:1])], "page_id long, url string")
    ruled = url_filter.with_rules(pages)
    expected = Counter()
    for row in ruled.collect():
        marked = f"\x02{row['url']}\x03"
        for n in range(1, url_filter.ORDER + 2):
            for at in range(len(marked) - n + 1):
                expected[(marked[at : at + n], row["ruled"] == "allow")] += 1
    urls = ruled.groupBy("url").agg(F.count("*").alias("n"), F.first(F.col("ruled") == "allow").cast("int").alias("class"))
    got = {}
    for r in url_filter.count_grams(urls.withColumn("half", F.lit(1))).collect():
        assert r["c00"] == r["c01"] == 0 and (r["gram"], True) not in got
        got |= {(r["gram"], k): n for k, n in ((False, r["c10"]), (True, r["c11"])) if n}
    assert len(got) > 1 << 18 and got == expected


def test_packing(spark, none):
    rng = random.Random(2)
    rows = [(i, f"s{rng.randrange(6)}" if i % 7 else None, rng.randrange(40), rng.randrange(0, 250)) for i in range(600)]
    items = spark.createDataFrame(rows, "doc_id long, source string, cluster long, n_tokens long")
    got = packing.place(items, 100, 200).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == [(i, n) for i, _, _, n in rows]
    bins = {}
    for r in got:
        assert r["n_full"] == r["n_tokens"] // 100 and (r["bin_id"] is None) == (r["n_tokens"] % 100 == 0)
        if r["bin_id"] is not None:
            bins.setdefault(r["bin_id"], []).append(r)
    for inside in bins.values():
        at = 0
        for r in sorted(inside, key=lambda r: r["bin_start"]):
            assert r["bin_start"] == at
            at += r["n_tokens"] % 100
        assert at <= 100
        for c in ("source", "cluster"):
            values = [r[c] for r in inside if r[c] is not None]
            assert len(values) == len(set(values))
    again = packing.place(items.repartition(7, "cluster"), 100, 200).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)
    assert packing.pack_documents(none).count() == 0


def test_packing_of_copies_ties_and_large_numbers(spark, monkeypatch):
    monkeypatch.setattr(packing, "RUN", 4)
    big = (1 << 62) + 1
    rows = [(big, "s", big, 30)] * 11 + [(None, None, None, 30)] * 9 + [(big + 2, "t", big + 2, 230), (3, None, None, 0)]
    items = spark.createDataFrame(rows, "doc_id long, source string, cluster long, n_tokens long")
    got = packing.place(items, 100).collect()
    assert Counter((r["doc_id"], r["source"], r["cluster"], r["n_tokens"]) for r in got) == Counter(rows)
    assert len({r["bin_id"] for r in got if r["doc_id"] == big}) == 11
    assert all(r["bin_id"] is None for r in got if r["doc_id"] == 3)
    assert next(r for r in got if r["doc_id"] == big + 2)["n_full"] == 2


def test_packing_keeps_near_copies_apart(spark):
    docs = spark.createDataFrame([(i, f"a b c {i}", None) for i in range(6)], "doc_id long, text string, source string")
    groups = spark.createDataFrame([(i, i // 3) for i in range(6)] + [(0, 9)], "doc_id long, component_id long")
    got = {r["doc_id"]: r for r in packing.pack_documents(docs, groups=groups).collect()}
    assert len(got) == 6 and len({r["bin_id"] for r in got.values()}) == 3
    assert {r["cluster"] for r in got.values()} == {0, 1}
    assert len({r["bin_id"] for r in packing.pack_documents(docs).collect()}) == 1


def test_best_fit_against_plain_search():
    rng = random.Random(9)
    items = [(rng.randrange(1, 60), 1 << rng.randrange(4), 0) for _ in range(300)]
    items.sort(reverse=True)
    bins, want = [], []
    for length, source, _ in items:
        fits = [(b[0], k) for k, b in enumerate(bins) if b[0] >= length and not b[1] & source]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([100, 0])
        want.append((k, 100 - bins[k][0]))
        bins[k] = [bins[k][0] - length, bins[k][1] | source]
    assert packing.pack(items, 100) == want


def slow_base(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, m.start(), m.end()))
    patterns = (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for kind, pattern in enumerate(patterns, 1):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            odd = sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(d[::-1]))
            fits = (max(map(int, m[0].split("."))) <= 255 if kind == 1 else 13 <= len(d) <= 19 and odd % 10 == 0) if kind < 3 else 9 <= len(d) <= 15
            if fits:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("a1.@-+ (%9 0") for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == slow_base(text), text
    for _ in range(1000):
        text = "".join(rng.choice("12.") for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == slow_base(text), text


def test_taken_stretches():
    rng = random.Random(8)
    for _ in range(300):
        spans = [(0, a, a + rng.randrange(1, 6)) for a in (rng.randrange(40) for _ in range(rng.randrange(6)))]
        taken = pii.Taken(spans)
        for _ in range(12):
            a = rng.randrange(45)
            b = a + rng.randrange(1, 6)
            touched = any(a < e and s < b for _, s, e in spans)
            assert taken.touches(a, b) == touched
            if not touched:
                taken.add(a, b)
                spans.append((0, a, b))


def test_long_texts_with_many_candidates():
    digits = "7" * 300_000
    assert pii.base_spans(digits) == []
    base, candidates = pii.find("4111 1111 1111 1111, a@b.c; " * 20_000)
    assert len(base) == 40_000 and all(not free for _, _, _, _, free, _ in candidates)


def test_a_half_without_a_class_takes_all_counts(spark):
    """Two judged URLs, at most one of a class in a half: pages without a rule are still scored by the models."""
    urls = ["https://a.com/good/garden/tools", "https://b.net/es/spam/casino/win", "https://c.org/good/garden/tools", "https://c.org/spam/casino/win"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert rows[0]["verdict"] == "allow" and rows[1]["verdict"] == "block"
    found = {r["url"]: r["whole"] for r in url_filter.differences(url_filter.with_rules(pages)).collect()}
    assert found[urls[2]] > 0 > found[urls[3]] and rows[2]["score"] >= rows[3]["score"]


def test_url_pieces(monkeypatch):
    monkeypatch.setattr(url_filter, "PIECE", 10)
    urls = ["", "abc", "x" * 50, "", "ab", "cd", "efghijk"]
    runs = list(url_filter.pieces(urls))
    assert [u for run in runs for u in urls[run]] == urls and len(runs) > 2
    assert all(sum(map(len, urls[run])) <= 10 or run.stop - run.start == 1 for run in runs if "x" * 50 not in urls[run])
    assert list(url_filter.pieces([])) == []


def test_partition_sums(spark):
    df = spark.range(0, 100, 1, 13)

    def add(batches):
        n = sum(pdf["id"].sum() for pdf in batches)
        return {"a": np.full((2, 5), float(n)), "b": np.ones(1)}

    got = common.partition_sums(df, add, block=3, together=2)
    assert got["a"].shape == (2, 5) and (got["a"] == 4950).all() and got["b"].tolist() == [13]


def test_pii(docs, none):
    rows = pii.report(docs).collect()
    assert len(rows) == len(TEXTS)
    hit = next(r for r in rows if r["doc_id"] == 6)
    assert (hit["n_email"], hit["n_ip"], hit["n_card"], hit["n_phone"]) == (1, 1, 1, 1)
    assert sum(r["n_email"] for r in rows) == 2 and pii.report(none).count() == 0
    clean = pii.spans(docs).where("doc_id = 6").join(docs, "doc_id").select(pii.redact(F.col("text"), F.col("spans"))).first()[0]
    assert clean.startswith("mail [email] or [ip], card [card] tel [phone]")


def test_pii_learns_from_every_candidate(spark, monkeypatch):
    """Trees and thresholds rest on all candidates of all documents, and not on where a row lies."""
    rng = random.Random(6)
    forms = ["mail a{}@b.org now", "call +49 30 {} 77 today", "card 4111 1111 1111 1111 of {}", "order {} 2234 5567 8890 1 due", "addr 10.0.0.{}", "serial {}-3344-55"]
    rows = [(i // 2, " ".join(rng.choice(forms).format(rng.randrange(10_000, 99_999)) for _ in range(4))) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learnt, scored, fit, thresholds = [], [], pii.fit, pii.thresholds
    monkeypatch.setattr(pii, "fit", lambda c, trees: learnt.append(c.agg(F.sum("weight")).first()[0]) or fit(c, trees))
    monkeypatch.setattr(pii, "thresholds", lambda s, precision: scored.append(s.agg(F.sum("weight")).first()[0]) or thresholds(s, precision))
    got = pii.report(docs).collect()
    every = sum(label or free for _, t in rows for _, _, _, label, free, _ in pii.find(t)[1])
    assert learnt[0] == scored[0] == every and sum(learnt[1:]) == (pii.FOLDS - 1) * every
    again = pii.report(docs.orderBy(F.rand(3)).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_pipeline_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_duplicates", "decontaminate", "packing"]
    first = corpus_pipeline.keep_quality(spark, docs, sf_dir)
    assert first.columns == docs.columns and 0 < first.count() <= docs.count()
    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert out["doc_id"].is_unique and 0 < len(out) <= docs.count()


def test_near_duplicate_stage_is_op2(spark, sf_dir):
    """The stage keeps the smallest id of each component of the query, rows as they were."""
    docs = table(spark, sf_dir, "documents")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    want = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want) and len(want) < docs.count()
