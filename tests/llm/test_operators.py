"""The operators for training data against plain versions, with odd rows in every table."""

import gzip
import hashlib
import itertools
import math
import os
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hibiki.llm import (
    bpe, components, fingerprints, golay, mixing, pii, simhash, substrings, threshold, token_store,
    toxicity, warc,
)
from hibiki.session import new_path

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
rng = random.Random(5)
VOCABULARY = ["the", "of", "Ärger", "ñu", "x1", "don't", "a", "b", "end.", "日本語", "🙂", "é"]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


ODD = [
    None, "", " \n\t ", "a", "word", "  two   spaces\n\n", "x" * 9000, "1" * 5000 + " " + "é" * 3000,
    prose(30), prose(3000), "don'" * 900, " " * 5000 + "we're", "　全角 x\x1fy\x85z", "!?" * 2500,
]
ODD += [ODD[9], ODD[8]]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a repeated row, a null id, and an extra column named like an output."""
    rows = [(i, t, "en", None if i % 4 == 0 else f"s{i % 3}", -1) for i, t in enumerate(ODD)]
    rows += [rows[9], (None, prose(40), "de", "s0", -1), (None, None, None, None, -1)]
    schema = "doc_id long, text string, lang string, source string, ids int"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def plain(df, *keys):
    rows = [tuple(r[k] for k in keys) for r in df.collect()]
    return sorted(rows, key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r))


def sha(data):
    return hashlib.sha256(data).hexdigest()


# -- byte-level BPE ------------------------------------------------------------------------------


@pytest.mark.parametrize("leaf", [1, 7, 64, 2048])
def test_bpe_equals_the_library(leaf):
    codec = bpe.Codec(RANKS, P.PATTERN, leaf)
    whole = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=codec.base._mergeable_ranks,
                              special_tokens={})
    for text in filter(None, ODD):
        text = text if leaf > 7 else text[:700]
        ids = codec.encode(text)
        assert ids == whole.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_bpe_rows(odd, empty):
    encoded = bpe.encode(odd, RANKS, P.PATTERN, ["doc_id", "lang"])
    decoded = bpe.decode(encoded, RANKS, P.PATTERN, ["doc_id"])
    assert Counter(r["bytes"].decode() for r in decoded.collect()) == Counter(
        r.text or "" for r in odd.collect()
    )
    assert encoded.filter("n_tokens * 4 <> octet_length(ids)").isEmpty()
    assert bpe.encode(empty, RANKS, P.PATTERN).isEmpty()


# -- SimHash ----------------------------------------------------------------------------------------


def test_golay_words_within_two_bits_share_a_key():
    code = golay.Golay()
    words = np.random.default_rng(1).integers(0, 1 << 23, 300)

    def keys(w):
        near, use = code.keys(np.array([w]))
        assert use.sum() in (1, 6)
        return set(near[use].tolist())

    for w in words.tolist():
        a, b = rng.sample(range(23), 2)
        assert keys(w) & keys(w ^ 1 << a) and keys(w) & keys(w ^ 1 << a ^ 1 << b)


@pytest.mark.parametrize("crowded", [0, 64])
def test_links_find_all_pairs(spark, crowded):
    base = [rng.getrandbits(64) for _ in range(60)] + [0, 2 ** 64 - 1]
    values = set(base)
    for v in base:
        for n in (1, 2, 3):
            values.add(v ^ sum(1 << k for k in rng.sample(range(64), n)))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), crowded)
    expected = {(max(a, b), min(a, b)) for a in signed for b in signed
                if a != b and bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 2}
    assert {(r.a, r.b) for r in found.collect()} == expected


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, 2), (2, 3), (7, 7), (50, 3), (9, 8)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 1: 1, 2: 1, 3: 1, 50: 1, 9: 8, 8: 8}
    assert components.connected(spark.createDataFrame([], "a long, b long")).isEmpty()


def slow_fingerprint(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates(odd, empty):
    rows = odd.collect()
    prints = [slow_fingerprint(r.text, 3) for r in rows]
    parent = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if bin(a ^ b).count("1") <= 2:
                    parent[i] = parent[j] = min(parent[i], parent[j])
    least = {}
    for r, p in zip(rows, parent):
        least[p] = min([x for x in (least.get(p), r.doc_id) if x is not None], default=None)
    found = simhash.near_duplicates(odd, words=3).withColumn("print", simhash.hexadecimal("fp"))
    expected = [(r.doc_id, f"{f:016x}", least[p]) for r, f, p in zip(rows, prints, parent)]
    assert Counter(map(tuple, found.select("doc_id", "print", "component_id").collect())) == Counter(expected)
    assert simhash.near_duplicates(empty).isEmpty()


def kept_by_hand(rows, words=3):
    """One row of each component of fingerprints within two bits: its smallest key, then content hash."""
    prints = [slow_fingerprint(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if bin(prints[x] ^ prints[y]).count("1") <= 2:
                root[top(x)] = top(y)
    best = {}
    for x, (k, t) in enumerate(rows):
        rank = (k is None, k or 0, hashlib.md5((t or "").encode()).digest())
        best[top(x)] = min(rank, best.get(top(x), rank))
    return Counter((None if none else k, c) for none, k, c in best.values())


def test_one_of_each_equals_brute_force(spark, odd, empty):
    own = random.Random(8)
    base, rows = [f"w{i}" for i in range(300)], []
    for i in range(250):
        words = list(base)
        for at in own.sample(range(300), own.choice([0, 0, 1, 1, 2, 30])):
            words[at] = f"e{i}x{at}"
        rows.append((i, " ".join(words)))
    rows += [rows[7], rows[7], (3, "other text here"), (3, "other text there"), (None, rows[5][1]),
             (8, ""), (7, None), (None, "alone here"), (None, "alone here")]
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, k int, c int, fp int")
    for crowded in (simhash.CROWDED, 1):
        kept = simhash.one_of_each(frame.repartition(3), crowded=crowded).collect()
        got = Counter((r.doc_id, hashlib.md5((r.text or "").encode()).digest()) for r in kept)
        assert got == kept_by_hand(rows)
        assert {(r.k, r.c, r.fp) for r in kept} == {(1, 2, 3)}
    assert simhash.one_of_each(odd).columns == odd.columns
    assert simhash.one_of_each(empty).isEmpty()


CLASHING = ["row", "own", "content", "k", "c", "t", "fp", "first", "least", "root", "stays", "n", "none", "target",
            "whole", "source_size", "size", "_size", "_order", "_source", "_copies", "_copy", "_range", "_of", "key",
            "cut_range", "cut_order", "_base", "_terms", "_hash", "_text", "_spans", "_row", "_own", "terms", "words",
            "wanted", "copies", "score", "_score", "ids", "digest"]


def test_stages_carry_columns_of_any_name(spark):
    """Each stage of the pipeline, with a column for every name that the operators use themselves."""
    rows = [(i, f"mail a{i}@b.org to someone{i % 3} and so on" * 3, "en", f"s{i % 2}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumns({name: F.lit(i) for i, name in enumerate(CLASHING)})
    for stage in (simhash.one_of_each, pii.sanitise, mixing.mix, lambda d: toxicity.drop_toxic(d, None)):
        found = stage(docs)
        assert found.columns == docs.columns
        kept = found.select(*CLASHING).distinct().collect()
        assert [tuple(r) for r in kept] == [tuple(range(len(CLASHING)))]


# -- toxicity ------------------------------------------------------------------------------------


def test_toxicity_learns_words_and_stems(spark, odd, empty):
    clean = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(900):
        words = rng.choices(clean, k=rng.randrange(1, 80))
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["nasty", f"stinkx{rng.randrange(999)}"]))
        rows.append((i, " ".join(words), "en" if i % 2 else "de", int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    scored = toxicity.add_scores(docs, model).withColumn("held", toxicity.held_out())
    aside = [r for r in scored.collect() if r.held]
    assert {r.doc_id for r in aside} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum((r.score >= 0.5) == r.toxic for r in aside) >= 0.95 * len(aside)
    plain_score = toxicity.add_scores(odd, model)
    assert plain_score.count() == odd.count()
    assert plain_score.filter("score < 0 OR score > 1 OR score IS NULL").isEmpty()
    assert toxicity.drop_toxic(odd, model).columns == odd.columns
    assert toxicity.add_scores(empty, model).isEmpty()
    nothing = toxicity.fit(odd, spark.createDataFrame([(1, None)], "doc_id long, toxic int"))
    assert nothing is None and {r.score for r in toxicity.add_scores(odd, None).collect()} == {0.0}


own_rng = random.Random(8)


def test_toxicity_learns_from_every_labelled_row(spark):
    """A word that only rows behind the first 8,000 by the hash of the key show is learned."""
    ids = [r.doc_id for r in spark.range(11000).withColumnRenamed("id", "doc_id")
           .filter(~toxicity.held_out()).orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").collect()]
    late = set(ids[8000:])
    assert len(late) > 500
    rows = []
    for i in range(11000):
        words = own_rng.choices([f"w{n}" for n in range(50)], k=4)
        new = i in late or i not in ids and i % 2 == 0
        if bad := i % 3 == 0:
            words.insert(own_rng.randrange(5), "zork" if new else "nasty")
        rows.append((i, " ".join(words), "en", int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    held = toxicity.add_scores(docs, model).filter(toxicity.held_out()).collect()
    assert any("zork" in r.text for r in held)
    assert sum((r.score >= 0.5) == r.toxic for r in held) >= 0.98 * len(held)


def test_toxicity_trained_in_parts(spark):
    """Several parts learn together, and neither the order nor the place of rows matters."""
    rows = []
    for i in range(4000):
        words = own_rng.choices([f"w{n}" for n in range(200)], k=own_rng.randrange(1, 30))
        if bad := i % 4 == 0:
            words.insert(own_rng.randrange(len(words) + 1), own_rng.choice(["nasty", f"stinkx{own_rng.randrange(99)}"]))
        rows.append((i, " ".join(words), "en" if i % 3 else None, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    labels = docs.select("doc_id", "toxic")
    docs = docs.drop("toxic")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n
    models = [toxicity.fit(docs, labels, part_bytes=size // 6),
              toxicity.fit(docs.unionAll(docs).orderBy(F.rand(3)), labels.repartition(3), part_bytes=size // 6)]
    for name in ("words", "stems"):
        assert all(np.array_equal(a, b) for a, b in zip(*[m.rows[name] for m in models]))
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].bias == models[1].bias
    assert abs(models[0].threshold - models[1].threshold) < 1e-5 and set(models[0].thresholds) == set(models[1].thresholds) == {"en"}
    held = toxicity.add_scores(docs, models[0]).filter(toxicity.held_out()).join(labels, "doc_id").collect()
    assert sum((r.score >= 0.5) == r.toxic for r in held) >= 0.95 * len(held)


def test_mean_of_models():
    """A model unfolds to rows and back without loss; untouched embeddings stay."""
    texts = [(np.array([i % 7, 9], np.int32), np.array([i % 3, 4], np.int32)) for i in range(40)]
    start = toxicity.train(texts, np.arange(40) % 7 == 0, epochs=2)
    then = toxicity.train(texts[:1], np.array([0.0]), epochs=1, start=start, turn=(1, 2))
    table = toxicity._unfolded(then)
    back = toxicity._folded(table.append_column("n", pa.array([1] * len(table))), start)
    for name in ("words", "stems"):
        known = dict(zip(start.rows[name][0].tolist(), start.rows[name][1].tolist()))
        known |= dict(zip(then.rows[name][0].tolist(), then.rows[name][1].tolist()))
        at, values = back.rows[name]
        assert at.tolist() == sorted(known)
        assert np.allclose(values, [known[i] for i in at.tolist()], atol=1e-12, rtol=0)
    for a, b in zip([*then.filters, then.shifts, then.weights, then.bias], [*back.filters, back.shifts, back.weights, back.bias]):
        assert np.allclose(a, b, atol=1e-12, rtol=0)


def test_pieces_of_a_training_batch(monkeypatch):
    """A batch taken in pieces gives the same step."""
    texts = [tuple(own_rng.choices(range(50), k=n) for _ in range(2)) for n in [0, 1, 5, 30, 90, 2] * 12]
    texts = [tuple(np.array(x, np.int32) for x in t) for t in texts]
    marks = np.array([int(3 in t[0][:20]) for t in texts])
    whole = toxicity.train(texts, marks, epochs=2)
    monkeypatch.setattr(toxicity, "_PIECE", 40)
    cut = toxicity.train(texts, marks, epochs=2)
    assert np.allclose(whole.weights, cut.weights, atol=1e-3) and abs(whole.bias - cut.bias) < 1e-3
    assert [len(p) for p in toxicity._pieces(np.arange(5), np.array([30, 30, 5, 90, 1]))] == [1, 2, 1, 1]


def test_training_holds_little():
    """Memory follows what the texts use, not all buckets, and not a whole batch of long texts."""
    draw = np.random.default_rng(3)
    texts = [tuple(draw.integers(0, 3000, 4000).astype(np.int32) for _ in range(2)) for _ in range(64)]
    tracemalloc.start()
    model = toxicity.train(texts, np.arange(64) % 5 == 0, epochs=1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6 and all(0 < len(model.rows[name][0]) <= 3000 for name in ("words", "stems"))


def test_thresholds_are_the_best_ones(spark):
    rows = [(own_rng.choice(["en", "de", "fr", None]), int(own_rng.random() < 0.4), round(own_rng.random(), 2)) for _ in range(400)]
    rows = [(x, int(x == "de" and t or x != "fr" and s > 0.3 and t), s) for x, t, s in rows]

    def slow(some):
        cuts = sorted({0.0, 1.0} | {s for _, _, s in some})
        f1 = {}
        for a, b in zip(cuts, cuts[1:]):
            hits, said = sum(t for _, t, s in some if s >= b), sum(s >= b for _, _, s in some)
            f1[(a + b) / 2] = 2 * hits / max(said + sum(t for _, t, _ in some), 1)
        return min((c for c in f1 if f1[c] >= max(f1.values()) - 1e-12), key=lambda c: (abs(c - 0.5), c))

    scored = spark.createDataFrame(rows, "lang string, toxic int, score double")
    overall, own = toxicity._best_thresholds(scored)
    assert abs(overall - slow(rows)) < 1e-9
    assert set(own) == {"en", "de"}
    assert all(abs(own[x] - slow([r for r in rows if r[0] == x])) < 1e-9 for x in own)
    assert toxicity._best_thresholds(scored.filter("toxic = 0")) == (None, {})


def test_scores_equal_plain_loops():
    """The network's answer for whole texts, word by word and filter by filter."""
    texts = [t or "" for t in ODD[:14]] + [prose(n) for n in (1, 2, 3, 50)]
    numbers = np.random.default_rng(3)
    found = [toxicity.features(pa.array([t])) for t in texts]
    rows = {}
    for k, name in enumerate(("words", "stems")):
        known = np.unique(np.concatenate([f[k] for f in found]))[::2]  # some words are unknown
        rows[name] = (known, numbers.normal(size=(len(known), toxicity.SIZE)).astype(np.float32))
    total = toxicity.FILTERS * len(toxicity.WIDTHS)
    filters = [numbers.normal(size=(w, toxicity.SIZE, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS]
    model = toxicity.Model(rows, filters, numbers.normal(size=total), numbers.normal(size=total) / 20, 0.1)
    known = {name: dict(zip(at.tolist(), values.tolist())) for name, (at, values) in rows.items()}
    nothing = [0.0] * toxicity.SIZE

    def slow(words, stems):
        x = [[a + b for a, b in zip(known["words"].get(w, nothing), known["stems"].get(s, nothing))]
             for w, s in zip(words.tolist(), stems.tolist())]
        logit, nth = model.bias, 0
        for f in filters:
            for c in range(toxicity.FILTERS):
                best = max(
                    sum(x[p + o][i] * float(f[o, i, c])
                        for o in range(len(f)) if p + o < len(x) for i in range(toxicity.SIZE))
                    for p in range(len(x) + 1)
                )
                logit += max(best + model.shifts[nth], 0) * model.weights[nth]
                nth += 1
        return 1 / (1 + math.exp(-min(max(logit, -30), 30)))

    together = toxicity._score_texts(model, [f[:2] for f in found], model.tables())
    assert np.allclose(together, [slow(*f[:2]) for f in found], atol=1e-4)


# -- token store -----------------------------------------------------------------------------------


def test_token_store(spark, odd, empty):
    folder = new_path(spark, "store")
    manifest = token_store.write_store(odd, folder, WORDS, shards=4)
    keys = token_store.all_keys(odd).unionByName(
        spark.createDataFrame([(999, 0), (1, 7)], "doc_id long, number long")
    )
    found = token_store.fetch(spark, folder, manifest, keys)
    library = Tokenizer.from_file(WORDS)
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids + [2]
    rows = found.orderBy("start").collect()
    assert Counter(np.frombuffer(r.ids, "<u4").tobytes() for r in rows) == Counter(
        np.array(ids(r.text), "<u4").tobytes() for r in odd.collect()
    )
    order = [r.doc_id for r in rows]
    assert order == sorted(order, key=lambda k: (k is not None, k or 0))
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
    none = token_store.write_store(empty, new_path(spark, "store"), WORDS, shards=2)
    assert token_store.fetch(spark, folder, none, token_store.all_keys(empty)).isEmpty()


def test_words_are_encoded_as_the_library_does():
    """Random texts with capitals that lower to several code points, marks, and added tokens."""
    own, library, encoder = random.Random(3), Tokenizer.from_file(WORDS), token_store.WordEncoder(WORDS)
    letters = ["İ", "Σ", "ß", "ſ", "K", "é", "e\u0301", "\u0301", "A", "b", ".", ",", "'s", "'", "9", "½", "日", "🙂", "\u00a0",
               "\u3000", "\x1f", "-", "_", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "|>"]
    texts = ["BELEDİYESİ. BELEDİYESİ, x <|endoftext|> y", "<|EndOfText|>.", "x<|endoftext|>y.z"]
    for _ in range(3000):
        words = ["".join(own.choices(letters, k=own.randrange(1, 7))) for _ in range(own.randrange(1, 6))]
        texts.append(own.choice([" ", "\n", "  ", "\t"]).join(words))
    for i in range(0, len(texts), 300):
        part = texts[i:i + 300]
        got = [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(part)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in part]


def test_token_store_encodes_letters_and_their_closing_marks_apart():
    own, library = token_store.WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    ends = ["$$$", "!!", ",***", ".", "'s", "'", "<s>", "\u0338", "=\u0338", ")'t"]
    texts = [f"{chr(97 + i)}ing{chr(97 + j)}{end}" for i in range(20) for j in range(20) for end in ends]
    seen, encode = [], own._ids
    own._ids = lambda text: seen.append(text) or encode(text)
    found = own.encode([" ".join(texts), *texts])
    for text, ids in zip([" ".join(texts), *texts], found):
        assert np.frombuffer(ids, own.kind).tolist() == library.encode(text, add_special_tokens=False).ids
    # 400 letter runs and four sorts of marks: never a call for each word with such marks.
    assert not any(text.endswith(("$", "!", "*", ".")) and len(text) > 4 for text in seen)


def test_token_store_numbers_a_key_over_several_shards(spark):
    rows = [(None, f"none {i}") for i in range(400)] + [(7, f"seven {i}") for i in range(60)]
    rows += [(8, "eight"), (9, "nine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = new_path(spark, "store")
    manifest = token_store.write_store(docs, folder, WORDS, shards=6)
    found = token_store.fetch(spark, folder, manifest, token_store.all_keys(docs)).orderBy("start").collect()
    assert [(r.doc_id, r.number) for r in found] == [
        (k, i) for k, n in ((None, 400), (7, 60), (8, 1), (9, 1)) for i in range(n)
    ]
    library = Tokenizer.from_file(WORDS)
    assert Counter((r.doc_id, r.ids) for r in found) == Counter(
        (k, np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for k, t in rows
    )


def test_minimal_perfect_hash():
    a, b = np.random.default_rng(2).integers(0, 2 ** 64, (2, 5000), dtype=np.uint64)
    bits, sizes = token_store.build_hash(a, b)
    assert sorted(token_store.slots(bits, sizes, a, b).tolist()) == list(range(5000))


# -- personal data ---------------------------------------------------------------------------------

PRIVATE = [
    "a@b.c_x@d.e.f .5 1.2.3.4.5 999.1.1.1 1.2.3.4@x.y", "4111 1111-1111 1111", "@@a@b.c..d@e.f",
    "+1 (386) 555-3733+4 444 444 44 44 ", "x" * 20000 + "@y.z " + "1" * 30000 + " 1" * 9000 + "-",
    "é4111111111111111é🙂a@b.co", "00000000000000000001.1.1.1 4 4", "+1 ()", "99999999999.1.1.1", None, "",
]


def slow_spans(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans(spark):
    docs = spark.createDataFrame(list(enumerate(PRIVATE)), "doc_id long, text string")
    for r in pii.find(docs).collect():
        assert [tuple(s) for s in r.base] == slow_spans(PRIVATE[r.doc_id] or "")


def test_disclosing_terms(spark, odd, empty):
    rows = [(i, f"mail zoe@mail.example now, Zebrafish {i} said common things") for i in range(4)]
    rows += [(10 + i, f"common things said {i} now mail") for i in range(40)]
    rows += [(60 + i, "one zebracorn copied zed@copy.example") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    terms = {i: [rows[i][1][s.start:s.stop] for s in found[i].spans if s.kind > 3] for i in range(4)}
    assert all(t == ["Zebrafish"] for t in terms.values())
    # Copies are one text: too few to tell.
    assert all(len(found[60 + i].spans) == 1 for i in range(9))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[0] == "mail [EMAIL] now,  0 said common things" and clean[10] == rows[4][1]
    assert Counter(r.text for r in pii.sanitise(odd).collect()) == Counter(r.text for r in odd.collect())
    assert pii.sanitise(odd).columns == odd.columns and pii.find(empty).isEmpty()


def test_terms_that_disclose_an_entity_of_one_or_two_texts(spark):
    rows = [(i, f"common words said {i % 7}") for i in range(5000)]
    rows += [(6000, "Ümit Bo common words umit@mail.example, Bo@mail.example"), (6001, "words said 3 1.2.3.4 Öz"),
             (6002, "call +49 (30) 1234567 R2 said"), (6003, "R2 common call +49 30 1234567")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    told = {i: [t[s.start:s.stop] for s in found[i].spans if s.kind > 3] for i, t in rows}
    # One text holds Ümit, Bo and Öz; two hold R2, under two spellings of a number.
    assert told[6001] == ["Öz"] and told[6002] == ["call", "R2"] and told[6003] == ["R2", "call"]
    assert told[6000] == ["Ümit", "Bo"]
    assert not any(told[i] for i in range(5000))


# -- web archives -----------------------------------------------------------------------------------


def test_archives(spark):
    big = "p" * 1200
    rows = [(1, "u1", big), (5, "u\r\n5", big), (5, "u5", big), (3, None, "small"), (4, "u4", "small"), (6, "u", None),
            (7, "u", ""), (None, "u", big), (None, "u", "q" * 1000), (8, "u", "é" * 700), (9, "u", "é" * 700)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    folder = new_path(spark, "warc")
    archives = warc.write_archives(pages, folder)
    found = warc.resolve(warc.read_records(spark, folder, archives))
    got = Counter(tuple(r) for r in found.collect())
    one = lambda k, t, kind, to=None: (
        k, len((t or "").encode()), hashlib.sha1((t or "").encode()).hexdigest(), kind, to)
    assert got == Counter([
        one(1, big, "revisit", 5), one(5, big, "response"), one(5, big, "revisit", 5), one(None, big, "revisit", 5),
        one(3, "small", "response"), one(4, "small", "response"), one(6, "", "response"), one(7, "", "response"),
        one(None, "q" * 1000, "response"), one(8, "é" * 700, "revisit", 9), one(9, "é" * 700, "response"),
    ])
    assert warc.write_archives(pages.limit(0), folder + "-none").isEmpty()


# -- fingerprints -----------------------------------------------------------------------------------


def slow_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2 ** 64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2 ** 64
    return x ^ x >> 31


def slow_phrases(symbols):
    """One level of the parse, symbol by symbol."""
    step = 0x9E3779B97F4A7C15
    runs = [(s, len(list(g))) for s, g in itertools.groupby(symbols)]
    names = [slow_mix((s + step * n) % 2 ** 64) for s, n in runs]
    labels = names
    for _ in range(4):
        tossed = []
        for i, s in enumerate(labels):
            place = 0
            while i and (s ^ labels[i - 1]) >> place & 1 == 0:
                place += 1
            tossed.append(2 * place + (s >> place & 1))
        labels = tossed
    last = len(names) - 1
    begins = [i for i in range(last + 1) if not i or i < last and labels[i - 1] < labels[i] > labels[i + 1]]
    phrases = [names[a:b] for a, b in zip(begins, [*begins[1:], last + 1])]
    return [
        slow_mix((sum(slow_mix((n + step * (i + 1)) % 2 ** 64) for i, n in enumerate(p)) + len(p)) % 2 ** 64)
        for p in phrases
    ]


def slow_parse(text):
    symbols, found = [ord(c) for c in text], set()
    for height in range(1, fingerprints.TOP + 1):
        symbols = slow_phrases(symbols) if symbols else []
        if height == fingerprints.LEVEL or height > fingerprints.LEVEL and len(symbols) > 1:
            found |= {s >> 32 for s in symbols}
    return sorted(found)[:fingerprints.KEPT]


def slow_likeness(a, b):
    union = sorted(set(a) | set(b))[:fingerprints.KEPT]
    return sum(x in a and x in b for x in union) / len(union) if union else 1.0


def neighbours(rows):
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of rows."""
    def signed(t):
        h = xxhash.xxh64_intdigest(t.encode(), seed=42)
        return h - 2 ** 64 * (h >= 2 ** 63)

    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))
    prints, out = {t: slow_parse(t) for _, t in rows}, []
    written = lambda p: "".join(f"{x:08x}" for x in p)
    for (k, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        q = len(t) // 4
        edited = t[:len(t) - q] + after[:q]
        own, other = prints[t], slow_parse(edited)
        out.append((k, len(t), sha(edited.encode()), written(own), written(other),
                    slow_likeness(own, other), slow_likeness(own, prints[after])))
    return out


@pytest.mark.parametrize("hot", [None, 7, 9 ** 18])
def test_neighbours_equal_brute_force(spark, odd, empty, hot):
    """Also where one key, null too, holds most rows, and rows are repeated."""
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    rows += [(hot, prose(rng.randrange(60))) for _ in range(60)] + [(hot, "again")] * 20
    frame = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in rows],
                                  "doc_id long, text string, part int, tail int, `order` int").repartition(3)
    found = fingerprints.compare_neighbours(frame)
    assert Counter(map(tuple, found.collect())) == Counter(neighbours(rows))
    assert fingerprints.compare_neighbours(empty).isEmpty()


def test_a_hot_key_is_dealt_to_several_ranges(spark):
    rows = [(None if i % 3 else i, prose(5) + str(i)) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    placed = fingerprints.in_order(frame, "doc_id", "text").filter("key IS NULL AND NOT tail")
    sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 250


def test_names_do_not_depend_on_the_place():
    inner = "".join(rng.choices("abcdef ghij", k=3000))
    for before in ("", "x", "yz" * 50):
        one, two = fingerprints.fingerprints([inner, before + inner], kept=10 ** 9)
        assert fingerprints.likeness(one, two, 10 ** 9) > 0.85
    assert fingerprints.likeness(*fingerprints.fingerprints([inner, inner[::-1]])) < 0.2


# -- repeated substrings ---------------------------------------------------------------------------


def slow_removal(docs, window):
    seen, out = {}, {}
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0))
    for key, text in order:
        words = (text or "").encode().split()
        for i in range(len(words) - window + 1):
            seen.setdefault(tuple(words[i:i + window]), (key is not None, key or 0, i))
    for key, text in order:
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i:i + window])] < (key is not None, key or 0, i):
                gone.update(range(i, i + window))
        out.setdefault((key, text), (len(words), len(gone), b" ".join(
            w for i, w in enumerate(words) if i not in gone)))
    return out


@pytest.mark.parametrize("words", [["a", "b"], VOCABULARY, [f"w{i}" for i in range(400)]])
def test_removal(spark, words):
    shared = [rng.choices(words, k=n) for n in (20, 21, 25, 60, 200)]
    docs = [(None, " ".join(shared[2])), (0, None), (1, ""), (2, " ".join(words[:1] * 70))]
    for i in range(3, 60):
        parts = []
        for _ in range(rng.randrange(4)):
            parts += rng.choices(words, k=rng.randrange(30)) + rng.choice(shared)[:rng.randrange(15, 200)]
        docs.append((i, "\t".join(parts)))
    docs += [docs[10], (99, docs[10][1]), (99, docs[11][1])]
    expected = slow_removal(docs, 20)
    frame = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, n_words int").repartition(3)
    left = substrings.remove_repeats(frame)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept.encode()) for r in left.collect())
    assert got == Counter((k, *expected[(k, t)]) for k, t in docs)
    assert substrings.remove_repeats(frame.limit(0)).isEmpty()


def test_sums_cannot_fool_the_comparison(spark):
    """Sequences whose polynomial sums modulo 2 ** 64 agree whatever the base, as letters and as words."""
    turns = [bin(i).count("1") % 2 for i in range(2048)]
    first, second = "".join("ab"[t] for t in turns[:1024]), "".join("ba"[t] for t in turns[:1024])
    same = [f"w{i}" for i in range(19)]
    words = [["yes", "no"][t] for t in turns], [["no", "yes"][t] for t in turns]
    docs = [(1, " ".join([*same, first])), (2, " ".join([*same, second])), (3, " ".join([*same, first]))]
    docs += [(4 + i, " ".join(w)) for i, w in enumerate(words)]
    expected = slow_removal(docs, 20)
    left = substrings.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept.encode()) for r in left} == {
        (k, *expected[(k, t)]) for k, t in docs}
    assert {r.doc_id: r.n_removed for r in left}[2] == 0


def test_words_are_what_is_compared():
    texts = ["", "one  two\tthree", None, "\n four\u00e9 five", "six", " one two\x0bthree\n"]
    words = substrings.Words(pa.array(texts, pa.string()))
    own = [w for t in texts for w in (t or "").encode().split()]
    spans = [(a, b) for a in range(len(own)) for b in range(a + 1, len(own) + 1)]
    got = words.digests(np.array([a for a, _ in spans]), np.array([b for _, b in spans])).to_pylist()
    assert got == [hashlib.sha256(b" ".join(own[a:b])).digest()[:16] for a, b in spans]
    assert words.first.tolist() == [0, 0, 3, 3, 5, 6, 9]
    nothing = substrings.Words(pa.array([None, " "], pa.string()))
    assert len(nothing.names()) == 0 and len(nothing.digests(np.zeros(0, int), np.zeros(0, int))) == 0


# -- mixing ----------------------------------------------------------------------------------------


def test_mixing(spark, odd, empty):
    rows = [(i, prose(rng.randrange(0, 30)), "big" if i % 3 else f"s{i % 7}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.shares(docs).collect()
    totals, taken, target = Counter(), Counter(), {}
    for r, (_, _, source) in zip(sorted(found, key=lambda r: r.doc_id), rows):
        totals[source] += r.size
        taken[source] += r.taken
        target[source] = r.target
        assert r.taken <= 2 * r.size
    assert abs(sum(target.values()) - 1.5 * sum(totals.values())) < 1e-6
    for s in totals:
        assert target[s] <= 2 * totals[s] + 1e-6 and abs(taken[s] - target[s]) <= 30
    mixed = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert mixed == Counter({r.doc_id: r.copies for r in found if r.copies})
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.shares(odd).count() == odd.count() and mixing.shares(empty).isEmpty()


# -- exact top-k -----------------------------------------------------------------------------------


def test_top_k(spark):
    g = np.random.default_rng(4)
    vectors = [(i, g.integers(-5, 6, 6).tolist()) for i in range(400)]
    vectors += [vectors[7], (500, vectors[9][1]), (501, [1, 2]), (502, [3, -1]), (503, None), (None, [1] * 6),
                (600, []), (650, [])]
    rows = spark.createDataFrame([(k, v, 1) for k, v in vectors], "vec_id long, embedding array<long>, rank int")
    found = threshold.top_k(rows, rows.filter("vec_id % 50 = 0"), k=5, block=64, group=3)
    distinct = {(k, tuple(v)) for k, v in vectors if k is not None and v is not None}
    expected = set()
    for q, x in distinct:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), k) for k, y in distinct
                            if k != q and len(x) == len(y))
            expected |= {(q, i + 1, k, -s) for i, (s, k) in enumerate(scored[:5])}
    assert {tuple(r) for r in found.collect()} == expected
    assert {tuple(r) for r in threshold.top_k(rows, rows.filter("vec_id % 50 = 0"), k=5).collect()} == expected
    assert threshold.top_k(rows.limit(0), rows.limit(0)).isEmpty()
    # Parts are as many as the tasks asked for, none smaller than some rows nor larger than a tile.
    assert threshold._parts(10_000, 64, None, 200) == 10 and threshold._parts(10 ** 6, 64, None, 4) == 16
    assert threshold._parts(10 ** 9, 64, None, 200) == -(-10 ** 9 // (1 << 16)) and threshold._parts(5, 0, None, 9) == 1
    odd = spark.createDataFrame(
        [([1.0, -0.001],), ([float("nan"), 1.0],), ([None, 1.0],), (None,)], "v array<double>"
    ).select(threshold.whole_numbers(F.col("v")).alias("v"))
    assert [r.v for r in odd.collect()] == [[256, -1], None, None, None]


def test_archives_are_gzip_members(spark):
    folder = new_path(spark, "warc")
    pages = spark.createDataFrame([(1, "u", "x"), (2, "u", "y")], "page_id long, url string, html string")
    names = [r.name for r in warc.write_archives(pages.coalesce(1), folder).collect()]
    data = b"".join(gzip.decompress(open(os.path.join(folder.removeprefix("file:"), n), "rb").read()) for n in names)
    assert data.count(b"WARC/1.1\r\n") == 2
