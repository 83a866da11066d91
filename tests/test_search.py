import hashlib
import math
import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from hibiki.operators import text_index as TI
from hibiki.operators import text_search
from hibiki.operators.text_search import text_topk, tiered_topk
from hibiki.session import new_path

from conftest import rows

DOCS = "id int, text string, applicable_tier string"


def corpus(n=120, seed=3):
    """Random texts over a skewed vocabulary; a third are copies of one text."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    tiers = ["all", "all", "gold", "silver", "standard"]
    docs = []
    for i in range(n):
        text = " ".join(rng.choices(words, weights, k=rng.randint(1, 25)))
        if i % 3 == 0:
            text = "w0 w5 w9 copied"
        docs.append((i, text, rng.choice(tiers)))
    asked = [
        (100 + i, " ".join(rng.choices(words + ["never"], weights + [0.2], k=rng.randint(1, 8))))
        for i in range(25)
    ]
    asked += [(200, "w0 w5 w9 copied"), (201, "w0 w5 w9 copied"), (202, "unknown words"), (203, "")]
    return docs, asked


def brute_force(docs, asked, k, allowed=lambda q, d: True):
    """The ranking by definition."""
    def words(text):
        return Counter(re.findall(r"\w+", text.lower()))

    counts = {d[0]: words(d[1]) for d in docs}
    df = Counter(t for c in counts.values() for t in c)
    idf = lambda t: math.log((len(docs) + 1) / (df.get(t, 0) + 1)) + 1
    vectors = {}
    for key, c in counts.items():
        v = {t: n * idf(t) for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        vectors[key] = {t: x / norm for t, x in v.items()}
    result = []
    for q, text, *rest in asked:
        v = {t: n * idf(t) for t, n in words(text).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        scored = []
        for d in docs:
            if not allowed((q, text, *rest), d):
                continue
            if not set(v) & set(vectors[d[0]]):
                continue
            score = sum(x / norm * vectors[d[0]].get(t, 0) for t, x in v.items())
            scored.append((-round(score, 6), d[0]))
        for rank, (score, d) in enumerate(sorted(scored)[:k], 1):
            result.append((q, rank, d, -score))
    return result


def check(got, wanted):
    assert [r[:3] for r in got] == [r[:3] for r in wanted]
    assert all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, wanted))


@pytest.fixture(scope="module")
def index(spark):
    docs, _ = corpus()
    df = spark.createDataFrame(docs, DOCS)
    return TI.build_text_index(df, new_path(spark, "t"), attributes=["applicable_tier"])


@pytest.mark.parametrize("broadcast_bytes", [10**8, 0])
@pytest.mark.parametrize("k", [1, 3, 500])
def test_ranking_is_exact(spark, index, broadcast_bytes, k):
    docs, asked = corpus()
    requests = spark.createDataFrame(asked, "request_id int, text string")
    got = text_topk(index, requests, k, broadcast_bytes=broadcast_bytes)
    got = rows(got.select("request_id", "rank", "id", "score"), "request_id", "rank")
    check(got, brute_force(docs, asked, k))


@pytest.mark.parametrize("broadcast_bytes", [10**8, 0])
def test_pruned_and_in_place_agree_for_allowed_passages(spark, index, broadcast_bytes):
    docs, asked = corpus()
    tiers = ["gold", "silver", "standard", "", None]
    asked = [(q, t, tiers[i % 5]) for i, (q, t) in enumerate(asked)]
    requests = spark.createDataFrame(asked, "request_id int, text string, customer_tier string")

    def allowed(q, d):
        return d[2] == "all" or (q[2] is not None and q[2] in d[2])

    from hibiki.functions.tiers import tier_allows
    got = text_topk(
        index, requests, 3, attributes=["customer_tier"], broadcast_bytes=broadcast_bytes,
        allow=lambda: tier_allows(F.col("applicable_tier"), F.col("customer_tier")),
    )
    got = rows(got.select("request_id", "rank", "id", "score"), "request_id", "rank")
    check(got, brute_force(docs, asked, 3, allowed))


def test_tier_modes(spark, index):
    docs, asked = corpus()
    requests = spark.createDataFrame(asked, "request_id int, text string").withColumn(
        "customer_tier", F.lit("gold")
    )
    allowed = lambda q, d: d[2] in ("all", "gold")
    pre = rows(
        tiered_topk(index, requests, 3, mode="prefilter")
        .select("request_id", "rank", "id", "score"), "request_id", "rank",
    )
    check(pre, brute_force(docs, asked, 3, allowed))
    post = rows(
        tiered_topk(index, requests, 3).select("request_id", "rank", "id", "score"),
        "request_id", "rank",
    )
    tier = {d[0]: d[2] for d in docs}
    wanted = []
    for q in sorted({q for q, _ in asked}):
        first = [r for r in brute_force(docs, asked, 6) if r[0] == q]
        kept = [r for r in first if tier[r[2]] in ("all", "gold")][:3]
        wanted += [(q, i, r[2], r[3]) for i, r in enumerate(kept, 1)]
    check(post, wanted)
    assert len(post) <= len(pre)
    with pytest.raises(ValueError):
        tiered_topk(index, requests, mode="other")


def test_postfilter_may_return_fewer(spark):
    docs = [(i, "oil change", "silver") for i in range(6)] + [(9, "oil change price", "all")]
    df = spark.createDataFrame(docs, DOCS)
    index = TI.build_text_index(df, new_path(spark, "t"), attributes=["applicable_tier"])
    asked = spark.createDataFrame([(1, "oil change", "gold")],
                                  "request_id int, text string, customer_tier string")
    assert tiered_topk(index, asked, 3).count() == 0
    assert [r.id for r in tiered_topk(index, asked, 3, mode="prefilter").collect()] == [9]


def everything(index):
    weights = TI.weights_by_id(index).select("id", "token", "tf", F.round("w", 9).alias("w"))
    return rows(weights, "id", "token"), rows(index.vocab.select("token", "df"), "token")


def test_sync_equals_rebuild(spark):
    docs, _ = corpus(60)
    path = new_path(spark, "t")
    old = [(i, t + (" old" if i % 7 == 0 else ""), a) for i, t, a in docs if i % 5] + [
        (1000, "removed later", "all"), (1001, docs[0][1], "gold"),
    ]
    options = dict(attributes=["applicable_tier"])
    TI.sync_text_index(spark.createDataFrame(old, DOCS), path, **options)
    now = spark.createDataFrame(docs, DOCS)
    synced = TI.sync_text_index(now, path, **options)
    rebuilt = TI.build_text_index(now, new_path(spark, "t"), **options)
    assert everything(synced) == everything(rebuilt)
    assert TI.indexed_rows(synced).first().indexed_rows == 60
    # The same change once more changes nothing.
    TI.apply_changes(now, path, None, **options)
    assert everything(TI.refresh_text_index(spark, path)) == everything(rebuilt)


@pytest.mark.parametrize("broadcast_bytes", [0, 10**8])
def test_a_key_with_two_texts_asks_twice(spark, broadcast_bytes):
    docs = [(1, "red apple", "all"), (2, "blue plum", "all")]
    index = TI.sync_text_index(
        spark.createDataFrame(docs, DOCS), new_path(spark, "twice"), "id", attributes=["applicable_tier"]
    )
    asked = [(7, "red apple"), (7, "blue plum"), (8, "blue plum"), (None, "red apple")]
    found = text_topk(index, spark.createDataFrame(asked, "request_id int, text string"), 1,
                      broadcast_bytes=broadcast_bytes)
    got = sorted((r.request_id or 0, r.rank, r.id, r.score) for r in found.collect())
    assert got == [(0, 1, 1, 1.0), (7, 1, 1, 1.0), (7, 1, 2, 1.0), (8, 1, 2, 1.0)]


def test_removing_everything(spark):
    path = new_path(spark, "t")
    df = spark.createDataFrame([(1, "a b", "all"), (2, "c", "all")], DOCS)
    TI.build_text_index(df, path)
    index = TI.sync_text_index(df.filter("id = 0"), path)
    assert index.n_docs == 0 and index.vocab.count() == 0
    asked = spark.createDataFrame([(1, "a")], "request_id int, text string")
    assert text_topk(index, asked).count() == 0


def test_index_opens_in_a_session_that_does_not_know_it(spark, index):
    for folder in (index.postings.inputFiles()[0], index.units.inputFiles()[0]):
        name = "bucketed_" + hashlib.md5(re.sub("/[^/]*$", "", folder).replace("file://", "").encode()).hexdigest()
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    assert everything(TI.open_text_index(spark, index.path)) == everything(index)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_sync_leaves_postings_in_their_buckets(spark, index):
    """Deriving idf and norms sums inside the buckets; only sums per token are dealt out."""
    units = index.units.select("unit", F.lit(1).alias("n_copies"), "doc", "applicable_tier")
    for derived in (
        TI._frequencies(index.postings, units),
        TI._norms(index.postings, units, F.broadcast(index.vocab.select("token", "idf")), index.attributes),
        index.weights,
    ):
        assert "hashpartitioning(unit" not in plan(derived) and "Cartesian" not in plan(derived)


def test_in_place_search_does_not_shuffle_the_index(spark, index):
    split = spark.createDataFrame(
        [(b"q", "w1", 0.5, 1.0, 0.1, False, 0.0, 0.0)],
        "asker binary, token string, qw double, idf double, floor double, skipped boolean, length double, most double",
    )
    found = text_search._found(index, split, lambda: F.lit(True), [], 10**8)
    assert "BroadcastHashJoin" in plan(found) and "hashpartitioning(unit" not in plan(found)
    assert "hashpartitioning(token" not in plan(found)
    apart = plan(text_search._found(index, split, lambda: F.lit(True), [], 0))
    assert "NestedLoop" not in apart and "Cartesian" not in apart


def test_a_floor_drops_pairs_without_changing_the_ranking(spark):
    """Many passages share frequent tokens; few share the requests' rare ones."""
    rng = random.Random(1)
    docs = [(i, " ".join(["the", "of", "and"] * 2 + rng.choices([f"r{j}" for j in range(400)], k=4)), "all")
            for i in range(400)]
    asked = [(i, docs[7 * i][1]) for i in range(30)]
    index = TI.build_text_index(spark.createDataFrame(docs, DOCS), new_path(spark, "t"), attributes=["applicable_tier"])
    requests = spark.createDataFrame(asked, "request_id int, text string")
    named = requests.select(TI.unit_of(F.col("text"), []).alias("asker"), "text")
    tokens = text_search._request_tokens(index, named, [])
    split = text_search._split(index, tokens, lambda: F.lit(True), 1)
    pairs = split.filter("not skipped").join(index.postings, "token").select("asker", "unit").distinct().count()
    assert pairs < 0.1 * len(asked) * len(docs)
    got = text_topk(index, requests, 1).select("request_id", "rank", "id", "score")
    check(rows(got, "request_id", "rank"), brute_force(docs, asked, 1))


@pytest.mark.parametrize("part_bytes", [48 << 20, 1])
def test_blocks_are_exact_however_they_are_cut(spark, index, monkeypatch, part_bytes):
    """Pairs of requests and passages stay in the task that scores their block."""
    for name, value in {"BLOCK_ROWS": 7, "PAIRS": 0, "PART_BYTES": part_bytes}.items():
        monkeypatch.setattr(text_search, name, value)
    monkeypatch.setattr(text_search, "PART_FLOOR", 2000)
    monkeypatch.setattr(text_search, "_found", None)
    docs, asked = corpus()
    requests = spark.createDataFrame(asked, "request_id int, text string")
    got = text_topk(index, requests, 3)
    check(rows(got.select("request_id", "rank", "id", "score"), "request_id", "rank"), brute_force(docs, asked, 3))
    none = text_topk(index, requests, 3, allow=lambda: F.lit(False))
    assert none.count() == 0


def test_a_task_passes_on_one_best_and_no_copy_of_the_postings_is_written(spark, index, monkeypatch):
    written = []
    write_out = text_search.write_out
    monkeypatch.setattr(text_search, "write_out", lambda df, name, *by: (written.append(name), write_out(df, name, *by))[1])
    for name, value in {"BLOCK_ROWS": 7, "PART_BYTES": 1, "PART_FLOOR": 2000, "PAIRS": 0, "JUDGED_REQUESTS": 3}.items():
        monkeypatch.setattr(text_search, name, value, raising=False)
    docs, asked = corpus()
    requests = spark.createDataFrame(asked, "request_id int, text string")
    got = text_topk(index, requests, 3).select("request_id", "rank", "id", "score")
    check(rows(got, "request_id", "rank"), brute_force(docs, asked, 3))
    assert "scored" in written and "passages" not in written
    monkeypatch.setattr(text_search, "PART_BYTES", 48 << 20)
    named = requests.select(TI.unit_of(F.col("text"), []).alias("asker"), "text").distinct()
    split = text_search._request_tokens(index, named, []).withColumn("floor", F.lit(0.0))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        found = text_search._in_blocks(index, split, [Row(mine="", theirs="")], [], 3, 10**8)
        most = found.groupBy("asker", F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert most == 3


@pytest.mark.parametrize("mode, judged", [("prefilter", 3), ("prefilter", 10**6), ("postfilter", 3)])
def test_tiers_are_exact_with_and_without_floors_by_champions(spark, index, monkeypatch, mode, judged):
    for name, value in {"BLOCK_ROWS": 16, "PAIRS": 0, "JUDGED_REQUESTS": judged, "DENSE_SHARE": 0.05, "CHUNK": 4}.items():
        monkeypatch.setattr(text_search, name, value)
    champions, sent = text_search._champions, []
    monkeypatch.setattr(text_search, "_champions", lambda i, a: (sent.append(a.select("asker").distinct().count()), champions(i, a))[1])
    docs, asked = corpus()
    asked = [(*q, ["gold", "silver", "standard"][q[0] % 3]) for q in asked]
    requests = spark.createDataFrame(asked, "request_id int, text string, customer_tier string")
    got = tiered_topk(index, requests, 3, mode=mode).select("request_id", "rank", "id", "score")
    fits = lambda q, d: d[2] in ("all", q[2])
    if mode == "prefilter":
        wanted = brute_force(docs, asked, 3, fits)
    else:
        tier = {d[0]: d for d in docs}
        first, wanted = brute_force(docs, asked, 6), []
        for q in asked:
            kept = [r for r in first if r[0] == q[0] and fits(q, tier[r[2]])][:3]
            wanted += [(r[0], n, *r[2:]) for n, r in enumerate(kept, 1)]
    check(rows(got, "request_id", "rank"), sorted(wanted))
    assert max(sent) < 15 if judged == 3 else max(sent) > 20


@pytest.mark.parametrize("share, k, rows_", [(0.05, 3, 5), (2.0, 1, 50), (0.0, 6, 10**6)])
def test_a_task_scores_its_blocks_exactly(monkeypatch, share, k, rows_):
    """What a task passes on, however its passages are cut, and whichever tokens are multiplied as matrices."""
    for name, value in {"BLOCK_ROWS": rows_, "BLOCK_POSTINGS": 40, "CHUNK": 4, "DENSE_SHARE": share}.items():
        monkeypatch.setattr(text_search, name, value)
    rng = np.random.default_rng(5)
    held = [(bytes([i]), int(rng.integers(40)), "ab"[i % 2], f"t{t}", float(rng.integers(1, 9)) / 16)
            for i in range(200) for t in sorted(rng.choice(30, rng.integers(1, 9), False))]
    doc = {}
    held = [(u, doc.setdefault(u, n), kind, t, w) for u, n, kind, t, w in held]
    kinds = ["a", "b", "c"] * 4
    asked = [{f"t{t}": float(rng.integers(1, 9)) / 16 for t in rng.choice(25, rng.integers(1, 7), False)} for _ in kinds]
    names = [f"t{t}" for t in range(25)]
    pairs = {("a", "a"), ("b", "a"), ("b", "b")}
    asks = {
        "asker": [b"q%d" % i for i in range(12)], "kind": kinds, "floor": np.zeros(12), "pairs": pairs,
        "ends": np.cumsum([0] + [len(q) for q in asked]), "number": np.array([names.index(t) for q in asked for t in q], np.int32),
        "qw": np.array([w for q in asked for w in q.values()]), "tokens": pa.array(names), "idf": np.full(25, 1.5),
    }
    schema = pa.schema([("unit", pa.binary()), ("doc", pa.int64()), ("kind", pa.string()), ("token", pa.string()), ("w", pa.float64())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held[i:i + 7]], schema)
               for i in range(0, len(held), 7)]
    got = [r for b in text_search._scorer(SimpleNamespace(value=asks), k)(iter(batches)) for r in b.to_pylist()]
    wanted = []
    for i, q in enumerate(asked):
        sums = Counter()
        for u, n, kind, t, w in held:
            if t in q and (kinds[i], kind) in pairs:
                sums[u] += q[t] * w * 1.5
        best = sorted((-round(x, 6), doc[u]) for u, x in sums.items())[:k]
        wanted += [(b"q%d" % i, x, n) for x, n in best]
    assert sorted((r["asker"], -r["score"], r["doc"]) for r in got) == sorted(wanted)


def test_tokens_are_counted_in_runs_sorted_by_token(spark, monkeypatch):
    """No second grouping by token; sorting a bucket only merges runs."""
    monkeypatch.setattr(TI, "COUNTED_TOKENS", 40)
    texts = ["b a b", "", "\u6f22\u5b57\u304b b", "c" * 50, "z y x y", "\u00e9t\u00e9 a", *[f"w{i % 7} w{i % 3} q" for i in range(60)]]
    df = spark.createDataFrame([(bytes([i]), t) for i, t in enumerate(texts)], "unit binary, text string")
    counted = TI._counted(df, 1)
    assert "token" not in "".join(re.findall(r"HashAggregate.*", plan(counted)))
    got = [tuple(r) for r in counted.collect()]
    wanted = df.select("unit", F.explode(text_search.tokens(F.col("text"))).alias("token")).groupBy("unit", "token").count()
    assert sorted((bytes(u), t, n) for u, t, n in got) == sorted((bytes(u), t, n) for u, t, n in wanted.collect())
    falls = sum(a[1].encode() > b[1].encode() for a, b in zip(got, got[1:]))
    assert 0 < falls <= 6


def test_requests_with_one_text_are_one_search(spark, index, monkeypatch):
    """Attributes that decide nothing do not make a text another search; those that do, do."""
    searched, real = [], text_search._best
    monkeypatch.setattr(text_search, "_best", lambda i, asked, *a: (
        searched.append(asked.select("asker").distinct().count()), real(i, asked, *a))[1])
    requests = spark.createDataFrame(
        [(i, "w0 w5 w9 copied", f"c{i}") for i in range(6)], "request_id int, text string, customer string"
    )
    got = rows(text_topk(index, requests, 2, attributes=["customer"]), "request_id", "rank")
    alone = rows(text_topk(index, requests, 2), "request_id", "rank")
    assert [r[:1] + r[2:] for r in got] == alone and [r[1] for r in got[::2]] == [f"c{i}" for i in range(6)]
    mine = text_topk(index, requests, 2, attributes=["customer"], allow=lambda: F.col("customer") <= "c2")
    assert {r[0] for r in rows(mine, "request_id")} == {0, 1, 2}
    assert searched == [1, 1, 6]


def test_rare_tokens_are_dealt_and_frequent_ones_sent(spark, monkeypatch):
    monkeypatch.setattr(TI, "COMMON_TOKENS", 5)
    docs, _ = corpus()
    df = spark.createDataFrame(docs, DOCS)
    small = TI.build_text_index(df, new_path(spark, "t"), attributes=["applicable_tier"])
    vocab = spark.createDataFrame([(f"t{i}", 1 << (20 - i), float(i)) for i in range(20)], "token string, df long, idf double")
    asked = spark.createDataFrame([(f"t{i % 25}", i) for i in range(50)] + [(None, 50)], "token string, n int")
    met = TI.with_idf(asked, vocab, F.lit(-1.0))
    assert "BroadcastHashJoin" in plan(met) and "SortMergeJoin" in plan(met)
    assert rows(met.select("n", "idf"), "n") == [(i, i % 25 if i % 25 < 20 else -1.0) for i in range(50)] + [(50, -1.0)]
    assert rows(TI.with_idf(asked, vocab).select("n"), "n") == [(i,) for i in range(50) if i % 25 < 20]
    monkeypatch.setattr(TI, "COMMON_TOKENS", 10**6)
    large = TI.build_text_index(df, new_path(spark, "t"), attributes=["applicable_tier"])
    by_id = lambda i: rows(TI.weights_by_id(i).withColumn("w", F.round("w", 9)), "id", "token")
    assert by_id(small) == by_id(large)


# -- generations ------------------------------------------------------------------------------------


class Stopped(Exception):
    pass


def stop_at(monkeypatch, nth):
    """Let the n-th write of a sync fail."""
    left = [nth]

    def guarded(f):
        def write(*a, **b):
            left[0] -= 1
            if left[0] == 0:
                raise Stopped
            return f(*a, **b)
        return write

    for name in ("_put", "_put_units", "_add_postings", "_commit"):
        monkeypatch.setattr(TI, name, guarded(getattr(TI, name)))


OLD = [(i, f"common word{i % 5} text{i}", "all") for i in range(30)]
NOW = [(i, t + (" new" if i % 4 == 0 else ""), a) for i, t, a in OLD if i % 7] + [(99, "added later", "gold")]


@pytest.fixture(scope="module")
def rebuilt(spark):
    index = TI.build_text_index(spark.createDataFrame(NOW, DOCS), new_path(spark, "t"), attributes=["applicable_tier"])
    return everything(index)


@pytest.fixture
def few_buckets(monkeypatch):
    monkeypatch.setattr(TI, "_buckets", lambda spark, n: n // TI.UNITS_PER_BUCKET + 2)


def test_a_sync_that_fails_at_any_write_and_runs_again(spark, rebuilt, monkeypatch, few_buckets):
    path, options = new_path(spark, "t"), dict(attributes=["applicable_tier"])
    tables = [spark.createDataFrame(t, DOCS) for t in (OLD, NOW)]
    index, seen = TI.sync_text_index(tables[0], path, **options), {1: rebuilt}
    seen[0] = everything(index)
    for nth in range(1, 10):  # members, postings, generation, five tables of stats, generation
        now = nth % 2
        with monkeypatch.context() as patch:
            stop_at(patch, nth)
            with pytest.raises(Stopped):
                TI.sync_text_index(tables[now], path, **options)
        # Whatever was written, readers still see the generation before.
        opened = TI.open_text_index(spark, path)
        assert opened.generation == index.generation and everything(opened) == seen[1 - now]
        index = TI.sync_text_index(tables[now], path, **options)
        assert everything(index) == seen[now]
        assert everything(opened) == seen[1 - now]  # one that was opened stays as it is


def test_a_build_that_fails_and_runs_again(spark, rebuilt, monkeypatch, few_buckets):
    for nth in (2, 3, 6):
        path, options = new_path(spark, "t"), dict(attributes=["applicable_tier"])
        with monkeypatch.context() as patch:
            stop_at(patch, nth)
            with pytest.raises(Stopped):
                TI.sync_text_index(spark.createDataFrame(NOW, DOCS), path, **options)
        assert TI.head(spark, path, derived=True) is None
        assert everything(TI.sync_text_index(spark.createDataFrame(NOW, DOCS), path, **options)) == rebuilt


def test_segments_are_merged_and_the_dead_left_behind(spark, rebuilt, monkeypatch, few_buckets):
    monkeypatch.setattr(TI, "MAX_SEGMENTS", 3)
    path, options = new_path(spark, "t"), dict(attributes=["applicable_tier"])
    TI.sync_text_index(spark.createDataFrame(OLD, DOCS), path, **options)
    for i in range(1, 4):
        now = [(k, f"{t} {i}", a) for k, t, a in NOW] if i < 3 else NOW
        index = TI.sync_text_index(spark.createDataFrame(now, DOCS), path, **options)
    assert TI.head(spark, path).segments and len(TI.head(spark, path).segments) == 1
    assert everything(index) == rebuilt
    assert index.postings.join(index.copies, "unit", "left_anti").isEmpty()


def test_buckets_grow_with_the_passages(spark, monkeypatch):
    path = new_path(spark, "t")
    TI.sync_text_index(spark.createDataFrame(OLD[:1], DOCS), path)
    small = TI.head(spark, path).buckets
    monkeypatch.setattr(TI, "UNITS_PER_BUCKET", 1)
    index = TI.sync_text_index(spark.createDataFrame(OLD, DOCS), path)
    assert TI.head(spark, path).buckets > 2 * small
    assert everything(index) == everything(TI.build_text_index(spark.createDataFrame(OLD, DOCS), new_path(spark, "t")))


CASES = [
    ("K1", "始動時の異音。カラカラと鳴る。原因は油の不足。油を補充する。"),
    ("K2", "急ブレーキの後にペダルが奥まで沈む。走行を止めて点検する。"),
    ("K3", "電気自動車の急速充電で失敗の表示。更新で直る。無償。"),
    ("K4", "窓が上がらない。モーターを交換する。"),
    ("K5", "雨の日に天井から水が漏れる。排水の管をつなぎ直す。"),
    ("K6", "冷房から風が出ない。冷媒を補う。"),
]


@pytest.mark.parametrize(
    "question, expected",
    [
        ("エンジンがカラカラと鳴ります", "K1"),
        ("ブレーキのペダルが沈みます", "K2"),
        ("急速充電が失敗します", "K3"),
    ],
)
def test_scenarios(spark, question, expected):
    cases = spark.createDataFrame(CASES, "case_id string, text string")
    index = TI.build_text_index(cases, new_path(spark, "t"), "case_id")
    asked = spark.createDataFrame([(1, question)], "request_id int, text string")
    assert text_topk(index, asked, 3).orderBy("rank").first().id == expected


def test_copies_of_a_text_are_dealt_once_a_task(spark):
    texts = spark.createDataFrame([(b"u", "the same words")] * 500 + [(b"v", None), (b"v", "")], "unit binary, text string")
    one = texts.coalesce(1)
    assert rows(TI._without_copies(one).select("unit"), "unit") == [(b"u",), (b"v",)]
    counts = TI._counted(one, 3)
    # Texts are dealt by unit; no list of tokens is dealt again.
    assert plan(counts).count("Exchange hashpartitioning") == 1
    assert rows(counts.select("token", "tf"), "token") == [("same", 1), ("the", 1), ("words", 1)]


def test_only_asked_tokens_have_champions(spark, index):
    asked = spark.createDataFrame([(b"q", "w1", 1.0, 1.5, 9)], "asker binary, token string, qw double, idf double, df long")
    found = text_search._champions(index, asked)
    assert [r.token for r in found.select("token").distinct().collect()] == ["w1"]
    top = index.tops.filter("token = 'w1'").first().top * 1.5
    assert abs(found.agg(F.max("w")).first()[0] - top) < 1e-12
    split = text_search._split(index, asked, lambda: F.lit(True), 1)
    assert split.filter("token = 'w1'").count() == 1


@pytest.mark.parametrize("limit", [10**8, 0])
def test_passages_are_not_dealt_to_meet_the_ranked_rows(spark, tmp_path, limit):
    spark.range(500).selectExpr("id AS k", "repeat('x', 100) AS answer").write.parquet(str(tmp_path / "p"))
    passages = spark.read.parquet(str(tmp_path / "p"))
    hits = spark.createDataFrame([(1, 5), (2, 5), (3, None), (4, 900)], "request_id int, id long")
    found = text_search.with_passages(hits, passages, "k", "answer", limit=limit)
    assert rows(found.select("request_id", "id"), "request_id") == [(1, 5), (2, 5)]
    if limit:
        assert "Exchange hashpartitioning" not in plan(found)
