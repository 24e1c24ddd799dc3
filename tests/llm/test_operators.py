"""Each operator on small tables with missing, empty, long, repeated and clashing input."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayscore.llm import (
    common, decontamination, embeddings, language, minhash, packing, pii, quality, queries, secret_scan, tokens, toxicity,
)
from wayscore.llm.components import connected_components
from wayscore.session import store

LONG = "word " * 20_000 + "end"
TEXTS = [
    (1, "a plain text of some six words"), (2, None), (3, ""), (4, LONG), (5, "a plain text of some six words"),
    (5, "a plain text of some six words"), (None, "no id here at all"), (6, " \n\t "), (7, "x" * 50_000),
]


@pytest.fixture(scope="module")
def docs(spark):
    """With extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return store(df.select("doc_id", "text", *(F.lit(0).alias(c) for c in ("score", "node", "row", "spans", "n"))), "docs")


@pytest.fixture(scope="module")
def empty(docs):
    return store(docs.limit(0), "none")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, 1, int(i % 2 == 0)) for i in range(1, 8)] + [(None, None, None), (1, 1, 1), (99, None, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def run_all(docs, labels, benchmark):
    yield toxicity.score_documents(docs, toxicity.train_on(docs, labels))
    yield quality.score_documents(docs, quality.train_on(docs, labels))
    yield tokens.token_counts(docs)
    yield secret_scan.find_secrets(docs)
    yield pii.find_personal_data(docs)
    yield language.score_documents(docs, language.train(docs))
    yield minhash.near_duplicates(docs)


def test_one_row_per_row(spark, docs, labels):
    benchmark = spark.createDataFrame([(1, None), (2, "short"), (None, "x")], "item_id long, text string")
    for out in run_all(docs, labels, benchmark):
        found = [r.doc_id for r in out.select("doc_id").collect()]
        assert Counter(found) == Counter(i for i, _ in TEXTS)
    assert decontamination.find_leaks(docs, benchmark).count() == 0
    assert decontamination.without_leaks(docs, benchmark).columns == docs.columns


def test_odd_characters(spark, labels):
    """NUL, controls, unusual white space and marks, astral letters: every row is kept, words are counted alike."""
    odd = ["a\0", "a", "\0", "a\0b the\0 the", "x\x1cy\x85z", "\u2028\u3000\xa0", "\u200b\ufeff", "e\u0301" * 30, "𝒳🙂 \U0010ffff", "\x7f\x0b\x0c"]
    rows = [*enumerate(odd), *((100 + i, f"{t} {t} some more words of a text {t}") for i, t in enumerate(odd))]
    df = store(spark.createDataFrame(rows, "doc_id long, text string").repartition(1), "odd")
    benchmark = spark.createDataFrame([(1, "\0" * 80), (2, "e\u0301" * 60)], "item_id long, text string")
    for out in run_all(df, labels, benchmark):
        assert sorted(r.doc_id for r in out.select("doc_id").collect()) == [i for i, _ in rows]
    assert packing.pack_documents(df).select("doc_id").distinct().count() == len(rows)
    assert {r.doc_id for r in decontamination.find_leaks(df, benchmark).select("doc_id").collect()} <= {i for i, _ in rows}
    pieces = tokens.vocabulary("piece_bpe_32k.model")
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in tokens.token_counts(df).collect()}
    assert got == {i: (len(t.split()), sum(pieces.one("▁" + w) for w in t.split())) for i, t in rows}
    for r in pii.find_personal_data(df).collect() + secret_scan.find_secrets(df).collect():
        assert r.base_sha256 == hashlib.sha256(b"").hexdigest()


def test_empty_tables(spark, empty, labels):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    for out in run_all(empty, labels.limit(0), benchmark):
        assert out.count() == 0
    assert packing.pack_documents(empty).count() == 0
    assert decontamination.find_leaks(empty, benchmark).count() == 0


def test_near_duplicate_classes(spark):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in rng.integers(0, 5000, 120)]
    rows = []
    for i in range(40):  # a chain: each differs a little from the one before
        words = base[:]
        for k in range(i):
            words[(k * 7) % 120] = f"n{k}"
        rows.append((i, " ".join(words)))
    rows += [(50, "Same  TEXT here of six words"), (51, "same text here of six words"), (52, None), (53, ""), (54, "")]
    df = store(spark.createDataFrame(rows, "doc_id long, text string"), "near")
    got = {r.doc_id: (r.class_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    bags = {i: minhash.shingles((t or "").lower().split()) for i, t in rows}
    parent = {i: i for i, _ in rows}
    for _ in range(len(rows)):
        for a in bags:
            for b in bags:
                if minhash.overlap(bags[a], bags[b]) >= 0.8:
                    parent[a] = parent[b] = min(parent[a], parent[b])
    assert {i: c for i, (c, _) in got.items()} == parent
    assert all(kept == (i == c) for i, (c, kept) in got.items())
    assert minhash.without_near_duplicates(df).count() == len(set(parent.values()))


def test_places_do_not_follow_the_split(spark):
    words = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(300)]
    rows = spark.createDataFrame([(i, words[i % 300]) for i in range(900)], "doc_id long, text string")
    df = store(rows.select("*", F.lit(1).alias("_metadata"), F.lit(2).alias("file"), F.lit(3).alias("index")).coalesce(2), "places")
    key, seen = "spark.sql.files.maxPartitionBytes", []
    before = spark.conf.get(key)
    try:
        for size in ("128m", "2k"):
            spark.conf.set(key, size)
            file, index = minhash.place(df)
            seen.append(df.select(file.alias("a"), index.alias("b"), "doc_id"))
            seen[-1] = (seen[-1].rdd.getNumPartitions(), {(r.a, r.b): r.doc_id for r in seen[-1].collect()})
        assert seen[0][0] != seen[1][0] and seen[0][1] == seen[1][1] and len(seen[0][1]) == 900
        left = minhash.without_near_duplicates(df)
        assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == list(range(300))
    finally:
        spark.conf.set(key, before)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (200, 100), (5, 5), (40, 41), (41, 40)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"))
    got = {r.node: r.component for r in found.collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, 200: 100, 40: 40, 41: 40}


def test_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)  # several blocks per bucket
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 150)] + 0.12 * rng.normal(size=(150, 16))).astype("float32")
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200 + i, x[3].tolist()) for i in range(3)]
    bad = [(300, None), (301, []), (302, [0.0] * 16), (303, [None] + [1.0] * 15), (304, [float("nan")] * 16), (305, x[3].tolist()[:8])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    y = np.array([v for _, v in rows], float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    linked = (y @ y.T >= 0.95) & ~np.eye(len(y), dtype=bool)
    ids = np.array([i for i, _ in rows])
    root = ids.copy()
    for _ in range(len(ids)):
        root = np.array([min(root[i], *root[linked[i]]) if linked[i].any() else root[i] for i in range(len(ids))])
    assert [got[i].n_links for i in ids] == linked.sum(1).tolist()
    assert [got[i].component_id for i in ids] == root.tolist()
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, _ in bad)


def test_language_scores(spark):
    rows = [(i, f"The cat {'sat' if i % 2 else 'ran'} on mat{i % 5} x{i}") for i in range(60)] + [(60, None), (61, "unseen words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = df.where("doc_id < 50")
    got = {r.doc_id: r for r in language.score_documents(df, language.train(train)).collect()}
    counts = Counter(w for i, t in rows if i < 50 for w in language.tokens(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        words = language.tokens(t or "")
        assert math.isclose(got[i].base_score, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words))
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(words), sum(w in counts for w in words), n)
    assert got[55].score > got[55].base_score
    assert got[60].held_out == (zlib.crc32(b"60") % 10 == 0)


class Automaton:
    """The whole automaton in one place: states are tuples of tokens, arcs and failure arcs as the module says."""

    def __init__(self, texts, priors=language.PRIORS):
        lines = [[language.START, *language.tokens(t)] for t in texts]
        self.counts = Counter(tuple(x[k : k + n]) for x in lines for n in (1, 2, 3) for k in range(len(x) - n + 1))
        words = {g: n for g, n in self.counts.items() if len(g) == 1 and g[0] != language.START}
        self.total, self.distinct, self.priors = sum(words.values()), len(words), priors

    def arc(self, state, word):
        """Weight of the arc, None where there is none; the root has an arc for every word."""
        if not state:
            return (self.counts[word,] + 0.1) / (self.total + 0.1 * (self.distinct + 1))
        n, prior = self.counts[*state, word], self.priors[len(state) - 1]
        return (n + prior * self.follow(state[1:], word)) / (self.counts[state] + prior) if n else None

    def fail(self, state):
        prior = self.priors[len(state) - 1]
        return prior / (self.counts[state] + prior)

    def follow(self, state, word):
        weight = self.arc(state, word)
        return self.fail(state) * self.follow(state[1:], word) if weight is None else weight

    def read(self, words):
        state, score = (language.START,), 0.0
        for word in words:
            score += math.log10(self.follow(state, word))
            state = (*state, word)[-2:]
            while state and not self.counts[state]:
                state = state[1:]
        return score


@pytest.mark.parametrize("chunk, bucket", [(language.CHUNK_TOKENS, language.BUCKET_TOKENS), (50, 40)])
def test_language_against_one_automaton(spark, chunk, bucket):
    """All n-grams count, and chunks give the automaton's own scores."""
    rng = np.random.default_rng(5)
    texts = ["rare pair here"] * 2 + [" ".join(rng.choice([f"w{i}" for i in range(30)], rng.integers(0, 40))) for _ in range(200)]
    rows = [*enumerate([*texts, "a rare pair here again", "new w1 w2 w3", "", "once"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = language.train(df.where(f"doc_id < {len(texts)}"), chunk_tokens=chunk)
    chunks = language.chunks_of(language._rows(df, F.lit(True), F.lit(False)), True, chunk)
    assert chunk > 50 or chunks.count() > 50
    automaton = Automaton(texts)
    for r in language.read_chunks(model.chunks.unionByName(chunks), bucket_tokens=bucket).collect():
        words = language.tokens(rows[r.doc_id][1])
        assert math.isclose(r.score, automaton.read(words), rel_tol=1e-9)
        assert math.isclose(r.base_score, sum(math.log10(automaton.arc((), w)) for w in words), rel_tol=1e-9)
        assert r.n_known == sum(automaton.counts[w,] > 0 for w in words) and r.train_tokens == automaton.total
    words = [w for (w, *more) in automaton.counts if not more and w != language.START]
    for state in [(), (language.START,), (b"rare",), (b"rare", b"pair"), (b"w1", b"w2")]:
        mass = sum(automaton.follow(state, w) for w in words) + automaton.follow(state, b"never seen")
        assert abs(mass - 1) < 1e-9


@pytest.mark.parametrize("most", [7, 60])
def test_language_adds_up_chunks_in_levels(spark, most):
    """Many chunks, all with the same common words, are answered as by one task per bucket."""
    rng = np.random.default_rng(8)
    rows = [(i, "the same start " + " ".join(rng.choice([f"w{i}" for i in range(20)], 6))) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    learned = F.col("doc_id") % 3 == 0
    chunks = language.chunks_of(language._rows(df, ~learned, learned), True, 1)
    only_learned = language.train(df.where(learned), chunk_tokens=1).chunks
    assert chunks.count() == 100
    whole, parted = (
        {r.doc_id: r for r in language.read_chunks(chunks.unionByName(only_learned), bucket_tokens=100, most=n).collect()}
        for n in (1_000, most)
    )
    assert whole == parted and len(whole) == 100


def test_levels_of_chunks():
    assert language.levels(0, 0, 21, 1_000_000, 4_000) == [(1, 0)]
    assert language.levels(300, 600_000_000, 50, 1_000_000, 4_000) == [(1, 10)]
    assert language.levels(10_000_000, 20_000_000_000_000, 64, 1_000_000, 4_000) == [(2500, 13), (1, 25)]
    assert language.levels(133, 1_330, 31, 100, 7) == [(19, 0), (3, 3), (1, 4)]


def test_language_learns_and_scores_in_one_go(spark, docs):
    """The same rows as training and scoring apart, in any split into chunks."""
    held = common.held_out(F.col("doc_id"), 10, 0)
    once = {(r.doc_id, r.n_tokens): r for r in language.score_by_rest(docs).collect()}
    apart = language.score_documents(docs.repartition(4), language.train(docs.where(~held)), chunk_tokens=1)
    for r in apart.collect():
        same = once[r.doc_id, r.n_tokens]
        assert np.allclose([r.score, r.base_score], [same.score, same.base_score]) and r.held_out == same.held_out
    nothing = language.score_documents(docs, language.train(docs.limit(0))).collect()
    assert all(r.score == r.base_score == 0 and r.n_known == 0 for r in nothing)


def test_planes_keep_numbers():
    for x in ([], [0], [255, 256], [2**64 - 1, 5], [7] * 300):
        assert language.unpack(language.pack(np.array(x, np.uint64))).tolist() == x
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 999, np.uint64))
    assert (language._keys_in(language._keys_out(keys)) == keys).all()


def test_secret_spans(spark):
    key = "Zx9Qw3Er7Ty1Ui5Op2As4Df"
    rows = [
        (1, f"🙂 k {key} tail"), (2, f"sha256: {key}"), (3, "token: token: abcdefgh"), (4, "API_KEY = 'abc123'"),
        (5, "AKIA" + "A" * 15 + " " + "AKIA" + "Z" * 16), (6, "f" * 30), (7, f"{key}example"), (8, "password=" + "0a" * 15),
    ]
    got = {r.doc_id: r for r in secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].spans == f"entropy:4:{4 + len(key)}" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert [got[i].spans for i in (2, 3, 7)] == ["", "", ""]
    assert got[4].spans == "assign:0:17" and got[4].base_sha256 == hashlib.sha256(b"assign:0:17").hexdigest()
    assert got[5].spans == "access:20:40" and got[6].spans == "hex:0:30"
    assert got[8].spans == "assign:0:39,hex:9:39"


def test_entropy_by_class_and_allowed_stretches(spark):
    rng = np.random.default_rng(11)
    upper = ["".join(rng.choice(list("0123456789ABCDEF"), 32)) for _ in range(30)]
    letters = "".join(rng.permutation(list("abcdefghijkmnpqrstuvwxyzABCDEFGHKLMNPQRSTUVWXYZ"))[:22])
    found = [*upper, *(f"id-{k}" for k in upper), *(f"sample/{k}/xxxxxxxx" for k in upper), f"{'0' * 9}-{letters}", letters]
    # The windows of the third stay below 3.0 in hex digits and below 3.6 with the z.
    none = ["123e4567-e89b-12d3-a456-426614174000", "example" * 5, "AB12" * 8 + "z", "x" * 40, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]
    df = spark.createDataFrame(list(enumerate(found + none)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secret_scan.find_secrets(df).collect()}
    assert [got[i] for i in range(len(found))] == [f"entropy:0:{len(t)}" for t in found]
    assert [got[len(found) + i] for i in range(len(none))] == [""] * len(none)


def test_largest_entropy(spark):
    texts = ["".join(np.random.default_rng(i).choice(list("abc123XY"), 30 + i)) for i in range(10)] + ["a" * 40, "short"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")

    def brute(t):
        windows = [t[i : i + 20] for i in range(len(t) - 19)]
        return max([0.0] + [-sum(n / 20 * math.log2(n / 20) for n in Counter(w).values()) for w in windows])

    got = [r[0] for r in df.select(secret_scan.largest_entropy(F.col("t"))).collect()]
    assert np.allclose(got, [brute(t) for t in texts])


def test_no_python_in_the_native_scan(spark, docs):
    text = secret_scan.find_secrets(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Pandas" not in text and "Exchange" not in text


def test_packing_keeps_every_id(spark, docs):
    out = packing.pack_documents(docs, 256).toPandas()
    assert out["length"].sum() == sum(len(packing.tokenizer().ids(t or "")) // 4 + 1 for _, t in TEXTS)
    filled = out.groupby("sequence_id")["length"].sum()
    assert all(n == 256 or n & (n - 1) == 0 for n in filled)


def test_packed_ids_of_added_tokens(spark):
    out = packing.pack_documents(spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string"), 8).collect()
    ids = np.array([64, 220, 50256, 275, packing.END_ID], "<u4").tobytes()
    assert [r.doc_tokens for r in out] == [5] * len(out)
    assert {(r.start, r.length): r.ids_crc32 for r in out} == {
        (r.start, r.length): zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) for r in out
    }


def test_copies_of_a_part_of_a_long_item(spark):
    words = [f"word{i * 7919 % 1009}" for i in range(120)]
    docs = [(1, "before " + " ".join(words[:102]) + " after"), (2, " ".join(words[25:94])), (3, " ".join(words)), (4, " ".join(words[30:60]))]
    df, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.find_leaks(df, benchmark).collect()}
    assert sorted(got) == [1, 2, 3] and all((r.item_id, r.edits) == (9, 0) for r in got.values())
    assert (got[1].start, got[3].start, got[3].end) == (7, 0, len(docs[2][1]))
    assert [r.doc_id for r in decontamination.without_leaks(df, benchmark).collect()] == [4]


def test_items_without_an_id(spark):
    df = spark.createDataFrame([(1, "so the quick brown fox jumps over the lazy dog it is"), (2, "else")], "doc_id long, text string")
    rows = [(None, "the quick brown fox jumps over the lazy dog"), (None, None), (3, "quick brown fox jumps over")]
    benchmark = spark.createDataFrame(rows, "item_id long, text string")
    got = decontamination.find_leaks(df, benchmark).collect()
    assert {(r.doc_id, r.item_id, r.edits) for r in got} == {(1, None, 0), (1, 3, 0)} and len(got) == 2
    assert [r.doc_id for r in decontamination.without_leaks(df, benchmark.limit(1)).collect()] == [2]


def test_sample_is_bounded_with_repeated_ids(spark):
    df = spark.createDataFrame([(1, f"text {i:02}") for i in range(50)] + [(2, "b"), (3, None), (4, "d")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i < 3)) for i in range(1, 5)], "doc_id long, quality int")
    got = common.labelled_sample(df, marks, "quality", lambda c: c.isNotNull(), 2, 2).collect()
    assert sorted(tuple(r) for r in got) == [(1, "text 00", 1), (2, "b", 1), (3, "", 0), (4, "d", 0)]


def test_leaks_in_blocks(spark):
    item = "the quick brown fox jumps over the lazy dog near the river bank"
    docs = spark.createDataFrame([(1, f"x {item.upper()} y"), (2, "nothing"), (3, item.replace("fox", "fix")), (3, None)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(10, item), (11, "another passage that nobody copied"), (12, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.edits) for r in decontamination.find_leaks(docs, benchmark, 40).collect()}
    assert got == {(1, 10, 0), (1, 12, 0), (3, 10, 1), (3, 12, 1)}
    assert sorted(r.doc_id for r in decontamination.without_leaks(docs, benchmark, block_chars=40).collect()) == [2, 3]


@pytest.mark.parametrize(("name", "column", "at_least"), [("op1_toxicity", "toxic", 0.9), ("op9_quality", "quality", 0.97)])
def test_held_out_accuracy(spark, name, column, at_least):
    given = "/root/testdata/sf0.01"
    out = queries.QUERIES[name](spark, given).where("held_out")
    known = out.join(spark.read.parquet(f"{given}/labels.parquet"), "doc_id").where(F.col(column).isNotNull())
    assert known.agg(F.avg((F.col("predicted") == F.col(column)).cast("int"))).first()[0] >= at_least


def test_vector_oracle(spark, given):
    from compare import connect, differences

    name = "op2_embeddings"
    assert differences(queries.QUERIES[name](spark, given), connect(given), queries.ORACLE_SQL[name]) == ""


def test_pipeline(spark, given):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{given}/documents.parquet")
    kinds = docs.dtypes
    for i, (name, stage) in enumerate(pipeline.STAGES):
        before = docs
        docs = store(stage(spark, docs, given), name)
        assert i == 4 or docs.dtypes == kinds
        if name == "personal_data":
            assert docs.count() == before.count()
            assert not any(pii.base_spans(r.text) for r in docs.collect())
        elif i < 4:
            assert 0.6 * before.count() < docs.count() <= before.count()
    assert docs.agg(F.countDistinct("doc_id")).first()[0] == before.count()
