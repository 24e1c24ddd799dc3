"""The operators' methods against brute force, nearly all without Spark."""

import random
import re
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wayscore.llm import common, decontamination, embeddings, minhash, packing, pii, quality, tagger, tokens, toxicity


def test_folding_undoes_disguises():
    assert toxicity.fold("ІDIОT  l0ser! $tup1d ｍoron café 2024 a-b") == [
        b"idiot", b"loser", b"stupid", b"moron", b"cafe", b"a", b"b",
    ]


@pytest.mark.parametrize("text", ["1d1ot", "!d!ot", "@idiot", "idiot1", "1DI0T!!", "5idiot", "ID10T"])
def test_disguised_words_are_found_from_the_first_letter(text):
    lexicon = toxicity.Lexicon({b" idiot ": 3.0})
    assert lexicon.evidence(f"you {text}, go") == (3.0, 3)


def test_one_may_be_an_l():
    lexicon = toxicity.Lexicon({b" loser ": 3.0, b" asshole ": 4.0})
    assert lexicon.evidence("1oser")[0] == 3 and lexicon.evidence("a55ho1e")[0] == 4 and lexicon.evidence("asshol3")[0] == 4
    assert toxicity.read("10 2024 3.5 -- !!") == ([], [])


def test_long_runs_are_read_but_not_kept():
    toxicity._kept_readings.cache_clear()
    run = "a1" * 500_000
    words, others = toxicity.read(f"{run} 1diot")
    assert words == [b"ai" * 499_999 + b"a", b"idiot"] and b"al" * 500_000 in others
    assert toxicity._kept_readings.cache_info().currsize == 1


def test_exception_phrases_excuse_hits():
    lexicon = toxicity.Lexicon({b" trash ": 3.0, b" lowei": 2.0}, (b"trash can",))
    assert lexicon.evidence("the trash can")[0] == 0
    assert lexicon.evidence("a trash and a trash can")[0] == 3
    assert lexicon.evidence("loweist slowei")[0] == 2
    assert 0 <= lexicon.score("") < lexicon.score("trash") <= 1


def test_trie_counts_equal_word_by_word_counts():
    pieces = tokens.vocabulary("piece_bpe_32k.model")
    rng = random.Random(3)
    words = {"▁" + "".join(rng.choice("abcdeé日🙂.") for _ in range(rng.randint(1, 20))) for _ in range(400)}
    words |= {"▁" + "ab" * 60, "▁the", "▁them", "▁theme", "▁"}
    assert pieces.many(sorted(words)) == {w: pieces.one(w) for w in words}


def test_trie_tells_nul_characters_from_the_end():
    pieces = tokens.vocabulary("piece_bpe_32k.model")
    for words in (["▁a", "▁a\0"], ["▁a\0", "▁a\0\0"], ["▁\0"], ["▁\0a", "▁a", "▁a\0b", "▁the", "▁the\0"]):
        assert pieces.many(words) == {w: pieces.one(w) for w in words}


def test_count_of_a_very_long_pretoken():
    pieces = tokens.vocabulary("piece_bpe_32k.model")
    char = "\U000e0001"
    assert char not in pieces.costs and pieces.many([char * 262_144 + "ab"]) == {char * 262_144 + "ab": 2**20 + pieces.one("ab")}


@pytest.mark.parametrize(
    "text",
    ["", " ", "a  b \n\n c\t\td  ", "<|endoftext|> x", "it's 'S we'll", "日本語 x² ½ ٣٤", "nb\xa0sp \x85 \x1c x", "  lead", "trail \n", "🙂🙂 ok, so."],
)
def test_ids_are_the_tokenizers(text):
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    assert np.frombuffer(packing.tokenizer().ids(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(
    "text", ["a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "x<|endoftext|>\n", " <|endoftext|>", "<|endoftext| >", "plain text"]
)
def test_documents_hold_added_tokens(text):
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert np.frombuffer(packing.tokenizer().document(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids


def test_sum_of_squares_placement_and_tail():
    rng = np.random.default_rng(0)
    packer, sizes, squares = packing.Packer(0, 64), rng.integers(1, 200, 300), []
    for i, n in enumerate(sizes):
        before = packer.level.copy()
        packer.add(i, rng.integers(0, 99, n).astype("<u4").tobytes())
        rest = n % 64
        if rest:
            options = []
            for h in range(0, 64 - rest + 1):
                if h and not before[h]:
                    continue
                level = before.copy()
                if h:
                    level[h] -= 1
                if h + rest < 64:
                    level[h + rest] += 1
                options.append(int((level[:64] ** 2).sum()))
            squares.append(int((packer.level[:64] ** 2).sum()) == min(options))
    assert all(squares)
    packer.finish()
    out = packer.take()
    assert out.groupby("doc_id")["length"].sum().tolist() == sizes.tolist()
    filled = out.groupby("sequence_id")["length"].sum()
    assert all(n == 64 or n & (n - 1) == 0 for n in filled)
    for _, part in out.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *part["length"].cumsum()[:-1]]


def test_bag_minhash_estimates_weighted_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for vocabulary in (400, 3, 8) * 5:
        a = [f"w{i}" for i in rng.integers(0, vocabulary, 300)]
        b = a[: 300 - int(rng.integers(0, 200))] + ["other", "words", "here"] * 10
        bags = [minhash.shingles(a), minhash.shingles(b)]
        signs = minhash.signatures(bags, 2048)
        errors.append((signs[0] == signs[1]).mean() - minhash.overlap(*bags))
    assert abs(np.mean(errors)) < 0.012 and np.max(np.abs(errors)) < 0.06


def edits_of(item: str, text: str) -> int:
    """Fewest edits of the item in any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_leaks_within_the_budget_are_found():
    rng = random.Random(5)
    item = "".join(rng.choice("abcdefg hij") for _ in range(120))
    index = decontamination.Index.of([(7, item)])
    for _ in range(40):
        chars = list(item)
        for _ in range(rng.randint(0, 14)):
            at, kind = rng.randrange(len(chars)), rng.random()
            if kind < 0.34:
                chars[at] = rng.choice("xyz")
            elif kind < 0.67:
                chars.insert(at, rng.choice("xyz"))
            else:
                del chars[at]
        text = "before " * rng.randint(0, 4) + "".join(chars) + " after" * rng.randint(0, 4)
        least = edits_of(item, text)
        found = index.matches(text)
        assert bool(found) == (least <= decontamination.budget(len(item)))
        if found:
            assert found[0][1] == least


def test_base_spans_follow_the_patterns():
    text = "a.b@x.com. c@d e@f.gg 300.1.1.1 1.2.3.4.5.6.7.8 +49 30 1234567 4111 1111-1111 1111 " + "9" * 5000
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    spans = pii.base_spans(text)
    assert [(a, b) for a, k, b in spans if k == 0] == [m.span() for m in email.finditer(text)]
    good = [m.span() for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    assert [(a, b) for a, k, b in spans if k == 1] == good
    assert [text[a:b] for a, k, b in spans if k == 3] == []  # the phone match runs on into the card
    assert pii.redact("x a@b.cc y", pii.base_spans("x a@b.cc y")) == "x [EMAIL] y"


def test_crf_marginals_and_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    emit, move = rng.normal(size=(4, 1, 3)), rng.normal(size=(3, 3))
    paths = np.stack(np.meshgrid(*[range(3)] * 4, indexing="ij"), -1).reshape(-1, 4)
    score = [sum(emit[t, 0, p[t]] for t in range(4)) + sum(move[a, b] for a, b in pairwise(p)) for p in paths]
    weight = np.exp(score) / np.exp(score).sum()
    marginal = np.exp(tagger._marginals(emit, move)[0])[:, 0]
    expected = [[weight[paths[:, t] == k].sum() for k in range(3)] for t in range(4)]
    assert np.allclose(marginal, expected)


def test_trained_tagger_on_held_out_windows():
    x, y = pii.labelled_windows(400, seed=99)
    found = pii.trained().window_marginals(x.T.astype(np.int64)).argmax(2).T
    assert (found == y).mean() > 0.94


def test_dual_coordinate_descent_separates():
    rows = [np.array([0, 2]), np.array([0]), np.array([1, 2]), np.array([1])]
    w = quality.dual_coordinate_descent(rows, [np.ones(len(r)) for r in rows], np.array([1, 1, -1, -1]), 3, np.full(4, 1.0))
    assert w[0] > 0 > w[1] and abs(w[2]) < 0.2


def test_more_signs_for_more_vectors():
    assert embeddings.plan(10**9, 0.95)[0] > embeddings.plan(10**4, 0.95)[0]
    for n in (10, 10**5, 10**8):
        signs, tables = embeddings.plan(n, 0.95)
        assert (1 - (1 - np.arccos(0.95) / np.pi) ** signs) ** tables <= 1e-4


def test_batches_keep_a_smaller_number_of_the_session(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for given, wanted in (("10000", "1000"), ("0", "1000"), ("50", "50")):
            spark.conf.set(key, given)
            common.prepare_workers(spark)
            assert spark.conf.get(key) == wanted
    finally:
        spark.conf.set(key, before)


def test_frugal_work_gives_the_same_batches():
    assert list(common.frugal(lambda batches: (2 * b for b in batches))(iter([1, 2, 3]))) == [2, 4, 6]
    assert list(common.frugal(iter)(iter([]))) == []
