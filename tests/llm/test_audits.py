"""Filter audit, archive and divergence against brute force and on missing, repeated and clashing input."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from wayscore.llm import archive, divergence, filter_audit, queries, text_tries
from wayscore.session import new_path, store

LONG = "word " * 30_000 + "end"
SAME = "Some shared START of texts " * 40


def document_rows():
    rows = [(i, SAME + f"and tail {i % 7}", "en", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, SAME * 3 + "x" * (i % 4), None, None) for i in range(20)]
    rows += [(7, SAME + "and tail 0", "en", "s0"), (0, SAME + "and tail 0", "en", "s2"), (None, SAME + "and tail 0", "en", "s1")]
    rows += [(200, None, "de", ""), (201, "", "de", "s9"), (202, LONG, "de", "s9"), (203, LONG, "fr", None), (None, None, None, None)]
    rows += [(204, "ÄÖÜ ß" * 300, "de", "s9"), (205, "a|b\x1c c d", "en", "s1"), (None, LONG, "de", "s1")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    """With extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(document_rows(), "doc_id long, text string, lang string, source string")
    return store(df.repartition(5).select("*", *(F.lit(0).alias(c) for c in ("tag", "mask", "n", "part", "term", "copy"))), "docs")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 2 == 0), int(i % 5 == 0)) for i in range(0, 250, 3)] + [(None, 1, 1), (3, 1, None), (7, None, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_trie_holds_every_text():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 99, rng.integers(0, 12)).tolist()) * int(rng.integers(1, 40)) for _ in range(500)]
    trie, seen = text_tries.TextTrie(), Counter()
    for t in texts:
        node = trie.terminal(t)
        node[0] = (node[0] or 0) + 1
        seen[t] += 1
    assert dict(trie.walk()) == seen
    assert trie.bytes <= sum(map(len, seen))
    assert len(seen) <= trie.nodes <= 2 * len(seen) + 1
    assert trie.size == trie.bytes + text_tries.NODE_BYTES * trie.nodes


def test_full_tries_close_between_prefixes():
    """Two prefixes that are far above the limit: one trie each, and every copy found in it."""
    names = ["text", "taken", "doc_id", "tag", "marks", "n"]
    texts = sorted([b"aaaa%d" % (i % 40) for i in range(120)] + [b"bbbb%d" % (i % 40) for i in range(120)], key=lambda t: t[:4])
    rows = pa.RecordBatch.from_pylist([dict(zip(names, (t, 4, i, "s", 0, 1))) for i, t in enumerate(texts)])
    out = pa.Table.from_batches(text_tries._last_rows(1_000)(iter([rows.slice(0, 100), rows.slice(100)]))).to_pylist()
    assert sorted(r["doc_id"] for r in out) == list(range(240))
    assert all(r["copy"] == (r["doc_id"] % 120 >= 40) for r in out)


@pytest.mark.parametrize("limits", [{}, {"local_bytes": 2_000, "range_bytes": 3_000}, {"local_bytes": 5_000, "range_bytes": 10**6}])
def test_copies_against_all_pairs(spark, docs, limits):
    found = text_tries.mark_copies(docs, F.coalesce("source", F.lit("")), len, **limits)
    got = Counter()
    for r in found.collect():
        got[r.doc_id, r.tag, r.marks, r.copy] += r.n
    first = {}
    for i, text, *_ in document_rows():
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    want = Counter()
    for i, text, _, source in document_rows():
        text = text or ""
        want[i, source or "", len(text.encode()), i is not None and i > first[text]] += 1
    assert got == want


def test_prefixes_grow_only_where_texts_share_them(spark):
    rows = [(b"same" * 400 + bytes([65 + i]),) for i in range(20)] + [(bytes([66 + i]) * 50,) for i in range(20)]
    df = store(spark.createDataFrame(rows, "text binary"), "texts")
    found = text_tries.adaptive_prefix(df, "text", 5_000)
    lengths = {bytes(r.text): min(r.taken, len(r.text)) for r in found.collect()}
    assert len(lengths) == found.count() == len(rows)
    assert all(n == (4 if t[:4] != b"same" else 1601) for t, n in lengths.items())


def brute_audit(docs, labels):
    first, good, toxic = {}, defaultdict(bool), defaultdict(bool)
    for i, q, t in labels:
        good[i] |= q == 1
        toxic[i] |= t == 1
    for i, text, *_ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    parts = defaultdict(list)
    for i, text, _, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        fails += "E" * (i is not None and i > first[text])
        parts[source or ""].append((fails, i is not None and good[i], i is not None and toxic[i]))
    out, shapley = {}, Counter()
    for part, rows in parts.items():
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                gone = [any(x in r[0] for x in order[:k]) for r in rows]
                removed = [r for r, g in zip(rows, gone) if f in r[0] and not g]
                shapley[part, f] += len(removed)
                out[part, "".join(order), k + 1] = [
                    sum(not g and f not in r[0] for r, g in zip(rows, gone)), len(removed),
                    sum(g and f in r[0] for r, g in zip(rows, gone)), sum(r[0] == f for r in rows),
                    sum(r[1] for r in removed), sum(r[2] for r in removed),
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_against_brute_force(spark, docs, labels):
    got = {tuple(r[:3]): tuple(r[3:]) for r in filter_audit.audit(docs, labels).collect()}
    assert got == brute_audit(document_rows(), [tuple(r) for r in labels.collect()])


def test_empty_audits(spark, docs, labels):
    none = store(docs.limit(0), "none")
    assert filter_audit.audit(none, labels).count() == 0
    assert divergence.divergence(none).count() == 0
    rows = filter_audit.audit(docs, store(labels.limit(0), "none")).agg(F.sum("good_lost"), F.max("kept")).first()
    assert rows[0] == 0 and rows[1] > 0


PAGES = [
    (1, "http://a/1", "x" * 1000), (5, "http://a/5", "x" * 1000), (3, None, "x" * 1000), (None, "http://a/n", "x" * 1000),
    (5, "http://b/5", "x" * 1000), (6, "u\r\nWARC-Type: bad %0D%", "y" * 999), (7, "", "y" * 999), (8, "u", None), (9, "u", ""),
    (None, None, None), (-4, "é", "ä" * 500), (-9, "e", "ä" * 500), (None, "z", "z" * 2000), (None, "z", "z" * 2000),
    (20, "l", "line\r\n\r\nWARC/1.1\r\nContent-Length: 1\r\n\r\n" * 30),
]


@pytest.fixture(scope="module")
def archived(spark):
    pages = spark.createDataFrame([(*p, 0, 0) for p in PAGES], "page_id long, url string, html string, digest int, owner int")
    path = new_path(spark, "warc")
    archive.write_archive(pages.repartition(4), path)
    return path


def test_archive_keeps_each_payload_once(spark, archived):
    payloads = [r.payload for r in spark.read.parquet(f"{archived}/payloads").collect()]
    assert sorted(payloads) == sorted({h or "" for *_, h in PAGES})


def test_records_come_back_whole(spark, archived):
    records = archive.read_archive(spark, archived)
    said = archive.fields(F.col("head"))
    got = records.select(*(said[c].alias(c) for c in ("page_id", "url", "record_type", "refers_to")), "payload").collect()
    largest = {}
    for key, _, html in PAGES:
        if key is not None:
            largest[html or ""] = max(key, largest.get(html or "", key))
    want = Counter()
    for key, url, html in PAGES:
        html = html or ""
        refers = largest.get(html) if len(html.encode()) >= 1000 and largest.get(html) != key else None
        want[key, url, "response" if refers is None else "revisit", refers, html] += 1
    assert Counter(map(tuple, got)) == want


def test_exported_files_parse_as_warc(spark, archived, tmp_path):
    archive.export_warc(spark, archived, f"{tmp_path}/out")
    seen = Counter()
    for path in (tmp_path / "out").glob("part-*"):
        data = path.read_bytes()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n")
            field = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            block, end, data = rest[: (n := int(field["Content-Length"]))], rest[n : n + 4], rest[n + 4 :]
            assert end == b"\r\n\r\n" and block.startswith(b"HTTP/1.1 200 OK\r\n")
            seen[field["WARC-Type"], block.partition(b"\r\n\r\n")[2].decode()] += 1
    assert sum(seen.values()) == len(PAGES)
    assert {b for t, b in seen if t == "revisit"} == {""} and sum(n for (t, _), n in seen.items() if t == "revisit") == 4
    assert {b for t, b in seen if t == "response"} == {h or "" for *_, h in PAGES}


def test_damaged_archives_are_told(spark, archived):
    path = new_path(spark, "damaged")
    spark.read.parquet(f"{archived}/headers").write.parquet(f"{path}/headers")
    spark.read.parquet(f"{archived}/payloads").where("length(payload) < 5").write.parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="no payload under SHA-256"):
        archive.read_archive(spark, path).collect()


def brute_divergence(rows, least=10, top=10):
    found, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
        found[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    kept = {g: {w for w, n in docs[g].items() if n >= least} for g in docs}
    out = []

    def price(n, size, v):
        return 1 + 10**9 * (n + 2) // (size + 2 * v)

    for (lang, source), counts in found.items():
        words = kept[lang]
        others = {s: c for (g, s), c in found.items() if g == lang}
        whole = sum(others.values(), Counter())
        size = {s: sum(c[w] for w in words) for s, c in others.items()}
        total, v = sum(whole[w] for w in words), len(words)
        worth = lambda p, q: (p - q) ** 2 // (p + q)
        p = {w: price(counts[w], size[source], v) for w in words}
        pairs = [(sum(worth(p[w], price(c[w], size[s], v)) for w in words), s) for s, c in others.items() if s != source]
        terms = [(worth(p[w], q), w) for w in words if counts[w] and p[w] > (q := price(whole[w], total, v))]
        for part, items in (("pair", pairs), ("term", terms)):
            items.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, i, f, k) for k, (f, i) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


def words_rows():
    rng = np.random.default_rng(5)
    rows = [
        (i, " ".join(f"{w}Wé" if w % 3 else f"T{w}".replace("1", "x") for w in rng.zipf(1.4, 60) % 400), "en", f"s{i % 9}")
        for i in range(150)
    ]
    return rows + [(500, "only rare words here", "en", "late"), (501, None, "en", None), *document_rows()]


@pytest.mark.parametrize("blocks", [None, (16, 2)])
def test_divergence_against_brute_force(spark, blocks, monkeypatch):
    if blocks:  # several blocks of terms and of sources
        plain = divergence.pairs
        monkeypatch.setattr(divergence, "pairs", lambda kept, groups: plain(kept, groups, *blocks))
    df = spark.createDataFrame(words_rows(), "doc_id long, text string, lang string, source string")
    got = divergence.divergence(df.select("*", F.lit(0).alias("term"), F.lit(1).alias("p")))
    assert sorted(map(tuple, got.collect())) == brute_divergence(words_rows())


def test_products_of_few_columns_give_the_same(monkeypatch):
    rng = np.random.default_rng(2)
    counts = rng.poisson(1.5, (90, 7)) * rng.integers(1, 90, (90, 1))
    prices = 1 + 10**9 * (counts + 2) // (counts.sum(0) + 180)
    want = [[divergence.worth(prices[:, a], prices[:, b]).sum() for b in range(7)] for a in range(7)]
    for columns in (1, 20, 4_000):
        assert (divergence.pair_values(counts, prices, columns) == want).all()
    large = np.array([10**9 + 1]), np.array([1])
    assert int(divergence.worth(*large)[0]) == 10**18 // (10**9 + 2)


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_warc", "op13_divergence"])
def test_same_as_sql(spark, given, name):
    assert differences(queries.QUERIES[name](spark, given), connect(given), queries.ORACLE_SQL[name]) == ""


def test_no_python_in_the_archive(spark, given, archived):
    plan = archive.read_archive(spark, archived, size=F.octet_length("payload"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
