"""Operators against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import rows_of, rows_of_sql

from fieldmill.llm import decontaminate, fingerprint, jaccard_join, langid, packing, registry, substring_dedup, token_counts, token_store, tokens, url_filter
from fieldmill.llm.common import scratch
from fieldmill.llm.html_extract import main_text


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return lambda x: t.encode(x, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert rows_of(registry.QUERIES[name](spark, sf)) == rows_of_sql(registry.ORACLES[name], sf)


def test_token_counts_against_all_cuts(spark, sf, texts):
    model = token_counts.Unigram(token_counts.default_path())

    def best(word):
        b, f = word.encode(), [(0, 0)]
        for i in range(1, len(b) + 1):
            f.append(max((f[j][0] + model.score[b[j:i]], f[j][1] - 1) for j in range(i) if b[j:i] in model.score))
        return -f[-1][1]

    known = {}
    for r in token_counts.op1_token_counts(spark, sf).collect():
        words = model.split(texts[r.doc_id])
        for w in words:
            if w not in known:
                known[w] = best(w)
        assert (r.n_pretokens, r.n_tokens) == (len(words), sum(map(known.__getitem__, words)))


def test_encoder_equals_library(tokenizer):
    rng = random.Random(1)
    given = ["".join(rng.choice([" ", "\n", "a", "é", "1", ".", "'s", "  ", " ", "\x85", "\t", "<|endoftext|>", "ab", "漢"]) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    import pyarrow as pa

    enc = tokens.Encoder(tokens.default_path())
    assert [np.frombuffer(x, dtype=enc.dtype).tolist() for x in enc.batch(pa.array(given))] == list(map(tokenizer, given))


def test_store_round_trip(spark, sf, texts, tokenizer):
    folder = scratch(spark, "store")
    manifest = token_store.write_store(spark.read.parquet(f"{sf}/documents.parquet"), folder)
    start = 0
    for r in token_store.read_store(spark, folder, manifest).orderBy("doc_id").collect():
        ids = [*tokenizer(texts[r.doc_id]), 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    opened = token_store.TokenStore(folder, manifest)
    assert opened.get(17)[0].tolist() == [*tokenizer(texts[17]), 0] and opened.get(10**9) == [] and opened.get(None) == []


def test_store_with_null_and_repeated_keys(spark, odd):
    folder = scratch(spark, "store")
    opened = token_store.TokenStore(folder, token_store.write_store(odd, folder, shards=3))
    assert len(opened.get(None)) == 2 and len(opened.get(11)) == 2 and len(opened.get(12)) == 2 and len(opened.get(1)) == 1


def test_store_with_a_hot_key(spark, tokenizer):
    """Keys that a third of all rows have, and none, are split over shards, in order."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i * 37 % 1000} of a row") for i in range(900)] + [(None, None)]
    folder = scratch(spark, "store")
    manifest = token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), folder, shards=6)
    assert sum(m["nulls"] > 0 for m in manifest) >= 2 and sum((m["low"] or 0) <= 7 <= (m["high"] or 0) for m in manifest) >= 2
    opened = token_store.TokenStore(folder, manifest)
    for key in (None, 7, 8, 899):
        want = sorted((t or "") for k, t in rows if k == key)
        assert [x.tolist() for x in opened.get(key)] == [[*tokenizer(t), 0] for t in want]
    got = token_store.read_store(spark, folder, manifest).collect()
    assert len(got) == 901 and sorted(r.start for r in got)[0] == 0 and sum(r.n_tokens for r in got) == sum(m["n_tokens"] for m in manifest)


def test_perfect_hash_is_minimal():
    for n in (1, 2, 3, 50, 3000):
        h = token_store.key_hashes(np.arange(n) * 7, np.zeros(n, dtype=bool))
        assert sorted(token_store.slots(h, token_store.perfect_hash(h), n).tolist()) == list(range(n))


def test_cuts_are_optimal():
    rng = random.Random(2)
    length, hard, full = 16, 8, 2
    for _ in range(200):
        at = np.cumsum([rng.randint(1, 30) for _ in range(rng.randint(1, 30))])
        cost = np.array([rng.choice([0, 2]) for _ in at])
        out, price, before, total = packing.cuts(at, cost, length, hard, full), {}, 0, 0
        for a, c in zip(at.tolist(), cost.tolist()):
            price[a] = min(price.get(a, 99), c)
        for e in out:
            assert 0 < e - before <= length
            total, before = total + length - (e - before) + price.get(e, hard), e
        f = [0]
        for i, x in enumerate(at.tolist()):
            options = [f[j] + (-(-(x - y) // length) - 1) * hard + -(x - y) % length + cost[i] for j, y in enumerate([0, *at.tolist()[:i]]) if -(-(x - y) // length) - 1 <= full]
            f.append(min(options, default=10**9))
        assert total <= f[-1]


def test_packing_covers_every_id_once(spark, sf, texts, tokenizer):
    rows = packing.op4_packing(spark, sf).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, text in texts.items():
        ids, at = [*tokenizer(text), 1], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    sizes = []
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 2048
        sizes.append(at)
    assert sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes) < 0.02 * sum(sizes)


def shingles(text, k):
    w = text.encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def linked(texts, k, percent):
    sets, where, up = {i: shingles(t, k) for i, t in texts.items()}, defaultdict(list), {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sorted(sets):
        common = Counter(j for x in sets[i] for j in where[x])
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
        for x in sets[i]:
            where[x].append(i)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
@pytest.mark.parametrize("block", [1000, 5])
def test_jaccard_join_against_all_pairs(spark, texts, k, percent, block, monkeypatch):
    """Also with shells of a few documents taken for heavy ones, so that levels of pivots and blocks are used."""
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", block)
    monkeypatch.setattr(jaccard_join, "FITTING", 256 if block == 1000 else 2)
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 4000)}" for _ in range(120)]
    given = dict(texts)
    for i in range(60):  # copies of one text with a few other words, near and at the threshold
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 9)}"
        given[10_000 + i] = " ".join(words)
    df = spark.createDataFrame(list(given.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_components(df, k, percent).collect()}
    assert got == linked(given, k, percent)


def test_region_join_recursion_is_exact():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**60, (6, 200)).astype(np.uint64)
    sets = []
    for i in range(300):
        s = base[i % 6].copy()
        s[rng.choice(200, rng.integers(0, 30), replace=False)] = rng.integers(0, 2**60)
        sets.append(np.unique(s))
    forest = jaccard_join.Forest(len(sets))
    for i, j in jaccard_join.join_region(sets, 90):
        assert jaccard_join.similar(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), 90)
        forest.link(i, j)
    for i in range(len(sets)):
        for j in range(i):
            if jaccard_join.similar(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), 90):
                assert forest.root(i) == forest.root(j)


def test_substring_dedup_against_all_spans(spark, sf, texts):
    first, spans, split = {}, {}, {i: substring_dedup.sentences(t) for i, t in texts.items()}
    assert all("".join(s) == texts[i] for i, s in split.items())
    for i in sorted(split):
        words = [s.encode().lower().split() for s in split[i]]
        own, found = [j for j, w in enumerate(words) if w], set()
        size = [len(words[j]) for j in own]
        for a in range(len(own)):
            ahead = [b for b in range(a + 1, len(own)) if sum(size[a : b + 1]) >= substring_dedup.WORDS]
            behind = [b for b in range(a) if sum(size[b : a + 1]) >= substring_dedup.WORDS]
            found |= {(a, ahead[0])} if ahead else set()
            found |= {(behind[-1], a)} if behind else set()
            found |= {(a, a)} if size[a] >= substring_dedup.LONG else set()
        spans[i] = [(own[a], own[b], tuple(w for j in own[a : b + 1] for w in words[j])) for a, b in sorted(found)]
        for a, _, key in spans[i]:
            first.setdefault(key, (i, a))
    for r in substring_dedup.op6_substring_dedup(spark, sf).collect():
        gone = {j for a, b, key in spans[r.doc_id] if first[key] != (r.doc_id, a) for j in range(a, b + 1)}
        left = "".join(s for j, s in enumerate(split[r.doc_id]) if j not in gone)
        assert r.n_removed == len(gone) and r.text == (left.rstrip() if gone else left)


def test_passages_are_caught_and_clean_texts_stay(spark):
    passage = "The old mill stood by the river for a hundred years. Nobody could say who had built it or why. Children played there in the summer and told each other stories. In winter the wheel froze and the miller slept until the thaw came at last in spring."
    own = [f"Document {i} has its own words here. {' '.join(f'u{i}w{j}' for j in range(30))}." for i in range(4)]
    rows = [(0, own[0]), (1, f"{own[1]} {passage} {own[1][::-1]}."), (2, f"{own[2]}\n{passage}\nAfter."), (3, own[3])]
    got = {r.doc_id: r.text for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == own[0] and got[3] == own[3] and got[1] == rows[1][1] and "miller" not in got[2] and "After." in got[2]


def test_fingerprints(spark, sf, documents):
    rows = sorted(documents.collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in fingerprint.op9_fingerprints(spark, sf).collect()}
    errors, prints = [], {}
    for i, r in enumerate(rows):
        other = rows[(i + 1) % len(rows)].text
        edited = fingerprint.edited(r.text, other)
        g = got[r.doc_id]
        assert g.n_chars == len(r.text) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(r.text, g.fingerprint) == g.fingerprint
        a, b = shingles(r.text, 5), shingles(edited, 5)
        if min(len(a), len(b)) > 100:
            errors.append(g.near_edited - len(a & b) / len(a | b))
    assert len(prints) == len(set(prints.values())) and abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_language_accuracy_and_spans(spark, sf, documents):
    rows = langid.op3_language_id(spark, sf).join(documents.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    model = langid.train(documents)
    one = {lang: documents.filter(f"lang = '{lang}' and n_chars > 1500").first().text[:1200] for lang in ("fr", "de")}
    mixed = spark.createDataFrame([(1, one["fr"] + " " + one["de"]), (2, "123 ...")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(mixed, model).collect()}
    assert [s.lang for s in got[1].spans] == ["fr", "de"] and got[2].lang_pred == "und" and got[2].score == 0


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(5)
    model = langid.Model(["a", "b", "c"], np.ones((langid.CELLS, 3)), np.ones((len(langid.NAMES), 3)))
    sizes = [0, 1, 5, 3, 6, 0]
    ends = np.cumsum(sizes)
    s = rng.normal(0, 3, (ends[-1], 3)).astype(np.float32)
    got = model.label(s, ends, 2.0)
    import itertools

    for n, e in zip(sizes, ends):
        if n:
            value = lambda p: sum(float(s[e - n + i, x]) for i, x in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:]))  # noqa: E731, B023
            assert value(got[e - n : e].tolist()) == pytest.approx(max(map(value, itertools.product(range(3), repeat=n))))


def test_seeds_bear_substitutions(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    words = item.split()
    words[4] = words[13] = "other"
    docs = spark.createDataFrame([(1, "Before, " + ", ".join(words).upper() + " after"), (2, "nothing of this kind at all in here"), (3, " ".join(words[:6]))], "doc_id long, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.start, r.n_equal) for r in got] == [(1, 9, 1, 18)]


def test_decontamination_has_no_python(spark, sf):
    plan = decontaminate.op10_decontamination(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


PAGES = [
    ('<article><header><h1>T &lt; x</h1></header><p>a&nbsp;b\n c<p>d<br>e<br><br>f<aside>no</aside><section class="comments"><article>c1</article></section></article><p>out', "T < x\n\na b c\n\nd e\n\nf"),
    ('<nav><a href="/">Home</a></nav><div class="ad">Buy</div><article><h1>Hi</h1><p>One.</article><footer>f</footer>', "Hi\n\nOne."),
    ('<script>var t="</p>";</script><style>p{}</style><main><p>Text</p><form><p>Name</p></form><div class="cookie-notice">c</div></main>', "Text"),
    ("<!-- <p>no</p> --><article><p>x &amp; y &#233; &eacute;</p></article>", "x & y é é"),
    ('<body class="has-sidebar"><div class="content no-sidebar ad-free"><article><p>Text</p><div class="share-buttons">s</div></article></div><div id="sidebar">x</div></body>', "Text"),
    ("", ""),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_main_text(page, want):
    assert main_text(page) == want


def test_blocks_without_an_article():
    body = "This is the story of a man who was in the house and it is long enough to be good for the reader of it."
    page = f'<div>Menu</div><h2>Title</h2><p>{body}</p><p>Short.</p><p>{body}</p><p><a href="x">{body}</a></p><p>Imprint</p>'
    assert main_text(page) == f"Title\n\n{body}\n\nShort.\n\n{body}"


def test_rules_and_reputation(spark):
    urls = ["http://A.net/x", "http://b.example.net/en/1?q", "http://example.com/de/", "http://x.org/fr/#t", "http://x.org", "no url", "http://a.net?x", "http://evil.example/", "http://anet/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    more = spark.createDataFrame([(100 + i, f"http://evil.example/{i}") for i in range(60)] + [(200 + i, f"http://good{i}.example/") for i in range(60)], pages.schema)
    outcomes = more.selectExpr("page_id", "int(page_id < 200) AS bad")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages.union(more), outcomes).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block") and got[1] == ("b.example.net", "/en/1", "example.net/en/", "allow") and got[2][2:] == ("example.com/de/", "block") and got[3][2:] == ("org/fr/", "allow")
    assert got[4] == ("x.org", "", None, "allow") and got[5] == ("", "", None, "allow") and got[6] == ("a.net", "", None, "allow") and got[7][3] == "block" and got[8][2] is None and got[205][3] == "allow"


def test_pipeline(spark, sf, texts):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        path = scratch(spark, "pipeline-test")
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        assert tuple(docs.columns) == pipeline.COLUMNS
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    groups = linked({i: texts[i] for i in kept["language_id"]}, 5, 80)
    assert set(kept["near_duplicates"]) == {i for i in kept["language_id"] if groups[i][1] == i}
    assert len(kept["language_id"]) > 0.97 * len(texts) and set(kept["decontamination"]) <= set(kept["substring_dedup"])
    assert {r.doc_id for r in pipeline.run(spark, sf).collect()} == set(kept["decontamination"])
