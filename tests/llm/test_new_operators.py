"""Importance resampling, the record archive and spelling variants, against brute force and round trips."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldmill.llm import bytewise, resample, spelling, warc
from fieldmill.llm.common import scratch
from fieldmill.sources.paths import children


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# words and checksums


def test_checksums_join():
    rng = random.Random(1)
    a, b = ([bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 200, 5000]))) for _ in range(60)] for _ in range(2))
    c = [np.array(list(map(zlib.crc32, x)), dtype=np.uint32) for x in (a, b)]
    assert (bytewise.shifted(c[0], np.array(list(map(len, b)))) ^ c[1]).tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]


@pytest.mark.parametrize("stretch", [1, 5, 1 << 20])
def test_features_and_runs_of_odd_texts(monkeypatch, stretch):
    """Texts that are cut in stretches, null, empty, of one long word, sliced out of a larger column."""
    monkeypatch.setattr(bytewise, "STRETCH", stretch)
    rng = random.Random(stretch)
    for _ in range(30):
        texts = [rng.choice([None, "", " ", "x" * rng.randint(60, 300), "".join(rng.choice("aZ éÀ漢0:_\n\x7f-×") for _ in range(rng.randint(0, 120)))]) for _ in range(rng.randint(0, 9))]
        column = pa.array(["before", *texts, "behind"], type=pa.string())[1:-1]
        got, many = [[] for _ in texts], [0] * len(texts)
        for buckets, owners, words in resample.features(column):
            for b, o in zip(buckets.tolist(), owners.tolist()):
                got[o].append(b)
            for o in words.tolist():
                many[o] += 1
        runs = Counter()
        for words, n in spelling.words_of(pa.array(range(len(texts)), type=pa.int64()), column):
            runs.update(dict(zip([w.as_py().decode() for w in words], n.tolist())) if len(set(words.to_pylist())) == len(words) else {})
            if len(set(words.to_pylist())) < len(words):
                for w, k in zip(words.to_pylist(), n.tolist()):
                    runs[w.decode()] += k
        want = Counter()
        for i, text in enumerate(texts):
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
            assert many[i] == len(words)
            assert sorted(got[i]) == sorted(zlib.crc32(f.encode()) % 10000 for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))])
            for r in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
                r = lower(r)
                h = zlib.crc32(f"{i}:{r}".encode())
                want[r[: h % len(r)] + r[h % len(r) + 1 :] if h % 97 == 0 else r] += 1
        assert +runs == want


# resampling


def drawn_plainly(docs, target, percent=25, least=20, seed=7):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        return len(w), [zlib.crc32(f.encode()) % 10000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    out, rich = {}, []
    for key, text in docs:
        n, f = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[key] = [len(f), weight, score, None]
        rich += [(-score, key)] * (n >= least)
    for rank, (_, key) in enumerate(sorted(rich)[: percent * len(rich) // 100], 1):
        out[key][3] = rank
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_resampling_equals_a_plain_draw(spark, parts):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["alpha", "Beta", "gämma", "42", "x-y", "zeta", "Größe"]) for _ in range(rng.choice([0, 3, 19, 20, 21, 60])))) for i in range(400)]
    target = ["alpha beta alpha 42", "x y zeta"]
    got = resample.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), spark.createDataFrame([(t,) for t in target], "text string"))
    assert {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in got.collect()} == drawn_plainly(docs, target)


def test_resampling_of_odd_tables(spark, odd):
    many = odd.withColumn("rank", F.lit("theirs")).withColumn("score", F.lit(0)).withColumn("part", F.lit(1))
    rows = resample.resample(many, odd.limit(0), least_words=1, percent=50).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert [(r.n_features, r.weight, r["rank"]) for k in (1, 2, 3, 13) for r in by[k]] == [(0, 0, None)] * 4 and len(by[None]) == 2 and by[11][0].score == by[11][1].score
    words = sum(1 for r in rows if r.n_features)
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, words // 2 + 1))
    assert resample.resample(odd.limit(0), odd).collect() == []
    assert {r["rank"] for r in resample.resample(odd, odd, least_words=10**6).collect()} == {None}


# records


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "theirs", 1) for r in rows], "page_id long, url string, html string, digest string, file int")


BODY = "<p>" + "body " * 40 + "é</p>"
ODD_PAGES = [(5, "http://a.net/ü x\r\nEvil: 1", BODY), (3, None, BODY), (9, "http://b.net", BODY + "other"), (None, "http://c.net", BODY), (4, "x", None), (2, "y", ""), (7, "z", "short"), (8, "z", "short"), (3, None, BODY), (10, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 20), (11, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 20)]


def archived(spark, pages, **more):
    folder = scratch(spark, "warc-test")
    warc.write_warc(pages, folder, **more)
    warc.store(spark, folder)
    return folder


@pytest.mark.parametrize("roll", [1, 1 << 20])
def test_archive_gives_back_every_byte(spark, roll):
    """What restore joins is what the files hold, record by record, and each payload is stored once."""
    folder = archived(spark, pages_of(spark, ODD_PAGES), roll=roll)
    rows = warc.restore(spark, folder).collect()
    text = lambda r: r.payload.decode()
    told = sorted(((r.record_id, r.record_type, r.refers_to, text(r)) for r in rows), key=str)
    want = [(f"<urn:page:{'' if k is None else k}>", *(("revisit", "<urn:page:3>") if h == BODY and k != 3 else ("revisit", "<urn:page:10>") if k == 11 else ("response", None)), h or "") for k, _, h in ODD_PAGES]
    assert told == sorted(want, key=str)
    local = folder.removeprefix("file:").replace("///", "/")
    files = [r.file for r in spark.read.parquet(f"{folder}/manifest").collect()]
    assert sorted(files) == sorted(n for n in children(spark, f"{folder}/warc") if not n.startswith("."))
    assert len(files) >= (len(ODD_PAGES) if roll == 1 else 1)
    for file in files:
        with gzip.open(f"{local}/warc/{file}") as f:
            assert f.read() == b"".join(bytes(r.record) for r in sorted((r for r in rows if r.file == file), key=lambda r: r.offset))
    stored = spark.read.parquet(f"{folder}/payloads").collect()
    assert sorted(hashlib.sha256(r.payload).hexdigest() for r in stored) == sorted(r.digest for r in stored) == sorted({hashlib.sha256((h or "").encode()).hexdigest() for _, _, h in ODD_PAGES})
    assert not any(b"\nEvil" in bytes(r.warc_header) for r in rows)


def test_archive_of_many_copies_and_of_nothing(spark):
    rows = [(i, "u", BODY if i % 3 else None) for i in range(3000)] + [(i, "v", f"{BODY}{i}") for i in range(3000, 3400)] + [(i, "w", f"{BODY}{i % 100}") for i in range(3400, 3700)]
    pages = pages_of(spark, rows).repartition(9)
    got = {r.page_id: r for r in warc.restore(spark, archived(spark, pages)).withColumn("page_id", warc.key_of(F.col("record_id")).try_cast("long")).withColumn("to", warc.key_of(F.col("refers_to")).try_cast("long")).collect()}
    first = {}
    for i, _, h in rows:
        first.setdefault(h or "", i)
    for i, _, h in rows:
        want = None if not h or first[h] == i else first[h]
        assert (got[i].to, got[i].payload.decode(), got[i].payload_bytes) == (want, h or "", len((h or "").encode()))
    assert len(got) == len(rows) and warc.restore(spark, archived(spark, pages.limit(0))).collect() == []


def test_damaged_records_are_told():
    data = warc.record_bytes("1", "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    [(head, fields, http, payload)] = warc.parsed(data)
    assert head + http + payload + warc.END == data and warc.verified(fields, payload) == hashlib.sha256(b"payload").hexdigest()
    with pytest.raises(ValueError, match="digest"):
        warc.verified(fields, b"payloaD")
    with pytest.raises(ValueError):
        list(warc.parsed(data[:-1]))
    with pytest.raises(ValueError):
        list(warc.parsed(b"x" + data))


def test_files_of_others():
    """Several records in one member, other kinds of records, and files that aren't compressed."""
    import io

    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\na:b\r\n\r\n"
    one = warc.record_bytes("k y", "u", b"p", hashlib.sha256(b"p").hexdigest(), None)
    for data, many in ((gzip.compress(info + one) + gzip.compress(one), [2, 1]), (info + one, [2])):
        found = list(warc.members(io.BytesIO(data), size=7))
        assert [len(list(warc.parsed(m))) for _, _, m in found] == many and sum(n for _, n, _ in found) == len(data)
    assert [f["warc-type"] for _, f, _, _ in warc.parsed(info + one)] == ["warcinfo", "response"]


# spelling


def one_edit(w, v):
    if len(w) == len(v):
        return sum(a != b for a, b in zip(w, v)) == 1
    w, v = sorted((w, v), key=len)
    return len(v) == len(w) + 1 and any(v[:i] + v[i + 1 :] == w for i in range(len(v)))


def test_wavelet_tree_reports_ranges():
    rng = random.Random(4)
    for m in (1, 2, 3, 17, 64):
        p = np.array(rng.sample(range(m), m))
        tree = spelling.WaveletTree(p)
        a, b, low, high = (np.array([rng.randint(0, m) for _ in range(50)]) for _ in range(4))
        q, v = tree.report(a, b, low, high)
        assert sorted(zip(q.tolist(), v.tolist())) == sorted((i, int(x)) for i in range(50) for x in p[a[i] : max(a[i], b[i])] if low[i] <= x < high[i])


@pytest.mark.parametrize("meet", [3, 10**6])
def test_near_words_equal_all_pairs(spark, meet):
    """With words dealt by halves, and by windows down to single positions; other alphabets and lengths too."""
    rng = random.Random(6)
    words = {"".join(rng.choice("abé漢") for _ in range(rng.randint(1, 8))): rng.randint(1, 9) for _ in range(400)} | {"a" * n: 5 for n in (70, 71, 72, 90)}
    got = {r.word: (r.n_near, r.best_n, r.best) for r in spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), meet=meet, part=100).collect()}
    want = {}
    for w in words:
        near = [v for v in words if v != w and one_edit(w, v)]
        if near:
            best = min(near, key=lambda v: (-words[v], v))
            want[w] = (len(near), words[best], best)
    assert got == want


def test_spelling_groups_and_odd_documents(spark, odd):
    docs = [(1, "window " * 20 + "windaw " * 9 + "wundaw " * 4 + "windows " * 10), (2, "WINDOW Größe größe GRÖSSE Grösse"), (3, None), (None, "größe gröse gröse gröse"), (4, "a" * 5000), (4, ("a" * 5000 + " ") * 2)]
    got = {r.word: r for r in spelling.spelling_groups(spark.createDataFrame(docs, "doc_id long, text string"), dropped=10**9).collect()}
    assert set(got) == {"window", "windaw", "wundaw", "windows", "größe", "gröse", "a" * 5000}
    assert [(got[w].form, got[w].root, got[w].n, got[w].n_near, got[w].form_n) for w in ("window", "windaw", "wundaw", "windows")] == [
        (None, "window", 21, 2, None), ("window", "window", 9, 2, 21), ("windaw", "window", 4, 1, 9), ("window", "window", 10, 1, 21)]
    assert (got["gröse"].n, got["gröse"].n_near, got["a" * 5000].root) == (3, 1, "a" * 5000)
    same = odd.withColumn("word", F.lit("theirs")).withColumn("class", F.lit(1))
    assert all(r.n >= 3 and len(r.word) >= 5 for r in spelling.spelling_groups(same).collect()) and spelling.spelling_groups(odd.limit(0)).collect() == []
