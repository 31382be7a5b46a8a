"""Cases that operators once left out."""

import math
import random

from fieldmill.llm import decontaminate, jaccard_join, substring_dedup
from fieldmill.llm.html_extract import main_text


def test_passages_that_end_inside_sentences(spark):
    """Every run of PASSAGE words that an earlier text holds goes, against brute force."""
    rng, size = random.Random(7), substring_dedup.PASSAGE
    passages = [[f"p{k}w{i}" for i in range(n)] for k, n in enumerate((92, 50, 49, 60))]
    texts = {}
    for d in range(12):
        words = []
        for k in rng.sample(range(4), 3) + [d % 4] * (d % 3):
            words += [f"d{d}x{rng.randrange(10**6)}" for _ in range(rng.randint(1, 40))] + passages[k]
        texts[d] = " ".join(words + [f"d{d}end"]) + "."
    texts[12] = "word " * 120
    seen, want = set(), {}
    for d, t in texts.items():
        w, gone, first = t.split(), set(), {}
        for p in range(len(w) - size + 1):
            run = tuple(w[p : p + size])
            q = first.setdefault(run, p)
            gone |= set(range(p, p + size)) if run in seen else set(range(max(p, q + size), p + size)) if q < p else set()
        seen |= first.keys()
        want[d] = [x for i, x in enumerate(w) if i not in gone]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    none = {"least_sentences": 10**6, "least_words": 10**6, "long": 10**6}
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(df, passage=size, **none).collect()}
    assert {d: r.text.split() for d, r in got.items()} == want and len(want[12]) == size
    assert [got[d].n_removed for d in want] == [int(len(want[d]) < len(texts[d].split())) for d in want]


CHINESE = "老磨坊在河边立了一百年。没有人知道是谁建的，也不知道为什么！孩子们夏天在那里玩耍，互相讲故事。冬天水轮结冰，磨坊主一直睡到春天解冻。"
THAI = "โรงสีเก่าตั้งอยู่ริมแม่น้ำมาเป็นเวลาหนึ่งร้อยปีและไม่มีใครรู้ว่าใครเป็นคนสร้างมันขึ้นมาหรือสร้างเพื่ออะไร"


def test_scripts_without_spaces(spark):
    assert [len(substring_dedup.sentences(t)) for t in (CHINESE, "他说：「好。」然后走了。", "Ends here. And here!")] == [4, 2, 2]
    rows = [(0, f"第一篇。{CHINESE}"), (1, f"另外一篇文章。{CHINESE}结束了。"), (2, THAI), (3, f"อื่น\n{THAI}\nจบ"), (4, f"前面{CHINESE[3:70]}后面")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in substring_dedup.remove_repeats(df).collect()}
    assert got[0] == rows[0][1] and got[1] == "另外一篇文章。结束了。" and got[2] == THAI and got[3] == "อื่น\nจบ"
    assert {r.doc_id: r.text for r in substring_dedup.remove_repeats(df, passage=50).collect()}[4] == "前面后面"
    items = spark.createDataFrame([(1, CHINESE[12:28]), (2, THAI[:40]), (3, "完全不同的一个问题在这里没有出现")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, items).collect()} == {(0, 1), (1, 1), (4, 1), (2, 2), (3, 2)}


def test_short_items_are_all_found(spark):
    """Items of up to 14 words with every number of substitutions, against all alignments."""
    rng = random.Random(8)
    items = {n: [f"i{n}w{i}" for i in range(n)] for n in range(1, 15)} | {30: "what is the capital of the land".split(), 31: []}
    docs = {}
    for k, words in items.items():
        for d in range(30):
            body = list(words)
            for i in rng.sample(range(len(body)), min(len(body), d % 5)):
                body[i] = f"x{rng.randrange(10**6)}"
            docs[100 * k + d] = [f"y{rng.randrange(50)}" for _ in range(rng.randrange(3))] + body[d % 4 // 3 :] + ["z"] * rng.randrange(3)
    want = set()
    for d, body in docs.items():
        for k, words in items.items():
            alignments = [sum(0 <= i + s < len(body) and body[i + s] == w for i, w in enumerate(words)) for s in range(-len(words), len(body))]
            want |= {(d, k, n) for n in [max(alignments, default=0)] if words and n >= math.ceil(0.75 * len(words))}
    df = spark.createDataFrame([(d, " ".join(b)) for d, b in docs.items()], "doc_id long, text string")
    got = decontaminate.contaminated(df, spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.n_equal) for r in got.collect()} == want and {k for _, k, _ in want} == set(items) - {31}


def test_near_links_of_a_key_that_also_copies_another(spark):
    """Key 5 copies key 1 on one row; on its other row stands a text near to those of keys 7 and 3."""
    a, b, c = ([f"{x}{i}" for i in range(100)] for x in "abc")
    near = lambda w: [*w[:-1], "other"]
    rows = [(1, a), (5, a), (5, b), (7, near(b)), (3, ["new", *b]), (8, c), (9, near(c)), (9, a), (10, b[:50])]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in jaccard_join.link_components(df, 3, 90).collect()}
    assert got == {(1, 1), (5, 1), (7, 1), (3, 1), (8, 1), (9, 1), (10, 10)}


def test_pages_in_other_languages_and_references():
    russian = "Старая мельница стояла у реки сто лет, и никто не мог сказать, кто её построил и зачем это было нужно людям."
    polish = "Stary młyn stał nad rzeką przez sto lat i nikt nie wiedział, kto go zbudował ani po co, lecz dzieci bawiły się tam latem."
    chinese = "老磨坊在河边立了一百年，没有人知道是谁建的，也不知道为什么。" * 4
    for body in (russian, polish, chinese):
        page = f'<p>{body}</p><p>Foto 1</p><p>{body}</p><p><a href="x">{body}</a></p>'
        assert main_text(page) == f"{body}\n\nFoto 1\n\n{body}"
    low = "Price list 2024: bolts 4 mm, nuts 5 mm, washers 6 mm, hinges 7 mm, screws 8 mm, nails 9 mm, brackets"
    english = "This is the story of a man who was in the house and it is long enough to be good for the reader of it."
    assert main_text(f"<p>{english}</p><p>{low}</p><p>{english}</p>") == f"{english}\n\n{english}"
    reference = "A. Smith and B. Jones: On the mills of the northern rivers, Journal of Old Engines 12, 1987"
    assert main_text(f'<article><p>{english}</p><ul><li><a href="r">{reference}</a></li></ul><ul><li><a href="m">More</a></li></ul></article>') == f"{english}\n\n{reference}"


def test_items_of_one_word_and_texts_of_many_hits(spark, monkeypatch):
    """A common word is found in every text that has it, and a text with many hits is held in several lots."""
    monkeypatch.setattr(decontaminate, "HITS", 7)
    docs = [(i, ("of the mill " * 40 if i % 3 else "a river ") + f"x{i}") for i in range(60)] + [(None, "the"), (61, None)]
    items = [(1, "The"), (2, "absent"), (3, "of the mill of the old of the"), (4, "river!"), (5, "the")]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(i, k, at, 1) for i, _ in docs[:60] for k, at in (((1, 1), (5, 1)) if i % 3 else ((4, 1),))} | {(i, 3, 0, 7) for i in range(60) if i % 3}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
