"""Operators that learn or that compare texts, against brute force or held-out accuracy."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewater.llm import html_extract, langid, minhash, quality
from tidewater.llm.common import Scratch, hash_limit, numbered
from tidewater.llm.components import components

SF = "/root/testdata/sf0.01"


def flat_weights():
    return minhash.Weights(np.zeros((minhash.DEPTH, minhash.WIDTH)), 10)


def independent_classes(texts, counted):
    """Classes by all pairs and idf from Python counts over the texts at the places counted; smallest place of each class."""
    import math
    import re

    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    bags = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter() for w in words]
    df = Counter(s for i in counted for s in bags[i])
    n = sum(bool(bags[i]) for i in counted)
    idf = lambda s: math.log10((1 + n) / (1 + max(1, df[s]))) + 1
    weighted = [{s: k * idf(s) for s, k in b.items()} for b in bags]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    close = 0
    for i, a in enumerate(weighted):
        for j, b in enumerate(weighted[:i]):
            both = sum(min(x, b[s]) for s, x in a.items() if s in b)
            sim = both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0
            close += abs(sim - 0.8) < 1e-4  # float32 may differ here
            if sim >= 0.8:
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    assert not close
    return [root(i) for i in range(len(texts))]


def test_near_classes(spark):
    """Groups of near copies around unlike texts, half with one of three passages, so that idf differs; plus odd rows."""
    rnd = random.Random(4)
    passages = [" ".join(f"p{k}x{i}" for i in range(25)) for k in range(3)]
    rows, heads, i = [], [], 0
    for g in range(60):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.randint(80, 150))]
        heads.append(len(rows))
        for k in range(rnd.choice([1, 1, 2, 6])):
            words = list(base)
            if k:
                at = rnd.randrange(len(words) - rnd.randint(0, 9))
                words[at : at + 1] = ["new"] * rnd.randint(0, 2)
            rows.append((i, " ".join(words + [passages[g % 3]] * (g % 2))))
            i += 1
    n = len(rows)
    rows += [(i, None), (i + 1, ""), (i + 2, " .. "), (i + 3, "One two"), (i + 4, "one, two!"), (i + 5, "one"), (None, rows[0][1]), (0, rows[0][1])]
    heads += [n + 3, n + 5]
    want_root = independent_classes([t for _, t in rows], heads)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, u string, rid int, ord int").coalesce(1)
    got = minhash.near_classes(spark, df).collect()
    classes = defaultdict(list)
    for k, r in enumerate(want_root):
        classes[r].append(k)
    want = []
    for members in classes.values():
        ids = [rows[m][0] for m in members]
        head = min((x for x in ids if x is not None), default=None)
        want += [(x, head, len(ids)) for x in ids]
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(r.kept for r in got) == len(classes) < n - 20
    kept = minhash.keep_first(spark, df)
    assert kept.columns == df.columns and {(r.u, r.rid, r.ord) for r in kept.collect()} == {("x", 1, 2)} and kept.count() == len(classes)


def test_a_large_group_of_near_copies_does_not_weigh_down_its_members(spark):
    """A third of over 2000 rows: a member with one word of 49 changed shares 40 of 50 shingles, 0.8 by plain counts."""
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(49)]
    edited = [*base[:24], "other", *base[25:]]
    rows = [(i, " ".join(base)) for i in range(799)] + [(799, " ".join(edited))]
    rows += [(i, " ".join(f"u{rnd.randrange(10**9)}" for _ in range(30))) for i in range(800, 2400)]
    got = {r.doc_id: r.class_id for r in minhash.near_classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i < 800 else i for i in range(2400)}


@pytest.mark.parametrize("n", [60, 2600])
def test_every_shingle_is_counted_at_every_size(spark, n):
    """Passages on a fifth, a twentieth and three of unlike texts, and shingles of one text: idf is that of the counts."""
    rnd = random.Random(n)
    rows = []
    for i in range(n):
        words = [f"u{rnd.randrange(10**9)}" for _ in range(40)]
        rows.append((i, " ".join(words + ["all rights belong to us"] * (i % 5 == 0) + ["rarely seen words of ours"] * (i % 20 == 1) + ["three of all texts say"] * (i < 3))))
    scratch = Scratch(spark, "t")
    weights = minhash.fit_weights(spark, scratch, numbered(scratch, spark.createDataFrame(rows, "doc_id long, text string"))[0])
    assert weights.n == n
    for text, df in (("all rights belong to us", n // 5), ("rarely seen words of ours", n // 20), ("three of all texts say", 3), (" ".join(rows[7][1].split()[:5]), 1)):
        assert abs(weights.of(minhash.shingle_sets([text])[1])[0] - (np.log10((1 + n) / (1 + df)) + 1)) < 1e-5


def test_sketch_blocks_round_trip():
    rng = np.random.default_rng(1)
    for high in (2, 200, 60_000, 1 << 20, 1 << 40):
        for some in (0.0, 0.01, 1.0):
            counts = rng.integers(0, high, minhash.BLOCK_OF) * (rng.random(minhash.BLOCK_OF) < some)
            back = np.ones(minhash.BLOCK_OF, np.int64)
            minhash._add(back, minhash._encode(counts))
            assert (back - 1 == counts).all()


def test_near_classes_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_classes(spark, none).collect() == []


def test_block_links_join_what_leaders_miss():
    """Texts linked among each other, none with all: every class is found from links in a bucket."""
    texts = [" ".join(f"a{i}" for i in range(k, k + 60)) for k in range(0, 40, 4)]
    owner, sh, times = minhash.shingle_sets(texts)
    n = len(texts)
    starts = np.searchsorted(owner, np.arange(n))
    ids = np.unique(sh, return_inverse=True)[1]
    sets = starts, np.diff(np.concatenate((starts, [len(owner)]))), ids, times.astype(float)
    keys, marks = np.ones((n, minhash.BANDS), np.int64), np.ones((n, minhash.SAMPLES), np.uint8)
    links = minhash.block_links(np.arange(n), np.arange(n), 0, np.full(n, -1), np.zeros(n, int), keys, marks, sets)
    assert len(links) == n - 1


def test_signatures_agree_as_in_sql(spark):
    samples = np.random.default_rng(2).integers(0, 3, (50, minhash.SAMPLES)).astype(np.uint64)
    s1, s2 = minhash.signatures(samples)
    marks = minhash.unpacked(s1, s2)
    rows = [(int(s1[i]), int(s2[i]), int(s1[j]), int(s2[j]), int((marks[i] == marks[j]).sum()), int((samples[i] == samples[j]).sum())) for i in range(50) for j in range(50)]
    df = spark.createDataFrame(rows, "s1 long, s2 long, t1 long, t2 long, n int, m int").withColumn("got", minhash.agreeing("s1", "s2", "t1", "t2"))
    assert df.where("got <> n OR got < m").count() == 0


def test_samples_estimate_similarity():
    rnd = random.Random(1)
    agree, true = [], []
    flat = flat_weights()
    for _ in range(200):
        a = [f"w{rnd.randrange(10**6)}" for _ in range(150)]
        b = list(a)
        for _ in range(rnd.randint(0, 12)):
            b[rnd.randrange(150)] = "other"
        pair = [" ".join(a), " ".join(b)]
        owner, sh, times = minhash.shingle_sets(pair)
        s = minhash.weighted_samples(owner, sh, times * flat.of(sh), 2)
        agree.append((s[0] == s[1]).mean())
        true.append(minhash.similarity(pair[:1], pair[1:], flat)[0])
    assert abs(np.mean(agree) - np.mean(true)) < 0.03 and np.corrcoef(agree, true)[0, 1] > 0.8


def test_shingles_do_not_depend_on_pieces(monkeypatch):
    texts = ["a b c d e f g " * 30, None, "x y", "é è ê ë ē"]
    whole = minhash.shingle_sets(texts)
    monkeypatch.setattr(minhash, "PIECE", 17)
    for x, y in zip(whole, minhash.shingle_sets(texts), strict=True):
        assert (x == y).all()


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (10, 11), (12, 11), (13, 13)] + [(100 + i, 101 + i) for i in range(30)] + [(500, 500 + i) for i in range(1, 40)]
    df = spark.createDataFrame(links, "u long, v long")
    got = dict(tuple(r) for r in components(Scratch(spark, "t"), df).collect())
    want = {2: 1, 3: 1, 9: 1, 11: 10, 12: 10} | {100 + i: 100 for i in range(1, 31)} | {500 + i: 500 for i in range(1, 40)}
    assert got == want


def test_components_of_random_graphs(spark):
    rnd = random.Random(6)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(200)]
    up: dict[int, int] = {}
    from tidewater.llm.components import root

    for u, v in links:
        a, b = root(up, u), root(up, v)
        up[max(a, b)] = min(a, b)
    want = {x: root(up, x) for link in links for x in link if root(up, x) != x}
    df = spark.createDataFrame(links, "u long, v long").repartition(7)
    assert dict(tuple(r) for r in components(Scratch(spark, "t"), df).collect()) == want


@pytest.mark.parametrize("n", [10**k for k in range(4, 13)])
def test_fit_samples_hold_at_any_size(n):
    """The expected sample of n rows is the rows asked for."""
    limit = hash_limit(1500, n)
    assert abs((limit + (1 << 63) + 1) * n / (1 << 64) - 1500) < 1e-3 and hash_limit(n, n) == (1 << 63) - 1


# -- language and quality


def test_langid_held_out(spark):
    from pyspark.sql import functions as F

    from tidewater.llm.registry import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op8_langid"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).head()
    assert n > 150 and right / n > 0.97


def test_langid_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (4, "123 !!", None), (5, "", "fr"), (None, "the dog", "en"), (1, "the cat and the dog", "en"), (6, "le chien", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(spark, df, langid.fit_profiles(df.where("doc_id < 3"))).collect()}
    assert got == {(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (None, "en"), (6, "fr")}
    none = langid.identify(spark, df, langid.fit_profiles(df.where("false"))).collect()
    assert {r.lang_pred for r in none} == {"und"} and all(0 <= r.score <= 1 for r in none)


def brute_counts(text):
    found = {}
    word, marked = "", []
    for ch in text.lower() + "\n":
        if ch.isalpha():
            word += ch
        elif word:
            marked.append(word)
            word = ""
    for w in marked:
        m = f"_{w}_"
        for n in range(1, langid.MOST + 1):
            for i in range(len(m) - n + 1):
                if (g := m[i : i + n]) != "_":
                    found[g] = found.get(g, 0) + 1
    return sorted(found.values())


def test_gram_counts_match_brute_force():
    texts = ["The cat, the DOG; été!", None, "", "a", "ab 12 ab", "ß straße"]
    for text, (_, n) in zip(texts, langid.gram_counts(texts), strict=True):
        assert sorted(n.tolist()) == brute_counts(text or "")


def test_ranks_and_distance():
    h, n = np.array([5, 9, 2, 7], np.uint64), np.array([3, 9, 3, 1])
    assert langid.ranked(h, n, 3).tolist() == [9, 2, 5]
    p = langid.Profiles({"a": [9, 2, 5], "b": [5, 2, 9]}, 3)
    assert p.predict(h, n) == ("a", 1.0)
    assert langid.Profiles({"a": [5, 9, 2]}, 3).predict(h, n) == ("a", pytest.approx(1 - (1 + 1 + 2) / 9))


def test_quality_held_out(spark):
    from tidewater.llm.registry import QUERIES

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = QUERIES["op2_quality"](spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    assert got[got.quality == 1].score.min() > got[got.quality == 0].score.median()


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good text here"), (2, "BAD!! BAD!!"), (3, None), (4, ""), (None, "good"), (1, "good text here")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (9, 1), (None, 0), (3, None)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    got = quality.score_quality(spark, docs, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    score = {r.doc_id: r.score for r in got}
    assert score[1] > score[2]
    none = quality.score_quality(spark, docs, quality.fit_quality(docs, labels.where("false"))).collect()
    assert {r.score for r in none} == {0.5}


def test_scores_do_not_depend_on_neighbours():
    rng = np.random.default_rng(3)
    table = rng.random(quality.BUCKETS).astype(np.float32)
    texts = ["one two two", "", None, "x" * 50, "été été\tété"]
    together = quality.score_texts(texts, table, 0.1)
    assert np.allclose(together, [quality.score_texts([t], table, 0.1)[0] for t in texts], atol=1e-8)


# -- pages


def page(title, paragraphs, extra=""):
    body = "".join(f"<p>{p}" for p in paragraphs)
    return f"<html><head><title>{title}</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class='cookie-notice'>We use cookies</div>{extra}<article><h2>{title}</h2>{body}<p>All rights belong to us</p></article><aside>More</aside><form>Mail <input></form><section id=comments><p>nice</section><footer>&copy; us</footer></body></html>"


def test_pages(spark):
    rows = [(i, "http://a.org/x", page(f"Title {i}", [f"Text &amp; {i}\n  more", f"Second<br>{i}"])) for i in range(8)]
    rows += [(20, None, None), (21, "", ""), (22, "odd url", "plain  text"), (0, "http://a.org/x", rows[0][2])]
    df = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract_pages(spark, df).collect()}
    for i in range(8):
        want = f"Title {i}\nText & {i} more\nSecond {i}"  # the constant line is template
        assert got[i] == (want, len(want))
    assert got[20] == ("", 0) and got[21] == ("", 0) and got[22] == ("plain text", 10)


def test_pages_join_templates_when_they_are_many(spark, monkeypatch):
    rows = [(i, f"http://{'ab'[i % 2]}.org/", page(f"T {i}", [f"p {i}"])) for i in range(16)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    one = sorted(tuple(r) for r in html_extract.extract_pages(spark, df).collect())
    monkeypatch.setattr(html_extract, "BROADCAST_ROWS", 0)
    assert sorted(tuple(r) for r in html_extract.extract_pages(spark, df).collect()) == one


def test_a_notice_on_part_of_the_pages_is_template(spark):
    """An unnamed block on six pages of ten goes, and so does a repeated list of another type of page."""
    rows = []
    for i in range(10):
        extra = "<div class=zq><p>Act now and save</p></div>" if i < 6 else "<ul><li>one thing</li><li>other thing</li></ul>"
        rows.append((i, "http://a.org/x", f"<html><body><article><p>Text {i} of the page, its first part</p>{extra}<p>Its second part is {i * 7} long</p></article></body></html>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark, df).collect()}
    assert got == {i: f"Text {i} of the page, its first part\nIts second part is {i * 7} long" if i < 6 else got[i] for i in range(10)}
    assert "one thing" in got[9]  # four pages are under MIN_PAGES


def test_templates_choose_the_slots_of_pages_without_article(spark):
    """Unnamed boxes: the one of the template that holds the text is the article, whatever changes in the others; without the template all stay."""
    rows, want = [], {}
    for i in range(9):
        parts = [f"Paragraph {k} of page {i} goes on for some {i + k} words" for k in range(2 + i % 3)]
        side = f"<div class=zx><p>Seen too: {i}</p><p>And {i + 1}</p></div>"
        top = f"<table><tr><td>Today it is {i}</table>"
        rows.append((i, "http://a.org/x", f"<html><body>{top}<div class=q7><h1>Page {i}</h1>{''.join(f'<p>{p}</p>' for p in parts)}</div>{side}</body></html>"))
        want[i] = "\n".join([f"Page {i}", *parts])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract_pages(spark, df).collect()} == want
    assert all(html_extract.pick_text(h, None) == f"Today it is {i}\n{want[i]}\nSeen too: {i}\nAnd {i + 1}" for i, _, h in rows)


def test_classes_are_those_of_occurrence_vectors(spark):
    """Tokens of a host that are on the same pages as often, by brute force over random pages."""
    rnd = random.Random(2)
    bits = ["<div class=a>", "</div>", "<p>", "<ul><li>x</ul>", "<section id=b><h2>same</h2></section>", "text", "other", "<table><tr><td>1</table>"]
    rows = [(i, f"http://{'ab'[i % 2]}.org/", "<body>" + "".join(rnd.choice(bits) for _ in range(rnd.randint(2, 12)))) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.host, r.token): (r["class"], r.part, r.once) for r in html_extract.deduce_templates(spark, df).collect()}
    want = {}
    for host in ("a.org", "b.org"):
        vectors = defaultdict(dict)
        pages = [(i, h) for i, u, h in rows if html_extract.host_of(u) == host]
        for i, h in pages:
            for token, n in Counter(html_extract.read_page(h)[0]).items():
                vectors[html_extract.token_key(token)][i] = n
        for token, v in vectors.items():
            if len(v) >= html_extract.MIN_PAGES:
                want[host, token] = min(t for t, w in vectors.items() if w == v), len(v) / len(pages), max(v.values()) == 1
    assert got == want and len({c for c, *_ in want.values()}) > 5


def test_templates_round_trip():
    template = {-5: (7, 0.5, 1.0, True), 1 << 60: (-9, 3.25, 0.01, False)}
    import pyarrow as pa

    rows = [{"token": t, "class": c, "place": p, "part": q, "once": o} for t, (c, p, q, o) in template.items()]
    assert html_extract.unpack(html_extract.pack(pa.Table.from_pylist(rows))) == template


def test_passages_that_articles_share_are_no_template(spark):
    """A paragraph on six of twenty pages stays; the same with a box of its own is template."""
    line = "Released to all who want it"
    boxed = lambda i: f"<div class=zq><p>{line}</div>" if 6 <= i < 12 else f"<p>{line}" if i < 6 else ""
    rows = [(i, "http://a.org/x", page(f"Title {i}", [f"Text {i} goes on for longer", f"Second {i}{boxed(i)}"])) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark, df).collect()}
    assert got == {i: f"Title {i}\nText {i} goes on for longer\nSecond {i}" + f"\n{line}" * (i < 6) for i in range(20)}


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, "http://a.org/x", page(f"Title {i}", [f"Text {i}" if i < 14 else "A text that six pages have", "and its second part" if i >= 14 else f"Second {i}"])) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark, df).collect()}
    assert got[3] == "Title 3\nText 3\nSecond 3" and got[16] == "Title 16\nA text that six pages have\nand its second part"


def test_classes_are_ordered_by_occurrence_and_nested():
    key = html_extract.token_key
    of = lambda *classes: {key(t): (n, float(k), 1.0 - n / 10, True) for n, c in enumerate(classes) for k, t in enumerate(c)}
    valid = lambda page, *classes: sorted(html_extract.valid_classes(list(page), of(*classes)))
    assert valid("xabababy", "ab") == [1, 2, 3, 4, 5, 6]  # each pair after the other
    assert valid("xaabby", "ab") == []  # the second a comes before the first b
    assert valid("acdb", "ab", "cd") == [0, 1, 2, 3] and valid("cabd", "ab", "cd") == [0, 1, 2, 3]
    assert valid("acbd", "ab", "cd") == [0, 2]  # neither is in a slot of the other


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<p>a<p>b</p>c", "a\nb\nc"),
        ("<main><div>x <b>y</b>z</div><ul><li>1<li>2</ul></main><div>out</div>", "x yz\n1\n2"),
        ("<article><p>t</p><article class=comment>no</article></article>", "t"),
        ("<div>&lt;b&gt; &#233; &nbsp; q</div>", "<b> é q"),
        ("<script>if (a < b) {}</script><p>x<!-- no --> y</p>", "x y"),
        ("<article><p>open <i>tags", "open tags"),
        ("a < b", "a < b"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2\n3"),
        ("<article><header><h1>In</h1></header><p>x</p></article>", "In\nx"),
    ],
)
def test_page_text(source, text):
    assert html_extract.pick_text(source, None) == text
