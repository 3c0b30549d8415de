"""HTML, vectors, the pipeline, and the registry."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site name</header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad -->
<div class="cookie-notice">We use cookies to improve your experience on this long notice line.</div><article><h1>Head &amp; shoulders</h1><p>A first   paragraph
with <b>bold</b> text that is long enough to count.<br><p>Short.</p><div class="ad">Buy now, a very good offer for everybody who reads.</div><p>Another paragraph of the article, &lt;escaped&gt; and long.</article>
<section id="comments"><p>A reader comment that is rather long, so that its ratio is high as well.</p></section><form><label>Mail</label></form><footer>&copy; someone</footer>"""


def test_op6_extraction(spark):
    from docloom.llm.html_content import extract_pages, main_text

    want = "Head & shoulders\nA first paragraph with bold text that is long enough to count.\nShort.\nAnother paragraph of the article, <escaped> and long."
    assert main_text(PAGE) == want
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == "" and main_text("plain text") == "plain text"
    assert main_text("<p>" * 3000 + "deep") == "deep"
    assert main_text("<body><div class='menu'><a>m</a></div><div id='c'><p>" + "word " * 60 + "</p><p>End.</p></div></body>") == ("word " * 60).strip() + "\nEnd."
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "<p>x" + "y" * 100_000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = extract_pages(frame).collect()
    assert sorted((r["page_id"] or 0, r["url"] or "", r["n_chars"]) for r in got) == [(0, "v", 100_001), (1, "u", len(want)), (1, "u", len(want)), (2, "", 0)]
    assert extract_pages(frame.limit(0)).count() == 0


def test_op6_marks_and_siblings():
    from docloom.llm.html_content import main_text

    words = "word " * 50
    assert main_text('<div class="page has-sidebar"><p>Hello world this is text</p></div>') == "Hello world this is text"
    assert main_text('<div class="widget"><p>Hello world this is text</p></div>') == "Hello world this is text"  # nothing else is there
    assert main_text('<div class="post no-comments"><article><h1>T</h1><p>Long text here it is</p></article></div>') == "T\nLong text here it is"
    assert main_text("<article><p>one two three four</p></article><article><p>five six seven eight</p></article><footer>x</footer>") == "one two three four\nfive six seven eight"
    assert main_text("<article><header><h1>Title</h1><p>by me</p></header><p>one two three four</p></article>") == "Title\none two three four"
    assert main_text('<p>one two</p><p hidden="hidden">a</p><p style="display: none">b</p><p aria-hidden="true">c</p><p>like <button>x</button> this</p>') == "one two\nlike this"
    assert main_text(f'<h1>Title</h1><div><p>{words}</p><p>short</p></div><div id="comments"><p>{"bla " * 400}</p></div>') == f"Title\n{words.strip()}\nshort"
    assert main_text(f"<main><section><p>{words}</p></section><section><p>{words}</p></section></main>") == f"{words.strip()}\n{words.strip()}"
    assert main_text(f"<main><article><p>{words}</p></article><div><a>x</a></div></main>") == words.strip()
    assert main_text(f'<article><p>{words}</p></article><article class="comment"><p>{words}</p></article>') == words.strip()


def test_op6_time_grows_with_the_page():
    import time

    from docloom.llm.html_content import main_text

    for html, want in (("<div>" * 5000 + "text", "text"), ("<p>a" + "<b" * 100_000, "a"), ("<p>a" + "<!--" * 100_000, "a"), ("<div>" * 3000 + "</p>" * 3000 + "x", "x")):
        began = time.perf_counter()
        assert main_text(html) == want
        assert time.perf_counter() - began < 1


def test_op6_against_brute_force(spark):
    """Every page of the small tables, whose article is cut out by a pattern and read block by block."""
    import html
    import re
    from pathlib import Path

    from docloom.llm.queries import op6_html_content

    sf = "/root/testdata/sf0.01"
    if not Path(sf).exists():
        pytest.skip("no tables")
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in op6_html_content(spark, sf).collect()}
    assert set(got) == set(pages)
    for i, page in pages.items():
        article = re.search(r"<article>(.*?)(?:</article>|<footer|$)", page, re.DOTALL).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[i]["text"] == "\n".join(b for b in blocks if b) and got[i]["n_chars"] == len(got[i]["text"])


def test_op9_recall_and_ties(spark):
    from docloom.llm.vector_graph import nearest

    rng = np.random.default_rng(3)
    base = rng.normal(size=(1500, 16)).astype(np.float32)
    base[100:400] = base[100]  # a vector that many rows share
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    odd = [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] + [1.0] * 15), (2300, [None] + [1.0] * 15), (2400, [1.0, 2.0]), (None, rows[0][1]), (50, rows[50][1]), (2500, [float("inf")] + [0.0] * 15)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("vector", F.lit(1))
    got: dict = {}
    for r in nearest(frame, every=100, shard_rows=300).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    x = base.astype(np.float64)
    hit = total = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = sorted((d[i], i) for i in range(1500) if i != q)[:10]
        assert len(got[q]) == 10 and got[q] == sorted(got[q])
        assert all(s == pytest.approx(d[i]) for s, i in got[q])
        hit += len({i for _, i in want} & {i for _, i in got[q]})
        total += 10
    assert hit / total >= 0.95 and set(got) == set(range(0, 1500, 100))
    assert [i for _, i in got[100]] == list(range(101, 111))
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in nearest(few).orderBy("rank").collect()] == [(0, 2), (0, 1)]
    assert nearest(few.limit(0)).count() == 0


def test_op9_doubles_and_lengths(spark):
    """Vectors of two lengths, and doubles that are equal as floats."""
    from docloom.llm.vector_graph import nearest

    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3 if i % 2 else 4).tolist()) for i in range(100, 140)] + [(0, [1.0, 0.0, 0.0, 0.0]), (1, [1.0, 1e-12, 0.0, 0.0]), (2, [1.0, 2e-12, 0.0, 0.0]), (200, [5.0, 5.0, 5.0])]
    got: dict = {}
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q in (0, 100, 200):
        own = dict(rows)[q]
        want = sorted((float(np.sqrt(((np.array(v) - own) ** 2).sum())), i) for i, v in rows if i != q and len(v) == len(own))[:5]
        assert [i for i, _ in got[q]] == [i for _, i in want] and [s for _, s in got[q]] == pytest.approx([d for d, _ in want], rel=1e-14)


def test_op9_recall_on_the_table(spark):
    from pathlib import Path

    from docloom.llm.queries import op9_vector_graph

    sf = "/root/testdata/sf0.1"
    if not Path(sf).exists():
        pytest.skip("no tables")
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows])
    got: dict = {}
    for r in op9_vector_graph(spark, sf).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = []
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hits.append(len(got[q] & set(ids[order].tolist())))
    assert sum(hits) >= 0.95 * 10 * len(hits)


def test_pipeline_stages(spark, messy, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    from conftest import prose

    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "quality classifier", "near duplicates", "substring dedup", "packing"]
    shared = prose(500, 60)
    texts = {i: prose(i, 150) for i in range(30)} | {30: prose(3, 150), 31: prose(4, 149) + " other", 32: "%%% &&& " * 60, 33: "too short", 34: shared + " " + prose(600, 90), 35: prose(601, 90) + " " + shared}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, kept = docs, []
    for name, stage in pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        kept.append({r["doc_id"]: r["text"] for r in now.collect()})
    assert set(kept[0]) == set(texts) - {32, 33} and set(kept[1]) == set(kept[0])
    assert set(kept[2]) == set(kept[1]) - {30, 31}
    assert set(kept[3]) == set(kept[2]) and len(kept[3][35].split()) == 90 and kept[3][34] == texts[34]
    packed = pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(kept[3])
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    """Rules and classifier by their reports, near duplicates, passages and pieces by plain loops over all documents."""
    import random
    import re

    pipeline = pytest.importorskip("corpus_pipeline")
    pt = pytest.importorskip("public_tokenizers")
    from conftest import prose
    from tokenizers import Tokenizer

    from docloom.llm.ordinal_classifier import fit_on, grade_documents, graded
    from docloom.llm.quality_rules import quality_report

    rng = random.Random(11)
    passages = [prose(900 + i, 58) for i in range(3)]
    texts = {}
    for i in range(90):
        t = prose(i, rng.randint(60, 260))
        if i % 9 == 1:
            t = texts[i - 1]
        elif i % 9 == 3:
            t = texts[i - 1] + " and a tail"
        elif i % 9 in (5, 7):
            t = t + " " + rng.choice(passages) + " " + prose(i + 300, 40)
        elif i % 9 == 8:
            t = t.replace(" ", " %%% ")
        texts[i] = t
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, int(i % 9 != 8), 0) for i in range(0, 90, 2)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))

    fine = [r["doc_id"] for r in quality_report(docs).collect() if r["kept"]]
    left = docs.filter(F.col("doc_id").isin(fine))
    kept = sorted(r["doc_id"] for r in grade_documents(left, fit_on(left, labels, graded(labels))).collect() if r["kept"])
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", texts[i]) for i in kept}
    sets = {i: {tuple(x.lower() for x in w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
    root = {i: i for i in kept}
    for a in kept:
        for b in kept:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
    kept = [i for i in kept if root[i] == i]
    first: dict = {}
    for i in kept:
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    tool, want = Tokenizer.from_file(pt.path("word_bpe_49k.json")), {}
    for i in kept:
        gone = {j for k in range(len(words[i]) - 49) if first[tuple(words[i][k : k + 50])] < i for j in range(k, k + 50)}
        text = " ".join(x for j, x in enumerate(words[i]) if j not in gone) if gone else texts[i]
        want[i] = tool.encode(text, add_special_tokens=False).ids + [1]
    assert 30 < len(kept) < len(fine) < 90 and any(len(want[i]) < len(tool.encode(texts[i]).ids) for i in kept)
    got: dict = {}
    for r in pipeline.run(spark, str(tmp_path)).orderBy("doc_id", "start").collect():
        assert r["start"] == len(got.setdefault(r["doc_id"], []))
        got[r["doc_id"]] += r["ids"]
    assert got == want


def test_pipeline_stages_take_messy_tables(spark, messy, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, 1, 0), (None, None, None), (7, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in pipeline.STAGES:
        out = stage(spark, messy, str(tmp_path))
        assert out.columns == messy.columns or name == "packing", name
        assert out.count() <= 3 * messy.count() and (out.count() > 0 or name == "quality classifier"), name  # which has two labels here


def test_registry():
    import __spark_entry__
    from docloom.llm.queries import QUERIES

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


LONG = "A sentence of an article that is long enough to be told from a menu by its ratio of characters to tags, whatever the page looks like. " * 2


def test_op6_comments_and_notices_at_any_size():
    """Reader comments, adverts and notices never come back, however short the article beside them is."""
    from docloom.llm.html_content import main_text

    post = "<p>A short post of a few words.</p>"
    for name in ("comments", "responses", "reader-replies", "discussion", "disqus_thread", "ad-slot", "sponsored", "alert", "cookie-notice", "newsletter signup"):
        junk = f'<div class="{name}">' + f"<p>{LONG}</p>" * 12 + "</div>"
        assert main_text(f"<body><div>{post}</div>{junk}</body>") == "A short post of a few words.", name
        assert main_text(f"<article>{post}{junk}</article>") == "A short post of a few words.", name
    assert main_text(f'<div class="comments"><p>{LONG}</p></div>') == ""
    assert main_text(f'<div class="page-header-wrapper"><p>{LONG}</p><nav>n</nav></div><footer>f</footer>') == LONG.strip()
    for name in ("comments-closed", "no-comments", "ad-free", "has-sidebar"):
        assert main_text(f'<div class="{name}"><p>{LONG}</p></div><div><p>{LONG}</p></div>') == f"{LONG.strip()}\n{LONG.strip()}", name


def test_op6_text_around_an_article_and_menus_in_it():
    from docloom.llm.html_content import main_text

    text = LONG.strip()
    assert main_text(f"<main><p>intro</p><article><p>{LONG}</p><p>{LONG}</p></article><p>end</p></main>") == f"intro\n{text}\n{text}\nend"
    menu = "<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li><li><a href=c>About</a></li></ul>"
    body = f"<p>{LONG}</p><p>Short.</p>" * 4
    want = "\n".join([text, "Short."] * 4)
    for page in (f"<article>{menu}{body}</article>", f"<article>{body}{menu}</article>", f"<article><p>{LONG}</p>{menu}{body}</article>".replace(f"<p>{LONG}</p>{menu}", menu + f"<p>{LONG}</p>", 1)):
        assert "Home" not in main_text(page) and main_text(page).count("Short.") == 4
    assert main_text(f"<article>{menu}{body}</article>") == want
    assert main_text(f"<article>{body}<p><a href=x>The study itself</a></p></article>") == f"{want}\nThe study itself"
    assert main_text("<article><p><a href=a>one link</a></p><p><a href=b>two links</a></p></article>") == "one link\ntwo links"


def test_op6_result_needs_the_smoothing(monkeypatch):
    """Without the Gaussian, titles in links between paragraphs are taken for a menu and text around the core is lost; with it, they stay."""
    from docloom.llm import html_content

    titles = "<ul><li><a href=a>The first of the studies that this was about, in full and with its year</a></li><li><a href=b>The second of the studies that this was about, in full and with its year</a></li></ul>"
    pages = [f"<article><p>{LONG}</p><p>{LONG}</p>{titles}<p>{LONG}</p><p>{LONG}</p></article>", f"<main><p>intro</p><article><p>{LONG}</p><p>{LONG}</p></article><p>end</p></main>"]
    smooth = [html_content.main_text(p) for p in pages]
    assert "The first of the studies" in smooth[0] and smooth[1].startswith("intro\n") and smooth[1].endswith("\nend")
    monkeypatch.setattr(html_content, "smoothed", lambda ratios, sigma=1.0: ratios)
    raw = [html_content.main_text(p) for p in pages]
    assert "studies" not in raw[0] and "intro" not in raw[1] and "end" not in raw[1].split("\n")
