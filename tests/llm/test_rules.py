"""Quality rules, sharding, licences, languages and pages."""

import zlib
from collections import Counter

from pyspark.sql import functions as F

from ledgerlens.llm import catalog, html_text, language, licenses, quality, sharding
from tests.llm.frames import documents, odd, prose


def brute_quality(text: str) -> tuple:
    words = (text or "").encode().split()
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(len(w.decode()) for w in words), symbols, len(lines) - len(set(lines)), len(inside), failed


PARAGRAPHS = "".join(f"<p>This is paragraph {i}, which has some words, and a full stop. It goes on for a while.</p>" for i in range(8))


def test_words_of_a_class_only_raise_doubt():
    """Layout classes that name a side bar or comments don't take the article with them; the parts themselves go."""
    body = [f"This is paragraph {i}, which has some words, and a full stop. It goes on for a while." for i in range(8)]
    side = '<div class="sidebar"><ul><li>a link</li><li>another, with words.</li></ul></div>'
    pages = {
        f'<div class="layout has-sidebar"><div class="content">{PARAGRAPHS}</div>{side}</div>': body,
        f'<div id="story" class="with-comments">{PARAGRAPHS}</div><div class="comments"><p>first!</p></div>': body,
        f'<div class="content sidebar-left">{PARAGRAPHS}</div>{side}': body,
        f'<div class="post"><div class="post-header"><h1>The title</h1></div><div class="post-body">{PARAGRAPHS}</div></div>': ["The title", *body],
        f'<div class="site-header"><p>Some name, and a line.</p></div><div class="content">{PARAGRAPHS}</div>': body,
        f'<div class="ad">{PARAGRAPHS}{PARAGRAPHS}</div><article><h1>Short</h1><p>One line, no more.</p></article>': ["Short", "One line, no more."],
    }
    for page, want in pages.items():
        assert html_text.main_text(f"<body>{page}</body>").split("\n") == want, page


def test_unclosed_tags_cost_little():
    import time
    import tracemalloc

    start = time.perf_counter()
    assert html_text.main_text("<div>" * 40_000) == ""
    assert len(html_text.main_text("".join(f"<div>text {i}" for i in range(20_000)))) > 100_000
    assert time.perf_counter() - start < 5
    tracemalloc.start()
    html_text.main_text("<div>" * 40_000)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def published(name: str, width: int, title: str | None = None, mark: str = "{}.") -> str:
    """A licence text as files have it: a title, a copyright line, wrapped paragraphs, marked items."""
    import textwrap

    first, *rest = licenses.TEXTS[name].split("\n")
    out, n = [first if title is None else title, "", "Copyright (c) 2020 Jane Q. Public", ""], 0
    for part in rest:
        if part[:3] in ("1. ", "2. ", "3. "):
            n += 1
            part = mark.format(n) + part[2:]
        out += [*textwrap.wrap(part, width), ""]
    return "\n".join(out).strip("\n")


def test_licences_as_they_are_published(spark):
    texts = [(f"{n} {w}", published(n, w), n) for n in ("MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause") for w in (60, 64, 68, 72, 76, 80, 100)]
    texts += [("no title", published("MIT", 72, ""), "MIT"), ("other title", published("MIT", 72, "The MIT License (MIT)"), "MIT")]
    texts += [("bsd no title", published("BSD-2-Clause", 72, ""), "BSD-2-Clause"), ("stars", published("BSD-2-Clause", 72, None, "*"), "BSD-2-Clause")]
    texts += [("brackets", published("BSD-3-Clause", 72, None, "{})"), "BSD-3-Clause"), ("name only", published("ISC", 72).replace("(c) 2020 ", ""), "ISC")]
    lines = [("notice", "This project is released under the MIT License. See LICENSE.", "MIT"), ("spdx", "# SPDX-License-Identifier: MIT", "MIT")]
    lines += [("gpl", "Words. // SPDX", None), ("spdx gpl", "// SPDX-License-Identifier: GPL-3.0-or-later\nint main;", "GPL-3.0")]
    rows = documents(spark, [(i, text) for i, (_, text, _) in enumerate(texts + lines)])
    found = {r.doc_id: (r.license_id, r.whole_text) for r in licenses.scan(rows, "doc_id").collect()}
    for i, (name, _, want) in enumerate(texts):
        assert found.get(i) == (want, True), name
    for i, (name, _, want) in enumerate(lines, len(texts)):
        assert (found.get(i) or (None, None))[0] == want, name


def test_what_is_a_copyright_line(spark):
    gone = ["Copyright (c) 2020 A", "copyright 1999-2020 The X Project", "(C) 2001 Y", "© 2020", "# Copyright by Z", "All rights reserved.", "Copyright Jane Doe"]
    stay = ["copyright notice and this permission notice appear in all copies.", "COPYRIGHT HOLDERS BE LIABLE", "copyright notice, this list of", "the copyright 2020", "(c) You must retain"]
    rows = spark.createDataFrame([(x,) for x in gone + stay], "line string")
    assert [r[0] == "" for r in rows.select(licenses.canonical(F.col("line"))).collect()] == [True] * len(gone) + [False] * len(stay)


def test_base_counts(spark, folder):
    rows = catalog.documents(spark, folder).select("doc_id", "text").union(odd(spark).select("doc_id", "text"))
    found = quality.quality(rows.withColumn("copy", F.col("text")).withColumn("KEPT", F.lit("clash"))).collect()
    assert len(found) == rows.count()
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(r.copy)
        assert not (r.kept and r.base_failed)


def test_lines_decide(spark):
    good, menu, shout = prose(4, 60), "\n".join(f"Home | About | Item{i} |" for i in range(40)), prose(5, 60).upper()
    signs = " ".join(w + "###" for w in prose(6, 60).split())
    rows = documents(spark, [(1, good), (2, good + "\n" + menu), (3, shout), (4, signs), (5, good + "\nHome | About")])
    kept = {r.doc_id: r.kept for r in quality.quality(rows).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: True}
    assert quality.quality(rows).where("doc_id = 5").first().cleaned == good
    assert quality.quality(documents(spark, [])).count() == 0


def test_shards_are_whole_even_and_gapless(spark, folder):
    rows = catalog.QUERIES["op3_sharding"](spark, folder).collect()
    docs = catalog.documents(spark, folder).collect()
    want = Counter((d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in rows if r["shard"] == s) == list(range(counts[s])) for s in counts)
    again = catalog.QUERIES["op3_sharding"](spark, folder).collect()
    assert set(rows) == set(again)


def test_repeated_and_null_rows_are_dealt_one_by_one(spark):
    df = spark.createDataFrame([(None, 1)] * 40_000 + [(i, 2) for i in range(500)], "id long, x int")
    plan = sharding.shuffle_plan(df, ["id", "x"], 4, seed=3, bucket_rows=2000)
    rows = plan.collect()
    assert len(rows) == 40_500 and Counter(r["shard"] for r in rows) == dict.fromkeys(range(4), 10_125)
    nulls = Counter(r["shard"] for r in rows if r.id is None)
    assert max(nulls.values()) - min(nulls.values()) < 300  # spread, not in a block
    assert sharding.shuffle_plan(df.limit(0), ["id", "x"], 4).count() == 0
    other = sharding.shuffle_plan(df.repartition(7), ["id", "x"], 4, seed=3, bucket_rows=2000)
    assert Counter(map(tuple, other.collect())) == Counter(map(tuple, rows))


def test_written_shards(spark, tmp_path):
    df = odd(spark)
    sharding.write_shards(df, str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    same = [c for c in df.columns]
    assert Counter(map(tuple, back.select(same).collect())) == Counter(map(tuple, df.select(same).collect()))
    assert max(r["count"] for r in back.groupBy("shard").count().collect()) <= -(-df.count() // 3)


def test_licences(spark):
    mit = licenses.TEXTS["MIT"].replace("MIT License", "The  mit LICENCE!").replace("The  mit", "MIT")
    rows = documents(spark, [
        (1, "Copyright (c) 2001 A. Body\n\n" + mit), (2, prose(1, 20) + "\nReleased under the MIT Licence.\nreleased under the mit license"),
        (3, None), (4, ""), (5, "© all mine"), (6, "Licensed under CC-BY-NC 4.0"), (None, "Released under the ISC license."), (7, "MIT"),
    ]).withColumn("license_id", F.lit("clash"))
    found = {(r.doc_id, r.license_id, r.whole_text, r.n_lines) for r in licenses.scan(rows, "doc_id").collect()}
    assert found == {(1, "MIT", True, 0), (2, "MIT", False, 2), (6, "CC-BY-NC-4.0", True, 1), (None, "ISC", True, 1)}
    assert licenses.scan(rows.limit(0), "doc_id").count() == 0


def test_licences_of_own_texts(spark):
    rows = documents(spark, [(1, "My own terms: do as you like."), (2, "my OWN terms do as you like")])
    assert licenses.scan(rows, "doc_id", texts={"OWN": "My own terms; do as you like"}).where("whole_text").count() == 2


def test_language_of_held_out_documents(spark, folder):
    rows = catalog.QUERIES["op10_language"](spark, folder).collect()
    docs = {r.doc_id: r for r in catalog.documents(spark, folder).collect()}
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)


def brute_model(texts: list[str], order: int) -> dict:
    """Kneser-Ney by its definition, in dictionaries of strings."""
    grams = Counter()
    for t in texts:
        s = " " * (order - 1) + t + " "
        for i in range(order - 1, len(s)):
            for n in range(1, order + 1):
                grams[s[i - n + 1 : i + 1]] += 1
    return grams


def test_probabilities_are_kneser_ney(spark):
    texts = ["abab ba", "abba ab", "baab aab a"]
    rows = spark.createDataFrame([("x", t) for t in texts], "lang string, text string")
    model = language._model(language.count_grams(rows, "text", "lang", 3).toPandas(), 3)
    grams = brute_model(texts, 3)

    def count(g):
        return grams[g] if len(g) == 3 else sum(h[1:] == g for h in grams if len(h) == len(g) + 1)

    def p(g):
        n = len(g)
        own = {h: count(h) for h in grams if len(h) == n and count(h)}
        ones, twos = (sum(v == k for v in own.values()) for k in (1, 2))
        d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
        lower = p(g[1:]) if n > 1 else 1 / max(2, sum(len(h) == 1 for h in grams))
        same = {h: v for h, v in own.items() if h[:-1] == g[:-1]}
        total = sum(same.values())
        return max(own.get(g, 0) - d, 0) / total + d * len(same) / total * lower if total else lower

    data = "abab".encode()
    import numpy as np

    chars, bounds, _ = language.characters(data, np.array([0, 4]), 3)
    got = model.score(chars, language._places(bounds, 3))[:, 0]
    padded = "  abab "
    want = [np.log(p(padded[i - 2 : i + 1])) for i in range(2, 7)]
    assert np.allclose(got, want, atol=1e-4)


def test_language_of_odd_documents(spark):
    learn = documents(spark, [(i, prose(i, 60), "xx") for i in range(30)] + [(i, "über die straße gehen wir nicht " * 9, "yy") for i in range(30, 60)] + [(60, None, "xx"), (61, "z", None)])
    model = language.fit(learn, ["doc_id"])
    rows = odd(spark).withColumn("SCORE", F.lit("clash")).withColumn("extra", F.lit(1))
    out = language.predict(rows.withColumn("copy", F.col("text")), model).collect()
    assert len(out) == rows.count()
    for r in out:
        has = any(c.isalpha() for c in r.copy or "")
        assert (r.lang_pred == "und") == (not has) and (r.score > 0) == has and r.extra == 1
        assert r.rejected or has
    assert language.fit(learn.limit(0), ["doc_id"]) is None
    assert {r.lang_pred for r in language.predict(rows, None).collect()} == {"und"}
    assert language.predict(rows.limit(0), model).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a < b) { x("</p>") }</script></head><body>
<header><p>Site header, with words. And more words, in a long line.</p></header><nav><ul><li><a>Home</a><li><a>News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, and so on. Please accept them, or else.</p></div>
<div id="content"><h1>A &lt;title&gt;</h1><p>First  <b>bo</b>ld
line, of text.<p>Second &amp; last, here.<br>More<ul><li>one<li>two</ul><!-- <p>not this</p> --></div>
<aside><p>Related: a long text, which should not be here. Really, not at all.</p></aside>
<div class="comments"><article class="comment"><p>What a comment, it is long. And it goes on, and on.</p></article></div>
<form><p>Sign up, now. It is free, of course.</p></form><footer>&copy; us</footer></body>"""


def test_page():
    assert html_text.main_text(PAGE).split("\n") == ["A <title>", "First bold line, of text.", "Second & last, here. More", "one", "two"]


def test_pages_of_plain_containers_are_whole():
    title, lead, last = "A plain title", prose(31, 30), prose(33, 25)
    body = [prose(40 + i, 60) for i in range(4)]
    text = "".join(f"<p>{x}</p>" for x in body)
    menu = '<div class="menu"><a>Home</a> <a>News</a></div>'
    for tag in ("div", "section"):
        page = f"<body>{menu}<{tag} id=post><h1>{title}</h1><{tag} class=lead><p>{lead}</p></{tag}><{tag} class=text>{text}</{tag}><{tag}><p>{last}</p></{tag}></{tag}></body>"
        assert html_text.main_text(page).split("\n") == [title, lead, *body, last]
        page = f"<body>{menu}<{tag} id=post><h1>{title}</h1><{tag} class=text>{text}</{tag}></{tag}></body>"
        assert html_text.main_text(page).split("\n") == [title, *body]
    page = f"<body>{menu}<table><tr><td><h1>{title}</h1><div><p>{lead}</p></div><div>{text}</div></td></tr></table></body>"
    assert html_text.main_text(page).split("\n") == [title, lead, *body]


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "plain &amp; text"), (4, "u", "<p>cut <a hre"), (5, "u", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    rows += [(6, "u", "<script>only</script>"), (None, None, PAGE), (7, "u", "<p>1 < 2</p></b></x>"), (8, "u", "<p title='>'>q</p><!-- open")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("TEXT", F.lit("clash"))
    got = {r.page_id: r["text"] for r in html_text.extract(df).collect()}
    assert got == {1: "", 2: "", 3: "plain & text", 4: "cut", 5: "deep", 6: "", None: html_text.main_text(PAGE), 7: "1 < 2", 8: "q"}
    assert html_text.extract(df.limit(0)).count() == 0


def test_pages_of_the_table(spark, folder):
    import html
    import re

    for r in catalog.QUERIES["op7_html"](spark, folder).join(spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = re.sub(r"<[^>]*(>|$)", "", re.sub(r"</?(?:p|h1)>", "\x00", body.replace("<br>", " "))).split("\x00")
        want = "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)
        assert r["text"] == want and r.n_chars == len(want)
