"""Chat, pages, toxicity, leaks, host rules and site lines on small tables with nulls, ties and clashing names."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sensorloom.llm import chat, contamination, host_rules, page_text, site_lines, toxicity


# Chat


def test_turns_survive_the_round_trip():
    random.seed(1)
    parts = ["\\", "### ", "###", "#", "</turn>", "</turn>\n", ": ", ":", "x", "\n", "Assistant", "é"]
    for _ in range(5000):
        role, text = ("".join(random.choices(parts, k=random.randint(0, n))) for n in (4, 8))
        (turn,) = chat.parse(chat.render(role, text))
        assert turn[:2] == (role, text)
    assert chat.parse("### user: a</turn>\nrest") is None and chat.parse("") == []
    assert chat.render("user", "plain text") == "### user: plain text</turn>\n"


def test_conversations_are_read_back(spark):
    rows = [
        (1, 1, "assistant", "\\### Assistant: </turn> ok"), (1, 0, "user", "\\### Assistant: </turn> ok"),
        (2, 0, "user", None), (2, 1, None, "é"), (3, 0, "assistant", ""), (None, 0, "assistant", "x"),
        (4, 0, "assistant", "same"), (4, 0, "assistant", "same"),
    ] + [(5, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(3000)]
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn int, role string, text string, rendered string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(turns.repartition(4))).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv_id, row in got.items():
        own = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv_id))
        learned = "".join(text for _, role, text in own if role == "assistant")
        assert row["n_turns"] == len(own)
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert (row["loss_chars"], row["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert row["formatted_chars"] == sum(len(chat.render(r, t)) for _, r, t in own)
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


# Pages

PAGE = """<!DOCTYPE html><html><head><title>no</title><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=x>one</a></ul></nav><!-- no <p>x</p> --><div class="ad">Buy &amp; go</div>
<article><header><h1>The  title &lt;1&gt;</h1></header><p><b>First.<br><p>A &amp; B are in the text of the page and it is the best of all.</p>
<p class=notice>no</p><p>Er.</p><ul><li>one<li>two &nbsp; three</ul><form><p>no</p></form>
<section class="post comments"><p>I like the text of the page and it is good that it is here.</p></section></article>
<aside><p>More of the texts that are on this site for you to read and to see.</p></aside><footer>&copy; no</footer></body></html>"""


def test_the_article_is_kept_whole():
    wanted = "The title <1> First. A & B are in the text of the page and it is the best of all. Er. one two three"
    assert page_text.main_text(PAGE) == wanted


def test_pages_without_an_article():
    long = "This is the text of the page and it is long enough to be decided by the words that are in it."
    other = "Kaufen Jetzt Sparen Angebot Preis Aktion Rabatt Gutschein Bestellen Lieferung Warenkorb Konto"
    page = f"<body><div>{other}</div><h2>Head</h2><p>{long}</p><p>Short.</p><p>{long}</p><div><a href=y>{long}</a></div></body>"
    assert page_text.main_text(page) == f"Head {long} Short. {long}"
    assert page_text.main_text("<p>Only this</p>") == "Only this"
    for broken in ("", "<", "<p", "a < b", "<!-- open", "<script>never closed", "<a href='x>y", "</p></div>"):
        page_text.main_text(broken)
    assert page_text.main_text("a < b") == "a < b"


def test_pages_table(spark):
    rows = [(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, "t"), (2, "v", "", "t"), (3, "w", "<p>" + "the x " * 50_000, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = page_text.extract_main_text(pages).collect()
    assert len(got) == 5 and got[0] == got[1]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["page_id"]: r["n_chars"] for r in got}[3] == 299_999
    assert page_text.extract_main_text(pages.limit(0)).count() == 0


# Toxicity


def test_pairs_of_words_are_learnt(spark):
    """Toxic are texts with both words; each alone is not, which no additive score can tell apart as well."""
    random.seed(4)
    plain = [f"w{i}" for i in range(30)]
    rows, labels = [], []
    for i in range(1500):
        extra = [w for w in ("insult", "group") if random.random() < 0.5]
        words = random.sample(plain, 5) + extra
        random.shuffle(words)
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(len(extra) == 2)))
    rows += [(5000, None, "s"), (None, "insult group", "s"), (5001, "", "s"), (1, rows[1][1], "s"), (5002, "Insult, GROUP! " * 2000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    known = spark.createDataFrame([*labels, (None, 1), (7777, None), (1, labels[1][1])], "doc_id long, toxic int")
    settings = toxicity.Settings(bits=14, rate=0.2, epochs=12)
    machine = toxicity.fit_toxicity(docs, known, F.col("doc_id") % 4 != 2, settings=settings)
    scored = toxicity.score_toxicity(docs, machine, "toxicity").collect()
    assert len(scored) == len(rows) and all(0 <= r["toxicity"] <= 1 for r in scored)
    truth = dict(labels)
    held_out = [(r["toxicity"], truth[r["doc_id"]]) for r in scored if r["doc_id"] in truth and r["doc_id"] % 4 == 2]
    assert sum((s >= 0.5) == t for s, t in held_out) / len(held_out) > 0.97
    again = toxicity.fit_toxicity(docs.repartition(7), known, F.col("doc_id") % 4 != 2, settings=settings)
    assert (again.weights == machine.weights).all() and (again.factors == machine.factors).all()


def test_no_labels_and_one_class(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 1), (2, 1)]):
        known = spark.createDataFrame(labels, "doc_id long, toxic int")
        machine = toxicity.fit_toxicity(docs, known, F.lit(True))
        assert len({r["score"] for r in toxicity.score_toxicity(docs, machine).collect()}) == 1
    assert toxicity.score_toxicity(docs.limit(0), machine).count() == 0


# Leaks


def test_contained_items_equal_brute_force(spark):
    random.seed(6)
    vocabulary = [f"v{i}" for i in range(300)]
    text = lambda n: " ".join(random.choices(vocabulary, k=n))
    items = [(i, text(random.choice([1, 2, 4, 5, 9, 16, 40, 90]))) for i in range(60)] + [(98, None), (99, " "), (3, "Twice")]
    docs = [(i, text(random.choice([0, 3, 60, 700]))) for i in range(80)]
    for i in range(80, 160):
        words = items[i % 60][1].split()
        if i % 3 == 0 and len(words) > 12:
            words[len(words) // 2] = "other"
        docs.append((i, f"{text(random.choice([0, 100, 900]))} {' '.join(words).upper()}\n{text(50)}"))
    docs += [(500, None), (None, items[6][1]), (80, docs[80][1])]
    wanted = []
    for doc_id, doc in docs:
        for item_id, item in items:
            words = (item or "").split()
            if words:
                width = min(5, len(words))
                own = contamination._shingles(item, width)
                shared = len(own & contamination._shingles(doc or "", width))
                if shared >= 0.8 * len(own):
                    wanted.append((doc_id, item_id, shared, len(own), shared / len(own)))
    table = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted(map(tuple, contamination.contained_items(table, bench).collect()), key=key)
    assert got == sorted(wanted, key=key) and len(got) > 80
    clean = contamination.drop_contaminated(table, bench)
    leaky = {(r[0]) for r in wanted}
    assert clean.columns == table.columns
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - leaky
    assert contamination.contained_items(table, bench.limit(0)).count() == 0
    assert contamination.drop_contaminated(table.limit(0), bench).count() == 0


# Host rules


def test_host_verdicts_and_edges(spark):
    good = "The words of this text are all plain and every one of them is of its own kind: " + " ".join(f"word{i}" for i in range(60))
    bad = " ".join(f"#w{i}" for i in range(60))
    rows = [(i, good, "clean") for i in range(40)] + [(100 + i, bad, "dirty") for i in range(40)]
    rows += [(200, good, "dirty"), (201, bad, "clean"), (300, None, None), (301, "", "clean"), (302, "a b c " * 4000, None), (0, good, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    judged = {r["doc_id"]: r for r in host_rules.judge_documents(docs).collect()}
    assert all(judged[i]["kept"] for i in range(40)) and judged[200]["kept"]  # good texts stay on bad hosts
    assert not any(judged[100 + i]["kept"] or judged[100 + i]["base_failed"] for i in range(40))
    assert judged[201]["kept"]  # one failure on a good host
    assert [judged[i]["base_failed"] for i in (300, 301, 302)] == [True] * 3
    assert (judged[300]["n_words"], judged[302]["n_words"], judged[302]["n_repeat_words"]) == (0, 12_000, 12_000)
    clashing = docs.withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(1))
    kept = host_rules.keep_good_documents(clashing)
    assert kept.columns == clashing.columns and kept.count() == 43
    assert host_rules.keep_good_documents(clashing.limit(0)).count() == 0


# Site lines


def test_lines_fall_by_their_share_of_the_host(spark):
    rows = [(i, f"Menu\nbody {i}\n\n  Menu  \nlast {i % 2}", "a", 0) for i in range(20)]
    rows += [(100 + i, f"Menu\nb{i}", "b", 0) for i in range(4)]  # too few pages
    rows += [(200, None, "a", 0), (201, "Menu", "a", 0), (202, "", None, 0), (203, "x\n" * 3000, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int").withColumn("pages", F.lit("k"))
    out = site_lines.drop_boilerplate_lines(docs.repartition(3), n_chars="n_chars", dropped="gone")
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == [*docs.columns, "gone"] and len(got) == len(rows)
    assert got[3]["text"] == "body 3\n" and got[3]["gone"] == 3 and got[3]["n_chars"] == 7
    assert got[101]["text"] == "Menu\nb1" and got[101]["gone"] == 0
    assert got[200]["text"] is None and got[201]["text"] == "" and got[201]["gone"] == 1
    assert got[203]["text"] == "x\n" * 3000
    assert site_lines.drop_boilerplate_lines(docs.limit(0)).count() == 0


def test_copies_are_one_page_of_a_host(spark):
    """A host of which a third are copies of one clean text loses nothing of them."""
    copy = "\n".join(f"line {i} of the copied text" for i in range(12))
    rows = [(i, f"Menu\nbody {i}\nend {i}", "a") for i in range(40)] + [(100 + i, copy, "a") for i in range(20)]
    rows += [(200 + i, copy, "b") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = {r["doc_id"]: r for r in site_lines.drop_boilerplate_lines(docs, dropped="TEXT_").collect()}
    assert all(got[i]["text"] == f"body {i}\nend {i}" for i in range(40))
    assert all(got[i]["text"] == copy for i in [*range(100, 120), *range(200, 230)])
    again = site_lines.drop_boilerplate_lines(docs.withColumn("gone", F.lit(5)), dropped="gone")
    assert again.columns == ["doc_id", "text", "source", "gone"] and {r["gone"] for r in again.collect()} == {0, 1}


def test_a_document_falls_on_one_host_and_stays_on_another(spark):
    good = "The words of this text are all plain and every one of them is of its own kind: " + " ".join(f"word{i}" for i in range(60))
    bad = " ".join(f"#w{i}" for i in range(60))
    rows = []
    for host in range(20):  # one page in ten fails on most hosts, four in ten on the last two
        failing = 16 if host >= 18 else 4
        rows += [(1000 * host + i, bad if i < failing else good, f"h{host}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    judged = {r["doc_id"]: r for r in host_rules.judge_documents(docs).collect()}
    assert {k // 1000 for k, r in judged.items() if r["host_rejected"]} == {18, 19}
    assert not judged[18_000]["kept"] and judged[18_039]["kept"]
    assert judged[0]["kept"] and not judged[0]["base_failed"]
    # Hosts that are all alike: none is worse than the prior expects.
    alike = docs.where("doc_id < 18000")
    assert not any(r["host_rejected"] for r in host_rules.judge_documents(alike).collect())


def test_host_verdicts_on_the_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = host_rules.judge_documents(docs).cache()
    hosts = {r["source"] for r in judged.where("host_rejected").select("source").collect()}
    assert hosts == {"src4"}
    assert judged.where("host_rejected AND NOT base_failed AND NOT kept").count() == 7
    judged.unpersist()


def test_equal_turns_are_in_order_of_their_text(spark):
    rows = [(1, 0, "user", t) for t in ("### b", "Z", "a", "a b", "\\", None)] + [(1, None, "user", "first"), (1, 1, None, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3)
    (found,) = chat.read_back(chat.format_turns(turns)).collect()
    ordered = sorted(((-1 if n is None else n), r or "", t or "") for _, n, r, t in rows)
    wanted = "".join(f"{r}\n{t}\n" for _, r, t in ordered)
    assert found["turns_sha256"] == hashlib.sha256(wanted.encode()).hexdigest() and found["n_turns"] == len(rows)


@pytest.mark.parametrize(
    "part", ['<a x="q ', "<a x='q \" ", "<a ", "<a", "<!x ", "<", '<a "', "<div>", "</p>", "<p class=x>&amp;", "<a x=\"'\" '> "]
)
def test_hostile_pages_take_time_in_proportion(part):
    import time

    html = "<p>" + part * (1_000_000 // len(part)) + "</p><i>\">\'> end"
    start = time.perf_counter()
    page_text.blocks(html)
    assert time.perf_counter() - start < 12  # a second or two; minutes where a search begins again for each part


def test_open_quotes_make_text_and_not_tags():
    text = lambda html: [b.text for b in page_text.blocks(html)]
    assert text('<p>a <b x="1>2">c</b> <i x="open d') == ['a c <i x="open d']
    assert text("<p>x <!doctype y") == ["x <!doctype y"]
    assert text("<p title='\"'>one</p><p>two</p>") == ["one", "two"]
