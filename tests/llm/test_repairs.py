"""Fill-in-the-middle, main text of pages and conversation repair, each against a plain version."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from frameloom.llm import conversations, fim, mainhtml
from frameloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_fim(doc_id, text):
    text, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    w = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(w)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_rank_and_select_equal_counting():
    rng = np.random.default_rng(3)
    for size, share in ((1, 1.0), (511, 0.5), (512, 0.01), (5000, 0.3), (5000, 0.0), (1300, 1.0)):
        flags = rng.random(size) < share
        bits, ones = fim.Bits(flags), np.flatnonzero(flags)
        assert bits.total == len(ones)
        at = np.arange(size + 1)
        assert (bits.rank(at) == np.concatenate([[0], np.cumsum(flags)])).all()
        assert (bits.select(np.arange(len(ones))) == ones).all()


def test_fill_in_middle_of_odd_texts(spark):
    texts = [None, "", "a", "é", "<P> here", "a<S", "S>a", "ß1Ünï cödé\n\x00<M", "word " * 30_000, "x" * 70_000, "日本語 text 日本", "P><<", "word one two", "word one two"]
    rows = [(k, t, "z") for k, t in enumerate(texts * 4)] + [(None, "no id", "z"), (3, "again", "z"), (3, "again", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string")
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in fim.fill_in_middle(docs).collect() if r["doc_id"] is not None)
    assert got == sorted((False, i, *plain_fim(i, t)) for i, t, _ in rows if i is not None)
    assert {r[3] for r in got} == {"plain", "psm", "spm"}
    back = fim.digests(docs).collect()
    want = {(i, sha(plain_fim(i, t)[-1]), sha(t or "")) for i, t, _ in rows}
    assert len(back) == len(rows) and {(r["doc_id"], r["output_sha256"], r["restored_sha256"]) for r in back} == want
    assert fim.digests(docs.limit(0)).count() == 0


def test_fim_query_equals_plain_version(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(SF + "/documents.parquet").collect()}
    rows = QUERIES["op11_fim"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, form, p, m, out = plain_fim(r["doc_id"], texts[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) == (n, form, p, m, sha(out), sha(texts[r["doc_id"]] or ""))


PAGE = """<html><head><title>x</title></head><body><header><a href=/>Home</a> Site</header><div id="cookie-notice"><p>We use cookies on this site, for reasons that take many words.</p></div>
<div class="content"><h1>Title here</h1><p>First paragraph of some <a href=x>linked</a> words, &amp; more of them; so that it is long enough.<br>next line</p>
<ul><li>one<li>two</ul><p class="promo">Buy now<p>Second one &nbsp; has   more.</p><form><label>Mail</label><input></form><script>if (a < b) { "<p>no</p>" }</script><p>Third.</p></div>
<div class="sidebar"><h3>Popular</h3><ul><li><a href=1>a b c d e f g h</a></ul></div><section id="comments"><div class="comment"><p>I think this is a very long reader comment that goes on and on.</p></div></section><footer>&copy; me</footer></body></html>"""


def test_main_text_of_pages_without_an_article_element():
    want = ["Title here", "First paragraph of some linked words, & more of them; so that it is long enough. next line", "one", "two", "Second one has more.", "Third."]
    assert mainhtml.main_text(PAGE).split("\n\n") == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), (" \n ", ""), ("<p>just text", "just text"), ("no tags &lt;b&gt; at all", "no tags <b> at all"), ("<nav><ul><li><a>x</a></ul><div><p>Body text here.</div>", "Body text here."),
        ("<article><header><h1>T</h1><p>by me</p></header><p>x <b>y</b>z</p><aside>q</aside><article class='comment'>c</article><footer>f</footer></article><p>out</p>", "T\n\nx yz"),
        ("<article><p>a &am b</p><p><a href=1>only a link</a></p><!-- <p>gone</p> --><p>&#233;&eacute;&#x4e2d;</p>", "a &am b\n\nonly a link\n\néé中"),
        ("<nav>m</nav><div class=ad>buy<article><h1>H</h1></article>", "H"), ("<script>never closed <p>x</p>", ""), ("<p title='<p>q</p>'>v</p>", "v"), ("a < b and c > d", "a < b and c > d"),
        ("<div class='content has-sidebar'><p>Text.</p></div><div class='left-sidebar'>gone</div><div class='no-comments'>Kept too.</div>", "Text.\n\nKept too."),
        ("<body><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul><div><p>" + "word " * 40 + "</p></div></body>", ("word " * 40).strip()),
    ],
)
def test_main_text_of_odd_pages(page, want):
    assert mainhtml.main_text(page) == want


def test_regions_open_at_surges_and_close_at_dives():
    weights = np.array([0, 0, 5, 50, 0, 40, 0, 0, 0, 3, 0, 0, 0, 60])
    assert [(a, b) for a, b in mainhtml.regions(weights, 0.2)] == [(2, 6), (13, 14)]
    assert mainhtml.regions(np.zeros(4, np.int64), 0.2) == [] and mainhtml.regions(np.zeros(0, np.int64), 0.2) == []


def test_pages_query_equals_the_article_elements(spark):
    """The given pages mark their articles, so that a plain cut at the tags tells what has to be kept."""
    import html

    pages = spark.read.parquet(SF + "/pages.parquet").collect()
    got = {r["page_id"]: r for r in QUERIES["op12_html"](spark, SF).collect()}
    assert len(got) == len(pages)
    for page in pages:
        article = page["html"][page["html"].index("<article>") : page["html"].index("</article>")]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", b))).strip() for b in re.split("</?p>|</?h1>|<br>", article)]
        r = got[page["page_id"]]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"]) and r["url"] == page["url"]


def test_pages_with_nulls_repeats_and_other_columns(spark):
    rows = [(None, "u", "<p>a</p>", 1), (1, None, None, 1), (2, "u", "", 1), (2, "u", "", 1), (3, "u", "<article>" + "<p>long text</p>" * 40_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted((r["page_id"] or 0, r["url"] or "", r["text"][:9], r["n_chars"]) for r in mainhtml.extract(pages).collect())
    assert got == [(0, "u", "a", 1), (1, "", "", 0), (2, "u", "", 0), (2, "u", "", 0), (3, "u", "long text", 40_000 * 9 + 39_999 * 2)]
    assert mainhtml.extract(pages.limit(0)).count() == 0


KEEP = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
MADE = {"0": "u", "s": "u", "u": "a", "a": "u"}


def plain_repair(rows):
    """Damaged rows (turn, role, text) in order: digest columns, by strings of edits instead of automaton states."""
    seen, kinds, illegal = set(), [], 0
    counts = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
    for k, (_, role, text) in enumerate(rows):
        kept = text.strip(" \t\n\x0b\x0c\r")
        kind = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else ""
        seen.add((role, text))
        kinds.append(kind)
        counts[kind] += 1
        illegal += k > 0 and rows[k - 1][1][:1] + role[:1] not in ("su", "ua", "au")
    best = {q: min((3 * k, "I" * k, ["user:", "assistant:"][:k] if q != "u" else ["assistant:"]) for k in ((0, 2) if q == "a" else (0,) if q == "0" else (2,) if q == "s" else (1,))) for q in MADE}
    for (_, role, text), kind in zip(reversed(rows), reversed(kinds)):
        after, now, cut = best, {}, 3 * (kind == "truncated")
        for q in MADE:
            ways = []
            for made in range(4):  # rows put in before this one
                p, lines = q, []
                for _ in range(made):
                    p = MADE[p]
                    lines.append("user:" if p == "u" else "assistant:")
                arcs = [("D", 4, p, [])]
                if kind in ("", "truncated"):
                    to = MADE[p]
                    arcs.append(("R", 3 + cut, to, [("user:" if to == "u" else "assistant:") + text]))
                    if (p, role[:1]) in KEEP:
                        arcs.append(("K", cut, KEEP[p, role[:1]], [f"{role}:{text}"]))
                ways += [(3 * made + c + after[to][0], "I" * made + letter + after[to][1], [*lines, *line, *after[to][2]]) for letter, c, to, line in arcs]
            now[q] = min(ways)
        best = now
    cost, audit, lines = best["0"]
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha("\n".join(lines)), lines


def damage(rows):
    """Rows (conv_id, turn, role, text) by conversation, damaged and in order."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1))
    return {conv: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for conv, rows in out.items()}


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def odd_conversations():
    rng, rows = random.Random(8), []
    for conv in [None, *range(60)]:
        for turn in range(rng.choice((1, 2, 3, 6, 9, 30))):
            rows.append((conv, rng.choice((turn, turn, turn, None, 2, -5)), rng.choice(("user", "assistant", "system", "tool", None, "", "User", "sup")), rng.choice(("Yes.", "No!", "cut", " \t", "", None, "a?  ", "x ", "Ωmega. " * 9, f"text {turn}."))))
    rows += [(500, k, ("user", "assistant")[k % 2], "same" if k % 3 else f"line {k}.") for k in range(700)]  # one that holds a third
    return rows


@pytest.mark.parametrize("piece", [5, 64, 16_384])
def test_repair_of_odd_conversations_in_pieces(spark, piece):
    rows = odd_conversations()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, part int").repartition(7)
    want = {conv: plain_repair(own) for conv, own in damage(rows).items()}
    got = {r["conv_id"]: tuple(r[c] for c in RESULT) for r in conversations.repair(table, piece).collect()}
    assert got == {conv: w[:-1] for conv, w in want.items()}
    lines = {}
    for r in sorted(conversations.repaired_turns(table, piece).collect(), key=lambda r: r["place"]):
        lines.setdefault(r["conv_id"], []).append((r["place"], f"{r['role']}:{r['text']}"))
    assert lines == {conv: list(enumerate(w[-1])) for conv, w in want.items() if w[-1]}


def test_repair_of_nothing_and_of_conversations_that_vanish(spark):
    dropped = next(k for k in itertools.count() if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(dropped, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    (row,) = conversations.repair(table).collect()
    assert tuple(row[c] for c in RESULT) == (0, 0, 0, 0, 0, 0, "", sha(""))
    assert conversations.repair(table.limit(0)).count() == 0


def test_conversations_query_equals_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(SF + "/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {conv: plain_repair(own)[:-1] for conv, own in damage(rows).items()}
    assert {r["conv_id"]: tuple(r[c] for c in RESULT) for r in QUERIES["op13_conversations"](spark, SF).collect()} == want
