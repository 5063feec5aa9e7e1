"""Chat formatting, ARC to WARC, HTML extraction: round trips and fixtures."""

import base64
import gzip
import hashlib
import json
import os
import random
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracewright import storage
from tracewright.llm import op04_chat_format as chat
from tracewright.llm import op06_arc_to_warc as arc
from tracewright.llm import op10_html_extraction as html

NASTY = ["", None, "plain", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "\\", "\\\\<|", "a\\n\nb", "<<SYS>>x<</SYS>>", "<", "<|im_end|>", "\n\n", "ä漢\u2028x", "<start_of_turn>", "x" * 30_000]


def test_turns_survive_the_template(spark):
    rows = [(c, k, role, NASTY[(c + 3 * k) % len(NASTY)]) for c in range(40) for k, role in enumerate(("system", "user", "assistant", "assistant")[: 2 + c % 3])]
    rows += [(50, 0, "user", "q"), (50, 1, "assistant", "a"), (51, 0, "user", "q"), (51, 1, "assistant", None), (52, 0, None, "x"), (53, 1, "we<|ird\nrole", "y"), (54, 0, "user", "t"), (54, 0, "user", "t"), (None, 1, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS turns", "2 AS payload")
    made = chat.format_chats(chat.as_records(df))
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    layouts = {r.layout for r in made.select("layout").distinct().collect()}
    assert None not in layouts and len(layouts) >= 4
    by = {}
    for c, k, role, text in rows:
        by.setdefault(c, []).append((k, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in made.collect():
        assert r.formatted.count(chat.START) == len(by[r.conv_id]) and "</s>" not in r.formatted


def test_layouts_by_fingerprint(spark):
    records = [
        (1, {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages"),
        (2, {"conversations": [{"from": "human", "value": "q"}, {"value": "a", "from": "gpt"}]}, "sharegpt"),
        (3, {"instruction": "do", "input": "this", "output": "a"}, "instruction"),
        (4, {"instruction": "q", "output": "a"}, "instruction-only"),
        (5, {"prompt": "q", "completion": "a"}, "prompt-completion"),
        (6, {"answer": "a", "question": "q"}, "question-answer"),
        (7, {"unknown": [1]}, None),
        (8, {"messages": []}, "messages"),
    ]
    rows = [(i, json.dumps(x)) for i, x, _ in records] + [(9, "no json"), (10, None)]
    got = {r.id: r for r in chat.format_chats(spark.createDataFrame(rows, "id long, payload string"), "id").collect()}
    assert [got[i].layout for i, _, _ in records] == [x for _, _, x in records] and got[9].layout is None and got[10].layout is None
    for i in (1, 2, 4, 5, 6):
        assert [tuple(t) for t in got[i].turns] == [("user", "q"), ("assistant", "a")]
    assert got[3].turns[0].text == "do\n\nthis" and got[8].turns == [] and got[7].turns is None
    assert chat.format_chats(spark.createDataFrame([], "id long, payload string"), "id").count() == 0


def test_turns_beyond_the_readers_default_length(spark):
    long = F.expr("repeat('x', 20000001)")
    rows = spark.range(2).select(F.when(F.col("id") == 0, F.to_json(F.struct(F.lit("q").alias("prompt"), long.alias("response")))).otherwise(F.to_json(F.struct(F.array(F.struct(F.lit("assistant").alias("role"), long.alias("content"))).alias("messages")))).alias("payload"), "id")
    got = {r.id: r for r in chat.canonical(rows).select("id", "layout", F.transform("turns", lambda t: F.length(t["text"])).alias("n")).collect()}
    assert (got[0].layout, got[0].n, got[1].layout, got[1].n) == ("prompt-response", [1, 20_000_001], "messages", [20_000_001])


def test_unreadable_records_get_no_empty_turns(spark):
    read = chat.LAYOUTS[3].convert(F.col("payload"))
    got = spark.createDataFrame([('{"prompt": "q", "resp',), ('{"prompt": "q", "response": "a"}',)], "payload string").select(read.alias("turns")).collect()
    assert got[0].turns is None and [t.text for t in got[1].turns] == ["q", "a"]


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_archives_round_trip(spark, tmp_path):
    pages = [(1, "http://a/", "same"), (2, "http://b/x y", "same"), (3, None, None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\n\r\n\r\nContent-Length: 3\r\n\r\n"), (6, "ü", "ä漢" * 9_000), (-7, "n", "same"), (9, "r", "rep"), (9, "r", "rep"), (None, "q", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS _id")
    got = arc.archive(df, path=str(tmp_path / "warc")).collect()
    assert len(got) == len(pages) and all(r.sound for r in got)
    last = {}
    for i, _, h in pages:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    want = sorted((repr(i), len((h or "").encode()), sha((h or "").encode()), "response" if i == last[h or ""] else "revisit", None if i == last[h or ""] else last[h or ""]) for i, _, h in pages)
    assert sorted((repr(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert arc.archive(df.limit(0), path=str(tmp_path / "none")).count() == 0
    files = [gzip.decompress(f.read_bytes()) for f in (tmp_path / "warc").glob("part-*")]  # any gzip reader takes them
    assert sum(f.count(b"WARC-Record-ID") for f in files) == len(pages) + len(files)


def test_archives_are_rolled_by_bytes(spark, tmp_path):
    rng = random.Random(1)
    payloads = [rng.randbytes(20_000).hex() for _ in range(30)] + [rng.randbytes(300_000).hex()]
    df = spark.createDataFrame([(k, "u", p) for k, p in enumerate(payloads)], "page_id long, url string, html string").coalesce(1)
    records = arc.convert(arc.legacy_archives(df)).withColumn("refers_to", F.lit(None).cast("long"))
    arc.write_archives(records, str(tmp_path / "w"), 100_000)
    sizes = sorted(f.stat().st_size for f in (tmp_path / "w").glob("part-*"))
    assert len(sizes) > 6 and all(s < 125_000 for s in sizes[:-1]) and 300_000 < sizes[-1] < 600_000  # the long record has a file of its own
    got = arc.read_archives(spark, str(tmp_path / "w")).collect()
    assert sorted(r.page_id for r in got) == list(range(31)) and all(r.sound for r in got)


def test_headers_keep_their_bytes(spark, tmp_path):
    """HTTP headers beyond ASCII are stored as they came, and a store's files go with the staged tables."""
    document = b"HTTP/1.0 200 OK\r\nX-Page-Id: 5\r\nServer: caf\xe9\xff\r\n\r\nbody"
    content = arc.arc_file("x.arc", 1, [("http://a/", "1.2.3.4", "20010203040506", "text/html", document)])
    records = arc.convert(spark.createDataFrame([(content,)], "content binary")).withColumn("refers_to", F.lit(None).cast("long"))
    path = storage.new_folder(spark, "warc-test")
    arc.write_archives(records, path)
    [raw] = [r.content for r in spark.read.format("binaryFile").load(path).select("content").collect()]
    assert [block for head, block in arc.warc_records(bytes(raw)) if head["warc-type"] == "response"] == [document]
    storage.clear_staged(spark)
    assert not os.path.exists(path.removeprefix("file:"))


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed", [False, True])
def test_arc_versions(spark, version, packed):
    records = [("http://a/", "1.2.3.4", "20010203040506", "text/html", b"HTTP/1.0 200 OK\r\nX-Page-Id: 12\r\n\r\nbody\n\n"), ("dns:a", "1.2.3.4", "200102030405", "text/dns", b"\n\nraw")]
    content = arc.arc_file("x.arc", version, records)
    df = spark.createDataFrame([(gzip.compress(content) if packed else content,), (content[:-20],), (b"",), (None,)], "content binary")
    got = arc.convert(df).collect()
    assert [(r.page_id, r.uri, bytes(r.payload), r.warc_date) for r in got[:2]] == [(12, "http://a/", b"body\n\n", "2001-02-03T04:05:06Z"), (None, "dns:a", b"\n\nraw", "2001-02-03T04:05:00Z")]
    assert got[0].digest == sha(b"body\n\n") and len(got) == 3  # the torn file gives its whole record


def test_record_identifiers(spark):
    ids = [0, 1, -1, 2**63 - 1, -(2**63), 123456789, None]
    df = spark.createDataFrame([(i,) for i in ids], "page_id long").select("page_id", arc.record_uuid(F.col("page_id")).alias("u"))
    for r in df.collect():
        assert arc.page_of(r.u) == r.page_id and len(r.u) == 36


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="has-sidebar">
<header>Site</header><nav><ul><li><a href=/x>Menu</a><li>More</ul></nav><div class="cookie-notice"><p>We use cookies, as all do.</p></div><!-- <p>no</p> -->
<article><h1 class="page-header">Head &amp; line</h1><p>One <b>bold</b>&nbsp;word,<span class="ad">Sale</span>
 two.<p>Next &lt;p&gt; &#228;<script>x()</script> end.<ul><li>a<li>b</ul><form><p>Name</p></form><aside>Side</aside>
<div class="ad">Buy</div><blockquote>Quote</blockquote><section id="comments"><p>Great post!</p></section></article>
<div class="sidebar">Side</div><footer>&copy; x</footer>"""


def test_article_text():
    assert html.main_text(PAGE) == "Head & line\nOne bold word, two.\nNext <p> ä end.\na\nb\nQuote"


def test_pages_without_an_article():
    body = "".join(f"<p>Sentence number {k}, which is long enough; it has commas, and stops. And so on.</p>" for k in range(6))
    page = f"<html><body><div id=menu><a>Home</a></div><div><span>x</span><span>y</span></div><div class=content>{body}</div><div><a>l1</a></div><div class=footer>end</div></body></html>"
    assert html.main_text(page).split("\n") == [f"Sentence number {k}, which is long enough; it has commas, and stops. And so on." for k in range(6)]


LONG = "".join(f"<p>Sentence number {k}, which is long enough; it has commas, and stops. And so on.</p>" for k in range(6))
SAID = "\n".join(f"Sentence number {k}, which is long enough; it has commas, and stops. And so on." for k in range(6))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><article><p>teaser</p></article><div class=main-col><h1>Title of it</h1>{LONG}</div></body>", "Title of it\n" + SAID),
        (f"<article>{LONG}<p class='social-history'>On social policy.</p><label>lab</label><math>x</math><header><h1>Title</h1></header></article>", SAID + "\nOn social policy.\nlabx\nTitle"),
        (f"<body><div class='layout-sidebar-right'><h2>Head</h2>{LONG}</div><div class=sidebar><p>Some side text, here.</p></div></body>", "Head\n" + SAID),
        (f"<body><div class='page header-fixed'>{LONG}</div><footer>f</footer></body>", SAID),
        (f"<body><main><article><h1>A</h1>{LONG}</article><section class='comments'>{LONG * 4}</section></main></body>", "A\n" + SAID),
        (f"<body><div id=post>{LONG}</div><div id=comments>{LONG * 3}</div></body>", SAID),
        (f"<body><h1>T</h1>{LONG}<ul><li>one<li>two</ul><p><a href=x>All links</a></p></body>", "T\n" + SAID + "\none\ntwo"),
        ("<article><p>" + "Long text, it is. " * 3_000 + "</p><ul>" + "<li>ab</li>" * 100 + "</ul></article>", ("Long text, it is. " * 3_000).strip() + "\nab" * 100),
        ("<nav>only menu</nav>", ""),
    ],
)
def test_ratios_decide(page, want):
    assert html.main_text(page) == want


class Plain(HTMLParser):
    """Blocks of a well-formed page as (path, text), by the standard library's reader."""

    HOLDERS = ("html", "body", "article", "div")

    def __init__(self, page):
        super().__init__()
        self.open, self.found, self.now = [], [], None
        self.feed(page)
        self.cut()

    def cut(self):
        if self.now and self.now[1].split():
            self.found.append((self.now[0], " ".join(self.now[1].split())))
        self.now = None

    def handle_starttag(self, tag, attrs):
        if tag not in ("b", "a", "span"):
            self.cut()
        if tag not in ("br", "meta", "link"):
            self.open.append((tag, dict(attrs).get("class")))

    def handle_endtag(self, tag):
        if tag not in ("b", "a", "span"):
            self.cut()
        self.open.pop()

    def handle_data(self, data):
        if not {t for t, _ in self.open} & {"nav", "footer", "head", "script", "style"}:
            self.now = (self.now[0] if self.now else tuple(self.open), (self.now[1] if self.now else "") + data) if self.now or data.split() else None


def plain_ratios(page):
    """The same decision written out for pages of articles, adverts and paragraphs; nothing is taken from the code."""
    found = Plain(page).found
    prior = lambda path: 0.05 if ("div", "ad") in path else 1.0
    holder = lambda path: next((path[:k] for k in range(len(path), 0, -1) if path[k - 1][0] in Plain.HOLDERS), ())
    raw, mass = {}, {}
    for path in {p for p, _ in found}:
        texts = [t for p, t in found if p == path]
        mean = lambda xs: sum(xs) / len(xs)
        raw[path] = (mean([min(len(t), 100) for t in texts]) * mean([min(1 + sum(c in ",.;:!?…،。，、؛؟" for c in t), 6) for t in texts])) ** 0.5 * prior(path)
        mass[path] = sum(map(len, texts)) * prior(path)
    total = sum(mass.values())
    held = {holder(p)[:k] for p in raw for k in range(len(holder(p)) + 1) if k == 0 or holder(p)[k - 1][0] in Plain.HOLDERS}
    level = {}
    for c in held:
        mine = [p for p in raw if holder(p) == c]
        level[c] = sum(raw[p] * mass[p] for p in mine) / sum(mass[p] for p in mine) if mine else 0.0
    up = lambda c: max((c[:k] for k in range(len(c)) if c[:k] in held), key=len)
    for c in sorted(held - {()}, key=len, reverse=True):
        level[up(c)] = max(level[up(c)], level[c] / 2)
    for c in sorted(held - {()}, key=len):
        level[c] = max(level[c], level[up(c)] / 2 * prior(c) / prior(up(c)))
    bar = 0.4 * sum(raw[p] * mass[p] for p in raw) / total if total else 0.0
    in_article = lambda p: any(t == "article" for t, _ in p)
    most = sum(m for p, m in mass.items() if in_article(p)) > total / 2
    score = {p: (raw[p] / 2 + level[holder(p)] / 2) * (1.0 if in_article(p) or not most else 0.5) * (1.5 if p[-1][0] == "h1" and not (most and in_article(p)) else 1.0) for p in raw}
    return "\n".join(t for p, t in found if score[p] >= bar - 1e-9)


def test_pages_against_plain_ratios():
    pages = [x or "" for folder in ("sf0.001", "sf0.01") for x in pq.read_table(f"/root/testdata/{folder}/pages.parquet", columns=["html"])["html"].to_pylist()]
    article = ["\n".join(t for p, t in Plain(x).found if ("article", None) in [(a, None) for a, _ in p] and ("div", "ad") not in p) for x in pages]
    assert [html.main_text(x) for x in pages] == [plain_ratios(x) for x in pages] == article
    assert [html.main_text(x.replace("<article", "<div").replace("article>", "div>")) for x in pages] == article  # nor does the element's name decide


def test_without_ratios_nothing_is_content(monkeypatch):
    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet", columns=["html"])["html"].to_pylist()
    assert all(html.main_text(x) for x in pages)
    real = html.ratios
    monkeypatch.setattr(html, "ratios", lambda found: {p: (place, 0.0, m) for p, (place, _, m) in real(found).items()})
    assert not any(html.main_text(x) for x in pages)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><form><div><h1>News</h1>{LONG}</div></form></body>", "News\n" + SAID),
        (f"<body><article>{LONG}<ul><li><a>one</a><li><a>two</a></ul></article></body>", SAID + "\none\ntwo"),
        (f"<html><body><article>{LONG}<ul><li><a>one</a><li><a>two</a></ul></article></body></html>", SAID + "\none\ntwo"),
        (f"<body><div class=notice>{LONG}</div><div><p>A short one, but it is real.</p></div></body>", "A short one, but it is real."),
        (f"<body><article>{LONG}<div class=c><p>Great post!</p></div><div><p>A fair sentence, which is in the text.</p></div></article></body>", SAID + "\nA fair sentence, which is in the text."),
        ("<article><div><p>" + "Long text, it is. " * 3_000 + f"</p></div><div>{LONG}</div></article>", ("Long text, it is. " * 3_000).strip() + "\n" + SAID),
        ("<body><p><a>only</a></p><p><a>links</a></p></body>", ""),
    ],
)
def test_ratios_in_and_beside_the_article(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize("page", ["", None, "   ", "<", "<p", "<p>", "</p></div>", "<script>never closed", "<!-- never closed", "<a href='x>y", "<nav>only menu</nav>", "<p " * 5_000, "<div>" * 3_000])
def test_broken_pages(page):
    assert isinstance(html.main_text(page), str)


def test_extract_keeps_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (3, "v", ""), (4, "w", "<article>" + "<p>long line</p>" * 20_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = html.extract(df).collect()
    assert len(got) == 5 and {r.page_id: r.n_chars for r in got}[4] == 20_000 * 10 - 1
    assert all(r.n_chars == len(r.text) for r in got)
    assert html.extract(df.limit(0)).count() == 0
