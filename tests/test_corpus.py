import pytest
import random
import re

from pyspark.sql import functions as F

from millrace.operators import corpus


def pages_frame(spark, pages):
    return spark.createDataFrame(pages, "page_id bigint, url string, html string")


def test_page_text(spark):
    html = (
        '<html><head><title>A &amp; B</title><style>p{x:1}</style><SCRIPT type="x">var t="</p>";</SCRIPT></head>'
        "<body><!-- no <b>this</b> --><p>One\n\n two&nbsp;&lt;3&gt; &amp;lt; café</p></body></html>"
    )
    got = corpus.pages_text(pages_frame(spark, [(1, "https://a.example/x/y?z=1", html)])).first()
    assert got.host == "a.example" and got.title == "A & B"
    assert got.text == "A & B One two <3> &lt; café"


def brute(pages, requests, top=2):
    words = {}
    for page_id, url, html in pages:
        words[page_id] = (url.split("/")[2], re.findall(r"\w+", re.sub("<[^>]*>", " ", html).lower()))
    out = []
    for request_id, domain, phrases in requests:
        best = {}
        for place, phrase in enumerate(phrases):
            p = re.findall(r"\w+", phrase.lower())
            for page_id, (host, w) in words.items():
                at = [i + 1 for i in range(len(w) - len(p) + 1) if p and host == domain and w[i : i + len(p)] == p]
                if at and page_id not in best:
                    best[page_id] = (place, -len(at), at[0])
        ranked = sorted((m[0], m[1], page_id, m[2]) for page_id, m in best.items())
        out += [(request_id, n, page_id, -fewer, at) for n, (_, fewer, page_id, at) in enumerate(ranked[:top], 1)]
    return sorted(out)


def test_search_equals_brute_force(spark):
    picks = random.Random(5)
    vocab = "red blue old new the a vacuum stand kit pro".split()
    text = lambda n: " ".join(picks.choice(vocab) for _ in range(n))
    # a third of all pages and requests sit on one site
    hosts = ["hot.example"] * 4 + [f"h{i}.example" for i in range(8)]
    pages = [(i, f"https://{picks.choice(hosts)}/p/{i}", f"<p>{text(picks.randrange(0, 40))}</p>") for i in range(120)]
    requests = [
        (i, picks.choice(hosts), [text(picks.randrange(0, 8)) for _ in range(picks.randrange(1, 4))]) for i in range(150)
    ]
    req = spark.createDataFrame(requests, "request_id bigint, domain string, phrases array<string>")
    got = corpus.site_search(req, pages_frame(spark, pages)).select("request_id", "rank", "page_id", "hits", "at")
    assert sorted(tuple(r) for r in got.collect()) == brute(pages, requests)


def test_snippet_and_context(spark):
    body = " ".join(f"w{i}" for i in range(30))
    pages = pages_frame(spark, [(1, "https://a.example/1", f"<p>{body}</p>"), (2, "https://a.example/2", "<p>w9 w10</p>")])
    req = spark.createDataFrame([(7, "a.example", ["W10"])], "request_id bigint, domain string, phrases array<string>")
    found = corpus.site_search(req, pages)
    got = {r.page_id: r for r in corpus.with_snippets(found, pages).collect()}
    assert got[1].snippet == " ".join(f"w{i}" for i in range(5, 25)) and got[1].rank == 1
    assert got[2].snippet == "w9 w10" and got[2].url == "https://a.example/2"
    assert corpus.context(found, pages).first().context == body + "\n\nw9 w10"


def test_search_without_usable_phrases(spark):
    pages = pages_frame(spark, [(1, "https://a.example/1", "<p>x</p>")])
    req = spark.createDataFrame([(1, "a.example", ["!!", ""])], "request_id bigint, domain string, phrases array<string>")
    assert corpus.site_search(req, pages).count() == 0
    assert corpus.title_requests(pages).select(F.size("phrases")).first()[0] == 2


def test_products_are_searched_by_name_then_code(spark):
    from millrace.operators import prices

    base = spark.createDataFrame(
        [("S1", "V15 Detect", "885609", "a.example"), ("S2", "Buds", None, "a.example")],
        "sku_id string, product_name string, upc string, website_domain string",
    )
    pages = pages_frame(spark, [(1, "https://a.example/1", "code 885609"), (2, "https://a.example/2", "The v15-detect!"),
                                (3, "https://b.example/3", "V15 Detect Buds")])
    found = corpus.site_search(prices.search_requests(base), pages)
    got = [(r.request_id, r["rank"], r.page_id) for r in found.collect()]
    assert sorted(got) == [("S1 a.example", 1, 2), ("S1 a.example", 2, 1)]


@pytest.mark.parametrize("limit", [corpus.BROADCAST_PHRASES, 0])
def test_phrase_hits_equal_brute_force(spark, limit):
    rng = random.Random(4)
    pages = [(i, f"https://s{i % 3}.example/{i}", "<p>" + " ".join(rng.choices("abc", k=rng.randint(0, 40))) + "</p>") for i in range(60)]
    pages += [(100, None, "<p>a b</p>"), (101, "https://s0.example/x", None), (102, "https://other.example/", "a b c")]
    phrases = [(f"s{i}.example", p) for i in range(3) for p in ("a", "a a", "a b a", "b c", "c c c c", "a b c a b c", "z")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = corpus._phrase_hits(df, spark.createDataFrame(phrases, "domain string, phrase string"), limit, 7).collect()
    want = []
    for page, url, html in pages:
        w = re.findall("[a-z]+", (html or "").replace("<p>", "").replace("</p>", ""))
        for domain, phrase in phrases:
            p = phrase.split()
            at = [k + 1 for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            if at and url and url.split("/")[2] == domain:
                want.append((domain, phrase, page, len(at), at[0]))
    assert sorted(map(tuple, got)) == sorted(want)
