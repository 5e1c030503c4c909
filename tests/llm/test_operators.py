"""Every operator against plain Python on hard rows: NULLs, empty, very long and repeated texts, clashing names."""

import collections
import hashlib
import html as html_lib
import re
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from millrace.llm import (
    decontaminate,
    html_extract,
    line_dedup,
    near_dedup,
    piece_codec,
    quality_model,
    repetition,
    secret_scan,
    sharding,
    substring_dedup,
)
from millrace.llm.queries import piece_model

SCHEMA = "doc_id long, text string, n long, __a string, kept_text string, score double"
PASSAGE = " ".join(f"shared{i}" for i in range(40))
BASE = [f"w{i}" for i in range(100)]
TEXTS = [
    (0, " ".join(BASE)),
    (1, " ".join(BASE[:60] + ["changed"] + BASE[61:])),
    (2, " ".join(BASE).upper()),
    (3, None),
    (4, ""),
    (5, " \t\n\x0b\x0c\r "),
    (6, "one two"),
    (7, "One  two"),
    (8, "own words first " + PASSAGE + " and own words last"),
    (9, PASSAGE + " again " + PASSAGE),
    (10, "línea única ñandú\nCommon Line\nlast line"),
    (10, "línea única ñandú\nCommon Line\nlast line"),
    (None, "a row without an id " * 3),
    (None, None),
    (11, "long " * 30_000 + "end"),
    (12, " ".join(f"x{i}" for i in range(20_000))),
    (13, "Token = 'abcdefgh' api_key:short AKIA" + "Q7" * 9 + " " + "0af9" * 9 + " é password=ñ"),
]
ROWS = [(d, t, 7, "other", "clash", 0.5) for d, t in TEXTS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    rows = [tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()]
    return sorted(rows, key=str)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text, k):
    w = words(lower(text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(rows, k):
    """Least reachable id of every row, from all pairs."""
    known = [(d, shingles(t, k)) for d, t in rows if d is not None]
    group = {d: d for d, _ in known}
    changed = True
    while changed:
        changed = False
        for a, s in known:
            for b, t in known:
                if s and t and 100 * len(s & t) >= 80 * len(s | t) and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    return group


@pytest.mark.parametrize("limit", [near_dedup.BROADCAST_IDS, 0])
def test_near_dedup(docs, limit):
    got = by_id(near_dedup.near_duplicates(docs, shingle=4, broadcast_ids=limit), "n_shingles", "component_id", "kept")
    group = components(TEXTS, 4)
    expected = [(d, len(shingles(t, 4)), group.get(d), d is None or group[d] == d) for d, t in TEXTS]
    assert got == sorted(expected, key=str)


def test_near_dedup_in_a_crowd(spark):
    """Copies with own changes, most alike only to their source, beside a passage that many others share."""
    import random

    random.seed(5)
    rows = [(0, " ".join(f"b{i}" for i in range(140)))]
    for d in range(1, 250):
        w = rows[0][1].split()
        for _ in range(random.choice((1, 2, 3, 4))):
            w[random.randrange(len(w))] = f"c{d}_{random.random()}"
        rows.append((d, " ".join(w)))
    rows += [(1000 + d, PASSAGE + " " + " ".join(f"o{d}_{i}" for i in range(60))) for d in range(100)]
    got = by_id(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4), "component_id")
    assert got == sorted(components(rows, 4).items(), key=str)


def test_near_dedup_beyond_the_reach(spark):
    """Isolated pairs just above 0.8 among thousands of texts of one template that are just below it."""
    template = " ".join(f"t{i}" for i in range(88))
    rows = [(d, f"{template} " + " ".join(f"o{d}_{i}" for i in range(12))) for d in range(3000)]
    for d in range(0, 40, 2):  # one own word in common: 89 of 111
        rows[d + 1500] = (d + 1500, f"{template} o{d}_0 " + " ".join(f"p{d}_{i}" for i in range(11)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, shingle=1, percent=80, reach=8).collect()}
    assert got == {d: d - 1500 if 1500 <= d < 1540 and d % 2 == 0 else d for d in range(3000)}


@pytest.mark.parametrize("tasks", [200, 2000])
def test_near_dedup_of_few_texts_in_many_tasks(spark, tasks):
    rows = [(0, " ".join(BASE)), (1, " ".join(BASE[:-1])), (2, "quite another text of nine words in a row"), (3, None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        got = by_id(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), "component_id")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == [(0, 0), (1, 0), (2, 2), (3, 3)]


def test_near_dedup_across_tasks(spark, monkeypatch):
    """One row a task: all pairs stand across a border."""
    made = near_dedup._orders
    order = ["tree", "key", "id"]
    monkeypatch.setattr(near_dedup, "_orders", lambda *a: made(*a).repartitionByRange(192, *order).sortWithinPartitions(*order))
    rows = [(d, " ".join(BASE[:-1] + [f"own{d}"])) for d in range(6)]
    got = by_id(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), "component_id")
    assert got == [(d, 0) for d in range(6)]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901)], "a long, b long")
    got = {r.id: r.group for r in near_dedup.connected(links).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 900: 900, 901: 900}


def removed(rows, size):
    seen = collections.Counter(tuple(w[i : i + size]) for _, t in rows for w in [words(t)] for i in range(len(w) - size + 1))
    for d, t in rows:
        w = words(t)
        gone = {j for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        yield d, len(w), len(gone), sha(kept), kept


@pytest.mark.parametrize("size,per_bucket", [(35, 6_000_000), (2, 500)])
def test_substring_dedup(docs, size, per_bucket):
    found = substring_dedup.remove_repeated(docs, window=size, windows_per_bucket=per_bucket)
    expected = sorted(removed(TEXTS, size), key=str)
    assert by_id(found, "n_words", "n_removed", "kept_sha256", "kept_text") == expected
    for row in found.collect():
        assert sum(row.spans[1::2]) - sum(row.spans[::2]) == row.n_removed
        assert all(a < b for a, b in zip(row.spans, row.spans[1:]))  # maximal: no two intervals touch


def test_substring_dedup_sends_a_hot_window_once_a_lot(monkeypatch):
    """A window that is a third of all: one value from each lot of texts reaches its bucket, and every place is flagged."""
    monkeypatch.setattr(substring_dedup, "WORDS_AT_ONCE", 500)
    texts = ["hot " * 39, "own words " + " ".join(f"a{i}" for i in range(60)) + " hot" * 50] * 20
    texts += [" ".join(f"t{k}x{i}" for i in range(50)) for k in range(40)] + [" ".join(BASE), "x " + " ".join(BASE), "hot"]
    texts = [f"{t} last{i}" for i, t in enumerate(texts)]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array([t.encode() for t in texts])], ["a", "b", "t"])
    hashes = substring_dedup.WindowHashes(5, 7)
    made = list(substring_dedup._window_rows(5, 7)(iter([batch])))
    assert len(made) > 5
    value, place = (x[0] for x in hashes.of(hashes.words.of([b"hot"] * 5)))
    hot = [b for m in made for r in m.to_pylist() for b in np.frombuffer(r["hashes"], np.uint64) if r["bucket"] == place and b == value]
    assert len(hot) <= len(made)
    masks = collections.defaultdict(list)
    for target in range(7):
        mine = [m.filter(pc.equal(m["target"], target)) for m in made]
        for out in substring_dedup._repeated(iter(mine)):
            for r in out.to_pylist():
                masks[r["a"]].append((r["bucket"], r["mask"]))
    want = {i: n for i, _, n, _, _ in removed(list(enumerate(texts)), 5)}
    got = {i: int(substring_dedup._flagged(hashes, t.encode().split(), masks[i], 5).sum()) for i, t in enumerate(texts)}
    assert got == want


def test_decontaminate(spark, docs):
    items = [(1, " ".join(BASE[10:30])), (2, "One two"), (3, None), (4, "!?"), (5, PASSAGE.upper()), (5, "one, TWO"), (None, "x5 x6 x7")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        for j in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[j : j + 13])].add("" if i is None else str(i))
    expected = []
    for d, t in TEXTS:
        w, hit, found = cut(t), set(), set()
        for size in {len(k) for k in windows}:
            for j in range(len(w) - size + 1):
                if tuple(w[j : j + size]) in windows:
                    found |= windows[tuple(w[j : j + size])]
                    hit |= set(range(j, j + size))
        expected.append((d, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    expected.sort(key=str)
    for size in (decontaminate.TABLE_BYTES, 100):  # one table, and several searched in turn
        got = decontaminate.scan(docs, bench, table_bytes=size)
        assert by_id(got, "n_words", "n_hit", "items", "contaminated") == expected
    assert not decontaminate.scan(docs, bench.limit(0)).where("contaminated or n_hit > 0").count()


@pytest.mark.parametrize("limit", [line_dedup.BROADCAST_ROWS, 0])
def test_line_dedup(spark, limit):
    rows = [(d, t) for d, t in TEXTS if d != 11]
    rows += [(100 + i, f"own {i}\n \tCOMMON line\r\nother {i // 10}\n\n") for i in range(12)] + [(100, "other 1")]
    df = spark.createDataFrame([(*r, 1, "x", "y", 0.0) for r in rows], SCHEMA)
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(d)
    expected = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or len(holders[key(x)]) < 10]
        expected.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = line_dedup.drop_common_lines(df, broadcast_rows=limit)
    assert by_id(got, "n_lines", "n_dropped", got.columns[-1]) == sorted(expected, key=str)


def test_piece_codec(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    expected = []
    for d, t in TEXTS:
        ids = model.encode(t or "")
        expected.append((d, len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))))
    got = by_id(piece_codec.digests(docs, piece_model()), "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == sorted(expected, key=str)
    full = by_id(piece_codec.encoded(docs, piece_model()), "ids", "decoded")
    assert full == sorted([(d, model.encode(t or ""), model.decode(model.encode(t or ""))) for d, t in TEXTS], key=str)


def test_piece_codec_on_odd_texts():
    import random

    import sentencepiece

    model, codec = sentencepiece.SentencePieceProcessor(model_file=piece_model()), piece_codec.Codec(piece_model())
    random.seed(3)
    letters = "ab the ing▁ \n\t  éßñ日本😀́<0x41>/s.,;=\x00\x01\xa0xyz0123456789ERTION"
    pieces = [model.id_to_piece(random.randrange(300, 32000)).replace("▁", " ") for _ in range(3000)]
    texts = ["".join(random.choice(letters) for _ in range(random.choice((1, 3, 8, 40)))) for _ in range(3000)]
    texts += ["".join(random.sample(pieces, 4)) for _ in range(3000)] + ["日本語の文章" * 3000, "abcdefghij" * 3000]
    for text in texts:
        ids = model.encode(text)
        assert codec.encode(text) == ids and codec.decode(ids) == model.decode(ids)
    assert codec.decode([5, 300, 131, 1, 0, 400]) == codec.raw([5, 300, 131, 1, 0, 400]).decode("utf-8", "replace")


def test_sharding(spark, docs):
    got = sharding.shard(docs.union(docs), n_shards=4, rows_per_range=5).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(d), size(t)) for d, t in TEXTS * 2)
    rows = [(d, f"text {d % 40} " * (1 + d % 7)) for d in range(900)] + [(d, "same text") for d in range(900, 1400)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), rows_per_range=50).collect()
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) < 2 * max(size(t) for _, t in rows)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def markov_model(spark):
    return secret_scan.trained(secret_scan.samples(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))


def test_secret_scan(spark, docs):
    assign = re.compile(secret_scan.ASSIGN, re.A)
    expected = []
    for d, t in TEXTS:
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t or "") if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 32]
        expected.append((d, [s for s in sorted(spans)]))
    found = secret_scan.scan(docs, markov_model(spark))
    got = [(r.doc_id, [(s.start, s.rank, s.end) for s in r.base]) for r in found.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_secret_scan_tells_random_strings_from_names(spark):
    random_text = "see k9Xq2LmZ7vR4tYpW8sJdB3nHf6 here"
    ordinary = "call request_handler_value_returns/config_number here"
    df = spark.createDataFrame([(1, random_text), (2, ordinary), (3, "token: token: abcdefgh")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secret_scan.digests(secret_scan.scan(df, markov_model(spark))).collect()}
    assert got == {1: "markov:4:30", 2: "", 3: ""}


def measures(text):
    w = words(text)
    runs = collections.Counter(zip(w, w[1:], w[2:]))
    again = {j for i, run in enumerate(zip(w, w[1:], w[2:])) if runs[run] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again), failed


def verdict(text):
    """Whether the shares of word characters in repeated runs and lines stay within the limits."""
    w, limits = words(text), repetition.Limits()
    chars = sum(map(len, w))
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen, again = set(), []
    for x in lines:
        again += [x] if x in seen else []
        seen.add(x)
    if len(again) > limits.lines * len(lines) or sum(len("".join(words(x))) for x in again) > limits.line_chars * chars:
        return False
    for n, most in {**limits.top, **limits.repeated}.items():
        at = collections.defaultdict(list)
        for i in range(len(w) - n + 1):
            at[tuple(w[i : i + n])].append(i)
        many = [p for p in at.values() if len(p) > 1]
        if n in limits.top and many:
            share = {sum(len(w[j]) for j in {j for i in p for j in range(i, i + n)}) for p in many if len(p) == max(map(len, many))}
            if len(share) == 1 and share.pop() > most * chars:
                return False
        elif n in limits.repeated:
            covered = {j for p in many for i in p for j in range(i, i + n)}
            if sum(len(w[j]) for j in covered) > most * chars:
                return False
    return True


def test_repetition(spark, docs):
    extra = [(50 + i, " ".join(BASE[: 60 + i]) + "\n" + "\n".join(["again and again"] * i)) for i in range(6)]
    extra += [(70, " ".join(f"u{i}" for i in range(90)) + " " + " ".join(f"u{i}" for i in range(12)) + " $# %%")]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = by_id(repetition.rate(df), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    expected = []
    for d, t in [*TEXTS, *extra]:
        m = measures(t)
        expected.append((d, *m, not m[-1] and verdict(t)))
    assert got == sorted(expected, key=str)


def page(body, head="<title>t &amp; u</title><script>var t='</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def test_html_extract(spark):
    chrome = "<div class='top'><span>Site</span> of all</div><ul><li>One<li>Two</ul>"
    rows = [(i, "http://h.example/a", page(f"{chrome}<div><p>Own text {i} &lt;b&gt;<br>goes\n on<p>Stock line</div>")) for i in range(6)]
    rows += [(10, "http://x.example/", page(f"{chrome}<p>Elsewhere")), (11, None, None), (12, "u", ""), (13, "u", "plain <b>te</b>xt")]
    article = "<header>H</header><article><h1>T&eacute;</h1><p>Same <i>text</i><div class='comments'><p>no</p></div></article>"
    rows += [(20 + i, "http://h.example/copy", page(article)) for i in range(8)]
    rows += [(30, "http://h.example/", "<article><p>cut off &amp; open <!-- never closed"), (31, None, page("<form><p>x</form>"))]
    rows += [(40, "http://l.example/", page("<article>" + "<p>para</p>" * 5000 + "</article>"))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, __hashes string")
    stock = [f"Own text {i} <b> goes on\nStock line" for i in range(6)]
    expected = {**dict(enumerate(stock)), 10: "Site of all\nOne\nTwo\nElsewhere", 11: "", 12: "", 13: "plain text"}
    expected |= {**{20 + i: "Té\nSame text" for i in range(8)}, 30: "cut off & open", 31: "", 40: "\n".join(["para"] * 5000)}
    expected |= {i: f"Own text {i} <b> goes on" for i in range(6)}  # the stock line recurs outside an article
    for limit in (html_extract.BROADCAST_HASHES, 0):
        got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(df, broadcast_hashes=limit).collect()}
        assert got == {k: (v, len(v)) for k, v in expected.items()}


@pytest.mark.parametrize("marks", [
    'style="overflow:hidden"', 'data-role="search"', "data-id='ad'", "title='class=ad id=ad hidden'", "data-class=menu",
    'href="/hidden-valley/"', "href=/read?id=ad", "aria-hidden=false", "data-hidden",
])
def test_html_attributes_by_exact_name(marks):
    for body in (f"<article {marks}><p>Text</p></article>", f"<div {marks}><p>Text</p></div>", f"<p><a {marks}>Text</a></p>"):
        assert html_extract.Page(page(body), "h").text(set()) == "Text"
    for gone in ("hidden", "class=ad", "id='ad'", 'role="search"', 'aria-hidden="true"'):
        assert html_extract.Page(page(f"<p>Text</p><div {marks} {gone}><p>Gone</p></div>"), "h").text(set()) == "Text"


def test_html_names_do_not_remove_the_article():
    read = lambda body: html_extract.Page(page(body), "h").text(set())
    inner = "<p>First part</p><p>Second part</p>"
    for tag in ("div class='page has-sidebar'", "div class=header-fixed", "div class=widget", "div role=search", "form"):
        end = tag.split()[0]
        assert read(f"<{tag}><article>{inner}</article></{end}>") == "First part\nSecond part"
        assert read(f"<{tag}>{inner}</{end}><p>x</p>") == "First part\nSecond part\nx"
    assert read("<article><section class='related-work'><p>a</p></section><p class='share-price'>b</p></article>") == "a\nb"
    for gone in ("div class='box sidebar'", "div id=site_header", "ul class='related-posts'", "form", "div role=banner"):
        assert read(f"<article>{inner}</article><{gone}><p>Gone</p></{gone.split()[0]}>{inner}") == "First part\nSecond part"
        assert read(f"{inner}<{gone}><p>Gone</p></{gone.split()[0]}>") == "First part\nSecond part"


@pytest.mark.parametrize(
    "html",
    [
        "<a " * 350_000, "<div>" * 100_000, "<div>" * 50_000 + "</p>" * 100_000, '<a ">"' * 170_000, "<script>" * 100_000,
        "<p><div>" + "<b>" * 50_000 + "<hr>" * 100_000, "<li><div>" + "<span>" * 50_000 + "<li></li>" * 50_000, "<!--" * 250_000,
    ],
    ids=["open tags", "nested", "stray ends", "quotes", "scripts", "void blocks", "items", "comments"],
)
def test_html_extract_takes_time_in_proportion_to_the_page(html):
    started = time.perf_counter()
    html_extract.Page(html, "h").text(set())
    assert time.perf_counter() - started < 5


def test_html_extract_reads_numbers_of_any_length():
    body = "&#" + "9" * 10_000 + "; &#" + "0" * 10_000 + "65; &#x42;"
    assert html_extract.Page(f"<p>{body}</p>", "h").text(set()) == "\ufffd A B"


def test_html_extract_on_the_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", re.sub(r"</?b>", "", inner)))
        blocks = (" ".join(html_lib.unescape(b).split()) for b in blocks)
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_quality_model_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model.learned(docs, labels)
    assert 0 < len(model.rules) < 200
    scored = quality_model.scored(docs, model).join(labels, "doc_id").where(quality_model.held_out(F.col("doc_id")))
    right = scored.agg(F.avg(((F.col("score") >= 0.7) == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert right >= 0.95


def test_quality_model_edges(spark, docs, none):
    labels = spark.createDataFrame([(d, 1) for d in range(8)], "doc_id long, quality int")
    one_class = quality_model.learned(docs, labels)
    assert one_class.rules == ()
    got = quality_model.scored(docs, one_class, ("doc_id", "text", "score")).collect()
    assert len(got) == len(ROWS) and all(0.5 < r[-1] < 1 for r in got)
    assert quality_model.learned(none, labels.limit(0)).intercept == 0.0
    trees = ["T\n  If (feature 0 <= 1.5)\n   If (feature 2 <= 3.0)\n    Predict: 0.0\n   Else (feature 2 > 3.0)\n    Predict: 1.0\n  Else (feature 0 > 1.5)\n   Predict: 1.0"]
    s0, s2 = quality_model.STATISTICS[0], quality_model.STATISTICS[2]
    assert {r.conditions for r in quality_model.rules_of(trees)} == {
        ((s0, True, 1.5),), tuple(sorted([(s0, True, 1.5), (s2, True, 3.0)])),
        tuple(sorted([(s0, True, 1.5), (s2, False, 3.0)])), ((s0, False, 1.5),),
    }


def test_empty_tables(spark, none):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    model = secret_scan.trained(secret_scan.samples(none))
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    made = [
        near_dedup.near_duplicates(none), substring_dedup.remove_repeated(none), html_extract.extract(pages),
        piece_codec.digests(none, piece_model()), sharding.shard(none), secret_scan.scan(none, model),
        decontaminate.scan(none, bench), line_dedup.drop_common_lines(none), repetition.rate(none),
    ]
    assert [df.count() for df in made] == [0] * len(made)


def test_sets_of_one_id_are_one_component(spark):
    w, x, y = ("w " * 9, " ".join(f"x{i}" for i in range(30)), " ".join(f"y{i}" for i in range(30)))
    docs = spark.createDataFrame([(3, w), (7, w), (7, x), (9, y), (8, x), (None, y)], "doc_id long, text string")
    got = by_id(near_dedup.near_duplicates(docs), "component_id", "kept")
    assert got == sorted([(3, 3, True), (7, 3, False), (7, 3, False), (9, 9, True), (8, 3, False), (None, None, True)], key=str)


def test_line_dedup_of_many_common_lines_is_linear(spark):
    text = "\n".join(f"line {i}" for i in range(100_000))
    docs = spark.createDataFrame([(i, text + f"\nown {i}") for i in range(10)], "doc_id long, text string").repartition(5)
    start = time.monotonic()
    got = line_dedup.drop_common_lines(docs).select("doc_id", "n_dropped", "kept_text").collect()
    assert sorted(map(tuple, got)) == [(i, 100_000, f"own {i}") for i in range(10)]
    assert time.monotonic() - start < 60


@pytest.mark.parametrize("table_bytes", [10**9, 1_500])
def test_decontamination_over_twenty_blocks(spark, monkeypatch, table_bytes):
    words_ = [f"q{i}" for i in range(4_000)]
    bench = [(f"b{i}", " ".join(words_[i * 20 : i * 20 + 20])) for i in range(200)]
    texts = [(i, " ".join(words_[i * 13 : i * 13 + 40])) for i in range(100)] * 2 + [(500, None), (501, "")]
    docs = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in texts], "doc_id long, text string, n_hit int, spans int, contaminated string")
    alive, most = set(), []
    made = decontaminate._shared_block

    def counted(rows, k):
        block = made(rows, k)
        alive.add(k)
        most.append(len(alive))
        destroy = block.destroy
        block.destroy = lambda: (alive.discard(k), destroy())
        return block

    monkeypatch.setattr(decontaminate, "_shared_block", counted)
    found = decontaminate.scan(docs, spark.createDataFrame(bench, "item_id string, text string"), tuple(docs.columns), table_bytes=table_bytes)
    assert found.columns[5:] == ["n_words", "spans_", "items", "n_hit_", "n_items", "contaminated_"]
    assert max(most) == 1 and (len(most) == 1 or len(most) >= 20)
    want = []
    for d, t in texts:
        w = words(lower(t))
        hit, items = set(), set()
        for name, b in bench:
            b = b.split()
            for j in range(len(b) - 12):
                for at in range(len(w) - 12):
                    if w[at] == b[j] and w[at : at + 13] == b[j : j + 13]:
                        hit |= set(range(at, at + 13))
                        items.add(name)
        want.append((d, len(w), len(hit), sorted(items)))
    assert sorted(((r.doc_id, r.n_words, r.n_hit_, list(r["items"])) for r in found.collect()), key=str) == sorted(want, key=str)
