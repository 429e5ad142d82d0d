"""Each operator against a brute-force version, and on nulls, empty and repeated rows, empty tables and further columns."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from actionline.llm import lattice, minhash, mixing, ogg, packing, secrets, tokens, toxicity, warc, wrappers
from actionline.llm.common import ChunkEncoder, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id long, score double, h string, kind int"


def docs(spark, texts, **more):
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, None if t is None else len(t), 1, 2.0, "x", 3) for i, t in enumerate(texts)]
    rows += more.get("extra", [])
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " ", "\n\n", "a", "wörter und worte", "x" * 5000, "tab\tand\r\nline\x0b\x0c end", "two  blanks   three\n\n\nlines \n x", "\x1c\x1d a", "😀 é ̈", "<|endoftext|> x", "it's 'tis", "one two three four", "same text", "same text"]


@lru_cache
def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def ids_of(text, name, end):
    return tokenizer(name).encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize(("name", "space"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_chunks_give_the_ids_of_whole_texts(name, space):
    draw, encode = random.Random(4), ChunkEncoder(tokenizer_path(name), space)
    assert encode.chunked
    alphabet = [*" \n\t'abcsS1½²é́中​\xa0 \x1c\r<|>._%!$Éİſ", "<|endoftext|>"]
    for text in ODD + ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 40))) for _ in range(1500)]:
        assert np.frombuffer(encode(text), "<u4").tolist() == ids_of(text, name, 0)[:-1], repr(text)


def test_other_tokenizers_encode_whole_texts(tmp_path):
    from tokenizers import Tokenizer, pre_tokenizers

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)  # merges across blanks
    t.save(str(tmp_path / "t.json"))
    encode = ChunkEncoder(str(tmp_path / "t.json"), True)
    assert not encode.chunked
    for text in ODD:
        assert np.frombuffer(encode(text), "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids


def test_tokens_round_trip(spark):
    d = docs(spark, ODD)
    folder = tokens.write_tokens(d)
    got = {r["doc_id"]: r for r in tokens.read_tokens(spark, folder).collect()}
    start = 0
    for i, text in enumerate(ODD):
        ids = ids_of(text, "word_bpe_49k.json", 2)
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)
    assert tokens.read_document(spark, folder, 5) == [ids_of(ODD[5], "word_bpe_49k.json", 2)]


def test_tokens_of_an_empty_table_and_of_null_ids(spark):
    assert tokens.read_tokens(spark, tokens.write_tokens(docs(spark, []))).count() == 0
    twice = docs(spark, ["a b"], extra=[(None, "c", None, None, 1, 1, 1.0, "", 1), (0, "a b", None, None, 1, 1, 1.0, "", 1)])
    rows = tokens.read_tokens(spark, tokens.write_tokens(twice)).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 0, 0] and rows[1]["ids_crc32"] == rows[2]["ids_crc32"]


def test_packing_covers_every_id_once(spark):
    texts = ODD + [" ".join(f"w{i * j}" for j in range(i)) for i in range(1, 900, 30)]
    rows = packing.packed(docs(spark, texts)).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, text in enumerate(texts):
        ids, at = ids_of(text, "byte_bpe_50k.json", 0), 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert packing.packed(docs(spark, [])).count() == 0


def plain_differencing(sizes, k):
    """The sums that Karmarkar-Karp gives, on whole vectors from the start."""
    heap = [[0] * (k - 1) + [n] for n in sizes]
    while len(heap) > 1:
        heap.sort(key=lambda v: v[0] - v[-1])
        a, b, *heap = heap
        heap.append(sorted(x + y for x, y in zip(a, reversed(b), strict=True)))
    return heap[0]


def test_differencing_against_whole_vectors():
    for seed in range(200):
        draw = random.Random(seed)
        most = draw.choice([1, 3, 50, 10**6])
        sizes, k = [draw.randint(1, most) for _ in range(draw.randint(1, 40))], draw.randint(1, 12)
        parts = packing.differencing(sizes, k)
        assert sorted(itertools.chain(*parts)) == list(range(len(sizes))) and len(parts) == k
        if most == 10**6:  # without ties there is one order of merging
            assert sorted(sum(sizes[i] for i in p) for p in parts) == plain_differencing(sizes, k)


def test_packing_of_tiny_documents_is_fast_and_tight(spark):
    began = time.perf_counter()
    parts = packing.pack([1] * 65_408)
    assert time.perf_counter() - began < 1 and len(parts) == 64 and sum(map(len, parts)) == 65_408
    rows = packing.packed(docs(spark, [None] * 3000 + ["one two three " * (i % 90) for i in range(300)]).coalesce(1)).collect()
    total, windows = sum(r["length"] for r in rows), len({r["sequence_id"] for r in rows})
    assert windows <= -(-total // 1024) + 1
    odd = docs(spark, ["a b c"] * 2, extra=[(None, "a b c", None, None, 1, 1, 1.0, "", 1), (0, "other", None, None, 1, 1, 1.0, "", 1)])
    got = sorted(((r["doc_id"], r["length"]) for r in packing.packed(odd).collect()), key=repr)
    assert got == [(0, 2), (0, 4), (1, 4), (None, 4)]


def test_differencing_is_near_equal_and_rises_when_full():
    sizes = [random.Random(i).randint(1, 256) for i in range(400)]
    parts = packing.differencing(sizes, 50)
    assert sorted(itertools.chain(*parts)) == list(range(400))
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert max(sums) - min(sums) <= 8
    assert len(packing.pack([700, 700, 700], 1024)) == 3  # two windows would be too full
    assert packing.differencing([], 3) == [] and packing.pack([]) == []


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(x):
    x = x or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(x) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", x) if m.end() - m.start() >= 24]
    return [(a, b, k) for a, _, k, b in sorted(out)]


def test_secrets_against_plain_scans(spark):
    draw = random.Random(7)
    bits = ["password", "Token", "SECRET", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abcdef", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "é", "中", "ſ", "K", "_", "-", ".", "\n", "f" * 24]
    texts = ODD + ["".join(draw.choice(bits) for _ in range(draw.randint(1, 25))) for _ in range(3000)]
    for t in texts:
        assert [s for s in secrets.find_secrets(t) if s[2] in secrets.BASE] == base_spans(t), repr(t)
    d = docs(spark, texts[:200])
    for r in secrets.scan(d).collect():
        plain = ",".join(f"{k}:{a}:{b}" for a, b, k in base_spans(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(plain.encode()).hexdigest()
    assert secrets.scan(docs(spark, [])).count() == 0


def test_secrets_with_checksums_and_redaction(spark):
    body = "0123456789abcdefghijABCDEFGHIJ"
    good, bad = f"ghp_{body}{secrets.checksum(body)}", f"ghp_{body}000000"
    assert [s[2] for s in secrets.find_secrets(f"x {good} y")] == ["github"]
    assert secrets.find_secrets(f"x {bad} y") == []
    d = docs(spark, [f"a {good} b", "clean", None])
    rows = {r["doc_id"]: r for r in secrets.redacted(d).collect()}
    assert rows[0]["text"] == "a [secret] b" and rows[0]["n_chars"] == 12 and rows[1]["text"] == "clean" and rows[2]["text"] is None
    assert secrets.redacted(d).columns == d.columns


def test_ogg_round_trip(spark):
    texts = ODD + ["y" * n for n in (63, 64, 65, 255 * 16, 4096, 70_000, 400_000)]
    rows = {r["doc_id"]: r for r in ogg.media_features(ogg.write_media(docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (rows[i]["n_bytes"], rows[i]["payload_bytes"], rows[i]["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert rows[i]["tail_crc32"] == zlib.crc32(payload[-64:])
    assert rows[14]["media_sha256"] == rows[15]["media_sha256"] and rows[0]["feature"] == rows[1]["feature"]


def test_ogg_rejects_damage_and_checks_like_the_format():
    def slow(page):  # bit by bit, from the format's definition
        c = 0
        for b in page:
            c ^= b << 24
            for _ in range(8):
                c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        return c

    media = ogg.encode("text " * 20_000)
    assert ogg.page_checksum(media[:300]) == slow(media[:300])
    for at in (5, 30, len(media) // 2, len(media) - 1):
        with pytest.raises(ValueError):
            ogg.samples(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])
    with pytest.raises(ValueError):
        ogg.samples(media[:-5])


def pages(spark, htmls, url="http://h.example/x"):
    return spark.createDataFrame([(i, url, h, "r", 0) for i, h in enumerate(htmls)], "page_id long, url string, html string, record_type string, start int")


def test_warc_with_magic_inside_payloads(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    long = "ö" * 700
    htmls = [None, "", "short", "short", long, long, f"a{fake}b", fake * 3, "WARC/1.1\r\n", f"{long}WARC/1.1\r\n{long}", "WARC/1.1\r\nContent-Length: 99999999\r\nWARC-Type: x\r\n\r\n", long, "\r\n\r\n", "x"]
    rows = {r["page_id"]: r for r in warc.archived(pages(spark, htmls)).collect()}
    for i, h in enumerate(htmls):
        data = (h or "").encode()
        revisit = h == long and i != 11
        assert (rows[i]["payload_bytes"], rows[i]["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest()), i
        assert (rows[i]["record_type"], rows[i]["refers_to"]) == (("revisit", 11) if revisit else ("response", None))
    assert warc.archived(pages(spark, [])).count() == 0


def test_warc_on_odd_rows(spark):
    """Null page_id and url, repeated rows, line ends in urls, clashing columns."""
    long, other = "x" * 1200, "y" * 1500
    rows = [(None, None, long), (None, "u", long), (4, "a\r\nb: c", long), (4, "a", long), (2, "b", long), (2, "b", long), (None, "b", other), (7, None, None), (8, "c", "z" * 999), (9, "c", "z" * 999)]
    schema = "page_id long, url string, html string, key string, none int, digest string, mark string, refers int, bytes int, file string, start int"
    d = spark.createDataFrame([(*r, "k", 1, "d", "m", 2, 3, "f", 4) for r in rows], schema).repartition(3)
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"], r["payload_digest"]) for r in warc.archived(d).collect())
    want = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        again = h == long and i != 4
        want[i, len(data), "revisit" if again else "response", 4 if again else None, hashlib.sha1(data).hexdigest()] += 1
    assert got == want


def test_warc_chain_across_many_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        htmls = [f"{i} WARC/1.1\r\n" * (i % 40) for i in range(300)]
        rows = warc.archived(pages(spark, htmls).coalesce(1), compression="none").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r["page_id"]: r["payload_digest"] for r in rows} == {i: hashlib.sha1(h.encode()).hexdigest() for i, h in enumerate(htmls)}


def test_warc_payloads_are_not_shuffled_to_be_read(spark):
    """At sizes where no join is broadcast, too: below no exchange of the plan are the archives read."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = warc.read_warc(spark, warc.write_warc(pages(spark, [f"text {i}" for i in range(20)])))
        plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
        assert sorted(r["page_id"] for r in found.collect()) == list(range(20))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    above, seen = [], 0
    for line in plan:
        depth = len(re.match(r"[\s:+-]*", line)[0])
        above = [(d, name) for d, name in above if d < depth]
        above.append((depth, line[depth:]))
        if "FileScan text" in line or "Scan text" in line:
            seen += 1
            assert not [name for _, name in above if name.startswith("Exchange")], "\n".join(plan)
    assert seen


def test_wrappers(spark):
    page = "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>A</a></li><li>B</li></ul></nav><!-- ad --><div class='ad'>buy</div>{}<footer>&copy; x</footer></body></html>"
    htmls = [
        page.format("<article><h1>One &amp; two</h1><p><b>bold\n text<br>more<p>last &#65;&lt;</article>"), page.format("<article><h1>H</h1><p>a</p><div class='ads'>no</div><ul><li>i</li><li>j</li></ul></article><div id='comments'><p>me too</p></div>"),
        page.format("<article>plain <i>in</i>line</article>"), None, "", "<p>no article", page.format("<article></article>"), page.format("<article><p>cut"),
    ]
    rows = {r["page_id"]: r for r in wrappers.main_text(pages(spark, htmls)).collect()}
    want = ["One & two\nbold text more\nlast A<", "H\na\ni\nj", "plain inline", "", "", "", "", "cut"]
    assert [rows[i]["text"] for i in range(8)] == want
    assert all(rows[i]["n_chars"] == len(want[i]) for i in range(8))
    assert wrappers.main_text(pages(spark, [])).count() == 0


def test_wrappers_with_boilerplate_marked_by_id_or_role(spark):
    one = "<body><div id='sidebar'><p>side</p></div><div id='content'><article><p>text</p></article></div></body>"
    two = "<body><div><article><p>other</p></article></div><div role='navigation'>go</div><div>after</div></body>"
    three = "<body><div class='a1d'><article>kept</article></div></body>"
    four = "<body><div class='ad'>buy</div></body>"
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(pages(spark, [one, two, three, four])).collect()}
    assert got == {0: "text", 1: "other", 2: "kept", 3: ""}
    assert [[i[3] for i in wrappers.expression(wrappers.parse(x))[0][5]] for x in (one, two)] == [[True, False], [False, True, False]]


def test_wrappers_of_hosts_with_mixed_templates(spark):
    body = "<html><body><header>Site</header><nav>go</nav>{}<footer>foot</footer></body></html>"
    mixed = {
        body.format("<article>one</article><div class='meta'>some words about the page and more of them</div>"): "one",
        body.format("<main><p>two</p></main>"): "two",
        body.format("<div class='content'><p>three</p><p>more</p></div>"): "three\nmore",
        body.format("<div class='meta'>m</div><div class='story'><header>head</header><p>four and many words</p></div>"): "m\nhead\nfour and many words",
        body.format("five"): "five",
        body.format(""): "",
        "<div>six</div>": "six",
        "seven": "seven",
    }
    longer = "<p>long text of the host</p>" * 9
    paths = {
        f"<html><body><div class='w-1/2'><div class='text'>{longer}</div></div></body></html>": "\n".join(["long text of the host"] * 9),
        "<html><body><div class='wrap'><div class='w-1/2'><div class='text'>more</div></div></div><div>x</div></body></html>": "more",
        "<html><body><div class='text'>fewer</div><div>x</div></body></html>": "fewer",
        "<html><body><div class='story'>other</div></body></html>": "other",
    }
    for want, url in ((mixed, "http://h.example/x"), (mixed, None), (paths, "http://h.example/x")):
        got = {r["page_id"]: r["text"] for r in wrappers.main_text(pages(spark, list(want), url)).collect()}
        assert [got[i] for i in range(len(want))] == list(want.values())


def test_wrapper_alignment():
    one, two = (wrappers.expression(wrappers.parse(h)) for h in ("<ul><li>a</li></ul><p>x</p>", "<ul><li>a</li><li>b</li></ul><h2>t</h2><p>x</p>"))
    both = wrappers.align(one, two)
    assert [(x[0], x[1], x[2]) for x in both] == [("ul", False, False), ("h2", True, False), ("p", False, False)]
    assert both[0][5][0][:3] == ["li", False, True]


@pytest.mark.parametrize("n", [1, 2, 7, 8, 30])
def test_article_text_stays_however_many_pages_share_it(spark, n):
    page = "<body><article><h1>Same title</h1><p>{0} one</p><p>Markets closed mixed on Friday</p><p>{0} two</p></article><div>foot</div></body>"
    htmls = [page.format(f"words {i}") for i in range(n)]
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(pages(spark, htmls)).collect()}
    assert got == {i: f"Same title\nwords {i} one\nMarkets closed mixed on Friday\nwords {i} two" for i in range(n)}


def test_text_that_differs_between_pages_tells_the_place_of_articles(spark):
    """No article, no main, no telling names: a long list that all pages share, and short texts that are their own."""
    shared = "".join(f"<li>a rather long entry number {i} of the list that each page has</li>" for i in range(30))
    page = "<body><div class='x'><ul>" + shared + "</ul></div><div class='y'><p>{}</p><p>{}</p></div></body>"
    got = [r["text"] for r in wrappers.main_text(pages(spark, [page.format(f"first {i}", f"second {i}") for i in range(6)])).orderBy("page_id").collect()]
    assert got == [f"first {i}\nsecond {i}" for i in range(6)]


def test_words_of_boilerplate_inside_of_other_names(spark):
    """Compound names that only contain such a word are content; short numbers keep columns apart; teasers go."""
    body = "<html><body>{}</body></html>"
    htmls = {
        body.format("<article><div class='article-header'><h1>Title</h1></div><p class='share-price'>Up</p><section id='comment-on-trade'><p>Sub 0</p></section><p>a <b class='social-contract'>deal</b> made</p><p>end</p></article>"): "Title\nUp\nSub 0\na deal made\nend",
        body.format("<article><p>one <span class='ad'>buy</span>two</p><div class='site-footer'>x</div><div class='post-comments'>y</div><div class='ad-banner top'>z</div></article>"): "one two",
        body.format("<article><h1>Long story</h1><p>many words of it</p></article><article class='teaser'><h2>Other</h2><p>short</p></article><article><a href='/b'><h2>Third story</h2></a><p>x</p></article>"): "Long story\nmany words of it",
        body.format("<article class='teaser'><h2>Only</h2><p>this</p></article>"): "Only\nthis",
        body.format("<article><p>one</p></article><article><p>two</p></article>"): "one\ntwo",
    }
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(pages(spark, list(htmls))).collect()}
    assert [got[i] for i in range(len(htmls))] == list(htmls.values())
    columns = [body.format(f"<div class='col1'><p>menu text of some length {i // 9}</p></div><div class='col2'><p>{'words and ' * 40}{i}</p></div><div class='col3'><p>links</p></div>") for i in range(8)]
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(pages(spark, columns)).collect()}
    assert got == {i: f"{'words and ' * 40}{i}" for i in range(8)}


def test_hosts_against_a_plain_model(spark):
    """Random hosts from templates with known places of their text: what main_text returns is that text."""
    draw = random.Random(12)
    words = lambda n: " ".join(draw.choice(["stone", "river &amp; sea", "path", "wind", "<i>leaf</i>"]) for _ in range(n))
    plain = lambda x: re.sub(r"<[^>]*>", "", x).replace("&amp;", "&")
    rows, want = [], {}
    for host in range(12):
        kind = draw.choice(["article", "main", "div"])
        opened, closed = {"article": ("<article>", "</article>"), "main": ("<main>", "</main>"), "div": ("<div class='story-1'>", "</div>")}[kind]
        menu, side, foot = ("".join(f"<li><a href='/{k}'>{words(2)}</a></li>" for k in range(draw.randint(1, 6))) for _ in range(3))
        for page in range(draw.randint(2, 14)):
            blocks = [words(draw.randint(12, 30)) + f" {page}" for _ in range(draw.randint(2, 6))]
            mine = "".join(draw.choice(["<p>{}</p>", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<blockquote><p>{}</p></blockquote>"]).format(b) for b in blocks)
            ad = draw.choice(["", "<div class='ad'>buy</div>", "<aside>more</aside>"])
            i = len(rows)
            rows.append((i, f"http://h{host}.example/{page}", f"<html><body><nav><ul>{menu}</ul></nav><div class='sidebar'>{side}</div><div class='w'>{opened}{mine}{ad}{closed}</div><footer>{foot}</footer></body></html>"))
            want[i] = "\n".join(plain(b) for b in blocks)
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert got == want


def test_pages_of_their_own_class_names_take_time_in_proportion(spark, monkeypatch):
    htmls = [f"<body><div class='p{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}'><p>text {i}</p></div></body>" for i in range(4000)]
    one = [wrappers.expression(wrappers.parse(x)) for x in htmls]
    began = time.perf_counter()
    whole = wrappers.merged(iter(one))
    assert time.perf_counter() - began < 10 and wrappers._size(whole) <= 3 * wrappers.MANY
    assert wrappers._mass(whole, (), False) == sum(wrappers._mass(x, (), False) for x in one)
    monkeypatch.setattr(wrappers, "FAN", 5)  # several rounds of groups
    rows = spark.createDataFrame([("h", x) for x in htmls[:300]], "host string, html string")
    assert wrappers.infer(rows).count() == 1
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(pages(spark, htmls[:40])).collect()}
    assert got == {i: f"text {i}" for i in range(40)}


def test_an_article_counts_however_large_its_host_is(spark):
    """An article with less than a thousandth of a host's text, beside few pages and beside many of own classes."""
    mine = "<body><article>few</article><div class='meta'>words about the page, and more of them</div></body>"
    own = [f"<body><div class='p{chr(97 + i % 26)}{chr(97 + i // 26)}'><p>{'words and ' * 20}{i}</p></div></body>" for i in range(676)]
    for n in (2, 676):
        rows = pages(spark, [mine, *own[:n]])
        got = {r["page_id"]: r["text"] for r in wrappers.main_text(rows).collect()}
        assert got == {0: "few"} | {i + 1: f"{'words and ' * 20}{i}" for i in range(n)}


def test_wrappers_are_the_same_for_any_groups_and_beside_any_hosts(spark, monkeypatch):
    draw = random.Random(7)
    bits = ["<div>{}</div>", "<ul><li>{}</li><li>x</li></ul>", "{}", "<p>{}</p>", "<section class='s'>{}<p>{}</p></section>"]
    htmls = ["<body>" + "".join(draw.choice(bits).format(*["y" * draw.randint(0, 3)] * 2) for _ in range(draw.randint(1, 9))) + "</body>" for _ in range(150)]
    one = sorted((wrappers._hash(x), wrappers.expression(wrappers.parse(x))) for x in set(htmls))
    whole = wrappers.aligned(iter(one))
    for shift in (62, 60, 57):
        groups = [(g, wrappers.aligned(iter(list(x)))) for g, x in itertools.groupby(one, key=lambda x: x[0] >> shift)]
        assert wrappers.aligned(iter(groups)) == whole
    found = set()
    for fan, more in ((1000, 0), (3, 0), (3, 100), (1000, 40)):
        monkeypatch.setattr(wrappers, "FAN", fan)
        rows = [("h", x) for x in htmls] + [("g", f"<body><div class='c{chr(97 + i % 26)}{chr(97 + i // 26)}'></div>x</body>") for i in range(more)]
        found |= {(fan, more, r["roots"]) for r in wrappers.infer(spark.createDataFrame(rows, "host string, html string")).where("host = 'h'").collect()}
    assert len(found) == 4 and len({x[2] for x in found}) == 1


def test_wrappers_are_the_same_for_any_layout(spark):
    draw = random.Random(6)
    bits = ["<div>{}</div>", "<ul><li>{}</li><li>x</li></ul>", "<h2>{}</h2>", "<p>{}</p>", "<section class='s'><p>{}</p></section>", "<table><tr><td>{}</td></tr></table>"]
    htmls = ["<body>" + "".join(draw.choice(bits).format(draw.randint(0, 3)) for _ in range(draw.randint(1, 12))) + "</body>" for _ in range(120)]
    rows = [("h" if i % 3 else "g", x) for i, x in enumerate(htmls)]
    found = set()
    for parts in (1, 3, 7):
        draw.shuffle(rows)
        found.add(tuple(sorted(tuple(r) for r in wrappers.infer(spark.createDataFrame(rows, "host string, html string").repartition(parts)).collect())))
    assert len(found) == 1


def test_aligned_expressions_match_both_sequences():
    def pattern(items):
        return "".join(f"(?:{x[0]}{'+' if x[2] else ''}){'?' if x[1] else ''}" for x in items)

    draw = random.Random(9)
    for _ in range(500):
        texts = ["".join(draw.choice("abcd") for _ in range(draw.randint(0, 9))) for _ in range(3)]
        found = None
        for text in texts:
            one = wrappers.expression(wrappers.parse("".join(f"<{c}x></{c}x>" for c in text)))
            for x in one:
                x[0] = x[0][0]
            found = one if found is None else wrappers.align(found, one)
        assert all(re.fullmatch(pattern(found), text) for text in texts), (texts, pattern(found))


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<div>" * 50_000 + "deep" + "</div>" * 50_000, "deep"),
        ("<div>" * 300 + "<aside>" + "<div>no" * 50 + "</div>" * 50 + "</aside><b>a</b><div>b</div>c", "a\nb\nc"),
        ("<p>x</p>" * 100_000, "\n".join("x" * 100_000)),
        ("t<a " * 30_000, ("t<a " * 30_000).strip()),
        ("<a <a " * 30_000 + ">t", "t"),
        ('<a ">' * 30_001 + "t", "t"),
        ("<x>" * 20_000 + "</y>" * 20_000 + "t", "t"),
        ("<p>a</p><h2>b</h2>" * 20_000, "\n".join("ab" * 20_000)),
    ],
)
def test_long_and_deep_pages_take_time_in_proportion(html, want):
    began = time.perf_counter()
    e = wrappers.expression(wrappers.parse(html))
    wrappers.align(e, [["q", False, False, False, 1, [], 0], *e])
    assert wrappers.read(html, [[]]) == want
    assert time.perf_counter() - began < 20


def test_wrappers_on_odd_rows(spark):
    rows = [(None, "http://h.example/1", "<p>a</p>"), (1, None, "<div>b</div>"), (1, None, "<div>b</div>"), (2, "no url", None), (3, "", "x" * 200_000)]
    d = spark.createDataFrame([(*r, "h", "r", 7) for r in rows], "page_id long, url string, html string, host string, roots string, n_chars int")
    got = sorted(((r["page_id"], r["text"]) for r in wrappers.main_text(d).collect()), key=repr)
    assert got == sorted([(None, "a"), (1, "b"), (1, "b"), (2, ""), (3, "x" * 200_000)], key=repr)


def test_lattice_cells_against_search():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(40, 8)) * 2
    near = lattice.decode(x)
    shell = np.concatenate([np.zeros((1, 8)), lattice.neighbours()])
    assert len(shell) == 2401
    for p, q in zip(x, near, strict=True):
        assert ((p - q) ** 2).sum() <= ((p - (q + shell)) ** 2).sum(1).min() + 1e-12
    rows, keys = lattice.cells(x, 0.3)
    for k in range(40):  # points within reach lie in one of the cells
        step = draw.normal(size=(50, 8))
        step *= 0.3 * draw.random((50, 1)) / np.sqrt((step**2).sum(1, keepdims=True))
        assert set(lattice.cell_key(lattice.decode(x[k] + step))) <= set(keys[rows == k])


def test_near_vectors(spark):
    draw = np.random.default_rng(5)
    base = draw.normal(size=(30, 20))
    x = [*(base[i % 30] + draw.normal(size=20) * s for i, s in enumerate(np.linspace(0, 0.6, 300))), base[0], base[0] * 1e200]
    rows = [(i, [float(v) for v in r], i % 3 if i % 10 else None, 9) for i, r in enumerate(x)]
    rows += [(400, None, 1, 9), (401, [], 1, 9), (402, [0.0] * 20, 1, 9), (403, [float("nan")] + [1.0] * 19, 1, 9), (404, [None] + [1.0] * 19, 1, 9), (None, list(map(float, base[0])), 0, 9), (405, [1.0, 0.0, 0.0], 1, 9), (406, [1.0, 0.1, 0.0], 1, 9)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links int")
    for scale in (0.35, 0.2):
        got = {r["vec_id"]: r for r in lattice.near_vectors(d, scale=scale).collect()}
        ok = [(i, np.array(v) / np.abs(v).max(), y) for i, v, y, _ in rows if i is not None and y is not None and v and None not in v and np.isfinite(v).all() and any(v)]
        links = {i: set() for i, *_ in rows}
        for (i, a, p), (j, b, q) in itertools.combinations(ok, 2):
            if p == q and len(a) == len(b) and a @ b / np.sqrt(a @ a * (b @ b)) >= 0.93:
                links[i].add(j)
                links[j].add(i)
        for i in links:
            seen, todo = {i}, [i]
            while todo:
                new = links[todo.pop()] - seen
                seen |= new
                todo += new
            least = None if i is None else min(seen)
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(links[i]), least, i is not None and least == i)
    assert lattice.near_vectors(d.limit(0)).count() == 0


@pytest.mark.parametrize(("d", "sizes"), [(16, (1e-170, 1.0, 1e170, 5e-324 * 2**60, 1e300)), (1600, (1.0, 1e-160))])
def test_near_vectors_of_any_magnitude(spark, d, sizes):
    """Pairs near the threshold, some in doubt on the grid, tiny and huge alike, very long ones, a vec_id that repeats."""
    draw = np.random.default_rng(8)
    x = draw.normal(size=(24, d))
    other = draw.normal(size=(24, d))
    other -= (other * x).sum(1)[:, None] / (x * x).sum(1)[:, None] * x  # at right angles
    other *= np.sqrt((x * x).sum(1) / (other * other).sum(1))[:, None]
    cos = np.concatenate([np.full(18, 0.93) + np.linspace(-4e-4, 4e-4, 18), [0.5, 0.9299999, 0.9300001, 0.99, 1.0, 0.931]])
    y = x * cos[:, None] + other * np.sqrt(1 - cos**2)[:, None]
    base = np.concatenate([x, y])
    rows, want = [], {}
    for k, size in enumerate(sizes):
        v = base / np.abs(base).max() * size
        rows += [(1000 * k + i, list(map(float, r)), k, 1.0, "b") for i, r in enumerate(v)]
        exact = v / size
        near = exact @ exact.T / np.sqrt((exact**2).sum(1)[:, None] * (exact**2).sum(1)[None])
        for i in range(len(v)):
            want[1000 * k + i] = int((near[i] >= 0.93).sum() - 1)
    rows.append((3, rows[3][1], 0, 1.0, "b"))  # the same vec_id and vector once more
    got = lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, a double, key string")).collect()
    for n in (3, 27):
        want[n] += n == 3 or near_to(rows, 3, 27)
    found = {}
    for r in got:
        found.setdefault(r["vec_id"], set()).add(r["n_links"])
    assert len(got) == len(rows) and found == {k: {n} for k, n in want.items()}


def near_to(rows, i, j):
    a, b = np.array(rows[i][1]), np.array(rows[j][1])
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return bool(a @ b / np.sqrt(a @ a * (b @ b)) >= 0.93)


def plain_shingles(text):
    """The contract's words and shingles, by a pattern and tuples."""
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_shingles_against_a_plain_version():
    draw = random.Random(8)
    bits = [*"aAbBzZ", "É", "ſ", "İ", "\x1c", "\x85", "\xa0", "\u2003", " ", "  ", "\n", "\t", "\x0b", "\r", "-", "word", "Word"]
    for text in ODD + ["".join(draw.choice(bits) for _ in range(draw.randint(0, 60))) for _ in range(2000)]:
        assert len(minhash.shingles(text)) == len(plain_shingles(text)), repr(text)


def brute(texts):
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(texts, 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 20)  # so that blocks are cut
    draw = random.Random(3)
    texts = list(ODD)
    for _ in range(6):
        base = [draw.choice("abcdefghij") * draw.randint(1, 6) + str(draw.randint(0, 50)) for _ in range(120)]
        for k in range(40):
            copy = list(base)
            for _ in range(draw.randint(0, 9)):
                copy[draw.randrange(len(copy))] = f"n{draw.randint(0, 10**6)}"
            texts.append(" ".join(copy))
    d = docs(spark, texts, extra=[(None, texts[-1], None, None, 1, 1, 1.0, "", 1)])
    got = {r["doc_id"]: r for r in minhash.near_duplicates(d).collect()}
    for i, (n, c) in brute(dict(enumerate(texts))).items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, c, c == i), i
    assert got[None]["component_id"] is None and got[None]["kept"] is False
    assert minhash.near_duplicates(d.limit(0)).count() == 0


def test_near_duplicates_with_a_doc_id_that_repeats(spark):
    """Rows of one doc_id are judged each by its own text; a component is named by the least doc_id of its rows."""
    words = lambda w: " ".join(f"{w}{i}" for i in range(60))
    rows = [(5, words("a")), (5, words("b")), (9, words("a") + " x"), (5, words("a")), (2, words("b") + " y"), (7, words("c")), (7, None)]
    d = docs(spark, [], extra=[(i, t, None, None, 1, 1, 1.0, "", 1) for i, t in rows])
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(d).collect())
    by_row = brute(dict(enumerate(t for _, t in rows)))
    want = []
    for k, (i, _) in enumerate(rows):
        least = min(rows[j][0] for j in range(len(rows)) if by_row[j][1] == by_row[k][1])
        want.append((i, by_row[k][0], least, i == least))
    assert got == sorted(want)


def test_copies_in_one_task_and_keys_that_several_sets_share(spark, monkeypatch):
    long = " ".join(f"w{i}" for i in range(80))
    texts = [long] * 30 + [long + " end"] * 30 + ["quite another text of more than five words", "and one more text that is like none of them"] * 10
    want = brute(dict(enumerate(texts)))
    for same in (False, True):
        if same:  # every set has the same first hash
            plain = minhash._key
            monkeypatch.setattr(minhash, "_key", lambda s: (7, plain(s)[1]))
        got = {r["doc_id"]: r for r in minhash.near_duplicates(docs(spark, texts)).collect()}
        assert all((got[i]["n_shingles"], got[i]["component_id"]) == x for i, x in want.items())


def test_bounds_of_sequential_verification():
    need = minhash.least_matches(0.75, 1e-4)
    assert list(need) == sorted(need) and need[-1] < 0.75 * minhash.HASHES
    draw = np.random.default_rng(0)  # pairs right at the threshold survive almost always
    k = draw.random((20_000, minhash.HASHES)) < 0.75
    lost = np.zeros(20_000, bool)
    for step, least in enumerate(need):
        lost |= k[:, : (step + 1) * minhash.BATCH].sum(1) < least
    assert lost.mean() < 1e-3


def test_toxicity_learns_words_and_restores_disguises(spark):
    draw = random.Random(2)
    plain = ["the", "river", "runs", "over", "stones", "and", "under", "bridges", "while", "birds", "sing", "songs", "about", "summer", "wind"]
    texts, labels = [], []
    for i in range(900):
        words = [draw.choice(plain) for _ in range(draw.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            words.insert(draw.randrange(len(words)), draw.choice(["idiot", "scumbag", "moron"]))
        texts.append(" ".join(words))
        labels.append((i, int(bad), None))
    labels += [(None, 1, 0), (5, None, 1)]
    d, y = docs(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    model = toxicity.fit(d, y)
    rows = toxicity.scored(d, model).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in rows)
    for t in ("an 1d10t here", "what an i d i o t you", "IDIOT!!", "iiiidiot", "m0ron.", "you m.o.r.o.n", "idi0t$"):
        assert model.score(t) >= 0.5, t
    for t in (None, "", "the river runs 10 times", "100% of 5 stones", "a b c d", "AKIA12", "x" * 3000):
        assert model.score(t) < 0.5, t
    empty = toxicity.fit(d.limit(0), y.limit(0))
    assert empty.score("idiot") < 0.5


def test_viterbi_is_the_cheapest_of_all_paths():
    model = toxicity.language_model_of(np.random.default_rng(3).integers(0, 50, toxicity.K**3))

    def cost(letters):
        a = b = 0
        total, text = 0.0, ""
        for c, price in [*letters, (" ", 0.0)]:
            total += price
            if not c or c == " " and b == 0:
                continue
            i = toxicity._INDEX.get(c, 0)
            total += float(model[a, b, i])
            a, b, text = b, i, text + c
        return total, text.strip()

    draw = random.Random(5)
    for _ in range(150):
        token = "".join(draw.choice("aabio10!$. _7é") for _ in range(draw.randint(1, 6)))
        best = min(cost(path)[0] for path in itertools.product(*toxicity.options(token)))
        found = toxicity.viterbi(token, model)
        assert any(abs(t - best) < 1e-9 and x == found for t, x in map(cost, itertools.product(*toxicity.options(token)))), token


def test_toxicity_on_odd_tables(spark):
    d = docs(spark, ["fine words here", None, "", "fine words here", "x" * 300_000], extra=[(None, "fine", None, None, 1, 1, 2.0, "x", 3), (0, "other", None, None, 1, 1, 2.0, "x", 3)])
    model = toxicity.fit(d, spark.createDataFrame([(0, None)], "doc_id long, toxic int"))
    rows = toxicity.scored(d, model).collect()
    assert len(rows) == 7 and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in rows) and rows[0]["h"] == "x"
    assert toxicity.scored(d.limit(0), model).count() == 0


def test_toxicity_restores_words_beside_punctuation_and_doubled_letters(spark):
    draw = random.Random(4)
    plain = ["the", "river", "runs", "all", "over", "stones", "and", "under", "bridges", "while", "birds", "sing", "hilly", "songs"]
    texts, labels = [], []
    for i in range(900):
        words = [draw.choice(plain) for _ in range(draw.randint(5, 40))]
        if i % 4 == 0:
            words.insert(draw.randrange(len(words)), draw.choice(["idiot", "scum"]))
        texts.append(" ".join(words))
        labels.append((i, int(i % 4 == 0), None))
    model = toxicity.fit(docs(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))
    for t in ("you s c u m!", "what s c u m.", '"s c u m" he', "s  c  u  m", "s - c - u - m", "(s c u m)", "the s c u m, and", "s c u m. a river", "sccuumm", "scuum.", "iddiot", "idiiott!"):
        assert model.score(t) >= 0.5, t
    assert toxicity._spaced("i d i o t, go") == ["i d i o t"]
    assert toxicity._spaced("a m o r and mo ro n, he said") == ["a m o r", "mo ro n"]
    for t in ("all the hilly songs", "a, b, c, d.", "1. 2. 3. 4. 5", "- - - - -", "....a", "s.u. m.c. river", "the . river . runs . over"):
        assert model.score(t) < 0.5, t
    assert toxicity.readings("hilly", model.language) == ["hilly"]
    assert len(toxicity._spaced("." * 50_000 + "a" + "- " * 50_000 + "ab")) == 0


def test_mixing_budget_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("web", "en", "a", 100), ("web", "en", "b", 1000), ("web", "de", "c", 1000), ("books", "en", "d", 5000)], "domain string, lang string, source string, supply long")
    weights = {"domain": {"web": 50, "books": 50}, "lang": {"en": 50, "de": 50}, "source": {}}
    own = {r["source"]: r["own"] for r in mixing.budgets(leaves, weights, percent=20, epochs=1).collect()}
    assert own == {"a": 100, "b": 255, "c": 355, "d": 710}  # what a lacks goes to b, not to c or d


def test_mixing_counts_and_edges(spark):
    texts = [("w " * (i % 50)).strip() for i in range(400)] + [None, ""]
    d = docs(spark, texts, extra=[(None, "a b", None, None, 1, 1, 1.0, "", 1), (0, "", None, None, 1, 1, 1.0, "", 1)])
    out = mixing.mixed(d)
    assert out.columns == d.columns
    chosen = {r["row"]["doc_id"]: r["copies"] for r in mixing.chosen(d).collect()}
    assert all(1 <= c <= 3 for c in chosen.values()) and mixing.mixed(d.limit(0)).count() == 0
    total, used = sum(len((t or "").split()) for t in texts), mixing.chosen(d).selectExpr("sum(n * copies)").first()[0]
    assert 0.6 * total < used <= 0.81 * total


LEET, ALIKE = str.maketrans("oieastl", "013@$71"), str.maketrans("acekmoptxyiβ", "асекмортхуіβ")
FORMS = {
    "blanks": " ".join, "double blanks": "  ".join, "tabs": "\t".join, "lines": "\n".join, "dots": ".".join, "pipes": "|".join, "plus": "+".join, "zero width": "​".join, "no-break": "\xa0".join,
    "twos": lambda w: " ".join(w[i : i + 2] for i in range(0, len(w), 2)), "threes": lambda w: "\n".join(w[i : i + 3] for i in range(0, len(w), 3)), "halves": lambda w: f"{w[: len(w) // 2]} {w[len(w) // 2 :]}",
    "doubled": lambda w: "".join(c * 2 for c in w), "repeats": lambda w: "".join(c * 3 for c in w), "leet": lambda w: w.translate(LEET), "leet and blanks": lambda w: " ".join(w.translate(LEET)),
    "other letters": lambda w: w.translate(ALIKE), "full width": lambda w: "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in w), "capitals and dashes": lambda w: "-".join(w.upper()), "quoted": lambda w: f'"{" ".join(w)}"',
}


def test_every_way_of_parting_and_disguising_is_decoded(spark):
    from actionline.llm.common import table

    d, y = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    model = toxicity.fit(d, y)
    known = [w for w in model.words if model.weights.get(toxicity._hash(f"{w}$"), 0) >= 0.9 and len(w) >= 4]
    assert len(known) >= 10
    around = [("The and thanedble ", ", anea and thanea."), ("Nicht aulich für ", " sch erüver."), ("Of thndouha thre ", " atre with.")]
    for name, form in FORMS.items():
        hit = sum(model.score(a + form(w) + b) >= 0.5 for k, w in enumerate(known) for a, b in [around[k % 3]])
        assert hit >= 0.85 * len(known), (name, hit, len(known))
    # what the lattice finds between the words of clean documents is next to nothing
    clean = [r["text"].lower() for r in d.join(y.where("toxic = 0"), "doc_id").where("text is not null").limit(1500).collect()]
    assert sum(any(model.restored(p) > 0.5 for p in model.hidden(t)) for t in clean) <= 3


def test_hidden_words_are_found_wherever_their_letters_stand():
    """Every stretch whose folded letters are a word's, unless it stands openly, against all stretches of a text."""
    draw = random.Random(10)
    model = toxicity.Model(np.zeros((toxicity.K,) * 3), {}, 0.0, ("abba", "cde", "tide"))
    fold = lambda t: re.sub(r"(.)\1+", r"\1", "".join({"i": "l", "1": "l", "@": "a"}.get(c, c) for c in t if c in "abcdeitl1@"))
    for _ in range(400):
        text = "".join(draw.choice("aabbcdeitl1@ .​\t") for _ in range(draw.randint(1, 14)))
        want = False
        for i, j in itertools.combinations(range(len(text) + 1), 2):
            part = text[i:j]
            if fold(part) in {fold(w) for w in model.words} and not (part.isalpha() and part == fold(part).replace("l", part[part.find("l")] if "l" in part else "i") and not re.search(r"(.)\1", part)):
                want = want or fold(part[:1]) != "" and fold(part[-1:]) != ""
        open_ = {w for w in re.findall("[a-z]+", text)}
        if not any(fold(w) in fold(o) for w in model.words for o in open_):
            assert bool(model.hidden(text)) == want, (text, model.hidden(text))
    assert model.hidden("so c d e x") == {"c d e"} and model.hidden("cde") == set() and model.hidden("xc.d​e1") == {"xc.d​e1"[:-1]}
