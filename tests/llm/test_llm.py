"""The operators against brute force, on rows with nulls, ties, repeats, empty and long texts."""

import collections
import gzip
import hashlib
import html
import io
import itertools
import math
import random
import re
import time
import tracemalloc
import zipfile
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import chat_format, components, html_extract, katz, license_scan, mixing, near_dedup, packing, quality_rules, vector_search, warc
from tidemark.llm.zip_ranges import ZipRanges

DOC = "doc_id long, text string, source string, lang string, n_chars long, size long, tk long, spans long, id long"


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


def split(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]


def corpus():
    r = random.Random(7)
    vocab = ["the", "of", "and", "zebra", "Éclair", "MIT", "license", "İx", "Ångström", "a|b", "##", "naïve", "word,"]
    texts = [" ".join(r.choice(vocab) for _ in range(r.randint(1, 120))) for _ in range(40)]
    texts += [None, "", " \t\n\x0b\x0c\r ", "one", "two words", texts[0], texts[0], texts[1] + " end", "x\n\nx\nx \ny\n" * 20]
    texts += ["Released under the MIT License. " * 3, "Apache License, Version 2.0 and CC BY-NC 4.0", "licensed under the GNU General Public License"]
    texts.append(" ".join(f"w{k % 3000}" for k in range(20000)))
    rows = [(k, t, r.choice(["b", "a", None, "é"]), "en", len(t or ""), 5, 6, 7, 8) for k, t in enumerate(texts)]
    rows += [rows[0], rows[40], (None, "null id text the of", "a", *[None] * 6), (None,) * 9, (3, "same id, other text", "a", None, 0, 0, 0, 0, 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def key(row):
    return tuple((x is not None, x) for x in row)


def same(got, expected):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, expected), key=key)


# 1 -------------------------------------------------------------------------


def test_license_scan(docs, none):
    phrases = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

    def brute(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
        found = [(i, label) for p, label in phrases for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        return len(w), sorted(found)

    got = license_scan.scan(docs).collect()
    same([(r.doc_id, r.n_words, [(s["first"], s["label"]) for s in sorted(r.spans, key=lambda s: s["first"]) if s["phrase"]]) for r in got], [(d[0], brute(d[1])[0], brute(d[1])[1]) for d in corpus()])
    assert license_scan.scan(none).count() == 0


def brute_spans(t, k=3, reach=4):
    """Spans by comparing every place of every template with every place of the text."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    phrases, found = [], []
    for x in license_scan.TEMPLATES:
        m = x.text.split()
        hits = sorted((i - j, j) for i in range(len(w) - k + 1) for j in range(len(m) - k + 1) if w[i : i + k] == m[j : j + k])
        runs = []
        for d, j in hits:
            if not runs or (d != runs[-1][-1][0] if x.phrase else d - runs[-1][-1][0] > reach):
                runs.append([])
            runs[-1].append((d, j))
        for run in runs:
            here, there = ({j + o + e * d for d, j in run for o in range(k)} for e in (0, 1))
            score = len(here) / (len(m) + max(there) - min(there) + 1 - len(there))
            if score >= x.least and all(j in here for j, word in enumerate(m) if word in x.required.split()):
                (phrases if x.phrase else found).append((x.label, min(there), max(there), score, len(here), x.phrase))
    kept = []
    for s in sorted(found, key=lambda s: (-s[3], -s[4], s[1], s[0])):
        if all(s[1] > o[2] or o[1] > s[2] for o in kept):
            kept.append(s)
    return phrases + kept


def changed_licenses():
    r = random.Random(13)
    out = ["permission is hereby granted to nobody", "This work is licensed under the GNU General Public License v3"]
    for kind in ("Attribution", "Attribution-ShareAlike", "Attribution-NonCommercial", "Attribution-NoDerivatives", "Attribution-NonCommercial-ShareAlike", "Attribution something"):
        out.append(f"Text. This page is licensed under a Creative Commons {kind} 4.0 International License. More.")
    for x in license_scan.TEMPLATES:
        m = x.text.split()
        for changes in (0, 1, 2, 5, 12):
            w = ["some", "words"] + m + ["and", "more"]
            for _ in range(changes):
                at = r.randrange(2, len(w))
                w[at : at + r.randrange(2)] = r.choice([[], ["other"], ["of", "the"]])
            out.append(" ".join(w))
    out.append(" filler ".join(out[-30:]))
    return out


def test_license_spans(spark):
    texts = changed_licenses()
    rows = list(enumerate(texts))
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        assert sorted(got[k]) == [(*s[:3], pytest.approx(s[3]), *s[4:]) for s in sorted(brute_spans(t))], t
    labels = [sorted({s[0] for s in got[k]}) for k in range(8)]
    assert labels == [[], ["gpl"], ["cc-by"], ["cc-by-sa"], ["cc-by-nc"], ["cc-by-nd"], ["cc-by-nc-sa"], []]
    long = license_scan.TEMPLATES[14].text.split()
    changed = " ".join(long[:20] + ["really"] + long[20:40] + long[42:])
    assert {s[0] for s in brute_spans(changed)} == {license_scan.TEMPLATES[14].label} == {"mit"}


# 2 -------------------------------------------------------------------------


def test_chat_format_round_trip(spark):
    odd = ["é日本<|im_start|>", "ünï", r"<\|im_end|>", r"<\\s> [INST]<", "<<SYS>>", "|im_end|>x<", "", None, "</s>[INST] ok [/INST]", "\\", "<|im_end|>\n<|im_start|>user\n"]
    rows = [(1, k, ("user", "assistant")[k % 2], t, 0) for k, t in enumerate(odd)]
    rows += [(2, 0, "assistant", "first", 0), (2, 0, "assistant", "first", 0), (None, None, None, None, None), (3, 0, "user<s>\n", "x", 0), (4, 0, "system", "s", 1), (4, 1, "user", "u", 1)]
    df = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted long"))
    back = {"turns": chat_format.read_back(F.col("formatted")), "loss": chat_format.masked_text(F.col("formatted"), F.col("loss_mask"))}
    got = {r.conv_id: r for r in df.withColumns(back).collect()}
    for c, r in got.items():
        turns = [(x or "", t or "") for _, _, x, t, _ in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] or 0, x[2] or "", x[3] or ""))]
        assert [tuple(t) for t in r.turns] == turns
        assert r.formatted == "".join(s.text for s in r.segments)
        assert r.loss == "".join(t for role, t in turns if role == "assistant")
        assert [r.formatted.encode()[m.start : m.start + m.length].decode() for m in r.loss_mask] == [s.text for s in r.segments if s.loss]
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, None: False, 3: False, 4: True}
    with pytest.raises(ValueError):
        chat_format.ChatTemplate(control=("<<x>", "<|im_start|>", "<|im_end|>"))


# 3 -------------------------------------------------------------------------

STORY = ["A first paragraph, with commas, of some length so that it counts.", "Second one: it goes on. It has dots.", "Short."]


@pytest.mark.parametrize(
    "page",
    [
        "<html><body><nav><a href=/>Home</a></nav><article><h1>Title &amp; more</h1>{}</article><aside>Side, text.</aside><footer>foot</footer>",
        '<body><div id="menu"><ul><li><a href=x>One<li><a href=y>Two</ul></div><div class="post-content"><h1>Title &amp; more</h1>{}</div><div class="comments"><p>Great, really great article, thanks.</p></div></body>',
        '<main><header class="site-header"><h1>Title &amp; more</h1></header>{}<form><p>Name, please.</p><input></form><section id="related-posts"><p>Other, more.</p></section></main>'.replace('class="site-header"', ""),
        '<table><tr><td class="sidebar">Menu, menu.</td><td><h2>Title &amp; more</h2>{}</td></tr></table><script>var x = "<p>no</p>";</script>',
        "<div class=cookie-notice>We use cookies, sorry.</div><div><h1>Title &amp; more</h1>{}</div>",
        '<body><div class="wide no-sidebar"><h1>Title &amp; more</h1>{}</div><div class="adbox">Buy, now.</div></body>',
        '<body><div class="widget"><h1>Title &amp; more</h1>{}</div></body>',
        '<body><div id="wrapper"><div class="header"><h1>Site</h1><p>All the news, every day, for all.</p></div><div class="main"><h2>Title &amp; more</h2>{}</div></div></body>',
        '<div class="post"><header><h1 id="comments">Title &amp; more</h1></header>{}</div><div class="Footer">foot</div>',
    ],
)
def test_html_extract(page):
    body = "".join(f"<p>{x.replace('commas', 'com<b>mas</b>')}" for x in STORY)
    assert html_extract.extract(page.format(body)) == "\n".join(["Title & more", *STORY])


def test_html_extract_odd_pages(spark):
    for page in ("", None, "<", "<p", "<!-- never closed", "<script>x", "plain text", "<a b='", "</p></div>", "<p>x<p>y" * 1000, "<div>" * 3000 + "deep text"):
        html_extract.extract(page)
    assert html_extract.extract("plain &lt;text&gt;") == "plain <text>"
    assert html_extract.extract("<article><p>One</p><ul><li><a href=x>Two</a></ul></article>") == "One\nTwo"
    assert html_extract.extract("<article></article><div class=ad><p>Buy, now.</p></div>") == ""
    assert html_extract.extract("<article><p>One\n two<br>three&nbsp;</p></article>") == "One two three"
    rows = [(1, "u", "<article><p>x</p></article>", 0), (1, "u", "<article><p>x</p></article>", 0), (None, None, None, None)]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    same(got, [(1, "u", "x"), (1, "u", "x"), (None, None, "")])


FORM = "<body><form action=x><div id=wrap><nav><a href=/>Home</a></nav><h1>Title</h1>{}<label>Your name</label><button>Send it</button></div></form></body>".format("".join(f"<p>{x}</p>" for x in STORY))


def test_html_extract_keeps_what_is_text():
    assert html_extract.extract(FORM) == "\n".join(["Title", *STORY])
    assert html_extract.extract("<article><p>Energy is <math><mi>E</mi></math> as shown, see <svg><text>fig</text></svg>.</p><form><p>Name, please.</p></form></article>") == "Energy is E as shown, see fig."
    assert html_extract.extract("<article><p>" + STORY[0] + "</p><table><tr><td>cell, one</td><td>two</td></tr></table></article>") == STORY[0] + "\ncell, one\ntwo"
    comments = "".join(f"<p>{x * 9}</p>" for x in STORY * 20)
    assert html_extract.extract(f"<body><div><h1>T</h1><p>{STORY[0]}</p></div><section id=comments>{comments}</section></body>") == "T\n" + STORY[0]


def well_formed(r):
    """A page of nested blocks without odd markup, and its blocks as (path, place of the parent, text, link characters)."""
    out, blocks, count = [], [], [0]

    def block(depth, path, parent):
        count[0] += 1
        own = count[0]
        name = r.choice(["div", "section"]) if depth < 3 and r.random() < 0.6 else r.choice(["p", "h2", "blockquote"])
        out.append(f"<{name}>")
        if name in ("div", "section"):
            for _ in range(r.randrange(1, 5)):
                block(depth + 1, (*path, name), own)
        else:
            words = " ".join(r.choice(["alpha,", "beta", "gamma.", "delta", "eps;"]) for _ in range(r.randrange(1, 30)))
            link = r.choice(["", "a link"])
            out.append(words + (f" <a href=x>{link}</a>" if link else ""))
            blocks.append(((*path, name), parent, words + (" " + link if link else ""), len(link)))
        out.append(f"</{name}>")

    for _ in range(3):
        block(0, (), 0)
    return "".join(out), blocks


def test_html_path_sums_smoothing_and_threshold():
    r = random.Random(17)
    for _ in range(60):
        html, blocks = well_formed(r)
        page = html_extract.Page(html)
        assert page.text == [b[2] for b in blocks] and page.links == [b[3] for b in blocks]
        assert [page.path_names(page.path[k]) for k in page.node] == ["/".join(b[0]) for b in blocks]
        sums = {}
        for path in {b[0] for b in blocks}:
            mine = [b for b in blocks if b[0] == path]
            sums["/".join(path)] = (len(mine), sum(len(b[2]) for b in mine), sum(c in ".,;" for b in mine for c in b[2]), sum(b[3] for b in mine))
        assert {page.path_names(p): x for p, x in page.path_sums().items()} == sums
        own = [sums["/".join(b[0])] for b in blocks]
        for k in reversed(range(len(blocks) - 1)):
            if blocks[k][0][-1] == "h2":
                own[k] = own[k + 1]

        def smooth(values):
            out = []
            for k, (_, parent, _, _) in enumerate(blocks):
                line = [i for i, b in enumerate(blocks) if b[1] == parent]
                near = [(math.exp(-((line.index(k) - j) ** 2) / 2), values[i]) for j, i in enumerate(line) if abs(line.index(k) - j) <= 2]
                out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
            return out

        fused = [c * (1 + p) ** 0.5 * (1 - x) ** 2 for c, p, x in zip(smooth([s[1] / s[0] for s in own]), smooth([s[2] / s[0] for s in own]), smooth([s[3] / s[1] for s in own]), strict=True)]
        assert page.ratios() == pytest.approx(fused)
        level = 0.5 * sum(f * len(b[2]) for f, b in zip(fused, blocks, strict=True)) / sum(len(b[2]) for b in blocks)
        mean = {p: sum(f for f, b in zip(fused, blocks, strict=True) if b[0] == p) / sum(b[0] == p for b in blocks) for p in {b[0] for b in blocks}}
        found = html_extract.content_paths(page, page.ratios(), [1.0] * len(blocks))
        assert {page.path_names(p) for p in found} == {"/".join(p) for p, x in mean.items() if x >= level - 1e-9}


def test_html_ratios_decide(monkeypatch, spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    texts = [html_extract.extract(p) for p in pages]
    as_divs = [p.replace("<article>", "<div>").replace("</article>", "</div>") for p in pages]
    assert [html_extract.extract(p) for p in as_divs] == texts
    monkeypatch.setattr(html_extract.Page, "ratios", lambda self, by_name=True: [1.0] * len(self.text))
    assert sum(html_extract.extract(p) != t for p, t in zip(pages, texts, strict=True)) > 0.9 * len(pages)


@pytest.mark.parametrize("page", ["<span>" * 200_000 + "x", "<div>a " * 50_000, "<span>" * 50_000 + "<p>a</p>" * 50_000, "<ul><li>a" * 30_000, "<svg/>" * 100_000])
def test_html_damaged_markup_is_linear(page):
    began = time.perf_counter()
    html_extract.extract(page)
    assert time.perf_counter() - began < 5
    if page.endswith("<span>x"):
        tracemalloc.start()
        html_extract.extract(page)
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
        tracemalloc.stop()


# 4 -------------------------------------------------------------------------


def brute_fingerprint(t):
    w = split(lowered(t))
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def groups(values, linked):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(values), 2):
        if linked(a, b):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {v: find(v) for v in values}


@pytest.mark.parametrize("limit", [1, 32])
def test_near_groups(docs, limit):
    fps = [(d[0], brute_fingerprint(d[1])) for d in corpus()]
    root = groups({f for _, f in fps}, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, f in fps:
        least.setdefault(root[f], []).append(i)
    expected = [(i, f, min((x for x in least[root[f]] if x is not None), default=None)) for i, f in fps]
    got = near_dedup.near_groups(docs, pair_limit=limit).collect()
    same([(r.doc_id, r.fp % (1 << 64), r.component_id) for r in got], expected)


@pytest.mark.parametrize("radius,limit", [(1, 1), (1, 32), (2, 1), (2, 4), (2, 32)])
def test_links_lose_none(spark, radius, limit):
    r = random.Random(radius)
    values = {0, (1 << 64) - 1}
    for _ in range(30):
        x = r.getrandbits(64)
        values |= {x} | {x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(6)}
    expected = groups(values, lambda a, b: (a ^ b).bit_count() <= radius)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = near_dedup.links(spark.createDataFrame([(signed(v),) for v in values], "fp long"), radius, limit)
    found = {r.node: r.root for r in components.components(links).collect()}
    classes = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert classes({v: found.get(signed(v), signed(v)) for v in values}) == classes(expected)


def test_masks_cover():
    for radius in (1, 2):
        tables = near_dedup.masks(radius)
        for bits in itertools.combinations(range(64), radius):
            assert any(all(not m >> b & 1 for b in bits) for m in tables)


def test_components_long_chain(spark):
    edges = [(k, k + 1) for k in range(300)] + [(5, 5), (1000, 1001), (1001, 1000), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(301)} | {1000: 1000, 1001: 1000}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_deduplicate(docs, none):
    got = near_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    rows = corpus()
    root = groups({brute_fingerprint(d[1]) for d in rows}, lambda a, b: (a ^ b).bit_count() <= 2)
    assert sorted(root[brute_fingerprint(r.text)] for r in got.collect()) == sorted(set(root.values()))
    assert near_dedup.deduplicate(none).count() == 0


# 5 -------------------------------------------------------------------------


def test_katz(spark):
    rows = [(d[0], d[1], (d[0] or 0) % 4 != 1) for d in corpus()]
    toks = [split(lowered(t)) + ["\n"] for _, t, _ in rows]
    for order in (1, 2, 3):
        model = katz.KatzModel(order=order, batch_tokens=500, part_entries=300)
        k = katz.Katz(spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(2), model)
        counts = [collections.Counter() for _ in range(order + 1)]
        for ws, (_, _, train) in zip(toks, rows, strict=True):
            for m in range(1, order + 1):
                line = ["\t"] * (m - 1) + ws
                if train:
                    counts[m].update(tuple(line[i : i + m]) for i in range(len(ws)))
        ds = [None] + [katz.discounts([collections.Counter(c.values())[r] for r in range(1, katz.K + 2)]) for c in counts[1:]]
        cut = lambda r, m: r * (ds[m][r] if r <= katz.K else 1)
        n, v = sum(counts[1].values()), len(counts[1])
        unseen = 1 - sum(cut(r, 1) for r in counts[1].values()) / n
        after = [collections.defaultdict(list) for _ in range(order + 1)]
        for m in range(2, order + 1):
            for g, r in counts[m].items():
                after[m][g[:-1]].append((g, r))

        def weights(h, m):
            total = sum(r for _, r in after[m][h])
            left = total - sum(cut(r, m) for _, r in after[m][h])
            total, left = (total, left) if left > 1e-9 else (total + 1, 1)
            return total, left / total / max(unseen, 1 - sum(p(g[1:]) for g, _ in after[m][h]))

        cache = {}

        def p(g):
            m = len(g)
            if m == 1:
                return cut(counts[1][g], 1) / n if g in counts[1] else unseen
            if g not in cache:
                h = g[:-1]
                if h in after[m]:
                    total, backoff = weights(h, m)
                    cache[g] = cut(counts[m][g], m) / total if g in counts[m] else backoff * p(g[1:])
                else:
                    cache[g] = p(g[1:])
            return cache[g]

        got = sorted(k.scores().collect(), key=key)
        expected = []
        for ws, (i, _, train) in zip(toks, rows, strict=True):
            line = ["\t"] * (order - 1) + ws
            score = sum(math.log10(p(tuple(line[x : x + order]))) for x in range(len(ws)))
            base = sum(math.log10((counts[1][(w,)] + 1) / (n + v + 1)) for w in ws)
            expected.append((i, not train, len(ws), sum((w,) in counts[1] for w in ws), n, base, score))
        for a, b in zip(got, sorted(expected, key=key), strict=True):
            assert tuple(a)[:5] == b[:5] and tuple(a)[5:] == pytest.approx(b[5:], rel=1e-9)
        words = [w for (w,) in counts[1]]
        for h in list(after[order])[:5] if order > 1 else []:
            rest = weights(h, order)[1] * (unseen if order == 2 else p((h[-1], "never")))
            assert sum(p((*h, w)) for w in words) + rest == pytest.approx(1)


@pytest.mark.parametrize("order", [2, 3])
def test_katz_tables_sum_to_one(spark, order):
    rows = [(d[0], d[1], True) for d in corpus() if len(d[1] or "") < 5000]
    k = katz.Katz(spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(3), katz.KatzModel(order=order, batch_tokens=400, part_entries=150))

    def table(number, kind):
        out = {}
        for r in k.tables[number].where("batch = -1").collect():
            out |= dict(zip(katz.unpack_sorted(bytes(r.first)).tolist(), katz.unpack(bytes(r.second), kind).tolist(), strict=True))
        return out

    counts = {m: table(2 * m, np.int64) for m in range(1, order + 1)}
    weights = {m: table(2 * m + 1, np.float64) for m in range(2, order + 1)}
    mixed = lambda a, b: int(katz.mix(np.array([a], np.uint64), np.array([b], np.uint64))[0])
    words = sorted(counts[1])
    single = dict(zip(words, k.evaluator.single(np.array([counts[1][w] for w in words])).tolist(), strict=True))
    unseen = float(k.evaluator.single(np.zeros(1, np.int64))[0])
    assert sum(single.values()) + unseen == pytest.approx(1, abs=1e-12)
    for h, backoff in weights[2].items():
        seen = {w: counts[2][g] for w in words if (g := mixed(h, w)) in counts[2]}
        d, total = k.evaluator.ratios(2), sum(seen.values())
        cut = {w: float(katz.discounted(np.array([r]), d)[0]) for w, r in seen.items()}
        total += sum(cut.values()) >= total  # nothing discounted: one is kept for what is unseen
        p = sum(cut[w] / total if w in seen else backoff * single[w] for w in words) + backoff * unseen
        assert p == pytest.approx(1, abs=1e-12)
    assert len(weights[2]) > 5 and (order == 2 or len(weights[3]) > 50)


def test_katz_rows_that_move(spark):
    """Twice the batches and partitions of the same texts: no more rows than n-grams, or than pairs."""
    rows = [(d[0], d[1], True) for d in corpus() if d[1]]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(3).cache()
    for tokens, entries in ((800, 400), (400, 200), (30, 20)):
        k = katz.Katz(df, katz.KatzModel(order=2, batch_tokens=tokens, part_entries=entries))
        moved = k.tables[4].where("batch >= 0").count()
        assert moved <= min(k.n_batches * k.parts, sum(r.tokens for r in k.batches.collect()))


def test_katz_packed_arrays():
    a = np.sort(np.random.default_rng(1).integers(0, 1 << 56, 5000).astype(np.uint64))
    assert (katz.unpack_sorted(katz.pack_sorted(a)) == a).all()
    assert sum((s.stop - s.start) for _, s in katz.slices(a, 7)) == len(a)
    assert list(katz.slices(a[:0], 3)) == []


def test_katz_no_rows(spark):
    assert katz.Katz(spark.createDataFrame([], "doc_id long, text string, train boolean")).scores().count() == 0
    only = katz.Katz(spark.createDataFrame([(1, "a b", False)], "doc_id long, text string, train boolean")).scores().first()
    assert (only.n_known, only.train_tokens, only.score) == (0, 0, pytest.approx(0))


# 6 -------------------------------------------------------------------------


def test_quality_rules(docs, none):
    def brute(t):
        t = t or ""
        w = split(t)
        lines = [x for x in t.split("\n") if split(x)]
        n = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)

    cols = ["q_n_words", "q_word_chars", "q_n_symbols", "q_n_dup_lines", "q_n_repeat_words"]
    got = quality_rules.with_quality(docs)
    same(got.select("doc_id", *cols).collect(), [(d[0], *brute(d[1])) for d in corpus()])
    assert set(docs.columns) <= set(got.columns)
    kept = got.where("q_kept").select("doc_id", "q_failed").collect()
    assert kept and all(not r.q_failed for r in kept)
    assert quality_rules.with_quality(none).count() == 0


# 7 -------------------------------------------------------------------------


def check_packing(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return by


def test_packing(docs, none):
    from tokenizers import Tokenizer
    import public_tokenizers

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(packing.pieces(docs, 256), 256, window=16).collect()
    by = check_packing(rows, 256)
    expected = []
    for d in corpus():
        ids = np.array([*full.encode(d[1] or "", add_special_tokens=False).ids, 1], "<u4")
        expected += [(d[0], k, min(256, len(ids) - k), zlib.crc32(ids[k : k + 256].tobytes()), len(ids)) for k in range(0, len(ids), 256)]
    same([tuple(r)[:5] for r in rows], expected)
    assert len(by) <= 2 + sum(r.length for r in rows) / 256 * 1.1
    assert packing.pack(packing.pieces(none)).count() == 0
    assert sorted(map(tuple, rows), key=key) == sorted(map(tuple, packing.pack(packing.pieces(docs, 256), 256, window=16).collect()), key=key)


def test_tokenizers_agree():
    from tokenizers import Tokenizer
    import public_tokenizers

    full, r = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(3)
    plain = [chr(c) for c in (9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x250))]
    for _ in range(1500):
        t = "".join(r.choice(plain) if r.random() < 0.5 else r.choice(" \n\t'stre1") for _ in range(r.randint(0, 60)))
        assert packing.token_ids(t).tolist() == [*full.encode(t, add_special_tokens=False).ids, 1], repr(t)
    for t in ("<|endoftext|> x", "日本 x", "\x85  y", None):
        assert packing.token_ids(t).tolist() == [*full.encode(t or "", add_special_tokens=False).ids, 1]


def test_tokenizers_agree_on_documents(spark):
    """Every document of a table, and runs just below and above where the full tokenizer takes over."""
    from tokenizers import Tokenizer
    import public_tokenizers

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for n in (packing.LONG_RUN - 1, packing.LONG_RUN, packing.LONG_RUN + 1):
        texts += [f"a{c * n}b {c * n}\n{c * n}" for c in (" ", "\n", "\t", "x", "é", "0", "-", " \n", "ab1")]
    for t in texts:
        assert packing.token_ids(t).tolist() == [*full.encode(t, add_special_tokens=False).ids, 1], repr(t[:80])
    assert sum(packing._plain(t) for t in texts) > len(texts) // 2


def test_equal_pieces_are_packed_alike(spark):
    rows = [(None, "one text", 0)] * 500 + [(k, "other " * (k % 9), 0) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, copies int")
    runs = [sorted(map(tuple, packing.pack(packing.pieces(df.repartition(n)), per_task=100).collect()), key=key) for n in (1, 4)]
    assert len(runs[0]) == 700 and runs[0] == runs[1]


def test_best_fill_is_best():
    r = random.Random(5)
    for _ in range(200):
        lengths = [r.randint(1, 30) for _ in range(r.randint(1, 9))]
        chosen = packing.best_fill(collections.Counter(lengths), 40)
        best = max(s for k in range(len(lengths) + 1) for c in itertools.combinations(lengths, k) if (s := sum(c)) <= 40)
        assert sum(k * n for k, n in chosen.items()) == best
        assert all(n <= lengths.count(k) for k, n in chosen.items())


# 8 -------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://x/a b\n", "<p>one</p>", 0), (2, None, "<p>one</p>", 0), (3, "u", "", 0), (4, "u", None, 0), (None, "é", "<p>one</p>", 0), (1, "http://x/a b\n", "<p>one</p>", 0), (5, "u", "é" * 100_000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    packages = warc.write_packages(warc.with_revisits(pages), str(tmp_path / "out"), roll_bytes=500)
    assert packages.count() > 1
    got = warc.read_packages(packages, str(tmp_path / "out")).collect()
    expected = []
    for i, _, h, _ in rows:
        b = (h or "").encode()
        first = min(x[0] for x in rows if (x[2] or "") == (h or "") and x[0] is not None)
        response = i == first
        expected.append((i, "response" if response else "revisit", warc.digest_of(b), len(b), None if response else first, b if response else None))
    same([(r.page_id, r.record_type, r.payload_digest, r.payload_bytes, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got], expected)
    for row in packages.collect():  # a common ZIP reader and gzip see the same records
        with zipfile.ZipFile(row.path) as z:
            assert z.testzip() is None
            assert gzip.decompress(z.read(warc.DATA)).count(b"WARC/1.1\r\n") == row.records
    assert {r.record_type for r in warc.read_packages(warc.write_packages(warc.with_revisits(pages, least=10**9), str(tmp_path / "all")), str(tmp_path / "all")).collect()} == {"response"}
    empty = warc.write_packages(warc.with_revisits(pages.limit(0)), str(tmp_path / "none"))
    assert warc.read_packages(empty, str(tmp_path / "none")).count() == 0


class Memory:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, offset):
        return self.data[offset : offset + n]


def test_zip_ranges(monkeypatch):
    def made(comment=b""):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("a", b"0123456789")
            z.writestr(zipfile.ZipInfo("dir/é"), b"PK\x05\x06" * 10)
            z.writestr("packed", b"x" * 100, zipfile.ZIP_DEFLATED)
            z.comment = comment
        return ZipRanges(Memory(out.getvalue()))

    for z in (made(), made(b"PK\x05\x06 in a comment")):
        assert z.read("a", 3, 4) == b"3456" and z.read("dir/é") == b"PK\x05\x06" * 10
        with pytest.raises(ValueError):
            z.read("packed")
        with pytest.raises(ValueError):
            z.read("a", 5, 6)
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 5)  # every size and offset goes to ZIP64 fields
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    z = made()
    assert z.read("a", 3, 4) == b"3456" and z.read("dir/é", 36) == b"PK\x05\x06"
    with pytest.raises(ValueError):
        ZipRanges(Memory(b"no package"))


# 9 -------------------------------------------------------------------------


def targets(sizes, weights=(3, 1, 2), budget=1.5, cap=2):
    """Words for each source, by sharing out again whatever a full source leaves."""
    out, left, todo = [0.0] * len(sizes), budget * sum(sizes), [i for i, n in enumerate(sizes) if n]
    while todo:
        each = left / sum(weights[i % 3] for i in todo)
        full = [i for i in todo if each * weights[i % 3] > cap * sizes[i]]
        if not full:
            for i in todo:
                out[i] = each * weights[i % 3]
            break
        for i in full:
            out[i] = cap * sizes[i]
            left -= out[i]
        todo = [i for i in todo if i not in full]
    return out


def check_mix(spark, rows, mix, tolerance=0.02):
    """``rows`` of (doc_id, text, source); the result."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.taken_words(df, mix).collect()
    same([(r.doc_id, r.size) for r in got], [(d[0], len(split(d[1] or ""))) for d in rows])
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(split(t or ""))
    sources = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    want = dict(zip(sources, targets([sizes[s] for s in sources]), strict=True))
    by_doc = collections.defaultdict(list)
    for i, t, s in rows:
        by_doc[i, len(split(t or ""))].append(s)
    taken = collections.Counter()
    for r in got:
        near = [s for s in by_doc[r.doc_id, r.size] if (sizes[s], want[s]) == (r.source_size, pytest.approx(r.target))]
        assert near
        taken[near[0]] += r.taken
    for s in sources:
        assert abs(taken[s] - want[s]) <= max(tolerance * want[s], 1 + sizes[s] / mix.least_blocks), s
    return got


def test_targets(spark):
    rows = [(k, "w " * n, s) for k, (n, s) in enumerate([(100, "a"), (10, "b"), (0, "c"), (50, "d")])]
    got = {r.doc_id: r.target for r in mixing.taken_words(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    # 240 words at weights 3, 1, 3 (the third has none): the second and fourth sources are full
    assert got == {0: pytest.approx(120), 1: 20, 2: 0, 3: 100}


def test_taken_words(spark, docs, none):
    mix = mixing.Mix(block_words=4, shard_slots=64, docs_per_bucket=8, chunk=3)
    got = check_mix(spark, [(d[0], d[1], d[2]) for d in corpus()], mix)
    same(got, mixing.taken_words(docs, mix).collect())
    same(got, mixing.taken_words(docs.repartition(5), mix).collect())
    assert mixing.taken_words(none, mix).count() == 0
    odd = docs.select("doc_id", "text", "source", F.lit(1).alias("TEXT2"), F.lit(2).alias("a.b"), F.lit(3).alias("skey"))
    same(got, mixing.taken_words(odd, mix).collect())


def test_mixing_a_hot_source_and_many_small_ones(spark):
    r = random.Random(3)
    rows = [(k, " ".join(["w"] * r.randrange(60)), "hot") for k in range(3000)]
    rows += [(3000 + k, " ".join(["w"] * r.randrange(1, 8)), f"s{k % 5000:05}") for k in range(6000)]
    rows += [(9000, "one row that many repeat", "twice")] * 2000
    got = check_mix(spark, rows, mixing.Mix(broadcast_sources=10, chunk=50, docs_per_bucket=16, shard_slots=128))
    repeated = [x.taken for x in got if x.doc_id == 9000]
    assert len(repeated) == 2000 and max(repeated) > 0


def test_slots_are_permutations(spark):
    rows = [(k, " ".join(["w"] * 97), "ab"[k % 2], *[None] * 6) for k in range(40)]
    m = mixing.Mixer(spark.createDataFrame(rows, DOC), mixing.Mix(block_words=7, shard_slots=32))
    about = {r.s: r for r in m.sources.collect()}
    slots = m.slots().collect()
    seen = collections.Counter((r.s, r["pass"], r.block) for r in slots)
    assert max(seen.values()) == 1 and all(0 <= b < about[s].blocks for s, _, b in seen)
    first = collections.Counter(s for s, p, _ in seen if p == 0)
    assert all(first[s] == about[s].blocks for s in first if any(x == s and p == 1 for x, p, _ in seen))
    assert collections.Counter(r.s for r in slots) == {s: r.n for s, r in about.items() if r.n}
    # shards are full but for the last, and each draws its sources: counts vary, and sum to the targets
    shards = collections.Counter(r.shard for r in slots)
    assert sorted(shards.values())[1:] == [32] * (len(shards) - 1)
    drawn = {(r.shard, r.s): r.n for r in m.shards().collect()}
    assert drawn == collections.Counter((r.shard, r.s) for r in slots)
    counts = [drawn.get((k, 0), 0) for k in range(len(shards) - 1)]
    share = about[0].n / m.slots_total
    spread = sum((x - 32 * share) ** 2 for x in counts) / len(counts)
    assert len(set(counts)) > 3 and 0.3 < spread / (32 * share * (1 - share)) < 2.5


def test_permuted_is_a_permutation(spark):
    for n in (1, 2, 7, 64, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), 5, F.lit("k")).alias("y")).collect()
        assert sorted(r.y for r in got) == list(range(n))


def test_mixed_documents(docs):
    mix = mixing.Mix(block_words=4, shard_slots=64, docs_per_bucket=8)
    taken = sum(r.taken for r in mixing.taken_words(docs, mix).collect())
    got = mixing.mixed_documents(docs, mix)
    assert got.columns == docs.columns
    rows = got.collect()
    assert sum(len(split(r.text)) for r in rows) == taken
    texts = [d[1] for d in corpus() if d[1]]
    assert all(r.n_chars == len(r.text) for r in rows)
    assert any(r.text in texts for r in rows)


def test_mixed_documents_nulls_apart(spark):
    rows = [(5, None, "a b c d", *[None] * 6), (5, "a b c d", None, *[None] * 6)]
    mix = mixing.Mix(block_words=2, shard_slots=4)
    df = spark.createDataFrame(rows, DOC)
    taken = sum(r.taken for r in mixing.taken_words(df, mix).collect())
    got = [r.text for r in mixing.mixed_documents(df, mix).collect()]
    assert taken and None not in got and sum(len(t.split()) for t in got) == taken


# 10 ------------------------------------------------------------------------


def test_top_k(spark):
    r = np.random.default_rng(2)
    rows = [(int(k), [float(x) for x in r.normal(size=4)]) for k in range(200)]
    rows += [(300 + k, [0.5, 0.5, 0.5, 0.5]) for k in range(80)]
    rows += [(500, None), (550, [1.0, None, 0.0, 0.0]), (600, [float("nan")] * 4), (650, [float("inf")] * 4), (None, [9.0] * 4), (700, [3.0]), (750, []), (0, [float(x) for x in r.normal(size=4)]), (800, [1e30, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ok = [(i, [math.floor(256 * x) for x in e] + [0] * (4 - len(e))) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    limit = (1 << 63) - 1
    expected = []
    for i, q in ok:
        if i % 50 == 0:
            scored = sorted((-max(-limit - 1, min(limit, sum(a * b for a, b in zip(q, v, strict=True)))), j) for j, v in ok if j != i)[:5]
            expected += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scored)]
    got = vector_search.top_k(df, F.col("vec_id") % 50 == 0, sample=50, pivots=5, block=16, rows_per_task=70, query_batch=3)
    same(got.collect(), expected)
    assert vector_search.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    one = vector_search.top_k(df.where("vec_id = 50"), F.col("vec_id") % 50 == 0)
    assert one.count() == 0


def test_top_k_skips_what_lies_apart(spark):
    r = np.random.default_rng(8)
    centres = r.normal(size=(40, 16)) * 3
    rows = [(k, (centres[k % 40] + r.normal(size=16) * 0.05).tolist()) for k in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    small = {"block": 64, "rows_per_task": 600, "pivots": 40}
    scored, read = vector_search.scored_share(df, F.col("vec_id") % 50 == 0, **small)
    assert scored < 0.2 and read < 0.5
    v = np.floor(256 * np.array([e for _, e in rows]))
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in vector_search.top_k(df, F.col("vec_id") % 50 == 0, **small).collect()}
    for q in range(0, 6000, 50):
        scores = v @ v[q]
        best = [i for i in np.lexsort((np.arange(6000), -scores)) if i != q][:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, int(scores[i])) for i in best]


def test_bounds_hold():
    r = np.random.default_rng(9)
    p, v, q = r.normal(size=(5, 8)) * 100, r.normal(size=(300, 8)) * 100, r.normal(size=(50, 8)) * 100
    d, norm = vector_search._distances(q, p), (q * q).sum(1)
    block = vector_search.Block(np.arange(300), v, p)
    assert (block.ranges.bound(d, d, norm) >= (q @ v.T).max(1)).all()
    group = vector_search.Ranges.of(q, p)
    assert block.ranges.bound(group.near[None], group.far[None], np.array([group.norm]))[0] >= (q @ v.T).max()


# queries -------------------------------------------------------------------


def test_registry_and_pipeline(spark):
    import __spark_entry__ as entry
    import corpus_pipeline

    found = entry.queries()
    assert [k for k in found if k.startswith("op")] == [k for k in found if re.match(r"op\d+_", k)] and "pipeline" in found
    sf = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, sf).collect()
    check_packing(rows, packing.CAPACITY)
    for r in rows:
        assert r.start % packing.CAPACITY == 0


def test_planted_conversation(spark):
    got = {r.conv_id: r for r in chat_format.op2_chat_format(spark, "/root/testdata/sf0.001").collect()}
    text = "</s>[INST] ok [/INST]"
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert got[-7].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_main_text_of_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    for r in html_extract.op3_html_extract(spark, "/root/testdata/sf0.001").collect():
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h\d|div|li|ul)\b[^>]*>", body))
        assert r.text == "\n".join(x for x in parts if x)
