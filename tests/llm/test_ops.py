"""Each operator against a plain version, and its defined results for nulls, empty texts, ties, repeats and empty tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from kithspark import scratch  # noqa: E402
from kithspark.llm import chat_format, components, decontaminate, fingerprint, html_extract, jaccard_join, language_id, license_scan, line_dedup, packing, token_counts  # noqa: E402
from kithspark.llm.components import connected_components  # noqa: E402

DOCS = "doc_id bigint, text string"
WORDS = "the of and to in is on that by it anea thand erin lyst ation wh".split()


def docs(spark, texts, extra=False):
    rows = [(i, t, "clash", -1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS + ", n_words string, n_chars bigint")
    return df if extra else df.drop("n_words", "n_chars")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice(WORDS) if rng.random() < 0.7 else "") for _ in range(n))


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


ODD = [None, "", " ", "\n\n", ".", "a", "x" * 50_000, "word " * 20_000, "Ünïcode ß 日本語   x", "same", "same"]


# 1 -------------------------------------------------------------------------------------------------------------------
def brute_hits(text, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        size = min(n, len(v))
        windows = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
        for i in range(len(w) - size + 1 if size else 0):
            if tuple(w[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found.add(item)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(str(x) for x in found if x is not None)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [2_000_000, 7])
def test_decontaminate(spark, block):
    rng = random.Random(1)
    items = [(i, prose(rng, rng.choice([3, 9, 10, 25]))) for i in range(8)] + [(8, None), (9, ""), (10, "Short One"), (11, "Short One"), (11, "Short One"), (None, "by no name")]
    texts = [prose(rng, 40) for _ in range(10)]
    texts += [f"{prose(rng, 5)}. {items[i][1].upper()}! {prose(rng, 5)}" for i in range(8)] + ["x by no-name y", " ".join(items[3][1].split()[4:19]), "a short-one b"]
    df = docs(spark, texts + ODD, extra=True)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = by_id(decontaminate.scan(df, bench, max_windows=block))
    for i, t in enumerate(texts + ODD):
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == brute_hits(t, items), t
    assert got[0]["n_chars"] == -1
    kept = decontaminate.decontaminate(df, bench, max_windows=block)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, t in enumerate(texts + ODD) if not brute_hits(t, items)[4]}
    cleaned = by_id(decontaminate.decontaminate(df, bench, "spans", max_windows=block))
    assert all(brute_hits(cleaned[i]["text"], items)[1] == 0 or brute_hits(t, items)[1] for i, t in enumerate(texts + ODD))
    assert cleaned[len(texts) - 1]["text"] == "a  b" and cleaned[0]["text"] == texts[0] and cleaned[len(texts)]["text"] is None
    assert decontaminate.scan(df, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.scan(df.limit(0), bench).count() == 0


# 2 -------------------------------------------------------------------------------------------------------------------
def test_fingerprint(spark):
    rng = random.Random(2)
    texts = [prose(rng, rng.choice([1, 4, 30, 300])) for _ in range(40)] + [None, "", "same words here", "same words here", "é" * 9]
    ids = rng.sample(range(1000), len(texts) - 2) + [None, 7]
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts, strict=True)], DOCS + ", fingerprint string")
    order = sorted(zip(ids, texts, strict=True), key=lambda x: (-1 if x[0] is None else x[0], xxhash.xxh64_intdigest((x[1] or "").encode(), 42)))
    want = {}
    for (i, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        t, q = t or "", len(t or "") // 4
        edited = t[: len(t) - q] + (following or "")[:q]
        want.setdefault(i, []).append((len(t), hashlib.sha256(edited.encode()).hexdigest()))
    for parts in (1, 7):
        got = {}
        rows = fingerprint.fingerprint_edits(df, parts=parts).collect()
        for r in rows:
            got.setdefault(r["doc_id"], []).append((r["n_chars"], r["edited_sha256"]))
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        unique = [i for i in want if len(want[i]) == 1]
        assert {i: got[i] for i in unique} == {i: want[i] for i in unique} and len(rows) == len(texts)
    same = fingerprint.fingerprint(docs(spark, ["a b c d e f", "A, b c d e f.", "a b c d e g"])).orderBy("doc_id").collect()
    assert same[0][1] == same[1][1] != same[2][1]
    lone = fingerprint.fingerprint_edits(docs(spark, ["a b c d e f g h"])).first()
    assert lone["near_next"] == 1
    assert fingerprint.fingerprint_edits(docs(spark, ["a"]).limit(0)).count() == 0


def test_sketch_estimates():
    rng = random.Random(3)
    big, k = [f"w{rng.randrange(10**6)}" for _ in range(20_000)], 5
    small = big[5000:9000]
    a, b = (fingerprint.Sketch.of(" ".join(x).encode(), 0.125, k) for x in (big, small))
    assert b.containment(a) == 1 and abs(a.containment(b) - 0.2) < 0.03 and abs(a.likeness(b) - 0.2) < 0.03
    assert a.merge(b).likeness(a) == 1 and str(fingerprint.Sketch.read(str(a))) == str(a)
    assert len(base64.urlsafe_b64decode(str(a).split(":")[2])) == 6 * len(a.kept)
    merged = fingerprint.Sketch.of(" ".join(big[:30]).encode(), 0.125, k).merge(a)
    assert merged.bound == a.bound and len(merged.kept) >= len(a.kept)
    assert fingerprint.Sketch.of(b"", 0.1, k).likeness(fingerprint.Sketch.of(b"", 0.1, k)) == 1 and fingerprint.Sketch.of(b"", 0.1, k).likeness(a) == 0


def jaccard_of_shingles(a, b, k=5):
    sets = []
    for t in (a, b):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def test_likeness_against_brute_force(spark):
    """Exact where both texts have at most LEAST shingles; an estimate of the true similarity beyond, by size."""
    import os

    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables")
    texts = [r["text"] or "" for r in spark.read.parquet(path).orderBy("doc_id").collect()]
    rows = fingerprint.fingerprint_edits(spark.read.parquet(path)).orderBy("doc_id").collect()
    off = {"few": [], "many": []}
    for i, r in enumerate(rows):
        t, following = texts[i], texts[(i + 1) % len(texts)]
        q = len(t) // 4
        for other, got in ((t[: len(t) - q] + following[:q], r["near_edited"]), (following, r["near_next"])):
            off["few" if max(len(t.split()), len(other.split())) <= fingerprint.LEAST else "many"].append(abs(got - jaccard_of_shingles(t, other)))
    assert max(off["few"]) < 1e-9 and np.mean(off["many"]) < 0.03 and max(off["many"]) < 0.3


def test_fingerprint_ids_of_any_type(spark):
    texts = ["a b c d e f g h", "b", None, "c d", "c d", ""]
    ids = ["x", "k10", None, "k9", None, "k9"]
    for cast in ("string", "date", "decimal(20,0)"):
        own = ids if cast == "string" else [None if i is None else {"x": "9", "k10": "1", "k9": "2"}[i] for i in ids]
        own = own if cast != "date" else [i and f"2020-01-0{i}" for i in own]
        df = spark.createDataFrame(list(zip(own, texts, strict=True)), "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(cast))
        got = fingerprint.fingerprint_edits(df, parts=3)
        assert got.schema["doc_id"].dataType == df.schema["doc_id"].dataType and got.count() == len(ids)
        r = got.filter("n_chars = 8 * 2 - 1").first()  # the last one: the first, a null id, comes after it
        first = min((xxhash.xxh64_intdigest(b"c d", 42) ^ 1 << 63, "c d"), (42 ^ 1 << 63, ""))[1]
        assert r["edited_sha256"] == hashlib.sha256((texts[0][:-3] + first[:3]).encode()).hexdigest()


def test_a_worker_holds_one_operators_cache():
    from kithspark.llm.common import WordHashes, hold

    a, b = WordHashes(), WordHashes()
    hold(a).of([b"x", b"y"])
    assert len(hold(a)) == 2 and hold(b) is b and not a


# 3 -------------------------------------------------------------------------------------------------------------------
PARAS = ["The first paragraph is about a thing of some length, so that its density is high.", "The second one says more & more about the same thing, with a link inside.", "Short."]
PAGES = {
    "plain": (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=/>Home</a><a href=/b>Blog</a></nav><article><h1>Head</h1><p>{PARAS[0]}</p><p>{PARAS[1].replace('&', '&amp;').replace('link', '<a href=x>link</a>')}</p><p>{PARAS[2]}</article><footer>&copy; me</footer>", ["Head", *PARAS]),
    "divs": (f"<body><div id=top class='site-header'><a href=/>x</a></div><div class='content has-sidebar'><h2>Head</h2><div>{PARAS[0]}</div><div>{PARAS[1].replace('&', '&amp;')}</div><p>{PARAS[2]}</p></div><div class=sidebar><ul><li><a href=1>one</a><li><a href=2>two</a></ul></div><form><p>Sign up to our letter now and never miss a thing again</p><input></form>", ["Head", *PARAS]),
    "comments": (f"<body><main><h1>Head</h1><p>{PARAS[0]}<p>{PARAS[1].replace('&', '&#38;')}<section class='user-comments'><p>I liked this text a lot, thanks for writing it down for us all.</p></section></main><div class=cookie-banner>We use cookies for a better site. Accept them all now?</div><script>var a='<p>no</p>'</script>", ["Head", *PARAS[:2]]),
    "sections": (f"<body><article><header><h1>Head</h1></header><section><p>{PARAS[0]}</p></section><section><p>{PARAS[1].replace('&', '&amp;')}</p><aside>An aside about other things that one may read</aside></section></article>", ["Head", *PARAS[:2]]),
}


@pytest.mark.parametrize("name", PAGES)
def test_html(name):
    page, want = PAGES[name]
    assert html_extract.extract(page).split("\n\n") == want


def test_html_beside_an_article():
    story = [f"{k} " + "x" * 398 for k in range(10)]
    teaser = "<article><p>" + "y" * 250 + "</p></article>"
    page = f"<body><div>{''.join(f'<p>{x}</p>' for x in story)}</div>{teaser}{'<div></div>' * 30}</body>"
    got = html_extract.extract(page).split("\n\n")
    assert got[:10] == story
    assert got[10:] == ["y" * 250]  # as dense as the threshold asks, so content as well


def test_html_without_an_end():
    import time

    began = time.perf_counter()
    for page in ("<img " + " ".join(f'a{i}="x"' for i in range(10_000)), "<a " * 50_000, "<p x='" * 20_000, "<p " + "a" * 100_000 + ">x", "</script" * 20_000, "<!" * 50_000, '<a b="' * 20_000 + ">"):
        html_extract.extract(f"<body><p>{PARAS[0]}</p>{page}")
    assert time.perf_counter() - began < 5
    assert html_extract.extract(f"<p>{PARAS[0]}</p><img " + "a=b " * 10_000).startswith(PARAS[0])


@pytest.mark.parametrize("wrap", ["article", "div", "section", "td"])
@pytest.mark.parametrize("part", ["<section id='discussion'>{}</section>", "<section id=related-work class='social'>{}</section>", "<div class='social-studies'>{}</div>", "<div id=notices>{}</div>"])
def test_parts_of_an_article_stay(wrap, part):
    own = part.format(f"<h2>Part</h2><p>{3 * PARAS[0]}</p>")
    page = f"<body><nav><a href=1>Home page of it</a></nav><div class=ad>Buy this now.</div><{wrap}><h1>Head</h1><p>{PARAS[0]}</p>{own}<p>{PARAS[0]}</p></{wrap}><div class='related-posts'><a href=2>Other</a></div><footer>me</footer>"
    assert html_extract.extract(page).split("\n\n") == ["Head", PARAS[0], "Part", 3 * PARAS[0], PARAS[0]]


@pytest.mark.parametrize("kind", ["comments", "user-comments", "cookie-notice", "sidebar", "advertisement", "newsletter-form", "share", "related links"])
def test_named_boilerplate_goes(kind):
    page = f"<body><div><h1>Head</h1><p>{PARAS[0]}</p><p>{PARAS[0]}</p><div class='{kind}'><a href=1>one more</a> <p>text of it</p></div><p>{PARAS[0]}</p></div>"
    assert html_extract.extract(page).split("\n\n") == ["Head", *[PARAS[0]] * 3]


def test_html_table(spark):
    odd = [None, "", "   ", "plain text", "<p>x\n  y<br>z</p>", "<div>" * 3000 + "deep", "<p a='", "<b>a</i>b</b>", "<p>&lt;b&gt;&nbsp;&amp;amp;</p>", "<ul><li>a<li>b</ul>", "<p>q</p></p>"]
    df = spark.createDataFrame([(i, "u", p, "clash") for i, p in enumerate(odd)], "page_id bigint, url string, html string, text string")
    got = by_id(html_extract.extract_pages(df), "page_id")
    assert [got[i]["text"] for i in range(len(odd))] == ["", "", "", "plain text", "x y z", "deep", "<p a='", "ab", "<b> &amp;", "a\n\nb", "q"]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_extract.extract_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("change", ["", "article as div", "density alone"])
def test_html_of_the_tables(spark, monkeypatch, change):
    """The pages' own articles; with none of their tags and names that tell the article, and with none at all."""
    import html
    import os

    path = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables")
    rows = spark.read.parquet(path).collect()
    right = 0
    for r in rows:
        page = r["html"]
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]+>", "\n", b))).strip() for b in re.split(r"</?(?:p|h1|ul|li|div)[^>]*>", inner)]
        if change:
            page = re.sub(r"(</?)article>", r"\1div>", page)
        if change == "density alone":
            page = re.sub(r"(</?)(?:nav|footer)>", r"\1div>", page).replace(' class="ad"', "")
        right += html_extract.extract(page) == "\n\n".join(b for b in blocks if b)
    assert right == len(rows) if change != "density alone" else right >= 0.9 * len(rows)


# 4 -------------------------------------------------------------------------------------------------------------------
def all_runs(rows, min_run=120):
    """id -> text without later copies of runs of lines, by a search for every run at every earlier place."""
    lines = {i: re.split(r"(?<=\n)|(?<=[.!?] )", t or "") for i, t in rows}
    bare = {i: [x.strip(" \t\r\n") for x in ls] for i, ls in lines.items()}
    gone = {i: set() for i, _ in rows}
    earlier = {}
    for i in sorted(bare, key=lambda i: (i is not None, i)):
        a = bare[i]
        for k, x in enumerate(a):
            for j, p in earlier.setdefault(x, []):
                b, n = bare[j], 1
                while k + n < len(a) and p + n < len(b) and a[k + n] == b[p + n]:
                    n += 1
                if sum(len(x) + 1 for x in a[k : k + n]) >= min_run:
                    gone[i] |= set(range(k, k + n))
            earlier[x].append((i, k))
    return {i: None if t is None else "".join(x for k, x in enumerate(lines[i]) if k not in gone[i]) for i, t in rows}


def sentences(rng, n):
    return [prose(rng, rng.randint(1, 14)).capitalize() + rng.choice([". ", ".\n", "! ", "\n"]) for _ in range(n)]


def test_line_dedup(spark):
    rng = random.Random(4)
    shared = ["".join(sentences(rng, 8)) for _ in range(4)]
    texts = []
    for _ in range(60):
        parts = ["".join(sentences(rng, rng.randint(1, 6)))] + [rng.choice([*shared, prose(rng, 5) + " "]) for _ in range(rng.randint(0, 3))] + sentences(rng, 3)
        texts.append("".join(parts))
    texts += [texts[0], texts[0], texts[3] + texts[5], "x. " * 300, "The same line over and over again, to fill the page up to its end.\n" * 9, "a\x01b. c", *ODD]
    rows = list(enumerate(texts))
    df = docs(spark, texts, extra=True)
    got = by_id(line_dedup.dedup_lines(df, counts=True))
    want = all_runs(rows)
    assert {i: r["text"] for i, r in got.items()} == want
    assert want[60] == "" and got[0]["n_removed"] == 0 and line_dedup.dedup_lines(df).columns == df.columns
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    clash = line_dedup.dedup_lines(df.withColumns({"n_removed": F.lit("x"), "id": F.lit("y"), "runs": F.lit("z"), "gone": F.lit(0)}), counts=True)
    assert clash.columns == [*df.columns, "id", "runs", "gone", "n_removed"] and clash.filter("n_removed > 0").count() == sum(r["n_removed"] > 0 for r in got.values())
    again = line_dedup.dedup_lines(df.unionByName(df))
    assert {(r["doc_id"], r["text"]) for r in again.collect()} == set(want.items())


def test_line_dedup_plan_is_native(spark):
    df = docs(spark, ["a. b. " * 50, "c"])
    for part in (line_dedup.dedup_lines(df), line_dedup.repeated_runs(df)):
        assert not re.search("Python|Pandas|Arrow", part._jdf.queryExecution().toString())


def test_passages_go(spark):
    rng = random.Random(5)
    passage = " ".join(s.strip() for s in sentences(rng, 12)) + " "
    texts = [f"{prose(rng, 30)} {passage}{prose(rng, 30)}." for _ in range(12)]
    got = by_id(line_dedup.dedup_lines(docs(spark, texts)))
    words = passage.split()
    windows = {tuple(words[i : i + 40]) for i in range(len(words) - 39)}
    left = [i for i, r in got.items() if any(tuple(w[k : k + 40]) in windows for w in [r["text"].split()] for k in range(len(w)))]
    assert left == [0]


def in_hosts(rng, passages):
    """Each passage between other sentences of its own, joined to one line of text."""
    return [f"{prose(rng, 12)}. {p} {prose(rng, 12)}." for p in passages]


def check_runs(spark, texts):
    got = {i: r["text"] for i, r in by_id(line_dedup.dedup_lines(docs(spark, texts))).items()}
    assert got == all_runs(list(enumerate(texts)))
    return got


@pytest.mark.parametrize("sizes", [[60], [30, 30], [20, 20, 20], [8] * 7, [1, 40, 1]])
def test_every_repeated_run_goes(spark, sizes):
    rng = random.Random(6)
    passage = " ".join(prose(rng, n).capitalize() + "." for n in sizes)
    got = check_runs(spark, in_hosts(rng, [passage] * 20))
    assert [i for i, t in got.items() if passage in t] == [0]


def test_random_runs(spark):
    rng = random.Random(7)
    lines = [prose(rng, rng.choice([1, 1, 2, 5, 12, 40])) + rng.choice([". ", ".\n", "\n", "  \n", "\n\n"]) for _ in range(25)]
    texts = []
    for _ in range(60):
        at = rng.randrange(20)
        texts.append("".join(x for x in lines[at : at + rng.randint(1, 9)] + [prose(rng, 3) + "\n"] + rng.choices(lines, k=4)))
    check_runs(spark, [*texts, texts[3] + texts[5], *texts[:2], None, ""])


def test_sentences_that_stand_alone_before(spark):
    rng = random.Random(8)
    own = [prose(rng, 13).capitalize() + "." for _ in range(6)]
    passage = " ".join(own)
    texts = in_hosts(rng, own) + in_hosts(rng, [passage] * 4)
    got = check_runs(spark, texts)
    assert [i for i, t in got.items() if passage in t] == [6] and all(got[i] == texts[i] for i in range(6))


def test_runs_of_short_lines(spark):
    rng = random.Random(9)
    verse = "".join(f"{prose(rng, 2)[:10]}\n" for _ in range(30))
    texts = [f"{prose(rng, 12)}.\n{verse}{prose(rng, 12)}.\n" for _ in range(6)] + [verse, "}\n" * 200, "}\n" * 200]
    got = check_runs(spark, texts)
    assert [i for i, t in got.items() if verse in t] == [0] and got[6] == got[8] == "" and len(got[7]) < 240


# 5, 6 ----------------------------------------------------------------------------------------------------------------
TOKEN_TEXTS = ["a  b", "   a", "a   ", "▁▁x ▁", "<s> </s> <unk>", "<|endoftext|> x", "don't 's 'S", "x\x00y", "É́ a\x1cb", "Straße ẞ K"]


def fuzz(n):
    rng = random.Random(6)
    return ["".join(rng.choice(" ab'sST\n▁.é1É-") for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("entries", [token_counts.ENTRIES, 20, 0])
def test_token_counts(spark, entries):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = ODD + TOKEN_TEXTS + fuzz(500)
    got = by_id(token_counts.count_tokens(docs(spark, texts, extra=True), P.path("piece_bpe_32k.model"), entries=entries))
    for i, t in enumerate(texts):
        n = len(model.encode(t or ""))
        assert got[i][:] == (i, len((t or "").encode()), n, n > 4096), t
    twice = docs(spark, ["a b c"] * 3).withColumn("doc_id", F.lit(None).cast("string"))
    assert [r[1:3] for r in token_counts.count_tokens(twice, P.path("piece_bpe_32k.model"), entries=entries).collect()] == [(5, 3)] * 3
    assert token_counts.count_tokens(docs(spark, ["a"]).limit(0), P.path("piece_bpe_32k.model")).count() == 0
    table = {r["p"]: (r["n"], r["pieces"]) for r in token_counts.piece_table(docs(spark, ["a  bc a", "a", None]), P.path("piece_bpe_32k.model")).collect()}
    assert {p: n for p, (n, _) in table.items()} == {"a": 3, " bc": 1} and table["a"][1] == 1


@pytest.mark.parametrize("group", [packing.GROUP, 3])
def test_pack(spark, group):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rng = random.Random(7)
    texts = ODD + TOKEN_TEXTS + fuzz(300) + [prose(rng, rng.randint(1, 3000)) for _ in range(40)]
    rows = packing.pack(docs(spark, texts, extra=True), path, with_ids=True, group=group).collect()
    mine = {}
    for r in rows:
        mine.setdefault(r["doc_id"], {})[r["piece"]] = r
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        parts = [ids[k : k + 4096] for k in range(0, len(ids), 4096)]
        assert sorted(mine[i]) == list(range(len(parts)))
        for k, part in enumerate(parts):
            r = mine[i][k]
            assert (r["start"], r["length"], r["input_ids"]) == (4096 * k, len(part), part)
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 4096) + 1
    assert packing.pack(docs(spark, ["a"]).limit(0), path).count() == 0


@pytest.mark.parametrize("change", ["none", "normalizer", "model", "split", "special"])
def test_other_vocabularies(tmp_path, change):
    """Steps that the fast way doesn't follow are left to the library."""
    import json

    from tokenizers import Tokenizer

    spec = json.load(open(P.path("word_bpe_49k.json"), encoding="utf-8"))
    if change == "normalizer":
        spec["normalizer"] = {"type": "NFC"}
    elif change == "model":
        spec["model"]["ignore_merges"] = True
    elif change == "split":
        spec["pre_tokenizer"]["pretokenizers"][1]["use_regex"] = True
    elif change == "special":
        spec["added_tokens"][0]["content"] = "Two Words"
        spec["model"]["vocab"]["Two Words"] = spec["model"]["vocab"].pop("<|startoftext|>", 49406)
    path = str(tmp_path / "v.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    encoder, library = packing.WordEncoder(path), Tokenizer.from_file(path)
    assert encoder.by_word == (change == "none")
    for t in ["Some UPPER words, don't  stop 123", "a Two Words b", *TOKEN_TEXTS]:
        assert encoder.encode([t], b"")[0].tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = random.Random(seed)
    cap = rng.choice([10, 64, 4096])
    top = rng.choice([cap // 3, cap])
    counts = Counter(rng.randint(1, max(1, top)) for _ in range(rng.choice([0, 1, 50, 5000])))
    slots, n = packing.plan(dict(counts), cap)
    fill, seen, large = np.zeros(n, np.int64), Counter(), Counter()
    for length, _, k, first, offset in slots[np.argsort(slots[:, 4], kind="stable")].tolist():
        assert (fill[first : first + k] == offset).all()
        fill[first : first + k] += length
        seen[length] += k
        if 3 * length > cap:
            large.update(range(first, first + k))
    assert seen == counts and (not n or fill.max() <= cap and fill.min() > 0) and max(large.values(), default=0) <= 2
    least = -(-sum(a * b for a, b in counts.items()) // cap)
    assert least <= n <= 11 / 9 * max(least, sum(c for a, c in counts.items() if 2 * a > cap)) + 1


# 7 -------------------------------------------------------------------------------------------------------------------
def test_language_id(spark):
    import os

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables")
    df = spark.read.parquet(path)
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language_id.fit(df.filter(~out))
    got = language_id.identify(df, model).filter(out)
    assert got.filter("lang_pred = lang").count() / got.count() > 0.98
    odd = by_id(language_id.identify(docs(spark, [*ODD, "123 !?", "²"], extra=True).withColumn("score", F.lit("x")), model))
    assert [odd[i]["lang_pred"] for i in (0, 1, 2, 3, 4, len(ODD), len(ODD) + 1)] == ["und"] * 7 and odd[0]["score"] == 0
    assert all(r["lang_pred"] != "und" and 0 <= r["score"] <= 1 for i, r in odd.items() if 5 <= i < len(ODD))
    assert language_id.fit(df.limit(0)) is None and language_id.identify(docs(spark, ["a"]), None).first()["lang_pred"] == "und"
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(df, max_languages=2)


def test_folded_weights_are_the_kernel_machine(monkeypatch):
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 1 << language_id.BITS, 300) % (5000 if i % 2 else 9000)) for i in range(40)]
    model = language_id.fit_rows(rows, ["a" if i % 2 else "b" for i in range(40)], 10, 0.5)
    order = [x for i in range(5) for x in (39 - 2 * i, 38 - 2 * i)]  # languages take turns from the end
    k = lambda x, y: len(np.intersect1d(x, y)) / np.sqrt(len(x) * len(y))
    kernel = np.array([[k(x, rows[o]) for o in order] for x in rows])
    values, vectors = np.linalg.eigh(kernel[order])
    phi = np.hstack([kernel @ (vectors / np.sqrt(values)), np.ones((40, 1))])
    y = np.array([[i % 2, 1 - i % 2] for i in range(40)], float)
    want = phi @ np.linalg.solve(phi.T @ phi + 0.5 * np.eye(phi.shape[1]), phi.T @ y)
    assert np.allclose(model.score(rows), want, atol=1e-3)
    each = np.array([model.score([x])[0] for x in rows])
    for size in (1, 5000, 10**9):  # one row a step, a few, all
        monkeypatch.setattr(language_id, "BLOCK_BYTES", size)
        assert np.allclose(model.score([*rows, rows[0][:0]])[:-1], each, atol=1e-5)
    assert np.allclose(model.score([rows[0][:0]]), model.intercepts) and model.score([]).shape == (0, 2)


def test_more_languages_than_landmarks(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choices([f"{c}{x}" for x in "abcdefg"], k=30)), f"l{ord(c)}") for i, c in enumerate("qwertyuiop" * 12)]
    df = spark.createDataFrame([(i, t, lang) for i, t, lang in rows], "doc_id bigint, text string, lang string")
    model = language_id.fit(df, landmarks=3, max_sample=60)
    assert language_id.identify(df, model).filter("lang_pred = lang").count() == len(rows)


# 8 -------------------------------------------------------------------------------------------------------------------
def test_chat(spark):
    rows = [
        (0, 0, "system", "s"), (0, 1, "user", "q"), (0, 2, "assistant", "good <|im_end|>"), (1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "bad"), (1, 3, "user", None),
        (2, 0, "user", "x"), (3, 0, "user", "x"), (4, 0, "user", "lone"), (6, 0, None, None), (7, 5, None, "y"), (None, 0, "user", "n"),
        (8, 0, "user", "t"), (8, 0, "assistant", "t"), (9, 0, "assistant", "t"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, pair string")
    turns = chat_format.turns_of(df.filter("conv_id is not null"), F.floor(F.col("conv_id") / 2).cast("bigint"))
    got = by_id(chat_format.format_preferences(turns.filter("conv % 2 = 0"), turns.filter("conv % 2 = 1")), "pair")
    assert sorted(got) == [0, 1, 3, 4]
    r = got[0]
    assert r["n_prompt_turns"] == 2 and r["prompt"] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nq<|im_end|>\n"
    lo, hi = map(int, r["chosen_spans"].split("-"))
    assert r["chosen"][lo:hi] == "good < |im_end|><|im_end|>"
    lo, hi = map(int, r["rejected_spans"].split("-"))
    assert r["rejected"][lo:hi] == "bad<|im_end|>" and r["rejected"].endswith("<|im_start|>user\n<|im_end|>\n")
    assert (got[1]["chosen"], got[1]["rejected"], got[1]["n_prompt_turns"]) == ("", "", 1)
    assert got[3]["n_prompt_turns"] == 0 and got[3]["chosen_spans"] == ""
    assert got[4]["n_prompt_turns"] == 1 and got[4]["chosen"] == "<|im_start|>user\nt<|im_end|>\n"
    answers = by_id(chat_format.pair_answers(df), "pair")
    assert sorted(answers) == [0, 1, 2, 3, 6, 7, 8, 9]
    r = answers[0]
    assert r["n_prompt_turns"] == 2 and r["chosen"] == "<|im_start|>assistant\ngood < |im_end|><|im_end|>\n" and r["rejected"] == "<|im_start|>user\n<|im_end|>\n"
    assert answers[1]["n_prompt_turns"] == 3 and answers[1]["rejected"][22:48] == "good < |im_end|><|im_end|>" and answers[1]["rejected_spans"] == "22-48" and answers[2]["chosen"] == answers[2]["rejected"] == ""
    assert chat_format.pair_answers(df.limit(0)).count() == 0
    assert not re.search("Python|Pandas|Arrow", chat_format.pair_answers(df)._jdf.queryExecution().toString())


def test_chat_of_the_tables(spark):
    """Most prompts hold the conversation up to its answer; each is rendered as a plain version does."""
    import os

    path = "/root/testdata/sf0.001/conversations.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables")
    df = spark.read.parquet(path)
    own = {}
    for r in sorted(df.collect(), key=lambda r: (r["turn"], r["role"], r["text"])):
        own.setdefault(r["conv_id"], []).append((r["role"], r["text"].replace("<|", "< |")))
    render = lambda ts: "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in ts)
    got = by_id(chat_format.pair_answers(df), "pair")
    assert sorted(got) == sorted(c for c in own if c ^ 1 in own)
    for c, r in got.items():
        other = [*own[c][:-1], own[c ^ 1][-1]]
        n = next((i for i, (x, y) in enumerate(zip(own[c], other, strict=True)) if x != y), len(other))
        assert (r["n_prompt_turns"], r["prompt"], r["chosen"], r["rejected"]) == (n, render(own[c][:n]), render(own[c][n:]), render(other[n:]))
    assert sum(r["prompt"] != "" for r in got.values()) > 0.8 * len(got)


# 9 -------------------------------------------------------------------------------------------------------------------
def test_license_bounds():
    for width, stride, own in license_scan.classes(license_scan.TEMPLATES):
        for tokens in own.values():
            parts = license_scan.shingles(tokens)
            size = min(license_scan.SHINGLE, len(tokens))
            inner, need = width - size + 1, -(-len(parts) * 8 // 10)
            assert need / (inner + len(parts) - need) >= 0.44 and 1 - 0.56**license_scan.BANDS > 0.9999
            assert len(tokens) + stride - 1 <= width  # every place of the template lies whole in a window
            # a shingle in five or more goes with the anchors
            assert sum(any(a in p for a in license_scan.ANCHORS) for p in parts) > 0.2 * len(parts)


def test_licenses(spark):
    rng = random.Random(8)
    texts = [prose(rng, 200)]
    for t in license_scan.TEMPLATES.values():
        texts.append(f"{prose(rng, rng.randint(0, 90))} {t.upper()} {prose(rng, 50)}")
    words = license_scan.TEMPLATES["mit"].split()
    texts += [" ".join(words[: len(words) // 2]), " ".join([*words[:60], "changed", *words[61:]]), "license license software", *ODD]
    got = {}
    for r in license_scan.scan(docs(spark, texts, extra=True)).collect():
        got.setdefault(r["doc_id"], {})[r["license"]] = r["containment"]
    want = {}
    for i, t in enumerate(texts):
        tokens = license_scan.words(t or "")
        for width, stride, own in license_scan.classes(license_scan.TEMPLATES):
            size = min(license_scan.SHINGLE, min(map(len, own.values())))
            every = [" ".join(tokens[k : k + size]) for k in range(max(len(tokens) - size + 1, 1))]
            for name, template in own.items():
                parts = {" ".join(template[k : k + size]) for k in range(len(template) - size + 1)}
                best = max((len(parts & set(every[k : k + width - size + 1])) / len(parts) for k in range(0, len(every), stride)), default=0)
                if best >= 0.8:
                    want.setdefault(i, {})[name] = pytest.approx(best)
    assert got == want and all(len(got[i + 1]) >= 1 for i in range(len(license_scan.TEMPLATES)))
    assert license_scan.scan(docs(spark, ["a"]).limit(0)).count() == 0
    assert not re.search("Python|Pandas|Arrow", license_scan.scan(docs(spark, ["a"]))._jdf.queryExecution().toString())


def test_license_templates(spark):
    rng = random.Random(12)
    own = {"no words": " ... ", "it's \"quoted\" \\ one": "you may keep it's parts", "short": "keep", "long": prose(rng, 60), "long again": ""}
    own["long again"] = own["long"]
    texts = ["x", f"{prose(rng, 40)} {own['long']} {prose(rng, 9)}", "You may KEEP it's parts", "keep", None, "", "..."]
    df = docs(spark, texts, extra=True).unionByName(docs(spark, texts, extra=True).filter("doc_id = 3"))
    got = {(r["doc_id"], r["license"]): (r["containment"], r["n_windows"] > 0) for r in license_scan.scan(df, templates=own).collect()}
    assert got == {(1, "long"): (1, True), (1, "long again"): (1, True), (2, 'it\'s "quoted" \\ one'): (1, True), (2, "short"): (1, True), (3, "short"): (1, True)}
    half = own["long"].split()
    less = docs(spark, [" ".join(half[:40])])
    assert license_scan.scan(less, templates=own).count() == 0 and license_scan.scan(less, templates=own, least=0.5).count() == 2
    for empty in ({}, {"no words": "!"}):
        none = license_scan.scan(df, templates=empty)
        assert none.count() == 0 and none.columns == ["doc_id", "license", "containment", "n_windows"]


# 10 ------------------------------------------------------------------------------------------------------------------
def brute_components(texts, k=3, percent=90):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def edited(rng, words, share):
    return [w + "q" if rng.random() < share else w for w in words]


@pytest.mark.parametrize("nearest", [1, 64])
def test_jaccard_join(spark, monkeypatch, nearest):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "NEAREST", nearest)
    rng = random.Random(9)
    texts = []
    for n in (8, 12, 20, 40, 150, 600):
        base = prose(rng, n).split()
        for share in (0, 0, 0.01, 0.02, 0.03, 0.05) * 4:
            texts.append(" ".join(edited(rng, base, share)))
        chain = base
        for _ in range(6):  # each near the last, the ends far apart
            chain = edited(rng, chain, 0.012)
            texts.append(" ".join(chain))
    texts += [prose(rng, rng.randint(1, 60)) for _ in range(60)] + ["One two", "one TWO", "one", *ODD]
    rng.shuffle(texts)
    df = docs(spark, texts, extra=True)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect()}
    want = brute_components(texts)
    assert got == want and len({c for _, c in want.values()}) < len(texts) - 60
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {c for _, c in want.values()}
    assert jaccard_join.jaccard_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_every_linked_pair_shares_a_key(percent):
    tiles, rng = jaccard_join.Tiles(percent), np.random.default_rng(1)
    for _ in range(400):
        n = int(rng.integers(5, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        drop, add = rng.integers(0, n // 10 + 1, 2)
        b = np.unique(np.concatenate((a[int(drop) :], rng.integers(0, 2**63, int(add)).astype(np.uint64) * np.uint64(2) + np.uint64(1))))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < percent * (len(a) + len(b) - both) or len(a) == len(b) == both:
            continue
        keys = [{(t, k) for t, high in tiles.of(len(x)) for k in jaccard_join.keys_and_bits(x, t, tiles.difference(high))[0].tolist()} for x in (a, b)]
        assert keys[0] & keys[1]
        shared = {t for t, _ in tiles.of(len(a))} & {t for t, _ in tiles.of(len(b))}
        for t, high in tiles.of(len(a)):
            if t in shared:
                x, y = (np.frombuffer(jaccard_join.keys_and_bits(z, t, tiles.difference(high))[1], np.uint64) for z in (a, b))
                assert np.bitwise_count(x ^ y).sum() <= tiles.allowed(len(a), len(b))


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (3, 1), *[(100 + i, 101 + i) for i in range(40)], *[(200, 300 + i) for i in range(30)]]
    got = dict(connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert {got[i] for i in (1, 2, 3)} == {1} and got[5] == 4 and got[9] == 9
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in [200, *range(300, 330)]} == {200}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_plan(spark, monkeypatch):
    """A step reads its edges four times, not sixteen: the driver plans each anew whenever a shuffle ends. The same roots as by
    a search, with repeated edges, both directions and loops."""
    leaves = []

    def cut(df, merge=0):
        leaves.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return scratch.cut(df, merge)

    monkeypatch.setattr(components, "cut", cut)
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]
    edges += [(b, a) for a, b in edges[:50]] + edges[:20] + [(i, i) for i in range(390, 410)] + [(7, 500 + i) for i in range(60)]
    got = connected_components(scratch.cut(spark.createDataFrame(edges, "a bigint, b bigint"))).collect()
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert sorted(map(tuple, got)) == sorted(root.items())
    assert len(leaves) > 1 and max(leaves) <= 4
