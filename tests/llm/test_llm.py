"""The ten operators against brute force on small tables, and the cases every operator must bear."""

import hashlib
import itertools
import math
import random
import re
import struct
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import html, langid, lattice, mixing, pieces, pii, quality, simhash, tokens, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], DOCS)


def prose(r, n):
    words = ["the", "of", "and", "to", "in", "lamp", "river", "stone", "quiet", "garden", "window", "letter", "morning", "paper", "house", "bridge"]
    return " ".join(r.choice(words) + r.choice(("", "", "", "s", "ly", "er")) for _ in range(n))


EDGE = [(1, None, "en", "a"), (2, "", None, None), (3, " \n\t", "en", "a"), (3, " \n\t", "en", "a"), (None, "x y", "en", "b"), (5, "é" * 300_000, "fr", "b"), (6, "a\x00b ▁ \U0001f600", "en", "c")]


# ---- urls


def test_url_rules_and_list(spark):
    rows = [
        (1, "https://www.Example.org/es/x?y"), (2, "http://a.example.org/en/12"), (3, "http://x.org"), (4, "http://x.org/"), (5, "ftp://q.com/de/1"), (6, "http://q.com/fr/1"),
        (7, None), (8, "nothing"), (9, "http://bad.net/a/?utm_source=q#z"), (10, "https://BAD.net:443/a"), (11, "http://badexample.org/es/"), (12, "http://bad.net/a?b=1&a=2"), (9, "http://bad.net/a/?utm_source=q#z"),
    ]
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in rows], "page_id long, url string, host string, verdict string")
    listed = spark.createDataFrame([("http://www.bad.net/a",), (None,), ("x",)], "url string")
    out = urls.judge(df, listed)
    assert out.columns[:4] == df.columns and "_host" in out.columns
    got = {r["page_id"]: (r["_host"], r["path"], r["rule"], r["_verdict"]) for r in out.collect()}
    assert out.count() == len(rows)
    assert got[1] == ("www.example.org", "/es/x", "example.org/es/", "block")
    assert got[2][2:] == ("example.org/en/1", "block")
    assert got[3] == ("x.org", "", None, "allow")
    assert got[4][2:] == ("org/", "allow")
    assert got[5][2:] == ("com/de/", "block") and got[6][2:] == ("com/fr/", "allow")
    assert got[7] == got[8] == ("", "", None, "allow")
    assert got[9][3] == got[10][3] == "block" and got[12][3] == "allow"
    assert got[11][2:] == ("org/", "allow")
    assert urls.judge(df.limit(0), listed).count() == 0
    assert urls.judge(df, listed.limit(0)).where("_verdict = 'block'").count() == 3


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"))
    listed = keys.where("substr(k, -1) = '7'")
    got = urls.in_list(keys, "k", listed)
    assert got.where("listed <> (substr(k, -1) = '7')").count() == 0 and got.count() == 5000


def test_hot_urls_are_dealt_out(spark, monkeypatch):
    keys = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"))
    listed = spark.createDataFrame([("hot",), ("k4",), ("k5",), ("none",), (None,)], "k string")
    monkeypatch.setattr(urls, "HOT_HITS", 100)
    got = urls.in_list(keys, "k", listed)
    assert got.count() == 9000 and got.where("listed <> (k in ('hot', 'k4', 'k5'))").count() == 0


# ---- language


def test_language_held_out(spark):
    r = random.Random(1)
    words = {"en": "the of and house water".split(), "de": "der und nicht haus wasser".split(), "fr": "les des maison avec eau".split()}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(30)), lang, "s") for i in range(300) for lang in [r.choice(list(words))]]
    df = docs(spark, rows)
    model = langid.fit(df.where(~langid.held_out()))
    got = langid.predict(df.drop("lang"), model).collect()
    truth = {i: lang for i, _, lang, _ in rows}
    assert all(truth[x["doc_id"]] == x["lang_pred"] and 0 <= x["score"] <= 1 for x in got)
    held = {x["doc_id"] for x in df.where(langid.held_out()).collect()}
    assert held == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    edge = {(x["doc_id"], x["lang_pred"]) for x in langid.predict(docs(spark, EDGE), model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= edge and (5, "und") not in edge
    none = langid.fit(df.limit(0))
    assert {x["lang_pred"] for x in langid.predict(df, none).collect()} == {"und"}


def test_grams_of_parts_add_up():
    texts = ["Ab c", "", "ÄÖ 12 z"]
    b, o, has = langid.grams(texts)
    for i, t in enumerate(texts):
        own, _, h = langid.grams([t])
        assert Counter(b[o == i].tolist()) == Counter(own.tolist()) and has[i] == h[0]


# ---- mixing


def edf(p):
    """One period of Pfair windows, slot by slot."""
    q, k, out = sum(p), [0] * len(p), []
    for t in range(q):
        ready = [(-(-(k[i] + 1) * q // p[i]), i) for i in range(len(p)) if k[i] < p[i] and k[i] * q // p[i] <= t]
        i = min(ready)[1]
        out.append((i, k[i]))
        k[i] += 1
    return out


@pytest.mark.parametrize("p", [[1], [3, 1], [5, 3, 2], [7, 7, 1, 5], [97, 2, 1]])
def test_schedule_is_earliest_deadline_first(spark, p):
    row = spark.createDataFrame([([(f"s{i}", 1, x) for i, x in enumerate(p)], sum(p))], "src array<struct<key:string,n:long,p:long>>, q long")
    got = [(r["key"], r["k"]) for r in mixing.schedule(row).orderBy("slot").collect()]
    want = edf(p)
    assert got == [(f"s{i}", k) for i, k in want]
    done = [0] * len(p)
    for t, (i, _) in enumerate(want, 1):
        done[i] += 1
        assert all(abs(done[j] - t * p[j] / sum(p)) < 1 for j in range(len(p)))


def test_mix_reaches_targets_and_keeps_all(spark):
    rows = [(i, "t", "en", "big" if i % 3 else ("small" if i % 2 else None)) for i in range(900)] + [(7, "t", "en", "big")]
    df = docs(spark, rows).withColumn("slot", F.lit(1))
    out = mixing.mix(df, block_rows=4, slots=50)
    assert "_slot" in out.columns
    got = out.collect()
    assert Counter(r["doc_id"] for r in got if r["epoch"] == 0) == Counter(i for i, *_ in rows)
    n = Counter(s for *_, s in rows)
    w = {s: c**mixing.SMOOTHING for s, c in n.items()}
    p = {s: max(1, round(50 * x / sum(w.values()))) for s, x in w.items()}
    total = Counter(r["source"] for r in got)
    whole = max(math.ceil(n[s] * sum(p.values()) / p[s]) for s in n)
    assert total == {s: max(n[s], math.ceil(whole * p[s] / sum(p.values()))) for s in n}
    slots = {}
    for r in got:
        assert slots.setdefault(r["_slot"], r["source"]) == r["source"]
    done = Counter()
    for t in range(1, len(slots) - max(len(p), 3)):
        done[slots[t - 1]] += 1
        assert all(abs(done[s] - t * p[s] / sum(p.values())) < 1 for s in p)
    assert len({r["position"] for r in got}) == len(got)
    assert mixing.mix(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="no weight"):
        mixing.mix(df, weights={"big": 1.0}).collect()
    assert mixing.mix(docs(spark, EDGE)).where("epoch = 0").count() == len(EDGE)


# ---- pieces


def segmentations(text, v):
    """All ways to spell a part, with log probabilities."""
    if not text:
        return [((), 0.0)]
    out = []
    single = text[0] in v.pieces
    for n in range(1, len(text) + 1):
        if text[:n] in v.pieces:
            i = v.pieces.index(text[:n])
            out += [((i, *rest), v.score[i] + s) for rest, s in segmentations(text[n:], v)]
    if not single:
        b = tuple(int(v.byte_ids[x]) for x in text[0].encode())
        out += [((*b, *rest), len(b) * v.byte_score + s) for rest, s in segmentations(text[1:], v)]
    return out


def test_sampling_follows_the_lattice():
    v = pieces.load(pieces.default_model())
    n = 6000
    ids, count = pieces.encode(["them๏in"] * n, np.arange(n, dtype=np.uint64), v)
    ends = np.cumsum(count)
    got = Counter(tuple(ids[e - c : e].tolist()) for e, c in zip(ends, count))
    ways = segmentations("▁them๏in", v)
    z = np.logaddexp.reduce([s for _, s in ways])
    want = {w: math.exp(s - z) for w, s in ways}
    assert set(got) <= set(want)
    assert sum(abs(got[w] / n - p) for w, p in want.items()) < 0.08


def test_pieces_round_trip(spark):
    r = random.Random(2)
    alphabet = ["a", "the", " ", "  ", "\n", "▁", "é", "日本", "😀", "\t", ".", "ing", "\x00", "x" * 40]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(300)]
    df = docs(spark, EDGE + [(100 + i, t, "en", "s") for i, t in enumerate(texts)])
    out = pieces.encoded(df, carry=("doc_id", "text"))
    assert out.where("not lossless").count() == 0
    back = pieces.decoded(out, out="again")
    assert back.where("coalesce(text, '') <> again").count() == 0
    twice = pieces.encoded(df.repartition(7)).groupBy("doc_id").agg(F.count_distinct("ids").alias("n")).where("n > 1 and doc_id is not null")
    assert twice.count() == 0
    assert pieces.encoded(df.limit(0)).count() == 0
    a = {x["doc_id"]: x["ids"] for x in out.where("doc_id >= 100").collect()}
    b = {x["doc_id"]: x["ids"] for x in pieces.encoded(df.repartition(5)).where("doc_id >= 100").collect()}
    c = {x["doc_id"]: x["ids"] for x in pieces.encoded(df, seed=9).where("doc_id >= 100").collect()}
    assert a == b != c


# ---- embeddings


def test_lattice_matches_brute_force(spark):
    r = np.random.default_rng(4)
    base = r.standard_normal((120, 64))
    rows = []
    for i, b in enumerate(base):
        for _ in range(1 + i % 4):
            noise = r.standard_normal(64) * np.linalg.norm(b) / 8 * r.choice([0.0, 0.15, 0.3, 0.36])
            rows.append(b + noise)
    rows = [[float(np.float32(x)) for x in v] for v in rows]
    bad = [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [1.0] * 3]
    data = [(i, v, 1) for i, v in enumerate(rows + bad)]
    df = spark.createDataFrame([(*x, "c") for x in data], "vec_id long, embedding array<double>, label int, kept string")
    got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in lattice.near_duplicates(df).collect()}
    m = np.array(rows) / np.linalg.norm(rows, axis=1)[:, None]
    near = m @ m.T >= 0.95
    comp = np.arange(len(rows))
    while True:
        new = np.array([comp[near[i]].min() for i in range(len(rows))])
        if (new == comp).all():
            break
        comp = new
    for i in range(len(rows)):
        assert got[i] == (near[i].sum() - 1, comp[i], bool(comp[i] == i))
    for i in range(len(rows), len(data)):
        assert got[i] == (0, i, True)
    assert lattice.near_duplicates(df.limit(0)).count() == 0


def test_e8_nearest():
    r = np.random.default_rng(1)
    x = r.uniform(-2, 2, (200, 8))
    p = lattice.e8_nearest(x)
    assert ((p * 2 == np.rint(p * 2)).all()) and (np.rint(p.sum(axis=1)) % 2 == 0).all()
    roots = lattice.e8_roots()
    assert len(roots) == 240 and np.allclose((roots**2).sum(axis=1), 2)
    own = ((x - p) ** 2).sum(axis=1)
    assert all((((x - p) - v) ** 2).sum(axis=1).min() >= 0 and (own <= (((x - p) - v) ** 2).sum(axis=1) + 1e-9).all() for v in roots)


# ---- tokens


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    r = random.Random(5)
    alphabet = [" ", "  ", "\n", ".", ",", "a", "é", "日", "1", "_", "'s", "\t", "\x01", "word", "<|endoftext|>", "!!"]
    rows = [(i, "".join(r.choice(alphabet) for _ in range(r.randint(0, 30))), "en", "s") for i in range(500)] + [(900, None, "en", "s"), (901, "", "en", "s"), (902, "long " * 100_000, "en", "s")]
    r.shuffle(rows)
    df = docs(spark, rows).withColumn("ids", F.lit(1))
    t = Tokenizer.from_file(tokens.default_tokenizer())
    t.encode_special_tokens = True
    for encoding in ("dictionary", "delta"):
        path = f"file://{tmp_path}/{encoding}"
        tokens.write(df, path, encoding=encoding)
        files = tokens.read(spark, path)
        got = {x["id"]: (x["start"], x["n_tokens"], x["ids_crc32"]) for x in tokens.digests(files).collect()}
        own = {x["id"]: x["start"] for x in tokens.starts(files).collect()}
        start = 0
        for i, text, *_ in sorted(rows):
            ids = t.encode(text or "", add_special_tokens=False).ids + [0]
            assert got[i] == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))) and own[i] == start
            start += len(ids)
    plan = files.where("id = 7").select("n_tokens")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,7)]" in plan and "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    tokens.write(df.limit(0), f"file://{tmp_path}/empty")
    assert tokens.digests(tokens.read(spark, f"file://{tmp_path}/empty")).count() == 0


# ---- html


def test_html_blocks():
    text = lambda h: "\n".join(html.parse(h)[0])
    assert text("<head><title>no</title></head><body><nav><a>menu</a></nav><article><h1>A &amp; B</h1><p>one<b> two\n three</b><br>x<p>four<script>var t='</p>'</script></article><footer>f</footer>") == "A & B\none two three x\nfour"
    assert text("<div class='main has-sidebar'><p>a</p><div class='sidebar'>no</div><div id='comments'><p>no</p></div><form>no</form></div>") == "a"
    assert text("<article><header><h1>H</h1></header><p>x</p><section class='comments'><article>no</article></section></article>") == "H\nx"
    assert text("<table><tr><td>a<td>b<tr><td>c</table>tail") == "a b\nc\ntail"
    assert text("<ul><li>1<li>2</ul><div hidden>no</div><p style='display: none'>no</p>") == "1\n2"
    assert text(None) == text("") == "" and text("plain  text") == "plain text"
    assert text("<p>a<!-- <p>no</p> -->b</p></div></b>c") == "ab\nc"


def test_templates_are_deleted(spark):
    page = lambda i, extra: f"<body><div><p>{'Join our list' if i % 2 else 'Join our list'}</p></div><div><p>Story {i} of the day</p>{extra}</div></body>"
    rows = [(i, f"http://h.example/{i}", page(i, "<p>shared by two</p>" if i < 2 else ""), "x") for i in range(12)]
    rows += [(100, None, None, "x"), (101, "http://other.example/1", page(1, ""), "x"), (101, "http://other.example/1", page(1, ""), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, lines string")
    got = [(x["page_id"], x["text"]) for x in html.main_text(df).collect()]
    assert sorted(got, key=str)[:1] and dict(got)[5] == "Story 5 of the day" and dict(got)[1] == "Story 1 of the day\nshared by two"
    assert dict(got)[100] == "" and got.count((101, "Join our list\nStory 1 of the day")) == 2
    assert html.main_text(df.limit(0)).count() == 0


def test_copied_articles_keep_their_text(spark):
    """Copies of one article count once; what is a template outside articles is none inside them."""
    page = lambda inner: f"<body><div class='x'><div>Read more here</div></div><article>{inner}</article></body>"
    story = lambda i: f"<h1>Title {i}</h1><p>Text {i} of the story.</p>"
    rows = [(i, f"http://one.example/{i}", page(story(0))) for i in range(6)]
    rows += [(100 + i, f"http://half.example/{i}", page(story(max(0, i - 9)))) for i in range(20)]
    quoted = "<div>Read more here</div>"
    rows += [(200 + i, f"http://quote.example/{i}", page(story(i) + (quoted if i < 2 else "") + "<p>Sent from our desk</p>")) for i in range(12)]
    rows += [(300 + i, f"http://same.example/{i}", page("<p>Only this</p>" if i % 2 else f"<p>Only this</p><p>And {i}</p>")) for i in range(20)]
    got = {x["page_id"]: x["text"] for x in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = lambda i: f"Title {i}\nText {i} of the story."
    assert all(got[i] == text(0) for i in range(6))
    assert all(got[100 + i] == text(max(0, i - 9)) for i in range(20))
    assert all(got[200 + i] == text(i) + ("\nRead more here" if i < 2 else "") for i in range(12))
    assert all(got[300 + i] == ("Only this" if i % 2 else f"And {i}") for i in range(20))


# ---- SimHash


def brute_fingerprint(text, k=4):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def union(pairs, ids):
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_copies(r, n):
    rows = []
    for i in range(n):
        words = prose(r, 220).split()
        rows.append(" ".join(words))
        for k in range(i % 4):
            copy = list(words)
            for _ in range(k):
                copy[r.randrange(len(copy))] = "changed"
            rows.append(" ".join(copy))
    return rows


def test_simhash_matches_brute_force(spark):
    r = random.Random(6)
    texts = near_copies(r, 60) + ["", None, "Ab  c\x0bd é", " x", "one"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    got = {x["doc_id"]: (x["fingerprint"], x["component_id"]) for x in simhash.classes(docs(spark, rows)).collect()}
    fp = {i: brute_fingerprint(t) for i, t, *_ in rows}
    want = union([(a, b) for a, b in itertools.combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 4], fp)
    assert got == {i: (f"{fp[i]:016x}", want[i]) for i in fp}
    assert simhash.classes(docs(spark, rows).limit(0)).count() == 0


def test_simhash_links_on_random_fingerprints(spark):
    """Chains of fingerprints up to four bits apart, in every segment."""
    from lodestone.llm.common import Scratch

    r = random.Random(8)
    fps = set()
    for _ in range(80):
        f = r.getrandbits(64)
        for _ in range(r.randint(1, 5)):
            fps.add(f)
            for b in r.sample(range(64), r.randint(0, 6)):
                f ^= 1 << b
    signed = {f - (1 << 64) if f >> 63 else f for f in fps}
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    scratch = Scratch(spark, "t")
    got = {x["id"]: x["component"] for x in simhash.links(df, scratch).collect()}
    mask = (1 << 64) - 1
    want = union([(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & mask).bit_count() <= 4], signed)
    assert {f: got.get(f, f) for f in signed} == want


def test_dedup_takes_similarity_from_eight_tenths(spark):
    r = random.Random(9)
    texts = []
    for i in range(80):
        words = prose(r, 300).split()
        texts += [" ".join(words)] * (1 + i % 2)
        if i % 2:
            copy = list(words)
            for _ in range(3):
                copy[r.randrange(300)] = "other"
            texts.append(" ".join(copy))
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    kept = {x["doc_id"] for x in simhash.dedup(docs(spark, [*rows, rows[0]])).collect()}
    shingles = {i: {tuple(t.split()[k : k + 5]) for k in range(296)} for i, t, *_ in rows}
    pairs = [(a, b) for a, b in itertools.combinations(shingles, 2) if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
    want = union(pairs, shingles)
    top = {i for i in want if want[i] == i}
    assert top == kept
    assert simhash.dedup(docs(spark, rows).limit(0)).count() == 0
    assert simhash.dedup(docs(spark, EDGE)).count() == 3


def jaccard_classes(texts, k=5):
    """The links of exact similarity 0.8 by brute force: texts by index."""
    words = [(t or "").lower().split() for t in texts]
    sets = {i: {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} for i, w in enumerate(words)}
    return union([(a, b) for a, b in itertools.combinations(sets, 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])], sets)


@pytest.mark.parametrize("hot", [False, True])
def test_dedup_links_exactly_from_eight_tenths(spark, monkeypatch, hot):
    """Copies with similarities from 0.6 to 0.85, short, long and repetitive ones, and a large group around the limit."""
    if hot:
        monkeypatch.setattr(simhash, "STAR_ROWS", 3)
    r = random.Random(21)
    word = lambda: f"w{r.randrange(9999)}"
    texts = ["on and on and " * 50, "on and on and " * 50 + "on", "so it goes " * 70]
    for i in range(60):
        n = r.choice((6, 12, 40, 300, 700))
        words = [word() for _ in range(n)] if i % 3 else "terms of use apply to all pages here".split() * (n // 8) + [word() for _ in range(n)]
        texts.append(" ".join(words))
        for _ in range(3):
            copy = list(words)
            for _ in range(round(len(words) * r.uniform(0.015, 0.055)) or 1):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy[: round(len(copy) * r.uniform(0.92, 1))]))
    base = [word() for _ in range(200)]
    for _ in range(40):
        copy = list(base)
        for at in r.sample(range(200), 3):
            copy[at] = word()
        texts.append(" ".join(copy))
    want = jaccard_classes(texts)
    got = {x["doc_id"] for x in simhash.dedup(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert got == {i for i in want if want[i] == i}


def test_dedup_keeps_rows_without_or_with_repeated_ids(spark):
    r = random.Random(22)
    a, b, c, d, e = (prose(r, 60) for _ in range(5))
    rows = [(None, a), (None, b), (None, b + " end"), (7, c), (7, d), (8, c), (9, e), (None, e), (None, None), (None, "")]
    df = docs(spark, [(i, t, "en", "s") for i, t in rows])
    got = [(x["doc_id"], x["text"]) for x in simhash.dedup(df, without_id=True).collect()]
    assert len(got) == 6 and {(None, a), (7, c), (7, d), (9, e)} < set(got)
    assert sum(t in (b, b + " end") for _, t in got) == 1 and sum(not t for _, t in got) == 1
    assert sorted((x["doc_id"], x["text"]) for x in simhash.dedup(df).collect()) == sorted([(7, c), (7, d), (9, e)])


# ---- quality


def brute_quality(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
        seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)]


def test_quality_base_counts():
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice(["a ", "b ", "c\n", "a b c d e ", "#", " \n", "é", " ", "\x0b", "x y\n", "|"]) for _ in range(r.randint(0, 60)))
        assert quality.features(text)[0] == brute_quality(text)
    assert quality.features(None)[0] == [0] * 5


def test_quality_verdicts(spark):
    r = random.Random(4)
    good = [(i, ". ".join(prose(r, 12).capitalize() for _ in range(12)) + ".", "en", "s") for i in range(60)]
    shout = (200, good[0][1].upper().replace(" ", "!! "), "en", "s")
    noise = (201, " ".join(w + r.choice(["$$$", "%%%", "###"]) for w in good[1][1].split()), "en", "s")
    again = (202, "one two three four five six " * 40, "en", "s")
    df = docs(spark, [*good, shout, noise, again, *EDGE]).withColumn("n_words", F.lit("x"))
    got = {x["doc_id"]: x for x in quality.judge(df).collect()}
    assert all(got[i]["kept"] for i, *_ in good if i not in (1, 2, 3, 5, 6))
    assert not got[200]["kept"] and not got[201]["kept"] and not got[200]["base_failed"]
    assert got[202]["base_failed"] and not got[202]["kept"]
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and kept.where("doc_id in (200, 201, 202)").count() == 0
    assert kept.count() == sum(x["kept"] for x in quality.judge(df).collect())
    assert quality.judge(df.limit(0)).count() == 0 and quality.keep_good(df.limit(0)).count() == 0


def test_quality_short_text_without_common_words(spark):
    """Menus and fragments of 40 to 99 words have no common words; prose of that length stays, whatever its language."""
    r = random.Random(14)
    nouns = "lamp river stone quiet garden window letter morning paper house bridge".split()
    line = lambda: " ".join(r.choice("the of and to in a is that for it".split() if r.random() < 0.3 else nouns) for _ in range(10)).capitalize()
    good = [(i, ". ".join(line() for _ in range(r.choice((5, 8, 20)))) + ".", "en", "s") for i in range(80)]
    bare = [(200 + i, ". ".join(" ".join(r.choice(nouns) for _ in range(10)).capitalize() for _ in range(n)) + ".", "en", "s") for i, n in enumerate((4, 6, 9, 15))]
    other = [(300 + i, ". ".join(" ".join(r.choice(nouns) for _ in range(10)).capitalize() for _ in range(6)) + ".", "xx", "s") for i in range(9)]
    df = docs(spark, [*good, *bare, *other])
    kept = {x["doc_id"] for x in quality.judge(df).where("kept").collect()}
    assert kept == {x["doc_id"] for x in quality.keep_good(df).collect()}
    assert not kept & {i for i, *_ in bare} and {i for i, *_ in other} <= kept
    assert len(kept & {i for i, *_ in good}) >= 0.95 * len([t for _, t, *_ in good if quality.verdict(t, "en", {})])


def test_distance_is_a_distance():
    p = np.array([[1.0, 1, 0], [0, 0, 5]])
    d = quality.distances(p, np.array([0.5, 0.5, 0]))
    assert d[0] == 0 and abs(d[1] - 1) < 1e-12


# ---- personal data


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(text):
    out = []
    for k, p in enumerate(PATTERNS.values()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(d) <= 19 and luhn(d), 10 <= len(d) <= 15)[k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base_spans(spark):
    r = random.Random(11)
    bits = ["a@b.c", "@", ".", "1.2.3.4", "300.1.1.1.2", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (212) 555-0199", "+44 20 7946 0958", " ", "x", "é😀", "79927398713", "5500000000000004", "-", "\n", "+", "7", "_d@e.fg", "0000001.2.3.4", "(", ")"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(1500)] + [None, "", "9" * 20_000, "a" * 20_000 + "@", "+1" + "(" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["spans"] for x in pii.with_spans(df, pii.fit(spark)).collect()}
    names = list(PATTERNS)
    for i, t in enumerate(texts):
        base = [(s["start"], s["kind"], s["end"]) for s in got[i] if s["kind"] < 4]
        assert base == brute_pii(t), t
        extra = [(s["start"], s["end"]) for s in got[i] if s["kind"] >= 4]
        assert not any(a < e and s < b for a, b in extra for s, _, e in base)
        assert all(b <= c for (_, b), (c, _) in itertools.pairwise(extra))
    listed = df.where("doc_id < 20").select("doc_id")
    assert listed.count() == 20
    digest = {x["doc_id"]: x["s"] for x in pii.with_spans(df, pii.fit(spark)).select("doc_id", pii.listed(F.filter("spans", lambda c: c["kind"] < 4)).alias("s")).collect()}
    assert all(digest[i] == ",".join(f"{names[k]}:{a}:{b}" for a, k, b in brute_pii(t)) for i, t in enumerate(texts))
    assert hashlib.sha256(digest[0].encode()).hexdigest()


def test_pii_method_spans_on_fresh_snippets(spark):
    rows = pii.snippets(800, seed=99)
    df = spark.createDataFrame([(i, x["text"], x["start"], x["end"], x["private"]) for i, x in enumerate(rows)], "doc_id long, text string, a int, b int, private boolean")
    got = pii.with_spans(df, pii.fit(spark)).collect()
    caught = [any(s["start"] < x["b"] and x["a"] < s["end"] for s in x["spans"]) for x in got]
    private = [x["private"] for x in got]
    recall = sum(c for c, p in zip(caught, private) if p) / sum(private)
    alarms = sum(c for c, p in zip(caught, private) if not p) / (len(private) - sum(private))
    assert recall > 0.9 and alarms < 0.12, (recall, alarms)
    clean = spark.createDataFrame([(i, prose(random.Random(i), 100)) for i in range(100)], "doc_id long, text string")
    assert pii.with_spans(clean, pii.fit(spark)).where("size(spans) > 0").count() == 0


def test_trees_in_sql_equal_trees_in_python(spark):
    r = np.random.default_rng(2)
    x = r.integers(0, 5, (400, len(pii.FEATURES))).astype(float)
    y = ((x[:, 1] > 2) ^ (x[:, 4] > 1)).astype(float)
    start, forest = pii.fit_trees(x, y, trees=15)
    score = np.array([start + sum(pii.tree_value(t, row) for t in forest) for row in x])
    assert ((score > 0) == (y > 0)).mean() > 0.95
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x[:50])], ["i", *pii.FEATURES])
    model = pii.Model(start, forest, {})
    got = df.select("i", model.score(F.struct(*pii.FEATURES)).alias("s")).collect()
    assert all(abs(g["s"] - score[g["i"]]) < 1e-9 for g in got)


def test_redaction(spark):
    rows = [(1, "mail a.b@c.example now, call +1 (212) 555-0199.", "en", "s"), (2, "nothing here", "en", "s"), (3, None, "en", "s"), (4, 'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" é', "en", "s")]
    df = docs(spark, [*rows, *[(10 + (i or 0), *x) for i, *x in EDGE]]).withColumn("spans", F.lit(0))
    out = pii.redact(df, n_chars="n_chars")
    got = {x["doc_id"]: x for x in out.collect()}
    assert out.columns == df.columns and out.count() == len(rows) + len(EDGE)
    assert got[1]["text"] == "mail <EMAIL> now, call <PHONE>." and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == "nothing here" and got[3]["text"] is None
    assert got[4]["text"] == 'token = "<SECRET>" é'
    assert pii.redact(df.limit(0)).count() == 0


def test_unicode_categories_of_classes():
    assert [quality.CLASSES[quality.class_table()[ord(c)]] for c in "aB日1 .([#́"] == ["lower", "upper", "letter", "digit", "space", "sentence", "bracket", "bracket", "symbol", "mark"]
    assert unicodedata.category("́") == "Mn"
